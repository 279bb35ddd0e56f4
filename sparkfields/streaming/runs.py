"""Runs a stream over what is there and gives back what it wrote."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The time of end marks, later than any item.
END = "2200-01-01 00:00:00"


def folder(spark: SparkSession) -> str:
    """A new folder under the shared one that spark.checkpoint.dir names; a temporary one where that is unset and Spark runs in this process alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(base or tempfile.mkdtemp(prefix='spark-stream-')).rstrip('/')}/stream-{uuid.uuid4().hex}"


def ended(stream: DataFrame, ts: str) -> DataFrame:
    """A stream and an end mark: a row of nulls but for a late time, which moves the watermark past all items, so that open groups close."""
    spark, at = stream.sparkSession, folder(stream.sparkSession)
    nulls = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != ts else F.lit(END).cast(f.dataType).alias(ts) for f in stream.schema.fields]
    spark.range(1).select(*nulls).write.parquet(at)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(at))


def run_now(stream: DataFrame) -> DataFrame:
    """Everything that the stream emits for the input there is now."""
    at = folder(stream.sparkSession)
    stream.writeStream.format("parquet").option("checkpointLocation", f"{at}/checkpoint").option("path", f"{at}/out").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/out")
