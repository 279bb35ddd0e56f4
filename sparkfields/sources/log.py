"""Event streams with gapless offsets, numbered where they are written."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..streaming.tables import Manifest
from .files import STREAM



class EventLog:
    """Streams of events under one folder; each stream's events have the offsets 1, 2, 3 and so on.

    append() numbers a frame without bringing a stream to one task: rows are
    dealt by ranges of (stream, order), counted in each range, and start where
    the ranges before them end. The counts of each append are kept with the
    offsets that follow, so a scan reads only the parts that hold what it asks for.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.manifest = Manifest(spark, root)

    def append(self, rows: DataFrame, stream: Column, order: list[Column], number: int, ranges: int | None = None) -> None:
        """Writes rows as append `number`, as compact JSON with their offsets; the same append again writes the same.

        A stream's name must not be blank or have a slash or two dots. Nulls come
        first in the order; rows alike in it are numbered in the order of their JSON.
        """
        staged = rows.select(stream.cast("string").alias("stream"), F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)]).alias("o"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("value"))
        if staged.where(~F.coalesce(F.col("stream").rlike(STREAM), F.lit(False))).limit(1).count():
            raise ValueError("stream name")
        keys = ["stream", "o", "value"]
        parted = staged.repartitionByRange(ranges, *keys) if ranges else staged.repartitionByRange(*keys)
        parted.withColumn("part", F.spark_partition_id()).write.mode("overwrite").parquet(f"{self.root}/staged")
        staged = self.spark.read.parquet(f"{self.root}/staged")
        # a row for each range of a stream
        counts = staged.groupBy("stream", "part").agg(F.count("*").alias("rows"))
        before = F.sum("rows").over(Window.partitionBy("stream").orderBy("part")) - F.col("rows")
        held = self.manifest.before(number) or {"next": {}, "appends": []}
        start = F.lit(1).cast("long")
        for name, upto in held["next"].items():
            start = F.when(F.col("stream") == name, F.lit(upto).cast("long")).otherwise(start)
        starts = counts.select("stream", (start + before).alias("first"), "rows", F.lit(number).alias("append"), "part")
        starts.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/parts/append={number}")
        starts = self.spark.read.parquet(f"{self.root}/parts/append={number}").select(F.col("stream").alias("s"), F.col("part").alias("p"), "first")
        inside = F.row_number().over(Window.partitionBy("stream", "part").orderBy("o", "value")) - 1
        numbered = staged.withColumn("inside", inside).join(starts, (F.col("stream") == F.col("s")) & (F.col("part") == F.col("p")))
        numbered = numbered.select("stream", "part", (F.col("first") + F.col("inside")).alias("offset"), "value")
        numbered.write.mode("overwrite").partitionBy("stream", "part").parquet(f"{self.root}/events/append={number}")
        ends = starts.sparkSession.read.parquet(f"{self.root}/parts/append={number}").groupBy("stream").agg(F.max(F.col("first") + F.col("rows")).alias("next"))
        following = held["next"] | {r["stream"]: r["next"] for r in ends.collect()}  # a number for each stream
        self.manifest.write(number, {"next": following, "appends": [*held["appends"], number]})

    def next_offsets(self) -> dict[str, int]:
        return (self.manifest.last() or {"next": {}})["next"]

    def parts(self) -> DataFrame:
        """(stream, first, rows, append, part): where each offset lies."""
        held = (self.manifest.last() or {"appends": []})["appends"]
        schema = "stream string, first bigint, rows bigint, append int, part int"
        if not held:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/parts").parquet(*[f"{self.root}/parts/append={n}" for n in held])

    def scan(self, stream: str, after: int = 0, count: int | None = None) -> DataFrame:
        """(offset, value) of a stream's events after an offset, at most `count`; only the parts that hold them are read."""
        if not re.match(STREAM, stream):
            raise ValueError(f"stream name: {stream!r}")
        upto = self.next_offsets().get(stream, 1) - 1
        upto = upto if count is None else min(upto, after + count)
        found = self.parts().where((F.col("stream") == stream) & (F.col("first") <= upto) & (F.col("first") + F.col("rows") > after + 1))
        at = [f"{self.root}/events/append={r['append']}/stream={stream}/part={r['part']}" for r in found.collect()]
        if not at:
            return self.spark.createDataFrame([], "offset bigint, value string")
        return self.spark.read.schema("offset bigint, value string").parquet(*at).where(F.col("offset").between(after + 1, upto))

    def poll(self, stream: str, consumer: str, handle: Callable[[DataFrame], None], count: int = 25, start: str = "beginning") -> int:
        """Gives a consumer the events that it has not had, at most `count` at a time, and returns how many polls there were.

        A consumer that is new starts at the beginning, or after the latest
        event. Its place is written after handle(rows) has ended, so a poll that
        fails is given again, and nothing is left out.
        """
        if start not in ("beginning", "latest"):
            raise ValueError("start is beginning or latest")
        places = Manifest(self.spark, f"{self.root}/consumers/{stream}/{consumer}")
        upto = self.next_offsets().get(stream, 1) - 1
        held = places.last()
        if held is None:
            held = {"poll": 0, "after": upto if start == "latest" else 0}
            places.write(0, held)
        polls = 0
        while held["after"] < upto:
            handle(self.scan(stream, held["after"], count))
            held = {"poll": held["poll"] + 1, "after": min(upto, held["after"] + count)}
            places.write(held["poll"], held)
            polls += 1
        return polls
