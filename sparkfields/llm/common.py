"""Small helpers that the operators of this folder share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession) -> str:
    """The shared folder for tables between steps: spark.checkpoint.dir; where that is unset and Spark runs in this process alone, a new one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not sc.getCheckpointDir():
        if named is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return (named or sc.getCheckpointDir()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the checkpoint folder that all executors share."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written as Parquet under the checkpoint folder: smaller than cut(), but the files stay there."""
    at = f"{folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.parquet(at)


def free(df: DataFrame, name: str) -> str:
    """A name like `name` that no column of df has, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_mod(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n; null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in smaller ones, so that fewer are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def sized(batches: Iterator[pa.RecordBatch], column: str, size: int = 8 << 20, rows: int = 4000) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in smaller ones, of about `size` bytes of a text column (one row at least)."""
    for batch in batches:
        held = pc.fill_null(pc.binary_length(batch.column(batch.schema.names.index(column))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at, upto = 0, np.cumsum(held)
        while at < len(held):
            before = upto[at - 1] if at else 0
            end = min(at + rows, max(at + 1, int(np.searchsorted(upto, before + size, "right"))))
            yield batch.slice(at, end - at)
            at = end
