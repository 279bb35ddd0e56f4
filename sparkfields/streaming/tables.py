"""Tables that micro-batches are merged into, at a cost that follows the batch and not what came before.

A table is a set of runs, folders that are never changed, and a manifest for each
batch that names the runs which hold after it. A batch writes its own run; when
`fanout` runs of a level are there, they are merged into one of the next, so each
row is rewritten about as often as there are levels. The manifest is one file and
comes last: a batch that is killed before has changed nothing, and one that runs
again starts from the manifest before it and writes the same.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FANOUT = 8


class Manifest:
    """What holds after each batch, as JSON."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, f"{root}/manifest"

    def _of(self, path: str) -> list[tuple[int, str]]:
        try:
            rows = self.spark.read.option("basePath", self.root).text(path)
            return [(int(r["batch"]), r["value"]) for r in rows.select("batch", "value").orderBy(F.desc("batch")).limit(1).collect()]
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return []
            raise

    def last(self) -> dict | None:
        found = self._of(self.root)
        return json.loads(found[0][1]) if found else None

    def before(self, number: int) -> dict | None:
        """As of the batch before; batches are numbered without gaps, else the manifests are listed."""
        found = self._of(f"{self.root}/batch={number - 1}") if number else []
        if not found:
            try:
                rows = self.spark.read.text(self.root).where(F.col("batch") < number).orderBy(F.desc("batch")).limit(1).collect()
            except AnalysisException as e:
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
                rows = []
            return json.loads(rows[0]["value"]) if rows else None
        return json.loads(found[0][1])

    def write(self, number: int, what: dict) -> None:
        self.spark.range(1).select(F.lit(json.dumps(what)).alias("value")).coalesce(1).write.mode("overwrite").text(f"{self.root}/batch={number}")


class Runs:
    """Rows that `merge` brings together; it may be used on any of its own results, in any order and grouping."""

    def __init__(self, spark: SparkSession, root: str, schema: str, merge: Callable[[DataFrame], DataFrame], fanout: int = FANOUT, by: list[str] | None = None):
        self.spark, self.root, self.schema, self.merge, self.fanout, self.by = spark, root, schema, merge, fanout, by or []
        self.manifest = Manifest(spark, root)

    def _rows(self, paths: list[str]) -> DataFrame:
        parts = [self.spark.read.schema(self.schema).parquet(f"{self.root}/{p}") for p in paths]
        out = parts[0] if parts else self.spark.createDataFrame([], self.schema)
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def raw(self, number: int | None = None) -> DataFrame:
        """The rows of all runs, not merged: as they are now, or before a batch."""
        held = self.manifest.last() if number is None else self.manifest.before(number)
        return self._rows([p for p, _ in held["runs"]] if held else [])

    def read(self, number: int | None = None) -> DataFrame:
        return self.merge(self.raw(number))

    def _write(self, rows: DataFrame, path: str) -> None:
        names = self._rows([]).columns
        rows.select(*names).write.mode("overwrite").partitionBy(*self.by).parquet(f"{self.root}/{path}")

    def add(self, rows: DataFrame, number: int) -> None:
        """Merges the rows of a batch in."""
        held = self.manifest.before(number)
        runs = [tuple(r) for r in held["runs"]] if held else []
        self._write(self.merge(rows), f"run-{number}-0")
        runs.append((f"run-{number}-0", 0))
        level = 0
        while len(full := [p for p, at in runs if at == level]) >= self.fanout:
            self._write(self.merge(self._rows(full)), f"run-{number}-{level + 1}")
            runs = [r for r in runs if r[1] != level] + [(f"run-{number}-{level + 1}", level + 1)]
            level += 1
        self.manifest.write(number, {"runs": runs})

    def vacuum(self) -> int:
        """Removes runs that the last manifest doesn't name; not while a batch or a reader is at work. Returns how many went."""
        held = {p for p, _ in (self.manifest.last() or {"runs": []})["runs"]}
        system, base = fs.FileSystem.from_uri(self.root)
        gone = [f for f in system.get_file_info(fs.FileSelector(base)) if f.base_name.startswith("run-") and f.base_name not in held]
        for f in gone:
            system.delete_dir(f.path)
        return len(gone)


class IdLog:
    """Ids that were seen, for ever, behind Bloom filters.

    An id sets 8 bits of one of `blocks` blocks of 256 bits (about 20 bits an id
    are right); filters of many batches are merged by OR. Ids that all filters
    refuse are new without a look at the log. The others are compared with the
    log's buckets that they fall into, so a full filter costs time but no row.
    """

    WORDS = [f"w{k}" for k in range(4)]

    def __init__(self, spark: SparkSession, root: str, blocks: int = 1 << 20, buckets: int = 64, fanout: int = FANOUT):
        self.blocks, self.buckets = blocks, buckets
        ors = [F.bit_or(w).alias(w) for w in self.WORDS]
        self.filters = Runs(spark, f"{root}/filters", "block int, w0 bigint, w1 bigint, w2 bigint, w3 bigint", lambda df: df.groupBy("block").agg(*ors), fanout)
        self.ids = Runs(spark, f"{root}/ids", "id string, bucket int", lambda df: df, fanout, ["bucket"])

    def _keyed(self, rows: DataFrame) -> DataFrame:
        """rows (id) with block, bucket, and the bits of each word."""
        h, g = F.xxhash64("id"), F.xxhash64(F.lit("bits"), "id")
        spots = [F.shiftrightunsigned(g, 8 * k).bitwiseAND(F.lit(255)).cast("int") for k in range(8)]
        one = F.lit(1).cast("long")
        words = []
        for k in range(4):
            bits = F.lit(0).cast("long")
            for s in spots:
                bits = bits.bitwiseOR(F.when(F.shiftright(s, 6) == k, F.call_function("shiftleft", one, s.bitwiseAND(F.lit(63)))).otherwise(F.lit(0).cast("long")))
            words.append(bits.alias(f"w{k}"))
        bucket = F.pmod(F.xxhash64(F.lit("bucket"), "id"), F.lit(self.buckets)).cast("int")
        return rows.select("id", F.pmod(h, F.lit(self.blocks)).cast("int").alias("block"), bucket.alias("bucket"), *words)

    def possible(self, rows: DataFrame, number: int | None = None) -> DataFrame:
        """(id, bucket) of the rows that a filter lets through; the rows of a batch are sent to the filters if they are few, never the other way."""
        held = self.filters.raw(number).withColumnsRenamed({w: f"f_{w}" for w in self.WORDS})
        keyed = self._keyed(rows)
        ors = [F.bit_or(f"f_{w}").alias(f"f_{w}") for w in self.WORDS]
        held = held.join(keyed.select("block").distinct(), "block", "left_semi").groupBy("block").agg(*ors)
        hit = F.lit(True)
        for w in self.WORDS:
            hit = hit & (F.col(f"f_{w}").bitwiseAND(F.col(w)) == F.col(w))
        return keyed.join(held, "block").where(hit).select("id", "bucket")

    def seen(self, rows: DataFrame, number: int | None = None) -> DataFrame:
        """(id): those of the rows that are in the log, as of now or before a batch."""
        maybe = self.possible(rows, number).persist()
        buckets = [r[0] for r in maybe.select("bucket").distinct().collect()]  # at most `buckets` numbers
        held = self.ids.raw(number).where(F.col("bucket").isin(buckets)) if buckets else self.ids.raw(number).limit(0)
        return maybe.select("id").join(held.select(F.col("id").alias("of")), F.col("id") == F.col("of"), "left_semi")

    def add(self, rows: DataFrame, number: int) -> None:
        """Ids that a batch brings, each once and none of them in the log. The ids come before their filter, so no filter refuses an id of the log."""
        keyed = self._keyed(rows)
        self.ids.add(keyed, number)
        self.filters.add(keyed, number)


def unseen(batch: DataFrame, log: IdLog, key: str, order: Column, number: int) -> DataFrame:
    """The first row of each id of a batch, by order, if no batch before brought it; rows without id go."""
    whole = F.struct(*[F.col(f"`{c}`") for c in batch.columns])
    first = batch.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("_id")).agg(F.min_by(whole, order).alias("_row"))
    old = log.seen(first.select(F.col("_id").alias("id")), number)
    return first.join(old, F.col("_id") == F.col("id"), "left_anti").select("_row.*")
