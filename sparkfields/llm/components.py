"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _mins(pairs: DataFrame) -> DataFrame:
    """For each u the least of itself and its v; partial sums first, so a hub costs no more than others."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = both.join(_mins(both), F.col("u") == F.col("k"))
    return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    mins = _mins(down)
    joined = down.join(mins, F.col("u") == F.col("k"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(mins.select(F.col("k").alias("u"), F.col("m").alias("v"))).where("u != v").distinct()


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Edges (u, v) to rows (u, v): each node that isn't the least of its component, with the least.

    Every round writes its edges to the checkpoint folder; only a count and a
    checksum come to the driver. Null ends are ignored; loops and repeated edges
    change nothing; no edges give no rows. Rounds grow with the logarithm of the
    nodes; a graph that takes more than `rounds` ends in an error, not in parts.
    """
    def sign(df: DataFrame) -> tuple:
        row = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return row[0], row[1]

    now = cut(edges.select("u", "v").where("u != v").distinct())
    before = sign(now)
    if not before[0]:
        return now
    for _ in range(rounds):
        now = cut(_small_star(_large_star(now)))
        after = sign(now)
        if after == before:
            return now
        before = after
    raise RuntimeError("components did not settle")
