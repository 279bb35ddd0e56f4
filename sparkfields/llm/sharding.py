"""Shards from a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import bisect

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The ring is cut into so many cells; a cell's keys have the same shards clockwise.
CELL_BITS = 13
VNODES = 32
SHARDS = 8
#: Rows alike that a task writes out at once.
PART = 1000


def ring(shards: int = SHARDS, vnodes: int = VNODES) -> list[tuple[int, list[int]]]:
    """(first cell, shards in clockwise order) of each arc between virtual nodes."""
    at: dict[int, int] = {}
    for s in range(shards):
        for v in range(vnodes):
            at.setdefault(xxhash.xxh64_intdigest(f"shard {s} node {v}", 0) >> (64 - CELL_BITS), s)
    cells = sorted(at)
    owners = [at[c] for c in cells]
    arcs = []
    for k in range(len(cells) + 1):  # the last arc goes on at the first node
        turn = [owners[(k + j) % len(owners)] for j in range(len(owners))]
        seen = list(dict.fromkeys(turn))
        seen += [s for s in range(shards) if s not in seen]
        arcs.append((cells[k - 1] + 1 if k else 0, seen))
    return arcs


def first_shard(cell: int, shards: int = SHARDS, vnodes: int = VNODES) -> int:
    arcs = ring(shards, vnodes)
    return arcs[bisect.bisect_right([a for a, _ in arcs], cell) - 1][1][0]


def position(doc_id: Column, other: Column | None = None) -> Column:
    """A key's place on the ring, a signed long; a null id counts as `other`, or as the empty text."""
    return F.xxhash64(F.coalesce(doc_id.cast("string"), *([other] if other is not None else []), F.lit("")))


def cell(pos: Column) -> Column:
    return F.shiftrightunsigned(pos, 64 - CELL_BITS).cast("int")


def _cells(spark: SparkSession, shards: int, vnodes: int) -> DataFrame:
    """(cell, prefs): the ring, one row a cell; its size depends on CELL_BITS alone."""
    arcs = ring(shards, vnodes)
    text = ";".join(f"{a} {' '.join(map(str, prefs))}" for a, prefs in arcs)
    rows = spark.range(1).select(F.explode(F.split(F.lit(text), ";")).alias("arc"))
    starts = F.array(*[F.lit(a) for a, _ in arcs], F.lit(1 << CELL_BITS))
    nums = F.transform(F.split("arc", " "), lambda x: x.cast("int"))
    rows = rows.select(nums[0].alias("a"), F.slice(nums, 2, shards).alias("prefs"))
    rows = rows.withColumn("b", F.element_at(F.filter(starts, lambda x: x > F.col("a")), 1))
    return rows.where("b > a").select(F.explode(F.sequence("a", F.col("b") - 1)).alias("cell"), "prefs")


def _ranges(counts: DataFrame, shards: int, vnodes: int) -> DataFrame:
    """(cell, ranges): of each cell's keys, in order, which part goes to which shard.

    In round r the keys that are left go to the r-th shard clockwise; a shard
    takes them, cell after cell, until it is full.
    """
    state = counts.join(F.broadcast(_cells(counts.sparkSession, shards, vnodes)), "cell")
    every = Window.partitionBy()
    total = F.sum("n").over(every)
    state = state.select("cell", "prefs", F.col("n").alias("left"), total.alias("total"))
    caps = F.array(*[F.floor(F.col("total") / shards) + (F.lit(s) < F.col("total") % shards).cast("long") for s in range(shards)])
    state = state.select("cell", "prefs", "left", caps.alias("free"), F.array().cast("array<bigint>").alias("got"))
    for r in range(shards):
        target = F.col("prefs")[r]
        before = F.sum("left").over(Window.partitionBy(target).orderBy("cell")) - F.col("left")
        state = state.withColumn("take", F.greatest(F.lit(0), F.least("left", F.element_at("free", target + 1) - before)))
        used = F.array(*[F.coalesce(F.sum(F.when(target == s, F.col("take"))).over(every), F.lit(0)) for s in range(shards)])
        state = state.select(
            "cell", "prefs", (F.col("left") - F.col("take")).alias("left"), F.zip_with("free", used, lambda a, b: a - b).alias("free"), F.concat("got", F.array("take")).alias("got")
        )
    parts = state.select("cell", "got", F.posexplode("got").alias("r", "n"), "prefs").where("n > 0")
    low = F.aggregate(F.slice("got", F.lit(1), F.col("r")), F.lit(0).cast("long"), lambda a, x: a + x)
    parts = parts.select("cell", "n", low.alias("lo"), F.element_at("prefs", F.col("r") + 1).alias("shard"))
    slot = F.sum("n").over(Window.partitionBy("shard").orderBy("cell", "lo")) - F.col("n")
    parts = parts.select("cell", F.struct("lo", (F.col("lo") + F.col("n")).alias("hi"), "shard", slot.alias("slot")).alias("part"))
    return parts.groupBy("cell").agg(F.collect_list("part").alias("ranges"))


def place(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, vnodes: int = VNODES) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot), one row for each row of docs.

    A key starts at the next virtual node clockwise; a shard that holds its
    share, rows / shards up or down to a whole number, sends what comes further
    to the next shard. So the counts differ by one at most, and a shard more or
    less moves the keys of its arcs and what overflows. Slots run from 0 without
    gaps. Null text counts as empty, texts of any length by their bytes; the key
    is the id, for null ids the size and checksum of the text; rows alike in
    these are counted first and get different slots; other columns are not read;
    no rows give no rows.
    """
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    pos = position(F.col("doc_id"), F.concat(F.lit("\0"), F.col("size").cast("string"), F.lit("/"), F.col("text_crc32").cast("string")))
    kinds = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n")).withColumn("pos", pos)
    kinds = kinds.withColumn("cell", cell(F.col("pos")))
    counts = kinds.groupBy("cell").agg(F.sum("n").alias("n"))
    rank = F.sum("n").over(Window.partitionBy("cell").orderBy("pos", "doc_id", "size", "text_crc32")) - F.col("n")
    # at most shards parts for each of 2 ** CELL_BITS cells, however many rows there are
    placed = kinds.withColumn("rank", rank).join(F.broadcast(_ranges(counts, shards, vnodes)), "cell")
    many = placed.where("n > 1").withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(PART).cast("long")))).repartition(F.col("pos"), F.col("from"))
    many = many.withColumn("k", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + PART, F.col("n")) - 1))).drop("from")
    placed = placed.where("n = 1").withColumn("k", F.lit(0).cast("long")).unionByName(many).withColumn("rank", F.col("rank") + F.col("k"))
    part = F.element_at(F.filter("ranges", lambda x: (x["lo"] <= F.col("rank")) & (F.col("rank") < x["hi"])), 1)
    placed = placed.withColumn("part", part)
    return placed.select("doc_id", "size", "text_crc32", F.col("part.shard").alias("shard"), (F.col("part.slot") + F.col("rank") - F.col("part.lo")).alias("slot"))
