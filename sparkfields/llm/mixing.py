"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

#: Weights of the sources in order, repeating; most copies of a document; rows of one group of the tree.
WEIGHTS = (1, 2, 3)
MOST = 3
GROUP = 64
SEED = 20
#: Equal rows that a task writes out at once.
PART = 1000


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, n) with the words that each source should give.

    Shares follow the weights; no source gives more than `most` times its size,
    and what is over goes to the others by weight. With the sources in order of
    size over weight, the first that are full are those whose quotient is under
    the level of the rest.
    """
    all_rows = Window.partitionBy()
    rank = F.row_number().over(Window.partitionBy().orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    rows = totals.withColumn("rank", rank).withColumn("w", w).withColumn("cap", F.col("source_size") * float(most)).withColumn("quotient", F.col("cap") / F.col("w"))
    up = Window.partitionBy().orderBy("quotient", "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = F.sum("source_size").over(all_rows) - (F.sum("cap").over(up) - F.col("cap"))
    level = rest / (F.sum("w").over(all_rows) - F.sum("w").over(up) + F.col("w"))
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy().orderBy("quotient", "rank"))).withColumn("level", level)
    rows = rows.withColumn("level", F.min_by(F.col("level"), F.when(F.col("level") <= F.col("quotient") * (1 + 1e-12), F.col("at"))).over(all_rows))
    return rows.select("source", "source_size", "n", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.lit(0.0))).alias("target"))


def _let(value: Column, body) -> Column:
    """body of value, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _draw(*keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *keys), 11) / float(1 << 53)


def _pair(a: Column, b: Column) -> Column:
    """Struct (x, y): new probabilities of a and b. Words expected from both stay; one becomes 0 or 1."""
    def moved(m: Column) -> Column:
        up = _draw(a["key"], b["key"]) * (m["up"] + m["down"]) < m["down"]
        risen = F.when(m["a_first"], F.struct(F.lit(1.0).alias("x"), F.greatest(F.lit(0.0), b["x"] - (1 - a["x"]) * a["size"] / b["size"]).alias("y"))).otherwise(
            F.struct((a["x"] + b["x"] * b["size"] / a["size"]).alias("x"), F.lit(0.0).alias("y"))
        )
        fallen = F.when(m["a_last"], F.struct(F.lit(0.0).alias("x"), F.least(F.lit(1.0), b["x"] + a["x"] * a["size"] / b["size"]).alias("y"))).otherwise(
            F.struct((a["x"] - (1 - b["x"]) * b["size"] / a["size"]).alias("x"), F.lit(1.0).alias("y"))
        )
        return F.when(up, risen).otherwise(fallen)

    rise, fall = 1 - a["x"], a["x"]  # as far as a can go, and as far as b lets it
    rise_b, fall_b = b["x"] * b["size"] / a["size"], (1 - b["x"]) * b["size"] / a["size"]
    return _let(F.struct(F.least(rise, rise_b).alias("up"), F.least(fall, fall_b).alias("down"), (rise <= rise_b).alias("a_first"), (fall <= fall_b).alias("a_last")), moved)


def _fold(items: Column, kind: str) -> Column:
    """The items of one group, all but one at most with x of 0 or 1."""
    start = F.struct(F.lit(None).cast(kind).alias("open"), F.array().cast(f"array<{kind}>").alias("done"))

    def step(acc: Column, item: Column) -> Column:
        held = acc["open"]

        def settle(p: Column) -> Column:
            one, two = held.withField("x", p["x"]), item.withField("x", p["y"])
            whole = lambda x: (x <= 0) | (x >= 1)
            left = F.when(~whole(p["x"]), one).when(~whole(p["y"]), two)
            out = F.filter(F.array(one, two), lambda i: whole(i["x"]))
            return F.struct(left.alias("open"), F.concat(acc["done"], out).alias("done"))

        fresh = F.struct(item.alias("open"), acc["done"].alias("done"))
        return F.when(held.isNull(), fresh).otherwise(_let(_pair(held, item), settle))

    return F.aggregate(items, start, step, lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def _name(docs: DataFrame, id_col: str) -> Column:
    """Equal for rows alike in all columns: their hash, and the id."""
    return F.concat_ws("/", F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).cast("string"), F.col(id_col).cast("string"))


def _classes(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], most: int) -> DataFrame:
    """(doc_id, source, size, source_size, target, key, name, rows, whole, more) for each kind of equal rows.

    All `rows` of a kind have `whole` copies and `more` of them have another.
    Equal rows exchange words among themselves first: of their fractions whole
    numbers and one rest come, and only that goes into the tree.
    """
    key = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), key.alias("key"), _name(docs, id_col).alias("name"))
    rows = cut(rows.groupBy("doc_id", "source", "size", "key", "name").agg(F.count("*").alias("rows")))
    totals = targets(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("n")), weights, most)
    totals = cut(totals.withColumnsRenamed({"source": "of"}))
    largest = totals.agg(F.max("n")).first()[0] or 0
    rows = rows.join(totals, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    p = F.least(F.lit(float(most)), F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size")))
    rows = rows.withColumn("p", F.coalesce(p, F.lit(0.0))).withColumn("whole", F.floor("p"))
    mass = F.when(F.col("size") > 0, (F.col("p") - F.col("whole")) * F.col("rows")).otherwise((_draw(F.col("key")) < F.col("p") - F.col("whole")).cast("double") * F.col("rows"))
    rows = rows.withColumn("x", mass).withColumn("sure", F.floor("x")).withColumn("x", F.col("x") - F.col("sure"))
    groups = F.ceil(F.col("n") / GROUP)
    names = ["doc_id", "size", "source_size", "target", "whole", "sure", "rows", "name", "key", "x"]
    kind = rows.select(F.struct(*names).alias("i")).schema["i"].dataType.simpleString()
    inside = (F.col("x") > 0) & (F.col("x") < 1)
    done = [rows.where(~inside).select("source", *names)]
    open_rows = rows.where(inside).select("source", F.pmod(F.xxhash64(F.lit(SEED), "key"), groups).alias("g"), *names)
    for _ in range(max(1, math.ceil(math.log(max(2, largest), GROUP)) + 1)):
        folded = open_rows.groupBy("source", "g").agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("order"), "key", "doc_id", *[n for n in names if n not in ("key", "doc_id")]))).alias("items"))
        items = F.transform("items", lambda i: F.struct(*[i[n].alias(n) for n in names]))
        level = cut(folded.select("source", "g", F.inline(_fold(items, kind))))
        done.append(level.where(~inside).select("source", *names))
        open_rows = level.where(inside).withColumn("g", F.floor(F.col("g") / GROUP))
    done.append(open_rows.withColumn("x", (_draw(F.col("key")) < F.col("x")).cast("double")).select("source", *names))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.withColumn("more", F.col("sure") + F.col("x").cast("long")).drop("sure", "x")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken, key) for every row of docs.

    A document of a source that should give t of its s words has t / s copies:
    the whole part for sure, the fraction by pivotal rounding in which two
    documents exchange words, so that the words of both stay. Groups of about
    GROUP documents are folded at each level of a tree, large ones first so that
    small ones take up what they leave, and the one fraction that a group leaves
    goes up; the last is drawn. The draws depend on the rows alone. Null and
    empty texts have size 0 and take nothing; texts of any length are one
    document; null source is a source, the last; equal rows exchange among
    themselves first, have equal keys, and their copies differ by one at most;
    columns with any name only enter the key; no rows give no rows.
    """
    classes = _classes(docs, id_col, text_col, source_col, weights, most)
    turns = F.col("rows") > 1
    # large kinds are spread again before they are written out row by row
    parts = classes.where(turns).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / PART)))).repartition(F.col("key"), F.col("part"))
    row = F.sequence(F.col("part") * PART + 1, F.least(F.col("rows"), (F.col("part") + 1) * PART))
    many = parts.withColumn("row", F.explode(row)).drop("part")
    every = classes.where(~turns).withColumn("row", F.lit(1).cast("long")).unionByName(many)
    copies = (F.col("whole") + (F.col("row") <= F.col("more")).cast("long")).cast("long")
    return every.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "key")


def repeat(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """docs with each row as often as the mix takes it; all columns stay as they are, whatever their names.

    Of equal rows as many are returned as the mix takes of all of them. Nulls,
    empty texts, ties and empty tables are as for mix().
    """
    kinds = _classes(docs, id_col, text_col, source_col, weights, most).select(F.col("name").alias("of"), "rows", "whole", "more")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _name(docs, id_col).alias("name"))
    both = rows.join(kinds.where("whole > 0 or more > 0"), F.col("name") == F.col("of"))
    times = lambda n: F.explode(F.sequence(F.lit(1), n.cast("int")))
    n = F.col("whole") + F.when(F.col("rows") == 1, F.col("more")).otherwise(0)
    own = both.where(n > 0).select("row", times(n))
    # what some of many equal rows have more: one of them, spread before it is repeated
    one = both.where("rows > 1 and more > 0").groupBy("name").agg(F.first("row").alias("row"), F.first("more").alias("more"))
    spread = one.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("more") - 1) / PART)))).repartition(F.col("name"), F.col("part"))
    more = spread.select("row", times(F.least(F.lit(PART), F.col("more") - F.col("part") * PART)))
    return own.select("row").unionByName(more.select("row")).select("row.*")
