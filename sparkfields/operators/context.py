"""Amounts chosen by the phrases that stand near them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X

#: Characters between an amount and a phrase up to which the phrase counts.
REACH = 120
AMOUNT = r"(?<![\d.,])\d{1,3}(?:\.\d{3})*,\d{2}(?!\d)"


def _marked(text: Column, phrases: list[list[str]]) -> Column:
    """Text with every amount and phrase set apart, in one pass of one pattern; of phrases at one place the longest counts."""
    one = lambda words: "|".join(re.escape(_folded(w)) for w in sorted(words, key=lambda w: (-len(w), w))) or "(?!)"
    groups = "|".join(f"({p})" for p in (AMOUNT, *map(one, phrases)))
    return F.regexp_replace(F.translate(text, "\x01\x02", "  "), groups, "\x01$1\x02$2\x02$3\x02")


def _folded(word: str) -> str:
    """A phrase as X.without_accents makes texts."""
    return word.lower().translate(str.maketrans(*X.ACCENTS))


def ranked_amounts(docs: DataFrame, priority: list[str], avoid: list[str], id_col: str = "doc_id", text_col: str = "raw_text", reach: int = REACH) -> DataFrame:
    """(doc_id, at, value, distance, avoided, rank): every amount of a text, best first.

    at counts characters from 0; distance is how many lie between the amount and
    the nearest phrase of priority, on either side, null beyond reach. An amount
    is avoided if a phrase of avoid is nearer than that. Those not avoided come
    first, then by distance, unknown ones last, then by place. Case and accents
    don't count; ids must be distinct; texts without amounts have no rows. A
    text's amounts and phrases are sorted by place once, and its neighbours on
    both sides are known in that order.
    """
    low = X.without_accents(F.col(text_col))
    pieces = F.split(_marked(low, [priority, avoid]), "\x01")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(pieces).alias("k", "piece"))
    size = F.length("piece") - F.when(F.col("k") > 0, 3).otherwise(0)
    by = Window.partitionBy("doc_id").orderBy("k")
    rows = rows.withColumn("at", F.sum(size).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - size).where("k > 0")
    part = F.split("piece", "\x02")
    rows = rows.select("doc_id", "at", *[F.nullif(part[k], F.lit("")).alias(n) for k, n in enumerate(("value", "good", "bad"))])
    end = F.col("at") + F.length(F.coalesce("value", "good", "bad"))
    before, after = Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("doc_id").orderBy("at").rowsBetween(1, Window.unboundedFollowing)
    gaps = {}
    for n in ("good", "bad"):
        last = F.last(F.when(F.col(n).isNotNull(), end), ignorenulls=True).over(before)
        following = F.first(F.when(F.col(n).isNotNull(), F.col("at")), ignorenulls=True).over(after)
        gaps[n] = F.least(F.col("at") - last, following - end)
    rows = rows.select("doc_id", "at", "value", gaps["good"].alias("good"), gaps["bad"].alias("bad")).where("value is not null")
    near = lambda n: F.when(F.col(n) <= reach, F.col(n))
    rows = rows.select("doc_id", F.col("at").cast("long").alias("at"), "value", near("good").cast("long").alias("distance"), near("bad").alias("bad"))
    avoided = F.col("bad").isNotNull() & (F.col("distance").isNull() | (F.col("bad") < F.col("distance")))
    order = Window.partitionBy("doc_id").orderBy("avoided", F.col("distance").asc_nulls_last(), "at")
    return rows.withColumn("avoided", avoided).withColumn("rank", F.row_number().over(order)).select("doc_id", "at", "value", "distance", "avoided", "rank")


def chosen_amounts(docs: DataFrame, rules: dict[str, tuple[list[str], list[str]]], id_col: str = "doc_id", text_col: str = "raw_text", reach: int = REACH) -> DataFrame:
    """(doc_id, field, value, distance): the best amount that isn't avoided, for each field's (priority, avoid) phrases."""
    parts = []
    for field, (priority, avoid) in rules.items():
        best = ranked_amounts(docs, priority, avoid, id_col, text_col, reach).where("rank = 1 and not avoided")
        parts.append(best.select("doc_id", F.lit(field).alias("field"), "value", "distance"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
