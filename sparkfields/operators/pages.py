"""Words and pages of recognised documents: text, confidence, layout and duplicates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X


def dedupe_lines(pages: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """pages with `unique_text`: of lines alike in lower case and spacing the first stays; the lines are sorted, not searched."""
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    rows = pages.withColumn("_s", F.array_sort(F.transform(lines, lambda x, i: F.struct(F.lower(X.clean_line(x)).alias("n"), i.alias("i"), x.alias("x")))))
    first = F.filter("_s", lambda e, i: (i == 0) | (F.get("_s", i - 1)["n"] != e["n"]))
    kept = F.transform(F.array_sort(F.transform(first, lambda e: F.struct(e["i"].alias("i"), e["x"].alias("x")))), lambda e: e["x"])
    return rows.withColumn("unique_text", F.array_join(kept, "\n")).drop("_s")


def page_blocks(pages: DataFrame, text_col: str = "text") -> DataFrame:
    """pages with header (3 lines), footer (2, if there are more than 2), body (the rest of over 5), table_lines."""
    rows = pages.withColumn("_l", X.lines(F.col(text_col)))
    n = F.size("_l")
    join = lambda c: F.array_join(c, "\n")
    body = F.when(n > 5, F.slice("_l", F.lit(4), F.greatest(n - 5, F.lit(0)))).otherwise(F.col("_l"))
    footer = F.when(n > 2, F.slice("_l", F.greatest(n - 1, F.lit(1)), F.lit(2))).otherwise(F.array().cast("array<string>"))
    return rows.withColumns({"header": join(F.slice("_l", 1, 3)), "footer": join(footer), "body": join(body), "table_lines": F.size(F.filter("_l", lambda x: x.rlike(r"[|\t]"))).cast("long")}).drop("_l")


def merge_pages(pages: DataFrame, key: str, order: str, empty: str = "sem texto") -> DataFrame:
    """(key, text, confidence, handwritten, errors): page texts in order with an empty line between, blank ones left out."""
    said = X.strip_space(F.coalesce(F.col("text"), F.lit("")))
    texts = F.array_sort(F.collect_list(F.when(said != "", F.struct(F.col(order).alias("o"), said.alias("t")))))
    bad = F.array_sort(F.collect_list(F.when(F.coalesce("error", F.lit("")) != "", F.struct(F.col(order).alias("o"), F.col("error").alias("e")))))
    rows = pages.groupBy(key).agg(F.array_join(F.transform(texts, lambda x: x["t"]), "\n\n").alias("text"), F.round(F.avg("confidence") * 100, 2).alias("confidence"), F.coalesce(F.bool_or("with_handwritten_text"), F.lit(False)).alias("handwritten"), F.array_join(F.transform(bad, lambda x: x["e"]), "; ").alias("errors"))
    return rows.withColumn("text", F.when(F.col("text") == "", empty).otherwise(F.col("text")))


def words_to_text(words: DataFrame) -> DataFrame:
    """(doc_id, page, text, confidence): words with confidence in order; confidences of 0 to 1 count as percentages."""
    pct = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.when(F.col("conf").between(0, 1), F.col("conf") * 100).otherwise(F.col("conf"))))
    rows = words.where((F.col("conf") >= 0) & (X.strip_space(F.col("text")) != ""))
    texts = F.array_sort(F.collect_list(F.struct("seq", X.strip_space(F.col("text")).alias("t"))))
    return rows.groupBy("doc_id", "page").agg(F.array_join(F.transform(texts, lambda x: x["t"]), " ").alias("text"), F.round(F.avg(pct), 4).alias("confidence"))


def term_time_share(words: DataFrame, total: Column) -> DataFrame:
    """words with term and seconds: the page's time by length, a character at least each."""
    size = F.greatest(F.length("text"), F.lit(1))
    share = size / F.sum(size).over(Window.partitionBy("doc_id", "page"))
    return words.withColumn("term", F.concat(F.col("seq").cast("string"), F.lit(":"), F.col("text"))).withColumn("seconds", F.round(total * share, 6))


def best_variant(attempts: DataFrame) -> DataFrame:
    """Of each document the attempt with most confidence times length, the first of equals."""
    score = F.col("avg_confidence") * F.greatest(F.length(F.coalesce("text", F.lit(""))), F.lit(1))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy(score.desc(), "seq"))
    return attempts.withColumn("_n", n).where("_n = 1").drop("_n")


def layout_text(words: DataFrame, columns: int = 120, step: float = 4.0, width: float = 595.0) -> DataFrame:
    """(doc_id, page, text): words set out on a grid by their place, rows by height.

    A word goes to its column, or a space behind the word before it where that
    reaches so far; words at one place keep their order. A page whose width is 0
    or null has `width` points; pages without words have no row.
    """
    row = (F.bround(F.col("y0") / step) * step).alias("row")
    col = (F.col("x0") * (columns / F.coalesce(F.nullif("page_width", F.lit(0.0)), F.lit(width)))).cast("int")
    cells = F.array_sort(F.collect_list(F.struct(F.col("x0"), "seq", col.alias("c"), "text")))
    lines = words.where("text is not null").groupBy("doc_id", "page", row).agg(cells.alias("cells"))
    gap = lambda a: F.when((a == "") | F.endswith(a, F.lit(" ")), 0).otherwise(1)
    put = lambda a, w: F.concat(F.rpad(a, F.greatest(w["c"], F.length(a) + gap(a)), F.lit(" ")), w["text"])
    lines = lines.withColumn("line", F.regexp_replace(F.aggregate("cells", F.lit(""), put), r"(?U)\s+$", ""))
    return lines.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("text"))


def pdf_block_summary(blocks: DataFrame) -> DataFrame:
    """Per document pages, text and image blocks, fonts and mode from a table of blocks (doc_id, page, kind, font)."""
    text, image = F.count_if(F.col("kind") == "text"), F.count_if(F.col("kind") == "image")
    mode = F.when((text > 0) & (text >= image), "text").otherwise("image")
    return blocks.groupBy("doc_id").agg(F.countDistinct("page").alias("nr_pages"), text.alias("txtblocks"), image.alias("imgblocks"), F.countDistinct("font").alias("docfonts"), mode.alias("mode"))


def non_overlapping_words(typed: DataFrame, hand: DataFrame, least: float = 0.55, most: float = 0.25) -> DataFrame:
    """Typed words of enough confidence, and the handwritten ones that overlap none of them by `most` of their union.

    Boxes meet in the cells of a grid that they touch, each different box of a
    page once, so a page's words aren't all paired. Both tables go through
    groupings and windows together, whose keys have the document: where they are
    dealt by document alike, neither words nor boxes are shuffled.
    """
    cell, own = 64.0, ["doc_id", "page", "x0", "y0", "x1", "y1"]
    good, hand = typed.where(F.col("conf") >= least), hand.where("x0 is not null and y0 is not null")
    both = good.select(*own, F.lit(True).alias("typed")).unionByName(hand.select(*own, F.lit(False).alias("typed")))
    boxes = both.groupBy(*own).agg(F.max("typed").alias("typed"), F.min("typed").alias("alone"))
    cells = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor(F.greatest(F.col(a), F.col(b)) / cell))
    boxes = boxes.withColumn("cx", F.explode(cells("x0", "x1"))).withColumn("cy", F.explode(cells("y0", "y1")))
    box = F.struct("x0", "y0", "x1", "y1")
    known = F.col("doc_id").isNotNull() & F.col("page").isNotNull()
    met = boxes.groupBy("doc_id", "page", "cx", "cy").agg(F.collect_list(F.when(known & F.col("typed"), box)).alias("t"), F.collect_list(F.when(~F.col("alone"), box)).alias("h"))

    pairs = met.select("doc_id", "page", "t", F.explode("h").alias("h")).select("doc_id", "page", "h", F.explode("t").alias("t"))
    w = F.greatest(F.lit(0.0), F.least("h.x1", "t.x1") - F.greatest("h.x0", "t.x0"))
    v = F.greatest(F.lit(0.0), F.least("h.y1", "t.y1") - F.greatest("h.y0", "t.y0"))
    area = lambda p: F.greatest(F.lit(0.0), (F.col(f"{p}.x1") - F.col(f"{p}.x0")) * (F.col(f"{p}.y1") - F.col(f"{p}.y0")))
    union = area("h") + area("t") - w * v
    taken = pairs.where(F.coalesce(F.when(union > 0, w * v / union), F.lit(0.0)) >= most).select("doc_id", "page", "h.*").distinct()
    words = hand.select(*own, "seq", F.lit(False).alias("taken")).unionByName(taken.select(*own, F.lit(None).cast(hand.schema["seq"].dataType).alias("seq"), F.lit(True).alias("taken")))
    words = words.withColumn("over", F.max("taken").over(Window.partitionBy(*own))).where("not taken")
    free = words.groupBy("doc_id", "page", "seq").agg(F.max("over").alias("over")).where("not over").select("doc_id", "page", "seq", F.lit("handwritten").alias("engine"))
    return good.select("doc_id", "page", "seq", F.lit("typed").alias("engine")).unionByName(free)


_BASE = 0x9E3779B97F4A7C15
#: Places that are compared at once.
_AT_ONCE = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)  # modulo 2 ** 64


def _loop(codes: np.ndarray, size: int, at: int) -> int | None:
    """Where a phrase of `size` codes that comes twice from `at` on comes three times running: the first such place, if there is one."""
    if not np.array_equal(codes[at : at + size], codes[at + size : at + 2 * size]):
        return None
    low, high = max(0, at - size), min(len(codes), at + 3 * size)
    differ = np.flatnonzero(codes[low : high - size] != codes[low + size : high])
    before, after = differ[differ < at - low], differ[differ >= at - low]
    start = low + int(before[-1]) + 1 if len(before) else low
    end = low + int(after[0]) if len(after) else high - size
    return start if end - start >= 2 * size else None


def cut_loops(text: str, least: int = 15) -> str:
    """text up to the end of the first copy of its shortest phrase of `least` characters that comes three times running.

    Such a phrase of s characters makes a stretch of at least 2 s - least + 1
    places at which `least` characters have come before, so only stretches are
    searched. A loop holds a multiple of s from which s characters come twice, so
    for each length only its multiples are compared, by hashes of any length from
    summed powers: n log n comparisons for a stretch of n. Hits are checked.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(codes)
    if n < 3 * least:
        return text
    powers = _powers(_BASE, n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers[:n])])
    grams = (sums[least:] - sums[:-least]) * _powers(pow(_BASE, -1, 1 << 64), n)[: n - least + 1]
    order = np.argsort(grams, kind="stable")
    again = np.zeros(len(grams) + 2, bool)
    again[order[1:][grams[order[1:]] == grams[order[:-1]]] + 1] = True
    edges = np.flatnonzero(np.diff(again.astype(np.int8)))
    best: tuple[int, int] | None = None
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        size, longest = least, (b - a + least - 1) // 2
        while size <= longest and not (best and size >= best[0]):
            many = max(1, _AT_ONCE // ((b - a) // size + 2))
            sizes = np.arange(size, min(size + many, longest + 1, best[0] if best else n))
            first = -(-np.maximum(0, a - sizes) // sizes)
            held = np.maximum(0, np.minimum(b - 1, n - 2 * sizes) // sizes - first + 1)
            s = np.repeat(sizes, held)
            at = (np.arange(len(s)) - np.repeat(np.cumsum(held) - held - first, held)) * s
            twice = (sums[at + s] - sums[at]) * powers[s] == sums[at + 2 * s] - sums[at + s]
            hits = ((int(s[k]), _loop(codes, int(s[k]), int(at[k]))) for k in np.flatnonzero(twice))
            found = next(((p, start) for p, start in hits if start is not None), None)
            if found:
                best = (found[0], found[1] + found[0])
                break
            size = int(sizes[-1]) + 1
    return text if best is None else text[: best[1]].rstrip(", \n")


def truncate_loops(df: DataFrame, text_col: str = "text", least: int = 15) -> DataFrame:
    """df with loop_free: the text, cut where a phrase begins to repeat for the third time without a break."""

    @F.pandas_udf("string")
    def trim(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else cut_loops(t, least))

    return df.withColumn("loop_free", trim(F.col(text_col)))


def words_of(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, page, seq, text, conf, x0, y0, x1, y1, page_width): a text's words set out on lines, for tests and queries."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("line", "t"))
    words = lines.select("doc_id", (F.col("line") / 40).cast("int").alias("page"), "line", F.posexplode(F.split("t", " ")).alias("k", "text")).where("text != ''")
    x0, y0 = (F.col("k") * 45 % 900).cast("double"), (F.col("line") % 40 * 18).cast("double")
    conf = ((F.col("k") * 7 + F.col("line") * 3) % 100) / 100.0
    return words.select("doc_id", "page", (F.col("line") * 100000 + F.col("k")).alias("seq"), "text", conf.alias("conf"), x0.alias("x0"), y0.alias("y0"), (x0 + 40).alias("x1"), (y0 + 12).alias("y1"), F.lit(900.0).alias("page_width"))


