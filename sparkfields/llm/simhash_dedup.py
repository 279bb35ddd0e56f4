"""SimHash near-duplicates, found by pigeonring filtering.

A fingerprint has 64 bits in SEGMENTS segments around a ring. If two
fingerprints differ in at most RADIUS bits, then from some segment on every run
of l consecutive segments differs in at most l * RADIUS / SEGMENTS bits. The
join key is the first CHAIN segments of such a run; what it finds must pass the
longer runs, and then the whole Hamming distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingle_join
from .common import cut, pieces, stored
from .components import connected
from .url_filter import KEYS_PER_BLOCK, SENT_BLOCKS, split_by

SEED = 42
NGRAM = 4
RADIUS = 4
SEGMENTS = 5


def fingerprint(text: str | None, ngram: int = NGRAM) -> int:
    """Majority bits of the XXH64 of all word shingles; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    runs = [words] if len(words) <= ngram else zip(*(words[k:] for k in range(ngram)), strict=False)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(x, SEED) for x in map(b" ".join, runs)], dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row for each row of docs, fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, fp bigint")


def segments(m: int = SEGMENTS) -> list[tuple[int, int]]:
    """(shift, width) of each segment, from the lowest bits."""
    ends = [64 * k // m for k in range(m + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def _ring(i: int, chain: int, m: int) -> list[tuple[int, int]]:
    return [segments(m)[(i + k) % m] for k in range(chain)]


def _key(fp: Column, i: int, chain: int, m: int) -> Column:
    mask = sum((1 << w) - 1 << s for s, w in _ring(i, chain, m))
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def _flips(i: int, chain: int, m: int, radius: int) -> list[int]:
    """Bit masks by which the first `chain` segments of a run may differ."""
    found = [(0, 0)]
    for k, (shift, width) in enumerate(_ring(i, chain, m)):
        most, step = (k + 1) * radius // m, []
        for mask, ones in found:
            new = [(mask, ones)]
            for _ in range(most - ones):
                new += [(x | 1 << b, n + 1) for x, n in new if n - ones == _ for b in range(shift, shift + width) if x >> b == mask >> b]
            step += new
        found = step
    return sorted({mask - (1 << 64) if mask >> 63 else mask for mask, _ in found})


def _within(a: Column, b: Column, i: Column, m: int, radius: int) -> Column:
    """Every run from segment i on keeps within its share of the radius; then the whole distance."""
    parts = [F.bit_count(a.bitwiseXOR(b).bitwiseAND(F.lit(x - (1 << 64) if (x := (1 << w) - 1 << s) >> 63 else x))) for s, w in segments(m)]
    out = F.lit(False)
    for start in range(m):
        test = i == start
        for n in range(2, m + 1):
            total = parts[start]
            for k in range(1, n):
                total = total + parts[(start + k) % m]
            test = test & (total <= n * radius // m)
        out = out | test
    return out & (F.bit_count(a.bitwiseXOR(b)) <= radius)


def links(fps: DataFrame, radius: int = RADIUS, m: int = SEGMENTS, chain: int | None = None) -> DataFrame:
    """(u, v), u < v: all pairs of the distinct `fp` that differ in at most `radius` bits.

    `chain` segments make the join key; by default as many as the count of
    fingerprints needs for keys that few of them share. A pair's differing bits
    are set in one of the two, so only the side that has a flipped bit at 0
    (at the lowest flipped bit) asks for it. The chain changes the cost, not the
    pairs.
    """
    if chain is None:
        chain = 2 if fps.count() < 1 << 27 else 3
    fp = F.col("fp")
    index = F.array(*[F.struct(F.lit(i).alias("i"), _key(fp, i, chain, m).alias("k")) for i in range(m)])
    asks = []
    for i in range(m):
        for flip in _flips(i, chain, m, radius):
            low = flip & -flip
            low = low - (1 << 64) if low >> 63 else low
            key = _key(fp, i, chain, m).bitwiseXOR(F.lit(flip))
            asks.append(F.when((F.lit(low) == 0) | (fp.bitwiseAND(F.lit(low)) == 0), F.struct(F.lit(i).alias("i"), key.alias("k"))))
    left = fps.select(fp.alias("a"), F.inline(F.filter(F.array(*asks), lambda x: x.isNotNull())))
    right = fps.select(fp.alias("b"), F.inline(index)).select("b", F.col("i").alias("j"), F.col("k").alias("l"))
    same = (F.col("i") == F.col("j")) & (F.col("k") == F.col("l"))
    # equal keys come from both sides; other keys from one side only
    once = (F.col("a") != F.col("b")) & ((F.col("a") < F.col("b")) | (_differ(m, chain)))
    pairs = left.join(right, same & once & _within(F.col("a"), F.col("b"), F.col("i"), m, radius))
    return pairs.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def _differ(m: int, chain: int) -> Column:
    """Whether a and b differ in the key's segments."""
    out = F.lit(False)
    for i in range(m):
        out = out | ((F.col("i") == i) & (_key(F.col("a"), i, chain, m) != _key(F.col("b"), i, chain, m)))
    return out


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs.

    component_id is the least doc_id that links reach. Null and empty texts have
    fingerprint 0 and are linked like others; rows with equal texts share a
    component; null ids keep their row and never name a component unless it has
    no other id; no rows give no rows; other columns are not read.
    """
    known = cut(fingerprints(docs, id_col, text_col))
    classes = cut(known.groupBy("fp").agg(F.min("doc_id").alias("least")))
    root = connected(links(classes.select("fp"), radius))
    named = classes.join(root, F.col("fp") == F.col("u"), "left").select("fp", "least", F.coalesce("v", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.select("fp", "root").join(least, "root").select("fp", "component_id")
    return known.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def near_classes(texts: DataFrame, classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v), u < v: pairs of the classes c of (ident, c) with fingerprints alike or at most `radius` bits apart, all reached from one class of each fingerprint."""
    fps = fingerprints(texts, "ident").select(F.xxhash64("doc_id").alias("of"), "fp")
    named = classes.select(F.xxhash64("ident").alias("of"), "c").distinct()
    by_class = cut(fps.join(named, "of").groupBy("c").agg(F.min("fp").alias("fp")))
    heads = cut(by_class.groupBy("fp").agg(F.min("c").alias("head")))
    head = lambda k: heads.select(F.col("fp").alias(f"fp_{k}"), F.col("head").alias(k))
    near = links(heads.select("fp"), radius).join(head("a"), F.col("u") == F.col("fp_a")).join(head("b"), F.col("v") == F.col("fp_b"))
    same = by_class.join(heads, "fp").where("c != head").select(F.col("head").alias("u"), F.col("c").alias("v"))
    return near.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).unionByName(same)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = shingle_join.NGRAM, similarity: float = shingle_join.SIMILARITY) -> DataFrame:
    """docs without the near copies: of each group of similar texts the row of the least id stays.

    Links are pairs of texts whose word shingles have at least this Jaccard
    similarity, all of them. Pairs of near fingerprints are found first, by
    pigeonring keys, and their similarity is checked; as no radius that keys can
    serve holds all that is 0.8 alike, an exact join finds the links between what
    they leave apart. Rows without id come after the others; of rows alike in all
    columns one stays.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    ident = F.struct(F.col(id_col).isNull().alias("no"), F.col(id_col).alias("id"), F.xxhash64(*columns).alias("row"))
    texts = docs.select(ident.alias("ident"), F.col(text_col).alias("text"))
    groups = shingle_join.groups(texts, ngram, similarity, lambda classes: near_classes(texts, classes))
    # most rows are alone in their group and need no join: only those that go or come more than once are looked up
    found = groups.groupBy("ident").agg(F.first("group").alias("group"), F.count("*").alias("n"))
    name = lambda x: F.concat_ws("/", x["no"].cast("string"), x["id"].cast("string"), x["row"].cast("string"))
    looked_up = stored(found.where("n > 1 or ident != group").select(name(F.col("ident")).alias("of"), (F.col("ident") == F.col("group")).alias("head")))
    rows = docs.select(F.struct(*columns).alias("row"), name(ident).alias("name"))
    sure = None
    if (n := looked_up.count()) <= KEYS_PER_BLOCK * SENT_BLOCKS:
        rows, sure = split_by(rows, "name", looked_up.select(F.col("of").alias("key")), n)
    kept = rows.join(looked_up, F.col("name") == F.col("of"), "left").where(F.coalesce("head", F.lit(True)))
    kept = kept.dropDuplicates(["name"]).select("row")
    return (kept if sure is None else kept.unionByName(sure.select("row"))).select("row.*")
