"""Near copies by exact Jaccard similarity of word shingles.

All texts put their shingles in one order, frequent ones last. Two sets that are
similar enough share a shingle among the first few of each (prefix filter), so
these are the join keys, and no similar pair is missed. What meets under a key
must be able to reach the similarity from its places there and from parity maps
of the sets, which can't differ in more cells than the sets do; then the sets
themselves are compared.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, pieces, stored
from .components import connected
from .url_filter import KEYS_PER_BLOCK, SENT_BLOCKS, split_by

SEED = 42
NGRAM, SIMILARITY = 5, 0.8
#: Cells in which a task counts shingles, and how many of the fullest cells are told apart in the order. The order changes the cost, not the pairs.
CELLS, FULLEST = 1 << 20, 1 << 15
#: Times that the classes of a key are tested against one of them, before all pairs between what isn't connected by then.
STARS = 2
#: Cells of the smallest parity map; larger sets have one with a cell for each shingle, a power of two of cells.
MAP = 1024
#: Hashes that go to Spark at once, and words that a task remembers.
FLUSH, REMEMBERED = 1 << 18, 1 << 17
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _shingles(text: str | None, ngram: int, seen: dict[bytes, int]) -> np.ndarray:
    """The distinct hashes of a text's word shingles, sorted; a text of fewer words is one shingle, none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(seen) > REMEMBERED:
        seen.clear()
    hashes = np.empty(len(words), dtype=np.uint64)
    for k, w in enumerate(words):
        h = seen.get(w)
        if h is None:
            h = seen[w] = xxhash.xxh64_intdigest(w, SEED)
        hashes[k] = h
    size = min(ngram, len(words))
    out = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        out = out * FACTOR + hashes[k : len(hashes) - size + 1 + k]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        out = (out ^ (out >> np.uint64(shift))) * np.uint64(factor)
    return np.unique(out ^ (out >> np.uint64(31)))


def _frequent(texts: DataFrame, ngram: int) -> np.ndarray:
    """For each cell of shingle hashes 0, or about how often its shingles occur if that is very often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(CELLS, dtype=np.int64), {}
        for batch in pieces(batches):
            for t in batch.column(0):
                np.add.at(counts, (_shingles(t.as_py(), ngram, seen) % np.uint64(CELLS)).astype(np.int64), 1)
        full = np.flatnonzero(counts >= max(8, 4 * counts.mean()))
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(counts[full])], names=["cell", "n"])

    found = texts.select("text").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    weights = np.zeros(CELLS, dtype=np.int64)
    for r in found.orderBy(F.desc("n"), "cell").limit(FULLEST).collect():
        weights[r.cell] = r.n
    return weights


def parity(x: np.ndarray) -> np.ndarray:
    """A bit for each cell of hashes, set if an odd number of x are in it."""
    cells = max(MAP, 1 << max(0, len(x) - 1).bit_length())
    return np.packbits(np.bincount((x & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1, bitorder="little")


def unlike(a: bytes, b: bytes) -> int:
    """Cells in which two parity maps differ, both brought to the cells of the smaller: no more than the hashes in one set alone."""
    p, q = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(p), len(q))
    mixed = np.bitwise_xor.reduce(p.reshape(-1, size), axis=0) ^ np.bitwise_xor.reduce(q.reshape(-1, size), axis=0)
    return int(np.bitwise_count(mixed).sum())


def _sets(texts: DataFrame, ngram: int, weights: np.ndarray, similarity: float | None) -> DataFrame:
    """(ident, c, n, x, map, w) of (ident, text): n hashes of shingles in the common order, x all or those of the prefix, c the hash of their set, map their parity map, w that map folded to MAP cells, as longs."""
    heavy = np.flatnonzero(weights)
    sent = heavy.astype(np.int32).tobytes(), weights[heavy].tobytes()
    longs = MAP // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, seen = np.zeros(CELLS, dtype=np.int64), {}
        weight[np.frombuffer(sent[0], dtype=np.int32)] = np.frombuffer(sent[1], dtype=np.int64)

        def out(ident: pa.Array, sets: list[np.ndarray], names: list[int], counts: list[int], maps: list[np.ndarray]) -> pa.RecordBatch:
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
            folded = np.concatenate([np.bitwise_xor.reduce(m.view(np.int64).reshape(-1, longs), axis=0) for m in maps])
            words = pa.ListArray.from_arrays(pa.array(np.arange(0, len(folded) + 1, longs, dtype=np.int32)), pa.array(folded))
            columns = [ident, pa.array(np.array(names, dtype=np.uint64).view(np.int64)), pa.array(counts, pa.int32()), lists, pa.array([m.tobytes() for m in maps], pa.binary()), words]
            return pa.RecordBatch.from_arrays(columns, names=["ident", "c", "n", "x", "map", "w"])

        for batch in pieces(batches):
            first, sets, names, counts, maps, size = 0, [], [], [], [], 0
            for t in batch.column(1):
                x = _shingles(t.as_py(), ngram, seen)
                names.append(xxhash.xxh64_intdigest(x.tobytes(), SEED))
                counts.append(len(x))
                maps.append(parity(x))
                most = len(x) if similarity is None else len(x) - math.ceil(len(x) * similarity - 1e-6) + (len(x) > 0)
                sets.append(x[np.argsort(weight[(x % np.uint64(CELLS)).astype(np.int64)], kind="stable")[:most]])
                size += most
                if size >= FLUSH:
                    yield out(batch.column(0).slice(first, len(sets)), sets, names, counts, maps)
                    first, sets, names, counts, maps, size = first + len(sets), [], [], [], [], 0
            if sets:
                yield out(batch.column(0).slice(first, len(sets)), sets, names, counts, maps)

    rows = texts.select("ident", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"ident {texts.schema['ident'].dataType.simpleString()}, c bigint, n int, x array<bigint>, map binary, w array<bigint>")


def _only(rows: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """The rows whose key, a long, is in the one column of keys; a Bloom filter of bounded size keeps most others out of the join."""
    named = keys.toDF("_want")
    rows = rows.select("*", key.alias("_is"))
    if (n := named.count()) <= KEYS_PER_BLOCK * SENT_BLOCKS:
        text = rows.withColumn("_key", F.col("_is").cast("string"))
        rows = split_by(text, "_key", named.select(F.col("_want").cast("string").alias("key")), n)[0].drop("_key")
    return rows.join(named, F.col("_is") == F.col("_want"), "left_semi").drop("_is")


def _least(n: Column, m: Column, similarity: float) -> Column:
    """Shingles that sets of n and m must share."""
    return F.ceil((n + m) * (similarity / (1 + similarity)) - 1e-6)


def _possible(similarity: float) -> Column:
    """Whether classes a and b that meet under a key at places i and j may be similar, if it is the first that they share."""
    rest = F.least(F.col("n_a") - F.col("i_a"), F.col("n_b") - F.col("i_b"))
    return rest >= _least(F.col("n_a"), F.col("n_b"), similarity)


def _maps_allow(similarity: float) -> Column:
    """Whether the folded parity maps of a and b differ in no more cells than similar sets may."""
    odd = F.lit(0)
    for k in range(MAP // 64):
        odd = odd + F.bit_count(F.col("w_a")[k].bitwiseXOR(F.col("w_b")[k]))
    return odd <= F.col("n_a") + F.col("n_b") - 2 * _least(F.col("n_a"), F.col("n_b"), similarity)


def _by_maps(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) of classes whose whole parity maps leave them room to be similar."""
    one = lambda s, k: classes.select(F.col("c").alias(k), F.col("n").alias(f"n_{s}"), F.col("map").alias(f"map_{s}"))
    both = pairs.join(one("a", "u"), "u").join(one("b", "v"), "v")
    most = F.col("n_a") + F.col("n_b") - 2 * _least(F.col("n_a"), F.col("n_b"), similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            a, b, top = (batch.column(k).to_pylist() for k in (2, 3, 4))
            keep = [unlike(x, y) <= z for x, y, z in zip(a, b, top, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.select("u", "v", "map_a", "map_b", most.cast("long").alias("most")).mapInArrow(run, "u bigint, v bigint")


def _confirmed(pairs: DataFrame, texts: DataFrame, classes: DataFrame, ngram: int, similarity: float) -> DataFrame:
    """The pairs (u, v) of classes that are similar enough: by their maps first, then by the shingles of one text of each."""
    pairs = cut(_by_maps(pairs, classes, similarity))
    wanted = cut(pairs.select(F.explode(F.array("u", "v")).alias("c")).distinct())
    if wanted.isEmpty():
        return pairs
    idents = cut(_only(classes.select("c", "least"), F.col("c"), wanted).select(F.xxhash64("least")).distinct())
    sets = _sets(_only(texts, F.xxhash64("ident"), idents).select("ident", "text"), ngram, np.zeros(CELLS, dtype=np.int64), None)
    sets = stored(sets.select("c", "x").dropDuplicates(["c"]))
    both = pairs.join(sets.select(F.col("c").alias("u"), F.col("x").alias("p")), "u").join(sets.select(F.col("c").alias("v"), F.col("x").alias("q")), "v")
    shared = F.size(F.array_intersect("p", "q"))
    return both.where(shared >= _least(F.size("p"), F.size("q"), similarity)).select("u", "v")


def _open(rows: DataFrame) -> DataFrame:
    """What meets under a key with others that it isn't connected to."""
    keys = rows.groupBy("k").agg(F.min("r").alias("lo"), F.max("r").alias("hi")).where("lo != hi").select(F.col("k").alias("k2"))
    return rows.join(keys, F.col("k") == F.col("k2"), "left_semi")


def _rooted(rows: DataFrame, root: DataFrame) -> DataFrame:
    """rows with the least class of their component as r."""
    return rows.drop("r").join(root, F.col("c") == F.col("u"), "left").select("k", "c", "n", "i", F.coalesce("v", "c").alias("r"))


def groups(texts: DataFrame, ngram: int = NGRAM, similarity: float = SIMILARITY, near: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(ident, group) of each row of (ident, text): the least ident that links of similar texts reach.

    Texts with the same shingles are one class, those without words too. Pairs
    (u, v) of classes that `near` finds by another method, given each row's
    (ident, c), are compared first; what they connect isn't searched again. Of
    the rest a star
    of each key's classes is tested first, around the class that meets others
    under most of its keys, then all pairs of a key that aren't connected by
    then, so the groups are those of all links.
    """
    texts = texts.select("ident", "text")
    known = stored(_sets(texts, ngram, _frequent(texts, ngram), similarity))
    first = [F.first(c).alias(c) for c in ("n", "map", "w")]
    classes = stored(known.groupBy("c").agg(F.min("ident").alias("least"), *first))
    keys = known.select("c", F.explode("x").alias("k")).groupBy("k").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi")
    shared = cut(keys.select("k"))
    rows = _only(known.select("c", "n", F.posexplode("x").alias("i", "k")), F.col("k"), shared)
    rows = stored(rows.select("k", "c", "n", "i", F.col("c").alias("r")).distinct())
    prefix = F.col("n") - F.ceil(F.col("n") * similarity - 1e-6) + 1
    meet = rows.groupBy("c").agg((-F.count("*") / F.first(prefix)).alias("alone")).withColumnRenamed("c", "of")
    side = lambda df, s, *more: df.select("k", *[F.col(c).alias(f"{c}_{s}") for c in ("c", "n", "i", "r", *more)])
    apart = (F.col("r_a") != F.col("r_b")) & _possible(similarity)
    root = None
    if near is not None:
        pairs = cut(near(known.select("ident", "c")))
        if not pairs.isEmpty():
            root = connected(_confirmed(pairs, texts, classes, ngram, similarity))
            rows = stored(_open(_rooted(rows, root)))
    for turn in range(STARS + 1):
        if turn < STARS:
            by = F.struct(*([F.col("alone")] if not turn else []), F.xxhash64(F.col("c"), F.lit(turn)).alias("by"), "c", "n", "i", "r")
            ranked = rows.join(meet, F.col("c") == F.col("of")) if not turn else rows
            others = ranked.groupBy("k").agg(F.min(by).alias("h")).select("k", "h.c", "h.n", "h.i", "h.r")
            pairs = side(rows, "a").join(side(others, "b"), "k").where(apart)
        else:
            mapped = rows.join(classes.select(F.col("c").alias("of"), "w"), F.col("c") == F.col("of"))
            pairs = side(mapped, "a", "w").join(side(mapped, "b", "w"), "k").where(F.col("c_a") < F.col("c_b")).where(apart & _maps_allow(similarity))
        pairs = cut(pairs.select(F.least("c_a", "c_b").alias("u"), F.greatest("c_a", "c_b").alias("v")).distinct())
        if root is None:
            root = pairs.limit(0)
        if pairs.isEmpty():  # nothing more is connected in this turn
            continue
        root = connected(_confirmed(pairs, texts, classes, ngram, similarity).unionByName(root))
        if turn < STARS:
            rows = stored(_open(_rooted(rows, root)))
    named = classes.join(root, F.col("c") == F.col("u"), "left").select("c", "least", F.coalesce("v", "c").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("group"))
    by_class = named.select(F.col("c").alias("c2"), "root").join(least, "root")
    return known.select("ident", "c").join(by_class, F.col("c") == F.col("c2")).select("ident", "group")
