"""Document fingerprints: invertible Bloom lookup sketches of paragraphs.

A text is cut at its line ends, and lines further at places that their own
letters choose, so that an edit changes the paragraphs around it only. A sketch
has cells of (count, xor of digests, xor of checks), and each digest is in one
cell of each of HASHES parts. The cells of two versions subtract; peeling what
is left gives the digests that differ. Where it fails, a sketch with GROW times
the cells is tried.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts of a sketch, cells of a part in a fingerprint, growth after a failure.
HASHES, CELLS, GROW = 3, 8, 4
#: One place in so many ends a paragraph inside a line.
MEAN = 32
#: Pairs of texts that are sketched together; ranges of ids, at most; documents of one range, if they are fewer.
BATCH, RANGES, BUCKET = 512, 1 << 13, 2000
#: Characters of the pairs that are sketched together.
BUFFER = 4 << 20

_U = np.uint64
_TYPE = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def paragraphs(text: str) -> np.ndarray:
    """The distinct paragraph digests of a text, in order."""
    raw = text.encode("utf-32-le", "surrogatepass")
    codes = np.frombuffer(raw, "<u4").astype(_U)
    n = len(codes)
    if not n:
        return np.zeros(0, _U)
    mark = np.zeros(n, bool)
    mark[:-1] = codes[:-1] == 10
    if n > 4:
        mixed = codes[:-4] * _U(0x9E3779B97F4A7C15) ^ codes[1:-3] * _U(0xC2B2AE3D27D4EB4F) ^ codes[2:-2] * _U(0x165667B19E3779F9) ^ codes[3:-1] * _U(0x27D4EB2F165667C5)
        mark[3:-1] |= (mixed ^ (mixed >> _U(31))) * _U(0xBF58476D1CE4E5B9) >> _U(40) & _U(MEAN - 1) == 0
    edges = [0, *((np.flatnonzero(mark) + 1) * 4).tolist(), 4 * n]
    digest = xxhash.xxh3_64_intdigest
    found = dict.fromkeys([digest(raw[a:b]) for a, b in zip(edges, edges[1:], strict=False)])
    return np.fromiter(found, _U, len(found))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _check(keys: np.ndarray) -> np.ndarray:
    return _mix(keys ^ _U(0xD6E8FEB86659FD93)) & _U(0xFFFFFFFF)


def _places(keys: np.ndarray, cells: int) -> list[np.ndarray]:
    """Each digest's cell in each part of its sketch."""
    return [(h * cells + (_mix(keys + _U(0x9E3779B97F4A7C15 * (h + 1) & (1 << 64) - 1)) % _U(cells)).astype(np.int64)) for h in range(HASHES)]


class Sketches:
    """Many sketches of the same size, one after another."""

    def __init__(self, many: int, cells: int):
        self.many, self.cells = many, cells
        size = many * HASHES * cells
        self.count = np.zeros(size, np.int64)
        self.key = np.zeros(size, _U)
        self.check = np.zeros(size, _U)

    def add(self, owner: np.ndarray, keys: np.ndarray, sign: np.ndarray | int = 1) -> None:
        checks, base = _check(keys), owner * (HASHES * self.cells)
        for place in _places(keys, self.cells):
            at = base + place
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.key, at, keys)
            np.bitwise_xor.at(self.check, at, checks)

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(self.many, self.cells)
        out.count, out.key, out.check = self.count - other.count, self.key ^ other.key, self.check ^ other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(whole, owner, key, sign): which sketches came apart, and the digests found; the sketches end up empty."""
        owners, keys, signs = [], [], []
        while True:
            pure = np.flatnonzero((np.abs(self.count) == 1) & (self.check == _check(self.key)))
            if not len(pure):
                break
            owner, key, sign = pure // (HASHES * self.cells), self.key[pure], self.count[pure]
            order = np.lexsort((key, owner))
            owner, key, sign = owner[order], key[order], sign[order]
            first = np.ones(len(key), bool)
            first[1:] = (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])
            owner, key, sign = owner[first], key[first], sign[first]
            self.add(owner, key, -sign)
            owners.append(owner)
            keys.append(key)
            signs.append(sign)
            if len(owners) > 10_000:
                break
        left = ((self.count != 0) | (self.key != 0) | (self.check != 0)).reshape(self.many, -1).any(axis=1) if self.many else np.zeros(0, bool)
        empty = np.zeros(0, np.int64)
        return ~left, *(np.concatenate(x) if x else e for x, e in ((owners, empty), (keys, empty.astype(_U)), (signs, empty)))

    def texts(self) -> list[str]:
        """Each sketch as text."""
        rows = np.zeros((len(self.count),), dtype=[("n", "<i4"), ("key", "<u8"), ("check", "<u4")])
        rows["n"], rows["key"], rows["check"] = self.count, self.key, self.check
        raw, step = rows.tobytes(), rows.itemsize * HASHES * self.cells
        return [base64.b64encode(raw[k * step : (k + 1) * step]).decode() for k in range(self.many)]


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    return owner, np.concatenate(sets) if sets else np.zeros(0, _U)


def sketch(sets: list[np.ndarray], cells: int = CELLS) -> Sketches:
    out = Sketches(len(sets), cells)
    out.add(*_flat(sets))
    return out


def likeness(a: list[np.ndarray], b: list[np.ndarray], cells: int = CELLS) -> list[float]:
    """For each pair of digest sets the common share of all their digests, from their sketches; 1 if both are empty.

    Sketches that cannot come apart, as the sizes of the sets differ by more
    than their cells, are not tried.
    """
    out = [1.0] * len(a)
    todo = list(range(len(a)))
    while todo:
        now = [k for k in todo if abs(len(a[k]) - len(b[k])) <= HASHES * cells]
        late = [k for k in todo if abs(len(a[k]) - len(b[k])) > HASHES * cells]
        if now:
            whole, owner, _, sign = sketch([a[k] for k in now], cells).minus(sketch([b[k] for k in now], cells)).peel()
            only_a = np.bincount(owner[sign > 0], minlength=len(now))
            only_b = np.bincount(owner[sign < 0], minlength=len(now))
            for k, ok, x, y in zip(now, whole, only_a.tolist(), only_b.tolist(), strict=True):
                common = len(a[k]) - x
                if ok and common == len(b[k]) - y:
                    out[k] = common / (common + x + y) if common + x + y else 1.0
                else:
                    late.append(k)
        todo, cells = late, cells * GROW
    return out


def _compared(rows: list[tuple]) -> Iterator[tuple]:
    """rows of (doc_id, text, digests, next text, next digests)."""
    edits = []
    for _, text, _, following, _ in rows:
        q = len(text) // 4
        edits.append(text[: len(text) - q] + following[:q])
    own, nxt, edited = [r[2] for r in rows], [r[4] for r in rows], [paragraphs(e) for e in edits]
    prints, edited_prints = sketch(own).texts(), sketch(edited).texts()
    near_edited, near_next = likeness(own, edited), likeness(own, nxt)
    for k, r in enumerate(rows):
        yield r[0], len(r[1]), hashlib.sha256(edits[k].encode("utf-8", "surrogatepass")).hexdigest(), prints[k], edited_prints[k], near_edited[k], near_next[k]


def _edges(rows: DataFrame) -> list[tuple[int, int, int]]:
    """Where buckets of about BUCKET rows begin in the order of (is an id, id, hash), RANGES at most: quantiles of the ids, and of the hashes where an id has several of them."""
    n, nulls = rows.agg(F.count("*"), F.count_if(F.col("oid").isNull())).first()
    many = lambda k: max(1, min(RANGES, -(-k // BUCKET)))
    split = lambda first, parts: [(*first, -(1 << 63) + (k << 64) // parts) for k in range(parts)]
    edges = split((0, 0), many(nulls)) if nulls else []
    if n > nulls:
        parts = many(n - nulls)
        at = rows.agg(F.percentile_approx("oid", [k / parts for k in range(parts)], F.lit(max(10_000, 10 * parts)))).first()[0]
        for oid, k in Counter(at).items():
            edges += split((1, oid), k)
    return sorted(edges)


def _bucket(edges: list[tuple[int, int, int]]):
    """A column function: the bucket of (id, hash); the texts don't go through Python."""
    bounds = np.array(edges, dtype=[("known", "i8"), ("oid", "i8"), ("h", "i8")])

    def find(oid: pd.Series, h: pd.Series) -> pd.Series:
        own = np.zeros(len(h), dtype=bounds.dtype)
        own["known"], own["oid"], own["h"] = oid.notna(), oid.fillna(0).astype("int64"), h
        order = np.argsort(np.concatenate([bounds, own]), kind="stable")
        at = np.empty(len(order), dtype=np.int64)
        at[order] = np.cumsum(order < len(bounds)) - 1
        return pd.Series(np.maximum(at[len(bounds) :], 0))

    return F.pandas_udf(find, "bigint")


def _spread(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _text, b, late): rows sorted in buckets, and after each bucket, late, the first row of the next one (after the last, of the first)."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(id_col).cast("long").alias("oid"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    rows = rows.withColumn("h", F.xxhash64("_text"))
    narrow = rows.select("oid", "h")
    edges = _edges(narrow)
    bucket = _bucket(edges)
    heads = narrow.select("oid", "h", bucket("oid", "h").alias("b")).groupBy("b").agg(F.min(F.struct(F.col("oid").isNotNull().alias("known"), "oid", "h")).alias("m")).orderBy("b").collect()  # RANGES at most
    order = [r.b for r in heads]
    first = docs.sparkSession.createDataFrame([(r.m.oid, r.m.h, order[k - 1]) for k, r in enumerate(heads)], "head_oid bigint, head_h bigint, before bigint")
    placed = rows.withColumn("b", bucket("oid", "h")).join(F.broadcast(first), F.col("oid").eqNullSafe(F.col("head_oid")) & (F.col("h") == F.col("head_h")), "left")
    place = lambda b, late: F.struct(F.col(b).alias("b"), F.lit(late).alias("late"))
    targets = F.when(F.col("before").isNull(), F.array(place("b", 0))).otherwise(F.array(place("b", 0), place("before", 1)))
    spread = placed.select("_id", "oid", "h", "_text", F.inline(targets))
    return spread.repartition("b").sortWithinPartitions("b", "late", F.col("oid").asc_nulls_first(), "h").select("_id", "_text", "b", "late")


def compare_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row its fingerprint, and those of its edited text and of the next document.

    The edited text has the last quarter of the code points (rounded down)
    replaced by the first as many of the next document, or all it has. Next is
    by ascending integer id, after the last the first; null ids come first and
    rows with equal ids are ordered by a hash of their text. Null text is empty;
    two empty texts have likeness 1; texts of any length are sketched whole; a
    single row is its own next; other columns are not read; no rows give no
    rows. Each range of ids also gets the first document of the next range.
    """
    spread = _spread(docs, id_col, text_col)
    id_type = spread.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        types = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        held: tuple | None = None
        closed = None  # the bucket whose next document has come
        waiting: list[tuple] = []
        size = 0

        def out(id_kind: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*_compared(waiting), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t or id_kind) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            kind = batch.column(0).type
            for doc_id, text, bucket, late in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if late and closed == bucket:
                    continue
                digests = paragraphs(text)
                if held and held[3] == bucket:
                    waiting.append((held[0], held[1], held[2], text, digests))
                    size += 2 * len(held[1]) + len(text)
                closed = bucket if late else closed
                held = None if late else (doc_id, text, digests, bucket)
                if len(waiting) >= BATCH or size >= BUFFER:
                    yield out(kind)
                    waiting, size = [], 0
        if waiting:
            yield out(kind)

    return spread.mapInArrow(run, f"doc_id {id_type}, {_TYPE}")
