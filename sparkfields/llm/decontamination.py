"""Benchmark decontamination by Wu-Manber multi-pattern search.

Test windows are byte strings of words between single spaces. Texts are brought
to the same form, many at once in one buffer, and the buffer is cut into lanes
that numpy steps through side by side: a block's shift table says how far a lane
may jump, the hash of the last block picks a bucket of windows, and a direct
comparison confirms each occurrence.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, pieces

WINDOW = 10
#: Texts of about so many bytes share a buffer; benchmark bytes of one search pass.
BUFFER = 8 << 20
BLOCK = 8 << 20
#: A lane's length, the longest block of a shift table, and where short windows end.
LANE, SUFFIX, SHORT = 2048, 8, 24

_KEEP = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_FOLD = bytes(c if (c := b | 0x20 if 0x41 <= b <= 0x5A else b) in _KEEP else 0x20 for b in range(256))
_TYPE = "struct<n_words:bigint,spans:array<struct<first:bigint,end:bigint>>,items:array<string>>"


def windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    """All runs of `size` words, or the one run of a shorter text; each between spaces."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    return [b" " + b" ".join(words[k : k + size]) + b" " for k in range(max(1, len(words) - size + 1))] if words else []


class Search:
    """Shift table and suffix buckets of one set of windows."""

    def __init__(self, patterns: Iterable[bytes]):
        found = sorted(patterns)
        self.m = min(map(len, found))
        self.b = min(SUFFIX, self.m)
        self.mask = np.uint64((1 << 8 * self.b) - 1)
        heads = np.array([np.frombuffer(p[: self.m] + bytes(8), np.uint8) for p in found])
        self.bits = max(12, min(22, int(len(found) * self.m).bit_length() + 2))
        self.shift = np.full(1 << self.bits, self.m - self.b + 1, dtype=np.int64)
        for at in range(self.m - self.b + 1):
            block = np.ascontiguousarray(heads[:, at : at + 8]).view("<u8").ravel() & self.mask
            np.minimum.at(self.shift, self._hash(block), self.m - self.b - at)
        self.buckets: dict[int, list[bytes]] = defaultdict(list)
        for p in found:
            self.buckets[int.from_bytes(p[self.m - self.b : self.m], "little")].append(p)

    def _hash(self, block: np.ndarray) -> np.ndarray:
        return ((block * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def occurrences(self, text: bytes) -> Iterator[tuple[int, bytes]]:
        """(position, window) of every occurrence; text ends with at least 8 bytes that no window has."""
        last = len(text) - 8 - self.m
        if last < 0:
            return
        blocks = np.ndarray(shape=(len(text) - 7,), dtype="<u8", buffer=text, strides=(1,))
        at = np.arange(0, last + 1, LANE)
        end = np.minimum(at + LANE, last + 1)
        while len(at):
            block = blocks[at + (self.m - self.b)] & self.mask
            jump = self.shift[self._hash(block)]
            if len(stop := np.flatnonzero(jump == 0)):
                for p, key in zip(at[stop].tolist(), block[stop].tolist(), strict=True):
                    for pattern in self.buckets.get(key, ()):
                        if text.startswith(pattern, p):
                            yield p, pattern
            at = at + np.maximum(jump, 1)
            if not (live := at < end).all():
                at, end = at[live], end[live]


def _groups(texts: list[str | None]) -> Iterator[list[str | None]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= BUFFER:
            yield part
            part, size = [], 0
    if part:
        yield part


def _search(texts: list[str | None], searches: list[Search], owners: dict[bytes, list[str]]) -> Iterator[dict]:
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    plain = np.frombuffer(b" " + b" ".join(raw).translate(_FOLD) + b" ", np.uint8)
    word = plain != 0x20
    starts = np.flatnonzero(word[1:] & ~word[:-1]) + 1
    keep = word.copy()
    keep[1:] |= word[:-1]
    keep[0] = True
    text = plain[keep].tobytes() + bytes(8)
    spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 0x20)
    offsets = np.cumsum([1] + [len(x) + 1 for x in raw])
    first = np.searchsorted(starts, offsets)
    items: dict[int, set[str]] = defaultdict(set)
    spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for search in searches:
        for p, pattern in search.occurrences(text):
            k, n = int(np.searchsorted(spaces, p)), pattern.count(b" ") - 1
            doc = int(np.searchsorted(first, k, "right")) - 1
            if k + n <= first[doc + 1]:
                items[doc].update(owners[pattern])
                spans[doc].append((k - int(first[doc]), k - int(first[doc]) + n))
    for doc in range(len(texts)):
        yield {"n_words": int(first[doc + 1] - first[doc]), "spans": spans.get(doc, []), "items": items.get(doc, ())}


def _merged(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], b)
        else:
            out.append({"first": a, "end": b})
    return out


def mark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", into: str = "hits", size: int = WINDOW) -> DataFrame:
    """docs with a column `into`: struct of n_words, spans of hit words (joined, in order), items.

    An item's windows are its runs of `size` consecutive words, or all its words
    if it has fewer. Null and empty texts have no words and no hits. Items
    without words have no window; windows of an item without id hit words but
    name no item; repeated rows give repeated results; texts of any length are
    searched whole; an item that two ids share names both; no rows give no rows.
    A column `into` of docs is replaced, others stay. The benchmark comes to the driver in blocks of BLOCK bytes and
    each block is one pass over docs; there is one unless the benchmark is larger.
    """
    docs = docs.drop(into)
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{into}` {_TYPE}"
    hit_type = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])
    out = docs
    for k in range(blocks):
        rows = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        owners: dict[bytes, list[str]] = defaultdict(list)
        for item, text in rows.distinct().collect():
            for w in set(windows(text, size)):
                owners[w] += [item] if item is not None else []

        shared = docs.sparkSession.sparkContext.broadcast(dict(owners))  # of BLOCK bytes of benchmark texts

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            owners = shared.value
            classes = [[w for w in owners if len(w) >= SHORT], [w for w in owners if len(w) < SHORT]]
            searches = [Search(c) for c in classes if c]
            for batch in pieces(batches):
                names = batch.schema.names
                at = names.index(text_col)
                texts = batch.column(at).cast(pa.string()).to_pylist()
                found = [x for part in _groups(texts) for x in _search(part, searches, owners)]
                if into in names:  # an earlier pass
                    for x, old in zip(found, batch.column(names.index(into)).to_pylist(), strict=True):
                        x["spans"] = [*x["spans"], *((s["first"], s["end"]) for s in old["spans"])]
                        x["items"] = {*x["items"], *old["items"]}
                hits = pa.array([{**x, "spans": _merged(x["spans"]), "items": sorted(x["items"])} for x in found], hit_type)
                kept = [(n, batch.column(i)) for i, n in enumerate(names) if n != into]
                yield pa.RecordBatch.from_arrays([*(c for _, c in kept), hits], names=[*(n for n, _ in kept), into])

        out = out.mapInArrow(run, schema)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that no benchmark window occurs in, with all their columns; nulls, ties, repeated rows and empty tables as for mark()."""
    into = free(docs, "hits")
    return mark(docs, benchmark, text_col, into=into).where(F.size(F.col(into).getField("spans")) == 0).drop(into)
