"""Removal of byte strings that an earlier document has, by a suffix array in ranges.

A string of LENGTH bytes is found through one suffix that starts inside it: of the
ANCHOR-byte strings in it, the one with the least hash, so that equal strings
have it at the same place. These suffixes are all that is sorted. Sampled
splitters range-partition them by their leading bytes; each range is sorted by
multikey quicksort over words of eight bytes, and suffixes whose leading bytes
no other document has drop out. The others are dealt again with the text around
them and sorted to its end; ties are in order of id, so that the first of equal
strings is in the earliest document. A string that a splitter cuts goes on in the
next range: the firsts of its ranges are compared across them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import folder, free, sized

LENGTH, ANCHOR = 50, 16
#: Bytes of text that a task looks at together; bytes of sorted rows of a range; sampled suffixes of a range.
CHUNK, RANGE, SAMPLE = 4 << 20, 24 << 20, 100
#: Least number of ranges; bytes that are hashed at once.
LEAST, BLOCK = 64, 1 << 20
#: Windows that are sorted together.
WINDOWS = 200_000
#: The place of null ids.
LAST = np.iinfo(np.int64).max
_LOW = np.uint64((1 << 24) - 1)


def _anchors(text: np.ndarray, length: int) -> np.ndarray:
    """The anchor of each string of `length` bytes; of equal hashes the rightmost counts."""
    words = np.ndarray((len(text) - 7,), "<u8", text.tobytes(), strides=(1,))
    n = len(text) - ANCHOR + 1
    h = words[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h += words[8 : 8 + n]
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h &= ~_LOW
    h |= _LOW - np.arange(n, dtype=np.uint64)
    width, have = length - ANCHOR + 1, 1
    while 2 * have <= width:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    if have < width:
        h = np.minimum(h[: have - width], h[width - have :])
    return (_LOW - (h & _LOW)).astype(np.int64)


def suffixes(text: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, anchor): runs of positions whose strings of `length` bytes have the same anchor and lie in one document.

    `ends` are where the documents of text end. What is chosen depends on the
    bytes of a string alone; a run ends at a block's end too.
    """
    found = [(np.zeros(0, np.int64),) * 3]
    for k in range(0, len(text) - length + 1, BLOCK):
        anchor = _anchors(text[k : k + BLOCK + length - 1], length) + k
        at = np.arange(k, k + len(anchor))
        doc = np.searchsorted(ends, at, "right")
        inside = at + length <= ends[doc]
        at, doc, anchor = at[inside], doc[inside], anchor[inside]
        begins = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]))[: len(at)]
        found.append((at[begins], at[np.append(begins[1:], len(at))[: len(begins)] - 1], anchor[begins]))
    first, last, anchor = (np.concatenate(x) for x in zip(*found, strict=True))
    return first, last, anchor


def multikey(words: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, same): rows in order of their words and ids, and how many leading words each shares with the row before.

    Multikey quicksort, all segments at a time: rows are sorted by one word, and
    only segments of equal words go on to the next.
    """
    n, width = words.shape
    order = np.argsort(words[:, 0], kind="stable") if width else np.arange(n)
    same = np.zeros(n, np.int64)
    rows = np.arange(n)  # places in order that segments of at least two rows hold
    for j in range(1, width + 1):
        key = words[order[rows], j - 1]
        equal = np.zeros(len(rows), bool)
        equal[1:] = (key[1:] == key[:-1]) & (rows[1:] == rows[:-1] + 1) & (same[rows[1:]] == j - 1)
        same[rows[equal]] = j
        keep = equal.copy()
        keep[:-1] |= equal[1:]
        rows, equal = rows[keep], equal[keep]
        if not len(rows):
            break
        segment = np.cumsum(~equal)
        part = order[rows]
        order[rows] = part[np.lexsort((words[part, j] if j < width else ids[part], segment))]
    return order, same


def _as_words(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as big-endian words, padded with zeros."""
    wide = -(-rows.shape[1] // 8) * 8
    if wide > rows.shape[1]:
        rows = np.concatenate([rows, np.zeros((len(rows), wide - rows.shape[1]), np.uint8)], axis=1)
    return np.ascontiguousarray(rows).view(">u8").astype(np.uint64)


def _minima(values: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of each segment."""
    return np.minimum.reduceat(values, begins), np.maximum.reduceat(values, begins)


class Splitters:
    """Where ranges begin: leading words and id of sampled suffixes."""

    def __init__(self, words: np.ndarray, ids: np.ndarray, ranges: int):
        order, _ = multikey(words, ids)
        picked = order[(np.arange(1, ranges) * len(order)) // ranges] if len(order) else order
        both = sorted({(*w, i) for w, i in zip(words[picked].tolist(), ids[picked].tolist(), strict=True)})
        self.words = np.array([b[:-1] for b in both], np.uint64).reshape(len(both), words.shape[1])
        self.ids = np.array([b[-1] for b in both], np.int64)

    def ranges(self, words: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The number of splitters that do not come after each row."""
        out = np.searchsorted(self.words[:, 0], words[:, 0], "left")
        high = np.searchsorted(self.words[:, 0], words[:, 0], "right")
        tied = np.flatnonzero(out < high)
        low, high = out[tied], high[tied]
        for j in range(int(low.min(initial=0)), int(high.max(initial=0))):
            rows = tied[(low <= j) & (j < high)]
            if len(rows):
                before, equal = np.zeros(len(rows), bool), np.ones(len(rows), bool)
                for own, other in [*zip(self.words[j], words[rows].T, strict=True), (self.ids[j], ids[rows])]:
                    before |= equal & (own < other)
                    equal &= own == other
                out[rows] += before | equal
        return out

    def cut(self, words: np.ndarray) -> np.ndarray:
        """Whether a splitter has the words of each row, so that others like it may be in another range."""
        out = np.zeros(len(words), bool)
        maybe = np.flatnonzero(np.isin(words[:, 0], self.words[:, 0]))
        if len(maybe):
            for own in self.words[np.isin(self.words[:, 0], words[maybe, 0])]:
                out[maybe] |= (words[maybe] == own).all(axis=1)
        return out


def _dealt(ranges: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """One row for each range: how many rows it gets, and their columns, packed."""
    order = np.argsort(ranges, kind="stable")
    begins = np.flatnonzero(np.concatenate([[True], np.diff(ranges[order]) != 0])) if len(order) else order
    packed, sizes, pack = [], np.diff(np.append(begins, len(order))), zstandard.ZstdCompressor(level=1)
    for at, size in zip(begins.tolist(), sizes.tolist(), strict=True):
        rows = order[at : at + size]
        packed.append(pack.compress(b"".join(_planes(c[rows]) for c in columns)))
    return pa.RecordBatch.from_arrays([pa.array(ranges[order[begins]], pa.int32()), pa.array(sizes, pa.int32()), pa.array(packed, pa.binary())], names=["range", "n", "packed"])


def _planes(column: np.ndarray) -> bytes:
    """First bytes of all rows, then second ones, and so on."""
    return np.ascontiguousarray(column.reshape(len(column), -1).view(np.uint8).T).tobytes()


def _joined(table: pa.Table, shapes: list[tuple[str, int]]) -> list[np.ndarray]:
    """The columns that _dealt() packed, of all rows of a range."""
    found: list[list[np.ndarray]] = [[np.zeros((0, width), kind)] for kind, width in shapes]
    for n, packed in zip(table["n"].to_pylist(), table["packed"].to_pylist(), strict=True):
        raw, at = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8), 0
        for k, (kind, width) in enumerate(shapes):
            size = np.dtype(kind).itemsize * width
            found[k].append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(kind).reshape(n, width))
            at += n * size
    return [np.concatenate(f) for f in found]


def _chunks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[int], list[int], list[int]]]:
    """(text, ends, rows of the batch, their first bytes, batch) of documents that are looked at together; long ones in parts that overlap by all but one byte of a string."""
    for batch in sized(batches, "text", CHUNK):
        names = batch.schema.names
        texts, ids, hs = (batch.column(names.index(c)).to_pylist() for c in ("text", "id", "h"))
        once = {(i, h, len(t or "")): row for row, (t, i, h) in enumerate(zip(texts, ids, hs, strict=True))}  # rows alike find the same
        parts: list[tuple[int, int, bytes]] = []
        for row in once.values():
            text = (texts[row] or "").encode("utf-8", "surrogatepass")
            for at in range(0, max(1, len(text) - length + 1), CHUNK):
                parts.append((row, at, text[at : at + CHUNK + length - 1]))
        while parts:
            held = np.cumsum([len(p[2]) for p in parts])
            n = max(1, int(np.searchsorted(held, CHUNK + length, "right")))
            yield np.frombuffer(b"".join(p[2] for p in parts[:n]), np.uint8), held[:n], [p[0] for p in parts[:n]], [p[1] for p in parts[:n]], batch
            parts = parts[n:]


def _long(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def _found(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple]:
    """For each chunk: text, its suffixes (first, last, anchor), their ids and checksums of texts, and what makes their places places in the document."""
    for text, ends, rows, firsts, batch in _chunks(batches, length):
        first, last, anchor = suffixes(text, ends, length)
        doc = np.searchsorted(ends, first, "right")
        begins = np.append(0, ends[:-1])
        row, shift = np.array(rows, np.int64)[doc], (np.array(firsts, np.int64) - begins)[doc]
        names = batch.schema.names
        yield text, first, last, anchor, _long(batch.column(names.index("id")))[row], _long(batch.column(names.index("h")))[row], shift, row, batch


def _leads(text: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    return _as_words(sliding_window_view(text, ANCHOR)[anchor]) if len(anchor) else np.zeros((0, ANCHOR // 8), np.uint64)


def _around(text: np.ndarray, first: np.ndarray, last: np.ndarray, anchor: np.ndarray, length: int) -> np.ndarray:
    """A row of bytes for each suffix: from its anchor to the end of its strings, what its strings have before, and the lengths of both."""
    left = length - ANCHOR
    wide = np.concatenate([np.zeros(left, np.uint8), text, np.zeros(length, np.uint8)])
    after = sliding_window_view(wide, length)[anchor + left]
    after[np.arange(length) >= (last + length - anchor)[:, None]] = 0
    before = sliding_window_view(wide, max(1, left))[anchor][:, :left]
    before[np.arange(left) < left - (anchor - first)[:, None]] = 0
    sizes = np.stack([anchor - first, last + length - anchor], axis=1).astype(">u2").view(np.uint8)
    return np.concatenate([after, before, sizes], axis=1)


def _windows(rows: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, place after the row's first, string) of all strings of rows that _around() made."""
    left = length - ANCHOR
    sizes = np.ascontiguousarray(rows[:, length + left :][:, :4]).view(">u2").astype(np.int64)
    n = sizes.sum(axis=1) - length + 1
    upto, at = np.cumsum(n), 0
    while at < len(rows):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + WINDOWS, "right")))
        flat = np.concatenate([rows[at:end, length : length + left], rows[at:end, :length]], axis=1)
        row = np.repeat(np.arange(at, end), n[at:end])
        place = np.arange(len(row)) - np.repeat(upto[at:end] - n[at:end] - (upto[at - 1] if at else 0), n[at:end])
        start = (row - at) * flat.shape[1] + left - sizes[row, 0] + place
        yield row, place, sliding_window_view(flat.ravel(), length)[start]
        at = end


def _runs(row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of places that follow each other."""
    order = np.lexsort((place, row))
    row, place = row[order], place[order]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)])[: len(row)]
    begins = np.flatnonzero(new)
    return row[begins], place[begins], place[np.append(begins[1:], len(row))[: len(begins)] - 1]


def _packed_rows(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _meets(words: np.ndarray, ids: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Whether another id has the words of each row, or may have them in another range."""
    if not len(ids):
        return cut
    order, same = multikey(words, ids)
    begins = np.flatnonzero(same < words.shape[1])
    least, most = _minima(ids[order], begins)
    out = np.zeros(len(ids), bool)
    out[order] = np.repeat((least != most) | cut[order[begins]], np.diff(np.append(begins, len(order))))
    return out


def _spans(ids: np.ndarray, hs: np.ndarray, first: np.ndarray, end: np.ndarray, rest: np.ndarray | None = None) -> pa.Table:
    """(id, h, first, end, rest): spans to remove where rest is null, else rows that are compared further."""
    kept = pa.nulls(len(ids), pa.binary()) if rest is None else _packed_rows(rest)
    return pa.table([pa.array(x, pa.int64()) for x in (ids, hs, first, end)] + [kept], names=["id", "h", "first", "end", "rest"])


_SPANS = "id bigint, h bigint, first bigint, end bigint, rest binary"
_DEALT = "range int, n int, packed binary"


def _settled(rows: np.ndarray, ids: np.ndarray, hs: np.ndarray, at: np.ndarray, open_rows: np.ndarray, length: int) -> list[pa.Table]:
    """What the sorted rows of one range say: `rows` are from _around(), ids in order.

    Rows that equal one of a smaller id go whole. Of the firsts of equal rows, all
    strings are compared with those of others with the same leading bytes; where
    other ranges may have these too, or they are very many, the rows go on instead.
    """
    if not len(rows):
        return [_spans(ids, hs, at, at)]
    words = _as_words(rows)
    order, same = multikey(words, ids)
    words, rows, ids, hs, at, open_rows = words[order], rows[order], ids[order], hs[order], at[order], open_rows[order]
    sizes = np.ascontiguousarray(rows[:, 2 * length - ANCHOR :][:, :4]).view(">u2").astype(np.int64).sum(axis=1)
    begins = np.flatnonzero(same < words.shape[1])
    least, _ = _minima(ids, begins)
    later = ids > np.repeat(least, np.diff(np.append(begins, len(ids))))
    heads = np.flatnonzero(same < ANCHOR // 8)
    low, high = _minima(ids, heads)
    held = np.diff(np.append(heads, len(ids)))
    alone = np.repeat(low == high, held)
    strings = np.add.reduceat(np.where(later, 0, sizes - length + 1), heads)
    open_rows |= ~alone & np.repeat(strings > 2 * WINDOWS, held)
    out = [_spans(ids[later], hs[later], at[later], at[later] + sizes[later])]
    on = ~later & open_rows
    out.append(_spans(ids[on], hs[on], at[on], at[on] + sizes[on], rows[on]))
    left = np.flatnonzero(~later & ~open_rows & ~alone)
    group = np.cumsum(same < ANCHOR // 8)[left]
    held = np.flatnonzero(np.concatenate([[True], np.diff(group) != 0])) if len(left) else left
    n = (sizes[left] - length + 1).cumsum()
    while len(held):  # whole groups, about WINDOWS strings at a time
        upto = n[np.append(held[1:], len(left)) - 1]
        take = max(1, int(np.searchsorted(upto, (n[held[0] - 1] if held[0] else 0) + WINDOWS, "right")))
        part = left[held[0] : held[take] if take < len(held) else len(left)]
        held = held[take:]
        row, place, strings = (np.concatenate(x) for x in zip(*_windows(rows[part], length), strict=True))
        owner = part[row]
        found, equal = multikey(_as_words(strings), ids[owner])
        starts = np.flatnonzero(equal < -(-length // 8))
        first, _ = _minima(ids[owner][found], starts)
        gone = found[ids[owner][found] > np.repeat(first, np.diff(np.append(starts, len(found))))]
        if len(gone):
            r, a, b = _runs(owner[gone], place[gone])
            out.append(_spans(ids[r], hs[r], at[r] + a, at[r] + b + length))
    return out


def spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, h, first, end) of what goes from docs (id bigint, h bigint, text); a row for each part that was found, which may overlap."""
    spark = docs.sparkSession
    at = f"{folder(spark)}/suffixes-{uuid.uuid4().hex}"
    key = ANCHOR // 8
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    # 1: leading bytes of all suffixes
    ranges = max(LEAST, -(-total * 2 * 36 // ((length - ANCHOR + 2) * RANGE)))
    share = min(1.0, max(0.005, ranges * SAMPLE * 300 / max(1, total)))

    def lead_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for text, _, _, anchor, ids, _, _, _, _ in _found(batches, length):
            pick = np.arange(0, len(anchor), 16)
            w = _leads(text, anchor[pick])
            yield pa.RecordBatch.from_arrays([pa.array(w[:, 0].view(np.int64)), pa.array(w[:, 1].view(np.int64)), pa.array(ids[pick])], names=["a", "b", "id"])

    picked = docs.where(F.pmod(F.xxhash64(F.lit(1), "id", "h"), F.lit(1 << 20)) < int(share * (1 << 20)))
    sample = picked.mapInArrow(lead_sample, "a bigint, b bigint, id bigint").toArrow()
    tops = spark.sparkContext.broadcast(Splitters(np.stack([_long(sample[c].combine_chunks()).view(np.uint64) for c in "ab"], axis=1), _long(sample["id"].combine_chunks()), ranges))

    def deal_leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for text, first, _, anchor, ids, hs, shift, _, _ in _found(batches, length):
            w = _leads(text, anchor)
            yield _dealt(tops.value.ranges(w, ids), [w, ids, hs, (first + shift).astype(np.int32)])

    def meeting(table: pa.Table) -> pa.Table:
        w, ids, hs, places = _joined(table, [("u8", key), ("i8", 1), ("i8", 1), ("i4", 1)])
        on = _meets(w, ids[:, 0], tops.value.cut(w))
        both = pa.table([pa.array(x[on, 0]) for x in (ids, hs, places)], names=["id", "h", "at"]).group_by(["id", "h", "at"]).aggregate([])
        both = both.group_by(["id", "h"]).aggregate([("at", "list")])
        return both.rename_columns({"at_list": "at"}).select(["id", "h", "at"])

    found = docs.mapInArrow(deal_leads, _DEALT).groupBy("range").applyInArrow(meeting, "id bigint, h bigint, at array<int>")
    found.write.option("compression", "zstd").parquet(f"{at}/meeting")
    meets = spark.read.parquet(f"{at}/meeting").groupBy("id", "h").agg(F.array_sort(F.flatten(F.collect_list("at"))).alias("at"))

    # 2: those that meet others, with the text around them
    texts = docs.join(meets.withColumnsRenamed({"id": "id2", "h": "h2"}), (F.col("id") == F.col("id2")) & (F.col("h") == F.col("h2"))).select("id", "h", "text", "at")

    def deal_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for text, first, last, anchor, ids, hs, shift, row, batch in _found(batches, length):
            on = _wanted(batch, row, first + shift)
            first, last, anchor, ids, hs, shift = (x[on] for x in (first, last, anchor, ids, hs, shift))
            if len(first):
                yield _dealt(tops.value.ranges(_leads(text, anchor), ids), [_around(text, first, last, anchor, length), ids, hs, (first + shift).astype(np.int32)])

    def settle(table: pa.Table) -> pa.Table:
        rows, ids, hs, places = _joined(table, [("u1", 2 * length - ANCHOR + 4), ("i8", 1), ("i8", 1), ("i4", 1)])
        cut = tops.value.cut(_as_words(rows[:, :ANCHOR]))
        return pa.concat_tables(_settled(rows, ids[:, 0], hs[:, 0], places[:, 0].astype(np.int64), cut, length))

    texts.mapInArrow(deal_rows, _DEALT).groupBy("range").applyInArrow(settle, _SPANS).write.option("compression", "zstd").parquet(f"{at}/settled")
    settled = spark.read.parquet(f"{at}/settled")

    # 3: strings whose leading bytes a splitter cuts, compared in ranges of their own
    rest = settled.where("rest is not null")
    cut_strings = rest.agg(F.sum(F.col("end") - F.col("first") - (length - 1))).first()[0] or 0
    out = settled.where("rest is null").select("id", "h", "first", "end")
    if not cut_strings:
        return out
    more = max(LEAST, -(-cut_strings * (length + 24) // RANGE))

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            rows = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(batch.num_rows, 2 * length - ANCHOR + 4)
            ids, hs, first = (_long(batch.column(k)) for k in range(3))
            for row, place, strings in _windows(rows, length):
                yield _as_words(strings), ids[row], hs[row], first[row] + place

    def string_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w, ids, _, _ in exploded(batches):
            yield pa.RecordBatch.from_arrays([_packed_rows(w.view(np.uint8)), pa.array(ids)], names=["w", "id"])

    few = min(1.0, more * SAMPLE * 4 / cut_strings)
    sample = rest.where(F.pmod(F.xxhash64(F.lit(2), "id", "h", "first"), F.lit(1 << 20)) < int(few * (1 << 20))).mapInArrow(string_sample, "w binary, id bigint").toArrow()
    width = -(-length // 8)
    keys = np.frombuffer(b"".join(sample["w"].to_pylist()), np.uint64).reshape(-1, width)
    lows = spark.sparkContext.broadcast(Splitters(keys, _long(sample["id"].combine_chunks()), more))

    def deal_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w, ids, hs, places in exploded(batches):
            yield _dealt(lows.value.ranges(w, ids), [w, ids, hs, places.astype(np.int32)])

    def compare(table: pa.Table) -> pa.Table:
        w, ids, hs, places = _joined(table, [("u8", width), ("i8", 1), ("i8", 1), ("i4", 1)])
        ids, hs, places = ids[:, 0], hs[:, 0], places[:, 0].astype(np.int64)
        order, same = multikey(w, ids)
        w, ids, hs, places = w[order], ids[order], hs[order], places[order]
        begins = np.flatnonzero(same < width)
        least, _ = _minima(ids, begins)
        later = ids > np.repeat(least, np.diff(np.append(begins, len(ids))))
        on = ~later & lows.value.cut(w)
        return pa.concat_tables([_spans(ids[later], hs[later], places[later], places[later] + length), _spans(ids[on], hs[on], places[on], places[on] + length, w[on].view(np.uint8))])

    rest.mapInArrow(deal_strings, _DEALT).groupBy("range").applyInArrow(compare, _SPANS).write.option("compression", "zstd").parquet(f"{at}/compared")
    compared = spark.read.parquet(f"{at}/compared")
    # across ranges: the firsts of each range for a string that is cut
    firsts = compared.where("rest is not null")
    least = firsts.groupBy("rest").agg(F.min("id").alias("least"))
    later = firsts.join(least, "rest").where("id > least")
    return out.unionByName(compared.where("rest is null").select("id", "h", "first", "end")).unionByName(later.select("id", "h", "first", "end"))


def _wanted(batch: pa.RecordBatch, row: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which places are in the list `at` of their row."""
    lists = batch.column(batch.schema.names.index("at"))
    sizes = np.diff(lists.offsets.to_numpy())
    owner = np.repeat(np.arange(batch.num_rows, dtype=np.int64), sizes)
    return np.isin((row << 32) | place, (owner << 32) | _long(lists.flatten()))


def _kept(text: bytes, parts: list[dict]) -> dict:
    runs: list[dict] = []
    for p in sorted(parts, key=lambda p: p["first"]):
        if runs and p["first"] <= runs[-1]["end"]:
            runs[-1]["end"] = max(runs[-1]["end"], p["end"])
        else:
            runs.append(dict(p))
    edges = [0, *(x for r in runs for x in (r["first"], r["end"])), len(text)]
    return {"n_bytes": len(text), "removed": runs, "kept": b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))}


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", into: str = "repeats", length: int = LENGTH) -> DataFrame:
    """docs with a struct `into`: n_bytes, removed (first and end of maximal runs of bytes), kept (the other bytes).

    A byte goes if a string of `length` bytes (at least ANCHOR) around it, in one
    document, also starts in a document with a smaller id. Ids are whole numbers;
    a null id is the greatest, as the greatest bigint is. Null texts count as
    empty; texts under `length` bytes stay whole, longer ones of any length are
    searched whole; documents of one id take nothing from each other, so repeated
    rows have equal results; no rows give no rows. A column `into` of docs is
    replaced, others stay, whatever their names.
    """
    if length < ANCHOR:
        raise ValueError(f"length is at least {ANCHOR}")
    docs = docs.drop(into)
    key, of, found = (free(docs, n) for n in ("key", "of", "found"))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    doc_id = F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(int(LAST)))
    repeated = docs.groupBy(doc_id.alias("id")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    keyed = docs.withColumn(key, F.struct(doc_id.alias("id"), (F.xxhash64(text) if repeated > 1 else F.lit(0).cast("bigint")).alias("h")))
    parts = spans(keyed.select(f"{key}.id", f"{key}.h", text.alias("text")), length)
    parts = parts.groupBy(F.struct("id", "h").alias(of)).agg(F.collect_set(F.struct("first", "end")).alias(found))
    both = keyed.join(parts, F.col(key) == F.col(of), "left").drop(key, of)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"`{into}` struct<n_bytes:bigint,removed:array<struct<first:bigint,end:bigint>>,kept:binary>"])
    kind = pa.struct([("n_bytes", pa.int64()), ("removed", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches, text_col, rows=1000):
            at = {n: k for k, n in enumerate(batch.schema.names)}
            texts, lists = batch.column(at[text_col]).cast(pa.binary()).to_pylist(), batch.column(at[found]).to_pylist()
            made = pa.array([_kept(t or b"", p or []) for t, p in zip(texts, lists, strict=True)], kind)
            others = [n for n in batch.schema.names if n != found]
            yield pa.RecordBatch.from_arrays([*(batch.column(at[n]) for n in others), made], names=[*others, into])

    return both.mapInArrow(run, schema)
