"""Language of mixed-language text: scripts narrow the candidates, Viterbi labels the words."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, pieces

UNKNOWN = "und"
#: Expected rows of the training sample, hashed feature buckets, letters of a feature.
SAMPLE = 20_000
BUCKETS = 1 << 16
NGRAM = 3
#: Cost of a change of language between two words; share of a language's letters from which it uses a script.
SWITCH = 6.0
SCRIPT_SHARE = 0.01
#: Code points that one numpy buffer holds.
BUFFER = 1 << 19

# First and last code point of each script.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x250, 0x2AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFB00, 0xFB06), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F), (0xA8E0, 0xA8FF)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)],
}
OTHER = len(SCRIPTS) + 1


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """For each code point 0 if it isn't a letter, else its script's number."""
    out = np.zeros(0x110000, dtype=np.uint8)
    for c in range(0x323B0):
        if unicodedata.category(chr(c))[0] == "L":
            out[c] = OTHER
    for k, ranges in enumerate(SCRIPTS.values(), 1):
        for a, b in ranges:
            part = out[a : b + 1]
            part[part > 0] = k
    return out


class Words:
    """The words of some texts in one buffer: their features, scripts and places."""

    def __init__(self, texts: list[str | None]):
        lower = [(t or "").lower() for t in texts]
        codes = np.frombuffer(("\0" + "\0".join(lower) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = _classes()[codes]
        letter = kinds > 0
        starts = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
        ends = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
        offsets = np.cumsum([1] + [len(t) + 1 for t in lower])
        self.first = np.searchsorted(starts, offsets)
        self.n = len(starts)
        self.length = ends - starts
        self.starts = starts
        plain = np.where(letter, codes, 0).astype(np.uint64)
        # a feature of a word: each run of NGRAM code points that begins at its blank or in it
        mixed = plain[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ plain[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ plain[2:] * np.uint64(0x165667B19E3779F9)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        self.features = np.append((mixed >> np.uint64(48)).astype(np.int64), [0, 0])
        self.begin, self.end = starts - 1, ends - 1
        self.script = kinds[starts]

    def scores(self, table: np.ndarray) -> np.ndarray:
        """Sum of the features' rows of the table for each word."""
        if not self.n:
            return np.zeros((0, table.shape[1]), dtype=np.float32)
        sums = np.zeros((len(self.features) + 1, table.shape[1]), dtype=np.float64)
        np.cumsum(table[self.features], axis=0, out=sums[1:])
        return sums[self.end] - sums[self.begin]

    def counts(self) -> np.ndarray:
        """How often each feature is in the words."""
        mark = np.zeros(len(self.features) + 1, dtype=np.int64)
        np.add.at(mark, self.begin, 1)
        np.add.at(mark, self.end, -1)
        return np.bincount(self.features[np.cumsum(mark[:-1]) > 0], minlength=BUCKETS)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> dict:
    """Features of each language, from about `sample` of the labelled rows (all if they are fewer).

    Returns langs (in order), table (BUCKETS x langs log probabilities) and uses
    (scripts x langs). Rows without text or lang teach nothing. What comes to
    the driver depends on BUCKETS and the languages only.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    n = rows.count()
    if n > sample:
        rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < (1 << 30) * sample // n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in pieces(batches):
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                for part in _parts([t for g, t in zip(langs, texts, strict=True) if g == lang]):
                    words = Words(part)
                    found = np.append(words.counts(), np.bincount(words.script, weights=words.length, minlength=OTHER + 1).astype(np.int64))
                    total[lang] = total[lang] + found if lang in total else found
        for lang, found in total.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(found[at], pa.int64())], names=["lang", "feature", "n"])

    found = rows.mapInArrow(run, "lang string, feature bigint, n bigint").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    counts = np.zeros((BUCKETS + OTHER + 1, len(langs)))
    for k, lang in enumerate(langs):
        own = found[found["lang"] == lang]
        counts[own["feature"].to_numpy(), k] = own["n"].to_numpy()
    features, scripts = counts[:BUCKETS], counts[BUCKETS:]
    table = np.log((features + 0.1) / (features.sum(axis=0) + 0.1 * BUCKETS)).astype(np.float32) if langs else np.zeros((BUCKETS, 0), np.float32)
    uses = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1)
    return {"langs": langs, "table": table, "uses": uses}


def _parts(texts: list[str | None]) -> Iterator[list[str | None]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= BUFFER:
            yield part
            part, size = [], 0
    if part:
        yield part


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of each word: scores (words x labels), first (texts + 1 offsets of words).

    Texts advance side by side, a word at a time. Ties keep the label of the
    word before, else take the lowest.
    """
    n, labels = scores.shape
    back = np.zeros((n, labels), dtype=np.int16)
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    begin, counts = first[:-1][order], counts[order]
    path = np.zeros(n, dtype=np.int16)
    if not n:
        return path
    live = int((counts > 0).sum())
    value = scores[begin[:live]].copy()
    own = np.arange(labels, dtype=np.int16)
    last = {}
    active = [live]
    for step in range(1, int(counts[0])):
        now = int(np.searchsorted(-counts, -step, "left"))  # texts with more than `step` words
        if now < len(value):
            last[step - 1] = value[now:].argmax(axis=1)
            value = value[:now]
        best = value.argmax(axis=1)
        jump = value[np.arange(now), best] - switch
        at = begin[:now] + step
        moved = jump[:, None] > value
        back[at] = np.where(moved, best[:, None], own)
        value = np.where(moved, jump[:, None], value) + scores[at]
        active.append(now)
    state = value.argmax(axis=1)
    for step in range(int(counts[0]) - 1, -1, -1):
        at = begin[: active[step]] + step
        path[at] = state
        if step:
            state = back[at, state]
            if step - 1 in last:
                state = np.concatenate([state, last[step - 1]])
    return path


def label(texts: list[str | None], model: dict) -> list[dict]:
    """For each text lang, score and spans of words with one language."""
    langs, table, uses = model["langs"], model["table"], model["uses"]
    out: list[dict] = []
    for part in _parts(texts):
        words = Words(part)
        scores = words.scores(table)
        if langs and words.n:
            fits = uses[words.script]
            scores = np.where(fits | ~fits.any(axis=1, keepdims=True), scores, scores - 1e6)
            path = viterbi(scores, words.first)
        for k in range(len(part)):
            a, b = int(words.first[k]), int(words.first[k + 1])
            if a == b or not langs:
                out.append({"lang": UNKNOWN, "score": 0.0, "spans": []})
                continue
            own = path[a:b]
            weight = np.bincount(own, weights=words.length[a:b], minlength=len(langs))
            best = int(weight.argmax())
            cuts = np.flatnonzero(np.diff(own)) + 1
            edges = [0, *cuts.tolist(), b - a]
            spans = [{"lang": langs[own[x]], "first": x, "end": y} for x, y in zip(edges, edges[1:], strict=False)]
            out.append({"lang": langs[best], "score": float(weight[best] / weight.sum()), "spans": spans})
    return out


def identify(docs: DataFrame, model: dict, text_col: str = "text", into: str = "language") -> DataFrame:
    """docs with a column `into`: struct of lang, score and spans (lang, first, end: words).

    A word is a run of letters; lang has most letters, score is its share of
    them. Null texts and texts without letters are `und` with score 0; so is
    every text if the model has no language. Equal rows get equal results; texts
    of any length are labelled whole; ties go to the first language by name; no
    rows give no rows; a column `into` of docs is replaced, others stay.
    """
    docs = docs.drop(into)
    kind = "struct<lang:string,score:double,spans:array<struct<lang:string,first:bigint,end:bigint>>>"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{into}` {kind}"
    hit = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int64()), ("end", pa.int64())])))])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows of one float a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = batch.column(batch.schema.names.index(text_col)).cast(pa.string()).to_pylist()
            found = pa.array(label(texts, shared.value), hit)
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, into])

    return docs.mapInArrow(run, schema)


def keep_known(docs: DataFrame, model: dict, least: float, text_col: str = "text") -> DataFrame:
    """The rows of docs with one main language, which has at least the share `least` of their letters, with all their columns.

    Null texts and texts without letters go; repeated rows stay repeated; no
    rows give no rows.
    """
    into = free(docs, "language")
    found = identify(docs, model, text_col, into)
    language = F.col(into)
    return found.where((language.getField("lang") != UNKNOWN) & (language.getField("score") >= least)).drop(into)
