"""Language-model scores of texts as the sum over all their segmentations into subwords.

The pieces are those of an existing vocabulary file, and its scores weigh the
segmentations: as a law of the pieces they count like PRIOR pieces seen before,
to which the corpus adds its expected counts over the lattice of each distinct
word, weighted by the word's count. A word's probability is the forward
recursion over its lattice, in logarithms.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: A word with at least one in HOT of all tokens is sent to every task, so HOT words at most.
HOT, HOT_BYTES = 1_000_000, 64
#: Distinct words that a task counts before it hands them on; characters of words worked on at once.
FLUSH, CHARS = 200_000, 400_000
#: Pieces that the file's scores count as, and rounds of expected counts over all training words.
PRIOR, ROUNDS = 10_000, 2
SPACE, END = "▁", ""
_U = np.uint64


def vocabulary(path: str) -> pd.DataFrame:
    """Pieces of a sentencepiece file: piece, byte (its number, else -1), score."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = []
    for k in range(sp.get_piece_size()):
        if not (sp.is_control(k) or sp.is_unknown(k)):
            piece = sp.id_to_piece(k)
            rows.append((piece, int(piece[3:5], 16) if sp.is_byte(k) else -1, sp.get_score(k)))
    return pd.DataFrame(rows, columns=["piece", "byte", "score"])


def start(vocab: pd.DataFrame) -> np.ndarray:
    """Log probabilities from the scores of the file, and that of the end of a text.

    Scores of a unigram file are logarithms already. Those of a BPE file are
    whole numbers, its merges' ranks, which fall by one from piece to piece: the
    probability is then inverse to the rank (Zipf). Bytes count as the last.
    """
    scores = vocab["score"].to_numpy(dtype=float)
    ranks = bool(len(scores)) and (scores == np.round(scores)).all() and len(np.unique(scores)) > len(scores) / 2
    lowest = np.where(vocab["byte"] >= 0, np.inf, scores).min(initial=0.0) - 1
    scores = np.where(vocab["byte"] >= 0, lowest, scores)
    p = 1 / (1 + np.maximum(-scores, 0)) if ranks else np.exp(scores)
    return np.log(np.append(p, 1e-6) / (p.sum() + 1e-6))


def _hash(codes: np.ndarray) -> np.ndarray:
    return (codes.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15)


class Lattice:
    """Pieces with their log probabilities; the last probability is the end of a text."""

    BITS = 18

    def __init__(self, vocab: pd.DataFrame, logp: np.ndarray):
        self.logp = np.append(logp[:-1], -np.inf)  # an unknown piece is the last
        self.end = float(logp[-1])
        self.none = len(vocab)
        self.longest = max([1, *vocab["piece"][vocab["byte"] < 0].str.len()])
        self.bytes = np.full(256, self.none)
        hashes, ids = [], []
        for k, (piece, byte) in enumerate(zip(vocab["piece"], vocab["byte"], strict=True)):
            if byte >= 0:
                self.bytes[byte] = k
            else:
                h = _U(0)
                for c in _hash(np.array([ord(c) for c in piece])):
                    with np.errstate(over="ignore"):
                        h = h * _U(0xD1342543DE82EF95) + c
                hashes.append(h)
                ids.append(k)
        self.keys = np.append(np.array(hashes, _U), _U(0))
        self.ids = np.append(np.array(ids), self.none)
        self.tables, rest, shift = [], np.arange(len(hashes)), 64 - self.BITS
        while len(rest):  # those whose slot is taken go to the next table
            table = np.full(1 << self.BITS, len(hashes), np.int32)
            slot = (self._spread(self.keys[rest], len(self.tables)) >> _U(shift)).astype(np.int64)
            table[slot] = rest
            self.tables.append(table)
            rest = rest[table[slot] != rest]

    @staticmethod
    def _spread(h: np.ndarray, k: int) -> np.ndarray:
        return (h ^ (h >> _U(32))) * _U(0xBF58476D1CE4E5B9 + 2 * k * 0x94D049BB133111EB & (1 << 64) - 1)

    def _find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(h.shape, self.none)
        for k, table in enumerate(self.tables):
            at = table[(self._spread(h, k) >> _U(64 - self.BITS)).astype(np.int64)]
            hit = (self.keys[at] == h) & (at < len(self.keys) - 1)
            out = np.where(hit, self.ids[at], out)
        return out

    def _edges(self, codes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Piece of each length at each place; pieces that spell the bytes of each distinct character; which one a place has; their log probability."""
        n = codes.shape[1]
        one, found, h = _hash(codes), [], None
        for size in range(1, min(self.longest, n) + 1):
            h = one if size == 1 else h[:, :-1] * _U(0xD1342543DE82EF95) + one[:, size - 1 :]
            found.append(self._find(h))
        chars, where = np.unique(codes, return_inverse=True)
        spelled = np.full((len(chars), 4), self.none)
        for k, c in enumerate(chars):
            raw = chr(c).encode("utf-8", "surrogatepass")
            spelled[k, : len(raw)] = self.bytes[list(raw)]
        cost = np.where(spelled == self.none, 0.0, self.logp[spelled]).sum(axis=1)
        return found, spelled, where.reshape(codes.shape), cost

    def forward(self, codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Log sums of all segmentations of each beginning: rows are words of one length."""
        found, spelled, where, cost = self._edges(codes)
        count, n = codes.shape
        alpha = np.full((count, n + 1), -np.inf)
        alpha[:, 0] = 0
        single = np.logaddexp(self.logp[found[0]], cost[where])
        for j in range(1, n + 1):
            terms = np.empty((count, min(j, self.longest)))
            terms[:, 0] = alpha[:, j - 1] + single[:, j - 1]
            for size in range(2, min(j, self.longest) + 1):
                terms[:, size - 1] = alpha[:, j - size] + self.logp[found[size - 1][:, j - size]]
            top = terms.max(axis=1)
            alpha[:, j] = top + np.log(np.exp(terms - top[:, None]).sum(axis=1))
        return alpha, found, spelled, where, cost

    def scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each word."""
        out = np.zeros(len(words))
        for at, codes in _by_length(words):
            out[at] = self.forward(codes)[0][:, -1]
        return out

    def expected(self, words: list[str], weights: np.ndarray) -> np.ndarray:
        """Expected count of each piece over all segmentations of the words."""
        total = np.zeros(self.none + 1)
        for at, codes in _by_length(words):
            alpha, found, spelled, where, cost = self.forward(codes)
            count, n = codes.shape
            beta = np.full((count, n + 1), -np.inf)
            beta[:, n] = 0
            single = np.logaddexp(self.logp[found[0]], cost[where])
            for i in range(n - 1, -1, -1):
                terms = np.empty((count, min(n - i, self.longest)))
                terms[:, 0] = single[:, i] + beta[:, i + 1]
                for size in range(2, min(n - i, self.longest) + 1):
                    terms[:, size - 1] = self.logp[found[size - 1][:, i]] + beta[:, i + size]
                top = terms.max(axis=1)
                beta[:, i] = top + np.log(np.exp(terms - top[:, None]).sum(axis=1))
            weight, whole = weights[at][:, None], alpha[:, -1:]
            for size, ids in enumerate(found, 1):
                share = np.exp(alpha[:, : n - size + 1] + self.logp[ids] + beta[:, size:] - whole) * weight
                total += np.bincount(ids.ravel(), weights=share.ravel(), minlength=self.none + 1)
            share = np.exp(alpha[:, :-1] + cost[where] + beta[:, 1:] - whole) * weight
            by_char = np.bincount(where.ravel(), weights=share.ravel(), minlength=len(spelled))
            total += np.bincount(spelled.ravel(), weights=np.repeat(by_char, 4), minlength=self.none + 1)
        return total[:-1]


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, codes) of words of the same length, each with the mark of a word's start."""
    lengths = np.array([len(w) for w in words])
    order = np.argsort(lengths, kind="stable")
    edges = np.flatnonzero(np.diff(lengths[order])) + 1
    for group in np.split(order, edges) if len(order) else []:
        n = int(lengths[group[0]]) + 1
        step = max(1, CHARS // n)
        for k in range(0, len(group), step):
            at = group[k : k + step]
            raw = "".join(SPACE + words[i] for i in at).encode("utf-32-le", "surrogatepass")
            yield at, np.frombuffer(raw, "<u4").reshape(len(at), n).astype(np.int64)


def tokens(text: str | None) -> list[bytes]:
    """Words of a text, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_counts(docs: DataFrame, trains: str, text_col: str = "text") -> DataFrame:
    """(word, c): every word of docs with its count in the rows where `trains` is true; the end of a text is the empty word."""
    rows = docs.select(F.coalesce(F.expr(trains), F.lit(False)).alias("trains"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def out() -> pa.RecordBatch:
            words = pa.array([w.decode("utf-8", "replace") for w in found], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(found.values()), pa.int64())], names=["word", "c"])

        for batch in batches:
            for trains, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = tokens(text)
                if trains:
                    found.update(words)
                    found[END.encode()] += 1
                else:
                    for w in words:
                        found.setdefault(w, 0)
                if len(found) > FLUSH:
                    yield out()
                    found = Counter()
        yield out()

    return rows.mapInArrow(run, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def fit(counts: DataFrame, vocab: pd.DataFrame, rounds: int = ROUNDS, prior: float = PRIOR) -> np.ndarray:
    """Log probabilities of the pieces and the end: the file's, as `prior` pieces seen, and expected counts of all training words, `rounds` times."""
    logp = start(vocab)
    before = np.exp(logp) * prior
    sc = counts.sparkSession.sparkContext
    ends = counts.where(F.col("word") == END).agg(F.sum("c")).first()[0] or 0
    rows = counts.where((F.col("word") != END) & (F.col("c") > 0)).select("word", "c")
    for _ in range(rounds):
        model = sc.broadcast((vocab, logp))

        def run(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            lattice, total = Lattice(*model.value), np.zeros(len(model.value[0]))
            for batch in batches:
                total += lattice.expected(batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(float))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["piece", "n"])

        found = rows.mapInArrow(run, "piece bigint, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        total = before.copy()
        total[found["piece"].to_numpy(dtype=np.int64)] += found["n"].to_numpy()
        total[-1] += ends
        logp = np.log(total / total.sum())
    return logp


def _scored(counts: DataFrame, model) -> DataFrame:
    """(word, c, lp): log10 probability of each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*model.value)
        for batch in batches:
            lp = lattice.scores(batch.column(0).to_pylist()) / math.log(10)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lp)], names=["word", "c", "lp"])

    return counts.select("word", "c").mapInArrow(run, "word string, c bigint, lp double")


def score(docs: DataFrame, trains: str, vocab: pd.DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_share: int = HOT, rounds: int = ROUNDS, prior: float = PRIOR) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row of docs.

    base_score is the add-half unigram model of whole words, score the marginal
    probability over all segmentations, both log10 and learned from the rows
    where `trains` is true. A word's count and score go to a task if it has one
    in `hot_share` of the training tokens; other words meet theirs in a join.
    Null and empty texts have their end alone; words and texts of any length are
    scored whole; rows alike in id and text get equal rows; without training
    rows counts are 0 and the pieces have the file's probabilities; other
    columns are read by `trains` alone; no rows give no rows. `hot_share` and
    HOT_BYTES change where a word is looked up, not its score.
    """
    spark = docs.sparkSession
    counts = cut(word_counts(docs, trains, text_col))
    total, kinds, ends = counts.agg(F.sum("c"), F.count_if(F.col("c") > 0), F.sum(F.when(F.col("word") == END, F.col("c")))).first()
    total, ends = total or 0, ends or 0
    hot = max(2.0, total / hot_share)
    frequent = (F.col("c") >= hot) & (F.octet_length("word") <= HOT_BYTES) & (F.col("word") != END)
    logp = fit(counts, vocab, rounds, prior)
    model = spark.sparkContext.broadcast((vocab, logp))
    known = _scored(counts.where(frequent).repartition(8), model).toPandas()
    table = spark.sparkContext.broadcast({w.encode(): (math.log10(c + 0.5), lp) for w, c, lp in known.itertuples(index=False)})
    rare = _scored(counts.where(~frequent & (F.col("word") != END)), model)
    last = (math.log10(ends + 0.5), float(ends > 0), float(logp[-1] / math.log(10)))
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("k"), F.col(text_col).cast("string").alias("text"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = table.value
        names = ["row", "k", "g", "is_doc", "n", "base", "known", "lp"]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for row, (k, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                words = tokens(text)
                base, seen, lp = last
                for w, n in Counter(words).items():
                    if x := hot.get(w):
                        base += n * x[0]
                        lp += n * x[1]
                        seen += n
                    else:
                        for c, v in zip(out, (row, k, w.decode("utf-8", "replace"), False, n, 0.0, 0.0, 0.0), strict=True):
                            c.append(v)
                for c, v in zip(out, (row, k, f"\0{k}", True, len(words) + 1, base, seen, lp), strict=True):
                    c.append(v)
            types = [pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            columns = [pa.array(c, t) for c, t in zip(out, types, strict=True)]
            for at in range(0, len(columns[0]), 100_000):
                part = [c.slice(at, 100_000) for c in columns]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(part[0]), *part[1:]], names=["doc_id", *names[1:]])

    parts = narrow.mapInArrow(run, f"doc_id {id_type}, k bigint, g string, is_doc boolean, n bigint, base double, known double, lp double")
    both = parts.join(rare.select("word", "c", F.col("lp").alias("word_lp")), F.col("g") == F.col("word"), "left")
    c = F.coalesce("c", F.lit(0))
    own = F.col("is_doc")
    sums = both.groupBy("doc_id", "k").agg(
        F.count_if(own).alias("rows"), F.sum(F.when(own, F.col("n"))).alias("n"), F.sum(F.when(own, F.col("base")).otherwise(F.col("n") * F.log10(c + 0.5))).alias("base"),
        F.sum(F.when(own, F.col("known")).otherwise(F.when(c > 0, F.col("n")).otherwise(0))).alias("known"), F.sum(F.when(own, F.col("lp")).otherwise(F.col("n") * F.col("word_lp"))).alias("lp"),
    )
    n = (F.col("n") / F.col("rows")).cast("long")
    scale = math.log10(total + 0.5 * (kinds + 1))
    one = sums.select(
        "doc_id", n.alias("n_tokens"), (F.col("known") / F.col("rows")).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("rows") - n * scale).alias("base_score"), (F.col("lp") / F.col("rows")).alias("score"), F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("copy"),
    )
    return one.drop("copy")


def teaches(id_col: str = "doc_id", fold: int = 1) -> str:
    """SQL condition of the rows that teach: crc32 of the id as text, modulo 5, is not `fold`."""
    return f"pmod(crc32(cast(coalesce(cast({id_col} as string), '') as binary)), 5) != {fold}"
