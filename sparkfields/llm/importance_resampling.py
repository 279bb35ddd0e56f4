"""Target-distribution importance resampling over hashed word runs.

Words and their offsets come from an untrained pre-tokeniser; runs of one to
three of them are counted in CRC buckets of the corpus and of a target. A
bucket's gain is the log ratio of its shares, a document's weight the sum of its
gains, and with Gumbel noise the highest scores are a draw without replacement.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import PreTokenizedString, Regex
from tokenizers.pre_tokenizers import Split

from .common import cut, sized, stored

BUCKETS = 10_000
RUN = 3
SEED, LEAST_WORDS, PERCENT = 42, 20, 5
#: Longer texts are tokenised in parts of about so many bytes; equal rows that a task writes out at once.
PART_BYTES, PART = 1 << 20, 1000

_SPLIT = Split(Regex(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), behavior="removed", invert=True)
_BREAK = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
_LOWER = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b for b in range(256))


def _parts(raw: bytes) -> Iterator[bytes]:
    """The text in parts that end at a byte that no word has."""
    at = 0
    while at < len(raw):
        found = _BREAK.search(raw, at + PART_BYTES)
        end = found.end() if found else len(raw)
        yield raw[at:end]
        at = end


def words(part: bytes) -> list[tuple[int, int]]:
    """Byte offsets of the words of a lowered text."""
    text = PreTokenizedString(part.decode("utf-8", "replace"))
    _SPLIT.pre_tokenize(text)
    return [piece[1] for piece in text.get_splits("original", "byte")]


def features(text: bytes) -> tuple[int, np.ndarray]:
    """(words, buckets of all runs of 1 to RUN words) of a whole text."""
    n, kept, found = 0, [], []
    for part in _parts(text.translate(_LOWER)):
        new = [part[a:b] for a, b in words(part)]
        n += len(new)
        every, held = kept + new, len(kept)
        spaced = [b" " + w for w in every]
        sums = list(map(zlib.crc32, every))
        for k in range(RUN):  # sums[i] is that of the k + 1 words from i on; those that end in this part are new
            if k:
                sums = list(map(zlib.crc32, spaced[k:], sums))
            found.append(np.array(sums[max(0, held - k) :], np.uint32) % BUCKETS)
        kept = every[1 - RUN :]
    return n, np.concatenate(found) if found else np.zeros(0, np.uint32)


def _packed(buckets: np.ndarray) -> bytes:
    """Sorted buckets as their gaps, which compress well."""
    return np.diff(np.sort(buckets).astype(np.uint16), prepend=np.uint16(0)).tobytes()


def _unpacked(gaps: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(gaps, np.uint16), dtype=np.int64)


def count_features(docs: DataFrame, text_col: str) -> DataFrame:
    """(the other columns of docs, n_words, gaps)."""
    others = [f for f in docs.schema.fields if f.name != text_col]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "n_words bigint", "gaps binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches, text_col, rows=1000):
            made = [features(t or b"") for t in batch.column(batch.schema.names.index(text_col)).cast(pa.binary()).to_pylist()]
            columns = [batch.column(k) for k, n in enumerate(batch.schema.names) if n != text_col]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array([n for n, _ in made], pa.int64()), pa.array([_packed(b) for _, b in made], pa.binary())],
                names=[*(f.name for f in others), "n_words", "gaps"],
            )

    return docs.mapInArrow(run, schema)


def histogram(counted: DataFrame) -> DataFrame:
    """(bucket, n): at most BUCKETS rows from each task are added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for gaps in batch.column(0).to_pylist():
                np.add.at(total, _unpacked(gaps), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    return counted.select("gaps").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame) -> np.ndarray:
    """A whole number for each bucket; BUCKETS rows come to the driver."""
    both = corpus.select("bucket", F.col("n").alias("s")).join(target.select("bucket", F.col("n").alias("t")), "bucket", "full")
    s, t = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for bucket, of_corpus, of_target in both.collect():
        s[bucket], t[bucket] = of_corpus or 0, of_target or 0
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def _weigh(counted: DataFrame, gain: np.ndarray) -> DataFrame:
    """counted with the sum of the gains, `weight`, in place of gaps."""
    kept = [f for f in counted.schema.fields if f.name != "gaps"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            weights = [int(gain[_unpacked(g)].sum()) for g in batch.column(names.index("gaps")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(f.name)) for f in kept), pa.array(weights, pa.int64())], names=[*(f.name for f in kept), "weight"])

    return counted.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "weight bigint"]))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise times 1000, rounded down, from a hash of seed and id; a null id counts as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def _ranks(kinds: DataFrame) -> DataFrame:
    """kinds with `before`, the rows of all kinds of higher rank: ranges of scores, their sizes summed up, and an order inside each."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_words").asc()]
    ranges = stored(kinds.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    sizes = ranges.groupBy("range").agg(F.sum("n").alias("size"))
    # a row for each range
    bases = sizes.select(F.col("range").alias("of"), (F.sum("size").over(Window.orderBy("range")) - F.col("size")).alias("base"))
    inside = F.sum("n").over(Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return ranges.withColumn("inside", inside).join(F.broadcast(bases), F.col("range") == F.col("of")).withColumn("before", F.col("base") + F.col("inside")).drop("range", "of", "base", "inside")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank), one row for each row of docs.

    Of the documents with at least least_words words, percent in 100 with the
    highest scores have a rank; ties go to the smaller id, a null id is the last.
    Null and empty texts have no features and weight 0; texts of any length are
    counted whole; rows alike in id, words and weight are counted first and have
    ranks of their own; other columns are not read; an empty target gives gains
    of how rare a bucket is; no rows give no rows. Buckets are counted over all
    of docs and target; a table of BUCKETS whole numbers is sent to the tasks.
    """
    body = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counted = stored(count_features(body, "text"))
    wanted = count_features(target.select(F.col(target_text_col).cast("string").alias("text")), "text")
    rows = _weigh(counted, gains(histogram(counted), histogram(wanted)))
    kinds = cut(rows.groupBy("doc_id", "n_words", "weight").agg(F.count("*").alias("n")))
    n = F.col("n_words")
    runs = sum((F.greatest(n - k, F.lit(0)) for k in range(1, RUN)), n)
    kinds = kinds.withColumn("n_features", runs.cast("long")).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    able = kinds.where(n >= least_words)
    drawn = (able.agg(F.sum("n")).first()[0] or 0) * percent // 100
    every = _ranks(able).unionByName(kinds.where(n < least_words).withColumn("before", F.lit(None).cast("long")))
    # large kinds are spread again before they are written out row by row
    many = every.where("n > 1").withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(PART).cast("long")))).repartition(F.col("doc_id"), F.col("from"))
    many = many.withColumn("k", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + PART, F.col("n")) - 1))).drop("from")
    every = every.where("n = 1").withColumn("k", F.lit(0).cast("long")).unionByName(many)
    rank = F.col("before") + F.col("k") + 1
    return every.select("doc_id", "n_words", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))
