"""Rule tables of words: all words of all labels are found in one pass over each text."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classify

#: Bytes of words of one automaton; more words are dealt by label to several, with a pass for each.
LIMIT = 16 << 20
#: Texts that are Python objects at once.
ROWS = 500


def rule_rows(spark: SparkSession, rules: dict[str, list[tuple[str, float]]]) -> DataFrame:
    """(label, seq, word, weight) of rules that are given as literals, in their order."""
    rows = [(label, seq, word, float(w)) for seq, (label, word, w) in enumerate((n, w, x) for n, words in rules.items() for w, x in words)]
    return spark.createDataFrame(rows, "label string, seq bigint, word string, weight double")


def keyword_scores(df: DataFrame, rules: DataFrame, text_col: str, into: str = "scores", always: list[str] | None = None) -> DataFrame:
    """df with a map `into` of label to (score, seq): the weights of the label's words that a text contains, and its first seq.

    rules has label, seq, word and weight. A word counts once however often it
    comes, also inside other words; weights are added in order of seq, so a score
    is the same number wherever it is computed. Labels without a found word are
    left out, but for those in `always`, which are in the rules. Words of null
    label and empty words are no rules; null text contains nothing; a column
    `into` is replaced. The words come to the driver by parts of LIMIT bytes, a
    label in one part, and are sent to the tasks.
    """
    rules = rules.where("label is not null and word <> ''")
    total = rules.agg(F.sum(F.octet_length("word"))).first()[0] or 0
    parts = max(1, -(-total // LIMIT))
    out = df.drop(into)
    columns = []
    for part in range(parts):
        mine = rules if parts == 1 else rules.where(F.pmod(F.xxhash64("label"), F.lit(parts)) == part)
        held = mine.select("label", "seq", "word", "weight").orderBy("seq", "label", "word").toArrow()
        columns.append(column := into if parts == 1 else f"{into}_{part}")
        out = _pass(out, held, text_col, column, always or [])
    if parts > 1:
        out = out.withColumn(into, F.map_concat(*columns)).drop(*columns)
    return out


def automaton(words: pa.ChunkedArray) -> tuple[ahocorasick.Automaton, dict[int, list[int]]]:
    """Finds each word as its first place in words; for words that come again, all places by the first.

    A word costs its letters and one number, as no list, tuple or text of it is
    kept as a Python object.
    """
    found, more = ahocorasick.Automaton(ahocorasick.STORE_INTS), {}
    at = 0
    for chunk in words.chunks:
        for start in range(0, len(chunk), ROWS):
            for word in chunk.slice(start, ROWS).to_pylist():
                if (before := found.get(word, -1)) < 0:
                    found.add_word(word, at)
                else:
                    more.setdefault(before, [before]).append(at)
                at += 1
    if at:
        found.make_automaton()
    return found, more


def _pass(df: DataFrame, held: pa.Table, text_col: str, into: str, always: list[str]) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(held)
    first = dict(zip(*held.group_by("label").aggregate([("seq", "min")]).select(["label", "seq_min"]).to_pydict().values(), strict=True))
    zero = [x for x in always if x in first]
    kind = pa.map_(pa.string(), pa.struct([("score", pa.float64()), ("seq", pa.int64())]))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"`{into}` map<string,struct<score:double,seq:bigint>>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = shared.value
        words, more = automaton(rules["word"])
        labels = rules["label"].combine_chunks().dictionary_encode() if rules.num_rows else None
        names, codes = (labels.dictionary.to_pylist(), labels.indices.to_numpy()) if labels is not None else ([], [])
        weights = rules["weight"].to_numpy()

        def score(text: str | None) -> list[tuple[str, dict]]:
            scores = dict.fromkeys(zero, 0.0)
            for k in sorted({k for _, f in words.iter(text) for k in more.get(f, (f,))}) if text and len(codes) else ():
                label = names[codes[k]]
                scores[label] = scores.get(label, 0.0) + float(weights[k])
            return [(label, {"score": s, "seq": first[label]}) for label, s in scores.items()]

        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                texts = batch.column(batch.schema.names.index(text_col)).to_pylist()
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([score(t) for t in texts], kind)], names=[*batch.schema.names, into])

    return df.mapInArrow(run, schema)


def layout_by_table(df: DataFrame, rules: DataFrame, text_col: str = "raw_text", patterns: dict[str, tuple[str, float, float]] | None = None) -> DataFrame:
    """df with layout, confidence, requires_human_validation, as classify.layout_classify gives them, by a table of rules.

    patterns: for some labels a pattern, what it adds, and the most that such a
    label's score can be; by default that of the access key.
    """
    patterns = {"nota_fiscal": (classify.ACCESS_KEY, classify.ACCESS_KEY_WEIGHT, 0.99)} if patterns is None else patterns
    rows = df.withColumn("_low", F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"\s+", " ")))
    rows = keyword_scores(rows, rules, "_low", "_scores", list(patterns))
    for k, (pattern, _, _) in enumerate(patterns.values()):
        rows = rows.withColumn(f"_p{k}", F.col("_low").rlike(pattern))

    def scored(e: Column) -> Column:
        score = e["value"]["score"]
        for k, (label, (_, adds, most)) in enumerate(patterns.items()):
            score = F.when(e["key"] == label, F.least(F.lit(most), e["value"]["score"] + F.when(F.col(f"_p{k}"), adds).otherwise(0.0))).otherwise(score)
        return F.struct(score.alias("score"), (-e["value"]["seq"]).alias("order"), e["key"].alias("name"))

    rows = rows.withColumn("_best", F.array_max(F.transform(F.map_entries("_scores"), scored)))
    generic = F.coalesce(F.col("_best.score") < classify.LEAST, F.lit(True))
    raw = F.when(generic, F.when(F.col("_low") == "", 0.0).otherwise(classify.GENERIC)).otherwise(F.least(F.lit(0.99), F.col("_best.score")))
    rows = rows.withColumn("layout", F.when(generic, "generic").otherwise(F.col("_best.name"))).withColumn("_raw", raw)
    rows = rows.withColumn("confidence", F.round("_raw", 2)).withColumn("requires_human_validation", F.col("_raw") < classify.REVIEW)
    return rows.drop("_low", "_scores", "_best", "_raw", *[f"_p{k}" for k in range(len(patterns))])


def counts_by_table(df: DataFrame, rules: DataFrame, text_col: str = "raw_text", into: str = "counts") -> DataFrame:
    """df with a map `into` of label to how many of its words the lower-case text contains; labels without one are left out."""
    rows = keyword_scores(df.withColumn("_low", F.lower(F.coalesce(F.col(text_col), F.lit("")))), rules.withColumn("weight", F.lit(1.0)), "_low", into)
    return rows.withColumn(into, F.transform_values(into, lambda _, v: v["score"].cast("int"))).drop("_low")
