"""Every operator over a table whose other columns have the names that operators use inside."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sparkfields.llm import decontamination, fill_in_middle, fingerprints, html_extraction, importance_resampling, language_id, lattice_lm, line_dedup, mixing, sharding, shingle_join, simhash_dedup, suffix_dedup, url_filter

NAMES = (
    "_id _key _n _row _k _gone _gone_k block w0 w1 _block _language _hits row name of group head n rows whole more key h g c u v x r sim par size k pos gone own cell rank "
    "oid b late before hits language hit best listed page shared at word lp is_doc base known trains ident map w least root lo hi i j fp component_id copies part p sure "
    "copy id range gaps n_features weight score n_words taken target source_size slot shard text_crc32 k2 want _want _is"
).split()
WORDS = [f"w{k}" for k in range(40)]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(2)
    line = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    texts = [line(60) for _ in range(6)] + ["a shared line of words\n" + line(30) for _ in range(4)] + [None, ""]
    rows = [(k, t, "en", f"s{k % 2}", f"http://h.com/{k}", f"<p>{t}</p>") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, url string, html string")
    return docs.select("*", *[(F.col("doc_id") * 100 + k).alias(n) for k, n in enumerate(NAMES)]).cache()


def with_own(found):
    """Whether each row has the values that its id gave its other columns."""
    return all(r[n] == r.doc_id * 100 + k for r in found.collect() for k, n in enumerate(NAMES))


def benchmark(spark):
    return spark.createDataFrame([(1, "zz yy xx")], "item_id bigint, text string")


def model(docs):
    return language_id.train(docs.select("text", "lang"))


KEEP = {
    "keep_one": lambda s, t: simhash_dedup.keep_one(t), "repeat": lambda s, t: mixing.repeat(t), "dedup_lines": lambda s, t: line_dedup.dedup_lines(t),
    "clean": lambda s, t: decontamination.clean(t, benchmark(s)), "keep_known": lambda s, t: language_id.keep_known(t, model(t), 0.5),
    "mark": lambda s, t: decontamination.mark(t, benchmark(s), into="found"), "identify": lambda s, t: language_id.identify(t, model(t), into="found"),
    "transform": lambda s, t: fill_in_middle.transform(t), "remove_repeats": lambda s, t: suffix_dedup.remove_repeats(t),
}


@pytest.mark.parametrize("name", sorted(KEEP))
def test_other_columns_come_back(spark, table, name):
    out = KEEP[name](spark, table)
    assert set(table.columns) <= set(out.columns) and out.count() > 0 and with_own(out)


def vocabulary():
    import public_tokenizers

    return lattice_lm.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))


READ = {
    "near_groups": lambda s, t: simhash_dedup.near_groups(t), "compare_next": lambda s, t: fingerprints.compare_next(t), "place": lambda s, t: sharding.place(t), "mix": lambda s, t: mixing.mix(t),
    "judge": lambda s, t: url_filter.judge(t, url_filter.entries(s, [("com", "/", "block")]), t.select("key").withColumn("key", F.lit("h.com/1")), id_col="doc_id"),
    "extract": lambda s, t: html_extraction.extract(t, id_col="doc_id"), "score": lambda s, t: lattice_lm.score(t, lattice_lm.teaches(), vocabulary()),
    "resample": lambda s, t: importance_resampling.resample(t, benchmark(s)),
    "groups": lambda s, t: shingle_join.groups(t.select(F.col("doc_id").alias("ident"), "text")),
}


@pytest.mark.parametrize("name", sorted(READ))
def test_a_row_for_each_row(spark, table, name):
    assert READ[name](spark, table).count() == table.count()
