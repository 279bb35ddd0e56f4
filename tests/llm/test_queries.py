"""The registered corpus queries and the pipeline over small tables."""

from __future__ import annotations

import random
from collections import Counter

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def write(spark, at, texts):
    rows = [(k, t, ("en", "fr")[k % 2], f"src{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(0, "the quick brown fox jumps over the lazy dog again and again")], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([], "page_id bigint, url string, html string").write.parquet(f"{at}/pages.parquet")


def names():
    return [n for n in entry.queries() if n.startswith("op")]


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in names()) == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("texts", [[], [None, "", " ", "a", *["same words all over here now"] * 5]])
def test_queries_over_edge_tables(spark, tmp_path, texts):
    write(spark, tmp_path, texts)
    for name in [*names(), "pipeline"]:
        rows = entry.queries()[name](spark, str(tmp_path)).collect()
        assert name in ("op5_url_filter", "op8_html_extraction", "pipeline") or len(rows) == len(texts), name


def test_pipeline_equals_its_rules(spark, tmp_path):
    rng = random.Random(1)
    words = {0: ["bala", "lamba", "galaba", "daba"], 1: ["xixo", "voxu", "zuxiv", "kixu"]}
    texts = [" ".join(rng.choices(words[k % 2], k=60)) for k in range(60)]
    texts += [texts[3], texts[3], None, "123", texts[4] + " the quick brown fox jumps over the lazy dog again and again"]
    write(spark, tmp_path, texts)
    out = Counter(r.doc_id for r in entry.queries()["pipeline"](spark, str(tmp_path)).collect())
    assert not set(out) & {60, 61, 62, 63, 64} and max(out.values()) <= 3
    sizes = Counter(r.shard for r in entry.queries()["pipeline"](spark, str(tmp_path)).collect())
    assert max(sizes.values()) - min(sizes.values()) <= 1


def test_held_out_accuracy(spark):
    from sparkfields.llm.common import table

    rows = entry.queries()["op3_language_id"](spark, SMALL).where("held_out").join(table(spark, SMALL, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95
