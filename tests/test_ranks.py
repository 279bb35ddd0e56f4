"""Exact ranks, amounts by context and loops against plain Python."""

from __future__ import annotations

import random
import re
import time

from pyspark.sql import functions as F

from sparkfields.operators import context, events
from sparkfields.operators.pages import cut_loops


def test_exact_ranks(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1.5, rng.random(), None, float(rng.randrange(5))])) for _ in range(900)] + [("one", 3.0), ("none", None)]
    n = F.col("n")
    ranks = {"first": F.lit(0), "low": F.floor((n - 1) / 2), "high": F.floor(n / 2), "last": n - 1}
    for ranges in (2, 7, 256):
        out = {r.s: (r.first, r.low, r.high, r.last) for r in events.exact_ranks(spark.createDataFrame(rows, "s string, v double"), "s", "v", ranks, ranges).collect()}
        want = {}
        for g in {s for s, _ in rows} - {"none"}:
            v = sorted(v for s, v in rows if s == g and v is not None)
            want[g] = (v[0], v[(len(v) - 1) // 2], v[len(v) // 2], v[-1])
        assert out == want
    assert events.exact_ranks(spark.createDataFrame([], "s string, v double"), "s", "v", ranks).count() == 0


def amounts(text, good, bad, reach):
    """(at, value, distance, avoided) of each amount, best first."""
    low = (text or "").lower()
    word = lambda words: "|".join(map(re.escape, sorted(words, key=lambda w: (-len(w), w)))) or "(?!)"
    found = [(m.start(), m.end(), m.lastindex) for m in re.finditer(f"({context.AMOUNT})|({word(good)})|({word(bad)})", low)]
    gap = lambda a, b: a[0] - b[1] if b[1] <= a[0] else b[0] - a[1]
    out = []
    for a in (f for f in found if f[2] == 1):
        d, e = (min((gap(a, f) for f in found if f[2] == kind and gap(a, f) <= reach), default=None) for kind in (2, 3))
        out.append((a[0], low[a[0] : a[1]], d, e is not None and (d is None or e < d)))
    return sorted(out, key=lambda x: (x[3], x[2] is None, x[2] or 0, x[0]))


def test_amounts_by_context(spark):
    rng = random.Random(3)
    parts = ["total de receitas", "total", "saldo", "1.234,56", "7,90", "12,345", "99.999,00", "linha digitavel", "\n", "  ", "x" * 9, "Total", ": R$ ", "0,10"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(25))) for _ in range(300)] + [None, "", "1,00 " * 500 + "total", "x" * 20_000 + "total 5,00"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, raw_text string")
    good, bad = ["Total", "linha digitavel"], ["total de receitas", "saldo"]
    for reach in (15, 120):
        got = {}
        for r in context.ranked_amounts(df, good, bad, reach=reach).orderBy("doc_id", "rank").collect():
            got.setdefault(r.doc_id, []).append((r.at, r.value, r.distance, r.avoided))
        want = {k: w for k, t in enumerate(texts) if (w := amounts(t, [g.lower() for g in good], bad, reach))}
        assert got == want
    assert context.ranked_amounts(df.limit(0), good, bad).count() == 0 and context.ranked_amounts(df, [], []).where("distance is not null or avoided").count() == 0


def test_loops_in_very_long_texts():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefgh", k=8)) for _ in range(2000)]
    long = " ".join(rng.choices(words, k=300_000))
    began = time.time()
    assert cut_loops(long) == long and cut_loops(long + long) == long + long and cut_loops(long * 3) == long
    assert cut_loops(long + "one phrase of words, " * 5 + long) == long + "one phrase of words"
    assert cut_loops("ab" * 1_000_000) == "ab" * 8 and time.time() - began < 120


def test_loops_equal_brute_force():
    rng, cut = random.Random(1), 0
    for _ in range(1500):
        alphabet, least = rng.choice(["ab", "abc", "a", "abé日"]), rng.choice([2, 3, 5])
        text = "".join("".join(rng.choices(alphabet, k=rng.randrange(1, 12))) * rng.choice([1, 1, 2, 3, 4]) for _ in range(rng.randrange(6)))
        want = next((text[: i + s].rstrip(", \n") for s in range(least, len(text) // 3 + 1) for i in range(len(text) - 3 * s + 1) if text[i : i + s] == text[i + s : i + 2 * s] == text[i + 2 * s : i + 3 * s]), text)
        cut += want != text
        assert cut_loops(text, least) == want
    assert cut > 300


def test_words_of_a_table(spark, monkeypatch):
    from sparkfields.operators import classify, keywords

    rng = random.Random(5)
    words = ["".join(rng.choices("abc ", k=rng.randrange(1, 6))) for _ in range(120)]
    rules = [(f"l{k % 7}", k, w, round(rng.random(), 2)) for k, w in enumerate(words)] + [(None, 500, "a", 1.0), ("l1", 501, "", 1.0), ("l1", 502, None, 1.0)]
    texts = ["".join(rng.choices("abc ", k=rng.randrange(40))) for _ in range(100)] + [None, "", "abc" * 30_000]
    df = spark.createDataFrame([(k, t, "own") for k, t in enumerate(texts)], "k int, t string, scores string")
    table = spark.createDataFrame(rules, "label string, seq bigint, word string, weight double").repartition(3)
    for limit in (16 << 20, 100):  # the second deals the labels to several passes
        monkeypatch.setattr(keywords, "LIMIT", limit)
        for r in keywords.keyword_scores(df, table, "t", always=["l3"]).collect():
            want = {"l3": 0.0}
            for label, _, w, x in rules:
                if label and w and w in (texts[r.k] or ""):
                    want[label] = want.get(label, 0.0) + x
            assert {n: v.score for n, v in r.scores.items()} == want
    assert keywords.keyword_scores(df, table.limit(0), "t").where("size(scores) > 0").count() == 0
    one = spark.createDataFrame([(k, t) for k, t in enumerate(["Nota Fiscal NF-e chave de acesso " + "1" * 44, "boleto bradesco 237 vencimento", "", None, "104 001"])], "k int, raw_text string")
    both = [{tuple(r) for r in f.select("k", "layout", "confidence", "requires_human_validation").collect()} for f in (classify.layout_classify(one), keywords.layout_by_table(one, keywords.rule_rows(spark, classify.LAYOUTS)))]
    assert both[0] == both[1]


def test_an_automaton_keeps_numbers_and_no_objects_of_its_words():
    import ahocorasick
    import pyarrow as pa

    from sparkfields.operators import keywords

    found, more = keywords.automaton(pa.chunked_array([["ab", "b"], ["ab", "abc"]]))
    assert found.store == ahocorasick.STORE_INTS and more == {0: [0, 2]}
    assert sorted(k for _, f in found.iter("xabc") for k in more.get(f, (f,))) == [0, 1, 2, 3]
    assert keywords.automaton(pa.chunked_array([], pa.string()))[1] == {}
