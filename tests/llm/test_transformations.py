"""Fill-in-middle, suffix deduplication and importance resampling against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from sparkfields.llm import fill_in_middle, importance_resampling, suffix_dedup

EDGE = [None, "", "\n", "\n\n", "a\n", "a\r\nb", "é\nß\n日本\n🎉 x\n", "with <P> inside\n", "no end", "x" * 3000, "é" * 3000 + "\n" + "z"]


def table(spark, texts, ids=None):
    rows = [((ids or range(len(texts)))[k], t) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


# 11. fill in the middle


def arranged(doc_id, text, units):
    text = text or ""
    h = [int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", ["line", "char"])
def test_fill_in_middle_equals_brute_force(spark, unit):
    rng = random.Random(3)
    texts = EDGE + ["".join(rng.choice(["a", "é", "日", "🎉", "\n", " ", "<", ">", "P", "S"]) for _ in range(rng.randrange(60))) for _ in range(300)] + ["lorem é ipsum\n" * 100_000]
    ids = [None, *range(1, len(texts))]
    split = {"line": lambda t: regex.findall(r"[^\n]*\n|[^\n]+", t or ""), "char": lambda t: list(t or "")}[unit]
    made = fill_in_middle.transform(table(spark, texts, ids).withColumn("n", F.lit("own")), unit=unit)
    out = {r.doc_id: r for r in made.withColumn("again", fill_in_middle.restored(F.col("fim.form"), F.col("fim.output"))).collect()}
    for k, text in zip(ids, texts, strict=True):
        f = out[k].fim
        assert (f.n, f.form, f.prefix_chars, f.middle_chars, f.output) == arranged(k, text, split(text)), k
        assert out[k].again == (text or "") and out[k].n == "own" and out[k].text == text
        if f.form != "plain":
            assert f.prefix_bytes == len((text or "")[: f.prefix_chars].encode())
    assert {f.fim.form for f in out.values()} == {"plain", "psm", "spm"}


def test_fill_in_middle_rates(spark):
    rows = table(spark, ["a b c\nd e\nf"] * 400)
    forms = lambda **how: Counter(r.fim.form for r in fill_in_middle.transform(rows, **how).collect())
    assert forms(rate=0) == {"plain": 400} and forms(spm=100) == {"spm": 400} and forms(spm=0) == {"psm": 400} and 150 < forms(rate=50)["plain"] < 250
    assert fill_in_middle.transform(rows.limit(0)).count() == 0


def test_index_converts_both_ways():
    text = "aé日🎉z" * 50
    raw, index = text.encode(), fill_in_middle.Index(np.frombuffer(text.encode(), np.uint8))
    at = np.arange(len(text) + 1)
    want = np.array([len(text[:k].encode()) for k in at])
    assert (index.to_bytes(at) == want).all() and (index.to_chars(want) == at).all() and index.chars == len(text) and len(index.lead) == 150 and len(raw) == want[-1]


# 12. repeated strings


def repeats(rows, length):
    """(removed runs, kept bytes) of each row."""
    first = {}
    for doc_id, text in rows:
        raw, order = (text or "").encode(), math.inf if doc_id is None else doc_id
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            first[s] = min(order, first.get(s, math.inf))
    out = []
    for doc_id, text in rows:
        raw, order = (text or "").encode(), math.inf if doc_id is None else doc_id
        gone = np.zeros(len(raw) + 1, bool)
        for p in range(len(raw) - length + 1):
            if first[raw[p : p + length]] < order:
                gone[p : p + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone]).astype(int)))
        out.append(([(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True)], bytes(np.frombuffer(raw, np.uint8)[~gone[:-1]])))
    return out


def checked(spark, rows, length=50):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = Counter((r.doc_id, r.text, r.repeats.n_bytes, tuple((s.first, s.end) for s in r.repeats.removed), bytes(r.repeats.kept)) for r in suffix_dedup.remove_repeats(docs, length=length).collect())
    want = Counter((i, t, len((t or "").encode()), tuple(spans), kept) for (i, t), (spans, kept) in zip(rows, repeats(rows, length), strict=True))
    assert found == want
    return sum(len(x[3]) for x in found)


def passages(rng, n):
    """Texts that share passages, shorter and longer than 50 bytes, some with a few bytes changed."""
    words = ["lorem", "ipsum", "dolor", "é", "日本", "a", "bb"]
    line = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [line(rng.randrange(3, 40)) for _ in range(8)]
    texts = []
    for _ in range(n):
        t = "".join(rng.choice([line(5), rng.choice(shared), rng.choice(shared)[rng.randrange(9) :]]) for _ in range(rng.randrange(1, 6)))
        if rng.random() < 0.3 and t:
            at = rng.randrange(len(t))
            t = t[:at] + "#" + t[at + 1 :]
        texts.append(t)
    return texts


def test_suffix_dedup_equals_brute_force(spark):
    rng = random.Random(4)
    texts = EDGE + passages(rng, 150)
    ids = [*rng.sample(range(500), len(texts) - 4), 7, 7, None, None]  # ids that come twice
    rows = list(zip(ids, texts, strict=True)) + [(ids[40], texts[40])] * 3 + [(None, texts[50]), (501, None), (502, "x" * 60), (503, "ab" * 40)]
    assert checked(spark, rows) > 60
    checked(spark, rows[:40], length=16)
    checked(spark, rows[:60], length=23)
    assert suffix_dedup.remove_repeats(table(spark, [])).count() == 0


def test_suffix_dedup_across_ranges_and_parts(spark, monkeypatch):
    """Small ranges, parts and groups, so that strings and their leading bytes are cut by splitters."""
    rng = random.Random(5)
    rows = list(enumerate(passages(rng, 120) + ["one passage that all of the later documents have in common, " * 2 + str(k % 7) * 30 for k in range(80)]))
    for name, value in {"CHUNK": 700, "RANGE": 3000, "WINDOWS": 500, "BLOCK": 256, "SAMPLE": 100_000}.items():
        monkeypatch.setattr(suffix_dedup, name, value)
    assert checked(spark, rows) > 100


def test_suffix_dedup_of_very_long_texts(spark):
    rng = random.Random(6)
    word = [f"w{k}" for k in range(5000)]
    long = " ".join(rng.choices(word, k=1_000_000))
    rows = [(2, long), (1, long[3_000_000:3_100_000]), (3, long[-400:] + "!")]
    found = {r.doc_id: [(s.first, s.end) for s in r.repeats.removed] for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found == {1: [], 2: [(3_000_000, 3_100_000)], 3: [(0, 400)]}


def test_multikey_order():
    rng = np.random.default_rng(1)
    words, ids = rng.integers(0, 3, (500, 4)).astype(np.uint64), rng.integers(0, 4, 500)
    order, same = suffix_dedup.multikey(words, ids)
    rows = [(*words[k].tolist(), int(ids[k])) for k in order]
    assert rows == sorted(rows)
    assert all(same[k] == next((j for j in range(4) if rows[k][j] != rows[k - 1][j]), 4) for k in range(1, 500))


# 13. importance resampling


def drawn(rows, items):
    """(n_features, weight, score, rank) of each row, of rows with ids that come once."""
    fold = lambda t: regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", regex.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    def runs(text):
        w = fold(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    found = [runs(t) for _, t in rows]
    s, t = Counter(b for f in found for b in f), Counter(b for i in items for b in runs(i))
    all_s, all_t = s.total() + 10_000, t.total() + 10_000
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t)))
    out, able = {}, []
    for (k, text), f in zip(rows, found, strict=True):
        h = int(hashlib.sha256(f"42:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[k] = [len(f), weight, score, None]
        if len(fold(text)) >= 20:
            able.append((-score, math.inf if k is None else k, k))
    for rank, (*_, k) in enumerate(sorted(able)[: 5 * len(able) // 100], 1):
        out[k][3] = rank
    return {k: tuple(v) for k, v in out.items()}


def test_resampling_equals_brute_force(spark):
    rng = random.Random(8)
    words = [f"W{k}" for k in range(30)] + ["é", "日本", "x-y", "a_b"]
    texts = EDGE + [rng.choice([" ", "\n", ", "]).join(rng.choices(words, k=rng.randrange(60))) for _ in range(300)] + [" ".join(rng.choices(words, k=300_000))]
    ids, items = [None, *range(1, len(texts))], ["W1 W2 W3 w4", None, "", "é W7 " * 30]
    target = spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id bigint, text string")
    docs = table(spark, texts, ids).withColumn("rank", F.lit(1)).withColumn("n_words", F.lit("own"))
    out = {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in importance_resampling.resample(docs, target).collect()}
    assert out == drawn(list(zip(ids, texts, strict=True)), items) and sum(v[3] is not None for v in out.values()) > 5


def test_resampling_of_repeated_rows_and_nothing(spark):
    target = spark.createDataFrame([("a b c",)], "text string")
    same = " ".join(["a b c d"] * 10)
    rows = [(1, same)] * 2500 + [(2, "other words " * 20)] * 100 + [(None, None)] * 5
    got = importance_resampling.resample(spark.createDataFrame(rows, "doc_id bigint, text string"), target, percent=50)
    ranks = sorted((r["rank"], r.doc_id) for r in got.where("rank is not null").collect())
    assert got.count() == 2605 and [k for k, _ in ranks] == list(range(1, 1301)) and [i for _, i in ranks] == [2] * 100 + [1] * 1200
    assert importance_resampling.resample(table(spark, []), target).count() == 0
    assert importance_resampling.resample(table(spark, [same] * 40), target.limit(0)).where("rank is not null").count() == 2


def test_parts_of_long_texts_keep_all_runs(monkeypatch):
    text = ("ab é, cd--" * 40 + "x" * 90 + " y z").encode()
    n, whole = importance_resampling.features(text)
    monkeypatch.setattr(importance_resampling, "PART_BYTES", 7)
    m, parts = importance_resampling.features(text)
    assert n == m and sorted(whole.tolist()) == sorted(parts.tolist()) and len(whole) == 3 * n - 3
