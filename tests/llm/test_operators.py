"""The corpus operators against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import itertools
import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from sparkfields.llm import components, decontamination, fingerprints, html_extraction, language_id, lattice_lm, line_dedup, mixing, sharding, shingle_join, simhash_dedup, url_filter

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp bigint, u bigint"


def docs(spark, texts, **more):
    rows = [(k, t, "en", f"s{k % 3}" if k % 4 else None, len(t or ""), 1, 2) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


WORDS = [f"w{k}" for k in range(40)]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


EDGE = [None, "", "  \n ", "one", "Héllo wörld", "same text of five words here", "same text of five words here", "日本語 テキスト", "x" * 3000]


# 1. decontamination


def brute_hits(text, items, size=10):
    fold = lambda t: regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", regex.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, found = fold(text), set(), set()
    for item, t in items:
        w = fold(t)
        n = min(size, len(w))
        for s in range(len(w) - n + 1) if n else ():
            for at in range(len(words) - n + 1):
                if words[at : at + n] == w[s : s + n]:
                    hit.update(range(at, at + n))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(1)
    items = [(k, sentence(rng, n)) for k, n in enumerate([3, 1, 12, 25, 10, 9, 30])] + [(7, None), (8, "--"), (2, "again " + sentence(rng, 11))]
    texts = EDGE + [sentence(rng, 5) + "! " + items[k % 7][1].upper() + ", " + sentence(rng, 4) for k in range(20)] + [items[3][1][: 60 + k] for k in range(9)]
    out = {r.doc_id: r for r in decontamination.mark(docs(spark, texts), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    for k, t in enumerate(texts):
        n, hit, found = brute_hits(t, items)
        h = out[k].hits
        assert (h.n_words, sum(s.end - s.first for s in h.spans), sorted(set(h["items"]))) == (n, hit, found)


def test_decontamination_in_blocks_is_the_same(spark, monkeypatch):
    rng = random.Random(2)
    items = spark.createDataFrame([(k, sentence(rng, 14)) for k in range(12)], "item_id bigint, text string")
    texts = [sentence(rng, 3) + " " + r.text for r in items.collect()]
    whole = sorted(map(str, decontamination.mark(docs(spark, texts), items).collect()))
    monkeypatch.setattr(decontamination, "BLOCK", 100)
    assert sorted(map(str, decontamination.mark(docs(spark, texts), items).collect())) == whole


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert [r.hits.spans for r in decontamination.mark(docs(spark, EDGE), none).collect()] == [[]] * len(EDGE)
    assert decontamination.clean(docs(spark, []), none).count() == 0


# 2. fingerprints


def test_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET", 4)
    rng = random.Random(3)
    texts = EDGE + ["\n".join(sentence(rng, 9) for _ in range(rng.randrange(1, 30))) for _ in range(25)]
    out = fingerprints.compare_next(docs(spark, texts)).collect()
    assert len(out) == len(texts)
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    sets = lambda t: set(fingerprints.paragraphs(t).tolist())
    prints = {}
    for r in out:
        a, b = texts[r.doc_id] or "", texts[(r.doc_id + 1) % len(texts)] or ""
        q = len(a) // 4
        e = a[: len(a) - q] + b[:q]
        assert (r.n_chars, r.edited_sha256) == (len(a), hashlib.sha256(e.encode()).hexdigest())
        assert r.near_edited == pytest.approx(like(sets(a), sets(e))) and r.near_next == pytest.approx(like(sets(a), sets(b)))
        assert prints.setdefault(a, r.fingerprint) == r.fingerprint


def test_fingerprints_of_skewed_ids_and_very_long_texts(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET", 4)
    rng = random.Random(4)
    text = lambda: sentence(rng, 20)
    rows = [(None, text()) for _ in range(15)] + [(7, text()) for _ in range(15)] + [(10**15 * k, text()) for k in range(-2, 4)] + [(8, sentence(rng, 80_000))]
    signed = lambda t: (h := xxhash.xxh64_intdigest(t, 42)) - (1 << 64) * (h >> 63)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1])))
    want = set()
    for (i, a), (_, b) in zip(order, order[1:] + order[:1], strict=True):
        q = len(a) // 4
        want.add((i, len(a), hashlib.sha256((a[: len(a) - q] + b[:q]).encode()).hexdigest()))
    assert {(r.doc_id, r.n_chars, r.edited_sha256) for r in fingerprints.compare_next(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()} == want


def test_fingerprints_of_null_and_repeated_ids(spark):
    rows = spark.createDataFrame([(None, "a"), (5, "b"), (5, "b"), (9, None)], "doc_id bigint, text string")
    assert fingerprints.compare_next(rows).count() == 4
    assert fingerprints.compare_next(rows.where("doc_id = 9")).first().near_next == 1.0
    assert fingerprints.compare_next(rows.limit(0)).count() == 0


def test_peeling_gives_the_difference():
    rng = np.random.default_rng(4)
    a, b = rng.integers(1, 1 << 63, 40).astype(np.uint64), rng.integers(1, 1 << 63, 6).astype(np.uint64)
    other = np.concatenate([a[:35], b])
    whole, owner, keys, sign = fingerprints.sketch([a], 30).minus(fingerprints.sketch([other], 30)).peel()
    assert whole.all() and set(keys[sign > 0]) == set(a[35:]) and set(keys[sign < 0]) == set(b)
    assert not fingerprints.sketch([a], 4).minus(fingerprints.sketch([b], 4)).peel()[0].all()


# 3. language identification


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(5)
    for _ in range(60):
        lens = rng.integers(0, 6, 4)
        first, scores = np.concatenate([[0], np.cumsum(lens)]), rng.normal(size=(lens.sum(), 3))
        path = language_id.viterbi(scores, first, 1.2)
        for k in range(4):
            s, p = scores[first[k] : first[k + 1]], path[first[k] : first[k + 1]]
            cost = lambda q: sum(s[i][q[i]] for i in range(len(s))) - 1.2 * sum(a != b for a, b in zip(q, q[1:]))
            if len(s):
                assert cost(p) == pytest.approx(max(map(cost, itertools.product(range(3), repeat=len(s)))))


def test_language_id(spark):
    rng = random.Random(6)
    words = {"aa": ["bala", "lamba", "galaba"], "bb": ["xixo", "voxu", "zuxiv"], "gr": ["λόγος", "και", "φως"]}
    rows = [(k, " ".join(rng.choices(words[g], k=20)), g) for k, g in enumerate(["aa", "bb", "gr"] * 20)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    ask = [None, "", "123 !", "bala galaba lamba", "φως 1 λόγος", "bala lamba bala galaba xixo voxu zuxiv xixo voxu xixo"]
    found = {r.doc_id: r.language for r in language_id.identify(docs(spark, ask), model).collect()}
    assert [found[k].lang for k in range(5)] == ["und", "und", "und", "aa", "gr"]
    assert [(s.lang, s.first, s.end) for s in found[5].spans] == [("aa", 0, 4), ("bb", 4, 10)]
    nothing = language_id.train(spark.createDataFrame([], "text string, lang string"))
    assert {r.language.lang for r in language_id.identify(docs(spark, ask), nothing).collect()} == {"und"}


# 4. lines


def test_line_dedup(spark):
    rng = random.Random(7)
    base = [sentence(rng, 30) for _ in range(12)]
    texts = EDGE + ["\n".join([rng.choice(base), sentence(rng, 3), rng.choice(base) + rng.choice(["", "!", " w1"]), sentence(rng, 12), rng.choice(["* * *", "Page 1", "page 1.", "w3", sentence(rng, 200)])]) for _ in range(30)]
    norm = lambda x: regex.sub(r"[^\p{L}\p{N}]+", " ", x.lower()).strip(" ")
    lines = [(k, p, norm(x)) for k, t in enumerate(texts) for p, x in enumerate((t or "").split("\n")) if norm(x)]

    def sim(n):
        w = n.split(" ")
        c = sum(np.array([xxhash.xxh64_intdigest(x, 42) >> b & 1 for b in range(64)]) for x in w)
        return sum(1 << b for b in range(64) if 2 * c[b] > len(w))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            old, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    kinds = sorted({n for *_, n in lines})
    sims, group = [sim(n) for n in kinds], list(range(len(kinds)))
    for i, j in itertools.combinations(range(len(kinds)), 2):
        if (sims[i] ^ sims[j]).bit_count() <= 3 and distance(kinds[i], kinds[j]) <= int(0.2 * max(len(kinds[i]), len(kinds[j])) + 1e-9):
            group = [group[i] if g == group[j] else g for g in group]
    places = defaultdict(list)
    for k, p, n in lines:
        places[group[kinds.index(n)]].append((k, p))
    gone = {x for v in places.values() for x in v if x != min(v)}
    out = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    for k, t in enumerate(texts):
        want = None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (k, p) not in gone)
        assert out[k].text == want
        assert out[k].lines == (0 if t is None else len(t.split("\n")))
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


def test_line_dedup_of_long_lines_and_repeated_rows(spark):
    long = " ".join(f"a{k % 97}" for k in range(70_000))
    rows = spark.createDataFrame([(1, long), (2, long), (2, long), (3, "tiny"), (None, "p q r s t u v")], "doc_id bigint, text string")
    out = sorted((r.doc_id or 0, len(r.text), r.lines_kept) for r in line_dedup.dedup_lines(rows).collect())
    assert out == [(0, 13, 1), (1, len(long), 1), (2, 0, 0), (2, 0, 0), (3, 4, 1)]


def test_close_pairs_equal_brute_force_and_spare_components(spark):
    """All pairs of different components, whichever is the largest under a key; none of a component, however large."""
    rng = random.Random(5)
    base = [rng.getrandbits(63) for _ in range(3)]
    sims = [rng.choice(base) ^ sum(1 << b for b in rng.sample(range(63), rng.choice([0, 1, 2]))) for _ in range(120)]
    rows = [(c, sim, 0, 100 + c % 7, rng.choice([c, 0, 1, 2])) for c, sim in enumerate(sims)]
    schema = "c bigint, sim bigint, par bigint, size int, r bigint"
    got = [(x.u, x.v) for x in line_dedup.close_pairs(spark.createDataFrame(rows, schema)).collect()]
    want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if (a[1] ^ b[1]).bit_count() <= 3 and a[4] != b[4]}
    assert len(got) == len(set(got)) and set(got) == want and want
    one = spark.range(40_000).selectExpr("id c", "5L sim", "0L par", "100 size", "0L r")
    assert line_dedup.close_pairs(one).isEmpty()
    other = one.unionByName(spark.createDataFrame([(40_000, 5, 0, 100, 1)], schema))
    assert line_dedup.close_pairs(other).agg({"u": "count", "v": "min"}).first()[:] == (40_000, 40_000)


def test_close_pairs_meet_from_compressed_files(spark):
    """The table of all keys is several times the lines: as a checkpoint, which isn't compressed, it took the most disk."""
    rows = spark.createDataFrame([(0, 5, 0, 100, 0), (1, 5, 0, 100, 1)], "c bigint, sim bigint, par bigint, size int, r bigint")
    pairs = line_dedup.close_pairs(rows)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "ExistingRDD" not in plan
    assert [(x.u, x.v) for x in pairs.collect()] == [(0, 1)]


def test_long_lines_with_many_changed_words_link(spark):
    """Changed words that are many, but few of a line: their parities differ in far more bits than a fixed bound would let through."""
    rng = random.Random(11)
    vocabulary, links = ["".join(rng.choices("abcdefghij", k=7)) for _ in range(3000)], []
    sims = lambda w: sum(1 << b for b in range(64) if 2 * sum(xxhash.xxh64_intdigest(x, 42) >> b & 1 for x in w) > len(w))
    while len(links) < 6:
        words = rng.choices(vocabulary, k=800)
        other = list(words)
        for k in rng.sample(range(800), 25):
            other[k] += "z"
        if 0 < (sims(words) ^ sims(other)).bit_count() <= 3:
            links.append((" ".join(words), " ".join(other)))
    rows = spark.createDataFrame([(2 * k + side, pair[side]) for k, pair in enumerate(links) for side in (0, 1)], "doc_id bigint, text string")
    out = {r.doc_id: r.lines_kept for r in line_dedup.dedup_lines(rows).collect()}
    assert out == {2 * k + side: 1 - side for k in range(6) for side in (0, 1)}


# 5. urls


def test_url_filter(spark):
    rules = url_filter.entries(spark, [("com", "/", "allow"), ("a.com", "/en/", "block"), ("bad.org", "/", "block"), ("bad.org", "/ok", "allow")])
    urls = ["http://A.com/en/x?q", "https://x.a.com/fr", "nothing", None, "ftp://bad.org/ok/1#f", "http://w.bad.org", "http://w.bad.org/", "http://notbad.org/", "://com/", "http://a.com/en/x?q", "http://l.net/" + "x" * 100_000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    listed = spark.createDataFrame([("w.bad.org/",), ("l.net/" + "x" * 100_000,), (None,), ("x.a.com/fr",)], "key string")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, rules, listed).collect()}
    assert out[0] == ("a.com", "/en/x", "a.com/en/", "block") and out[1] == ("x.a.com", "/fr", "com/", "allow")
    assert out[2] == ("", "", None, "allow") == out[3]
    assert out[4][2:] == ("bad.org/ok", "allow") and out[5][2:] == (None, "block") and out[6][2:] == ("bad.org/", "block") and out[7][2:] == (None, "allow")
    assert out[8] == ("com", "/", "com/", "allow") and out[9] == out[0] and out[10][2:] == (None, "block")
    assert url_filter.judge(pages.limit(0), rules, listed).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, rules.limit(0), listed.limit(0)).collect()} == {"allow"}


def test_canonical_urls(spark):
    same = {
        "h.com/": ["http://h.com", "https://H.COM:443/#top", "http://u:p@h.com:80", "ftp://h.com./"],
        "h.com/a-b/%2F?q=%C3%A9": ["http://h.com/%61%2Db/%2f?q=%c3%a9", "http://h.com/a-b/%2F?q=%C3%A9#x"],
        "h.com:8080/%zz%": ["http://h.com:8080/%zz%"],
    }
    rows = spark.createDataFrame([(u, k) for k, v in same.items() for u in v], "url string, want string")
    assert [(r.got, r.url) for r in rows.select("url", url_filter.canonical(F.col("url")).alias("got"), "want").where("got is distinct from want").collect()] == []


def test_bloom_has_no_false_negatives(spark):
    listed = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    ask = spark.range(6000).select(F.concat(F.lit("k"), "id").alias("key"))
    got = {r.key for r in url_filter.passing(ask, listed).collect()}
    assert {f"k{k}" for k in range(3000)} <= got and len(got) < 3600
    maybe, never = url_filter.split_by(ask, "key", listed, 3000)
    assert maybe.count() == len(got) and maybe.count() + never.count() == 6000


# 6. near-duplicates


def brute_fp(text):
    w = regex.findall(r"[^\x20\x09-\x0D]+", regex.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def components_of(n, links):
    group = list(range(n))
    for i, j in links:
        group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    return group


def test_near_groups_equal_brute_force(spark):
    rng = random.Random(8)
    base = [sentence(rng, 120) for _ in range(6)]
    texts = EDGE + [b for b in base for _ in range(4)] + [b + " " + sentence(rng, 1) for b in base for _ in range(6)]
    fps = [brute_fp(t) for t in texts]
    want = components_of(len(texts), [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if (fps[i] ^ fps[j]).bit_count() <= 4])
    out = {r.doc_id: r for r in simhash_dedup.near_groups(docs(spark, texts)).collect()}
    assert [out[k].fp & (1 << 64) - 1 for k in range(len(texts))] == fps
    assert [out[k].component_id for k in range(len(texts))] == want


@pytest.mark.parametrize("chain", [2, 3])
def test_links_find_every_pair(spark, chain):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(8)]
    fps = {0} | {b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(7))) for b in base for _ in range(12)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    want = {(min(a, b), max(a, b)) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    got = simhash_dedup.links(spark.createDataFrame([(x,) for x in signed], "fp bigint"), chain=chain).collect()
    assert sorted((r.u, r.v) for r in got) == sorted(want)


def test_keep_one_with_nulls_and_repeated_rows(spark):
    rows = spark.createDataFrame([(3, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (None, "z y"), (5, None), (6, "")], "doc_id bigint, text string")
    assert sorted((r.doc_id or 0) for r in simhash_dedup.keep_one(rows).collect()) == [0, 1, 5]
    assert simhash_dedup.keep_one(rows.limit(0)).count() == 0


def test_keep_one_equals_brute_force(spark):
    rng = random.Random(12)
    base = [[f"v{rng.randrange(3000)}" for _ in range(n)] for n in (60, 60, 200, 200, 900, 8)]
    texts = list(EDGE)
    for b in base:
        for k in range(14):  # words changed, from none to too many
            copy = list(b)
            for at in rng.sample(range(len(b)), len(b) * k // 200 + k % 2):
                copy[at] = "new"
            texts.append(" ".join(copy))
    cuts = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in cuts]
    alike = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b) - 1e-9
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if alike(sets[i], sets[j])]
    far = [(i, j) for i, j in links if (brute_fp(texts[i]) ^ brute_fp(texts[j])).bit_count() > 4]
    want = components_of(len(texts), links)
    assert far and {r.doc_id for r in simhash_dedup.keep_one(docs(spark, texts)).collect()} == set(want)


def test_keep_one_takes_its_first_links_from_fingerprints(spark, monkeypatch):
    rng = random.Random(31)
    long = [f"v{rng.randrange(3000)}" for _ in range(900)]
    texts = [" ".join(long), " ".join([*long[:-1], "new"]), " ".join(long).upper(), " ".join(f"w{k}" for k in range(50))]
    fps = [brute_fp(t) for t in texts]
    seen = []
    whole = shingle_join.groups

    def watched(texts, ngram, similarity, near):
        def spied(classes):
            seen.append(sorted((r.u, r.v) for r in near(classes).collect()))
            return near(classes)

        return whole(texts, ngram, similarity, spied)

    monkeypatch.setattr(shingle_join, "groups", watched)
    assert sorted(r.doc_id for r in simhash_dedup.keep_one(docs(spark, texts)).collect()) == [0, 3]
    assert 0 < (fps[0] ^ fps[1]).bit_count() <= 4 and len(seen) == 1 and len(seen[0]) == 1


def test_components(spark):
    rng = random.Random(10)
    pairs = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(200 + k, 201 + k) for k in range(40)] + [(None, 3), (7, 7)]
    got = {r.u: r.v for r in components.connected(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
    want = components_of(260, [(a, b) for a, b in pairs if a is not None])
    assert got == {k: want[k] for k in range(260) if want[k] != k}


# 7. shards


def test_sharding(spark):
    texts = EDGE * 40
    out = sharding.place(docs(spark, texts)).collect()
    counts = Counter(r.shard for r in out)
    assert len(out) == len(texts) and max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(8))
    for s, n in counts.items():
        assert sorted(r.slot for r in out if r.shard == s) == list(range(n))
    for r in out:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    more = {r.doc_id: r.shard for r in sharding.place(docs(spark, texts), shards=9).collect()}
    assert sum(more[r.doc_id] != r.shard for r in out) / len(out) < 0.4
    assert sorted(map(str, sharding.place(docs(spark, texts).repartition(3)).collect())) == sorted(map(str, out))


def ring_by_hand(keys, shards, vnodes=32, bits=13):
    """Shard of each key (sortable, with its place first): clockwise to the next node with room, a round for each next shard."""
    nodes = {}
    for s in range(shards):
        for v in range(vnodes):
            nodes.setdefault(xxhash.xxh64_intdigest(f"shard {s} node {v}", 0) >> (64 - bits), s)
    waiting = sorted(keys, key=lambda k: (k[0] >> (64 - bits), k[0] - (1 << 64) * (k[0] >> 63), *k[1:]))
    free = [len(keys) // shards + (s < len(keys) % shards) for s in range(shards)]
    out = {}
    for r in range(shards):
        late = []
        for k in waiting:
            here = k[0] >> (64 - bits)
            turn = [nodes[c] for c in sorted(nodes) if c >= here] + [nodes[c] for c in sorted(nodes) if c < here]
            target = list(dict.fromkeys(turn))[r]
            if free[target]:
                free[target] -= 1
                out.setdefault(k, []).append(target)
            else:
                late.append(k)
        waiting = late
    return out


def test_sharding_equals_brute_force_and_moves_little(spark):
    texts = [f"text {k % 50}" for k in range(900)]
    place = lambda i: xxhash.xxh64_intdigest(str(i), 42)
    keys = [(place(i), i, len(t) + 1, zlib.crc32(t.encode())) for i, t in enumerate(texts)]
    homes = {}
    for shards in (8, 9):
        want = ring_by_hand(keys, shards)
        got = {r.doc_id: r.shard for r in sharding.place(docs(spark, texts), shards=shards).collect()}
        assert got == {k[1]: v[0] for k, v in want.items()}
        homes[shards] = got
    assert sum(homes[8][k] != homes[9][k] for k in homes[8]) / len(texts) < 0.35


def test_sharding_of_few_repeated_and_no_rows(spark):
    assert sharding.place(docs(spark, [])).count() == 0
    same = spark.createDataFrame([(None, "a")] * 20 + [(1, "b")] * 20, "doc_id bigint, text string")
    out = sharding.place(same).collect()
    assert set(Counter(r.shard for r in out).values()) == {5} and len({(r.shard, r.slot) for r in out}) == 40


# 8. pages


def longest(a, b):
    row = np.zeros(len(b) + 1, int)
    right = np.array(b)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[:-1] + (right == x), row[1:]))
    return int(row[-1])


def test_common_lines_are_longest():
    rng = random.Random(11)
    sizes = [(rng.randrange(9), rng.randrange(9), 4) for _ in range(200)] + [(rng.randrange(60), rng.randrange(60), 7) for _ in range(50)] + [(3000, 2500, 40), (2500, 3000, 2)]
    for n, m, kinds in sizes:
        a, b = [rng.randrange(kinds) for _ in range(n)], [rng.randrange(kinds) for _ in range(m)]
        found = html_extraction.common_lines(a, b)
        assert len(found) == longest(a, b) and all(a[i] == b[j] for i, j in found)
        assert all(x < y and u < v for (x, u), (y, v) in zip(found, found[1:]))


def test_html_extraction_equals_brute_force(spark):
    """Pages of known lines: what the nearest differing page has in the same order goes, but for the article."""
    rng = random.Random(13)
    rows, want = [], {}
    for h in ("a.com", "b.com"):
        frame = [f"frame {h} {k}" for k in range(12)]
        pages = {}
        for k in range(14):
            lines = sorted([(i, t, False) for i, t in enumerate(frame) if rng.random() < 0.7] + [(rng.uniform(0, 12), f"own {h} {k} {j}", rng.random() < 0.6 and k % 3 == 0) for j in range(4)])
            path = f"/{rng.choice('xyz')}/{rng.randrange(1000)}"
            if k % 5 == 4:  # a copy under another path
                lines = pages[sorted(pages)[0]]
            pages[path] = lines
        first = {}
        for path in sorted(pages):
            first.setdefault(tuple(t for _, t, _ in pages[path]), path)
        order = sorted(first.values())
        same = lambda x, y: len(os.path.commonprefix([x, y]))
        for path, lines in pages.items():
            at = order.index(first[tuple(t for _, t, _ in lines)])
            near = [(-same(order[at], order[j]), k, order[j]) for k, j in enumerate((at - 1, at + 1)) if 0 <= j < len(order)]
            other = {t for _, t, _ in pages[min(near)[2]]}
            article = any(x for *_, x in lines)
            text = [t for _, t, inside in lines if (inside if article else t not in other)]
            n = len(rows)
            want[n] = ("\n\n".join(text), sum(t in other and not inside for _, t, inside in lines))
            rows.append((n, f"http://{h}{path}", "".join(f"<article><p>{t}</p></article>" if inside else f"<div>{t}</div>" for _, t, inside in lines)))
    out = html_extraction.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert {r.page_id: (r.text, r.n_shared) for r in out} == want
    assert sum(n for _, n in want.values()) > 50


@pytest.mark.parametrize(("page", "want"), [
    ("<body class='with-sidebar'><p>a</p></body>", ["a"]), ("<body class='sidebar'><main id='banner'><p>a</p></main></body>", ["a"]),
    ("<article class='post no-comments'><p>a</p></article>", ["a"]), ("<div class='content header-fixed'><h2 class='section-header'>a</h2>b</div>", ["a", "b"]),
    ("<p>a</p><figure><pre>b</pre><figcaption>c</figcaption></figure>", ["a", "b", "c"]),
    ("<p>a</p><div class='big ad'>x</div><div class='cookie-banner'>y</div><div id='comments'>z</div>", ["a"]),
])
def test_class_names_hide_what_they_name(page, want):
    found = html_extraction.blocks(page)
    assert [found[k][0] for k in html_extraction.kept(found)] == want


def test_html_extraction(spark):
    page = lambda body: f"<div>Site</div><p>{body}</p><div>All rights</div>"
    rows = [
        (1, "http://h.com/a/1", page("one")), (2, "http://h.com/a/2", page("two &amp; more &lt;b&gt;")), (3, "http://alone.com/", "<p>a\n b<br>c<p>d"), (4, None, None), (5, "x", ""),
        (6, "http://h.com/b", "<nav>menu</nav><article><h1>T</h1><p>x <b>y</b><script>'<p>'</script></p><div class='ad'>buy</div><p>z</article><footer>f</footer>"),
        (7, "http://k.com/1", "<main><p>Site<section id=comments><p>hi</section></main>"), (1, "http://h.com/a/1", page("one")), (8, "http://h.com/c", "<article><p>cut o"),
    ]
    out = defaultdict(set)
    for r in html_extraction.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect():
        out[r.page_id].add(r.text)
    assert out == {1: {"one"}, 2: {"two & more <b>"}, 3: {"a b c\n\nd"}, 4: {""}, 5: {""}, 6: {"T\n\nx y\n\nz"}, 7: {"Site"}, 8: {"cut o"}}
    assert html_extraction.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


# 9. language model


@pytest.fixture(scope="module")
def vocab():
    import public_tokenizers

    return lattice_lm.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))


def test_lattice_sums_all_segmentations(vocab):
    lattice = lattice_lm.Lattice(vocab, lattice_lm.start(vocab))
    pieces = {p: k for k, (p, b) in enumerate(zip(vocab["piece"], vocab["byte"], strict=True)) if b < 0}

    def brute(w):
        if not w:
            return 1.0
        spelled = math.exp(sum(lattice.logp[lattice.bytes[b]] for b in w[0].encode())) * brute(w[1:])
        return spelled + sum(math.exp(lattice.logp[pieces[w[:k]]]) * brute(w[k:]) for k in range(1, len(w) + 1) if w[:k] in pieces)

    words = ["the", "thing", "é", "日本", "zq1", "a"]
    assert np.allclose(lattice.scores(words), [math.log(brute("▁" + w)) for w in words])
    one, up = lattice.scores(["then"])[0], lattice_lm.start(vocab)
    k, eps = pieces["en"], 1e-5
    up[k] += eps  # a piece's expected count is the slope of the score
    slope = (lattice_lm.Lattice(vocab, up).scores(["then"])[0] - one) / eps
    assert lattice.expected(["then"], np.array([1.0]))[k] == pytest.approx(slope, rel=1e-3, abs=1e-6)


def test_scores_equal_brute_force(spark):
    """Every segmentation of every word, its expected counts, and the sums of texts; pieces of over 16 letters too."""
    import pandas as pd

    pieces = [("▁", -1, -1.0), ("a", -1, -2.0), ("b", -1, -2.5), ("▁a", -1, -3.0), ("ab", -1, -2.2), ("▁ab", -1, -4.0), ("ba", -1, -3.3), ("cdefghijklmnopqrstu", -1, -6.0)]
    pieces += [(f"<0x{k:02X}>", k, 0.0) for k in range(256)]
    vocab = pd.DataFrame(pieces, columns=["piece", "byte", "score"])
    rng = random.Random(17)
    texts = [None, "", "cdefghijklmnopqrstu ab", "é ab"] + [" ".join("".join(rng.choice("ab") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 8))) for _ in range(12)]

    def ways(word, logp):
        """(log probability, ids) of each segmentation of a marked word."""
        if not word:
            yield 0.0, ()
            return
        raw = [8 + b for b in word[0].encode()]
        for ids, rest in [(raw, word[1:])] + [([k], word[len(p) :]) for k, (p, b, _) in enumerate(pieces) if b < 0 and word.startswith(p)]:
            for lp, more in ways(rest, logp):
                yield sum(logp[i] for i in ids) + lp, (*ids, *more)

    teach = [t for k, t in enumerate(texts) if zlib.crc32(str(k).encode()) % 5 != 1]
    counts = Counter(w for t in teach for w in (t or "").split())
    known = [math.exp(s) if b < 0 else math.exp(-7.0) for _, b, s in pieces] + [1e-6]
    law = [x / sum(known) for x in known]
    total = [x * 100 for x in law]
    for w, c in counts.items():
        found = list(ways("▁" + w, [math.log(x) for x in law]))
        whole = sum(math.exp(lp) for lp, _ in found)
        for lp, ids in found:
            for i in ids:
                total[i] += c * math.exp(lp) / whole
    total[-1] += len(teach)
    logp = [math.log10(x / sum(total)) for x in total]
    want = {}
    for k, t in enumerate(texts):
        want[k] = logp[-1] + sum(math.log10(sum(10**lp for lp, _ in ways("▁" + w, logp))) for w in (t or "").split())
    out = lattice_lm.score(docs(spark, texts), lattice_lm.teaches(), vocab, rounds=1, prior=100).collect()
    assert {r.doc_id: pytest.approx(r.score, abs=1e-6) for r in out} == want


def test_scores(spark, vocab):
    rng = random.Random(12)
    texts = EDGE + [sentence(rng, 30) for _ in range(20)]
    for share in (lattice_lm.HOT, 1):  # frequent words sent along, or all words joined
        out = {r.doc_id: r for r in lattice_lm.score(docs(spark, texts), lattice_lm.teaches(), vocab, hot_share=share).collect()}
        c = Counter(w for k, t in enumerate(texts) if zlib.crc32(str(k).encode()) % 5 != 1 for w in [*lattice_lm.tokens(t), b""])
        n, level = sum(c.values()), math.log10(sum(c.values()) + 0.5 * (len(c) + 1))
        for k, t in enumerate(texts):
            w = [*lattice_lm.tokens(t), b""]
            assert (out[k].n_tokens, out[k].n_known, out[k].train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
            assert out[k].base_score == pytest.approx(sum(math.log10(c[x] + 0.5) - level for x in w)) and out[k].score < 0
    assert lattice_lm.score(docs(spark, []), lattice_lm.teaches(), vocab).count() == 0
    two = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id bigint, text string")
    assert sorted(r.n_tokens for r in lattice_lm.score(two, lattice_lm.teaches(), vocab).collect()) == [1, 3, 3]


# 10. mixing


def brute_targets(sizes):
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    total, target, free = sum(sizes.values()), {}, set(names)
    while True:
        rest, weight = total - sum(target.values()), sum(w[s] for s in free)
        over = {s for s in free if weight and rest * w[s] / weight > 3 * sizes[s] + 1e-9}
        if not over:
            return target | {s: rest * w[s] / weight for s in free}
        target |= {s: 3 * sizes[s] for s in over}
        free -= over


def test_mixing(spark):
    rng = random.Random(13)
    rows = [(k, rng.choice(["a", "b", "é", None, "z"]) if k % 3 else "hot", sentence(rng, rng.randrange(0, 30))) for k in range(600)] + [(900, "tiny", "w1 w2"), (901, "void", None), (902, "void", "")]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    out = mixing.mix(df).collect()
    sizes = defaultdict(int)
    for _, s, t in rows:
        sizes[s] += len((t or "").split())
    want, taken = brute_targets(sizes), defaultdict(int)
    assert len(out) == len(rows)
    for r in out:
        assert r.size == len((rows[r.doc_id][2] if r.doc_id < 600 else next(x[2] for x in rows if x[0] == r.doc_id) or "").split())
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r.size
        assert r.copies in (math.floor(r.target / r.source_size) if r.source_size else 0, math.ceil(r.target / r.source_size) if r.source_size else 0) or r.size == 0
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 30
    assert sorted(map(str, mixing.mix(df.repartition(5)).collect())) == sorted(map(str, out))


def test_mixing_draws_without_bias(spark, monkeypatch):
    rows = spark.createDataFrame([(k, "a" if k < 30 else "b", "w " * (1 + k % 5)) for k in range(60)], "doc_id bigint, source string, text string")
    total = Counter()
    for seed in range(12):
        monkeypatch.setattr(mixing, "SEED", seed)
        for r in mixing.mix(rows).collect():
            total[r.source] += r.copies / 12 / 30
    first = mixing.mix(rows).groupBy("source").agg(F.max(F.col("target") / F.col("source_size")).alias("p")).collect()
    for r in first:
        assert total[r.source] == pytest.approx(r.p, abs=0.08)


def test_repeat_takes_what_the_mix_says(spark):
    rows = spark.createDataFrame([(1, "a", "x y z")] * 5 + [(2, "b", "x"), (None, None, None), (3, "b", "p q r s")], "doc_id bigint, source string, text string")
    want = Counter()
    for r in mixing.mix(rows).collect():
        want[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in mixing.repeat(rows).collect()) == Counter({k: n for k, n in want.items() if n})
    assert mixing.repeat(rows.limit(0)).count() == 0
