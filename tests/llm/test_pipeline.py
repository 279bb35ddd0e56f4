"""The whole pipeline against each of its stages done by hand."""

from __future__ import annotations

import itertools
import random
import zlib
from collections import Counter

import xxhash

import corpus_pipeline
from sparkfields.llm import mixing

from .test_operators import brute_hits, brute_targets, components_of, ring_by_hand
from .test_queries import write

ITEM = "the quick brown fox jumps over the lazy dog again and again"


def test_pipeline_equals_brute_force(spark, tmp_path):
    rng = random.Random(21)
    words = {0: ["bala", "lamba", "galaba", "daba", "moba", "saba"], 1: ["xixo", "voxu", "zuxiv", "kixu", "pixo", "xuzu"]}
    texts = [" ".join(rng.choices(words[k % 2], k=rng.randrange(30, 90))) for k in range(50)]
    for k in range(12):  # near copies with a few words changed, at the end of which some have a test passage
        copy = texts[k].split()
        copy[rng.randrange(len(copy))] = rng.choice(words[k % 2])
        texts.append(" ".join(copy))
    texts += [texts[20], texts[20], None, "", "12 34 !", texts[24] + " " + ITEM, texts[26][:60] + " " + ITEM.upper() + " " + texts[26][60:]]
    texts += [" ".join(rng.choices(words[0], k=12) + rng.choices(words[1], k=4) + rng.choices(words[0], k=12))]
    write(spark, tmp_path, texts)
    # language: all these texts have one main language but for those without letters
    kept = [k for k, t in enumerate(texts) if any(c.isalpha() for c in t or "")]
    # near copies: exact similarity of all pairs
    cut = {k: texts[k].lower().split() for k in kept}
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k, w in cut.items()}
    links = [(i, j) for i, j in itertools.combinations(range(len(kept)), 2) if len(sets[kept[i]] & sets[kept[j]]) >= 0.8 * len(sets[kept[i]] | sets[kept[j]]) - 1e-9]
    root = components_of(len(kept), links)
    kept = [kept[k] for k in range(len(kept)) if root[k] == k]
    assert len(root) - len(kept) >= 8
    # decontamination: every window of every item in every text
    clean = [k for k in kept if brute_hits(texts[k], [(0, ITEM)])[1] == 0]
    assert len(clean) < len(kept)
    # mixing: words of each source near its target, no text more than three times
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    copies = Counter(r.doc_id for r in out)
    assert set(copies) <= set(clean) and max(copies.values()) <= 3
    sizes = {k: len(texts[k].split()) for k in clean}
    total = Counter()
    for k in clean:
        total[f"src{k % 3}"] += sizes[k]
    for source, target in brute_targets(dict(total)).items():
        assert abs(sum(n * sizes[k] for k, n in copies.items() if f"src{k % 3}" == source) - target) <= max(sizes.values())
    # sharding: the ring by hand over the copies
    key = lambda k: (xxhash.xxh64_intdigest(str(k), 42), k, len(texts[k].encode()) + 1, zlib.crc32(texts[k].encode()))
    homes = ring_by_hand([key(k) for k, n in copies.items() for _ in range(n)], 8)
    assert Counter((r.doc_id, r.shard) for r in out) == Counter((k[1], s) for k, v in homes.items() for s in v)
    assert [sorted(r.slot for r in out if r.shard == s) for s in range(8)] == [list(range(sum(r.shard == s for r in out))) for s in range(8)]


def test_mixing_many_equal_rows(spark):
    """A third of the rows alike: they differ by one copy at most, and their sources still meet their targets."""
    rows = spark.createDataFrame([(5, "a b c d e f g", "x")] * 3000 + [(k, "w " * (k % 50 + 1), "xyz"[k % 3]) for k in range(6, 3006)] + [(None, None, None)] * 500, "doc_id bigint, text string, source string")
    out = mixing.mix(rows).collect()
    assert len(out) == 6500
    same = {r.copies for r in out if r.doc_id == 5}
    assert max(same) - min(same) <= 1
    for source in "xyz":
        own = [r for r in out if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 50
    assert Counter(r.doc_id for r in mixing.repeat(rows).collect()) == Counter({k: n for k, n in Counter({k: sum(r.copies for r in g) for k, g in itertools.groupby(sorted(out, key=lambda r: r.doc_id or -1), key=lambda r: r.doc_id)}).items() if n})
