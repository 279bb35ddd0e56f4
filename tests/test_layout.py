"""Words set out on a page's grid, and a service block of any length, against plain Python."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from sparkfields.operators import pages, quality
from sparkfields.plans import flows

SF = "/root/testdata/sf0.001"
WORDS = "doc_id long, page int, seq long, text string, x0 double, y0 double, page_width double"


def grid(words, width):
    """The page's lines, character by character."""
    rows = {}
    for x, seq, y, text in words:
        rows.setdefault(round(y / 4) * 4, []).append((x, seq, text))
    out = []
    for y in sorted(rows):
        line = []
        for x, _, text in sorted(rows[y]):
            at = int(x * (120 / (width or 595.0)))
            if at > len(line):
                line += " " * (at - len(line))
            elif line and line[-1] != " ":
                line.append(" ")
            line += text
        out.append("".join(line).rstrip())
    return "\n".join(out)


def test_layout_text(spark):
    rng = random.Random(4)
    texts = ["a", "total", "R$", "1.234,56", "ação", "x" * 150, "end ", "", "\U0001f600"]
    rows, want = [], {}
    for doc in range(40):
        width = rng.choice([595.0, 900.0, 612.5, 0.0, None])
        words = [(rng.choice([0.0, 45.0, -3.0, rng.random() * 600]), seq, rng.choice([2.0, 6.0, 10.0, rng.random() * 40]), rng.choice(texts)) for seq in range(rng.randrange(1, 40))]
        rows += [(doc, 0, seq, text, x, y, width) for x, seq, y, text in words]
        want[doc] = grid(words, width)
    rng.shuffle(rows)
    found = {r.doc_id: r.text for r in pages.layout_text(spark.createDataFrame(rows, WORDS)).collect()}
    assert found == want
    assert pages.layout_text(spark.createDataFrame([], WORDS)).count() == 0


def test_tail_of_any_length(spark):
    lines = ["Head", "x"] + [str(i) for i in range(10_500)]
    row = spark.createDataFrame([(lines,), ([],), (None,)], "v array<string>").select(F.size(quality._tail(F.col("v"), "^head$", F.size("v"))).alias("n"))
    assert [r.n for r in row.collect()] == [10_501, 0, 0]


def shuffles(df):
    """What the plan of df shuffles by, without the ids of columns."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.sub(r"#\d+L?", "", x) for x in re.findall(r"Exchange hashpartitioning\((.*?)\)", plan)]


def test_page_texts_shuffle_texts_not_words(spark):
    keys = shuffles(flows.d12_words_to_text(spark, SF))
    assert len(keys) == 1 and re.fullmatch(r"doc_id, \d+", keys[0])


def test_grid_shuffles_texts_not_words(spark):
    keys = shuffles(flows.d15_layout_text(spark, SF))
    assert len(keys) == 1 and re.fullmatch(r"doc_id, \d+", keys[0])


def test_overlaps_shuffle_texts_not_words(spark):
    keys = shuffles(flows.c10_non_overlapping_words(spark, SF))
    assert keys and all(re.fullmatch(r"doc_id, \d+", k) for k in keys)


def test_overlaps_equal_all_pairs(spark):
    rng = random.Random(8)
    schema = "doc_id long, page int, seq long, x0 double, y0 double, x1 double, y1 double, conf double"

    def word(seq):
        x, y = rng.choice([-70.0, 0.0, 10.0, 63.0, 64.0, 128.0]), rng.choice([-5.0, 0.0, 8.0, 60.0])
        return (rng.choice([1, 2, None]), rng.choice([0, 0, 1, None]), seq, x, y, x + rng.choice([-10.0, 0.0, 5.0, 40.0, 200.0]), y + rng.choice([0.0, 12.0, 90.0]), rng.choice([0.2, 0.55, 0.9, None]))

    typed, hand = [word(k) for k in range(60)], [word(k % 150) for k in range(200)] + [(1, 0, 900, None, 0.0, 1.0, 1.0, 0.9)]

    def alike(a, b):
        w, v = max(0.0, min(a[5], b[5]) - max(a[3], b[3])), max(0.0, min(a[6], b[6]) - max(a[4], b[4]))
        union = sum(max(0.0, (r[5] - r[3]) * (r[6] - r[4])) for r in (a, b)) - w * v
        return w * v / union if union > 0 else 0.0

    good, over = [t for t in typed if t[7] is not None and t[7] >= 0.55], {}
    for h in hand[:-1]:
        hit = any(None not in h[:2] and h[:2] == t[:2] and alike(h, t) >= 0.25 for t in good)
        over[h[:3]] = over.get(h[:3], False) or hit
    want = [(*t[:3], "typed") for t in good] + [(*k, "handwritten") for k, hit in over.items() if not hit]
    got = [tuple(r) for r in pages.non_overlapping_words(spark.createDataFrame(typed, schema), spark.createDataFrame(hand, schema)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and any(over.values())
