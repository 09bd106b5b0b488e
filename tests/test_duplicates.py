"""Near titles against a look at all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions.scalar import normal_title
from graphloom.operators import duplicates


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def by_hand(titles, threshold):
    ids = {}
    for i, t in titles:
        ids.setdefault(t, []).append(i)
    single = {t: i[0] for t, i in ids.items() if len(i) == 1}
    blocks = sorted({t[:3] for t in single})
    ranks = {b: k for k, b in enumerate(blocks)}
    out = set()
    for a in single:
        for b in single:
            if single[a] < single[b] and abs(ranks[a[:3]] - ranks[b[:3]]) <= 1:
                longest = max(len(a), len(b))
                if longest and abs(len(a) - len(b)) <= (1 - threshold) * longest + 1:
                    sim = 1 - distance(a, b) / longest
                    if threshold <= sim < 1:
                        out.add((single[a], single[b], int(sim * 100 + 0.5) / 100))
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = ["order", "plan", "plans", "review", "meeting", "notes", "of", "q1", "q2", "é", "straße", "a", ""]
    titles = {f"order {rng.randrange(400)}" for _ in range(40)} | {f"weekly planning meeting of team number {rng.randrange(60)} {rng.choice('ab')}" for _ in range(40)}
    titles |= {" ".join(rng.choice(words) for _ in range(rng.randrange(1, 9))) for _ in range(60)}
    for t in sorted(titles)[::3]:
        c = list(t)
        for _ in range(rng.randrange(1, 5)):
            k = rng.randrange(len(c) + 1)
            c[k : k + rng.randrange(2)] = rng.choice(["", "x", "1", "ab"])
        titles.add("".join(c))
    return [(f"n{i:03d}", t) for i, t in enumerate(sorted(titles))] + [("z1", "same"), ("z2", "Same!")]


@pytest.mark.parametrize("threshold", [0.6, 0.8, 0.92])
def test_near_equals_all_pairs(spark, threshold):
    d = spark.createDataFrame(corpus(int(threshold * 100)), "id string, title string")
    norm = [(r["id"], r["n"]) for r in d.select("id", normal_title(F.col("title")).alias("n")).collect()]
    want = by_hand(norm, threshold)
    got = [tuple(r) for r in duplicates.near(d, threshold).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 30


def test_a_hot_block_is_not_all_pairs(spark):
    n = 4_000
    d = spark.range(n).select(F.format_string("o/%d", "id").alias("id"), F.format_string("Order %d", F.col("id") * 37 + 100_000).alias("title"))
    met = duplicates._candidates(duplicates._members(d), 0.8).count()
    near = duplicates.near(d).count()
    assert near <= met < min(8 * near, n * n / 2 / 20)


def test_groups_are_whole(spark):
    rows = [(f"a{i:04d}", "Same title") for i in range(1_500)] + [("b1", "other"), ("b2", "Other"), ("c1", "alone thing"), ("c2", "alone things")]
    got, n = duplicates.groups(spark.createDataFrame(rows, "id string, title string"), limit=2)
    ids = [r["ids"] for r in got.collect()]
    assert n == 3 and [len(x) for x in ids] == [1_500, 2] and ids[1] == ["b1", "b2"]
    assert duplicates.near(spark.createDataFrame([], "id string, title string")).count() == 0
    assert duplicates.near(spark.createDataFrame([("a", None), ("b", "")], "id string, title string")).count() == 0
