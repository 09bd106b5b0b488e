"""Hot keys and whole texts: what is dealt or bounded gives the same rows as the plain way."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import common, mixing, near_dedup


def test_first_by_hash_equals_sorting(spark):
    rng = random.Random(6)
    spread = [("a", rng.randrange(-(2**63), 2**63), i) for i in range(3000)] + [("b", rng.randrange(-(2**63), 2**63), i) for i in range(4)]
    # hashes that are anything but even, and ties
    spread += [("c", 2**63 - 1 - i // 2, i) for i in range(500)]
    rows = common.materialize(spark.createDataFrame(spread, "g string, h long, id long"), "rows")
    for most in (1, 7, 60):
        got = {(r["g"], r["k"]): (r["h"], r["id"]) for r in common.first_by_hash(rows, ["g"], ["h", "id"], most).collect()}
        want = {}
        for g in "abc":
            for k, (_, h, i) in enumerate(sorted(x for x in spread if x[0] == g)[:most], 1):
                want[g, k] = (h, i)
        assert got == want
    none = common.materialize(rows.filter("g = 'x'"), "none")
    assert common.first_by_hash(none, ["g"], ["h", "id"], 5).count() == 0


def test_hot_key_without_partner_is_dealt(spark):
    left = spark.range(2000).select(F.col("id").alias("x"), F.when(F.col("id") < 1500, 7).otherwise(F.col("id")).alias("k"))
    counts = left.groupBy("k").agg(F.count("*").alias("n"))
    right = spark.createDataFrame([(1600, "one"), (1700, "two")], "k long, v string")
    out = common.hot_join(left, right, ["k"], "x", 2000, "left", counts)
    assert Counter(r["v"] for r in out.collect()) == {None: 1998, "one": 1, "two": 1}
    assert "__salt" in out._jdf.queryExecution().optimizedPlan().toString()


def family(rng, words, n, edits):
    base = [rng.choice(words) for _ in range(120)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(edits):
            w[rng.randrange(120)] = rng.choice(words)
        out.append(w)
    return out


def jaccard(a, b):
    x, y = (Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (a, b))
    both = sum((x & y).values())
    return both / (sum(x.values()) + sum(y.values()) - both)


def test_rare_pairs_in_blocks(spark, monkeypatch):
    """No pair of similar texts is lost, and the blocks change nothing."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    texts = [w for _ in range(4) for w in family(rng, words, 12, 1)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "__key long, text string")
    reps = common.materialize(spark.createDataFrame([(i, i) for i in range(len(texts))], "rep long, c long"), "reps")
    want = {(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8}
    assert len(want) > 20
    whole = {(r["a"], r["b"]) for r in near_dedup.rare_pairs(reps, docs).collect()}
    assert {(j, i) for i, j in want} <= whole
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    assert {(r["a"], r["b"]) for r in near_dedup.rare_pairs(reps, docs).collect()} == whole


def test_many_copies_and_a_leader_of_many(spark):
    """A third of the rows is one text without near partners, another a family around one leader."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    copy = " ".join(rng.choice(words) for _ in range(60))
    base = [rng.choice(words) for _ in range(100)]
    near = []
    for i in range(120):
        w = list(base)
        w[i % 100] = f"x{i}"
        near.append(" ".join(w))
    alone = [" ".join(rng.choice(words) for _ in range(50)) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate([copy] * 120 + [" ".join(base)] + near + alone)), "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["kept"]) for r in near_dedup.op3(spark, docs).collect()}
    want = {i: (0, i == 0) for i in range(120)} | {i: (120, i == 120) for i in range(120, 241)} | {i: (i, True) for i in range(241, 361)}
    assert got == want


def test_mixing_learns_from_the_end_of_long_texts(spark):
    """Texts that differ only after 24,000 characters are told apart, by the words that differ most."""
    rng = random.Random(9)
    filler = " ".join(rng.choice(["red", "blue", "green"]) for _ in range(6000))
    rows = [(i, f"{filler} {'zinc iron' if i % 2 else 'river stone'} end", "junk" if i % 2 else "good") for i in range(160)]
    assert len(filler) > 20_000
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k) for i, _, k in rows if i < 120], "doc_id long, domain string")
    model = mixing.train(docs, labels)
    assert sorted(model.words) == [b"iron", b"river", b"stone", b"zinc"]
    _, p = model.posterior([t.encode() for _, t, _ in rows])
    assert [model.domains[k] for k in p.argmax(1)] == [k for _, _, k in rows] and p.max(1).min() > 0.9


def test_telling_words_equal_plain_counts(spark):
    rng = random.Random(10)
    kinds = {"a": "one two three four".split(), "b": "one two five six".split(), "c": "one seven eight".split()}
    rows = [(" ".join(rng.sample(w, 2)), d) for d, w in kinds.items() for _ in range(40 if d == "a" else 25)]
    of = Counter(d for _, d in rows)
    seen = Counter((w, d) for t, d in rows for w in set(t.split()))
    gaps = {}
    for w in {w for w, _ in seen}:
        n = sum(seen[w, d] for d in of)
        if n >= 5:
            p = n / len(rows)
            gaps[w] = max(abs(seen[w, d] / of[d] - p) / np.sqrt(p / of[d] + 1 / of[d] ** 2) for d in of)
    want = [w.encode() for w, g in sorted(gaps.items(), key=lambda g: (-g[1], g[0])) if g > 4]
    got = mixing.telling_words(spark.createDataFrame(rows, "text string, domain string"), dict(of))
    assert got == want and got
