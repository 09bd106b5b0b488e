"""Importance resampling, the filter audit and decontamination against brute force, on tables with
null, empty, long and repeated rows, and over the given tables against SQL."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import decontamination, filter_audit, importance, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, n_words long, rank int, h long, mask int, part string"


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def table(spark, rows):
    return spark.createDataFrame([(i, t, l, 1, 2, 3, 4, "p") for i, t, l in rows], SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    vocabulary = ["river", "Stone", "green", "GRÜN", "straße", "and", "of", "the", "x1", "light", "über", "walks"]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, prose(rng.randint(8, 30))) for i in range(12)]
    items += [(20, "one two three"), (21, "Solo"), (22, None), (23, " ?! "), (24, items[0][1]), (24, "another text of the same item id that has a few more words"), (25, items[1][1] + " tail end")]
    rows = [(i, prose(rng.randint(1, 150)), rng.choice(["en", "de", None])) for i in range(60)]
    rows += [(100 + i, prose(30) + ", " + items[i % 12][1].upper().replace("Ü", "ü").replace("SSE", "ße") + ". " + prose(9), "en") for i in range(24)]
    rows += [(200, None, "en"), (201, "", None), (202, None, "de"), (203, "one, TWO; three solo", "de"), (203, "one, TWO; three solo", "de"), (None, rows[3][1], "en"), (None, None, None), (3, rows[4][1], "en"), (204, rows[3][1], "de"), (1, rows[3][1], "en")]
    rows += [(300 + i, items[2][1] + " $ " + items[2][1], "en") for i in range(40)]
    rows.append((500, prose(30_000) + " " + items[3][1] + " " + "ж" * 70_000, "ru"))
    return rows, items


def test_suffix_array_sorts_by_the_first_words():
    rng = random.Random(3)
    texts = [[rng.randrange(4) for _ in range(n)] for n in (0, 30, 1, 2, 17, 0, 3)]
    ids = np.array([w for t in texts for w in t])
    left = np.array([len(t) - i for t in texts for i in range(len(t))])
    for depth in (1, 2, 3, 5):
        order, common = importance.suffix_array(ids, left, depth)
        at = lambda p: tuple(ids[p : p + min(depth, left[p])])
        got = [at(p) for p in order]
        assert got == sorted(map(at, range(len(ids))))
        shared = [0] + [len(os.path.commonprefix([a, b])) for a, b in zip(got, got[1:])]
        assert common.tolist() == shared
        flat = pa.array([f"w{w}" for w in ids])
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        buckets, places = importance.buckets_of(flat, bounds, 1, depth, 1000)
        want = Counter((int(p), zlib.crc32(" ".join(f"w{w}" for w in ids[p : p + n]).encode()) % 1000) for p in range(len(ids)) for n in range(1, depth + 1) if left[p] >= n)
        assert Counter(zip(places.tolist(), buckets.tolist())) == want


def test_importance_equals_brute_force(spark, corpus, monkeypatch):
    monkeypatch.setattr(importance, "BLOCK", 500)
    rows, items = corpus
    b = lambda w: zlib.crc32(w.encode()) % 10_000
    s, t = (Counter(b(w) for *_, x in d for w in words(x)) for d in ([(r[1],) for r in rows], [(i[1],) for i in items]))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda k: math.floor(1000 * math.log((t[k] + 1) * (S + 10_000) / ((s[k] + 1) * (T + 10_000))))
    want = []
    for i, x, _ in rows:
        w = words(x)
        weight = math.floor(sum(gain(b(v)) for v in w) / len(w)) if w else 0
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        want.append([i, len(w), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    drawn = sorted((r for r in want if r[1] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): k for k, r in enumerate(drawn[: len(drawn) // 10], 1)}
    got = importance.op11(spark, table(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(((*r, ranks.get(id(r))) for r in want), key=key)
    none = importance.op11(spark, table(spark, rows).limit(0), spark.createDataFrame(items, "item_id long, text string"))
    assert none.count() == 0
    no_target = importance.op11(spark, table(spark, rows), spark.createDataFrame([], "item_id long, text string"))
    assert no_target.filter("rank is not null").count() == len(drawn) // 10


def test_longer_runs_of_words(spark, corpus):
    rows, _ = corpus
    rows = rows[:40]
    got = importance.features(table(spark, rows).select("doc_id", "text"), ["doc_id"], 1, 3, 50)
    for r in got.collect():
        w = words(dict((i, t) for i, t, _ in rows)[r["doc_id"]])
        assert r["n_words"] == len(w)
        assert Counter(r["buckets"]) == Counter(zlib.crc32(" ".join(w[k : k + n]).encode()) % 50 for n in (1, 2, 3) for k in range(len(w) - n + 1))


def audited(rows, labels):
    split = re.compile(r"[^\x20\x09-\x0D]+")
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    out = {}
    for i, t, lang in rows:
        t = t or ""
        w = split.findall(t)
        fails = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and first[t] < i]
        mask = {f for f, x in zip("ABCDE", fails) if x}
        out.setdefault(lang or "", []).append((mask, labels.get(i, (0, 0))))
    for part, docs in out.items():
        shapley = Counter()
        got = []
        for order in permutations("ABCDE"):
            left = docs
            for k, f in enumerate(order, 1):
                removed = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                shapley[f] += len(removed)
                redundant = sum(f in m and bool(m & set(order[: k - 1])) for m, _ in docs)
                got.append((part, "".join(order), k, len(left), len(removed), redundant, sum(m == {f} for m, _ in docs), sum(g for _, (g, _) in removed), sum(x for _, (_, x) in removed)))
        yield from ((*r, shapley[r[1][r[2] - 1]]) for r in got)


@pytest.mark.parametrize("stretch", [1, filter_audit.STRETCH])
def test_filter_audit_equals_brute_force(spark, corpus, monkeypatch, stretch):
    monkeypatch.setattr(filter_audit, "STRETCH", stretch)
    rows, _ = corpus
    rows = rows + [(600 + i, "A B C " * 50, "fr") for i in range(5)] + [(606, " ".join(map(str, range(120))), "fr")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 320, 2)] + [(4, 1, 0), (None, 1, 1), (301, None, None)]
    known = {}
    for i, g, x in labels:
        if i is not None:
            old = known.get(i, (0, 0))
            known[i] = (max(old[0], int(g == 1)), max(old[1], int(x == 1)))
    table_ = spark.createDataFrame([(i, None if g is None else int(g), None if x is None else int(x)) for i, g, x in labels], "doc_id long, quality int, toxic int")
    got = filter_audit.op12(spark, table(spark, rows).repartition(5), table_)
    assert sorted(map(tuple, got.collect())) == sorted(audited(rows, known))
    assert filter_audit.op12(spark, table(spark, rows).limit(0), table_).count() == 0


def test_equal_hashes_are_told_apart(monkeypatch):
    chain = filter_audit._first_of_each([(1, 5, {"a": 1}, 0, b"x"), (1, 4, {"b": 1}, 0, b"y"), (1, 3, {"a": 1}, 0, b"x"), (1, 3, {"b": 1}, 0, b"x")])
    assert list(chain) == [(1, 5, {"a": 1}, 16, None), (1, 3, {"a": 1, "b": 1}, 0, b"x"), (1, 4, {"b": 1}, 0, b"y")]


def decontaminated(rows, items, window):
    of = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1)) if w else ():
            of.setdefault(tuple(w[k : k + window]), set()).add(i)
    sizes = {len(x) for x in of}
    for i, t, _ in rows:
        w, hit, found = words(t), set(), set()
        for z in sizes:
            for k in range(len(w) - z + 1):
                if x := of.get(tuple(w[k : k + z])):
                    hit |= set(range(k, k + z))
                    found |= x
        yield i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("broadcast", [0, decontamination.BROADCAST])
def test_decontamination_equals_brute_force(spark, corpus, monkeypatch, broadcast):
    monkeypatch.setattr(decontamination, "BROADCAST", broadcast)
    monkeypatch.setattr(decontamination, "PARTS", 4)  # so that shingles are hot
    rows, items = corpus
    docs, bench = table(spark, rows), spark.createDataFrame([(i, t, 0, "w") for i, t in items], "item_id long, text string, h long, window string")
    got = decontamination.op13(spark, docs, bench)
    key = lambda r: tuple((v is None, v or 0) for v in r)
    want = list(decontaminated(rows, items, 10))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert sum(r[5] for r in want) > 60
    for r in decontamination.scan(docs, bench).filter("doc_id >= 100 and doc_id < 112").collect():
        text = words(dict((i, t) for i, t, _ in rows)[r["doc_id"]])
        item = words(dict(items[:12])[r["doc_id"] - 100])
        assert any(" ".join(item) in " ".join(text[s["start"] : s["end"]]) for s in r["spans"]) or len(item) < 10 or "grÜn" in item
        assert all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:]))


def test_decontamination_of_empty_tables(spark, corpus):
    rows, items = corpus
    docs, bench = table(spark, rows[:5]), spark.createDataFrame(items, "item_id long, text string")
    assert decontamination.op13(spark, docs.limit(0), bench).count() == 0
    got = decontamination.op13(spark, docs, bench.limit(0)).collect()
    assert len(got) == 5 and not any(r["contaminated"] or r["n_items"] for r in got)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["op11_importance", "op12_filter_audit"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    rel = con.sql(queries.SQL[name])
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(rel.columns)
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(map(tuple, got.select(*rel.columns).collect()), key=key) == sorted(rel.fetchall(), key=key)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_decontamination_query(spark):
    read = lambda t, c: duckdb.sql(f"select {c} from '{SF}/{t}.parquet'").fetchall()
    want = sorted(decontaminated(read("documents", "doc_id, text, lang"), read("benchmark", "item_id, text"), 10))
    assert sorted(map(tuple, queries.QUERIES["op13_decontamination"](spark, SF).collect())) == want
    assert any(r[5] for r in want)
