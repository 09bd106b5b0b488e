"""Rows that are easily lost: ids on several texts, null ids, clashing columns, hashes that collide,
empty tables; and the operators against brute force on tables built for that."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import common, embedding_dedup, language_id, licenses, mixing, near_dedup, packing, pii, quality_rules, substring_dedup, token_counts

#: Columns of documents and some that operators name their results or inner columns by.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, kept boolean, cell int, class_id long, n_tokens long, spans string, rep long, n_words long, p int, bucket int"
EXTRA = ("x", True, 1, 5, 7, "y", 3, 4, 1, 2)


def table(spark, rows):
    return spark.createDataFrame([(i, t, l, "s", len(t) if t else None, *EXTRA) for i, t, l in rows], SCHEMA)


def thue_morse(a, b, n):
    return [(a, b)[bin(i).count("1") % 2] for i in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(2)
    words = "the house of river green walks under stone with morning light and".split()
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    a, b, c = text(80), text(90), text(70)
    rows = [(1, a, "en"), (2, a, "en"), (2, b, "en"), (2, b, "en"), (None, a, "en"), (None, c, None), (None, None, None), (4, None, "de"), (5, "", "de"), (6, " \n", None), (7, c, "en"), (8, c + " " + b, "en"), (9, "word", "en"), (9, "word", "en"), (10, "ж" * 50_000, "ru"), (11, "a\u0000b �\U0001f600", None)]
    return rows, table(spark, rows)


def operators(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 1), (None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    return {
        "mixing": lambda d: mixing.op1(spark, d, labels),
        "language": lambda d: language_id.op2(spark, d),
        "near": lambda d: near_dedup.op3(spark, d),
        "packing": lambda d: packing.op4(spark, d),
        "licenses": lambda d: licenses.scan(d),
        "quality": lambda d: quality_rules.op6(spark, d, labels),
        "substring": lambda d: substring_dedup.op7(spark, d),
        "tokens": lambda d: token_counts.count_tokens(d, {"▁": -1.0, "a": -2.0}),
        "pii": lambda d: pii.op10(spark, d),
    }


@pytest.mark.parametrize("name", ["mixing", "language", "near", "packing", "licenses", "quality", "substring", "tokens", "pii"])
def test_every_row_comes_back(spark, odd, name):
    rows, d = odd
    op = operators(spark)[name]
    got = Counter(r["doc_id"] for r in op(d).collect())
    assert got == Counter(i for i, *_ in rows)
    assert op(d.limit(0)).count() == 0


@pytest.mark.parametrize("stage", ["language", "near", "pii", "mixing"])
def test_stages_keep_columns(spark, odd, stage):
    rows, d = odd
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (7, 0, 1)], "doc_id long, quality int, toxic int")
    f = {"language": language_id.keep_known, "near": near_dedup.keep_first, "pii": pii.redact, "mixing": lambda d: mixing.draw(d, labels)}[stage]
    got = f(d)
    assert got.columns == d.columns
    assert got.select(*d.columns[5:]).distinct().count() <= 1
    assert f(d.limit(0)).count() == 0
    if stage == "pii":
        assert Counter(r["doc_id"] for r in got.collect()) == Counter(i for i, *_ in rows)
    if stage == "language":
        assert Counter(r["doc_id"] for r in got.collect()) == Counter(i for i, t, _ in rows if re.search(r"[^\W\d_]", t or ""))


def test_near_dedup_tells_rows_apart(spark, odd):
    rows, d = odd
    got = near_dedup.op3(spark, d).collect()
    a, b, c = rows[0][1], rows[2][1], rows[5][1]
    assert Counter(r["class_id"] for r in got if r["doc_id"] in (1, 2)) == {1: 2, 2: 2}
    assert sum(r["kept"] for r in got) == len({t for _, t, _ in rows if (t or "").split()}) + 4
    kept = Counter(r["text"] for r in near_dedup.keep_first(d).collect())
    assert kept[a] == kept[b] == kept[c] == kept["word"] == 1
    # words that cancel out in a polynomial hash: the prints differ, and alignment (140 edits of the
    # 204 allowed) links the texts
    x, y = (" ".join(thue_morse(*w, 1024)) for w in (("foo", "bar"), ("bar", "foo")))
    prints = {(r["f1"], r["f2"]) for r in near_dedup.sketches(table(spark, [(1, x, "en"), (2, y, "en")]).withColumnRenamed("doc_id", "__key")).collect()}
    assert len(prints) == 2
    assert near_dedup.edits_within(*(common.hash_words([t.encode()])[0] for t in (x, y)), 204) == 140


def test_short_texts_lose_no_link(spark):
    """4 of 5 shingles shared (8 against 9 words): similarity exactly 0.8."""
    rng = random.Random(9)
    out = []
    for k in range(300):
        w = [f"w{rng.randrange(10**6)}" for _ in range(9)]
        out += [(2 * k, " ".join(w[:8]), "en"), (2 * k + 1, " ".join(w), "en")]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.op3(spark, table(spark, out)).collect()}
    assert all(got[2 * k + 1] == 2 * k for k in range(300))


def stripped(rows):
    first = {}
    for i, t, *_ in rows:
        w = (t or "").encode("utf-8", "surrogatepass").split()
        for k in range(len(w) - 12):
            if i is not None:
                first[tuple(w[k : k + 13])] = min(first.get(tuple(w[k : k + 13]), i), i)
    out = []
    for i, t, *_ in rows:
        w = (t or "").encode("utf-8", "surrogatepass").split()
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((-1 if i is None else i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_substring_dedup_tells_rows_and_words_apart(spark, odd):
    rows, d = odd
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.op7(spark, d).collect())
    assert got == stripped(rows)
    twelve = [f"w{i}" for i in range(12)]
    ends = ["".join(thue_morse("a", "b", 1024)), "".join(thue_morse("b", "a", 1024))]
    got = substring_dedup.op7(spark, table(spark, [(i, " ".join([*twelve, e]), "en") for i, e in enumerate(ends)])).collect()
    assert [r["n_removed"] for r in got] == [0, 0]


def test_word_hashes_do_not_collide():
    words = {"".join(w) for n in (8, 64, 1024) for w in (thue_morse("a", "b", n), thue_morse("b", "a", n))} | {f"w{i}" for i in range(5000)} | {"a" * n for n in range(1, 200)}
    for seed in (0, 1):
        h, at = common.hash_words([" ".join(sorted(words)).encode()], seed)
        assert len(set(h.tolist())) == len(words) == at[-1]


def test_two_appends_equal_one(spark, tmp_path):
    """An index opened again and fed in parts removes what one batch removes; compaction keeps runs few."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(300)]
    passages = [[rng.choice(words) for _ in range(20)] for _ in range(6)]
    rows = [(i, " ".join([*(rng.choice(words) for _ in range(15)), *rng.choice(passages), *(rng.choice(words) for _ in range(9))]), "en") for i in range(60)]
    found = substring_dedup.windows(table(spark, rows).withColumn("__key", common.F.col("doc_id")))
    one = substring_dedup.FingerprintIndex.open(spark, f"file://{tmp_path}/one", 4)
    whole = sorted(map(tuple, one.append(found).collect()))
    assert whole
    parts, sizes = [], []
    for a, b in ((0, 20), (20, 30), (30, 45), (45, 60)):
        index = substring_dedup.FingerprintIndex.open(spark, f"file://{tmp_path}/parts", 4)
        parts += map(tuple, index.append(found.filter(f"doc_id >= {a} and doc_id < {b}")).collect())
        sizes.append(len(index.runs))
    assert sorted(parts) == whole and max(sizes) <= 3
    index = substring_dedup.FingerprintIndex.open(spark, f"file://{tmp_path}/parts", 4)
    seen = index.read(index.runs[0][0])
    for f, _ in index.runs[1:]:
        seen = seen.unionByName(index.read(f))
    assert sorted(map(tuple, seen.groupBy("wh", "chk").agg(common.F.min("first")).collect())) == sorted(map(tuple, one.read(one.runs[0][0]).collect()))
    one.delete()
    index.delete()


def test_embeddings_equal_brute_force(spark):
    """Cells of 60 vectors: several levels of pivots, guests, copies, ids on two vectors, text labels."""
    rng = np.random.default_rng(1)
    n = 700
    centres = rng.normal(size=(20, 12))
    x = centres[rng.integers(0, 20, n)] + rng.normal(size=(n, 12)) * rng.choice([0.02, 0.1, 0.3], size=(n, 1))
    x[100:140], x[200:220] = x[5], x[6] * 2
    label = ["red" if i < 500 else "blue" for i in range(n)]
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = (unit @ unit.T >= 0.98) & (np.array(label)[:, None] == np.array(label)[None])
    np.fill_diagonal(near, False)
    low = np.arange(n)
    while True:
        new = np.array([min(low[i], low[near[i]].min() if near[i].any() else i) for i in range(n)])
        if (new == low).all():
            break
        low = new
    rows = [(int(i), x[i].tolist(), label[i], 1, 2, 3) for i in range(n)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, cell int, n_links int, rep int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.link(t, cell=60).collect()}
    assert got == {i: (int(near[i].sum()), int(low[i]), bool(low[i] == i)) for i in range(n)}
    assert embedding_dedup.link(t.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, [1.0, 0.0], 2**40), (1, [0.0, 1.0], 2**40), (2, [0.0, 2.0], 2**40), (None, [1.0, 0.0], 2**40), (3, [0.0, -0.0], 2**40), (4, [], 2**40), (5, [None, 1.0], 2**40)], "vec_id long, embedding array<double>, label long")
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0) for r in embedding_dedup.link(twice).collect())
    assert got == [(0, 0, 0), (1, 0, 1), (1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5)]


def base_by_hand(t):
    """The four stated patterns, leftmost and without overlap, failing matches dropped."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((0, *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub(r"\D", "", m[0])
        if 16 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 8 <= len(re.sub(r"\D", "", m[0])) <= 15:
            out.append((3, *m.span()))
    return out


def test_pii_base_spans_equal_patterns():
    rng = random.Random(7)
    for _ in range(4000):
        t = "".join(rng.choice("ab@.-+%_ 0123456789()4") for _ in range(rng.randrange(60)))
        assert pii.base_spans(t) == base_by_hand(t)


def test_pii_learned_kinds(spark):
    """Precision and recall of the added kinds on invented sentences, many names outside the gazetteer."""
    rng = random.Random(5)
    given, family = sorted(pii._GIVEN), ["Smith", "Miller", "Garcia", "Dubois", "Weber", "Rossi", "Novak", "Keller"]
    filler = "the house of river green walks under stone with morning light and kept quiet near old mill".split()
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    rows, truth = [], set()
    for i in range(400):
        text = ""
        for _ in range(3):
            text += " ".join(rng.choices(filler, k=5)) + " "
            name = f"{rng.choice(given) if rng.random() < 0.7 else rng.choice(['Arvo', 'Tamsin', 'Bogdan'])} {rng.choice(family)}"
            before, span, kind, after = rng.choice([
                ("Dr. ", name, 6, ""), ("patient ", name, 6, ""), ("", name, 6, ""),
                ("password: ", "".join(rng.choice("abcdefgh0123456789XYZ") for _ in range(14)) + "7", 4, ""),
                ('api_key = "', "".join(rng.choice("0123456789abcdef") for _ in range(31)) + "1", 4, '"'),
                ("ssn ", f"{rng.randrange(100, 600)}-{digits(2)}-{digits(4)}", 5, ""), ("", f"{rng.randrange(100, 600)}-{digits(2)}-{digits(4)}", 5, ""),
                ("account number ", digits(10), 7, ""), ("The House", "", None, ""), ("ratio: something", "", None, ""), ("on Monday April the total " + digits(4), "", None, ""),
            ])
            if kind:
                truth.add((i, pii.KINDS[kind], len(text) + len(before), len(text) + len(before) + len(span)))
            text += before + span + after + ". "
        rows.append((i, text))
    got = set()
    for r in pii.op10(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got |= {(r["doc_id"], k, int(a), int(b)) for k, a, b in (x.split(":") for x in r["spans"].split(",") if x)}
    for kind in pii.MORE:
        g, w = ({x for x in s if x[1] == kind} for s in (got, truth))
        assert len(g & w) >= 0.95 * len(g) and len(g & w) >= 0.85 * len(w), kind


def test_pii_is_linear():
    import time

    start = time.time()
    text = "Dr. John Smith 123-45-6789 a@b.co " * 6000
    base = pii.base_spans(text)
    assert len(base) == 6000 and len(pii.candidates(text, base)) == 12_000
    assert time.time() - start < 20


def test_reliabilities_find_the_good_labeler():
    """Three labelers of known accuracy on spans of two classes."""
    rng = random.Random(1)
    counts = Counter()
    for _ in range(5000):
        truth = rng.random() < 0.4
        code = 0
        for right in (0.95, 0.8, 0.65):
            vote = 0 if rng.random() < 0.2 else 2 if (rng.random() < right) == truth else 1
            code = code * 3 + vote
        counts[code] += 1
    prior, tables, _ = pii.reliabilities({k: float(v) for k, v in counts.items()})
    assert abs(prior - 0.4) < 0.08
    for j, right in enumerate((0.95, 0.8, 0.65)):
        assert abs(tables[j, 1, 2] / (tables[j, 1, 1] + tables[j, 1, 2]) - right) < 0.08


def test_draw_repeats_scarce_documents(spark):
    """2 % junk and toxic for targets of 5 %: scarce documents stand more than once."""
    rng = random.Random(4)
    good, junk, toxic = "river stone light morning green".split(), "### $$$ %% buy|now click|".split(), "hate vile awful nasty scum".split()
    out = []
    for i in range(3000):
        kind = "junk" if i % 50 == 0 else "toxic" if i % 50 == 1 else "good"
        w = {"good": good, "junk": junk, "toxic": toxic}[kind]
        out.append((i, " ".join(rng.choice(w) for _ in range(60)), kind))
    d = table(spark, out)
    labels = spark.createDataFrame([(i, int(k != "junk"), int(k == "toxic")) for i, _, k in out if i % 3 == 0], "doc_id long, quality int, toxic int")
    drawn = [r["lang"] for r in mixing.draw(d, labels).collect()]
    share = {k: drawn.count(k) / len(drawn) for k in ("good", "junk", "toxic")}
    assert abs(share["good"] - 0.9) < 0.02 and abs(share["junk"] - 0.05) < 0.015 and abs(share["toxic"] - 0.05) < 0.015
    assert drawn.count("good") > 0.97 * 2880
    rows, domains = mixing.mix(d, mixing.domains_of(labels), mixing.TARGETS)
    got = mixing.reached(rows, domains)
    assert all(abs(got[k][1] - mixing.TARGETS[k]) < 1e-5 for k in domains)


def test_mixing_learns_domains_of_long_texts(spark):
    rng = random.Random(3)
    out = [(i, " ".join(rng.choice(["red", "blue", "green"]) for _ in range(40)), "good") for i in range(40)]
    out += [(100 + i, " ".join(rng.choice(["zinc", "iron", "lead"]) for _ in range(6000)), "junk") for i in range(6)]
    labels = spark.createDataFrame([(i, k) for i, _, k in out], "doc_id long, domain string")
    assert mixing.train(table(spark, out), labels).domains == ["good", "junk"]


def test_quality_rules_by_hand(spark):
    """All base columns, and the learned list applied to plain Python statistics."""
    rng = random.Random(10)
    words = [f"w{i}" for i in range(400)]
    out = []
    for i in range(600):
        bad = i % 4 == 0
        w = [rng.choice(words) + ("$$#" if bad and rng.random() < 0.5 else "") for _ in range(80)]
        lines = [" ".join(w[k : k + 10]) for k in range(0, 80, 10)]
        if i % 7 == 0:
            lines += [lines[0], "", lines[0]]
        out.append((i, "\n".join(lines), "en"))
    d = table(spark, out)
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(600)], "doc_id long, quality int, toxic int")
    stats = {r["doc_id"]: r for r in quality_rules.statistics(d).collect()}
    rules = quality_rules.learn(quality_rules.statistics(d), labels)
    assert rules
    got = {r["doc_id"]: r for r in quality_rules.op6(spark, d, labels).collect()}
    for i, t, _ in out:
        r, w = got[i], t.split()
        full = [x for x in t.split("\n") if x.split()]
        c = Counter(zip(w, w[1:], w[2:]))
        cover = {k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)}
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), len(full) - len(set(full)), len(cover))
        s = stats[i].asDict()
        values = {f: (eval(e, {}, s) if s[e.split(" / ")[1]] else 0.0) for f, e in quality_rules.FEATURES.items()}
        reject = any(all((values[q.feature] > q.cut) == q.above for q in rule) for rule in rules)
        assert r["base_failed"] == (len(w) < 50 or 100 * len(cover) > 50 * len(w))
        assert r["kept"] == (not r["base_failed"] and not reject)
    assert sum(got[i]["kept"] != (i % 4 != 0) for i in got if not got[i]["base_failed"]) < 12


def test_license_classifier_on_unseen_variants():
    """Families told from variants that the fit never drew."""
    weights, families, limit = licenses.fit()
    rng = random.Random(99)
    right = wrong = 0
    for f, notices in licenses.NOTICES.items():
        for t in notices:
            for _ in range(5):
                text = " ".join(x for x in t.split() if rng.random() > 0.08)
                z = np.sum([weights[g] for g in [*licenses.ngrams(text), ""] if g in weights], axis=0)
                p = licenses.softmax(z)
                guess = families[int(p.argmax())] if p.max() >= limit else licenses.UNKNOWN
                right, wrong = right + (guess == f), wrong + (guess not in (f, licenses.UNKNOWN))
    assert right >= 0.85 * (right + wrong) and wrong <= 0.1 * 5 * sum(map(len, licenses.NOTICES.values()))


def test_licences_go_by_row(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, under the MIT License"
    rows = [(1, mit, "en"), (1, mit, "en"), (1, "no notice here", "en"), (None, "text\n" + mit, "en"), (None, None, None), (2, "", "en")]
    got = Counter((r["doc_id"], r["n_paragraphs"], r["licenses"]) for r in licenses.scan(table(spark, rows)).collect())
    assert got == Counter([(1, 1, "mit"), (1, 1, "mit"), (1, 0, ""), (None, 1, "mit"), (None, 0, ""), (2, 0, "")])


def test_keys_need_no_digit_elsewhere():
    for t in ("sk-abcdefghijklmnop alone", "sk-abcdefghijklmnop alone 7", "xoxb-aaaaabbbbbccccc", "no ghp_ABCDEFGHIJKLM here"):
        assert any(kind == 4 for kind, *_ in pii._proposed(t)), t


def test_long_spans_are_judged_whole():
    a, b = "x" * 300 + "A" * 100, "x" * 300 + "1" * 100
    assert pii._features(4, a, 0, 400, []) != pii._features(4, b, 0, 400, [])


def test_pii_columns_follow_the_spans(spark):
    rows = [(i, f"mail a{i}@b.org or call +49 170 555 {1000 + i}; token = abcdef0123456789{i:02d} and card 4111 1111 1111 1111") for i in range(60)] + [(70, None), (71, "nothing")]
    for r in pii.op10(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect():
        text = dict(rows)[r["doc_id"]] or ""
        base = ",".join(f"{pii.BASE[k]}:{s}:{e}" for k, s, e in pii.base_spans(text))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert (r["spans"] or "").startswith(base)
        more = [x.split(":") for x in (r["spans"] or "")[len(base) :].strip(",").split(",") if x]
        assert [(k, text[int(s) : int(e)]) for k, s, e in more] == ([("secret", f"abcdef0123456789{r['doc_id']:02d}")] if r["doc_id"] < 60 else [])


def test_pivots_are_drawn_for_small_cells(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    rows = [(i, "a", (centres[i % 12] + rng.normal(size=16) * 0.05).tolist()) for i in range(150)]
    d = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")
    vectors = d.select(d["label"].alias("cell"), d["vec_id"].alias("rep"), d["embedding"].alias("v")).selectExpr("cell", "rep", "v", "1L n")
    placed = embedding_dedup.assign(vectors, 0.98, 32)
    assert placed.select("cell").distinct().count() > 1
    assert Counter(r["rep"] for r in placed.filter("own").collect()) == Counter(range(150))
