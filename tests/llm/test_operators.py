"""Corpus operators on small tables: brute force, and null, empty, long, repeated and odd rows."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import embedding_dedup, language_id, licenses, mixing, near_dedup, packing, pii, quality_rules, substring_dedup, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


def rows():
    rng = random.Random(1)
    en = ["the", "house", "of", "river", "green", "walks", "under", "stone", "with", "morning", "light", "and"]
    de = ["der", "hund", "und", "straße", "über", "grün", "nicht", "morgen", "haus", "kalt", "schnee", "ist"]
    out = []
    for i in range(40):
        t = prose(rng, 120, en if i % 2 else de)
        out.append((i, t, "en" if i % 2 else "de"))
    out += [(50, None, "en"), (51, "", None), (52, "  \n\t ", None), (53, "!!! 123 ???", None), (54, out[3][1], "en"), (55, out[3][1].replace("river", "lake", 1), "en"), (56, "hi", "en"), (56, "hi", "en")]
    out.append((57, "x" * 300_000 + " " + prose(rng, 2000, en), "en"))
    return [(i, t, l, "s", len(t) if t else None, 0.5) for i, t, l in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 3 != 0, i % 5 == 0) for i in range(40)], "doc_id long, quality boolean, toxic boolean").selectExpr("doc_id", "cast(quality as int) quality", "cast(toxic as int) toxic")


def test_language_id(spark, docs):
    got = {r["doc_id"]: r for r in language_id.op2(spark, docs).collect()}
    assert all(got[i]["lang_pred"] == ("en" if i % 2 else "de") for i in range(40))
    assert all(got[i]["lang_pred"] == "und" for i in (50, 51, 52, 53))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language_id.op2(spark, docs.limit(0)).count() == 0


def test_phrases_match_plain_parse():
    """Whole texts, longer than many blocks, copies of the training text among them."""
    import numpy as np

    rng = random.Random(4)
    for letters, size in (("ab", 60), ("abc", 900), ("abcde", 3000)):
        train = prose(rng, size // 4, ["".join(rng.choice(letters) for _ in range(k)) for k in (2, 3, 5)])
        alphabet = language_id.Alphabet.learn([train])
        a = language_id.Automaton(alphabet.codes(train), alphabet.size)
        texts = [prose(rng, n, ["".join(rng.choice(letters + "z") for _ in range(k)) for k in (1, 2, 4, 7)]) for n in (0, 1, 80, 4000)] + [train * 3, train[7:], train]
        want = []
        for text in texts:
            n = at = 0
            while at < len(text):
                end = at + 1
                while end < len(text) and text[at] in train and text[at : end + 1] in train:
                    end += 1
                n, at = n + 1, end
            want.append(n)
        codes = [alphabet.codes(t) for t in texts]
        starts = np.concatenate([[0], np.cumsum([len(c) for c in codes])])
        flat = np.concatenate([*codes, [0]]).astype(np.int64)
        assert language_id.phrases(a, language_id.Blocks(flat, starts)).tolist() == want


def test_language_sample_holds_every_language(spark):
    """One language is one text on 3,000 rows, one has only a very long text."""
    rng = random.Random(8)
    en = ["the", "house", "of", "river", "green", "walks", "under", "stone"]
    out = [(3 * i, "der hund und die straße sind kalt und der schnee ist nicht warm", "de") for i in range(3000)]
    out += [(3 * i + 1, prose(rng, 60, en), "en") for i in range(60)]
    out += [(100_002, prose(rng, 20_000, ["casa", "perro", "calle", "fría", "nieve", "mañana"]), "es")]
    out += [(100_005, "der schnee ist kalt", None), (100_008, prose(rng, 30, ["casa", "nieve", "perro"]), None)]
    d = spark.createDataFrame([(i, t, l, "x", 0.5) for i, t, l in out], "doc_id long, text string, lang string, lang_pred string, score double")
    model = language_id.train(d)
    assert model.langs == ["de", "en", "es"]
    kept = {r["doc_id"]: r for r in language_id.keep_known(d).collect()}
    assert kept[100_005]["lang"] == "de" and kept[100_008]["lang"] == "es" and kept[100_008]["score"] == 0.5 and kept[0]["lang_pred"] == "x"
    assert len(kept) == len(out)


def test_quality_rules(spark, docs, labels):
    got = {r["doc_id"]: r for r in quality_rules.op6(spark, docs, labels).collect()}
    for i, t, *_ in rows():
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        c = Counter(zip(w, w[1:], w[2:]))
        cover = {k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)}
        r = got[i]
        assert (r["n_words"], r["n_repeat_words"], r["word_chars"]) == (len(w), len(cover), sum(map(len, w)))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(cover) > 50 * len(w))


def test_substring_dedup(spark, docs):
    got = {r["doc_id"]: r for r in substring_dedup.op7(spark, docs).collect()}
    first = {}
    for i, t, *_ in sorted(rows(), key=lambda r: r[0]):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first.setdefault(tuple(w[k : k + 13]), i) < i:
                gone[k : k + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert substring_dedup.op7(spark, docs.limit(0)).count() == 0


def test_near_dedup(spark, docs):
    rows_ = near_dedup.op3(spark, docs).collect()
    got = {r["doc_id"]: r for r in rows_}
    assert got[54]["class_id"] == got[55]["class_id"] == got[3]["class_id"] == 3
    assert sorted(r["doc_id"] for r in rows_ if r["kept"]) == sorted(i for i in got if i not in (54, 55))
    assert near_dedup.keep_first(docs).columns == docs.columns


def test_edits():
    import numpy as np

    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(3) for _ in range(rng.randrange(12))] for _ in range(2))
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(d[j] + 1, new[-1] + 1, d[j - 1] + (x != y)))
            d = new
        assert near_dedup.edits_within(np.array(a), np.array(b), 20) == d[-1]
        assert near_dedup.edits_within(np.array(a), np.array(b), d[-1] - 1) is None


def test_embeddings(spark):
    t = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.1], 1), (4, [1.0, 0.0], 2), (5, None, 1), (6, [0.0, 0.0], 1), (7, [float("nan"), 1.0], 1), (8, [1.0, 0.0], None), (9, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.link(t).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 9: (3, 1), **{i: (0, i) for i in (4, 5, 6, 7, 8)}}


def test_pii(spark):
    t = "mail a.b@c-d.org, ip 10.0.0.1, bad 300.1.1.1, +1 (555) 555-1234, 4111 1111 1111 1111"
    d = spark.createDataFrame([(1, t, len(t)), (2, None, None), (3, "", 0), (4, "clean text with 12 words", 24)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: r for r in pii.op10(spark, d).collect()}
    assert [got[1][f"n_{k}"] for k in pii.BASE] == [1, 1, 1, 1]
    assert got[2]["spans"] == got[3]["spans"] == got[4]["spans"] == ""
    red = {r["doc_id"]: r for r in pii.redact(d).collect()}
    assert red[1]["text"] == "mail <EMAIL>, ip <IP>, bad 300.1.1.1, <PHONE>, <CARD>" and red[1]["n_chars"] == len(red[1]["text"])
    assert red[4]["text"] == "clean text with 12 words"


def test_mixing(spark, docs, labels):
    rows_, domains = mixing.mix(docs, mixing.domains_of(labels), {"good": 0.5, "junk": 0.25, "toxic": 0.25})
    got = rows_.collect()
    total = sum(r["n_tokens"] for r in got)
    for k, d in enumerate(domains):
        assert abs(sum(r["rate"] * r["n_tokens"] * r["p"][k] for r in got) / total - {"good": 0.5}.get(d, 0.25)) < 1e-3
    assert all(r["rate"] >= 0 for r in got)


def test_packing(spark, docs):
    got = packing.op4(spark, docs).collect()
    assert len(got) == len(rows())
    assert all((r["bucket"] is None) == (r["n_tokens"] == 0) for r in got)
    at = sorted(((r["bucket"], r["shard"], r["batch"], r["slot"]) for r in got if r["bucket"] is not None))
    assert len(set(at)) == sum(r["n_tokens"] > 0 for r in got)
    tops = sorted({(r["bucket"], r["bucket_len"]) for r in got if r["bucket"] is not None})
    for r in got:
        if r["n_tokens"]:
            assert r["bucket_len"] == min(t for _, t in tops if t >= r["n_tokens"])
            # a batch holds no more than the budget, and only the last of a shard less than it could
            assert r["slot"] < max(1, packing.BUDGET // r["bucket_len"])


def test_boundaries_equal_brute_force():
    from itertools import combinations

    rng = random.Random(3)
    for _ in range(200):
        xs = sorted(rng.sample(range(1, 30_000), rng.randrange(1, 9)))
        lengths, k = [(x, rng.randrange(1, 5)) for x in xs], rng.randrange(1, 6)
        pads = []
        for q in range(1, min(k, len(xs)) + 1):
            for c in combinations(xs[:-1], q - 1):
                tops = [*c, xs[-1]]
                pads.append((sum(n * (min(t for t in tops if t >= x) - x) for x, n in lengths), q))
        tops, padding = packing.boundaries(lengths, k)
        assert (padding, len(tops)) == min(pads)
        assert padding == sum(n * (min(t for t in tops if t >= x) - x) for x, n in lengths)


def tokens_by_hand(word, pieces):
    text, low = "\u2581" + word, min(pieces.values()) - 10
    best = [(0.0, 0)]
    for i in range(1, len(text) + 1):
        size = len(text[i - 1].encode())
        options = [(best[i - 1][0] + size * low, best[i - 1][1] + size)]
        options += [(best[j][0] + pieces[text[j:i]], best[j][1] + 1) for j in range(i) if text[j:i] in pieces]
        best.append(max(options, key=lambda o: (round(o[0], 9), -o[1])))
    return best[-1][1]


def test_token_counts(spark):
    rng = random.Random(6)
    pieces = {"\u2581": -3.0, "\u2581a": -1.0, "b": -2.0, "ab": -1.5, "\u2581ab": -4.0, "c": -2.0, "abc": -2.5, "bc": -3.1}
    t = token_counts.TokenTrie(pieces)
    assert (t.count(b"ab"), t.count(b"abc"), t.count(b"a"), t.count("ß".encode())) == (2, 2, 1, 3)
    words = sorted({"".join(rng.choice("abcß") for _ in range(rng.randrange(1, 9))) for _ in range(300)}, key=str.encode)
    t = token_counts.TokenTrie(pieces)
    assert [t.count(w.encode()) for w in words] == [tokens_by_hand(w, pieces) for w in words]
    assert t.made <= len({("\u2581" + w)[:k] for w in words for k in range(1, len(w) + 2)})  # once for each prefix
    long = "".join(rng.choice("abc") for _ in range(token_counts.LONG + 500))
    texts = [" ".join(rng.choices(words, k=50)) for _ in range(20)] + [None, "", " \n", "ab " + long, "ab\u00a0c"]
    d = spark.createDataFrame([(i if i != 7 else None, x, 1) for i, x in enumerate(texts)] + [(3, texts[3], 1), (3, "ab", 1)], "doc_id long, text string, n_tokens int")
    want = sorted((i if i != 7 else -1, len((x or "").encode().split()), sum(tokens_by_hand(w.decode(), pieces) for w in (x or "").encode().split() if len(w) < 1000)) for i, x in [*enumerate(texts), (3, texts[3]), (3, "ab")])
    for known in (5, 100_000):
        got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_pretokens"], r["n_tokens"]) for r in token_counts.count_tokens(d, pieces, known).collect())
        big = max(r[2] for r in got)
        assert len(long) / 3 < big < len(long)
        assert [r if r[0] != 23 else (23, 2, 2) for r in got] == [w if w[0] != 23 else (23, 2, 2) for w in want]


def test_licenses(spark):
    d = spark.createDataFrame([(1, "x\nReleased under the MIT License."), (2, "A driving license is needed here."), (3, None), (4, "nothing")], "doc_id long, text string")
    assert {r["doc_id"]: r["licenses"] for r in licenses.scan(d).collect()} == {1: "mit", 2: "unknown", 3: "", 4: ""}


MIT = """MIT License

Copyright (c) 2020 A. Writer

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""


def test_wrapped_licenses(spark):
    narrow = "\n".join(re.findall(r"\S.{0,38}(?:\s|$)", GPL.replace("# ", "").replace("3 of", "2 of").replace("\n", " ")))
    texts = [MIT, GPL, BSD, ISC, MIT.split("\n\n")[2] + "\n" + BSD, narrow, GPL.replace("General", "Affero General"), "Some words here.\n" + GPL + "\n#\n# All rights reserved.", "All rights reserved.\nReleased under the MIT License.\nAll rights reserved."]
    names = ["CC BY-SA 4.0", "GPL-3.0", "Apache-2.0", "code under GPLv2 here", "CC BY-NC-SA 4.0", "sent cc by mail"]
    d = spark.createDataFrame(list(enumerate(texts + names)), "doc_id long, text string")
    got = {r["doc_id"]: (r["licenses"], r["n_paragraphs"]) for r in licenses.scan(d).collect()}
    want = [("mit,unknown", 3), ("gpl-3.0", 1), ("bsd", 1), ("isc", 1), ("bsd,mit", 2), ("gpl-2.0", 1), ("unknown", 3), ("gpl-3.0,unknown", 2), ("mit,unknown", 3)]
    want += [("cc-by-sa-4.0", 1), ("gpl-3.0", 1), ("apache-2.0", 1), ("gpl-2.0", 1), ("unknown", 1), ("", 0)]
    assert got == dict(enumerate(want))


def test_near_dedup_large_family(spark):
    """A family around the threshold, larger than SMALL: the classes are those of brute force."""
    from graphloom.llm.common import hash_words

    rng = random.Random(11)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    texts = []
    for _ in range(90):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 6])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    words = [hash_words([t.encode()])[0] for t in texts]
    low = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if low[i] != low[j] and near_dedup.similar(words[i], words[j]):
                a, b = sorted((low[i], low[j]))
                low = [a if x == b else x for x in low]
    docs = spark.createDataFrame(list(enumerate(texts)), "__key long, text string")
    got = {r["__key"]: r["class"] for r in near_dedup.classes(docs).collect()}
    assert got == dict(enumerate(low))
    everything = spark.createDataFrame([(i, i) for i in range(len(texts))], "rep long, c long")
    found = {(r["a"], r["b"]) for r in near_dedup.rare_pairs(everything, docs).collect()}
    assert {(j, i) for i in range(len(texts)) for j in range(i) if near_dedup.similar(words[i], words[j])} <= found


def test_mixing_reaches_targets(spark, recwarn):
    """Soft posteriors and a small favoured share cut many rates at 0; the targets are met all the same."""
    rng = random.Random(5)
    out = []
    for _ in range(3000):
        z = [rng.gauss(0, 1) for _ in range(3)]
        z[rng.choices(range(3), (0.3, 0.5, 0.2))[0]] += 2.5
        e = [2.718281828459045**x for x in z]
        out.append((rng.randrange(10, 500), [x / sum(e) for x in e]))
    t = spark.createDataFrame(out, "n_tokens long, p array<double>").cache()
    domains = ["good", "junk", "toxic"]
    rates = [r["r"] for r in t.select(mixing._rate(mixing.fit_rates(t, domains, mixing.TARGETS)).alias("r")).collect()]
    total = sum(n for n, _ in out)
    for k, d in enumerate(domains):
        assert abs(sum(n * r * p[k] for (n, p), r in zip(out, rates)) / total - mixing.TARGETS[d]) < 1e-6
    assert min(rates) == 0 and not [w for w in recwarn if "mixing" in str(w.message)]
    flat = t.limit(50).selectExpr("n_tokens", "array(0.5D, 0.3D, 0.2D) p").cache()
    with pytest.warns(UserWarning, match="missed by up to"):
        mixing.fit_rates(flat, domains, mixing.TARGETS)


def solved(p, n, w, rounds=400):
    """Projected gradient on the whole vector of rates, all rows at hand."""
    r, total = np.ones(len(p)), n.sum()
    for _ in range(rounds):
        gap = (n * r) @ p / total - w
        if np.abs(gap).max() < mixing.TOLERANCE:
            break
        for active in (r > 0, None):
            active = (r > 0) | (p @ step < 0) if active is None else active
            gram = (p[active] * n[active, None]).T @ p[active] / total
            gram += np.eye(len(w)) * np.trace(gram) / len(w) * mixing.RIDGE
            step = np.linalg.solve(gram, gap)
        trials = [np.maximum(0, r - k * (p @ step)) for k in mixing.LENGTHS]
        left = [(n * t) @ p / total - w for t in trials]
        r = trials[int(np.argmin([g @ np.linalg.solve(gram, g) for g in left]))]
    return r


@pytest.mark.parametrize("shares, sharp", [((0.3, 0.5, 0.2), 0.5), ((0.1, 0.6, 0.3), 2.0), ((0.5, 0.3, 0.2), 6.0)])
def test_rates_equal_a_solver(spark, shares, sharp):
    rng = np.random.default_rng(9)
    z = rng.normal(size=(600, 3))
    z[np.arange(600), rng.choice(3, 600, p=shares)] += sharp
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    n = rng.integers(1, 900, 600)
    t = spark.createDataFrame([(i, int(k), x.tolist()) for i, (k, x) in enumerate(zip(n, p))], "i long, n_tokens long, p array<double>").cache()
    steps = mixing.fit_rates(t, ["good", "junk", "toxic"], mixing.TARGETS)
    got = np.array([r["r"] for r in t.select("i", mixing._rate(steps).alias("r")).orderBy("i").collect()])
    want = solved(p, n.astype(float), np.array([0.9, 0.05, 0.05]))
    assert np.abs(got - want).max() < 1e-5 and np.abs(got - mixing.rate_of(p, steps)).max() < 1e-9
    assert got.min() >= 0 and np.abs((n * got) @ p / n.sum() - [0.9, 0.05, 0.05]).max() < 1e-6


def test_language_id_keeps_every_letter_and_language(spark):
    """70 languages, 1400 letters, some above U+FFFF: each language is told by its own letters."""
    rng = random.Random(3)
    starts = [(0x4E00 if k % 2 else 0x20000) + 20 * k for k in range(70)]
    out = [(100 * k + i, " ".join("".join(chr(s + rng.randrange(20)) for _ in range(3)) for _ in range(30)), f"l{k:02}") for k, s in enumerate(starts) for i in range(9)]
    d = spark.createDataFrame(out, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.op2(spark, d).collect()}
    assert got == {i: l for i, _, l in out}
    letters = "".join(filter(str.isalpha, map(chr, range(0x110000))))
    assert sorted(language_id.Alphabet(letters).lut.tolist())[-len(letters) :] == list(range(2, len(letters) + 2))


def test_mixing_fits_in_the_rows_it_is_given():
    """The driver holds the rows of features once, and what the spread of a column needs besides."""
    rng = np.random.default_rng(5)
    x = rng.random((1000, 200))
    labels = ["a" if v > 0.5 else "b" for v in x[:, 3]]
    tracemalloc.start()
    try:
        c = mixing.fit_classifier(["a", "b"], [], x, labels, rounds=20)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 1.6 * x.nbytes and c.weights.shape == (200, 2)
