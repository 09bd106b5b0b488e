"""Every stage of the pipeline against a brute-force version on a small corpus."""

import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from graphloom.llm import common, near_dedup, packing, pii

EN = "the house of river green walks under stone with morning light and quiet field winter road early letter garden window".split()
DE = "der hund und straße über grün nicht morgen haus kalt schnee ist unter garten fenster brief winter feld früh licht".split()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(21)
    rows = []
    for i in range(240):
        junk = i % 6 == 0
        w = [rng.choice(EN if i % 3 else DE) for _ in range(rng.randrange(60, 160))]
        if junk:
            w = [x + rng.choice(["", "$$$", "###"]) for x in w]
        elif i % 11 == 0:
            w[::3] = [rng.choice(["vile", "hateful", "awful"]) for _ in w[::3]]
        rows.append((i, " ".join(w), "en" if i % 3 else "de"))
    near = rows[7][1].split()
    near[30] = "changed"
    rows += [(300, rows[5][1], "en"), (301, rows[5][1], "en"), (302, " ".join(near), "en"), (303, None, None), (304, "", "de"), (305, "12 34 !!", None), (306, rows[9][1] + " und mehr", None), (306, "a second text with this id, quite another one", "en"), (307, "write to a.b@example.org or +1 (555) 555-1234 now", "en"), (308, "x" * 30_000, "en")]
    path = tmp_path_factory.mktemp("corpus")
    docs = [(i, t, l, "s", len(t) if t is not None else None, 0.5, "z") for i, t, l in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string").write.parquet(str(path / "documents.parquet"))
    labels = [(i, int(i % 6 != 0), int(i % 11 == 0)) for i in range(0, 240, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return rows, str(path)


def key(r):
    return (r["doc_id"], r["text"])


def test_stages_equal_brute_force(spark, corpus):
    rows, path = corpus
    docs = common.load(spark, path, "documents")
    columns, out, before = docs.columns, {}, docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, path), name)
        after = docs.collect()
        out[name] = (before, after)
        before = after
        if name != "packing":
            assert docs.columns == columns

    before, after = out["language_id"]
    assert Counter(map(key, after)) == Counter(key(r) for r in before if re.search(r"[^\W\d_]", r["text"] or ""))
    assert all(r["lang"] in ("en", "de") for r in after)

    before, after = out["near_dedup"]
    words = [common.hash_words([r["text"].encode()])[0] for r in before]
    low = list(range(len(before)))
    for i in range(len(before)):
        for j in range(i):
            if low[i] != low[j] and (np.array_equal(words[i], words[j]) or near_dedup.similar(words[i], words[j])):
                a, b = low[i], low[j]
                low = [min(a, b) if x in (a, b) else x for x in low]
    first = {}
    for r, c in zip(before, low):
        first.setdefault(c, []).append(key(r))
    assert len(after) == len(first)
    assert Counter(map(key, after)) == Counter(min(v) for v in first.values())

    before, after = out["pii"]
    texts = {r["doc_id"]: r["text"] for r in after if r["doc_id"] != 306}
    for r in before:
        if r["doc_id"] != 306 and not pii.candidates(r["text"], pii.base_spans(r["text"])):
            want = r["text"]
            for k, s, e in sorted(pii.base_spans(want), key=lambda x: -x[1]):
                want = want[:s] + f"<{pii.BASE[k].upper()}>" + want[e:]
            assert texts[r["doc_id"]] == want
    assert texts[307] == "write to <EMAIL> or <PHONE> now"
    assert all(r["n_chars"] == len(r["text"]) for r in after)

    before, after = out["mixing"]
    assert set(map(key, after)) <= set(map(key, before))
    good = [r for r in before if r["doc_id"] < 240 and r["doc_id"] % 6 and r["doc_id"] % 11]
    assert len({key(r) for r in good} & set(map(key, after))) >= 0.8 * len(good)

    before, after = out["packing"]
    lengths = Counter(len(r["text"].split()) for r in before)
    tops, _ = packing.boundaries(sorted(lengths.items()))
    assert Counter((r["doc_id"], r["n_tokens"]) for r in after) == Counter((r["doc_id"], len(r["text"].split())) for r in before)
    assert all(r["bucket_len"] == min(t for t in tops if t >= r["n_tokens"]) for r in after)
    assert len({(r["bucket"], r["shard"], r["batch"], r["slot"]) for r in after}) == len(after)


def test_run_and_empty_tables(spark, corpus, tmp_path):
    rows, path = corpus
    assert corpus_pipeline.run(spark, path).count() > 150
    for name in ("documents", "labels"):
        common.load(spark, path, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
