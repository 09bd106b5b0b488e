"""Versions of a durable store: increments, batches, conflicts, roll-back; search in its postings."""

import random
import re
import sqlite3
from functools import partial

import pytest
from pyspark.sql import functions as F

from graphloom.operators import changes, ingest, text
from graphloom.operators.query import QueryError, QueryOptions, query
from graphloom.plans.durable import Durable


def notes(spark, rows):
    return spark.createDataFrame([(p, t, r) for p, (t, r) in rows.items()], "path string, mtime string, raw string").withColumn("mtime", F.col("mtime").cast("timestamp"))


def edges(store):
    return sorted(tuple(r) for r in store.edges.select("source_id", "target_id", "rel_type", F.coalesce("resolved", F.lit("-")), F.coalesce("context", F.lit("-"))).collect())


def tables(snapshot):
    s = snapshot.store
    out = {t: sorted(map(repr, getattr(s, t).collect())) for t in ("nodes", "types", "fields", "contents")}
    out |= {t: sorted(map(repr, snapshot.table(t).collect())) for t in ("files", "chunks", "names", "postings", "lengths")}
    return out | {"edges": edges(s)}


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join")


FIRST = {
    "a.md": ("2020-01-01", '---\ntitle: Alpha\ntypes: [note]\nref: "[[Beta]]"\n---\nsee [[Gamma]] and [[Delta]]: an apple pie'),
    "b.md": ("2020-01-01", "---\ntitle: Beta\nsize: 3\n---\nbody [[alpha]] [[x/c]]"),
    "x/c.md": ("2020-01-01", "---\ntitle: Gamma\n---\nyellow apple"),
}


def test_ten_increments_equal_a_rebuild(spark, tmp_path):
    rng = random.Random(5)
    names = ["Alpha", "Beta", "Gamma", "Delta", "Same"]

    def note():
        return f"---\ntitle: {rng.choice(names)}\ntypes: [{rng.choice(['note', 'task'])}]\nref: \"[[{rng.choice(names)}]]\"\n---\n[[{rng.choice(names)}]] [[n{rng.randrange(12)}]] {rng.choice(['apple', 'pear'])} pie\n"

    now = {f"d/n{i}.md": ("2020-01-01", note()) for i in range(8)}
    snapshot, shape = ingest.create(Durable(spark, str(tmp_path / "store")), notes(spark, now)), set()
    for day in range(2, 12):
        gone = rng.choice(sorted(now))
        now.pop(gone)
        for i in (rng.randrange(12), rng.randrange(12)):
            now[f"d/n{i}.md"] = (f"2020-01-{day:02d}", note())
        touched = rng.choice(sorted(now))
        now[touched] = (f"2020-01-{day:02d}", now[touched][1])
        snapshot, counts = ingest.advance(snapshot, notes(spark, now), compact_after=99)
        shape.add((joins(snapshot.store.edges), joins(snapshot.store.nodes)))
    assert shape == {(1, 1)} and snapshot.version == 11
    fresh = ingest.create(Durable(spark, str(tmp_path / "fresh")), notes(spark, now))
    same = lambda t: {k: v for k, v in tables(t).items() if k != "nodes"}  # noqa: E731  times of touched nodes are those of their content
    assert same(snapshot) == same(fresh)
    packed = snapshot.durable.compact(snapshot)
    before = tables(snapshot)
    assert tables(packed) == before and joins(packed.store.edges) == 0
    again, counts = ingest.advance(packed, notes(spark, now))
    assert again is packed and tuple(counts.first()) == (0, len(now), 0)
    assert packed.durable.expire() == list(range(1, 12))
    assert tables(Durable(spark, packed.durable.root).open()) == before


@pytest.fixture
def first(spark, tmp_path):
    return ingest.create(Durable(spark, str(tmp_path / "store")), notes(spark, FIRST))


def test_only_moved_names_are_resolved_again(spark, first):
    later = FIRST | {"b.md": ("2020-01-02", FIRST["b.md"][1] + " more"), "y/d.md": ("2020-01-02", "---\ntitle: Delta\n---\n")}
    snapshot, _ = ingest.advance(first, notes(spark, later))
    assert {(t, r) for s, t, _, r, _ in edges(snapshot.store) if s == "a.md"} == {("Beta", "b.md"), ("Gamma", "x/c.md"), ("Delta", "y/d.md")}
    void = {(r["node_id"], r["area"]) for r in spark.read.option("basePath", f"{first.durable.root}/void").parquet(f"{first.durable.root}/void/{snapshot.runs['void'][-1]}").collect()}
    assert void == {("b.md", "all"), ("a.md", "edges")}  # b.md kept its names


BATCH = [
    {"op": "create", "title": "Delta", "types": ["task"], "fields": {"owner": "[[Beta]]"}, "body": "apple [[Gamma]]"},
    {"op": "update", "id": "b.md", "title": "Bee", "values": {"size": None, "ref": "[[Delta]]"}, "append": "tail [[Bee]]"},
    {"op": "link", "source": "Delta.md", "target": "Alpha", "rel_type": "wiki-link"},
    {"op": "link", "source": "a.md", "target": "Delta", "rel_type": "ref"},
    {"op": "unlink", "source": "Delta.md", "target": "Gamma", "rel_type": "wiki-link"},
    {"op": "delete", "id": "x/c.md"},
]


def test_batch_is_published_whole(spark, first):
    got = ingest.commit_batch(first, BATCH)
    assert got.version == 2
    want = {
        ("Delta.md", "Beta", "owner", "-"), ("Delta.md", "Alpha", "wiki-link", "a.md"), ("a.md", "Delta", "ref", "Delta.md"), ("a.md", "Gamma", "wiki-link", "-"), ("a.md", "Delta", "wiki-link", "Delta.md"),
        ("b.md", "alpha", "wiki-link", "a.md"), ("b.md", "x/c", "wiki-link", "-"), ("b.md", "Delta", "ref", "Delta.md"), ("b.md", "Bee", "wiki-link", "b.md"),
    }
    assert {x[:4] for x in edges(got.store)} == want and len(edges(got.store)) == len(want)
    assert {(r["node_id"], r["key"]) for r in got.store.fields.collect()} == {("a.md", "ref"), ("b.md", "ref"), ("Delta.md", "owner")}
    assert sorted(r[0] for r in query(got.store, QueryOptions(full_text="tail OR apple", limit=None), "id").collect()) == ["Delta.md", "a.md", "b.md"]
    in_memory = changes.batch(first.store, BATCH)
    assert edges(in_memory) == edges(got.store)
    assert sorted(map(tuple, in_memory.contents.collect())) == sorted(map(tuple, got.store.contents.collect()))


@pytest.mark.parametrize("bad, code", [({"op": "delete", "id": "no.md"}, "NOT_FOUND"), ({"op": "create", "title": "Delta"}, "CONFLICT"), ({"op": "create", "title": "b"}, "CONFLICT"), ({"op": "fly", "id": "a.md"}, "VALIDATION_ERROR"), ({"op": "update", "id": "a.md", "body": "x", "append": "y"}, "VALIDATION_ERROR"), ({"op": "update", "id": "x/c.md", "title": "gone"}, "NOT_FOUND")])
def test_a_failing_operation_changes_nothing(spark, first, bad, code):
    with pytest.raises(QueryError, match="operation 6") as e:
        ingest.commit_batch(first, [*BATCH, bad])
    assert e.value.code == code
    assert first.durable.versions() == [1] and first.durable.open().runs == first.runs


def test_a_failing_write_changes_nothing(spark, first, monkeypatch):
    monkeypatch.setattr(Durable, "_publish", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        ingest.commit_batch(first, BATCH)
    monkeypatch.undo()
    assert first.durable.versions() == [1]
    assert first.durable.files.names("nodes/seg=2") == []  # what was written is gone


def test_two_writers_collide_and_versions_return(spark, first):
    one = ingest.commit_batch(first, [{"op": "create", "title": "One"}])
    with pytest.raises(QueryError) as e:
        ingest.commit_batch(first, [{"op": "create", "title": "Two"}])
    assert e.value.code == "CONFLICT"
    other = Durable(spark, first.durable.root)
    assert other.open().runs == one.runs
    two = ingest.commit_batch(other.open(), [{"op": "create", "title": "Two"}])
    assert {r["title"] for r in two.store.nodes.collect()} == {"Alpha", "Beta", "Gamma", "One", "Two"}
    back = other.roll_back(1)
    assert back.version == 4 and tables(back) == tables(first) == tables(other.open())
    assert {r["title"] for r in other.open(3).store.nodes.collect()} == {"Alpha", "Beta", "Gamma", "One", "Two"}
    with pytest.raises(KeyError):
        other.open(9)


def test_one_plan_for_many_operations(spark, first):
    many = [{"op": "create", "title": f"N {i}", "body": "[[Alpha]]"} for i in range(100)] + [{"op": "link", "source": f"N {i}.md", "target": f"N {i + 1}", "rel_type": "wiki-link"} for i in range(99)]
    few = changes.batch(first.store, many[:1])
    all_ = changes.batch(first.store, many)
    assert joins(all_.edges) == joins(few.edges) and joins(all_.nodes) == joins(few.nodes)
    assert all_.edges.filter(F.col("source_id").startswith("N ") & F.col("resolved").isNotNull()).count() == 199


# ---- search ---------------------------------------------------------------------------------

TEXTS = ["one", "one two", "one three", "one two three", "two three two three", "two one", "three", "four", "", "one two one two threesome", "Élan vital, one-two: THREE!", "a b a b a"]
EXPRESSIONS = ["one", '"one two"', "thr*", '"two thr"*', "(one OR four) AND two", "one NOT (two OR three)", "(one two) OR four", '"a b a"', "one one two", '"one two" OR thr*', "nothing OR four", "nothing", '"one nothing"', "((two)) NOT three"]


@pytest.fixture(scope="module")
def fts():
    con = sqlite3.connect(":memory:")
    try:
        con.execute("create virtual table t using fts5(x, tokenize = \"unicode61 remove_diacritics 0\")")
    except sqlite3.OperationalError:
        pytest.skip("no fts5")
    con.executemany("insert into t(rowid, x) values (?, ?)", list(enumerate(TEXTS, 1)))
    return con


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    t = text.postings(spark.createDataFrame(list(enumerate(TEXTS, 1)), "doc_id long, text string"))
    at = str(tmp_path_factory.mktemp("postings"))
    text.sorted_by_term(t.postings).write.mode("overwrite").partitionBy("folder").parquet(at)
    return text.TextIndex(spark.read.parquet(at), t.lengths)


@pytest.mark.parametrize("expression", EXPRESSIONS)
def test_ranks_equal_fts5(spark, fts, index, expression):
    want = {r[0]: pytest.approx(r[1], abs=1e-9) for r in fts.execute("select rowid, bm25(t) from t where t match ?", (expression,))}
    assert {r["id"]: r["rank"] for r in text.ranked(index, expression).collect()} == want
    d = spark.createDataFrame(list(enumerate(TEXTS, 1)), "doc_id long, text string")
    assert {r[0] for r in text.search(d, expression).collect()} == set(want)


@pytest.mark.parametrize("bad", ["", "(one", "one)", "one (two)", "(one) two", "one OR", "NOT one", "one AND OR two", "()", "a-b", "it's", "*", '"open'])
def test_what_fts5_refuses_is_refused(fts, bad):
    with pytest.raises(text.QuerySyntaxError):
        text.parse(bad)
    if bad:
        with pytest.raises(sqlite3.OperationalError):
            fts.execute("select rowid from t where t match ?", (bad,)).fetchall()


def test_a_search_reads_the_folders_of_its_terms(spark, index):
    plan = text.ranked(index, '"one two" OR élan')._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[.*folder.*(IN \(|INSET )", plan) and "o,other-" in plan.replace(" ", "")
    assert "text" not in plan


def test_search_in_an_empty_index(spark):
    t = text.postings(spark.createDataFrame([], "doc_id long, text string"))
    assert text.ranked(t, "one").count() == 0
    assert text.ranked(t, '""').count() == 0
    null = text.postings(spark.createDataFrame([(1, None), (2, "x")], "doc_id long, text string"))
    assert [r["id"] for r in text.ranked(null, "x").collect()] == [2]


def test_links_follow_updates(spark, first):
    store = first.store
    ids = partial(spark.createDataFrame, schema="node_id string")
    out = changes.update(store, ids([("a.md",)]), values={"ref": ["[[Gamma]]", "[[nobody]]"]}, append="tail [[Beta]]")
    assert {x[:4] for x in edges(out) if x[0] == "a.md"} == {("a.md", "Gamma", "ref", "x/c.md"), ("a.md", "nobody", "ref", "-"), ("a.md", "Gamma", "wiki-link", "x/c.md"), ("a.md", "Delta", "wiki-link", "-"), ("a.md", "Beta", "wiki-link", "b.md")}
    out = changes.update(store, ids([("a.md",)]), values={"ref": None}, body="now [[Beta]] only")
    assert {x for x in edges(out) if x[0] == "a.md"} == {("a.md", "Beta", "wiki-link", "b.md", "now Beta only")}
    out = changes.update(store, ids([("x/c.md",)]), title="Delta")
    assert {(t, r) for s, t, _, r, _ in edges(out) if s == "a.md"} == {("Beta", "b.md"), ("Gamma", "-"), ("Delta", "x/c.md")}
    out = changes.update(store, ids([("x/c.md",)]), title="Beta")  # two of that name now
    assert {(t, r) for s, t, _, r, _ in edges(out) if s == "a.md"} == {("Beta", "-"), ("Gamma", "-"), ("Delta", "-")}
    both, hit = changes.bulk_update(store, ids([("a.md",), ("b.md",), ("no.md",)]), {"ref": "[[Alpha]]"})
    assert {x[:4] for x in edges(both) if x[2] == "ref"} == {("a.md", "Alpha", "ref", "a.md"), ("b.md", "Alpha", "ref", "a.md")}
    assert query(both, QueryOptions(references="Alpha", limit=None), "id").count() == 2
