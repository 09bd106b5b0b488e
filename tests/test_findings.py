"""What the findings of round 3 showed, on small tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from graphloom import catalogue, catalogue_notes
from graphloom.llm import common
from graphloom.llm.substring_dedup import FingerprintIndex
from graphloom.operators import graph, ingest, query, text
from graphloom.plans.durable import Durable
from graphloom.plans.store import GraphStore
from graphloom.sources import notes

SF = "/root/testdata/sf0.001"


def chain(spark, n):
    e = [(f"n{i}", f"n{i + 1}", "r", f"n{i + 1}", None) for i in range(n)]
    make = spark.createDataFrame
    return GraphStore(make([(f"n{i}", f"n{i}") for i in range(n + 1)], "id string, title string"), None, None, make(e, "source_id string, target_id string, rel_type string, resolved string, context string"))


@pytest.mark.parametrize("few", [1_000, 0])
def test_traversal_without_a_bound(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW", few)
    store = chain(spark, 13)
    assert sorted(r["depth"] for r in graph.traverse(store, "n0", None, "both")[0].collect()) == list(range(1, 14))
    assert graph.traverse(store, "n0", 99, "both")[0].count() == 10


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_deep_part_equals_sql(spark, tmp_path):
    """a chain of orders and parts that is longer than ten hops."""
    con = duckdb.connect()
    for f in os.listdir(SF):
        rows = f"select * from '{SF}/{f}'"
        if f == "orders.parquet":
            rows = f"select * replace (i as o_orderkey, if(i = 0, 7, 100 + i) as o_custkey) from (select *, row_number() over (order by o_orderkey) - 1 as i from '{SF}/{f}') where i < 8"
            rows = f"select * exclude (i) from ({rows})"
        if f == "lineitem.parquet":
            rows = f"select * exclude (i) replace (i // 2 as l_orderkey, (i + 1) // 2 as l_partkey) from (select *, row_number() over (order by l_orderkey) - 1 as i from '{SF}/{f}') where i < 16"
        con.sql(f"copy ({rows}) to '{tmp_path}/{f}'")
        con.sql(f"create view {f.split('.')[0]} as select * from '{tmp_path}/{f}'")
    got = catalogue.QUERIES["q_bfs_depth_10"](spark, str(tmp_path)).first()["n"]
    assert got == con.execute(catalogue.SQL["q_bfs_depth_10"]).fetchone()[0] > 10


def test_among_keeps_all_that_are_in(spark, monkeypatch):
    rows = spark.range(-3000, 3000).selectExpr("id as k", "concat('t', id) as t")
    ids = spark.range(-3000, 3000, 7).withColumnRenamed("id", "x")
    want = set(range(-3000, 3000, 7))
    got = {r["k"]: r["t"] for r in common.among(rows, "k", ids).collect()}
    assert want <= set(got) and len(got) < len(want) + 10 and all(t == f"t{k}" for k, t in got.items())
    monkeypatch.setattr(common, "SLOTS", 1 << 16)  # places in two rows of bits, many of them shared
    assert want <= {r["k"] for r in common.among(rows, "k", ids.unionByName(ids)).collect()}
    assert common.among(rows, "k", ids.limit(0)).isEmpty()


def rows_made(df, node):
    """Rows that nodes of a kind handed on in a plan that was run."""
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution()
    df.collect()
    found, todo = 0, [plan.executedPlan()]
    while todo:
        p = todo.pop()
        if p.nodeName().startswith("AdaptiveSparkPlan"):
            p = p.executedPlan()
        if p.nodeName() == node:
            found += p.metrics().apply("numOutputRows").value()
        kids = p.children()
        todo += [kids.apply(i) for i in range(kids.size())]
        if "QueryStage" in p.nodeName():
            todo.append(p.plan())
    return found


def test_only_hot_rows_are_repeated(spark):
    """op7: rows of the other keys do not pass through the explode of the hot ones."""
    left = spark.range(4000).selectExpr("id as x", "if(id < 2000, 7, id) as k")
    right = common.materialize(spark.range(4000).selectExpr("id as k", "if(id = 7, 2000L, 1L) as n", "id * 2 as v"), "right")
    out = common.hot_join(left, right, ["k"], "x", 4000, apart=True)
    assert rows_made(out, "Generate") < 256
    assert {(r["x"], r["v"]) for r in out.collect()} == {(i, 2 * (7 if i < 2000 else i)) for i in range(4000)}


def windows_of(spark, ids):
    return spark.createDataFrame([(w, w, i, i, 0) for i, w in ids], "wh long, chk long, doc_id long, __key long, pos int")


def test_match_leaves_the_index_as_it_is(spark, tmp_path, monkeypatch):
    """op7: the last batch is only held against the index, whose runs have a bucket for each task."""
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "70")
    try:
        index = FingerprintIndex.open(spark, f"file://{tmp_path}/index")
        assert index.buckets == 70
        index.append(windows_of(spark, [(1, 5), (2, 6)]))
        runs, version = list(index.runs), index.version
        hits = index.match(windows_of(spark, [(3, 5), (4, 8), (5, 8), (6, 9)])).collect()
        assert {r["__key"] for r in hits} == {3, 5} and (index.runs, index.version) == (runs, version)
        index.delete()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)


def later_notes(spark):
    rows = [(f"a/{i}.md", f"2000-01-0{1 + i % 3} 00:00:00", f"---\ntitle: N{i}\nkind: {'new' if i % 2 else 'old'}\nto: \"[[N1]]\"\n---\nSee [[N{i + 1}]]\n") for i in range(1, 7)]
    return spark.createDataFrame(rows, "path string, mtime string, raw string")


def test_changes_are_told_without_parsing(spark, monkeypatch):
    """F6, F7, F8: files tell what changed; fields need no body, and links are resolved once."""
    asked = []
    whole = ingest.parsed
    monkeypatch.setattr(ingest, "parsed", lambda notes, parts=("head", "body"): asked.append(parts) or whole(notes, parts))
    now = later_notes(spark)
    index = ingest.build(now.filter("path <> 'a/6.md'").withColumn("raw", F.regexp_replace("raw", "kind: new", "kind: was")))
    out, counts = ingest.incremental(index, now.filter("path <> 'a/2.md'"), strict_hash=True)
    assert counts.first().asDict() == {"indexed": 4, "skipped": 1, "deleted": 1} and not asked
    kinds = {r["node_id"]: r["value_text"] for r in out.table("fields").filter("key = 'kind'").collect()}
    assert kinds == {f"a/{i}.md": "new" if i % 2 else "old" for i in (1, 3, 4, 5, 6)} and set(asked) == {("head",)}
    links = {(r["source_id"], r["target_id"]): r["resolved"] for r in out.store.edges.filter("rel_type = 'wiki-link'").collect()}
    assert links == {(f"a/{i}.md", f"N{i + 1}"): f"a/{i + 1}.md" if i + 1 in (3, 4, 5, 6) else None for i in (1, 3, 4, 5, 6)}


def test_advanced_version_needs_no_batch(spark, monkeypatch):
    """the second version is read without making the third; F4, F5: a batch is not dealt over tasks."""
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    made, dealt = [], []
    monkeypatch.setattr(catalogue_notes.ingest, "commit_batch", lambda *a: made.append(a))
    monkeypatch.setattr(catalogue_notes.ingest, "advance", lambda *a: ("second", None))
    monkeypatch.setattr(catalogue_notes.ingest, "create", lambda *a: "first")
    monkeypatch.setattr(catalogue_notes, "_KEPT", {})
    assert catalogue_notes._advanced(spark, SF) == "second" and not made
    monkeypatch.setattr(text, "dealt", lambda rows, by: dealt.append(by) or rows)
    one = spark.createDataFrame([("a", "x y x")], "node_id string, content_text string")
    assert {(r["term"], tuple(r["positions"])) for r in text.postings(one, "node_id", "content_text", few=True).postings.collect()} == {("x", (0, 2)), ("y", (1,))}
    assert not dealt


@pytest.mark.parametrize("raw", ["---\na: 1\nblock\nb: [x, , y,]\n---\nplain\n# H #\n\n> q\nlazy\n- i\n\n```\n[[h]]\n```\nend\r\n", "---\r\nx: [a]b]\r\n\r---\r\n===\ntext\n===\n", "---\nt: a: b\ne: [x\\y, é]\n----\n---", "no header\n---\n", "---\n---\n"])
def test_quick_ways_of_the_parser(raw):
    m = notes.HEAD.match(raw)
    assert notes.split(raw) == ((m[1], m[2]) if m else (None, raw))
    n = notes.parse("p.md", raw)
    # a list that is not flat by its look, and text that does not begin with a letter, go the long way
    slow = notes.blocks("\n".join(f" {x}" if x[:1].isalpha() else x for x in n.body.split("\n")))
    assert [(b.kind, b.text) for b in slow] == [(b.kind, b.text) for b in n.blocks]


def test_search_is_done_once(spark, monkeypatch):
    """results are written before their labels and fields are looked up."""
    wrote, whole = [], query.written
    monkeypatch.setattr(query, "written", lambda df, tag, by=None: wrote.append(tag) or whole(df, tag, by))
    make = spark.createDataFrame
    types = make([("a", "y"), ("a", "x"), ("b", "x")], "node_id string, schema_type string")
    fields = make([("a", "k", "v", "string", None, None), ("b", "k", "v", "string", None, None)], "node_id string, key string, value_text string, value_type string, value_number double, value_date string")
    out = query.assembled(GraphStore(None, types, fields, None), make([("a", 1.0), ("c", 2.0)], "id string, rank double"))
    assert wrote == ["found"]
    assert {r["id"]: (r["rank"], r["types"], r["fields"]) for r in out.collect()} == {"a": (1.0, '["x","y"]', '{"k":{"value":"v","type":"string"}}'), "c": (2.0, None, None)}


def test_loose_fields_meet_by_node_in_all_tasks(spark):
    """no task gets more than its share of the nodes, however few bytes they are, nor all fields of a key."""
    make = spark.createDataFrame
    nodes = [f"o/{i}" for i in range(400)]
    types = make([(n, t) for n in nodes for t in ("order", "task")] + [("c", "customer"), ("bare", "task"), (None, "task")], "node_id string, schema_type string")
    fields = make([(n, k, v) for n in nodes for k, v in (("status", "done"), ("total", "5"), ("due_date", "d"))] + [("c", "status", "x"), ("o/x", "total", "1"), (None, "total", "1")], "node_id string, key string, value_text string")
    rows = catalogue_notes._loose(GraphStore(None, types, fields, None))
    sizes = rows.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 4 and max(r["count"] for r in sizes) < 1000
    assert {(r["node_id"], r["key"]): r["value_text"] for r in rows.collect()} == {(n, k): v for n in nodes for k, v in (("Status", "done"), ("total", " 5"), ("isUrgent", "Yes"), ("project", None), ("labels", None), ("extra", "x"))}
    done, _ = catalogue_notes.coercion.coerce_fields(rows, catalogue_notes._declared(spark))
    assert "hashpartitioning(key" not in done._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning(canonical")[0]


def test_normalising_leaves_links_of_other_fields(spark, tmp_path):
    """F1 of round 4: links are written anew only where a renamed field holds them, fields are read once to tell the rules."""
    head = {"a.md": "status: x\nRef: \"[[b]]\"", "b.md": "status: y\nto: \"[[a]]\"", "c.md": "status: z\nStatus: kept\nref: q"}
    rows = [(p, "2020-01-01", f"---\ntypes: [t]\n{h}\n---\n[[a]]") for p, h in head.items()]
    first = ingest.create(Durable(spark, str(tmp_path / "store")), spark.createDataFrame(rows, "path string, mtime string, raw string").withColumn("mtime", F.col("mtime").cast("timestamp")))
    declared = lambda *keys: spark.createDataFrame([("t", k, "string") for k in keys], "schema_type string, key string, field_type string")
    done, _ = ingest.normalize(first, declared("Status"), apply_=True)
    assert done.runs["edges"] == first.runs["edges"] and done.version == 2
    want = {("a.md", "Status", "x"), ("a.md", "Ref", "[[b]]"), ("b.md", "Status", "y"), ("b.md", "to", "[[a]]"), ("c.md", "status", "z"), ("c.md", "Status", "kept"), ("c.md", "ref", "q")}
    assert {(r["node_id"], r["key"], r["value_text"]) for r in done.store.fields.collect()} == want
    done, _ = ingest.normalize(done, declared("ref"), apply_=True)
    void = {(r["node_id"], r["area"]) for r in spark.read.option("basePath", f"{done.durable.root}/void").parquet(f"{done.durable.root}/void/{done.runs['void'][-1]}").collect()}
    assert void == {("a.md", "fields"), ("a.md", "edges")}
    assert sorted((r["source_id"], r["rel_type"], r["resolved"]) for r in done.store.edges.collect()) == [("a.md", "ref", "b.md"), ("a.md", "wiki-link", "a.md"), ("b.md", "to", "a.md"), ("b.md", "wiki-link", "a.md"), ("c.md", "wiki-link", "a.md")]


def test_batch_shuffles_no_table(spark, tmp_path, monkeypatch):
    """F3, F6 of round 4: the nodes of a batch, and the names that they change, are told where names and links are read."""
    rows = [(f"{i}.md", "2020-01-01", f"---\ntitle: N{i}\n---\n[[N{i + 1}]] [[new.md]]") for i in range(4)]
    first = ingest.create(Durable(spark, str(tmp_path / "store")), spark.createDataFrame(rows, "path string, mtime string, raw string").withColumn("mtime", F.col("mtime").cast("timestamp")))
    plans, whole = {}, ingest.written
    monkeypatch.setattr(ingest, "written", lambda df, tag, by=None: plans.update({tag: df._jdf.queryExecution().executedPlan().toString()}) or whole(df, tag, by))
    got = ingest.commit_batch(first, [{"op": "create", "title": "N4", "path": "new.md"}, {"op": "update", "id": "0.md", "title": "N7"}])
    assert all("SortMergeJoin" not in plans[t] for t in ("moved", "relinked"))
    links = {(r["source_id"], r["target_id"]): r["resolved"] for r in got.store.edges.collect()}
    assert links == {(f"{i}.md", f"N{i + 1}"): ("1.md", "2.md", "3.md", "new.md")[i] for i in range(4)} | {(f"{i}.md", "new.md"): "new.md" for i in range(4)}
    assert got.store.edges.count() == 8
    monkeypatch.setattr(ingest, "FEW", 0)  # a batch that is not few goes the way of an increment
    back = first.durable.roll_back(1)
    much = ingest.commit_batch(back, [{"op": "create", "title": "N4", "path": "new.md"}, {"op": "update", "id": "0.md", "title": "N7"}])
    assert sorted(map(str, much.store.edges.drop("edge_id").collect())) == sorted(map(str, got.store.edges.drop("edge_id").collect()))
