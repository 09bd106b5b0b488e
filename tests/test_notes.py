"""Notes, header patches, schemas, policies, edits, search grammar and streams."""

import json
import sqlite3
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from graphloom.functions import scalar as S
from graphloom.operators import changes, coercion, graph, ingest, text, vector
from graphloom.operators.query import Filter, QueryError, QueryOptions, get_node, query
from graphloom.plans import schemas as C
from graphloom.plans.store import GraphStore
from graphloom.sources import markdown
from graphloom.sources import notes as N
from graphloom.sources.markdown import Patch
from graphloom.streaming import events


def test_header_values():
    got = N.header("a: 1\nb: 'it''s'\nc: \"x \\\"y\\\"\"\nd: 2024-05-06\ne: true\nf:\n  - x\n  - 3\ng: [1, \"b, c\", [[L]]]\nh:\n  k: v\ni: ~\nj: [[One]]\n\"k k\": z # note\nl:")
    day = datetime(2024, 5, 6, tzinfo=timezone.utc)
    assert got == {"a": 1.0, "b": "it's", "c": 'x "y"', "d": day, "e": True, "f": ["x", 3.0], "g": [1.0, "b, c", "[[L]]"], "h": {"k": "v"}, "i": None, "j": "[[One]]", "k k": "z", "l": None}
    assert [N.value_type(v) for v in (got["a"], got["d"], got["e"], got["f"], got["j"], got["b"])] == ["number", "date", "boolean", "list", "reference", "string"]
    assert [N.value_text(v) for v in (1.5, 2.0, day, [1.0, "x"], None, {})] == ["1.5", "2", "2024-05-06T00:00:00.000Z", '[1,"x"]', "null", "[object Object]"]


def test_note_blocks_and_links():
    n = N.parse("a/b.md", "---\ntitle: T\ntypes: note\nref: \"[[X|y]]\"\n---\n# Head [[A]]\n\npara *one*\nwith [[B|b]] `[[no]]`\n\n- item [[C]]\n\n```\n[[hidden]]\n```\n> quoted\n")
    assert (n.title, n.types) == ("T", ["note"])
    assert N.content(n) == "Head A\npara one\nwith b\nitem C\nquoted".replace("with b", "with b ").replace("b \n", "b \n")
    assert N.edges(n) == [("X", "ref", None), ("A", "wiki-link", "Head A"), ("B", "wiki-link", "para one\nwith b "), ("C", "wiki-link", "item C")]
    assert N.parse("x/stem.md", "no header").title == "stem"


def test_notes_of_one_file_are_parsed_in_many_tasks(spark):
    few = spark.range(400).coalesce(1).select(F.concat(F.lit("n/"), F.col("id").cast("string"), F.lit(".md")).alias("path"), F.lit("2000-01-01").alias("mtime"), F.lit("---\nday: 0999-01-02\n---\n[[X]]").alias("raw"))
    got = N.parsed(few).groupBy(F.spark_partition_id()).count().collect()
    assert len(got) == 4 and sum(r["count"] for r in got) == 400
    one = N.parsed(few.limit(1)).first()
    assert [f.asDict() for f in one["fields"]] == [{"key": "day", "value_text": "0999-01-02T00:00:00.000Z", "value_type": "date", "value_number": None, "value_date": "0999-01-02T00:00:00.000Z"}]
    assert [tuple(e) for e in one["edges"]] == [("X", "wiki-link", "X")] and [tuple(c) for c in one["chunks"]] == [(0, None, "X", 2)]
    empty = N.parsed(few.withColumn("raw", F.lit(None).cast("string")).limit(1)).first()
    assert (empty["fields"], empty["edges"], empty["types"]) == ([], [], []) and empty["chunks"][0]["content"] == ""


def test_chunks_split_at_every_depth():
    long = "word " * 200
    n = N.parse("a.md", f"before\n\n## One\n{long}\n### Two\nlast")
    assert [(i, h) for i, h, *_ in N.chunks(n)] == [(0, None), (1, "One"), (2, "Two")]
    assert len(N.chunks(N.parse("a.md", "## One\nshort"))) == 1


def test_chunk_expression(spark):
    long = "word " * 200
    d = spark.createDataFrame([(1, f"## One\n{long}\n## Two\nx"), (2, "## One\nshort"), (3, "")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["chunk_index"], r["heading"]) for r in vector.chunk(d).collect())
    assert got == [(1, 0, "One"), (1, 1, "Two"), (2, 0, None), (3, 0, None)]


@pytest.mark.parametrize(
    "patches, want",
    [
        ([Patch("set", "a", "x$1\\")], '---\na: "x$1\\\\"\nb: [1, 2]\nC: t\n---\nbody a: 1'),
        ([Patch("rename", "C", "c")], "---\na: 1\nb: [1, 2]\nc: t\n---\nbody a: 1"),
        ([Patch("rename", "C", "a")], "---\na: 1\nb: [1, 2]\nC: t\n---\nbody a: 1"),
        ([Patch("wrap", "a"), Patch("wrap", "b"), Patch("wrap", "zz")], "---\na: [1]\nb: [1, 2]\nC: t\n---\nbody a: 1"),
        ([Patch("set", "zz", 1)], "---\na: 1\nb: [1, 2]\nC: t\n---\nbody a: 1"),
    ],
)
def test_patch(spark, patches, want):
    raw = "---\na: 1\nb: [1, 2]\nC: t\n---\nbody a: 1"
    assert spark.range(1).select(markdown.patch(F.lit(raw), patches)).first()[0] == want


def test_patch_at_the_end_of_a_file(spark):
    for raw in ("---\na: 1\n---", "---\na: 1\n---\n", "no header", "---\na: 1\n---\n\nx"):
        assert spark.range(1).select(markdown.patch(F.lit(raw), [Patch("set", "a", 2)])).first()[0] == raw.replace("a: 1", "a: 2")


def test_write_and_read_notes(spark, tmp_path):
    rows = [("a.md", "x"), ("sub/b c.md", "---\nk: v\n---\ny"), (".git/h.md", "no"), ("node_modules/i.md", "no")]
    assert markdown.write_notes(spark.createDataFrame(rows, "path string, raw string"), str(tmp_path)) == 4
    got = {r["path"]: r["raw"] for r in N.read_notes(spark, str(tmp_path)).collect()}
    assert got == {"a.md": "x", "sub/b c.md": "---\nk: v\n---\ny"}
    with pytest.raises(Exception, match="path"):
        markdown.write_notes(spark.createDataFrame([("../x.md", "")], "path string, raw string"), str(tmp_path))


def notes(spark, rows):
    return spark.createDataFrame([(p, datetime(2024, 1, m), r) for p, m, r in rows], "path string, mtime timestamp, raw string")


def test_index_lives(spark):
    first = [("a.md", 1, "---\ntypes: t\nn: 1\n---\n[[b]]"), ("b.md", 1, "to [[a]] and [[c]]"), ("d.md", 1, "x")]
    index = ingest.build(notes(spark, first))
    edges = lambda i: sorted((r["source_id"], r["target_id"], r["resolved"]) for r in i.store.edges.collect())
    assert edges(index) == [("a.md", "b", "b.md"), ("b.md", "a", "a.md"), ("b.md", "c", None)]
    # c comes, a changes, d goes, b is touched only
    later = [("a.md", 2, "---\ntypes: t\nn: 2\n---\n[[c]]"), ("b.md", 2, "to [[a]] and [[c]]"), ("c.md", 2, "new")]
    index, counts = ingest.incremental(index, notes(spark, later))
    assert tuple(counts.first()) == (2, 1, 1)
    assert edges(index) == [("a.md", "c", "c.md"), ("b.md", "a", "a.md"), ("b.md", "c", "c.md")]
    assert [r["value_text"] for r in index.store.fields.collect()] == ["2"]
    assert {r["path"]: r["mtime"].day for r in index.files.collect()} == {"a.md": 2, "b.md": 2, "c.md": 2}
    same, counts = ingest.incremental(index, notes(spark, later))
    assert tuple(counts.first()) == (0, 3, 0) and edges(same) == edges(index)


def test_normalized_lookup(spark):
    d = spark.createDataFrame([("Café – “X”… Y",), (None,)], "t string").select(S.fold_typography(F.col("t")))
    assert [r[0] for r in d.collect()] == ['café - "x"... y', None]
    nodes = spark.createDataFrame([("n/Café.md", "Café"), ("n/x.md", "Same"), ("m/y.md", "Same")], "id string, title string")
    assert graph.resolve_identifier(nodes, "n/Café.md") == {"id": "n/Café.md", "tier": "nfc", "candidates": 0}
    assert graph.resolve_identifier(nodes, "same", "title") == {"id": None, "tier": "exact", "candidates": 2}
    assert graph.resolve_identifier(nodes, "nothing", "title")["id"] is None
    got = {r["target"]: r["resolved"] for r in graph.resolve(spark.createDataFrame([("CAFÉ",), ("same",), ("m/y",)], "target string"), nodes).collect()}
    assert got == {"CAFÉ": "n/Café.md", "same": None, "m/y": "m/y.md"}


EXPRESSIONS = ["one NOT two three", "one two NOT three", "one OR two three", "one NOT two OR three", "one AND two NOT three", '"one two" OR three', "thr*", "one NOT three NOT two", "two OR one NOT three"]


@pytest.mark.parametrize("expression", EXPRESSIONS)
def test_search_grammar_equals_fts5(spark, expression):
    texts = ["one", "one two", "one three", "one two three", "two three", "two one", "three", "four"]
    con = sqlite3.connect(":memory:")
    try:
        con.execute("create virtual table t using fts5(x)")
    except sqlite3.OperationalError:
        pytest.skip("no fts5")
    con.executemany("insert into t(rowid, x) values (?, ?)", list(enumerate(texts, 1)))
    want = sorted(r[0] for r in con.execute("select rowid from t where t match ?", (expression,)))
    d = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    assert sorted(r[0] for r in text.search(d, expression).collect()) == want


def test_search_errors(spark):
    for bad in ("", "AND one", "one OR", '"open'):
        with pytest.raises(text.QuerySyntaxError):
            text.parse(bad)
    d = spark.createDataFrame([(1, "it's one")], "doc_id long, text string")
    assert text.bm25(d, ["it's'"]).count() == 0


RAW = [
    {"name": "base", "fields": {"status": {"type": "enum", "values": ["a", "b"]}, "x": {"type": "string", "required": True}}, "serialization": {"filename_template": "base/{{title}}.md"}},
    {"name": "child", "extends": "base", "fields": {"x": {"type": "number"}}},
    {"name": "other", "fields": {"status": {"type": "enum", "values": ["b", "c"], "required": True}, "x": {"type": "date"}}, "serialization": {"frontmatter_fields": ["x", "status"]}},
]


def test_schemas():
    s = C.from_definitions(RAW)
    assert s["child"].fields["x"].type == "number" and s["child"].template is None and s["child"].ancestors == ["base"]
    m = C.merge(s, ["other", "base"])
    assert m.fields["status"] == C.Field("enum", True, values=("a", "b", "c")) and "x" not in m.fields
    assert m.conflicts == [("x", (("base", "string"), ("other", "date")))]
    assert "x" in C.merge(s, ["base", "child", "other"]).fields  # gone with the second, back with the third
    assert C.merge(s, ["nosuch"]).conflicts == [("", (("nosuch", ""),))]
    assert C.field_order(s, ["other", "base"]) == ["x", "status"]
    for bad in ([{"fields": {}}], [{"name": "a"}, {"name": "a"}], [{"name": "a", "extends": "b"}], [{"name": "a", "extends": "b"}, {"name": "b", "extends": "a"}], [{"name": "a", "fields": {"k": {"type": "odd"}}}]):
        with pytest.raises(C.SchemaError):
            C.from_definitions(bad)


def test_schema_files(tmp_path):
    for raw in RAW:
        (tmp_path / f"{raw['name']}.json").write_text(json.dumps(raw))
    (tmp_path / "_global.json").write_text(json.dumps({"fields": {"due": {"type": "date", "canonical_name": "due_date"}}}))
    assert list(C.load(str(tmp_path))) == ["base", "child", "other"]
    assert C.load_globals(str(tmp_path))["due"].canonical == "due_date" and C.load(str(tmp_path / "none")) == {}
    got = C.update_file(str(tmp_path), "base", [{"action": "rename_field", "field": "status", "to": "state"}, {"action": "add_field", "field": "n", "definition": {"type": "number"}}, {"action": "set_metadata", "key": "icon", "value": "i"}])
    assert list(got["base"].fields) == ["state", "x", "n"] and got["base"].icon == "i"
    before = (tmp_path / "base.json").read_text()
    for op in ({"action": "add_field", "field": "e", "definition": {"type": "enum"}}, {"action": "set_metadata", "key": "name", "value": "z"}, {"action": "set_metadata", "key": "extends", "value": "nosuch"}, {"action": "remove_field", "field": "nosuch"}):
        with pytest.raises(C.SchemaError):
            C.update_file(str(tmp_path), "base", [op])
    assert (tmp_path / "base.json").read_text() == before
    made = C.generate([("base", "status", "enum", 1.0, ["b", "z"]), ("base", "new", "number", 0.5, []), ("meeting-note", "k", "string", 1.0, [])], {"base": None, "meeting-note": "m/{{title}}.md"}, existing=C.from_definitions(RAW))
    assert made["base"]["fields"]["status"]["values"] == ["a", "b", "z"] and made["meeting-note"]["display_name"] == "Meeting Note"
    assert C.write(str(tmp_path / "out"), made) and list(C.load(str(tmp_path / "out"))) == ["base", "meeting-note"]


def test_policies(tmp_path):
    p = C.read_policies({"enforcement": {"unknown_fields": {"default": "warn", "per_type": {"a": "reject", "b": "strip", "c": "odd"}}, "enum_validation": {"default": "odd"}}})
    assert [C.policy_of(p, "unknown_fields", t) for t in ([], ["b"], ["a", "b"], ["c"])] == ["warn", "strip", "reject", "warn"]
    assert C.policy_of(p, "enum_validation", ["a"]) == "coerce" and C.policy_of(p, "normalize_on_index", []) == "warn"
    assert C.load_policies(str(tmp_path / "none.json")) == C.read_policies(None)


def small(spark):
    make = spark.createDataFrame
    at = datetime(2024, 1, 1)
    return GraphStore(
        make([("a.md", "A", at, at), ("b.md", "B", at, at)], "id string, title string, indexed_at timestamp_ntz, file_mtime timestamp_ntz"),
        make([("a.md", "t")], "node_id string, schema_type string"),
        make([("a.md", "k", "[[B|x]] and [[b]]", "reference", None, None), ("a.md", "n", "1234567.5", "number", 1234567.5, None)], "node_id string, key string, value_text string, value_type string, value_number double, value_date string"),
        make([("a.md", "B", "k", "b.md", None)], "source_id string, target_id string, rel_type string, resolved string, context string"),
        make([("a.md", "see [[B]]"), ("b.md", "")], "node_id string, content_text string"),
    )


def test_edits(spark):
    st = small(spark)
    ids = lambda **q: [r[0] for r in query(st, QueryOptions(**q), "id").collect()]
    assert ids(filters=[Filter("n", "eq", 1234567.5)]) == ["a.md"] and ids(filters=[Filter("k", "gt", "it's")]) == []
    up = changes.update_fields(st, spark.createDataFrame([("a.md",), ("zz.md",)], "node_id string"), {"n": 3, "d": datetime(2024, 2, 3), "l": ["x"]})
    got = {(r["node_id"], r["key"]): (r["value_text"], r["value_type"]) for r in up.collect()}
    assert got[("a.md", "n")] == ("3", "number") and got[("a.md", "d")][1] == "date" and got[("a.md", "l")] == ('["x"]', "list") and ("zz.md", "n") not in got
    ren = changes.rename_node(st, "b.md", "New $1 \\")
    assert {r["value_text"] for r in ren.fields.filter("key = 'k'").collect()} == {"[[New $1 \\|x]] and [[New $1 \\]]"}
    assert {r["content_text"] for r in ren.contents.collect()} == {"see [[New $1 \\]]", ""}
    for call in (lambda: changes.update(st, spark.createDataFrame([("a.md",)], "node_id string"), body="x", append="y"), lambda: changes.rename_node(st, "zz.md", "Z"), lambda: get_node(st, "zz.md"), lambda: query(st, QueryOptions())):
        with pytest.raises(QueryError):
            call()


def test_batch_is_all_or_nothing(spark):
    st = small(spark)
    ok = [{"op": "create", "title": "C", "fields": {"to": "[[A]]"}}, {"op": "update", "id": "C.md", "values": {"n": 1}}, {"op": "unlink", "source": "a.md", "target": "B", "rel_type": "wiki-link"}]
    out = changes.batch(st, ok)
    assert out.nodes.count() == 3 and out.contents.filter("node_id = 'a.md'").first()["content_text"] == "see"
    for bad in ({"op": "create", "title": "A", "path": "a.md"}, {"op": "update", "id": "zz.md", "values": {}}, {"op": "odd"}, {"op": "create", "title": "x", "path": "../x.md"}):
        with pytest.raises(QueryError, match="operation 3"):
            changes.batch(st, [*ok, bad])
    assert st.nodes.count() == 2


def test_file_paths():
    s = C.from_definitions(RAW)
    assert changes.file_path('T: "x"  y', ["child", "base"], {}, s) == "base/T x y.md"
    s["other"].template = "{{date}}/{{ref}}.md"
    assert changes.file_path("T", ["other"], {"date": datetime(2024, 1, 2), "ref": "[[R]]"}, s) == "2024-01-02/R.md"
    with pytest.raises(QueryError):
        changes.file_path("T", ["other"], {}, s)


def test_coercion_of_conflicts_and_globals(spark):
    f = spark.createDataFrame([("a", "Due", "soon", "string"), ("a", "clash", "1", "number"), ("a", "tags", "3", "number"), ("a", "refs", '["x","[[y]]"]', "list")], "node_id string, key string, value_text string, value_type string")
    declared = spark.createDataFrame([("tags", "list<string>", []), ("refs", "list<reference>", [])], "key string, field_type string, values array<string>")
    g = spark.createDataFrame([("due", "reference", [])], "key string, field_type string, values array<string>")
    out, issues = coercion.coerce_fields(f, declared, g, spark.createDataFrame([("clash",)], "key string"))
    assert sorted(tuple(r) for r in out.collect()) == [("a", "clash", "1", "number"), ("a", "due", "[[soon]]", "reference"), ("a", "refs", '["[[x]]","[[y]]"]', "list"), ("a", "tags", "[3]", "list")]
    assert [tuple(r) for r in issues.collect()] == [("a", "clash", "type_conflict", "warning")]


def test_streams_run(spark, tmp_path):
    """Files come and change; each content is applied once, also after a restart."""
    folder, seen = tmp_path / "notes", []
    folder.mkdir()
    (folder / "a.md").write_text("one")
    (folder / "b.md").write_text("two")

    def apply(batch, number):
        seen.extend(sorted((r["path"].rsplit("/", 1)[-1], r["raw"]) for r in batch.collect()))

    for texts in ({}, {}, {"c.md": "three"}):
        for name, t in texts.items():
            (folder / name).write_text(t)
        events.watch(events.note_events(spark, str(folder)), apply, str(tmp_path / "checkpoint")).awaitTermination(60)
    assert seen == [("a.md", "one"), ("b.md", "two"), ("c.md", "three")]
    gone = events.deletions(spark.createDataFrame([("a.md",), ("z.md",)], "path string"), spark.createDataFrame([("a.md",)], "path string"))
    assert [r[0] for r in gone.collect()] == ["z.md"]


def test_debounce_and_once_on_a_stream(spark, tmp_path):
    rows = [("a", "h1", "2024-01-01 00:00:00"), ("a", "h1", "2024-01-01 00:00:10"), ("a", "h2", "2024-01-01 02:00:00"), ("b", "h1", "2024-01-01 00:00:05"), ("z", "h", "2024-01-02 00:00:00")]
    d = spark.createDataFrame(rows, "path string, hash string, at string").selectExpr("path", "hash", "cast(at as timestamp) at")
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    for name, s in (("bursts", events.debounce(read(), "1 minute", "1 hour", "path", "at")), ("once", events.once(read(), ["path", "hash"], "at"))):
        s.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination(60)
    assert sorted((r["path"], r["n"]) for r in spark.table("bursts").collect()) == [("a", 1), ("a", 2), ("b", 1)]
    assert sorted((r["path"], r["hash"]) for r in spark.table("once").collect()) == [("a", "h1"), ("a", "h2"), ("b", "h1"), ("z", "h")]
