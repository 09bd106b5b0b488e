"""Merged declarations of type sets, validation of all sets in one plan, samples of audits, vector cells."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import aggregate, coercion, quality, text, vector
from graphloom.operators.query import Filter, with_fields
from graphloom.plans import schemas as C
from graphloom.plans.store import GraphStore

RAW = [
    {"name": "a", "fields": {"x": {"type": "string"}, "s": {"type": "enum", "values": ["p", "q"]}, "r": {"type": "reference", "target_type": "a"}, "n": {"type": "number", "required": True}}},
    {"name": "b", "fields": {"x": {"type": "number"}, "s": {"type": "enum", "values": ["q", "z"], "required": True}, "r": {"type": "reference", "target_type": "b"}, "l": {"type": "list<reference>"}}},
    {"name": "c", "extends": "b", "fields": {"x": {"type": "date"}, "n": {"type": "number"}}},
    {"name": "d", "extends": "c", "fields": {"x": {"type": "date"}}},
]


def test_ancestors_from_the_root():
    s = C.from_definitions(RAW)
    assert s["d"].ancestors == ["b", "c"] and s["c"].ancestors == ["b"]


def test_merged_sets_equal_merge(spark):
    schemas = C.from_definitions(RAW)
    sets = [[t for k, t in enumerate("abcd") if i >> k & 1] for i in range(1, 16)] + [["a", "nosuch"]]
    got = C.merged_sets(spark.createDataFrame([(s,) for s in sets], "types array<string>"), C.declarations(spark, schemas)).collect()
    have = {(tuple(r["types"]), r["key"]): (r["field_type"], r["required"], tuple(r["values"])) for r in got if r["field_type"]}
    want = {(tuple(s), k): (f.type, f.required, f.values) for s in sets for k, f in C.merge(schemas, s).fields.items()}
    assert have == want
    conflicts = {(tuple(r["types"]), r["key"]) for r in got if r["conflict"]}
    assert conflicts == {(tuple(s), key) for s in sets for key, _ in C.merge(schemas, s).conflicts if key}


def test_validation_of_all_sets_in_one_plan(spark):
    rng, schemas = random.Random(1), C.from_definitions(RAW)
    nodes = [(f"n{i}", [t for t in "abcde" if rng.random() < 0.4]) for i in range(60)]
    values = {"x": [("t", "string"), ("1", "number"), ("2020", "date")], "s": [("p", "string"), ("y", "string"), ("1", "number")], "r": [("[[K]]", "reference"), ("see [[K]]", "reference")], "n": [("1", "number"), ("one", "string")], "l": [('["[[K]]"]', "list"), ('["K"]', "list")]}
    fields = [(n, k, *(v[0] if rng.random() < 0.85 else rng.choice(v))) for n, _ in nodes for k, v in values.items() if rng.random() < 0.9]
    make = spark.createDataFrame
    store = GraphStore(make([(n,) for n, _ in nodes], "id string"), make([(n, t) for n, ts in nodes for t in ts], "node_id string, schema_type string"), make(fields, "node_id string, key string, value_text string, value_type string"), None)
    got = {r["node_id"]: r["is_valid"] for r in quality.validate_all(store, schemas).collect()}
    want = {}
    for n, ts in nodes:
        known = [t for t in ts if t in schemas]
        bad = quality.check(make([(n,)], "node_id string"), store.fields, quality.merged_defs(schemas, known)).count() if known and int(n[1:]) % 4 == 0 else None
        want[n] = None if not known else "?" if bad is None else bad == 0
    assert set(got) == set(want) and all(w == "?" or got[n] is w for n, w in want.items())
    assert {True, False, None} <= set(got.values())


@pytest.mark.parametrize("value, kind", [('["[[A]]","x [[B]]"]', "list<reference>"), ('["[[A]]","x"]', "list<string>"), ("[]", "list<string>"), ("[1]", "list<string>")])
def test_lists_that_hold_links(spark, value, kind):
    make = spark.createDataFrame
    fields = make([("1", "k", '["[[Z]]"]', "list"), ("2", "k", value, "list")], "node_id string, key string, value_text string, value_type string")
    store = GraphStore(None, make([("1", "t"), ("2", "t")], "node_id string, schema_type string"), fields, None)
    assert [r["field_type"] for r in aggregate.infer_field_types(store).collect()] == [kind]


def test_samples_of_a_rule_with_many_files(spark):
    fields = spark.range(3_000).select(F.format_string("n%05d", F.col("id")).alias("node_id"), F.when(F.col("id") % 3 == 0, "Tag").otherwise("tag").alias("key"), F.lit("v").alias("value_text"), F.lit("string").alias("value_type"))
    types = fields.select("node_id", F.lit("t").alias("schema_type"))
    declared = spark.createDataFrame([("t", "tag", "list<string>")], "schema_type string, key string, field_type string")
    got = {r["action"]: (r["files_affected"], r["sample_files"]) for r in coercion.audit(fields, coercion.infer_rules(fields, types, declared)).collect()}
    assert got["rename_key"] == (1_000, "n00000,n00003,n00006,n00009,n00012")
    assert got["coerce_value"][1] == "n00000,n00001,n00002,n00003,n00004"


def test_nearest_from_cells(spark):
    rng = random.Random(8)
    centres = [[rng.gauss(0, 5) for _ in range(6)] for _ in range(12)]
    rows = [(i, [c + rng.gauss(0, 0.3) for c in rng.choice(centres)]) for i in range(900)] + [(1000 + i, centres[0]) for i in range(5)] + [(2000, None)]
    d = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    index, whole = vector.cells(d), d.filter("embedding is not null")
    assert 20 <= len(index.pivots) <= 30
    for probe, k, most in ((rows[0][1], 5, 12), ([0.0] * 6, 40, 30), (centres[0], 7, 12), ([100.0] * 6, 3, 30), (rows[3][1], 2_000, 30)):
        found, read = vector.nearest(index, probe, k)
        want = [(r["chunk_id"], round(r["distance"], 9)) for r in vector.knn(whole, probe, k).collect()]
        assert [(r["chunk_id"], round(r["distance"], 9)) for r in found.collect()] == want
        assert read <= min(most, len(index.pivots))
    assert vector.nearest(vector.cells(d.limit(0)), [0.0] * 6, 3)[0].count() == 0


def test_search_that_needs_a_thousand_cells(spark):
    n = 1_200
    rows = spark.range(n).select(F.col("id").alias("chunk_id"), F.array(F.col("id").cast("double")).alias("embedding"), F.col("id").cast("int").alias("cell"), F.lit(0.0).alias("reach"))
    index = vector.VectorIndex(rows, np.arange(n, dtype=float)[:, None], np.zeros(n), np.zeros(n), "embedding")
    found, read = vector.nearest(index, [0.0], n)
    assert read == n and [r["chunk_id"] for r in found.collect()] == list(range(n))


def test_words_are_grouped_without_a_row_for_each(spark):
    texts = {i: " ".join(random.Random(i).choice("a b c \u00e4 7x".split()) for _ in range(i * 7)) for i in range(40)} | {40: None, 41: "..", 42: "A a-B"}
    index = text.postings(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    plan = index.postings._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan
    want = {(w, i): [k for k, x in enumerate(words) if x == w] for i, t in texts.items() if t for words in [re.findall(r"[^\W_]+", t.lower())] for w in words}
    got = index.postings.collect()
    assert {(r["term"], r["id"]): r["positions"] for r in got} == want and len(got) == len(want)
    lengths = {r["id"]: r["len"] for r in index.lengths.collect()}
    assert set(lengths) == set(texts) and all(r["len"] == lengths[r["id"]] for r in got) and lengths[42] == 3 and lengths[40] == 0


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def small_store(spark):
    fields = spark.createDataFrame([(i, k, v, t, n, None) for i, k, v, t, n in [("a", "Size", "1", "number", 1.0), ("a", "size", "2", "number", 2.0), ("b", "size", "30", "number", 30.0), ("b", "to", "x", "string", None), ("c", "to", "[[y]]", "reference", None)]], "node_id string, key string, value_text string, value_type string, value_number double, value_date string")
    types = spark.createDataFrame([(i, t) for i in "abcd" for t in ("t", "u")], "node_id string, schema_type string")
    return GraphStore(types.select(F.col("node_id").alias("id")).distinct(), types, fields, None)


def test_one_filter_brings_no_rows_together(spark):
    got = with_fields(small_store(spark), [Filter("size", "lte", 10)])
    assert "Aggregate" not in plan_of(got) and [r["id"] for r in got.collect()] == ["a"]


def test_check_reads_the_keys_with_rules_and_tells_a_lack_once(spark):
    st = small_store(spark)
    got = quality.check(st.types.select("node_id"), st.fields, [quality.FieldDef("to", "reference", True)])
    assert sorted(map(tuple, got.collect())) == [("a", "to", "required"), ("b", "to", "type"), ("d", "to", "required")]
    some = quality.check(st.types.select("node_id"), st.fields, [quality.FieldDef("to", "reference")])
    assert "Aggregate" not in plan_of(some) and "(key" in plan_of(some)


def test_only_keys_that_become_one_meet(spark):
    st = small_store(spark)
    declared = spark.createDataFrame([("size", "number", []), ("to", "reference", [])], "key string, field_type string, values array<string>")
    got, _ = coercion.coerce_fields(st.fields, declared)
    assert sorted((r["node_id"], r["key"], r["value_text"]) for r in got.collect()) == [("a", "size", "2"), ("b", "size", "30"), ("b", "to", "[[x]]"), ("c", "to", "[[y]]")]
    assert "__n" in plan_of(got) and plan_of(got).count("Union") == 1


def test_frequency_counts_rows_where_they_are(spark):
    got = aggregate.field_frequency(small_store(spark))
    assert "distinct" not in plan_of(got).lower()
    assert sorted((r["key"], r["n_nodes"], r["frequency"]) for r in got.filter("schema_type = 't'").collect()) == [("Size", 1, 0.25), ("size", 2, 0.5), ("to", 2, 0.5)]
