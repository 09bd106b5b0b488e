"""Validation and coercion of fields against a declared schema."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import to_boolean, wrap_reference
from ..plans.schemas import Schema, declarations, merge, merged_sets
from ..plans.store import GraphStore

#: Observed value types that a declared type accepts (fixed values).
ACCEPTS = {"string": ("string",), "number": ("number",), "date": ("date",), "boolean": ("boolean",), "enum": ("string",), "reference": ("reference",), "list<string>": ("list",), "list<reference>": ("list",)}
LINK = r"^\[\[[^\]]+\]\]$"


@dataclass(frozen=True)
class FieldDef:
    name: str
    type: str
    required: bool = False
    values: tuple[str, ...] = ()


def validate(store: GraphStore, schema_type: str, defs: list[FieldDef]) -> DataFrame:
    """(node_id, key, rule): required, type, enum and reference warnings of a type's nodes."""
    return check(store.types.filter(F.col("schema_type") == schema_type).select("node_id"), store.fields, defs)


def check(nodes: DataFrame, fields: DataFrame, defs: list[FieldDef]) -> DataFrame:
    """(node_id, key, rule) of nodes (node_id), stored or not, whose merged fields are defs. A
    reference is a link as a whole, and so is each item of a list of references."""
    t = nodes.select("node_id")
    # no other keys have rules, and their folders are not read
    f = fields.filter(F.col("key").isin([d.name for d in defs])).join(t, "node_id", "left_semi")
    need = [d.name for d in defs if d.required]
    out = None
    if need:
        want = t.select("node_id", F.explode(F.array(*map(F.lit, need))).alias("key"))
        # distinct are the few that lack something, not all nodes
        out = want.join(f.select("node_id", "key"), ["node_id", "key"], "left_anti").distinct().withColumn("rule", F.lit("required"))
    rule = F.lit(None).cast("string")
    for d in defs:
        bad = F.when(~F.col("value_type").isin(*ACCEPTS[d.type]), "type")
        if d.type == "enum":
            bad = bad.when(~F.col("value_text").isin(*d.values), "enum")
        if d.type == "reference":
            bad = bad.when(~F.col("value_text").rlike(LINK), "reference")
        if d.type == "list<reference>":
            bad = bad.when(F.exists(F.from_json("value_text", "array<string>"), lambda x: ~x.rlike(LINK)), "reference")
        rule = F.when(F.col("key") == d.name, bad).otherwise(rule)
    rows = f.select("node_id", "key", rule.alias("rule")).filter("rule is not null")
    return rows if out is None else out.unionByName(rows)


def validity(store: GraphStore, schema_type: str, defs: list[FieldDef]) -> DataFrame:
    t = store.types.filter(F.col("schema_type") == schema_type).select("node_id")
    bad = validate(store, schema_type, defs).groupBy("node_id").agg(F.count("*").alias("n"))
    return t.join(bad, "node_id", "left").select("node_id", F.col("n").isNull().alias("is_valid"))


def merged_defs(schemas: dict[str, Schema], types: list[str]) -> list[FieldDef]:
    return [FieldDef(k, f.type, f.required, f.values) for k, f in merge(schemas, types).fields.items()]


def check_sets(sets: DataFrame, fields: DataFrame, merged: DataFrame) -> DataFrame:
    """(node_id, key, rule): check() of nodes (node_id, types) whose fields are merged (from
    merged_sets()), as joins: the plan doesn't depend on the number of sets."""
    want = merged.filter("field_type is not null").select("types", "key", "field_type", "required", "values")
    accepts = F.create_map(*[x for t, kinds in ACCEPTS.items() for x in (F.lit(t), F.array(*map(F.lit, kinds)))])
    bad = F.when(~F.array_contains(accepts[F.col("field_type")], F.col("value_type")), "type")
    bad = bad.when((F.col("field_type") == "enum") & ~F.array_contains("values", F.col("value_text")), "enum")
    bad = bad.when((F.col("field_type") == "reference") & ~F.col("value_text").rlike(LINK), "reference")
    items = F.from_json(F.when(F.col("field_type") == "list<reference>", F.col("value_text")), "array<string>")
    bad = bad.when(F.exists(items, lambda x: ~x.rlike(LINK)), "reference")
    have = sets.join(fields.select("node_id", "key", "value_text", "value_type"), "node_id").join(want, ["types", "key"])
    wrong = have.select("node_id", "key", bad.alias("rule")).filter("rule is not null")
    need = sets.join(want.filter("required").select("types", "key"), "types").select("node_id", "key")
    missing = need.join(fields.select("node_id", "key"), ["node_id", "key"], "left_anti").withColumn("rule", F.lit("required"))
    return wrong.unionByName(missing)


def type_sets(types: DataFrame) -> DataFrame:
    """(node_id, types) with the types of each node in order."""
    return types.groupBy("node_id").agg(F.array_sort(F.collect_set("schema_type")).alias("types"))


def validate_all(store: GraphStore, schemas: dict[str, Schema]) -> DataFrame:
    """(node_id, is_valid) of every node: null where none of its types has a schema."""
    sets = type_sets(store.types.filter(F.col("schema_type").isin(list(schemas))))
    merged = merged_sets(sets.select("types").distinct(), declarations(store.nodes.sparkSession, schemas))
    bad = check_sets(sets, store.fields, merged).select("node_id").distinct().withColumn("bad", F.lit(True))
    known = sets.select("node_id").join(bad, "node_id", "left").select("node_id", F.col("bad").isNull().alias("is_valid"))
    return store.nodes.select(F.col("id").alias("node_id")).join(known, "node_id", "left")


def coerce(value: Column, d: FieldDef) -> Column:
    """value_text brought to the declared type where that is possible, else unchanged."""
    if d.type == "number":
        return F.when(F.trim(value).try_cast("double").isNotNull(), F.trim(value)).otherwise(value)
    if d.type == "boolean":
        return F.coalesce(to_boolean(value).cast("string"), value)
    if d.type == "enum":
        return F.coalesce(F.get(F.filter(F.array(*map(F.lit, d.values)), lambda v: F.lower(v) == F.lower(value)), F.lit(0)), value)
    if d.type == "reference":
        return wrap_reference(value)
    if d.type.startswith("list"):
        item = wrap_reference(value) if d.type == "list<reference>" else value
        return F.when(value.startswith("["), value).otherwise(F.to_json(F.array(item)))
    return value
