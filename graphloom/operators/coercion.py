"""Field names and values brought to what schemas declare, and reports of what that would change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import json_items, number_text, snake_case, spaced, to_boolean, wrap_reference

LINK = r"^\[\[.+\]\]$"


def aliases(keys: DataFrame, known: DataFrame) -> DataFrame:
    """(key, canonical, tier) of distinct keys: the known name (name) it equals (0), equals in other
    case (1), in snake case (2) or with blanks for underscores (3); else itself without a tier.
    Where several known names fit in a tier, the last in order is taken."""
    k = keys.select("key").distinct()
    names = known.select("name").distinct()
    lower = names.groupBy(F.lower("name").alias("n")).agg(F.max("name").alias("name"))
    blank = names.groupBy(F.lower(spaced(F.col("name"))).alias("n")).agg(F.max("name").alias("name"))
    tiers = [
        names.select(F.col("name").alias("n"), "name"),
        lower,
        lower,
        blank,
    ]
    forms = [F.col("key"), F.lower("key"), F.when(snake_case(F.col("key")) != F.col("key"), snake_case(F.col("key"))), F.lower(spaced(F.col("key")))]
    out = k
    for i, (t, form) in enumerate(zip(tiers, forms)):
        out = out.withColumn("n", form).join(F.broadcast(t.select("n", F.col("name").alias(f"t{i}"))), "n", "left").drop("n")
    tier = F.lit(None).cast("int")
    for i in reversed(range(4)):
        tier = F.when(F.col(f"t{i}").isNotNull(), i).otherwise(tier)
    return out.select("key", F.coalesce("t0", "t1", "t2", "t3", "key").alias("canonical"), tier.alias("tier"))


def coerced(value: Column, kind: Column, declared: Column, values: Column) -> Column:
    """The (text, type) of a value of an observed kind as the declared type wants it, unchanged
    where that can't be done. Dates are never made from strings."""
    string = kind.isin("string", "reference")
    linked = F.when(value.rlike(LINK), value).otherwise(F.concat(F.lit("[["), value, F.lit("]]")))
    items = F.transform(json_items(value), lambda x: F.when(x.rlike(LINK), x).otherwise(F.concat(F.lit("[["), x, F.lit("]]"))))
    pair = lambda text, t: F.struct(text.alias("text"), F.lit(t).alias("type") if isinstance(t, str) else t.alias("type"))
    number = F.when(F.trim(value) != "", F.trim(value).try_cast("double"))
    number = F.when(F.isnan(number), None).otherwise(number)
    truth = F.when(F.lower(value).isin("true", "yes", "1"), True).when(F.lower(value).isin("false", "no", "0"), False)
    match = F.get(F.filter(values, lambda v: F.lower(v) == F.lower(value)), F.lit(0))
    same = pair(value, kind)
    one = F.when(kind.isin("number", "boolean"), F.concat(F.lit("["), value, F.lit("]")))
    return (
        F.when((declared == "list<reference>") & (kind == "list"), pair(F.to_json(items), "list"))
        .when((declared == "list<reference>") & string, pair(F.to_json(F.array(linked)), "list"))
        .when(declared.startswith("list") & (kind != "list"), pair(F.coalesce(one, F.to_json(F.array(value))), "list"))
        .when((declared == "reference") & string, pair(linked, "reference"))
        .when((declared == "boolean") & string & truth.isNotNull(), pair(truth.cast("string"), "boolean"))
        .when((declared == "number") & string & number.isNotNull(), pair(number_text(number), "number"))
        .when((declared == "enum") & string & match.isNotNull(), pair(match, kind))
        .otherwise(same)
    )


def rule(declared: Column, kind: Column) -> Column:
    """The name of the rule that changed a value."""
    return F.when(declared.startswith("list") & (kind != "list"), "scalar_to_list").when(declared.isin("reference", "list<reference>"), "reference_wrap").when(declared == "boolean", "boolean_coerce").when(declared == "number", "number_coerce").otherwise("enum_case")


def coerce_fields(fields: DataFrame, declared: DataFrame, global_fields: DataFrame | None = None, conflicted: DataFrame | None = None, unknown: str = "warn", enums: str = "coerce") -> tuple[DataFrame, DataFrame]:
    """fields (node_id, key, value_text, value_type) with known names and coerced values, and the
    issues (node_id, key, policy, severity).

    declared (key, field_type, values) comes before global_fields of the same form; a key of
    conflicted (key) passes with a warning; what nothing declares is kept with a warning, stripped,
    or kept and rejected, as the policy `unknown` says.
    """
    defs = declared.select("key", "field_type", "values")
    if global_fields is not None:
        defs = defs.unionByName(global_fields.select("key", "field_type", "values").join(defs.select("key"), "key", "left_anti"))
    known = defs.select(F.col("key").alias("name"))
    if conflicted is not None:
        known = known.unionByName(conflicted.select(F.col("key").alias("name")))
    names = aliases(fields, known).select("key", "canonical").withColumn("__n", F.count("*").over(Window.partitionBy("canonical")))
    f = fields.select("node_id", "key", "value_text", "value_type").join(F.broadcast(names), "key")
    # two keys that become one: the later in the order of keys holds. Only fields with such keys meet
    both = f.filter("__n > 1").withColumn("__k", F.row_number().over(Window.partitionBy("node_id", "canonical").orderBy(F.desc("key")))).filter("__k = 1").drop("__k")
    f = f.filter("__n = 1").unionByName(both)
    # declarations are as few as schemas name; a shuffle by key would bring all fields of a key to one task
    f = f.select("node_id", F.col("canonical").alias("key"), "value_text", "value_type").join(F.broadcast(defs), "key", "left")
    mark = conflicted.select("key").distinct().withColumn("__c", F.lit(True)) if conflicted is not None else None
    f = f.join(F.broadcast(mark), "key", "left") if mark is not None else f.withColumn("__c", F.lit(None).cast("boolean"))
    new = coerced(F.col("value_text"), F.col("value_type"), F.col("field_type"), F.col("values"))
    f = f.withColumn("__new", F.when(F.col("field_type").isNull(), F.struct(F.col("value_text").alias("text"), F.col("value_type").alias("type"))).otherwise(new))
    clash, lost = F.col("field_type").isNull() & F.col("__c"), F.col("field_type").isNull() & F.col("__c").isNull()
    bad_enum = (F.col("field_type") == "enum") & F.col("value_type").isin("string", "reference") & ~F.exists("values", lambda v: F.lower(v) == F.lower(F.col("value_text")))
    policy = F.when(clash, "type_conflict").when(lost & F.lit(unknown != "strip"), "unknown_fields").when(bad_enum & F.lit(enums != "coerce"), "enum_validation")
    severity = F.when(policy == "unknown_fields", "rejection" if unknown == "reject" else "warning").when(policy == "enum_validation", "rejection" if enums == "reject" else "warning").otherwise("warning")
    issues = f.select("node_id", "key", policy.alias("policy"), severity.alias("severity")).filter("policy is not null")
    kept = f.filter(~lost) if unknown == "strip" else f
    return kept.select("node_id", "key", F.col("__new.text").alias("value_text"), F.col("__new.type").alias("value_type")), issues


def named_in(fields: DataFrame, names: DataFrame, key: str = "key") -> DataFrame:
    """fields whose key is one of names (key), few as they are, in any case; told before fields meet anything else."""
    low = F.broadcast(names.select(F.lower(key).alias("__low")).distinct())
    return fields.join(low, F.lower(fields["key"]) == low["__low"], "left_semi")


def infer_rules(fields: DataFrame, types: DataFrame, declared: DataFrame) -> DataFrame:
    """(action, from_key, to_key, target_type): keys that differ from a declared one in case only,
    and declared lists that are not lists everywhere."""
    d = F.broadcast(declared.select("schema_type", F.col("key").alias("to_key"), "field_type", F.lower("key").alias("low")))
    # declarations are few: fields that none of them can mean are left out before labels are looked up
    both = named_in(fields, declared).select("node_id", F.col("key").alias("from_key"), "value_type", F.lower("key").alias("low")).join(d, "low")
    both = both.filter("from_key <> to_key or (field_type like 'list%' and value_type <> 'list')")
    mine = types.join(F.broadcast(declared.select("schema_type").distinct()), "schema_type", "left_semi")
    both = both.join(mine, ["node_id", "schema_type"], "left_semi")
    none = F.lit(None).cast("string")
    renames = both.filter("from_key <> to_key").select(F.lit("rename_key").alias("action"), "from_key", "to_key", none.alias("target_type"))
    lists = both.filter("field_type like 'list%' and value_type <> 'list'").select(F.lit("coerce_value").alias("action"), F.col("to_key").alias("from_key"), none.alias("to_key"), F.col("field_type").alias("target_type"))
    return renames.unionByName(lists).distinct()


def audit(fields: DataFrame, rules: DataFrame) -> DataFrame:
    """rules with files_affected and the first five files."""
    r = F.broadcast(rules.withColumn("low", F.lower("from_key")))
    f = named_in(fields, rules, "from_key").select("node_id", "key", "value_type", F.lower("key").alias("low"))
    hit = f.join(r, "low").filter("(action = 'rename_key' and key = from_key) or (action = 'coerce_value' and value_type <> 'list')")
    hit = hit.select("action", "from_key", "to_key", "target_type", "node_id")
    cols = ["action", "from_key", "to_key", "target_type"]
    # the rows of a rule are counted where they are. The fifth of the first files of 64 parts is not before the fifth of
    # all, so that only files up to it are put in order, and no rule's files meet in one task
    counts = hit.distinct().groupBy(*cols).agg(F.count("*").alias("files_affected"))
    firsts = hit.groupBy(*cols, F.pmod(F.xxhash64("node_id"), F.lit(64)).alias("part")).agg(F.min("node_id").alias("first"))
    bounds = firsts.groupBy(*cols).agg(F.get(F.sort_array(F.collect_list("first")), F.lit(4)).alias("bound")).alias("b")
    first = hit.alias("h").join(F.broadcast(bounds), [F.col(f"h.{c}").eqNullSafe(F.col(f"b.{c}")) for c in cols])
    first = first.filter("bound is null or node_id <= bound").select(*(f"h.{c}" for c in cols), "node_id").distinct()
    first = first.withColumn("k", F.row_number().over(Window.partitionBy(*cols).orderBy("node_id"))).filter("k <= 5")
    first = first.groupBy(*cols).agg(F.array_join(F.sort_array(F.collect_list("node_id")), ",").alias("sample_files"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in cols]
    return counts.alias("a").join(first.alias("b"), same).select(*(f"a.{c}" for c in cols), "files_affected", "sample_files")


def renamed_to(fields: DataFrame, renames: DataFrame) -> DataFrame:
    """(node_id, __has): the keys that renames (to_key) make which a node has already; nodes without any are left out."""
    have = fields.join(F.broadcast(renames.select(F.col("to_key").alias("key")).distinct()), "key", "left_semi")
    return have.groupBy("node_id").agg(F.collect_set("key").alias("__has"))


def has_renamed() -> Column:
    """Whether a node has the key to_key already, by renamed_to()."""
    return F.coalesce(F.array_contains("__has", F.col("to_key")), F.lit(False))


def normalized(fields: DataFrame, rules: DataFrame) -> DataFrame:
    """fields after the rules: renames (not where the node has the new key), then lists."""
    renames = rules.filter("action = 'rename_key'").select(F.col("from_key").alias("key"), "to_key")
    f = fields.join(F.broadcast(renames), "key", "left").join(renamed_to(fields, renames), "node_id", "left")
    f = f.withColumn("key", F.when(F.col("to_key").isNotNull() & ~has_renamed(), F.col("to_key")).otherwise(F.col("key"))).drop("to_key", "__has")
    lists = rules.filter("action = 'coerce_value'").select(F.col("from_key").alias("key"), F.lit(True).alias("__list")).distinct()
    f = f.join(F.broadcast(lists), "key", "left")
    wrap = F.col("__list") & (F.col("value_type") != "list")
    bare = F.col("value_type").isin("number", "boolean")
    text = F.when(wrap & bare, F.concat(F.lit("["), F.col("value_text"), F.lit("]"))).when(wrap, F.to_json(F.array("value_text"))).otherwise(F.col("value_text"))
    return f.select("node_id", "key", text.alias("value_text"), F.when(wrap, "list").otherwise(F.col("value_type")).alias("value_type"))


def normalize_on_index(fields: DataFrame, types: DataFrame, declared: DataFrame, policy: str) -> tuple[DataFrame, DataFrame]:
    """Before indexing: off leaves fields alone, warn gives the report besides, fix the changed fields."""
    rules = infer_rules(fields, types, declared)
    if policy == "off":
        return fields, rules.limit(0)
    return (normalized(fields, rules) if policy == "fix" else fields), rules


__all__ = ["aliases", "audit", "coerce_fields", "coerced", "infer_rules", "normalize_on_index", "normalized", "rule", "to_boolean", "wrap_reference"]
