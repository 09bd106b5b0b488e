"""Counts, computed fields and value profiles over the long table of fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import dirname, json_items, round2
from ..plans.store import GraphStore


def count_types(store: GraphStore) -> DataFrame:
    return store.types.groupBy("schema_type").agg(F.count("*").alias("n"))


def computed_count(store: GraphStore, schema_type: str, filters: dict[str, str], rel_type: str | None = None) -> DataFrame:
    """(target, n): distinct nodes of a type that link to each target and have the raw field values."""
    return _linked(store, schema_type, filters, rel_type).groupBy(F.col("resolved").alias("target")).agg(F.countDistinct("source_id").alias("n"))


def _linked(store: GraphStore, schema_type: str, filters: dict[str, str], rel_type: str | None) -> DataFrame:
    e = store.edges.filter("resolved is not null")
    if rel_type:
        e = e.filter(F.col("rel_type") == rel_type)
    e = e.join(store.types.filter(F.col("schema_type") == schema_type).select(F.col("node_id").alias("source_id")), "source_id", "left_semi")
    for k, v in filters.items():
        e = e.join(store.fields.filter((F.col("key") == k) & (F.col("value_text") == v)).select(F.col("node_id").alias("source_id")), "source_id", "left_semi")
    return e.select("source_id", "resolved")


def computed_percentage(store: GraphStore, schema_type: str, filters: dict[str, str], numerator: dict[str, str], rel_type: str | None = None) -> DataFrame:
    """(target, pct): numerator keys replace filter values of the same key; 0 without any."""
    base = _linked(store, schema_type, filters, rel_type).groupBy(F.col("resolved").alias("target")).agg(F.countDistinct("source_id").alias("d"))
    top = _linked(store, schema_type, filters | numerator, rel_type).groupBy(F.col("resolved").alias("target")).agg(F.countDistinct("source_id").alias("m"))
    pct = F.when(F.col("d") > 0, round2(F.coalesce("m", F.lit(0)) / F.col("d") * 100)).otherwise(0.0)
    return base.join(top, "target", "full").select("target", pct.alias("pct"))


def value_profile(store: GraphStore, schema_type: str | None = None) -> DataFrame:
    t = store.types if schema_type is None else store.types.filter(F.col("schema_type") == schema_type)
    return store.fields.join(t, "node_id").groupBy("schema_type", "key", "value_type", "value_text").agg(F.count("*").alias("n"))


def field_frequency(store: GraphStore) -> DataFrame:
    """(schema_type, key, n_nodes, frequency): share of a type's nodes that have a field."""
    # a node has a label once and a key once, so that rows are counted where they are
    sizes = store.types.groupBy("schema_type").agg(F.count("*").alias("total"))
    have = store.fields.join(store.types, "node_id").groupBy("schema_type", "key").agg(F.count("*").alias("n_nodes"))
    return have.join(sizes, "schema_type").select("schema_type", "key", "n_nodes", (F.col("n_nodes") / F.col("total")).alias("frequency"))


def dominant_type(store: GraphStore) -> DataFrame:
    """(schema_type, key, value_type): the most frequent value type, ties by name."""
    n = store.fields.join(store.types, "node_id").groupBy("schema_type", "key", "value_type").agg(F.count("*").alias("n"))
    return n.groupBy("schema_type", "key").agg(F.min_by("value_type", F.struct(-F.col("n"), "value_type")).alias("value_type"))


def infer_field_types(store: GraphStore) -> DataFrame:
    """(schema_type, key, field_type): the dominant value type; lists of which each has items, and each
    item holds a link, are list<reference>, others list<string>; strings that all hold a link's beginning
    are reference, few different ones enum."""
    v = store.fields.join(store.types, "node_id").groupBy("schema_type", "key", "value_type", "value_text").agg(F.count("*").alias("n"))
    of = lambda t: F.col("value_type") == t
    link = F.contains(F.col("value_text"), F.lit("[["))
    items = F.when(of("list"), json_items(F.col("value_text")))
    linked = (F.size(items) > 0) & F.forall(items, lambda x: F.contains(x, F.lit("[[")))
    per = v.groupBy("schema_type", "key").agg(
        F.count_if(of("string")).alias("distinct_strings"),
        F.sum(F.when(of("string"), F.col("n")).otherwise(0)).alias("strings"),
        F.coalesce(F.bool_and(F.when(of("string"), link)), F.lit(False)).alias("links"),
        F.coalesce(F.bool_and(F.when(of("list"), F.coalesce(linked, F.lit(False)))), F.lit(False)).alias("link_lists"),
    )
    few = F.col("distinct_strings").between(2, 20) & (F.col("distinct_strings") / F.col("strings") < 0.5)
    kind = F.when(of("list"), F.when(F.col("link_lists"), "list<reference>").otherwise("list<string>")).when(~of("string"), F.col("value_type")).when(F.col("links"), "reference").when(few, "enum").otherwise("string")
    return per.join(dominant_type(store), ["schema_type", "key"]).select("schema_type", "key", kind.alias("field_type"))


#: Share of a type's notes that must lie in one folder, and of those that must begin with a date.
FOLDER_SHARE, DATE_SHARE = 0.8, 0.5


def filename_templates(store: GraphStore) -> DataFrame:
    """(schema_type, template): the folder that most notes of a type lie in, with a date before the
    title where the type has a field `date` and most names there begin with one; else null."""
    at = store.types.select(F.col("node_id").alias("id"), "schema_type").withColumn("dir", dirname(F.col("id")))
    dated = F.substring_index("id", "/", -1).rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}")
    dirs = at.groupBy("schema_type", "dir").agg(F.count("*").alias("n"), F.avg(dated.cast("double")).alias("dated"))
    top = dirs.groupBy("schema_type").agg(F.sum("n").alias("total"), F.min_by(F.struct("dir", "n", "dated"), F.struct(-F.col("n"), "dir")).alias("top"))
    has_date = store.fields.filter("key = 'date'").join(store.types, "node_id").select("schema_type").distinct().withColumn("has", F.lit(True))
    name = F.when(F.coalesce("has", F.lit(False)) & (F.col("top.dated") > DATE_SHARE), "{{date}}-{{title}}.md").otherwise("{{title}}.md")
    folder = F.when(F.col("top.dir") == "", "").otherwise(F.concat("top.dir", F.lit("/")))
    return top.join(has_date, "schema_type", "left").select("schema_type", F.when(F.col("top.n") / F.col("total") >= FOLDER_SHARE, F.concat(folder, name)).alias("template"))


def enum_values(store: GraphStore) -> DataFrame:
    """(schema_type, key, value, n): the values of fields that are inferred to be enums."""
    kinds = infer_field_types(store).filter("field_type = 'enum'").select("schema_type", "key")
    return value_profile(store).filter("value_type = 'string'").join(kinds, ["schema_type", "key"]).select("schema_type", "key", F.col("value_text").alias("value"), "n")


def samples(store: GraphStore, most: int = 10) -> DataFrame:
    """(schema_type, key, values): the most frequent values of each field, as JSON."""
    p = value_profile(store).withColumn("k", F.row_number().over(Window.partitionBy("schema_type", "key").orderBy(F.desc("n"), "value_text"))).filter(F.col("k") <= most)
    return p.groupBy("schema_type", "key").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("k", "value_text"))), lambda x: x["value_text"])).alias("values"))


def discrepancies(store: GraphStore, declared: DataFrame) -> DataFrame:
    """(schema_type, key, issue, detail) between data and declared fields (schema_type, key,
    field_type, values): undefined, absent, type, and enum values on one side only."""
    seen = infer_field_types(store).join(declared.select("schema_type").distinct(), "schema_type", "left_semi")
    d = declared.select("schema_type", "key", F.col("field_type").alias("want"), "values")
    both = seen.join(d, ["schema_type", "key"], "full")
    kind = F.when(F.col("want").isNull(), "undefined").when(F.col("field_type").isNull(), "absent").when(F.col("want") != F.col("field_type"), "type")
    detail = F.when(F.col("want").isNull(), F.col("field_type")).when(F.col("field_type").isNull(), F.col("want")).otherwise(F.concat_ws(" / ", "want", "field_type"))
    out = both.select("schema_type", "key", kind.alias("issue"), detail.alias("detail")).filter("issue is not null")
    enums = both.filter("want = 'enum' and field_type = 'enum'").select("schema_type", "key", "values")
    have = enum_values(store).join(enums.select("schema_type", "key"), ["schema_type", "key"], "left_semi").select("schema_type", "key", "value")
    want = enums.select("schema_type", "key", F.explode("values").alias("value"))
    extra = have.join(want, ["schema_type", "key", "value"], "left_anti").select("schema_type", "key", F.lit("extra value").alias("issue"), F.col("value").alias("detail"))
    missing = want.join(have, ["schema_type", "key", "value"], "left_anti").select("schema_type", "key", F.lit("missing value").alias("issue"), F.col("value").alias("detail"))
    return out.unionByName(extra).unionByName(missing)


def active_projects(store: GraphStore) -> DataFrame:
    """(id, status, total, done): projects whose status is active or missing, with their tasks."""
    p = store.types.filter("schema_type = 'project'").select("node_id").distinct()
    s = store.fields.filter("key = 'status'").select("node_id", F.col("value_text").alias("status"))
    p = p.join(s, "node_id", "left").filter("status is null or status = 'active'").select(F.col("node_id").alias("id"), F.coalesce("status", F.lit("active")).alias("status"))
    tasks = _linked(store, "task", {}, None).distinct().join(s.select(F.col("node_id").alias("source_id"), F.col("status").alias("task_status")), "source_id", "left")
    n = tasks.groupBy(F.col("resolved").alias("id")).agg(F.count("*").alias("total"), F.count_if(F.col("task_status") == "done").alias("done"))
    return p.join(n, "id", "left").select("id", "status", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("done", F.lit(0)).alias("done"))


def task_lists(store: GraphStore, project: str) -> DataFrame:
    """(status, n, id): the tasks that link to a project by any link, a row each, with the number of
    those of the same status."""
    t = _linked(store, "task", {}, None).filter(F.col("resolved") == project).select(F.col("source_id").alias("node_id")).distinct()
    f = store.fields.filter("key = 'status'").select("node_id", F.col("value_text").alias("status"))
    rows = t.join(f, "node_id", "left").select(F.coalesce("status", F.lit("unknown")).alias("status"), F.col("node_id").alias("id"))
    return rows.join(rows.groupBy("status").agg(F.count("*").alias("n")), "status").select("status", "n", "id")


def recent(store: GraphStore, ids: DataFrame | None = None, n: int = 10) -> DataFrame:
    """The n nodes indexed last (of ids (id))."""
    nodes = store.nodes if ids is None else store.nodes.join(ids, "id", "left_semi")
    return nodes.orderBy(F.col("indexed_at").desc(), "id").limit(n).select("id", "indexed_at")


def queue_stats(queue: DataFrame) -> DataFrame:
    """(status, n) of a work queue; pending counts what is pending or being worked on."""
    return queue.groupBy("status").agg(F.count("*").alias("n"))


def shared_fields(store: GraphStore) -> DataFrame:
    """(key, field_type, schema_types): fields that two or more types have with the same type."""
    return infer_field_types(store).groupBy("key", "field_type").agg(F.array_join(F.sort_array(F.collect_set("schema_type")), ",").alias("schema_types"), F.countDistinct("schema_type").alias("n")).filter("n > 1").drop("n")


def status_buckets(store: GraphStore, schema_type: str = "task") -> DataFrame:
    f = store.fields.filter("key = 'status'").select("node_id", F.col("value_text").alias("status"))
    t = store.types.filter(F.col("schema_type") == schema_type).select("node_id")
    return t.join(f, "node_id", "left").groupBy(F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"))


def project_status(store: GraphStore, today: str) -> DataFrame:
    """(project, total, done, pct, overdue) of the tasks that link to each project."""
    wide = store.fields.filter(F.col("key").isin("status", "due_date")).groupBy(F.col("node_id").alias("source_id")).agg(F.max(F.when(F.col("key") == "status", F.col("value_text"))).alias("status"), F.max(F.when(F.col("key") == "due_date", F.substring("value_date", 1, 10))).alias("due"))
    links = _linked(store, "task", {}, None).join(store.types.filter("schema_type = 'project'").select(F.col("node_id").alias("resolved")), "resolved", "left_semi").distinct()
    late = F.coalesce((F.col("due") < today) & ~F.coalesce(F.col("status").isin("done", "cancelled"), F.lit(False)), F.lit(False))
    g = links.join(wide, "source_id", "left").groupBy(F.col("resolved").alias("project")).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "done").alias("done"), F.count_if(late).alias("overdue"))
    return g.select("project", "total", "done", round2(F.col("done") / F.col("total") * 100).alias("pct"), "overdue")


def due_lists(store: GraphStore, today: str) -> DataFrame:
    """(id, due, bucket): overdue, today and the rest of the ISO week, without done and cancelled."""
    from ..functions.scalar import end_of_week

    due = store.fields.filter("key = 'due_date' and value_date is not null").select("node_id", F.substring("value_date", 1, 10).alias("due"))
    status = store.fields.filter("key = 'status'").select("node_id", F.col("value_text").alias("status"))
    week = end_of_week(F.lit(today).cast("date")).cast("string")
    b = F.when(F.col("due") < today, "overdue").when(F.col("due") == today, "today").when(F.col("due") <= week, "week")
    return due.join(status, "node_id", "left").filter("status is null or status not in ('done', 'cancelled')").select(F.col("node_id").alias("id"), "due", b.alias("bucket")).filter("bucket is not null")
