"""Structured queries over a graph store: filters, references, full text, order, limit, hydration."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import ascii_lower, decode, strip_reference
from ..plans.shared import written
from ..plans.store import GraphStore
from . import graph, text


class QueryError(ValueError):
    """A request that cannot be answered; code is NOT_FOUND, VALIDATION_ERROR, CONFLICT or INTERNAL_ERROR."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass
class Filter:
    key: str
    op: str
    value: Any


@dataclass
class QueryOptions:
    schema_type: str | None = None
    filters: list[Filter] = field(default_factory=list)
    since: str | None = None
    modified_since: str | None = None
    path_prefix: str | None = None
    references: str | None = None
    direction: str = "outgoing"
    rel_type: str | None = None
    full_text: str | None = None
    order_by: str | None = None
    typed: bool = False
    limit: int | None = 20

    def check(self) -> None:
        """At least one criterion, known operators, no `.` or `..` in a path."""
        if not (self.schema_type or self.filters or self.since or self.modified_since or self.path_prefix or self.references or self.full_text):
            raise QueryError("VALIDATION_ERROR", "a query needs at least one criterion")
        for f in self.filters:
            if f.op not in OPERATORS:
                raise QueryError("VALIDATION_ERROR", f"unknown operator {f.op}")
        if self.direction not in ("outgoing", "incoming", "both"):
            raise QueryError("VALIDATION_ERROR", f"unknown direction {self.direction}")
        if self.path_prefix:
            check_path(self.path_prefix)


OPERATORS = ("eq", "neq", "in", "contains", "gt", "lt", "gte", "lte")


def check_path(path: str) -> None:
    if any(part in (".", "..") for part in path.split("/")):
        raise QueryError("VALIDATION_ERROR", f"path with . or ..: {path}")


def text_of(v: Any) -> str:
    """A value as the store writes it: whole numbers without a fraction, no exponent."""
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return str(int(v)) if v == int(v) else repr(v)
    return str(v)


def _number(v: Any) -> float | None:
    try:
        return float(v)
    except (TypeError, ValueError):
        return None


def condition(op: str, value: Any) -> Column:
    plain = F.when(F.col("value_type") == "reference", strip_reference(F.col("value_text"))).otherwise(F.col("value_text"))
    if op == "eq":
        return plain == F.lit(text_of(value))
    if op == "neq":
        return plain != F.lit(text_of(value))
    if op == "in":
        values = [text_of(v) for v in (value if isinstance(value, (list, tuple)) else [value])]
        return plain.isin(values) if values else F.lit(False)
    if op == "contains":
        return F.contains(ascii_lower(F.col("value_text")), ascii_lower(F.lit(text_of(value))))
    compare = {"gt": Column.__gt__, "lt": Column.__lt__, "gte": Column.__ge__, "lte": Column.__le__}.get(op)
    if compare is None:
        raise QueryError("VALIDATION_ERROR", f"unknown operator {op}")
    number = compare(F.col("value_number"), F.lit(_number(value)).cast("double"))
    return F.when(F.col("value_type") == "number", number).when(F.col("value_type") == "date", compare(F.col("value_date"), F.lit(text_of(value)))).otherwise(compare(F.col("value_text"), F.lit(text_of(value))))


def with_fields(store: GraphStore, filters: list[Filter]) -> DataFrame:
    """Ids of nodes that meet all filters: one pass over the folders of their keys. For semi joins, which ask
    no more than whether an id is there: one filter is no reason to bring the rows of a node together."""
    keys = sorted({f.key for f in filters})
    rows = store.fields.filter(F.col("key").isin(keys))
    if len(filters) == 1:
        return rows.filter(condition(filters[0].op, filters[0].value)).select(F.col("node_id").alias("id"))
    hits = [F.max(F.when(F.col("key") == f.key, condition(f.op, f.value)).otherwise(False)).alias(f"f{i}") for i, f in enumerate(filters)]
    met = rows.groupBy("node_id").agg(*hits)
    for i in range(len(filters)):
        met = met.filter(F.col(f"f{i}"))
    return met.select(F.col("node_id").alias("id"))


def referencing(store: GraphStore, target: str, direction: str, rel_type: str | None, bag: bool = False) -> DataFrame:
    e = store.edges if rel_type is None else store.edges.filter(F.col("rel_type") == rel_type)
    out = e.filter((F.col("resolved") == target) | (F.col("resolved").isNull() & (F.lower("target_id") == target.lower()))).select(F.col("source_id").alias("id"))
    into = e.filter((F.col("source_id") == target) & F.col("resolved").isNotNull()).select(F.col("resolved").alias("id"))
    ids = {"outgoing": out, "incoming": into, "both": out.unionByName(into)}[direction]
    return ids if bag else ids.distinct()


def query(store: GraphStore, q: QueryOptions, fields: str = "short") -> DataFrame:
    """The matching nodes: (id, title, indexed_at), with fields="id" ids only, with fields="full"
    all columns and the text; with full text also rank, by which they are then ordered."""
    q.check()
    n = store.nodes
    if q.path_prefix is not None:
        n = n.filter(F.col("id").startswith(q.path_prefix.rstrip("/") + "/"))
    if q.since is not None:
        n = n.filter(F.col("indexed_at") > F.lit(q.since).cast("timestamp_ntz"))
    if q.modified_since is not None:
        n = n.filter(F.col("file_mtime") > F.lit(q.modified_since).cast("timestamp_ntz"))
    if q.schema_type is not None:
        n = n.join(store.types.filter(F.col("schema_type") == q.schema_type).select(F.col("node_id").alias("id")), "id", "left_semi")
    if q.filters:
        n = n.join(with_fields(store, q.filters), "id", "left_semi")
    if q.references is not None:
        n = n.join(referencing(store, resolved_target(store, q.references), q.direction, q.rel_type), "id", "left_semi")
    order = [F.col("indexed_at").desc(), F.col("id")]
    if q.full_text is not None:
        n = n.join(ranked(store, q.full_text), "id")
        order = [F.col("rank"), F.col("id")]
    elif q.order_by:
        key, _, way = q.order_by.partition(" ")
        by = F.col("value_number") if q.typed else F.col("value_text")
        n = n.join(store.fields.filter(F.col("key") == key).select(F.col("node_id").alias("id"), by.alias("__by")), "id", "left")
        order = [F.col("__by").asc_nulls_first() if way.strip().upper() == "ASC" else F.col("__by").desc_nulls_last(), F.col("id")]
    if q.limit is not None:
        n = n.orderBy(*order).limit(q.limit)
    extra = ["rank"] if q.full_text is not None else []
    if fields == "id":
        return n.select("id")
    if fields == "short":
        return n.select("id", "title", "indexed_at", *extra)
    content = store.contents.withColumnRenamed("node_id", "id")
    full = n.join(content, "id", "left")
    return full.select("id", F.col("id").alias("file_path"), F.lit("file").alias("node_type"), "title", "content_text", "indexed_at", *extra)


def ranked(store: GraphStore, expression: str) -> DataFrame:
    """(id, rank) of nodes whose text matches, by BM25: from the store's postings, which are written
    at the first search where the store itself is written, and else from its texts."""
    if store.text is None and store.written:
        t = text.postings(store.contents, "node_id", "content_text")
        store.text = text.TextIndex(written(text.sorted_by_term(t.postings), "postings", "folder"), written(t.lengths, "lengths"))
    return text.ranked(store.text or text.postings(store.contents, "node_id", "content_text"), expression)


def resolved_target(store: GraphStore, target: str) -> str:
    """The id that a reference filter means: an id as it stands, else what the text resolves to."""
    if not store.nodes.filter(F.col("id") == target).limit(1).isEmpty():
        return target
    spark = store.nodes.sparkSession
    found = graph.resolve(spark.createDataFrame([(target,)], "target string"), store.nodes).first()
    return found["resolved"] or target


def hydrate(store: GraphStore, found: DataFrame) -> DataFrame:
    """found with its labels and fields, as sorted text. Up to FEW nodes are looked up by their ids."""
    rows = found.limit(FEW + 1).collect()
    if len(rows) <= FEW:
        few = F.col("node_id").isin([r["id"] for r in rows]) if rows else F.lit(False)
        types, fields = store.types.filter(few), store.fields.filter(few)
        # the rows themselves, not the work that found them once more
        found = found.sparkSession.createDataFrame(rows, found.schema)
    else:
        keys = found.select(F.col("id").alias("node_id"))
        types, fields = (x.join(keys, "node_id", "left_semi") for x in (store.types, store.fields))
    t = types.groupBy(F.col("node_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_list("schema_type")), ",").alias("types"))
    f = fields.groupBy(F.col("node_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "key", "value_text"))), ";").alias("fields"))
    return found.join(t, "id", "left").join(f, "id", "left")


#: Nodes that hydrate() looks up by a list of ids.
FEW = 500


def get_node(store: GraphStore, identifier: str, by: str = "id", edges: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """The node with an id or title (in three tiers), hydrated, and its links in both directions."""
    found = graph.resolve_identifier(store.nodes, identifier, by)
    if found["id"] is None:
        raise QueryError("CONFLICT" if found["candidates"] else "NOT_FOUND", f"no single node for {identifier}: {found['candidates']}")
    node = hydrate(store, store.nodes.filter(F.col("id") == found["id"]).select("id", "title", "indexed_at"))
    if not edges:
        return node, None
    e = store.edges
    out = e.filter(F.col("source_id") == found["id"]).withColumn("direction", F.lit("outgoing"))
    into = e.filter(F.col("resolved") == found["id"]).withColumn("direction", F.lit("incoming"))
    return node, out.unionByName(into)


def assembled(store: GraphStore, found: DataFrame) -> DataFrame:
    """Search results with their labels and their fields as JSON of value and type. The search is done once, and
    its results are then looked up."""
    found = written(found, "found")
    ids = found.select(F.col("id").alias("node_id"))
    t = store.types.join(ids, "node_id", "left_semi").groupBy(F.col("node_id").alias("id")).agg(F.to_json(F.sort_array(F.collect_list("schema_type"))).alias("types"))
    one = F.concat(F.to_json(F.array("key")).substr(F.lit(2), F.length(F.to_json(F.array("key"))) - 2), F.lit(':{"value":'), decode(F.col("value_type"), F.col("value_text"), F.col("value_number")), F.lit(',"type":"'), F.col("value_type"), F.lit('"}'))
    f = store.fields.join(ids, "node_id", "left_semi").select(F.col("node_id").alias("id"), one.alias("one")).groupBy("id").agg(F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list("one")), ","), F.lit("}")).alias("fields"))
    return found.join(t, "id", "left").join(f, "id", "left")
