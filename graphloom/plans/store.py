"""The graph store: nodes, labels, typed attributes and links as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import number_text
from .shared import written


@dataclass
class GraphStore:
    """nodes(id, title, indexed_at, file_mtime) · types(node_id, schema_type) ·
    fields(node_id, key, value_text, value_type, value_number, value_date) ·
    edges(source_id, target_id, rel_type, resolved, context) · contents(node_id, content_text);
    a node has each label and each key once;
    text is the index of contents (operators.text.TextIndex), where there is one; written tells that the
    tables are files, not expressions. Both end with any change of contents."""

    nodes: DataFrame
    types: DataFrame
    fields: DataFrame
    edges: DataFrame
    contents: DataFrame | None = None
    text: Any = None
    written: bool = False

    def changed(self, **tables: DataFrame) -> GraphStore:
        """The store with other tables, which are expressions now."""
        return replace(self, **tables, written=False, text=None if "contents" in tables else self.text)


#: The column that each table is laid out in folders by, so that a filter on it reads no others.
FOLDERS = {"nodes": None, "types": "schema_type", "fields": "key", "edges": "rel_type", "contents": None}


def persisted(store: GraphStore) -> GraphStore:
    """The store written once, in folders by label, key and kind of link; links get numbers."""
    if "edge_id" not in store.edges.columns:
        store = replace(store, edges=store.edges.withColumn("edge_id", F.monotonically_increasing_id()))
    return GraphStore(**{name: written(getattr(store, name), name, by) for name, by in FOLDERS.items() if getattr(store, name) is not None}, written=True)


_OPEN: dict[tuple[str, str], GraphStore] = {}


def opened(spark: SparkSession, sf_dir: str) -> GraphStore:
    """The store of the tables of a folder, built once for each session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _OPEN:
        _OPEN[key] = persisted(from_tables(spark, sf_dir))
    return _OPEN[key]


ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, key: str):
    return F.concat(F.lit(f"{kind}/"), F.col(key).cast("string"), F.lit(".md"))


def _field(node, key: str, text, kind: str, number=None, date=None):
    none = F.lit(None)
    return F.struct(F.lit(key).alias("key"), text.cast("string").alias("value_text"), F.lit(kind).alias("value_type"), (none if number is None else number).cast("double").alias("value_number"), (none if date is None else date).cast("string").alias("value_date"))


def from_tables(spark: SparkSession, sf_dir: str) -> GraphStore:
    """Orders as tasks, customers as projects, parts, and documents with their text: the tables seen as a graph."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey", "left")
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey", "left")
    p = table(spark, sf_dir, "part")
    then = F.lit("2000-01-01").cast("timestamp_ntz")
    oid, cid, pid = _id("orders", "o_orderkey"), _id("customers", "c_custkey"), _id("parts", "p_partkey")
    t = table(spark, sf_dir, "documents")
    tid = _id("docs", "doc_id")
    day = F.expr("interval 1 day")
    nodes = o.select(oid.alias("id"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"), F.col("o_orderdate").cast("timestamp_ntz").alias("indexed_at"), (F.col("o_orderdate").cast("timestamp_ntz") + day).alias("file_mtime"))
    for d, i, title in ((c, cid, F.col("c_name")), (p, pid, F.col("p_name"))):
        nodes = nodes.unionByName(d.select(i.alias("id"), title.alias("title"), then.alias("indexed_at"), then.alias("file_mtime")))
    mtime = F.expr("timestamp_ntz'2000-01-01' + make_dt_interval(0, cast(doc_id % 1000 as int), 0, 0)")
    nodes = nodes.unionByName(t.select(tid.alias("id"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"), then.alias("indexed_at"), mtime.alias("file_mtime")))
    label = lambda d, i, names: d.select(i.alias("node_id"), F.explode(F.array(*map(F.lit, names))).alias("schema_type"))
    types = label(o, oid, ["order", "task"]).unionByName(label(c, cid, ["customer", "project"])).unionByName(label(p, pid, ["part"])).unionByName(label(t, tid, ["document"]))
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "todo").otherwise("in-progress")
    due = F.date_format("o_orderdate", ISO)
    price, acct, retail = F.col("o_totalprice"), F.col("c_acctbal"), F.col("p_retailprice")
    link = lambda x: F.concat(F.lit("[["), F.col(x), F.lit("]]"))
    long = lambda d, i, fs: d.select(i.alias("node_id"), F.explode(F.array(*fs)).alias("f")).select("node_id", "f.*")
    fields = long(o, oid, [_field(oid, "status", status, "string"), _field(oid, "priority", F.col("o_orderpriority"), "string"), _field(oid, "total", number_text(price), "number", price), _field(oid, "due_date", due, "date", date=due), _field(oid, "project", link("c_name"), "reference")])
    fields = fields.unionByName(long(c, cid, [_field(cid, "segment", F.col("c_mktsegment"), "string"), _field(cid, "acctbal", number_text(acct), "number", acct), _field(cid, "nation", link("n_name"), "reference")]))
    fields = fields.unionByName(long(p, pid, [_field(pid, "brand", F.col("p_brand"), "string"), _field(pid, "type", F.col("p_type"), "string"), _field(pid, "size", F.col("p_size"), "number", F.col("p_size")), _field(pid, "price", number_text(retail), "number", retail)]))
    fields = fields.unionByName(long(t, tid, [_field(tid, "lang", F.col("lang"), "string"), _field(tid, "source", F.col("source"), "string"), _field(tid, "chars", F.col("n_chars"), "number", F.col("n_chars"))]))
    fields = fields.filter("value_text is not null")
    li = table(spark, sf_dir, "lineitem")
    edges = o.select(oid.alias("source_id"), F.col("c_name").alias("target_id"), F.lit("project").alias("rel_type"), _id("customers", "o_custkey").alias("resolved"))
    edges = edges.unionByName(li.select(_id("orders", "l_orderkey").alias("source_id"), _id("parts", "l_partkey").alias("target_id"), F.lit("item").alias("rel_type"), _id("parts", "l_partkey").alias("resolved")))
    edges = edges.unionByName(c.select(cid.alias("source_id"), F.col("n_name").alias("target_id"), F.lit("nation").alias("rel_type"), F.lit(None).cast("string").alias("resolved")))
    return GraphStore(nodes, types, fields, edges.withColumn("context", F.lit(None).cast("string")), t.select(tid.alias("node_id"), F.col("text").alias("content_text")))


_NUM = "CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE CAST({0} AS VARCHAR) END"
_DUE = "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ')"
_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'todo' ELSE 'in-progress' END"

#: The same store as common table expressions in SQL.
STORE_SQL = f"""nodes AS (
  SELECT 'orders/' || o_orderkey || '.md' AS id, 'Order ' || o_orderkey AS title, o_orderdate::TIMESTAMP AS indexed_at, o_orderdate::TIMESTAMP + INTERVAL 1 DAY AS file_mtime FROM orders
  UNION ALL SELECT 'customers/' || c_custkey || '.md', c_name, TIMESTAMP '2000-01-01', TIMESTAMP '2000-01-01' FROM customer
  UNION ALL SELECT 'parts/' || p_partkey || '.md', p_name, TIMESTAMP '2000-01-01', TIMESTAMP '2000-01-01' FROM part
  UNION ALL SELECT 'docs/' || doc_id || '.md', 'Doc ' || doc_id, TIMESTAMP '2000-01-01', TIMESTAMP '2000-01-01' + to_hours((doc_id % 1000)::INTEGER) FROM documents
), types AS (
  SELECT 'orders/' || o_orderkey || '.md' AS node_id, unnest(['order', 'task']) AS schema_type FROM orders
  UNION ALL SELECT 'customers/' || c_custkey || '.md', unnest(['customer', 'project']) FROM customer
  UNION ALL SELECT 'parts/' || p_partkey || '.md', 'part' FROM part
  UNION ALL SELECT 'docs/' || doc_id || '.md', 'document' FROM documents
), contents AS (SELECT 'docs/' || doc_id || '.md' AS node_id, text AS content_text FROM documents
), fields AS (
  SELECT * FROM (
  SELECT 'orders/' || o_orderkey || '.md' AS node_id, 'status' AS key, {_STATUS} AS value_text, 'string' AS value_type, NULL::DOUBLE AS value_number, NULL::VARCHAR AS value_date FROM orders
  UNION ALL SELECT 'orders/' || o_orderkey || '.md', 'priority', o_orderpriority, 'string', NULL, NULL FROM orders
  UNION ALL SELECT 'orders/' || o_orderkey || '.md', 'total', {_NUM.format("o_totalprice")}, 'number', o_totalprice, NULL FROM orders
  UNION ALL SELECT 'orders/' || o_orderkey || '.md', 'due_date', {_DUE}, 'date', NULL, {_DUE} FROM orders
  UNION ALL SELECT 'orders/' || o_orderkey || '.md', 'project', '[[' || c_name || ']]', 'reference', NULL, NULL FROM orders LEFT JOIN customer ON c_custkey = o_custkey
  UNION ALL SELECT 'customers/' || c_custkey || '.md', 'segment', c_mktsegment, 'string', NULL, NULL FROM customer
  UNION ALL SELECT 'customers/' || c_custkey || '.md', 'acctbal', {_NUM.format("c_acctbal")}, 'number', c_acctbal, NULL FROM customer
  UNION ALL SELECT 'customers/' || c_custkey || '.md', 'nation', '[[' || n_name || ']]', 'reference', NULL, NULL FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey
  UNION ALL SELECT 'parts/' || p_partkey || '.md', 'brand', p_brand, 'string', NULL, NULL FROM part
  UNION ALL SELECT 'parts/' || p_partkey || '.md', 'type', p_type, 'string', NULL, NULL FROM part
  UNION ALL SELECT 'parts/' || p_partkey || '.md', 'size', CAST(p_size AS VARCHAR), 'number', p_size, NULL FROM part
  UNION ALL SELECT 'parts/' || p_partkey || '.md', 'price', {_NUM.format("p_retailprice")}, 'number', p_retailprice, NULL FROM part
  UNION ALL SELECT 'docs/' || doc_id || '.md', 'lang', lang, 'string', NULL, NULL FROM documents
  UNION ALL SELECT 'docs/' || doc_id || '.md', 'source', source, 'string', NULL, NULL FROM documents
  UNION ALL SELECT 'docs/' || doc_id || '.md', 'chars', n_chars::VARCHAR, 'number', n_chars, NULL FROM documents
  ) WHERE value_text IS NOT NULL
), edges AS (
  SELECT 'orders/' || o_orderkey || '.md' AS source_id, c_name AS target_id, 'project' AS rel_type, 'customers/' || o_custkey || '.md' AS resolved FROM orders LEFT JOIN customer ON c_custkey = o_custkey
  UNION ALL SELECT 'orders/' || l_orderkey || '.md', 'parts/' || l_partkey || '.md', 'item', 'parts/' || l_partkey || '.md' FROM lineitem
  UNION ALL SELECT 'customers/' || c_custkey || '.md', n_name, 'nation', NULL FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey
)"""
