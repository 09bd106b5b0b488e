"""All registered queries of the graph engine: name -> callable, and name -> SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import scalar as S
from .operators import aggregate, changes, duplicates, graph, quality, text, vector
from .operators.query import Filter, QueryOptions, hydrate, query, referencing
from .plans.store import GraphStore, opened, table
from .registry import QUERIES, SQL, register
from .sources import markdown
from .streaming import events

TODAY = "2000-06-14"


def _ids(name: str, options: dict, where: str, extra: str = "") -> None:
    """A query on filters alone, returned whole as ids."""
    register(name, f"{extra} SELECT id FROM nodes WHERE {where}")(lambda st, spark, d, o=options: query(st, QueryOptions(limit=None, **o), "id"))


def _has(key: str, cond: str) -> str:
    return f"id IN (SELECT node_id FROM fields WHERE key = '{key}' AND {cond})"


_PLAIN = "(CASE WHEN value_type = 'reference' THEN replace(replace(value_text, '[[', ''), ']]', '') ELSE value_text END)"
_ids("q_eq_reference", {"filters": [Filter("nation", "eq", "NATION_3")]}, _has("nation", f"{_PLAIN} = 'NATION_3'"))
_ids("q_eq_string", {"filters": [Filter("segment", "eq", "BUILDING")]}, _has("segment", f"{_PLAIN} = 'BUILDING'"))
_ids("q_neq_has_field", {"filters": [Filter("status", "neq", "done")]}, _has("status", f"{_PLAIN} <> 'done'"))
_ids("q_in_set", {"filters": [Filter("status", "in", ["todo", "done"])]}, _has("status", f"{_PLAIN} IN ('todo', 'done')"))
_ids("q_in_empty", {"filters": [Filter("status", "in", [])]}, "false")
_ids("q_gt_number", {"filters": [Filter("total", "gt", 200000)]}, _has("total", "value_number > 200000"))
_ids("q_lte_number", {"filters": [Filter("size", "lte", 10)]}, _has("size", "value_number <= 10"))
_ids("q_lt_date_text", {"filters": [Filter("due_date", "lt", "1997-01-01")]}, _has("due_date", "value_date < '1997-01-01'"))
_ids("q_gte_date_text", {"filters": [Filter("due_date", "gte", "2000-01-01")]}, _has("due_date", "value_date >= '2000-01-01'"))
_ids("q_gt_string", {"filters": [Filter("brand", "gt", "Brand#3")]}, _has("brand", "value_text > 'Brand#3'"))
_ids("q_contains_ascii", {"filters": [Filter("type", "contains", "romo")]}, _has("type", "contains(lower(value_text), 'romo')"))
_ids("q_contains_wildcard_literal", {"filters": [Filter("nation", "contains", "n_1")]}, _has("nation", "contains(lower(value_text), 'n_1')"))
_ids("q_eq_number", {"filters": [Filter("price", "eq", 900.5)]}, _has("price", "value_number = 900.5"))
_ids("q_gt_quote", {"filters": [Filter("brand", "gt", "B'and#3")]}, _has("brand", "value_text > 'B''and#3'"))
_ids("q_modified_since", {"modified_since": "2000-01-20"}, "file_mtime > TIMESTAMP '2000-01-20'")
_ids("q_path_prefix", {"path_prefix": "customers"}, "starts_with(id, 'customers/')")
_ids("q_since", {"since": "2000-01-01"}, "indexed_at > TIMESTAMP '2000-01-01'")
_ids("q_multi_filter_and", {"schema_type": "task", "filters": [Filter("status", "eq", "todo"), Filter("total", "gt", 100000), Filter("priority", "neq", "1-URGENT")]}, "id IN (SELECT node_id FROM types WHERE schema_type = 'task') AND " + " AND ".join([_has("status", "value_text = 'todo'"), _has("total", "value_number > 100000"), _has("priority", "value_text <> '1-URGENT'")]))
_ids("q_type_filter", {"schema_type": "project"}, "id IN (SELECT node_id FROM types WHERE schema_type = 'project')")
_ids("q_ref_outgoing_set", {"references": "parts/7.md"}, "id IN (SELECT source_id FROM edges WHERE resolved = 'parts/7.md')")
_ids("q_ref_incoming", {"references": "orders/7.md", "direction": "incoming"}, "id IN (SELECT resolved FROM edges WHERE source_id = 'orders/7.md')")
_ids("q_ref_both", {"references": "customers/7.md", "direction": "both"}, "id IN (SELECT source_id FROM edges WHERE resolved = 'customers/7.md') OR id IN (SELECT resolved FROM edges WHERE source_id = 'customers/7.md')")
_ids("q_ref_reltype", {"references": "customers/7.md", "rel_type": "project"}, "id IN (SELECT source_id FROM edges WHERE resolved = 'customers/7.md' AND rel_type = 'project')")

_OPEN = QueryOptions(schema_type="task", filters=[Filter("status", "eq", "todo")], limit=20)
_HYDRATED = """found AS (SELECT id, title, indexed_at FROM nodes WHERE id IN (SELECT node_id FROM types WHERE schema_type = 'task')
  AND id IN (SELECT node_id FROM fields WHERE key = 'status' AND value_text = 'todo') ORDER BY indexed_at DESC NULLS LAST, id LIMIT 20)
SELECT id, title, indexed_at,
  (SELECT string_agg(schema_type, ',' ORDER BY schema_type) FROM types WHERE node_id = id) AS types,
  (SELECT string_agg(key || '=' || value_text, ';' ORDER BY key || '=' || value_text) FROM fields WHERE node_id = id) AS fields
FROM found"""


@register("q_type_status_recent", ", " + _HYDRATED)
def _(st: GraphStore, spark, d):
    return hydrate(st, query(st, _OPEN))


@register("q_ref_outgoing_bag", "SELECT source_id AS id FROM edges WHERE resolved = 'parts/7.md'")
def _(st, spark, d):
    return referencing(st, "parts/7.md", "outgoing", None, bag=True)


for _n, _o, _sql in (
    ("q_order_by_text", QueryOptions(schema_type="part", order_by="size"), "value_text DESC NULLS LAST"),
    ("q_order_by_typed", QueryOptions(schema_type="part", order_by="size", typed=True), "value_number DESC NULLS LAST"),
    ("q_order_by_asc", QueryOptions(schema_type="part", order_by="price ASC", typed=True), "value_number ASC NULLS FIRST"),
    ("q_order_by_missing", QueryOptions(schema_type="part", order_by="nosuch"), "value_text DESC NULLS LAST"),
):
    _k = _o.order_by.split()[0]
    register(_n, f"SELECT id, title, indexed_at FROM nodes LEFT JOIN (SELECT * FROM fields WHERE key = '{_k}') f ON f.node_id = id WHERE id IN (SELECT node_id FROM types WHERE schema_type = 'part') ORDER BY {_sql}, id LIMIT 20")(lambda st, spark, d, o=_o: query(st, o))

register("q_list_types", "SELECT schema_type, count(*) AS n FROM types GROUP BY 1")(lambda st, spark, d: aggregate.count_types(st))
register("q_computed_count", "SELECT resolved AS target, count(DISTINCT source_id) AS n FROM edges WHERE rel_type = 'project' AND source_id IN (SELECT node_id FROM types WHERE schema_type = 'task') AND source_id IN (SELECT node_id FROM fields WHERE key = 'status' AND value_text = 'done') AND resolved IS NOT NULL GROUP BY 1")(lambda st, spark, d: aggregate.computed_count(st, "task", {"status": "done"}, "project"))


def _pct(flt: str) -> str:
    return f""", b AS (SELECT resolved AS target, count(DISTINCT source_id) AS d FROM edges WHERE rel_type = 'project' AND resolved IS NOT NULL {flt} GROUP BY 1),
m AS (SELECT resolved AS target, count(DISTINCT source_id) AS m FROM edges WHERE rel_type = 'project' AND source_id IN (SELECT node_id FROM fields WHERE key = 'status' AND value_text = 'done') GROUP BY 1)
SELECT target, CASE WHEN d > 0 THEN floor(coalesce(m, 0) / d * 100 * 100 + 0.5) / 100 ELSE 0 END AS pct FROM b FULL JOIN m USING (target)"""


register("q_computed_pct", _pct(""))(lambda st, spark, d: aggregate.computed_percentage(st, "task", {}, {"status": "done"}, "project"))
register("q_computed_pct_overlay", _pct("AND source_id IN (SELECT node_id FROM fields WHERE key = 'status' AND value_text = 'todo')"))(lambda st, spark, d: aggregate.computed_percentage(st, "task", {"status": "todo"}, {"status": "done"}, "project"))
register("q_field_profile", "SELECT schema_type, key, value_type, value_text, count(*) AS n FROM fields JOIN types USING (node_id) WHERE schema_type = 'part' GROUP BY ALL")(lambda st, spark, d: aggregate.value_profile(st, "part"))
register("q_field_frequency", "SELECT schema_type, key, count(DISTINCT node_id) AS n_nodes, count(DISTINCT node_id) / any_value(total) AS frequency FROM fields JOIN types USING (node_id) JOIN (SELECT schema_type, count(DISTINCT node_id) AS total FROM types GROUP BY 1) USING (schema_type) GROUP BY 1, 2")(lambda st, spark, d: aggregate.field_frequency(st))
_DOMINANT = "dom AS (SELECT schema_type, key, arg_min(value_type, (-n, value_type)) AS value_type FROM (SELECT schema_type, key, value_type, count(*) AS n FROM fields JOIN types USING (node_id) GROUP BY ALL) GROUP BY 1, 2)"
register("q_dominant_type", f", {_DOMINANT} SELECT * FROM dom")(lambda st, spark, d: aggregate.dominant_type(st))
_INFER = rf"""{_DOMINANT}, s AS (SELECT schema_type, key, count(DISTINCT value_text) FILTER (value_type = 'string') AS ds, count(*) FILTER (value_type = 'string') AS ns, bool_and(regexp_matches(value_text, '^\[\[[^\]]+\]\]$')) FILTER (value_type = 'string') AS links FROM fields JOIN types USING (node_id) GROUP BY 1, 2),
inferred AS (SELECT schema_type, key, CASE WHEN value_type <> 'string' THEN value_type WHEN links THEN 'reference' WHEN ds BETWEEN 2 AND 20 AND ds / ns < 0.5 THEN 'enum' ELSE 'string' END AS field_type FROM dom JOIN s USING (schema_type, key))"""
register("q_enum_candidates", f", {_INFER} SELECT * FROM inferred")(lambda st, spark, d: aggregate.infer_field_types(st))
register("q_shared_fields", f", {_INFER} SELECT key, field_type, string_agg(DISTINCT schema_type, ',' ORDER BY schema_type) AS schema_types FROM inferred GROUP BY 1, 2 HAVING count(DISTINCT schema_type) > 1")(lambda st, spark, d: aggregate.shared_fields(st))
register("q_status_buckets", "SELECT coalesce(f.value_text, 'unknown') AS status, count(*) AS n FROM types t LEFT JOIN fields f ON f.node_id = t.node_id AND f.key = 'status' WHERE schema_type = 'task' GROUP BY 1")(lambda st, spark, d: aggregate.status_buckets(st))
register("q_project_status", f""", w AS (SELECT node_id AS source_id, max(CASE WHEN key = 'status' THEN value_text END) AS status, max(CASE WHEN key = 'due_date' THEN value_date[:10] END) AS due FROM fields GROUP BY 1),
l AS (SELECT DISTINCT source_id, resolved FROM edges WHERE resolved IN (SELECT node_id FROM types WHERE schema_type = 'project') AND source_id IN (SELECT node_id FROM types WHERE schema_type = 'task'))
SELECT resolved AS project, count(*) AS total, count(*) FILTER (status = 'done') AS done, floor(count(*) FILTER (status = 'done') / count(*) * 100 * 100 + 0.5) / 100 AS pct, count(*) FILTER (due < '{TODAY}' AND status NOT IN ('done', 'cancelled')) AS overdue FROM l LEFT JOIN w USING (source_id) GROUP BY 1""")(lambda st, spark, d: aggregate.project_status(st, TODAY))
register("q_daily_summary_due", f""", x AS (SELECT d.node_id AS id, d.value_date[:10] AS due, s.value_text AS status FROM fields d LEFT JOIN fields s ON s.node_id = d.node_id AND s.key = 'status' WHERE d.key = 'due_date' AND d.value_date IS NOT NULL)
SELECT id, due, CASE WHEN due < '{TODAY}' THEN 'overdue' WHEN due = '{TODAY}' THEN 'today' ELSE 'week' END AS bucket FROM x WHERE (status IS NULL OR status NOT IN ('done', 'cancelled')) AND due <= CAST(CAST(date_trunc('week', DATE '{TODAY}') + INTERVAL 6 DAY AS DATE) AS VARCHAR)""")(lambda st, spark, d: aggregate.due_lists(st, TODAY))
register("q_recent_typed", "SELECT id, indexed_at FROM nodes WHERE id IN (SELECT node_id FROM types) ORDER BY indexed_at DESC NULLS LAST, id LIMIT 20")(lambda st, spark, d: st.nodes.join(st.types.select(F.col("node_id").alias("id")), "id", "left_semi").orderBy(F.col("indexed_at").desc(), "id").limit(20).select("id", "indexed_at"))

_NAMES = r""", lookup AS (SELECT name, tier, min(id) AS id FROM (SELECT lower(title) AS name, 0 AS tier, id FROM nodes UNION ALL SELECT lower(array_to_string(p[i:], '/')), 1, id FROM (SELECT id, string_split(regexp_replace(id, '\.md$', ''), '/') AS p FROM nodes), unnest([1, 2]) AS u(i)) GROUP BY 1, 2 HAVING count(*) = 1)"""


@register("q_resolve_title", _NAMES + r""" SELECT DISTINCT e.target_id AS target, coalesce(a.id, b.id) AS resolved FROM edges e LEFT JOIN lookup a ON a.tier = 0 AND a.name = lower(e.target_id) LEFT JOIN lookup b ON b.tier = 1 AND b.name = regexp_replace(lower(e.target_id), '\.md$', '')""")
def _(st, spark, d):
    return graph.resolve(st.edges.select(F.col("target_id").alias("target")).distinct(), st.nodes)


@register("q_resolve_ambiguous", "SELECT p_name AS target, CASE WHEN count(*) = 1 THEN 'parts/' || min(p_partkey) || '.md' END AS resolved FROM part GROUP BY 1", store=False)
def _(spark, d):
    nodes = opened(spark, d).nodes
    return graph.resolve(table(spark, d, "part").select(F.col("p_name").alias("target")).distinct(), nodes)


register("q_dangling", "SELECT rel_type, count(*) AS n FROM edges WHERE resolved IS NULL GROUP BY 1")(lambda st, spark, d: st.edges.filter("resolved is null").groupBy("rel_type").agg(F.count("*").alias("n")))


def _bfs(name: str, root: str, depth: int, direction: str, rel: str | None = None) -> None:
    out, into = "SELECT source_id AS u, resolved AS v FROM edges WHERE resolved IS NOT NULL", "SELECT resolved AS u, source_id AS v FROM edges WHERE resolved IS NOT NULL"
    if rel:
        out, into = f"{out} AND rel_type = '{rel}'", f"{into} AND rel_type = '{rel}'"
    hops = {"outgoing": out, "incoming": into, "both": f"{out} UNION ALL {into}"}[direction]
    register(name, f", hops AS (SELECT DISTINCT u, v FROM ({hops})), walk AS (SELECT '{root}' AS id, 0 AS depth UNION SELECT v, depth + 1 FROM walk JOIN hops ON u = id WHERE depth < {depth}) SELECT id, min(depth) AS depth FROM walk WHERE id <> '{root}' GROUP BY 1", recursive=True)(
        lambda st, spark, d: graph.traverse(st, root, depth, direction, [rel] if rel else None)[0]
    )


_bfs("q_bfs_out_2", "orders/7.md", 2, "outgoing")
_bfs("q_bfs_in_2", "customers/7.md", 2, "incoming")
_bfs("q_bfs_both_3", "customers/7.md", 3, "both")
_bfs("q_bfs_reltype", "customers/7.md", 2, "both", "project")

_TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
for _n, _e, _w in (
    ("q_fts_term", "thing", "list_contains(w, 'thing')"),
    ("q_fts_and", "thing that", "list_contains(w, 'thing') AND list_contains(w, 'that')"),
    ("q_fts_or", "pour OR para", "list_contains(w, 'pour') OR list_contains(w, 'para')"),
    ("q_fts_not", "that NOT which", "list_contains(w, 'that') AND NOT list_contains(w, 'which')"),
    ("q_fts_not_and", "the NOT that thing", "list_contains(w, 'the') AND NOT (list_contains(w, 'that') AND list_contains(w, 'thing'))"),
    ("q_fts_or_not", "para OR the NOT that", "list_contains(w, 'para') OR (list_contains(w, 'the') AND NOT list_contains(w, 'that'))"),
    ("q_fts_prefix", "licen*", "len(list_filter(w, lambda x: starts_with(x, 'licen'))) > 0"),
    ("q_fts_phrase", '"apache license version"', "contains(' ' || array_to_string(w, ' ') || ' ', ' apache license version ')"),
):
    register(_n, f"SELECT doc_id FROM (SELECT doc_id, {_TOK} AS w FROM documents) WHERE {_w}", store=False)(lambda spark, d, e=_e: text.search(table(spark, d, "documents"), e))
register("q_fts_bm25_topk", f"""WITH d AS (SELECT doc_id, len(w) AS len, len(list_filter(w, lambda x: x = 'license')) AS t0, len(list_filter(w, lambda x: x = 'under')) AS t1 FROM (SELECT doc_id, {_TOK} AS w FROM documents)),
s AS (SELECT count(*) AS n, avg(len) AS a, sum((t0 > 0)::INT) AS d0, sum((t1 > 0)::INT) AS d1 FROM d),
r AS (SELECT doc_id, -(greatest(ln((n - d0 + 0.5) / (d0 + 0.5)), 1e-6) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * len / a)) + greatest(ln((n - d1 + 0.5) / (d1 + 0.5)), 1e-6) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * len / a))) AS rank FROM d, s WHERE t0 > 0 AND t1 > 0)
SELECT doc_id, round(rank, 6) AS rank FROM r ORDER BY round(rank, 6), doc_id LIMIT 20""", store=False)(lambda spark, d: text.bm25(table(spark, d, "documents"), ["license", "under"]).select("doc_id", F.round("rank", 6).alias("rank")).orderBy("rank", "doc_id").limit(20))

_PROBE = [1.0] * 8 + [0.0] * 56
_DIST = "sqrt(list_sum([(x::DOUBLE - CASE WHEN i <= 8 THEN 1.0 ELSE 0.0 END) ** 2 for x, i in embedding]))"


_CELLS: dict = {}


def _cells(spark, d):
    key = (spark.sparkContext.applicationId, d)
    if key not in _CELLS:
        _CELLS[key] = vector.cells(_chunks(spark, d))
    return _CELLS[key]


def _chunks(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.floor(F.col("vec_id") / 5).cast("bigint").alias("node_id"), "label", "embedding")


register("q_knn_topk", f"SELECT vec_id AS chunk_id, round({_DIST}, 6) AS distance FROM embeddings ORDER BY 2, 1 LIMIT 30", store=False)(lambda spark, d: vector.knn(_chunks(spark, d), _PROBE, 30).select("chunk_id", F.round("distance", 6).alias("distance")))
register("q_knn_cells", f"SELECT vec_id AS chunk_id, round({_DIST}, 6) AS distance FROM embeddings ORDER BY 2, 1 LIMIT 30", store=False)(lambda spark, d: vector.nearest(_cells(spark, d), _PROBE, 30)[0].select("chunk_id", F.round("distance", 6).alias("distance")))
_KNN = f"h AS (SELECT vec_id AS chunk_id, vec_id // 5 AS node_id, {_DIST} AS distance FROM embeddings {{}} ORDER BY distance, chunk_id LIMIT 30), b AS (SELECT node_id, min(distance) AS distance FROM h GROUP BY 1)"
_BEST = " SELECT node_id, round(distance, 6) AS distance, round(1 / (1 + distance), 6) AS score FROM b {} ORDER BY b.distance, node_id LIMIT 10"
_ALLOWED = "(SELECT vec_id // 5 FROM embeddings WHERE label < 5)"
for _n, _k, _pre, _post in (("q_knn_dedup_node", {}, "", ""), ("q_knn_postfilter", {"allowed": True}, "", f"WHERE node_id IN {_ALLOWED}"), ("q_knn_prefilter", {"allowed": True, "prefilter": True}, f"WHERE vec_id // 5 IN {_ALLOWED}", "")):
    register(_n, "WITH " + _KNN.format(_pre) + _BEST.format(_post), store=False)(
        lambda spark, d, k=_k: vector.semantic_search(_chunks(spark, d), _PROBE, 10, **({**k, "allowed": _chunks(spark, d).filter("label < 5").select("node_id").distinct()} if k else {})).select("node_id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))
    )
register("q_token_estimate", r"SELECT doc_id, ceil(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) * 1.3)::BIGINT AS tokens FROM documents", store=False)(lambda spark, d: table(spark, d, "documents").select("doc_id", S.token_estimate(F.col("text")).cast("bigint").alias("tokens")))
_SECTIONED = r"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '## First' || chr(10) || text || chr(10) || '### Second ' || doc_id || chr(10) || 'tail' ELSE text END AS text FROM documents WHERE text IS NOT NULL"""
register("q_chunk_sections", rf"""WITH d AS ({_SECTIONED}), t AS (SELECT *, ceil(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) * 1.3) AS n FROM d),
c AS (SELECT doc_id, 0 AS chunk_index, NULL AS heading, regexp_replace(text, '^\s+|\s+$', '', 'g') AS content FROM t WHERE doc_id % 2 = 1 OR n < 200
UNION ALL SELECT t.doc_id, 0, 'First', regexp_replace(o.text, '^\s+|\s+$', '', 'g') FROM t JOIN documents o USING (doc_id) WHERE t.doc_id % 2 = 0 AND n >= 200
UNION ALL SELECT doc_id, 1, 'Second ' || doc_id, 'tail' FROM t WHERE doc_id % 2 = 0 AND n >= 200)
SELECT *, ceil(len(list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> '')) * 1.3)::BIGINT AS token_count FROM c""", store=False)(
    lambda spark, d: vector.chunk(table(spark, d, "documents").filter("text is not null").select("doc_id", F.when(F.expr("doc_id % 2 = 0"), F.concat(F.lit("## First\n"), "text", F.lit("\n### Second "), F.col("doc_id").cast("string"), F.lit("\ntail"))).otherwise(F.col("text")).alias("text"))).withColumn("token_count", F.col("token_count").cast("bigint"))
)
register("q_embed_hash", store=False)(lambda spark, d: vector.hash_embed(table(spark, d, "documents")))


def _titles(spark, d):
    return table(spark, d, "part").select(F.concat(F.lit("parts/"), F.col("p_partkey").cast("string"), F.lit(".md")).alias("id"), F.concat_ws(" ", "p_name", "p_brand").alias("title"))


_NORM = r"SELECT 'parts/' || p_partkey || '.md' AS id, trim(regexp_replace(regexp_replace(trim(lower(p_name || ' ' || p_brand)), '[^\w\s]', '', 'g'), '\s+', ' ', 'g')) AS norm FROM part"
register("q_dup_exact", f"SELECT * FROM (SELECT norm, count(*) OVER (PARTITION BY norm) AS n, id FROM ({_NORM})) WHERE n > 1", store=False)(lambda spark, d: duplicates.exact(_titles(spark, d)))
_NEAR = f"""s AS (SELECT norm, min(id) AS id, dense_rank() OVER (ORDER BY norm[:3]) AS ord FROM ({_NORM}) GROUP BY norm HAVING count(*) = 1),
p AS (SELECT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b, 1 - levenshtein(x.norm, y.norm) / greatest(len(x.norm), len(y.norm)) AS sim FROM s x JOIN s y ON y.ord = x.ord + 1 OR (y.ord = x.ord AND x.id < y.id)),
near AS (SELECT a, b, floor(sim * 100 + 0.5) / 100 AS similarity FROM p WHERE sim >= 0.8 AND sim < 1)"""
register("q_dup_near", f"WITH {_NEAR} SELECT * FROM near", store=False)(lambda spark, d: duplicates.near(_titles(spark, d)))
register("q_dup_fields", f", {_NEAR}, o AS (SELECT n.a, n.b, (SELECT avg(CASE WHEN x.value_text = y.value_text THEN 1.0 ELSE 0.0 END) FROM (SELECT * FROM fields WHERE node_id = n.a) x FULL JOIN (SELECT * FROM fields WHERE node_id = n.b) y ON x.key = y.key) AS overlap, similarity FROM near n) SELECT a, b, floor((0.7 * similarity + 0.3 * overlap) * 100 + 0.5) / 100 AS score FROM o WHERE floor((0.7 * similarity + 0.3 * overlap) * 100 + 0.5) / 100 >= 0.8")(lambda st, spark, d: duplicates.field_overlap(duplicates.near(_titles(spark, d)), st.fields))

_DEFS = [quality.FieldDef("status", "enum", True, ("todo", "in-progress")), quality.FieldDef("total", "string"), quality.FieldDef("project", "reference"), quality.FieldDef("assignee", "reference", True)]
_TASKS = "(SELECT node_id FROM types WHERE schema_type = 'task')"
_WARN = f"SELECT node_id, 'assignee' AS key, 'required' AS rule FROM types WHERE schema_type = 'task' UNION ALL SELECT node_id, key, CASE WHEN key = 'status' THEN 'enum' ELSE 'type' END FROM fields WHERE node_id IN {_TASKS} AND ((key = 'status' AND value_text NOT IN ('todo', 'in-progress')) OR key = 'total')"
register("q_validate", _WARN)(lambda st, spark, d: quality.validate(st, "task", _DEFS))
register("q_is_valid", f"SELECT node_id, node_id NOT IN (SELECT node_id FROM fields WHERE key = 'status' AND value_text <> 'todo') AS is_valid FROM types WHERE schema_type = 'task'")(lambda st, spark, d: quality.validity(st, "task", [quality.FieldDef("status", "enum", True, ("todo",))]))
register("q_coerce_enum_case", "SELECT node_id, CASE lower(value_text) WHEN 'building' THEN 'Building' WHEN 'machinery' THEN 'Machinery' ELSE value_text END AS value FROM fields WHERE key = 'segment'")(lambda st, spark, d: st.fields.filter("key = 'segment'").select("node_id", quality.coerce(F.col("value_text"), quality.FieldDef("segment", "enum", values=("Building", "Machinery"))).alias("value")))
register("q_coerce_reference_wrap", "SELECT node_id, '[[' || value_text || ']]' AS value FROM fields WHERE key = 'brand'")(lambda st, spark, d: st.fields.filter("key = 'brand'").select("node_id", quality.coerce(F.col("value_text"), quality.FieldDef("brand", "reference")).alias("value")))
register("q_coerce_list_wrap", """SELECT node_id, '["' || value_text || '"]' AS value FROM fields WHERE key = 'brand'""")(lambda st, spark, d: st.fields.filter("key = 'brand'").select("node_id", quality.coerce(F.col("value_text"), quality.FieldDef("brand", "list<string>")).alias("value")))

_FILES = "SELECT doc_id::VARCHAR AS path, {} AS mtime, sha256({}) AS hash FROM documents WHERE {}"
_OLD, _NEW = _FILES.format("0", "text", "doc_id % 10 <> 0"), _FILES.format("CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END", "CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END", "doc_id % 7 <> 0")
_DIFF = f"SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.hash IS NULL THEN 'new' WHEN n.hash IS NULL THEN 'deleted' WHEN o.mtime = n.mtime THEN 'skip' WHEN o.hash = n.hash THEN 'touch' ELSE 'changed' END AS action FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.path = n.path"


def _snapshots(spark, d):
    t = table(spark, d, "documents")
    old = t.filter("doc_id % 10 <> 0").select(F.col("doc_id").cast("string").alias("path"), F.lit(0).alias("mtime"), F.sha2("text", 256).alias("hash"))
    new = t.filter("doc_id % 7 <> 0").select(F.col("doc_id").cast("string").alias("path"), F.when(F.expr("doc_id % 3 = 0"), 0).otherwise(1).alias("mtime"), F.sha2(F.when(F.expr("doc_id % 5 = 0"), F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("hash"))
    return changes.diff(old, new)


register("q_cdc_diff", _DIFF, store=False)(_snapshots)
register("q_cdc_counts", f"SELECT action, count(*) AS n FROM ({_DIFF}) GROUP BY 1", store=False)(lambda spark, d: _snapshots(spark, d).groupBy("action").agg(F.count("*").alias("n")))
_TODO = "(SELECT node_id FROM fields WHERE key = 'status' AND value_text = 'todo')"
register("q_bulk_update", f"SELECT node_id, key, value_text FROM fields WHERE key NOT IN ('status', 'priority') OR node_id NOT IN {_TODO} UNION ALL SELECT node_id, 'status', 'blocked' FROM fields WHERE key = 'status' AND value_text = 'todo'")(lambda st, spark, d: changes.update_fields(st, st.fields.filter("key = 'status' and value_text = 'todo'").select("node_id"), {"status": "blocked", "priority": None}).select("node_id", "key", "value_text"))
register("q_delete_dangling", "SELECT source_id, target_id, rel_type, CASE WHEN resolved NOT IN (SELECT node_id FROM fields WHERE key = 'size' AND value_number > 25) THEN resolved END AS resolved FROM edges")(lambda st, spark, d: changes.delete_nodes(st, st.fields.filter("key = 'size' and value_number > 25").select("node_id")).edges.select("source_id", "target_id", "rel_type", "resolved"))
register("q_rename_refs", "SELECT node_id, replace(value_text, '[[NATION_3]]', '[[Third $1 \\E]]') AS value_text FROM fields WHERE key = 'nation'")(lambda st, spark, d: changes.rename_references(st.fields.filter("key = 'nation'"), "nation_3", "Third $1 \\E").select("node_id", "value_text"))

_RAW = "'---' || chr(10) || 'status: ' || o_orderstatus || chr(10) || 'customer: \"[[' || o_custkey || '|C' || o_custkey || ']]\"' || chr(10) || '---' || chr(10) || 'See [[Order ' || o_orderkey || ']] and ![[scan' || o_orderkey || '.png|100]].'"


def _notes(spark, d):
    o = table(spark, d, "orders")
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    raw = F.concat(F.lit("---\nstatus: "), F.col("o_orderstatus"), F.lit('\ncustomer: "[['), c, F.lit("|C"), c, F.lit(']]"\n---\nSee [[Order '), k, F.lit("]] and ![[scan"), k, F.lit(".png|100]]."))
    return o.select(F.col("o_orderkey").alias("path"), raw.alias("raw"))


register("q_parse_frontmatter", "SELECT o_orderkey AS path, 'status' AS key, o_orderstatus AS value FROM orders UNION ALL SELECT o_orderkey, 'customer', '[[' || o_custkey || '|C' || o_custkey || ']]' FROM orders", store=False)(lambda spark, d: markdown.flat_fields(_notes(spark, d)))
register("q_extract_links", "SELECT o_orderkey AS path, 0 AS ordinal, o_custkey::VARCHAR AS target, 'C' || o_custkey AS alias FROM orders UNION ALL SELECT o_orderkey, 1, 'Order ' || o_orderkey, NULL FROM orders UNION ALL SELECT o_orderkey, 2, 'scan' || o_orderkey || '.png', '100' FROM orders", store=False)(lambda spark, d: markdown.links(_notes(spark, d)).drop("start", "end"))
register("q_extract_embeds", "SELECT o_orderkey AS path, 'scan' || o_orderkey || '.png' AS file, 'image' AS class FROM orders", store=False)(lambda spark, d: _notes(spark, d).select("path", F.explode(markdown.embeds(F.col("raw"))).alias("file")).withColumn("class", markdown.attachment_class(F.col("file"))))
register("q_plain_text", "SELECT o_orderkey AS path, 'See Order ' || o_orderkey || ' and !100.' AS text FROM orders", store=False)(lambda spark, d: _notes(spark, d).select("path", markdown.plain_text(F.col("raw")).alias("text")))
register("q_patch_frontmatter", f"SELECT o_orderkey AS path, replace({_RAW}, 'status: ' || o_orderstatus, 'status: done') AS raw FROM orders", store=False)(lambda spark, d: _notes(spark, d).select("path", markdown.patch_header(F.col("raw"), "status", "done").alias("raw")))
register("q_filename", r"SELECT p_partkey, trim(regexp_replace(regexp_replace(p_name || ': ' || p_brand, '[\\:*?\"<>|]', '', 'g'), '\s+', ' ', 'g')) || '.md' AS name FROM part", store=False)(lambda spark, d: table(spark, d, "part").select("p_partkey", F.concat(S.safe_filename(F.concat_ws(": ", "p_name", "p_brand")), F.lit(".md")).alias("name")))
register("q_transcript_merge", """WITH a AS (SELECT *, CASE WHEN role IS NOT DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AND row_number() OVER (PARTITION BY conv_id ORDER BY turn) > 1 THEN 0 ELSE 1 END AS fresh FROM conversations WHERE trim(text) <> ''),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM a)
SELECT conv_id, min(turn) AS first_turn, min(role) AS role, string_agg(text, ' ' ORDER BY turn, text) AS text FROM b GROUP BY conv_id, run""", store=False)(lambda spark, d: events.merge_turns(table(spark, d, "conversations")))
register("q_stream_debounce", """WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM a)
SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start, floor(epoch(max(ts)))::BIGINT AS last, count(*) AS n FROM b GROUP BY user_id, run""", store=False)(lambda spark, d: events.debounce(table(spark, d, "events")).select("user_id", F.unix_timestamp("start").alias("start"), F.unix_timestamp("last").alias("last"), "n"))
register("q_stream_dedup", "SELECT DISTINCT user_id, event_type FROM events", store=False)(lambda spark, d: events.once(table(spark, d, "events").select("user_id", "event_type", "ts"), ["user_id", "event_type"]).select("user_id", "event_type"))
register("q_stream_queue", "SELECT event_id AS chunk_id, CASE WHEN event_type <> 'error' THEN 'done' WHEN event_id % 3 + 1 >= 3 THEN 'failed' ELSE 'pending' END AS status, (event_id % 3 + 1)::BIGINT AS attempts FROM events", store=False)(lambda spark, d: events.queue_step(table(spark, d, "events").select(F.col("event_id").alias("chunk_id"), F.expr("event_id % 3").alias("attempts")), table(spark, d, "events").filter("event_type = 'error'").select(F.col("event_id").alias("chunk_id"))))


from . import catalogue_notes  # noqa: E402, F401  (registers the queries of notes, schemas and edits)
