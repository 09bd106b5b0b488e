"""Snapshot change capture, and post-images of edits: create, update, link, rename, batches."""

from __future__ import annotations

import re
from copy import deepcopy
from dataclasses import dataclass
from dataclasses import field as dc_field
from datetime import date, datetime
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import json_items, safe_filename, strip_reference
from ..plans.schemas import Schema
from ..plans.store import GraphStore
from ..sources import notes as N
from . import graph
from .query import QueryError, check_path


def diff(old: DataFrame, new: DataFrame, strict_hash: bool = False) -> DataFrame:
    """(path, action) between two snapshots (path, mtime, hash): new, skip (same time), touch
    (same hash), changed or deleted. With strict_hash the same time proves nothing."""
    o, n = (d.select("path", F.col("mtime").alias(f"m{k}"), F.col("hash").alias(f"h{k}")) for k, d in (("o", old), ("n", new)))
    same = (F.col("mo") == F.col("mn")) & ((F.col("ho") == F.col("hn")) if strict_hash else F.lit(True))
    act = F.when(F.col("ho").isNull(), "new").when(F.col("hn").isNull(), "deleted").when(same, "skip").when(F.col("ho") == F.col("hn"), "touch").otherwise("changed")
    return o.join(n, "path", "full").select("path", act.alias("action"))


def _columns(v: Any) -> list[Column]:
    """value_text, value_type, value_number and value_date of a Python value."""
    kind = N.value_type(v)
    number = float(v) if kind == "number" else None
    return [F.lit(N.value_text(v)).alias("value_text"), F.lit(kind).alias("value_type"), F.lit(number).cast("double").alias("value_number"), F.lit(N.iso(v) if isinstance(v, (date, datetime)) else None).cast("string").alias("value_date")]


def update_fields(store: GraphStore, ids: DataFrame, values: dict[str, Any]) -> DataFrame:
    """Post-image of fields: typed values set on those nodes of ids (node_id) that exist; None deletes."""
    keys = list(values)
    hit = ids.select("node_id").distinct().join(store.nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    cols = ["node_id", "key", "value_text", "value_type", "value_number", "value_date"]
    inside = F.col("key").isin(keys)
    kept = store.fields.filter(~inside).unionByName(store.fields.filter(inside).join(hit, "node_id", "left_anti")).select(*cols)
    for k, v in values.items():
        if v is not None:
            kept = kept.unionByName(hit.select("node_id", F.lit(k).alias("key"), *_columns(v)))
    return kept


def update(store: GraphStore, ids: DataFrame, values: dict[str, Any] | None = None, title: str | None = None, types: list[str] | None = None, body: str | None = None, append: str | None = None) -> GraphStore:
    """The store after an update of the nodes ids (node_id). body replaces the text, append adds to it.

    Links follow: those of a field that is set go and the new value's come, those of the text go with
    it; links by a title that came or went are resolved anew.
    """
    if body is not None and append is not None:
        raise QueryError("VALIDATION_ERROR", "body and append exclude each other")
    hit = ids.select("node_id").distinct().join(store.nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    out = store if not values else store.changed(fields=update_fields(store, ids, values))
    mark = hit.select(F.col("node_id").alias("id"), F.lit(True).alias("__hit"))
    if title is not None:
        old = store.nodes.join(mark, "id", "left_semi").select("id", "title")
        out = out.changed(nodes=out.nodes.join(mark, "id", "left").withColumn("title", F.when(F.col("__hit"), F.lit(title)).otherwise(F.col("title"))).drop("__hit"))
        changed = graph.moved(graph.names(old), graph.names(old.withColumn("title", F.lit(title))))
        out = out.changed(edges=graph.relinked(out.edges, out.nodes, changed))
    if types is not None:
        new = hit.select("node_id", F.explode(F.array(*map(F.lit, types)) if types else F.array().cast("array<string>")).alias("schema_type"))
        out = out.changed(types=out.types.join(hit, "node_id", "left_anti").unionByName(new))
    if body is not None or append is not None:
        new = F.lit(body) if body is not None else F.concat(F.coalesce("content_text", F.lit("")), F.lit("\n\n"), F.lit(append))
        c = out.contents.join(hit.withColumn("__hit", F.lit(True)), "node_id", "left")
        out = out.changed(contents=c.select("node_id", F.when(F.col("__hit"), new).otherwise(F.col("content_text")).alias("content_text")))
    stale = [*(values or {}), *(["wiki-link"] if body is not None else [])]
    fresh = _links([(k, v) for k, v in (values or {}).items() if v is not None], body if body is not None else append)
    if stale or fresh:
        own = F.col("rel_type").isin(stale)
        kept = out.edges.filter(~own).unionByName(out.edges.filter(own).join(hit.withColumnRenamed("node_id", "source_id"), "source_id", "left_anti").select(*out.edges.columns)) if stale else out.edges
        columns = [c for c in ("source_id", "target_id", "rel_type", "resolved", "context") if c in kept.columns]
        if fresh:
            made = store.nodes.sparkSession.createDataFrame(fresh, "target_id string, rel_type string, context string")
            # resolved first: the new links of all nodes have the same few targets
            made = graph.resolve_edges(made, out.nodes, few=True)
            link = made.agg(F.collect_list(F.struct("target_id", "rel_type", "resolved", "context")).alias("l"))
            link = hit.withColumn("__one", F.lit(1)).join(F.broadcast(link.withColumn("__one", F.lit(1))), "__one").select(F.col("node_id").alias("source_id"), F.explode("l").alias("l")).select("source_id", "l.*")
            kept = kept.select(*columns).unionByName(link.select(*columns))
        out = out.changed(edges=kept.select(*columns))
    return out


def _links(values: list[tuple[str, Any]], body: str | None) -> list[tuple[str, str, str | None]]:
    return N.edges(N.Note("", [], values, body or "", N.blocks(body or "")))


def bulk_update(store: GraphStore, ids: DataFrame, values: dict[str, Any], dry_run: bool = False) -> tuple[GraphStore, DataFrame]:
    """The store after an update of ids and the ids; with dry_run the store as it is. Nothing is
    written in place, so that a run that fails changes nothing."""
    hit = ids.select("node_id").distinct().join(store.nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    return (store if dry_run else update(store, hit, values)), hit


def delete_nodes(store: GraphStore, ids: DataFrame) -> GraphStore:
    """Nodes and what belongs to them go; links to them stay and become dangling."""
    gone = ids.select("node_id").distinct()
    gid = gone.withColumnRenamed("node_id", "id")
    edges = store.edges.join(gone.withColumnRenamed("node_id", "source_id"), "source_id", "left_anti")
    edges = edges.join(gone.select(F.col("node_id").alias("resolved"), F.lit(True).alias("__gone")), "resolved", "left")
    edges = edges.select("source_id", "target_id", "rel_type", F.when(F.col("__gone").isNull(), F.col("resolved")).alias("resolved"), *(c for c in store.edges.columns if c in ("context", "edge_id")))
    contents = None if store.contents is None else store.contents.join(gone, "node_id", "left_anti")
    return GraphStore(store.nodes.join(gid, "id", "left_anti"), store.types.join(gone, "node_id", "left_anti"), store.fields.join(gone, "node_id", "left_anti"), edges, contents)


def _java_literal(text: str) -> str:
    return re.sub(r"([\\.*+?^${}()|\[\]])", r"\\\1", text)


def rename_in(c: Column, old: str, new: str) -> Column:
    """[[old]] and [[old|alias]] of a text become [[new]] and [[new|alias]], ignoring case."""
    to = new.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(c, F.lit(rf"(?iu)\[\[{_java_literal(old)}(\|[^\]]+)?\]\]"), F.lit(f"[[{to}$1]]"))


def rename_references(fields: DataFrame, old: str, new: str) -> DataFrame:
    return fields.withColumn("value_text", rename_in(F.col("value_text"), old, new))


def rename_node(store: GraphStore, node: str, title: str, path: str | None = None) -> GraphStore:
    """The store with a node of another title (and path): links by the old title in values, texts
    and the edge table follow."""
    found = store.nodes.filter(F.col("id") == node).select("title").first()
    if found is None:
        raise QueryError("NOT_FOUND", node)
    old, new_id = found["title"], path or node
    check_path(new_id)
    if new_id != node and not store.nodes.filter(F.col("id") == new_id).isEmpty():
        raise QueryError("CONFLICT", f"{new_id} exists")
    move = lambda c: F.when(F.col(c) == node, F.lit(new_id)).otherwise(F.col(c)).alias(c)
    rest = lambda d, done: [c for c in d.columns if c not in done]
    nodes = store.nodes.select(move("id"), F.when(F.col("id") == node, F.lit(title)).otherwise(F.col("title")).alias("title"), *rest(store.nodes, ("id", "title")))
    types = store.types.select(move("node_id"), "schema_type")
    fields = rename_references(store.fields, old, title)
    fields = fields.select(move("node_id"), *rest(fields, ("node_id",)))
    e = store.edges
    target = F.when((F.lower("target_id") == old.lower()) & (F.col("resolved") == node), F.lit(title)).otherwise(F.col("target_id"))
    edges = e.select(move("source_id"), target.alias("target_id"), "rel_type", move("resolved"), *rest(e, ("source_id", "target_id", "rel_type", "resolved")))
    contents = store.contents and store.contents.select(move("node_id"), rename_in(F.col("content_text"), old, title).alias("content_text"))
    return GraphStore(nodes, types, fields, edges, contents)


def remove_link(c: Column, target: str) -> Column:
    """A text without its links to target; three and more line ends become two, ends are trimmed."""
    link = rf"(?iu)\[\[\s*{_java_literal(target)}\s*(\|[^\]]+)?\]\]"
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, link, ""), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    return F.when(c.rlike(link), out).otherwise(c)


def link(store: GraphStore, source: str, target: str, rel_type: str, list_keys: tuple[str, ...] = (), field_keys: tuple[str, ...] = ()) -> GraphStore:
    """source linked to target: `wiki-link` and what is no field go to the text; a list field gets the
    link at its end unless it has it in any case; a single field is set."""
    if store.nodes.filter(F.col("id") == source).isEmpty():
        raise QueryError("NOT_FOUND", source)
    text, here = f"[[{target}]]", F.col("node_id") == source
    own = store.fields.filter(here & (F.col("key") == rel_type)).first() if rel_type != "wiki-link" else None
    listed = rel_type in list_keys or (own is not None and own["value_type"] == "list")
    if listed:
        items = [] if own is None else (N.plain(_json(own["value_text"])) if own["value_type"] == "list" else [own["value_text"]])
        if any(str(x).lower() == text.lower() for x in items):
            return store
        out = store.changed(fields=update_fields(store, _ids(store, source), {rel_type: [*items, text]}))
    elif rel_type != "wiki-link" and (rel_type in field_keys or own is not None):
        out = store.changed(fields=update_fields(store, _ids(store, source), {rel_type: text}))
        out = out.changed(edges=out.edges.filter(~((F.col("source_id") == source) & (F.col("rel_type") == rel_type))))
    else:
        return update(store, _ids(store, source), append=text)
    return _edge(out, source, target, rel_type, None)


def unlink(store: GraphStore, source: str, target: str, rel_type: str) -> GraphStore:
    """The inverse of link(): the link leaves the list, the field or the text."""
    text, here = f"[[{target}]]", (F.col("node_id") == source)
    own = store.fields.filter(here & (F.col("key") == rel_type)).first()
    if own is not None and own["value_type"] == "list":
        items = [x for x in _json(own["value_text"]) if str(x).lower() != text.lower()]
        out = store.changed(fields=update_fields(store, _ids(store, source), {rel_type: items or None}))
    elif own is not None and own["value_text"].lower() == text.lower():
        out = store.changed(fields=update_fields(store, _ids(store, source), {rel_type: None}))
    else:
        rel_type = "wiki-link"
        out = store.changed(contents=store.contents.select("node_id", F.when(here, remove_link(F.col("content_text"), target)).otherwise(F.col("content_text")).alias("content_text")))
    drop = (F.col("source_id") == source) & (F.lower("target_id") == target.lower()) & (F.col("rel_type") == rel_type)
    return out.changed(edges=out.edges.filter(~drop))


def _json(text: str) -> list:
    import json

    return json.loads(text)


def _ids(store: GraphStore, node: str) -> DataFrame:
    return store.nodes.sparkSession.createDataFrame([(node,)], "node_id string")


def _edge(store: GraphStore, source: str, target: str, rel_type: str, context: str | None) -> GraphStore:
    spark = store.nodes.sparkSession
    row = spark.createDataFrame([(source, target, rel_type, context)], "source_id string, target_id string, rel_type string, context string")
    new = graph.resolve_edges(row, store.nodes)
    cols = ["source_id", "target_id", "rel_type", "resolved", "context"]
    return store.changed(edges=store.edges.select(*cols).unionByName(new.select(*cols)))


def file_path(title: str, types: list[str], values: dict[str, Any], schemas: dict[str, Schema]) -> str:
    """The path of a new note: the template of its first type (in order) that has one, filled in."""
    template = next((schemas[t].template for t in sorted(types) if t in schemas and schemas[t].template), "{{title}}.md")
    known = {"title": title}
    for k, v in values.items():
        if v is not None:
            known[k] = N.iso(v)[:10] if isinstance(v, (date, datetime)) else re.sub(r"^\[\[(.+)\]\]$", r"\1", N.value_text(v))

    def fill(m: re.Match) -> str:
        if m[1] not in known:
            raise QueryError("VALIDATION_ERROR", f"{{{{{m[1]}}}}} of {template} has no value")
        return known[m[1]]

    path = re.sub(r"\{\{(\w+)\}\}", fill, template)
    return "/".join(re.sub(r"\s+", " ", re.sub(r'[\\:*?"<>|]', "", p)).strip() for p in path.split("/"))


def template_paths(template: str) -> Column:
    """file_path() as an expression over columns that bear the names of the template's variables; a
    note that lacks one gets null."""
    parts = re.split(r"\{\{(\w+)\}\}", template)
    cols = [F.lit(p) if i % 2 == 0 else F.regexp_replace(F.col(p).cast("string"), r"^\[\[(.+)\]\]$", "$1") for i, p in enumerate(parts) if p]
    return F.array_join(F.transform(F.split(F.concat(*cols), "/"), safe_filename), "/")


def create(store: GraphStore, notes: list[dict], schemas: dict[str, Schema] | None = None) -> GraphStore:
    """The store with new nodes (title, types, fields, body; optional path). A path that exists is a
    conflict. Links of values and body become edges."""
    spark = store.nodes.sparkSession
    rows, types, fields, edges, contents = [], [], [], [], []
    for n in notes:
        values = n.get("fields") or {}
        path = n.get("path") or file_path(n["title"], n.get("types") or [], values, schemas or {})
        check_path(path)
        note = N.Note(n["title"], n.get("types") or [], [(k, v) for k, v in values.items() if v is not None], n.get("body") or "", N.blocks(n.get("body") or ""))
        now = n.get("indexed_at") or datetime(2000, 1, 1)
        rows.append((path, n["title"], now, now))
        types += [(path, t) for t in dict.fromkeys(note.types)]
        fields += [(path, k, N.value_text(v), N.value_type(v), float(v) if N.value_type(v) == "number" else None, N.iso(v) if N.value_type(v) == "date" else None) for k, v in note.fields]
        edges += [(path, *e) for e in N.edges(note)]
        contents.append((path, N.content(note)))
    paths = [r[0] for r in rows]
    clash = [r[0] for r in store.nodes.filter(F.col("id").isin(paths)).select("id").collect()] or [p for p in paths if paths.count(p) > 1]
    if clash:
        raise QueryError("CONFLICT", f"{clash[0]} exists")
    make = spark.createDataFrame
    nodes = store.nodes.select("id", "title", "indexed_at", "file_mtime").unionByName(make(rows, "id string, title string, indexed_at timestamp_ntz, file_mtime timestamp_ntz"))
    out = GraphStore(
        nodes,
        store.types.unionByName(make(types, "node_id string, schema_type string")),
        store.fields.select("node_id", "key", "value_text", "value_type", "value_number", "value_date").unionByName(make(fields, "node_id string, key string, value_text string, value_type string, value_number double, value_date string")),
        store.edges,
        store.contents.unionByName(make(contents, "node_id string, content_text string")),
    )
    if edges:
        cols = ["source_id", "target_id", "rel_type", "resolved", "context"]
        new = graph.resolve_edges(make(edges, "source_id string, target_id string, rel_type string, context string"), nodes)
        out = out.changed(edges=store.edges.select(*cols).unionByName(new.select(*cols)))
    return out


@dataclass
class Draft:
    """A node as a batch has it in hand. Links are (target, rel_type, context)."""

    title: str
    indexed_at: datetime
    file_mtime: datetime
    types: list[str] = dc_field(default_factory=list)
    fields: dict[str, tuple] = dc_field(default_factory=dict)
    text: str | None = None
    links: list[tuple[str, str, str | None]] = dc_field(default_factory=list)

    def set(self, key: str, value: Any) -> None:
        if value is None:
            self.fields.pop(key, None)
        else:
            kind = N.value_type(value)
            self.fields[key] = (N.value_text(value), kind, float(value) if kind == "number" else None, N.iso(value) if kind == "date" else None)

    def unlinked(self, drop) -> None:
        self.links = [x for x in self.links if not drop(*x)]


@dataclass
class Overlay:
    """What a batch has made of the nodes it touched: their state before and after, None where there
    is none. Its size is that of the operations, whatever that of the store."""

    before: dict[str, Draft | None]
    after: dict[str, Draft | None]

    @property
    def touched(self) -> list[str]:
        return [i for i in self.after if self.after[i] != self.before.get(i)]

    def rows(self, spark: SparkSession) -> dict[str, DataFrame]:
        """The rows of the nodes as they are after it; links are not resolved."""
        drafts = [(i, self.after[i]) for i in self.touched if self.after[i] is not None]
        make = spark.createDataFrame
        return {
            "nodes": make([(i, d.title, d.indexed_at, d.file_mtime) for i, d in drafts], "id string, title string, indexed_at timestamp_ntz, file_mtime timestamp_ntz"),
            "types": make([(i, t) for i, d in drafts for t in d.types], "node_id string, schema_type string"),
            "fields": make([(i, k, *v) for i, d in drafts for k, v in d.fields.items()], "node_id string, key string, value_text string, value_type string, value_number double, value_date string"),
            "edges": make([(i, *x) for i, d in drafts for x in d.links], "source_id string, target_id string, rel_type string, context string"),
            "contents": make([(i, d.text) for i, d in drafts if d.text is not None], "node_id string, content_text string"),
        }

    def names(self, spark: SparkSession, which: dict[str, Draft | None]) -> DataFrame:
        return graph.names(spark.createDataFrame([(i, which[i].title) for i in self.touched if which.get(i) is not None], "id string, title string"))

    def renames(self) -> bool:
        """Whether a node comes, goes or gets another title."""
        return any((self.after[i] and self.after[i].title) != (self.before.get(i) and self.before[i].title) for i in self.touched)


def draft(store: GraphStore, operations: list[dict], schemas: dict[str, Schema] | None = None) -> Overlay:
    """The operations applied in order to the nodes that they name, which are read once, with one look at
    each table however many operations there are. An operation that fails raises."""
    created = [_created(i, op, schemas) if op.get("op") == "create" else None for i, op in enumerate(operations)]
    wanted = {str(op.get("id") or op.get("source")) for op in operations if op.get("op") != "create"} | {c[0] for c in created if c}
    before = _read(store, sorted(wanted))
    after: dict[str, Draft | None] = {i: deepcopy(d) for i, d in before.items()}
    for i, op in enumerate(operations):
        try:
            _apply(after, op, created[i])
        except QueryError as e:
            raise QueryError(e.code, f"operation {i}: {e}") from e
    return Overlay(before, after)


def _created(i: int, op: dict, schemas: dict[str, Schema] | None) -> tuple[str, Draft]:
    values, body, types = op.get("fields") or {}, op.get("body") or "", op.get("types") or []
    try:
        path = op.get("path") or file_path(op["title"], types, values, schemas or {})
        check_path(path)
    except QueryError as e:
        raise QueryError(e.code, f"operation {i}: {e}") from e
    note = N.Note(op["title"], types, [(k, v) for k, v in values.items() if v is not None], body, N.blocks(body))
    now = op.get("indexed_at") or datetime(2000, 1, 1)
    made = Draft(op["title"], now, now, list(dict.fromkeys(types)), text=N.content(note), links=N.edges(note))
    for k, v in note.fields:
        made.set(k, v)
    return path, made


def _read(store: GraphStore, ids: list[str]) -> dict[str, Draft | None]:
    some = lambda d, c: d.filter(F.col(c).isin(ids)).collect()
    found: dict[str, Draft | None] = {r["id"]: Draft(r["title"], r["indexed_at"], r["file_mtime"]) for r in some(store.nodes, "id")}
    for r in some(store.types, "node_id"):
        if r["node_id"] in found:
            found[r["node_id"]].types.append(r["schema_type"])
    for r in some(store.fields, "node_id"):
        if r["node_id"] in found:
            found[r["node_id"]].fields[r["key"]] = (r["value_text"], r["value_type"], r["value_number"], r["value_date"])
    for r in some(store.edges, "source_id"):
        if r["source_id"] in found:
            found[r["source_id"]].links.append((r["target_id"], r["rel_type"], r["context"]))
    for r in some(store.contents, "node_id"):
        if r["node_id"] in found:
            found[r["node_id"]].text = r["content_text"]
    return found


def _apply(nodes: dict[str, Draft | None], op: dict, created: tuple[str, Draft] | None) -> None:
    action, args = op.get("op"), {k: v for k, v in op.items() if k != "op"}
    if created is not None:
        path, made = created
        if nodes.get(path) is not None:
            raise QueryError("CONFLICT", f"{path} exists")
        nodes[path] = made
        return
    if action not in ("update", "delete", "link", "unlink"):
        raise QueryError("VALIDATION_ERROR", f"unknown operation {action}")
    node = args.pop("id" if action in ("update", "delete") else "source")
    own = nodes.get(node)
    if own is None:
        raise QueryError("NOT_FOUND", node)
    if action == "delete":
        nodes[node] = None
    else:
        {"update": _updated, "link": _linked, "unlink": _unlinked}[action](own, **args)


def _updated(own: Draft, values: dict[str, Any] | None = None, title: str | None = None, types: list[str] | None = None, body: str | None = None, append: str | None = None) -> None:
    if body is not None and append is not None:
        raise QueryError("VALIDATION_ERROR", "body and append exclude each other")
    for k, v in (values or {}).items():
        own.set(k, v)
    own.title = own.title if title is None else title
    own.types = own.types if types is None else list(dict.fromkeys(types))
    if body is not None:
        own.text = body
    elif append is not None:
        own.text = f"{own.text or ''}\n\n{append}"
    own.unlinked(lambda target, kind, context: kind in (values or {}) or body is not None and kind == "wiki-link")
    own.links += _links([(k, v) for k, v in (values or {}).items() if v is not None], body if body is not None else append)


def _items_of(own: Draft, key: str) -> list:
    text, kind = own.fields[key][:2]
    return _json(text) if kind == "list" else [text]


def _linked(own: Draft, target: str, rel_type: str, list_keys: tuple[str, ...] = (), field_keys: tuple[str, ...] = ()) -> None:
    text, field = f"[[{target}]]", own.fields.get(rel_type) if rel_type != "wiki-link" else None
    if rel_type in list_keys or (field is not None and field[1] == "list"):
        items = [] if field is None else _items_of(own, rel_type)
        if any(str(x).lower() == text.lower() for x in items):
            return
        own.set(rel_type, [*items, text])
        own.links.append((target, rel_type, None))
    elif rel_type != "wiki-link" and (rel_type in field_keys or field is not None):
        own.set(rel_type, text)
        own.unlinked(lambda t, kind, c: kind == rel_type)
        own.links.append((target, rel_type, None))
    else:
        own.text = f"{own.text or ''}\n\n{text}"
        own.links.append((target, "wiki-link", text))


def _unlinked(own: Draft, target: str, rel_type: str) -> None:
    text, field = f"[[{target}]]", own.fields.get(rel_type)
    if field is not None and field[1] == "list":
        own.set(rel_type, [x for x in _items_of(own, rel_type) if str(x).lower() != text.lower()] or None)
    elif field is not None and field[0].lower() == text.lower():
        own.set(rel_type, None)
    else:
        rel_type, link = "wiki-link", re.compile(rf"\[\[\s*{re.escape(target)}\s*(\|[^\]]+)?\]\]", re.I)
        if own.text and link.search(own.text):
            own.text = re.sub(r"\n{3,}", "\n\n", link.sub("", own.text)).strip()
    own.unlinked(lambda t, kind, c: kind == rel_type and t.lower() == target.lower())


def batch(store: GraphStore, operations: list[dict], schemas: dict[str, Schema] | None = None) -> GraphStore:
    """The store after create, update, delete, link and unlink in order, all of them or none: an
    operation that fails raises, and the store that was given is as it was. The plan of the result
    is that of one change, however many operations there are."""
    return applied(store, draft(store, operations, schemas))


def applied(store: GraphStore, overlay: Overlay) -> GraphStore:
    """The store with the touched nodes' rows replaced; links are resolved once, those of other
    nodes only where they may mean a name that came or went."""
    spark, ids = store.nodes.sparkSession, overlay.touched
    if not ids:
        return store
    rows = overlay.rows(spark)
    out = {}
    for name, key in (("nodes", "id"), ("types", "node_id"), ("fields", "node_id"), ("contents", "node_id")):
        new = rows[name]
        out[name] = getattr(store, name).filter(~F.col(key).isin(ids)).select(*new.columns).unionByName(new)
    columns = ["source_id", "target_id", "rel_type", "resolved", "context"]
    others = store.edges.filter(~F.col("source_id").isin(ids)).select(*columns)
    if overlay.renames():
        others = graph.relinked(others, out["nodes"], graph.moved(overlay.names(spark, overlay.before), overlay.names(spark, overlay.after)))
    new = graph.resolve_edges(rows["edges"], out["nodes"], few=True)
    return store.changed(**out, edges=others.unionByName(new.select(*columns)))


def meeting_notes(store: GraphStore, title: str, day: date, attendees: list[str], body: str, project: str | None = None, schemas: dict[str, Schema] | None = None) -> GraphStore:
    """A meeting note and a note for each attendee that has none, in one batch."""
    have = {r[0].lower() for r in store.nodes.filter(F.lower("title").isin([a.lower() for a in attendees])).select("title").collect()}
    people = [{"op": "create", "title": a, "types": ["person"]} for a in dict.fromkeys(attendees) if a.lower() not in have]
    values = {"date": datetime(day.year, day.month, day.day), "attendees": [f"[[{a}]]" for a in attendees], "project": f"[[{project}]]" if project else None}
    return batch(store, [*people, {"op": "create", "title": title, "types": ["meeting"], "fields": values, "body": body}], schemas)


def extract_tasks(store: GraphStore, source: str, tasks: list[dict], schemas: dict[str, Schema] | None = None) -> GraphStore:
    """A task note for each task (title, fields) with a link back to the note it comes from."""
    found = store.nodes.filter(F.col("id") == source).select("title").first()
    if found is None:
        raise QueryError("NOT_FOUND", source)
    back = {"source": f"[[{found['title']}]]", "status": "todo"}
    return batch(store, [{"op": "create", "title": t["title"], "types": ["task"], "fields": back | (t.get("fields") or {})} for t in tasks], schemas)


__all__ = ["batch", "bulk_update", "create", "delete_nodes", "diff", "extract_tasks", "file_path", "json_items", "link", "meeting_notes", "remove_link", "rename_in", "rename_node", "rename_references", "strip_reference", "template_paths", "unlink", "update", "update_fields"]
