"""Notes to store: rebuild, incremental index, upsert, reconcile; and the same on a durable store, which
keeps versions and resolves again only links that may mean a name that came or went."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import TABLES, Conflict, Durable, Snapshot
from ..plans.schemas import POLICIES, Schema
from ..plans.shared import scratch, written
from ..plans.store import GraphStore
from ..sources import notes as N
from ..sources.notes import parsed
from . import changes, coercion, graph, text
from .query import QueryError


#: What the header of a note tells, and its body; links stand in both.
HEAD, BODY = ("nodes", "types", "fields", "named"), ("linked", "contents", "chunks")


class Index:
    """A store with the files it was built from (path, mtime, hash) and the chunks of their texts
    (node_id, chunk_index, heading, content, token_count). Headers and bodies are parsed when a table
    that needs them is first asked for: what changed is told by the files alone."""

    def __init__(self, files: DataFrame, make: Callable[[str], dict[str, DataFrame]]):
        self.files, self.part = files, cache(make)

    def table(self, name: str) -> DataFrame:
        """A table of the store, or the chunks."""
        if name == "edges":
            links, nodes = self.table("named").unionByName(self.table("linked")), self.table("nodes")
            return graph.resolve_edges(links, nodes).select("source_id", "target_id", "rel_type", "resolved", "context")
        return self.part("head" if name in HEAD else "body")[name]

    @cached_property
    def store(self) -> GraphStore:
        return GraphStore(*map(self.table, ("nodes", "types", "fields", "edges", "contents")))

    @property
    def chunks(self) -> DataFrame:
        return self.table("chunks")


def build(notes: DataFrame) -> Index:
    """Full rebuild from notes (path, mtime, raw), which are kept as they are now. Each header and each body is parsed once."""
    found = written(notes.select("path", F.col("mtime").cast("timestamp").alias("mtime"), F.sha2("raw", 256).alias("hash"), "raw"), "notes")
    return Index(found.drop("raw"), lambda part: _tables_of(_parsed(found, (part,)), HEAD if part == "head" else BODY))


def _parsed(notes: DataFrame, parts: tuple[str, ...] = ("head", "body")) -> DataFrame:
    return written(parsed(notes, parts).drop("content_md"), "parsed")  # no table holds the body as it was


def _tables_of(rows: DataFrame, names: tuple[str, ...]) -> dict[str, DataFrame]:
    """Tables of parsed notes; links are not resolved, and are those of the parts that were parsed."""
    id_, time = F.col("id").alias("node_id"), F.col("mtime").cast("timestamp_ntz")
    links = lambda: rows.select(F.col("id").alias("source_id"), F.explode("edges").alias("e")).select("source_id", "e.*")
    make = {
        "nodes": lambda: rows.select("id", "title", time.alias("indexed_at"), time.alias("file_mtime")),
        "types": lambda: rows.select(id_, F.explode("types").alias("schema_type")),
        "fields": lambda: rows.select(id_, F.explode("fields").alias("f")).select("node_id", "f.*"),
        "named": links, "linked": links, "edges": links,
        "contents": lambda: rows.select(id_, "content_text"),
        "chunks": lambda: rows.select(id_, F.explode("chunks").alias("c")).select("node_id", "c.*"),
        "files": lambda: rows.select(F.col("id").alias("path"), "mtime", "hash"),
    }
    return {t: make[t]() for t in names}


# ---- durable --------------------------------------------------------------------------------


def _tables(notes: DataFrame) -> dict[str, DataFrame]:
    """The rows of all tables for notes (path, mtime, raw); links are not resolved."""
    return _with_derived(_tables_of(_parsed(notes), ("nodes", "types", "fields", "edges", "contents", "files", "chunks")))


def _with_derived(rows: dict[str, DataFrame], few: bool = False) -> dict[str, DataFrame]:
    """rows with the names of nodes and the postings of texts, which are dealt over tasks unless they are few."""
    index = text.postings(rows["contents"], "node_id", "content_text", few)
    return rows | {"names": graph.names(rows["nodes"]), "postings": index.postings, "lengths": index.lengths}


def _numbered(edges: DataFrame) -> DataFrame:
    """Links with numbers that no other run has: links are a bag."""
    return edges.select("source_id", "target_id", "rel_type", "resolved", "context", "name", "stem").withColumn("edge_id", F.expr("uuid()"))


def create(durable: Durable, notes: DataFrame) -> Snapshot:
    """The first version of a durable store, or one that replaces all there is."""
    with scratch():
        rows = _tables(notes)
        rows["edges"] = _numbered(graph.resolve_keyed(graph.with_keys(rows["edges"]), rows["names"]))
        return _commit(durable.open(), rows, replace=True)


def advance(snapshot: Snapshot, notes: DataFrame, strict_hash: bool = False, compact_after: int = 24) -> tuple[Snapshot, DataFrame]:
    """The next version after a new listing of notes (path, mtime, raw), and the counts (indexed,
    skipped, deleted), as incremental() does it. Without a change there is no new version.

    Only new and changed notes are parsed, and only links that may mean a name that came or went are
    resolved again. After compact_after commits the runs are made one.
    """
    with scratch():
        return _advance(snapshot, notes, strict_hash, compact_after)


def _advance(snapshot: Snapshot, notes: DataFrame, strict_hash: bool, compact_after: int) -> tuple[Snapshot, DataFrame]:
    spark = notes.sparkSession
    now = notes.select("path", F.col("mtime").cast("timestamp").alias("mtime"), F.sha2("raw", 256).alias("hash"))
    plan = written(changes.diff(snapshot.table("files"), now, strict_hash), "diff")
    found = {r["action"]: r["count"] for r in plan.groupBy("action").count().collect()}
    n = lambda *actions: sum(found.get(a, 0) for a in actions)
    counts = spark.createDataFrame([(n("new", "changed"), n("skip", "touch"), n("deleted"))], "indexed long, skipped long, deleted long")
    if not n("new", "changed", "deleted", "touch"):
        return snapshot, counts
    touched = plan.filter("action = 'touch'").select("path").join(now, "path")
    if n("new", "changed", "deleted"):
        fresh = _tables(notes.join(plan.filter("action in ('new', 'changed')").select("path"), "path", "left_semi"))
        gone = plan.filter("action in ('changed', 'deleted')").select(F.col("path").alias("node_id"))
        return _compacted(apply(snapshot, fresh, gone, touched if n("touch") else None), compact_after), counts
    out = _commit(snapshot, {"files": touched}, touched.select(F.col("path").alias("node_id"), F.lit("files").alias("area")))
    return _compacted(out, compact_after), counts


#: Rows that are so few that each task can hold them.
FEW = 10_000


def _few(rows: DataFrame) -> bool:
    return rows.limit(FEW + 1).count() <= FEW


def apply(snapshot: Snapshot, fresh: dict[str, DataFrame], gone: DataFrame, touched: DataFrame | None = None, few: bool = False) -> Snapshot:
    """The next version: the rows of gone (node_id) void, those of fresh (links not resolved) added, the
    files of touched (path, mtime, hash) replaced, and the links of other nodes that may mean one of
    the names that came or went resolved again. With few, gone and fresh are the nodes of a batch: they, and
    what they change as long as it is few, are told where tables are read, so that no table is shuffled for them."""
    gone = gone.distinct()
    names = snapshot.table("names")
    kept_names = names.join(gone.withColumnRenamed("node_id", "id"), "id", "left_anti")
    changed = written(graph.moved(names.join(gone.withColumnRenamed("node_id", "id"), "id", "left_semi"), fresh["names"]), "moved")
    new = graph.with_keys(fresh["edges"].drop("resolved"))
    void = gone.select("node_id", F.lit("all").alias("area"))
    if not changed.isEmpty():
        few = few and _few(changed)
        others = snapshot.table("edges").join(gone.withColumnRenamed("node_id", "source_id"), "source_id", "left_anti")
        # a node's links are void together, so that all links of a node with such a link are written
        asking = graph.asking(others, changed) if few else graph.named(others.select("source_id", "name", "stem"), changed).filter("hit")
        sources = written(asking.select("source_id").distinct(), "relinked")
        few = few and _few(sources)
        mine = others.join(F.broadcast(sources) if few else sources, "source_id", "left_semi").select(*new.columns)
        new = new.unionByName(written(mine, "links") if few else mine)
        void = void.unionByName(sources.select(F.col("source_id").alias("node_id"), F.lit("edges").alias("area")))
    every = kept_names.select("name", "tier", "id").unionByName(fresh["names"].select("name", "tier", "id"))
    if few:
        every = every.join(F.broadcast(graph.wanted(new)), ["name", "tier"], "left_semi")
    edges = graph.resolve_keyed(new, every, few=not few)
    rows = fresh | {"edges": _numbered(edges)}
    if touched is not None:
        rows["files"] = rows["files"].unionByName(touched.select(*rows["files"].columns))
        void = void.unionByName(touched.select(F.col("path").alias("node_id"), F.lit("files").alias("area")))
    return _commit(snapshot, rows, void)


def commit_batch(snapshot: Snapshot, operations: list[dict], schemas: dict[str, Schema] | None = None) -> Snapshot:
    """The next version after create, update, delete, link and unlink in order, all of them or none. Where
    an operation fails, or another writer was faster (CONFLICT), the published version stays."""
    overlay = changes.draft(snapshot.store, operations, schemas)
    ids = overlay.touched
    if not ids:
        return snapshot
    spark = snapshot.durable.spark
    rows = overlay.rows(spark)
    chunks = [(i, *c) for i in ids if overlay.after[i] is not None for c in N.chunks(N.Note("", [], [], "", N.blocks(overlay.after[i].text or "")))]
    rows["chunks"] = spark.createDataFrame(chunks, "node_id string, chunk_index int, heading string, content string, token_count int")
    # files are as they were found: a note that is still there stays known, so that advance() sees its change
    here = spark.createDataFrame([(i,) for i in ids if overlay.after[i] is not None], "path string")
    few = len(ids) <= FEW
    hint = F.broadcast if few else lambda d: d
    rows["files"] = snapshot.table("files").join(hint(here), "path", "left_semi")
    with scratch():
        return apply(snapshot, _with_derived(rows, few=True), hint(spark.createDataFrame([(i,) for i in ids], "node_id string")), few=few)


def normalize(snapshot: Snapshot, declared: DataFrame, apply_: bool = False) -> tuple[Snapshot, DataFrame]:
    """The rules that fields need to be as declared (schema_type, key, field_type), with the notes they touch
    (coercion.audit()), and with apply_ the next version, in which keys are renamed and lists are lists,
    links of a renamed field with them. Only fields and links of notes that a rule touches are written;
    roll_back() to the version before undoes it."""
    fields, types = snapshot.table("fields"), snapshot.table("types")
    with scratch():
        # what declarations may mean, read once: rules, report and the notes that are touched are told by it
        some = written(coercion.named_in(fields.select("node_id", "key", "value_type"), declared), "declared")
        rules = written(coercion.infer_rules(some, types, declared), "rules")
        report = coercion.audit(some, rules)
        report = fields.sparkSession.createDataFrame(report.collect(), report.schema)  # a row for each rule
        if not apply_ or rules.isEmpty():
            return snapshot, report
        mine = rules.select("action", F.col("from_key").alias("key")).distinct()
        hit = some.join(F.broadcast(mine), "key").filter("action = 'rename_key' or value_type <> 'list'").select("node_id").distinct()
        hit = written(hit, "normalized")
        before = fields.join(hit, "node_id", "left_semi")
        after = coercion.normalized(before, rules)
        after = after.withColumns({"value_number": F.when(F.col("value_type") == "number", F.col("value_text").cast("double")), "value_date": F.when(F.col("value_type") == "date", F.col("value_text"))})
        rows, void = {"fields": after}, hit.select("node_id", F.lit("fields").alias("area"))
        # a field is renamed where the note has no field of the new name; a node's links are void together, so that
        # all links of a node with a link of such a field are written, and none of the others
        renames = rules.filter("action = 'rename_key'").select(F.col("from_key").alias("rel_type"), "to_key")
        edges, nodes = snapshot.table("edges"), hit.withColumnRenamed("node_id", "source_id")
        linked = edges.select("source_id", "rel_type").join(F.broadcast(renames.select("rel_type").distinct()), "rel_type", "left_semi")
        linked = written(linked.join(nodes, "source_id", "left_semi").select("source_id").distinct(), "linked")
        if not linked.isEmpty():
            have = coercion.renamed_to(before, renames).withColumnRenamed("node_id", "source_id")
            links = edges.join(linked, "source_id", "left_semi").join(F.broadcast(renames), "rel_type", "left").join(have, "source_id", "left")
            links = links.withColumn("rel_type", F.when(F.col("to_key").isNotNull() & ~coercion.has_renamed(), F.col("to_key")).otherwise(F.col("rel_type")))
            rows["edges"] = links.select(*edges.columns)
            void = void.unionByName(linked.select(F.col("source_id").alias("node_id"), F.lit("edges").alias("area")))
        return _commit(snapshot, rows, void), report


def advance_normalized(snapshot: Snapshot, notes: DataFrame, declared: DataFrame, policy: str = "warn") -> tuple[Snapshot, DataFrame, DataFrame]:
    """advance(), then normalize() as a policy says: off not at all, warn for its report, fix with a version
    of its own. The counts and the report come with it."""
    if policy not in POLICIES["normalize_on_index"]:
        raise QueryError("VALIDATION_ERROR", f"unknown policy {policy}")
    out, counts = advance(snapshot, notes)
    if policy == "off":
        return out, counts, coercion.infer_rules(out.table("fields"), out.table("types"), declared).limit(0)
    out, report = normalize(out, declared, apply_=policy == "fix")
    return out, counts, report


def _commit(base: Snapshot, rows: dict[str, DataFrame], void: DataFrame | None = None, replace: bool = False) -> Snapshot:
    rows = {t: d.select(*(c.split(" ")[0] for c in TABLES[t].schema.split(", "))) for t, d in rows.items()}
    try:
        return base.durable.commit(base, rows, void, replace)
    except Conflict as e:
        raise QueryError("CONFLICT", str(e)) from e


def _compacted(snapshot: Snapshot, after: int) -> Snapshot:
    return snapshot.durable.compact(snapshot) if len(snapshot.runs.get("files", [])) > after else snapshot


# ---- within a session -----------------------------------------------------------------------


def upsert(index: Index, notes: DataFrame) -> Index:
    """The index with notes added or replaced; links are resolved anew at the end."""
    new = build(notes)
    return _merged(remove(index, new.files.select("path")), new)


def remove(index: Index, paths: DataFrame) -> Index:
    """The index without paths (path); links to them stay, unresolved."""
    ids = paths.select(F.col("path").alias("node_id")).distinct()

    key = {"nodes": "id", "named": "source_id", "linked": "source_id"}

    def left(part: str) -> dict[str, DataFrame]:
        return {t: d.join(ids.withColumnRenamed("node_id", k), k, "left_anti") for t, d in index.part(part).items() for k in (key.get(t, "node_id"),)}

    return Index(index.files.join(paths.select("path"), "path", "left_anti"), left)


def _merged(a: Index, b: Index) -> Index:
    return Index(a.files.unionByName(b.files), lambda part: {t: d.unionByName(b.part(part)[t]) for t, d in a.part(part).items()})


def incremental(index: Index, notes: DataFrame, strict_hash: bool = False) -> tuple[Index, DataFrame]:
    """The index after a new listing of notes (path, mtime, raw), and the counts (indexed, skipped,
    deleted); a plan on that of the index before, and so not for long chains, which advance() is for. A note of the same time is skipped without a look at it, unless strict_hash; one of
    the same content gets its new time."""
    spark = notes.sparkSession
    now = notes.select("path", F.col("mtime").cast("timestamp").alias("mtime"), F.sha2("raw", 256).alias("hash"))
    plan = written(changes.diff(index.files, now, strict_hash), "diff")
    counts = plan.agg(F.count_if(F.col("action").isin("new", "changed")).alias("indexed"), F.count_if(F.col("action").isin("skip", "touch")).alias("skipped"), F.count_if(F.col("action") == "deleted").alias("deleted"))
    counts = spark.createDataFrame([tuple(counts.first())], "indexed long, skipped long, deleted long")
    fresh, void = (plan.filter(F.col("action").isin(*a)).select("path") for a in (("new", "changed"), ("changed", "deleted")))
    out = index
    if not void.isEmpty():
        out = remove(out, void)
    if not fresh.isEmpty():
        out = _merged(out, build(notes.join(fresh, "path", "left_semi")))
    touched = plan.filter("action = 'touch'").select("path").join(now.select("path", F.col("mtime").alias("__m")), "path")
    files = out.files.join(touched, "path", "left").select("path", F.coalesce("__m", "mtime").alias("mtime"), "hash")
    return Index(files, out.part), counts


def reconcile(index: Index, notes: DataFrame) -> Index:
    """What a timer runs: an incremental index without normalisation."""
    return incremental(index, notes)[0]


def attach_chunks(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """hits (node_id, chunk_index) with heading and content of the chunk that matched."""
    return hits.join(chunks.select("node_id", "chunk_index", "heading", "content"), ["node_id", "chunk_index"], "left")


def vector_dimensions(vectors: DataFrame, column: str = "embedding") -> int | None:
    """The one length of all vectors, None without any; different lengths are an error."""
    found = [r[0] for r in vectors.select(F.size(column).alias("n")).distinct().limit(2).collect()]
    if len(found) > 1:
        raise ValueError(f"vectors of {found} dimensions")
    return found[0] if found else None


def requeue(chunks: DataFrame, vectors: DataFrame | None, dimensions: int) -> DataFrame:
    """The work queue (chunk_id, status, attempts): chunks without a vector, all of them where the
    vectors have other dimensions."""
    ids = chunks.select(F.concat_ws("#", "node_id", F.col("chunk_index").cast("string")).alias("chunk_id"))
    if vectors is not None and vector_dimensions(vectors) == dimensions:
        ids = ids.join(vectors.select("chunk_id"), "chunk_id", "left_anti")
    return ids.withColumns({"status": F.lit("pending"), "attempts": F.lit(0)})
