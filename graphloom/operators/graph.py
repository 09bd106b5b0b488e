"""Identity and link resolution, and bounded traversal."""

from __future__ import annotations

import unicodedata
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import fold_typography, nfc
from ..plans.shared import written
from ..plans.store import GraphStore

TIERS = ("exact", "nfc", "typographic")


def names(nodes: DataFrame) -> DataFrame:
    """(id, name, tier): what a node can be named by, its title (tier 0) and its path's suffixes (tier 1)."""
    stem = F.regexp_replace("id", r"\.md$", "")
    parts = F.split(stem, "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    paths = nodes.select("id", F.explode(suffixes).alias("name"))
    every = nodes.select("id", F.col("title").alias("name"), F.lit(0).alias("tier")).unionByName(paths.select("id", "name", F.lit(1).alias("tier")))
    return every.select("id", fold_typography(F.col("name")).alias("name"), "tier")


def lookup(nodes: DataFrame) -> DataFrame:
    """(name, tier, id): unique titles (tier 0) and unique path suffixes (tier 1)."""
    return unique(names(nodes))


def unique(every: DataFrame) -> DataFrame:
    """(name, tier, id) of the names that one node has."""
    return every.groupBy("name", "tier").agg(F.min("id").alias("id"), F.count("*").alias("n")).filter("n = 1").drop("n")


def resolve(targets: DataFrame, nodes: DataFrame) -> DataFrame:
    """targets (target) with resolved: a unique title, else a unique path suffix, else null."""
    keyed = with_keys(targets.withColumnRenamed("target", "target_id"))
    return resolve_keyed(keyed, names(nodes)).withColumnRenamed("target_id", "target").select(*targets.columns, "resolved")


def with_keys(edges: DataFrame) -> DataFrame:
    """edges (target_id) with the title (name) and path (stem) that their targets may mean."""
    return edges.withColumn("name", fold_typography(F.col("target_id"))).withColumn("stem", F.regexp_replace("name", r"\.md$", ""))


def resolve_keyed(edges: DataFrame, every: DataFrame, few: bool = False) -> DataFrame:
    """edges (name, stem) with resolved, by names(). With few, only the names that edges ask for are
    told apart, which saves grouping all of them."""
    if few:
        every = every.join(wanted(edges), ["name", "tier"], "left_semi")
    known = unique(every)
    by_title = known.filter("tier = 0").select("name", F.col("id").alias("__a"))
    by_path = known.filter("tier = 1").select(F.col("name").alias("stem"), F.col("id").alias("__b"))
    return edges.drop("resolved").join(by_title, "name", "left").join(by_path, "stem", "left").withColumn("resolved", F.coalesce("__a", "__b")).drop("__a", "__b")


def resolve_edges(edges: DataFrame, nodes: DataFrame, few: bool = False) -> DataFrame:
    """edges with resolved worked out anew for all of them."""
    found = resolve_keyed(with_keys(edges.select("target_id").distinct()), names(nodes), few).select("target_id", "resolved")
    return edges.drop("resolved").join(found, "target_id", "left")


def moved(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, tier) that other nodes have in new than in old (both from names(), of some nodes)."""
    both = old.select("name", "tier", "id").unionByName(new.select("name", "tier", "id"))
    return both.groupBy("name", "tier", "id").count().filter("count = 1").select("name", "tier").distinct()


def named(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """edges (name, stem) with hit: whether their target may mean one of changed (name, tier)."""
    title = changed.filter("tier = 0").select("name", F.lit(True).alias("__t"))
    path = changed.filter("tier = 1").select(F.col("name").alias("stem"), F.lit(True).alias("__p"))
    return edges.join(title, "name", "left").join(path, "stem", "left").withColumn("hit", F.coalesce("__t", "__p", F.lit(False))).drop("__t", "__p")


def asking(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """edges (name, stem) whose target may mean one of changed (name, tier), which are so few that they are told where
    edges are read; an edge that means a title and a path comes twice."""
    title, path = (F.broadcast(changed.filter(f"tier = {k}").select(F.col("name").alias(c))) for k, c in enumerate(("name", "stem")))
    return edges.join(title, "name", "left_semi").select(*edges.columns).unionByName(edges.join(path, "stem", "left_semi").select(*edges.columns))


def wanted(edges: DataFrame) -> DataFrame:
    """(name, tier) that edges (name, stem) may mean."""
    return edges.select(F.explode(F.array(F.struct(F.lit(0).alias("tier"), "name"), F.struct(F.lit(1).alias("tier"), F.col("stem").alias("name")))).alias("w")).select("w.*").distinct()


def relinked(edges: DataFrame, nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """edges, those that may mean one of the changed names resolved anew."""
    columns = edges.columns
    all_ = named(with_keys(edges), changed)
    return all_.filter("not hit").select(*columns).unionByName(resolve_keyed(all_.filter("hit").drop("hit"), names(nodes), few=True).select(*columns))


def reference_counts(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count("resolved").alias("resolved"), F.count_if(F.col("resolved").isNull()).alias("unresolved"))


def resolve_many(wanted: DataFrame, nodes: DataFrame, by: str = "id") -> DataFrame:
    """wanted (identifier) with id, tier and the number of candidates: the first tier (exact, composed
    and lower case, typographic) in which a node is found; by title, a tier with several stops."""
    column = F.col("id") if by == "id" else F.col("title")
    exact = (lambda c: c) if by == "id" else F.lower
    tiers = (exact, lambda c: F.lower(nfc(c)), fold_typography)
    rows = wanted.select("identifier").distinct()
    out = rows
    for k, f in enumerate(tiers):
        names = nodes.filter(column.isNotNull()).select(f(column).alias("__n"), "id").groupBy("__n").agg(F.min("id").alias(f"__id{k}"), F.count("*").alias(f"__c{k}"))
        out = out.withColumn("__n", f(F.col("identifier"))).join(names, "__n", "left").drop("__n")
    some = [F.coalesce(F.col(f"__c{k}"), F.lit(0)) for k in range(3)]
    # by id only a tier with one node counts; by title the first tier with any
    good = [c == 1 if by == "id" else c > 0 for c in some]
    tier, found, n = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(0).cast("long")
    for k in reversed(range(3)):
        tier = F.when(good[k], TIERS[k]).otherwise(tier)
        found = F.when(good[k], F.when(some[k] == 1, F.col(f"__id{k}"))).otherwise(found)
        n = F.when(good[k], some[k]).otherwise(n)
    return out.select("identifier", found.alias("id"), tier.alias("tier"), n.alias("candidates"))


def resolve_identifier(nodes: DataFrame, identifier: str, by: str = "id") -> dict:
    """id (or None), tier and number of candidates of one identifier. An exact or composed id is
    looked up directly."""
    if by == "id":
        for text, tier in ((identifier, "exact"), (unicodedata.normalize("NFC", identifier), "nfc")):
            if not nodes.filter(F.col("id") == text).limit(1).isEmpty():
                return {"id": text, "tier": tier, "candidates": 0}
    spark = nodes.sparkSession
    r = resolve_many(spark.createDataFrame([(identifier,)], "identifier string"), nodes, by).first()
    return {"id": r["id"], "tier": r["tier"], "candidates": 0 if r["id"] else r["candidates"]}


def traverse(store: GraphStore, root: str, depth: int | None = 2, direction: str = "outgoing", rel_types: list[str] | None = None, target_types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, depth) of nodes within depth (1 to 10) hops without the root, those of target_types
    only, and the links met, each once. Depth None goes on until a round reaches nothing new.

    Each round writes the nodes it reached, so that the plan of a round doesn't hold those before.
    """
    depth = None if depth is None else min(max(depth, 1), 10)
    spark = store.nodes.sparkSession
    e = store.edges if "edge_id" in store.edges.columns else numbered(store.edges)
    e = e.filter("resolved is not null")
    if rel_types:
        e = e.filter(F.col("rel_type").isin(rel_types))
    ways = {"outgoing": [("source_id", "resolved")], "incoming": [("resolved", "source_id")], "both": [("source_id", "resolved"), ("resolved", "source_id")]}[direction]
    frontier, ids = spark.createDataFrame([(root,)], "id string"), [root]
    seen = spark.createDataFrame([(root, 0)], "id string, depth int")
    met = None
    for d in count(1) if depth is None else range(1, depth + 1):
        steps = None
        for a, b in ways:
            if ids is not None:  # a short list of ids is looked up in the links
                hop = e.filter(F.col(a).isin(ids))
            else:
                hop = e.join(frontier.withColumnRenamed("id", a), a, "left_semi")
            met = hop.select("edge_id", *EDGE) if met is None else met.unionByName(hop.select("edge_id", *EDGE))
            hop = hop.select(F.col(b).alias("id"))
            steps = hop if steps is None else steps.unionByName(hop)
        if d == depth and ids is None:
            frontier = steps.distinct().join(seen.select("id"), "id", "left_anti")
            seen = seen.unionByName(frontier.withColumn("depth", F.lit(d)))
            break
        new = steps.distinct().join(seen.select("id"), "id", "left_anti")
        if ids is not None:
            got = [r[0] for r in new.limit(FEW + 1).collect()]
            if len(got) <= FEW:
                ids = got
                if not ids:
                    break
                rows = spark.createDataFrame([(i, d) for i in ids], "id string, depth int")
                seen = seen.unionByName(rows)
                continue
            ids = None
        frontier = written(new, "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(d)))
    nodes = seen.filter("depth > 0")
    if target_types:
        nodes = nodes.join(store.types.filter(F.col("schema_type").isin(target_types)).select(F.col("node_id").alias("id")), "id", "left_semi")
    # a link may be met from both of its ends
    return nodes, met.dropDuplicates(["edge_id"]).select(*EDGE)


def numbered(edges: DataFrame) -> DataFrame:
    """edges with edge_id: links are a bag, and equal ones are told apart by their number."""
    return written(edges.withColumn("edge_id", F.monotonically_increasing_id()), "edges")


EDGE = ("source_id", "target_id", "rel_type", "resolved", "context")
#: Nodes of a round that are looked up by a list of ids.
FEW = 1_000


def hydrated(store: GraphStore, nodes: DataFrame) -> DataFrame:
    """Nodes of a traversal with their labels, fields and depth."""
    from .query import hydrate

    return hydrate(store, nodes.join(store.nodes.select("id", "title"), "id").select("id", "title", "depth"))
