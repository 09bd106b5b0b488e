"""Chunk vectors: nearest neighbours, also from cells around pivots, best chunk of each node, chunking, a hashing embedder."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import token_estimate
from ..plans.shared import written


def l2(v: Column, probe: list[float]) -> Column:
    p = F.array(*[F.lit(float(x)) for x in probe])
    return F.sqrt(F.aggregate(F.zip_with(v, p, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x))


def knn(chunks: DataFrame, probe: list[float], k: int, id: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """The k nearest rows with their distance; only the k rows of each partition meet."""
    return chunks.withColumn("distance", l2(F.col(vector), probe)).drop(vector).orderBy("distance", id).limit(k)


# ---- nearest neighbours from cells ----------------------------------------------------------

#: Most cells of an index, and vectors that their pivots are drawn from.
CELLS, DRAWN = 1_024, 20_000


@dataclass
class VectorIndex:
    """Vectors in folders by cell (rows: id columns, vector, cell, reach), reach being the distance of a
    vector to its cell's pivot; pivots and the least and largest reach of each cell (CELLS at most)."""

    rows: DataFrame
    pivots: np.ndarray
    low: np.ndarray
    high: np.ndarray
    vector: str


def cells(chunks: DataFrame, vector: str = "embedding", most: int | None = None) -> VectorIndex:
    """An index of vectors of one length, written in the shared folder: about sqrt(n) cells, each vector
    in that of the nearest pivot, sorted by its distance to it. Vectors that are null or hold null or NaN
    have no distance and are left out."""
    chunks = chunks.filter(F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)))
    n = chunks.count()
    most = most or max(1, min(CELLS, math.isqrt(n)))
    # the pivots only decide how much a search reads; it is exact with any
    drawn = chunks.select(F.col(vector).cast("array<double>").alias("v")).orderBy(F.xxhash64(F.lit(11), "v")).limit(DRAWN).collect()
    pool = np.unique(np.array([r["v"] for r in drawn], float), axis=0) if drawn else np.empty((0, 0))
    chosen, far = [0] if len(pool) else [], None
    while len(pool) and len(chosen) < most:
        d = ((pool - pool[chosen[-1]]) ** 2).sum(1)
        far = d if far is None else np.minimum(far, d)
        if far.max() <= 0:
            break
        chosen.append(int(far.argmax()))
    pivots = pool[chosen]

    def place(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf[vector].to_numpy()).astype(float)
            d = np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * x @ pivots.T + (pivots**2).sum(1)[None], 0))
            cell = d.argmin(1)
            # the nearest by rough distances; its own distance without cancellation
            yield pdf.assign(reach=np.sqrt(((x - pivots[cell]) ** 2).sum(1)), cell=cell.astype(np.int32))

    placed = chunks.mapInPandas(place, T.StructType([*chunks.schema.fields, T.StructField("reach", T.DoubleType()), T.StructField("cell", T.IntegerType())]))
    rows = written(placed.repartitionByRange("cell", "reach").sortWithinPartitions("cell", "reach"), "vectors", "cell")
    low, high = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
    for r in rows.groupBy("cell").agg(F.min("reach").alias("low"), F.max("reach").alias("high")).collect():
        low[r["cell"]], high[r["cell"]] = r["low"], r["high"]
    return VectorIndex(rows, pivots, low, high, vector)


def nearest(index: VectorIndex, probe: list[float], k: int, id: str = "chunk_id") -> tuple[DataFrame, int]:
    """knn() from an index, and how many cells were read.

    The cells nearest to the probe give k vectors, whose largest distance bounds that of the k nearest. By
    the triangle inequality no vector nearer than that has a distance to its pivot that differs more from
    the probe's; cells without such distances are not opened, and of the others only such rows are read.
    """
    none = index.rows.drop("cell", "reach", index.vector).withColumn("distance", F.lit(0.0)).limit(0)
    if not len(index.pivots) or k < 1:
        return none, 0
    to = np.sqrt(((index.pivots - np.array(probe, float)) ** 2).sum(1))
    # how near a vector of each cell may be
    bound = np.maximum(0, np.maximum(to - index.high, index.low - to))
    order = [int(c) for c in np.argsort(bound, kind="stable") if np.isfinite(bound[c])]
    limit, first, found = math.inf, [], 0
    while found < k and len(first) < len(order):
        first = order[: max(1, 2 * len(first))]
        got = knn(index.rows.filter(F.col("cell").isin(first)).select(id, index.vector), probe, k, id, index.vector).collect()
        found = len(got)
        limit = got[-1]["distance"] if found == k else math.inf
    limit = limit * (1 + 1e-12) + 1e-12
    need = [c for c in order if bound[c] <= limit]
    # a table of the cells' bounds, as a condition for each of a thousand cells is too deep an expression
    bounds = index.rows.sparkSession.createDataFrame([(c, float(to[c]) - limit, float(to[c]) + limit) for c in need], "cell int, __low double, __high double")
    near = index.rows.filter(F.col("cell").isin(need)).join(F.broadcast(bounds), "cell").filter(F.col("reach").between(F.col("__low"), F.col("__high")))
    return knn(near.drop("cell", "reach", "__low", "__high"), probe, k, id, index.vector), len(set(first) | set(need))


def best_per_node(hits: DataFrame, node: str = "node_id", id: str = "chunk_id") -> DataFrame:
    best = hits.groupBy(node).agg(F.min(F.struct("distance", F.col(id).alias("chunk_id"))).alias("b"))
    return best.select(node, F.col("b.chunk_id").alias("chunk_id"), F.col("b.distance").alias("distance"), (1 / (1 + F.col("b.distance"))).alias("score"))


def semantic_search(chunks: DataFrame, probe: list[float], limit: int = 10, allowed: DataFrame | None = None, prefilter: bool = False) -> DataFrame:
    """Best chunk of each node among the 3 * limit nearest; allowed(node_id) filters after that,
    or before with prefilter, which never returns too few."""
    if allowed is not None and prefilter:
        chunks = chunks.join(allowed, "node_id", "left_semi")
    hits = best_per_node(knn(chunks, probe, 3 * limit))
    if allowed is not None and not prefilter:
        hits = hits.join(allowed, "node_id", "left_semi")
    return hits.orderBy("distance", "node_id").limit(limit)


def chunk(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = 200) -> DataFrame:
    """(id, chunk_index, heading, content, token_count): one chunk for texts without a heading or
    under `least` estimated tokens, else the text before the first heading, if any, and one chunk
    for each heading of any depth, without the heading's line. For whole notes see notes.chunks()."""
    mark = r"(?m)^ {0,3}#{1,6}[ \t]+"
    headed = F.col(text).rlike(mark) & (token_estimate(F.col(text)) >= least)
    parts = F.when(headed, F.split(text, r"(?m)^(?= {0,3}#{1,6}[ \t])")).otherwise(F.array(text))
    kept = F.filter(parts, lambda p: (F.trim(p) != "") | ~headed)
    d = docs.select(id, headed.alias("__h"), F.posexplode(kept).alias("chunk_index", "part"))
    is_section = F.col("__h") & F.col("part").rlike("^ {0,3}#{1,6}[ \t]")
    heading = F.when(is_section, F.trim(F.regexp_extract("part", r"^ {0,3}#{1,6}[ \t]+([^\n]*)", 1)))
    content = F.when(is_section, F.regexp_replace("part", r"^[^\n]*\n?", "")).otherwise(F.col("part"))
    d = d.select(id, "chunk_index", heading.alias("heading"), F.regexp_replace(content, r"^\s+|\s+$", "").alias("content"))
    return d.withColumn("token_count", token_estimate(F.col("content")))


class Provider:
    """Texts to vectors in batches; embed() may be any Python callable, such as a remote service."""

    def __init__(self, embed, dims: int):
        self.embed, self.dims = embed, dims


def embed(docs: DataFrame, provider: Provider, id: str = "doc_id", text: str = "text", batch: int = 50) -> DataFrame:
    """(id, embedding) by a provider, in Arrow batches."""
    call = provider.embed

    def run(batches):
        for pdf in batches:
            vectors = []
            for i in range(0, len(pdf), batch):
                vectors += call(pdf[text].iloc[i : i + batch].tolist())
            yield pd.DataFrame({id: pdf[id], "embedding": vectors})

    return docs.select(id, text).mapInPandas(run, f"{id} {dict(docs.dtypes)[id]}, embedding array<float>")


def hash_embed(docs: DataFrame, id: str = "doc_id", text: str = "text", dims: int = 16) -> DataFrame:
    """A deterministic embedding of words by hashing, scaled to length 1; needs no service."""
    words = docs.select(id, F.explode(F.split(F.lower(text), r"\s+")).alias("w")).filter("w <> ''")
    h = F.xxhash64("w")
    cells = words.groupBy(id).agg(*[F.sum(F.when(F.pmod(h, F.lit(dims)) == i, F.when(F.pmod(F.shiftright(h, 32), F.lit(2)) == 0, 1.0).otherwise(-1.0)).otherwise(0.0)).alias(f"d{i}") for i in range(dims)])
    norm = F.sqrt(sum((F.col(f"d{i}") * F.col(f"d{i}") for i in range(dims)), F.lit(0.0)))
    return cells.select(id, F.array(*[F.when(norm > 0, F.col(f"d{i}") / norm).otherwise(0.0) for i in range(dims)]).alias("embedding"))
