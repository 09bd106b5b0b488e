r"""Embedding near-duplicates by an exact metric range join.

Vectors are scaled to length 1; cosine >= t is then a distance of at most r = sqrt(2 - 2 t). Pivots
split a cell's vectors by the nearest pivot. A vector also goes, as a guest, to every other cell
whose border may lie within r of it: by the triangle inequality a vector at distances d1 of its own
and d2 of another pivot is at least (d2^2 - d1^2) / (2 |p2 - p1|) from the border. Each cell then
holds all partners of its own vectors and is joined without the others, in blocks of at most BLOCK
by BLOCK vectors, as matrix products; a cell emits counts and a spanning forest, never its pairs.

Cells with more than CELL vectors of their own are split again, level by level, each by at most
PIVOTS pivots, drawn by hash and spread out, as long as the split leaves less than GAIN of the
products of own and all vectors: where the vectors of a label lie so close (or in so many
dimensions) that borders are near everywhere, copying them to more cells would only add work, and
the cell is joined as it is, in blocks. Vectors meet their pivots in groups of at most BLOCK, so that
no table of pivots is sent to all and no label meets in one task.

Equal vectors are joined once and counted by their number. Cosines are worked out in double
precision; those within 1e-12 of the threshold again with exact sums.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and
those with a null label, link with nothing; different lengths never link; rows with the same vec_id
are vectors of their own in n_links and share a component; rows without a vec_id link with nothing;
labels may be of any type; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_ready, hot_join, load, materialize, scope
from .components import components

THRESHOLD = 0.98
CELL, PIVOTS, BLOCK = 2_000, 16, 2_048
#: Vectors that the pivots of a cell are chosen from, share of the work that a split must leave at
#: most, and levels (each level leaves at most GAIN of the work of a cell that it splits).
DRAWN, GAIN, LEVELS = 64, 0.8, 40


def pairs_within(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean matrix of cosine(x[i], y[j]) >= threshold."""
    nx, ny = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
    cos = (x @ y.T) / (nx[:, None] * ny[None, :])
    out = cos >= threshold
    for i, j in zip(*np.nonzero(np.abs(cos - threshold) < 1e-12)):
        a, b = x[i].tolist(), y[j].tolist()
        exact = math.fsum(p * q for p, q in zip(a, b)) / math.sqrt(math.fsum(p * p for p in a) * math.fsum(q * q for q in b))
        out[i, j] = exact >= threshold
    return out


def _pivots(pdf: pd.DataFrame) -> pd.DataFrame:
    """The pivots of one cell from its drawn vectors: each the furthest from those before."""
    x = np.stack(pdf.sort_values("rep")["v"].to_numpy())
    x = x / np.linalg.norm(x, axis=1)[:, None]
    want = int(min(PIVOTS, max(2, -(-int(pdf["mine"].iloc[0]) // CELL))))
    chosen, far = [0], 2 - 2 * x @ x[0]
    while len(chosen) < want and far.max() > 1e-9:
        k = int(far.argmax())
        chosen.append(k)
        far = np.minimum(far, 2 - 2 * x @ x[k])
    return pd.DataFrame({"cell": pdf["cell"].iloc[0], "pivots": [x[chosen].ravel().tolist()]})


def _placed(threshold: float):
    """Vectors of a group and its one row of pivots -> the vectors with the number of each part."""
    radius = math.sqrt(2 - 2 * threshold) * (1 + 1e-9) + 1e-9

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({c: [] for c in ("rep", "v", "n", "cell", "part", "own")})
        x = np.stack(left["v"].to_numpy())
        x = x / np.linalg.norm(x, axis=1)[:, None]
        p = np.array(right["pivots"].iloc[0]).reshape(-1, x.shape[1])
        d2 = np.maximum(2 - 2 * x @ p.T, 0)
        near = d2.argmin(1)
        gap = np.sqrt(np.maximum(((p[near][:, None, :] - p[None]) ** 2).sum(2), 1e-300))
        reach = (d2 - d2[np.arange(len(x)), near][:, None]) / (2 * gap) <= radius
        reach[np.arange(len(x)), near] = True
        i, c = np.nonzero(reach)
        return left.iloc[i].assign(part=c.astype(np.int32), own=left["own"].to_numpy()[i] & (c == near[i]))[["rep", "v", "n", "cell", "part", "own"]]

    return run


def assign(vectors: DataFrame, threshold: float, cell: int | None = None) -> DataFrame:
    """(rep, v, n, cell, own) of vectors (cell, rep, v, n): each once in the cell that is its own,
    and as a guest in others; cells of the input are never mixed."""
    limit = CELL if cell is None else cell
    cols = ["rep", "v", "n", "cell", "own"]
    todo, done = vectors.withColumn("own", F.lit(True)), None
    for _ in range(LEVELS):
        sizes = todo.groupBy("cell").agg(F.count("*").alias("every"), F.sum(F.col("own").cast("long")).alias("mine"))
        sizes = materialize(sizes.withColumn("groups", F.ceil(F.col("every") / BLOCK).cast("int")), "sizes")
        big = sizes.filter(F.col("mine") > limit)
        if big.isEmpty():
            break
        rows = todo.count()
        todo = materialize(_with(todo, sizes, "every", rows), "sized")
        inside = todo.filter(F.col("mine") > limit)
        drawn = inside.filter("own").withColumn("k", F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("rep", "cell"), "rep"))).filter(F.col("k") <= DRAWN)
        pivots = drawn.select("cell", "rep", "v", "mine").groupBy("cell").applyInPandas(_pivots, "cell string, pivots array<double>")
        pivots = materialize(pivots, "pivots").join(big, "cell").select("cell", "pivots", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"))
        # the vectors of large cells in groups of about BLOCK, each with the pivots of its cell
        left = inside.withColumn("group", F.pmod(F.xxhash64("rep"), F.col("groups")).cast("int")).select(*cols, "group")
        split = left.groupBy("cell", "group").cogroup(pivots.groupBy("cell", "group")).applyInPandas(_placed(threshold), "rep long, v array<double>, n long, cell string, part int, own boolean")
        split = materialize(split, "split")
        work = split.groupBy("cell", "part").agg(F.count("*").alias("every"), F.sum(F.col("own").cast("long")).alias("mine"))
        work = work.groupBy("cell").agg(F.sum(F.col("every").cast("double") * F.col("mine")).alias("after"), F.max("mine").alias("most"), F.sum("every").alias("now"))
        good = (F.col("after") <= GAIN * F.col("every") * F.col("mine")) & (F.col("most") < F.col("mine"))
        worth = materialize(big.join(work, "cell").select("cell", good.alias("good"), "every", "now"), "worth")
        stay = _with(inside.select(*cols), worth, "every", rows).filter("not good")
        rest = todo.filter(F.col("mine") <= limit).select(*cols).unionByName(stay.select(*cols))
        done = rest if done is None else done.unionByName(rest)
        todo = _with(split, worth, "now", split.count()).filter("good")
        todo = materialize(todo.select("rep", "v", "n", F.concat_ws("/", "cell", "part").alias("cell"), "own"), "todo")
    rest = todo.select(*cols)
    return rest if done is None else done.unionByName(rest)


def _with(rows: DataFrame, cells: DataFrame, count: str, n: int) -> DataFrame:
    """rows with the columns of their cell; cells has one row for each, with its number of rows."""
    return hot_join(rows.withColumnRenamed("n", "copies"), cells.withColumn("n", F.col(count)), ["cell"], "rep", n, "inner").withColumnRenamed("copies", "n")


def join_cells(placed: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(rep, links) counts and (a, b) edges whose components are those of all links, of a
    materialised table of assign()."""
    cells = placed.groupBy("cell").agg(F.count("*").alias("all"), F.sum(F.col("own").cast("long")).alias("mine")).filter("mine > 0")
    rows = _with(placed, materialize(cells, "cells"), "all", placed.count())
    across, down = F.ceil(F.col("mine") / BLOCK).cast("int"), F.ceil(F.col("all") / BLOCK).cast("int")
    own = rows.filter("own").withColumn("i", F.pmod(F.xxhash64("rep"), across).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), down - 1))).withColumn("side", F.lit(True))
    every = rows.withColumn("j", F.pmod(F.xxhash64("rep"), down).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), across - 1))).withColumn("side", F.lit(False))
    cols = ["cell", "i", "j", "side", "rep", "v", "n"]
    both = own.select(*cols).unionByName(every.select(*cols))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["side"]], pdf[~pdf["side"]]
        if not len(a) or not len(b):
            return pd.DataFrame({"a": [], "b": [], "links": []})
        x, y = np.stack(a["v"].to_numpy()), np.stack(b["v"].to_numpy())
        ra, rb, nb = a["rep"].to_numpy(), b["rep"].to_numpy(), b["n"].to_numpy()
        got, parent = [], {}

        def find(k):
            while parent.setdefault(k, k) != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        for at in range(0, len(x), 512):
            near = pairs_within(x[at : at + 512], y, threshold)
            near &= ra[at : at + 512, None] != rb[None, :]
            count = near @ nb
            for i in np.flatnonzero(count):
                u = int(ra[at + i])
                got.append((u, u, int(count[i])))
                for w in rb[near[i]].tolist():
                    f, g = find(u), find(w)
                    if f != g:
                        parent[max(f, g)] = min(f, g)
        got += [(k, find(k), 0) for k in list(parent) if find(k) != k]
        return pd.DataFrame(got, columns=["a", "b", "links"])

    found = materialize(both.groupBy("cell", "i", "j").applyInPandas(run, "a long, b long, links long"), "joined")
    return found.filter("links > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links")), found.filter("a <> b").select("a", "b")


def link(table: DataFrame, threshold: float = THRESHOLD, cell: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of table (vec_id, embedding, label)."""
    arrow_ready(table.sparkSession)
    with scope() as keep:
        # a label's text tells it from others of its type; a label is never part of a path of cells
        rows = table.select("vec_id", F.col("label").cast("string").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
        whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
        # -0.0 is 0.0
        rows = rows.withColumn("v", F.transform("v", lambda x: x + 0.0))
        rows = rows.withColumn("ok", F.coalesce(whole & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False)))
        good = rows.filter("ok")
        print_of = F.sha2(F.to_json(F.struct("label", F.col("v"))), 256)
        good = materialize(good.select("vec_id", F.col("label"), "v", print_of.alias("print")), "good")
        total = good.count()
        same = good.groupBy("print").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("v").alias("v"))
        # a name of its own for each distinct vector, as an id may stand on several
        same = materialize(same.withColumn("rep", F.monotonically_increasing_id()), "vectors")
        # so that squares neither vanish nor overflow, each vector is first divided by its largest part
        scaled = same.withColumn("m", F.array_max(F.transform("v", lambda x: F.abs(x)))).withColumn("v", F.expr("transform(v, x -> x / m)"))
        scaled = scaled.select(F.concat_ws(":", F.sha2("label", 256), F.size("v")).alias("cell"), "rep", "v", "n")
        counts, edges = join_cells(materialize(assign(scaled, threshold, cell), "placed"), threshold)
        ids = materialize(hot_join(good.select("vec_id", "print"), same.select("print", "rep", "low", "n", F.col("n").alias("all")), ["print"], "vec_id", total, "inner"), "ids")
        # rows of one id are in one component
        shared = ids.groupBy("vec_id").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).filter("x < y")
        twice = ids.join(shared, "vec_id").select(F.col("x").alias("a"), F.col("rep").alias("b")).filter("a <> b")
        comp = components(edges.unionByName(twice), "a", "b")
        named = same.select("rep", "low").join(comp.select(F.col("node").alias("rep"), F.col("component").alias("c")), "rep", "left").withColumn("c", F.coalesce("c", "rep"))
        named = materialize(named, "named")
        lows = materialize(named.groupBy("c").agg(F.min("low").alias("component_id"), F.count("*").alias("n")), "lows")
        named = hot_join(named.select("rep", "c"), lows, ["c"], "rep", total, "inner").join(counts, "rep", "left")
        named = named.select("rep", "component_id", F.coalesce("links", F.lit(0)).alias("links")).join(same.select("rep", "n"), "rep")
        done = hot_join(ids.select("vec_id", "rep", "all"), named, ["rep"], "vec_id", total, "inner")
        done = done.select("vec_id", (F.col("all") - 1 + F.col("links")).alias("n_links"), "component_id")
        rest = rows.filter("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        return keep(materialize(done.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))), "linked"))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(load(spark, sf_dir, "embeddings"))


#: DuckDB statement of the same result for tables without zero or broken vectors.
ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT vec_id AS id, vec_id AS low FROM v
  UNION
  SELECT p.a, r.low FROM reach r JOIN pairs p ON p.b = r.id WHERE r.low < p.a
), low AS (SELECT id, min(low) AS component_id FROM reach GROUP BY id),
n AS (SELECT a, count(*) AS n_links FROM pairs GROUP BY a)
SELECT v.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, low.component_id, v.vec_id = low.component_id AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id JOIN low ON low.id = v.vec_id
"""
