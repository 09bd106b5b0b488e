r"""Packing into optimal length buckets.

The histogram of token counts over all documents has a row for each length that occurs. Dynamic
programming over it picks at most BUCKETS boundaries with the least padding of all choices: the
cost of a bucket is a line in its longest length, so that the lower envelope of the lines of one
layer gives the next layer in one pass, in whole numbers. Inside a bucket, batches of as many
documents as fit in the token budget at the bucket's length are formed. A bucket is dealt into
shards of bounded size by a hash of the id, their number taken from the histogram, so that no
bucket meets in one task; at most one batch of each shard is not full.

A token is a word here; pack() takes any counts, such as those of the token count operator.

Defined results: null and blank texts have no tokens and are in no bucket (all packing columns are
null); a text longer than the budget is a batch of its own; of boundaries with equal padding the
fewest, then those with the smallest lengths from the last on, are taken; inside a shard documents
stand in the order of id and length; rows with the same id, or none, take a slot each; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, load, materialize

BUCKETS, BUDGET, SHARD = 16, 65_536, 4_096


def histogram(rows: DataFrame) -> list[tuple[int, int]]:
    """(length, documents) of rows (n_tokens) by length; as many as there are different lengths."""
    return sorted(map(tuple, rows.filter("n_tokens > 0").groupBy("n_tokens").count().collect()))


def boundaries(lengths: list[tuple[int, int]], buckets: int = BUCKETS) -> tuple[list[int], int]:
    """Lengths of the buckets (each the longest document in it) and the padding they need."""
    if not lengths:
        return [], 0
    count, tokens = [0], [0]
    for length, n in lengths:
        count.append(count[-1] + n)
        tokens.append(tokens[-1] + n * length)
    m = len(lengths)
    # best[j]: least padding of the first j lengths in the buckets so far; a bucket of the lengths
    # i + 1 to j adds top * (count[j] - count[i]) - (tokens[j] - tokens[i])
    best: list[int | None] = [0] + [None] * m
    cuts: list[list[int]] = []
    found: list[int] = []
    for _ in range(min(buckets, m)):
        now: list[int | None] = [None] * (m + 1)
        cut = [0] * (m + 1)
        hull: list[tuple[int, int, int]] = []  # slope, height and i of the lines of the envelope
        at = 0
        for j in range(1, m + 1):
            if best[j - 1] is not None:
                slope, height = -count[j - 1], best[j - 1] + tokens[j - 1]
                while len(hull) > 1 and (height - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) < (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - slope):
                    hull.pop()
                hull.append((slope, height, j - 1))
            if not hull:
                continue
            top = lengths[j - 1][0]
            at = min(at, len(hull) - 1)
            while at + 1 < len(hull) and hull[at + 1][0] * top + hull[at + 1][1] < hull[at][0] * top + hull[at][1]:
                at += 1
            now[j] = hull[at][0] * top + hull[at][1] + top * count[j] - tokens[j]
            cut[j] = hull[at][2]
        best = now
        cuts.append(cut)
        found.append(now[m])
    used = found.index(min(found))
    out, j = [], m
    for q in range(used, -1, -1):
        out.append(lengths[j - 1][0])
        j = cuts[q][j]
    return out[::-1], found[used]


def shard_of(doc_id, shards):
    """A number below shards from a multiplicative hash of the id (0 for no id)."""
    return F.coalesce(F.pmod(F.pmod(F.pmod(doc_id, F.lit(2_147_483_647)) * 48_271, F.lit(2_147_483_647)), shards), F.lit(0)).cast("int")


def pack(rows: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """rows (doc_id, n_tokens) with bucket, bucket_len, shard, batch and slot."""
    rows = materialize(rows, "lengths")
    lengths = histogram(rows)
    tops, _ = boundaries(lengths, buckets)
    columns = ("bucket", "bucket_len", "shard", "batch", "slot")
    if not tops:
        return rows.select("doc_id", "n_tokens", *[F.lit(None).cast("int").alias(c) for c in columns])
    docs = [sum(n for x, n in lengths if (tops[i - 1] if i else 0) < x <= top) for i, top in enumerate(tops)]
    size = [max(1, budget // top) for top in tops]
    shards = [max(1, -(-n // max(SHARD, 4 * s))) for n, s in zip(docs, size)]
    bucket = F.lit(None).cast("int")
    for i in reversed(range(len(tops))):
        bucket = F.when(F.col("n_tokens") <= tops[i], i).otherwise(bucket)
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), F.col("__bucket") + 1)
    full = rows.filter("n_tokens > 0").withColumn("__bucket", bucket).withColumn("bucket_len", pick(tops)).withColumn("shard", shard_of(F.col("doc_id"), pick(shards)))
    place = F.row_number().over(Window.partitionBy("__bucket", "shard").orderBy("doc_id", "n_tokens")) - 1
    full = full.withColumn("place", place).withColumn("__size", pick(size)).withColumnRenamed("__bucket", "bucket")
    full = full.select("doc_id", "n_tokens", "bucket", F.col("bucket_len").cast("int").alias("bucket_len"), "shard", F.floor(F.col("place") / F.col("__size")).cast("int").alias("batch"), F.pmod("place", "__size").cast("int").alias("slot"))
    none = rows.filter("n_tokens = 0").select("doc_id", "n_tokens", *[F.lit(None).cast("int").alias(c) for c in columns])
    return full.unionByName(none)


def token_lengths(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"))


def op4(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return pack(token_lengths(docs))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4(spark, load(spark, sf_dir, "documents"))


#: DuckDB statement of the same result: the dynamic program layer by layer, then its way back.
ORACLE_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens FROM documents
), h AS (SELECT n_tokens AS x, count(*) AS n FROM d WHERE n_tokens > 0 GROUP BY 1),
g AS (
  SELECT row_number() OVER (ORDER BY x) AS j, x, sum(n) OVER (ORDER BY x)::BIGINT AS c, sum(n * x) OVER (ORDER BY x)::BIGINT AS t FROM h
  UNION ALL SELECT 0, 0, 0, 0
), layers AS (
  SELECT 0 AS q, 0::BIGINT AS j, 0::BIGINT AS pad, 0::BIGINT AS cut
  UNION ALL
  SELECT l.q + 1, g.j, min(l.pad + g.x * (g.c - p.c) - (g.t - p.t)), arg_min(l.j, (l.pad + g.x * (g.c - p.c) - (g.t - p.t), l.j))
  FROM layers l JOIN g p ON p.j = l.j JOIN g ON g.j > l.j WHERE l.q < {BUCKETS} GROUP BY l.q, g.j
), used AS (
  SELECT arg_min(q, (pad, q)) AS q FROM layers WHERE q > 0 AND j = (SELECT max(j) FROM g)
), back AS (
  SELECT q, (SELECT max(j) FROM g) AS j FROM used
  UNION ALL SELECT b.q - 1, l.cut FROM back b JOIN layers l ON l.q = b.q AND l.j = b.j WHERE b.q > 1
), tops AS (
  SELECT (b.q - 1)::INTEGER AS bucket, g.x AS bucket_len, greatest(1, {BUDGET} // g.x) AS size, coalesce(lag(g.x) OVER (ORDER BY b.q), 0) AS low, g.c - coalesce(lag(g.c) OVER (ORDER BY b.q), 0) AS docs
  FROM back b JOIN g ON g.j = b.j
), dealt AS (
  SELECT doc_id, n_tokens, bucket, bucket_len, size,
    coalesce(((doc_id % 2147483647 + 2147483647) % 2147483647 * 48271 % 2147483647) % greatest(1, ceil(docs / greatest({SHARD}, 4 * size))::BIGINT), 0)::INTEGER AS shard
  FROM d JOIN tops ON n_tokens > low AND n_tokens <= bucket_len
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY bucket, shard ORDER BY doc_id NULLS FIRST, n_tokens) - 1 AS place FROM dealt
)
SELECT doc_id, n_tokens, bucket, bucket_len::INTEGER AS bucket_len, shard, (place // size)::INTEGER AS batch, (place % size)::INTEGER AS slot FROM placed
UNION ALL SELECT doc_id, n_tokens, NULL, NULL, NULL, NULL, NULL FROM d WHERE n_tokens = 0
"""
