r"""Importance resampling towards a target distribution, from hashed n-gram features.

Every text's features are its runs of LOW to HIGH consecutive words, joined by a space, repeats counted;
a feature's bucket is the CRC-32 of its UTF-8 bytes modulo BUCKETS. A bucket's gain is the scaled
logarithm of the ratio of its smoothed shares in target and raw texts; a text's weight is the mean of the
gains of its features; adding Gumbel noise drawn from the id and taking the highest scores samples without
replacement in proportion to exp(weight).

Features are told apart by a word-id suffix array of each part of a partition (BLOCK words, cut
between texts, so that memory stays bounded): the words of the part get ids, their suffixes are
sorted by the first HIGH words (by doubling, as deeper order does not matter), and the lengths of the common
prefixes of neighbours split the array into runs of equal n-grams. Each run is hashed once, by going on from
the CRC of its prefix that is one word shorter, and its bucket is scattered back to all places of
the run. Buckets are written once, and gains (BUCKETS numbers, whatever the input) come back to them.

Defined results: null, empty and wordless texts have no features, weight 0 and are never drawn; equal
scores go to the smaller doc_id, a null doc_id last (its noise is that of the text `null`); repeated rows
each get a rank; without target texts all target counts are 0; empty tables give no rows; extra
columns are ignored; texts are read whole, however long, and a text of more than BLOCK words is
a part of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_ready, load, materialize

LOW = HIGH = 1
BUCKETS = 10_000
#: Words of a text that can be drawn, percent of such texts that are, and the name of the noise.
LEAST_WORDS, PERCENT, SEED = 20, 10, 2024
#: Words of one suffix array.
BLOCK = 400_000
#: Letters, digits, and all characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words with A-Z in lower case. lower() does just that, and faster, where all is ASCII."""
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.regexp_extract_all(F.coalesce(low, F.lit("")), F.lit(WORD), F.lit(0))


# ---- suffix arrays --------------------------------------------------------------------------


def suffix_array(ids: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of a sequence of word ids, sorted by their next `depth` words within the text, and
    how many of these each shares with the place before it in that order. left: words left in the text.
    """
    n = len(ids)
    rank, size = ids.astype(np.int64) + 1, 1
    order = np.argsort(rank, kind="stable")
    while size < depth:  # ranks of `size` words make those of twice as many
        after = np.zeros(n, np.int64)
        go_on = np.flatnonzero(left > size)
        after[go_on] = rank[go_on + size]
        key = rank * (after.max() + 1) + after
        order = np.argsort(key, kind="stable")
        found = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], (found[1:] != found[:-1]).astype(np.int64)]))
        size *= 2
    common = np.zeros(n, np.int64)
    alike = np.arange(1, n)
    for k in range(depth):
        a, b = order[alike - 1], order[alike]
        both = (left[a] > k) & (left[b] > k)
        alike, a, b = alike[both], a[both], b[both]
        alike = alike[ids[a + k] == ids[b + k]]
        common[alike] = k + 1
    return order, common


def buckets_of(words: pa.Array, bounds: np.ndarray, low: int = LOW, high: int = HIGH, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and place of each feature of consecutive texts; text i has the words from bounds[i] on."""
    coded = words.dictionary_encode()
    ids, names = coded.indices.to_numpy(zero_copy_only=False), [w.encode("utf-8", "surrogatepass") for w in coded.dictionary.to_pylist()]
    n = len(ids)
    sizes = np.diff(bounds)
    left = np.repeat(bounds[1:], sizes) - np.arange(n)
    order, common = suffix_array(ids, left, high)
    run_crc: np.ndarray | None = None
    out, places = [], []
    for size in range(1, high + 1):
        first = common < size  # a run of equal n-grams begins
        run = np.cumsum(first) - 1
        heads = order[np.flatnonzero(first)]
        whole = left[heads] >= size
        crc = np.zeros(len(heads), np.int64)
        if size == 1:
            crc[:] = [zlib.crc32(names[i]) for i in ids[heads].tolist()]
        else:
            shorter = run_crc[heads]
            at = np.flatnonzero(whole)
            crc[at] = [zlib.crc32(names[i], zlib.crc32(b" ", c)) for i, c in zip(ids[heads[at] + size - 1].tolist(), shorter[at].tolist())]
        run_crc = np.empty(n, np.int64)
        run_crc[order] = crc[run]
        if size >= low:
            full = np.flatnonzero(left >= size)
            out.append(run_crc[full] % buckets)
            places.append(full)
    return np.concatenate(out), np.concatenate(places)


def features(docs: DataFrame, keep: list[str], low: int = LOW, high: int = HIGH, buckets: int = BUCKETS) -> DataFrame:
    """(*keep, n_words, buckets): the bucket of each feature of docs (*keep, text)."""
    spark = docs.sparkSession
    arrow_ready(spark)
    rows = docs.select(*keep, words(F.col("text")).alias("__w"))
    schema = rows.drop("__w").schema.add("n_words", T.IntegerType()).add("buckets", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("__w"))
            ends = lists.offsets.to_numpy()
            ends = ends - ends[0]
            flat, done = lists.flatten(), 0
            while done < batch.num_rows:  # parts of BLOCK words, or of one text
                to = max(done + 1, int(np.searchsorted(ends, ends[done] + BLOCK, "right")) - 1)
                bounds = ends[done : to + 1] - ends[done]
                got, places = buckets_of(flat.slice(ends[done], bounds[-1]), bounds, low, high, buckets)
                text = np.searchsorted(bounds, places, "right") - 1
                got = got[np.argsort(text, kind="stable")] if high > low else got
                at = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=to - done))]).astype(np.int32)
                part = batch.slice(done, to - done)
                columns = [part.column(i) for i in range(len(keep))] + [pa.array(np.diff(bounds), pa.int32()), pa.ListArray.from_arrays(pa.array(at), pa.array(got, pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_words", "buckets"])
                done = to

    return rows.mapInArrow(run, schema)


# ---- scores ---------------------------------------------------------------------------------


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of all buckets, from the features of raw and of target texts."""
    spark = raw.sparkSession
    each = [d.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias(n)) for d, n in ((raw, "s"), (target, "t"))]
    b = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(each[0], "bucket", "left").join(each[1], "bucket", "left").fillna(0)
    counts = b.collect()
    s_all, t_all = (float(sum(r[c] for r in counts)) for c in ("s", "t"))
    rows = spark.createDataFrame([(r["bucket"], float(r["s"]), float(r["t"])) for r in counts], "bucket int, s double, t double")
    ratio = ((F.col("t") + 1.0) * F.lit(s_all + buckets)) / ((F.col("s") + 1.0) * F.lit(t_all + buckets))
    return rows.select("bucket", F.floor(1000.0 * F.log(ratio)).cast("long").alias("gain"))


def weights(rows: DataFrame, gain: DataFrame) -> DataFrame:
    """rows (from features()) with n_features and weight in the place of buckets. gain has one row for
    each bucket, so that the tasks can hold it as an array."""
    by_bucket = np.array([r["gain"] for r in gain.orderBy("bucket").collect()], np.int64)
    schema = rows.drop("buckets").schema.add("n_features", T.LongType()).add("weight", T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("buckets")
            lists = batch.column(at)
            ends = lists.offsets.to_numpy()
            sums = np.concatenate([[0], np.cumsum(by_bucket[lists.flatten().to_numpy()])])[ends - ends[0]]
            n = np.diff(ends).astype(np.int64)
            weight = np.diff(sums) // np.maximum(n, 1)
            kept = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n), pa.array(weight)], names=schema.names)

    return rows.mapInArrow(run, schema)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Scaled standard Gumbel noise, from the first 32 bits of a digest of the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(scored: DataFrame, order: list[Column], draw: int) -> DataFrame:
    """scored in an order, with rank 1, 2, ... and only the first `draw` rows.

    Rows are sorted by ranges; the sizes of the ranges, one number for each task, give the rank at
    which each begins.
    """
    spark = scored.sparkSession
    sorted_ = materialize(scored.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part, row = F.shiftrightunsigned("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes, before = sorted(sorted_.groupBy(part.alias("p")).count().collect()), 0
    starts = []
    for p, n in sizes:
        starts.append((p, before))
        before += n
    starts = spark.createDataFrame(starts, "__p long, __before long")
    return sorted_.withColumn("__p", part).join(F.broadcast(starts), "__p").withColumn("rank", F.col("__before") + row + 1).filter(F.col("rank") <= draw).drop("__at", "__p", "__before")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, low: int = LOW, high: int = HIGH, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of docs (doc_id, text); target: (text)."""
    raw = materialize(features(docs.select("doc_id", "text"), ["doc_id"], low, high, buckets), "features")
    gain = gains(raw, features(target.select("text"), [], low, high, buckets), buckets)
    rows = weights(raw, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    rows = materialize(rows.withColumn("__key", F.monotonically_increasing_id()), "scores")
    enough = rows.filter(F.col("n_words") >= LEAST_WORDS)
    drawn = ranked(enough.select("__key", "score", "doc_id"), [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("__key")], percent * enough.count() // 100)
    return rows.join(drawn.select("__key", "rank"), "__key", "left").drop("__key")


def op11(spark: SparkSession, docs: DataFrame, target: DataFrame) -> DataFrame:
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11(spark, load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: CRC-32 of each distinct word from a table that its polynomial gives, byte by byte.
ORACLE_SQL = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT {_WORDS} AS w FROM benchmark),
crc AS (SELECT list(list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda a, i: xor(a >> 1, 3988292384 * (a & 1)), n::BIGINT) ORDER BY n) AS crc FROM range(256) t(n)),
one AS (SELECT DISTINCT unnest(w) AS word FROM (SELECT w FROM d UNION ALL SELECT w FROM b)),
x AS (SELECT word, xor(list_reduce(list_transform(range(1, length(hex(word)) // 2 + 1), lambda i: ('0x' || substr(hex(word), (2 * i - 1)::INT, 2))::BIGINT), lambda c, y: xor(c >> 8, crc[(xor(c, y) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % {BUCKETS} AS bucket FROM one, crc),
f AS (SELECT doc_id, bucket FROM (SELECT doc_id, unnest(w) AS word FROM d) JOIN x USING (word)),
g AS (SELECT bucket, count(*) AS t FROM (SELECT unnest(w) AS word FROM b) JOIN x USING (word) GROUP BY 1), r AS (SELECT bucket, count(*) AS s FROM f GROUP BY 1),
n AS (SELECT (SELECT coalesce(sum(s), 0) FROM r)::DOUBLE AS s_all, (SELECT coalesce(sum(t), 0) FROM g)::DOUBLE AS t_all),
gain AS (SELECT bucket, floor(1000.0::DOUBLE * ln((coalesce(t, 0) + 1.0::DOUBLE) * (s_all + {BUCKETS}.0::DOUBLE) / ((s + 1.0::DOUBLE) * (t_all + {BUCKETS}.0::DOUBLE)))) AS gain FROM r LEFT JOIN g USING (bucket), n),
v AS (SELECT doc_id, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight FROM f JOIN gain USING (bucket) GROUP BY 1),
h AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000.0::DOUBLE * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::UBIGINT::DOUBLE + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN v USING (doc_id)),
k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM h WHERE n_words >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, rank FROM h LEFT JOIN (SELECT doc_id, rank FROM k WHERE rank <= {PERCENT} * n // 100) USING (doc_id)"""
