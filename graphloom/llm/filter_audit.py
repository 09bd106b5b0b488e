r"""Filter interaction audit: what five filters remove, in every order, together and alone.

A text fails filter A if it has under 100 words, B if distinct words are under 80 in 100, C if
capitals A-Z are over 10 in 100 code points, D if it holds a mark of `#$%&*|`, E if it equals the text of
a smaller doc_id, wherever that is and whatever became of it. The letters a row fails make a mask of five
bits, and all counts of all 120 orders follow from the number of rows with each mask.

One pass over the texts finds the bits A to D and the hash of each text. Rows then move once, in an RDD
dealt by that hash (xxhash, 64 bits). A task first keeps, of each stretch of STRETCH bytes, one row
for each different text: that with the smallest id, with its text. All others are settled, and go
as a few numbers, dealt by their own ids; a text that makes up a third of all rows thus meets in its
task once for each stretch only. There, texts of one hash form a chain of (full text, minimum id);
what is not the minimum of its text fails E. The masks meet the labels by doc_id, and combineByKey
merges vectors of counts by mask.

Defined results: null texts are empty ones (and equal to each other); a row whose doc_id is null
or that has the same id as an equal text is no copy of a smaller id; a null lang is the part '';
labels on several rows of one id count once, good or toxic if any row is; a row without labels is
neither; an empty table gives no rows; extra columns are ignored; texts are read and compared whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_ready, load, materialize

FILTERS = "ABCDE"
#: Bytes of different texts that a task holds before it passes them on.
STRETCH = 8_000_000
#: Bytes of text for each task after the shuffle.
TASK_BYTES = 24_000_000

_NOT_UPPER = bytes(x for x in range(256) if not 65 <= x <= 90)
_MARKS = b"#$%&*|"
_COPY = 1 << FILTERS.index("E")


def mask_of(text: bytes, points: int) -> int:
    """The bits of the filters A to D that a text (UTF-8, of so many code points) fails."""
    words = text.split()
    n, capitals = len(words), len(text.translate(None, _NOT_UPPER))
    return (n < 100) | (100 * len(set(words)) < 80 * n) << 1 | (100 * capitals > 10 * points) << 2 | any(m in text for m in _MARKS) << 3


def _own(doc_id: int) -> int:
    return xxhash.xxh64_intdigest(str(doc_id))


#: What moves: (key, (doc_id, {part: rows}, mask, text)); without a text it is settled.
Row = tuple[int, tuple[int | None, dict[str, int], int, bytes | None]]


def _first_of_each(rows: Iterable[tuple[int, int | None, dict[str, int], int, bytes]]) -> Iterator[tuple[int, int | None, dict[str, int], int, bytes | None]]:
    """Chains of (full text, minimum id) by hash: each text's minimum comes out last and with its
    text, what is not the minimum before, with the bit E and without. None is handed through."""
    chains: dict[int, list[list]] = {}
    for row in rows:
        if row is None:
            yield None
            continue
        h, doc_id, parts, mask, text = row
        chain = chains.setdefault(h, [])
        for link in chain:
            if link[3] == text:
                if doc_id == link[0]:
                    for p, n in parts.items():
                        link[1][p] = link[1].get(p, 0) + n
                else:
                    if doc_id < link[0]:
                        link[0], doc_id, link[1], parts = doc_id, link[0], parts, link[1]
                    yield h, doc_id, parts, mask | _COPY, None
                break
        else:
            chain.append([doc_id, dict(parts), mask, text])
    for h, chain in chains.items():
        for link in chain:
            yield h, *link


def _route(rows: Iterable) -> Iterator[Row]:
    """Rows (doc_id, part, points, text) with their masks and the keys they are dealt by."""

    def stretches() -> Iterator[list]:
        held, size = [], 0
        for r in rows:
            text = bytes(r["text"])
            held.append((xxhash.xxh64_intdigest(text), r["doc_id"], {r["part"]: 1}, mask_of(text, r["points"]), text))
            size += len(text)
            if size >= STRETCH:
                yield held
                held, size = [], 0
        yield held

    without: dict[int, dict[str, int]] = {}  # rows without an id, no copies of anything, by mask
    for stretch in stretches():
        known = []
        for row in stretch:
            if row[1] is None:
                parts = without.setdefault(row[3], {})
                for p, n in row[2].items():
                    parts[p] = parts.get(p, 0) + n
            else:
                known.append(row)
        for h, doc_id, parts, mask, text in _first_of_each(known):
            yield (_own(doc_id) if text is None else h), (doc_id, parts, mask, text)
    for mask, parts in without.items():
        yield mask, (None, parts, mask, None)


def _settle(rows: Iterable[Row]) -> Iterator[tuple[int | None, str, int, int]]:
    """(doc_id, part, mask, rows), all masks whole."""
    settled: list[tuple] = []

    def with_text() -> Iterator[tuple]:
        for key, (doc_id, parts, mask, text) in rows:
            if text is None:
                settled.append((doc_id, parts, mask))
            else:
                yield key, doc_id, parts, mask, text
            if len(settled) >= 10_000:  # pass them on, in the place of a row with a text
                yield None

    def flat(some: list[tuple]) -> Iterator[tuple]:
        for doc_id, parts, mask in some:
            for part, n in parts.items():
                yield doc_id, part, mask, n
        some.clear()

    for x in _first_of_each(with_text()):
        if x is not None:
            settled.append(x[1:4])
        if len(settled) >= 10_000:
            yield from flat(settled)
    yield from flat(settled)


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, n): the mask of each row of docs (doc_id, text, lang); n equal rows of one
    id and text are one row."""
    spark = docs.sparkSession
    arrow_ready(spark)
    text = F.coalesce("text", F.lit(""))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    rows: RDD = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.char_length(text).alias("points"), text.cast("binary").alias("text")).rdd
    settled = rows.mapPartitions(_route).partitionBy(tasks, lambda key: key).mapPartitions(_settle)
    return spark.createDataFrame(settled, "doc_id long, part string, mask int, n long", verifySchema=False)


def vectors(found: DataFrame, labels: DataFrame) -> RDD:
    """(part, counts): rows, good rows and toxic rows by mask (3 x 32), merged by part."""
    good, toxic = (F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(c) for c in ("quality", "toxic"))
    marked = found.join(labels.filter("doc_id is not null").groupBy("doc_id").agg(good, toxic), "doc_id", "left").select("part", "mask", "n", F.coalesce("quality", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))

    def add(v: np.ndarray, row: tuple[int, int, int, int]) -> np.ndarray:
        mask, n, good, toxic = row
        v[:, mask] += (n, n * good, n * toxic)
        return v

    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a += b
        return a

    pairs = marked.rdd.map(lambda r: (r["part"], (r["mask"], r["n"], r["good"], r["toxic"])))
    return pairs.combineByKey(lambda row: add(np.zeros((3, 1 << len(FILTERS)), np.int64), row), add, merge)


def report(part: str, counts: np.ndarray) -> Iterator[tuple]:
    """The rows of all orders of the filters, for the counts of a part."""
    n, good, toxic = counts
    every = np.arange(1 << len(FILTERS))
    failed = [(every >> f & 1).astype(bool) for f in range(len(FILTERS))]
    orders = list(permutations(range(len(FILTERS))))
    # of the orders of the filters that a mask fails, each is first in an equal share
    share = np.array([0] + [len(orders) // bin(m).count("1") for m in every[1:].tolist()])
    shapley = [int((n * share)[x].sum()) for x in failed]
    alone = [int(n[1 << f]) for f in range(len(FILTERS))]
    for order in orders:
        left = np.ones(len(every), bool)
        for step, f in enumerate(order, 1):
            removed = left & failed[f]
            left = left & ~failed[f]
            yield (part, "".join(FILTERS[x] for x in order), step, int(n[left].sum()), int(n[removed].sum()), int(n[failed[f]].sum() - n[removed].sum()), alone[f], int(good[removed].sum()), int(toxic[removed].sum()), shapley[f])


SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def op12(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = materialize(masks(docs), "masks")
    return spark.createDataFrame(vectors(found, labels).flatMap(lambda kv: report(*kv)), SCHEMA, verifySchema=False)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12(spark, load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


_FAILS = """CASE f WHEN 'A' THEN n < 100 WHEN 'B' THEN 100 * n_distinct < 80 * n WHEN 'C' THEN 100 * capitals > 10 * points WHEN 'D' THEN marks WHEN 'E' THEN doc_id > first END"""
ORACLE_SQL = f"""WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
x AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM w),
y AS (SELECT doc_id, part, first, len(words) AS n, len(list_distinct(words)) AS n_distinct, len(regexp_extract_all(t, '[A-Z]')) AS capitals, length(t) AS points, regexp_matches(t, '[#$%&*|]') AS marks FROM x),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
m AS (SELECT part, doc_id, string_agg(f, '' ORDER BY f) FILTER ({_FAILS}) AS mask FROM y, f GROUP BY 1, 2),
c AS (SELECT part, coalesce(mask, '') AS mask, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic FROM m LEFT JOIN labels USING (doc_id) GROUP BY 1, 2),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS f, filter_order[:step - 1] AS before FROM o, range(1, 6) t(step)),
z AS (SELECT part, filter_order, step, n, good, toxic, f, contains(mask, f) AS fails, mask = f AS alone, before <> '' AND regexp_matches(mask, '[' || before || '.]') AS gone FROM s, c),
r AS (SELECT part, filter_order, step, any_value(f) AS f, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost FROM z GROUP BY 1, 2, 3)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r"""
