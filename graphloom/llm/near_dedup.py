r"""Near-duplicate classes by Order MinHash.

Texts with the same words (told by SHA-256) are one text from the start. Each distinct text gives
keys; a key hashes the WIDTH smallest of its occurrence-labelled 5-word shingles (under that
sketch's own order), taken in the order in which they stand in the text, so that it is sensitive to
the edit similarity. Texts that share a key are candidates, and a candidate pair is a link when

* the 5-word shingles, counted with repetition, have a Jaccard similarity of 0.8 or more, and
* a banded alignment of the words (band and edit bound grow together) needs at most 0.2 edits
  for each word of the longer text.

A bucket is never expanded into all its pairs: its members are held against a leader; what stays
in other classes is then held against one more member, drawn by hash and so another one in each of
the many buckets that a large family shares. What is still in several classes
is compared across classes: in small buckets (up to SMALL texts) directly, in larger ones through an
index of each text's rarest shingles, which loses no pair: two texts of similarity 0.8 share one of
the n - ceil(0.8 n) + 1 rarest of their n shingles. Classes are the connected components of the
links. Texts of up to SHORT shingles have SHORT_SKETCHES keys of SHORT_WIDTH minima, those of more
than LONG shingles have SKETCHES keys of WIDTH; two texts of similarity 0.8 always have a kind of key
in common. Such a pair shares no key with a probability below 1e-6 in the first kind (0.4 ** 16 for 4
of 5 shingles), and between 3e-6 (long texts) and 2e-5 (LONG shingles) in the second.

Defined results: null and blank texts are each a class of their own; texts under five words are
only grouped when equal; every row is a document of its own, whether its id is null, stands on
other rows with other texts, or the whole row is repeated; class_id is the smallest id of the class
(null if no row of it has one); extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import among, arrow_ready, drop, hash_words, hot_at, hot_join, in_chunks, keyed, load, materialize, mix64, narrow, ngram_hashes, scope, utf8, words_of
from .components import components, near_labels

SHINGLE, SIMILARITY = 5, 0.8
SKETCHES, WIDTH = 24, 4
#: Keys of short texts (up to SHORT shingles); those of more than LONG shingles have the others.
SHORT_SKETCHES, SHORT_WIDTH, SHORT, LONG = 16, 2, 40, 26
SMALL = 24
#: Rows, and pairs to align, for one task.
ROWS, PAIRS = 100_000, 1_000
#: Texts of one shingle that are held against as many others in one task.
BLOCK = 1_024
#: Counters (a power of two) of the frequencies that order the shingles.
COUNTERS = 1 << 20
_RNG = np.random.Generator(np.random.PCG64(5))
_XOR = _RNG.integers(0, 2**64, SKETCHES, np.uint64)[:, None]
_MUL = (_RNG.integers(0, 2**64, SKETCHES, np.uint64) | np.uint64(1))[:, None]


def labelled(g: np.ndarray) -> np.ndarray:
    """Distinct values for repeated shingles: each carries the number of its occurrence."""
    order = np.argsort(g, kind="stable")
    s = g[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    if new.all():
        return g
    at = np.arange(len(s))
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    out = np.empty_like(g)
    out[order] = np.where(nth == 0, s, mix64(s + nth.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)))
    return out


def order_minhash(g: np.ndarray) -> np.ndarray:
    """The keys of one text from its occurrence-labelled shingles, in text order."""
    out = [np.empty(0, np.uint64)]
    if 0 < len(g) <= SHORT:
        out.append(_keys(g, SHORT_SKETCHES, SHORT_WIDTH))
    if len(g) > LONG:
        out.append(_keys(g, SKETCHES, WIDTH))
    return np.concatenate(out)


def _keys(g: np.ndarray, n: int, width: int) -> np.ndarray:
    k = min(width, len(g))
    if len(g) == k:
        at = np.tile(np.arange(k), (n, 1))
    elif len(g) <= 40_000:
        at = np.sort(np.argpartition((g[None, :] ^ _XOR[:n]) * _MUL[:n], k - 1, axis=1)[:, :k], axis=1)
    else:
        at = np.stack([np.sort(np.argpartition((g ^ _XOR[i]) * _MUL[i], k - 1)[:k]) for i in range(n)])
    key = np.arange(1, n + 1).astype(np.uint64) + np.uint64(1000 * width)
    for j in range(k):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + g[at[:, j]])
    return key


def sketches(docs: DataFrame) -> DataFrame:
    """__key, f1 and f2 (halves of a SHA-256 of the words), n_words, keys."""
    arrow_ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n, f, keys = utf8(b.column(1)), [], [], []
            for i, j in in_chunks(texts):
                h, at = hash_words(texts[i:j])
                for t, lo, hi in zip(texts[i:j], at[:-1].tolist(), at[1:].tolist()):
                    n.append(hi - lo)
                    f.append(hashlib.sha256(b" ".join(words_of(t))).digest()[:16])
                    keys.append(order_minhash(labelled(ngram_hashes(h[lo:hi], SHINGLE))))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*keys, np.empty(0, np.uint64)]).view(np.int64)))
            halves = np.frombuffer(b"".join(f), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array(n, pa.int64()), lists], names=["__key", "f1", "f2", "n_words", "keys"])

    return docs.select("__key", "text").mapInArrow(run, "__key long, f1 long, f2 long, n_words long, keys array<long>")


def shingle_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of the shingle bags of two word sequences."""
    x, y = labelled(ngram_hashes(a, SHINGLE)), labelled(ngram_hashes(b, SHINGLE))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 0.0


def edits_within(a: np.ndarray, b: np.ndarray, limit: int) -> int | None:
    """Edit distance of two sequences by an alignment whose band widens with each edit."""
    short = min(len(a), len(b))
    off = np.flatnonzero(a[:short] != b[:short])
    pre = int(off[0]) if len(off) else short
    a, b = a[pre:], b[pre:]
    short = min(len(a), len(b))
    off = np.flatnonzero(a[len(a) - short :][::-1] != b[len(b) - short :][::-1])
    suf = int(off[0]) if len(off) else short
    a, b = a[: len(a) - suf], b[: len(b) - suf]
    n, m = len(a), len(b)
    if abs(n - m) > limit:
        return None
    if not n or not m:
        return n + m
    la, lb = a.tolist(), b.tolist()

    def slide(i: int, k: int) -> int:
        """Furthest place in a on diagonal k (= place in b minus place in a) from i on."""
        step = 32
        while i < n and i + k < m:
            if la[i] != lb[i + k]:
                return i
            size = min(step, n - i, m - i - k)
            bad = np.flatnonzero(a[i : i + size] != b[i + k : i + k + size])
            if len(bad):
                return i + int(bad[0])
            i += size
            step *= 4
        return i

    low = -2
    far = {0: slide(0, 0)}
    for e in range(limit + 1):
        if e:
            new = {}
            for k in range(max(-e, -n), min(e, m) + 1):
                i = max(far.get(k, low) + 1, far.get(k - 1, low), far.get(k + 1, low) + 1)
                i = min(i, n, m - k)
                if i >= max(0, -k):
                    new[k] = slide(i, k)
            far = new
        if far.get(m - n, low) >= n:
            return e
    return None


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    x, y = len(a) - SHINGLE + 1, len(b) - SHINGLE + 1
    if min(x, y) < 1 or min(x, y) < SIMILARITY * max(x, y) or shingle_jaccard(a, b) < SIMILARITY:
        return False
    return edits_within(a, b, int((1 - SIMILARITY) * max(len(a), len(b)) + 1e-9)) is not None


def verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of pairs (a, b; a materialised table) of row keys that are links."""
    arrow_ready(docs.sparkSession)
    rows, n = pairs.select("a", "b"), pairs.count()
    # a leader of a large bucket stands in many pairs, at either end: such pairs are dealt to many tasks
    for end, other in (("b", "a"), ("a", "b")):
        texts = among(docs.select("__key", "text"), "__key", pairs.select(end)).select(F.col("__key").alias(end), F.col("text").alias(f"t{end}"))
        rows = hot_join(rows, texts, [end], other, n, "inner", pairs.groupBy(end).agg(F.count("*").alias("n")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [utf8(batch.column(k)) for k in (2, 3)]
            good, last = [], (None, None)
            for i in range(batch.num_rows):
                if last[0] != ids[i]:
                    last = (ids[i], hash_words([texts[0][i]])[0])
                good.append(similar(last[1], hash_words([texts[1][i]])[0]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return materialize(narrow(rows.select("a", "b", "ta", "tb"), n, PAIRS).mapInArrow(run, "a long, b long"), "links")


def mixed_rows(buckets: DataFrame, comp: DataFrame) -> DataFrame:
    """The rows of buckets that are in several classes, with c (their class)."""
    rows = buckets.join(comp.select(F.col("node").alias("rep"), F.col("component").alias("c")), "rep", "left").withColumn("c", F.coalesce("c", "rep"))
    n = buckets.count()
    mixed = rows.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n")).filter(f"lo < hi or n > {hot_at(n)}")
    mixed = materialize(mixed.select("key", "n", (F.col("lo") < F.col("hi")).alias("mixed")), "mixed")
    return materialize(narrow(hot_join(rows, mixed, ["key"], "rep", n, "inner").filter("mixed").drop("mixed"), n, ROWS), "rows")


def joined(comp: DataFrame, links: DataFrame, merge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """comp (node, component) after more links (a, b): classes that these join get a common name by
    merge, which maps edges (a, b), a < b, to (node, component)."""
    e, n = links.select("a", "b", F.col("a").alias("x"), F.col("b").alias("y")), links.count()
    for end, other, name in (("a", "b", "x"), ("b", "a", "y")):
        uses = links.groupBy(end).agg(F.count("*").alias("n"))
        ends = comp.select(F.col("node").alias(end), F.col("component").alias("c"))
        e = hot_join(e, ends, [end], other, n, "left", uses).withColumn(name, F.coalesce("c", end)).drop("c")
    e = e.select(F.col("x").alias("a"), F.col("y").alias("b"))
    over = materialize(merge(e.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))), "over")
    uses = comp.groupBy("component").agg(F.count("*").alias("n"))
    new = uses.join(over.select(F.col("node").alias("component"), F.col("component").alias("c")), "component", "left")
    moved = hot_join(comp, new, ["component"], "node", comp.count()).select("node", F.coalesce("c", "component").alias("component"))
    alone = over.join(comp.select("node"), "node", "left_anti").select("node", "component")
    return materialize(narrow(moved.unionByName(alone), comp.count() + over.count(), ROWS), "classes")


def shingles(docs: DataFrame) -> DataFrame:
    """rep, c and list of occurrence-labelled shingles of docs (rep, c, text)."""
    arrow_ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [labelled(ngram_hashes(hash_words([t])[0], SHINGLE)).view(np.int64) for t in utf8(b.column(2))]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*lists, np.empty(0, np.int64)])))], names=["rep", "c", "s"])

    return docs.select("rep", "c", "text").mapInArrow(run, "rep long, c long, s array<long>")


def prefixes(lists: DataFrame) -> DataFrame:
    """(rep, c, n, rest, s): the n - ceil(0.8 n) + 1 first shingles of each text of lists (rep, c, s).

    All texts are sorted by one order: by the count of all shingles that fall into the same of
    COUNTERS counters, then by value. rest is the number of a text's shingles from s on. The counters
    steer how many texts meet at a shingle, never which pairs are found, so that a table of a
    fixed size does and the shingles themselves need not be shuffled to be counted.
    """
    mask = COUNTERS - 1
    counts = lists.select(F.explode("s").alias("s")).groupBy(F.col("s").bitwiseAND(F.lit(mask)).cast("int").alias("k")).count()
    got = counts.filter("count > 1").select("k", F.round(3 * F.log2("count")).cast("tinyint").alias("level")).toArrow()
    level = np.zeros(COUNTERS, np.uint8)
    level[got.column("k").to_numpy()] = got.column("level").to_numpy()
    shared = lists.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[np.empty(0, np.int64)] for _ in range(5)]
            for rep, c, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                g = g.values.to_numpy()
                n = len(g)
                if n:
                    first = g[np.lexsort((g, shared.value[g & mask]))][: n - (4 * n + 4) // 5 + 1]
                    for column, x in zip(out, (np.full(len(first), rep), np.full(len(first), c), np.full(len(first), n), n - np.arange(len(first)), first)):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["rep", "c", "n", "rest", "s"])

    return lists.mapInArrow(run, "rep long, c long, n long, rest long, s long")


def rare_pairs(reps: DataFrame, docs: DataFrame) -> DataFrame:
    """All pairs (a, b) of reps (rep, c) of different c that may reach SIMILARITY, by prefix filtering.

    A pair that reaches the similarity shares a shingle in both prefixes, and from the first one
    shared on enough are left in both.
    """
    texts = reps.join(among(docs.select("__key", "text"), "__key", reps.select("rep")).withColumnRenamed("__key", "rep"), "rep").dropDuplicates(["rep"])
    lists = materialize(shingles(narrow(texts, reps.count(), PAIRS)), "shingles")
    index = materialize(prefixes(lists), "index")
    rows = index.count()
    # a shingle of one class only is in no pair; that of many texts is joined in blocks
    met = index.groupBy("s").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n")).filter(f"lo < hi or n > {hot_at(rows)}")
    met = materialize(met.select("s", "n", (F.col("lo") < F.col("hi")).alias("met"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "met")
    index = hot_join(index.withColumnRenamed("n", "size"), met, ["s"], "rep", rows, "inner").filter("met")
    index = materialize(narrow(index.withColumnRenamed("size", "n").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")), rows, ROWS), "index")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    x = index.select("s", F.col("block").alias("i"), every.alias("j"), *(F.col(k).alias(f"{k}_a") for k in ("rep", "c", "n", "rest")))
    y = index.select("s", every.alias("i"), F.col("block").alias("j"), *(F.col(k).alias(f"{k}_b") for k in ("rep", "c", "n", "rest")))
    both = x.join(y, ["s", "i", "j"]).filter("rep_a < rep_b and c_a <> c_b and 9 * least(rest_a, rest_b) >= 4 * (n_a + n_b)")
    return narrow(both.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct(), rows, ROWS)


def classes(docs: DataFrame) -> DataFrame:
    """Of docs (__key, text): __key, rep (smallest key with the same words) and class (smallest key
    of the class)."""
    with scope() as keep:
        sk = materialize(sketches(docs), "sketch")
        n = sk.count()
        same = sk.filter("n_words > 0").groupBy("f1", "f2").agg(F.min("__key").alias("rep"), F.count("*").alias("n")).filter("n > 1")
        same = materialize(same, "same")
        member = hot_join(sk.select("__key", "f1", "f2"), same, ["f1", "f2"], "__key", n).select("__key", F.coalesce("rep", "__key").alias("rep"))
        member = materialize(narrow(member, n, ROWS), "member")
        drop(same)
        copies = member.filter("__key <> rep").select("__key")
        each = sk.join(copies, "__key", "left_anti").select(F.col("__key").alias("rep"), F.explode("keys").alias("key")).distinct()
        lead = each.groupBy("key").agg(F.min("rep").alias("lead"), F.max("rep").alias("last"), F.count("*").alias("size")).filter("lead < last")
        lead = materialize(narrow(lead.select("key", "lead", "size", F.col("size").alias("n")), SKETCHES * n, ROWS), "lead")
        n_docs, n = n, lead.agg(F.sum("size")).first()[0] or 0
        buckets = materialize(narrow(hot_join(each, lead, ["key"], "rep", n, "inner"), n, ROWS), "buckets")
        pairs = materialize(narrow(buckets.filter("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct(), n, ROWS), "pairs")
        links = verify(pairs, docs)
        # until all links are known, names of classes only spare comparisons and need not be final
        comp = materialize(near_labels(links), "classes")
        # what shares a bucket but no class yet: against a member drawn for that bucket, and in small
        # buckets every pair of classes
        rows = mixed_rows(buckets, comp)
        heads = rows.groupBy("key").agg(F.min_by(F.struct("rep", "c"), F.xxhash64("rep", "key")).alias("head"), F.count("*").alias("n"))
        found = hot_join(rows, heads, ["key"], "rep", n, "inner").filter("c <> head.c").select(F.least("head.rep", "rep").alias("a"), F.greatest("head.rep", "rep").alias("b"))
        some = rows.filter(F.col("size").between(3, SMALL))
        found = found.unionByName(some.select("key", F.col("rep").alias("a"), F.col("c").alias("ca")).join(some.select("key", F.col("rep").alias("b"), F.col("c").alias("cb")), "key").filter("a < b and ca <> cb").select("a", "b"))
        pairs = materialize(narrow(found.distinct().join(pairs, ["a", "b"], "left_anti"), SMALL * n, ROWS), "pairs")
        more = verify(pairs, docs)
        comp = joined(comp, links.unionByName(more), near_labels)
        # larger buckets that are still in several classes: by the rarest shingles
        rows = mixed_rows(buckets.filter(F.col("size") > SMALL), comp)
        links = links.unionByName(more)
        if not rows.isEmpty():
            reps = materialize(narrow(rows.select("rep", "c").distinct(), rows.count(), ROWS), "reps")
            links = links.unionByName(verify(materialize(rare_pairs(reps, docs), "pairs"), docs))
        comp = joined(comp, links, lambda e: components(e, "a", "b"))
        # every text of a class with all its copies: a text with many is dealt to many tasks
        most = member.groupBy("rep").agg(F.count("*").alias("n"))
        comp = comp.select(F.col("node").alias("rep"), F.col("component").alias("c"))
        named = hot_join(member, most.join(comp, "rep", "left"), ["rep"], "__key", n_docs)
        return keep(materialize(named.select("__key", "rep", F.coalesce("c", "rep").alias("class")), "classes"))


def _named(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs with __key, and (__key, class_id, kept) for each."""
    docs, plain = keyed(docs)
    found = classes(docs.select("__key", "text"))
    if plain:
        return docs, found.select("__key", F.col("class").alias("class_id"), (F.col("class") == F.col("__key")).alias("kept"))
    rows = found.select("__key", "class").join(docs.select("__key", "doc_id"), "__key")
    rows = materialize(rows, "named")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__key"))
    groups = materialize(rows.groupBy("class").agg(first.alias("first"), F.count("*").alias("n")), "groups")
    out = hot_join(rows.select("__key", "class"), groups, ["class"], "__key", rows.count())
    return docs, out.select("__key", F.col("first.doc_id").alias("class_id"), (F.col("first.__key") == F.col("__key")).alias("kept"))


def op3(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, class_id and kept (the row is the one of its class that stays) for every row."""
    docs, found = _named(docs.select("doc_id", "text"))
    return docs.select("__key", "doc_id").join(found, "__key").select("doc_id", "class_id", "kept")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each class (that with the smallest id), with all columns of docs."""
    cols = docs.columns
    docs, found = _named(docs)
    gone = found.filter("not kept").select("__key")
    return docs.join(gone, "__key", "left_anti").select(*cols)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3(spark, load(spark, sf_dir, "documents"))
