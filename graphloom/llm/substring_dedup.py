r"""Substring deduplication with a log-structured index of window fingerprints.

A window is N consecutive words of one document. A word goes when it lies in a window whose word
sequence also starts in a document with a smaller id. FingerprintIndex keeps the fingerprints of the
windows seen so far, with the smallest id each started in, as immutable runs of one folder, each
sorted and bucketed by fingerprint, named by a manifest. A batch is aggregated, merge-joined with
each run (whose buckets need no new shuffle), verified, and becomes a run of its own; runs of like
size are merged before the next batch. The index can be opened again later, and two batches give
the same as one, as long as a later batch has no smaller ids.

A fingerprint is a rolling hash of the words' hashes; a match is verified by a second hash, which is
worked out from the bytes of the window itself, independently of the first.

op7 has the whole table at hand, and so spares the index the windows that cannot repeat: the smallest
hash of the ANCHOR-word grams inside a window is its anchor (equal windows have equal anchors,
about every fifth gram is one), and only windows whose anchor occurs in two documents reach the
index. Documents with the same words as one of a smaller id lose all windows and stay out of it.

Defined results: null and blank texts have no words; texts shorter than a window lose nothing; each
row gives one row, and rows of the same id, with the same text or others, never remove from each
other; rows without an id come back whole and remove nothing; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_ready, drop, hash_words, hot_join, in_chunks, keyed, load, materialize, ngram_hashes, scope, shared_dir, sliding_min, utf8, words_of

N, ANCHOR = 13, 5
#: Batches that a whole table is fed to the index in; runs are merged while the one before is not
#: FANOUT times as large; buckets of a run, at least.
BATCHES, FANOUT, BUCKETS = 3, 2, 64


def anchors(h: np.ndarray, n: int = N) -> np.ndarray:
    """For each window of n words the smallest hash of its ANCHOR-word grams."""
    g = ngram_hashes(h, ANCHOR, 11)
    if len(h) < n:
        return np.empty(0, np.uint64)
    return sliding_min(g, n - ANCHOR + 1)


def _digest(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def profile(docs: DataFrame, n: int = N) -> DataFrame:
    """__key, n_words, sha (SHA-256 of the words) and anchors (distinct, of texts with a window)."""
    arrow_ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, found = [], []
            texts = utf8(b.column(1))
            sha = [_digest(words_of(t)) for t in texts]
            for i, j in in_chunks(texts):
                h, at = hash_words(texts[i:j])
                for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
                    size.append(hi - lo)
                    found.append(np.unique(anchors(h[lo:hi], n)).view(np.int64))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*found, np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(size, pa.int64()), pa.array(sha, pa.binary()), lists], names=["__key", "doc_id", "n_words", "sha", "anchors"])

    return docs.select("__key", "text", "doc_id").mapInArrow(run, "__key long, doc_id long, n_words long, sha binary, anchors array<long>")


def repeated_anchors(profiles: DataFrame) -> DataFrame:
    """(__key, shared): the anchors of each row of profiles (__key, doc_id, anchors) that a document
    with another id has too."""
    each = profiles.select("__key", "doc_id", F.explode("anchors").alias("h"))
    met = each.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).filter("lo < hi")
    met = materialize(met.select("h", "n"), "anchors")
    rows = met.agg(F.sum("n")).first()[0] or 0
    return hot_join(each.select("__key", "h"), met, ["h"], "__key", rows, "inner").groupBy("__key").agg(F.collect_list("h").alias("shared"))


def windows(docs: DataFrame, shared: DataFrame | None = None, n: int = N) -> DataFrame:
    """(wh, chk, doc_id, __key, pos) of the windows of docs (doc_id, __key, text) whose id isn't
    null; with shared (__key, shared), of those with an anchor in it."""
    arrow_ready(docs.sparkSession)
    docs = docs.filter("doc_id is not null").select("__key", "doc_id", "text")
    rows = docs.withColumn("shared", F.lit(None).cast("array<long>")) if shared is None else docs.join(shared, "__key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["wh", "chk", "doc_id", "__key", "pos"]
        for b in batches:
            parts, size = [], 0
            keys, ids, texts, wanted = b.column(0).to_pylist(), b.column(1).to_pylist(), utf8(b.column(2)), b.column(3)
            for i, j in in_chunks(texts):
                every, at = hash_words(texts[i:j])
                for k in range(i, j):
                    h = every[at[k - i] : at[k - i + 1]]
                    if len(h) < n:
                        continue
                    pos = np.arange(len(h) - n + 1)
                    if wanted[k].is_valid:
                        pos = pos[np.isin(anchors(h, n).view(np.int64), wanted[k].values.to_numpy(zero_copy_only=False))]
                    words = words_of(texts[k])
                    line = memoryview(b" ".join(words))
                    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
                    begins = np.concatenate([[0], ends[:-1] + 1])
                    digest = xxhash.xxh3_64_intdigest
                    chk = np.array([digest(line[s:e], 17) for s, e in zip(begins[pos].tolist(), ends[pos + n - 1].tolist())], np.uint64)
                    wh = ngram_hashes(h, n, 1)[pos]
                    parts.append((wh.view(np.int64), chk.view(np.int64), np.full(len(pos), ids[k], np.int64), np.full(len(pos), keys[k], np.int64), pos.astype(np.int32)))
                    size += len(pos)
                if size > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], names=names)
                    parts, size = [], 0
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], names=names)

    return rows.select("__key", "doc_id", "text", "shared").mapInArrow(run, "wh long, chk long, doc_id long, __key long, pos int")


class FingerprintIndex:
    """Sorted immutable runs of (wh, chk, first): window fingerprints and their first id.

    FingerprintIndex.open(spark, path) reads the newest manifest below path, or starts an empty
    index there. append() returns the hits of a batch and makes the batch part of the index; a run
    and the manifest that names it are complete before the older manifest is out of use, so that an
    append that fails leaves the index as it was.
    """

    COLUMNS = ("wh", "chk", "first")

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        # as many as a shuffle has partitions: a batch meets a run without another shuffle, and each task writes one bucket
        buckets = buckets or max(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.spark, self.path, self.buckets, self.version = spark, path.rstrip("/"), buckets, 0
        #: (folder, rows) of each run, oldest first
        self.runs: list[tuple[str, int]] = []

    @classmethod
    def open(cls, spark: SparkSession, path: str, buckets: int | None = None) -> FingerprintIndex:
        index = cls(spark, path, buckets)
        done = [int(name.removeprefix("manifest-")) for name in index._names() if name.startswith("manifest-") and index._exists(f"{name}/_SUCCESS")]
        if done:
            index.version = max(done)
            rows = sorted(spark.read.parquet(f"{index.path}/manifest-{index.version}").collect(), key=lambda r: r["place"])
            index.buckets = rows[0]["buckets"]
            index.runs = [(r["folder"], r["rows"]) for r in rows if r["folder"]]
        return index

    def _fs(self, name: str = ""):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        at, fs = self._fs(name)
        return fs.exists(at)

    def _names(self) -> list[str]:
        at, fs = self._fs()
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def _delete(self, name: str) -> None:
        at, fs = self._fs(name)
        fs.delete(at, True)

    def read(self, folder: str) -> DataFrame:
        """A run as a bucketed table, known to the session under its own name."""
        name = f"graphloom_{folder.replace('-', '_')}"
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (wh BIGINT, chk BIGINT, first BIGINT) USING parquet "
            f"CLUSTERED BY (wh, chk) SORTED BY (wh, chk) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{folder}'"
        )
        return self.spark.table(name)

    def _forget(self, folder: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS graphloom_{folder.replace('-', '_')}")
        self._delete(folder)

    def _write(self, rows: DataFrame) -> tuple[str, int]:
        folder = f"run-{uuid.uuid4().hex}"
        ordered = rows.select(*self.COLUMNS).repartition(self.buckets, "wh", "chk")
        name = f"graphloom_{folder.replace('-', '_')}"
        ordered.write.format("parquet").bucketBy(self.buckets, "wh", "chk").sortBy("wh", "chk").option("path", f"{self.path}/{folder}").saveAsTable(name)
        return folder, self.spark.table(name).count()

    def _commit(self) -> None:
        old, self.version = self.version, self.version + 1
        rows = [(i, f, n, self.buckets) for i, (f, n) in enumerate(self.runs)] or [(0, None, 0, self.buckets)]
        self.spark.createDataFrame(rows, "place int, folder string, rows long, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest-{self.version}")
        if old:
            self._delete(f"manifest-{old}")

    def compact(self) -> None:
        """Merge the youngest runs while the one before is not FANOUT times as large as they."""
        at, rows = len(self.runs) - 1, self.runs[-1][1] if self.runs else 0
        while at > 0 and self.runs[at - 1][1] < FANOUT * rows:
            at -= 1
            rows += self.runs[at][1]
        if at < 0 or at == len(self.runs) - 1:
            return
        old, both = self.runs[at:], None
        for folder, _ in old:
            run = self.read(folder)
            both = run if both is None else both.unionByName(run)
        self.runs = [*self.runs[:at], self._write(both.groupBy("wh", "chk").agg(F.min("first").alias("first")))]
        self._commit()
        for folder, _ in old:
            self._forget(folder)

    def append(self, batch: DataFrame) -> DataFrame:
        """The hits of a batch (see match()), which becomes part of the index."""
        self.compact()
        own, hits = self._met(batch)
        self.runs.append(self._write(own.filter("news")))
        self._commit()
        drop(own)
        return hits

    def match(self, batch: DataFrame) -> DataFrame:
        """(__key, pos) of those windows of batch (wh, chk, doc_id, __key, pos) that also start in a
        document with a smaller id, in the batch or in the index, which stays as it is."""
        own, hits = self._met(batch)
        drop(own)
        return hits

    def _met(self, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The distinct windows of a batch, with news where the index has them from no smaller id, and its hits."""
        own = batch.groupBy("wh", "chk").agg(F.min("doc_id").alias("own"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
        for k, (folder, _) in enumerate(self.runs):
            own = own.hint("merge").join(self.read(folder).withColumnRenamed("first", f"r{k}"), ["wh", "chk"], "left")
        known = [F.col(f"r{k}") for k in range(len(self.runs))]
        seen = F.least(*known) if len(known) > 1 else known[0] if known else F.lit(None).cast("long")
        own = materialize(own.select("wh", "chk", "last", "n", F.least(F.col("own"), seen).alias("first"), (seen.isNull() | (F.col("own") < seen)).alias("news")), "batch")
        met = own.filter("first < last").select("wh", "chk", "first", "n")
        rows = met.agg(F.sum("n")).first()[0] or 0
        hits = hot_join(batch, met, ["wh", "chk"], "__key", rows, "inner", apart=True).filter("first < doc_id").select("__key", "pos")
        return own, materialize(hits, "hits")

    def delete(self) -> None:
        for folder, _ in self.runs:
            self._forget(folder)
        self._delete("")


def strip(rows: DataFrame, n: int = N) -> DataFrame:
    """Apply removals: rows (doc_id, text, starts) -> doc_id, n_words, n_removed, kept_sha256."""
    arrow_ready(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(b.num_rows):
                w = words_of(b.column(1)[i].as_py())
                gone = np.zeros(len(w) + 1, np.int32)
                at = np.unique(b.column(2)[i].values.to_numpy(zero_copy_only=False))
                gone[at] += 1
                np.subtract.at(gone, at + n, 1)
                keep = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
                kept = [w[k] for k in keep.tolist()]
                out.append((len(w), len(w) - len(kept), _digest(kept).hex()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return rows.select("doc_id", "text", "starts").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op7(spark: SparkSession, docs: DataFrame) -> DataFrame:
    with scope() as keep:
        docs, _ = keyed(docs.select("doc_id", "text"))
        prof = materialize(profile(docs), "profile")
        n = prof.count()
        first = prof.filter((F.col("n_words") >= N) & F.col("doc_id").isNotNull()).groupBy("sha").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).filter("n > 1")
        each = prof.select("__key", "doc_id", "n_words", "sha")
        narrow = hot_join(each, materialize(first, "first"), ["sha"], "__key", n).withColumn("copy", F.coalesce(F.col("rep") < F.col("doc_id"), F.lit(False)))
        narrow = materialize(narrow.drop("rep"), "narrow")
        originals = prof.filter("doc_id is not null").join(narrow.filter("copy").select("__key"), "__key", "left_anti")
        shared = materialize(repeated_anchors(originals), "shared")
        found = materialize(windows(docs, shared), "windows")
        low, high = found.agg(F.min("doc_id"), F.max("doc_id")).first()
        index, hits = FingerprintIndex.open(spark, f"{shared_dir(spark)}/graphloom-index-{uuid.uuid4().hex}"), None
        for k in range(BATCHES if low is not None else 0):
            a, b = (low + (high + 1 - low) * x // BATCHES for x in (k, k + 1))
            batch = found.filter((F.col("doc_id") >= a) & (F.col("doc_id") < b))
            got = index.append(batch) if k < BATCHES - 1 else index.match(batch)  # nothing is held against the last one
            hits = got if hits is None else hits.unionByName(got)
        index.delete()
        none = F.sha2(F.lit(""), 256)
        plain = narrow.withColumns({"n_removed": F.when(F.col("copy"), F.col("n_words")).otherwise(0).cast("long"), "kept_sha256": F.when(F.col("copy"), none).otherwise(F.lower(F.hex("sha")))})
        if hits is None:
            return keep(materialize(plain.select("doc_id", "n_words", "n_removed", "kept_sha256"), "stripped"))
        starts = materialize(hits.groupBy("__key").agg(F.collect_list("pos").alias("starts")), "starts")
        plain = plain.join(starts.select("__key"), "__key", "left_anti").select("doc_id", "n_words", "n_removed", "kept_sha256")
        return keep(materialize(plain.unionByName(strip(docs.join(starts, "__key"))), "stripped"))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7(spark, load(spark, sf_dir, "documents"))
