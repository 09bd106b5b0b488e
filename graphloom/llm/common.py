"""Shared pieces of the corpus operators: shared-folder tables, words, hashing."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)

#: Bytes of one Arrow batch sent to a Python worker; very long texts thus never pile up.
BATCH_BYTES = "4m"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only a session of one machine (tests) that names none gets a local folder; on a cluster that is an error.
    """
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="graphloom-checkpoints-"))
        at = sc.getCheckpointDir()
    return at.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom-tables/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._graphloom_path = path
    if _SCOPES:
        _SCOPES[-1].append(out)
    return out


#: Tables written in each open scope().
_SCOPES: list[list[DataFrame]] = []


@contextmanager
def scope() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the tables of materialize() that were written in it, but for those given to what it
    yields, which stay until an outer scope ends. Nothing may be read from the others later."""
    _SCOPES.append([])
    kept: list[DataFrame] = []

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table)
        return table

    try:
        yield keep
    finally:
        stay = {t._graphloom_path for t in kept}
        for t in _SCOPES.pop():
            if t._graphloom_path not in stay:
                drop(t)
            elif _SCOPES:
                _SCOPES[-1].append(t)


def narrow(df: DataFrame, rows: int, per_task: int) -> DataFrame:
    """df in tasks of about per_task rows, where a small result would else be cut into many tasks
    and files; a result with enough rows keeps its partitions. rows is a bound that was counted."""
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // per_task)))


def drop(df: DataFrame) -> None:
    """Delete a table of materialize() that nothing will read again."""
    path = getattr(df, "_graphloom_path", None)
    if path:
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs with `__key`, a long of its own for each row, and whether that is simply doc_id.

    Where an id is null or stands on several rows, rows are numbered, and docs are written so that
    every later reading sees the same numbers.
    """
    if docs.groupBy("doc_id").count().filter("doc_id is null or count > 1").isEmpty():
        return docs.withColumn("__key", F.col("doc_id")), True
    return materialize(docs.withColumn("__key", F.monotonically_increasing_id()), "keyed"), False


#: A key of a join is hot when it holds more than one in PARTS of the rows.
PARTS = 256


def hot_at(rows: int) -> int:
    """The number of rows of a key up to which it is not hot in a table of rows."""
    return max(1, -(-rows // PARTS))


def hot_join(left: DataFrame, right: DataFrame, on: list[str], spread: str, rows: int, how: str = "left", counts: DataFrame | None = None, apart: bool = False) -> DataFrame:
    """left joined with right, in which each key stands once with n, its number of rows in left.

    Keys with more than hot_at(rows) rows are dealt by the column `spread` of left to several tasks,
    and their row of right is repeated for each. There are at most PARTS such keys, as the counts of
    different keys add up to no more than rows, so that the driver may know them by their hashes.
    A hot key of left must be dealt whether or not it finds a partner: right holds it too, or counts
    (the key and n) are given apart. With apart, for a right that is a written table, its rows of the
    other keys are not handed through the explode of the hot ones.
    """
    most = hot_at(rows)
    key = F.xxhash64(*on)
    hot = (right if counts is None else counts).filter(F.col("n") > most).select(key.alias("key"), "n").collect()
    if not hot:
        return left.join(right.drop("n"), on, how)
    salts = -(-max(r["n"] for r in hot) // most)
    is_hot = key.isin([r["key"] for r in hot])
    dealt = left.withColumn("__salt", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(0))
    if apart:
        copies = right.withColumn("__salt", F.lit(0)).unionByName(right.withColumn("__salt", F.explode(F.when(is_hot, F.sequence(F.lit(1), F.lit(salts - 1))))))
        return dealt.join(copies.drop("n"), [*on, "__salt"], how).drop("__salt")
    copies = right.withColumn("__salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(copies.drop("n"), [*on, "__salt"], how).drop("__salt")


#: Bits (a power of two) of the bitmap of keys that among() holds rows against, and those of a row of it.
SLOTS, SLOTS_IN_ROW = 1 << 25, 1 << 15


def among(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose key may be in the one column of ids, for a join that follows: all that are in it, and
    of the others the few whose hash has the place of one that is. The bitmap has the same size whatever
    the number of ids, so that it can be sent to all tasks where the ids can't, and long rows that the
    join would only throw away are not shuffled."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS))
    row, at = (place(key) / SLOTS_IN_ROW).cast("int"), place(key) % SLOTS_IN_ROW
    slots = ids.select(place(ids.columns[0]).alias("s"))
    bits = slots.groupBy((F.col("s") / SLOTS_IN_ROW).cast("int").alias("__row")).agg(F.bitmap_construct_agg(F.col("s") % SLOTS_IN_ROW).alias("__bits"))
    byte = F.conv(F.hex(F.substring("__bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = rows.withColumn("__row", row).join(F.broadcast(bits), "__row").filter(F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1)
    return met.select(*rows.columns)


def first_by_hash(rows: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """The `most` first rows of each group of rows (a written table) by order, whose first column
    is an evenly spread 64-bit hash, with their place k.

    Of a group of n rows the first ones lie below a bound that follows from n, with room to spare,
    so that about `most` rows of a group meet in a task, whatever its size. Where chance has left
    fewer than asked below a bound, it is raised.
    """
    sizes = materialize(rows.groupBy(*by).agg(F.count("*").alias("n"), F.count("*").alias("__size")), "sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    part = F.col(order[0]) / F.lit(2.0**64) + 0.5
    room = most + 8 * most**0.5 + 16
    while True:
        near = hot_join(rows, sizes, by, order[0], total, "inner").filter(part * F.col("__size") <= room)
        near = materialize(near, "near")
        short = near.groupBy(*by).agg(F.count("*").alias("got")).join(sizes, by, "right").filter(F.coalesce("got", F.lit(0)) < F.least("__size", F.lit(most)))
        if short.isEmpty():
            break
        drop(near)
        room *= 4
    drop(sizes)
    return near.drop("__size").withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("k") <= most)


def arrow_ready(spark: SparkSession) -> None:
    """Bound the Arrow batches by bytes, so that memory does not follow the length of texts,
    and send the package to the Python workers (once for each context)."""
    sc = spark.sparkContext
    if not getattr(sc, "_graphloom_sent", False):
        root = Path(__file__).resolve().parents[1]
        zipped = Path(tempfile.mkdtemp(prefix="graphloom-code-")) / "graphloom_code.zip"
        with zipfile.ZipFile(zipped, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(zipped))
        sc._graphloom_sent = True
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words_of(text: bytes | str | None) -> list[bytes]:
    """The words of a text as UTF-8. bytes.split() splits at exactly the six white-space bytes."""
    if not text:
        return []
    return (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text).split()


def utf8(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


_IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_R, _R_INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}
#: Bytes up to which words are hashed side by side, eight bytes at a time.
SIDE_BY_SIDE = 64


def _powers(base: int, n: int) -> np.ndarray:
    got = _POWERS.get(base)
    if got is None or len(got) < n:
        size = max(1 << n.bit_length(), 1 << 14)
        got = np.full(size, np.uint64(base), np.uint64)
        got[0] = 1
        got = _POWERS[base] = np.cumprod(got)
    return got[:n]


def hash_words(texts: list[bytes | None], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and the bounds of each text's words.

    A word's hash mixes its bytes, eight at a time, into a state that starts from seed and length,
    so that no arrangement of equal parts cancels out; long words are hashed one by one.
    """
    joined = b"\n".join(t or b"" for t in texts) + b"\n"
    buf = np.frombuffer(joined, np.uint8)
    space = _IS_SPACE[buf]
    edge = np.empty(len(buf), bool)
    edge[0] = not space[0]
    np.not_equal(space[1:], space[:-1], out=edge[1:])
    at = np.flatnonzero(edge)
    first, last = at[::2], at[1::2]
    size = last - first
    h = mix64(size.astype(np.uint64) * np.uint64(_R) + np.uint64((seed * 0xD1B54A32D192ED03 + 0x8BB84B93962EACC9) % 2**64))
    padded = joined + b"\0" * 8
    eights = np.ndarray((len(joined),), "<u8", padded, strides=(1,))
    some = np.flatnonzero(size <= SIDE_BY_SIDE)
    for at in range(0, SIDE_BY_SIDE, 8):
        some = some[size[some] > at] if at else some
        if not len(some):
            break
        left = np.minimum(size[some] - at, 8).astype(np.uint64)
        part = eights[first[some] + at] & (np.uint64(2**64 - 1) >> (np.uint64(64) - np.uint64(8) * left))
        h[some] = mix64(h[some] ^ part) + np.uint64(_R)
    for i in np.flatnonzero(size > SIDE_BY_SIDE).tolist():
        h[i] = xxhash.xxh3_64_intdigest(joined[first[i] : last[i]], seed)
    ends = np.cumsum([len(t or b"") + 1 for t in texts])
    return mix64(h), np.concatenate([[0], np.searchsorted(first, ends)])


def in_chunks(texts: list[bytes | str | None], size: int = 500_000):
    """Index ranges of texts of about `size` bytes (or characters) together (one text at least)."""
    start, got = 0, 0
    for i, t in enumerate(texts):
        got += len(t or "")
        if got >= size:
            yield start, i + 1
            start, got = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def ngram_hashes(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of all n-grams of a sequence of (well mixed) word hashes, from running sums."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    base = (_R + 0x51ED2700 * seed) | 1
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _powers(base, len(h)), out=sums[1:])
    return mix64((sums[n:] - sums[:m]) * _powers(pow(base, -1, 2**64), m))


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n neighbours, by doubling."""
    if len(x) < n:
        return x[:0]
    width = 1
    while 2 * width <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (n - width)], x[n - width :]) if n > width else x


def crc_mod(doc_id: int, mod: int = 3) -> int:
    return zlib.crc32(str(doc_id).encode()) % mod


def crc_mod_col(col, mod: int = 3):
    """crc32 of the id's text, as Spark computes it."""
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(mod))
