"""File events as streams: debounce, idempotence, transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import clock
from ..sources.notes import IGNORED


def debounce(events: DataFrame, gap: str = "1 hour", watermark: str | None = None, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """(key, start, stop, n): bursts of events of a key with less than gap between them.

    Works on batches and, with a watermark, on streams, where closed bursts are emitted.
    """
    e = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if watermark:
        e = e.withWatermark(ts, watermark)
    g = e.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.max(ts).alias("last"), F.count("*").alias("n"))
    return g.select(key, F.col("w.start").alias("start"), "last", "n")


def once(events: DataFrame, keys: list[str], ts: str = "ts", watermark: str = "1 hour") -> DataFrame:
    """Each content once: repeats within the watermark are dropped (batches: all repeats)."""
    if not events.isStreaming:
        return events.dropDuplicates(keys)
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark).dropDuplicatesWithinWatermark(keys)


def merge_turns(turns: DataFrame, group: str = "conv_id", order: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    """(group, first, speaker, text): neighbouring turns of a speaker joined, empty ones left out."""
    w = Window.partitionBy(group).orderBy(order)
    d = turns.filter(F.trim(text) != "").withColumn("__new", (~F.col(speaker).eqNullSafe(F.lag(speaker).over(w))).cast("int"))
    d = d.withColumn("__run", F.sum("__new").over(w))
    g = d.groupBy(group, "__run").agg(F.min(order).alias("first_turn"), F.min(speaker).alias(speaker), F.array_sort(F.collect_list(F.struct(order, text))).alias("l"))
    return g.select(group, "first_turn", speaker, F.array_join(F.transform("l", lambda x: x[text]), " ").alias(text))


def transcript(turns: DataFrame, group: str = "conv_id", seconds: Column | None = None) -> DataFrame:
    """(group, text): merged turns as lines `[m:ss] Speaker: text`. seconds is the start of a turn
    (default: its number times ten)."""
    m = merge_turns(turns, group)
    at = F.col("first_turn") * 10 if seconds is None else seconds
    line = F.concat(F.lit("["), clock(at), F.lit("] "), F.coalesce("role", F.lit("Unknown")), F.lit(": "), "text")
    return m.select(group, "first_turn", line.alias("line")).groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first_turn", "line"))), lambda x: x["line"]), "\n").alias("text"))


def queue_step(queue: DataFrame, failed: DataFrame, most: int = 3) -> DataFrame:
    """Work queue after a round: failed (chunk_id) rows get an attempt more and fail at `most`."""
    f = failed.select("chunk_id", F.lit(True).alias("__f"))
    q = queue.join(f, "chunk_id", "left").withColumn("attempts", F.col("attempts") + 1)
    return q.select("chunk_id", F.when(F.col("__f").isNull(), "done").when(F.col("attempts") >= most, "failed").otherwise("pending").alias("status"), "attempts")


def claim(queue: DataFrame, chunks: DataFrame, n: int = 50) -> DataFrame:
    """The next n pending rows of a queue (chunk_id, status, attempts) with their texts. What was
    being worked on when a run broke off is pending again."""
    q = queue.withColumn("status", F.when(F.col("status") == "processing", "pending").otherwise(F.col("status")))
    return q.filter("status = 'pending'").orderBy("attempts", "chunk_id").limit(n).join(chunks.select("chunk_id", "content"), "chunk_id")


def note_events(spark: SparkSession, folder: str, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """A stream of new and changed .md files below a folder (path, mtime, raw), but for those in ignored
    folders."""
    d = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(folder)
    d = d.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("mtime"), F.col("value").alias("raw"))
    return d.filter(~F.exists(F.split("path", "/"), lambda s: s.isin(*ignored)))


def watch(events: DataFrame, apply, checkpoint: str, every: str | None = None):
    """Run apply(batch, id) on the last state of each path of a stream of (path, mtime, raw), each
    content once. Batches that ran before a restart are not run again (checkpoint). Without `every`
    what is there is worked off and the stream ends."""

    def run(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("path").agg(F.max_by(F.struct("mtime", "raw"), "mtime").alias("l")).select("path", "l.*")
        if not last.isEmpty():
            apply(last, number)

    w = events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def deletions(known: DataFrame, listed: DataFrame) -> DataFrame:
    """Paths that are known and no longer there; a file source tells of none, a listing does."""
    return known.select("path").join(listed.select("path"), "path", "left_anti")


def with_catalogue(events: DataFrame, load, apply, checkpoint: str):
    """watch() with the schemas loaded anew for each batch, so that edits of them take effect."""
    return watch(events, lambda batch, number: apply(batch, load()), checkpoint)


__all__ = ["claim", "clock", "debounce", "deletions", "merge_turns", "note_events", "once", "queue_step", "transcript", "watch", "with_catalogue"]
