"""Streams whose state outlives the query: quiet-time debounce, and a queue of embedding work.

The state lies in the state store below the query's checkpoint and is committed with each batch, so that a
query that was killed goes on where its last batch ended: nothing that waited is lost, and what was
being worked on is worked on again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.vector import Provider
from ..plans.shared import ship


def settled(events: DataFrame, quiet_ms: int = 1_500, key: str = "path") -> DataFrame:
    """Of each key (path) the last event (path, mtime, raw), once none has come for quiet_ms: the
    trailing edge of a burst. An event with an earlier mtime than one before it is no newer state."""
    ship(events.sparkSession)

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            micros, raw = state.get
            state.remove()
            yield pd.DataFrame({key: [keys[0]], "micros": [micros], "raw": [raw]})
            return
        last = state.get if state.exists else None
        for pdf in batches:
            for micros, raw in zip(pdf["micros"].tolist(), pdf["raw"].tolist()):
                if last is None or micros >= last[0]:
                    last = (int(micros), raw)
        if last is not None:
            state.update(last)
            state.setTimeoutDuration(quiet_ms)
        yield pd.DataFrame({key: [], "micros": [], "raw": []})

    rows = events.select(key, F.unix_micros(F.col("mtime").cast("timestamp")).alias("micros"), "raw")
    out = rows.groupBy(key).applyInPandasWithState(run, f"{key} string, micros long, raw string", "micros long, raw string", "append", GroupStateTimeout.ProcessingTimeTimeout)
    return out.select(key, F.timestamp_micros("micros").alias("mtime"), "raw")


#: Parts that the queue is dealt into; each works off its own chunks in batches.
PARTS = 64


def worked_off(chunks: DataFrame, provider: Provider, most: int = 3, retry_ms: int = 1_000, batch: int = 50, parts: int = PARTS) -> DataFrame:
    """(chunk_id, embedding, status, attempts, error) of a stream of chunks (chunk_id, content): `done`
    with its vector, or `failed` with the error after `most` attempts.

    Chunks are taken in batches; a batch that fails waits retry_ms and is tried again, all its chunks with
    an attempt more. Only what waits is kept. A chunk that comes again while it waits replaces the
    older content and begins anew.
    """
    ship(chunks.sparkSession)
    call = provider.embed
    columns = ["chunk_id", "embedding", "status", "attempts", "error"]

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting: dict[str, tuple[str, int]] = {c: (t, n) for c, t, n in json.loads(state.get[0])} if state.exists else {}
        for pdf in batches:
            for c, t in zip(pdf["chunk_id"].tolist(), pdf["content"].tolist()):
                waiting.pop(c, None)
                waiting[c] = (t or "", 0)
        out, left = [], []
        todo = list(waiting.items())
        for i in range(0, len(todo), batch):
            some = todo[i : i + batch]
            try:
                vectors = call([t for _, (t, _) in some])
                if len(vectors) != len(some):
                    raise ValueError(f"{len(vectors)} vectors for {len(some)} texts")
                out += [(c, [float(x) for x in v], "done", n + 1, None) for (c, (_, n)), v in zip(some, vectors)]
            except Exception as e:  # whatever the provider raises is an attempt that failed
                out += [(c, None, "failed", n + 1, str(e)) for c, (_, n) in some if n + 1 >= most]
                left += [(c, t, n + 1) for c, (t, n) in some if n + 1 < most]
        if left:
            state.update((json.dumps(left),))
            state.setTimeoutDuration(retry_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=columns)

    dealt = chunks.select(F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).alias("part"), "chunk_id", "content")
    return dealt.groupBy("part").applyInPandasWithState(run, "chunk_id string, embedding array<float>, status string, attempts int, error string", "waiting string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def written_to(stream: DataFrame, path: str, checkpoint: str, every: str = "1 second"):
    """The running query that appends a stream's rows to Parquet files, each batch once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime=every).start()
