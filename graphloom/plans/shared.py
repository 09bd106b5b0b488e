"""The folder that driver and executors share, tables written there, and the code workers need."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only a session of one machine gets a local folder."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="graphloom-checkpoints-"))
        at = sc.getCheckpointDir()
    return at.rstrip("/")


def written(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """df written as Parquet in the shared folder (in folders by a column) and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom-store/{tag}-{uuid.uuid4().hex}"
    if _SCRATCH:
        _SCRATCH[-1].append((spark, path))
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(rows: DataFrame, by: str) -> DataFrame:
    """rows dealt over some tasks for each core, for work that costs far more than its bytes tell. A number is
    given because small files would be few splits, and few bytes be coalesced to few tasks; it is not that of a
    shuffle, as each task that is shuffled again writes a part for each of that shuffle's tasks."""
    spark = rows.sparkSession
    cores, most = spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(cores, min(most, max(4 * cores, 32))), by)


#: Tables written in each open scratch().
_SCRATCH: list[list[tuple[SparkSession, str]]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes what written() writes in it, at its end: for work whose result is written elsewhere."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for spark, path in _SCRATCH.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, once for each context."""
    sc = spark.sparkContext
    if not getattr(sc, "_graphloom_shipped", False):
        root = Path(__file__).resolve().parents[1]
        zipped = Path(tempfile.mkdtemp(prefix="graphloom-code-")) / "graphloom_core.zip"
        with zipfile.ZipFile(zipped, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(zipped))
        sc._graphloom_shipped = True
