"""A store that outlives its session: immutable runs of rows, and a manifest for each version.

A commit writes the rows of the nodes it touches as one new run of each table, and a list of the nodes
whose earlier rows are void; then it publishes a manifest under the next number. That is one rename, which
fails if the number is taken: readers see a version whole or not at all, and of two writers
that start from the same version the second gets CONFLICT. A failing commit leaves the published
version as it was. Reading a table is one scan of its runs and one join with the void nodes, however
many commits there were; compact() writes them as one run again.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import GraphStore


class Conflict(Exception):
    """Another writer has published the version that was to be published."""

    code = "CONFLICT"


@dataclass(frozen=True)
class Layout:
    """What a table's rows belong to, its columns, and the column that it is laid out in folders by."""

    key: str
    schema: str
    folder: str | None = None


TABLES = {
    "nodes": Layout("id", "id string, title string, indexed_at timestamp_ntz, file_mtime timestamp_ntz"),
    "types": Layout("node_id", "node_id string, schema_type string", "schema_type"),
    "fields": Layout("node_id", "node_id string, key string, value_text string, value_type string, value_number double, value_date string", "key"),
    # name and stem: what the target is resolved by
    "edges": Layout("source_id", "source_id string, target_id string, rel_type string, resolved string, context string, name string, stem string, edge_id string", "rel_type"),
    "contents": Layout("node_id", "node_id string, content_text string"),
    "files": Layout("path", "path string, mtime timestamp, hash string"),
    "chunks": Layout("node_id", "node_id string, chunk_index int, heading string, content string, token_count int"),
    "names": Layout("id", "id string, name string, tier int"),
    "postings": Layout("id", "term string, id string, positions array<int>, len int, folder string", "folder"),
    "lengths": Layout("id", "id string, len int"),
}


class Files:
    """The file system of a folder, local or not, through Hadoop."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """A whole new file, or False if there is one of that name."""
        draft = f"{name}.{uuid.uuid4().hex}.draft"
        stream = self.fs.create(self.path(draft), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path("").toUri(), self.conf)
        no_overwrite = self.spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(self.path(draft), self.path(name), no_overwrite)
            return True
        except Exception as e:
            self.delete(draft)
            if "FileAlreadyExists" in str(e):
                return False
            raise

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


@dataclass
class Snapshot:
    """One version: the runs of each table, oldest first, and those of the void nodes."""

    durable: Durable
    version: int
    runs: dict[str, list[str]] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        spark, layout = self.durable.spark, TABLES[name]
        runs = self.runs.get(name)
        if not runs:
            return spark.createDataFrame([], layout.schema)
        base = f"{self.durable.root}/{name}"
        rows = spark.read.schema(f"{layout.schema}, seg int, run string").option("basePath", base).parquet(*(f"{base}/{r}" for r in runs)).drop("run")
        gone = self._void(name)
        if gone is not None:
            rows = rows.join(gone.withColumnRenamed("node_id", layout.key), layout.key, "left").filter(F.col("upto").isNull() | (F.col("seg") > F.col("upto")))
        return rows.select(*(c.split(" ")[0] for c in layout.schema.split(", ")))

    def _void(self, name: str) -> DataFrame | None:
        """(node_id, upto): rows of a node in runs before that are void."""
        runs = self.runs.get("void")
        if not runs:
            return None
        base = f"{self.durable.root}/void"
        rows = self.durable.spark.read.schema("node_id string, area string, seg int, run string").option("basePath", base).parquet(*(f"{base}/{r}" for r in runs))
        # the run that voids earlier rows of a node holds its new ones
        return rows.filter(F.col("area").isin("all", name)).groupBy("node_id").agg((F.max("seg") - 1).alias("upto"))

    @property
    def store(self) -> GraphStore:
        from ..operators.text import TextIndex

        return GraphStore(self.table("nodes"), self.table("types"), self.table("fields"), self.table("edges").drop("name", "stem"), self.table("contents"), TextIndex(self.table("postings"), self.table("lengths")), True)


class Durable:
    """A folder of versions. Data of a version stay until expire()."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Files(spark, self.root)

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.files.names("versions") if n.endswith(".json"))

    def open(self, version: int | None = None) -> Snapshot:
        """The newest version, or an earlier one; version 0 is empty."""
        known = self.versions()
        version = max(known, default=0) if version is None else version
        if version and version not in known:
            raise KeyError(f"no version {version}")
        return Snapshot(self, version, json.loads(self.files.read(f"versions/{version:08d}.json"))["runs"] if version else {})

    def commit(self, base: Snapshot, rows: dict[str, DataFrame], void: DataFrame | None = None, replace: bool = False) -> Snapshot:
        """base with rows added and the earlier rows of void (node_id, area: a table or `all`) gone,
        published as the next version. With replace, rows are all that there is."""
        version, run = base.version + 1, uuid.uuid4().hex
        here, made = f"seg={version}/run={run}", {}
        try:
            for name, df in [*rows.items(), *([("void", void)] if void is not None else [])]:
                folder = TABLES[name].folder if name in TABLES else None
                if name == "postings":
                    from ..operators.text import sorted_by_term

                    df = sorted_by_term(df)
                writer = df.write.partitionBy(folder) if folder else df.write
                writer.parquet(f"{self.root}/{name}/{here}")
                made[name] = here
            runs = {} if replace else {k: list(v) for k, v in base.runs.items()}
            for name in made:
                runs.setdefault(name, []).append(here)
            self._publish(version, runs)
        except BaseException:
            for name in made:
                self.files.delete(f"{name}/{here}")
            raise
        return Snapshot(self, version, runs)

    def _publish(self, version: int, runs: dict[str, Any]) -> None:
        if not self.files.publish(f"versions/{version:08d}.json", json.dumps({"runs": runs})):
            raise Conflict(f"version {version} is published already")

    def roll_back(self, version: int) -> Snapshot:
        """A new version that is as an earlier one was."""
        old, now = self.open(version), max(self.versions(), default=0)
        self._publish(now + 1, old.runs)
        return Snapshot(self, now + 1, old.runs)

    def compact(self, base: Snapshot | None = None) -> Snapshot:
        """The newest version with one run of each table and nothing void."""
        base = base or self.open()
        return self.commit(base, {name: base.table(name) for name in TABLES if base.runs.get(name)}, replace=True)

    def expire(self, keep: int = 1) -> list[int]:
        """Drop all but the newest versions, and the runs that only they have."""
        known = self.versions()
        old, new = known[: max(0, len(known) - keep)], known[max(0, len(known) - keep) :]
        held = {(t, r) for v in new for t, runs in self.open(v).runs.items() for r in runs}
        for t, r in {(t, r) for v in old for t, runs in self.open(v).runs.items() for r in runs} - held:
            self.files.delete(f"{t}/{r}")
        for v in old:
            self.files.delete(f"versions/{v:08d}.json")
        return old
