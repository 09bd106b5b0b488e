"""Streams that are killed and go on: nothing is lost, nothing comes twice."""

import json
import time

import pytest

from graphloom.operators.vector import Provider
from graphloom.streaming import stateful


def rows(spark, path):
    try:
        return spark.read.parquet(path).collect()
    except Exception:
        return []


def until(check, seconds=120):
    end = time.time() + seconds
    while time.time() < end:
        if check():
            return
        time.sleep(0.5)
    raise AssertionError("not in time")


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def put(folder, name, some):
    draft = folder.parent / f"{name}.draft"
    draft.write_text("\n".join(map(json.dumps, some)))
    draft.rename(folder / name)


def test_queue_goes_on_after_a_kill(spark, tmp_path):
    (source := tmp_path / "in").mkdir()
    (broken := tmp_path / "broken").write_text("")

    def embed(texts):
        import os

        if os.path.exists(broken) or any("poison" in t for t in texts):
            raise RuntimeError("provider is down")
        return [[float(len(t)), 1.0] for t in texts]

    def start():
        chunks = spark.readStream.schema("chunk_id string, content string").json(str(source))
        return stateful.written_to(stateful.worked_off(chunks, Provider(embed, 2), most=3, retry_ms=60_000 if broken.exists() else 500, batch=4, parts=2), str(tmp_path / "out"), str(tmp_path / "checkpoint"), "200 milliseconds")

    put(source, "a.json", [{"chunk_id": f"c{i}", "content": "x" * i} for i in range(10)])
    query = start()
    until(lambda: query.lastProgress and query.lastProgress["numInputRows"] >= 0 and any(p["numInputRows"] for p in query.recentProgress))
    query.stop()  # all wait for their second attempt
    assert not [r for r in rows(spark, str(tmp_path / "out"))]
    broken.unlink()
    put(source, "b.json", [{"chunk_id": f"d{i}", "content": "y"} for i in range(3)] + [{"chunk_id": "c3", "content": "newer"}])
    put(source, "e.json", [{"chunk_id": "p", "content": "poison"}])
    query = start()
    try:
        # those that waited have a minute to go, but new chunks of their part take them along
        until(lambda: {r["chunk_id"] for r in rows(spark, str(tmp_path / "out"))} >= {"d0", "d1", "d2", "c3"})
    finally:
        query.stop()
    put(source, "f.json", [{"chunk_id": f"w{i}", "content": "wake"} for i in range(8)])
    query = start()
    try:
        until(lambda: len(rows(spark, str(tmp_path / "out"))) == 10 + 3 + 1 + 8)
    finally:
        query.stop()
    got = rows(spark, str(tmp_path / "out"))
    by = {r["chunk_id"]: r for r in got}
    assert len(by) == len(got)
    failed = {c for c, r in by.items() if r["status"] == "failed"}
    assert "p" in failed and by["p"]["attempts"] == 3 and by["p"]["error"] == "provider is down"
    assert len(failed) <= 4 and all(r["embedding"] is None for r in got if r["status"] == "failed")  # at most its batch
    for c, r in by.items():
        if c not in failed:
            assert r["status"] == "done" and r["embedding"][0] == {"c": 5 if c == "c3" else int(c[1:]), "d": 1, "w": 4}[c[0]]


def test_last_event_after_a_quiet_time(spark, tmp_path):
    (source := tmp_path / "in").mkdir()

    def start():
        events = spark.readStream.schema("path string, mtime string, raw string").json(str(source))
        return stateful.written_to(stateful.settled(events, 3_000), str(tmp_path / "out"), str(tmp_path / "checkpoint"), "200 milliseconds")

    event = lambda p, second, raw: {"path": p, "mtime": f"2020-01-01 00:00:{second:02d}", "raw": raw}
    put(source, "1.json", [event("a", 1, "a1"), event("a", 3, "a3"), event("b", 1, "b1"), event("a", 2, "a2")])
    query = start()
    until(lambda: any(p["numInputRows"] for p in query.recentProgress))
    query.stop()  # within the quiet time
    put(source, "2.json", [event("a", 4, "a4")])
    query = start()
    try:
        until(lambda: len(rows(spark, str(tmp_path / "out"))) >= 2)
        time.sleep(3)
    finally:
        query.stop()
    assert {(r["path"], r["raw"]) for r in rows(spark, str(tmp_path / "out"))} >= {("a", "a4"), ("b", "b1")}
    assert len(rows(spark, str(tmp_path / "out"))) == 2 or ("a", "a3") in {(r["path"], r["raw"]) for r in rows(spark, str(tmp_path / "out"))}
