"""Streams of incidents and of results: state, late and repeated events, restarts."""

from collections import namedtuple
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quire.streaming import incidents

T0 = datetime(2024, 3, 1, 10)
NAMES = [x.split()[0] for x in incidents.EVENT.split(", ")]


def event(work, event_id, minutes, what="", action="add", kind="tool-error", source="auto", **more):
    given = {"work": work, "event_id": event_id, "ts": T0 + timedelta(minutes=minutes), "action": action, "kind": kind, "what": what, "source": source, "stage": "read", **more}
    return tuple(given.get(n) for n in NAMES)


@pytest.fixture
def files(spark, tmp_path):
    def put(name, rows):
        spark.createDataFrame(rows, incidents.EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def stream():
        return spark.readStream.schema(incidents.EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    return put, stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")


def state_of(spark, out):
    return {(r.work, r.id): r for r in incidents.incidents(spark.read.parquet(out)).collect()}


def test_incident_life(spark, files):
    put, stream, out, checkpoint = files
    put("a", [
        event("w", "e1", 0, 'page 12 of "x" in a/b.md failed'), event("w", "e2", 5, "page 13 of 'y z' in c/d.md failed"), event("w", "e3", 6, "other", source="human"), event("w", "e4", 7, "other", source="human"),
        event("v", "e5", 1, "page 12 of «q» in a/b failed"), event("w", "e6", 8, "bad", kind="nothing"), event("w", "e2", 5, "page 13 of 'y z' in c/d.md failed"), event("w", "e7", 9, "  "),
    ])
    incidents.run_lifecycle(stream(), out, checkpoint)
    got = state_of(spark, out)
    assert {(k, r["count"], r.status, r.source) for k, r in got.items()} == {(("w", "pc-2024-03-01-1"), 2, "open", "auto"), (("w", "pc-2024-03-01-2"), 1, "open", "human"), (("w", "pc-2024-03-01-3"), 1, "open", "human"), (("v", "pc-2024-03-01-1"), 1, "open", "auto")}
    assert got["w", "pc-2024-03-01-1"].signature == "tool-error|read|page N of ‹q› in ‹path› failed"
    refused = {(r.event_id, r.problem) for r in spark.read.parquet(out).where("problem is not null").collect()}
    assert refused == {("e6", "kind"), ("e7", "missing what")}
    # a second run goes on from the state: repeats of an event id don't count, a close ends the incident, and the next event opens another
    put("b", [
        event("w", "e1", 0, 'page 12 of "x" in a/b.md failed'), event("w", "f1", 20, action="close", incident="pc-2024-03-01-1", status="promoted", why="cause"), event("w", "f2", 21, action="close", incident="pc-2024-03-01-1", status="promoted", why="cause", fix="skill:read", evidence="replay"),
        event("w", "f3", 22, "page 1 of 'z' in a/b.md failed"), event("w", "f4", 23, action="close", incident="pc-2024-03-01-9", status="wontfix"), event("w", "f5", 24, action="close", incident="pc-2024-03-01-3", status="open", why="cause found"),
        event("w", "f6", 25, action="close", incident="pc-2024-03-01-1", status="wontfix"),
    ])
    incidents.run_lifecycle(stream(), out, checkpoint)
    got = state_of(spark, out)
    first = got["w", "pc-2024-03-01-1"]
    assert (first["count"], first.status, first.why, first.fix, first.evidence) == (2, "promoted", "cause", "skill:read", "replay")
    assert (got["w", "pc-2024-03-01-4"]["count"], got["w", "pc-2024-03-01-4"].status) == (1, "open") and got["w", "pc-2024-03-01-3"].why == "cause found"
    refused = {(r.event_id, r.problem) for r in spark.read.parquet(out).where("problem is not null").collect()}
    assert refused >= {("f1", "promoted without fix"), ("f4", "no open incident pc-2024-03-01-9"), ("f6", "no open incident pc-2024-03-01-1")}


def test_late_events_are_dropped_and_state_stays_small(spark, files):
    put, stream, out, checkpoint = files
    day = 24 * 60
    for d in range(6):
        put(str(d), [event("w", f"d{d}-{i}", d * day + i, "seen again", source="auto") for i in range(20)])
    incidents.run_lifecycle(stream(), out, checkpoint, delay="1 hour")
    put("late", [event("w", "late", 30, "seen again")])
    put("next", [event("w", "next", 7 * day, "seen again")])
    progress = incidents.run_lifecycle(stream(), out, checkpoint, delay="1 hour")
    only = state_of(spark, out)["w", "pc-2024-03-01-1"]
    assert only["count"] == 121 and only.last_ts == T0 + timedelta(days=7)
    kept = spark.read.format("statestore").option("stateVarName", "seen").load(checkpoint)
    assert 1 <= kept.count() <= 21
    days = spark.read.format("statestore").option("stateVarName", "given").load(checkpoint)
    assert days.count() <= 1
    assert sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in progress) == 1


def test_run_log(spark, tmp_path):
    schema, (out, checkpoint) = incidents.RESULT, (str(tmp_path / "out"), str(tmp_path / "c"))
    spark.conf.set(*incidents.STATE_STORE)

    def run(rows):
        spark.createDataFrame([(f, "a", 1, T0 + timedelta(minutes=m), e) for f, m, e in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        keep = lambda b, epoch: b.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        incidents.run_log(stream).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(once=True).foreachBatch(keep).start().awaitTermination()
        last = spark.read.parquet(out).groupBy("fixture").agg(F.max_by(F.struct("attempts", "state", "error"), "epoch").alias("x"))
        return {r.fixture: tuple(r.x) for r in last.collect()}

    assert run([("x", 1, "boom"), ("y", 1, None), ("z", 1, "a"), ("z", 2, "b")]) == {"x": (1, "retry", "boom"), "y": (1, "done", None), "z": (2, "retry", "b")}
    assert run([("x", 5, None), ("y", 6, "too late"), ("z", 7, "c")]) == {"x": (2, "done", None), "y": (1, "done", None), "z": (3, "failed", "c")}


def test_a_batch_asks_the_state_once():
    """Calls of the state for a batch of 500 events of one signature: as many as there are keys, not as there are events."""
    calls = []

    class Kept:
        def __init__(self):
            self.kept = {}

        def __getattr__(self, name):
            calls.append(name)
            return {"exists": lambda: bool(self.kept), "containsKey": self.kept.__contains__, "getValue": self.kept.get, "updateValue": self.kept.__setitem__, "iterator": self.kept.items, "update": lambda v: self.kept.update(value=v)}[name]

    class Handle:
        def __getattr__(self, name):
            calls.append(name)
            return lambda *a: Kept()

    life = incidents.Lifecycle()
    life.init(Handle())
    Event = namedtuple("Event", "ts event_id problem action source signature kind stage what why fix")
    rows = [Event(T0 + timedelta(seconds=k), f"e{k % 500}", None, "add", "auto", "s", "tool-error", "read", "x", None, None) for k in range(600)]
    out = list(life.handleInputRows(("w",), iter(rows), None))
    assert len(out) == 500 and (out[-1]["id"], out[-1]["count"], out[-1]["seq"]) == ("pc-2024-03-01-1", 500, 500)
    assert len(calls) < 30
