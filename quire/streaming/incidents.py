"""Incidents from a stream of events: counts of repeats, and their life from the first report to the end in keyed state."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from quire.operators.records import open_incidents

#: The state store that keyed state needs; set it on the session before a stateful stream starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
DAY_MS, HOUR_MS = 86_400_000, 3_600_000


def run_available(spark: SparkSession, source: str, schema, out: str, checkpoint: str, delay: str = "1 day", pattern: str | None = None) -> DataFrame:
    """Fold all events now under ``source`` into open incidents and return the state. [X1]

    Each micro-batch upserts changed incidents to a folder of its own; the newest row of an incident counts, so a batch that runs again
    after a failure changes nothing. Days that lie ``delay`` behind the newest event leave the state.
    """
    options = {"pathGlobFilter": pattern} if pattern else {}
    events = spark.readStream.schema(schema).options(**options).parquet(source).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)

    def upsert(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    query = open_incidents(events).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(upsert).start()
    query.awaitTermination()
    state = spark.read.parquet(out)
    newest = state.groupBy("user_id", "event_type", "day").agg(F.max(F.struct("n", "last_ts")).alias("m"))
    return newest.select("user_id", "event_type", "day", "m.n", "m.last_ts")


# ---------------------------------------------------------------- the life of an incident

#: What the stream of ``lifecycle`` reads; action is add or close, and a close names an incident.
EVENT = "work string, event_id string, ts timestamp, action string, kind string, stage string, what string, source string, incident string, status string, why string, fix string, evidence string"
#: What it writes: one row for each change of an incident, the last (highest seq) of a work's incident is its state; a refused event has a problem and no incident.
CHANGE = "work string, seq long, id string, signature string, kind string, stage string, what string, source string, status string, count long, ts timestamp, last_ts timestamp, why string, fix string, evidence string, event_id string, problem string"
_OPEN = "kind string, stage string, what string, source string, signature string, count long, ts timestamp, last_ts timestamp"


def incident_signature(kind: Column, stage: Column, what: Column) -> Column:
    """A key under which repeats of an incident meet: quotations, paths and numbers are blanked, white space is collapsed. [A10, T21]"""
    text = F.lower(F.coalesce(what, F.lit("")))
    for pattern, put in ((r"[\"'«»“”].*?[\"'«»“”]", "‹q›"), (r"\S*/\S*", "‹path›"), (r"[0-9]+", "N"), (r"\s+", " ")):
        text = F.regexp_replace(text, pattern, put)
    return F.concat_ws("|", kind, F.coalesce(stage, F.lit("other")), F.substring(F.trim(text), 1, 120))


class _Held:
    """A map of the state as one batch sees it: each key is read once, and those that changed are written at the end (a call of the state costs far more than an event). Keys that no event asks for are never read."""

    def __init__(self, state):
        self.state, self.values, self.changed = state, {}, {}
        self.empty = not state.exists()

    def get(self, name: str) -> tuple | None:
        if name not in self.values:
            there = not self.empty and self.state.containsKey((name,))
            self.values[name] = tuple(self.state.getValue((name,))) if there else None
        return self.values[name]

    def set(self, name: str, value: tuple | None) -> None:
        self.values[name] = self.changed[name] = value

    def put(self) -> None:
        for name, value in self.changed.items():
            if value is not None:
                self.state.updateValue((name,), value)
            elif not self.empty and self.state.containsKey((name,)):
                self.state.removeKey((name,))


class Lifecycle(StatefulProcessor):
    """The incidents of one work.

    State: open incidents by id, the id of the open automatic incident of a signature, ids given per day, and the event ids of the
    last days, by hour. A batch reads what it asks of the state once and writes what it changed once, at its end. Closed incidents leave it at once; event ids and days leave it by a timer when the watermark has passed them, after
    which an event of that time would come too late anyway. So the state holds what is open, and what the watermark's delay spans.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seq = handle.getValueState("seq", "n long")
        self.open = handle.getMapState("open", "id string", _OPEN)
        self.by_signature = handle.getMapState("by_signature", "signature string", "id string")
        self.given = handle.getMapState("given", "day string", "n long")
        self.seen = handle.getMapState("seen", "hour long", "ids array<string>")
        self.names = [x.split()[0] for x in CHANGE.split(", ")]
        self.row = Row(*self.names)

    def _change(self, key, **values) -> Row:
        self.n += 1
        return self.row(*[{"work": key[0], "seq": self.n, **values}.get(c) for c in self.names])

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803 (Spark's names)
        self.n = self.seq.get()[0] if self.seq.exists() else 0
        is_open, by_signature, given = (_Held(x) for x in (self.open, self.by_signature, self.given))
        # an id counts once whatever its time, so all hours are read
        hours = {k[0]: list(v[0]) for k, v in self.seen.iterator()}
        known, changed = {x for ids in hours.values() for x in ids}, set()
        for r in sorted(rows, key=lambda r: (r.ts, r.event_id or "")):
            ms = int(r.ts.replace(tzinfo=r.ts.tzinfo or timezone.utc).timestamp() * 1000)
            if r.event_id is not None:
                if r.event_id in known:
                    continue
                known.add(r.event_id)
                hours.setdefault(ms // HOUR_MS, []).append(r.event_id)
                changed.add(ms // HOUR_MS)
            if r.problem:
                yield self._change(key, event_id=r.event_id, problem=r.problem, ts=r.ts)
            elif r.action == "close":
                yield self._close(key, r, is_open, by_signature)
            else:
                yield self._add(key, r, is_open, by_signature, given)
        for hour in sorted(changed):
            self.seen.updateValue((hour,), (hours[hour],))
        for day in {hour * HOUR_MS // DAY_MS for hour in changed}:
            self.handle.registerTimer((day + 1) * DAY_MS)
        for held in (is_open, by_signature, given):
            held.put()
        self.seq.update((self.n,))

    def _add(self, key, r: Row, is_open: _Held, by_signature: _Held, given: _Held) -> Row:
        named = by_signature.get(r.signature) if r.source == "auto" else None
        if named is not None:
            name = named[0]
            was = is_open.get(name)
            now = (*was[:5], was[5] + 1, was[6], r.ts)
        else:
            day = f"{r.ts:%Y-%m-%d}"
            n = (given.get(day) or (0,))[0] + 1
            given.set(day, (n,))
            name = f"pc-{day}-{n}"
            now = (r.kind, r.stage, r.what, r.source, r.signature, 1, r.ts, r.ts)
            if r.source == "auto":
                by_signature.set(r.signature, (name,))
        is_open.set(name, now)
        fields = dict(zip(("kind", "stage", "what", "source", "signature", "count", "ts", "last_ts"), now, strict=True))
        return self._change(key, id=name, status="open", event_id=r.event_id, why=r.why, fix=r.fix, **fields)

    def _close(self, key, r: Row, is_open: _Held, by_signature: _Held) -> Row:
        was = is_open.get(r.incident) if r.incident is not None else None
        if was is None:
            return self._change(key, event_id=r.event_id, ts=r.ts, problem=f"no open incident {r.incident}")
        fields = dict(zip(("kind", "stage", "what", "source", "signature", "count", "ts", "last_ts"), was, strict=True))
        ended = (r.status or "open") != "open"
        if ended:
            is_open.set(r.incident, None)
            if (by_signature.get(was[4]) or (None,))[0] == r.incident:
                by_signature.set(was[4], None)
        return self._change(key, id=r.incident, status=r.status or "open", event_id=r.event_id, why=r.why, fix=r.fix, evidence=r.evidence, **fields)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        end = expiredTimerInfo.getExpiryTimeInMs()
        for (hour,) in list(self.seen.keys()):
            if hour * HOUR_MS < end:
                self.seen.removeKey((hour,))
        last = f"{datetime.fromtimestamp(end / 1000, timezone.utc):%Y-%m-%d}"
        for (day,) in list(self.given.keys()):
            if day < last:
                self.given.removeKey((day,))
        return iter(())

    def close(self) -> None:
        pass


def lifecycle(events: DataFrame, delay: str = "1 day", tool: str = "tool") -> DataFrame:
    """The changes (CHANGE) that a stream of events (EVENT) makes. [X1]

    An automatic event whose signature is open in its work raises that incident's count and its last time; every other one opens an incident ``pc-day-n``. A close
    sets the status, cause, target and evidence of an open incident and, unless the status is open, ends it, so that the next event of its signature
    opens a new one. Events against the schema (kinds, stages, statuses, targets; closed without a cause, promoted without a target) and closes of
    unknown incidents change nothing and come out with their problem. An event id counts once; events behind the watermark by ``delay`` are dropped by Spark. The
    session's time zone must be UTC, in which days are counted. A task sorts a work's events of one batch: bound batches by ``maxFilesPerTrigger`` and the like.
    """
    from quire.operators.gates import INCIDENT_KINDS, STAGES, STATUSES

    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    c = F.col
    route = rf"^(work-readme|house-style|agents-md|harness|skill:[\w.-]+|{tool}:[\w.]+)$"
    add, status = F.coalesce(c("action"), F.lit("add")) == "add", F.coalesce(c("status"), F.lit("open"))
    problem = (
        F.when(add & blank(c("kind")), "missing kind").when(add & blank(c("what")), "missing what").when(add & ~c("kind").isin(*INCIDENT_KINDS), "kind")
        .when(~F.coalesce(c("stage"), F.lit("other")).isin(*STAGES), "stage").when(~status.isin(*STATUSES), "status").when(~blank(c("fix")) & ~c("fix").rlike(route), "fix is no target")
        .when(status.isin("fixed-here", "promoted") & blank(c("why")), "closed without why").when((status == "promoted") & blank(c("fix")), "promoted without fix")
    )
    rows = events.withColumns({
        "problem": problem, "stage": F.coalesce("stage", F.lit("other")), "source": F.coalesce("source", F.lit("human")), "signature": incident_signature(c("kind"), c("stage"), c("what")),
    }).withWatermark("ts", delay)
    return rows.groupBy("work").transformWithState(Lifecycle(), StructType.fromDDL(CHANGE), outputMode="Update", timeMode="EventTime")


def run_lifecycle(events: DataFrame, out: str, checkpoint: str, delay: str = "1 day", tool: str = "tool"):
    """Run ``lifecycle`` over all events that are there now, and return the progress of its batches; changes go to a folder for each batch, which a batch that runs again replaces."""
    spark = events.sparkSession
    spark.conf.set(*STATE_STORE)

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    query = lifecycle(events, delay, tool).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    return query.recentProgress


def incidents(changes: DataFrame) -> DataFrame:
    """The state of every incident after its last change."""
    rows = changes.where("id is not null")
    names = [c for c in rows.columns if c not in ("work", "id", "problem", "event_id")]
    last = rows.groupBy("work", "id").agg(F.max(F.struct("seq", *[c for c in names if c != "seq"])).alias("m"))
    return last.select("work", "id", *[F.col(f"m.{c}").alias(c) for c in names])


# ---------------------------------------------------------------- runs

RESULT = "fixture string, label string, sample int, ts timestamp, error string"
ATTEMPT = "fixture string, label string, sample int, attempts int, state string, error string"


class RunLog(StatefulProcessor):
    """The attempts of one run: an error asks for another, up to ``most``; a run that is done stays so. Its state goes ``forget_ms`` after its last change."""

    def __init__(self, most: int, forget_ms: int):
        self.most, self.forget_ms = most, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "attempts int, done boolean", self.forget_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        attempts, done = self.state.get() if self.state.exists() else (0, False)
        error = None
        for r in sorted(rows, key=lambda r: r.ts):
            if done:
                break
            attempts, error = attempts + 1, r.error
            done = not r.error
        self.state.update((attempts, done))
        state = "done" if done else "retry" if attempts < self.most else "failed"
        names = [x.split()[0] for x in ATTEMPT.split(", ")]
        yield Row(*names)(*key, attempts, state, None if done else error)

    def close(self) -> None:
        pass


def run_log(results: DataFrame, most: int = 3, forget_days: int = 30) -> DataFrame:
    """What a stream of results (RESULT) says of each run: done, retry (it ended in an error and is asked for again) or failed (``most`` errors). [X2]

    Finished runs are forgotten by the clock, so the query wakes up without new results too: give it a trigger of some minutes, or ``once``,
    not ``availableNow``, which would not end.
    """
    processor = RunLog(most, forget_days * DAY_MS)
    return results.groupBy("fixture", "label", "sample").transformWithState(processor, StructType.fromDDL(ATTEMPT), outputMode="Update", timeMode="ProcessingTime")
