"""Turns and calls of sessions that go on, kept up to date by state: what any split of a log into batches ends with is what the whole log gives."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lorekeep.operators.session import opens_turn
from lorekeep.sources.growing import register
from lorekeep.sources.sessions import events

#: uuids that a file's state remembers, and milliseconds without events after which a session's state goes.
SEEN, IDLE_MS = 4096, 24 * 3_600_000
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "path string, kind string, turn long, idx long, at int, call_id string, name string, prompt string, started_us long, ended_us long, n_events long, n_calls long, called_us long, answered_us long, content string, is_error boolean, pending boolean"
_COLUMNS = [c.split()[0] for c in OUT.split(", ")]


def tail(spark: SparkSession, folder: str, from_start: bool = True) -> DataFrame:
    """The events of growing files under a folder as a stream; `idx` is a line's first byte. Lines that are no event are skipped."""
    register(spark)
    lines = spark.readStream.format("growing_lines").option("from_start", str(from_start).lower()).load(folder)
    told = events(lines.select("path", F.col("offset").alias("idx"), "line"), keep_invalid=True)
    return told.where("problem is null").drop("problem")


def tail_lines(spark: SparkSession, folder: str, from_start: bool = True) -> DataFrame:
    """path, offset, line, rewritten, uuid of growing files as a stream."""
    register(spark)
    lines = spark.readStream.format("growing_lines").option("from_start", str(from_start).lower()).load(folder)
    return lines.withColumn("uuid", F.get_json_object("line", "$.uuid"))


class _Once(StatefulProcessor):
    """Passes on lines whose uuid is not among the last SEEN of the file; a rewritten file forgets them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "uuids array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # a batch has a rewritten file from its start, or only what is behind the lines before
        frame = pd.concat(list(rows)).sort_values("offset")
        held = dict.fromkeys([] if frame["rewritten"].any() or not self.seen.exists() else self.seen.get()[0])
        keep = []
        for uuid in frame["uuid"]:
            new = uuid is None or uuid not in held
            keep.append(new)
            if new and uuid is not None:
                held[uuid] = None
                if len(held) > SEEN:
                    del held[next(iter(held))]
        self.seen.update((list(held),))
        yield frame[keep][["path", "offset", "line", "uuid"]].astype({"path": object, "line": object, "uuid": object})

    def close(self) -> None:
        pass


def once(lines: DataFrame) -> DataFrame:
    """Lines (path, offset, line, rewritten, uuid) without repeats of a uuid within a file; those without one all pass."""
    lines.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return lines.groupBy("path").transformWithStateInPandas(statefulProcessor=_Once(), outputStructType="path string, offset bigint, line string, uuid string", outputMode="Append", timeMode="None")


class _Lift(StatefulProcessor):
    """Holds a session's open turn, and its calls by id with their uses and last result."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turn = handle.getValueState("turn", "held string")
        self.calls = handle.getMapState("calls", "call_id string", "held string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        path = key[0]
        t = json.loads(self.turn.get()[0]) if self.turn.exists() else {"last": -1, "opened": 0, "first": None}
        touched: dict[str, dict] = {}
        out = []

        def held(call_id: str) -> dict:
            if call_id not in touched:
                touched[call_id] = json.loads(self.calls.getValue((call_id,))[0]) if self.calls.containsKey((call_id,)) else {"uses": [], "result": None}
            return touched[call_id]

        def turn_row() -> dict:
            return {"path": path, "kind": "turn", "turn": t["turn"], "prompt": t["prompt"], "started_us": t["started"], "ended_us": t["ended"], "n_events": t["n"], "n_calls": t["calls"]}

        for e in pd.concat(list(rows)).sort_values("idx").itertuples():
            if e.idx <= t["last"]:  # delivered before
                continue
            opens = bool(e.opens)
            us = None if pd.isna(e.us) else int(e.us)
            t["first"] = int(opens) if t["first"] is None else t["first"]
            t["opened"] += opens
            if opens or t["last"] < 0:
                if t["last"] >= 0:
                    out.append(turn_row())
                t |= {"turn": t["opened"] - t["first"], "prompt": e.text if opens else "", "started": None, "ended": None, "n": 0, "calls": 0}
            t["last"] = int(e.idx)
            t["n"] += 1
            t["calls"] += len(e.call_ids)
            t["started"], t["ended"] = us if t["started"] is None else t["started"], t["ended"] if us is None else us
            for at, (call_id, name) in enumerate(zip(e.call_ids, e.names)):
                held(call_id)["uses"].append([t["turn"], int(e.idx), at, name, us])
            for call_id, content, error in zip(e.result_ids, e.contents, e.errors):
                held(call_id)["result"] = [us, content, bool(error)]
        if "turn" not in t:
            return
        out.append(turn_row())
        for call_id, c in touched.items():
            self.calls.updateValue((call_id,), (json.dumps(c),))
            done = c["result"] or [None, None, False]
            out += [{"path": path, "kind": "call", "turn": u[0], "idx": u[1], "at": u[2], "call_id": call_id, "name": u[3], "called_us": u[4], "answered_us": done[0], "content": done[1], "is_error": done[2], "pending": c["result"] is None} for u in c["uses"]]
        self.turn.update((json.dumps(t),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        frame = pd.DataFrame(out).reindex(columns=_COLUMNS)
        text = ("path", "kind", "call_id", "name", "prompt", "content", "is_error", "pending")
        yield frame.astype({c: object if c in text else "Int64" for c in _COLUMNS})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.turn.clear()
        self.calls.clear()
        return iter(())

    def close(self) -> None:
        pass


def lifted(stream: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """Updates of turns (kind `turn`, by path and turn) and calls (kind `call`, by path, idx and at) of a stream of events.

    Events of a session come in the order of `idx`, in any batches; one that is not behind the last is a repeat and is
    dropped. Turns before the open one are final. A result that comes late, or again, changes its call. A session
    without events for so many milliseconds is forgotten; it goes on as a new one.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    of = lambda column, field: F.transform(column, lambda x: x[field])
    rows = stream.select("path", "idx", F.unix_micros("ts").alias("us"), opens_turn().alias("opens"), "text", of("calls", "id").alias("call_ids"), of("calls", "name").alias("names"), of("results", "tool_use_id").alias("result_ids"), of("results", "content").alias("contents"), of("results", "is_error").alias("errors"))
    return rows.groupBy("path").transformWithStateInPandas(statefulProcessor=_Lift(idle_ms), outputStructType=OUT, outputMode="Update", timeMode="ProcessingTime")


def turns(table: DataFrame) -> DataFrame:
    """path, turn, prompt, started_at, ended_at, n_events, n_calls of the last updates."""
    at = lambda c: F.timestamp_micros(c)
    return table.where("kind = 'turn'").select("path", "turn", "prompt", at("started_us").alias("started_at"), at("ended_us").alias("ended_at"), "n_events", "n_calls")


def calls(table: DataFrame) -> DataFrame:
    """path, turn, idx, at, call_id, name, latency_ms, content, is_error, pending of the last updates."""
    ms = F.bround((F.col("answered_us") - F.col("called_us")) / 1000).cast("long")
    return table.where("kind = 'call'").select("path", "turn", "idx", "at", "call_id", "name", ms.alias("latency_ms"), "content", "is_error", "pending")
