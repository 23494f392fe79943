"""State machines by key: the same steps over a stream, with state, time to live and timers, and over a batch.

A machine has a bounded state and a step for each row of a key, in order.  Over a stream the state lives in the state
store; an idle timer finishes what waits for a next row that may never come.  Over a batch rows are sorted by key
and order, and each task runs its keys one after another, so it holds one state, never a key's rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType, _parse_datatype_string

Rows = list[tuple]


class Machine:
    """start: the state of a new key, which JSON can hold; out: the columns of the tuples that step and finish return."""

    columns: tuple[str, ...] = ()
    out = ""

    def start(self) -> Any:
        raise NotImplementedError

    def step(self, state: Any, row: tuple) -> tuple[Any, Rows]:
        """The state after a row of columns, and what it gives out."""
        raise NotImplementedError

    def finish(self, state: Any) -> Rows:
        """What is given out when no further row comes."""
        return []


@dataclass
class Cache(Machine):
    """Entries by name with a time to live; at most `most`, of which the first put in goes first; failures aren't kept.

    A call hits if its entry is younger than ttl. A call that misses and succeeds puts its entry last; an old entry keeps its
    place until it is put in again or goes.
    """

    ttl: float = 600.0
    most: int = 100
    columns = ("call", "entry", "at", "ok")
    out = "call long, hit boolean, entries int, evicted int"

    def start(self):
        return {}

    def step(self, state, row):
        call, entry, at, ok = row
        hit, evicted = entry in state and at < state[entry], 0
        if not hit and ok:
            state.pop(entry, None)
            state[entry] = at + self.ttl
            while len(state) > self.most:
                del state[next(iter(state))]
                evicted += 1
        return state, [(call, hit, len(state), evicted)]


class Queue(Machine):
    """First in, first out, one job at a time: what starts when; kinds are submit, done and cancel.

    A cancelled job that waits holds its place and is passed over; cancelling takes the job submitted last among those that wait.
    """

    columns = ("seq", "kind")
    out = "seq long, started long, waiting int"

    def start(self):
        return {"running": None, "queue": []}

    def step(self, state, row):
        seq, kind = row
        started = None
        if kind == "submit":
            if state["running"] is None:
                state["running"] = started = seq
            else:
                state["queue"].append([seq, True])
        elif kind == "cancel":
            last = next((j for j in reversed(state["queue"]) if j[1]), None)
            if last:
                last[1] = False
        elif state["running"] is not None:
            state["running"] = None
            while state["queue"] and started is None:
                job, alive = state["queue"].pop(0)
                if alive:
                    state["running"] = started = job
        return state, [(seq, started, len(state["queue"]))]


@dataclass
class HoldBack(Machine):
    """Parts of a stream with a secret masked, even where parts cut it: as many characters as it has, less one, wait for the next part.

    The last part lets all out; a stream that is stopped drops what waits, as that can be most of a secret.
    """

    secret: str = ""
    columns = ("seq", "part", "ends")
    out = "seq long, part string"

    def start(self):
        return ["", None]

    def step(self, state, row):
        seq, part, ends = row
        held = state[0] + (part or "")
        if self.secret:
            held = held.replace(self.secret, "[REDACTED]")
        cut = len(held) if ends == "done" else max(0, len(held) - max(0, len(self.secret) - 1))
        return ["" if ends else held[cut:], seq], [(seq, held[:cut])]

    def finish(self, state):
        return [(state[1], state[0])] if state[0] else []


@dataclass
class Gate(Machine):
    """Calls of a service that keep a gap after one another; a call that must wait is dropped when a newer one comes first.

    After a failed call the service rests, and calls meanwhile are refused.  The call that waits is the whole queue.
    """

    gap: float = 1.0
    rest: float = 60.0
    columns = ("call", "at", "ok")
    out = "call long, outcome string, starts double"

    def start(self):
        return {"next": 0.0, "resume": 0.0, "waits": None}

    def _run(self, state):
        """Starts the waiting call."""
        call, begin, ok = state["waits"]
        state["waits"] = None
        if begin < state["resume"]:
            return (call, "refused", None)
        state["next"] = begin + self.gap
        if not ok:
            state["resume"] = begin + self.rest
        return (call, "called" if ok else "failed", begin)

    def step(self, state, row):
        call, at, ok = row
        out = []
        if state["waits"]:
            out.append(self._run(state) if state["waits"][1] <= at else (state["waits"][0], "stale", None))
            state["waits"] = None
        state["waits"] = [call, max(at, state["next"]), ok]
        return state, out

    def finish(self, state):
        return [self._run(state)] if state["waits"] else []


def over_batch(rows: DataFrame, key: str, order: str, machine: Machine) -> DataFrame:
    """(key, machine.out) of all rows, a key's in order; rows without a key are one key of their own."""
    out = f"`{key}` {rows.schema[key].dataType.simpleString()}, {machine.out}"
    schema = _arrow(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, any_yet = None, None, False
        for batch in batches:
            made = []
            for k, *row in zip(*(batch.column(c).to_pylist() for c in (key, *machine.columns))):
                if not any_yet or k != now:
                    if any_yet:
                        made += [(now, *r) for r in machine.finish(state)]
                    now, state, any_yet = k, machine.start(), True
                state, found = machine.step(state, tuple(row))
                made += [(k, *r) for r in found]
            yield _batch(made, schema)
        if any_yet:
            yield _batch([(now, *r) for r in machine.finish(state)], schema)

    return rows.select(key, order, *[c for c in machine.columns if c != order]).repartition(key).sortWithinPartitions(key, order).mapInArrow(run, out)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(_parse_datatype_string(ddl))


def _batch(rows: Rows, schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


class _Processor(StatefulProcessor):
    """A machine over a stream: its state as JSON in the state store, dropped after ttl; idle keys are finished by a timer."""

    def __init__(self, machine: Machine, order: str, ttl_ms: int | None, idle_ms: int | None):
        self.machine, self.order, self.ttl_ms, self.idle_ms = machine, order, ttl_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names = [f.split()[0] for f in self.machine.out.split(", ")]
        self.state = handle.getValueState("state", StructType([StructField("json", StringType())]), self.ttl_ms)

    def _frame(self, key, rows: Rows) -> pd.DataFrame:
        return pd.DataFrame([(*key, *r) for r in rows], columns=["key", *self.names], dtype=object)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(self.order)
        state = json.loads(self.state.get()[0]) if self.state.exists() else self.machine.start()
        out: Rows = []
        for row in zip(*(frame[c].tolist() for c in self.machine.columns)):
            state, found = self.machine.step(state, row)
            out += found
        self.state.update((json.dumps(state),))
        if self.idle_ms is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = self.machine.finish(json.loads(self.state.get()[0])) if self.state.exists() else []
        self.state.clear()
        yield self._frame(key, out)

    def close(self) -> None:
        pass


#: Conf under which a stream's keyed state is kept.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def over_stream(rows: DataFrame, key: str, order: str, machine: Machine, ttl_ms: int | None = None, idle_ms: int | None = None) -> DataFrame:
    """(key, machine.out) of a stream; each micro-batch holds rows that come after those before it in a key's order.

    ttl_ms: a key's state is forgotten so long after its last row; idle_ms: a key without rows for so long is finished and forgotten.
    The session must keep state in RocksDB, see STORE.
    """
    kind = rows.schema[key].dataType.simpleString()
    mode = "processingTime" if ttl_ms is not None or idle_ms is not None else "none"
    used = rows.select(key, order, *[c for c in machine.columns if c != order])
    out = used.groupBy(key).transformWithStateInPandas(_Processor(machine, order, ttl_ms, idle_ms), f"key {kind}, {machine.out}", "Append", mode)
    return out.withColumnRenamed("key", key)
