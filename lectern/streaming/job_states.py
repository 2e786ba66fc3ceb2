"""Live states of jobs: a keyed state machine over a stream of partial updates, and claims of exclusive slots.

The stream needs Spark's RocksDB state store (spark.sql.streaming.stateStore.providerClass), as transformWithState does.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lectern.plans.status import ACTIVE, INTERRUPTED, MESSAGES

#: An event: `slot` is the key, `at` its order there. kind is start, update, stop or finish; the rest may be null.
EVENT = "slot string, at long, kind string, project string, phase string, message string, fraction double, completed long, total long, speed double, eta double, state string"
SNAPSHOT = "state string, phase string, message string, fraction double, completed long, total long, speed double, eta double, project string, started_at long, updated_at long"
FIELDS = [x.split()[0] for x in SNAPSHOT.split(", ")]
IDLE = dict.fromkeys(FIELDS) | {"state": "idle", "phase": "idle", "message": MESSAGES["idle"], "fraction": 0.0, "completed": 0, "total": 0}


def _known(x) -> bool:
    return x is not None and x == x


def merged(snapshot: dict, event: dict) -> dict:
    """The snapshot with the fields that the event has; the fraction is cut to 0 to 1, counts to 0 and more."""
    new = {k: event[k] for k in ("phase", "message", "speed", "eta") if _known(event[k])}
    if _known(event["fraction"]):
        new["fraction"] = max(0.0, min(1.0, float(event["fraction"])))
    new |= {k: max(0, int(event[k])) for k in ("completed", "total") if _known(event[k])}
    return snapshot | new | {"updated_at": int(event["at"])}


def advanced(snapshot: dict, event: dict) -> tuple[dict, bool]:
    """The snapshot after an event, and whether the event counted.

    A start counts where no job is active, and a stop where one is; updates and finishes always do. An event without a
    kind of these four, and a finish without an end state, change nothing.
    """
    kind, active = event["kind"], snapshot["state"] in ACTIVE
    if kind == "start" and not active:
        return IDLE | {"state": "running", "phase": "starting", "message": MESSAGES["starting"], "project": event["project"], "started_at": int(event["at"]), "updated_at": int(event["at"])}, True
    if kind == "update":
        return merged(snapshot, event), True
    if kind == "stop" and active:
        return snapshot | {"state": "stopping", "phase": "stopping", "message": MESSAGES["stopping"], "eta": None, "updated_at": int(event["at"])}, True
    if kind == "finish" and event["state"] in MESSAGES and event["state"] not in ACTIVE:
        done = {"state": event["state"], "phase": event["state"], "message": event["message"] if _known(event["message"]) else MESSAGES[event["state"]], "eta": None}
        return merged(snapshot, event | {"message": None, "phase": None, "eta": None}) | done, True
    return snapshot, False


def restarted(snapshot: dict) -> dict:
    """What is left of a job whose process has ended: an active one is interrupted and has no estimate any more."""
    return snapshot | (INTERRUPTED if snapshot["state"] in ACTIVE else {})


class _Machine(StatefulProcessor):
    """One slot's snapshot as state; `at` beyond the last event's moves it on, others came too late and are left out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("snapshot", SNAPSHOT)

    def handleInitialState(self, key: tuple, initial: pd.DataFrame, timer) -> None:
        rows = initial.sort_values("updated_at", na_position="first").astype(object)
        last = rows.where(rows.notna(), None).iloc[-1]
        self._put(restarted(IDLE | {k: last[k] for k in FIELDS if k in last and last[k] is not None}))

    def _get(self) -> dict:
        return dict(zip(FIELDS, self.value.get())) if self.value.exists() else dict(IDLE)

    def _put(self, snapshot: dict) -> None:
        whole = ("completed", "total", "started_at", "updated_at")
        self.value.update(tuple(int(snapshot[k]) if k in whole and snapshot[k] is not None else snapshot[k] for k in FIELDS))

    def _events(self, batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
        """A micro-batch's events of the slot in order; rows without `at` are left out."""
        rows = pd.concat(list(batches))
        rows = rows[rows["at"].notna()].sort_values(["at", "kind"], kind="stable")
        yield from rows.astype(object).to_dict("records")

    def close(self) -> None:
        pass


class _States(_Machine):
    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        snapshot = self._get()
        for event in self._events(rows):
            if snapshot["updated_at"] is None or event["at"] >= snapshot["updated_at"]:
                snapshot, _ = advanced(snapshot, event)
        self._put(snapshot)
        yield pd.DataFrame([{"slot": key[0], **snapshot}])


class _Claims(_Machine):
    """A holder that shows no sign of life for `timeout` units of `at` loses its slot to the next start."""

    def __init__(self, timeout: int | None):
        self.timeout = math.inf if timeout is None else timeout

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        snapshot, out = self._get(), []
        for event in self._events(rows):
            if snapshot["updated_at"] is not None and event["at"] < snapshot["updated_at"]:
                continue
            if event["kind"] == "start" and snapshot["state"] in ACTIVE and event["at"] - snapshot["updated_at"] > self.timeout:
                snapshot = restarted(snapshot)
            snapshot, accepted = advanced(snapshot, event)
            if event["kind"] == "start":
                out.append({"slot": key[0], "at": int(event["at"]), "project": event["project"], "accepted": accepted, "holder": snapshot["started_at"], "holder_project": snapshot["project"]})
        self._put(snapshot)
        yield pd.DataFrame(out, columns=["slot", "at", "project", "accepted", "holder", "holder_project"])


def job_states(events: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """slot and its snapshot after each micro-batch in which it has events, from a stream of events (EVENT).

    snapshots (slot and SNAPSHOT): what an earlier run left; jobs that were active there start as interrupted. Rows
    without slot are left out. Events of a slot count in the order of `at`; those older than what has been applied are
    left out.
    """
    rows = events.selectExpr(*[x.split()[0] for x in EVENT.split(", ")]).filter("slot is not null")
    first = snapshots.filter("slot is not null").groupBy("slot") if snapshots is not None else None
    return rows.groupBy("slot").transformWithStateInPandas(_States(), outputStructType=f"slot string, {SNAPSHOT}", outputMode="Update", timeMode="None", initialState=first)


def slot_claims(events: DataFrame, timeout: int | None = None) -> DataFrame:
    """Each start of a stream of events (EVENT) with accepted, and the start (and project) that holds the slot after it."""
    rows = events.selectExpr(*[x.split()[0] for x in EVENT.split(", ")]).filter("slot is not null")
    return rows.groupBy("slot").transformWithStateInPandas(_Claims(timeout), outputStructType="slot string, at long, project string, accepted boolean, holder long, holder_project string", outputMode="Append", timeMode="None")
