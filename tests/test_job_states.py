"""Job states and slots as streams, against a plain fold and the table forms."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lectern.plans import status
from lectern.streaming import job_states

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NAMES = [x.split()[0] for x in job_states.EVENT.split(", ")]


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def some_events(rng, n):
    """Rows of EVENT for slots a, b and c, in order."""
    rows = []
    for at in range(n):
        kind = rng.choice(["start", "update", "update", "update", "stop", "finish"])
        row = dict.fromkeys(NAMES) | {"slot": rng.choice("abc"), "at": at, "kind": kind, "project": f"p{at}" if kind == "start" else None}
        if kind == "update":
            row |= {k: v for k, v in {"phase": f"ph{at}", "message": f"m{at}", "fraction": rng.uniform(-0.5, 1.5), "completed": rng.randrange(-3, 9), "total": 9, "speed": 2.0, "eta": float(at)}.items() if rng.random() < 0.5}
        if kind == "finish":
            row["state"] = rng.choice(["completed", "stopped", "failed", None, "running"])
        rows.append(row)
    return rows


def fold(rows, before=None):
    """The snapshot of each slot after its events, and the outcome of each start, one event after another."""
    now, claims = dict(before or {}), []
    for e in rows:
        s = now.setdefault(e["slot"], {"state": "idle", "phase": "idle", "fraction": 0.0, "completed": 0, "total": 0, "eta": None, "speed": None, "project": None, "started_at": None})
        live = s["state"] in ("running", "stopping")
        if e["kind"] == "start":
            if not live:
                s.update(state="running", phase="starting", fraction=0.0, completed=0, total=0, eta=None, speed=None, project=e["project"], started_at=e["at"])
            claims.append((e["slot"], e["at"], not live, s["started_at"]))
        elif e["kind"] == "update":
            for k in ("phase", "speed", "eta"):
                s[k] = s[k] if e[k] is None else e[k]
            if e["fraction"] is not None:
                s["fraction"] = min(1.0, max(0.0, e["fraction"]))
            for k in ("completed", "total"):
                s[k] = s[k] if e[k] is None else max(0, e[k])
        elif e["kind"] == "stop" and live:
            s.update(state="stopping", phase="stopping", eta=None)
        elif e["kind"] == "finish" and e["state"] in ("completed", "stopped", "failed"):
            s.update(state=e["state"], phase=e["state"], eta=None)
    return now, claims


def streamed(spark, tmp_path, name, rows, make, mode, batches, rng):
    """The rows that a stream gives for batches of events, each shuffled within; a file is a batch."""
    source = f"{tmp_path}/{name}-in"
    step = -(-len(rows) // batches)
    for k in range(0, len(rows), step):
        part = rows[k : k + step]
        rng.shuffle(part)
        spark.createDataFrame([tuple(r[c] for c in NAMES) for r in part], job_states.EVENT).coalesce(1).write.mode("append").parquet(source)
    out = f"{tmp_path}/{name}-out"
    stream = make(spark.readStream.schema(job_states.EVENT).option("maxFilesPerTrigger", 1).parquet(source))
    q = stream.writeStream.outputMode(mode).foreachBatch(lambda b, n: b.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/n={n}"))
    q.option("checkpointLocation", f"{tmp_path}/{name}-state").trigger(availableNow=True).start().awaitTermination()
    return [r.asDict() for r in spark.read.parquet(out).collect()]


def same(got, want):
    for slot, s in want.items():
        assert {k: got[slot][k] for k in s} == pytest.approx(s), slot


def test_states_equal_a_fold(spark, tmp_path):
    rng = random.Random(1)
    rows = some_events(rng, 90) + [dict.fromkeys(NAMES) | {"slot": None, "at": 5, "kind": "start"}, dict.fromkeys(NAMES) | {"slot": "a", "at": None, "kind": "start"}]
    want, claims = fold([dict(r) for r in rows[:90]])
    found = streamed(spark, tmp_path, "states", [dict(r) for r in rows], job_states.job_states, "update", 3, rng)
    last = {}
    for r in sorted(found, key=lambda r: r["batch"]):
        last[r["slot"]] = r
    same(last, want)
    # another run begins with what is left: active jobs are interrupted, their estimates gone
    left = [(slot, s["state"], s["phase"], "m", s["fraction"], s["completed"], s["total"], s["speed"], s["eta"], s["project"], s["started_at"], 89) for slot, s in want.items()]
    left.append(("d", "running", "chunk 3", "m", 0.5, 3, 6, None, 12.0, "p", 1, 2))
    snapshots = spark.createDataFrame(left, f"slot string, {job_states.SNAPSHOT}")
    again = [dict.fromkeys(NAMES) | {"slot": slot, "at": 100, "kind": "update", "total": 7} for slot in "abcd"] + [dict.fromkeys(NAMES) | {"slot": "d", "at": 101, "kind": "start", "project": "new"}, dict.fromkeys(NAMES) | {"slot": "d", "at": 50, "kind": "finish", "state": "failed"}]
    found = {r["slot"]: r for r in streamed(spark, tmp_path, "again", again, lambda e: job_states.job_states(e, snapshots), "update", 1, rng)}
    for slot, s in want.items():
        active = s["state"] in ("running", "stopping")
        assert (found[slot]["state"], found[slot]["phase"]) == (("interrupted", "interrupted") if active else (s["state"], s["phase"]))
        assert found[slot]["eta"] is None or not active
        assert found[slot]["total"] == 7 and found[slot]["completed"] == s["completed"]
    assert (found["d"]["state"], found["d"]["project"], found["d"]["completed"]) == ("running", "new", 0)


def test_table_form_equals_a_fold(spark):
    rng = random.Random(2)
    rows = some_events(rng, 400)
    want, _ = fold([dict(r) for r in rows])
    rng.shuffle(rows)
    events = spark.createDataFrame([tuple(r[c] for c in NAMES) for r in rows], job_states.EVENT).withColumn("project", F.col("slot")).drop("slot")
    got = {r["project"]: r.asDict() for r in status.job_state(events).collect()}
    fields = ("state", "phase", "fraction", "completed", "total", "eta")
    same(got, {k: {f: v[f] for f in fields} for k, v in want.items()})
    assert status.job_state(events.limit(0)).count() == 0
    odd = events.limit(0).union(spark.createDataFrame([(1, "boo", "q", *[None] * 8), (2, "stop", "q", *[None] * 8)], events.schema))
    assert [(r["state"], r["message"]) for r in status.job_state(odd).collect()] == [("idle", status.MESSAGES["idle"])]


def test_claims_equal_a_fold(spark, tmp_path):
    rng = random.Random(3)
    rows = some_events(rng, 90)
    _, claims = fold([dict(r) for r in rows])
    found = streamed(spark, tmp_path, "claims", rows, job_states.slot_claims, "append", 3, rng)
    assert sorted((r["slot"], r["at"], r["accepted"], r["holder"]) for r in found) == sorted(claims)
    # the table form has the same claims, where finishes are those that end a job
    events = spark.createDataFrame([(r["slot"], r["at"], r["kind"]) for r in rows if r["kind"] == "start" or r["state"] in ("completed", "stopped", "failed")], "project string, at long, kind string")
    assert sorted(tuple(r) for r in status.single_slot(events).collect()) == sorted(claims)


def test_a_silent_holder_loses_its_slot(spark, tmp_path):
    blank = dict.fromkeys(NAMES) | {"slot": "s"}
    rows = [blank | {"at": 0, "kind": "start", "project": "one"}, blank | {"at": 5, "kind": "start", "project": "two"}, blank | {"at": 9, "kind": "update", "total": 3}, blank | {"at": 19, "kind": "start", "project": "three"}, blank | {"at": 30, "kind": "start", "project": "four"}]
    found = streamed(spark, tmp_path, "silent", rows, lambda e: job_states.slot_claims(e, timeout=10), "append", 2, random.Random(4))
    assert sorted((r["at"], r["accepted"], r["holder_project"]) for r in found) == [(0, True, "one"), (5, False, "one"), (19, False, "one"), (30, True, "four")]


def test_fields_are_kept_as_they_come():
    """Fractions and counts that are no numbers of their range are cut, NaN counts as nothing."""
    s, _ = job_states.advanced(dict(job_states.IDLE), dict.fromkeys(NAMES) | {"at": 1, "kind": "update", "fraction": float("nan"), "completed": -4, "eta": float("nan")})
    assert (s["fraction"], s["completed"], s["eta"]) == (0.0, 0, None)
    assert json.dumps(job_states.restarted(s)) == json.dumps(s)
