"""Status of jobs from their events: states, slots, live progress, checked snapshots, messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T

# The states of a job, those in which it runs, and what a snapshot says in each
STATES = ("idle", "running", "stopping", "completed", "stopped", "failed", "interrupted")
ACTIVE = ("running", "stopping")
MESSAGES = {
    "idle": "No audiobook job is running.",
    "starting": "Starting audiobook job…",
    "stopping": "Stop requested; waiting for the current operation to finish…",
    "interrupted": "The previous app session ended while this job was running. Its saved project can be resumed.",
    "completed": "completed",
    "stopped": "stopped",
    "failed": "failed",
}
INTERRUPTED = {"state": "interrupted", "phase": "interrupted", "message": MESSAGES["interrupted"], "eta": None}


def job_state(events: DataFrame) -> DataFrame:
    """The last snapshot of each project: state, phase, message, fraction, completed, total, eta.

    events: project, at (unique in a project), kind (start, update, stop, finish), and phase, message, fraction, completed,
    total, eta and state (of a finish: idle, completed, stopped, failed or interrupted), which may be null. A start counts
    where no job is active and clears all fields; an update sets the fields that it has, the fraction cut to 0 to 1, counts
    to 0 and more; a stop counts where a job is active; a finish ends the job in its state. Stops and finishes clear the
    estimate.

    Instead of a fold over a project's events, four aggregations with partial sums find the last start that counts, the
    finish after it, and the last event that sets each field, so a project with very many events stays spread.
    """
    finish = (F.col("kind") == "finish") & F.col("state").isin(*[x for x in STATES if x not in ACTIVE])
    e = events.filter(finish | F.col("kind").isin("start", "update", "stop"))
    at = lambda cond: F.when(cond, F.col("at"))
    start = F.col("kind") == "start"
    last = e.groupBy("project").agg(F.max(at(start)).alias("last_start"))
    ends = e.join(last, "project").groupBy("project").agg(F.max(at(finish & (F.col("at") < F.col("last_start")))).alias("before"), F.min(at(finish & (F.col("at") > F.col("last_start")))).alias("ended"))
    first = e.join(ends, "project").filter(start & (F.col("before").isNull() | (F.col("at") > F.col("before")))).groupBy("project").agg(F.min("at").alias("started"))
    spans = ends.join(first, "project", "left").select("project", "started", "ended")

    row = e.join(spans, "project").filter(F.col("started").isNull() | (F.col("at") >= F.col("started")))
    begins = F.col("started").isNotNull() & (F.col("at") == F.col("started"))
    stops = (F.col("kind") == "stop") & (F.col("at") > F.col("started")) & (F.col("ended").isNull() | (F.col("at") < F.col("ended")))
    update, said = F.col("kind") == "update", lambda c: F.col(c).isNotNull()
    fraction = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("fraction")))
    count = lambda c: F.greatest(F.lit(0).cast("long"), F.col(c).cast("long"))
    known = said("fraction") & ~F.isnan("fraction")

    def latest(name: str, *cases: tuple[Column, Column]) -> Column:
        """The value of the last event that one of the cases (whether it sets the field, to what) holds for."""
        value, sets = F.lit(None), F.lit(False)
        for cond, to in reversed(cases):
            value, sets = F.when(cond, F.struct(to.alias("v"))).otherwise(value), sets | F.coalesce(cond, F.lit(False))
        return F.max_by(F.when(sets, value), at(sets)).alias(name)

    text = F.lit
    got = row.groupBy("project").agg(
        latest("state", (begins, text("running")), (stops, text("stopping")), (finish, F.col("state"))),
        latest("phase", (begins, text("starting")), (stops, text("stopping")), (finish, F.col("state")), (update & said("phase"), F.col("phase"))),
        latest("message", (begins, text(MESSAGES["starting"])), (stops, text(MESSAGES["stopping"])), (finish, F.coalesce("message", "state")), (update & said("message"), F.col("message"))),
        latest("fraction", (begins, F.lit(0.0)), ((update | finish) & known, fraction)),
        latest("completed", (begins, F.lit(0).cast("long")), ((update | finish) & said("completed"), count("completed"))),
        latest("total", (begins, F.lit(0).cast("long")), ((update | finish) & said("total"), count("total"))),
        latest("eta", (begins | stops | finish, F.lit(None).cast("double")), (update & said("eta") & ~F.isnan("eta"), F.col("eta"))),
    )
    start_as = {"state": F.lit("idle"), "phase": F.lit("idle"), "message": F.lit(MESSAGES["idle"]), "fraction": F.lit(0.0), "completed": F.lit(0).cast("long"), "total": F.lit(0).cast("long")}
    every = events.select("project").distinct().join(got, "project", "left")
    return every.select("project", *[F.coalesce(F.col(c)["v"], v).alias(c) for c, v in start_as.items()], F.col("eta")["v"].alias("eta"))


def restarted(snapshots: DataFrame) -> DataFrame:
    """snapshots as the next run finds them: active jobs are interrupted and have no estimate."""
    active = F.col("state").isin(*ACTIVE)
    own = {c: F.when(active, F.lit(v)).otherwise(F.col(c)) for c, v in INTERRUPTED.items()}
    return snapshots.select(*[own[c].alias(c) if c in own else F.col(c) for c in snapshots.columns])


def single_slot(events: DataFrame) -> DataFrame:
    """Each start with whether its slot was free, and the start that holds the slot."""
    w = Window.partitionBy("project").orderBy("at")
    e = events.filter("kind in ('start', 'finish')").withColumn("round", F.count_if(F.col("kind") == "finish").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    holder = F.min("at").over(Window.partitionBy("project", "round"))
    return e.filter("kind = 'start'").withColumn("holder", holder).select("project", "at", (F.col("at") == F.col("holder")).alias("accepted"), "holder")


def snapshot_faults(rows: DataFrame, states: tuple[str, ...] = STATES) -> DataFrame:
    """Adds `faults`: the names of the rules that a status row (state, fraction, eta, completed) breaks.

    The estimate may be null; a null in another column breaks its rule.
    """
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    rules = {
        "state": F.col("state").isin(*states),
        "fraction": finite(F.col("fraction")) & F.col("fraction").between(0, 1),
        "eta": F.col("eta").isNull() | (finite(F.col("eta")) & (F.col("eta") >= 0)),
        "completed": F.col("completed") >= 0,
    }
    return rows.withColumn("faults", F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])))


def progress_line(done: Column, total: Column, elapsed: Column, cached: Column) -> Column:
    """A scan's message: counts with thousands separators, whole percent, time left, and what the cache spared."""
    left = F.when((done <= 0) & (total > 0), F.lit("calculating…")).otherwise(T.format_duration(F.when(total > 0, elapsed * (total - done) / done).otherwise(F.lit(0.0))))
    percent = F.when(total > 0, F.floor(100 * done / total)).otherwise(F.lit(100))
    line = F.concat(F.format_number(done, 0), F.lit("/"), F.format_number(total, 0), F.lit(" ("), percent.cast("string"), F.lit("%), ETA "), left)
    return F.concat(line, F.when(cached > 0, F.concat(F.lit("; "), F.format_number(cached, 0), F.lit(" cached skipped"))).otherwise(F.lit("")))


def numbered(rows: DataFrame, key: str, order: str, width: int = 10_000) -> DataFrame:
    """Adds n, 1 for the least `order` of each key; ranges of `order` are numbered apart and meet by their counts.

    `order` is a whole number and unique in a key. Only the counts of ranges go through one window of a key.
    """
    r = rows.withColumn("_range", F.floor(F.col(order) / width))
    counts = r.groupBy(key, "_range").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col(key).alias("_key"), F.col("_range").alias("_at"), F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_before"))
    r = r.withColumn("_in", F.row_number().over(Window.partitionBy(key, "_range").orderBy(order)))
    joined = r.join(counts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_at")))
    return joined.withColumn("n", F.col("_before") + F.col("_in")).drop("_range", "_in", "_key", "_at", "_before")


def running(rows: DataFrame, key: str, order: str, value: str, width: int = 10_000) -> DataFrame:
    """Adds before, the sum of `value` over a key's earlier rows by `order`; ranges of `order` are summed apart.

    `order` is a whole number, unique in a key; null values count as 0. Only the sums of ranges, not the rows, go
    through one window of a key. An empty table gives an empty one.
    """
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    r = rows.withColumn("_range", F.floor(F.col(order) / width))
    sums = r.groupBy(F.col(key).alias("_key"), F.col("_range").alias("_at")).agg(F.sum(value).alias("_sum"))
    sums = sums.select("_key", "_at", F.coalesce(F.sum("_sum").over(earlier(Window.partitionBy("_key").orderBy("_at"))), F.lit(0)).alias("_earlier"))
    r = r.withColumn("_in", F.coalesce(F.sum(value).over(earlier(Window.partitionBy(key, "_range").orderBy(order))), F.lit(0)))
    joined = r.join(sums, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_at")))
    return joined.withColumn("before", (F.col("_earlier") + F.col("_in")).cast("long")).drop("_range", "_in", "_key", "_at", "_earlier")


def size_caps(members: DataFrame, member_cap: int = 8 << 20, book_cap: int = 64 << 20) -> DataFrame:
    """members (book, pos, bytes) with running (bytes up to it), over and book_failed.

    A member is over if it has more bytes than a member may have, or with those before it more than a book may have;
    one such member fails its book. pos is unique in a book; null bytes count as 0.
    """
    m = running(members, "book", "pos", "bytes")
    m = m.withColumn("running", F.col("before") + F.coalesce("bytes", F.lit(0))).drop("before")
    m = m.withColumn("over", (F.coalesce("bytes", F.lit(0)) > member_cap) | (F.col("running") > book_cap))
    failed = m.groupBy(F.col("book").alias("_book")).agg(F.max("over").alias("book_failed"))
    return m.join(failed, F.col("book").eqNullSafe(F.col("_book"))).drop("_book")
