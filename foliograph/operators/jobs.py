"""Job state from events, in batch: latest state, running progress, recent events, expiry, write-once snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_state(events: DataFrame, key: str, at: str, seq: str, more: list[Column] | None = None) -> DataFrame:
    """The last event of each key and further aggregates; ``seq`` breaks ties. One partial aggregate, no sort."""
    rest = [c for c in events.columns if c != key]
    last = events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(at, seq)).alias("l"), F.count("*").alias("n_events"), *(more or []))
    return last.select("*", "l.*").drop("l")


def running_progress(events: DataFrame, key: str, at: str, seq: str, value: str) -> DataFrame:
    """Progress never falls: the running maximum."""
    w = Window.partitionBy(key).orderBy(at, seq).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("progress", F.max(value).over(w))


def recent(events: DataFrame, key: str, at: str, seq: str, n: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(at), F.desc(seq))
    return events.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def expired(events: DataFrame, key: str, at: str, seq: str, terminal: Column, hours: int) -> DataFrame:
    """Keys whose last event (``seq`` breaks ties) ended them more than ``hours`` before the last event of all."""
    last = events.groupBy(key).agg(F.max(at).alias("last_at"), F.max_by(terminal, F.struct(at, seq)).alias("ended"))
    now = events.agg(F.max(at).alias("now"))
    return last.join(F.broadcast(now), F.expr(f"ended AND last_at < now - INTERVAL {hours} HOURS")).select(key, "last_at")  # one row


def active_jobs(jobs: DataFrame, project: str, job: str, at: str, open_: Column) -> DataFrame:
    """``state`` of each job: of a project's open jobs the first is active, later ones are refused; the others are closed."""
    w = Window.partitionBy(project, open_).orderBy(at, job)
    return jobs.withColumn("state", F.when(~open_, "closed").when(F.row_number().over(w) == 1, "active").otherwise("refused"))


def accepted_events(events: DataFrame, key: str, at: str, seq: str, commit: Column, cancel: Column) -> DataFrame:
    """Events without the cancellations behind a key's commit: from there on it can't be cancelled. A cancellation before it ends the key,
    so what follows is dropped."""
    w = Window.partitionBy(key).orderBy(at, seq).rowsBetween(Window.unboundedPreceding, -1)
    committed = F.coalesce(F.max(commit.cast("int")).over(w), F.lit(0))
    rows = events.withColumn("_late", (cancel & (committed == 1)).cast("int")).filter("_late = 0")
    ended = F.coalesce(F.max(cancel.cast("int")).over(w), F.lit(0))
    return rows.withColumn("_ended", ended).filter("_ended = 0").drop("_late", "_ended")


def paused_time(events: DataFrame, key: str, at: str, seq: str, pause: Column, resume: Column) -> DataFrame:
    """key and the time between each pause that took effect and the resume behind it, in the unit of ``at``; open pauses count nothing."""
    marks = events.withColumn("_m", F.when(pause, 1).when(resume, 0)).filter("_m IS NOT NULL")
    w = Window.partitionBy(key).orderBy(at, seq)
    changes = marks.withColumn("_b", F.coalesce(F.lag("_m").over(w), F.lit(0))).filter("_m <> _b")
    steps = changes.withColumn("_next", F.lead(at).over(w)).filter("_m = 1")
    return steps.groupBy(key).agg(F.count("*").alias("n_pauses"), F.coalesce(F.sum(F.col("_next") - F.col(at)), F.lit(0)).cast("bigint").alias("paused"))


def stale(snapshots: DataFrame, current: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """Snapshots with ``stale``: whether the key's fingerprint is another one now, or it is gone."""
    now = current.select(key, F.col(fingerprint).alias("_now"))
    return snapshots.join(now, key, "left").withColumn("stale", ~F.col(fingerprint).eqNullSafe(F.col("_now")) | F.col("_now").isNull()).drop("_now")


def write_once(events: DataFrame, keys: list[str], at: str, seq: str, value: str) -> DataFrame:
    """The first value of each key stays."""
    return events.groupBy(*keys).agg(F.min_by(value, F.struct(at, seq)).alias(value), F.min(at).alias("first_at"))
