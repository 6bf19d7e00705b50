"""Queries over events and conversations: intervals, as-of joins, sessions, job state, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import instant, micros, zoneless
from ..operators import intervals, jobs, lines
from ..operators.storage import fresh_path
from ..streaming import jobs as streams
from ._base import Queries, table

Q = Queries()

SPANS = "iv AS (SELECT event_id, user_id, CAST(epoch(ts) AS BIGINT) AS s, CAST(epoch(ts) AS BIGINT) + CAST(floor(value * 100) AS BIGINT) AS e FROM events)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("s", F.floor(micros(F.col("ts")) / 1_000_000))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", "user_id", "s", (F.col("s") + F.floor(F.col("value") * 100)).alias("e"))


SPANS = SPANS.replace("CAST(epoch(ts) AS BIGINT)", "CAST(epoch(date_trunc('second', ts)) AS BIGINT)")


@Q.add(f"WITH {SPANS} SELECT event_id, user_id FROM iv a WHERE EXISTS (SELECT 1 FROM iv b WHERE a.user_id = b.user_id AND a.event_id <> b.event_id AND a.s <= b.e AND b.s <= a.e)")
def interval_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.conflicts(spans(spark, sf_dir), "user_id", ["event_id"]).select("event_id", "user_id")


@Q.add(f"WITH {SPANS} SELECT event_id FROM iv a WHERE NOT EXISTS (SELECT 1 FROM iv b WHERE a.user_id = b.user_id AND a.event_id <> b.event_id AND a.s <= b.e AND b.s <= a.e)")
def conflict_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.without_conflicts(spans(spark, sf_dir), "user_id", ["event_id"]).select("event_id")


@Q.add("""WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts AS s, ts + INTERVAL 6 HOUR AS e FROM events WHERE event_type = 'signup')
SELECT p.event_id, count(*) AS n_open FROM p JOIN r ON p.user_id = r.user_id AND p.ts BETWEEN r.s AND r.e GROUP BY p.event_id""")
def containment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases within six hours of signups: ranges are cut into hourly buckets and joined on (user, bucket)."""
    rows = events(spark, sf_dir).withColumn("us", micros(F.col("ts")))
    points = rows.filter("event_type = 'purchase'").select("event_id", "user_id", "us")
    ranges = rows.filter("event_type = 'signup'").select("user_id", F.col("us").alias("from_us"), (F.col("us") + 6 * 3_600_000_000).alias("to_us"))
    return intervals.bucketed_containment(points, ranges, "user_id", "us", "from_us", "to_us", 3_600_000_000).groupBy("event_id").agg(F.count("*").alias("n_open"))


@Q.add("""WITH m AS (SELECT event_id, user_id, epoch_us(ts) AS t, CASE WHEN event_type = 'error' THEN epoch_us(ts) END AS a, ts FROM events),
n AS (SELECT event_id, t, last_value(a IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, first_value(a IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS f FROM m)
SELECT event_id, b AS before, f AS after, least(t - b, f - t) AS distance FROM n""")
def nearest_before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("t", micros(F.col("ts")))
    return intervals.nearest(rows, F.col("event_type") == "error", "user_id", "t", ["ts", "event_id"]).select("event_id", "before", "after", "distance")


@Q.add("""WITH g AS (SELECT event_id, user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 21600000000 THEN 1 ELSE 0 END AS n FROM events),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n_events, max(epoch_us(ts)) - min(epoch_us(ts)) AS length_us FROM s GROUP BY user_id, session""")
def gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("t", micros(F.col("ts")))
    out = intervals.gap_sessions(rows, "user_id", "t", ["t", "event_id"], F.lit(21_600_000_000))
    return out.groupBy("user_id", F.col("session").cast("bigint").alias("session")).agg(F.count("*").alias("n_events"), (F.max("t") - F.min("t")).alias("length_us"))


@Q.add("SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_user FROM conversations")
def page_marker_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return lines.last_before(rows, F.when(F.col("role") == "user", F.col("turn")), "conv_id", ["turn"], "last_user").select("conv_id", "turn", "role", "last_user")


@Q.add("SELECT conv_id, turn, min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_stop FROM conversations")
def next_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return lines.first_after(rows, F.when(F.col("role") == "user", F.col("turn")), "conv_id", ["turn"], "next_stop").select("conv_id", "turn", "next_stop")


@Q.add("WITH s AS (SELECT *, max(CASE WHEN turn > 0 AND role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS st FROM conversations) SELECT conv_id, turn, role FROM s WHERE st = 0")
def extend_until_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return lines.extend_until(rows, (F.col("turn") > 0) & (F.col("role") == "user"), "conv_id", "turn").select("conv_id", "turn", "role")


@Q.add("SELECT user_id, count(*) AS n_events, arg_max(event_type, (ts, event_id)) AS event_type, max(event_id) FILTER (true) AS highest FROM events GROUP BY user_id")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return jobs.latest_state(rows, "user_id", "ts", "event_id", [F.max("event_id").alias("highest")]).select("user_id", "n_events", "event_type", "highest")


@Q.add("SELECT event_id, user_id, round(max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS progress FROM events")
def running_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jobs.running_progress(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", "value")
    return out.select("event_id", "user_id", F.round("progress", 6).alias("progress"))


@Q.add("WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) SELECT user_id, event_id, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5")
def event_ring_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.recent(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 5).select("user_id", "event_id", "rank")


@Q.add("WITH l AS (SELECT user_id, max(ts) AS last_at, arg_max(event_type, (ts, event_id)) IN ('purchase', 'error') AS ended FROM events GROUP BY user_id) SELECT user_id, last_at FROM l WHERE ended AND last_at < (SELECT max(ts) FROM events) - INTERVAL 6 HOUR")
def ttl_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return jobs.expired(rows, "user_id", "ts", "event_id", F.col("event_type").isin("purchase", "error"), 6)


@Q.add("SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id, min(ts) AS first_at FROM events GROUP BY ALL")
def write_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.write_once(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id", "event_id")


@Q.add("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.from_json("props", "k BIGINT")["k"].alias("k")).agg(F.count("*").alias("n"))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events, and behind them one that no window holds, so that the watermark passes all windows and append mode emits them."""
    rows = table(spark, sf_dir, "events").withColumn("ts", instant(F.col("ts")))
    path = fresh_path(spark, "events")
    rows.write.parquet(f"{path}/1")
    end = rows.agg((F.max("ts") + F.expr("INTERVAL 400 DAYS")).alias("ts"))
    schema = rows.schema
    blank = end.select(*[F.col("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
    blank.write.parquet(f"{path}/2")
    return streams.read_events(spark, f"{path}/*", schema, 1)


@Q.add("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.run_once(streams.tumbling(_stream(spark, sf_dir), "ts", "1 day", "60 days", ["event_type"]), fresh_path(spark, "tumbling"))
    return out.filter("event_type IS NOT NULL").withColumn("start", zoneless(F.col("start")))


@Q.add("""WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 21600000000 THEN 0 ELSE 1 END AS n FROM events), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.run_once(streams.sessions(_stream(spark, sf_dir), "ts", "6 hours", "60 days", ["user_id"]), fresh_path(spark, "sessions"))
    return out.filter("user_id IS NOT NULL").withColumns({c: zoneless(F.col(c)) for c in ("start", "end")})


@Q.add("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = streams.first_snapshots(_stream(spark, sf_dir), "ts", "60 days", ["user_id", "event_type"])
    out = streams.run_once(first.select("user_id", "event_type"), fresh_path(spark, "dedup"))
    return out.filter("user_id IS NOT NULL").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@Q.add("""SELECT a.event_id AS signup, b.event_id AS purchase FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 6 HOUR
  WHERE a.event_type = 'signup' AND b.event_type = 'purchase'""")
def stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups with the purchases of the six hours behind them, both sides as streams."""
    left = _stream(spark, sf_dir).filter("event_type = 'signup' OR event_type IS NULL").select("user_id", "event_id", "ts")
    right = _stream(spark, sf_dir).filter("event_type = 'purchase' OR event_type IS NULL").select("user_id", "event_id", "ts")
    out = streams.run_once(streams.joined(left, right, "user_id", "ts", "ts", "6 HOURS", "60 days"), fresh_path(spark, "joined"))
    return out.select(F.col("l_event_id").alias("signup"), F.col("r_event_id").alias("purchase"))


@Q.add("""SELECT ts AS start, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS ts FROM events) GROUP BY 1""")
def sliding_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")
