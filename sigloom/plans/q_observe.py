"""Observation: schedules, snapshots, failures, runs; windows over events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.time import retry_minutes
from ..operators import observe
from .catalogue import query

NOW = 1706745600


def targets(m):
    return m.source.select("target_id").distinct().select(
        "target_id", F.when(F.col("target_id") % 6 == 0, "paused").otherwise("watching").alias("status"), F.when(F.col("target_id") % 4 == 0, "running").otherwise("idle").alias("discovery"),
        F.when(F.col("target_id") % 3 == 0, None).otherwise(NOW + (F.col("target_id") - 10) * 60).alias("next_discovery_at"), (NOW - F.col("target_id") * 60).alias("discovery_started_at"),
    )


TARGETS = f"""target AS (SELECT DISTINCT target_id, CASE WHEN target_id % 6 = 0 THEN 'paused' ELSE 'watching' END AS status, CASE WHEN target_id % 4 = 0 THEN 'running' ELSE 'idle' END AS discovery,
  CASE WHEN target_id % 3 = 0 THEN NULL ELSE {NOW} + (target_id - 10) * 60 END AS next_discovery_at, {NOW} - target_id * 60 AS discovery_started_at FROM source)"""


@query(f"""WITH {TARGETS} SELECT s.source_id, s.next_observation_at FROM source s JOIN target t ON t.target_id = s.target_id AND t.status = 'watching' WHERE s.relevant AND s.status <> 'paused'
  AND (s.next_observation_at IS NULL OR s.next_observation_at <= {NOW}) ORDER BY s.next_observation_at NULLS FIRST, s.source_id LIMIT 50""")
def due_sources(m):
    """Sources to observe now."""
    return observe.due_sources(m.source, targets(m), NOW).select("source_id", "next_observation_at")


@query(f"""WITH {TARGETS} SELECT target_id, discovery FROM target WHERE status <> 'paused' AND (((next_discovery_at IS NULL OR next_discovery_at <= {NOW}) AND discovery <> 'running') OR (discovery = 'running' AND discovery_started_at < {NOW} - 600))""")
def due_targets(m):
    """Targets to discover now."""
    return observe.due_targets(targets(m), NOW).select("target_id", "discovery")


@query(f"SELECT source_id, coalesce(last_success_at, last_checked_at) AS seen FROM source WHERE coalesce(last_success_at, last_checked_at) < {NOW} - 172800")
def stale_sources(m):
    """Sources that have not been seen well for two days; never seen is not stale."""
    seen = F.coalesce("last_success_at", "last_checked_at")
    return m.source.filter(seen < NOW - 172800).select("source_id", seen.alias("seen"))


@query("SELECT source_id, arg_max(snapshot_id, (observed_at, snapshot_id)) AS snapshot_id, max(observed_at) AS observed_at FROM snapshot GROUP BY 1")
def snapshot_latest(m):
    """the last snapshot of each source."""
    return observe.latest_snapshots(m.snapshot)


def _pages(m):
    """Snapshots with blocks: what a page said each time, its version among it."""
    line = F.concat(F.lit("line of "), F.col("event_type"))
    lines = F.array(F.lit("always here"), line, F.concat(F.lit("version 1."), F.col("version").cast("string")))
    return m.snapshot.select("source_id", "observed_at", "snapshot_id", lines.alias("lines"), lines.alias("blocks"), F.sha2(F.array_join(lines, "\n"), 256).alias("hash"))


CHANGES = """p AS (SELECT source_id, observed_at, snapshot_id, ['always here', 'line of ' || event_type, 'version 1.' || version] AS l FROM snapshot),
b AS (SELECT *, lag(l) OVER (PARTITION BY source_id ORDER BY observed_at, snapshot_id) AS old FROM p),
d AS (SELECT *, CASE WHEN old IS NULL OR old = l THEN []::VARCHAR[] ELSE list_filter(l, lambda x: NOT list_contains(old, x)) END AS added, CASE WHEN old IS NULL OR old = l THEN []::VARCHAR[] ELSE list_filter(old, lambda x: NOT list_contains(l, x)) END AS removed FROM b),
c AS (SELECT *, CASE WHEN old IS NULL THEN 'baseline' WHEN old = l THEN 'unchanged' WHEN len(added) + len(removed) >= 3 OR len(list_filter(added, lambda x: contains(x, '.'))) > 0 OR (len(added) = 1 AND len(removed) = 1) THEN 'materially_changed' ELSE 'changed' END AS change FROM d)"""


@query(f"WITH {CHANGES} SELECT source_id, snapshot_id, change, array_to_string(added, '|') AS added, array_to_string(removed, '|') AS removed FROM c")
def snapshot_diff(m):
    """Each snapshot against the one before."""
    return observe.snapshot_changes(_pages(m)).select("source_id", "snapshot_id", "change", F.array_join("added", "|").alias("added"), F.array_join("removed", "|").alias("removed"))


@query(f"WITH {CHANGES} SELECT source_id, arg_max(snapshot_id, (observed_at, snapshot_id)) AS snapshot_id, max(observed_at) AS observed_at FROM c WHERE change <> 'unchanged' GROUP BY 1")
def last_change(m):
    """the last snapshot that was not as the one before."""
    return observe.latest_snapshots(observe.snapshot_changes(_pages(m)).filter("change <> 'unchanged'"))


@query(f"WITH {CHANGES} SELECT source_id, snapshot_id, source_id || '#change-' || substr(sha256(array_to_string(added, chr(10)) || chr(10) || array_to_string(removed, chr(10))), 1, 12) AS identity, array_to_string(added, chr(10)) AS content_text FROM c WHERE change = 'materially_changed'")
def change_items(m):
    """Items that changes make."""
    return observe.change_items(observe.snapshot_changes(_pages(m)))


@query("""WITH i AS (SELECT *, sum(CASE WHEN status = 'failed' THEN 0 ELSE 1 END) OVER (PARTITION BY source_id ORDER BY observed_at, event_id ROWS UNBOUNDED PRECEDING) AS island FROM observation)
SELECT source_id, island::BIGINT AS island, count(*) AS failures, min(observed_at) AS since FROM i WHERE status = 'failed' GROUP BY 1, 2""")
def failure_streaks(m):
    """failures in a row."""
    return observe.failure_streaks(m.observation)


@query("""WITH l AS (SELECT source_id, max(CASE WHEN status <> 'failed' THEN (observed_at, event_id) END) AS ok FROM observation GROUP BY 1),
f AS (SELECT o.source_id, count(*) FILTER (WHERE o.status = 'failed' AND (l.ok IS NULL OR (o.observed_at, o.event_id) > l.ok)) AS failures FROM observation o JOIN l ON l.source_id = o.source_id GROUP BY 1)
SELECT source_id, failures, CASE WHEN source_id % 10 = 0 THEN 'paused' WHEN failures >= 3 THEN 'unavailable' WHEN failures > 0 THEN 'retrying' ELSE 'healthy' END AS health FROM f""")
def source_health(m):
    """Failures since the last success, and what they mean."""
    at = F.struct("observed_at", "event_id")
    ok = m.observation.filter("status <> 'failed'").groupBy("source_id").agg(F.max(at).alias("ok"))
    seen = m.observation.join(ok, "source_id", "left")
    since = seen.groupBy("source_id").agg(F.count_if((F.col("status") == "failed") & (F.col("ok").isNull() | (at > F.col("ok")))).alias("failures"))
    return since.select("source_id", "failures", observe.health(F.col("failures"), F.col("source_id") % 10 == 0, F.lit(True)).alias("health"))


@query("""SELECT event_id, round(CASE WHEN event_id % 5 = 0 THEN greatest(event_id % 200, 60)::DOUBLE / 60 ELSE least(1440.0::DOUBLE, (CASE WHEN event_id % 2 = 0 THEN 5 ELSE greatest(event_id % 90, 5) END)::DOUBLE * pow(2.0::DOUBLE, least(greatest(event_id % 14 - 1, 0), 10))) END, 6) AS minutes FROM events""")
def retry_backoff(m):
    """How long to wait after failures."""
    e = F.col("event_id")
    wait = retry_minutes(e % 90, e % 14, e % 2 == 0, F.when(e % 5 == 0, e % 200))
    return m.events.select("event_id", F.round(wait, 6).alias("minutes"))


@query("SELECT event_id, source_id, CASE WHEN observed_at = min(observed_at) OVER (PARTITION BY source_id) THEN 'baseline' ELSE 'fresh' END AS novelty FROM observation")
def baseline_novelty(m):
    """The first pass is the baseline."""
    return observe.novelty(m.observation).select("event_id", "source_id", "novelty")


@query(f"""WITH {TARGETS} SELECT (SELECT count(*) FROM target) AS targets, (SELECT count(*) FROM target WHERE status = 'paused') AS paused, (SELECT count(*) FROM source) AS sources, (SELECT count(*) FROM source WHERE status = 'failing') AS failing,
  (SELECT least(min(next_observation_at), (SELECT min(next_discovery_at) FROM target)) FROM source) AS next_due""")
def observation_status(m):
    """Counts and what is due next."""
    t = targets(m).agg(F.count("*").alias("targets"), F.count_if(F.col("status") == "paused").alias("paused"), F.min("next_discovery_at").alias("t"))
    s = m.source.agg(F.count("*").alias("sources"), F.count_if(F.col("status") == "failing").alias("failing"), F.min("next_observation_at").alias("s"))
    return t.crossJoin(s).select("targets", "paused", "sources", "failing", F.least("s", "t").alias("next_due"))


@query("SELECT date_trunc('day', observed_at) AS run, sum(new_items)::BIGINT AS new_items, count(*) FILTER (WHERE status = 'failed') AS failures, count(DISTINCT source_id) AS sources FROM observation GROUP BY 1")
def run_counters(m):
    """What each run came to."""
    return m.observation.groupBy(F.date_trunc("day", "observed_at").cast("timestamp_ntz").alias("run")).agg(F.sum("new_items").alias("new_items"), F.count_if(F.col("status") == "failed").alias("failures"), F.countDistinct("source_id").alias("sources"))


@query("SELECT count(*) FILTER (WHERE status = 'failed') AS failures, count(*) FILTER (WHERE status = 'unchanged') AS unchanged FROM observation WHERE observed_at >= TIMESTAMP '2024-01-24'")
def doctor(m):
    """Failures of the last week."""
    return m.observation.filter("observed_at >= TIMESTAMP_NTZ '2024-01-24'").agg(F.count_if(F.col("status") == "failed").alias("failures"), F.count_if(F.col("status") == "unchanged").alias("unchanged"))


@query("SELECT source_id, CASE WHEN source_id % 5 = 0 THEN 'seed' WHEN source_id % 5 = 1 THEN 'page_link' ELSE 'other' END AS method, row_number() OVER (PARTITION BY target_id ORDER BY CASE WHEN source_id % 5 = 0 THEN 0 WHEN source_id % 5 = 1 THEN 2 ELSE 1 END, source_id)::BIGINT AS place FROM source")
def watched_sources(m):
    """The sources of a target in their order."""
    k = F.col("source_id") % 5
    method = F.when(k == 0, "seed").when(k == 1, "page_link").otherwise("other")
    rank = F.when(k == 0, 0).when(k == 1, 2).otherwise(1)
    return m.source.select("source_id", method.alias("method"), F.row_number().over(Window.partitionBy("target_id").orderBy(rank, "source_id")).cast("long").alias("place"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def events_tumbling(m):
    """Beyond parity: tumbling windows."""
    return m.events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


@query("SELECT hour, count(*) AS n FROM (SELECT date_trunc('hour', ts) + to_hours(-k) AS hour FROM events, (SELECT unnest([0, 1]) AS k)) GROUP BY 1")
def events_sliding(m):
    """Beyond parity: windows of two hours each hour."""
    return m.events.groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def events_sessions(m):
    """Beyond parity: sessions with gaps of half an hour."""
    return m.events.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")
