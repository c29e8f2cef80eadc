"""Operators over observations: what is due, what changed, how sources fare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions.text import without_repeats


def due_sources(sources: DataFrame, targets: DataFrame, now: int, force: bool = False, most: int = L.DUE_SOURCES) -> DataFrame:
    """Relevant sources of watching targets that are not paused and whose time has come; the longest due first, those never seen before all."""
    due = F.lit(True) if force else F.col("next_observation_at").isNull() | (F.col("next_observation_at") <= now)
    watching = targets.filter("status = 'watching'").select("target_id")
    return sources.filter(F.col("relevant") & (F.col("status") != "paused") & due).join(watching, "target_id", "left_semi").orderBy(F.asc_nulls_first("next_observation_at"), "source_id").limit(most)


def due_targets(targets: DataFrame, now: int, force: bool = False, stale: int = 600) -> DataFrame:
    """Targets to discover: time has come and none runs, or one has run for too long; paused ones only if forced."""
    ready = (F.col("next_discovery_at").isNull() | (F.col("next_discovery_at") <= now)) & (F.col("discovery") != "running")
    stuck = (F.col("discovery") == "running") & (F.col("discovery_started_at") < now - stale)
    return targets.filter((ready | stuck) & (F.lit(force) | (F.col("status") != "paused")))


def snapshot_changes(snapshots: DataFrame) -> DataFrame:
    """Every snapshot (source_id, observed_at, snapshot_id, lines, blocks, hash) beside the one before it: change, added, removed.
    Added are lines as written, removed are blocks as compared; order and repeats stay."""
    w = Window.partitionBy("source_id").orderBy("observed_at", "snapshot_id")
    both = snapshots.withColumn("before", F.lag("blocks").over(w)).withColumn("before_hash", F.lag("hash").over(w))
    added = F.transform(F.filter(F.arrays_zip("lines", "blocks"), lambda p: ~F.array_contains(F.col("before"), p["blocks"])), lambda p: p["lines"])
    removed = F.filter("before", lambda b: ~F.array_contains(F.col("blocks"), b))
    first, same = F.col("before_hash").isNull(), F.col("before_hash") == F.col("hash")
    none = F.array().cast("array<string>")
    told = both.withColumn("added", F.when(first | same, none).otherwise(added)).withColumn("removed", F.when(first | same, none).otherwise(removed))
    words = lambda c: F.aggregate(c, F.lit(0), lambda n, x: n + F.size(F.filter(F.split(x, r"\s+"), lambda w: w != "")))
    versioned = F.exists("added", lambda x: F.exists(F.split(x, r"\s+"), lambda w: F.contains(w, F.lit(".")) & w.rlike("[0-9]")))
    material = (words(F.col("added")) + words(F.col("removed")) >= L.MATERIAL_WORDS) | versioned
    change = F.when(first, "baseline").when(same, "unchanged").when(material, "materially_changed").otherwise("changed")
    return told.select("source_id", "snapshot_id", "observed_at", change.alias("change"), "added", "removed")


def change_items(changes: DataFrame) -> DataFrame:
    """The items that material changes make: named by page and what changed."""
    key = F.sha2(F.concat_ws("\n", F.array_join("added", "\n"), F.array_join("removed", "\n")), 256)
    return changes.filter("change = 'materially_changed'").select("source_id", "snapshot_id", F.concat(F.col("source_id").cast("string"), F.lit("#change-"), F.substring(key, 1, 12)).alias("identity"), F.array_join("added", "\n").alias("content_text"))


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy("source_id").agg(F.max_by(F.struct("snapshot_id", "observed_at"), F.struct("observed_at", "snapshot_id")).alias("s")).select("source_id", "s.snapshot_id", "s.observed_at")


def failure_streaks(log: DataFrame) -> DataFrame:
    """Runs of failures in a row of each source: gaps and islands over its observations."""
    w = Window.partitionBy("source_id").orderBy("observed_at", "event_id")
    failed = (F.col("status") == "failed").cast("int")
    islands = log.withColumn("failed", failed).withColumn("island", F.sum(1 - F.col("failed")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.filter("failed = 1").groupBy("source_id", "island").agg(F.count("*").alias("failures"), F.min("observed_at").alias("since"))


def health(failures: Column, paused: Column, ever: Column) -> Column:
    """How a source fares: paused, unavailable after three failures in a row, failing, new, or well."""
    return F.when(paused, "paused").when(failures >= 3, "unavailable").when(failures > 0, "retrying").when(~ever, "pending").otherwise("healthy")


def novelty(log: DataFrame) -> DataFrame:
    """What the first pass over a source finds is baseline; what comes later is fresh."""
    first = F.min("observed_at").over(Window.partitionBy("source_id"))
    return log.withColumn("novelty", F.when(F.col("observed_at") == first, "baseline").otherwise("fresh"))


def new_pages(links: DataFrame, previous: DataFrame, section: Column, most: int = L.NEW_PAGES) -> DataFrame:
    """Links of a section's page that lead strictly below it, were not there before and stand in no navigation; a few of each page."""
    from ..functions import url as U

    below = F.startswith(U.path(F.col("to")), F.concat(F.regexp_replace(U.path(section), "/$", ""), F.lit("/"))) & (F.length(U.path(F.col("to"))) > F.length(F.regexp_replace(U.path(section), "/$", "")) + 1)
    fresh = links.filter(U.same_site(section, F.col("to")) & below & ~F.col("in_navigation")).join(previous, ["page_id", "to"], "left_anti")
    return fresh.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy("to"))).filter(F.col("place") <= most)


def lines_kept(lines: Column) -> Column:
    return without_repeats(lines)
