"""Records that observation and use leave behind: observations, contexts, surfaces, stages, statuses, runs, and how they are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions.text import slug

# The stages a source goes through, in order.
STAGES = ("queued", "fetching", "understanding", "connecting", "building_signal", "observed", "failed")


def observation_records(observed: DataFrame) -> DataFrame:
    """One row per item and original identifier (`key`), the latest observation of it, and how often it was observed."""
    return observed.groupBy(F.concat_ws(":", "item_id", "original_identifier").alias("key"), "item_id").agg(F.max_by("source_id", F.struct("observed_at", "seq")).alias("source_id"), F.max("observed_at").alias("observed_at"), F.count("*").alias("times"))


def merged_contexts(entries: DataFrame) -> DataFrame:
    """Contexts by the slug of their name: the last kind and description that was given, and all aliases and related ids."""
    known = entries.withColumn("name_key", slug(F.col("name"))).filter("name_key <> ''")
    at = F.struct("seq")
    return known.groupBy("name_key").agg(
        F.min_by("name", at).alias("name"), F.max_by("kind", at).alias("kind"),
        F.max_by("description", F.struct((F.col("description") != "").alias("told"), F.col("seq"))).alias("description"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"),
    )


def reevaluated(signals: DataFrame, matches: DataFrame, connections: DataFrame, most: int = 200) -> DataFrame:
    """New connections of open signals to a context that was added: what matches (signal_id, target_id, strength) and is not connected yet; the newest signals only."""
    open_ = signals.filter("status = 'open'").orderBy(F.desc("created_at"), "signal_id").limit(most).select("signal_id")
    return matches.join(open_, "signal_id", "left_semi").join(connections.filter("relation = 'matches'").select("signal_id", "target_id").distinct(), ["signal_id", "target_id"], "left_anti")


def registered_surfaces(known: DataFrame, found: DataFrame) -> DataFrame:
    """Surfaces (target_id, url, at) after a discovery: new ones are registered, known ones confirmed."""
    both = known.select("target_id", "url", "at").unionByName(found.select("target_id", "url", "at"))
    return both.groupBy("target_id", "url").agg(F.min("at").alias("discovered_at"), F.max("at").alias("last_confirmed_at"), F.count("*").alias("confirmations"))


def stages(log: DataFrame) -> DataFrame:
    """The stage each source has come to in its last run (source_id, run, stage), and whether it went back without failing, which it must not."""
    rank = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage"))
    last = log.withColumn("rank", rank).groupBy("source_id", "run").agg(F.max("rank").alias("rank"), F.bool_or(F.col("stage") == "failed").alias("failed"))
    return last.groupBy("source_id").agg(F.max_by(F.struct("rank", "failed"), "run").alias("s"), F.max("run").alias("run")).select("source_id", "run", F.element_at(F.array(*[F.lit(s) for s in STAGES]), F.col("s.rank").cast("int")).alias("stage"), "s.failed")


def statuses(base: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """The status of each row after events (key, status, seq): the last wins, and rows without events keep theirs."""
    last = events.groupBy(key).agg(F.max_by("status", "seq").alias("now"))
    return base.join(last, key, "left").select(key, F.coalesce("now", "status").alias("status"))


def saved_statement(statements: DataFrame) -> DataFrame:
    """What of an answer is saved as an insight: its first inferred statement, else its first, with all evidence it cites."""
    order = F.struct((F.col("basis") != "inferred").alias("other"), F.col("place"))
    return statements.groupBy("answer_id").agg(F.min_by("text", order).alias("statement"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence_ids")))).alias("evidence_ids"))


def prior_candidates(shared: DataFrame, most: int = 12) -> DataFrame:
    """Priors that share terms with an item, the most first, as many as a model is shown."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("shared"), "prior_id"))
    return shared.filter("shared > 0").withColumn("place", place).filter(F.col("place") <= most)


def card(ranked: DataFrame) -> DataFrame:
    """Signals as text: place, what, from how many sources, and why."""
    line = F.concat(F.lit("#"), F.col("position").cast("string"), F.lit(" "), F.col("subject"), F.lit(" · "), F.col("change_kind"), F.lit(" · "), F.col("sources").cast("string"), F.lit(" sources"))
    return ranked.select("position", line.alias("card"))


def envelope(rows: DataFrame) -> DataFrame:
    """Rows as JSON, nulls left out, as callers outside Spark get them."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


def label(status: Column, surfaces: Column) -> Column:
    """What is being watched, in words."""
    return F.when(status == "paused", "Paused").when(surfaces == 0, "Looking for information surfaces").otherwise(F.concat(F.lit("Watching "), surfaces.cast("string"), F.lit(" surface"), F.when(surfaces == 1, "").otherwise("s")))


def pass_record(due: DataFrame, found: DataFrame) -> DataFrame:
    """The record of one pass: how many sources were due and observed, what is new, and what failed. found: source_id, status, new_items."""
    met = due.select("source_id").join(found, "source_id", "left")
    return met.agg(
        F.countDistinct("source_id").alias("due"), F.countDistinct(F.when(F.col("status").isNotNull(), F.col("source_id"))).alias("observed"),
        F.coalesce(F.sum("new_items"), F.lit(0)).cast("long").alias("new_items"), F.count_if(F.col("status") == "failed").alias("failures"),
    )
