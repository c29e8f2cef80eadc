"""Operators over signals, evidence, connections and contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions.text import case


def best_connections(connections: DataFrame) -> DataFrame:
    """One connection per signal and target: a match before a via, then the stronger, then the earlier."""
    via = F.when(F.col("relation") == "via", 1).otherwise(0)
    return connections.withColumn("k", F.row_number().over(Window.partitionBy("signal_id", "target_id").orderBy(via, F.desc("strength"), "connection_id"))).filter("k = 1").drop("k")


def context_edges(connections: DataFrame) -> DataFrame:
    """Edges of the context graph: a match makes the edge one and raises it to its strength; the first edge's strength can survive."""
    matched = F.when(F.col("relation") == "matches", F.col("strength"))
    return connections.groupBy(F.col("target_id").alias("context_id"), "signal_id").agg(
        F.when(F.bool_or(F.col("relation") == "matches"), "matches").otherwise("via").alias("relation"),
        F.greatest(F.min_by("strength", F.struct("connection_id", "strength")), F.coalesce(F.max(matched), F.lit(0.0))).alias("strength"),
    )


def subject_nodes(signals: DataFrame, evidence: DataFrame) -> DataFrame:
    items = evidence.select("signal_id", "item_id").distinct()
    seen = signals.join(items, "signal_id", "left")
    return seen.groupBy("subject_key").agg(F.countDistinct("signal_id").alias("signals"), F.countDistinct("item_id").alias("observations"), F.min_by("topic", "signal_id").alias("label"))


def patterns(connections: DataFrame, signals: DataFrame) -> DataFrame:
    matched = connections.filter("relation = 'matches'").select("signal_id", "target_id").distinct()
    contexts = matched.groupBy(F.col("target_id").cast("long").alias("id")).agg(F.lit("context").alias("over"), F.count("*").alias("signals"))
    topics = signals.groupBy("topic").agg(F.min(F.col("signal_id") % 13).alias("id"), F.lit("topic").alias("over"), F.count("*").alias("signals")).drop("topic")
    return contexts.unionByName(topics).filter("signals >= 2")


def observations(evidence: DataFrame) -> DataFrame:
    """The items of each signal: whether they dispute it, and when they came."""
    return evidence.groupBy("signal_id", "item_id").agg(F.bool_or(F.col("claim") == "contradiction").alias("disputes"), F.min("observed_at").alias("first_at"))


def timeline_roles(evidence: DataFrame) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("signal_id").orderBy("first_at", "item_id"))
    kind = F.when(place == 1, "observed").when(F.col("disputes"), "disputed").otherwise("corroborated")
    return observations(evidence).select("signal_id", "item_id", F.col("first_at").alias("at"), kind.alias("kind"))


def round_robin(evidence: DataFrame, most: int = L.SIGNAL_EVIDENCE) -> DataFrame:
    """Evidence of each signal within its budget: distinct rows, the earliest of every kind of claim, then the second ones, and so on."""
    rank = case(F.col("claim"), L.CLAIM_PRIORITY, 9)
    copies = Window.partitionBy("signal_id", "item_id", "claim", "excerpt").orderBy("observed_at", "evidence_id")
    distinct = evidence.withColumn("rank", rank).withColumn("copy", F.row_number().over(copies)).filter("copy = 1").drop("copy")
    rounds = distinct.withColumn("round", F.row_number().over(Window.partitionBy("signal_id", "rank").orderBy("observed_at", "evidence_id")).cast("long"))
    return rounds.withColumn("place", F.row_number().over(Window.partitionBy("signal_id").orderBy("round", "rank")).cast("long")).filter(F.col("place") <= most)


def neighbours_by(contexts: DataFrame, family: str) -> DataFrame:
    """Edges (a, b) both ways between contexts of one family."""
    a, b = (contexts.select(F.col("context_id").alias(x), family) for x in "ab")
    return a.join(b, family).filter("a <> b").select("a", "b")


def via_connections(connections: DataFrame, edges: DataFrame) -> DataFrame:
    """Contexts next to those a signal matches, at half the strength of the strongest such match; not where a connection is already."""
    matched = connections.filter("relation = 'matches'").groupBy("signal_id", F.col("target_id").alias("a")).agg(F.max("strength").alias("strength"))
    near = matched.join(edges, "a").groupBy("signal_id", F.col("b").alias("target_id")).agg(F.round(F.max("strength") * 0.5, 6).alias("strength"))
    return near.join(connections.select("signal_id", "target_id").distinct(), ["signal_id", "target_id"], "left_anti")


def timeline(evidence: DataFrame, signals: DataFrame, sources: DataFrame, connections: DataFrame, contexts: DataFrame, insights: DataFrame) -> DataFrame:
    """signal_id, at, kind, ref: what happened to signals, of seven kinds. sources and contexts: source_id or context_id, and at
    when they came; they stand once for every signal that they are behind. insights: signal_id, insight_id, at."""
    seen = timeline_roles(evidence).select("signal_id", "at", "kind", F.col("item_id").alias("ref"))
    made = signals.select("signal_id", F.col("created_at").alias("at"), F.lit("signal_created").alias("kind"), F.col("signal_id").alias("ref"))
    added = evidence.select("signal_id", "source_id").distinct().join(sources, "source_id").select("signal_id", "at", F.lit("source_added").alias("kind"), F.col("source_id").alias("ref"))
    named = connections.filter("relation = 'matches'").select("signal_id", F.col("target_id").alias("context_id")).distinct()
    cared = named.join(contexts, "context_id").select("signal_id", "at", F.lit("context_added").alias("kind"), F.col("context_id").alias("ref"))
    saved = insights.select("signal_id", "at", F.lit("insight_saved").alias("kind"), F.col("insight_id").alias("ref"))
    out = seen.withColumn("at", F.col("at").cast("timestamp_ntz"))
    for more in (made, added, cared, saved):
        out = out.unionByName(more.withColumn("at", F.col("at").cast("timestamp_ntz")))
    return out


def is_meaningful(primary: Column, matched: Column, consolidates: Column, fresh: Column, kind: Column) -> Column:
    """Whether an item is worth a signal: its user's own URL, a context that matches, a change that is known, or a concrete change that is fresh."""
    return primary | matched | consolidates | (fresh & (kind != "describes"))


def bundle_pairs(signals: DataFrame, evidence: DataFrame, relations: DataFrame, connections: DataFrame) -> DataFrame:
    """a, b, relation: how the signals of a bundle (signal_id, place; eight at most) relate: as items of theirs do, in either
    direction, else by a context that both match. Of several relations the first by name stands."""
    own = evidence.join(F.broadcast(signals), "signal_id").select("item_id", "place").distinct()
    ends = relations.join(own.select(F.col("item_id").alias("from_item"), F.col("place").alias("x")), "from_item").join(own.select(F.col("item_id").alias("to_item"), F.col("place").alias("y")), "to_item")
    told = ends.filter("x <> y").select(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), F.lit(0).alias("rank"), "relation")
    held = connections.filter("relation = 'matches'").join(F.broadcast(signals), "signal_id").select("target_id", "place").distinct()
    both = held.select("target_id", F.col("place").alias("i")).join(held.select("target_id", F.col("place").alias("j")), "target_id").filter("i < j")
    met = told.unionByName(both.select("i", "j", F.lit(1).alias("rank"), F.lit("shared_context").alias("relation"))).groupBy("i", "j").agg(F.min(F.struct("rank", "relation"))["relation"].alias("relation"))
    a, b = (signals.select(F.col("signal_id").alias(x), F.col("place").alias(y)) for x, y in ("ai", "bj"))
    return met.join(F.broadcast(a), "i").join(F.broadcast(b), "j").select("a", "b", "relation")


def signal_detail(evidence: DataFrame, connections: DataFrame, insights: DataFrame) -> DataFrame:
    """signal_id with the items that observed it in the order they came, its claims in their order, the contexts it matches, and the insights that cite it (signal_id, insight_id)."""
    items = observations(evidence).groupBy("signal_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first_at", "item_id"))), lambda x: x["item_id"]).alias("items"))
    rank = case(F.col("claim"), L.CLAIM_PRIORITY)
    claims = evidence.select("signal_id", "claim", rank.alias("rank")).distinct().groupBy("signal_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "claim"))), lambda x: x["claim"]).alias("claims"))
    contexts = connections.filter("relation = 'matches'").groupBy("signal_id").agg(F.array_sort(F.collect_set("target_id")).alias("contexts"))
    cited = insights.groupBy("signal_id").agg(F.array_sort(F.collect_set("insight_id")).alias("insights"))
    return items.join(claims, "signal_id", "left").join(contexts, "signal_id", "left").join(cited, "signal_id", "left")
