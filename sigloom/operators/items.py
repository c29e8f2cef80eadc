"""Operators over items: search, rules, deduplication, state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_ci
from ..staging import cut_dense as cut

BROADCAST_RULES = 10_000


def search(items: DataFrame, text: str = "", source_id: str | None = None, source_kind: str | None = None, state: str | None = None, after=None) -> DataFrame:
    """Items for which all given hold; every word of text has to stand in title, content, author or URL, A-Z in any case. `after` is strict, and fails where nothing was published."""
    out = items
    for column, value in (("source_id", source_id), ("source_kind", source_kind), ("state", state)):
        out = out.filter(F.col(column) == value) if value is not None else out
    out = out.filter(F.col("published_at") > after) if after is not None else out
    hay = F.concat_ws(" ", "title", "content_text", F.coalesce("author", F.lit("")), F.coalesce("canonical_url", F.lit("")))
    for word in text.split():
        out = out.filter(contains_ci(hay, F.lit(word)))
    return out


def hydrated(items: DataFrame, states: DataFrame) -> DataFrame:
    """Items with their state; one that has none is unseen."""
    return items.join(states.select("item_id", "state"), "item_id", "left").withColumn("state", F.coalesce("state", F.lit("unseen")))


def rule_matches() -> Column:
    """Whether an item fits a rule; both stand in one row. What a rule leaves out fits all; `published_after` includes its own time."""
    fits = lambda rule, hit: F.col(rule).isNull() | F.coalesce(hit, F.lit(False))
    return (
        F.col("enabled")
        & fits("source_filter", F.col("source_id") == F.col("source_filter"))
        & fits("kind_filter", F.col("source_kind") == F.col("kind_filter"))
        & fits("title_pattern", contains_ci(F.col("title"), F.col("title_pattern")))
        & fits("content_pattern", contains_ci(F.col("content_text"), F.col("content_pattern")))
        & fits("url_pattern", contains_ci(F.col("canonical_url"), F.col("url_pattern")))
        & fits("author_pattern", contains_ci(F.col("author"), F.col("author_pattern")))
        & fits("published_after", F.col("published_at") >= F.col("published_after"))
    )


def apply_rules(items: DataFrame, rules: DataFrame) -> DataFrame:
    """One execution per new item and rule, skipped ones too. That is what the log is: items times rules. Rules are what users
    have written; they are broadcast if there are no more of them than BROADCAST_RULES, which is looked at first."""
    for c in ("content_pattern", "url_pattern"):
        rules = rules if c in rules.columns else rules.withColumn(c, F.lit(None).cast("string"))
    few = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    return items.crossJoin(F.broadcast(rules) if few else rules).select("item_id", "rule_id", "action", F.when(rule_matches(), "matched").otherwise("skipped").alias("result"))


#: What a rule may ask of an item: its columns, and those of the item; by equality, or by a text that the item's holds.
EQUAL = {"source_filter": "source_id", "kind_filter": "source_kind"}
HELD = {"title_pattern": "title", "url_pattern": "canonical_url", "author_pattern": "author", "content_pattern": "content_text"}


def _pieces(text: Column) -> Column:
    """The runs of three signs of a text, A-Z lower-cased; those of a pattern stand in every text that holds it."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.length(low) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda k: F.substring(low, k, F.lit(3)))))


def matched_rules(items: DataFrame, rules: DataFrame) -> DataFrame:
    """item_id, rule_id, action of the rules that items match, as apply_rules() finds them, for any number of rules.

    Each enabled rule is filed under what it asks for that fewest items have: a source, a kind, or three signs in a row of one of
    its patterns; the content's only if it asks for nothing else. Items fetch the rules under what they have, and those are
    checked whole. A rule that asks for none of these (nothing, a time, or patterns of one or two signs) is put to all items, as
    it may match them all. item_id and rule_id tell rows apart; nulls and empty tables are fine.
    """
    for c in HELD:
        rules = rules if c in rules.columns else rules.withColumn(c, F.lit(None).cast("string"))
    rules = rules.filter("enabled")
    one = lambda c: F.when(c.isNotNull(), F.array(c.cast("string")))
    light = [F.struct(F.lit(name).alias("field"), one(F.col(name)).alias("tokens")) for name in EQUAL] + [F.struct(F.lit(name).alias("field"), _pieces(F.col(name)).alias("tokens")) for name in HELD if name != "content_pattern"]
    asked = F.flatten(F.transform(F.array(*light), lambda f: F.transform(F.coalesce(f["tokens"], F.array().cast("array<string>")), lambda t: F.struct(f["field"].alias("field"), t.alias("token")))))
    last = F.transform(F.coalesce(_pieces(F.col("content_pattern")), F.array().cast("array<string>")), lambda t: F.struct(F.lit("content_pattern").alias("field"), t.alias("token")))
    none = F.array(F.struct(F.lit("").alias("field"), F.lit("").alias("token")))
    ways = F.when(F.size(asked) > 0, asked).when(F.size(last) > 0, last).otherwise(none)
    keys = cut(rules.select("rule_id", F.explode(ways).alias("k")).select("rule_id", "k.field", "k.token"))
    wanted = keys.select("field", "token").distinct()
    has = items.select("item_id", F.lit("").alias("field"), F.lit("").alias("token"))
    for name, column in EQUAL.items():
        has = has.unionByName(items.select("item_id", F.lit(name).alias("field"), F.col(column).cast("string").alias("token")))
    for name, column in HELD.items():
        has = has.unionByName(items.select("item_id", F.lit(name).alias("field"), F.explode(_pieces(F.col(column))).alias("token")))
    has = cut(has.join(wanted, ["field", "token"], "left_semi"))
    counts = has.groupBy("field", "token").agg(F.count("*").alias("n"))
    filed = keys.join(counts, ["field", "token"], "left").groupBy("rule_id").agg(F.min_by(F.struct("field", "token"), F.struct(F.coalesce("n", F.lit(0)), "field", "token")).alias("k"))
    met = has.join(filed.select("rule_id", "k.field", "k.token"), ["field", "token"]).select("item_id", "rule_id")
    return met.join(items, "item_id").join(rules, "rule_id").filter(rule_matches()).select("item_id", "rule_id", "action")


def deduplicated(observed: DataFrame) -> DataFrame:
    """What becomes of observed items in order of arrival (`seq`): `new`, `fingerprint` (seen just so), or `identity` (the same
    item told otherwise), and the item it stands for. A fingerprint is looked for before an identity. Groups are kept by grouped
    minima, which combine before they move, so an item seen a billion times is no hot spot."""
    by_print = observed.groupBy("fingerprint").agg(F.min("seq").alias("print_seq"))
    by_identity = observed.groupBy("canonical_identity").agg(F.min("seq").alias("identity_seq"))
    seen = observed.join(by_print, "fingerprint").join(by_identity, "canonical_identity")
    outcome = F.when(F.col("print_seq") < F.col("seq"), "fingerprint").when(F.col("identity_seq") < F.col("seq"), "identity").otherwise("new")
    return seen.select("seq", outcome.alias("outcome"), F.when(outcome == "fingerprint", F.least("print_seq", "identity_seq")).when(outcome == "identity", F.col("identity_seq")).otherwise(F.col("seq")).alias("item_seq"))


def latest(rows: DataFrame, key: str, order: str, *also: str) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), *[F.desc(c) for c in also]))).filter("k = 1").drop("k")


def transitions(log: DataFrame) -> DataFrame:
    """The state of each item after its transitions, and when it first came into each."""
    return log.groupBy("item_id").agg(F.max_by("state", F.struct("at", "seq")).alias("state"), F.max("at").alias("updated_at"), F.countDistinct("state").alias("states"))


def upsert(table: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """The table after the changes: of each key the row of the highest version."""
    return latest(table.unionByName(changes), key, version)


def insert_absent(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The rows whose keys the table does not have."""
    return rows.join(table.select(key).distinct(), key, "left_anti")
