"""Terms of texts and what is computed from them: weights, topics, similar items, novel details."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions import text as T


def term_head(content: Column, most: int = 4000) -> Column:
    """The first `most` bytes of content, or all of it where that would cut a character: as much as terms are taken from."""
    head = F.substring(content.cast("binary"), 1, most)
    return F.when(F.octet_length(content) <= most, content).when(F.is_valid_utf8(head.cast("string")), head.cast("string")).otherwise(content)


def key_terms(items: DataFrame, most: int, keep: str = "item_id") -> DataFrame:
    """keep, term, weight, place, many: the terms of each item by weight (3 a time in the title, 1 in the content), then by first
    place, and how many terms the item has here. Tokens are judged and stemmed after they are exploded, as generated code."""
    title = T.tokens(F.col("title"))
    words = items.select(keep, F.size(title).alias("titled"), F.concat(title, T.tokens(term_head(F.col("content_text")))).alias("words"))
    # what stands beside the explosion in one select would be computed for every token
    at = words.select(keep, "titled", F.posexplode("words").alias("at", "t")).filter(T.is_term(F.col("t")))
    weights = at.groupBy(keep, T.stemmed(F.col("t")).alias("term")).agg(F.sum(F.when(F.col("at") < F.col("titled"), 3.0).otherwise(1.0)).alias("weight"), F.min("at").alias("first"))
    own = Window.partitionBy(keep)
    kept = weights.withColumn("place", F.row_number().over(own.orderBy(F.desc("weight"), "first")).cast("long")).filter(F.col("place") <= most)
    return kept.select(keep, "term", "weight", "place", F.count("*").over(own).alias("many"))  # after the limit, which is applied before rows move


def topic_scores(items: DataFrame) -> DataFrame:
    """item_id, topic, score: how often the phrases of each topic stand in the title (3) and in the first 80 sentences (1 each)."""
    sentences = F.slice(T.sentences(F.col("content_text")), 1, 80)
    padded = lambda s: F.concat(F.lit(" "), F.array_join(T.stems(s), " "), F.lit(" "))
    ready = items.select("item_id", padded(F.col("title")).alias("head"), F.transform(sentences, padded).alias("body"))
    phrases = items.sparkSession.createDataFrame([(i, k, p) for i, (k, ps) in enumerate(L.TOPICS.items()) for p in ps], "rank int, topic string, phrase string")
    phrases = phrases.select("rank", "topic", F.concat(F.lit(" "), F.array_join(T.stems(F.col("phrase")), " "), F.lit(" ")).alias("needle"))
    held = ready.crossJoin(F.broadcast(phrases))  # as many rows an item as the lexicon has phrases, a fixed number
    score = F.when(F.contains("head", "needle"), 3.0).otherwise(0.0) + F.size(F.filter("body", lambda s: F.contains(s, F.col("needle"))))
    return held.groupBy("item_id", "rank", "topic").agg(F.sum(score).alias("score")).filter("score > 0")


def topics(items: DataFrame) -> DataFrame:
    """The topic of most score, the first of equals; what none speaks for gets one by its kind of source."""
    best = topic_scores(items).groupBy("item_id").agg(F.max_by("topic", F.struct("score", -F.col("rank"))).alias("topic"), F.max("score").alias("score"))
    other = T.case(F.col("source_kind"), L.TOPIC_OF_KIND, "General")
    out = items.select("item_id", "source_kind").join(best, "item_id", "left")
    confidence = F.when(F.col("score").isNull(), 0.1).otherwise(F.least(F.lit(1.0), F.col("score") / 8.0))
    return out.select("item_id", F.coalesce("topic", other).alias("topic"), F.round(confidence, 3).alias("confidence"))


def similar(items: DataFrame, prior: DataFrame, most_terms: int = 18, most_links: int = 8) -> DataFrame:
    """item_id, prior_id, shared, overlap, kind: links to earlier items by shared terms, the strongest first. The terms of the
    priors are as many as PRIORS times most_terms, and are broadcast as that bound is set; priors are the newest items (published_at), those without a time last, of equals the first by id."""
    own = key_terms(items, most_terms).select("item_id", "term", F.col("many").alias("n"))
    old = key_terms(prior.orderBy(F.desc_nulls_last("published_at"), "item_id").limit(L.PRIORS), most_terms).select(F.col("item_id").alias("prior_id"), "term", F.col("many").alias("m"))
    pairs = own.join(F.broadcast(old), "term").filter("item_id <> prior_id").groupBy("item_id", "prior_id").agg(F.count("*").alias("shared"), F.max("n").alias("n"), F.max("m").alias("m"))
    overlap = F.round(F.col("shared").cast("double") / F.greatest(F.lit(1), F.least("n", "m")), 6)
    kind = F.when((F.col("overlap") >= 0.45) & (F.col("shared") >= 5), "same_change").when((F.col("overlap") >= 0.25) & (F.col("shared") >= 3), "related")
    linked = pairs.withColumn("overlap", overlap).withColumn("kind", kind).filter("kind IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("overlap"), "prior_id"))
    return linked.withColumn("place", place).filter(F.col("place") <= most_links).select("item_id", "prior_id", "shared", "overlap", "kind")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def quoted(text: str) -> str:
    """A pattern for the text itself."""
    return "".join(c if c.isalnum() or c == " " else f"\\{c}" for c in text)


#: Each verb of change with its kind; of several kinds the first.
KIND_OF = {v: k for k, vs in reversed(L.CHANGE_VERBS.items()) for v in vs}
#: Any of them with no letter or digit next to it; of those at one place the first in the list.
VERB = rf"(?<![{T.WORD_CHARS}])({'|'.join(quoted(v) for vs in L.CHANGE_VERBS.values() for v in vs)})(?![{T.WORD_CHARS}])"


def verb(text: Column) -> Column:
    """The first verb of change as (kind, verb, at from 1), null where there is none, or where lower case has another length."""
    found = lambda low: let(F.regexp_extract(low, VERB, 1), lambda v: F.when(v != "", F.struct(T.case(v, KIND_OF).alias("kind"), v.alias("verb"), F.regexp_instr(low, F.lit(VERB)).alias("at"))))
    return let(F.lower(text), lambda low: F.when(F.octet_length(low) == F.octet_length(text), found(low)))


def change_verbs(texts: DataFrame, keep: str, column: str) -> DataFrame:
    """keep, kind, verb: the verb of change that stands first in each text, the first in the list of equals."""
    return texts.select(keep, verb(F.col(column)).alias("f")).filter("f IS NOT NULL").select(keep, "f.kind", "f.verb")


def surface_forms(items: DataFrame) -> DataFrame:
    """item_id, stem, form: for each stem of an item the form in which it is written first, title before content."""
    words = lambda c: F.transform(F.split(F.col(c), rf"[^{T.WORD_CHARS}\-']+"), lambda w: F.btrim(w, F.lit("-'")))
    at = items.select("item_id", F.posexplode(F.concat(words("title"), words("content_text"))).alias("at", "word")).filter("word <> ''")
    first = at.groupBy("item_id", "word").agg(F.min("at").alias("at"))
    return first.groupBy("item_id", T.stem(F.col("word")).alias("stem")).agg(F.min_by("word", "at").alias("form"))


def disputes(items: DataFrame) -> DataFrame:
    """item_id, place of the sentences (0 is the title) that deny something, in whole words."""
    said = F.concat(F.array("title"), F.slice(T.sentences(F.col("content_text")), 1, 80))
    denial = "|".join(re.escape(d) for d in L.DENIALS)
    return items.select("item_id", F.posexplode(said).alias("place", "sentence")).filter(F.lower("sentence").rlike(rf"(?<![{T.WORD_CHARS}])(?:{denial})(?![{T.WORD_CHARS}])")).select("item_id", "place")


def stances(links: DataFrame, items: DataFrame, own: DataFrame) -> DataFrame:
    """links (item_id, prior_id) with the stance of the item: it contradicts where a sentence that denies holds a term that both
    share (own: item_id, term), else it supports."""
    said = items.select("item_id", F.posexplode(F.concat(F.array("title"), F.slice(T.sentences(F.col("content_text")), 1, 80))).alias("place", "sentence"))
    denying = said.join(disputes(items), ["item_id", "place"], "left_semi").select("item_id", F.explode(F.array_distinct(T.stems(F.col("sentence")))).alias("term")).distinct()
    shared = links.select("item_id", "prior_id").join(own, "item_id").join(own.select(F.col("item_id").alias("prior_id"), "term"), ["prior_id", "term"])
    against = shared.join(denying, ["item_id", "term"], "left_semi").select("item_id", "prior_id").distinct().withColumn("against", F.lit(True))
    return links.join(against, ["item_id", "prior_id"], "left").withColumn("stance", F.when(F.col("against"), "contradicts").otherwise("supports")).drop("against")
