"""Rules on the quality of documents, with DataFrame functions only.

Base rules count words, signs, repeated lines and repeated runs of words inside a document. Then lines are compared across the
documents of a host: normalised lines are hashed, the documents that hold each are counted per host, and lines above the limits,
menus and notices for the most part, are removed. A document of which too little is left is rejected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, cut

#: Words that a document needs, before and after lines are removed.
LEAST_WORDS = 50
#: Hundredths of the words that repeated runs may cover.
MOST_REPEATED = 50
#: A line is removed where it stands in more documents of a host than this, and in more than this share of the host's documents.
DOCUMENTS, SHARE = 10, 0.001
#: Share of its words that a document may lose.
MOST_LOST = 0.5


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{WHITE}+"), "")


def has_word(line: Column) -> Column:
    return F.rlike(line, F.lit(r"[^\x20\x09-\x0D]"))


def normalised(line: Column) -> Column:
    """A line for comparison: case, digits and white space do not tell it from another."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, "[0-9]+", "0"), f"{WHITE}+", " ")))


def repeated_words(words: Column) -> Column:
    """How many of words stand in a run of three that the words hold twice or more.

    Runs are sorted by 32 bits of their hash, with their places in the other 32; those with a neighbour of one hash are compared
    by their words. What is left are the places of repeated runs, and each adds what the one before it has not covered.
    """
    run = lambda p: F.array_join(F.slice(words, p + 1, 3), " ")
    hashed = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda p: F.shiftleft(F.hash(F.get(words, p), F.get(words, p + 1), F.get(words, p + 2)).cast("long"), 32).bitwiseOR(p.cast("long")))
    near = lambda all_, k, same: F.coalesce(same(F.get(all_, k - 1)), F.lit(False)) | F.coalesce(same(F.get(all_, k + 1)), F.lit(False))
    high = lambda x: F.shiftright(x, 32)
    alike = let(F.sort_array(hashed), lambda s: F.filter(s, lambda x, k: near(s, k, lambda y: high(y) == high(x))))
    named = lambda places: F.sort_array(F.transform(places, lambda x: let(x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"), lambda p: F.struct(run(p).alias("run"), p.alias("p")))))
    equal = let(named(alike), lambda s: F.filter(s, lambda x, k: near(s, k, lambda y: y["run"] == x["run"])))
    covered = let(F.sort_array(F.transform(equal, lambda x: x["p"])), lambda at: F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3)))))
    return F.when(F.size(words) > 3, F.aggregate(covered, F.lit(0).cast("long"), lambda a, b: a + b)).otherwise(F.lit(0).cast("long"))


def measured(docs: DataFrame, host: Column, text: bool) -> DataFrame:
    """row, doc_id, host, the base counts, and the lines with a word: place, words and 128 bits of hashes of the normalised line. text: whether the text comes along."""
    whole = F.coalesce(docs["text"], F.lit(""))
    counts = let(words_of(whole), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    split = F.split(whole, "\n")
    lines = F.filter(F.transform(split, lambda x, k: F.struct(x.alias("line"), k.alias("place"))), lambda x: has_word(x["line"]))
    twice = let(F.filter(split, has_word), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    name = lambda x, at: let(normalised(x), lambda n: F.struct(at.alias("place"), F.size(words_of(x)).alias("words"), F.xxhash64(F.lit(1), n).alias("a"), F.xxhash64(F.lit(2), n).alias("b")))
    read = docs.select(docs["doc_id"], host.alias("host"), whole.alias("text"), counts.alias("counts"), twice.alias("n_dup_lines"), F.transform(lines, lambda x: name(x["line"], x["place"])).alias("lines"))
    return read.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "host", "counts.n_words",
        (F.char_length("text") - F.regexp_count("text", F.lit(WHITE))).cast("long").alias("word_chars"), F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        "n_dup_lines", "counts.n_repeat_words", "lines", *(["text"] if text else []),
    )


def common_lines(rows: DataFrame, documents: int = DOCUMENTS, share: float = SHARE) -> DataFrame:
    """host, a, b of the lines that stand in more than `documents` rows of a host and in more than `share` of them. Counts are combined before they move, so a line or host of any frequency is a row a task."""
    once = rows.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: F.concat_ws(" ", x["a"], x["b"])))).alias("line"))
    once = once.select("host", *(F.split("line", " ")[k].cast("long").alias(c) for k, c in enumerate("ab")))
    counted = once.groupBy("host", "a", "b").agg(F.count("*").alias("n")).filter(F.col("n") > documents)
    hosts = rows.groupBy(F.col("host").alias("of")).agg(F.count("*").alias("docs"))
    return counted.join(hosts, F.col("host").eqNullSafe(F.col("of"))).filter(F.col("n") > share * F.col("docs")).select("host", "a", "b")


def quality_rules(docs: DataFrame, host: str = "source", documents: int = DOCUMENTS, share: float = SHARE, text: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_lines, removed_words, kept; with text, also the text without the lines removed.

    A document fails the base rules with fewer than 50 words, or if repeated runs of three words cover over half of them. Lines
    that stand in more than `documents` documents of a host, and in more than `share` of them, are removed; a document is
    rejected if fewer than 50 words are left, or less than half. A row is a document: rows that repeat an id or a text count
    each. A null host is a host of its own. A null text is an empty one, which has no word and fails. Texts and lines of any
    length are read whole. An empty table gives no rows. Other columns are not read, so their names cannot clash.
    """
    rows = cut(measured(docs, docs[host], text))
    common = cut(common_lines(rows, documents, share))
    lines = rows.select("row", "host", F.explode("lines").alias("line")).select("row", "host", "line.*")
    same = lines["host"].eqNullSafe(common["host"]) & (lines["a"] == common["a"]) & (lines["b"] == common["b"])
    gone = lines.join(common, same).groupBy("row").agg(F.count("*").alias("removed_lines"), F.sum("words").alias("removed_words"), *([F.collect_list("place").alias("places")] if text else []))
    none = F.lit(0).cast("long")
    found = rows.join(gone, "row", "left").withColumns({c: F.coalesce(c, none) for c in ("removed_lines", "removed_words")})
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    kept = ~failed & (left >= LEAST_WORDS) & (F.col("removed_words") <= MOST_LOST * F.col("n_words"))
    out = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "removed_lines", "removed_words", kept.alias("kept")]
    if text:
        rest = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.coalesce("places", F.array().cast("array<int>")))
        out.append(let(F.split("text", "\n"), lambda x: F.array_join(F.transform(rest(x), lambda k: F.get(x, k)), "\n")).alias("text"))
    return found.select(*out)
