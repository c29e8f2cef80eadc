"""URL filtering by pattern rules that are fetched through their rarest literal token, with DataFrame functions only.

Each rule is a regular expression over host and path, and names literal tokens that stand as whole tokens in everything it
can match. How often those tokens occur in the URLs is counted, and a rule is filed under its rarest one. The tokens of a URL
fetch the rules filed under them, and only those run their expressions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A rule without literal tokens is filed under this one, which every URL has.
ALWAYS = ""

#: Up to so many rules, their index is broadcast; beyond that Spark chooses the join by size.
BROADCAST_RULES = 10_000


@dataclass(frozen=True)
class Rule:
    """name: what the result calls it; pattern: over host + path; literals: lower-case tokens that any match holds whole; rank: the highest of those that match decides."""

    name: str
    pattern: str
    verdict: str
    literals: tuple[str, ...]
    rank: int
    listed: bool = False


def place(name: str, verdict: str) -> Rule:
    """The rule that fits a host, its subdomains, and paths that start so. name: host and start of the path, like `example.org/en/`.
    The last token of the path is no literal where it may go on in the URL."""
    host, slash, path = name.partition("/")
    path = slash + path
    whole = path if re.search(r"[^a-zA-Z0-9]$", path) else re.sub(r"[a-zA-Z0-9]+$", "", path)
    literals = tuple(x for x in re.split("[^a-z0-9]+", f"{host}{whole}".lower()) if x)
    return Rule(name, rf"\A(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", verdict, literals, len(name), True)


def word(token: str, verdict: str = "block") -> Rule:
    """The rule for URLs that have a token, or tokens with `-` between them, anywhere in host or path."""
    return Rule(token, rf"(?i)(?:\A|[^a-z0-9]){token}(?:[^a-z0-9]|\z)", verdict, tuple(token.split("-")), 0)


#: The places that are allowed or blocked by name.
PLACES = (place("org/", "allow"), place("example.org/es/", "block"), place("example.org/en/1", "block"), place("com/fr/", "allow"), place("com/de/", "block"))
#: Expressions over host and path that mark unwanted pages where no place decides, and the whole tokens that each of their
#: matches holds. Several tokens are candidates; the rarest one in the URLs is what a rule is filed under. None repeats a group:
#: the engine would take a call a repetition, and a long URL would end the executor. (?> is taken once, so none is tried again.
PATTERNS = (
    ("adult hosts", r"(?i)\A(?:[^/]*[.])?adult-[a-z0-9]+[.]", ("adult",)),
    ("casino offers", r"(?i)(?:\A|[^a-z0-9])casino[^a-z0-9]+(?:[a-z0-9]+[^a-z0-9]+)?(?:bonus|offers?)(?:[^a-z0-9]|\z)", ("casino",)),
    ("cheap shops", r"(?i)\A(?:[^/]*[.])?cheap-[a-z0-9]+[.]example[.][a-z]+/[a-z]{2}/[0-9]+(?:/|\z)", ("cheap", "example")),
    ("farm hosts", r"(?i)\A(?:[^/]*[.])?[a-z0-9]+-farm[.]example[.](?:com|net|org)(?:/|\z)", ("farm", "example")),
    ("numbered spam", r"(?i)(?:\A|[.-])spam-[a-z]+[.][^/]*/(?:en|fr)/[0-9]{1,3}(?:/|\z)", ("spam",)),
    ("payday loans", r"(?i)(?:\A|[^a-z0-9])payday[^a-z0-9]+loans?(?:[^a-z0-9]|\z)", ("payday",)),
    ("replica watches", r"(?is)\A(?>(?:.*?[^a-z0-9])??replica[^a-z0-9])(?:.*[^a-z0-9])?watches(?:[^a-z0-9]|\z)", ("replica", "watches")),
)
#: Words of hosts and paths that mark unwanted pages.
WORDS = (*(Rule(name, pattern, "block", literals, 0) for name, pattern, literals in PATTERNS), *map(word, ("escort", "free-money", "porn", "viagra", "xxx")))


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty where it is null or has no `://`."""
    rest = F.when(F.coalesce(F.locate("://", url), F.lit(0)) > 0, F.regexp_replace(url, r"(?s)\A.*?://", "")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def tokens(address: Column) -> Column:
    """The tokens of an address, and ALWAYS."""
    return F.array_distinct(F.concat(F.array(F.lit(ALWAYS)), F.split(F.translate(address, UPPER, LOWER), "[^a-z0-9]+")))


def filed(urls: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """The rules, each under the rarest of its literal tokens. Counted over all urls; what comes to the driver is one count a literal."""
    spark = urls.sparkSession
    literals = sorted({x for r in rules for x in r.literals})
    names = _rows(spark, [(x,) for x in literals], "token string")
    found = urls.select(F.explode(tokens(F.concat("host", "path"))).alias("token")).join(_small(names, len(literals)), "token", "left_semi").groupBy("token").count()
    counts = {r["token"]: r["count"] for r in found.collect()}
    rows = [(min(r.literals, key=lambda x: (counts.get(x, 0), x), default=ALWAYS), r.name, r.pattern, r.verdict, r.rank, r.listed) for r in rules]
    return _rows(spark, rows, "token string, name string, pattern string, ruled string, rank int, listed boolean")


def _rows(spark: SparkSession, rows: list[tuple], fields: str) -> DataFrame:
    """A few rows as literals; no task has to read them from Python."""
    columns = [f.split() for f in fields.split(", ")]
    structs = [F.struct(*(F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(row, columns))) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs).cast("array<struct<" + ", ".join(f"{n}: {k}" for n, k in columns) + ">>")))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_RULES else df


def filter_urls(pages: DataFrame, places: tuple[Rule, ...] = PLACES, words: tuple[Rule, ...] = WORDS, otherwise: str = "allow") -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, word.

    A place that fits decides, the longest first (then block before allow, then by name); `rule` names it. Else the words
    decide: a URL with one of them is blocked, and `word` names the first by name; any other URL gets `otherwise`. A null URL
    and one without `://` have empty host and path, which no rule fits. Repeated rows and null ids give a row each, an empty
    table none. Columns but page_id and url are not read.
    """
    host, path = parts(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    rules = places + words
    index = filed(urls, rules)
    fetched = urls.withColumn("row", F.monotonically_increasing_id()).withColumn("token", F.explode(tokens(F.concat("host", "path"))))
    met = fetched.join(_small(index, len(rules)), "token", "left")
    fits = F.expr("coalesce(concat(host, path) rlike pattern, false)")
    best = lambda listed: F.min(F.when(fits & (F.col("listed") == listed), F.struct((-F.col("rank")).alias("rank"), (F.col("ruled") != "block").alias("mild"), F.col("name"), F.col("ruled"))))
    judged = met.groupBy("row", "page_id", "host", "path").agg(best(True).alias("place"), best(False).alias("word"))
    return judged.select(
        "page_id", "host", "path", F.col("place.name").alias("rule"), F.coalesce("place.ruled", "word.ruled", F.lit(otherwise)).alias("verdict"), F.col("word.name").alias("word")
    )
