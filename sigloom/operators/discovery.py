"""What is worth watching around a page: six ways to find surfaces, united.

What a crawler would fetch on the way is given as tables, so that all pages are served by the same few joins: the parsed pages
themselves, robots rules, locations of sitemaps, and which documents are known to be feeds. Nothing is gathered but the surfaces
of one page.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions import url as U
from ..functions.text import lit_array
from ..sources import feeds
from ..staging import cut

# How many surfaces, sections that are read for feeds, addresses that are tried and repositories a page may have.
SURFACES, SECTIONS, PROBES, REPOSITORIES = 30, 6, 6, 2
#: The ways in their order; of equal addresses the first way counts.
SEED, DECLARED, LINKED, REPOSITORY, SITEMAP, SECTION_FEED, CONVENTION = range(7)


def _surface(stage: int, place: Column, url: Column, kind: Column, adapter: Column, method: Column, confidence: Column, found_on: Column) -> list[Column]:
    told = {"place": place.cast("long"), "url": url, "kind": kind, "adapter": adapter, "method": method, "confidence": confidence, "found_on": found_on}
    return [F.col("page_id"), F.lit(stage).alias("stage"), *(c.alias(n) for n, c in told.items())]


def _first(surfaces: DataFrame) -> DataFrame:
    """The first surface of each address of a page."""
    rest = [c for c in surfaces.columns if c not in ("page_id", "url", "stage", "place")]
    best = surfaces.withColumn("url", F.coalesce(U.canonical(F.col("url")), "url")).groupBy("page_id", "url").agg(F.min(F.struct("stage", "place", *rest)).alias("s"))
    return best.select("page_id", "url", "s.*")


def _judged(surfaces: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds whether robots rules allow the address; those of other sites are not asked about."""
    at = surfaces.withColumns({"site": U.bare_host(F.col("url")), "path": U.path(F.col("url"))})
    verdicts = feeds.robots_allows(at.select("site", "path").distinct(), rules)
    return at.join(verdicts, ["site", "path"], "left").withColumn("allowed", F.col("allowed") | ~U.same_site(F.col("seed"), F.col("url"))).drop("site", "path")


def discovered(pages: DataFrame, rules: DataFrame, locations: DataFrame, known: DataFrame) -> DataFrame:
    """pages (as parsed; each is a seed), rules (site, verdict, prefix), locations (page_id, location), known (url, format): one row
    for each surface of a page, with the way that found it and, where it is left out, why (skipped). Pages without an address
    have none; null lists count as empty."""
    c, lit = F.col, F.lit
    # every way starts from the pages, which are parsed once
    seeds = cut(pages.filter("url IS NOT NULL").select("page_id", c("url").alias("seed"), "feeds", "links"))
    itself = F.coalesce(feeds.classified_link(c("seed"), c("seed"), lit(""))["kind"], lit("homepage"))
    own = seeds.select(*_surface(SEED, lit(0), c("seed"), itself, lit("web"), lit("seed"), lit("high"), c("seed")))
    declared = seeds.select("page_id", "seed", F.posexplode("feeds").alias("at", "f"))
    declared = declared.select(*_surface(DECLARED, c("at"), c("f.url"), lit("feed"), c("f.format"), lit("html_feed_declaration"), lit("high"), c("seed")))

    links = seeds.select("page_id", "seed", F.posexplode("links").alias("at", "l")).withColumn("repository", U.github_repository(c("l.url")))
    sections = links.filter("repository IS NULL").withColumn("s", feeds.classified_link(c("seed"), c("l.url"), c("l.text"))).filter("s IS NOT NULL")
    way = F.when(U.bare_host(c("seed")) == U.bare_host(c("l.url")), "navigation_link").otherwise("subdomain_link")
    linked = sections.select(*_surface(LINKED, c("at"), c("l.url"), c("s.kind"), lit("web"), way, c("s.confidence"), c("seed")))

    named = seeds.select("page_id", "seed", lit(-1).alias("at"), U.github_repository(c("seed")).alias("repository")).unionByName(links.select("page_id", "seed", "at", "repository")).filter("repository IS NOT NULL")
    few = named.groupBy("page_id", "repository").agg(F.min("at").alias("at"), F.max("seed").alias("seed"))
    few = few.withColumn("k", F.row_number().over(Window.partitionBy("page_id").orderBy("at"))).filter(c("k") <= REPOSITORIES)
    base = F.concat(lit("https://github.com/"), c("repository"))
    sure = F.when(c("at") == -1, "high").otherwise("medium")
    watched = lambda url, kind, adapter, sure: F.struct(url.alias("url"), lit(kind).alias("kind"), lit(adapter).alias("adapter"), sure.alias("sure"))
    both = F.array(watched(F.concat(base, lit("/releases.atom")), "releases", "atom", sure), watched(base, "repository", "web", lit("medium")))
    repositories = few.select("page_id", "seed", "k", F.posexplode(both).alias("n", "r"))
    repositories = repositories.select(*_surface(REPOSITORY, c("k") * 2 + c("n"), c("r.url"), c("r.kind"), c("r.adapter"), lit("github_surface"), c("r.sure"), c("seed")))

    listed = feeds.sitemap_sections(locations.join(seeds.select("page_id", "seed"), "page_id"), c("seed"), "page_id", "seed")
    listed = listed.select(*_surface(SITEMAP, -c("pages"), c("root"), c("kind"), lit("web"), lit("sitemap"), F.when(c("pages") >= 3, "high").otherwise("medium"), c("seed")))

    first = cut(_first(reduce(DataFrame.unionByName, [own, declared, linked, repositories, listed])))
    addresses = seeds.select("page_id", "seed")
    worth = first.filter(c("stage").isin(LINKED, SITEMAP) & (c("confidence") == "high") & (c("kind") != "documentation")).join(addresses, "page_id")
    worth = _judged(worth, rules).filter("allowed").withColumn("k", F.row_number().over(Window.partitionBy("page_id").orderBy("stage", "place", "url"))).filter(c("k") <= SECTIONS)
    read = seeds.select("seed", F.explode("feeds").alias("f")).select(U.canonical(c("seed")).alias("url"), c("f.url").alias("feed"), c("f.format").alias("format")).distinct()
    told = worth.join(read, "url").select(*_surface(SECTION_FEED, c("k"), c("feed"), lit("feed"), c("format"), lit("html_feed_declaration"), c("confidence"), c("url")))

    fed = declared.select("page_id").unionByName(told.select("page_id")).distinct()
    usual = addresses.join(fed, "page_id", "left_anti").select("page_id", "seed", F.posexplode(lit_array(L.CONVENTIONAL_FEEDS[:PROBES])).alias("at", "path"))
    usual = usual.withColumn("url", U.canonical(F.concat(U.origin(c("seed")), "path")))
    formats = known.filter(c("format").isin(*feeds.ADAPTERS)).select(U.canonical(c("url")).alias("url"), "format").groupBy("url").agg(F.min("format").alias("format"))
    tried = _judged(usual, rules).filter("allowed").join(formats, "url").withColumn("k", F.row_number().over(Window.partitionBy("page_id").orderBy("at"))).filter("k = 1")
    tried = tried.select(*_surface(CONVENTION, c("at"), c("url"), lit("feed"), c("format"), lit("conventional_feed_path"), lit("medium"), c("seed")))

    every = _judged(_first(reduce(DataFrame.unionByName, [first, told, tried])).join(addresses, "page_id"), rules)
    place = F.row_number().over(Window.partitionBy("page_id", "allowed").orderBy("stage", "place", "url"))
    skipped = F.when(~c("allowed"), "disallowed by robots.txt").when(place > SURFACES, f"beyond the {SURFACES}-surface limit")
    return every.withColumn("skipped", skipped).select("page_id", "url", "kind", "adapter", "method", "confidence", "found_on", "skipped")
