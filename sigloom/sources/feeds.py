"""Feeds as items: RSS, Atom and JSON Feed, what a document is, robots.txt and sitemaps."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import url as U
from ..functions.time import parsed

NORMALIZED = "feed_id long, parser string, original_identifier string, link string, title string, content_text string, content_html string, author string, published string"


def sniffed(body: Column, content_type: Column) -> Column:
    """The format of a document: what its first 4096 bytes say, else what it is declared to be."""
    head = F.lower(F.substring(body, 1, 4096))
    bare = F.regexp_replace(head, r"^[﻿\s]+", "")
    any_of = lambda *words: reduce(lambda x, y: x | y, [F.contains(head, F.lit(w)) for w in words])
    tagged = F.startswith(bare, F.lit("<"))
    declared = (
        F.when(F.contains(content_type, F.lit("rss")), "rss").when(F.contains(content_type, F.lit("atom")), "atom").when(F.contains(content_type, F.lit("feed+json")), "json_feed")
        .when(F.contains(content_type, F.lit("html")), "html").otherwise("unknown")
    )
    return (
        F.when(F.startswith(bare, F.lit("{")) & any_of("jsonfeed.org/version"), "json_feed")
        .when(tagged & any_of("<rss", "<rdf:rdf"), "rss")
        .when(tagged & any_of("<feed") & any_of("http://www.w3.org/2005/atom"), "atom")
        .when(tagged & any_of("<html", "<!doctype html", "<head", "<body"), "html")
        .otherwise(declared)
    )


def parse_xml(body: str) -> list[dict]:
    """The entries of an RSS or Atom document."""
    import xml.etree.ElementTree as ET

    local = lambda e: e.tag.rpartition("}")[2]
    out = []
    for entry in ET.fromstring(body).iter():
        if local(entry) not in ("item", "entry"):
            continue
        parts: dict[str, list] = {}
        for child in entry:
            parts.setdefault(local(child), []).append(child)
        text = lambda name: next(("".join(c.itertext()) for c in parts.get(name, ())), None)
        if local(entry) == "item":
            link, title = (text("link") or "").strip() or None, (text("title") if text("title") is not None else "untitled").strip()
            author = (text("author") or "").split("(")[0].strip() or None
            out.append({"parser": "rss", "original_identifier": text("guid") or link or title, "link": link, "title": title, "content_text": (text("description") or "").strip(), "content_html": None, "author": author, "published": text("pubDate")})
        else:
            link = next((c.get("href") for c in parts.get("link", ())), None)
            name = next((("".join(n.itertext())) for a in parts.get("author", ()) for n in a if local(n) == "name"), None)
            summary = text("summary")
            out.append({"parser": "atom", "original_identifier": text("id"), "link": link, "title": text("title"), "content_text": summary if summary is not None else text("content") or "", "content_html": text("content"), "author": name, "published": text("published") or text("updated")})
    return out


def xml_entries(feeds: DataFrame) -> DataFrame:
    """feeds (feed_id, body): one row per entry. Documents that are no XML give none."""
    columns = [c.split(" ")[0] for c in NORMALIZED.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xml.etree.ElementTree as ET

        for b in batches:
            rows = []
            for i, body in zip(b["feed_id"], b["body"]):
                try:
                    rows += [{"feed_id": i} | e for e in parse_xml(body)]
                except ET.ParseError:
                    continue
            yield pd.DataFrame(rows, columns=columns)

    return feeds.select("feed_id", "body").mapInPandas(parse, NORMALIZED)


def json_entries(feeds: DataFrame) -> DataFrame:
    """feeds (feed_id, body): one row per entry, read by from_json."""
    entry = "id string, url string, external_url string, title string, content_text string, content_html string, date_published string, author struct<name: string>"
    rows = feeds.select("feed_id", F.explode(F.from_json("body", f"items array<struct<{', '.join(x.replace(' ', ': ', 1) for x in entry.split(', '))}>>")["items"]).alias("e"))
    return rows.select(
        "feed_id", F.lit("json_feed").alias("parser"), F.col("e.id").alias("original_identifier"), F.coalesce("e.url", "e.external_url").alias("link"), F.coalesce("e.title", F.lit("untitled")).alias("title"),
        F.coalesce("e.content_text", F.lit("")).alias("content_text"), F.col("e.content_html").alias("content_html"), F.col("e.author.name").alias("author"), F.col("e.date_published").alias("published"),
    )


def normalized(entries: DataFrame) -> DataFrame:
    """Entries with canonical URL, identity and time: the URL is the identity where there is one."""
    known = entries.withColumn("canonical_url", U.canonical(F.col("link")))
    return known.select("*", F.coalesce("canonical_url", "original_identifier").alias("canonical_identity"), parsed(F.col("published")).alias("published_at"))


def page_items(pages: DataFrame) -> DataFrame:
    """Parsed pages as items: the description stands before a text that does not hold it."""
    told = F.when(F.col("description").isNull() | F.contains("text", "description"), F.col("text")).otherwise(F.trim(F.concat_ws("\n", "description", "text")))
    return pages.select("page_id", F.lit("web").alias("parser"), U.canonical(F.col("canonical_url")).alias("canonical_url"), "title", told.alias("content_text"), "author", parsed(F.col("published")).alias("published_at"))


#: How items are made from documents, by the adapter of their source.
ADAPTERS = {"rss": xml_entries, "atom": xml_entries, "json_feed": json_entries}


def dispatched(documents: DataFrame) -> DataFrame:
    """documents (feed_id, adapter_kind, body): the entries that the adapter of each document's source reads, and for kinds that
    have none a row with the error."""
    columns = [c.split(" ")[0] for c in NORMALIZED.split(", ")]
    read = [adapter(documents.filter(F.col("adapter_kind") == kind)).select(*columns, F.lit(None).cast("string").alias("error")) for kind, adapter in ADAPTERS.items()]
    other = documents.filter(F.col("adapter_kind").isNull() | ~F.col("adapter_kind").isin(*ADAPTERS))
    error = F.concat(F.lit("no source adapter registered for "), F.coalesce("adapter_kind", F.lit("none")))
    refused = other.select("feed_id", *(F.lit(None).cast("string").alias(c) for c in columns[1:]), error.alias("error"))
    return reduce(DataFrame.unionByName, [*read, refused])


def robots_rules(files: DataFrame, agent: str = "sigloom") -> DataFrame:
    """files (site, body): site, verdict, prefix of the rules that apply to all agents or to one that holds `agent`. A group of
    user-agent lines is one block; it ends with the first rule."""
    line = F.trim(F.split(F.col("line"), "#")[0])
    lines = files.select("site", F.posexplode(F.split("body", r"\r?\n")).alias("n", "line")).select("site", "n", line.alias("line")).filter(F.contains("line", F.lit(":")))
    key, value = F.lower(F.trim(F.split("line", ":")[0])), F.trim(F.regexp_replace("line", "^[^:]*:", ""))
    lines = lines.select("site", "n", key.alias("key"), value.alias("value")).filter("key <> 'sitemap'")
    w = Window.partitionBy("site").orderBy("n")
    agents = F.col("key") == "user-agent"
    opens = agents & ~F.coalesce(F.lag(agents).over(w), F.lit(False))
    blocks = lines.withColumn("block", F.sum(opens.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    meant = agents & ((F.col("value") == "*") | F.contains(F.lower("value"), F.lit(agent)))
    applies = F.bool_or(meant).over(Window.partitionBy("site", "block"))
    return blocks.withColumn("applies", applies).filter("applies AND key IN ('allow', 'disallow') AND value <> ''").select("site", F.col("key").alias("verdict"), F.col("value").alias("prefix"))


def robots_allows(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """paths (site, path) with whether they may be read: the longest rule decides, and of equals the one that allows."""
    met = paths.join(rules, "site", "left")
    best = lambda v: F.coalesce(F.max(F.when((F.col("verdict") == v) & F.startswith("path", "prefix"), F.length("prefix"))), F.lit(-1))
    return met.groupBy("site", "path").agg((best("allow") >= best("disallow")).alias("allowed"))


def sitemap_locations(files: DataFrame, most: int = 5000) -> DataFrame:
    """files (site, body): the locations of each sitemap in order, and whether it is an index."""
    locations = F.slice(F.regexp_extract_all(F.col("body"), F.lit(r"(?s)<loc>(.*?)</loc>"), F.lit(1)), 1, most)
    rows = files.select("site", F.contains("body", F.lit("<sitemapindex")).alias("is_index"), F.posexplode(locations).alias("place", "raw"))
    return rows.select("site", "is_index", "place", F.replace(F.trim("raw"), F.lit("&amp;"), F.lit("&")).alias("location"))


def sitemap_sections(locations: DataFrame, seed: Column, *by: str) -> DataFrame:
    """Sections that locations imply, for each `by`: the first of the first two parts of a path that names one, with how many pages lie below."""
    own = locations.filter(U.same_site(seed, F.col("location")))
    parts = U.segments(F.col("location"))
    first, second = U.section_of(F.get(parts, F.lit(0))), U.section_of(F.get(parts, F.lit(1)))
    root = F.when(first.isNotNull(), parts[0]).when(second.isNotNull(), F.concat(parts[0], F.lit("/"), parts[1]))
    found = own.select(*by, F.concat(U.origin(F.col("location")), F.lit("/"), root).alias("root"), F.coalesce(first, second).alias("kind")).filter("kind IS NOT NULL")
    return found.groupBy(*by, "root").agg(F.min("kind").alias("kind"), F.count("*").alias("pages"))


def classified_link(seed: Column, url: Column, text: Column) -> Column:
    """What a link of a site leads to: struct(kind, confidence); null for none. A subdomain or a path of two parts at most that
    ends in the name of a section is sure; an anchor of three words at most that names one is likely."""
    parts = U.segments(url)
    a, b = U.bare_host(seed), U.bare_host(url)
    label = F.when((a != b) & (F.size(parts) == 0), U.section_of(F.split(b, r"\.")[0]))
    last = F.when(F.size(parts).between(1, 2), U.section_of(F.regexp_replace(F.element_at(parts, -1), r"(\.html)*(\.htm)*$", "")))
    words = F.filter(F.split(text, r"[^\p{IsAlphabetic}\p{N}\-]+"), lambda w: w != "")
    each = F.get(F.filter(F.transform(words, U.section_of), lambda k: k.isNotNull()), F.lit(0))
    said = F.when(F.size(words).between(1, 3) & (F.size(parts) <= 2), F.coalesce(U.section_of(F.array_join(words, "-")), each))
    sure, likely = F.coalesce(label, last), F.struct(said.alias("kind"), F.lit("medium").alias("confidence"))
    found = U.let(sure, lambda k: F.when(k.isNotNull(), F.struct(k.alias("kind"), F.lit("high").alias("confidence"))).otherwise(likely))
    return F.when(U.same_site(seed, url), U.let(found, lambda x: F.when(x["kind"].isNotNull(), x)))
