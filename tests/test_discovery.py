"""Discovery over a site of three pages, against what each way should find."""

import pytest

from sigloom.operators import discovery
from sigloom.sources import feeds, html

HOME = """<html><head><title>Acme</title><link rel="alternate" type="application/rss+xml" href="/all.rss"></head><body><nav><a href="/blog">Blog</a><a href="/docs">Docs</a>
<a href="/private/changelog">Changelog</a><a href="https://status.acme.org/">Status</a></nav><p><a href="https://github.com/acme/tool">code</a> <a href="https://github.com/acme/tool/issues">issues</a>
<a href="https://github.com/acme/two">two</a> <a href="https://github.com/acme/three">three</a></p></body></html>"""
BLOG = """<html><head><title>Blog</title><link rel="alternate" type="application/atom+xml" href="/blog/feed.atom"></head><body><p>text</p></body></html>"""


@pytest.fixture(scope="module")
def found(spark):
    pages = [(1, "https://acme.org/", HOME), (2, "https://acme.org/blog", BLOG), (3, "https://plain.org/", "<html><body><p>nothing here</p></body></html>"), (4, None, None)]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string")
    rules = feeds.robots_rules(spark.createDataFrame([("acme.org", "User-agent: *\nDisallow: /private/")], "site string, body string"))
    locations = spark.createDataFrame([(1, "https://acme.org/news/a"), (1, "https://acme.org/news/b"), (1, "https://acme.org/news/c"), (1, "https://other.org/blog/x"), (9, "https://acme.org/blog/x")], "page_id long, location string")
    known = spark.createDataFrame([("https://plain.org/rss.xml", "rss"), ("https://acme.org/feed.xml", "rss"), ("https://plain.org/feed.xml", "html")], "url string, format string")
    out = discovery.discovered(html.parsed_pages(rows), rules, locations, known).collect()
    assert len(out) == len({(r.page_id, r.url) for r in out})
    return {(r.page_id, r.url): r for r in out}


def test_ways(found):
    way = {k: (r.method, r.kind, r.adapter, r.confidence) for k, r in found.items()}
    assert way[1, "https://acme.org/"] == ("seed", "homepage", "web", "high")
    assert way[1, "https://acme.org/all.rss"][:3] == ("html_feed_declaration", "feed", "rss")
    assert way[1, "https://acme.org/blog"] == ("navigation_link", "blog", "web", "high")
    assert way[1, "https://status.acme.org/"][0] == "subdomain_link"
    assert way[1, "https://github.com/acme/tool/releases.atom"] == ("github_surface", "releases", "atom", "medium")
    assert way[1, "https://acme.org/news"][::3] == ("sitemap", "high")
    assert way[1, "https://acme.org/blog/feed.atom"][:3] == ("html_feed_declaration", "feed", "atom")
    assert found[1, "https://acme.org/blog/feed.atom"].found_on == "https://acme.org/blog"


def test_limits(found):
    assert (1, "https://github.com/acme/two") in found and (1, "https://github.com/acme/three") not in found  # two repositories
    assert found[1, "https://acme.org/private/changelog"].skipped == "disallowed by robots.txt"
    assert not any(r.method == "conventional_feed_path" for (page, _), r in found.items() if page == 1)  # it declares feeds
    assert {u: r.method for (page, u), r in found.items() if page == 3} == {"https://plain.org/": "seed", "https://plain.org/rss.xml": "conventional_feed_path"}
    assert not any(page in (4, 9) or "other.org" in u for page, u in found)


def test_many(spark):
    links = "".join(f'<a href="/blog/{i}">blog</a>' for i in range(80))
    rows = spark.createDataFrame([(1, "https://acme.org/", f"<html><body>{links}</body></html>")], "page_id long, url string, html string")
    none = lambda schema: spark.createDataFrame([], schema)
    out = discovery.discovered(html.parsed_pages(rows), none("site string, verdict string, prefix string"), none("page_id long, location string"), none("url string, format string")).collect()
    assert len(out) == 81 and sum(r.skipped is None for r in out) == 30
