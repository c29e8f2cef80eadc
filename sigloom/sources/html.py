"""Pages as rows. HTML is read by the standard library's parser, a batch at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

from .. import lexicon as L

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}

#: An opening tag that closes an open one of these.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dd": {"dd", "dt", "p"}, "dt": {"dd", "dt", "p"}} | {h: {"p"} for h in ("h1", "h2", "h3", "h4", "ul", "ol", "div", "blockquote", "pre", "article", "main", "nav", "header", "footer", "section", "aside", "table", "form")}

#: A sign that begins no reference which ends with its semicolon.
BARE = re.compile(r"&(?!#?[0-9A-Za-z]+;)")

PAGE = (
    "page_id long, url string, title string, canonical_url string, site_name string, description string, author string, published string, text string, "
    "feeds array<struct<url: string, format: string, title: string>>, links array<struct<url: string, text: string, in_navigation: boolean>>"
)

# Names of metadata, the first that is there counts.
TITLE_META, DESCRIPTION_META, AUTHOR_META = ("og:title", "twitter:title"), ("description", "og:description", "twitter:description"), ("author", "article:author", "twitter:creator")
DATE_META, SITE_META = ("article:published_time", "og:published_time", "datepublished", "pubdate", "date", "dc.date"), ("og:site_name", "application-name")


class _Node:
    __slots__ = ("tag", "attrs", "parent", "parts")

    def __init__(self, tag: str, attrs: dict, parent):
        self.tag, self.attrs, self.parent, self.parts = tag, attrs, parent, []

    def up(self) -> Iterator[_Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def walk(self) -> Iterator[_Node]:
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += [p for p in reversed(node.parts) if isinstance(p, _Node)]

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                todo += reversed(node.parts)
        return " ".join(" ".join(out).split())


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        closing = CLOSES.get(tag, ())
        if self.at.tag in closing:
            self.at = self.at.parent
        node = _Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.parts.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.parts.append(data)


def _main_text(root: _Node) -> str:
    for fits in (lambda n: n.tag == "article", lambda n: n.tag == "main", lambda n: n.attrs.get("role") == "main", lambda n: n.tag == "body"):
        top = next((n for n in root.walk() if fits(n)), None)
        if top is None:
            continue
        lines: list[str] = []
        size = 0
        for block in top.walk():
            if block is top or block.tag not in L.BLOCKS or any(a.tag in L.SKIPPED for a in block.up()) or any(a.tag in L.OUTER_BLOCKS for a in block.up()):
                continue
            line = block.text()
            if line and (not lines or lines[-1] != line):
                lines.append(line)
                size += len(line.encode()) + 1
                if size >= L.MAIN_TEXT_BYTES:
                    break
        if lines:
            return "\n".join(lines).encode()[: L.MAIN_TEXT_BYTES].decode(errors="ignore")
    return ""


def parse_page(url: str, html: str) -> dict:
    """What a page says of itself: title, address, dates, its main text, the feeds it declares and its links."""
    from urllib.parse import urldefrag, urljoin, urlsplit

    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    nodes = list(tree.root.walk())

    def meta(names: tuple[str, ...]) -> str | None:
        for name in names:
            for n in nodes:
                if n.tag == "meta" and (n.attrs.get("property") or n.attrs.get("name") or n.attrs.get("itemprop") or "").lower() == name:
                    if content := " ".join(n.attrs.get("content", "").split()):
                        return content
        return None

    def first(tag: str) -> str | None:
        return next((n.text() for n in nodes if n.tag == tag), None)

    def absolute(href: str) -> str | None:
        try:
            joined = urldefrag(urljoin(url, href.strip()))[0]
            return joined if urlsplit(joined).scheme in ("http", "https") else None
        except ValueError:
            return None

    links: dict[str, dict] = {}
    feeds: dict[str, dict] = {}
    for n in nodes:
        if n.tag == "a" and "href" in n.attrs and (to := absolute(n.attrs["href"])):
            own = {"url": to, "text": n.text(), "in_navigation": any(a.tag in ("nav", "header", "footer") for a in n.up())}
            if old := links.get(to):
                old["in_navigation"] |= own["in_navigation"]
                old["text"] = old["text"] or own["text"]
            elif len(links) < L.PAGE_LINKS:
                links[to] = own
        if n.tag == "link" and "alternate" in n.attrs.get("rel", "").lower().split() and "href" in n.attrs:
            kind, title = n.attrs.get("type", "").lower(), n.attrs.get("title")
            form = "rss" if "rss" in kind else "atom" if "atom" in kind else "json_feed" if "feed+json" in kind or kind == "application/json" and title is not None else None
            if form and (to := absolute(n.attrs["href"])):
                feeds.setdefault(to, {"url": to, "format": form, "title": " ".join((title or "").split()) or None})
    canonical = next((n.attrs["href"] for n in nodes if n.tag == "link" and "canonical" in n.attrs.get("rel", "").lower().split() and n.attrs.get("href")), None) or meta(("og:url",))
    title = meta(TITLE_META)
    if title is None:
        title = first("title")
    if title is None:
        title = first("h1")
    return {
        "title": title or url, "canonical_url": urljoin(url, canonical) if canonical else url, "site_name": meta(SITE_META), "description": meta(DESCRIPTION_META), "author": meta(AUTHOR_META),
        "published": meta(DATE_META) or next((n.attrs["datetime"] for n in nodes if n.tag == "time" and n.attrs.get("datetime")), None),
        "text": _main_text(tree.root), "feeds": list(feeds.values()), "links": list(links.values()),
    }


def parsed_pages(pages: DataFrame, terminated: bool = False) -> DataFrame:
    """pages (page_id, url, html), each with what parse_page finds. terminated: only references with their semicolon are resolved;
    else those that HTML lets go without it are too, as &amp at the end of a title that was cut."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{"page_id": i, "url": u} | parse_page(u or "", BARE.sub("&amp;", h or "") if terminated else h) for i, u, h in zip(b["page_id"], b["url"], b["html"])]
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in ("page_id", "url", "title", "canonical_url", "site_name", "description", "author", "published", "text", "feeds", "links")])

    return pages.select("page_id", "url", "html").mapInPandas(parse, PAGE)
