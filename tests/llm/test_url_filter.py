import re

import pytest
from pyspark.sql import functions as F

from sigloom.llm.url_filter import PLACES, WORDS, filter_urls, place

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
URLS = [
    "http://Example.ORG/en/123?x=1", "https://a.example.org/en/2", "https://a.example.org", "http://notexample.org/es/x", "http://example.org/es/", "http://x.com/fr/1",
    "http://x.com/de/1#a", "http://x.com/FR/1", "http://com/de/", "ftp://a://b/c", "no scheme", "", None, "http://spam-farm.example.net/en/1", "http://x.net/a/Casino?b", "http://x.net/casinos",
    "http://example.org:80/es/", "://", "http://?", "http://x.net/" + "a/" * 5000, "http://É.com/de/é", "http://spam-farm.org/a", "HTTP://U@COM/de/", "http://a\nb.com/de/\nx",
]


def brute(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    words = [w.name for w in WORDS if re.search(w.pattern.replace(r"\z", r"\Z"), host + path)]
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "block" if words else "allow", min(words, default=None)


@pytest.mark.parametrize("urls", [URLS, [URLS[0]] * 3, []])
def test_against_brute_force(spark, urls):
    pages = spark.createDataFrame([(i // 2 or None, u) for i, u in enumerate(urls)], "page_id long, url string").withColumns({"token": F.lit("t"), "host": F.lit(1), "rank": F.lit(2), "html": F.lit(None).cast("string")})
    got = filter_urls(pages)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "word"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((i // 2 or None, *brute(u)) for i, u in enumerate(urls)), key=repr)


def test_literals_are_whole_tokens():
    assert place("example.org/en/1", "block").literals == ("example", "org", "en")
    assert [p.literals for p in PLACES][0] == ("org",)


def long_urls():
    """URLs of 100 kB that hold the literals of each rule, as matches and as near misses."""
    out = [f"http://x.com/replica-{'a-' * n}watche{end}" for n in (2000, 50_000) for end in ("s", "sx", "s/", "")]
    out += [f"http://x.com/watches-{'a/' * 50_000}replica", f"http://x.com/{'a-' * 50_000}replica watches", f"http://x.com/{'replica-' * 300}{'a' * 50_000}watches"]
    for rule in WORDS:
        for fill in ("a" * 100_000, "a-" * 50_000, ("-".join(rule.literals) + "-") * 300 + "a." * 50_000):
            out += [f"http://{fill}.{'-'.join(rule.literals)}.net/{fill}", f"http://x.net/{'/'.join(rule.literals)}/{fill}", f"http://{rule.literals[0]}-{fill}.net/{rule.name.replace(' ', '-')}"]
    return out


def test_long_urls(spark):
    urls = long_urls()
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(8)
    assert sorted(map(tuple, filter_urls(pages).collect())) == [(i, *brute(u)) for i, u in enumerate(urls)]
