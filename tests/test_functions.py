"""Golden values of the column functions."""

import pytest
from pyspark.sql import functions as F

from sigloom.functions import ids, text, time, url


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def rows(spark, f, values):
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("x")).collect()
    return [r["x"] for r in sorted(got)]


def test_stem(spark):
    words = ["containers", "runtimes", "policies", "shipping", "added", "boxes", "classes", "autonomous", "process", "go", "Matches"]
    assert rows(spark, text.stem, words) == ["container", "runtime", "policy", "shipp", "added", "boxe", "classe", "autonomou", "process", "go", "match"]


def test_tokens_and_slug(spark):
    assert rows(spark, text.tokens, ["Version 1.99 of node.js, it's C++!", "-a- 'b' _c_"]) == [["version", "1.99", "of", "node.js", "it's", "c++"], ["a", "b", "c"]]
    assert rows(spark, text.slug, ["Portable Compute!", "  Ünï--code 9 ", "!!"]) == ["portable-compute", "ünï-code-9", ""]


def test_sentences(spark):
    got = rows(spark, text.sentences, ["Version 1.2 is out. It adds tools! e.g. small ones.\nNext line? ok.", "a."])
    assert got[0] == ["Version 1.2 is out.", "It adds tools! e.g. small ones.", "Next line? ok."]
    assert got[1] == []


def test_blocks(spark):
    lines = ["Updated 5 minutes ago by x", "at 12:30:45 sharp", "id deadbeefdeadbeef01", "2024-01-02T03:04:05Z done", "just now", "Version 1.2.3", "12 minutes later", "5 apples ago"]
    assert rows(spark, text.normalize_block, lines) == ["Updated # by x", "at # sharp", "id #", "# done", "#", "Version 1.2.3", "12 minutes later", "5 apples ago"]


@pytest.mark.parametrize(
    "question, intent",
    [
        ("Do any sources contradict this?", "contradictions"), ("What evidence supports it?", "evidence"), ("What remains uncertain?", "uncertainty"), ("What should I investigate?", "investigate"),
        ("How did it evolve?", "evolution"), ("Are these related to each other?", "relatedness"), ("Any patterns?", "patterns"), ("Why does this matter?", "why_matters"), ("How does it connect to X?", "connections"), ("What changed this week?", "changes"), ("Tell me", "general"),
    ],
)
def test_intents(spark, question, intent):
    assert value(spark, text.intent(F.lit(question))) == intent


def test_windows_and_anaphora(spark):
    assert rows(spark, text.window_days, ["today", "in the past week", "last month", "lately", "ever"]) == [1, 7, 31, 14, None]
    assert rows(spark, text.is_anaphoric, ["what is that?", "thatched roofs"]) == [True, False]
    assert value(spark, text.content_terms(F.lit("What changed about the Rust containers?"))) == ["container", "rust"]


def test_grounding(spark):
    f = lambda needle: value(spark, text.grounded(F.lit("It  ADDS\nsupport."), F.lit(needle)))
    assert f("adds support") and not f("removes") and not f("i")


def test_canonical_urls(spark):
    same = ["https://Example.com/a/?b=2&a=1", "http://www.example.com/a?a=1&b=2&utm_source=x#top", "example.com:80/a//?a=1&ref=y&b=2", "https://u:p@example.com:443/a?b=2&gclid=1&a=1"]
    assert set(rows(spark, url.canonical, same)) == {"https://example.com/a?a=1&b=2"}
    assert rows(spark, url.canonical, ["https://youtu.be/abc", "", "ftp://x.org", "x.org", "https://x.org/?a", None]) == ["https://youtube.com/watch?v=abc", None, None, "https://x.org/", "https://x.org/?a=", None]


def test_kinds(spark):
    urls = ["https://github.com/a/b", "https://youtube.com/watch?v=1", "https://arxiv.org/abs/1", "https://docs.x.org/", "https://x.org/feed.rss", "https://x.org/atom.xml", "https://x.org/feed.json", "https://x.org/a.pdf", "https://x.org"]
    assert rows(spark, url.kind, urls) == ["github", "youtube", "research", "documentation", "rss", "atom", "json_feed", "research", "web"]


def test_targets(spark):
    got = rows(spark, url.target, ["https://x.org", "x.org/*", "https://x.org//a//*", "https://x.org/*/b", "https://x.org/%2A", "", "x.org/a*"])
    assert [(r["scope"], r["canonical"], r["error"]) for r in got] == [
        ("resource", "https://x.org/", None), ("descendants", "https://x.org/", None), ("descendants", "https://x.org/a/", None), ("resource", None, "misplaced operator"),
        ("resource", None, "misplaced operator"), ("resource", None, "empty"), ("resource", None, "misplaced operator"),
    ]


def test_policy(spark):
    bad = ["http://localhost/", "http://a.local/", "http://127.0.0.1/", "http://192.168.1.1:80/", "http://100.64.0.1/", "http://169.254.1.1/", "http://[::1]/", "http://[fd00::1]/", "http://u:p@x.org/", "ftp://x.org/", "http://240.0.0.1/", "http://198.51.100.7/"]
    assert all(rows(spark, url.policy_error, bad))
    assert rows(spark, url.policy_error, ["https://x.org/", "http://8.8.8.8/", "http://172.15.0.1/"]) == [None] * 3


def test_accounts(spark):
    assert rows(spark, url.x_account, ["https://x.com/someone/status/1", "https://twitter.com/home", "https://x.com/way_too_long_a_name", "https://x.org/a"]) == ["someone", None, None, None]
    assert rows(spark, url.github_repository, ["https://github.com/a/b.git", "https://github.com/topics/x", "https://github.com/a"]) == ["a/b", None, None]


def test_times(spark):
    got = rows(spark, lambda c: time.parsed(c).cast("string"), ["2024-01-02T03:04:05Z", "Tue, 02 Jan 2024 03:04:05 GMT", "2 Jan 2024 03:04:05 +0200", "2024-01-02 or so", "no"])
    assert got == ["2024-01-02 03:04:05", "2024-01-02 03:04:05", "2024-01-02 01:04:05", "2024-01-02 00:00:00", None]
    wait = lambda *a: value(spark, time.retry_minutes(*[F.lit(x) for x in a[:3]], F.lit(a[3]).cast("int")))
    assert [wait(60, 1, True, None), wait(60, 4, True, None), wait(60, 2, False, None), wait(60, 40, False, None), wait(60, 1, True, 10)] == [5.0, 40.0, 120.0, 1440.0, 1.0]


def test_ids(spark):
    import hashlib

    assert value(spark, ids.named("source", F.lit("x"))) == "source_" + hashlib.sha256(b"x").hexdigest()[:32]
    c = F.lit("https://x.org/")
    assert value(spark, ids.target_id(c, F.lit("descendants"))) != value(spark, ids.target_id(c, F.lit("resource")))
    one = [F.lit(x) for x in ("T  t", "c\n d", "u", "i", "a", "2024")]
    two = [F.lit(x) for x in (" T t", "c d ", "u", "i", "a", "2024")]
    assert value(spark, ids.fingerprint(*one)) == value(spark, ids.fingerprint(*two))


def test_small_texts(spark):
    assert value(spark, text.truncated(F.lit("abc def"), 4)) == "abc…"
    assert value(spark, text.lower_first(F.lit("Adds X"))) == "adds X"
    assert value(spark, text.quoted(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 2)) == "“a”, “b”"
    assert rows(spark, text.code_fence_stripped, ['```json\n{"a": 1}\n```', "plain"]) == ['{"a": 1}', "plain"]
    assert rows(spark, text.blank_as_null, ["  ", "", "x "]) == [None, None, "x "]
    assert value(spark, text.without_repeats(F.array(*[F.lit(x) for x in "aabba"]))) == ["a", "b", "a"]
    assert [value(spark, text.plural(F.lit(n), "source")) for n in (1, 2)] == ["1 source", "2 sources"]


def test_failures_with_unknown_parts(spark):
    from sigloom.functions import failures as X

    given = [("http", 503, None, None, None), ("http", 429, 7, None, None), ("http", 410, None, None, None), ("http", None, None, None, None), ("dns", None, None, None, None), ("too_large", None, None, 3 << 20, None), ("policy", None, None, None, "private"), ("odd", None, None, None, None), (None, 500, None, None, None)]
    t = spark.createDataFrame(given, "k string, s int, w long, b long, d string")
    c = [F.col(x) for x in "kswbd"]
    got = [tuple(r) for r in t.select(X.is_temporary(*c[:2]), X.category(*c[:2]), X.described(*c)).collect()]
    assert got == [
        (True, "network", "Server error (HTTP 503)"), (True, "network", "Rate limited (HTTP 429); asked to wait 7s"), (False, "network", "Source unavailable (HTTP 410)"), (False, "network", "HTTP "), (True, "network", "Could not resolve the host ()"),
        (False, "network", "Document larger than 3 MB"), (False, "authorization", "Not fetched: private"), (False, "network", None), (False, "network", None),
    ]
