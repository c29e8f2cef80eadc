"""Operators on small tables: pages, feeds, interpretation, gates, clustering, syntheses, streams."""

import json

import pytest
from pyspark.sql import functions as F

from sigloom.engine import Engine, InvalidInput, NotFound
from sigloom.operators import answers, cluster, interpret, items, observe, ranking, retrieval
from sigloom.sources import feeds, html
from sigloom.streaming import state

PAGE = """<html><head><title>Plain | Site</title><meta property="og:title" content="Acme ships  Portable Runtime"><meta name="description" content="What it is.">
<link rel="canonical" href="/post?utm_source=a&x=1"><link rel="alternate" type="application/rss+xml" href="/feed.xml" title="Feed"><link rel="alternate" type="text/html" href="/x">
<meta property="article:published_time" content="2024-03-01T10:00:00Z"></head><body><nav><p>menu</p><a href="/nav">Nav</a></nav>
<article><h1>Acme ships</h1><p>First <b>bold</b> text.</p><p>First <b>bold</b> text.</p><ul><li><p>Item</p></li></ul><script>var x = "<p>no</p>";</script><a href="/docs#a">Docs</a><a href="mailto:x">m</a></article><footer><p>foot</p></footer></body></html>"""


def test_pages(spark):
    page = html.parse_page("https://acme.org/p", PAGE)
    assert page["title"] == "Acme ships Portable Runtime" and page["published"] == "2024-03-01T10:00:00Z"
    assert page["text"] == "Acme ships\nFirst bold text.\nItem"
    assert page["feeds"] == [{"url": "https://acme.org/feed.xml", "format": "rss", "title": "Feed"}]
    assert page["links"] == [{"url": "https://acme.org/nav", "text": "Nav", "in_navigation": True}, {"url": "https://acme.org/docs", "text": "Docs", "in_navigation": False}]
    assert html.parse_page("https://a.org/", "")["title"] == "https://a.org/"
    rows = feeds.page_items(html.parsed_pages(spark.createDataFrame([(1, "https://acme.org/p", PAGE), (2, None, None)], "page_id long, url string, html string"))).orderBy("page_id").collect()
    assert rows[0]["canonical_url"] == "https://acme.org/post?x=1" and rows[0]["content_text"].startswith("What it is.\n")


RSS = "<rss><channel><title>c</title><item><guid>g1</guid><title>A &amp; b</title><link>http://www.x.org/a/?utm_source=1</link><description> d </description><author>me@x.org (Me)</author><pubDate>Fri, 01 Mar 2024 10:00:00 GMT</pubDate></item><item/></channel></rss>"
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>e1</id><title>T</title><link href="https://x.org/e"/><updated>2024-03-01T10:00:00Z</updated><content>c</content><author><name>N</name></author></entry></feed>'


def test_feeds(spark):
    xml = spark.createDataFrame([(1, RSS), (2, ATOM), (3, "<broken")], "feed_id long, body string")
    got = {(r["feed_id"], r["original_identifier"]): r for r in feeds.normalized(feeds.xml_entries(xml)).collect()}
    assert set(got) == {(1, "g1"), (1, "untitled"), (2, "e1")}
    assert got[1, "g1"]["canonical_identity"] == "https://x.org/a" and got[1, "g1"]["author"] == "me@x.org" and str(got[1, "g1"]["published_at"]) == "2024-03-01 10:00:00"
    assert got[2, "e1"]["content_text"] == "c" and got[2, "e1"]["author"] == "N" and str(got[2, "e1"]["published_at"]) == "2024-03-01 10:00:00"
    body = json.dumps({"version": "https://jsonfeed.org/version/1.1", "items": [{"id": "1", "external_url": "https://y.org/", "content_html": "<p>h</p>"}]})
    one = feeds.normalized(feeds.json_entries(spark.createDataFrame([(1, body)], "feed_id long, body string"))).first()
    assert (one["title"], one["content_text"], one["content_html"], one["canonical_identity"]) == ("untitled", "", "<p>h</p>", "https://y.org/")


def test_robots(spark):
    body = "User-agent: a\nDisallow: /\n\nUser-agent: MySigloomBot\nAllow: /p/open\nDisallow: /p\nDisallow:\n"
    paths = spark.createDataFrame([("s", p) for p in ("/p", "/p/open/x", "/q")] + [("none", "/p")], "site string, path string")
    got = feeds.robots_allows(paths, feeds.robots_rules(spark.createDataFrame([("s", body)], "site string, body string"))).collect()
    assert {(r["site"], r["path"]): r["allowed"] for r in got} == {("s", "/p"): False, ("s", "/p/open/x"): True, ("s", "/q"): True, ("none", "/p"): True}


def test_links(spark):
    cases = [("https://docs.x.org/", "a"), ("https://x.org/en/blog", ""), ("https://x.org/a/b/blog", "t"), ("https://x.org/z", "Release Notes"), ("https://x.org/z", "see all our latest news here"), ("https://y.org/blog", "")]
    c = feeds.classified_link(F.lit("https://x.org/"), F.col("u"), F.col("t"))
    got = [r["c"] for r in spark.createDataFrame([(i, *x) for i, x in enumerate(cases)], "i int, u string, t string").select("i", c.alias("c")).orderBy("i").collect()]
    assert [(x["kind"], x["confidence"]) if x else None for x in got] == [("documentation", "high"), ("blog", "high"), None, ("changelog", "medium"), None, None]


CONTEXT = {"context_id": 1, "name": "Portable compute", "kind": "project", "aliases": ["edge runtime"], "description": "Containers and virtual machines that move between clouds."}


def test_interpretation():
    r = interpret.read("Acme introduces Portable Runtime | Acme Blog", "The runtime moves containers between clouds. It runs on Linux and Kubernetes.", "web", interpret.Contexts([CONTEXT]))
    assert (r.topic, r.subject, r.kind) == ("Compute & Infrastructure", "Acme", "introduces")
    assert r.change == "Introduces Portable Runtime" and r.contexts[0]["context_id"] == 1 and "Portable compute" in r.why
    quiet = interpret.read("Notes on gardening", "Tulips like sun. They grow.", "web", interpret.Contexts([CONTEXT]))
    assert (quiet.topic, quiet.kind, quiet.contexts, quiet.why) == ("General", "describes", [], None)
    assert interpret.subject_of("Announcing Tokio 2.0: a runtime")[0] == "Tokio 2.0" and interpret.names("the New Rust Compiler is here") == "New Rust Compiler"
    assert interpret.clean_title("A long title - Site") == "A long title" and interpret.verb_of("Widget drops support")[0] == "removes"


def test_gate():
    r = interpret.read("Acme ships X", "Body text here.", "web", interpret.Contexts([CONTEXT]))
    assert interpret.gate(r, "Acme ships X", "Body text here.", {1})[0] is r
    r.excerpts["change"] = ["never said"]
    kept, refused = interpret.gate(r, "Acme ships X", "Body text here.", {1})
    assert kept is None and refused == ["change: no excerpt is present in the underlying item"]


def test_clusters(spark):
    rows = [
        (1, "web", "Acme releases Portable Runtime engine", "Portable Runtime engine moves containers between cloud regions quickly.", 1000),
        (2, "web", "Portable Runtime engine released", "The Portable Runtime engine by Acme moves containers between cloud regions.", 2000),
        (3, "web", "Gardening tips", "Tulips and roses need water.", 3000), (4, "web", "Acme Portable Runtime engine", "Acme engine moves containers between cloud regions with Portable Runtime.", 4000),
    ]
    got = {r["item_id"]: r["signal_id"] for r in cluster.clustered(spark.createDataFrame(rows, "item_id long, source_kind string, title string, content_text string, published_at long")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1}
    untimed = [(5, "web", rows[1][2], rows[1][3], None)]
    got = {r["item_id"]: r["signal_id"] for r in cluster.clustered(spark.createDataFrame(rows + untimed, "item_id long, source_kind string, title string, content_text string, published_at long")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1, 5: 1}


def test_synthesis(spark):
    rows = [
        (1, 1, 10, "a", "a", "change", "x1", 1), (1, 2, 20, "b", "b", "corroboration", "x2", 2), (1, 3, 20, "b", "b", "detail", "x3", 3), (1, 4, 30, "c", "c", "contradiction", "x4", 4),
        (1, 5, 10, "a", "a", "detail", "x5", 5), (1, 6, 20, "b", "b", "detail", "x6", 6), (1, 7, 20, "b", "b", "detail", "x7", 7), (2, 8, 10, "a", "a", "change", "x", 1),
        (3, 11, None, "a", "h", "reason", None, None), (3, 12, 10, "b", "h", None, "x", None), (4, 13, 1, "d", "d", "subject", "y", 1), (4, 14, 2, "e", "e", "contradiction", "z", 0),
    ]
    evidence = spark.createDataFrame(rows, "signal_id long, evidence_id long, item_id long, label string, host string, claim string, excerpt string, observed_at long").repartition(3)
    signals = spark.createDataFrame([(k, "S", "Adds y") for k in range(1, 5)], "signal_id long, subject string, change string")
    got = {(r["signal_id"], r["section"], r["statement"], r["basis"], tuple(r["evidence_ids"])) for r in answers.syntheses(evidence, signals).collect()}
    assert got == {
        (1, "agreements", "2 observations from 2 publishers agree that S adds y.", "observed", (1, 2)),
        (1, "new_information", "b adds: “x3”", "observed", (3,)), (1, "new_information", "b adds: “x6”", "observed", (6,)),
        (1, "differences", "c disputes it: “x4”", "observed", (4,)),
        (1, "uncertainties", "Sources disagree about whether S adds y; neither side settles it yet.", "inferred", (4, 1, 2)),
        (3, "agreements", "2 observations from one publisher agree that S adds y.", "observed", (11, 12)),
        (3, "uncertainties", "All observations come from h; they may not be independent.", "inferred", (11, 12)),
        (4, "differences", "e disputes it: “z”", "observed", (14,)),
        (4, "uncertainties", "Sources disagree about whether S adds y; neither side settles it yet.", "inferred", (14, 13)),
        (4, "uncertainties", "Only d reports this so far; it has not been independently corroborated.", "inferred", (13,)),
    }
    assert answers.syntheses(evidence.limit(0), signals).count() == 0
    points = [("agreements", "z", "observed", [1, 2])]
    kept, refused = answers.checked(points + [("agreements", "z", "observed", [99])], {1, 2, 3, 4})
    assert kept == points and len(refused) == 2


def test_answer_gate():
    good = {"text": "t", "basis": "observed", "evidence_ids": [1, 9], "signal_ids": [], "context_ids": []}
    kept, refused = answers.verified(answers.Answer("s", "sufficient", [good, {"text": "u", "basis": "observed", "evidence_ids": [9]}]), {1: 5}, {5}, set())
    assert [s["evidence_ids"] for s in kept.statements] == [[1]] and kept.statements[0]["signal_ids"] == [5] and len(refused) == 3
    assert answers.verified(answers.Answer("s", "sufficient"), {}, set(), set())[0].summary == answers.INSUFFICIENT
    assert answers.verified(answers.Answer("s", "sufficient", [{"text": "h", "basis": "hypothesis"}]), {}, set(), set())[0].sufficiency == "partial"
    assert answers.answered(lambda: 1 / 0, lambda: "local")[0] == "local"


def test_deduplication_is_idempotent(spark):
    rows = [(1, "f1", "i1"), (2, "f1", "i1"), (3, "f2", "i1"), (4, "f3", "i2")]
    t = spark.createDataFrame(rows, "seq long, fingerprint string, canonical_identity string")
    got = {r["seq"]: (r["outcome"], r["item_seq"]) for r in items.deduplicated(t).collect()}
    assert got == {1: ("new", 1), 2: ("fingerprint", 1), 3: ("identity", 1), 4: ("new", 4)}
    new = [k for k, v in got.items() if v[0] == "new"]
    assert all(r["outcome"] == "new" for r in items.deduplicated(t.filter(F.col("seq").isin(new))).collect())


def test_snapshot_changes(spark):
    lines = [["a b", "c"], ["a b", "c"], ["c", "a b"], ["c", "new words that are six long"], ["c", "x"], ["c", "y"], ["c", "v 1.2"]]
    rows = [(1, i, i, x, x, "|".join(x)) for i, x in enumerate(lines)]
    t = spark.createDataFrame(rows, "source_id long, observed_at long, snapshot_id long, lines array<string>, blocks array<string>, hash string")
    assert [r["change"] for r in observe.snapshot_changes(t).orderBy("snapshot_id").collect()] == ["baseline", "unchanged", "changed", "materially_changed", "materially_changed", "changed", "materially_changed"]


def test_mentioned(spark):
    t = spark.createDataFrame([(1, "Rust tools", "project"), (2, "Gardens", "interest")], "context_id long, name string, kind string")
    ask = lambda q: [r["context_id"] for r in retrieval.mentioned(t, F.lit(q)).orderBy("context_id").collect()]
    assert ask("What of rust tool chains?") == [1] and ask("gardens?") == [2] and ask("what am I building?") == [1] and ask("nothing") == []


def test_total_is_the_sum_of_contributions(spark):
    row = [(1, "open", "adds", 3, 2, 1, 5.0, 1, 2, 0.4, 0, ["r"], 1)]
    t = spark.createDataFrame(row, "signal_id long, status string, change_kind string, sources int, publishers int, contradictions int, context_strength double, contexts int, prior_signals int, link_strength double, open_questions int, rules array<string>, evidence int")
    t = t.withColumn("last_observed_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    r = ranking.ranked(t, F.lit("2024-01-04 00:00:00").cast("timestamp")).first().asDict()
    assert r["c_context"] == 3.0 and r["c_recency"] == 0.5 and r["c_corroboration"] == 0.5 and r["c_novelty"] == 0.25
    assert r["total"] == pytest.approx(sum(v for k, v in r.items() if k.startswith("c_"))) and r["position"] == 1


def test_streams(spark, tmp_path):
    rows = [(1, 5, "failed", "seen", 10), (2, 5, "failed", "saved", 20), (3, 6, "succeeded", "read", 15), (4, 5, "failed", "read", 5)]
    table = spark.createDataFrame(rows, "event_id long, source_id long, status string, state string, s long").withColumn("observed_at", F.timestamp_seconds("s"))
    table.write.parquet(f"{tmp_path}/in")
    read = spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in")

    def run(df, name, mode):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination(120)
        return spark.table(name).collect()

    health = {r["source_id"]: (r["failures"], r["health"], r["next_minutes"]) for r in run(state.source_health(read), "health", "update")}
    assert health == {5: (3, "unavailable", 20.0), 6: (0, "healthy", 60.0)}
    states = {r["item_id"]: (r["state"], r["states"]) for r in run(state.item_states(read.select(F.col("source_id").alias("item_id"), "state", F.col("observed_at").alias("at"))), "states", "update")}
    assert states == {5: ("saved", 3), 6: ("read", 1)}
    assert len(run(state.new_items(read.withColumn("fingerprint", F.col("source_id").cast("string"))), "fresh", "append")) == 2


def test_engine(spark):
    e = Engine(spark, {"item": spark.createDataFrame([(1, "s", "web", "Hello World", "text", "me", "u", 5)], "item_id long, source_id string, source_kind string, title string, content_text string, author string, canonical_url string, published_at long"), "item_state": spark.createDataFrame([], "item_id long, state string")})
    assert e.query("unread").count() == 1 and e.query("saved").count() == 0 and e.search(text="HELLO text").count() == 1 and e.query("recent", 6).count() == 1
    for bad in (lambda: e.query("x"), lambda: e.source_add("ftp://x"), lambda: e.source_add("http://localhost"), lambda: e.context_add(" ")):
        with pytest.raises(InvalidInput):
            bad()
    with pytest.raises(NotFound):
        e.signal_get(1)
    assert e.source_add("http://www.X.org/?utm_a=1").first()["canonical_url"] == "https://x.org/"
    assert e.target_parse("x.org/*").first()["scope"] == "descendants"


def test_capabilities_and_their_errors(spark):
    from sigloom.engine import UnknownCapability
    from sigloom.harness import MODEL, Model

    root = "/root/testdata/sf0.001"
    m = Model(spark, root)
    target = spark.createDataFrame([(1, "watching"), (2, "paused")], "target_id long, status string")
    engine = Engine(spark, {n: m.view(n) for n in MODEL if n != "question"} | {"target": target})
    for name, given, error in (
        ("nothing.known", {}, UnknownCapability), ("_t", {"name": "item"}, UnknownCapability), ("call", {}, UnknownCapability), ("", {}, UnknownCapability), ("item.get", {}, InvalidInput), ("item.get", {"item_id": None}, InvalidInput),
        ("signal.status", {"signal_id": 1, "status": "odd"}, InvalidInput), ("insight.status", {"insight_id": 1, "status": "x"}, InvalidInput), ("target.status", {"target_id": 1, "status": "x"}, InvalidInput), ("target.add", {"text": "ftp://x"}, InvalidInput),
    ):
        with pytest.raises(error):
            engine.call(name, **given)
    with pytest.raises(NotFound):
        Engine(spark, {}).call("source.list")
    assert engine.call("target.pause", target_id=1).first()["status"] == "paused" and engine.call("target.resume", target_id=2).first()["status"] == "watching"
    assert engine.call("insight.drop", insight_id=1).first()["status"] == "dropped"
    assert engine.call("signal.detail", signal_id=1).count() <= 1
    assert engine.call("attention.summary").columns == ["rule_id", "name", "items"]
    assert engine.call("attention.resolve", item_id=1, at=5).first()["state"] == "acted_on"
    added = engine.call("target.add", text="https://x.org/docs/*").first()
    assert added["scope"] == "descendants" and added["target_id"].startswith("target_")


def test_fallback_is_told():
    fails = lambda *a: 1 / 0
    answer, events = answers.answered(fails, lambda *a: answers.Answer("local", "sufficient"), "changes")
    assert answer.summary == "local" and events and events[0].startswith("fallback: ")
    assert answers.answered(None, lambda *a: 1) == (1, []) and answers.answered(lambda *a: 2, fails) == (2, [])


def test_title_functions_agree(spark):
    from sigloom.functions import text as T

    titles = ["Acme ships Runtime | Site", "A | b c d e f g", "One two - three — four", "No site here", "Two  words - a b c d e f", " x · y ", "a b | c | d", "", "Acme ships — it, now!"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "i int, t string").select("i", T.clean_title(F.col("t")).alias("c"), T.phrase(F.col("t"), 3).alias("p")).collect()
    for r in rows:
        assert r["c"] == interpret.clean_title(titles[r["i"]]) and r["p"] == interpret.phrase(titles[r["i"]], 3)
    assert interpret.names("The Acme Portable Runtime ships in Paris") == "Acme Portable Runtime"
    assert interpret.names("nothing here") == "" and interpret.names("A Big, Bold Move 2 Go Far Away Now") == "Bold Move 2 Go Far"
