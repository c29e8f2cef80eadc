"""What larger and odd tables have shown."""

import re

import pytest

from sigloom import staging
from sigloom.operators import answers, changeset, cluster, items, questions, ranking, reading
from sigloom.plans import q_reading
from sigloom.sources import html


@pytest.mark.parametrize("terminated, title", [(True, "A & b <i> &&amp"), (False, "A & b <i> &&")])
def test_title_that_ends_within_a_reference(spark, terminated, title):
    rows = spark.createDataFrame([(1, "https://a.org/", "<html><head><title>A &amp; b &lt;i&gt;  &amp;&amp</title></head></html>")], "page_id long, url string, html string")
    assert html.parsed_pages(rows, terminated).first()["title"] == title


def test_observations_of_one_time_and_id(spark):
    """One of two that are equal in time and id opens the signal, so the other adds its detail."""
    rows = [(1, 3, 10, "a", "a", "detail", "x", 1), (1, 3, 20, "b", "b", "detail", "y", 1), (1, 3, 20, "b", "b", "detail", "z", 1), (1, 3, 20, "b", "b", "detail", "w", 2)]
    evidence = spark.createDataFrame(rows, "signal_id long, evidence_id long, item_id long, label string, host string, claim string, excerpt string, observed_at long")
    signals = spark.createDataFrame([(1, "S", "Adds y")], "signal_id long, subject string, change string")
    got = [r["statement"] for r in answers.syntheses(evidence, signals).collect() if r["section"] == "new_information"]
    assert sorted(got) == ["b adds: “y”", "b adds: “z”"]


def test_dense_tables_are_not_broadcast(spark):
    """A million rows take 40 kB as Parquet and 16 MB and more as rows."""
    rows = staging.cut_dense(spark.range(1_000_000).selectExpr("id DIV 1000 AS id", "'token' AS token"))
    plan = lambda a: a.join(rows, "id")._jdf.queryExecution().sparkPlan().toString()
    some = spark.range(10_000_000).selectExpr("id", "id AS x")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "60k")
        assert "Broadcast" not in plan(some)
        spark.conf.set("spark.sql.sources.fileCompressionFactor", "1.0")
        assert "Broadcast" in plan(some)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def few_contexts(spark):
    """Items and contexts of which every item meets every one, by words and by names of three words."""
    items = spark.createDataFrame([(i, f"Red blue green n{i}", "One two three four. Red blue green.", i, "web") for i in range(40)], "item_id long, title string, content_text string, published_at long, source_kind string")
    contexts = spark.createDataFrame([(k, "red blue green", "project", [f"three four n{k}"], "five three four") for k in range(9)], "context_id long, name string, kind string, aliases array<string>, description string")
    return items, contexts


def test_pairs_of_items_and_contexts_do_not_move(spark):
    out = reading.context_matches(*few_contexts(spark))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert sorted(re.findall(r"Exchange hashpartitioning\((\w+)#", plan)) == ["item_id", "mark"]  # texts, and the keys that are looked for
    rows = out.collect()
    assert len(rows) == 40 * 9 and all(r["direct"] and r["terms"] == ["red blue green", "red", "blue", "green", "three", "four"] and r["places"] == [0, 1, 2] for r in rows)
    assert {r["score"] for r in rows} == {4 + 3 + 3 * 1.5 + 2 * 0.6}


def test_common_words_are_looked_for_last(spark, monkeypatch):
    items, contexts = few_contexts(spark)
    whole = sorted(map(str, reading.context_matches(items, contexts).collect()))
    monkeypatch.setattr(reading, "OFTEN", 5)
    assert sorted(map(str, reading.context_matches(items, contexts).collect())) == whole
    monkeypatch.setattr(reading, "KEYS", 3)
    assert sorted(map(str, reading.context_matches(items, contexts).collect())) == whole


def test_pairs_of_stems_are_found_as_such(spark):
    items, contexts = few_contexts(spark)
    wanted = spark.createDataFrame([("blue green",), ("four red",), ("n3",)], "stem string")
    got = sorted((r["item_id"], r["place"], r["at"], r["stem"]) for r in reading.stem_places(reading.located(items.filter("item_id = 3")), wanted).collect())
    assert got == [(3, 0, 1, "blue green"), (3, 0, 3, "n3"), (3, 2, 1, "blue green")]


def test_reasons_gather_no_descriptions(spark):
    """Of the contexts that an item meets names are gathered; what describes the first is joined to it."""
    matches = spark.createDataFrame([(1, k, 0.5, f"mentions n{k}", [k]) for k in (2, 1, 3)], "item_id long, context_id long, strength double, rationale string, places array<int>")
    contexts = spark.createDataFrame([(k, f"N{k}", "project", f"About {k}.") for k in range(5)], "context_id long, name string, kind string, description string")
    changes = spark.createDataFrame([(1, "fixes")], "item_id long, change_kind string")
    out = reading.relevance(matches, changes, contexts)
    assert [f.name for f in out.schema["m"].dataType.elementType.fields] == ["less", "context_id", "name", "places"]
    row = out.first()
    assert row["why"] == "This may matter because it overlaps with N1, a project you're working on: it mentions n1. You describe N1 as “About 1”. It also touches N2, N3." and row["why_places"] == [1, 2, 3]


@pytest.mark.parametrize("module", [changeset, cluster, items, questions, ranking, reading, q_reading])
def test_tables_of_ids_are_told_to_be_dense(module):
    assert module.cut is staging.cut_dense
