"""Questions to the engine: window, focus, contexts and their citations, the eleven intents, events."""

import datetime as dt

import pytest

from sigloom.engine import Engine, InvalidInput
from sigloom.operators import answers
from sigloom.operators.reasoner import WAYS, compose

NOW = dt.datetime(2024, 2, 1)


def at(day):
    return dt.datetime(2024, 1, day)


@pytest.fixture(scope="module")
def engine(spark):
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    signal = [(1, 1, "Acme runtime", "runs on phones", "open", "adds", "portable compute", at(2), None), (2, 2, "Bolt cache", "drops disks", "open", "removes", "storage", at(3), "it frees memory"), (3, 3, "Core index", "is rebuilt", "open", "changes", "storage", at(30), None)]
    evidence = [(10, 1, 100, 7, "change", "Acme runs on phones", at(2)), (11, 1, 101, 8, "contradiction", "Acme does not run", at(4)), (12, 1, 100, 7, "subject", "Acme", at(2)), (20, 2, 102, 7, "change", "Bolt drops disks", at(3)), (30, 3, 103, 9, "change", "Core is rebuilt", at(30)), (31, 3, 104, 8, "corroboration", "Core was rebuilt", at(31))]
    return Engine(spark, {
        "signal": table(signal, "signal_id long, subject_key long, subject string, change string, status string, change_kind string, topic string, created_at timestamp, why_it_matters string"),
        "evidence": table(evidence, "evidence_id long, signal_id long, item_id long, source_id long, claim string, excerpt string, observed_at timestamp"),
        "source": table([(7, "a", 1), (8, "b", 2), (9, "c", 3)], "source_id long, title string, publisher long"),
        "connection": table([(1, 1, 50, "matches", 0.5, at(2)), (2, 1, 51, "via", 0.2, at(2)), (3, 2, 50, "matches", 0.9, at(3))], "connection_id long, signal_id long, target_id long, relation string, strength double, created_at timestamp"),
        "context": table([(50, "Phoenix", "project", at(1)), (51, "Gardens", "interest", at(5)), (52, "Unmet", "interest", at(6))], "context_id long, name string, kind string, created_at timestamp"),
        "item_link": table([], "signal_id long, target_item long, strength double"),
        "item_relation": table([(100, 103, "related")], "from_item long, to_item long, relation string"),
        "rule": table([], "rule_id long, name string, enabled boolean, action string"),
        "rule_execution": table([], "item_id long, rule_id long, result string"),
        "insight": table([(90, "question", "open", "Is it so?")], "insight_id long, kind string, status string, statement string"),
        "insight_signal": table([(90, 1)], "insight_id long, signal_id long"),
    })


def test_a_citation_of_a_context_survives(engine):
    answer, events = engine.ask("How does Phoenix connect to Acme?", NOW)
    assert not events and answer.sufficiency == "sufficient" and "Phoenix" in answer.summary
    cited = {(tuple(s["signal_ids"]), tuple(s["context_ids"]), s["basis"]) for s in answer.statements}
    assert ((1,), (50,), "connected") in cited and ((2,), (50,), "connected") in cited and ((1,), (51,), "connected") in cited
    assert any("by way of" in s["text"] for s in answer.statements if s["context_ids"] == [51])
    outside = lambda b: answers.Answer("s", "sufficient", [{"text": "t", "basis": "connected", "evidence_ids": [10], "context_ids": [50]}, {"text": "u", "basis": "connected", "evidence_ids": [10], "context_ids": [52]}, {"text": "v", "basis": "observed", "evidence_ids": [99]}])
    answer, events = engine.ask("How does Phoenix connect to Acme?", NOW, outside)
    assert [s["context_ids"] for s in answer.statements] == [[50], []] and [e.split(":")[0] for e in events] == ["rejected"] * 3
    answer, events = engine.ask("How does Phoenix connect to Acme?", NOW, lambda b: 1 / 0)
    assert answer.statements and [e.split(":")[0] for e in events] == ["fallback", "failed"]


def test_window_focus_and_history(engine):
    found = lambda *a, **k: {n: [r["signal_id"] for r in d.select("signal_id").collect()] for n, d in engine.retrieve(*a, **k).items() if n in ("signals", "timeline")}
    assert sorted(found("What changed?", NOW)["signals"]) == [1, 2, 3]
    week = engine.retrieve("What changed this week?", NOW)
    assert [r["signal_id"] for r in week["signals"].collect()] == [3] and week["intent"].first()["since"] == NOW - dt.timedelta(days=7)
    assert set(found("What changed this week?", NOW)["timeline"]) == {3}
    assert found("What of it?", NOW, focus=(2,))["signals"] == [2]
    assert found("What evidence supports that?", NOW, history=((1,), (2,), ()))["signals"] == [2]
    assert engine.retrieve("What evidence supports that?", NOW, history=((1,),))["intent"].first()["focused"]
    with pytest.raises(InvalidInput):
        engine.retrieve(" ", NOW)
    answer, _ = engine.ask("zebra?", NOW)
    assert answer.sufficiency == "insufficient" and not answer.statements


def test_intents_of_the_engine(engine):
    ask = lambda q, **k: engine.ask(q, NOW, **k)[0]
    assert [s["evidence_ids"] for s in ask("What contradicts Acme?").statements] == [[11, 10]]
    assert ask("Does anyone dispute Bolt?").sufficiency in ("partial", "insufficient")
    history = ask("How has the picture of Acme evolved?", focus=(1,)).statements
    assert [s["text"].split(" — ")[0] for s in history] == ["Jan 1, 2024", "Jan 2, 2024", "Jan 4, 2024"] and history[0]["basis"] == "hypothesis" and history[0]["context_ids"] == [50]
    assert any("linked by their items" in s["text"] for s in ask("Are these actually related?", focus=(1, 3)).statements)
    patterns = ask("What patterns appear across sources?").statements
    assert [(s["context_ids"], sorted(s["signal_ids"])) for s in patterns] == [([50], [1, 2]), ([], [2, 3])]
    assert any(s["text"] == "Open question: Is it so?" for s in ask("What should I investigate?", focus=(1,)).statements)


def test_every_intent_keeps_to_the_bundle():
    evidence = [{"evidence_id": 1, "signal_id": 5, "item_id": 2, "source_id": 3, "claim": "change", "excerpt": "x", "observed_at": None}]
    signal = {"signal_id": 5, "subject": "S", "change": "c", "why": None, "last_at": None}
    for intent in WAYS:
        for more in ([], evidence):
            answer = compose({"intent": intent, "signals": [signal, signal | {"signal_id": 6}], "evidence": more})
            assert all(s["basis"] == "hypothesis" or s["evidence_ids"] for s in answer.statements) and answer.follow_ups
            assert more or answer.sufficiency != "sufficient"
            assert len({s["text"] for s in answer.statements}) == len(answer.statements)
        assert compose({"intent": intent, "signals": []}).sufficiency == "insufficient"


def test_many_questions_as_each_alone(spark):
    """Every question of a table against the scores of one question at a time; nulls, ties, repeated rows and hot shapes with it."""
    from pyspark.sql import functions as F

    from sigloom.functions import text as T
    from sigloom.operators import questions, retrieval

    texts = ["What of rust tools?", "What changed this week?", "What am I building with rust tools?", "what am i building?", "", None, "What is uncertain about caches this month?", "gardens and rust", "zebra", "How do gardens relate lately?"]
    asked = [(i, texts[i % len(texts)]) for i in range(40)] + [(100 + i, "What of rust tools?") for i in range(60)]
    told = ["rust cache", "garden tools", None, "", "cache cache", "tool"]
    signals = spark.createDataFrame([(i, ("open", "resolved", None)[i % 3], told[i % 6], dt.datetime(2024, 1, 1 + i % 9), dt.datetime(2024, 1, 31) - dt.timedelta(days=i)) for i in range(45)], "signal_id long, status string, text string, updated_at timestamp, last_at timestamp")
    contexts = spark.createDataFrame([(1, "Rust tools", "project"), (2, "Gardens", "interest"), (3, None, None), (4, "", "project"), (5, "Gardens rust", "interest")], "context_id long, name string, kind string")
    connections = spark.createDataFrame([(i % 45, 1 + i % 5, ("matches", "via", None)[i % 3], None if i % 7 == 0 else i / 100) for i in range(30, 97)], "signal_id long, target_id long, relation string, strength double")
    ranks = spark.createDataFrame([(i, float(i % 12)) for i in range(0, 45, 3)], "signal_id long, total double")
    got = {}
    for r in questions.retrieved(spark.createDataFrame(asked, "question_id long, question string"), signals, connections, contexts, ranks, F.lit(NOW)).collect():
        got.setdefault(r["question_id"], []).append((r["place"], r["signal_id"], r["score"]))
    known = connections.fillna(0.0, ["strength"])
    for text in texts:
        q = F.lit(text or "")
        named = retrieval.mentioned(contexts.fillna("", ["name"]), q)
        n, intent, days = spark.range(1).select(F.size(T.content_terms(q)), T.intent(q), T.window_days(q).cast("int")).first()
        general = n == 0 or intent in retrieval.GENERAL and named.isEmpty()
        since = None if days is None else F.lit(NOW - dt.timedelta(days=days))
        scored = retrieval.scores(signals.fillna("", ["text"]), known, named, q, ranks.join(signals.select("signal_id"), "signal_id", "right").fillna(0.0), general, since)
        want = [(k + 1, r["signal_id"], r["score"]) for k, r in enumerate(retrieval.top_signals(scored).collect())]
        for i, t in asked:
            if t == text:
                assert sorted(got.get(i, [])) == want, text
    assert set(got) - {100 + i for i in range(60)} < set(range(40)) and not [i for i, t in asked if t == "zebra" and i in got]
    empty = questions.retrieved(spark.createDataFrame([], "question_id long, question string"), signals, connections, contexts.limit(0), ranks, F.lit(NOW))
    assert empty.columns == ["question_id", "place", "signal_id", "score"] and empty.count() == 0


def test_other_failures_are_internal(spark, engine):
    from sigloom.engine import Internal, NotFound

    broken = Engine(spark, engine.tables | {"signal": spark.range(1)})
    with pytest.raises(Internal) as told:
        broken.call("retrieve", question="What changed?", now=NOW)
    assert told.value.__cause__ is not None and "retrieve" in str(told.value)
    with pytest.raises(NotFound):
        Engine(spark, {}).call("retrieve", question="What changed?", now=NOW)
    with pytest.raises(InvalidInput):
        engine.call("ask", question=" ", now=NOW)
