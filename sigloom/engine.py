"""What a caller can ask for: one method per capability. Reads return DataFrames; writes return the new rows of a table."""

from __future__ import annotations

import inspect

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import ids
from .functions import text as T
from .functions import url as U
from .operators import answers, gold, items, observe, ranking, records, retrieval
from .operators.reasoner import compose


class InvalidInput(ValueError):
    pass


class NotFound(LookupError):
    pass


class UnknownCapability(LookupError):
    pass


class Internal(RuntimeError):
    """A capability failed for a reason that is not the caller's; the cause is attached."""


class Engine:
    """tables: name -> DataFrame of the collections that are asked for (item, item_state, signal, evidence, source, connection,
    item_link, rule, rule_execution, context, insight, insight_signal, observation, snapshot, target)."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame]):
        self.spark, self.tables = spark, tables

    def call(self, capability: str, **given):
        """What a capability (a method, with `.` or `_` between its words) gives. Errors are UnknownCapability, InvalidInput (also for parameters that do not fit), NotFound, and Internal for all else."""
        name = capability.replace(".", "_")
        method = getattr(type(self), name, None) if name and not name.startswith("_") and name != "call" else None
        if not callable(method):
            raise UnknownCapability(capability)
        try:
            inspect.signature(method).bind(self, **given)
        except TypeError as e:
            raise InvalidInput(f"{capability}: {e}") from None
        try:
            return method(self, **given)
        except (UnknownCapability, InvalidInput, NotFound):
            raise
        except Exception as e:
            raise Internal(f"{capability}: {type(e).__name__}") from e

    def _t(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise NotFound(f"no table {name}")
        return self.tables[name]

    def _one(self, name: str, key: str, value) -> DataFrame:
        if value is None:
            raise InvalidInput(f"{key} is missing")
        return self._t(name).filter(F.col(key) == value)

    # items
    def item_list(self) -> DataFrame:
        return items.hydrated(self._t("item"), self._t("item_state"))

    def item_get(self, item_id) -> DataFrame:
        return self._one("item", "item_id", item_id)

    def search(self, **query) -> DataFrame:
        return items.search(self.item_list(), **query)

    def query(self, name: str, now: int | None = None) -> DataFrame:
        if name == "list":
            return self.item_list()
        if name == "recent":
            if now is None:
                raise InvalidInput("recent asks for now")
            return self.search(after=now - 7 * 86400)
        states = {"unread": "unseen", "saved": "saved", "important": "important"}
        if name not in states:
            raise InvalidInput(f"no query {name}")
        return self.search(state=states[name])

    def item_transition(self, item_id, state: str, at: int) -> DataFrame:
        if state not in ("unseen", "seen", "read", "saved", "dismissed", "important", "acted_on", "archived"):
            raise InvalidInput(f"no state {state}")
        return self.spark.createDataFrame([(item_id, state, at)], "item_id long, state string, at long")

    # signals
    def signal_list(self, now) -> DataFrame:
        names = ("signal", "evidence", "source", "connection", "item_link", "rule_execution", "rule", "insight", "insight_signal")
        return ranking.ranked(ranking.summarised(*map(self._t, names)), F.lit(now))

    def today(self, now) -> DataFrame:
        return self.signal_list(now).filter("eligible").orderBy("position")

    def signal_get(self, signal_id) -> dict[str, DataFrame]:
        return {n: self._one(n, "signal_id", signal_id) for n in ("signal", "evidence", "connection")} | {"observations": gold.observations(self._one("evidence", "signal_id", signal_id))}

    def signal_detail(self, signal_id) -> DataFrame:
        """One row: the items of a signal in first-seen order, its claims, contexts and insights."""
        return gold.signal_detail(*(self._one(n, "signal_id", signal_id) for n in ("evidence", "connection", "insight_signal")))

    def signal_resolve(self, signal_id) -> DataFrame:
        return self.signal_status(signal_id, "resolved")

    def signal_dismiss(self, signal_id) -> DataFrame:
        return self.signal_status(signal_id, "dismissed")

    def signal_status(self, signal_id, status: str) -> DataFrame:
        if status not in ("open", "resolved", "dismissed"):
            raise InvalidInput(f"no status {status}")
        return self._one("signal", "signal_id", signal_id).withColumn("status", F.lit(status))

    def evidence_get(self, evidence_id) -> DataFrame:
        return self._one("evidence", "evidence_id", evidence_id).join(self._t("source"), "source_id", "left")

    # contexts and connections
    def context_list(self) -> DataFrame:
        return self._t("context").orderBy("name")

    def context_add(self, name: str, kind: str = "interest") -> DataFrame:
        if not name.strip():
            raise InvalidInput("a context needs a name")
        if kind not in ("project", "interest", "concern"):
            raise InvalidInput(f"no kind {kind}")
        return self.spark.range(1).select(F.lit(name).alias("name"), T.slug(F.lit(name)).alias("name_key"), F.lit(kind).alias("kind"))

    def connection_list(self, target=None) -> DataFrame:
        rows = self._t("connection") if target is None else self._one("connection", "target_id", target)
        return rows.orderBy(F.desc("strength"), "created_at")

    def connection_graph(self) -> dict[str, DataFrame]:
        return {"contexts": gold.context_edges(self._t("connection")), "subjects": gold.subject_nodes(self._t("signal"), self._t("evidence"))}

    # sources and targets
    def source_list(self) -> DataFrame:
        return self._t("source")

    def source_get(self, source_id) -> DataFrame:
        return self._one("source", "source_id", source_id)

    def source_add(self, url: str) -> DataFrame:
        row = self.spark.range(1).select(U.canonical(F.lit(url)).alias("canonical_url"), U.kind(U.with_scheme(F.lit(url))).alias("kind"), U.policy_error(U.with_scheme(F.lit(url))).alias("error")).first()
        if row["canonical_url"] is None or row["error"]:
            raise InvalidInput(row["error"] or "no http(s) URL")
        return self.spark.range(1).select(ids.named("source", F.lit(row["canonical_url"])).alias("source_id"), F.lit(row["canonical_url"]).alias("canonical_url"), F.lit(row["kind"]).alias("kind"))

    def target_parse(self, text: str) -> DataFrame:
        return self.spark.range(1).select(U.target(F.lit(text)).alias("t")).select("t.*")

    def target_list(self) -> DataFrame:
        return self._t("target")

    def observation_due(self, now: int, force: bool = False) -> DataFrame:
        return observe.due_sources(self._t("source"), self._t("target"), now, force)

    def observation_status(self) -> DataFrame:
        return self._t("source").agg(F.count("*").alias("sources"), F.count_if(F.col("status") == "paused").alias("paused"), F.min("next_observation_at").alias("next_due"))

    def target_get(self, target_id) -> dict[str, DataFrame]:
        return {"target": self._one("target", "target_id", target_id), "sources": self.target_sources(target_id)}

    def target_sources(self, target_id) -> DataFrame:
        return self._one("source", "target_id", target_id)

    def target_add(self, text: str) -> DataFrame:
        row = self.target_parse(text).first()
        if row["error"] or row["canonical"] is None:
            raise InvalidInput(row["error"] or "no http(s) URL")
        return self.target_parse(text).select(ids.target_id(F.col("canonical"), F.col("scope")).alias("target_id"), "canonical", "scope", F.lit("watching").alias("status"))

    def target_status(self, target_id, status: str) -> DataFrame:
        """The target, paused or resumed; it stays in any case."""
        if status not in ("paused", "watching"):
            raise InvalidInput(f"no status {status}")
        return self._one("target", "target_id", target_id).withColumn("status", F.lit(status))

    def target_pause(self, target_id) -> DataFrame:
        return self.target_status(target_id, "paused")

    def target_resume(self, target_id) -> DataFrame:
        return self.target_status(target_id, "watching")

    def observation_run(self, now: int, force: bool = False) -> DataFrame:
        """The record of a pass over what is due."""
        return records.pass_record(self.observation_due(now, force), self._t("observation"))

    # rules and attention
    def attention_list(self) -> DataFrame:
        """What rules have called attention to: matched executions of rules that create events."""
        calls = self._t("rule").filter("action = 'create_attention_event'").select("rule_id", "name")
        return self._t("rule_execution").filter("result = 'matched'").join(calls, "rule_id").select("item_id", "rule_id", "name")

    def attention_summary(self) -> DataFrame:
        return self.attention_list().groupBy("rule_id", "name").agg(F.countDistinct("item_id").alias("items"))

    def attention_resolve(self, item_id, at: int) -> DataFrame:
        return self.item_transition(item_id, "acted_on", at)

    def apply_rules(self, new_items: DataFrame) -> DataFrame:
        return items.apply_rules(new_items, self._t("rule"))

    # questions
    def retrieve(self, question: str, now, focus: tuple = (), history: tuple = ()) -> dict[str, DataFrame]:
        """What a question is answered from: the best signals that it looks back to, their evidence within the budget, the contexts
        that it names or they connect to, the insights that cite them, what happened to them, and, where relations of items are known, how they relate.
        focus: signals that the question is about; without, a question that points back ("that", "these") is about the last
        signals of history (a tuple of signal ids an earlier answer)."""
        if not question.strip():
            raise InvalidInput("a question needs words")
        q = F.lit(question)
        named = retrieval.mentioned(self._t("context"), q)
        shape = self.spark.range(1).select(T.intent(q).alias("intent"), F.size(T.content_terms(q)).alias("n"), T.window_days(q).cast("int").alias("days"), T.is_anaphoric(q).alias("back")).select("*", (F.lit(now).cast("timestamp") - F.make_interval(days=F.col("days"))).alias("since")).first()
        if not focus and shape["back"]:
            focus = next((h for h in reversed(history) if h), ())
        about = self.spark.createDataFrame([(i,) for i in focus], "signal_id long") if focus else None
        general = shape["n"] == 0 or shape["intent"] in retrieval.GENERAL and named.isEmpty()
        ranks = self.signal_list(now).select("signal_id", "total")
        seen = self._t("evidence").groupBy("signal_id").agg(F.max("observed_at").alias("seen"))
        texts = [c for c in ("topic", "subject", "change", "why_it_matters", "change_kind") if c in self._t("signal").columns]
        rows = self._t("signal").join(seen, "signal_id", "left").select("signal_id", "status", F.concat_ws(" ", *texts).alias("text"), F.col("created_at").alias("updated_at"), F.coalesce("seen", "created_at").alias("last_at"))
        since = None if shape["days"] is None else F.lit(shape["since"])
        scored = retrieval.scores(rows, self._t("connection"), named, q, ranks, general, since, about)
        best = retrieval.top_signals(scored)
        placed = best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("updated_at"), "signal_id")))
        parts = retrieval.bundle_parts(placed, self._t("evidence"), self._t("connection"), self._t("insight_signal"))
        head = self.spark.createDataFrame([(shape["intent"], shape["days"], shape["since"], bool(focus))], "intent string, window_days int, since timestamp, focused boolean")
        mine = lambda t: t.join(placed.select("signal_id"), "signal_id", "left_semi")
        links = gold.best_connections(mine(self._t("connection"))).select("signal_id", F.col("target_id").alias("context_id"), "relation", "strength")
        met = links.select("context_id").union(named.select("context_id")).distinct()
        contexts = self._t("context").join(met, "context_id", "left_semi").join(named.select("context_id", F.lit(True).alias("mentioned")), "context_id", "left").fillna(False, ["mentioned"])
        when = lambda name, key: self._t(name).select(key, F.col("created_at").alias("at")) if "created_at" in self._t(name).columns else self._t(name).select(key, F.lit(None).cast("timestamp").alias("at"))
        told = mine(self._t("insight_signal")).join(when("insight", "insight_id"), "insight_id").select("signal_id", "insight_id", "at")
        line = gold.timeline(mine(self._t("evidence")), mine(self._t("signal")), when("source", "source_id"), mine(self._t("connection")), when("context", "context_id"), told).filter("at IS NOT NULL")
        out = {"intent": head, "signals": best, "evidence": parts["evidence"][0], "contexts": contexts, "connections": links, "insights": parts["insight"][0], "timeline": line}
        if "item_relation" in self.tables:
            out["pairs"] = gold.bundle_pairs(placed.select("signal_id", "place"), self._t("evidence"), self._t("item_relation"), self._t("connection"))
        return out

    def ask(self, question: str, now, reasoner=None, focus: tuple = (), history: tuple = ()) -> tuple[answers.Answer, list[str]]:
        """An answer from what retrieve() finds, checked against it, and the events: failed and fallback of the reasoner (a callable
        of the bundle as `operators/reasoner.py` describes it), rejected for what the gate withheld. Rows of eight signals and 60 pieces of evidence come to the driver, with
        their connections and history."""
        found = self.retrieve(question, now, focus, history)
        head = found["intent"].first()
        best = [r.asDict() for r in found["signals"].collect()]
        few = self.spark.createDataFrame([(r["signal_id"],) for r in best], "signal_id long")
        detail = {r["signal_id"]: r.asDict() for r in self._t("signal").join(F.broadcast(few), "signal_id", "left_semi").collect()}
        contexts = [r.asDict() for r in found["contexts"].select("context_id", "name", "kind", "mentioned").orderBy("context_id").collect()]
        of = {c["context_id"]: c for c in contexts}
        evidence = [r.asDict() for r in found["evidence"].orderBy("signal_id", "place").collect()]
        last: dict = {}
        for e in evidence:
            last[e["signal_id"]] = max(filter(None, (last.get(e["signal_id"]), e["observed_at"])), default=None)
        signals = []
        for r in best:
            s = detail[r["signal_id"]]
            signals.append({"signal_id": r["signal_id"], "subject": s.get("subject") or str(s.get("subject_key")), "change": s.get("change") or s.get("change_kind"), "why": s.get("why_it_matters"), "topic": s.get("topic"), "last_at": last.get(r["signal_id"]) or s.get("created_at")})
        ids = self._t("insight").join(F.broadcast(found["insights"]), "insight_id").join(self._t("insight_signal").join(F.broadcast(few), "signal_id"), "insight_id").groupBy("insight_id", "kind", "status", "statement").agg(F.array_sort(F.collect_set("signal_id")).alias("signal_ids"))
        bundle = {
            "intent": head["intent"], "since": head["since"], "signals": signals, "evidence": evidence, "contexts": contexts, "mentioned": [c["context_id"] for c in contexts if c["mentioned"]],
            "connections": [c | {"name": of[c["context_id"]]["name"], "kind": of[c["context_id"]]["kind"]} for r in found["connections"].orderBy("signal_id", F.desc("strength"), "context_id").collect() if (c := r.asDict())["context_id"] in of],
            "pairs": [r.asDict() for r in found["pairs"].orderBy("a", "b").collect()] if "pairs" in found else [],
            "timeline": [r.asDict() for r in found["timeline"].collect()] if head["intent"] == "evolution" else [],
            "insights": [r.asDict() for r in ids.orderBy("insight_id").collect()],
        }
        answer, events = answers.answered(reasoner, compose, bundle)
        kept, refused = answers.verified(answer, {e["evidence_id"]: e["signal_id"] for e in evidence}, set(detail), set(of))
        return kept, events + [f"rejected: {r}" for r in refused]

    # insights
    def insight_list(self) -> DataFrame:
        return self._t("insight")

    def insight_get(self, insight_id) -> dict[str, DataFrame]:
        return {"insight": self._one("insight", "insight_id", insight_id), "signals": self._one("insight_signal", "insight_id", insight_id)}

    def insight_status(self, insight_id, status: str) -> DataFrame:
        if status not in ("open", "resolved", "dropped"):
            raise InvalidInput(f"no status {status}")
        return self._one("insight", "insight_id", insight_id).withColumn("status", F.lit(status))

    def insight_resolve(self, insight_id) -> DataFrame:
        return self.insight_status(insight_id, "resolved")

    def insight_drop(self, insight_id) -> DataFrame:
        return self.insight_status(insight_id, "dropped")

    def insight_save(self, statement: str, kind: str = "insight", signal_ids: tuple = ()) -> DataFrame:
        if not statement.strip():
            raise InvalidInput("an insight needs a statement")
        wanted = self.spark.createDataFrame([(i,) for i in signal_ids], "signal_id long")
        if not wanted.join(self._t("signal"), "signal_id", "left_anti").isEmpty():
            raise NotFound("a signal that is cited is not there")
        return self.spark.createDataFrame([(statement, kind, "open", list(signal_ids))], "statement string, kind string, status string, signal_ids array<long>")
