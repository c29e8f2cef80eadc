"""The model tables as views of the driver's tables. One text of SQL defines each for Spark and for the oracle alike: it is the
ground the queries stand on, not what they are tested for."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")

#: When questions are asked and schedules run, where the tables do not say.
AS_OF = "2024-02-01 00:00:00"

MODEL = {
    "item": """SELECT doc_id AS item_id, source AS source_id, CASE lang WHEN 'en' THEN 'web' WHEN 'fr' THEN 'rss' WHEN 'de' THEN 'atom' ELSE 'research' END AS source_kind,
        substr(split_part(text, chr(10), 1), 1, 80) AS title, text AS content_text, lang AS author, md5(lower(text)) AS canonical_identity,
        1704067200 + doc_id * 60 AS published_at, concat('https://', lang, '.example.org/', source, '/', CAST(doc_id % 700 AS STRING)) AS canonical_url FROM documents""",
    "item_state": """SELECT doc_id AS item_id, CASE WHEN toxic = 1 THEN 'dismissed' WHEN quality = 0 THEN 'seen' WHEN doc_id % 5 = 0 THEN 'saved' WHEN doc_id % 7 = 0 THEN 'important' ELSE 'read' END AS state, doc_id * 60 AS updated_at FROM labels""",
    "provenance": """SELECT l_orderkey * 10 + l_linenumber AS provenance_id, l_partkey AS item_id, l_suppkey AS source_id, l_shipdate AS observed_at, l_shipmodeless AS parser
        FROM (SELECT *, concat('p', CAST(l_linenumber AS STRING)) AS l_shipmodeless FROM lineitem)""",
    "signal": """SELECT o_orderkey AS signal_id, o_custkey AS subject_key, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'resolved' ELSE 'dismissed' END AS status,
        CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'removes' WHEN '2' THEN 'adds' WHEN '3' THEN 'changes' WHEN '4' THEN 'fixes' ELSE 'describes' END AS change_kind,
        concat('topic', CAST(o_orderkey % 13 AS STRING)) AS topic, o_orderdate AS created_at, o_totalprice AS weight FROM orders""",
    "evidence": """SELECT l_orderkey * 10 + l_linenumber AS evidence_id, l_orderkey AS signal_id, l_partkey AS item_id, l_suppkey AS source_id,
        CASE WHEN l_returnflag = 'R' AND l_linenumber % 2 = 0 THEN 'contradiction' WHEN l_linenumber = 1 THEN 'change' WHEN l_returnflag = 'N' THEN 'corroboration' WHEN l_linenumber % 3 = 0 THEN 'detail' ELSE 'subject' END AS claim,
        concat('excerpt ', CAST(l_partkey % 50 AS STRING)) AS excerpt, l_shipdate AS observed_at, l_discount AS strength, l_linestatus AS line_status, l_tax AS tax FROM lineitem""",
    "source": """SELECT s_suppkey AS source_id, s_name AS title, s_nationkey AS publisher, s_acctbal AS balance, CASE WHEN s_suppkey % 11 = 0 THEN 'failing' WHEN s_suppkey % 7 = 0 THEN 'paused' ELSE 'active' END AS status,
        s_suppkey % 20 AS target_id, s_suppkey % 9 <> 0 AS relevant, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 1706745600 + (s_suppkey % 13 - 6) * 3600 END AS next_observation_at,
        CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 1706745600 - s_suppkey * 3600 END AS last_success_at, CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE 1706745600 - s_suppkey * 1800 END AS last_checked_at FROM supplier""",
    "context": "SELECT n_nationkey AS context_id, n_name AS name, n_regionkey AS family, CASE n_nationkey % 3 WHEN 0 THEN 'project' WHEN 1 THEN 'interest' ELSE 'concern' END AS kind FROM nation",
    "connection": """SELECT l_orderkey * 10 + l_linenumber AS connection_id, l_orderkey AS signal_id, s_nationkey AS target_id, CASE WHEN l_linestatus = 'O' THEN 'matches' ELSE 'via' END AS relation,
        round(l_discount * 10, 3) AS strength, l_shipdate AS created_at FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
    "item_link": "SELECT l_orderkey AS signal_id, l_partkey AS target_item, round(l_tax * 10, 3) AS strength FROM lineitem WHERE l_linenumber > 3",
    "rule": """SELECT r_regionkey AS rule_id, r_name AS name, r_regionkey <> 4 AS enabled, CASE r_regionkey WHEN 0 THEN 'retain' WHEN 1 THEN 'save' WHEN 2 THEN 'mark_important' ELSE 'create_attention_event' END AS action,
        CASE r_regionkey WHEN 0 THEN NULL WHEN 1 THEN 'src1' WHEN 2 THEN NULL WHEN 3 THEN 'src3' ELSE 'src4' END AS source_filter, CASE r_regionkey WHEN 2 THEN 'rss' ELSE NULL END AS kind_filter,
        CASE r_regionkey WHEN 0 THEN 'TH' WHEN 1 THEN NULL WHEN 2 THEN 'le' ELSE NULL END AS title_pattern, CASE r_regionkey WHEN 3 THEN 'en' ELSE NULL END AS author_pattern,
        CASE r_regionkey WHEN 2 THEN 'ou' ELSE NULL END AS content_pattern, CASE r_regionkey WHEN 3 THEN 'EXAMPLE.org/SRC3/1' ELSE NULL END AS url_pattern,
        CASE r_regionkey WHEN 1 THEN 1704067200 + 6000 ELSE NULL END AS published_after FROM region""",
    "rule_execution": "SELECT p_partkey AS item_id, p_size % 5 AS rule_id, CASE WHEN p_size % 3 = 0 THEN 'matched' ELSE 'skipped' END AS result FROM part",
    "item_relation": """SELECT DISTINCT l_partkey AS from_item, l_partkey % 97 + 1 AS to_item, CASE l_linenumber WHEN 6 THEN 'same_change' WHEN 7 THEN 'contradicts' ELSE 'related' END AS relation FROM lineitem WHERE l_linenumber > 4""",
    "insight": """SELECT c_custkey AS insight_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'question' WHEN 'MACHINERY' THEN 'hypothesis' WHEN 'AUTOMOBILE' THEN 'investigation' WHEN 'FURNITURE' THEN 'insight' ELSE 'decision_candidate' END AS kind,
        CASE WHEN c_acctbal > 0 THEN 'open' ELSE 'resolved' END AS status, c_name AS statement FROM customer""",
    "insight_signal": "SELECT o_custkey AS insight_id, o_orderkey AS signal_id FROM orders WHERE o_orderkey % 3 = 0",
    "observation": """SELECT event_id, user_id AS source_id, ts AS observed_at, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'unchanged' ELSE 'succeeded' END AS status, value AS strength, event_type,
        CASE WHEN event_type = 'purchase' THEN 2 WHEN event_type = 'click' THEN 1 ELSE 0 END AS new_items FROM events""",
    "snapshot": """SELECT event_id AS snapshot_id, user_id % 40 AS source_id, ts AS observed_at, event_type, CAST(floor(value) AS BIGINT) % 4 AS version FROM events WHERE event_type IN ('view', 'click', 'error')""",
    "question": "SELECT conv_id, turn, text AS question FROM conversations WHERE role = 'user'",
}


class Model:
    """The driver's tables and the model over them, all lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        text = re.sub(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b", r"\1 {\2}", MODEL[name])
        return self.spark.sql(text, **{t: self.table(t) for t in TABLES if f"{{{t}}}" in text})

    def __getattr__(self, name: str) -> DataFrame:
        if name in MODEL:
            return self.view(name)
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)


def oracle(sql: str) -> str:
    """The SQL with the model tables it names in front."""
    need = {}
    for name, text in MODEL.items():
        if re.search(rf"\b{name}\b", sql):
            need[name] = text
    body = sql.strip()
    heads = [f"{n} AS ({t})" for n, t in need.items()]
    if not heads:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {', '.join(heads)}, {body[14:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {', '.join(heads)}, {body[5:]}"
    return f"WITH {', '.join(heads)} {body}"
