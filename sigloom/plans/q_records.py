"""Records: observations, contexts, surfaces, stages, statuses, cards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import observe, records
from .catalogue import query


@query("SELECT l_partkey || ':' || l_linenumber AS key, l_partkey AS item_id, arg_max(l_suppkey, (l_shipdate, l_orderkey, l_suppkey)) AS source_id, max(l_shipdate) AS observed_at, count(*) AS times FROM lineitem GROUP BY 1, 2")
def observation_records(m):
    """What is known of each item and original identifier."""
    seen = m.lineitem.select(F.col("l_partkey").alias("item_id"), F.col("l_linenumber").alias("original_identifier"), F.col("l_suppkey").alias("source_id"), F.col("l_shipdate").alias("observed_at"), F.struct("l_orderkey", "l_suppkey").alias("seq"))
    return records.observation_records(seen)


@query("""WITH e AS (SELECT c_custkey AS seq, c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN '!' ELSE '' END AS name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS description, 'n' || c_nationkey % 4 AS alias FROM customer)
SELECT lower(rtrim(name, '!')) AS name_key, arg_min(name, seq) AS name, arg_max(description, (description <> '', seq)) AS description, string_agg(DISTINCT alias, ',' ORDER BY alias) AS aliases FROM e GROUP BY 1""")
def merged_contexts(m):
    """Contexts told several times are one."""
    c = F.col
    entries = m.customer.select(c("c_custkey").alias("seq"), F.concat("c_mktsegment", F.when(c("c_custkey") % 2 == 0, "!").otherwise("")).alias("name"), F.lit("interest").alias("kind"), F.when(c("c_custkey") % 3 == 0, "").otherwise(c("c_name")).alias("description"), F.array(F.concat(F.lit("n"), (c("c_nationkey") % 4).cast("string"))).alias("aliases"))
    return records.merged_contexts(entries).select("name_key", "name", "description", F.array_join("aliases", ",").alias("aliases"))


@query("""WITH o AS (SELECT signal_id FROM signal WHERE status = 'open' ORDER BY created_at DESC, signal_id LIMIT 200), t AS (SELECT DISTINCT signal_id, 3 AS target_id FROM evidence WHERE item_id % 10 = 0)
SELECT t.signal_id, t.target_id FROM t JOIN o ON o.signal_id = t.signal_id WHERE NOT EXISTS (SELECT 1 FROM connection c WHERE c.signal_id = t.signal_id AND c.target_id = t.target_id AND c.relation = 'matches')""")
def reevaluated(m):
    """Open signals that a new context meets."""
    matches = m.evidence.filter("item_id % 10 = 0").select("signal_id", F.lit(3).alias("target_id")).distinct()
    return records.reevaluated(m.signal, matches, m.connection)


@query("SELECT user_id AS target_id, event_type AS url, min(ts) AS discovered_at, max(ts) AS last_confirmed_at, count(*) AS confirmations FROM events GROUP BY 1, 2")
def registered_surfaces(m):
    """Surfaces registered and confirmed."""
    rows = m.events.select(F.col("user_id").alias("target_id"), F.col("event_type").alias("url"), F.col("ts").alias("at"), "event_id")
    return records.registered_surfaces(rows.filter("event_id % 2 = 0"), rows.filter("event_id % 2 = 1"))


@query("""WITH l AS (SELECT user_id AS source_id, date_trunc('day', ts) AS run, CASE event_type WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'signup' THEN 4 WHEN 'purchase' THEN 6 ELSE 7 END AS rank FROM events),
g AS (SELECT source_id, run, max(rank) AS rank FROM l GROUP BY 1, 2)
SELECT source_id, max(run) AS run, ['queued', 'fetching', 'understanding', 'connecting', 'building_signal', 'observed', 'failed'][arg_max(rank, run)] AS stage, arg_max(rank, run) = 7 AS failed FROM g GROUP BY 1""")
def stages(m):
    """How far the last run of each source came."""
    e = F.col("event_type")
    stage = F.when(e == "view", "fetching").when(e == "click", "understanding").when(e == "signup", "connecting").when(e == "purchase", "observed").otherwise("failed")
    return records.stages(m.events.select(F.col("user_id").alias("source_id"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("run"), stage.alias("stage")))


@query("SELECT o_orderkey AS signal_id, coalesce(l.now, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'resolved' ELSE 'dismissed' END) AS status FROM orders LEFT JOIN (SELECT l_orderkey, CASE WHEN max(l_linenumber) % 2 = 0 THEN 'resolved' ELSE 'open' END AS now FROM lineitem WHERE l_linenumber > 4 GROUP BY 1) l ON l.l_orderkey = o_orderkey")
def statuses(m):
    """Statuses after their transitions."""
    events = m.lineitem.filter("l_linenumber > 4").select(F.col("l_orderkey").alias("signal_id"), F.when(F.col("l_linenumber") % 2 == 0, "resolved").otherwise("open").alias("status"), F.col("l_linenumber").alias("seq"))
    return records.statuses(m.signal, events, "signal_id")


@query("""SELECT l_orderkey AS answer_id, arg_min(l_shipdate::DATE::VARCHAR || '/' || l_partkey, (l_returnflag <> 'R', l_linenumber, l_partkey, l_shipdate)) AS statement, string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS evidence FROM lineitem GROUP BY 1""")
def saved_statements(m):
    """The statement of an answer that is saved, and all it cites."""
    c = F.col
    s = m.lineitem.select(c("l_orderkey").alias("answer_id"), F.struct("l_linenumber", "l_partkey", "l_shipdate").alias("place"), F.when(c("l_returnflag") == "R", "inferred").otherwise("observed").alias("basis"), F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("/"), c("l_partkey").cast("string")).alias("text"), F.array(c("l_suppkey").cast("string")).alias("evidence_ids"))
    return records.saved_statement(s).select("answer_id", "statement", F.array_join("evidence_ids", ",").alias("evidence"))


@query("SELECT p.item_id, p.prior_id, p.shared FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, prior_id) AS k FROM (SELECT l_suppkey AS item_id, l_partkey AS prior_id, count(*) AS shared FROM lineitem GROUP BY 1, 2)) p WHERE k <= 12")
def prior_candidates(m):
    """Priors that a model is shown."""
    shared = m.lineitem.groupBy(F.col("l_suppkey").alias("item_id"), F.col("l_partkey").alias("prior_id")).agg(F.count("*").alias("shared"))
    return records.prior_candidates(shared).select("item_id", "prior_id", "shared")


@query("SELECT source_id AS position, '#' || source_id || ' ' || title || ' · adds · ' || target_id || ' sources' AS card FROM source")
def cards(m):
    """Signals as text."""
    return records.card(m.source.select(F.col("source_id").alias("position"), F.col("title").alias("subject"), F.lit("adds").alias("change_kind"), F.col("target_id").alias("sources")))


@query("SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS json FROM nation")
def envelopes(m):
    """Rows as JSON."""
    return records.envelope(m.nation.select("n_nationkey", "n_name"))


@query("SELECT source_id, CASE WHEN status = 'paused' THEN 'Paused' WHEN target_id = 0 THEN 'Looking for information surfaces' WHEN target_id = 1 THEN 'Watching 1 surface' ELSE 'Watching ' || target_id || ' surfaces' END AS label FROM source")
def watching_labels(m):
    """What is watched, in words."""
    return m.source.select("source_id", records.label(F.col("status"), F.col("target_id")).alias("label"))


@query("SELECT page_id, 'https://s.org/docs/p' || k AS \"to\" FROM pages, (SELECT unnest([1, 3, 4, 5, 6]) AS k)")
def new_pages(m):
    """Pages below a section that were not linked before; five of each page at most."""
    links = m.pages.select("page_id", F.explode(F.array(*[F.struct(F.lit(u).alias("to"), F.lit(n).alias("in_navigation")) for u, n in [(f"https://s.org/docs/p{k}", False) for k in range(1, 9)] + [("https://s.org/docs/", False), ("https://other.org/docs/x", False), ("https://s.org/docs/n", True)]])).alias("l")).select("page_id", "l.*")
    before = m.pages.select("page_id", F.lit("https://s.org/docs/p2").alias("to"))
    return observe.new_pages(links, before, F.lit("https://s.org/docs/")).select("page_id", "to")
