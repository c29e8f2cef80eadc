"""Items: scans, filters, joins, rules, deduplication, state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import blank_as_null
from ..operators import items
from .catalogue import query


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def table_scan(m):
    """A scan of the columns asked for."""
    return m.orders.select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'")
def equality_filter(m):
    """Equality, pushed to the scan."""
    return m.orders.filter((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "1-URGENT")).select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey = 77")
def point_lookup(m):
    """One row by its key."""
    return m.part.filter("p_partkey = 77").select("p_partkey", "p_name", "p_size")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def insert_absent(m):
    """Rows whose keys are not there yet."""
    return items.insert_absent(m.orders.select(F.col("o_custkey").alias("c_custkey")), m.customer, "c_custkey").select("c_custkey", "c_name")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def upsert_latest(m):
    """The latest version of each key wins."""
    half = m.events.select("user_id", "event_id", "event_type")
    return items.upsert(half.filter("event_id % 2 = 0"), half.filter("event_id % 2 = 1"), "user_id", "event_id")


@query("SELECT item_id, source_id, published_at FROM item WHERE source_kind = 'web' AND published_at > 1704067200 + 12000 AND contains(lower(concat_ws(' ', title, content_text, author, canonical_url)), 'the') AND contains(lower(concat_ws(' ', title, content_text, author, canonical_url)), 'src1')")
def search_tokens(m):
    """Search by words and filters."""
    return items.search(m.item, "the SRC1", source_kind="web", after=1704067200 + 12000).select("item_id", "source_id", "published_at")


@query("SELECT item.item_id, coalesce(state, 'unseen') AS state, title FROM item LEFT JOIN item_state USING (item_id)")
def hydrate_items(m):
    """Items with their state."""
    return items.hydrated(m.item, m.item_state).select("item_id", "state", "title")


@query("""WITH h AS (SELECT item.item_id, published_at, coalesce(state, 'unseen') AS state FROM item LEFT JOIN item_state USING (item_id))
SELECT 'unread' AS filter, count(*) FILTER (WHERE state = 'unseen') AS n FROM h UNION ALL SELECT 'saved', count(*) FILTER (WHERE state = 'saved') FROM h
UNION ALL SELECT 'important', count(*) FILTER (WHERE state = 'important') FROM h UNION ALL SELECT 'recent', count(*) FILTER (WHERE published_at > 1704067200 + 30000) FROM h UNION ALL SELECT 'list', count(*) FROM h""")
def saved_filters(m):
    """The saved filters; unread is unseen only."""
    h = items.hydrated(m.item, m.item_state)
    found = {"unread": items.search(h, state="unseen"), "saved": items.search(h, state="saved"), "important": items.search(h, state="important"), "recent": items.search(h, after=1704067200 + 30000), "list": h}
    counts = [rows.agg(F.lit(name).alias("filter"), F.count("*").alias("n")) for name, rows in found.items()]
    return reduce(lambda a, b: a.unionByName(b), counts)


@query("""SELECT item_id, rule_id, action, CASE WHEN enabled AND (source_filter IS NULL OR source_id = source_filter) AND (kind_filter IS NULL OR source_kind = kind_filter)
  AND (title_pattern IS NULL OR contains(lower(title), lower(title_pattern))) AND (author_pattern IS NULL OR contains(lower(author), lower(author_pattern)))
  AND (content_pattern IS NULL OR contains(lower(content_text), lower(content_pattern))) AND (url_pattern IS NULL OR contains(lower(canonical_url), lower(url_pattern)))
  AND (published_after IS NULL OR published_at >= published_after) THEN 'matched' ELSE 'skipped' END AS result FROM item CROSS JOIN rule""")
def rule_matches(m):
    """Every rule on every new item, skipped ones logged too."""
    return items.apply_rules(m.item, m.rule)


@query("""SELECT item_id, rule_id, action FROM item JOIN rule ON enabled AND (source_filter IS NULL OR source_id = source_filter) AND (kind_filter IS NULL OR source_kind = kind_filter)
  AND (title_pattern IS NULL OR contains(lower(title), lower(title_pattern))) AND (author_pattern IS NULL OR contains(lower(author), lower(author_pattern)))
  AND (content_pattern IS NULL OR contains(lower(content_text), lower(content_pattern))) AND (url_pattern IS NULL OR contains(lower(canonical_url), lower(url_pattern)))
  AND (published_after IS NULL OR published_at >= published_after)""")
def matched_rules(m):
    """The rules that items match, fetched through what fewest items have."""
    return items.matched_rules(m.item, m.rule)


@query("""WITH o AS (SELECT item_id AS seq, md5(concat(title, '|', content_text, '|', source_id)) AS fingerprint, canonical_identity FROM item),
p AS (SELECT *, min(seq) OVER (PARTITION BY fingerprint) AS ps, min(seq) OVER (PARTITION BY canonical_identity) AS si FROM o)
SELECT seq, CASE WHEN ps < seq THEN 'fingerprint' WHEN si < seq THEN 'identity' ELSE 'new' END AS outcome, CASE WHEN ps < seq THEN least(ps, si) WHEN si < seq THEN si ELSE seq END AS item_seq FROM p""")
def dedup_observed(m):
    """What becomes of each observed item."""
    return items.deduplicated(m.item.select(F.col("item_id").alias("seq"), F.md5(F.concat_ws("|", "title", "content_text", "source_id")).alias("fingerprint"), "canonical_identity"))


@query("""WITH o AS (SELECT item_id AS seq, md5(concat(title, '|', content_text, '|', source_id)) AS fingerprint, canonical_identity FROM item),
p AS (SELECT *, min(seq) OVER (PARTITION BY fingerprint) AS ps, min(seq) OVER (PARTITION BY canonical_identity) AS si FROM o)
SELECT count(*) AS items, count(*) FILTER (WHERE ps < seq OR si < seq) AS duplicates, count(*) FILTER (WHERE NOT (ps < seq OR si < seq)) AS retained FROM p""")
def attempt_counters(m):
    """Counters of an observation."""
    out = items.deduplicated(m.item.select(F.col("item_id").alias("seq"), F.md5(F.concat_ws("|", "title", "content_text", "source_id")).alias("fingerprint"), "canonical_identity"))
    return out.agg(F.count("*").alias("items"), F.count_if(F.col("outcome") != "new").alias("duplicates"), F.count_if(F.col("outcome") == "new").alias("retained"))


@query("SELECT user_id AS item_id, arg_max(event_type, event_id) AS state, max(ts) AS updated_at, count(DISTINCT event_type) AS states FROM events GROUP BY 1".replace("arg_max(event_type, event_id)", "arg_max(event_type, (ts, event_id))"))
def item_state_latest(m):
    """The state after all transitions."""
    return items.transitions(m.events.select(F.col("user_id").alias("item_id"), F.col("event_type").alias("state"), F.col("ts").alias("at"), F.col("event_id").alias("seq")))


@query("SELECT item_id, arg_max(source_id, (observed_at, provenance_id, source_id)) AS source_id, max(observed_at) AS observed_at FROM provenance GROUP BY 1")
def latest_provenance(m):
    """where an item was last seen."""
    return m.provenance.groupBy("item_id").agg(F.max_by("source_id", F.struct("observed_at", "provenance_id", "source_id")).alias("source_id"), F.max("observed_at").alias("observed_at"))


@query("""SELECT e.evidence_id, e.claim, e.excerpt, p.p_name AS item_title, s.title AS source_title, n.n_name AS publisher FROM evidence e LEFT JOIN part p ON p.p_partkey = e.item_id
  LEFT JOIN source s ON s.source_id = e.source_id LEFT JOIN nation n ON n.n_nationkey = s.publisher""")
def evidence_trace(m):
    """Evidence with its item, source and publisher."""
    e = m.evidence.join(m.part.select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("item_title")), "item_id", "left")
    e = e.join(m.source.select("source_id", F.col("title").alias("source_title"), "publisher"), "source_id", "left").withColumnRenamed("publisher", "n_nationkey")
    return e.join(m.nation.select("n_nationkey", F.col("n_name").alias("publisher")), "n_nationkey", "left").select("evidence_id", "claim", "excerpt", "item_title", "source_title", "publisher")


@query("SELECT signal_id, target_id, coalesce(c.name, 'gone') AS label, relation FROM connection LEFT JOIN (SELECT * FROM context WHERE family <> 3) c ON c.context_id = target_id")
def connection_labels(m):
    """The name a context has now, where it still exists."""
    contexts = m.context.filter("family <> 3").select(F.col("context_id").alias("target_id"), "name")
    return m.connection.join(contexts, "target_id", "left").select("signal_id", "target_id", F.coalesce("name", F.lit("gone")).alias("label"), "relation")


@query("SELECT connection_id, signal_id, target_id, strength FROM connection WHERE target_id = 3 OR signal_id IN (SELECT signal_id FROM evidence WHERE item_id = 5) OR signal_id = 7")
def connection_filter(m):
    """Connections of a target, a signal, or an item's signals."""
    of_item = m.evidence.filter("item_id = 5").select("signal_id").distinct().withColumn("of_item", F.lit(True))
    return m.connection.join(of_item, "signal_id", "left").filter("target_id = 3 OR signal_id = 7 OR coalesce(of_item, false)").select("connection_id", "signal_id", "target_id", "strength")


@query("SELECT DISTINCT s.target_id, e.signal_id FROM source s JOIN evidence e ON e.source_id = s.source_id WHERE s.status = 'active'")
def target_signals(m):
    """Signals that a target's sources speak of."""
    return m.source.filter("status = 'active'").select("target_id", "source_id").join(m.evidence.select("source_id", "signal_id"), "source_id").select("target_id", "signal_id").distinct()


@query("""SELECT s.target_id, count(DISTINCT s.source_id) AS sources, count(DISTINCT CASE WHEN s.status = 'failing' THEN s.source_id END) AS failing, count(DISTINCT e.signal_id) AS signals
  FROM source s LEFT JOIN evidence e ON e.source_id = s.source_id GROUP BY 1""")
def target_summary(m):
    """All targets at once."""
    seen = m.source.join(m.evidence.select("source_id", "signal_id").distinct(), "source_id", "left")
    return seen.groupBy("target_id").agg(F.countDistinct("source_id").alias("sources"), F.countDistinct(F.when(F.col("status") == "failing", F.col("source_id"))).alias("failing"), F.countDistinct("signal_id").alias("signals"))


@query("SELECT item_id, title, r FROM (SELECT item_id, title, row_number() OVER (PARTITION BY source_id ORDER BY published_at DESC NULLS LAST, item_id) AS r FROM item) WHERE r <= 25")
def feed_newest(m):
    """The newest 25 of each source."""
    return m.item.withColumn("r", F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc_nulls_last("published_at"), "item_id")).cast("long")).filter("r <= 25").select("item_id", "title", "r")


@query("""WITH l AS (SELECT item_id, signal_id, observed_at, row_number() OVER (PARTITION BY item_id ORDER BY observed_at DESC, evidence_id DESC, signal_id DESC) AS k FROM evidence)
SELECT item_id, signal_id, observed_at FROM l WHERE k = 1 ORDER BY observed_at DESC, item_id LIMIT 200""")
def priors(m):
    """The items whose evidence is newest, 200 of them."""
    last = items.latest(m.evidence.select("item_id", "signal_id", "observed_at", "evidence_id"), "item_id", "observed_at", "evidence_id", "signal_id")
    return last.orderBy(F.desc("observed_at"), "item_id").limit(200).select("item_id", "signal_id", "observed_at")


@query("""SELECT (SELECT count(*) FROM item) AS items, (SELECT count(*) FROM item LEFT JOIN item_state USING (item_id) WHERE coalesce(state, 'unseen') IN ('unseen', 'seen')) AS unread_items,
  (SELECT count(*) FROM item_state WHERE state = 'saved') AS saved_items, (SELECT count(*) FROM item_state WHERE state = 'important') AS important_items, (SELECT count(*) FROM observation WHERE status = 'failed') AS failures,
  (SELECT count(*) FROM source WHERE status = 'failing') AS failing_sources, (SELECT count(*) FROM source WHERE coalesce(last_success_at, last_checked_at) < 1706745600 - 172800) AS stale_sources""")
def attention_summary(m):
    """What needs attention; here unread is unseen or seen."""
    h = items.hydrated(m.item, m.item_state).agg(F.count("*").alias("items"), F.count_if(F.col("state").isin("unseen", "seen")).alias("unread_items"), F.count_if(F.col("state") == "saved").alias("saved_items"), F.count_if(F.col("state") == "important").alias("important_items"))
    o = m.observation.agg(F.count_if(F.col("status") == "failed").alias("failures"))
    s = m.source.agg(F.count_if(F.col("status") == "failing").alias("failing_sources"), F.count_if(F.coalesce("last_success_at", "last_checked_at") < 1706745600 - 172800).alias("stale_sources"))
    return h.crossJoin(o).crossJoin(s)


@query("SELECT doc_id, CASE WHEN trim(x) <> '' THEN x END AS text_or_null, coalesce(TRY_CAST(f AS DOUBLE), 0) AS number, k FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '  ' WHEN 1 THEN '' ELSE source END AS x, CASE doc_id % 4 WHEN 0 THEN 'x' WHEN 1 THEN '0.25' ELSE NULL END AS f, CASE lang WHEN 'en' THEN 'web' WHEN 'fr' THEN 'rss' ELSE NULL END AS k FROM documents)")
def decoded_fields(m):
    """Blank is null, text that is no number is zero, names outside their domain are set apart."""
    x = F.when(F.col("doc_id") % 3 == 0, "  ").when(F.col("doc_id") % 3 == 1, "").otherwise(F.col("source"))
    f = F.when(F.col("doc_id") % 4 == 0, "x").when(F.col("doc_id") % 4 == 1, "0.25")
    kind = F.when(F.col("lang") == "en", "web").when(F.col("lang") == "fr", "rss").otherwise("none")
    return m.documents.select("doc_id", blank_as_null(x).alias("text_or_null"), F.coalesce(f.try_cast("double"), F.lit(0.0)).alias("number"), F.when(kind.isin("web", "rss", "atom", "github"), kind).alias("k"))


@query("SELECT event_id, CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 0 ELSE 1 END AS n, coalesce(json_extract_string(props, '$.k'), '') AS first FROM events")
def json_lists(m):
    """JSON text at the boundary becomes typed values; what is missing is empty."""
    k = F.get_json_object("props", "$.k")
    return m.events.select("event_id", F.when(k.isNull(), 0).otherwise(1).alias("n"), F.coalesce(k, F.lit("")).alias("first"))


@query("SELECT event_id, observed_at, status FROM observation ORDER BY observed_at DESC, event_id DESC LIMIT 50")
def event_log(m):
    """The newest events, without what is not for showing."""
    return m.observation.select("event_id", "observed_at", "status").orderBy(F.desc("observed_at"), F.desc("event_id")).limit(50)


@query("SELECT i.insight_id, string_agg(l.signal_id::VARCHAR, ',' ORDER BY l.signal_id) AS signals FROM insight i JOIN insight_signal l ON l.insight_id = i.insight_id GROUP BY 1")
def insight_views(m):
    """Insights with what they cite, in order."""
    cited = m.insight.select("insight_id").join(m.insight_signal, "insight_id").groupBy("insight_id").agg(F.array_sort(F.collect_list("signal_id")).alias("s"))
    return cited.select("insight_id", F.array_join(F.transform("s", lambda x: x.cast("string")), ",").alias("signals"))


@query("SELECT l.insight_id, l.signal_id FROM insight_signal l LEFT JOIN (SELECT DISTINCT signal_id FROM evidence) e ON e.signal_id = l.signal_id WHERE e.signal_id IS NULL")
def insight_integrity(m):
    """Citations of what is not there; an insight with one is refused."""
    return items.insert_absent(m.evidence, m.insight_signal, "signal_id").select("insight_id", "signal_id")


@query("SELECT DISTINCT s AS signal_id FROM (SELECT signal_id AS s FROM signal WHERE signal_id IN (1, 2, 3) UNION ALL SELECT signal_id FROM evidence WHERE item_id = 9 UNION ALL SELECT signal_id FROM evidence WHERE source_id = 4 UNION ALL SELECT signal_id FROM connection WHERE target_id = 2)")
def focus_signals(m):
    """What a question points at, directly or through items, sources and contexts."""
    parts = [m.signal.filter("signal_id IN (1, 2, 3)"), m.evidence.filter("item_id = 9"), m.evidence.filter("source_id = 4"), m.connection.filter("target_id = 2")]
    out = parts[0].select("signal_id")
    for p in parts[1:]:
        out = out.unionByName(p.select("signal_id"))
    return out.distinct()


@query("SELECT name, count(*) AS matched FROM rule_execution x JOIN rule r ON r.rule_id = x.rule_id WHERE result = 'matched' AND CAST(r.rule_id AS VARCHAR) LIKE '3%' GROUP BY 1")
def id_prefix(m):
    """Lookup by the beginning of an id."""
    return m.rule_execution.filter("result = 'matched'").join(m.rule.filter(F.startswith(F.col("rule_id").cast("string"), F.lit("3"))), "rule_id").groupBy("name").agg(F.count("*").alias("matched"))
