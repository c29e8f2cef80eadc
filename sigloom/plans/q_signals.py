"""Signals, evidence and rankings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions.text import case
from ..operators import gold, ranking
from .catalogue import query

NOW = "(SELECT max(observed_at) FROM evidence)"


def now_of(m):
    """The latest observation, as a literal: one row comes to the driver."""
    return F.lit(m.evidence.agg(F.max("observed_at")).first()[0])


def summaries(m):
    return ranking.summarised(m.signal, m.evidence, m.source, m.connection, m.item_link, m.rule_execution, m.rule, m.insight, m.insight_signal)


COUNTS = """counts AS (SELECT e.signal_id, count(DISTINCT e.source_id) AS sources, count(DISTINCT item_id) AS items, count(*) AS evidence, max(observed_at) AS last_observed_at,
  count(DISTINCT CASE WHEN claim = 'contradiction' THEN item_id END) AS contradictions, count(DISTINCT CASE WHEN claim <> 'contradiction' THEN publisher END) AS publishers
  FROM evidence e LEFT JOIN source s ON e.source_id = s.source_id GROUP BY e.signal_id)"""


@query(f"WITH {COUNTS} SELECT * FROM counts")
def signal_counts(m):
    """What is behind each signal."""
    return ranking.signal_counts(m.evidence, m.source)


CONTEXTS = """ctx AS (SELECT signal_id, sum(strength) AS context_strength, count(*) AS contexts FROM
  (SELECT signal_id, target_id, max(strength) AS strength FROM connection WHERE relation = 'matches' GROUP BY 1, 2) GROUP BY 1)"""


@query(f"WITH {CONTEXTS} SELECT signal_id, round(context_strength, 6) AS context_strength, contexts FROM ctx")
def context_strength(m):
    """The strength of matched contexts."""
    return ranking.context_strength(m.connection).withColumn("context_strength", F.round("context_strength", 6))


PRIOR = "prior AS (SELECT s.signal_id, count(o.signal_id) AS prior_signals FROM signal s LEFT JOIN signal o ON s.subject_key = o.subject_key AND o.created_at < s.created_at GROUP BY 1)"


@query(f"WITH {PRIOR} SELECT * FROM prior")
def prior_on_subject(m):
    """Earlier signals of the same subject."""
    return ranking.prior_on_subject(m.signal)


RULES = """hits AS (SELECT e.signal_id, list_sort(list(DISTINCT r.name)) AS rules FROM evidence e JOIN rule_execution x ON e.item_id = x.item_id AND x.result = 'matched'
  JOIN rule r ON r.rule_id = x.rule_id AND r.action IN ('save', 'mark_important', 'create_attention_event') GROUP BY 1)"""


@query(f"WITH {RULES} SELECT signal_id, array_to_string(rules, '|') AS rules FROM hits")
def rule_hits(m):
    """Promoting rules that matched an item of the signal."""
    return ranking.rule_hits(m.evidence, m.rule_execution, m.rule).withColumn("rules", F.array_join("rules", "|"))


OPEN = """asked AS (SELECT l.signal_id, count(DISTINCT i.insight_id) AS open_questions FROM insight_signal l JOIN insight i ON i.insight_id = l.insight_id
  WHERE i.status = 'open' AND i.kind IN ('question', 'hypothesis', 'investigation') GROUP BY 1)"""


@query(f"WITH {OPEN} SELECT * FROM asked")
def open_questions(m):
    """Open questions about the signal."""
    return ranking.open_questions(m.insight, m.insight_signal)


TOTAL = f"""WITH {COUNTS}, {CONTEXTS}, {PRIOR}, {RULES}, {OPEN},
links AS (SELECT signal_id, max(strength) AS link_strength FROM item_link GROUP BY 1),
joined AS (SELECT s.*, coalesce(sources, 0) AS sources, coalesce(publishers, 0) AS publishers, coalesce(contradictions, 0) AS contradictions, coalesce(last_observed_at, created_at) AS last_observed_at,
  coalesce(context_strength, 0) AS context_strength, coalesce(contexts, 0) AS contexts, coalesce(len(rules), 0) AS n_rules, rules, coalesce(open_questions, 0) AS open_questions, prior_signals, coalesce(link_strength, 0) AS link_strength
  FROM signal s LEFT JOIN counts USING (signal_id) LEFT JOIN ctx USING (signal_id) LEFT JOIN hits USING (signal_id) LEFT JOIN asked USING (signal_id) LEFT JOIN prior USING (signal_id) LEFT JOIN links USING (signal_id)),
factors AS (SELECT *,
  round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, context_strength)) * 3.0::DOUBLE, 6) AS c_context, CASE WHEN n_rules > 0 THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS c_rules,
  round(least(1.0::DOUBLE, (least(greatest(publishers, 1), greatest(sources, 1)) - 1)::DOUBLE / 3.0::DOUBLE) * 1.5::DOUBLE, 6) AS c_corroboration,
  round(least(1.0::DOUBLE, open_questions::DOUBLE / 2.0::DOUBLE) * 1.0::DOUBLE, 6) AS c_open_questions, CASE WHEN contradictions > 0 THEN 0.75::DOUBLE ELSE 0.0::DOUBLE END AS c_disputed,
  round(least(1.0::DOUBLE, link_strength) * 1.0::DOUBLE, 6) AS c_connection,
  round(CASE change_kind WHEN 'removes' THEN 1.0::DOUBLE WHEN 'adds' THEN 0.8::DOUBLE WHEN 'changes' THEN 0.6::DOUBLE WHEN 'fixes' THEN 0.4::DOUBLE ELSE 0.15::DOUBLE END, 6) AS c_change,
  round(1.0::DOUBLE / (1.0::DOUBLE + prior_signals::DOUBLE) * 0.75::DOUBLE, 6) AS c_novelty,
  round(pow(0.5::DOUBLE, greatest(0, floor((epoch({NOW}) - epoch(last_observed_at)) / 60))::DOUBLE / 60.0::DOUBLE / 72.0::DOUBLE), 6) AS c_recency FROM joined),
totals AS (SELECT *, CASE WHEN status = 'open' THEN round(c_context + c_rules + c_corroboration + c_open_questions + c_disputed + c_connection + c_change + c_novelty + c_recency, 6) ELSE 0.0::DOUBLE END AS total FROM factors),
placed AS (SELECT *, CASE WHEN status = 'open' THEN row_number() OVER (PARTITION BY status = 'open' ORDER BY total DESC, last_observed_at DESC, signal_id) ELSE 0 END::BIGINT AS position FROM totals)"""


@query(f"{TOTAL} SELECT signal_id, status, total, position, sources::BIGINT AS sources, publishers::BIGINT AS publishers, contradictions::BIGINT AS contradictions, c_context, c_novelty, c_recency FROM placed")
def today_ranking(m):
    """The ranking of all signals."""
    return ranking.ranked(summaries(m), now_of(m)).select("signal_id", "status", "total", "position", "sources", "publishers", "contradictions", "c_context", "c_novelty", "c_recency")


@query(f"{TOTAL} SELECT signal_id, total, position FROM placed WHERE status = 'open'")
def today(m):
    """What is eligible for today, in its order."""
    return ranking.ranked(summaries(m), now_of(m)).filter("eligible").select("signal_id", "total", "position")


@query(f"""{TOTAL}, says AS (SELECT signal_id, status, unnest([
  {{'c': c_context, 'i': 0, 's': CASE WHEN contexts = 0 THEN 'Not connected to anything you''ve said you care about.' ELSE 'Connects to ' || contexts || ' contexts.' END}},
  {{'c': c_rules, 'i': 1, 's': CASE WHEN n_rules = 0 THEN 'No rule of yours matched.' ELSE 'Matched your rule' || CASE WHEN n_rules = 1 THEN '' ELSE 's' END || ' ' || array_to_string(rules, ', ') || '.' END}},
  {{'c': c_corroboration, 'i': 2, 's': CASE WHEN sources <= 1 THEN 'Observed by a single source.' WHEN publishers <= 1 THEN sources || ' sources, all from one publisher — not independent.' WHEN publishers >= sources THEN sources || ' independent sources describe this change.' ELSE sources || ' sources from ' || publishers || ' independent publishers describe this change.' END}},
  {{'c': c_open_questions, 'i': 3, 's': CASE open_questions WHEN 0 THEN 'No open questions of yours about this.' WHEN 1 THEN 'You have 1 open question or investigation about this.' ELSE 'You have ' || open_questions || ' open questions or investigations about this.' END}},
  {{'c': c_disputed, 'i': 4, 's': CASE contradictions WHEN 0 THEN 'No source disputes it.' WHEN 1 THEN 'One source disputes it — unresolved.' ELSE contradictions || ' sources dispute it — unresolved.' END}},
  {{'c': c_connection, 'i': 5, 's': CASE WHEN link_strength > 0 THEN 'Links to earlier observations (strength ' || format('{{:.2f}}', link_strength) || ').' ELSE 'No link to earlier observations yet.' END}},
  {{'c': c_change, 'i': 6, 's': 'Change type: ' || change_kind || '.'}},
  {{'c': c_novelty, 'i': 7, 's': CASE prior_signals WHEN 0 THEN 'The first signal about this subject.' WHEN 1 THEN '1 earlier signal about this subject.' ELSE prior_signals || ' earlier signals about this subject.' END}}]) AS f FROM placed),
top AS (SELECT signal_id, status, f, row_number() OVER (PARTITION BY signal_id ORDER BY f.c DESC, f.i) AS k FROM says WHERE f.c > 0 )
SELECT signal_id, string_agg(rtrim(f.s, '.'), '; ' ORDER BY k) || '.' AS summary FROM top WHERE k <= 2 AND status = 'open' GROUP BY signal_id
UNION ALL SELECT signal_id, 'Not shown in Today: this signal is ' || status || '.' FROM signal WHERE status <> 'open'""")
def today_top_factors(m):
    """the leading factors but recency, whose age is shown by the ranking itself."""
    rows = ranking.ranked(summaries(m), now_of(m)).withColumn("c_recency", F.lit(0.0))
    return ranking.leading(rows, now_of(m))


@query("""SELECT signal_id, target_id, arg_min(relation, (CASE WHEN relation = 'via' THEN 1 ELSE 0 END, -strength, connection_id)) AS relation,
  arg_min(strength, (CASE WHEN relation = 'via' THEN 1 ELSE 0 END, -strength, connection_id)) AS strength FROM connection GROUP BY 1, 2""")
def connected_labels(m):
    """The best connection of each signal and target; a via never replaces a match."""
    return gold.best_connections(m.connection).select("signal_id", "target_id", "relation", "strength")


@query("""SELECT target_id AS context_id, signal_id, CASE WHEN bool_or(relation = 'matches') THEN 'matches' ELSE 'via' END AS relation,
  greatest(arg_min(strength, (connection_id, strength)), coalesce(max(CASE WHEN relation = 'matches' THEN strength END), 0)) AS strength FROM connection GROUP BY 1, 2""")
def context_graph(m):
    """Edges between contexts and signals."""
    return gold.context_edges(m.connection)


@query("SELECT subject_key, count(*) AS signals, count(DISTINCT e.item_id) AS observations, arg_min(s.topic, s.signal_id) AS label FROM signal s LEFT JOIN (SELECT DISTINCT signal_id, item_id FROM evidence) e ON s.signal_id = e.signal_id GROUP BY 1".replace("count(*) AS signals", "count(DISTINCT s.signal_id) AS signals"))
def subject_graph(m):
    """Subjects, their signals and distinct observations; the first label stays."""
    return gold.subject_nodes(m.signal, m.evidence)


@query("""WITH best AS (SELECT signal_id, target_id, max(strength) AS strength FROM connection WHERE relation = 'matches' GROUP BY 1, 2)
SELECT target_id AS id, 'context' AS over, count(*) AS signals FROM best GROUP BY 1 HAVING count(*) >= 2
UNION ALL SELECT min(signal_id % 13), 'topic', count(*) FROM signal GROUP BY topic HAVING count(*) >= 2""")
def patterns(m):
    """Contexts and topics that several signals share."""
    return gold.patterns(m.connection, m.signal)


@query("""WITH o AS (SELECT signal_id, item_id, bool_or(claim = 'contradiction') AS disputes, min(observed_at) AS first, count(*) AS evidence, count(DISTINCT source_id) AS s FROM evidence GROUP BY 1, 2)
SELECT signal_id, count(*) AS observations, count(*) FILTER (WHERE NOT disputes) AS supporters, count(*) FILTER (WHERE disputes) AS disputers, min(first) AS first_at FROM o GROUP BY 1 HAVING count(*) >= 2""")
def synthesis_counts(m):
    """What a synthesis is made from; two items at least."""
    return gold.observations(m.evidence).groupBy("signal_id").agg(F.count("*").alias("observations"), F.count_if(~F.col("disputes")).alias("supporters"), F.count_if("disputes").alias("disputers"), F.min("first_at").alias("first_at")).filter("observations >= 2")


@query("""WITH o AS (SELECT signal_id, item_id, bool_or(claim = 'contradiction') AS disputes, min(observed_at) AS first FROM evidence GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY first, item_id) AS k FROM o)
SELECT signal_id, item_id, first AS at, CASE WHEN k = 1 THEN 'observed' WHEN disputes THEN 'disputed' ELSE 'corroborated' END AS kind FROM r""")
def timeline_roles(m):
    """How each item came into the history of its signal."""
    return gold.timeline_roles(m.evidence)


PRIORITY = "CASE claim WHEN 'change' THEN 0 WHEN 'corroboration' THEN 1 WHEN 'contradiction' THEN 2 WHEN 'detail' THEN 3 ELSE 6 END"


@query(f"""WITH d AS (SELECT *, {PRIORITY} AS p, row_number() OVER (PARTITION BY signal_id, item_id, claim, excerpt ORDER BY observed_at, evidence_id) AS copy FROM evidence),
r AS (SELECT *, row_number() OVER (PARTITION BY signal_id, p ORDER BY observed_at, evidence_id) AS round FROM d WHERE copy = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY round, p) AS place FROM r)
SELECT signal_id, evidence_id, claim, round::BIGINT AS round, place::BIGINT AS place FROM k WHERE place <= 16""")
def evidence_round_robin(m):
    """Evidence within the budget of a signal, claim kinds in turn."""
    return gold.round_robin(m.evidence).select("signal_id", "evidence_id", "claim", "round", "place")


@query("""SELECT item_id, excerpt, string_agg(DISTINCT claim, ',' ORDER BY claim) AS claims, count(*) AS n FROM evidence GROUP BY 1, 2""")
def evidence_groups(m):
    """Evidence with one excerpt, shown once with its claims."""
    return m.evidence.groupBy("item_id", "excerpt").agg(F.array_join(F.array_sort(F.collect_set("claim")), ",").alias("claims"), F.count("*").alias("n"))


@query(f"""SELECT evidence_id, signal_id, row_number() OVER (PARTITION BY signal_id ORDER BY {PRIORITY}, observed_at, evidence_id)::BIGINT AS place FROM evidence""")
def claims_ordered(m):
    """Claims of a signal by rank, then by time."""
    rank = case(F.col("claim"), L.CLAIM_PRIORITY)
    return m.evidence.select("evidence_id", "signal_id", F.row_number().over(Window.partitionBy("signal_id").orderBy(rank, "observed_at", "evidence_id")).cast("long").alias("place"))


@query("""WITH b AS (SELECT signal_id, target_id FROM connection WHERE relation = 'matches' GROUP BY 1, 2),
n AS (SELECT a.context_id AS a, c.context_id AS b FROM context a JOIN context c ON a.family = c.family AND a.context_id <> c.context_id)
SELECT b.signal_id, n.b AS target_id, round(max(s.strength) * 0.5, 6) AS strength FROM b
JOIN (SELECT signal_id, target_id, max(strength) AS strength FROM connection WHERE relation = 'matches' GROUP BY 1, 2) s ON s.signal_id = b.signal_id AND s.target_id = b.target_id
JOIN n ON n.a = b.target_id WHERE NOT EXISTS (SELECT 1 FROM connection x WHERE x.signal_id = b.signal_id AND x.target_id = n.b) GROUP BY 1, 2""")
def via_connections(m):
    """Contexts next to matched ones, at half the strength, unless connected already."""
    return gold.via_connections(m.connection, gold.neighbours_by(m.context, "family"))


@query("SELECT a.context_id, string_agg(b.name, ',' ORDER BY b.name) AS neighbours, count(*) AS n FROM context a JOIN context b ON a.family = b.family AND a.context_id <> b.context_id GROUP BY 1")
def context_neighbours(m):
    """The contexts next to each."""
    edges = gold.neighbours_by(m.context, "family")
    return edges.join(m.context.select(F.col("context_id").alias("b"), "name"), "b").groupBy(F.col("a").alias("context_id")).agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("neighbours"), F.count("*").alias("n"))


@query("SELECT signal_id, evidence_id, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, (strength + tax + 0.5::DOUBLE) / 3.0::DOUBLE)), 3) AS confidence FROM evidence")
def confidences(m):
    """The mean of three confidences, clamped, three digits."""
    return m.evidence.select("signal_id", "evidence_id", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("strength") + F.col("tax") + 0.5) / 3.0)), 3).alias("confidence"))


@query("""SELECT signal_id, signal_id % 11 = 0 OR signal_id IN (SELECT signal_id FROM connection WHERE relation = 'matches') OR signal_id IN (SELECT signal_id FROM item_link WHERE strength >= 0.7)
  OR (status = 'open' AND change_kind <> 'describes') AS meaningful FROM signal""")
def meaningful(m):
    """C11: the user's own, matched by a context, a known change told again, or a fresh change that is no description."""
    known = lambda rows, name: rows.select("signal_id").distinct().withColumn(name, F.lit(True))
    met = m.signal.join(known(m.connection.filter("relation = 'matches'"), "matched"), "signal_id", "left").join(known(m.item_link.filter("strength >= 0.7"), "again"), "signal_id", "left")
    said = gold.is_meaningful(F.col("signal_id") % 11 == 0, F.coalesce("matched", F.lit(False)), F.coalesce("again", F.lit(False)), F.col("status") == "open", F.col("change_kind"))
    return met.select("signal_id", said.alias("meaningful"))


@query("""WITH t AS (SELECT signal_id, target_id, max(strength) AS strength FROM connection WHERE relation = 'matches' GROUP BY 1, 2),
p AS (SELECT signal_id, target_id, row_number() OVER (PARTITION BY signal_id ORDER BY strength DESC, target_id) AS k FROM t)
SELECT a.signal_id AS a, b.signal_id AS b, count(*) AS shared FROM p a JOIN p b ON a.target_id = b.target_id AND a.signal_id < b.signal_id
JOIN signal s ON s.signal_id = a.signal_id JOIN signal u ON u.signal_id = b.signal_id AND u.subject_key = s.subject_key WHERE a.k = 1 AND b.k = 1 GROUP BY 1, 2""")
def related_pairs(m):
    """Signals of one subject whose strongest context is the same."""
    best = m.connection.filter("relation = 'matches'").groupBy("signal_id", "target_id").agg(F.max("strength").alias("strength"))
    first = best.withColumn("k", F.row_number().over(Window.partitionBy("signal_id").orderBy(F.desc("strength"), "target_id"))).filter("k = 1").join(m.signal.select("signal_id", "subject_key"), "signal_id")
    a, b = (first.select(F.col("signal_id").alias(x), "target_id", "subject_key") for x in "ab")
    return a.join(b, ["target_id", "subject_key"]).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
