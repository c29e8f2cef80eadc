"""What a question is answered from: the signals of a bundle, their evidence, contexts, insights and how they relate."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import gold, ranking, records, retrieval
from .catalogue import query
from .q_observe import NOW, TARGETS, targets
from .q_retrieval import QUESTION
from .q_signals import PRIORITY, TOTAL, now_of, summaries

TOP = f"""{TOTAL}, c AS (SELECT signal_id, sum(CASE WHEN relation = 'via' THEN 2.0::DOUBLE ELSE 3.0::DOUBLE + 6.0::DOUBLE * strength END) AS by_context FROM connection WHERE target_id IN (SELECT context_id FROM context WHERE kind = 'project' OR lower(name) = 'germany') GROUP BY 1),
scored AS (SELECT p.signal_id, created_at, coalesce(by_context, 0) + 1.5::DOUBLE * CASE WHEN topic = 'topic7' THEN 1 ELSE 0 END AS own, status, total FROM placed p LEFT JOIN c ON c.signal_id = p.signal_id),
best AS (SELECT signal_id, created_at, round(own + CASE WHEN own = 0 AND status = 'open' THEN 0.5::DOUBLE + total / 20.0::DOUBLE ELSE 0 END, 6) AS score FROM scored WHERE own > 0 OR status = 'open'),
top AS (SELECT signal_id, score, row_number() OVER (ORDER BY score DESC, created_at DESC, signal_id) AS place FROM best QUALIFY place <= 8)"""


def bundle(m):
    """The signals that a question is answered from, with their places."""
    signals = m.signal.select("signal_id", "status", F.col("topic").alias("text"), F.col("created_at").alias("updated_at"))
    ranks = ranking.ranked(summaries(m), now_of(m)).select("signal_id", "total")
    scored = retrieval.scores(signals, m.connection, retrieval.mentioned(m.context, F.lit(QUESTION)), F.lit(QUESTION), ranks, True)
    best = retrieval.top_signals(scored)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("updated_at"), "signal_id")).cast("long"))


@query(f"{TOP} SELECT signal_id, score, place::BIGINT AS place FROM top")
def bundle_signals(m):
    """The eight best signals of a question."""
    return bundle(m).select("signal_id", "score", "place")


@query(f"""{TOP}, d AS (SELECT e.*, {PRIORITY} AS p, row_number() OVER (PARTITION BY e.signal_id, item_id, claim, excerpt ORDER BY observed_at, evidence_id) AS copy FROM evidence e JOIN top USING (signal_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY signal_id, p ORDER BY observed_at, evidence_id) AS round FROM d WHERE copy = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY round, p) AS seat FROM r),
ev AS (SELECT evidence_id, signal_id FROM k WHERE seat <= 16 ORDER BY signal_id, seat LIMIT 60)
SELECT 'evidence' AS part, evidence_id AS ref FROM ev UNION ALL SELECT 'signal', signal_id FROM top
UNION ALL SELECT DISTINCT 'context', target_id FROM connection JOIN top USING (signal_id) WHERE relation = 'matches'
UNION ALL SELECT DISTINCT 'insight', insight_id FROM insight_signal JOIN top USING (signal_id)""")
def bundle_parts(m):
    """What is in a bundle: signals, evidence within the budget, contexts and insights."""
    best = bundle(m).select("signal_id", "place")
    parts = retrieval.bundle_parts(best, m.evidence, m.connection, m.insight_signal)
    rows = [rows.select(F.lit(name).alias("part"), F.col(key).cast("long").alias("ref")) for name, (rows, key) in parts.items()]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


@query(f"""{TOP}, own AS (SELECT DISTINCT item_id, place FROM evidence JOIN top USING (signal_id)),
told AS (SELECT least(x.place, y.place) AS i, greatest(x.place, y.place) AS j, 0 AS rank, relation FROM item_relation r JOIN own x ON x.item_id = r.from_item JOIN own y ON y.item_id = r.to_item WHERE x.place <> y.place),
held AS (SELECT DISTINCT target_id, place FROM connection JOIN top USING (signal_id) WHERE relation = 'matches'),
allp AS (SELECT * FROM told UNION ALL SELECT a.place, b.place, 1, 'shared_context' FROM held a JOIN held b ON a.target_id = b.target_id AND a.place < b.place),
pick AS (SELECT i, j, arg_min(relation, (rank, relation)) AS relation FROM allp GROUP BY 1, 2)
SELECT a.signal_id AS a, b.signal_id AS b, relation FROM pick JOIN top a ON a.place = i JOIN top b ON b.place = j""")
def bundle_pairs(m):
    """How the signals of a bundle relate: by their items in either direction, else by a shared context."""
    return gold.bundle_pairs(bundle(m).select("signal_id", "place"), m.evidence, m.item_relation, m.connection)


@query(f"""WITH o AS (SELECT signal_id, item_id, min(observed_at) AS first FROM evidence GROUP BY 1, 2), a AS (SELECT signal_id, string_agg(item_id::VARCHAR, ',' ORDER BY first, item_id) AS items FROM o GROUP BY 1),
b AS (SELECT signal_id, string_agg(claim, ',' ORDER BY p) AS claims FROM (SELECT DISTINCT signal_id, claim, {PRIORITY} AS p FROM evidence) GROUP BY 1),
c AS (SELECT signal_id, string_agg(target_id::VARCHAR, ',' ORDER BY target_id) AS contexts FROM (SELECT DISTINCT signal_id, target_id FROM connection WHERE relation = 'matches') GROUP BY 1),
d AS (SELECT signal_id, string_agg(insight_id::VARCHAR, ',' ORDER BY insight_id) AS insights FROM (SELECT DISTINCT signal_id, insight_id FROM insight_signal) GROUP BY 1)
SELECT signal_id, items, claims, contexts, insights FROM a LEFT JOIN b USING (signal_id) LEFT JOIN c USING (signal_id) LEFT JOIN d USING (signal_id)""")
def signal_details(m):
    """A signal with its items in first-seen order, its claims, contexts and insights."""
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return gold.signal_detail(m.evidence, m.connection, m.insight_signal).select("signal_id", *map(joined, ("items", "claims", "contexts", "insights")))


@query("""WITH k AS (SELECT signal_id, evidence_id, row_number() OVER (PARTITION BY signal_id ORDER BY evidence_id) AS n FROM (SELECT DISTINCT signal_id, evidence_id FROM evidence)), i AS (SELECT signal_id, item_id, row_number() OVER (PARTITION BY signal_id ORDER BY item_id) AS n FROM (SELECT DISTINCT signal_id, item_id FROM evidence))
SELECT signal_id, (SELECT string_agg(evidence_id::VARCHAR, ',' ORDER BY n) FROM k WHERE k.signal_id = s.signal_id AND n <= 3) AS excerpts, (SELECT string_agg(item_id::VARCHAR, ',' ORDER BY n) FROM i WHERE i.signal_id = s.signal_id AND n <= 2) AS details FROM (SELECT DISTINCT signal_id FROM evidence) s""")
def truncated_lists(m):
    """Lists that are cut: three excerpts, two details."""
    def first(column: str, most: int, name: str):
        place = F.row_number().over(Window.partitionBy("signal_id").orderBy(column))  # cut before rows move, so none is gathered that is not shown
        kept = m.evidence.select("signal_id", column).distinct().withColumn("place", place).filter(F.col("place") <= most)
        return kept.groupBy("signal_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(column)), lambda x: x.cast("string")), ",").alias(name))

    return first("evidence_id", 3, "excerpts").join(first("item_id", 2, "details"), "signal_id")


@query("SELECT source_id AS id, title, publisher, status FROM source")
def source_refs(m):
    """Sources as they are referred to."""
    return m.source.select(F.col("source_id").alias("id"), "title", "publisher", "status")


@query("SELECT item_id AS id, title, canonical_url, source_id, source_kind FROM item")
def item_refs(m):
    """Items as they are referred to, without their texts."""
    return m.item.select(F.col("item_id").alias("id"), "title", "canonical_url", "source_id", "source_kind")


@query(f"{TOTAL} SELECT signal_id AS id, topic, change_kind, status, total, position, sources::BIGINT AS sources FROM placed")
def signal_views(m):
    """Signals as they are listed."""
    return ranking.ranked(summaries(m), now_of(m)).select(F.col("signal_id").alias("id"), "topic", "change_kind", "status", "total", "position", "sources")


@query(f"""WITH {TARGETS}, due AS (SELECT s.source_id FROM source s JOIN target t ON t.target_id = s.target_id AND t.status = 'watching' WHERE s.relevant AND s.status <> 'paused'
  AND (s.next_observation_at IS NULL OR s.next_observation_at <= {NOW}) ORDER BY s.next_observation_at NULLS FIRST, s.source_id LIMIT 50)
SELECT count(DISTINCT d.source_id) AS due, count(DISTINCT o.source_id) AS observed, coalesce(sum(new_items), 0)::BIGINT AS new_items, count(*) FILTER (WHERE o.status = 'failed') AS failures FROM due d LEFT JOIN observation o ON o.source_id = d.source_id""")
def pass_record(m):
    """The record of one pass of the schedule."""
    from ..operators import observe

    return records.pass_record(observe.due_sources(m.source, targets(m), NOW), m.observation)
