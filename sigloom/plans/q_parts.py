"""Parts of readings, each on its own: titles, phrases, written forms, denials, adapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions import text as T
from ..operators import terms
from ..sources import feeds
from .catalogue import query
from .q_text import SENTENCES, TERMS, TOKENS, _stem

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query(f"SELECT doc_id, contains(translate(text, '{UPPER}', '{LOWER}'), 'the ') AS held FROM documents")
def contains_any_case(m):
    """Containment that ignores the case of A-Z."""
    return m.documents.select("doc_id", T.contains_ci(F.col("text"), F.lit("THE ")).alias("held"))


WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"
MARKS = ", ".join(q(x) for x in L.TITLE_SEPARATORS)


def _cleaned(t: str) -> str:
    out = t
    for mark in reversed(L.TITLE_SEPARATORS):
        at = f"length(regexp_extract({t}, {q('(?s)^(.*)' + mark.replace('|', '[|]'))}, 1))"  # the last mark, also where it overlaps the one before
        count = lambda x: f"len(list_filter(str_split({x}, ' '), lambda w: w <> ''))"
        head, tail = f"substr({t}, 1, {at})", f"substr({t}, {at} + 1)"
        out = f"CASE WHEN contains({t}, {q(mark)}) AND {count(head)} >= 2 AND {count(tail)} <= 5 THEN trim({head}) ELSE {out} END"
    return out


@query(f"""WITH t AS (SELECT doc_id, trim(array_to_string(list_slice(l, 1, 3), ' ') || ([{MARKS}])[doc_id % {len(L.TITLE_SEPARATORS)} + 1] || array_to_string(list_slice(l, 4, 3 + doc_id % 7), ' ')) AS title FROM (SELECT doc_id, {WORDS} AS l FROM documents))
SELECT doc_id, {_cleaned('title')} AS title FROM t""")
def clean_titles(m):
    """Titles without the name of their site."""
    words = F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "")
    mark = F.element_at(T.lit_array(L.TITLE_SEPARATORS), (F.col("doc_id") % len(L.TITLE_SEPARATORS) + 1).cast("int"))
    title = F.concat(F.array_join(F.slice(words, 1, 3), " "), mark, F.array_join(F.slice(words, F.lit(4), (F.col("doc_id") % 7).cast("int")), " "))
    return m.documents.select("doc_id", T.clean_title(title).alias("title"))


@query(f"SELECT doc_id, trim(array_to_string(list_slice({WORDS}, 1, 6), ' '), {q(T.EDGES[:-2])} || ' ' || chr(9) || chr(10)) AS phrase FROM documents")
def phrases(m):
    """The first six words without punctuation at the edges."""
    return m.documents.select("doc_id", T.phrase(F.col("text"), 6).alias("phrase"))


FORMS = r"list_transform(regexp_split_to_array({0}, '[^\p{{L}}\p{{N}}''-]+'), lambda w: trim(w, chr(45) || chr(39)))"


@query(f"""WITH l AS (SELECT item_id, list_concat({FORMS.format('title')}, {FORMS.format('content_text')}) AS l FROM item), w AS (SELECT item_id, unnest(l) AS word, generate_subscripts(l, 1) AS pos FROM l),
s AS (SELECT item_id, word, pos, lower(word) AS t FROM w WHERE word <> '') SELECT item_id, {_stem('t')} AS stem, arg_min(word, pos) AS form FROM s GROUP BY 1, 2""")
def surface_forms(m):
    """The form in which each stem is written first."""
    return terms.surface_forms(m.item)


DENIES = "|".join(d.replace("'", "''") for d in L.DENIALS)
SAID = f"said AS (SELECT item_id, unnest(l) AS sentence, generate_subscripts(l, 1) - 1 AS place FROM (SELECT item_id, list_concat([title], list_slice({SENTENCES.format('content_text')}, 1, 80)) AS l FROM (SELECT item_id, {{0}} AS title, content_text FROM item)))"
DENIED = rf"denied AS (SELECT * FROM said WHERE regexp_matches(' ' || lower(sentence) || ' ', '[^\p{{L}}\p{{N}}]({DENIES})[^\p{{L}}\p{{N}}]'))"


def _said(m):
    """Items, a third of whose titles deny."""
    return m.item.withColumn("title", F.when(F.col("item_id") % 3 == 0, F.concat("title", F.lit(" is not true"))).otherwise(F.col("title")))


TITLE = "CASE WHEN item_id % 3 = 0 THEN title || ' is not true' ELSE title END"


@query(f"WITH {SAID.replace("{0}", TITLE)}, {DENIED} SELECT item_id, place::INTEGER AS place FROM denied")
def denials(m):
    """Sentences that deny, the title being the first."""
    return terms.disputes(_said(m))


@query(f"""WITH {TERMS.replace('FROM item)', f'FROM (SELECT item_id, {TITLE} AS title, content_text FROM item))')}, {SAID.replace("{0}", TITLE)}, {DENIED}, own AS (SELECT item_id, term FROM terms WHERE place <= 18),
links AS (SELECT item_id, item_id - 1 AS prior_id FROM item WHERE item_id > 0),
dt AS (SELECT DISTINCT item_id, unnest(list_transform({TOKENS.format('sentence')}, lambda t: {_stem('t')})) AS term FROM denied),
against AS (SELECT DISTINCT l.item_id FROM links l JOIN own a ON a.item_id = l.item_id JOIN own b ON b.item_id = l.prior_id AND b.term = a.term JOIN dt ON dt.item_id = l.item_id AND dt.term = a.term)
SELECT item_id, prior_id, CASE WHEN item_id IN (SELECT item_id FROM against) THEN 'contradicts' ELSE 'supports' END AS stance FROM links""")
def item_stances(m):
    """Whether an item contradicts or supports the one before it: by what they share in sentences that deny."""
    said = _said(m)
    links = said.filter("item_id > 0").select("item_id", (F.col("item_id") - 1).alias("prior_id"))
    return terms.stances(links, said, terms.key_terms(said, 18).select("item_id", "term"))


@query("""SELECT doc_id AS feed_id, CASE doc_id % 5 WHEN 0 THEN 'rss' WHEN 1 THEN 'atom' WHEN 2 THEN 'json_feed' END AS parser, CASE WHEN doc_id % 5 < 3 THEN 'https://example.org/' || source || '/' || doc_id END AS link,
  CASE doc_id % 5 WHEN 3 THEN 'no source adapter registered for telnet' WHEN 4 THEN 'no source adapter registered for none' END AS error FROM documents""")
def adapter_dispatch(m):
    """Documents read by the adapter of their source; a kind without one is an error."""
    k, link = F.col("doc_id") % 5, F.concat(F.lit("https://example.org/"), "source", F.lit("/"), F.col("doc_id").cast("string"))
    kind = F.when(k == 0, "rss").when(k == 1, "atom").when(k == 2, "json_feed").when(k == 3, "telnet")
    body = (
        F.when(k == 0, F.concat(F.lit("<rss><channel><item><title>t</title><link>"), link, F.lit("</link></item></channel></rss>")))
        .when(k == 1, F.concat(F.lit("<feed xmlns='http://www.w3.org/2005/Atom'><entry><id>i</id><title>t</title><link href='"), link, F.lit("'/></entry></feed>")))
        .otherwise(F.concat(F.lit('{"items": [{"id": "1", "url": "'), link, F.lit('"}]}')))
    )
    return feeds.dispatched(m.documents.select(F.col("doc_id").alias("feed_id"), kind.alias("adapter_kind"), body.alias("body"))).select("feed_id", "parser", "link", "error")
