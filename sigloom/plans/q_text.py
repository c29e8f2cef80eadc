"""Texts: tokens, terms, sentences, blocks, questions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import text as T
from ..operators import terms
from .catalogue import query

TOKENS = r"list_filter(list_transform(regexp_split_to_array({0}, '[^\p{{L}}\p{{N}}.+#''-]+'), lambda t: lower(regexp_replace(t, '^[.''-]+|[.''-]+$', '', 'g'))), lambda t: t <> '')"


def _stem(t: str) -> str:
    fits = lambda s, n: f"(ends_with({t}, '{s}') AND length({t}) - {len(s)} >= {n} AND NOT ends_with(substr({t}, 1, length({t}) - {len(s)}), 's'))"
    cut = lambda n: f"substr({t}, 1, length({t}) - {n})"
    return (
        f"CASE WHEN length({t}) <= 3 THEN {t} WHEN {fits('ies', 3)} THEN {cut(3)} || 'y' WHEN {fits('ing', 4)} THEN {cut(3)} WHEN {fits('ed', 4)} THEN {cut(2)} "
        f"WHEN {fits('es', 4)} THEN CASE WHEN regexp_matches({cut(2)}, '(ch|sh|x)$') THEN {cut(2)} ELSE {cut(2)} || 'e' END WHEN {fits('s', 3)} THEN {cut(1)} ELSE {t} END"
    )


def _is_term(t: str) -> str:
    from .. import lexicon as L

    stop = ", ".join("'" + w.replace("'", "''") + "'" for w in L.STOP_WORDS)
    short = ", ".join(f"'{w}'" for w in L.SHORT_TERMS)
    return f"({t} NOT IN ({stop}) AND NOT regexp_matches({t}, '^[0-9.]+$') AND (length({t}) >= 3 OR {t} IN ({short})))"


@query(f"SELECT t AS token, count(*) AS n FROM (SELECT unnest({TOKENS.format('text')}) AS t FROM documents) GROUP BY 1")
def tokens_freq(m):
    """How often each token stands in all texts."""
    return m.documents.select(F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query(f"SELECT {_stem('t')} AS stem, count(*) AS n FROM (SELECT unnest({TOKENS.format('text')}) AS t FROM documents) WHERE {_is_term('t')} GROUP BY 1")
def stem_terms(m):
    """Stems of the tokens that are terms."""
    at = tokens_freq(m).filter(T.is_term(F.col("token")))  # each distinct token is judged and stemmed once
    return at.groupBy(T.stemmed(F.col("token")).alias("stem")).agg(F.sum("n").alias("n"))


HEAD = "CASE WHEN strlen(content_text) <= 4000 OR substr(hex(encode(content_text)), 8001, 1) IN ('8', '9', 'A', 'B') THEN content_text ELSE decode(unhex(substr(hex(encode(content_text)), 1, 8000))) END".replace("strlen(content_text) <= 4000 OR", "strlen(content_text) <= 4000 OR")
TERMS = f"""toks AS (SELECT item_id, list_concat(list_transform({TOKENS.format('title')}, lambda t: {{'t': t, 'w': 3.0::DOUBLE}}), list_transform({TOKENS.format(f'({HEAD})')}, lambda t: {{'t': t, 'w': 1.0::DOUBLE}})) AS l FROM item),
flat AS (SELECT item_id, unnest(l) AS x, generate_subscripts(l, 1) AS pos FROM toks),
weighed AS (SELECT item_id, {_stem('x.t')} AS term, sum(x.w) AS weight, min(pos) AS first FROM flat WHERE {_is_term('x.t')} GROUP BY 1, 2),
terms AS (SELECT item_id, term, weight, row_number() OVER (PARTITION BY item_id ORDER BY weight DESC, first) AS place FROM weighed)"""


@query(f"WITH {TERMS} SELECT item_id, term, weight, place::BIGINT AS place FROM terms WHERE place <= 18")
def key_terms_top(m):
    """The key terms of each item."""
    return terms.key_terms(m.item, 18).drop("many")


@query(f"""WITH {TERMS}, k AS (SELECT item_id, term FROM terms WHERE place <= 18), old AS (SELECT * FROM k WHERE item_id IN (SELECT item_id FROM item ORDER BY published_at DESC, item_id LIMIT 200)),
p AS (SELECT a.item_id, b.item_id AS prior_id, count(*) AS shared FROM k a JOIN old b ON a.term = b.term AND a.item_id <> b.item_id GROUP BY 1, 2),
n AS (SELECT item_id, count(*) AS n FROM k GROUP BY 1),
o AS (SELECT p.*, round(shared::DOUBLE / greatest(1, least(a.n, b.n)), 6) AS overlap FROM p JOIN n a ON a.item_id = p.item_id JOIN n b ON b.item_id = p.prior_id),
l AS (SELECT *, CASE WHEN overlap >= 0.45 AND shared >= 5 THEN 'same_change' WHEN overlap >= 0.25 AND shared >= 3 THEN 'related' END AS kind FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, prior_id) AS k FROM l WHERE kind IS NOT NULL)
SELECT item_id, prior_id, shared, overlap, kind FROM r WHERE k <= 8""")
def similar_items(m):
    """Links to the 200 newest items by shared key terms."""
    return terms.similar(m.item, m.item)


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(lower(split_part(text, chr(10), 1)), '[^\p{L}\p{N}]+', '-', 'g'), '^-|-$', '', 'g')) AS slug FROM documents")
def slug_subjects(m):
    """Slugs of first lines."""
    return m.documents.select("doc_id", T.slug(F.split_part(F.col("text"), F.lit("\n"), F.lit(1))).alias("slug"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS digest FROM documents")
def normalized_texts(m):
    """Texts with single spaces."""
    return m.documents.select("doc_id", F.md5(T.normalize_whitespace(F.col("text"))).alias("digest"))


@query("SELECT doc_id, 'source_' || substr(sha256(text), 1, 32) AS id FROM documents")
def deterministic_ids(m):
    """Ids that follow from content."""
    return m.documents.select("doc_id", ids.named("source", F.col("text")).alias("id"))


@query(r"""WITH n AS (SELECT item_id, '{"author":"' || author || '","canonical_identity":"' || canonical_identity || '","canonical_url":"' || canonical_url || '","content_text":' || to_json(trim(regexp_replace(content_text, '\s+', ' ', 'g')))::VARCHAR || ',"published_at":"' || published_at || '","title":' || to_json(trim(regexp_replace(title, '\s+', ' ', 'g')))::VARCHAR || '}' AS j FROM item)
SELECT item_id, sha256(j) AS fingerprint FROM n""")
def fingerprints(m):
    """Fingerprints over the canonical JSON."""
    c = F.col
    return m.item.select("item_id", ids.fingerprint(c("title"), c("content_text"), c("canonical_url"), c("canonical_identity"), c("author"), c("published_at").cast("string")).alias("fingerprint"))


BARE = r"[^\p{L}\p{N}\s]*"
AGO = rf"(^| ){BARE}[0-9]+{BARE} {BARE}(?i:seconds?|minutes?|hours?|secs?|mins?){BARE} (?i:ago)[^\s]*"
JUST = rf"(^| ){BARE}(?i:just){BARE} (?i:now)[^\s]*"
EDGE = r"regexp_replace(w, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')"
DIGITS = rf"length(regexp_replace({EDGE}, '[^0-9]', '', 'g'))"
MASK = rf"(length({EDGE}) >= 16 AND regexp_matches({EDGE}, '^[0-9a-fA-F-]+$')) OR (contains({EDGE}, ':') AND regexp_matches({EDGE}, '^[0-9:]+$') AND {DIGITS} >= 3) OR ({DIGITS} >= 6 AND contains({EDGE}, 'T') AND contains({EDGE}, '-'))"
LINE = rf"regexp_replace(regexp_replace(trim(regexp_replace(b, '\s+', ' ', 'g')), '{AGO}', '\1#', 'g'), '{JUST}', '\1#', 'g')"
BLOCKS = rf"list_filter(list_transform(regexp_split_to_array(text, '\r?\n'), lambda b: array_to_string(list_transform(str_split({LINE}, ' '), lambda w: CASE WHEN {MASK} THEN '#' ELSE w END), ' ')), lambda b: trim(b) <> '')"


@query(f"SELECT doc_id, sha256(array_to_string({BLOCKS}, chr(10))) AS content_hash FROM documents")
def content_hash(m):
    """The hash of the blocks of every text."""
    return m.documents.select("doc_id", ids.block_hash(T.normalized_blocks(F.col("text"))).alias("content_hash"))


@query(f"SELECT doc_id, array_to_string({BLOCKS}, chr(10)) AS blocks FROM (SELECT doc_id, text || chr(10) || '  seen 5 minutes  ago, (3 Hours) ago! at 2024-01-0' || doc_id % 9 || 'T10:00:00Z or 12:30:0' || doc_id % 9 || ' just now. id ' || md5(text) || ' no:1' AS text FROM documents)")
def block_normalise(m):
    """Blocks with what changes by itself masked; each text has one line more that holds all that is masked."""
    n = (F.col("doc_id") % 9).cast("string")
    line = F.concat(F.lit("\n  seen 5 minutes  ago, (3 Hours) ago! at 2024-01-0"), n, F.lit("T10:00:00Z or 12:30:0"), n, F.lit(" just now. id "), F.md5("text"), F.lit(" no:1"))
    return m.documents.select("doc_id", F.array_join(T.normalized_blocks(F.concat("text", line)), "\n").alias("blocks"))


@query("SELECT doc_id, array_to_string(list_filter(l, lambda x, i: i = 1 OR x <> l[i - 1]), '|') AS kept FROM (SELECT doc_id, str_split(text, ' ') AS l FROM documents)")
def repeats_removed(m):
    """values equal to the one before go."""
    return m.documents.select("doc_id", F.array_join(T.without_repeats(F.split("text", " ")), "|").alias("kept"))


_ENDS = "regexp_replace({0}, '([.!?])([ \\t\\r\\f])([^a-z]|$)', '\\1' || chr(10) || '\\2\\3', 'g')"
#: Twice, as an end may be the beginning of the next.
SENTENCES = rf"list_filter(list_transform(str_split({_ENDS.format(_ENDS.format('{0}'))}, chr(10)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: length(regexp_replace(s, '[^\p{{{{L}}}}\p{{{{N}}}}]', '', 'g')) >= 3)"


@query(f"SELECT doc_id, unnest(l) AS sentence, generate_subscripts(l, 1)::INTEGER - 1 AS place FROM (SELECT doc_id, {SENTENCES.format('text')} AS l FROM documents)")
def sentences(m):
    """Verbatim sentences."""
    return m.documents.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("place", "sentence"))


@query(f"""WITH {TERMS.replace('content_text', 'content_text')}, st AS (SELECT item_id, ' ' || array_to_string(list_transform({TOKENS.format('content_text')}, lambda t: {_stem('t')}), ' ') || ' ' AS s FROM item),
b AS (SELECT item_id AS context_id, array_to_string(list_transform({TOKENS.format("array_to_string(list_slice(str_split(text, ' '), 1, 2), ' ')")}, lambda t: {_stem('t')}), ' ') AS p FROM benchmark)
SELECT st.item_id, b.context_id FROM st JOIN b ON contains(st.s, ' ' || b.p || ' ') WHERE b.p <> ''""")
def phrase_mentions(m):
    """Items that hold the first two words of a context as a stemmed phrase."""
    phrases = m.benchmark.select(F.col("item_id").alias("context_id"), F.concat(F.lit(" "), F.array_join(T.stems(F.array_join(F.slice(F.split("text", " "), 1, 2), " ")), " "), F.lit(" ")).alias("p")).filter("trim(p) <> ''")
    stems = m.item.select("item_id", F.concat(F.lit(" "), F.array_join(T.stems(F.col("content_text")), " "), F.lit(" ")).alias("s"))
    few = phrases.limit(10_001).count() <= 10_000
    return stems.join(F.broadcast(phrases) if few else phrases, F.contains("s", "p")).select("item_id", "context_id")


@query(r"""WITH n AS (SELECT count(*) AS many FROM benchmark), b AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS place, text AS cited FROM benchmark),
cited AS (SELECT d.doc_id, d.text, CASE d.doc_id % 3 WHEN 0 THEN translate(replace(substr(d.text, 11, 60), ' ', '  '), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') WHEN 1 THEN substr(d.text, 11, 60) || ' and more' ELSE b.cited END AS excerpt FROM documents d CROSS JOIN n LEFT JOIN b ON b.place = d.doc_id % n.many)
SELECT doc_id, contains(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), lower(trim(regexp_replace(excerpt, '\s+', ' ', 'g')))) AND strlen(trim(regexp_replace(excerpt, '\s+', ' ', 'g'))) >= 2 AS grounded FROM cited""")
def grounded_excerpts(m):
    """Whether the excerpt that each text is cited with stands in it: a part of it written otherwise, a part with more
    after it, or a benchmark item, in turn."""
    d, turn = F.col("doc_id"), F.col("doc_id") % 3
    items = m.benchmark.select("item_id", F.col("text").alias("cited"))
    place = F.row_number().over(Window.orderBy("item_id")) - 1  # the benchmark's ids, which are few against the documents
    b = items.select("item_id", place.cast("long").alias("place")).join(items, "item_id")
    own = F.substring("text", 11, 60)
    cited = m.documents.withColumn("place", d % F.lit(m.benchmark.count())).join(b, "place", "left")
    excerpt = F.when(turn == 0, F.translate(F.replace(own, F.lit(" "), F.lit("  ")), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).when(turn == 1, F.concat(own, F.lit(" and more"))).otherwise(F.col("cited"))
    return cited.select("doc_id", T.grounded(F.col("text"), excerpt).alias("grounded"))


def _verbs() -> list[tuple[str, str]]:
    from .. import lexicon as L

    return [(k, v) for k, vs in L.CHANGE_VERBS.items() for v in vs]


def _verb_pattern() -> str:
    """Before a verb of change (1), and the verb (2): the leftmost one, of those at one place the first in the list; a text has a space in front."""
    import re as _re

    verbs = "|".join(_re.escape(v).replace(chr(92) + " ", " ").replace(chr(92) + "-", "-") for _, v in _verbs())
    return rf"(?s)^(.*?)[^\p{{L}}\p{{N}}]({verbs})(?:[^\p{{L}}\p{{N}}]|$)"


VERB_PATTERN = _verb_pattern()


def _verb_sql() -> str:
    rows = ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(_verbs()))
    return rf"""WITH verbs(i, kind, verb) AS (VALUES {rows}), d AS (SELECT doc_id, text || ' it ' || verb || ' this' AS text FROM documents JOIN verbs ON i = doc_id % {len(_verbs())}),
t AS (SELECT doc_id, regexp_extract(' ' || lower(text), '{VERB_PATTERN}', 2) AS verb FROM d WHERE strlen(lower(text)) = strlen(text))
SELECT doc_id, kind, verb FROM (SELECT t.doc_id, t.verb, v.kind, row_number() OVER (PARTITION BY doc_id ORDER BY v.i) AS k FROM t JOIN verbs v ON v.verb = t.verb) WHERE k = 1"""


@query(_verb_sql())
def change_verb(m):
    """The first verb of change in each text, to each of which one of the verbs in turn is added."""
    which = F.element_at(T.lit_array([v for _, v in _verbs()]), (F.col("doc_id") % len(_verbs()) + 1).cast("int"))
    return terms.change_verbs(m.documents.select("doc_id", F.concat("text", F.lit(" it "), which, F.lit(" this")).alias("title")), "doc_id", "title")


def _topic_sql() -> str:
    from .. import lexicon as L
    from ..operators.interpret import padded

    rows = ", ".join(f"({i}, '{k}', '{padded(p)}')" for i, (k, ps) in enumerate(L.TOPICS.items()) for p in ps)
    own = lambda c: f"' ' || array_to_string(list_transform({TOKENS.format(c)}, lambda t: {_stem('t')}), ' ') || ' '"
    other = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.TOPIC_OF_KIND.items())
    return f"""WITH phrases(rank, topic, needle) AS (VALUES {rows}), said AS (SELECT item_id, unnest(list_slice({SENTENCES.format('content_text')}, 1, 80)) AS s FROM item),
stemmed AS (SELECT item_id, {own('s')} AS b, 1.0::DOUBLE AS w FROM said UNION ALL SELECT item_id, {own('title')}, 3.0::DOUBLE FROM item),
scores AS (SELECT item_id, rank, topic, sum(w) AS score FROM stemmed JOIN phrases ON contains(b, needle) GROUP BY 1, 2, 3), best AS (SELECT item_id, arg_max(topic, (score, -rank)) AS topic, max(score) AS score FROM scores GROUP BY 1)
SELECT item.item_id, coalesce(best.topic, CASE source_kind {other} ELSE 'General' END) AS topic, round(CASE WHEN score IS NULL THEN 0.1 ELSE least(1.0, score / 8.0) END, 3)::DOUBLE AS confidence FROM item LEFT JOIN best ON best.item_id = item.item_id"""


@query(_topic_sql())
def topic_of_items(m):
    """The topic of each item."""
    return terms.topics(m.item)


def _first(of: str, table: dict, other: str) -> str:
    q = lambda p: p.replace("'", "''")
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({of}, '{q(p)}')" for p in ps) + f" THEN {k!r}" for k, ps in table.items()) + f" ELSE {other} END"


def _questions() -> tuple[str, str]:
    from .. import lexicon as L

    return _first("lower(question)", L.INTENTS, "'general'"), _first("lower(question)", dict(L.WINDOWS), "NULL").replace("'", "'")


@query(f"SELECT conv_id, turn, {_questions()[0]} AS intent, {_questions()[1]}::INTEGER AS days, len(list_intersect(regexp_split_to_array(lower(question), '[^\\p{{L}}\\p{{N}}]+'), ['that', 'this', 'it', 'these', 'those', 'they', 'them'])) > 0 AS anaphoric FROM question")
def question_shape(m):
    """Intent, window and anaphora of questions."""
    q = F.col("question")
    return m.question.select("conv_id", "turn", T.intent(q).alias("intent"), T.window_days(q).alias("days"), T.is_anaphoric(q).alias("anaphoric"))


@query(f"""SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_transform(list_filter(list_transform(regexp_split_to_array(question, '[^\\p{{L}}\\p{{N}}.-]+'), lambda w: lower(regexp_replace(w, '^[.-]+|[.-]+$', '', 'g'))),
  lambda w: strlen(w) >= 2 AND w NOT IN ({', '.join(repr(w) for w in __import__('sigloom.lexicon', fromlist=['x']).QUESTION_WORDS)})), lambda t: {_stem('t')}))), ' ') AS terms FROM question""")
def question_terms(m):
    """What a question is about."""
    return m.question.select("conv_id", "turn", F.array_join(T.content_terms(F.col("question")), " ").alias("terms"))


@query("SELECT doc_id, CASE WHEN length(text) <= 120 THEN text ELSE rtrim(substr(text, 1, 120)) || '…' END AS shown, lower(substr(text, 1, 1)) || substr(text, 2, 40) AS lowered FROM documents")
def truncations(m):
    """Texts as they are shown."""
    return m.documents.select("doc_id", T.truncated(F.col("text"), 120).alias("shown"), F.substring(T.lower_first(F.col("text")), 1, 41).alias("lowered"))


@query("SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def grouping_sets(m):
    """Beyond parity: several groupings in one pass."""
    d = m.documents
    return d.groupingSets([[F.col("lang")], [F.col("source")], []], F.col("lang"), F.col("source")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT lang, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k <= 10")
def top_k_per_group(m):
    """Beyond parity: the ten longest of each language."""
    k = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id"))
    return m.documents.withColumn("k", k).filter("k <= 10").select("lang", "doc_id", "n_chars")
