"""The queries opN_<name> of this subpackage and, where SQL can say it, the SQL of their rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import table
from .chat_format import rotate_perspectives
from .decontamination import find_leaks
from .exact_dedup import exact_dedup
from .licence_scan import DIGESTS, KNOWN, SPELLINGS, scan_licences
from .packing import pack
from .prefix_trie import prefix_trie
from .quality_rules import DOCUMENTS, LEAST_WORDS, MOST_LOST, MOST_REPEATED, SHARE, quality_rules
from .recompression import remove_passages
from .resampling import resample
from .simhash import near_duplicates
from .suffix_array import remove_substrings
from .target_resampling import resample_to
from .url_filter import WORDS, filter_urls

QUERIES: dict = {}
ORACLES: dict = {}


def op8_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


QUERIES["op8_exact_dedup"] = op8_exact_dedup
ORACLES["op8_exact_dedup"] = r"""
WITH bare AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS t FROM documents),
kept AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM bare)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM kept
"""


def op10_url_filter(spark, sf_dir):
    return filter_urls(table(spark, sf_dir, "pages"))


QUERIES["op10_url_filter"] = op10_url_filter
def _url_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    words = ", ".join(f"({quoted(r.name)}, {quoted(r.pattern.replace('(?>', '(?:'))})" for r in WORDS)
    return rf"""
WITH rules(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
words(word, pattern) AS (VALUES {words}),
rest AS (SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS r FROM pages),
cut AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fit AS (
  SELECT c.page_id, c.host, c.path,
    (SELECT max_by({{'rule': r.host || r.path, 'verdict': r.verdict}}, length(r.host || r.path)) FROM rules r
     WHERE (c.host = r.host OR ends_with(c.host, '.' || r.host)) AND starts_with(c.path, r.path)) AS place,
    (SELECT min(w.word) FROM words w WHERE regexp_matches(c.host || c.path, w.pattern)) AS word
  FROM cut c)
SELECT page_id, host, path, place.rule AS rule, coalesce(place.verdict, CASE WHEN word IS NULL THEN 'allow' ELSE 'block' END) AS verdict, word FROM fit
"""


ORACLES["op10_url_filter"] = _url_sql()


def op3_chat_format(spark, sf_dir):
    return rotate_perspectives(table(spark, sf_dir, "conversations"))


QUERIES["op3_chat_format"] = op3_chat_format
ORACLES["op3_chat_format"] = r"""
WITH said AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
people AS (SELECT DISTINCT conv_id, role AS perspective FROM said WHERE role <> 'system'),
seen AS (
  SELECT s.*, perspective, role = perspective AS own,
    CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN role ELSE 'user name=' || role END AS head
  FROM said s JOIN people p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
cut AS (SELECT *, '<|im_start|>' || head || chr(10) || text || '<|im_end|>' || chr(10) AS segment FROM seen),
placed AS (
  SELECT *, coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM cut)
SELECT conv_id, perspective, turn, segment, start, length(segment)::BIGINT AS length,
  CASE WHEN own THEN start + length(head) + 13 END::BIGINT AS mask_start, CASE WHEN own THEN start + length(segment) - 1 END::BIGINT AS mask_end
FROM placed
"""


def op7_licence_scan(spark, sf_dir):
    return scan_licences(table(spark, sf_dir, "documents"))


QUERIES["op7_licence_scan"] = op7_licence_scan


def _canonical_sql(text: str) -> str:
    kept = rf"regexp_replace(lower({text}), '(?m)^[ \t#*/;-]*(copyright\b[^\n]*([0-9]{{4}}|\(c\)|©)|\(c\) |© |all rights reserved)[^\n]*$', '', 'g')"
    for pattern, one in SPELLINGS:
        kept = f"regexp_replace({kept}, '{pattern}', '{one}', 'g')"
    return rf"trim(regexp_replace({kept}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def licence_copies(spark, sf_dir):
    """op7 over texts that are known licences, as files tell them: under a copyright line, in capitals, with other white space."""
    docs, names = table(spark, sf_dir, "documents"), sorted(KNOWN)
    which = F.element_at(F.array(*(F.lit(KNOWN[n]) for n in names)), (F.col("doc_id") % len(names) + 1).cast("int"))
    text = F.concat(F.lit("Copyright (c) 2020 "), "source", F.lit("\n\n"), F.replace(F.upper(which), F.lit(" "), F.when(F.col("doc_id") % 2 == 0, "  ").otherwise("\t")))
    return scan_licences(docs.select("doc_id", text.alias("text")))


QUERIES["licence_copies"] = licence_copies


def _licence_sql(read: str) -> str:
    pairs = lambda d: ", ".join("('{}', '{}')".format(k.replace("'", "''"), v.replace("'", "''")) for k, v in d.items())
    return f"""
WITH texts AS (SELECT * FROM (VALUES {pairs(KNOWN)}) k(licence, words)),
known AS (SELECT digest, min(licence) AS licence FROM (SELECT sha256({_canonical_sql("words")}) AS digest, licence FROM texts UNION ALL SELECT digest, licence FROM (VALUES {pairs(DIGESTS)}) d(licence, digest)) GROUP BY 1),
read AS ({read})
SELECT doc_id, sha256(c) AS digest, licence FROM read LEFT JOIN known ON known.digest = sha256(c) AND c <> ''
"""


ORACLES["op7_licence_scan"] = _licence_sql(f"SELECT doc_id, {_canonical_sql('coalesce(text, chr(0))')} AS c FROM documents".replace("chr(0)", "''"))
ORACLES["licence_copies"] = _licence_sql(
    f"""SELECT doc_id, {_canonical_sql("'Copyright (c) 2020 ' || source || chr(10) || chr(10) || replace(upper(words), ' ', CASE WHEN doc_id % 2 = 0 THEN '  ' ELSE chr(9) END)")} AS c
  FROM documents JOIN (SELECT words, row_number() OVER (ORDER BY licence) - 1 AS n FROM texts) t ON t.n = doc_id % {len(KNOWN)}"""
)


def op1_simhash_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES["op1_simhash_dedup"] = op1_simhash_dedup


def op4_best_fit_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), vocabulary(), added=True)


def vocabulary() -> str:
    """The file of the public vocabulary that packs are made with."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


QUERIES["op4_best_fit_packing"] = op4_best_fit_packing


def op5_suffix_array_dedup(spark, sf_dir):
    return remove_substrings(table(spark, sf_dir, "documents"))


def op6_recompression_dedup(spark, sf_dir):
    return remove_passages(table(spark, sf_dir, "documents"))


QUERIES["op5_suffix_array_dedup"] = op5_suffix_array_dedup
QUERIES["op6_recompression_dedup"] = op6_recompression_dedup


def op9_quality_resampling(spark, sf_dir):
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_decontamination(spark, sf_dir):
    """Whether each document holds benchmark items, with the items named in a text."""
    leaks = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.withColumn("item_ids", F.array_join(F.transform("item_ids", lambda i: i.cast("string")), ","))


QUERIES["op9_quality_resampling"] = op9_quality_resampling
QUERIES["op2_decontamination"] = op2_decontamination


ORACLES["op6_recompression_dedup"] = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l FROM documents),
windows AS (SELECT doc_id, s, array_to_string(l[s:s + 19], ' ') AS k FROM (SELECT doc_id, l, unnest(range(1, len(l) - 18)) AS s FROM w)),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, s + i AS p FROM later, (SELECT unnest(range(0, 20)) AS i)),
words AS (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT w.doc_id, len(l)::BIGINT AS n_words, (len(l) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

ORACLES["op5_suffix_array_dedup"] = r"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
windows AS (SELECT doc_id, s, substr(x, 2 * s + 1, 100) AS k FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 49)) AS s FROM h)),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY k) AS first FROM windows) WHERE doc_id > first),
gone AS (SELECT DISTINCT doc_id, s + i AS p FROM later, (SELECT unnest(range(0, 50)) AS i)),
spans AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE new) AS spans FROM (SELECT doc_id, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p), 2) > 1 AS new FROM gone) GROUP BY 1),
bytes AS (SELECT doc_id, unnest(range(0, length(x) // 2)) AS p, x FROM h),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * p + 1, 2), '' ORDER BY p) AS t FROM bytes ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT h.doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(t, ''))) AS kept_sha256
FROM h LEFT JOIN spans USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op11_target_resampling(spark, sf_dir):
    return resample_to(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES["op11_target_resampling"] = op11_target_resampling

#: CRC-32 by half bytes; its table follows from the polynomial.
_NIBBLES = []
for _n in range(16):
    for _ in range(4):
        _n = (_n >> 1) ^ (0xEDB88320 if _n & 1 else 0)
    _NIBBLES.append(_n)


def _crc_sql(text: str) -> str:
    """The CRC-32 of a text's UTF-8 bytes, lower half byte first."""
    halves = f"flatten(list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: [('0x' || h[2])::BIGINT, ('0x' || h[1])::BIGINT]))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {halves}), lambda a, n: xor(a >> 4, ({_NIBBLES}::BIGINT[])[(xor(a, n) & 15) + 1])), 4294967295)"


ORACLES["op11_target_resampling"] = rf"""
WITH texts AS (SELECT 'd' AS side, row_number() OVER () AS row, doc_id, text FROM documents UNION ALL SELECT 't', row_number() OVER (), NULL, text FROM benchmark),
words AS (SELECT side, row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
runs AS (
  SELECT side, row, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS feature FROM words),
named AS (SELECT feature, {_crc_sql("feature")} % 10000 AS bucket FROM (SELECT DISTINCT feature FROM runs)),
found AS (SELECT side, row, bucket, count(*) AS n FROM runs JOIN named USING (feature) GROUP BY ALL),
sums AS (SELECT (SELECT coalesce(sum(n), 0) FROM found WHERE side = 'd')::DOUBLE AS all_s, (SELECT coalesce(sum(n), 0) FROM found WHERE side = 't')::DOUBLE AS all_t),
counts AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE side = 't'), 0)::DOUBLE AS t FROM found GROUP BY 1),
gain AS (SELECT bucket, floor(1000 * ln((c.t + 1) * (z.all_s + 10000) / ((c.s + 1) * (z.all_t + 10000))))::BIGINT AS gain FROM counts c, sums z),
weighed AS (SELECT row, sum(n) AS n_features, sum(n * gain) AS weight FROM found JOIN gain USING (bucket) WHERE side = 'd' GROUP BY 1),
scored AS (
  SELECT doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM words LEFT JOIN weighed USING (row) WHERE side = 'd'),
placed AS (SELECT *, words >= 20 AS able, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS place FROM scored)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score,
  CASE WHEN able AND place <= 5 * (SELECT count(*) FROM placed WHERE able) // 100 THEN place END::BIGINT AS rank
FROM placed
"""


def op12_prefix_trie(spark, sf_dir):
    return prefix_trie(table(spark, sf_dir, "conversations"), branched=True)


QUERIES["op12_prefix_trie"] = op12_prefix_trie
ORACLES["op12_prefix_trie"] = rf"""
WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p, {{'role': role, 'text': text}} AS s FROM said),
convs AS (SELECT c, {_crc_sql("c::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT conv_id AS c FROM said)),
rebuilt AS (SELECT c, 0 AS own, p, s FROM convs JOIN placed ON conv_id = c - c % 5 AND p <= h UNION ALL SELECT c, 1, p, s FROM convs JOIN placed ON conv_id = c AND p > h),
turns AS (SELECT c, s, row_number() OVER (PARTITION BY c ORDER BY own, p) AS d FROM rebuilt),
members AS (
  SELECT c, d, s.text AS text, list(s) OVER (PARTITION BY c ORDER BY d) AS path, d = count(*) OVER (PARTITION BY c) AS last FROM turns
  UNION ALL SELECT c, 0, '', list_filter([{{'role': '', 'text': ''}}], lambda x: false), c NOT IN (SELECT c FROM turns) FROM convs),
nodes AS (
  SELECT path, d AS depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * strlen(any_value(text)) AS saved, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '') AS ends
  FROM members GROUP BY path, d),
children AS (SELECT path[1:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
full_ AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN children k ON n.path = k.path),
subtrees AS (SELECT path[1:a] AS path, sum((n_children = 0)::BIGINT) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT path, saved, n_children, unnest(range(0, depth + 1)) AS a FROM full_) GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, t.n_leaves::BIGINT AS n_leaves, t.saved_tokens::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM full_ n JOIN subtrees t ON n.path = t.path LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[1:n.depth - 1]
"""


def op13_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"))


QUERIES["op13_quality_rules"] = op13_quality_rules
ORACLES["op13_quality_rules"] = rf"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text FROM documents),
words AS (SELECT row, doc_id, source, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM docs),
runs AS (SELECT row, p, w[p:p + 2] AS k FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS p FROM words)),
again AS (SELECT row, p FROM (SELECT row, p, count(*) OVER (PARTITION BY row, k) AS n FROM runs) WHERE n > 1),
covered AS (SELECT row, count(*) AS n FROM (SELECT DISTINCT row, p + i AS q FROM again, (SELECT unnest([0, 1, 2]) AS i)) GROUP BY 1),
lines AS (
  SELECT *, trim(lower(regexp_replace(regexp_replace(line, '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')), ' ') AS same,
    len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n
  FROM (SELECT row, source, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
twice AS (SELECT row, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY 1),
hosts AS (SELECT source, count(*) AS n FROM docs GROUP BY 1),
common AS (
  SELECT c.source, same FROM (SELECT source, same, count(DISTINCT row) AS n FROM lines GROUP BY ALL) c JOIN hosts h ON c.source IS NOT DISTINCT FROM h.source
  WHERE c.n > {DOCUMENTS} AND c.n > {SHARE} * h.n),
gone AS (SELECT row, count(*) AS lines, sum(n) AS words FROM lines l JOIN common c ON l.source IS NOT DISTINCT FROM c.source AND l.same = c.same GROUP BY 1),
base AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(twice.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.lines, 0)::BIGINT AS removed_lines, coalesce(gone.words, 0)::BIGINT AS removed_words
  FROM words LEFT JOIN twice USING (row) LEFT JOIN covered USING (row) LEFT JOIN gone USING (row))
SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
  NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AND n_words - removed_words >= {LEAST_WORDS} AND removed_words <= {MOST_LOST} * n_words AS kept
FROM base
"""
