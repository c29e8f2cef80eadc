"""Text as columns: everything here stays in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicon as L

#: The signs of words, inside a class; ASCII stands first, as it is found soonest.
WORD_CHARS = r"a-zA-Z0-9\p{IsAlphabetic}\p{N}"
#: A word: a run of word signs and those of versions and names, without the dots, dashes and quotes at its edges.
TOKEN = rf"[{WORD_CHARS}+#](?:[{WORD_CHARS}.+#'\-]*[{WORD_CHARS}+#])?"


def lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def case(of: Column, table: dict, otherwise=None) -> Column:
    """The value of `of` in table."""
    out = F.lit(otherwise)
    for k, v in reversed(list(table.items())):
        out = F.when(of == F.lit(k), F.lit(v)).otherwise(out)
    return out


def first_containing(of: Column, table: dict, otherwise=None) -> Column:
    """The first key of table of whose phrases one stands in the text."""
    out = F.lit(otherwise)
    for k, phrases in reversed(list(table.items())):
        out = F.when(reduce(lambda a, b: a | b, [F.contains(of, F.lit(p)) for p in phrases]), F.lit(k)).otherwise(out)
    return out


def normalize_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def blank_as_null(text: Column) -> Column:
    return F.when(F.trim(text) != "", text)


def slug(label: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(label), f"[^{WORD_CHARS}]+", "-"), "^-|-$", "")


def tokens(text: Column) -> Column:
    """Lower-case words; signs inside versions and names stay."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower)


#: What goes from a lower-case word: ing and ed, es after ch, sh and x, else s; four characters stay, of plurals three, and no s stands last.
SUFFIXES = r"(?s)\A(?:(.{3,}[^s])(?:ing|ed)|(.{2,}(?:ch|sh)|.{3,}x)es|(.{2,}[^s])s)\z"


def stemmed(token: Column) -> Column:
    """A small stemmer of lower-case words: the first suffix that leaves enough goes, unless an s would stand before it."""
    ends = lambda *suffixes: reduce(lambda a, b: a | b, [F.endswith(token, F.lit(s)) for s in suffixes])
    plural_y = ends("ies") & (F.length(token) >= 6) & ~ends("sies")
    return F.when(plural_y, F.concat(F.substring(token, F.lit(1), F.length(token) - 3), F.lit("y"))).when(ends("s", "ing", "ed"), F.regexp_replace(token, SUFFIXES, "$1$2$3")).otherwise(token)


def stem(token: Column) -> Column:
    return stemmed(F.lower(token))


def is_term(token: Column) -> Column:
    """Whether a token says something: no stop word, no number, three characters or a known short term."""
    return ((F.length(token) >= 3) | token.isin(*L.SHORT_TERMS)) & ~token.isin(L.STOP_WORDS) & ~token.rlike(r"^[0-9.]+$")


def sentences(text: Column) -> Column:
    """Verbatim sentences: they end at a line break, or at . ! ? before white space that no lower-case letter follows."""
    parts = F.split(text, r"\n|(?<=[.!?])(?=[ \t\r\f](?![a-z])|\z)")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: F.length(F.regexp_replace(s, f"[^{WORD_CHARS}]", "")) >= 3)


def stems(text: Column) -> Column:
    return F.transform(tokens(text), stemmed)


def contains_phrase(stemmed: Column, phrase: Column) -> Column:
    """Whether the stems hold those of phrase in a row."""
    needle = F.array_join(stems(phrase), " ")
    return (needle != "") & F.contains(F.concat(F.lit(" "), F.array_join(stemmed, " "), F.lit(" ")), F.concat(F.lit(" "), needle, F.lit(" ")))


def content_terms(question: Column) -> Column:
    parts = F.transform(F.split(question, rf"[^{WORD_CHARS}\-.]+"), lambda w: F.lower(F.regexp_replace(w, r"^[.\-]+|[.\-]+$", "")))
    kept = F.filter(parts, lambda w: (F.octet_length(w) >= 2) & ~w.isin(L.QUESTION_WORDS))
    return F.array_sort(F.array_distinct(F.transform(kept, stemmed)))


def intent(question: Column) -> Column:
    return first_containing(F.lower(question), L.INTENTS, "general")


def window_days(question: Column) -> Column:
    return first_containing(F.lower(question), dict(L.WINDOWS))


def is_anaphoric(question: Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(question), f"[^{WORD_CHARS}]+"), lit_array(L.ANAPHORA))


def contains_ci(text: Column, pattern: Column) -> Column:
    """Containment that ignores the case of A-Z."""
    low = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.contains(low(text), low(pattern))


def grounded(text: Column, excerpt: Column) -> Column:
    needle = F.lower(normalize_whitespace(excerpt))
    return F.contains(F.lower(normalize_whitespace(text)), needle) & (F.octet_length(needle) >= 2)


def normalize_block(block: Column) -> Column:
    """A line with what changes by itself masked as #: long hex names, clock times, time stamps, and how long ago something was."""
    bare = r"[^\p{IsAlphabetic}\p{N}\s]*"
    words = normalize_whitespace(block)
    ago = rf"(?<!\S){bare}[0-9]+{bare} {bare}(?i:seconds?|minutes?|hours?|secs?|mins?){bare} (?i:ago)\S*"
    words = F.regexp_replace(words, ago, "#")
    words = F.regexp_replace(words, rf"(?<!\S){bare}(?i:just){bare} (?i:now)\S*", "#")
    mask = lambda w, b: (
        ((F.length(b) >= 16) & b.rlike(r"^[0-9a-fA-F\-]+$"))
        | (F.contains(b, F.lit(":")) & b.rlike(r"^[0-9:]+$") & (F.length(F.regexp_replace(b, "[^0-9]", "")) >= 3))
        | ((F.length(F.regexp_replace(b, "[^0-9]", "")) >= 6) & F.contains(b, F.lit("T")) & F.contains(b, F.lit("-")))
    )
    strip = lambda w: F.regexp_replace(w, rf"^[^{WORD_CHARS}]+|[^{WORD_CHARS}]+$", "")
    return F.array_join(F.transform(F.split(words, " "), lambda w: F.when(mask(w, strip(w)), F.lit("#")).otherwise(w)), " ")


def normalized_blocks(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\r?\n"), normalize_block), lambda b: F.trim(b) != "")


def without_repeats(values: Column) -> Column:
    """The values without those equal to the one before."""
    before = F.concat(F.array(F.lit(None).cast("string")), values)  # one longer; the pair of its end falls away with the nulls
    return F.filter(F.zip_with(values, before, lambda v, b: F.when(v.eqNullSafe(b), None).otherwise(v)), lambda v: v.isNotNull())


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, most)), F.lit("…")))


def quoted(values: Column, most: int) -> Column:
    return F.array_join(F.transform(F.slice(values, 1, most), lambda v: F.concat(F.lit("“"), v, F.lit("”"))), ", ")


def lower_first(text: Column) -> Column:
    return F.concat(F.lower(F.left(text, F.lit(1))), F.substring(text, F.lit(2), F.length(text)))


def plural(count: Column, noun: str) -> Column:
    return F.concat(count.cast("string"), F.lit(f" {noun}"), F.when(count == 1, F.lit("")).otherwise(F.lit("s")))


def code_fence_stripped(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(text), r"(?s)\A```(?:json)?\s*(.*?)\s*```\z", "$1"))


#: What is cut off the edges of phrases.
EDGES = ",;:.-—–!?\"' \t\n"


def phrase(text: Column, words: int) -> Column:
    """The first words of a text, without punctuation at the edges."""
    kept = F.slice(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""), 1, words)
    return F.btrim(F.array_join(kept, " "), F.lit(EDGES))


def clean_title(title: Column) -> Column:
    """A title without the name of its site: what follows the last of the first separator that leaves two words and cuts off five at most, itself counted."""
    bare = normalize_whitespace(title)
    count = lambda c: F.size(F.filter(F.split(c, " "), lambda w: w != ""))
    out = bare
    for mark in reversed(L.TITLE_SEPARATORS):
        at = F.length(bare) - F.length(F.substring_index(bare, mark, -1)) - len(mark)
        head, tail = F.substring(bare, F.lit(1), at), F.substring(bare, at + 1, F.length(bare))
        out = F.when(F.contains(bare, F.lit(mark)) & (count(head) >= 2) & (count(tail) <= 5), F.trim(head)).otherwise(out)
    return out
