import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sigloom.llm.recompression import remove_passages, word_kind, words_left
from sigloom.llm import repeats
from sigloom.llm.repeats import apply, ranges
from sigloom.llm.suffix_array import byte_kind, bytes_left, remove_substrings, suffix_array, suffix_arrays

LAST = 2**63 - 1


def brute_bytes(rows, length=50):
    first = {}
    data = [(LAST if i is None else i, (t or "").encode()) for i, t in rows]
    for i, t in data:
        for k in range(len(t) - length + 1):
            first[t[k : k + length]] = min(i, first.get(t[k : k + length], LAST))
    out = []
    for (given, _), (i, t) in zip(rows, data):
        gone = np.zeros(len(t) + 2, int)
        for k in range(len(t) - length + 1):
            if first[t[k : k + length]] < i:
                gone[k + 1 : k + length + 1] = 1
        kept = bytes(b for b, g in zip(t, gone[1:]) if not g)
        out.append((given, len(t), int(gone.sum()), int((np.diff(gone) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def brute_words(rows, length=20):
    data = [(LAST if i is None else i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in data:
        for k in range(len(w) - length + 1):
            x = tuple(w[k : k + length])
            first[x] = min((i, k), first.get(x, (LAST, LAST)))
    out = []
    for (given, _), (i, w) in zip(rows, data):
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < (i, k):
                gone[k : k + length] = [True] * length
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((given, len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


random.seed(11)
WORDS = ["of", "the", "in", "ést", "thing"] + ["w%d" % i for i in range(60)]
text = lambda n: " ".join(random.choices(WORDS, k=n))
PASSAGE = [text(60) for _ in range(5)]
DOCS = [(i, text(random.randint(0, 80)) + " " + random.choice(PASSAGE)[random.randint(0, 30) :] + "\n" + text(random.randint(0, 60))) for i in range(60)]
CASES = {
    "passages": DOCS,
    "copies": [(5, DOCS[0][1]), (3, DOCS[0][1]), (9, DOCS[0][1] + " x"), (4, "y " + DOCS[0][1]), (None, DOCS[0][1]), (None, DOCS[1][1])],
    "runs and periods": [(1, "aa " * 100), (2, "aa " * 30), (3, "aa bb " * 60), (4, "x " + "aa bb " * 15 + "y"), (5, "x" * 300), (6, "x" * 49), (7, "x" * 50), (8, "abcdefg" * 20), (9, "")],
    "periods of one document": [(1, "se cion ciez ear asja. " * 5), (2, "a b c d e f g " * 9), (3, " ".join(f"p{k}" for k in range(23)) + " q r s " * 11)],
    "repeated rows": [(1, PASSAGE[0]), (2, PASSAGE[0]), (2, PASSAGE[0]), (2, "p " + PASSAGE[0]), (3, None), (3, "")],
    "long": [(1, PASSAGE[1]), (2, text(30_000) + " " + PASSAGE[1] + " " + text(100))],
    "empty": [],
}


@pytest.mark.parametrize("case", CASES)
def test_substrings(spark, case):
    docs = spark.createDataFrame(CASES[case], "doc_id long, text string").withColumns({"name": F.lit(1), "at": F.lit("x"), "spans": F.lit(None).cast("int")})
    assert sorted(map(tuple, remove_substrings(docs).collect()), key=repr) == brute_bytes(CASES[case])


@pytest.mark.parametrize("case", CASES)
def test_passages(spark, case):
    docs = spark.createDataFrame(CASES[case], "doc_id long, text string").withColumns({"name": F.lit(1), "at": F.lit("x"), "spans": F.lit(None).cast("int")})
    assert sorted(map(tuple, remove_passages(docs).collect()), key=repr) == brute_words(CASES[case])


KINDS = [(byte_kind(50), bytes_left, "a long, b long, c long, d string", brute_bytes), (word_kind(20), words_left, "a long, b long, d string", brute_words)]


@pytest.mark.parametrize("bucket, few", [(1, 16), (3, 1), (512, 1)])
@pytest.mark.parametrize("kind, left, columns, brute", KINDS)
def test_buckets_that_are_split(spark, monkeypatch, kind, left, columns, brute, bucket, few):
    """A bucket of more rows than a task may hold or compare is named anew, level by level, with the same result."""
    monkeypatch.setattr(repeats, "FEW", few)
    rows = [*DOCS, *CASES["runs and periods"], *((200 + i, t) for i, t in CASES["periods of one document"]), *((100 + i, f"{text(i % 7)} {PASSAGE[0]} {text(i % 5)}") for i in range(20)), (None, PASSAGE[0]), (None, "z " + PASSAGE[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = apply(docs, ranges(docs, kind, bucket), left, columns)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array(symbols):
    assert suffix_array(symbols) == sorted(range(len(symbols)), key=lambda k: symbols[k:])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=40), min_size=1, max_size=6))
def test_suffix_arrays_of_several_texts(texts):
    symbols = np.array([x for t in texts for x in [*t, 0]])
    want, base = [], 0
    for t in texts:
        want += [base + k for k in sorted(range(len(t) + 1), key=lambda k: [*t, 0][k:])]
        base += len(t) + 1
    assert suffix_arrays(symbols, np.array([len(t) + 1 for t in texts])).tolist() == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("ab"), min_size=8, max_size=30), st.lists(st.sampled_from("ab"), max_size=12), st.lists(st.sampled_from("ab"), max_size=12), st.integers(0, 4))
def test_a_window_is_named_alike_wherever_it_stands(window, before, after, level):
    """Every window is in one passage, whose name does not depend on what stands around it."""
    for kind, join in ((word_kind(8), b" ".join), (byte_kind(8), b"".join)):
        level = min(level, kind.levels - 1)

        def named(signs, kind=kind, join=join, level=level):
            _, at, size, name, _ = kind.passages([join([x.encode() for x in signs])], level)
            out = [(a + j, x) for a, n, x in zip(at.tolist(), size.tolist(), name.tolist()) for j in range(n - 7)]
            assert [a for a, _ in out] == list(range(len(signs) - 7))
            return [x for _, x in out]

        inner = named(window)
        assert inner == named(before + window + after)[len(before) : len(before) + len(inner)]
        assert inner == [named(window[k : k + 8])[0] for k in range(len(inner))]
        if kind.again:
            _, at, size, _, _ = kind.passages([join([x.encode() for x in window])], level)
            for a, n in zip(at.tolist(), size.tolist()):
                own = [tuple(window[k : k + 8]) for k in range(a, a + n - 7)]
                assert len(set(own)) == len(own)


def test_runs_of_nul(spark):
    rows = [(1, "a" + "\0" * 200 + "b"), (2, "c" + "\0" * 120), (3, "\0" * 50), (4, "\0" * 49), (5, PASSAGE[2] + "\0" * 90 + PASSAGE[3]), (None, "x" * 30 + "\0" * 26 + "y" * 30)]
    got = remove_substrings(spark.createDataFrame(rows, "doc_id long, text string"))
    want = brute_bytes(rows)
    assert {r[0]: r[2] for r in want} == {1: 0, 2: 120, 3: 50, 4: 0, 5: 90, None: 0}
    assert sorted(map(tuple, got.collect()), key=repr) == want


@pytest.mark.parametrize("kind, left, columns, brute", KINDS)
def test_equal_rows_cost_no_square(spark, kind, left, columns, brute):
    """Each of many equal rows gets each span once."""
    rows = [(1, " ".join(PASSAGE)), *[(None, f"{PASSAGE[0]} q {PASSAGE[1]}")] * 300]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    spans = ranges(docs, kind)
    assert 0 < max(len(set(r["spans"])) for r in spans.collect()) == max(len(r["spans"]) for r in spans.collect()) < 300
    assert sorted(map(tuple, apply(docs, spans, left, columns).collect()), key=repr) == brute(rows)
