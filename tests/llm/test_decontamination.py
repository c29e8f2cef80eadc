import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sigloom.llm import decontamination
from sigloom.llm.decontamination import drop_leaks, find_leaks, tiles
from sigloom.llm.entries import op2_decontamination


def brute_tiles(item, doc, least):
    mi, md, out = [False] * len(item), [False] * len(doc), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and not mi[i + n] and not md[d + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, d)
        n, i, d = best
        if n < least:
            return out
        mi[i : i + n] = md[d : d + n] = [True] * n
        out.append((i, d, n))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=30), st.lists(st.integers(1, 4), max_size=40), st.integers(1, 4))
def test_tiles(item, doc, least):
    got = tiles(item, doc, least)
    assert sorted(n for _, _, n in got) == sorted(n for _, _, n in brute_tiles(item, doc, least))
    assert all(item[i : i + n] == doc[d : d + n] for i, d, n in got)


def brute(docs, items, least=5, share=0.8):
    out = []
    for k, t in docs:
        doc, found = (t or "").lower().split(), {}
        for name, text in items:
            item = (text or "").lower().split()
            if item and name is not None:
                part = sum(n for _, _, n in brute_tiles(item, doc, min(least, len(item)))) / len(item)
                if part >= share:
                    found[name] = max(part, found.get(name, 0))
        out.append((k, bool(found), sorted(found), max(found.values(), default=0.0)))
    return sorted(out, key=repr)


random.seed(2)
word = lambda n, k="w": [f"{k}{random.randint(0, 500)}" for _ in range(n)]
ITEMS = [(i, " ".join(word(random.choice([12, 25, 40])))) for i in range(8)] + [(20, "one two three"), (21, ""), (22, None), (None, "no id at all here five"), (23, "Solo")]
A, B = ITEMS[0][1].split(), ITEMS[1][1].split()
DOCS = [
    (1, " ".join(word(30, "v") + A + word(20, "v"))), (2, " ".join(word(5, "v") + A[len(A) // 2 :] + word(9, "v") + A[: len(A) // 2])), (3, " ".join(A[: len(A) // 2])), (4, " ".join(A).upper() + "\n" + " ".join(B)),
    (5, "x one two three y"), (6, "one two x three"), (7, "the solo"), (8, ""), (9, None), (None, " ".join(B)), (10, " ".join(B)), (10, " ".join(B)), (11, " ".join(x for i, x in enumerate(B) if i % 5)), (12, " ".join(["v"] * 20_000 + B)),
]


@pytest.mark.parametrize("limit", [10**6, 0])
@pytest.mark.parametrize("docs, items", [(DOCS[:-1], ITEMS), ([], ITEMS), (DOCS[:3], [])])
def test_against_brute_force(spark, monkeypatch, docs, items, limit):
    monkeypatch.setattr(decontamination, "BROADCAST_WORDS", limit)
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"item_id": F.lit(1), "seed": F.lit("x"), "coverage": F.lit(None).cast("int")})
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(9))
    got = find_leaks(table, bench)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items)
    clean = drop_leaks(table, bench)
    assert clean.columns == table.columns
    assert sorted((r["doc_id"] for r in clean.collect()), key=repr) == sorted((k for k, bad, _, _ in brute(docs, items) if not bad), key=repr)


def test_long_texts(spark):
    got = find_leaks(spark.createDataFrame(DOCS[-1:], "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")).collect()
    assert got[0]["item_ids"] == [1]


PERIODIC = [(1, " ".join(["la"] * 12)), (2, "row the boat " * 7), (3, "a b " * 20 + "c d e f g"), (4, "0 1 2 3 4 5 6 7 8 9 " * 4), (5, "x " * 7 + "y " * 7)]
REFRAINS = [(k, f"v1 v2 {t} v3") for k, t in PERIODIC] + [
    (11, "la " * 9), (12, "la " * 10), (13, "la " * 60), (14, "row the boat " * 4), (15, "row the boat " * 3 + "ashore " + "row the boat " * 3), (16, "a b " * 9), (17, "3 4 5 6 7 8 9 0 1 2 " * 4), (18, "y " * 6 + "x " * 6),
]


@pytest.mark.parametrize("limit", [10**6, 0])
def test_items_that_repeat_their_words(spark, monkeypatch, limit):
    monkeypatch.setattr(decontamination, "BROADCAST_WORDS", limit)
    table, bench = spark.createDataFrame(REFRAINS, "doc_id long, text string"), spark.createDataFrame(PERIODIC, "item_id long, text string")
    want = brute(REFRAINS, PERIODIC)
    assert all(k in ids and most == 1 for k, _, ids, most in want if k <= 5)
    assert sorted(map(tuple, find_leaks(table, bench).collect()), key=repr) == want
    assert {r["doc_id"] for r in drop_leaks(table, bench).collect()} == {k for k, bad, _, _ in want if not bad}


@pytest.mark.parametrize("limit", [10**6, 0])
def test_rows_that_share_an_id_are_judged_each(spark, monkeypatch, limit):
    monkeypatch.setattr(decontamination, "BROADCAST_WORDS", limit)
    rows = [(1, " ".join(A)), (1, "clean"), (None, " ".join(B)), (None, "clean too"), (None, None)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(ITEMS[:2], "item_id long, text string")
    assert sorted(map(tuple, drop_leaks(docs, bench).collect()), key=repr) == sorted([rows[1], *rows[3:]], key=repr)


def test_the_query_has_a_row_for_each_document(spark, tmp_path):
    spark.createDataFrame(DOCS[:-1], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = op2_decontamination(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(k, bad, ",".join(map(str, ids)), most) for k, bad, ids, most in brute(DOCS[:-1], ITEMS)], key=repr)
