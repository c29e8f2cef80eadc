import os

import pytest
import pytest
from pyspark.sql import functions as F

from sigloom.llm.licence_scan import DIGESTS, KNOWN, scan_licences

MIT = KNOWN["MIT"]
SAME = [MIT, MIT.upper(), "Copyright (c) 2019 A. Person\n\n" + MIT, "  © 2020 me\n" + MIT.replace("license", "licence").replace("sublicense", "sub-license"), MIT.replace(",", " ").replace("\n", "\r\n"), MIT.replace(". ", ".\n * ")]
OTHER = [MIT + " And more.", MIT.replace("free of charge", "for a fee"), "a word " + MIT, "", None, "!!!", "x " * 60_000, "copyright 2020 me"]


@pytest.mark.parametrize("text", SAME)
def test_variants_match(spark, text):
    docs = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string").withColumns({"licence": F.lit("x"), "digest": F.lit(1), "known": F.lit(2), "words": F.lit(None).cast("int")})
    assert [r["licence"] for r in scan_licences(docs).collect()] == ["MIT"] * 3


def test_others_do_not(spark):
    got = scan_licences(spark.createDataFrame(list(enumerate(OTHER)), "doc_id long, text string"))
    assert [r["licence"] for r in got.collect()] == [None] * len(OTHER)


def test_every_known_text_matches_itself(spark):
    rows = list(KNOWN.items())
    got = scan_licences(spark.createDataFrame(list(enumerate(v for _, v in rows)), "doc_id long, text string"))
    assert {r["doc_id"]: r["licence"] for r in got.collect()} == {i: k for i, (k, _) in enumerate(rows)}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert scan_licences(empty).count() == 0
    assert scan_licences(spark.createDataFrame([(1, "a")], "doc_id long, text string"), {}).collect()[0]["licence"] is None


SYSTEM = "/usr/share/common-licenses"


@pytest.mark.skipif(not os.path.isdir(SYSTEM), reason="no licence texts on this system")
def test_published_texts(spark):
    """Whole licences as published, and told in other words of the same meaning, in capitals, and under a copyright line."""
    files = {n: open(f"{SYSTEM}/{n}", encoding="utf-8", errors="replace").read() for n in os.listdir(SYSTEM) if n in DIGESTS}
    assert files
    forms = (lambda t: t, lambda t: "Copyright (c) 2024 A. Person\n\n" + t.upper(), lambda t: t.replace(" license", " licence").replace(",", " , "), lambda t: t + "\nand more")
    rows = [(k, n, f(t)) for n, t in files.items() for k, f in enumerate(forms)]
    docs = spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["licence"] for r in scan_licences(docs).collect()}
    assert got == {i: n if k < 3 else None for i, (k, n, _) in enumerate(rows)}
