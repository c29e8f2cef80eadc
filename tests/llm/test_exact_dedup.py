import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sigloom.llm.exact_dedup import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        first = min(groups[bare])
        out.append((i, first[3], len(groups[bare]), i == first[3] and len(t or "") == -first[0], hashlib.sha256(bare.encode()).hexdigest()))
    return sorted(out, key=repr)


LONG = "Many words. " * 2000
CASES = {
    "plain": [(3, "a b"), (1, "ab"), (2, "a  b"), (4, "abc"), (5, None), (6, ""), (7, " \t\n"), (8, "é b"), (9, "é b")],
    "long": [(1, LONG), (2, LONG.replace(" ", "\n")), (3, LONG + "x"), (4, "x" * 9000), (5, "x" * 8999 + " x")],
    "ties and repeats": [(2, "a b"), (2, "a b"), (1, "b a"), (1, "ab"), (None, "a b"), (None, None)],
    "empty": [],
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("weak", [False, True])
def test_against_brute_force(spark, case, weak):
    docs = spark.createDataFrame(CASES[case], "doc_id long, text string").withColumns({"recipe": F.lit("r"), "h": F.lit(1), "n": F.lit(None).cast("int")})
    more = {"chunk_hash": lambda c: F.xxhash64(c) % 2} if weak else {}
    got = exact_dedup(docs, **more)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(CASES[case])
