from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sigloom.llm.chat_format import rotate_perspectives

low = lambda v: (v is not None, v if v is not None else 0)


def brute(rows):
    talks = defaultdict(list)
    for c, t, r, x in rows:
        talks[c].append((low(t), r if r is not None else "unknown", x or "", t))
    out = []
    for c, turns in talks.items():
        for p in {r for _, r, _, _ in turns if r != "system"}:
            at = 0
            for _, r, x, t in sorted(turns):
                head = "assistant" if r == p else r if r == "system" else f"user name={r}"
                s = f"<|im_start|>{head}\n{x}<|im_end|>\n"
                own = r == p
                out.append((c, p, t, s, at, len(s), at + len(head) + 13 if own else None, at + len(s) - 1 if own else None))
                at += len(s)
    return sorted(out, key=repr)


CASES = {
    "three speakers": [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "hé 😀"), (1, 3, "cy", None), (1, 4, "ann", "")],
    "long": [(2, i, "ab"[i % 2], "x" * (i % 7)) for i in range(1000)] + [(3, 0, "a", "y" * 100_000)],
    "nulls, ties and repeats": [(None, None, None, None), (None, 1, "a", "t"), (4, 1, "a", "t"), (4, 1, "a", "t"), (4, 1, "b", "s"), (5, 0, "system", "alone"), (4, -300, "a", "early")],
    "empty": [],
}


@pytest.mark.parametrize("case", CASES)
def test_against_brute_force(spark, case):
    talks = spark.createDataFrame(CASES[case], "conv_id long, turn long, role string, text string").withColumns({"block": F.lit(7), "perspective": F.lit("p"), "of": F.lit(1)})
    assert sorted(map(tuple, rotate_perspectives(talks).collect()), key=repr) == brute(CASES[case])


def test_mask_covers_the_speaker(spark):
    rows = rotate_perspectives(spark.createDataFrame(CASES["three speakers"], "conv_id long, turn long, role string, text string")).filter("perspective = 'bob'").orderBy("start").collect()
    whole = "".join(r["segment"] for r in rows)
    assert [whole[r["mask_start"] : r["mask_end"]] for r in rows if r["mask_start"] is not None] == ["hé 😀<|im_end|>"]


def test_turns_without_a_number_come_first(spark):
    rows = [("c", 1, "b", "one"), ("c", None, "a", "none"), ("c", -300, "b", "before"), ("c", 700, "a", "last"), (None, None, "z", "")]
    got = rotate_perspectives(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")).collect()
    for person in ("a", "b"):
        own = sorted((r for r in got if r["conv_id"] == "c" and r["perspective"] == person), key=lambda r: r["start"])
        assert [r["turn"] for r in own] == [None, -300, 1, 700]
        assert [r["start"] for r in own] == [sum(len(x["segment"]) for x in own[:k]) for k in range(4)]
        assert all("".join(x["segment"] for x in own)[r["mask_start"] : r["mask_end"]] == r["segment"][r["mask_start"] - r["start"] : -1] for r in own if r["mask_start"] is not None)
    assert sum(r["conv_id"] is None for r in got) == 1
