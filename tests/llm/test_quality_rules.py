"""Quality rules and lines that many documents of a host hold, against a plain version."""

import re
from collections import Counter

import numpy as np

from sigloom.llm.quality_rules import quality_rules

FIELDS = "doc_id long, text string, source string, row long, line string, host string"


def plain(docs, documents, share):
    """docs: doc_id, text, host."""
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines = lambda t: [x for x in (t or "").split("\n") if words(x)]
    norm = lambda x: " ".join(words(re.sub("[0-9]+", "0", x))).lower()
    held = Counter((h, x) for _, t, h in docs for x in {norm(x) for x in lines(t)})
    size = Counter(h for *_, h in docs)
    out = []
    for i, t, h in docs:
        w = words(t)
        runs = Counter(zip(w, w[1:], w[2:]))
        at = {p + k for p in range(len(w) - 2) if runs[tuple(w[p : p + 3])] > 1 for k in range(3)}
        gone = [k for k, x in enumerate((t or "").split("\n")) if words(x) and (n := held[h, norm(x)]) > documents and n > share * size[h]]
        all_ = (t or "").split("\n")
        lost = sum(len(words(all_[k])) for k in gone)
        failed = len(w) < 50 or 100 * len(at) > 50 * len(w)
        kept = not failed and len(w) - lost >= 50 and lost <= 0.5 * len(w)
        symbols, dup = sum(c in "#*$%&|<>" for c in t or ""), len(lines(t)) - len(set(lines(t)))
        out.append((i, len(w), sum(map(len, w)), symbols, dup, len(at), failed, len(gone), lost, kept, "\n".join(x for k, x in enumerate(all_) if k not in gone)))
    return sorted(out, key=repr)


def test_against_a_plain_version(spark):
    rng = np.random.default_rng(9)
    line = lambda n, most: " ".join(f"w{k}" for k in rng.integers(0, most, n))
    docs = []
    for k in range(120):
        host = ("big", "big", "small", None)[k % 4]
        own = [line(int(rng.integers(1, 30)), int(rng.choice([5, 5000]))) for _ in range(int(rng.integers(0, 9)))]
        menu = [f"Menu  {k} | Home", "\thome  ABOUT ünder ß"] if k % 3 else ["menu 7 | home "]
        docs.append((k, "\n".join(own[:3] + menu + own[3:] + ["", " \r"]), host))
    same = "\n".join(line(12, 5000) for _ in range(10))
    docs += [(k, same, "copied") for k in range(200, 230)] + [(5, same, "small"), (None, same, "small"), (None, None, None), (None, None, None), (300, "", "big"), (301, " \n\t\n", None)]
    docs += [(302, "a " * 60, "x"), (303, "a a a", "x"), (304, "a a a a", "x"), (305, "# $ * % & | < > <b>", "x"), (306, "日本 日本 日本 日本", "x"), (307, "one two three\none two three\n one two three", "x")]
    docs += [(310, line(60_000, 200), "x"), (311, "\n".join(["again and again"] * 5000), "x")]
    rows = spark.createDataFrame([(i, t, h, 1, "l", "h") for i, t, h in docs], FIELDS).repartition(4)
    for documents, share in ((10, 0.001), (3, 0.4), (0, 0.0)):
        got = quality_rules(rows, documents=documents, share=share, text=True)
        assert sorted(map(tuple, got.collect()), key=repr) == plain(docs, documents, share)
    assert [r[0] for r in quality_rules(rows.select("doc_id", "text", "source")).filter("kept").collect()].count(200) == 0


def test_runs_are_told_by_their_words(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(F, "hash", lambda *c: F.lit(7))  # all runs of one hash
    docs = [(1, " ".join(f"w{k % 40}" for k in range(90)), "x"), (2, " ".join(f"w{k}" for k in range(90)), "x"), (3, "a b c d a b c e a b", "x")]
    rows = spark.createDataFrame([(i, t, h, 1, "l", "h") for i, t, h in docs], FIELDS)
    assert sorted((r["doc_id"], r["n_repeat_words"]) for r in quality_rules(rows).collect()) == [(x[0], x[5]) for x in plain(docs, 10, 0.001)]


def test_empty_table(spark):
    assert quality_rules(spark.createDataFrame([], FIELDS), text=True).collect() == []
