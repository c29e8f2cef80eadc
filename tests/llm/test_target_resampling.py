"""Importance resampling towards a target, against a plain version."""

import math
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sigloom.llm import target_resampling as tr

FIELDS = "doc_id long, text string, score string, row string"


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)], len(words)


def plain(docs, target, percent, least):
    count = lambda texts: Counter(crc32(f.encode()) % 10000 for t in texts for f in features(t)[0])
    raw, aim = count(t for _, t in docs), count(target)
    s, t = sum(raw.values()), sum(aim.values())
    gain = lambda b: math.floor(1000 * math.log((aim[b] + 1) * (t * 0 + s + 10000) / ((raw[b] + 1) * (t + 10000))))
    out = []
    for i, text in docs:
        own, words = features(text)
        weight = sum(gain(crc32(f.encode()) % 10000) for f in own)
        h = int(sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, words >= least])
    able = sorted((x for x in out if x[5]), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for k, x in enumerate(able[: percent * len(able) // 100]):
        x[4] = k + 1
    return sorted((tuple(x[:5]) for x in out), key=repr)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aZ0 é.-\n日", max_size=40), min_size=1, max_size=6))
def test_checksums_of_runs(texts):
    sums = tr.Checksums()
    buckets, row, sizes = tr.buckets_of(sums, [t.encode() for t in texts])
    for k, t in enumerate(texts):
        own, words = features(t)
        assert sizes[k] == words and sorted(buckets[row == k]) == sorted(crc32(f.encode()) % 10000 for f in own)


def test_checksums_of_long_words():
    texts = ["a" * 5000 + " b " + "c" * 70001 + " d e", "f " * 3000]
    buckets, row, _ = tr.buckets_of(tr.Checksums(), [t.encode() for t in texts])
    for k, t in enumerate(texts):
        assert Counter(buckets[row == k].tolist()) == Counter(crc32(f.encode()) % 10000 for f in features(t)[0])


def test_against_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(tr, "CHUNK", 4)
    rng = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(60)] + ["É", "Ü2"]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    docs = [(int(k), text(int(rng.integers(1, 60)))) for k in range(300)]
    same = text(30)
    docs += [(None, None), (900, ""), (901, " .,; "), (None, same)] + [(7, same)] * 9 + [(None, same)] * 30 + [(k, same) for k in range(400, 420)]
    target = [text(40) for _ in range(5)] + [None, ""]
    rows = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], FIELDS).repartition(5)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    for percent, least in ((5, 20), (40, 20), (100, 1), (0, 20)):
        got = sorted((tuple(r) for r in tr.resample_to(rows, aim, percent, least).collect()), key=repr)
        assert got == plain(docs, target, percent, least)


def test_empty_tables(spark):
    none = spark.createDataFrame([], FIELDS)
    assert tr.resample_to(none, none.select("text")).collect() == []
    some = spark.createDataFrame([(1, "a " * 25, None, None)], FIELDS)
    assert [tuple(r) for r in tr.resample_to(some, none.select("text"), 100).collect()] == plain([(1, "a " * 25)], [], 100, 20)
