"""The prefix trie, against a plain version."""

from collections import defaultdict
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.llm import prefix_trie as pt

FIELDS = "conv_id long, turn long, role string, text string, depth string, name int, block string"


def plain(rows, branched):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(x)] for c, x in convs.items()}
    built = {}
    for c, own in turns.items():
        h = crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        built[c] = turns.get(base, [])[:h] + own[h:] if branched else own
    members = defaultdict(list)
    for c, way in built.items():
        for d in range(len(way) + 1):
            members[tuple(way[:d])].append(c)
    parents = {p[:-1] for p in members if p}
    out = []
    for path, of in members.items():
        below = [p for p in members if p[: len(path)] == path]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(str(c) for c in sorted(of) if len(built[c]) == len(path))
        kids = sum(1 for p in members if p and p[:-1] == path)
        out.append((min(of), len(path), min(members[path[:-1]]) if path else None, len(of), kids, sum(p not in parents for p in below), saved, sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], FIELDS).repartition(3)


def some():
    rng = np.random.default_rng(5)
    rows = []
    for c in [*range(-7, 40), 2**63 - 1, -(2**63)]:
        for t in range(int(rng.integers(1, 12))):
            rows.append((c, t, str(rng.choice(["user", "assistant"])), str(rng.choice(["a", "b", "é"])) if t else "a"))
    rows += [(3, None, None, None), (3, None, "user", ""), (4, 1, "user", "tie"), (4, 1, "user", "tie"), (4, 1, "assistant", "tie"), (None, 0, "user", "lost"), (50, 0, "user", "long " * 20_000)]
    return rows + [(60, k, "user", "a" if k % 7 else "b") for k in range(40)] + [(61, k, "user", "a" if k % 7 else "b") for k in range(39)]


def got(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=repr)


@pytest.mark.parametrize("branched", [True, False])
def test_against_a_plain_version(spark, branched):
    assert got(pt.prefix_trie(table(spark, some()), branched)) == plain(some(), branched)


@pytest.mark.parametrize("branched", [True, False])
def test_blocks_and_chunks(spark, monkeypatch, branched):
    monkeypatch.setattr(pt, "BLOCK", 10)
    monkeypatch.setattr(pt, "CHUNK", 2)
    assert got(pt.prefix_trie(table(spark, some()), branched)) == plain(some(), branched)


def test_collisions_are_split(spark):
    rows = [r for r in some() if r[0] is None or -3 < r[0] < 14 or r[0] == 60]
    weak_turns = lambda role, text: F.length(text) % 2 + F.lit(0).cast("long")
    assert got(pt.prefix_trie(table(spark, rows), True, hashed=weak_turns, renamed=lambda name: name % 2)) == plain(rows, True)


def test_texts_of_nodes_and_empty_tables(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "bot", "x"), (2, 0, "user", "hi")]
    nodes = {(r["conv_id"], r["depth"]): (r["role"], r["text"], r["n_convs"]) for r in pt.prefix_trie(table(spark, rows)).collect()}
    assert nodes == {(1, 0): (None, None, 2), (1, 1): ("user", "hi", 2), (1, 2): ("bot", "x", 1)}
    none = spark.createDataFrame([], FIELDS)
    assert pt.prefix_trie(none, True).collect() == [] and pt.prefix_trie(table(spark, [(None, 1, "user", "a")])).collect() == []
