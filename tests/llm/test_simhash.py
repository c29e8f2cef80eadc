import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from sigloom.llm.components import components
from sigloom.llm.simhash import links, near_duplicates


def mark(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    fps = [mark(t) for _, t in rows]
    group = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if bin(fps[i] ^ fps[j]).count("1") <= 3 and group[j] > group[i]:
                    group[j], changed = group[i], True
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in set(group)}
    return sorted(((r[0], f"{f:016x}", least[g]) for r, f, g in zip(rows, fps, group)), key=repr)


random.seed(5)
WORDS = ["w%d" % i for i in range(400)] + ["É", "x y", "Up", "ß"]
BASE = [" ".join(random.choices(WORDS, k=300)) for _ in range(6)]
NEAR = [b if k == 0 else " ".join(w if random.random() > 0.004 * k else "zz" for w in b.split(" ")) for b in BASE for k in range(6)]
CASES = {
    "near": list(enumerate(NEAR)),
    "copies": [(i + 1, BASE[0].upper() if i % 2 else BASE[0]) for i in range(20)] + [(0, BASE[1])],
    "short": [(4, ""), (3, None), (5, "one"), (6, "One"), (7, "a b"), (8, "a  b"), (9, "a\tb c"), (10, "a b c"), (11, " \n ")],
    "nulls, repeats and length": [(None, "a b c"), (None, None), (2, "a b c"), (2, "a b c"), (1, "tok " * 70_000), (3, "TOK " * 70_001)],
    "empty": [],
}


@pytest.mark.parametrize("case", CASES)
def test_against_brute_force(spark, case):
    docs = spark.createDataFrame(CASES[case], "doc_id long, text string").withColumns({"fp": F.lit("x"), "root": F.lit(1), "first": F.lit(2), "links": F.lit(3)})
    got = near_duplicates(docs)
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got.collect()), key=repr) == brute(CASES[case])


def test_links_connect_every_close_pair(spark):
    random.seed(1)
    centre = [random.getrandbits(64) for _ in range(4)]
    fps = sorted({c ^ sum(1 << b for b in random.sample(range(64), random.randint(0, 3))) for c in centre for _ in range(120)} | {random.getrandbits(64) for _ in range(100)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = {(r["a"], r["b"]) for r in links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 3 for a, b in edges)
    assert len(edges) < 20 * len(fps)
    roots = {r["node"]: r["root"] for r in components(spark.createDataFrame(list(edges), "a long, b long")).collect()}
    for a in signed:
        for b in signed:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= 3:
                assert roots.get(a, a) == roots.get(b, b)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 140)}


@pytest.mark.parametrize("few", [1, 20, 1024])
def test_one_key_over_many_batches(spark, few):
    random.seed(few)
    centre = [0xABCD_EF01 << 32 | random.getrandbits(32) for _ in range(300)]
    fps = sorted(set(centre) | {c ^ sum(1 << b for b in random.sample(range(32), random.randint(1, 3))) for c in centre[:40] for _ in range(9)})
    group = list(range(len(fps)))
    find = lambda x: x if group[x] == x else find(group[x])
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                group[find(i)] = find(j)
    want = {frozenset(fps[i] for i in range(len(fps)) if find(i) == g) for g in map(find, range(len(fps)))}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        edges = [(r["a"] & (2**64 - 1), r["b"] & (2**64 - 1)) for r in links(spark.createDataFrame([(f - (1 << 64),) for f in fps], "fp long"), few=few).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(bin(a ^ b).count("1") <= 3 for a, b in edges)
    at, group = {f: i for i, f in enumerate(fps)}, list(range(len(fps)))
    for a, b in edges:
        group[find(at[a])] = find(at[b])
    assert {frozenset(fps[i] for i in range(len(fps)) if find(i) == g) for g in map(find, range(len(fps)))} == want
