import math
import random
import re

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from test_decontamination import brute as leaks
from test_packing import brute as pieces
from test_simhash import mark
from tokenizers import Tokenizer

from sigloom.llm.resampling import Grams, resample, variates


def test_stages_on_planted_documents(spark, tmp_path):
    random.seed(4)
    word = lambda: "".join(random.choices("abcdefghij", k=random.randint(2, 8)))
    clean = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    rows = [(i, clean(random.randint(30, 200))) for i in range(200)]
    junk = [(1000 + i, " ".join(word().upper() + "!!" for _ in range(60))) for i in range(30)]
    copies = [(2000 + i, rows[i][1].replace(" ", "\n", 3)) for i in range(10)]
    item = clean(30)
    leaks = [(3000 + i, f"{clean(40)} {item} {clean(40)}") for i in range(5)]
    long = [(4000, clean(300))]
    near = [(4001, long[0][1].replace(long[0][1].split()[150], "zz", 1)), (4002, long[0][1] + " q.")]
    docs = rows + junk + copies + leaks + long + near + [(None, "A null name.")]
    d = str(tmp_path)
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long"), "key": F.lit("clash")})
    table.write.parquet(f"{d}/documents.parquet")
    labels = [(i, 1, 0) for i, _ in rows[:120]] + [(i, 0, 0) for i, _ in junk[:15]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    now, kept = spark.read.parquet(f"{d}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, d)
        assert k == 4 or out.columns == now.columns
        out.write.parquet(f"{d}/out{k}")
        now = spark.read.parquet(f"{d}/out{k}")
        kept.append({r["doc_id"] for r in now.select("doc_id").collect()})
    ids = lambda x: {i for i, _ in x}
    assert not kept[0] & ids(junk) and ids(docs) - ids(junk) == kept[0]
    assert kept[1] == kept[0] - ids(copies)
    assert kept[1] - kept[2] <= ids(near) and 4001 not in kept[2]
    assert kept[3] == kept[2] - ids(leaks)
    assert kept[4] == kept[3]
    assert {tuple(r)[:5] for r in corpus_pipeline.run(spark, d).collect()} == {tuple(r)[:5] for r in now.collect()}


def test_empty_documents(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0


def test_rows_that_share_an_id_are_decided_each(spark):
    random.seed(8)
    text = lambda n: " ".join("".join(random.choices("abcdefghij", k=6)) for _ in range(n))
    far = [text(80) for _ in range(8)]
    rows = [(None, t) for t in far[:4]] + [(7, t) for t in far[4:6]] + [(None, far[0]), (7, far[4].replace(" ", "  ", 3)), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "digest": F.lit("clash"), "text_sha256": F.lit("clash")})
    out = corpus_pipeline.exact(spark, docs, "")
    assert out.columns == docs.columns
    got = [(r["doc_id"], r["text"] or "") for r in out.collect()]
    assert sorted(got, key=repr) == sorted([(None, t) for t in [*far[:4], ""]] + [(7, rows[7][1]), (7, far[5])], key=repr)
    rows = [(None, t) for t in far[:4]] + [(None, far[0] + " q"), (7, far[4]), (7, far[5]), (3, far[3] + " q"), (None, far[6]), (9, far[7]), (9, far[7])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("clash"))
    got = [tuple(r)[:2] for r in corpus_pipeline.near(spark, docs, "").collect()]
    assert [sum(k is None and t.startswith(x) for k, t in got) for x in far[:3]] == [1, 1, 1]
    assert {g for g in got if g[0]} == {(7, far[4]), (7, far[5]), (3, far[3] + " q"), (9, far[7])} and len(got) == 8


def drawn(docs, labels):
    """The documents of the largest keys, by sorting all keys: {row: key}, and how many are drawn."""
    counts = [np.bincount(Grams().buckets([t or ""])[0], minlength=1 << 16) for _, t in docs]
    good, judged = {i for i, quality, toxic in labels if quality == 1 and not toxic}, {i for i, _, _ in labels}
    raw, target = sum(counts), sum(c for (i, _), c in zip(docs, counts) if i in good)
    ratio, share = np.log((target + 8) / (raw * target.sum() / raw.sum() + 8)), len(good) / len(judged)
    weights = [min(-math.log(share), float(c @ ratio)) for c in counts]
    k = sum(w + math.log(share) >= math.log(0.001) for w in weights)
    keys = [w + variates(pa.array([i], pa.int64()), 0)[0] for w, (i, _) in zip(weights, docs)]
    return {d for d, key in zip(docs, keys) if key >= sorted(keys, reverse=True)[k - 1]}


def stays(docs, names, order):
    """The first of each group of docs."""
    groups = {}
    for d, g in zip(docs, names):
        groups.setdefault(g, []).append(d)
    return {min(g, key=order) for g in groups.values()}


def near_groups(docs):
    marks, group = [mark(t) for _, t in docs], list(range(len(docs)))
    for _ in docs:
        for i in range(len(docs)):
            for j in range(len(docs)):
                if bin(marks[i] ^ marks[j]).count("1") <= 3:
                    group[j] = group[i] = min(group[i], group[j])
    return group


def test_against_brute_force(spark, tmp_path):
    random.seed(11)
    text = lambda n: " ".join("".join(random.choices("abcdefgh", k=random.randint(2, 7))) for _ in range(n)) + "."
    item, rows = text(14), [(i, text(random.randint(3, 70))) for i in range(40)]
    junk = [(100 + i, " ".join("".join(random.choices("QXZ", k=4)) + "!?" for _ in range(40))) for i in range(10)]
    copies = [(200 + i, rows[i][1].replace(" ", "\t\n", 2)) for i in range(6)] + [(220, rows[0][1]), (221, "<|endoftext|> x")]
    leaky = [(300, f"{text(9)} {item} {text(9)}"), (301, " ".join(reversed([item[: len(item) // 2], item[len(item) // 2 :]])))]
    long = text(400)
    docs = rows + junk + copies + leaky + [(400, long), (401, long.replace(long.split()[200], "zz", 1)), (None, text(20)), (500, ""), (501, None)]
    labels = [(i, 1, 0) for i, _ in rows[:30]] + [(i, 0, 0) for i, _ in junk]
    d = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    kept = drawn(docs, labels)
    read = lambda name: spark.read.parquet(f"{d}/{name}.parquet")
    assert {r["doc_id"] for r in resample(read("documents"), read("labels")).filter("kept").collect()} == {i for i, _ in kept} and not {i for i, _ in kept} & {i for i, _ in junk}
    last = lambda i: (i is None, i or 0)
    kept = list(kept)
    kept = list(stays(kept, [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in kept], lambda x: (-len(x[1] or ""), last(x[0]))))
    kept = list(stays(kept, near_groups(kept), lambda x: last(x[0])))
    bad = {k for k, found, *_ in leaks(kept, [(1, item)]) if found}
    kept = [x for x in kept if x[0] not in bad]
    assert bad >= {300}
    want = pieces(kept, Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    got = corpus_pipeline.run(spark, d).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == want
    ends = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 1024


def test_columns_of_any_name_and_type(spark, tmp_path, monkeypatch):
    """Names that stages use themselves, and a column that has no order."""
    from sigloom.llm import decontamination

    random.seed(4)
    text = lambda n: " ".join("".join(random.choices("abcdefghij", k=6)) for _ in range(n))
    far, item = [text(60) for _ in range(5)], text(12)
    docs = [(1, far[0]), (1, far[0]), (2, far[0] + " "), (3, far[1]), (4, far[1].upper()), (5, far[2] + " " + item), (None, far[3]), (None, None)]
    clash = {n: F.lit("x") for n in ("_stay", "stay", "_digest", "digest", "_row", "row", "leaky", "doc", "row_key", "node", "root", "keep_id", "text_sha256", "key", "fingerprint")}
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns(clash | {"extra": F.create_map(F.lit("k"), F.lit(1)), "many": F.array(F.create_map(F.lit("k"), F.col("doc_id")))})
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    ids = lambda df: sorted((r["doc_id"] for r in df.collect()), key=repr)
    want = {"quality": None, "exact": [2, 3, 4, 5, None, None], "near": [1, 3, 5, None, None], "benchmark": [1, 1, 2, 3, 4, None, None]}
    for name, left in want.items():
        out = getattr(corpus_pipeline, name)(spark, table, str(tmp_path))
        assert out.columns == table.columns and (left is None and out.count() <= 8 or ids(out) == left), name
    assert {r["doc_id"] for r in corpus_pipeline.packing(spark, table, "").collect()} == {1, 2, 3, 4, 5, None}
    monkeypatch.setattr(decontamination, "BROADCAST_WORDS", 0)
    out = corpus_pipeline.benchmark(spark, table, str(tmp_path))
    assert out.columns == table.columns and ids(out) == want["benchmark"]
    for stage in ("quality", "exact", "near", "benchmark"):
        assert getattr(corpus_pipeline, stage)(spark, table.limit(0), str(tmp_path)).collect() == []


def test_tables_on_the_way_go(spark, tmp_path):
    from sigloom.staging import _PATHS

    before = set(_PATHS.values())
    spark.createDataFrame([(1, "a b c"), (2, "d e f")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "x y z")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.collect()} == {1, 2}
    assert len([p for p in set(_PATHS.values()) - before if any(set(spark.read.parquet(p).columns) == {"doc_id", "text"} for _ in [0])]) <= 1
