import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.llm.resampling import Grams, cutoff, fit, keep_drawn, resample, scores, variates

ROOT = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{ROOT}/documents.parquet"), spark.read.parquet(f"{ROOT}/labels.parquet")
    held = labels.filter("doc_id % 2 = 0")
    got = resample(docs, labels.filter("doc_id % 2 = 1")).join(held, "doc_id").filter("toxic = 0 OR quality = 0")
    rates = {r["quality"]: r["kept"] for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert rates[1] > 0.98 and rates[0] < 0.1


def test_weights_are_ratios_of_whole_counts(spark):
    rows = [(1, "good words here"), (2, "good words there"), (3, "BAD!! BAD!!"), (4, ""), (None, None), (5, "good words here"), (6, "good " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 1, None), (3, 0, 0), (5, 1, 1), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    model = fit(docs, labels)
    grams, raw, target = Grams(), np.zeros(1 << 16), np.zeros(1 << 16)
    for i, t in rows:
        b, _ = grams.buckets([t or ""])
        raw += np.bincount(b, minlength=1 << 16)
        target += np.bincount(b, minlength=1 << 16) if i in (1, 2) else 0
    assert model.share == 0.75
    assert np.allclose(model.ratio, np.log((target + 8) / (raw * target.sum() / raw.sum() + 8)))
    got = sorted(((r["doc_id"], r["log_weight"]) for r in scores(docs, model).collect()), key=repr)
    assert np.allclose([w for _, w in got], [min(model.limit, model.ratio[Grams().buckets([dict(rows)[i] or ""])[0]].sum()) for i, _ in got])


@pytest.mark.parametrize("values, k", [([3.0, 1.0, 2.0], 2), ([1.0] * 9, 4), ([], 3), ([5.0], 0), ([5.0, 6.0], 9), (list(np.random.default_rng(0).normal(size=2000)), 700), ([0.0, 1e-300, 1e300], 2)])
def test_cutoff(spark, values, k):
    least = cutoff(spark.createDataFrame([(float(v),) for v in values], "key double"), k)
    want = sorted(values, reverse=True)[k - 1] if 0 < k <= len(values) else None
    assert sum(v >= least for v in values) == (sum(v >= want for v in values) if want is not None and k < len(values) else min(k, len(values)))


def test_cases(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, None), (2, "")], "doc_id long, text string").withColumns({"key": F.lit("x"), "log_weight": F.lit(1), "kept": F.lit(2)})
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = resample(docs, none)
    assert got.columns == ["doc_id", "log_weight", "key", "kept"] and got.filter("kept AND log_weight = 0").count() == 4
    assert resample(docs.limit(0), none).count() == 0
    assert keep_drawn(docs, none).columns == docs.columns and keep_drawn(docs, none, k=2).count() == 2


def test_variates_are_gumbel():
    import pyarrow as pa

    drawn = variates(pa.array(range(20_000)), 0)
    assert abs(drawn.mean() - 0.5772) < 0.03 and abs(drawn.var() - np.pi**2 / 6) < 0.08
