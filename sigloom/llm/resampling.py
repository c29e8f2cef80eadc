"""Quality classification by importance resampling.

Two generative models over hashed n-grams are counted: one of the target (documents labelled good), one of the raw corpus, over
all of its texts. A document's weight is the ratio of its probabilities under the two. Documents are drawn without replacement in
proportion to their weights by the Gumbel trick: the k largest sums of a log weight and a Gumbel variate. The variates come from
a hash of the doc_id, so a task that runs again draws the same.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Hashed n-grams: what the driver holds and broadcasts are as many numbers, whatever the corpus.
BUCKETS = 1 << 16

#: The bound of the sample of labelled rows that the target model is fitted on, by the least hash of the doc_id.
TARGET_ROWS = 50_000

#: Pseudo-counts by which a bucket's ratio is drawn to 1.
PRIOR = 8.0

#: Distinct words whose hashes a task keeps at once.
CACHE = 400_000

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shape(word: str) -> str:
    """What kind of token a word is: its case, its digits, or the signs it consists of."""
    if word.isalpha():
        return "x" if word.islower() else "X" if word.isupper() and len(word) == 1 else "XX" if word.isupper() else "Xx" if word.istitle() else "xX"
    return "9" if word.isdigit() else "_" if word[0].isalnum() else word[:3]


class Grams:
    """The buckets of the n-grams of texts: of one and two words, and of one, two and three token shapes."""

    def __init__(self) -> None:
        import re

        self.parts = re.compile(r"\w+|[^\w\s]+").findall
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.words, self.shapes = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def buckets(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Buckets, and the row of the text that each belongs to."""
        from xxhash import xxh64_intdigest

        if len(self.number) > CACHE:
            self._clear()
        lists = [self.parts(t) for t in texts]
        flat = [w for ws in lists for w in ws]
        if new := list({w for w in flat if w not in self.number}):
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
            self.words = np.concatenate([self.words, np.fromiter((xxh64_intdigest(w.lower()) for w in new), np.uint64, len(new))])
            self.shapes = np.concatenate([self.shapes, np.fromiter((xxh64_intdigest(shape(w), 1) for w in new), np.uint64, len(new))])
        at = np.fromiter(map(self.number.__getitem__, flat), np.int64, len(flat))
        row = np.repeat(np.arange(len(texts)), [len(ws) for ws in lists])
        word, form = self.words[at], self.shapes[at]
        if len(at) > 1:  # a word said again is a shape of its own
            form[1:] += ((at[1:] == at[:-1]) & (row[1:] == row[:-1])).astype(np.uint64) * _B
        out = [(word, row), (form, row)]
        for values, sizes in ((word, (2,)), (form, (2, 3))):
            for n in sizes:
                gram = values[n - 1 :].copy() if len(values) >= n else values[:0]
                for k in range(1, n):
                    gram = gram * _A + values[n - 1 - k : len(values) - k]
                same = row[n - 1 :] == row[: len(row) - n + 1] if len(row) >= n else row[:0] == 0
                out.append((gram[same], row[n - 1 :][same]))
        grams = np.concatenate([v * _B for v, _ in out])
        grams ^= grams >> np.uint64(31)
        return ((grams * _A) >> np.uint64(48)).astype(np.int64) % BUCKETS, np.concatenate([r for _, r in out])


def _slices(texts: list, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    k = 0
    while k < len(texts):
        j, total = k, 0
        while j < len(texts) and (total < size or j == k):
            total, j = total + len(texts[j]), j + 1
        yield k, j
        k = j


@dataclass
class Model:
    """ratio: the log ratio of each bucket; limit: the greatest log weight, as the target is that share of the raw corpus; share."""

    ratio: np.ndarray
    limit: float
    share: float

    def log_weights(self, grams: Grams, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts))
        for k, j in _slices(texts):
            buckets, row = grams.buckets(texts[k:j])
            out[k:j] = np.bincount(row, self.ratio[buckets], j - k)
        return np.minimum(out, self.limit)


def fit(docs: DataFrame, labels: DataFrame, target_rows: int = TARGET_ROWS) -> Model:
    """Counts both models. Good are the documents labelled quality 1 and not toxic; where several labels name one, all have to be so. Without a good label all weights are 1."""
    judged = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    shares = judged.agg(F.count("*").alias("n"), F.sum((F.col("quality") > 0).cast("long")).alias("good")).first()
    chosen = judged.filter("quality > 0 AND toxic = 0").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_rows).collect()
    good = np.sort(np.array([r["doc_id"] for r in chosen], np.int64))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, raw, target = Grams(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches:
            ids, texts = b.column(0).fill_null(-1).to_numpy(), [t or "" for t in b.column(1).to_pylist()]
            known = np.isin(ids, good) & ~np.array(b.column(0).is_null())
            for k, j in _slices(texts):
                buckets, row = grams.buckets(texts[k:j])
                raw += np.bincount(buckets, minlength=BUCKETS)
                target += np.bincount(buckets[known[k:j][row]], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])

    counted = docs.select("doc_id", "text").mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counted.collect():
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    share = (shares["good"] or 0) / shares["n"] if shares["n"] else 1.0
    if not target.sum() or not share:
        return Model(np.zeros(BUCKETS), 0.0, 1.0)
    expected = raw * (target.sum() / raw.sum())
    return Model(np.log((target + PRIOR) / (expected + PRIOR)), -math.log(share), share)


def variates(ids: pa.Array, seed: int) -> np.ndarray:
    """A standard Gumbel variate for each id."""
    from xxhash import xxh64_intdigest

    uniform = np.array([(xxh64_intdigest(str(i), seed) + 0.5) / 2**64 for i in ids.to_pylist()])
    return -np.log(-np.log(np.clip(uniform, 1e-300, 1 - 1e-16)))


def scores(docs: DataFrame, model: Model, seed: int = 0) -> DataFrame:
    """doc_id, log_weight, and key, the log weight and the variate together."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for b in batches:
            weights = model.log_weights(grams, [t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(weights), pa.array(weights + variates(b.column(0), seed))], ["doc_id", "log_weight", "key"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, log_weight double, key double")


def cutoff(scored: DataFrame, k: int, column: str = "key") -> float:
    """The k-th largest value, by counts in ever smaller bins: what comes to the driver is one count a bin."""
    total, low, high = scored.agg(F.count(column), F.min(column), F.max(column)).first()
    if k <= 0 or not total:
        return math.inf
    if k >= total:
        return -math.inf
    bins, above = 4096, 0
    while True:
        step = (high - low) / bins
        if not step or low + step == low or high - step == high:
            return low
        inside = scored.filter((F.col(column) >= low) & (F.col(column) <= high))
        number = F.least(F.floor((F.col(column) - low) / step), F.lit(bins - 1))
        counts = {r["bin"]: (r["n"], r["low"], r["high"]) for r in inside.groupBy(number.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()}
        for b in sorted(counts, reverse=True):
            n, least, most = counts[b]
            if above + n >= k:
                break
            above += n
        if n == 1 or least == most:
            return least
        low, high = least, most


@dataclass
class Choice:
    scored: DataFrame
    model: Model
    cutoff: float


def choose(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 0, target_rows: int = TARGET_ROWS, chance: float = 0.001) -> Choice:
    """The scores and the key from which on documents are drawn. k: how many; None: as many as there are documents that belong
    to the target with that chance at least, by the share of the target times their weight."""
    model = fit(docs, labels, target_rows)
    scored = cut(scores(docs, model, seed))
    if k is None:
        k = scored.filter(F.col("log_weight") + math.log(model.share) >= math.log(chance)).count()
    return Choice(scored, model, cutoff(scored, k))


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 0) -> DataFrame:
    """One row per row of docs: doc_id, log_weight, key, kept.

    kept are the k documents of largest key; ties at the last place, such as repeated rows, are all kept. Null and empty texts
    have no n-grams and weight 1. Null ids draw one variate, and labels without id or quality count for nothing. An empty table
    gives no rows. Columns but doc_id and text, and doc_id, quality and toxic of labels, are not read.
    """
    chosen = choose(docs, labels, k, seed)
    return chosen.scored.select("doc_id", "log_weight", "key", (F.col("key") >= F.lit(chosen.cutoff)).alias("kept"))


def keep_drawn(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 0) -> DataFrame:
    """The rows of docs that resample() keeps, with all their columns. Texts are scored again where they are read instead of
    being joined to their decisions, so none moves."""
    chosen = choose(docs, labels, k, seed)
    return docs.mapInArrow(_filter(docs.columns.index("doc_id"), docs.columns.index("text"), chosen.model, chosen.cutoff, seed), docs.schema)


def _filter(doc_id: int, text: int, model: Model, least: float, seed: int) -> Callable:
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for b in batches:
            weights = model.log_weights(grams, [t or "" for t in b.column(text).to_pylist()])
            yield b.filter(pa.array(weights + variates(b.column(doc_id), seed) >= least))

    return keep
