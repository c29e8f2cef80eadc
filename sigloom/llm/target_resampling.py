"""Importance resampling towards a target distribution.

Features of documents and of the target are counted in hashed buckets; the gain of a bucket is the log ratio of its two smoothed
shares, in whole thousandths. A document's weight is the sum of its features' gains, read from an array of all gains. Weight and
a Gumbel variate, drawn from a hash of the doc_id, make an integer score. The draw takes the highest scores: a histogram of the
exact scores, summed from above, says how many rows stand before each score and which score is the last one drawn; inside each
drawn score rows are numbered by doc_id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Buckets of features: what the driver holds and every task gets are as many numbers, whatever the corpus.
BUCKETS = 10_000

#: Distinct words whose checksums a task keeps at once.
CACHE = 400_000

#: Rows of one score and doc_id that are numbered together; more are numbered chunk by chunk.
CHUNK = 1 << 16

#: Bytes to words: A-Z become a-z, and what is neither letter, digit nor part of a longer UTF-8 sequence becomes a space.
_WORDS = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 0x20 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


class Checksums:
    """The CRC-32 of every run of one to three words, joined by spaces.

    A checksum of joined strings follows from theirs: that of the first, carried over the length of the second, xor that of the
    second. Carrying is linear, so each length has four tables of 256 numbers, one a byte.
    """

    def __init__(self) -> None:
        self._clear()
        byte = np.arange(256, dtype=np.uint32)
        step = byte.copy()
        for _ in range(8):
            step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)
        self.one = np.stack([step, *(byte << np.uint32(8 * k - 8) for k in (1, 2, 3))])

    def _clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.alone, self.spaced, self.row = np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.lengths: dict[int, int] = {}
        self.tables = np.zeros((0, 4, 256), np.uint32)

    def _over(self, length: int) -> np.ndarray:
        """The tables that carry a checksum over so many bytes."""
        out, power = None, self.one
        while length:
            if length & 1:
                out = power if out is None else _carry(power, out)
            length >>= 1
            if length:
                power = _carry(power, power)
        return out

    def learn(self, words: list[bytes]) -> np.ndarray:
        """The numbers of words."""
        if len(self.number) > CACHE or len(self.lengths) > 4096:
            self._clear()
        if new := list({w for w in words if w not in self.number}):
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
            if fresh := sorted({len(w) + 1 for w in new} - self.lengths.keys()):
                self.lengths.update(zip(fresh, range(len(self.lengths), len(self.lengths) + len(fresh))))
                self.tables = np.concatenate([self.tables, np.stack([self._over(n) for n in fresh])])
            self.alone = np.concatenate([self.alone, np.fromiter(map(crc32, new), np.uint32, len(new))])
            self.spaced = np.concatenate([self.spaced, np.fromiter((crc32(b" " + w) for w in new), np.uint32, len(new))])
            self.row = np.concatenate([self.row, np.fromiter((self.lengths[len(w) + 1] for w in new), np.int64, len(new))])
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def followed(self, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The checksums of strings with checksums `before`, each followed by a space and the word numbered `at`."""
        flat, base = self.tables.reshape(-1), self.row[at] << 10
        out = self.spaced[at]
        for k in range(4):
            out ^= flat[base + ((before >> np.uint32(8 * k)) & np.uint32(255)) + (k << 8)]
        return out


def _carry(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][(crc >> np.uint32(8)) & 255] ^ tables[2][(crc >> np.uint32(16)) & 255] ^ tables[3][crc >> np.uint32(24)]


def buckets_of(sums: Checksums, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of the features of texts, the text that each feature belongs to, and the words of each text."""
    lists = [t.translate(_WORDS).split() for t in texts]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    at = sums.learn([w for ws in lists for w in ws])
    row = np.repeat(np.arange(len(texts)), sizes)
    one = sums.alone[at]
    two = sums.followed(one[:-1], at[1:])
    three = sums.followed(two[:-1], at[2:]) if len(two) else two
    same2, same3 = row[1:] == row[:-1], row[2:] == row[:-2]
    features = np.concatenate([one, two[same2], three[same3]])
    return (features % np.uint32(BUCKETS)).astype(np.int64), np.concatenate([row, row[1:][same2], row[2:][same3]]), sizes


def _slices(sizes: list[int], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    k = 0
    while k < len(sizes):
        j, total = k, 0
        while j < len(sizes) and (total < most or j == k):
            total, j = total + sizes[j], j + 1
        yield k, j
        k = j


def feature_counts(texts: DataFrame) -> np.ndarray:
    """How often features fall into each bucket, over all rows of texts (text); one row a bucket and task moves."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, total = Checksums(), np.zeros(BUCKETS, np.int64)
        for b in batches:
            whole = [t or b"" for t in b.column(0).cast(pa.binary()).to_pylist()]
            for k, j in _slices([len(t) for t in whole]):
                total += np.bincount(buckets_of(sums, whole[k:j])[0], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket, in thousandths, rounded down: its smoothed share of the target over that of the raw corpus."""
    s, t = float(raw.sum()) + len(raw), float(target.sum()) + len(target)
    return np.array([math.floor(1000 * math.log((b + 1.0) * s / ((a + 1.0) * t))) for a, b in zip(raw.tolist(), target.tolist())], np.int64)


def variate(doc_id: int | None, seed: int) -> int:
    """A Gumbel variate in thousandths, rounded down, by a hash of the doc_id."""
    h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """doc_id, words, n_features, weight, score of each row of docs."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Checksums()
        for b in batches:
            whole, weights, counts, words = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()], [], [], []
            for k, j in _slices([len(t) for t in whole]):
                buckets, row, sizes = buckets_of(sums, whole[k:j])
                weights.append(np.bincount(row, gain[buckets], j - k).astype(np.int64))  # whole numbers, exact in doubles
                counts.append(np.bincount(row, minlength=j - k))
                words.append(sizes)
            weight, noise = np.concatenate([np.zeros(0, np.int64), *weights]), np.array([variate(i, seed) for i in b.column(0).to_pylist()], np.int64)
            columns = [np.concatenate([np.zeros(0, np.int64), *words]), np.concatenate([np.zeros(0, np.int64), *counts]), weight, weight + noise]
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, columns)], ["doc_id", "words", "n_features", "weight", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, words long, n_features long, weight long, score long")


def before_each(histogram: DataFrame) -> DataFrame:
    """score, before: how many rows have a higher score. histogram: score, n, one row a score.

    The scores are dealt out by ranges, so no task sorts them all; what comes to the driver is one sum a range.
    """
    dealt = histogram.repartitionByRange(F.desc("score")).withColumn("part", F.spark_partition_id())
    held = cut(dealt)
    sums = {r["part"]: r["n"] for r in held.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    above, offsets = 0, []
    for part in sorted(sums):
        offsets.append((part, above))
        above += sums[part]
    start = held.sparkSession.createDataFrame(offsets, "part int, start long") if offsets else held.sparkSession.range(0).selectExpr("int(id) AS part", "id AS start")
    inside = F.sum("n").over(Window.partitionBy("part").orderBy(F.desc("score"))) - F.col("n")
    return held.join(F.broadcast(start), "part").select("score", "n", (F.col("start") + inside).alias("before"))


def resample_to(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """One row per row of docs: doc_id, n_features, weight, score, rank, all long.

    Words are A-Z lower-cased runs of ASCII letters, digits and all signs above ASCII; features are runs of one to three words.
    rank counts the drawn rows from 1, by falling score and then by rising doc_id; it is null in rows that are not drawn. Drawn
    are `percent` in a hundred, rounded down, of the rows with `least_words` words or more. A null or empty text has no feature
    and weight 0. A null doc_id draws the variate of an empty one and comes after all others of its score. Rows that repeat an
    id with the same text have one score and take neighbouring ranks, in no particular order. Where target is empty, or docs
    are, the counts are zero and the gains follow from the smoothing alone; an empty table gives no rows. Texts of any length
    are read whole. Other columns are not read, so their names cannot clash.
    """
    gain = gains(feature_counts(docs), feature_counts(target))
    rows = cut(scored(docs, gain, seed).withColumn("row", F.monotonically_increasing_id()))
    able = rows.filter(F.col("words") >= least_words)
    drawn = percent * able.count() // 100
    places = cut(before_each(able.groupBy("score").agg(F.count("*").alias("n"))).filter(F.col("before") < drawn))
    last = places.agg(F.min("score")).first()[0]
    reached = (F.col("words") >= least_words) & (F.col("score") >= (F.lit(last) if last is not None else F.lit(None).cast("long")))

    # Rows of one score are numbered by doc_id. Rows that share the doc_id too are numbered in chunks, so that none is large.
    some = rows.filter(F.coalesce(reached, F.lit(False))).withColumn("chunk", F.shiftright("row", CHUNK.bit_length() - 1))
    chunks = some.groupBy("score", "doc_id", "chunk").agg(F.count("*").alias("m"))
    earlier = F.sum("m").over(Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "chunk")) - F.col("m")
    chunks = chunks.withColumn("earlier", earlier).join(places.select("score", "before"), "score")
    own = F.row_number().over(Window.partitionBy("score", "doc_id", "chunk").orderBy("row"))
    s, c = some.withColumn("own", own).alias("s"), chunks.alias("c")
    same = (F.col("s.score") == F.col("c.score")) & F.col("s.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("s.chunk") == F.col("c.chunk"))
    rank = F.col("before") + F.col("earlier") + F.col("own")
    ranked = s.join(c, same).select("s.doc_id", "s.n_features", "s.weight", "s.score", F.when(rank <= drawn, rank).cast("long").alias("rank"))
    rest = rows.filter(~F.coalesce(reached, F.lit(False))).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return ranked.unionByName(rest)
