"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items that share a seed (a run of `least` words) meet. Of such a pair the longest common matches that do
not overlap are marked again and again, found by running Karp-Rabin, down to matches of `least` words; the share of the item's
words that are marked tells whether the document holds it, whole or in reordered passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, unused

#: Words of a benchmark up to which its texts are held by every task (8 bytes a seed and the words). Larger ones are joined by their seeds.
BROADCAST_WORDS = 2_000_000

_PRIME, _BASE = (1 << 61) - 1, 1_000_003


def tiles(item: list[int], doc: list[int], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in item, place in doc, length) of matches of `least` numbers or more that overlap in neither, the longest first."""
    marked_item, marked_doc = [False] * len(item), [False] * len(doc)
    out: list[tuple[int, int, int]] = []
    size = max(least, min(len(item), len(doc)) // 2)
    while True:
        found = _scan(item, doc, marked_item, marked_doc, size)
        if found and found[0][0] > 2 * size:
            size = found[0][0]
            continue
        while found:
            for n, i, d in found:
                if any(marked_item[i : i + n]) or any(marked_doc[d : d + n]):
                    break  # a longer tile took part of it; what remains is found, in its turn, by the next scan
                marked_item[i : i + n] = marked_doc[d : d + n] = [True] * n
                out.append((i, d, n))
            else:
                break
            found = _scan(item, doc, marked_item, marked_doc, size)
        if size == least:
            return out
        size = max(least, size // 2)


def _scan(item: list[int], doc: list[int], marked_item: list[bool], marked_doc: list[bool], size: int) -> list[tuple[int, int, int]]:
    """Running Karp-Rabin: matches of unmarked numbers, each as long as it goes, of `size` at least; longest first, then by place."""
    table: dict[int, list[int]] = {}
    for i, h in _rolling(item, marked_item, size):
        table.setdefault(h, []).append(i)
    best: dict[tuple[int, int], int] = {}
    if table:
        for d, h in _rolling(doc, marked_doc, size):
            for i in table.get(h, ()):
                if (i and d and item[i - 1] == doc[d - 1] and not marked_item[i - 1] and not marked_doc[d - 1]) or item[i : i + size] != doc[d : d + size]:
                    continue  # inside a longer match that starts before, or not equal but for the hash
                n = size
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and not marked_item[i + n] and not marked_doc[d + n]:
                    n += 1
                best[i, d] = n
    return sorted(((n, i, d) for (i, d), n in best.items()), key=lambda x: (-x[0], x[1], x[2]))


def _rolling(numbers: list[int], marked: list[bool], size: int) -> Iterator[tuple[int, int]]:
    """The hash of every run of `size` unmarked numbers."""
    top = pow(_BASE, size - 1, _PRIME)
    h = run = 0
    for k, x in enumerate(numbers):
        if marked[k]:
            h = run = 0
            continue
        if run >= size:
            h -= numbers[k - size] * top
        h = (h * _BASE + x) % _PRIME
        run += 1
        if run >= size:
            yield k - size + 1, h


def _numbers(words: list[bytes], vocabulary: dict[bytes, int] | None) -> np.ndarray:
    from xxhash import xxh64_intdigest

    if vocabulary is None:
        return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    return np.fromiter((vocabulary.get(w, 0) for w in words), np.uint64, len(words))


def _seeds(numbers: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` numbers."""
    h = np.zeros(max(0, len(numbers) - size + 1), np.uint64)
    for k in range(size):
        h = (h ^ (numbers[k : k + len(h)] + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(31)
    return h


class Benchmark:
    """Items, their words as numbers from 1, and which items each seed occurs in, for documents that are read one by one."""

    def __init__(self, items: list[tuple[int, bytes]], least: int, share: float):
        self.least, self.share = least, share
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[tuple[int, list[int]]] = []
        for name, text in items:
            words = text.lower().split()
            if words:
                self.items.append((name, [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]))
        #: an item of fewer words has one seed, itself
        self.sizes = sorted({min(least, len(x)) for _, x in self.items})
        self.own = [_seeds(np.array(x, np.uint64), min(least, len(x))) for _, x in self.items]
        self.seeds = {}
        for size in self.sizes:
            pairs = sorted((int(h), k) for k, (_, x) in enumerate(self.items) if min(least, len(x)) == size for h in set(self.own[k].tolist()))
            self.seeds[size] = np.array([h for h, _ in pairs], np.uint64), np.array([k for _, k in pairs], np.int64)

    def leaks(self, text: bytes) -> list[tuple[int, float]]:
        """(item, share of its words) of the items that text holds, by name."""
        numbers = _numbers(text.lower().split(), self.vocabulary)
        out: dict[int, float] = {}
        for size, (seeds, of) in self.seeds.items():
            hashes = _seeds(numbers, size)
            left, right = np.searchsorted(seeds, hashes, "left"), np.searchsorted(seeds, hashes, "right")
            places = np.flatnonzero(left < right)
            near: dict[int, list[int]] = {}
            for p in places.tolist():
                for k in of[left[p] : right[p]].tolist():
                    near.setdefault(k, []).append(p)
            for k, at in near.items():
                name, item = self.items[k]
                if _reached(self.own[k], hashes[at], size) < self.share * len(item):
                    continue
                if (share := covered(item, numbers, at, size)) >= self.share:
                    out[name] = max(share, out.get(name, 0.0))
        return sorted(out.items())


def _reached(own: np.ndarray, found: np.ndarray, size: int) -> int:
    """How many words of an item stand in a seed that was found, at any of its places: tiles cover no others."""
    starts = np.flatnonzero(np.isin(own, found))
    return int(np.minimum(np.diff(starts), size).sum()) + size if len(starts) else 0


def covered(item: list[int], numbers: np.ndarray, at: list[int], least: int) -> float:
    """The share of the item that tiles cover. Only what seeds of the item cover in the document can be tiled; the rest stands as one gap."""
    doc: list[int] = []
    end = -1
    for p in at:
        if p > end and doc:
            doc.append(0)
        doc += numbers[max(p, end) : p + least].tolist()
        end = p + least
    return sum(n for _, _, n in tiles(item, [x if x else -1 - k for k, x in enumerate(doc)], least)) / len(item)


def _items(benchmark: DataFrame) -> list[tuple[int, bytes]] | None:
    """The items, if they are few enough to be held by every task."""
    words = benchmark.select(F.size(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+")).alias("n")).agg(F.sum("n")).first()[0] or 0
    if words > BROADCAST_WORDS:
        return None
    return [(r["item_id"], (r["text"] or "").encode()) for r in benchmark.select("item_id", "text").filter("item_id IS NOT NULL").collect()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: int = 5, share: float = 0.8) -> DataFrame:
    """One row per row of docs: doc_id, contaminated, item_ids (array, ascending), coverage (of the item covered most; 0 if none is held).

    Words are what white space parts, after A-Z are lower-cased. A document holds an item if tiles of `least` words or more cover
    at least `share` of the item's words; an item of fewer words has to stand whole. Null and empty texts hold and are nothing;
    items without id are not looked for, and items with one id count once. Null ids and repeated rows give a row each, an empty
    table none, and an empty benchmark finds nothing. Columns but doc_id, text and item_id are not read.
    """
    items = _items(benchmark)
    if items is None:
        return _joined(docs, benchmark, least, share)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            held = held or Benchmark(items, least, share)
            found = [held.leaks(t or b"") for t in b.column(1).cast(pa.binary()).to_pylist()]
            arrays = [pa.array([bool(x) for x in found]), pa.array([[i for i, _ in x] for x in found], pa.list_(pa.int64())), pa.array([max((s for _, s in x), default=0.0) for x in found])]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], ["doc_id", "contaminated", "item_ids", "coverage"])

    return docs.select("doc_id", "text").mapInArrow(judge, "doc_id long, contaminated boolean, item_ids array<long>, coverage double")


def _row_key(docs: DataFrame) -> Column:
    """A digest of the text, which alone decides what a row holds: 16 bytes, so that no two texts of any corpus share one."""
    return F.unhex(F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary")))


def _met(docs: DataFrame, benchmark: DataFrame, least: int, share: float) -> DataFrame:
    """The way for benchmarks of any size: seeds of both sides are joined, and the pairs that share one are tiled. row_key, item_ids, coverage of the rows that hold items."""

    def seeds(sizes: list[int], own: bool):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k, text in enumerate(b.column(1).to_pylist()):
                    numbers = _numbers((text or b"").lower().split(), None)
                    for size in [min(least, len(numbers))] if own else sizes:
                        if not size:
                            continue
                        hashes = np.unique(_seeds(numbers, size)).view(np.int64)
                        yield pa.RecordBatch.from_arrays([b.column(0)[k : k + 1].take(pa.array(np.zeros(len(hashes), np.int64))), pa.array(np.full(len(hashes), size, np.int32)), pa.array(hashes)], ["k", "size", "seed"])

        return work

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for row, name, doc, item in zip(*(b.column(k).to_pylist() for k in range(4))):
                rows += [(row, i, s) for i, s in Benchmark([(name, item)], least, share).leaks(doc)]
            cols = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["row_key", "item_id", "coverage"])

    binary = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    items = benchmark.filter("item_id IS NOT NULL").select("item_id", binary)
    read = docs.select(_row_key(docs).alias("row_key"), binary)
    item_seeds = cut(items.select(F.col("item_id").alias("k"), "text").mapInArrow(seeds([], True), "k long, size int, seed long"))
    sizes = [r["size"] for r in item_seeds.select("size").distinct().collect()]
    doc_seeds = read.select(F.col("row_key").alias("k"), "text").mapInArrow(seeds(sizes, False), "k binary, size int, seed long")
    met = doc_seeds.join(item_seeds.withColumnRenamed("k", "item_id"), ["size", "seed"]).select(F.col("k").alias("row_key"), "item_id").distinct()
    pairs = met.join(items.withColumnRenamed("text", "item"), "item_id").join(read.distinct(), "row_key").select("row_key", "item_id", "text", "item")
    return pairs.mapInArrow(tiled, "row_key binary, item_id long, coverage double").groupBy("row_key").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("coverage").alias("coverage"))


def _joined(docs: DataFrame, benchmark: DataFrame, least: int, share: float) -> DataFrame:
    """find_leaks for benchmarks of any size."""
    found = _met(docs, benchmark, least, share)
    return docs.select(_row_key(docs).alias("row_key"), "doc_id").join(found, "row_key", "left").select(
        "doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), F.coalesce("coverage", F.lit(0.0)).alias("coverage")
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, least: int = 5, share: float = 0.8) -> DataFrame:
    """The rows of docs that hold no item, with all their columns, whatever their names; judged where they are read, so no text moves unless the benchmark is too large to be held.
    Rows are judged as by find_leaks(): null and empty texts stay, repeated rows stay or go together, an empty table stays one."""
    items = _items(benchmark)
    if items is None:
        leaky = unused(docs, "leaky")
        return docs.join(_met(docs, benchmark, least, share).select(F.col("row_key").alias(leaky)), _row_key(docs) == F.col(leaky), "left_anti")
    text = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            held = held or Benchmark(items, least, share)
            yield b.filter(pa.array([not held.leaks(t or b"") for t in b.column(text).cast(pa.binary()).to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
