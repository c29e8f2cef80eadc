"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified Hamming distance, connected components.

A 64-bit fingerprint is cut into BLOCKS blocks. Two that differ in at most `distance` bits agree on all but `distance` of the
blocks, so each distinct fingerprint is filed under every choice of blocks that could be those. Fingerprints under one key are
compared as integers; what comes out is a forest that links what is linked, never all pairs. With six blocks and a distance of
three there are twenty keys of 32 bits or more, so chance meetings stay rare for billions of fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components

BLOCKS = 6

#: Fingerprints of one key that are compared without being parted further.
FEW = 1024


def fingerprint(text: bytes, size: int = 3) -> int:
    """The SimHash of the shingles of `size` words: a bit is 1 if set in over half the XXH64 of the shingles; 0 without words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(words) - size + 1)
    first, last = starts[:n].tolist(), (ends[min(size, len(words)) - 1 :] - 1).tolist()
    votes = np.zeros(64, np.int64)
    for k in range(0, n, 65_536):
        hashes = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(first[k : k + 65_536], last[k : k + 65_536])], np.uint64)
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, the fingerprint of each row as a signed long, and the SHA-256 of its text. Texts stay where they are read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            out = np.fromiter((fingerprint(t.as_py() or b"", size) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out), b.column(2)], ["doc_id", "fp", "digest"])

    return docs.select("doc_id", "text", text_digest(F.col("text")).alias("digest")).mapInArrow(read, "doc_id long, fp long, digest string")


def text_digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def links(distinct: DataFrame, distance: int = 3, few: int = FEW) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints `fp`, all of at most `distance` differing bits, that connect whatever
    such pairs connect. A task compares the fingerprints of one key with those not yet reached from one of them, so a dense
    group costs about its size; over `few` fingerprints are parted by more of their bits first, so that one of many strangers does
    not compare them all. What a task holds is 24 bytes for each distinct fingerprint of a key."""
    edges = np.linspace(0, 64, BLOCKS + 1).round().astype(int)
    blocks = [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(edges[:-1], edges[1:])]
    masks = [sum(m) for m in combinations(blocks, BLOCKS - distance)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    filed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("choice", "key"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # rows whose last key may go on in the next batch
        for b in _and_end(batches):
            if b is not None:
                if not b.num_rows:
                    continue
                held.append(np.stack([b.column(k).to_numpy().astype(np.int64) for k in range(3)]))
                if len(held) > 1 and (held[-1][:2, -1] == held[0][:2, 0]).all():
                    continue  # one key still: nothing is copied
            now = np.concatenate([*held, np.zeros((3, 0), np.int64)], axis=1)
            new = np.flatnonzero((now[0, 1:] != now[0, :-1]) | (now[1, 1:] != now[1, :-1])) + 1
            bounds = np.concatenate(([0], new, [now.shape[1]])) if b is None else np.concatenate(([0], new))
            done = bounds[-1]
            if done or b is None:
                yield _edges(now[2, :done].view(np.uint64), bounds)
            held = [now[:, done:]]

    def _edges(fps: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
        found: list[np.ndarray] = []
        sizes = np.diff(bounds)
        pairs = bounds[:-1][sizes == 2]
        near = pairs[np.bitwise_count(fps[pairs] ^ fps[pairs + 1]) <= distance] if len(pairs) else pairs
        found.append(np.stack([fps[near], fps[near + 1]], axis=1))
        for a, n in zip(bounds[:-1][sizes > 2], sizes[sizes > 2]):
            found += map(_forest, _parted(fps[a : a + n]))
        out = np.concatenate(found).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(out[:, 0].copy()), pa.array(out[:, 1].copy())], ["a", "b"])

    def _parted(fps: np.ndarray) -> Iterator[np.ndarray]:
        """The pigeonholes once more, in the bits that a large group differs in: close pairs agree on one of `distance` + 1 shares of them."""
        if len(fps) <= few:
            yield fps
            return
        differing = np.bitwise_or.reduce(fps ^ fps[0])
        bits = [1 << b for b in range(64) if int(differing) >> b & 1]
        for k in range(distance + 1):
            mask = np.uint64(sum(bits[k :: distance + 1]))
            rows = fps[np.argsort(fps & mask, kind="stable")]
            ends = np.flatnonzero(np.diff(rows & mask)) + 1
            yield from (g for g in np.split(rows, ends) if len(g) > 1)

    def _forest(fps: np.ndarray) -> np.ndarray:
        out, todo, open_ = [], np.unique(fps), []
        while len(todo) or open_:
            if not open_:
                open_, todo = [todo[0]], todo[1:]
            x = open_.pop()
            near = np.bitwise_count(todo ^ x) <= distance
            if near.any():
                met = todo[near]
                out.append(np.stack([np.full(len(met), x), met], axis=1))
                open_ += list(met)
                todo = todo[~near]
        return np.concatenate(out) if out else np.zeros((0, 2), np.uint64)

    return filed.repartition("choice", "key").sortWithinPartitions("choice", "key").select("choice", "key", "fp").mapInArrow(compare, "a long, b long")


def _and_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def near_duplicates(docs: DataFrame, distance: int = 3, size: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id it reaches).

    Words are what white space parts, after A-Z are lower-cased; shingles take `size` words, and fewer words are one shingle.
    Fingerprints of at most `distance` differing bits link. Null and empty texts have fingerprint zero, which links like any
    other. A null doc_id belongs to its component but is never its smallest id unless all are null. Repeated rows give a row
    each, an empty table none. Columns but doc_id and text are not read.
    """
    marked = cut(fingerprints(docs, size).drop("digest"))
    placed = _placed(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), distance)
    named = placed.join(placed.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _placed(groups: DataFrame, distance: int) -> DataFrame:
    """groups (fp, first) with the root of each fingerprint's component."""
    roots = components(links(groups.select("fp"), distance))
    return groups.join(roots, groups.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def representatives(docs: DataFrame, distance: int = 3, size: int = 3) -> DataFrame:
    """One row per component of near_duplicates: doc_id and digest (the SHA-256 of the text) of its row of the smallest doc_id, nulls last, and of these the smallest digest."""
    marked = cut(fingerprints(docs, size))
    first = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "digest")
    placed = _placed(marked.groupBy("fp").agg(F.min(first).alias("first")), distance)
    return placed.groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.digest")
