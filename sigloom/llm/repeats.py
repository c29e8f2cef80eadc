"""Where passages of documents stand in earlier ones too: the steps that substring and suffix-array deduplication share.

1. Every window of the asked length is named by its own content alone, wherever it stands. Neighbouring windows of one name form
   a passage; equal windows have equal names, so passages without a name in common share nothing.
2. Passages meet by name in one shuffle of their names, hashes and places; no text moves. Of equal passages the first document's
   decides the others. In a batch that is done before the shuffle, so a passage moves once a batch however often it stands there.
3. Only names that different passages have move content: one row for each passage that no earlier one equals.
4. Passages under one name form a bucket, and a resolver tells which of their windows stand in an earlier one. A bucket of more
   than BUCKET rows is not gathered: its passages are named anew by longer pieces of their windows, level by level, and meet
   under those names, until at the last level a name is a whole window and equal names are equal passages.
5. The decided ranges of each document are merged and applied to its text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release

#: Stands for a null doc_id: later than all others.
LAST = 2**63 - 1

#: Rows of one bucket that a task holds at once; larger buckets are split by longer names.
BUCKET = 512

#: Windows of one passage at most: periodic texts have long runs of windows with one name.
SPAN = 256

#: Passages of one bucket that a resolver compares; more are parted by longer names where they are.
FEW = 16

#: Bytes of content that a resolver gets at once.
FLUSH = 1 << 21

PLACED = "name long, doc_id long, text_key long, at int, size int"

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
#: An odd number and its inverse among the 64-bit numbers.
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


@dataclass
class Kind:
    """How a kind of unit (bytes, words) is named and looked at.

    again: whether a window that stands earlier in the same document counts; then no two windows of a passage are equal.
    levels: how often windows can be named, each time by longer pieces; at the last level every window is a passage.
    passages(texts, level) -> (row, place, size, name, hash) arrays over a batch of texts, in order of row and place.
    contents(texts, row, place, size) -> the contents of passages, as an Arrow array of bytes.
    resolve(buckets) -> (bucket, passage, start, stop) of the ranges of each passage whose windows also stand in an earlier
    one; a bucket is a list of different passages (content, doc_id, place).
    """

    length: int
    again: bool
    levels: int
    passages: Callable
    contents: Callable
    resolve: Callable


def ranges(docs: DataFrame, kind: Kind, bucket: int = BUCKET) -> DataFrame:
    """doc_id (LAST for null), text_key and spans: the [start, stop) of each row of docs that has such passages, as start * 2^32 + stop. Equal rows have one row of spans, each of which stands there once."""
    spark = docs.sparkSession
    read = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("binary").alias("text"))
    long_enough = read.filter(F.octet_length("text") >= kind.length)
    named = long_enough.mapInArrow(_named(kind), "name long, hash long, doc_id long, text_key long, at int, size int")
    met = cut(named.repartition("name").sortWithinPartitions("name", "hash", "doc_id", "at", "text_key").mapInArrow(_met(kind), PLACED))
    release(spark)
    wanted = met.filter("size > 0").groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("name", "at", "size")).alias("wanted"))
    found = long_enough.join(wanted, ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "wanted").mapInArrow(_contents(kind), f"{PLACED}, content binary")
    decided = met.filter("size < 0")
    for level in range(kind.levels):
        told = cut(found.repartition("name").sortWithinPartitions("name", "content", "doc_id", "at").mapInArrow(_decide(kind, level, bucket), f"{PLACED}, content binary"))
        release(spark)
        decided = decided.unionByName(told.filter("content IS NULL").drop("content"))
        found = told.filter("content IS NOT NULL")
        if found.isEmpty():
            break
    span = F.shiftleft(F.col("at").cast("long"), 32) + F.col("at") - F.col("size")
    return decided.groupBy("doc_id", "text_key").agg(F.collect_set(span).alias("spans"))


def _batch(columns: list, names: str = PLACED) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in names.split(", ")]
    arrays = [c if isinstance(c, pa.Array) else pa.array(c.view(np.int64) if isinstance(c, np.ndarray) and c.dtype == np.uint64 else c, kinds[k]) for c, (_, k) in zip(columns, fields)]
    return pa.RecordBatch.from_arrays(arrays, [n for n, _ in fields])


def _named(kind: Kind) -> Callable:
    """The passages of each batch, but for those that an earlier document of the batch decides: of these the merged ranges, with negative size."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, at, size, names, hashes = kind.passages(b.column(2).to_pylist(), 0)
            if not len(row):
                continue
            docs, keys = b.column(0).to_numpy()[row], b.column(1).to_numpy()[row]
            late = _later_in_batch(names, hashes, docs, at, kind.again)
            r, start, stop = merge(row[late], at[late], at[late] + size[late])
            on = ~late
            yield _batch(
                [np.concatenate(x) for x in (
                    (names[on].view(np.int64), b.column(1).to_numpy()[r] ^ start), (hashes[on].view(np.int64), np.zeros(len(r), np.int64)), (docs[on], b.column(0).to_numpy()[r]),
                    (keys[on], b.column(1).to_numpy()[r]), (at[on], start), (size[on], start - stop),
                )],
                "name long, hash long, doc_id long, text_key long, at int, size int",
            )

    return name


def _later_in_batch(names: np.ndarray, hashes: np.ndarray, docs: np.ndarray, at: np.ndarray, again: bool) -> np.ndarray:
    """Which passages have an equal one in an earlier document of the batch (or, with again, earlier in their own)."""
    order = np.argsort(names ^ hashes * _A, kind="stable")
    names, hashes, docs, at = names[order], hashes[order], docs[order], at[order]
    mixed = names ^ hashes * _A
    heads = np.flatnonzero(np.append(True, mixed[1:] != mixed[:-1]))
    of = np.repeat(heads, np.diff(np.append(heads, len(names))))
    like = (names == names[of]) & (hashes == hashes[of])
    first = np.minimum.reduceat(np.where(like, docs, LAST), heads)[np.searchsorted(heads, of)]
    late = like & (docs > first)
    if again:
        own = np.minimum.reduceat(np.where(like & (docs == first), at, LAST), heads)[np.searchsorted(heads, of)]
        late |= like & (docs == first) & (at > own)
    out = np.zeros(len(late), bool)
    out[order] = late
    return out


def _met(kind: Kind) -> Callable:
    """From rows in order of name, hash, doc_id and place: the ranges that are decided (of negative size), and the places whose content has to be looked at."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64)] * 6  # rows of the last name, while all of it are one passage
        state: tuple | None = None  # name, hash, first doc_id and place of the last passage, once its name has several
        for b in _and_end(batches):
            now = rest if b is None else [np.concatenate([r, b.column(k).to_numpy()]) for k, r in enumerate(rest)]
            done = now[5] < 0
            if done.any():
                yield _batch([c[done] for c in (now[0], now[2], now[3], now[4], now[5])])
                now = [c[~done] for c in now]
            name, body, doc, key, at, size = now
            n = len(name)
            if not n:
                rest = now
                continue
            new_name, new_body = np.ones(n, bool), np.ones(n, bool)
            new_name[1:] = name[1:] != name[:-1]
            new_body[1:] = new_name[1:] | (body[1:] != body[:-1])
            goes_on = state is not None and state[0] == name[0]
            same_body = goes_on and state[1] == body[0]
            heads = np.flatnonzero(new_body)
            first_doc, first_at = doc[heads], at[heads]
            if same_body:
                first_doc[0], first_at[0] = state[2], state[3]
            counts = np.diff(np.append(heads, n))
            first_doc, first_at = np.repeat(first_doc, counts), np.repeat(first_at, counts)
            late = doc > first_doc
            if kind.again:
                late |= (doc == first_doc) & (at > first_at)
            opens = np.flatnonzero(new_name)
            several = np.add.reduceat(new_body.astype(np.int64), opens) > 1
            several[0] |= goes_on
            several = np.repeat(several, np.diff(np.append(opens, n)))
            twice = np.zeros(n, bool)  # the same place of the same text, from a repeated row
            twice[1:] = ~new_body[1:] & (doc[1:] == doc[:-1]) & (at[1:] == at[:-1]) & (key[1:] == key[:-1])
            wait = ~late & ~twice & ~several & (name == name[-1]) if b is not None else np.zeros(n, bool)
            if wait.sum() > 1 << 16:
                wait[:], several[name == name[-1]] = False, True  # looked at without need, but not held
            look = ~late & ~twice & several
            out = late | look
            yield _batch([name[out], doc[out], key[out], at[out], np.where(late, -size, size)[out]])
            rest = [c[wait] for c in now]
            state = None if wait.any() else (name[-1], body[-1], first_doc[-1], first_at[-1])

    return meet


def _and_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def _contents(kind: Kind) -> Callable:
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wanted = b.column(3)
            row = np.repeat(np.arange(len(b)), wanted.value_lengths().to_numpy())
            name, at, size = (wanted.flatten().field(k).to_numpy() for k in range(3))
            docs, keys = b.column(0).to_numpy(), b.column(1).to_numpy()
            for k in range(0, len(row), 100_000):
                part = slice(k, k + 100_000)
                yield _batch([name[part], docs[row[part]], keys[row[part]], at[part], size[part], kind.contents(b.column(2), row[part], at[part], size[part])], f"{PLACED}, content binary")

    return look


def _decide(kind: Kind, level: int, most: int) -> Callable:
    """From passages in order of name, content, doc_id and place: the ranges that are decided (no content), and passages of larger buckets, named by the next level."""
    last = level == kind.levels - 1

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: list[tuple] = []
        split: list[tuple] = []
        buckets: list[list[list]] = []
        own: list[list] = []  # content, first doc_id and place, rows
        name, content, first, held, units, large = None, None, None, 0, 0, False

        def close() -> None:
            nonlocal own, held, units
            if len(own) > 1:
                buckets.append(own)
                units += sum(len(p[0]) for p in own)
            own, held = [], 0

        def settle() -> None:
            nonlocal buckets, units
            deeper, few = level, []
            while buckets:
                few += [x for x in buckets if len(x) <= FEW or deeper == kind.levels - 1]
                deeper += 1
                buckets = [x for x in buckets if len(x) > FEW and deeper < kind.levels]
                if buckets:
                    buckets = _parted(kind, deeper, buckets, told)
            for k, p, start, stop in kind.resolve([[(x[0], *x[1]) for x in bucket] for bucket in few]):
                told.extend((0, doc, key, at + start, start - stop, None) for doc, key, at, _ in few[k][p][3])
            units = 0

        for b in _and_end(batches):
            rows = [(None,) * 6] if b is None else zip(*(b.column(k).to_pylist() if k == 5 else b.column(k).to_numpy().tolist() for k in range(6)))
            for row in rows:
                if b is None or row[0] != name:
                    close()
                    if units >= FLUSH or b is None:
                        settle()
                    name, content, large = row[0], None, False
                    if b is None:
                        break
                _, doc, key, at, size, text = row
                if text == content:
                    if doc > first[0] or kind.again and doc == first[0] and at > first[1]:
                        told.append((0, doc, key, at, -size, None))
                        continue
                else:
                    content, first = text, (doc, at)
                    if not (last or large):
                        own.append([text, first, None, []])
                if last:
                    continue
                if large:
                    split.append(row)
                    continue
                own[-1][3].append((doc, key, at, size))
                held += 1
                if held > most:
                    split += [(name, doc, key, at, size, p[0]) for p in own for doc, key, at, size in p[3]]
                    own, held, large = [], 0, True
            if split:
                yield from _renamed(kind, level + 1, split)
                split = []
            if told:
                yield _batch(list(zip(*told)), f"{PLACED}, content binary")
                told = []

    return decide


def _parted(kind: Kind, level: int, buckets: list[list[list]], told: list[tuple]) -> list[list[list]]:
    """The passages of buckets in shorter ones under the names of a further level, as buckets of different ones. What equal passages decide is told."""
    flat = [(k, x) for k, bucket in enumerate(buckets) for x in bucket]
    texts = [x[0] for _, x in flat]
    row, at, size, names, _ = kind.passages(texts, level)
    parts = kind.contents(pa.array(texts, pa.binary()), row, at, size).to_pylist()
    met: dict[tuple, dict[bytes, list]] = {}
    for r, a, n, name, content in zip(row.tolist(), at.tolist(), size.tolist(), names.tolist(), parts):
        k, (_, first, _, rows) = flat[r]
        met.setdefault((k, name), {}).setdefault(content, []).append(((first[0], first[1] + a), [(doc, key, x + a, n) for doc, key, x, _ in rows]))
    out = []
    for same in met.values():
        bucket = []
        for content, held in same.items():
            first = min(x for x, _ in held)
            own: list = []
            for x, rows in held:
                if x[0] > first[0] or kind.again and x > first:
                    told.extend((0, doc, key, a, -n, None) for doc, key, a, n in rows)
                else:
                    own += rows
            bucket.append([content, first, None, own])
        if len(bucket) > 1:
            out.append(bucket)
    return out


def _renamed(kind: Kind, level: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """The passages of rows, in shorter ones that are named by a further level."""
    for k in range(0, len(rows), 10_000):
        part = rows[k : k + 10_000]
        texts = [r[5] for r in part]
        row, at, size, names, _ = kind.passages(texts, level)
        doc, key, base = (np.array([r[j] for r in part], np.int64)[row] for j in (1, 2, 3))
        yield _batch([names ^ np.uint64(level) * _B, doc, key, base + at, size, kind.contents(pa.array(texts, pa.binary()), row, at, size)], f"{PLACED}, content binary")


def merge(row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges in order of row and start, put together where those of one row touch or overlap."""
    if not len(row):
        return row, start, stop
    wide = np.int64(1) << np.int64(32)
    reach = np.maximum.accumulate(row * wide + stop)
    opens = np.append(True, row[1:] * wide + start[1:] > reach[:-1])
    heads = np.flatnonzero(opens)
    return row[heads], start[heads], reach[np.append(heads[1:], len(row)) - 1] % wide


def apply(docs: DataFrame, spans: DataFrame, judge: Callable, columns: str) -> DataFrame:
    """For every row of docs: doc_id, and the columns that judge(text, merged spans) gives."""
    from pyspark.sql import types as T

    read = docs.select(F.col("doc_id").alias("given"), F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("binary").alias("text"))
    joined = read.join(spans, ["doc_id", "text_key"], "left").select("given", "text", F.coalesce("spans", F.array().cast("array<bigint>")).alias("spans"))
    schema = T._parse_datatype_string(f"doc_id long, {columns}")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        wanted = to_arrow_schema(schema)
        for b in batches:
            packed = b.column(2).flatten().to_numpy()
            row = np.repeat(np.arange(len(b)), b.column(2).value_lengths().to_numpy())
            order = np.lexsort((packed, row))
            row, start, stop = merge(row[order], packed[order] >> 32, packed[order] & 0xFFFFFFFF)
            bounds = np.searchsorted(row, np.arange(len(b) + 1)).tolist()
            pairs = list(zip(start.tolist(), stop.tolist()))
            rows = [judge(text or b"", pairs[i:j]) for text, i, j in zip(b.column(1).to_pylist(), bounds, bounds[1:])]
            cols = list(zip(*rows)) or [()] * (len(wanted) - 1)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, f.type) for c, f in zip(cols, list(wanted)[1:]))], names=wanted.names)

    return joined.mapInArrow(work, schema)


# what kinds have in common ------------------------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * _A
    x = x ^ (x >> np.uint64(32))
    x = x * _B
    return x ^ (x >> np.uint64(31))


class RangeHashes:
    """Hashes of any ranges of an array of hashed units, from sums of its beginnings."""

    def __init__(self, units: np.ndarray):
        n = len(units)
        powers = np.full(n + 1, _BASE, np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        self.back = np.full(n + 1, _INVERSE, np.uint64)
        self.back[0] = 1
        self.back = np.multiply.accumulate(self.back)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(units * powers[:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.back[start] + (stop - start).astype(np.uint64) * _C)


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """The least of each `size` neighbours, by doubling."""
    have = 1
    while have * 2 <= size:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    rest = size - have
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def runs(names: np.ndarray, starts: np.ndarray, whole: bool, places: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The runs of neighbouring windows of one name, as their first windows' indices and numbers of windows; of one window each
    if not whole. starts: where the windows start, in order; those that do not follow each other part runs. places: where what
    names a window stands; with them a run is named by one place, and as that is at another distance from each window, no two
    windows of a run are equal."""
    n = len(names)
    if not whole:
        return np.arange(n), np.ones(n, np.int64)
    head = np.ones(n, bool)
    head[1:] = (names[1:] != names[:-1]) | (starts[1:] != starts[:-1] + 1)
    if places is not None:
        head[1:] |= places[1:] != places[:-1]
    first = np.flatnonzero(head)
    many = np.diff(np.append(first, n))
    if len(many) and many.max() > SPAN:
        pieces = -(-many // SPAN)
        ends = np.cumsum(pieces)
        inner = (np.arange(int(ends[-1])) - np.repeat(ends - pieces, pieces)) * SPAN
        first, many = np.repeat(first, pieces) + inner, np.minimum(np.repeat(many, pieces) - inner, SPAN)
    return first, many


def first_places(values: np.ndarray, least: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each start the first index from it on whose value is least[start]."""
    ranks = np.unique(values, return_inverse=True)
    n = len(values)
    keys = np.sort(ranks[1] * n + np.arange(n))
    return keys[np.searchsorted(keys, np.searchsorted(ranks[0], least[starts]) * n + starts)] % n


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Neighbouring texts that are of `most` together, or single longer ones."""
    k = 0
    while k < len(sizes):
        j, total = k, 0
        while j < len(sizes) and (total < most or j == k):
            total, j = total + sizes[j], j + 1
        yield k, j
        k = j
