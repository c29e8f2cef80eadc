"""Suffix arrays by linear grouping, and substring deduplication with them.

The suffixes of a text are put into groups that share a first symbol. Groups are taken in descending order; each suffix of a
group points to the nearest suffix before it whose group is smaller, and those pointed at move up within their groups, the more
pointers the higher. In the end a group holds the suffixes with one Lyndon prefix. One pass in ascending order then emits the
suffixes: each emitted one lets its predecessor, and what that points to, take the next place of their groups. No text is renamed.

Passages that share an anchor form one text. Many such texts are sorted together: each has its own groups, and every step takes
the next group of all of them at once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import Kind, RangeHashes, apply, mix, ranges, runs, slices, sliding_min

#: Bytes that windows are named by at first: few enough that passages stay long, more than chance repeats.
GRAM = 24

#: Fixed value: where the hashes of grams start, so that zero bytes do not all give zero.
SEED = np.uint64(0x9E3779B97F4A7C15)

#: Bytes that are named at once.
SLICE = 1 << 20


def suffix_array(text: list[int]) -> list[int]:
    """The starts of the suffixes of text in order; a suffix that is a prefix of another comes first."""
    if not text:
        return []
    return suffix_arrays(np.append(np.array(text, np.int64) + 1, 0), np.array([len(text) + 1]))[1:].tolist()


def suffix_arrays(symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The suffixes of several texts that stand one after the other, text by text, each text's in order. The last symbol of a
    text is smaller than all its others. Suffixes are places in symbols."""
    bases = np.cumsum(sizes) - sizes
    order = np.lexsort((symbols, np.repeat(np.arange(len(sizes)), sizes)))
    held = symbols[order]
    opens = np.ones(len(order), bool)
    opens[1:] = held[1:] != held[:-1]
    opens[bases] = True
    heads = np.flatnonzero(opens)
    counts = np.diff(np.append(heads, len(order)))
    start, place, size = np.empty_like(order), np.empty_like(order), np.zeros_like(order)
    start[order] = np.repeat(heads, counts)
    place[order] = np.arange(len(order))
    size[heads] = counts
    ends = bases + sizes - 1
    before = _form_groups(order, place, start, size, bases, ends)
    return _emit(start, before, bases, ends)


def _spread(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each of the counts, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - counts), counts)


def _form_groups(order: np.ndarray, place: np.ndarray, start: np.ndarray, size: np.ndarray, bases: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Refines the groups to Lyndon prefixes in place; what is returned is, for each suffix, the nearest one before it of a
    smaller group, or -1. Each turn takes the highest group left of every text."""
    n = len(order)
    before, jump = np.full(n, -1), np.full(n, -1)
    marked = np.zeros(n, bool)
    left_of = np.arange(n) - 1
    left_of[bases] = -1
    end = ends.copy()
    live = np.flatnonzero(end > bases)
    while len(live):
        last = end[live]
        head = start[order[last]]
        counts = last - head + 1
        single = len(counts) == int(counts.sum())
        members = order[last] if single else order[_spread(head, counts)]
        floor = head if single else np.repeat(head, counts)
        # members of the group itself are passed over too: they follow one another's pointers until all stand
        near = left_of[members]
        jump[members] = near
        todo = np.flatnonzero((near >= 0) & (start[near] >= floor))
        passed = near[todo]
        open_ = todo
        while len(open_):
            further = jump[near[open_]]
            near[open_] = further
            jump[members[open_]] = further
            open_ = open_[(further >= 0) & (start[further] >= floor[open_])]
        before[members] = near
        jump[passed] = near[todo]
        end[live] = head - 1
        if single:
            _lift(near[near >= 0], order, place, start, size)
        else:
            alone = np.repeat(counts == 1, counts) & (near >= 0)
            _lift(near[alone], order, place, start, size)
            _split(near[~np.repeat(counts == 1, counts) & (near >= 0)], order, place, start, size, marked)
        live = live[end[live] > bases[live]]
    return before


def _lift(pointed: np.ndarray, order: np.ndarray, place: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
    """Moves one suffix of each group to a group of its own at the upper end. No two are of one group."""
    head = start[pointed]
    some = size[head] > 1
    pointed, head = pointed[some], head[some]
    to = head + size[head] - 1
    other, at = order[to], place[pointed]
    order[at], place[other] = other, at
    order[to], place[pointed], start[pointed] = pointed, to, to
    size[head] -= 1
    size[to] = 1


def _split(pointers: np.ndarray, order: np.ndarray, place: np.ndarray, start: np.ndarray, size: np.ndarray, marked: np.ndarray) -> None:
    """Moves what is pointed at to groups of their own at the upper end of theirs, those with most pointers last."""
    if not len(pointers):
        return
    moved, many = np.unique(pointers, return_counts=True)
    some = size[start[moved]] > 1
    moved, many = moved[some], many[some]
    if not len(moved):
        return
    by = np.lexsort((many, start[moved]))
    moved, many = moved[by], many[by]
    head = start[moved]
    first = np.flatnonzero(np.append(True, head[1:] != head[:-1]))
    counts = np.diff(np.append(first, len(head)))
    heads = head[first]
    low = heads + size[heads] - counts
    slots = _spread(low, counts)
    marked[moved] = True
    there = order[slots]
    there = there[~marked[there]]
    at = place[moved]
    holes = at[at < np.repeat(low, counts)]
    marked[moved] = False
    order[holes], place[there] = there, holes
    order[slots], place[moved] = moved, slots
    block = np.flatnonzero(np.append(True, (head[1:] != head[:-1]) | (many[1:] != many[:-1])))
    lengths = np.diff(np.append(block, len(head)))
    size[heads] -= counts
    size[slots[block]] = lengths
    start[moved] = np.repeat(slots[block], lengths)


def _emit(start: np.ndarray, before: np.ndarray, bases: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The suffixes in order, from groups of Lyndon prefixes: a step of every text at a time."""
    n = len(start)
    out, front, placed = np.zeros(n, np.int64), np.arange(n), np.zeros(n, bool)
    out[bases], placed[ends] = ends, True
    left_of = np.arange(n) - 1
    left_of[bases] = -1
    at, stop = bases.copy(), ends + 1
    near = left_of[ends]
    while len(at):
        put = np.flatnonzero((near >= 0) & ~placed[near])
        suffix = near[put]
        head = start[suffix]
        to = front[head]
        out[to] = suffix
        front[head] = to + 1
        placed[suffix] = True
        near[put] = before[suffix]
        rest = np.ones(len(at), bool)
        rest[put] = False
        rest = np.flatnonzero(rest)
        at[rest] += 1
        on = at < stop
        if not on.all():
            at, stop, near, moved = at[on], stop[on], near[on], np.zeros(len(on), bool)
            moved[rest] = True
            rest = np.flatnonzero(moved[on])
        near[rest] = left_of[out[at[rest]]]
    return out


def grams_of(length: int, least: int) -> list[int]:
    """The lengths of the pieces that windows are named by, level by level: each level halves what is outside of them."""
    out = [min(least, length)]
    while out[-1] < length:
        out.append(length - (length - out[-1]) // 2)
    return out


def byte_kind(length: int) -> Kind:
    """Windows of `length` bytes, named by the least hash of the grams in them."""
    grams = grams_of(length, GRAM)

    def hashed(raw: bytes, n: int, gram: int) -> np.ndarray:
        """A hash of each `gram` bytes."""
        if gram < 8:
            whole = RangeHashes(mix(np.frombuffer(raw, np.uint8, n).astype(np.uint64) + SEED))
            return whole(np.arange(n - gram + 1), np.arange(gram, n + 1))
        out = np.full(n - gram + 1, SEED)
        for k in [*range(0, gram - 8, 8), gram - 8]:
            out += np.ndarray((n - gram + 1,), "<u8", raw, k, (1,))
            out *= np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(31)
        return mix(out)

    def some(texts: list[bytes], level: int) -> tuple[np.ndarray, ...]:
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        n = int(ends[-1])
        if n < length:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
        raw = b"".join(texts)
        least = sliding_min(hashed(raw, n, grams[level]), length - grams[level] + 1)
        inside = np.zeros(n + 1, np.int64)
        long_ = sizes >= length
        inside[(ends - sizes)[long_]] = 1
        inside[(ends - length + 1)[long_]] -= 1
        starts = np.flatnonzero(np.cumsum(inside)[: len(least)])
        names = least[starts]
        first, many = runs(names, starts, level < len(grams) - 1)
        start, stop = starts[first], starts[first] + many + length - 1
        codes = mix(np.arange(256, dtype=np.uint64) + SEED)[np.frombuffer(raw, np.uint8)]
        row = np.searchsorted(ends, start, "right")
        return row, start - (ends - sizes)[row], stop - start, names[first], RangeHashes(codes)(start, stop)

    def passages(texts: list[bytes], level: int) -> tuple[np.ndarray, ...]:
        parts = [(a, some(texts[a:b], level)) for a, b in slices(list(map(len, texts)), SLICE)]
        return tuple(np.concatenate([p[k] + a if k == 0 else p[k] for a, p in parts]) for k in range(5)) if parts else (np.zeros(0, np.int64),) * 5

    def contents(texts: pa.Array, row: np.ndarray, at: np.ndarray, size: np.ndarray) -> pa.Array:
        _, offsets, data = texts.buffers()
        from_ = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts)].astype(np.int64)[row] + at
        raw = np.frombuffer(data, np.uint8)[_spread(from_, size.astype(np.int64))] if len(row) else np.zeros(0, np.uint8)
        bounds = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(bounds), pa.py_buffer(raw)])

    return Kind(length, False, len(grams), passages, contents, lambda buckets: shared_windows(buckets, length))


def shared_windows(buckets: list[list[tuple]], length: int) -> list[tuple[int, int, int, int]]:
    """(bucket, passage, start, stop) of the ranges of each passage that consist of windows which also stand in a passage of its
    bucket with a smaller doc_id, by the suffix array of the bucket's passages."""
    if not buckets:
        return []
    flat = [p for own in buckets for p in own]
    many = np.array([len(own) for own in buckets])
    sizes = np.array([len(p[0]) for p in flat])
    docs = np.array([p[1] for p in flat], np.int64)
    raw = b"\0".join([p[0] for p in flat]) + bytes(length + 9)
    n = int(sizes.sum()) + len(flat)
    stops = np.cumsum(sizes + 1)  # behind the sign that ends each passage
    symbols = np.frombuffer(raw, np.uint8, n).astype(np.int16) + np.int16(2)
    symbols[stops - 1] = 1
    last = np.cumsum(many) - 1
    symbols[stops[last] - 1] = 0
    texts = np.diff(np.concatenate(([0], stops[last])))
    order = _sorted(symbols, texts)
    of = np.repeat(np.arange(len(flat)), sizes + 1)
    fits = stops[of[order]] - 1 - order >= length
    order = order[fits]
    if not len(order):
        return []
    owner = of[order]
    bucket = np.repeat(np.arange(len(buckets)), many)[owner]
    same = np.zeros(len(order), bool)
    same[1:] = bucket[1:] == bucket[:-1]
    wide = min(8, length)
    for k in [*range(0, length - wide, wide), length - wide]:
        for offset, form in [(k, "<u8")] if wide == 8 else [(k + x, "u1") for x in range(wide)]:
            values = np.ndarray((n,), form, raw, offset, (1,))
            same[1:] &= values[order[1:]] == values[order[:-1]]
    heads = np.flatnonzero(~same)
    least = np.repeat(np.minimum.reduceat(docs[owner], heads), np.diff(np.append(heads, len(order))))
    late = np.zeros(n + 1, np.int8)
    late[order] = least < docs[owner]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], late))))
    start, stop = edges[::2], edges[1::2]
    passage = of[start]
    base = (stops - sizes - 1)[passage]
    within = passage - (np.cumsum(many) - many)[np.repeat(np.arange(len(buckets)), many)[passage]]
    return list(zip(np.repeat(np.arange(len(buckets)), many)[passage].tolist(), within.tolist(), (start - base).tolist(), (stop - base + length - 1).tolist()))


def _sorted(symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """suffix_arrays, the texts in groups of about one length, so that none is sorted alone while many wait."""
    bases = np.cumsum(sizes) - sizes
    by = np.argsort(sizes, kind="stable")
    out, k = np.zeros(len(symbols), np.int64), 0
    while k < len(by):
        j = int(np.searchsorted(sizes[by], 2 * sizes[by[k]], "right"))
        mine = by[k:j]
        places = _spread(bases[mine], sizes[mine])
        out[places] = places[suffix_arrays(symbols[places], sizes[mine])]
        k = j
    return out


def remove_substrings(docs: DataFrame, length: int = 50) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are UTF-8 bytes, and a null text is empty. A byte is removed if a string of `length` bytes covers it that also starts
    in a document with a smaller doc_id, as the documents were given; strings do not cross documents. A null doc_id is larger
    than all others. Rows with one doc_id are one document: they remove nothing from each other. An empty table gives no rows.
    Columns but doc_id and text are not read.
    """
    return apply(docs, ranges(docs, byte_kind(length)), bytes_left, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def bytes_left(text: bytes, spans: list[tuple[int, int]]) -> tuple:
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return len(text), sum(b - a for a, b in spans), len(spans), hashlib.sha256(b"".join(kept)).hexdigest()
