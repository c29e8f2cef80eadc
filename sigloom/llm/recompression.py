"""Substring deduplication over words by recompression.

Words are named by hash. A first round names runs of one word; each further round parts all names into left and right ones by a
bit of their hash and names every pair of a left and a right neighbour. A name depends on what it stands for only, so equal
passages consist of the same symbols everywhere but for a few at their ends. Which symbols of a window those are follows from
the window itself. Rounds go on until no window is sure of a symbol; of the last round in which a window was sure of some, the
symbol with the least hash names the window. Names meet over the whole corpus, and the words of windows with one name are compared.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import Kind, RangeHashes, apply, first_places, mix, ranges, runs, slices, sliding_min
from .suffix_array import grams_of

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))

#: Bytes of texts that are named at once.
SLICE = 1 << 21


def _argmin_between(values: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each [left, right) the index of the least value, the first of equals."""
    tables = [np.arange(len(values))]
    size = right - left
    while 2 << (len(tables) - 1) <= int(size.max(initial=1)):
        have, step = tables[-1], 1 << (len(tables) - 1)
        a, b = have[:-step], have[step:]
        tables.append(np.where(values[b] < values[a], b, a))
    level = np.frexp(size)[1] - 1
    out = np.zeros(len(left), np.int64)
    for k, have in enumerate(tables):
        at = np.flatnonzero(level == k)
        a, b = have[left[at]], have[right[at] - (1 << k)]
        out[at] = np.where(values[b] < values[a], b, a)
    return out


def window_names(words: np.ndarray, opens: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The name of every window of `length` words that starts at starts, and where it stands: the symbol that recompression
    gives it at last, the first of equal ones. words: hashes of all words; opens: which of them begin a text."""
    n = len(words)
    named, places = np.zeros(len(starts), np.uint64), starts.copy()
    # runs; the first and the last one that a window has may go on outside it
    head = opens.copy()
    head[1:] |= words[1:] != words[:-1]
    at = np.flatnonzero(head)
    parent = np.cumsum(head) - 1
    size = np.diff(np.append(at, n))
    names = np.where(size > 1, mix(words[at] * _C + size.astype(np.uint64)), words[at])
    first = np.append(opens[at], True)
    live = np.arange(len(starts))
    left, right = parent[starts] + 1, parent[starts + length - 1]
    sure = left < right
    bare = live[~sure]  # one or two runs: the window is its own name
    if len(bare):
        named[bare] = RangeHashes(words)(starts[bare], starts[bare] + length)
    live, left, right = live[sure], left[sure], right[sure]
    turn = 0
    while len(live):
        m = len(names)
        second = (mix(names + np.uint64(turn)) >> np.uint64(17)) & np.uint64(1) == 1
        pair = np.zeros(m, bool)
        pair[:-1] = ~second[:-1] & second[1:] & ~first[1:m]
        head = np.ones(m, bool)
        head[1:] = ~pair[:-1]
        parent = np.cumsum(head) - 1
        # a right name at a window's start may pair with what stands before it, a left name at its end with what follows
        a = left + second[left]
        b = right - ~second[right - 1]
        sure = a < b
        gone = ~sure
        if gone.any():
            chosen = _argmin_between(mix(names), left[gone], right[gone])
            named[live[gone]], places[live[gone]] = names[chosen], at[chosen]
        live, left, right = live[sure], parent[a[sure]], parent[b[sure] - 1] + 1
        following = np.append(names[1:], np.uint64(0))
        names, at = np.where(pair, mix(names * _A + following * _B + _C), names)[head], at[head]
        first = np.append(first[:m][head], True)
        turn += 1
        if turn >= 64 and len(live):  # a few symbols that never form a pair
            chosen = _argmin_between(mix(names), left, right)
            named[live], places[live] = names[chosen], at[chosen]
            break
    return named, places


def word_kind(length: int) -> Kind:
    """Windows of `length` words. Level 0 names them by recompression, further levels by the least hash of longer grams of words."""
    grams = [0, *grams_of(length, -(-length // 2))]

    def some(texts: list[bytes], level: int) -> tuple[np.ndarray, ...]:
        from xxhash import xxh64_intdigest

        parted = [t.split() for t in texts]
        counts = np.fromiter(map(len, parted), np.int64, len(parted))
        ends, n = np.cumsum(counts), int(counts.sum())
        row_of = np.repeat(np.arange(len(parted)), counts)
        starts = np.flatnonzero(ends[row_of] - np.arange(n) >= length)
        if not len(starts):
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
        known: dict[bytes, int] = {}
        for t in parted:
            for w in t:
                if w not in known:
                    known[w] = xxh64_intdigest(w)
        words = mix(np.fromiter((known[w] for t in parted for w in t), np.uint64, n))
        whole = RangeHashes(words)
        if level == 0:
            opens = np.zeros(n, bool)
            opens[(ends - counts)[counts > 0]] = True
            names, places = window_names(words, opens, starts, length)
        else:
            gram = grams[level]
            values = whole(np.arange(n - gram + 1), np.arange(gram, n + 1))
            least = sliding_min(values, length - gram + 1)
            names, places = least[starts], first_places(values, least, starts)
        first, many = runs(names, starts, level < len(grams) - 1, places)
        start, stop = starts[first], starts[first] + many + length - 1
        row = row_of[start]
        return row, start - (ends - counts)[row], stop - start, names[first], whole(start, stop)

    def passages(texts: list[bytes], level: int) -> tuple[np.ndarray, ...]:
        parts = [(a, some(texts[a:b], level)) for a, b in slices(list(map(len, texts)), SLICE)]
        return tuple(np.concatenate([p[k] + a if k == 0 else p[k] for a, p in parts]) for k in range(5)) if parts else (np.zeros(0, np.int64),) * 5

    def contents(texts: pa.Array, row: np.ndarray, at: np.ndarray, size: np.ndarray) -> pa.Array:
        out, parted, of = [], [], -1
        for r, a, n in zip(row.tolist(), at.tolist(), size.tolist()):
            if r != of:
                parted, of = texts[r].as_py().split(), r
            out.append(b" ".join(parted[a : a + n]))
        return pa.array(out, pa.binary())

    return Kind(length, True, len(grams), passages, contents, lambda buckets: _earlier_windows(buckets, length))


def _earlier_windows(buckets: list[list[tuple]], length: int) -> list[tuple[int, int, int, int]]:
    """(bucket, passage, start, stop) of the ranges of each passage that consist of windows whose words stand earlier in its bucket."""
    out = []
    for k, bucket in enumerate(buckets):
        first: dict[bytes, tuple] = {}
        held = []
        for content, doc, at in bucket:
            words = content.split(b" ")
            own = [b" ".join(words[j : j + length]) for j in range(len(words) - length + 1)]
            held.append(own)
            for j, window in enumerate(own):
                if (doc, at + j) < first.setdefault(window, (doc, at + j)):
                    first[window] = (doc, at + j)
        for p, ((_, doc, at), own) in enumerate(zip(bucket, held)):
            start = None
            for j, window in enumerate([*own, None]):
                late = window is not None and first[window] < (doc, at + j)
                if late and start is None:
                    start = j
                elif not late and start is not None:
                    out.append((k, p, start, j + length - 1))
                    start = None
    return out


def remove_passages(docs: DataFrame, length: int = 20) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256.

    Words are what white space parts, unchanged; a null text has none. A word is removed if a window of `length` words of its
    document covers it whose words also start earlier: in a document with a smaller doc_id, or before it in the same one, as the
    documents were given. Kept words are joined by single spaces for the digest. A null doc_id is larger than all others. Rows
    with one doc_id are one document; an equal window at the same place of both is not earlier. An empty table gives no rows.
    Columns but doc_id and text are not read.
    """
    return apply(docs, ranges(docs, word_kind(length)), words_left, "n_words long, n_removed long, kept_sha256 string")


def words_left(text: bytes, spans: list[tuple[int, int]]) -> tuple:
    words, kept, at = text.split(), [], 0
    for a, b in spans:
        kept += words[at:a]
        at = b
    kept += words[at:]
    return len(words), sum(b - a for a, b in spans), hashlib.sha256(b" ".join(kept)).hexdigest()
