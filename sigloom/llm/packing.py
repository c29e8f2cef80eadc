"""Best-fit packing of token pieces into fixed sequences, improved by swaps between underfull bins.

How pieces pack depends on their lengths only, and lengths are at most the capacity, so the plan is made for the histogram of
lengths: classes of equal bins with a multiplicity. The histogram has as many numbers as the capacity, whatever the corpus. The
pieces then take the places of their length by rank, which is counted within partitions and summed over them.
"""

from __future__ import annotations

import codecs
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Distinct pre-tokens whose ids a task keeps at once; above, the half that came most often stays.
CACHE = 400_000

#: Characters that are split into pre-tokens at once; documents are longer or shorter, and each is taken whole.
BATCH = 1_000_000

#: Fixed value: how the vocabulary's tokenizer parts a text before it merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The pattern for texts of PLAIN characters only, whose letters, numbers and white space are spelt out as ranges. Contractions begin
#: with a sign that letters and numbers cannot begin with, so they may stand behind these.
PLAIN = "\\0-\u024f\u2010-\u2027\u2030-\u205e\u20a0-\u20c0"
LETTERS, NUMBERS, SPACES = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"


def _plain_pattern(letters: str, numbers: str, spaces: str) -> str:
    a, n, other = f"[{letters}]++", f"[{numbers}]++", f"[^{spaces}{letters}{numbers}]++"
    return rf" {a}|{a}| {n}|{n}|'(?:[stmd]|re|ve|ll)| {other}|{other}|[{spaces}]+(?![^{spaces}])|[{spaces}]+"


def _byte_signs() -> str:
    """How byte-level vocabularies write each byte: printable ones as themselves, the others by signs from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in plain)
    signs = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}
    return "".join(signs[b] for b in range(256))


class Encoder:
    """Ids of texts by a byte-level BPE of `tokenizers`. Texts are parted as its tokenizer parts them, and each distinct
    pre-token is merged once by its model; texts with signs on which libraries disagree are left to the tokenizer as a whole, and
    with `added` also those that hold the content of an added token, which then is that token."""

    def __init__(self, vocabulary: str, added: bool = False):
        import re

        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = not added
        self.merge, self.signs = self.tokenizer.model.tokenize, _byte_signs()
        self.any_parts = regex.compile(PATTERN).findall
        self.ascii_parts = re.compile(_plain_pattern("A-Za-z", "0-9", "\t-\r ")).findall
        self.plain_parts = re.compile(_plain_pattern(LETTERS, NUMBERS, SPACES)).findall
        self.not_plain = re.compile(f"[^{PLAIN}]").search
        self.contents = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if added else []
        self.odd = re.compile("[\x1c-\x1f\x85]").search
        self._clear()

    def _clear(self) -> None:
        #: Numbers new pre-tokens as they come.
        self.number: defaultdict[str, int] = defaultdict(count().__next__)
        self.ids = np.zeros(0, np.uint32)
        self.starts = np.zeros(1, np.int64)
        self.uses = np.zeros(0, np.int64)

    def _shed(self) -> None:
        """Keeps the pre-tokens that came most often, half of CACHE, with half their counts, so that what came of late counts more."""
        keep = np.sort(np.argsort(-self.uses, kind="stable")[: CACHE // 2])
        stays = np.zeros(len(self.uses), bool)
        stays[keep] = True
        names = [w for w, stay in zip(self.number, stays.tolist()) if stay]
        sizes = np.diff(self.starts)
        self.ids, self.uses = self.ids[np.repeat(stays, sizes)], self.uses[keep] // 2
        self.starts = np.concatenate(([0], np.cumsum(sizes[keep])))
        self.number = defaultdict(count(len(names)).__next__, zip(names, range(len(names))))

    def _parts(self, text: str) -> list[str]:
        if self.odd(text) or any(c in text for c in self.contents):
            return [f"\0whole {text}"]
        if text.isascii():
            return self.ascii_parts(text)
        return self.any_parts(text) if self.not_plain(text) else self.plain_parts(text)

    def _learn(self, parts: list[str]) -> None:
        """Merges the parts and appends what came of each."""
        # byte 255 is in no text's UTF-8, so it can stand between the parts while their bytes are written as signs
        written = codecs.charmap_decode("\udcff".join(parts).encode("utf-8", "surrogateescape"), "strict", self.signs)[0].split(self.signs[255])
        found: list[int] = []
        ends = []
        for part, signs in zip(parts, written):
            found += self.tokenizer.encode(part[7:], add_special_tokens=False).ids if part.startswith("\0whole ") else [x.id for x in self.merge(signs)]
            ends.append(len(found))
        self.ids = np.concatenate([self.ids, np.array(found, np.uint32)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.array(ends)])
        self.uses = np.concatenate([self.uses, np.zeros(len(parts), np.int64)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and where each text ends."""
        if len(self.number) > CACHE:
            self._shed()
        words, known = [self._parts(t) for t in texts], len(self.number)
        word_ends = np.cumsum([len(ws) for ws in words], dtype=np.int64)
        at = np.fromiter(map(self.number.__getitem__, chain.from_iterable(words)), np.int64, int(word_ends[-1]) if words else 0)
        if new := [*islice(reversed(self.number), len(self.number) - known)][::-1]:
            self._learn(new)
        self.uses += np.bincount(at, minlength=len(self.uses))
        sizes = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        index = np.arange(total) + np.repeat(self.starts[at] - (ends - sizes), sizes)
        return self.ids[index], np.concatenate(([0], ends))[word_ends]


def _encoder(vocabulary: str, added: bool) -> Encoder:
    """The worker process's own encoder, which keeps its pre-tokens from task to task."""
    import sys

    kept = sys.__dict__.setdefault("_sigloom_encoders", {})
    if (vocabulary, added) not in kept:
        kept[vocabulary, added] = Encoder(vocabulary, added)
    return kept[vocabulary, added]


def pieces(docs: DataFrame, vocabulary: str, end: int = 2, capacity: int = 1024, added: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the pieces of each text's ids and the end id. Only longer texts are cut; all pieces but the
    first are full. part and local number the pieces of each length within the partition that read them."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen, part = None, Counter(), TaskContext.get().partitionId()
        for b in batches:
            encoder = encoder or _encoder(vocabulary, added)
            names, texts, k = b.column(0), [t or "" for t in b.column(1).to_pylist()], 0
            while k < len(texts):
                size, j = 0, k
                while j < len(texts) and (size < BATCH or j == k):
                    size, j = size + len(texts[j]), j + 1
                ids, ends = encoder.encode(texts[k:j])
                rows: list[tuple] = []
                for i, (a, z) in enumerate(zip(np.concatenate(([0], ends[:-1])).tolist(), ends.tolist())):
                    own = np.append(ids[a:z], np.uint32(end))
                    bounds = [0, *range((len(own) - 1) % capacity + 1, len(own) + 1, capacity)]
                    for p, (s, e) in enumerate(zip(bounds, bounds[1:])):
                        rows.append((k + i, p, part, s, e - s, zlib.crc32(own[s:e].astype("<u4").tobytes()), seen[e - s]))
                        seen[e - s] += 1
                cols = list(zip(*rows))
                values = [pa.array(c, pa.int32() if i < 2 else pa.int64()) for i, c in enumerate(cols[1:])]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(cols[0])), *values], ["doc_id", "piece", "part", "start", "length", "ids_crc32", "local"])
                k = j

    return docs.select("doc_id", "text").mapInArrow(read, "doc_id long, piece int, part int, start long, length long, ids_crc32 long, local long")


def plan(counts: dict[int, int], capacity: int = 1024) -> list[tuple[tuple[int, ...], int]]:
    """Kinds of bins, as lengths in descending order and how many bins are so, that hold counts[n] pieces of each length n."""
    bins = _best_fit(counts, capacity)
    return sorted(_swaps(bins, capacity, -(-sum(n * c for n, c in counts.items()) // capacity)).items(), key=lambda x: x[0], reverse=True)


def _best_fit(counts: dict[int, int], capacity: int) -> Counter:
    """Longest first, each piece into the fullest bin that takes it; equal bins are filled together."""
    room: dict[int, Counter] = {}
    spaces: list[int] = []

    def put(kind: tuple, many: int) -> None:
        left = capacity - sum(kind)
        if left not in room:
            room[left] = Counter()
            spaces.insert(bisect_left(spaces, left), left)
        room[left][kind] += many

    for n in sorted(counts, reverse=True):
        todo = counts[n]
        while todo:
            k = bisect_left(spaces, n)
            if k == len(spaces):
                each = capacity // n
                whole, rest = divmod(todo, each)
                if whole:
                    put((n,) * each, whole)
                if rest:
                    put((n,) * rest, 1)
                break
            space = spaces[k]
            kind, many = next(iter(room[space].items()))
            each = space // n
            full = min(many, todo // each)
            taken, put_each = (full, each) if full else (1, todo)
            room[space][kind] -= taken
            if not room[space][kind]:
                del room[space][kind]
            if not room[space]:
                del room[space], spaces[k]
            put(kind + (n,) * put_each, taken)
            todo -= taken * put_each
    out: Counter = Counter()
    for kinds in room.values():
        out.update(kinds)
    return out


def _swaps(bins: Counter, capacity: int, least: int) -> Counter:
    """Moves, one-for-one and two-for-one exchanges between underfull bins, each of which fills the fuller bin further and so
    raises the sum of squared fills, until no two bins of any kinds have one or the bins are as few as the tokens allow. The
    emptiest bins give first, to the fullest first. As many equal pairs of bins as there are take a step together.

    Whether two kinds have a step depends on nothing else, so a giver that found none is asked again about kinds that came since."""
    bins, total, clock = Counter(bins), sum(bins.values()), 0
    came, asked = dict.fromkeys(bins, 0), {}
    changed = True
    while changed and total > least:
        changed, clock = False, clock + 1
        bins = Counter({k: n for k, n in bins.items() if n})
        open_ = sorted((k for k in bins if sum(k) < capacity), key=lambda k: (-sum(k), k))
        for first in reversed(open_):
            giver, since, stepped = first, asked.get(first, 0), False
            for a in open_:
                if not giver or not bins[giver] or sum(a) < sum(giver):
                    break
                if not bins[a] or a == giver and bins[a] < 2 or came[a] < since and a != giver:
                    continue
                step = _better(a, giver, capacity - sum(a)) if _meets(a, giver, capacity) else None
                if not step:
                    continue
                many = bins[a] // 2 if a == giver else min(bins[a], bins[giver])
                for kind, sign in ((a, -1), (giver, -1), (step[0], 1), (step[1], 1)):
                    if kind:
                        if not bins[kind]:
                            came[kind] = clock
                        bins[kind] += sign * many
                total -= 0 if step[1] else many
                giver, since, stepped, changed = step[1], 0, True, True
            if not stepped and bins[first]:
                asked[first] = clock
    return Counter({k: n for k, n in bins.items() if n})


@lru_cache(maxsize=20_000)
def _sums(kind: tuple) -> tuple[int, int]:
    """The single lengths and the sums of pairs of a bin, as bits."""
    one, pairs = _parts(kind)
    return sum(1 << x for x, _ in one), sum(1 << x for x in {x for x, _ in pairs})


@lru_cache(maxsize=20_000)
def _taken(kind: tuple, capacity: int) -> tuple[int, int]:
    """What a bin takes, as bits: sums that are larger than what it gives back by 1 to its space, if it gives up to two or up to one back."""
    one, two = _sums(kind)
    space, out = capacity - sum(kind), []
    for bits in (1 | one | two, 1 | one):
        bits, have = bits << 1, 1
        while have < space:
            more = min(have, space - have)
            bits, have = bits | bits << more, have + more
        out.append(bits)
    return out[0], out[1]


def _meets(a: tuple, b: tuple, capacity: int) -> bool:
    """Whether _better finds a step."""
    (one, two), (most, some) = _sums(b), _taken(a, capacity)
    return bool(one & most or two & some)


@lru_cache(maxsize=20_000)
def _parts(kind: tuple) -> tuple[list, list]:
    """The single lengths and the pairs of a bin, each as (sum, lengths) in order."""
    many = Counter(kind)
    one = sorted(many)
    pairs = sorted((x + y, (x, y)) for i, x in enumerate(one) for y in one[i:] if x != y or many[x] > 1)
    return [(x, (x,)) for x in one], pairs


def _better(a: tuple, b: tuple, space: int) -> tuple[tuple, tuple] | None:
    """a and b after the exchange that fills a the most, if one does: b gives one or two lengths, a gives none, one or two back, three in all at most."""
    best, found = 0, None
    (a1, a2), (b1, b2) = _parts(a), _parts(b)
    for gives, takes in ((b1, [(0, ())]), (b2, [(0, ())]), (b1, a1), (b2, a1), (b1, a2)):
        for y, t in takes:
            k = bisect_left(gives, (y + space + 1,)) - 1
            if k >= 0 and best < gives[k][0] - y:
                best, found = gives[k][0] - y, (gives[k][1], t)
        if best == space:
            break
    if not found:
        return None
    return _with(a, found[0], found[1]), _with(b, found[1], found[0])


def _with(kind: tuple, more: tuple, less: tuple) -> tuple:
    left = Counter(kind) + Counter(more) - Counter(less)
    return tuple(sorted(left.elements(), reverse=True))


def pack(docs: DataFrame, vocabulary: str, end: int = 2, capacity: int = 1024, added: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Ids are those of `tokenizers` for the whole text without special tokens, then `end`; a null text is empty. Special tokens
    spelt out in a text are ordinary text, or with `added` those tokens, as the library does by default. Sequences hold at most `capacity` ids, are gapless from 0, and are numbered
    from 0. Every row of docs is packed, repeated rows and null ids too. An empty table gives no rows. Columns but doc_id and
    text are not read.
    """
    cutup = cut(pieces(docs, vocabulary, end, capacity, added))
    per_part = cutup.groupBy("length", "part").agg(F.count("*").alias("many"))
    counts = {r["length"]: r["many"] for r in per_part.groupBy("length").agg(F.sum("many").alias("many")).collect()}
    before = per_part.withColumn("before", F.coalesce(F.sum("many").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("many")

    bins = plan(counts, capacity)
    rows: dict[int, list[tuple]] = {}
    first, used = 0, Counter()
    for kind, many in bins:
        offset = 0
        for n, each in sorted(Counter(kind).items(), reverse=True):
            rows.setdefault(n, []).append((used[n], each, first, offset))
            used[n] += each * many
            offset += n * each
        first += many
    tables = {n: np.array(r, np.int64) for n, r in rows.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length).tolist():
                at = np.flatnonzero(length == n)
                row = tables[n][np.searchsorted(tables[n][:, 0], rank[at], "right") - 1]
                inner = rank[at] - row[:, 0]
                sequence[at], offset[at] = row[:, 2] + inner // row[:, 1], row[:, 3] + n * (inner % row[:, 1])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in NAMES), pa.array(sequence), pa.array(offset)], [*NAMES, "sequence_id", "offset"])

    ranked = cutup.join(before, ["length", "part"]).select(*NAMES, (F.col("before") + F.col("local")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]
