"""A trie of the beginnings that conversations share.

A node is a distinct sequence of the first turns of conversations. Sequences are named by polynomial prefix fingerprints, summed
by numpy over turns in order. Conversations whose beginnings have one name and depth are candidates; each is verified turn by
turn against the group's representative, its smallest conv_id, and members that differ from it are split off. What holds for a
node's subtree is then rolled up to it.

Rollup needs no pass a level: the smallest member of a node is the smallest one of every deeper node on its own way, so each
conversation owns the nodes from one depth of its way to its end. A subtree is what its smallest member owns from there on,
and all that its other members own: one sum along owned ways, and one grouped sum over members.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Turns of one conversation that are summed together; a longer one is summed block by block. More than a branch takes over.
BLOCK = 4096

#: Ids that are written into one string on the way to a node's digest.
CHUNK = 4096

_PRIME = (1 << 31) - 1
_BASES = (1_103_515_245, 1_812_433_253)

KEY = ["depth", "name", "split"]


def turn_hash(role: Column, text: Column) -> Column:
    return F.xxhash64(role, text)


def placed(conversations: DataFrame, hashed: Callable[[Column, Column], Column] = turn_hash) -> DataFrame:
    """conv_id, place, role, text, hash, number, bytes: the turns of each conversation from place 1 on.

    They are ordered by turn, null first, then by role and text. hash and number together are equal for equal turns only:
    hashes are checked against the turns themselves, and turns that share one are numbered. Rows are dealt out by ranges, so
    that a conversation of any length is shared by tasks; what comes to the driver is one row a range.
    """
    said = conversations.filter("conv_id IS NOT NULL").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    said = said.withColumn("hash", hashed(F.col("role"), F.col("text"))).withColumn("bytes", F.octet_length("text").cast("long"))
    first = F.asc_nulls_first("turn")
    dealt = said.repartitionByRange("conv_id", first, "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", first, "role", "text")
    names = ["part", "conv_id", "role", "text", "hash", "bytes"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for b in batches:
            ids = b.column(1).to_numpy()
            if not len(ids):
                continue
            starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            n = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids)))) + 1
            if last == ids[0]:
                n[: starts[1] if len(starts) > 1 else len(ids)] += seen
            last, seen = ids[-1], int(n[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n)], [*names, "n"])

    rows = cut(dealt.withColumn("part", F.spark_partition_id()).select(*names).mapInArrow(count, "part int, conv_id long, role string, text string, hash long, bytes long, n long"))
    summary = rows.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "n")).alias("last")).collect()
    before, conv, seen = [], None, 0
    for r in sorted(summary, key=lambda r: r["part"]):
        more = seen if r["first"] == conv else 0
        if more:
            before.append((r["part"], r["first"], more))
        conv, seen = r["last"]["conv_id"], r["last"]["n"] + (more if r["last"]["conv_id"] == r["first"] else 0)
    place = F.col("n")
    if before:
        start = rows.sparkSession.createDataFrame(before, "part int, conv_id long, more long")
        rows, place = rows.join(F.broadcast(start), ["part", "conv_id"], "left"), F.col("n") + F.coalesce("more", F.lit(0).cast("long"))
    rows = rows.select("conv_id", place.alias("place"), "role", "text", "hash", "bytes")
    turns = rows.select("hash", "role", "text").distinct()
    shared = cut(turns.groupBy("hash").agg(F.count("*").alias("turns")).filter("turns > 1").select("hash"))
    if shared.isEmpty():
        return rows.withColumn("number", F.lit(0))
    numbers = turns.join(shared, "hash").withColumn("number", F.row_number().over(Window.partitionBy("hash").orderBy("role", "text")))
    return rows.join(numbers, ["hash", "role", "text"], "left").withColumn("number", F.coalesce("number", F.lit(0)))


def ways(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each conversation as it is. Its turns: conv_id, block, depth, hash, number, bytes, last, tail; and the conversations: conv_id."""
    n = turns.groupBy("conv_id").agg(F.max("place").alias("n"))
    held = _blocks(n).select("conv_id", "block", "n")
    rows = turns.withColumn("block", _block("place")).join(held, ["conv_id", "block"])
    return rows.select("conv_id", "block", F.col("place").alias("depth"), "hash", "number", "bytes", (F.col("place") == F.col("n")).alias("last"), _tail().alias("tail")), n.select("conv_id")


def branches(turns: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Each conversation c as a branch of conversation c - c % group: the first h turns of that one, then its own after its first h; h is the CRC-32 of its id modulo `most`. As ways() gives it."""
    h = lambda c: (F.crc32(c.cast("string").cast("binary")) % most).cast("long")
    n = turns.groupBy("conv_id").agg(F.max("place").alias("n"))
    convs = n.withColumn("h", h(F.col("conv_id"))).withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    bases = n.select(F.col("conv_id").alias("base"), F.col("n").alias("of_base"))
    convs = cut(convs.join(bases, "base", "left").select("conv_id", "n", "h", F.least("h", F.coalesce("of_base", F.lit(0).cast("long"))).alias("taken")))
    what = ["place", "hash", "number", "bytes"]
    own = turns.filter(F.col("place") > h(F.col("conv_id"))).select("conv_id", F.lit(True).alias("own"), *what)
    near = [F.try_add("conv_id", F.lit(k).cast("long")) for k in range(1 - group, group)]  # what leaves the range of ids is no id
    lent = turns.filter((F.col("conv_id") % group == 0) & (F.col("place") < most)).select(F.col("conv_id").alias("base"), F.explode(F.array(*near)).alias("conv_id"), F.lit(False).alias("own"), *what)
    lent = lent.filter((F.col("conv_id") - F.col("conv_id") % group == F.col("base")) & (F.col("place") <= h(F.col("conv_id")))).drop("base")
    rows = own.unionByName(lent).withColumn("block", _block("place")).join(_blocks(convs), ["conv_id", "block"])
    depth = F.when(F.col("own"), F.col("place") - F.col("h") + F.col("taken")).otherwise(F.col("place"))
    end = F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return rows.select("conv_id", "block", depth.alias("depth"), "hash", "number", "bytes", (depth == end).alias("last"), (F.col("own") & _tail()).alias("tail")), convs.select("conv_id")


def _block(place: str) -> Column:
    return F.floor(F.col(place) / BLOCK).cast("long")


def _blocks(convs: DataFrame) -> DataFrame:
    """A row for each block of each conversation."""
    return convs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), _block("n"))))


def _tail() -> Column:
    """Whether a turn is the last one of its block, in a conversation of several blocks."""
    return (F.col("n") >= BLOCK) & ((F.col("place") == F.col("n")) | ((F.col("place") + 1) % BLOCK == 0))


def _terms(depth: np.ndarray, turn: np.ndarray, base: int) -> np.ndarray:
    """turn * base ** depth, modulo the prime."""
    power, out, rest = base, turn % _PRIME, depth.copy()
    while rest.any():
        out = np.where(rest & 1, out * power % _PRIME, out)
        power, rest = power * power % _PRIME, rest >> 1
    return out


def fingerprints(rows: DataFrame) -> DataFrame:
    """conv_id, depth, name, before, hash, number, bytes, last: name is the fingerprint of the first `depth` turns, before that of one turn less."""
    names = ["conv_id", "block", "depth", "hash", "number", "bytes", "last", "tail"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, carried = None, [0, 0]
        for b in batches:
            if not b.num_rows:
                continue
            conv, block, depth, turn, number = (b.column(k).to_numpy() for k in range(5))
            starts = np.flatnonzero(np.concatenate([[True], (conv[1:] != conv[:-1]) | (block[1:] != block[:-1])]))
            sizes = np.diff(np.append(starts, len(conv)))
            mixed = (turn.view(np.uint64) + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64((1 << 61) - 1)
            sums = []
            for k, base in enumerate(_BASES):
                term = _terms(depth, (mixed ^ (mixed >> np.uint64(19 + 12 * k))).astype(np.int64), base)
                total = np.cumsum(term)
                total -= np.repeat(total[starts] - term[starts], sizes)
                if key == (conv[0], block[0]):
                    total[: sizes[0]] += carried[k]
                total %= _PRIME
                carried[k] = int(total[-1])
                sums += [total, (total - term) % _PRIME]
            key = conv[-1], block[-1]
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, sums)], [*names, "a", "a_before", "b", "b_before"])

    fields = "conv_id long, block long, depth long, hash long, number int, bytes long, last boolean, tail boolean, a long, a_before long, b long, b_before long"
    summed = cut(rows.select(*names).repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "depth").mapInArrow(scan, fields))
    # What the blocks before add: a row for each block of the conversations that have several.
    earlier = Window.partitionBy("conv_id").orderBy("block")
    ahead = summed.filter("tail").select("conv_id", (F.col("block") + 1).alias("block"), *((F.sum(x).over(earlier) % _PRIME).alias(f"{x}_ahead") for x in "ab"))
    later = summed.filter("block > 0").join(ahead, ["conv_id", "block"])
    both = summed.filter("block = 0").withColumns({f"{x}_ahead": F.lit(0).cast("long") for x in "ab"}).unionByName(later)
    name = lambda end: ((F.col(f"a{end}") + F.col("a_ahead")) % _PRIME) * (1 << 31) + (F.col(f"b{end}") + F.col("b_ahead")) % _PRIME
    return both.select("conv_id", "depth", name("").alias("name"), name("_before").alias("before"), "hash", "number", "bytes", "last")


@dataclass
class Trie:
    """nodes: depth, name, split, conv_id, before, before_split, n_convs, bytes. members: conv_id, depth, name, split, last; neither has the root. convs: conv_id."""

    nodes: DataFrame
    members: DataFrame
    convs: DataFrame


def build(rows: DataFrame, convs: DataFrame, renamed: Callable[[Column], Column] | None = None) -> Trie:
    """The verified nodes of ways. renamed changes the names (tests make them collide)."""
    named = fingerprints(rows)
    if renamed:
        named = named.withColumns({c: F.when(F.col("depth") > int(c == "before"), renamed(F.col(c))).otherwise(F.lit(0)) for c in ("name", "before")})
    members = cut(named.withColumn("split", F.lit(0)).withColumn("before_split", F.lit(0)))
    nodes = cut(_nodes(members))
    # A member that has its representative's last turn, and in its parent's group is where that one is, agrees with it in
    # every turn, once parents are verified: all groups are, where no group has two last turns or two parents.
    if not (wrong := nodes.filter("NOT alike")).isEmpty():
        members = cut(_split(members, wrong))
        nodes = cut(_nodes(members))
    return Trie(nodes, members, convs)


def _nodes(members: DataFrame) -> DataFrame:
    of = ("hash", "number", "before", "before_split")
    least, most = [F.min(c).alias(f"{c}_least") for c in of], [F.max(c).alias(f"{c}_most") for c in of]
    grouped = members.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("bytes").alias("bytes"), *least, *most)
    alike = F.lit(True)
    for c in of:
        alike &= F.col(f"{c}_least") == F.col(f"{c}_most")
    return grouped.select(*KEY, "conv_id", F.col("before_least").alias("before"), F.col("before_split_least").alias("before_split"), "n_convs", "bytes", alike.alias("alike"))


def _split(members: DataFrame, wrong: DataFrame) -> DataFrame:
    """Members with exact groups. Of conversations in a group with a collision, all members are compared turn by turn with the
    representatives of their groups; those that differ from theirs form groups of their own, round by round."""
    hit = members.join(wrong.select(*KEY), KEY).groupBy("conv_id").agg(F.min("depth").alias("since"))
    hit = cut(hit)
    rows = members.join(hit, "conv_id")
    rest, open_, done, split = members.join(hit, "conv_id", "left").filter("since IS NULL OR depth < since").drop("since"), cut(rows.filter("depth >= since").drop("since")), [], 0
    whole = cut(rows.select("conv_id", "depth", "hash", "number"))
    while not open_.isEmpty():
        heads = open_.groupBy("depth", "name").agg(F.min("conv_id").alias("head"))
        met = open_.join(heads, ["depth", "name"])
        pairs = met.filter("conv_id != head").groupBy("conv_id", "head").agg(F.max("depth").alias("deepest"))
        theirs = whole.select(F.col("conv_id").alias("head"), "depth", F.col("hash").alias("its_hash"), F.col("number").alias("its_number"))
        apart = pairs.join(whole, "conv_id").filter("depth <= deepest").join(theirs, ["head", "depth"]).filter("hash != its_hash OR number != its_number")
        apart = apart.groupBy("conv_id", "head").agg(F.min("depth").alias("apart"))
        judged = cut(met.join(apart, ["conv_id", "head"], "left").withColumn("agrees", F.coalesce(F.col("depth") < F.col("apart"), F.lit(True))))
        done.append(judged.filter("agrees").select(*members.columns).withColumn("split", F.lit(split)))
        open_, split = cut(judged.filter("NOT agrees").select(*members.columns)), split + 1
    for d in done:
        rest = rest.unionByName(d)
    rest = cut(rest.drop("before_split"))
    return rest.join(rest.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("split").alias("before_split")), ["conv_id", "depth"], "left").withColumn("before_split", F.coalesce("before_split", F.lit(0)))


def _joined_ids(ends: DataFrame) -> DataFrame:
    """depth, name, split, ends_sha256: the digest of the ids of each node's rows, ascending, joined by commas.

    Ids become strings where ranges of them lie; the digest of a node then reads one string for thousands of its ids, in order,
    and holds one at a time."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            depth, name, split, ids = (b.column(k).to_numpy() for k in range(4))
            new = np.concatenate([[True], (depth[1:] != depth[:-1]) | (name[1:] != name[:-1]) | (split[1:] != split[:-1])])
            starts = np.flatnonzero(new)
            cuts = np.unique(np.concatenate([starts, *(np.arange(s, e, CHUNK) for s, e in zip(starts, np.append(starts[1:], len(ids))) if e - s > CHUNK)]))
            text = [",".join(map(str, ids[s:e].tolist())) for s, e in zip(cuts, np.append(cuts[1:], len(ids)))]
            yield pa.RecordBatch.from_arrays([pa.array(x[cuts]) for x in (depth, name, split, ids)] + [pa.array(text)], [*KEY, "least", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None
        for b in batches:
            out = []
            for *node, ids in zip(*(b.column(k).to_pylist() for k in (0, 1, 2, 4))):
                if node == key:
                    held.update(b"," + ids.encode())
                else:
                    if held:
                        out.append((*key, held.hexdigest()))
                    key, held = node, sha256(ids.encode())
            yield _digests(out)
        if held:
            yield _digests([(*key, held.hexdigest())])

    ordered = ends.select(*KEY, "conv_id").repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    strings = ordered.mapInArrow(write, "depth long, name long, split int, least long, ids string")
    return strings.repartition(*KEY).sortWithinPartitions(*KEY, "least").mapInArrow(digest, "depth long, name long, split int, ends_sha256 string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [*KEY, "ends_sha256"])


def rolled_up(trie: Trie) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row a node, the root at depth 0."""
    zero = F.lit(0).cast("long")
    nodes = trie.nodes.drop("alike")
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("before").alias("name"), F.col("before_split").alias("split")).agg(F.count("*").alias("n_children"))
    values = nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", zero))
    values = values.withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes")).withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("block", _block("depth"))
    values = cut(values)
    # Along owned ways, from the end: inside blocks, and the blocks that follow.
    below = Window.partitionBy("conv_id").orderBy(F.desc("block"))
    later = values.filter("block > 0").groupBy("conv_id", "block").agg(F.sum("saved").alias("s"), F.sum("leaf").alias("l"))
    later = later.select("conv_id", (F.col("block") - 1).alias("block"), F.sum("s").over(below).alias("later_saved"), F.sum("l").over(below).alias("later_leaf"))
    on = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth"))
    own = values.withColumns({f"own_{c}": F.sum(c).over(on) for c in ("saved", "leaf")}).join(later, ["conv_id", "block"], "left")
    owned = values.groupBy("conv_id").agg(F.min("depth").alias("since"), F.sum("saved").alias("all_saved"), F.sum("leaf").alias("all_leaf"))
    others = trie.members.join(owned, "conv_id").filter("depth < since").groupBy(*KEY).agg(F.sum("all_saved").alias("other_saved"), F.sum("all_leaf").alias("other_leaf"))
    ends = trie.members.filter("last").select(*KEY, "conv_id")
    idle = trie.convs.join(trie.members.filter("depth = 1").select("conv_id"), "conv_id", "left_anti")
    ends = _joined_ids(ends.unionByName(idle.select(zero.alias("depth"), zero.alias("name"), F.lit(0).alias("split"), "conv_id")))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("name").alias("before"), F.col("split").alias("before_split"), F.col("conv_id").alias("parent"))

    all_ = trie.convs.agg(F.min("conv_id").alias("least"), F.count("*").alias("n")).first()
    total = values.agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"), F.sum((F.col("depth") == 1).cast("long")).alias("children")).first()
    total_of = lambda c: F.coalesce(F.col(f"own_{c}"), zero) + F.coalesce(F.col(f"later_{c}"), zero) + F.coalesce(F.col(f"other_{c}"), zero)
    inner = own.join(others, KEY, "left").join(parents, ["depth", "before", "before_split"], "left").select(
        *KEY, "conv_id", F.when(F.col("depth") == 1, F.lit(all_["least"]).cast("long")).otherwise(F.col("parent")).alias("parent_conv_id"), "n_convs", "n_children",
        total_of("leaf").alias("n_leaves"), total_of("saved").alias("saved_tokens"),
    )
    root = trie.convs.sparkSession.range(1 if all_["n"] else 0).select(
        zero.alias("depth"), zero.alias("name"), F.lit(0).alias("split"), F.lit(all_["least"]).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"),
        *(F.lit(v).cast("long").alias(k) for k, v in {"n_convs": all_["n"], "n_children": total["children"] or 0, "n_leaves": total["leaf"] or 1, "saved_tokens": total["saved"] or 0}.items()),
    )
    found = inner.unionByName(root).join(ends, KEY, "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, branched: bool = False, hashed: Callable[[Column, Column], Column] = turn_hash, renamed: Callable[[Column], Column] | None = None) -> DataFrame:
    """The nodes of the trie of conversations, as rolled_up() gives them; with the last turn of each (role, text) where they are not branched.

    Turns are ordered by turn, null first; turns of one number, repeated rows among them, by role and text. A null role or text
    is an empty one. Rows without conv_id belong to no conversation and are left out. A conversation without turns (which only
    branching makes) is a member of the root alone. Texts of any length are compared whole. An empty table has no node, not
    even a root. Columns but conv_id, turn, role and text are not read, so their names cannot clash.
    """
    turns = cut(placed(conversations, hashed))
    nodes = rolled_up(build(*(branches if branched else ways)(turns), renamed))
    if branched:
        return nodes
    last = turns.select("conv_id", F.col("place").alias("depth"), "role", "text")
    return nodes.join(last, ["conv_id", "depth"], "left")
