"""Snapshots of pages compared as they come, with the last one of each source in state."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import zip_longest

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from .. import lexicon as L

CHANGES = "source_id long, snapshot_id long, observed_at timestamp, change string, novelty string, added array<string>, removed array<string>"
LAST = "first long, at long, snapshot_id long, hash string, blocks array<string>"
ROW = "hash string, lines array<string>, blocks array<string>"
SPACE = re.compile(r"[ \t\n\x0b\f\r]+")


class _Compared(StatefulProcessor):
    """One source: when it was first seen, and its last snapshot; snapshots of a batch that wait for their turn."""

    def __init__(self, material: int):
        self.material = material

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", LAST)
        self.waiting = handle.getMapState("waiting", "at long, snapshot_id long", ROW)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.last.get() if self.last.exists() else (None, None, None, None, None)
        first, seen = known[0], (known[1], known[2])
        before_hash, before = known[3], list(known[4]) if known[4] is not None else None
        places = set()
        for f in rows:
            at = f["observed_at"].to_numpy("datetime64[us]").astype("int64").tolist()
            for place, h, lines, blocks in zip(zip(at, f["snapshot_id"].tolist()), f["hash"], f["lines"], f["blocks"]):
                if (seen[0] is None or place > seen) and place not in places:
                    places.add(place)
                    self.waiting.updateValue(place, (h, _list(lines), _list(blocks)))
        for place in sorted(places):
            h, lines, blocks = self.waiting.getValue(place)
            self.waiting.removeKey(place)
            lines, blocks = _list(lines), _list(blocks)
            first = place[0] if first is None else first
            change, added, removed = self.compared(before_hash, before, h, lines, blocks)
            before_hash, before, seen = h, blocks, place
            yield pd.DataFrame({"source_id": [key[0]], "snapshot_id": [place[1]], "observed_at": [pd.Timestamp(place[0], unit="us")], "change": [change], "novelty": ["baseline" if place[0] == first else "fresh"], "added": [added], "removed": [removed]})
        if places:
            self.last.update((first, seen[0], seen[1], before_hash, before))

    def compared(self, before_hash, before, now_hash, lines: list, blocks: list) -> tuple[str, list, list]:
        if before_hash is None:
            return "baseline", [], []
        if before_hash == now_hash:
            return "unchanged", [], []
        old, new = set(before), set(blocks)
        added = [line for line, block in zip_longest(lines, blocks) if block is not None and block not in old]
        removed = [block for block in before if block not in new]
        words = sum(1 for text in added + removed for w in SPACE.split(text or "") if w)
        versioned = any("." in w and re.search("[0-9]", w) for text in added for w in SPACE.split(text or ""))
        return ("materially_changed" if words >= self.material or versioned else "changed"), added, removed


def _list(values) -> list:
    return [] if values is None else list(values)


def changes(snapshots: DataFrame, material: int = L.MATERIAL_WORDS) -> DataFrame:
    """Every snapshot of a stream beside the one before it, as `observe.snapshot_changes` gives them for a table, and whether it is of
    the first pass over its source (`novelty`), which is baseline and never news.

    snapshots (source_id long, snapshot_id long, observed_at timestamp, hash, lines and blocks: arrays of strings). State is the last
    snapshot of each source. Snapshots of one batch are put in order of time and id, whatever frames they come in; in memory
    are their places only, they themselves wait in the state store, so a source with many at once needs no more memory. One that is not newer than the last compared, or comes twice,
    changes nothing, so replays are harmless. Rows without a source, id or time are dropped, null lists are empty, a null hash is unlike any. Needs
    the RocksDB state store.
    """
    rows = snapshots.filter("source_id IS NOT NULL AND snapshot_id IS NOT NULL AND observed_at IS NOT NULL").select("source_id", "snapshot_id", "observed_at", "hash", "lines", "blocks")
    return rows.groupBy("source_id").transformWithStateInPandas(_Compared(material), CHANGES, "append", "None")
