"""Stateful stages as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HEALTH = "source_id long, failures int, health string, next_minutes double"
STATE = "item_id long, state string, at timestamp, states int"


def new_items(items: DataFrame, late: str | None = None) -> DataFrame:
    """Arriving items that were not seen just so before (`fingerprint`). With `late`, what is known is forgotten that long
    after it came; without, it is kept for good, as items are."""
    if late is None:
        return items.dropDuplicates(["fingerprint"])
    return items.withWatermark("observed_at", late).dropDuplicatesWithinWatermark(["fingerprint"])


def item_states(log: DataFrame) -> DataFrame:
    """The state of each item after every batch of transitions (item_id, state, at): the latest wins. State: the last transition and the number of distinct states."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, now, seen = state.get if state.exists else (None, None, "")
        names = set(seen.split("|")) - {""}
        for f in frames:
            for when, name in zip(f["at"], f["state"]):
                names.add(name)
                if at is None or when.value >= at:
                    at, now = when.value, name
        state.update((at, now, "|".join(sorted(names))))
        yield pd.DataFrame({"item_id": [key[0]], "state": [now], "at": [pd.Timestamp(at)], "states": [len(names)]})

    return log.groupBy("item_id").applyInPandasWithState(step, STATE, "at long, state string, seen string", "update", GroupStateTimeout.NoTimeout)


def source_health(log: DataFrame, interval: int = 60) -> DataFrame:
    """Failures in a row of each source, what they mean, and when to try again (source_id, observed_at, status). State: one counter a source."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values("observed_at", kind="stable")
        for status in rows["status"]:
            failures = failures + 1 if status == "failed" else 0
        state.update((failures,))
        health = "unavailable" if failures >= 3 else "retrying" if failures else "healthy"
        wait = min(1440.0, 5.0 * 2.0 ** min(failures - 1, 10)) if failures else float(interval)
        yield pd.DataFrame({"source_id": [key[0]], "failures": [failures], "health": [health], "next_minutes": [wait]})

    return log.groupBy("source_id").applyInPandasWithState(step, HEALTH, "failures int", "update", GroupStateTimeout.NoTimeout)


def counts_by_window(events: DataFrame, late: str = "1 day", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events in windows, final once the watermark has passed."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, late: str = "1 day", gap: str = "30 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def observe_each(batches: DataFrame, step, checkpoint: str, trigger: str = "1 minute"):
    """Runs an observation pass for every batch; one query name and checkpoint are the lease: a second run of them does not start."""
    return batches.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start()
