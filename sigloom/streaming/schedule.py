"""When sources are to be observed: a timer a source, passes of two rounds, and the worker that runs them."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .. import lexicon as L

SCHEDULE = "source_id long, event string, at timestamp, failures int, health string, due_at timestamp"

#: Minutes after which a source that was due and of which nothing was heard is due again.
STALE = 10

MINUTE = 60_000


def _millis(at: pd.Series) -> np.ndarray:
    return at.to_numpy("datetime64[ms]").astype("int64")


class _Timers(StatefulProcessor):
    """One source: how often it failed since it was last well, when it was last heard of, and its timer (milliseconds)."""

    def __init__(self, interval: int, stale: int):
        self.interval, self.stale = interval, stale

    def init(self, handle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "failures int, seen long, due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if pd.isna(key[0]):
            return  # a tick of the clock
        failures, seen, due = self.known.get() if self.known.exists() else (0, None, None)
        ok, failed, last = None, np.empty(0, "int64"), None
        for f in rows:
            at, bad = _millis(f["observed_at"]), (f["status"] == "failed").to_numpy(bool)
            if seen is not None:
                f, at, bad = f[at > seen], at[at > seen], bad[at > seen]
            if not len(at):
                continue
            if (~bad).any():
                ok = max(at[~bad].max(), ok if ok is not None else at[~bad].max())
            failed = np.union1d(failed, at[bad])
            failed = failed if ok is None else failed[failed >= ok]
            rank = pd.DataFrame({"at": at, "bad": bad, "wait": self._waits(f)}).sort_values(["at", "bad", "wait"]).iloc[-1]
            here = (int(rank["at"]), bool(rank["bad"]), tuple(rank["wait"]))
            last = here if last is None else max(last, here)
        if last is None:
            return
        failures = len(failed) + (0 if ok is not None else failures)
        at, bad, (retry, base, interval) = last
        wait = interval * MINUTE
        if bad:
            wait = max(retry, 60) * 1000 if retry >= 0 else min(1440, base * 2 ** min(max(failures - 1, 0), 10)) * MINUTE
        self._set(failures, at, due, at + wait)
        yield self._row(key, "scheduled", at, failures, at + wait)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        failures, seen, due = self.known.get()
        fired = expiredTimerInfo.getExpiryTimeInMs()
        if fired != due:
            return
        again = max(fired, timerValues.getCurrentWatermarkInMs()) + self.stale * MINUTE
        self._set(failures, seen, None, again)
        yield self._row(key, "due", fired, failures, again)

    def _waits(self, f: pd.DataFrame) -> list[tuple[int, int, int]]:
        """Of each row: the seconds that the server asked for (-1 for none), the base of the backoff and the interval, in minutes."""
        interval = pd.to_numeric(f["interval"]).fillna(self.interval).astype("int64")
        base = np.where(f["temporary"].fillna(False).astype(bool), 5, np.maximum(interval, 5))
        return list(zip(pd.to_numeric(f["retry_after"]).fillna(-1).astype("int64").tolist(), base.tolist(), interval.tolist()))

    def _set(self, failures: int, seen: int, old: int | None, due: int) -> None:
        if old is not None and old != due:
            self.handle.deleteTimer(old)
        self.handle.registerTimer(due)
        self.known.update((int(failures), int(seen), int(due)))

    def _row(self, key, event: str, at: int, failures: int, due: int) -> pd.DataFrame:
        health = "unavailable" if failures >= 3 else "retrying" if failures else "healthy"
        times = [pd.Timestamp(t, unit="ms") for t in (at, due)]
        return pd.DataFrame({"source_id": [key[0]], "event": [event], "at": [times[0]], "failures": [failures], "health": [health], "due_at": [times[1]]})


def schedule(log: DataFrame, interval: int = 60, stale: int = STALE, late: str = "0 seconds") -> DataFrame:
    """The schedule as a stream of events: `scheduled` when a source was heard of, with when it is next due; `due` when that time
    has come (`at`), with when it is due again if nothing is heard.

    log (source_id long, observed_at timestamp, status, temporary boolean, retry_after seconds, interval minutes) is a stream of
    outcomes. The clock is its watermark, so a replay gives the same events: rows of any source move it on, a clock tick is a row
    without a source_id. A failure waits as long as the server says, a minute at least, else 5 minutes (temporary) or the
    interval, doubled with each failure in a row, a day at most. Several outcomes of one source and time are one, failed if any
    is; outcomes not newer than the last one known change nothing, so rows that come twice count once. Null: status is well,
    temporary is not, retry_after is none, interval the default; rows without a time are dropped. A source's rows of one batch are reduced
    frame by frame to the times of its failures. Needs the RocksDB state store.
    """
    rows = log.filter("observed_at IS NOT NULL").select("source_id", "observed_at", "status", "temporary", "retry_after", "interval")
    marked = rows.withWatermark("observed_at", late)
    return marked.groupBy("source_id").transformWithStateInPandas(_Timers(interval, stale), SCHEDULE, "append", "EventTime")


def observation_pass(sources: DataFrame, observe: Callable[[DataFrame], tuple[DataFrame, DataFrame]], now: int, rounds: int = 2, most: int = L.DUE_SOURCES) -> list[DataFrame]:
    """One pass of the schedule. observe(due) gives what was found, and the sources that this registered, with the columns of
    `sources`; those not known before, each once, are observed in the next round, in whole, and none in a later one. The
    longest due come first, those never seen before all, at most `most` (the feature's limit on a pass); what they register has no limit."""
    due = sources.filter(F.col("next_observation_at").isNull() | (F.col("next_observation_at") <= now)).orderBy(F.asc_nulls_first("next_observation_at"), "source_id").limit(most)
    known, out = sources.select("source_id"), []
    for left in reversed(range(rounds)):
        found, registered = observe(due)
        out.append(found)
        if left:
            due = registered.select(*sources.columns).join(known, "source_id", "left_anti").dropDuplicates(["source_id"])
            known = known.unionByName(due.select("source_id"))
    return out


def idle(next_due: float | None, now: float, most: float, least: float = 2.0) -> float:
    """Seconds a worker sleeps: until something is due, at least two, at most `most`, and that if nothing is due."""
    return most if next_due is None else min(max(next_due - now, least), most)


def work(run_pass: Callable[[], None], next_due: Callable[[], float | None], stop: threading.Event, most: float = 300.0, clock: Callable[[], float] = time.time, wait: Callable[[float], object] | None = None) -> list[str]:
    """Runs passes until told to stop, sleeping until the next due time; gives the failures of passes, none of which ends it."""
    failures = []
    while not stop.is_set():
        try:
            run_pass()
        except Exception as e:  # the next pass may do what this one could not; due times are in the tables
            failures.append(f"{type(e).__name__}: {e}")
        (wait or stop.wait)(idle(next_due(), clock(), most))
    return failures
