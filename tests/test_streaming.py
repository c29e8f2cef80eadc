"""Timers, passes, the worker, the ledger and its lease."""

import threading

import pytest
from pyspark.sql import functions as F

from sigloom.streaming import schedule as S
from sigloom.streaming.ledger import Lease, LeaseLost, Ledger

LOG = "source_id long, observed_at timestamp, status string, temporary boolean, retry_after long, interval long"
ROWS = "id long, text string"


class Clock:
    def __init__(self, now=0.0):
        self.now = now

    def __call__(self):
        return self.now


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def test_timers_follow_a_clock_of_ticks(rocks, tmp_path):
    """Each step puts a file into the stream and runs it to its end, from the checkpoint: every step is a restart too."""
    source, name = f"{tmp_path}/in", iter(range(99))
    rocks.createDataFrame([], LOG).write.parquet(source)

    def step(*rows):
        """rows: source, minute, status, temporary, retry_after, interval. Gives the events (source, event, minute, failures, health, due minute)."""
        values = [(s, m * 60, st, t, r, i) for s, m, st, t, r, i in rows]
        table = rocks.createDataFrame(values, "source_id long, s long, status string, temporary boolean, retry_after long, interval long")
        table.select("source_id", F.timestamp_seconds("s").alias("observed_at"), "status", "temporary", "retry_after", "interval").write.mode("append").parquet(source)
        out = f"{tmp_path}/out{next(name)}"
        rocks.createDataFrame([], S.SCHEDULE + ", x int").drop("x").write.parquet(out)
        write = lambda df, _: df.write.mode("append").parquet(out)
        q = S.schedule(rocks.readStream.schema(LOG).parquet(source)).writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None
        minute = lambda c: (F.unix_timestamp(c) / 60).cast("int").alias(c)
        return sorted(tuple(r) for r in rocks.read.parquet(out).select("source_id", "event", minute("at"), "failures", "health", minute("due_at")).collect())

    tick = lambda m: (None, m, None, None, None, None)
    assert step((1, 100, "ok", None, None, 30), (2, 100, "failed", True, None, 30), (3, 100, "failed", False, 7200, 30), (4, 100, None, None, None, None)) == [
        (1, "scheduled", 100, 0, "healthy", 130), (2, "scheduled", 100, 1, "retrying", 105), (3, "scheduled", 100, 1, "retrying", 220), (4, "scheduled", 100, 0, "healthy", 160)]
    assert step(tick(104)) == []
    assert step(tick(106)) == [(2, "due", 105, 1, "retrying", 116)]
    # heard of in time: the stale timer is gone; a row that comes twice, or late, counts once
    assert step((2, 107, "failed", True, None, 30), (2, 107, "failed", True, None, 30)) == [(2, "scheduled", 107, 2, "retrying", 117)]
    assert step((2, 107, "failed", True, None, 30), tick(109)) == []
    assert step((2, 110, "failed", False, None, 30)) == [(2, "scheduled", 110, 3, "unavailable", 230)]
    # source 1 comes due, nothing is heard, and it is due again
    assert step(tick(131)) == [(1, "due", 130, 0, "healthy", 141)]
    assert step(tick(142)) == [(1, "due", 141, 0, "healthy", 152)]
    # success ends a run of failures; of outcomes of one batch the newest decides
    assert step((2, 143, "failed", True, None, 30), (2, 144, "ok", None, None, 30), (2, 145, "failed", True, None, 30), (1, 143, "ok", None, None, 30)) == [
        (1, "scheduled", 143, 0, "healthy", 173), (2, "scheduled", 145, 1, "retrying", 150)]


def test_a_pass_observes_what_it_registers_in_a_second_round(spark):
    schema = "source_id long, next_observation_at long, url string"
    sources = spark.createDataFrame([(1, None, "a"), (2, 50, "b"), (3, 500, "c")], schema)
    seen = []

    def observe(due):
        rows = sorted((r["source_id"], r["url"]) for r in due.collect())
        seen.append(rows)
        new = [(s * 10, None, u + u) for s, u in rows] * 2 + [(3, 500, "c")]
        return due.select("source_id"), spark.createDataFrame(new, schema)

    found = S.observation_pass(sources, observe, 100, rounds=3)
    assert seen == [[(1, "a"), (2, "b")], [(10, "aa"), (20, "bb")], [(100, "aaaa"), (200, "bbbb")]]
    assert [f.count() for f in found] == [2, 2, 2]
    empty = S.observation_pass(sources.filter("source_id > 5"), lambda due: (due, due), 100)
    assert [f.count() for f in empty] == [0, 0]


def test_worker_sleeps_until_something_is_due():
    stop, clock, slept, due = threading.Event(), Clock(100.0), [], iter([130.0, None, 90.0, 9999.0])

    def wait(seconds):
        slept.append(seconds)
        clock.now += seconds
        if len(slept) == 4:
            stop.set()

    runs = []

    def run():
        runs.append(clock.now)
        if len(runs) == 2:
            raise ValueError("no")

    assert S.work(run, lambda: next(due), stop, 60.0, clock, wait) == ["ValueError: no"]
    assert slept == [30.0, 60.0, 2.0, 60.0] and runs == [100.0, 130.0, 190.0, 192.0]
    assert S.work(run, lambda: None, stop) == []


def test_lease_has_one_holder(spark, tmp_path):
    clock = Clock(1000.0)
    a, b, c = (Lease(spark, f"{tmp_path}/lease", n, 10, clock) for n in "abc")
    assert not a.held() and a.acquire() and a.held()
    assert not b.acquire() and not b.held()
    assert a.acquire()  # renewed
    clock.now += 601
    assert not a.held()
    last = b._last()
    assert b.acquire() and b.held() and not a.acquire()
    assert not c._next(last[0], clock.now + 600)  # it asked at the same time, and b was first
    a.release()
    assert b.held()
    b.release()
    assert not b.held() and a.acquire()
    for _ in range(9):
        assert a.acquire()
    assert len(a.folder.files()) <= 5
    a.folder.create(f"{a._last()[0] + 1:020d}", "")  # a writer that died before it wrote
    clock.now = a.folder.files()[f"{a._last()[0]:020d}"].getModificationTime() / 1000 + 1
    assert not a.acquire()
    clock.now += 601
    assert a.acquire()


def test_a_batch_is_written_once(spark, tmp_path):
    clock = Clock()
    make = lambda holder: Ledger(spark, f"{tmp_path}/t", ROWS, Lease(spark, f"{tmp_path}/lease", holder, 10, clock))
    rows = lambda *values: spark.createDataFrame(list(values), ROWS)
    shown = lambda ledger: sorted(tuple(r) for r in ledger.read().collect())
    one, two = make("one"), make("two")
    assert shown(one) == []
    assert one.write(rows((1, "a"), (1, "a"), (None, None)), 0) and one.write(rows(), 1)
    assert not one.write(rows((9, "again")), 0)  # a replay, with whatever rows
    both = [(1, "a"), (1, "a")]
    assert sorted(tuple(r) for r in one.read().filter("id IS NOT NULL").collect()) == both and one.read().count() == 3 and one.batches() == [0, 1]
    with pytest.raises(LeaseLost):
        two.write(rows((2, "b")), 2)
    clock.now += 601

    # the lease of `two` runs out while it writes, and `one` takes over the batch
    held = two.lease.held
    two.lease.held = lambda: [setattr(clock, "now", clock.now + 601), held()][1]
    with pytest.raises(LeaseLost):
        two.write(rows((2, "b")), 2)
    assert one.write(rows((3, "c")), 2) and one.read().count() == 4 and one.batches() == [0, 1, 2]
    # rows of the lost batch are found and removed, and nothing else
    assert len(one.mend()) == 1 and one.mend() == [] and one.read().count() == 4
    # an entry whose writer died before it named its rows frees its batch
    one.entries.create(one.entry(3), "")
    assert one.read().count() == 4 and one.mend() == [] and one.write(rows((4, "d")), 3) and one.read().count() == 5


def test_a_stream_that_is_run_again_writes_nothing_twice(spark, tmp_path):
    spark.createDataFrame([(i, str(i)) for i in range(20)], ROWS).repartition(4).write.parquet(f"{tmp_path}/in")
    ledger = Ledger(spark, f"{tmp_path}/t", ROWS, Lease(spark, f"{tmp_path}/lease", "a"))
    read = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for checkpoint in ("one", "one", "lost"):  # the last has no memory of what it did and replays all batches
        q = ledger.follow(read, f"{tmp_path}/{checkpoint}", availableNow=True)
        assert q.awaitTermination(120) and q.exception() is None
    assert sorted(r["id"] for r in ledger.read().collect()) == list(range(20)) and len(ledger.batches()) == 4
    other = Ledger(spark, f"{tmp_path}/t", ROWS, Lease(spark, f"{tmp_path}/lease", "b"))
    q = other.follow(read, f"{tmp_path}/other", availableNow=True)
    with pytest.raises(Exception, match="LeaseLost"):
        q.awaitTermination(120)


def test_streamed_snapshots_as_those_of_a_table(rocks, tmp_path):
    """In four batches with a restart between each, hot source included, against the operator over the whole table."""
    from sigloom.operators import observe
    from sigloom.streaming import snapshots

    pages = [["a b", "c"], ["a b", "c"], ["c", "a b", "a b"], ["c", "new words that are six long"], [], ["x", "y", "y"], ["y", "x"], ["v 1.2", "c"]]
    rows = [(1 if i % 3 else i % 5 + 2, i, i // 2 * 60, pages[i * 7 % 8]) for i in range(80)]
    schema = "source_id long, snapshot_id long, s long, lines array<string>"
    table = rocks.createDataFrame(rows, schema).select("source_id", "snapshot_id", F.timestamp_seconds("s").alias("observed_at"), "lines", F.transform("lines", F.lower).alias("blocks"), F.md5(F.array_join("lines", "|")).alias("hash"))
    rocks.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        for lot in range(4):
            some = table.filter(F.col("snapshot_id").between(lot * 20, lot * 20 + 19))
            some.union(some.limit(3)).repartition(3).orderBy(F.rand(lot)).write.mode("append").parquet(f"{tmp_path}/in")
            out = snapshots.changes(rocks.readStream.schema(table.schema).parquet(f"{tmp_path}/in"))
            write = lambda df, _: df.write.mode("append").parquet(f"{tmp_path}/out")
            q = out.writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
            assert q.awaitTermination(120) and q.exception() is None
    finally:
        rocks.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = rocks.read.parquet(f"{tmp_path}/out")
    shown = lambda df: sorted(map(str, df.select("source_id", "snapshot_id", "observed_at", "change", "added", "removed").collect()))
    assert shown(got) == shown(observe.snapshot_changes(table))
    told = lambda df: sorted(map(tuple, df.select("source_id", "snapshot_id", "novelty").collect()))
    assert told(got) == told(observe.novelty(table))
    assert {r["change"] for r in got.select("change").collect()} == {"baseline", "unchanged", "changed", "materially_changed"}
