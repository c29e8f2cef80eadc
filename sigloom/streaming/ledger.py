"""A table that micro-batches are written to exactly once, by one holder at a time."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Minutes for which a lease holds.
LEASE = 10


class LeaseLost(RuntimeError):
    """Another holder has the lease."""


class _Folder:
    """A folder of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(self.path)

    def create(self, name: str, content: str) -> bool:
        """Writes a file that is not there; False if it is."""
        try:
            out = self.fs.create(self.jvm.org.apache.hadoop.fs.Path(self.path, name), False)
        except Exception as e:
            if self.fs.exists(self.jvm.org.apache.hadoop.fs.Path(self.path, name)):
                return False
            raise e
        out.write(bytearray(content.encode()))
        out.close()
        return True

    def files(self) -> dict[str, object]:
        return {s.getPath().getName(): s for s in self.fs.listStatus(self.path)}

    def read(self, name: str) -> str:
        file = self.fs.open(self.jvm.org.apache.hadoop.fs.Path(self.path, name))
        try:
            return bytes(file.readAllBytes()).decode()
        finally:
            file.close()

    def remove(self, name: str) -> None:
        self.fs.delete(self.jvm.org.apache.hadoop.fs.Path(self.path, name), True)


class Lease:
    """Who may write now. Each taking, renewing and releasing is the next file of a row of numbered ones, made only if it is not there, so of
    two that want the same number one gets it: compare-and-swap, as strong as the file system's exclusive creation is."""

    def __init__(self, spark: SparkSession, path: str, holder: str, minutes: float = LEASE, clock: Callable[[], float] = time.time):
        self.folder, self.holder, self.minutes, self.clock = _Folder(spark, path), holder, minutes, clock

    def _last(self) -> tuple[int, str | None, float]:
        """The last number, its holder and when it expires. A file whose writer died before it wrote counts as held from its making."""
        files = {n: s for n, s in self.folder.files().items() if n.isdigit()}
        if not files:
            return 0, None, 0.0
        name = max(files)
        try:
            told = json.loads(self.folder.read(name))
        except ValueError:
            return int(name), None, files[name].getModificationTime() / 1000 + self.minutes * 60
        return int(name), told["holder"], told["expires_at"]

    def _next(self, last: int, expires_at: float) -> bool:
        if not self.folder.create(f"{last + 1:020d}", json.dumps({"holder": self.holder, "expires_at": expires_at})):
            return False
        for name in sorted(n for n in self.folder.files() if n.isdigit())[:-4]:
            self.folder.remove(name)
        return True

    def acquire(self) -> bool:
        """Takes the lease, or renews it; False while another holds it or gets it first."""
        last, holder, expires = self._last()
        if holder != self.holder and expires > self.clock():
            return False
        return self._next(last, self.clock() + self.minutes * 60)

    def held(self) -> bool:
        _, holder, expires = self._last()
        return holder == self.holder and expires > self.clock()

    def release(self) -> None:
        """Lets others have it; nothing happens if it is not held."""
        last, holder, _ = self._last()
        if holder == self.holder:
            self._next(last, self.clock())


class Ledger:
    """A table in a shared folder that holds the rows of every batch once, whoever wrote it how often.

    A batch is written to a folder of its own and counts from when its entry is made, which is made only if the batch has none; the lease
    is asked for before the rows are written and again before the entry. So a batch that is replayed leaves the first result, a
    holder that lost its lease leaves none (LeaseLost, which ends a streaming query before its checkpoint moves on), and a driver
    or executor that dies leaves rows without an entry, which nobody reads. Batches without rows have an entry too. Names of batches pass through the driver
    when the table is read, as those of any table's files do; rows do not.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, lease: Lease):
        self.spark, self.path, self.schema, self.lease = spark, path.rstrip("/"), schema, lease
        self.entries = _Folder(spark, f"{self.path}/entries")

    def entry(self, batch: int) -> str:
        return f"{int(batch):020d}"

    def write(self, rows: DataFrame, batch: int) -> bool:
        """The rows as those of the batch; False if it has some already. As step of `foreachBatch`, it makes a query exactly-once."""
        if not self.lease.acquire():
            raise LeaseLost(f"{self.lease.holder} does not hold the lease")
        if self.entry(batch) in self.entries.files():
            return False
        place = f"{self.entry(batch)}-{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(f"{self.path}/rows/{place}")
        if not self.lease.held():
            raise LeaseLost(f"{self.lease.holder} lost the lease while it wrote batch {batch}")
        return self.entries.create(self.entry(batch), place)

    def batches(self) -> list[int]:
        return sorted(int(n) for n in self.entries.files() if n.isdigit())

    def read(self) -> DataFrame:
        """The rows of all batches that have an entry. An entry whose writer died before it named its rows counts for nothing; `mend` frees its batch."""
        places = [p for n in self.entries.files() if n.isdigit() and (p := self.entries.read(n))]
        if not places:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/rows/{p}" for p in sorted(places)])

    def mend(self) -> list[str]:
        """Removes entries without rows and rows without an entry, as dead writers leave them; only the holder of the lease may."""
        if not self.lease.acquire():
            raise LeaseLost(f"{self.lease.holder} does not hold the lease")
        named = {n: self.entries.read(n) for n in self.entries.files() if n.isdigit()}
        rows = _Folder(self.spark, f"{self.path}/rows")
        dead = [p for p in rows.files() if p not in set(named.values())]
        for n in (n for n, p in named.items() if not p):
            self.entries.remove(n)
        for p in dead:
            rows.remove(p)
        return sorted(dead)

    def follow(self, batches: DataFrame, checkpoint: str, **trigger):
        """A streaming query that writes each of its batches here."""
        return batches.writeStream.foreachBatch(lambda rows, batch: self.write(rows, batch) and None).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 minute"})).start()
