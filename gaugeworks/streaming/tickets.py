"""Tickets as a stream. Cleaning, SLA, risk and triage are row-local, so the batch functions take a stream as it is."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugeworks.functions.dates import from_instant, to_instant


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write new rows to parquet exactly once, stop when the input known at the start is done."""
    writer = stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
    return writer.option("checkpointLocation", checkpoint).start(path)


def breach_windows(scored: DataFrame, delay: str, window: str = "7 days", by: str = "department") -> DataFrame:
    """Tickets and breaches per window of the creation time.

    A row is counted if it is no more than `delay` behind the newest one of earlier micro-batches; state is kept as long.
    The source decides what covers its disorder, so there is no default.
    """
    # Watermarks need an instant.
    timed = scored.where(F.col(by).isNotNull()).withColumn("event_time", to_instant(F.col("created_at")))
    if timed.isStreaming:
        timed = timed.withWatermark("event_time", delay)
    counted = timed.groupBy(F.window("event_time", window).alias("w"), by).agg(
        F.count("*").alias("total_tickets"), F.count_if("sla_breached").alias("breached_tickets")
    )
    return counted.select(
        from_instant(F.col("w.start")).alias("window_start"),
        from_instant(F.col("w.end")).alias("window_end"),
        by, "total_tickets", "breached_tickets",
    )


class WindowLog:
    """The changed windows of a stream, kept as one snapshot and the batches after it.

    `batches/id=n` holds what micro-batch n changed; `snapshots/...` the state after some batch; `manifests/n` is a small file
    that names the snapshot of batch n. A manifest appears by a rename, so it is there whole or not at all, and the newest one
    counts: what broke off before it leaves the log as it was. On a store without such a rename, one compaction at a time and
    no other writer of manifests is required. `drop_covered` deletes what no reader needs any more.
    """

    def __init__(self, spark: SparkSession, path: str, by: str = "department"):
        self.spark, self.path, self.by = spark, path.rstrip("/"), by
        self._jvm_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._jvm_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._jvm_path(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def append(self, batch: DataFrame, batch_id: int) -> None:
        """Write a batch; a repeated batch overwrites its own folder."""
        batch.write.mode("overwrite").parquet(f"{self.path}/batches/id={batch_id}")

    def batches(self, after: int = -1) -> list[int]:
        """Numbers of the batches that were written to their end, in order."""
        numbers = sorted(int(name.removeprefix("id=")) for name in self._names("batches") if name.startswith("id="))
        done = lambda n: self._fs.exists(self._jvm_path(f"{self.path}/batches/id={n}/_SUCCESS"))
        return [n for n in numbers if n > after and done(n)]

    def manifest(self) -> tuple[int, str | None]:
        """The last batch that a snapshot covers, and that snapshot's folder; -1 and None without a snapshot."""
        numbers = [int(name) for name in self._names("manifests") if name.isdigit()]
        if not numbers:
            return -1, None
        stream = self._fs.open(self._jvm_path(f"{self.path}/manifests/{max(numbers)}"))
        try:
            return max(numbers), self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def latest(self) -> DataFrame:
        """The last state of each window: the snapshot and the batches after it, no others."""
        covered, snapshot = self.manifest()
        parts = [self.spark.read.parquet(snapshot).withColumn("batch_id", F.lit(covered))] if snapshot else []
        parts += [self.spark.read.parquet(f"{self.path}/batches/id={n}").withColumn("batch_id", F.lit(n)) for n in self.batches(covered)]
        if not parts:
            raise ValueError(f"no window was written to {self.path}")
        written = parts[0]
        for part in parts[1:]:
            written = written.unionByName(part)
        last = F.max_by(F.struct("total_tickets", "breached_tickets"), "batch_id").alias("last")
        return written.groupBy("window_start", "window_end", self.by).agg(last).select("window_start", "window_end", self.by, "last.*")

    def compact(self) -> int:
        """Make a snapshot of all finished batches and let a manifest name it; returns the last batch covered."""
        covered = self.manifest()[0]
        upto = max(self.batches(covered), default=covered)
        if upto > covered:
            self.publish(upto, self.write_snapshot(upto))
        return upto

    def write_snapshot(self, upto: int) -> str:
        folder = f"{self.path}/snapshots/{upto}-{uuid.uuid4().hex}"
        self.latest().write.parquet(folder)
        return folder

    def publish(self, upto: int, folder: str) -> None:
        """The one step that makes a snapshot count."""
        made, final = (self._jvm_path(f"{self.path}/manifests/{name}") for name in (f"_{uuid.uuid4().hex}", str(upto)))
        out = self._fs.create(made)
        out.write(bytearray(folder, "utf-8"))
        out.close()
        if not self._fs.rename(made, final):
            self._fs.delete(made, False)  # another compaction has covered the same batches

    def drop_covered(self) -> None:
        """Delete batches, snapshots and manifests that the newest manifest replaces; for when no older reader runs."""
        covered, snapshot = self.manifest()
        if snapshot is None:
            return
        gone = [f"batches/{n}" for n in self._names("batches") if n.startswith("id=") and int(n.removeprefix("id=")) <= covered]
        gone += [f"snapshots/{n}" for n in self._names("snapshots") if not snapshot.endswith(f"/{n}") and int(n.split("-")[0]) <= covered]
        gone += [f"manifests/{n}" for n in self._names("manifests") if n.isdigit() and int(n) < covered]
        for name in gone:
            self._fs.delete(self._jvm_path(f"{self.path}/{name}"), True)


def upsert_to(windows: DataFrame, path: str, checkpoint: str, compact_every: int | None = None, by: str = "department") -> StreamingQuery:
    """Write changed windows to a `WindowLog`, which is compacted after each `compact_every` micro-batches, if given."""
    log = WindowLog(windows.sparkSession, path, by)

    def write(batch: DataFrame, batch_id: int) -> None:
        log.append(batch, batch_id)
        if compact_every and (batch_id + 1) % compact_every == 0:
            log.compact()

    writer = windows.writeStream.outputMode("update").trigger(availableNow=True).foreachBatch(write)
    return writer.option("checkpointLocation", checkpoint).start()


def latest_windows(spark: SparkSession, path: str, by: str = "department") -> DataFrame:
    """The last state of each window that `upsert_to` wrote."""
    return WindowLog(spark, path, by).latest()
