"""Token totals by source, language and tokenizer version, kept up to date from signed changes.

A change carries its sign: +1 adds a document's count, -1 takes it back, and a revised count is one of each. Totals are
sums, so batches may arrive in any order, and a batch's rows are folded before they are written. Each batch is written
below its own id in the shared folder. A batch that is there in whole is not written again, so a re-sent one changes
nothing, and one that broke off is overwritten.

`compact` folds committed batches into a snapshot of totals. A manifest, which appears by one rename, names the snapshot and
the batches in it, and the newest manifest counts: a compaction that breaks off before leaves the totals as they were.
"""

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer")
DELTAS = "source string, lang string, tokenizer string, documents long, tokens long"


def counted(docs: DataFrame, tokenizer: str, count: Column) -> DataFrame:
    """The documents' counts under one tokenizer version: doc_id, source, lang, tokenizer, tokens. A null text has no tokens.

    Join counts, not documents, where only some are meant: the texts then stay where they are.
    """
    return docs.select("doc_id", "source", "lang", F.lit(tokenizer).alias("tokenizer"), F.coalesce(count, F.lit(0)).cast("long").alias("tokens"))


def inserts(counts: DataFrame) -> DataFrame:
    return counts.withColumn("sign", F.lit(1))


def deletes(counts: DataFrame) -> DataFrame:
    return counts.withColumn("sign", F.lit(-1))


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    return deletes(before).unionByName(inserts(after))


class Rollup:
    """The totals below `path`, a folder that all executors and later runs share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _matching(self, pattern: str) -> list[str]:
        files, where = self._files(f"{self.path}/{pattern}")
        return [s.getPath().toString() for s in files.globStatus(where) or []]

    def manifest(self) -> tuple[int, str | None, list[str]]:
        """Number of the newest manifest, its snapshot's folder and the batches in it; 0, None and none before a compaction."""
        numbers = [int(p.rsplit("-", 1)[1]) for p in self._matching("manifest-*")]
        if not numbers:
            return 0, None, []
        files, where = self._files(f"{self.path}/manifest-{max(numbers)}")
        stream = files.open(where)
        try:
            held = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return max(numbers), f"{self.path}/{held['snapshot']}", held["batches"]

    def committed(self, batch: str) -> bool:
        files, marker = self._files(f"{self.path}/batch={batch}/_SUCCESS")
        return files.exists(marker) or batch in self.manifest()[2]

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Fold signed changes into the batch's deltas. False if the batch was committed before.

        The marker is written last, after all tasks have succeeded. Two writers of the same batch write the same deltas.
        A hot key is combined in the tasks before the shuffle.
        """
        if not re.fullmatch(r"[A-Za-z0-9_-]+", batch):
            raise ValueError(f"batch ids are letters, digits, _ and -: {batch!r}")
        if self.committed(batch):
            return False
        folded = changes.groupBy(*KEYS).agg(
            F.sum("sign").cast("long").alias("documents"), F.sum(F.col("sign") * F.col("tokens")).cast("long").alias("tokens")
        )
        folded.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{self.path}/batch={batch}")
        return True

    def _waiting(self, covered: list[str]) -> list[str]:
        """Committed batches that are not among the covered ones."""
        names = {p.rsplit("/", 2)[1].removeprefix("batch=") for p in self._matching("batch=*/_SUCCESS")}
        return sorted(names - set(covered))

    def batches(self) -> list[str]:
        covered = self.manifest()[2]
        return sorted([*covered, *self._waiting(covered)])

    def _sums(self, paths: list[str]) -> DataFrame:
        deltas = self.spark.read.schema(DELTAS).parquet(*paths) if paths else self.spark.createDataFrame([], DELTAS)
        sums = deltas.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return sums.where("documents <> 0 OR tokens <> 0")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, documents, tokens over all committed batches; keys that have gone to nothing are left out.

        Reads the newest snapshot and the batches that are not in it.
        """
        _, snapshot, covered = self.manifest()
        return self._sums([*([snapshot] if snapshot else []), *[f"{self.path}/batch={b}" for b in self._waiting(covered)]])

    def write_snapshot(self) -> tuple[int, str, list[str]]:
        """Totals in a folder of their own, of which no manifest knows yet: the number and the content of a manifest for it."""
        number, snapshot, covered = self.manifest()
        waiting = self._waiting(covered)
        name = f"snapshot-{uuid.uuid4().hex}"
        paths = [*([snapshot] if snapshot else []), *[f"{self.path}/batch={b}" for b in waiting]]
        self._sums(paths).write.parquet(f"{self.path}/{name}")
        return number + 1, name, sorted([*covered, *waiting])

    def publish(self, number: int, snapshot: str, batches: list[str]) -> bool:
        """The one step that makes a snapshot count. False if another compaction was first; its manifest stays."""
        files, made = self._files(f"{self.path}/_{uuid.uuid4().hex}")
        out = files.create(made)
        out.write(bytearray(json.dumps({"snapshot": snapshot, "batches": batches}), "utf-8"))
        out.close()
        if files.rename(made, self._files(f"{self.path}/manifest-{number}")[1]):
            return True
        files.delete(made, False)
        return False

    def compact(self) -> bool:
        """Fold the batches that are not in the newest snapshot into a new one. False if there is nothing to fold.

        A batch stays committed once its folder is gone, as the manifest lists it: a line of text per batch.
        """
        _, _, covered = self.manifest()
        return bool(self._waiting(covered)) and self.publish(*self.write_snapshot())

    def drop_covered(self) -> None:
        """Delete what the newest manifest replaces; for when no older reader runs and no compaction is under way."""
        number, snapshot, covered = self.manifest()
        if snapshot is None:
            return
        old = [f"{self.path}/batch={b}" for b in covered]
        old += [p for p in self._matching("snapshot-*") if p.rsplit("/", 1)[1] != snapshot.rsplit("/", 1)[1]]
        old += [p for p in self._matching("manifest-*") if int(p.rsplit("-", 1)[1]) < number]
        for path in old:
            files, where = self._files(path)
            files.delete(where, True)
