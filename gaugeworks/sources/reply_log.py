"""Replies that are kept: each distinct prompt is asked once, and a run that broke off goes on where it stopped."""

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators.replies import complete

COLUMNS = "prompt_hash string, reply string"


class ReplyLog:
    """A folder of replies by the sha256 of their prompt.

    Prompts are asked in `parts` by hash. A part's replies are written below `pending` and moved to `done` by one rename, which
    commits them: a part that broke off leaves nothing there and is asked again, a finished one never. Parts that one run
    commits never share a prompt, and a later run leaves out what is done. A task that Spark repeats asks its prompts of the
    part at hand again. One run at a time may write to a log.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._jvm_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def replies(self) -> DataFrame:
        """(prompt_hash, reply) of all committed parts."""
        done = self._jvm_path(f"{self.path}/done")
        folders = [str(s.getPath()) for s in self._fs.listStatus(done)] if self._fs.exists(done) else []
        return self.spark.read.schema(COLUMNS).parquet(*folders) if folders else self.spark.createDataFrame([], COLUMNS)

    def commit(self, replies: DataFrame) -> int:
        """Write (prompt_hash, reply) as one part; returns the number of its rows. Without rows nothing is committed."""
        name = uuid.uuid4().hex
        pending = f"{self.path}/pending/{name}"
        replies.write.option("compression", "zstd").parquet(pending)
        rows = self.spark.read.schema(COLUMNS).parquet(pending).count()
        if not rows:
            self._fs.delete(self._jvm_path(pending), True)
            return 0
        self._fs.mkdirs(self._jvm_path(f"{self.path}/done"))
        if not self._fs.rename(self._jvm_path(pending), self._jvm_path(f"{self.path}/done/{name}")):
            raise RuntimeError(f"could not commit {pending}")
        return rows

    def ask(self, prompts: DataFrame, answer: Callable[[list[str]], list[str | None]], parts: int = 1) -> int:
        """Ask for the prompts (column `prompt`) that have no reply yet, equal ones once; returns how many were asked.

        Null prompts are not asked. A reply of None is kept as a reply. The prompts are written first, so that they are made
        once, however many parts there are. Hashes and places alone tell which of them are open; the prompts themselves are
        shuffled only where some of them are to be left out, and then once.
        """
        made, places = (f"{self.path}/pending/{name}-{uuid.uuid4().hex}" for name in ("prompts", "places"))
        digest = F.unhex(F.sha2("prompt", 256)).alias("digest")
        numbered = prompts.select("prompt").select(digest, "prompt", F.monotonically_increasing_id().alias("place"))
        numbered.write.option("compression", "zstd").parquet(made)
        # Nulls go on the way back: a filter here would be pushed below the prompts and make each of them a second time.
        written = self.spark.read.schema("digest binary, prompt string, place long").parquet(made).where(F.col("digest").isNotNull())
        known = self.replies().select(F.unhex("prompt_hash").alias("digest"))
        firsts = written.groupBy("digest").agg(F.min("place").alias("place")).join(known, "digest", "left_anti")
        part_of = F.pmod(F.xxhash64(F.lower(F.hex("digest"))), F.lit(parts))
        firsts.select("place", part_of.alias("part")).write.option("compression", "zstd").parquet(places)
        open_places = self.spark.read.schema("place long, part long").parquet(places)
        left, asked = open_places.count(), 0
        every = left == written.count()
        for part in range(parts if left else 0):
            own = written.where(part_of == part)
            if not every:
                own = own.join(open_places.where(F.col("part") == part), "place", "left_semi")
            asked += self.commit(complete(own.select(F.lower(F.hex("digest")).alias("prompt_hash"), "prompt"), "prompt_hash", answer))
        for path in (made, places):
            self._fs.delete(self._jvm_path(path), True)
        return asked

    def answered(self, prompts: DataFrame, *keys: str) -> DataFrame:
        """(keys, reply): the reply of each prompt, null where there is none yet. Only hashes and replies are joined."""
        narrow = prompts.select(*keys, F.sha2("prompt", 256).alias("prompt_hash"))
        return narrow.join(self.replies(), "prompt_hash", "left").select(*keys, "reply")

    def clear_pending(self) -> None:
        """Delete what runs that broke off have left behind."""
        self._fs.delete(self._jvm_path(f"{self.path}/pending"), True)
