"""Session settings, and the shared folder used to cut lineage."""

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Splits join partitions that one hot key blows up.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Call sites in error messages cost half the time it takes to build a plan.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}
PARTITION_BYTES = 128 * 1024 * 1024
_scratch: list[str] = []


def settings_for(shuffled_bytes: int) -> dict[str, str]:
    """Settings for jobs that shuffle about so many bytes: partitions of 128 MB, which adaptive execution may merge.

    Wide row-local queries shuffle only aggregates; the largest shuffles here are the joins with replies (tickets plus
    replies) and with resumes (their keywords).
    """
    return {
        "spark.sql.shuffle.partitions": str(max(200, -(-shuffled_bytes // PARTITION_BYTES))),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(PARTITION_BYTES),
        "spark.sql.files.maxPartitionBytes": str(PARTITION_BYTES),
    }


def build_session(
    app: str = "gaugeworks", master: str | None = None, shuffled_bytes: int | None = None, **conf
) -> SparkSession:
    """A session with this library's settings. `shuffled_bytes`, the largest shuffle expected, sizes its partitions."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **(settings_for(shuffled_bytes) if shuffled_bytes else {}), **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as `spark.checkpoint.dir` names it.

    Only a master that is a single process (`local` or `local[n]`) may go without that setting: its executors are the
    driver, so it gets a folder of its own, which goes when the process ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(folder)
        return folder
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="gaugeworks-")
        atexit.register(shutil.rmtree, own, True)
        spark.sparkContext.setCheckpointDir(own)
        current = spark.sparkContext.getCheckpointDir()
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder. Its owner is this process, until `clear_scratch`."""
    path = f"{shared_dir(spark).rstrip('/')}/gaugeworks/{name}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def clear_scratch(spark: SparkSession) -> None:
    """Delete all that this process has written to scratch paths, once no frame that reads it is needed any more."""
    while _scratch:
        path = spark._jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(frame: DataFrame) -> DataFrame:
    """Write an aggregated frame to the shared folder and go on from there.

    For rollups that several results are derived from: the big input is read once, and a lost executor
    costs a re-read of the small rollup instead of a re-run of the scan.
    """
    shared_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)
