"""Connected components of a large undirected graph by alternating large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import SharedTables


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    hashed = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), hashed).first())


def components(edges: DataFrame, tables: SharedTables) -> DataFrame:
    """u, v: each node of `edges` (u, v: long) but the smallest of its component, and that smallest node.

    Each round is written to the shared folder, so lineage stays short. Minima are combined in the tasks, and a hub's edges
    are a skewed side that adaptive execution splits. Rounds grow with the logarithm of the number of nodes. Loops and
    repeated edges do no harm; without edges the result is empty.
    """
    current = tables.write(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges-0")
    state, turn = _state(current), 0
    while True:
        turn += 1
        following = tables.write(_small_star(_large_star(current)), f"edges-{turn}")
        tables.drop(f"edges-{turn - 1}")
        now = _state(following)
        if now == state:
            return following
        current, state = following, now
