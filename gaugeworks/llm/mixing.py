"""Mix sources to target weights, with DataFrame functions alone.

The words of each source are laid end to end and cut into blocks of a fixed length. A source's target sets how many slots
it gets. Every slot is thrown at an output shard, so a shard's source counts are a multinomial draw given the totals.
Slot k takes the block whose index is a pseudorandom permutation of k within its source, and slots and blocks are joined
by index. The permutation is swap-or-not over 0..n-1 for any n, computed in each row; all pseudorandom numbers are integer
arithmetic on (seed, source number, round, index), so reruns agree.

No window holds a whole source: documents are numbered within buckets of about `BUCKET_ROWS` rows, and the buckets' sums
are added up in a table of one row per bucket.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks.llm.common import SPACES, WORD, SharedTables

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MOST_TIMES = 2
BLOCK_WORDS = 128
BUCKET_ROWS = 50_000
SLOT_RANGE = 1 << 12
SHARD_SLOTS = 1 << 13
ROUNDS = 12
PRIME = (1 << 31) - 1


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(x: str) -> str:
    """SQL for a pseudorandom number below PRIME from a non-negative integer; products stay below 2 to the power 62."""
    y = f"((({x}) % {PRIME}) * 48271 + 12345) % {PRIME}"
    z = f"(({y}) * (({y}) + 16807)) % {PRIME}"
    return f"(({z}) * 69621 + 7) % {PRIME}"


def round_keys(source_no: str, size: str, seed: int) -> Column:
    """For each round, the key that pairs indexes up and the salt of the bit that decides on a swap."""
    at = f"({source_no} * {2 * ROUNDS} + 2 * turn + {seed * 1_000_003})"
    return F.expr(
        f"transform(sequence(0L, {ROUNDS - 1}L), turn -> named_struct("
        f"'pair', ({mix(at)} * {PRIME} + {mix(f'{at} + 1')}) % {size}, 'salt', {mix(f'{at} + 7919')}))")


def permuted(index: str, size: str, keys: str) -> Column:
    """A permutation of `index` within 0..size-1, set by the keys.

    Swap-or-not: each round pairs x with key - x (mod size) and swaps the pair if a bit drawn for its larger member says so.
    Every round is a permutation, so the whole is, for any size. One aggregate over the rounds keeps the expression small;
    a chain of columns would double in size with each round once a filter is pushed through it.
    """
    pair = f"((k.pair + {size} - x) % {size})"
    top = f"greatest(x, {pair})"
    drawn = mix(f"{top} % {PRIME} + ({top} div {PRIME}) * 7919 + k.salt")
    return F.expr(f"aggregate({keys}, {index}, (x, k) -> CASE WHEN ({drawn} div 1024) % 2 = 1 THEN {pair} ELSE x END)")


def source_key(source: Column) -> Column:
    """A key that is never null; the null source sorts last and differs from every text."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("t"))


def measured(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, key, size: one row per document. `carry` names columns to keep, under a struct of their own."""
    kept = [F.struct(*(F.col(c) for c in carry)).alias("carried")] if carry else []
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("source"), source_key(F.col("source")).alias("key"),
        word_count(F.col("text")).alias("size"), *kept,
    )


def targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, most_times: int = MOST_TIMES,
    block_words: int = BLOCK_WORDS, bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """One row per source: key, source_no, source_size, target, n_blocks, n_slots, all_slots, n_buckets.

    Weights repeat over the sources by code point, null last. Sources together get `share_percent` of all words. A target
    stops at `most_times` its source's size, and the excess goes to the others by weight: sources are taken by size per
    weight, and one is capped if its share of what the earlier ones leave exceeds its cap.
    """
    by_key = W.orderBy("key")
    by_ratio = W.orderBy(F.expr("CAST(source_size AS DOUBLE) / weight"), "key")
    weight = "CASE " + " ".join(f"WHEN source_no % {len(weights)} = {i} THEN {w}" for i, w in enumerate(weights)) + " END"
    wide = "CAST({} AS DECIMAL(38, 0))".format
    per_source = (
        sizes.groupBy("key").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents"))
        # One row per source is left here, so the windows without keys are as small as the list of sources.
        .withColumn("source_no", (F.row_number().over(by_key) - 1).cast("long"))
        .withColumn("weight", F.expr(weight).cast("long"))
        .withColumn("_before", F.sum("source_size").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)))
        .withColumn("_before", F.coalesce("_before", F.lit(0)))
        .withColumn("_weights", F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("_all", F.sum("source_size").over(W.partitionBy()))
        .withColumn("_capped", F.expr(
            f"{wide(f'{100 * most_times} * source_size')} * _weights <= {wide('weight')} * ({share_percent} * _all - {100 * most_times} * _before)"))
        .withColumn("_rest", F.expr(f"{share_percent} * _all - {100 * most_times} * sum(CASE WHEN _capped THEN source_size ELSE 0 END) OVER ()"))
        .withColumn("_open", F.expr("sum(CASE WHEN _capped THEN 0 ELSE weight END) OVER ()"))
        .withColumn("target", F.expr(
            f"CASE WHEN _capped THEN CAST({most_times} * source_size AS DOUBLE) ELSE CAST(weight * _rest AS DOUBLE) / CAST(100 * _open AS DOUBLE) END"))
    )
    return (
        per_source.withColumn("n_blocks", F.expr(f"(source_size + {block_words - 1}) div {block_words}"))
        .withColumn("_passes", F.expr("CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END"))
        .withColumn("n_slots", F.expr(
            f"_passes * n_blocks + least(n_blocks, CAST(floor((target - _passes * source_size) / {block_words} + 0.5) AS BIGINT))"))
        .withColumn("n_buckets", F.expr(f"(documents + {bucket_rows - 1}) div {bucket_rows}"))
        .withColumn("all_slots", F.sum("n_slots").over(W.partitionBy()))
        .select("key", "source_no", "source_size", "target", "n_blocks", "n_slots", "all_slots", "n_buckets")
    )


def slots(per_source: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = 0) -> DataFrame:
    """One row per slot: key, slot, shard, block. Slots are made in ranges that are dealt over the tasks first."""
    ranges = (
        per_source.where("n_slots > 0")
        .select("key", "source_no", "n_blocks", "n_slots", "all_slots", F.explode(F.expr(f"sequence(0L, (n_slots - 1) div {SLOT_RANGE})")).alias("_range"))
        # With a number, as adaptive execution would merge these few rows into one task before they are exploded.
        .repartition(int(per_source.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "_range")
        .withColumn("_keys", round_keys("source_no", "n_blocks", seed))
    )
    every = ranges.select(
        "key", "source_no", "n_blocks", "all_slots", "_keys",
        F.explode(F.expr(f"sequence(_range * {SLOT_RANGE}, least(n_slots, (_range + 1) * {SLOT_RANGE}) - 1)")).alias("slot"),
    )
    thrown = mix(f"({mix(f'slot % {PRIME} + (slot div {PRIME}) * 7919')} + source_no * 65537 + {seed + 1})")
    return every.select(
        "key", "slot", permuted("slot % n_blocks", "n_blocks", "_keys").alias("block"),
        F.expr(f"({thrown}) % ((all_slots + {shard_slots - 1}) div {shard_slots})").alias("shard"),
    )


def shard_counts(drawn: DataFrame) -> DataFrame:
    """shard, key, slots: the source counts of every output shard."""
    return drawn.groupBy("shard", "key").agg(F.count(F.lit(1)).alias("slots"))


def placed(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """Add to each row where its words begin among those of its source: `first_word`."""
    bucket = F.expr(mix(f"pmod(coalesce(doc_id, 0), {PRIME})") + " % n_buckets")
    in_bucket = rows.join(per_source.select("key", "n_buckets"), "key").withColumn("bucket", bucket).drop("n_buckets")
    sums = in_bucket.groupBy("key", "bucket").agg(F.sum("size").alias("_words"))
    before = sums.select(
        "key", "bucket", (F.sum("_words").over(W.partitionBy("key").orderBy("bucket")) - F.col("_words")).alias("_before"),
    )
    upto = W.partitionBy("key", "bucket").orderBy("doc_id", "size", "row").rowsBetween(W.unboundedPreceding, 0)
    return (
        in_bucket.withColumn("_within", F.sum("size").over(upto) - F.col("size"))
        .join(before, ["key", "bucket"])
        .withColumn("first_word", F.col("_before") + F.col("_within"))
        .drop("bucket", "_before", "_within")
    )


class Mixture:
    """A mixture of `docs` (doc_id, text, source): its tables, from which the outputs below are derived.

    Null texts and texts without words take no part but keep their row; a null source is a source of its own. Repeated rows
    are rows of their own. Without any words, all targets and counts are zero; an empty table gives empty results.
    """

    def __init__(
        self, docs: DataFrame, carry: tuple[str, ...] = (), block_words: int = BLOCK_WORDS, seed: int = 0,
        weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, most_times: int = MOST_TIMES,
        bucket_rows: int = BUCKET_ROWS, shard_slots: int = SHARD_SLOTS,
    ):
        self.block_words = block_words
        self.tables = SharedTables(docs.sparkSession, "mixing")
        # Row numbers are fixed by writing them, so that later reads agree on them.
        self.rows = self.tables.write(measured(docs, carry).withColumn("row", F.monotonically_increasing_id()), "rows")
        self.per_source = self.tables.write(
            targets(self.rows.select("key", "size"), weights, share_percent, most_times, block_words, bucket_rows), "sources")
        self.slots = slots(self.per_source, shard_slots, seed)

    def used_parts(self) -> DataFrame:
        """One row per document and block it has words in (a null block if it has none): row, block, first_word, words, uses, and
        the output shards whose draw has the block (null if none)."""
        length = self.block_words
        spots = placed(self.rows.select("row", "doc_id", "key", "size"), self.per_source)
        parts = spots.select(
            "row", "key", "first_word", "size",
            F.explode_outer(F.expr(
                f"CASE WHEN size > 0 THEN sequence(first_word div {length}, (first_word + size - 1) div {length}) END")).alias("block"),
        ).withColumn("words", F.expr(
            f"coalesce(least(first_word + size, (block + 1) * {length}) - greatest(first_word, block * {length}), 0)"))
        # A block is used a few times at most, as a target stops at a multiple of its source.
        uses = self.slots.groupBy("key", F.col("block").alias("at")).agg(F.count(F.lit(1)).alias("uses"), F.collect_set("shard").alias("shards"))
        # A row for each block of the corpus, from a few rows per source that are exploded: without the hint, Spark takes it for a
        # small table and broadcasts it. Documents without words match no block, and need not meet in one task for that.
        return parts.withColumn("at", F.coalesce("block", -1 - F.col("row"))).join(uses.hint("merge"), ["key", "at"], "left").select(
            "row", "block", "first_word", "words", F.coalesce("uses", F.lit(0)).alias("uses"), "shards")

    def taken(self) -> DataFrame:
        """doc_id, source, size, source_size, target, taken, shards: one row per document.

        `shards` lists the output shards that have words of it, ascending; a document has no more of them than uses of its blocks.
        """
        numbers = F.array_sort(F.array_distinct(F.flatten(F.collect_list("shards"))))
        words = self.used_parts().groupBy("row").agg(
            F.sum(F.col("words") * F.col("uses")).alias("taken"), F.array_join(numbers.cast("array<string>"), ",").alias("shards"))
        rows = self.rows.select("row", "doc_id", "source", "key", "size")
        return rows.join(words, "row").join(self.per_source.select("key", "source_size", "target"), "key").select(
            "doc_id", "source", "size", "source_size", "target", "taken", "shards")

    def texts(self) -> DataFrame:
        """The mixed texts, with the carried columns: a row for each document and each time it is used.

        Its text then is the words of the document's blocks that are used so many times, joined by spaces.
        """
        used = self.used_parts().where("uses > 0")
        blocks = used.groupBy("row").agg(
            F.first("first_word").alias("first_word"), F.max("uses").alias("most"),
            F.array_sort(F.collect_list(F.struct("block", "words", "uses"))).alias("blocks"),
        )
        each = self.rows.join(blocks, "row").withColumn("time", F.explode(F.expr("sequence(1L, most)")))
        every_word = F.filter(F.split(F.col("carried.text"), SPACES), lambda w: w != "")
        mine = F.expr("filter(blocks, b -> b.uses >= time)")
        start = f"cast(greatest(first_word, b.block * {self.block_words}) - first_word + 1 AS INT)"
        # The words are the variable of an outer lambda, so a text is split once and not once for each of its blocks.
        used = f"array_join(flatten(transform(_mine, b -> slice(words, {start}, cast(b.words AS INT)))), ' ')"
        return (
            each.withColumn("_words", every_word)
            .withColumn("_mine", mine)
            .withColumn("text", F.expr(f"transform(array(_words), words -> {used})[0]"))
            .select("carried", "text", "time")
        )
