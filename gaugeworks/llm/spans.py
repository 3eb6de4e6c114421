"""Document fingerprints from prefix polynomial hashes.

The prefix arrays of a text give the hash of any span in two subtractions and products, so span equality takes constant
time, and the longest common extension of two places is found by binary search. A fingerprint is the smallest hashes of
all spans of `SPAN` code points; the likeness of two is the share of the text they have in common.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gaugeworks.llm.common import texts

# Two prime moduli below 2^31, so that products fit 64 bits; one base for each.
MODULI = ((1 << 31) - 1, (1 << 31) - 19)
BASES = (911_382_323, 972_663_749)
SPAN = 16
KEPT = 64
DIGITS = 8


class Powers:
    """Powers of the bases and of their inverses, grown as longer texts come."""

    def __init__(self):
        self.up = [np.ones(1, dtype=np.int64) for _ in MODULI]
        self.down = [np.ones(1, dtype=np.int64) for _ in MODULI]

    def reach(self, size: int) -> None:
        for i, (modulus, base) in enumerate(zip(MODULI, BASES)):
            for table, step in ((self.up, base), (self.down, pow(base, -1, modulus))):
                while len(table[i]) < size:
                    have = table[i]
                    table[i] = np.concatenate([have, have * pow(step, len(have), modulus) % modulus])


class PrefixHashes:
    """The prefix arrays of one text."""

    def __init__(self, text: str, powers: Powers):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64) + 1
        self.size, self.powers = len(codes), powers
        powers.reach(self.size + 1)
        self.sums = []
        for modulus, up in zip(MODULI, powers.up):
            sums = np.zeros(self.size + 1, dtype=np.int64)
            # Up to 2^32 terms below 2^31 stay within 64 bits.
            np.cumsum(codes * up[: self.size] % modulus, out=sums[1:])
            self.sums.append(sums % modulus)

    def span(self, start: int, end: int) -> int:
        """The 62-bit hash of the code points from start to end, wherever they stand."""
        value = 0
        for modulus, sums, down in zip(MODULI, self.sums, self.powers.down):
            value = value << 31 | (int(sums[end]) - int(sums[start])) % modulus * int(down[start]) % modulus
        return value

    def spans(self, length: int) -> np.ndarray:
        """The hashes of all spans of a length, as unsigned 64-bit numbers."""
        count = self.size - length + 1
        value = np.zeros(max(count, 0), dtype=np.uint64)
        if count > 0:
            for modulus, sums, down in zip(MODULI, self.sums, self.powers.down):
                part = (sums[length:] - sums[:count]) % modulus * down[:count] % modulus
                value = value << np.uint64(31) | part.astype(np.uint64)
        return value

    def extension(self, start: int, other: "PrefixHashes", at: int) -> int:
        """How many code points agree from `start` here and `at` there on."""
        low, high = 0, min(self.size - start, other.size - at)
        while low < high:
            middle = (low + high + 1) // 2
            if self.span(start, start + middle) == other.span(at, at + middle):
                low = middle
            else:
                high = middle - 1
        return low


def scattered(hashes: np.ndarray) -> np.ndarray:
    mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return mixed >> np.uint64(64 - 4 * DIGITS)


def sketch(hashes: PrefixHashes, span: int = SPAN, kept: int = KEPT) -> np.ndarray:
    """The `kept` smallest distinct scattered hashes of all spans; a shorter text is one span, an empty one has none."""
    if not hashes.size:
        return np.zeros(0, dtype=np.uint64)
    values = scattered(hashes.spans(min(span, hashes.size)))
    full = 1 << (4 * DIGITS)
    below = full if len(values) <= 4 * kept else full * 4 * kept // len(values)
    while True:
        least = np.unique(values if below >= full else values[values < below])
        if len(least) >= kept or below >= full:
            return least[:kept]
        below *= 4


def written(values: np.ndarray) -> str:
    return "".join(f"{v:0{DIGITS}x}" for v in values.tolist())


def parsed(fingerprint: str) -> np.ndarray:
    return np.array([int(fingerprint[i : i + DIGITS], 16) for i in range(0, len(fingerprint), DIGITS)], dtype=np.uint64)


def likeness(left: np.ndarray, right: np.ndarray, kept: int = KEPT) -> float:
    """The share of spans in common (2 |A and B| / (|A| + |B|)), estimated from two sketches; 1 for equal ones."""
    union = np.union1d(left, right)[:kept]
    if not len(union):
        return 1.0
    both = int((np.isin(union, left, assume_unique=True) & np.isin(union, right, assume_unique=True)).sum())
    return 2 * both / (len(union) + both)


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by as much of the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """bucket, guest, place, doc_id, text: buckets of consecutive rows, each closed by a guest, the row after its last.

    Buckets are cut at approximate quantiles of the id, four to a shuffle partition; only their bounds and first ids are
    collected. The row after the last one is the first. Rows are ordered by id, then text; a null id comes first.
    """
    rows = texts(docs, id_col, text_col).withColumn("place", F.coalesce("doc_id", F.lit(-(1 << 63))))
    count = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.approxQuantile("place", [i / count for i in range(1, count)], 1 / (4 * count))
    bounds = np.unique(np.array([int(c) for c in cuts], dtype=np.int64))

    @F.pandas_udf("int")
    def bucket_of(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, place.to_numpy(dtype=np.int64), side="right").astype(np.int32))

    narrow = rows.select("place").withColumn("bucket", bucket_of("place"))
    firsts = sorted(tuple(r) for r in narrow.groupBy("bucket").agg(F.min("place")).collect())
    before = {}
    for i, (bucket, first) in enumerate(firsts):
        before[bucket] = (int(first), int(firsts[i - 1][0]))

    @F.pandas_udf("int")
    def visits(bucket: pd.Series, place: pd.Series) -> pd.Series:
        """The bucket that a row closes, or -1."""
        return pd.Series([before[b][1] if before[b][0] == p else -1 for b, p in zip(bucket.tolist(), place.tolist())], dtype="int32")

    marked = rows.withColumn("bucket", bucket_of("place")).withColumn("visits", visits("bucket", "place"))
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("guest"))
    visit = F.struct(F.col("visits").alias("bucket"), F.lit(1).alias("guest"))
    both = marked.withColumn("_at", F.explode(F.when(F.col("visits") >= 0, F.array(own, visit)).otherwise(F.array(own))))
    return both.select("_at.bucket", "_at.guest", "place", "doc_id", "text")


EDITS = (
    "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
    "same_start_edited long, same_start_next long"
)


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document, its edited text, both fingerprints and how alike they and the next document are.

    One row per input row. A null text counts as empty; empty texts are equal. A single row is followed by itself. Of rows
    with equal ids, the one with the smaller text comes first. An empty table gives an empty result. The columns
    same_start_* are the longest common extensions from the beginning. Texts move once, sorted within their buckets; a
    task holds one batch and the row that follows it.
    """
    ordered = in_order(docs, id_col, text_col)
    count = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ordered.repartition(count, "bucket").sortWithinPartitions("bucket", "guest", "place", "text")

    fields = to_arrow_schema(StructType.fromDDL(EDITS))

    def run(batches):
        powers, out = Powers(), []

        def pair(row, following):
            (doc_id, text, hashes, least), (_, after, after_hashes, after_least) = row, following
            changed = edited(text, after)
            changed_hashes = PrefixHashes(changed, powers)
            changed_least = sketch(changed_hashes)
            return (
                doc_id, len(text), changed, written(least), written(changed_least), likeness(least, changed_least),
                likeness(least, after_least), hashes.extension(0, changed_hashes, 0), hashes.extension(0, after_hashes, 0),
            )

        waiting, at = None, None
        for batch in batches:
            for bucket, guest, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "guest", "doc_id", "text"))):
                hashes = PrefixHashes(text, powers)
                row = (doc_id, text, hashes, sketch(hashes))
                if waiting is not None and at == bucket:
                    out.append(pair(waiting, row))
                # Rows that repeat the first id all come as guests; the first of them closes the bucket.
                waiting, at = (None, None) if guest else (row, bucket)
                if len(out) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), fields)], schema=fields)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), fields)], schema=fields)

    return dealt.mapInArrow(run, EDITS)
