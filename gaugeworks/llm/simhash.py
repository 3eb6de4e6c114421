"""SimHash near-dedup with bit-sliced comparison.

Candidates: the 64 bits are cut into bands, and fingerprints are bucketed by every choice of `AGREE` bands. With a radius
of 4 and 6 bands at least 2 bands of a linked pair agree, so no link is lost. Buckets hold distinct fingerprints only.

Comparison: a task lays the fingerprints of its buckets out as 64 bit planes, one bit per fingerprint. The planes are
compared with themselves shifted by a lag, which gives the difference planes of all pairs at that lag at once; these are
added into bitwise counters with carry-save adders. A block of lanes is abandoned as soon as all its distances exceed the
radius. Pairs within a bucket are never emitted: each bucket returns a star per component, at most one edge a row.

`keep` asks for more than the query: all texts whose sets of five-word shingles have a Jaccard likeness of 0.8 or more. Two
such sets share one of the first hashes (a fifth of each set) in any one order, so these hashes are the keys; hashes that many texts
have come last, so that a common passage is not what texts meet by. Keys that one text alone has go no further. Fingerprints of 256 bits, compared by the same bit planes, tell which texts with a common key are candidates, and
the exact likeness decides on a link (see `likeness`).
"""

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.arrays import among, mixed
from gaugeworks.llm.common import SharedTables, map_batches, texts
from gaugeworks.llm.components import components
from gaugeworks.llm.likeness import Likeness, Method

SHINGLE = 4
SEED = 42
RADIUS = 4
BANDS, AGREE = 6, 2
UNIT_ROWS = 8192
BLOCK_WORDS = 64
# What `keep` asks for: a likeness of at least LEAST[0] / LEAST[1]. At a likeness of 0.8 fingerprints of 256 bits differ in 39
# bits on average with a standard deviation of 5.7, so the radius is 4.4 deviations away; unrelated ones differ in 128.
LEAST = (4, 5)
WIDE, WIDE_RADIUS = 256, 64
# Lags are compared several at a time while few lanes are left.
LAG_LANES = 1 << 12


def hashes_of(text: str, words: int) -> np.ndarray:
    """A hash of each shingle, in order; a text of fewer words has a single one, a text without words none."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z alone, and ASCII white space alone
    if not parts:
        return np.zeros(0, dtype="<u8")
    line = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    size = min(words, len(parts))
    stops = (ends[size - 1 :] - 1).tolist()
    starts = [0, *ends.tolist()][: len(stops)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[s:e], SEED) for s, e in zip(starts, stops)], dtype="<u8")


def fingerprint(text: str, words: int = SHINGLE) -> int:
    """64 bits as an unsigned number; zero without words."""
    return majority(hashes_of(text, words))


def majority(hashes: np.ndarray) -> int:
    """Each bit as in more than half of the hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        counts += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, bits: the fingerprint as a signed long. Null texts count as empty and have fingerprint zero."""
    return map_batches(
        texts(docs, id_col, text_col), lambda ids, bodies: (ids, [signed(fingerprint(b)) for b in bodies]), "doc_id long, bits long"
    )


def band_masks(bands: int = BANDS) -> list[int]:
    edges = [64 * i // bands for i in range(bands + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]


def buckets(distinct: DataFrame, bands: int = BANDS, agree: int = AGREE) -> DataFrame:
    """choice, key, bits: each fingerprint once for every choice of bands, with the bits of those bands as the key."""
    masks = [sum(c) for c in combinations(band_masks(bands), agree)]
    keys = [F.struct(F.lit(i).alias("choice"), F.col("bits").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(masks)]
    return distinct.select("bits", F.explode(F.array(*keys)).alias("_b")).select("_b.choice", "_b.key", "bits")


def planes(values: np.ndarray) -> np.ndarray:
    """64 rows of packed bits: row j holds bit j of all values. Values of several words give 64 rows for each word."""
    if values.ndim > 1:
        return np.concatenate([planes(np.ascontiguousarray(column)) for column in values.T])
    lanes = -(-len(values) // 64) * 64
    padded = np.zeros(lanes, dtype="<u8")
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def shifted(sliced: np.ndarray, lag: int) -> np.ndarray:
    """The planes with lane i holding what was in lane i + lag."""
    words, bits = divmod(lag, 64)
    out = np.zeros_like(sliced)
    size = sliced.shape[1] - words
    if size > 0:
        out[:, :size] = sliced[:, words:] >> np.uint64(bits)
        if bits:
            out[:, : size - 1] |= sliced[:, words + 1 :] << np.uint64(64 - bits)
    return out


def within(left: np.ndarray, right: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Packed lanes whose values differ in at most `radius` bits.

    Difference planes go in groups of three through a full adder, its sum and carry into the counter bits ones, twos, fours
    and as many more as the radius needs; a carry beyond the last marks the lane as over. Blocks of lanes that are all over
    take no part in later planes.
    """
    width = left.shape[1]
    counters = [np.zeros(width, dtype="<u8") for _ in range(max(3, radius.bit_length()))]
    (ones, twos), over = counters[:2], np.zeros(width, dtype="<u8")
    live = np.arange(width)
    every = np.uint64(0xFFFFFFFFFFFFFFFF)
    for at in range(0, len(left), 3):
        group = [left[j][live] ^ right[j][live] for j in range(at, min(at + 3, len(left)))]
        group += [np.zeros(len(live), dtype="<u8")] * (3 - len(group))
        a, b, c = group
        low, high = a ^ b ^ c, (a & b) | (c & (a ^ b))
        carry = ones[live] & low
        ones[live] ^= low
        first = twos[live]
        add = first ^ high ^ carry
        second = (first & high) | (carry & (first ^ high))
        twos[live] = add
        for plane in counters[2:]:
            held = plane[live]
            plane[live] = held ^ second
            second = held & second
        over[live] |= second
        if at % 12 == 9:
            exceeded = over[live] | above([c[live] for c in counters], radius)
            blocks = -(-len(live) // BLOCK_WORDS)
            full = np.full(blocks * BLOCK_WORDS, every, dtype="<u8")
            full[: len(live)] = exceeded
            stay = ~(full.reshape(blocks, BLOCK_WORDS) == every).all(axis=1)
            if not stay.all():
                gone = ~np.repeat(stay, BLOCK_WORDS)[: len(live)]
                over[live[gone]] = every
                live = live[~gone]
                if not len(live):
                    break
    return ~(over | above(counters, radius))


def above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Packed lanes whose counter (planes from the lowest bit on) is greater than the radius."""
    greater, equal = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for bit, plane in reversed(list(enumerate(counters))):
        if radius >> bit & 1:
            equal = equal & plane
        else:
            greater, equal = greater | (equal & plane), equal & ~plane
    return greater


def linked(values: np.ndarray, groups: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Stars that connect what lies within the radius inside each group: values, and the smallest index's value."""
    leaf, root = stars(values, groups, radius)
    return values[leaf], values[root]


def stars(values: np.ndarray, groups: np.ndarray, radius: int, sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """`linked` as places in `values`.

    `groups` is sorted. Larger groups come first, so that the lanes still to be compared at a lag are a prefix. It ends
    early when each group is one component. With `sizes` of sets, ascending in each group, pairs too different in size for
    LEAST do not count, and it ends when only such are left.
    """
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    counts = np.diff(np.r_[starts, len(groups)])
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] > 1]
    if not len(order):
        return order, order
    counts, starts = counts[order], starts[order]
    index = np.repeat(starts - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
    chosen, number = values[index], np.repeat(np.arange(len(counts)), counts)
    own = None if sizes is None else sizes[index]
    root = np.arange(len(chosen))
    sliced, ends = planes(chosen), np.cumsum(counts)
    lag = 1
    while lag < int(counts[0]):
        lanes = int(ends[np.searchsorted(-counts, -lag, side="left") - 1])
        words = -(-lanes // 64)
        turns = min(max(1, LAG_LANES // words), int(counts[0]) - lag)
        reach = min(sliced.shape[1], words + (lag + turns) // 64 + 2)
        right = np.concatenate([shifted(sliced[:, :reach], k)[:, :words] for k in range(lag, lag + turns)], axis=1)
        near = within(np.tile(sliced[:, :words], (1, turns)), right, radius)
        flags = np.unpackbits(near.view(np.uint8), bitorder="little").reshape(turns, -1)
        found = False
        for turn, k in enumerate(range(lag, lag + turns)):
            hits = np.flatnonzero(flags[turn, : max(0, min(lanes, len(chosen) - k))])
            hits = hits[number[hits] == number[hits + k]]
            if own is not None:
                hits = hits[own[hits] * LEAST[1] >= own[hits + k] * LEAST[0]]
            hits = hits[root[hits] != root[hits + k]]
            for i in hits.tolist():
                a, b = i, i + k
                while root[a] != a:
                    a = root[a]
                while root[b] != b:
                    b = root[b]
                root[max(a, b)] = min(a, b)
            if len(hits):
                found = True
                while not np.array_equal(root, root[root]):
                    root = root[root]
        if found and np.count_nonzero(root == np.arange(len(root))) == len(counts):
            break
        lag += turns
        if own is not None and lag < int(counts[0]):
            ahead = np.arange(min(lanes, len(chosen) - lag))
            if not ((number[ahead] == number[ahead + lag]) & (own[ahead] * LEAST[1] >= own[ahead + lag] * LEAST[0])).any():
                break
    leaf = np.flatnonzero(root != np.arange(len(root)))
    return index[leaf], index[root[leaf]]


def links(distinct: DataFrame, radius: int = RADIUS, bands: int = BANDS, agree: int = AGREE, unit_rows: int = UNIT_ROWS) -> DataFrame:
    """u, v: links between distinct fingerprints (`bits`) that leave the same components as all pairs within the radius.

    A bucket of more than `unit_rows` rows is cut into parts, and each pair of parts is a unit of work of its own, so no
    task holds more than a unit at a time and every pair still meets.
    """
    if bands - radius < agree:
        raise ValueError("a pair within the radius has to agree in the chosen bands")
    rows = buckets(distinct, bands, agree)
    large = rows.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > unit_rows).select(
        "choice", "key", F.expr(f"cast(ceil(2 * n / {unit_rows}) AS INT)").alias("parts"))
    part = F.expr("cast(pmod(xxhash64(bits), parts) AS INT)")
    units = (
        rows.join(large, ["choice", "key"], "left")
        .withColumn("part", F.when(F.col("parts").isNull(), F.lit(0)).otherwise(part))
        .withColumn("other", F.explode(F.expr("CASE WHEN parts IS NULL THEN array(0) ELSE sequence(0, parts - 1) END")))
        .select("choice", "key", F.least("part", "other").alias("first"), F.greatest("part", "other").alias("second"), "bits")
        .withColumn("unit", F.xxhash64("choice", "key", "first", "second"))
    )
    # A collision of two units' hashes only adds comparisons: the radius decides on a link.
    dealt = units.select("unit", "bits").repartition("unit").sortWithinPartitions("unit")

    def compare(batches):
        kept_units, kept_bits = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

        def done(groups, values):
            if not len(groups):
                return None
            leaves, roots = linked(values.view(np.uint64), groups, radius)
            return pa.RecordBatch.from_arrays([pa.array(leaves.view(np.int64)), pa.array(roots.view(np.int64))], names=["u", "v"])

        for batch in batches:
            groups = np.r_[kept_units, batch.column(0).to_numpy(zero_copy_only=False)]
            values = np.r_[kept_bits, batch.column(1).to_numpy(zero_copy_only=False)]
            # The last group may go on in the next batch.
            cut = int(np.searchsorted(groups, groups[-1])) if len(groups) else 0
            kept_units, kept_bits = groups[cut:], values[cut:]
            result = done(groups[:cut], values[:cut])
            if result is not None and result.num_rows:
                yield result
        result = done(kept_units, kept_bits)
        if result is not None and result.num_rows:
            yield result

    return dealt.mapInArrow(compare, "u long, v long")


def classes(marked: DataFrame, tables: SharedTables, edges) -> DataFrame:
    """bits, component_id: each distinct `bits` of `marked` (doc_id, bits) and the smallest doc_id that links reach.

    `edges` gives the links (u, v) of a frame of distinct bits.
    """
    distinct = tables.write(marked.groupBy("bits").agg(F.min("doc_id").alias("least")), "distinct")
    stars = components(edges(distinct.select("bits")), tables)
    rooted = distinct.join(stars.select(F.col("u").alias("bits"), F.col("v").alias("root")), "bits", "left").withColumn(
        "root", F.coalesce("root", "bits"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return tables.write(rooted.join(named, "root").select("bits", "component_id"), "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, bits, component_id: one row per input row; component_id is the smallest doc_id that links reach.

    Texts without words, null ones included, share fingerprint zero. Rows that repeat a doc_id may stand in several
    components. A null doc_id never names a component unless it is alone there. An empty table gives an empty result.
    """
    tables = SharedTables(docs.sparkSession, "simhash")
    marked = tables.write(fingerprints(docs, id_col, text_col), "marked")
    return marked.join(classes(marked, tables, lambda distinct: links(distinct, radius)), "bits").select("doc_id", "bits", "component_id")


def wide_fingerprint(own: np.ndarray) -> bytes:
    """WIDE bits of a set of hashes: a majority of 64 bits for each of several ways to spread a hash."""
    words = [majority(mixed(own + np.uint64(i))) for i in range(WIDE // 64)]
    return np.array(words, dtype="<u8").tobytes()


def prefix_keys(own: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
    """The shingle hashes one of which any like text shares, and the wide fingerprint.

    In the order of the hashes, those in `often` behind all others, two sets that share a LEAST part of either have a common hash
    among all but the last `ceil(LEAST * size) - 1` of each.
    """
    last = among(own, often)[1]
    keys = np.r_[own[~last], own[last]][: len(own) + 1 - (-(-LEAST[0] * len(own) // LEAST[1]))]
    return keys, np.zeros(len(keys), dtype=np.uint64), wide_fingerprint(own)


def wide_forest(unit: np.ndarray, entry: np.ndarray, flags: np.ndarray, sizes: np.ndarray, sketches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Entries that connect what is within WIDE_RADIUS in its unit and of sizes that LEAST allows."""
    bits = np.frombuffer(b"".join(sketches), dtype="<u8").reshape(len(sketches), WIDE // 64)
    order = np.lexsort((sizes[entry], unit))
    entry = entry[order]
    leaf, root = stars(bits[entry], unit[order], WIDE_RADIUS, sizes[entry])
    return entry[leaf], entry[root]


NEAR = Method(prefix_keys, wide_forest, LEAST, rare_first=True)


def keep(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns: of each group of near duplicates the one with the smallest doc_id.

    Texts are near duplicates if links reach from one to the other; a link is a Jaccard likeness of LEAST or more between the
    sets of five-word shingles. Texts without words, null ones included, are alike. Rows that repeat both the id and the text
    are one document, of which one row stays; a null id is smaller than any other. An empty table stays empty.
    """
    found = Likeness(docs, NEAR, "simhash-keep").labelled()
    wordless = found.where("n = 0")
    first = wordless.agg(F.min_by(F.struct("doc_id"), F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("first")).select("first.doc_id").scalar()
    least = F.when(F.col("n") == 0, first).otherwise(F.col("component_id"))
    stays = found.where(F.col("doc_id").eqNullSafe(least)).select(F.col("doc_id").alias("stays_id"), F.col("tag").alias("stays_tag")).distinct()
    # The row travels as one struct, so that no column of the caller's can clash.
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("tag"))
    same = F.col("id").eqNullSafe(F.col("stays_id")) & (F.col("tag") == F.col("stays_tag"))
    return rows.join(stays, same, "left_semi").dropDuplicates(["id", "tag"]).select("row.*")
