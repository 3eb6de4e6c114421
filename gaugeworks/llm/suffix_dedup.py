"""Removal of repeated byte strings by collection suffix sorting, column by column.

A byte goes if a string of `LENGTH` bytes that covers it also starts in a document with a smaller id.

1. Mark. The least hash among the `GRAM`-byte strings of a window is the same wherever the window stands, so equal windows
   share it. Consecutive windows with the same least hash are a run. Each batch of documents finds the hashes that several
   of its documents have, and sends one packed entry per hash to a bucket.
2. Meet. A bucket tells which hashes more than one document has; documents get back the list of theirs.
3. Cut. Each document cuts the runs with such a hash into strings of at most `PIECE + LENGTH - 1` bytes. A string that
   several documents of a batch have is sent once, with the smallest of their ids; the others are resolved on the spot.
   Where a hash stands in very many places, be it of a few documents, the strings around it would meet in one bucket; its
   windows are sent one by one instead, each to the bucket of its own bytes.
4. Sort. A bucket builds the Burrows-Wheeler transform and the common prefixes of its collection of strings. Each round
   inserts one symbol of every string: the stable order of the transform's symbols says where the extended suffixes go, and
   the least common prefix between neighbours with the same symbol, plus one, is the new common prefix. Suffixes whose
   common prefixes reach LENGTH are equal windows; the smallest id among them decides. More than `BLOCK_STRINGS` strings
   with one hash are no block: their windows are compared piece by piece.
Spans of a document that overlap or touch are joined before they leave a task.
5. Remove. The spans found come back to their documents and the rest of the bytes is kept.

The transform, common prefixes and suffix names are streams that a round reads front to back and writes anew. They stay in
memory, as a block of the collection is bounded by `BLOCK_STRINGS`, and one task sorts one block after the other.
"""

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import SharedTables, texts

LENGTH = 50
GRAM = 24
PIECE = LENGTH - GRAM + 1
BLOCK_STRINGS = 4_000
# Documents that a task looks at together.
BATCH_ROWS = 4_000
# A cut looks at so many places before it sends what it has.
CUT_PLACES = 200_000
# Windows of a large group that are compared together.
PIECE_WINDOWS = 200_000
# A hash is hot from this many places in all documents on, or from more if there would be over HOT_HASHES of them, as these
# are broadcast.
HOT_DOCUMENTS = 50_000
HOT_HASHES = 5_000_000
NO_ID = -(1 << 63)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM (three times eight) bytes from each place on."""
    one = data.astype(np.uint64)
    two = one[:-1] | one[1:] << np.uint64(8)
    four = two[:-2] | two[2:] << np.uint64(16)
    eight = four[:-4] | four[4:] << np.uint64(32)
    mixed = eight[:-16] * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    mixed = (mixed + eight[8:-8]) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(30)
    mixed = (mixed + eight[16:]) * np.uint64(0x94D049BB133111EB)
    return mixed ^ mixed >> np.uint64(29)


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    least, reach = values, 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    return least if reach == width else np.minimum(least[: len(values) - width + 1], least[width - reach :])


def runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first window and number of windows of each run; a run of more than PIECE windows comes in pieces."""
    if len(data) < LENGTH:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    least = sliding_minimum(gram_hashes(data), PIECE) >> np.uint64(16)
    starts = np.r_[0, np.flatnonzero(least[1:] != least[:-1]) + 1]
    sizes = np.diff(np.r_[starts, len(least)])
    if (sizes > PIECE).any():
        parts = -(-sizes // PIECE)
        within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts, sizes = np.repeat(starts, parts) + within * PIECE, np.minimum(np.repeat(sizes, parts) - within * PIECE, PIECE)
    return least[starts], starts, sizes


def packed(*arrays: np.ndarray) -> bytes:
    """Equally long arrays of 64-bit numbers, byte plane by byte plane, compressed."""
    planes = [np.ascontiguousarray(a.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpacked(blob: bytes, count: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    return [np.ascontiguousarray(p.reshape(8, -1).T).view("<i8").ravel() for p in raw.reshape(count, -1)]


def by_bucket(bucket: np.ndarray):
    """(value, places that have it) for each value, in order."""
    order = np.argsort(bucket, kind="stable")
    ends = np.flatnonzero(np.r_[bucket[order][1:] != bucket[order][:-1], True]) + 1 if len(order) else []
    for a, b in zip([0, *ends], ends):
        yield int(bucket[order[a]]), order[a:b]


def collection_minima(strings: list[bytes], ids: np.ndarray) -> list[np.ndarray]:
    """For each window of each string, the smallest id of a string that has it.

    Column-wise construction of the transform (`symbols`) and the common prefixes (`common`, up to LENGTH) of the strings'
    suffixes; `names` (string times 256 plus length) says whose suffix each is. Each string ends in a terminator that is
    smaller than any byte. Bytes that occur are numbered anew, in order, as sorting eight bits is fast.
    """
    count = len(strings)
    lengths = np.array([len(s) for s in strings])
    longest = int(lengths.max())
    used = np.unique(np.frombuffer(b"".join(strings), dtype=np.uint8))
    kind = np.uint8 if len(used) < 256 else np.uint16
    number = np.zeros(256, dtype=kind)
    number[used] = np.arange(1, len(used) + 1)
    columns = np.zeros((longest, count), dtype=kind)
    for i, s in enumerate(strings):
        columns[: len(s), i] = number[np.frombuffer(s, dtype=np.uint8)[::-1]]
    names = np.arange(count, dtype=np.int64) << 8
    symbols, common, place = np.zeros(count, dtype=kind), np.zeros(count, dtype=np.uint8), np.arange(count)
    for turn in range(longest):
        active = np.flatnonzero(lengths > turn)
        symbols[place[active]] = columns[turn, active]
        fresh = np.zeros(len(symbols), dtype=bool)
        fresh[place[active]] = True
        order = np.argsort(symbols, kind="stable")
        order = order[np.count_nonzero(symbols == 0) :]
        new = fresh[order]
        # A suffix extended by its symbol stands where the symbol stands in the sorted transform, after the terminators.
        to = count + np.flatnonzero(new)
        same = np.r_[False, symbols[order[1:]] == symbols[order[:-1]]]
        changed = np.flatnonzero(new | np.r_[False, new[:-1]])
        prefix = np.zeros(len(changed), dtype=np.uint8)
        inner = same[changed]
        first, last = order[changed[inner] - 1] + 1, order[changed[inner]] + 1
        if len(first):
            # From the right to the left: between two ranges that overlap or go back, reduceat reads a single element.
            back = np.argsort(-first, kind="stable")
            edges = np.column_stack([first[back], last[back]]).ravel()
            least = np.minimum.reduceat(np.r_[common, np.uint8(0)], edges)[::2]
            spread = np.empty(len(first), dtype=np.uint8)
            spread[back] = np.minimum(least + 1, LENGTH)
            prefix[inner] = spread
        total = len(symbols) + len(active)
        old = np.ones(total, dtype=bool)
        old[to] = False
        stay = np.flatnonzero(old)
        grown = [np.zeros(total, dtype=a.dtype) for a in (symbols, common, names)]
        # Suffixes are extended in the order of their symbols' places: the names at those places tell whose they are.
        before = names[order[new]] >> 8
        for target, source in zip(grown, (symbols, common, names)):
            target[stay] = source
        symbols, common, names = grown
        names[to] = (before << 8) + turn + 1
        common[count + changed] = prefix
        place[before] = to
    starts = np.flatnonzero(common < LENGTH)
    owner, size = names >> 8, names & 255
    least = np.minimum.reduceat(ids[owner], starts)
    each = np.repeat(least, np.diff(np.r_[starts, len(common)]))
    whole = size >= LENGTH
    result = [np.empty(n - LENGTH + 1, dtype=np.int64) for n in lengths.tolist()]
    offsets = np.r_[0, np.cumsum(lengths - LENGTH + 1)]
    flat = np.empty(offsets[-1], dtype=np.int64)
    flat[offsets[owner[whole]] + lengths[owner[whole]] - size[whole]] = each[whole]
    for i in range(count):
        result[i] = flat[offsets[i] : offsets[i + 1]]
    return result


def window_minima(strings: list[bytes], ids: np.ndarray) -> list[np.ndarray]:
    """As `collection_minima`, for any number of strings: equal windows are found by sorting PIECE_WINDOWS or so at a time.

    Equal windows start with the same gram, whose hash tells the piece.
    """
    data = np.frombuffer(b"".join(strings), dtype=np.uint8)
    lengths = np.array([len(s) for s in strings])
    counts = lengths - LENGTH + 1
    owner = np.repeat(np.arange(len(strings)), counts)
    place = np.arange(counts.sum()) + (np.cumsum(lengths) - lengths - np.cumsum(counts) + counts)[owner]
    pieces = -(-len(place) // PIECE_WINDOWS)
    piece = gram_hashes(data)[place] % np.uint64(pieces)
    windows = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
    flat = np.empty(len(place), dtype=np.int64)
    for number in range(pieces):
        at = np.flatnonzero(piece == number)
        if len(at):
            # All have LENGTH bytes, so that zero bytes at the end cannot make two of them equal.
            _, kind = np.unique(np.ascontiguousarray(windows[place[at]]).view(f"S{LENGTH}").ravel(), return_inverse=True)
            least = np.full(kind.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, kind, ids[owner[at]])
            flat[at] = least[kind]
    return np.split(flat, np.cumsum(counts)[:-1])


def spans_of(ok: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Byte spans covered by the windows from `start` on that are marked."""
    turns = [0, *(np.flatnonzero(ok[1:] != ok[:-1]) + 1).tolist(), len(ok)]
    first = 0 if ok[0] else 1
    return [(start + a, start + b - 1 + LENGTH) for a, b in zip(turns[first::2], turns[first + 1 :: 2])]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def spans_joined(rows: list[tuple[int, int, int, int]]) -> list[np.ndarray]:
    """Spans (doc_id, row, start, end) with those of one row that overlap or touch made one; columns in this order."""
    doc_id, row, start, end = (np.array(c, dtype=np.int64) for c in zip(*rows))
    order = np.lexsort((start, row, doc_id))
    doc_id, row, start, end = doc_id[order], row[order], start[order], end[order]
    first = np.r_[True, (doc_id[1:] != doc_id[:-1]) | (row[1:] != row[:-1])]
    # The furthest end so far within a row: a text has fewer bytes than a step from one row to the next is worth.
    step = int(end.max()) + 1
    reach = np.maximum.accumulate((np.cumsum(first) - 1) * step + end) - (np.cumsum(first) - 1) * step
    fresh = first | np.r_[False, start[1:] > reach[:-1]]
    begin = np.flatnonzero(fresh)
    last = np.r_[begin[1:], len(start)] - 1
    return [doc_id[begin], row[begin], start[begin], reach[last]]


def record(columns, names):
    return pa.RecordBatch.from_arrays(columns, names=names)


def longs(values) -> pa.Array:
    return pa.array(values, type=pa.int64())


def slices(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(start, BATCH_ROWS)


def mark(batches, buckets: int, known: bool):
    """The hashes of each batch: what its documents have in common (`known`), or one entry per hash for the buckets.

    With each hash goes the number of places of the document that have it.
    """
    for batch in slices(batches):
        hashes, owners, places = [], [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found, times = np.unique(runs(np.frombuffer(text.encode(), dtype=np.uint8))[0], return_counts=True)
            hashes.append(found)
            places.append(times)
            owners.append(np.full(len(found), doc_id, dtype=np.int64))
        if not hashes or not sum(map(len, hashes)):
            continue
        value, owner, times = np.concatenate(hashes).astype(np.int64), np.concatenate(owners), np.concatenate(places)
        order = np.argsort(value)
        value, owner, times = value[order], owner[order], times[order]
        first = np.r_[True, value[1:] != value[:-1]]
        several = np.repeat(np.diff(np.r_[np.flatnonzero(first), len(value)]) > 1, np.diff(np.r_[np.flatnonzero(first), len(value)]))
        if known:
            yield record([pa.array(owner[several]), pa.array(value[several]), longs(times[several])], ["doc_id", "hash", "places"])
            continue
        keys, blobs = [], []
        value, owner, times, several = value[first], owner[first], times[first], several[first]
        for key, spots in by_bucket(value % buckets):
            keys.append(key)
            blobs.append(packed(value[spots] * 2 + several[spots], owner[spots], times[spots]))
        if keys:
            yield record([longs(keys), pa.array(blobs, type=pa.binary())], ["key", "blob"])


def grouped(batches, columns: int):
    """(key, list of the other columns' values) of consecutive rows with the same key."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in range(columns))):
            if row[0] != key and held:
                yield key, held
                held = []
            key = row[0]
            held.append(row[1:])
    if held:
        yield key, held


def meet(batches):
    """Of each bucket, the hashes that more than one entry has, for each document that is not told yet."""
    for _, blobs in grouped(batches, 2):
        parts = [unpacked(b, 3) for (b,) in blobs]
        value, owner, times = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.argsort(value >> 1, kind="stable")
        value, owner, times = value[order], owner[order], times[order]
        several, value = value & 1, value >> 1
        shared = np.r_[False, value[1:] == value[:-1]] | np.r_[value[1:] == value[:-1], False]
        tell = shared & (several == 0)
        yield record([pa.array(owner[tell]), pa.array(value[tell]), longs(times[tell])], ["doc_id", "hash", "places"])


CUT = "bucket long, blob binary, body binary, doc_id long, row long, start long, end long"


def cut(batches, buckets: int):
    """Strings for the buckets, and the spans of documents whose string a smaller one of the batch has as well.

    The smallest document that has a string is sent; larger ones are resolved. Places of one document with the same
    string are all sent, as none of them is in a smaller document. After CUT_PLACES places all that was found goes out.
    """
    for batch in slices(batches):
        found: dict[bytes, tuple[int, list]] = {}
        places = 0
        listed = batch.column(3)
        edges, hashes = listed.offsets.to_numpy(), listed.values.to_numpy()  # offsets into all values, also of a slice
        for doc_id, row, text, a, b in zip(*(batch.column(c).to_pylist() for c in range(3)), edges, edges[1:]):
            body = text.encode()
            value, starts, sizes = runs(np.frombuffer(body, dtype=np.uint8))
            value, told = value.astype(np.int64), hashes[a:b]
            hot = set(told[told & 1 == 1].tolist())
            for i in np.flatnonzero(np.isin(value, told >> 1)).tolist():
                start, group = int(starts[i]), int(value[i])
                if group * 2 + 1 in hot:
                    for at in range(start, start + int(sizes[i])):
                        key = body[at : at + LENGTH]
                        found.setdefault(key, ((zlib.crc32(key) << 16) + (group & 0xFFFF), []))[1].append((doc_id, row, at))
                    places += int(sizes[i])
                else:
                    key = body[start : start + int(sizes[i]) + LENGTH - 1]
                    found.setdefault(key, (group, []))[1].append((doc_id, row, start))
                    places += 1
                if places >= CUT_PLACES:
                    yield from dealt(found, buckets)
                    found, places = {}, 0
        yield from dealt(found, buckets)


def dealt(found: dict[bytes, tuple[int, list]], buckets: int):
    """The rows that `cut` makes of the places found."""
    resolved, sent = [], []
    for body, (value, spots) in found.items():
        least = min(s[0] for s in spots)
        for doc_id, row, start in spots:
            if doc_id == least:
                sent.append((value, body, doc_id, row, start))
            else:
                resolved.append((doc_id, row, start, start + len(body)))
    if sent:
        value = np.array([s[0] for s in sent])
        sizes, ids, rows, starts = (np.array(c, dtype=np.int64) for c in zip(*((len(s[1]), *s[2:]) for s in sent)))
        keys, blobs, bodies = [], [], []
        for key, spots in by_bucket(value % buckets):
            spots = spots[np.argsort(value[spots], kind="stable")]
            keys.append(key)
            blobs.append(packed(value[spots], sizes[spots], ids[spots], rows[spots], starts[spots]))
            bodies.append(zstandard.ZstdCompressor(level=1).compress(b"".join(sent[i][1] for i in spots.tolist())))
        none = [None] * len(keys)
        yield record([longs(keys), pa.array(blobs, pa.binary()), pa.array(bodies, pa.binary()), *[longs(none)] * 4], CUT_NAMES)
    if resolved:
        spans = spans_joined(resolved)
        none = [None] * len(spans[0])
        yield record([longs(none), *[pa.array(none, pa.binary())] * 2, *map(longs, spans)], CUT_NAMES)


CUT_NAMES = [c.split()[0] for c in CUT.split(", ")]
SPANS = "doc_id long, row long, start long, end long"


def sort_strings(batches):
    """Of each bucket, the spans of its strings that smaller documents have."""
    for _, sent in grouped(batches, 3):
        strings: dict[bytes, int] = {}
        group, least, spots = [], [], []
        for blob, bodies in sent:
            value, sizes, ids, rows, starts = unpacked(blob, 5)
            raw, at = zstandard.ZstdDecompressor().decompress(bodies), 0
            for v, n, doc_id, row, start in zip(*(a.tolist() for a in (value, sizes, ids, rows, starts))):
                number = strings.setdefault(raw[at : at + n], len(strings))
                at += n
                if number == len(group):
                    group.append(v)
                    least.append(doc_id)
                least[number] = min(least[number], doc_id)
                spots.append((number, doc_id, row, start))
        bodies, least, group = list(strings), np.array(least), np.array(group)
        minima: dict[int, np.ndarray] = {}
        # A string that is alone with its hash has no other to share windows with.
        order = np.argsort(group, kind="stable")
        block: list[int] = []
        sizes = np.diff(np.r_[0, np.flatnonzero(np.r_[group[order][1:] != group[order][:-1], True]) + 1])
        at = 0
        for size in [*sizes.tolist(), 0]:
            if block and (not size or len(block) + size > BLOCK_STRINGS):
                minima.update(zip(block, collection_minima([bodies[i] for i in block], least[block])))
                block = []
            if size > BLOCK_STRINGS:
                chosen = order[at : at + size]
                minima.update(zip(chosen.tolist(), window_minima([bodies[i] for i in chosen.tolist()], least[chosen])))
            elif size > 1:
                block += order[at : at + size].tolist()
            at += size
        found = []
        for number, doc_id, row, start in spots:
            own = minima.get(number)
            if own is not None:
                covered = spans_of(own < doc_id, start)
            else:
                covered = [(start, start + len(bodies[number]))] if least[number] < doc_id else []
            found += [(doc_id, row, a, b) for a, b in covered]
        if found:
            yield record([longs(c) for c in spans_joined(found)], ["doc_id", "row", "start", "end"])


REMOVED = "doc_id long, n_bytes long, n_removed long, kept binary, starts array<long>, ends array<long>"


def remove(batches):
    for batch in batches:
        out = []
        listed = batch.column(2)
        edges = listed.offsets.to_pylist()
        starts, ends = (listed.values.field(i).to_pylist() for i in (0, 1))
        for doc_id, text, a, b in zip(*(batch.column(c).to_pylist() for c in range(2)), edges, edges[1:]):
            body, spans = text.encode(), merged(list(zip(starts[a:b], ends[a:b])))
            bounds = [0, *(x for span in spans for x in span), len(body)]
            kept = b"".join(body[i:j] for i, j in zip(bounds[::2], bounds[1::2]))
            out.append((doc_id, len(body), len(body) - len(kept), kept, [s for s, _ in spans], [e for _, e in spans]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=k) for c, k in zip(zip(*out), kinds)], names=[c.split()[0] for c in REMOVED.split(", ")])


def hot_hashes(told: DataFrame, least: int = HOT_DOCUMENTS) -> DataFrame:
    """hash: those of `told` (doc_id, hash, places) with more than `least` places, at most HOT_HASHES."""
    most = max(least, (told.agg(F.sum("places")).first()[0] or 0) // HOT_HASHES)
    return told.groupBy("hash").agg(F.sum("places").alias("n")).where(F.col("n") > most).select("hash")


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_documents: int = HOT_DOCUMENTS
) -> DataFrame:
    """doc_id, n_bytes, n_removed, kept (bytes), starts, ends (removed runs): one row per input row.

    A null text counts as empty; texts of fewer than LENGTH bytes lose nothing. Rows with the same id do not remove from
    each other, as neither has the smaller id; a null id is smaller than any other. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    tables = SharedTables(spark, "suffix-dedup")
    # The partitions of a scan have a bounded size, so buckets keep theirs where their number follows that of the partitions.
    buckets = max(16, 4 * docs.rdd.getNumPartitions())
    rows = texts(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text")
    pair = "doc_id long, hash long, places long"
    marked = rows.mapInArrow(lambda b: mark(b, buckets, False), "key long, blob binary")
    met = marked.repartition("key").sortWithinPartitions("key").mapInArrow(meet, pair)
    told = tables.write(met.unionAll(rows.mapInArrow(lambda b: mark(b, buckets, True), pair)), "told")
    hot = hot_hashes(told, hot_documents).select("hash", F.lit(1).alias("hot"))
    # At most HOT_HASHES numbers, by the choice of the bound.
    flagged = told.join(F.broadcast(hot), "hash", "left").select("doc_id", F.expr("hash * 2 + coalesce(hot, 0)").alias("hash"))
    lists = flagged.groupBy("doc_id").agg(F.collect_list("hash").alias("hashes"))
    candidates = rows.join(lists, "doc_id").select("doc_id", F.xxhash64("text").alias("row"), "text", "hashes")
    pieces = tables.write(candidates.mapInArrow(lambda b: cut(b, buckets), CUT), "pieces")
    strings = pieces.where("bucket IS NOT NULL").select("bucket", "blob", "body").repartition("bucket").sortWithinPartitions("bucket")
    resolved = pieces.where("bucket IS NULL").select("doc_id", "row", "start", "end")
    spans = tables.write(strings.mapInArrow(sort_strings, SPANS).unionAll(resolved), "spans")
    tables.drop("told")
    tables.drop("pieces")
    per_row = spans.groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    whole = rows.withColumn("row", F.xxhash64("text")).join(per_row, ["doc_id", "row"], "left").select("doc_id", "text", F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"))
    return whole.mapInArrow(remove, REMOVED).withColumn("doc_id", F.expr(f"nullif(doc_id, {NO_ID + 1} - 1)"))

