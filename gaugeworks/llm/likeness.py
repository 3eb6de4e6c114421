"""Texts whose sets of word shingles are alike: from keys that alike texts share to verified links and classes.

An operator brings its own keys and its own test of closeness (`Method`): any two texts alike enough must share a key and pass
the test. What follows is the same for all of them.

1. Mark. Texts with equal sets are one class, known by a digest; only one text of a class goes on. A method may take its keys from
   the rare shingles of a text first (`rare_first`); those that more than about `OFTEN` texts have are counted before.
2. Meet. Each batch of documents sends one packed entry per key to the key's bucket, and learns which keys others have as well.
   Keys that one text alone has go no further.
3. Compare. Of keys that the same texts have, one goes on. Sketches of texts that share a key meet in units of at most about
   `UNIT` sketches; a more frequent key is cut into parts, and each pair of parts is a unit. A unit returns the edges of a forest
   of the close ones, not their pairs.
4. Verify. The exact likeness of each edge is taken from the two texts, the leaves of a hub in parts of `HUB_LEAVES`.
5. Settle. Where an edge of a group of close texts fails, other pairs of this group may still link its pieces: each text
   outside the group's largest piece is held against all other texts of the group, in units of bounded size. What many texts of
   a unit have is counted by a product of matrices.
"""

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.arrays import GOLDEN, WordHashes, among, by_key, mixed, packed, record, runs_of, unpacked
from gaugeworks.llm.common import SLICE_ROWS, SharedTables, texts
from gaugeworks.llm.components import components

SHINGLE = 5
UNIT = 8_192
HUB_LEAVES = 2_000
SETTLE_ROWS = 2_048
BATCH_ROWS = 4_000
OFTEN = 2_048
HELD_SHINGLES = 1 << 20
# A shingle that one of so many texts of a unit has is a column of a matrix there; rows and columns of a matrix at a time.
DENSE, ROWS, COLUMNS = 16, 256, 512
KEY_BITS = 48
NO_ID = -(1 << 63)


def shingles(text: str, known: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of all runs of `size` words, sorted; A-Z lower-cased. Fewer words are one run, no words none.

    A hash has 64 bits: that two different runs of a pair of texts have the same one is left out of account.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z alone, and ASCII white space alone
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes, size = known.of(words), min(size, len(words))
    count = len(words) - size + 1
    found = np.full(count, size, dtype=np.uint64)
    for i in range(size):
        found = mixed(found * GOLDEN + hashes[i : i + count])
    return np.unique(found)


@dataclass(frozen=True)
class Method:
    """keys(set) gives (keys, flags, sketch): 64-bit keys, a flag 0 or 1 with each, and the bytes to compare by.

    forest(unit, entry, flags, sizes, sketches) gives (leaf, root) entries: `unit` (sorted) and `entry` (a place in sizes and
    sketches) of each row; the edges connect what is close within a unit, and lose no connection.

    With `rare_first`, keys also gets the sorted hashes of the shingles that many texts have. They only set an order, so whichever
    they are, alike texts share a key.
    """

    keys: Callable
    forest: Callable
    least: tuple[int, int]
    rare_first: bool = False


def enough(common, one, other, least: tuple[int, int]):
    """Whether the common shingles are at least `least` of the union."""
    return common * least[1] >= least[0] * (one + other - common)


def repeated(batches):
    """shingle, n: of each run of texts with about HELD_SHINGLES shingles, those that several of its texts have."""
    known, held, size = WordHashes(), [], 0

    def told():
        flat = np.concatenate(held)
        held.clear()
        flat.sort()
        starts, counts = runs_of(flat)
        several = counts > 1
        return record("shingle long, n long", flat[starts[several]].view(np.int64), counts[several])

    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            for text in batch.column(0).slice(at, SLICE_ROWS).to_pylist():
                held.append(shingles(text, known))
                size += len(held[-1])
                if size >= HELD_SHINGLES:
                    yield told()
                    size = 0
    if held:
        yield told()


MARK = "bucket long, blob binary, doc_id long, tag long, n long, digest binary, sketch binary, own long, key long"


def marks(batches, method: Method, buckets: int, *often: np.ndarray):
    """Three kinds of rows: documents (doc_id, tag, n, digest, sketch, own), blobs for the buckets, and (own, key) of keys that several
    texts of the batch have. A key ends with its flag; `own` names a text by the first half of its digest. `often` goes to the keys."""
    known = WordHashes()
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            piece = batch.slice(at, BATCH_ROWS)
            ids, tags, sizes, digests, sketches, names, keys, owners, seen = [], [], [], [], [], [], [], [], set()
            for doc_id, text, tag in zip(*(c.to_pylist() for c in piece.columns)):
                own = shingles(text, known)
                digest = xxhash.xxh3_128_digest(own.tobytes())
                found, flags, sketch = method.keys(own, *often) if len(own) else (own, own, b"")
                ids.append(doc_id)
                tags.append(tag)
                sizes.append(len(own))
                digests.append(digest)
                sketches.append(sketch)
                names.append(int.from_bytes(digest[:8], "little", signed=True))
                if digest not in seen:
                    seen.add(digest)
                    keys.append(np.unique(found >> np.uint64(65 - KEY_BITS) << np.uint64(1) | flags.astype(np.uint64)).astype(np.int64))
                    owners.append(np.full(len(keys[-1]), names[-1]))
            yield record(MARK, None, None, ids, tags, sizes, digests, sketches, names, None)
            key, owner = np.concatenate(keys), np.concatenate(owners)
            if not len(key):
                continue
            order = np.argsort(key >> 1, kind="stable")
            key, owner = key[order], owner[order]
            starts, counts = runs_of(key >> 1)
            several = counts > 1
            told = np.repeat(several, counts)
            if told.any():
                yield record(MARK, *[None] * 7, owner[told], key[told])
            key, owner = key[starts], owner[starts]
            order = np.argsort((key >> 1) % buckets, kind="stable")
            key, owner, several = key[order], owner[order], several[order]
            begin, size = runs_of((key >> 1) % buckets)
            blobs = [packed(np.diff(key[a : a + n], prepend=0), owner[a : a + n], several[a : a + n])
                     for a, n in zip(begin.tolist(), size.tolist())]
            yield record(MARK, (key[begin] >> 1) % buckets, blobs, *[None] * 7)


def met(batches):
    """own, key: of each bucket, the keys that more than one entry has, for each text that does not know it yet."""
    for _, blobs in by_key(batches):
        parts = [unpacked(b, 3) for (b,) in blobs]
        key = np.concatenate([np.cumsum(p[0]) for p in parts])
        owner, several = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
        order = np.lexsort((owner, key >> 1))
        key, owner, several = key[order], owner[order], several[order]
        # Entries of one text from several batches are no company.
        starts, counts = runs_of(key >> 1)
        fresh = np.r_[True, (key[1:] >> 1 != key[:-1] >> 1) | (owner[1:] != owner[:-1])]
        texts_with = np.add.reduceat(fresh.astype(np.int64), starts) if len(starts) else starts
        tell = np.repeat(texts_with > 1, counts) & (several == 0) & fresh
        if tell.any():
            yield record("own long, key long", owner[tell], key[tell])


def sent(batches, buckets: int):
    """bucket, blob, sketches: of each batch, the units' entries by bucket; a text's sketch goes once to each bucket."""
    for batch in batches:
        nodes, sizes, sketches, units, flags = (c.to_pylist() for c in batch.columns)
        unit = np.array([u for own in units for u in own], dtype=np.int64)
        flag = np.array([f for own in flags for f in own], dtype=np.int64)
        owner = np.repeat(np.arange(len(nodes)), [len(u) for u in units])
        order = np.argsort(unit % buckets, kind="stable")
        begin, size = runs_of(unit[order] % buckets)
        keys, blobs, bodies = [], [], []
        for a, n in zip(begin.tolist(), size.tolist()):
            mine = order[a : a + n]
            some, place = np.unique(owner[mine], return_inverse=True)
            lengths = [len(sketches[i]) for i in some.tolist()]
            keys.append(int(unit[mine[0]] % buckets))
            head = packed(np.array([nodes[i] for i in some.tolist()]), np.array([sizes[i] for i in some.tolist()]), np.array(lengths))
            blobs.append(len(head).to_bytes(4, "little") + head + packed(unit[mine], flag[mine], place))
            bodies.append(b"".join(sketches[i] for i in some.tolist()))
        if keys:
            yield record("bucket long, blob binary, sketches binary", keys, blobs, bodies)


def compared(batches, method: Method):
    """u, v: of each bucket, the forests of its units as edges between nodes."""
    for _, rows in by_key(batches):
        node, size, sketch, unit, flag, entry = [], [], [], [], [], []
        for blob, body in rows:
            cut = 4 + int.from_bytes(blob[:4], "little")
            ids, sizes, lengths = unpacked(blob[4:cut], 3)
            keys, flags, place = unpacked(blob[cut:], 3)
            ends = np.cumsum(lengths).tolist()
            entry.append(place + sum(map(len, node)))
            node.append(ids)
            size.append(sizes)
            sketch += [body[a:b] for a, b in zip([0, *ends], ends)]
            unit.append(keys)
            flag.append(flags)
        node, size, unit, flag, entry = map(np.concatenate, (node, size, unit, flag, entry))
        order = np.lexsort((node[entry], unit))
        leaf, root = method.forest(unit[order], entry[order], flag[order], size, sketch)
        if len(leaf):
            u, v = node[leaf], node[root]
            both = np.unique(np.column_stack([np.maximum(u, v), np.minimum(u, v)]), axis=0)
            both = both[both[:, 0] != both[:, 1]]
            yield record("u long, v long", both[:, 0], both[:, 1])


def verified(batches, least: tuple[int, int]):
    """u, v, ok: of each unit, whose first row is the hub v (u is null), whether its leaves u are alike."""
    known = WordHashes()
    hub, own, last = None, None, None
    for batch in batches:
        out = []
        for unit, u, v, text in zip(*(c.to_pylist() for c in batch.columns)):
            found = shingles(text, known)
            if u is None:
                hub, own, last = unit, found, v
            elif unit == hub and v == last:
                common = len(np.intersect1d(own, found, assume_unique=True))
                out.append((u, v, bool(enough(common, len(own), len(found), least))))
        if out:
            yield record("u long, v long, ok boolean", *map(list, zip(*out)))


def shared(asking: list[np.ndarray], rest: list[np.ndarray]):
    """For each asking set, how many of its elements each of the other sets has."""
    flat, owner = np.concatenate(rest), np.repeat(np.arange(len(rest)), [len(s) for s in rest])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    starts, counts = runs_of(flat)
    dense = counts * DENSE >= len(rest)
    columns, often = flat[starts[dense]], np.repeat(dense, counts)
    spot, holder = np.repeat(np.arange(len(columns)), counts[dense]), owner[often]
    light, lone = flat[~often], owner[~often]
    for top in range(0, len(asking), ROWS):
        some = asking[top : top + ROWS]
        asked = [place[there] for place, there in (among(own, columns) for own in some)]
        known = np.zeros((len(some), len(rest)), dtype=np.float32)  # whole numbers below 2 to the power 24
        for at in range(0, len(columns), COLUMNS):
            a, b = np.searchsorted(spot, [at, at + COLUMNS])
            have, ask = (np.zeros((n, COLUMNS), dtype=np.float32) for n in (len(rest), len(some)))
            have[holder[a:b], spot[a:b] - at] = 1
            for row, own in zip(ask, asked):
                a, b = np.searchsorted(own, [at, at + COLUMNS])
                row[own[a:b] - at] = 1
            known += ask @ have.T
        for row, own in zip(known, some):
            a, b = np.searchsorted(light, own), np.searchsorted(light, own, side="right")
            spots = np.repeat(a - np.r_[0, np.cumsum(b - a)[:-1]], b - a) + np.arange((b - a).sum())
            yield row.astype(np.int64) + np.bincount(lone[spots], minlength=len(rest))


def settled(batches, least: tuple[int, int]):
    """u, v: of each unit, a forest of the labels that links connect; rows (unit, asks, node, label, text) with asks = 1 are held against
    the rest. A label is a node of its own piece, so edges between labels are as good as the links between their texts."""
    known = WordHashes()
    for _, rows in by_key(batches):
        sides: tuple[dict, dict] = ({}, {})
        for asks, node, label, text in rows:
            sides[asks].setdefault(node, (label, shingles(text, known)))
        rest, asking = sides
        if not rest or not asking:
            continue
        label, size = np.array([l for l, _ in rest.values()]), np.array([len(s) for _, s in rest.values()])
        root: dict[int, int] = {}

        def top(one: int) -> int:
            while (up := root.setdefault(one, one)) != one:
                root[one] = one = root.setdefault(up, up)
            return one

        counts = shared([s for _, s in asking.values()], [s for _, s in rest.values()])
        for (mine, own), common in zip(asking.values(), counts):
            link = enough(common, len(own), size, least) & (label != mine)
            for other in np.unique(label[link]).tolist():
                one, two = sorted((top(mine), top(other)))
                root[two] = one
        out = [(u, v) for u in list(root) if (v := top(u)) != u]
        if out:
            yield record("u long, v long", *map(list, zip(*out)))


class Likeness:
    """Classes of alike texts among `docs` (doc_id, text).

    `classes`: digest, node, least (the smallest doc_id), n; `links`: u, v between nodes, enough to connect whatever alike
    texts connect; `labelled`: a row per document. Null texts count as empty; texts without words have an empty set
    and are linked with nothing. Rows that repeat a doc_id may be in several components. An empty table gives an empty result.
    """

    def __init__(self, docs: DataFrame, method: Method, name: str, id_col: str = "doc_id", text_col: str = "text"):
        self.spark, self.method, self.tables = docs.sparkSession, method, SharedTables(docs.sparkSession, name)
        self.rows = texts(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text")
        tagged = self.rows.withColumn("tag", F.xxhash64("text"))
        # A scan's partitions have a bounded size, so buckets keep theirs where their number follows that of the partitions.
        self.buckets = max(16, 4 * docs.rdd.getNumPartitions())
        often = self._often() if method.rare_first else None
        marked = tagged.mapInArrow(lambda b, n=self.buckets: marks(b, method, n, *([often.value] if often else [])), MARK)
        kind = F.expr("CASE WHEN digest IS NOT NULL THEN 'document' WHEN bucket IS NOT NULL THEN 'blob' ELSE 'told' END")
        self.marked = self.tables.write(marked.withColumn("kind", kind), "marked", "kind")
        self.documents = self.marked.where("kind = 'document'").select("doc_id", "tag", "n", "digest", "sketch", "own")
        grouped = self.documents.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"),
            F.first("sketch").alias("sketch"), F.first("own").alias("own"))
        self.classes = self.tables.write(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
        self.links = self._links()

    def _dealt(self, frame: DataFrame, key: str, *more) -> DataFrame:
        return frame.repartition(key).sortWithinPartitions(key, *more)

    def _often(self):
        """A broadcast of the shingles that more than about OFTEN texts have, sorted; no more than one for OFTEN shingles of the texts."""
        told = self.rows.select("text").mapInArrow(repeated, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
        found = told.where(F.col("n") > OFTEN).select("shingle").toArrow().column(0).to_numpy()
        return self.spark.sparkContext.broadcast(np.sort(found.view(np.uint64)))

    def _close(self) -> DataFrame:
        """u, v: forests of close texts."""
        blobs = self._dealt(self.marked.where("kind = 'blob'").select("bucket", "blob"), "bucket").mapInArrow(met, "own long, key long")
        told = self.tables.write(self.marked.where("kind = 'told'").select("own", "key").unionAll(blobs).distinct(), "told")
        self.tables.drop("marked/kind=blob")  # as large as the input
        entries = told.select("own", F.expr("shiftright(key, 1)").alias("key"), F.expr("key & 1").alias("flag"))
        # Alike texts share most of their keys: of the keys with the same texts one is enough, known by 128 bits of their hashes.
        members = entries.groupBy("key").agg(
            F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("own", "flag")).alias("some"),
            F.bit_xor(F.xxhash64("flag", "own", F.lit("more"))).alias("more"))
        chosen = members.groupBy("n", "some", "more").agg(F.min("key").alias("key")).select(
            "key", F.expr(f"CASE WHEN n > {UNIT} THEN cast(ceil(2 * n / {UNIT}) AS int) END").alias("parts"))
        part = F.expr("cast(pmod(xxhash64(own), parts) AS int)")
        units = (
            entries.join(chosen, "key")
            .withColumn("part", F.when(F.col("parts").isNull(), F.lit(0)).otherwise(part))
            .withColumn("other", F.explode(F.expr("CASE WHEN parts IS NULL THEN array(0) ELSE sequence(0, parts - 1) END")))
            .select("own", "flag", F.expr("shiftright(xxhash64(key, least(part, other), greatest(part, other)), 1)").alias("unit"))
        )
        lists = units.groupBy("own").agg(F.collect_list("unit").alias("units"), F.collect_list("flag").alias("flags"))
        ready = self.classes.join(lists, "own").select("node", "n", "sketch", "units", "flags")
        buckets, method = self.buckets, self.method
        blobs = self._dealt(ready.mapInArrow(lambda b: sent(b, buckets), "bucket long, blob binary, sketches binary"), "bucket")
        return self.tables.write(blobs.mapInArrow(lambda b: compared(b, method), "u long, v long").distinct(), "close")

    def _links(self) -> DataFrame:
        close, least = self._close(), self.method.least
        named = close.select(F.col("u").alias("node")).unionAll(close.select(F.col("v").alias("node"))).distinct()
        wanted = named.join(self.classes, "node").select("node", "digest", F.col("least").alias("doc_id"))
        bodies = self.tables.write(self.rows.join(wanted, "doc_id").mapInArrow(right_texts, "node long, text string").dropDuplicates(["node"]), "bodies")
        parts = close.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / HUB_LEAVES).cast("int").alias("parts"))
        edges = close.join(parts, "v").select("u", "v", F.expr("shiftright(xxhash64(v, pmod(xxhash64(u), parts)), 1)").alias("unit"))
        leaves = edges.join(bodies.withColumnRenamed("node", "u"), "u").select("unit", "u", "v", "text")
        hubs = edges.select("unit", "v").distinct().join(bodies.withColumnRenamed("node", "v"), "v").select(
            "unit", F.lit(None).cast("long").alias("u"), "v", "text")
        told = self.tables.write(self._dealt(hubs.unionAll(leaves), "unit", "v", F.asc_nulls_first("u")).mapInArrow(
            lambda b: verified(b, least), "u long, v long, ok boolean"), "verified")
        links = told.where("ok").select("u", "v")
        failed = told.where("NOT ok").select("u", "v")
        if failed.isEmpty():
            return links
        return links.unionAll(self.tables.write(self._settled(close, links, failed, bodies), "settled"))

    def _settled(self, close: DataFrame, links: DataFrame, failed: DataFrame, bodies: DataFrame) -> DataFrame:
        least = self.method.least
        group = labels(components(close, SharedTables(self.spark, "close-groups")), "node", "grp")
        piece = labels(components(links, SharedTables(self.spark, "pieces")), "node", "label")
        open_groups = failed.select(F.col("u").alias("node")).join(group, "node").select("grp").distinct()
        nodes = self.tables.write(
            group.join(open_groups, "grp").join(piece, "node", "left").select("grp", "node", F.coalesce("label", "node").alias("label")), "open")
        counted = nodes.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("n"))
        whole = counted.groupBy("grp").agg(
            F.sum("n").alias("all"), F.max(F.struct("n", "label")).alias("top")).select(
            "grp", F.expr(f"cast(ceil(all / {SETTLE_ROWS}) AS int)").alias("parts"), F.col("top.label").alias("main"),
            F.expr(f"cast(ceil((all - top.n) / {SETTLE_ROWS}) AS int)").alias("asking")).where("asking > 0")
        mine = nodes.join(whole, "grp")
        rest = mine.withColumn("a", F.expr("pmod(xxhash64(node), parts)")).withColumn("b", F.explode(F.expr("sequence(0L, asking - 1L)")))
        asks = mine.where("label <> main").withColumn("a", F.explode(F.expr("sequence(0L, parts - 1L)"))).withColumn("b", F.expr("pmod(xxhash64(node, 1), asking)"))
        both = rest.select("grp", "a", "b", F.lit(0).alias("asks"), "node", "label").unionAll(
            asks.select("grp", "a", "b", F.lit(1).alias("asks"), "node", "label"))
        rows = both.join(bodies, "node").select(F.xxhash64("grp", "a", "b").alias("unit"), "asks", "node", "label", "text")
        return self._dealt(rows, "unit").mapInArrow(lambda b: settled(b, least), "u long, v long").distinct()

    def labelled(self) -> DataFrame:
        """doc_id, tag, n, component_id: one row per document; the tag, a hash of the text, tells rows of one doc_id apart."""
        stars = components(self.links, SharedTables(self.spark, "alike"))
        rooted = self.classes.join(stars.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select(
            "digest", "least", F.coalesce("root", "node").alias("root"))
        named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        found = self.tables.write(rooted.join(named, "root").select("digest", "component_id"), "named")
        return self.documents.join(found, "digest", "left").select(
            F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "tag", "n",
            F.nullif(F.coalesce("component_id", "doc_id"), F.lit(NO_ID)).alias("component_id"))


def labels(stars: DataFrame, node: str, label: str) -> DataFrame:
    """All nodes of the edges with the smallest node of their component."""
    return stars.select(F.col("u").alias(node), F.col("v").alias(label)).unionAll(
        stars.select(F.col("v").alias(node), F.col("v").alias(label)).distinct())


def right_texts(batches):
    """node, text: of rows with a wanted doc_id, those whose set of shingles is the wanted one."""
    known = WordHashes()
    for batch in batches:
        columns = {n: batch.column(n).to_pylist() for n in ("node", "text", "digest")}
        good = [(n, t) for n, t, d in zip(*columns.values()) if xxhash.xxh3_128_digest(shingles(t, known).tobytes()) == d]
        if good:
            yield record("node long, text string", *map(list, zip(*good)))
