"""Ranked lexical search with pair-bound MaxScore.

Index: documents are cut into segments in the order they are read. A segment is one row: the ids and lengths of its documents,
its vocabulary, and a posting list (document, occurrences) per term. Nothing is shuffled, and every document is indexed whole.

Queries come in blocks. For the terms of a block, document frequencies are summed over all segments. Then each segment turns
the posting lists of these terms into impacts (what the term adds to a score) and intersects the lists of its `PAIR_TERMS` most
frequent ones of them pair by pair. A pair's list keeps the largest joint impact, what both terms add together in one document,
and the documents that come closest to it. Both are written beside the impacts, before any query runs.

Search: no document that only has the weakest terms of a query can enter its best results if a bound on their sum is below the
result that is in last place. MaxScore takes the sum of the terms' maxima as that bound. Here two terms count with the larger
of their maxima and their joint maximum, which is less than the sum wherever no document has both at their best, so more terms
are skipped. Documents of the other terms are candidates; the weak terms are looked up for candidates alone, which are dropped
as soon as the bound on what is left cannot lift them to the last place. The first threshold comes from the documents of a
pair's list. A task carries its best results from segment to segment.
"""

import math
from collections import Counter
from itertools import chain, combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks.llm.arrays import opened, packed, record, squeezed, unpacked
from gaugeworks.llm.common import SharedTables, texts

# Digits, letters and all beyond ASCII make terms; everything else parts them.
LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SEGMENT_DOCS = 8_192
SEGMENT_BYTES = 16 << 20
PAIR_TERMS = 96
PAIR_DOCS = 16
BEST = 10
BLOCK_ITEMS = 1_000
BLOCK_BYTES = 16 << 20
NO_ID = -(1 << 63)
MERGE_SALTS = 64

SEGMENT = "docs long, words long, ids binary, vocabulary binary, sizes binary, postings binary"
IMPACTS = "ids binary, lists binary, postings binary, pairs binary, heads binary"


def terms(text: str) -> list[bytes]:
    """The terms of a text, with repeats; A-Z alone are lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(LETTERS).split()


def segments(batches):
    """Rows of SEGMENT: `docs` counts the documents with a term, `words` their terms with repeats."""
    ids, lengths, found, times, kinds, size = [], [], [], [], [], 0

    def closed():
        vocabulary: dict[bytes, int] = {}
        number = np.fromiter((vocabulary.setdefault(t, len(vocabulary)) for t in chain.from_iterable(found)), dtype=np.int64, count=sum(kinds))
        owner = np.repeat(np.arange(len(ids)), kinds)
        order = np.argsort(number, kind="stable")
        counts = np.bincount(number, minlength=len(vocabulary))
        occurrences = np.fromiter(chain.from_iterable(times), dtype=np.int64, count=len(number))
        whole = np.array(lengths)
        return record(
            SEGMENT, [int(np.count_nonzero(whole))], [int(whole.sum())], [packed(np.array(ids), whole)],
            [squeezed(b" ".join(vocabulary))], [packed(counts)], [packed(owner[order], occurrences[order])])

    for batch in batches:
        for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
            own = terms(text)
            counted = Counter(own)
            ids.append(NO_ID if doc_id is None else doc_id)
            lengths.append(len(own))
            found.append(list(counted))
            times.append(list(counted.values()))
            kinds.append(len(counted))
            size += len(text)
            if len(ids) >= SEGMENT_DOCS or size >= SEGMENT_BYTES:
                yield closed()
                ids, lengths, found, times, kinds, size = [], [], [], [], [], 0
    if ids:
        yield closed()


def weight(documents: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


def present(vocabulary: bytes, wanted: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Places in a segment's vocabulary of the wanted terms, and the numbers of these."""
    get = wanted.get
    pairs = [(place, number) for place, term in enumerate(opened(vocabulary).split(b" ")) if (number := get(term)) is not None]
    both = np.array(pairs, dtype=np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def frequencies(batches, wanted: dict[bytes, int]):
    """number, documents: in how many documents of the task each wanted term is."""
    total = np.zeros(len(wanted), dtype=np.int64)
    for batch in batches:
        for vocabulary, sizes in zip(*(c.to_pylist() for c in batch.columns)):
            places, numbers = present(vocabulary, wanted)
            total[numbers] += unpacked(sizes, 1)[0][places]
    some = np.flatnonzero(total)
    yield record("number long, documents long", some, total[some])


def impacts(batches, wanted: dict[bytes, int], weights: np.ndarray, documents: int, words: int):
    """Rows of IMPACTS, one per segment: the impacts of the wanted terms, and the lists of pairs of the most frequent."""
    for batch in batches:
        for ids, vocabulary, sizes, postings in zip(*(c.to_pylist() for c in batch.columns)):
            places, numbers = present(vocabulary, wanted)
            if not len(places):
                continue
            doc_ids, lengths = unpacked(ids, 2)
            counts = unpacked(sizes, 1)[0]
            starts = np.cumsum(counts) - counts
            owner, times = unpacked(postings, 2)
            spots = np.concatenate([np.arange(a, a + n) for a, n in zip(starts[places], counts[places])])
            owner, times, held = owner[spots], times[spots], counts[places]
            norm = 10 + 90 * lengths * documents // words
            added = np.repeat(weights[numbers], held) * (1_000_000_000 * times // (1000 * times + 8 * norm[owner]))
            pairs, heads = joint(owner, added, held, len(doc_ids))
            yield record(IMPACTS, [packed(doc_ids)], [packed(numbers, held)], [packed(owner, added)], [packed(*pairs)], [packed(heads)])


def joint(owner: np.ndarray, added: np.ndarray, held: np.ndarray, docs: int):
    """(first list, second list, joint maximum) of each pair of the PAIR_TERMS longest lists, and PAIR_DOCS documents of each.

    A pair that no document has comes with a joint maximum of zero. Fewer documents are filled up with -1.
    """
    chosen = np.sort(np.argsort(-held, kind="stable")[:PAIR_TERMS])
    starts = np.cumsum(held) - held
    dense = np.zeros((len(chosen), docs), dtype=np.int64)
    for row, k in enumerate(chosen.tolist()):
        dense[row, owner[starts[k] : starts[k] + held[k]]] = added[starts[k] : starts[k] + held[k]]
    first, second, most, heads = [], [], [], []
    for row in range(len(chosen) - 1):
        here = np.flatnonzero(dense[row])
        others = dense[row + 1 :, here]
        sums = np.where(others > 0, others + dense[row, here], 0)
        if not len(here):
            sums, here = np.zeros((len(others), 1), dtype=np.int64), np.array([-1])
        few = min(PAIR_DOCS, len(here))
        top = np.argpartition(sums, len(here) - few, axis=1)[:, len(here) - few :]
        best = np.take_along_axis(sums, top, axis=1)
        listed = np.full((len(others), PAIR_DOCS), -1, dtype=np.int64)
        listed[:, :few] = np.where(best > 0, here[top], -1)
        first.append(np.full(len(others), chosen[row]))
        second.append(chosen[row + 1 :])
        most.append(best.max(axis=1))
        heads.append(listed.ravel())
    if not first:
        return (np.zeros(0, dtype=np.int64),) * 3, np.zeros(0, dtype=np.int64)
    return tuple(map(np.concatenate, (first, second, most))), np.concatenate(heads)


class Lists:
    """What a segment has for a block of queries."""

    def __init__(self, ids, lists, postings, pairs, heads):
        self.ids = unpacked(ids, 1)[0]
        numbers, held = unpacked(lists, 2)
        owner, added = unpacked(postings, 2)
        ends = np.cumsum(held).tolist()
        self.place = {n: i for i, n in enumerate(numbers.tolist())}
        self.docs = [owner[a:b] for a, b in zip([0, *ends], ends)]
        self.added = [added[a:b] for a, b in zip([0, *ends], ends)]
        self.most = [int(a.max()) for a in self.added]
        first, second, most = unpacked(pairs, 3)
        heads = unpacked(heads, 1)[0].reshape(-1, PAIR_DOCS)
        self.pairs = {(a, b): (m, k) for k, (a, b, m) in enumerate(zip(first.tolist(), second.tolist(), most.tolist()))}
        self.heads, self.paired = heads, {*first.tolist(), *second.tolist()}

    def bounds(self, order: list[int]) -> list[int]:
        """For each number of the first lists of `order`, a bound on what a document can get from them.

        A list is joined with the earlier free one with which it saves most against the sum of the two maxima.
        """
        out, free, total = [], [], 0
        for at in order:
            total += self.most[at]
            if at in self.paired:
                less = [self.most[at] + self.most[o] - max(self.most[at], self.most[o], self.pairs[min(at, o), max(at, o)][0]) for o in free]
                saved = max(less, default=0)
                if saved > 0:
                    free.pop(less.index(saved))
                    total -= saved
                else:
                    free.append(at)
            out.append(total)
        return out

    def looked_up(self, at: int, docs: np.ndarray) -> np.ndarray:
        """What a list adds to each of some documents."""
        own = self.docs[at]
        spot = np.minimum(np.searchsorted(own, docs), len(own) - 1)
        return np.where(own[spot] == docs, self.added[at][spot], 0)

    def first_threshold(self, order: list[int], best: int) -> int:
        """The score that `best` documents from lists of the query's pairs reach for sure; zero if there are not so many."""
        mine = sorted(at for at in order if at in self.paired)
        known = sorted((self.pairs[p] for p in combinations(mine, 2)), reverse=True)[:PAIR_DOCS]
        if not known:
            return 0
        docs = np.unique(self.heads[[k for _, k in known]])
        docs = docs[docs >= 0]
        if len(docs) < best:
            return 0
        scores = sum(self.looked_up(at, docs) for at in order)
        return int(np.partition(scores, len(scores) - best)[len(scores) - best])

    def search(self, wanted: list[int], best: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and documents that may be among the `best`: all with a score of at least `threshold` are, if they are."""
        order = sorted((self.place[n] for n in wanted if n in self.place), key=lambda at: self.most[at])
        if not order:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        threshold = threshold or max(1, self.first_threshold(order, best))
        bounds = self.bounds(order)
        weak = sum(b < threshold for b in bounds)
        scores = np.zeros(len(self.ids), dtype=np.int64)
        for at in order[weak:]:
            scores[self.docs[at]] += self.added[at]
        found = np.flatnonzero(scores)
        sums = scores[found]
        for turn in range(weak - 1, -1, -1):
            if len(found) >= best:
                threshold = max(threshold, int(np.partition(sums, len(sums) - best)[len(sums) - best]))
            stay = sums + bounds[turn] >= threshold
            found, sums = found[stay], sums[stay]
            if not len(found):
                break
            sums = sums + self.looked_up(order[turn], found)
        stay = sums >= max(1, threshold)
        return sums[stay], self.ids[found[stay]]


def firsts(scores: np.ndarray, ids: np.ndarray, best: int) -> tuple[np.ndarray, np.ndarray]:
    """The best by score, equal ones by id."""
    order = np.lexsort((ids, -scores))[:best]
    return scores[order], ids[order]


def searched(batches, queries: list[tuple[int, list[int]]], best: int):
    """item, doc_id, score: the best results of a task's segments for each query (item, terms' numbers)."""
    none = np.zeros(0, dtype=np.int64)
    held = {item: (none, none) for item, _ in queries}
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            lists = Lists(*row)
            for item, wanted in queries:
                scores, ids = held[item]
                more, new = lists.search(wanted, best, int(scores[-1]) if len(scores) == best else 0)
                if len(more):
                    held[item] = firsts(np.r_[scores, more], np.r_[ids, new], best)
    sizes = [len(s) for s, _ in held.values()]
    if sum(sizes):
        yield record(
            "item long, doc_id long, score long", np.repeat(list(held), sizes),
            np.concatenate([i for _, i in held.values()]), np.concatenate([s for s, _ in held.values()]))


def blocks(items: DataFrame):
    """Lists of (item_id, distinct terms), at most BLOCK_ITEMS items and about BLOCK_BYTES of text each, one item at least."""
    held, size = [], 0
    for item_id, text in items.toLocalIterator():
        held.append((item_id, list(dict.fromkeys(terms(text or "")))))
        size += len(text or "")
        if len(held) >= BLOCK_ITEMS or size >= BLOCK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


class Index:
    """An index of `docs` (doc_id, text) in the shared folder.

    Null texts and texts without terms are in no result and in no count. Repeated rows are documents of their own; a null
    doc_id comes before any other among equal scores. An empty table gives empty results.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        self.spark, self.tables = docs.sparkSession, SharedTables(docs.sparkSession, "search")
        self.segments = self.tables.write(texts(docs, id_col, text_col).mapInArrow(segments, SEGMENT), "segments")
        self.documents, self.words = (int(n or 0) for n in self.segments.agg(F.sum("docs"), F.sum("words")).first())

    def search(self, items: DataFrame, best: int = BEST) -> DataFrame:
        """item_id, rank, doc_id, score: the `best` documents of each item (item_id, text), highest first, then by doc_id.

        Rows that repeat an item_id are answered one by one. Items without terms, or whose terms no document has, have no rows.
        """
        schema, parts = "item_id long, rank int, doc_id long, score long", []
        for number, block in enumerate(blocks(items.select(F.col("item_id").cast("long"), "text")) if self.documents else []):
            parts.append(self._block(block, number, best))
        if not parts:
            return self.spark.createDataFrame([], schema)
        result = parts[0]
        for part in parts[1:]:
            result = result.unionAll(part)
        return result

    def _block(self, block: list, number: int, best: int) -> DataFrame:
        wanted: dict[bytes, int] = {}
        queries = [(item, [wanted.setdefault(t, len(wanted)) for t in own]) for item, (_, own) in enumerate(block)]
        shared = self.spark.sparkContext.broadcast(wanted)  # at most BLOCK_BYTES of terms, or one item's
        counted = self.segments.select("vocabulary", "sizes").mapInArrow(
            lambda b: frequencies(b, shared.value), "number long, documents long").groupBy("number").agg(F.sum("documents").alias("documents"))
        weights = np.zeros(len(wanted), dtype=np.int64)
        for term, found in counted.collect():  # at most one row per term of the block
            weights[term] = weight(self.documents, found)
        documents, words = self.documents, self.words
        weighted = self.tables.write(
            self.segments.select("ids", "vocabulary", "sizes", "postings").mapInArrow(
                lambda b: impacts(b, shared.value, weights, documents, words), IMPACTS), f"impacts-{number}")
        asked = self.spark.sparkContext.broadcast(queries)
        found = weighted.mapInArrow(lambda b: searched(b, asked.value, best), "item long, doc_id long, score long")
        # Each task sends its best alone; they are cut once more by salt before the rows of an item meet.
        place = [F.desc("score"), F.asc("doc_id")]
        salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(MERGE_SALTS)))
        fewer = salted.withColumn("rank", F.row_number().over(W.partitionBy("item", "salt").orderBy(*place))).where(F.col("rank") <= best)
        ranked = fewer.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*place))).where(F.col("rank") <= best)
        names = self.spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], "item long, item_id long")
        return ranked.join(names, "item").select(
            "item_id", F.col("rank").cast("int"), F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "score")
