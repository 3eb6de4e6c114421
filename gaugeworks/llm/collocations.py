"""Phrase collocations: candidates by Apriori, counted with double-array tries that all positions of a text walk at once.

A phrase can be frequent only if its parts are. Candidates of k words are therefore taken from places where both phrases of
k - 1 words are candidates. What is frequent there is first screened by hash: each task counts the hashes of its k-word
places, hashes are summed in buckets, and those that reach the least count become a bitmap of fixed size. A bitmap only ever
lets too much through.

Counting takes one more pass, however many candidates there are. The phrases of a chunk of texts that pass all bitmaps are built
into double-array tries of at most `TRIE_PHRASES`. A word is two symbols of ten bits (its number in the trie), so nodes stay
narrow. A state starts at every position of the chunk and all advance with one array operation per level; the states that accept
are counted with bincount. The chunks' counts are summed by phrase, and what stays below the least count goes.
"""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks.llm.arrays import GOLDEN, WordHashes, by_key, mixed, packed, record, runs_of, unpacked
from gaugeworks.llm.common import SLICE_ROWS, SharedTables

LEAST = 10
MOST_WORDS = 3
FIRST = 2_000
ABSORBED_PERCENT = 50
TRIE_PHRASES = 500_000
HASH_BITS, SLOT_BITS = 48, 26
HELD_WORDS = 300_000
CHUNK_WORDS = 1 << 20
SYMBOL_BITS = 10
RANK_SALTS = 64
BATCH_ROWS = 1 << 16
NARROW = 16

BREAK = b"\xff"  # no byte of UTF-8
# A-Z lower-cased, tabs as spaces, ends of pieces as BREAK; all other bytes stay.
PIECES = bytes(
    c + 32 if 65 <= c <= 90 else 32 if c == 9 else 255 if c in b".,;:!?" or 10 <= c <= 13 else c for c in range(256))


def spoken(text: str | None) -> list[bytes]:
    """The words of a text in order, with BREAK between pieces."""
    return (text or "").encode("utf-8", "surrogatepass").translate(PIECES).replace(BREAK, b" \xff ").split()


def chunks(batches):
    """(language, words of many texts with BREAK after each text): CHUNK_WORDS or so are held at a time, in all languages."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for piece in (batch.slice(at, SLICE_ROWS) for batch in batches for at in range(0, batch.num_rows, SLICE_ROWS)):
        for lang, text in zip(*(c.to_pylist() for c in piece.columns)):
            words = held.setdefault(lang, [])
            size -= len(words)
            words += spoken(text)
            words.append(BREAK)
            size += len(words)
            if size >= CHUNK_WORDS:
                largest = max(held, key=lambda k: len(held[k]))
                words = held.pop(largest)
                size -= len(words)
                yield largest, words
    while held:
        yield held.popitem()


def hashed_words(lang: str, words: list[bytes], known: WordHashes) -> np.ndarray:
    """The hash of each word, also by language; zero for BREAK."""
    found = known.of(words)
    return np.where(found == np.uint64(known[BREAK]), np.uint64(0), mixed(found ^ np.uint64(zlib.crc32(lang.encode()))) | np.uint64(1))


def longer(hashes: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """The hash of `size` words from each place on, from that of one word less; zero where they are not in one piece."""
    if len(first) < 2:
        return np.zeros(0, dtype=np.uint64)
    left, last = first[:-1], hashes[size - 1 : size - 1 + len(first) - 1]
    joined = mixed(left * GOLDEN + last) | np.uint64(1)
    return np.where((left != 0) & (last != 0), joined, np.uint64(0))


def slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def passing(hashes: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    at = slots(hashes)
    return (hashes != 0) & ((bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


def screened(lang: str, words: list[bytes], bitmaps: list[np.ndarray], known: WordHashes) -> tuple[list[np.ndarray], np.ndarray]:
    """For two words and more, the hashes of the places that pass the bitmaps so far; and those to be screened next.

    A place of k words is safe if both of its parts of k - 1 words are.
    """
    single = hashed_words(lang, words, known)
    found, current = [], single
    for size in range(2, len(bitmaps) + 3):
        current = longer(single, current, size)
        if size > len(bitmaps) + 1:
            break
        current = np.where(passing(current, bitmaps[size - 2]), current, np.uint64(0))
        found.append(current)
        # The next size needs both parts, and the second part's place is one further on.
        current = np.where(np.r_[current[1:] != 0, False], current, np.uint64(0))
    return found, current


SCREEN = "bucket long, blob binary, lang string, word string, n long"


def screen(batches, bitmaps: list[np.ndarray], bucket_bits: int):
    """Counts of hashes by bucket and, without bitmaps yet, of words: rows of SCREEN."""
    known, counted, held = WordHashes(), {}, 0

    def words_so_far():
        for lang, counts in counted.items():
            yield record(SCREEN, None, None, [lang] * len(counts), [w.decode("utf-8", "surrogatepass") for w in counts], list(counts.values()))

    for lang, words in chunks(batches):
        if not bitmaps:
            own = counted.setdefault(lang, Counter())
            own.update(words)
            del own[BREAK]
            if sum(map(len, counted.values())) > HELD_WORDS:
                yield from words_so_far()
                counted = {}
        hashes = screened(lang, words, bitmaps, known)[1]
        values = np.sort(hashes[hashes != 0] >> np.uint64(64 - HASH_BITS)).astype(np.int64)
        starts, sizes = runs_of(values)
        values = values[starts]
        buckets, blobs = values >> (HASH_BITS - bucket_bits), []
        begin, count = runs_of(buckets)
        for a, n in zip(begin.tolist(), count.tolist()):
            blobs.append(packed(np.diff(values[a : a + n], prepend=0), sizes[a : a + n]))
        if blobs:
            yield record(SCREEN, buckets[begin], blobs, None, None, None)
    yield from words_so_far()


def frequent_slots(batches, least: int, bucket_bits: int):
    """bucket, bits: for each bucket its part of the bitmap of hashes that reach the least count."""
    width = SLOT_BITS - bucket_bits
    for bucket, blobs in by_key(batches):
        parts = [unpacked(b, 2) for (b,) in blobs]
        values, counts = (np.concatenate(c) for c in zip(*((np.cumsum(v), n) for v, n in parts)))
        order = np.argsort(values, kind="stable")
        starts, _ = runs_of(values[order])
        often = values[order][starts][np.add.reduceat(counts[order], starts) >= least]
        flags = np.zeros(1 << width, dtype=np.uint8)
        flags[(often >> (HASH_BITS - SLOT_BITS)) - (bucket << width)] = 1
        yield record("bucket long, bits binary", [bucket], [np.packbits(flags, bitorder="little").tobytes()])


def candidates(words: list[bytes], found: list[np.ndarray]) -> pa.Array:
    """The distinct phrases of a chunk that pass all bitmaps: two words and more, from the hashes by place."""
    coded = pa.array(words, type=pa.binary()).dictionary_encode()
    codes, vocabulary = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    phrases = []
    for size, hashes in enumerate(found, 2):
        places = np.flatnonzero(hashes)
        # Numbers of words tell phrases apart, not their hashes; runs of more words than fit into 64 bits are numbered anew.
        run = codes[places]
        for i in range(1, size):
            run = run * len(vocabulary) + codes[places + i]
            _, first, run = np.unique(run, return_index=True, return_inverse=True)
        places = places[first]
        phrases.append(pc.binary_join_element_wise(*(vocabulary.take(pa.array(codes[places + i])) for i in range(size)), b" ").cast(pa.string()))
    return pa.concat_arrays(phrases)


COUNTS = "lang string, phrase string, n long"


def counts(batches, bitmaps: list[np.ndarray], trie_phrases: int, most_words: int):
    """lang, phrase, n: the phrases of a chunk that pass all bitmaps, with all their occurrences in it."""
    known = WordHashes()
    for lang, words in chunks(batches):
        phrases = candidates(words, screened(lang, words, bitmaps, known)[0])
        for at in range(0, len(phrases), trie_phrases):
            own = phrases.slice(at, trie_phrases)
            total = Trie(pa.repeat(lang, len(own)), own).count(lang, words, most_words)
            for row in range(0, len(own), BATCH_ROWS):
                part = own.slice(row, BATCH_ROWS)
                yield record(COUNTS, pa.repeat(lang, len(part)), part, total[row : row + BATCH_ROWS])


class Trie:
    """A double array over the languages and words of some phrases.

    A state is a place in the arrays: from state s, symbol c leads to t = base[s] + c if check[t] is s. State 0 has no way out.
    Each node's children need free places at a common distance; the widest nodes choose first, one by one, narrow ones all at
    once in rounds, and those with a single child fill the gaps.
    """

    def __init__(self, langs: pa.Array, phrases: pa.Array):
        """Words are numbered from one on, so no way leads on from an unknown word. Phrases stay in Arrow arrays, as there are many."""
        split = pc.split_pattern(phrases, " ")
        coded, coded_langs = split.flatten().dictionary_encode(), langs.dictionary_encode()
        self.words = {w.encode("utf-8", "surrogatepass"): i for i, w in enumerate(coded.dictionary.to_pylist(), 1)}
        self.langs = {lang: i for i, lang in enumerate(coded_langs.dictionary.to_pylist(), 1)}
        self.size = len(phrases)
        lengths = np.diff(split.offsets.to_numpy()).astype(np.int64)
        self.digits = max(1, -(-max(len(self.words), len(self.langs)).bit_length() // SYMBOL_BITS))
        table = np.zeros((self.size, 1 + int(lengths.max(initial=0))), dtype=np.int64)
        table[:, 0] = coded_langs.indices.to_numpy() + 1
        row = np.repeat(np.arange(self.size), lengths)
        column = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + 1
        table[row, column] = coded.indices.to_numpy() + 1
        self._build(table, lengths + 1)

    def symbols(self, numbers: np.ndarray) -> list[np.ndarray]:
        """The symbols of numbers, from the highest digit to the lowest."""
        return [numbers >> (SYMBOL_BITS * d) & ((1 << SYMBOL_BITS) - 1) for d in range(self.digits - 1, -1, -1)]

    def _build(self, table: np.ndarray, lengths: np.ndarray) -> None:
        width = 1 << SYMBOL_BITS
        columns = [s for c in range(table.shape[1]) for s in self.symbols(table[:, c])]
        capacity = 4 * width
        self.base, self.check, used = np.zeros(capacity, dtype=np.int64), np.zeros(capacity, dtype=np.int64), np.zeros(capacity, dtype=bool)
        used[:width] = True  # so that a base is never negative; the root is state 1
        state, draw = np.ones(len(table), dtype=np.int64), np.random.default_rng(0)
        self.accepts = np.full(capacity, -1, dtype=np.int64)

        def grown(size: int) -> None:
            nonlocal used
            more = max(size, 2 * len(used)) - len(used)
            self.base, self.check = np.r_[self.base, np.zeros(more, dtype=np.int64)], np.r_[self.check, np.zeros(more, dtype=np.int64)]
            self.accepts, used = np.r_[self.accepts, np.full(more, -1, dtype=np.int64)], np.r_[used, np.zeros(more, dtype=bool)]

        filled = 3 * width
        for level, symbol in enumerate(columns):
            active = np.flatnonzero(lengths * self.digits > level)
            if not len(active):
                break
            pairs, which = np.unique(state[active] * width + symbol[active], return_inverse=True)
            parents, kids = pairs // width, pairs % width
            starts, sizes = runs_of(parents)
            for node in np.argsort(-sizes, kind="stable")[: np.count_nonzero(sizes > NARROW)].tolist():
                own = kids[starts[node] : starts[node] + sizes[node]]
                tries = draw.integers(width, filled - width + 1, 32)
                if len(used) < filled + 2 * width:
                    grown(filled + 2 * width)
                fits = np.flatnonzero(~used[tries[:, None] + own].any(axis=1))
                if len(fits):
                    base = int(tries[fits[0]])
                else:
                    base, filled = filled, filled + width
                    if len(used) < filled + 2 * width:
                        grown(filled + 2 * width)
                self.base[parents[starts[node]]] = base
                used[base + own] = True
            narrow = np.flatnonzero((sizes > 1) & (sizes <= NARROW))
            while len(narrow):
                # All draw a place at once; those that meet others or used places draw again.
                owner = np.repeat(np.arange(len(narrow)), sizes[narrow])
                firsts = np.cumsum(sizes[narrow]) - sizes[narrow]
                base = draw.integers(width, filled - width + 1, len(narrow))
                to = base[owner] + kids[starts[narrow][owner] + np.arange(len(owner)) - firsts[owner]]
                claims = np.zeros(len(used), dtype=np.int32)
                claims[to] = owner
                good = np.logical_and.reduceat(~used[to] & (claims[to] == owner), firsts)
                self.base[parents[starts[narrow[good]]]] = base[good]
                used[to[good[owner]]] = True
                narrow = narrow[~good]
                if np.count_nonzero(good) < len(good) // 4 + 1:
                    filled += len(owner) + width
                    if len(used) < filled + 2 * width:
                        grown(filled + 2 * width)
            lone = starts[sizes == 1]
            free = np.flatnonzero(~used[2 * width : filled]) + 2 * width
            if len(free) < len(lone):
                end = filled
                filled += len(lone) - len(free) + width
                if len(used) < filled + 2 * width:
                    grown(filled + 2 * width)
                free = np.r_[free, np.flatnonzero(~used[end:filled]) + end]
            place = free[: len(lone)]
            self.base[parents[lone]] = place - kids[lone]
            used[place] = True
            to = self.base[parents] + kids
            self.check[to] = parents
            state[active] = to[which]
            last = active[lengths[active] * self.digits == level + 1]
            self.accepts[state[last]] = last
        end = filled + 2 * width
        if len(used) < end:
            grown(end)
        self.base, self.check, self.accepts = (a[:end].astype(np.int32) for a in (self.base, self.check, self.accepts))

    def advanced(self, states: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """The states after one more word (or language) each; 0 where there is no way."""
        for symbol in self.symbols(numbers):
            to = self.base[states] + symbol
            states = np.where(self.check[to] == states, to, 0)
        return states

    def count(self, lang: str, words: list[bytes], most_words: int) -> np.ndarray:
        """Occurrences of each phrase, by its place in the list the trie was built from."""
        total = np.zeros(self.size, dtype=np.int64)
        if lang not in self.langs:
            return total
        get = self.words.get
        numbers = np.array([get(w, 0) for w in words], dtype=np.int64)
        root = self.advanced(np.ones(1, dtype=np.int64), np.array([self.langs[lang]]))
        at = np.flatnonzero(numbers)
        states = np.repeat(root, len(at))
        for level in range(most_words):
            inside = at + level < len(numbers)
            at, states = at[inside], states[inside]
            states = self.advanced(states, numbers[at + level])
            alive = states != 0
            at, states = at[alive], states[alive]
            phrases = self.accepts[states]
            total += np.bincount(phrases[phrases >= 0], minlength=len(total))
        return total


def least_score(parts: list[tuple[str, str]]):
    """SQL for the lowest score floor(1000000 * a * a / (l * r)) over the cuts (columns of l and r), and for its l and r.

    Whole numbers of 38 digits: exact for up to 10 to the power 16 occurrences.
    """
    wide = "cast({} AS decimal(19, 0))".format
    cuts = [
        f"struct(cast((1000000 * ({wide('a')} * {wide('a')})) div ({wide(left)} * {wide(right)}) AS long) AS score, {k} AS k, {left} AS l, {right} AS r)"
        for k, (left, right) in enumerate(parts, 1)]
    return F.expr(cuts[0] if len(cuts) == 1 else f"least({', '.join(cuts)})")


class Collocations:
    """Phrase counts and collocations of `docs` (text, lang), per language.

    A null text counts as empty and a null language as `und`. Texts are read whole; repeated rows count again. An empty table
    gives empty results. `most_words` is 2 or more.
    """

    def __init__(
        self, docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, trie_phrases: int = TRIE_PHRASES,
        lang_col: str = "lang", text_col: str = "text",
    ):
        self.spark, self.tables = docs.sparkSession, SharedTables(docs.sparkSession, "collocations")
        self.least, self.most_words, self.trie_phrases = least, most_words, trie_phrases
        self.rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        # Partitions of a scan have a bounded size, so buckets stay bounded where their number follows that of partitions.
        self.bucket_bits = bucket_bits = min(16, max(4, (2 * self.rows.rdd.getNumPartitions()).bit_length()))
        bitmaps: list[np.ndarray] = []
        for size in range(2, most_words + 1):
            shared = self.spark.sparkContext.broadcast(list(bitmaps))
            table = self.rows.mapInArrow(lambda b, maps=shared: screen(b, maps.value, bucket_bits), SCREEN)
            if not bitmaps:
                table = self.tables.write(table.withColumn("kind", F.when(F.col("bucket").isNull(), "word").otherwise("blob")), "screen", "kind")
                counted = self.tables.write(table.where("kind = 'word'").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
                self.tables.drop("screen/kind=word")
                table = table.where("kind = 'blob'")
            bitmaps.append(self._bitmap(table, size))
            self.tables.drop("screen")
        self.totals = counted.groupBy("lang").agg(F.sum("n").alias("n"))
        self.words = counted.where(F.col("n") >= least)
        self.phrases = self._counted(bitmaps)

    def _bitmap(self, table: DataFrame, size: int) -> np.ndarray:
        """Where the hashes lie that reach the least count; the driver holds one such map per size, whatever the data."""
        bits, least = self.bucket_bits, self.least
        blobs = table.where("bucket IS NOT NULL").select("bucket", "blob").repartition("bucket").sortWithinPartitions("bucket")
        bitmap = np.zeros((1 << SLOT_BITS) // 8, dtype=np.uint8)
        width = len(bitmap) >> bits
        flags = self.tables.write(blobs.mapInArrow(lambda b: frequent_slots(b, least, bits), "bucket long, bits binary"), f"bitmap-{size}")
        for bucket, part in flags.collect():
            bitmap[bucket * width : (bucket + 1) * width] = np.frombuffer(bytes(part), dtype=np.uint8)
        return bitmap

    def _counted(self, bitmaps: list[np.ndarray]) -> DataFrame:
        """lang, phrase, n: the frequent phrases of two words and more."""
        shared, most_words, trie_phrases = self.spark.sparkContext.broadcast(bitmaps), self.most_words, self.trie_phrases
        counted = self.rows.mapInArrow(lambda b: counts(b, shared.value, trie_phrases, most_words), COUNTS)
        return self.tables.write(counted.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= self.least), "phrases")

    def scored(self) -> DataFrame:
        """lang, phrase, a, l, r, n, score: all frequent phrases of two words and more that no longer one absorbs."""
        every = self.words.select("lang", F.col("word").alias("phrase"), "n").unionAll(self.phrases)
        result = None
        for size in range(2, self.most_words + 1):
            own = self.phrases.where(F.size(F.split("phrase", " ")) == size).select("lang", "phrase", F.col("n").alias("a"))
            words = "split(phrase, ' ')"
            for k in range(1, size):
                for side, cut in ((f"l{k}", f"array_join(slice({words}, 1, {k}), ' ')"), (f"r{k}", f"array_join(slice({words}, {k + 1}, {size - k}), ' ')")):
                    part = every.select("lang", F.col("phrase").alias("part"), F.col("n").alias(side))
                    own = own.withColumn("part", F.expr(cut)).join(part, ["lang", "part"]).drop("part")
            own = own.withColumn("cut", least_score([(f"l{k}", f"r{k}") for k in range(1, size)])).select(
                "lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
            result = own if result is None else result.unionAll(own)
        return result.join(self._absorbed(), ["lang", "phrase"], "left_anti").join(self.totals, "lang").select(
            "lang", "phrase", "a", "l", "r", "n", "score")

    def _absorbed(self) -> DataFrame:
        """lang, phrase: those inside a longer one that is ABSORBED_PERCENT of them or more."""
        words = "split(phrase, ' ')"
        inner = self.phrases.where(F.expr(f"size({words}) > 2")).select("lang", F.col("n").alias("longer"), F.explode(F.expr(
            f"array_distinct(flatten(transform(sequence(2, size({words}) - 1), k -> "
            f"transform(sequence(1, size({words}) - k + 1), i -> array_join(slice({words}, i, k), ' ')))))")).alias("phrase"))
        most = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
        return self.phrases.join(most, ["lang", "phrase"]).where(F.expr(f"100 * longer >= {ABSORBED_PERCENT} * n")).select("lang", "phrase")

    def best(self, first: int = FIRST) -> DataFrame:
        """lang, rank, phrase, a, l, r, n, score: each language's first by score, then a, both descending, then phrase."""
        place = [F.desc("score"), F.desc("a"), F.asc("phrase")]
        salted = self.scored().withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(RANK_SALTS)))
        fewer = salted.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*place))).where(F.col("rank") <= first)
        ranked = fewer.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*place))).where(F.col("rank") <= first)
        return ranked.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
