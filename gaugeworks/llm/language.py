"""Language identification with spans.

Words are cut by letters. The script of a word narrows its candidate languages to those seen in that script in training.
Each candidate gets a score for the word from hashed character trigrams and the word itself (naive Bayes, centred and
clipped), all new words of some hundred texts at once. Viterbi over the words, with a penalty for each switch, labels spans of mixed-language text.

Most texts have one language. Staying with the best is optimal if no interval of words gains more than the penalty in another
language, and no first words and last words together: a path that visits the best label pays the penalty for each other
interval, and one that never does pays for all but one of them, of which one begins and one ends the text. That is a
cumulative sum and a running minimum; only the other texts go through the dynamic programme.
"""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import SLICE_ROWS, map_batches

UNKNOWN = "und"
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
BUCKETS = 1 << 16
TRAIN_ROWS = 4000
CLIP, PENALTY = 4.0, 12.0
SCRIPT_SHARE = 0.001
CACHE_WORDS = 300_000

# First code points of the script ranges that are told apart, in order; what lies between is "other".
SCRIPTS = (
    (0x0041, "latin"), (0x0250, "other"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "ethiopic"), (0x1380, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"),
    (0x3100, "han"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0xFB1D, "hebrew"), (0xFB50, "arabic"),
    (0xFE00, "other"), (0x20000, "han"),
)
STARTS = np.array([s for s, _ in SCRIPTS])
NAMES = sorted({n for _, n in SCRIPTS})
# The number of the script by how many of the first code points are not above a code point.
SCRIPT_OF = np.array([NAMES.index("other"), *(NAMES.index(n) for _, n in SCRIPTS)])


def bulk_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-case words: the buckets of their trigrams with a mark at both ends, where each word's trigrams start, the
    bucket of each whole word, and the number of its script."""
    text = "".join(["\x02" + w + "\x03" for w in words])
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    grams = scattered(codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1] * np.uint32(0x85EBCA77) + codes[2:] * np.uint32(0xC2B2AE3D))
    # A trigram lies within a word if neither of its first two code points is the mark at the end.
    grams = grams[(codes[:-2] != 3) & (codes[1:-1] != 3)]
    begins = np.cumsum(sizes + 2) - (sizes + 2)
    place = np.arange(len(codes)) - np.repeat(begins, sizes + 2)
    powers = np.cumprod(np.full(int(sizes.max()) + 2, 0x01000193, dtype=np.uint32), dtype=np.uint32)
    wholes = scattered(np.add.reduceat(codes * powers[place], begins, dtype=np.uint32))
    scripts = SCRIPT_OF[np.maximum(np.searchsorted(STARTS, codes[begins + 1], side="right"), 0)]
    return grams, np.cumsum(sizes) - sizes, wholes, scripts


def scattered(hashes: np.ndarray) -> np.ndarray:
    mixed = (hashes ^ hashes >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
    return ((mixed ^ mixed >> np.uint32(13)) % np.uint32(BUCKETS)).astype(np.int64)


class Model:
    """What training learned: the languages, the log probability of each bucket in each, and the languages of each script."""

    def __init__(self, languages: list[str], weights: np.ndarray, allowed: np.ndarray):
        """`weights`: languages by BUCKETS. `allowed`: scripts by languages; a script that was not seen allows none."""
        self.languages, self.weights, self.allowed = languages, weights, allowed
        self._by_bucket = np.ascontiguousarray(weights.T, dtype=np.float32)
        # A script without a language tells nothing: all stay candidates.
        self._candidates = np.where(allowed.any(axis=1, keepdims=True), allowed, True)
        self._place: dict[str, int] = {}
        self._table = np.zeros((0, len(languages)), dtype=np.float32)

    def parts(self) -> tuple:
        """What a broadcast carries, as plain values that any worker can read."""
        return self.languages, self.weights, self.allowed

    def _score(self, words: list[str]) -> np.ndarray:
        """A centred, clipped score of each word for each language; languages that its script rules out get the lowest."""
        grams, starts, wholes, scripts = bulk_features([w.lower() for w in words])
        raw = np.add.reduceat(self._by_bucket[grams], starts, axis=0) + self._by_bucket[wholes]
        allowed = self._candidates[scripts]
        mean = (raw * allowed).sum(axis=1, keepdims=True) / allowed.sum(axis=1, keepdims=True)
        return np.where(allowed, np.clip(raw - mean, -CLIP, CLIP), -CLIP).astype(np.float32)

    def learn_words(self, lists: list[list[str]]) -> None:
        """Score the words of some texts that have no score yet, all at once. Old words go if there are too many."""
        new = set().union(*lists).difference(self._place)
        if len(new) + len(self._place) > CACHE_WORDS:
            self._place, self._table, new = {}, self._table[:0], set().union(*lists)
        if new:
            found = list(new)
            self._place.update(zip(found, range(len(self._place), len(self._place) + len(found))))
            self._table = np.concatenate([self._table, self._score(found)])

    def scores(self, words: list[str]) -> np.ndarray:
        """The scores of words that `learn_words` has seen."""
        return self._table[np.fromiter(map(self._place.__getitem__, words), dtype=np.int64, count=len(words))]


def viterbi(scores: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best label of each row of `scores` when each change of label costs the penalty."""
    total = scores.sum(axis=0)
    best = int(total.argmax())
    gains = np.cumsum(scores - scores[:, best : best + 1], axis=0)
    lowest = np.minimum(np.minimum.accumulate(gains, axis=0), 0)
    before = np.vstack([np.zeros((1, scores.shape[1])), lowest[:-1]])
    rises = gains - before
    if rises.max() <= penalty and gains.max() + rises[-1].max() <= penalty:
        return np.full(len(scores), best)
    back, state = [], scores[0].tolist()
    count = len(state)
    for row in scores[1:].tolist():
        top = max(range(count), key=state.__getitem__)
        switch = state[top] - penalty
        back.append([i if state[i] >= switch else top for i in range(count)])
        state = [max(state[i], switch) + row[i] for i in range(count)]
    at = max(range(count), key=state.__getitem__)
    path = [at]
    for step in reversed(back):
        at = step[at]
        path.append(at)
    return np.array(path[::-1])


def label_all(texts: list[str | None], model: Model) -> list[tuple[str, float, list[dict]]]:
    """`label` of several texts, whose words are scored together."""
    lists = [WORD.findall(t or "") for t in texts]
    model.learn_words(lists)
    return [_label(t, words, model) for t, words in zip(texts, lists)]


def label(text: str | None, model: Model) -> tuple[str, float, list[dict]]:
    """The language with most letters, its score, and the spans: start and end in code points and a language each."""
    return label_all([text], model)[0]


def _label(text: str | None, words: list[str], model: Model) -> tuple[str, float, list[dict]]:
    if not words or not model.languages:
        return UNKNOWN, 0.0, []
    scores = model.scores(words)
    path = viterbi(scores)
    letters = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    shares = np.bincount(path, weights=letters, minlength=len(model.languages)) / letters.sum()
    best = int(shares.argmax())
    sums = scores[path == best].sum(axis=0, dtype=np.float64)
    rest = np.delete(sums, best)
    margin = min(30.0, float(sums[best] - rest.max())) if len(rest) else 30.0
    score = float(shares[best]) / (1 + math.exp(-max(margin, -30.0)))
    turns = np.flatnonzero(path[1:] != path[:-1]) + 1
    if not len(turns):
        first = WORD.search(text)
        spans = [{"start": first.start(), "end": text.rfind(words[-1]) + len(words[-1]), "lang": model.languages[best]}]
    else:
        places = [m.span() for m in WORD.finditer(text)]
        edges = [0, *turns.tolist(), len(places)]
        spans = [
            {"start": places[a][0], "end": places[b - 1][1], "lang": model.languages[path[a]]} for a, b in zip(edges, edges[1:])
        ]
    return model.languages[best], score, spans


def held_out():
    """Documents whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, rows_per_language: int = TRAIN_ROWS) -> Model:
    """Learn from documents (doc_id, text, lang) with a language that are not held out.

    Of each language at most about `rows_per_language` documents are read, picked by the hash of their id; their words are
    counted by Spark, and BUCKETS numbers per language come to the driver, whatever the size of the input.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    counts = {r[0]: r[1] for r in known.groupBy("lang").agg(F.count(F.lit(1))).collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((0, BUCKETS)), np.zeros((len(NAMES), 0), dtype=bool))
    share = F.create_map(*(F.lit(x) for k in languages for x in (k, min(1 << 20, (rows_per_language << 20) // counts[k]))))
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("lang")])
    number = {lang: i for i, lang in enumerate(languages)}

    def count(batches):
        sums = np.zeros((len(languages), BUCKETS + len(NAMES)), dtype=np.int64)
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                words = WORD.findall(text.lower())
                if words:
                    grams, _, wholes, scripts = bulk_features(words)
                    row = sums[number[lang]]
                    for spots in (grams, wholes, BUCKETS + scripts):
                        row += np.bincount(spots, minlength=len(row))
        langs, spots = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array(spots), pa.array(sums[langs, spots])], names=["lang", "spot", "n"])

    found = picked.mapInArrow(count, "lang long, spot long, n long").groupBy("lang", "spot").agg(F.sum("n").alias("n")).toPandas()
    sums = np.zeros((len(languages), BUCKETS + len(NAMES)))
    sums[found["lang"], found["spot"]] = found["n"]
    grams, scripts = sums[:, :BUCKETS], sums[:, BUCKETS:]
    smoothed = grams + 0.5
    weights = np.log(smoothed / smoothed.sum(axis=1, keepdims=True)).astype(np.float32)
    shares = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    allowed = (shares >= SCRIPT_SHARE).T
    return Model(languages, weights, allowed)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, spans: one row per input row, in one pass and without a shuffle.

    Texts that are null or have no letter are `und` with score 0, as are all texts if nothing was learned. Of languages
    with equally many letters the first by name is taken. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.parts())  # BUCKETS numbers per language
    own = []

    def run(ids, bodies):
        if not own:
            own.append(Model(*shared.value))
        langs, scores, spans = zip(*label_all(bodies, own[0]))
        return ids, langs, scores, spans

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(rows, run, "doc_id long, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")


def keep(docs: DataFrame, model: Model, least: float = 0.4) -> DataFrame:
    """The documents, with all their columns, whose language could be told: neither `und` nor mostly of several languages.

    Where nothing was learned, as no document has a language, no document can be judged and all stay.
    """
    if not model.languages:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model.parts())
    own = []

    @F.pandas_udf("boolean")
    def told(bodies: pd.Series) -> pd.Series:
        if not own:
            own.append(Model(*shared.value))
        found = []
        for start in range(0, len(bodies), SLICE_ROWS):
            found += label_all(bodies.iloc[start : start + SLICE_ROWS].tolist(), own[0])
        return pd.Series([lang != UNKNOWN and score >= least for lang, score, _ in found], dtype=bool)

    return docs.where(told("text"))
