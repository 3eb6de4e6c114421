"""Toxicity scores by a factorization machine over hashed terms.

A text is the set of its hashed terms. The machine adds a weight for each term and, for each pair of terms, the product of
their short factor vectors, so a pair such as an insult and the mention of a group can weigh more than both alone. The sum
over pairs takes time linear in the terms: half of (sum of factors) squared minus the sum of squares.

Training reads at most `TRAIN_ROWS` labelled documents. A term takes part if it says something about the label there by itself,
or together with another term: a group mention as common in clean as in toxic texts says nothing alone, but the texts where it
meets an insult differ from those that have only one of both. With thousands of terms and few labels, terms that show neither
only add noise: a machine over all terms of the sample found fewer toxic texts (see README). The model has at most
`MODEL_TERMS` terms, whatever the size of the input.
"""

import zlib

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import map_batches, texts

TERM = regex.compile(r"\p{L}[\p{L}\p{M}]*")
HASH_BITS = 24
TRAIN_ROWS = 12_000
MIN_DOCUMENTS = 5
MODEL_TERMS = 2048
# A term's share of toxic documents has to stand out by so many standard deviations.
MIN_DEVIATION = 4.0
# Pairs are sought among the terms that stand out and this many of the most frequent ones. What a pair's texts differ by from
# those with one of its terms has to be so many standard deviations, with so many texts on each side.
PAIR_TERMS, PAIR_DEVIATION, PAIR_DOCUMENTS = 1024, 6.0, 20
FACTORS = 4
EPOCHS, STEPS, BATCH, RATE, DECAY = 6, 1500, 32, 0.2, 1e-5
THRESHOLD = 0.7
CACHE_WORDS = 300_000
PAIR_ROWS = 1_000


def hashed(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) >> (32 - HASH_BITS)


def terms(text: str) -> set[int]:
    return {hashed(w) for w in set(TERM.findall(text.lower()))}


class FactorizationMachine:
    """bias + sum of weights + half of the factors' pairwise products, as a probability."""

    def __init__(self, index: dict[int, int], seed: int = 0):
        self.index = index
        self.bias, self.weights = 0.0, np.zeros(len(index))
        self.factors = np.random.default_rng(seed).normal(0, 0.01, (len(index), FACTORS))

    def places(self, found: set[int]) -> list[int]:
        return sorted(self.index[t] for t in found if t in self.index)

    def raw(self, places: list[int]) -> float:
        rows = self.factors[places]
        total = rows.sum(axis=0)
        return float(self.bias + self.weights[places].sum() + 0.5 * (total @ total - (rows * rows).sum()))

    def probability(self, places: list[int]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(places), -30, 30))))

    def fit(self, rows: list[list[int]], labels: list[int], seed: int = 0) -> None:
        """AdaGrad on the log loss over small batches; terms and factors decay."""
        random = np.random.default_rng(seed)
        share = min(max(float(np.mean(labels)), 1e-3), 1 - 1e-3)
        self.bias = float(np.log(share / (1 - share)))
        seen_bias, seen_weights, seen_factors = 1e-6, np.full(len(self.weights), 1e-6), np.full(self.factors.shape, 1e-6)
        # Few rows are read more often, so that the number of steps is enough.
        for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(rows)))):
            order = random.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                batch = order[at : at + BATCH].tolist()
                step_bias, step_weights, step_factors = 0.0, np.zeros_like(self.weights), np.zeros_like(self.factors)
                for i in batch:
                    places = rows[i]
                    error = (self.probability(places) - labels[i]) / len(batch)
                    step_bias += error
                    if places:
                        own = self.factors[places]
                        step_weights[places] += error
                        step_factors[places] += error * (own.sum(axis=0) - own)
                step_weights += DECAY * self.weights
                step_factors += DECAY * self.factors
                seen_bias += step_bias**2
                seen_weights += step_weights**2
                seen_factors += step_factors**2
                self.bias -= RATE * step_bias / seen_bias**0.5
                self.weights -= RATE * step_weights / np.sqrt(seen_weights)
                self.factors -= RATE * step_factors / np.sqrt(seen_factors)


def held_out():
    """Documents whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(labels: DataFrame, label_col: str = "toxic", most: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, y: at most `most` labelled documents that are not held out, those with the smallest hash of their id.

    Documents without a label, and those that are labelled both ways, are left out.
    """
    clean = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(
        F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out())
    agreed = clean.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("_most")).where("y = _most").drop("_most")
    return agreed.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", most: int = TRAIN_ROWS) -> FactorizationMachine:
    """Learn from labelled documents that are not held out. Without any, all scores are one half."""
    picked = training_rows(labels, label_col, most)
    # At most `most` rows of two numbers.
    rows = texts(docs).join(F.broadcast(picked), "doc_id")

    def found(ids, bodies, answers):
        return ids, answers, [sorted(terms(b)) for b in bodies]

    sparse = map_batches(rows.select("doc_id", "text", "y"), found, "doc_id long, y int, terms array<int>").orderBy("doc_id").toPandas()
    if sparse.empty:
        return FactorizationMachine({})
    answers = sparse["y"].to_numpy()
    lists = [np.asarray(t, dtype=np.int64) for t in sparse["terms"]]
    del sparse
    machine = FactorizationMachine({t: i for i, t in enumerate(telling(lists, answers))})
    machine.fit([machine.places(set(t.tolist())) for t in lists], answers.tolist())
    return machine


def telling(rows: list[np.ndarray], answers: np.ndarray) -> list[int]:
    """The terms (sorted) that tell something about the answers, alone or as one of a pair."""
    flat = np.concatenate(rows)
    names, spots = np.unique(flat, return_inverse=True)
    toxic = np.repeat(answers, [len(r) for r in rows])
    documents, with_label = np.bincount(spots), np.bincount(spots, weights=toxic)
    rate = answers.mean()
    deviation = np.abs(with_label - documents * rate) / np.sqrt(np.maximum(documents * rate * (1 - rate), 1e-9))
    fit = (documents >= MIN_DOCUMENTS) & (deviation >= MIN_DEVIATION)
    alone = np.flatnonzero(fit)[np.argsort(-deviation[fit], kind="stable")]
    sought = np.unique(np.r_[alone[:MODEL_TERMS], np.argsort(-documents, kind="stable")[:PAIR_TERMS]])
    strength = paired(rows, answers, names[sought])
    partners = sought[strength >= PAIR_DEVIATION][np.argsort(-strength[strength >= PAIR_DEVIATION], kind="stable")]
    # Pairs come first: without one of them, its partner is lost as well.
    chosen = dict.fromkeys([*names[partners].tolist(), *names[alone].tolist()])
    return sorted(list(chosen)[:MODEL_TERMS])


def paired(rows: list[np.ndarray], answers: np.ndarray, names: np.ndarray) -> np.ndarray:
    """For each term of `names`, by how many deviations the texts of its strongest pair differ from those with only one of it."""
    size = len(names)
    both, marked = np.zeros((size, size), dtype=np.float32), np.zeros((size, size), dtype=np.float32)
    for start in range(0, len(rows), PAIR_ROWS):
        block = np.zeros((min(PAIR_ROWS, len(rows) - start), size), dtype=np.float32)
        for i, own in enumerate(rows[start : start + PAIR_ROWS]):
            block[i] = np.isin(names, own, assume_unique=True)
        both += block.T @ block
        marked += block.T @ (block * answers[start : start + PAIR_ROWS, None])
    single, single_marked, best = np.diag(both).copy(), np.diag(marked).copy(), np.zeros(size, dtype=np.float32)
    for i in range(size):
        n, m = both[i], marked[i]
        strengths = []
        for others, others_marked in ((single[i] - n, single_marked[i] - m), (single - n, single_marked - m)):
            share = (m + others_marked) / np.maximum(n + others, 1)
            spread = np.sqrt(np.maximum(share * (1 - share), 1e-6) * (1 / np.maximum(n, 1) + 1 / np.maximum(others, 1)))
            enough = (n >= PAIR_DOCUMENTS) & (others >= PAIR_DOCUMENTS)
            strengths.append(np.where(enough, np.abs(m / np.maximum(n, 1) - others_marked / np.maximum(others, 1)) / spread, 0))
        best[i] = np.minimum(*strengths).max()
    return best


def score(docs: DataFrame, machine: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score: one row per input row, in one pass and without a shuffle.

    The score is that the text's label is 1, between 0 and 1. Null and empty texts, and texts without a known term, get the
    score of no terms. Repeated rows get equal scores. An empty table gives an empty result.
    """

    def run(ids, bodies):
        known: dict[str, int] = {}
        scores = []
        for body in bodies:
            places = set()
            for word in TERM.findall(body.lower()):
                place = known.get(word)
                if place is None:
                    if len(known) >= CACHE_WORDS:
                        known.clear()
                    place = known[word] = machine.index.get(hashed(word), -1)
                places.add(place)
            places.discard(-1)
            scores.append(machine.probability(sorted(places)))
        return ids, scores

    return map_batches(texts(docs, id_col, text_col), run, "doc_id long, score double")
