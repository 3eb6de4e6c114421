"""N-gram Jaccard join with parity sketches.

The shingles of a text are XORed into a sketch: a hash picks one of its words, and the shingle's 64 bits are flipped in there.
A shingle more or less changes one word, so the number of differing words never exceeds the symmetric difference of two sets.
Sets of sizes a <= b with a likeness of 0.8 differ in at most (a + b) / 9 shingles, which is a / 4 at most and 2 b / 9 at most.

Pigeonhole join: of the first k + 1 words of a sketch that are not empty, with k = size / 4, one at least is the same in both
sketches and among the first of both, as at most k words differ. These words are the keys. Sketches of one size band have the
same number of words; a text whose partners reach into the next lower band has a sketch for that band as well. A text with too
few words that are not empty shares one of its words with every other text; two such texts meet in keys of their own, which
hold empty words too.

A second sketch flips one bit per shingle. Its Hamming distance is a lower bound of the symmetric difference as well, and pairs
beyond (a + b) / 9 are dropped before their texts are compared.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.arrays import GOLDEN, mixed, runs_of
from gaugeworks.llm.likeness import Likeness, Method

LEAST = (4, 5)
BAND = 1.5


def band(size: int) -> int:
    return int(np.log(size) / np.log(BAND) + 1e-9)


def top(level: int) -> int:
    """No set of the band is larger."""
    return int(BAND ** (level + 1)) + 1


def parity_words(own: np.ndarray, level: int) -> np.ndarray:
    """The sketch of a set for a band: a little more words than may differ, so that few stay empty."""
    words = np.zeros(int(0.36 * top(level)) + 8, dtype=np.uint64)
    spread = mixed(own + np.uint64(level + 1))
    np.bitwise_xor.at(words, (spread % np.uint64(len(words))).astype(np.int64), mixed(spread))
    return words


def bit_width(level: int) -> int:
    """At least twice as many bits as the band's largest set has shingles, a power of two."""
    return max(64, 1 << (2 * top(level) - 1).bit_length())


def parity_bits(own: np.ndarray, level: int) -> bytes:
    """One bit per shingle, flipped."""
    width = bit_width(level)
    times = np.bincount((mixed(own ^ GOLDEN) & np.uint64(width - 1)).astype(np.int64), minlength=width)
    return np.packbits((times & 1).astype(np.uint8), bitorder="little").tobytes()


def keys_at(own: np.ndarray, level: int) -> np.ndarray:
    words = parity_words(own, level)
    filled, needed = np.flatnonzero(words), len(own) // 4 + 1
    tag = mixed(np.arange(len(words), dtype=np.uint64) * GOLDEN + np.uint64(2 * level))
    keys = mixed(words + tag)
    if len(filled) >= needed:
        return keys[filled[:needed]]
    return np.r_[keys[filled], mixed(keys ^ GOLDEN)]


def keys(own: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Keys of a set in its band (flag 0) and, if its partners may lie there, the next lower one (flag 1); both bit sketches."""
    level = band(len(own))
    first, lowest = keys_at(own, level), band(-(-len(own) * LEAST[0] // LEAST[1]))
    if lowest == level:
        return first, np.zeros(len(first), dtype=np.uint64), parity_bits(own, level)
    second = keys_at(own, level - 1)
    flags = np.repeat(np.array([0, 1], dtype=np.uint64), [len(first), len(second)])
    return np.r_[first, second], flags, parity_bits(own, level) + parity_bits(own, level - 1)


def close(one: np.ndarray, other: np.ndarray, sizes: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Pairs of bit sketches whose distance allows for the likeness, and whose sizes do."""
    apart = np.bitwise_count(one ^ other).sum(axis=-1, dtype=np.int64)
    fits = (np.minimum(sizes, more) * LEAST[1] >= np.maximum(sizes, more) * LEAST[0])
    return fits & (9 * apart <= sizes + more)


def find(root: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The roots of some entries; paths are halved on the way."""
    while True:
        up = root[at]
        if np.array_equal(up, at):
            return at
        root[at] = root[up]
        at = up


def forest(unit: np.ndarray, entry: np.ndarray, flags: np.ndarray, sizes: np.ndarray, sketches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Edges (entries) that connect what is close within a unit.

    Units go one after the other; each holds the sketches of one band. A text is held against all texts of the unit that are
    not connected to it yet, in this unit or an earlier one, until all are connected or have been held against the others.
    """
    root, leaves, roots = np.arange(len(sizes)), [], []
    starts, counts = runs_of(unit)
    bits: dict[tuple[int, int], np.ndarray] = {}

    def sketch(at: int, lower: int) -> np.ndarray:
        found = bits.get((at, lower))
        if found is None:
            wide = bit_width(band(int(sizes[at]))) // 8
            raw = sketches[at][wide:] if lower else sketches[at][:wide]
            found = bits[at, lower] = np.frombuffer(raw, dtype=np.uint64)
        return found

    for start, count in zip(starts.tolist(), counts.tolist()):
        if count < 2:
            continue
        own, flag = entry[start : start + count], flags[start : start + count]
        if count > 2:
            label = find(root, own)
            if (label == label[0]).all():
                continue
        elif root[own[0]] == root[own[1]]:
            continue
        rows = [sketch(a, f) for a, f in zip(own.tolist(), flag.tolist())]
        width = len(rows[0])
        if any(len(r) != width for r in rows):  # two bands share a unit by a clash of hashes
            same = np.array([len(r) == width for r in rows])
            own, rows = own[same], [r for r in rows if len(r) == width]
        held = np.array(rows)
        for i in range(len(own) - 1):
            label = find(root, own)
            if (label == label[0]).all():
                break
            apart = np.flatnonzero(label != label[i])
            apart = apart[close(held[i], held[apart], sizes[own[i]], sizes[own[apart]])]
            for j in apart.tolist():
                a, b = (int(find(root, own[[k]])[0]) for k in (i, j))
                if a != b:
                    root[max(a, b)] = min(a, b)
                    leaves.append(int(own[j]))
                    roots.append(int(own[i]))
    return np.array(leaves, dtype=np.int64), np.array(roots, dtype=np.int64)


METHOD = Method(keys, forest, LEAST)


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: one row per document; the smallest doc_id that links of LEAST or more reach.

    Texts of fewer words than a shingle has are one shingle; texts without words, null ones included, have none and are linked
    with nothing. Texts are read whole. Rows that repeat a doc_id may be in several components; an empty table gives an empty
    result.
    """
    found = Likeness(docs, METHOD, "sketch-join", id_col, text_col).labelled()
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
