"""Helpers of operators that work on numpy arrays inside tasks: packing, hashes of words, rows by key."""

import numpy as np
import pyarrow as pa
import xxhash
import zstandard

HELD_WORDS = 400_000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
ODD = np.uint64(0xBF58476D1CE4E5B9)


def packed(*arrays: np.ndarray) -> bytes:
    """Equally long arrays of whole numbers, byte plane by byte plane, compressed."""
    planes = [np.ascontiguousarray(a.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpacked(blob: bytes, count: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    return [np.ascontiguousarray(p.reshape(8, -1).T).view("<i8").ravel() for p in raw.reshape(count, -1)]


def squeezed(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def opened(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def mixed(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit numbers, each spread over all bits."""
    values = (values ^ (values >> np.uint64(30))) * ODD
    return (values ^ (values >> np.uint64(27))) * GOLDEN


class WordHashes(dict):
    """The unsigned 64-bit hash of each word, never zero; forgets all when it holds HELD_WORDS words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= HELD_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word) or 1
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def record(schema: str, *columns) -> pa.RecordBatch:
    """A batch of the columns, named and typed as in the schema ("name long, name binary, ..."); None is a column of nulls."""
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_(), "int": pa.int32()}
    fields = [f.split() for f in schema.split(", ")]
    size = next(len(c) for c in columns if c is not None)
    return pa.RecordBatch.from_arrays(
        [pa.array([None] * size if c is None else c, type=kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)],
        names=[name for name, _ in fields])


def by_key(batches):
    """(key, list of the other columns' values) of consecutive rows with the same first column."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[0] != key:
                yield key, held
                held = []
            key = row[0]
            held.append(row[1:])
    if held:
        yield key, held


def runs_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of equal values in a sorted array."""
    if not len(values):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return starts, np.diff(np.r_[starts, len(values)])


def among(values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each value, where it would stand in the sorted array `known` and whether it is there."""
    place = np.searchsorted(known, values)
    there = place < len(known)
    there[there] = known[place[there]] == values[there]
    return place, there
