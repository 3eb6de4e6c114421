"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over code points cuts a text where the last `WINDOW` of them say so, wherever they stand, so passages that
documents share fall into the same chunks. A chunk is encoded once and its ids are kept for the next document that has it.

A cut may fall inside a word. Tokens never reach across white space, so a chunk's ids are settled between its first and
its last white space, and what stands before and after is open. A join is repaired by encoding the open end of the left
chunk together with the open start of the right one; a chunk without white space stays open as a whole, so the repair
goes on into the next chunk until it meets white space on both sides. There it agrees with the encoding of the whole text.

Reuse is within a Python worker, across its tasks: moving chunks and ids through a shuffle so that each is encoded once in
the whole cluster would move more bytes than the input has. The caches are bounded and keep the more recent half.
"""

import os
import re
import sys
import types

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from gaugeworks.llm.common import map_batches, texts

WINDOW = 16
CHUNK_BITS = 9
BASE = 0x9E3779B1
# What the two caches of a worker hold at most, in bytes of Python objects, roughly.
WORD_CACHE = 96 << 20
CHUNK_CACHE = 32 << 20
# An entry with its key, value and place in the map, and what each id of it adds.
ENTRY_BYTES, ID_BYTES = 300, 8

ROUND_TRIP = "doc_id long, n_tokens long, ids binary, decoded string"

# These four end no word for the tokenizer, but would for str.split().
NOT_SPACE = re.compile("[\x1c-\x1f]")
SPACES = re.compile("[ \t\n\r\x0b\x0c]+")
FIRST_SPACE = re.compile("[ \t\n\r\x0b\x0c]")


# Words of visible ASCII and the accented Latin letters need no normalizing but lower case: their pieces are letters, single
# digits and runs of the rest. An apostrophe starts pieces of its own and < may start a special token, so these are left out.
PLAIN = re.compile("[!-&(-;=-~À-ÖØ-öø-ÿ]+")
PIECES = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def byte_letters() -> list[str]:
    """The visible character that stands for each byte: itself where it is one, else the next one from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Recent:
    """A map of texts to ids that forgets those not used for longest, half at a time, when it holds about `size` bytes."""

    def __init__(self, size: int):
        self.half, self.held, self.young, self.old = size // 2, 0, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.pop(key, None)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value, ids: int | None = None) -> None:
        if self.held >= self.half:
            self.young, self.old, self.held = {}, self.young, 0
        self.young[key] = value
        self.held += ENTRY_BYTES + len(key) + ID_BYTES * (len(value) if ids is None else ids)


def cuts(text: str) -> list[int]:
    """Ends of the chunks: places where the rolling hash of the last WINDOW code points has CHUNK_BITS zero bits, and the end."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if len(codes) <= WINDOW:
        return [len(codes)]
    hashes = np.zeros(len(codes) - WINDOW + 1, dtype=np.uint32)
    for i in range(WINDOW):
        hashes = hashes * np.uint32(BASE) + codes[i : i + len(hashes)]
    hashes ^= hashes >> np.uint32(15)
    ends = (np.flatnonzero((hashes * np.uint32(0x85EBCA77)) >> np.uint32(32 - CHUNK_BITS) == 0) + WINDOW).tolist()
    return ends if ends and ends[-1] == len(codes) else [*ends, len(codes)]


class Codec:
    """The tokenizer of a vocabulary file, with the caches of a worker."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.tokens = [self.tokenizer.id_to_token(i) for i in range(size)]
        if self.tokenizer.decoder is not None:
            raise ValueError("only vocabularies without a decoder, whose tokens are joined by spaces, are decoded here")
        self.words, self.chunks = Recent(WORD_CACHE), Recent(CHUNK_CACHE)
        self.letters, self.merge = byte_letters(), self.tokenizer.model.tokenize
        sample = "Größe42-x"
        self.plain = self._plain(sample) == tuple(self.tokenizer.encode(sample, add_special_tokens=False).ids)

    def _plain(self, word: str) -> tuple[int, ...]:
        """A word that matches PLAIN, piece by piece straight through the merges."""
        word = word.lower()
        pieces = [word] if word.isascii() and word.isalpha() else PIECES.findall(word)
        ids, merge = [], self.merge
        for piece in pieces:
            shown = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
            ids += [token.id for token in merge(shown)]
        return tuple(ids)

    def _encode_words(self, words: list[str]) -> None:
        """Encode new words: plain ones by the merges alone, the others in one call, told apart by where they stand."""
        if self.plain:
            others = []
            for word in words:
                if PLAIN.fullmatch(word):
                    self.words.put(word, self._plain(word))
                else:
                    others.append(word)
            words = others
        if not words:
            return
        line = "\n".join(words)
        found = self.tokenizer.encode(line, add_special_tokens=False)
        ids, at, end, begin = found.ids, 0, 0, [s for s, _ in found.offsets]
        for word in words:
            end += len(word) + 1
            first = at
            while at < len(begin) and begin[at] < end:
                at += 1
            self.words.put(word, tuple(ids[first:at]))

    def settled(self, text: str) -> list[int]:
        """The ids of a text whose ends are ends of words."""
        words = text.split() if NOT_SPACE.search(text) is None else [w for w in SPACES.split(text) if w]
        get, out = self.words.get, []
        found = [get(w) for w in words]
        if None in found:
            new = list(dict.fromkeys(w for w, ids in zip(words, found) if ids is None))
            own = {}
            self._encode_words(new)
            for word in new:
                own[word] = self.words.get(word) or ()
            found = [own[w] if ids is None else ids for w, ids in zip(words, found)]
        for ids in found:
            out += ids
        return out

    def chunk(self, text: str) -> tuple[str, list[int], str] | None:
        """The open start, the settled ids and the open end of a chunk; None if it has no white space."""
        found = self.chunks.get(text)
        if found is None:
            first = FIRST_SPACE.search(text)
            if first is None:
                return None
            last = max(text.rfind(c) for c in " \t\n\r\x0b\x0c")
            found = (text[: first.start()], self.settled(text[first.start() : last + 1]), text[last + 1 :])
            self.chunks.put(text, found, len(found[1]) + len(text) // ID_BYTES)
        return found

    def encode(self, text: str) -> list[int]:
        ids, held, start = [], "", 0
        for end in cuts(text):
            piece = text[start:end]
            start = end
            parts = self.chunk(piece)
            if parts is None:
                held += piece
                continue
            head, middle, tail = parts
            if held or head:
                ids += self.settled(held + head)
            ids += middle
            held = tail
        if held:
            ids += self.settled(held)
        return ids

    def decode(self, ids) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))


def codec(vocabulary: str) -> Codec:
    """This worker's codec of a vocabulary. It lives in a module of the process, so that later tasks find it filled."""
    store = sys.modules.setdefault("_gaugeworks_codecs", types.ModuleType("_gaugeworks_codecs"))
    key = str(hash(vocabulary))
    if key not in store.__dict__:
        store.__dict__[key] = Codec(vocabulary)
    return store.__dict__[key]


def vocabulary(spark: SparkSession, path: str):
    """The vocabulary file, read by the driver and sent to the executors; its size does not depend on the data."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def packed(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


def unpacked(ids: bytes) -> list[int]:
    return np.frombuffer(ids, dtype="<u4").tolist()


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids: ids packed as little-endian unsigned 32-bit numbers. One row per input row, no shuffle.

    Null texts count as empty and have no ids. Texts are encoded whole, however long. An empty table gives an empty result.
    """
    shared = vocabulary(docs.sparkSession, path)

    def run(ids, bodies):
        encoded = [packed(codec(shared.value).encode(body)) for body in bodies]
        return ids, [len(e) // 4 for e in encoded], encoded

    return map_batches(texts(docs, id_col, text_col), run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of `encode` with the decoded text as column `decoded`."""
    shared = vocabulary(encoded.sparkSession, path)

    def run(ids, sizes, tokens):
        return ids, sizes, tokens, [codec(shared.value).decode(unpacked(t)) for t in tokens]

    return map_batches(encoded.select("doc_id", "n_tokens", "ids"), run, ROUND_TRIP)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`encode` and then `decode`, in one pass and thus with one Python worker and one set of caches per core."""
    shared = vocabulary(docs.sparkSession, path)

    def run(ids, bodies):
        own = codec(shared.value)
        tokens = [packed(own.encode(body)) for body in bodies]
        return ids, [len(t) // 4 for t in tokens], tokens, [own.decode(unpacked(t)) for t in tokens]

    return map_batches(texts(docs, id_col, text_col), run, ROUND_TRIP)
