"""What several test modules share: table shapes, invented texts, slow versions of operators."""

import re

import xxhash

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
# Columns whose names the operators use inside.
CLASHES = ("row", "size", "key", "bits", "grp", "rest", "bucket", "place", "carried", "spans", "kept", "score", "taken", "_text_sha", "_node", "id", "sha", "tag", "digest",
           "stays_id", "unit")


def sentence(rng, words=40):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(words))


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(values, radius=4):
    """Root index of each value: pairs that differ in at most `radius` bits are linked."""
    root = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def five_words(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike_roots(sets):
    """Root index of each set: pairs of non-empty sets with a Jaccard likeness of 0.8 or more are linked."""
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def changed_copies(rng):
    """Texts and their copies with a growing number of changed words."""
    texts = []
    for size in (12, 60, 200, 400):
        for changes in (0, 1, 2, 3, 5, 8, 12):
            words = sentence(rng, size).split()
            texts.append(" ".join(words))
            for _ in range(3):
                copy = list(words)
                for at in rng.sample(range(size), min(changes, size // 2)):
                    copy[at] = "changed" + str(rng.random())
                texts.append(" ".join(copy) + " end" * (changes == 0))
    return texts
