"""Ranked search and collocations against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_samples import COLUMNS

from gaugeworks.llm import collocations, search

LOW = -(1 << 63)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def slow_search(docs, items):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    counted = [(i, Counter(term.findall(lower(t)))) for i, t in docs]
    total, words = sum(bool(c) for _, c in counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc_id, c in counted:
            m = 10 + 90 * c.total() * total // max(words, 1)
            score = sum(
                math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in set(term.findall(lower(text))) if t in c)
            if score > 0:
                scores.append((-score, LOW if doc_id is None else doc_id))
        out += [(item, r, None if i == LOW else i, -s) for r, (s, i) in enumerate(sorted(scores)[:10], 1)]
    return sorted(out, key=str)


def found(index, items, spark):
    frame = spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, index.search(frame).collect()), key=str)


@pytest.mark.parametrize("size", [3, 8192])
def test_search_by_brute_force(spark, odd, odd_rows, none, size, monkeypatch):
    monkeypatch.setattr(search, "SEGMENT_DOCS", size)
    monkeypatch.setattr(search, "BLOCK_ITEMS", 3)
    docs = [(r[0], r[1]) for r in odd_rows]
    items = [(1, "a b c one two three"), (2, None), (3, " !!! "), (4, odd_rows[9][1]), (4, "no id"), (5, odd_rows[14][1]), (None, "tail ß")]
    assert found(search.Index(odd), items, spark) == slow_search(docs, items)
    assert found(search.Index(none), items, spark) == []


def test_search_skips_and_stays_exact(spark, monkeypatch):
    """Frequent and rare terms, many ties, several segments a task: pair bounds change what is read, never the result."""
    monkeypatch.setattr(search, "SEGMENT_DOCS", 50)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    draw = lambda n: " ".join(vocabulary[min(59, int(rng.expovariate(0.12)))] for _ in range(n))
    docs = [(i, draw(rng.randint(1, 60))) for i in range(600)]
    items = [(i, draw(25)) for i in range(12)]
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], COLUMNS).repartition(3)
    assert found(search.Index(frame), items, spark) == slow_search(docs, items)


def test_pair_bounds_are_bounds_and_tighter():
    rng = np.random.default_rng(3)
    held = np.full(12, 40)
    owner = np.concatenate([np.sort(rng.choice(200, n, replace=False)) for n in held])
    added = rng.integers(1, 1000, len(owner))
    pairs, heads = search.joint(owner, added, held, 200)
    blob = search.packed
    lists = search.Lists(blob(np.arange(200)), blob(np.arange(12), held), blob(owner, added), blob(*pairs), blob(heads))
    order = sorted(range(12), key=lambda at: lists.most[at])
    bounds, sums = lists.bounds(order), np.zeros(200, dtype=np.int64)
    for at, bound in zip(order, bounds):
        sums[lists.docs[at]] += lists.added[at]
        assert sums.max() <= bound
    assert bounds[-1] < sum(lists.most)


def slow_collocations(docs, first=2000):
    grams, totals = Counter(), Counter()
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for k in (1, 2, 3):
                grams.update((lang or "und", *words[i : i + k]) for i in range(len(words) - k + 1))
    out = {}
    for (lang, *w), a in grams.items():
        if len(w) > 1 and a >= 10:
            cuts = [(10**6 * a * a // (grams[lang, *w[:k]] * grams[lang, *w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            gone = len(w) == 2 and any(
                len(o) == 3 and n >= 10 and ol == lang and (o[:2] == w or o[1:] == w) and 100 * n >= 50 * a for (ol, *o), n in grams.items())
            if not gone:
                out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), grams[lang, *w[:k]], grams[lang, *w[k:]], totals[lang]))
    return sorted(
        (lang, r, p.decode(), -a, lf, rf, n, -s) for lang, rows in out.items() for r, (s, a, p, lf, rf, n) in enumerate(sorted(rows)[:first], 1))


@pytest.mark.parametrize("phrases", [5, 500_000])
def test_collocations_by_brute_force(spark, none, phrases):
    rng = random.Random(2)
    words = ["in", "the", "New", "York", "city", "aé", "x\x1cy", "of", "to", "b"]
    draw = lambda: "".join(rng.choice(words) + rng.choice((" ", " ", "\t", "  ", ", ", ".\n")) for _ in range(60))
    rows = [(i, draw(), rng.choice(("en", "de", None, "und")), "s", 0) for i in range(40)]
    rows += [(90, None, "en", None, None), (91, "", None, None, None), (92, "New York city hall " * 30, "en", "s", 1), (92, "New York city hall " * 30, "en", "s", 1)]
    frame = spark.createDataFrame(rows, COLUMNS).repartition(3)
    got = collocations.Collocations(frame, trie_phrases=phrases).best()
    assert sorted(map(tuple, got.collect())) == slow_collocations([(r[2], r[1]) for r in rows])
    assert collocations.Collocations(none).best().count() == 0


def test_trie_counts_all_positions_at_once():
    rng = random.Random(1)
    letters = [f"w{i}" for i in range(3000)]
    texts = [rng.choice(letters[:40]) if rng.random() < 0.7 else rng.choice(letters) for _ in range(20_000)]
    grams = Counter(" ".join(texts[i : i + k]) for k in (2, 3) for i in range(len(texts) - k + 1))
    phrases = sorted(grams)[::3]
    trie = collocations.Trie(pa.array(["en"] * len(phrases) + ["de"]), pa.array([*phrases, "w1 w2"]))
    got = trie.count("en", [w.encode() for w in texts], 3)
    assert got.tolist() == [grams[p] for p in phrases] + [0]
    assert not trie.count("fr", [b"w1", b"w2"], 3).any()


def test_passes_over_the_texts_do_not_grow_with_the_candidates(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(60)), "en", "s", 0) for i in range(30)]
    frame, results = spark.createDataFrame(rows, COLUMNS).repartition(2).localCheckpoint(), []
    for phrases in (5, 500_000):
        seen = spark.sparkContext.accumulator(0)

        def told(batches, seen=seen):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        best = collocations.Collocations(frame.mapInArrow(told, COLUMNS), trie_phrases=phrases).best()
        results.append(sorted(map(tuple, best.collect())))
        assert seen.value == 3 * len(rows)
    assert results[0] == results[1] == slow_collocations([(r[2], r[1]) for r in rows])
