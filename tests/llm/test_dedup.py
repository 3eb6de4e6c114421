"""Exact dedup, SimHash and removal of repeated strings against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_samples import COLUMNS, alike_roots, changed_copies, five_words, sentence, slow_components, slow_fingerprint

from gaugeworks.llm import components, exact_dedup, likeness, simhash, sketch_join, suffix_dedup
from gaugeworks.llm.arrays import unpacked
from gaugeworks.llm.common import SharedTables

LOW = -(1 << 63)


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def order(value):
    return LOW if value is None else value


@pytest.mark.parametrize("first_digit", [1, 64])
def test_exact_dedup_by_brute_force(odd, odd_rows, first_digit):
    groups = defaultdict(list)
    for doc_id, text, *_ in odd_rows:
        groups[text or ""].append(doc_id)
    want = []
    for text, ids in groups.items():
        keep = max(ids, key=order)
        want += [(i, keep, len(ids), i == keep, sha(text)) for i in ids]
    got = [tuple(r) for r in exact_dedup.annotate(odd, first_digit=first_digit).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_exact_dedup_keeps_one_row_of_each_text(odd, odd_rows, none):
    kept = exact_dedup.keep(odd)
    assert kept.columns == odd.columns
    assert sorted(t or "" for (t,) in kept.select("text").collect()) == sorted({t or "" for _, t, *_ in odd_rows})
    assert exact_dedup.annotate(none).count() == exact_dedup.keep(none).count() == 0


def test_simhash_by_brute_force(odd, odd_rows, none):
    values = [slow_fingerprint(t) for _, t, *_ in odd_rows]
    root = slow_components(values)
    least = {}
    for (doc_id, *_), r in zip(odd_rows, root):
        least[r] = min([x for x in (least.get(r), doc_id) if x is not None], default=None)
    want = [(doc_id, simhash.signed(v), least[r]) for (doc_id, *_), v, r in zip(odd_rows, values, root)]
    assert sorted(map(tuple, simhash.near_duplicates(odd).collect()), key=str) == sorted(want, key=str)
    assert simhash.near_duplicates(none).count() == simhash.keep(none).count() == 0
    kept = simhash.keep(odd)
    alike = alike_roots([five_words(t) for _, t, *_ in odd_rows])
    wordless = sum(not five_words(t) for _, t, *_ in odd_rows)
    assert kept.columns == odd.columns and kept.count() == len(set(alike)) - wordless + 1


def near_values(rng, count=400):
    centers = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    values = rng.choice(centers, count)
    for _ in range(4):
        values ^= np.where(rng.random(count) < 0.6, np.uint64(1) << rng.integers(0, 64, count).astype(np.uint64), np.uint64(0))
    return np.unique(values)


def test_bit_sliced_distances():
    rng = np.random.default_rng(1)
    values = near_values(rng)
    sliced = simhash.planes(values)
    for lag in (1, 5, 64, 70, 130):
        near = simhash.within(sliced, simhash.shifted(sliced, lag))
        bits = np.unpackbits(near.view(np.uint8), bitorder="little")[: len(values) - lag].astype(bool)
        assert (bits == (np.bitwise_count(values[:-lag] ^ values[lag:]) <= 4)).all()


@pytest.mark.parametrize("unit_rows", [8192, 16])
def test_links_lose_no_pair(spark, unit_rows):
    """Also where buckets are cut into pairs of parts."""
    values = near_values(np.random.default_rng(2))
    values[: len(values) // 2] &= np.uint64(0xFFFFFFFF)  # a hot bucket
    values = np.unique(values)
    frame = spark.createDataFrame([(simhash.signed(int(v)),) for v in values], "bits long")
    links = simhash.links(frame, unit_rows=unit_rows).collect()
    index = {simhash.signed(int(v)): i for i, v in enumerate(values)}
    root = list(range(len(values)))
    for u, v in links:
        assert (int(values[index[u]]) ^ int(values[index[v]])).bit_count() <= 64
        a, b = root[index[u]], root[index[v]]
        root = [min(a, b) if r in (a, b) else r for r in root]
    assert root == slow_components([int(v) for v in values])


def test_components_of_a_path_a_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1000, 1000 + i) for i in range(40)] + [(7, 7), (3000, 2000)]
    frame = spark.createDataFrame(edges, "u long, v long")
    found = dict(map(tuple, components.components(frame, SharedTables(spark, "test")).collect()))
    assert found == {**{i: 0 for i in range(1, 51)}, **{1000 + i: 1000 for i in range(1, 40)}, 3000: 2000}


def slow_removal(rows):
    """Per row: bytes, removed bytes, runs and what is kept."""
    first = {}
    for doc_id, text, *_ in rows:
        body = (text or "").encode()
        for i in range(len(body) - 49):
            first[body[i : i + 50]] = min(first.get(body[i : i + 50], 1 << 62), order(doc_id))
    out = []
    for doc_id, text, *_ in rows:
        body = (text or "").encode()
        gone = bytearray(len(body))
        for i in range(len(body) - 49):
            if first[body[i : i + 50]] < order(doc_id):
                gone[i : i + 50] = b"\1" * 50
        starts = [i for i in range(len(gone)) if gone[i] and (not i or not gone[i - 1])]
        out.append((doc_id, len(body), sum(gone), bytes(b for b, g in zip(body, gone) if not g), starts))
    return out


@pytest.mark.parametrize("hot_documents", [1, suffix_dedup.HOT_DOCUMENTS])
def test_removal_by_brute_force(odd, odd_rows, none, hot_documents):
    """Also where all hashes count as hot."""
    found = suffix_dedup.remove_repeats(odd, hot_documents=hot_documents)
    got = [(r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept), r.starts) for r in found.collect()]
    assert sorted(got, key=str) == sorted(slow_removal(odd_rows), key=str)
    assert suffix_dedup.remove_repeats(none).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.text("ab", min_size=50, max_size=76), st.integers(0, 20)), min_size=1, max_size=30))
def test_collection_minima(pairs):
    strings = {s.encode(): i for s, i in pairs}
    found = suffix_dedup.collection_minima(list(strings), np.array(list(strings.values())))
    first = {}
    for s, i in strings.items():
        for k in range(len(s) - 49):
            first[s[k : k + 50]] = min(first.get(s[k : k + 50], 99), i)
    assert [m.tolist() for m in found] == [[first[s[k : k + 50]] for k in range(len(s) - 49)] for s in strings]


def test_equal_windows_share_a_run_hash():
    body = bytes(range(256)) * 2
    hashes, starts, sizes = suffix_dedup.runs(np.frombuffer(body, dtype=np.uint8))
    each = np.repeat(hashes, sizes)
    assert sizes.sum() == len(body) - 49 and (np.repeat(starts, sizes)[each.argsort()] >= 0).all()
    assert all(each[i] == each[i + 256] for i in range(len(body) - 49 - 256))
    assert len(suffix_dedup.runs(np.frombuffer(b"short", dtype=np.uint8))[0]) == 0
    assert suffix_dedup.runs(np.frombuffer(b"a" * 5000, dtype=np.uint8))[2].max() <= suffix_dedup.PIECE


@pytest.mark.parametrize("bounds", [None, (3, 1, 2)])
@pytest.mark.parametrize("operator", [simhash, sketch_join])
def test_copies_down_to_a_likeness_of_four_fifths(spark, bounds, operator, monkeypatch):
    """Planted copies with a growing number of changed words, against all pairs; also where groups are cut into parts."""
    for name, value in zip(("UNIT", "HUB_LEAVES", "SETTLE_ROWS"), bounds or ()):
        monkeypatch.setattr(likeness, name, value)
    texts = changed_copies(random.Random(3))
    root = alike_roots([five_words(t) for t in texts])
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], COLUMNS).repartition(2)
    if operator is simhash:
        assert {r.doc_id for r in simhash.keep(docs).collect()} == set(root)
    else:
        assert {r.doc_id: r.component_id for r in sketch_join.join(docs).collect()} == dict(enumerate(root))


def test_sketch_join_by_brute_force(odd, odd_rows, none):
    sets = [five_words(t) for _, t, *_ in odd_rows]
    root, least = alike_roots(sets), {}
    # Texts with equal sets are one class even where a null id comes first.
    for (doc_id, *_), r in zip(odd_rows, root):
        least[r] = min(order(doc_id), least.get(r, order(doc_id)))
    plain = lambda x: None if x == LOW else x
    want = [(d, len(s), plain(least[r])) for (d, *_), s, r in zip(odd_rows, sets, root)]
    assert sorted(map(tuple, sketch_join.join(odd).collect()), key=str) == sorted(want, key=str)
    assert sketch_join.join(none).count() == 0


@given(st.integers(1, 3000), st.integers(0, 2**32), st.floats(0, 0.3))
@settings(max_examples=60, deadline=None)
def test_alike_sets_share_a_parity_word_and_pass_the_bits(size, seed, share):
    """Whatever two sets with a likeness of 0.8: a common key in a common band, and a distance within the bound."""
    rng = np.random.default_rng(seed)
    one = np.unique(rng.integers(1, 1 << 63, size, dtype=np.uint64))
    drop, add = rng.random(len(one)) < share * rng.random(), rng.integers(1, 1 << 63, int(share * size * rng.random()), dtype=np.uint64)
    other = np.unique(np.r_[one[~drop], add])
    common = len(np.intersect1d(one, other))
    if not len(other) or 5 * common < 4 * (len(one) + len(other) - common):
        return
    assert set(sketch_join.keys(one)[0].tolist()) & set(sketch_join.keys(other)[0].tolist())
    level = min(sketch_join.band(len(one)), sketch_join.band(len(other)))
    a, b = (np.frombuffer(sketch_join.parity_bits(s, level), dtype=np.uint64) for s in (one, other))
    assert sketch_join.close(a, b[None, :], np.int64(len(one)), np.array([len(other)])).all()
    assert np.count_nonzero(sketch_join.parity_words(one, level) != sketch_join.parity_words(other, level)) <= len(one) + len(other) - 2 * common


def test_bit_sliced_distances_of_a_wide_radius():
    rng = np.random.default_rng(4)
    values = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    values[1:] ^= (values[:-1] ^ values[1:]) & rng.integers(0, 1 << 63, 299, dtype=np.uint64)
    sliced = simhash.planes(values)
    near = simhash.within(sliced, simhash.shifted(sliced, 1), 20)
    bits = np.unpackbits(near.view(np.uint8), bitorder="little")[:299].astype(bool)
    assert bits.any() and (bits == (np.bitwise_count(values[:-1] ^ values[1:]) <= 20)).all()


def test_spans_are_joined_per_row():
    rows = [(2, 1, 5, 9), (1, 1, 0, 50), (1, 1, 1, 51), (1, 1, 10, 20), (1, 1, 51, 60), (1, 1, 70, 80), (1, 2, 60, 61), (2, 1, 0, 3)]
    got = list(zip(*(c.tolist() for c in suffix_dedup.spans_joined(rows))))
    assert got == [(1, 1, 0, 60), (1, 1, 70, 80), (1, 2, 60, 61), (2, 1, 0, 3), (2, 1, 5, 9)]


def test_a_hot_passage_makes_few_rows():
    """400 documents with a common passage of 400 bytes whose hashes are all hot: spans, not windows, leave the task."""
    rng = random.Random(9)
    shared = sentence(rng, 100)[:400]
    texts = [sentence(rng, 30) + shared + sentence(rng, 30) for _ in range(400)]
    hashes = [np.unique(suffix_dedup.runs(np.frombuffer(t.encode(), dtype=np.uint8))[0]).astype(np.int64) * 2 + 1 for t in texts]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(400)), pa.array([0] * 400), pa.array(texts), pa.array([h.tolist() for h in hashes])], names=["doc_id", "row", "text", "hashes"])
    rows = sum(r.num_rows for r in suffix_dedup.cut([batch], 16))
    assert rows <= 2_000


def test_places_of_few_documents_make_a_hash_hot(spark):
    told = spark.createDataFrame([(1, 7, 60), (2, 7, 60), (1, 8, 1), (2, 8, 1)], "doc_id long, hash long, places long")
    assert [r.hash for r in suffix_dedup.hot_hashes(told, 100).collect()] == [7]


def phrase_in_many_contexts(times):
    """Two documents with one phrase before texts that vary, a third of them in both."""
    rng = random.Random(11)
    contexts = [f"{rng.getrandbits(120):036d}" for _ in range(2 * times)]
    # Of some phrases, the one whose least hash is smallest, so that it is that of the windows around it.
    phrases = [f"the phrase of all these lines, {i:03d}: " for i in range(300)]
    phrase = min(phrases, key=lambda p: int(suffix_dedup.gram_hashes(np.frombuffer(p.encode(), dtype=np.uint8)).min()))
    part = lambda c: phrase + c
    return [(1, "\n".join(map(part, contexts[:times]))), (2, "\n".join(map(part, contexts[2 * times // 3 : times + 2 * times // 3])))]


@pytest.mark.parametrize("hot_documents", [1000, suffix_dedup.HOT_DOCUMENTS])
def test_removal_around_a_phrase_in_two_documents(spark, hot_documents):
    rows = phrase_in_many_contexts(5000)
    found = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), hot_documents=hot_documents)
    got = [(r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept), r.starts) for r in found.collect()]
    assert sorted(got) == sorted(slow_removal(rows))


def test_no_block_is_larger_than_the_bound(monkeypatch):
    """The strings of one hash and of the whole batch, sorted in this process."""
    rows = phrase_in_many_contexts(5000)
    hashes = [np.unique(suffix_dedup.runs(np.frombuffer(t.encode(), dtype=np.uint8))[0]).astype(np.int64) * 2 for _, t in rows]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([1, 2]), pa.array([0, 0]), pa.array([t for _, t in rows]), pa.array(hashes, type=pa.list_(pa.int64()))], names=list("abcd"))
    sizes, sort = [], suffix_dedup.collection_minima
    monkeypatch.setattr(suffix_dedup, "collection_minima", lambda strings, ids: sizes.append(len(strings)) or sort(strings, ids))
    sent = [b for b in suffix_dedup.cut([batch], 1) if b.column(0).null_count == 0]
    assert sum(b.num_rows for b in suffix_dedup.sort_strings(sent)) > 0
    assert max(sizes, default=0) <= suffix_dedup.BLOCK_STRINGS


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.text("ab\0", min_size=50, max_size=76), st.integers(0, 20)), min_size=1, max_size=30), st.integers(1, 40))
def test_window_minima_equal_those_of_the_collection(pairs, piece):
    strings = {s.encode(): i for s, i in pairs}
    ids, before = np.array(list(strings.values())), suffix_dedup.PIECE_WINDOWS
    suffix_dedup.PIECE_WINDOWS = piece
    try:
        found = suffix_dedup.window_minima(list(strings), ids)
    finally:
        suffix_dedup.PIECE_WINDOWS = before
    assert [m.tolist() for m in found] == [m.tolist() for m in suffix_dedup.collection_minima(list(strings), ids)]


def test_texts_that_share_many_keys_meet_once(spark, monkeypatch):
    """Two near copies have most of their keys in common; their sketches are sent to one unit for each set of texts, not for each key."""
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join(words[:-3]), "another text of its own"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept, units, drop = likeness.Likeness._dealt, [], likeness.SharedTables.drop

    def dealt(self, frame, key, *more):
        if "sketches" in frame.columns:
            units.append(sum(int.from_bytes(b.blob[:4], "little") > 0 and len(unpacked(bytes(b.blob)[4 + int.from_bytes(b.blob[:4], "little"):], 3)[0])
                             for b in frame.collect()))
        return kept(self, frame, key, *more)

    monkeypatch.setattr(likeness.Likeness, "_dealt", dealt)
    gone = []
    monkeypatch.setattr(likeness.SharedTables, "drop", lambda self, table="": (gone.append(table), drop(self, table)))
    found = {r.doc_id: r.component_id for r in sketch_join.join(docs).collect()}
    assert found == {0: 0, 1: 0, 2: 2}
    # A set of texts may come with flags 0 and 1 of its band.
    assert len(units) == 1 and 2 <= units[0] <= 4 and "marked/kind=blob" in gone


@pytest.mark.parametrize("size", [40, 160])
def test_a_settled_group_gives_a_forest_not_its_pairs(size):
    """All texts of a unit but the last are alike and of different pieces; half of them ask."""
    base = sentence(random.Random(3), 300)
    nodes = [(n, n, f"{base} end{n}") for n in range(1, size)] + [(size, size, "quite another text than those before")]
    rows = [(7, int(asks), *node) for asks in (0, 1) for node in nodes if not asks or node[0] % 2]
    batch = pa.RecordBatch.from_pylist([dict(zip(("unit", "asks", "node", "label", "text"), r)) for r in rows])
    edges = [tuple(e.values()) for b in likeness.settled([batch], (4, 5)) for e in b.to_pylist()]
    assert sorted(edges) == [(n, 1) for n in range(2, size)]


def test_texts_with_a_common_line_alone_do_not_meet(spark, monkeypatch):
    """A line that many texts begin with is no key of theirs, so the work does not grow with the square of their number; copies still meet."""
    monkeypatch.setattr(likeness, "OFTEN", 20, raising=False)
    rng = random.Random(5)
    line = sentence(rng, 16)
    texts = [f"{line}\n{sentence(rng, 60)}" for _ in range(120)] + [line, line + " end"]
    texts += [texts[0] + " tail", texts[7] + " tail"]
    rows, write = {}, SharedTables.write

    def written(self, frame, table, *by):
        found = write(self, frame, table, *by)
        rows[table] = rows.get(table, 0) + found.count() if table == "told" else 0
        return found

    monkeypatch.setattr(SharedTables, "write", written)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], COLUMNS).repartition(3)
    kept = {r.doc_id for r in simhash.keep(docs).collect()}
    assert kept == set(alike_roots([five_words(t) for t in texts])) == set(range(121))
    # Of the two pairs of copies, a fifth of about 70 shingles each, and what the line and the line with one word more share.
    assert rows["told"] <= 4 * 16 + 2 * 13


@pytest.mark.parametrize("often", [0, 1, 3])
def test_copies_are_found_whichever_shingles_come_last(spark, often, monkeypatch):
    """Planted copies against all pairs, where all shingles or those of several texts count as frequent."""
    monkeypatch.setattr(likeness, "OFTEN", often, raising=False)
    monkeypatch.setattr(likeness, "HELD_SHINGLES", 3_000, raising=False)
    texts = changed_copies(random.Random(8))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], COLUMNS).repartition(2)
    assert {r.doc_id for r in simhash.keep(docs).collect()} == set(alike_roots([five_words(t) for t in texts]))


@given(st.integers(1, 400), st.integers(0, 2**32), st.floats(0, 0.3))
@settings(max_examples=60, deadline=None)
def test_alike_sets_share_a_prefix_key_in_any_order(size, seed, share):
    rng = np.random.default_rng(seed)
    one = np.unique(rng.integers(1, 1 << 63, size, dtype=np.uint64))
    other = np.unique(np.r_[one[rng.random(len(one)) >= share * rng.random()], rng.integers(1, 1 << 63, int(share * size * rng.random()), dtype=np.uint64)])
    common = len(np.intersect1d(one, other))
    if not len(other) or 5 * common < 4 * (len(one) + len(other) - common):
        return
    every = np.union1d(one, other)
    often = every[rng.random(len(every)) < rng.random()]
    assert set(simhash.prefix_keys(one, often)[0].tolist()) & set(simhash.prefix_keys(other, often)[0].tolist())


@pytest.mark.parametrize("dense, columns", [(1, 7), (16, 1024), (10**6, 5)])
def test_common_shingles_by_matrix_and_by_search(dense, columns, monkeypatch):
    monkeypatch.setattr(likeness, "DENSE", dense)
    monkeypatch.setattr(likeness, "COLUMNS", columns)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    sets = [np.unique(np.r_[base[rng.random(60) < 0.6], rng.integers(0, 1 << 63, k % 9, dtype=np.uint64)]) for k in range(70)]
    found = [row.tolist() for row in likeness.shared(sets[:20], sets[10:])]
    assert found == [[len(np.intersect1d(a, b)) for b in sets[10:]] for a in sets[:20]]
