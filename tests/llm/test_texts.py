"""Personal data, span fingerprints, BPE, language and toxicity against brute force, round trips and held-out labels."""

import random
import re

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_samples import COLUMNS, sentence
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gaugeworks.llm import bpe, language, pii, spans, toxicity
from gaugeworks.llm.common import read

SMALL = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


def slow_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        out += [("ip", *m.span())] * all(int(p) <= 255 for p in m[0].split("."))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()][::-1]
        out += [("card", *m.span())] * (13 <= len(digits) <= 19 and sum(digits[::2] + [sum(divmod(2 * d, 10)) for d in digits[1::2]]) % 10 == 0)
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        out += [("phone", *m.span())] * (9 <= sum(c.isdigit() for c in m[0]) <= 15)
    return out


@settings(max_examples=300, deadline=None)
@given(st.text("a@.-+12 ()", max_size=80) | st.lists(st.sampled_from(["4111111111111111", "a@b.c", "1.2.3.4", "256.1.1.1", "+1 234 567 89", " ", ".", "@"])).map("".join))
def test_base_spans(text):
    assert pii.base_spans(text) == slow_spans(text)


def test_added_spans_need_a_checksum_and_context():
    kinds = lambda text: [s["kind"] for s in pii.find_in_text(text)]
    assert kinds("IBAN DE89 3704 0044 0532 0130 00 please") == ["iban"]
    assert kinds("IBAN DE88 3704 0044 0532 0130 00 please") == []
    assert kinds("ssn 123-45-6789") == ["national_id"] and kinds("part 123-45-6789") == []
    assert kinds("born 1990-01-02") == ["birth_date"] and kinds("on 1990-01-02") == []
    assert kinds("dob 31/12/1990") == kinds("dob 12.31.1990") == ["birth_date"]
    assert kinds("dob 99.99.0000") == kinds("dob 13.13.1990") == kinds("dob 1990-31-12") == []
    assert pii.find_in_text("call +1 234 567 8901")[0]["score"] > pii.find_in_text("x +1 234 567 8901")[0]["score"]


def test_pii_of_odd_rows(odd, odd_rows, none):
    got = [(r.doc_id, [(s.kind, s.start, s.end) for s in r.spans if s.kind in pii.BASE_KINDS]) for r in pii.find(odd).collect()]
    assert sorted(got, key=str) == sorted([(i, slow_spans(t or "")) for i, t, *_ in odd_rows], key=str)
    assert pii.find(none).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.text("ab", max_size=60), st.text("ab", max_size=60), st.data())
def test_prefix_hashes(left, right, data):
    powers = spans.Powers()
    a, b = spans.PrefixHashes(left, powers), spans.PrefixHashes(right, powers)
    i, j = data.draw(st.integers(0, len(left))), data.draw(st.integers(0, len(right)))
    size = min(len(left) - i, len(right) - j)
    common = next((k for k in range(size) if left[i + k] != right[j + k]), size)
    assert a.extension(i, b, j) == common
    for k in range(size + 1):
        assert (a.span(i, i + k) == b.span(j, j + k)) == (left[i : i + k] == right[j : j + k])
    assert a.spans(2).tolist() == [a.span(k, k + 2) for k in range(len(left) - 1)]


@pytest.mark.parametrize("partitions", ["4", "1"])
def test_edits_by_brute_force(spark, odd, odd_rows, none, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = sorted(((r.doc_id, r.n_chars, r.edited, r.same_start_edited) for r in spans.edits(odd).collect()), key=str)
        likeness = [r.near_edited for r in spans.edits(odd).collect()]
        assert spans.edits(none).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    rows = sorted(((i, t or "") for i, t, *_ in odd_rows), key=lambda r: (-1 if r[0] is None else r[0], r[1].encode()))
    want = []
    for k, (doc_id, text) in enumerate(rows):
        following, half = rows[(k + 1) % len(rows)][1], len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        same = next((i for i, (a, b) in enumerate(zip(text, changed)) if a != b), min(len(text), len(changed)))
        want.append((doc_id, len(text), changed, same))
    assert got == sorted(want, key=str)
    assert all(0 <= x <= 1 for x in likeness)


def test_likeness_estimates_shared_text():
    rng, powers = np.random.default_rng(3), spans.Powers()
    text = "".join(map(chr, rng.integers(97, 123, 6000)))
    other = "".join(map(chr, rng.integers(97, 123, 6000)))
    one, half, none = (spans.sketch(spans.PrefixHashes(t, powers)) for t in (text, text[:3000] + other[:3000], other))
    assert spans.likeness(one, one) == 1 and spans.likeness(one, none) < 0.05 and 0.3 < spans.likeness(one, half) < 0.7
    assert (spans.parsed(spans.written(one)) == one).all()


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    with open(PATH, encoding="utf-8") as file:
        return bpe.Codec(file.read())


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=300) | st.lists(st.sampled_from([*"abé ́\t\n\x1c'sdt 字1²!", "<|endoftext|>", "hello"]), max_size=2000).map("".join))
def test_bpe_equals_the_library(tokenizer, own, text):
    want = tokenizer.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == want
    assert own.decode(want) == tokenizer.decode(want, skip_special_tokens=False)


def test_chunks_depend_on_content_alone():
    rng = np.random.default_rng(5)
    shared = "".join(map(chr, rng.integers(97, 123, 20_000)))
    chunks = lambda t: {t[a:b] for a, b in zip([0, *bpe.cuts(t)], bpe.cuts(t))}
    common = chunks("x" + shared) & chunks("something else " + shared)
    assert len(common) > 0.9 * len(chunks(shared))
    assert "".join(shared[a:b] for a, b in zip([0, *bpe.cuts(shared)], bpe.cuts(shared))) == shared


def test_bpe_of_odd_rows(odd, odd_rows, none, tokenizer):
    got = [(r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in bpe.decode(bpe.encode(odd, PATH), PATH).collect()]
    want = []
    for doc_id, text, *_ in odd_rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, len(ids), np.array(ids, dtype="<u4").tobytes(), tokenizer.decode(ids, skip_special_tokens=False)))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sorted(((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in bpe.round_trip(odd, PATH).collect()), key=str) == sorted(want, key=str)
    assert bpe.encode(none, PATH).count() == bpe.round_trip(none, PATH).count() == 0


def test_recent_is_bounded_by_bytes():
    cache = bpe.Recent(4 * (bpe.ENTRY_BYTES + 1 + 2 * bpe.ID_BYTES))
    for i in range(10):
        cache.put(str(i), (i, i))
        assert cache.get("0") == (0, 0)
    assert len(cache.young) + len(cache.old) <= 5 and cache.get("3") is None
    cache.put("x" * 100_000, (1,))
    cache.put("y" * 100_000, (1,))
    cache.put("z", (1,))
    assert len(cache.young) + len(cache.old) <= 2


def slow_viterbi(scores, penalty):
    best, path = scores[0].copy(), [[i] for i in range(scores.shape[1])]
    for row in scores[1:]:
        options = best[None, :] - penalty * (1 - np.eye(len(best)))
        path = [path[options[i].argmax()] + [i] for i in range(len(best))]
        best = options.max(axis=1) + row
    return best.max()


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 60), st.floats(0.5, 8))
def test_viterbi_is_optimal(seed, size, penalty):
    rng = np.random.default_rng(seed)
    scores = np.clip(rng.normal(0, 2, (size, 4)) + 2 * np.eye(4)[rng.integers(0, 2, size // 10 + 1).repeat(10)[:size]], -4, 4)
    path = language.viterbi(scores, penalty)
    worth = scores[np.arange(size), path].sum() - penalty * (path[1:] != path[:-1]).sum()
    assert worth == pytest.approx(slow_viterbi(scores, penalty))


def test_language_on_held_out_documents(spark):
    docs = read(spark, SMALL)
    model = language.train(docs)
    found = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(language.held_out())
    assert found.where("lang_pred <> lang").count() <= 0.03 * found.count()
    assert found.where("score < 0 OR score > 1").count() == 0
    texts = {lang: docs.where(F.col("lang") == lang).orderBy("doc_id").first().text for lang in ("en", "de")}
    mixed = texts["en"] + " " + texts["de"]
    _, _, parts = language.label(mixed, model)
    assert {p["lang"] for p in parts} == {"en", "de"}
    assert language.keep(docs, model).columns == docs.columns


def test_script_narrows_the_candidates():
    allowed = np.zeros((len(language.NAMES), 2), dtype=bool)
    allowed[language.NAMES.index("latin"), 0] = allowed[language.NAMES.index("cyrillic"), 1] = True
    model = language.Model(["en", "ru"], np.zeros((2, language.BUCKETS)), allowed)
    assert language.label("привет мир " * 5 + "hello there " * 9, model)[0] == "en"
    assert [s["lang"] for s in language.label("привет мир " * 9 + "hello there " * 9, model)[2]] == ["ru", "en"]


def test_language_of_odd_rows(spark, odd, odd_rows, none):
    model = language.train(odd)
    found = language.identify(odd, model).collect()
    assert len(found) == len(odd_rows)
    assert {r.lang_pred for r in found if r.doc_id in (0, 3, 6)} == {"und"}
    assert all(r.score == 0 and not r.spans for r in found if r.lang_pred == "und")
    empty = language.train(none)
    assert {r.lang_pred for r in language.identify(odd, empty).collect()} == {"und"}
    assert language.identify(none, model).count() == language.keep(none, model).count() == 0
    assert language.keep(odd, empty).count() == len(odd_rows)


LABELS = "doc_id long, quality int, toxic int"


def test_toxicity_learns_a_pair(spark):
    """Neither word alone is toxic here; only both together are."""
    texts = ["awful thing", "those people", "awful those", "plain words"]
    docs = spark.createDataFrame([(i, f"{texts[i % 4]} w{i % 7}", None, None, None) for i in range(800)], COLUMNS)
    labels = spark.createDataFrame([(i, 0, int(i % 4 == 2)) for i in range(800)], LABELS)
    found = toxicity.score(docs, toxicity.train(docs, labels)).where(toxicity.held_out())
    wrong = found.where((F.col("score") >= 0.7) != (F.col("doc_id") % 4 == 2)).count()
    assert wrong <= 0.02 * found.count()


def test_toxicity_learns_from_a_pair_alone(spark):
    """Toxic if exactly one of two words is there: each is as frequent in clean texts as in toxic ones."""
    rng = random.Random(4)
    both = [(rng.random() < 0.5, rng.random() < 0.5) for _ in range(3000)]
    noise = [sentence(rng, 3) for _ in range(300)]
    docs = spark.createDataFrame(
        [(i, f"{'insult ' * a}{' '.join(rng.sample(noise, 5))}{' group' * b}", None, None, None) for i, (a, b) in enumerate(both)], COLUMNS)
    labels = spark.createDataFrame([(i, 0, int(a != b)) for i, (a, b) in enumerate(both)], LABELS)
    found = toxicity.score(docs, toxicity.train(docs, labels)).where(toxicity.held_out()).collect()
    wrong = sum((r.score >= 0.7) != (both[r.doc_id][0] != both[r.doc_id][1]) for r in found)
    assert len(found) > 900 and wrong <= 0.02 * len(found)


def test_toxicity_on_the_given_labels(spark):
    """Held-out labels of the given tables: how often a toxic document scores above a clean one."""
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    told = docs.join(labels.select("doc_id", "toxic").where("toxic IS NOT NULL"), "doc_id")
    found = toxicity.score(told, toxicity.train(docs, labels)).join(told.select("doc_id", "toxic"), "doc_id").where(toxicity.held_out()).collect()
    toxic, clean = (np.array([r.score for r in found if r.toxic == y]) for y in (1, 0))
    assert (toxic[:, None] > clean).mean() + 0.5 * (toxic[:, None] == clean).mean() >= 0.94
    assert (toxic >= 0.7).mean() >= 0.75 and (clean >= 0.7).mean() <= 0.005


def test_toxicity_of_odd_rows(spark, odd, odd_rows, none):
    labels = spark.createDataFrame([(3, 1, 1), (3, 1, 0), (None, 1, 1), (6, 0, None), (9, 1, 1), (12, 0, 0), (12, 0, 0)], LABELS)
    picked = {tuple(r) for r in toxicity.training_rows(labels).collect()}
    assert picked <= {(9, 1), (12, 0)}
    found = toxicity.score(odd, toxicity.train(odd, labels)).collect()
    assert len(found) == len(odd_rows) and all(0 <= r.score <= 1 for r in found)
    nothing = toxicity.train(none, none.selectExpr("doc_id", "1 AS quality", "1 AS toxic"))
    assert {r.score for r in toxicity.score(odd, nothing).collect()} == {0.5}
    assert toxicity.score(none, nothing).count() == 0


def worth(scores, path, penalty):
    return scores[np.arange(len(path)), path].sum() - penalty * (path[1:] != path[:-1]).sum()


def test_viterbi_does_not_stay_with_a_label_that_is_best_nowhere():
    scores = np.array([[4, -4, 1.25]] * 4 + [[-4, 4, 1.25]] * 4)
    path = language.viterbi(scores, 12)
    assert path.tolist() == [0] * 4 + [1] * 4 and worth(scores, path, 12) == slow_viterbi(scores, 12) == 20


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10_000), st.integers(2, 12), st.floats(2, 14))
def test_viterbi_is_optimal_with_three_raised_labels(seed, half, penalty):
    rng = np.random.default_rng(seed)
    scores = np.array([[4, -4, 1.25, -2]] * half + [[-4, 4, 1.25, -2]] * half) + rng.normal(0, 0.5, (2 * half, 4))
    assert worth(scores, language.viterbi(scores, penalty), penalty) == pytest.approx(slow_viterbi(scores, penalty))


def test_ibans_end_where_their_country_says():
    found = lambda text: [text[s["start"] : s["end"]] for s in pii.find_in_text(text) if s["kind"] == "iban"]
    one, two = "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"
    for after in (" BIC COBADEFF", " 100 EUR", " MAX MUSTERMANN", ".", " please", ""):
        assert found(f"IBAN {one}{after}") == [one]
    assert found(f"{one} {two} {one}") == [one, two, one] and found(f"AB12 {one}") == [one]
    assert found(f"x{one}") == found(f"{one}0") == found(f"{one[:-1]}1 BIC COBADEFF") == []
