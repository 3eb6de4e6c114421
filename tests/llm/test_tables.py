"""Mixing, token rollups, the registered queries and the pipeline."""

import random
import re
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from llm_samples import COLUMNS, alike_roots, five_words, sentence, slow_fingerprint
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from gaugeworks.llm import mixing, token_rollup  # noqa: E402
from gaugeworks.llm.common import SharedTables, read  # noqa: E402
from gaugeworks.llm.oracles import ORACLES  # noqa: E402
from gaugeworks.llm.queries import QUERIES  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def plain(frame):
    return sorted(tuple(str(v) for v in r) for r in frame.select(*sorted(frame.columns)).collect())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_duckdb(spark, name):
    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    got = QUERIES[name](spark, SMALL)
    con.execute(ORACLES[name])
    columns = [d[0] for d in con.description]
    want = sorted(tuple(str(r[columns.index(c)]) for c in sorted(columns)) for r in con.fetchall())
    assert sorted(got.columns) == sorted(columns) and plain(got) == want


def slow_targets(sizes, weights=(5, 2, 1)):
    """Share, cap, and share the excess again until no source is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values())
    open_ = set(names)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = sum(max(0, target[s] - 2 * sizes[s]) for s in names)
        for s in names:
            if target[s] >= 2 * sizes[s]:
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


@pytest.fixture(scope="module")
def sized(spark):
    rng = random.Random(4)
    share = ["big"] * 60 + ["mid"] * 25 + ["small"] * 10 + [None] * 5
    return spark.createDataFrame([(i, sentence(rng, rng.randint(0, 400)), None, share[i % 100], None) for i in range(600)], COLUMNS).cache()


def test_mixture(sized):
    mixture = mixing.Mixture(sized, carry=("doc_id", "text"), block_words=16, bucket_rows=50)
    taken = mixture.taken().collect()
    sizes = Counter()
    for r in taken:
        sizes[r.source] += r.size
        assert 0 <= r.taken <= 2 * r.size
    targets = slow_targets(sizes)
    for source, target in targets.items():
        own = [r for r in taken if r.source == source]
        assert {round(r.target, 6) for r in own} == {round(target, 6)} and {r.source_size for r in own} == {sizes[source]}
        assert abs(sum(r.taken for r in own) - target) <= 40
    again = mixing.Mixture(sized.repartition(5), block_words=16, bucket_rows=50).taken()
    assert plain(again) == plain(mixture.taken())
    words = Counter()
    for r in mixture.texts().collect():
        words[r.carried.doc_id] += len(r.text.split())
        rest = iter(r.carried.text.split())
        assert all(w in rest for w in r.text.split())
    assert {r.doc_id: r.taken for r in taken if r.taken} == dict(words)


def test_permutation_and_shards(spark, sized):
    for size in (1, 2, 7, 64, 1000):
        frame = spark.range(size).selectExpr("id", f"cast({size} AS BIGINT) AS n", "3L AS source_no").withColumn("keys", mixing.round_keys("source_no", "n", 9))
        values = [r[0] for r in frame.select(mixing.permuted("id", "n", "keys")).collect()]
        assert sorted(values) == list(range(size)) and (size < 64 or values != list(range(size)))
    mixture = mixing.Mixture(sized, block_words=16, shard_slots=500)
    counts = mixing.shard_counts(mixture.slots).collect()
    total = sum(r.slots for r in counts)
    by_shard, by_key = Counter(), Counter()
    for r in counts:
        by_shard[r.shard] += r.slots
        by_key[r.key] += r.slots
    assert len(by_shard) == -(-total // 500) and min(by_shard.values()) > 350
    assert dict(by_key) == {r.key: r.n_slots for r in mixture.per_source.collect()}
    top = by_key.most_common(1)[0]
    shares = [r.slots / by_shard[r.shard] for r in counts if r.key == top[0]]
    assert max(abs(s - top[1] / total) for s in shares) < 0.1


def test_mixture_of_odd_rows(odd, odd_rows, none):
    taken = mixing.Mixture(odd).taken().collect()
    assert len(taken) == len(odd_rows) and all(0 <= r.taken <= 2 * r.size for r in taken)
    assert [r.size for r in taken if r.doc_id == 0] == [0]
    assert mixing.Mixture(none).taken().count() == mixing.Mixture(none, carry=("text",)).texts().count() == 0
    blank = none.sparkSession.createDataFrame([(1, None, None, None, None), (2, " ", None, "a", None)], COLUMNS)
    assert {(r.target, r.taken) for r in mixing.Mixture(blank).taken().collect()} == {(0.0, 0)}


def test_blocks_are_not_broadcast(spark, sized):
    """The table of used blocks grows with the corpus: it meets the documents in a shuffle, whatever Spark takes its size for."""
    mixture = mixing.Mixture(sized, carry=("doc_id", "text"), block_words=16)
    for frame in (mixture.taken(), mixture.texts()):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        joins = re.findall(r"(\w+Join) \[key#\d+, (?:block|at)#", plan)
        assert joins == ["SortMergeJoin"]


def test_texts_without_words_keep_their_row_and_use_no_block(spark):
    rows = [(i, None if i % 3 else "one two three", "en", "s", 0) for i in range(30)]
    mixture = mixing.Mixture(spark.createDataFrame(rows, COLUMNS), carry=("doc_id",), block_words=4)
    taken = {r.doc_id: (r.size, r.shards) for r in mixture.taken().collect()}
    assert len(taken) == 30 and all(taken[i] == (0, "") for i in range(30) if i % 3)
    parts = mixture.used_parts().where("block IS NULL").collect()
    assert [(r.words, r.uses, r.shards) for r in parts] == [(0, 0, None)] * 20


def test_rollup_commits_once_and_adds_up(spark, odd, none):
    rollup = token_rollup.Rollup(spark, SharedTables(spark, "test-rollup").path("r"))
    assert rollup.totals().count() == 0
    counts = token_rollup.counted(odd, "v1", F.length("text"))
    assert rollup.commit("a", token_rollup.inserts(counts)) and not rollup.commit("a", token_rollup.inserts(counts))
    want = odd.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("tokens"))
    assert plain(rollup.totals().drop("tokenizer")) == plain(want)
    revised = token_rollup.counted(odd, "v1", F.lit(1))
    rollup.commit("b", token_rollup.revisions(counts, revised))
    assert {r.documents == r.tokens for r in rollup.totals().collect()} == {True}
    rollup.commit("c", token_rollup.deletes(revised))
    rollup.commit("d", token_rollup.inserts(token_rollup.counted(none, "v1", F.lit(1))))
    assert rollup.totals().count() == 0 and rollup.batches() == ["a", "b", "c", "d"]
    with pytest.raises(ValueError):
        rollup.commit("../x", token_rollup.inserts(counts))


def test_rollup_reads_a_snapshot_and_later_batches(spark, odd):
    rollup = token_rollup.Rollup(spark, SharedTables(spark, "test-rollup").path("r"))
    assert not rollup.compact() and rollup.totals().count() == 0
    one, two = (token_rollup.counted(odd, "v1", F.lit(n)) for n in (1, 2))
    rollup.commit("a", token_rollup.inserts(one))
    rollup.commit("b", token_rollup.revisions(one, two))
    want = plain(rollup.totals())
    # A compaction that ends before its manifest changes nothing.
    broken = rollup.write_snapshot()
    again = token_rollup.Rollup(spark, rollup.path)
    assert again.manifest() == (0, None, []) and plain(again.totals()) == want
    assert again.compact() and not again.compact() and plain(again.totals()) == want
    # One that comes too late leaves the manifest that was first.
    named = again.manifest()
    assert not again.publish(*broken) and again.manifest() == named
    again.drop_covered()
    assert {f.split("/")[-2] for f in again.totals().inputFiles()} == {named[1].rsplit("/", 1)[1]} and plain(again.totals()) == want
    # What was compacted is not counted again.
    assert not again.commit("a", token_rollup.inserts(one)) and again.batches() == ["a", "b"]
    again.commit("c", token_rollup.inserts(one))
    read = {f.split("/")[-2] for f in again.totals().inputFiles()}
    assert read == {named[1].rsplit("/", 1)[1], "batch=c"}
    again.commit("d", token_rollup.deletes(two))
    assert again.compact() and again.manifest()[0] == 2
    again.drop_covered()
    assert plain(again.totals()) == plain(one.groupBy("source", "lang", "tokenizer").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens")))



def test_rollup_redoes_a_batch_that_broke_off(spark, odd):
    rollup = token_rollup.Rollup(spark, SharedTables(spark, "test-rollup").path("r"))
    counts = token_rollup.inserts(token_rollup.counted(odd, "v1", F.length("text")))
    rollup.commit("a", counts)
    total = plain(rollup.totals())
    files, marker = rollup._files(f"{rollup.path}/batch=a/_SUCCESS")
    files.delete(marker, False)
    assert rollup.totals().count() == 0
    assert rollup.commit("a", counts) and plain(rollup.totals()) == total


def test_pipeline_against_brute_force(spark):
    """Each stage on what the one before it kept, by other means."""
    tables, docs, seen = SharedTables(spark, "test-pipeline"), read(spark, SMALL), []
    for name, stage in corpus_pipeline.STAGES:
        docs = tables.write(stage(spark, docs, SMALL), name)
        seen.append(docs)
        if name != "bpe":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    start = {r.doc_id: r.text for r in read(spark, SMALL).collect()}
    told = {r.doc_id for r in seen[0].select("doc_id").collect()}
    assert len(told) >= 0.98 * len(start)
    last = {}
    for i in sorted(told):
        last[start[i]] = i
    assert {r.doc_id for r in seen[1].select("doc_id").collect()} == set(last.values())
    ids = sorted(last.values())
    roots = alike_roots([five_words(start[i]) for i in ids])
    stays = {i for k, (i, r) in enumerate(zip(ids, roots)) if r == k}
    assert {r.doc_id for r in seen[2].select("doc_id").collect()} == stays
    sizes, words = Counter(), Counter()
    for r in seen[2].collect():
        sizes[r.source] += len(r.text.split())
    for r in seen[3].collect():
        words[r.source] += len(r.text.split())
        assert r.n_chars == len(r.text)
    for source, target in slow_targets(sizes).items():
        assert abs(words[source] - target) <= 2 * mixing.BLOCK_WORDS
    assert seen[4].count() == seen[3].count() == corpus_pipeline.run(spark, SMALL).count()


def test_documents_name_the_shards_of_their_words(spark):
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, sentence(rng, 40), None, f"s{i % 3}", 0) for i in range(300)], COLUMNS)
    mixture = mixing.Mixture(docs, block_words=16, shard_slots=64)
    counts = mixing.shard_counts(mixture.slots).collect()
    total, shards = sum(r.slots for r in counts), {r.shard for r in counts}
    assert len(shards) == -(-total // 64) > 10
    # Each source's counts are a multinomial draw over equally likely shards: chi square within six deviations.
    for key in {r.key for r in counts}:
        own = [sum(r.slots for r in counts if r.key == key and r.shard == s) for s in shards]
        mean = sum(own) / len(shards)
        chi = sum((n - mean) ** 2 / mean for n in own)
        assert abs(chi - len(shards) + 1) <= 6 * (2 * (len(shards) - 1)) ** 0.5
    found = mixture.taken().collect()
    assert {int(s) for r in found for s in r.shards.split(",") if s} == shards
    assert all((r.taken > 0) == bool(r.shards) for r in found)


@pytest.mark.parametrize("labelled", [True, False])
def test_pipeline_of_odd_rows(spark, odd, odd_rows, tmp_path, labelled):
    """Nulls, empty and very long texts, copies, repeated rows and clashing names; also where no document has a language."""
    docs = odd if labelled else odd.withColumn("lang", F.lit(None).cast("string"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    ids = {r[0] for r in odd_rows}
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert found and {r.doc_id for r in found} <= ids
    if not labelled:
        kept = corpus_pipeline.known_language(spark, read(spark, str(tmp_path)), str(tmp_path))
        assert kept.count() == len(odd_rows) and kept.columns == list(corpus_pipeline.COLUMNS)


def test_pipeline_of_an_empty_table(spark, none, tmp_path):
    none.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_duplicate_stage_by_all_pairs(spark):
    """Five-word shingles, a Jaccard likeness of 0.8; some pairs of these are more than 4 bits apart."""
    docs = read(spark, SMALL)
    last = {r.text: r.doc_id for r in sorted(docs.collect(), key=lambda r: r.doc_id)}
    texts = {i: t for t, i in last.items() if t}
    ids, sets, far = sorted(texts), {}, 0
    for i in ids:
        words = texts[i].encode().lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    root = {i: i for i in ids}
    for k, i in enumerate(ids):
        for j in ids[:k]:
            common = len(sets[i] & sets[j])
            if 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common):
                far += (slow_fingerprint(texts[i]) ^ slow_fingerprint(texts[j])).bit_count() > 4
                low, high = sorted((root[i], root[j]))
                root = {n: low if r == high else r for n, r in root.items()}
    kept = corpus_pipeline.distinct_contents(spark, docs.where(F.col("doc_id").isin(ids)), SMALL)
    assert far and {r.doc_id for r in kept.collect()} == set(root.values())


def test_queries_read_whole_tables(spark):
    rows = read(spark, SMALL).count()
    for name in ("op1_simhash", "op2_pii", "op4_fingerprints", "op7_suffix_dedup", "op8_toxicity", "op9_bpe", "op10_language"):
        assert QUERIES[name](spark, SMALL).count() == rows, name
