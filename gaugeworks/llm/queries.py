"""The registered queries of this subpackage: each applies its operator to whole tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import bpe, collocations, exact_dedup, language, mixing, pii, search, simhash, sketch_join, spans, suffix_dedup, token_rollup, toxicity
from gaugeworks.llm.common import WORD, SharedTables, read
from gaugeworks.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    counts = [F.expr(f"size(filter(spans, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in pii.BASE_KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(pii.joined(base).cast("binary"), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: s["score"]), ",").alias("scores"),
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under two tokenizer versions; the second one's counts revised; toxic documents taken back; one batch sent twice.
    The totals come from a snapshot of the first two batches and the deltas after it.

    The second version first counts each digit by itself; the revision counts runs of digits. A document is taken back with all
    rows of its doc_id.
    """
    docs, labels = read(spark, sf_dir), read(spark, sf_dir, "labels")
    first = token_rollup.counted(docs, "words-1", F.regexp_count("text", F.lit(WORD)))
    second = token_rollup.counted(docs, "pieces-2", F.regexp_count("text", F.lit(r"[A-Za-z]+|[0-9]|[^\x20\x09-\x0DA-Za-z0-9]")))
    revised = token_rollup.counted(docs, "pieces-2", F.regexp_count("text", F.lit(r"[A-Za-z]+|[0-9]+|[^\x20\x09-\x0DA-Za-z0-9]")))
    toxic = labels.where("toxic = 1").select("doc_id").distinct()
    taken_back = first.join(toxic, "doc_id", "left_semi")
    rollup = token_rollup.Rollup(spark, SharedTables(spark, "token-counts").path("rollup"))
    rollup.commit("load", token_rollup.inserts(first))
    rollup.commit("second-version", token_rollup.inserts(second))
    rollup.compact()
    rollup.drop_covered()
    rollup.commit("second-revised", token_rollup.revisions(second, revised))
    rollup.commit("toxic", token_rollup.deletes(taken_back))
    rollup.commit("load", token_rollup.inserts(first))
    return rollup.totals()


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans.edits(read(spark, sf_dir))
    return found.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        "near_edited", "near_next", "same_start_edited", "same_start_next",
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mixture(read(spark, sf_dir)).taken()


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.annotate(read(spark, sf_dir))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read(spark, sf_dir)).select(
        "doc_id", "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir)
    machine = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, machine).select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.round_trip(read(spark, sf_dir), path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir)
    found = language.identify(docs, language.train(docs))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.Index(read(spark, sf_dir)).search(read(spark, sf_dir, "benchmark"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.Collocations(read(spark, sf_dir)).best()


def op13_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch_join.join(read(spark, sf_dir))


QUERIES = {
    "op1_simhash": op1_simhash, "op2_pii": op2_pii, "op3_token_counts": op3_token_counts, "op4_fingerprints": op4_fingerprints,
    "op5_mixing": op5_mixing, "op6_exact_dedup": op6_exact_dedup,
    "op7_suffix_dedup": op7_suffix_dedup, "op8_toxicity": op8_toxicity, "op9_bpe": op9_bpe, "op10_language": op10_language,
    "op11_search": op11_search, "op12_collocations": op12_collocations,
    "op13_sketch_join": op13_sketch_join,
}
