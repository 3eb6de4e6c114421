"""Documents to training tokens: language, exact dedup, near dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the columns of
`documents`. Between stages the rows are written as Parquet below spark.checkpoint.dir and read again.
An empty table passes all stages and stays empty.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import bpe, exact_dedup, language, mixing, simhash
from gaugeworks.llm.common import SharedTables, read

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language cannot be told: without letters, null ones included, or with a score below 0.4 (several
    languages, none of which has most of the text). Where no document has a language to learn from, all stay."""
    return language.keep(docs, language.train(docs)).select(*COLUMNS)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id stays. Null texts count as empty; a null id is the smallest; of rows that
    repeat id and text one stays."""
    return exact_dedup.keep(docs).select(*COLUMNS)


def distinct_contents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates, the document with the smallest id stays, however long the texts. Texts without words, null ones
    included, are near duplicates of each other; of rows that repeat id and text one stays."""
    return simhash.keep(docs).select(*COLUMNS)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that words of a document are used, up to two; the text is the words used, n_chars its length.

    Documents of which no block was drawn are not in the mixture.
    """
    mixed = mixing.Mixture(docs, carry=COLUMNS).texts()
    kept = [F.col(f"carried.{c}").alias(c) for c in COLUMNS if c not in ("text", "n_chars")]
    return mixed.select(*kept, "text", F.char_length("text").cast("long").alias("n_chars")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (packed as little-endian 32-bit numbers), ids_sha256, decoded_sha256: one row per row, null texts as
    empty ones."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.round_trip(docs, path).select(
        "doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language", known_language),
    ("exact_dedup", distinct_texts),
    ("simhash", distinct_contents),
    ("mixing", mixed_sources),
    ("bpe", tokens),
]

# Trained and iterative stages: tests compare run() with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, docs = SharedTables(spark, "pipeline"), read(spark, sf_dir)
    for name, stage in STAGES:
        docs = tables.write(stage(spark, docs, sf_dir), name)
    return docs
