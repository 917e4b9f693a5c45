"""From raw documents to token ids: five stages, each over all rows that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns the columns of documents, the last one token ids instead. run() writes each
stage's rows as Parquet to the shared folder and reads them again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evgraph.llm.bpe_chunks import bpe_encode
from evgraph.llm.mixing import mix
from evgraph.llm.ngram_join import ngram_jaccard
from evgraph.llm.shared import store
from evgraph.llm.suffix_dedup import suffix_dedup
from evgraph.llm.toxicity import learn, score


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity, learned from those of docs that sf_dir labels, is under 0.3.

    Each row is judged alone by its text; a null or empty one has no toxic window and stays. Null ids have no label. Repeated rows go or stay together.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(docs, learn(docs, labels), docs.columns, "toxicity_of_text")
    return scored.filter(F.col("toxicity_of_text") < 0.3).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id, then text hash; rows that repeat both are copies too.

    Rows without a doc_id can't be compared, and texts without words (null ones too) have no copies: they stay. Rows that repeat a doc_id with another text are
    documents of their own. An empty table gives no rows.
    """
    found = ngram_jaccard(docs).filter(F.col("group_id").isNotNull())
    first = found.groupBy("group_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("first")).select(F.col("first.doc_id").alias("kept_id"), F.col("first.text_hash").alias("kept_hash"))
    wordless = F.length(F.translate(F.coalesce("text", F.lit("")), " \t\n\x0b\x0c\r", "")) == 0
    same = (F.col("doc_id").cast("long") == F.col("kept_id")) & (F.xxhash64("text") == F.col("kept_hash"))
    kept = docs.join(first, same).dropDuplicates(["kept_id", "kept_hash"])
    return kept.select(docs.columns).unionByName(docs.filter(F.col("doc_id").isNull() | wordless))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 200 bytes that occur elsewhere; characters that lose a byte go whole."""
    done = suffix_dedup(docs, whole_characters=True, keep=[c for c in docs.columns if c not in ("doc_id", "text")])
    text = done.withColumn("text", F.col("kept").cast("string")).withColumn("n_chars", F.length("text").cast("long"))
    return text.select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents whose tokens meet the targets of sources, languages and topics; rare values may come in copies.

    Null sources and languages are a value of their own; texts without words follow their cell; rows with equal doc_id and text share one fate.
    """
    mixed = mix(docs).filter("kept").withColumn("mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return mixed.select(docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document; a null or empty text has none, and repeated rows get equal ids."""
    import public_tokenizers

    return bpe_encode(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("mixture", mixture),
    ("encoding", encoding),
]

# fitted models, raking and tokenization have no SQL form; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
