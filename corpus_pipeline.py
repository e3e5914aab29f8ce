"""A document pipeline of five operators: toxicity, near duplicates, benchmarks, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylog.llm import packing, secrets, simhash, spaced_seeds, toxicity
from quaylog.llm.staging import Stage, bounded_batches


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned lexicon doesn't call toxic.

    Each row is judged by its text, so ids may be null or repeated. Null and empty texts have the
    score of a text without hits. Without labels all documents have one score, below the threshold.
    """
    bounded_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    lexicon = toxicity.learn_lexicon(docs, labels.where(~toxicity.held_out()))
    return docs.where(~toxicity.toxic(docs["text"], lexicon))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that fingerprints or shingles of five words link: that of the smallest id.

    Different texts of one id are different documents, repeated rows are copies, null ids come
    last. Texts without words are copies of each other.
    """
    bounded_batches(spark)
    return simhash.representatives(docs, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark.

    Each row is judged by its text, so ids may be null or repeated. Null and empty texts stay.
    """
    bounded_batches(spark)
    return spaced_seeds.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked and, where they have ``n_chars``, their lengths counted anew.

    Null texts stay null, and so does their length. Ids play no part.
    """
    bounded_batches(spark)
    clean = secrets.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(docs.columns)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens, mixed by source.

    A null or empty text is one end-of-text id. Null and repeated ids are packed row by row.
    """
    bounded_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_documents),
]

#: SQL can't express the learned lexicon, the fingerprints or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        table = Stage(stage(spark, docs, sf_dir), name)
        if before:
            before.drop()
        docs, before = table.df, table
    return STAGES[-1][1](spark, docs, sf_dir)
