"""Training-corpus pipeline: five stages over ``documents``, each written as Parquet and reread by the next.

1. ``toxicity``: documents that score 0.5 or more go. The model learns from the stage's own input and the labels.
2. ``near_dedup``: one document of each component of five-word shingle similarity >= 0.8 stays, that of the smallest doc_id.
3. ``decontamination``: documents in which a benchmark item occurs within its edit budget go.
4. ``pii``: personal data is replaced by the name of its kind; no document goes.
5. ``encoding``: every text as byte-level BPE ids (little-endian unsigned 32-bit), with the check that they decode to it.

Null, empty and repeated rows and extra columns: see each operator. An empty table passes as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.llm import decontaminate, merge_replay, near_dedup, pii, toxicity
from wardflow.llm.common import table
from wardflow.session import run_folder


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.harmless(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    encoded = merge_replay.encode_rows(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return encoded.withColumn("round_trip", F.col("decoded") == F.coalesce("text", F.lit(""))).drop("decoded")


STAGES = [
    ("toxicity", remove_toxic),
    ("near_dedup", keep_one_of_each),
    ("decontamination", remove_contaminated),
    ("pii", mask_personal_data),
    ("encoding", encode),
]

ORACLE_SQL = None  # a trained model, similarity components and BPE are not expressible; tests/llm has brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, folder = table(spark, sf_dir, "documents"), run_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
