"""The corpus pipeline: documents in, one training file's worth of token digests out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last
return the columns of ``documents``. Part of the llm subpackage's deliverable.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm._common import scratch_dir, table
from lexmill.llm.decontamination import clean_documents
from lexmill.llm.jaccard_join import drop_near_copies
from lexmill.llm.quality_rules import quality_keepers
from lexmill.llm.queries import tokenizer_path
from lexmill.llm.source_mixing import mixed_documents
from lexmill.llm.token_files import fresh_folder, token_digests, write_tokens


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the adaptive thresholds keep."""
    return quality_keepers(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return drop_near_copies(docs, k=5, threshold=(8, 10))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in whose text no benchmark item is found."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token files of what is left, read back from the files: doc_id, start, n_tokens, ids_crc32."""
    folder = fresh_folder(spark)
    write_tokens(docs, folder, tokenizer_path("word_bpe_49k.json"), end_id=1)
    return token_digests(spark, folder, last=True).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]

#: Tokenizing and edit distances aren't SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", F.col("n_chars"))
    folder = f"{scratch_dir(spark)}/lexmill/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
