"""A corpus from documents to token ids, stage by stage.

Every stage gets the rows its predecessor kept and gives rows with the columns of
``documents``, but for the last, which gives token ids. A table that is empty, or becomes
so, passes through all stages.

quality        rows that the base rules or the model reject go
near_duplicates one row of each group of near copies stays
decontamination rows that hold a test item go
personal_data  personal data and the terms that reveal it are replaced in the text
token_ids      doc_id, n_tokens, digests of the ids and of the decoded text, ids
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fieldtally.llm import bpe, decontaminate, near_duplicates, pii, quality
from fieldtally.llm.common import table
from fieldtally.session import scratch_folder


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.judge(docs, quality.train(docs, table(spark, sf_dir, "labels")), keep=True)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.one_of_each(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitised(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(docs, ranks, public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", keep_uncontaminated),
    ("personal_data", hide_personal_data),
    ("token_ids", token_ids),
]

#: The model, the alignment and the encoding are beyond SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
