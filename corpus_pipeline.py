"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as Parquet and
read again as the next stage's docs. All but the last keep the columns of documents.

Defined results of every stage: a null text is the empty one, scored, compared and packed like any
other; whole texts are read however long they are; a null doc_id is kept and never learnt from; ties
go to the lower doc_id (nulls last), then to the hash of the text; rows repeated in all of doc_id and
text are one document from near_duplicates on; an empty table gives an empty result; further columns
of documents, also such as clash with names used inside, come through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import decontaminate, packing, quality, secrets, similar
from tracewell.llm.common import staged
from tracewell.llm.tokens import vocabulary


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, learnt from ``labels``, does not reject."""
    return quality.accepted(docs, quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without one of a lower doc_id among those kept that shares 0.8 or more of their five-word shingles (Jaccard)."""
    return similar.one_of_similar(docs)


def no_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten-word window of ``benchmark`` occurs."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced."""
    return secrets.redact(docs, secrets.learn(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 ids, in the mixture of their sources."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), end_id=0)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_near_duplicates),
    ("decontamination", no_benchmark_passages),
    ("secrets", no_secrets),
    ("packing", packed),
]

#: SQL cannot express the classifier, the fingerprints or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
