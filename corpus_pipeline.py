"""The corpus pipeline: toxicity, exact copies, near copies, source mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages
the rows are written as Parquet and read again, so a lost executor costs a part
of one stage and no plan grows across stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import cut, table
from llm.exact_dedup import drop_copies
from llm.mixing import select_documents
from llm.ngram_join import one_of_each_group
from llm.pieces import encode_and_decode, token_digests
from llm.toxicity import score_documents

#: Of the tokens that reach the mixing stage, the share that the corpus gets; every source is read at most once.
MIX_FRACTION, MIX_WEIGHTS = 0.9, {("domain0",): 1.0, ("domain1",): 1.0, ("domain2",): 1.0, ("domain3",): 1.0}


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects by their language's calibrated threshold go."""
    scored = cut(score_documents(docs, table(spark, sf_dir, "labels")).where("toxic_by_lang").select(F.col("doc_id").alias("id__")).distinct(), "toxic")
    return docs.join(scored, docs.doc_id == scored.id__, "left_anti")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a 5-word Jaccard similarity of 0.8 or more stays."""
    return one_of_each_group(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return select_documents(docs, fraction=MIX_FRACTION, weights=MIX_WEIGHTS, max_epochs=1)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_digests(encode_and_decode(docs))


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("encode", encode),
]

#: A trained classifier decides in the first stage, so SQL has no expression for run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
