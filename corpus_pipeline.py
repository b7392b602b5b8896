"""A corpus pipeline of five stages: each works on all that its predecessor kept.

Toxicity rejects documents; of each SimHash group one row, that with the least id,
stays; documents that hold benchmark windows go; the rest is mixed to the sources'
target weights, a document taken twice being two rows; the mix is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import cut
from lakeloom.llm.decontaminate import search_benchmark
from lakeloom.llm.mixing import mix
from lakeloom.llm.queries import table, vocabulary
from lakeloom.llm.simhash import one_of_each
from lakeloom.llm.token_store import token_table
from lakeloom.llm.toxicity import score, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).where("predicted = 0").select(*docs.columns)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = search_benchmark(docs, table(spark, sf_dir, "benchmark"))
    return found.where("NOT contaminated").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    each = F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))
    return mix(docs).select(*docs.columns, each.alias("__copy")).drop("__copy")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_table(docs, vocabulary())


STAGES = [("toxicity", toxicity), ("simhash", simhash), ("decontaminate", decontaminate), ("mixing", mixing), ("token_ids", token_ids)]

#: None: learned scores and XXH64 fingerprints have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
