"""The corpus pipeline: toxicity, near duplicates, surrogates, mixing, packing.

Each stage takes (spark, docs, sf_dir), where docs has the columns of `documents`, and works on all rows. All but the
last return these columns again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finquarry.llm.common import stage, table
from finquarry.llm.mixing import mixed_documents
from finquarry.llm.ngram_join import one_of_each_group
from finquarry.llm.packing import pack_documents
from finquarry.llm.pii import replace_pii
from finquarry.llm.queries import tokenizer_path
from finquarry.llm.toxicity import clean_documents


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return clean_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by the Jaccard similarity of their five-word n-grams, 0.8 or more, the smallest id stays."""
    return one_of_each_group(docs, 5, 8, 10)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets become surrogates; n_chars follows the text."""
    new = replace_pii(docs)
    length = F.when(F.col(new.columns[-1]) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return new.withColumn("n_chars", length).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document is dropped, kept or repeated."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences and offsets."""
    return pack_documents(docs, tokenizer_path())


STAGES = [("toxicity", toxicity), ("ngram_jaccard_join", near_duplicates), ("pii", surrogates), ("mixing", mixing), ("packing", packing)]
#: Random rounding and learned scores have no SQL; each stage is tested against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each result written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{name}")
    return docs
