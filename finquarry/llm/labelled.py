"""A bounded, keyed sample of labelled documents, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finquarry.llm.common import hashed_sample


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, where=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, label int) of at most `most` labelled rows, those of the ids with the smallest hashes.

    Null labels and ids count as unlabelled; of repeated labels of one id the largest holds. Of documents that share a
    sampled id the least text comes, null last, so an id is one row however often it is repeated. The sampled ids are at
    most `most` rows, so they are broadcast.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("label")).dropna()
    if where is not None:
        known = known.filter(where)
    ids = hashed_sample(known.groupBy("doc_id").agg(F.max("label").alias("label")), "doc_id", most)
    ids = docs.sparkSession.createDataFrame([(r.doc_id, r.label) for r in ids.collect()], "doc_id long, label int")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")
