"""A bounded sample of labelled documents to learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, held_out

#: The most labelled documents that a model is fitted on, whatever the tables hold.
SAMPLE = 6000


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, most: int = SAMPLE) -> DataFrame:
    """(doc_id, text, label): at most `most` documents with label 0 or 1, by a hash of doc_id, none of them held out.

    Null ids and labels other than 0 and 1 are left out; a doc_id with several labels or texts counts with the smallest.
    """
    known = labels.filter(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.min(column).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return durable(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")))
