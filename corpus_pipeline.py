"""The training-data pipeline: stages over the documents, each on all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again for the next
one. All stages but the last return the columns of documents. Stages drop whole documents or redact texts; documents
with nothing against them stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vqspark.llm.bpe import encode_decode
from vqspark.llm.common import durable, table
from vqspark.llm.decontamination import contaminated
from vqspark.llm.near_dups import near_duplicates, row_key
from vqspark.llm.pii import find_personal_data
from vqspark.llm.toxicity import score_toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents whose sets of five-word shingles are this alike, in hundredths, are near copies.
SIMILARITY = 80


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that aren't predicted to be toxic, by their own text."""
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"), carry=("text", "lang", "source", "n_chars"))
    return _columns(scored.filter("predicted = 0"))


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id.

    Rows that repeat both id and text are one; rows without doc_id stay if no row of their group has one.
    """
    groups = near_duplicates(docs, SIMILARITY)
    kept = groups.filter("kept or component_id is null").select("row_key").distinct()
    return _columns(docs.withColumn("row_key", row_key()).join(kept, "row_key", "left_semi").dropDuplicates(["row_key"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item, also not with other numbers, units or names; each row goes by its own text."""
    rows = docs.withColumn("row_key", row_key())
    found = contaminated(rows.select(F.col("row_key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return _columns(rows.join(found.select(F.col("doc_id").alias("row_key")).distinct(), "row_key", "left_anti"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind in brackets; n_chars follows the text."""
    found = find_personal_data(docs, carry=("lang", "source"))
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.coalesce(F.length("redacted"), F.lit(0)).cast("long").alias("n_chars"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of all documents: doc_id, n_tokens, ids, ids_sha256, decoded_sha256."""
    return encode_decode(docs, keep_offsets=False).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicate_groups),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: SQL can't express the learnt stages; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
