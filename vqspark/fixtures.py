"""Tables derived from the given ones, for queries and tests, with their DuckDB twins as CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import ship

# Evaluation tasks with category and expected number of rows.
TASKS = [
    ("narrativeqa", "SingleQA", 200), ("qasper", "SingleQA", 200), ("multifieldqa_en", "SingleQA", 150),
    ("hotpotqa", "MultiQA", 200), ("2wikimqa", "MultiQA", 200), ("musique", "MultiQA", 200),
    ("gov_report", "Summarization", 200), ("qmsum", "Summarization", 200), ("multi_news", "Summarization", 200),
    ("trec", "Few shot", 200), ("triviaqa", "Few shot", 200), ("samsum", "Few shot", 200),
    ("passage_retrieval_en", "Synthetic", 200), ("passage_count", "Synthetic", 200), ("lcc", "Code", 500), ("repobench-p", "Code", 500),
]
POSITIONS = ["start", "middle", "end"]
LANGS = ["en", "de", "es", "fr", "hi", "ru", "vi", "zh"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession) -> DataFrame:
    """The dimension of tasks: dataset, category, expected. Its size is fixed, so it may be broadcast."""
    return F.broadcast(spark.createDataFrame(TASKS, "dataset string, category string, expected long"))


TASKS_CTE = "tasks(dataset, category, expected) AS (VALUES " + ", ".join(f"('{d}', '{c}', CAST({n} AS BIGINT))" for d, c, n in TASKS) + ")"
_NAMES = "[" + ", ".join(f"'{d}'" for d, _, _ in TASKS) + "]"


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows of two methods at two bit widths, one of each document; the variant lacks some rows of one task."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    names = F.array(*[F.lit(d) for d, _, _ in TASKS])
    rows = docs.select(
        F.element_at(names, (F.col("doc_id") % 16 + 1).cast("int")).alias("dataset"), F.expr("doc_id div 16").alias("index"), F.col("n_chars").cast("long").alias("prompt_tokens"),
        (F.col("doc_id") % 25).alias("passage_count"), (F.col("doc_id") * 7 % 130).alias("question_marks"), "doc_id",
    )
    methods = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.lit(b).alias("bits")) for m in ("base", "variant") for b in (2.5, 3.5)])).alias("run")
    rows = rows.select("*", methods).select("*", "run.method", "run.bits").drop("run")
    variant, high = (F.col("method") == "variant").cast("int"), (F.col("bits") == 3.5).cast("int")
    rows = rows.withColumns({
        "code_like": F.col("dataset").isin("lcc", "repobench-p"),
        "score": (F.col("doc_id") * 37 + 11 * variant + 5 * high) % 101 / F.lit(100.0),
        "latency": (F.col("doc_id") % 13 + 1) / F.lit(4.0), "ratio": F.col("bits") / 16,
    }).drop("doc_id")
    return rows.filter(~((F.col("dataset") == "trec") & (F.col("method") == "variant") & (F.col("index") % 17 == 5)))


RESULTS_CTE = f"""results AS (
    SELECT dataset, index, prompt_tokens, passage_count, question_marks, method, bits, dataset IN ('lcc', 'repobench-p') AS code_like,
        ((doc_id * 37 + 11 * (method = 'variant')::INT + 5 * (bits = 3.5)::INT) % 101) / 100.0::DOUBLE AS score, (doc_id % 13 + 1) / 4.0::DOUBLE AS latency, bits / 16 AS ratio
    FROM (SELECT doc_id, {_NAMES}[doc_id % 16 + 1] AS dataset, doc_id // 16 AS index, CAST(n_chars AS BIGINT) AS prompt_tokens, doc_id % 25 AS passage_count, doc_id * 7 % 130 AS question_marks FROM documents),
        (VALUES ('base'), ('variant')) m(method), (VALUES (2.5::DOUBLE), (3.5::DOUBLE)) b(bits)
    WHERE NOT (dataset = 'trec' AND method = 'variant' AND index % 17 = 5))"""


def needle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Needle runs: one row per document."""
    d = F.col("doc_id")
    pick = lambda values, by: F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        d.alias("index"), F.when(d % 50 == 0, "other").otherwise(pick(POSITIONS, d)).alias("needle_position"), pick(LANGS, d).alias("distractor_lang"),
        (F.col("n_chars").cast("long") * 20).alias("prompt_tokens"), F.when(d % 2 == 0, d % 4 * 4000 + 4000).alias("target_prompt_tokens"),
        (d * 7 % 10 < 6).alias("answer_contains"), ((d % 9 + 1) / F.lit(4.0)).alias("latency_seconds"),
    )


NEEDLE_CTE = """needle AS (
    SELECT doc_id AS index, CASE WHEN doc_id % 50 = 0 THEN 'other' ELSE ['start', 'middle', 'end'][doc_id % 3 + 1] END AS needle_position,
        ['en', 'de', 'es', 'fr', 'hi', 'ru', 'vi', 'zh'][doc_id % 8 + 1] AS distractor_lang, CAST(n_chars AS BIGINT) * 20 AS prompt_tokens,
        CASE WHEN doc_id % 2 = 0 THEN doc_id % 4 * 4000 + 4000 END AS target_prompt_tokens, doc_id * 7 % 10 < 6 AS answer_contains,
        (doc_id % 9 + 1) / 4.0::DOUBLE AS latency_seconds FROM documents)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings scaled so that norms differ and four channels dominate: vec_id, label, vec."""
    factor = (1 + F.col("vec_id") % 7) / 2
    vec = F.transform("embedding", lambda x, j: x.cast("double") * factor * F.when(j % 16 == 2, 4.0).otherwise(1.0))
    return spread(table(spark, sf_dir, "embeddings")).select("vec_id", "label", vec.alias("vec"))


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer partitions than cores is dealt out first; a larger one stays as it is, without a shuffle."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


VECTORS_CTE = """vectors AS (
    SELECT vec_id, label, list_transform(embedding, lambda x, j: CAST(x AS DOUBLE) * (1 + vec_id % 7) / 2 * CASE WHEN j % 16 = 3 THEN 4.0 ELSE 1.0 END) AS vec FROM embeddings)"""


def kv_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key and value states of four layers, two heads and eight positions: one row per vector."""
    return with_slots(vectors(spark, sf_dir))


def with_slots(df: DataFrame) -> DataFrame:
    v = F.col("vec_id")
    return df.withColumns({
        "seq_id": F.expr("vec_id div 128"), "layer": F.expr("vec_id div 4 % 4"), "side": F.when(v % 2 == 0, "key").otherwise("value"),
        "head": F.expr("vec_id div 2 % 2"), "pos": F.expr("vec_id div 16 % 8"), "segment_id": F.lit(0).cast("long"),
    })


KV_CTE = VECTORS_CTE + """, kv AS (
    SELECT *, vec_id // 128 AS seq_id, (vec_id // 4) % 4 AS layer, CASE WHEN vec_id % 2 = 0 THEN 'key' ELSE 'value' END AS side,
        (vec_id // 2) % 2 AS head, (vec_id // 16) % 8 AS pos FROM vectors)"""


def q_states(spark: SparkSession, sf_dir: str, t: int = 1) -> DataFrame:
    """Queries of the last t positions, two to a head: seq_id, layer, q_head, kv_head, pos, q."""
    rows = with_slots(spread(table(spark, sf_dir, "embeddings"))).filter(F.col("pos") >= 8 - t)
    q_head = F.col("head") * 2 + F.col("vec_id") % 2
    return rows.select("seq_id", "layer", q_head.alias("q_head"), F.expr("(head * 2 + vec_id % 2) div 2").alias("kv_head"), F.col("pos").alias("q_pos"), F.transform("embedding", lambda x: x.cast("double")).alias("q"))


def q_cte(t: int = 1) -> str:
    return f"""queries AS (
    SELECT vec_id // 128 AS seq_id, (vec_id // 4) % 4 AS layer, (vec_id // 2) % 2 * 2 + vec_id % 2 AS q_head, (vec_id // 2) % 2 AS kv_head, (vec_id // 16) % 8 AS q_pos,
        list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS q FROM embeddings WHERE (vec_id // 16) % 8 >= {8 - t})"""
