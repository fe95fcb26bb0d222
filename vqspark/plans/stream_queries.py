"""Queries that run streams over the given tables to their end and return what was written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as X
from ..operators import codec as V
from ..operators import segments as G
from ..sources import tables as S
from ..streaming import encode as E

QUERIES: dict = {}
ORACLE_SQL: dict = {}
D = 64


def _folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; a local one only where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or "file://" + tempfile.mkdtemp(prefix="vqspark-")
    return f"{base.rstrip('/')}/streams/{uuid.uuid4().hex}"


def _source(spark: SparkSession, sf_dir: str, folder: str, positions: range = range(8)) -> DataFrame:
    """Key and value states as a stream of files, one position after the other."""
    rows = X.kv_states(spark, sf_dir)
    for pos in positions:
        rows.filter(F.col("pos") == pos).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def _encode_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    E.encode_stream(_source(spark, sf_dir, folder), "vec", V.codec("mse", D, 2), f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("vec_id", "pos", F.size("codes").alias("n_codes"), F.round("scale", 5).alias("scale"))


def _encode_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    E.encode_segments(_source(spark, sf_dir, folder), 2.5, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("layer", "side").agg(F.round(F.avg(G.squared_error()), 6).alias("mse"), F.count("*").alias("n"))


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes so far, kept in a table by micro-batches, half of them before a restart from the checkpoint."""
    folder, m = _folder(spark), V.codec("mse", D, 2)
    for positions in (range(5), range(5, 8)):
        sizes = E.running_sizes(_source(spark, sf_dir, folder, positions), m)
        E.keep_state(sizes, f"{folder}/sizes", f"{folder}/state").awaitTermination()
    return E.current_state(spark, f"{folder}/sizes", ["seq_id", "layer"])


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, m = _folder(spark), V.codec("mse", D, 3)
    S.write_codes(V.pack(V.encode(X.kv_states(spark, sf_dir), "vec", m), 3).drop("vec"), f"{folder}/codes")
    held = S.read_codes(spark, f"{folder}/codes")
    return V.decode(V.unpack(held.drop("codes"), 3, D).withColumnRenamed("codes_back", "codes"), m).select("vec_id", "layer", "side", F.round(V.l2_norm("vec_hat"), 4).alias("norm"), F.array_join(F.transform("codes", lambda c: c.cast("string")), ",").alias("codes"))


def _fractional_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fractional codes and the metadata of their segments, written as one version, read and joined again."""
    folder, keys, kv = _folder(spark), ["seq_id", "layer", "side"], X.kv_states(spark, sf_dir)
    masks = G.select_channels(G.channel_scores(kv, "dynamic_absmean", 2.5, keys), keys, 32)
    codes, segments = G.split_codes(kv, masks, 2.5, keys)
    S.write_coded(codes, segments, f"{folder}/coded")
    made = G.join_codes(*S.read_coded(spark, f"{folder}/coded"), keys).select("vec_id", "vec_hat")
    return kv.join(made, "vec_id").groupBy("layer", "side").agg(F.round(F.avg(G.squared_error()), 6).alias("mse"), F.count("*").alias("n"))


def _mixed_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation rows of two methods, one shard in Arrow files and one in Parquet, three columns of which are read."""
    folder, rows = _folder(spark), X.results(spark, sf_dir)
    S.write_arrow(rows.filter("method = 'base'").drop("latency"), f"{folder}/base.arrow")
    rows.filter("method <> 'base'").write.parquet(f"{folder}/variant")
    both = S.read_eval_rows(spark, [f"{folder}/base.arrow", f"{folder}/variant"], "dataset string, method string, score double")
    return both.groupBy("dataset", "method").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("score"))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    S.write_results(X.results(spark, sf_dir).select("dataset", "index", "method", "bits", "prompt_tokens", "score"), f"{folder}/results")
    return S.read_results(spark, [f"{folder}/results"]).select("dataset", "index", "method", "bits", "prompt_tokens", F.round("score", 6).alias("score"))


QUERIES |= {"encode_stream": _encode_stream, "encode_segment_stream": _encode_segments, "running_sizes": _sizes, "code_table": _codes, "results_roundtrip": _results, "fractional_codes": _fractional_codes, "mixed_shards": _mixed_shards}
ORACLE_SQL |= {
    "running_sizes": f"WITH {X.KV_CTE} SELECT seq_id, layer, count(*) AS n, count(*) * 18 AS bytes FROM kv GROUP BY 1, 2",
    "mixed_shards": f"WITH {X.RESULTS_CTE} SELECT dataset, method, count(*) AS n, round(avg(score), 6) AS score FROM results GROUP BY 1, 2",
    "encode_stream": f"WITH {X.KV_CTE} SELECT vec_id, pos, CAST(64 AS INT) AS n_codes, round(sqrt(list_sum(list_transform(vec, lambda x: x * x))), 5) AS scale FROM kv",
    "results_roundtrip": f"WITH {X.RESULTS_CTE} SELECT dataset, index, method, bits, prompt_tokens, round(score, 6) AS score FROM results",
}
