"""Nearest neighbours: exact and over codes, by partial top-k in each task and a merge; recall.

A bounded number of queries is broadcast. More are dealt to blocks, rows to chunks, and every block meets every chunk in a
group of its own; a score matrix over all rows never exists, and queries don't pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .codec import Codec, matrix

#: The most query values (rows times dimensions) that are broadcast, and that a block has beyond that.
BLOCK_VALUES = 8_000_000
#: Rows of a chunk, and its values (rows times dimensions), at most; queries that are scored at once.
CHUNK_ROWS, CHUNK_VALUES, STEP = 200_000, 12_800_000, 512


def _merge(score: np.ndarray, vec: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((vec, -score), axis=1)[:, :k]
    return np.take_along_axis(score, order, 1), np.take_along_axis(vec, order, 1)


def _best(ids: np.ndarray, q: np.ndarray, x: np.ndarray, vec_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and rows of the k best of x for each query, the lower row on ties; a row isn't its own neighbour."""
    turn = np.argsort(vec_id, kind="stable")
    x, vec_id = x[turn] / np.maximum(np.linalg.norm(x[turn], axis=1, keepdims=True), 1e-12), vec_id[turn]
    scores, vecs = [], []
    for a in range(0, len(q), STEP):
        s = q[a : a + STEP] @ x.T
        s[ids[a : a + STEP, None] == vec_id] = -np.inf
        order = np.argsort(-s, axis=1, kind="stable")[:, :k]
        scores.append(np.take_along_axis(s, order, 1))
        vecs.append(vec_id[order])
    return np.concatenate(scores), np.concatenate(vecs)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def topk(database: DataFrame, queries: DataFrame, k: int, made: Codec | None = None) -> DataFrame:
    """query_id, rank, vec_id, score by cosine; ties go to the lower id. With a codec, rows have codes instead of vec.

    `queries` has query_id and vec; a row with a query's own id isn't among its neighbours. Up to BLOCK_VALUES values of
    queries (counted) are broadcast, so that every task keeps k candidates a query; more go by blocks and chunks.
    """
    ship(database.sparkSession)
    column = "vec" if made is None else "codes"
    rows = database.select("vec_id", column).filter(F.col(column).isNotNull() & F.col("vec_id").isNotNull())
    queries = queries.select("query_id", "vec").filter("query_id is not null and vec is not null")
    found = queries.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d")).first()
    if found.n * (found.d or 0) <= BLOCK_VALUES:
        part = _broadcast_topk(rows, queries, k, made, column)
    else:
        part = _blocked_topk(rows, queries, k, made, column, -(-found.n * found.d // BLOCK_VALUES), found.d)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return part.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _broadcast_topk(rows: DataFrame, queries: DataFrame, k: int, made: Codec | None, column: str) -> DataFrame:
    table = queries.toArrow()
    ids = table.column("query_id").to_numpy()
    q = _unit(matrix(table.column("vec").combine_chunks())) if len(ids) else np.zeros((0, 1))
    held = rows.sparkSession.sparkContext.broadcast((ids, q))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = held.value
        top = np.full((len(ids), 0), 0.0), np.full((len(ids), 0), 0)
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            x = matrix(batch.column(column))
            score, vec = _best(ids, q, x if made is None else made.unit(x.astype(np.int64)), batch.column("vec_id").to_numpy(), k)
            top = _merge(np.hstack([top[0], score]), np.hstack([top[1], vec]), k)
        yield _candidates(ids, *top)

    return rows.mapInArrow(best, "query_id bigint, vec_id bigint, score double")


def _candidates(ids: np.ndarray, score: np.ndarray, vec: np.ndarray) -> pa.RecordBatch:
    good = np.isfinite(score)
    return pa.record_batch([pa.array(np.repeat(ids, score.shape[1]).reshape(score.shape)[good].astype(np.int64)), pa.array(vec[good].astype(np.int64)), pa.array(score[good])], names=["query_id", "vec_id", "score"])


def _blocked_topk(rows: DataFrame, queries: DataFrame, k: int, made: Codec | None, column: str, blocks: int, d: int) -> DataFrame:
    chunks = max(1, -(-rows.count() // max(1, min(CHUNK_ROWS, CHUNK_VALUES // d))))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("chunk", every(chunks))
    x = rows.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int")).withColumn("block", every(blocks))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        ids, y = left["query_id"].to_numpy(), np.stack(right[column].to_numpy())
        y = y.astype(np.float64) if made is None else made.unit(y.astype(np.int64))
        score, vec = _best(ids, _unit(np.stack(left["vec"].to_numpy()).astype(np.float64)), y, right["vec_id"].to_numpy(), k)
        return _candidates(ids, score, vec).to_pandas()

    return q.groupBy("block", "chunk").cogroup(x.groupBy("block", "chunk")).applyInPandas(best, "query_id long, vec_id long, score double")


def recall(exact: DataFrame, approx: DataFrame, ks: list[int]) -> DataFrame:
    """k and the share of queries whose exact nearest row is among the first k approximate ones."""
    first = exact.filter("rank = 1").select("query_id", "vec_id").join(approx.select("query_id", "vec_id", F.col("rank").alias("at")), ["query_id", "vec_id"], "left")
    return first.select("at", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")).groupBy("k").agg(F.avg(F.coalesce((F.col("at") <= F.col("k")).cast("double"), F.lit(0.0))).alias("recall"))


def recall_by_group(exact: DataFrame, approx: DataFrame, groups: DataFrame, ks: list[int]) -> DataFrame:
    """group, k and recall; `groups` has query_id and group."""
    first = exact.filter("rank = 1").select("query_id", "vec_id").join(approx.select("query_id", "vec_id", F.col("rank").alias("at")), ["query_id", "vec_id"], "left").join(groups, "query_id")
    hit = F.coalesce((F.col("at") <= F.col("k")).cast("double"), F.lit(0.0))
    return first.select("group", "at", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")).groupBy("group", "k").agg(F.avg(hit).alias("recall"), F.count("*").alias("n"))
