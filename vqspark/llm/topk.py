"""Exact top-k by integer inner product, with block-at-a-time pruning.

Rows are sorted by the nearest of a few pivots and by id, and cut into blocks of consecutive rows. A block has a forward
index (its vectors, packed) and, for every term (dimension), the greatest and least value in it; summed over the terms of a
query these bound any score in the block from above. Queries are packed into groups by the same sort, so each starts with
the k-th best score of the block that it falls into.

Pairs of group and block in which no query's bound reaches its k-th score are dropped before any forward index moves. The
rest meet in groups of bounded size; there each query takes blocks in the order of its bounds until they fall below its
k-th score so far. What is left, at most k rows for each query and group, is ranked by a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, partitions, table, trim

#: Bytes of a block's forward index and most rows of a block; queries of a group, at most (fewer for many dimensions).
BLOCK_BYTES, BLOCK_ROWS, GROUP_BYTES = 1 << 16, 512, 1 << 18
#: Blocks that meet a group in one task's call; blocks and groups that meet by bounds.
PART, PARCEL, CROWD = 256, 1 << 14, 64
#: Rows that pivots are fitted on (they decide the order of rows, never a result), pivots, and rounds of the fit.
SAMPLE, PIVOTS, ROUNDS = 4096, 64, 8
LEAST = np.iinfo(np.int64).min

PACKED = "kind string, id bigint, n int, ids binary, code string, data binary, high binary, low binary, floor binary"


def quantised(vector: Column, factor: int = 64) -> Column:
    """floor(factor * x) of every component, worked out in doubles."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(factor))))


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return F.coalesce(F.forall(vector, finite), F.lit(False))


def integers(column: pa.Array, d: int) -> np.ndarray:
    """Lists of whole numbers as rows of d; components that a shorter list lacks are 0."""
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (size == d).all():
        return flat.reshape(len(column), d)
    out = np.zeros((len(column), d), dtype=np.int64)
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def exact_type(q: np.ndarray, x: np.ndarray) -> type:
    """The fastest type in which all inner products of rows of q and x are exact; an error if a long can't hold them."""
    most = lambda a: max(abs(int(a.max(initial=0))), abs(int(a.min(initial=0))))
    size = most(q) * most(x) * max(1, x.shape[1])
    if size >= 1 << 63:
        raise OverflowError("scores don't fit a long")
    return np.float32 if size < 1 << 24 else np.float64 if size < 1 << 53 else np.int64


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    kind = exact_type(q, x)
    return (q.astype(kind) @ x.T.astype(kind)).astype(np.int64)


def bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Upper bounds of the scores of queries in blocks: every term's better extreme, summed."""
    return scores(np.hstack([np.maximum(q, 0), np.minimum(q, 0)]), np.hstack([high, low]))


class Best:
    """The k best rows of each query so far: by score, ties to the smaller id. `floor` is what a row must reach."""

    def __init__(self, ids: np.ndarray, floor: np.ndarray, k: int) -> None:
        self.ids, self.floor, self.k = ids, floor.copy(), k
        self.query, self.row, self.score = (np.empty(0, dtype=np.int64) for _ in range(3))

    def add(self, query: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        query, row, score = np.r_[self.query, query], np.r_[self.row, row], np.r_[self.score, score]
        order = np.lexsort((row, -score, query))
        query, row, score = query[order], row[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        last = query[place == self.k - 1]
        self.floor[last] = np.maximum(self.floor[last], score[place == self.k - 1])
        keep = place < self.k
        self.query, self.row, self.score = query[keep], row[keep], score[keep]

    def meet(self, q: np.ndarray, which: np.ndarray, x: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        """(query, row, score) of what reaches the floors among rows x, for the queries at `which`; own rows don't count."""
        s = scores(q[which], x)
        good = (s >= self.floor[which, None]) & (self.ids[which, None] != ids)
        at, to = np.nonzero(good)
        return which[at], ids[to], s[at, to]


def search_blocks(q: np.ndarray, ids: np.ndarray, floor: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], high: np.ndarray, low: np.ndarray, k: int) -> tuple[Best, int]:
    """The best rows among blocks (ids, vectors), and how many (query, block) pairs were scored.

    Each query's blocks are taken in the order of falling bounds: the first, then so many more as have been taken, until
    the next bound is below the k-th score.
    """
    best, reach = Best(ids, floor, k), bounds(q, high, low)
    order = np.argsort(-reach, axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(blocks))[None, :], axis=1)
    done, step, scored = 0, 1, 0
    while done < len(blocks):
        due = (place >= done) & (place < done + step) & (reach >= best.floor[:, None])
        found = [best.meet(q, np.flatnonzero(due[:, b]), blocks[b][1], blocks[b][0]) for b in np.flatnonzero(due.any(axis=0))]
        if not found:
            break  # later bounds are no higher
        scored += int(due.sum())
        best.add(*(np.concatenate(x) for x in zip(*found, strict=True)))
        done, step = done + step, done + step
    return best, scored


def _pivots(rows: DataFrame, d: int) -> np.ndarray:
    """Directions that rows are dealt to: Lloyd's rounds over a bounded sample, chosen by a hash of ids."""
    held = rows.select("id", "vec").orderBy(F.xxhash64("id"), "id", "vec").limit(SAMPLE).select("vec").toArrow()
    x = integers(held.column("vec").combine_chunks(), d).astype(np.float64) if held.num_rows else np.zeros((0, d))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    centers = x[:PIVOTS].copy() if len(x) else np.zeros((1, d))
    for _ in range(ROUNDS if len(x) else 0):
        at = (x @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, at, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(size > 0, sums / np.maximum(size, 1e-12), centers)
    return centers


def _with_cells(df: DataFrame, pivots: np.ndarray, d: int) -> DataFrame:
    held = df.sparkSession.sparkContext.broadcast(pivots)
    schema = "id bigint, vec array<bigint>, query boolean, cell int"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = integers(batch.column("vec"), d).astype(np.float32)
            yield pa.record_batch([*batch.columns, pa.array((x @ held.value.T.astype(np.float32)).argmax(axis=1).astype(np.int32))], names=["id", "vec", "query", "cell"])

    return df.mapInArrow(work, schema)


def _least_type(x: np.ndarray) -> np.ndarray:
    for kind in (np.int8, np.int16, np.int32):
        if not x.size or np.iinfo(kind).min <= x.min() and x.max() <= np.iinfo(kind).max:
            return x.astype(kind)
    return x.astype(np.int64)


def _packed(rows: list[dict]) -> pa.RecordBatch:
    types = {"kind": pa.string(), "id": pa.int64(), "n": pa.int32(), "code": pa.string()}
    names = [c.split()[0] for c in PACKED.split(", ")]
    return pa.record_batch([pa.array([r.get(c) for r in rows], types.get(c, pa.binary())) for c in names], names=names)


def pack(rows: DataFrame, queries: DataFrame, k: int, d: int) -> DataFrame:
    """Blocks of rows and groups of queries, written: see PACKED. Ids of blocks and groups tell task and place."""
    both = rows.withColumn("query", F.lit(False)).unionByName(queries.withColumn("query", F.lit(True)))
    laid = _with_cells(both, _pivots(rows, d), d).repartitionByRange("cell", "id").sortWithinPartitions("cell", "id", "query")
    most_rows, most_queries = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (2 * d))), max(1, GROUP_BYTES // (2 * d))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId() << 32, 0
        held: dict[bool, list] = {False: [], True: []}  # (ids, vectors) of rows and queries since the last block
        group: list[tuple] = []  # (ids, vectors, floors) of queries since the last group

        def count(parts: list) -> int:
            return sum(len(p[0]) for p in parts)

        def block() -> list[dict]:
            nonlocal made
            out = []
            ids, x = (np.concatenate(z) for z in zip(*held[False], strict=True)) if held[False] else (np.empty(0, np.int64), np.zeros((0, d), np.int64))
            if len(ids):
                small = _least_type(x)
                out.append({"kind": "block", "id": task + made, "n": len(ids), "ids": ids.tobytes(), "code": small.dtype.str, "data": small.tobytes(), "high": x.max(axis=0).astype(np.int64).tobytes(), "low": x.min(axis=0).astype(np.int64).tobytes()})
                made += 1
            if held[True]:
                own, q = (np.concatenate(z) for z in zip(*held[True], strict=True))
                floor = np.full(len(own), LEAST)
                for a in range(0, len(own), 1024):  # queries may be many where rows are few
                    best = Best(own[a : a + 1024], floor[a : a + 1024], k)
                    best.add(*best.meet(q[a : a + 1024], np.arange(len(own[a : a + 1024])), x, ids))
                    floor[a : a + 1024] = best.floor
                group.append((own, q, floor))
            held[False], held[True] = [], []
            return out

        def flush() -> list[dict]:
            nonlocal made, group
            own, q, floor = (np.concatenate(z) for z in zip(*group, strict=True))
            group, out = [], []
            for a in range(0, len(own), most_queries):
                small = _least_type(q[a : a + most_queries])
                out.append({"kind": "group", "id": task + made, "n": len(small), "ids": own[a : a + most_queries].tobytes(), "code": small.dtype.str, "data": small.tobytes(), "floor": floor[a : a + most_queries].tobytes()})
                made += 1
            return out

        for batch in batches:
            ids, x, query = batch.column("id").to_numpy(), integers(batch.column("vec"), d), batch.column("query").to_numpy(zero_copy_only=False)
            first = 0
            while first < len(ids):
                # up to the row that fills the block
                room = most_rows - count(held[False])
                filled = np.flatnonzero(np.cumsum(~query[first:]) >= room)
                end = first + int(filled[0]) + 1 if len(filled) else len(ids)
                for kind in (False, True):
                    at = first + np.flatnonzero(query[first:end] == kind)
                    if len(at):
                        held[kind].append((ids[at], x[at]))
                first = end
                out = block() if len(filled) or count(held[True]) >= most_queries else []
                out += flush() if count(group) >= most_queries else []
                if out:
                    yield _packed(out)
        out = block()
        out += flush() if group else []
        if out:
            yield _packed(out)
        trim()

    return durable(laid.select("id", "vec", "query").mapInArrow(work, PACKED))


def _vectors(row: dict, d: int) -> np.ndarray:
    return np.frombuffer(row["data"], dtype=row["code"]).reshape(-1, d).astype(np.int64)


def _longs(values: list[bytes], d: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype=np.int64).reshape(len(values), d)


def top_k(rows: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k rows of the highest integer inner product, ties to smaller vec_id.

    `rows` has vec_id and vec, `queries` query_id and vec: whole numbers (see `quantised`); components that a shorter
    vector lacks count as 0. A row whose id is the query's own is no candidate of it. Rows of a null id or vector take no
    part. A repeated row counts as often as it stands; a query that stands several times gets its list as often. Scores
    beyond a long are an error. Without rows or queries the result is empty.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col("vec_id").cast("bigint").alias("id"), "vec").filter("id is not null and vec is not null")
    queries = queries.select(F.col("query_id").cast("bigint").alias("id"), "vec").filter("id is not null and vec is not null")
    d = max(1, rows.select(F.size("vec").alias("n")).unionByName(queries.select(F.size("vec").alias("n"))).agg(F.max("n")).first()[0] or 0)
    packed = pack(rows, queries, k, d)
    blocks, groups = packed.filter("kind = 'block'"), packed.filter("kind = 'group'")
    n_blocks, n_groups = blocks.count(), groups.count()
    parcels, crowds = max(1, -(-n_blocks // PARCEL)), max(1, -(-n_groups // CROWD))
    # A part is small enough for memory, and there are as many as keep all cores at work.
    parts = max(1, -(-n_blocks // PART), min(-(-n_blocks // 8), -(-partitions(spark) // max(1, n_groups))))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def reachable(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        if left.num_rows and right.num_rows:
            high, low = (_longs(right.column(c).to_pylist(), d) for c in ("high", "low"))
            ids = right.column("block").to_numpy()
            for row in left.to_pylist():
                floor = np.frombuffer(row["floor"], dtype=np.int64)
                hit = ids[(bounds(_vectors(row, d), high, low) >= floor[:, None]).any(axis=0)]
                found.append((np.full(len(hit), row["grp"]), hit))
        grp, block = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"grp": grp, "block": block})

    # Every group sees the bounds of every block, a crowd and a parcel at a time; forward indexes stay where they are.
    dealt_to = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    crowd = groups.select(F.col("id").alias("grp"), "code", "data", "floor", dealt_to(crowds).alias("crowd"), every(parcels).alias("parcel"))
    parcel = blocks.select(F.col("id").alias("block"), "high", "low", dealt_to(parcels).alias("parcel"), every(crowds).alias("crowd"))
    pairs = crowd.groupBy("crowd", "parcel").cogroup(parcel.groupBy("crowd", "parcel")).applyInArrow(reachable, "grp bigint, block bigint")
    met = pairs.join(blocks.select(F.col("id").alias("block"), "ids", "code", "data", "high", "low"), "block")
    met = met.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"grp": pa.int64(), "at": pa.int32(), "query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.int64()}
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], t) for c, t in out.items()})
        row = left.to_pylist()[0]
        ids, floor = (np.frombuffer(row[c], dtype=np.int64) for c in ("ids", "floor"))
        taken = [(np.frombuffer(r["ids"], dtype=np.int64), _vectors(r, d)) for r in right.select(["ids", "code", "data"]).to_pylist()]
        high, low = (_longs(right.column(c).to_pylist(), d) for c in ("high", "low"))
        best, _ = search_blocks(_vectors(row, d), ids, floor, taken, high, low, k)
        trim()
        return pa.table([pa.array(np.full(len(best.query), row["grp"])), pa.array(best.query.astype(np.int32)), pa.array(ids[best.query]), pa.array(best.row), pa.array(best.score)], names=list(out))

    dealt = groups.select(F.col("id").alias("grp"), "ids", "code", "data", "floor", every(parts).alias("part"))
    near = dealt.groupBy("grp", "part").cogroup(met.groupBy("grp", "part")).applyInArrow(search, "grp bigint, at int, query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("grp", "at").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows of `embeddings` for each row whose vec_id is divisible by 20: query_id, rank, vec_id, score."""
    found = table(spark, sf_dir, "embeddings").filter(usable(F.col("embedding"))).select("vec_id", quantised(F.col("embedding")).alias("vec"))
    return top_k(found, found.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), 20)


OP13_SQL = """
with x as (
  select vec_id, list_transform(embedding, lambda c: floor(64 * c::double)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0
), pairs as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score from x q, x c where q.vec_id % 20 = 0 and c.vec_id <> q.vec_id
), ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pairs
)
select query_id, rank::integer as rank, vec_id, score from ranked where rank <= 20
"""
