"""Importance resampling of documents towards a target corpus, over hashed runs of one and two words.

The hash is CRC-32, worked out for all features of a slice of text at once. CRC is affine over XOR: a byte's contribution
depends on its value and its distance from the end of the span alone, so a table by distance and byte is looked up for
every byte and the contributions of a span are XORed (bitwise_xor.reduceat); a constant for the length completes it. Spans
that are longer than the table fold blockwise: what has been gathered moves on by a block of zero bytes, which is linear.

Counts of buckets are summed in tasks before they are shuffled. A document's score is its mean gain plus Gumbel noise from
its id, so the highest scores are a draw without replacement. Scores are whole numbers in a fixed range (below 140,000
different ones), so ranks come from their histogram and an order within each score, without one task that sorts all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship
from . import textops as T
from .common import durable, table, trim

#: Distances from the end that the table has, and so the bytes of a block.
REACH = 256
BUCKETS, SEED, PERCENT, LEAST_WORDS = 10_000, 7, 25, 20
POLYNOMIAL = 0xEDB88320


@lru_cache(maxsize=1)
def position_table() -> np.ndarray:
    """[distance * 256 + byte]: what the byte contributes to the register at the end of the span."""
    first = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        first = np.where(first & 1, first >> 1 ^ POLYNOMIAL, first >> 1).astype(np.uint32)
    out = np.empty((REACH, 256), dtype=np.uint32)
    out[0] = first
    for distance in range(1, REACH):
        out[distance] = out[distance - 1] >> 8 ^ first[out[distance - 1] & 255]
    return out.reshape(-1)


@lru_cache(maxsize=1)
def block_shift() -> np.ndarray:
    """[byte of the register, its value]: the register after a block of zero bytes."""
    first = position_table()[:256]
    state = np.arange(256, dtype=np.uint32)[None, :] << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    for _ in range(REACH):
        state = state >> 8 ^ first[state & 255]
    return state


@lru_cache(maxsize=1 << 12)
def _constant(length: int) -> int:
    """CRC of so many zero bytes."""
    value, left = 0, length
    while left:
        value, left = zlib.crc32(bytes(min(left, 1 << 20)), value), left - min(left, 1 << 20)
    return value


@lru_cache(maxsize=1)
def _constants() -> np.ndarray:
    return np.array([_constant(n) for n in range(REACH + 1)], dtype=np.uint32)


def _xor(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """XOR of the runs of values that start there; no run is empty."""
    return np.bitwise_xor.reduceat(values, starts) if len(starts) else np.empty(0, dtype=np.uint32)


def _firsts(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def _long_crc(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC of spans of any length, block by block from the front; only a span's first block may be short."""
    length = ends - starts
    blocks = -(-length // REACH)
    span = np.repeat(np.arange(len(starts)), blocks)
    nth = np.arange(len(span)) - np.repeat(_firsts(blocks), blocks)
    stop = ends[span] - (blocks[span] - 1 - nth) * REACH
    begin = np.maximum(stop - REACH, starts[span])
    size = stop - begin
    distance = np.repeat(size, size) - 1 - (np.arange(size.sum()) - np.repeat(_firsts(size), size))
    at = np.repeat(stop, size) - 1 - distance
    part = _xor(position_table()[distance * 256 + data[at]], _firsts(size))
    state, shift = np.zeros(len(starts), dtype=np.uint32), block_shift()
    first = _firsts(blocks)
    live = np.arange(len(starts))
    for k in range(int(blocks.max(initial=0))):
        live = live[blocks[live] > k]
        s = state[live]
        moved = shift[0][s & 255] ^ shift[1][s >> 8 & 255] ^ shift[2][s >> 16 & 255] ^ shift[3][s >> 24]
        state[live] = moved ^ part[first[live] + k]
    return state ^ np.array([_constant(int(n)) for n in length], dtype=np.uint32)


def word_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and CRC-32 of every run of one word, then of two (joined by a space), and the number of words of each row.

    A-Z are lower-cased. Words are runs of digits, letters a to z and bytes over 127.
    """
    n = len(offsets) - 1
    low = T.lower_ascii(data)
    inside = np.zeros(len(low) + 2, dtype=bool)
    inside[1:-1] = (low >= 128) | (low - np.uint8(97) < 26) | (low - np.uint8(48) < 10)
    edge = np.zeros(len(low) + 1, dtype=bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    row = np.searchsorted(offsets, starts, side="right") - 1
    words = np.bincount(row, minlength=n)
    size = (ends - starts).astype(np.int64)
    # All words with one space after each: features are spans of this.
    first = _firsts(size + 1)
    joined = np.full(int((size + 1).sum()), 32, dtype=np.uint8)
    letters = np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)
    joined[letters] = low[inside[1:-1]]
    table_of, constant = position_table(), _constants()

    distance = np.repeat(first + size - 1, size) - letters
    single = np.empty(len(size), dtype=np.uint32)
    own = _xor(table_of[np.minimum(distance, REACH - 1) * 256 + joined[letters]], _firsts(size))
    long = size > REACH
    single[~long] = own[~long] ^ constant[size[~long]]
    single[long] = _long_crc(joined, first[long], first[long] + size[long])

    pair = np.flatnonzero(row[1:] == row[:-1])
    length = size[pair] + 1 + size[pair + 1]
    double = np.empty(len(pair), dtype=np.uint32)
    short = length <= REACH
    a, b = pair[short], pair[short] + 1
    # The second word's contributions are its own; the first word and the space lie further from the end.
    count = size[a] + 1
    back = np.repeat(length[short], count) - 1 - (np.arange(int(count.sum())) - np.repeat(_firsts(count), count))
    at = np.repeat(first[b] + size[b] - 1, count) - back
    double[short] = _xor(table_of[back * 256 + joined[at]], _firsts(count)) ^ own[b] ^ constant[length[short]]
    a, b = pair[~short], pair[~short] + 1
    double[~short] = _long_crc(joined, first[a], first[b] + size[b])
    return np.r_[row, row[pair]], np.r_[single, double], words


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket and n, the features of all texts in it; buckets without features aren't there. Null texts have none."""
    ship(texts.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            data, offsets = T.text_bytes(batch.column("text"))
            for a, b in T.slices(offsets):
                found = word_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])[1]
                total += np.bincount(found % buckets, minlength=buckets)
            trim()
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    return texts.select("text").mapInArrow(work, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket and gain: a thousand times the logarithm of the smoothed shares' ratio, floored; one row for each bucket."""
    spark = docs.sparkSession
    s, t = bucket_counts(docs, buckets).withColumnRenamed("n", "s"), bucket_counts(target, buckets).withColumnRenamed("n", "t")
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = durable(every.join(s, "bucket", "left").join(t, "bucket", "left").fillna(0))
    whole = both.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    d = lambda c: F.col(c).cast("double")
    ratio = (d("t") + 1) * F.lit(float(whole.s + buckets)) / ((d("s") + 1) * F.lit(float(whole.t + buckets)))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def weighed(docs: DataFrame, gains: DataFrame) -> DataFrame:
    """doc_id, n_words, n_features and weight, the floored mean gain of a document's features (0 without any).

    `gains` has one row for each bucket: a fixed number, which the driver gathers and broadcasts.
    """
    ship(docs.sparkSession)
    rows = gains.orderBy("bucket").select("gain").toArrow().column("gain").to_numpy()
    held, buckets = docs.sparkSession.sparkContext.broadcast(rows), len(rows)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = held.value.astype(np.float64)
        for batch in batches:
            data, offsets = T.text_bytes(batch.column("text"))
            for a, b in T.slices(offsets):
                row, crc, words = word_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                n = np.bincount(row, minlength=b - a)
                total = np.bincount(row, gain[crc % buckets], b - a).astype(np.int64)  # whole numbers, exact in doubles
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                yield pa.record_batch([batch.column("doc_id").slice(a, b - a), pa.array(words.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])
            trim()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(work, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def gumbel(doc_id: F.Column, seed: int = SEED) -> F.Column:
    """Whole-number noise from an id (a null one as an empty string): the same in every run."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Every row of docs: doc_id, n_features, weight, score, rank (null if it isn't drawn) and n_words.

    Of the rows with at least `least_words` words, `percent` in a hundred (rounded down) are drawn: those of the highest
    scores, ties to the smaller doc_id, null ids last. Null and empty texts have no features and weight 0. Rows that repeat
    an id share its noise and are drawn each for itself. Without target texts the gains still are defined, by smoothing.
    An empty table gives an empty one. Both tables need text, docs also doc_id; other columns are not looked at.
    """
    scored = weighed(docs, bucket_gains(docs, target, buckets)).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = durable(scored.withColumn("able", F.col("n_words") >= least_words))
    # The histogram has at most some 140,000 rows: a weight's size is below 45,000, noise lies between -3,200 and 22,900.
    counts = scored.filter("able").groupBy("score").agg(F.count("*").alias("n"))
    before = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("score", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    quota = percent * scored.filter("able").count() // 100
    drawn = scored.join(F.broadcast(counts.filter(F.col("base") < quota)), "score", "left").withColumn("base", F.when(F.col("able"), F.col("base")))
    within = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "n_features", "weight", "n_words")
    ranked = drawn.filter("base is not null").withColumn("rank", F.col("base") + F.row_number().over(within))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= quota, F.col("rank")))
    rest = drawn.filter("base is null").withColumn("rank", F.lit(None).cast("bigint"))
    columns = ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    return ranked.select(*columns).unionByName(rest.select(*columns))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents drawn towards `benchmark`: doc_id, n_features, weight, score, rank."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


OP12_SQL = r"""
with crc as (
  select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t
), words as (
  select src, id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from (select 'd' as src, row_number() over () as id, doc_id, text from documents union all select 'b', row_number() over (), null, text from benchmark)
), lists as (
  select src, id, doc_id, len(w) as n_words, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as f from words
), each as (
  select src, id, unnest(f) as f from lists
), hashed as (
  select f, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda h: ('0x' || h)::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 as bucket
  from (select distinct f from each), crc
), placed as (
  select src, id, bucket from each join hashed using (f)
), buckets as (
  select bucket, count(*) filter (src = 'd') as s, count(*) filter (src = 'b') as t from placed group by bucket
), gains as (
  select bucket, floor(1000 * ln((t::double + 1) * (s_all + 10000) / ((s::double + 1) * (t_all + 10000))))::bigint as gain
  from buckets, (select sum(s)::double as s_all, sum(t)::double as t_all from buckets)
), weights as (
  select id, count(*) as n_features, floor(sum(gain) / count(*))::bigint as weight from placed join gains using (bucket) where src = 'd' group by id
), scored as (
  select id, doc_id, n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::bigint + 0.5) / 4294967296)))::bigint as score
  from lists left join weights using (id) where src = 'd'
), ranked as (
  select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id) as r, count(*) filter (n_words >= 20) over () as n from scored
)
select doc_id, n_features::bigint as n_features, weight, score, case when n_words >= 20 and r <= 25 * n // 100 then r end as rank from ranked
"""
