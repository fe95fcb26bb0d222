"""Online encoding: what arrives is coded once; codes of old positions never change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.codec import Codec, encode, pack
from ..operators.segments import encode_fractional


def encode_stream(stream: DataFrame, column: str, made: Codec, path: str, checkpoint: str) -> StreamingQuery:
    """Data-oblivious kinds are a stateless map from source to append sink."""
    return encode(stream, column, made).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def encode_segments(stream: DataFrame, bits: float, path: str, checkpoint: str) -> StreamingQuery:
    """Segment-dependent kinds: a micro-batch is one segment of every (seq, layer, side); rewriting a batch replaces it."""

    def write(batch: DataFrame, number: int) -> None:
        made = encode_fractional(batch.withColumn("segment_id", F.lit(number).cast("long")), bits)
        made.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_sizes(stream: DataFrame, made: Codec) -> DataFrame:
    """Positions and bytes so far, by sequence and layer: a streaming aggregate over the packed codes and two-byte scales."""
    coded = pack(encode(stream, "vec", made), made.bits)
    return coded.groupBy("seq_id", "layer").agg(F.count("packed").alias("n"), F.sum(F.octet_length("packed") + 2).alias("bytes"))


def keep_state(aggregate: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """A streaming aggregate in update mode into a table: each micro-batch writes what has changed as its own partition.

    A micro-batch that is run again after a failure replaces its partition, so restarts from the checkpoint leave the same
    rows. No row passes through the driver. See `current_state`.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return aggregate.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current_state(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last row of every key that `keep_state` has written."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("last")).select(*keys, "last.*")


def phase_kind(df: DataFrame, keys: list[str], prefill: str, step: str) -> DataFrame:
    """Segments with several positions take one kind, single ones another."""
    n = df.groupBy(*keys).agg(F.count_distinct("pos").alias("n_pos"))
    return df.join(n, keys).withColumn("kind", F.when(F.col("n_pos") > 1, prefill).otherwise(step))


def crop(df: DataFrame, length: int, most: int) -> DataFrame:
    """Positions below `most`; a negative one drops so many from the end of `length`."""
    return df.filter(F.col("pos") < (most if most >= 0 else length + most))


def reorder(df: DataFrame, beams: DataFrame) -> DataFrame:
    """Sequences by (new_seq, old_seq); an old one may come several times."""
    return df.join(beams, df.seq_id == beams.old_seq).drop("seq_id", "old_seq").withColumnRenamed("new_seq", "seq_id")


def materialize(decoded: DataFrame, keys: list[str]) -> DataFrame:
    """All decoded segments of a layer in the order of their arrival: rows sorted within `keys`, with their place from 1."""
    order = [c for c in ("segment_id", "pos", "vec_id") if c in decoded.columns]
    return decoded.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def to_dense(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and `cache`: positions and vectors of a sequence, layer, side and head in order, as dense caches are handed on."""
    cells = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "vec"))).alias("cache"))
    return cells.select(*keys, "cache")


def from_dense(dense: DataFrame) -> DataFrame:
    """Rows of dense caches, one for each position, as one segment that can be coded."""
    cells = dense.select(*[c for c in dense.columns if c != "cache"], F.explode("cache").alias("c"))
    return cells.select("*", "c.pos", "c.vec").drop("c").withColumn("segment_id", F.lit(0).cast("long"))
