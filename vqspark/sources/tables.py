"""Reading and writing vectors, evaluation rows and results; keyed set maintenance (merge, slices, reports)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import ship
from . import arrow_files

RESULT_SCHEMA = "dataset string, index bigint, method string, bits double, prompt_tokens bigint, prediction string, answers array<string>, score double"


def read_vectors(spark: SparkSession, path: str, column: str, key: str = "vec_id") -> DataFrame:
    """Key and one list column of all shards under a path; Parquet reads nothing else."""
    return spark.read.parquet(path).select(key, F.col(column).alias("vec"))


def kth_smallest(df: DataFrame, key: str, k: int, bins: int = 4096) -> int:
    """The k-th smallest (from 1) of a whole-number key, by histograms that narrow: `bins` counts reach the driver a pass."""
    low, high, n = df.agg(F.min(key), F.max(key), F.count(key)).first()
    if n < k:
        raise ValueError(f"need {k} rows, found {n}")
    while low < high:
        width = -(-(high - low + 1) // bins)
        slot = F.expr(f"({key} - ({low})) div {width}")
        for r in df.filter(F.col(key).between(low, high)).groupBy(slot.alias("slot")).count().orderBy("slot").collect():
            if r["count"] >= k:
                low, high = low + r.slot * width, min(high, low + (r.slot + 1) * width - 1)
                break
            k -= r["count"]
    return low


def split_database_queries(df: DataFrame, key: str, n_database: int, n_queries: int) -> tuple[DataFrame, DataFrame]:
    """The first rows by key as database, the next ones as queries (range filters); an error if there are too few."""
    a, b = kth_smallest(df, key, n_database), kth_smallest(df, key, n_database + n_queries)
    return df.filter(F.col(key) <= a), df.filter((F.col(key) > a) & (F.col(key) <= b))


def read_shard(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One shard by its suffix: Arrow files, JSON lines, or Parquet where there is none. A schema prunes Arrow's columns."""
    suffix = path.rstrip("/").rpartition(".")[2]
    if suffix in ("arrow", "feather", "ipc", "arrows"):
        ship(spark)
        arrow_files.register(spark)
        reader = spark.read.format(arrow_files.NAME)
        return (reader.schema(schema) if schema else reader).load(path)
    if suffix in ("json", "jsonl"):
        return (spark.read.schema(schema) if schema else spark.read).json(path)
    found = spark.read.parquet(path)
    return found if schema is None else found.select(*[c for c in StructType.fromDDL(schema).names if c in found.columns])


def read_eval_rows(spark: SparkSession, paths: list[str], schema: str | None = None) -> DataFrame:
    """All shards, of any of these forms, as one table; columns are matched by name and may be missing."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [read_shard(spark, p, schema) for p in paths])


def write_arrow(df: DataFrame, path: str) -> None:
    """One Arrow file for each task's rows in a folder; files of a task that is run again replace those it has left."""
    ship(df.sparkSession)
    schema, arrow = df.schema, to_arrow_schema(df.schema)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(path.replace("file:///", "/"))
        fs.create_dir(root)
        name, n = f"{root}/part-{TaskContext.get().partitionId():05d}.arrow", 0
        with fs.open_output_stream(f"{name}.{TaskContext.get().taskAttemptId()}") as out, pa.ipc.new_file(out, arrow) as file:
            for batch in batches:
                file.write_batch(pa.record_batch(batch.columns, schema=arrow))
                n += batch.num_rows
        fs.move(f"{name}.{TaskContext.get().taskAttemptId()}", name)
        yield pa.record_batch([pa.array([n])], names=["n"])

    df.select(*schema.names).mapInArrow(write, "n bigint").collect()  # one number for each task


def read_results(spark: SparkSession, paths: list[str], schema: str = RESULT_SCHEMA) -> DataFrame:
    """JSON lines with an explicit schema; blank lines are skipped by the reader."""
    return spark.read.schema(schema).json(paths)


def write_results(df: DataFrame, path: str, form: str = "json") -> None:
    """Replaces the target; the task committer publishes whole outputs only."""
    df.write.mode("overwrite").format(form).save(path)


def slice_by_index(df: DataFrame, start: int = 0, end: int | None = None, most: int | None = None) -> DataFrame:
    """Half-open range of `index`; `most` shortens it. Filters reach the scan."""
    stop = end if most is None else min(end if end is not None else start + most, start + most)
    df = df.filter(F.col("index") >= max(0, start))
    return df if stop is None else df.filter(F.col("index") < stop)


def merge_shards(shards: list[DataFrame], line: str = "line") -> DataFrame:
    """One row per index of all shards: that of the last shard, and within a shard of the last line."""
    tagged = reduce(DataFrame.unionByName, [s.withColumn("_shard", F.lit(k)) for k, s in enumerate(shards)])
    columns = [c for c in tagged.columns if c not in ("index", line, "_shard")]
    best = tagged.groupBy("index").agg(F.max_by(F.struct(*columns), F.struct("_shard", line)).alias("row"))
    return best.select("index", "row.*")


def duplicate_report(df: DataFrame) -> DataFrame:
    return df.groupBy("index").agg(F.count("*").alias("n")).filter("n > 1")


def missing_report(df: DataFrame, start: int, end: int) -> DataFrame:
    """Indexes of the range that df lacks."""
    return df.sparkSession.range(start, end).withColumnRenamed("id", "index").join(df.select("index"), "index", "left_anti")


def pending(df: DataFrame, done: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return df.join(done, keys or ["index"], "left_anti")


def stratified_head(df: DataFrame, keys: list[str], n: int, allowed: dict[str, list] | None = None) -> DataFrame:
    """First n rows by index of each cell, after filters on allowed values."""
    for column, values in (allowed or {}).items():
        df = df.filter(F.col(column).isin(values))
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("index"))).filter(F.col("_n") <= n).drop("_n")


def cell_coverage(df: DataFrame, key_values: dict[str, list], n: int) -> DataFrame:
    """For every cell of the grid: rows available, selected (at most n) and short of n."""
    spark = df.sparkSession
    grid = spark.range(1).select()
    grid = reduce(lambda g, kv: g.select("*", F.explode(F.array(*[F.lit(v) for v in kv[1]])).alias(kv[0])), key_values.items(), grid)
    counts = df.groupBy(*key_values).agg(F.count("*").alias("available"))
    cells = grid.join(counts, list(key_values), "left").fillna(0, ["available"])
    return cells.withColumn("selected", F.least("available", F.lit(n))).withColumn("short", F.lit(n) - F.col("selected"))


def write_codes(codes: DataFrame, path: str) -> None:
    """Code table by layer and side; decoding reads the partitions it needs."""
    codes.write.mode("overwrite").partitionBy("layer", "side").parquet(path)


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_coded(codes: DataFrame, segments: DataFrame, path: str) -> str:
    """Codes and the metadata of their segments as two tables of one version, which is published by a last small write.

    `codes` has layer and side, by which it is partitioned. A reader sees the version that was published last, whole; what a
    write that failed has left is never read.
    """
    version = uuid.uuid4().hex
    codes.write.partitionBy("layer", "side").parquet(f"{path}/{version}/codes")
    segments.write.parquet(f"{path}/{version}/segments")
    codes.sparkSession.createDataFrame([(version,)], "version string").coalesce(1).write.mode("append").json(f"{path}/published")
    return version


def read_coded(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Codes and segments of the version that was published last."""
    published = spark.read.schema("version string").json(f"{path}/published").select("version", "_metadata.file_modification_time", "_metadata.file_name")
    version = published.orderBy(F.desc("file_modification_time"), F.desc("file_name")).first().version
    return spark.read.parquet(f"{path}/{version}/codes"), spark.read.parquet(f"{path}/{version}/segments")
