"""Positions that stay raw, routing by schedule, and bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def raw_by_ratio(length: Column, quant_bits: float, ratio: float) -> Column:
    """Raw positions so that 16-bit and coded ones together take `ratio` of the dense size; one at least."""
    return F.greatest(F.floor(length * (16 * ratio - quant_bits) / (16 - quant_bits)), F.lit(1)).cast("long")


def raw_by_bytes(length: Column, bits: float, quant_bits: float) -> Column:
    """The most raw positions for which the mix takes no more bits than all positions at `bits`."""
    return F.greatest(F.floor(length * (bits - quant_bits) / (16 - quant_bits)), F.lit(0)).cast("long")


def protect(df: DataFrame, raw: Column, policy: str = "sink_recent", start: int = 4, keys: list[str] | None = None, importance: DataFrame | None = None) -> DataFrame:
    """df with is_raw: the first `start` positions and, of the rest, the last ones or those of the most importance.

    `importance` has keys, pos and weight (mean norm over heads, or attention errors). Without it: the most recent.
    """
    keys = keys or ["seq_id", "layer", "side"]
    spots = df.select(*keys, "pos").distinct().withColumn("length", F.count("*").over(Window.partitionBy(*keys))).withColumn("budget", raw)
    if importance is not None and policy != "sink_recent":
        spots = spots.join(importance.select(*keys, "pos", "weight"), [*keys, "pos"], "left")
    else:
        spots = spots.withColumn("weight", F.col("pos").cast("double"))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("pos"))
    spots = spots.withColumn("sink", first <= F.least(F.lit(start), F.col("budget")))
    order = Window.partitionBy(*keys).orderBy(F.col("sink").desc(), F.col("weight").desc_nulls_last(), F.col("pos").desc())
    spots = spots.withColumn("is_raw", F.row_number().over(order) <= F.col("budget"))
    return df.join(spots.select(*keys, "pos", "is_raw"), [*keys, "pos"])


def mixed_bits(df: DataFrame, quant_bits: float, keys: list[str]) -> DataFrame:
    """Effective bits of protected segments."""
    return df.groupBy(*keys).agg(F.avg(F.when(F.col("is_raw"), 16.0).otherwise(quant_bits)).alias("effective_bits"), F.sum(F.col("is_raw").cast("long")).alias("n_raw"))


def with_schedule(df: DataFrame, schedule: DataFrame) -> DataFrame:
    """df with bits and kind of its layer and side; layers without an entry keep nulls (see `unscheduled`)."""
    return df.join(F.broadcast(schedule), ["layer", "side"], "left")


def unscheduled(df: DataFrame, schedule: DataFrame) -> DataFrame:
    return df.select("layer", "side").distinct().join(schedule, ["layer", "side"], "left_anti")


def storage(df: DataFrame, keys: list[str], d: int, bits: Column, side_bytes: Column, scale_bytes: int = 2) -> DataFrame:
    """Bytes by segment as one bit string (codes), scales and side information, against 16-bit dense ones."""
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.first(bits).alias("bits"), F.first(side_bytes).alias("extra"))
    size = F.ceil(F.col("n") * d * F.col("bits") / 8) + F.col("n") * scale_bytes + F.col("extra")
    return out.select(*keys, "n", size.cast("long").alias("bytes"), (F.col("n") * d * 2).alias("dense_bytes"), (size / (F.col("n") * d * 2)).alias("ratio"), (F.col("bits").cast("double")).alias("effective_bits"))


def compression_summary(segments: DataFrame, keys: list[str]) -> DataFrame:
    """How many segments of each kind, average effective bits and the distinct widths."""
    return segments.groupBy(*keys).agg(F.count("*").alias("n_segments"), F.avg("effective_bits").alias("avg_bits"), F.array_sort(F.collect_set("effective_bits")).alias("widths"), F.sum("bytes").alias("bytes"))


def segment_table(df: DataFrame, keys: list[str], d: int) -> DataFrame:
    """One row of metadata for each segment of rows with `kind` and `bits`: what its codes take beside the codes.

    n rows, n_heads, n_pos, n_raw (rows with is_raw, if there is such a column), low and high widths and n_high channels.
    """
    raw = F.sum(F.col("is_raw").cast("long")) if "is_raw" in df.columns else F.lit(0).cast("long")
    rows = df.groupBy(*keys, "kind", "bits").agg(F.count("*").alias("n"), F.count_distinct("head").alias("n_heads"), F.count_distinct("pos").alias("n_pos"), raw.alias("n_raw"))
    low = F.floor("bits").cast("long")
    share = F.col("bits") - low
    return rows.withColumns({"dim": F.lit(d), "low": low, "high": low + (share > 0).cast("long"), "n_high": F.bround(share * d).cast("long")})


def storage_by_kind(segments: DataFrame) -> DataFrame:
    """bytes, dense_bytes, ratio and effective_bits of rows of `segment_table`, by what each kind stores.

    Codes of a segment are one bit string; scales take two bytes. Beside them: uniform channel scales and centres by head,
    channel scales, order and signs of dealt channels, a bit or a number for each row's choice, indices of chosen channels
    or coefficients. Raw rows take 16 bits a value and, like coded ones, an index for each position.
    """
    n, d, bits, low = F.col("n") - F.col("n_raw"), F.col("dim"), F.col("bits"), F.col("low")
    packed = lambda values: F.ceil(values / 8)
    kind = F.col("kind")
    plain = packed(n * d * low) + 2 * n
    split = packed(n * (d - F.col("n_high")) * low) + packed(n * F.col("n_high") * F.col("high")) + 4 * n + 2 * d
    residual = plain + packed(n * F.col("n_high")) + 2 * n + 2 * F.col("n_high")
    whole = F.col("n_high") == 0
    coded = (
        F.when(kind == "raw", 2 * n * d)
        .when(kind == "prod", packed(n * d * (low - 1)) + 2 * n + packed(n * d) + 2 * n)
        .when(kind == "uniform_channel", packed(n * d * low) + 2 * d * F.col("n_heads"))
        .when(kind == "centered_mse", plain + 2 * d * F.col("n_heads"))
        .when(kind.contains("vector") & kind.contains("outlier_hadamard"), plain + 3 * d + packed(n))
        .when(kind.contains("outlier_hadamard"), F.when(whole, plain + 3 * d).otherwise(split + 3 * d))
        .when(kind.startswith("rms_"), F.when(whole, plain + 2 * d).otherwise(split + 2 * d))
        .when(kind == "rotation_bank_mse", plain + n)
        .when(kind.endswith("rotation_bank_mse"), plain + 1)
        .when(kind.contains("hadamard_residual"), F.when(whole, plain).otherwise(residual))
        .otherwise(F.when(whole, plain).otherwise(split))
    )
    raw = F.when(F.col("n_raw") > 0, 2 * F.col("n_raw") * d + 2 * F.col("n_pos")).otherwise(0)
    size, dense = (coded + raw).cast("long"), F.col("n") * d * 2
    share = F.col("n_raw") / F.col("n")
    index_bits = F.when(kind == "raw", 16.0).otherwise((low * (d - F.col("n_high")) + F.col("high") * F.col("n_high")) / d)
    return segments.withColumns({"bytes": size, "dense_bytes": dense, "ratio": size / dense, "effective_bits": share * 16 + (1 - share) * index_bits})
