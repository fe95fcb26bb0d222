"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table: an offset and a step, both from a hash of
its name. Shards take turns; each turn claims the shard's first slot that nobody has. Rows then go to the shard that
owns slot `hash(key) mod size`: constant time by a broadcast join with a table whose size is a parameter, not data.

Adding or losing a shard moves few slots between the others, and the slots of any two shards differ by one at most.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, table

#: The largest lookup table that may be filled and broadcast.
MAX_SLOTS = 65_537
SHARDS, SLOTS = 24, 2039
#: Steps of the fill that run as one fold.
STEPS = 32_768


def digest(text: Column) -> Column:
    """32 bits of MD5 as a number; the same in any SQL engine."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def lookup_table(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard): the filled table, by SQL functions alone.

    A step of the fold probes one slot for the shard whose turn it is: a free one is claimed and the turn passes on, else
    the shard's next preference is due. About `slots * log(slots)` steps fill the table. They run in rounds of STEPS; the
    state between rounds (turn, preference, how far each shard is, free slots as bytes) is one row, written to the shared
    folder with the round's claims, so claims that are copied at every step stay few.
    `slots` must be a prime of at least the number of shards, which must be distinct and at least one.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and not empty")
    if not len(shards) <= slots <= MAX_SLOTS or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)) or slots < 2:
        raise ValueError(f"slots must be a prime from the number of shards to {MAX_SLOTS}")
    n = len(shards)
    names = F.array(*[F.lit(s) for s in shards])
    prefs = spark.range(1).select(
        F.transform(names, lambda s: digest(F.concat(F.lit("offset:"), s)) % slots).alias("start"),
        F.transform(names, lambda s: digest(F.concat(F.lit("step:"), s)) % (slots - 1) + 1).alias("step"),
    )
    # turn t; k preferences that the shard of the turn has behind it; at: the same for all shards at their last turns
    state = prefs.select("*", F.lit(0).alias("t"), F.lit(0).cast("long").alias("k"), F.array_repeat(F.lit(0).cast("long"), n).alias("at"), F.encode(F.lit("1" * slots), "UTF-8").alias("free"))
    own = f"cast(s.t % {n} as int) + 1"
    slot = f"cast((element_at(start, {own}) + s.k * element_at(step, {own})) % {slots} as int)"
    fold = f"""
      aggregate(sequence(1, {STEPS}), named_struct('t', t, 'k', k, 'at', at, 'free', free, 'got', cast(array() as array<int>)),
        (s, j) -> if(s.t >= {slots}, s, if(substring(s.free, {slot} + 1, 1) = X'31',
          named_struct('t', s.t + 1, 'k', if({n} = 1, s.k + 1, element_at(s.at, cast((s.t + 1) % {n} as int) + 1)),
            'at', transform(s.at, (v, i) -> if(i = s.t % {n}, s.k + 1, v)),
            'free', overlay(s.free placing X'30' from {slot} + 1 for 1), 'got', concat(s.got, array({slot}))),
          named_struct('t', s.t, 'k', s.k + 1, 'at', s.at, 'free', s.free, 'got', s.got))))"""
    claims, turn = [], 0
    while turn < slots:
        made = durable(state.select("start", "step", F.col("t").alias("first"), F.expr(fold).alias("s")))
        claims.append(made.select("first", F.posexplode("s.got").alias("nth", "slot")))
        state = made.select("start", "step", "s.t", "s.k", "s.at", "s.free")
        turn = state.select("t").first().t
    rows = reduce(DataFrame.unionByName, claims)
    return rows.select(F.col("slot").cast("long").alias("slot"), F.element_at(names, ((F.col("first") + F.col("nth")) % n + 1).cast("int")).alias("shard"))


def assign_shards(df: DataFrame, key: str, lookup: DataFrame, slots: int = SLOTS, spread_by: str | None = None, max_share: float = 0.02) -> DataFrame:
    """df with `slot` and `shard`, which replace columns of these names.

    A null key is a key of its own. With `spread_by` (a column that tells rows apart), keys with over `max_share` of all
    rows are salted, so that each salted part has at most about that share: a key with a third of the rows fills many slots.
    Rows keep their number; an empty table gives an empty one.
    """
    df = df.drop("slot", "shard")
    text = F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("null"))
    if spread_by is not None:
        counts = df.groupBy(F.col(key).alias("_k")).count()
        total = counts.agg(F.sum("count").alias("_all"))
        hot = counts.crossJoin(F.broadcast(total)).filter(F.col("count") > max_share * F.col("_all"))  # below 1 / max_share keys
        hot = hot.select("_k", F.ceil(F.col("count") / (max_share * F.col("_all"))).alias("_salts"))
        df = df.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k")
        salt = digest(F.coalesce(F.col(spread_by).cast("string"), F.lit("null"))) % F.col("_salts")
        text = F.concat(text, F.coalesce(F.concat(F.lit("#"), salt.cast("string")), F.lit("")))
    df = df.withColumn("slot", digest(text) % slots)
    return df.join(F.broadcast(lookup), "slot", "left").drop("_salts")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document by doc_id: doc_id, slot, shard."""
    names = [f"shard{k:03d}" for k in range(SHARDS)]
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return assign_shards(docs, "doc_id", lookup_table(spark, names)).select("doc_id", "slot", "shard")


OP1_SQL = f"""
WITH RECURSIVE names AS (SELECT i, 'shard' || lpad(CAST(i AS VARCHAR), 3, '0') AS shard FROM range({SHARDS}) r(i)),
prefs AS (SELECT i, shard,
    CAST('0x' || substr(md5('offset:' || shard), 1, 8) AS BIGINT) % {SLOTS} AS start,
    CAST('0x' || substr(md5('step:' || shard), 1, 8) AS BIGINT) % {SLOTS - 1} + 1 AS step FROM names),
lists AS (SELECT list(start ORDER BY i) AS starts, list(step ORDER BY i) AS steps FROM prefs),
fill(t, free, slot) AS (
    SELECT 0, range({SLOTS}), CAST(-1 AS BIGINT)
    UNION ALL
    SELECT t + 1, list_filter(free, lambda x: x <> pick), pick FROM (
        SELECT t, free, list_filter(list_transform(range({SLOTS}), lambda k: (starts[t % {SHARDS} + 1] + k * steps[t % {SHARDS} + 1]) % {SLOTS}),
            lambda s: list_contains(free, s))[1] AS pick
        FROM fill, lists WHERE t < {SLOTS}) x),
owners AS (SELECT slot, 'shard' || lpad(CAST((t - 1) % {SHARDS} AS VARCHAR), 3, '0') AS shard FROM fill WHERE t > 0)
SELECT doc_id, CAST('0x' || substr(md5(coalesce('k' || CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) % {SLOTS} AS slot, shard
FROM documents JOIN owners ON owners.slot = CAST('0x' || substr(md5(coalesce('k' || CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) % {SLOTS}
"""
