"""Attention proxies as joins and sums: scores, probabilities, and the error that coding makes in them.

The last t queries of a sequence meet all its keys by an equi-join on (seq, layer, head), so the result is linear in keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .codec import dot
from .segments import channel_sums, pick_by_segment

SCALING = 0.125
QUERY = ["seq_id", "layer", "q_head", "q_pos"]
HEAD = ["seq_id", "layer", "kv_head"]


def attention_scores(q: DataFrame, keys: DataFrame, column: str = "vec", scaling: float = SCALING) -> DataFrame:
    """One row per query and key of its head: `score`."""
    k = keys.withColumnRenamed("head", "kv_head").select(*HEAD, "pos", F.col(column).alias("k"))
    return q.join(k, HEAD).select(*QUERY, "kv_head", "pos", (dot("q", "k") * scaling).alias("score"))


#: Scores are summed by steps of this size, so that a partial sum stays below e^STEP for each key.
STEP = 32.0


def causal_probs(scores: DataFrame, length: int = 8, t: int = 1) -> DataFrame:
    """Softmax over the keys a query may see: all for one query, else those up to its own position.

    A query's keys are never in one task: exp(score - step) is summed by query and step of the score, which tasks add up
    before the shuffle; the few steps of a query make one sum, which is joined back.
    """
    seen = scores if t == 1 else scores.filter(F.col("pos") <= F.col("q_pos"))
    step = F.floor(F.col("score") / STEP)
    sums = seen.groupBy(*QUERY, step.alias("step")).agg(F.sum(F.exp(F.col("score") - step * STEP)).alias("s"))
    steps = sums.groupBy(*QUERY).agg(F.max("step").alias("top"), F.collect_list(F.struct("step", "s")).alias("steps"))
    whole = F.aggregate("steps", F.lit(0.0), lambda a, x: a + x["s"] * F.exp((x["step"] - F.col("top")) * STEP))
    norms = steps.select(*QUERY, "top", whole.alias("whole"))
    return seen.join(norms, QUERY).withColumn("p", F.exp(F.col("score") - F.col("top") * STEP) / F.col("whole")).drop("top", "whole").select(*scores.columns, "p")


def attention_probs(q: DataFrame, keys: DataFrame, t: int = 1, scaling: float = SCALING) -> DataFrame:
    return causal_probs(attention_scores(q, keys, scaling=scaling), t=t)


def entropy_ratio(probs: DataFrame, keys: list[str]) -> DataFrame:
    """Mean entropy over the logarithm of the number of keys, 0 for a single key."""
    h = probs.groupBy(*keys, *[k for k in QUERY if k not in keys]).agg((-F.sum(F.when(F.col("p") > 0, F.col("p") * F.log("p")).otherwise(0.0))).alias("h"), F.count("*").alias("n"))
    return h.groupBy(*keys).agg(F.avg(F.when(F.col("n") > 1, F.col("h") / F.log("n")).otherwise(0.0)).alias("entropy_ratio"))


def key_error(q: DataFrame, coded: DataFrame, keys: list[str], t: int = 1) -> DataFrame:
    """Mean of p (s - s')^2 over queries and keys, where s' comes from `vec_hat`."""
    exact = attention_probs(q, coded, t)
    other = attention_scores(q, coded, "vec_hat").select(*QUERY, "pos", F.col("score").alias("other"))
    both = exact.join(other, [*QUERY, "pos"])
    return both.groupBy(*keys).agg(F.avg(F.col("p") * (F.col("score") - F.col("other")) ** 2).alias("error"))


def value_error(q: DataFrame, k: DataFrame, values: DataFrame, keys: list[str], t: int = 1) -> DataFrame:
    """Mean over values of the mean squared probability times the squared error of `vec_hat`."""
    weight = attention_probs(q, k, t).groupBy(*HEAD, "pos").agg(F.avg(F.col("p") ** 2).alias("w"))
    v = values.withColumnRenamed("head", "kv_head").select(*HEAD, "pos", _square("vec", "vec_hat").alias("sse"))
    return v.join(weight, [*HEAD, "pos"]).groupBy(*keys).agg(F.avg(F.col("w") * F.col("sse")).alias("error"))


def _square(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def token_weights(q: DataFrame, k: DataFrame, squared: bool = False, t: int = 1) -> DataFrame:
    """Mean probability (or its square) of every key position by head: weights for channel and position choices."""
    p = F.col("p") ** 2 if squared else F.col("p")
    return attention_probs(q, k, t).groupBy(*HEAD, "pos").agg(F.avg(p).alias("weight")).withColumnRenamed("kv_head", "head")


def attention_scale(q: DataFrame, coded: DataFrame, t: int = 1) -> DataFrame:
    """Per key vector the factor, not negative, that fits its decoded unit scores to the exact ones."""
    exact = attention_scores(q, coded).select(*QUERY, "kv_head", "pos", F.col("score").alias("s"))
    unit = attention_scores(q, coded, "unit_hat").select(*QUERY, "pos", F.col("score").alias("u"))
    both = exact.join(unit, [*QUERY, "pos"]).groupBy(*HEAD, "pos").agg(F.sum(F.col("s") * F.col("u")).alias("su"), F.sum(F.col("u") ** 2).alias("uu"))
    return both.select("seq_id", "layer", F.col("kv_head").alias("head"), "pos", F.when(F.col("uu") > 0, F.greatest(F.col("su") / F.col("uu"), F.lit(0.0))).otherwise(0.0).alias("attention_scale"))


def token_errors(q: DataFrame, coded_keys: DataFrame, coded_values: DataFrame, t: int = 1) -> DataFrame:
    """Per position: keys by p |q (k - k')|, values by mean p times the squared error."""
    probs = attention_probs(q, coded_keys, t)
    other = attention_scores(q, coded_keys, "vec_hat").select(*QUERY, "pos", F.col("score").alias("other"))
    k = probs.join(other, [*QUERY, "pos"]).groupBy("seq_id", "layer", "pos").agg(F.avg(F.col("p") * F.abs(F.col("score") - F.col("other"))).alias("error")).withColumn("side", F.lit("key"))
    weight = probs.groupBy(*HEAD, "pos").agg(F.avg("p").alias("w"))
    v = coded_values.withColumnRenamed("head", "kv_head").select(*HEAD, "pos", _square("vec", "vec_hat").alias("sse")).join(weight, [*HEAD, "pos"])
    return k.unionByName(v.groupBy("seq_id", "layer", "pos").agg(F.avg(F.col("w") * F.col("sse")).alias("error")).withColumn("side", F.lit("value")))


def error_metrics(q: DataFrame, coded: DataFrame, by: list[str], t: int = 1) -> DataFrame:
    """Score and probability errors of decoded keys, and how often the strongest key stays the same."""
    exact = attention_probs(q, coded, t)
    other = causal_probs(attention_scores(q, coded, "vec_hat"), t=t).select(*QUERY, "pos", F.col("score").alias("score_hat"), F.col("p").alias("p_hat"))
    both = exact.join(other, [*QUERY, "pos"])
    per_query = both.groupBy(*[c for c in by if c not in QUERY], *QUERY).agg(
        F.avg(F.abs(F.col("score") - F.col("score_hat"))).alias("score_mae"), F.avg((F.col("score") - F.col("score_hat")) ** 2).alias("score_mse"),
        F.avg(F.abs(F.col("p") - F.col("p_hat"))).alias("prob_mae"), F.sum(F.abs(F.col("p") - F.col("p_hat"))).alias("prob_l1"),
        (F.max_by("pos", F.struct("score", -F.col("pos"))) == F.max_by("pos", F.struct("score_hat", -F.col("pos")))).cast("double").alias("top1"),
    )
    return per_query.groupBy(*by).agg(F.avg("score_mae").alias("score_mae"), F.sqrt(F.avg("score_mse")).alias("score_rmse"), F.avg("prob_mae").alias("prob_mae"), F.avg("prob_l1").alias("prob_l1"), F.avg("top1").alias("top1_match"))


def output_error(q: DataFrame, k: DataFrame, v: DataFrame, keys: list[str], t: int = 1) -> DataFrame:
    """Mean squared difference of attention outputs with exact and with decoded values."""
    rows = v.withColumnRenamed("head", "kv_head").select(*HEAD, "pos", F.zip_with("vec", "vec_hat", lambda a, b: a - b).alias("gap"))
    out = _outputs(attention_probs(q, k, t).join(rows, [*HEAD, "pos"]), "gap", "p")
    return out.groupBy(*keys).agg(F.avg(F.col("total") ** 2).alias("error"))


def _outputs(rows: DataFrame, column: str, weight: str) -> DataFrame:
    """QUERY, ch, total: weighted sums of a query's vectors; a task sends one sum for each query and channel that it has."""
    return channel_sums(rows, column, QUERY, lambda x, batch: x * batch.column(weight).to_numpy(zero_copy_only=False)[:, None])


def guard_by_entropy(segments: DataFrame, ratios: DataFrame, keys: list[str], limit: float, kind: str, base: str = "mse", below: bool = True) -> DataFrame:
    """kind where the entropy ratio is at most (or over) the limit; base elsewhere and where there is none."""
    rows = segments.join(ratios, keys, "left")
    good = F.col("entropy_ratio") <= limit if below else ~(F.col("entropy_ratio") > limit)
    return rows.withColumn("kind", F.when(F.coalesce(good, F.lit(False)), kind).otherwise(base))


def pick_by_attention(q: DataFrame, candidates: dict[str, DataFrame], keys: list[str], t: int = 1) -> DataFrame:
    """Per segment the candidate (rows with vec and vec_hat) of the least attention error of its keys: kind and vec_hat.

    Serves every kind that chooses between codings by this proxy; segments without queries keep the first candidate.
    """
    names = list(candidates)
    errors = [key_error(q, c, keys, t).withColumnRenamed("error", f"sse_{n}") for n, c in candidates.items()]
    segments = candidates[names[0]].select(*keys).distinct()
    chosen = segments.join(pick_by_segment(reduce(lambda a, b: a.join(b, keys), errors), keys, names), keys, "left").fillna(names[0], ["kind"])
    common = [*dict.fromkeys([*keys, "vec_id", "head", "pos", "vec", "vec_hat"])]
    return reduce(DataFrame.unionByName, [c.select(*common).join(chosen.filter(F.col("kind") == n), keys) for n, c in candidates.items()])


def key_output_error(q: DataFrame, coded: DataFrame, v: DataFrame, keys: list[str], t: int = 1) -> DataFrame:
    """Mean squared difference of attention outputs with exact and with decoded keys, over the exact values."""
    other = causal_probs(attention_scores(q, coded, "vec_hat"), t=t).select(*QUERY, "kv_head", "pos", F.col("p").alias("p_hat"))
    gap = attention_probs(q, coded, t).join(other, [*QUERY, "kv_head", "pos"]).select(*QUERY, "kv_head", "pos", (F.col("p") - F.col("p_hat")).alias("gap"))
    out = _outputs(gap.join(v.withColumnRenamed("head", "kv_head").select(*HEAD, "pos", "vec"), [*HEAD, "pos"]), "vec", "gap")
    return out.groupBy(*keys).agg(F.avg(F.col("total") ** 2).alias("error"))


def relative_errors(coded: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the norm of all errors over the norm of all vectors."""
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    return coded.groupBy(*keys).agg(F.sqrt(F.sum(_square("vec", "vec_hat")) / F.sum(norm)).alias("relative_l2"))
