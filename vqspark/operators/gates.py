"""Prompt features, routing rules and gated comparison of methods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prompt_features(df: DataFrame, text: str) -> DataFrame:
    """Marks, questions, lengths and shares that routing rules use."""
    t = F.col(text)
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    passages = F.regexp_count(F.lower(t), F.lit(r"\bpassage\s+\d+\s*:"))
    return df.withColumns({
        "passage_count": passages, "question_marks": F.length(t) - F.length(F.replace(t, F.lit("?"), F.lit(""))), "chars": F.length(t),
        "newlines": F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))), "sentences": F.regexp_count(t, F.lit(r"[.!?]")),
        "capitalized_ratio": F.size(F.filter(words, lambda w: w.rlike("^[A-Z]"))) / F.greatest(F.size(words), F.lit(1)),
        "avg_passage_chars": F.length(t) / F.greatest(passages, F.lit(1)),
    })


def code_prompt(dataset: Column, text: Column, phrases: tuple[str, ...] = ("complete the code",), markers: tuple[str, ...] = ("def ", "class ", "import ", "return ", "{", "};")) -> Column:
    """A code task by its dataset, by a phrase near the start, or by a phrase and three code markers anywhere."""
    low = F.lower(text)
    has = lambda where: reduce(Column.__or__, [where.contains(p) for p in phrases])
    marks = reduce(Column.__add__, [text.contains(m).cast("int") for m in markers])
    return dataset.isin("lcc", "repobench-p") | has(low.substr(1, 2048)) | (has(low) & (marks >= 3))


def gate(min_tokens: int, max_tokens: int | None, max_passages: int | None, max_questions: int | None, questions_need_passages: bool = False) -> Column:
    """Whether the variant is used: longer than, at most as long as, not code, limits on passages (if any) and questions."""
    rule = (F.col("prompt_tokens") > min_tokens) & ~F.col("code_like")
    if max_tokens is not None:
        rule &= F.col("prompt_tokens") <= max_tokens
    if max_passages is not None:
        rule &= (F.col("passage_count") == 0) | (F.col("passage_count") <= max_passages)
    if max_questions is not None:
        within = F.col("question_marks") <= max_questions
        rule &= ((F.col("passage_count") == 0) | within) if questions_need_passages else within
    return rule


def route(df: DataFrame, rule: Column, variant: str, base: str) -> DataFrame:
    return df.withColumn("effective_kind", F.when(rule, variant).otherwise(base))


def paired(results: DataFrame) -> DataFrame:
    """Base and variant rows side by side by dataset, index and bits."""
    base, other = results.filter("method = 'base'"), results.filter("method = 'variant'")
    keep = other.select("dataset", "index", "bits", F.col("score").alias("variant_score"))
    return base.join(keep, ["dataset", "index", "bits"])


def rule_cells(examples: DataFrame, rules: DataFrame, by: list[str]) -> DataFrame:
    """Examples counted by what rules can tell apart: features are replaced by the thresholds next to them.

    The result has at most as many rows as there are groups (`by`) and combinations of thresholds, however many examples
    there are, and rules hold on its rows as they hold on the examples: columns prompt_tokens, passage_count (0 stays 0),
    question_marks, code_like, n and delta (a sum).
    """
    cuts = rules.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in ("min_tokens", "max_passages", "max_questions")]).first()
    most = F.lit(2**31 - 1)
    below = F.greatest(F.lit(-1), *[F.when(F.col("prompt_tokens") > t, t + 1) for t in cuts.min_tokens])
    above = lambda column, values: F.coalesce(F.least(most, *[F.when(F.col(column) <= v, v) for v in values]), most)
    cells = examples.select(
        *by, "code_like", below.alias("prompt_tokens"), F.when(F.col("passage_count") == 0, 0).otherwise(F.greatest(above("passage_count", cuts.max_passages), F.lit(1))).alias("passage_count"),
        above("question_marks", cuts.max_questions).alias("question_marks"), "delta",
    )
    keys = [*by, "code_like", "prompt_tokens", "passage_count", "question_marks"]
    return cells.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("delta").alias("delta"))


def gate_search(results: DataFrame, tasks: DataFrame, rules: DataFrame, k: int = 20) -> DataFrame:
    """Rules by the least gain over bit widths; the examples are first counted by what rules can tell apart.

    The gain of a rule at a width is the macro average, over categories and their tasks, of score changes where it holds.
    A rule without max_passages limits questions only where there are passages. Rules are a fixed grid and broadcast.
    """
    examples = paired(results).join(tasks, "dataset").withColumn("delta", F.col("variant_score") - F.col("score"))
    cells = rule_cells(examples, rules, ["bits", "category", "dataset"])
    passages, questions = F.col("passage_count"), F.col("question_marks") <= F.col("max_questions")
    limits = F.when(F.col("max_passages").isNull(), (passages == 0) | questions).otherwise(((passages == 0) | (passages <= F.col("max_passages"))) & questions)
    holds = (F.col("prompt_tokens") > F.col("min_tokens")) & ~F.col("code_like") & limits
    share = lambda x: F.sum(F.when(holds, F.col(x)).otherwise(0.0)) / F.sum("n")
    per_task = cells.crossJoin(F.broadcast(rules)).groupBy("rule", "bits", "category", "dataset").agg(share("delta").alias("gain"), share("n").alias("active"))
    per_category = per_task.groupBy("rule", "bits", "category").agg(F.avg("gain").alias("gain"), F.avg("active").alias("active"))
    wide = per_category.groupBy("rule", "bits").agg(F.avg("gain").alias("gain"), F.avg("active").alias("active"))
    both = wide.groupBy("rule").agg(F.min("gain").alias("least_gain"), F.max("gain").alias("best_gain"), F.avg("active").alias("activation"))
    return both.filter("least_gain > 0").orderBy(F.round("least_gain", 9).desc(), F.round("best_gain", 9).desc(), "rule").limit(k)


def rule_grid(spark, tokens: list[int], passages: list[int], questions: list[int]) -> DataFrame:  # noqa: ANN001
    """All rules of three thresholds; None among the passages stands for rules that limit questions alone."""
    rows = [(i, *r) for i, r in enumerate((t, p, q) for t in tokens for p in passages for q in questions)]
    return spark.createDataFrame(rows, "rule int, min_tokens int, max_passages int, max_questions int")


def materialize_gate(base: DataFrame, variant: DataFrame, rule: Column) -> DataFrame:
    """Per index the variant's score where the rule holds, else the base's, with where it came from.

    `missing` marks active rows that the variant lacks: the caller decides whether that is an error.
    """
    other = variant.select("dataset", "index", F.col("score").alias("variant_score"))
    rows = base.withColumn("active", rule).join(other, ["dataset", "index"], "left")
    return rows.select(
        "dataset", "index", "active", F.when(F.col("active"), F.col("variant_score")).otherwise(F.col("score")).alias("score"),
        F.when(F.col("active"), "variant").otherwise("base").alias("origin"), (F.col("active") & F.col("variant_score").isNull()).alias("missing"),
    )


def prefill_inactive(existing: DataFrame, base: DataFrame, rule: Column) -> DataFrame:
    """Existing rows, and base rows where the rule doesn't hold and nothing exists yet."""
    idle = base.filter(~rule).join(existing.select("dataset", "index"), ["dataset", "index"], "left_anti")
    return existing.select("dataset", "index", "score", F.lit("existing").alias("origin")).unionByName(idle.select("dataset", "index", "score", F.lit("base").alias("origin")))


def verify_existing(made: DataFrame, existing: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Rows of both whose scores differ by more than the tolerance, or where just one is null."""
    pair = made.select("dataset", "index", F.col("score").alias("made")).join(existing.select("dataset", "index", F.col("score").alias("held")), ["dataset", "index"])
    return pair.filter(F.coalesce(F.abs(F.col("made") - F.col("held")) > tolerance, ~F.col("made").eqNullSafe(F.col("held"))))


def regime_kind(kind: str, bits: float) -> Column:
    """What a kind that depends on rate, side and layer stands for; other kinds stand for themselves."""
    low = bits < 3
    value = F.col("side") == "value"
    fine = F.lit("learned_unit_mse_block2")
    made = {
        "distortion_regime_mse": F.lit("gain_mse") if bits <= 2 else fine,
        "gain_unit_regime_mse": F.lit("gain_mse" if bits <= 2 else "unit_mse"),
        "rate_regime_mse": F.lit("gain_mse") if low else fine,
        "hadamard_rate_regime_mse": F.when(value, "margin_vector_outlier_hadamard_mse").otherwise("mse") if low else fine,
        "rate_hadamard_value_mse": F.when(~value, "mse").when(F.lit(low), "margin_vector_outlier_hadamard_mse").when(F.col("layer") >= 16, "outlier_hadamard_mse").otherwise("mse"),
    }
    return made.get(kind, F.lit(kind))


def code_passthrough(base: DataFrame, code_datasets: tuple[str, ...] = ("lcc", "repobench-p")) -> DataFrame:
    """Base rows of code tasks as a gated run has them: never active, with the columns that tell so."""
    rows = base.filter(F.col("dataset").isin(*code_datasets))
    return rows.select("dataset", "index", "score", F.lit(False).alias("active"), F.lit("base").alias("origin"), F.lit("code").alias("reason"))


def feature_profile(features: DataFrame, scores: DataFrame, columns: list[str], key: list[str]) -> DataFrame:
    """dataset, n, n_scored, score, and mean, least and largest of every feature; rows without a score count in the features."""
    rows = features.join(scores.select(*key, F.col("score").alias("_score")), key, "left")
    stats = [f(F.col(c)).cast("double").alias(f"{n}_{c}") for c in columns for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))]
    return rows.groupBy("dataset").agg(F.count("*").alias("n"), F.count("_score").alias("n_scored"), F.avg("_score").alias("score"), *stats)
