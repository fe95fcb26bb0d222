"""Aggregation and comparison of scored runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def run_summary(results: DataFrame, tasks: DataFrame) -> DataFrame:
    """One pass of grouping sets: overall, by dataset and by category (micro averages over rows)."""
    rows = results.join(tasks, "dataset", "left").withColumnRenamed("dataset", "d").withColumnRenamed("category", "c")
    out = rows.groupingSets([[], ["d"], ["c"]], "d", "c").agg(
        F.grouping_id().alias("g"), F.count("*").alias("n"), F.avg("prompt_tokens").alias("prompt_tokens"), F.avg("latency").alias("latency"),
        F.avg("ratio").alias("ratio"), (100 * F.avg("score")).alias("score"), F.avg((F.col("score") >= 0.5).cast("double")).alias("accuracy"),
    )
    level = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "dataset").otherwise("category")
    return out.select(level.alias("level"), F.coalesce("d", "c", F.lit("all")).alias("name"), "n", "prompt_tokens", "latency", "ratio", "score", "accuracy")


def category_table(results: DataFrame, tasks: DataFrame) -> DataFrame:
    """Macro averages: rows to datasets, datasets to categories, categories to one average."""
    per_task = results.join(tasks, "dataset").groupBy("method", "bits", "category", "dataset").agg(F.avg("score").alias("score"))
    per_category = per_task.groupBy("method", "bits", "category").agg((100 * F.avg("score")).alias("score"), F.count("*").alias("n_tasks"))
    whole = per_category.groupBy("method", "bits").agg(F.avg("score").alias("score"), F.sum("n_tasks").alias("n_tasks")).withColumn("category", F.lit("Average"))
    return per_category.unionByName(whole)


def method_comparison(pairs: DataFrame, tasks: DataFrame, active: Column | None = None) -> DataFrame:
    """Means of base and candidate by task, over indexes of both; delta, ratio, activation and completeness.

    With `active`, the candidate has the variant's score only where it holds.
    """
    pairs = pairs.withColumn("on", active if active is not None else F.lit(True))
    candidate = F.when(F.col("on"), F.col("variant_score")).otherwise(F.col("score"))
    rows = pairs.groupBy("bits", "dataset").agg((100 * F.avg("score")).alias("base"), (100 * F.avg(candidate)).alias("candidate"), F.avg(F.col("on").cast("double")).alias("activation"), F.count_distinct("index").alias("n"))
    rows = rows.join(tasks, "dataset")
    return rows.withColumns({"delta": F.col("candidate") - F.col("base"), "relative": F.when(F.col("base") != 0, F.col("candidate") / F.col("base")), "complete": F.col("n") == F.col("expected")})


def mismatched_indexes(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """Keys that just one side has, by a full outer join."""
    a, b = (x.select("dataset", "index", "bits").distinct().withColumn(f, F.lit(True)) for x, f in ((base, "in_base"), (candidate, "in_candidate")))
    return a.join(b, ["dataset", "index", "bits"], "full").filter("in_base is null or in_candidate is null").select("dataset", "index", "bits", F.col("in_base").isNotNull().alias("in_base"))


def official_comparison(results: DataFrame, tasks: DataFrame, published: DataFrame) -> DataFrame:
    """Category scores of complete tasks beside published ones; a category counts only if all its tasks are complete."""
    per_task = results.groupBy("method", "bits", "dataset").agg(F.count_distinct("index").alias("n"), (100 * F.avg("score")).alias("score"))
    methods = results.select("method", "bits").distinct()
    grid = methods.crossJoin(tasks).join(per_task, ["method", "bits", "dataset"], "left").withColumn("complete", F.coalesce(F.col("n") == F.col("expected"), F.lit(False)))
    local = grid.groupBy("method", "bits", "category").agg(F.when(F.min("complete"), F.avg("score")).alias("score")).withColumn("origin", F.lit("local"))
    return local.unionByName(published.withColumn("origin", F.lit("published")))


def best_source(candidates: DataFrame, tasks: DataFrame) -> DataFrame:
    """For each task and width the source to use: complete before incomplete, then the largest, then by name."""
    sizes = candidates.groupBy("source", "bits", "dataset").agg(F.count_distinct("index").alias("n")).join(tasks, "dataset")
    order = Window.partitionBy("bits", "dataset").orderBy((F.col("n") == F.col("expected")).desc(), F.desc("n"), "source")
    return sizes.withColumn("rank", F.row_number().over(order)).filter("rank = 1").select("bits", "dataset", "source", "n")


def task_progress(results: DataFrame, tasks: DataFrame) -> DataFrame:
    """Every method, width and task: rows against expected, state, and the score of complete ones."""
    runs = results.select("method", "bits").distinct()
    have = results.groupBy("method", "bits", "dataset").agg(F.count_distinct("index").alias("n"), (100 * F.avg("score")).alias("score"))
    rows = runs.crossJoin(tasks).join(have, ["method", "bits", "dataset"], "left").fillna(0, ["n"])
    state = F.when(F.col("n") >= F.col("expected"), "complete").when(F.col("n") > 0, "partial").otherwise("missing")
    return rows.select("method", "bits", "dataset", "n", "expected", state.alias("state"), F.when(state == "complete", F.col("score")).alias("score"))


def output_audit(results: DataFrame, tasks: DataFrame) -> DataFrame:
    """Tasks of a run whose unique indexes aren't as many as expected, or that have repeated ones."""
    have = results.groupBy("method", "bits", "dataset").agg(F.count_distinct("index").alias("n_unique"), F.count("*").alias("n_rows"))
    grid = results.select("method", "bits").distinct().crossJoin(tasks).join(have, ["method", "bits", "dataset"], "left").fillna(0, ["n_unique", "n_rows"])
    return grid.filter("n_unique <> expected or n_rows <> n_unique").select("method", "bits", "dataset", "n_unique", "n_rows", "expected")


def needle_summary(needle: DataFrame) -> DataFrame:
    """All levels of needle results in one query of grouping sets."""
    n = needle.withColumnsRenamed({"needle_position": "p", "distractor_lang": "l", "target_prompt_tokens": "t"})
    sets = [[], ["p"], ["l"], ["p", "l"], ["t"], ["t", "p"]]
    out = n.groupingSets(sets, "p", "l", "t").agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.avg(F.col("answer_contains").cast("double")).alias("accuracy"), F.avg("latency_seconds").alias("latency"), F.avg("prompt_tokens").alias("prompt_tokens"))
    return out.withColumnsRenamed({"p": "needle_position", "l": "distractor_lang", "t": "target_prompt_tokens", "g": "level"})


def needle_cells(needle: DataFrame, buckets: list[int]) -> DataFrame:
    """Accuracy by length bucket (the nearest from above) and depth in percent."""
    bucket = F.coalesce(*[F.when(F.col("prompt_tokens") <= b, b) for b in sorted(buckets)], F.col("prompt_tokens"))
    depth = F.when(F.col("needle_position") == "start", 0).when(F.col("needle_position") == "middle", 50).when(F.col("needle_position") == "end", 100).otherwise(-1)
    return needle.groupBy(bucket.cast("long").alias("bucket"), depth.alias("depth")).agg(F.count("*").alias("n"), F.avg(F.col("answer_contains").cast("double")).alias("accuracy"))


def needle_heatmap(cells: DataFrame) -> DataFrame:
    return cells.groupBy("bucket").pivot("depth", [-1, 0, 50, 100]).agg(F.first("accuracy")).withColumnsRenamed({"-1": "other", "0": "start", "50": "middle", "100": "end"})


def needle_flat(needle: DataFrame) -> DataFrame:
    """Overall, position and language levels as one long table."""
    n = needle.withColumnsRenamed({"needle_position": "p", "distractor_lang": "l"})
    out = n.groupingSets([[], ["p"], ["l"]], "p", "l").agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.avg(F.col("answer_contains").cast("double")).alias("accuracy"))
    return out.select(F.when(F.col("g") == 3, "overall").when(F.col("g") == 1, "position").otherwise("lang").alias("level"), F.coalesce("p", "l", F.lit("all")).alias("name"), "n", "accuracy")


def against_published(measured: DataFrame, published: DataFrame, key: str, value: str) -> DataFrame:
    """Difference and ratio to published figures; the published side is a handful of rows."""
    return measured.join(F.broadcast(published), key, "left").withColumns({"difference": F.col(value) - F.col("published"), "ratio": F.col(value) / F.col("published")})


def compression_runs(runs: DataFrame) -> DataFrame:
    """Average, least and largest effective bits by run, and how often each outlier count occurs."""
    plain = runs.groupBy("run").agg(F.avg("effective_bits").alias("avg_bits"), F.min("effective_bits").alias("min_bits"), F.max("effective_bits").alias("max_bits"), F.avg("ratio").alias("ratio"))
    counts = runs.select("run", F.explode("outlier_counts").alias("c")).groupBy("run", "c").agg(F.count("*").alias("n"))
    return plain.join(counts.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("c", "n"))).alias("histogram")), "run", "left")


def coverage(results: DataFrame, tasks: DataFrame) -> DataFrame:
    """Tasks and whether the rows have any of them: available or missing, by category."""
    have = results.select("dataset").distinct().withColumn("there", F.lit(True))
    return tasks.join(have, "dataset", "left").select("category", "dataset", F.when(F.col("there"), "available").otherwise("missing").alias("state"))


def run_manifest(results: DataFrame, tasks: DataFrame, runs: DataFrame) -> DataFrame:
    """Every wanted run (method, bits) and task with its rows and state, also of runs that have none."""
    have = results.groupBy("method", "bits", "dataset").agg(F.count_distinct("index").alias("n"), F.max("index").alias("last"))
    rows = runs.crossJoin(tasks).join(have, ["method", "bits", "dataset"], "left").fillna(0, ["n"])
    state = F.when(F.col("n") >= F.col("expected"), "done").when(F.col("n") > 0, "resume").otherwise("start")
    return rows.select("method", "bits", "dataset", "n", "expected", state.alias("state"), (F.coalesce("last", F.lit(-1)) + 1).alias("next_index"))


def rescore_files(df: DataFrame, score: Column) -> DataFrame:
    """Rows and mean score by the folder of the file they come from: all files of a tree in one job."""
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return df.select(folder.alias("run"), score.alias("s")).groupBy("run").agg(F.count("*").alias("n"), F.avg("s").alias("score"))
