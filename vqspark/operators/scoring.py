"""Scores of predictions against answers, in SQL functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..session import ship

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Which score a task takes.
METRICS = {
    "narrativeqa": "f1", "qasper": "f1", "multifieldqa_en": "f1", "hotpotqa": "f1", "2wikimqa": "f1", "musique": "f1", "triviaqa": "f1",
    "dureader": "rouge", "gov_report": "rouge", "qmsum": "rouge", "multi_news": "rouge", "vcsum": "rouge", "samsum": "rouge",
    "trec": "class", "lsht": "class", "passage_retrieval_en": "retrieval", "passage_retrieval_zh": "retrieval", "passage_count": "count", "lcc": "code", "repobench-p": "code",
}
FIRST_LINE = ("trec", "triviaqa", "samsum", "lsht")
# The classes of trec, for rows that name none.
TREC_CLASSES = [
    "Description of something", "Entity", "Expression abbreviated", "Individual", "Group or organization of person", "Title of a person", "Description of a person", "Reason",
    "Definition of something", "Animal", "Body", "Color", "Creative piece", "Currency name", "Disease and medicine", "Event", "Food", "Musical instrument", "Language", "Letter",
    "Other entity", "Plant", "Product", "Religion", "Sport", "Element and substance", "Symbol", "Techniques and method", "Equivalent term", "Vehicle", "Word with a special property",
    "Numerical value", "Code", "Number of something", "Date", "Distance, linear measure", "Price", "Order, rank", "Lasting time of somethin", "Percent, fraction", "Speed",
    "Temperature", "Size, area and volume", "Weight", "Location", "City", "Country", "Mountain", "Other location", "State",
]


def normalize(text: Column) -> Column:
    """Lower case without ASCII punctuation, articles and doubled space."""
    bare = F.translate(F.lower(text), PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "), r"\s+", " "))


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda t: t != "")


def with_f1(df: DataFrame, prediction: str, answer: str, key: list[str], name: str = "f1") -> DataFrame:
    """Bag F1 of normalized words by counting and joining words, for texts of any length."""
    count = lambda c, n: df.select(*key, F.explode(tokens(normalize(F.col(c)))).alias("w")).groupBy(*key, "w").agg(F.count("*").alias(n))
    a, b = count(prediction, "na"), count(answer, "nb")
    same = a.join(b, [*key, "w"]).groupBy(*key).agg(F.sum(F.least("na", "nb")).alias("same"))
    sizes = df.select(*key, F.size(tokens(normalize(F.col(prediction)))).alias("p"), F.size(tokens(normalize(F.col(answer)))).alias("g"))
    return sizes.join(same, key, "left").select(*key, F.coalesce(2 * F.col("same") / (F.col("p") + F.col("g")), F.lit(0.0)).alias(name))


def lcs_length(a: list, b: list) -> int:
    """Longest common subsequence by bit-parallel rows: one big number holds a row of the usual table."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for x in b:
        same = row & places.get(x, 0)
        row = (row + same | row - same) & full
    return len(a) - row.bit_count()


@F.pandas_udf(IntegerType())
def _lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two lists, for whole Arrow batches."""
    return pd.Series([lcs_length(list(x), list(y)) if x is not None and y is not None else 0 for x, y in zip(a, b, strict=True)])


def lcs(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two list columns."""
    if (spark := SparkSession.getActiveSession()) is not None:
        ship(spark)
    return _lcs(a, b)


def without_line_feeds(text: Column) -> Column:
    return F.ltrim(text, F.lit("\n"))


def task(dataset: Column) -> Column:
    """A task's name without the suffix of its shorter variant."""
    return F.regexp_replace(dataset, "_e$", "")


def rouge_l(prediction: Column, answer: Column) -> Column:
    """F-measure of the longest common subsequence of white-space words; 0 if either has none."""
    a, b = (F.filter(F.split(F.coalesce(x, F.lit("")), r"\s+"), lambda t: t != "") for x in (prediction, answer))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 2 * lcs(a, b) / (F.size(a) + F.size(b))).otherwise(0.0)


def classification(prediction: Column, answer: Column, classes: Column) -> Column:
    """1 / n if the answer is among the n classes named, other classes within the answer's text not counted."""
    named = F.filter(classes, lambda c: prediction.contains(c) & ~(answer.contains(c) & (c != answer)))
    return F.when(F.array_contains(named, answer), 1.0 / F.size(named)).otherwise(0.0)


def numbers_equal(prediction: Column, wanted: Column) -> Column:
    """Share of the numbers named that are the wanted one."""
    found = F.regexp_extract_all(prediction, F.lit(r"(\d+)"), F.lit(1))
    return F.when(F.size(found) > 0, F.size(F.filter(found, lambda x: x == wanted)) / F.size(found)).otherwise(0.0)


def retrieval(prediction: Column, answer: Column) -> Column:
    wanted = F.regexp_extract(answer, r"Paragraph (\d+)", 1)
    return F.when(wanted != "", numbers_equal(prediction, wanted)).otherwise(0.0)


def code_similarity(prediction: Column, answer: Column) -> Column:
    """Twice the common subsequence of characters over both lengths, in whole percent, for the first line that is code."""
    lines = F.filter(F.split(without_line_feeds(prediction), "\n"), lambda x: ~(x.contains("`") | x.contains("#") | x.contains("//")))
    a, b = (F.filter(F.split(F.coalesce(x, F.lit("")), ""), lambda c: c != "") for x in (F.get(lines, F.lit(0)), answer))
    return F.when(F.size(a) + F.size(b) > 0, F.round(200 * lcs(a, b) / (F.size(a) + F.size(b))) / 100).otherwise(0.0)


def contains_answer(prediction: Column, answers: Column) -> Column:
    """Whether any answer that isn't empty stands, normalized, in the prediction."""
    text = normalize(prediction)
    return F.coalesce(F.exists(answers, lambda a: (normalize(a) != "") & text.contains(normalize(a))), F.lit(False))


def score_prediction(df: DataFrame, key: list[str]) -> DataFrame:
    """df (dataset, prediction, answers, all_classes) with score: the best over answers; null for an unknown task.

    Words are counted and joined for F1; the other scores are expressions of a row. Null predictions are empty ones, null
    or empty answers give 0; the shorter variant of a task (its name and `_e`) is scored like the task.
    """
    ship(df.sparkSession)
    name = task(F.col("dataset"))
    cut = F.when(name.isin(*FIRST_LINE), F.get(F.split(without_line_feeds(F.col("prediction")), "\n"), F.lit(0))).otherwise(F.col("prediction"))
    metric = F.element_at(F.create_map(*[F.lit(x) for kv in METRICS.items() for x in kv]), name)
    classes = F.coalesce("all_classes", F.when(name == "trec", F.array(*map(F.lit, TREC_CLASSES))))
    rows = df.withColumns({"text": F.coalesce(cut, F.lit("")), "metric": metric, "classes": classes})
    each = rows.select(*key, "metric", "text", "classes", F.posexplode("answers").alias("nth", "answer"))
    f1 = with_f1(each.filter("metric = 'f1'"), "text", "answer", [*key, "nth"], "s")
    other = each.filter("metric <> 'f1'").withColumn("s", F.when(F.col("metric") == "rouge", rouge_l(F.col("text"), F.col("answer"))).when(F.col("metric") == "class", classification(F.col("text"), F.col("answer"), F.col("classes"))).when(F.col("metric") == "retrieval", retrieval(F.col("text"), F.col("answer"))).when(F.col("metric") == "count", numbers_equal(F.col("text"), F.col("answer"))).otherwise(code_similarity(F.col("text"), F.col("answer"))))
    best = f1.select(*key, "s").unionByName(other.select(*key, "s")).groupBy(*key).agg(F.max("s").alias("s"))
    return rows.join(best, key, "left").withColumn("score", F.when(F.col("metric").isNotNull(), F.greatest(F.coalesce("s", F.lit(0.0)), F.lit(0.0)))).drop("s", "text", "metric", "classes")


def f1(prediction: Column, answer: Column) -> Column:
    """Bag F1 of normalized words as an expression of a row, for short answers."""
    a, b = tokens(normalize(prediction)), tokens(normalize(answer))
    times = lambda words, w: F.size(F.filter(words, lambda x: x == w))
    same = F.aggregate(F.transform(F.array_distinct(b), lambda w: F.least(times(a, w), times(b, w))), F.lit(0), lambda s, x: s + x)
    return F.when(F.size(a) + F.size(b) > 0, 2.0 * same / (F.size(a) + F.size(b))).otherwise(0.0)


def needle_scores(df: DataFrame) -> DataFrame:
    """df (prediction, answer, sentence) with whether and how far answer and needle sentence come back."""
    p = F.coalesce("prediction", F.lit(""))
    made = {}
    for name in ("answer", "sentence"):
        made |= {f"{name}_contains": contains_answer(p, F.array(name)), f"{name}_f1": f1(p, F.coalesce(name, F.lit("")))}
    return df.withColumns(made)


def backfill(df: DataFrame, tasks: DataFrame, key: list[str]) -> DataFrame:
    """Stored rows with score and category put in, whatever they had; unknown tasks get nulls."""
    scored = score_prediction(df.drop("score", "category"), key).withColumn("_task", task(F.col("dataset")))
    return scored.join(tasks.select(F.col("dataset").alias("_task"), "category"), "_task", "left").drop("_task")
