"""Prompt tables: templates and limits are dimension tables, text stays in SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tasks whose question carries a prefix, limits of new tokens, tasks without a chat form.
QUESTION_TASKS = ("narrativeqa", "qasper", "multifieldqa_en", "hotpotqa", "2wikimqa", "musique")
MAX_NEW_TOKENS = [("narrativeqa", 128), ("qasper", 128), ("multifieldqa_en", 64), ("hotpotqa", 32), ("2wikimqa", 32), ("musique", 32), ("gov_report", 512), ("qmsum", 512), ("multi_news", 512), ("trec", 64), ("triviaqa", 32), ("samsum", 128), ("passage_count", 32), ("passage_retrieval_en", 32), ("lcc", 64), ("repobench-p", 64)]
NO_CHAT = ("trec", "triviaqa", "samsum", "lcc", "repobench-p")


def task_name(task: Column, dataset: Column, fallback: str = "") -> Column:
    """First of task, dataset and fallback that isn't empty, without a closing `_e`."""
    return F.regexp_replace(F.coalesce(F.nullif(task, F.lit("")), F.nullif(dataset, F.lit("")), F.lit(fallback)), "_e$", "")


def input_text(value: Column, question: Column, task: Column) -> Column:
    """The input, or else the question without its prefix."""
    prefix = F.when(task.isin(*QUESTION_TASKS), F.regexp_replace(question, r"^\s*(?i)question:", "")).when(task == "qmsum", F.regexp_replace(question, r"^\s*(?i)query:", "")).otherwise(question)
    trimmed = F.when(task.isin(*QUESTION_TASKS, "qmsum"), F.regexp_replace(prefix, r"^\s+|\s+$", "")).otherwise(question)
    return F.coalesce(F.nullif(value, F.lit("")), trimmed, F.lit(""))


def build_prompt(df: DataFrame, templates: DataFrame) -> DataFrame:
    """df (dataset, context, input) with `prompt`; braces in the data are left alone, as slots are filled piece by piece.

    Templates (dataset, template) are a broadcast dimension of one row a task; a task without one has a null prompt.
    """
    pieces = F.split("template", r"(?=\{context\}|\{input\})|(?<=\{context\}|\{input\})")
    filled = F.transform(pieces, lambda p: F.when(p == "{context}", F.coalesce("context", F.lit(""))).when(p == "{input}", F.coalesce("input", F.lit(""))).otherwise(p))
    return df.join(F.broadcast(templates), "dataset", "left").withColumn("prompt", F.array_join(filled, "")).drop("template")


def generation_limits(df: DataFrame, spark, mode: str = "auto", default: int = 64) -> DataFrame:  # noqa: ANN001
    """df with max_new_tokens and use_chat."""
    if mode not in ("auto", "always", "never"):
        raise ValueError(f"unknown mode {mode}")
    limits = F.broadcast(spark.createDataFrame(MAX_NEW_TOKENS, "dataset string, max_new_tokens int"))
    chat = {"auto": ~F.col("dataset").isin(*NO_CHAT), "always": F.lit(True), "never": F.lit(False)}[mode]
    return df.join(limits, "dataset", "left").withColumn("max_new_tokens", F.coalesce("max_new_tokens", F.lit(default))).withColumn("use_chat", chat)


def plain_prompt(context: Column, question: Column) -> Column:
    """Context and question; a context that ends with the question isn't followed by it again."""
    return F.when(F.rtrim(context).endswith(F.rtrim(question)), context).otherwise(F.concat(context, F.lit("\n\n"), question))


def truncate_middle(words: Column, n: int) -> Column:
    """The first and last halves of n words; shorter lists stay."""
    return F.when(F.size(words) <= n, words).otherwise(F.concat(F.slice(words, 1, n // 2), F.slice(words, F.size(words) - (n - n // 2) + 1, n - n // 2)))


def needle_crop(words: Column, first: Column, length: Column, budget: int) -> Column:
    """`budget` words around the answer sentence (first word from 0, its length), kept inside the text.

    Without the sentence (null) the first `budget` words stay.
    """
    start = F.greatest(F.least(first - F.floor((F.lit(budget) - length) / 2), F.size(words) - budget), F.lit(0))
    return F.when(F.size(words) <= budget, words).otherwise(F.slice(words, (F.coalesce(start, F.lit(0)) + 1).cast("int"), budget))


def find_words(words: Column, sentence: Column) -> Column:
    """Where the sentence's words start in a list of words, from 0; null if nowhere."""
    spots = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - F.size(sentence), F.lit(0))), lambda i: F.slice(words, i + 1, F.greatest(F.size(sentence), F.lit(1))) == sentence)
    return F.get(spots, F.lit(0))


def crop_prompt(body: Column, tail: Column, sentence: Column, target: Column) -> Column:
    """Words of a prompt cut to `target` of them: the tail (the question) stays whole, the body keeps what is around the
    answer sentence.

    A prompt that is short enough stays. Without a sentence the body's beginning is kept, with one that isn't in the body
    its middle; a sentence longer than what is left for the body is cut itself. One word of the body stays at least.
    """
    n, m = F.size(body), F.size(sentence)
    room = F.greatest(target - F.size(tail), F.lit(1))
    at = find_words(body, sentence)
    begin = F.when(m == 0, 0).when(at.isNull(), F.floor(n / 2) - F.floor(room / 2)).when(m >= room, at).otherwise(at - F.floor((room - m) / 2))
    begin = F.greatest(F.least(begin, n - room), F.lit(0)).cast("int")
    return F.when(n + F.size(tail) <= target, F.concat(body, tail)).otherwise(F.concat(F.slice(body, begin + 1, room), tail))
