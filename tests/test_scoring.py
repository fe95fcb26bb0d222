"""Scores of single predictions against values worked out by hand, and of many against a plain Python version."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from vqspark.operators import scoring as S

SCHEMA = "id long, dataset string, prediction string, answers array<string>, all_classes array<string>"
CASES = [
    ("lcc", "\n\nreturn x + 1\nfoo", ["return x + 1"], None, 1.0),
    ("lcc", "# note\n// more\n`code`\nreturn x", ["return x"], None, 1.0),
    ("lcc", "# note only", ["return x"], None, 0.0),
    ("lcc_e", "return x", ["return y"], None, 0.88),
    ("repobench-p", "abc", ["xyz", "abd"], None, 0.67),
    ("trec", "\n\nEntity\nAnimal", ["Entity"], ["Entity", "Animal"], 1.0),
    ("trec", "Other location", ["Other location"], None, 1.0),
    ("trec", "Sport and Color", ["Sport"], None, 0.5),
    ("lsht", "\nA\nB", ["B"], ["A", "B"], 0.0),
    ("triviaqa", "\nthe Blue Whale\nand more", ["blue whale!"], None, 1.0),
    ("samsum", "a b c\nx y z", ["a b c"], None, 1.0),
    ("gov_report", "a b c\nx y z", ["a b c"], None, 2 * 3 / 9),
    ("gov_report", "", ["a"], None, 0.0),
    ("passage_count", "3 or 4", ["3"], None, 0.5),
    ("passage_retrieval_en", "Paragraph 7", ["Paragraph 7"], None, 1.0),
    ("hotpotqa", None, ["a word"], None, 0.0),
    ("hotpotqa", "word", [], None, 0.0),
    ("unknown", "word", ["word"], None, None),
]


def test_scores_by_hand(spark):
    rows = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(CASES)], SCHEMA)
    got = {r.id: r.score for r in S.score_prediction(rows, ["id"]).collect()}
    for i, case in enumerate(CASES):
        assert got[i] == (pytest.approx(case[4]) if case[4] is not None else None), case


def test_an_empty_table_and_columns_of_clashing_names(spark):
    rows = spark.createDataFrame([(1, "lcc", "x", ["x"], None)], SCHEMA).withColumn("score", F.lit(0.5)).withColumn("s", F.lit(1))
    assert S.score_prediction(rows.drop("score", "s").limit(0), ["id"]).collect() == []
    assert S.backfill(rows.drop("s"), spark.createDataFrame([("lcc", "Code")], "dataset string, category string"), ["id"]).select("score", "category").collect() == [(1.0, "Code")]


def test_common_subsequence_of_random_lists(spark):
    random.seed(3)
    pairs = [("".join(random.choice("abcd") for _ in range(random.randrange(40))), "".join(random.choice("abcd") for _ in range(random.randrange(40)))) for _ in range(200)]

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", S.code_similarity(F.col("a"), F.col("b")).alias("s"))
    for a, b, s in rows.collect():
        assert s == pytest.approx(round(200 * plain(a, b) / (len(a) + len(b))) / 100 if a or b else 0.0, abs=0.0100001)
        assert s + 0.0051 >= difflib.SequenceMatcher(None, a, b).ratio() or not (a or b)
