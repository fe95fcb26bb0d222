"""Queries of reports over runs: scores of needles, stored and rescored rows, manifests, coverage, the whole rule search."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..operators import gates as G
from ..operators import prompts as P
from ..operators import results as R
from ..operators import scoring as S
from ..sources import tables as T
from . import stream_queries as W
from . import tabular as B
from . import text_queries as Q

QUERIES, ORACLE_SQL = {}, {}


def _add(name: str, query, sql: str | None = None) -> None:  # noqa: ANN001
    QUERIES[name] = query
    if sql is not None:
        ORACLE_SQL[name] = sql


def _f1_sql(p: str, g: str) -> str:
    """F1 of two normalized texts as a DuckDB expression."""
    p, g = Q._TOK.format(p), Q._TOK.format(g)
    return f"CASE WHEN len({p}) + len({g}) > 0 THEN 2.0 * coalesce(list_sum(list_transform(list_distinct({g}), lambda w: least(len(list_filter({p}, lambda x: x = w)), len(list_filter({g}, lambda x: x = w))))), 0) / (len({p}) + len({g})) ELSE 0 END"


def _needles(s, d):  # noqa: ANN001, ANN202
    rows = Q._pairs(s, d).withColumns({"answer": F.substring("asked", 1, 24), "sentence": F.substring("prediction", 5, 40)})
    return S.needle_scores(rows).select("conv_id", "turn", "answer_contains", "sentence_contains", *(F.round(c, 6).alias(c) for c in ("answer_f1", "sentence_f1")))


_N = {"p": Q._norm("prediction"), "a": Q._norm("substr(asked, 1, 24)"), "s": Q._norm("substr(prediction, 5, 40)")}
_add("needle_scores", _needles, f"""WITH {Q._PAIRS}, t AS (SELECT conv_id, turn, {_N['p']} AS p, {_N['a']} AS a, {_N['s']} AS s FROM pairs)
SELECT conv_id, turn, a <> '' AND contains(p, a) AS answer_contains, s <> '' AND contains(p, s) AS sentence_contains, round({_f1_sql('p', 'a')}, 6) AS answer_f1, round({_f1_sql('p', 's')}, 6) AS sentence_f1 FROM t""")
_F1_TASKS = ("hotpotqa", "qasper", "musique", "unknown")


def _stored(s, d):  # noqa: ANN001, ANN202
    names = F.array(*[F.lit(x) for x in _F1_TASKS])
    return Q._pairs(s, d).select("conv_id", "turn", F.element_at(names, (F.col("conv_id") % 4 + 1).cast("int")).alias("dataset"), "prediction", F.array("asked", F.substring("prediction", 1, 40)).alias("answers"), F.lit(None).cast("array<string>").alias("all_classes"), F.lit(-1.0).alias("score"))


_STORED = f"""stored AS (SELECT conv_id, turn, {list(_F1_TASKS)}[conv_id % 4 + 1] AS dataset, {Q._norm('prediction')} AS p, {Q._norm('asked')} AS a, {Q._norm('substr(prediction, 1, 40)')} AS b FROM pairs),
scored AS (SELECT conv_id, turn, dataset, CASE WHEN dataset <> 'unknown' THEN greatest({_f1_sql('p', 'a')}, {_f1_sql('p', 'b')}) END AS score FROM stored)"""
_add("backfill_scores", lambda s, d: S.backfill(_stored(s, d), X.tasks(s), ["conv_id", "turn"]).select("conv_id", "turn", "dataset", "category", F.round("score", 6).alias("score")),
     f"WITH {Q._PAIRS}, {X.TASKS_CTE}, {_STORED} SELECT conv_id, turn, dataset, category, round(score, 6) AS score FROM scored LEFT JOIN tasks USING (dataset)")


def _rescored(s, d):  # noqa: ANN001, ANN202
    """Stored predictions of several runs as JSON files, rescored in one job."""
    folder = W._folder(s)
    rows = _stored(s, d).withColumn("answer", F.get("answers", F.lit(0)))
    for run in range(2):
        T.write_results(rows.filter(F.col("conv_id") % 2 == run).select("dataset", "prediction", "answer"), f"{folder}/run{run}")
    held = s.read.schema("dataset string, prediction string, answer string").json([f"{folder}/run{run}" for run in range(2)])
    return R.rescore_files(held, S.f1(F.col("prediction"), F.col("answer"))).withColumn("score", F.round("score", 6))


_add("bulk_rescore", _rescored, f"WITH {Q._PAIRS}, {_STORED} SELECT 'run' || conv_id % 2 AS run, count(*) AS n, round(avg({_f1_sql('p', 'a')}), 6) AS score FROM stored GROUP BY 1")
_add("gate_code_passthrough", lambda s, d: G.code_passthrough(B._base(s, d)), B._with(X.RESULTS_CTE) + "SELECT dataset, index, score, false AS active, 'base' AS origin, 'code' AS reason FROM results WHERE method = 'base' AND bits = 2.5 AND code_like")
_RUNS = [("base", 2.5), ("base", 3.5), ("variant", 2.5), ("other", 3.0)]
_add("run_manifest", lambda s, d: R.run_manifest(X.results(s, d), X.tasks(s), s.createDataFrame(_RUNS, "method string, bits double")), B._with(X.TASKS_CTE, X.RESULTS_CTE, "runs(method, bits) AS (VALUES " + ", ".join(f"('{m}', {b}::DOUBLE)" for m, b in _RUNS) + ")")
     + """SELECT method, bits, dataset, coalesce(n, 0) AS n, expected, CASE WHEN coalesce(n, 0) >= expected THEN 'done' WHEN n > 0 THEN 'resume' ELSE 'start' END AS state, coalesce(last, -1) + 1 AS next_index
    FROM runs CROSS JOIN tasks LEFT JOIN (SELECT method, bits, dataset, count(DISTINCT index) AS n, max(index) AS last FROM results GROUP BY ALL) USING (method, bits, dataset)""")
_add("task_coverage", lambda s, d: R.coverage(X.results(s, d).filter("prompt_tokens % 5 <> 0 and dataset not in ('trec', 'lcc')"), X.tasks(s)), B._with(X.TASKS_CTE, X.RESULTS_CTE) + "SELECT category, dataset, CASE WHEN dataset IN (SELECT dataset FROM results WHERE prompt_tokens % 5 <> 0 AND dataset NOT IN ('trec', 'lcc')) THEN 'available' ELSE 'missing' END AS state FROM tasks")
_FEATURES = ("prompt_tokens", "passage_count", "question_marks")
_add("scored_feature_profile", lambda s, d: G.feature_profile(B._base(s, d).drop("score"), B._variant(s, d), list(_FEATURES), ["dataset", "index"]).withColumn("score", F.round("score", 6)),
     B._with(X.RESULTS_CTE) + "SELECT dataset, count(*) AS n, count(v.score) AS n_scored, round(avg(v.score), 6) AS score, " + ", ".join(f"CAST({n}(b.{c}) AS DOUBLE) AS {n}_{c}" for c in _FEATURES for n in ("avg", "min", "max"))
     + " FROM (SELECT * FROM results WHERE method = 'base' AND bits = 2.5) b LEFT JOIN (SELECT dataset, index, score FROM results WHERE method = 'variant' AND bits = 2.5) v USING (dataset, index) GROUP BY 1")
_WHOLE = ([50, 100, 200, 400, 800, 1200, 1600, 2400, 3200, 4800], [2, 5, 8, 11, 15, 20, 24, None], [10, 30, 50, 70, 90, 110, 129])
_add("gate_search_whole", lambda s, d: G.gate_search(X.results(s, d), X.tasks(s), G.rule_grid(s, *_WHOLE), 50).select("rule", *(F.round(c, 6).alias(c) for c in ("least_gain", "best_gain", "activation"))),
     B._with(X.TASKS_CTE, X.RESULTS_CTE, B._PAIRS, f"t AS (SELECT unnest({_WHOLE[0]}) AS t, unnest(range(10)) AS i), p AS (SELECT unnest({_WHOLE[1][:-1]} || [NULL]) AS p, unnest(range(8)) AS j), q AS (SELECT unnest({_WHOLE[2]}) AS q, unnest(range(7)) AS k)")
     + """SELECT rule, round(least_gain, 6) AS least_gain, round(best_gain, 6) AS best_gain, round(activation, 6) AS activation FROM (
    SELECT rule, min(gain) AS least_gain, max(gain) AS best_gain, avg(active) AS activation FROM (SELECT rule, bits, avg(gain) AS gain, avg(active) AS active FROM (
      SELECT rule, bits, category, avg(gain) AS gain, avg(active) AS active FROM (
        SELECT rule, bits, category, dataset, avg(CASE WHEN holds THEN variant_score - score ELSE 0 END) AS gain, avg(holds::INT) AS active FROM (
          SELECT *, CAST(i * 56 + j * 7 + k AS INT) AS rule, prompt_tokens > t AND NOT code_like AND CASE WHEN p IS NULL THEN passage_count = 0 OR question_marks <= q ELSE (passage_count = 0 OR passage_count <= p) AND question_marks <= q END AS holds FROM pairs JOIN tasks USING (dataset), t, p, q)
        GROUP BY ALL) GROUP BY ALL) GROUP BY ALL) GROUP BY rule) rules WHERE rules.least_gain > 0 ORDER BY round(rules.least_gain, 9) DESC, round(rules.best_gain, 9) DESC, rule LIMIT 50""")


def _named(s, d):  # noqa: ANN001, ANN202
    rows = X.table(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat("lang", F.lit("_e"))).alias("task"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("dataset"))
    return rows.select("doc_id", P.task_name(F.col("task"), F.col("dataset"), "unnamed_e").alias("name"))


_add("task_names", _named, "SELECT doc_id, regexp_replace(coalesce(CASE WHEN doc_id % 3 = 0 THEN lang || '_e' END, CASE WHEN doc_id % 2 = 0 THEN source END, 'unnamed_e'), '_e$', '') AS name FROM documents")
_TAIL = ["Question:", "which", "one", "is", "it?"]


def _cropped(s, d):  # noqa: ANN001, ANN202
    """Documents as prompt bodies at two lengths; a third each has a sentence of its own, one it lacks, and none."""
    w = X.table(s, d, "documents").select("doc_id", F.filter(F.split("text", " "), lambda x: x != "").alias("w"))
    none = F.array().cast("array<string>")
    sentence = F.when((F.col("doc_id") % 3 == 0) & (F.size("w") > 30), F.slice("w", 21, 6)).when(F.col("doc_id") % 3 == 1, F.array(F.lit("nowhere"), F.lit("there"))).otherwise(none)
    rows = w.withColumn("sentence", sentence).withColumn("target", F.explode(F.array(F.lit(24), F.lit(60))))
    return rows.withColumn("kept", P.crop_prompt(F.col("w"), F.array(*map(F.lit, _TAIL)), F.col("sentence"), F.col("target")))


_CROPPED = f"""w AS (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM documents),
x AS (SELECT doc_id, w, t, {_TAIL} AS tail, CASE WHEN doc_id % 3 = 0 AND len(w) > 30 THEN w[21:26] WHEN doc_id % 3 = 1 THEN ['nowhere', 'there'] ELSE [] END AS s FROM w, (SELECT unnest([24, 60]) AS t)),
r AS (SELECT *, greatest(t - len(tail), 1) AS room, CASE WHEN len(s) > 0 THEN list_filter(range(0, greatest(len(w) - len(s), 0) + 1), lambda i: w[i + 1:i + len(s)] = s)[1] END AS hit FROM x),
b AS (SELECT *, greatest(least(CASE WHEN len(s) = 0 THEN 0 WHEN hit IS NULL THEN len(w) // 2 - room // 2 WHEN len(s) >= room THEN hit ELSE hit - (room - len(s)) // 2 END, len(w) - room), 0) AS bg FROM r),
cropped AS (SELECT doc_id, t, CASE WHEN len(w) + len(tail) <= t THEN w || tail ELSE w[bg + 1:bg + room] || tail END AS kept FROM b)"""
_add("needle_prompts", lambda s, d: _cropped(s, d).select(F.concat("doc_id", F.lit(":target"), "target").alias("id"), F.size("kept").cast("long").alias("n"), F.md5(F.array_join("kept", " ")).alias("kept")),
     f"WITH {_CROPPED} SELECT doc_id || ':target' || t AS id, len(kept) AS n, md5(array_to_string(kept, ' ')) AS kept FROM cropped")
_add("needle_prompt_lengths", lambda s, d: _cropped(s, d).groupBy("target").agg(F.count("*").alias("n"), F.min(F.size("kept")).cast("long").alias("least"), F.max(F.size("kept")).cast("long").alias("most"), F.round(F.avg(F.size("kept")), 6).alias("mean")),
     f"WITH {_CROPPED} SELECT CAST(t AS INT) AS target, count(*) AS n, min(len(kept)) AS least, max(len(kept)) AS most, round(avg(len(kept)), 6) AS mean FROM cropped GROUP BY 1")
