"""Queries over evaluation rows: sources, gates, results, needle runs; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..operators import gates as G
from ..operators import results as R
from ..sources import tables as S

QUERIES, ORACLE_SQL = {}, {}


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _add(name: str, query, sql: str) -> None:  # noqa: ANN001
    QUERIES[name], ORACLE_SQL[name] = query, sql


def _base(s, d, bits=2.5):  # noqa: ANN001, ANN202
    return X.results(s, d).filter(f"method = 'base' and bits = {bits}")


def _variant(s, d, bits=2.5):  # noqa: ANN001, ANN202
    return X.results(s, d).filter(f"method = 'variant' and bits = {bits}")


def _rule() -> F.Column:
    """A function, as columns can be made in a session only and this module is imported without one."""
    return G.gate(300, 20000, 15, 80)


RULE_SQL = "(prompt_tokens > 300 AND NOT code_like AND prompt_tokens <= 20000 AND (passage_count = 0 OR passage_count <= 15) AND question_marks <= 80)"
LOOSE_SQL = "(prompt_tokens > 300 AND NOT code_like AND (passage_count = 0 OR question_marks <= 80))"

_add("read_vectors", lambda s, d: S.read_vectors(X.table(s, d, "embeddings").sparkSession, f"{d}/embeddings.parquet", "embedding").select("vec_id", F.size("vec").alias("dim"), F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total")),
     "SELECT vec_id, CAST(len(embedding) AS INT) AS dim, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM embeddings")


def _split(s, d):  # noqa: ANN001, ANN202
    db, q = S.split_database_queries(X.table(s, d, "embeddings").select("vec_id"), "vec_id", 400, 50)
    return db.withColumn("part", F.lit("database")).unionByName(q.withColumn("part", F.lit("query")))


_add("split_database_queries", _split, "SELECT vec_id, CASE WHEN n <= 400 THEN 'database' ELSE 'query' END AS part FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS n FROM embeddings) WHERE n <= 450")
_add("eval_rows", lambda s, d: S.read_eval_rows(X.table(s, d, "documents").sparkSession, [f"{d}/documents.parquet", f"{d}/benchmark.parquet"]).select("doc_id", "item_id", F.length("text").cast("long").alias("chars")),
     "SELECT doc_id, CAST(NULL AS BIGINT) AS item_id, length(text) AS chars FROM documents UNION ALL SELECT NULL, item_id, length(text) FROM benchmark")
_add("slice_by_index", lambda s, d: S.slice_by_index(_base(s, d), 5, 40, 20).select("dataset", "index", "score"), _with(X.RESULTS_CTE) + "SELECT dataset, index, score FROM results WHERE method = 'base' AND bits = 2.5 AND index >= 5 AND index < 25")


def _shards(s, d):  # noqa: ANN001, ANN202
    rows = X.table(s, d, "documents").select((F.col("doc_id") % 500).alias("index"), F.col("doc_id").alias("line"), "n_chars", "lang")
    return S.merge_shards([rows.filter("doc_id % 3 <> 0"), rows.filter("doc_id % 3 = 0")])


_add("merge_shards", _shards, "SELECT doc_id % 500 AS index, arg_max(n_chars, (doc_id % 3 = 0)::INT * 1000000000 + doc_id) AS n_chars, arg_max(lang, (doc_id % 3 = 0)::INT * 1000000000 + doc_id) AS lang FROM documents GROUP BY 1")
_add("duplicate_report", lambda s, d: S.duplicate_report(X.table(s, d, "labels").select((F.col("doc_id") % 211).alias("index"))), "SELECT doc_id % 211 AS index, count(*) AS n FROM labels GROUP BY 1 HAVING count(*) > 1")
def _missing(s, d):  # noqa: ANN001, ANN202
    """Ids without labels in the range of all documents' ids."""
    first, last = X.table(s, d, "documents").agg(F.min("doc_id"), F.max("doc_id")).first()
    return S.missing_report(X.table(s, d, "labels").select(F.col("doc_id").alias("index")), first or 0, 0 if last is None else last + 1)


_add("missing_report", _missing, "SELECT r AS index FROM (SELECT unnest(range(min(doc_id), max(doc_id) + 1)) AS r FROM documents) WHERE r NOT IN (SELECT doc_id FROM labels)")
_add("pending", lambda s, d: S.pending(X.table(s, d, "documents").select(F.col("doc_id").alias("index"), "source"), X.table(s, d, "labels").select(F.col("doc_id").alias("index"))), "SELECT doc_id AS index, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
_add("stratified_head", lambda s, d: S.stratified_head(X.needle(s, d), ["needle_position", "distractor_lang"], 3, {"needle_position": X.POSITIONS}).select("needle_position", "distractor_lang", "index"),
     _with(X.NEEDLE_CTE) + "SELECT needle_position, distractor_lang, index FROM (SELECT *, row_number() OVER (PARTITION BY needle_position, distractor_lang ORDER BY index) AS n FROM needle WHERE needle_position <> 'other') WHERE n <= 3")
_add("cell_coverage", lambda s, d: S.cell_coverage(X.needle(s, d), {"needle_position": [*X.POSITIONS, "nowhere"], "distractor_lang": X.LANGS}, 40).select("needle_position", "distractor_lang", "available", F.col("selected").cast("long").alias("selected"), F.col("short").cast("long").alias("short")),
     _with(X.NEEDLE_CTE) + f"""SELECT p AS needle_position, l AS distractor_lang, count(index) AS available, least(count(index), 40) AS selected, 40 - least(count(index), 40) AS short
     FROM (SELECT unnest({[*X.POSITIONS, 'nowhere']}) AS p), (SELECT unnest({X.LANGS}) AS l) LEFT JOIN needle ON needle_position = p AND distractor_lang = l GROUP BY 1, 2""")
_add("prompt_features", lambda s, d: G.prompt_features(X.table(s, d, "documents"), "text").select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("passage_count", "question_marks", "chars", "newlines", "sentences")), F.round("capitalized_ratio", 6).alias("capitalized_ratio"), F.round("avg_passage_chars", 6).alias("avg_passage_chars")),
     r"""SELECT doc_id, len(regexp_extract_all(lower(text), '\bpassage\s+\d+\s*:')) AS passage_count, length(text) - length(replace(text, '?', '')) AS question_marks, length(text) AS chars,
     length(text) - length(replace(text, chr(10), '')) AS newlines, len(regexp_extract_all(text, '[.!?]')) AS sentences,
     round(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: regexp_matches(w, '^[A-Z]'))) / greatest(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')), 1), 6) AS capitalized_ratio,
     round(length(text) / greatest(len(regexp_extract_all(lower(text), '\bpassage\s+\d+\s*:')), 1), 6) AS avg_passage_chars FROM documents""")
_add("route_gate", lambda s, d: G.route(_base(s, d), _rule(), "regular_gain_mse", "mse").select("dataset", "index", "effective_kind"), _with(X.RESULTS_CTE) + f"SELECT dataset, index, CASE WHEN {RULE_SQL} THEN 'regular_gain_mse' ELSE 'mse' END AS effective_kind FROM results WHERE method = 'base' AND bits = 2.5")
_add("route_gate_passages", lambda s, d: G.route(_base(s, d), G.gate(300, None, None, 80, True), "a", "b").groupBy("dataset", "effective_kind").agg(F.count("*").alias("n")), _with(X.RESULTS_CTE) + f"SELECT dataset, CASE WHEN {LOOSE_SQL} THEN 'a' ELSE 'b' END AS effective_kind, count(*) AS n FROM results WHERE method = 'base' AND bits = 2.5 GROUP BY 1, 2")
_add("code_prompts", lambda s, d: X.table(s, d, "documents").select("doc_id", G.code_prompt(F.col("source"), F.col("text"), ("licensed under",), ("the ", "License", "Version")).alias("is_code")),
     "SELECT doc_id, source IN ('lcc', 'repobench-p') OR contains(substr(lower(text), 1, 2048), 'licensed under') OR (contains(lower(text), 'licensed under') AND contains(text, 'the ')::INT + contains(text, 'License')::INT + contains(text, 'Version')::INT >= 3) AS is_code FROM documents")
_add("feature_profile", lambda s, d: _base(s, d).groupBy("dataset").agg(*(f(c).cast("double").alias(f"{n}_{c}") for c in ("prompt_tokens", "passage_count") for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max)))),
     _with(X.RESULTS_CTE) + "SELECT dataset, " + ", ".join(f"CAST({n}({c}) AS DOUBLE) AS {n}_{c}" for c in ("prompt_tokens", "passage_count") for n in ("avg", "min", "max")) + " FROM results WHERE method = 'base' AND bits = 2.5 GROUP BY 1")
_ROUNDED = ("prompt_tokens", "latency", "ratio", "score", "accuracy")
_add("run_summary", lambda s, d: R.run_summary(_base(s, d), X.tasks(s)).select("level", "name", "n", *(F.round(c, 6).alias(c) for c in _ROUNDED)),
     _with(X.TASKS_CTE, X.RESULTS_CTE) + """SELECT CASE WHEN grouping(dataset) = 0 THEN 'dataset' WHEN grouping(category) = 0 THEN 'category' ELSE 'all' END AS level, coalesce(dataset, category, 'all') AS name, count(*) AS n,
     round(avg(prompt_tokens), 6) AS prompt_tokens, round(avg(latency), 6) AS latency, round(avg(ratio), 6) AS ratio, round(100 * avg(score), 6) AS score, round(avg((score >= 0.5)::INT), 6) AS accuracy
     FROM results JOIN tasks USING (dataset) WHERE method = 'base' AND bits = 2.5 GROUP BY GROUPING SETS ((), (dataset), (category))""")
_add("slice_summary", lambda s, d: R.run_summary(S.slice_by_index(_base(s, d), 0, 30), X.tasks(s)).filter("level = 'category'").select("name", "n", F.round("score", 6).alias("score")),
     _with(X.TASKS_CTE, X.RESULTS_CTE) + "SELECT category AS name, count(*) AS n, round(100 * avg(score), 6) AS score FROM results JOIN tasks USING (dataset) WHERE method = 'base' AND bits = 2.5 AND index < 30 GROUP BY 1")
_MACRO = "per_task AS (SELECT method, bits, category, dataset, avg(score) AS score FROM results JOIN tasks USING (dataset) GROUP BY ALL), per_category AS (SELECT method, bits, category, 100 * avg(score) AS score, count(*) AS n_tasks FROM per_task GROUP BY ALL)"
_add("category_macro", lambda s, d: R.category_table(X.results(s, d), X.tasks(s)).withColumn("score", F.round("score", 6)),
     _with(X.TASKS_CTE, X.RESULTS_CTE, _MACRO) + "SELECT method, bits, category, round(score, 6) AS score, n_tasks FROM per_category UNION ALL SELECT method, bits, 'Average', round(avg(score), 6), CAST(sum(n_tasks) AS BIGINT) FROM per_category GROUP BY 1, 2")
_PAIRS = "pairs AS (SELECT b.*, v.score AS variant_score FROM results b JOIN results v USING (dataset, index, bits) WHERE b.method = 'base' AND v.method = 'variant')"


def _compare_sql(on: str) -> str:
    return _with(X.TASKS_CTE, X.RESULTS_CTE, _PAIRS) + f"""SELECT bits, dataset, category, expected, round(base, 6) AS base, round(candidate, 6) AS candidate, round(activation, 6) AS activation, n,
    round(candidate - base, 6) AS delta, round(candidate / base, 6) AS relative, n = expected AS complete
    FROM (SELECT bits, dataset, 100 * avg(score) AS base, 100 * avg(CASE WHEN {on} THEN variant_score ELSE score END) AS candidate, avg(({on})::INT) AS activation, count(DISTINCT index) AS n FROM pairs GROUP BY 1, 2) JOIN tasks USING (dataset)"""


def _compare(s, d, active=None):  # noqa: ANN001, ANN202
    out = R.method_comparison(G.paired(X.results(s, d)), X.tasks(s), active)
    return out.select("bits", "dataset", "category", "expected", *(F.round(c, 6).alias(c) for c in ("base", "candidate", "activation")), "n", *(F.round(c, 6).alias(c) for c in ("delta", "relative")), "complete")


_add("method_delta", _compare, _compare_sql("true"))
_add("gated_comparison", lambda s, d: _compare(s, d, _rule()), _compare_sql(RULE_SQL))
_add("content_adaptive_comparison", lambda s, d: _compare(s, d, G.gate(300, None, None, 80, True)), _compare_sql(LOOSE_SQL))
_add("mismatched_indexes", lambda s, d: R.mismatched_indexes(X.results(s, d).filter("method = 'base'"), X.results(s, d).filter("method = 'variant'")),
     _with(X.RESULTS_CTE) + "SELECT dataset, index, bits, a IS NOT NULL AS in_base FROM (SELECT DISTINCT dataset, index, bits, 1 AS a FROM results WHERE method = 'base') FULL JOIN (SELECT DISTINCT dataset, index, bits, 1 AS b FROM results WHERE method = 'variant') USING (dataset, index, bits) WHERE a IS NULL OR b IS NULL")


def _official(s, d):  # noqa: ANN001, ANN202
    few = X.tasks(s).withColumn("expected", F.when(F.col("dataset") == "trec", 62).otherwise(F.floor(F.lit(1000) / 16) + (F.col("dataset").isin(*[t[0] for t in X.TASKS[:8]])).cast("int")).cast("long"))
    published = s.createDataFrame([("base", 2.5, "SingleQA", 44.16), ("base", 2.5, "Code", 59.0)], "method string, bits double, category string, score double")
    return R.official_comparison(X.results(s, d), few, published).select("method", "bits", "category", F.round("score", 6).alias("score"), "origin")


_add("official_comparison", _official, _with(X.TASKS_CTE, X.RESULTS_CTE) + f"""SELECT method, bits, category, round(CASE WHEN bool_and(coalesce(n = want, false)) THEN avg(score) END, 6) AS score, 'local' AS origin
    FROM (SELECT DISTINCT method, bits FROM results) CROSS JOIN (SELECT category, dataset, CASE WHEN dataset = 'trec' THEN 62 ELSE 62 + (dataset IN {tuple(t[0] for t in X.TASKS[:8])})::INT END AS want FROM tasks)
    LEFT JOIN (SELECT method, bits, dataset, count(DISTINCT index) AS n, 100 * avg(score) AS score FROM results GROUP BY ALL) USING (method, bits, dataset) GROUP BY 1, 2, 3
    UNION ALL SELECT * FROM (VALUES ('base', 2.5, 'SingleQA', 44.16, 'published'), ('base', 2.5, 'Code', 59.0, 'published'))""")
_add("best_source", lambda s, d: R.best_source(X.results(s, d).withColumnRenamed("method", "source"), X.tasks(s)),
     _with(X.TASKS_CTE, X.RESULTS_CTE) + "SELECT bits, dataset, source, n FROM (SELECT *, row_number() OVER (PARTITION BY bits, dataset ORDER BY (n = expected) DESC, n DESC, source) AS r FROM (SELECT method AS source, bits, dataset, count(DISTINCT index) AS n FROM results GROUP BY ALL) JOIN tasks USING (dataset)) WHERE r = 1")
_GRID = ([100, 1000, 3000], [5, 15, 24], [40, 80, 129])
_add("gate_search", lambda s, d: G.gate_search(X.results(s, d), X.tasks(s), G.rule_grid(s, *_GRID)).select("rule", *(F.round(c, 6).alias(c) for c in ("least_gain", "best_gain", "activation"))),
     _with(X.TASKS_CTE, X.RESULTS_CTE, _PAIRS) + f"""SELECT rule, round(least_gain, 6) AS least_gain, round(best_gain, 6) AS best_gain, round(activation, 6) AS activation FROM (
    SELECT rule, min(gain) AS least_gain, max(gain) AS best_gain, avg(active) AS activation FROM (SELECT rule, bits, avg(gain) AS gain, avg(active) AS active FROM (
      SELECT rule, bits, category, avg(gain) AS gain, avg(active) AS active FROM (
        SELECT rule, bits, category, dataset, avg(CASE WHEN holds THEN variant_score - score ELSE 0 END) AS gain, avg(holds::INT) AS active FROM (
          SELECT *, prompt_tokens > t AND NOT code_like AND (passage_count = 0 OR passage_count <= p) AND question_marks <= q AS holds FROM pairs JOIN tasks USING (dataset),
            (SELECT CAST(row_number() OVER (ORDER BY t, p, q) - 1 AS INT) AS rule, t, p, q FROM (SELECT unnest({_GRID[0]}) AS t), (SELECT unnest({_GRID[1]}) AS p), (SELECT unnest({_GRID[2]}) AS q)))
        GROUP BY ALL) GROUP BY ALL) GROUP BY ALL) GROUP BY rule) rules WHERE rules.least_gain > 0 ORDER BY round(rules.least_gain, 9) DESC, round(rules.best_gain, 9) DESC, rule LIMIT 20""")
_add("materialize_gate", lambda s, d: G.materialize_gate(_base(s, d), _variant(s, d), _rule()), _with(X.RESULTS_CTE) + f"""SELECT b.dataset, b.index, {RULE_SQL} AS active, CASE WHEN {RULE_SQL} THEN v.vs ELSE b.score END AS score,
    CASE WHEN {RULE_SQL} THEN 'variant' ELSE 'base' END AS origin, {RULE_SQL} AND v.vs IS NULL AS missing
    FROM results b LEFT JOIN (SELECT dataset, index, score AS vs FROM results WHERE method = 'variant' AND bits = 2.5) v USING (dataset, index) WHERE b.method = 'base' AND b.bits = 2.5""")
_add("prefill_inactive", lambda s, d: G.prefill_inactive(_variant(s, d).filter("index % 3 = 0"), _base(s, d), _rule()), _with(X.RESULTS_CTE) + f"""SELECT dataset, index, score, 'existing' AS origin FROM results WHERE method = 'variant' AND bits = 2.5 AND index % 3 = 0
    UNION ALL SELECT dataset, index, score, 'base' FROM results b WHERE method = 'base' AND bits = 2.5 AND NOT {RULE_SQL} AND NOT EXISTS (SELECT 1 FROM results v WHERE v.method = 'variant' AND v.bits = 2.5 AND v.index % 3 = 0 AND v.dataset = b.dataset AND v.index = b.index)""")
_add("verify_existing", lambda s, d: G.verify_existing(_base(s, d), _variant(s, d)), _with(X.RESULTS_CTE, _PAIRS) + "SELECT dataset, index, score AS made, variant_score AS held FROM pairs WHERE bits = 2.5 AND abs(score - variant_score) > 1e-9")
_add("task_progress", lambda s, d: R.task_progress(X.results(s, d), X.tasks(s)).withColumn("score", F.round("score", 6)), _with(X.TASKS_CTE, X.RESULTS_CTE) + """SELECT method, bits, dataset, coalesce(n, 0) AS n, expected, CASE WHEN coalesce(n, 0) >= expected THEN 'complete' WHEN n > 0 THEN 'partial' ELSE 'missing' END AS state,
    round(CASE WHEN n >= expected THEN score END, 6) AS score FROM (SELECT DISTINCT method, bits FROM results) CROSS JOIN tasks LEFT JOIN (SELECT method, bits, dataset, count(DISTINCT index) AS n, 100 * avg(score) AS score FROM results GROUP BY ALL) USING (method, bits, dataset)""")
_add("output_audit", lambda s, d: R.output_audit(X.results(s, d), X.tasks(s)), _with(X.TASKS_CTE, X.RESULTS_CTE) + """SELECT method, bits, dataset, coalesce(n_unique, 0) AS n_unique, coalesce(n_rows, 0) AS n_rows, expected
    FROM (SELECT DISTINCT method, bits FROM results) CROSS JOIN tasks LEFT JOIN (SELECT method, bits, dataset, count(DISTINCT index) AS n_unique, count(*) AS n_rows FROM results GROUP BY ALL) USING (method, bits, dataset) WHERE coalesce(n_unique, 0) <> expected OR n_unique <> n_rows""")
_NEEDLE = "count(*) AS n, avg(answer_contains::INT) AS accuracy"
_add("needle_grouping_sets", lambda s, d: R.needle_summary(X.needle(s, d)).select("needle_position", "distractor_lang", "target_prompt_tokens", F.col("level").cast("long").alias("level"), "n", *(F.round(c, 6).alias(c) for c in ("accuracy", "latency", "prompt_tokens"))),
     _with(X.NEEDLE_CTE) + """SELECT needle_position, distractor_lang, target_prompt_tokens, CAST(grouping(needle_position) * 4 + grouping(distractor_lang) * 2 + grouping(target_prompt_tokens) AS BIGINT) AS level, count(*) AS n,
    round(avg(answer_contains::INT), 6) AS accuracy, round(avg(latency_seconds), 6) AS latency, round(avg(prompt_tokens), 6) AS prompt_tokens FROM needle
    GROUP BY GROUPING SETS ((), (needle_position), (distractor_lang), (needle_position, distractor_lang), (target_prompt_tokens), (target_prompt_tokens, needle_position))""")
_BUCKETS = [4096, 8192, 16384, 32768, 65536, 104000]
_CELLS = "cells AS (SELECT CAST(CASE " + " ".join(f"WHEN prompt_tokens <= {b} THEN {b}" for b in _BUCKETS) + " ELSE prompt_tokens END AS BIGINT) AS bucket, CASE needle_position WHEN 'start' THEN 0 WHEN 'middle' THEN 50 WHEN 'end' THEN 100 ELSE -1 END AS depth, " + _NEEDLE + " FROM needle GROUP BY 1, 2)"
_add("needle_cells", lambda s, d: R.needle_cells(X.needle(s, d), _BUCKETS).withColumn("accuracy", F.round("accuracy", 6)), _with(X.NEEDLE_CTE, _CELLS) + "SELECT bucket, depth, n, round(accuracy, 6) AS accuracy FROM cells")
_add("needle_heatmap", lambda s, d: R.needle_heatmap(R.needle_cells(X.needle(s, d), _BUCKETS)).select("bucket", *(F.round(c, 6).alias(c) for c in ("other", "start", "middle", "end"))),
     _with(X.NEEDLE_CTE, _CELLS) + "SELECT bucket, " + ", ".join(f"round(max(accuracy) FILTER (depth = {k}), 6) AS \"{n}\"" for k, n in ((-1, "other"), (0, "start"), (50, "middle"), (100, "end"))) + " FROM cells GROUP BY 1")
_add("needle_flat", lambda s, d: R.needle_flat(X.needle(s, d)).withColumn("accuracy", F.round("accuracy", 6)),
     _with(X.NEEDLE_CTE) + "SELECT CASE WHEN grouping(needle_position) = 0 THEN 'position' WHEN grouping(distractor_lang) = 0 THEN 'lang' ELSE 'overall' END AS level, coalesce(needle_position, distractor_lang, 'all') AS name, count(*) AS n, round(avg(answer_contains::INT), 6) AS accuracy FROM needle GROUP BY GROUPING SETS ((), (needle_position), (distractor_lang))")
_add("against_published", lambda s, d: R.against_published(_base(s, d).groupBy("dataset").agg((100 * F.avg("score")).alias("score")), s.createDataFrame([("trec", 40.0), ("lcc", 50.0)], "dataset string, published double"), "dataset", "score").select("dataset", "published", *(F.round(c, 6).alias(c) for c in ("score", "difference", "ratio"))),
     _with(X.RESULTS_CTE) + "SELECT dataset, published, round(score, 6) AS score, round(score - published, 6) AS difference, round(score / published, 6) AS ratio FROM (SELECT dataset, 100 * avg(score) AS score FROM results WHERE method = 'base' AND bits = 2.5 GROUP BY 1) LEFT JOIN (VALUES ('trec', 40.0::DOUBLE), ('lcc', 50.0::DOUBLE)) p(dataset, published) USING (dataset)")
_add("compression_runs", lambda s, d: R.compression_runs(X.table(s, d, "documents").select((F.col("doc_id") % 7).alias("run"), (2 + F.col("doc_id") % 5 / 4).alias("effective_bits"), (F.col("doc_id") % 5 / 64).alias("ratio"), F.array(F.col("doc_id") % 3, F.col("doc_id") % 4).alias("outlier_counts"))).select("run", *(F.round(c, 6).alias(c) for c in ("avg_bits", "min_bits", "max_bits", "ratio")), F.array_join(F.transform("histogram", lambda x: F.concat_ws(":", x["c"], x["n"])), ",").alias("histogram")),
     """SELECT run, round(avg_bits, 6) AS avg_bits, min_bits, max_bits, round(ratio, 6) AS ratio, histogram FROM (SELECT doc_id % 7 AS run, avg(2 + doc_id % 5 / 4) AS avg_bits, min(2 + doc_id % 5 / 4) AS min_bits, max(2 + doc_id % 5 / 4) AS max_bits, avg(doc_id % 5 / 64) AS ratio FROM documents GROUP BY 1)
    JOIN (SELECT run, string_agg(c || ':' || n, ',' ORDER BY c) AS histogram FROM (SELECT doc_id % 7 AS run, unnest([doc_id % 3, doc_id % 4]) AS c, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY 1) USING (run)""")
