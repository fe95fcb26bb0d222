"""Queries over prompts and predictions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..operators import prompts as P
from ..operators import scoring as S

QUERIES, ORACLE_SQL = {}, {}


def _add(name: str, query, sql: str | None = None) -> None:  # noqa: ANN001
    QUERIES[name] = query
    if sql is not None:
        ORACLE_SQL[name] = sql


def _pairs(s, d):  # noqa: ANN001, ANN202
    c = X.table(s, d, "conversations")
    user = c.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("asked"))
    return c.filter("role = 'assistant'").join(user, ["conv_id", "turn"]).select("conv_id", "turn", F.col("text").alias("prediction"), "asked")


_PAIRS = "pairs AS (SELECT a.conv_id, a.turn, a.text AS prediction, u.text AS asked FROM conversations a JOIN conversations u ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE a.role = 'assistant' AND u.role = 'user')"


def _norm(x: str) -> str:
    marks = "".join(f"\\{c}" for c in S.PUNCTUATION).replace("'", "''")
    return f"array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower({x}), '[{marks}]', '', 'g'), '\\s+'), lambda x: x NOT IN ('', 'a', 'an', 'the')), ' ')"


_add("normalize_answer", lambda s, d: _pairs(s, d).select("conv_id", "turn", S.normalize(F.col("prediction")).alias("text")), f"WITH {_PAIRS} SELECT conv_id, turn, {_norm('prediction')} AS text FROM pairs")
_TOK = "list_filter(string_split({}, ' '), lambda x: x <> '')"
_add("qa_f1", lambda s, d: S.with_f1(_pairs(s, d), "prediction", "asked", ["conv_id", "turn"]).withColumn("f1", F.round("f1", 6)),
     f"""WITH {_PAIRS}, t AS (SELECT conv_id, turn, {_TOK.format(_norm('prediction'))} AS p, {_TOK.format(_norm('asked'))} AS g FROM pairs)
    SELECT conv_id, turn, round(coalesce(2.0 * list_sum(list_transform(list_distinct(p), lambda w: least(len(list_filter(p, lambda x: x = w)), len(list_filter(g, lambda x: x = w))))) / (len(p) + len(g)), 0), 6) AS f1 FROM t""")
_add("contains_answer", lambda s, d: _pairs(s, d).select("conv_id", "turn", S.contains_answer(F.col("prediction"), F.array("asked", F.substring("prediction", 3, 20))).alias("hit")),
     f"WITH {_PAIRS} SELECT conv_id, turn, list_bool_or([{_norm('asked')} <> '' AND contains({_norm('prediction')}, {_norm('asked')}), {_norm('substr(prediction, 3, 20)')} <> '' AND contains({_norm('prediction')}, {_norm('substr(prediction, 3, 20)')})]) AS hit FROM pairs")
_NUM = "'Paragraph ' || doc_id % 9 || ' or ' || doc_id % 7"
_add("count_and_retrieval_score", lambda s, d: X.table(s, d, "documents").select("doc_id", F.expr(_NUM).alias("p")).select("doc_id", F.round(S.retrieval(F.col("p"), F.concat(F.lit("Paragraph "), (F.col("doc_id") % 7).cast("string"))), 6).alias("retrieval"), F.round(S.numbers_equal(F.col("p"), (F.col("doc_id") % 7).cast("string")), 6).alias("counted")),
     f"SELECT doc_id, s AS retrieval, s AS counted FROM (SELECT doc_id, round(len(list_filter(regexp_extract_all({_NUM}, '\\d+'), lambda x: x = (doc_id % 7)::VARCHAR)) / 2, 6) AS s FROM documents)")


def _classes(s, d):  # noqa: ANN001, ANN202
    t = X.table(s, d, "documents").select("doc_id", "lang")
    return t.join(t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("lang").alias("answer")), "doc_id").select("doc_id", F.concat("lang", F.lit(" text")).alias("p"), "answer", F.array(*[F.lit(x) for x in ("de", "en", "es", "fr")]).alias("c"))


_add("classification_score", lambda s, d: _classes(s, d).select("doc_id", S.classification(F.col("p"), F.col("answer"), F.col("c")).alias("score")),
     "SELECT doc_id, CASE WHEN contains(p, answer) THEN 1.0::DOUBLE / len(list_filter(['de', 'en', 'es', 'fr'], lambda c: contains(p, c) AND NOT (contains(answer, c) AND c <> answer))) ELSE 0 END AS score FROM (SELECT a.doc_id, a.lang || ' text' AS p, b.lang AS answer FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)")


def _lcs_sql(a: str, b: str) -> str:
    """Length of the longest common subsequence of two lists: the places of b's items in a, each item's from the last one on,
    are taken into an ascending list, each in the place of the first that isn't smaller."""
    smaller = "list_filter(s, lambda x: x < p[1])"
    places = f"flatten(list_transform({b}, lambda y: list_transform(list_reverse(list_filter(range(1, len({a}) + 1), lambda i: {a}[i] = y)), lambda i: [i])))"
    return f"len(list_reduce(list_prepend([]::BIGINT[], {places}), lambda s, p: list_concat({smaller}, p, s[len({smaller}) + 2:])))"


_WORDS = "list_filter(regexp_split_to_array({}, '\\s+'), lambda x: x <> '')"
_ROUGE = f"CASE WHEN len(p) > 0 AND len(g) > 0 THEN 2.0 * {_lcs_sql('p', 'g')} / (len(p) + len(g)) ELSE 0 END"
_LINE = r"coalesce(list_filter(string_split(ltrim({}, chr(10)), chr(10)), lambda x: NOT (contains(x, '`') OR contains(x, '#') OR contains(x, '//')))[1], '')"
_LETTERS = "list_filter(string_split({}, ''), lambda x: x <> '')"
_CODE = f"CASE WHEN len(p) + len(g) > 0 THEN round(200.0 * {_lcs_sql('p', 'g')} / (len(p) + len(g))) / 100 ELSE 0 END"
_add("rouge_l", lambda s, d: _pairs(s, d).select("conv_id", "turn", F.round(S.rouge_l(F.col("prediction"), F.col("asked")), 6).alias("rouge")),
     f"WITH {_PAIRS}, t AS (SELECT conv_id, turn, {_WORDS.format('prediction')} AS p, {_WORDS.format('asked')} AS g FROM pairs) SELECT conv_id, turn, round({_ROUGE}, 6) AS rouge FROM t")


def _lined(s, d):  # noqa: ANN001, ANN202
    """Predictions whose sentences are lines, every other one after line feeds, every third one with a comment first."""
    n = F.col("conv_id") + F.col("turn")
    text = F.regexp_replace("prediction", "[.] ", "\n")
    return _pairs(s, d).withColumn("prediction", F.concat(F.when(n % 2 == 0, "\n\n").otherwise(""), F.when(n % 3 == 0, "# note\n").otherwise(""), text))


_LINED = f"""{_PAIRS}, lined AS (SELECT conv_id, turn, asked, CASE WHEN (conv_id + turn) % 2 = 0 THEN chr(10) || chr(10) ELSE '' END || CASE WHEN (conv_id + turn) % 3 = 0 THEN '# note' || chr(10) ELSE '' END || replace(prediction, '. ', chr(10)) AS prediction FROM pairs)"""
_add("code_similarity", lambda s, d: _lined(s, d).select("conv_id", "turn", S.code_similarity(F.col("prediction"), F.col("asked")).alias("similarity")),
     f"WITH {_LINED}, t AS (SELECT conv_id, turn, {_LETTERS.format(_LINE.format('prediction'))} AS p, {_LETTERS.format('asked')} AS g FROM lined) SELECT conv_id, turn, {_CODE} AS similarity FROM t")
_TASK_NAMES = [*S.METRICS, "unknown", "lcc_e"]


def _predictions(s, d):  # noqa: ANN001, ANN202
    """A task for every pair: all there are, one that isn't known and one of a shorter variant."""
    names = F.array(*[F.lit(x) for x in _TASK_NAMES])
    dataset = F.element_at(names, ((F.col("conv_id") * 5 + F.col("turn")) % len(_TASK_NAMES) + 1).cast("int"))
    number = (F.col("conv_id") % 3).cast("string")
    paragraph = F.concat(F.lit("\nParagraph "), number, F.lit(" is "))
    rows = _lined(s, d).withColumn("dataset", dataset).withColumn("prediction", F.when(dataset.startswith("passage"), F.concat(paragraph, "prediction")).otherwise(F.col("prediction")))
    first = F.get(F.split(S.without_line_feeds(F.col("prediction")), "\n"), F.lit(0))
    answers = F.when(dataset == "passage_count", F.array(number)).when(dataset.startswith("passage"), F.array(F.concat(F.lit("Paragraph "), number))).otherwise(F.array("asked", F.substring(first, 1, 40)))
    return rows.select("conv_id", "turn", "dataset", "prediction", answers.alias("answers"), F.when(F.col("conv_id") % 2 == 0, F.array("asked", F.substring(first, 1, 40))).alias("all_classes"))


_SCORE_SQL = f"""WITH {_LINED}, named AS (SELECT *, {_TASK_NAMES}[(conv_id * 5 + turn) % {len(_TASK_NAMES)} + 1] AS dataset FROM lined),
    m(task, metric) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in S.METRICS.items())}),
    raw AS (SELECT conv_id, turn, asked, dataset, regexp_replace(dataset, '_e$', '') AS task, CASE WHEN starts_with(dataset, 'passage') THEN chr(10) || 'Paragraph ' || conv_id % 3 || ' is ' ELSE '' END || prediction AS prediction FROM named),
    firsts AS (SELECT *, string_split(ltrim(prediction, chr(10)), chr(10))[1] AS line FROM raw),
    cut AS (SELECT conv_id, turn, metric, asked, dataset, line, CASE WHEN task IN {S.FIRST_LINE} THEN line ELSE prediction END AS text,
        CASE WHEN dataset = 'passage_count' THEN [(conv_id % 3)::VARCHAR] WHEN starts_with(dataset, 'passage') THEN ['Paragraph ' || conv_id % 3] ELSE [asked, substr(line, 1, 40)] END AS answers,
        CASE WHEN conv_id % 2 = 0 THEN [asked, substr(line, 1, 40)] WHEN task = 'trec' THEN {S.TREC_CLASSES} END AS classes FROM firsts LEFT JOIN m USING (task)),
    each AS (SELECT * EXCLUDE (answers), unnest(answers) AS answer FROM cut),
    f AS (SELECT conv_id, turn, {_TOK.format(_norm('text'))} AS p, {_TOK.format(_norm('answer'))} AS g FROM each WHERE metric = 'f1'),
    r AS (SELECT conv_id, turn, {_WORDS.format('text')} AS p, {_WORDS.format('answer')} AS g FROM each WHERE metric = 'rouge'),
    c AS (SELECT conv_id, turn, {_LETTERS.format(_LINE.format('text'))} AS p, {_LETTERS.format('answer')} AS g FROM each WHERE metric = 'code'),
    n AS (SELECT conv_id, turn, regexp_extract_all(text, '[0-9]+') AS found, CASE WHEN metric = 'count' THEN answer ELSE regexp_extract(answer, 'Paragraph ([0-9]+)', 1) END AS wanted FROM each WHERE metric IN ('count', 'retrieval')),
    k AS (SELECT conv_id, turn, answer, list_filter(classes, lambda x: contains(text, x) AND NOT (contains(answer, x) AND x <> answer)) AS named FROM each WHERE metric = 'class'),
    s AS (SELECT conv_id, turn, coalesce(2.0 * list_sum(list_transform(list_distinct(p), lambda w: least(len(list_filter(p, lambda x: x = w)), len(list_filter(g, lambda x: x = w))))) / (len(p) + len(g)), 0) AS s FROM f
        UNION ALL SELECT conv_id, turn, {_ROUGE} FROM r UNION ALL SELECT conv_id, turn, {_CODE} FROM c
        UNION ALL SELECT conv_id, turn, CASE WHEN len(found) > 0 THEN len(list_filter(found, lambda x: x = wanted)) / len(found) ELSE 0 END FROM n
        UNION ALL SELECT conv_id, turn, CASE WHEN list_contains(named, answer) THEN 1.0 / len(named) ELSE 0 END FROM k)
    SELECT conv_id, turn, dataset, round(max(s)::DOUBLE, 6) AS score FROM cut LEFT JOIN s USING (conv_id, turn) GROUP BY 1, 2, 3"""
_add("score_prediction", lambda s, d: S.score_prediction(_predictions(s, d), ["conv_id", "turn"]).select("conv_id", "turn", "dataset", F.round("score", 6).alias("score")), _SCORE_SQL)


def _tasked(s, d):  # noqa: ANN001, ANN202
    names = F.array(*[F.lit(x[0]) for x in X.TASKS])
    t = X.table(s, d, "benchmark").select("item_id", F.element_at(names, (F.col("item_id") % 16 + 1).cast("int")).alias("dataset"), F.concat(F.lit("  question:  "), "text").alias("question"))
    docs = X.table(s, d, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("context"))
    return t.join(docs, "item_id").withColumn("input", P.input_text(F.lit(None).cast("string"), F.col("question"), F.col("dataset")))


_TASKED = f"""tasked AS (SELECT item_id, dataset, context, CASE WHEN dataset IN {P.QUESTION_TASKS} THEN trim(regexp_replace(question, '^\\s*(?i)question:', '')) WHEN dataset = 'qmsum' THEN trim(question) ELSE question END AS input
    FROM (SELECT item_id, {[x[0] for x in X.TASKS]}[item_id % 16 + 1] AS dataset, d.text AS context, '  question:  ' || b.text AS question FROM benchmark b JOIN documents d ON d.doc_id = b.item_id))"""
_add("build_prompt", lambda s, d: P.build_prompt(_tasked(s, d), s.createDataFrame([(x[0], f"Read {{context}} and answer ({x[1]}): {{input}}.") for x in X.TASKS], "dataset string, template string")).select("item_id", F.md5("prompt").alias("prompt")),
     f"WITH {X.TASKS_CTE}, {_TASKED} SELECT item_id, md5('Read ' || context || ' and answer (' || category || '): ' || input || '.') AS prompt FROM tasked JOIN tasks USING (dataset)")
_add("generation_limits", lambda s, d: P.generation_limits(_tasked(s, d).select("item_id", "dataset"), s).select("item_id", "max_new_tokens", "use_chat"),
     f"WITH {_TASKED}, l(dataset, n) AS (VALUES {', '.join(f'({k!r}, {v})' for k, v in P.MAX_NEW_TOKENS)}) SELECT item_id, CAST(coalesce(n, 64) AS INT) AS max_new_tokens, dataset NOT IN {P.NO_CHAT} AS use_chat FROM tasked LEFT JOIN l USING (dataset)")
_add("plain_prompt", lambda s, d: _pairs(s, d).select("conv_id", "turn", F.length(P.plain_prompt(F.col("prediction"), F.substring("prediction", -9, 9))).cast("long").alias("n")), f"WITH {_PAIRS} SELECT conv_id, turn, length(prediction) AS n FROM pairs")
_add("truncate_middle", lambda s, d: X.table(s, d, "documents").select("doc_id", F.md5(F.array_join(P.truncate_middle(F.split("text", " "), 21), " ")).alias("t")),
     "SELECT doc_id, md5(array_to_string(CASE WHEN len(w) <= 21 THEN w ELSE list_concat(w[1:10], w[len(w) - 10:]) END, ' ')) AS t FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)")


def _needles(s, d):  # noqa: ANN001, ANN202
    head = lambda w, i: F.xxhash64(*[F.get(w, i + k) for k in range(3)])
    items = X.table(s, d, "benchmark").select("item_id", F.split("text", " ").alias("sentence")).withColumn("head", head(F.col("sentence"), F.lit(0)))
    docs = X.table(s, d, "documents").select("doc_id", F.split("text", " ").alias("words"))
    # Places of three-word heads move, not texts; what has met gets its texts afterwards.
    heads = docs.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("words") - 1), lambda i: head(F.col("words"), i))).alias("spot", "head"))
    met = heads.join(items.select("item_id", "head"), "head").select("doc_id", "item_id", "spot")
    found = met.join(items.select("item_id", "sentence"), "item_id").join(docs, "doc_id").filter(F.slice("words", F.col("spot") + 1, F.size("sentence")) == F.col("sentence"))
    found = found.groupBy("doc_id", "item_id").agg(F.min("spot").alias("at"), F.first("words").alias("words"), F.first("sentence").alias("sentence"))
    return found.crossJoin(s.createDataFrame([(60,), (120,)], "target int")).select("doc_id", "item_id", "target", "at", F.when(F.col("target") == 60, P.needle_crop(F.col("words"), F.col("at"), F.size("sentence"), 60)).otherwise(P.needle_crop(F.col("words"), F.col("at"), F.size("sentence"), 120)).alias("kept"))


_add("needle_length_grid", lambda s, d: _needles(s, d).select(F.concat("doc_id", F.lit(":target"), "target").alias("id"), "item_id", F.size("kept").cast("long").alias("n"), F.md5(F.array_join("kept", " ")).alias("kept")),
     """WITH n AS (SELECT doc_id, item_id, string_split(d.text, ' ') AS w, string_split(b.text, ' ') AS sn FROM documents d, benchmark b WHERE contains(d.text, b.text)),
    a AS (SELECT *, list_filter(range(0, len(w)), lambda i: w[i + 1:i + len(sn)] = sn)[1] AS spot FROM n), g AS (SELECT *, greatest(least(spot - CAST(floor((t - len(sn)) / 2) AS BIGINT), len(w) - t), 0) AS st FROM a, (SELECT unnest([60, 120]) AS t) WHERE spot IS NOT NULL)
    SELECT doc_id || ':target' || t AS id, item_id, CAST(least(len(w), t) AS BIGINT) AS n, md5(array_to_string(CASE WHEN len(w) <= t THEN w ELSE w[st + 1:st + t] END, ' ')) AS kept FROM g""")
