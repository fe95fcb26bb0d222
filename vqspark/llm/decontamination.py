"""Benchmark decontamination by canonical templates.

Words become a template: numbers, units after numbers and names (capitalised words, other than common openers of
sentences) turn into typed placeholders, everything else is lower-cased without signs at its ends. Five-word windows of
benchmark templates are hash-joined with those of all documents; a window that is nearly all placeholders says too little
as a template and is joined by its words as they stand. A document has an item if enough of the item's windows stand in it
and its slots are filled consistently: along one alignment, equal values of the item have equal values in the document. So
copies with other numbers or names are found, and texts that merely have the same form but mixed-up values are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, table
from .native_text import CORES_SQL, WORDS_SQL, cores, solid_words, starts_digit
from .near_dups import row_key

WORDS = 5
#: Windows of a text that are made at a time: what a word costs beside its letters is never held for a whole long text.
PIECE = 2048
#: The share of an item's windows that a document must hold, and the fewest plain words of a window that stays a template.
COVERAGE, LEAST_WORDS = 0.8, 2
#: Bytes of benchmark windows up to which these are broadcast (checked), with what a row costs beside its words.
MOST_BROADCAST, ROW_BYTES = 64 << 20, 200

# Units that may follow a number.
UNITS = ["mm", "cm", "m", "km", "in", "ft", "mi", "mg", "g", "kg", "t", "lb", "oz", "ml", "l", "s", "min", "h", "hours", "minutes", "seconds", "days", "weeks", "months", "years", "meters", "metres", "miles", "kilometers", "grams", "kilograms", "pounds", "liters", "litres", "dollars", "euros", "cents", "percent", "degrees"]
NUMBER = r"^[0-9][0-9.,:/]*(%|st|nd|rd|th|mm|cm|m|km|mg|g|kg|ml|l|s|h)?$"
NAME = r"^\p{Lu}\p{Ll}+(-\p{Lu}\p{Ll}+)*('s)?$"
# Common words that open sentences and aren't names.
OPENERS = [
    "a", "about", "after", "all", "also", "although", "an", "and", "another", "any", "are", "as", "assume", "at", "because", "before", "both", "but", "by", "calculate", "can", "compute", "consider", "determine",
    "do", "does", "during", "each", "every", "explain", "find", "for", "from", "given", "has", "have", "he", "her", "here", "his", "how", "however", "i", "if", "in", "into", "is", "it", "its", "later", "let",
    "many", "most", "my", "no", "not", "now", "of", "on", "once", "one", "only", "or", "other", "our", "out", "over", "select", "she", "show", "since", "so", "some", "suppose", "that", "the", "their", "then",
    "there", "these", "they", "this", "those", "through", "to", "under", "until", "up", "use", "using", "was", "we", "were", "what", "when", "where", "which", "while", "who", "whose", "why", "will", "with",
    "without", "write", "yet", "you", "your",
]
SENTENCE_END = r"[.!?:][\"')]*$"


def canonical(words: Column, core: Column, low: Column) -> Column:
    """The template's tokens. Cheap tests stand before regular expressions, as few words are anything but plain."""

    def token(w: Column, i: Column) -> Column:
        before = F.get(core, i - 1)
        number = starts_digit(w) & w.rlike(NUMBER)
        unit = (i > 0) & starts_digit(before) & F.get(low, i).isin(UNITS) & before.rlike(NUMBER)
        opens = (i == 0) | F.get(words, i - 1).rlike(SENTENCE_END)
        name = (w != F.get(low, i)) & w.rlike(NAME) & ~(F.get(low, i).isin(OPENERS) & opens)
        return F.when(number, "<num>").when(unit, "<unit>").when(name, "<name>").otherwise(F.get(low, i))

    return F.transform(core, token)


def _tokens(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, and for each piece of the text its base, core words, these in lower case, and tokens.

    A piece starts with the word before its first window, if there is one, and ends with the last word of its last; `base`
    is the place of its first word in the text. Each step is a column of its own, as expressions within lambdas would be
    worked out for every element.
    """
    whole = rows.select(*keys, solid_words(F.col("text")).alias("whole"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("whole") - WORDS, F.lit(0)), F.lit(PIECE))
    whole = whole.select(*keys, "whole", F.explode(starts).alias("start")).withColumn("base", F.greatest(F.col("start") - 1, F.lit(0)))
    words = F.slice("whole", F.col("base") + 1, F.col("start") - F.col("base") + PIECE + WORDS - 1)
    keys = [*keys, "base"]
    staged = whole.select(*keys, words.alias("words"))
    staged = staged.select(*keys, "words", cores(F.col("words")).alias("core"))
    staged = staged.select(*keys, "words", "core", F.transform("core", F.lower).alias("low"))
    return staged.select(*keys, "core", "low", canonical(F.col("words"), F.col("core"), F.col("low")).alias("tokens"))


def _first() -> Column:
    """Place of a piece's first window: all pieces but a text's first have a word before it."""
    return (F.col("base") > 0).cast("int")


def _windows(tokens: DataFrame, *columns: str) -> DataFrame:
    """`columns` and base of the rows of `_tokens`, and place in the piece and hash of each window; a text below WORDS words is one window.

    Windows of many placeholders are hashed by their words. No filter looks at the tokens, as Spark would work them out twice.
    """

    def key(i: Column) -> Column:
        some = [F.get(F.col("tokens"), i + k) for k in range(WORDS)]
        words = sum(F.coalesce((~s.startswith("<")).cast("int"), F.lit(0)) for s in some)
        plain = F.xxhash64(F.lit(0), *[F.get(F.col("low"), i + k) for k in range(WORDS)])
        return F.when(some[0].isNotNull(), F.when(words >= LEAST_WORDS, F.xxhash64(*some)).otherwise(plain))

    hashes = F.transform(F.sequence(_first(), F.greatest(F.size("tokens") - WORDS, F.lit(0))), key)
    # The hashes are a column too: a generator that holds a lambda isn't compiled, and then every window copies its text.
    columns = [*columns, "base"]
    staged = tokens.select(*dict.fromkeys([*columns, "tokens"]), hashes.alias("hashes"))
    staged = staged.select(*columns, F.posexplode_outer("hashes").alias("nth", "hash")).filter("hash is not null")
    return staged.select(*columns, (F.col("nth") + _first()).alias("at"), "hash")


def _short_runs(tokens: DataFrame, n: int, *columns: str) -> DataFrame:
    """Place and hash of each run of n words as they stand, for benchmark items of n words; those where pieces meet may stand twice."""
    columns = [*columns, "base"]
    hashes = F.transform(F.sequence(_first(), F.size("low") - n), lambda i: F.xxhash64(F.lit(n), *[F.get(F.col("low"), i + k) for k in range(n)]))
    staged = tokens.filter(F.size("low") >= n).select(*columns, hashes.alias("hashes"))
    staged = staged.select(*columns, F.posexplode("hashes").alias("nth", "hash"))
    return staged.select(*columns, (F.col("nth") + _first()).alias("at"), "hash")


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """Windows of the items: item_key, item_id, item_at, hash, and what hits are compared by.

    `span` is how many words a hit must share, `dense` whether as they stand, `form` these words or tokens. `part` numbers
    the item's different windows, n_windows and n_sparse count them, all and those that are templates. An item of two to
    four words is also looked up as a run of these words.
    """
    tokens = _tokens(benchmark.select("item_id", F.xxhash64("item_id", "text").alias("item_key"), "text").dropDuplicates(["item_key"]), ["item_id", "item_key"])
    own = ["item_id", "item_key", "core", "low", "tokens"]
    rows = _windows(tokens, *own).withColumn("span", F.lit(WORDS)).withColumn("part", F.when(F.size("core") >= WORDS, F.col("hash")).otherwise(F.lit(0)))
    for n in range(2, WORDS):
        rows = rows.unionByName(_short_runs(tokens.filter(F.size("low") == n), n, *own).withColumn("span", F.lit(n)).withColumn("part", F.lit(0).cast("long")))
    cut = {c: F.slice(c, F.col("at") + 1, WORDS) for c in ("core", "low", "tokens")}
    rows = rows.withColumns(cut)
    dense = (F.size(F.filter("tokens", lambda t: ~t.startswith("<"))) < LEAST_WORDS) | (F.col("span") < WORDS)
    rows = rows.withColumn("dense", dense).withColumn("form", F.when(F.col("dense"), F.col("low")).otherwise(F.col("tokens")))
    sizes = rows.groupBy("item_key").agg(F.countDistinct("part").alias("n_windows"), F.countDistinct(F.when(~F.col("dense"), F.col("part"))).alias("n_sparse"))
    return rows.join(sizes, "item_key").select("item_key", "item_id", (F.col("base") + F.col("at")).alias("item_at"), "hash", "span", "part", "dense", "form", F.col("tokens").alias("kinds"), F.col("low").alias("item_values"), "n_windows", "n_sparse")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows, n_matched, coverage, reparameterised: documents that hold benchmark items.

    `docs` needs doc_id and text, `benchmark` item_id and text; other columns are not looked at. Null, empty and wordless
    texts match nothing. An item_id or doc_id with several texts has its best pair; equal rows give one. coverage is the
    share of the item's windows in the document; where at least half of them are templates, that of these if it is more.
    Items below five words are found as whole texts of the same form and, from two words on, as runs of their words; a
    single word only as the whole text. reparameterised tells whether some slot differs.

    Texts are worked on in pieces of PIECE windows. Benchmark windows of up to MOST_BROADCAST bytes (checked) are broadcast,
    and texts aren't shuffled; beyond that the documents' window hashes are shuffled alone, what they hit is written, and
    then joined with the words of the texts that have hits.
    """
    items = durable(benchmark_windows(benchmark))
    words = sum(F.octet_length(F.array_join(c, " ", "")) for c in ("form", "kinds", "item_values"))
    size, spans = items.agg(F.sum(words + ROW_BYTES), F.collect_set(F.when(F.col("span") < WORDS, F.col("span")))).first()
    docs = docs.select("doc_id", row_key().alias("row_key"), "text")
    tokens = _tokens(docs, ["doc_id", "row_key"])
    few = (size or 0) <= MOST_BROADCAST
    carried = ["doc_id", "row_key", "core", "tokens"] if few else ["row_key"]
    windows = _windows(tokens, *carried)
    for n in sorted(spans):
        windows = windows.unionByName(_short_runs(tokens, n, *carried))
    if few:
        hits = windows.join(F.broadcast(items), "hash")
    else:
        hits = durable(windows.join(items, "hash"))
        texts = docs.join(hits.select("row_key").distinct(), "row_key", "left_semi").dropDuplicates(["row_key"])
        hits = hits.join(_tokens(texts, ["doc_id", "row_key"]).select("doc_id", "row_key", "base", "core", "tokens"), ["row_key", "base"])
    # Hits are compared by order, since as an equality the words would become join keys and be cut for every window; a
    # lambda here would keep the join from being compiled.
    for k in range(WORDS):
        mine = F.when(F.col("dense"), F.lower(F.get("core", F.col("at") + k))).otherwise(F.get("tokens", F.col("at") + k))
        own, other = F.coalesce(mine, F.lit("")), F.coalesce(F.get("form", F.lit(k)), F.lit(""))
        hits = hits.filter((F.col("span") <= k) | ((own >= other) & (own <= other)))
    hits = hits.withColumn("values", F.transform(F.slice("core", F.col("at") + 1, WORDS), F.lower)).drop("core", "tokens")
    pair = ["doc_id", "row_key", "item_key", "item_id", "n_windows", "n_sparse"]
    hits = hits.withColumn("aligned", F.col("base") + F.col("at") - F.col("item_at"))
    slots = F.filter(F.arrays_zip("kinds", "values", "item_values"), lambda s: s["kinds"].startswith("<"))
    runs = hits.groupBy(*pair, "aligned").agg(F.collect_set(F.struct("part", "dense")).alias("parts"), F.array_distinct(F.flatten(F.collect_list(slots))).alias("slots"))
    # Consistent: as many different (kind, item value) as (kind, item value, document value).
    given = F.array_distinct(F.transform("slots", lambda s: F.struct(s["kinds"], s["item_values"])))
    runs = runs.filter(F.size(given) == F.size("slots")).withColumn("changed", F.exists("slots", lambda s: s["values"] != s["item_values"]))
    found = runs.groupBy(*pair).agg(F.array_distinct(F.flatten(F.collect_list("parts"))).alias("parts"), F.max("changed").alias("changed"))
    n_sparse = F.size(F.array_distinct(F.transform(F.filter("parts", lambda p: ~p["dense"]), lambda p: p["part"])))
    found = found.withColumn("n_matched", F.size(F.array_distinct(F.transform("parts", lambda p: p["part"]))).cast("long"))
    sparse = F.when(2 * F.col("n_sparse") >= F.col("n_windows"), n_sparse / F.col("n_sparse"))
    found = found.withColumn("coverage", F.greatest(F.col("n_matched") / F.col("n_windows"), sparse)).filter(F.col("coverage") >= COVERAGE)
    best = F.max(F.struct("coverage", "n_matched", "n_windows", (~F.col("changed")).alias("same"))).alias("best")
    found = found.groupBy("doc_id", "item_id").agg(best)
    return found.select("doc_id", "item_id", "best.n_windows", "best.n_matched", "best.coverage", (~F.col("best.same")).alias("reparameterised"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _tokens_sql(source: str, key: str) -> str:
    """Rows of key, core words (core), tokens (c)."""
    listed = lambda words: ", ".join(f"'{w}'" for w in words)
    name, end = (p.replace("'", "''") for p in (NAME, SENTENCE_END))
    return f"""
    SELECT {key}, core, list_transform(range(1, len(core) + 1), lambda i: CASE
            WHEN regexp_matches(core[i], '{NUMBER}') THEN '<num>'
            WHEN i > 1 AND list_contains([{listed(UNITS)}], lower(core[i])) AND regexp_matches(core[i - 1], '{NUMBER}') THEN '<unit>'
            WHEN regexp_matches(core[i], '{name}') AND NOT (list_contains([{listed(OPENERS)}], lower(core[i])) AND (i = 1 OR regexp_matches(w[i - 1], '{end}'))) THEN '<name>'
            ELSE lower(core[i]) END) AS c
    FROM (SELECT {key}, w, {CORES_SQL} AS core FROM (SELECT {key}, {WORDS_SQL} AS w FROM {source})) WHERE len(core) > 0"""


def _windows_sql(source: str, key: str, short: bool) -> str:
    """Windows: place, form (what must agree), kinds and values; runs of two to four words, of all texts or of those as short."""
    own = f"""
    SELECT {key}, place, dense, span, kinds, vals, CASE WHEN dense THEN list_transform(vals, lambda x: lower(x)) ELSE kinds END AS form, CASE WHEN n < {WORDS} THEN ['short'] ELSE kinds || CASE WHEN dense THEN vals ELSE [] END END AS part
    FROM (SELECT {key}, n, i - 1 AS place, {WORDS} AS span, c[i:i + 4] AS kinds, core[i:i + 4] AS vals, len(list_filter(c[i:i + 4], lambda x: NOT starts_with(x, '<'))) < {LEAST_WORDS} AS dense
        FROM (SELECT {key}, core, c, len(c) AS n, unnest(range(1, greatest(len(c) - 3, 2))) AS i FROM {source}))"""
    length = "len(core) = n AND" if short else ""
    return own + f"""
    UNION ALL SELECT {key}, i - 1, true, n, c[i:i + n - 1], core[i:i + n - 1], list_transform(core[i:i + n - 1], lambda x: lower(x)), ['short']
    FROM (SELECT {key}, core, c, n, unnest(range(1, len(c) - n + 2)) AS i FROM {source}, (SELECT unnest(range(2, {WORDS})) AS n) WHERE {length} n IN (SELECT len(core) FROM item_tokens))"""


OP7_SQL = f"""
WITH item_tokens AS MATERIALIZED ({_tokens_sql("benchmark", "item_id")}),
doc_tokens AS MATERIALIZED ({_tokens_sql("documents", "doc_id")}),
items AS MATERIALIZED ({_windows_sql("item_tokens", "item_id", True)}),
sizes AS (SELECT item_id, count(DISTINCT part) AS n_windows, count(DISTINCT part) FILTER (NOT dense) AS n_sparse FROM items GROUP BY item_id),
hits AS MATERIALIZED (
    SELECT d.doc_id, i.item_id, d.place - i.place AS aligned, i.part, i.dense, i.kinds, d.vals, i.vals AS item_vals
    FROM ({_windows_sql("doc_tokens", "doc_id", False)}) d JOIN items i ON d.form = i.form AND d.dense = i.dense AND d.span = i.span),
slots AS (
    SELECT DISTINCT doc_id, item_id, aligned, kind, item_val, val FROM (
        SELECT doc_id, item_id, aligned, unnest(kinds) AS kind, lower(unnest(item_vals)) AS item_val, lower(unnest(vals)) AS val FROM hits)
    WHERE starts_with(kind, '<')),
wrong AS (SELECT DISTINCT doc_id, item_id, aligned FROM slots GROUP BY doc_id, item_id, aligned, kind, item_val HAVING count(*) > 1),
changed AS (SELECT DISTINCT doc_id, item_id, aligned FROM slots WHERE val <> item_val),
found AS (
    SELECT h.doc_id, h.item_id, count(DISTINCT h.part) AS n_matched, count(DISTINCT h.part) FILTER (NOT h.dense) AS n_sparse_matched, bool_or(c.doc_id IS NOT NULL) AS reparameterised
    FROM hits h LEFT JOIN changed c USING (doc_id, item_id, aligned) ANTI JOIN wrong x USING (doc_id, item_id, aligned)
    GROUP BY h.doc_id, h.item_id),
covered AS (
    SELECT doc_id, item_id, n_windows, n_matched, reparameterised, greatest(n_matched / n_windows, CASE WHEN 2 * n_sparse >= n_windows THEN n_sparse_matched / n_sparse END) AS coverage
    FROM found JOIN sizes USING (item_id))
SELECT doc_id, item_id, CAST(n_windows AS BIGINT) AS n_windows, CAST(n_matched AS BIGINT) AS n_matched, coverage, reparameterised
FROM covered WHERE coverage >= {COVERAGE}
"""
