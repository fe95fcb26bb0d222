"""Rows that try operators: nulls, empty, short and very long texts, ties, repeated rows, clashing columns."""

LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(30_000))
TEXTS = [None, "", "   \n", "one", "one two three", "The quick brown fox jumps over the lazy dog again and again today.", "The quick brown fox jumps over the lazy dog again and again today.", LONG, LONG + " more words at the end", "é" * 700, "a\tb\x0bc d", "mail me: jo.doe@example.com or +1 (202) 555-0123, 10.0.0.255"]


def edge_docs(spark):
    """Also a null id, a row that stands twice, an id with two texts, and columns named like results."""
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id here at all but some words"), (5, TEXTS[5]), (3, "another text of the same id")]
    rows = [(i, t, "en", "s", None if t is None else len(t), 7, "x", 0.5) for i, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row_key long, digest string, score double")


def empty_docs(spark):
    return edge_docs(spark).limit(0)
