"""Alignment, resampling and exact search against plain Python versions and the tokenizers' own libraries."""

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from helpers import TEXTS, edge_docs, empty_docs

from vqspark.llm import alignment, resampling, textops, topk

ODD = ["a", "b", " ", "  ", "\n", "\t", "▁", "é", "日本", "　", "\x00", "<s>", "<|endoftext|>", "'s", "'ll", "12", "!?", "́", "ing", "the", "\r\n", "🙂", "​", "<0x0A>"]


def odd_texts(n, most=60):
    random.seed(5)
    return ["".join(random.choice(ODD) for _ in range(random.randrange(most))) for _ in range(n)]


@pytest.fixture(scope="module")
def libraries():
    a = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def plain_alignment(rows, libraries):
    first, second = libraries
    letters = alignment.byte_letters()
    spelled = {i: bytes(letters[c] for c in t) for t, i in first.get_vocab().items() if i < 50256}

    def piece(i):
        name = second.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if second.is_byte(i) else name.replace("▁", " ").encode()

    out, held = [], Counter()
    for doc, text in rows:
        whole = b" " + (text or "").encode()
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        if not text or b"".join(spelled[i] for i in a) != whole or b"".join(map(piece, b)) != whole:
            out.append((doc, 0, 0, 0, [], ""))
            continue
        ends = [list(np.cumsum([len(x) for x in part])) for part in ([spelled[i] for i in a], [piece(i) for i in b])]
        groups, links, i, j, ga, gb = [], [], 0, 0, [], []
        while i < len(a) and j < len(b):
            links.append((a[i], b[j]))
            x, y = ends[0][i], ends[1][j]
            if x <= y:
                ga.append(a[i])
                i += 1
            if y <= x:
                gb.append(b[j])
                j += 1
            if x == y:
                groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
                ga, gb = [], []
        held.update(set(links))
        out.append((doc, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = {}
    for (a, _), n in held.items():
        best[a] = max(n, best.get(a, 0))
    return sorted([(doc, na, nb, ng, len(x), sum(held[k] == best[k[0]] for k in x), sum(held[k] for k in x), sha) for doc, na, nb, ng, x, sha in out], key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"fragment": 50}, {"broadcast_pairs": 0}])
def test_alignment(spark, data, libraries, options):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").filter("doc_id < 60").union(edge_docs(spark).selectExpr("doc_id + 1000", "text"))
    docs = docs.union(spark.createDataFrame(list(enumerate(odd_texts(150), 2000)), "doc_id long, text string"))
    got = found(alignment.align_tokenizers(docs, **options))
    assert got == plain_alignment([tuple(r) for r in docs.collect()], libraries)
    assert any(r[1] == 0 for r in got) and all(r[4] == r[1] + r[2] - r[3] for r in got)


def test_alignment_of_an_empty_table_and_clashing_columns(spark):
    assert alignment.align_tokenizers(empty_docs(spark)).collect() == []
    more = edge_docs(spark).withColumns({"block": F.lit(1), "pairs": F.lit("x"), "nth": F.lit(3)})
    assert found(alignment.align_tokenizers(more)) == found(alignment.align_tokenizers(edge_docs(spark)))


def test_encoders_equal_the_libraries(libraries):
    texts = [*odd_texts(2000), "é" * 3000, "a " * 3000, " " * 500, "▁" * 9, "\n" * 77, "x" * 5000]
    data, at = alignment.with_space(*textops.text_bytes(pa.array(texts)))
    first = alignment.ByteLevel(*alignment.load_byte_level(public_tokenizers.path("byte_bpe_50k.json")))
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        second = alignment.Pieces(file.read())
    a = alignment.encode_side(first, data, at, alignment.bpe.piece_spans(data, at)[0])
    b = alignment.encode_side(second, data, at, alignment.word_starts(data, at))
    for i, text in enumerate(texts):
        assert a.of(i)[0].tolist() == (libraries[0].encode(" " + text, add_special_tokens=False).ids if text else [])
        assert b.of(i)[0].tolist() == libraries[1].encode(text)
    # A slice that is a token is taken as it is, so merges must lead to every token.
    assert all(first.merge(token) == (i,) for token, i in first.ranks.items())


def test_fragments_compose_in_any_order():
    """Random token ends, cut anywhere: all trees give what one fragment of the whole gives."""
    rng = np.random.default_rng(1)
    for _ in range(60):
        total = int(rng.integers(1, 60))
        ends = [np.r_[np.flatnonzero(rng.random(total - 1) < 0.4) + 1, total].astype(np.int64) for _ in range(2)]
        ids = [rng.integers(0, 9, len(e)).astype(np.int32) for e in ends]
        tokens = alignment._open(a=ids[0], a_end=ends[0], b=ids[1], b_end=ends[1])
        whole = alignment.Fragment.of(tokens, 0, True)
        cuts = sorted({0, total, *rng.integers(0, total + 1, int(rng.integers(0, 9))).tolist()})
        parts = [alignment.Fragment.of(alignment._split(tokens, low, high), low, low == 0) for low, high in zip(cuts, cuts[1:], strict=False)]
        while len(parts) > 1:
            i = int(rng.integers(0, len(parts) - 1))
            parts[i : i + 2] = [alignment.Fragment.read(parts[i].row()) + alignment.Fragment.read(parts[i + 1].row())]
        for name in ("cut", "n_a", "n_b", "n_groups", "text"):
            assert getattr(parts[0], name) == getattr(whole, name)
        assert (parts[0].keys == whole.keys).all() and (parts[0].times == whole.times).all()
        assert not len(parts[0].prefix["a"]) and not len(parts[0].suffix["b"])


def words_of(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def features_of(text):
    w = words_of(text)
    return [zlib.crc32(x) for x in w] + [zlib.crc32(a + b" " + b) for a, b in zip(w, w[1:], strict=False)]


def test_position_table_equals_crc():
    random.seed(2)
    texts = [*TEXTS, "x" * 255, "y" * 256 + " " + "z" * 300, "é" * 1000 + " b " + "q" * 254 + " t", "a--b 9", "k" * 5000 + " " + "k" * 2000]
    texts += ["".join(random.choice("ab é.Z9") for _ in range(random.randrange(900))) for _ in range(200)]
    row, crc, words = resampling.word_features(*textops.text_bytes(pa.array(texts)))
    for i, text in enumerate(texts):
        assert sorted(crc[row == i].tolist()) == sorted(features_of(text)) and words[i] == len(words_of(text))


def plain_resample(docs, target, percent, least, buckets, seed):
    s, t = (Counter(c % buckets for text in texts for c in features_of(text)) for texts in ([x for _, x in docs], target))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    rows = []
    for doc, text in docs:
        f = [gain[c % buckets] for c in features_of(text)]
        weight = sum(f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(text))])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2], r[5]))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("percent,least,buckets,seed", [(25, 20, 10_000, 7), (60, 0, 16, 3), (100, 1, 1, 7), (0, 1, 9, 7)])
def test_resampling(spark, data, percent, least, buckets, seed):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").union(edge_docs(spark).selectExpr("doc_id + 1000", "text"))
    target = spark.read.parquet(f"{data}/benchmark.parquet")
    got = found(resampling.resample(docs, target, percent, least, buckets, seed))
    assert got == plain_resample([tuple(r) for r in docs.collect()], [r.text for r in target.collect()], percent, least, buckets, seed)


def test_resampling_edges(spark, data):
    target = spark.read.parquet(f"{data}/benchmark.parquet")
    assert resampling.resample(empty_docs(spark), target).collect() == []
    more = edge_docs(spark).withColumns({"bucket": F.lit(1), "rank": F.lit("x"), "able": F.lit(3)})
    assert found(resampling.resample(more, target.limit(0))) == plain_resample([(r.doc_id, r.text) for r in more.collect()], [], 25, 20, 10_000, 7)


def plain_top_k(rows, queries, k):
    def product(x, y):
        return sum(a * b for a, b in zip(x, y, strict=False))

    out = []
    for q, x in queries:
        best = sorted(((-product(x, y), i) for i, y in rows if i is not None and y is not None and i != q), key=lambda p: p)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out, key=str)


def test_top_k_equals_sql(spark, data):
    duck = duckdb.connect()
    duck.sql(f"create view embeddings as select * from '{data}/embeddings.parquet'")
    assert found(topk.op13_topk(spark, data)) == sorted(duck.sql(topk.OP13_SQL).fetchall(), key=str)


@pytest.mark.parametrize("rows_of_a_block,queries_of_a_group", [(512, 1 << 18), (7, 64)])
def test_top_k_edges(spark, monkeypatch, rows_of_a_block, queries_of_a_group):
    """Ties, repeated ids and rows, null ids and vectors, vectors of several lengths, fewer rows than k, negative values."""
    monkeypatch.setattr(topk, "BLOCK_ROWS", rows_of_a_block)
    monkeypatch.setattr(topk, "GROUP_BYTES", queries_of_a_group)
    monkeypatch.setattr(topk, "PARCEL", 5)
    random.seed(4)
    rows = [(random.randrange(150), [random.randrange(-3, 4) for _ in range(random.choice([4, 4, 4, 2, 0]))]) for _ in range(300)]
    rows += [(None, [1, 1, 1, 1]), (7, None), *rows[:20], *[(200 + i, [2, 2, 0, 0]) for i in range(60)]]
    queries = [(i, x) for i, x in rows if i is not None and x is not None and i % 5 == 0] + [(1000, [9, -9, 9, 9]), (1001, []), (1001, [0, 0, 0, 0])]
    tables = [spark.createDataFrame(t, f"{name} long, vec array<bigint>").withColumn("score", F.lit("x")) for name, t in (("vec_id", rows), ("query_id", queries))]
    for k in (1, 20, 1000):
        assert found(topk.top_k(*tables, k)) == plain_top_k(rows, queries, k)
    assert topk.top_k(tables[0].limit(0), tables[1], 5).collect() == [] == topk.top_k(tables[0], tables[1].limit(0), 5).collect()


def test_top_k_takes_no_part(spark):
    """Null vectors, and null or non-finite components."""
    rows = spark.createDataFrame([(0, [0.5, 0.25]), (1, None), (2, [0.5, None]), (3, [float("nan"), 0.0]), (4, [float("inf"), 0.0]), (5, [-0.001, 1.0])], "vec_id long, embedding array<double>")
    kept = rows.filter(topk.usable(F.col("embedding"))).select("vec_id", topk.quantised(F.col("embedding")).alias("vec"))
    assert [(r.vec_id, r.vec) for r in kept.orderBy("vec_id").collect()] == [(0, [32, 16]), (5, [-1, 64])]


def test_scores_are_exact_or_an_error():
    big = np.array([[1 << 30, -(1 << 30) + 1]])
    for x, kind in ((big, np.int64), (big >> 10, np.float64), (big >> 21, np.float32)):
        assert topk.exact_type(x, x) is kind
        assert topk.scores(x, x)[0, 0] == int(x[0, 0]) ** 2 + int(x[0, 1]) ** 2
    with pytest.raises(OverflowError):
        topk.scores(big * 2, big * 2)


def test_blocks_below_the_floor_are_not_scored():
    """Rows in tight clusters: most pairs of query and block are left out, and results are those of all rows."""
    rng = np.random.default_rng(3)
    centers = rng.integers(-60, 60, (40, 16))
    x = np.repeat(centers, 25, axis=0) + rng.integers(-1, 2, (1000, 16))
    q = centers + rng.integers(-1, 2, centers.shape)
    blocks = [(np.arange(a, a + 25), x[a : a + 25]) for a in range(0, 1000, 25)]
    high, low = (np.array([f(b[1], axis=0) for b in blocks]) for f in (np.max, np.min))
    best, scored = topk.search_blocks(q, np.full(40, -1), np.full(40, topk.LEAST), blocks, high, low, 20)
    assert scored < 0.25 * 40 * 40
    wanted = topk.scores(q, x)
    for i in range(40):
        order = np.lexsort((np.arange(1000), -wanted[i]))[:20]
        assert best.row[best.query == i].tolist() == order.tolist()
