"""Operators on single texts and on pairs, against plain Python versions."""

import hashlib
import itertools
import random
import re
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

sys.path.insert(0, str(Path(__file__).parent))
from helpers import TEXTS, edge_docs, empty_docs

from vqspark.llm import bpe, decontamination, fingerprints, licenses, near_dups, pii, repeats, sharding, suffix_arrays, textops


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_components(rows, percent):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return [(doc, len(sets[i]), least.get(root(i))) for i, (doc, _) in enumerate(rows)]


@pytest.mark.parametrize("block", [32, 2])
def test_near_duplicates(spark, data, monkeypatch, block):
    monkeypatch.setattr(near_dups, "BLOCK", block)
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").union(edge_docs(spark).selectExpr("doc_id + 100000", "text"))
    found = sorted(map(tuple, near_dups.near_duplicates(rows, 85).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert found == sorted(brute_components([tuple(r) for r in rows.collect()], 85), key=str)


def test_near_duplicates_star(spark, monkeypatch):
    """A group around a base whose members mostly don't link to each other, and members that share edits."""
    monkeypatch.setattr(near_dups, "BLOCK", 4)
    random.seed(1)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for at in random.sample(range(120), i % 7):
            words[at] = f"edit{i if i % 3 else i // 9}_{at % 5}"
        rows.append((i, " ".join(words)))
    found = sorted(map(tuple, near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).select("doc_id", "n_shingles", "component_id").collect()))
    assert found == sorted(brute_components(rows, 85))


def test_near_duplicates_clusters(spark, monkeypatch):
    """Clusters apart from each other in the same buckets: each gets a leader, and few pairs are ever listed."""
    monkeypatch.setattr(near_dups, "BLOCK", 8)
    random.seed(5)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for cluster in range(4):
        form = list(base)
        for at in range(5, 200, 40):
            form[at] = f"form{cluster}_{at}"
        for i in range(50):
            words = list(form)
            words[random.randrange(200)] = f"own{cluster}_{i}"
            rows.append((cluster * 50 + i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(map(tuple, near_dups.near_duplicates(docs, 85).select("doc_id", "n_shingles", "component_id").collect()))
    assert found == sorted(brute_components(rows, 85))
    assert len({c for _, _, c in found}) == 4
    sketches = docs.selectExpr("xxhash64(doc_id, text) as row_key", "text").mapInArrow(near_dups._sketch, near_dups.SKETCH)
    assert near_dups.links(docs, sketches, 85).count() < 200 * 49 / 2


def test_hashes_of_structured_texts():
    """Thue-Morse words and their complements, which collide under polynomials modulo a power of two."""
    word = bytes(97 + i.bit_count() % 2 for i in range(1024))
    other = bytes(195 - c for c in word)
    for n in (8, 64, 512, 1024):
        data = np.frombuffer(word[:n] + other[:n] + word[:n], dtype=np.uint8)
        starts = np.array([0, n, 2 * n])
        h = textops.spans_hash(data, starts, starts + n)
        assert h[0] == h[2] != h[1]
    encoder = bpe.Encoder(bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY)))
    data = np.frombuffer(word + other, dtype=np.uint8)
    ids, counts = encoder.ids(data, np.array([0, 1024]))
    assert tuple(ids[: counts[0]]) == encoder.merge(word) and tuple(ids[counts[0] :]) == encoder.merge(other)


def test_bpe_when_keys_collide(monkeypatch):
    """Slices of one key are told apart by their marks."""
    monkeypatch.setattr(bpe.Encoder, "hashes", staticmethod(lambda data, starts, ends: (np.zeros(len(starts), dtype=np.int64), textops.spans_hash(data, starts, ends, salt=1))))
    encoder = bpe.Encoder(bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY)))
    words = [b"one", b" two", b" three", b" one", b" two"]
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    starts = np.cumsum([0, *map(len, words)])[:-1]
    for _ in range(2):
        ids, counts = encoder.ids(data, starts)
        assert [tuple(x) for x in np.split(ids, np.cumsum(counts)[:-1])] == [encoder.merge(w) for w in words]


def test_bpe(spark):
    ranks = bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY))
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    random.seed(3)
    signs = ["'", "s", "re", "ll", " ", "  ", "\n", "　", "1", "²", "é", "中", ".", "!", "😀", "'s", "’"]
    texts = TEXTS + ["".join(random.choices(signs, k=50)) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in bpe.encode_decode(docs).collect()}
    for i, t in enumerate(texts):
        ids = reference.encode_ordinary(t or "")
        assert found[i].ids == ids and found[i].n_tokens == len(ids)
        assert found[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
        assert found[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        sizes = [len(x) for x in map(reference.decode_single_token_bytes, ids)]
        assert found[i].offsets == list(itertools.accumulate(sizes, initial=0))[:-1]
    back = bpe.decode(bpe.encode_decode(docs))
    assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in enumerate(texts)}


def test_scan_composes():
    table = bpe.compositions()
    f = np.random.default_rng(0).integers(0, 256, 1000).astype(np.uint8)
    state = 0
    for g, made in zip(f, bpe.scan(f), strict=True):
        state = int(g) >> 2 * state & 3
        assert made & 3 == state
    assert table[0b11100100 << 8 | 77] == 77


PLAIN = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_rules(t):
    out = [(0, m.start(), m.end()) for m in PLAIN[0].finditer(t)]
    out += [(1, m.start(), m.end()) for m in PLAIN[1].finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in PLAIN[2].finditer(t):
        digits = re.sub("[ -]", "", m.group())
        if 16 <= len(digits) <= 19 and pii.luhn(digits):
            out.append((2, m.start(), m.end()))
    return out + [(3, m.start(), m.end()) for m in PLAIN[3].finditer(t) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def test_pii_rules_and_table(spark, data):
    random.seed(2)
    parts = [*"ab1234567890..@@+-() _%Z\n", "1.2.3.4", "4111111111111111", "+1 (499) 555-6503", "a@b.c"]
    for _ in range(5000):
        t = "".join(random.choices(parts, k=random.randint(0, 40)))
        assert pii.rule_spans(t) == plain_rules(t)
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.find_personal_data(docs).collect():
        rules = plain_rules(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(pii.joined(rules).encode()).hexdigest()
        assert {*filter(None, pii.joined(rules).split(","))} <= {*r.spans.split(",")}
    found = pii.find_personal_data(edge_docs(spark), carry=("lang",)).collect()
    assert len(found) == len(TEXTS) + 3 and any(r.redacted == "mail me: [EMAIL] or [PHONE], [IP]" for r in found)


def test_pii_proposals_take_linear_time():
    """Long runs without spaces, dense signs and many spans."""
    for text in ("1" * 1_000_000, "a." * 500_000, "x@" * 300_000, "a@b.c " * 50_000, "key=abc123def456 " * 30_000, "-1" * 400_000, "(at)" * 200_000):
        start = time.process_time()
        rules, offered = pii.rule_spans(text), pii.proposals(text)
        pii.choose(rules, offered, np.full(len(offered), 0.9), [0.5] * 5)
        assert time.process_time() - start < 20, text[:10]


def test_pii_choice():
    """Against trying every span in turn, with ties."""
    random.seed(7)
    for _ in range(300):
        rules = sorted({(k, s, s + random.randint(1, 9)) for k, s in ((random.randint(0, 3), random.randint(0, 60)) for _ in range(4))})
        offered = sorted({(k, s, s + random.randint(1, 9)) for k, s in ((random.randint(0, 4), random.randint(0, 60)) for _ in range(12))})
        p = np.array([random.choice([0.2, 0.6, 0.6, 0.9]) for _ in offered])
        want = list(rules)
        for i in sorted(range(len(offered)), key=lambda i: (-p[i], offered[i])):
            if p[i] >= 0.5 and all(offered[i][2] <= s or e <= offered[i][1] for _, s, e in want):
                want.append(offered[i])
        assert pii.choose(rules, offered, p, [0.5] * 5) == sorted(want)


def test_pii_finds_what_rules_miss(spark):
    """Keys without a telling name are found by their form, as learnt from named ones; plain long words aren't taken."""
    random.seed(9)
    key = lambda: "".join(random.choices("abcdef0123456789", k=40))
    word = lambda: "".join(random.choices("aeioubcdlmnrst", k=random.randint(3, 9)))
    rows = []
    for i in range(600):
        prose = [word() for _ in range(20)]
        prose.insert(5, f"token={key()}" if i % 3 == 0 else f"section{i}of{word()}{i % 7}")
        rows.append((i, " ".join(prose)))
    rows += [(1000 + i, f"some {word()} {key()} text") for i in range(30)]
    found = {r.doc_id: r.spans for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum("secret:" in found[1000 + i] for i in range(30)) >= 28
    assert sum("secret:" in found[i] for i in range(600) if i % 3) <= 12


def test_pii_learns_from_all_documents(spark):
    """What only documents beyond the first thousands by the hash of their ids show is learnt too."""
    random.seed(10)
    key = lambda: "".join(random.choices("abcdef0123456789", k=40))
    ids = [r.id for r in spark.range(5000).selectExpr("id", "xxhash64(id) h").orderBy("h", "id").collect()]
    rows = [(i, f"see section{i}of it") for i in ids[:4200]] + [(i, f"a token={key()} b") for i in ids[4200:]]
    rows += [(10_000 + i, f"some word {key()} text") for i in range(30)]
    found = {r.doc_id: r.spans for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum("secret:" in found[10_000 + i] for i in range(30)) >= 28
    assert not any("secret:" in found[i] for i in ids[:4200])


def ends_paragraph(word):
    data = np.frombuffer(word, dtype=np.uint8)
    return int(textops.spans_hash(data, np.array([0]), np.array([len(word)]))[0]) % fingerprints.PARAGRAPH_WORDS == 0


def paragraphs(t):
    seen, out, known = Counter(), set(), {}
    for line in t.split("\n"):
        part = []
        words = line.encode().split()
        for i, word in enumerate(words):
            part.append(word)
            known.setdefault(word, None)
            if known[word] is None:
                known[word] = ends_paragraph(word)
            if known[word] or i + 1 == len(words):
                seen[tuple(part)] += 1
                out.add((tuple(part), seen[tuple(part)]))
                part = []
    return out


def test_paragraphs_move_with_an_inserted_word():
    words = [f"w{i * 7919 % 1000}" for i in range(400)]
    old, new = paragraphs(" ".join(words)), paragraphs(" ".join([*words[:3], "inserted", *words[3:]]))
    assert len(old & new) >= len(old) - 2


def test_fingerprints(spark):
    docs = edge_docs(spark)
    rows = sorted(((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in docs.collect()), key=lambda r: (r[0], r[1]))
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    found = fingerprints.with_next(docs)[0].mapInArrow(fingerprints._compare, fingerprints.PAIRED).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    wanted = Counter()
    like = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    for (doc, t), (_, n) in zip(rows, rows[1:] + rows[:1], strict=True):
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        wanted[doc, len(t), hashlib.sha256(e.encode()).hexdigest(), round(like(paragraphs(t), paragraphs(e)), 9), round(like(paragraphs(t), paragraphs(n)), 9)] += 1
    assert Counter((r.doc_id if r.doc_id is not None else -1, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in found) == wanted
    same = [r.fingerprint for r in found if r.doc_id == 5]
    assert len(set(same)) == 1
    assert fingerprints.Sketches.parse(same).strings() == same
    changed = fingerprints.changed_paragraphs(spark.createDataFrame([(1, "a b\nc d")], "doc_id long, text string"), spark.createDataFrame([(1, "a b\nc e")], "doc_id long, text string")).first()
    assert len(changed.removed) == len(changed.added) == 1


def brute_repeats(texts):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + 200] for b in raw for i in range(len(b) - 199))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        end = 0
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[max(i, end) : i + 200] = b"\1" * (i + 200 - max(i, end))
                end = i + 200
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_repeats(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(repeats, "CONTEXTS", 5)
        monkeypatch.setattr(repeats, "RANGE", 700)
    random.seed(5)
    text = lambda n: "".join(random.choices("abcdé fg\n", k=n))
    shared = [text(random.randint(190, 700)) for _ in range(5)]
    texts = [text(random.randint(0, 400)) + random.choice(shared)[random.randint(0, 80) :] + text(random.randint(0, 300)) + random.choice([*shared, ""]) for _ in range(50)]
    texts += ["a" * 1500, "ab" * 400, "a" * 150, None, "", shared[0], shared[0], "x" * 199, "x" * 200]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = sorted(map(tuple, repeats.remove_repeats(docs, keep=False).drop("kept").collect()))
    assert found == [(i, *r) for i, r in enumerate(brute_repeats(texts))]


def test_repeats_shards_keep_ranks_and_places_in_a_word(monkeypatch):
    """A shard is closed before the contexts of the next anchor take it beyond its bytes, wherever batches end."""
    monkeypatch.setattr(repeats, "SHARD_BYTES", 2000)
    made = []
    monkeypatch.setattr(repeats, "_shard", lambda batch, hot: iter([made.append((batch.column("anchor").to_pylist(), hot))]))
    names = ["anchor", "salt", "shards", "size"]
    rows = [(a, s, n, 300) for a, s, n, k in ((1, 0, 1, 4), (2, 0, 1, 4), (3, 0, 1, 2), (4, 0, 2, 3), (4, 1, 2, 1), (5, 0, 1, 9), (6, 0, 1, 1)) for _ in range(k)]
    whole = pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)
    for step in (1, 3, 7, 100):
        made.clear()
        list(repeats._shards(whole.slice(i, step) for i in range(0, whole.num_rows, step)))
        assert made == [([1] * 4, False), ([2] * 4 + [3] * 2, False), ([4] * 3, True), ([4], True), ([5] * 9, False), ([6], False)]


@pytest.mark.parametrize("symbols", [2, 60, 256])
def test_order_by_prefix(symbols):
    """Suffixes in order of their first bytes, whatever the alphabet and the length of the text."""
    rng = np.random.default_rng(symbols)
    for n, length in ((0, 5), (1, 5), (40, 3), (900, 200), (900, 30), (5000, 200)):
        block = rng.integers(0, symbols, max(1, n // 3)).astype(np.uint8)
        text = np.resize(block, n)
        text[rng.integers(0, n, n // 200) if n else []] = 1
        at = np.flatnonzero(rng.random(n) < 0.7)
        order, head = suffix_arrays.ordered_by_prefix(text, at, length)
        cut = [text[i : i + length].tobytes() for i in order]
        assert sorted(order) == at.tolist() and cut == sorted(cut)
        assert head.tolist() == [not i or cut[i] != cut[i - 1] for i in range(len(cut))]
    order, head = suffix_arrays._sorted(np.array([7, 5, 7], dtype=np.uint64) << np.uint64(40), np.arange(3, dtype=np.uint64), 21, 44)
    assert order[0] == 1 and head.tolist() == [True, True, False]


def test_suffix_array():
    text = np.frombuffer(b"banana bandana banana ban", dtype=np.uint8)
    order, words = suffix_arrays.suffix_array(text)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tobytes())
    prefix = suffix_arrays.common_prefixes(text, order, words, np.array([0, 7]), np.array([7, 18]), 100)
    for k in range(1, len(order)):
        a, b = text[order[k - 1] :].tobytes(), text[order[k] :].tobytes()
        assert prefix[k] == next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))


def test_licenses(spark):
    docs = spark.createDataFrame([(1, "Some text. Licensed under the Apache License, Version 2.0. More text follows here."), (2, None), (3, ""), (4, "Released under the MIT License."), (5, dict(licenses.TEMPLATES)["BSD-3-Clause"].replace("binary", "object"))], "doc_id long, text string")
    found = {(r.doc_id, r.license_id) for r in licenses.scan_licenses(docs, licenses.known_templates(spark)).collect()}
    assert found == {(1, "Apache-2.0-line"), (4, "MIT-line")}
    assert licenses.scan_licenses(edge_docs(spark), licenses.known_templates(spark)).count() == 0


@pytest.mark.parametrize("broadcast", [licenses.MOST_BROADCAST, 0])
def test_licenses_anywhere(spark, monkeypatch, broadcast):
    """Every notice at the start, middle and end of many texts, against the SQL; also with shuffled templates."""
    monkeypatch.setattr(licenses, "MOST_BROADCAST", broadcast)
    random.seed(6)
    prose = lambda n: " ".join("".join(random.choices("abcdefgh", k=5)) for _ in range(n))
    rows = [" ".join((prose(a), notice, prose(b))) for _, notice in licenses.TEMPLATES for _ in range(40) for a, b in ((0, 30), (random.randint(5, 30), 30), (30, 0))]
    documents = pd.DataFrame({"doc_id": range(len(rows)), "text": rows})
    wanted = {r[:2] for r in duckdb.sql(licenses.OP4_SQL).fetchall()}
    found = {(r.doc_id, r.license_id) for r in licenses.scan_licenses(spark.createDataFrame(documents), licenses.known_templates(spark)).collect()}
    assert len(wanted) >= len(rows) and found == wanted


def test_decontamination(spark):
    items = spark.createDataFrame([(1, "If Alice walks 12 km and Bob walks 7 km then how far does Alice walk more than Bob today"), (2, None), (3, "")], "item_id long, text string")
    docs = [(1, "Well. If Carol walks 99 km and Dave walks 3 km then how far does Carol walk more than Dave today ok"), (2, "If Carol walks 99 km and Dave walks 3 km then how far does Frank walk more than Dave today"), (3, "If Alice walks 12 km and Bob walks 7 km then how far does Alice walk more than Bob today"), (4, None), (5, ""), (6, "nothing of that kind here")]
    found = {(r.doc_id, r.item_id, r.reparameterised) for r in decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert found == {(1, 1, True), (3, 1, False)}
    assert decontamination.contaminated(edge_docs(spark), items).count() == 0


def test_short_notices_with_a_lost_end(spark):
    """A notice of five shingles of which one is lost has 0.8 of them, at whatever place it stands."""
    notice = "terms apply to every copy of this thing here"
    templates = spark.createDataFrame([("five", notice), ("none", None), (None, notice)], "license_id string, text string")
    cut = [" ".join(notice.split()[1:]), " ".join(notice.split()[:-1])]
    docs = [(i, " ".join([*(f"x{i}y{k}" for k in range(i % 9)), cut[i % 2], *(f"z{i}y{k}" for k in range(9))])) for i in range(400)]
    found = licenses.scan_licenses(spark.createDataFrame(docs + docs[:5], "doc_id long, text string"), templates).collect()
    assert sorted((r.doc_id, r.license_id, r.n_matched) for r in found) == [(i, "five", 4) for i in range(400)]


ITEMS = [
    (1, "Natalia sold 48 clips to her friends in April and then she sold half as many in May. Natalia wants to know how many clips she sold in all."),
    (2, "12 13 14 15 16 17 18 19"),
    (3, "blue whales sing"),
    (4, "Yes"),
    (5, "Compute 3 4 5 6 7 8 and tell Bob the sum of all the numbers that you have seen here."),
    (6, None),
]
CASES = [
    (1, "Lead. Maria sold 51 clips to her friends in June and then she sold half as many in July. Maria wants to know how many clips she sold in all. End."),
    (2, "Maria sold 51 clips to her friends in June and then she sold half as many in July. Petra wants to know how many clips she sold in all."),
    (3, "The row is 12 13 14 15 16 17 18 19 and no more"),
    (4, "The row is 22 13 14 15 16 17 18 29 and no more"),
    (5, "It is said that blue whales sing at night"),
    (6, "It is said that blue birds sing at night"),
    (7, "yes"),
    (8, "Well yes of course it is"),
    (9, "Compute 3 4 5 6 7 8 and tell Bob the sum of all the numbers that you have seen here."),
    (10, "Compute 3 4 5 9 7 8 and tell Eve the sum of all the numbers that you have seen here."),
    (11, "Natalia sold 48 clips to her friends in April and then she sold half as many in May. Natalia wants to know how many clips she sold in all. " * 3),
]


@pytest.mark.parametrize("broadcast", [decontamination.MOST_BROADCAST, -1])
def test_decontamination_recall(spark, monkeypatch, broadcast):
    """Rewritten sentence-initial names, rows of numbers, short items, repeated rows; by both joins, against the SQL."""
    monkeypatch.setattr(decontamination, "MOST_BROADCAST", broadcast)
    random.seed(8)
    prose = lambda n: " ".join("".join(random.choices("abcdefgh", k=5)) for _ in range(n))
    rows = CASES + [(100 + i, f"{prose(i % 7)} {t} {prose(i % 5)}") for i, (_, t) in enumerate(CASES * 5)] + [(300, None), (301, ""), CASES[0]]
    documents, benchmark = pd.DataFrame(rows, columns=["doc_id", "text"]), pd.DataFrame(ITEMS, columns=["item_id", "text"])
    wanted = sorted(duckdb.sql(decontamination.OP7_SQL).fetchall())
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    found = sorted(map(tuple, decontamination.contaminated(docs, items.union(items)).collect()))
    assert found == [(d, i, n, m, pytest.approx(c), r) for d, i, n, m, c, r in wanted]
    assert {(d, i, r) for d, i, _, _, _, r in found if d < 100} == {(1, 1, True), (3, 2, False), (5, 3, False), (7, 4, False), (9, 5, False), (10, 5, True), (11, 1, False)}


@pytest.mark.parametrize(("piece", "broadcast"), [(1, decontamination.MOST_BROADCAST), (7, decontamination.MOST_BROADCAST), (7, -1)])
def test_decontamination_of_long_texts_in_pieces(spark, monkeypatch, piece, broadcast):
    """No row holds the words of a whole long text, and items that lie across the ends of pieces are found as by the SQL."""
    monkeypatch.setattr(decontamination, "PIECE", piece)
    monkeypatch.setattr(decontamination, "MOST_BROADCAST", broadcast)
    random.seed(9)
    prose = lambda n: " ".join("".join(random.choices("abcdefgh", k=5)) for _ in range(n))
    rows = [(i, f"{prose(n)} {t}{' ' + prose(2 * n) if i % 2 else ''}") for i, (n, (_, t)) in enumerate((n, c) for n in (1, 5, 13, 20) for c in CASES)]
    documents, benchmark = pd.DataFrame(rows, columns=["doc_id", "text"]), pd.DataFrame(ITEMS, columns=["item_id", "text"])
    wanted = sorted(duckdb.sql(decontamination.OP7_SQL).fetchall())
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert len(wanted) > 16 and sorted(map(tuple, decontamination.contaminated(docs, items).collect())) == [(d, i, n, m, pytest.approx(c), r) for d, i, n, m, c, r in wanted]
    most = decontamination._tokens(docs, ["doc_id"]).selectExpr("max(size(tokens))", "max(size(core))").first()
    assert max(most) <= piece + decontamination.WORDS


def filled(names, slots):
    """The lookup table by turns, step by step."""
    start, step = ([int(hashlib.md5(f"{what}:{n}".encode()).hexdigest()[:8], 16) for n in names] for what in ("offset", "step"))
    owner, seen = [None] * slots, [0] * len(names)
    for turn in range(slots):
        i = turn % len(names)
        while owner[at := (start[i] % slots + seen[i] * (step[i] % (slots - 1) + 1)) % slots] is not None:
            seen[i] += 1
        owner[at] = names[i]
        seen[i] += 1
    return owner


@pytest.mark.parametrize("shards,slots,steps", [(1, 7, 32_768), (3, 101, 50), (5, 5, 3), (24, 2039, 4096)])
def test_lookup_table(spark, monkeypatch, shards, slots, steps):
    monkeypatch.setattr(sharding, "STEPS", steps)
    names = [f"n{k}" for k in range(shards)]
    assert [r.shard for r in sharding.lookup_table(spark, names, slots).orderBy("slot").collect()] == filled(names, slots)


def test_sharding(spark):
    names = [f"s{k}" for k in range(5)]
    lookup = sharding.lookup_table(spark, names, 101)
    sizes = [r["count"] for r in lookup.groupBy("shard").count().collect()]
    assert sum(sizes) == 101 and max(sizes) - min(sizes) <= 1 and lookup.select("slot").distinct().count() == 101
    fewer = {r.slot: r.shard for r in sharding.lookup_table(spark, names[:4], 101).collect()}
    moved = sum(r.shard != "s4" and fewer[r.slot] != r.shard for r in lookup.collect())
    assert moved < 50
    hot = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(900)] + [(None, 1)], "key string, id long")
    placed = sharding.assign_shards(hot, "key", lookup, 101, spread_by="id")
    assert placed.count() == 901 and placed.filter("key = 'hot'").select("slot").distinct().count() > 15
    with pytest.raises(ValueError):
        sharding.lookup_table(spark, names, 100)


@pytest.mark.parametrize("name", ["near", "bpe", "pii", "fingerprints", "repeats", "licenses", "decontamination", "sharding"])
def test_empty_tables(spark, name):
    docs = empty_docs(spark)
    items = spark.createDataFrame([], "item_id long, text string")
    made = {
        "near": lambda: near_dups.near_duplicates(docs), "bpe": lambda: bpe.encode_decode(docs), "pii": lambda: pii.find_personal_data(docs),
        "fingerprints": lambda: fingerprints.with_next(docs)[0], "repeats": lambda: repeats.remove_repeats(docs), "licenses": lambda: licenses.scan_licenses(docs, licenses.known_templates(spark)),
        "decontamination": lambda: decontamination.contaminated(docs, items), "sharding": lambda: sharding.assign_shards(docs, "doc_id", sharding.lookup_table(spark, ["a"], 7), 7),
    }[name]()
    assert made.count() == 0
