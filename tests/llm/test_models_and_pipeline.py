"""Learnt operators by held-out accuracy, exact search against brute force, and the pipeline step by step."""

import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
from helpers import TEXTS, edge_docs, empty_docs

import corpus_pipeline
from vqspark.llm import boosting, decontamination, near_dups, pii, quality, toxicity


def labelled(spark, n=600):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(n):
        bad, junk = bool(rng.random() < 0.3), bool(rng.random() < 0.3)
        text = list(rng.choice(words, 40)) + ([str(x) for x in rng.choice(["scumword", "trashword"], 2)] if bad else [])
        rng.shuffle(text)
        rows.append((i, " ".join(t + ("***" if junk else "") for t in text)))
        labels.append((i, int(not junk), int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_and_quality(spark):
    docs, labels = labelled(spark)
    truth = {r.doc_id: r for r in labels.collect()}
    for made, column in ((toxicity.score_toxicity(docs, labels), "toxic"), (quality.score_quality(docs, labels), "quality")):
        held = [r for r in made.collect() if r.held_out]
        assert len(held) > 50 and sum(r.predicted == truth[r.doc_id][column] for r in held) >= 0.95 * len(held)
        assert all(0 <= r.score <= 1 for r in held)


def test_held_out_labels_do_not_matter(spark):
    docs, labels = labelled(spark, 200)
    flipped = labels.selectExpr("doc_id", "quality", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - toxic, toxic) as toxic")
    a, b = (sorted((r.doc_id, r.score) for r in toxicity.score_toxicity(docs, x).collect()) for x in (labels, flipped))
    assert a == b


def test_toxicity_with_few_labels(spark, data):
    """About ten toxic labels: those held out are found, and no clean text is."""
    docs, labels = labelled(spark, 45)
    for d, x in ((spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")), (docs, labels)):
        truth = {r.doc_id: r.toxic for r in x.filter("toxic in (0, 1)").collect()}
        held = [r for r in toxicity.score_toxicity(d, x).collect() if r.held_out and r.doc_id in truth]
        learnt = {r.doc_id for r in toxicity.labelled_sample(d, x, "toxic").filter("label = 1").collect()}
        assert 5 <= len(learnt) <= 15 and any(truth[r.doc_id] for r in held)
        assert all(r.predicted == truth[r.doc_id] for r in held)


def test_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 1), (2, None, None), (77, 3, 9)], "doc_id long, quality int, toxic int")
    for docs, n in ((edge_docs(spark), len(TEXTS) + 3), (empty_docs(spark), 0)):
        assert toxicity.score_toxicity(docs, labels).count() == n
        assert quality.score_quality(docs, labels).count() == n


def dense_index(counts, labels, idf):
    row, term = np.nonzero(counts)
    index = toxicity.Index(np.arange(len(counts)), labels, row, term, counts[row, term], idf)
    vectors = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * idf
    return index, vectors[index.ids] / np.linalg.norm(vectors[index.ids], axis=1, keepdims=True)


def test_block_max_search_is_exact():
    rng = np.random.default_rng(1)
    counts = rng.poisson(0.3, (700, 12))
    index, vectors = dense_index(counts, rng.integers(0, 2, 700), np.linspace(1, 3, 12))
    assert set(index.ids) == set(np.flatnonzero(counts.any(axis=1)))
    for _ in range(50):
        terms = np.sort(rng.choice(12, rng.integers(1, 5), replace=False))
        weights = rng.random(len(terms))
        weights /= np.linalg.norm(weights)
        at, near = index.nearest(terms, weights)
        every = vectors[:, terms] @ weights
        least = np.sort(every)[-toxicity.NEIGHBOURS]
        assert sorted(at.tolist()) == np.flatnonzero((every >= least - 1e-9) & (every > 0)).tolist()
        assert np.allclose(near, every[at])


def test_votes_are_calibrated():
    """Where terms tell half of the truth, scores on new texts are near the shares that they stand for."""
    rng = np.random.default_rng(4)
    counts = rng.poisson(0.5, (4000, 8))
    chance = 1 / (1 + np.exp(3 - 1.2 * counts[:, :4].sum(axis=1)))
    labels = (rng.random(4000) < chance).astype(int)
    index, _ = dense_index(counts[:2000], labels[:2000], np.ones(8))
    index.calibrate()
    scores = np.array([index.score(np.flatnonzero(c), c[np.flatnonzero(c)])[0] for c in counts[2000:]])
    for low, high in ((0, 0.2), (0.2, 0.5), (0.5, 1.01)):
        some = (scores >= low) & (scores < high)
        assert some.sum() > 50 and abs(scores[some].mean() - labels[2000:][some].mean()) < 0.1
    assert index.slope != 1.0


def test_terms_have_no_cap(spark):
    """Hundreds of telling words, each in a few texts, are all terms."""
    rng = np.random.default_rng(3)
    words = lambda form, n: " ".join(f"{rng.integers(1e9)} {form}{rng.integers(300)}x" for _ in range(n))
    rows = [(i, words("bad", 8) if i % 10 == 0 else words("good", 8), int(i % 10 == 0)) for i in range(6000)]
    sample = spark.createDataFrame(rows, "doc_id long, text string, label int")
    assert len(toxicity.choose_terms(sample)) >= 300


def test_boosting():
    rng = np.random.default_rng(2)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(int)
    model = boosting.fit(x[:1500], y[:1500])
    p = model.probability(x[1500:])
    assert ((p > 0.5) == y[1500:]).mean() > 0.97
    assert boosting.threshold(np.array([0.9, 0.8, 0.7]), np.array([1, 1, 0]), 0.5) <= 0.8


def test_boosting_of_a_table_equals_that_of_arrays(spark, monkeypatch):
    monkeypatch.setattr(boosting, "TREES", 4)
    monkeypatch.setattr(boosting, "WRITTEN", 2)
    rng = np.random.default_rng(3)
    x = np.stack([rng.integers(0, 9, 3000), rng.random(3000) * 3, rng.integers(0, 2000, 3000)], axis=1).astype(float)
    y, fold, kind = (x[:, 0] * x[:, 1] + rng.random(3000) > 8).astype(int), rng.integers(0, 3, 3000), rng.integers(0, 2, 3000)
    rows = [(int(f), int(t), int(k), c.tobytes(), 1) for f, t, k, c in zip(fold, y, kind, boosting.cells(x), strict=True)]
    table = spark.createDataFrame(rows, "fold int, y int, kind int, cells binary, n long")
    plain = boosting.fit(x, y)
    found = []
    for direct, parts in ((32, 1), (0, 7)):
        monkeypatch.setattr(boosting, "DIRECT", direct)
        model, steps = boosting.fit_table(table.repartition(parts), 3, 3)
        assert len(model.leaves) == 4
        for name in ("columns", "cuts", "leaves"):
            assert np.array_equal(getattr(model, name), getattr(plain, name))
        found.append(sorted(map(tuple, steps.collect())))
    assert found[0] == found[1]
    assert sum(r[2] for r in found[0]) == 3000 and sum(r[3] for r in found[0]) == y.sum()


def test_pipeline(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    labels = spark.read.parquet(f"{data}/labels.parquet")
    toxic = {r.doc_id for r in toxicity.score_toxicity(docs, labels).collect() if r.predicted}
    left = docs.filter(~docs.doc_id.isin(*toxic)) if toxic else docs
    groups = {r.doc_id: r.component_id for r in near_dups.near_duplicates(left, corpus_pipeline.SIMILARITY).collect()}
    kept = {d for d, c in groups.items() if d == c}
    bad = {r.doc_id for r in decontamination.contaminated(docs.filter(docs.doc_id.isin(*kept)), spark.read.parquet(f"{data}/benchmark.parquet")).collect()}
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, data).collect()}
    assert set(found) == kept - bad
    plain = [d for d in found if not pii.proposals(texts[d]) and not pii.rule_spans(texts[d])]
    import hashlib

    assert plain and all(found[d].decoded_sha256 == hashlib.sha256(texts[d].encode()).hexdigest() for d in plain)


def test_pipeline_edges(spark, data):
    for docs in (edge_docs(spark), empty_docs(spark)):
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, data)
            assert name == "tokens" or docs.columns == list(corpus_pipeline.COLUMNS)
        docs.count()


def plain_leader(texts, labels):
    """Follow-the-regularised-leader with dictionaries over the n-grams themselves: a function that scores a text."""
    import re

    def grams(text):
        tokens = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x09-\x0d\x20]+", (text or "").encode())
        found = {}
        for g in [(t,) for t in tokens] + ["same" if a == b else (a, b) for a, b in zip(tokens, tokens[1:], strict=False)]:
            found[g] = found.get(g, 0) + 1
        total = max(1, sum(found.values()))
        return {g: n / total**0.5 for g, n in found.items()}

    z, n = {}, {}
    mean = (sum(labels) + 1) / (len(labels) + 2)
    bias = np.log(mean / (1 - mean))

    def weight(g):
        if abs(z.get(g, 0.0)) <= quality.L1:
            return 0.0
        return -(z[g] - np.sign(z[g]) * quality.L1) / ((quality.BETA + n[g] ** 0.5) / quality.ALPHA + quality.L2)

    def score(text):
        return 1 / (1 + np.exp(-(bias + sum(weight(g) * x for g, x in grams(text).items()))))

    for epoch in range(quality.EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(texts)):
            p, x = score(texts[i]), grams(texts[i])
            held = {g: weight(g) for g in x}
            for g, v in x.items():
                step = (p - labels[i]) * v
                sigma = ((n.get(g, 0.0) + step * step) ** 0.5 - n.get(g, 0.0) ** 0.5) / quality.ALPHA
                z[g] = z.get(g, 0.0) + step - sigma * held[g]
                n[g] = n.get(g, 0.0) + step * step
    return score


def test_quality_equals_a_plain_follow_the_regularised_leader(spark):
    """Scores of all texts against dictionaries without hashing: few enough words that no two n-grams share a weight."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(12)] + ["good", "!!", "é"]
    texts = [None, "", "  "] + [" ".join(rng.choice(words, int(rng.integers(1, 30)))) for _ in range(300)]
    rows = [(i, t, int("good" in (t or "") or rng.random() < 0.1)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    learnt = sorted(quality.labelled_sample(docs, labels, "quality").collect(), key=lambda r: r.doc_id)
    score = plain_leader([r.text for r in learnt], [r.label for r in learnt])
    found = {r.doc_id: r for r in quality.score_quality(docs, labels).collect()}
    assert len(found) == len(rows) and len(learnt) > 200
    assert all(abs(found[i].score - score(t)) < 1e-5 and found[i].predicted == (found[i].score >= 0.3) for i, t, _ in rows)


def test_decontamination_stage_judges_rows_by_their_own_text(spark, data):
    item = spark.read.parquet(f"{data}/benchmark.parquet").first().text
    clean = [f"nothing of the kind stands in clean row number {i} of this small table, all of its words are its own" for i in range(4)]
    rows = [(None, f"some words before {item} and after"), (None, clean[0]), (5, clean[1]), (5, f"again {item} here"), (5, clean[2]), (6, None), (7, clean[3]), (7, clean[3])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.decontamination(spark, docs, data)
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([r for r in rows if r[1] is None or item not in r[1]], key=str)


def test_decontamination_stage_cuts_long_texts(spark, data, monkeypatch):
    """Whatever piece an item starts in, its document goes; the words of a long text never stand in one row."""
    monkeypatch.setattr(decontamination, "PIECE", 16)
    item = spark.read.parquet(f"{data}/benchmark.parquet").first().text
    filler = [" ".join(f"own{i}x{k}" for k in range(300)) for i in range(20)]
    rows = [(i, f"{' '.join(t.split()[:i + 20])} {item} {t}" if i % 2 else t) for i, t in enumerate(filler)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.decontamination(spark, docs, data)
    assert sorted((r.doc_id, r.text) for r in left.collect()) == [r for r in rows if r[0] % 2 == 0]
    assert decontamination._tokens(docs, ["doc_id"]).selectExpr("max(size(tokens))").first()[0] <= 16 + decontamination.WORDS


def test_addresses_of_thousands_of_digits():
    for zeros in (5, 5000, 100_000):
        text = "at " + "0" * zeros + "1.1.1.1 and " + "9" * zeros + ".1.1.1 and 0." + "0" * zeros + ".0.255"
        spans = [s for s in pii.rule_spans(text) if pii.KINDS[s[0]] == "ip"]
        assert [text[a:b].replace("0", "") for _, a, b in spans] == ["1.1.1.1", "...255"]
        assert pii.proposals(text) is not None
