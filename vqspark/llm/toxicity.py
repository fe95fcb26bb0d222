"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, over a block-max inverted index.

Terms are words and their beginnings. Those that tell toxic from other examples are chosen on a bounded labelled sample,
by in how many different contexts they are seen, so that copies of one text don't count again; over all terms the nearest
examples are those of the same topic and say little (figures in the README). Document frequencies come from all documents.
The index holds, for every term, the examples with it and their weights, block by block with the largest weight of each
block. It is bounded by the sample, and broadcast. A search adds up the blocks' bounds over the text's terms, takes blocks
from the highest on and ends when no block left can reach the k-th similarity, which is exact. Votes are weighted by
distance, shrunk to the base rate and calibrated by a logistic curve that is fitted to the examples' own votes, each
without itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import textops as T
from .common import held_out, table, trim
from .labelled import SAMPLE, labelled_sample

#: Lengths in bytes of the word beginnings that are terms beside whole words.
PREFIXES = (4, 5, 6, 7)
#: The least contexts of a term in toxic examples; the least deviation from chance.
CONTEXTS, DEVIATION = 8, 8.0
#: With few toxic examples, contexts in this share of their number are enough, but two at least.
SHARE = 0.4
NEIGHBOURS, BLOCK = 25, 64


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of ASCII letters and digits and of bytes of other scripts, in lower-cased bytes; start, end and row."""
    is_word = np.zeros(256, dtype=bool)
    is_word[48:58] = is_word[97:123] = is_word[128:] = True
    return T.word_spans(np.where(is_word[data], data, np.uint8(32)), offsets)


def _terms(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For whole words and for each length of beginnings: which words have such a term, and its hash."""
    everything = np.arange(len(starts))
    yield everything, T.spans_hash(data, starts, ends)
    for n in PREFIXES:
        longer = everything[ends - starts > n]
        yield longer, T.spans_hash(data, starts[longer], starts[longer] + n) ^ np.uint64(0x5BD1E995)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (term, word before it, label) of each step."""
    for batch in batches:
        data, offsets = T.text_bytes(batch.column("text"))
        labels = batch.column("label").to_numpy(zero_copy_only=False)
        for a, b in T.slices(offsets):
            low = T.lower_ascii(data[offsets[a] : offsets[b]])
            starts, ends, row = _words(low, offsets[a : b + 1] - offsets[a])
            if not len(starts):
                continue
            words = T.spans_hash(low, starts, ends)
            before = np.r_[np.uint64(0), words[:-1]]
            before[np.r_[True, row[1:] != row[:-1]]] = 0
            for which, term in _terms(low, starts, ends):
                label = labels[a + row[which]].astype(np.uint64)
                # the label goes to the last bit of the context's hash
                t, c = T.distinct(term, (T.mix(before[which]) & ~np.uint64(1)) | label)
                yield pa.record_batch([pa.array(t.view(np.int64)), pa.array((c >> np.uint64(1)).view(np.int64)), pa.array((c & np.uint64(1)).astype(np.int32))], names=["term", "context", "label"])


def _toxic_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each distinct term of each toxic text."""
    for batch in batches:
        data, offsets = T.text_bytes(batch.column("text"))
        for a, b in T.slices(offsets):
            low = T.lower_ascii(data[offsets[a] : offsets[b]])
            starts, ends, row = _words(low, offsets[a : b + 1] - offsets[a])
            for which, term in _terms(low, starts, ends) if len(starts) else ():
                t, _ = T.distinct(term, row[which].astype(np.uint64))
                yield pa.record_batch([pa.array(t.view(np.int64))], names=["term"])


def choose_terms(sample: DataFrame) -> list[int]:
    """Hashes of the terms that point to toxic examples, the strongest first; as many as the sample gives.

    A term needs CONTEXTS toxic contexts and DEVIATION. Where SHARE of the number of toxic examples is less than CONTEXTS,
    it needs so many toxic contexts, in as many toxic texts, and at most the deviation that they have if all are toxic.
    """
    seen = sample.select("text", "label").mapInArrow(_contexts, "term bigint, context bigint, label int").groupBy("term", "context").agg(F.max("label").alias("label"))
    per_term = seen.groupBy("term").agg(F.count("*").alias("n"), F.sum("label").alias("toxic"))
    base = per_term.agg(F.sum("toxic") / F.sum("n")).first()[0]
    if not base or base >= 1:
        return []
    contexts = min(CONTEXTS, max(2, math.ceil(SHARE * sample.filter("label = 1").count())))
    least = DEVIATION if contexts == CONTEXTS else min(DEVIATION, math.sqrt(contexts * (1 - base) / base) - 1e-9)
    deviation = (F.col("toxic") - F.col("n") * base) / F.sqrt(F.col("n") * base * (1 - base))
    strong = per_term.filter(F.col("toxic") >= contexts).withColumn("z", deviation).filter((F.col("z") >= least) & (F.col("toxic") > 0.5 * F.col("n")))
    if contexts < CONTEXTS:
        texts = sample.filter("label = 1").select("text").mapInArrow(_toxic_texts, "term bigint").groupBy("term").count()
        strong = strong.join(texts.filter(F.col("count") >= contexts), "term", "left_semi")
    return [r.term for r in strong.orderBy(F.desc("z"), "term").select("term").collect()]


class Vocabulary:
    """Looks terms up by hash: a bitmap first, then a binary search."""

    BITS = 20

    def __init__(self, terms: list[int]) -> None:
        self.order = np.argsort(np.array(terms, dtype=np.int64).view(np.uint64), kind="stable")
        self.keys = np.array(terms, dtype=np.int64).view(np.uint64)[self.order]
        self.maybe = np.zeros(1 << self.BITS, dtype=bool)
        self.maybe[self.keys & np.uint64((1 << self.BITS) - 1)] = True

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, term number and count of the terms of each row, in lower-cased bytes."""
        starts, ends, row = _words(data, offsets)
        rows, terms = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        if len(self.keys) and len(starts):
            for which, term in _terms(data, starts, ends):
                hit = self.maybe[term & np.uint64((1 << self.BITS) - 1)]
                which, term = which[hit], term[hit]
                at = np.minimum(np.searchsorted(self.keys, term), len(self.keys) - 1)
                hit = self.keys[at] == term
                rows.append(row[which[hit]])
                terms.append(self.order[at[hit]])
        pair, n = np.unique(np.concatenate(rows) << 32 | np.concatenate(terms), return_counts=True)
        return pair >> 32, pair & 0xFFFFFFFF, n


def document_frequencies(docs: DataFrame, terms: list[int]) -> tuple[int, np.ndarray]:
    """Number of documents, and of those with each term: over all documents, summed in tasks before anything moves."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(terms)
        held, n = np.zeros(len(terms), dtype=np.int64), 0
        for batch in batches:
            data, offsets = T.text_bytes(batch.column("text"))
            n += batch.num_rows
            for a, b in T.slices(offsets):
                _, found, _ = vocabulary.counts(T.lower_ascii(data[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a])
                held += np.bincount(found, minlength=len(terms))
        yield pa.record_batch([pa.array(np.arange(-1, len(terms))), pa.array(np.r_[n, held])], names=["term", "n"])

    rows = docs.select("text").mapInArrow(work, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(terms) + 1, dtype=np.int64)
    for r in rows:
        out[r.term + 1] = r.n
    return int(out[0]), out[1:]


class Index:
    """Examples as sparse unit vectors in blocks: postings by term and block, and the largest weight of each such run.

    `row`, `term` and `count` list the terms of the examples; `ids` and `labels` are those of the examples.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, row: np.ndarray, term: np.ndarray, count: np.ndarray, idf: np.ndarray) -> None:
        self.idf, self.base = idf, (labels.sum() + 1) / (len(labels) + 2)
        weight = (1 + np.log(count)) * idf[term]
        norm = np.sqrt(np.bincount(row, weight**2, len(ids)))
        plain = norm == 0
        self.plain = (labels[plain].sum() + self.base) / (plain.sum() + 1)
        # Examples whose heaviest term is the same stand together, so that blocks have tight bounds.
        heaviest = np.full(len(ids), len(idf), dtype=np.int64)
        by_weight = np.argsort(weight, kind="stable")
        heaviest[row[by_weight]] = term[by_weight]
        order = np.lexsort((ids, heaviest, plain))[: int((~plain).sum())]
        place = np.full(len(ids), -1, dtype=np.int64)
        place[order] = np.arange(len(order))
        self.ids, self.labels = ids[order], labels[order]
        self.blocks = -(-len(order) // BLOCK)
        turn = np.lexsort((place[row], term))
        self.example, self.weight, term = place[row][turn], (weight / np.where(plain, 1, norm)[row])[turn], term[turn]
        block = self.example // BLOCK
        first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])]) if len(term) else np.empty(0, dtype=np.int64)
        self.run, self.run_block = np.r_[first, len(term)], block[first]
        self.run_most = np.maximum.reduceat(self.weight, first) if len(first) else np.empty(0)
        self.runs_of = np.searchsorted(term[first], np.arange(len(idf) + 1))
        self.slope, self.shift = 1.0, 0.0
        self.known: dict[bytes, tuple[float, list[int]]] = {}

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """Positions and similarities of the k nearest examples that share a term, and of all that tie with the last."""
        upper = np.zeros(self.blocks)
        runs = [np.arange(self.runs_of[t], self.runs_of[t + 1]) for t in terms]
        for r, w in zip(runs, weights, strict=True):
            upper[self.run_block[r]] += w * self.run_most[r]
        at, best, least = [], np.zeros(0), 0.0
        for block in np.argsort(-upper, kind="stable"):
            if upper[block] <= 0 or (len(best) >= k and upper[block] < least - 1e-9):
                break
            score = np.zeros(BLOCK)
            for r, w in zip(runs, weights, strict=True):
                i = np.searchsorted(self.run_block[r], block)
                if i < len(r) and self.run_block[r[i]] == block:
                    here = slice(self.run[r[i]], self.run[r[i] + 1])
                    score[self.example[here] - block * BLOCK] += w * self.weight[here]
            found = np.flatnonzero(score > 0)
            at.append(block * BLOCK + found)
            best = np.r_[best, score[found]]
            if len(best) >= k:
                least = np.partition(best, -k)[-k]
        if not at:
            return np.zeros(0, dtype=np.int64), best
        near = np.flatnonzero(best >= least - 1e-9)
        return np.concatenate(at)[near], best[near]

    def vote(self, terms: np.ndarray, counts: np.ndarray, without: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        """The shrunk share of toxic neighbours, and the neighbours; `without` is an example that has no vote."""
        weights = (1 + np.log(counts)) * self.idf[terms]
        at, near = self.nearest(terms, weights / np.sqrt((weights**2).sum()), NEIGHBOURS + (without >= 0))
        at, near = at[at != without], near[at != without]
        votes = 1 / (1.05 - np.minimum(near, 1))
        return float((votes @ self.labels[at] + self.base) / (votes.sum() + 1)), at, near

    def calibrate(self) -> None:
        """Fits the curve from votes to probabilities on the examples' votes, by Newton steps; its prior is no change."""
        term = np.repeat(np.arange(len(self.idf)), self.run[self.runs_of[1:]] - self.run[self.runs_of[:-1]])
        order = np.argsort(self.example, kind="stable")
        cut = np.searchsorted(self.example[order], np.arange(len(self.ids) + 1))
        votes = np.zeros(len(self.ids))
        for i in range(len(self.ids)):
            own = order[cut[i] : cut[i + 1]]
            # the stored weights are the products that `vote` would make, so counts aren't needed
            at, near = self.nearest(term[own], self.weight[own], NEIGHBOURS + 1)
            at, near = at[at != i], near[at != i]
            w = 1 / (1.05 - np.minimum(near, 1))
            votes[i] = (w @ self.labels[at] + self.base) / (w.sum() + 1)
        if len(votes) < 20 or self.labels.min() == self.labels.max():
            return
        x = np.stack([np.log(votes / (1 - votes)), np.ones(len(votes))], axis=1)
        prior = np.array([1.0, 0.0])
        theta = prior.copy()
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
            gradient = x.T @ (p - self.labels) + 4 * (theta - prior)
            theta -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 4 * np.eye(2), gradient)
        if np.isfinite(theta).all() and theta[0] > 0:
            self.slope, self.shift = map(float, theta)

    def score(self, terms: np.ndarray, counts: np.ndarray) -> tuple[float, list[int]]:
        """Calibrated vote and the ids of up to three nearest examples."""
        if not len(terms) or not len(self.ids):
            return float(self.plain), []
        key = terms.tobytes() + counts.tobytes()
        if key not in self.known:
            value, at, near = self.vote(terms, counts)
            value = 1 / (1 + math.exp(-self.slope * math.log(value / (1 - value)) - self.shift))
            evidence = self.ids[at[np.lexsort((self.ids[at], -np.round(near, 9)))[:3]]].tolist()
            if len(self.known) >= 50_000:
                self.known.clear()
            self.known[key] = value, evidence
        return self.known[key]


def _examples(sample: DataFrame, terms: list[int]) -> tuple[np.ndarray, ...]:
    """Ids and labels of the bounded sample, by doc_id, and its terms: row, term, count."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(terms)
        for batch in batches:
            data, offsets = T.text_bytes(batch.column("text"))
            for a, b in T.slices(offsets):
                row, term, count = vocabulary.counts(T.lower_ascii(data[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a])
                cut = pa.array(np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32))
                yield pa.record_batch([batch.column("doc_id").slice(a, b - a), batch.column("label").slice(a, b - a), pa.ListArray.from_arrays(cut, pa.array(term)), pa.ListArray.from_arrays(cut, pa.array(count))], names=["doc_id", "label", "terms", "counts"])

    rows = sorted(sample.mapInArrow(work, "doc_id bigint, label int, terms array<bigint>, counts array<bigint>").collect())
    whole = lambda c: np.array([x for r in rows for x in r[c]], dtype=np.int64)
    ids, labels = (np.array([r[c] for r in rows], dtype=np.int64) for c in ("doc_id", "label"))
    return ids, labels, np.repeat(np.arange(len(rows)), [len(r.terms) for r in rows] or 0), whole("terms"), whole("counts")


def score_toxicity(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted, evidence (ids of the nearest examples).

    `docs` needs doc_id and text, `labels` doc_id and toxic; of other columns, those named in `carry` come along. Labels are learnt from
    the rows that aren't held out alone, at most `most` of them. A text without any term, also a null or empty one, gets
    the rate of toxic examples without terms. Without labels of both kinds every row gets the base rate. Examples that
    tie with the last neighbour all vote. Rows keep their number.
    """
    ship(docs.sparkSession)
    sample = labelled_sample(docs, labels, "toxic", most)
    terms = choose_terms(sample)
    n, held = document_frequencies(docs, terms)
    idf = np.log((n + 1) / (held + 1)) + 1
    examples = _examples(sample, terms)
    index = Index(*examples, idf)
    index.calibrate()
    held_index = docs.sparkSession.sparkContext.broadcast(index)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, index = Vocabulary(terms), held_index.value
        for batch in batches:
            data, offsets = T.text_bytes(batch.column("text"))
            scores, evidence = [], []
            for a, b in T.slices(offsets):
                row, term, count = vocabulary.counts(T.lower_ascii(data[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a])
                cut = np.searchsorted(row, np.arange(b - a + 1))
                for r in range(b - a):
                    value, near = index.score(term[cut[r] : cut[r + 1]], count[cut[r] : cut[r + 1]])
                    scores.append(value)
                    evidence.append(near)
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array(evidence, pa.list_(pa.int64())), *(batch.column(c) for c in carry)], names=["doc_id", "held_out", "score", "evidence", *carry])
        trim()

    types = dict(docs.dtypes)
    schema = "doc_id bigint, held_out boolean, score double, evidence array<bigint>" + "".join(f", {c} {types[c]}" for c in carry)
    scored = docs.select("doc_id", held_out().alias("held_out"), *dict.fromkeys(["text", *carry])).mapInArrow(work, schema)
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "evidence", *carry)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents: doc_id, held_out, score, predicted, evidence."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
