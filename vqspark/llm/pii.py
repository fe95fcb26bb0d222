"""Personal data: rule spans, and spans that boosted trees choose among the proposals of high-recall generators.

Rules find e-mail addresses, IP addresses, card and phone numbers; their spans always stay. Generators propose more,
also overlapping, spans of these kinds and of secrets (keys, tokens, passwords), in time that grows with the text. Boosted
trees judge a proposal by its format and its context. There are no labelled spans, so the trees learn on the proposals of
all documents from a view that their features don't have: for cards the checksum, for phones the leading plus, for IP
addresses the size of the numbers, for secrets the name that one is assigned to (their features are of the token alone).
Thresholds by kind count all proposals, each judged by trees that haven't seen its document. Of overlapping chosen spans
the likelier stays.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import boosting
from .common import parts, table, trim

KINDS = ("email", "ip", "card", "phone", "secret")
#: The precision that thresholds are set for, on so many folds, and the numbers that describe a proposal.
PRECISION, FOLDS, FEATURES = 0.97, 4, 25

# The rules' patterns.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

PROPOSALS = {
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,4}(?:\.[0-9]{1,4}){3}(?![0-9])|(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
    "card": re.compile(r"(?<![0-9])[0-9](?:[ .-]?[0-9]){12,18}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9A-Za-z])(?:\+|00)?\(?[0-9]{1,4}\)?(?:[ .-]?\(?[0-9]{2,4}\)?){2,5}(?![0-9A-Za-z])"),
    "secret": re.compile(r"(?<![A-Za-z0-9_])(?=[A-Za-z_]*[0-9])[A-Za-z0-9_]{12,80}(?![A-Za-z0-9_])"),
}
AT_SIGN = re.compile(r" ?(?:@|\(at\)|\[at\]) ?")
SPELLED_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)+")
DIGITS = re.compile(r"[0-9]+")
NAMED = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|api_?key|key|pwd)[\"']?\s?[=:]\s?[\"']?$")
KEY_FORM = re.compile(r"(?:AKIA[0-9A-Z]{16}|[0-9a-f]{32,64})")
#: Characters on either side of a run of digits that proposals are sought in.
AROUND = 90


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def rule_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the rules, by kind and start; leftmost matches of a kind that don't overlap."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", m.end() if m else at + 1)
    if DIGITS.search(text) is None:
        return out
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(q := p.lstrip("0")) <= 3 and int(q or "0") <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def windows(text: str) -> list[tuple[int, int]]:
    """Stretches around digits and spelled-out at signs, widened to white space."""
    marks = [m.span() for m in DIGITS.finditer(text)]
    for sign in ("@", "(at)", "[at]"):
        at = text.find(sign)
        while at >= 0:
            marks.append((at, at + len(sign)))
            at = text.find(sign, at + 1)
    out: list[list[int]] = []
    for start, end in sorted(marks):
        start, end = max(0, start - AROUND), min(len(text), end + AROUND)
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    for w in out:
        while w[0] > 0 and not text[w[0] - 1].isspace() and w[0] > w[1] - 4 * AROUND:
            w[0] -= 1
    return [tuple(w) for w in out]


def proposals(text: str) -> list[tuple[int, int, int]]:
    """Spans of every kind that may be personal data. Addresses are sought from their signs outwards: every stretch is
    walked once, whatever its length."""
    found, done = set(), 0
    for m in AT_SIGN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = SPELLED_DOMAIN.match(text, m.end()) if start < m.start() else None
        if domain:
            found.add((0, start, domain.end()))
        done = m.end()
    for start, end in windows(text):
        for k, kind in enumerate(KINDS[1:], 1):
            found.update((k, m.start(), m.end()) for m in PROPOSALS[kind].finditer(text, start, end))
    return sorted(found)


def describe(text: str, kind: int, start: int, end: int) -> list[float]:
    """Format and context of a proposal as numbers, without what `truth` looks at; of a secret the format alone."""
    plus = kind == KINDS.index("phone") and text[start] == "+"
    s = text[start + plus : end]
    n = len(s)
    digits = sum("0" <= c <= "9" for c in s)
    upper, lower = sum("A" <= c <= "Z" for c in s), sum("a" <= c <= "z" for c in s)
    groups = re.findall(r"[0-9]+", s)
    before, after = text[max(0, start - 24) : start], text[end : end + 1]
    if kind == KINDS.index("phone"):
        before = before.removesuffix("+")
    if kind == KINDS.index("secret"):
        before = after = ""
    changes = sum((a.isdigit()) != (b.isdigit()) for a, b in zip(s, s[1:], strict=False))
    return [
        kind, n, digits, digits / n, upper / n, lower / n, len(set(s)) / n, len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        s.count("."), s.count("-"), s.count(" "), s.count("("), s.count("@"), s.count(":"), changes / n, all(c in "0123456789abcdef" for c in s),
        before[-1:] != "" and before[-1:] in "\"'=:", before[-1:].isspace() or not before, after.isspace() or not after, after in ".,;)\"'" and after != "",
        before.rstrip()[-1:] == "=", "@" in before[-2:], before[-1:].isalnum(),
    ]


def truth(text: str, kind: int, start: int, end: int, rules: list[tuple[int, int, int]]) -> int | None:
    """What a proposal counts as in learning; None for a token in a known form of key that no telling name is given to."""
    if kind == KINDS.index("secret"):
        if NAMED.search(text[max(0, start - 24) : start]):
            return 1
        return None if KEY_FORM.fullmatch(text, start, end) else 0
    return int(any(s <= start + 1 and end <= e + 1 and (end - start) * 2 > e - s for s, e in _around(rules, kind, start)))


def _around(rules: list[tuple[int, int, int]], kind: int, start: int) -> list[tuple[int, int]]:
    """The rule spans of a kind that may hold a proposal: those of a kind don't overlap and come in order."""
    at = bisect_right(rules, (kind, start + 1, 1 << 62))
    return [r[1:] for r in rules[max(0, at - 2) : at] if r[0] == kind]


def fit(docs: DataFrame) -> tuple[boosting.Trees, list[float]]:
    """Trees and thresholds by kind from the proposals of all documents; documents are dealt to folds by doc_id."""
    ship(docs.sparkSession)
    marked = docs.select("doc_id", "text").filter(F.col("text").rlike("[0-9@]|[(\\[]at[)\\]]"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole, "text"):
                key, x = [], []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    rules = rule_spans(text)
                    fold = hashlib.md5(str(doc_id).encode()).digest()[0] % FOLDS
                    for kind, start, end in proposals(text):
                        if (y := truth(text, kind, start, end, rules)) is not None:
                            key.append((fold, y, kind))
                            x.append(describe(text, kind, start, end))
                if not key:
                    continue
                found = np.hstack([np.array(key, dtype="<u2"), boosting.cells(np.array(x, dtype=np.float64))])
                found, n = np.unique(found.view(f"V{found.shape[1] * 2}").reshape(-1), return_counts=True)
                found = found.view("<u2").reshape(len(n), -1)
                cells = pa.array([r.tobytes() for r in np.ascontiguousarray(found[:, 3:])], pa.binary())
                yield pa.record_batch([*(pa.array(found[:, k].astype(np.int32)) for k in range(3)), cells, pa.array(n)], names=["fold", "y", "kind", "cells", "n"])
        trim()

    seen = marked.mapInArrow(work, "fold int, y int, kind int, cells binary, n bigint")
    trees, steps = boosting.fit_table(seen, FEATURES, FOLDS)
    found = steps.toArrow()
    kind, step, n, hits = (found.column(c).to_numpy() for c in ("kind", "step", "n", "hits"))
    limits = [boosting.threshold(step[kind == k] / boosting.STEPS, hits[kind == k], PRECISION, n[kind == k]) for k in range(len(KINDS))]
    # Where too few proposals are known to prove the precision, the trees' own probability must reach it.
    return trees, [v if v <= 1 else PRECISION for v in limits]


def choose(rules: list[tuple[int, int, int]], offered: list[tuple[int, int, int]], probability: np.ndarray, limits: list[float]) -> list[tuple[int, int, int]]:
    """Rule spans and the likeliest proposals that overlap neither rule spans nor each other; of equals the first."""
    starts, ends = [], []  # what is taken, as stretches apart from each other
    for start, end in sorted((s, e) for _, s, e in rules):
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    out = list(rules)
    good = [i for i in range(len(offered)) if probability[i] >= max(0.5, limits[offered[i][0]])]
    for i in sorted(good, key=lambda i: (-probability[i], offered[i])):
        _, start, end = offered[i]
        at = bisect_right(ends, start)  # the first stretch that ends after the proposal starts
        if at == len(starts) or starts[at] >= end:
            starts.insert(at, start)
            ends.insert(at, end)
            out.append(offered[i])
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, of the first kind."""
    out, at = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e in spans):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


SCHEMA = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint, redacted string"


def find_personal_data(docs: DataFrame, keep_text: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of `docs`: doc_id, counts and digest of the rules' spans, all spans, and the redacted text.

    `docs` needs doc_id and text; of other columns, those named in `carry` (which mustn't be names of results) come along.
    Positions are in code points, ends exclusive. A null text counts as empty in spans and digest and stays null when
    redacted. Without `keep_text` the redacted text is null. Without documents to learn from, rules alone decide.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))
    types = dict(docs.dtypes)
    schema = SCHEMA + "".join(f", {c} {types[c]}" for c in carry)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, limits = model.value
        for whole in batches:
            for batch in parts(whole, "text"):
                texts = batch.column("text").to_pylist()
                rules = [rule_spans(t or "") for t in texts]
                offered = [proposals(t or "") for t in texts]
                x = np.array([describe(t, *c) for t, cs in zip(texts, offered, strict=True) for c in cs], dtype=np.float64)
                p = trees.probability(x) if len(x) else np.zeros(0)
                cut = np.cumsum([0, *map(len, offered)])
                spans = [choose(r, o, p[cut[i] : cut[i + 1]], limits) for i, (r, o) in enumerate(zip(rules, offered, strict=True))]
                counts = [[sum(k == kind for k, _, _ in r) for r in rules] for kind in range(4)]
                text = [redacted(t, s) if keep_text and t is not None else None for t, s in zip(texts, spans, strict=True)]
                yield pa.record_batch(
                    [
                        batch.column("doc_id"),
                        *(pa.array(c, pa.int64()) for c in counts),
                        pa.array([hashlib.sha256(joined(r).encode()).hexdigest() for r in rules], pa.string()),
                        pa.array([joined(s) for s in spans], pa.string()),
                        pa.array([len(s) - len(r) for s, r in zip(spans, rules, strict=True)], pa.int64()),
                        pa.array(text, pa.string()),
                        *(batch.column(c) for c in carry),
                    ],
                    names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "redacted", *carry],
                )
        trim()

    return docs.select("doc_id", "text", *carry).mapInArrow(work, schema)


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents."""
    return find_personal_data(table(spark, sf_dir, "documents"), keep_text=False).drop("redacted")
