"""Near-duplicate documents by min-max hashing of five-word shingles.

Each permutation of the shingle hashes gives two signature values, its minimum and its maximum: half the hash
evaluations of plain min-hashing for an estimate that is as unbiased and varies less. Bands of the signatures find
candidate pairs; a pair is a link only if its full shingle sets pass the threshold exactly.

How groups of any size stay affordable and whole:

* Texts with equal shingle sets are one class from the start (grouped by a 128-bit digest, with partial aggregation).
* A bucket of at most BLOCK classes gives its pairs; after an estimate from the signatures they are verified.
* A larger bucket never gives its pairs. Its most central member is its leader, which buckets with mostly the same members
  share (see `_shared_leaders`), and each member is compared with the leader alone, which yields the symmetric difference of both sets. For two members x and y the difference of their
  sets is the difference of these differences. Members that link to the leader are in one component.
* A member x that is left can link to another one y only if their differences share over half of y's, so a join on y's
  rarest elements (a prefix filter, exact) finds every such pair without a quadratic list, as edits are mostly one's own.
  Where many of those left share theirs (a cluster of its own), the join would list all their pairs: these are counted
  first, and if there are over CROWD for each member, those left are a bucket with a new leader, and so on. Each round
  settles a cluster; a leader that settles less than one member in FRUITFUL isn't followed by another one.
* Texts move once, and only those of one member of each class that has a candidate; a leader that many members meet is
  one key of a join with both sides shuffled, which Spark splits when it is skewed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import ship
from . import textops as T
from .common import durable, table, trim
from .components import components

#: Bands, rows of a band, and so permutations: a pair is missed with a chance of (1 - s**5)**20,
#: below 2e-5 at a similarity of 85 in 100 and 4e-4 at 80; copies in groups have many chances.
BANDS, ROWS = 20, 5
PERMUTATIONS = BANDS * ROWS // 2
#: The largest bucket whose pairs are listed.
BLOCK = 32
#: Pairs whose signatures agree this much less than the threshold aren't verified: five standard deviations at 80 in 100.
SLACK = 0.2
#: Pairs of a bucket's unsettled members, for each of them, from which on another leader is better than listing them; a
#: leader that settles fewer than one in FRUITFUL members isn't followed by another one, the first excepted.
CROWD, FRUITFUL = 64, 16

SKETCH = "row_key bigint, n_shingles bigint, digest binary, bands array<bigint>, signature binary"


def shingle_sets(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and hash of each distinct shingle, sorted by both, and each row's digest (two numbers).

    The digest is a cryptographic one over two independent hashes of every shingle, so that equal digests are equal sets;
    rows without shingles get zeros.
    """
    n = len(offsets) - 1
    row, value, other = T.shingle_hashes(low, offsets, salts=(0, 1))
    order = np.lexsort((value, row))
    row, value, other = row[order], value[order], other[order]
    keep = np.r_[True, (row[1:] != row[:-1]) | (value[1:] != value[:-1])] if len(row) else np.empty(0, dtype=bool)
    row, value, pairs = row[keep], value[keep], np.stack([value[keep], other[keep]], axis=1)
    cut = np.searchsorted(row, np.arange(n + 1))
    empty = bytes(16)
    digests = b"".join(hashlib.blake2b(pairs[a:b].tobytes(), digest_size=16).digest() if b > a else empty for a, b in zip(cut, cut[1:], strict=False))
    return row, value, np.frombuffer(digests, dtype=np.uint64).reshape(n, 2)


def signatures(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Minimum and maximum under each permutation, side by side."""
    out = np.zeros((n, 2 * PERMUTATIONS), dtype=np.uint64)
    if len(value):
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        with np.errstate(over="ignore"):
            for k, factor in enumerate(T.seeds(PERMUTATIONS, 3)):
                permuted = value * factor
                out[row[starts], 2 * k] = np.minimum.reduceat(permuted, starts)
                out[row[starts], 2 * k + 1] = np.maximum.reduceat(permuted, starts)
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    salts = T.seeds(ROWS, 9)
    for batch in batches:
        data, offsets = T.text_bytes(batch.column("text"))
        for a, b in T.slices(offsets):
            low = T.lower_ascii(data[offsets[a] : offsets[b]])
            row, value, digest = shingle_sets(low, offsets[a : b + 1] - offsets[a])
            n = b - a
            sizes = np.bincount(row, minlength=n).astype(np.int64)
            marks = signatures(row, value, n)
            with np.errstate(over="ignore"):
                bands = T.mix((marks.reshape(n, BANDS, ROWS) * salts).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
            short = T.mix(marks).astype(np.uint8)
            yield pa.record_batch(
                [
                    batch.column("row_key").slice(a, n),
                    pa.array(sizes),
                    _fixed(digest),
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(bands.reshape(-1).view(np.int64))),
                    _fixed(short),
                ],
                names=["row_key", "n_shingles", "digest", "bands", "signature"],
            )
    trim()


def _fixed(values: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary."""
    flat = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1)
    ends = np.arange(len(values) + 1, dtype=np.int32) * flat.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(ends), pa.py_buffer(flat.tobytes())])


class _Sets:
    """Shingle sets of texts by their digest; the last few are held, as pairs come sorted by their second text."""

    def __init__(self) -> None:
        self.held: dict[bytes, np.ndarray] = {}

    def __call__(self, digest: bytes, text: str | None) -> np.ndarray:
        if digest not in self.held:
            if len(self.held) >= 64:
                self.held.clear()
            data = np.frombuffer((text or "").encode(), dtype=np.uint8)
            self.held[digest] = shingle_sets(T.lower_ascii(data), np.array([0, len(data)]))[1]
        return self.held[digest]


VERIFIED = "a binary, b binary, n_a bigint, n_b bigint, common bigint, gone array<bigint>, added array<bigint>"


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets = _Sets()
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("a", "b", "n_a", "n_b", "common", "gone", "added")}
        for a, b, text_a, text_b, hot in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b", "hot")), strict=True):
            x, y = sets(a, text_a), sets(b, text_b)
            common = len(np.intersect1d(x, y, assume_unique=True))
            gone, added = (np.setdiff1d(p, q, assume_unique=True).view(np.int64) if hot else None for p, q in ((y, x), (x, y)))
            for k, v in zip(out, (a, b, len(x), len(y), common, gone, added), strict=True):
                out[k].append(v)
        yield pa.record_batch(
            [pa.array(out["a"], pa.binary()), pa.array(out["b"], pa.binary()), *(pa.array(out[k], pa.int64()) for k in ("n_a", "n_b", "common")), *(pa.array(out[k], pa.list_(pa.int64())) for k in ("gone", "added"))],
            names=list(out),
        )


def row_key() -> F.Column:
    return F.xxhash64("doc_id", "text")


def _agree(a: str, b: str) -> F.Column:
    """Share of equal signature bytes, less what chance gives."""
    n = 2 * PERMUTATIONS
    hex_a, hex_b = F.hex(a), F.hex(b)
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: hex_a.substr(i * 2 + 1, F.lit(2)) == hex_b.substr(i * 2 + 1, F.lit(2))))
    return same / n


def links(docs: DataFrame, sketches: DataFrame, threshold: int) -> DataFrame:
    """(a, b): set digests of linked classes, enough of them that components are those of all links."""
    linked = f"100 * common >= {threshold} * (n_a + n_b - common)"
    classes = durable(sketches.filter("n_shingles > 0").groupBy("digest").agg(F.min("row_key").alias("row_key"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("signature").alias("signature")))
    buckets = classes.select("digest", "n", F.posexplode("bands").alias("band", "value"))
    counts = buckets.groupBy("band", "value").count().filter("count > 1").withColumnRenamed("count", "size")
    buckets = durable(buckets.join(counts, ["band", "value"]).select("digest", "n", "band", "value", "size"))
    # One text of each class that has a candidate; rows of equal keys are equal.
    wanted = classes.select("digest", "row_key").join(buckets.select("digest").distinct(), "digest")
    texts = durable(docs.select(row_key().alias("row_key"), "text").join(wanted, "row_key").select("digest", "text").dropDuplicates(["digest"]))

    def verified(pairs: DataFrame, hot: bool) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(texts.withColumnsRenamed({"digest": side, "text": f"text_{side}"}), side)
        return durable(pairs.withColumn("hot", F.lit(hot)).mapInArrow(_verify, VERIFIED))

    small = buckets.filter(f"size <= {BLOCK}")
    large = buckets.filter(f"size > {BLOCK}")
    found, first = [], True
    while not large.isEmpty():
        # Each member with the bucket's leader, the member that shares the most with the large buckets.
        central = large.groupBy("digest").agg(F.sum("size").alias("weight"))
        # Written, so that the joins of buckets with their leaders have two shuffled sides and a large one can be split.
        leaders = durable(large.join(central, "digest").groupBy("band", "value").agg(F.max_by("digest", F.struct("weight", "digest")).alias("leader")))
        leaders = durable(_shared_leaders(large, leaders, central))
        led = large.join(leaders, ["band", "value"]).filter("digest <> leader")
        stars = verified(led.select(F.col("digest").alias("a"), F.col("leader").alias("b")).distinct(), hot=True).withColumn("apart", ~F.expr(linked))
        found.append(stars.filter("not apart").select("a", "b"))
        stars = durable(_recentred(stars, threshold))
        found.append(stars.filter("close").select("a", "b"))
        pairs, crowded = _across(stars, threshold, first)
        found.append(pairs)
        again = stars.filter("apart").join(crowded, "led_by").select(F.col("a").alias("digest"), F.col("led_by").alias("leader"))
        rest, first = led.join(again, ["digest", "leader"]).select("digest", "n", "band", "value"), False
        sizes = durable(rest.groupBy("band", "value").agg(F.count("*").alias("size")).filter("size > 1"))
        rest = durable(rest.join(sizes, ["band", "value"]))
        small = small.unionByName(rest.filter(f"size <= {BLOCK}"))
        large = rest.filter(f"size > {BLOCK}")
    # Small buckets: their pairs, if sizes allow a link at all and the signatures don't speak against it.
    ratio = threshold / 100.0
    x, y = small.alias("x"), small.alias("y")
    pairs = x.join(y, ["band", "value"]).filter("x.digest < y.digest").filter(f"least(x.n, y.n) >= {ratio} * greatest(x.n, y.n)")
    pairs = pairs.select(F.col("x.digest").alias("a"), F.col("y.digest").alias("b")).distinct()
    marks = classes.select("digest", "signature")
    pairs = pairs.join(marks.withColumnsRenamed({"digest": "a", "signature": "s"}), "a").join(marks.withColumnsRenamed({"digest": "b", "signature": "t"}), "b")
    pairs = pairs.filter(_agree("s", "t") >= ratio - SLACK).select("a", "b")
    found.append(verified(pairs, hot=False).filter(linked).select("a", "b"))
    return reduce(DataFrame.unionByName, found)


def _shared_leaders(large: DataFrame, leaders: DataFrame, central: DataFrame) -> DataFrame:
    """(band, value, leader): for each bucket the weightiest leader that half of its members have, by any of their buckets.

    A cluster fills buckets of many bands, which mostly hold the same members; so they get one leader, and a member is
    compared with few. A leader needn't be in a bucket that it leads.
    """
    members = large.select("digest", "band", "value").join(leaders, ["band", "value"])
    known = durable(members.select("digest", "leader").distinct())
    votes = large.select("digest", "band", "value", "size").join(known, "digest").groupBy("band", "value", "leader").agg((2 * F.count("*") >= F.first("size")).alias("most"))
    votes = votes.join(central.withColumnRenamed("digest", "leader"), "leader")
    return votes.groupBy("band", "value").agg(F.max_by("leader", F.struct("most", "weight", "leader")).alias("leader"))


def _recentred(stars: DataFrame, threshold: int) -> DataFrame:
    """The members of each leader's star as seen from the settled one that is nearest to what most of them have in common.

    A leader with edits of its own gives all others the same differences, which say nothing. The majority's set differs from
    the leader's by the elements that over half of the settled members differ in; the member nearest to it is the new centre
    (b), and differences follow from those to the leader (led_by) without texts. close: linked to the centre; apart: linked
    to neither.
    """
    delta = F.concat("gone", "added")
    empty = F.array().cast("array<bigint>")
    leaders = stars.groupBy("b").agg(F.first("n_b").alias("n_b")).select(F.col("b").alias("a"), "b", F.col("n_b").alias("n_a"), "n_b", empty.alias("gone"), empty.alias("added"), F.lit(False).alias("apart"))
    rows = stars.select("a", "b", "n_a", "n_b", "gone", "added", "apart").unionByName(leaders)
    near = rows.filter("not apart")
    held = near.select("b", F.explode(delta).alias("e")).groupBy("b", "e").agg(F.count("*").alias("held"))
    most = near.groupBy("b").agg(F.count("*").alias("of"))
    # Written, so that the joins below have two shuffled sides and a leader with many members can be split.
    shift = durable(held.join(most, "b").filter("2 * held > of").groupBy("b").agg(F.collect_list("e").alias("shift")))
    far = F.size(delta) - 2 * F.size(F.array_intersect(delta, F.coalesce("shift", empty)))
    centre = F.min_by(F.struct("a", "n_a", "gone", "added"), F.struct(far, "a")).alias("c")
    centres = durable(near.join(shift, "b", "left").groupBy("b").agg(centre))
    rows = rows.join(centres, "b").filter(F.col("a") != F.col("c.a"))
    only = F.array_except
    rows = rows.select(
        "a", F.col("b").alias("led_by"), F.col("c.a").alias("b"), "n_a", F.col("c.n_a").alias("n_b"), "apart",
        F.concat(only("gone", "c.gone"), only("c.added", "added")).alias("gone"), F.concat(only("added", "c.added"), only("c.gone", "gone")).alias("added"),
    )
    both, d = F.col("n_a") + F.col("n_b"), F.size("gone") + F.size("added")
    close = 100 * (both - d) >= threshold * (both + d)
    return rows.withColumn("close", close).withColumn("apart", F.col("apart") & ~close)


def _across(stars: DataFrame, threshold: int, first: bool) -> tuple[DataFrame, DataFrame]:
    """Links of members apart from their star's centre with all others, and the leaders (led_by) whose members apart are
    too alike for that: of these, links with settled members alone.

    With d the size of a symmetric difference, a link of x and y means d(x, y) * (100 + t) <= (100 - t) * (n_x + n_y).
    """
    per = (100 - threshold) / (100 + threshold)
    stars = stars.select(F.col("led_by").alias("b"), "a", "n_a", "n_b", "gone", "added", (F.size("gone") + F.size("added")).alias("d"), "apart")
    # Over half of y's difference, about, is also in that of any x that is apart from the centre.
    stars = stars.withColumn("need", F.floor((F.col("d") + per * (F.col("n_b") - F.col("n_a"))) / 2) + 1)
    # Every difference once as rows; `new` tells what a member has that the centre lacks.
    sides = F.concat(F.transform("gone", lambda e: F.struct(e.alias("e"), F.lit(False).alias("new"))), F.transform("added", lambda e: F.struct(e.alias("e"), F.lit(True).alias("new"))))
    cells = durable(stars.select("b", "a", "n_a", "d", "apart", "need", F.explode(sides).alias("c")).select("b", "a", "n_a", "d", "apart", "need", "c.e", "c.new"))
    # What y has lost may be lost by others too; of what it has gained, only what others have gained can count.
    gains = cells.filter("new").select("b", "a", "apart", "e")
    others = gains.groupBy("b", "e").agg(F.count("*").alias("held"), F.max("apart").alias("wanted")).filter("held > 1 and wanted")
    gained = gains.join(others.select("b", "e"), ["b", "e"], "left_semi").groupBy("b", "a").agg(F.count("*").alias("gained"))
    ys = stars.join(gained, ["b", "a"], "left").filter(F.size("gone") + F.coalesce("gained", F.lit(0)) >= F.col("need")).select("b", "a")
    held = cells.groupBy("b", "e").agg(F.count("*").alias("held"), F.sum(F.col("apart").cast("int")).alias("wanted"))
    held = durable(held.filter("held > 1 and wanted > 0"))
    spans = cells.drop("new").join(ys, ["b", "a"], "left_semi").join(held, ["b", "e"])
    spans = spans.withColumn("rank", F.row_number().over(Window.partitionBy("b", "a").orderBy("held", "e"))).withColumn("own", F.count("*").over(Window.partitionBy("b", "a")))
    y = durable(spans.filter(F.col("rank") <= F.col("own") - F.col("need") + 1).select("b", "e", "wanted", F.col("a").alias("y"), F.col("apart").alias("y_apart"), F.col("d").alias("d_y"), F.col("n_a").alias("n_y"), (F.col("own") - F.col("rank") + 1).alias("left_y")))
    # What the join would list among the members apart, and how many these and the settled ones are.
    listed = y.filter("y_apart").groupBy("b").agg(F.sum("wanted").alias("listed"))
    counts = stars.groupBy("b").agg(F.sum(F.col("apart").cast("int")).alias("left"), F.count("*").alias("of"))
    fruitful = F.lit(first) | (FRUITFUL * (F.col("of") - F.col("left")) >= F.col("of"))
    crowded = durable(listed.join(counts, "b").filter((F.col("listed") > CROWD * F.col("left")) & fruitful).select("b"))
    y = y.join(crowded.withColumn("crowded", F.lit(True)), "b", "left").filter("crowded is null or not y_apart")
    x = cells.filter("apart").select("b", F.col("a").alias("x"), F.col("d").alias("d_x"), F.col("n_a").alias("n_x"), "e")
    enough = F.col("left_y") * 2 >= F.col("d_x") + F.col("d_y") - per * (F.col("n_x") + F.col("n_y")) - 1e-6
    # Of two members that are both apart, one order will do.
    pairs = x.join(y, ["b", "e"]).filter((F.col("x") != F.col("y")) & (~F.col("y_apart") | (F.col("x") < F.col("y"))) & enough).select("b", "x", "y", "d_x", "d_y", "n_x", "n_y").distinct()
    deltas = stars.select("b", "a", F.concat("gone", "added").alias("delta"))
    pairs = pairs.join(deltas.withColumnsRenamed({"a": "x", "delta": "delta_x"}), ["b", "x"]).join(deltas.withColumnsRenamed({"a": "y", "delta": "delta_y"}), ["b", "y"])
    apart = F.col("d_x") + F.col("d_y") - 2 * F.size(F.array_intersect("delta_x", "delta_y"))
    both = F.col("n_x") + F.col("n_y")
    # intersection (both - d) / 2 against union (both + d) / 2, in whole numbers
    pairs = pairs.filter(100 * (both - apart) >= threshold * (both + apart)).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    return durable(pairs), crowded.withColumnRenamed("b", "led_by")


def near_duplicates(docs: DataFrame, threshold: int = 80) -> DataFrame:
    """One row per row of `docs`: doc_id, row_key, n_shingles, component_id, kept.

    `docs` needs doc_id and text; other columns are not looked at. Links join texts whose sets of distinct five-word
    shingles (words of a shorter text; ASCII lower case) have 100 * intersection >= threshold * union. A null, empty or
    wordless text has an empty set and no link. component_id is the smallest doc_id of the linked rows; null doc_ids
    are ignored for it, and rows of a component without any other have null. kept tells whether doc_id is component_id;
    rows that repeat both id and text have the same result. An empty table gives an empty one.
    """
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    keyed = docs.select("doc_id", row_key().alias("row_key"), "text")
    sketches = durable(keyed.select("row_key", "text").mapInArrow(_sketch, SKETCH))
    found = components(links(docs, sketches, threshold))
    ids = docs.select("doc_id", row_key().alias("row_key"))
    known = sketches.select("row_key", "n_shingles", "digest").dropDuplicates(["row_key"])
    rows = ids.join(known, "row_key").join(found.withColumnsRenamed({"node": "digest"}), "digest", "left")
    # Rows without shingles are components of their own.
    rows = rows.withColumn("root", F.when(F.col("n_shingles") > 0, F.coalesce("root", "digest")))
    # Written, so that the join below has two shuffled sides and a root with many rows can be split.
    least = durable(rows.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("least")))
    rows = rows.join(least, "root", "left").withColumn("component_id", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")))
    return rows.select("doc_id", "row_key", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents at 85 in 100: doc_id, n_shingles, component_id, kept."""
    return near_duplicates(table(spark, sf_dir, "documents"), threshold=85).select("doc_id", "n_shingles", "component_id", "kept")


OP2_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
    FROM documents),
sets AS MATERIALIZED (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [list_aggregate(w, 'string_agg', ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i:i + 4], 'string_agg', ' '))) END AS s
    FROM words),
elements AS MATERIALIZED (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS e FROM sets),
links AS MATERIALIZED (
    SELECT a.doc_id AS a, b.doc_id AS b FROM elements a JOIN elements b ON a.e = b.e AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(min(r.b), s.doc_id) AS component_id, s.doc_id = least(min(r.b), s.doc_id) AS kept
FROM sets s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.s
"""
