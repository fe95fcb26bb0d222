"""Removal of repeated byte strings by suffix arrays of shards.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else. What can't repeat never moves:

1. Every string of LENGTH bytes holds an anchor, the GRAM bytes of the least hash in it, at the same place wherever it
   stands. Only anchors that occur again, with the bytes around them (their context), can be part of a repeat.
2. Occurrences whose whole contexts are equal repeat throughout; one of each such class stands for all.
3. The different contexts of an anchor are dealt to shards by anchor. A shard builds the suffix array of its windows'
   starts by refinement, to the depth of a window, and finds the windows that two of its contexts share.
4. An anchor with very many different contexts is dealt to several shards; these hand on their windows' digests as
   sorted runs, cut into ranges, and for each range the runs are merged by binary search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import textops as T
from .common import durable, partitions, table
from .near_dups import row_key
from .suffix_arrays import ordered_by_prefix

LENGTH, GRAM = 200, 48
SIDE = LENGTH - GRAM
#: Different contexts of one anchor in one shard, bytes of a shard (two ranks and a place of which fit into a word), and
#: windows of a range when runs are merged.
CONTEXTS, SHARD_BYTES, RANGE = 4096, 7 << 18, 400_000

#: Bits of an anchor that the sieve looks at.
SIEVE_BITS = 27

ANCHORS = "anchor bigint, context bigint, row_key bigint, at int, before int, size int"


def anchors(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Anchors of texts laid end to end: row, place in the row, hash, and extent and hash of the context."""
    n = len(data)
    sums, down = T.prefix_sums(data)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    whole = np.flatnonzero(np.arange(n) + LENGTH <= ends)
    if not len(whole):
        return {k: np.empty(0, dtype=np.int64) for k in ("row", "at", "anchor", "before", "size", "context")}
    grams = n - GRAM + 1
    with np.errstate(over="ignore"):
        hashes = T.mix((sums[GRAM:] - sums[:-GRAM]) * down[:grams])
    # The least hash of a window, the last of equal ones: the place goes to the low bits.
    bits = np.uint64(max(20, int(n).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    keyed = hashes & ~low | (low - np.arange(grams, dtype=np.uint64))
    width = SIDE + 1
    rows = -(-grams // width)
    grid = np.full(rows * width, ~np.uint64(0))
    grid[:grams] = keyed
    grid = grid.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(behind[whole], ahead[whole + width - 1])
    place = (low - (least & low)).astype(np.int64)
    place = np.unique(place)
    row = np.searchsorted(offsets, place, side="right") - 1
    start, end = np.maximum(place - SIDE, offsets[row]), np.minimum(place + LENGTH, offsets[row + 1])
    with np.errstate(over="ignore"):
        context = T.mix((sums[end] - sums[start]) * down[start] + ((place - start) << 20 | (end - start)).astype(np.uint64))
    return {"row": row, "at": place - offsets[row], "anchor": hashes[place].view(np.int64), "before": place - start, "size": end - start, "context": context.view(np.int64)}


def _count_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = T.text_bytes(batch.column("text"))
        for a, b in T.slices(offsets):
            anchor, n = np.unique(anchors(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])["anchor"], return_counts=True)
            yield pa.record_batch([pa.array(anchor), pa.array(n)], names=["anchor", "n"])


def _find_anchors(sieve):  # noqa: ANN001, ANN202  a Spark broadcast
    """Anchors that pass the sieve: all that are seen again, and a few others."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sieve.value
        for batch in batches:
            data, offsets = T.text_bytes(batch.column("text"))
            keys = batch.column("row_key").to_numpy()
            for a, b in T.slices(offsets):
                found = anchors(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                bit = found["anchor"].view(np.uint64) >> np.uint64(64 - SIEVE_BITS)
                some = np.flatnonzero(words[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1))
                found = {k: v[some] for k, v in found.items()}
                small = [pa.array(found[k].astype(np.int32)) for k in ("at", "before", "size")]
                yield pa.record_batch([pa.array(found["anchor"]), pa.array(found["context"]), pa.array(keys[a + found["row"]]), *small], names=["anchor", "context", "row_key", "at", "before", "size"])

    return work


def _sieve(seen: DataFrame) -> np.ndarray:
    """A bit for the leading bits of every anchor: 16 MB, whatever the number of anchors. Words come as sums of bits."""
    bit = F.shiftrightunsigned("anchor", 64 - SIEVE_BITS)
    mask = F.expr("shiftleft(1L, cast(bit & 63 as int))")
    rows = seen.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(mask).alias("mask")).toArrow()
    out = np.zeros(1 << SIEVE_BITS - 6, dtype=np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("mask").to_numpy().view(np.uint64)
    return out


def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("anchor", "context", "row_key", "start", "copies", "shards", "bytes")}
        for key, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("row_key", "text", "wanted")), strict=True):
            raw = text.encode()
            for w in wanted:
                start = w["at"] - w["before"]
                for k, v in zip(out, (w["anchor"], w["context"], key, start, w["n"], w["shards"], raw[start : start + w["size"]]), strict=True):
                    out[k].append(v)
        yield pa.record_batch([*(pa.array(out[k], pa.int64()) for k in list(out)[:-1]), pa.array(out["bytes"], pa.binary())], names=list(out))


FOUND = "anchor bigint, context bigint, windows array<int>, run int, digests array<bigint>, owners array<bigint>, places array<bigint>, offsets array<int>, settled array<boolean>"


def shared_windows(batch: pa.RecordBatch, all_of_them: bool = True) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """For a shard of contexts: the starts of the windows that repeat, in order, and columns of all windows.

    Without `all_of_them` the columns leave out windows whose bytes stand at one start alone.
    """
    raw = batch.column("bytes").cast(pa.large_binary())
    at = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
    text = np.frombuffer(raw.buffers()[2], dtype=np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    size = np.diff(at)
    starts = np.flatnonzero(np.arange(len(text)) + LENGTH <= np.repeat(at[1:], size))
    order, head = ordered_by_prefix(text, starts, LENGTH)
    columns = {k: batch.column(k).to_numpy() for k in ("row_key", "start", "copies")}
    owner = np.repeat(np.arange(len(size), dtype=np.int32), size)
    alone = head & np.r_[head[1:], np.ones(min(1, len(head)), dtype=bool)]
    single = order[alone & (columns["copies"] > 1)[owner[order]]]
    if not all_of_them:
        order, head = order[~alone], head[~alone]
    number = owner[order]
    offset = order - at[number]
    with np.errstate(over="ignore"):
        place = T.mix(columns["row_key"][number].view(np.uint64) + T.mix((columns["start"][number] + offset).astype(np.uint64)))
    first = np.flatnonzero(head)
    count = np.diff(np.r_[first, len(head)])
    repeats = np.zeros(0, dtype=bool)
    if len(first):
        repeats = np.minimum.reduceat(place, first) != np.maximum.reduceat(place, first)
        repeats |= np.maximum.reduceat(columns["copies"][number], first) > 1
    every = np.repeat(repeats, count)
    found = np.zeros(len(text), dtype=bool)
    found[order[every]] = True
    found[single] = True
    return np.flatnonzero(found), {"number": number, "offset": offset, "place": place, "first": first, "repeats": every, "text": text, "at": at}


def _shard(batch: pa.RecordBatch, hot: bool) -> Iterator[pa.RecordBatch]:
    found, every = shared_windows(batch, hot)
    # Windows of a context all overlap, so the first and the last one tell what they cover.
    low, high = np.searchsorted(found, every["at"][:-1]), np.searchsorted(found, every["at"][1:])
    some = high > low
    cut = np.r_[0, np.cumsum(2 * some)].astype(np.int32)
    ends = np.stack([found[low[some]], found[high[some] - 1]], axis=1) - every["at"][:-1][some, None]
    windows = pa.ListArray.from_arrays(pa.array(cut), pa.array(ends.reshape(-1).astype(np.int32)))
    none = {k: pa.nulls(batch.num_rows, t) for k, t in (("run", pa.int32()), ("digests", pa.list_(pa.int64())), ("owners", pa.list_(pa.int64())), ("places", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int32())), ("settled", pa.list_(pa.bool_())))}
    yield pa.record_batch([batch.column("anchor"), batch.column("context"), windows, *none.values()], names=["anchor", "context", "windows", *none])
    if not hot:
        return
    # A run: unsettled windows and one of each settled class, sorted by digest and cut into ranges.
    use = ~every["repeats"]
    use[every["first"]] = True
    n, o = every["number"][use], every["offset"][use]
    start = every["at"][n] + o
    digest = T.spans_hash(every["text"], start, start + LENGTH)
    turn = np.argsort(digest)
    ranges = max(1, int(batch.column("shards")[0].as_py()) * CONTEXTS * SIDE // RANGE)
    digest, n, o = digest[turn], n[turn], o[turn]
    piece = (digest >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
    anchor, context = batch.column("anchor")[0].as_py(), batch.column("context").to_numpy()
    settled, place = every["repeats"][use][turn], every["place"][use][turn]
    for k in range(ranges):
        a, b = np.searchsorted(piece, [k, k + 1])
        lists = [pa.array([x], t) for x, t in ((digest[a:b].view(np.int64), pa.list_(pa.int64())), (context[n[a:b]], pa.list_(pa.int64())), (place[a:b].view(np.int64), pa.list_(pa.int64())), (o[a:b].astype(np.int32), pa.list_(pa.int32())), (settled[a:b], pa.list_(pa.bool_())))]
        yield pa.record_batch([pa.array([anchor]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int32())), pa.array([k], pa.int32()), *lists], names=["anchor", "context", "windows", *none])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor and salt: many anchors make a shard, or a part of one that is dealt to several."""
    held: list[pa.RecordBatch] = []
    rows, size, last = 0, 0, None
    begin = (0, 0)  # rows and bytes that are held before the group that is being read
    for batch in batches:
        anchor, salt, shards = (batch.column(k).to_numpy() for k in ("anchor", "salt", "shards"))
        weight = np.r_[0, np.cumsum(batch.column("size").to_numpy())]
        head = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1])])
        taken = 0
        for a, b in zip(head.tolist(), [*head[1:].tolist(), len(anchor)], strict=True):
            group = (anchor[a], salt[a], bool(shards[a] > 1))
            new = int(weight[b] - weight[a])
            other = last is not None and group[:2] != last[:2]
            if other:
                begin = (rows, size)
            if begin[0] and (size + new > SHARD_BYTES or (other and (group[2] or last[2]))):
                held.append(batch.slice(taken, a - taken))
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                yield from _shard(whole.slice(0, begin[0]), last[2])
                held, rows, size, begin, taken = [whole.slice(begin[0])], rows - begin[0], size - begin[1], (0, 0), a
            rows, size, last = rows + b - a, size + new, group
        held.append(batch.slice(taken))
    if rows:
        yield from _shard(pa.Table.from_batches(held).combine_chunks().to_batches()[0], last[2])


def _merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor and range: the runs of a range are searched in each other."""
    held: list[tuple] = []
    key = None
    for batch in batches:
        columns = [batch.column(k) for k in ("digests", "owners", "places", "offsets", "settled")]
        for i, this in enumerate(zip(batch.column("anchor").to_pylist(), batch.column("run").to_pylist(), strict=True)):
            if held and this != key:
                yield _merged(key[0], held)
                held = []
            key = this
            held.append(tuple(np.asarray(c[i].values.to_numpy(zero_copy_only=False)) for c in columns))
    if held:
        yield _merged(key[0], held)


def _merged(anchor: int, runs: list[tuple]) -> pa.RecordBatch:
    found = []
    for i, (digest, owner, place, offset, settled) in enumerate(runs):
        repeats = np.zeros(len(digest), dtype=bool)
        for j, (other, _, other_place, _, other_settled) in enumerate(runs):
            if i != j and len(other):
                at = np.minimum(np.searchsorted(other.view(np.uint64), digest.view(np.uint64)), len(other) - 1)
                repeats |= (other[at] == digest) & (other_settled[at] | (other_place[at] != place))
        repeats &= ~settled.astype(bool)
        found.append((owner[repeats], offset[repeats]))
    owner, offset = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.record_batch([pa.array(np.full(len(owner), anchor)), pa.array(owner, pa.int64()), pa.array(offset, pa.int32())], names=["anchor", "context", "window"])


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


def _remove(keep: bool):  # noqa: ANN202
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n", "removed", "spans", "sha", "kept")}
            starts, ends = (batch.column(k) for k in ("starts", "ends"))
            for i, text in enumerate(batch.column("text").to_pylist()):
                raw = (text or "").encode()
                kept, removed, spans = raw, 0, 0
                if starts[i].is_valid and len(starts[i]):
                    a, b = np.array(starts[i].as_py()), np.array(ends[i].as_py())
                    turn = np.argsort(a, kind="stable")
                    a, b = a[turn], np.maximum.accumulate(b[turn])
                    head = np.flatnonzero(np.r_[True, a[1:] > b[:-1]])
                    a, b = a[head], b[np.r_[head[1:] - 1, len(b) - 1]]
                    kept = b"".join(raw[s:e] for s, e in zip(np.r_[0, b], np.r_[a, len(raw)], strict=True))
                    removed, spans = int((b - a).sum()), len(a)
                for k, v in zip(out, (len(raw), removed, spans, hashlib.sha256(kept).hexdigest(), kept if keep else None), strict=True):
                    out[k].append(v)
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(out[k], pa.int64()) for k in ("n", "removed", "spans")), pa.array(out["sha"], pa.string()), pa.array(out["kept"], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return work


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(row_key, start, end): byte ranges, possibly overlapping, that together are what repeats."""
    spark = docs.sparkSession
    keyed = docs.select(row_key().alias("row_key"), "text").filter(F.octet_length("text") >= LENGTH)
    # Anchors are found twice rather than written, which would take as much disk as the texts: first counted, then those that
    # pass a sieve of fixed size. Those seen again are written, so that the join, which is exact, has two shuffled sides and
    # an anchor with many places can be split.
    counts = keyed.select("text").mapInArrow(_count_anchors, "anchor bigint, n bigint").groupBy("anchor").agg(F.sum("n").alias("n"))
    seen = durable(counts.filter("n > 1").select("anchor"))
    sieve = spark.sparkContext.broadcast(_sieve(seen))
    again = durable(keyed.mapInArrow(_find_anchors(sieve), ANCHORS).join(seen, "anchor"))
    contexts = again.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(F.struct("row_key", "at", "before", "size")).alias("one"))
    contexts = durable(contexts)
    several = contexts.groupBy("anchor").count().filter("count > 1").select("anchor", F.ceil(F.col("count") / CONTEXTS).alias("shards"))
    wanted = contexts.join(several, "anchor").select("one.row_key", F.struct("anchor", "context", "n", "shards", "one.at", "one.before", "one.size").alias("w")).groupBy("row_key").agg(F.collect_list("w").alias("wanted"))
    # Rows of equal keys are equal; one of them will do.
    cut = keyed.join(wanted, "row_key").mapInArrow(_cut_contexts, "anchor bigint, context bigint, row_key bigint, start bigint, copies bigint, shards bigint, bytes binary").dropDuplicates(["anchor", "context"])
    dealt = cut.withColumn("salt", F.pmod("context", "shards")).withColumn("size", F.length("bytes")).repartition(partitions(spark), "anchor", "salt").sortWithinPartitions("anchor", "salt")
    found = durable(dealt.mapInArrow(_shards, FOUND))
    runs = found.filter("run is not null").select("anchor", "run", "digests", "owners", "places", "offsets", "settled")
    merged = runs.repartition(partitions(spark), "anchor", "run").sortWithinPartitions("anchor", "run").mapInArrow(_merge_runs, "anchor bigint, context bigint, window int")
    windows = found.filter("run is null").select("anchor", "context", "windows").unionByName(merged.groupBy("anchor", "context").agg(F.collect_list("window").alias("windows")))
    # Windows of a context all overlap, so they cover one range, from the first to the end of the last.
    part = windows.filter("size(windows) > 0").groupBy("anchor", "context").agg(F.min(F.array_min("windows")).alias("from"), (F.max(F.array_max("windows")) + LENGTH).alias("to"))
    whole = contexts.filter("n > 1").select("anchor", "context", F.lit(0).alias("from"), F.col("one.size").alias("to"))
    ranges = whole.unionByName(part.join(whole.select("anchor", "context"), ["anchor", "context"], "left_anti"))
    start = F.col("at") - F.col("before")
    return again.join(ranges, ["anchor", "context"]).select("row_key", (start + F.col("from")).alias("start"), (start + F.col("to")).alias("end"))


def remove_repeats(docs: DataFrame, keep: bool = True) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (null without `keep`).

    `docs` needs doc_id and text; other columns are not looked at. Texts are UTF-8 bytes, matches never cross rows, and
    what repeats is judged on the input. Texts below LENGTH bytes, empty and null ones lose nothing; a null text has no
    bytes. A row that stands twice repeats itself and loses all that LENGTH allows.
    """
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    spans = repeated_spans(docs).groupBy("row_key").agg(F.collect_set(F.struct("start", "end")).alias("s"))
    spans = spans.select("row_key", F.col("s.start").alias("starts"), F.col("s.end").alias("ends"))
    rows = docs.withColumn("row_key", row_key()).join(spans, "row_key", "left")
    return rows.select("doc_id", "text", "starts", "ends").mapInArrow(_remove(keep), RESULT)


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removal of strings of 200 bytes that repeat, over all documents."""
    return remove_repeats(table(spark, sf_dir, "documents"), keep=False).drop("kept")
