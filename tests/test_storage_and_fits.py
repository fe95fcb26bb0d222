"""Arrow shards, coded tables with their metadata, running state, fitted blocks and merged covariances."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vqspark import fixtures as X
from vqspark.operators import calibration, codec, segments
from vqspark.sources import arrow_files, tables
from vqspark.streaming import encode

KEYS = ["seq_id", "layer", "side"]


def write_file(path, batches, stream=False):
    with (pa.ipc.new_stream if stream else pa.ipc.new_file)(str(path), batches[0].schema) as out:
        for b in batches:
            out.write_batch(b)


def test_arrow_files_streams_and_columns(spark, tmp_path):
    batch = lambda a, n: pa.record_batch({"a": pa.array(range(a, a + n), pa.int64()), "b": pa.array([None if i == a else str(i) for i in range(a, a + n)], pa.string()), "c": pa.array([[float(i)] for i in range(a, a + n)], pa.list_(pa.float64()))})
    write_file(tmp_path / "one.arrow", [batch(0, 5), batch(5, 0), batch(5, 3), batch(8, 1)])
    write_file(tmp_path / "two.arrows", [batch(9, 2)], stream=True)
    write_file(tmp_path / "three.feather", [pa.record_batch({"a": pa.array([11], pa.int64()), "d": [True]})])
    (tmp_path / "_SUCCESS").write_text("")
    arrow_files.register(spark)
    whole = spark.read.format("arrow_ipc").option("batches", 2).load(str(tmp_path))
    rows = sorted(map(tuple, whole.select("a", "b", "c", "d").collect()))
    assert rows == [(i, None if i in (0, 5, 8, 9, 11) else str(i), None if i == 11 else [float(i)], True if i == 11 else None) for i in range(12)]
    assert whole.rdd.getNumPartitions() == 4  # two runs of batches of the first file
    some = tables.read_shard(spark, f"{tmp_path}/one.arrow", "b string, missing int")
    assert some.columns == ["b", "missing"] and some.count() == 9 and some.filter("missing is not null").count() == 0
    reader = arrow_files._reader(str(tmp_path / "one.arrow"), ["b"])
    assert reader.get_batch(0).schema.names == ["b"]  # other columns aren't read
    with pytest.raises(Exception, match="(?i)not.?found|no such"):
        spark.read.format("arrow_ipc").load(f"{tmp_path}/nothing").count()


def test_arrow_round_trip(spark, tmp_path):
    rows = spark.range(100).select("id", (F.col("id") / 3).alias("x"), F.array("id").alias("l")).repartition(3)
    for _ in range(2):
        tables.write_arrow(rows, f"file://{tmp_path}/out.arrow")
    back = tables.read_shard(spark, f"file://{tmp_path}/out.arrow")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_coded_tables_need_their_segments(spark, data, tmp_path):
    kv = X.kv_states(spark, data).filter("seq_id = 0")
    for bits in (2.5, 2.25):
        n = round((bits - 2) * 64)
        masks = segments.select_channels(segments.channel_scores(kv, "error_gain", bits, KEYS), KEYS, n)
        want = {r.vec_id: r.vec_hat for r in segments.encode_split(kv, masks, bits, keys=KEYS).select("vec_id", "vec_hat").collect()}
        codes, meta = segments.split_codes(kv, masks, bits, KEYS)
        tables.write_coded(codes, meta, f"file://{tmp_path}/coded")
        held, places = tables.read_coded(spark.newSession(), f"file://{tmp_path}/coded")
        got = {r.vec_id: r.vec_hat for r in segments.join_codes(held, places, KEYS).select("vec_id", "vec_hat").collect()}
        assert set(got) == set(want) and all(np.allclose(got[i], want[i], atol=1e-12) for i in want)
        size = held.select((F.octet_length("regular") + F.octet_length("outlier")).alias("n")).distinct().collect()
        assert [r.n for r in size] == [(64 - n) * 2 // 8 + n * 3 // 8]
    with pytest.raises(Exception, match="without their segment"):
        segments.join_codes(held, places.filter("layer > 0"), KEYS).select("vec_hat").collect()


def test_state_is_the_same_after_restarts(spark, data, tmp_path):
    rows, made = X.kv_states(spark, data), codec.codec("mse", 64, 3)
    folder = f"file://{tmp_path}"
    for step, part in enumerate((rows.filter("pos < 3"), rows.filter("pos >= 3 and pos < 6"), rows.filter("pos >= 6"))):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        encode.keep_state(encode.running_sizes(stream, made), f"{folder}/out", f"{folder}/state").awaitTermination()
        now = {(r.seq_id, r.layer): (r.n, r.bytes) for r in encode.current_state(spark, f"{folder}/out", ["seq_id", "layer"]).collect()}
        want = {(r.seq_id, r.layer): (r.n, r.n * (64 * 3 // 8 + 2)) for r in rows.filter(f"pos < {3 * step + 3}").groupBy("seq_id", "layer").agg(F.count("*").alias("n")).collect()}
        assert now == want


def test_blocks_are_no_worse_than_products_and_rounds_are_counted(spark):
    found = codec.sphere_blocks(spark, 16, 2, 2000)
    assert 1 < found.rounds <= 60 and found.centers.shape == (16, 2)
    rng = np.random.default_rng(7)
    x = rng.standard_normal((4000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    errors = []
    for kind, blocks in (("mse_block2", None), ("learned_mse_block2", found.centers)):
        m = codec.codec(kind, 16, 2, blocks=blocks)
        errors.append(((x - m.decode(*m.encode(x))) ** 2).sum(1).mean())
    assert errors[1] < errors[0]
    assert codec.sphere_blocks(spark, 16, 2) is found


def test_empty_blocks_go_to_the_farthest_pairs(spark):
    samples = spark.createDataFrame([([0.0, 0.0, 0.1, 0.0],), ([0.0, 0.1, 5.0, 5.0],), ([-4.0, 0.0, 5.0, 5.1],)], "y array<double>")
    start = np.array([[0.0, 0.0], [90.0, 90.0], [91.0, 91.0]])
    found = codec.lloyd_blocks(samples, start, 30)
    want = [[0.1 / 3, 0.1 / 3], [5.0, 5.05], [-4.0, 0.0]]
    assert np.allclose(sorted(map(tuple, found.centers)), sorted(map(tuple, want))) and found.moved < 1e-7
    assert (codec.lloyd_blocks(samples.limit(0), start).centers == start).all()


def test_covariance_of_many_tasks(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 5)) * [1, 2, 3, 4, 5] + 1e6
    rows = [(int(i % 3) if i % 7 else None, v.tolist()) for i, v in enumerate(x)] + [(9, [1.0] * 5), (1, None)]
    df = spark.createDataFrame(rows, "k int, vec array<double>").repartition(70)
    got = {(r.k, r.i, r.j): (r.value, r.n) for r in calibration.covariance(df, ["k"], unit=False).collect()}
    for k in (0, 1, 2, None):
        own = np.stack([v for i, v in rows if i == k and v is not None])
        want = np.cov(own.T)
        assert all(np.isclose(got[k, i, j][0], want[i, j], rtol=1e-9) and got[k, i, j][1] == len(own) for i in range(5) for j in range(5))
    assert got[9, 0, 0] == (None, 1) and len(got) == 5 * 25
