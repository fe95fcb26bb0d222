"""Invariants of codecs and segment kinds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vqspark import fixtures as X
from vqspark.functions import constants as C
from vqspark.operators import codec as V
from vqspark.operators import segments as S
from vqspark.sources import tables as T

SEG = ["seq_id", "layer", "side"]


def sse(df):
    return df.agg(F.sum(S.squared_error())).first()[0]


def test_codebook_is_symmetric_and_predicts_distortion():
    for bits, wanted in ((1, 0.3584), (2, 0.1145), (3, 0.0334), (4, 0.0091)):
        c, cost = C.codebook(64, bits)
        assert np.allclose(c, -np.array(c)[::-1]) and abs(64 * cost - wanted) < 0.03 * wanted
    assert C.codebook(64, 0)[0] == (0.0,)


def test_transforms_are_orthonormal():
    for m in (C.rotation(16, 1), C.signed_hadamard(16, 1), C.srht(16, 1), C.block_hadamard(20, 16, 1)):
        assert np.allclose(m @ m.T, np.eye(len(m)), atol=1e-6)
    with pytest.raises(ValueError):
        C.hadamard(12)


def test_error_falls_with_bits_and_gains_are_bounded():
    x = np.random.default_rng(0).standard_normal((256, 32)) * 3
    errors = [((x - m.decode(*m.encode(x))) ** 2).sum() for m in (V.codec("mse", 32, b) for b in (1, 2, 3))]
    assert errors[0] > errors[1] > errors[2]
    plain, fit, unit, clipped, gain = (V.codec(k, 32, 2) for k in ("mse", "lsq_mse", "unit_mse", "clipped_gain_mse", "gain_mse"))
    assert ((x - fit.decode(*fit.encode(x))) ** 2).sum() <= ((x - plain.decode(*plain.encode(x))) ** 2).sum() + 1e-9
    assert np.allclose(np.linalg.norm(unit.decode(*unit.encode(x)), axis=1), np.linalg.norm(x, axis=1), rtol=1e-4)
    ratio = clipped.encode(x)[1] / np.linalg.norm(x, axis=1)
    assert ratio.min() >= 1 - 1e-12 and ratio.max() <= C.gain(32, 2) + 1e-12
    assert (gain.encode(x)[0] == plain.encode(x)[0]).all() and np.linalg.norm(gain.decode(*gain.encode(x))) > np.linalg.norm(plain.decode(*plain.encode(x)))
    zero = plain.decode(*plain.encode(np.zeros((1, 32))))
    assert np.abs(zero).max() < 1e-6


def test_custom_transform_and_errors():
    m = V.codec("custom", 8, 2, transform=np.eye(8), inverse=np.eye(8))
    assert (m.forward == np.eye(8)).all()
    for bad in (lambda: V.codec("custom", 8, 2, transform=np.eye(8)), lambda: V.codec("mse", 8, 2, transform=np.eye(7)), lambda: V.codec("nothing", 8, 2), lambda: V.codec("mse_block2", 7, 2)):
        with pytest.raises(ValueError):
            bad()


def test_nulls_and_partitions(spark):
    rows = [(i, np.random.default_rng(i).standard_normal(16).tolist() if i % 5 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, vec array<double>")
    m = V.codec("mse", 16, 3)
    outcomes = [sorted(map(str, V.pack(V.encode(df.repartition(n), "vec", m), 3).collect())) for n in (1, 4, 17)]
    assert outcomes[0] == outcomes[1] == outcomes[2] and len(outcomes[0]) == 40
    assert V.encode(df.limit(0), "vec", m).count() == 0


def test_segment_kinds(spark, data):
    kv = X.kv_states(spark, data).persist()
    m = V.codec("mse", 64, 2)
    base = sse(V.decode(V.encode(kv, "vec", m), m))
    assert abs(sse(S.rotation_bank(kv, 2, 1)) - base) < 1e-6 * base
    assert sse(S.rotation_bank(kv, 2, 4)) < base
    assert sse(S.outlier_hadamard(kv, 2, "segment", keys=SEG)) <= base + 1e-9
    assert sse(S.outlier_hadamard(kv, 2, "vector", keys=SEG)) <= base + 1e-9
    assert sse(S.encode_fractional(kv, 2.5, keys=SEG)) < base
    masks = S.select_channels(S.channel_scores(kv, "dynamic_absmean", 2.5, SEG), SEG, 32)
    assert {r[0] for r in masks.select(F.size(F.filter("mask", lambda x: x))).collect()} == {32}
    joint = S.joint_channels(S.channel_scores(kv, "error_gain", 2.5, SEG), 64, 64, SEG)
    both = joint.groupBy("seq_id", "layer").agg(F.sum(F.size(F.filter("mask", lambda x: x))).alias("n"), F.count("*").alias("sides")).filter("sides = 2")
    assert {r.n for r in both.collect()} == {64}
    assert C.resolve_bits(2.5, 16) == (2, 3, 8) and C.resolve_bits(2.5, 16, "quarter_high2") == (2, 4, 4)


def test_keyed_sets(spark):
    df = spark.createDataFrame([(i * 3, i) for i in range(100)], "vec_id long, x int")
    assert T.kth_smallest(df, "vec_id", 10) == 27
    with pytest.raises(ValueError):
        T.split_database_queries(df, "vec_id", 90, 20)
    a = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "index long, line long, v string")
    b = spark.createDataFrame([(2, 0, "d")], "index long, line long, v string")
    assert sorted(map(tuple, T.merge_shards([a, b]).collect())) == [(1, "b"), (2, "d")]


def test_auto_kinds_weigh_the_learned_blocks(spark, tmp_path):
    """On vectors of few directions the learnt blocks are all but exact, so they have the least error in every segment."""
    from vqspark.plans import vector_queries  # its columns need a session

    some = np.random.default_rng(0).standard_normal((2, 64)).astype(np.float32)
    rows = [(i, i % 3, some[i // 4 % 2].tolist()) for i in range(256)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("auto_kind", "attention_auto_kind"):
        picked = {r.kind for r in vector_queries.QUERIES[name](spark, str(tmp_path)).collect()}
        assert picked == {"learned_unit_mse_block2"}, name


def test_learned_blocks_use_the_default_rounds(spark, data, monkeypatch):
    from vqspark.plans import vector_queries  # its columns need a session

    given = []
    monkeypatch.setattr(vector_queries.V, "fit_blocks", lambda *a, **more: given.append((a, more)) or np.zeros((16, 2)))
    vector_queries.QUERIES["learned_blocks"](spark, data)
    assert len(given) == 1 and len(given[0][0]) == 3 and "most_rounds" not in given[0][1]
