"""Queries that code with kinds by name, and over what the coded tables are for: storage, layers, rotations, reports."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import constants as C
from ..operators import attention as A
from ..operators import calibration as K
from ..operators import codec as V
from ..operators import kinds as N
from ..operators import protection as P
from ..operators import search as H
from ..operators import segments as S
from ..streaming import encode as E
from . import vector_queries as Q

QUERIES: dict = {}
ORACLE_SQL: dict = {}
D = Q.D
SEG = ("seq_id", "layer", "side")


def _add(name: str, query, sql: str | None = None) -> None:  # noqa: ANN001
    QUERIES[name] = query
    if sql is not None:
        ORACLE_SQL[name] = sql


def _at(s, d, queries: bool = False, **more) -> N.Setting:  # noqa: ANN001, ANN003
    """Rotations and matrices are numbered by layer; half of the layers count as high ones."""
    layers = [(layer, side) for layer in range(4) for side in ("key", "value")]
    return N.Setting(keys=SEG, q=X.q_states(s, d) if queries else None, value_layer=2, entropy_limit=0.999, rotations={k: k[0] for k in layers}, transforms={k: C.rotation(D, 20 + k[0]) for k in layers}, **more)


def _coded(kind: str, bits: float, queries: bool = False, **more):  # noqa: ANN003, ANN202
    def query(s, d) -> DataFrame:  # noqa: ANN001
        return Q._mse(N.encode_kind(X.kv_states(s, d), kind, bits, _at(s, d, queries, **more)), "layer", "side")

    return query


def _plain_sql(bits: int, factor: str = "nrm", where: str = "true") -> str:
    """Mean squared error by layer and side of plain codes whose decoded direction is multiplied by `factor`."""
    return f"WITH {X.KV_CTE}, {Q._hat('h', 'kv', 'vec', Q.ROT, bits)} SELECT layer, side, round(avg({Q._apart('vec', f'list_transform(u, lambda x: x * ({factor}))')}), 6) AS mse, count(*) AS n FROM h WHERE {where} GROUP BY 1, 2"


_UNIT = f"nrm / sqrt({Q._sq('u')})"
_GAIN = f"nrm * {C.gain(D, 2)!r}"
for _kind, _bits, _sql in (
    ("distortion_regime_mse", 2, _plain_sql(2, _GAIN)), ("gain_unit_regime_mse", 3, _plain_sql(3, _UNIT)), ("rate_regime_mse", 2, _plain_sql(2, _GAIN)),
    ("hadamard_rate_regime_mse", 2, None), ("rate_hadamard_value_mse", 3, None), ("lsq_unit_mse", 2, _plain_sql(2, _UNIT)),
):
    _add(f"kind_{_kind}", _coded(_kind, _bits), _sql)
_add("kind_raw", _coded("mse", 16), f"WITH {X.KV_CTE} SELECT layer, side, 0.0::DOUBLE AS mse, count(*) AS n FROM kv GROUP BY 1, 2")
_HALVES = "parts AS (SELECT layer, side, vec_id, list(x ORDER BY i) FILTER (hot) AS hi, list(x ORDER BY i) FILTER (NOT hot) AS lo FROM long JOIN top USING (seq_id, layer, side, i) GROUP BY ALL)"


def _halves_sql(low: str, high: str) -> str:
    return f"""WITH {X.KV_CTE}, {Q._LONG}, {Q._TOP.format(n=32)}, {_HALVES}, {Q._hat('a', 'parts', 'lo', C.rotation(32, 0), 2, 32, 'a')}, {Q._hat('b', 'a', 'hi', C.rotation(32, 0), 3, 32, 'b')}
    SELECT layer, side, round(avg({Q._apart('lo', f'list_transform(ua, lambda x: x * {low})')} + {Q._apart('hi', f'list_transform(ub, lambda x: x * {high})')}), 6) AS mse, count(*) AS n FROM b GROUP BY 1, 2"""


_add("kind_gain_unit_regime_2p5", _coded("gain_unit_regime_mse", 2.5), _halves_sql(f"nrma * {C.gain(32, 2)!r}", f"nrmb / sqrt({Q._sq('ub')})"))
_add("kind_unit_mse_2p5", _coded("unit_mse", 2.5), _halves_sql(f"nrma / sqrt({Q._sq('ua')})", f"nrmb / sqrt({Q._sq('ub')})"))
_ADAPT = f"""WITH {X.KV_CTE}, {Q._LONG}, {Q._TOP.format(n=32)}, parts AS (SELECT seq_id, layer, side, vec_id, list(x ORDER BY i) FILTER (hot) AS hi, list(x ORDER BY i) FILTER (NOT hot) AS lo FROM long JOIN top USING (seq_id, layer, side, i) GROUP BY ALL),
{Q._hat('a', 'parts', 'lo', C.rotation(32, 0), 2, 32, 'a')}, {Q._hat('b', 'a', 'hi', C.rotation(32, 0), 3, 32, 'b')},
e AS (SELECT seq_id, layer, side, {Q._apart('hi', 'list_transform(ub, lambda x: x * nrmb)')} AS hot, {Q._apart('lo', 'list_transform(ua, lambda x: x * nrma)')} AS plain, {Q._apart('lo', f'list_transform(ua, lambda x: x * nrma * {C.gain(32, 2)!r})')} AS gained FROM b),
g AS (SELECT seq_id, layer, side, count(*) AS n, least(sum(hot + plain), sum(hot + gained)) AS sse FROM e GROUP BY ALL)
SELECT layer, side, round(sum(sse) / sum(n), 6) AS mse, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY 1, 2"""
_add("kind_adaptive_regular_gain_mse", _coded("adaptive_regular_gain_mse", 2.5), _ADAPT)
_LO_BANK = ", ".join(Q._hat(f"a{k}", f"a{k - 1}" if k else "parts", "lo", C.rotation(32, k), 2, 32, f"_a{k}") for k in range(4))
_HI_BANK = ", ".join(Q._hat(f"b{k}", f"b{k - 1}" if k else "a3", "hi", C.rotation(32, k), 3, 32, f"_b{k}") for k in range(4))
_BANK_PARTS = "parts AS (SELECT seq_id, layer, side, vec_id, list(x ORDER BY i) FILTER (hot) AS hi, list(x ORDER BY i) FILTER (NOT hot) AS lo FROM long JOIN top USING (seq_id, layer, side, i) GROUP BY ALL)"
_BANK_ERRORS = ", ".join(f"{Q._apart(part, f'list_transform(u_{t}{k}, lambda x: x * nrm_{t}{k})')} AS {part}{k}" for part, t in (("lo", "a"), ("hi", "b")) for k in range(4))
_BANK_HALVES = f"WITH {X.KV_CTE}, {Q._LONG}, {Q._TOP.format(n=32)}, {_BANK_PARTS}, {_LO_BANK}, {_HI_BANK}, e AS MATERIALIZED (SELECT seq_id, layer, side, {_BANK_ERRORS} FROM b3)"
_add("kind_rotation_bank_2p5", _coded("rotation_bank_mse", 2.5), f"{_BANK_HALVES} SELECT layer, side, round(avg(least(lo0, lo1, lo2, lo3) + least(hi0, hi1, hi2, hi3)), 6) AS mse, count(*) AS n FROM e GROUP BY 1, 2")
_add("kind_segment_rotation_bank_2p5", _coded("segment_rotation_bank_mse", 2.5), f"""{_BANK_HALVES}, g AS (SELECT layer, side, count(*) AS n, least(sum(lo0 + hi0), sum(lo1 + hi1), sum(lo2 + hi2), sum(lo3 + hi3)) AS sse FROM e GROUP BY seq_id, layer, side)
SELECT layer, side, round(sum(sse) / sum(n), 6) AS mse, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY 1, 2""")


def _choice(s, d):  # noqa: ANN001, ANN202
    """Which of three codings each segment takes at 2.5 bits, and its error."""
    kv, at, held = X.kv_states(s, d), _at(s, d), {}
    errors = N.candidate_errors(kv, {k: N.coder(kv, k, 2.5, at, held) for k in ("mse", "unit_mse", "selected_gain_mse")}, at)
    least = F.array_min("spare")
    return errors.select(*SEG, (F.array_position("spare", least) - 1).cast("int").alias("choice"), F.round(least, 6).alias("mse"))


_add("choice_of_three_2p5", _choice, f"""WITH {X.KV_CTE}, {Q._LONG}, {Q._TOP.format(n=32)}, {_BANK_PARTS}, {Q._hat('a', 'parts', 'lo', C.rotation(32, 0), 2, 32, 'a')}, {Q._hat('b', 'a', 'hi', C.rotation(32, 0), 3, 32, 'b')},
e AS MATERIALIZED (SELECT seq_id, layer, side, {Q._apart('lo', 'list_transform(ua, lambda x: x * nrma)')} AS lo, {Q._apart('hi', 'list_transform(ub, lambda x: x * nrmb)')} AS hi,
    {Q._apart('lo', f"list_transform(ua, lambda x: x * nrma / sqrt({Q._sq('ua')}))")} AS lo_unit, {Q._apart('hi', f"list_transform(ub, lambda x: x * nrmb / sqrt({Q._sq('ub')}))")} AS hi_unit,
    {Q._apart('lo', f'list_transform(ua, lambda x: x * nrma * {C.gain(32, 2)!r})')} AS lo_gain, {Q._apart('hi', f'list_transform(ub, lambda x: x * nrmb * {C.gain(32, 3)!r})')} AS hi_gain FROM b),
g AS (SELECT seq_id, layer, side, [avg(lo + hi), avg(lo_unit + hi_unit), avg(least(lo, lo_gain) + least(hi, hi_gain))] AS e FROM e GROUP BY 1, 2, 3)
SELECT seq_id, layer, side, CAST(list_position(e, list_min(e)) - 1 AS INT) AS choice, round(list_min(e), 6) AS mse FROM g""")
for _kind in ("auto_mse", "rms_regular_gain_mse", "regular_outlier_hadamard_mse", "outlier_only_hadamard_mse", "shared_rotated_outlier_mse", "calibrated_rotated_outlier_mse", "adaptive_outlier_hadamard_mse"):
    _add(f"kind_{_kind}", _coded(_kind, 2.5))
for _kind in ("attention_rotated_outlier_mse", "attention_adaptive_paired_rotated_outlier_mse", "entropy_guarded_paired_rotated_outlier_mse", "entropy_guarded_outlier_hadamard_mse", "bitwidth_attention_outlier_hadamard_mse", "attention_weighted_hadamard_residual_mse", "attention_hadamard_residual_mse", "regular_attention_scale_mse", "attention_adaptive_regular_gain_mse", "attention_rotation_bank_mse"):
    _add(f"kind_{_kind}", _coded(_kind, 2.5 if "bank" not in _kind else 2, queries=True))
_add("kind_attention_auto_mse", _coded("attention_auto_mse", 2, queries=True))
_SCALED = f"""WITH {Q._ERR}, f AS (SELECT pr.vec_id, greatest(sum(score * 0.125 * {Q._dot('pr.q', 'h.u')}) / sum((0.125 * {Q._dot('pr.q', 'h.u')}) ** 2), 0) AS f FROM pr JOIN h USING (vec_id) GROUP BY 1)
SELECT layer, side, round(avg({Q._apart('vec', "list_transform(u, lambda x: x * CASE WHEN side = 'key' THEN coalesce(f, nrm) ELSE nrm END)")}), 6) AS mse, count(*) AS n FROM h LEFT JOIN f USING (vec_id) GROUP BY 1, 2"""
_add("kind_attention_scale_mse", _coded("attention_scale_mse", 2, queries=True), _SCALED)


def _by_layer_sql(seed: int) -> str:
    made = ", ".join(Q._hat(f"h{i}", f"k{i}", "vec", C.rotation(D, seed + i), 2) for i in range(4))
    cut = ", ".join(f"k{i} AS (SELECT * FROM kv WHERE layer = {i})" for i in range(4))
    every = " UNION ALL ".join(f"SELECT layer, side, vec, u, nrm FROM h{i}" for i in range(4))
    return f"WITH {X.KV_CTE}, {cut}, {made} SELECT layer, side, round(avg({Q._apart('vec', 'list_transform(u, lambda x: x * nrm)')}), 6) AS mse, count(*) AS n FROM ({every}) GROUP BY 1, 2"


_add("kind_scheduled_rotation_mse", _coded("scheduled_rotation_mse", 2), _by_layer_sql(0))
_add("kind_calibrated_rotation_mse", _coded("calibrated_rotation_mse", 2), _by_layer_sql(20))
_SCHEDULE = [(layer, side, (2, 3, 2, 3)[layer], "mse" if side == "key" else "gain_mse") for layer in range(4) for side in ("key", "value")]


def _scheduled(s, d):  # noqa: ANN001, ANN202
    return Q._mse(N.encode_scheduled(X.kv_states(s, d), _SCHEDULE, _at(s, d)), "layer", "side")


_add("encode_scheduled", _scheduled, f"""WITH {X.KV_CTE}, a AS (SELECT * FROM kv WHERE layer % 2 = 0), b AS (SELECT * FROM kv WHERE layer % 2 = 1), {Q._hat('h2', 'a', 'vec', Q.ROT, 2)}, {Q._hat('h3', 'b', 'vec', Q.ROT, 3)}
SELECT layer, side, round(avg({Q._apart('vec', "list_transform(u, lambda x: x * nrm * CASE WHEN side = 'key' THEN 1 ELSE g END)")}), 6) AS mse, count(*) AS n
FROM (SELECT layer, side, vec, u, nrm, {C.gain(D, 2)!r} AS g FROM h2 UNION ALL SELECT layer, side, vec, u, nrm, {C.gain(D, 3)!r} FROM h3) GROUP BY 1, 2""")


def _protected(s, d, targets: str = "both"):  # noqa: ANN001, ANN202
    flagged = P.protect(X.kv_states(s, d), P.raw_by_ratio(F.col("length"), 2.0, 0.5), start=1)
    return Q._mse(N.encode_protected(flagged, "mse", 2, _at(s, d), targets), "layer", "side")


for _t in ("both", "key"):
    _stay = "(r = 1 OR n - r < {raw} - 1)".format(raw=Q._NRAW) + (" AND side = 'key'" if _t == "key" else "")
    _add(f"encode_protected_{_t}", lambda s, d, t=_t: _protected(s, d, t), f"""{Q._SPOTS}, {Q._hat('h', 'kv', 'vec', Q.ROT, 2)}, f AS (SELECT seq_id, layer, side, pos, {_stay} AS stays FROM c)
    SELECT layer, side, round(avg(CASE WHEN stays THEN 0 ELSE {Q._apart('vec', 'list_transform(u, lambda x: x * nrm)')} END), 6) AS mse, count(*) AS n FROM h JOIN f USING (seq_id, layer, side, pos) GROUP BY 1, 2""")
_add("preset_naive_int4", lambda s, d: Q._mse(N.encode_preset(X.kv_states(s, d), "naive_int4", _at(s, d)), "layer", "side"), Q.ORACLE_SQL["uniform_token_int4"])
_add("crop_encode", lambda s, d: Q._mse(N.encode_kind(E.crop(X.kv_states(s, d), 8, -3), "mse", 2, _at(s, d)), "layer", "side"), _plain_sql(2, where="pos < 5"))
_add("reorder_encode", lambda s, d: Q._mse(N.encode_kind(E.reorder(X.kv_states(s, d), Q._beams(s, d)), "mse", 2, _at(s, d)), "seq_id"),
     f"WITH {X.KV_CTE}, {Q._BEAMS}, {Q._hat('h', 'kv', 'vec', Q.ROT, 2)} SELECT new_seq AS seq_id, round(avg({Q._apart('vec', 'list_transform(u, lambda x: x * nrm)')}), 6) AS mse, count(*) AS n FROM h JOIN beams ON seq_id = old_seq GROUP BY 1")


def _materialized(s, d):  # noqa: ANN001, ANN202
    m = V.codec("mse", D, 2)
    rows = E.materialize(V.decode(V.encode(X.kv_states(s, d), "vec", m), m), ["seq_id", "layer", "side", "head"])
    return rows.select("seq_id", "layer", "side", "head", "pos", "place", F.round(F.aggregate("vec_hat", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


_add("materialize_layer", _materialized, f"""WITH {X.KV_CTE}, {Q._hat('h', 'kv', 'vec', Q.ROT, 2)}
SELECT seq_id, layer, side, head, pos, row_number() OVER (PARTITION BY seq_id, layer, side, head ORDER BY pos, vec_id) AS place, round(nrm * list_sum(u), 4) AS total FROM h""")


def _legacy(s, d):  # noqa: ANN001, ANN202
    """Dense caches out and in again, then coded as one segment."""
    dense = E.to_dense(X.kv_states(s, d).select("seq_id", "layer", "side", "head", "pos", "vec"), ["seq_id", "layer", "side", "head"])
    return Q._mse(N.encode_kind(E.from_dense(dense), "mse", 2, _at(s, d)), "layer", "side")


_add("legacy_roundtrip", _legacy, _plain_sql(2))


def _label_recall(s, d):  # noqa: ANN001, ANN202
    rows, queries = Q._sets(s, d)
    m = V.codec("mse", D, 2)
    groups = rows.select(F.col("vec_id").alias("query_id"), F.col("label").alias("group"))
    return H.recall_by_group(H.topk(rows, queries, 1), H.topk(V.encode(rows, "vec", m), queries, 8, m), groups, [1, 2, 4, 8])


_add("recall_by_label", _label_recall, f"""WITH {Q._PLAIN}, {Q._EXACT}, {Q._hat('h', 'base', 'vec', Q.ROT, 2)},
ap AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM (SELECT q.vec_id AS query_id, h.vec_id, {Q._dot('q.vec', 'h.u')} / sqrt({Q._sq('q.vec')} * {Q._sq('h.u')}) AS score FROM base q, h WHERE q.vec_id % 20 = 0 AND h.vec_id <> q.vec_id))
SELECT b.label AS "group", CAST(k AS INT) AS k, avg((coalesce(place, 99) <= k)::INT) AS recall, count(*) AS n FROM ex LEFT JOIN ap USING (query_id, vec_id) JOIN base b ON b.vec_id = query_id, (SELECT unnest([1, 2, 4, 8]) AS k) WHERE rank = 1 GROUP BY 1, 2""")
_SIGNS = 4


def _sign_search(s, d):  # noqa: ANN001, ANN202
    return K.search_transforms(X.kv_states(s, d), [C.signed_hadamard(D, k) for k in range(_SIGNS)], [2, 3], ["layer", "side"]).withColumn("score", F.round("score", 6))


_SIGN_HATS = ", ".join(Q._hat(f"s{k}_{b}", (f"s{k}_{b - 1}" if b == 3 else f"s{k - 1}_3") if (k, b) != (0, 2) else "kv", "vec", C.signed_hadamard(D, k), b, tag=f"_{k}_{b}") for k in range(_SIGNS) for b in (2, 3))
_SIGN_ERRORS = ", ".join(f"avg({Q._apart('vec', f'list_transform(u_{k}_{b}, lambda x: x * nrm_{k}_{b})')}) AS e_{k}_{b}" for k in range(_SIGNS) for b in (2, 3))
_add("sign_search", _sign_search, f"WITH {X.KV_CTE}, {_SIGN_HATS}, e AS (SELECT layer, side, {_SIGN_ERRORS} FROM s{_SIGNS - 1}_3 GROUP BY 1, 2), c AS (SELECT layer, side, unnest([" + ", ".join(f"{{'k': {k}, 's': (e_{k}_2 / e_0_2 + e_{k}_3 / e_0_3) / 2}}" for k in range(_SIGNS)) + "]) AS c FROM e) SELECT layer, side, CAST(arg_min(c.k, c.s) AS INT) AS choice, round(min(c.s), 6) AS score FROM c GROUP BY 1, 2")


def _fractional_signs(s, d):  # noqa: ANN001, ANN202
    found = K.search_transforms(X.kv_states(s, d), [C.signed_hadamard(D, k) for k in range(3)], [2.5], ["layer", "side"])
    return found.withColumn("score", F.round("score", 6))


def _fractional_sign_sql(k: int) -> str:
    """Error of candidate k by layer and side at 2.5 bits: its own 32 coordinates of the high width, scales that fit best."""
    return f"""y{k} AS MATERIALIZED (SELECT kv.*, list_transform(m, lambda r: {Q._dot('r', 'vec')} / greatest(sqrt({Q._sq('vec')}), {V.EPS!r})) AS y FROM kv, (SELECT {Q._matrix(C.signed_hadamard(D, k))} AS m)),
    z{k} AS MATERIALIZED (SELECT vec_id, layer, side, i, y[i] AS y, {_snap('y[i]', 2)} AS lo, {_snap('y[i]', 3)} AS hi FROM y{k}, range(1, 65) t(i)),
    t{k} AS (SELECT layer, side, i, row_number() OVER (PARTITION BY layer, side ORDER BY sum((y - lo) ** 2 - (y - hi) ** 2) DESC, i) <= 32 AS hot FROM z{k} GROUP BY 1, 2, 3),
    f{k} AS (SELECT layer, side, vec_id, sum(y * CASE WHEN hot THEN hi ELSE lo END) AS yh, sum((CASE WHEN hot THEN hi ELSE lo END) ** 2) AS hh FROM z{k} JOIN t{k} USING (layer, side, i) GROUP BY ALL),
    e{k} AS (SELECT f{k}.layer, f{k}.side, {k} AS k, avg({Q._sq('vec')} * (1 - yh * yh / hh)) AS e FROM f{k} JOIN kv USING (vec_id) GROUP BY 1, 2)"""


def _rotation_by_attention(s, d):  # noqa: ANN001, ANN202
    """The rotation of the least attention output error by layer, for values."""
    kv = X.kv_states(s, d)
    keys, values, q = kv.filter("side = 'key'"), kv.filter("side = 'value'"), X.q_states(s, d)
    errors = [A.output_error(q, keys, N._roundtrip(values, V.codec("mse", D, 2, k)), ["layer"]).withColumn("rotation_id", F.lit(k)) for k in range(3)]
    return reduce(DataFrame.unionByName, errors).groupBy("layer").agg(F.min_by("rotation_id", F.struct("error", "rotation_id")).alias("rotation_id"), F.round(F.min("error"), 8).alias("error"))


_ROT_ERR = [f"o{k} AS (SELECT layer, avg(o * o) AS e FROM (SELECT p.seq_id, p.layer, p.q_head, p.q_pos, i, sum(p.p * (v.vec[i] - v.nrm_{k} * v.u_{k}[i])) AS o FROM pr p JOIN r2 v ON v.side = 'value' AND v.seq_id = p.seq_id AND v.layer = p.layer AND v.head = p.kv_head AND v.pos = p.pos, range(1, 65) t(i) GROUP BY ALL) GROUP BY 1)" for k in range(3)]
_add("rotation_by_attention", _rotation_by_attention, f"WITH {X.KV_CTE}, {X.q_cte()}, {Q._PROBS}, " + ", ".join(Q._hat(f"r{k}", f"r{k - 1}" if k else "kv", "vec", C.rotation(D, k), 2, tag=f"_{k}") for k in range(3)) + ", " + ", ".join(_ROT_ERR)
     + " SELECT layer, CAST(arg_min(k, e) AS INT) AS rotation_id, round(min(e), 8) AS error FROM (" + " UNION ALL ".join(f"SELECT layer, {k} AS k, e FROM o{k}" for k in range(3)) + ") GROUP BY 1")


def _blocks(s, d):  # noqa: ANN001, ANN202
    """Scalar codes, pairs of scalar codes and fitted pairs: errors by layer and side, and what pairs save."""
    kv = X.kv_states(s, d)
    made = {"scalar": V.codec("mse", D, 2), "block2": V.codec("mse_block2", D, 2), "learned": V.codec("learned_mse_block2", D, 2, blocks=V.fit_blocks(kv, "vec", 2))}
    rows = V.roundtrip(kv, "vec", made).groupBy("layer", "side").agg(*[F.avg(f"sse_{n}").alias(n) for n in made])
    return rows.select("layer", "side", *[F.round(n, 6).alias(n) for n in made], *[F.round(1 - F.col(n) / F.col("scalar"), 6).alias(f"{n}_reduction") for n in ("block2", "learned")])


_add("block_comparison", _blocks)


def _second_hadamard(s, d):  # noqa: ANN001, ANN202
    """Transforms from second moments of unit vectors, by layer and side, compared with the usual rotation."""
    kv = X.kv_states(s, d)
    found = K.transforms(K.second_moments(kv, ["layer", "side"]), ["layer", "side"], "second_hadamard").collect()  # one row for each layer and side
    matrices = {(r.layer, r.side): np.array(r.forward).reshape(D, D) for r in found}
    coded = Q._mse(N.by_layer(kv, 2, D, matrices, {}), "layer", "side").withColumnRenamed("mse", "calibrated")
    return coded.join(Q._mse(N._roundtrip(kv, V.codec("mse", D, 2)), "layer", "side").select("layer", "side", F.col("mse").alias("random")), ["layer", "side"])


_add("calibrated_transforms", _second_hadamard)


def _policies(s, d):  # noqa: ANN001, ANN202
    """Score errors of keys and channel counts by outlier policy."""
    kv, q = X.kv_states(s, d), X.q_states(s, d)
    parts = []
    for policy in ("dynamic_absmean", "error_gain", "attention_error_gain"):
        at = _at(s, d, True, policy=policy)
        coded = N.encode_kind(kv, "mse", 2.5, at).filter("side = 'key'")
        parts.append(A.error_metrics(q, coded, ["layer"]).select(F.lit(policy).alias("policy"), "layer", F.round("score_mae", 6).alias("score_mae"), F.round("score_rmse", 6).alias("score_rmse"), F.lit(C.resolve_bits(2.5, D)[2]).alias("n_channels")))
    return reduce(DataFrame.unionByName, parts)


_add("policy_comparison", _policies)
_KIND_CASE = "CASE layer WHEN 0 THEN 'mse' WHEN 1 THEN 'outlier_hadamard_mse' WHEN 2 THEN 'prod' ELSE 'fractional' END"


def _segments(s, d):  # noqa: ANN001, ANN202
    """Segment metadata: kind and width by layer."""
    kv = X.kv_states(s, d).withColumn("kind", F.expr(_KIND_CASE)).withColumn("bits", F.when(F.col("layer") == 3, 2.5).otherwise(3.0))
    return P.segment_table(kv, list(SEG), D)


_add("segment_storage", lambda s, d: P.storage_by_kind(_segments(s, d)).select(*SEG, "kind", "n", "bytes", "dense_bytes", F.round("ratio", 6).alias("ratio"), "effective_bits"),
     f"""WITH {X.KV_CTE}, g AS (SELECT seq_id, layer, side, {_KIND_CASE} AS kind, CASE layer WHEN 3 THEN 2.5::DOUBLE ELSE 3.0 END AS bits, count(*) AS n FROM kv GROUP BY ALL),
    b AS (SELECT *, CAST(CASE kind WHEN 'mse' THEN ceil(n * 64 * 3 / 8) + 2 * n WHEN 'outlier_hadamard_mse' THEN ceil(n * 64 * 3 / 8) + 2 * n + 3 * 64
      WHEN 'prod' THEN ceil(n * 64 * 2 / 8) + 2 * n + ceil(n * 64 / 8) + 2 * n ELSE ceil(n * 32 * 2 / 8) + ceil(n * 32 * 3 / 8) + 4 * n + 2 * 64 END AS BIGINT) AS bytes FROM g)
    SELECT seq_id, layer, side, kind, n, bytes, n * 128 AS dense_bytes, round(bytes / (n * 128), 6) AS ratio, bits AS effective_bits FROM b""")
_add("segment_table_roundtrip", lambda s, d: _segments(s, d).groupBy("kind").agg(F.count("*").alias("segments"), F.sum("n").alias("n"), F.max("low").cast("int").alias("low"), F.max("n_high").cast("int").alias("n_high")),
     f"WITH {X.KV_CTE} SELECT kind, count(*) AS segments, CAST(sum(n) AS BIGINT) AS n, CAST(CASE kind WHEN 'fractional' THEN 2 ELSE 3 END AS INT) AS low, CAST(CASE kind WHEN 'fractional' THEN 32 ELSE 0 END AS INT) AS n_high FROM (SELECT {_KIND_CASE} AS kind, count(*) AS n FROM kv GROUP BY seq_id, layer, side) GROUP BY 1")
_add("relative_errors", lambda s, d: A.relative_errors(N._roundtrip(X.kv_states(s, d), V.codec("mse", D, 2)), ["layer", "head", "side"]).withColumn("relative_l2", F.round("relative_l2", 6)),
     f"WITH {X.KV_CTE}, {Q._hat('h', 'kv', 'vec', Q.ROT, 2)} SELECT layer, head, side, round(sqrt(sum({Q._apart('vec', 'list_transform(u, lambda x: x * nrm)')}) / sum({Q._sq('vec')})), 6) AS relative_l2 FROM h GROUP BY 1, 2, 3")
_add("attention_key_output_error", lambda s, d: A.key_output_error(X.q_states(s, d), Q._coded(s, d, "key"), X.kv_states(s, d).filter("side = 'value'"), ["layer"]).withColumn("error", F.round("error", 7)),
     f"""WITH {Q._ERR}, ph AS (SELECT *, exp(sh) / sum(exp(sh)) OVER (PARTITION BY seq_id, layer, q_head, q_pos) AS p_hat FROM (SELECT pr.*, 0.125 * h.nrm * {Q._dot('pr.q', 'h.u')} AS sh FROM pr JOIN h USING (vec_id))),
    o AS (SELECT ph.seq_id, ph.layer, q_head, q_pos, i, sum((p - p_hat) * v.vec[i]) AS o FROM ph JOIN kv v ON v.side = 'value' AND v.seq_id = ph.seq_id AND v.layer = ph.layer AND v.head = ph.kv_head AND v.pos = ph.pos, range(1, 65) t(i) GROUP BY ALL)
    SELECT layer, round(avg(o * o), 7) AS error FROM o GROUP BY 1""")
# SQL for queries of the vector module whose choices it can follow.
_FACTORS = {
    "half_gain_mse": f"nrma * {1 + (C.gain(32, 2) - 1) / 2!r}",
    "clipped_gain_mse": f"nrma * least(greatest({Q._dot('lo', 'ua')} / {Q._sq('ua')} / nrma, 1), {C.gain(32, 2)!r})",
}
for _kind, _factor in _FACTORS.items():
    ORACLE_SQL[f"regular_{_kind}"] = f"""WITH {X.KV_CTE}, {Q._LONG}, {Q._TOP.format(n=32)}, {_HALVES}, {Q._hat('a', 'parts', 'lo', C.rotation(32, 0), 2, 32, 'a')}, {Q._hat('b', 'a', 'hi', C.rotation(32, 0), 3, 32, 'b')},
    c AS MATERIALIZED (SELECT *, {_factor} AS f FROM b) SELECT layer, side, round(avg({Q._apart('lo', 'list_transform(ua, lambda x: x * f)')} + {Q._apart('hi', 'list_transform(ub, lambda x: x * nrmb)')}), 6) AS mse, count(*) AS n FROM c GROUP BY 1, 2"""
ORACLE_SQL["regular_selected_gain_mse"] = f"""WITH {X.KV_CTE}, {Q._LONG}, {Q._TOP.format(n=32)}, {_HALVES}, {Q._hat('a', 'parts', 'lo', C.rotation(32, 0), 2, 32, 'a')}, {Q._hat('b', 'a', 'hi', C.rotation(32, 0), 3, 32, 'b')}
SELECT layer, side, round(avg(least({Q._apart('lo', 'list_transform(ua, lambda x: x * nrma)')}, {Q._apart('lo', f'list_transform(ua, lambda x: x * nrma * {C.gain(32, 2)!r})')}) + {Q._apart('hi', 'list_transform(ub, lambda x: x * nrmb)')}), 6) AS mse, count(*) AS n FROM b GROUP BY 1, 2"""
ORACLE_SQL["quarter_high2_mse"] = f"""WITH {X.KV_CTE}, {Q._LONG}, {Q._TOP.format(n=16)}, {_HALVES}, {Q._hat('a', 'parts', 'lo', C.rotation(48, 0), 2, 48, 'a')}, {Q._hat('b', 'a', 'hi', C.rotation(16, 0), 4, 16, 'b')}
SELECT layer, side, round(avg({Q._apart('lo', 'list_transform(ua, lambda x: x * nrma)')} + {Q._apart('hi', 'list_transform(ub, lambda x: x * nrmb)')}), 6) AS mse, count(*) AS n FROM b GROUP BY 1, 2"""
_BANK = ", ".join(Q._hat(f"b{k}", f"b{k - 1}" if k else "kv", "vec", C.rotation(D, k), 2, tag=f"_{k}") for k in range(4))
_BANK_E = ", ".join(f"{Q._apart('vec', f'list_transform(u_{k}, lambda x: x * nrm_{k})')} AS e{k}" for k in range(4))


def _bank_sql(keys: str) -> str:
    """Rotation of the least summed error by the given keys, for every row."""
    return f"WITH {X.KV_CTE}, {_BANK}, e AS MATERIALIZED (SELECT vec_id, seq_id, layer, side, {_BANK_E} FROM b3), c AS (SELECT {keys}, [sum(e0), sum(e1), sum(e2), sum(e3)] AS e FROM e GROUP BY ALL), p AS (SELECT *, CAST(list_position(e, list_min(e)) - 1 AS INT) AS rotation_id FROM c)"


ORACLE_SQL["bank4_segment"] = _bank_sql("seq_id, layer, side") + " SELECT layer, side, rotation_id, round(avg([e0, e1, e2, e3][rotation_id + 1]), 6) AS mse, count(*) AS n FROM e JOIN p USING (seq_id, layer, side) GROUP BY 1, 2, 3"
ORACLE_SQL["choose_rotation"] = _bank_sql("layer, side") + " SELECT layer, side, rotation_id, count(*) AS n FROM e JOIN p USING (layer, side) GROUP BY 1, 2, 3"
ORACLE_SQL["head_rotation_mse"] = f"WITH {X.KV_CTE}, " + ", ".join(f"k{h} AS (SELECT * FROM kv WHERE head = {h}), {Q._hat(f'h{h}', f'k{h}', 'vec', C.rotation(D, 100 + h), 2)}" for h in range(2)) + " SELECT layer, side, head, round(avg(" + Q._apart("vec", "list_transform(u, lambda x: x * nrm)") + "), 6) AS mse, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT layer, side, head, vec, u, nrm FROM h{h}" for h in range(2)) + ") GROUP BY 1, 2, 3"
_SH = f"sh AS MATERIALIZED (SELECT pr.*, 0.125 * h.nrm * {Q._dot('pr.q', 'h.u')} AS sh FROM pr JOIN h USING (vec_id)), ph AS MATERIALIZED (SELECT *, exp(sh) / sum(exp(sh)) OVER (PARTITION BY seq_id, layer, q_head, q_pos) AS p_hat FROM sh)"
ORACLE_SQL["attention_error_metrics"] = f"""WITH {Q._ERR}, {_SH}, per AS (SELECT layer, q_head, seq_id, q_pos, avg(abs(score - sh)) AS mae, avg((score - sh) ** 2) AS mse, avg(abs(p - p_hat)) AS pm, sum(abs(p - p_hat)) AS pl,
(arg_max(pos, score) = arg_max(pos, sh))::INT AS top1 FROM ph GROUP BY ALL) SELECT layer, q_head, round(avg(mae), 6) AS score_mae, round(sqrt(avg(mse)), 6) AS score_rmse, round(avg(pm), 6) AS prob_mae, round(avg(pl), 6) AS prob_l1, round(avg(top1), 6) AS top1_match FROM per GROUP BY 1, 2"""
_MEET = "h.side = 'value' AND h.seq_id = w.seq_id AND h.layer = w.layer AND h.head = w.kv_head AND h.pos = w.pos"
ORACLE_SQL["token_errors"] = f"""WITH {Q._ERR}, {_SH}, w AS (SELECT seq_id, layer, kv_head, pos, avg(p) AS w FROM pr GROUP BY ALL)
SELECT seq_id, layer, pos, round(avg(p * abs(score - sh)), 6) AS error, 'key' AS side FROM ph GROUP BY 1, 2, 3
UNION ALL SELECT h.seq_id, h.layer, h.pos, round(avg(w.w * {Q._apart('h.vec', 'list_transform(h.u, lambda x: x * h.nrm)')}), 6), 'value' FROM h JOIN w ON {_MEET} GROUP BY 1, 2, 3"""
ORACLE_SQL["attention_output_error"] = f"""WITH {Q._ERR}, o AS (SELECT w.seq_id, w.layer, q_head, q_pos, i, sum(w.p * (h.vec[i] - h.nrm * h.u[i])) AS o FROM pr w JOIN h ON {_MEET}, range(1, 65) t(i) GROUP BY ALL) SELECT layer, round(avg(o * o), 7) AS error FROM o GROUP BY 1"""
ORACLE_SQL["entropy_guard"] = f"""{Q._ATT}, r AS (SELECT seq_id, layer, avg(CASE WHEN n > 1 THEN h / ln(n) ELSE 0 END) AS r FROM (SELECT seq_id, layer, q_head, q_pos, -sum(p * ln(p)) AS h, count(*) AS n FROM pr GROUP BY ALL) GROUP BY 1, 2)
SELECT DISTINCT seq_id, layer, CASE WHEN r <= 0.999 THEN 'outlier_hadamard_mse' ELSE 'mse' END AS kind FROM kv LEFT JOIN r USING (seq_id, layer)"""
ORACLE_SQL["protect_attention_error"] = f"""WITH {Q._ERR}, {_SH}, w AS (SELECT seq_id, layer, kv_head, pos, avg(p) AS w FROM pr GROUP BY ALL),
e AS (SELECT seq_id, layer, pos, avg(p * abs(score - sh)) AS e, 'key' AS side FROM ph GROUP BY 1, 2, 3 UNION ALL SELECT h.seq_id, h.layer, h.pos, avg(w.w * {Q._apart('h.vec', 'list_transform(h.u, lambda x: x * h.nrm)')}), 'value' FROM h JOIN w ON {_MEET} GROUP BY 1, 2, 3),
s AS (SELECT DISTINCT seq_id, layer, side, pos FROM kv), c AS (SELECT *, count(*) OVER (PARTITION BY seq_id, layer, side) AS n, row_number() OVER (PARTITION BY seq_id, layer, side ORDER BY pos) = 1 AS sink FROM s)
SELECT seq_id, layer, side, pos, row_number() OVER (PARTITION BY seq_id, layer, side ORDER BY sink DESC, e DESC NULLS LAST, pos DESC) <= {Q._NRAW} AS is_raw FROM c LEFT JOIN e USING (seq_id, layer, side, pos)"""
_GAINS = f"WITH {X.KV_CTE}, {Q._hat('h2', 'kv', 'vec', Q.ROT, 2, tag='2')}, {Q._hat('h3', 'h2', 'vec', Q.ROT, 3, tag='3')}, g AS MATERIALIZED (SELECT seq_id, layer, side, i, avg((vec[i] - nrm2 * u2[i]) ** 2 - (vec[i] - nrm3 * u3[i]) ** 2) AS g FROM h3, range(1, 65) t(i) GROUP BY ALL)"
_add("error_gain_masks", lambda s, d: Q._mask_text(S.select_channels(S.channel_scores(X.kv_states(s, d), "error_gain", 2.5, list(SEG)), list(SEG), 32)),
     f"{_GAINS}, t AS (SELECT *, row_number() OVER (PARTITION BY seq_id, layer, side ORDER BY g DESC, i) <= 32 AS hot FROM g) SELECT seq_id, layer, side, string_agg(hot::INT::VARCHAR, '' ORDER BY i) AS mask FROM t GROUP BY 1, 2, 3")
_add("channels_by_side", lambda s, d: Q._mask_text(N.channel_masks(X.kv_states(s, d), 2.5, _at(s, d, policies={"key": "dynamic_absmean", "value": "error_gain"}))),
     f"""{_GAINS}, m AS (SELECT seq_id, layer, side, i, avg(abs(vec[i])) AS m FROM kv, range(1, 65) t(i) GROUP BY ALL),
    t AS (SELECT seq_id, layer, side, i, row_number() OVER (PARTITION BY seq_id, layer, side ORDER BY CASE WHEN side = 'key' THEN round(m, 9) ELSE g END DESC, i) <= 32 AS hot FROM g JOIN m USING (seq_id, layer, side, i))
    SELECT seq_id, layer, side, string_agg(hot::INT::VARCHAR, '' ORDER BY i) AS mask FROM t GROUP BY 1, 2, 3""")
_add("sensitivity_masks", lambda s, d: Q._mask_text(S.select_channels(S.channel_scores(X.kv_states(s, d), "sensitivity_error_gain", 2.5, list(SEG), static=Q._static(s, d), power=0.5), list(SEG), 24)),
     f"""{_GAINS}, v AS (SELECT *, greatest(g, 0) * sqrt(((i - 1) * 7 + layer * 3 + (side = 'key')::INT) % 13) AS v FROM g), t AS (SELECT *, row_number() OVER (PARTITION BY seq_id, layer, side ORDER BY v DESC, i) <= 24 AS hot FROM v)
    SELECT seq_id, layer, side, string_agg(hot::INT::VARCHAR, '' ORDER BY i) AS mask FROM t GROUP BY 1, 2, 3""")
_add("joint_masks", lambda s, d: Q._mask_text(S.joint_channels(S.channel_scores(X.kv_states(s, d), "error_gain", 2.5, list(SEG)), 64, D, list(SEG))),
     f"""{_GAINS}, n AS (SELECT *, greatest(g, 0) / greatest(avg(greatest(g, 0)) OVER (PARTITION BY seq_id, layer, side), 1e-30) AS v FROM g), p AS (SELECT *, row_number() OVER (PARTITION BY seq_id, layer, side ORDER BY v DESC, i) AS place FROM n),
    t AS (SELECT *, row_number() OVER (PARTITION BY seq_id, layer ORDER BY place > 1, place = 64, v DESC, side, i) <= 64 AND place < 64 AS hot FROM p) SELECT seq_id, layer, side, string_agg(hot::INT::VARCHAR, '' ORDER BY i) AS mask FROM t GROUP BY 1, 2, 3""")
_add("joint_attention_channels", lambda s, d: Q._mask_text(N.channel_masks(X.kv_states(s, d), 2.5, _at(s, d, True, policy="joint_attention_error_gain"))),
     f"""WITH {X.KV_CTE}, {X.q_cte()}, {Q._PROBS}, {Q._hat('h2', 'kv', 'vec', Q.ROT, 2, tag='2')}, {Q._hat('h3', 'h2', 'vec', Q.ROT, 3, tag='3')},
    w AS (SELECT seq_id, layer, kv_head AS head, pos, 'key' AS side, avg(p) AS w FROM pr GROUP BY ALL UNION ALL SELECT seq_id, layer, kv_head, pos, 'value', avg(p * p) FROM pr GROUP BY ALL),
    en AS (SELECT seq_id, layer, kv_head AS head, 'key' AS side, i, avg(q[i] * q[i]) AS en FROM queries, range(1, 65) t(i) GROUP BY ALL),
    r AS (SELECT h3.*, i, greatest((vec[i] - nrm2 * u2[i]) ** 2 - (vec[i] - nrm3 * u3[i]) ** 2, 0) AS gain FROM h3, range(1, 65) t(i)),
    g AS MATERIALIZED (SELECT seq_id, layer, side, i, avg(gain * coalesce(w, 1) * coalesce(en, 1)) AS g FROM r LEFT JOIN w USING (seq_id, layer, head, pos, side) LEFT JOIN en USING (seq_id, layer, head, side, i) GROUP BY ALL),
    n AS (SELECT *, g / greatest(avg(g) OVER (PARTITION BY seq_id, layer, side), 1e-30) AS v FROM g), p AS (SELECT *, row_number() OVER (PARTITION BY seq_id, layer, side ORDER BY v DESC, i) AS place FROM n),
    t AS (SELECT *, row_number() OVER (PARTITION BY seq_id, layer ORDER BY place > 1, place = 64, v DESC, side, i) <= 64 AND place < 64 AS hot FROM p) SELECT seq_id, layer, side, string_agg(hot::INT::VARCHAR, '' ORDER BY i) AS mask FROM t GROUP BY 1, 2, 3""")
_HEADS = f"WITH {X.KV_CTE}, {Q._LONG}, c AS (SELECT seq_id, layer, side, head, i, avg(abs(x)) AS s FROM long GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY seq_id, layer, side, head ORDER BY round(s, 9) DESC, i) <= 32 AS hot FROM c)"
_add("head_masks", lambda s, d: S.select_channels(S.channel_scores(X.kv_states(s, d), "head_dynamic_absmean", 2.5, list(SEG)), [*SEG, "head"], 32).select(*SEG, "head", F.array_join(F.transform("mask", lambda m: m.cast("int").cast("string")), "").alias("mask")),
     _HEADS + " SELECT seq_id, layer, side, head, string_agg(hot::INT::VARCHAR, '' ORDER BY i) AS mask FROM t GROUP BY 1, 2, 3, 4")


def _snap(value: str, bits: int) -> str:
    """The nearest centroid of a rotated unit coordinate, the lower one on ties."""
    c = C.codebook(D, bits)[0]
    return "CASE " + " ".join(f"WHEN {value} <= {(a + b) / 2!r} THEN {a!r}::DOUBLE" for a, b in zip(c, c[1:], strict=False)) + f" ELSE {c[-1]!r} END"


def _rotated_sql(shared: bool) -> str:
    score = "greatest(g, 0) / greatest(avg(greatest(g, 0)) OVER (PARTITION BY seq_id, layer, side), 1e-30)" if shared else "g"
    pool = "SELECT seq_id, layer, i, sum(v) AS v FROM n GROUP BY ALL" if shared else "SELECT seq_id, layer, side, i, v FROM n"
    keys = "seq_id, layer" if shared else "seq_id, layer, side"
    return f"""WITH {X.KV_CTE}, y AS MATERIALIZED (SELECT kv.*, list_transform(m, lambda r: {Q._dot('r', 'vec')} / greatest(sqrt({Q._sq('vec')}), {V.EPS!r})) AS y FROM kv, (SELECT {Q._matrix(Q.ROT)} AS m)),
    z AS MATERIALIZED (SELECT vec_id, seq_id, layer, side, i, y[i] AS y, {_snap('y[i]', 2)} AS lo, {_snap('y[i]', 3)} AS hi FROM y, range(1, 65) t(i)),
    g AS (SELECT seq_id, layer, side, i, avg((y - lo) ** 2 - (y - hi) ** 2) AS g FROM z GROUP BY ALL), n AS (SELECT *, {score} AS v FROM g), pool AS ({pool}),
    t AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY v DESC, i) <= 32 AS hot FROM pool),
    f AS (SELECT layer, side, vec_id, sum(y * CASE WHEN hot THEN hi ELSE lo END) AS yh, sum((CASE WHEN hot THEN hi ELSE lo END) ** 2) AS hh FROM z JOIN t USING ({keys}, i) GROUP BY ALL)
    SELECT f.layer, f.side, round(avg({Q._sq('vec')} * (1 - yh * yh / hh)), 6) AS mse, count(*) AS n FROM f JOIN kv USING (vec_id) GROUP BY 1, 2"""


ORACLE_SQL["rotated_outlier_2p5_own"], ORACLE_SQL["rotated_outlier_2p5_shared"] = _rotated_sql(False), _rotated_sql(True)
_COUNTS = f"WITH {X.KV_CTE} SELECT layer, side, CAST(sum(32) AS BIGINT) AS n_channels{{more}} FROM (SELECT DISTINCT seq_id, layer, side{{head}} FROM kv) GROUP BY 1, 2"
ORACLE_SQL["channels_error_gain"] = _COUNTS.format(more=", count(*) AS n_segments", head="")
ORACLE_SQL["channels_sensitivity"] = _COUNTS.format(more="", head="")
for _policy in ("head_dynamic_absmean", "head_error_gain"):
    ORACLE_SQL[f"channels_{_policy}"] = _COUNTS.format(more=", count(*) AS n_segments", head=", head")
ORACLE_SQL["channels_joint"] = f"SELECT seq_id, layer, CAST(sum(n) AS BIGINT) AS n_channels, CAST(min(n) AS INT) AS least FROM (SELECT seq_id, layer, len(replace(mask, '0', '')) AS n FROM ({ORACLE_SQL['joint_masks']})) GROUP BY 1, 2"
ORACLE_SQL["attention_channels"] = f"""WITH {X.KV_CTE}, {X.q_cte()}, {Q._PROBS}, {Q._hat('h2', 'kv', 'vec', Q.ROT, 2, tag='2')}, {Q._hat('h3', 'h2', 'vec', Q.ROT, 3, tag='3')}, w AS (SELECT vec_id, avg(p) AS w FROM pr GROUP BY 1),
g AS (SELECT seq_id, layer, side, i, avg(w * greatest((vec[i] - nrm2 * u2[i]) ** 2 - (vec[i] - nrm3 * u3[i]) ** 2, 0)) AS g FROM h3 JOIN w USING (vec_id), range(1, 65) t(i) GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY seq_id, layer, side ORDER BY g DESC, i) <= 32 AS hot FROM g) SELECT seq_id, layer, side, string_agg(hot::INT::VARCHAR, '' ORDER BY i) AS mask FROM t GROUP BY 1, 2, 3"""
for _kind in ("pca", "second_hadamard"):
    ORACLE_SQL[f"transform_{_kind}"] = "SELECT DISTINCT CASE WHEN vec_id % 2 = 0 THEN 'key' ELSE 'value' END AS side, 0.0::DOUBLE AS distance FROM embeddings"
_add("sign_search_2p5", _fractional_signs, f"WITH {X.KV_CTE}, " + ", ".join(_fractional_sign_sql(k) for k in range(3)) + """
SELECT a.layer, a.side, CAST(arg_min(a.k, a.e) AS INT) AS choice, round(min(a.e / b.e), 6) AS score FROM (SELECT * FROM e0 UNION ALL SELECT * FROM e1 UNION ALL SELECT * FROM e2) a JOIN e0 b ON a.layer = b.layer AND a.side = b.side GROUP BY 1, 2""")
_FACTOR2 = {
    "lowbit_gain_mse": f"nrm * {C.gain(D, 2)!r}", "lowbit_half_gain_mse": f"nrm * {1 + (C.gain(D, 2) - 1) / 2!r}",
    "lowbit_clipped_gain_mse": f"nrm * least(greatest({Q._dot('vec', 'u')} / {Q._sq('u')} / nrm, 1), {C.gain(D, 2)!r})",
}
ORACLE_SQL["lowbit_variants_2"] = f"WITH {X.VECTORS_CTE}, {Q._hat('h', 'vectors', 'vec', Q.ROT, 2)} SELECT label, " + ", ".join(
    [f"round(avg({Q._apart('vec', f'list_transform(u, lambda x: x * {f})')}), 5) AS {k}" for k, f in _FACTOR2.items()]
    + [f"round(avg(least({Q._apart('vec', 'list_transform(u, lambda x: x * nrm)')}, {Q._apart('vec', 'list_transform(u, lambda x: x * ' + _FACTOR2['lowbit_gain_mse'] + ')')})), 5) AS lowbit_selected_gain_mse"]
) + " FROM h GROUP BY 1"
ORACLE_SQL["code_table"] = f"WITH {X.KV_CTE}, {Q._hat('h', 'kv', 'vec', Q.ROT, 3)} SELECT vec_id, layer, side, round(nrm * sqrt({Q._sq('u')}), 4) AS norm, array_to_string(codes, ',') AS codes FROM h"
ORACLE_SQL["fractional_codes"] = Q._SPLIT_SQL.replace("GAIN", "1.0")
ORACLE_SQL["encode_segment_stream"] = Q._SPLIT_SQL.replace("GAIN", "1.0").replace("seq_id, layer, side", "seq_id, layer, side, pos")
