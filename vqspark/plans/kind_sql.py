"""SQL for queries of the kind and vector modules that needs every channel's decoded value: dealt blocks, choices by attention.

`long` tables hold one row for each vector and channel with the decoded value of every candidate; errors, attention scores
and choices by segment are sums over them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import constants as C
from ..operators import calibration as M
from . import kind_queries as K
from . import vector_queries as Q

D = Q.D
QUERIES: dict = {}
ORACLE_SQL: dict = {}
SEG = "seq_id, layer, side"


def _dealt(parts: str, group: str = "", blocks: int = 4) -> str:
    """Places of channels: by falling size within a segment (and group), dealt to blocks of 16."""
    by = f"{SEG}{', ' + group if group else ''}"
    return f"SELECT *, (p % {blocks}) * 16 + p // {blocks} + 1 AS place FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY s DESC, i) - 1 AS p, row_number() OVER (PARTITION BY {by} ORDER BY i) AS j FROM {parts})"


def _whole(bits: int) -> str:
    """hats: plain (v0) and flattened (v1) values of every channel at a whole width."""
    return f"""WITH {X.KV_CTE}, {Q._LONG}, size AS MATERIALIZED (SELECT {SEG}, i, sum(abs(x)) AS s FROM long GROUP BY ALL), spots AS MATERIALIZED ({_dealt('size')}),
    dealt AS MATERIALIZED (SELECT vec_id, {SEG}, list(x ORDER BY place) AS z, list(x ORDER BY i) AS vec FROM long JOIN spots USING ({SEG}, i) GROUP BY ALL),
    {Q._hat('a', 'dealt', 'vec', Q.ROT, bits, tag='a')}, {Q._hat('b', 'a', 'z', C.block_hadamard(D, 16, 0), bits, tag='b')},
    hats AS MATERIALIZED (SELECT l.*, nrma * ua[l.i] AS v0, nrmb * ub[spots.place] AS v1 FROM long l JOIN spots USING ({SEG}, i) JOIN b USING (vec_id))"""


def _split() -> str:
    """hats at 2.5 bits: v0 plain, v1 flattened in both sub-spaces, g the regular gain, w plain at 2 bits; parts by `hot`."""
    low = f"nrma * ua[j] * CASE WHEN hot THEN 1 ELSE {C.gain(32, 2)!r} END"
    return f"""WITH {X.KV_CTE}, {Q._LONG}, {Q._TOP.format(n=32)}, spots AS MATERIALIZED ({_dealt('top', 'hot', 2)}),
    parts AS MATERIALIZED (SELECT vec_id, {SEG}, list(x ORDER BY j) FILTER (NOT hot) AS lo, list(x ORDER BY j) FILTER (hot) AS hi, list(x ORDER BY place) FILTER (NOT hot) AS zlo, list(x ORDER BY place) FILTER (hot) AS zhi, list(x ORDER BY i) AS vec FROM long JOIN spots USING ({SEG}, i) GROUP BY ALL),
    {Q._hat('a', 'parts', 'lo', C.rotation(32, 0), 2, 32, 'a')}, {Q._hat('b', 'a', 'hi', C.rotation(32, 0), 3, 32, 'b')}, {Q._hat('c', 'b', 'zlo', C.block_hadamard(32, 16, 0), 2, 32, 'c')}, {Q._hat('d', 'c', 'zhi', C.block_hadamard(32, 16, 0), 3, 32, 'd')}, {Q._hat('f', 'd', 'vec', Q.ROT, 2, tag='f')},
    hats AS MATERIALIZED (SELECT l.*, hot, CASE WHEN hot THEN nrmb * ub[j] ELSE nrma * ua[j] END AS v0, CASE WHEN hot THEN nrmd * ud[place] ELSE nrmc * uc[place] END AS v1, CASE WHEN hot THEN nrmb * ub[j] ELSE {low} END AS g, nrmf * uf[l.i] AS w
        FROM long l JOIN spots USING ({SEG}, i) JOIN f USING (vec_id))"""


def _mean(base: str, value: str) -> str:
    """Mean squared error by layer and side of one expression of hats."""
    return f"{base} SELECT layer, side, round(sum((x - ({value})) ** 2) / count(DISTINCT vec_id), 6) AS mse, count(DISTINCT vec_id) AS n FROM hats GROUP BY 1, 2"


def _least(base: str, values: tuple[str, ...]) -> str:
    """The candidate of the least squared error of each segment."""
    sums = ", ".join(f"sum((x - ({v})) ** 2)" for v in values)
    return f"{base}, g AS (SELECT layer, side, count(DISTINCT vec_id) AS n, least({sums}) AS sse FROM hats GROUP BY {SEG}) SELECT layer, side, round(sum(sse) / sum(n), 6) AS mse, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY 1, 2"


def by_attention(base: str, values: tuple[str, ...]) -> str:
    """CTEs from hats to e (by vector: sse, a list) and choice (by segment: k, from 1), the least error of attention."""
    sse = ", ".join(f"sum((x - ({v})) ** 2)" for v in values)
    other = ", ".join(f"sum(q[i] * ({v})) * 0.125" for v in values)
    mean = lambda e: "[" + ", ".join(e.format(k=k) for k in range(1, len(values) + 1)) + "]"
    return f"""{base}, {X.q_cte()}, {Q._PROBS}, e AS MATERIALIZED (SELECT vec_id, {SEG}, head, pos, [{sse}] AS sse FROM hats GROUP BY ALL),
    o AS MATERIALIZED (SELECT p.seq_id, p.layer, q_head, q_pos, p.vec_id, any_value(p.p) AS p, any_value(p.score) AS score, [{other}] AS other FROM pr p JOIN hats h ON h.vec_id = p.vec_id GROUP BY ALL),
    w AS (SELECT seq_id, layer, kv_head AS head, pos, avg(p * p) AS w FROM pr GROUP BY ALL),
    met AS (SELECT seq_id, layer, 'key' AS side, {mean('avg(p * (score - other[{k}]) ** 2)')} AS err FROM o GROUP BY 1, 2 UNION ALL SELECT seq_id, layer, 'value', {mean('avg(w * sse[{k}])')} FROM e JOIN w USING (seq_id, layer, head, pos) WHERE side = 'value' GROUP BY 1, 2),
    spare AS (SELECT {SEG}, {mean('avg(sse[{k}])')} AS sp FROM e GROUP BY ALL),
    choice AS MATERIALIZED (SELECT {SEG}, list_position(coalesce(err, sp), list_min(coalesce(err, sp))) AS k FROM spare LEFT JOIN met USING ({SEG}))"""


def _chosen(base: str, values: tuple[str, ...]) -> str:
    return f"{by_attention(base, values)} SELECT layer, side, round(avg(sse[k]), 6) AS mse, count(*) AS n FROM e JOIN choice USING ({SEG}) GROUP BY 1, 2"


for _mode, _sql in (
    ("always", _mean(_whole(2), "v1")), ("segment", _least(_whole(2), ("v0", "v1"))),
    ("vector", f"{_whole(2)}, e AS (SELECT layer, side, vec_id, sum((x - v0) ** 2) AS a, sum((x - v1) ** 2) AS b FROM hats GROUP BY ALL) SELECT layer, side, round(avg(CASE WHEN b < 0.95 * a THEN b ELSE a END), 6) AS mse, count(*) AS n FROM e GROUP BY 1, 2"),
):
    ORACLE_SQL[f"outlier_hadamard_{_mode}"] = _sql
ORACLE_SQL["kind_hadamard_rate_regime_mse"] = f"{_whole(2)}, e AS (SELECT layer, side, vec_id, sum((x - v0) ** 2) AS a, sum((x - v1) ** 2) AS b FROM hats GROUP BY ALL) SELECT layer, side, round(avg(CASE WHEN side = 'value' AND b < 0.95 * a THEN b ELSE a END), 6) AS mse, count(*) AS n FROM e GROUP BY 1, 2"
ORACLE_SQL["kind_rate_hadamard_value_mse"] = _mean(_whole(3), "CASE WHEN side = 'value' AND layer >= 2 THEN v1 ELSE v0 END")
ORACLE_SQL["kind_regular_outlier_hadamard_mse"] = _mean(_split(), "CASE WHEN hot THEN v0 ELSE v1 END")
ORACLE_SQL["kind_outlier_only_hadamard_mse"] = _mean(_split(), "CASE WHEN hot THEN v1 ELSE v0 END")
ORACLE_SQL["kind_bitwidth_attention_outlier_hadamard_mse"] = _mean(_split(), "v1")
ORACLE_SQL["kind_adaptive_outlier_hadamard_mse"] = _least(_split(), ("v0", "v1"))
_RATIO = "ratio AS (SELECT seq_id, layer, avg(CASE WHEN n > 1 THEN h / ln(n) ELSE 0 END) AS r FROM (SELECT seq_id, layer, q_head, q_pos, -sum(p * ln(p)) AS h, count(*) AS n FROM pr GROUP BY ALL) GROUP BY 1, 2)"
ORACLE_SQL["kind_entropy_guarded_outlier_hadamard_mse"] = f"""{_split()}, {X.q_cte()}, {Q._PROBS}, {_RATIO}
    SELECT h.layer, side, round(sum((x - CASE WHEN side = 'value' AND r <= 0.999 THEN v1 ELSE v0 END) ** 2) / count(DISTINCT vec_id), 6) AS mse, count(DISTINCT vec_id) AS n FROM hats h LEFT JOIN ratio USING (seq_id, layer) GROUP BY 1, 2"""
ORACLE_SQL["kind_attention_adaptive_regular_gain_mse"] = _chosen(_split(), ("v0", "g"))
_BANK = f"WITH {X.KV_CTE}, {Q._LONG}, {K._BANK}, hats AS MATERIALIZED (SELECT l.*, " + ", ".join(f"nrm_{k} * u_{k}[l.i] AS v{k}" for k in range(4)) + " FROM long l JOIN b3 USING (vec_id))"
ORACLE_SQL["kind_attention_rotation_bank_mse"] = _chosen(_BANK, ("v0", "v1", "v2", "v3"))
ORACLE_SQL["kind_shared_rotated_outlier_mse"] = K._rotated_sql(True)


def _rotated_by_layer() -> str:
    """Rotated outliers whose transform is that of the layer."""
    turned = " UNION ALL ".join(f"SELECT kv.*, list_transform(m, lambda r: {Q._dot('r', 'vec')} / greatest(sqrt({Q._sq('vec')}), {K.V.EPS!r})) AS y FROM kv, (SELECT {Q._matrix(C.rotation(D, 20 + k))} AS m) WHERE layer = {k}" for k in range(4))
    return f"""WITH {X.KV_CTE}, y AS MATERIALIZED ({turned}), z AS MATERIALIZED (SELECT vec_id, {SEG}, i, y[i] AS y, {K._snap('y[i]', 2)} AS lo, {K._snap('y[i]', 3)} AS hi FROM y, range(1, 65) t(i)),
    t AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {SEG} ORDER BY g DESC, i) <= 32 AS hot FROM (SELECT {SEG}, i, avg((y - lo) ** 2 - (y - hi) ** 2) AS g FROM z GROUP BY ALL)),
    f AS (SELECT layer, side, vec_id, sum(y * CASE WHEN hot THEN hi ELSE lo END) AS yh, sum((CASE WHEN hot THEN hi ELSE lo END) ** 2) AS hh FROM z JOIN t USING ({SEG}, i) GROUP BY ALL)
    SELECT f.layer, f.side, round(avg({Q._sq('vec')} * (1 - yh * yh / hh)), 6) AS mse, count(*) AS n FROM f JOIN kv USING (vec_id) GROUP BY 1, 2"""


ORACLE_SQL["kind_calibrated_rotated_outlier_mse"] = _rotated_by_layer()
# Coefficients of the residual in the Hadamard basis: what is left is their size less what 32 signs of one level take away.
_RESIDUAL = f"""WITH {X.KV_CTE}, {Q._hat('h', 'kv', 'vec', Q.ROT, 2)}, r AS MATERIALIZED (SELECT *, list_transform(list_zip(vec, u), lambda z: z[1] - nrm * z[2]) AS gap FROM h),
    c AS MATERIALIZED (SELECT vec_id, {SEG}, i, {Q._dot('m[i]', 'gap')} AS c FROM r, (SELECT {Q._matrix(C.signed_hadamard(D, 3))} AS m), range(1, 65) t(i))"""
ORACLE_SQL["hadamard_residual_mse"] = f"""{_RESIDUAL}, s AS (SELECT vec_id, sqrt(sum(c * c)) AS size FROM c GROUP BY 1),
    t AS (SELECT *, row_number() OVER (PARTITION BY {SEG} ORDER BY g DESC, i) <= 32 AS hot FROM (SELECT {SEG}, i, sum(abs(c) / size) AS g FROM c JOIN s USING (vec_id) GROUP BY ALL)),
    e AS (SELECT layer, side, vec_id, sum(c * c) - sum(CASE WHEN hot THEN abs(c) ELSE 0 END) ** 2 / 32 AS e FROM c JOIN t USING ({SEG}, i) GROUP BY ALL) SELECT layer, side, round(avg(e), 6) AS mse, count(*) AS n FROM e GROUP BY 1, 2"""


def _heads() -> str:
    """Two heads mixed by position, coded and mixed back; positions that lack one are coded as they are."""
    m = C.signed_hadamard(2, 0)
    both = lambda a, b, k: f"list_transform(list_zip({a}, {b}), lambda z: z[1] * {float(m[k, 0])!r} + z[2] * {float(m[k, 1])!r})"
    back = lambda k: f"list_transform(list_zip(list_transform(u0, lambda x: x * nrm0), list_transform(u1, lambda x: x * nrm1)), lambda z: z[1] * {float(m.T[k, 0])!r} + z[2] * {float(m.T[k, 1])!r})"
    return f"""WITH {X.KV_CTE}, pairs AS (SELECT {SEG}, pos, max(CASE WHEN head = 0 THEN vec END) AS x0, max(CASE WHEN head = 1 THEN vec END) AS x1 FROM kv GROUP BY ALL),
    mixed AS MATERIALIZED (SELECT {SEG}, pos, x0, x1, {both('x0', 'x1', 0)} AS mix0, {both('x0', 'x1', 1)} AS mix1 FROM pairs WHERE x0 IS NOT NULL AND x1 IS NOT NULL), {Q._hat('a', 'mixed', 'mix0', Q.ROT, 2, tag='0')}, {Q._hat('b', 'a', 'mix1', Q.ROT, 2, tag='1')},
    single AS (SELECT layer, side, head, vec FROM kv ANTI JOIN mixed USING ({SEG}, pos)), {Q._hat('c', 'single', 'vec', Q.ROT, 2, tag='c')},
    e AS (SELECT layer, side, 0 AS head, {Q._apart('x0', back(0))} AS e FROM b UNION ALL SELECT layer, side, 1, {Q._apart('x1', back(1))} FROM b UNION ALL SELECT layer, side, head, {Q._apart('vec', 'list_transform(uc, lambda x: x * nrmc)')} FROM c)
    SELECT layer, side, head, round(avg(e), 6) AS mse, count(*) AS n FROM e GROUP BY 1, 2, 3"""


ORACLE_SQL["head_hadamard_mse"] = _heads()
_RMS = f"""WITH {X.KV_CTE}, {Q._LONG}, {Q._TOP.format(n=32)}, r AS (SELECT {SEG}, i, greatest(sqrt(avg(x * x)), {K.V.EPS!r}) AS r, count(*) AS n FROM long GROUP BY ALL),
    k AS MATERIALIZED (SELECT {SEG}, i, hot, CASE WHEN n <= 1 THEN 1 ELSE r / exp(avg(ln(r)) OVER (PARTITION BY {SEG}, hot)) END AS r FROM r JOIN top USING ({SEG}, i)),
    parts AS MATERIALIZED (SELECT vec_id, {SEG}, list(x / r ORDER BY i) FILTER (NOT hot) AS lo, list(x / r ORDER BY i) FILTER (hot) AS hi, list(r ORDER BY i) FILTER (NOT hot) AS rlo, list(r ORDER BY i) FILTER (hot) AS rhi FROM long JOIN k USING ({SEG}, i) GROUP BY ALL),
    {Q._hat('a', 'parts', 'lo', C.rotation(32, 0), 2, 32, 'a')}, {Q._hat('b', 'a', 'hi', C.rotation(32, 0), 3, 32, 'b')}"""
_SCALED = lambda v, u, r, f: f"list_sum(list_transform(list_zip({v}, {u}, {r}), lambda z: ((z[1] - z[2] * {f}) * z[3]) ** 2))"
ORACLE_SQL["kind_rms_regular_gain_mse"] = f"{_RMS} SELECT layer, side, round(avg({_SCALED('lo', 'ua', 'rlo', f'nrma * {C.gain(32, 2)!r}')} + {_SCALED('hi', 'ub', 'rhi', 'nrmb')}), 6) AS mse, count(*) AS n FROM b GROUP BY 1, 2"


def _picked(base: str, values: tuple[str, str]) -> str:
    """Keys coded one way or the other by segment, plain where no query meets them."""
    return f"""{by_attention(base, values)}, kept AS (SELECT vec_id, e.layer, sse, CASE WHEN err IS NULL OR err[1] <= err[2] THEN 1 ELSE 2 END AS k FROM e LEFT JOIN met USING ({SEG}) WHERE e.side = 'key')
    SELECT layer, ['mse', 'other'][k] AS kind, round(avg(sse[k]), 6) AS mse, count(*) AS n FROM kept GROUP BY 1, 2"""


ORACLE_SQL["attention_pick_outlier_hadamard"] = _picked(_whole(2), ("v0", "v1"))
ORACLE_SQL["attention_pick_regular_gain"] = _picked(_split(), ("w", "g"))


def _moments(s, d):  # noqa: ANN001, ANN202
    """Second moments after each transform that is made from them: trace, squares on the diagonal and off it."""
    held = M.second_moments(X.kv_states(s, d), ["side"], unit=False)
    parts = []
    for kind in ("pca", "whiten", "second_hadamard"):
        made = M.transformed_moments(M.transforms(held, ["side"], kind), held, ["side"], D)
        on = F.col("k") == F.col("l")
        total = lambda c, v: F.round(F.sum(F.when(c, v).otherwise(0.0)), 5)
        parts.append(made.groupBy("side").agg(total(on, F.col("value")).alias("trace"), total(on, F.col("value") ** 2).alias("diagonal"), total(~on, F.col("value") ** 2).alias("off")).withColumn("kind", F.lit(kind)))
    return reduce(DataFrame.unionByName, parts)


QUERIES["transformed_moments"] = _moments
# A diagonal has all of the squares; equal shares have the least; white ones are ones.
ORACLE_SQL["transformed_moments"] = f"""WITH {X.KV_CTE}, m AS (SELECT side, i, j, avg(vec[i] * vec[j]) AS m FROM kv, range(1, 65) a(i), range(1, 65) b(j) GROUP BY ALL),
    t AS (SELECT side, sum(CASE WHEN i = j THEN m ELSE 0 END) AS tr, sum(m * m) AS sq FROM m GROUP BY 1)
    SELECT side, 'pca' AS kind, round(tr, 5) AS trace, round(sq, 5) AS diagonal, 0.0::DOUBLE AS off FROM t UNION ALL SELECT side, 'whiten', 64.0, 64.0, 0.0 FROM t
    UNION ALL SELECT side, 'second_hadamard', round(tr, 5), round(tr * tr / 64, 5), round(sq - tr * tr / 64, 5) FROM t"""
