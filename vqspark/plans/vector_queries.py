"""Queries over vectors: codecs, segment kinds, attention, search, storage, calibration; with SQL where it can follow."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import constants as C
from ..operators import attention as A
from ..operators import calibration as K
from ..operators import codec as V
from ..operators import gates as G
from ..operators import protection as P
from ..operators import search as N
from ..operators import segments as S
from ..streaming import encode as E

QUERIES, ORACLE_SQL = {}, {}
D = 64
SEG = ["seq_id", "layer", "side"]


def _add(name: str, query, sql: str | None = None) -> None:  # noqa: ANN001
    QUERIES[name] = query
    if sql is not None:
        ORACLE_SQL[name] = sql


def _list(values) -> str:  # noqa: ANN001
    return "[" + ", ".join(repr(float(v)) + "::DOUBLE" for v in values) + "]"


def _matrix(m: np.ndarray) -> str:
    return "[" + ", ".join(_list(r) for r in m) + "]"


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"


def _sq(a: str) -> str:
    return f"list_sum(list_transform({a}, lambda x: x * x))"


def _apart(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _hat(out: str, source: str, vec: str, forward: np.ndarray, bits: int, d: int | None = None, tag: str = "") -> str:
    """CTEs from `source` to `out` with norm (nrm), codes and the decoded direction (u) of a list column."""
    c = C.codebook(d or len(forward), bits)[0]
    mids = [(a + b) / 2 for a, b in zip(c, c[1:], strict=False)]
    return f"""
{out}_n AS MATERIALIZED (SELECT *, greatest(sqrt({_sq(vec)}), {V.EPS!r}) AS nrm{tag} FROM {source}),
{out}_y AS MATERIALIZED (SELECT s.*, list_transform(m, lambda r: {_dot('r', vec)} / nrm{tag}) AS y{tag} FROM {out}_n s, (SELECT {_matrix(forward)} AS m)),
{out}_c AS MATERIALIZED (SELECT *, list_transform(y{tag}, lambda v: len(list_filter({_list(mids)}, lambda m: m < v))) AS codes{tag} FROM {out}_y),
{out} AS MATERIALIZED (SELECT s.*, list_transform(m, lambda r: {_dot('r', f'list_transform(codes{tag}, lambda k: {_list(c)}[k + 1])')}) AS u{tag} FROM {out}_c s, (SELECT {_matrix(forward.T)} AS m))"""


ROT, HAD = C.rotation(D, 0), C.signed_hadamard(D, 0)
_PLAIN = "base AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec FROM embeddings)"


def _plain(s, d):  # noqa: ANN001, ANN202
    return X.spread(X.table(s, d, "embeddings")).select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


def _mse(df, *keys):  # noqa: ANN001, ANN202
    return df.withColumn("_e", S.squared_error()).groupBy(*keys).agg(F.round(F.avg("_e"), 6).alias("mse"), F.count("*").alias("n"))


_add("vec_norms", lambda s, d: X.vectors(s, d).select("vec_id", F.round(V.l2_norm("vec"), 6).alias("norm")), f"WITH {X.VECTORS_CTE} SELECT vec_id, round(sqrt({_sq('vec')}), 6) AS norm FROM vectors")
_add("hadamard_rotate", lambda s, d: V.apply_transform(_plain(s, d), "vec", HAD).select("vec_id", F.posexplode("rotated").alias("ch", "y")).select("vec_id", "ch", F.round("y", 5).alias("y")),
     f"""WITH {_PLAIN}, y AS (SELECT vec_id, list_transform(m, lambda r: {_dot('r', 'vec')}) AS y FROM base, (SELECT {_matrix(HAD)} AS m))
    SELECT vec_id, CAST(i - 1 AS INT) AS ch, round(y[i], 5) AS y FROM (SELECT *, unnest(range(1, 65)) AS i FROM y)""")
_add("srht_mse", lambda s, d: V.roundtrip(_plain(s, d), "vec", {"srht": V.codec("srht_mse", D, 2)}).groupBy("label").agg(F.round(F.avg("sse_srht"), 6).alias("mse")),
     f"WITH {_PLAIN}, {_hat('h', 'base', 'vec', C.srht(D, 0), 2)} SELECT label, round(avg({_apart('vec', 'list_transform(u, lambda x: x * nrm)')}), 6) AS mse FROM h GROUP BY 1")


def _codes(kind: str, bits: int):  # noqa: ANN202
    return lambda s, d: V.encode(_plain(s, d), "vec", V.codec(kind, D, bits)).select("vec_id", F.array_join(F.transform("codes", lambda c: c.cast("string")), ",").alias("codes"))


for _name, _kind, _bits, _m in (("hadamard_codes_2bit", "hadamard_mse", 2, HAD), ("dense_codes_3bit", "mse", 3, ROT)):
    _add(_name, _codes(_kind, _bits), f"WITH {_PLAIN}, {_hat('h', 'base', 'vec', _m, _bits)} SELECT vec_id, array_to_string(codes, ',') AS codes FROM h")
_add("distortion_by_label", lambda s, d: V.roundtrip(_plain(s, d), "vec", {f"b{b}": V.codec("mse", D, b) for b in (1, 2, 3, 4)}).groupBy("label").agg(*[F.round(F.avg(f"sse_b{b}"), 6).alias(f"mse_{b}") for b in (1, 2, 3, 4)]),
     f"WITH {_PLAIN}, " + ", ".join(_hat(f"h{b}", f"h{b - 1}" if b > 1 else "base", "vec", ROT, b, tag=str(b)) for b in (1, 2, 3, 4)) + " SELECT label, " + ", ".join(f"round(avg({_apart('vec', f'list_transform(u{b}, lambda x: x * nrm{b})')}), 6) AS mse_{b}" for b in (1, 2, 3, 4)) + " FROM h4 GROUP BY 1")
_GAINS = ["mse", "unit_mse", "lsq_mse", "gain_mse", "half_gain_mse", "clipped_gain_mse", "selected_gain_mse", "dot_gain_mse"]


def _gain_sql(bits: int) -> str:
    g, dg = C.gain(D, bits), C.gain(D, bits, 1.0)
    scaled = lambda f: _apart("vec", f"list_transform(u, lambda x: x * ({f}))")
    return f"""WITH {X.VECTORS_CTE}, {_hat('h', 'vectors', 'vec', ROT, bits)}, f AS MATERIALIZED (SELECT *, {_dot('vec', 'u')} / {_sq('u')} AS fit, sqrt({_sq('u')}) AS un FROM h), e AS (SELECT label, {scaled('nrm')} AS mse, {scaled('nrm / un')} AS unit_mse,
    {scaled('fit')} AS lsq_mse, {scaled(f'nrm * {g}')} AS gain_mse, {scaled(f'nrm * {1 + (g - 1) / 2}')} AS half_gain_mse, {scaled(f'nrm * least(greatest(fit / nrm, 1), {g})')} AS clipped_gain_mse,
    least({scaled('nrm')}, {scaled(f'nrm * {g}')}) AS selected_gain_mse, {scaled(f'nrm * {dg}')} AS dot_gain_mse FROM f) SELECT label, """ + ", ".join(f"round(avg({k}), 5) AS {k}" for k in _GAINS) + " FROM e GROUP BY 1"


_add("gain_variants_mse", lambda s, d: V.roundtrip(X.vectors(s, d), "vec", {k: V.codec(k, D, 2) for k in _GAINS}).groupBy("label").agg(*[F.round(F.avg(f"sse_{k}"), 5).alias(k) for k in _GAINS]), _gain_sql(2))
_LOW = ["lowbit_gain_mse", "lowbit_half_gain_mse", "lowbit_clipped_gain_mse", "lowbit_selected_gain_mse"]
_add("lowbit_variants_2", lambda s, d: V.roundtrip(X.vectors(s, d), "vec", {k: V.codec(k, D, 2) for k in _LOW}).groupBy("label").agg(*[F.round(F.avg(f"sse_{k}"), 5).alias(k) for k in _LOW]))
_add("lowbit_variants", lambda s, d: V.roundtrip(X.vectors(s, d), "vec", {k: V.codec(k, D, 3) for k in _LOW}).groupBy("label").agg(*[F.round(F.avg(f"sse_{k}"), 5).alias(k) for k in _LOW]),
     f"WITH {X.VECTORS_CTE}, {_hat('h', 'vectors', 'vec', ROT, 3)}, e AS (SELECT label, {_apart('vec', 'list_transform(u, lambda x: x * nrm)')} AS e FROM h) SELECT label, " + ", ".join(f"round(avg(e), 5) AS {k}" for k in _LOW) + " FROM e GROUP BY 1")
_add("block2_mse", lambda s, d: V.roundtrip(_plain(s, d), "vec", {"b": V.codec("mse_block2", D, 2)}).groupBy("label").agg(F.round(F.avg("sse_b"), 6).alias("mse")),
     f"WITH {_PLAIN}, {_hat('h', 'base', 'vec', ROT, 2)} SELECT label, round(avg({_apart('vec', 'list_transform(u, lambda x: x * nrm)')}), 6) AS mse FROM h GROUP BY 1")


def _learned(s, d):  # noqa: ANN001, ANN202
    rows = X.vectors(s, d)
    blocks = V.fit_blocks(rows, "vec", 2)
    return V.roundtrip(rows, "vec", {k: V.codec(k, D, 2, blocks=blocks) for k in ("learned_mse_block2", "learned_unit_mse_block2")}).groupBy("label").agg(F.round(F.avg("sse_learned_mse_block2"), 6).alias("learned"), F.round(F.avg("sse_learned_unit_mse_block2"), 6).alias("learned_unit"))


_add("learned_blocks", _learned)
_add("pack_roundtrip", lambda s, d: V.unpack(V.pack(V.encode(_plain(s, d), "vec", V.codec("hadamard_mse", D, 3)), 3), 3, D).select("vec_id", F.length("packed").cast("long").alias("n_bytes"), (F.col("codes") == F.col("codes_back")).alias("same")), "SELECT vec_id, CAST(24 AS BIGINT) AS n_bytes, true AS same FROM embeddings")
_add("codebooks", lambda s, d: C.codebook_table(s, D, [1, 2, 3]).join(X.table(s, d, "embeddings").agg(F.first(F.size("embedding")).alias("dim")), "dim").select("dim", "bits", "idx", F.round("centroid", 9).alias("centroid")),
     " UNION ALL ".join(f"SELECT DISTINCT CAST(len(embedding) AS INT) AS dim, CAST({b} AS INT) AS bits, CAST(i AS INT) AS idx, round({_list(C.codebook(D, b)[0])}[i + 1], 9) AS centroid FROM embeddings, range({1 << b}) r(i)" for b in (1, 2, 3)))


def _prod(s, d):  # noqa: ANN001, ANN202
    """Mean and variance of inner-product errors over all pairs of rows and queries (ids divisible by 50).

    They follow from the first and second moments of both sides, so pairs are never made: with residuals r and queries q,
    the mean of (r q) is the product of means, that of (r q)^2 the sum over products of second moments.
    """
    rows = _plain(s, d)
    made = V.prod_encode(rows, "vec", 3).select("vec_id", "vec", F.col("vec_hat").alias("prod_hat"))
    made = V.decode(V.encode(made, "vec", V.codec("mse", D, 3)), V.codec("mse", D, 3), "mse_hat")
    gap = lambda h: F.zip_with("vec", h, lambda a, b: a - b)
    sides = [made.select(F.lit(h).alias("h"), gap(h).alias("vec")) for h in ("mse_hat", "prod_hat")] + [rows.filter("vec_id % 50 = 0").select(F.lit("q").alias("h"), "vec")]
    sides = sides[0].unionByName(sides[1]).unionByName(sides[2])
    first = S.channel_sums(sides, "vec", ["h"], lambda x, _: x).select("h", "ch", (F.col("total") / F.col("n")).alias("m"))
    second = K.second_moments(sides, ["h"], unit=False)
    q1, q2 = (x.filter("h = 'q'").drop("h").withColumnRenamed(c, "q") for x, c in ((first, "m"), (second, "value")))
    mean = first.filter("h <> 'q'").join(q1, "ch").groupBy("h").agg(F.sum(F.col("m") * F.col("q")).alias("mean"))
    square = second.filter("h <> 'q'").join(q2, ["i", "j"]).groupBy("h").agg(F.sum(F.col("value") * F.col("q")).alias("square"))
    both = mean.join(square, "h").withColumn("var", F.col("square") - F.col("mean") ** 2)
    return both.agg(*[F.round(F.max(F.when(F.col("h") == h, F.col(c))), 6).alias(f"{c}_{h}") for h in ("mse_hat", "prod_hat") for c in ("mean", "var")])


_sk = np.random.default_rng(17).standard_normal((D, D))
_add("prod_ip_error", _prod, f"""WITH {_PLAIN}, {_hat('h2', 'base', 'vec', ROT, 2, tag='2')}, {_hat('h3', 'h2', 'vec', ROT, 3, tag='3')},
r AS MATERIALIZED (SELECT *, list_transform(list_zip(vec, u2), lambda z: z[1] - z[2] * nrm2) AS rest FROM h3),
sg AS MATERIALIZED (SELECT r.*, list_transform(m, lambda k: CASE WHEN {_dot('k', 'rest')} >= 0 THEN 1.0 ELSE -1.0 END) AS sg FROM r, (SELECT {_matrix(_sk)} AS m)),
p AS MATERIALIZED (SELECT sg.*, list_transform(m, lambda k: {_dot('k', 'sg')} * {np.sqrt(np.pi / 2) / D} * sqrt({_sq('rest')})) AS add FROM sg, (SELECT {_matrix(_sk.T)} AS m)),
e AS (SELECT {_dot('p.vec', 'q.vec')} - p.nrm3 * {_dot('p.u3', 'q.vec')} AS a, {_dot('p.vec', 'q.vec')} - p.nrm2 * {_dot('p.u2', 'q.vec')} - {_dot('p.add', 'q.vec')} AS b FROM p, base q WHERE q.vec_id % 50 = 0)
SELECT round(avg(a), 6) AS mean_mse_hat, round(var_pop(a), 6) AS var_mse_hat, round(avg(b), 6) AS mean_prod_hat, round(var_pop(b), 6) AS var_prod_hat FROM e""")

_add("uniform_token_int4", lambda s, d: _mse(S.uniform(X.kv_states(s, d), 4), "layer", "side"),
     f"WITH {X.KV_CTE}, q AS (SELECT *, list_max(list_transform(vec, lambda x: abs(x))) / 7 AS s FROM kv) SELECT layer, side, round(avg(list_sum(list_transform(vec, lambda x: (x - round(x / s) * s) ** 2))), 6) AS mse, count(*) AS n FROM q GROUP BY 1, 2")
_LONG = "long AS MATERIALIZED (SELECT seq_id, layer, side, head, pos, vec_id, i, vec[i] AS x FROM kv, range(1, 65) r(i))"
_add("uniform_channel_int4", lambda s, d: _mse(S.uniform(X.kv_states(s, d), 4, "channel"), "layer", "side"),
     f"WITH {X.KV_CTE}, {_LONG}, q AS (SELECT *, max(abs(x)) OVER (PARTITION BY seq_id, layer, side, head, i) / 7 AS s FROM long) SELECT layer, side, round(sum((x - coalesce(round(x / nullif(s, 0)) * s, 0)) ** 2) / count(DISTINCT vec_id), 6) AS mse, count(DISTINCT vec_id) AS n FROM q GROUP BY 1, 2")
_add("centered_mse", lambda s, d: _mse(S.centered(X.kv_states(s, d), 2), "layer", "side"),
     f"""WITH {X.KV_CTE}, {_LONG}, m AS (SELECT *, x - avg(x) OVER (PARTITION BY seq_id, layer, side, head, i) AS r FROM long), c AS (SELECT layer, side, vec_id, list(r ORDER BY i) AS vec FROM m GROUP BY ALL),
    {_hat('h', 'c', 'vec', ROT, 2)} SELECT layer, side, round(avg({_apart('vec', 'list_transform(u, lambda x: x * nrm)')}), 6) AS mse, count(*) AS n FROM h GROUP BY 1, 2""")
_add("rms_rotation_mse", lambda s, d: _mse(S.rms_rotation(X.kv_states(s, d), 2), "layer", "side"),
     f"""WITH {X.KV_CTE}, {_LONG}, r AS (SELECT *, sqrt(avg(x * x) OVER (PARTITION BY seq_id, layer, side, i)) AS rms FROM long), g AS (SELECT *, rms / exp(avg(ln(rms)) OVER (PARTITION BY seq_id, layer, side)) AS k FROM r),
    c AS (SELECT layer, side, vec_id, list(x / k ORDER BY i) AS vec, list(x ORDER BY i) AS orig, list(k ORDER BY i) AS ks FROM g GROUP BY ALL), {_hat('h', 'c', 'vec', ROT, 2)}
    SELECT layer, side, round(avg(list_sum(list_transform(list_zip(orig, u, ks), lambda z: (z[1] - z[2] * nrm * z[3]) ** 2))), 6) AS mse, count(*) AS n FROM h GROUP BY 1, 2""")
_TOP = "score AS MATERIALIZED (SELECT seq_id, layer, side, i, avg(abs(x)) AS s FROM long GROUP BY ALL), top AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY seq_id, layer, side ORDER BY round(s, 9) DESC, i) <= {n} AS hot FROM score)"


def _mask_text(masks):  # noqa: ANN001, ANN202
    return masks.select(*SEG, F.array_join(F.transform("mask", lambda m: m.cast("int").cast("string")), "").alias("mask"))


_add("channel_absmean_top", lambda s, d: _mask_text(S.select_channels(S.channel_scores(X.kv_states(s, d), "dynamic_absmean", 2.5, SEG), SEG, 4)),
     f"WITH {X.KV_CTE}, {_LONG}, {_TOP.format(n=4)} SELECT seq_id, layer, side, string_agg(hot::INT::VARCHAR, '' ORDER BY i) AS mask FROM top GROUP BY 1, 2, 3")
for _p in ("error_gain", "head_dynamic_absmean", "head_error_gain"):
    _add(f"channels_{_p}", lambda s, d, p=_p: S.select_channels(S.channel_scores(X.kv_states(s, d), p, 2.5, SEG), [*SEG, *(["head"] if "head" in p else [])], 32).groupBy("layer", "side").agg(F.sum(F.size(F.filter("mask", lambda m: m))).alias("n_channels"), F.count("*").alias("n_segments")))


def _static(s, d):  # noqa: ANN001, ANN202
    rows = [(layer, side, ch, float((ch * 7 + layer * 3 + (side == "key")) % 13)) for layer in range(4) for side in ("key", "value") for ch in range(D)]
    return s.createDataFrame(rows, "layer long, side string, ch int, score double")


_add("channels_static", lambda s, d: _mask_text(S.select_channels(S.channel_scores(X.kv_states(s, d), "static_score", 2.5, SEG, static=_static(s, d)), SEG, 32)),
     f"""WITH {X.KV_CTE}, c AS (SELECT DISTINCT seq_id, layer, side FROM kv), t AS (SELECT *, row_number() OVER (PARTITION BY seq_id, layer, side ORDER BY (ch * 7 + layer * 3 + (side = 'key')::INT) % 13 DESC, ch) <= 32 AS hot FROM c, range(64) r(ch))
    SELECT seq_id, layer, side, string_agg(hot::INT::VARCHAR, '' ORDER BY ch) AS mask FROM t GROUP BY 1, 2, 3""")
_add("channels_sensitivity", lambda s, d: S.select_channels(S.channel_scores(X.kv_states(s, d), "sensitivity_error_gain", 2.5, SEG, static=_static(s, d), power=0.5), SEG, 32).groupBy("layer", "side").agg(F.sum(F.size(F.filter("mask", lambda m: m))).alias("n_channels")))
_add("channels_joint", lambda s, d: S.joint_channels(S.channel_scores(X.kv_states(s, d), "error_gain", 2.5, SEG), 64, D, SEG).groupBy("seq_id", "layer").agg(F.sum(F.size(F.filter("mask", lambda m: m))).alias("n_channels"), F.min(F.size(F.filter("mask", lambda m: m))).alias("least")))
_SPLIT_SQL = f"""WITH {X.KV_CTE}, {_LONG}, {_TOP.format(n=32)}, parts AS (SELECT layer, side, vec_id, list(x ORDER BY i) FILTER (hot) AS hi, list(x ORDER BY i) FILTER (NOT hot) AS lo FROM long JOIN top USING (seq_id, layer, side, i) GROUP BY ALL),
{_hat('a', 'parts', 'lo', C.rotation(32, 0), 2, 32, 'a')}, {_hat('b', 'a', 'hi', C.rotation(32, 0), 3, 32, 'b')}
SELECT layer, side, round(avg({_apart('lo', 'list_transform(ua, lambda x: x * nrma * GAIN)')} + {_apart('hi', 'list_transform(ub, lambda x: x * nrmb)')}), 6) AS mse, count(*) AS n FROM b GROUP BY 1, 2"""
_add("fractional_2p5_mse", lambda s, d: _mse(S.encode_fractional(X.kv_states(s, d), 2.5, keys=SEG), "layer", "side"), _SPLIT_SQL.replace('GAIN', '1.0'))
_add("regular_gain_2p5_mse", lambda s, d: _mse(S.encode_fractional(X.kv_states(s, d), 2.5, kinds=("gain_mse", "mse"), keys=SEG), "layer", "side"), _SPLIT_SQL.replace('GAIN', repr(C.gain(32, 2))))
for _k in ("half_gain_mse", "selected_gain_mse", "clipped_gain_mse"):
    _add(f"regular_{_k}", lambda s, d, k=_k: _mse(S.encode_fractional(X.kv_states(s, d), 2.5, kinds=(k, "mse"), keys=SEG), "layer", "side"))
_add("quarter_high2_mse", lambda s, d: _mse(S.encode_fractional(X.kv_states(s, d), 2.5, keys=SEG, allocation="quarter_high2"), "layer", "side"))
_add("resolve_bits", lambda s, d: s.createDataFrame([(b, p, *C.resolve_bits(b, D, p)) for b in (2.0, 2.5, 3.25, 3.5) for p in ("blend", "quarter_high2")], "bits double, policy string, low int, high int, n int").crossJoin(X.table(s, d, "embeddings").select((F.col("label") % 2).alias("g")).distinct()))


def _auto(s, d):  # noqa: ANN001, ANN202
    names = ["mse", "unit_mse", "selected_gain_mse", "learned_unit_mse_block2"]
    rows = X.kv_states(s, d)
    blocks = V.fit_blocks(rows, "vec", 2)
    return S.pick_by_segment(V.roundtrip(rows, "vec", {k: V.codec(k, D, 2, blocks=blocks if "learned" in k else None) for k in names}), SEG, names)


_add("auto_kind", _auto)
for _m in ("always", "segment", "vector"):
    _add(f"outlier_hadamard_{_m}", lambda s, d, m=_m: _mse(S.outlier_hadamard(X.kv_states(s, d), 2, m, 0.95 if m == "vector" else 1.0, SEG), "layer", "side"))
for _n, _o in (("own", {}), ("shared", {"shared": True})):
    _add(f"rotated_outlier_2p5_{_n}", lambda s, d, o=_o: _mse(S.rotated_outliers(X.kv_states(s, d), 2.5, SEG, **o), "layer", "side"))
_add("bank4_choice", lambda s, d: S.rotation_bank(X.vectors(s, d), 2).select("vec_id", "rotation_id", F.round(S.squared_error(), 5).alias("sse")),
     f"WITH {X.VECTORS_CTE}, " + ", ".join(_hat(f"h{k}", f"h{k - 1}" if k else "vectors", "vec", C.rotation(D, k), 2, tag=f"_{k}") for k in range(4)) + ", e AS (SELECT vec_id, [" + ", ".join(_apart("vec", f"list_transform(u_{k}, lambda x: x * nrm_{k})") for k in range(4)) + "] AS e FROM h3) SELECT vec_id, CAST(list_position(e, list_min(e)) - 1 AS INT) AS rotation_id, round(list_min(e), 5) AS sse FROM e")
_add("bank4_segment", lambda s, d: _mse(S.rotation_bank(X.kv_states(s, d), 2, 4, "segment", SEG), "layer", "side", "rotation_id"))
_add("head_rotation_mse", lambda s, d: _mse(S.head_rotation(X.kv_states(s, d), 2), "layer", "side", "head"))
_add("head_hadamard_mse", lambda s, d: _mse(S.head_hadamard(X.kv_states(s, d), 2), "layer", "side", "head"))
_add("hadamard_residual_mse", lambda s, d: _mse(S.hadamard_residual(X.kv_states(s, d), 2.5, SEG), "layer", "side"))


def _keys(s, d):  # noqa: ANN001, ANN202
    return X.kv_states(s, d).filter("side = 'key'")


def _coded(s, d, side: str, kind: str = "mse", bits: int = 2):  # noqa: ANN001, ANN202
    m = V.codec(kind, D, bits)
    rows = V.decode(V.encode(X.kv_states(s, d).filter(F.col("side") == side), "vec", m), m)
    return rows.withColumn("unit_hat", F.transform("vec_hat", lambda x: x / F.col("scale")))


_PROBS = f"""sc AS MATERIALIZED (SELECT q.seq_id, q.layer, q_head, q_pos, q.kv_head, k.pos, k.vec_id, q.q, {_dot('q.q', 'k.vec')} * 0.125 AS score FROM queries q JOIN kv k ON k.seq_id = q.seq_id AND k.layer = q.layer AND k.head = q.kv_head AND k.side = 'key'),
pr AS MATERIALIZED (SELECT *, exp(score - max(score) OVER w) / sum(exp(score)) OVER w * exp(max(score) OVER w) AS p FROM sc WINDOW w AS (PARTITION BY seq_id, layer, q_head, q_pos))"""
_ATT = f"WITH {X.KV_CTE}, {X.q_cte()}, {_PROBS}"
_add("attention_probs", lambda s, d: A.attention_probs(X.q_states(s, d), _keys(s, d)).select("seq_id", "layer", "q_head", "pos", F.round("score", 6).alias("score"), F.round("p", 6).alias("p")), _ATT + " SELECT seq_id, layer, q_head, pos, round(score, 6) AS score, round(p, 6) AS p FROM pr")
_add("attention_entropy", lambda s, d: A.entropy_ratio(A.attention_probs(X.q_states(s, d), _keys(s, d)), ["seq_id", "layer"]).withColumn("entropy_ratio", F.round("entropy_ratio", 6)),
     _ATT + " SELECT seq_id, layer, round(avg(CASE WHEN n > 1 THEN h / ln(n) ELSE 0 END), 6) AS entropy_ratio FROM (SELECT seq_id, layer, q_head, q_pos, -sum(p * ln(p)) AS h, count(*) AS n FROM pr GROUP BY ALL) GROUP BY 1, 2")
_ERR = f"{X.KV_CTE}, {X.q_cte()}, {_PROBS}, {_hat('h', 'kv', 'vec', ROT, 2)}"
_add("attention_error", lambda s, d: A.key_error(X.q_states(s, d), _coded(s, d, "key"), ["seq_id", "layer"]).withColumn("error", F.round("error", 6)),
     f"WITH {_ERR} SELECT pr.seq_id, pr.layer, round(avg(p * (score - 0.125 * h.nrm * {_dot('pr.q', 'h.u')}) ** 2), 6) AS error FROM pr JOIN h USING (vec_id) GROUP BY 1, 2")
_add("attention_value_error", lambda s, d: A.value_error(X.q_states(s, d), _keys(s, d), _coded(s, d, "value"), ["seq_id", "layer"]).withColumn("error", F.round("error", 6)),
     f"WITH {_ERR}, w AS (SELECT seq_id, layer, kv_head, pos, avg(p * p) AS w FROM pr GROUP BY ALL) SELECT h.seq_id, h.layer, round(avg(w * {_apart('h.vec', 'list_transform(h.u, lambda x: x * h.nrm)')}), 6) AS error FROM h JOIN w ON h.side = 'value' AND h.seq_id = w.seq_id AND h.layer = w.layer AND h.head = w.kv_head AND h.pos = w.pos GROUP BY 1, 2")
_add("attention_scale", lambda s, d: A.attention_scale(X.q_states(s, d), _coded(s, d, "key")).withColumn("attention_scale", F.round("attention_scale", 5)),
     f"WITH {_ERR} SELECT pr.seq_id, pr.layer, pr.kv_head AS head, pr.pos, round(greatest(sum(score * 0.125 * {_dot('pr.q', 'h.u')}) / sum((0.125 * {_dot('pr.q', 'h.u')}) ** 2), 0), 5) AS attention_scale FROM pr JOIN h USING (vec_id) GROUP BY 1, 2, 3, 4")
_add("token_errors", lambda s, d: A.token_errors(X.q_states(s, d), _coded(s, d, "key"), _coded(s, d, "value")).withColumn("error", F.round("error", 6)))
_add("attention_error_metrics", lambda s, d: A.error_metrics(X.q_states(s, d), _coded(s, d, "key"), ["layer", "q_head"]).select("layer", "q_head", *(F.round(c, 6).alias(c) for c in ("score_mae", "score_rmse", "prob_mae", "prob_l1", "top1_match"))))
_add("attention_output_error", lambda s, d: A.output_error(X.q_states(s, d), _keys(s, d), _coded(s, d, "value"), ["layer"]).withColumn("error", F.round("error", 7)))
_add("entropy_guard", lambda s, d: A.guard_by_entropy(X.kv_states(s, d).select("seq_id", "layer").distinct(), A.entropy_ratio(A.attention_probs(X.q_states(s, d), _keys(s, d)), ["seq_id", "layer"]), ["seq_id", "layer"], 0.999, "outlier_hadamard_mse").select("seq_id", "layer", "kind"))
_add("attention_channels", lambda s, d: S.select_channels(S.channel_scores(_keys(s, d).join(A.token_weights(X.q_states(s, d), _keys(s, d)), ["seq_id", "layer", "head", "pos"]), "attention_error_gain", 2.5, SEG, weight="weight"), SEG, 32).select(*SEG, F.array_join(F.transform("mask", lambda m: m.cast("int").cast("string")), "").alias("mask")))


def _attention_pick(s, d):  # noqa: ANN001, ANN202
    names, keys = ["mse", "gain_mse", "unit_mse", "learned_unit_mse_block2"], _keys(s, d)
    blocks = V.fit_blocks(keys, "vec", 2)
    made = {k: V.codec(k, D, 2, blocks=blocks if "learned" in k else None) for k in names}
    errors = [A.key_error(X.q_states(s, d), V.decode(V.encode(keys, "vec", m), m), ["seq_id", "layer"]).withColumnRenamed("error", f"sse_{k}") for k, m in made.items()]
    every = errors[0]
    for e in errors[1:]:
        every = every.join(e, ["seq_id", "layer"])
    return S.pick_by_segment(every, ["seq_id", "layer"], names)


_add("attention_auto_kind", _attention_pick)


def _spots(df):  # noqa: ANN001, ANN202
    return df.select("seq_id", "layer", "side", "pos", "is_raw").distinct()


_NRAW = "least(greatest(CAST(floor(n * (16 * 0.5 - 2.0) / 14.0) AS BIGINT), 1), n)"
_SPOTS = f"WITH {X.KV_CTE}, s AS (SELECT DISTINCT seq_id, layer, side, pos FROM kv), c AS (SELECT *, count(*) OVER (PARTITION BY seq_id, layer, side) AS n, row_number() OVER (PARTITION BY seq_id, layer, side ORDER BY pos) AS r FROM s)"
_add("protect_sink_recent", lambda s, d: _spots(P.protect(X.kv_states(s, d), P.raw_by_ratio(F.col("length"), 2.0, 0.5), start=1)), _SPOTS + f" SELECT seq_id, layer, side, pos, r = 1 OR n - r < {_NRAW} - 1 AS is_raw FROM c")
_NORM = f", w AS (SELECT seq_id, layer, side, pos, avg(sqrt({_sq('vec')})) AS w FROM kv GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY seq_id, layer, side ORDER BY (r = 1) DESC, round(w, 9) DESC, pos DESC) AS k FROM c JOIN w USING (seq_id, layer, side, pos))"


def _norm_weights(df):  # noqa: ANN001, ANN202
    return df.groupBy("seq_id", "layer", "side", "pos").agg(F.round(F.avg(V.l2_norm("vec")), 9).alias("weight"))


_add("protect_norm_aware", lambda s, d: _spots(P.protect(X.kv_states(s, d), P.raw_by_ratio(F.col("length"), 2.0, 0.5), "norm_aware", 1, importance=_norm_weights(X.kv_states(s, d)))), _SPOTS + _NORM + f" SELECT seq_id, layer, side, pos, k <= {_NRAW} AS is_raw FROM o")
_add("protect_by_bytes", lambda s, d: P.mixed_bits(P.protect(X.kv_states(s, d), P.raw_by_bytes(F.col("length"), 4.0, 2.0), start=1), 2.0, SEG),
     _SPOTS + ", b AS (SELECT *, CAST(floor(n * 2.0 / 14.0) AS BIGINT) AS b FROM c), z AS (SELECT seq_id, layer, side, pos, (r <= least(1, b)) OR n - r < b - 1 AS is_raw FROM b) SELECT seq_id, layer, side, avg(CASE WHEN is_raw THEN 16.0 ELSE 2.0 END) AS effective_bits, CAST(sum(is_raw::INT) AS BIGINT) AS n_raw FROM kv JOIN z USING (seq_id, layer, side, pos) GROUP BY 1, 2, 3")
_SCHEDULE = [(layer, side, b, "mse") for layer, b in enumerate((2.0, 3.0, 2.5, 3.5)) for side in ("key", "value")]


def _scheduled(s, d):  # noqa: ANN001, ANN202
    return P.with_schedule(X.kv_states(s, d), s.createDataFrame(_SCHEDULE, "layer long, side string, bits double, kind string"))


_add("unscheduled_layers", lambda s, d: P.unscheduled(X.kv_states(s, d), s.createDataFrame(_SCHEDULE[:5], "layer long, side string, bits double, kind string")), f"WITH {X.KV_CTE} SELECT DISTINCT layer, side FROM kv WHERE layer * 2 + (side = 'value')::INT >= 5")
_SIZE = "CAST(ceil(n * 64 * bits / 8) + n * 2 + CASE WHEN bits = floor(bits) THEN 0 ELSE 64 END AS BIGINT)"
_STORE = f"WITH {X.KV_CTE}, st AS (SELECT seq_id, layer, side, [2.0, 3.0, 2.5, 3.5][layer + 1]::DOUBLE AS bits, count(*) AS n FROM kv GROUP BY ALL)"


def _stored(s, d):  # noqa: ANN001, ANN202
    return P.storage(_scheduled(s, d), SEG, D, F.col("bits"), F.when(F.col("bits") == F.floor("bits"), 0).otherwise(64))


_add("storage_ratio", lambda s, d: _stored(s, d).withColumn("ratio", F.round("ratio", 6)), _STORE + f" SELECT seq_id, layer, side, n, {_SIZE} AS bytes, n * 128 AS dense_bytes, round({_SIZE} / (n * 128), 6) AS ratio, bits AS effective_bits FROM st")
_add("compression_summary", lambda s, d: P.compression_summary(_stored(s, d), ["side"]).withColumn("widths", F.array_join(F.transform("widths", lambda x: x.cast("string")), ",")), _STORE + f" SELECT side, count(*) AS n_segments, avg(bits) AS avg_bits, string_agg(DISTINCT bits, ',' ORDER BY bits) AS widths, CAST(sum({_SIZE}) AS BIGINT) AS bytes FROM st GROUP BY 1")


def _sets(s, d):  # noqa: ANN001, ANN202
    """All rows, and as queries those whose id is divisible by 20."""
    rows = _plain(s, d)
    return rows, rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "vec")


_EXACT = f"sc AS (SELECT q.vec_id AS query_id, b.vec_id, {_dot('q.vec', 'b.vec')} / sqrt({_sq('q.vec')} * {_sq('b.vec')}) AS score FROM base q, base b WHERE q.vec_id % 20 = 0 AND b.vec_id <> q.vec_id), ex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM sc)"
_add("exact_topk", lambda s, d: N.topk(*_sets(s, d), 3).select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", F.round("score", 5).alias("score")), f"WITH {_PLAIN}, {_EXACT} SELECT query_id, rank, vec_id, round(score, 5) AS score FROM ex WHERE rank <= 3")


def _recall(s, d, bits: int):  # noqa: ANN001, ANN202
    database, queries = _sets(s, d)
    m = V.codec("mse", D, bits)
    approx = N.topk(V.encode(database, "vec", m), queries, 16, m)
    return N.recall(N.topk(database, queries, 1), approx, [1, 2, 4, 8, 16]).withColumn("bits", F.lit(bits))


def _recall_sql(bits: int) -> str:
    return f"""WITH {_PLAIN}, {_EXACT}, {_hat('h', 'base', 'vec', ROT, bits)},
    ap AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM (SELECT q.vec_id AS query_id, h.vec_id, {_dot('q.vec', 'h.u')} / sqrt({_sq('q.vec')} * {_sq('h.u')}) AS score FROM base q, h WHERE q.vec_id % 20 = 0 AND h.vec_id <> q.vec_id))
    SELECT CAST(k AS INT) AS k, avg((place <= k)::INT) AS recall, CAST({bits} AS INT) AS bits FROM ex JOIN ap USING (query_id, vec_id), (SELECT unnest([1, 2, 4, 8, 16]) AS k) WHERE rank = 1 GROUP BY k"""


_add("ann_recall", lambda s, d: _recall(s, d, 2), _recall_sql(2))
_add("ann_recall_sweep", lambda s, d: _recall(s, d, 1).unionByName(_recall(s, d, 3)), f"SELECT * FROM ({_recall_sql(1)}) UNION ALL BY NAME SELECT * FROM ({_recall_sql(3)})")
_add("gram_moment", lambda s, d: K.second_moments(X.kv_states(s, d), ["layer", "side"]).filter("i <= j").withColumn("value", F.round("value", 6)),
     f"WITH {X.KV_CTE}, u AS (SELECT layer, side, list_transform(vec, lambda x: x / sqrt({_sq('vec')})) AS u FROM kv) SELECT layer, side, CAST(i - 1 AS INT) AS i, CAST(j - 1 AS INT) AS j, round(avg(u[i] * u[j]), 6) AS value FROM u, range(1, 65) a(i), range(1, 65) b(j) WHERE i <= j GROUP BY ALL")
for _k in ("pca", "whiten", "second_hadamard"):
    _add(f"transform_{_k}", lambda s, d, k=_k: K.orthogonality(K.transforms(K.second_moments(X.kv_states(s, d), ["side"]), ["side"], k), ["side"], D).withColumn("distance", F.round("distance", 4)))
_add("covariance", lambda s, d: K.covariance(X.kv_states(s, d), ["layer", "side"]).filter("i <= j").withColumn("value", F.round("value", 8)),
     f"WITH {X.KV_CTE}, u AS (SELECT layer, side, list_transform(vec, lambda x: x / sqrt({_sq('vec')})) AS u FROM kv) SELECT layer, side, CAST(i - 1 AS INT) AS i, CAST(j - 1 AS INT) AS j, round(covar_samp(u[i], u[j]), 8) AS value, count(*) AS n FROM u, range(1, 65) a(i), range(1, 65) b(j) WHERE i <= j GROUP BY ALL")
_add("static_query_scores", lambda s, d: K.static_scores(X.kv_states(s, d), "seq_id", queries=X.q_states(s, d, 2)).withColumn("score", F.round("score", 6)),
     f"""WITH {X.KV_CTE}, {X.q_cte(2)}, cells AS (SELECT layer, side, seq_id, i, vec[i] AS x FROM kv, range(1, 65) t(i) WHERE side = 'value' UNION ALL SELECT layer, 'key', seq_id, i, q[i] FROM queries, range(1, 65) t(i))
    SELECT layer, side, CAST(i - 1 AS INT) AS ch, round(avg(m), 6) AS score FROM (SELECT layer, side, seq_id, i, avg(x * x) AS m FROM cells GROUP BY ALL) GROUP BY ALL""")
_add("static_channel_scores", lambda s, d: K.static_scores(X.kv_states(s, d), "seq_id").withColumn("score", F.round("score", 6)),
     f"WITH {X.KV_CTE}, {_LONG} SELECT layer, side, CAST(i - 1 AS INT) AS ch, round(avg(m), 6) AS score FROM (SELECT layer, side, seq_id, i, avg(x * x) AS m FROM long GROUP BY ALL) GROUP BY ALL")
_METRIC = "metric AS (SELECT layer, head, avg(list_sum(list_transform(vec, lambda x: x * x))) AS metric FROM kv GROUP BY ALL)"
_add("layer_bit_schedule", lambda s, d: K.layer_bit_schedule(X.kv_states(s, d).groupBy("layer", "head").agg(F.avg(V.l2_norm("vec") ** 2).alias("metric")), 0.5, 2.5, 3.5).withColumn("metric", F.round("metric", 5)),
     f"WITH {X.KV_CTE}, {_METRIC}, m AS (SELECT layer, avg(metric) AS metric FROM metric GROUP BY 1) SELECT layer, round(metric, 5) AS metric, CASE WHEN row_number() OVER (ORDER BY metric DESC, layer) <= 2 THEN 3.5::DOUBLE ELSE 2.5 END AS bits FROM m")
_add("strided_sample", lambda s, d: K.strided_sample(X.kv_states(s, d), ["layer"], "vec_id", 30).select("layer", "vec_id"),
     f"WITH {X.KV_CTE}, r AS (SELECT layer, vec_id, row_number() OVER (PARTITION BY layer ORDER BY vec_id) - 1 AS n, greatest(count(*) OVER (PARTITION BY layer) // 30, 1) AS st FROM kv) SELECT layer, vec_id FROM r WHERE n % st = 0 AND n // st < 30")
def _beams(s, d):  # noqa: ANN001, ANN202
    """Every sequence is followed by the next one's half: some old ones come twice, some never."""
    seqs = X.table(s, d, "embeddings").select(F.expr("vec_id div 128").alias("new_seq")).distinct()
    return seqs.select("new_seq", F.expr("new_seq div 2").alias("old_seq"))


_BEAMS = "beams AS (SELECT DISTINCT vec_id // 128 AS new_seq, vec_id // 128 // 2 AS old_seq FROM embeddings)"
_add("phase_kind", lambda s, d: E.phase_kind(X.kv_states(s, d).filter("pos >= 7 or layer = 0"), ["seq_id", "layer", "side"], "mse", "raw").groupBy("layer", "kind").agg(F.count("*").alias("n")),
     f"WITH {X.KV_CTE}, k AS (SELECT * FROM kv WHERE pos >= 7 OR layer = 0) SELECT layer, CASE WHEN m > 1 THEN 'mse' ELSE 'raw' END AS kind, CAST(sum(c) AS BIGINT) AS n FROM (SELECT layer, count(DISTINCT pos) AS m, count(*) AS c FROM k GROUP BY seq_id, layer, side) GROUP BY 1, 2")
_add("crop", lambda s, d: E.crop(X.kv_states(s, d), 8, -3).groupBy("layer", "side").agg(F.count("*").alias("n"), F.max("pos").alias("last")), f"WITH {X.KV_CTE} SELECT layer, side, count(*) AS n, max(pos) AS last FROM kv WHERE pos < 5 GROUP BY 1, 2")
_add("reorder", lambda s, d: E.reorder(X.kv_states(s, d), _beams(s, d)).groupBy("seq_id", "layer").agg(F.count("*").alias("n"), F.sum("vec_id").alias("total")),
     f"WITH {X.KV_CTE}, {_BEAMS} SELECT new_seq AS seq_id, layer, count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS total FROM kv JOIN beams ON seq_id = old_seq GROUP BY 1, 2")


def _picked(s, d, made):  # noqa: ANN001, ANN202
    keys = _keys(s, d)
    m = V.codec("mse", D, 2)
    plain = V.decode(V.encode(keys, "vec", m), m)
    return A.pick_by_attention(X.q_states(s, d), {"mse": plain, "other": made(keys)}, ["seq_id", "layer"]).groupBy("layer", "kind").agg(F.round(F.avg(S.squared_error()), 6).alias("mse"), F.count("*").alias("n"))


for _n, _f in (("outlier_hadamard", lambda k: S.outlier_hadamard(k, 2, keys=SEG)), ("rotated_outlier", lambda k: S.rotated_outliers(k, 2.5, SEG)), ("hadamard_residual", lambda k: S.hadamard_residual(k, 2.5, SEG)), ("regular_gain", lambda k: S.encode_fractional(k, 2.5, kinds=("gain_mse", "mse"), keys=SEG)), ("rotation_bank", lambda k: S.rotation_bank(k, 2, 4, "segment", SEG))):
    _add(f"attention_pick_{_n}", lambda s, d, f=_f: _picked(s, d, f))
_add("regime_kinds", lambda s, d: X.kv_states(s, d).withColumn("layer", F.col("layer") * 8).select("layer", "side", G.regime_kind("rate_hadamard_value_mse", 3.5).alias("high"), G.regime_kind("hadamard_rate_regime_mse", 2.5).alias("low")).distinct(),
     f"WITH {X.KV_CTE} SELECT DISTINCT layer * 8 AS layer, side, CASE WHEN side = 'key' THEN 'mse' WHEN layer * 8 >= 16 THEN 'outlier_hadamard_mse' ELSE 'mse' END AS high, CASE WHEN side = 'value' THEN 'margin_vector_outlier_hadamard_mse' ELSE 'mse' END AS low FROM kv")
_add("choose_rotation", lambda s, d: S.rotation_bank(X.kv_states(s, d), 2, 4, "segment", ["layer", "side"]).groupBy("layer", "side", "rotation_id").agg(F.count("*").alias("n")))


def _protect_attention(s, d):  # noqa: ANN001, ANN202
    weights = A.token_errors(X.q_states(s, d), _coded(s, d, "key"), _coded(s, d, "value")).withColumnRenamed("error", "weight")
    return _spots(P.protect(X.kv_states(s, d), P.raw_by_ratio(F.col("length"), 2.0, 0.5), "attention_error", 1, importance=weights))


_add("protect_attention_error", _protect_attention)


def _transform_comparison(s, d):  # noqa: ANN001, ANN202
    """Error by label of random, Hadamard and scrambled transforms, and the reduction against the random one."""
    names = {"rotation": "mse", "hadamard": "hadamard_mse", "srht": "srht_mse"}
    rows = V.roundtrip(_plain(s, d), "vec", {n: V.codec(k, D, 2) for n, k in names.items()}).groupBy("label").agg(*[F.avg(f"sse_{n}").alias(n) for n in names])
    return rows.select("label", *[F.round(n, 6).alias(n) for n in names], F.round(1 - F.col("hadamard") / F.col("rotation"), 6).alias("reduction"))


_add("transform_comparison", _transform_comparison, f"""WITH {_PLAIN}, {_hat('a', 'base', 'vec', ROT, 2, tag='a')}, {_hat('b', 'a', 'vec', HAD, 2, tag='b')}, {_hat('c', 'b', 'vec', C.srht(D, 0), 2, tag='c')},
e AS (SELECT label, """ + ", ".join(f"avg({_apart('vec', f'list_transform(u{t}, lambda x: x * nrm{t})')}) AS {n}" for t, n in (("a", "rotation"), ("b", "hadamard"), ("c", "srht"))) + " FROM c GROUP BY 1) SELECT label, round(rotation, 6) AS rotation, round(hadamard, 6) AS hadamard, round(srht, 6) AS srht, round(1 - hadamard / rotation, 6) AS reduction FROM e")
