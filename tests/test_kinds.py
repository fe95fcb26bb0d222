"""Kinds by name against plain numpy versions on a few segments, and that every kind of the catalogue codes all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vqspark import fixtures as X
from vqspark.functions import constants as C
from vqspark.operators import attention, kinds, search, segments
from vqspark.operators.codec import codec

D = 64
SEG = ("seq_id", "layer", "side")
CATALOGUE = """mse unit_mse lsq_mse lsq_unit_mse gain_mse regular_gain_mse regular_half_gain_mse regular_selected_gain_mse regular_clipped_gain_mse adaptive_regular_gain_mse
attention_adaptive_regular_gain_mse clipped_gain_mse selected_gain_mse lowbit_gain_mse lowbit_half_gain_mse lowbit_clipped_gain_mse lowbit_selected_gain_mse dot_gain_mse hadamard_mse srht_mse
calibrated_rotation_mse head_rotation_mse head_hadamard_mse outlier_hadamard_mse attention_adaptive_outlier_hadamard_mse attention_outlier_hadamard_mse bitwidth_attention_outlier_hadamard_mse
entropy_guarded_outlier_hadamard_mse adaptive_outlier_hadamard_mse vector_adaptive_outlier_hadamard_mse margin_vector_outlier_hadamard_mse hadamard_residual_mse attention_hadamard_residual_mse
attention_weighted_hadamard_residual_mse regular_outlier_hadamard_mse outlier_only_hadamard_mse attention_scale_mse regular_attention_scale_mse rotation_bank_mse attention_rotation_bank_mse
segment_rotation_bank_mse rotated_outlier_mse attention_rotated_outlier_mse attention_adaptive_rotated_outlier_mse attention_adaptive_paired_rotated_outlier_mse entropy_guarded_paired_rotated_outlier_mse
calibrated_rotated_outlier_mse paired_rotated_outlier_mse shared_rotated_outlier_mse rms_rotation_mse rms_regular_gain_mse centered_mse auto_mse attention_auto_mse distortion_regime_mse gain_unit_regime_mse
rate_regime_mse hadamard_rate_regime_mse rate_hadamard_value_mse prod mse_block2 learned_mse_block2 learned_unit_mse_block2 uniform_token uniform_channel""".split()


@pytest.fixture(scope="module")
def few(spark, data):
    """Two layers of one sequence with their queries, small enough for loops."""
    kv = X.kv_states(spark, data).filter("seq_id = 0 and layer < 2").coalesce(1).cache()
    q = X.q_states(spark, data).filter("seq_id = 0 and layer < 2").coalesce(1).cache()
    return kv, q


@pytest.fixture(scope="module")
def plain(few):
    """Rows and queries as Python values."""
    kv, q = few
    rows = [(r.vec_id, (r.seq_id, r.layer, r.side), r.head, r.pos, np.array(r.vec)) for r in kv.collect()]
    return rows, [(r.layer, r.kv_head, r.q_head, np.array(r.q)) for r in q.collect()]


def setting(q=None, **more):
    return kinds.Setting(keys=SEG, q=q, value_layer=1, **more)


def coded(few, kind, bits, with_queries=False, **more):
    kv, q = few
    return {r.vec_id: np.array(r.vec_hat) for r in kinds.encode_kind(kv, kind, bits, setting(q if with_queries else None, **more)).collect()}


def code(x, kind, bits, **more):
    m = codec(kind, x.shape[1], bits, **more)
    return m.decode(*m.encode(x))


def by_segment(rows, work):
    """work(ids, rows as a matrix, segment) for each segment; its result by vec_id."""
    out = {}
    for seg in sorted({r[1] for r in rows}):
        own = [r for r in rows if r[1] == seg]
        out |= dict(zip([r[0] for r in own], work(own, np.stack([r[4] for r in own]), seg), strict=True))
    return out


def same(a, b):
    assert set(a) == set(b)
    for i in a:
        assert np.allclose(a[i], b[i], atol=1e-9), i


def top(scores, n):
    on = np.zeros(len(scores), dtype=bool)
    on[np.lexsort((np.arange(len(scores)), -scores))[:n]] = True
    return on


def halves(x, on, low, high):
    out = np.empty_like(x)
    out[:, ~on], out[:, on] = low(x[:, ~on]), high(x[:, on])
    return out


def probabilities(plain, layer, head):
    """p of every query (rows) and position (columns), scores and the queries, for the keys of a head."""
    rows, queries = plain
    keys = sorted((r[3], r[0], r[4]) for r in rows if r[1][1] == layer and r[1][2] == "key" and r[2] == head)
    q = np.stack([x for lay, h, _, x in queries if lay == layer and h == head])
    k = np.stack([k[2] for k in keys])
    s = q @ k.T * 0.125
    e = np.exp(s - s.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True), s, q, [k[0] for k in keys], [k[1] for k in keys]


def attention_error(plain, hats, seg):
    rows, _ = plain
    _, layer, side = seg
    parts = []
    for head in (0, 1):
        if not any(r[1] == seg and r[2] == head for r in rows):
            continue
        p, s, q, at, ids = probabilities(plain, layer, head)
        if side == "key":
            other = q @ np.stack([hats[i] for i in ids]).T * 0.125
            parts += list((p * (s - other) ** 2).reshape(-1))
        else:
            weight = dict(zip(at, (p**2).mean(0), strict=True))
            parts += [weight[r[3]] * ((r[4] - hats[r[0]]) ** 2).sum() for r in rows if r[1] == seg and r[2] == head]
    return np.mean(parts)


def chosen(plain, candidates, error):
    rows, _ = plain
    best = {seg: min(range(len(candidates)), key=lambda i: (error(candidates[i], seg), i)) for seg in {r[1] for r in rows}}
    return {r[0]: candidates[best[r[1]]][r[0]] for r in rows}


def squared(rows):
    return lambda hats, seg: np.mean([((r[4] - hats[r[0]]) ** 2).sum() for r in rows if r[1] == seg])


def flat(x, bits):
    order = np.lexsort((np.arange(x.shape[1]), -np.abs(x).sum(0)))
    n = max(1, -(-x.shape[1] // 16))
    dealt = np.concatenate([order[k::n] for k in range(n)])
    mix, m = C.block_hadamard(x.shape[1], 16, 0), codec("custom", x.shape[1], bits, transform=np.eye(x.shape[1]), inverse=np.eye(x.shape[1]))
    out = np.empty_like(x)
    out[:, dealt] = m.decode(*m.encode(x[:, dealt] @ mix.T)) @ mix
    return out


def test_regimes_and_raw(few, plain):
    rows, _ = plain
    x = np.stack([r[4] for r in rows])
    whole = lambda kind, bits: {r[0]: v for r, v in zip(rows, code(x, kind, bits), strict=True)}
    same(coded(few, "mse", 16), {r[0]: r[4] for r in rows})
    same(coded(few, "distortion_regime_mse", 2), whole("gain_mse", 2))
    same(coded(few, "gain_unit_regime_mse", 3), whole("unit_mse", 3))
    same(coded(few, "rate_regime_mse", 2), whole("gain_mse", 2))
    value = by_segment(rows, lambda own, v, seg: flat(v, 3) if seg[1] >= 1 and seg[2] == "value" else code(v, "mse", 3))
    same(coded(few, "rate_hadamard_value_mse", 3), value)
    margin = lambda v: (lambda a, b: np.where((((v - a) ** 2).sum(1) < 0.95 * ((v - b) ** 2).sum(1))[:, None], a, b))(flat(v, 2), code(v, "mse", 2))
    same(coded(few, "hadamard_rate_regime_mse", 2), by_segment(rows, lambda own, v, seg: margin(v) if seg[2] == "value" else code(v, "mse", 2)))


def test_fractional_sub_kinds(few, plain):
    rows, _ = plain
    split = lambda low, high: by_segment(rows, lambda own, v, seg: halves(v, top(np.abs(v).mean(0), 32), low, high))
    hot = lambda v: code(v, "mse", 3)
    mse, gain = split(lambda v: code(v, "mse", 2), hot), split(lambda v: code(v, "gain_mse", 2), hot)
    same(coded(few, "regular_gain_mse", 2.5), gain)
    for kind in ("half_gain_mse", "selected_gain_mse", "clipped_gain_mse"):
        same(coded(few, f"regular_{kind}", 2.5), split(lambda v, k=kind: code(v, k, 2), hot))
    same(coded(few, "adaptive_regular_gain_mse", 2.5), chosen(plain, [mse, gain], squared(rows)))
    same(coded(few, "attention_adaptive_regular_gain_mse", 2.5, True), chosen(plain, [mse, gain], lambda h, seg: attention_error(plain, h, seg)))
    same(coded(few, "regular_outlier_hadamard_mse", 2.5), split(lambda v: flat(v, 2), hot))
    same(coded(few, "outlier_only_hadamard_mse", 2.5), split(lambda v: code(v, "mse", 2), lambda v: flat(v, 3)))

    def rms(v, kind, bits):
        r = np.sqrt((v * v).mean(0))
        r = r / np.exp(np.log(r).mean())
        return code(v / r, kind, bits) * r

    same(coded(few, "rms_regular_gain_mse", 2.5), split(lambda v: rms(v, "gain_mse", 2), lambda v: rms(v, "mse", 3)))


def test_choices_by_attention(few, plain):
    rows, _ = plain
    error = lambda hats, seg: attention_error(plain, hats, seg)
    mse, hadamard = by_segment(rows, lambda own, v, seg: code(v, "mse", 2)), by_segment(rows, lambda own, v, seg: flat(v, 2))
    same(coded(few, "attention_outlier_hadamard_mse", 2, True), chosen(plain, [mse, hadamard], error))
    same(coded(few, "bitwidth_attention_outlier_hadamard_mse", 2, True), hadamard)
    three = [by_segment(rows, lambda own, v, seg: f(v)) for f in (lambda v: code(v, "mse", 3), lambda v: flat(v, 3))]
    same(coded(few, "bitwidth_attention_outlier_hadamard_mse", 3, True), chosen(plain, three, error))
    bank = [by_segment(rows, lambda own, v, seg, k=k: code(v, "mse", 2, seed=k)) for k in range(4)]
    same(coded(few, "attention_rotation_bank_mse", 2, True), chosen(plain, bank, error))

    def ratio(layer):
        h = [-(p * np.log(p)).sum(1) / np.log(p.shape[1]) for p in (probabilities(plain, layer, head)[0] for head in (0, 1))]
        return np.concatenate(h).mean()

    limit = sorted(ratio(layer) for layer in (0, 1))[0]
    guarded = by_segment(rows, lambda own, v, seg: flat(v, 2) if seg[2] == "value" and ratio(seg[1]) <= limit + 1e-12 else code(v, "mse", 2))
    same(coded(few, "entropy_guarded_outlier_hadamard_mse", 2, True, entropy_limit=limit + 1e-12), guarded)


def scaled(plain, hats, units, layer, side, queries=None):
    """Keys of a layer with the factors that fit their scores."""
    out = {}
    for head in (0, 1):
        p, s, q, _, ids = probabilities(plain, layer, head)
        if queries is not None:
            q = q[:, queries]
            s = q @ np.stack([hats[i] for i in ids]).T * 0.125
        u = q @ np.stack([units[i] for i in ids]).T * 0.125
        f = np.maximum((s * u).sum(0) / (u * u).sum(0), 0)
        out |= {i: units[i] * f[n] for n, i in enumerate(ids)}
    return out


def test_attention_scales_and_weights(few, plain):
    rows, queries = plain
    rot, low, high = C.rotation(D, 0), 2, 3
    snap = lambda y, b: (lambda c: c[np.searchsorted((c[1:] + c[:-1]) / 2, y)])(np.array(C.codebook(D, b)[0]))

    def regular(own, v, seg):
        on = top(np.abs(v).mean(0), 32)
        m = codec("mse", 32, 2)
        lo = v[:, ~on]
        hats = m.decode(*m.encode(lo))
        if seg[2] == "key":
            ids = [r[0] for r in own]
            exact, units = dict(zip(ids, lo, strict=True)), dict(zip(ids, m.unit(m.encode(lo)[0]), strict=True))
            made = scaled(plain, exact, units, seg[1], "key", ~on)
            hats = np.stack([made[i] for i in ids])
        return halves(v, on, lambda _: hats, lambda x: code(x, "mse", 3))

    same(coded(few, "regular_attention_scale_mse", 2.5, True), by_segment(rows, regular))

    def weights(own, seg):
        w, energy = [], []
        for r in own:
            p, _, q, at, _ = probabilities(plain, seg[1], r[2])
            n = at.index(r[3])
            w.append(p[:, n].mean() if seg[2] == "key" else (p[:, n] ** 2).mean())
            energy.append(((q @ rot.T) ** 2).mean(0) if seg[2] == "key" else np.ones(D))
        return np.array(w)[:, None], np.stack(energy)

    def rotated(own, v, seg, paired=False):
        rot = C.rotation(D, 0 if paired or seg[2] == "key" else kinds.VALUE_SEED)
        y = v / np.linalg.norm(v, axis=1, keepdims=True) @ rot.T
        w, energy = weights(own, seg)
        gain = np.maximum((y - snap(y, low)) ** 2 - (y - snap(y, high)) ** 2, 0) * (v * v).sum(1, keepdims=True) * w * energy
        hat = np.where(top(gain.mean(0), 32), snap(y, high), snap(y, low)) @ rot
        return hat * ((v * hat).sum(1) / (hat * hat).sum(1))[:, None]

    same(coded(few, "attention_rotated_outlier_mse", 2.5, True), by_segment(rows, rotated))
    paired = by_segment(rows, lambda own, v, seg: rotated(own, v, seg, True))
    plain_mse = by_segment(rows, lambda own, v, seg: halves(v, top(np.abs(v).mean(0), 32), lambda x: code(x, "mse", 2), lambda x: code(x, "mse", 3)))
    error = lambda hats, seg: attention_error(plain, hats, seg)
    same(coded(few, "attention_adaptive_paired_rotated_outlier_mse", 2.5, True), chosen(plain, [plain_mse, paired], error))
    same(coded(few, "attention_adaptive_rotated_outlier_mse", 2.5, True), chosen(plain, [plain_mse, by_segment(rows, rotated)], error))

    def residual(own, v, seg):
        h, base = C.signed_hadamard(D, 3), code(v, "mse", 2)
        size = np.linalg.norm(v - base, axis=1, keepdims=True)
        c = (v - base) / size @ h.T
        weight = np.ones_like(c)
        if seg[2] == "key":
            for n, r in enumerate(own):
                p, _, q, at, _ = probabilities(plain, seg[1], r[2])
                weight[n] = p[:, at.index(r[3])] @ np.abs(q @ h.T)
        on = top((np.abs(c) * weight).sum(0), 32)
        level = (np.abs(c) * on).sum(1, keepdims=True) / on.sum()
        return base + (np.where(c >= 0, 1.0, -1.0) * on * level) @ h * size

    same(coded(few, "attention_weighted_hadamard_residual_mse", 2.5, True), by_segment(rows, residual))


def test_learned_candidates(few, plain):
    """The automatic kinds choose no worse than any single candidate, by squared error and by attention."""
    rows, _ = plain
    for kind, names, error, queries in (
        ("auto_mse", ("mse", "unit_mse", "selected_gain_mse"), squared(rows), False),
        ("attention_auto_mse", ("mse", "gain_mse", "unit_mse"), lambda h, seg: attention_error(plain, h, seg), True),
    ):
        made = coded(few, kind, 2, queries)
        for seg in {r[1] for r in rows}:
            for name in names:
                other = {r[0]: v for r, v in zip(rows, code(np.stack([r[4] for r in rows]), name, 2), strict=True)}
                assert error(made, seg) <= error(other, seg) + 1e-9


@pytest.mark.parametrize("kind", [k for k in CATALOGUE if "learned" not in k and k not in ("auto_mse", "attention_auto_mse", "distortion_regime_mse", "rate_regime_mse", "hadamard_mse", "srht_mse", "mse_block2")])
def test_every_kind_codes_all_rows(few, plain, kind):
    rows, _ = plain
    made = coded(few, kind, 2.5 if kind not in ("prod", "uniform_token", "uniform_channel") else 3, "attention" in kind or "entropy" in kind)
    error = sum(((r[4] - made[r[0]]) ** 2).sum() for r in rows) / sum((r[4] ** 2).sum() for r in rows)
    assert set(made) == {r[0] for r in rows} and error < 0.35


def test_fractional_widths_of_whole_space_kinds(few, plain):
    """Sub-spaces are coded by the kind itself; banks choose one rotation for both; heads have masks of their own."""
    rows, _ = plain
    split = lambda low, high: by_segment(rows, lambda own, v, seg: halves(v, top(np.abs(v).mean(0), 32), low, high))
    hats = lambda v, bits: np.stack([code(v, "mse", bits, seed=k) for k in range(4)])
    best = lambda v, bits: (lambda h: h[((h - v) ** 2).sum(-1).argmin(0), np.arange(len(v))])(hats(v, bits))
    same(coded(few, "rotation_bank_mse", 2.5), split(lambda v: best(v, 2), lambda v: best(v, 3)))
    bank = [split(lambda v, k=k: code(v, "mse", 2, seed=k), lambda v, k=k: code(v, "mse", 3, seed=k)) for k in range(4)]
    same(coded(few, "segment_rotation_bank_mse", 2.5), chosen(plain, bank, squared(rows)))
    same(coded(few, "attention_rotation_bank_mse", 2.5, True), chosen(plain, bank, lambda h, seg: attention_error(plain, h, seg)))

    def by_head(own, v, seg, work):
        out, heads = np.empty_like(v), np.array([r[2] for r in own])
        for h in np.unique(heads):
            out[heads == h] = work(v[heads == h], int(h))
        return out

    heads = lambda x, h: halves(x, top(np.abs(x).mean(0), 32), lambda y: code(y, "mse", 2, seed=100 + h), lambda y: code(y, "mse", 3, seed=100 + h))
    same(coded(few, "head_rotation_mse", 2.5), by_segment(rows, lambda own, v, seg: by_head(own, v, seg, heads)))
    same(coded(few, "head_rotation_mse", 2), by_segment(rows, lambda own, v, seg: by_head(own, v, seg, lambda x, h: code(x, "mse", 2, seed=100 + h))))
    center = lambda own, seg: (lambda x, h: x.mean(0) + halves(x - x.mean(0), masks[seg], lambda y: code(y, "mse", 2), lambda y: code(y, "mse", 3)))
    masks = {seg: top(np.abs(np.stack([r[4] for r in rows if r[1] == seg])).mean(0), 32) for seg in {r[1] for r in rows}}
    same(coded(few, "centered_mse", 2.5), by_segment(rows, lambda own, v, seg: by_head(own, v, seg, center(own, seg))))
    mixed = coded(few, "head_hadamard_mse", 2.5)
    places = {(r[1], r[3], r[2]): r for r in rows}
    h, made = C.signed_hadamard(2, 0), {}
    for seg in masks:
        both = sorted({r[3] for r in rows if r[1] == seg and all((seg, r[3], k) in places for k in (0, 1))})
        y = np.stack([h @ np.stack([places[seg, pos, k][4] for k in (0, 1)]) for pos in both]).reshape(-1, D)
        assert 2 * len(both) == sum(r[1] == seg for r in rows)
        back = halves(y, top(np.abs(y).mean(0), 32), lambda v: code(v, "mse", 2), lambda v: code(v, "mse", 3)).reshape(-1, 2, D)
        for pos, pair in zip(both, back, strict=True):
            made |= {places[seg, pos, k][0]: v for k, v in enumerate(h.T @ pair)}
    same(mixed, made)


@pytest.mark.parametrize("kind", ["rotation_bank_mse", "segment_rotation_bank_mse", "head_rotation_mse", "head_hadamard_mse", "centered_mse", "rms_rotation_mse", "prod", "uniform_token", "uniform_channel", "scheduled_rotation_mse", "attention_rotation_bank_mse", "attention_scale_mse", "rotated_outlier_mse"])
def test_a_fractional_width_lies_between_whole_ones(few, plain, kind):
    rows, _ = plain
    low = 3 if kind == "uniform_token" else 2
    error = lambda bits: sum(((r[4] - made[r[0]]) ** 2).sum() for made in [coded(few, kind, bits, kind.startswith("attention"), rotations={(0, "key"): 3})] for r in rows)
    two, half, three = error(low), error(low + 0.5), error(low + 1)
    # A scale for each sub-space, or codes without the queries' scale, can beat the next whole width.
    assert half < two and (three < half or kind in ("uniform_token", "attention_scale_mse"))


def test_softmax_has_no_window_and_holds_for_long_ranges_of_scores(spark):
    scores = [(0, 0, q, 0, 0, pos, s) for q, row in enumerate([[-500.0, 400.0, 401.5], [0.0, 0.0, 0.0], [31.99, 32.0, 64.01], [-1e3, -1.0e3, -2e3]]) for pos, s in enumerate(row)]
    df = spark.createDataFrame(scores, "seq_id long, layer long, q_head long, q_pos long, kv_head long, pos long, score double")
    probs = attention.causal_probs(df)
    assert "Window" not in probs._jdf.queryExecution().optimizedPlan().toString()
    for q in range(4):
        row = np.array([s[6] for s in scores if s[2] == q])
        e = np.exp(row - row.max())
        got = [r.p for r in probs.filter(f"q_head = {q}").orderBy("pos").collect()]
        assert np.allclose(got, e / e.sum(), atol=1e-12)


def test_protection_schedules_and_errors(few, plain):
    kv, _ = few
    rows, _ = plain
    flagged = kv.withColumn("is_raw", F.col("pos") < 2)
    made = {r.vec_id: (r.is_raw, np.array(r.vec_hat)) for r in kinds.encode_protected(flagged, "mse", 2, setting(), "key").collect()}
    hats = code(np.stack([r[4] for r in rows]), "mse", 2)
    for r, hat in zip(rows, hats, strict=True):
        assert np.allclose(made[r[0]][1], r[4] if r[3] < 2 and r[1][2] == "key" else hat)
    schedule = [(0, "key", 2, "mse"), (1, "value", 3, "gain_mse"), (0, "value", 2.5, "mse"), (1, "key", 2, "mse"), (9, "key", 2, "mse")]
    assert kinds.encode_scheduled(kv, schedule, setting()).count() == kv.count()
    for wrong in (schedule[1:], [*schedule, schedule[0]]):
        with pytest.raises(ValueError):
            kinds.encode_scheduled(kv, wrong, setting())
    with pytest.raises(ValueError):
        kinds.encode_kind(kv, "no_such_kind", 2, setting())
    assert kinds.encode_kind(kv.limit(0), "adaptive_outlier_hadamard_mse", 2, setting()).count() == 0


def test_joint_channels_follow_attention(few):
    kv, q = few
    masks = kinds.channel_masks(kv, 2.5, setting(q, policy="joint_attention_error_gain")).collect()
    for layer in (0, 1):
        n = [sum(r.mask) for r in masks if r.layer == layer]
        assert sum(n) == 64 and all(1 <= x <= 63 for x in n)
    alone = kinds.channel_masks(kv.filter("side = 'key'"), 2.5, setting(policy="joint_error_gain")).collect()
    assert all(sum(r.mask) == 32 for r in alone)


def test_blocked_search_equals_the_broadcast_one(spark, data, monkeypatch):
    rows = X.table(spark, data, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    queries = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "vec")
    one = sorted(map(tuple, search.topk(rows, queries, 5).collect()))
    monkeypatch.setattr(search, "BLOCK_VALUES", 500)
    monkeypatch.setattr(search, "CHUNK_ROWS", 100)
    other = sorted(map(tuple, search.topk(rows, queries, 5).collect()))
    assert [r[:3] for r in one] == [r[:3] for r in other] and np.allclose([r[3] for r in one], [r[3] for r in other])


def test_group_rows():
    import pyarrow as pa

    batch = pa.record_batch([pa.array([1, None, 1, None, 2]), pa.array(["a", "b", "a", "b", None])], names=["x", "y"])
    first, at = segments.group_rows(batch, ["x", "y"])
    assert len(first) == 3 and at[0] == at[2] and at[1] == at[3] and len({at[0], at[1], at[4]}) == 3
