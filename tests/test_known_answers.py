"""Operators against independent numpy answers on small planted frames."""

import itertools
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from duoframe.functions import fits
from duoframe.fixtures import Tables, v_rgb
from duoframe.functions import matrices as X
from duoframe.operators import filters, masks, percentiles, pixels, register, scale, warp
from duoframe.operators.components import components
from duoframe.operators.diagnostics import top_rows
from duoframe.operators.matching import two_nearest
from duoframe.operators.points import iterate_closest_points, nearest_neighbours
from duoframe.queries import registration

RNG = np.random.default_rng(7)


def frame_df(spark, frames):
    rows = [(k, int(r), int(c), float(a[r, c])) for k, a in frames.items() for r, c in zip(*np.nonzero(a))]
    return spark.createDataFrame(rows, "f string, r int, c int, v double")


def to_array(df, shape, value="v"):
    a = np.zeros(shape)
    p = df.toPandas()
    a[p["r"], p["c"]] = 1.0 if value is None else p[value]
    return a


def flood(mask, conn):
    lab, n = np.zeros(mask.shape, int), 0
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (conn == 8 or abs(i) + abs(j) == 1)]
    for r, c in zip(*np.nonzero(mask)):
        if lab[r, c]:
            continue
        n += 1
        todo = [(r, c)]
        lab[r, c] = n
        while todo:
            y, x = todo.pop()
            for i, j in steps:
                v, u = y + i, x + j
                if 0 <= v < mask.shape[0] and 0 <= u < mask.shape[1] and mask[v, u] and not lab[v, u]:
                    lab[v, u] = n
                    todo.append((v, u))
    return lab


@pytest.mark.parametrize("conn,density,block", [(8, 0.35, 7), (4, 0.6, 5), (8, 0.5, 256)])
def test_components_match_flood_fill(spark, conn, density, block):
    mask = RNG.random((40, 33)) < density
    runs = masks.pixels_to_runs(frame_df(spark, {"a": mask.astype(float)}), ["f"])
    want = flood(mask, conn)
    got = to_array(masks.runs_to_pixels(components(runs, ["f"], conn, block)), mask.shape, "label")
    pairs = {(a, b) for a, b in zip(got[mask], want[mask])}
    assert len(pairs) == len({a for a, _ in pairs}) == want.max()


def test_long_snake_is_one_component(spark):
    mask = np.zeros((61, 21), bool)
    mask[::2] = True
    mask[1::4, -1] = True
    mask[3::4, 0] = True
    runs = masks.pixels_to_runs(frame_df(spark, {"a": mask.astype(float)}), ["f"])
    assert components(runs, ["f"], 4, 3).select("label").distinct().count() == 1


def test_morphology(spark):
    mask = RNG.random((30, 26)) < 0.04
    runs = masks.pixels_to_runs(frame_df(spark, {"a": mask.astype(float)}), ["f"])
    yy, xx = np.nonzero(mask)
    r, c = np.mgrid[0:30, 0:26]
    near = np.zeros_like(mask)
    for y, x in zip(yy, xx):
        near |= abs(r - y) + abs(c - x) <= 7
    grown = masks.clip_runs(masks.dilate_cross(runs, ["f"], 7), ["f"], (30, 26))
    assert np.array_equal(to_array(masks.runs_to_pixels(grown), mask.shape, None) > 0, near)
    k = 2
    want = np.array([[near[max(y - k, 0):y + k + 1, max(x - k, 0):x + k + 1].sum() == (2 * k + 1) ** 2 for x in range(26)] for y in range(30)])
    got = masks.erode_square(grown, ["f"], k)
    assert np.array_equal(to_array(masks.runs_to_pixels(got), mask.shape, None) > 0, want)


def test_dilation_steps_add_up(spark):
    mask = RNG.random((20, 20)) < 0.05
    runs = masks.pixels_to_runs(frame_df(spark, {"a": mask.astype(float)}), ["f"])
    one = runs
    for _ in range(4):
        one = masks.dilate(one, ["f"], masks.diamond(1))
    assert set(map(tuple, one.collect())) == set(map(tuple, masks.dilate_cross(runs, ["f"], 4).select(*one.columns).collect()))


def test_gaussian_tiles_do_not_show(spark):
    a = RNG.random((50, 41)).round(3)
    df = frame_df(spark, {"a": a})
    w = filters.gaussian_weights(2.0)
    k = len(w) // 2
    p = np.pad(a, k, mode="symmetric")
    rows = sum(w[i] * p[i:i + 50] for i in range(2 * k + 1))
    want = sum(w[j] * rows[:, j:j + 41] for j in range(2 * k + 1))
    for tile in (16, 64):
        got = to_array(filters.gaussian_blur(df, ["f"], (50, 41), 2.0, tile=tile), a.shape)
        assert np.allclose(got, want)


def test_warp_identity_and_round_trip(spark):
    a = np.zeros((40, 40))
    a[12:28, 12:28] = RNG.random((16, 16))
    df = frame_df(spark, {"a": a})
    keys = spark.createDataFrame([("a",)], "f string")
    same = warp.warp_bilinear(df, ["f"], (40, 40), keys.withColumn("m", X.identity()))
    assert np.allclose(to_array(same, a.shape), a)
    m = X.translation(3, -2)
    there = warp.warp_bilinear(df, ["f"], (40, 40), keys.withColumn("m", m))
    back = warp.warp_bilinear(there, ["f"], (40, 40), keys.withColumn("m", X.invert(m)))
    assert np.allclose(to_array(back, a.shape), a)


@pytest.mark.parametrize("m", [
    [1, 0, 0, 0, 1, 0, 0, 0, 1], [0.2, 0.05, 3, -0.04, 0.3, 8, 0, 0, 1], [9.0, 0.4, 1, -0.3, 7.0, 2, 0, 0, 1],
    [1.0, 0.1, 2, 0.05, 0.9, 4, 0.02, 0.03, -1.0],  # the horizon crosses the frame
    [0.6, -0.8, 20, 0.8, 0.6, -9, 0.004, -0.006, 1.0],
])
def test_warp_by_tiles_equals_brute_force(spark, m):
    h, w = 50, 37
    a = np.where(RNG.random((h, w)) < 0.7, RNG.integers(1, 200, (h, w)), 0).astype(float)
    px = spark.createDataFrame([("a", int(r), int(c), float(a[r, c]), f"{r}/{c}") for r, c in zip(*np.nonzero(a))], "f string, r int, c int, v double, t string")
    maps = spark.createDataFrame([("a", [float(x) for x in m]), ("none", None)], "f string, m array<double>")
    r, c = np.mgrid[:h, :w].astype(float)
    d = m[6] * c + m[7] * r + m[8]
    with np.errstate(all="ignore"):
        x, y = (m[0] * c + m[1] * r + m[2]) / d, (m[3] * c + m[4] * r + m[5]) / d
    want, near = np.zeros((h, w)), {}
    for i, j in np.ndindex(h, w):
        if not (abs(x[i, j]) < 1e6 and abs(y[i, j]) < 1e6):
            continue
        for p in range(int(np.floor(y[i, j])), int(np.floor(y[i, j])) + 2):
            for q in range(int(np.floor(x[i, j])), int(np.floor(x[i, j])) + 2):
                if 0 <= p < h and 0 <= q < w:
                    want[i, j] += a[p, q] * max(0, 1 - abs(x[i, j] - q)) * max(0, 1 - abs(y[i, j] - p))
        p, q = int(np.floor(y[i, j] + 0.5)), int(np.floor(x[i, j] + 0.5))
        if 0 <= p < h and 0 <= q < w and a[p, q]:
            near[i, j] = f"{p}/{q}"
    for tile in (16, 256):
        assert np.allclose(to_array(warp.warp_bilinear(px, ["f"], (h, w), maps, tile).drop("t"), (h, w)), want)
        assert {(g["r"], g["c"]): g["t"] for g in warp.warp_nearest(px, ["f"], (h, w), maps, tile).collect()} == near


@pytest.mark.parametrize("bins", [4096, 5])
def test_narrowed_percentiles_are_exact(spark, monkeypatch, bins):
    """Heavy tails, both signs, ties, one value, extremes; with few parts a round, many rounds are needed."""
    monkeypatch.setattr(percentiles, "BINS", bins)
    rng = np.random.default_rng(5)
    groups = {
        "normal": rng.normal(0, 3, 6000), "tail": np.exp(rng.normal(0, 20, 6000)) * rng.choice([-1, 1], 6000), "ties": rng.integers(-3, 4, 500).astype(float),
        "one": np.full(7, 2.5), "single": np.array([-1e-300]), "far": np.array([-1.7e308, 5e-324, -5e-324, 0.0, -0.0, 1.7e308, 1.0, 1.0 + 2**-52]), "near": 1 + np.arange(20) * 2.0**-52,
    }
    df = spark.createDataFrame(pd.concat([pd.DataFrame({"k": k, "v": v}) for k, v in groups.items()])).repartition(5)
    df = df.unionByName(df.limit(1).selectExpr("'normal' as k", "cast(null as double) as v"))
    ps = {"lo": 0.0, "a": 0.013, "m": 0.5, "b": 0.987, "hi": 1.0}
    got = percentiles.percentiles(df, ["k"], "v", ps).toPandas().set_index("k")
    for k, v in groups.items():
        s, n = np.sort(v), len(v) - 1
        want = [s[int(p * n)] + (s[int(np.ceil(p * n))] - s[int(p * n)]) * (p * n - int(p * n)) for p in ps.values()]
        assert np.allclose(got.loc[k, list(ps)].astype(float), want, rtol=1e-12, atol=0), k
    assert len(got) == len(groups)
    whole = percentiles.percentiles(df.filter("k = 'tail'"), [], "v", {"m": 0.5}).first()["m"]
    assert np.isclose(whole, np.median(groups["tail"]), rtol=1e-12, atol=0)


def test_top_rows_with_ties(spark):
    rows = [("a", int(r), int(c), float(v)) for (r, c), v in zip(itertools.product(range(20), range(20)), RNG.integers(0, 4, 400))]
    df = spark.createDataFrame(rows, "f string, r int, c int, post double")
    want = sorted(rows, key=lambda x: (-x[3], x[1], x[2]))[:37]
    assert sorted(map(tuple, top_rows(df, ["f"], 37).collect())) == sorted(want)
    assert top_rows(df, ["f"], 1000).count() == 400


@pytest.mark.parametrize("beta", [1.0, 3.0, 20.0])
def test_moffat_fit_recovers_the_curve(beta):
    x = np.linspace(-1, 2, 120)
    p = fits.fit_moffat(x, fits.moffat(x, 50.0, 0.4, 0.5, beta), 0.35, -1, 2)
    assert abs(p[1] - 0.4) < 1e-4
    assert fits.fit_moffat(x[:5], np.ones(5), 0.4, -1, 2) is None


def test_planted_scale(spark):
    n = 20_000
    pre = RNG.uniform(20, 200, n)
    post = 1.4 * pre * RNG.lognormal(0, 0.05, n)
    post[:300] += 500
    df = spark.createDataFrame(pd.DataFrame({"s": "a", "post": post, "pre": pre}))
    got = scale.moffat_scale(df, ["s"]).first()["scale"]
    assert abs(got / 1.4 - 1) < 0.05


def test_nearest_neighbours_with_a_hot_spot(spark):
    q = RNG.uniform(0, 100, (300, 2))
    t = np.r_[RNG.uniform(0, 100, (60, 2)), 50 + RNG.normal(0, 0.01, (900, 2)), np.full((40, 2), 3.0)]
    qd = spark.createDataFrame([("a", i, *map(float, p)) for i, p in enumerate(q)], "k string, q_id bigint, x double, y double")
    td = spark.createDataFrame([("a", i, *map(float, p)) for i, p in enumerate(t)], "k string, t_id bigint, x double, y double")
    got = nearest_neighbours(qd, td, ["k"], max_per_cell=32).toPandas().set_index("q_id")
    d = np.hypot(*(q[:, None] - t[None]).transpose(2, 0, 1))
    assert len(got) == 300
    assert np.allclose(got.loc[range(300), "dist"], d.min(1))


def test_two_nearest_over_blocks(spark):
    q, t = RNG.normal(size=(70, 8)), np.r_[RNG.normal(size=(60, 8)), 0.01 * RNG.normal(size=(80, 8))]
    qd = spark.createDataFrame([("a", i, p.tolist()) for i, p in enumerate(q)], "k string, q_id bigint, vec array<double>")
    td = spark.createDataFrame([("a", i, p.tolist()) for i, p in enumerate(t)], "k string, t_id bigint, vec array<double>")
    got = two_nearest(qd, td, ["k"], block=9).toPandas().set_index("q_id").loc[range(70)]
    d = np.sort(np.linalg.norm(q[:, None] - t[None], axis=2), axis=1)
    assert np.allclose(got["d1"], d[:, 0]) and np.allclose(got["d2"], d[:, 1])


def test_robust_homography_ignores_outliers(spark):
    h = np.array([[1.02, -0.05, 7], [0.04, 0.98, -3], [1e-5, -2e-5, 1]])
    p = RNG.uniform(0, 500, (400, 2))
    d = np.c_[p, np.ones(400)] @ h.T
    u = d[:, :2] / d[:, 2:] + RNG.normal(0, 0.2, (400, 2))
    u[:120] = RNG.uniform(0, 500, (120, 2))
    df = spark.createDataFrame([("a", *map(float, (*x, *y))) for x, y in zip(p, u)], "k string, x double, y double, u double, w double")
    row = register.robust_homography(df, ["k"]).first()
    assert 270 <= row["n_inliers"] <= 300
    assert np.allclose(np.array(row["m"]).reshape(3, 3), h, atol=0.2)


def test_closest_points_recover_an_affine_map(spark):
    t = np.linspace(0, 2 * np.pi, 240, endpoint=False)
    ring = np.c_[150 + (60 + 12 * np.cos(3 * t)) * np.cos(t), 140 + (45 + 9 * np.sin(2 * t)) * np.sin(t)]
    m = np.array([[1.01, -0.02], [0.015, 0.99]])
    moved = ring @ m.T + [2.0, -1.5]
    pre = spark.createDataFrame([("a", i, *map(float, p)) for i, p in enumerate(ring)], "k string, q_id bigint, x double, y double")
    post = spark.createDataFrame([("a", i, *map(float, p)) for i, p in enumerate(moved)], "k string, t_id bigint, x double, y double")
    row = iterate_closest_points(pre, post, ["k"], max_iter=8).first()
    got = np.array(row["m"]).reshape(3, 3)
    got = got @ np.array(row["before"]).reshape(3, 3)
    assert np.abs(np.c_[ring, np.ones(240)] @ got[:2].T - moved).mean() < 0.6


def test_coarse_search_finds_turn_and_scale(spark):
    """The returned inverse map must undo exactly the turn and scale that was planted."""
    shape = (96, 96)
    r, c = np.mgrid[0:96, 0:96]
    ring = lambda y, x: ((np.hypot((y - 50) / 1.3, x - 44) < 26) & (np.hypot((y - 50) / 1.3, x - 44) > 20)) * 1.0 + (np.hypot(y - 30, x - 40) < 5)
    post = ring(r, c)
    # pre = post seen through a known map: pre(x) = post(A x)
    ang, s = np.radians(-6.0), 1 / 1.1
    x, y = c - 48.0, r - 48.0
    xs, ys = s * (np.cos(ang) * x - np.sin(ang) * y) + 48 - 3, s * (np.sin(ang) * x + np.cos(ang) * y) + 48 + 2
    pre = ring(ys, xs)
    df = frame_df(spark, {"post": post, "pre": pre}).select(F.lit("a").alias("k"), F.col("f").alias("kind"), "r", "c", "v")
    cand = register.search_candidates(angle_range=8, angle_step=2, scale_min=0.9, scale_max=1.1, scale_step=0.1)
    # scales around 1/1.1 are searched as 0.9
    best = register.best_candidate(register.coarse_search(df, ["k"], shape, cand), ["k"])
    t = best.select("k", X.similarity_inverse_map(*[F.col(n) for n in ("angle", "scale", "cx", "cy", "dx", "dy")], 1.0).alias("m"))
    back = to_array(warp.warp_bilinear(df.filter("kind = 'pre'").drop("kind"), ["k"], shape, t), shape)
    before = np.corrcoef(pre.ravel(), post.ravel())[0, 1]
    after = np.corrcoef(back.ravel(), post.ravel())[0, 1]
    assert after > 0.8 > before


def test_homography_does_not_depend_on_repeats(spark):
    """Rows repeated 1, 100 and 10,000 times give the same map, also in one table."""
    h = np.array([[1.02, -0.05, 7], [0.04, 0.98, -3], [1e-5, -2e-5, 1]])
    rng = np.random.default_rng(3)
    p = rng.uniform(0, 500, (60, 2))
    d = np.c_[p, np.ones(60)] @ h.T
    u = d[:, :2] / d[:, 2:]
    u[:12] = rng.uniform(0, 500, (12, 2))
    df = spark.createDataFrame([(*map(float, (*x, *y)),) for x, y in zip(p, u)], "x double, y double, u double, w double")
    many = df.crossJoin(spark.createDataFrame([(1,), (100,), (10_000,)], "k int")).withColumn("i", F.explode(F.sequence(F.lit(1), "k"))).drop("i")
    rows = {r["k"]: r for r in register.robust_homography(many, ["k"], n_hypotheses=300).collect()}
    for k, r in rows.items():
        assert (r["n_matches"], r["n_inliers"]) == (60 * k, 48 * k)
        assert np.allclose(np.array(r["m"]).reshape(3, 3), h, atol=1e-4)
        assert np.allclose(r["m"], rows[1]["m"], atol=1e-9)


def test_neighbours_without_an_answer(spark):
    q = spark.createDataFrame([("a", 1, 0.0, 0.0), ("a", 2, None, 1.0), ("b", 3, 1.0, 1.0)], "k string, q_id bigint, x double, y double")
    t = spark.createDataFrame([("a", 7, 3.0, 4.0), ("a", 8, None, None)], "k string, t_id bigint, x double, y double")
    got = {r["q_id"]: (r["t_id"], r["dist"]) for r in nearest_neighbours(q, t, ["k"]).collect()}
    assert got == {1: (7, 5.0), 2: (None, None), 3: (None, None)}


def test_a_rejected_step_is_skipped_and_scale_frozen(spark):
    """A far pair is moved by the first step alone; later rounds turn and move without scale."""
    t = np.linspace(0, 2 * np.pi, 300, endpoint=False)
    ring = np.c_[300 + (110 + 25 * np.cos(3 * t)) * np.cos(t), 280 + (90 + 20 * np.sin(2 * t)) * np.sin(t)]
    moved = ring + [40.0, -25.0]
    pre = spark.createDataFrame([("a", i, *map(float, p)) for i, p in enumerate(ring)], "k string, q_id bigint, x double, y double")
    post = spark.createDataFrame([("a", i, *map(float, p)) for i, p in enumerate(moved)], "k string, t_id bigint, x double, y double")
    row = iterate_closest_points(pre, post, ["k"]).first()
    m, before = (np.array(row[c]).reshape(3, 3) for c in ("m", "before"))
    assert not np.allclose(before, np.eye(3))
    assert np.allclose(np.hypot(m[0, :2], m[1, :2]), 1, atol=0.1)
    assert np.hypot(*(np.c_[ring, np.ones(300)] @ (m @ before)[:2].T - moved).T).mean() < 15


@pytest.mark.parametrize("turn,size", [(0, 1.0), (3, 1.05)])
def test_outline_on_a_reduced_grid(spark, turn, size):
    """Planted shift, turn and scale come back within 1.5 pixels from a grid of half the size."""
    y, x = np.mgrid[:240, :240]

    def scene(dx, dy, angle, s):
        a = np.radians(angle)
        u, v = x - 120 - dx, y - 120 - dy
        p, q = (np.cos(a) * u + np.sin(a) * v) / s, (-np.sin(a) * u + np.cos(a) * v) / s
        th = np.arctan2(q, p / 1.2)
        inside = np.hypot(p / 1.2, q) < 54 + 7 * np.cos(3 * th) + 5 * np.sin(5 * th + 0.4)
        return np.where(inside, np.clip(100 + 60 * np.sin(p / 7) * np.cos(q / 5), 30, 255), 0)

    frames = {"post": scene(0, 0, 0, 1), "pre": scene(13, -9, turn, size)}
    df = frame_df(spark, frames).select(F.lit("a").alias("k"), F.col("f").alias("kind"), "r", "c", "v").filter("v > 0")
    cand = register.search_candidates(angle_range=4, scale_min=0.95, scale_max=1.05)
    row = register.register_outline(df, ["k"], (240, 240), down_scale=2.0, boundary_width=4, boundary_smooth=2.0, candidates=cand).first()
    m, a = np.array(row["m"]).reshape(3, 3), np.radians(turn)
    at = np.array([[120 + r * np.cos(k), 120 + r * np.sin(k), 1] for r in (0, 25, 50) for k in range(6)]).T
    want = size * np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]]) @ (at[:2] - 120) + 120 + np.array([[13], [-9]])
    assert np.abs((m @ at)[:2] / (m @ at)[2] - want).max() < 1.5


def test_a_black_frame_does_not_end_the_others(spark):
    df = spark.createDataFrame([("a", 0, 0, 0.0), ("b", 0, 0, 2.0), ("b", 0, 1, 4.0)], "k string, r int, c int, v double")
    got = {(r["k"], r["c"]): r["v"] for r in pixels.normalize(df, ["k"]).collect()}
    assert got == {("a", 0): None, ("b", 0): 0.5, ("b", 1): 1.0}


def test_a_pair_of_few_matches_leaves_the_others_their_homography(spark):
    from duoframe.operators.register import robust_homography

    rows = [("few", float(i), 1.0, float(i), 1.0) for i in range(3)]
    rows += [("many", float(i % 5), float(i // 5), float(i % 5) + 1, float(i // 5)) for i in range(25)]
    got = robust_homography(spark.createDataFrame(rows, "k string, x double, y double, u double, w double"), ["k"], n_hypotheses=50)
    assert {r["k"]: r["n_inliers"] for r in got.select("k", "n_inliers").collect()} == {"few": 0, "many": 25}


def test_the_registered_batch_runs_the_whole_search_on_all_pixels(spark):
    from duoframe.fixtures import Tables, v_px
    from duoframe.queries import parameters as Q

    t = Tables(spark, "/root/testdata/sf0.001")
    assert Q._runs(t)[0].count() == v_px(t).count()
    assert not {"multiscale", "interior_ecc", "rotation_search", "scale_search"} & set(Q.SMALL)


def test_homography_rounds_end_by_confidence(spark):
    h = np.array([[1.02, -0.05, 7], [0.04, 0.98, -3], [1e-5, -2e-5, 1]])
    rows = []
    for name, wrong in (("clean", 10), ("mixed", 180), ("line", 0)):
        p = RNG.uniform(0, 500, (300, 2))
        if name == "line":
            p[:, 1] = 2 * p[:, 0]
        d = np.c_[p, np.ones(300)] @ h.T
        u = d[:, :2] / d[:, 2:]
        u[:wrong] = RNG.uniform(0, 500, (wrong, 2))
        rows += [(name, *map(float, (*x, *y))) for x, y in zip(p, u)]
    df = spark.createDataFrame(rows, "k string, x double, y double, u double, w double")
    soon = {r["k"]: r for r in register.robust_homography(df, ["k"], first_round=64).collect()}
    whole = {r["k"]: r for r in register.robust_homography(df, ["k"], confidence=1 - 1e-15, n_hypotheses=2000, first_round=2000).collect()}
    for k in ("clean", "mixed"):
        assert np.allclose(np.array(soon[k]["m"]).reshape(3, 3), h, atol=1e-3) and soon[k]["n_inliers"] == whole[k]["n_inliers"]
        assert np.allclose(soon[k]["m"], whole[k]["m"], atol=1e-6)
    assert soon["line"]["m"] is None and soon["line"]["n_inliers"] == 0


def test_neighbours_of_groups_with_their_own_cells(spark):
    t = [("hot", i, *map(float, p)) for i, p in enumerate(np.r_[5 + RNG.normal(0, 1e-3, (500, 2)), [[9e4, 9e4]]])]
    t += [("wide", i, *map(float, p)) for i, p in enumerate(RNG.uniform(0, 1e5, (40, 2)))]
    q = [(g, i, *map(float, p)) for g in ("hot", "wide") for i, p in enumerate(np.r_[RNG.uniform(0, 1e5, (30, 2)), [[5.0, 5.0]]])]
    qd, td = spark.createDataFrame(q, "k string, q_id bigint, x double, y double"), spark.createDataFrame(t, "k string, t_id bigint, x double, y double")
    got = nearest_neighbours(qd, td, ["k"], max_per_cell=64).toPandas().set_index(["k", "q_id"])["dist"]
    for g, i, x, y in q:
        assert np.isclose(got[g, i], min(np.hypot(x - b, y - c) for k, _, b, c in t if k == g))


def test_local_zscore_keeps_cells_at_their_mean(spark):
    """A flat difference, as between saturated frames, has z = 0 in every listed cell and no row elsewhere."""
    flat = spark.createDataFrame([("a", r, c, 0.0) for r in range(12) for c in range(12) if (r, c) != (3, 4)], "f string, r int, c int, d double")
    got = filters.local_zscore(flat, ["f"], (12, 12), 2.0, tile=8).toPandas()
    assert len(got) == 143 and (got["z"] == 0).all() and not ((got["r"] == 3) & (got["c"] == 4)).any()


def test_colour_frames_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    """Discounts that add up to a whole number do so in any order; sums of these doubles are 0.9999999999999999, 1 or 1.0000000000000002."""
    for i, gains in enumerate(itertools.permutations([0.1, 0.2, 0.3, 0.4])):
        rows = [("A", "F", 0, 0, 2, 5.0, x) for x in gains] + [("A", "F", 1, 0, 2, 5.0, x) for x in [0.1] * 10]
        df = spark.createDataFrame(rows, "l_returnflag string, l_linestatus string, l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_discount double")
        df.coalesce(1).write.parquet(f"{tmp_path}/{i}/lineitem.parquet")
        assert [r.v for r in v_rgb(Tables(spark, f"{tmp_path}/{i}")).collect()] == [1, 1]
        if i == 3:
            break


def test_coarse_response_of_a_plain_square_is_full(spark):
    """Phases that a plain square does not have take nothing from the response of its shift."""
    post = np.zeros((48, 48))
    post[8:40, 8:40] = 255.0
    dx, dy, response = register._correlate(np.fft.rfft2(post), np.roll(post, (-3, 4), (0, 1)))
    assert np.allclose([dx, dy, response], [4, -3, 1], atol=1e-6)


def test_wrapped_frames_keep_their_detail(spark, tmp_path):
    """Cells of several hundred are all 255 in v_px; planted turns need frames that differ from cell to cell."""
    rows = [("A", "F", i % 128, i // 128 % 128, 0, 300.0 + i % 97) for i in range(128 * 128)]
    df = spark.createDataFrame(rows, "l_returnflag string, l_linestatus string, l_orderkey long, l_partkey long, l_linenumber int, l_quantity double")
    df.write.parquet(f"{tmp_path}/lineitem.parquet")
    px, _ = registration._turned(Tables(spark, str(tmp_path)))
    post = px.filter("kind = 'post'").toPandas()
    assert len(post) == 128 * 128 and post["v"].nunique() > 50 and post["v"].between(0, 255).all()


def test_coarse_search_of_a_soft_outline_cut_by_the_frame():
    """Where softened outlines have next to no signal, the phases of their interpolation must not outvote the rest."""
    n, w = 192, filters.gaussian_weights(2.0, size=filters.coarse_kernel_size(2.0))
    y, x = np.mgrid[0:n, 0:n] - n / 2 + 0.5

    def ring(mask):
        p, inner = np.pad(mask, 4, constant_values=True), mask.copy()
        for i, j in itertools.product(range(9), range(9)):
            if (i - 4) ** 2 + (j - 4) ** 2 <= 16:
                inner &= p[i : i + n, j : j + n]
        return filters._along(filters._along((mask & ~inner).astype(float), w, 0), w, 1)

    square = lambda a, b: np.maximum(np.abs(a), np.abs(b)) < 64
    t = np.radians(4)
    u, v = (np.cos(t) * (x - 4) - np.sin(t) * (y + 3)) / 1.05, (np.sin(t) * (x - 4) + np.cos(t) * (y + 3)) / 1.05
    # the turned square reaches the upper and the right edge of the frame
    pre = ring(square(u, v) | ((y < 0) & (np.abs(x - 20) < 40)) | ((x > 0) & (np.abs(y) < 50)))
    r, c = np.nonzero(pre)
    fa = np.fft.rfft2(ring(square(x, y)))
    found = [(register._correlate(fa, register._turned(pre, a, s, c.mean(), r.mean()))[2], s, a) for s, a in register.search_candidates()]
    assert np.allclose(max(found)[1:], [0.95, -4])
