"""Scale-space features on planted blobs, edges and turned frames."""

import numpy as np
import pandas as pd
import pytest

from duoframe.operators.features import interior_keypoints
from duoframe.operators.matching import ratio_test, two_nearest


def pixels(spark, frames):
    parts = []
    for k, a in frames.items():
        r, c = np.nonzero(a)
        parts.append(pd.DataFrame({"k": k, "r": r, "c": c, "v": a[r, c]}))
    return spark.createDataFrame(pd.concat(parts), "k string, r int, c int, v double")


def blobs(h, w, spots):
    y, x = np.mgrid[:h, :w]
    return sum(200 * np.exp(-((y - a) ** 2 + (x - b) ** 2) / (2 * s * s)) for a, b, s in spots)


SPOTS = [(40.3, 50.7, 2.2), (120.0, 61.5, 3.0), (60.4, 150.2, 4.4), (150.6, 150.1, 7.0)]


@pytest.mark.parametrize("tile", [512, 64])
def test_blobs_are_found_to_a_fraction_of_a_cell(spark, tile):
    got = interior_keypoints(pixels(spark, {"a": blobs(200, 230, SPOTS)}), ["k"], (200, 230), min_contrast=5.0, tile=tile).toPandas()
    for y, x, s in SPOTS:
        near = got[np.hypot(got["y"] - y, got["x"] - x) < 0.15 * max(s / 2, 1)]
        assert len(near) and (np.abs(np.log2(near["sigma"] / s)) < 0.3).any()
    far = [min(np.hypot(y - a, x - b) for a, b, _ in SPOTS) for y, x in zip(got["y"], got["x"])]
    assert max(far) < 1


def test_tiles_give_the_features_of_the_whole_frame(spark):
    r = np.random.default_rng(3)
    a = blobs(150, 170, [(r.uniform(10, 140), r.uniform(10, 160), r.uniform(2, 6)) for _ in range(60)])
    px = pixels(spark, {"a": a})
    one, other = (interior_keypoints(px, ["k"], (150, 170), tile=t).toPandas().sort_values(["y", "x", "sigma", "angle"], ignore_index=True) for t in (512, 50))
    assert len(one) == len(other) > 40
    for c in ("y", "x", "sigma", "angle", "response"):
        assert np.allclose(one[c], other[c], atol=1e-6)


def test_edges_and_flat_frames_have_none(spark):
    edge = np.zeros((120, 120))
    edge[:, 60:] = 200
    corner = np.zeros((120, 120))
    corner[60:, 60:] = 200
    got = interior_keypoints(pixels(spark, {"edge": edge, "flat": np.full((120, 120), 9.0), "corner": corner}), ["k"], (120, 120), min_contrast=2.0).toPandas()
    inner = got[(got["y"].between(20, 100)) & (got["x"].between(20, 100))]
    assert set(inner["k"]) == {"corner"}


def test_n_best_keeps_the_strongest(spark):
    px = pixels(spark, {"a": blobs(200, 230, SPOTS)})
    every = interior_keypoints(px, ["k"], (200, 230), min_contrast=1.0).toPandas().sort_values("response", ascending=False)
    few = interior_keypoints(px, ["k"], (200, 230), n_best=3, min_contrast=1.0).toPandas()
    assert few["response"].min() >= every["response"].iloc[2] - 1e-9 and len(few) >= 3
    assert interior_keypoints(px.filter("false"), ["k"], (200, 230)).count() == 0


@pytest.mark.parametrize("turn,size", [(20, 1.0), (20, 1.15), (90, 0.9)])
def test_matches_survive_turn_and_scale(spark, turn, size):
    r = np.random.default_rng(1)
    spots = [(r.uniform(-110, 110), r.uniform(-110, 110), r.uniform(2, 5), r.uniform(0.4, 1)) for _ in range(220)]
    y, x = np.mgrid[:260, :260] - 130.0
    a = np.radians(turn)

    def frame(angle, s):
        out = np.zeros((260, 260))
        for p, q, w, v in spots:
            cy, cx = s * (np.cos(angle) * p + np.sin(angle) * q), s * (-np.sin(angle) * p + np.cos(angle) * q)
            out += 120 * v * np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / (2 * (s * w) ** 2))
        return np.round(np.minimum(out, 255))

    kp = interior_keypoints(pixels(spark, {"post": frame(0, 1), "pre": frame(a, size)}), ["k"], (260, 260)).toPandas()
    post, pre = kp[kp["k"] == "post"].set_index("kp_id"), kp[kp["k"] == "pre"].set_index("kp_id")
    side = lambda d, name: spark.createDataFrame([("g", int(i), [float(v) for v in vec]) for i, vec in d["vec"].items()], f"g string, {name} long, vec array<float>")
    good = ratio_test(two_nearest(side(post, "q_id"), side(pre, "t_id"), ["g"]), 0.7).toPandas()
    p, q = post.loc[good["q_id"], ["y", "x"]].to_numpy() - 130, pre.loc[good["t_id"], ["y", "x"]].to_numpy() - 130
    want = size * p @ np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]])
    right = np.hypot(*(want - q).T) < 1.5
    assert right.sum() >= 60 and right.mean() > 0.9


def test_pixels_are_read_once(spark):
    """The first octave's features and its cells for the next one come from one pass over the pixels."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    y, x = np.mgrid[0:72, 0:72]
    v = 200 * np.exp(-((y - 36) ** 2 + (x - 30) ** 2) / (2 * 3.0**2))
    rows = pd.DataFrame({"f": "a", "r": y.ravel(), "c": x.ravel(), "v": v.ravel()})
    px = spark.createDataFrame(rows, "f string, r int, c int, v double").mapInPandas(counted, "f string, r int, c int, v double")
    got = interior_keypoints(px, ["f"], (72, 72)).toPandas()
    best = got.loc[got["response"].idxmax()]
    assert abs(best.y - 36) < 0.3 and abs(best.x - 30) < 0.3 and read.value == 72 * 72
