"""Discs by distances against the run version and against plain loops."""

import numpy as np
import pandas as pd
import pytest

from duoframe.operators import discs
from duoframe.operators.masks import clip_runs, dilate, ellipse, erode, runs_to_pixels


def runs(spark, masks):
    rows = [(k, int(r), int(c), int(c)) for k, a in masks.items() for r, c in zip(*np.nonzero(a))]
    return spark.createDataFrame(rows, "k string, r int, c0 int, c1 int")


def array(df, k, shape):
    p = runs_to_pixels(df.filter(df["k"] == k)).toPandas()
    out = np.zeros(shape, bool)
    out[p["r"], p["c"]] = True
    return out


@pytest.mark.parametrize("radius,tile", [(1, 256), (5, 256), (5, 16), (9, 9)])
def test_discs_equal_the_run_version(spark, monkeypatch, radius, tile):
    monkeypatch.setattr(discs, "LEAST_TILE", tile)
    rng, shape = np.random.default_rng(radius), (45, 61)
    masks = {"sparse": rng.random(shape) < 0.01, "full": rng.random(shape) < 0.97, "edge": np.zeros(shape, bool)}
    masks["edge"][:3], masks["edge"][:, -4:] = True, True
    df = runs(spark, masks)
    grown, kept = discs.dilate_disc(df, ["k"], radius, shape), discs.erode_disc(df, ["k"], radius, shape)
    old_grown = clip_runs(dilate(df, ["k"], ellipse(radius)), ["k"], shape)
    old_kept = erode(discs.dilate_disc(df, ["k"], 0, shape), ["k"], ellipse(radius), shape, outside_counts=False)
    for k in masks:
        assert np.array_equal(array(grown, k, shape), array(old_grown, k, shape))
        assert np.array_equal(array(kept, k, shape), array(old_kept, k, shape))


def test_a_large_radius_sends_no_more_rows(spark):
    """A radius of 112 sends a run to a few tiles, where the run version made 225 copies of it."""
    shape = (900, 900)
    df = spark.createDataFrame([("a", 450, 430, 470), ("a", 5, 3, 4)], "k string, r int, c0 int, c1 int")
    got = array(discs.dilate_disc(df, ["k"], 112, shape), "a", shape)
    y, x = np.mgrid[:900, :900]
    half = np.array([ellipse(112).get(d, -1) for d in range(-900, 901)])
    want = np.zeros(shape, bool)
    for r, c0, c1 in ((450, 430, 470), (5, 3, 4)):
        gap = np.maximum(np.maximum(c0 - x, x - c1), 0)
        want |= gap <= half[y - r + 900]
    assert np.array_equal(got, want)
    back = array(discs.erode_disc(discs.dilate_disc(df, ["k"], 112, shape), ["k"], 112, shape), "a", shape)
    assert back[450, 430:471].all() and back.sum() < want.sum()
    assert discs.dilate_disc(df.filter("false"), ["k"], 3, shape).count() == 0
