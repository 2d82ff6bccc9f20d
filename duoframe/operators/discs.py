"""Dilation and erosion by discs of any radius, from exact distances on haloed tiles."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import size_columns

LEAST_TILE = 256


def _near(mask: np.ndarray, radius: int, rows: slice) -> np.ndarray:
    """Cells of some rows whose disc meets the mask, by distances along rows, then along columns.

    The disc of a radius has the half-width round(sqrt(radius^2 - d^2)) in row d, so a cell
    h columns and d rows away lies in it if max(h - 1/2, 0)^2 + d^2 <= radius^2.
    """
    n = mask.shape[1]
    at = np.arange(n, dtype=np.int32)
    far = np.int32(4 * (n + radius))
    before = np.maximum.accumulate(np.where(mask, at, -far), axis=1)
    after = np.minimum.accumulate(np.where(mask, at, far)[:, ::-1], axis=1)[:, ::-1]
    gap = np.minimum(np.minimum(at - before, after - at), radius + 2).astype(np.float32)
    square = np.square(np.maximum(gap - 0.5, 0))
    best = np.full((rows.stop - rows.start, n), np.float32(np.inf))
    for d in range(-radius, radius + 1):
        low, high = rows.start + d, rows.stop + d
        a, b = max(low, 0), min(high, len(mask))
        if a < b:
            part = best[a - low : b - low]
            np.minimum(part, square[a:b] + np.float32(d * d), out=part)
    return best <= np.float32(radius * radius)


def _runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    edge = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    r, c0 = np.nonzero(edge == 1)
    return r, c0, np.nonzero(edge == -1)[1] - 1


def _by_discs(runs: DataFrame, keys: Sequence[str], radius: int, shape, grow: bool) -> DataFrame:
    keys = list(keys)
    tile = max(LEAST_TILE, radius)
    ddl = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in runs.select(*keys).schema)
    span = lambda low, high, size: F.explode(F.sequence(
        F.greatest(F.lit(0), F.floor((F.col(low) - radius) / tile)).cast("int"), F.least(F.floor((F.col(size) - 1) / tile), F.floor((F.col(high) + radius) / tile)).cast("int")))
    inside = size_columns(runs.select(*keys, "r", "c0", "c1"), shape, keys).filter("r >= 0 and r < height and c1 >= 0 and c0 < width")
    routed = inside.withColumn("_tr", span("r", "r", "height")).withColumn("_tc", span("c0", "c1", "width"))

    def run(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        height, width = int(pdf["height"].iloc[0]), int(pdf["width"].iloc[0])
        top, left = group[-2] * tile, group[-1] * tile
        rows, cols = min(tile, height - top), min(tile, width - left)
        r = pdf["r"].to_numpy() - top + radius
        c0 = np.clip(pdf["c0"].to_numpy() - left + radius, 0, cols + 2 * radius)
        change = np.zeros((rows + 2 * radius, cols + 2 * radius + 1), np.int32)
        stop = np.clip(pdf["c1"].to_numpy() + 1 - left + radius, 0, cols + 2 * radius)
        fits = (r >= 0) & (r < len(change)) & (stop > c0)
        np.add.at(change, (r[fits], c0[fits]), 1)
        np.add.at(change, (r[fits], stop[fits]), -1)
        mask = np.cumsum(change, axis=1)[:, :-1] > 0
        core = slice(radius, radius + rows)
        if grow:
            out = _near(mask, radius, core)[:, radius : radius + cols]
        else:  # cells beyond the frame put no constraint
            i, j = np.arange(len(mask)) + top - radius, np.arange(mask.shape[1]) + left - radius
            free = ((i >= 0) & (i < height))[:, None] & ((j >= 0) & (j < width))[None, :] & ~mask
            out = mask[core, radius : radius + cols] & ~_near(free, radius, core)[:, radius : radius + cols]
        r, c0, c1 = _runs_of(out)
        return pd.DataFrame({**{k: pd.Series([v] * len(r), dtype=object) for k, v in zip(keys, group)}, "r": (r + top).astype(np.int32), "c0": (c0 + left).astype(np.int32), "c1": (c1 + left).astype(np.int32)})

    cut = routed.groupBy(*keys, "_tr", "_tc").applyInPandas(run, ddl + "r int, c0 int, c1 int")
    from .masks import union_runs

    return union_runs(keys, cut)  # runs that touch across a tile border are one


def dilate_disc(runs: DataFrame, keys: Sequence[str], radius: int, shape) -> DataFrame:
    """Cells of the frame whose disc meets the mask. A run goes to the tiles its discs reach, whatever the radius is."""
    return _by_discs(runs, keys, radius, shape, True)


def erode_disc(runs: DataFrame, keys: Sequence[str], radius: int, shape) -> DataFrame:
    """Cells whose whole disc, as far as it is inside the frame, lies in the mask."""
    return _by_discs(runs, keys, radius, shape, False)
