"""Warping of sparse pixel tables through an inverse map, tile by tile of the output."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import matrices as M
from ..session import attach, size_columns

TILE = 256
_MAP, _BACK = ([f"{name}{i}" for i in range(9)] for name in ("_map", "_back"))


def _routed(px: DataFrame, keys: Sequence[str], shape, transforms: DataFrame, reach: float, tile: int) -> DataFrame:
    """Each source pixel once per output tile with cells whose source position may lie within reach of it.

    Cells are looked for around the image of the pixel under the inverse of the map. While the square
    of the pixel lies on one side of the horizon, its image ends at most du and dv away; a square on
    the horizon goes to every tile of the frame. A pixel that no cell samples, as most where the map
    shrinks, stops here, so a tile meets little more than four pixels per cell.
    """
    on = [k for k in keys if k in transforms.columns]
    entry = lambda m, names: [F.get(m, F.lit(i)).alias(n) for i, n in enumerate(names)]
    maps = transforms.withColumn("_back", M.invert(F.col("m"))).select(*on, *entry(F.col("m"), _MAP), *entry(F.col("_back"), _BACK))
    src = attach(size_columns(px, shape, keys), maps.filter(F.col(_BACK[8]).isNotNull()), on, "inner")
    a, b, e, c, d, f, g, h, i = (F.col(n) for n in _BACK)
    src = src.withColumn("_w", g * F.col("c") + h * F.col("r") + i)
    src = src.withColumn("_least", F.abs("_w") - reach * (F.abs(g) + F.abs(h))).withColumn("_beyond", F.col("_least") < 1e-9)
    w = F.when(~F.col("_beyond"), F.col("_w"))
    src = src.withColumn("_u", (a * F.col("c") + b * F.col("r") + e) / w).withColumn("_v", (c * F.col("c") + d * F.col("r") + f) / w)
    wide = lambda at, p, q: reach * (F.abs(p - F.col(at) * g) + F.abs(q - F.col(at) * h)) / F.greatest("_least", F.lit(1e-9)) + 1e-6
    src = src.withColumn("_du", wide("_u", a, b)).withColumn("_dv", wide("_v", c, d))
    lo = lambda at, size: F.when(F.col("_beyond"), 0.0).otherwise(F.least(F.greatest(F.ceil(F.col(f"_{at}") - F.col(f"_d{at}")), F.lit(0.0)), F.col(size) * 1.0))
    hi = lambda at, size: F.when(F.col("_beyond"), F.col(size) - 1.0).otherwise(F.greatest(F.least(F.floor(F.col(f"_{at}") + F.col(f"_d{at}")), F.col(size) - 1.0), F.lit(-1.0)))
    src = src.select(*px.columns, "height", "width", *_MAP, lo("u", "width").alias("_left"), hi("u", "width").alias("_right"), lo("v", "height").alias("_top"), hi("v", "height").alias("_bottom"))
    tiles = lambda first, last: F.explode(F.sequence(*[F.floor(F.col(n) / tile).cast("int") for n in (first, last)]))
    return (
        src.filter("_left <= _right and _top <= _bottom").withColumn("_tr", tiles("_top", "_bottom")).withColumn("_tc", tiles("_left", "_right"))
        .drop("_left", "_right", "_top", "_bottom")
    )


def _positions(pdf: pd.DataFrame, tr: int, tc: int, tile: int) -> tuple[np.ndarray, ...]:
    """Rows and columns of the cells of an output tile, and the source position of each; -9 for none."""
    m = [float(pdf[n].iloc[0]) for n in _MAP]
    height, width = int(pdf["height"].iloc[0]), int(pdf["width"].iloc[0])
    r, c = np.mgrid[tr * tile: min((tr + 1) * tile, height), tc * tile: min((tc + 1) * tile, width)]
    r, c = r.ravel(), c.ravel()
    w = m[6] * c + m[7] * r + m[8]
    with np.errstate(divide="ignore", invalid="ignore"):
        x, y = (m[0] * c + m[1] * r + m[2]) / w, (m[3] * c + m[4] * r + m[5]) / w
    there = (np.abs(x) < 1 << 30) & (np.abs(y) < 1 << 30)
    return r, c, np.where(there, x, -9.0), np.where(there, y, -9.0)


def _place(r: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (np.asarray(r, np.int64) << 32) + np.asarray(c, np.int64)


def _per_tile(routed: DataFrame, keys: list[str], kernel: Callable, columns: Sequence[str]) -> DataFrame:
    """Rows (r, c, columns) that the kernel makes of the pixels of each output tile."""
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in routed.select(*keys).schema) + "r int, c int"
    ddl += "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in routed.select(*columns).schema)

    def run(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = kernel(pdf, group[-2], group[-1])
        own = {k: pd.Series([v] * len(out["r"]), dtype=object) for k, v in zip(keys, group)}
        return pd.DataFrame({**own, **out})

    return routed.groupBy(*keys, "_tr", "_tc").applyInPandas(run, ddl)


def warp_bilinear(px: DataFrame, keys: Sequence[str], shape, transforms: DataFrame, tile: int = TILE) -> DataFrame:
    """out(x, y) = in(m * (x, y, 1)), bilinear, 0 outside the frame.

    transforms has the pair keys and m. A stored pixel goes to the output tiles that sample it,
    for most maps to one; each tile is then sampled as arrays. Neither the output grid is
    generated as rows, nor is there a join on coordinates or a sum per cell. Repeated pixels
    count together, a missing value not at all; a pair without a map has no output.
    """
    keys = list(keys)
    stored = px.filter("v is not null").select(*keys, "r", "c", F.col("v").cast("double").alias("v"))
    routed = _routed(stored, keys, shape, transforms, 1.0, tile)

    def kernel(pdf: pd.DataFrame, tr: int, tc: int) -> dict:
        r, c, x, y = _positions(pdf, tr, tc, tile)
        at, which = np.unique(_place(pdf["r"], pdf["c"]), return_inverse=True)
        v = np.bincount(which, pdf["v"].to_numpy(float))
        x0, y0 = np.floor(x).astype(np.int64), np.floor(y).astype(np.int64)
        fx, fy = x - x0, y - y0
        out, any_ = np.zeros(len(r)), np.zeros(len(r), bool)
        for i, wy in ((0, 1 - fy), (1, fy)):
            for j, wx in ((0, 1 - fx), (1, fx)):
                want = _place(y0 + i, x0 + j)
                pos = np.minimum(np.searchsorted(at, want), len(at) - 1)
                hit = (at[pos] == want) & (wx * wy > 0)
                out[hit] += (wx * wy)[hit] * v[pos[hit]]
                any_ |= hit
        return {"r": r[any_], "c": c[any_], "v": out[any_]}

    return _per_tile(routed, keys, kernel, ["v"])


def warp_nearest(px: DataFrame, keys: Sequence[str], shape, transforms: DataFrame, tile: int = TILE) -> DataFrame:
    """The same map with all columns of the nearest source pixel (for masks and rings).

    Rows of a tile are picked by number, so further columns keep their types; repeated pixels
    are repeated in the output.
    """
    keys = list(keys)
    more = [k for k in px.columns if k not in (*keys, "r", "c")]
    routed = _routed(px, keys, shape, transforms, 0.5, tile)

    def kernel(pdf: pd.DataFrame, tr: int, tc: int) -> dict:
        r, c, x, y = _positions(pdf, tr, tc, tile)
        at = _place(pdf["r"], pdf["c"])
        order = np.argsort(at, kind="stable")
        want = _place(np.floor(y + 0.5), np.floor(x + 0.5))
        first, last = np.searchsorted(at[order], want, "left"), np.searchsorted(at[order], want, "right")
        n = last - first  # repeated pixels are repeated in the output
        cell = np.repeat(np.arange(len(r)), n)
        row = order[first[cell] + np.arange(len(cell)) - np.repeat(np.cumsum(n) - n, n)]
        picked = pdf[more].iloc[row].reset_index(drop=True)
        return {"r": r[cell], "c": c[cell], **{k: picked[k] for k in more}}

    return _per_tile(routed, keys, kernel, more)


def shift_image(px: DataFrame, keys: Sequence[str], shape, offsets: DataFrame) -> DataFrame:
    """Move the image by (dx, dy), given per group, with bilinear sampling."""
    t = offsets.select(*[k for k in keys if k in offsets.columns], M.translation(-F.col("dx"), -F.col("dy")).alias("m"))
    return warp_bilinear(px, keys, shape, t)


def rotate_and_scale(px: DataFrame, keys: Sequence[str], shape, turns: DataFrame) -> DataFrame:
    """Turn by angle and scale about (cx, cy), given per group."""
    forward = M.rotation_about(F.col("angle"), F.col("scale"), F.col("cx"), F.col("cy"))
    t = turns.select(*[k for k in keys if k in turns.columns], M.invert(forward).alias("m"))
    return warp_bilinear(px, keys, shape, t)
