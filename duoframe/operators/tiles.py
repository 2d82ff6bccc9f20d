"""Haloed tiles (M6): the physical layout for array kernels over large neighbourhoods."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import size_columns

TILE = 512


def tile_map(
    px: DataFrame,
    keys: Sequence[str],
    shape,
    halo: int,
    kernel: Callable[[np.ndarray, np.ndarray], np.ndarray | list[np.ndarray]],
    value: str = "v",
    outputs: Sequence[str] = ("v",),
    tile: int = TILE,
    mode: str = "constant",
    fill: float = 0.0,
    absent: float = 0.0,
    drop_zero: bool = True,
) -> DataFrame:
    """Apply an array kernel to every tile of every frame, with halo cells around it.

    kernel(a, inside) gets the haloed array and the mask of cells inside the frame and
    returns one array per output, of the same shape. Cells beyond the frame hold fill,
    or a mirror image of the frame: mode 'reflect' repeats the edge cell, 'mirror' does
    not. A cell of the frame without a row holds absent. A pixel goes only to the tiles whose halo covers it (one for most pixels), so
    a task group never holds more than (tile + 2 * halo)^2 cells, however large the frame.
    """
    key_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in px.select(*keys).schema)
    schema = ", ".join([s for s in [key_schema] if s] + ["r int", "c int"] + [f"{o} double" for o in outputs])
    n_out = len(outputs)

    def cells(a: np.ndarray, inside: np.ndarray) -> dict:
        res = kernel(a, inside)
        res = [res] if n_out == 1 and isinstance(res, np.ndarray) else res
        core = [x[halo: x.shape[0] - halo, halo: x.shape[1] - halo] for x in res]
        keep = np.zeros(core[0].shape, bool)
        for x in core:
            keep |= x != 0
        if not drop_zero:
            keep[:] = True
        r, c = np.nonzero(keep)
        return {"r": r, "c": c, **{name: x[r, c] for name, x in zip(outputs, core)}}

    return tile_rows(px, keys, shape, halo, cells, schema, value, tile, mode, fill, absent)


def tile_rows(
    px: DataFrame, keys: Sequence[str], shape, halo: int, rows_of: Callable[[np.ndarray, np.ndarray], dict], schema: str,
    value: str = "v", tile: int = TILE, mode: str = "constant", fill: float = 0.0, absent: float = 0.0,
) -> DataFrame:
    """Rows that rows_of finds in each haloed tile; its r and c count from the tile corner without halo."""
    keys = list(keys)
    fixed = None if isinstance(shape, DataFrame) else (int(shape[0]), int(shape[1]))  # one size is not sent with each pixel
    sized = size_columns(px.select(*keys, "r", "c", F.col(value).cast("double").alias("_v")), shape, keys)
    near = lambda x, size: F.explode(
        F.sequence(
            F.greatest(F.lit(0), F.floor((F.col(x) - halo) / tile)).cast("int"),
            F.least(F.floor((F.col(size) - 1) / tile), F.floor((F.col(x) + halo) / tile)).cast("int"),
        )
    )
    routed = sized.withColumn("_tr", near("r", "height")).withColumn("_tc", near("c", "width"))
    if fixed:
        routed = routed.drop("height", "width")

    def run(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        height, width = fixed or (int(pdf["height"].iloc[0]), int(pdf["width"].iloc[0]))
        tr, tc = group[-2], group[-1]
        top, left = tr * tile - halo, tc * tile - halo
        # only the cells up to the frame edge plus halo are needed
        rows = min(tile, height - tr * tile) + 2 * halo
        cols = min(tile, width - tc * tile) + 2 * halo
        a = np.full((rows, cols), absent)
        # halo cells beyond the cut arrays of edge tiles are not needed
        r, c = pdf["r"].to_numpy() - top, pdf["c"].to_numpy() - left
        a[r, c] = pdf["_v"].to_numpy()
        rr, cc = np.arange(top, top + rows), np.arange(left, left + cols)
        inside = ((rr >= 0) & (rr < height))[:, None] & ((cc >= 0) & (cc < width))[None, :]
        if mode == "constant":
            a[~inside] = fill
        else:
            a = a[_fold(rr, height, mode) - top][:, _fold(cc, width, mode) - left]
        out = rows_of(a, inside)
        n = len(out["r"])
        # object columns keep their type when a tile yields no row
        res = {k: pd.Series([v] * n, dtype=object) for k, v in zip(keys, group[:-2])}
        for name, x in out.items():
            shift = {"r": tr * tile, "c": tc * tile}.get(name)
            res[name] = x if shift is None else (np.asarray(x) + shift).astype(np.int32)
        return pd.DataFrame(res)

    return routed.groupBy(*keys, "_tr", "_tc").applyInPandas(run, schema)


def _fold(i: np.ndarray, n: int, mode: str) -> np.ndarray:
    """Index of the mirrored cell for positions outside 0..n-1."""
    if mode == "reflect":
        i = np.mod(i, 2 * n)
        return np.where(i < n, i, 2 * n - 1 - i)
    if n == 1:
        return np.zeros_like(i)
    i = np.mod(i, 2 * n - 2)
    return np.where(i < n, i, 2 * n - 2 - i)
