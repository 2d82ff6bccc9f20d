"""Neighbourhood filters and resampling to a coarser grid."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import attach, size_columns
from .histograms import match_histograms
from .tiles import tile_map


def area_downsample(px: DataFrame, keys: Sequence[str], shape, factor: float) -> DataFrame:
    """Shrink by factor >= 1; an output cell is the area-weighted mean of what it covers.

    Every pixel gives its share to at most four cells, then one map-side combined sum.
    """
    sized = size_columns(px, shape, keys)
    sized = sized.withColumn("_oh", F.greatest(F.lit(1), F.rint(F.col("height") / factor).cast("int"))).withColumn(
        "_ow", F.greatest(F.lit(1), F.rint(F.col("width") / factor).cast("int"))
    ).withColumn("_sy", F.col("height") / F.col("_oh")).withColumn("_sx", F.col("width") / F.col("_ow"))

    def shares(x: str, step: str, n: str):
        first = F.floor(F.col(x) / F.col(step)).cast("int")
        cut = (first + 1) * F.col(step)
        whole = F.least(F.lit(1.0), cut - F.col(x))
        parts = F.array(
            F.struct(first.alias("i"), whole.alias("w")),
            F.struct((first + 1).alias("i"), (1.0 - whole).alias("w")),
        )
        return F.explode(F.filter(parts, lambda s: (s["w"] > 1e-12) & (s["i"] < F.col(n))))

    return (
        sized.withColumn("_y", shares("r", "_sy", "_oh")).withColumn("_x", shares("c", "_sx", "_ow"))
        .groupBy(*keys, F.col("_y.i").alias("r"), F.col("_x.i").alias("c"))
        .agg((F.sum(F.col("v") * F.col("_y.w") * F.col("_x.w")) / F.max(F.col("_sy") * F.col("_sx"))).alias("v"))
    )


def downsampled_shape(height: int, width: int, factor: float) -> tuple[int, int]:
    return max(1, round(height / factor)), max(1, round(width / factor))


def _along(a: np.ndarray, weights: np.ndarray, axis: int) -> np.ndarray:
    """Correlation along one axis; cells beyond the array count as 0."""
    k = len(weights) // 2
    pad = [(0, 0), (0, 0)]
    pad[axis] = (k, k)
    p = np.pad(a, pad)
    n = a.shape[axis]
    out = np.zeros_like(a)
    for i, w in enumerate(weights):
        out += w * (p[i:i + n] if axis == 0 else p[:, i:i + n])
    return out


def gaussian_weights(sigma: float, truncate: float = 4.0, size: int | None = None) -> np.ndarray:
    """Normalised Gaussian over radius int(truncate * sigma + 0.5), or over an odd size."""
    radius = int(truncate * sigma + 0.5) if size is None else size // 2
    x = np.arange(-radius, radius + 1)
    w = np.exp(-0.5 * (x / sigma) ** 2)
    return w / w.sum()


def coarse_kernel_size(sigma: float) -> int:
    """Kernel size of the registration blurs: round(8*sigma + 1), made odd."""
    return round(8 * sigma + 1) | 1


def gaussian_blur(
    px: DataFrame, keys: Sequence[str], shape, sigma: float, mode: str = "reflect",
    size: int | None = None, tile: int = 512,
) -> DataFrame:
    """Separable Gaussian; 'reflect' repeats the edge cell, 'mirror' does not, 'constant' is 0."""
    if sigma <= 0:
        return px
    w = gaussian_weights(sigma, size=size)

    def kernel(a, inside):
        return _along(_along(a, w, 0), w, 1)

    return tile_map(px, keys, shape, len(w) // 2, kernel, tile=tile, mode=mode)


def nan_conserving_blur(px: DataFrame, keys: Sequence[str], shape, sigma: float, tile: int = 512) -> DataFrame:
    """Blur that keeps the total next to masked cells; a row with NULL v is a masked cell.

    Every unmasked cell gets the blur of the known values plus its own value times
    the blurred share of masked (or outside) cells. Masked cells stay NULL.
    """
    w = gaussian_weights(sigma)
    known = px.withColumn("_known", F.coalesce(F.col("v"), F.lit(float("nan"))))

    def kernel(a, inside):
        gap = np.isnan(a)
        lost = (gap | ~inside).astype(float)
        # the share of the kernel outside the haloed array lies outside the frame as well
        lost = 1.0 - _along(_along(1.0 - lost, w, 0), w, 1)
        kept = np.where(gap, 0.0, a)
        out = _along(_along(kept, w, 0), w, 1) + lost * kept
        return np.where(gap, np.nan, out)

    out = tile_map(known, keys, shape, len(w) // 2, kernel, value="_known", tile=tile)
    return out.withColumn("v", F.when(~F.isnan("v"), F.col("v")))


def unsharp(px: DataFrame, keys: Sequence[str], shape, sigma: float, tile: int = 512) -> DataFrame:
    """E5: positive part of v - blur(v), divided by its frame maximum + 1e-8."""
    w = gaussian_weights(sigma, size=coarse_kernel_size(sigma))

    def kernel(a, inside):
        return np.where(inside, np.maximum(a - _along(_along(a, w, 0), w, 1), 0.0), 0.0)

    raw = tile_map(px, keys, shape, len(w) // 2, kernel, tile=tile, mode="mirror")
    top = raw.groupBy(*keys).agg(F.max("v").alias("_top"))
    return attach(raw, top, keys).withColumn("v", F.col("v") / (F.col("_top") + 1e-8)).drop("_top")


def box_mean(px: DataFrame, keys: Sequence[str], shape, size: int, tile: int = 512) -> DataFrame:
    """Mean over a size x size window, cells outside are 0.

    An even window reaches size//2 cells back and size//2 - 1 cells ahead.
    """
    back, ahead = size // 2, size - 1 - size // 2

    def kernel(a, inside):
        for axis in (0, 1):
            total = np.cumsum(np.insert(a, 0, 0.0, axis=axis), axis=axis)
            n = a.shape[axis]
            i = np.arange(n)
            a = np.take(total, np.minimum(i + ahead + 1, n), axis) - np.take(total, np.maximum(i - back, 0), axis)
        return np.where(inside, a / float(size * size), 0.0)

    return tile_map(px, keys, shape, max(back, ahead), kernel, tile=tile)


def densest_window(mask_px: DataFrame, keys: Sequence[str], shape, size: int) -> DataFrame:
    """Corner r0, c0 of the size x size window with the most mask cells, clipped into the frame.

    Counts are whole numbers, so ties are exact: the first window in raster order wins.
    """
    ones = mask_px.select(*keys, "r", "c", F.lit(1.0).alias("v"))
    count = box_mean(ones, keys, shape, size).withColumn("n", F.rint(F.col("v") * size * size).cast("bigint"))
    best = count.groupBy(*keys).agg(
        F.max_by(F.struct("r", "c", "n"), F.struct(F.col("n"), -F.col("r"), -F.col("c"))).alias("b")
    )
    sized = size_columns(best, shape, keys)
    corner = lambda x, n: F.greatest(F.lit(0), F.least(x - size // 2, F.col(n) - size))
    return sized.select(
        *keys, corner(F.col("b.r"), "height").alias("r0"), corner(F.col("b.c"), "width").alias("c0"),
        F.col("b.n").alias("n"),
    )


def local_zscore(
    diff: DataFrame, keys: Sequence[str], shape, sigma: float = 20.0, tile: int = 512
) -> DataFrame:
    """(d - local mean) / local deviation, both Gaussian-weighted over the listed cells.

    diff lists d for every cell of the mask; a cell without a row is outside the mask.
    """
    w = gaussian_weights(sigma)
    blur = lambda a: _along(_along(a, w, 0), w, 1)

    def kernel(a, inside):
        known = ~np.isnan(a)
        d = np.where(known, a, 0.0)
        weight = blur(known.astype(float)) + 1e-8
        mean = blur(d) / weight
        spread = np.sqrt(np.maximum(blur(d * d) / weight - mean * mean, 0.0)) + 1e-8
        return np.where(known, (d - mean) / spread, np.nan)

    z = tile_map(
        diff, keys, shape, len(w) // 2, kernel, value="d", outputs=("z",), tile=tile, mode="reflect", absent=math.nan,
        drop_zero=False,  # a listed cell at its local mean has z = 0 and keeps its row
    )
    return z.filter(F.col("z").isNotNull() & ~F.isnan("z"))


def registration_input(
    px: DataFrame, keys: Sequence[str], shape, gauss_sigma: float = 0.0, unsharp_sigma: float = 0.0,
    use_edges: bool = True, boundary_width: int = 15, boundary_smooth: float = 10.0, levels: int | None = None,
) -> DataFrame:
    """Matched pair, optionally blurred, then boundary ring, unsharp image or the image itself."""
    from .rings import boundary_ring

    side = [*keys, "kind"]
    eq = match_histograms(px, keys, levels=levels).select(*side, "r", "c", F.col("matched").alias("v"))
    if gauss_sigma > 0:
        eq = gaussian_blur(eq, side, shape, gauss_sigma, "mirror", coarse_kernel_size(gauss_sigma))
    if use_edges:
        return boundary_ring(eq, side, shape, boundary_width, boundary_smooth)
    return unsharp(eq, side, shape, unsharp_sigma) if unsharp_sigma else eq
