"""Boundary rings of the tissue outline on coarse frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import attach, pin, size_columns, union_all
from .components import components
from .filters import coarse_kernel_size, gaussian_blur
from .masks import (
    close_ellipse, erode_ellipse, fill_holes, largest_component, pixels_to_runs, runs_to_pixels, subtract_runs,
)
from .percentiles import percentiles


def ring_runs(px: DataFrame, keys: Sequence[str], shape: tuple[int, int], boundary_width: int = 15) -> DataFrame:
    """Hard ring: the tissue mask without its erosion, as runs. px holds values in 0..1.

    Frames fall into three density classes, which decide blur, threshold and closing;
    each class is handled as one job over all its frames.
    """
    keys, height = list(keys), shape[0]
    px = pin(px)
    share = pin(
        size_columns(px, shape, keys).groupBy(*keys).agg(
            (F.count_if(F.col("v") > 0.05) / F.max(F.col("height") * F.col("width"))).alias("_share")
        )
    )
    marked = attach(px, share, keys)
    # sigma follows the frame height, within fixed limits per class
    classes = {
        "sparse": (F.col("_share") <= 0.1, min(max(height // 100, 2), 10), boundary_width),
        "dense": ((F.col("_share") > 0.1) & (F.col("_share") <= 0.3), min(max(height // 50, 3), 20), boundary_width),
        "full": (F.col("_share") > 0.3, min(max(height // 50, 3), 20), 3 * boundary_width),
    }
    present = {r[0] for r in share.select(
        F.when(F.col("_share") <= 0.1, "sparse").when(F.col("_share") <= 0.3, "dense").otherwise("full")
    ).distinct().collect()}
    masks = []
    for name in [n for n in classes if n in present]:
        wanted, sigma, radius = classes[name]
        part = marked.filter(wanted).select(*keys, "r", "c", "v")
        blurred = pin(gaussian_blur(part, keys, shape, float(sigma), "mirror", coarse_kernel_size(sigma)))
        top = blurred.groupBy(*keys).agg(F.max("v").alias("_top"))
        scaled = attach(blurred, top, keys).withColumn("v", F.col("v") / (F.col("_top") + 1e-8))
        if name == "sparse":
            cut = percentiles(scaled.filter("v > 0"), keys, "v", {"_p30": 0.3})
            limited = attach(scaled, cut, keys).withColumn("_cut", F.greatest("_p30", F.lit(0.02)))
            limited = attach(limited, share, keys).withColumn(
                "_cut", F.when(F.col("_share") < 0.1, F.col("_cut")).otherwise(0.1)
            )
        else:
            limited = scaled.withColumn("_cut", F.lit(0.1))
        mask = pin(close_ellipse(pixels_to_runs(limited.filter("v > _cut"), keys), keys, radius, shape, iterations=2))
        mask = fill_holes(largest_component(pin(components(mask, keys, 8)), keys), keys)
        if name != "sparse":
            hull = max(height // 20, 2 * boundary_width)
            mask = fill_holes(close_ellipse(pin(mask), keys, hull, shape), keys)
        masks.append(mask)
    if not masks:
        return pixels_to_runs(px.limit(0), keys)
    tissue = pin(union_all(*masks))
    return subtract_runs(keys, tissue, erode_ellipse(tissue, keys, boundary_width, shape))


def boundary_ring(
    px: DataFrame, keys: Sequence[str], shape: tuple[int, int], boundary_width: int = 15, boundary_smooth: float = 10.0
) -> DataFrame:
    """Softened ring scaled to a maximum of 1 (column v), with the hard ring in column ring."""
    keys = list(keys)
    hard = pin(runs_to_pixels(ring_runs(px, keys, shape, boundary_width)))
    sigma = max(float(boundary_smooth), 1.0)
    soft = pin(gaussian_blur(hard.withColumn("v", F.lit(1.0)), keys, shape, sigma, "mirror", coarse_kernel_size(sigma)))
    top = soft.groupBy(*keys).agg(F.max("v").alias("_top"))
    out = attach(soft, top, keys).withColumn("v", F.col("v") / (F.col("_top") + 1e-8)).drop("_top")
    return out.join(hard.withColumn("ring", F.lit(1)), [*keys, "r", "c"], "left").withColumn(
        "ring", F.coalesce("ring", F.lit(0))
    )
