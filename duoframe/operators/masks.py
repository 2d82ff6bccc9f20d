"""Masks as row runs and their morphology.

A mask is a table of runs: keys, r, c0, c1 (inclusive). All set operations are one
sweep along the rows, partitioned by (keys, r): a partition never holds more than
one row of one frame.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .discs import dilate_disc, erode_disc
from ..session import attach, pin, size_columns
from .components import components


def pixels_to_runs(px: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs of consecutive pixels per row."""
    w = Window.partitionBy(*keys, "r").orderBy("c")
    return (
        px.select(*keys, "r", "c", (F.col("c") - F.row_number().over(w)).alias("_g"))
        .groupBy(*keys, "r", "_g").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).drop("_g")
    )


def runs_to_pixels(runs: DataFrame) -> DataFrame:
    return runs.withColumn("c", F.explode(F.sequence("c0", "c1"))).drop("c0", "c1")


def sweep(parts: Sequence[tuple[DataFrame, Column]], keys: Sequence[str], keep: Callable[[Column], Column]) -> DataFrame:
    """Runs of the cells whose summed weight satisfies keep.

    parts are (runs, weight). Every run is a +weight event at c0 and a -weight event
    after c1; the running sum along the row is the weight of a cell.
    """
    events = None
    for runs, weight in parts:
        e = runs.select(
            *keys, "r",
            F.explode(F.array(
                F.struct(F.col("c0").cast("int").alias("c"), weight.cast("int").alias("w")),
                F.struct((F.col("c1") + 1).cast("int").alias("c"), (-weight).cast("int").alias("w")),
            )).alias("e"),
        ).select(*keys, F.col("r").cast("int").alias("r"), "e.c", "e.w")
        events = e if events is None else events.unionByName(e)
    row = Window.partitionBy(*keys, "r").orderBy("c")
    on = keep(F.sum("w").over(row.rangeBetween(Window.unboundedPreceding, 0)))
    return (
        events.withColumn("_on", on)
        .withColumn("_was", F.lag("_on", 1, False).over(row))
        .filter("_on <> _was")
        .withColumn("_next", F.lead("c").over(row))
        .filter("_on")
        .select(*keys, "r", F.col("c").alias("c0"), (F.col("_next") - 1).alias("c1"))
    )


def union_runs(keys: Sequence[str], *masks: DataFrame) -> DataFrame:
    return sweep([(m, F.lit(1)) for m in masks], keys, lambda s: s > 0)


def intersect_runs(keys: Sequence[str], a: DataFrame, b: DataFrame) -> DataFrame:
    return sweep([(a, F.lit(1)), (b, F.lit(2))], keys, lambda s: s == 3)


def subtract_runs(keys: Sequence[str], a: DataFrame, b: DataFrame) -> DataFrame:
    return sweep([(a, F.lit(1)), (b, F.lit(2))], keys, lambda s: s == 1)


def clip_runs(runs: DataFrame, keys: Sequence[str], shape) -> DataFrame:
    """Cut runs to the frame."""
    out = size_columns(runs, shape, keys).filter((F.col("r") >= 0) & (F.col("r") < F.col("height")))
    return (
        out.withColumn("c0", F.greatest("c0", F.lit(0))).withColumn("c1", F.least(F.col("c1"), F.col("width") - 1))
        .filter("c0 <= c1").select(*runs.columns)
    )


# ---- structuring elements: half-width of each row offset ---------------------------------


def diamond(n: int) -> dict[int, int]:
    """n iterations of the 4-neighbour cross."""
    return {d: n - abs(d) for d in range(-n, n + 1)}


def square(k: int) -> dict[int, int]:
    return {d: k for d in range(-k, k + 1)}


def ellipse(radius: int) -> dict[int, int]:
    """Disc inside a box of side 2*radius+1, row half-widths rounded half to even."""
    return {d: round(math.sqrt(radius * radius - d * d)) for d in range(-radius, radius + 1)}


def _offsets(profile: dict[int, int]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(h).alias("h")) for d, h in profile.items()]))


def dilate(runs: DataFrame, keys: Sequence[str], profile: dict[int, int]) -> DataFrame:
    """Union of the element placed on every mask cell; the result may pass the frame edge."""
    grown = runs.withColumn("_o", _offsets(profile)).select(
        *keys, (F.col("r") + F.col("_o.d")).alias("r"),
        (F.col("c0") - F.col("_o.h")).alias("c0"), (F.col("c1") + F.col("_o.h")).alias("c1"),
    )
    return sweep([(grown, F.lit(1))], keys, lambda s: s > 0)


def erode(
    runs: DataFrame, keys: Sequence[str], profile: dict[int, int], shape=None, outside_counts: bool = True
) -> DataFrame:
    """Cells whose whole element lies in the mask.

    With outside_counts (the usual rule) cells beyond the frame are background. Without
    it they put no constraint, as in the second half of a closing; shape is then needed.
    """
    need = len(profile)
    if outside_counts:
        src, want = runs, F.lit(need)
    else:
        src = size_columns(runs, shape, keys)
        widest = max(profile.values()) + 1
        src = src.withColumn("c0", F.when(F.col("c0") <= 0, -widest).otherwise(F.col("c0"))).withColumn(
            "c1", F.when(F.col("c1") >= F.col("width") - 1, F.col("width") + widest).otherwise(F.col("c1"))
        )
        want = F.lit(need)
    extra = [] if outside_counts else ["height"]
    shrunk = (
        src.withColumn("_o", _offsets(profile))
        .select(
            *keys, *extra, (F.col("r") - F.col("_o.d")).cast("int").alias("r"), F.lit(1).alias("_w"),
            (F.col("c0") + F.col("_o.h")).alias("c0"), (F.col("c1") - F.col("_o.h")).alias("c1"),
        )
        .filter("c0 <= c1")
    )
    if outside_counts:
        return sweep([(shrunk, F.col("_w"))], keys, lambda s: s == want)
    # near the upper and lower edge fewer rows constrain: weight the first row up
    lo, hi = min(profile), max(profile)
    shrunk = shrunk.filter((F.col("r") >= 0) & (F.col("r") < F.col("height")))
    missing = F.greatest(F.lit(0), -(F.col("r") + lo)) + F.greatest(F.lit(0), F.col("r") + hi - (F.col("height") - 1))
    free = shrunk.groupBy(*keys, "r").agg(F.max(missing).alias("_w"), F.min("c0").alias("c0"), F.max("c1").alias("c1"))
    kept = sweep([(shrunk, F.col("_w")), (free, F.col("_w"))], keys, lambda s: s == want)
    return clip_runs(kept, keys, shape)


def dilate_cross(runs: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """N dilations by the 4-neighbour cross, that is every cell within L1 distance n.

    Balls add up (radius a, then b, gives a + b), so a few growing steps merge the runs
    early and keep the number of generated runs small.
    """
    out, left, step = runs, n, 3
    while left > 0:
        k = min(step, left)
        out = dilate(out, keys, diamond(k))
        left, step = left - k, step * 4
    return out


def erode_square(runs: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """Erosion by a square of side 2k+1, cells beyond the frame are background.

    Rows are intersected in a few steps of factor 8 instead of 2k+1 copies at once.
    """
    side = 2 * k + 1
    out = runs.select(*keys, "r", (F.col("c0") + k).alias("c0"), (F.col("c1") - k).alias("c1")).filter("c0 <= c1")
    length = 1
    while length < side:
        m = min(8, -(-side // length))
        # the last step may overlap the earlier ones
        shifts = sorted({min(j * length, side - length) for j in range(m)})
        out = erode(out, keys, {s: 0 for s in shifts})
        length = min(side, shifts[-1] + length)
    return out.withColumn("r", (F.col("r") + k).cast("int"))


def close_ellipse(
    runs: DataFrame, keys: Sequence[str], radius: int, shape, iterations: int = 1
) -> DataFrame:
    """D3: dilate, then erode by the same ellipse; cells beyond the frame put no constraint."""
    out = runs
    for _ in range(iterations):
        out = dilate_disc(out, keys, radius, shape)
    for _ in range(iterations):
        out = erode_disc(out, keys, radius, shape)
    return out


def erode_ellipse(runs: DataFrame, keys: Sequence[str], radius: int, shape) -> DataFrame:
    """D3: erosion by an ellipse; cells beyond the frame put no constraint."""
    return erode_disc(runs, keys, radius, shape)


def background_runs(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Complement of the mask inside its bounding box grown by one cell."""
    box = runs.groupBy(*keys).agg(
        F.min("r").alias("_r0"), F.max("r").alias("_r1"), F.min("c0").alias("_c0"), F.max("c1").alias("_c1")
    )
    whole = box.select(
        *keys, F.explode(F.sequence(F.col("_r0") - 1, F.col("_r1") + 1)).alias("r"),
        (F.col("_c0") - 1).alias("c0"), (F.col("_c1") + 1).alias("c1"),
    )
    return subtract_runs(keys, whole, runs)


def fill_holes(runs: DataFrame, keys: Sequence[str], block_rows: int = 256) -> DataFrame:
    """Add every background region (4-connected) that is not linked to the outside."""
    runs = pin(runs)
    labelled = pin(components(background_runs(runs, keys), keys, 4, block_rows))
    # the outside holds the topmost row, so its label is the smallest of its frame
    outside = labelled.groupBy(*keys).agg(F.min("label").alias("_outside"))
    holes = attach(labelled, outside, keys).filter("label <> _outside").select(*keys, "r", "c0", "c1")
    return union_runs(keys, runs.select(*keys, "r", "c0", "c1"), holes)


def areas(labelled: DataFrame, keys: Sequence[str]) -> DataFrame:
    return labelled.groupBy(*keys, "label").agg(F.sum(F.col("c1") - F.col("c0") + 1).alias("area"))


def largest_component(labelled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs of the component with the most cells; the first label wins a tie."""
    best = areas(labelled, keys).groupBy(*keys).agg(
        F.max_by("label", F.struct(F.col("area"), -F.col("label"))).alias("_best")
    )
    return attach(labelled, best, keys).filter("label = _best").select(*keys, "r", "c0", "c1")


def tissue_mask(
    px: DataFrame, keys: Sequence[str], shape, threshold: float = 0.0, iterations: int = 50
) -> DataFrame:
    """Dilated and filled post signal meets dilated and filled pre signal (kind in px)."""
    side = [*keys, "kind"]
    grown = dilate_cross(pixels_to_runs(px.filter(F.col("v") > threshold), side), side, iterations)
    return _both_kinds(clip_runs(fill_holes(clip_runs(grown, side, shape), side), side, shape), keys)


def clean_tissue_mask(px: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Filled post signal meets filled pre signal."""
    side = [*keys, "kind"]
    return _both_kinds(fill_holes(pixels_to_runs(px.filter("v > 0"), side), side), keys)


def _both_kinds(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    w = F.when(F.col("kind") == "post", 1).otherwise(2)
    return sweep([(runs, w)], keys, lambda s: s == 3)


def mask_coverage(runs: DataFrame, keys: Sequence[str], shape) -> DataFrame:
    """Covered fraction of the frame and its verdict."""
    n = size_columns(runs, shape, keys).groupBy(*keys).agg(
        (F.sum(F.col("c1") - F.col("c0") + 1) / F.max(F.col("height").cast("bigint") * F.col("width"))).alias("coverage")
    )
    return n.withColumn("verdict", F.when(F.col("coverage") > 0.05, "OK").otherwise("LOW"))


def contour_pixels(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mask cells with a 4-neighbour outside the mask."""
    inner = erode(runs, keys, {-1: 0, 0: 1, 1: 0})
    return runs_to_pixels(subtract_runs(keys, runs, inner))


def outer_contour_of_largest(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Contour cells of the largest component, without the contours of its holes."""
    labelled = pin(components(runs, keys, 8))
    return contour_pixels(fill_holes(largest_component(labelled, keys), keys), keys)
