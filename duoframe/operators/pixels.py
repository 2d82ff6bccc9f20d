"""Pixel-wise operators on pixel tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import attach, pin, running_total, size_columns
from .percentiles import percentiles


def pair_pixels(px: DataFrame, keys: Sequence[str], pre_value: str = "v") -> DataFrame:
    """M7: post and pre value of each pixel, 0 where one side has no row.

    One aggregation replaces the full outer join of two pixel tables.
    """
    side = lambda k: F.coalesce(F.max(F.when(F.col("kind") == k, F.col(pre_value))), F.lit(0.0))
    return px.filter(F.col("kind").isin("post", "pre")).groupBy(*keys, "r", "c").agg(
        side("post").alias("post"), side("pre").alias("pre")
    )


def sparse_percentile(
    px: DataFrame, keys: Sequence[str], value: str, p: float, cells: str, name: str, levels: int | None = None
) -> DataFrame:
    """Percentile over all cells of a region where only the positive cells are stored.

    Absent cells are zeros, so the rank is moved into the stored values and the
    exact order statistics come from the value counts.
    """
    vals = px.filter(F.col(value) != 0).groupBy(*keys, cells, value).agg(F.count("*").alias("_c"))
    vals = pin(vals)
    zeros = vals.groupBy(*keys).agg(F.max(cells).alias("_n"), F.sum("_c").alias("_s")).select(
        *keys, F.col("_n").alias(cells), F.lit(0.0).alias(value), (F.col("_n") - F.col("_s")).alias("_c")
    )
    counts = vals.unionByName(zeros)
    k = F.lit(float(p)) * (F.col(cells) - 1)
    a = F.min(F.when(F.col("_cum") > F.floor("_k"), F.col(value)))
    z = F.min(F.when(F.col("_cum") > F.ceil("_k"), F.col(value)))
    return (
        running_total(counts, keys, [value], "_c", "_cum")
        .withColumn("_k", k)
        .groupBy(*keys)
        .agg((a + (z - a) * F.max(F.col("_k") - F.floor("_k"))).alias(name))
    )


def subtract_region_median(
    px: DataFrame, keys: Sequence[str], shape, region: tuple[int, int, int, int] = (0, 5000, 0, 5000)
) -> DataFrame:
    """B1: subtract the median of region (r0, r1, c0, c1); absent cells count as 0.

    The result lists the stored pixels; an absent cell holds -median, which the
    returned background column gives.
    """
    r0, r1, c0, c1 = region
    sized = size_columns(px, shape, keys)
    cells = (F.least(F.lit(r1), "height") - r0) * (F.least(F.lit(c1), "width") - c0)
    box = sized.withColumn("_cells", cells.cast("bigint")).filter(
        (F.col("r") >= r0) & (F.col("r") < r1) & (F.col("c") >= c0) & (F.col("c") < c1)
    )
    med = sparse_percentile(box, keys, "v", 0.5, "_cells", "background")
    return attach(px, med, keys).withColumn("background", F.coalesce("background", F.lit(0.0))).withColumn(
        "v", F.col("v") - F.col("background")
    )


def normalize(px: DataFrame, keys: Sequence[str], p: float | None = None, levels: int | None = None) -> DataFrame:
    """B2: divide by the frame maximum, or by its percentile p (0..1) over the stored pixels."""
    if p is None:
        ref = px.groupBy(*keys).agg(F.max("v").alias("_ref"))
    else:
        ref = percentiles(px, keys, "v", {"_ref": p}, levels)
    # a frame whose reference is 0 has nothing to scale: its values become null
    return attach(px, ref, keys).withColumn("v", F.try_divide("v", "_ref")).drop("_ref")


def pad_to_common_canvas(frames: DataFrame, pair_keys: Sequence[str], pad: int = 2000) -> DataFrame:
    """New frame sizes on a common canvas; only metadata moves, no pixel is written."""
    canvas = frames.groupBy(*pair_keys).agg(
        (F.max("height") + 2 * pad).alias("canvas_h"), (F.max("width") + 2 * pad).alias("canvas_w")
    )
    return frames.join(canvas, list(pair_keys)).select(
        *[k for k in frames.columns if k not in ("height", "width", "origin_r", "origin_c")],
        F.col("canvas_h").alias("height"),
        F.col("canvas_w").alias("width"),
        F.lit(pad).alias("origin_r"),
        F.lit(pad).alias("origin_c"),
    )


def shift_pixels(px: DataFrame, dr: Column | int, dc: Column | int) -> DataFrame:
    """Move stored pixels by a whole number of rows and columns."""
    return px.withColumn("r", (F.col("r") + dr).cast("int")).withColumn("c", (F.col("c") + dc).cast("int"))


def signal_box(px: DataFrame, keys: Sequence[str], threshold: float = 0.0) -> DataFrame:
    """Half-open bounding box of the pixels above threshold, per group."""
    return px.filter(F.col("v") > threshold).groupBy(*keys).agg(
        F.min("r").alias("r0"), (F.max("r") + 1).alias("r1"), F.min("c").alias("c0"), (F.max("c") + 1).alias("c1")
    )


def trim_to_signal(px: DataFrame, keys: Sequence[str], threshold: float = 0.0) -> DataFrame:
    """Cut both frames of a pair to the joint signal box; a pair without signal stays as it is."""
    box = signal_box(px, keys, threshold)
    inside = F.col("r0").isNull() | (
        (F.col("r") >= F.col("r0")) & (F.col("r") < F.col("r1")) & (F.col("c") >= F.col("c0")) & (F.col("c") < F.col("c1"))
    )
    out = attach(px, box, keys).filter(inside)
    return shift_pixels(
        out, -F.coalesce("r0", F.lit(0)), -F.coalesce("c0", F.lit(0))
    ).select(*px.columns)


def blur_sigma_by_density(
    px: DataFrame, keys: Sequence[str], shape, sparse_threshold: float = 0.1,
    sparse_sigma: float = 5.0, dense_sigma: float = 0.0,
) -> DataFrame:
    """Blur sigma per frame from the fraction of positive pixels."""
    agg = size_columns(px, shape, keys).groupBy(*keys).agg(
        (F.count_if(F.col("v") > 0) / F.max(F.col("height").cast("bigint") * F.col("width"))).alias("fraction")
    )
    return agg.withColumn(
        "sigma", F.when(F.col("fraction") < sparse_threshold, float(sparse_sigma)).otherwise(float(dense_sigma))
    )


def robust_display_max(px: DataFrame, keys: Sequence[str], n_mad: float = 5.0, levels: int | None = None) -> DataFrame:
    """Median + n_mad * MAD over the positive pixels, 1.0 for a frame without any."""
    pos = px.filter("v > 0")
    med = pin(percentiles(pos, keys, "v", {"med": 0.5}, levels))
    dev = pos.join(med, list(keys)).withColumn("dev", F.abs(F.col("v") - F.col("med")))
    # |v - med| takes at most as many values as v does
    mad = percentiles(dev, keys, "dev", {"mad": 0.5}, levels)
    return (
        px.select(*keys).distinct()
        .join(med, list(keys), "left").join(mad, list(keys), "left")
        .select(*keys, F.coalesce(F.col("med") + n_mad * F.col("mad"), F.lit(1.0)).alias("vmax"))
    )


def stretch_to_8bit(
    px: DataFrame, keys: Sequence[str], low: float | None = 0.01, high: float = 0.99, levels: int | None = None
) -> DataFrame:
    """B7 (low=0.01) and the scaling of B8 (low=None): percentile stretch of v to 0..255."""
    ps = {"_hi": high} if low is None else {"_lo": low, "_hi": high}
    lim = percentiles(px.filter("v > 0"), keys, "v", ps, levels)
    if low is None:
        lim = lim.withColumn("_lo", F.lit(0.0))
    lim = lim.withColumn("_hi", F.when(F.col("_hi") <= F.col("_lo"), F.col("_lo") + 1.0).otherwise(F.col("_hi")))
    scaled = (F.col("v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 255.0
    return attach(px, lim, keys).withColumn(
        "v8", F.coalesce(F.floor(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(255.0))).cast("int"), F.lit(0))
    ).drop("_lo", "_hi")


def rgb_overlay(
    px: DataFrame, keys: Sequence[str], edges: DataFrame | None = None, levels: int | None = None
) -> DataFrame:
    """red = post, green = pre, each scaled by its p99; edge pixels override the colour.

    edges has keys, r, c and kind: a post edge is drawn in cyan, a pre edge in magenta.
    """
    scaled = stretch_to_8bit(px, [*keys, "kind"], None, 0.99, levels)
    rows = scaled.select(*keys, "r", "c", "kind", "v8", F.lit(0).alias("edge"))
    if edges is not None:
        rows = rows.unionByName(edges.select(*keys, "r", "c", "kind", F.lit(0).alias("v8"), F.lit(1).alias("edge")))
    of = lambda kind, col: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col(col))), F.lit(0))
    g = rows.groupBy(*keys, "r", "c").agg(
        of("post", "v8").alias("_post"), of("pre", "v8").alias("_pre"),
        of("post", "edge").alias("_pe"), of("pre", "edge").alias("_qe"),
    )
    on_pre, on_post = F.col("_qe") == 1, F.col("_pe") == 1
    return g.select(
        *keys, "r", "c",
        F.when(on_pre, 255).when(on_post, 0).otherwise(F.col("_post")).alias("red"),
        F.when(on_pre, 0).when(on_post, 255).otherwise(F.col("_pre")).alias("green"),
        F.when(on_pre | on_post, 255).otherwise(0).alias("blue"),
    )


def log_stretch(v: Column) -> Column:
    """log10(v + 1)."""
    return F.log10(v + 1.0)


def signed_log(d: Column) -> Column:
    """sign(d) * log10(|d| + 1)."""
    return F.signum(d) * F.log10(F.abs(d) + 1.0)


def asinh_stretch(d: Column, knee: Column) -> Column:
    """asinh(d / knee)."""
    return F.asinh(d / knee)


def display_stretches(
    diff: DataFrame, keys: Sequence[str], p_knee: float = 0.5, knee_floor: float = 1.0, levels: int | None = None
) -> DataFrame:
    """Signed log, asinh and z-score of column d; the statistics are per group."""
    knee = percentiles(diff, keys, F.abs(F.col("d")), {"knee": p_knee}, levels)
    stats = diff.groupBy(*keys).agg(F.avg("d").alias("mu"), F.stddev_pop("d").alias("sd"))
    limits = stats.join(knee, list(keys)).withColumn("knee", F.greatest("knee", F.lit(float(knee_floor))))
    d = F.col("d")
    return attach(diff, limits, keys).select(
        *diff.columns,
        signed_log(d).alias("signed_log"),
        asinh_stretch(d, F.col("knee")).alias("asinh"),
        ((d - F.col("mu")) / F.greatest("sd", F.lit(1e-8))).alias("z"),
    )


def residual(post: Column, pre: Column, scale: Column | float) -> Column:
    """Post - scale * pre."""
    return post - scale * pre


def binary_mask(v: Column) -> Column:
    """1 where v > 0, NULL elsewhere."""
    return F.when(v > 0, 1.0)


def display_limits(
    diff: DataFrame, keys: Sequence[str], ps: Mapping[str, float] | None = None, levels: int | None = None
) -> DataFrame:
    """Symmetric display limits p90, p95 and p99 of |d|."""
    ps = ps or {"lim90": 0.90, "lim95": 0.95, "lim99": 0.99}
    return percentiles(diff, keys, F.abs(F.col("d")), ps, levels)


def value_limits(px: DataFrame, keys: Sequence[str], levels: int | None = None) -> DataFrame:
    """p10/p90 and p1/p99 of the values, and the robust limits -0.05*vmax..vmax."""
    q = percentiles(px, keys, "v", {"p01": 0.01, "p10": 0.10, "p90": 0.90, "p99": 0.99}, levels)
    top = robust_display_max(px, keys, levels=levels)
    return q.join(top, list(keys)).withColumn("vmin", -0.05 * F.col("vmax"))


def legacy_column_limit(px: DataFrame, keys: Sequence[str], value: Column, levels: int | None = None) -> DataFrame:
    """max(median + 2*MAD, p50) of one panel column."""
    vals = px.select(*keys, value.alias("_x"))
    med = pin(percentiles(vals, keys, "_x", {"med": 0.5}, levels))
    mad = percentiles(
        vals.join(med, list(keys)).withColumn("_x", F.abs(F.col("_x") - F.col("med"))), keys, "_x", {"mad": 0.5}, levels
    )
    return med.join(mad, list(keys)).select(*keys, F.greatest(F.col("med") + 2 * F.col("mad"), "med").alias("limit"))


def crop(px: DataFrame, keys: Sequence[str], shape, row: int, col: int, size: int) -> DataFrame:
    """Square crop whose corner is clamped into the frame, at least one pixel large.

    Crop several images at the same box by passing several kinds. Blur afterwards
    with filters.gaussian_blur, whose reflection then happens at the crop edge.
    """
    sized = size_columns(px, shape, keys)
    r0 = F.least(F.greatest(F.lit(row), F.lit(0)), F.col("height") - 1)
    c0 = F.least(F.greatest(F.lit(col), F.lit(0)), F.col("width") - 1)
    r1 = F.least(r0 + max(size, 1), F.col("height"))
    c1 = F.least(c0 + max(size, 1), F.col("width"))
    inside = (F.col("r") >= r0) & (F.col("r") < r1) & (F.col("c") >= c0) & (F.col("c") < c1)
    # constant bounds as well, so that the scan can prune row groups
    near = (F.col("r") < max(row, 0) + max(size, 1)) & (F.col("c") < max(col, 0) + max(size, 1))
    return sized.filter(near & inside).withColumn("r", F.col("r") - r0).withColumn("c", F.col("c") - c0).select(*px.columns)


def preview_stride(frames: DataFrame, target: int) -> Column:
    """Stride so that the longer side shrinks to about target pixels."""
    return F.greatest(F.lit(1), F.ceil(F.greatest("height", "width") / target).cast("int"))


def strided_preview(px: DataFrame, keys: Sequence[str], shape, target: int) -> DataFrame:
    """Every stride-th row and column."""
    sized = size_columns(px, shape, keys)
    s = preview_stride(sized, target)
    return sized.withColumn("_s", s).filter((F.col("r") % F.col("_s") == 0) & (F.col("c") % F.col("_s") == 0)).select(
        *[k for k in px.columns if k not in ("r", "c", "v")],
        (F.col("r") / F.col("_s")).cast("int").alias("r"), (F.col("c") / F.col("_s")).cast("int").alias("c"), "v",
    )


def masked_composite(px: DataFrame, keys: Sequence[str], first: str, second: str, by: str = "kind") -> DataFrame:
    """Add the second image where the first has signal; the sum wraps at 256 like 8-bit values."""
    of = lambda k: F.coalesce(F.max(F.when(F.col(by) == k, F.col("v"))), F.lit(0.0))
    pair = px.groupBy(*keys, "r", "c").agg(of(first).alias("_a"), of(second).alias("_b"))
    return pair.filter("_a <> 0").select(
        *keys, "r", "c", ((F.col("_a") + F.col("_b")).cast("int") % 256).alias("v")
    )


# Luminance weights of the usual gray conversion.
LUMINANCE = {"R": 0.299, "G": 0.587, "B": 0.114}


def luminance_gray(px_rgb: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weighted sum of the channels of each pixel, rounded."""
    weight = F.lit(0.0)
    for ch, w in LUMINANCE.items():
        weight = F.when(F.col("ch") == ch, w).otherwise(weight)
    return px_rgb.groupBy(*keys, "r", "c").agg(F.round(F.sum(F.col("v") * weight), 0).cast("int").alias("v"))
