"""Diagnostics as tables over paired pixels."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import let
from ..session import attach, pin, running_total, size_columns, union_all
from .filters import area_downsample, densest_window, downsampled_shape
from .histograms import bin_counts, explode_bins, uniform_bin
from .percentiles import percentiles
from .pixels import asinh_stretch, preview_stride, signed_log
from .scale import log_ratio, moffat_scale, ratio_histogram, initial_peak, mirrored_wing

# Diagnostics a user may add: name -> function of the pair table and its keys.
REGISTRY: dict[str, Callable[[DataFrame, Sequence[str]], DataFrame]] = {}


def diagnostic(name: str):
    """Register a function (pairs, keys) -> DataFrame under name."""

    def wrap(fn):
        REGISTRY[name] = fn
        return fn

    return wrap


def level(v: Column) -> Column:
    """Nearest whole number (halves to even) within 0..255."""
    return F.least(F.greatest(F.rint(v), F.lit(0.0)), F.lit(255.0)).cast("int")


def _with_zero_pairs(counts: DataFrame, keys: list[str], shape, zero: dict[str, int]) -> DataFrame:
    """Add the cells that are stored on neither side to the group of all-zero values."""
    rest = size_columns(counts.groupBy(*keys).agg(F.sum("n").alias("_s")), shape, keys).select(
        *keys, *[F.lit(v).cast(counts.schema[k].dataType).alias(k) for k, v in zero.items()],
        (F.col("height").cast("bigint") * F.col("width") - F.col("_s")).alias("n"),
    )
    return counts.unionByName(rest).groupBy(*keys, *zero).agg(F.sum("n").alias("n")).filter("n > 0")


def density_grid(pairs: DataFrame, keys: Sequence[str], shape) -> DataFrame:
    """H1: number of cells per (pre, post) level pair, all cells of the frame counted."""
    counts = pairs.groupBy(*keys, level(F.col("pre")).alias("pre_level"), level(F.col("post")).alias("post_level")).agg(
        F.count("*").alias("n")
    )
    full = _with_zero_pairs(counts, list(keys), shape, {"pre_level": 0, "post_level": 0})
    return full.withColumn("log_n", F.log10(F.col("n").cast("double")))


def density_limits(grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """H1: colour range of the grid without the (0, 0) cell."""
    return grid.filter("pre_level <> 0 or post_level <> 0").groupBy(*keys).agg(
        F.min("log_n").alias("lo"), F.max("log_n").alias("hi")
    )


def nearest_value(x: Column, values: Column) -> Column:
    """Entry of the sorted array nearest to x, the upper one on a tie."""
    above = F.coalesce(F.array_min(F.filter(values, lambda v: v >= x)), F.array_max(values))

    def pick(up: Column) -> Column:
        below = F.coalesce(F.array_max(F.filter(values, lambda v: v < up)), up)
        return let(below, lambda low: F.when(F.abs(x - low) < F.abs(x - up), low).otherwise(up))

    return let(above, pick)


def excess_grid(pairs: DataFrame, keys: Sequence[str], shape) -> DataFrame:
    """H2: surplus of (pre = a, post = b) cells over (pre = b, post = a) cells for b > a, where positive.

    Pre levels are moved to the nearest level that occurs in post. Both cells of a mirrored
    pair meet in one aggregation on (smaller, larger), so there is no self join.
    """
    keys = list(keys)
    grid = pin(density_grid(pairs, keys, shape).drop("log_n"))
    values = grid.groupBy(*keys).agg(F.array_sort(F.collect_set("post_level")).alias("_vals"))
    # at most 256 levels per group: look each one up once
    lookup = pin(
        grid.select(*keys, "pre_level").distinct().join(pin(values), keys)
        .select(*keys, "pre_level", nearest_value(F.col("pre_level"), F.col("_vals")).alias("_p"))
    )
    snapped = grid.join(lookup, [*keys, "pre_level"])
    sign = F.when(F.col("_p") < F.col("post_level"), F.col("n")).otherwise(-F.col("n"))
    return (
        snapped.filter(F.col("_p") != F.col("post_level"))
        .groupBy(*keys, F.least("_p", "post_level").alias("pre_value"), F.greatest("_p", "post_level").alias("post_value"))
        .agg(F.sum(sign).alias("excess")).filter("excess > 0")
        .withColumn("log_excess", F.log10(F.col("excess").cast("double")))
    )


def brightness_histograms(pairs: DataFrame, keys: Sequence[str], levels: int | None = None) -> DataFrame:
    """H3: keys, series (post, pre, and warped if a raw_pre column exists), value, n, dense, log_axis.

    One bin per whole number if at least 30 % of them occur up to the p99.9 cap, else one
    bin per occurring value. log_axis is set if a zero bin exceeds five times any other.
    """
    keys, raw = list(keys), "raw_pre" in pairs.columns
    region = (F.col("post") > 0) | (F.col("pre") > 0)
    if raw:
        region = region | (F.col("raw_pre") > 0)
    series = [("post", "post"), ("pre", "raw_pre" if raw else "pre")] + ([("warped", "pre")] if raw else [])
    long = pairs.filter(region).select(*keys, F.explode(F.array(*[
        F.struct(F.lit(s).alias("series"), F.col(c).cast("double").alias("v")) for s, c in series
    ])).alias("s")).select(*keys, "s.series", "s.v")
    front = F.col("series") != "warped"
    cap = percentiles(long.filter(front), keys, "v", {"cap": 0.999}, levels).withColumn(
        "cap", F.greatest(F.lit(1), F.ceil("cap")).cast("int")
    )
    cap = pin(cap)
    occurring = (
        long.filter(front).join(cap, keys).filter(F.col("v") <= F.col("cap"))
        .groupBy(*keys, F.rint("v").cast("int").alias("_i")).agg(F.max("cap").alias("cap"))
        .filter("_i >= 0").groupBy(*keys)
        .agg(F.max("cap").alias("cap"), F.array_sort(F.collect_set("_i")).alias("_vals"))
    )
    plan = pin(occurring.withColumn("dense", F.size("_vals") >= 0.30 * (F.col("cap") + 1)))
    v, mids = F.col("v"), F.floor(F.col("v") + 0.5).cast("int")
    top = F.element_at("_vals", -1)
    binned = long.join(plan, keys).withColumn(
        "value",
        F.when(F.col("dense"), F.when((v >= -0.5) & (v <= F.col("cap") + 0.5), F.least("cap", mids)))
        .when((v >= F.col("_vals")[0] - 0.5) & (v <= top + 0.5), nearest_value(v, F.col("_vals"))),
    ).filter("value is not null")
    counts = binned.groupBy(*keys, "series", "value").agg(F.count("*").alias("n"), F.first("dense").alias("dense"))
    zero = F.coalesce(F.max(F.when(F.col("value") == 0, F.col("n"))), F.lit(0))
    others = F.coalesce(F.max(F.when(F.col("value") != 0, F.col("n"))), F.lit(0))
    per_series = counts.filter(front).groupBy(*keys, "series").agg(((others > 0) & (zero > 5 * others)).alias("_log"))
    flag = per_series.groupBy(*keys).agg(F.max("_log").alias("log_axis"))
    return counts.join(flag, keys)


def difference_histogram(pairs: DataFrame, keys: Sequence[str], shape) -> DataFrame:
    """H4: counts of rint(post - pre) over all cells, cells with both signals, cells with post only."""
    keys = list(keys)
    both, only = (F.col("post") > 0) & (F.col("pre") > 0), (F.col("post") > 0) & (F.col("pre") <= 0)
    part = pairs.groupBy(*keys, F.rint(F.col("post") - F.col("pre")).cast("int").alias("d")).agg(
        F.count("*").alias("n"), F.count_if(both).alias("n_both"), F.count_if(only).alias("n_post_only")
    )
    rest = size_columns(part.groupBy(*keys).agg(F.sum("n").alias("_s")), shape, keys).select(
        *keys, F.lit(0).alias("d"), (F.col("height").cast("bigint") * F.col("width") - F.col("_s")).alias("n"),
        F.lit(0).cast("bigint").alias("n_both"), F.lit(0).cast("bigint").alias("n_post_only"),
    )
    return part.unionByName(rest).groupBy(*keys, "d").agg(
        F.sum("n").alias("n"), F.sum("n_both").alias("n_both"), F.sum("n_post_only").alias("n_post_only")
    ).filter("n > 0")


def ratio_report(pairs: DataFrame, keys: Sequence[str], points: int = 500) -> DataFrame:
    """H5: rows of three kinds: histogram bins, fit points, and the fitted curve."""
    keys = list(keys)
    hist = ratio_histogram(pairs, keys)
    peaked = initial_peak(hist)
    from .histograms import bin_centers

    bars = hist.select(*keys, F.explode(F.arrays_zip(bin_centers().alias("x"), F.col("counts").alias("y"))).alias("z"))
    wing = mirrored_wing(peaked).select(*keys, F.explode("wing").alias("z"))
    fit = moffat_scale(pairs, keys).filter("fitted")
    x = F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / (points - 1)
    curve = fit.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", x)
    y = F.col("amp") * F.pow(1 + F.pow((F.col("x") - F.col("mu")) / F.col("alpha"), 2), -F.col("beta"))
    rows = lambda df, kind: df.select(*keys, F.lit(kind).alias("kind"), F.col("z.x").alias("x"), F.col("z.y").cast("double").alias("y"))
    return union_all(rows(bars, "histogram"), rows(wing, "fit_point"), curve.select(*keys, F.lit("curve").alias("kind"), "x", y.alias("y")))


def difference_display(pairs: DataFrame, keys: Sequence[str], scale: Column | float, levels: int | None = None) -> DataFrame:
    """H6: asinh-stretched difference over the tissue with its knee and symmetric limit."""
    s = scale if isinstance(scale, Column) else F.lit(float(scale))
    d = pairs.filter("post > 0 or pre > 0").withColumn("d", F.col("post") - s * F.col("pre"))
    # |asinh(d / knee)| keeps the order of |d|: its percentile needs the knee first
    knee = pin(percentiles(d, keys, F.abs(F.col("d")), {"knee": 0.5}, levels).withColumn("knee", F.greatest("knee", F.lit(1.0))))
    shown = d.join(knee, list(keys)).withColumn("display", asinh_stretch(F.col("d"), F.col("knee")))
    lim = percentiles(shown, keys, F.abs(F.col("display")), {"limit": 0.95}, levels)
    return attach(shown, lim, keys)


def residual_histogram(pairs: DataFrame, keys: Sequence[str], scales: DataFrame, n_bins: int = 100) -> DataFrame:
    """H7: four residual series on one axis p0.5..p99.5.

    pairs holds the tissue cells with in_fit (cells of the least-squares fit); scales has
    ls_scale and opt_scale. Series: both methods over all cells and over their own cells.
    """
    keys = list(keys)
    base = attach(pairs, scales.select(*keys, "ls_scale", "opt_scale"), keys, "inner")
    d = lambda s: F.col("post") - F.col(s) * F.col("pre")
    low = (F.col("pre") > 0) & (F.col("post") / F.col("pre") <= F.col("opt_scale"))
    series = F.array(
        F.struct(F.lit("ls_all").alias("series"), d("ls_scale").alias("d"), F.lit(True).alias("use")),
        F.struct(F.lit("robust_all").alias("series"), d("opt_scale").alias("d"), F.lit(True).alias("use")),
        F.struct(F.lit("ls_fit").alias("series"), d("ls_scale").alias("d"), F.col("in_fit").alias("use")),
        F.struct(F.lit("robust_fit").alias("series"), d("opt_scale").alias("d"), low.alias("use")),
    )
    long = base.select(*keys, F.explode(F.filter(series, lambda s: s["use"])).alias("s")).select(*keys, "s.series", "s.d")
    all_cells = long.filter(F.col("series").isin("ls_all", "robust_all"))
    lim = pin(percentiles(all_cells, keys, "d", {"lo": 0.005, "hi": 0.995}))
    counts = bin_counts(long.join(lim.drop("lo", "hi"), keys), [*keys, "series"], "d", n_bins, _per_series(lim, keys))
    return explode_bins(counts, [*keys, "series"])


def _per_series(lim: DataFrame, keys: list[str]) -> DataFrame:
    names = F.explode(F.array(*[F.lit(s) for s in ("ls_all", "robust_all", "ls_fit", "robust_fit")]))
    return lim.select(*keys, names.alias("series"), "lo", "hi")


def top_rows(df: DataFrame, keys: Sequence[str], n: int, value: str = "post") -> DataFrame:
    """The n rows of each group with the largest value; ties go to the first (r, c).

    The cut is found from counts: first the value, then the row within the tied value,
    then the column within the tied row. No group is sorted whole.
    """
    out = None
    rest, left = df, None  # rows still undecided, and how many of them to take
    for step, (col, down) in enumerate([(value, True), ("r", False), ("c", False)]):
        order = F.col(col).desc() if down else F.col(col).asc()
        counts = rest.groupBy(*keys, col).agg(F.count("*").alias("_n"))
        run = running_total(counts, keys, [order], "_n", "_cum")
        want = F.lit(n) if left is None else F.col("_want")
        run = run if left is None else run.join(left, list(keys))
        cut = pin(
            run.filter((F.col("_cum") >= want) & (F.col("_cum") - F.col("_n") < want))
            .select(*keys, F.col(col).alias("_cut"), (want - (F.col("_cum") - F.col("_n"))).alias("_want"))
        )
        marked = rest.join(cut, list(keys), "left")
        before = F.col(col) > F.col("_cut") if down else F.col(col) < F.col("_cut")
        whole = marked.filter(F.col("_cut").isNull() | before).select(*df.columns)
        out = whole if out is None else out.unionByName(whole)
        rest = marked.filter(F.col(col) == F.col("_cut")).select(*df.columns)
        left = cut.select(*keys, "_want")
    # (r, c) is unique, so the last cut value is taken itself
    return out.unionByName(rest)


def density_scatter(pairs: DataFrame, keys: Sequence[str], n_points: int = 100_000, n_bins: int = 200) -> DataFrame:
    """H8: the brightest n_points cells with the relative density of their log-log cell."""
    keys = list(keys)
    pts = pin(top_rows(pairs.filter("post > 0 and pre > 0"), keys, n_points)).withColumn("log_post", F.log10("post")).withColumn(
        "log_pre", F.log10("pre")
    )
    span = pts.groupBy(*keys).agg(
        F.min("log_pre").alias("_x0"), F.max("log_pre").alias("_x1"), F.min("log_post").alias("_y0"), F.max("log_post").alias("_y1")
    )
    cells = attach(pts, span, keys).withColumn("_bx", uniform_bin(F.col("log_pre"), F.col("_x0"), F.col("_x1"), n_bins)).withColumn(
        "_by", uniform_bin(F.col("log_post"), F.col("_y0"), F.col("_y1"), n_bins)
    )
    counts = pin(cells.groupBy(*keys, "_bx", "_by").agg(F.count("*").alias("_n")))
    top = counts.groupBy(*keys).agg(F.max("_n").alias("_top"))
    dens = counts.join(top, keys).select(*keys, "_bx", "_by", (F.col("_n") / F.col("_top")).alias("density"))
    return cells.join(dens, [*keys, "_bx", "_by"]).select(*keys, "r", "c", "log_pre", "log_post", "density")


def ratio_markers(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """H9: ratio percentiles 10, 25, 50, 75 and 90."""
    ps = {f"p{p}": p / 100.0 for p in (10, 25, 50, 75, 90)}
    return percentiles(pairs.filter("post > 0 and pre > 0"), keys, F.col("post") / F.col("pre"), ps)


def difference_panels(pairs: DataFrame, keys: Sequence[str], scales: DataFrame, p: float = 0.99) -> DataFrame:
    """Least-squares and robust difference side by side where post has signal, with symmetric limits."""
    keys = list(keys)
    both = attach(pairs.filter("post > 0"), scales.select(*keys, "ls_scale", "opt_scale"), keys, "inner").select(
        *keys, "r", "c", F.explode(F.array(
            F.struct(F.lit("ls").alias("panel"), (F.col("post") - F.col("ls_scale") * F.col("pre")).alias("d")),
            F.struct(F.lit("robust").alias("panel"), (F.col("post") - F.col("opt_scale") * F.col("pre")).alias("d")),
        )).alias("x"),
    ).select(*keys, "r", "c", "x.panel", "x.d")
    lim = percentiles(both, [*keys, "panel"], F.abs(F.col("d")), {"limit": p})
    return attach(both, lim, [*keys, "panel"])


def stretch_panels(pairs: DataFrame, keys: Sequence[str], scales: DataFrame) -> DataFrame:
    """Asinh, signed log and global z of both differences, long form (panel, stretch, value).

    The fourth stretch, the local z-score, is filters.local_zscore on the same rows.
    """
    d = difference_panels(pairs, keys, scales).drop("limit")
    side = [*keys, "panel"]
    knee = percentiles(d, side, F.abs(F.col("d")), {"_knee": 0.10})
    stats = d.groupBy(*side).agg(F.avg("d").alias("_mu"), F.stddev_pop("d").alias("_sd"))
    x = attach(d, knee.join(stats, side), side)
    col = F.col("d")
    return x.select(*side, "r", "c", F.explode(F.array(
        F.struct(F.lit("asinh").alias("stretch"), F.asinh(col / F.greatest("_knee", F.lit(0.5))).alias("value")),
        F.struct(F.lit("signed_log").alias("stretch"), signed_log(col).alias("value")),
        F.struct(F.lit("zscore").alias("stretch"), ((col - F.col("_mu")) / F.greatest("_sd", F.lit(1e-8))).alias("value")),
    )).alias("s")).select(*side, "r", "c", "s.stretch", "s.value")


def zoom_at_densest(
    pairs: DataFrame, keys: Sequence[str], shape, scales: DataFrame, size: int = 300, signal: Column | None = None
) -> DataFrame:
    """Both differences in the size x size window with the most signal cells."""
    keys = list(keys)
    box = densest_window(pairs.filter(F.col("post") > 0 if signal is None else signal), keys, shape, size)
    inside = (
        (F.col("r") >= F.col("r0")) & (F.col("r") < F.col("r0") + size) & (F.col("c") >= F.col("c0")) & (F.col("c") < F.col("c0") + size)
    )
    z = attach(attach(pairs, box, keys, "inner").filter(inside), scales.select(*keys, "ls_scale", "opt_scale"), keys, "inner")
    return z.select(
        *keys, (F.col("r") - F.col("r0")).alias("r"), (F.col("c") - F.col("c0")).alias("c"), "post", "pre",
        (F.col("post") - F.col("ls_scale") * F.col("pre")).alias("d_ls"),
        (F.col("post") - F.col("opt_scale") * F.col("pre")).alias("d_robust"),
    )


def registration_check(px: DataFrame, keys: Sequence[str], shape: tuple[int, int], factor: float) -> DataFrame:
    """Post - pre on the coarse grid with the limit p95 of the non-zero |d|."""
    from .pixels import pair_pixels

    keys = list(keys)
    coarse = area_downsample(px, [*keys, "kind"], shape, factor)
    d = pin(pair_pixels(coarse, keys).withColumn("d", F.col("post") - F.col("pre")).filter("d <> 0"))
    return attach(d, percentiles(d, keys, F.abs(F.col("d")), {"limit": 0.95}), keys)


def ring_overlay(rings: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Ring cells before and after, tagged by step."""
    return union_all(*[df.select(*keys, "r", "c", F.lit(step).alias("step")) for step, df in rings.items()])


def blink_pair(px: DataFrame, keys: Sequence[str], frames: DataFrame, target: int) -> DataFrame:
    """Both kinds on one preview grid, whose stride is the coarser of the two; frames has kind."""
    keys = list(keys)
    step = frames.groupBy(*keys).agg(F.max(preview_stride(frames, target)).alias("_s"))
    on = attach(px, step, keys, "inner").filter((F.col("r") % F.col("_s") == 0) & (F.col("c") % F.col("_s") == 0))
    of = lambda k: F.coalesce(F.max(F.when(F.col("kind") == k, F.col("v"))), F.lit(0.0))
    return on.groupBy(*keys, (F.col("r") / F.col("_s")).cast("int").alias("r"), (F.col("c") / F.col("_s")).cast("int").alias("c")).agg(
        of("post").alias("a"), of("pre").alias("b")
    )
