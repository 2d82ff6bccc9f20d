"""Background scale of post against pre, and its subtraction."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fits import fit_gauss, fit_moffat
from ..functions.text import general_format
from ..session import attach, pin, union_all
from .histograms import bin_centers, bin_counts, box_smooth
from .percentiles import percentiles


def overlap(pairs: DataFrame) -> DataFrame:
    """Rows with signal on both sides."""
    return pairs.filter("post > 0 and pre > 0")


def log_ratio(pairs: DataFrame) -> DataFrame:
    """G1: column x = log10(post / pre) of the overlapping rows."""
    return overlap(pairs).withColumn("x", F.log10(F.col("post") / F.col("pre")))


def percentile_scale(pairs: DataFrame, keys: Sequence[str], p: float) -> DataFrame:
    """10 ** percentile of the log ratio, p in 0..100; NULL for a pair without overlap."""
    q = percentiles(log_ratio(pairs), keys, "x", {"_q": p / 100.0})
    groups = pairs.select(*keys).distinct()
    return groups.join(q, list(keys), "left").select(*keys, F.pow(F.lit(10.0), "_q").alias("scale"))


def ratio_histogram(pairs: DataFrame, keys: Sequence[str], n_bins: int = 200, half: int = 3) -> DataFrame:
    """Keys, lo, hi, counts, smooth: the log-ratio histogram of each pair as two short arrays."""
    hist = bin_counts(log_ratio(pairs).select(*keys, "x"), keys, "x", n_bins)
    # written once: one short row per pair, read by every later step
    return pin(pin(hist).withColumn("smooth", box_smooth("counts", half)))


def _near_one(x: Column) -> Column:
    """Within three bins of ratio 1."""
    return F.abs(x) <= 3 * (F.col("hi") - F.col("lo")) / F.size("counts")


def initial_peak(hist: DataFrame) -> DataFrame:
    """Adds peak_bin and peak, the first maximum of the smoothed counts away from ratio 1."""
    masked = F.transform(
        F.arrays_zip(F.col("smooth").alias("s"), bin_centers().alias("x")),
        lambda z, i: F.struct(F.when(_near_one(z["x"]), 0.0).otherwise(z["s"]).alias("s"), (-i).alias("i")),
    )
    top = pin(hist.withColumn("_top", F.array_max(masked)))
    return pin(
        top.withColumn("peak_bin", -F.col("_top.i")).withColumn("peak", F.get(bin_centers(), F.col("peak_bin"))).drop("_top")
    )


def mirrored_wing(peaked: DataFrame) -> DataFrame:
    """Adds wing, an array of (x, y, mirrored): bins up to the peak and their mirror images."""
    points = F.transform(
        F.arrays_zip(bin_centers().alias("x"), F.col("counts").alias("y")),
        lambda z: F.struct(z["x"].alias("x"), z["y"].cast("double").alias("y"), F.lit(False).alias("mirrored")),
    )
    left = F.filter(points, lambda z: (z["x"] <= F.col("peak")) & ~_near_one(z["x"]))
    back = F.transform(
        F.col("_left"), lambda z: F.struct((2 * F.col("peak") - z["x"]).alias("x"), z["y"].alias("y"), F.lit(True).alias("mirrored"))
    )
    return pin(peaked.withColumn("_left", left)).withColumn(
        "wing", F.concat("_left", F.filter(back, lambda z: ~_near_one(z["x"])))
    ).drop("_left")


def moffat_scale(pairs: DataFrame, keys: Sequence[str], n_bins: int = 200, half: int = 3) -> DataFrame:
    """Scale of each pair from a Moffat curve through the mirrored left wing.

    All rows are reduced to n_bins numbers per pair first; the fit sees one row per pair.
    A pair whose fit fails keeps the initial peak (fitted = false).
    """
    wings = mirrored_wing(initial_peak(ratio_histogram(pairs, keys, n_bins, half)))
    src = wings.select(
        *keys, "lo", "hi", "counts", "peak", F.col("wing.x").alias("x"), F.col("wing.y").alias("y")
    )
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in src.drop("x", "y").schema]
    schema = ", ".join([*fields, "amp double", "mu double", "alpha double", "beta double", "fitted boolean"])

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [
                fit_moffat(np.array(r.x, float), np.array(r.y, float), r.peak, r.lo, r.hi) for r in pdf.itertuples(index=False)
            ]
            out = pdf.drop(columns=["x", "y"])
            for i, name in enumerate(("amp", "mu", "alpha", "beta")):
                out[name] = [None if p is None else float(p[i]) for p in found]
            out["fitted"] = [p is not None for p in found]
            yield out

    return src.mapInPandas(fit, schema).withColumn("scale", F.pow(F.lit(10.0), F.coalesce("mu", "peak")))


def scale_set(
    pairs: DataFrame, keys: Sequence[str], scale_percentile: float | None = None, manual_scale: float | None = None
) -> DataFrame:
    """Keys, label, scale: the fitted scale always, the two others where they are set."""
    fitted = pin(moffat_scale(pairs, keys).select(*keys, "scale"))
    out = [fitted.select(*keys, F.lit("moffat").alias("label"), "scale")]
    if scale_percentile is not None:
        label = F.concat(F.lit("percentile_p"), general_format(F.lit(float(scale_percentile))))
        q = percentile_scale(pairs, keys, scale_percentile).filter("scale is not null")
        out.append(q.select(*keys, label.alias("label"), "scale"))
    if manual_scale is not None:
        out.append(fitted.select(*keys, F.lit("manual").alias("label"), F.lit(float(manual_scale)).alias("scale")))
    return union_all(*out)


def difference(pairs: DataFrame, keys: Sequence[str], scales: DataFrame) -> DataFrame:
    """d = post - scale * pre for every scale of the pair."""
    return attach(pairs, scales, keys, "inner").withColumn("d", F.col("post") - F.col("scale") * F.col("pre"))


# ---- older estimators ---------------------------------------------------------------------


def _ls(post: str = "post", pre: str = "pre") -> Column:
    x2 = F.sum(F.col(pre) * F.col(pre))
    return F.when(x2 > 0, F.sum(F.col(post) * F.col(pre)) / x2)


def least_squares_scale(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """sum(post * pre) / sum(pre^2)."""
    return pairs.groupBy(*keys).agg(_ls().alias("scale"))


def ratio_percentile_scale(pairs: DataFrame, keys: Sequence[str], p: float) -> DataFrame:
    """Percentile of the plain ratio, p in 0..100."""
    return percentiles(overlap(pairs), keys, F.col("post") / F.col("pre"), {"scale": p / 100.0})


def parabola_vertex(values: Column, peak: Column, half: int) -> Column:
    """Position of the vertex, in bins relative to peak, of the parabola through the bins
    peak-half..peak+half; 0 if it opens upwards; clipped to the bins used.

    The bins are numbered from the peak, which keeps the sums small and exact.
    """
    n = F.size(values)
    first, last = F.greatest(peak - half, F.lit(0)), F.least(peak + half, n - 1)
    us = F.sequence(first - peak, last - peak)
    total = lambda f: F.aggregate(F.transform(us, lambda u: f(u.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    y = lambda u: F.get(values, peak + u.cast("int")).cast("double")
    s0, s1, s2 = total(lambda u: F.lit(1.0)), total(lambda u: u), total(lambda u: u * u)
    s3, s4 = total(lambda u: u * u * u), total(lambda u: u * u * u * u)
    t0, t1, t2 = total(y), total(lambda u: u * y(u)), total(lambda u: u * u * y(u))
    # Cramer's rule for y = a u^2 + b u + c; the common determinant is positive
    det_a = t2 * (s2 * s0 - s1 * s1) - s3 * (t1 * s0 - s1 * t0) + s2 * (t1 * s1 - s2 * t0)
    det_b = s4 * (t1 * s0 - t0 * s1) - t2 * (s3 * s0 - s1 * s2) + s2 * (s3 * t0 - t1 * s2)
    vertex = F.least(F.greatest(-det_b / (2 * det_a), (first - peak).cast("double")), (last - peak).cast("double"))
    return F.when(det_a < 0, vertex).otherwise(0.0)


def _argmax(values: Column) -> Column:
    return -F.array_max(F.transform(values, lambda v, i: F.struct(v.cast("double").alias("v"), (-i).alias("i"))))["i"]


def histogram_mode_scale(pairs: DataFrame, keys: Sequence[str], n_bins: int = 100, ls: DataFrame | None = None) -> DataFrame:
    """Mode of the log-ratio histogram, refined by a parabola over +-5 bins.

    A peak more than one decade below the least-squares scale is searched again within
    one decade of it.
    """
    ls = least_squares_scale(pairs, keys) if ls is None else ls
    hist = pin(bin_counts(log_ratio(pairs).select(*keys, "x"), keys, "x", n_bins)).withColumn("smooth", box_smooth("counts", 2))
    one = pin(hist.join(ls.select(*keys, F.log10("scale").alias("_ls")), list(keys)).withColumn("_c", bin_centers()))
    one = pin(one.withColumn("_p0", _argmax(F.col("smooth"))))
    near = F.transform(
        F.arrays_zip(F.col("smooth").alias("s"), F.col("_c").alias("x")),
        lambda z: F.when(F.abs(z["x"] - F.col("_ls")) <= 1.0, z["s"]).otherwise(0.0),
    )
    again = (F.get("_c", F.col("_p0")) < F.col("_ls") - 1.0) & F.exists("_c", lambda x: F.abs(x - F.col("_ls")) <= 1.0)
    one = pin(one.withColumn("_peak", F.when(again, _argmax(near)).otherwise(F.col("_p0"))))
    width = (F.col("hi") - F.col("lo")) / n_bins
    mode = F.get("_c", F.col("_peak")) + parabola_vertex(F.col("smooth"), F.col("_peak"), 5) * width
    return one.select(*keys, F.pow(F.lit(10.0), mode).alias("scale"))


def signal_only_scale(
    pairs: DataFrame, keys: Sequence[str], p: float = 50.0, min_cells: int = 100, levels: int | None = None
) -> DataFrame:
    """Least squares over cells above the percentile p of both sides, plain least squares below min_cells.

    pairs holds the cells of the tissue mask.
    """
    a = percentiles(pairs, keys, "post", {"_tp": p / 100.0}, levels)
    b = percentiles(pairs, keys, "pre", {"_tq": p / 100.0}, levels)
    bright = (F.col("post") > F.col("_tp")) & (F.col("pre") > F.col("_tq"))
    x2 = F.sum(F.when(bright, F.col("pre") * F.col("pre")))
    xy = F.sum(F.when(bright, F.col("post") * F.col("pre")))
    return attach(pairs, a.join(b, list(keys)), keys).groupBy(*keys).agg(
        F.when(F.count_if(bright) >= min_cells, xy / x2).otherwise(_ls()).alias("scale"),
        F.count_if(bright).alias("n_signal"),
    )


def legacy_scale(
    px: DataFrame, keys: Sequence[str], shape, method: str = "least_squares", percentile: float | None = None,
    n_hist_bins: int = 100, boundary_erosion: int = 50, signal_percentile: float = 50.0, mask: DataFrame | None = None,
    min_cells: int = 100, levels: int | None = None,
) -> DataFrame:
    """Keys, scale, signal_scale, ls_scale, n_cells by the chosen method.

    The fit uses the eroded tissue mask; a pair whose mask keeps fewer than min_cells
    uses all its post signal. signal_scale belongs to method 'robust_percentile'.
    """
    from .masks import clean_tissue_mask, erode_square, pixels_to_runs, runs_to_pixels
    from .pixels import pair_pixels

    keys = list(keys)
    pairs = pin(pair_pixels(px, keys))
    tissue = pin(clean_tissue_mask(px, keys))
    base = tissue if mask is None else pixels_to_runs(
        overlap(pairs).join(runs_to_pixels(mask), [*keys, "r", "c"], "left_semi"), keys
    )
    fit_runs = erode_square(base, keys, boundary_erosion) if boundary_erosion > 0 else base
    cells = [*keys, "r", "c"]
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    in_mask = runs_to_pixels(fit_runs).join(pairs, cells, "left").select(*cells, zero("post"), zero("pre"))
    in_mask = pin(in_mask)
    n = in_mask.groupBy(*keys).agg(F.count("*").alias("n_cells"))
    enough = pin(pairs.select(*keys).distinct().join(n, keys, "left").select(*keys, F.coalesce("n_cells", F.lit(0)).alias("n_cells")))
    ok = enough.filter(F.col("n_cells") >= min_cells)
    used = pin(
        in_mask.join(ok, keys, "left_semi").unionByName(
            pairs.filter("post > 0").join(ok, keys, "left_anti").select(*cells, "post", "pre")
        )
    )
    ls = pin(least_squares_scale(used, keys).withColumnRenamed("scale", "ls_scale"))
    out = enough.join(ls, keys, "left")
    if method == "least_squares":
        return out.select(*keys, F.col("ls_scale").alias("scale"), F.lit(None).cast("double").alias("signal_scale"), "ls_scale", "n_cells")
    if percentile is not None:
        main = ratio_percentile_scale(used, keys, percentile)
    else:
        main = histogram_mode_scale(used, keys, n_hist_bins, ls.withColumnRenamed("ls_scale", "scale"))
    in_tissue = runs_to_pixels(tissue).join(pairs, cells, "left").select(*cells, zero("post"), zero("pre"))
    sig = signal_only_scale(pin(in_tissue), keys, signal_percentile, min_cells, levels)
    return (
        out.join(main, keys, "left").join(sig.select(*keys, F.col("scale").alias("signal_scale")), keys, "left")
        .select(*keys, F.coalesce("scale", "ls_scale").alias("scale"), F.coalesce("signal_scale", "ls_scale").alias("signal_scale"), "ls_scale", "n_cells")
    )


def gaussian_noise_fit(pairs: DataFrame, keys: Sequence[str], n_bins: int = 100) -> DataFrame:
    """Gaussian through the log-ratio bins left of the coarse peak and their mirror images."""
    x = log_ratio(pairs).select(*keys, "x")
    limits = pin(x.groupBy(*keys).agg(F.min("x").alias("lo"), F.max("x").alias("hi")))
    coarse = pin(pin(bin_counts(x, keys, "x", 20, limits)).withColumn("_p", _argmax(F.col("counts"))))
    width = (F.col("hi") - F.col("lo")) / 20
    peak = F.get(bin_centers(), F.col("_p")) + parabola_vertex(F.col("counts"), F.col("_p"), 3) * width
    fine = bin_counts(x, keys, "x", n_bins, limits)
    both = fine.join(pin(coarse.select(*keys, peak.alias("peak"))), list(keys)).withColumn("x", bin_centers())
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in both.select(*keys, "lo", "hi", "peak").schema]
    schema = ", ".join([*fields, "amp double", "mu double", "sigma double"])

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                c, y = np.array(r.x, float), np.array(r.counts, float)
                c, y = c[c <= r.peak], y[c <= r.peak]
                p = fit_gauss(np.r_[c, 2 * r.peak - c], np.r_[y, y], r.peak, r.lo)
                rows.append([None] * 3 if p is None else [float(v) for v in p])
            out = pdf[[*keys, "lo", "hi", "peak"]].copy()
            for i, name in enumerate(("amp", "mu", "sigma")):
                out[name] = [row[i] for row in rows]
            yield out

    return both.mapInPandas(fit, schema)
