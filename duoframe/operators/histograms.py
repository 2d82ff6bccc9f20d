"""Histograms as one short array per group, smoothing and histogram matching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import attach, pin
from .percentiles import percentiles


def uniform_bin(x: Column, lo: Column, hi: Column, n: int) -> Column:
    """Bin number of x for n equal bins over [lo, hi], last bin closed; 0 if lo = hi."""
    b = F.floor((x - lo) / (hi - lo) * n)
    return F.when(hi > lo, F.least(F.lit(n - 1), b)).otherwise(0).cast("int")


def value_range(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))


def bin_counts(
    df: DataFrame, keys: Sequence[str], value: str, n_bins: int, limits: DataFrame | None = None
) -> DataFrame:
    """Keys, lo, hi, counts ARRAY<BIGINT> of length n_bins, values outside [lo, hi] ignored.

    Counting is one map-side combined aggregation on (keys, bin); a group's array
    never holds more than n_bins numbers.
    """
    limits = pin(value_range(df, keys, value) if limits is None else limits.select(*keys, "lo", "hi"))
    x = F.col(value)
    binned = (
        df.select(*keys, value).join(limits, list(keys))
        .filter((x >= F.col("lo")) & (x <= F.col("hi")))
        .groupBy(*keys, uniform_bin(x, F.col("lo"), F.col("hi"), n_bins).alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    counts = binned.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_m"))
    return counts.join(limits, list(keys)).select(
        *keys, "lo", "hi",
        F.transform(
            F.sequence(F.lit(0), F.lit(n_bins - 1)), lambda b: F.coalesce(F.element_at("_m", b), F.lit(0).cast("bigint"))
        ).alias("counts"),
    )


def bin_width(counts: str = "counts") -> Column:
    return (F.col("hi") - F.col("lo")) / F.size(counts)


def bin_centers(counts: str = "counts") -> Column:
    """Array of bin centres: lo + (i + 0.5) * width."""
    return F.transform(
        F.sequence(F.lit(0), F.size(counts) - 1),
        lambda i: F.col("lo") + (i + 0.5) * (F.col("hi") - F.col("lo")) / F.size(counts),
    )


def box_smooth(counts: str | Column, half: int) -> Column:
    """Running mean of width 2*half+1 with mirrored ends (edge value repeated)."""
    c = F.col(counts) if isinstance(counts, str) else counts
    n = F.size(c)

    def at(i: Column) -> Column:
        j = F.when(i < 0, -1 - i).when(i >= n, 2 * n - 1 - i).otherwise(i)
        return F.get(c, j)

    offsets = F.sequence(F.lit(-half), F.lit(half))
    return F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.aggregate(F.transform(offsets, lambda o: at(i + o)), F.lit(0).cast("bigint"), lambda s, x: s + x)
        / float(2 * half + 1),
    )


def explode_bins(hist: DataFrame, keys: Sequence[str], counts: str = "counts") -> DataFrame:
    """Long form of a bin_counts table: one row per bin with its edges."""
    w = bin_width(counts)
    return hist.select(*keys, "lo", "hi", F.posexplode(counts).alias("bin", "n"), w.alias("_w")).select(
        *keys, "bin", (F.col("lo") + F.col("bin") * F.col("_w")).alias("bin_lo"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("_w")).alias("bin_hi"), "n",
    )


def integer_bins(df: DataFrame, keys: Sequence[str], value: str, levels: int | None = None) -> DataFrame:
    """C4: counts in unit bins centred on the integers, up to ceil(p99.9) + 0.5."""
    cap = percentiles(df, keys, value, {"cap": 0.999}, levels).withColumn("cap", F.ceil("cap"))
    return (
        attach(df, cap, keys)
        .withColumn("bin", F.floor(F.col(value) + 0.5))
        .filter((F.col("bin") >= 0) & (F.col(value) <= F.col("cap") + 0.5))
        .withColumn("bin", F.least("bin", "cap"))
        .groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    )


def match_histograms(
    px: DataFrame, keys: Sequence[str], n_bins: int = 256, levels: int | None = None
) -> DataFrame:
    """Give the pre image the value distribution of the post image, both scaled to 0..1.

    Both distributions live in n_bins numbers per frame. The inversion of the post
    distribution is an ordered window over those bins, and only the short lookup
    table meets the pixels.
    """
    keys = list(keys)
    side = [*keys, "kind"]
    pos = px.filter("v > 0")
    hist = pin(bin_counts(pos, side, "v", n_bins))
    bins = hist.select(*side, "lo", "hi", F.posexplode("counts").alias("bin", "n"))
    run = Window.partitionBy(*side).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cdf = bins.withColumn("cdf", F.sum("n").over(run) / F.sum("n").over(Window.partitionBy(*side)))
    # first post bin with cdf >= x: look forward from each pre bin in cdf order
    post_bin = F.when(F.col("kind") == "post", F.col("bin"))
    ahead = (
        Window.partitionBy(*keys)
        .orderBy(F.col("cdf").desc(), F.when(F.col("kind") == "post", 0).otherwise(1), F.col("bin").desc())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    spans = hist.filter("kind = 'post'").select(*keys, F.col("lo").alias("_plo"), F.col("hi").alias("_phi"))
    lookup = (
        cdf.withColumn("_to", F.last(post_bin, ignorenulls=True).over(ahead))
        .filter("kind = 'pre'")
        .join(spans, keys)
        .select(
            *side, "bin",
            (F.col("_plo") + (F.coalesce("_to", F.lit(n_bins - 1)) + 0.5) * (F.col("_phi") - F.col("_plo")) / n_bins).alias("_matched"),
        )
    )
    top = percentiles(pos.filter("kind = 'post'"), keys, "v", {"_p99": 0.99}, levels)
    edges = hist.select(*side, "lo", "hi")
    own = edges.groupBy(*keys).agg(
        F.max(F.when(F.col("kind") == "post", F.col("hi"))).alias("_post_max"),
        F.max(F.when(F.col("kind") == "pre", F.col("hi"))).alias("_pre_max"),
    )
    per_pair = own.join(top, keys, "left").withColumn(
        "_p99", F.when(F.col("_p99") < 1e-8, 1.0).otherwise(F.col("_p99"))
    )
    # right-closed bins: the largest edge strictly below v opens the bin of v
    up = F.ceil((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * n_bins) - 1
    bin_of = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(n_bins - 1), F.greatest(F.lit(0), up))).otherwise(0).cast("int")
    out = (
        attach(attach(px, edges, side), per_pair, keys)
        .withColumn("bin", F.when(F.col("v") > 0, bin_of))
        .join(pin(lookup), [*side, "bin"], "left")
    )
    both = F.col("_post_max").isNotNull() & F.col("_pre_max").isNotNull()
    raw = F.when(F.col("kind") == "post", F.col("v")).when(F.col("v") > 0, F.col("_matched")).otherwise(0.0)
    alone = F.col("v") / (F.coalesce(F.when(F.col("kind") == "post", F.col("_post_max")).otherwise(F.col("_pre_max")), F.lit(0.0)) + 1e-8)
    unit = F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw / F.col("_p99")))
    return out.select(*px.columns, F.when(both, unit).otherwise(alone).alias("matched"))
