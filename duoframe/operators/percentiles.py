"""Exact percentiles with linear interpolation, safe for very large groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import is_empty, pin

# Parts into which a round cuts the range that holds a wanted rank.
BINS = 4096


def percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str | Column,
    ps: Mapping[str, float],
    levels: int | None = None,
) -> DataFrame:
    """One row per group with one exact percentile column per entry of ps (name -> p in 0..1).

    levels is a proven bound on the distinct values of a group, such as 256 for
    8-bit frames. With it the built-in aggregate does the work in one map-side combined pass.
    Otherwise every rank is narrowed down by counts: first by sign and binary exponent,
    then by equal parts of the range that is left, until that range is one value. Only
    counts, minima and maxima per part are shuffled, at most BINS rows per rank and task, and
    every further round divides the range by BINS, so about five passes settle any data.
    Nulls are left out; NaN counts as the largest value.
    """
    keys = list(keys)
    vals = df.select(*keys, _as_col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    if levels is not None:
        return _builtin(vals, keys, ps)
    return _refined(vals, keys, ps)


def _as_col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _builtin(vals: DataFrame, keys: list[str], ps: Mapping[str, float]) -> DataFrame:
    q = F.percentile("_v", F.array(*[F.lit(float(p)) for p in ps.values()]))
    return vals.groupBy(*keys).agg(q.alias("_q")).select(
        *keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(ps)]
    )


def _exponent(v: Column) -> Column:
    """A number that never falls as v grows: by sign and binary exponent."""
    size = F.floor(F.log2(F.abs(v))).cast("double") + 2000.0
    return F.when(F.isnan(v), 1e6).when(F.abs(v) == float("inf"), F.signum(v) * 1e5).when(v == 0, 0.0).otherwise(F.signum(v) * size)


def _narrowed(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Of the parts of each rank the one that holds it, with the rows below it and the smallest value above it.

    counts: keys, _i, _k (rank), _below, _next, _bin, _c, _lo, _hi. A rank has BINS parts at most.
    """
    order = Window.partitionBy(*keys, "_i").orderBy("_bin")
    cum = F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_below")
    seen = counts.withColumn("_cum", cum).withColumn("_next", F.coalesce(F.lead("_lo").over(order), "_next"))
    here = (F.col("_cum") > F.floor("_k")) & (F.col("_cum") - F.col("_c") <= F.floor("_k"))
    return seen.filter(here).select(*keys, "_i", "_k", (F.col("_cum") - F.col("_c")).alias("_below"), "_next", F.col("_c").alias("_in"), "_lo", "_hi")


def _refined(vals: DataFrame, keys: list[str], ps: Mapping[str, float]) -> DataFrame:
    part = [F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]
    first = vals.groupBy(*keys, _exponent(F.col("_v")).alias("_bin")).agg(*part)
    n = F.sum("_c").over(Window.partitionBy(*keys))
    ranks = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(ps.values())]))
    asked = first.withColumn("_n", n).withColumn("_r", ranks).select(
        "*", F.col("_r.i").alias("_i"), (F.col("_r.p") * (F.col("_n") - 1)).alias("_k"),
        F.lit(0).cast("bigint").alias("_below"), F.lit(None).cast("double").alias("_next"),
    )
    state = pin(_narrowed(asked, keys))
    while not is_empty(state.filter("_lo < _hi")):
        wide = state.filter("_lo < _hi")
        # few rows: every value is a part of its own
        share = (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * BINS
        cut = F.when(F.col("_in") <= BINS, F.col("_v")).otherwise(F.least(F.floor(share).cast("double"), F.lit(BINS - 1.0)))
        near = vals.join(wide, keys) if keys else vals.crossJoin(wide)  # without keys: a row per entry of ps
        counts = near.filter((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))).groupBy(*keys, "_i", cut.alias("_bin")).agg(*part)
        counts = counts.join(wide.select(*keys, "_i", "_k", "_below", "_next"), [*keys, "_i"])
        state = pin(state.filter("not (_lo < _hi)").unionByName(_narrowed(counts, keys)))
    upper = F.when(F.ceil("_k") < F.col("_below") + F.col("_in"), F.col("_lo")).otherwise(F.col("_next"))
    share = F.col("_k") - F.floor("_k")
    x = F.when(share == 0, F.col("_lo")).otherwise(F.col("_lo") + (upper - F.col("_lo")) * share)
    return state.groupBy(*keys).agg(*[F.max(F.when(F.col("_i") == i, x)).alias(name) for i, name in enumerate(ps)])
