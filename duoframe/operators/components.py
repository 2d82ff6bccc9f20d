"""Connected components of masks given as runs, and the feature table."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import is_empty, pin


def run_id():
    """Number of a run that grows in raster order (rows and columns from -1 on)."""
    return F.shiftleft((F.col("r") + 1).cast("bigint"), 32) + F.col("c0") + 1


def _lowest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lowest vertex number in the component of each of n vertices with edges (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _label_block(slack: int):
    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["r", "c0"], ignore_index=True)
        r, c0, c1 = (pdf[k].to_numpy(np.int64) for k in ("r", "c0", "c1"))
        row = (r + 2) << 32
        # runs of the next row that touch run i form the range first[i]:last[i]
        first = np.searchsorted(row + c1, row + (1 << 32) + c0 - slack, "left")
        last = np.searchsorted(row + c0, row + (1 << 32) + c1 + slack, "right")
        count = np.maximum(last - first, 0)
        a = np.repeat(np.arange(len(r)), count)
        b = first.repeat(count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        pdf["label"] = pdf["run"].to_numpy()[_lowest(len(r), a, b)]
        return pdf

    return label


def _touching(rows: DataFrame, keys: list[str], slack: int) -> DataFrame:
    """Label pairs of runs that touch across a block border.

    Of two touching runs the later starting one begins inside the other, so for
    each run it is enough to look at the last run of the facing row that starts
    at or before it.
    """
    w = Window.partitionBy(*keys, "_border").orderBy("c0", "_side").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda side: F.last(F.when(F.col("_side") == side, F.struct("label", "c1")), ignorenulls=True).over(w)
    facing = rows.withColumn("_up", last(0)).withColumn("_lo", last(1))
    seen = F.when(F.col("_side") == 0, F.col("_lo")).otherwise(F.col("_up"))
    return (
        facing.select(*keys, F.col("label").alias("a"), seen.alias("_f"), "c0")
        .filter(F.col("_f").isNotNull() & (F.col("_f.c1") + slack >= F.col("c0")))
        .select(*keys, "a", F.col("_f.label").alias("b"))
    )


def components(
    runs: DataFrame, keys: Sequence[str], connectivity: int = 8, block_rows: int = 256
) -> DataFrame:
    """Runs with label, the number of the first run of the component in raster order.

    Blocks of block_rows rows are labelled inside tasks (a block holds at most
    block_rows * width / 2 runs); what is left is the small graph of the labels that
    touch across block borders. It is solved by repeated hooking and pointer jumping over
    all frames at once, with a written table per round.
    """
    keys, slack = list(keys), 1 if connectivity == 8 else 0
    src = runs.select(
        *keys, F.col("r").cast("int").alias("r"), F.col("c0").cast("int").alias("c0"), F.col("c1").cast("int").alias("c1")
    ).withColumn("run", run_id()).withColumn("_block", F.floor((F.col("r") + 1) / block_rows).cast("int"))
    schema = src.withColumn("label", F.lit(0).cast("bigint")).schema
    local = pin(src.groupBy(*keys, "_block").applyInPandas(_label_block(slack), schema))

    pos = F.pmod(F.col("r") + 1, F.lit(block_rows))
    lower = local.filter(pos == 0).select(*keys, F.col("_block").alias("_border"), F.lit(1).alias("_side"), "c0", "c1", "label")
    upper = local.filter(pos == block_rows - 1).select(
        *keys, (F.col("_block") + 1).alias("_border"), F.lit(0).alias("_side"), "c0", "c1", "label"
    )
    edges = pin(_touching(upper.unionByName(lower), keys, slack).distinct())
    if is_empty(edges):
        return local.drop("_block", "run")
    roots = _solve(edges, keys)
    return (
        local.join(roots.withColumnRenamed("node", "label"), [*keys, "label"], "left")
        .withColumn("label", F.coalesce("root", "label")).drop("_block", "run", "root")
    )


def _solve(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest label reachable from each label of an undirected edge list."""
    both = pin(edges.unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = pin(both.select(*keys, F.col("a").alias("node")).distinct().withColumn("root", F.col("node")))
    while True:
        near = (
            both.join(state.select(*keys, F.col("node").alias("b"), F.col("root").alias("_nr")), [*keys, "b"])
            .groupBy(*keys, F.col("a").alias("node")).agg(F.min("_nr").alias("_nr"))
        )
        hooked = state.join(near, [*keys, "node"], "left").select(
            *keys, "node", "root", F.least("root", F.coalesce("_nr", "root")).alias("_new")
        )
        # a root takes the best label that any of its nodes has seen
        pull = hooked.groupBy(*keys, F.col("root").alias("node")).agg(F.min("_new").alias("_pull"))
        step = pin(
            hooked.join(pull, [*keys, "node"], "left").select(
                *keys, "node", "root", F.least("_new", F.coalesce("_pull", "_new")).alias("_new")
            )
        )
        jump = step.select(*keys, F.col("node").alias("_new"), F.col("_new").alias("_jump"))
        nxt = pin(
            step.join(jump, [*keys, "_new"], "left").select(
                *keys, "node", F.least("_new", F.coalesce("_jump", "_new")).alias("root"),
                F.col("root").alias("_old"),
            )
        )
        state = nxt.drop("_old")
        if is_empty(nxt.filter("root <> _old")):
            return state


def feature_table(
    diff: DataFrame, keys: Sequence[str], n_sigma: float = 5.0, min_area: int = 20
) -> DataFrame:
    """Bright features of a difference image: centroid, area, mean intensity per component."""
    from .masks import pixels_to_runs, runs_to_pixels
    from ..session import attach

    keys = list(keys)
    noise = diff.filter("d <> 0").groupBy(*keys).agg(F.stddev_pop("d").alias("_sd"))
    bright = pin(attach(diff, noise, keys, "inner").filter(F.col("d") > n_sigma * F.col("_sd")).select(*keys, "r", "c", "d"))
    labelled = runs_to_pixels(components(pixels_to_runs(bright, keys), keys, 8))
    return (
        labelled.join(bright, [*keys, "r", "c"])
        .groupBy(*keys, "label")
        .agg(
            F.avg("r").alias("centroid_r"), F.avg("c").alias("centroid_c"),
            F.count("*").alias("area"), F.avg("d").alias("mean_intensity"),
        )
        .filter(F.col("area") >= min_area)
    )
