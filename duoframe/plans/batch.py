"""Runs of one pair, of a batch and of a parameter sweep over a stage store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diagnostics as D
from ..operators.pixels import pad_to_common_canvas, pair_pixels
from ..operators.register import refine_interior, register_outline, search_candidates
from ..operators.scale import difference, moffat_scale, overlap, scale_set
from ..operators.warp import warp_bilinear
from ..session import attach, is_empty, pin, union_all
from ..sources.store import PARTITIONS, SCHEMA, write_stage
from . import params as P
from .reports import DIAGNOSTICS, plan_stages

KEYS = ["sample", "dye"]
TRANSFORMS = "sample string, dye string, stage int, suffix string, m array<double>"


class Store:
    """Folder of stage rasters and transforms; every raster is keyed by its parameter suffix."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.rasters, self.maps = spark, f"{path}/rasters", f"{path}/transforms"
        self.tables = f"{path}/tables"

    def _read(self, path: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def manifest(self, suffix_of: dict[int, str]) -> DataFrame:
        """Rasters that exist for these parameters: partition values only."""
        rows = self._read(self.rasters, SCHEMA)
        wanted = [(F.col("stage") == s) & (F.col("suffix") == (x or "_")) for s, x in suffix_of.items()]
        match = wanted[0]
        for w in wanted[1:]:
            match = match | w
        out = rows.filter(match).select(*PARTITIONS).distinct()
        last = suffix_of.get(P.MAX_STAGE)
        if last is not None:
            for name in DIAGNOSTICS:
                kept = self._read(f"{self.tables}/{name}", "sample string, dye string, suffix string").filter(F.col("suffix") == (last or "_"))
                out = out.unionByName(kept.select(*KEYS, F.lit(P.MAX_STAGE).alias("stage"), F.lit(name).alias("name"), "suffix").distinct())
        return out

    def write_table(self, rows: DataFrame, name: str, suffix: str) -> None:
        """Rows with the keys of their task, kept by name and suffix; the tasks present in rows are replaced."""
        out = rows.withColumn("suffix", F.lit(suffix or "_"))
        out.write.partitionBy("suffix", *KEYS).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.tables}/{name}")

    def table(self, name: str, suffix: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.tables}/{name}").filter(F.col("suffix") == (suffix or "_")).drop("suffix")

    def raster(self, tasks: DataFrame, stage: int, name: str, suffix: str) -> DataFrame:
        px = self._read(self.rasters, SCHEMA).filter(
            (F.col("stage") == stage) & (F.col("name") == name) & (F.col("suffix") == (suffix or "_"))
        )
        return px.join(tasks, KEYS, "left_semi").select(*KEYS, "r", "c", F.col("v").cast("double").alias("v"))

    def transforms(self, tasks: DataFrame, stage: int, suffix: str) -> DataFrame:
        rows = self._read(self.maps, TRANSFORMS).filter((F.col("stage") == stage) & (F.col("suffix") == (suffix or "_")))
        return rows.join(tasks, KEYS, "left_semi").select(*KEYS, "m")

    def write_transforms(self, maps: DataFrame, stage: int, suffix: str) -> None:
        out = maps.select(*KEYS, "m", F.lit(stage).alias("stage"), F.lit(suffix or "_").alias("suffix"))
        out.write.partitionBy("stage", "suffix", *KEYS).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.maps)


def suffixes(spark: SparkSession, params: dict) -> dict[int, str]:
    table = P.require_valid(P.params_table(spark, {**P.defaults_typed(), **params}))
    return {s: P.build_suffix(table, s).first()["suffix"] for s in range(1, P.MAX_STAGE + 1)}


def write_diagnostics(store: Store, pairs: DataFrame, canvas: DataFrame, scales: DataFrame, suffix: str) -> None:
    """Tables of H1 to H6 and of every diagnostic that the user registered, for all pairs at once."""
    one = scales.filter("label = 'moffat'").select(*KEYS, "scale")
    made = {
        "pre_post_heatmap": D.density_grid(pairs, KEYS, canvas), "pre_post_histograms": D.brightness_histograms(pairs, KEYS),
        "difference_histogram": D.difference_histogram(pairs, KEYS, canvas), "ratio_histogram": D.ratio_report(pairs, KEYS),
        "excess_heatmap": D.excess_grid(pairs, KEYS, canvas),
        "difference_image": D.difference_display(attach(pairs, one, KEYS, "inner"), KEYS, F.col("scale")),
        **{name: fn(pairs, KEYS) for name, fn in D.REGISTRY.items()},
    }
    for name, rows in made.items():
        store.write_table(rows, name, suffix)


def run_batch(
    px: DataFrame, frames: DataFrame, tasks: DataFrame, path: str, params: dict | None = None,
    from_stage: int | None = None, to_stage: int | None = None, force: bool = False, diagnostics: bool = True,
) -> DataFrame:
    """Run the four stages for all tasks at once; one result row per task.

    px: sample, dye, kind, r, c, v (gray raw pixels); frames: sample, dye, kind, height, width.
    Every stage is one grouped job over the tasks that still need it. A task that cannot
    go on gets an error status and leaves the others alone: one whose file could not be read
    (column error of frames, if there is one), without frame size, with pixels outside its frame or
    values that are not finite, without signal on a side, or whose outline search failed. The last stage also writes the
    tables of the diagnostics, stage 3 those of the interior fits.
    """
    spark = px.sparkSession
    given = {**P.defaults_typed(), **(params or {})}
    if given["fine_ecc"]:
        raise ValueError("fine_ecc: the optional fine pass is not built")
    suf, store = suffixes(spark, params or {}), Store(spark, path)
    tasks = pin(tasks.select(*KEYS).distinct())
    first, last = from_stage or 1, to_stage or P.MAX_STAGE

    def todo(stage: int) -> DataFrame:
        planned = plan_stages(tasks, store.manifest(suf), first, last, force)
        return pin(planned.filter((F.col("stage") == stage) & F.col("run")).select(*KEYS).join(ready, KEYS, "left_semi"))

    # what a task has, and what keeps it from running, in one pass over the pixels
    listed = frames.join(tasks, KEYS, "left_semi")
    text = F.col("error") if "error" in frames.columns else F.lit(None).cast("string")
    unread = pin(listed.groupBy(*KEYS).agg(F.max(text).alias("unread")).filter("unread is not null"))
    size = listed.groupBy(*KEYS, "kind").agg(F.max("height").alias("_height"), F.max("width").alias("_width"))
    within = F.col("r").between(0, F.col("_height") - 1) & F.col("c").between(0, F.col("_width") - 1)
    v = F.col("v").cast("double")
    fault = (
        F.when(F.col("_height").isNull() | F.col("_width").isNull(), "no frame size")
        .when(~F.coalesce(within, F.lit(False)), "pixels outside the frame")
        .when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), "values that are not finite")
    )
    sides = pin(attach(px.join(tasks, KEYS, "left_semi"), size, [*KEYS, "kind"]).groupBy(*KEYS).agg(
        F.count_if((F.col("kind") == "post") & (v > 0)).alias("n_post"), F.count_if((F.col("kind") == "pre") & (v > 0)).alias("n_pre"),
        F.max(fault).alias("fault"),
    ))
    ready = pin(sides.filter("n_post > 0 and n_pre > 0 and fault is null").select(*KEYS).join(unread, KEYS, "left_anti"))
    failed = []
    canvas = pin(pad_to_common_canvas(frames.join(tasks, KEYS, "left_semi"), KEYS, given["pad"]).select(*KEYS, "height", "width").distinct())
    # pairs of one canvas size run together; scanners produce few sizes
    shapes = [(r["height"], r["width"]) for r in canvas.join(ready, KEYS, "left_semi").select("height", "width").distinct().toLocalIterator()]
    at_shape = lambda df, s: df.join(canvas.filter((F.col("height") == s[0]) & (F.col("width") == s[1])), KEYS, "left_semi")

    if first <= 1 or not is_empty(todo(1)):
        new = todo(1)
        if not is_empty(new):
            moved = px.join(new, KEYS, "left_semi").withColumn("r", F.col("r") + given["pad"]).withColumn("c", F.col("c") + given["pad"])
            for kind in ("post", "pre"):
                write_stage(moved.filter(F.col("kind") == kind), store.rasters, 1, kind, suf[1])
    both = lambda t, stage, suffix: store.raster(t, 1, "post", suf[1]).withColumn("kind", F.lit("post")).unionByName(
        store.raster(t, stage, "pre", suffix).withColumn("kind", F.lit("pre"))
    )
    if last >= 2:
        new = todo(2)
        for s in shapes:
            part = pin(at_shape(new, s))
            if is_empty(part):
                continue
            cand = search_candidates(*[given[k] for k in (
                "rotation_search", "angle_range", "angle_step", "scale_search", "scale_min", "scale_max", "scale_step")])
            gate = {k: given[k] for k in ("max_translation", "max_rotation", "max_scale_delta", "max_scale_diff")}
            maps = register_outline(
                both(part, 1, suf[1]), KEYS, s, given["down_scale"], given["boundary_width"], given["boundary_smooth"],
                cand, given["multiscale"], gate,
            )
            failed.append(maps.filter("m is null").select(*KEYS, F.concat(F.lit("error: outline: "), "error").alias("failure")))
            maps = maps.filter("m is not null")
            store.write_transforms(maps, 2, suf[2])
            write_stage(warp_bilinear(store.raster(part, 1, "pre", suf[1]), KEYS, s, maps), store.rasters, 2, "pre", suf[2])
    if last >= 3:
        new = todo(3)
        for s in shapes:
            part = pin(at_shape(new, s))
            if is_empty(part):
                continue
            before = pin(store.transforms(part, 2, suf[2]))
            maps = before
            if given["interior_ecc"]:
                maps = pin(refine_interior(
                    both(part, 1, suf[1]), before, KEYS, s, max_correction=given["interior_max_correction"],
                    min_inlier_ratio=given["interior_min_inlier_ratio"], blur_base=given["interior_blur_base"],
                ))
                store.write_table(maps.drop("m"), "interior", suf[3])
            store.write_transforms(maps, 3, suf[3])
            write_stage(warp_bilinear(store.raster(part, 1, "pre", suf[1]), KEYS, s, maps), store.rasters, 3, "pre", suf[3])
    scales = None
    if last >= 4:
        new = todo(4)
        aligned = pin(pair_pixels(both(ready, 3, suf[3]), KEYS))
        scales = pin(scale_set(aligned, KEYS, given["scale_percentile"], given["manual_scale"]))
        if not is_empty(new):
            diff = difference(aligned.join(new, KEYS, "left_semi"), KEYS, scales).withColumn("v", F.col("d"))
            # one label per kind of scale that the parameters ask for
            labels = [r["label"] for r in scales.select("label").distinct().collect()]
            for label in labels:
                name = "difference" if label == "moffat" else f"difference_{label}"
                write_stage(diff.filter(F.col("label") == label), store.rasters, 4, name, suf[4])
            if diagnostics:
                write_diagnostics(store, pin(aligned.join(new, KEYS, "left_semi")), canvas, scales, suf[4])
    done = tasks.join(sides, KEYS, "left").join(unread, KEYS, "left")
    none = spark.createDataFrame([], done.select(*KEYS).schema).withColumn("failure", F.lit(None).cast("string"))
    done = done.join(union_all(none, *failed), KEYS, "left")
    if scales is None:
        scales = spark.createDataFrame([], "sample string, dye string, label string, scale double")
    pick = lambda cond: F.max(F.when(cond, F.col("scale")))
    per_task = scales.groupBy(*KEYS).agg(
        pick(F.col("label") == "moffat").alias("scale_estimate"),
        pick(F.col("label").startswith("percentile")).alias("scale_percentile_value"),
        pick(F.col("label") == "manual").alias("manual_scale"),
    )
    status = (
        F.when(F.col("unread").isNotNull(), F.concat(F.lit("error: "), "unread"))
        .when(F.col("n_post").isNull(), "error: no raw pixels").when(F.col("fault").isNotNull(), F.concat(F.lit("error: "), "fault"))
        .when(F.col("n_post") == 0, "error: post frame has no signal").when(F.col("n_pre") == 0, "error: pre frame has no signal")
        .when(F.col("failure").isNotNull(), F.col("failure")).when(F.lit(last < P.MAX_STAGE), "stopped early")
        .when(F.col("scale_estimate").isNull(), "error: no overlap of post and pre").otherwise("complete")
    )
    return done.join(per_task, KEYS, "left").select(*KEYS, "scale_estimate", "scale_percentile_value", "manual_scale", status.alias("status"))


def run_pair(px: DataFrame, frames: DataFrame, sample: str, dye: str, path: str, **options) -> DataFrame:
    """I8: one pair through the stages: a batch of one task."""
    one = px.sparkSession.createDataFrame([(sample, dye)], "sample string, dye string")
    return run_batch(px, frames, one, path, **options)


def sweep(
    px: DataFrame, frames: DataFrame, tasks: DataFrame, path: str, name: str, values: Sequence, params: dict | None = None
) -> DataFrame:
    """Results per value of one parameter.

    Stages before the parameter's stage are shared through the store; later ones are kept
    apart by their suffix.
    """
    parts = []
    for v in values:
        one = run_batch(px, frames, tasks, path, {**(params or {}), name: v}, diagnostics=False)
        parts.append(pin(one.withColumn("parameter", F.lit(name)).withColumn("value", F.lit(P.to_text(v)))))
    return union_all(*parts)
