"""Resume logic, estimates, status and summaries over the manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import human_bytes
from ..sources.store import STAGE_NAMES

# Rasters each stage writes, and the diagnostics of the last stage.
STAGE_RASTERS = [(1, "post"), (1, "pre"), (2, "pre"), (3, "pre"), (4, "difference")]
DIAGNOSTICS = [
    "pre_post_heatmap", "pre_post_histograms", "difference_histogram", "ratio_histogram",
    "excess_heatmap", "difference_image",
]


def _literal_rows(rows: list[tuple], names: list[str]) -> Column:
    return F.explode(F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(names, row)]) for row in rows]))


def expected_rasters(tasks: DataFrame) -> DataFrame:
    return tasks.select("sample", "dye", _literal_rows(STAGE_RASTERS, ["stage", "name"]).alias("_e")).select(
        "sample", "dye", "_e.stage", "_e.name"
    )


def missing_upstream(tasks: DataFrame, manifest: DataFrame, target_stage: int) -> DataFrame:
    """Rasters below target_stage that a task needs and does not have."""
    need = expected_rasters(tasks).filter(F.col("stage") < target_stage)
    return need.join(manifest.select("sample", "dye", "stage", "name").distinct(), ["sample", "dye", "stage", "name"], "left_anti")


def plan_stages(
    tasks: DataFrame, manifest: DataFrame, from_stage: int | None = None, to_stage: int | None = None, force: bool = False
) -> DataFrame:
    """Task x stage with run true or false.

    A stage runs if it is inside the range and forced or not complete; a stage before the
    range runs if it is not complete, because the range needs it.
    """
    first, last = from_stage or 1, to_stage or max(STAGE_NAMES)
    have = manifest.select("sample", "dye", "stage", "name").distinct().withColumn("_have", F.lit(1))
    done = (
        expected_rasters(tasks).join(have, ["sample", "dye", "stage", "name"], "left")
        .groupBy("sample", "dye", "stage").agg((F.count("*") == F.count("_have")).alias("complete"))
    )
    st = F.col("stage")
    run = F.when(st > last, False).when(st < first, ~F.col("complete")).otherwise(F.lit(force) | ~F.col("complete"))
    return done.withColumn("run", run)


def status_report(tasks: DataFrame, manifest: DataFrame) -> DataFrame:
    """Every expected raster and diagnostic with an exists flag."""
    rows = [(s, n) for s, n in STAGE_RASTERS] + [(4, n) for n in DIAGNOSTICS]
    want = tasks.select("sample", "dye", _literal_rows(rows, ["stage", "name"]).alias("_e")).select(
        "sample", "dye", "_e.stage", "_e.name"
    )
    have = manifest.select("sample", "dye", "stage", "name").distinct().withColumn("_have", F.lit(True))
    return want.join(have, ["sample", "dye", "stage", "name"], "left").select(
        "sample", "dye", "stage", "name", F.coalesce("_have", F.lit(False)).alias("exists")
    )


def summary(results: DataFrame) -> DataFrame:
    """Results with a short status."""
    s = F.col("status")
    return results.withColumn(
        "short_status", F.when(F.contains(s, F.lit("error")), "error").when(s == "complete", "complete").otherwise(F.substring(s, 1, 10))
    )


def summary_columns(results: DataFrame) -> DataFrame:
    """Which optional scale columns hold any value."""
    cols = [c for c in ("scale_estimate", "scale_percentile_value", "manual_scale") if c in results.columns]
    return results.agg(*[F.max(F.col(c).isNotNull()).alias(f"has_{c}") for c in cols])


def problems(results: DataFrame) -> DataFrame:
    """Failed tasks with the error text."""
    return results.filter(F.contains("status", F.lit("error"))).select(
        "sample", "dye", F.regexp_replace("status", "^error: ", "").alias("message")
    )


PLOT_OVERHEAD = 10 * 1024 * 1024
CHANNEL_RATIO, PADDING_INFLATION = 4.0 / 3.0, 1.2


def output_size(
    tasks: DataFrame, pairs: DataFrame, save_all_intermediates: bool = False, n_scale_methods: int = 1, checkpoint_format: str = "tiff"
) -> DataFrame:
    """Estimated bytes per task from the size of its post file; 0 where the pair is not resolvable."""
    n = 4 + max(1, n_scale_methods) + (1 if save_all_intermediates else 0)
    n *= 2 if checkpoint_format == "both" else 1
    usable = pairs.filter("n_pre > 0 and n_post > 0").select("sample", "dye", "post_length")
    each = F.floor(F.col("post_length") * F.lit(CHANNEL_RATIO) * F.lit(PADDING_INFLATION)).cast("bigint")
    return tasks.join(usable, ["sample", "dye"], "left").select(
        "sample", "dye", F.coalesce(n * each + PLOT_OVERHEAD, F.lit(0)).alias("bytes")
    )


def output_size_totals(per_task: DataFrame) -> DataFrame:
    return per_task.agg(
        F.sum("bytes").alias("total_bytes"), F.count("*").alias("n_tasks"), F.count_if(F.col("bytes") > 0).alias("n_resolvable")
    )


def peak_memory(frames: DataFrame, pad: int = 2000, n_workers: int = 1, peak_factor: float = 4.0) -> DataFrame:
    """Peak bytes per frame size and over all tasks; several workers may each hold the worst one."""
    one = F.floor((F.col("height") + 2 * pad).cast("bigint") * (F.col("width") + 2 * pad) * 4 * peak_factor).cast("bigint")
    return frames.agg(
        F.coalesce(F.max(one), F.lit(0)).alias("peak_bytes"),
        (F.coalesce(F.max(one), F.lit(0)) * max(1, n_workers)).alias("concurrent_peak_bytes"),
    )


def budget_bands(estimates: DataFrame, bytes_col: str, budget: Column | int, force: bool = False) -> DataFrame:
    """I16: ok up to 80 %, warn up to 100 %, fail above (forced instead if force)."""
    share = F.col(bytes_col) / budget
    band = F.when(share > 1.0, "forced" if force else "fail").when(share > 0.8, "warn").otherwise("ok")
    return estimates.withColumn("fraction", share).withColumn("band", band).withColumn("size_text", human_bytes(F.col(bytes_col)))


class BudgetError(RuntimeError):
    """An estimate exceeds its budget."""


def preflight(estimates: DataFrame, bytes_col: str, budget: int, force: bool = False) -> DataFrame:
    """I16: the bands, or an error if an estimate exceeds the budget and force is not set."""
    bands = budget_bands(estimates, bytes_col, budget, force)
    over = bands.filter("band = 'fail'").limit(1).collect()
    if over:
        raise BudgetError(f"estimated {over[0]['size_text']} exceeds the budget; reduce pad or workers, or force the run")
    return bands


def append_log(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Add rows (seq, ts, section, line) to the run log."""
    rows.select("seq", "ts", "section", "line").write.mode("append").parquet(path)


def log_tail(log: DataFrame, n: int = 500) -> DataFrame:
    """The last n lines; a top-k, no full sort."""
    return log.orderBy(F.col("seq").desc()).limit(n)


def clear_log(log_path: str, spark: SparkSession) -> None:
    """Empty the log."""
    from ..schemas import RUN_LOG

    spark.createDataFrame([], RUN_LOG).select("seq", "ts", "section", "line").write.mode("overwrite").parquet(log_path)


def mixed_formats(manifest: DataFrame, wanted: str) -> DataFrame:
    """Tasks that already hold a format the run will not write; wanted is tiff, fits or both."""
    formats = ["tiff", "fits"] if wanted == "both" else [wanted]
    found = manifest.groupBy("sample", "dye").agg(F.array_sort(F.collect_set("fmt")).alias("_found"))
    other = F.array_except("_found", F.array(*[F.lit(f) for f in formats]))
    return found.filter(F.size(other) > 0).select(
        "sample", "dye", F.array_join("_found", ",").alias("present"), F.array_join(other, ",").alias("unexpected")
    )
