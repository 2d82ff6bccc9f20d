"""Stage rasters as partitioned Parquet, with manifest and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.params import non_default
from ..session import is_empty

PARTITIONS = ["sample", "dye", "stage", "name", "suffix"]
# Folder names of the stages.
STAGE_NAMES = {1: "01_padded", 2: "02_icp_aligned", 3: "03_interior_aligned", 4: "04_difference"}


def stage_name(stage: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in STAGE_NAMES.items() for x in kv]), stage)


def write_stage(px: DataFrame, path: str, stage: int, name: str, suffix: str = "") -> None:
    """Write pixels as 4-byte floats; only the partitions present in px are replaced.

    Rows are laid out by pair and 512-pixel tile row, so that crops prune row groups and
    a very large frame is written by many tasks.
    """
    out = px.select(
        "sample", "dye", F.lit(stage).alias("stage"), F.lit(name).alias("name"),
        F.lit(suffix or "_").alias("suffix"), "r", "c", F.col("v").cast("float").alias("v"),
    )
    (
        out.repartition("sample", "dye", F.floor(F.col("r") / 512)).sortWithinPartitions("sample", "dye", "r", "c")
        .write.partitionBy(*PARTITIONS).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    )


SCHEMA = "sample string, dye string, stage int, name string, suffix string, r int, c int, v float"


def read_stage(
    spark: SparkSession, path: str, stage: int, name: str, suffix: str = "", sample: str | None = None, dye: str | None = None
) -> DataFrame | None:
    """Pixels of one stage raster through partition filters, or None if there are none."""
    try:
        px = spark.read.schema(SCHEMA).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    px = px.filter((F.col("stage") == stage) & (F.col("name") == name) & (F.col("suffix") == (suffix or "_")))
    if sample is not None:
        px = px.filter(F.col("sample") == sample)
    if dye is not None:
        px = px.filter(F.col("dye") == dye)
    return None if is_empty(px) else px.select("sample", "dye", "r", "c", F.col("v").cast("double").alias("v"))


def manifest_from_store(spark: SparkSession, path: str) -> DataFrame:
    """Which (sample, dye, stage, name, suffix) exist: the partition values of the files, no column is decoded."""
    return spark.read.schema(SCHEMA).parquet(path).select(*PARTITIONS).distinct()


def provenance(runs: DataFrame, params: DataFrame, extras: DataFrame | None = None) -> DataFrame:
    """Header rows of written rasters.

    runs: run_id, sample, dye, stage, created. params: run_id, name, value (long form).
    extras: run_id, key, value. Only parameters that differ from their default and act at
    or before the stage of the raster are listed.
    """
    base = runs.select(
        "run_id", "sample", "dye", "stage",
        F.explode(F.array(
            _header("SAMPLE", F.col("sample"), "sample of the frame"),
            _header("DYE", F.col("dye"), "dye of the frame"),
            _header("STAGE", stage_name(F.col("stage")), "stage that wrote it"),
            _header("CREATED", F.date_format("created", "yyyy-MM-dd'T'HH:mm:ss"), "time of writing"),
        )).alias("h"),
    ).select("run_id", "sample", "dye", "stage", "h.key", "h.value", "h.comment")
    own = runs.select("run_id", "sample", "dye", "stage")
    changed = non_default(params).join(own.withColumnRenamed("stage", "at_stage"), "run_id").filter("stage <= at_stage").select(
        "run_id", "sample", "dye", F.col("at_stage").alias("stage"), F.upper("abbrev").alias("key"),
        F.coalesce("value", F.lit("None")).alias("value"), F.col("name").alias("comment"),
    )
    out = base.unionByName(changed)
    if extras is not None:
        out = out.unionByName(
            extras.join(own, "run_id").select(
                "run_id", "sample", "dye", "stage", F.upper(F.substring("key", 1, 8)).alias("key"),
                F.substring("value", 1, 68).alias("value"), F.lit("").alias("comment"),
            )
        )
    return out


def _header(key: str, value: Column, comment: str) -> Column:
    return F.struct(F.lit(key).alias("key"), value.alias("value"), F.lit(comment).alias("comment"))
