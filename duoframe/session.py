"""Session helpers: shared work folder, written intermediates, joins to small tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOCAL_DIRS: dict[str, str] = {}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "6g") -> SparkSession:
    """Session for tests and the bench; on a cluster use the session it provides."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("duoframe")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def work_dir(spark: SparkSession) -> str:
    """Shared folder for intermediates, as the session names it in spark.checkpoint.dir.

    Only a local[...] session without that setting gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if sc.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[sc.applicationId] = tempfile.mkdtemp(prefix="spark-duoframe-")
    return _LOCAL_DIRS[sc.applicationId]


def pin(df: DataFrame) -> DataFrame:
    """Write df to the shared work folder and read it back.

    This cuts the lineage, survives the loss of executors, and gives Catalyst the
    real size of the table, so that a later join broadcasts it only while it is
    below spark.sql.autoBroadcastJoinThreshold and sort-merges beyond that.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def attach(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join a per-group table (one row per group) to a large table on keys.

    The small side is pinned first: its join strategy follows from its measured size.
    """
    return big.join(pin(small), list(keys), how)


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence, amount: str, name: str) -> DataFrame:
    """Add the sum of amount up to and with each row of its group, in the given order.

    Ranges of (keys, order) are summed first, each range starts from the sums of the ranges
    before it, and only the inside of a range is a window; so no group, however large, is one
    task. Rows that are equal in keys and order share a range.
    """
    keys = list(keys)
    ranged = pin(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy(*keys, "_range").agg(F.sum(amount).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*keys, "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged.withColumn(name, F.sum(amount).over(inside)).join(
        before.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_range").alias("_of_range"), "_before"),
        on=[F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys] + [F.col("_range") == F.col("_of_range")],
    )
    return joined.withColumn(name, F.col(name) + F.col("_before")).select(*df.columns, name)


def is_empty(df: DataFrame) -> bool:
    return len(df.limit(1).take(1)) == 0


def union_all(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def size_columns(df: DataFrame, shape, keys: Sequence[str]) -> DataFrame:
    """Add height and width: from a constant (H, W) or from a frames table with one row per group."""
    if isinstance(shape, DataFrame):
        on = [k for k in keys if k in shape.columns]
        return df.join(shape.select(*on, "height", "width"), on)
    return df.withColumn("height", F.lit(int(shape[0]))).withColumn("width", F.lit(int(shape[1])))
