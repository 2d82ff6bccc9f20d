"""Shards by jump consistent hashing: the key and the number of shards decide, no ring table is kept."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import pin


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key; with one more shard a key stays or moves into the new one."""
    state = keys.astype(np.uint64)
    shard = np.zeros(len(state), np.int64)
    going = np.arange(len(state))
    while len(going):
        # the multiplier of the generator that the method is defined with is a fixed value
        state[going] = state[going] * np.uint64(2862933555777941757) + np.uint64(1)
        step = float(1 << 31) / ((state[going] >> np.uint64(33)) + np.uint64(1)).astype(float)
        target = np.floor((shard[going] + 1) * step)
        going = going[target < shards]
        shard[going] = target[target < shards].astype(np.int64)
    return shard


def key_of(docs: DataFrame, column: str):
    """The 64-bit key of a column: whole numbers as they are, anything else hashed; null is key 0."""
    kind = docs.schema[column].dataType
    value = F.col(column).cast("long") if isinstance(kind, T.IntegralType) else F.xxhash64(column)
    return F.when(F.isnull(column), F.lit(0)).otherwise(value)


def shard(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Put every row into one of `shards` shards by its key, with a gapless place in the shard.

    Returns doc_id, size (UTF-8 bytes of the text, null: none, plus 16), text_crc32, law
    ("key"), shard, slot (from 0 in each shard, by key, text_crc32 and size), grown_shard (the
    shard if there were one more). Null keys share a shard; equal keys always do; equal rows
    get different slots; an empty table gives no rows; other columns are not read.

    Slots come from a range partitioning by key and the counts of each shard in each range, so
    no shard and no frequent key is gathered in one task.
    """

    @F.pandas_udf("struct<shard: int, grown_shard: int>")
    def put(keys: pd.Series) -> pd.DataFrame:
        values = keys.to_numpy().astype(np.int64).view(np.uint64)
        return pd.DataFrame({"shard": jump_hash(values, shards).astype(np.int32), "grown_shard": jump_hash(values, shards + 1).astype(np.int32)})

    whole = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(key).alias("doc_id"), key_of(docs, key).alias("key"), (F.octet_length(whole) + 16).cast("long").alias("size"),
        F.crc32(whole).alias("text_crc32"), F.monotonically_increasing_id().alias("row"),
    )
    placed = pin(rows.select("*", put("key").alias("to")).select("*", "to.*").drop("to", "key"))
    order = ["doc_id", "text_crc32", "size"]
    ranged = pin(placed.repartitionByRange(*order, "row").withColumn("part", F.spark_partition_id()))
    counts = ranged.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("shard", "part").orderBy(*order, "row")) - 1
    return ranged.withColumn("nth", nth).join(before, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("nth")).alias("slot"), "grown_shard",
    )
