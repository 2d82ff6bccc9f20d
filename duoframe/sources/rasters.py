"""8-bit rasters as pixel rows, channel survey, channel pick and split."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import attach, pin, size_columns
from . import tiff

IMAGE_PIXELS = "path string, height int, width int, r int, c int, ch string, v int"
ROWS_PER_BATCH = 64


def _listed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Paths of the files; their content is not read. Spark's listing leaves out files of length 0."""
    return spark.read.format("binaryFile").load(path).select("path")


def raster_frames(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A3: one row per file: path, height, width, channels, error; black frames have their size, damaged files an error."""
    return tiff.raster_sizes(_listed(spark, path))


def read_raster(spark: SparkSession, path: str | list[str], piece: int = tiff.PIECE) -> DataFrame:
    """A3: pixels of 8-bit gray or RGB TIFF files of any size, one row per pixel and channel, zeros left out, and errors.

    A file is read by byte ranges in strips or tiles, each by its own task if there are enough
    (uncompressed strips in pieces of `piece` bytes). A strip that cannot be read is one row
    with its first row number and an error, a file with an unreadable header one row with an
    error only; pixels have the error null.
    """
    return tiff.pixels_of(tiff.segments_of(_listed(spark, path), piece))


def decode_raster(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A3: the pixels alone."""
    return read_raster(spark, path).filter("error is null").drop("error")


def decode_images(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Pixels of whole images of any format that Spark's image source reads, one file a record."""
    img = spark.read.format("image").option("dropInvalid", "true").load(path)
    # local paths in the form the file listing uses
    origin = F.regexp_replace("image.origin", "^file:/+", "file:/").alias("origin")
    return img.select(origin, "image.height", "image.width", "image.nChannels", "image.data").mapInPandas(_explode_bytes, IMAGE_PIXELS)


def _explode_bytes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            flat = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.nChannels)
            # colour bytes come in the order blue, green, red
            names = ["gray"] if row.nChannels == 1 else ["B", "G", "R", "ch3"][: row.nChannels]
            for top in range(0, row.height, ROWS_PER_BATCH):
                part = flat[top: top + ROWS_PER_BATCH]
                r, c, k = np.nonzero(part)
                yield pd.DataFrame({
                    "path": row.origin, "height": np.int32(row.height), "width": np.int32(row.width),
                    "r": (r + top).astype(np.int32), "c": c.astype(np.int32),
                    "ch": np.array(names, dtype=object)[k], "v": part[r, c, k].astype(np.int32),
                })


def decode_frames(spark: SparkSession, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gray pixel rows of the listed files (path, r, c, v after the channel pick), and their frames (path, height, width, error).

    The list stays a table; every file is decoded once. A file with damaged strips has an
    error in its frame and no pixels.
    """
    segments = pin(tiff.segments_of(paths.select("path").distinct()))
    decoded = pin(tiff.pixels_of(segments))
    sizes = segments.groupBy("path").agg(F.max("height").alias("height"), F.max("width").alias("width"))
    errors = decoded.filter("error is not null").groupBy("path").agg(F.concat(F.min("error"), F.lit(": "), F.count("*").cast("string")).alias("error"))
    frames = pin(sizes.join(errors, "path", "left"))
    good = frames.filter("error is null").select("path", "height", "width")
    rgb = attach(decoded.filter("error is null").select("path", "r", "c", "ch", "v"), good.select("path"), ["path"], "left_semi")
    return pick_signal_channel(rgb, ["path"], good), frames


def channel_survey(px_rgb: DataFrame, keys: Sequence[str], shape, crop_size: int = 1000) -> DataFrame:
    """Maximum, mean and non-zero count per channel of the centre crop; absent cells are 0."""
    half = crop_size // 2
    sized = size_columns(px_rgb, shape, keys)
    mid = lambda n: F.floor(F.col(n) / 2).cast("int")
    r0, r1 = F.greatest(mid("height") - half, F.lit(0)), F.least(mid("height") + half, F.col("height"))
    c0, c1 = F.greatest(mid("width") - half, F.lit(0)), F.least(mid("width") + half, F.col("width"))
    inside = (F.col("r") >= r0) & (F.col("r") < r1) & (F.col("c") >= c0) & (F.col("c") < c1)
    v = F.when(inside, F.col("v")).otherwise(0)
    return sized.groupBy(*keys, "ch").agg(
        F.max(v).alias("max"),
        (F.sum(v.cast("double")) / F.max((r1 - r0).cast("bigint") * (c1 - c0))).alias("mean"),
        F.count_if(v != 0).alias("nonzero"),
    )


def channel_index(ch: str = "ch"):
    c = F.col(ch)
    return F.when(c.isin("R", "gray"), 0).when(c == "G", 1).when(c == "B", 2).otherwise(
        F.expr(f"try_cast(substring({ch}, 3) as int)")
    )


def pick_signal_channel(px_rgb: DataFrame, keys: Sequence[str], shape, min_mean: float = 0.5) -> DataFrame:
    """One gray frame from the channels whose mean over the whole image exceeds min_mean.

    No such channel: the one with the highest mean (the first on a tie). Several: their
    sum, clipped to 0..255.
    """
    keys = list(keys)
    cells = F.max(F.col("height").cast("bigint") * F.col("width"))
    means = size_columns(px_rgb, shape, keys).groupBy(*keys, "ch").agg((F.sum(F.col("v").cast("double")) / cells).alias("mean"))
    per_frame = means.groupBy(*keys).agg(
        F.count_if(F.col("mean") > min_mean).alias("_n"),
        F.max_by("ch", F.struct(F.col("mean"), -channel_index())).alias("_best"),
    )
    active = means.join(per_frame, keys).filter(
        ((F.col("_n") > 0) & (F.col("mean") > min_mean)) | ((F.col("_n") == 0) & (F.col("ch") == F.col("_best")))
    ).select(*keys, "ch")
    return (
        attach(px_rgb, active, [*keys, "ch"], "left_semi")
        .groupBy(*keys, "r", "c")
        .agg(F.least(F.lit(255.0), F.floor(F.sum("v")).cast("double")).alias("v"))
    )


# Names of the split planes.
PLANES = {"RED1": "R", "GREEN2": "G", "BLUE3": "B"}


def split_channels(px_rgb: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One column per plane."""
    plane = lambda ch: F.coalesce(F.max(F.when(F.col("ch") == ch, F.col("v"))), F.lit(0))
    return px_rgb.groupBy(*keys, "r", "c").agg(*[plane(ch).alias(n) for n, ch in PLANES.items()])
