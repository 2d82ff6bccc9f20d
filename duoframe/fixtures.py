"""Derived views over the given tables: paired measurements, frames, file names, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.percentiles import percentiles
from .session import attach, pin

PX_SHAPE = (128, 128)  # size of the v_px frames
LEVELS = 256           # v_px and v_grid hold 8-bit values


class Tables:
    """Lazy reader of the parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def v_ratio(t: Tables) -> DataFrame:
    li, part = t("lineitem"), t("part")
    return li.join(part, li.l_partkey == part.p_partkey).select(
        F.col("l_returnflag").alias("sample"),
        F.col("l_linestatus").alias("dye"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("post"),
        F.col("p_retailprice").alias("pre"),
    )


def v_ratio_stored(t: Tables) -> DataFrame:
    """v_ratio written once, for operators that pass over the pairs several times."""
    return pin(v_ratio(t))


def _px_rows(t: Tables) -> DataFrame:
    return t("lineitem").select(
        F.col("l_returnflag").alias("sample"),
        F.when(F.col("l_linestatus") == "F", "post").otherwise("pre").alias("kind"),
        (F.col("l_orderkey") % 128).cast("int").alias("r"),
        ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % 128).cast("int").alias("c"),
        F.col("l_quantity").alias("q"),
    )


def v_px(t: Tables) -> DataFrame:
    """Frames as stored pixels: written once, because most operators read them several times."""
    return pin(
        _px_rows(t).groupBy("sample", "kind", "r", "c").agg(F.least(F.lit(255.0), F.sum("q")).alias("v"))
    )


def v_px_wrapped(t: Tables) -> DataFrame:
    """The frames of v_px with sums that start again at 256: they keep their detail where v_px is 255 in every cell."""
    return pin(_px_rows(t).groupBy("sample", "kind", "r", "c").agg(F.pmod(F.sum("q"), F.lit(256.0)).alias("v")))


def v_grid(t: Tables) -> DataFrame:
    return t("embeddings").select(
        "vec_id", F.posexplode("embedding").alias("pos", "e")
    ).select(
        F.when(F.col("vec_id") % 2 == 0, "post").otherwise("pre").alias("kind"),
        F.floor(F.col("vec_id") / 2).cast("int").alias("r"),
        F.col("pos").cast("int").alias("c"),
        F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor(F.col("e").cast("double") * 512).cast("double"))).alias("v"),
    )


def v_rgb(t: Tables) -> DataFrame:
    k = F.col("l_suppkey") % 3
    gain = (
        F.when(k == 0, F.col("l_quantity"))
        .when((k == 1) & (F.col("l_returnflag") == "A"), F.col("l_quantity"))
        .otherwise(F.col("l_discount"))
    )
    return (
        t("lineitem")
        .groupBy(
            F.concat("l_returnflag", "l_linestatus").alias("frame_id"),
            (F.col("l_orderkey") % 64).cast("int").alias("r"),
            (F.col("l_partkey") % 64).cast("int").alias("c"),
            F.when(k == 0, "R").when(k == 1, "G").otherwise("B").alias("ch"),
        )
        # as decimals, since a sum of doubles next to a whole number would depend on the order of the rows
        .agg(F.least(F.lit(255), F.floor(F.sum(gain.cast("decimal(18,6)"))).cast("int")).alias("v"))
    )


def v_mask(t: Tables) -> DataFrame:
    px = v_px(t)
    cut = percentiles(px, ["sample", "kind"], "v", {"t": 0.95}, levels=LEVELS)
    return attach(px, cut, ["sample", "kind"]).filter("v >= t").select("sample", "kind", "r", "c")


def v_files(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    stem = F.concat(F.lit("F"), d.cast("string"))
    quarter = F.floor(d / 4).cast("bigint")
    third = F.floor(d / 2).cast("bigint") % 3
    good = F.concat(
        stem,
        F.when(d % 2 == 0, "_PreStain_").otherwise("_PostStain_"),
        F.when(quarter % 5 == 0, "DAPI").when(third == 0, "DAPI").when(third == 1, "Cy5").otherwise("SybrGld"),
        F.when(d % 3 == 0, ".TIFF").otherwise(".tif"),
    )
    basename = (
        F.when(d % 11 == 0, F.concat(stem, F.lit("_PrePost_DAPI.tif")))
        .when(d % 11 == 1, F.concat(stem, F.lit("_DAPI.tif")))
        .when(d % 11 == 2, F.concat(stem, F.lit("PreDAPI.tif")))
        .when(d % 11 == 3, F.concat(stem, F.lit("_pre_.tif")))
        .when(d % 11 == 4, F.concat(stem, F.lit("_pre_DAPI.txt")))
        .otherwise(good)
    )
    sample = F.concat(F.lit("S"), quarter.cast("string"))
    return t("documents").select(
        sample.alias("sample"),
        F.concat(F.lit("raw/"), sample, F.lit("/"), basename).alias("path"),
        basename.alias("basename"),
        F.col("n_chars").alias("length"),
    )


def v_match(t: Tables) -> DataFrame:
    x, y, tax = F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax")
    return t("lineitem").select(
        F.col("l_returnflag").alias("pair_id"),
        x.alias("x"),
        y.alias("y"),
        (1.02 * x - 0.05 * y + 3 + tax).alias("u"),
        (0.04 * x + 0.98 * y - 2 - tax).alias("w"),
    )


def v_result(t: Tables) -> DataFrame:
    s = F.col("o_orderstatus")
    return t("orders").select(
        F.concat(F.lit("S"), F.col("o_custkey").cast("string")).alias("sample"),
        F.col("o_orderpriority").alias("dye"),
        F.when(s != "F", F.col("o_totalprice") / 100000).alias("scale_estimate"),
        F.when(s == "F", "error: no raw files").when(s == "O", "complete").otherwise("stopped early").alias("status"),
    )


def v_manifest(t: Tables) -> DataFrame:
    n, r, s = t("nation"), t("region"), t("supplier")
    k = F.col("s_suppkey")
    return (
        s.join(n, s.s_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .select(
            F.col("n_name").alias("sample"),
            F.col("r_name").alias("dye"),
            (k % 4 + 1).cast("int").alias("stage"),
            F.when(k % 4 == 3, "difference").when(k % 8 == 0, "post").otherwise("pre").alias("name"),
            F.when(k % 5 == 0, "fits").otherwise("tiff").alias("fmt"),
        )
        .distinct()
    )


def v_log(t: Tables) -> DataFrame:
    return t("events").select(
        F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("section"), F.col("props").alias("line")
    )


def v_params(t: Tables) -> DataFrame:
    """Run parameters (run_id, name, value) derived from the parts table."""
    k = F.col("p_partkey")
    rows = [
        (F.lit("boundary_width"), F.col("p_size").cast("string")),
        (F.lit("angle_range"), (20 + k % 3).cast("string")),
        (F.lit("scale_min"), F.when(k % 4 == 0, "0.8").when(k % 4 == 1, "0.85").otherwise("0.9125")),
        (F.lit("use_edges"), F.when(k % 2 == 0, "true").otherwise("false")),
        (F.lit("stopdelta"), F.when(k % 3 == 0, "1e-06").otherwise("0.0000125")),
        (F.lit("interior_blur_base"), F.when(k % 5 == 0, "8").otherwise("12.50")),
        (F.lit("manual_scale"), F.when(k % 7 != 0, F.col("p_retailprice").cast("string"))),
    ]
    base = t("part").select(
        k.alias("run_id"), F.explode(F.array(*[F.struct(n.alias("name"), v.alias("value")) for n, v in rows])).alias("p"),
    ).select("run_id", "p.name", "p.value")
    typos = t("part").filter(k % 17 == 0).select(k.alias("run_id"), F.col("p_brand").alias("name"), F.lit("1").alias("value"))
    return base.unionByName(typos)
