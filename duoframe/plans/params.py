"""Run parameters as tables: registry, checks, file suffixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import general_format
from ..schemas import PARAM_REGISTRY

# Name, default, type, abbreviation, stage, description.
PARAMETERS = [
    ("pad", "2000", "int", "pad", 1, "zero margin added on every side"),
    ("use_edges", "true", "bool", "ue", 2, "coarse search on outline rings"),
    ("boundary_width", "15", "int", "bw", 2, "ring thickness on the coarse grid"),
    ("boundary_smooth", "10", "int", "bs", 2, "softening sigma of the ring"),
    ("rotation_search", "true", "bool", "rs", 2, "search over angles"),
    ("angle_range", "20", "int", "ar", 2, "largest searched angle in degrees"),
    ("angle_step", "1", "int", "astep", 2, "angle step in degrees"),
    ("scale_search", "true", "bool", "ss", 2, "search over scales"),
    ("scale_min", "0.85", "float", "smin", 2, "smallest searched scale"),
    ("scale_max", "1.15", "float", "smax", 2, "largest searched scale"),
    ("scale_step", "0.05", "float", "sstep", 2, "scale step"),
    ("multiscale", "true", "bool", "ms", 2, "coarse search before the point refinement"),
    ("down_scale", "0.3", "float", "ds", 2, "factor of the registration views"),
    ("max_translation", "200", "int", "mtr", 2, "largest accepted shift in pixels"),
    ("max_rotation", "5.0", "float", "mrot", 2, "largest accepted turn in degrees"),
    ("max_scale_delta", "0.2", "float", "msd", 2, "largest accepted scale change"),
    ("max_scale_diff", "0.15", "float", "msdf", 2, "largest accepted difference of the axis scales"),
    ("save_all_intermediates", "false", "bool", "sai", 2, "keep every alignment step"),
    ("fine_ecc", "false", "bool", "fecc", 2, "optional fine pass"),
    ("stopit", "500", "int", "sit", 2, "iteration limit of the fine pass"),
    ("stopdelta", "1e-06", "float", "sdl", 2, "stop threshold of the fine pass"),
    ("interior_ecc", "true", "bool", "iecc", 3, "refine on interior features"),
    ("interior_blur_base", "8.0", "float", "iblur", 3, "blur before feature detection"),
    ("interior_max_correction", "500", "int", "imc", 3, "largest accepted correction in pixels"),
    ("interior_min_inlier_ratio", "0.4", "float", "imir", 3, "smallest accepted inlier share"),
    ("scale_percentile", None, "none", "sp", 4, "also subtract with this ratio percentile"),
    ("manual_scale", None, "none", "msc", 4, "also subtract with this scale"),
]
MAX_STAGE = 4
# Display groups.
GROUPS = {
    1: "Stage 1 — Padding",
    2: "Stage 2 — Boundary + ICP",
    3: "Stage 3 — Interior SIFT",
    4: "Stage 4 — Diagnostics & subtraction",
}
FINE_GROUP = "Stage 2.5 — Fine ECC (optional)"
FINE_PARAMETERS = ("fine_ecc", "stopit", "stopdelta")


def registry(spark: SparkSession, extra: list[tuple] = ()) -> DataFrame:
    """One row per parameter; extra rows of the same form add parameters of the user."""
    rows = [
        (i, n, d, ty, ab, st, FINE_GROUP if n in FINE_PARAMETERS else GROUPS.get(st, f"Stage {st}"), ds)
        for i, (n, d, ty, ab, st, ds) in enumerate([*PARAMETERS, *extra])
    ]
    return spark.createDataFrame(rows, PARAM_REGISTRY)


def defaults() -> dict[str, str | None]:
    return {p[0]: p[1] for p in PARAMETERS}


def defaults_typed() -> dict:
    """Defaults as Python values."""
    read = {"bool": lambda v: v == "true", "int": int, "float": float, "none": lambda v: v}
    return {n: None if d is None else read[ty](d) for n, d, ty, *_ in PARAMETERS}


def stage_of(name: str) -> int:
    return next(p[4] for p in PARAMETERS if p[0] == name)


def to_text(value) -> str | None:
    """Text form of a Python parameter value, as kept in parameter tables."""
    if value is None:
        return None
    return str(value).lower() if isinstance(value, bool) else repr(value) if isinstance(value, float) else str(value)


def params_table(spark: SparkSession, values: dict, run_id: int = 0) -> DataFrame:
    return spark.createDataFrame(
        [(run_id, k, to_text(v)) for k, v in values.items()], "run_id bigint, name string, value string"
    )


def check_params(params: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Rows whose name is unknown or whose value does not fit the type, with the problem."""
    # the own registry is a fixed short list; a caller's table joins by its real size
    reg = F.broadcast(registry(params.sparkSession).select("name", "type")) if known is None else known.select("name", "type")
    v = F.col("value")
    bad = (
        F.when(F.col("type").isNull(), "unknown parameter")
        .when(v.isNull() & (F.col("type") != "none"), "value is missing")
        .when((F.col("type") == "bool") & ~v.isin("true", "false"), "not a boolean")
        .when(F.col("type").isin("int", "float", "none") & v.isNotNull() & F.expr("try_cast(value as double) is null"), "not a number")
    )
    return params.join(reg, "name", "left").withColumn("problem", bad).filter("problem is not null").select(
        *params.columns, "problem"
    )


def require_valid(params: DataFrame) -> DataFrame:
    """Params unchanged, or an error that names the first bad rows."""
    bad = check_params(params).limit(10).collect()
    if bad:
        raise ValueError("; ".join(f"{r['name']}: {r['problem']}" for r in bad))
    return params


def _differs() -> Column:
    num = lambda c: F.expr(f"try_cast({c} as double)")
    same_number = num("value") == num("default")
    return ~F.coalesce(same_number, F.lit(False)) & ~F.col("value").eqNullSafe(F.col("default"))


def non_default(params: DataFrame, stage: int | None = None) -> DataFrame:
    """Parameters that differ from their default, up to a stage, with registry columns."""
    reg = F.broadcast(registry(params.sparkSession).select("ord", "name", "default", "type", "abbrev", "stage"))
    out = params.join(reg, "name").filter(_differs())
    return out if stage is None else out.filter(F.col("stage") <= stage)


def param_token() -> Column:
    """Abbreviation and value as written in file suffixes."""
    v = F.col("value")
    text = (
        F.when(v.isNull(), "none")
        .when(F.col("type") == "bool", F.when(v == "true", "1").otherwise("0"))
        .when(v.rlike(r"[.eE]"), general_format(F.expr("try_cast(value as double)")))
        .otherwise(v)
    )
    return F.concat("abbrev", text)


def build_suffix(params: DataFrame, stage: int) -> DataFrame:
    """I4: run_id and suffix; a run without changed parameters has the empty suffix.

    A run holds at most one value per registry entry, so its token list is short.
    """
    tokens = non_default(params, stage).groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("ord"), param_token().alias("tok")))).alias("_t")
    )
    joined = F.concat(F.lit("_"), F.array_join(F.transform("_t", lambda x: x["tok"]), "_"))
    return params.select("run_id").distinct().join(tokens, "run_id", "left").select(
        "run_id", F.coalesce(joined, F.lit("")).alias("suffix")
    )


def parse_suffix(suffixes: DataFrame) -> DataFrame:
    """run_id, name, value from suffix; the longest matching abbreviation wins.

    The registry has a fixed, short list of abbreviations, so the prefix match is a
    CASE over them in order of length and needs no join.
    """
    by_length = sorted(PARAMETERS, key=lambda p: (-len(p[3]), p[3]))
    tok = F.col("tok")
    which = lambda field: F.coalesce(*[F.when(tok.startswith(p[3]), F.lit(p[field])) for p in by_length])
    parts = suffixes.select("run_id", F.explode(F.split(F.ltrim(F.col("suffix"), F.lit("_")), "_")).alias("tok")).filter("tok <> ''")
    raw = F.substr(tok, F.length("_abbrev") + 1)
    typed = (
        F.when(raw == "none", None).when(F.col("_type") == "bool", F.when(raw == "1", "true").otherwise("false")).otherwise(raw)
    )
    return (
        parts.withColumn("name", which(0)).withColumn("_abbrev", which(3)).withColumn("_type", which(2))
        .filter("name is not null").select("run_id", "name", typed.alias("value"))
    )
