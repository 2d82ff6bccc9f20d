"""Text expressions: file names, number formats, byte sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expressions import let

TIFF_PATTERN = r"(?i)\.tiff?$"


def is_tiff(name: Column) -> Column:
    """A1: name ends in .tif or .tiff, in any case."""
    return name.rlike(TIFF_PATTERN)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, TIFF_PATTERN, "")


def general_format(x: Column) -> Column:
    """Six significant digits without trailing zeros; exponent form below 1e-4 and from 1e6 on."""
    strip = lambda t: F.regexp_replace(F.regexp_replace(t, r"0+$", ""), r"\.$", "")

    def write(p: Column) -> Column:
        digits, exp = p["digits"], p["exp"].cast("int")
        large = F.concat(F.substr(digits, F.lit(1), exp + 1), F.lit("."), F.substr(digits, exp + 2))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exp - 1), digits)
        mantissa = strip(F.concat(F.substr(digits, F.lit(1), F.lit(1)), F.lit("."), F.substr(digits, F.lit(2))))
        return (
            F.when((exp < -4) | (exp >= 6), F.concat(mantissa, F.lit("e"), p["exp"]))
            .when(exp >= 0, strip(large)).otherwise(strip(small))
        )

    parts = lambda sci: F.struct(
        F.regexp_replace(F.substring_index(sci, "e", 1), r"\.", "").alias("digits"), F.substring_index(sci, "e", -1).alias("exp")
    )
    body = let(let(F.format_string("%.5e", F.abs(x)), parts), write)
    return F.concat(F.when(x < 0, "-").otherwise(""), F.when(x == 0, "0").otherwise(body))


def human_bytes(n: Column) -> Column:
    """Whole bytes, then one decimal in KB, MB, GB, TB, PB; '?' for NULL."""
    units = ["KB", "MB", "GB", "TB"]
    x = n.cast("double")
    # one decimal, exact halves to the even digit
    tenth = lambda unit, i: F.format_string(f"%.1f {unit}", F.rint(x / 1024.0**i * 10) / 10)
    out = F.when(n.isNull(), F.lit("?")).when(x < 1024, F.format_string("%d B", n.cast("bigint")))
    for i, u in enumerate(units, start=1):
        out = out.when(x < 1024.0 ** (i + 1), tenth(u, i))
    return out.otherwise(tenth("PB", 5))
