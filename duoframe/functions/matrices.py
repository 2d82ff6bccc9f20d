"""3x3 transforms as ARRAY<DOUBLE> of nine row-major values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expressions import let


def at(m: Column, i: int, j: int) -> Column:
    return F.get(m, F.lit(3 * i + j))


def matrix(*rows: list) -> Column:
    return F.array(*[(x if isinstance(x, Column) else F.lit(float(x))).cast("double") for row in rows for x in row])


def identity() -> Column:
    return matrix([1, 0, 0], [0, 1, 0], [0, 0, 1])


def compose(a: Column, b: Column) -> Column:
    """matrix product a * b."""
    def product(p: Column) -> Column:
        x, y = p["x"], p["y"]
        return F.array(*[
            at(x, i, 0) * at(y, 0, j) + at(x, i, 1) * at(y, 1, j) + at(x, i, 2) * at(y, 2, j)
            for i in range(3) for j in range(3)
        ])

    return let(F.struct(a.alias("x"), b.alias("y")), product)


def invert(m: Column) -> Column:
    """inverse by cofactors, scaled so that the last entry is 1; entries of null where there is none."""
    def cofactors(v: Column) -> Column:
        def minor(i: int, j: int) -> Column:
            r = [x for x in range(3) if x != i]
            c = [x for x in range(3) if x != j]
            return (at(v, r[0], c[0]) * at(v, r[1], c[1]) - at(v, r[0], c[1]) * at(v, r[1], c[0])) * ((-1) ** (i + j))

        return F.array(*[minor(j, i) for i in range(3) for j in range(3)])

    return let(let(m, cofactors), lambda adj: F.transform(adj, lambda x: F.try_divide(x, at(adj, 2, 2))))


def rescale(m: Column, factor: Column | float) -> Column:
    """S * m * S^-1 with S = diag(factor, factor, 1): the same map on a grid finer by factor."""
    f = factor if isinstance(factor, Column) else F.lit(float(factor))
    return let(m, lambda v: F.array(
        at(v, 0, 0), at(v, 0, 1), at(v, 0, 2) * f,
        at(v, 1, 0), at(v, 1, 1), at(v, 1, 2) * f,
        at(v, 2, 0) / f, at(v, 2, 1) / f, at(v, 2, 2),
    ))


def translation(dx: Column | float, dy: Column | float) -> Column:
    return matrix([1, 0, dx], [0, 1, dy], [0, 0, 1])


def rotation_about(angle_deg: Column | float, scale: Column | float, cx: Column | float, cy: Column | float) -> Column:
    """Forward map that turns by angle (counter-clockwise on screen) and scales about a pivot."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    t, s, cx, cy = F.radians(as_col(angle_deg)), as_col(scale), as_col(cx), as_col(cy)
    a, b = s * F.cos(t), s * F.sin(t)
    return matrix([a, b, (1 - a) * cx - b * cy], [-b, a, b * cx + (1 - a) * cy], [0, 0, 1])


def similarity_inverse_map(
    angle_deg: Column, scale: Column, cx: Column, cy: Column, dx: Column, dy: Column, coarse_scale: float
) -> Column:
    """full-resolution inverse map of a coarse search hit.

    The search turned and scaled the pre image about (cx, cy) and found it displaced by
    (dx, dy) against the post image. A post position is therefore shifted by (dx, dy)
    and then taken back through the inverse of the turn.
    """
    t = F.radians(angle_deg)
    a, b = F.cos(t) / scale, F.sin(t) / scale
    lift = 1.0 / coarse_scale
    return matrix(
        [a, -b, (cx + a * (dx - cx) - b * (dy - cy)) * lift],
        [b, a, (cy + b * (dx - cx) + a * (dy - cy)) * lift],
        [0, 0, 1],
    )


def decompose(m: Column) -> dict[str, Column]:
    """angle (degrees), axis scales, shear, perspective size and shift."""
    a, b, c, d = at(m, 0, 0), at(m, 0, 1), at(m, 1, 0), at(m, 1, 1)
    sx, sy = F.sqrt(a * a + c * c), F.sqrt(b * b + d * d)
    return {
        "angle": F.degrees(F.atan2(c, a)),
        "scale_x": sx,
        "scale_y": sy,
        "shear": (a * b + c * d) / (sx * sy),
        "perspective": F.sqrt(at(m, 2, 0) * at(m, 2, 0) + at(m, 2, 1) * at(m, 2, 1)),
        "dx": at(m, 0, 2),
        "dy": at(m, 1, 2),
    }


def project(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    w = at(m, 2, 0) * x + at(m, 2, 1) * y + at(m, 2, 2)
    return (
        (at(m, 0, 0) * x + at(m, 0, 1) * y + at(m, 0, 2)) / w,
        (at(m, 1, 0) * x + at(m, 1, 1) * y + at(m, 1, 2)) / w,
    )
