"""Point sets: nearest neighbours, affine fits, iterative closest points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import matrices as M
from ..session import attach, is_empty, pin, running_total
from .percentiles import percentiles


def centroid(px: DataFrame, keys: Sequence[str], shape: tuple[int, int], frames: DataFrame) -> DataFrame:
    """mean position of the listed pixels per frame; the frame centre where there are none."""
    mean = px.groupBy(*keys).agg(F.avg("c").alias("_x"), F.avg("r").alias("_y"))
    return frames.select(*keys).distinct().join(mean, list(keys), "left").select(
        *keys, F.coalesce("_x", F.lit(shape[1] / 2.0)).alias("cx"), F.coalesce("_y", F.lit(shape[0] / 2.0)).alias("cy")
    )


def even_subsample(points: DataFrame, keys: Sequence[str], n: int = 800, order: Sequence[str] = ("r", "c")) -> DataFrame:
    """the points at positions round(linspace(0, N - 1, n)); all points if there are at most n.

    Whether a position is hit follows from its own number, so no index table is joined.
    """
    keys = list(keys)
    num = running_total(points.withColumn("_one", F.lit(1)), keys, list(order), "_one", "_j").withColumn("_j", F.col("_j") - 1).drop("_one")
    num = attach(num, points.groupBy(*keys).agg(F.count("*").alias("_n")), keys)
    step = (F.col("_n") - 1) / F.lit(float(n - 1))
    first = F.floor(F.col("_j") / step)
    hit = lambda i: (i >= 0) & (i <= n - 1) & (F.rint(i * step) == F.col("_j"))
    return num.filter((F.col("_n") <= n) | hit(first) | hit(first + 1) | hit(first - 1)).drop("_j", "_n")


def nearest_neighbours(
    queries: DataFrame, targets: DataFrame, keys: Sequence[str], radius: float | None = None, max_distance: float | None = None,
    max_per_cell: int = 64,
) -> DataFrame:
    """nearest target (t_id, tx, ty, dist) of each query point; the smallest t_id wins a tie.

    queries: keys, q_id, x, y; targets: keys, t_id, x, y. Points meet by an equi-join on
    grid cells and the best one is kept by a map-side combined minimum. Equal targets
    are collapsed first. The cell size of each group starts at the mean spacing of its targets
    (or at radius) and is halved, several times at once where a cell is very full, until no cell of the group holds more than max_per_cell
    different targets, so a hot spot never forms one large group and costs the other groups
    nothing. Queries without a target inside the radius go to another round with three times
    the radius, unless max_distance ends the search. Queries with a missing coordinate, or of a group without
    targets, have no answer: their t_id, tx, ty and dist are null.
    """
    keys = list(keys)
    t = pin(targets.filter("x is not null and y is not null").groupBy(*keys, "x", "y").agg(F.min("t_id").alias("t_id")))
    if max_distance is not None:
        return _within(queries.select(*keys, "q_id", "x", "y"), t, keys, F.lit(float(max_distance)))
    spacing = F.sqrt((F.max("x") - F.min("x") + 1) * (F.max("y") - F.min("y") + 1) / F.count("*"))
    cells = pin(t.groupBy(*keys).agg((1.5 * spacing if radius is None else F.lit(float(radius)) + 0 * F.count("*")).alias("_cell")))
    while True:  # different targets part at some size
        place = [F.floor(F.col(c) / F.col("_cell")).alias(f"_{c}") for c in ("x", "y")]
        crowded = t.join(cells, keys).groupBy(*keys, *place).count().filter(F.col("count") > max_per_cell)
        crowded = pin(crowded.groupBy(*keys).agg(F.max("count").alias("_most")))
        if is_empty(crowded):
            break
        times = F.greatest(F.lit(1.0), F.floor(F.log2(F.col("_most") / max_per_cell) / 2))  # as if the fullest cell were even
        halved = F.when(F.col("_most") > 0, F.col("_cell") / F.pow(F.lit(2.0), times)).otherwise(F.col("_cell"))
        cells = pin(cells.join(crowded, keys, "left").select(*keys, halved.alias("_cell")))
    t = pin(t.join(cells, keys))
    asked = queries.select(*keys, "q_id", "x", "y").withColumn("_ok", F.col("x").isNotNull() & F.col("y").isNotNull())
    asked = pin(asked.join(cells, keys, "left"))
    empty = asked.filter("_cell is null or not _ok").select(
        *keys, "q_id", "x", "y", F.lit(None).cast(t.schema["t_id"].dataType).alias("t_id"), *[F.lit(None).cast("double").alias(n) for n in ("tx", "ty", "dist")])
    left = asked.filter("_cell is not null and _ok").select(*keys, "q_id", "x", "y", "_cell")
    found, factor = empty, 1.0
    while True:
        hits = pin(_within(left, t, keys, F.col("_cell") * factor))
        found = found.unionByName(hits)
        left = pin(left.join(hits.select(*keys, "q_id"), [*keys, "q_id"], "left_anti"))
        if is_empty(left):
            return found
        factor *= 3


def _within(queries: DataFrame, targets: DataFrame, keys: list[str], radius: Column) -> DataFrame:
    """Nearest target within radius, a column of both sides: cells of that size meet their 3 x 3 neighbourhood."""
    cell = lambda c, step=0: (F.floor(F.col(c) / radius) + step).cast("bigint")
    grid = targets.select(*keys, cell("x").alias("_cx"), cell("y").alias("_cy"), "t_id", F.col("x").alias("tx"), F.col("y").alias("ty"))
    around = F.explode(F.array(*[F.struct(cell("x", i).alias("cx"), cell("y", j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    d2 = (F.col("x") - F.col("tx")) * (F.col("x") - F.col("tx")) + (F.col("y") - F.col("ty")) * (F.col("y") - F.col("ty"))
    return (
        queries.withColumn("_a", around).withColumn("_cx", F.col("_a.cx")).withColumn("_cy", F.col("_a.cy")).drop("_a")
        .withColumn("_r", radius)
        .join(grid, [*keys, "_cx", "_cy"]).withColumn("_d2", d2).filter(F.col("_d2") <= F.col("_r") * F.col("_r"))
        .groupBy(*keys, "q_id").agg(F.min(F.struct("_d2", "t_id", "tx", "ty")).alias("_b"), F.first("x").alias("x"), F.first("y").alias("y"))
        .select(*keys, "q_id", "x", "y", "_b.t_id", "_b.tx", "_b.ty", F.sqrt("_b._d2").alias("dist"))
    )


def start_threshold(matches: DataFrame, keys: Sequence[str], low: float = 5.0, high: float = 30.0) -> DataFrame:
    """clip(2 * median distance, low, high) per pair."""
    med = percentiles(matches.filter("dist is not null"), keys, "dist", {"median": 0.5})
    return med.withColumn("threshold", F.least(F.greatest(2 * F.col("median"), F.lit(low)), F.lit(high)))


def affine_from_matches(matches: DataFrame, keys: Sequence[str], extra: Sequence[Column] = ()) -> DataFrame:
    """F8: least-squares map (x, y) -> (u, w): keys, n, m. One aggregation, then a closed form.

    extra are further aggregates to return from the same pass.

    Both outputs share one centred 2x2 normal matrix.
    """
    cov = lambda a, b: F.covar_pop(a, b)
    s = matches.groupBy(*keys).agg(
        F.count("*").alias("n"), *[F.avg(k).alias(f"_m{k}") for k in ("x", "y", "u", "w")],
        cov("x", "x").alias("_xx"), cov("x", "y").alias("_xy"), cov("y", "y").alias("_yy"),
        cov("x", "u").alias("_xu"), cov("y", "u").alias("_yu"), cov("x", "w").alias("_xw"), cov("y", "w").alias("_yw"),
        *extra,
    )
    more = [c for c in s.columns if c not in keys and c != "n" and not c.startswith("_")]
    det = F.col("_xx") * F.col("_yy") - F.col("_xy") * F.col("_xy")
    solve = lambda p, q: (
        (F.col(p) * F.col("_yy") - F.col(q) * F.col("_xy")) / F.col("_det"),
        (F.col(q) * F.col("_xx") - F.col(p) * F.col("_xy")) / F.col("_det"),
    )
    (a, b), (c, d) = solve("_xu", "_yu"), solve("_xw", "_yw")
    s = s.withColumn("_det", F.when(det > 0, det)).withColumn("_a", a).withColumn("_b", b).withColumn("_c", c).withColumn("_d", d)
    e = F.col("_mu") - F.col("_a") * F.col("_mx") - F.col("_b") * F.col("_my")
    f = F.col("_mw") - F.col("_c") * F.col("_mx") - F.col("_d") * F.col("_my")
    m = M.matrix([F.col("_a"), F.col("_b"), e], [F.col("_c"), F.col("_d"), f], [0, 0, 1])
    return s.select(*keys, "n", F.when(F.col("_det").isNotNull(), m).alias("m"), *more)


def _axis_scales(m: Column) -> tuple[Column, Column]:
    """Lengths of the images of the x and y unit vectors."""
    length = lambda j: F.sqrt(M.at(m, 0, j) * M.at(m, 0, j) + M.at(m, 1, j) * M.at(m, 1, j))
    return length(0), length(1)


def _within_limits(m: Column, shift: Column, scale: float) -> Column:
    """Whether both shifts stay under the limit and both axis scales within 1 +- scale."""
    sx, sy = _axis_scales(m)
    return (F.abs(M.at(m, 0, 2)) < shift) & (F.abs(M.at(m, 1, 2)) < shift) & (F.abs(sx - 1) < scale) & (F.abs(sy - 1) < scale)


def _without_scale(fit: DataFrame, name: str, frozen: Column) -> Column:
    """The fitted map with both axis scales set to 1 about the matches' means, where frozen."""
    m, (sx, sy) = F.col(name), _axis_scales(F.col(name))
    a, b, c, d = M.at(m, 0, 0) / sx, M.at(m, 0, 1) / sy, M.at(m, 1, 0) / sx, M.at(m, 1, 1) / sy
    x, y, u, w = (F.col(f"_mean_{k}") for k in ("x", "y", "u", "w"))
    still = M.matrix([a, b, u - (a * x + b * y)], [c, d, w - (c * x + d * y)], [0, 0, 1])
    return F.when(frozen & (sx > 1e-8) & (sy > 1e-8), still).otherwise(m)


def precorrect(pre: DataFrame, post: DataFrame, keys: Sequence[str], limit: float = 15.0, low: float = 5.0, high: float = 30.0) -> DataFrame:
    """one affine step of the pre points where the median distance of post points to them exceeds limit.

    The step is fitted from every pre point and its nearest post point, and accepted if it
    moves less than five times `high` along each axis, changes no axis scale by 0.3 and turns
    less than 10 degrees; otherwise the identity stays. The threshold is twice the median
    distance, measured again after an accepted step, within low and high.
    """
    keys = list(keys)
    as_target = lambda p: p.select(*keys, F.col("q_id").alias("t_id"), "x", "y")
    as_query = post.select(*keys, F.col("t_id").alias("q_id"), "x", "y")
    median = lambda p: percentiles(nearest_neighbours(as_query, as_target(p), keys).filter("dist is not null"), keys, "dist", {"median": 0.5})
    med = median(pre)
    back = nearest_neighbours(pre, post, keys).filter("dist is not null")
    fit = affine_from_matches(back.select(*keys, "x", "y", F.col("tx").alias("u"), F.col("ty").alias("w")), keys)
    m = F.col("m")
    good = m.isNotNull() & (F.col("median") > limit) & _within_limits(m, F.lit(5 * high), 0.3) & (F.abs(M.decompose(m)["angle"]) < 10)
    ok = F.coalesce(good, F.lit(False))
    step = pin(med.join(fit, keys, "left").select(*keys, "median", F.when(ok, m).otherwise(M.identity()).alias("m"), ok.alias("corrected")))
    x, y = M.project(F.col("m"), F.col("x"), F.col("y"))
    moved = attach(pre, step.filter("corrected").select(*keys, "m"), keys, "inner").select(*keys, "q_id", x.alias("x"), y.alias("y"))
    after = step.select(*keys) if is_empty(moved) else median(pin(moved)).withColumnRenamed("median", "median_after")
    both = step.join(after, keys, "left")
    now = F.coalesce("median_after", "median") if "median_after" in both.columns else F.col("median")
    return both.select(*keys, "median", "m", "corrected", F.least(F.greatest(2 * now, F.lit(low)), F.lit(high)).alias("threshold"))


def iterate_closest_points(
    pre: DataFrame, post: DataFrame, keys: Sequence[str], max_iter: int = 20, floor_px: float = 5.0
) -> DataFrame:
    """affine map m of the pre points onto the post points for all pairs at once, after the step `before` of F9.

    pre: keys, q_id, x, y; post: keys, t_id, x, y. In each round every post point takes its
    nearest pre point within the round's threshold (falling linearly to floor_px); one
    aggregated fit per pair moves the pre points, without scale after an accepted F9 step. A
    step that moves too far or rescales too much is left out, and the next round tries a
    tighter threshold. A pair stops with fewer than 10 matches, below 0.5 mean distance, or
    after 5 rounds without 2 % gain; finished pairs leave the join. Each round is a written
    state table of one row per pair.
    """
    keys = list(keys)
    pre, post = pin(pre.select(*keys, "q_id", "x", "y")), pin(post.select(*keys, F.col("t_id").alias("q_id"), "x", "y"))
    first = precorrect(pre, post.withColumnRenamed("q_id", "t_id"), keys)
    state = pin(first.select(
        *keys, F.col("m").alias("before"), "corrected", M.identity().alias("m"), F.col("threshold").alias("start"), F.lit(None).cast("double").alias("best"),
        F.lit(0).alias("stall"), F.lit(0).alias("rounds"), F.lit(0).alias("skipped"), F.lit(0).cast("bigint").alias("n_pairs"), F.lit("").alias("end"),
    ))
    for i in range(max_iter):
        thr = F.col("start") + (floor_px - F.col("start")) * (i / max(max_iter - 1, 1))
        active = state.filter("end = ''").select(*keys, M.compose(F.col("m"), F.col("before")).alias("m"), thr.alias("_thr"))
        if is_empty(active):
            break
        # state is a written table of one row per pair: its joins follow its real size
        x, y = M.project(F.col("m"), F.col("x"), F.col("y"))
        moved = pre.join(active, keys).select(*keys, F.col("q_id").alias("t_id"), x.alias("x"), y.alias("y"), "_thr")
        once = pin(moved.groupBy(*keys, "x", "y").agg(F.min("t_id").alias("t_id"), F.first("_thr").alias("_thr")))
        near = _within(post.join(active.select(*keys, "_thr"), keys), once, keys, F.col("_thr")).join(active.drop("m"), keys).filter(F.col("dist") < F.col("_thr"))
        fit = affine_from_matches(
            near.select(*keys, F.col("tx").alias("x"), F.col("ty").alias("y"), F.col("x").alias("u"), F.col("y").alias("w"), "dist"), keys,
            [F.avg("dist").alias("mean"), *[F.avg(k).alias(f"mean_{k}") for k in ("x", "y", "u", "w")]],
        ).withColumnRenamed("m", "_fit").withColumnRenamed("mean", "_mean")
        for k in ("x", "y", "u", "w"):
            fit = fit.withColumnRenamed(f"mean_{k}", f"_mean_{k}")
        joined = state.join(fit, keys, "left")
        j = pin(joined.withColumn("_step", _without_scale(joined, "_fit", F.col("corrected"))))
        live, step = F.col("end") == "", F.col("_step")
        enough = F.coalesce("n", F.lit(0)) >= 10
        take = live & enough & step.isNotNull() & _within_limits(step, 3 * thr, 0.15)
        take = F.coalesce(take, F.lit(False))
        gain = F.col("best").isNull() | (F.col("_mean") < 0.98 * F.col("best"))
        stall = F.when(~take, F.col("stall")).when(gain, 0).otherwise(F.col("stall") + 1)
        stop = F.when(~enough, "few pairs").when(take & (F.col("_mean") < 0.5), "converged").when(stall >= 5, "no gain").otherwise("")
        state = pin(j.select(
            *keys, "before", "corrected", F.when(take, M.compose(step, F.col("m"))).otherwise(F.col("m")).alias("m"), "start",
            F.when(take & gain, F.col("_mean")).otherwise(F.col("best")).alias("best"), F.when(live, stall).otherwise(F.col("stall")).alias("stall"),
            F.when(live, F.col("rounds") + 1).otherwise(F.col("rounds")).alias("rounds"),
            F.when(live & enough & ~take, F.col("skipped") + 1).otherwise(F.col("skipped")).alias("skipped"),
            F.when(take, F.col("n")).otherwise(F.col("n_pairs")).alias("n_pairs"), F.when(live, stop).otherwise(F.col("end")).alias("end"),
        ))
    return state.select(
        *keys, "m", "before", F.col("best").alias("mean_distance"), "rounds", "skipped", "n_pairs",
        F.when(F.col("end") == "", "iteration limit").otherwise(F.col("end")).alias("ended_by"),
    )


def sanity_gate(
    transforms: DataFrame, max_translation: float = 200.0, max_rotation: float = 5.0,
    max_scale_delta: float = 0.2, max_scale_diff: float = 0.15,
) -> DataFrame:
    """accepted flag and the reasons against a correction m."""
    p = M.decompose(F.col("m"))
    checks = [
        (F.abs(p["dx"]) > max_translation, "shift in x"), (F.abs(p["dy"]) > max_translation, "shift in y"),
        (F.abs(p["angle"]) > max_rotation, "rotation"), (F.abs(p["scale_x"] - 1) > max_scale_delta, "scale in x"),
        (F.abs(p["scale_y"] - 1) > max_scale_delta, "scale in y"), (F.abs(p["scale_x"] - p["scale_y"]) > max_scale_diff, "unequal scales"),
    ]
    reasons = F.filter(F.array(*[F.when(c, F.lit(name)) for c, name in checks]), lambda x: x.isNotNull())
    return transforms.withColumn("reasons", reasons).withColumn("accepted", F.size("reasons") == 0)
