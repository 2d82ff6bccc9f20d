"""Registration of pre onto post: coarse search, interior features, composition."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import matrices as M
from ..session import attach, is_empty, pin
from .features import interior_keypoints
from .filters import area_downsample, downsampled_shape
from .histograms import match_histograms
from .masks import outer_contour_of_largest, pixels_to_runs
from .matching import ratio_test, two_nearest
from .percentiles import percentiles
from .phase import CELLS, full_response, phase_shift, window_of_known
from .pixels import stretch_to_8bit
from .points import centroid, even_subsample, iterate_closest_points, sanity_gate
from .rings import boundary_ring
from .warp import warp_bilinear

# ---- coarse search on whole coarse frames ---------------------------------------------------


# share of the strongest product below which a phase does not count: each frame is then below 1e-4 of its strongest
# coefficient, where interpolation and the cut-off of the blur outweigh what turned and softened frames have in common
WEAK = 1e-8


def _correlate(fa: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    """Displacement (dx, dy) of b against a, whose transform is fa, and the peak strength as a share of that of a against itself."""
    cross = np.conj(fa) * np.fft.rfft2(b)
    size = np.abs(cross)
    # only phases count, so neither frame needs a common brightness; what is too weak to have one stays out
    least = max(WEAK * size.max(), 1e-300)
    surface = np.fft.irfft2(np.where(size > least, cross / np.maximum(size, least), 0), b.shape)
    py, px = np.unravel_index(np.argmax(surface), surface.shape)
    rows, cols = np.arange(py - 2, py + 3), np.arange(px - 2, px + 3)
    w = np.maximum(surface[np.ix_(rows % b.shape[0], cols % b.shape[1])], 0)
    total = w.sum()
    if total <= 0:
        return 0.0, 0.0, 0.0
    y, x = float((w.sum(1) * rows).sum() / total), float((w.sum(0) * cols).sum() / total)
    wrap = lambda v, n: v - n if v > n / 2 else v
    own = np.abs(fa) ** 2
    full = full_response(window_of_known((own > max(WEAK * own.max(), 1e-300)).astype(float), *b.shape))
    return wrap(x, b.shape[1]), wrap(y, b.shape[0]), float(total) / full


def _turned(im: np.ndarray, angle: float, scale: float, cx: float, cy: float) -> np.ndarray:
    """Image turned by angle degrees (counter-clockwise on screen) and scaled about (cx, cy), bilinear."""
    h, w = im.shape
    t = np.radians(angle)
    a, b = np.cos(t) / scale, np.sin(t) / scale
    u, v = np.arange(w)[None, :] - cx, np.arange(h)[:, None] - cy
    x, y = a * u - b * v + cx, b * u + a * v + cy
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    fx, fy = x - x0, y - y0
    p = np.pad(im, 1)
    inside = (x0 >= -1) & (x0 < w) & (y0 >= -1) & (y0 < h)
    i, j = np.where(inside, y0 + 1, 0), np.where(inside, x0 + 1, 0)
    grab = lambda di, dj: p[i + di, j + dj]
    out = (1 - fy) * ((1 - fx) * grab(0, 0) + fx * grab(0, 1)) + fy * ((1 - fx) * grab(1, 0) + fx * grab(1, 1))
    return np.where(inside, out, 0.0)


def _frames_of(pdf: pd.DataFrame, shape: tuple[int, int]) -> dict[str, np.ndarray]:
    out = {k: np.zeros(shape) for k in ("post", "pre")}
    for kind, part in pdf.groupby("kind"):
        if kind in out:
            out[kind][part["r"].to_numpy(), part["c"].to_numpy()] = part["v"].to_numpy()
    return out


def _ddl(df: DataFrame, keys: Sequence[str]) -> str:
    return "".join(f"{f.name} {f.dataType.simpleString()}, " for f in df.select(*keys).schema)


def guarded(step: Callable, keys: Sequence[str], columns: Sequence[str]) -> Callable:
    """The grouped step with a column error: a group whose data it cannot handle gives one row of its keys and the message.

    Only errors of the data count; a lost worker or a lack of memory still ends the task, and Spark runs it again.
    """
    def run(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            return step(group, pdf).assign(error=None)
        except (ArithmeticError, LookupError, ValueError) as e:
            row = {**dict.fromkeys(columns), **dict(zip(keys, group)), "error": f"{type(e).__name__}: {e}"[:200]}
            return pd.DataFrame([row], columns=[*columns, "error"], dtype=object)

    return run


def search_candidates(
    rotation_search: bool = True, angle_range: float = 20, angle_step: float = 1,
    scale_search: bool = True, scale_min: float = 0.85, scale_max: float = 1.15, scale_step: float = 0.05,
) -> list[tuple[float, float]]:
    """(scale, angle) pairs of the coarse search, 287 by default."""
    turns = int(np.ceil(2 * angle_range / angle_step - 1e-9)) + 1 if rotation_search else 0
    sizes = int(np.floor((scale_max - scale_min) / scale_step + 0.5)) + 1 if scale_search else 0
    angles = [k * angle_step - angle_range for k in range(turns)] or [0.0]
    scales = [scale_min + k * scale_step for k in range(sizes)] or [1.0]
    return [(float(f), float(a)) for f in scales for a in angles]


def coarse_search(
    rings: DataFrame, keys: Sequence[str], shape: tuple[int, int], candidates: list[tuple[float, float]] | None = None,
    per_task: int = 16,
) -> DataFrame:
    """response of every candidate: keys, i, scale, angle, cx, cy, dx, dy, response, error.

    rings: keys, kind, r, c, v on the coarse grid. The candidates of a pair are spread over
    many tasks, per_task each; a task holds two coarse frames. A task that cannot handle its
    frames gives one row with an error and no candidate; those of other pairs are not affected.
    """
    keys, cand = list(keys), candidates or search_candidates()
    pivot = centroid(rings.filter("kind = 'pre' and v > 0"), keys, shape, rings)
    n_tasks = -(-len(cand) // per_task)
    spread = attach(rings.select(*keys, "kind", "r", "c", "v"), pivot, keys, "inner").withColumn(
        "_task", F.explode(F.sequence(F.lit(0), F.lit(n_tasks - 1)))
    )

    def run(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        f = _frames_of(pdf, shape)
        cx, cy = float(pdf["cx"].iloc[0]), float(pdf["cy"].iloc[0])
        post = np.fft.rfft2(f["post"])
        rows = []
        for i in range(group[-1] * per_task, min(len(cand), (group[-1] + 1) * per_task)):
            s, a = cand[i]
            turned = f["pre"] if s == 1.0 and a == 0.0 else _turned(f["pre"], a, s, cx, cy)
            rows.append((*group[:-1], i, s, a, cx, cy, *_correlate(post, turned)))
        return pd.DataFrame(rows, columns=columns)

    columns = [*keys, "i", "scale", "angle", "cx", "cy", "dx", "dy", "response"]
    return spread.groupBy(*keys, "_task").applyInPandas(
        guarded(run, keys, columns),
        _ddl(rings, keys) + "i int, scale double, angle double, cx double, cy double, dx double, dy double, response double, error string",
    )


def best_candidate(responses: DataFrame, keys: Sequence[str], by_scale: bool = False) -> DataFrame:
    """candidate with the highest response per pair (or per pair and scale), the first on a tie."""
    group = [*keys, "scale"] if by_scale else list(keys)
    cols = [c for c in responses.columns if c not in (*group, "error")]
    best = F.max_by(F.struct(*cols), F.struct(F.col("response"), -F.col("i")))
    return responses.filter("response is not null").groupBy(*group).agg(best.alias("b")).select(*group, "b.*")


def register_outline(
    px: DataFrame, keys: Sequence[str], shape: tuple[int, int], down_scale: float = 0.3, boundary_width: int = 15,
    boundary_smooth: float = 10.0, candidates: list[tuple[float, float]] | None = None, multiscale: bool = True,
    gate: dict | None = None, levels: int | None = None,
) -> DataFrame:
    """inverse map m per pair from outline search and closest points, with diagnostics.

    px: keys, kind, r, c, v at full resolution. Without multiscale the identity is returned.
    The point step is dropped where its correction fails the sanity gate. Every pair of px has a
    row; one without an outline, or whose search met an error, has no map and the reason in error.
    """
    keys = list(keys)
    if not multiscale:
        return px.select(*keys).distinct().select(*keys, M.identity().alias("m"), F.lit("identity").alias("outcome"), F.lit(None).cast("string").alias("error"))
    coarse = min(max(down_scale * 0.25, 0.02), 1.0)
    small_shape = downsampled_shape(*shape, 1 / coarse)
    side = [*keys, "kind"]
    small = pin(area_downsample(px, side, shape, 1 / coarse))
    eq = match_histograms(small, keys, levels=levels).select(*side, "r", "c", F.col("matched").alias("v"))
    rings = pin(boundary_ring(eq, side, small_shape, boundary_width, boundary_smooth))
    responses = pin(coarse_search(rings, keys, small_shape, candidates))
    wrong = pin(responses.filter("error is not null").groupBy(*keys).agg(F.max("error").alias("error")))
    hit = pin(best_candidate(responses.join(wrong, keys, "left_anti"), keys))
    found = [F.col(n) for n in ("angle", "scale", "cx", "cy", "dx", "dy")]
    first = pin(hit.select(*keys, "angle", "scale", "response", M.similarity_inverse_map(*found, 1.0).alias("m_coarse"), M.similarity_inverse_map(*found, coarse).alias("m0")))
    # outer contours of the hard rings; distances below are in cells of the coarse grid
    edge = even_subsample(outer_contour_of_largest(pixels_to_runs(rings.filter("ring = 1"), side), side), side)
    pts = pin(edge.select(*side, (F.shiftleft(F.col("r").cast("bigint"), 32) + F.col("c")).alias("id"), F.col("c").cast("double").alias("x"), F.col("r").cast("double").alias("y")))
    x, y = M.project(M.invert(F.col("m_coarse")), F.col("x"), F.col("y"))
    pre = attach(pts.filter("kind = 'pre'"), first.select(*keys, "m_coarse"), keys, "inner").select(*keys, F.col("id").alias("q_id"), x.alias("x"), y.alias("y"))
    icp = iterate_closest_points(pre, pts.filter("kind = 'post'").select(*keys, F.col("id").alias("t_id"), "x", "y"), keys)
    lifted = lambda c: M.rescale(F.coalesce(c, M.identity()), 1 / coarse)
    whole = first.join(icp, keys, "left").withColumn("m", lifted(F.col("m"))).withColumn("before", lifted(F.col("before")))
    checked = sanity_gate(whole, **(gate or {}))
    final = F.when(F.col("accepted"), M.compose(F.col("m0"), M.compose(M.invert(F.col("before")), M.invert(F.col("m"))))).otherwise(F.col("m0"))
    fine = checked.select(
        *keys, final.alias("m"), F.when(F.col("accepted"), "refined").otherwise("coarse only").alias("outcome"),
        "angle", "scale", "response", (F.col("mean_distance") / coarse).alias("mean_distance"), "rounds", F.array_join("reasons", "; ").alias("reasons"),
    )
    every = small.select(*keys).distinct().join(wrong, keys, "left").join(fine, keys, "left")
    return pin(every.select(*fine.columns, F.when(F.col("m").isNull(), F.coalesce("error", F.lit("no outline to search with"))).alias("error")))


def prealign_translation(px: DataFrame, keys: Sequence[str], shape, cells: int = CELLS) -> DataFrame:
    """pre image moved by the phase shift (keys, r, c, v); no frame is held by one task."""
    t = phase_shift(px, keys, shape, cells).select(*keys, M.translation(F.col("dx"), F.col("dy")).alias("m"))
    return warp_bilinear(px.filter("kind = 'pre'").select(*keys, "r", "c", "v"), keys, shape, t)


# ---- interior features ----------------------------------------------------------------------


def work_scale(longest: Column) -> Column:
    """one half, less for very large frames, more for small ones."""
    half = F.when(longest * 0.5 > 15000, 10000 / longest).otherwise(0.5)
    return F.when(longest * half < 2000, F.least(F.lit(1.0), 2000 / longest)).otherwise(half)


# ---- robust homography ----------------------------------------------------------------------


def _solve_fours(src: np.ndarray, dst: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Homographies with last entry 1 through the drawn fours of point pairs, and which draws have one."""

    def scaled(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean, size = p.mean(axis=0), max(float(p.std()), 1e-9)
        return (p - mean) / size, np.array([[1 / size, 0, -mean[0] / size], [0, 1 / size, -mean[1] / size], [0, 0, 1]])

    (a, ta), (b, tb) = scaled(src), scaled(dst)
    x, y, u, w = a[draws, 0], a[draws, 1], b[draws, 0], b[draws, 1]
    z, o = np.zeros_like(x), np.ones_like(x)
    rows = np.concatenate([np.stack([x, y, o, z, z, z, -u * x, -u * y], -1), np.stack([z, z, z, x, y, o, -w * x, -w * y], -1)], axis=1)
    able = np.linalg.cond(rows) < 1e9  # three points on a line have no map
    h = np.linalg.solve(rows[able], np.concatenate([u, w], axis=1)[able][:, :, None])[:, :, 0]
    full = np.linalg.inv(tb) @ np.c_[h, np.ones(len(h))].reshape(-1, 3, 3) @ ta
    fine = np.abs(full[:, 2, 2]) > 1e-12
    return full[fine].reshape(-1, 9) / full[fine][:, 2, 2][:, None], np.flatnonzero(able)[fine]


def _errors(h: np.ndarray, pdf: pd.DataFrame) -> np.ndarray:
    x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
    d = h[:, 6:7] * x + h[:, 7:8] * y + h[:, 8:9]
    d = np.where(np.abs(d) < 1e-12, np.nan, d)
    u, w = (h[:, 0:1] * x + h[:, 1:2] * y + h[:, 2:3]) / d, (h[:, 3:4] * x + h[:, 4:5] * y + h[:, 5:6]) / d
    return np.hypot(u - pdf["u"].to_numpy(), w - pdf["w"].to_numpy())


CHUNK = 20_000


def robust_homography(
    matches: DataFrame, keys: Sequence[str], tolerance: float = 3.0, n_hypotheses: int = 5000, pool: int = 400,
    confidence: float = 0.999, first_round: int = 256,
) -> DataFrame:
    """keys, m, n_matches, n_inliers, inlier_ratio for matches (x, y) -> (u, w).

    Equal matches are collapsed first and vote with their number. Hypotheses come from
    seeded samples, by how often each match occurs, of a pool of different matches, the first
    ones by hash, in rounds of growing size. Every match votes on every hypothesis in chunks of bounded size. A pair is ready when
    a draw of four inliers has come with the given confidence, judged by its best inlier
    share so far, or after n_hypotheses draws; only the other pairs see another round. The
    winner is fitted again on all its inliers from sums. The result depends neither on the
    partitioning nor on how often the whole set is repeated. Pairs whose matches define no map
    have a null m.
    """
    keys = list(keys)
    ddl = _ddl(matches, keys)
    rows = matches.groupBy(*keys, "x", "y", "u", "w").agg(F.count("*").alias("_weight")).withColumn("_h", F.xxhash64("x", "y", "u", "w"))
    rows = pin(rows)
    counts = pin(rows.groupBy(*keys).agg(F.sum("_weight").alias("n_matches"), F.count("*").alias("_different")))
    sized = pin(attach(rows, counts, keys, "inner"))
    # about 1.5 times pool different matches per pair, by hash, whatever the pair's size
    share = F.pmod(F.col("_h"), F.lit(1 << 30)) / float(1 << 30)
    seeds = pin(sized.filter(share <= 1.5 * pool / F.col("_different")))
    n_chunks = F.ceil(F.col("_different") / CHUNK).cast("int")
    chunked = sized.withColumn("_chunk", F.pmod(F.col("_h"), n_chunks).cast("int"))

    def guess(first: int, n: int) -> Callable:
        def run(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["_h", "x", "y", "u", "w"]).head(pool)
            src, dst = pdf[["x", "y"]].to_numpy(float), pdf[["u", "w"]].to_numpy(float)
            out = []
            if len(src) >= 4:
                rng = np.random.default_rng([0, first])
                often = pdf["_weight"].to_numpy(float)
                draws = np.array([rng.choice(len(src), 4, replace=False, p=often / often.sum()) for _ in range(n)])
                out = [(*group, first + int(i), h.tolist()) for h, i in zip(*_solve_fours(src, dst, draws))]
            return pd.DataFrame(out, columns=[*keys, "i", "h"])

        return run

    def vote(group: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if b.empty:  # a pair without hypotheses in this round
            return pd.DataFrame([], columns=[*keys, "i", "n"])
        out = {**{k: [v] * len(b) for k, v in zip(keys, group)}, "i": b["i"]}
        if len(a) and len(b):
            h = np.stack(b["h"].to_numpy())
            weight = a["_weight"].to_numpy()
            out["n"] = [int(weight[(_errors(h[j: j + 1], a) <= tolerance)[0]].sum()) for j in range(len(h))]
        else:
            out["n"] = [0] * len(b)
        return pd.DataFrame(out)[[*keys, "i", "n"]]

    best, waiting = None, counts.select(*keys)
    drawn, size = 0, first_round
    while drawn < n_hypotheses:
        size = min(size, n_hypotheses - drawn)
        hyps = pin(seeds.join(waiting, keys, "left_semi").groupBy(*keys).applyInPandas(guess(drawn, size), ddl + "i int, h array<double>"))
        per_chunk = hyps.join(counts, keys).withColumn("_chunk", F.explode(F.sequence(F.lit(0), n_chunks - 1))).drop("n_matches", "_different")
        votes = (
            chunked.join(waiting, keys, "left_semi").groupBy(*keys, "_chunk").cogroup(per_chunk.groupBy(*keys, "_chunk"))
            .applyInPandas(vote, ddl + "i int, n bigint").groupBy(*keys, "i").agg(F.sum("n").alias("n"))
        )
        tops = votes.groupBy(*keys).agg(F.max_by(F.struct("i", "n"), F.struct(F.col("n"), -F.col("i"))).alias("_t")).select(*keys, "_t.*")
        tops = tops.join(hyps, [*keys, "i"]).select(*keys, "i", "n", F.col("h").alias("m0"))
        if best is not None:
            tops = tops.unionByName(best)
        best = pin(tops.groupBy(*keys).agg(F.max_by(F.struct("i", "n", "m0"), F.struct(F.col("n"), -F.col("i"))).alias("_t")).select(*keys, "_t.*"))
        drawn, size = drawn + size, 4 * size
        four = F.pow(F.coalesce("n", F.lit(0)) / F.col("n_matches"), F.lit(4))  # chance that a draw holds inliers only
        needed = F.when(four < 1e-12, float("inf")).when(four >= 1 - 1e-12, 0.0).otherwise(float(np.log(1 - confidence)) / F.log1p(-four))
        judged = counts.join(waiting, keys, "left_semi").join(best, keys, "left").filter("_different >= 4").withColumn("_needed", needed)
        waiting = pin(judged.filter(F.col("_needed") > drawn).select(*keys))
        if is_empty(waiting):
            break
    winner = best
    px, py = M.project(F.col("m0"), F.col("x"), F.col("y"))
    err = F.sqrt((px - F.col("u")) * (px - F.col("u")) + (py - F.col("w")) * (py - F.col("w")))
    inliers = pin(attach(sized, winner.select(*keys, "m0"), keys, "inner").filter(err <= tolerance).select(*keys, "x", "y", "u", "w", "_weight"))
    refit = fit_homography(inliers, keys, "_weight")
    n_in = inliers.groupBy(*keys).agg(F.sum("_weight").alias("n_inliers"))
    return (
        counts.join(winner.select(*keys, "m0"), keys, "left").join(refit, keys, "left").join(n_in, keys, "left")
        .select(
            *keys, F.coalesce("m", "m0").alias("m"), "n_matches", F.coalesce("n_inliers", F.lit(0)).alias("n_inliers"),
            (F.coalesce("n_inliers", F.lit(0)) / F.col("n_matches")).alias("inlier_ratio"),
        )
    )


def fit_homography(matches: DataFrame, keys: Sequence[str], weight: str | None = None) -> DataFrame:
    """Least-squares homography per group from sums only: one aggregation, then one 8x8 solve per group.

    weight names the number of times that a match counts.
    """
    keys, k = list(keys), F.col(weight) if weight else F.lit(1)
    mean = lambda c: F.sum(k * F.col(c)) / F.sum(k)
    centre = matches.groupBy(*keys).agg(*[mean(c).alias(f"_a{c}") for c in ("x", "y", "u", "w")])
    spread = lambda a, b: F.greatest(F.sqrt(F.sum(k * ((F.col(a) - F.col(f"_a{a}")) ** 2 + (F.col(b) - F.col(f"_a{b}")) ** 2)) / F.sum(k)), F.lit(1e-9))
    centred = attach(matches, centre, keys, "inner")
    std = centred.groupBy(*keys).agg(*[F.first(f"_a{c}").alias(f"_a{c}") for c in ("x", "y", "u", "w")], spread("x", "y").alias("_s"), spread("u", "w").alias("_q"))
    x, y = (F.col("x") - F.col("_ax")) / F.col("_s"), (F.col("y") - F.col("_ay")) / F.col("_s")
    u, w = (F.col("u") - F.col("_au")) / F.col("_q"), (F.col("w") - F.col("_aw")) / F.col("_q")
    n = attach(matches, std, keys, "inner").select(*keys, "_ax", "_ay", "_au", "_aw", "_s", "_q", x.alias("x"), y.alias("y"), u.alias("u"), w.alias("w"), k.alias("_k"))
    one, zero = F.lit(1.0), F.lit(0.0)
    X, Y, U, W = F.col("x"), F.col("y"), F.col("u"), F.col("w")
    ra = [X, Y, one, zero, zero, zero, -U * X, -U * Y]
    rb = [zero, zero, zero, X, Y, one, -W * X, -W * Y]
    K = F.col("_k")
    norm = [F.sum(K * (ra[i] * ra[j] + rb[i] * rb[j])) for i in range(8) for j in range(8)]
    rhs = [F.sum(K * (ra[i] * U + rb[i] * W)) for i in range(8)]
    params = ["_ax", "_ay", "_au", "_aw", "_s", "_q"]
    sums = n.groupBy(*keys).agg(F.array(*norm).alias("a"), F.array(*rhs).alias("b"), *[F.first(p).alias(p) for p in params])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ms = []
            for r in pdf.to_dict("records"):
                h = np.r_[np.linalg.lstsq(np.array(r["a"]).reshape(8, 8), np.array(r["b"]), rcond=None)[0], 1.0].reshape(3, 3)
                pre = np.array([[1 / r["_s"], 0, -r["_ax"] / r["_s"]], [0, 1 / r["_s"], -r["_ay"] / r["_s"]], [0, 0, 1]])
                post = np.array([[r["_q"], 0, r["_au"]], [0, r["_q"], r["_aw"]], [0, 0, 1]])
                full = post @ h @ pre
                ms.append((full / full[2, 2]).ravel().tolist())
            out = pdf[keys].copy()
            out["m"] = ms
            yield out

    return sums.mapInPandas(solve, _ddl(matches, keys) + "m array<double>")


def inlier_gate(
    fits: DataFrame, min_inlier_ratio: float = 0.4, max_correction: float = 500.0, work_scale_col: str = "work_scale", min_matches: int = 10
) -> DataFrame:
    """success and failure_reason of an interior fit."""
    shift = F.sqrt(M.at(F.col("m"), 0, 2) ** 2 + M.at(F.col("m"), 1, 2) ** 2) / F.col(work_scale_col)
    reason = (
        F.when(F.col("m").isNull() | (F.col("n_matches") < min_matches), "too few matches")
        .when(F.col("inlier_ratio") < min_inlier_ratio, "inlier ratio too low")
        .when(shift > max_correction, "correction too large")
    )
    return fits.withColumn("failure_reason", reason).withColumn("success", reason.isNull())


def accuracy(matches: DataFrame, fits: DataFrame, keys: Sequence[str], tolerance: float = 3.0) -> DataFrame:
    """median reprojection error of the inliers at full resolution; -1 for a failed fit."""
    keys = list(keys)
    x, y = M.project(F.col("m"), F.col("x"), F.col("y"))
    err = F.sqrt((x - F.col("u")) * (x - F.col("u")) + (y - F.col("w")) * (y - F.col("w")))
    near = attach(matches, fits.filter("success").select(*keys, "m", "work_scale"), keys, "inner").withColumn("_e", err).filter(F.col("_e") <= tolerance)
    med = percentiles(near, keys, F.col("_e") / F.col("work_scale"), {"estimated_accuracy_px": 0.5})
    return fits.select(*keys).join(med, keys, "left").select(*keys, F.coalesce("estimated_accuracy_px", F.lit(-1.0)).alias("estimated_accuracy_px"))


def refine_interior(
    px: DataFrame, transforms: DataFrame, keys: Sequence[str], shape: tuple[int, int], min_contrast: float = 1.0,
    max_correction: float = 500.0, min_inlier_ratio: float = 0.4, blur_base: float = 8.0, ratio: float = 0.7,
    levels: int | None = None,
) -> DataFrame:
    """refined inverse map per pair from interior features; a failed pair keeps its map.

    transforms: keys, m (post position -> pre position).
    """
    from .filters import coarse_kernel_size, gaussian_blur

    keys = list(keys)
    side, longest = [*keys, "kind"], max(shape)
    # F14 for one shape, as a number
    ws = 10000 / longest if longest * 0.5 > 15000 else 0.5
    ws = min(1.0, 2000 / longest) if longest * ws < 2000 else ws
    post = px.filter("kind = 'post'").select(*keys, "r", "c", "v")
    pre = warp_bilinear(px.filter("kind = 'pre'").select(*keys, "r", "c", "v"), keys, shape, transforms)
    both = pin(post.withColumn("kind", F.lit("post")).unionByName(pre.withColumn("kind", F.lit("pre"))))
    small_shape = shape if ws == 1.0 else downsampled_shape(*shape, 1 / ws)
    small = both if ws == 1.0 else area_downsample(both, side, shape, 1 / ws)
    sigma = max(blur_base * 0.5, 1.0)
    soft = pin(gaussian_blur(small, side, small_shape, sigma, "mirror", coarse_kernel_size(sigma)))
    bytes_ = stretch_to_8bit(soft, side, levels=levels).select(*side, "r", "c", F.col("v8").cast("double").alias("v"))
    kp = pin(interior_keypoints(bytes_, side, small_shape, min_contrast=min_contrast))
    a = kp.filter("kind = 'post'").select(*keys, F.col("kp_id").alias("q_id"), "vec", "x", "y")
    b = kp.filter("kind = 'pre'").select(*keys, F.col("kp_id").alias("t_id"), "vec", F.col("x").alias("u"), F.col("y").alias("w"))
    good = ratio_test(two_nearest(a.select(*keys, "q_id", "vec"), b.select(*keys, "t_id", "vec"), keys), ratio)
    matches = pin(good.join(a.drop("vec"), [*keys, "q_id"]).join(b.drop("vec"), [*keys, "t_id"]).select(
        *keys, F.col("u").alias("x"), F.col("w").alias("y"), F.col("x").alias("u"), F.col("y").alias("w")))  # from pre to post
    n_feat = kp.groupBy(*keys).agg(F.count_if(F.col("kind") == "post").alias("n_features_post"), F.count_if(F.col("kind") == "pre").alias("n_features_pre"))
    found = transforms.select(*keys, F.col("m").alias("m_before")).join(robust_homography(matches, keys), keys, "left")
    found = found.withColumn("n_matches", F.coalesce("n_matches", F.lit(0))).withColumn("work_scale", F.lit(float(ws)))
    gated = pin(inlier_gate(found, min_inlier_ratio, max_correction))
    acc = accuracy(matches, gated, keys)
    lifted = M.compose(F.col("m_before"), M.invert(M.rescale(F.col("m"), 1 / ws)))
    return (
        gated.join(acc, keys, "left").join(n_feat, keys, "left")
        .select(
            *keys, F.when(F.col("success"), lifted).otherwise(F.col("m_before")).alias("m"), "success",
            F.when(F.col("success"), 1).otherwise(0).alias("levels_completed"), "estimated_accuracy_px", "failure_reason",
            "n_features_post", "n_features_pre", "n_matches", "n_inliers", "inlier_ratio",
            F.when(F.col("success"), M.at(F.col("m"), 0, 2) / ws).alias("dx_correction"),
            F.when(F.col("success"), M.at(F.col("m"), 1, 2) / ws).alias("dy_correction"),
        )
    )
