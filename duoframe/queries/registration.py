"""Queries for registration."""

from pyspark.sql import functions as F

from ..fixtures import LEVELS, PX_SHAPE, v_match, v_px, v_px_wrapped
from ..functions import matrices as M
from ..operators import points as P
from ..operators import register as R
from ..operators.filters import area_downsample
from ..operators.masks import contour_pixels, pixels_to_runs
from ..operators.matching import ratio_test, two_nearest
from ..operators.pixels import pair_pixels, shift_pixels
from ..operators.warp import warp_bilinear
from ..session import pin
from .base import query, r6

SK = ["sample", "kind"]


def _id():
    return F.shiftleft(F.col("r").cast("bigint"), 32) + F.col("c")


def _points(t):
    px = v_px(t)
    xy = [F.col("c").cast("double").alias("x"), F.col("r").cast("double").alias("y")]
    pre = px.filter("kind = 'pre'").select("sample", _id().alias("q_id"), *xy)
    post = px.filter("kind = 'post'").select("sample", _id().alias("t_id"), *xy)
    return pre, post


@query("centroid", "F1", """
select f.sample, f.kind, coalesce(round(avg(p.c), 6), 64.0) as cx, coalesce(round(avg(p.r), 6), 64.0) as cy
from (select distinct sample, kind from v_px) f left join v_px p on p.sample = f.sample and p.kind = f.kind group by 1, 2""")
def centroid(t):
    px = v_px(t)
    return P.centroid(px, SK, PX_SHAPE, px).select(*SK, r6("cx").alias("cx"), r6("cy").alias("cy"))


def _planted(t):
    """Every frame as the post frame of a pair of its own, and the same frame moved by (4, -3) as pre."""
    post = pin(shift_pixels(v_px(t), 32, 32).withColumn("sample", F.concat("sample", F.lit("-"), "kind")).drop("kind"))
    turn = M.invert(M.translation(4, -3))
    maps = post.select("sample").distinct().select("sample", turn.alias("m"))
    pre = warp_bilinear(post, ["sample"], (192, 192), maps)
    return pin(post.withColumn("kind", F.lit("post")).unionByName(pre.withColumn("kind", F.lit("pre"))))


# a turn by 4 degrees and a scale of 1.05 about the centre, then the shift; positions of three points in the pre frame
TURNED = """
select sample || '-' || kind as sample, {} round(96 + 1.05 * (cos(radians(a)) * (x - 96) - sin(radians(a)) * (y - 96)) + 4, 3) as x, round(96 + 1.05 * (sin(radians(a)) * (x - 96) + cos(radians(a)) * (y - 96)) - 3, 3) as y, k
from (select distinct sample, kind from v_px) f, (values (0, 64, 64), (1, 128, 64), (2, 96, 128)) p(k, x, y), (select -4.0::double as a) t"""
POINTS = [(0, 64.0, 64.0), (1, 128.0, 64.0), (2, 96.0, 128.0)]


def _turned(t, frames=v_px_wrapped):
    """Every frame as the post frame of a pair of its own, and the same frame turned, scaled and moved as pre; and the map from post to pre.

    Interior features need frames that are not of one value, so by default the brightness wraps instead of ending at 255.
    """
    post = pin(shift_pixels(frames(t), 32, 32).withColumn("sample", F.concat("sample", F.lit("-"), "kind")).drop("kind"))
    forward = M.compose(M.translation(4, -3), M.rotation_about(F.lit(4.0), F.lit(1.05), F.lit(96.0), F.lit(96.0)))
    maps = post.select("sample").distinct().select("sample", M.invert(forward).alias("m"))
    pre = warp_bilinear(post, ["sample"], (192, 192), maps)
    return pin(post.withColumn("kind", F.lit("post")).unionByName(pre.withColumn("kind", F.lit("pre")))), forward


def _positions(df, forward, tolerance, *more):
    """Positions of the points under the map m: as planted where they are within the tolerance of that, else as measured."""
    spread = df.withColumn("truth", forward).withColumn("p", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(x).alias("x"), F.lit(y).alias("y")) for k, x, y in POINTS])))
    (x, y), (u, w) = (M.project(F.col(c), F.col("p.x"), F.col("p.y")) for c in ("m", "truth"))
    snap = lambda a, b: r6(F.when(F.abs(a - b) < tolerance, b).otherwise(a), 3)
    return spread.select("sample", *more, snap(x, u).alias("x"), snap(y, w).alias("y"), F.col("p.k").alias("k"))


PLANTED = "select distinct sample || '-' || kind as sample, {} from v_px"
SHIFT = "4.0::double as dx, -3.0::double as dy, 1.0::double as response"


@query("coarse_search", "F2", PLANTED.format("true as no_turn, true as strong, 1.0::double as scale, 4.0::double as dx, -3.0::double as dy"))
def coarse_search(t):
    out = R.best_candidate(R.coarse_search(_planted(t), ["sample"], (192, 192)), ["sample"])
    # a turn by one step moves these frames by less than a cell, so the step itself may win
    return out.select("sample", (F.abs("angle") <= 1).alias("no_turn"), (F.col("response") > 0.9).alias("strong"), *[r6(n, 0).alias(n) for n in ("scale", "dx", "dy")])


@query("phase_shift", "F3", PLANTED.format(SHIFT))
def phase_shift(t):
    return R.phase_shift(_planted(t), ["sample"], (192, 192)).select("sample", *[r6(n, 3).alias(n) for n in ("dx", "dy", "response")])


@query("prealign_translation", "F22", "select sample || '-' || kind as sample, (r + 32)::int as r, (c + 32)::int as c, round(v, 3) as v from v_px where v > 0")
def prealign_translation(t):
    out = R.prealign_translation(_planted(t), ["sample"], (192, 192))
    return out.select("sample", "r", "c", r6("v", 3).alias("v")).filter("v > 0")


PART = "from part"
ANGLE = "(p_partkey % 41 - 20)"
SIM = f"""
k as (select p_partkey, radians({ANGLE}) as t, 0.85 + (p_partkey % 7) * 0.05 as s, p_size * 3.0 as cx, p_size * 2.0 as cy, p_partkey % 13 - 6 as dx, p_partkey % 11 - 5 as dy from part),
i as (select *, cos(t) / s as a, sin(t) / s as b from k),
f as (select p_partkey, a, -b as b, cx - a * cx + b * cy + a * dx - b * dy as e, b as c, a as d, cy - b * cx - a * cy + b * dx + a * dy as g from i)"""


@query("similarity_matrix", "F4", f"""
with {SIM} select p_partkey, round(a, 6) + 0 as m00, round(b, 6) + 0 as m01, round(e / 0.075, 6) + 0 as m02,
 round(c, 6) + 0 as m10, round(d, 6) + 0 as m11, round(g / 0.075, 6) + 0 as m12 from f""")
def similarity_matrix(t):
    k = F.col("p_partkey")
    m = M.similarity_inverse_map(
        (k % 41 - 20).cast("double"), 0.85 + (k % 7) * 0.05, F.col("p_size") * 3.0, F.col("p_size") * 2.0,
        (k % 13 - 6).cast("double"), (k % 11 - 5).cast("double"), 0.075,
    )
    return _entries(t("part").select("p_partkey", m.alias("m")), ["p_partkey"])


def _entries(df, keys, rows=2):
    return df.select(*keys, *[r6(M.at(F.col("m"), i, j)).alias(f"m{i}{j}") for i in range(rows) for j in range(3)])


@query("even_subsample", "F5", """
with n as (select *, row_number() over (partition by sample, kind order by r, c) - 1 as j, count(*) over (partition by sample, kind) as n from v_px),
i as (select distinct sample, kind, round_even(range * ((n - 1) / 799.0::double), 0) as j from (select distinct sample, kind, n from n) k, range(800))
select n.sample, n.kind, n.r, n.c from n where n <= 800 or exists (select 1 from i where i.sample = n.sample and i.kind = n.kind and i.j = n.j)""")
def even_subsample(t):
    return P.even_subsample(v_px(t), SK, 800).select(*SK, "r", "c")


NN = """
nn as (select sample, qr, qc, best.r as tr, best.c as tc, sqrt(best.d) as dist from (
  select q.sample, q.r as qr, q.c as qc, min(struct_pack(d := (q.r - t.r) ** 2 + (q.c - t.c) ** 2, r := t.r, c := t.c)) as best
  from v_px q join v_px t on q.sample = t.sample and q.kind = 'pre' and t.kind = 'post' group by 1, 2, 3))"""


@query("nearest_neighbours", "F6", f"""
with {NN} select sample, qr::bigint * 4294967296 + qc as q_id, tr::bigint * 4294967296 + tc as t_id, round(dist, 6) as dist from nn""")
def nearest_neighbours(t):
    return P.nearest_neighbours(*_points(t), ["sample"]).select("sample", "q_id", "t_id", r6("dist").alias("dist"))


@query("start_threshold", "F7", f"""
with {NN} select sample, round(quantile_cont(dist, 0.5), 6) as median, round(least(greatest(2 * quantile_cont(dist, 0.5), 5.0), 30.0), 6) as threshold
from nn group by 1""")
def start_threshold(t):
    out = P.start_threshold(P.nearest_neighbours(*_points(t), ["sample"]), ["sample"])
    return out.select("sample", r6("median").alias("median"), r6("threshold").alias("threshold"))


FIT = """
s as (select pair_id, count(*) as n, avg(x) as mx, avg(y) as my, avg(u) as mu, avg(w) as mw, covar_pop(x, x) as xx, covar_pop(x, y) as xy, covar_pop(y, y) as yy,
  covar_pop(x, u) as xu, covar_pop(y, u) as yu, covar_pop(x, w) as xw, covar_pop(y, w) as yw from v_match group by 1),
f as (select pair_id, n, (xu * yy - yu * xy) / (xx * yy - xy * xy) as a, (yu * xx - xu * xy) / (xx * yy - xy * xy) as b,
  (xw * yy - yw * xy) / (xx * yy - xy * xy) as c, (yw * xx - xw * xy) / (xx * yy - xy * xy) as d, mx, my, mu, mw from s),
g as (select pair_id, n, a, b, mu - a * mx - b * my as e, c, d, mw - c * mx - d * my as h from f)"""


@query("affine_from_matches", "F8", f"""
with {FIT} select pair_id, n, round(a, 6) + 0 as m00, round(b, 6) + 0 as m01, round(e, 6) + 0 as m02, round(c, 6) + 0 as m10, round(d, 6) + 0 as m11, round(h, 6) + 0 as m12 from g""")
def affine_from_matches(t):
    return _entries(P.affine_from_matches(v_match(t), ["pair_id"]), ["pair_id", "n"])


@query("precorrect", "F9")
def precorrect(t):
    out = P.precorrect(*_points(t), ["sample"], limit=1.0)
    return out.select("sample", r6("median").alias("median"), "corrected", r6("threshold").alias("threshold"))


def _contours(t):
    px = _planted(t)
    cells = contour_pixels(pixels_to_runs(px.filter("v >= 60"), SK), SK)
    xy = [F.col("c").cast("double").alias("x"), F.col("r").cast("double").alias("y")]
    pre = cells.filter("kind = 'pre'").select("sample", _id().alias("q_id"), *xy)
    return pre, cells.filter("kind = 'post'").select("sample", _id().alias("t_id"), *xy)


@query("iterate_closest_points", "F10")
def iterate_closest_points(t):
    out = P.iterate_closest_points(*_contours(t), ["sample"])
    return out.select("sample", r6("mean_distance", 3).alias("mean_distance"), "rounds", "n_pairs", "ended_by")


@query("closest_points_planted", "F10", """
select sample, kind, round(64 + 1.01 * (cos(radians(a)) * (x - 64) - sin(radians(a)) * (y - 64)) + 0.5, 3) as x,
 round(64 + 1.01 * (sin(radians(a)) * (x - 64) + cos(radians(a)) * (y - 64)) - 0.3, 3) as y, k
from (select distinct sample, kind from v_px) f, (values (0, 64, 64), (1, 128, 64), (2, 96, 128)) p(k, x, y), (select -0.5::double as a) t""")
def closest_points_planted(t):
    """Points spread over every frame, and the same points turned, scaled and moved: the map between them comes back."""
    post = pin(P.even_subsample(v_px(t), SK, 800).select(*SK, _id().alias("t_id"), F.col("c").cast("double").alias("x"), F.col("r").cast("double").alias("y")))
    forward = M.compose(M.translation(0.5, -0.3), M.rotation_about(F.lit(0.5), F.lit(1.01), F.lit(64.0), F.lit(64.0)))
    x, y = M.project(forward, F.col("x"), F.col("y"))
    pre = post.select(*SK, F.col("t_id").alias("q_id"), x.alias("x"), y.alias("y"))
    found = P.iterate_closest_points(pre, post, SK).select(*SK, M.invert(M.compose(F.col("m"), F.col("before"))).alias("m"))
    return _positions(found, forward, 0.1, "kind")


@query("decompose_matrix", "F11", f"""
with {FIT} select pair_id, round(degrees(atan2(c, a)), 6) + 0 as angle, round(sqrt(a * a + c * c), 6) as scale_x, round(sqrt(b * b + d * d), 6) as scale_y,
 round((a * b + c * d) / (sqrt(a * a + c * c) * sqrt(b * b + d * d)), 6) + 0 as shear, 0.0::double as perspective, round(e, 6) + 0 as dx, round(h, 6) + 0 as dy from g""")
def decompose_matrix(t):
    fit = P.affine_from_matches(v_match(t), ["pair_id"])
    return fit.select("pair_id", *[r6(c).alias(n) for n, c in M.decompose(F.col("m")).items()])


@query("sanity_gate", "F12", """
with k as (select p_partkey, (p_partkey % 29 - 14) * 20.0 as dx, (p_partkey % 13) * 20.0 as dy, 0.7::double + (p_partkey % 11) * 0.05::double as sx, 0.9::double + (p_partkey % 7) * 0.05::double as sy from part)
select p_partkey, concat_ws('; ', case when abs(dx) > 200 then 'shift in x' end, case when abs(dy) > 200 then 'shift in y' end,
 case when abs(sx - 1) > 0.2 then 'scale in x' end, case when abs(sy - 1) > 0.2 then 'scale in y' end, case when abs(sx - sy) > 0.15 then 'unequal scales' end) as reasons,
 not (abs(dx) > 200 or abs(dy) > 200 or abs(sx - 1) > 0.2 or abs(sy - 1) > 0.2 or abs(sx - sy) > 0.15) as accepted from
 (select p_partkey, dx, dy, sqrt(sx::double * sx::double) as sx, sqrt(sy::double * sy::double) as sy from k) q""")
def sanity_gate(t):
    k = F.col("p_partkey")
    m = M.matrix(
        [F.lit(0.7) + (k % 11) * F.lit(0.05), 0, (k % 29 - 14) * 20.0], [0, F.lit(0.9) + (k % 7) * F.lit(0.05), (k % 13) * 20.0], [0, 0, 1]
    )
    out = P.sanity_gate(t("part").select("p_partkey", m.alias("m")))
    return out.select("p_partkey", F.array_join("reasons", "; ").alias("reasons"), "accepted")


@query("compose_and_invert", "F13", f"""
with {FIT}, v as (select pair_id, a * d - b * c as det, g.* exclude pair_id from g),
i as (select pair_id, d / det as a, -b / det as b, (b * h - d * e) / det as e, -c / det as c, a / det as d, (c * e - a * h) / det as h, a as a0, b as b0, c as c0, d as d0, e as e0, h as h0 from v)
select pair_id, 'inverse' as kind, round(a, 6) + 0 as m00, round(b, 6) + 0 as m01, round(e, 6) + 0 as m02, round(c, 6) + 0 as m10, round(d, 6) + 0 as m11, round(h, 6) + 0 as m12 from i
union all select pair_id, 'square', round(a0*a0 + b0*c0, 6) + 0, round(a0*b0 + b0*d0, 6) + 0, round(a0*e0 + b0*h0 + e0, 6) + 0, round(c0*a0 + d0*c0, 6) + 0, round(c0*b0 + d0*d0, 6) + 0, round(c0*e0 + d0*h0 + h0, 6) + 0 from i
union all select pair_id, 'rescaled', round(a0, 6) + 0, round(b0, 6) + 0, round(e0 * 4, 6) + 0, round(c0, 6) + 0, round(d0, 6) + 0, round(h0 * 4, 6) + 0 from i""")
def compose_and_invert(t):
    fit = pin(P.affine_from_matches(v_match(t), ["pair_id"]))
    m = F.col("m")
    kinds = [("inverse", M.invert(m)), ("square", M.compose(m, m)), ("rescaled", M.rescale(m, 4.0))]
    out = None
    for name, e in kinds:
        part = fit.select("pair_id", F.lit(name).alias("kind"), e.alias("m"))
        out = part if out is None else out.unionByName(part)
    return _entries(out, ["pair_id", "kind"])


@query("work_scale", "F14", """
with k as (select p_partkey, p_size * 800 + p_partkey % 1000 as longest from part), h as (select *, case when longest * 0.5 > 15000 then 10000 / longest else 0.5::double end as s from k)
select p_partkey, round(case when longest * s < 2000 then least(1.0, 2000 / longest) else s end, 6) as scale from h""")
def work_scale(t):
    longest = F.col("p_size") * 800 + F.col("p_partkey") % 1000
    return t("part").select("p_partkey", r6(R.work_scale(longest)).alias("scale"))


@query("interior_keypoints", "F15")
def interior_keypoints(t):
    out = R.interior_keypoints(v_px(t), SK, PX_SHAPE)
    return out.select(*SK, *[r6(n, 3).alias(n) for n in ("y", "x", "sigma", "response")])


# one blob for each supplier, 25 to a frame of 5 x 5 fields of 48 cells, of width 3 or 6 by turns
@query("keypoints_of_blobs", "F15", """
select s_suppkey, (s_suppkey % 25 // 5 * 48 + 24)::double as y, (s_suppkey % 5 * 48 + 24)::double as x, (s_suppkey % 2)::double as octave from supplier""")
def keypoints_of_blobs(t):
    k = F.col("s_suppkey")
    reach = F.sequence(F.lit(-23), F.lit(23))
    # whole frames to a partition: a supplier becomes 2,209 pixels, so the few rows of a file are too many for one task
    dealt = t("supplier").select(k).repartition(max(1, t("supplier").count() // 1000), F.floor(k / 25))
    spread = dealt.select(k, F.explode(reach).alias("i")).withColumn("j", F.explode(reach))
    width = 3.0 * F.pow(F.lit(2.0), k % 2)
    height = 100 + k % 100
    px = spread.select(
        F.floor(k / 25).alias("frame"), (F.floor(k % 25 / 5) * 48 + 24 + F.col("i")).cast("int").alias("r"), (k % 5 * 48 + 24 + F.col("j")).cast("int").alias("c"),
        (height * F.exp(-(F.col("i") * F.col("i") + F.col("j") * F.col("j")) / (2 * width * width))).alias("v"))
    found = R.interior_keypoints(px, ["frame"], (240, 240))
    inner = lambda n: F.floor(F.least(F.col(n), F.lit(239)) / 48)
    field = inner("r") * 5 + inner("c")
    best = found.groupBy((F.col("frame") * 25 + field).alias("s_suppkey")).agg(F.max_by(F.struct("y", "x", "sigma"), "response").alias("b"))
    return best.select("s_suppkey", r6("b.y", 0).alias("y"), r6("b.x", 0).alias("x"), r6(F.log2(F.col("b.sigma") / 3), 0).alias("octave"))


def _embeddings(t):
    e = t("embeddings")
    q = e.filter("vec_id % 2 = 0").select(F.lit("all").alias("g"), F.col("vec_id").alias("q_id"), F.col("embedding").alias("vec"))
    return q, e.filter("vec_id % 2 = 1").select(F.lit("all").alias("g"), F.col("vec_id").alias("t_id"), F.col("embedding").alias("vec"))


TWO = """
x as (select q.vec_id as q_id, t.vec_id as t_id, list_distance(q.embedding::double[], t.embedding::double[]) as d
  from embeddings q join embeddings t on q.vec_id % 2 = 0 and t.vec_id % 2 = 1),
k as (select *, row_number() over (partition by q_id order by d, t_id) as k, lead(d) over (partition by q_id order by d, t_id) as d2 from x)"""


@query("two_nearest", "F16", f"with {TWO} select q_id, t_id, round(d, 6) as d1, round(d2, 6) as d2 from k where k = 1")
def two_nearest_rows(t):
    return two_nearest(*_embeddings(t), ["g"]).select("q_id", "t_id", r6("d1").alias("d1"), r6("d2").alias("d2"))


@query("descriptor_matches", "F16", f"with {TWO} select q_id, t_id, round(d, 6) as d1, round(d2, 6) as d2 from k where k = 1 and d < 0.95 * d2")
def descriptor_matches(t):
    out = ratio_test(two_nearest(*_embeddings(t), ["g"]), 0.95)
    return out.select("q_id", "t_id", r6("d1").alias("d1"), r6("d2").alias("d2"))


# a planted projective map, missed by the matches of three suppliers in ten
MAP = (1.02, -0.05, 3.0, 0.04, 0.98, -2.0, 0.0005, 0.0002, 1.0)
PLANTED = f"""
p as (select l_returnflag as pair_id, l_suppkey % 10 < 3 as far, count(*) as n from lineitem group by 1, 2)
select pair_id, cast(sum(n) as bigint) as n_matches, cast(coalesce(sum(n) filter (where not far), 0) as bigint) as n_inliers, {", ".join(f"{v}::double as m{i // 3}{i % 3}" for i, v in enumerate(MAP[:8]))}
from p group by 1"""


@query("robust_homography", "F17", "with " + PLANTED)
def robust_homography(t):
    x, y, far = F.col("l_quantity").cast("double"), (F.col("l_discount") * 100).cast("double"), F.col("l_suppkey") % 10 < 3
    d = MAP[6] * x + MAP[7] * y + 1
    off = F.when(far, 10 + F.col("l_partkey") % 40).otherwise(0)
    matches = t("lineitem").select(
        F.col("l_returnflag").alias("pair_id"), x.alias("x"), y.alias("y"),
        ((MAP[0] * x + MAP[1] * y + MAP[2]) / d + off).alias("u"), ((MAP[3] * x + MAP[4] * y + MAP[5]) / d - off).alias("w"),
    )
    out = R.robust_homography(matches, ["pair_id"], tolerance=0.05)
    entries = [(F.round(F.get("m", F.lit(i)), 6) + 0).alias(f"m{i // 3}{i % 3}") for i in range(8)]
    return out.select("pair_id", "n_matches", "n_inliers", *entries)


@query("inlier_gate", "F18", """
with k as (select p_partkey, p_size as n, (p_partkey % 10) / 10.0::double as ratio, (p_partkey % 400)::double as dx from part)
select p_partkey, coalesce(case when n < 10 then 'too few matches' when ratio < 0.4 then 'inlier ratio too low' when abs(dx) / 0.5 > 500 then 'correction too large' end, '') as failure_reason,
 not (n < 10 or ratio < 0.4 or abs(dx) / 0.5 > 500) as success from k""")
def inlier_gate(t):
    k = F.col("p_partkey")
    fits = t("part").select(
        "p_partkey", M.translation((k % 400).cast("double"), 0.0).alias("m"), F.col("p_size").alias("n_matches"),
        ((k % 10) / 10.0).alias("inlier_ratio"), F.lit(0.5).alias("work_scale"),
    )
    return R.inlier_gate(fits).select("p_partkey", F.coalesce("failure_reason", F.lit("")).alias("failure_reason"), "success")


@query("accuracy", "F19", f"""
with {FIT}, e as (select v.pair_id, sqrt((a * x + b * y + e - u) ** 2 + (c * x + d * y + h - w) ** 2) as e from v_match v join g on v.pair_id = g.pair_id)
select pair_id, round(quantile_cont(e / 0.5, 0.5), 6) as estimated_accuracy_px from e where e <= 3 group by 1""")
def accuracy(t):
    fits = P.affine_from_matches(v_match(t), ["pair_id"]).select("pair_id", "m", F.lit(True).alias("success"), F.lit(0.5).alias("work_scale"))
    out = R.accuracy(v_match(t), pin(fits), ["pair_id"])
    return out.select("pair_id", r6("estimated_accuracy_px").alias("estimated_accuracy_px"))


@query("register_outline", "F20", TURNED.format(""))
def register_outline(t):
    px, forward = _turned(t, v_px)
    out = R.register_outline(px, ["sample"], (192, 192), down_scale=4.0, boundary_width=4, boundary_smooth=2.0)
    return _positions(out, forward, 2.5)


@query("refine_interior", "F21", TURNED.format("true as success, 1::int as levels_completed, '' as failure_reason, true as matched,"))
def refine_interior(t):
    px, forward = _turned(t)
    start = px.select("sample").distinct().select("sample", M.translation(3, -2).alias("m"))
    out = R.refine_interior(px, start, ["sample"], (192, 192))
    matched = (F.col("n_matches") >= 10).alias("matched")
    return _positions(out, forward, 1.0, "success", "levels_completed", F.coalesce("failure_reason", F.lit("")).alias("failure_reason"), matched)
