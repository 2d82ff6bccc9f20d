"""Queries for neighbourhood filters and resampling."""

from pyspark.sql import functions as F

from ..fixtures import LEVELS, PX_SHAPE, v_grid, v_px
from ..functions import matrices as M
from ..operators import filters as N
from ..operators import warp as W
from ..operators.pixels import pair_pixels, shift_pixels
from ..session import pin
from .base import query, r6

SK = ["sample", "kind"]


def grid_frames(grid):
    return pin(grid.groupBy("kind").agg((F.max("r") + 1).alias("height"), (F.max("c") + 1).alias("width")))


@query("area_downsample", "E1", """
select sample, kind, cast(r // 4 as int) as r, cast(c // 4 as int) as c, round(sum(v) / 16, 6) as v from v_px group by 1, 2, 3, 4""")
def area_downsample(t):
    return N.area_downsample(v_px(t), SK, PX_SHAPE, 4).select(*SK, "r", "c", r6("v").alias("v"))


@query("area_downsample_fractional", "E1", """
with o as (select cast(range as int) as i, range * (128 / 51.0) as a, (range + 1) * (128 / 51.0) as b from range(51))
select p.sample, p.kind, y.i as r, x.i as c,
 round(sum(v * (least(y.b, r + 1.0) - greatest(y.a, r)) * (least(x.b, c + 1.0) - greatest(x.a, c))) / ((128 / 51.0) * (128 / 51.0)), 4) as v
from v_px p join o y on y.a < p.r + 1 - 1e-12 and y.b > p.r + 1e-12 join o x on x.a < p.c + 1 - 1e-12 and x.b > p.c + 1e-12 group by 1, 2, 3, 4""")
def area_downsample_fractional(t):
    return N.area_downsample(v_px(t), SK, PX_SHAPE, 2.5).select(*SK, "r", "c", r6("v", 4).alias("v"))


@query("box_mean", "E2", """
select k.kind, k.r, k.c, round(sum(p.v) / 25.0, 6) as v from v_grid k join v_grid p
on k.kind = p.kind and abs(k.r - p.r) <= 2 and abs(k.c - p.c) <= 2 group by 1, 2, 3 having sum(p.v) <> 0""")
def box_mean(t):
    grid = v_grid(t)
    out = N.box_mean(grid, ["kind"], grid_frames(grid), 5, tile=64)
    return out.select("kind", "r", "c", r6("v").alias("v"))


WEIGHTS = """
w0 as (select range - 4 as o, exp(-0.5 * (range - 4) * (range - 4)) as w from range(9)),
w as (select o, w / (select sum(w) from w0) as w from w0)"""


@query("gaussian_blur", "E3", f"""
with f as (select kind, max(r) + 1 as h, max(c) + 1 as wd from v_grid group by 1), {WEIGHTS},
g as (select g.kind, g.r, g.c, g.v, h, wd from v_grid g join f on g.kind = f.kind),
rows_ as (select k.kind, k.r, k.c, sum(p.v * w.w) as v, max(k.wd) as wd from g k join w on true
  join g p on p.kind = k.kind and p.c = k.c
  and p.r = case when k.r + w.o < 0 then -1 - (k.r + w.o) when k.r + w.o >= k.h then 2 * k.h - 1 - (k.r + w.o) else k.r + w.o end
  group by 1, 2, 3)
select k.kind, k.r, k.c, round(sum(p.v * w.w), 6) as v from rows_ k join w on true
  join rows_ p on p.kind = k.kind and p.r = k.r
  and p.c = case when k.c + w.o < 0 then -1 - (k.c + w.o) when k.c + w.o >= k.wd then 2 * k.wd - 1 - (k.c + w.o) else k.c + w.o end
  group by 1, 2, 3""")
def gaussian_blur(t):
    grid = v_grid(t)
    out = N.gaussian_blur(grid, ["kind"], grid_frames(grid), 1.0, tile=64)
    return out.select("kind", "r", "c", r6("v").alias("v"))


@query("nan_conserving_blur", "E4", f"""
with {WEIGHTS}, g as (select kind, r, c, case when v > 100 then null else v end as v from v_grid),
y as (select p.kind, p.r - w.o as r, p.c, sum(coalesce(p.v, 0) * w.w) as s,
   sum(case when p.v is not null then w.w else 0 end) as known from g p, w group by 1, 2, 3),
a as (select kind, r, c - w.o as c, sum(s * w.w) as s, sum(known * w.w) as known from y, w group by 1, 2, 3)
select g.kind, g.r, g.c, round(coalesce(s + (1 - known) * g.v, -1), 6) + 0 as v
from g join a on g.kind = a.kind and g.r = a.r and g.c = a.c""")
def nan_conserving_blur(t):
    grid = v_grid(t)
    masked = grid.withColumn("v", F.when(F.col("v") <= 100, F.col("v")))
    out = N.nan_conserving_blur(masked, ["kind"], grid_frames(grid), 1.0, tile=64)
    # the blur keeps zero rows implicit: list every cell
    full = grid.select("kind", "r", "c", (F.col("v") > 100).alias("gap")).join(out, ["kind", "r", "c"], "left")
    v = F.when(F.col("gap"), -1.0).otherwise(F.coalesce("v", F.lit(0.0)))
    return full.select("kind", "r", "c", r6(v).alias("v"))


@query("unsharp", "E5", f"""
with f as (select kind, max(r) + 1 as h, max(c) + 1 as wd from v_grid group by 1), {WEIGHTS},
g as (select g.kind, g.r, g.c, g.v, h, wd from v_grid g join f on g.kind = f.kind),
k as (select g.*, w.w, case when r + w.o < 0 then -(r + w.o) when r + w.o >= h then 2 * h - 2 - (r + w.o) else r + w.o end as pr,
  case when c + w.o < 0 then -(c + w.o) when c + w.o >= wd then 2 * wd - 2 - (c + w.o) else c + w.o end as pc from g, w),
y as (select k.kind, k.r, k.c, sum(p.v * k.w) as v from k join g p on p.kind = k.kind and p.c = k.c and p.r = k.pr group by 1, 2, 3),
b as (select k.kind, k.r, k.c, sum(p.v * k.w) as v from k join y p on p.kind = k.kind and p.r = k.r and p.c = k.pc group by 1, 2, 3),
u as (select g.kind, g.r, g.c, greatest(g.v - b.v, 0) as u from g join b on g.kind = b.kind and g.r = b.r and g.c = b.c)
select kind, r, c, round(u / ((select max(u) from u x where x.kind = u.kind) + 1e-8), 6) as v from u where u > 1e-9""")
def unsharp(t):
    grid = v_grid(t)
    out = N.unsharp(grid, ["kind"], grid_frames(grid), 1.0, tile=64)
    top = F.col("v") > 1e-11
    return out.filter(top).select("kind", "r", "c", r6("v").alias("v"))


@query("registration_input", "E6")
def registration_input(t):
    out = N.registration_input(
        shift_pixels(v_px(t), 40, 40), ["sample"], (208, 208), gauss_sigma=1.0, use_edges=True, boundary_width=4, boundary_smooth=2.0, levels=LEVELS
    )
    return out.select(*SK, "r", "c", "ring", r6("v").alias("v"))


# fixed test map: small turn, scale, shear, shift and perspective
MAP = [1.03, -0.04, 2.25, 0.05, 0.97, -1.5, 0.0001, -0.00005, 1.0]
SOURCE = """
p as (select k.sample, k.r, k.c, (1.03 * k.c - 0.04 * k.r + 2.25) / (0.0001 * k.c - 0.00005 * k.r + 1) as x,
  (0.05 * k.c + 0.97 * k.r - 1.5) / (0.0001 * k.c - 0.00005 * k.r + 1) as y from v_cells k where kind = 'pre')"""


def fixed_map(px, m=MAP):
    return px.select("sample").distinct().withColumn("m", F.array(*[F.lit(float(x)) for x in m]))


@query("warp_bilinear", "E7", f"""
with {SOURCE}
select p.sample, p.r, p.c, round(sum(s.v * (1 - abs(p.x - s.c)) * (1 - abs(p.y - s.r))), 6) as v
from p join (values (0, 0), (0, 1), (1, 0), (1, 1)) o(dr, dc) on true
join v_px s on s.sample = p.sample and s.kind = 'pre' and s.r = cast(floor(p.y) as int) + o.dr and s.c = cast(floor(p.x) as int) + o.dc
where abs(p.x - s.c) < 1 and abs(p.y - s.r) < 1 group by 1, 2, 3 having sum(s.v * (1 - abs(p.x - s.c)) * (1 - abs(p.y - s.r))) > 1e-6""")
def warp_bilinear(t):
    px = v_px(t).filter("kind = 'pre'").drop("kind")
    out = W.warp_bilinear(px, ["sample"], PX_SHAPE, fixed_map(px))
    return out.filter("v > 1e-6").select("sample", "r", "c", r6("v").alias("v"))


@query("warp_nearest", "E8", f"""
with {SOURCE}
select p.sample, p.r, p.c, s.v from p join v_px s on s.sample = p.sample and s.kind = 'pre'
and s.r = cast(floor(p.y + 0.5) as int) and s.c = cast(floor(p.x + 0.5) as int)""")
def warp_nearest(t):
    px = v_px(t).filter("kind = 'pre'").drop("kind")
    return W.warp_nearest(px, ["sample"], PX_SHAPE, fixed_map(px))


@query("rotate_and_scale", "E9", """
with q as (select k.sample, k.r, k.c, cos(radians(10)) / 1.05 as a, sin(radians(10)) / 1.05 as b, k.c - 60.0 as u, k.r - 70.0 as w
  from v_cells k where kind = 'pre'),
p as (select sample, r, c, a * u - b * w + 60 as x, b * u + a * w + 70 as y from q)
select p.sample, p.r, p.c, round(sum(s.v * (1 - abs(p.x - s.c)) * (1 - abs(p.y - s.r))), 6) as v
from p join (values (0, 0), (0, 1), (1, 0), (1, 1)) o(dr, dc) on true
join v_px s on s.sample = p.sample and s.kind = 'pre' and s.r = cast(floor(p.y) as int) + o.dr and s.c = cast(floor(p.x) as int) + o.dc
where abs(p.x - s.c) < 1 and abs(p.y - s.r) < 1 group by 1, 2, 3 having sum(s.v * (1 - abs(p.x - s.c)) * (1 - abs(p.y - s.r))) > 1e-6""")
def rotate_and_scale(t):
    px = v_px(t).filter("kind = 'pre'").drop("kind")
    turns = px.select("sample").distinct().select(
        "sample", F.lit(10.0).alias("angle"), F.lit(1.05).alias("scale"), F.lit(60.0).alias("cx"), F.lit(70.0).alias("cy")
    )
    out = W.rotate_and_scale(px, ["sample"], PX_SHAPE, turns)
    return out.filter("v > 1e-6").select("sample", "r", "c", r6("v").alias("v"))


@query("shift_image", "E9", """
select s.sample, s.kind, k.r, k.c, round(sum(s.v * (1 - abs(k.c - 3.5 - s.c)) * (1 - abs(k.r + 2.25 - s.r))), 6) as v
from v_cells k join v_px s on s.sample = k.sample and s.kind = k.kind and s.r in (k.r + 2, k.r + 3) and s.c in (k.c - 4, k.c - 3)
group by 1, 2, 3, 4""")
def shift_image(t):
    px = v_px(t)
    offsets = px.select(*SK).distinct().withColumn("dx", F.lit(3.5)).withColumn("dy", F.lit(-2.25))
    return W.shift_image(px, SK, PX_SHAPE, offsets).select(*SK, "r", "c", r6("v").alias("v"))


@query("densest_window", "E10", """
with m as (select kind, r, c from v_grid where v > 60),
f as (select kind, max(r) + 1 as h, max(c) + 1 as wd from v_grid group by 1),
n as (select k.kind, k.r, k.c, count(*) as n from v_grid k join m on k.kind = m.kind
  and m.r between k.r - 10 and k.r + 9 and m.c between k.c - 10 and k.c + 9 group by 1, 2, 3),
b as (select *, row_number() over (partition by kind order by n desc, r, c) as k from n)
select b.kind, cast(greatest(0, least(b.r - 10, h - 20)) as int) as r0, cast(greatest(0, least(b.c - 10, wd - 20)) as int) as c0, n
from b join f on b.kind = f.kind where k = 1""")
def densest_window(t):
    grid = v_grid(t)
    return N.densest_window(grid.filter("v > 60"), ["kind"], grid_frames(grid), 20)


@query("local_zscore", "B10", """
with d as (select sample, r, c, post - pre as d from v_pair),
w0 as (select range - 8 as o, exp(-0.5 * (range - 8) * (range - 8) / 4.0) as w from range(17)),
w as (select o, w / (select sum(w) from w0) as w from w0),
a as (select k.sample, k.r, k.c, wy.w * wx.w as w, k.d,
   case when k.r + wy.o < 0 then -1 - (k.r + wy.o) when k.r + wy.o >= 128 then 255 - (k.r + wy.o) else k.r + wy.o end as pr,
   case when k.c + wx.o < 0 then -1 - (k.c + wx.o) when k.c + wx.o >= 128 then 255 - (k.c + wx.o) else k.c + wx.o end as pc
  from d k, w wy, w wx),
s as (select a.sample, a.r, a.c, max(a.d) as d, sum(a.w) as w, sum(a.w * p.d) as s1, sum(a.w * p.d * p.d) as s2
  from a join d p on p.sample = a.sample and p.r = a.pr and p.c = a.pc group by 1, 2, 3)
select sample, r, c, round((d - s1 / (w + 1e-8)) / (sqrt(greatest(s2 / (w + 1e-8) - (s1 / (w + 1e-8)) ** 2, 0)) + 1e-8), 4) + 0 as z from s""")
def local_zscore(t):
    diff = pair_pixels(v_px(t), ["sample"]).withColumn("d", F.col("post") - F.col("pre"))
    out = N.local_zscore(diff, ["sample"], PX_SHAPE, 2.0, tile=64)
    return out.select("sample", "r", "c", r6("z", 4).alias("z"))
