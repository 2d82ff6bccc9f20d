"""Queries for masks, morphology and components."""

from pyspark.sql import functions as F

from ..fixtures import LEVELS, PX_SHAPE, v_grid, v_mask, v_px
from ..operators import masks as M
from ..operators.components import components, feature_table
from ..operators.pixels import pair_pixels, shift_pixels
from ..operators.rings import boundary_ring
from ..session import attach, pin
from .base import query, r6

SK = ["sample", "kind"]

# cells reached from the start cells by steps of a neighbourhood, written once
REACH = """
comp(sample, kind, r, c, r0, c0) as (
  select sample, kind, r, c, r, c from m
  union
  select m.sample, m.kind, m.r, m.c, k.r0, k.c0 from comp k, (select a.range - 1 as dr, b.range - 1 as dc from range(3) a, range(3) b) n, m
  where m.sample = k.sample and m.kind = k.kind and m.r = k.r + dr and m.c = k.c + dc),
lab as (select sample, kind, r, c, min((r0 + 1) * 4294967296 + c0 + 1) as l from comp group by 1, 2, 3, 4)"""


def mask_runs(t):
    return pin(M.pixels_to_runs(v_mask(t), SK))


@query("dilate_cross", "D1", """
select distinct k.sample, k.kind, k.r, k.c from v_cells k join v_mask m
on k.sample = m.sample and k.kind = m.kind and abs(k.r - m.r) + abs(k.c - m.c) <= 5""")
def dilate_cross(t):
    return M.runs_to_pixels(M.clip_runs(M.dilate_cross(mask_runs(t), SK, 5), SK, PX_SHAPE))


@query("erode_square", "D2", """
with m as (select * from v_px where v >= 10),
n as (select a.sample, a.kind, a.r, a.c, count(*) as n from m a join m b on a.sample = b.sample and a.kind = b.kind
  and abs(a.r - b.r) <= 1 and abs(a.c - b.c) <= 1 group by 1, 2, 3, 4)
select sample, kind, r, c from n where n = 9""")
def erode_square(t):
    runs = M.pixels_to_runs(v_px(t).filter("v >= 10"), SK)
    return M.runs_to_pixels(M.erode_square(runs, SK, 1))


@query("close_ellipse", "D3", """
with e as (select a.range - 3 as dr, b.range - 3 as dc from range(7) a, range(7) b
  where abs(b.range - 3) <= round_even(sqrt(9 - (a.range - 3) * (a.range - 3)), 0)),
d as (select distinct sample, kind, r + dr as r, c + dc as c from v_mask, e),
nd as (select k.* from v_cells k anti join d on d.sample = k.sample and d.kind = k.kind and d.r = k.r and d.c = k.c),
bad as (select distinct sample, kind, r - dr as r, c - dc as c from nd, e)
select k.sample, k.kind, k.r, k.c from v_cells k anti join bad b
on b.sample = k.sample and b.kind = k.kind and b.r = k.r and b.c = k.c""")
def close_ellipse(t):
    return M.runs_to_pixels(M.close_ellipse(mask_runs(t), SK, 3, PX_SHAPE))


FILLED = """
bg as (select a.range - 1 as r, b.range - 1 as c, s.sample, s.kind from range(130) a, range(130) b,
    (select distinct sample, kind from m) s
  where not exists (select 1 from m where m.sample = s.sample and m.kind = s.kind and m.r = a.range - 1 and m.c = b.range - 1)),
out_cells(sample, kind, r, c) as (
  select sample, kind, r, c from bg where r = -1 and c = -1
  union
  select b.sample, b.kind, b.r, b.c from out_cells o, (values (0, 1), (0, -1), (1, 0), (-1, 0)) n(dr, dc), bg b
  where b.sample = o.sample and b.kind = o.kind and b.r = o.r + dr and b.c = o.c + dc)"""


@query("fill_holes", "D4", f"""
with recursive m as (select sample, kind, r, c from v_px where v >= 20), {FILLED}
select k.sample, k.kind, k.r, k.c from v_cells k where not exists
 (select 1 from out_cells o where o.sample = k.sample and o.kind = k.kind and o.r = k.r and o.c = k.c)""")
def fill_holes(t):
    return M.runs_to_pixels(M.fill_holes(M.pixels_to_runs(v_px(t).filter("v >= 20"), SK), SK))


@query("connected_components", "D5", f"""
with recursive m as (select sample, kind, r, c from v_mask), {REACH}
select sample, kind, r, c, l as label from lab""")
def connected_components(t):
    return M.runs_to_pixels(components(mask_runs(t), SK, 8, block_rows=64))


@query("largest_component", "D6", f"""
with recursive m as (select sample, kind, r, c from v_mask), {REACH},
a as (select sample, kind, l, count(*) as n from lab group by 1, 2, 3),
b as (select sample, kind, l, row_number() over (partition by sample, kind order by n desc, l) as k from a)
select lab.sample, lab.kind, lab.r, lab.c from lab join b
 on b.k = 1 and lab.sample = b.sample and lab.kind = b.kind and lab.l = b.l""")
def largest_component(t):
    labelled = pin(components(mask_runs(t), SK, 8))
    return M.runs_to_pixels(M.largest_component(labelled, SK))


@query("tissue_mask", "D7", f"""
with recursive s as (select * from v_px where v > 60),
m as (select distinct k.sample, k.kind, k.r, k.c from v_cells k join s
  on k.sample = s.sample and k.kind = s.kind and abs(k.r - s.r) + abs(k.c - s.c) <= 2), {FILLED},
f as (select k.sample, k.kind, k.r, k.c from v_cells k where not exists
  (select 1 from out_cells o where o.sample = k.sample and o.kind = k.kind and o.r = k.r and o.c = k.c))
select a.sample, round(count(*) / 16384.0, 6) as coverage,
  case when count(*) / 16384.0 > 0.05 then 'OK' else 'LOW' end as verdict
from f a join f b on a.sample = b.sample and a.r = b.r and a.c = b.c and a.kind = 'post' and b.kind = 'pre' group by 1""")
def tissue_mask(t):
    mask = M.tissue_mask(v_px(t), ["sample"], PX_SHAPE, 60.0, 2)
    out = M.mask_coverage(mask, ["sample"], PX_SHAPE)
    return out.select("sample", r6("coverage").alias("coverage"), "verdict")


@query("clean_tissue_mask", "D8", f"""
with recursive m as (select sample, kind, r, c from v_px where v > 0), {FILLED},
f as (select k.sample, k.kind, k.r, k.c from v_cells k where not exists
  (select 1 from out_cells o where o.sample = k.sample and o.kind = k.kind and o.r = k.r and o.c = k.c))
select a.sample, a.r, a.c from f a join f b
on a.sample = b.sample and a.r = b.r and a.c = b.c and a.kind = 'post' and b.kind = 'pre'""")
def clean_tissue_mask(t):
    return M.runs_to_pixels(M.clean_tissue_mask(v_px(t), ["sample"]))


@query("boundary_ring", "D9")
def boundary_ring_query(t):
    px = shift_pixels(v_px(t), 40, 40).withColumn("v", F.col("v") / 255.0)
    ring = boundary_ring(px, SK, (208, 208), boundary_width=4, boundary_smooth=2.0)
    return ring.select(*SK, "r", "c", "ring", r6("v").alias("v"))


CONTOUR = """
select k.sample, k.kind, k.r, k.c from m k where (select count(*) from m n where n.sample = k.sample
 and n.kind = k.kind and abs(n.r - k.r) + abs(n.c - k.c) = 1) < 4"""


@query("outer_contour", "D10", f"with m as (select sample, kind, r, c from v_px where v >= 15) {CONTOUR}")
def outer_contour(t):
    return M.contour_pixels(M.pixels_to_runs(v_px(t).filter("v >= 15"), SK), SK)


@query("outer_contour_of_largest", "D10")
def outer_contour_of_largest(t):
    return M.outer_contour_of_largest(M.pixels_to_runs(v_px(t).filter("v >= 20"), SK), SK)


@query("feature_table", "D11", f"""
with recursive d as (select sample, r, c, post - pre as d from v_pair),
s as (select sample, stddev_pop(d) as sd from d where d <> 0 group by 1),
m as (select d.sample, 'post' as kind, r, c from d join s on d.sample = s.sample where d > 1.5 * sd), {REACH}
select lab.sample, l as label, round(avg(lab.r), 6) as centroid_r, round(avg(lab.c), 6) as centroid_c, count(*) as area,
  round(avg(d.d), 6) as mean_intensity
from lab join d on lab.sample = d.sample and lab.r = d.r and lab.c = d.c group by 1, 2 having count(*) >= 2""")
def features(t):
    diff = pair_pixels(v_px(t), ["sample"]).withColumn("d", F.col("post") - F.col("pre"))
    out = feature_table(diff, ["sample"], 1.5, 2)
    names = ["centroid_r", "centroid_c", "mean_intensity"]
    return out.select("sample", "label", "area", *[r6(n).alias(n) for n in names])


@query("tissue_edge", "D12", f"with m as (select 'all' as sample, kind, r, c from v_grid where v > 0), x as ({CONTOUR}) select kind, r, c from x")
def tissue_edge(t):
    return M.contour_pixels(M.pixels_to_runs(v_grid(t).filter("v > 0"), ["kind"]), ["kind"])
