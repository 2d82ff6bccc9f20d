"""Queries for the diagnostics."""

from pyspark.sql import functions as F

from ..fixtures import LEVELS, PX_SHAPE, v_grid, v_mask, v_px, v_ratio, v_ratio_stored
from ..operators import diagnostics as D
from ..operators.masks import contour_pixels, pixels_to_runs
from ..operators.pixels import pair_pixels
from ..operators.scale import least_squares_scale
from ..session import pin
from .base import query, r6

SD = ["sample", "dye"]


def pairs_of(t):
    return pair_pixels(v_px(t), ["sample"])


GRID = """
g as (select sample, cast(least(greatest(round_even(pre, 0), 0), 255) as int) as a, cast(least(greatest(round_even(post, 0), 0), 255) as int) as b from v_pair),
g1 as (select sample, a, b, count(*) as n from g group by 1, 2, 3),
grid as (select sample, a, b, cast(sum(n) as bigint) as n from (select * from g1 union all select sample, 0, 0, 16384 - sum(n) from g1 group by 1) q group by 1, 2, 3)"""


@query("density_grid", "H1", f"""
with {GRID} select sample, a as pre_level, b as post_level, n, round(log10(n), 6) as log_n from grid where n > 0""")
def density_grid(t):
    return D.density_grid(pairs_of(t), ["sample"], PX_SHAPE).withColumn("log_n", r6("log_n"))


@query("density_limits", "H1", f"""
with {GRID} select sample, round(min(log10(n)), 6) as lo, round(max(log10(n)), 6) as hi from grid where n > 0 and (a <> 0 or b <> 0) group by 1""")
def density_limits(t):
    return D.density_limits(D.density_grid(pairs_of(t), ["sample"], PX_SHAPE), ["sample"]).select("sample", r6("lo").alias("lo"), r6("hi").alias("hi"))


@query("excess_grid", "H2", f"""
with {GRID}, pos as (select * from grid where n > 0),
vals as (select distinct sample, b as v from pos),
near as (select p.sample, p.a, v, row_number() over (partition by p.sample, p.a order by abs(p.a - v), v desc) as k
  from (select distinct sample, a from pos) p join vals on p.sample = vals.sample),
s as (select pos.sample, near.v as a, b, sum(n) as n from pos join near on pos.sample = near.sample and pos.a = near.a and k = 1 group by 1, 2, 3),
e as (select coalesce(x.sample, y.sample) as sample, coalesce(x.a, y.b) as a, coalesce(x.b, y.a) as b, coalesce(x.n, 0) - coalesce(y.n, 0) as e
  from s x full outer join s y on x.sample = y.sample and x.a = y.b and x.b = y.a)
select sample, a as pre_value, b as post_value, cast(e as bigint) as excess, round(log10(e), 6) as log_excess from e where b > a and e > 0""")
def excess_grid(t):
    return D.excess_grid(pairs_of(t), ["sample"], PX_SHAPE).withColumn("log_excess", r6("log_excess"))


@query("brightness_histograms", "H3", """
with p as (select * from v_pair where post > 0 or pre > 0),
v as (select sample, 'post' as series, post as v from p union all select sample, 'pre', pre from p),
cap as (select sample, greatest(1, cast(ceil(quantile_cont(v, 0.999)) as int)) as cap from v group by 1),
vals as (select distinct v.sample, cast(round_even(v, 0) as int) as i from v join cap on v.sample = cap.sample where v <= cap),
d as (select cap.sample, cap, count(i) >= 0.30 * (cap + 1) as dense from cap join vals on cap.sample = vals.sample group by 1, 2),
b as (select v.sample, series, least(cap, cast(floor(v + 0.5) as int)) as value, dense from v join d on v.sample = d.sample where v <= cap + 0.5),
c as (select sample, series, value, count(*) as n, bool_and(dense) as dense from b group by 1, 2, 3),
l as (select sample, series, coalesce(max(n) filter (where value = 0), 0) > 5 * max(n) filter (where value <> 0) as lg from c group by 1, 2)
select c.sample, series, value, n, dense, (select max(lg) from l where l.sample = c.sample) as log_axis from c""")
def brightness_histograms(t):
    return D.brightness_histograms(pairs_of(t), ["sample"], LEVELS)


@query("difference_histogram", "H4", """
with p as (select sample, cast(round_even(post - pre, 0) as int) as d, count(*) as n, count(*) filter (where post > 0 and pre > 0) as n_both,
  count(*) filter (where post > 0 and pre <= 0) as n_post_only from v_pair group by 1, 2),
u as (select * from p union all select sample, 0, 16384 - sum(n), 0, 0 from p group by 1)
select sample, d, cast(sum(n) as bigint) as n, cast(sum(n_both) as bigint) as n_both, cast(sum(n_post_only) as bigint) as n_post_only
from u group by 1, 2 having sum(n) > 0""")
def difference_histogram(t):
    return D.difference_histogram(pairs_of(t), ["sample"], PX_SHAPE)


@query("ratio_report", "H5")
def ratio_report(t):
    return D.ratio_report(v_ratio_stored(t), SD).select(*SD, "kind", r6("x").alias("x"), r6("y", 3).alias("y"))


@query("difference_display", "H6", """
with d as (select sample, r, c, post - 1.25 * pre as d from v_pair where post > 0 or pre > 0),
k as (select sample, greatest(quantile_cont(abs(d), 0.5), 1.0) as knee from d group by 1),
s as (select d.sample, r, c, d, knee, asinh(d / knee) as display from d join k on d.sample = k.sample),
l as (select sample, quantile_cont(abs(display), 0.95) as lim from s group by 1)
select s.sample, r, c, round(d, 6) + 0 as d, round(display, 6) + 0 as display, round(knee, 6) as knee, round(lim, 6) as limit
from s join l on s.sample = l.sample""")
def difference_display(t):
    out = D.difference_display(pairs_of(t), ["sample"], 1.25)
    return out.select("sample", "r", "c", *[r6(n).alias(n) for n in ("d", "display", "knee", "limit")])


# scales of the comparison queries: least squares and its 0.9-fold
def _two_scales(pairs, keys):
    return least_squares_scale(pairs, keys).select(*keys, F.col("scale").alias("ls_scale"), (F.col("scale") * 0.9).alias("opt_scale"))


TWO = "sc as (select sample, sum(post * pre) / sum(pre * pre) as ls, sum(post * pre) / sum(pre * pre) * 0.9 as op from v_pair group by 1)"


@query("residual_histogram", "H7", f"""
with {TWO}, p as (select v.*, ls, op from v_pair v join sc on v.sample = sc.sample),
u as (select sample, 'ls_all' as series, post - ls * pre as d from p union all select sample, 'robust_all', post - op * pre from p
 union all select sample, 'ls_fit', post - ls * pre from p where post > 0 and pre > 0
 union all select sample, 'robust_fit', post - op * pre from p where pre > 0 and post / pre <= op),
l as (select sample, quantile_cont(d, 0.005) as lo, quantile_cont(d, 0.995) as hi from u where series in ('ls_all', 'robust_all') group by 1),
b as (select u.sample, series, least(99, floor((d - lo) / (hi - lo) * 100)) as bin from u join l on u.sample = l.sample where d between lo and hi)
select s.sample, s.series, cast(i.range as int) as bin, count(b.bin) as n from (select distinct sample, series from u) s cross join range(100) i
left join b on b.sample = s.sample and b.series = s.series and b.bin = i.range group by 1, 2, 3""")
def residual_histogram(t):
    pairs = pairs_of(t)
    cells = pairs.withColumn("in_fit", (F.col("post") > 0) & (F.col("pre") > 0))
    return D.residual_histogram(cells, ["sample"], _two_scales(pairs, ["sample"])).select("sample", "series", "bin", "n")


@query("density_scatter", "H8", """
with t as (select *, row_number() over (partition by sample order by post desc, r, c) as k from v_pair where post > 0 and pre > 0),
p as (select sample, r, c, log10(pre) as x, log10(post) as y from t where k <= 2000),
s as (select sample, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from p group by 1),
b as (select p.*, least(199, floor((x - x0) / (x1 - x0) * 200)) as bx, case when y1 > y0 then least(199, floor((y - y0) / (y1 - y0) * 200)) else 0 end as by_
  from p join s on p.sample = s.sample),
n as (select sample, bx, by_, count(*) as n from b group by 1, 2, 3), m as (select sample, max(n) as m from n group by 1)
select b.sample, r, c, round(x, 6) + 0 as log_pre, round(y, 6) + 0 as log_post, round(n.n / m.m, 6) as density
from b join n on b.sample = n.sample and b.bx = n.bx and b.by_ = n.by_ join m on m.sample = b.sample""")
def density_scatter(t):
    out = D.density_scatter(pairs_of(t), ["sample"], 2000)
    return out.select("sample", "r", "c", *[r6(n).alias(n) for n in ("log_pre", "log_post", "density")])


@query("ratio_markers", "H9", """
select sample, dye, round(quantile_cont(post / pre, 0.1), 6) as p10, round(quantile_cont(post / pre, 0.25), 6) as p25,
 round(quantile_cont(post / pre, 0.5), 6) as p50, round(quantile_cont(post / pre, 0.75), 6) as p75, round(quantile_cont(post / pre, 0.9), 6) as p90
from v_ratio group by 1, 2""")
def ratio_markers(t):
    return D.ratio_markers(v_ratio_stored(t), SD).select(*SD, *[r6(f"p{p}").alias(f"p{p}") for p in (10, 25, 50, 75, 90)])


PANELS = f"""
{TWO}, d as (select v.sample, r, c, 'ls' as panel, post - ls * pre as d from v_pair v join sc on v.sample = sc.sample where post > 0
 union all select v.sample, r, c, 'robust', post - op * pre from v_pair v join sc on v.sample = sc.sample where post > 0)"""


@query("difference_panels", "H10", f"""
with {PANELS}, l as (select sample, panel, quantile_cont(abs(d), 0.99) as lim from d group by 1, 2)
select d.sample, d.panel, r, c, round(d, 6) + 0 as d, round(lim, 6) as limit from d join l on d.sample = l.sample and d.panel = l.panel""")
def difference_panels(t):
    pairs = pairs_of(t)
    return D.difference_panels(pairs, ["sample"], _two_scales(pairs, ["sample"])).select("sample", "panel", "r", "c", r6("d").alias("d"), r6("limit").alias("limit"))


@query("stretch_panels", "H11", f"""
with {PANELS}, k as (select sample, panel, greatest(quantile_cont(abs(d), 0.1), 0.5) as knee, avg(d) as mu, greatest(stddev_pop(d), 1e-8) as sd from d group by 1, 2),
x as (select d.*, knee, mu, sd from d join k on d.sample = k.sample and d.panel = k.panel)
select sample, panel, r, c, 'asinh' as stretch, round(asinh(d / knee), 6) + 0 as value from x
union all select sample, panel, r, c, 'signed_log', round(sign(d) * log10(abs(d) + 1), 6) + 0 from x
union all select sample, panel, r, c, 'zscore', round((d - mu) / sd, 6) + 0 from x""")
def stretch_panels(t):
    pairs = pairs_of(t)
    return D.stretch_panels(pairs, ["sample"], _two_scales(pairs, ["sample"])).withColumn("value", r6("value"))


@query("zoom_at_densest", "H12", f"""
with {TWO}, k as (select distinct sample, r, c from v_cells), m as (select sample, r, c from v_pair where post > 0),
y as (select k.sample, k.r, k.c, count(m.r) as n from k left join m on m.sample = k.sample and m.c = k.c and m.r between k.r - 15 and k.r + 14 group by 1, 2, 3),
n as (select k.sample, k.r, k.c, sum(y.n) as n from k join y on y.sample = k.sample and y.r = k.r and y.c between k.c - 15 and k.c + 14 group by 1, 2, 3),
b as (select *, row_number() over (partition by sample order by n desc, r, c) as i from n),
w as (select sample, greatest(0, least(r - 15, 98)) as r0, greatest(0, least(c - 15, 98)) as c0 from b where i = 1)
select p.sample, cast(r - r0 as int) as r, cast(c - c0 as int) as c, post, pre, round(post - ls * pre, 6) + 0 as d_ls, round(post - op * pre, 6) + 0 as d_robust
from v_pair p join w on p.sample = w.sample join sc on sc.sample = p.sample where r >= r0 and r < r0 + 30 and c >= c0 and c < c0 + 30""")
def zoom_at_densest(t):
    pairs = pairs_of(t)
    out = D.zoom_at_densest(pairs, ["sample"], PX_SHAPE, _two_scales(pairs, ["sample"]), 30)
    return out.withColumn("d_ls", r6("d_ls")).withColumn("d_robust", r6("d_robust"))


@query("registration_check", "H13", """
with k as (select sample, kind, cast(r // 4 as int) as r, cast(c // 4 as int) as c, sum(v) / 16 as v from v_px group by 1, 2, 3, 4),
d as (select sample, r, c, coalesce(max(case when kind = 'post' then v end), 0) - coalesce(max(case when kind = 'pre' then v end), 0) as d from k group by 1, 2, 3),
l as (select sample, quantile_cont(abs(d), 0.95) as lim from d where d <> 0 group by 1)
select d.sample, r, c, round(d, 6) + 0 as d, round(lim, 6) as limit from d join l on d.sample = l.sample where d <> 0""")
def registration_check(t):
    out = D.registration_check(v_px(t), ["sample"], PX_SHAPE, 4)
    return out.select("sample", "r", "c", r6("d").alias("d"), r6("limit").alias("limit"))


@query("ring_overlay", "H13", """
select sample, kind, r, c, 'before' as step from v_px p where v >= 15 and (select count(*) from v_px n where n.sample = p.sample
 and n.kind = p.kind and n.v >= 15 and abs(n.r - p.r) + abs(n.c - p.c) = 1) < 4
union all select sample, kind, r, c, 'after' from v_mask""")
def ring_overlay(t):
    keys = ["sample", "kind"]
    before = contour_pixels(pixels_to_runs(v_px(t).filter("v >= 15"), keys), keys)
    return D.ring_overlay({"before": before, "after": v_mask(t)}, keys)


@query("blink_pair", "H14", """
with f as (select max(greatest(1, cast(ceil(greatest(h, w) / 50.0) as int))) as s from (select kind, max(r) + 1 as h, max(c) + 1 as w from v_grid group by 1))
select 'all' as sample, cast(r // s as int) as r, cast(c // s as int) as c, coalesce(max(case when kind = 'post' then v end), 0) as a,
 coalesce(max(case when kind = 'pre' then v end), 0) as b from v_grid, f where r % s = 0 and c % s = 0 group by 1, 2, 3""")
def blink_pair(t):
    grid = v_grid(t).withColumn("sample", F.lit("all"))
    frames = grid.groupBy("sample", "kind").agg((F.max("r") + 1).alias("height"), (F.max("c") + 1).alias("width"))
    return D.blink_pair(grid, ["sample"], frames, 50)
