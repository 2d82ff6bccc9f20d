"""Queries for scale estimation and subtraction."""

from pyspark.sql import functions as F

from ..fixtures import LEVELS, PX_SHAPE, v_px, v_ratio, v_ratio_stored
from ..operators import scale as S
from ..operators.pixels import pair_pixels
from .base import query, r6

SD = ["sample", "dye"]

HIST = """
x as (select sample, dye, log10(post / pre) as x from v_ratio where post > 0 and pre > 0),
l as (select sample, dye, min(x) as lo, max(x) as hi from x group by 1, 2),
b as (select x.sample, x.dye, least({n} - 1, floor((x - lo) / (hi - lo) * {n})) as bin from x join l on x.sample = l.sample and x.dye = l.dye),
h as (select l.sample, l.dye, lo, hi, i.range as bin, lo + (i.range + 0.5::double) * (hi - lo) / {n} as centre, (hi - lo) / {n} as w, count(b.bin) as n
  from l cross join range({n}) i left join b on b.sample = l.sample and b.dye = l.dye and b.bin = i.range group by all),
m as (select sample, dye, bin, n from h union all select sample, dye, -1 - bin, n from h where bin < {k}
  union all select sample, dye, 2 * {n} - 1 - bin, n from h where bin >= {n} - {k}),
s as (select sample, dye, bin, sum(n) over (partition by sample, dye order by bin rows between {k} preceding and {k} following) / (2.0 * {k} + 1) as s from m),
sm as (select h.*, s.s from h join s on h.sample = s.sample and h.dye = s.dye and h.bin = s.bin)"""
RATIO200 = HIST.format(n=200, k=3)
PEAK = RATIO200 + """,
pk as (select sample, dye, lo, hi, w, bin as peak_bin, centre as peak from (
  select *, row_number() over (partition by sample, dye order by case when abs(centre) <= 3 * w then 0 else s end desc, bin) as k from sm) q where k = 1)"""


@query("log_ratio", "G1", "select sample, dye, post, pre, round(log10(post / pre), 6) + 0 as x from v_ratio where post > 0 and pre > 0")
def log_ratio(t):
    return S.log_ratio(v_ratio(t)).withColumn("x", r6("x"))


@query("percentile_scale", "G2", """
select sample, dye, round(pow(10, quantile_cont(log10(post / pre), 0.6)), 6) as scale from v_ratio where post > 0 and pre > 0 group by 1, 2""")
def percentile_scale(t):
    return S.percentile_scale(v_ratio_stored(t), SD, 60.0).select(*SD, r6("scale").alias("scale"))


@query("ratio_histogram", "G3", f"""
with {RATIO200} select sample, dye, cast(bin as int) as bin, round(centre, 6) + 0 as centre, n, round(s, 6) as smooth from sm""")
def ratio_histogram(t):
    h = S.ratio_histogram(v_ratio_stored(t), SD)
    z = F.arrays_zip(S.bin_centers().alias("x"), F.col("counts").alias("n"), F.col("smooth").alias("s"))
    return h.select(*SD, F.posexplode(z).alias("bin", "z")).select(
        *SD, "bin", r6("z.x").alias("centre"), F.col("z.n").alias("n"), r6("z.s").alias("smooth")
    )


@query("initial_peak", "G4", f"with {PEAK} select sample, dye, cast(peak_bin as int) as peak_bin, round(peak, 6) + 0 as peak from pk")
def initial_peak(t):
    return S.initial_peak(S.ratio_histogram(v_ratio_stored(t), SD)).select(*SD, "peak_bin", r6("peak").alias("peak"))


@query("mirrored_wing", "G5", f"""
with {PEAK},
lf as (select h.sample, h.dye, h.centre as x, h.n as y, pk.peak, h.w from h join pk on h.sample = pk.sample and h.dye = pk.dye
  where h.centre <= pk.peak and abs(h.centre) > 3 * h.w)
select sample, dye, round(x, 6) + 0 as x, y::double as y, false as mirrored from lf
union all select sample, dye, round(2 * peak - x, 6) + 0, y::double, true from lf where abs(2 * peak - x) > 3 * w""")
def mirrored_wing(t):
    w = S.mirrored_wing(S.initial_peak(S.ratio_histogram(v_ratio_stored(t), SD)))
    return w.select(*SD, F.explode("wing").alias("z")).select(*SD, r6("z.x").alias("x"), "z.y", "z.mirrored")


@query("moffat_scale", "G6")
def moffat_scale(t):
    out = S.moffat_scale(v_ratio_stored(t), SD)
    return out.select(*SD, r6("scale", 4).alias("scale"), r6("peak").alias("peak"), r6("alpha", 4).alias("alpha"), r6("beta", 3).alias("beta"), "fitted")


@query("scale_set", "G7")
def scale_set(t):
    return S.scale_set(v_ratio_stored(t), SD, 99.1, 1.5).select(*SD, "label", r6("scale").alias("scale"))


@query("scale_set_fixed_part", "G7", """
select sample, dye, 'percentile_p99.1' as label, round(pow(10, quantile_cont(log10(post / pre), 0.991)), 6) as scale from v_ratio group by 1, 2
union all select distinct sample, dye, 'manual', 1.5::double from v_ratio""")
def scale_set_fixed_part(t):
    return S.scale_set(v_ratio_stored(t), SD, 99.1, 1.5).filter("label <> 'moffat'").select(*SD, "label", r6("scale").alias("scale"))


@query("difference", "G8", """
with s as (select sample, sum(post * pre) / sum(pre * pre) as s from v_pair group by 1),
k as (select sample, 'least_squares' as label, s from s union all select sample, 'manual', 1.5 from s)
select p.sample, label, r, c, round(post - s * pre, 6) + 0 as d from v_pair p join k on p.sample = k.sample""")
def difference(t):
    pairs = pair_pixels(v_px(t), ["sample"])
    ls = S.least_squares_scale(pairs, ["sample"])
    scales = ls.select("sample", F.lit("least_squares").alias("label"), "scale").unionByName(
        ls.select("sample", F.lit("manual").alias("label"), F.lit(1.5).alias("scale"))
    )
    return S.difference(pairs, ["sample"], scales).select("sample", "label", "r", "c", r6("d").alias("d"))


@query("least_squares_scale", "G9", "select sample, dye, round(sum(post * pre) / sum(pre * pre), 6) as scale from v_ratio group by 1, 2")
def least_squares_scale(t):
    return S.least_squares_scale(v_ratio(t), SD).select(*SD, r6("scale").alias("scale"))


@query("ratio_percentile_scale", "G10", "select sample, dye, round(quantile_cont(post / pre, 0.9), 6) as scale from v_ratio group by 1, 2")
def ratio_percentile_scale(t):
    return S.ratio_percentile_scale(v_ratio_stored(t), SD, 90.0).select(*SD, r6("scale").alias("scale"))


@query("histogram_mode_scale", "G11", f"""
with {HIST.format(n=100, k=2)},
ls as (select sample, dye, log10(sum(post * pre) / sum(pre * pre)) as ls from v_ratio group by 1, 2),
p0 as (select *, row_number() over (partition by sample, dye order by s desc, bin) as k from sm),
a as (select p0.sample, p0.dye, p0.bin as b0, p0.centre as c0, ls from p0 join ls on p0.sample = ls.sample and p0.dye = ls.dye where k = 1),
p1 as (select sm.sample, sm.dye, sm.bin, row_number() over (partition by sm.sample, sm.dye
  order by case when abs(sm.centre - ls) <= 1 then s else 0 end desc, bin) as k from sm join a on sm.sample = a.sample and sm.dye = a.dye),
pk as (select a.sample, a.dye, case when c0 < ls - 1 then p1.bin else b0 end as peak from a join p1 on a.sample = p1.sample and a.dye = p1.dye and k = 1),
u as (select sm.sample, sm.dye, (bin - peak)::double as u, s as y from sm join pk on sm.sample = pk.sample and sm.dye = pk.dye and abs(bin - peak) <= 5),
q as (select sample, dye, min(u) as u0, max(u) as u1, count(*)::double as s0, sum(u) as s1, sum(u*u) as s2, sum(u*u*u) as s3, sum(u*u*u*u) as s4,
  sum(y) as t0, sum(u*y) as t1, sum(u*u*y) as t2 from u group by 1, 2),
v as (select *, t2*(s2*s0-s1*s1) - s3*(t1*s0-s1*t0) + s2*(t1*s1-s2*t0) as da,
  s4*(t1*s0-t0*s1) - t2*(s3*s0-s1*s2) + s2*(s3*t0-t1*s2) as db from q)
select v.sample, v.dye, round(pow(10, centre + case when da < 0 then least(greatest(-db/(2*da), u0), u1) else 0 end * w), 6) as scale
from v join pk on v.sample = pk.sample and v.dye = pk.dye join sm on sm.sample = v.sample and sm.dye = v.dye and sm.bin = pk.peak""")
def histogram_mode_scale(t):
    return S.histogram_mode_scale(v_ratio_stored(t), SD).select(*SD, r6("scale").alias("scale"))


@query("signal_only_scale", "G12", """
with q as (select sample, dye, quantile_cont(post, 0.5) as tp, quantile_cont(pre, 0.5) as tq from v_ratio group by 1, 2)
select r.sample, r.dye, round(sum(post * pre) / sum(pre * pre), 6) as scale, count(*) as n_signal
from v_ratio r join q on r.sample = q.sample and r.dye = q.dye where post > tp and pre > tq group by 1, 2""")
def signal_only_scale(t):
    return S.signal_only_scale(v_ratio_stored(t), SD).select(*SD, r6("scale").alias("scale"), "n_signal")


@query("legacy_scale", "G13")
def legacy_scale(t):
    out = S.legacy_scale(v_px(t), ["sample"], PX_SHAPE, "robust_percentile", boundary_erosion=1, levels=LEVELS)
    return out.select("sample", *[r6(n).alias(n) for n in ("scale", "signal_scale", "ls_scale")], "n_cells")


@query("gaussian_noise_fit", "G14")
def gaussian_noise_fit(t):
    out = S.gaussian_noise_fit(v_ratio_stored(t), SD)
    return out.select(*SD, r6("peak").alias("peak"), r6("mu", 4).alias("mu"), r6("sigma", 4).alias("sigma"))
