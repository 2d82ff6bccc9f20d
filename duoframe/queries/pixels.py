"""Queries for the pixel-wise operators."""

from pyspark.sql import functions as F

from ..fixtures import LEVELS, PX_SHAPE, v_grid, v_px, v_rgb
from ..operators import pixels as P
from .base import query, r6

SK = ["sample", "kind"]


@query("pair_pixels", "M7", "select sample, r, c, post, pre from v_pair")
def pair_pixels(t):
    return P.pair_pixels(v_px(t), ["sample"])


@query("subtract_region_median", "B1", """
with stored as (select sample, kind, v, r, c from v_px),
cells as (select k.sample, k.kind, coalesce(p.v, 0) as v from v_cells k
  left join v_px p on p.sample = k.sample and p.kind = k.kind and p.r = k.r and p.c = k.c
  where k.r >= 10 and k.r < 60 and k.c >= 0 and k.c < 100),
med as (select sample, kind, quantile_cont(v, 0.5) as background from cells group by 1, 2)
select s.sample, s.kind, s.r, s.c, round(s.v - m.background, 6) + 0 as v, round(m.background, 6) + 0 as background
from stored s join med m on s.sample = m.sample and s.kind = m.kind""")
def subtract_region_median(t):
    out = P.subtract_region_median(v_px(t), SK, PX_SHAPE, (10, 60, 0, 100))
    return out.select(*SK, "r", "c", r6("v").alias("v"), r6("background").alias("background"))


@query("normalize_by_max", "B2", """
select p.sample, p.kind, r, c, round(v / m, 6) + 0 as v from v_px p
join (select sample, kind, max(v) as m from v_px group by 1, 2) q on p.sample = q.sample and p.kind = q.kind""")
def normalize_by_max(t):
    return P.normalize(v_px(t), SK).select(*SK, "r", "c", r6("v").alias("v"))


@query("normalize_by_percentile", "B2", """
select p.sample, p.kind, r, c, round(v / m, 6) + 0 as v from v_px p
join (select sample, kind, quantile_cont(v, 0.9) as m from v_px group by 1, 2) q
on p.sample = q.sample and p.kind = q.kind""")
def normalize_by_percentile(t):
    return P.normalize(v_px(t), SK, 0.9, LEVELS).select(*SK, "r", "c", r6("v").alias("v"))


@query("pad_to_common_canvas", "B3", """
with f as (select sample, kind, max(r) + 1 as height, max(c) + 1 as width from v_px group by 1, 2)
select f.sample, f.kind, k.h + 4000 as height, k.w + 4000 as width, 2000 as origin_r, 2000 as origin_c
from f join (select sample, max(height) as h, max(width) as w from f group by 1) k on f.sample = k.sample""")
def pad_to_common_canvas(t):
    frames = v_px(t).groupBy(*SK).agg((F.max("r") + 1).alias("height"), (F.max("c") + 1).alias("width"))
    return P.pad_to_common_canvas(frames, ["sample"])


@query("trim_to_signal", "B4", """
with b as (select sample, min(r) as r0, max(r) as r1, min(c) as c0, max(c) as c1 from v_px where v > 240 group by 1)
select p.sample, kind, p.r - coalesce(r0, 0) as r, p.c - coalesce(c0, 0) as c, v
from v_px p left join b on p.sample = b.sample
where r0 is null or (r between r0 and r1 and c between c0 and c1)""")
def trim_to_signal(t):
    return P.trim_to_signal(v_px(t), ["sample"], 240.0)


@query("blur_sigma_by_density", "B5", """
select kind, round(avg(case when v > 100 then 1.0 else 0.0 end), 6) as fraction,
  case when avg(case when v > 100 then 1.0 else 0.0 end) < 0.1 then 5.0 else 0.0 end::double as sigma
from v_grid group by 1""")
def blur_sigma_by_density(t):
    from ..session import pin

    grid = v_grid(t)
    frames = pin(grid.groupBy("kind").agg((F.max("r") + 1).alias("height"), (F.max("c") + 1).alias("width")))
    bright = grid.withColumn("v", F.when(F.col("v") > 100, F.col("v")).otherwise(0.0))
    out = P.blur_sigma_by_density(bright, ["kind"], frames)
    return out.select("kind", r6("fraction").alias("fraction"), "sigma")


@query("robust_display_max", "B6", """
with m as (select sample, kind, quantile_cont(v, 0.5) as med from v_px where v > 0 group by 1, 2),
d as (select p.sample, p.kind, med, abs(v - med) as dev from v_px p
  join m on p.sample = m.sample and p.kind = m.kind where v > 0)
select sample, kind, round(max(med) + 5 * quantile_cont(dev, 0.5), 6) as vmax from d group by 1, 2""")
def robust_display_max(t):
    return P.robust_display_max(v_px(t), SK, 5.0, LEVELS).select(*SK, r6("vmax").alias("vmax"))


@query("stretch_to_8bit", "B7", """
with q as (select sample, kind, quantile_cont(v, 0.01) as lo, quantile_cont(v, 0.99) as hi0
  from v_px where v > 0 group by 1, 2),
l as (select sample, kind, lo, case when hi0 <= lo then lo + 1 else hi0 end as hi from q)
select p.sample, p.kind, r, c, cast(floor(least(greatest((v - lo) / (hi - lo) * 255.0, 0.0), 255.0)) as int) as v8
from v_px p join l on p.sample = l.sample and p.kind = l.kind""")
def stretch_to_8bit(t):
    return P.stretch_to_8bit(v_px(t), SK, levels=LEVELS).select(*SK, "r", "c", "v8")


@query("rgb_overlay", "B8", """
with q as (select sample, kind, quantile_cont(v, 0.99) as hi from v_px where v > 0 group by 1, 2),
s as (select p.sample, p.kind, r, c, cast(floor(least(greatest(v / hi * 255.0, 0.0), 255.0)) as int) as v8
  from v_px p join q on p.sample = q.sample and p.kind = q.kind),
e as (select sample, kind, r, c from v_mask),
k as (select sample, r, c, coalesce(max(case when kind = 'post' then v8 end), 0) as red,
  coalesce(max(case when kind = 'pre' then v8 end), 0) as green from s group by 1, 2, 3)
select k.sample, k.r, k.c,
  case when b.r is not null then 255 when a.r is not null then 0 else red end as red,
  case when b.r is not null then 0 when a.r is not null then 255 else green end as green,
  case when b.r is not null or a.r is not null then 255 else 0 end as blue
from k left join (select * from e where kind = 'post') a on k.sample = a.sample and k.r = a.r and k.c = a.c
left join (select * from e where kind = 'pre') b on k.sample = b.sample and k.r = b.r and k.c = b.c""")
def rgb_overlay(t):
    from ..fixtures import v_mask

    return P.rgb_overlay(v_px(t), ["sample"], v_mask(t), LEVELS)


@query("display_stretches", "B9", """
with d as (select sample, r, c, post, pre, post - pre as d from v_pair),
k as (select sample, greatest(quantile_cont(abs(d), 0.5), 1.0) as knee, avg(d) as mu,
  greatest(stddev_pop(d), 1e-8) as sd from d group by 1)
select d.sample, r, c, round(log10(post + 1), 6) as log_post,
  round(sign(d) * log10(abs(d) + 1), 6) + 0 as signed_log,
  round(asinh(d / knee), 6) + 0 as asinh, round((d - mu) / sd, 6) + 0 as z
from d join k on d.sample = k.sample""")
def display_stretches(t):
    diff = P.pair_pixels(v_px(t), ["sample"]).withColumn("d", F.col("post") - F.col("pre"))
    out = P.display_stretches(diff, ["sample"], levels=2 * LEVELS)
    return out.select(
        "sample", "r", "c", r6(P.log_stretch(F.col("post"))).alias("log_post"),
        r6("signed_log").alias("signed_log"), r6("asinh").alias("asinh"), r6("z").alias("z"),
    )


@query("residual", "B11", "select sample, r, c, round(post - 1.25 * pre, 6) + 0 as d from v_pair")
def residual(t):
    pairs = P.pair_pixels(v_px(t), ["sample"])
    return pairs.select("sample", "r", "c", r6(P.residual(F.col("post"), F.col("pre"), 1.25)).alias("d"))


@query("binary_mask", "B12", """
select kind, r, c, coalesce(case when v > 0 then 1.0 end, -1.0)::double as m from v_grid""")
def binary_mask(t):
    return v_grid(t).select("kind", "r", "c", F.coalesce(P.binary_mask(F.col("v")), F.lit(-1.0)).alias("m"))


@query("display_limits", "B13", """
select sample, round(quantile_cont(abs(post - pre), 0.90), 6) as lim90,
  round(quantile_cont(abs(post - pre), 0.95), 6) as lim95, round(quantile_cont(abs(post - pre), 0.99), 6) as lim99
from v_pair where post > 0 or pre > 0 group by 1""")
def display_limits(t):
    diff = P.pair_pixels(v_px(t), ["sample"]).filter("post > 0 or pre > 0").withColumn("d", F.col("post") - F.col("pre"))
    out = P.display_limits(diff, ["sample"], levels=LEVELS)
    return out.select("sample", *[r6(n).alias(n) for n in ("lim90", "lim95", "lim99")])


@query("value_limits", "B13", """
with m as (select sample, kind, quantile_cont(v, 0.5) as med, quantile_cont(v, 0.01) as p01,
  quantile_cont(v, 0.1) as p10, quantile_cont(v, 0.9) as p90, quantile_cont(v, 0.99) as p99
  from v_px group by 1, 2),
d as (select p.sample, p.kind, quantile_cont(abs(v - med), 0.5) as mad from v_px p
  join m on p.sample = m.sample and p.kind = m.kind group by 1, 2)
select m.sample, m.kind, round(p01, 6) as p01, round(p10, 6) as p10, round(p90, 6) as p90, round(p99, 6) as p99,
  round(med + 5 * mad, 6) as vmax, round(-0.05 * (med + 5 * mad), 6) as vmin,
  round(greatest(med + 2 * mad, med), 6) as legacy_limit
from m join d on m.sample = d.sample and m.kind = d.kind""")
def value_limits(t):
    px = v_px(t)
    out = P.value_limits(px, SK, LEVELS).join(P.legacy_column_limit(px, SK, F.col("v"), LEVELS), SK)
    names = ["p01", "p10", "p90", "p99", "vmax", "vmin"]
    return out.select(*SK, *[r6(n).alias(n) for n in names], r6("limit").alias("legacy_limit"))


@query("crop", "B14", """
select sample, kind, r - 20 as r, c - 90 as c, v from v_px
where r >= 20 and r < 60 and c >= 90 and c < 128 and kind = 'post'""")
def crop(t):
    return P.crop(v_px(t).filter("kind = 'post'"), SK, PX_SHAPE, 20, 90, 40)


@query("crop_several", "B15", """
select sample, kind, r - 0 as r, c - 127 as c, v from v_px where r < 50 and c = 127""")
def crop_several(t):
    return P.crop(v_px(t), SK, PX_SHAPE, -5, 200, 50)


@query("strided_preview", "B16", """
select kind, cast(r // s as int) as r, cast(c // s as int) as c, v from (
  select g.kind, r, c, v, greatest(1, cast(ceil(greatest(h, w) / 50.0) as int)) as s from v_grid g
  join (select kind, max(r) + 1 as h, max(c) + 1 as w from v_grid group by 1) f on g.kind = f.kind) q
where r % s = 0 and c % s = 0""")
def strided_preview(t):
    from ..session import pin

    grid = v_grid(t)
    frames = pin(grid.groupBy("kind").agg((F.max("r") + 1).alias("height"), (F.max("c") + 1).alias("width")))
    return P.strided_preview(grid, ["kind"], frames, 50)


@query("masked_composite", "B17", """
select sample, r, c, cast(cast(post + pre as int) % 256 as int) as v from v_pair where post <> 0""")
def masked_composite(t):
    return P.masked_composite(v_px(t), ["sample"], "post", "pre")


@query("luminance_gray", "B18", """
select frame_id, r, c, cast(round(sum(v * case ch when 'R' then 0.299 when 'G' then 0.587 else 0.114 end::double)) as int) as v
from v_rgb group by 1, 2, 3""")
def luminance_gray(t):
    return P.luminance_gray(v_rgb(t), ["frame_id"])
