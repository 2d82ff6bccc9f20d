"""Queries for histograms, percentiles and histogram matching."""

from pyspark.sql import functions as F

from ..fixtures import LEVELS, v_grid, v_px, v_ratio, v_ratio_stored
from ..operators import histograms as H
from ..operators.percentiles import percentiles
from .base import query, r6

SD = ["sample", "dye"]


@query("uniform_histogram", "C1", """
with x as (select sample, dye, post from v_ratio),
l as (select sample, dye, min(post) as lo, max(post) as hi from x group by 1, 2),
b as (select x.sample, x.dye, case when hi > lo then least(99, floor((post - lo) / (hi - lo) * 100)) else 0 end as bin
  from x join l on x.sample = l.sample and x.dye = l.dye)
select l.sample, l.dye, cast(i.range as int) as bin, round(lo + i.range * ((hi - lo) / 100), 9) as bin_lo,
  round(lo + (i.range + 1) * ((hi - lo) / 100), 9) as bin_hi, count(b.bin) as n
from l, range(100) i left join b on b.sample = l.sample and b.dye = l.dye and b.bin = i.range
group by all""")
def uniform_histogram(t):
    out = H.explode_bins(H.bin_counts(v_ratio_stored(t), SD, "post", 100), SD)
    return out.select(*SD, "bin", r6("bin_lo", 9).alias("bin_lo"), r6("bin_hi", 9).alias("bin_hi"), "n")


@query("match_histograms", "C2", """
with pos as (select * from v_px where v > 0),
e as (select sample, kind, min(v) as lo, max(v) as hi from pos group by 1, 2),
h as (select p.sample, p.kind, least(255, floor((v - lo) / (hi - lo) * 256)) as bin, count(*) as n
  from pos p join e on p.sample = e.sample and p.kind = e.kind group by 1, 2, 3),
hb as (select e.sample, e.kind, i.range as bin, coalesce(h.n, 0) as n
  from e cross join range(256) i left join h on h.sample = e.sample and h.kind = e.kind and h.bin = i.range),
cdf as (select sample, kind, bin, sum(n) over (partition by sample, kind order by bin)
  / sum(n) over (partition by sample, kind) as cdf from hb),
pick as (select a.sample, a.bin, min(b.bin) as post_bin from cdf a join cdf b
  on a.sample = b.sample and a.kind = 'pre' and b.kind = 'post' and b.cdf >= a.cdf group by 1, 2),
p99 as (select sample, quantile_cont(v, 0.99) as p99 from pos where kind = 'post' group by 1)
select p.sample, p.kind, p.r, p.c, p.v, round(least(1.0, greatest(0.0, case when p.kind = 'post' then p.v
   else o.lo + (k.post_bin + 0.5) * (o.hi - o.lo) / 256 end / q.p99)), 6) + 0 as matched
from v_px p join e on p.sample = e.sample and p.kind = e.kind
join e o on o.sample = p.sample and o.kind = 'post' join p99 q on q.sample = p.sample
left join pick k on k.sample = p.sample and p.kind = 'pre'
  and k.bin = least(255, greatest(0, ceil((p.v - e.lo) / (e.hi - e.lo) * 256) - 1))""")
def match_histograms(t):
    out = H.match_histograms(v_px(t), ["sample"], levels=LEVELS)
    return out.select("sample", "kind", "r", "c", "v", r6("matched").alias("matched"))


@query("percentile_linear", "C3", """
select sample, dye, round(quantile_cont(post / pre, 0.01), 6) as p01, round(quantile_cont(post / pre, 0.5), 6) as p50,
  round(quantile_cont(post / pre, 0.991), 6) as p991 from v_ratio group by 1, 2""")
def percentile_linear(t):
    out = percentiles(v_ratio_stored(t), SD, F.col("post") / F.col("pre"), {"p01": 0.01, "p50": 0.5, "p991": 0.991})
    return out.select(*SD, *[r6(n).alias(n) for n in ("p01", "p50", "p991")])


@query("integer_bins", "C4", """
with cap as (select sample, kind, ceil(quantile_cont(v, 0.999)) as cap from v_px group by 1, 2)
select p.sample, p.kind, cast(least(floor(v + 0.5), cap) as bigint) as bin, count(*) as n
from v_px p join cap on p.sample = cap.sample and p.kind = cap.kind
where v <= cap + 0.5 group by 1, 2, 3""")
def integer_bins(t):
    return H.integer_bins(v_px(t), ["sample", "kind"], "v", LEVELS)


@query("smoothed_histogram", "C5", """
with x as (select kind, v from v_grid where v > 0),
l as (select kind, min(v) as lo, max(v) as hi from x group by 1),
b as (select x.kind, least(49, floor((v - lo) / (hi - lo) * 50)) as bin from x join l on x.kind = l.kind),
h as (select l.kind, i.range as bin, count(b.bin) as n from l, range(50) i
  left join b on b.kind = l.kind and b.bin = i.range group by 1, 2),
m as (select kind, bin, n from h union all select kind, -1 - bin, n from h where bin < 3
  union all select kind, 99 - bin, n from h where bin >= 47),
s as (select kind, bin, sum(n) over (partition by kind order by bin rows between 3 preceding and 3 following) / 7.0 as s from m)
select s.kind, cast(s.bin as int) as bin, h.n, round(s.s, 6) as smooth from s join h on s.kind = h.kind and s.bin = h.bin""")
def smoothed_histogram(t):
    hist = H.bin_counts(v_grid(t).filter("v > 0"), ["kind"], "v", 50)
    both = hist.select("kind", F.posexplode(F.arrays_zip("counts", H.box_smooth("counts", 3).alias("s"))).alias("bin", "x"))
    return both.select("kind", "bin", F.col("x.counts").alias("n"), r6("x.s").alias("smooth"))
