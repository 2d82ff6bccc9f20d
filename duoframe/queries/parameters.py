"""Queries for parameters, resume, batch reports and estimates."""

from pyspark.sql import functions as F

from ..fixtures import Tables, v_files, v_log, v_manifest, v_params, v_result
from ..functions.text import human_bytes
from ..plans import params as P
from ..plans import reports as B
from ..session import pin
from ..sources import catalog as C
from .base import query, r6


def tasks(t):
    """Requested pairs: every nation with every region name."""
    # the list of dyes is an argument of a request, as in a call by hand
    dyes = [r["r_name"] for r in t("region").select("r_name").distinct().collect()]
    return C.request(t("nation").select(F.col("n_name").alias("sample")), dyes)


def _text(value) -> str:
    return "null" if value is None else "'" + str(value).replace("'", "''") + "'"


REGISTRY = ", ".join(
    f"({i}, {_text(n)}, {_text(d)}, {_text(k)}, {_text(a)}, {s}, {_text(P.FINE_GROUP if n in P.FINE_PARAMETERS else P.GROUPS[s])})"
    for i, (n, d, k, a, s, _) in enumerate(P.PARAMETERS)
)


@query("parameter_registry", "I1", f"""
select g.ord, g.name, g.dflt as "default", g.type, g.abbrev, g.stage, g.grp, coalesce(u.n_set, 0) as n_set
from (values {REGISTRY}) g(ord, name, dflt, type, abbrev, stage, grp)
left join (select name, count(*) as n_set from v_params group by 1) u on u.name = g.name""")
def parameter_registry(t):
    used = v_params(t).groupBy("name").agg(F.count("*").alias("n_set"))
    reg = P.registry(t.spark).join(used, "name", "left")
    return reg.select("ord", "name", "default", "type", "abbrev", "stage", "grp", F.coalesce("n_set", F.lit(0)).alias("n_set"))


@query("unknown_parameters", "I2", "select run_id, name, value, 'unknown parameter' as problem from v_params where name like 'Brand%'")
def unknown_parameters(t):
    return P.check_params(v_params(t))


@query("non_default_parameters", "I3", """
select run_id, name, coalesce(value, 'None') as value, stage from v_changed where stage <= 3""")
def non_default_parameters(t):
    return P.non_default(v_params(t), 3).select("run_id", "name", F.coalesce("value", F.lit("None")).alias("value"), "stage")


@query("build_suffix", "I4", "select run_id, suffix from v_suffix")
def build_suffix(t):
    return P.build_suffix(v_params(t), 4)


@query("parse_suffix", "I5", """
with k as (select run_id, unnest(string_split(ltrim(suffix, '_'), '_')) as tok from v_suffix),
a as (select * from (values ('boundary_width', 'bw', 'n'), ('angle_range', 'ar', 'n'), ('scale_min', 'smin', 'n'), ('use_edges', 'ue', 'b'),
  ('stopdelta', 'sdl', 'n'), ('interior_blur_base', 'iblur', 'n'), ('manual_scale', 'msc', 'n')) a(name, abbrev, type))
select k.run_id, a.name, case when type = 'b' then case when substr(tok, len(abbrev) + 1) = '1' then 'true' else 'false' end
  else substr(tok, len(abbrev) + 1) end as value from k join a on starts_with(tok, abbrev) where tok <> ''""")
def parse_suffix(t):
    return P.parse_suffix(P.build_suffix(v_params(t), 4))


EXPECTED = "(values (1, 'post'), (1, 'pre'), (2, 'pre'), (3, 'pre'), (4, 'difference')) x(stage, name)"


@query("missing_upstream", "I6", f"""
select k.sample, k.dye, x.stage, x.name from v_task k, {EXPECTED}
where x.stage < 4 and not exists (select 1 from v_manifest m where m.sample = k.sample and m.dye = k.dye and m.stage = x.stage and m.name = x.name)""")
def missing_upstream(t):
    return B.missing_upstream(tasks(t), v_manifest(t), 4)


@query("plan_stages", "I7", f"""
with d as (select k.sample, k.dye, x.stage, bool_and(exists (select 1 from v_manifest m where m.sample = k.sample and m.dye = k.dye
   and m.stage = x.stage and m.name = x.name)) as complete from v_task k, {EXPECTED} group by 1, 2, 3)
select sample, dye, stage, complete, case when stage > 3 then false when stage < 2 then not complete else not complete end as run from d""")
def plan_stages(t):
    return B.plan_stages(tasks(t), v_manifest(t), from_stage=2, to_stage=3)


@query("status_report", "I12", """
select k.sample, k.dye, x.stage, x.name, exists (select 1 from v_manifest m where m.sample = k.sample and m.dye = k.dye
   and m.stage = x.stage and m.name = x.name) as exists
from v_task k, (values (1, 'post'), (1, 'pre'), (2, 'pre'), (3, 'pre'), (4, 'difference'), (4, 'pre_post_heatmap'), (4, 'pre_post_histograms'),
  (4, 'difference_histogram'), (4, 'ratio_histogram'), (4, 'excess_heatmap'), (4, 'difference_image')) x(stage, name)""")
def status_report(t):
    return B.status_report(tasks(t), v_manifest(t))


@query("summary", "I13", """
select sample, dye, coalesce(scale_estimate, -1) as scale_estimate, case when status like '%error%' then 'error'
  when status = 'complete' then 'complete' else substr(status, 1, 10) end as short_status from v_result""")
def summary(t):
    return B.summary(v_result(t)).select("sample", "dye", F.coalesce("scale_estimate", F.lit(-1.0)).alias("scale_estimate"), "short_status")


@query("summary_columns", "I13", "select max(scale_estimate is not null) as has_scale_estimate from v_result")
def summary_columns(t):
    return B.summary_columns(v_result(t))


@query("problems", "I13", "select sample, dye, regexp_replace(status, '^error: ', '') as message from v_result where status like '%error%'")
def problems(t):
    return B.problems(v_result(t))


SIZES = """
b as (select r.sample, r.dye, coalesce(12 * cast(floor(c.length * (cast(4 as double) / 3) * cast(1.2 as double)) as bigint) + 10485760, 0) as bytes
 from (select sample, d.dye from (select distinct sample from v_files) s, (values ('DAPI'), ('Cy5'), ('SybrGld'), ('Hoechst')) d(dye)) r
 left join v_pairs p on p.sample = r.sample and p.dye = r.dye and p.n_pre > 0 and p.n_post > 0
 left join v_files c on c.path = p.first_post and p.n_pre > 0)"""


def _sizes(t):
    files = v_files(t)
    pairs = C.group_pairs(C.classify_files(files))
    return B.output_size(C.request(files, ["DAPI", "Cy5", "SybrGld", "Hoechst"]), pairs, True, 1, "both")


@query("output_size", "I14", f"with {SIZES} select sample, dye, bytes from b")
def output_size(t):
    return _sizes(t)


@query("output_size_totals", "I14", f"""
with {SIZES} select cast(sum(bytes) as bigint) as total_bytes, count(*) as n_tasks, count(*) filter (where bytes > 0) as n_resolvable from b""")
def output_size_totals(t):
    return B.output_size_totals(_sizes(t))


@query("peak_memory", "I15", """
select max((cast(p_size as bigint) * 700 + 4000) * (p_partkey % 25000 + 4000) * 16) as peak_bytes,
 max((cast(p_size as bigint) * 700 + 4000) * (p_partkey % 25000 + 4000) * 16) * 4 as concurrent_peak_bytes from part""")
def peak_memory(t):
    frames = t("part").select((F.col("p_size").cast("bigint") * 700).alias("height"), (F.col("p_partkey") % 25000).alias("width"))
    return B.peak_memory(frames, 2000, 4)


@query("budget_bands", "I16", f"""
with {SIZES} select sample, dye, bytes, round(bytes / 10600000, 6) as fraction,
 case when bytes / 10600000 > 1.0 then 'fail' when bytes / 10600000 > 0.8 then 'warn' else 'ok' end as band from b""")
def budget_bands(t):
    out = B.budget_bands(_sizes(t), "bytes", 10_600_000)
    return out.select("sample", "dye", "bytes", r6("fraction").alias("fraction"), "band")


@query("human_bytes", "I17", """
with x as (select o_orderkey, cast(floor(o_totalprice) as bigint) * (case o_orderkey % 5 when 0 then 1 when 1 then 1000 when 2 then 1000000 when 3 then 1000000000 else 0 end)
  + o_orderkey % 1500 as n from orders)
select o_orderkey, n, case when n < 1024 then n || ' B' when n < 1024 ** 2 then printf('%.1f KB', n / 1024.0) when n < 1024 ** 3 then printf('%.1f MB', n / 1024.0 ** 2)
 when n < 1024 ** 4 then printf('%.1f GB', n / 1024.0 ** 3) when n < 1024 ** 5 then printf('%.1f TB', n / 1024.0 ** 4) else printf('%.1f PB', n / 1024.0 ** 5) end as text from x""")
def human_bytes_text(t):
    k = F.col("o_orderkey")
    factor = F.when(k % 5 == 0, F.lit(1)).when(k % 5 == 1, 1000).when(k % 5 == 2, 1000000).when(k % 5 == 3, F.lit(1000000000)).otherwise(0).cast("bigint")
    n = F.floor("o_totalprice").cast("bigint") * factor + k % 1500
    return t("orders").select("o_orderkey", n.alias("n"), human_bytes(n).alias("text"))


@query("log_tail", "I18", "select seq, section, line from v_log order by seq desc limit 500")
def log_tail(t):
    return B.log_tail(v_log(t)).select("seq", "section", "line")


@query("mixed_formats", "I19", """
select sample, dye, string_agg(distinct fmt, ',' order by fmt) as present, 'fits' as unexpected from v_manifest group by 1, 2
having count(*) filter (where fmt = 'fits') > 0""")
def mixed_formats(t):
    return B.mixed_formats(v_manifest(t), "tiff")


@query("new_tasks", "I10", """
select p.sample, p.dye from v_pairs p where n_pre = 1 and n_post = 1 and not exists (
  select 1 from v_result r where r.sample = p.sample and r.status = 'complete' and r.dye = '1-URGENT')""")
def new_tasks(t):
    from ..streaming.newfiles import new_tasks as pending

    pairs = C.classify_files(v_files(t))
    dyes = pairs.filter("code is null").select("sample", "dye").distinct()
    # a finished urgent order of the same number stands for a finished sample
    done = v_result(t).filter("dye = '1-URGENT' and status = 'complete'").select("sample", "status").distinct().join(dyes, "sample")
    return pending(pairs, done)


class _Streamed(Tables):
    """The same tables as streams."""

    def __call__(self, name):
        schema = super().__call__(name).schema
        # a pattern, since a stream takes a folder or a pattern, and a table may be one file
        return self.spark.readStream.schema(schema).parquet(f"{self.folder}/{name}.parque[t]")


@query("streamed_pairs", "I10", """
select sample, dye, case when n_pre > 1 or n_post > 1 then 'duplicate' else 'ok' end as state, n_pre, n_post,
 split_part(pre_paths, ';', 1) as pre_path, first_post as post_path, 1 as version from v_pairs where n_pre > 0 and n_post > 0""")
def streamed_pairs(t):
    from ..session import work_dir
    from ..streaming.newfiles import current_pairs, write_pair_events
    import uuid

    path = f"{work_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    write_pair_events(C.classify_files(v_files(_Streamed(t.spark, t.folder))), f"{path}/events", f"{path}/checkpoint").awaitTermination()
    return current_pairs(t.spark, f"{path}/events")


def _runs(t):
    from ..fixtures import v_px

    px = v_px(t).select(F.col("sample"), F.lit("DAPI").alias("dye"), "kind", "r", "c", "v")
    frames = px.select("sample", "dye", "kind").distinct().select("*", F.lit(128).alias("height"), F.lit(128).alias("width"))
    return px, frames


# sizes that fit frames of 128 x 128; every stage and the whole search run as by default
SMALL = dict(pad=16, boundary_width=3, boundary_smooth=2, down_scale=4.0)


@query("run_batch", "I8 I9")
def run_batch(t):
    from ..plans.batch import run_batch as run
    from ..session import work_dir
    import uuid

    px, frames = _runs(t)
    path = f"{work_dir(t.spark)}/run-{uuid.uuid4().hex}"
    out = run(px, frames, px.select("sample", "dye").distinct(), path, {**SMALL, "manual_scale": 1.5})
    return out.select("sample", "dye", r6("scale_estimate", 3).alias("scale_estimate"), "manual_scale", "status")


@query("sweep", "I11")
def sweep_runs(t):
    from ..plans.batch import sweep
    from ..session import work_dir
    import uuid

    px, frames = _runs(t)
    path = f"{work_dir(t.spark)}/run-{uuid.uuid4().hex}"
    out = sweep(px, frames, px.select("sample", "dye").distinct(), path, "manual_scale", [1.0, 2.0], SMALL)
    return out.select("sample", "dye", "parameter", "value", "manual_scale", "status")
