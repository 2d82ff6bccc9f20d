"""Queries for the file catalogue, channels and provenance."""

from pyspark.sql import functions as F

from ..fixtures import v_files, v_manifest, v_params, v_rgb, v_result
from ..functions.text import is_tiff
from ..session import pin
from ..sources import catalog as C
from ..sources import rasters as R
from ..sources.store import provenance
from .base import query, r6

RGB_SHAPE = (64, 64)
DYES = ["DAPI", "Cy5", "SybrGld", "Hoechst"]


@query("tiff_name_test", "A1", """
select basename, regexp_matches(lower(basename), '[.]tiff?$') as is_tiff from v_files""")
def tiff_name_test(t):
    return v_files(t).select("basename", is_tiff(F.col("basename")).alias("is_tiff"))


@query("classify_files", "A4", """
select sample, path, coalesce(code, '') as code, case when code is null then kind else '' end as kind,
 case when code is null then dye else '' end as dye from v_class""")
def classify_files(t):
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return C.classify_files(v_files(t)).select("sample", "path", blank("code"), blank("kind"), blank("dye"))


@query("group_pairs", "A5", """
select sample, dye, n_pre, n_post, coalesce(nullif(split_part(pre_paths, ';', 1), ''), '') as pre_path, first_post as post_path from v_pairs""")
def group_pairs(t):
    p = C.group_pairs(C.classify_files(v_files(t)))
    return p.select("sample", "dye", "n_pre", "n_post", F.coalesce("pre_path", F.lit("")).alias("pre_path"), F.coalesce("post_path", F.lit("")).alias("post_path"))


@query("pair_members", "A5", """
select c.sample, c.dye, c.kind, c.path, p.n_pre, p.n_post from v_class c join v_pairs p
on c.sample = p.sample and c.dye = p.dye where c.code is null""")
def pair_members(t):
    return C.pair_members(C.classify_files(v_files(t)))


STATE = """case when n_pre = 0 or n_post = 0 then 'incomplete' when n_pre > 1 or n_post > 1 then 'duplicate' else 'ok' end"""
REASON = """case when n_pre = 0 or n_post = 0 then 'incomplete pair — ' || case when n_pre = 0 then 'pre-stain' else 'post-stain' end
  || ' file is missing (found ' || n_pre || ' pre, ' || n_post || ' post)'
 when n_pre > 1 or n_post > 1 then 'duplicate files — found ' || n_pre || ' pre and ' || n_post || ' post for this dye, expected 1+1' end"""


@query("pair_state", "A6", f"select sample, dye, n_pre, n_post, {STATE} as state, coalesce({REASON}, '') as reason from v_pairs")
def pair_state(t):
    p = C.pair_state(C.group_pairs(C.classify_files(v_files(t))))
    return p.select("sample", "dye", "n_pre", "n_post", "state", F.coalesce("reason", F.lit("")).alias("reason"))


@query("complete_dyes", "A6", "select distinct dye from v_pairs where n_pre > 0 and n_post > 0")
def complete_dyes(t):
    return C.complete_dyes(C.group_pairs(C.classify_files(v_files(t))))


# raw folders: every sample number modulo 5 is one root; files of some samples lie loose
TREE = """
f as (select cast(substr(sample, 2) as bigint) as s, sample, basename from v_files),
t as (select 'root' || (s % 5) as root, sample, basename, s % 5 = 1 or (s % 5 = 2 and s % 10 = 2) as loose from f),
e as (select distinct root, case when loose then basename else sample end as name, not loose as is_dir from t),
n as (select root, count(*) as n_entries, count(*) filter (where is_dir) as n_subdirs,
  count(*) filter (where not is_dir and regexp_matches(lower(name), '[.]tiff?$')) as n_loose from e group by 1),
g as (select root, count(distinct sample) as n_filled from t where not loose and regexp_matches(lower(basename), '[.]tiff?$')
  and root <> 'root4' group by 1),
r as (select 'root' || range as root from range(7))"""


def _tree(t):
    s = F.substring("sample", 2, 20).cast("bigint")
    tree = v_files(t).select(
        F.concat(F.lit("root"), (s % 5).cast("string")).alias("root"), "sample", "basename",
        ((s % 5 == 1) | ((s % 5 == 2) & (s % 10 == 2))).alias("loose"),
    )
    entries = tree.select("root", F.when(F.col("loose"), F.col("basename")).otherwise(F.col("sample")).alias("name"), (~F.col("loose")).alias("is_dir")).distinct()
    files = tree.filter("not loose and root <> 'root4'").select("root", F.col("sample").alias("subdir"), "basename")
    return entries, files


@query("layout_report", "A7", f"""
with {TREE}
select r.root, coalesce(n_subdirs, 0) as n_subdirs, coalesce(n_loose, 0) as n_loose,
 coalesce(n_subdirs, 0) - coalesce(n_filled, 0) as n_empty_subdirs,
 case when r.root = 'root5' then 'missing' when coalesce(n_entries, 0) = 0 then 'empty'
  when n_loose > 0 and n_subdirs = 0 then 'loose files only' when n_subdirs > 0 and coalesce(n_filled, 0) = 0 then 'no files in subfolders'
  when n_loose > 0 then 'loose files ignored' else 'ok' end as code,
 case when r.root in ('root5', 'root6', 'root1', 'root4') then false else true end as ok
from r left join n on r.root = n.root left join g on r.root = g.root""")
def layout_report(t):
    entries, files = _tree(t)
    # the roots are the remainders that occur, an empty one and one that does not exist
    s = F.substring("sample", 2, 20).cast("bigint")
    roots = v_files(t).select(F.concat(F.lit("root"), (s % 5).cast("string")).alias("root")).distinct().select(
        "root", F.lit(True).alias("exists"), F.lit(True).alias("is_dir")
    )
    more = t("region").select(F.explode(F.array(*[F.struct(F.lit(r).alias("root"), F.lit(e).alias("exists")) for r, e in (("root5", False), ("root6", True))])).alias("x"))
    return C.layout_report(roots.unionByName(more.select("x.root", "x.exists", F.col("x.exists").alias("is_dir")).distinct()), entries, files)


@query("layout_entries", "A7", f"""
with {TREE}
select e.root, e.name, case when is_dir and x.sample is not null then 'subdir' when is_dir then 'empty_subdir'
 when regexp_matches(lower(name), '[.]tiff?$') then 'loose_tiff' else 'other' end as role
from e left join (select distinct root, sample from t where not loose and regexp_matches(lower(basename), '[.]tiff?$') and root <> 'root4') x
on e.root = x.root and e.name = x.sample""")
def layout_entries(t):
    return C.layout_entries(*_tree(t))


RESOLVED = f"""
req as (select sample, d.dye from (select distinct sample from v_files union all select n_name from nation) s,
  (values ('DAPI'), ('Cy5'), ('SybrGld'), ('Hoechst')) d(dye)),
av as (select sample, string_agg(dye, ', ' order by dye) as dyes from v_pairs group by 1),
st as (select sample, dye, {STATE} as state, {REASON} as why from v_pairs),
out as (select req.sample, req.dye, case when f.sample is null then 'sample directory ''raw/' || req.sample || ''' does not exist'
  when av.dyes is null then 'no validly-named raw files in ''raw/' || req.sample || ''''
  when st.state is null then 'no ''' || req.dye || ''' files in this sample (dyes present: ' || av.dyes || ')' else st.why end as reason
 from req left join (select distinct sample from v_files) f on f.sample = req.sample left join av on av.sample = req.sample
 left join st on st.sample = req.sample and st.dye = req.dye)"""


def _resolved(t):
    files = v_files(t)
    pairs = pin(C.group_pairs(C.classify_files(files)))
    asked = files.select("sample").unionByName(t("nation").select(F.col("n_name").alias("sample")))
    return C.resolve_request(C.request(asked, DYES), pairs, files)


@query("resolve_request", "A8", f"""
with {RESOLVED} select sample, dye, coalesce(reason, '') as reason, case when reason is null then 'present' else 'skipped' end as status from out""")
def resolve_request(t):
    return _resolved(t).select("sample", "dye", F.coalesce("reason", F.lit("")).alias("reason"), "status")


@query("lenient_tasks", "A9", f"with {RESOLVED} select sample, dye from out where reason is null")
def lenient_tasks(t):
    return C.enforce(_resolved(t), strict=False)


@query("loadable_pairs", "A10", f"""
select sample, dye, split_part(pre_paths, ';', 1) as pre_path, first_post as post_path from v_pairs where n_pre = 1 and n_post = 1""")
def loadable_pairs(t):
    return C.pair_state(C.group_pairs(C.classify_files(v_files(t)))).filter("state = 'ok'").select("sample", "dye", "pre_path", "post_path")


@query("channel_survey", "A11", """
select frame_id, ch, max(case when i then v else 0 end) as max, round(sum(case when i then v else 0 end) / 1600.0, 6) as mean,
 count(*) filter (where i and v <> 0) as nonzero
from (select *, r >= 12 and r < 52 and c >= 12 and c < 52 as i from v_rgb) q group by 1, 2""")
def channel_survey(t):
    return R.channel_survey(v_rgb(t), ["frame_id"], RGB_SHAPE, 40).select("frame_id", "ch", "max", r6("mean").alias("mean"), "nonzero")


@query("pick_signal_channel", "A12", """
with m as (select frame_id, ch, sum(v) / 4096.0 as mean from v_rgb group by 1, 2),
n as (select frame_id, count(*) filter (where mean > 0.5) as n from m group by 1),
b as (select m.*, n, row_number() over (partition by m.frame_id order by mean desc, case ch when 'R' then 0 when 'G' then 1 else 2 end) as k
  from m join n on m.frame_id = n.frame_id),
a as (select frame_id, ch from b where (n > 0 and mean > 0.5) or (n = 0 and k = 1))
select p.frame_id, r, c, least(255.0, floor(sum(v)))::double as v from v_rgb p join a on p.frame_id = a.frame_id and p.ch = a.ch group by 1, 2, 3""")
def pick_signal_channel(t):
    return R.pick_signal_channel(v_rgb(t), ["frame_id"], RGB_SHAPE)


@query("split_channels", "A13", """
select frame_id, r, c, coalesce(max(case when ch = 'R' then v end), 0) as RED1, coalesce(max(case when ch = 'G' then v end), 0) as GREEN2,
 coalesce(max(case when ch = 'B' then v end), 0) as BLUE3 from v_rgb group by 1, 2, 3""")
def split_channels(t):
    return R.split_channels(v_rgb(t), ["frame_id"])


@query("provenance", "A16", """
with runs as (select p_partkey as run_id, 'S' || p_partkey as sample, p_brand as dye, cast(p_size % 4 + 1 as int) as stage from part),
x as (select run_id, sample, dye, stage, unnest(['SAMPLE', 'DYE', 'STAGE', 'CREATED']) as key,
  unnest([sample, dye, case stage when 1 then '01_padded' when 2 then '02_icp_aligned' when 3 then '03_interior_aligned' else '04_difference' end,
    '2024-05-06T07:08:09']) as value from runs
 union all select r.run_id, sample, dye, r.stage, upper(abbrev), coalesce(value, 'None') from v_changed c join runs r on c.run_id = r.run_id where c.stage <= r.stage
 union all select run_id, sample, dye, stage, 'SCALE', cast(p_retailprice as varchar) from runs join part on p_partkey = run_id)
select run_id, sample, dye, stage, key, value from x""")
def provenance_rows(t):
    runs = t("part").select(
        F.col("p_partkey").alias("run_id"), F.concat(F.lit("S"), F.col("p_partkey").cast("string")).alias("sample"),
        F.col("p_brand").alias("dye"), (F.col("p_size") % 4 + 1).cast("int").alias("stage"),
        F.to_timestamp(F.lit("2024-05-06 07:08:09")).alias("created"),
    )
    extras = t("part").select(F.col("p_partkey").alias("run_id"), F.lit("scale").alias("key"), F.col("p_retailprice").cast("string").alias("value"))
    return provenance(runs, v_params(t), extras).drop("comment")
