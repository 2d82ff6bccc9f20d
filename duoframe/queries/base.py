"""Registry of queries with their oracle SQL, and the derived views as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
ROWS: dict[str, list[str]] = {}  # inventory row -> query names


def query(name: str, rows: str, sql: str | None = None):
    """Register a query for the inventory rows it covers; sql may name {views}."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLE[name] = render(sql)
        for row in rows.split():
            ROWS.setdefault(row, []).append(name)
        return fn

    return wrap


def r6(x: Column | str, digits: int = 6) -> Column:
    """Value rounded for comparison; + 0.0 turns -0.0 into 0.0."""
    return F.round(x, digits) + F.lit(0.0)


VIEWS = {
    "v_ratio": """select l_returnflag as sample, l_linestatus as dye,
        l_extendedprice / l_quantity as post, p_retailprice as pre
        from lineitem join part on l_partkey = p_partkey""",
    "v_px": """select l_returnflag as sample,
        case when l_linestatus = 'F' then 'post' else 'pre' end as kind,
        cast(l_orderkey % 128 as int) as r,
        cast((l_partkey * 7 + l_linenumber) % 128 as int) as c,
        least(cast(255 as double), sum(l_quantity)) as v
        from lineitem group by 1, 2, 3, 4""",
    "v_pair": """select sample, r, c,
        coalesce(max(case when kind = 'post' then v end), 0) as post,
        coalesce(max(case when kind = 'pre' then v end), 0) as pre
        from v_px group by 1, 2, 3""",
    "v_grid": """select case when vec_id % 2 = 0 then 'post' else 'pre' end as kind,
        cast(floor(vec_id / 2) as int) as r, cast(i - 1 as int) as c,
        least(cast(255 as double), greatest(cast(0 as double),
              floor(cast(embedding[i] as double) * 512))) as v
        from embeddings, unnest(range(1, len(embedding) + 1)) as t(i)""",
    "v_rgb": """select concat(l_returnflag, l_linestatus) as frame_id,
        cast(l_orderkey % 64 as int) as r, cast(l_partkey % 64 as int) as c,
        case when l_suppkey % 3 = 0 then 'R' when l_suppkey % 3 = 1 then 'G' else 'B' end as ch,
        least(255, cast(floor(sum(case
          when l_suppkey % 3 = 0 then l_quantity
          when l_suppkey % 3 = 1 and l_returnflag = 'A' then l_quantity
          else l_discount end)) as int)) as v
        from lineitem group by 1, 2, 3, 4""",
    "v_mask": """select p.sample, p.kind, p.r, p.c
        from v_px p join (select sample, kind, quantile_cont(v, 0.95) as t
                          from v_px group by sample, kind) h
          on p.sample = h.sample and p.kind = h.kind
        where p.v >= h.t""",
    "v_files": """select sample, 'raw/' || sample || '/' || basename as path, basename, length from (
        select concat('S', cast(cast(floor(doc_id / 4) as bigint) as varchar(20))) as sample,
         case when doc_id % 11 = 0 then concat('F', cast(doc_id as varchar(20)), '_PrePost_DAPI.tif')
              when doc_id % 11 = 1 then concat('F', cast(doc_id as varchar(20)), '_DAPI.tif')
              when doc_id % 11 = 2 then concat('F', cast(doc_id as varchar(20)), 'PreDAPI.tif')
              when doc_id % 11 = 3 then concat('F', cast(doc_id as varchar(20)), '_pre_.tif')
              when doc_id % 11 = 4 then concat('F', cast(doc_id as varchar(20)), '_pre_DAPI.txt')
              else concat('F', cast(doc_id as varchar(20)),
                case when doc_id % 2 = 0 then '_PreStain_' else '_PostStain_' end,
                case when cast(floor(doc_id / 4) as bigint) % 5 = 0 then 'DAPI'
                     when cast(floor(doc_id / 2) as bigint) % 3 = 0 then 'DAPI'
                     when cast(floor(doc_id / 2) as bigint) % 3 = 1 then 'Cy5' else 'SybrGld' end,
                case when doc_id % 3 = 0 then '.TIFF' else '.tif' end) end as basename,
         n_chars as length
        from documents) d""",
    "v_match": """select l_returnflag as pair_id, l_quantity as x, l_discount * 100 as y,
        1.02 * l_quantity - 0.05 * (l_discount * 100) + 3 + l_tax as u,
        0.04 * l_quantity + 0.98 * (l_discount * 100) - 2 - l_tax as w
        from lineitem""",
    "v_result": """select concat('S', cast(o_custkey as varchar(20))) as sample, o_orderpriority as dye,
        case when o_orderstatus = 'F' then null else o_totalprice / 100000 end as scale_estimate,
        case when o_orderstatus = 'F' then 'error: no raw files'
             when o_orderstatus = 'O' then 'complete' else 'stopped early' end as status
        from orders""",
    "v_task": "select n_name as sample, r_name as dye from nation cross join region",
    "v_manifest": """select distinct n_name as sample, r_name as dye, cast(s_suppkey % 4 + 1 as int) as stage,
        case when s_suppkey % 4 = 3 then 'difference'
             when s_suppkey % 8 = 0 then 'post' else 'pre' end as name,
        case when s_suppkey % 5 = 0 then 'fits' else 'tiff' end as fmt
        from supplier join nation on s_nationkey = n_nationkey
                      join region on n_regionkey = r_regionkey""",
    "v_params": """select p_partkey as run_id, n.name, case n.name when 'boundary_width' then cast(p_size as varchar)
          when 'angle_range' then cast(20 + p_partkey % 3 as varchar)
          when 'scale_min' then case p_partkey % 4 when 0 then '0.8' when 1 then '0.85' else '0.9125' end
          when 'use_edges' then case when p_partkey % 2 = 0 then 'true' else 'false' end
          when 'stopdelta' then case when p_partkey % 3 = 0 then '1e-06' else '0.0000125' end
          when 'interior_blur_base' then case when p_partkey % 5 = 0 then '8' else '12.50' end
          else case when p_partkey % 7 <> 0 then cast(p_retailprice as varchar) end end as value
        from part, (values ('boundary_width'), ('angle_range'), ('scale_min'), ('use_edges'), ('stopdelta'),
          ('interior_blur_base'), ('manual_scale')) n(name)
        union all select p_partkey, p_brand, '1' from part where p_partkey % 17 = 0""",
    "v_changed": """select p.run_id, g.ord, p.name, p.value, g.dflt, g.abbrev, g.stage from v_params p join (values
          (2, 'boundary_width', '15', 'bw', 2), (5, 'angle_range', '20', 'ar', 2), (8, 'scale_min', '0.85', 'smin', 2),
          (1, 'use_edges', 'true', 'ue', 2), (20, 'stopdelta', '1e-06', 'sdl', 2),
          (22, 'interior_blur_base', '8.0', 'iblur', 3), (26, 'manual_scale', null, 'msc', 4)) g(ord, name, dflt, abbrev, stage)
        on p.name = g.name where not coalesce(try_cast(p.value as double) = try_cast(g.dflt as double), false)
          and p.value is distinct from g.dflt""",
    "v_suffix": """select a.run_id, coalesce(b.suffix, '') as suffix from (select distinct run_id from v_params) a left join
        (select run_id, '_' || string_agg(abbrev || case when value is null then 'none' when name = 'use_edges' then
             case when value = 'true' then '1' else '0' end
           when regexp_matches(value, '[.eE]') then printf('%g', try_cast(value as double)) else value end, '_' order by ord) as suffix
         from v_changed group by 1) b on a.run_id = b.run_id""",
    "v_log": "select event_id as seq, ts, event_type as section, props as line from events",
    # brightest pixels as whole frames of 128 x 128 cells
    "v_cells": """select s.sample, s.kind, a.r, b.c
        from (select distinct sample, kind from v_px) s,
             (select cast(range as int) as r from range(128)) a, (select cast(range as int) as c from range(128)) b""",
    # classified file names
    "v_class": """select sample, path, basename, length,
        case when stem like '%pre%' and stem like '%post%' then 'AMBIGUOUS'
             when stem not like '%pre%' and stem not like '%post%' then 'NO STAIN MARKER'
             when not contains(full_stem, '_') then 'NO UNDERSCORE'
             when dye0 = '' then 'EMPTY DYE' end as code,
        case when stem like '%pre%' then 'pre' else 'post' end as kind, dye0 as dye
        from (select *, lower(full_stem) as stem,
                regexp_extract(full_stem, '([^_]*)$', 1) as dye0
              from (select *, regexp_replace(basename, '[.][^.]*$', '') as full_stem from v_files) q0
              where regexp_matches(lower(basename), '[.]tiff?$')) q1""",
    "v_pairs": """select sample, dye,
        count(*) filter (where kind = 'pre') as n_pre, count(*) filter (where kind = 'post') as n_post,
        coalesce(string_agg(path, ';' order by path) filter (where kind = 'pre'), '') as pre_paths,
        coalesce(string_agg(path, ';' order by path) filter (where kind = 'post'), '') as post_paths,
        coalesce(min(path) filter (where kind = 'post'), '') as first_post
        from v_class where code is null group by 1, 2""",
}


def render(sql: str) -> str:
    """Prefix the views that sql uses as CTEs; R(x) and R(x, n) round for comparison."""
    needed: list[str] = []

    def visit(text: str):
        for name, body in VIEWS.items():
            if _uses(text, name) and name not in needed:
                visit(body)
                needed.append(name)

    visit(sql)
    body = sql.strip()
    ctes = [f"{n} as ({VIEWS[n]})" for n in needed]
    recursive = "recursive " if body.lower().startswith("with recursive") else ""
    if body.lower().startswith("with "):
        body = body[len("with recursive ") if recursive else len("with "):]
        return f"with {recursive}" + ", ".join([*ctes, ""]) + body if ctes else f"with {recursive}" + body
    return ("with " + ", ".join(ctes) + " " + body) if ctes else body


def _uses(text: str, name: str) -> bool:
    import re

    return re.search(rf"\b{name}\b", text) is not None
