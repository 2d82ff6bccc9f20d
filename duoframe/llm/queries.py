"""Registered queries of the pipeline operators, each over its whole table, with oracle SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_dir
from . import codebooks, contamination, exact, near, packing, repeats, revisits, runs, secret_scan, sharding, tokenfile, toxicity, vectors

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Place of a public tokenizer's vocabulary file; it is installed wherever the tasks run."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return register


# the generator's multiplier and the reflected CRC-32 polynomial are fixed values
@query("op1_jump_shards", """
with recursive steps as (
  select doc_id, n, doc_id::hugeint as k, 0::bigint as b, 0::bigint as j from documents, (values (40), (41)) c(n)
  union all
  select doc_id, n, k2, j, floor((j + 1) * (2147483648.0::double / ((k2 // 8589934592) + 1)::double))::bigint
  from (select doc_id, n, j, (k * 2862933555777941757 + 1) % 18446744073709551616 as k2 from steps where j < n)
),
shards as (select doc_id, n, max(b)::int as shard from steps where j >= n group by all),
crc as (select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
d as (select doc_id, (octet_length(encode(coalesce(text, ''))) + 16)::bigint as size,
        xor(list_reduce([4294967295::bigint] || list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::bigint), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) as text_crc32
      from documents, crc)
select d.*, 'key' as law, s.shard, row_number() over (partition by s.shard order by d.doc_id, d.text_crc32, d.size) - 1 as slot, g.shard as grown_shard
from d join shards s on s.doc_id = d.doc_id and s.n = 40 join shards g on g.doc_id = d.doc_id and g.n = 41
""")
def op1(spark, folder):
    return sharding.shard(table(spark, folder, "documents"), 40)


@query("op2_dictionary_token_file")
def op2(spark, folder):
    path = f"{work_dir(spark)}/token-file-{uuid.uuid4().hex}"
    tokenfile.write_token_file(table(spark, folder, "documents"), path, tokenizer("word_bpe_49k.json"), end_id=1)
    return tokenfile.read_token_file(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op3_bag_minhash_classes")
def op3(spark, folder):
    return near.near_classes(table(spark, folder, "documents"))


@query("op4_hash_compared_suffixes")
def op4(spark, folder):
    cut = repeats.find_repeats(table(spark, folder, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


# every page as a full response, and a later revisit of it whose validators agree, differ or lack by turns
CAPTURES = """
select page_id * 2 as record_id, url, page_id * 4 as ts, 'response' as kind, concat('"', md5(coalesce(html, '')), '"') as etag,
       concat('day ', page_id % 365) as last_modified, 'text/html' as content_type, concat('max-age=', page_id % 60) as cache_control
from pages
union all
select page_id * 2 + 1, url, page_id * 4 + 1 + page_id * 7919 % 4000, 'revisit',
       case page_id % 5 when 0 then null when 1 then concat('W/"', md5(coalesce(html, '')), '"') when 2 then '"stale"' else concat('"', md5(coalesce(html, '')), '"') end,
       case when page_id % 10 = 0 then 'day -1' when page_id % 15 = 0 then null else concat('day ', page_id % 365) end, 'text/plain', concat('max-age=', page_id % 90)
from pages
"""


@query("op5_not_modified_revisits", f"""
with r as ({CAPTURES}),
u as (select *, regexp_replace(trim(url), '#.*$', '') as u from r),
v as (select *, regexp_replace(regexp_replace(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*')), '^(http://[^/]*):80$', '\\1'), '^(https://[^/]*):443$', '\\1')
        as head, regexp_replace(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*', '') as rest from u),
w as (select *, array_to_string(list_sort([p for p in string_split(regexp_extract(rest, '\\?(.*)$', 1), '&') if not regexp_full_match(p, '(({revisits.TRACKING})(=.*)?)?')]), '&') as tail,
        regexp_replace(regexp_extract(rest, '^[^?]*'), '/+$', '') as path from v),
c as (select *, head || path || case when tail <> '' then '?' || tail else '' end as canonical from w),
full_ as (select canonical, ts, max(struct_pack(record_id, etag, last_modified, cache_control)) as f from c where kind = 'response' group by 1, 2),
j as (select c.*, f from c asof left join full_ on c.canonical = full_.canonical and c.ts > full_.ts where kind = 'revisit'),
o as (select *, case when f is null then 'orphan'
        when etag is not null and f.etag is not null then case when regexp_replace(etag, '^W/', '') = regexp_replace(f.etag, '^W/', '') then 'etag' else 'changed' end
        when last_modified is not null and f.last_modified is not null then case when last_modified = f.last_modified then 'last-modified' else 'changed' end
        else 'unchecked' end as outcome from j)
select record_id, canonical, ts, case when outcome in ('etag', 'last-modified') then f.record_id else -1 end as refers_to, outcome,
       case when outcome in ('etag', 'last-modified') then 'text/html' else 'text/plain' end as content_type, cache_control
from o
""")
def op5(spark, folder):
    view = f"pages_{uuid.uuid4().hex}"
    table(spark, folder, "pages").createOrReplaceTempView(view)
    captures = spark.sql(CAPTURES.replace("from pages", f"from {view}"))
    headers = F.create_map(F.lit("content-type"), "content_type", F.lit("cache-control"), "cache_control")
    done = revisits.resolve_revisits(captures.withColumn("headers", headers))
    return done.select("record_id", "canonical", "ts", F.coalesce("refers_to", F.lit(-1)).alias("refers_to"), "outcome", F.col("headers")["content-type"].alias("content_type"), F.col("headers")["cache-control"].alias("cache_control"))


@query("op6_ordinal_toxicity")
def op6(spark, folder):
    docs = table(spark, folder, "documents")
    return toxicity.grade_toxicity(docs, toxicity.fit_toxicity(docs, table(spark, folder, "labels")))


@query("op7_secret_network")
def op7(spark, folder):
    found = secret_scan.find_secrets(table(spark, folder, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secret_scan.listed("spans", base_only=True).cast("binary"), 256).alias("base_sha256"), secret_scan.listed("spans").alias("spans"),
    )


@query("op8_winnowing", f"""
with words as (
  select 'd' || doc_id as k, doc_id, null as item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') as w from documents
  union all
  select 'i' || item_id, null, item_id::varchar, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') from benchmark
),
wins as (
  select distinct item_id, unnest([list_slice(w, i, i + least(10, len(w)) - 1) for i in range(1, len(w) - least(10, len(w)) + 2)]) as win
  from words where item_id is not null and len(w) > 0
),
sizes as (select distinct len(win) as size from wins),
spots as (select doc_id, unnest(range(1, len(w) - size + 2)) as i, size, w from words, sizes where doc_id is not null and len(w) >= size),
hits as (select doc_id, i, size, item_id from spots join wins on list_slice(w, i, i + size - 1) = win),
hit_words as (select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(range(i, i + size)) from hits) group by 1),
met as (select doc_id, count(*) as n_items, sha256(string_agg(item_id, ',' order by item_id)) as s from (select distinct doc_id, item_id from hits) group by 1)
select d.doc_id, coalesce(len(w), 0)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       coalesce(s, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from words d left join hit_words using (doc_id) left join met using (doc_id) where d.doc_id is not null
""")
def op8(spark, folder):
    met = contamination.decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    listed = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return met.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"), "contaminated")


@query("op9_best_fit_packing")
def op9(spark, folder):
    return packing.pack(table(spark, folder, "documents"), tokenizer("byte_bpe_50k.json"), 2048, 0)


@query("op10_digest_index", """
with d as (select doc_id, length(coalesce(text, '')) as n, sha256(regexp_replace(coalesce(text, ''), '[ \\t-\\r]', '', 'g')) as h from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by h) as group_size,
       doc_id = first_value(doc_id) over w as kept, h as text_sha256
from d window w as (partition by h order by n desc, doc_id)
""")
def op10(spark, folder):
    index = exact.DigestIndex(spark)
    decided = index.ingest_table(table(spark, folder, "documents")).drop("n_chars")
    index.close()
    return decided


VEC_PARTS, VEC_ENTRIES, VEC_ROUNDS = 8, 16, 6
FINITE = "embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"


def _codebook_rounds() -> str:
    """One assignment and one update of the codebooks per round, as named steps."""
    steps = []
    for k in range(VEC_ROUNDS + 1):
        steps.append(f"""a{k} as materialized (
  select vec_id, part, arg_min(entry, struct_pack(d, entry)) as entry, min(d) as d
  from (select vec_id, part, entry, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from parts join b{k} using (part))
  group by 1, 2)""")
        if k < VEC_ROUNDS:
            steps.append(f"""b{k + 1} as materialized (
  select part, entry, coalesce(m.c, b.c) as c from b{k} b left join (
    select part, entry, list(((s - (s % n + n) % n) // n)::bigint order by j) as c from (
      select part, entry, j, sum(v[j])::bigint as s, count(*) as n from a{k} join parts using (vec_id, part), (select unnest(range(1, width + 1)) as j from dims) group by 1, 2, 3)
    group by 1, 2) m using (part, entry))""")
    return ",\n".join(steps)


@query("op13_pivot_codes", f"""
with kept as (select vec_id, label, list_transform(embedding, lambda x: floor(x::double * 4096)::bigint) as units from embeddings where {FINITE}),
dims as (select (any_value(len(units)) // {VEC_PARTS})::bigint as width from kept),
parts as materialized (select vec_id, p as part, units[p * width + 1 : (p + 1) * width] as v from kept, dims, (select unnest(range({VEC_PARTS})) as p)),
first_ as (select vec_id, row_number() over (order by vec_id) - 1 as entry from kept order by vec_id limit {VEC_ENTRIES}),
b0 as materialized (select part, entry, v as c from parts join first_ using (vec_id)),
{_codebook_rounds()},
books as (select sha256(string_agg(array_to_string(c, ','), ',' order by part, entry)) as h from b{VEC_ROUNDS}),
codes as (select vec_id, string_agg(lpad(lower(hex(entry)), 2, '0'), '' order by part) as code, sum(d)::bigint as error from a{VEC_ROUNDS} group by 1)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, h as codebooks_sha256
from codes join kept using (vec_id), books
""")
def op13(spark, folder):
    coded = codebooks.encode_vectors(table(spark, folder, "embeddings"), VEC_PARTS, VEC_ENTRIES, VEC_ROUNDS)
    return coded.drop("label")


# vectors without a direction have no cosine; the links are few, the pairs of a label are all compared here
@query("op11_stable_hash_links", f"""
with recursive v as materialized (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
  where label is not null and {FINITE} and len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links as materialized (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.98
),
reach as (select a as vec_id, b as other from links union select reach.vec_id, links.b from reach join links on reach.other = links.a),
lowest as (select vec_id, min(other) as low from reach group by 1),
counts as (select a as vec_id, count(*) as n from links group by 1)
select vec_id, coalesce(n, 0) as n_links, least(vec_id, coalesce(low, vec_id)) as component_id, least(vec_id, coalesce(low, vec_id)) = vec_id as kept
from embeddings left join lowest using (vec_id) left join counts using (vec_id)
""")
def op11(spark, folder):
    return vectors.near_vectors(table(spark, folder, "embeddings"))


@query("op12_maximal_pair_runs", """
with crc as (select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w,
        xor(list_reduce([4294967295::bigint] || list_transform(regexp_extract_all(doc_id::varchar, '.'), lambda c: ascii(c)::bigint), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) as h from documents, crc),
e as (select doc_id, w, len(w) as n, h, h // 10 as g from d),
f as (select *, g % n as a, 1 + (n - g % n) // (3 + g % 8) as p from e),
x as materialized (select doc_id, n, case when h % 10 = 0 and n > 0 then w[1 : a] || list_transform(range(a, n), lambda i: w[a + (i - a) % p + 1]) else w end as w from f),
words as materialized (select doc_id, n, i, w[i + 1] as word from (select *, unnest(range(n)) as i from x)),
same as (select u.doc_id, u.i, v.i - u.i as q from words u join words v on u.doc_id = v.doc_id and u.word = v.word and v.i > u.i and 3 * (v.i - u.i) <= u.n),
stretch as (select doc_id, q, min(i) as start, count(*) + q as length from (select *, i - row_number() over (partition by doc_id, q order by i) as isle from same) group by doc_id, q, isle),
run as materialized (select doc_id, start, length, min(q) as period from stretch where length >= greatest(24, 3 * q) group by 1, 2, 3),
gone as (select distinct doc_id, unnest(range(start + period, start + length)) as i from run),
kept as (select doc_id, string_agg(word, ' ' order by i) as s from words anti join gone using (doc_id, i) group by 1),
listed as (select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as s,
             arg_max(struct_pack(start, length, period), struct_pack(e := length::double / period, s := -start, p := -period)) as best from run group by 1)
select doc_id, coalesce(n_runs, 0)::bigint as n_runs, best.start::bigint as start, best.length::bigint as length, best.period::bigint as period, (1000 * best.length // best.period)::bigint as exponent_milli,
       sha256(coalesce(listed.s, '')) as runs_sha256, sha256(coalesce(kept.s, '')) as collapsed_sha256
from x left join listed using (doc_id) left join kept using (doc_id)
""")
def op12(spark, folder):
    return runs.detect_runs(table(spark, folder, "documents"), plant=True, with_text=False)
