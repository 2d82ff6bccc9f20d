"""Not-modified revisits of web captures, resolved to the full response they confirm."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import pin

# fixed values: what a 304 answer may update in a stored response (RFC 9110, 15.4.5)
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
# fixed values: query parameters that do not change the resource
TRACKING = "utm_[a-z]+|ref|fbclid|gclid"


def canonical_url(url):
    """Scheme and host in lower case, without fragment, default port, tracking parameters or closing slash; parameters sorted."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    head = F.lower(F.regexp_extract(u, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", 0))
    head = F.regexp_replace(F.regexp_replace(head, "^(http://[^/]*):80$", "$1"), "^(https://[^/]*):443$", "$1")
    rest = F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^?]*", 0), "/+$", "")
    query = F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: ~p.rlike(f"^(({TRACKING})(=.*)?)?$"))
    tail = F.array_join(F.array_sort(query), "&")
    return F.when(url.isNotNull(), F.concat(head, path, F.when(tail != "", F.concat(F.lit("?"), tail)).otherwise("")))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Resolve every revisit to the latest strictly earlier full response of its canonical URL.

    records: record_id, url, ts (whole number), kind ("response" or "revisit"), etag,
    last_modified, headers (map of lower-case names). Returns one row per revisit: record_id,
    canonical, ts, refers_to, outcome and headers. The outcome is "etag" or "last-modified" for
    the validator that agrees (entity tags compare weakly, and decide alone where both records
    have one), "changed" if it does not agree, "unchecked" if the two share no validator, and
    "orphan" without an earlier response. Only agreeing revisits refer to a response; their
    headers are the response's, updated with the permitted ones of the revisit; the others keep
    their own. A null URL or time is an orphan and a null map is empty; of responses at one time
    the largest record_id counts, of those with one id the largest entity tag, then date, then
    headers as text; repeated revisits are each resolved; other columns are not read.

    Times of a URL are first reduced to one row each, then ranges of (URL, time) find the latest
    response inside a range and take over the last one of the ranges before, so a URL with a
    third of all captures is dealt over many tasks.
    """
    keyed = records.select("record_id", "ts", "kind", "etag", "last_modified", F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"), canonical_url(F.col("url")).alias("canonical"))
    keyed = pin(keyed)
    placed = keyed.filter("canonical is not null and ts is not null")
    answer = F.when(F.col("kind") == "response", F.struct("record_id", "etag", "last_modified"))
    times = placed.groupBy("canonical", "ts").agg(F.max(answer).alias("answer"))
    ranged = pin(times.repartitionByRange("canonical", "ts").withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part", "canonical").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    ends = ranged.filter("answer is not null").groupBy("canonical", "part").agg(F.max_by("answer", "ts").alias("last"))
    spread = ranged.select("canonical", "part").distinct().join(ends, ["canonical", "part"], "left")
    parts = Window.partitionBy("canonical").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = spread.select("canonical", "part", F.last("last", ignorenulls=True).over(parts).alias("carried"))
    latest = ranged.withColumn("near", F.last("answer", ignorenulls=True).over(inside)).join(carried, ["canonical", "part"]).select(
        "canonical", "ts", F.coalesce("near", "carried").alias("found")).filter("found is not null")

    revisits = keyed.filter("kind = 'revisit'").join(latest, ["canonical", "ts"], "left")
    bare = lambda c: F.regexp_replace(c, "^W/", "")
    tags, dates = F.col("etag").isNotNull() & F.col("found.etag").isNotNull(), F.col("last_modified").isNotNull() & F.col("found.last_modified").isNotNull()
    outcome = (
        F.when(F.col("found").isNull(), "orphan")
        .when(tags, F.when(bare(F.col("etag")) == bare(F.col("found.etag")), "etag").otherwise("changed"))
        .when(dates, F.when(F.col("last_modified") == F.col("found.last_modified"), "last-modified").otherwise("changed"))
        .otherwise("unchecked")
    )
    judged = revisits.withColumn("outcome", outcome).withColumn("refers_to", F.when(F.col("outcome").isin("etag", "last-modified"), F.col("found.record_id")))
    # a record id may be repeated with other validators or headers: the validators tell which was found
    which = lambda at: F.to_json(F.struct(*[F.col(at + n).alias(n) for n in ("record_id", "etag", "last_modified")]))
    said = F.to_json(F.array_sort(F.map_entries("headers")))
    full = keyed.filter("kind = 'response'").groupBy(which("").alias("which")).agg(F.max_by("headers", said).alias("stored"))
    allowed = lambda k: k.isin(*PERMITTED)
    own = F.map_filter("headers", lambda k, v: allowed(k))
    merged = F.map_concat(F.map_filter("stored", lambda k, v: ~F.array_contains(F.map_keys(own), k)), own)
    with_head = judged.filter("refers_to is not null").withColumn("which", which("found.")).join(full, "which").withColumn("headers", merged)
    out = ["record_id", "canonical", "ts", "refers_to", "outcome", "headers"]
    return with_head.select(*out).unionByName(judged.filter("refers_to is null").select(*out))
