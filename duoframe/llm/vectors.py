"""Near-duplicate vectors: p-stable hashing in several tables, then exact cosine checks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import is_empty, pin
from .codebooks import _floats
from .near import components
from .textbytes import mix, ragged, release

BLOCK = 1024  # vectors of a bucket that one task compares with as many others
FEW = 32  # vectors of a bucket whose pairs are listed; those of a larger one are a product
CELL = 8.0  # width of a hash cell, in units of the distance at the threshold


def _erf(x: float) -> float:
    return math.erf(x / math.sqrt(2))


def collision(ratio: float) -> float:
    """Chance that one projection puts two vectors into one cell; ratio: cell width over their distance."""
    return _erf(ratio) - 2 / (math.sqrt(2 * math.pi) * ratio) * (1 - math.exp(-ratio * ratio / 2))


def table_plan(rows: int, least: float, miss: float) -> tuple[int, int]:
    """Projections per table and number of tables.

    So many projections that unrelated (orthogonal) vectors of `rows` share a bucket with one
    other at most on average, and so many tables that a pair at the threshold shares no
    bucket with probability `miss` at most.
    """
    near = math.sqrt(2 - 2 * least)
    same, other = collision(CELL), collision(CELL * near / math.sqrt(2))
    per_table = max(2, math.ceil(math.log(max(rows, 2)) / -math.log(other)))
    return per_table, math.ceil(math.log(miss) / math.log1p(-(same**per_table)))


def unit(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Components of length 1 in double precision, first place of each row, and which rows have a direction."""
    flat, at, good = _floats(column)
    size = np.diff(at)
    some = size > 0
    fine = np.ones(len(size), bool)
    fine[some] = np.logical_and.reduceat(np.isfinite(flat), at[:-1][some]) if some.any() else True
    good &= fine & some
    flat = np.where(np.isfinite(flat), flat, 0)
    # divided by the largest component first, so that squares neither overflow nor vanish
    for reduce, of in ((np.maximum.reduceat, np.abs), (lambda x, i: np.sqrt(np.add.reduceat(x, i)), np.square)):
        norm = np.ones(len(size))
        if some.any():
            norm[some] = reduce(of(flat), at[:-1][some])
        good &= norm > 0
        flat = flat / np.repeat(np.where(norm > 0, norm, 1), size)
    return flat, at, good


def _hashed(batches: Iterator[pa.RecordBatch], per_table: int, tables: int, cell: float, seed: int) -> Iterator[pa.RecordBatch]:
    """Bucket of every vector in every table; labels and lengths never share one."""
    planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        flat, at, _ = unit(batch.column("vec"))
        group = np.array(batch.column("group"), np.int64).view(np.uint64)
        size = np.diff(at)
        names = np.zeros((batch.num_rows, tables), np.uint64)
        for dim in np.unique(size).tolist():
            if dim not in planes:
                r = np.random.default_rng([seed, dim])
                planes[dim] = r.normal(size=(dim, tables * per_table)), r.uniform(0, cell, tables * per_table)
            normal, shift = planes[dim]
            own = np.flatnonzero(size == dim)
            points = flat[at[own][:, None] + np.arange(dim)]
            cells = np.floor((points @ normal + shift) / cell).astype(np.int64).view(np.uint64).reshape(len(own), tables, per_table)
            name = np.tile(np.arange(tables, dtype=np.uint64), (len(own), 1)) ^ mix(group[own] + np.uint64(dim))[:, None]
            for j in range(per_table):
                name = mix(name ^ mix(cells[:, :, j] + np.uint64(j)))
            names[own] = name
        lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * tables), pa.array(names.reshape(-1).view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("node"), lists], ["node", "buckets"])
    release()


def _pairs(points: np.ndarray, first: np.ndarray, end: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of rows inside the given ranges of rows: small ranges all at once, each other one by a product."""
    i, j = [], []
    size = end - first
    few = size <= FEW
    row = ragged(first[few], size[few])
    more = np.repeat(end[few], size[few]) - row - 1
    a, b = np.repeat(row, more), ragged(row + 1, more)
    for k in range(0, len(a), 1 << 16):
        x, y = a[k : k + (1 << 16)], b[k : k + (1 << 16)]
        linked = np.einsum("nd,nd->n", points[x], points[y]) >= least
        i.append(x[linked])
        j.append(y[linked])
    for low, high in zip(first[~few].tolist(), end[~few].tolist()):
        x, y = np.nonzero(np.triu(points[low:high] @ points[low:high].T >= least, 1))
        i.append(x + low)
        j.append(y + low)
    return np.concatenate([np.zeros(0, np.int64), *i]), np.concatenate([np.zeros(0, np.int64), *j])


def _task(table: pa.Table, least: float) -> pa.Table:
    """Links inside some whole buckets (side 0), or between two blocks of one bucket (sides 1 and 2).

    Per row with links: how many rows it is linked with here, and the smallest node it is
    connected with. A pair that shares several buckets counts in the first of its tables only.
    """
    table = table.sort_by([("length", "ascending"), ("bucket", "ascending"), ("side", "ascending"), ("node", "ascending")])
    node, copies, side, bucket, length = (table.column(c).to_numpy() for c in ("node", "copies", "side", "bucket", "length"))
    buckets = table.column("buckets").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
    flat, at, _ = unit(table.column("vec").combine_chunks())
    i, j = [], []
    for dim in np.unique(length).tolist():  # vectors of one length share buckets with each other only
        own = np.flatnonzero(length == dim)
        low, high = int(own[0]), int(own[-1]) + 1
        points = flat[at[low] : at[high]].reshape(-1, dim)
        if side[low]:
            other = low + int(np.searchsorted(side[low:high], 2))
            a, b = np.nonzero(points[: other - low] @ points[other - low :].T >= least)
            b = b + (other - low)
        else:
            first = np.flatnonzero(np.concatenate([[True], np.diff(bucket[low:high]) != 0]))
            a, b = _pairs(points, first, np.append(first[1:], high - low), least)
        i.append(a + low)
        j.append(b + low)
    i, j = np.concatenate(i), np.concatenate(j)
    keep = np.zeros(len(i), bool)
    for k in range(0, len(i), 1 << 16):
        x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
        first = np.argmax(buckets[x] == buckets[y], axis=1)
        keep[k : k + (1 << 16)] = buckets[x, first] == bucket[x]
    i, j = i[keep], j[keep]
    n = np.bincount(i, copies[j], len(node)) + np.bincount(j, copies[i], len(node))
    order = np.argsort(node, kind="stable")
    rank = np.empty(len(node), np.int64)
    rank[order] = np.arange(len(node))
    root, a, b = np.arange(len(node)), rank[i], rank[j]
    while len(a):
        least_ = np.minimum(root[a], root[b])
        new = root.copy()
        for ends in (root[a], root[b], a, b):
            np.minimum.at(new, ends, least_)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    some = np.flatnonzero(n)
    return pa.table({"node": pa.array(node[some], pa.int64()), "low": pa.array(node[order][root[rank[some]]], pa.int64()), "n": pa.array(n[some].astype(np.int64))})


def near_vectors(
    vectors: DataFrame, least: float = 0.98, miss: float = 1e-5, seed: int = 11,
    id_col: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> DataFrame:
    """Links between vectors of equal label whose cosine is at least `least`, and their components.

    Returns one row per row: vec_id, n_links (other rows linked directly), component_id (the
    smallest vec_id reachable by links, its own included) and kept (vec_id = component_id).
    Cosines are taken in double precision. Rows whose vector is null, empty or all zero, or
    holds null or non-finite components, and rows without a label link with nothing; vectors
    of different lengths neither. Equal vectors of one label are linked (their cosine is 1)
    and compared with others once. Rows with one vec_id are rows of their own, each counted; a
    null vec_id is the component's id only where it has no other, and such a row is kept if
    it is. An empty table gives an empty one. Other columns are not read.

    Normalised vectors are projected on random Gaussian directions, and the projections cut
    into cells (Euclidean p-stable hashing); vectors that share all cells of a table share a
    bucket. A pair at the threshold shares none with a probability of `miss` at most, a closer
    pair with less; no other link is lost. Buckets are compared in blocks of bounded size on
    both sides, each giving only counts and one parent per vector, never its pairs.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    source = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vec"))

    def directed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(unit(batch.column("vec"))[2])], [*batch.schema.names, "good"])

    rows = pin(source.mapInArrow(directed, f"{source.schema.simpleString()[7:-1]}, good boolean").withColumn(
        "key", F.when(F.col("good") & F.col("label").isNotNull(), F.sha2(F.to_json(F.struct("label", "vec")), 256))).drop("good"))
    comparable = rows.filter("key is not null")
    texts = pin(comparable.groupBy("key").agg(
        F.min_by(F.struct("label", "vec"), "row").alias("of"), F.count("*").alias("copies"), F.min("vec_id").alias("first_id"),
    ).select("key", F.xxhash64("of.label").alias("group"), F.col("of.vec").alias("vec"), "copies", "first_id").withColumn("node", F.monotonically_increasing_id()))

    most = texts.groupBy("group").count().agg(F.max("count")).first()[0] or 1
    per_table, tables = table_plan(most, least, miss)
    cell = CELL * math.sqrt(2 - 2 * least)
    hashed = pin(texts.select("node", "group", "vec").mapInArrow(lambda b: _hashed(b, per_table, tables, cell, seed), "node long, buckets array<long>"))
    buckets = hashed.select("node", F.explode("buckets").alias("bucket"))
    members = pin(buckets.join(buckets.groupBy("bucket").agg(F.count("*").alias("m")).filter("m > 1"), "bucket"))

    # buckets of up to BLOCK vectors are dealt whole to tasks of about 2 * BLOCK rows; a larger one has
    # ceil(m / BLOCK) blocks, and every two of them (sides 1 and 2), and each with itself (side 0), are a task
    whole = F.col("blocks") == 1
    sized = members.withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    tasks = 1 + sized.filter(whole).count() // (2 * BLOCK)
    small = sized.filter(whole).select(F.pmod(F.xxhash64("bucket"), F.lit(tasks)).alias("task"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), "bucket", "node", F.lit(0).alias("side"))
    large = (
        sized.filter(~whole).withColumn("own", F.pmod(F.xxhash64("node", "bucket"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(F.col("bucket").alias("task"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "bucket", "node",
                F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"))
    )
    loaded = small.unionByName(large).join(texts.select("node", "copies", "vec", F.size("vec").alias("length")), "node").join(hashed, "node")
    met = pin(loaded.groupBy("task", "i", "j").applyInArrow(lambda t: _task(t, least), "node long, low long, n long"))

    counts = met.groupBy("node").agg(F.sum("n").alias("n"))
    links = met.filter("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b"))
    labels = components(links) if not is_empty(links) else links.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    named = texts.select("key", "node", "copies", "first_id").join(counts, "node", "left").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    smallest = named.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    found = pin(named.join(smallest, "comp").select("key", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id"))
    alone = rows.filter("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = comparable.select("vec_id", "key").join(found, "key").select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
