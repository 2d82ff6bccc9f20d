"""Near-duplicate classes: BagMinHash signatures, bands, and exact multiset overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import is_empty, pin
from .bagminhash import bag, signatures
from .textbytes import Words, mix, slices

# members of a bucket that one task compares with each other: MINOR rows against MAJOR rows
MINOR, MAJOR = 256, 2048


def _shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every run of `size` words; a text of fewer words, but not none, is one run."""
    at, value = words.grams(size)
    doc = words.doc[at]
    for k in range(1, size):
        few = np.flatnonzero(np.diff(words.first) == k)
        if len(few):
            at, own = words.grams(k)
            keep = np.isin(words.doc[at], few)
            doc, value = np.append(doc, words.doc[at][keep]), np.append(value, own[keep])
    return doc, value


def _signed(batches: Iterator[pa.RecordBatch], shingle: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", rows=1024):  # every text, however short, fills all registers
        doc, value = _shingles(Words(batch.column("text")), shingle)
        doc, value, weight = bag(doc, value)
        names = signatures(doc, value, weight, batch.num_rows, bands * rows).reshape(-1, bands, rows)
        band = np.tile(np.arange(bands, dtype=np.uint64), (batch.num_rows, 1))
        for j in range(rows):
            band = mix(band ^ names[:, :, j])
        empty = np.bincount(doc, minlength=batch.num_rows) == 0
        lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * bands), pa.array(band.reshape(-1).view(np.int64)))
        key = pa.array([None if e else k for k, e in zip(batch.column("key").to_pylist(), empty)], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), key, lists], ["doc_id", "key", "bands"])


def _bags(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """Sorted 32-bit names of all shingles of each text, repeated ones as often as they occur."""
    for batch in slices(batches, "text"):
        doc, value = _shingles(Words(batch.column("text")), shingle)
        value = (value >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((value, doc))
        value, cuts = value[order], np.searchsorted(doc[order], np.arange(batch.num_rows + 1))
        data = [value[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(data, pa.binary())], ["node", "bag"])


def _ranked(names: np.ndarray) -> np.ndarray:
    """Sorted names with the number of equal ones before each: equal pairs are shared occurrences."""
    first = np.ones(len(names), bool)
    first[1:] = names[1:] != names[:-1]
    start = np.maximum.accumulate(np.where(first, np.arange(len(names)), 0))
    return (names.astype(np.uint64) << np.uint64(32)) | (np.arange(len(names)) - start).astype(np.uint64)


def _similarity(one: bytes, other: bytes) -> float:
    a, b = (_ranked(np.frombuffer(x, np.uint32)) for x in (one, other))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _verified(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column("left_bag"), batch.column("right_bag")
        good = [_similarity(x.as_py(), y.as_py()) >= similarity for x, y in zip(left, right)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))


def _block(table: pa.Table, similarity: float) -> pa.Table:
    """Links between the minor members and all others of one block of a bucket, unless already in one component.

    A pair that shares several buckets is compared in the first of them only.
    """
    node, comp, minor = (table.column(c).to_numpy() for c in ("node", "comp", "minor"))
    bands = np.array(table.column("bands").to_pylist(), np.int64).reshape(len(node), -1)
    here = table.column("h")[0].as_py()
    bags = [_ranked(np.frombuffer(x.as_py(), np.uint32)) for x in table.column("bag")]
    size = np.array([len(x) for x in bags])
    other = np.flatnonzero(table.column("other").to_numpy())
    flat, row = np.concatenate([bags[i] for i in other]) if len(other) else np.zeros(0, np.uint64), np.repeat(np.arange(len(other)), size[other])
    found = set()
    for i in np.flatnonzero(minor):
        same = bands[other] == bands[i]
        compare = (comp[other] != comp[i]) & (bands[other, np.argmax(same, axis=1)] == here)
        if not compare.any():
            continue
        at = np.searchsorted(bags[i], flat)
        shared = np.bincount(row[bags[i][np.minimum(at, size[i] - 1)] == flat], minlength=len(other))
        good = compare & (shared >= similarity * (size[other] + size[i] - shared))
        found |= {(int(min(node[i], node[j])), int(max(node[i], node[j]))) for j in other[good]}
    a, b = zip(*sorted(found)) if found else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def components(links: DataFrame) -> DataFrame:
    """node, comp (smallest node it is connected with) for every end of the links (a, b).

    Stars are joined to the smallest neighbour by turns, over larger and over smaller
    neighbours; each turn is a written table, so nothing is gathered or recomputed.
    """
    edges = pin(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = pin(small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").unionByName(
            small.select("u", F.col("m").alias("v")).filter("u > v")).distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("comp", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots)


def _classified(docs: DataFrame, similarity: float, shingle: int, bands: int, rows: int, id_col: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Every row with its text's key (null without words), and every key with its class and whether it stays."""
    kind = docs.schema[id_col].dataType.simpleString()
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), F.sha2(F.col(text).cast("binary"), 256).alias("key"))
    signed = pin(keyed.mapInArrow(lambda b: _signed(b, shingle, bands, rows), f"doc_id {kind}, key string, bands array<long>"))
    texts = pin(signed.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("first_id"), F.first("bands").alias("bands"))
                .withColumn("node", F.monotonically_increasing_id()))

    buckets = texts.select("node", F.explode("bands").alias("h"))
    members = pin(buckets.join(buckets.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "h"))
    weight = pin(members.groupBy("node").agg(F.sum("n").alias("weight")))
    heads = members.join(weight, "node").groupBy("h").agg(F.max(F.struct("weight", (-F.col("node")).alias("node"))).alias("head"))
    pairs = members.join(heads.select("h", (-F.col("head.node")).alias("head")), "h").filter("node != head").select(
        F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct()

    wanted = texts.join(weight.select("node"), "node").select("key", "first_id", "node")
    own = keyed.join(wanted, "key").filter(F.col("doc_id").eqNullSafe(F.col("first_id"))).select("node", "text")
    bags = pin(own.dropDuplicates(["node"]).mapInArrow(lambda b: _bags(b, shingle), "node long, bag binary"))
    side = lambda name, to: bags.select(F.col("node").alias(to), F.col("bag").alias(name))
    links = pin(pairs.join(side("left_bag", "a"), "a").join(side("right_bag", "b"), "b").select("a", "b", "left_bag", "right_bag").mapInArrow(
        lambda b: _verified(b, similarity), "a long, b long"))
    labels = components(links)

    placed = members.select("h", "node").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    counts = placed.groupBy("h", "comp").agg(F.count("*").alias("n"))
    open_buckets = counts.groupBy("h").agg(F.max(F.struct("n", "comp")).alias("top"), F.count("*").alias("comps"), F.sum("n").alias("n")).filter("comps > 1")
    rest = pin(placed.join(open_buckets.select("h", F.col("top.comp").alias("top"), (F.col("n") - F.col("top.n")).alias("minors"), "n"), "h"))
    if not is_empty(rest):
        at = F.pmod(F.xxhash64("node", "h"), F.lit(1 << 30))
        lefts, rights = F.ceil(F.col("minors") / MINOR), F.ceil(F.col("n") / MAJOR)
        left, right = (at % lefts).cast("int"), (at % rights).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
        queries = rest.filter("comp != top").select("h", "node", "comp", left.alias("i"), every(rights).alias("j"), F.lit(True).alias("minor"), F.lit(False).alias("other"))
        others = rest.select("h", "node", "comp", every(lefts).alias("i"), right.alias("j"), F.lit(False).alias("minor"), F.lit(True).alias("other"))
        task = queries.unionByName(others).groupBy("h", "i", "j", "node", "comp").agg(F.max("minor").alias("minor"), F.max("other").alias("other"))
        loaded = task.join(bags, "node").join(texts.select("node", "bands"), "node")
        more = pin(loaded.groupBy("h", "i", "j").applyInArrow(lambda t: _block(t, similarity), "a long, b long"))
        if not is_empty(more):
            labels = components(links.unionByName(more))

    named = texts.select("node", "key", "first_id").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    smallest = named.groupBy("comp").agg(F.min(F.struct(F.isnull("first_id").alias("none"), "first_id", "key")).alias("best"))
    return signed, pin(named.join(smallest, "comp").select("key", F.col("best.first_id").alias("class_id"), (F.col("key") == F.col("best.key")).alias("stays")))


def near_classes(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, bands: int = 32, rows: int = 4, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Class of each document: documents linked, directly or through others, by a weighted
    Jaccard similarity of at least `similarity` of their multisets of word shingles.

    Returns one row per document: doc_id and class_id (the smallest doc_id of its class). Words
    are runs of digits, letters and bytes over 0x7F, A-Z lower-cased; a text of fewer words
    than a shingle is one shingle. Texts without words (null, empty, marks only) are each a
    class of their own. Equal texts are one class whatever their ids; null ids are the class
    id only where a class has no other; other columns are not read.

    Equal texts are compared once. Texts that share a band meet in its bucket: all members are
    compared with the one that shares most bands with others, and the links so found give
    components. Only buckets with several components left are compared further, each member
    outside the bucket's largest component with every member of another, in blocks of bounded
    size. A pair of at least `similarity` shares no band with a probability of
    (1 - similarity ** rows) ** bands (5e-8 by default); no other link is lost.
    """
    signed, class_of = _classified(docs, similarity, shingle, bands, rows, id_col, text)
    alone = signed.filter("key is null").select("doc_id", F.col("doc_id").alias("class_id"))
    return signed.filter("key is not null").select("doc_id", "key").join(class_of, "key").select("doc_id", "class_id").unionByName(alone)


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, bands: int = 32, rows: int = 4, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that stay: of each class the one of the smallest id.

    Of rows with equal texts and ids any one stays. Texts without words all stay.
    """
    signed, class_of = _classified(docs, similarity, shingle, bands, rows, id_col, text)
    key = "near_key"
    while key in docs.columns:
        key += "_"
    named = docs.withColumn(key, F.sha2(F.col(text).cast("binary"), 256))
    gone = pin(class_of.filter(~F.col("stays")).select(F.col("key").alias(key)))
    copied = pin(signed.filter("key is not null").groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("key").alias(key)))
    rest = named.join(gone, key, "left_anti")
    if is_empty(copied):
        return rest.drop(key)
    first = F.min_by(F.struct(*[docs[f"`{c}`"] for c in docs.columns]), F.struct(F.isnull(id_col), F.col(id_col)))
    one = rest.join(copied, key, "left_semi").groupBy(key).agg(first.alias("row")).select("row.*")
    return rest.join(copied, key, "left_anti").drop(key).unionByName(one)
