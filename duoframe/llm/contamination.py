"""Benchmark decontamination by winnowing: shared spans of `window` words are never missed.

Of every `window` consecutive words the smallest hash of their `gram`-word runs is the
fingerprint, so two texts that share the words share the fingerprint at the same place. The
documents' fingerprints are matched with the benchmark's, and each hit is extended to the
whole windows around it, which are compared word by word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import pin
from .textbytes import Words, mix, slices

MIN_BITS, MAX_BITS = 16, 26
_SIZED = np.uint64(0x100000001B3)


def _windows(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of every whole window, and the fingerprint it selects (the last of equal ones)."""
    at, value = words.grams(gram)
    span = window - gram + 1
    n = len(at) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    whole = at[:n] + span - 1 == at[span - 1 :]  # grams of one text are consecutive words
    best = value[:n].copy()
    for j in range(1, span):
        np.minimum(best, value[j : j + n], out=best)
    return at[:n][whole], mix(best[whole])


def _text(words: Words, first: int, size: int) -> bytes:
    return b" ".join(words.data[a:b].tobytes() for a, b in zip(words.start[first : first + size], words.end[first : first + size]))


def _short(fingerprint: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of items of fewer words: the whole item, told apart by its length."""
    return mix(fingerprint ^ (_SIZED * np.uint64(size)))


def _item_windows(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        words = Words(batch.column("text"))
        counts = np.diff(words.first)
        first, mark = _windows(words, window, gram)
        rows = [(words.doc[f], window, m, _text(words, f, window)) for f, m in zip(first.tolist(), mark.view(np.int64).tolist())]
        for size in range(1, window):
            if own := np.flatnonzero(counts == size).tolist():
                at, value = words.grams(size)
                mark_of = dict(zip(at.tolist(), _short(value, size).view(np.int64).tolist()))
                rows += [(i, size, mark_of[words.first[i]], _text(words, words.first[i], size)) for i in own]
        doc, size, mark, text = zip(*rows) if rows else ([], [], [], [])
        yield pa.RecordBatch.from_arrays(
            [batch.column("item_id").take(pa.array(np.array(doc, np.int64))), pa.array(size, pa.int32()), pa.array(mark, pa.int64()), pa.array(text, pa.binary())],
            ["item_id", "size", "mark", "words"],
        )


def _bitmap(marks: DataFrame) -> np.ndarray:
    """Bits of the benchmark's fingerprints, at most 2**MAX_BITS (8 MB) of them however many there are."""
    n = marks.count()
    bits = min(MAX_BITS, max(MIN_BITS, int(n * 32).bit_length()))
    place = F.shiftrightunsigned("mark", 64 - bits)
    words = marks.select(place.alias("place")).groupBy(F.shiftright("place", 5).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 31 as int))")).alias("set")).toArrow()
    out = np.zeros(1 << bits - 5, np.uint32)
    out[words.column("at").to_numpy()] = words.column("set").to_numpy().astype(np.uint32)
    return out


def _in(bitmap: np.ndarray, marks: np.ndarray) -> np.ndarray:
    place = marks >> np.uint64(64 - 5 - (len(bitmap).bit_length() - 1))
    return (bitmap[(place >> np.uint64(5)).astype(np.int64)] >> (place & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1


def _candidates(batches: Iterator[pa.RecordBatch], window: int, gram: int, sizes: list[int], bitmap: np.ndarray, many: int = 20_000) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("first", pa.int32()), ("size", pa.int32()), ("mark", pa.int64()), ("words", pa.binary())]))
    for batch in slices(batches, "text"):
        words = Words(batch.column("text"))
        found = []
        for size in sizes:
            if size == window:
                first, mark = _windows(words, window, gram)
            else:
                first, mark = words.grams(size)
                mark = _short(mark, size)
            hit = _in(bitmap, mark)
            found.append((first[hit], np.full(int(hit.sum()), size, np.int64), mark[hit].view(np.int64)))
        first, size, mark = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
        order = np.argsort(first, kind="stable")
        first, size, mark = first[order], size[order], mark[order]
        ends = np.searchsorted(words.doc[first], np.arange(batch.num_rows + 1))
        raw = batch.column("text").to_pylist()
        start = 0
        while start < batch.num_rows:  # few rows at a time where there are many hits
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + many, "right")) - 1)
            stop = min(stop, batch.num_rows)
            rows = []
            for i in range(start, stop):
                at = range(ends[i], ends[i + 1])
                rows.append([{"first": first[j] - words.first[i], "size": size[j], "mark": mark[j], "words": _text(words, first[j], size[j])} for j in at])
            keys = [hashlib.sha256((raw[i] or "").encode()).digest() if rows[i - start] else None for i in range(start, stop)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(start, stop - start), pa.array(keys, pa.binary()), pa.array(np.diff(words.first)[start:stop]), pa.array(rows, kind)],
                ["doc_id", "key", "n_words", "found"],
            )
            start = stop


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, gram: int = 5, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Words of each document that lie inside an occurrence of a benchmark window.

    A window is `window` consecutive words of an item; an item of fewer words, but not none,
    is one window. Words are runs of digits, letters and bytes over 0x7F, A-Z lower-cased.
    Returns one row per document: doc_id, key (sha256 of the text, of documents with possible
    hits), n_words, n_hit, spans (runs of hit words as first
    and end word), items (ids of the items met, as strings, sorted) and contaminated.

    Null and empty texts have no words and are clean. A null item id stands as the empty
    string; repeated item ids are one item; repeated documents each get their row; without
    items every document is clean. Other columns are not read.

    Only windows whose fingerprint is in a bitmap of bounded size leave a document's task; the
    rest is decided by joins on the fingerprint and the words themselves, once per different text.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    chosen = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item_id"), F.col(item_text).alias("text"))
    rows = pin(chosen.mapInArrow(lambda b: _item_windows(b, window, gram), "item_id string, size int, mark long, words binary"))
    wins = pin(rows.groupBy("size", "mark", "words").agg(F.array_sort(F.collect_set("item_id")).alias("items")))
    sizes = sorted(r["size"] for r in wins.select("size").distinct().collect())  # at most `window` numbers
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(wins.select("mark").distinct()))

    marked = pin(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        lambda b: _candidates(b, window, gram, sizes, bitmap.value),
        f"doc_id {kind}, key binary, n_words long, found array<struct<first: int, size: int, mark: long, words: binary>>",
    ))
    found = marked.filter("key is not null").select("key", F.explode("found").alias("f")).select("key", "f.*").distinct()
    hits = pin(found.join(wins, ["size", "mark", "words"]).select("key", "first", (F.col("first") + F.col("size")).alias("end"), "items"))
    by = Window.partitionBy("key").orderBy("first", "end")
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    runs = (
        hits.withColumn("before", before).withColumn("opens", (F.col("before").isNull() | (F.col("first") > F.col("before"))).cast("int"))
        .withColumn("run", F.sum("opens").over(by.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("key", "run").agg(F.min("first").alias("first"), F.max("end").alias("end"))
        .groupBy("key").agg(F.sum(F.col("end") - F.col("first")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("first", "end"))).alias("spans"))
    )
    met = hits.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    out = ["doc_id", "key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit")]
    none = F.array().cast("array<struct<first: int, end: int>>"), F.array().cast("array<string>")
    out += [F.coalesce("spans", none[0]).alias("spans"), F.coalesce("items", none[1]).alias("items"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated")]
    clean = marked.filter("key is null").select("doc_id", "key", "n_words", F.lit(0).cast("long").alias("n_hit"), none[0].alias("spans"), none[1].alias("items"), F.lit(False).alias("contaminated"))
    return marked.filter("key is not null").select("doc_id", "key", "n_words").join(runs.join(met, "key"), "key", "left").select(*out).unionByName(clean)


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of docs, with all their columns, in which no benchmark window occurs."""
    met = decontaminate(docs, items, text=text, **options)
    hit = pin(met.filter("contaminated").select("key").distinct())
    key = "contamination_key"
    while key in docs.columns:
        key += "_"
    named = docs.withColumn(key, F.unhex(F.sha2(F.col(text).cast("binary"), 256)))
    return named.join(hit.withColumnRenamed("key", key), key, "left_anti").drop(key)
