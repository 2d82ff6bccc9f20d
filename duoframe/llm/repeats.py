"""Repeated byte strings across a corpus, by a hash-compared suffix sort around shared anchors.

Every string of `length` bytes selects an anchor, its `gram`-byte run of smallest hash, so equal
strings meet at equal anchors. Around each anchor that occurs at two places the suffixes that
start at it are sorted: prefix polynomial hashes and a binary search give the common extension
of two suffixes, a mergesort orders them, and neighbours share the longest extensions. Together
with the hashes of what stands before the anchors they tell which strings of `length` bytes occur
again; every such finding is compared byte by byte before it counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import pin
from .textbytes import BASE, INVERSE, mix, powers, ragged, slices, utf8

BLOCK, CHUNK = 4096, 4096
COMPARED = 2 << 20  # bytes compared at once
_U = np.uint64


class Hashed:
    """Polynomial hashes of all substrings of a buffer, from its prefixes."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.prefix = np.zeros(len(data) + 1, _U)
        np.cumsum((data.astype(_U) + _U(1)) * powers(INVERSE, len(data)), out=self.prefix[1:])
        self.power = powers(BASE, len(data) + 1)

    def __call__(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.prefix[start + length] - self.prefix[start]) * self.power[start]

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common extension of the suffixes at a and b, up to `most`, by binary search."""
        low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self(a, middle) == self(b, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def before(self, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether suffix a sorts before b, and whether they are equal."""
        most = np.minimum(size_a, size_b)
        n = self.common(a, b, most)
        last = len(self.data) - 1
        less = np.where(n == most, size_a < size_b, self.data[np.minimum(a + n, last)] < self.data[np.minimum(b + n, last)])
        return less, (n == most) & (size_a == size_b)


def sort_suffixes(text: Hashed, start: np.ndarray, size: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Order of the suffixes (start, size) inside each group of consecutive rows, by a bottom-up mergesort.

    first and count: of each row's group. All groups and runs are merged at once: a row's new
    place is its place in its run plus its rank in the neighbouring run.
    """
    order = np.arange(len(start))
    width = 1
    while width < (count.max() if len(count) else 0):
        place = order_place = np.arange(len(order)) - first
        run = place // width
        low = np.where(run % 2 == 0, run + 1, run - 1) * width
        high = np.minimum(low + width, count)
        low = np.minimum(low, high)
        own = run % 2
        lo, hi = low + first, high + first
        me, my = start[order], size[order]
        while (open_ := np.flatnonzero(lo < hi)).size:
            middle = (lo[open_] + hi[open_]) // 2
            them = order[middle]
            less, same = text.before(start[them], me[open_], size[them], my[open_])
            up = less | (same & (own[open_] == 1))
            lo[open_] = np.where(up, middle + 1, lo[open_])
            hi[open_] = np.where(up, hi[open_], middle)
        rank = lo - (low + first)
        target = first + run // 2 * 2 * width + (order_place - run * width) + rank
        moved = np.empty_like(order)
        moved[target] = order
        order = moved
        width *= 2
    return order


def _anchors(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        data, at = utf8(batch.column("text"))
        text, n = Hashed(data), len(data)
        span = length - gram + 1
        rows = np.arange(batch.num_rows)
        position = near = far = np.zeros(0, np.int64)
        if n >= length:
            value = mix(text(np.arange(n - gram + 1), gram))
            place = _minima(value, span)
            row = np.repeat(rows, np.diff(at))
            start = np.flatnonzero(row[: n - length + 1] == row[length - 1 :])
            # the strings that select one place start at consecutive bytes
            position, first, many = np.unique(place[start], return_index=True, return_counts=True)
            far, near = position - start[first], position - start[first + many - 1]
        row = np.searchsorted(at, position, "right") - 1
        cuts = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
        marks = value[position].view(np.int64) if len(position) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("key"), pa.array(np.diff(at)), pa.ListArray.from_arrays(cuts, pa.array(marks)),
             pa.ListArray.from_arrays(cuts, pa.array(position - at[row])), pa.ListArray.from_arrays(cuts, pa.array(near.astype(np.int32))),
             pa.ListArray.from_arrays(cuts, pa.array(far.astype(np.int32)))],
            ["doc_id", "key", "n_bytes", "marks", "places", "nears", "fars"],
        )


def _minima(value: np.ndarray, span: int) -> np.ndarray:
    """Last place of the smallest value of every `span` consecutive ones, by doubling."""
    best, place = value.copy(), np.arange(len(value))
    have = 1
    while have < span:
        step = min(have, span - have)
        a, b = best[:-step], best[step:]
        later = b <= a
        best, place = np.where(later, b, a), np.where(later, place[step:], place[:-step])
        have += step
    return place


def _contexts(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """The bytes around each wanted anchor: all strings of `length` bytes that select it."""
    for batch in slices(batches, "text"):
        data, at = utf8(batch.column("text"))
        whole = memoryview(data)
        lists = batch.column("wanted")
        out: dict[str, list] = {c: [] for c in ("mark", "block", "split", "key", "place", "near", "left", "bytes")}
        for i, key in enumerate(batch.column("key").to_pylist()):
            for w in lists[i].as_py():
                p = int(at[i]) + w["place"]
                part = bytes(whole[p - w["far"] : p - w["near"] + length])
                for c, v in zip(out, (w["mark"], w["block"], w["split"], key, w["place"], w["near"], w["far"], part)):
                    out[c].append(v)
                if len(out["mark"]) >= 20_000:
                    yield _context_batch(out)
                    out = {c: [] for c in out}
        if out["mark"]:
            yield _context_batch(out)


def _context_batch(out: dict[str, list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], list(out))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Chunks of sorted rows that hold whole groups (mark, block)."""
    waiting: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        waiting.append(batch)
        rows += batch.num_rows
        while rows >= CHUNK:
            table = pa.Table.from_batches(waiting)
            mark, block = table.column("mark").to_numpy(), table.column("block").to_numpy()
            edges = np.flatnonzero((mark[1:] != mark[:-1]) | (block[1:] != block[:-1])) + 1
            if not len(edges):
                break
            cut = int(edges[min(np.searchsorted(edges, CHUNK), len(edges) - 1)])
            yield table.slice(0, cut)
            waiting, rows = table.slice(cut).to_batches(), rows - cut
    if rows:
        yield pa.Table.from_batches(waiting)


def repeated_windows(table: pa.Table, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows of whole groups: which strings start `o` bytes before the anchor and occur again in the group.

    A row's bytes are the strings that select its anchor: those that start from `left` down to
    `near` bytes before it. Returns two matrices, rows x (length - gram + 1): whether there is
    such a string, and the row of an equal one (-1: none).
    """
    data, at = utf8(table.column("bytes").combine_chunks().cast(pa.large_binary()).view(pa.large_string()))
    text = Hashed(data)
    left, near = table.column("left").to_numpy(), table.column("near").to_numpy()
    anchor, right = at[:-1] + left, np.diff(at) - left
    mark, block = table.column("mark").to_numpy(), table.column("block").to_numpy()
    n = len(mark)
    edge = np.concatenate([[True], (mark[1:] != mark[:-1]) | (block[1:] != block[:-1])])
    starts = np.flatnonzero(edge)
    counts = np.diff(np.append(starts, n))
    first, count = np.repeat(starts, counts), np.repeat(counts, counts)
    order = sort_suffixes(text, anchor, right, first, count)
    a, b = anchor[order[:-1]], anchor[order[1:]]
    shared = text.common(a, b, np.minimum(right[order[:-1]], right[order[1:]]))
    shared = np.where(edge[1:], -1, shared)  # neighbours of different groups share nothing

    offsets = length - gram + 1
    inside = (left[:, None] >= np.arange(offsets)) & (near[:, None] <= np.arange(offsets))
    partner = np.full((n, offsets), -1)
    for o in range(offsets):
        kind = np.concatenate([[0], np.cumsum(shared < length - o)])
        rows = order[inside[order, o]]
        if len(rows) < 2:
            continue
        kinds = kind[inside[order, o]]
        before = text(anchor[rows] - o, o)
        by = np.lexsort((before, kinds))
        rows, kinds, before = rows[by], kinds[by], before[by]
        new = np.concatenate([[True], (kinds[1:] != kinds[:-1]) | (before[1:] != before[:-1])])
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(rows)))
        head = np.repeat(heads, sizes)
        many = np.repeat(sizes, sizes) > 1
        other = np.where(np.arange(len(rows)) == head, np.minimum(head + 1, len(rows) - 1), head)
        partner[rows[many], o] = rows[other[many]]

    # compare the bytes of every run of offsets that has one partner
    change = np.ones((n, offsets), bool)
    change[:, 1:] = partner[:, 1:] != partner[:, :-1]
    row, low = np.nonzero(change & (partner >= 0))
    flat = np.flatnonzero(change.reshape(-1))
    following = np.append(flat, n * offsets)[np.searchsorted(flat, row * offsets + low, "right")]
    high = following - row * offsets - 1
    whom = partner[row, low]
    span = high - low + length
    run, bad = np.cumsum(span), set()
    i = 0
    while i < len(span):
        j = max(i + 1, int(np.searchsorted(run, (run[i - 1] if i else 0) + COMPARED, "right")))
        size = span[i:j]
        other = data[ragged(anchor[row[i:j]] - high[i:j], size)] != data[ragged(anchor[whom[i:j]] - high[i:j], size)]
        bad |= set(row[i:j][np.add.reduceat(other, np.cumsum(size) - size) > 0].tolist())
        i = j
    for r in bad:  # hashes that lied: decide the row's strings from the bytes alone
        peers = [int(j) for j in range(first[r], first[r] + count[r]) if j != r]
        for o in np.flatnonzero(inside[r]):
            mine = data[anchor[r] - o : anchor[r] - o + length].tobytes()
            partner[r, o] = next((j for j in peers if inside[j, o] and data[anchor[j] - o : anchor[j] - o + length].tobytes() == mine), -1)
    return inside, partner


def _matched(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Repeated stretches of each text; of groups in several blocks also the strings to match across blocks."""
    for table in _groups(batches):
        inside, partner = repeated_windows(table, length, gram)
        place, key = table.column("place").to_numpy(), table.column("key").combine_chunks()
        hit = np.zeros((len(place), partner.shape[1] + 2), np.int8)
        hit[:, 1:-1] = partner >= 0
        edge = np.diff(hit, axis=1)
        row, low = np.nonzero(edge == 1)
        high = np.nonzero(edge == -1)[1] - 1
        out = [key.take(pa.array(row)), pa.array(place[row] - high), pa.array(place[row] - low + length), pa.nulls(len(row), pa.binary()), pa.array(np.zeros(len(row), bool))]
        names = ["key", "first", "end", "string", "open"]
        yield pa.RecordBatch.from_arrays(out, names)
        split = table.column("split").to_numpy()
        if split.any():
            # undecided strings, and one of each that the block has more than once
            row, o = np.nonzero((inside & ((partner < 0) | (partner > np.arange(len(place))[:, None]))) & split[:, None])
            data, left = table.column("bytes").combine_chunks(), table.column("left").to_numpy()
            for i in range(0, len(row), 50_000):
                r, p = row[i : i + 50_000], o[i : i + 50_000]
                whole = {int(j): data[int(j)].as_py() for j in np.unique(r)}
                names_of = [hashlib.blake2b(whole[int(j)][left[j] - q : left[j] - q + length], digest_size=16).digest() for j, q in zip(r, p)]
                yield pa.RecordBatch.from_arrays([key.take(pa.array(r)), pa.array(place[r] - p), pa.array(place[r] - p + length), pa.array(names_of, pa.binary()), pa.array(partner[r, p] < 0)], names)


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = []
        for text, spans in zip(batch.column("text"), batch.column("spans")):
            data, at, rest = (text.as_py() or "").encode(), 0, hashlib.sha256()
            for s in spans.as_py():
                rest.update(data[at : s["first"]])
                at = s["end"]
            rest.update(data[at:])
            kept.append(rest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n_removed"), batch.column("spans"), pa.array(kept, pa.string())], ["key", "n_removed", "spans", "kept_sha256"])


def find_repeats(docs: DataFrame, length: int = 200, gram: int = 64, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Bytes of each document that lie in a string of `length` bytes that also starts elsewhere.

    Returns one row per document: doc_id, n_bytes, n_removed, spans (maximal removed runs, as
    byte ranges), kept_sha256 (of the remaining bytes joined). Strings never cross documents;
    overlapping occurrences and other places of the same document count; strings are judged on
    the input. A null text is empty; shorter texts lose nothing; of equal texts all copies lose
    all bytes if they have `length` of them. Null and repeated ids are rows like any other.
    Other columns are not read.

    Equal texts are searched once. Anchors that occur once are dropped after a pre-aggregated
    count. Those that occur often are dealt into blocks of about BLOCK places, and what a block
    cannot decide is matched across blocks by the digest of the string, so no anchor gathers in
    one task. A text of very short period has an anchor at nearly every byte.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("key", F.sha2(F.col("text").cast("binary"), 256))
    base = pin(source.mapInArrow(lambda b: _anchors(b, length, gram), f"doc_id {kind}, key string, n_bytes long, marks array<long>, places array<long>, nears array<int>, fars array<int>"))
    copies = base.groupBy("key").agg(F.count("*").alias("copies"))
    anchors = base.select("key", F.explode(F.arrays_zip("marks", "places", "nears", "fars")).alias("a")).select(
        "key", F.col("a.marks").alias("mark"), F.col("a.places").alias("place"), F.col("a.nears").alias("near"), F.col("a.fars").alias("far"))
    named = anchors.select("mark", F.xxhash64("key", "place").alias("f"))
    shared = pin(named.groupBy("mark").agg(F.min("f").alias("low"), F.max("f").alias("high"), F.count("*").alias("n")).filter("low != high").select("mark", "n"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    wanted = anchors.join(shared, "mark").select("key", F.struct(
        "place", "near", "far", "mark", F.pmod(F.xxhash64("key", "place"), blocks).cast("int").alias("block"), (blocks > 1).alias("split")).alias("w"))
    lists = pin(wanted.groupBy("key").agg(F.collect_set("w").alias("wanted")))  # as many as a text has anchors
    once = source.groupBy("key").agg(F.first("text").alias("text"))  # copies are dropped within each task first
    texts = pin(once.join(lists, "key"))
    around = texts.mapInArrow(lambda b: _contexts(b, length, gram), "mark long, block int, split boolean, key string, place long, near long, left long, bytes binary")
    sorted_ = around.repartition("mark", "block").sortWithinPartitions("mark", "block")
    matched = pin(sorted_.mapInArrow(lambda b: _matched(b, length, gram), "key string, first long, end long, string binary, open boolean"))
    local = matched.filter("string is null").select("key", "first", "end")
    strings = matched.filter("string is not null")
    named = strings.select("string", F.xxhash64("key", "first").alias("f"))
    twice = named.groupBy("string").agg(F.min("f").alias("low"), F.max("f").alias("high")).filter("low != high").select("string")
    across = strings.filter("open").join(twice, "string").select("key", "first", "end")

    by = Window.partitionBy("key").orderBy("first", "end")
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    runs = (
        local.unionByName(across).withColumn("before", before).withColumn("opens", (F.col("before").isNull() | (F.col("first") > F.col("before"))).cast("int"))
        .withColumn("run", F.sum("opens").over(by.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("key", "run").agg(F.min("first").alias("first"), F.max("end").alias("end"))
        .groupBy("key").agg(F.sum(F.col("end") - F.col("first")).alias("n_removed"), F.array_sort(F.collect_list(F.struct("first", "end"))).alias("spans"))
    )
    cut = pin(texts.select("key", "text").join(runs, "key").select("key", "text", "n_removed", "spans").mapInArrow(
        _without, "key string, n_removed long, spans array<struct<first: long, end: long>>, kept_sha256 string"))
    info = copies.join(cut, "key", "left")
    rows = base.select("doc_id", "key", "n_bytes").join(info, "key")
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    none = F.array().cast("array<struct<first: bigint, end: bigint>>")
    all_of = F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n_bytes").alias("end")))
    return rows.select(
        "doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, all_of).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.when(gone, F.lit(hashlib.sha256().hexdigest())).otherwise(F.coalesce("kept_sha256", "key")).alias("kept_sha256"),
    )
