"""Best-fit packing of whole documents into sequences of a fixed number of tokens.

Large items first: pieces of more than a third of a sequence fit at most twice into one, so
they are matched greedily, the largest with the largest that still fits. Smaller pieces then
go, the longest first, into the tightest gap. Pieces of one length are interchangeable, so
the plan is made from the count of each length (as many numbers as a sequence has tokens,
whatever the corpus), and every piece finds its place from its rank among its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import pin
from .textbytes import slices
from .tokens import encoder

_SLICE = 4 << 20


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins as (how many alike, [(length, copies in one bin), ...]) for the count of each length.

    The number of entries depends on the capacity, not on the counts.
    """
    left = {s: n for s, n in counts.items() if n}
    large = sorted(s for s in left if 3 * s > capacity)
    open_bins: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    gaps: list[int] = []
    full: list[tuple[int, list[tuple[int, int]]]] = []

    def put(many: int, holds: list[tuple[int, int]], gap: int) -> None:
        if not gap:
            full.append((many, holds))
            return
        if gap not in open_bins:
            open_bins[gap] = []
            insort(gaps, gap)
        open_bins[gap].append((many, holds))

    for s in reversed(large):
        while left[s]:
            i = bisect_left(large, min(s, capacity - s) + 1) - 1
            while i >= 0 and left[large[i]] < 1 + (large[i] == s):
                i -= 1
            if i < 0:
                put(left[s], [(s, 1)], capacity - s)
                left[s] = 0
                continue
            t = large[i]
            many = left[s] // 2 if t == s else min(left[s], left[t])
            put(many, [(s, 2)] if t == s else [(s, 1), (t, 1)], capacity - s - t)
            left[s] -= many
            left[t] -= many
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        n = left[s]
        while n:
            i = bisect_left(gaps, s)
            if i == len(gaps):
                each = capacity // s
                if n >= each:
                    put(n // each, [(s, each)], capacity - each * s)
                if n % each:
                    put(1, [(s, n % each)], capacity - n % each * s)
                break
            gap = gaps[i]
            many, holds = open_bins[gap].pop()
            if not open_bins[gap]:
                del open_bins[gap]
                gaps.pop(i)
            each = gap // s
            filled = min(many, n // each)
            if filled:
                put(filled, [*holds, (s, each)], gap - each * s)
                n -= filled * each
            rest = many - filled
            if rest and n:
                put(1, [*holds, (s, n)], gap - n * s)
                n, rest = 0, rest - 1
            if rest:
                put(rest, holds, gap)
    return full + [x for bins in open_bins.values() for x in bins]


def _pieces(batches: Iterator[pa.RecordBatch], id_col: str, text: str, path: str, capacity: int, end_id: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    encode, part = encoder(path), TaskContext.get().partitionId()
    met = np.zeros(capacity + 1, np.int64)
    for batch in slices(batches, text, _SLICE):
        ids, offsets = encode(batch.column(text))
        row, piece, start, crc, length, order, kept = [], [], [], [], [], [], []
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
            n = len(own)
            cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
            for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
                row.append(i)
                piece.append(k)
                start.append(x)
                length.append(y - x)
                crc.append(zlib.crc32(own[x:y].tobytes()))
                order.append(met[y - x])
                met[y - x] += 1
                if with_ids:
                    kept.append(own[x:y].astype(np.int32))
        columns = [
            batch.column(id_col).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
            pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(row), pa.int64()), pa.array(order, pa.int64()),
        ]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
        if with_ids:
            columns.append(pa.array(kept, pa.list_(pa.int32())))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(columns, names)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Place every document, encoded by the tokenizer file and closed by end_id, into sequences of `capacity` tokens.

    Returns one row per piece: doc_id, piece (from 0), start (ids of the document before it),
    length, ids_crc32, sequence_id (gapless from 0), offset (place in the sequence), and ids
    where asked for. A document of more than `capacity` tokens is cut; only its first piece
    may be shorter than a sequence. A null or empty text is its end id alone. Null and
    repeated ids are rows like any others; equal lengths are placed in no stated order; an
    empty table gives no rows; other columns are not read.

    The pieces are written once with their place among the pieces of the same length and task;
    the counts of each length and task then give each piece its rank, so no length is gathered
    in one task, however frequent it is.
    """
    kind = docs.schema[id_col].dataType
    fields = [T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType())]
    fields += [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "part", "nth")]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids
    made = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        lambda batches: _pieces(batches, "doc_id", "text", tokenizer, capacity, end_id, with_ids), T.StructType(fields)
    )
    pieces = pin(made)
    counts = pin(pieces.groupBy("length", "part").agg(F.count("*").alias("n")))
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")

    rows, rank, sequence = [], dict.fromkeys(total, 0), 0
    for many, holds in plan_bins(total, capacity):
        offset = 0
        for s, each in holds:
            rows.append((s, rank[s], sequence, each, offset))
            rank[s] += each * many
            offset += s * each
        sequence += many
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    keys = (table[:, 0] << 44) + table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, nth = (b.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 44) + nth, "right") - 1
            within = nth - table[at, 1]
            own = [c for c in b.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*map(b.column, own), pa.array(table[at, 2] + within // table[at, 3]), pa.array(table[at, 4] + within % table[at, 3] * length)],
                [*own, "sequence_id", "offset"],
            )

    ranked = pieces.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    out = [f.name for f in fields if f.name not in ("part", "nth")]
    schema = T.StructType([f for f in fields if f.name in out] + [T.StructField(c, T.LongType()) for c in ("sequence_id", "offset")])
    return ranked.select(*out, "rank").mapInArrow(place, schema)
