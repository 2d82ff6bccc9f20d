"""Codes of vectors from codebooks of their parts, with distances pruned by fixed pivots (LAESA)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import pin
from .textbytes import release

ROWS = 4096  # vectors handled at a time
LIMIT = 1 << 24  # scaled components stay below it, so that squared distances fit a long


def choose_pivots(book: np.ndarray, many: int) -> np.ndarray:
    """Of the entries (entries x width), `many` that lie far apart: each next one is farthest from those before."""
    far = ((book - book[0]) ** 2).sum(axis=1)
    chosen = [0]
    while len(chosen) < min(many, len(book)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((book - book[chosen[-1]]) ** 2).sum(axis=1))
    return book[chosen]


def distances(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of two integer tables; the squares are exact before the root."""
    return np.sqrt(np.stack([((points - o) ** 2).sum(axis=1) for o in others], axis=1).astype(np.float64))


def nearest(points: np.ndarray, to_pivots: np.ndarray, book: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entry of each point (ties to the lower index), its squared distance, and the evaluations made.

    By the triangle inequality an entry is no nearer than the largest difference between the
    distances of point and entry to a pivot. Entries are taken by this bound, smallest first;
    a point is done once the next bound exceeds its best distance, by more than rounding can
    hide. Squared distances are exact integers.
    """
    n, entries = len(points), len(book)
    entry_to_pivot = distances(book, pivots)
    bound = np.zeros((n, entries))
    for p in range(len(pivots)):
        gap = np.abs(to_pivots[:, p, None] - entry_to_pivot[None, :, p])
        np.maximum(bound, gap - 1e-6 * (1 + to_pivots[:, p, None] + entry_to_pivot[None, :, p]), out=bound)  # to_pivots is kept in single precision
    order = np.argsort(bound, axis=1, kind="stable")
    bound = np.take_along_axis(bound, order, axis=1)
    best, which = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
    left, made = np.arange(n), 0
    for k in range(entries):
        left = left[bound[left, k] <= np.sqrt(best[left].astype(np.float64)) * (1 + 1e-12)]
        if not len(left):
            break
        made += len(left)
        own = order[left, k]
        square = ((points[left] - book[own]) ** 2).sum(axis=1)
        better = (square < best[left]) | ((square == best[left]) & (own < which[left]))
        best[left[better]], which[left[better]] = square[better], own[better]
    return which, best, made


def _floats(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All components as doubles, first place of each row, and whether the row is no null and holds none."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    flat = column.values.slice(at[0], at[-1] - at[0])
    whole = np.array(column.is_valid(), bool)
    if flat.null_count:
        gone = np.concatenate([[0], np.cumsum(np.array(flat.is_null(), bool))])
        whole &= gone[at[1:] - at[0]] == gone[at[:-1] - at[0]]
        flat = flat.fill_null(0)
    return flat.to_numpy(zero_copy_only=False).astype(np.float64), at - at[0], whole


def _scaled(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    """floor(scale * x) of the vectors that are kept."""
    for batch in batches:
        flat, at, whole = _floats(batch.column("vec"))
        with np.errstate(over="ignore", invalid="ignore"):
            value = np.floor(flat * scale)
            bad = np.concatenate([[0], np.cumsum(~(np.abs(value) < LIMIT))])
        keep = whole & (bad[at[1:]] == bad[at[:-1]])
        value = np.where(np.abs(value) < LIMIT, value, 0).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(value))
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), lists], ["vec_id", "label", "units"]).filter(pa.array(keep))
    release()


def _matrix(batch: pa.RecordBatch, name: str, width: int, kind) -> np.ndarray:
    return np.asarray(batch.column(name).flatten(), kind).reshape(batch.num_rows, width)


def _first(batches: Iterator[pa.RecordBatch], many: int) -> Iterator[pa.RecordBatch]:
    """The `many` smallest ids of a task (null last), each with its smallest vector."""
    kept: dict = {}
    schema = None
    for batch in batches:
        schema = batch.schema
        for row in batch.to_pylist():
            key = (row["vec_id"] is None, row["vec_id"] or 0)
            if key not in kept or row["units"] < kept[key]["units"]:
                kept[key] = row
        kept = {k: kept[k] for k in sorted(kept)[:many]}
    if kept:
        yield pa.RecordBatch.from_pylist(list(kept.values()), schema)


def _with_pivots(batches: Iterator[pa.RecordBatch], pivots: list[np.ndarray], dim: int) -> Iterator[pa.RecordBatch]:
    """Add the distances of every part to the fixed pivots of its position, part after part."""
    width = dim // len(pivots)
    for batch in _cut(batches):
        units = _matrix(batch, "units", dim, np.int64)
        far = np.concatenate([distances(units[:, k * width : (k + 1) * width], p) for k, p in enumerate(pivots)], axis=1).astype(np.float32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * far.shape[1]), pa.array(far.reshape(-1)))
        yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "far"])
    release()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            yield batch.slice(k, ROWS)


def _assigned(batch: pa.RecordBatch, books: list[np.ndarray], pivots: list[np.ndarray], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per part position: the parts, their entries and squared distances."""
    width = dim // len(books)
    units = _matrix(batch, "units", dim, np.int64)
    far = _matrix(batch, "far", sum(map(len, pivots)), np.float64)
    at = 0
    for k, (book, own) in enumerate(zip(books, pivots)):
        parts = units[:, k * width : (k + 1) * width]
        which, square, _ = nearest(parts, far[:, at : at + len(own)], book, own)
        at += len(own)
        yield parts, which, square


def _sums(batches: Iterator[pa.RecordBatch], books: list[np.ndarray], pivots: list[np.ndarray], dim: int) -> Iterator[pa.RecordBatch]:
    """Per part position and entry: how many parts of this task it is nearest to, and their sums."""
    width, entries = dim // len(books), len(books[0])
    count, total = np.zeros((len(books), entries), np.int64), np.zeros((len(books), entries, width), np.int64)
    for batch in _cut(batches):
        for k, (parts, which, _) in enumerate(_assigned(batch, books, pivots, dim)):
            count[k] += np.bincount(which, minlength=entries)
            np.add.at(total[k], which, parts)
    release()
    part, entry = np.nonzero(count)
    sums = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * width), pa.array(total[part, entry].reshape(-1)))
    yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), sums], ["part", "entry", "n", "sums"])


_HEX = np.array([f"{i:02x}" for i in range(256)])


def _codes(batches: Iterator[pa.RecordBatch], books: list[np.ndarray], pivots: list[np.ndarray], dim: int) -> Iterator[pa.RecordBatch]:
    for batch in _cut(batches):
        code, error = np.full(batch.num_rows, "", dtype=f"<U{2 * len(books)}"), np.zeros(batch.num_rows, np.int64)
        for _, which, square in _assigned(batch, books, pivots, dim):
            code = np.char.add(code, _HEX[which])
            error += square
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code.tolist(), pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])
    release()


def train_codebooks(units: DataFrame, books: list[np.ndarray], rounds: int, pivots_each: int = 4) -> tuple[list[np.ndarray], list[np.ndarray], DataFrame]:
    """Final codebooks, the fixed pivots, and the vectors with the distances to them (written once).

    A round is one pass over the vectors: counts and sums per entry are made inside tasks and
    added up by Spark; parts x entries rows reach the driver, however large the table.
    """
    width = books[0].shape[1]
    dim = width * len(books)
    pivots = [choose_pivots(b, pivots_each) for b in books]
    table = pin(units.mapInArrow(lambda b: _with_pivots(b, pivots, dim), f"{units.schema.simpleString()[7:-1]}, far array<float>"))
    for _ in range(rounds):
        now = list(books)
        partial = table.mapInArrow(lambda b: _sums(b, now, pivots, dim), "part int, entry int, n long, sums array<long>")
        rows = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[j]) for j in range(width)]).alias("sums")).collect()
        books = [b.copy() for b in books]
        for r in rows:
            books[r["part"]][r["entry"]] = np.array(r["sums"], np.int64) // r["n"]
    return books, pivots, table


def encode_vectors(
    vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, pivots_each: int = 4,
    id_col: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> DataFrame:
    """Code of every vector: the nearest entry of each of its parts.

    Returns one row per kept row: vec_id, label, code (two hex digits a part), error (squared
    distances summed over the parts), label_error (error summed over equal labels, nulls
    together) and codebooks_sha256. Components become floor(scale * x). Each codebook starts
    with the parts of the `entries` smallest ids (fewer ids: fewer entries) and goes through
    `rounds` of assignment and floored means; an entry without parts stays as it is.

    Rows whose vector is null or holds null or non-finite components are left out. So are
    vectors that cannot be cut or measured alike: those of another length than the vector of the
    smallest id has whose length is a multiple of `parts` and not 0, and those with a component of 4096 or
    more in size (their squared distances would not fit a long at any length). Null ids are encoded and come
    last in the order; of rows with one id the smallest vector starts the codebook, and all
    are encoded. An empty table gives an empty one. Other columns are not read.

    Distances of the parts to a few fixed pivots, chosen from the first entries, are computed
    once and written; in each round they bound the distances to the entries, so that few of
    the exact integer distances are evaluated (LAESA).
    """
    kind, named = vectors.schema[id_col].dataType.simpleString(), vectors.schema[label].dataType.simpleString()
    source = vectors.select(F.col(id_col).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vec"))
    units = source.mapInArrow(lambda b: _scaled(b, scale), f"vec_id {kind}, label {named}, units array<int>")
    whole = units.filter((F.size("units") > 0) & (F.size("units") % parts == 0))
    order = [F.col("vec_id").asc_nulls_last(), "units"]
    lead = whole.orderBy(*order).limit(1).collect()
    dim = len(lead[0]["units"]) if lead else parts
    same = whole.filter(F.size("units") == dim)
    few = same.select("vec_id", "units").mapInArrow(lambda b: _first(b, entries), f"vec_id {kind}, units array<int>")
    start = few.groupBy("vec_id").agg(F.min("units").alias("units")).orderBy(*order).limit(entries).collect()
    if start:
        width = dim // parts
        first = np.array([r["units"] for r in start], np.int64)
        books, pivots, table = train_codebooks(same, [first[:, k * width : (k + 1) * width] for k in range(parts)], rounds, pivots_each)
        digest = hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()
        coded = pin(table.mapInArrow(lambda b: _codes(b, books, pivots, dim), f"vec_id {kind}, label {named}, code string, error long"))
    else:
        digest = hashlib.sha256(b"").hexdigest()
        coded = same.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    totals = pin(coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error")))
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of_label"))).select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
