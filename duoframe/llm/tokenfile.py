"""Token files: one zstandard frame per document, a shared dictionary, and an offset index.

A token file is a folder of three Parquet tables:

    dictionary  one row: sha256, width (bytes of an id), end_id and the dictionary itself, trained on serialized ids
    blocks      one row per block of documents in ascending id order: part, block, first_id, last_id,
                doc_ids, n_tokens, offsets (where each frame begins, and the end), first_token
                (ids of the part before the block), dictionary (its sha256) and frames
    parts       one row per part: its documents, its ids, and the ids of all parts before it

One document is read by its block's id range, which Parquet's statistics prune, and its
frame's offsets; nothing else is decompressed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .textbytes import slices
from .tokens import encoder

_SLICE = 4 << 20


def _serialized(ids: np.ndarray, end_id: int, width: int) -> bytes:
    return np.append(ids, np.uint32(end_id)).astype(f"<u{width}").tobytes()


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, text: str, width: int, train_docs: int = 4000, train_chunks: int = 4096, dictionary_bytes: int = 1 << 16) -> bytes:
    """A zstandard dictionary from a bounded sample of serialized ids.

    About train_docs documents, chosen by the hash of their whole text, are encoded and cut
    into pieces of 2 KB; the train_chunks pieces with the smallest hashes (8 MB at most) come
    to the driver. Too few pieces to train on become the dictionary's raw content.
    """
    n = docs.count()
    hashed = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    if n > train_docs:
        hashed = hashed.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < int(1_000_003 * train_docs / n) + 1)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in slices(batches, "text", _SLICE):
            ids, offsets = encode(batch.column("text"))
            whole = [_serialized(ids[a:b], end_id, width) for a, b in zip(offsets[:-1], offsets[1:])]
            cut = [w[i : i + 2048] for w in whole for i in range(0, len(w), 2048)]
            yield pa.RecordBatch.from_arrays([pa.array(cut, pa.binary())], ["chunk"])

    got = hashed.mapInArrow(chunks, "chunk binary").select("chunk", F.xxhash64("chunk").alias("h")).orderBy("h", "chunk").limit(train_chunks).collect()
    samples = [bytes(r["chunk"]) for r in got]
    try:
        return zstandard.train_dictionary(dictionary_bytes, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:dictionary_bytes]


def write_token_file(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text: str = "text", width: int = 2, level: int = 3, block_bytes: int = 1 << 20, **training) -> None:
    """Encode every whole text, append end_id, and write the token file in ascending id order.

    Null counts as an empty text. Null ids come first and are kept, rows with equal ids stay
    next to each other, an empty table gives an empty token file; other columns are not read.
    `width` is the bytes of one id on disk (2 for vocabularies of up to 65,536 ids). Ranges of
    ids are balanced by rows and split inside repeated ids, so no id makes a large task.
    """
    spark = docs.sparkSession
    shared = train_dictionary(docs, tokenizer, end_id, text, width, **training)
    name = hashlib.sha256(shared).hexdigest()
    spark.createDataFrame([(name, width, end_id, bytearray(shared))], "sha256 string, width int, end_id long, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer), TaskContext.get().partitionId()
        press = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(shared)) if shared else zstandard.ZstdCompressor(level=level)
        block, before = 0, 0
        doc_ids, counts, frames = [], [], []

        def flush() -> pa.RecordBatch:
            row = {
                "part": [part], "block": [block], "first_id": [doc_ids[0]], "last_id": [doc_ids[-1]], "doc_ids": [doc_ids], "n_tokens": [counts],
                "offsets": [np.concatenate([[0], np.cumsum([len(f) for f in frames])]).tolist()], "first_token": [before], "dictionary": [name], "frames": [b"".join(frames)],
            }
            return pa.RecordBatch.from_arrays([pa.array(row[f.name], f.type) for f in arrow], schema=arrow)

        for batch in slices(batches, "text", _SLICE):
            ids, offsets = encode(batch.column("text"))
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                doc_ids.append(doc)
                counts.append(b - a + 1)
                frames.append(press.compress(_serialized(ids[a:b], end_id, width)))
                if sum(map(len, frames[-64:])) >= block_bytes or len(frames) % 64 == 0 and sum(map(len, frames)) >= block_bytes:
                    yield flush()
                    block, before = block + 1, before + sum(counts)
                    doc_ids, counts, frames = [], [], []
        if doc_ids:
            yield flush()

    kind = docs.schema[id_col].dataType.simpleString()
    schema = (
        f"part int, block int, first_id {kind}, last_id {kind}, doc_ids array<{kind}>, n_tokens array<long>, "
        "offsets array<long>, first_token long, dictionary string, frames binary"
    )
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    ranged = (
        docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
        .repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row").drop("row")
    )
    ranged.mapInArrow(blocks, schema).write.option("compression", "none").parquet(f"{path}/blocks")
    parts = spark.read.parquet(f"{path}/blocks").select(
        "part", F.size("n_tokens").alias("docs"), F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("tokens"))
    parts = parts.groupBy("part").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    (parts.withColumn("before", F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens"))  # one row per part
     .coalesce(1).write.parquet(f"{path}/parts"))


@lru_cache(maxsize=4)
def _presser(name: str, shared: bytes) -> zstandard.ZstdDecompressor:
    if hashlib.sha256(shared).hexdigest() != name:
        raise ValueError("the dictionary does not match its hash")
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(shared)) if shared else zstandard.ZstdDecompressor()


def read_token_file(spark: SparkSession, path: str, only: list | None = None) -> DataFrame:
    """Documents of a token file: doc_id, start (ids of all documents before it), n_tokens
    (with the end id), ids (little-endian unsigned 32-bit integers, as binary).

    With `only`, a short list of ids, just the blocks that may hold them are read and just
    their frames decompressed. A block whose dictionary hash is not the file's is an error.
    """
    head = spark.read.parquet(f"{path}/dictionary").first()
    name, width, shared = head["sha256"], head["width"], bytes(head["dictionary"])
    stored = spark.read.parquet(f"{path}/blocks")
    kind = stored.schema["first_id"].dataType.simpleString()
    if only is not None:
        wanted = [F.col("first_id").isNull()] * (None in only) + [(F.col("first_id") <= x) & (F.col("last_id") >= x) for x in only if x is not None]
        hit = F.lit(False)
        for w in wanted:
            hit = hit | w
        stored = stored.filter(hit)
    chosen = None if only is None else frozenset(only)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = _presser(name, shared)
        for batch in batches:
            for k in range(batch.num_rows):
                b = {c: batch.column(c)[k] for c in batch.schema.names}
                if b["dictionary"].as_py() != name:
                    raise ValueError("a block was written with another dictionary")
                ids, counts = b["doc_ids"].values, b["n_tokens"].values.to_numpy()
                at, frames = b["offsets"].values.to_pylist(), memoryview(b["frames"].as_buffer())
                starts = b["first_token"].as_py() + b["before"].as_py() + np.cumsum(counts) - counts
                rows = np.arange(len(counts)) if chosen is None else np.array([i for i, x in enumerate(ids.to_pylist()) if x in chosen], np.int64)
                for i in range(0, len(rows), 256):
                    own = rows[i : i + 256]
                    plain = [np.frombuffer(press.decompress(frames[at[j] : at[j + 1]]), f"<u{width}").astype("<u4").tobytes() for j in own]
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(own)), pa.array(starts[own]), pa.array(counts[own]), pa.array(plain, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    parts = spark.read.parquet(f"{path}/parts").select("part", "before")  # one small row per part of the file
    return stored.join(parts, "part").select("doc_ids", "n_tokens", "offsets", "first_token", "dictionary", "frames", "before").mapInArrow(
        decode, f"doc_id {kind}, start long, n_tokens long, ids binary")
