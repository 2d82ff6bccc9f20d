"""8-bit TIFF files of any size, read by strips and tiles through byte ranges (A3).

A header gives the segments of a file: strips or tiles, and of uncompressed ones pieces of
bounded size. Segments are rows of a table (or partitions of the `tiff_strips` data source),
so one file is decoded by many tasks and none of them holds a frame.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PIECE = 4 << 20  # bytes of an uncompressed strip that are read at a time
UNREADABLE = "unreadable raster"

SEGMENTS = (
    "path string, height int, width int, channels int, plane int, r0 int, c0 int, rows int, cols int, stored int, "
    "offset long, bytes long, code int, predictor int, inverted boolean, error string"
)
PIXELS = "path string, height int, width int, r int, c int, ch string, v int, error string"
_PIXEL_TYPES = pa.schema([("path", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("r", pa.int32()), ("c", pa.int32()), ("ch", pa.string()), ("v", pa.int32()), ("error", pa.string())])
# Fixed values of the file format: struct codes and sizes of the field types, and the codings that are read.
FIELD_TYPES = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4), 16: ("Q", 8)}
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773


class Unreadable(ValueError):
    """A raster that is damaged or coded in a way that is not read."""


def open_file(path: str):
    """Random-access file of a local path or of any URI that Arrow's file systems know."""
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    if "://" in path:
        system, inner = fs.FileSystem.from_uri(path)
        return system.open_input_file(inner)
    return fs.LocalFileSystem().open_input_file(path)


def _read(f, offset: int, size: int) -> bytes:
    f.seek(offset)
    data = f.read(size)
    if len(data) != size:
        raise Unreadable(UNREADABLE)
    return data


def _tags(f) -> dict[int, list[int]]:
    """Integer fields of the first directory, of either byte order and of classic or 64-bit files."""
    head = _read(f, 0, 8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack(order + "H", head[2:4])[0] if order else 0
    if version == 42:
        at, many, entry, slot = struct.unpack(order + "I", head[4:])[0], "H", "HHI", 4
    elif version == 43:
        at, many, entry, slot = struct.unpack(order + "Q", _read(f, 8, 8))[0], "Q", "HHQ", 8
    else:
        raise Unreadable(UNREADABLE)
    size = struct.calcsize(order + many)
    n = struct.unpack(order + many, _read(f, at, size))[0]
    head_size = struct.calcsize(order + entry)
    if n > 4096:
        raise Unreadable(UNREADABLE)
    body = _read(f, at + size, n * (head_size + slot))
    out: dict[int, list[int]] = {}
    for k in range(n):
        own = body[k * (head_size + slot) : (k + 1) * (head_size + slot)]
        tag, kind, count = struct.unpack(order + entry, own[:head_size])
        if kind not in FIELD_TYPES:
            continue
        letter, each = FIELD_TYPES[kind]
        data = own[head_size:] if count * each <= slot else _read(f, struct.unpack(order + ("Q" if slot == 8 else "I"), own[head_size:])[0], count * each)
        out[tag] = list(struct.unpack(order + f"{count}{letter}", data[: count * each]))
    return out


def read_segments(path: str, piece: int = PIECE) -> list[dict]:
    """Segments of a file in order of its planes and rows; a file that cannot be read gives one with an error."""
    blank = {"path": path, **dict.fromkeys([x.split()[0] for x in SEGMENTS.split(", ")][1:])}
    try:
        with open_file(path) as f:
            tags = _tags(f)
        return [{**blank, **s} for s in _layout(tags, piece)]
    except Unreadable as e:
        return [{**blank, "error": str(e)}]
    except (OSError, struct.error, OverflowError, MemoryError, KeyError, IndexError, ZeroDivisionError):
        return [{**blank, "error": UNREADABLE}]


def _layout(tags: dict[int, list[int]], piece: int) -> Iterator[dict]:
    one = lambda tag, default: tags.get(tag, [default])[0]
    width, height, channels, planar = tags[256][0], tags[257][0], one(277, 1), one(284, 1)
    code, look, predictor = one(259, 1), one(262, 1), one(317, 1)
    if set(tags.get(258, [1])) != {8}:
        raise Unreadable("unsupported raster: not 8 bits a sample")
    if code not in (PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS) or predictor not in (1, 2) or look not in (0, 1, 2) or not 1 <= channels <= 4:
        raise Unreadable(f"unsupported raster: coding {code}, predictor {predictor}, photometric {look}, {channels} channels")
    if not 0 < width < 1 << 31 or not 0 < height < 1 << 31:
        raise Unreadable(UNREADABLE)
    if 322 in tags:
        tall, wide, offsets, sizes = tags[323][0], tags[322][0], tags[324], tags[325]
    else:
        tall, wide, offsets, sizes = min(one(278, height), height), width, tags[273], tags[279]
    down, across = -(-height // tall), -(-width // wide)
    planes = channels if planar == 2 else 1
    if len(offsets) != planes * down * across or len(sizes) != len(offsets):
        raise Unreadable(UNREADABLE)
    samples = 1 if planar == 2 else channels
    for k, (offset, size) in enumerate(zip(offsets, sizes)):
        plane, at = divmod(k, down * across)
        r0, c0 = at // across * tall, at % across * wide
        rows = min(tall, height - r0)
        base = {
            "height": height, "width": width, "channels": channels, "plane": plane if planar == 2 and channels > 1 else -1, "c0": c0, "cols": min(wide, width - c0),
            "stored": wide, "code": code, "predictor": predictor, "inverted": look == 0,
        }
        each = wide * samples
        step = max(1, piece // each) if code == PLAIN else rows
        for top in range(0, rows, step):
            many = min(step, rows - top)
            place = {"offset": offset + top * each, "bytes": max(0, min(many * each, size - top * each))} if code == PLAIN else {"offset": offset, "bytes": size}
            yield {**base, "r0": r0 + top, "rows": many, **place}


def _unpack_bits(data: bytes) -> bytes:
    out, k = bytearray(), 0
    while k < len(data):
        n = data[k]
        if n < 128:
            out += data[k + 1 : k + 2 + n]
            k += n + 2
        elif n > 128:
            out += data[k + 1 : k + 2] * (257 - n)
            k += 2
        else:
            k += 1
    return bytes(out)


def _unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest bit first; 256 starts anew, 257 ends."""
    out, table, bits, width, k, last = bytearray(), [], 0, 0, 0, None
    size, held = 9, 0
    table = [bytes([i]) for i in range(256)] + [b"", b""]
    while True:
        while held < size:
            if k >= len(data):
                return bytes(out)
            bits, held, k = (bits << 8 | data[k]) & 0xFFFFFF, held + 8, k + 1
        code = bits >> (held - size) & ((1 << size) - 1)
        held -= size
        if code == 257:
            return bytes(out)
        if code == 256:
            del table[258:]
            size, last = 9, None
            continue
        if code < len(table):
            word = table[code]
        elif last is not None and code == len(table):
            word = last + last[:1]
        else:
            raise Unreadable("damaged strip")
        out += word
        if last is not None and len(table) < 4096:
            table.append(last + word[:1])
            if len(table) >= (1 << size) - 1 and size < 12:
                size += 1
        last = word


def decode_segment(f, s: dict) -> np.ndarray:
    """Samples of a segment inside the frame, rows x cols x samples."""
    samples = 1 if s["plane"] >= 0 else s["channels"]
    data = _read(f, s["offset"], s["bytes"])
    if s["code"] in (DEFLATE, OLD_DEFLATE):
        data = zlib.decompress(data)
    elif s["code"] == PACKBITS:
        data = _unpack_bits(data)
    elif s["code"] == LZW:
        data = _unpack_lzw(data)
    need = s["rows"] * s["stored"] * samples
    if len(data) < need:
        raise Unreadable("damaged strip")
    a = np.frombuffer(data, np.uint8, need).reshape(s["rows"], s["stored"], samples)
    if s["predictor"] == 2:
        a = np.cumsum(a, axis=1, dtype=np.uint8)
    return (255 - a if s["inverted"] else a)[:, : s["cols"]]


def pixel_batches(segments: Iterator[dict], low: int = 0, high: int = 1 << 31) -> Iterator[pa.RecordBatch]:
    """Stored pixels of segments between two rows, zeros left out; a damaged segment is one row with its first row and an error."""
    f, path = None, None
    for s in segments:
        own = {"path": s["path"], "height": s["height"], "width": s["width"]}
        error, a = s["error"], None
        if not error:
            try:
                if s["path"] != path:
                    if f:
                        f.close()
                    f, path = open_file(s["path"]), s["path"]
                a = decode_segment(f, s)
            except (Unreadable, OSError, zlib.error, ValueError):
                error = "damaged strip"
        if error:
            yield pa.RecordBatch.from_pylist([{**own, "r": s["r0"], "error": error}], _PIXEL_TYPES)
            continue
        names = ["gray"] if s["channels"] == 1 else ["R", "G", "B", "ch3"][: s["channels"]]
        names = names if s["plane"] < 0 else [names[s["plane"]]]
        step = max(1, (1 << 18) // max(1, a.shape[1] * a.shape[2]))
        for top in range(max(0, low - s["r0"]), min(s["rows"], high - s["r0"]), step):
            part = a[top : min(top + step, high - s["r0"])]
            r, c, k = np.nonzero(part)
            if len(r):
                same = lambda v, t: pa.repeat(pa.scalar(v, t), len(r))
                yield pa.RecordBatch.from_arrays([
                    same(own["path"], pa.string()), same(own["height"], pa.int32()), same(own["width"], pa.int32()),
                    pa.array((r + s["r0"] + top).astype(np.int32)), pa.array((c + s["c0"]).astype(np.int32)),
                    pa.array(names).take(pa.array(k)), pa.array(part[r, c, k].astype(np.int32)), pa.nulls(len(r), pa.string()),
                ], schema=_PIXEL_TYPES)
    if f:
        f.close()


def segments_of(paths: DataFrame, piece: int = PIECE) -> DataFrame:
    """Segments of the files in column `path`: headers are read by the tasks, no list passes the driver."""

    def headers(batches):
        schema = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}[t]) for n, t in (x.split() for x in SEGMENTS.split(", "))])
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = read_segments(path, piece)
                for k in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_pylist(rows[k : k + 10_000], schema)

    return paths.select("path").mapInArrow(headers, SEGMENTS)


def pixels_of(segments: DataFrame) -> DataFrame:
    """Stored pixels of segments, dealt over tasks by file and row, so that a large file is read by many."""

    def decode(batches):
        for batch in batches:
            yield from pixel_batches(batch.to_pylist())

    return segments.repartition("path", "plane", "r0", "c0").mapInArrow(decode, PIXELS)


class Strips(InputPartition):
    def __init__(self, segments: list[dict]):
        super().__init__(len(segments))
        self.segments = segments


class TiffStrips(DataSource):
    """Data source `tiff_strips`: pixels of all TIFF files below a path; partitions are strips or tiles.

    Options: partitionBytes (decoded bytes of a partition, 32 MiB by default, one segment at
    least), rows ("first:end", to read a band of every file). The headers are read where the
    query is planned; for very many files use decode_raster, which reads them in tasks.
    """

    @classmethod
    def name(cls) -> str:
        return "tiff_strips"

    def schema(self) -> str:
        return PIXELS

    def reader(self, schema):
        return TiffReader(dict(self.options))


class TiffReader(DataSourceReader):
    def __init__(self, options: dict):
        options = {k.lower(): v for k, v in options.items()}
        self.path, self.most = options["path"], int(options.get("partitionbytes", 32 << 20))
        low, _, high = options.get("rows", ":").partition(":")
        self.low, self.high = int(low or 0), int(high or 1 << 31)

    def partitions(self) -> list[Strips]:
        path = self.path
        if path.startswith("file:"):
            path = "/" + path[5:].lstrip("/")
        system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        scheme = path[: path.index("://") + 3] if "://" in path else ""
        info = system.get_file_info(inner)
        files = [info] if info.is_file else system.get_file_info(fs.FileSelector(inner, recursive=True))
        out, now, size = [], [], 0
        for file in sorted((x for x in files if x.is_file and x.path.lower().endswith((".tif", ".tiff"))), key=lambda x: x.path):
            for s in read_segments(scheme + file.path):
                if not s["error"] and (s["r0"] >= self.high or s["r0"] + s["rows"] <= self.low):
                    continue
                own = 0 if s["error"] else s["rows"] * s["stored"] * (1 if s["plane"] >= 0 else s["channels"])
                if now and size + own > self.most:
                    out.append(Strips(now))
                    now, size = [], 0
                now.append(s)
                size += own
        return [*out, Strips(now)] if now else out or [Strips([])]

    def read(self, partition: Strips):
        return pixel_batches(iter(partition.segments), self.low, self.high)


def raster_sizes(paths: DataFrame) -> DataFrame:
    """One row per file: path, height, width, channels, error; only headers are read."""
    first = F.min_by(F.struct("height", "width", "channels", "error"), F.struct("plane", "r0", "c0"))
    return segments_of(paths, 1 << 62).groupBy("path").agg(first.alias("s")).select("path", "s.*")
