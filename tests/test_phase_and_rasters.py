"""Phase correlation in shuffled transforms, and rasters read by strips and tiles."""

import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from duoframe.operators.phase import phase_shift
from duoframe.operators.register import prealign_translation
from duoframe.sources import catalog as C
from duoframe.sources import rasters as R
from duoframe.sources import tiff as T


# -- phase correlation

def moved_pair(h, w, dy, dx, seed):
    r = np.random.default_rng(seed)
    post = r.random((h, w)) * 255 * (r.random((h, w)) < 0.5)
    return {"post": post, "pre": np.roll(post, (dy, dx), (0, 1)) + r.random((h, w)) * 20}


def plain_shift(post, pre):
    """The same estimate with whole frames in memory."""
    cross = np.conj(np.fft.fft2(post)) * np.fft.fft2(pre)
    size = np.abs(cross)
    surface = np.fft.ifft2(np.where(size > 1e-9, cross / np.maximum(size, 1e-9), 0)).real
    h, w = surface.shape
    py, px = np.unravel_index(surface.argmax(), surface.shape)
    cells = [(max(surface[(py + i) % h, (px + j) % w], 0), py + i, px + j) for i in range(-2, 3) for j in range(-2, 3)]
    total = sum(c[0] for c in cells)
    y, x = (sum(c[0] * c[k] for c in cells) / total for k in (1, 2))
    return x - w if x > w / 2 else x, y - h if y > h / 2 else y, total


def as_pixels(spark, pairs):
    parts = []
    for k, frames in pairs.items():
        for kind, a in frames.items():
            r, c = np.nonzero(a)
            parts.append(pd.DataFrame({"k": k, "kind": kind, "r": r, "c": c, "v": a[r, c]}))
    return spark.createDataFrame(pd.concat(parts), "k long, kind string, r int, c int, v double")


@pytest.mark.parametrize("cells", [1 << 20, 700, 60])
def test_phase_shift_in_parts_equals_whole_frames(spark, cells):
    """With 700 cells a task a frame of 11,790 is 18 bands; with 60 every row and column stands alone."""
    pairs = {0: moved_pair(90, 131, 5, -7, 1), 1: moved_pair(90, 131, -44, 64, 2)}
    got = phase_shift(as_pixels(spark, pairs), ["k"], (90, 131), cells).toPandas().set_index("k")
    for k, f in pairs.items():
        assert np.allclose(got.loc[k, ["dx", "dy", "response"]].astype(float), plain_shift(f["post"], f["pre"]), atol=1e-4)


def test_phase_shift_of_pairs_of_several_sizes_and_of_nothing(spark):
    pairs = {0: moved_pair(40, 33, 3, 4, 3), 1: moved_pair(21, 64, -2, 9, 4), 2: {"pre": np.ones((5, 5))}}
    sizes = spark.createDataFrame([(0, 40, 33), (1, 21, 64), (2, 5, 5)], "k long, height int, width int")
    got = phase_shift(as_pixels(spark, pairs), ["k"], sizes, 200).toPandas().set_index("k")
    assert np.allclose(got.loc[[0, 1], ["dx", "dy"]], [[4, 3], [9, -2]], atol=0.1)
    assert list(got.loc[2, ["dx", "dy", "response"]]) == [0, 0, 0]
    assert phase_shift(as_pixels(spark, pairs).filter("false"), ["k"], sizes).count() == 0


@pytest.mark.parametrize("cells", [1 << 20, 150])
def test_a_plain_square_has_full_response(spark, cells):
    """The transform of a square of two thirds of the frame vanishes at every third row and column; frames of one value tell no shift."""
    post = np.zeros((48, 48))
    post[8:40, 8:40] = 255.0
    pairs = {0: {"post": post, "pre": np.roll(post, (-3, 4), (0, 1))}, 1: {"post": np.ones((48, 48)), "pre": np.ones((48, 48))}}
    got = phase_shift(as_pixels(spark, pairs), ["k"], (48, 48), cells).toPandas().set_index("k")
    assert np.allclose(got.loc[0, ["dx", "dy", "response"]].astype(float), [4, -3, 1], atol=1e-4)
    assert got.loc[1, "response"] < 0.1


def test_prealignment_moves_the_frame_back(spark):
    r = np.random.default_rng(5)
    post = np.zeros((80, 100))
    post[20:50, 30:70] = r.integers(20, 250, (30, 40))
    pairs = {0: {"post": post, "pre": np.roll(post, (-6, 9), (0, 1))}}
    back = prealign_translation(as_pixels(spark, pairs), ["k"], (80, 100), 500).toPandas()
    got = np.zeros((80, 100))
    got[back["r"], back["c"]] = back["v"]
    assert np.abs(got - post).max() < 8  # the centroid of the peak is off by hundredths of a cell


# -- rasters

def tiff(path, a, order="<", big=False, rows=None, tile=None, code=1, planar=1, predictor=1):
    """Gray or RGB file, in strips of `rows` or tiles, with one of the codings."""
    a = a.astype(np.uint8)
    h, w = a.shape[:2]
    k = 1 if a.ndim == 2 else a.shape[2]
    a = a.reshape(h, w, k)
    planes = [a[:, :, i : i + 1] for i in range(k)] if planar == 2 else [a]
    boxes = []
    for plane in planes:
        if tile:
            padded = np.pad(plane, ((0, -h % tile), (0, -w % tile), (0, 0)))
            boxes += [padded[i : i + tile, j : j + tile] for i in range(0, h, tile) for j in range(0, w, tile)]
        else:
            boxes += [plane[i : i + (rows or h)] for i in range(0, h, rows or h)]

    def coded(x):
        if predictor == 2:
            x = np.concatenate([x[:, :1], np.diff(x, axis=1)], axis=1)
        b = x.tobytes()
        if code == 8:
            return zlib.compress(b)
        if code == 32773:  # literal runs of up to 128 bytes, and one repeat run at the end of a constant tail
            out = b"".join(bytes([len(b[i : i + 128]) - 1]) + b[i : i + 128] for i in range(0, len(b) - 3, 128) if i + 128 <= len(b) - 3)
            rest = b[len(b) - 3 - (len(b) - 3) % 128 :] if len(b) > 3 else b
            for v in rest:
                out += bytes([0, v])
            return out + b"\x80"
        return b

    data = [coded(x) for x in boxes]
    size = "Q" if big else "I"
    head = struct.pack(order + "2sHHHQ", b"II" if order == "<" else b"MM", 43, 8, 0, 16) if big else struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 8)
    tags = {256: ("I", [w]), 257: ("I", [h]), 258: ("H", [8] * k), 259: ("H", [code]), 262: ("H", [2 if k > 2 else 1]), 277: ("H", [k]), 284: ("H", [planar]), 317: ("H", [predictor])}
    if tile:
        tags |= {322: ("I", [tile]), 323: ("I", [tile]), 324: (size, [0] * len(data)), 325: ("I", [len(x) for x in data])}
    else:
        tags |= {273: (size, [0] * len(data)), 278: ("I", [rows or h]), 279: ("I", [len(x) for x in data])}
    slot = 8 if big else 4
    at = len(head) + (8 if big else 2) + len(tags) * (20 if big else 12) + slot
    extra = sum(len(v) * struct.calcsize(order + t) for t, v in tags.values() if len(v) * struct.calcsize(order + t) > slot)
    start = np.cumsum([at + extra] + [len(x) for x in data]).tolist()
    tags[324 if tile else 273] = (size, start[:-1])
    codes = {"H": 3, "I": 4, "Q": 16}
    ifd, more = b"", b""
    for tag, (t, v) in sorted(tags.items()):
        body = struct.pack(order + f"{len(v)}{t}", *v)
        ifd += struct.pack(order + ("HHQ" if big else "HHI"), tag, codes[t], len(v))
        if len(body) > slot:
            ifd += struct.pack(order + size, at + len(more))
            more += body
        else:
            ifd += body.ljust(slot, b"\0")
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(head + struct.pack(order + ("Q" if big else "H"), len(tags)) + ifd + b"\0" * slot + more + b"".join(data))


CASES = [
    {}, {"rows": 7}, {"rows": 7, "order": ">"}, {"rows": 5, "big": True}, {"tile": 16}, {"tile": 16, "code": 8, "predictor": 2}, {"rows": 9, "code": 8},
    {"rows": 4, "code": 32773}, {"rows": 6, "planar": 2}, {"tile": 32, "planar": 2, "code": 8, "order": ">", "big": True},
]


def test_layouts_and_codings(spark, tmp_path):
    r = np.random.default_rng(6)
    want = {}
    for i, case in enumerate(CASES):
        for k in (1, 3):
            a = r.integers(0, 4, (41, 53, k)) * 60
            want[f"{i}-{k}.tif"] = a
            tiff(tmp_path / f"{i}-{k}.tif", a if k > 1 else a[:, :, 0], **case)
    px = R.read_raster(spark, str(tmp_path), piece=400).toPandas()  # plain strips are cut
    assert px["error"].isna().all()
    for name, a in want.items():
        own = px[px["path"].str.endswith("/" + name)]
        got = np.zeros_like(a)
        slot = {"gray": 0, "R": 0, "G": 1, "B": 2}
        got[own["r"], own["c"], own["ch"].map(slot)] = own["v"]
        assert np.array_equal(got, a) and len(own) == (a > 0).sum(), name
    frames = {x["path"].rsplit("/", 1)[1]: (x["height"], x["width"], x["channels"], x["error"]) for x in R.raster_frames(spark, str(tmp_path)).collect()}
    assert frames == {n: (41, 53, a.shape[2], None) for n, a in want.items()}


def test_strips_equal_the_image_source(spark, tmp_path):
    for i in range(3):
        tiff(tmp_path / f"{i}.tif", np.random.default_rng(i).integers(0, 256, (60, 45, 3)), rows=8)
    cells = ["path", "height", "width", "r", "c", "ch", "v"]
    one, other = R.decode_raster(spark, str(tmp_path)).select(cells), R.decode_images(spark, str(tmp_path)).select(cells)
    assert one.count() == other.count() > 0 and one.exceptAll(other).count() == other.exceptAll(one).count() == 0


def test_lzw_of_known_codes():
    """The example of the format's specification: 7 7 7 8 8 7 7 6 6."""
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    data = bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))
    assert list(T._unpack_lzw(data)) == [7, 7, 7, 8, 8, 7, 7, 6, 6]


def lzw(data):
    """Plain encoder, to test the growing code width."""
    out, size, table, word = [(256, 9)], 9, {bytes([i]): i for i in range(256)}, b""
    n = 258
    for b in data:
        if word + bytes([b]) in table:
            word += bytes([b])
            continue
        out.append((table[word], size))
        table[word + bytes([b])] = n
        n += 1
        word = bytes([b])
        if n == 4094:
            out += [(table[word], size), (256, size)]
            size, table, n, word = 9, {bytes([i]): i for i in range(256)}, 258, b""
        elif n >= 1 << size:
            size += 1
    if word:
        out.append((table[word], size))
    out.append((257, size))
    bits = "".join(f"{c:0{w}b}" for c, w in out)
    return bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))


def test_lzw_round_trip():
    r = np.random.default_rng(7)
    for high in (2, 20, 256):
        data = r.integers(0, high, 20_000).astype(np.uint8).tobytes()
        assert T._unpack_lzw(lzw(data)) == data


def test_damage_is_local(spark, tmp_path):
    a = np.full((40, 30), 9)
    tiff(tmp_path / "cut.tif", a, rows=10)
    (tmp_path / "cut.tif").write_bytes((tmp_path / "cut.tif").read_bytes()[:-350])
    tiff(tmp_path / "bits.tif", a, rows=10, code=8)
    raw = bytearray((tmp_path / "bits.tif").read_bytes())
    raw[-8:] = b"\xff" * 8
    (tmp_path / "bits.tif").write_bytes(raw)
    (tmp_path / "bad.tif").write_bytes(b"II*\0" + b"\1" * 40)
    tiff(tmp_path / "jpeg.tif", a, code=7)
    px = R.read_raster(spark, str(tmp_path))
    bad = {(x["path"].rsplit("/", 1)[1], x["r"]) for x in px.filter("error is not null").collect()}
    assert bad == {("cut.tif", 20), ("cut.tif", 30), ("bits.tif", 30), ("bad.tif", None), ("jpeg.tif", None)}
    good = {(x["path"].rsplit("/", 1)[1], x["n"]) for x in px.filter("error is null").groupBy("path").agg(F.count("*").alias("n")).collect()}
    assert good == {("cut.tif", 600), ("bits.tif", 900)}
    assert {x["path"].rsplit("/", 1)[1] for x in R.raster_frames(spark, str(tmp_path)).filter("error is not null").collect()} == {"bad.tif", "jpeg.tif"}


def test_a_full_size_frame_is_read_in_parts(spark, tmp_path):
    """30,000 x 25,000 RGB: only the header and two of the strips are stored, the rest of the file is a hole."""
    h, w, rows = 30_000, 25_000, 40
    n = h // rows
    at = 8 + 2 + 12 * 9 + 4
    start = at + 6 + 8 * n
    strips = [start + i * rows * w * 3 for i in range(n)]
    head = struct.pack("<2sHIH", b"II", 42, 8, 9)
    for tag, t, many, value in ((256, 4, 1, w), (257, 4, 1, h), (258, 3, 3, at), (259, 3, 1, 1), (262, 3, 1, 2), (273, 4, n, at + 6), (277, 3, 1, 3), (278, 4, 1, rows), (279, 4, n, at + 6 + 4 * n)):
        head += struct.pack("<HHII", tag, t, many, value)
    with (tmp_path / "full.tif").open("wb") as f:
        f.write(head + struct.pack("<I3H", 0, 8, 8, 8) + struct.pack(f"<{n}I", *strips) + struct.pack(f"<{n}I", *[rows * w * 3] * n))
        for i in (0, 511):
            f.seek(strips[i] + 3 * 17)
            f.write(b"\x05\x06\x07")
        f.truncate(strips[-1] + rows * w * 3)
    spark.dataSource.register(T.TiffStrips)
    whole = spark.read.format("tiff_strips").option("partitionBytes", 32 << 20).load(str(tmp_path))
    assert whole.rdd.getNumPartitions() >= 60
    near = spark.read.format("tiff_strips").option("rows", "20400:20480").load(str(tmp_path))
    assert {(x["r"], x["c"], x["ch"], x["v"]) for x in near.collect()} == {(20440, 17, "R", 5), (20440, 17, "G", 6), (20440, 17, "B", 7)}


def test_from_files_to_pixels_and_frames(spark, tmp_path):
    a = np.zeros((40, 50, 3), np.uint8)
    a[5:30, 8:40, 1] = np.random.default_rng(1).integers(1, 255, (25, 32))
    for n in ("s/s_pre_DAPI.tif", "s/s_post_DAPI.tif", "q/q_pre_DAPI.tif", "q/q_post_DAPI.tif"):
        tiff(tmp_path / n, a, rows=8)
    (tmp_path / "q/q_post_DAPI.tif").write_bytes(b"no raster")
    pairs = C.group_pairs(C.classify_files(C.list_raw_files(spark, str(tmp_path))))
    px, frames = C.load_pairs_and_frames(spark, pairs.select("sample", "dye").distinct(), pairs)
    got = {(x["sample"], x["kind"]): (x["height"], x["width"], x["error"]) for x in frames.collect()}
    assert got[("s", "pre")] == got[("s", "post")] == got[("q", "pre")] == (40, 50, None) and got[("q", "post")][2]
    assert px.filter("sample = 's' and kind = 'post'").agg(F.sum("v")).first()[0] == float(a.sum())
