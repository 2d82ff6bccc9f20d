"""Scale-space features of frames of any size: octaves on haloed tiles, orientation, descriptors."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import pin, size_columns
from .diagnostics import top_rows
from .filters import _along, gaussian_weights
from .tiles import tile_rows

PER_OCTAVE = 3  # scales of an octave in which extrema are sought
BASE_SIGMA = 1.6  # blur of the first scale; every octave doubles it
EDGE = 10.0  # largest ratio of the two principal curvatures of a feature
TURNS = 36  # bins of the orientation histogram
CELLS, BINS, SAMPLES = 4, 8, 16  # of a descriptor: cells a side, orientations a cell, samples a side
STEP = 0.75  # distance of two samples, in units of the feature's blur: a cell spans 3 of them
SIGMAS = [BASE_SIGMA * 2 ** (k / PER_OCTAVE) for k in range(PER_OCTAVE + 3)]
# blur of the last level, and the corner of a turned descriptor of the largest scale
HALO = int(4 * SIGMAS[-1] + 0.5) + int(np.ceil(SAMPLES / 2 * STEP * np.sqrt(2) * SIGMAS[PER_OCTAVE + 1])) + 2


def _blur(a: np.ndarray, sigma: float) -> np.ndarray:
    w = gaussian_weights(sigma)
    return _along(_along(a, w, 0), w, 1)


def _extrema(dog: np.ndarray, level: int, inside: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of a level that exceed all 26 neighbours in space and scale."""
    v = dog[level]
    core = np.abs(v) > least
    core &= inside
    core[:HALO], core[-HALO:], core[:, :HALO], core[:, -HALO:] = False, False, False, False
    r, c = np.nonzero(core)
    high, low = np.ones(len(r), bool), np.ones(len(r), bool)
    for k in (-1, 0, 1):
        for i in (-1, 0, 1):
            for j in (-1, 0, 1):
                if (k, i, j) != (0, 0, 0):
                    near = dog[level + k, r + i, c + j]
                    high &= v[r, c] > near
                    low &= v[r, c] < near
    keep = high | low
    return r[keep], c[keep]


def _refined(dog: np.ndarray, level: int, r: np.ndarray, c: np.ndarray, least: float) -> tuple[np.ndarray, ...]:
    """Peak of the quadratic through the neighbours: which stay, offsets in scale, row and column, and the value there."""
    at = lambda k, i, j: dog[level + k, r + i, c + j]
    g = np.stack([at(1, 0, 0) - at(-1, 0, 0), at(0, 1, 0) - at(0, -1, 0), at(0, 0, 1) - at(0, 0, -1)], axis=1) / 2
    v = at(0, 0, 0)
    ss, rr, cc = (at(*d) + at(*[-x for x in d]) - 2 * v for d in ((1, 0, 0), (0, 1, 0), (0, 0, 1)))
    cross = lambda a, b: (at(*np.add(a, b)) - at(*np.subtract(a, b)) - at(*np.subtract(b, a)) + at(*-np.add(a, b))) / 4
    s, y, x = (1, 0, 0), (0, 1, 0), (0, 0, 1)
    sr, sc, rc = cross(s, y), cross(s, x), cross(y, x)
    h = np.stack([np.stack([ss, sr, sc], 1), np.stack([sr, rr, rc], 1), np.stack([sc, rc, cc], 1)], axis=1)
    flat = np.abs(np.linalg.det(h)) < 1e-9 if len(v) else np.zeros(0, bool)
    h[flat] = np.eye(3)
    move = -np.linalg.solve(h, g[:, :, None])[:, :, 0] if len(v) else g
    move[flat] = 0
    value = v + (g * move).sum(axis=1) / 2
    trace, det = rr + cc, rr * cc - rc * rc
    keep = (np.abs(move).max(axis=1, initial=0) <= 1) & (np.abs(value) > least) & (det > 0) & (trace * trace * EDGE < (EDGE + 1) ** 2 * det)
    return keep, move, value


def _orientations(gy: np.ndarray, gx: np.ndarray, r: np.ndarray, c: np.ndarray, sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """Feature and direction (radians) of every peak of its gradient histogram that reaches 0.8 of the highest."""
    reach = int(round(4.5 * sigma))
    dy, dx = np.mgrid[-reach : reach + 1, -reach : reach + 1]
    weight = np.exp(-(dy**2 + dx**2) / (2 * (1.5 * sigma) ** 2))
    rows, cols = r[:, None, None] + dy, c[:, None, None] + dx
    y, x = gy[rows, cols], gx[rows, cols]
    turn = np.floor(np.mod(np.arctan2(y, x), 2 * np.pi) / (2 * np.pi) * TURNS).astype(int) % TURNS
    slot = np.arange(len(r))[:, None, None] * TURNS + turn
    hist = np.bincount(slot.ravel(), (np.hypot(y, x) * weight).ravel(), TURNS * len(r)).reshape(len(r), TURNS)
    for _ in range(2):
        hist = (np.roll(hist, 1, 1) + hist + np.roll(hist, -1, 1)) / 3
    before, after = np.roll(hist, 1, 1), np.roll(hist, -1, 1)
    peak = (hist > before) & (hist >= after) & (hist >= 0.8 * hist.max(axis=1, initial=0, keepdims=True))
    n, k = np.nonzero(peak)
    a, b, d = before[n, k], hist[n, k], after[n, k]
    return n, (k + 0.5 + (a - d) / (2 * (a - 2 * b + d))) * 2 * np.pi / TURNS


def _sampled(a: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    i, j = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = y - i, x - j
    return (1 - fy) * ((1 - fx) * a[i, j] + fx * a[i, j + 1]) + fy * ((1 - fx) * a[i + 1, j] + fx * a[i + 1, j + 1])


def _descriptors(gy: np.ndarray, gx: np.ndarray, y: np.ndarray, x: np.ndarray, angle: np.ndarray, sigma: float) -> np.ndarray:
    """Gradient directions around each place, relative to its own: 4 x 4 cells of 8 bins, shared linearly by neighbours, unit length."""
    n = len(y)
    side = np.arange(SAMPLES) - SAMPLES / 2 + 0.5
    v, u = np.meshgrid(side, side, indexing="ij")
    cos, sin = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
    rows = y[:, None, None] + (u * sin + v * cos) * STEP * sigma
    cols = x[:, None, None] + (u * cos - v * sin) * STEP * sigma
    dy, dx = _sampled(gy, rows, cols), _sampled(gx, rows, cols)
    weight = np.hypot(dy, dx) * np.exp(-(u**2 + v**2) / (2 * (SAMPLES / 2) ** 2))
    turn = np.mod(np.arctan2(dy, dx) - angle[:, None, None], 2 * np.pi) / (2 * np.pi) * BINS
    cell_v, cell_u = ((w + SAMPLES / 2) / SAMPLES * CELLS - 0.5 for w in (v, u))
    hist = np.zeros(n * CELLS * CELLS * BINS)
    base = np.arange(n)[:, None, None] * CELLS * CELLS * BINS
    for i in (0, 1):
        row = np.floor(cell_v).astype(int) + i
        share_v = 1 - np.abs(cell_v - row)
        for j in (0, 1):
            col = np.floor(cell_u).astype(int) + j
            share = share_v * (1 - np.abs(cell_u - col)) * ((row >= 0) & (row < CELLS) & (col >= 0) & (col < CELLS))
            place = base + (np.clip(row, 0, CELLS - 1) * CELLS + np.clip(col, 0, CELLS - 1)) * BINS
            for k in (0, 1):
                b = np.floor(turn).astype(int) + k
                hist += np.bincount((place + b % BINS).ravel(), (weight * share * (1 - np.abs(turn - b))).ravel(), len(hist))
    hist = hist.reshape(n, CELLS * CELLS * BINS)
    unit = lambda h: h / np.maximum(np.linalg.norm(h, axis=1, keepdims=True), 1e-12)
    return unit(np.minimum(unit(hist), 0.2)).astype(np.float32)


def _of_tile(least: float):
    def rows_of(a: np.ndarray, inside: np.ndarray) -> dict:
        blurred = np.stack([_blur(a, s) for s in SIGMAS])
        dog = np.diff(blurred, axis=0)
        out: dict[str, list] = {k: [] for k in ("r", "c", "dy", "dx", "response", "level", "angle", "vec")}
        for level in range(1, PER_OCTAVE + 1):
            r, c = _extrema(dog, level, inside, 0.8 * least)
            keep, move, value = _refined(dog, level, r, c, least)
            r, c, move, value = r[keep], c[keep], move[keep], value[keep]
            gy, gx = np.gradient(blurred[level])
            n, angle = _orientations(gy, gx, r, c, SIGMAS[level])
            y, x = r[n] + move[n, 1], c[n] + move[n, 2]
            vec = _descriptors(gy, gx, y, x, angle, SIGMAS[level])
            for k, own in (("r", r[n] - HALO), ("c", c[n] - HALO), ("dy", move[n, 1]), ("dx", move[n, 2]), ("response", np.abs(value[n])), ("level", level + move[n, 0]), ("angle", angle), ("vec", vec)):
                out[k].append(own)
        joined = {k: np.concatenate(v) for k, v in out.items()}
        return {**joined, "vec": pd.Series(list(joined["vec"]), dtype=object)}

    return rows_of


def _half(a: np.ndarray, inside: np.ndarray) -> dict:
    """Every second cell of every second row, blurred as the first scale of the next octave asks for."""
    halo = HALF_HALO
    soft = _blur(a, HALF_SIGMA)
    core = (soft * inside)[halo : a.shape[0] - halo, halo : a.shape[1] - halo][::2, ::2]
    r, c = np.nonzero(core)
    return {"r": 2 * r, "c": 2 * c, "v": core[r, c]}


# the first scale of an octave is blurred by BASE_SIGMA of its own cells, so before halving a little less than one cell is enough
HALF_SIGMA = 0.8
HALF_HALO = int(4 * HALF_SIGMA + 0.5)


def _of_tile_and_half(least: float):
    """The features of a tile, and its cells of the next octave as rows without vec: the pixels are sent and read once for both."""
    features, cut = _of_tile(least), HALO - HALF_HALO

    def rows_of(a: np.ndarray, inside: np.ndarray) -> dict:
        found, half = features(a, inside), _half(a[cut : a.shape[0] - cut, cut : a.shape[1] - cut], inside[cut : a.shape[0] - cut, cut : a.shape[1] - cut])
        n, m = len(found["r"]), len(half["r"])
        own = {k: np.concatenate([found[k], np.full(m, np.nan)]) for k in found if k not in ("r", "c", "vec")}
        place = {k: np.concatenate([found[k], half[k]]).astype(int) for k in ("r", "c")}
        vec = np.empty(n + m, dtype=object)
        vec[:n] = list(found["vec"])
        return {**place, **own, "vec": pd.Series(vec, dtype=object), "v": np.concatenate([np.full(n, np.nan), half["v"]])}

    return rows_of


def interior_keypoints(
    px: DataFrame, keys: Sequence[str], shape, n_best: int = 5000, min_contrast: float = 1.0, tile: int = 512, octaves: int = 4,
) -> DataFrame:
    """extrema of differences of Gaussians in space and scale, with turned gradient descriptors; the n_best strongest per frame.

    Returns keys, r, c (cell), y, x (position to a fraction of a cell), sigma (scale), angle
    (radians, from the column axis towards the rows), response, vec (128 values) and kp_id. A feature with
    several clear directions is one row for each. Features along edges are left out.

    Octave k works on the frame reduced by 2**k, made from the one before in haloed tiles, so no task
    holds more than one tile with its halo at any octave. n_best is the size of the feature
    set itself, applied over all octaves.
    """
    keys = list(keys)
    ddl = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in px.select(*keys).schema)
    varied = isinstance(shape, DataFrame)
    sizes = pin(size_columns(px.select(*keys).distinct(), shape, keys)) if varied else (int(shape[0]), int(shape[1]))
    now, found = px.select(*keys, "r", "c", F.col("v").cast("double").alias("v")), None
    for k in range(octaves):
        if k:
            now = now.select(*keys, (F.col("r") / 2).cast("int").alias("r"), (F.col("c") / 2).cast("int").alias("c"), "v")
        # a frame smaller than a descriptor has no features
        if varied:
            sizes = sizes if k == 0 else sizes.withColumn("height", F.ceil(F.col("height") / 2).cast("int")).withColumn("width", F.ceil(F.col("width") / 2).cast("int"))
            large = sizes.filter((F.col("height") >= 2 * SAMPLES) & (F.col("width") >= 2 * SAMPLES))
            own = now.join(large.select(*keys), keys, "left_semi")
        else:
            large = sizes if k == 0 else (-(-large[0] // 2), -(-large[1] // 2))
            own = now if min(large) >= 2 * SAMPLES else now.limit(0)
        schema = ddl + "r int, c int, dy double, dx double, response double, level double, angle double, vec array<float>"
        if k + 1 < octaves:
            both = pin(tile_rows(own, keys, large, HALO, _of_tile_and_half(min_contrast), schema + ", v double", tile=tile, mode="mirror"))
            pts, now = both.filter("vec is not null"), both.filter("vec is null").select(*keys, "r", "c", "v")
        else:
            pts = tile_rows(own, keys, large, HALO, _of_tile(min_contrast), schema, tile=tile, mode="mirror")
        scale = float(1 << k)
        part = pts.select(
            *keys, ((F.col("r") + F.col("dy")) * scale).alias("y"), ((F.col("c") + F.col("dx")) * scale).alias("x"),
            (F.pow(F.lit(2.0), F.col("level") / PER_OCTAVE) * (BASE_SIGMA * scale)).alias("sigma"), "angle", "response", "vec",
        )
        found = part if found is None else found.unionByName(part)
    cell = lambda n: F.greatest(F.lit(0), F.floor(F.col(n) + 0.5)).cast("int")
    rows = pin(found.select(*keys, cell("y").alias("r"), cell("x").alias("c"), "y", "x", "sigma", "angle", "response", "vec"))
    return top_rows(rows, keys, n_best, "response").withColumn("kp_id", F.xxhash64("y", "x", "sigma", "angle"))
