"""BagMinHash signatures of weighted sets: registers agree with the weighted Jaccard similarity.

Each element draws a Poisson process over (weight, time). Weights are whole counts, and the
weight axis is split into the dyadic strips [0, 1), [1, 2), [2, 4), [4, 8) ...; a strip that
the weight covers only in part is thinned by the weight cell of every point. So the points of
a smaller weight are a subset of those of a larger one. A point falls into a random register,
and every register keeps its earliest point; no point after the time at which all registers
are filled is ever made.
"""

from __future__ import annotations

import numpy as np

from .textbytes import mix

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


def _points(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, until: np.ndarray, registers: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slot (doc * registers + register), time and name of every point up to each row's time."""
    strips = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 2))).astype(np.int64) + 1, 1)
    who = np.repeat(np.arange(len(doc)), strips)
    strip = np.arange(len(who)) - np.repeat(np.cumsum(strips) - strips, strips)
    low = np.where(strip > 0, 1 << np.maximum(strip - 1, 0), 0)
    width = np.maximum(low, 1)
    seed = mix(element[who] + _STEP * strip.astype(_U))
    time, row, limit, most = np.zeros(len(who)), doc[who], until[doc[who]], weight[who]
    slots, times, names = [], [], []
    step = 0
    while len(seed):
        step += 1
        draw = mix(seed + _U(step * int(_STEP) & (1 << 64) - 1))
        time = time - np.log1p(-(draw >> _U(11)).astype(float) * 2.0**-53) / width
        on = np.flatnonzero(time <= limit)
        seed, time, row, limit, most, low, width, draw = (x[on] for x in (seed, time, row, limit, most, low, width, draw))
        place = mix(draw ^ _STEP)
        cell = low + (((place & _U(0xFFFFFFFF)) * width.astype(_U)) >> _U(32)).astype(np.int64)
        inside = cell < most
        register = ((place >> _U(32)) * _U(registers) >> _U(32)).astype(np.int64)
        slots.append((row * registers + register)[inside])
        times.append(time[inside])
        names.append(place[inside])
    return np.concatenate(slots), np.concatenate(times), np.concatenate(names)


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int, registers: int) -> np.ndarray:
    """Names of the earliest points, rows x registers; rows without elements stay 0."""
    out = np.zeros((rows, registers), _U)
    total = np.bincount(doc, weight, rows)
    scale = np.full(rows, np.log(registers) + 2.0)
    open_rows = total > 0
    while open_rows.any():
        own = open_rows[doc]
        until = np.where(open_rows, registers * scale / np.maximum(total, 1), 0.0)
        slot, time, name = _points(doc[own], element[own], weight[own], until, registers)
        order = np.argsort(-time, kind="stable")
        filled = np.zeros(rows * registers, bool)
        filled[slot] = True
        flat = out.reshape(-1)
        flat[slot[order]] = name[order]  # the earliest is written last
        open_rows &= ~filled.reshape(rows, registers).all(axis=1)
        scale *= 2
    return out


def bag(doc: np.ndarray, element: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct elements of each row and how often they occur, by row and element."""
    order = np.lexsort((element, doc))
    doc, element = doc[order], element[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (element[1:] != element[:-1])
    at = np.flatnonzero(new)
    return doc[at], element[at], np.diff(np.append(at, len(doc)))
