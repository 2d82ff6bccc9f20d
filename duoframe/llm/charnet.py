"""A small character convolutional network in numpy, with calibrated probabilities."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .textbytes import ragged

WINDOW, SYMBOLS, SIZE, WIDTH, FILTERS = 72, 98, 8, 5, 24
SPAN = 1 << 14  # places whose convolution is held at a time, about
SPACE = 2  # the symbol of a space
TOP = 3  # maxima over up to 2**TOP places are kept for every place; longer ranges are made of several


def symbols(codes: np.ndarray) -> np.ndarray:
    """Symbol of each code point: printable ASCII, or other."""
    return np.where((codes >= 32) & (codes < 127), codes - 30, 1).astype(np.int16)


def encode(windows: list[str], marks: list[tuple[int, int]]) -> np.ndarray:
    """Symbols of each window, n x WINDOW x 2: printable ASCII, others, or nothing; and whether inside the candidate."""
    out = np.zeros((len(windows), WINDOW, 2), np.int16)
    for i, (text, (low, high)) in enumerate(zip(windows, marks)):
        codes = np.frombuffer(text[:WINDOW].encode("utf-32-le"), np.uint32).astype(np.int64)
        out[i, : len(codes), 0] = symbols(codes)
        out[i, low:high, 1] = 1
    return out


@dataclass
class CharNet:
    """Embedding, one convolution, maximum and mean over places, and a logistic output."""

    parts: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 2.0
    least: float = np.inf  # the logit of the threshold

    @staticmethod
    def new(seed: int = 7) -> CharNet:
        r = np.random.default_rng(seed)
        shapes = {"symbol": (SYMBOLS, SIZE), "inside": (2, SIZE), "kernel": (WIDTH * SIZE, FILTERS), "bias": (FILTERS,), "out": (2 * FILTERS,), "base": (1,)}
        return CharNet({k: r.normal(0, 0.3 if len(s) > 1 else 0.05, s) for k, s in shapes.items()})

    def _forward(self, x: np.ndarray) -> tuple:
        p = self.parts
        e = p["symbol"][x[:, :, 0]] + p["inside"][x[:, :, 1]]
        places = WINDOW - WIDTH + 1
        patches = np.concatenate([e[:, j : j + places] for j in range(WIDTH)], axis=2)
        h = np.maximum(patches @ p["kernel"] + p["bias"], 0)
        pooled = np.concatenate([h.max(axis=1), h.mean(axis=1)], axis=1)
        return patches, h, pooled, pooled @ p["out"] + p["base"][0]

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 512])[3] for i in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.chance(self.logit(x))

    def chance(self, logit: np.ndarray) -> np.ndarray:
        """Calibrated probability."""
        return 1 / (1 + np.exp(-np.clip(self.scale * logit + self.shift, -40, 40)))

    def probability_at(self, symbol: np.ndarray, low: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """`probability` of the windows at `low` of a row of symbols, marked from `first` to `end`."""
        return self.chance(self.logit_at(symbol, low, first, end))

    def logit_at(self, symbol: np.ndarray, low: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """`logit` of such windows, in single precision."""
        return self.forms_at(symbol, low, first, end, np.zeros(len(low), bool))[0]

    def forms_at(self, symbol: np.ndarray, low: np.ndarray, first: np.ndarray, end: np.ndarray, bare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """`logit` of such windows, and of those of them that are bare with spaces for what is before the mark.

        Windows overlap, so the convolution of the unmarked symbols is made once per place. Only the
        places that touch its mark are a window's own. The others are a range on its left and one on
        its right, whose maximum comes from a table of maxima over 1, 2, 4 and 8 places; the mean
        enters the logit as a sum of one number a place. The two forms differ only in the range on
        the left and in the few places that reach into the mark from there.
        """
        p = {k: v.astype(np.float32) for k, v in self.parts.items()}
        kernel, places = p["kernel"].reshape(WIDTH, SIZE, FILTERS), WINDOW - WIDTH + 1
        of_most, of_mean = p["out"][:FILTERS], p["out"][FILTERS:] / places
        taps = (p["symbol"] + p["inside"][0]) @ kernel
        taps[0] += p["bias"]
        to_space = [taps[j, SPACE] - taps[j] for j in range(WIDTH - 1)]
        # what the marks add: to a place whose symbols from the i-th up to the j-th are marked
        by_tap = np.concatenate([np.zeros((1, FILTERS), np.float32), np.cumsum((p["inside"][1] - p["inside"][0]) @ kernel, axis=0)])
        marks = (by_tap[None] - by_tap[:, None]).reshape(-1, FILTERS)
        blank = np.maximum(taps[:, SPACE].sum(axis=0), 0)
        out, of_bare = np.zeros(len(low)), np.zeros(len(low))
        order = np.argsort(low, kind="stable")
        spread = int(low.max() - low.min()) + 1 if len(low) else 1
        group = (low[order] - low[order[:1]]) * max(1, round(spread / SPAN)) // spread
        for part in np.split(order, np.flatnonzero(np.diff(group)) + 1) if len(order) else ():
            base = int(low[part[0]])
            own, start, head, tail = symbol[base : int(low[part[-1]]) + WINDOW], low[part] - base, first[part] - base, end[part] - base
            n = len(own) - WIDTH + 1
            # pairs of the symbols that occur here: three rows a place instead of five
            seen = np.flatnonzero(np.bincount(own, minlength=SYMBOLS))
            number = np.zeros(SYMBOLS, np.int64)
            number[seen] = np.arange(len(seen))
            pair = number[own]
            pair = pair[:-1] * len(seen) + pair[1:]
            both = lambda j: (taps[j, seen][:, None] + taps[j + 1, seen][None]).reshape(-1, FILTERS)
            plane = both(0).take(pair[:n], axis=0)
            plane += both(2).take(pair[2 : 2 + n], axis=0)
            plane += taps[4].take(own[4 : 4 + n], axis=0)
            levels = [np.maximum(plane, 0)]
            running = np.concatenate([[0], np.cumsum(levels[0] @ of_mean, dtype=float)])
            a, b, stop = np.maximum(head - WIDTH + 1, start), np.minimum(tail, start + places), start + places
            which = np.flatnonzero(bare[part])
            # the places inside the mark and the range on the right, alike in both forms; with one form all places of the mark
            inner = np.maximum(head, start) if len(which) else a
            size = b - inner
            place, of = ragged(inner, size), np.repeat(np.arange(len(part)), size)
            met = plane.take(place, axis=0)
            met += marks.take(np.maximum(head[of] - place, 0) * (WIDTH + 1) + np.minimum(tail[of] - place, WIDTH), axis=0)
            np.maximum(met, 0, out=met)
            at = np.cumsum(size) - size
            most = np.maximum.reduceat(met, at, axis=0)
            total = running[stop] - running[b] + np.add.reduceat(met @ of_mean, at, dtype=float)
            left, right = np.flatnonzero(a > start), np.flatnonzero(stop > b)
            for k in range(min(TOP, int(max((a - start).max(), (stop - b).max())).bit_length() - 1)):
                levels.append(np.maximum(levels[-1][: -(1 << k)], levels[-1][1 << k :]))
            self._range(levels, b, stop, right, most)
            if len(which):
                bare_most, bare_total = most[which], total[which] + (a - start)[which] * float(blank @ of_mean)
                gone = a[which] > start[which]
                bare_most[gone] = np.maximum(bare_most[gone], blank)
            # the places before the mark that reach into it
            for j in range(1, WIDTH if len(which) else 1):
                i = np.flatnonzero(head - j >= start)
                place = head[i] - j
                met = plane.take(place, axis=0)
                met += marks.take(j * (WIDTH + 1) + np.minimum(tail[i] - place, WIDTH), axis=0)
                spaced = np.flatnonzero(bare[part[i]])
                other, from_ = met.take(spaced, axis=0), place[spaced]
                for t in range(j):
                    other += to_space[t].take(own[from_ + t], axis=0)
                np.maximum(other, 0, out=other)
                to = np.searchsorted(which, i[spaced])
                bare_most[to] = np.maximum(bare_most[to], other)
                bare_total[to] += other @ of_mean
                np.maximum(met, 0, out=met)
                most[i] = np.maximum(most[i], met)
                total[i] += met @ of_mean
            self._range(levels, start, a, left, most)
            total += running[a] - running[start]
            out[part] = most @ of_most + total + p["base"][0]
            if len(which):
                of_bare[part[which]] = bare_most @ of_most + bare_total + p["base"][0]
        return out, of_bare[bare]

    @staticmethod
    def _range(levels: list[np.ndarray], low: np.ndarray, high: np.ndarray, some: np.ndarray, most: np.ndarray) -> None:
        """Take the maxima over the places from low up to high into those of some windows."""
        low, high = low[some], high[some]
        level = np.minimum(np.frexp(high - low)[1] - 1, TOP)
        for k in np.unique(level).tolist():
            i = np.flatnonzero(level == k)
            at, last = low[i], high[i] - (1 << k)
            both = levels[k].take(last, axis=0)
            for _ in range(-(-int((last - at).max()) // (1 << k)) if k == TOP else 1):  # only ranges of the top level need several
                np.maximum(both, levels[k].take(np.minimum(at, last), axis=0), out=both)
                at = at + (1 << k)
            most[some[i]] = np.maximum(most[some[i]], both)

    def _gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        forward = self._forward(x)
        return self._back(x, weight * (1 / (1 + np.exp(-np.clip(forward[3], -40, 40))) - y) / len(x), forward)

    def _back(self, x: np.ndarray, d: np.ndarray, forward: tuple | None = None) -> dict[str, np.ndarray]:
        """Gradient of the parts, from that of the logits of x."""
        p = self.parts
        patches, h, pooled, _ = forward or self._forward(x)
        g = {"out": pooled.T @ d, "base": np.array([d.sum()])}
        dh = np.repeat((d[:, None] * p["out"][None, FILTERS:])[:, None, :] / h.shape[1], h.shape[1], axis=1)
        i, k = np.ogrid[: len(x), :FILTERS]
        dh[i, h.argmax(axis=1), k] += d[:, None] * p["out"][None, :FILTERS]
        dh *= h > 0
        g["kernel"] = patches.reshape(-1, WIDTH * SIZE).T @ dh.reshape(-1, FILTERS)
        g["bias"] = dh.sum(axis=(0, 1))
        back = (dh @ p["kernel"].T).reshape(len(x), -1, WIDTH, SIZE)
        de = np.zeros((len(x), WINDOW, SIZE), back.dtype)
        for j in range(WIDTH):
            de[:, j : j + back.shape[1]] += back[:, :, j]
        for name, c in (("symbol", 0), ("inside", 1)):
            at = x[:, :, c].reshape(-1)
            g[name] = np.stack([np.bincount(at, de[:, :, k].reshape(-1), len(p[name])) for k in range(SIZE)], axis=1)
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, seed: int = 7) -> None:
        """Adam on shuffled batches; both classes weigh the same."""
        r = np.random.default_rng(seed)
        weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
        adam = Adam(self.parts)
        for _ in range(epochs):
            order = r.permutation(len(x))
            for i in range(0, len(x), 64):
                own = order[i : i + 64]
                adam.step(self._gradient(x[own], y[own], weight[own]))

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float) -> None:
        """Platt scaling on held-out findings, and the highest threshold that keeps `recall` of them."""
        self.calibrate_counts(self.logit(x), y, np.ones(len(y)), recall)

    def calibrate_counts(self, z: np.ndarray, y: np.ndarray, n: np.ndarray, recall: float) -> None:
        """The same from logits z of either side (y) that were seen n times."""
        yes, no = n[y > 0].sum(), n[y <= 0].sum()
        target = np.where(y > 0, (yes + 1) / (yes + 2), 1 / (no + 2))

        def loss(scale, shift):
            t = scale * z + shift
            return float(n @ (np.logaddexp(0, t) - target * t))

        at, best = (1.0, 0.0), loss(1.0, 0.0)
        for _ in range(100):  # Newton's method, with shorter steps where a whole one does not help
            q = 1 / (1 + np.exp(-np.clip(at[0] * z + at[1], -40, 40)))
            d, w = n * (q - target), n * q * (1 - q)
            g = np.array([d @ z, d.sum()])
            step = np.linalg.solve(np.array([[w @ (z * z), w @ z], [w @ z, w.sum()]]) + 1e-9 * (1 + n.sum()) * np.eye(2), g)
            for half in range(30):
                new = (at[0] - step[0] / 2**half, at[1] - step[1] / 2**half)
                if new[0] > 0 and loss(*new) < best:
                    break
            else:
                break
            at, last, best = new, best, loss(*new)
            if last - best < 1e-12 * abs(last):
                break
        self.scale, self.shift = at
        order = np.argsort(z[y > 0], kind="stable")
        found, below = z[y > 0][order], np.cumsum(n[y > 0][order])
        self.least = float(found[int(np.searchsorted(below, np.floor((1 - recall) * yes), "right"))])
        self.threshold = float(self.chance(np.array(self.least)))


class Adam:
    """Steps that change the parts in place."""

    def __init__(self, parts: dict[str, np.ndarray], rate: float = 0.005):
        self.parts, self.rate, self.t = parts, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in parts.items()}
        self.v = {k: np.zeros_like(v) for k, v in parts.items()}

    def step(self, gradient: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in gradient.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            self.parts[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)
