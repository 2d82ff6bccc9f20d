"""Secrets in texts: fixed patterns, and a character network over every candidate and its context."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import pin
from .charnet import SPACE, WINDOW, Adam, CharNet, encode, symbols
from .textbytes import BASE, INVERSE, mix, powers, ragged, slices, utf8

# fixed values: the base patterns and the least length of what they find
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 8, 16, 32
KINDS = ("assign", "access", "hex", "network")

CANDIDATE_LENGTH, BEFORE, STEP = 8, 24, WINDOW // 2
HELD, STEP_ROWS, PAIRED = 4, 512, 64  # one text in HELD is held out; others and secrets of a step
ROUNDS, EPOCHS, ENOUGH = (0, 1, 4, 16, 64), 12, 1 << 20  # shares of the texts, in 64ths; windows that need no further epoch
FINE, LEAST = 1024, 0.0  # steps of a logit in the calibration; logits of candidates that are kept until the threshold is known
SPAN = pa.struct([("kind", pa.int32()), ("first", pa.int64()), ("end", pa.int64()), ("logit", pa.float64())])
COUNT = pa.struct([("step", pa.int64()), ("secret", pa.bool_()), ("n", pa.int64())])
_HEX, _TOKEN, _SET = (np.zeros(256, bool) for _ in range(3))
_HEX[[*b"0123456789abcdef"]] = True
_TOKEN[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"]] = True
_SET[[*b":="]] = True


def _runs(mask: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and end byte of the runs of at least `least` bytes that stay inside a text."""
    edge = np.zeros((2, len(mask) + 1), bool)  # whether a run may begin at a byte, and whether one may end before it
    edge[0, 1:], edge[1, :-1] = ~mask, ~mask
    edge[:, at] = True
    first, end = np.flatnonzero(mask & edge[0, :-1]), np.flatnonzero(mask & edge[1, 1:]) + 1
    long = end - first >= least
    return np.searchsorted(at, first[long], "right") - 1, first[long], end[long]


def _base(column: pa.Array, data: np.ndarray, at: np.ndarray, points: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """First, kind and end of the base spans of each row, in code points of its text."""
    base: dict[int, list[tuple[int, int, int]]] = {}
    for row, first, end in zip(*_runs(_HEX[data], at, HEX_LENGTH)):
        base.setdefault(int(row), []).append((int(points[first] - points[at[row]]), 2, int(points[end] - points[at[row]])))
    whole = data.tobytes()
    some, p = set(), whole.find(b"AKIA")
    while p >= 0:
        some.add(int(np.searchsorted(at, p, "right") - 1))
        p = whole.find(b"AKIA", p + 4)
    for row in some:
        for m in ACCESS.finditer(column[row].as_py() or ""):
            if m.end() - m.start() >= ACCESS_LENGTH:
                base.setdefault(row, []).append((m.start(), 1, m.end()))
    for row in np.unique(np.searchsorted(at, np.flatnonzero(_SET[data]), "right") - 1).tolist():
        for m in ASSIGN.finditer(column[row].as_py() or ""):
            if len(m[2]) >= ASSIGN_LENGTH:
                base.setdefault(row, []).append((m.start(), 0, m.end()))
    return base


class _Slice:
    """Base spans, candidates and windows of a slice of whole texts.

    Places count the code points of the whole slice, with WINDOW empty places after every text. A candidate of more than WINDOW characters with BEFORE of its context on either side has
    several windows, STEP apart, the last one up to the end of that context.
    """

    def __init__(self, column: pa.Array):
        self.column = column
        data, at = utf8(column)
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        self.base = _base(column, data, at, points)
        gaps = WINDOW * np.arange(len(at) - 1)
        self.text, self.stop = points[at[:-1]] + gaps, points[at[1:]] + gaps
        codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        self.symbol = np.zeros(len(codes) + WINDOW * (len(at) - 1), np.int16)
        self.symbol[ragged(self.text, self.stop - self.text)] = symbols(codes)
        self.row, first, end = _runs(_TOKEN[data], at, CANDIDATE_LENGTH)
        self.first, self.end = points[first] + gaps[self.row], points[end] + gaps[self.row]
        marked = np.zeros(len(self.symbol) + 1, np.int64)
        for r, spans in self.base.items():
            for a, _, b in spans:
                marked[self.text[r] + a] += 1
                marked[self.text[r] + b] -= 1
        self.marked = np.concatenate([[0], np.cumsum(np.cumsum(marked[:-1]) > 0)])
        self.known = self.marked[self.end] > self.marked[self.first]

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Candidate and first place of every window of some candidates."""
        low = np.maximum(self.text[self.row[which]], self.first[which] - BEFORE)
        last = np.minimum(self.stop[self.row[which]], self.end[which] + BEFORE) - WINDOW
        n = 1 + np.maximum(0, -(-(last - low) // STEP))
        number = ragged(np.zeros(len(n), np.int64), n)
        low, last, which = np.repeat(low, n), np.repeat(last, n), np.repeat(which, n)
        return which, np.where(number, np.minimum(low + STEP * number, last), low)

    def keys(self, which: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Hash of the network's input for these windows: the symbols, and the marked places."""
        n = len(self.symbol)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((self.symbol.astype(np.uint64) + np.uint64(1)) * powers(INVERSE, n), out=prefix[1:])
        text = (prefix[low + WINDOW] - prefix[low]) * powers(BASE, n + 1)[low]
        first, end = np.maximum(self.first[which] - low, 0), np.minimum(self.end[which] - low, WINDOW)
        return mix(mix(text) + (first * (WINDOW + 1) + end).astype(np.uint64)).view(np.int64)


def _inputs(rows: list[dict], masked: bool = False) -> np.ndarray:
    """Network inputs; masked: without the context before the candidate, so that its characters must tell."""
    windows, marks = [], []
    for c in rows:
        a, b = c["first"] - c["low"], min(c["end"] - c["low"], WINDOW)
        windows.append(" " * a + c["window"][a:] if masked else c["window"])
        marks.append((a, b))
    return encode(windows, marks)


class _Labelled:
    """Windows of a slice with the labels of the base patterns.

    Secrets are the windows of candidates that a pattern meets, if their part of the candidate
    is met; others are those of candidates that no pattern meets.
    """

    def __init__(self, column: pa.Array):
        s = self.slice = _Slice(column)
        which, low = s.windows(np.arange(len(s.first)))
        met = s.marked[np.minimum(low + WINDOW, s.end[which])] > s.marked[np.maximum(low, s.first[which])]
        use = np.flatnonzero(~s.known[which] | met)
        which, self.low = which[use], low[use]
        self.which, self.first, self.end, self.secret = which, s.first[which], s.end[which], s.known[which]

    def logits(self, net: CharNet, some: np.ndarray) -> np.ndarray:
        return _both_logits(net, self.slice.symbol, self.low[some], self.first[some], self.end[some])

    def rows(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of some windows, and where the mark begins and ends in each."""
        low = self.low[some]
        return self.slice.symbol[low[:, None] + np.arange(WINDOW)], np.maximum(self.first[some] - low, 0), np.minimum(self.end[some] - low, WINDOW)


def _both_logits(net: CharNet, symbol: np.ndarray, low: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Logits of the windows as they are, then without the context before the candidate, so that its characters must tell."""
    return np.concatenate(net.forms_at(symbol, low, first, end, np.ones(len(low), bool)))


def _network_inputs(symbol: np.ndarray, first: np.ndarray, end: np.ndarray, bare: np.ndarray) -> np.ndarray:
    place = np.arange(WINDOW)
    before = place < first[:, None]
    return np.stack([np.where(before & bare[:, None], SPACE, symbol), ~before & (place < end[:, None])], axis=2).astype(np.int16)


def _step(net: CharNet, adam: Adam, windows: _Labelled, others: np.ndarray, pool: list[np.ndarray], some: np.ndarray) -> None:
    """One step on other windows and on some secrets of the pool, both sides with the same weight.

    The loss is the squared lack of a margin of 1, so windows beyond it have no gradient at all
    and only the remaining ones need one.
    """
    symbol, first, end = (a[some] for a in pool)
    at = WINDOW * np.arange(len(some))
    z = windows.logits(net, others), _both_logits(net, symbol.reshape(-1), at, at + first, at + end)
    x, d = [], []
    for lack, rows, sign in ((1 + z[0], lambda i: windows.rows(others[i]), 1), (1 - z[1], lambda i: (symbol[i], first[i], end[i]), -1)):
        short, n = np.flatnonzero(lack > 0), len(lack) // 2
        x.append(_network_inputs(*rows(short % max(n, 1)), short >= n))
        d.append(sign * lack[short] / max(n, 1))
    x, d = np.concatenate(x), np.concatenate(d)
    if len(x):
        small = CharNet({k: v.astype(np.float32) for k, v in net.parts.items()})
        parts = [small._back(x[i : i + 128], d[i : i + 128].astype(np.float32)) for i in range(0, len(x), 128)]
        adam.step({k: sum(g[k] for g in parts) for k in parts[0]})


def _taught(batches: Iterator[pa.RecordBatch], net: CharNet) -> Iterator[pa.RecordBatch]:
    """The parts of the network after steps over all windows of a task.

    Others come in the order of the texts, each once; every step has secrets of the same slice
    of texts beside them, all of them in turn, and of the slices before if those are few.
    """
    net = CharNet({k: v.copy() for k, v in net.parts.items()})
    adam, secrets, others = Adam(net.parts), 0, 0
    pool = [np.zeros((0, WINDOW), np.int16), np.zeros(0, np.int64), np.zeros(0, np.int64)]
    for batch in slices(batches, "text"):
        w = _Labelled(batch.column("text"))
        own, rest = np.flatnonzero(w.secret), np.flatnonzero(~w.secret)
        secrets, others = secrets + len(own), others + len(rest)
        pool = [np.concatenate([a, b[: max(0, PAIRED - len(own))]]) for a, b in zip(w.rows(own), pool)]
        steps, known = -(-max(len(rest), len(own)) // STEP_ROWS), len(pool[1])
        for k, part in enumerate(np.array_split(rest, steps) if steps else ()):
            size = min(known, max(PAIRED, -(-known // steps)))
            _step(net, adam, w, part, pool, (np.arange(size) + k * size) % max(known, 1))
    flat = np.concatenate([net.parts[k].reshape(-1) for k in sorted(net.parts)])
    yield pa.RecordBatch.from_pylist([{"n": secrets + others, "secrets": secrets, "others": others, "parts": flat.tolist()}], pa.schema([("n", pa.int64()), ("secrets", pa.int64()), ("others", pa.int64()), ("parts", pa.list_(pa.float64()))]))


def _average(taught: DataFrame, net: CharNet) -> CharNet:
    """The parts of all tasks, weighted by their windows; rounded, so that the order of the sum does not show."""
    mean = taught.filter("n > 0").agg(Summarizer.mean(array_to_vector("parts"), F.col("n").cast("double")).alias("m")).first()["m"]
    flat, names = np.round(mean.toArray(), 9), sorted(net.parts)
    cuts = np.cumsum([net.parts[k].size for k in names])[:-1]
    return CharNet({k: v.reshape(net.parts[k].shape) for k, v in zip(names, np.split(flat, cuts))})


def _held():
    """Whether a text is held out: a quarter, by its hash, so that equal texts are on one side."""
    return F.pmod(F.xxhash64("text", F.lit(HELD)), F.lit(HELD)) == 0


def train(docs: DataFrame) -> CharNet | None:
    """Fit on every window of every text that is not held out, with the base patterns as labels.

    Candidates that a pattern meets are secrets, all others are not. The texts are seen in rounds
    of growing shares (ROUNDS), each text in one of them: every task goes on from the parts of the
    round before, over all its windows, and the parts of all tasks are averaged. Small tables are
    gone through again, up to EPOCHS times. None with fewer than 15 secrets or others to fit on.
    Which texts share a task follows from the partitions of docs, so the fitted parts do too.
    """
    net, trained = CharNet.new(), 0
    share = F.pmod(F.xxhash64("text"), F.lit(ROUNDS[-1]))
    for epoch in range(EPOCHS):
        seen = np.zeros(3, np.int64)
        for low, high in zip(ROUNDS, ROUNDS[1:]) if epoch == 0 else ((0, ROUNDS[-1]),):
            part = docs.filter((share >= low) & (share < high) & ~_held()).select("text")
            taught = pin(part.mapInArrow(lambda b, net=net: _taught(b, net), "n long, secrets long, others long, parts array<double>"))
            sizes = taught.agg(*(F.sum(c).alias(c) for c in ("n", "secrets", "others"))).first()
            seen += [int(v or 0) for v in sizes]
            net = _average(taught, net) if sizes["n"] else net
        trained += seen[0]
        if min(seen[1:]) < 15:
            return None
        if trained >= ENOUGH:
            break
    return net


def _with_spans(s: _Slice, more: np.ndarray, logit: np.ndarray) -> list[list[dict]]:
    """Base spans of each row, and some candidates with their logits."""
    spans = [[(a, k, b, None) for a, k, b in s.base.get(r, ())] for r in range(len(s.text))]
    for i in more.tolist():
        r = int(s.row[i])
        spans[r].append((int(s.first[i] - s.text[r]), 3, int(s.end[i] - s.text[r]), float(logit[i])))
    return [[{"kind": k, "first": a, "end": b, "logit": z} for a, k, b, z in sorted(x, key=lambda t: t[:3])] for x in spans]


def _scored(batches: Iterator[pa.RecordBatch], net: CharNet) -> Iterator[pa.RecordBatch]:
    """Base spans of each whole text, and the open candidates whose likeliest window has a logit of LEAST or more.

    A last row of every task counts the held-out windows in both forms: secrets and others whose logit has so
    many whole steps of 1 / FINE.
    """
    total: dict[tuple[int, bool], int] = {}
    kind = batch = None
    # held-out texts apart from the others: both of their forms are needed, of the others only one
    parted = (p for b in slices(batches, "text") for p in (b.filter(b.column("held")), b.filter(pc.invert(b.column("held")))) if p.num_rows)
    for batch in parted:
        w = _Labelled(batch.column("text"))
        s, kind = w.slice, batch.schema.field("doc_id").type
        held = np.array(batch.column("held"), bool)[s.row[w.which]]
        plain = np.flatnonzero(held | ~w.secret)
        some = np.concatenate([plain, np.flatnonzero(held)])
        z = np.concatenate(net.forms_at(s.symbol, w.low[plain], w.first[plain], w.end[plain], held[plain]))
        best = np.full(len(s.first), -np.inf)
        open_ = ~w.secret[plain]
        np.maximum.at(best, w.which[plain[open_]], z[: len(plain)][open_])
        counted = held[some]
        steps = np.floor(FINE * np.clip(z[counted], -40, 40)).astype(np.int64)
        for secret in (True, False):
            for k, n in zip(*np.unique(steps[w.secret[some][counted] == secret], return_counts=True)):
                total[int(k), secret] = total.get((int(k), secret), 0) + int(n)
        spans = pa.array(_with_spans(s, np.flatnonzero(best >= LEAST), best), pa.list_(SPAN))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), spans, pa.nulls(batch.num_rows, pa.list_(COUNT))], ["doc_id", "spans", "counts"])
    if batch is not None:
        rows = [{"step": k, "secret": secret, "n": n} for (k, secret), n in total.items()]
        yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.list_(SPAN)), pa.array([rows], pa.list_(COUNT))], ["doc_id", "spans", "counts"])


def _judge(batches: Iterator[pa.RecordBatch], net: CharNet | None) -> Iterator[pa.RecordBatch]:
    """Spans of each whole text: the base spans, and the open candidates whose likeliest window reaches the threshold."""
    for batch in slices(batches, "text"):
        s = _Slice(batch.column("text"))
        best = np.full(len(s.first), -np.inf)
        more = np.zeros(0, np.int64)
        if net:
            which, low = s.windows(np.flatnonzero(~s.known))
            np.maximum.at(best, which, net.logit_at(s.symbol, low, s.first[which], s.end[which]))
            more = np.flatnonzero(~s.known & (net.chance(best) >= net.threshold))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_with_spans(s, more, best), pa.list_(SPAN))], ["doc_id", "spans"])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text: str = "text", recall: float = 0.95) -> DataFrame:
    """Secrets of each whole text: doc_id and spans (kind, first, end in code points, end exclusive).

    Kinds 0 to 2 are the base patterns (assign, access, hex), whole matches, always kept. Kind 3
    is what the network adds: candidates (runs of token characters, 8 or more) that meet no base
    span and whose calibrated probability reaches the threshold; a long candidate counts as its
    likeliest window. Spans are ordered by start, then kind. Null counts as empty; texts without
    findings have an empty list; repeated rows are scanned alike; without enough labelled
    findings only the base patterns count. Other columns are not read.

    The network is fitted on all windows of three quarters of the texts. Calibration and the
    threshold, which keeps `recall` of the secrets, take all windows of the last quarter, as
    counts of their logits in steps of 1 / FINE. One pass makes these counts and the spans of
    all texts; only a threshold below LEAST, where most candidates lie, needs another.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    spans = "array<struct<kind: int, first: long, end: long{}>>"
    short = lambda c: F.transform(c, lambda s: F.struct(s["kind"].alias("kind"), s["first"].alias("first"), s["end"].alias("end"))).alias("spans")
    judged = lambda net: texts.mapInArrow(lambda b: _judge(b, net), f"doc_id {kind}, spans {spans.format(', logit: double')}").select("doc_id", short("spans"))
    net = train(texts)
    if net is None:
        return judged(None)
    scored = pin(texts.withColumn("held", _held()).mapInArrow(
        lambda b: _scored(b, net), f"doc_id {kind}, spans {spans.format(', logit: double')}, counts array<struct<step: long, secret: boolean, n: long>>"))
    counts = scored.filter("counts is not null").select(F.explode("counts").alias("c")).groupBy("c.step", "c.secret").agg(F.sum("c.n").alias("n"))
    rows = counts.orderBy("step", "secret").collect()
    z, y, n = (np.array([r[k] for r in rows], float) for k in ("step", "secret", "n"))
    if not 0 < y.sum() < len(y):
        return judged(None)
    net.calibrate_counts(z / FINE, y, n, recall)
    if net.least < LEAST:
        return judged(net)
    reached = F.filter("spans", lambda s: (s["kind"] < 3) | (s["logit"] >= net.least))
    return scored.filter("counts is null").select("doc_id", short(reached))


def listed(spans: str, base_only: bool = False):
    """The spans as kind:start:end, joined by commas."""
    chosen = F.filter(spans, lambda s: s["kind"] < 3) if base_only else F.col(spans)
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", name(s), s["first"].cast("string"), s["end"].cast("string"))), ",")
