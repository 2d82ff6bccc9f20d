"""Periodic runs of words: maximal pairs from a bottom-up traversal of the LCP-interval tree."""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import BASE, INVERSE, mix, powers, slices

LEAST, TIMES = 24, 3  # a run has at least so many words and so many periods
# every run holds a string of so many words twice, one period apart: max(LEAST - q, (TIMES - 1) * q) at its least
SHARED = LEAST * (TIMES - 1) // TIMES


class Suffixes:
    """Sorted suffixes of a word sequence, by prefix doubling; only groups that still tie are sorted again.

    `levels[k]` ranks every position by its first 2**k words, so equal ranks are equal words.
    """

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.at = np.argsort(words, kind="stable")
        own = words[self.at]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if n else np.zeros(0, np.int64)
        rank = np.empty(n, np.int64)
        rank[self.at] = np.repeat(first, np.diff(np.append(first, n)))
        self.levels = [rank.astype(np.int32)]
        slots, h = np.arange(n), 1
        while True:
            group = rank[self.at[slots]]
            tied = np.zeros(len(slots), bool)
            tied[1:] = group[1:] == group[:-1]
            tied[:-1] |= tied[1:]
            slots, group = slots[tied], group[tied]
            if not len(slots):
                break
            place = self.at[slots]
            after = np.where(place + h < n, rank[np.minimum(place + h, n - 1)], -1)
            order = np.lexsort((after, group))
            place, after = place[order], after[order]
            fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (after[1:] != after[:-1])])
            self.at[slots] = place
            rank[place] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))]
            h *= 2
            self.levels.append(rank.astype(np.int32))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that the suffixes at a and b (not equal) have in common."""
        n, size = len(self.at), np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            i, j = a + size, b + size
            inside = np.maximum(i, j) < n
            level = self.levels[k]
            size += (inside & (level[np.minimum(i, n - 1)] == level[np.minimum(j, n - 1)])).astype(np.int64) << k
        return size


class _Node:
    """Positions below an LCP interval: in order, and by the word to their left (their class)."""

    __slots__ = ("size", "order", "classes")

    def __init__(self, size: int, order: list[int], classes: dict[int, int]):
        self.size, self.order, self.classes = size, order, classes

    def join(self, other: _Node, left: list[int], found: list[tuple[int, int, int]]) -> None:
        """Take in a child of this interval, and report the pairs that are maximal here and close enough.

        Positions of two children differ in the word after the common part; of two classes, in the
        word before. Two occurrences of a string at a distance of its half at most repeat its period, so of
        all partners of a position within that distance the next on either side is one period away; those
        beyond are one of the multiples. So each position of the smaller side looks at its
        neighbours on the other, and only if that has a class that is not its own.
        """
        size = self.size
        small, big = (other, self) if len(other.order) <= len(self.order) else (self, other)
        order, only = big.order, len(big.classes) == 1
        for p in small.order:
            x = left[p]
            if only and x in big.classes:
                continue
            k = bisect_left(order, p)
            if k and 2 * (p - order[k - 1]) <= size and left[order[k - 1]] != x:
                found.append((order[k - 1], p - order[k - 1] + size, p - order[k - 1]))
            if k < len(order) and 2 * (order[k] - p) <= size and left[order[k]] != x:
                found.append((p, order[k] - p + size, order[k] - p))
        if len(small.order) < 8:
            for p in small.order:
                insort(order, p)
        else:
            order.extend(small.order)
            order.sort()
        for c, n in small.classes.items():
            big.classes[c] = big.classes.get(c, 0) + n
        self.order, self.classes = big.order, big.classes


def maximal_pairs(places: list[int], common: list[int], left: list[int]) -> list[tuple[int, int, int]]:
    """Maximal pairs of one subtree as (start, distance + common words, distance), distance at most half of the common words.

    places: sorted suffixes; common[t]: words that suffix t shares with the one before it (t > 0).
    """
    found: list[tuple[int, int, int]] = []
    stack: list[_Node] = []
    for t in range(1, len(places) + 1):
        node = _Node(1 << 62, [places[t - 1]], {left[places[t - 1]]: 1})
        size = common[t] if t < len(places) else 0
        while stack and stack[-1].size > size:
            stack[-1].join(node, left, found)
            node = stack.pop()
        if stack and stack[-1].size == size:
            stack[-1].join(node, left, found)
        elif t < len(places):
            stack.append(_Node(size, node.order, node.classes))
    return found


def find_runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence of word numbers, by start, then period."""
    if len(words) < LEAST:
        return []
    suffixes = Suffixes(words)
    deep = SHARED.bit_length() - 1  # levels[deep] ranks by SHARED words if that is a power of two, by fewer otherwise
    if len(suffixes.levels) <= deep:
        return []
    group = suffixes.levels[deep][suffixes.at]
    same = np.flatnonzero(group[1:] == group[:-1]) + 1
    if not len(same):
        return []
    common = np.zeros(len(words), np.int64)
    common[same] = suffixes.common(suffixes.at[same - 1], suffixes.at[same])
    left = np.concatenate([[-1], words[:-1]]).tolist()
    cuts = np.flatnonzero(np.diff(same) > 1) + 1
    shortest: dict[tuple[int, int], int] = {}
    for own in np.split(same, cuts):
        span = slice(int(own[0]) - 1, int(own[-1]) + 1)
        for start, length, period in maximal_pairs(suffixes.at[span].tolist(), common[span].tolist(), left):
            if length >= LEAST:  # and at least TIMES periods, by the distance of the pair
                shortest[start, length] = min(period, shortest.get((start, length), period))
    return sorted((start, length, period) for (start, length), period in shortest.items())


def _repeating(lists: list[list[bytes]]) -> np.ndarray:
    """Which word lists hold a string of SHARED words twice, by 64-bit hashes; none that does is missed."""
    out = np.zeros(len(lists), bool)
    count = np.array([len(x) for x in lists])
    doc = np.repeat(np.arange(len(lists)), count)
    n = len(doc)
    if n < SHARED:
        return out
    value = mix(np.fromiter((hash(w) for x in lists for w in x), np.int64, n).view(np.uint64))
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(value * powers(INVERSE, n), out=prefix[1:])
    gram = (prefix[SHARED:] - prefix[:-SHARED]) * powers(BASE, n - SHARED + 1)
    inside = np.flatnonzero(doc[: n - SHARED + 1] == doc[SHARED - 1 :])
    gram = mix(gram[inside]) ^ mix(doc[inside].astype(np.uint64))
    order = np.argsort(gram)
    gram = gram[order]
    out[doc[inside[order[1:][gram[1:] == gram[:-1]]]]] = True
    return out


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with the periodic tail that the checksum of the id asks for; a null id asks for none."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def _number(lists: list[list[bytes]]) -> np.ndarray:
    """Numbers of the words; words of different lists have different numbers, so nothing repeats across lists."""
    numbers: list[int] = []
    at = 0
    for words in lists:
        own: dict[bytes, int] = {}
        numbers.extend([own.setdefault(w, at + len(own)) for w in words])
        at += len(own)
    return np.array(numbers, np.int64)


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period, joined by one space."""
    if runs:
        change = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            change[start + period] += 1
            change[start + length] -= 1
        keep = np.cumsum(change[:-1]) == 0
        words = [words[i] for i in np.flatnonzero(keep).tolist()]
    return b" ".join(words)


def _best(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    best = runs[0]
    for run in runs[1:]:  # by start, then period: a later one must be strictly greater
        if run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


FIELDS = [("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]


def _detect(batches: Iterator[pa.RecordBatch], plant: bool, with_text: bool) -> Iterator[pa.RecordBatch]:
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for batch in slices(batches, "text"):
        ids = batch.column("doc_id").to_pylist()
        lists = [(t or "").encode().split() for t in batch.column("text").to_pylist()]  # bytes split at the six ASCII white spaces
        changed = [planted(w, i) for w, i in zip(lists, ids)] if plant else lists
        search = np.flatnonzero(_repeating(changed)).tolist()
        at = np.cumsum([0] + [len(changed[i]) for i in search])
        runs: dict[int, list[tuple[int, int, int]]] = {}
        for start, length, period in find_runs(_number([changed[i] for i in search])):
            k = int(np.searchsorted(at, start, "right")) - 1
            runs.setdefault(search[k], []).append((start - int(at[k]), length, period))
        rows, texts, listed = [], [], []
        for i, words in enumerate(changed):
            own = runs.get(i, [])
            kept = collapse(words, own)
            best = _best(own) if own else (None, None, None)
            told = "".join(f"{s},{n},{q}\n" for s, n, q in own)
            rows.append((len(own), *best, 1000 * best[1] // best[2] if own else None, sha(told.encode()), sha(kept)))
            if with_text:
                texts.append(kept.decode())
                listed.append([{"start": s, "length": n, "period": q} for s, n, q in own])
        columns = [pa.array(c, kind) for c, (_, kind) in zip(zip(*rows), FIELDS)]
        names = [n for n, _ in FIELDS]
        if with_text:
            run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            columns, names = [*columns, pa.array(listed, run), pa.array(texts, pa.string())], [*names, "runs", "collapsed"]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *names])


def detect_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", plant: bool = False, with_text: bool = True) -> DataFrame:
    """Periodic runs of the words of each whole text, and the text without their repetitions.

    Words are what stands between the characters space and \\x09 to \\x0D. A run is a stretch
    of consecutive words with smallest period q and at least max(24, 3 q) words that no
    neighbouring word extends. Returns one row per row: doc_id, n_runs; start, length, period
    and exponent_milli (1000 * length / period, floored) of the run with the greatest length /
    period (ties: smallest start, then period; null without a run); runs_sha256 (of
    "start,length,period\\n" of every run by start, then period) and collapsed_sha256 (of the
    words that no run contains after its first q words, joined by one space). with_text
    adds the runs and the collapsed text themselves. Null counts as empty: no runs, and the
    checksums of nothing. Repeated rows give equal rows; other columns are not read.

    plant: before, every text whose id's checksum is a multiple of 10 gets a periodic tail, as
    `planted` says (a test of the operator on texts of which few have runs).

    The suffixes of the words are sorted, and the LCP intervals visited from the leaves up,
    each with the positions below it and the words left of them. A pair of positions whose
    common string no word extends on either side, and that are at most half of it apart, is
    a run; of pairs with one start and end the smallest distance is the period. Texts in
    which no string of 16 words occurs twice, by its hash, cannot hold a run and are not sorted. A text is
    one row and is handled in one piece, with memory in proportion to its words times the
    logarithm of their number.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    extra = ", runs array<struct<start: long, length: long, period: long>>, collapsed string" if with_text else ""
    fields = f"doc_id {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string{extra}"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).mapInArrow(lambda b: _detect(b, plant, with_text), fields)
