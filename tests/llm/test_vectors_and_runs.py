"""Vector links, vector codes and periodic runs against plain versions, with odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import ODD

from duoframe.llm import codebooks, runs, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, node long, bucket string, key int, units string, far int, code int, n int, copies int"


def table(spark, rows):
    """Vectors with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, v, x, 1, "b", 2, "u", 3, 4, 5, 6) for i, v, x in rows], SCHEMA).repartition(3)


def clustered(n=400, dim=16, seed=2):
    """Vectors of three labels around few directions, so that many cosines lie near the limit."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, dim))
    out = []
    for i in range(n):
        v = centres[r.integers(6)] + r.normal(size=dim) * r.choice([0.02, 0.1, 0.15, 1.0])
        out.append((i, [float(np.float32(x)) for x in v * r.choice([0.5, 3.0])], int(r.integers(3))))
    return out


NAN, INF = float("nan"), float("inf")
ODD_VECTORS = [
    (1000, None, 0), (1001, [], 0), (1002, [0.0] * 16, 0), (1003, [1.0] * 15 + [None], 0), (1004, [1.0] * 15 + [NAN], 0), (1005, [1.0] * 15 + [INF], 0),
    (1006, [1.0] * 8, 0), (1007, [1.0] * 16, None), (1008, [2.0] * 16, None), (1009, [1e30] * 16, 2), (1010, [2e-30] * 16, 2), (None, [1e30] * 16, 2),
    (1011, [1.0] * 16, 2), (1011, [1.0] * 16, 2), (1011, [5.0] * 16, 2), (1012, [1.0] * 7, 2), (1013, [1.0] * 7, 2), (None, None, None),
]


# -- links

def brute_links(rows, least=0.98):
    def point(v):
        if not v or any(x is None or not np.isfinite(x) for x in v):
            return None
        v = np.array(v, np.float64)
        v = v / max(abs(v).max(), 1e-300)
        return v / np.linalg.norm(v) if v.any() else None

    points = [point(v) if label is not None else None for _, v, label in rows]
    root, n = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if points[a] is not None and points[b] is not None and rows[a][2] == rows[b][2] and len(points[a]) == len(points[b]) and points[a] @ points[b] >= least:
                n[a] += 1
                n[b] += 1
                root[find(a)] = find(b)
    low = {}
    for i, (vec_id, _, _) in enumerate(rows):
        if vec_id is not None:
            low[find(i)] = min(low.get(find(i), vec_id), vec_id)
    return sorted(((i, n[k], low.get(find(k)), i == low.get(find(k))) for k, (i, _, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("block", [1024, 7])
def test_links(spark, block, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "FEW", block // 2)
    rows = clustered() + ODD_VECTORS + [(2000 + i, v, x) for i, v, x in clustered()[:20]]  # equal vectors
    got = vectors.near_vectors(table(spark, rows)).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got), key=str) == brute_links(rows)
    assert vectors.near_vectors(table(spark, rows).filter("false")).count() == 0


def test_plan_keeps_the_promised_recall():
    assert abs(vectors.collision(8.0) - 0.9003) < 1e-3
    r = np.random.default_rng(3)
    a = r.normal(size=(4000, 32))
    a /= np.linalg.norm(a, axis=1)[:, None]
    side = r.normal(size=a.shape)
    side -= (side * a).sum(axis=1)[:, None] * a
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * side / np.linalg.norm(side, axis=1)[:, None]
    per_table, tables = vectors.table_plan(10_000, 0.98, 0.05)
    both = pa.record_batch({"node": np.arange(8000), "group": np.zeros(8000, np.int64), "vec": pa.array(np.concatenate([a, b]).tolist())})
    names = np.concatenate([np.array(x.column("buckets").to_pylist()) for x in vectors._hashed(iter([both]), per_table, tables, vectors.CELL * 0.2, 1)])
    missed = 1 - (names[:4000] == names[4000:]).any(axis=1).mean()
    assert 0.01 < missed < 0.07  # pairs exactly at the limit; closer ones are missed less


# -- codes

def brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [int(np.floor(np.float64(x) * 4096)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept = [r for r in kept if r[1] and len(r[1]) % parts == 0 and all(abs(x) < codebooks.LIMIT for x in r[1])]
    if not kept:
        return []
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dim = len(order[0][1])
    kept, order = ([r for r in x if len(r[1]) == dim] for x in (kept, order))
    first = {}
    for i, v, _ in order:
        first.setdefault(i, v)
    w = dim // parts
    books = [[v[k * w : (k + 1) * w] for v in list(first.values())[:entries]] for k in range(parts)]

    def assign(v):
        out = []
        for k in range(parts):
            part = v[k * w : (k + 1) * w]
            out.append(min((sum((x - y) ** 2 for x, y in zip(part, c)), e) for e, c in enumerate(books[k])))
        return out

    for _ in range(rounds):
        sums = {}
        for _, v, _ in kept:
            for k, (_, e) in enumerate(assign(v)):
                sums.setdefault((k, e), []).append(v[k * w : (k + 1) * w])
        for (k, e), members in sums.items():
            books[k][e] = [sum(c) // len(members) for c in zip(*members)]
    coded = [(i, label, assign(v)) for i, v, label in kept]
    total = {}
    for _, label, a in coded:
        total[label] = total.get(label, 0) + sum(d for d, _ in a)
    h = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((i, "".join(f"{e:02x}" for _, e in a), sum(d for d, _ in a), total[label], h) for i, label, a in coded), key=str)


@pytest.mark.parametrize("rows", [clustered() + ODD_VECTORS, clustered(9, 8) + [(3, [0.1] * 8, None)], [(1, None, 0)], ODD_VECTORS])
def test_codes(spark, rows):
    got = codebooks.encode_vectors(table(spark, rows)).collect()
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got), key=str) == brute_codes(rows)


def test_no_codes_of_an_empty_table(spark):
    assert codebooks.encode_vectors(table(spark, ODD_VECTORS).filter("false")).count() == 0


def test_pivots_prune_and_ties_go_to_the_lower_index():
    r = np.random.default_rng(4)
    book = r.integers(-3000, 3000, (16, 8))
    book[9] = book[2]
    points = book[r.integers(0, 16, 3000)] + r.integers(-300, 300, (3000, 8))
    pivots = codebooks.choose_pivots(book, 4)
    which, square, made = codebooks.nearest(points, codebooks.distances(points, pivots).astype(np.float32).astype(np.float64), book, pivots)
    every = ((points[:, None] - book[None]) ** 2).sum(axis=2)
    assert (which == every.argmin(axis=1)).all() and (square == every.min(axis=1)).all() and 9 not in which
    assert made < 0.3 * every.size  # most evaluations are ruled out by the bounds


# -- runs

def brute_runs(w):
    found = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def made_words(r):
    """Words of small alphabets with repeated stretches, repeated again inside longer ones."""
    out, k = [], r.choice([1, 2, 3, 5])
    while len(out) < r.choice([30, 100, 200]):
        u = [f"w{r.randrange(k)}" for _ in range(r.randint(1, 30))]
        out += u * r.randint(1, 8) if r.random() < 0.6 else u
        if r.random() > 0.8:
            out += out[: r.randint(1, len(out))] * r.randint(1, 4)
    return out


def test_runs_of_made_sequences():
    r = random.Random(5)
    for _ in range(300):
        w = made_words(r)
        numbers = {x: i for i, x in enumerate(dict.fromkeys(w))}
        assert runs.find_runs(np.array([numbers[x] for x in w])) == brute_runs(w)
    assert runs.find_runs(np.zeros(24, np.int64)) == [(0, 24, 1)] and runs.find_runs(np.zeros(23, np.int64)) == []


def test_suffixes():
    r = random.Random(8)
    for _ in range(30):
        w = [int(x[1:]) for x in made_words(r)]
        s = runs.Suffixes(np.array(w))
        assert [w[i:] for i in s.at] == sorted(w[i:] for i in range(len(w)))
        got = s.common(s.at[1:], s.at[:-1])
        for n, a, b in zip(got, s.at[1:], s.at[:-1]):
            assert w[a : a + n] == w[b : b + n] and w[a + n : a + n + 1] != w[b + n : b + n + 1]


def brute_document(doc_id, text, plant):
    w = [x for x in (text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\f", " ").replace("\r", " ").split(" ") if x]
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if plant and h % 10 == 0 and w:
        a = h // 10 % len(w)
        p = 1 + (len(w) - a) // (3 + h // 10 % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    found = brute_runs(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if found else (None, None, None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_documents(spark, odd, none):
    r = random.Random(9)
    texts = [r.choice([" ", "\n", "\t  "]).join(made_words(r)) + r.choice(["", " \x1c \xa0 é x"]) for _ in range(150)]
    rows = ODD + [(20 + i, t) for i, t in enumerate(texts)] + [(20, texts[0])]
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for plant in (True, False):
        got = runs.detect_runs(made, plant=plant)
        assert sorted((tuple(x) for x in got.drop("runs", "collapsed").collect()), key=str) == sorted((brute_document(i, t, plant) for i, t in rows), key=str)
    one = {x["doc_id"]: x for x in got.collect()}
    assert one[10]["runs"][0].asDict() == {"start": 0, "length": 3000, "period": 1} and one[10]["collapsed"] == "word"
    assert runs.detect_runs(odd).count() == len(ODD) and runs.detect_runs(none).count() == 0
