"""The pivot trees of the descriptor match against brute force (F16)."""

import numpy as np

from duoframe.operators import matching
from duoframe.operators.matching import two_nearest

SIDE = "g string, {} bigint, vec array<double>"


def _frames(spark, queries, targets):
    rows = lambda side: [(g, i, None if p is None else [float(v) for v in p]) for g, ps in side.items() for i, p in enumerate(ps)]
    return spark.createDataFrame(rows(queries), SIDE.format("q_id")), spark.createDataFrame(rows(targets), SIDE.format("t_id"))


def _brute(q, t):
    """Position of the nearest target, by distance and position, and both distances."""
    out = []
    for p in q:
        d = np.sqrt(((t - p) ** 2).sum(axis=1))
        a = sorted(zip(d, range(len(t))))[:2]
        out.append((a[0][1], a[0][0], a[1][0] if len(a) > 1 else None))
    return out


def _check(got, group, q, t):
    own = got[got.g == group].set_index("q_id")
    assert len(own) == len(q)
    for i, (t_id, d1, d2) in enumerate(_brute(q, t)):
        row = own.loc[i]
        assert row.t_id == t_id and abs(row.d1 - d1) < 1e-9
        assert np.isnan(row.d2) if d2 is None else abs(row.d2 - d2) < 1e-9


def test_groups_of_all_sizes_at_several_depths(spark):
    r = np.random.default_rng(3)
    centres = r.normal(0, 10, (9, 6))
    cloud = lambda n: centres[r.integers(0, 9, n)] + r.normal(0, 0.3, (n, 6))
    t = {"large": np.r_[cloud(400), np.full((60, 6), 2.0)], "far": 1e4 + cloud(150), "one": cloud(1), "equal": np.full((50, 6), 1.0)}
    q = {"large": np.r_[cloud(80), r.normal(0, 10, (20, 6)), np.full((2, 6), 2.0)], "far": 1e4 + cloud(30), "one": cloud(3), "equal": cloud(2)}
    qd, td = _frames(spark, {**q, "none": cloud(4), "null": [None]}, {**t, "null": [None]})
    for leaf, fan, block in ((16, 4, 64), (10_000, 32, 2048)):
        got = two_nearest(qd, td, ["g"], block=block, leaf=leaf, fan=fan).toPandas()
        assert set(got.g) == set(q)
        for g in q:
            _check(got, g, q[g], t[g])


def test_clustered_vectors_need_few_distances(spark):
    r = np.random.default_rng(4)
    n, centres = 6000, r.normal(0, 10, (150, 12))
    cloud = lambda: centres[r.integers(0, 150, n)] + r.normal(0, 0.2, (n, 12))
    q, t = cloud(), cloud()
    count = spark.sparkContext.accumulator(0)
    got = two_nearest(*_frames(spark, {"a": q}, {"a": t}), ["g"], leaf=64, fan=16, evaluated=count).toPandas()
    _check(got[got.q_id < 200], "a", q[:200], t)
    assert n < count.value < n**1.7


def test_empty_sides(spark):
    q, t = _frames(spark, {"a": np.ones((2, 3))}, {"a": np.ones((2, 3))})
    assert two_nearest(q.limit(0), t, ["g"]).count() == 0 and two_nearest(q, t.limit(0), ["g"]).count() == 0


def test_vectors_without_clusters_are_sent_to_few_leaves(spark, monkeypatch):
    """Where every ball reaches every bound a query visits all leaves, so they must be few: no copy of it for each thousand targets."""
    r = np.random.default_rng(5)
    q, t = r.normal(0, 1, (3000, 32)), r.normal(0, 1, (4000, 32))
    sent, visit = [], matching._visit
    monkeypatch.setattr(matching, "_visit", lambda visits, *more: (sent.append(visits.count()), visit(visits, *more))[1])
    got = two_nearest(*_frames(spark, {"a": q}, {"a": t}), ["g"]).toPandas()
    _check(got[got.q_id < 100], "a", q[:100], t)
    assert len(got) == 3000 and sum(sent) <= 2 * 3000


def test_cells_of_a_block_give_the_exact_two():
    r = np.random.default_rng(6)
    for spread in (0.1, 10):  # the cells are skipped, or all met
        centres = r.normal(0, 3, (20, 8))
        y, x = (centres[r.integers(0, 20, n)] + r.normal(0, spread, (n, 8)) for n in (3000, 500))
        y[1500:1510] = x[:10]  # equal distances of 0 beside the copies
        y[1510:1520] = x[:10]
        ids = r.permutation(9000)[:3000]
        d = np.sqrt(((x[:, None, :] - y[None]) ** 2).sum(axis=2))
        first = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :2]
        want = np.take_along_axis(d, first, 1)
        t, dist = matching._two_closest(x, np.full(500, np.inf), y, ids)
        assert (t == ids[first]).all() and np.allclose(dist, want)
        near = want[:, 1] * 1.01 > r.random(500) * 2 * want[:, 1].max()  # some bounds leave both, others none
        t, dist = matching._two_closest(x, np.where(near, want[:, 1], -1.0), y, ids)
        assert (t[near] == ids[first][near]).all() and np.isinf(dist[~near & (want[:, 0] > 0.1)]).all()


def test_targets_of_two_blocks_need_no_tree(spark, monkeypatch):
    """More targets than a block holds are met in blocks at once: a query is not sent down a tree a second time."""
    r = np.random.default_rng(8)
    q, t = r.normal(0, 1, (1500, 12)), r.normal(0, 1, (40_000, 12))
    sent, visit = [], matching._visit
    monkeypatch.setattr(matching, "_visit", lambda visits, *more: (sent.append(visits.count()), visit(visits, *more))[1])
    got = two_nearest(*_frames(spark, {"a": q}, {"a": t}), ["g"]).toPandas()
    assert sum(sent) == 1500 == len(got)
    own = got.set_index("q_id")
    for i in range(0, 1500, 30):
        d = np.sqrt(((t - q[i]) ** 2).sum(axis=1))
        assert own.t_id[i] == d.argmin() and np.allclose(np.sort(d)[:2], own.loc[i, ["d1", "d2"]].astype(float))


def test_products_in_single_precision_leave_the_exact_two():
    """Distances that single precision cannot tell apart, far from the origin, tiny and huge ones, and a query that is not finite."""
    r = np.random.default_rng(9)
    for offset, spread, unit in ((0, 1, 1), (1e4, 1e-3, 1), (0, 1, 1e-25), (0, 1, 1e25)):
        y = unit * (offset + np.repeat(r.normal(0, 1, (3, 10)), 700, axis=0) + r.normal(0, spread, (2100, 10)))
        y[100:400] = y[100] + unit * 1e-9 * r.normal(0, 1, (300, 10))  # nearly equal targets
        x = np.r_[y[::21] + unit * 1e-3 * spread * r.normal(0, 1, (100, 10)), np.full((1, 10), np.nan)]
        ids = r.permutation(2100)
        t, dist = matching._two_closest(x, np.full(101, np.inf), y, ids)
        for i in range(100):
            d = np.sqrt(((y - x[i]) ** 2).sum(axis=1))
            first = np.lexsort((ids, d))[:2]
            assert (t[i] == ids[first]).all() and (dist[i] == d[first]).all()
        assert not np.isfinite(dist[100]).any()
