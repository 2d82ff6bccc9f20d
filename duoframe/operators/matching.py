"""Two nearest descriptors with ratio test, on any vector column (F16)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import is_empty, pin, union_all

BLOCK = 1 << 15  # rows of either side that one task meets
LEAST, TASKS = 4096, 32  # rows of either side that a task meets at least, while there are so many tasks
LEAF = 1 << 16  # targets of a node that is not split; twice a block, since a split gives leaves of half of it
FAN = 32  # children of a node, at most
MEET = 4096  # rows that meet the children of their node at once
ROWS, CELL, CELLS = 2048, 256, 32  # inside a task: rows at a time, targets of a cell on average, and cells at most
PAIRS = 1 << 18  # pairs of a task whose exact distances are made at a time
DEPTH = 11  # levels whose numbers fit a bigint; larger leaves below are visited in blocks


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0.0)


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _meet_children(rows: DataFrame, level: DataFrame, keys: list[str], id_col: str, block: int, pick: Callable, more: str = "", evaluated=None) -> DataFrame:
    """Hand the rows at the nodes of a level to those children that pick chooses.

    pick(distances, rows, children) returns positions of rows and of children. Rows meet the
    children of their node in parts of about block rows. Returns the columns of rows with node
    replaced by the child, and dist if more asks for it.
    """
    side = [*keys, "node"]
    rows = pin(rows)
    parts = pin(rows.groupBy(*side).agg(F.ceil(F.count("*") / min(block, MEET)).cast("int").alias("_parts")))
    a = rows.join(parts, side).withColumn("_part", F.pmod(F.xxhash64(id_col), F.col("_parts")).cast("int")).drop("_parts")
    b = level.join(parts, side).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    names = [*rows.columns, *(["dist"] if more else [])]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame([], columns=names)
        right = right.sort_values("child")
        d = np.sqrt(_squared(_stack(left["vec"]), _stack(right["pivot"])))
        if evaluated is not None:
            evaluated.add(d.size)
        i, j = pick(d, left, right)
        out = left.iloc[i].copy()
        out["node"], out["dist"] = right["child"].to_numpy()[j], d[i, j]
        return out[names]

    by = [*side, "_part"]
    return a.groupBy(*by).cogroup(b.groupBy(*by)).applyInPandas(run, _ddl(rows) + more)


def _nearest_child(d: np.ndarray, left: pd.DataFrame, right: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return np.arange(len(d)), d.argmin(axis=1)


def _with_slack(bound: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Bounds of vectors of these norms that also cover the rounding of distances."""
    return bound + 1e-6 * (1 + np.where(np.isfinite(bound), bound, 0)) + 1e-7 * norm


def _children_in_reach(d: np.ndarray, left: pd.DataFrame, right: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Children whose ball reaches inside the bound."""
    reach = _with_slack(left["bound"].to_numpy(), np.linalg.norm(_stack(left["vec"]), axis=1))
    return np.nonzero(d - right["radius"].to_numpy()[None, :] <= reach[:, None])


def _cells(y: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Pivots among the vectors of a block, the positions nearest to each of them, and the radius of each cell."""
    n = min(CELLS, max(1, len(y) // CELL))
    pivots = y[np.argsort(ids, kind="stable")[np.linspace(0, len(y) - 1, n).astype(int)]]
    d = np.sqrt(_squared(y, pivots))
    own = d.argmin(axis=1)
    members = [np.flatnonzero(own == k) for k in range(n)]
    kept = [k for k in range(n) if len(members[k])]
    return pivots[kept], [members[k] for k in kept], np.array([d[members[k], k].max() for k in kept])


def _merge(best_d: np.ndarray, best_t: np.ndarray, xs: np.ndarray, y: np.ndarray, ids: np.ndarray, row: np.ndarray, who: np.ndarray) -> None:
    """Take some pairs of rows and targets, by their exact distances, into the two best of the rows."""
    for first in range(0, len(row), PAIRS):
        r, w = row[first : first + PAIRS], who[first : first + PAIRS]
        own = np.unique(r)
        every_r = np.r_[np.repeat(own, 2), r]
        every_d = np.r_[best_d[own].ravel(), np.sqrt(((xs[r] - y[w]) ** 2).sum(axis=1))]
        every_t = np.r_[best_t[own].ravel(), ids[w]]
        order = np.lexsort((every_t, every_d, every_r))
        at = np.searchsorted(every_r[order], own)
        top = order[at[:, None] + np.arange(2)]
        best_d[own], best_t[own] = every_d[top], every_t[top]


def _two_closest(x: np.ndarray, bound: np.ndarray, y: np.ndarray, ids: np.ndarray, evaluated=None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances of the two nearest targets of each row, by distance and id; infinite distance where the bound leaves none.

    Products in single precision, taken from the pivot of a cell and scaled to at most 1, find the
    pairs that can be within the bound, with their rounding added to it; only those get distances.
    """
    pivots, members, radius = _cells(y, ids)
    d, t = np.full((len(x), 2), np.inf), np.zeros((len(x), 2), ids.dtype)
    unit, cells = [], []
    for k, own in enumerate(members):
        c = y[own] - pivots[k]
        unit.append(np.linalg.norm(c, axis=1).max() or 1.0)
        c /= unit[k]
        cells.append(np.c_[c, -0.5 * (c * c).sum(axis=1)].astype(np.float32).T)
    counted = len(y) * len(pivots)
    for first in range(0, len(x), ROWS):
        part = slice(first, first + ROWS)
        xs, limit, best_d, best_t = x[part], bound[part].copy(), d[part], t[part]
        norm, rounding = np.linalg.norm(xs, axis=1), (x.shape[1] + 8) * 2.0**-23
        away = np.sqrt(_squared(xs, pivots))
        home = np.where(np.isfinite(norm), away.argmin(axis=1), -1)
        counted += away.size
        for at_home in (True, False):  # the nearest cell of a row gives the bound for its other cells
            for k, own in enumerate(members):
                rows = np.flatnonzero(home == k if at_home else (home >= 0) & (home != k) & (away[:, k] - radius[k] <= _with_slack(limit, norm)))
                if not len(rows):
                    continue
                c = xs[rows] - pivots[k]
                far = np.sqrt(np.einsum("ij,ij->i", c, c))
                wide = max(far.max(), unit[k])
                a = np.full((len(rows), c.shape[1] + 1), unit[k] / wide, np.float32)
                a[:, :-1] = c / wide
                score = a @ cells[k]  # (product of row and target - half the square of the target) / (wide * unit): the larger, the nearer
                counted += score.size
                reach = limit[rows]
                new = np.flatnonzero(np.isinf(reach))
                if len(new) and len(own) > 1:  # the likeliest two give a first bound
                    who = own[np.argpartition(score[new], len(own) - 2, axis=1)[:, -2:]]
                    reach[new] = np.sqrt(((xs[rows[new]][:, None, :] - y[who]) ** 2).sum(axis=2)).max(axis=1)
                reach = _with_slack(reach, norm[rows])
                least = (far / wide * (far / unit[k]) - reach / wide * (reach / unit[k])) / 2
                least -= rounding * (far + unit[k]) / wide + 1e-6 * np.where(np.isfinite(least), np.abs(least), 0) + 1e-30
                near = np.flatnonzero((score.max(axis=1) >= least) & (reach >= 0))
                i, j = np.nonzero(score[near] >= least[near, None])
                _merge(best_d, best_t, xs, y, ids, rows[near[i]], own[j])
                limit[rows] = np.minimum(limit[rows], best_d[rows, 1])
    if evaluated is not None:
        evaluated.add(counted)
    return t, d


def _grow(targets: DataFrame, keys: list[str], leaf: int, fan: int, block: int, evaluated=None) -> tuple[DataFrame, list[DataFrame]]:
    """A tree of pivots per group: the targets with their leaf (node), and the levels.

    A level lists keys, node, child, pivot and the radius of the child. Nodes of more than leaf
    targets are split between fan of their different vectors, chosen by hash, so the tree
    deepens only where a group is large.
    """
    side = [*keys, "node"]
    rows, settled, levels = pin(targets.withColumn("node", F.lit(0).cast("bigint"))), [], []
    for depth in range(DEPTH):
        large = pin(rows.groupBy(*side).agg(F.count("*").alias("_n")).filter(F.col("_n") > leaf))
        if is_empty(large):
            break
        settled.append(rows.join(large, side, "left_anti"))
        open_rows = rows.join(large, side)
        # no more children than leaves of half the size need, since a row may be handed to each of them
        many = F.least(F.lit(fan), F.ceil(2 * F.col("_n") / leaf))
        order = Window.partitionBy(*side).orderBy(F.xxhash64("vec", F.lit(depth)), "t_id")
        pivots = open_rows.filter("copy = 1").withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= fan).filter(F.col("_k") <= many)
        pivots = pin(pivots.select(*side, (F.col("node") * fan + F.col("_k")).alias("child"), F.col("vec").alias("pivot")))
        dealt = pin(_meet_children(open_rows.drop("_n"), pivots, keys, "t_id", block, _nearest_child, ", dist double", evaluated))
        radius = dealt.groupBy(*keys, F.col("node").alias("child")).agg(F.max("dist").alias("radius"))
        levels.append(pin(pivots.join(radius, [*keys, "child"])))
        rows = dealt.drop("dist")
    return union_all(*settled, rows), levels


def _descend(rows: DataFrame, levels: list[DataFrame], keys: list[str], block: int, pick: Callable, evaluated=None) -> DataFrame:
    """Rows at the leaves that they reach from the roots."""
    side, at_leaf = [*keys, "node"], []
    rows = rows.withColumn("node", F.lit(0).cast("bigint"))
    for level in levels:
        rows = pin(rows)
        inner = level.select(*side).distinct()
        at_leaf.append(rows.join(inner, side, "left_anti"))
        rows = _meet_children(rows.join(inner, side, "left_semi"), level, keys, "q_id", block, pick, evaluated=evaluated)
    return union_all(*at_leaf, rows)


def two_nearest(
    queries: DataFrame, targets: DataFrame, keys: Sequence[str], block: int = BLOCK, leaf: int = LEAF, fan: int = FAN, evaluated=None
) -> DataFrame:
    """The two nearest targets of each query inside its group: keys, q_id, t_id, d1, d2.

    queries: keys, q_id, vec; targets: keys, t_id, vec. Exact; of equal distances the smallest
    t_id wins. Every group has its own tree of pivots, which grows with the group. A first way
    down, always to the nearest pivot, gives a bound of the second distance; the second way
    down visits, by the triangle inequality, only the nodes that reach inside that bound.
    Leaves are large, because every query is sent to each leaf that it visits: they meet their
    queries in blocks of at most about block rows on either side, so no task grows with a group.
    Inside a block the same bound is used on cells of its targets, and each block emits at most
    two rows per query. Of equal targets only the first two are searched, since no more can be
    among the answers. A group of one target has no d2; rows without a vector, and queries of
    groups without targets, have no answer. evaluated: an accumulator that counts the distances.
    """
    keys = list(keys)
    copy = F.row_number().over(Window.partitionBy(*keys, "vec").orderBy("t_id"))
    t0 = targets.filter("vec is not null").select(*keys, "t_id", "vec").withColumn("copy", copy).filter("copy <= 2")
    t, levels = _grow(t0, keys, leaf, fan, block, evaluated)
    t = pin(t.drop("copy")) if levels else t.drop("copy")
    leaves = pin(t.groupBy(*keys, "node").agg(F.count("*").alias("n_t")))
    q = queries.filter("vec is not null").select(*keys, "q_id", "vec")
    home = pin(_descend(q, levels, keys, block, _nearest_child, evaluated))
    found = _two_per_query(_visit(home, t, leaves, keys, block, evaluated), keys)
    if levels:
        found = pin(found)
        bound = found.groupBy(*keys, "q_id").agg(F.when(F.count("*") >= 2, F.max("dist")).otherwise(float("inf")).alias("bound"))
        reached = _descend(q.join(bound, [*keys, "q_id"]), levels, keys, block, _children_in_reach, evaluated)
        others = reached.join(home.select(*keys, "q_id", "node"), [*keys, "q_id", "node"], "left_anti")
        found = _two_per_query(found.unionByName(_two_per_query(_visit(others, t, leaves, keys, block, evaluated), keys)), keys)
    top = found.groupBy(*keys, "q_id").agg(
        F.min(F.struct("dist", "t_id")).alias("_a"), F.max(F.struct("dist", "t_id")).alias("_b"), F.count("*").alias("_n")
    )
    return top.select(
        *keys, "q_id", F.col("_a.t_id").alias("t_id"), F.col("_a.dist").alias("d1"), F.when(F.col("_n") > 1, F.col("_b.dist")).alias("d2")
    )


def _two_per_query(rows: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys, "q_id").orderBy("dist", "t_id")
    return rows.withColumn("_k", F.row_number().over(w)).filter("_k <= 2").drop("_k")


def _visit(visits: DataFrame, targets: DataFrame, leaves: DataFrame, keys: list[str], block: int, evaluated=None) -> DataFrame:
    """Two nearest targets of each visiting query in each block of its leaf; with a column bound, only those within it."""
    side = [*keys, "node"]
    visits = pin(visits if "bound" in visits.columns else visits.withColumn("bound", F.lit(float("inf"))))
    met = pin(leaves.join(visits.groupBy(*side).agg(F.count("*").alias("n_q")), side))
    # a row is sent to every block of the other side, so both sides of a block are alike, and as large as the tasks allow
    pairs = met.agg(F.sum(F.col("n_q").cast("double") * F.col("n_t"))).first()[0] or 0.0
    rows = int(min(block, max(LEAST, (pairs / TASKS) ** 0.5)))
    sizes = met.select(*side, F.ceil(F.col("n_t") / rows).cast("int").alias("_nt"), F.ceil(F.col("n_q") / rows).cast("int").alias("_nq"))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = visits.join(sizes, side).withColumn("_bq", part("q_id", "_nq")).withColumn("_bt", every("_nt"))
    t = targets.join(sizes, side).withColumn("_bt", part("t_id", "_nt")).withColumn("_bq", every("_nq"))
    key_ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in visits.select(*keys).schema)

    def run(group: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names = [*keys, "q_id", "t_id", "dist"]
        if a.empty or b.empty:
            return pd.DataFrame([], columns=names)
        t_id, dist = _two_closest(_stack(a["vec"]), a["bound"].to_numpy(float), _stack(b["vec"]), b["t_id"].to_numpy(), evaluated)
        row, k = np.nonzero(np.isfinite(dist))
        out = {n: pd.Series([v] * len(row), dtype=object) for n, v in zip(keys, group)}
        return pd.DataFrame({**out, "q_id": a["q_id"].to_numpy()[row], "t_id": t_id[row, k], "dist": dist[row, k]})[names]

    by = [*side, "_bq", "_bt"]
    return (
        q.select(*by, "q_id", "vec", "bound").groupBy(*by)
        .cogroup(t.select(*by, "t_id", "vec").groupBy(*by))
        .applyInPandas(run, f"{key_ddl}q_id bigint, t_id bigint, dist double")
    )


def ratio_test(pairs: DataFrame, ratio: float = 0.7) -> DataFrame:
    """F16: matches whose nearest target is clearly nearer than the second one."""
    return pairs.filter(F.col("d1") < ratio * F.col("d2"))
