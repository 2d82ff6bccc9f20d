"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

All thresholds share one weight per feature: P(grade > k) = 1 / (1 + exp(cut_k - w.x)) with
cut_0 < cut_1 < ..., and the expected severity is the sum of these over k. Features are words
and the first bytes of words, as log(1 + count).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import pin
from .bagminhash import bag
from .textbytes import Words, slices

PREFIXES = (4, 6)
GRADES = 4


@dataclass
class OrdinalModel:
    """Feature names (sorted 64-bit hashes), their weights, ordered cuts, and the least P(grade > 0) that rejects."""

    names: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    cuts: np.ndarray = field(default_factory=lambda: np.full(GRADES - 1, np.inf))
    reject: float = 2.0
    held_out: dict = field(default_factory=dict)

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and cut."""
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(self.cuts - score[:, None]))


def _features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Row and name of every word and word start."""
    size = words.end - words.start
    rows, names = [words.doc], [words.hash]
    for k in PREFIXES:
        long = np.flatnonzero(size >= k)
        rows.append(words.doc[long])
        names.append(words.head(long, k))
    return np.concatenate(rows), np.concatenate(names)


def _known(rows: np.ndarray, found: np.ndarray, names: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and index of the features that the model has; seen: 2**20 flags by the hash's upper bits."""
    maybe = np.flatnonzero(seen[(found >> np.uint64(44)).astype(np.int64)])
    at = np.searchsorted(names, found[maybe])
    good = names[np.minimum(at, len(names) - 1)] == found[maybe] if len(names) else np.zeros(0, bool)
    return rows[maybe][good], at[good]


def _flags(names: np.ndarray) -> np.ndarray:
    seen = np.zeros(1 << 20, bool)
    seen[(names >> np.uint64(44)).astype(np.int64)] = True
    return seen


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        rows, names = _features(Words(batch.column("text")))
        rows, names, _ = bag(rows, names)
        yield pa.RecordBatch.from_arrays([batch.column("toxic").take(pa.array(rows)), pa.array(names.view(np.int64))], ["toxic", "name"])


def fit_ordinal(x_row: np.ndarray, x_name: np.ndarray, x: np.ndarray, grade: np.ndarray, n_names: int, decay: float = 1e-3, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered cuts that maximise the likelihood of the grades, by Adam on the whole sample."""
    n = len(grade)
    share = np.array([np.clip((grade > k).mean(), 1e-3, 1 - 1e-3) for k in range(GRADES - 1)])
    start = -np.log(share / (1 - share))
    # cuts as the first one and the logarithms of the positive gaps keep their order
    p = np.concatenate([np.zeros(n_names), [start[0]], np.log(np.maximum(np.diff(start), 0.1))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    weight = np.where(grade > 0, 0.5 / max((grade > 0).mean(), 1e-6), 0.5 / max((grade == 0).mean(), 1e-6)) / n
    for t in range(1, rounds + 1):
        w, gaps = p[:n_names], np.exp(p[n_names + 1 :])
        cuts = p[n_names] + np.concatenate([[0], np.cumsum(gaps)])
        score = np.bincount(x_row, w[x_name] * x, n)
        cdf = np.concatenate([np.zeros((n, 1)), 1 / (1 + np.exp(np.clip(score[:, None] - cuts, -40, 40))), np.ones((n, 1))], axis=1)
        slope = cdf * (1 - cdf)
        i = np.arange(n)
        mass = np.maximum(cdf[i, grade + 1] - cdf[i, grade], 1e-12)
        up, low = weight * slope[i, grade + 1] / mass, weight * slope[i, grade] / mass
        by_score = up - low  # of the negative log likelihood
        by_cut = np.array([-(up[grade == k].sum()) + low[grade == k + 1].sum() for k in range(GRADES - 1)])
        tail = np.cumsum(by_cut[::-1])[::-1]
        g = np.concatenate([np.bincount(x_name, by_score[x_row] * x, n_names) + decay * w, [tail[0]], tail[1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return p[:n_names], p[n_names] + np.concatenate([[0], np.cumsum(np.exp(p[n_names + 1 :]))])


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 4000, features: int = 2000, id_col: str = "doc_id", text: str = "text") -> OrdinalModel:
    """Fit on a bounded sample of labelled documents.

    About per_class documents of either value of `toxic` are taken, by the hash of their id,
    and the `features` words and word starts that tell the classes apart best. The labels have
    no severity, so the grades of toxic documents are thirds of how many such words they hold.
    A fifth of the sample is held out to choose the rejecting probability (the best F1).
    Rows without id, text or label are not used; repeated labels of an id count as the highest.
    Without both classes the model grades everything 0.
    """
    one = labels.filter(f"{id_col} is not null and toxic is not null").groupBy(id_col).agg(F.max("toxic").cast("int").alias("toxic"))
    one = pin(one.select(F.col(id_col).alias("id"), "toxic"))
    sizes = {r["toxic"]: r["n"] for r in one.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return OrdinalModel()
    spot = F.pmod(F.xxhash64(F.col("id"), F.lit(6)), F.lit(1_000_003))
    bound = F.when(F.col("toxic") > 0, int(1_000_003 * per_class / sizes[1]) + 1).otherwise(int(1_000_003 * per_class / sizes[0]) + 1)
    sample = one.filter(spot < bound)  # about 2 * per_class short rows
    chosen = pin(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(F.broadcast(sample), "id").filter("text is not null"))
    n1, n0 = (chosen.filter(f"toxic = {k}").count() for k in (1, 0))
    if not n1 or not n0:
        return OrdinalModel()
    counts = chosen.select("text", "toxic").mapInArrow(_each, "toxic int, name long").groupBy("name").agg(
        F.sum("toxic").alias("c1"), F.sum(1 - F.col("toxic")).alias("c0")).filter("c1 + c0 >= 3")
    p1, p0 = (F.col("c1") + 0.5) / (n1 + 1.0), (F.col("c0") + 0.5) / (n0 + 1.0)
    gap = F.abs(p1 - p0) / F.sqrt(p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0)
    best = counts.orderBy(gap.desc(), "name").limit(features).select("name", (p1 > p0).alias("toxic_side")).toArrow()
    order = np.argsort(best.column("name").to_numpy().view(np.uint64))
    names = best.column("name").to_numpy().view(np.uint64)[order]
    side = best.column("toxic_side").to_numpy(zero_copy_only=False)[order] if best.num_rows else np.zeros(0, bool)
    seen = _flags(names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            row, at, count = bag(*_known(*_features(Words(batch.column("text"))), names, seen))
            cuts = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("held"), pa.ListArray.from_arrays(cuts, pa.array(at.astype(np.int32))), pa.ListArray.from_arrays(cuts, pa.array(count.astype(np.int32)))], ["toxic", "held", "at", "n"])

    held = (F.pmod(F.xxhash64(F.col("id"), F.lit(7)), F.lit(5)) == 0).alias("held")
    got = chosen.select("text", "toxic", held).mapInArrow(rows, "toxic int, held boolean, at array<int>, n array<int>").toArrow()
    toxic, held_out = got.column("toxic").to_numpy(), got.column("held").to_numpy()
    lists = got.column("at").combine_chunks()
    at, n = lists.flatten().to_numpy().astype(np.int64), got.column("n").combine_chunks().flatten().to_numpy()
    row = np.repeat(np.arange(len(toxic)), np.diff(lists.offsets.to_numpy()))
    evidence = np.bincount(row, n * side[at], len(toxic))
    thirds = np.quantile(evidence[toxic > 0], [1 / 3, 2 / 3])
    grade = np.where(toxic > 0, 1 + (evidence[:, None] > thirds).sum(axis=1), 0)
    use = ~held_out
    number = np.cumsum(use) - 1
    pick = use[row]
    weights, cuts = fit_ordinal(number[row[pick]], at[pick], np.log1p(n[pick]), grade[use], len(names))
    model = OrdinalModel(names, weights, cuts)
    score = np.bincount(row, weights[at] * np.log1p(n), len(toxic))
    judge = held_out if held_out.any() and 0 < toxic[held_out].sum() < held_out.sum() else np.ones(len(toxic), bool)
    chance, truth = model.above(score)[judge, 0], toxic[judge] > 0
    by = np.argsort(-chance, kind="stable")
    right = np.cumsum(truth[by])
    f1 = 2 * right / (np.arange(1, len(by) + 1) + truth.sum())
    f1[:-1][chance[by][:-1] == chance[by][1:]] = -1  # equal chances are decided together
    k = int(np.argmax(f1))
    model.reject = float((chance[by][k] + chance[by][min(k + 1, len(by) - 1)]) / 2)
    model.held_out = {"documents": int(judge.sum()), "precision": float(right[k] / (k + 1)), "recall": float(right[k] / truth.sum())}
    return model


def grade_toxicity(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Grade every document: doc_id, severity (expected grade, 0 to 3), grade (the most likely) and rejected.

    Null and empty texts have no features and are graded like any text without them; every row
    is graded by itself, whole, in one pass without a shuffle; other columns are not read.
    """
    fields = [T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("severity", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("rejected", T.BooleanType())]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).mapInArrow(lambda b: _graded(b, model, "text", ["doc_id"]), T.StructType(fields))


def drop_toxic(docs: DataFrame, model: OrdinalModel, text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that the model does not reject."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for graded in _graded(batches, model, text, None):
            n = graded.num_columns - 3
            rows = pa.RecordBatch.from_arrays(graded.columns[:n], graded.schema.names[:n])
            yield rows.filter(pc.invert(graded.columns[-1]))

    return docs.mapInArrow(keep, docs.schema)


def _graded(batches: Iterator[pa.RecordBatch], model: OrdinalModel, text: str, own: list[str] | None) -> Iterator[pa.RecordBatch]:
    seen = _flags(model.names)
    for batch in slices(batches, text):
        row, at, n = bag(*_known(*_features(Words(batch.column(text))), model.names, seen))
        above = model.above(np.bincount(row, model.weights[at] * np.log1p(n), batch.num_rows))
        mass = -np.diff(np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], axis=1), axis=1)
        names = batch.schema.names if own is None else own
        columns = [batch.column(c) for c in names]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(np.round(above.sum(axis=1), 6)), pa.array(mass.argmax(axis=1).astype(np.int32)), pa.array(above[:, 0] >= model.reject)],
            [*names, "severity", "grade", "rejected"],
        )
