"""Mixtures and k-means for many configurations and resamples at once.

All models run side by side: a step is one pass over the rows, in which every task adds up the
sufficient statistics of every model, and one grouped sum of them by model. The number of Spark jobs
is that of the slowest model's steps, whatever the number of models. Models that have converged drop
out of later steps. Only statistics and parameters (some k x d x d numbers a model) reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortgrid.session import cut_lineage

#: Rows on which the first means are sought (the ones whose ids hash lowest), and tries for each model.
START_ROWS, TRIES = 2048, 4
#: Added to variances.
FLOOR = 1e-6
KINDS = ("full", "diag", "tied", "kmeans")


@dataclass(frozen=True)
class Model:
    """A kind with k components; `rep` 0 uses all rows, others a resample of their own."""

    kind: str
    k: int
    rep: int = 0
    weights: np.ndarray | None = None
    means: np.ndarray | None = None
    cov: np.ndarray | None = None
    #: Log-likelihood (k-means: minus the squared distances) of these parameters, and rows.
    fit: float = -math.inf
    n: int = 0

    @property
    def name(self) -> tuple[str, int, int]:
        return self.kind, self.k, self.rep


def in_resample(h: np.ndarray, rep: int, seed: int, fraction: float) -> np.ndarray:
    """Whether rows, given by a hash of their ids, are in a resample."""
    if not rep:
        return np.ones(len(h), bool)
    mixed = h.astype(np.uint64) ^ np.uint64((seed * 1_000_003 + rep) * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    return (mixed ^ (mixed >> np.uint64(31))) % np.uint64(1_000_000) < np.uint64(round(fraction * 1_000_000))


def scores(x: np.ndarray, m: Model) -> np.ndarray:
    """Per row and component: weighted log density, for k-means minus the squared distance."""
    out = np.empty((len(x), m.k))
    if m.kind == "kmeans":
        return 2 * x @ m.means.T - (m.means**2).sum(1) - (x * x).sum(1)[:, None]
    d = x.shape[1]
    for j in range(m.k):
        if m.kind == "diag":
            y, half = (x - m.means[j]) / np.sqrt(m.cov[j]), 0.5 * np.log(m.cov[j]).sum()
        else:
            chol = np.linalg.cholesky(m.cov if m.kind == "tied" else m.cov[j])
            y, half = (x - m.means[j]) @ np.linalg.inv(chol).T, np.log(np.diag(chol)).sum()
        out[:, j] = -0.5 * (y * y).sum(1) - half
    return out + np.log(np.maximum(m.weights, 1e-300)) - 0.5 * d * math.log(2 * math.pi)


def memberships(x: np.ndarray, m: Model) -> tuple[np.ndarray, float]:
    """Share of each row in each component, and the rows' fit."""
    s = scores(x, m)
    top = s.max(1, keepdims=True)
    if m.kind == "kmeans":
        return np.eye(m.k)[s.argmax(1)], float(top.sum())
    e = np.exp(s - top)
    total = e.sum(1, keepdims=True)
    return e / total, float((top + np.log(total)).sum())


def statistics(x: np.ndarray, m: Model) -> np.ndarray:
    """Rows, fit, and per component the share, the sum and (as the kind needs) the squares of its rows, as one line."""
    r, fit = memberships(x, m)
    second = {"full": lambda: np.stack([(x * r[:, [j]]).T @ x for j in range(m.k)]), "diag": lambda: r.T @ (x * x), "tied": lambda: x.T @ x, "kmeans": lambda: np.zeros(0)}[m.kind]()
    return np.concatenate([[len(x), fit], r.sum(0), (r.T @ x).ravel(), second.ravel()])


def _firm(cov: np.ndarray) -> np.ndarray:
    """Covariances whose variances in any direction are at least about FLOOR, where rounding took them below."""
    values, axes = np.linalg.eigh(cov)
    if values.min() >= FLOOR / 2:
        return cov
    return (axes * np.maximum(values, FLOOR)[..., None, :]) @ np.swapaxes(axes, -1, -2)


def updated(m: Model, s: np.ndarray, d: int) -> Model:
    """The model that the statistics give; `fit` is that of the model before. A component without rows stays as it is."""
    n, fit, share, sums, second = s[0], s[1], s[2 : 2 + m.k], s[2 + m.k : 2 + m.k + m.k * d].reshape(m.k, d), s[2 + m.k + m.k * d :]
    held = share > 1e-10
    means = np.where(held[:, None], sums / np.maximum(share, 1e-10)[:, None], m.means)
    share = np.maximum(share, 1e-10)
    cov = m.cov
    if m.kind == "full":
        cov = second.reshape(m.k, d, d) / share[:, None, None] - means[:, :, None] * means[:, None, :] + FLOOR * np.eye(d)
        cov = _firm(np.where(held[:, None, None], cov, m.cov))
    elif m.kind == "diag":
        cov = np.where(held[:, None], np.maximum(second.reshape(m.k, d) / share[:, None] - means**2, 0) + FLOOR, m.cov)
    elif m.kind == "tied":
        cov = _firm((second.reshape(d, d) - (means.T * share) @ means) / n + FLOOR * np.eye(d))
    return replace(m, weights=share / share.sum(), means=means, cov=cov, fit=float(fit), n=int(n))


def started(x: np.ndarray, m: Model, seed: int) -> Model:
    """A model from the best of TRIES k-means runs on the given rows: each mean far from those before."""
    best = None
    rng = np.random.default_rng([seed, m.k, m.rep])
    for _ in range(TRIES):
        means = x[[rng.integers(len(x))]]
        for _ in range(m.k - 1):
            near = ((x[:, None, :] - means[None]) ** 2).sum(2).min(1)
            p = near / near.sum() if near.sum() > 0 else None
            means = np.concatenate([means, x[[rng.choice(len(x), p=p)]]])
        one = Model("kmeans", m.k, m.rep, means=means)
        for _ in range(20):
            after = updated(one, statistics(x, one), x.shape[1])
            if after.fit - one.fit <= 1e-9 * abs(after.fit):
                break
            one = after
        if best is None or after.fit > best.fit:
            best = after
    if m.kind == "kmeans":
        return replace(m, means=best.means)
    hard, _ = memberships(x, best)
    spread = np.stack([np.cov(x[hard[:, j] > 0].T, bias=True).reshape(x.shape[1], -1) if hard[:, j].sum() > 1 else np.zeros((x.shape[1],) * 2) for j in range(m.k)])
    share = np.maximum(hard.sum(0), 1e-10) / len(x)
    full = spread + FLOOR * np.eye(x.shape[1])
    cov = {"full": full, "diag": np.maximum(np.diagonal(full, axis1=1, axis2=2), FLOOR), "tied": (share[:, None, None] * full).sum(0)}[m.kind]
    return replace(m, weights=share, means=best.means, cov=cov)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.nan_to_num(flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, d))


class Fits:
    """Fitted models over one table of vectors."""

    def __init__(self, data: DataFrame, id_col: str, centre: np.ndarray, models: list[Model], seed: int, fraction: float, steps: int):
        self._data, self._id, self._centre, self._seed, self._fraction = data, id_col, centre, seed, fraction
        self.models, self.steps = {m.name: m for m in models}, steps

    def base(self) -> list[Model]:
        return [m for m in self.models.values() if not m.rep]

    def parameters(self) -> DataFrame:
        """kind, k, component, weight, mean, covariance (row by row; the variances alone for diag), of the models over all rows."""
        rows = []
        for m in self.base():
            for j in range(m.k if m.kind != "kmeans" else 0):
                cov = m.cov if m.kind == "tied" else m.cov[j]
                rows.append((m.kind, m.k, j, float(m.weights[j]), (m.means[j] + self._centre).tolist(), np.asarray(cov).ravel().tolist()))
        return self._data.sparkSession.createDataFrame(rows, "kind string, k int, component int, weight double, mean array<double>, covariance array<double>")

    def selection(self) -> DataFrame:
        """kind, k, n, loglik, bic of the models over all rows; k-means has neither of the last two."""
        d = len(self._centre)
        rows = [(m.kind, m.k, m.n, m.fit if m.kind != "kmeans" else None, bic(m.fit, m.n, d, m.k, m.kind) if m.kind != "kmeans" else None) for m in self.base()]
        return self._data.sparkSession.createDataFrame(rows, "kind string, k int, n long, loglik double, bic double")

    def assignments(self) -> DataFrame:
        """id, kind, k, cluster, membership: a row per row of the table and model over all rows."""
        models, centre = self.base(), self._centre
        kind = dict(self._data.dtypes)[self._id]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _matrix(b.column(2), len(centre)) - centre
                for m in models if len(x) else ():
                    r, _ = memberships(x, m)
                    cells = pa.ListArray.from_arrays(np.arange(0, r.size + 1, m.k, dtype=np.int32), r.ravel())
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.kind] * len(x)), pa.array(np.full(len(x), m.k, np.int32)), pa.array(r.argmax(1).astype(np.int32)), cells], names=["id", "kind", "k", "cluster", "membership"])

        return self._data.mapInArrow(run, f"`{self._id}` {kind}, kind string, k int, cluster int, membership array<double>")

    def agreement(self) -> DataFrame:
        """kind, k, rep, ari: adjusted Rand index of each resample's model with the one over all rows, on the resample's rows.

        Tasks hand on counts per pair of labels.
        """
        from cohortgrid.operators.evaluation import adjusted_rand

        models, centre, seed, fraction = dict(self.models), self._centre, self._seed, self._fraction

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, h = _matrix(b.column(2), len(centre)) - centre, b.column(1).to_numpy()
                own = {name: memberships(x, m)[0].argmax(1) for name, m in models.items() if not m.rep}
                for (kind, k, rep), m in models.items():
                    if rep:
                        on = in_resample(h, rep, seed, fraction)
                        cells = np.bincount(own[kind, k, 0][on] * k + memberships(x[on], m)[0].argmax(1), minlength=k * k)
                        at = np.flatnonzero(cells)
                        # A batch may have no row of a resample; the names keep their type then.
                        yield pa.RecordBatch.from_arrays([pa.array([kind] * len(at), pa.string()), *(pa.array(np.full(len(at), v, np.int32)) for v in (k, rep)), pa.array(at // k), pa.array(at % k), pa.array(cells[at])], names=["kind", "k", "rep", "a", "b", "n"])

        cells = self._data.mapInArrow(run, "kind string, k int, rep int, a long, b long, n long")
        return adjusted_rand(cells, "a", "b", ["kind", "k", "rep"], count="n").select("kind", "k", "rep", "ari")

    def stability(self) -> DataFrame:
        """kind, k, stability (mean ari), n_boot."""
        return self.agreement().groupBy("kind", "k").agg(F.avg("ari").alias("stability"), F.count(F.lit(1)).alias("n_boot"))


def bic(loglik: float, n: int, d: int, k: int, covariance: str) -> float:
    free = {"full": k * d * (d + 1) / 2, "diag": k * d, "tied": d * (d + 1) / 2}[covariance]
    return -2.0 * loglik + (k - 1 + k * d + free) * math.log(n)


def fit_all(df: DataFrame, ks: Sequence[int], kinds: Sequence[str] = ("full",), n_boot: int = 0, boot_kinds: Sequence[str] = ("full",), fraction: float = 0.8, vec: str = "latent", id_col: str = "id", seed: int = 0, max_iter: int = 200, tol: float = 1e-3) -> Fits:
    """Models of each kind and k over all rows, and of each boot kind and k over `n_boot` resamples.

    A resample holds about `fraction` of the rows, chosen by a hash of id and number. A model ends when
    a step changes its mean log-likelihood (k-means: the mean squared distance) by less than `tol`.
    Missing numbers of a vector count as 0; rows without a vector are left out. Needs at least one row.
    """
    if unknown := {*kinds, *boot_kinds} - {*KINDS}:
        raise ValueError(f"unknown kinds {sorted(unknown)}")
    kept = df.where(F.col(vec).isNotNull()).select(F.col(id_col), F.xxhash64(F.col(id_col).cast("string")).alias("_h"), F.col(vec).cast("array<double>").alias("_x"))
    data = cut_lineage(kept)
    first = data.orderBy("_h", id_col).limit(START_ROWS).toPandas()
    if not len(first):
        raise ValueError("no rows to fit on")
    d = len(first["_x"].iloc[0])
    sums = data.select(*[F.avg(F.coalesce(F.nanvl(F.get("_x", F.lit(i)), F.lit(0.0)), F.lit(0.0))) for i in range(d)]).first()
    centre = np.array(sums, float)
    x0, h0 = np.nan_to_num(np.array(first["_x"].tolist(), float)) - centre, first["_h"].to_numpy()
    wanted = [Model(kind, k) for kind in kinds for k in ks] + [Model(kind, k, rep) for kind in boot_kinds for k in ks for rep in range(1, n_boot + 1)]
    spark = df.sparkSession

    def begin(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = [started(rows if len(rows := x0[in_resample(h0, m.rep, seed, fraction)]) else x0, m, seed) for m in (wanted[i] for i in pdf["i"])]
            yield pd.DataFrame({"i": pdf["i"], "p": [np.concatenate([np.ravel(a) for a in (m.weights, m.means, m.cov) if a is not None]) for m in out]})

    width = spark.range(len(wanted)).repartition(spark.sparkContext.defaultParallelism).select(F.col("id").alias("i"))
    models = [None] * len(wanted)
    for row in width.mapInPandas(begin, "i long, p array<double>").collect():
        m, p = wanted[row["i"]], np.array(row["p"])
        if m.kind == "kmeans":
            models[row["i"]] = replace(m, means=p.reshape(m.k, d))
        else:
            shape = {"full": (m.k, d, d), "diag": (m.k, d), "tied": (d, d)}[m.kind]
            models[row["i"]] = replace(m, weights=p[: m.k], means=p[m.k : m.k + m.k * d].reshape(m.k, d), cov=p[m.k + m.k * d :].reshape(shape))
    open_, steps = set(range(len(models))), 0

    def totals(which: Sequence[int]) -> dict[int, np.ndarray]:
        sent = spark.sparkContext.broadcast({i: models[i] for i in which})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            acc: dict[int, np.ndarray] = {}
            for b in batches:
                x, h = _matrix(b.column(2), d) - centre, b.column(1).to_numpy()
                held: dict[int, np.ndarray] = {}
                for i, m in sent.value.items():
                    if m.rep not in held:
                        held[m.rep] = x[in_resample(h, m.rep, seed, fraction)]
                    s = statistics(held[m.rep], m)
                    acc[i] = acc[i] + s if i in acc else s
            if acc:
                yield pa.RecordBatch.from_arrays([pa.array(list(acc), pa.int64()), pa.array([a.tolist() for a in acc.values()], pa.list_(pa.float64()))], names=["i", "s"])

        def add(table: pa.Table) -> pa.Table:
            lines = table.column("s").to_pylist()
            return pa.table({"i": table.column("i").slice(0, 1), "s": pa.array([np.sum(lines, axis=0).tolist()], pa.list_(pa.float64()))})

        rows = data.mapInArrow(run, "i long, s array<double>").groupBy("i").applyInArrow(add, "i long, s array<double>").collect()
        sent.destroy()
        return {r["i"]: np.array(r["s"]) for r in rows}

    while open_ and steps < max_iter:
        steps += 1
        for i, s in totals(sorted(open_)).items():
            before, after = models[i], updated(models[i], s, d)
            if abs(after.fit - before.fit) < tol * max(after.n, 1):
                # The parameters whose fit is known stay.
                models[i] = replace(before, fit=after.fit, n=after.n)
                open_.discard(i)
            else:
                models[i] = after
    if open_:
        for i, s in totals(sorted(open_)).items():
            models[i] = replace(models[i], fit=float(s[1]), n=int(s[0]))
    return Fits(data, id_col, centre, models, seed, fraction, steps)
