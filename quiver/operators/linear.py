"""Linear softmax classifiers of many models, trained together (T3, and the learner of T7).

A model has a weight vector and an intercept a class. ``train_logistic`` finds the regularised optimum of all
models in one joint solver: a step is one scan that gives every model's loss and gradient, the product of the
multiplicity matrix with the residuals. A row is stored once, with its multiplicities, for any number of models.
``train_sgd`` runs mini-batch gradient descent for all trials of a search: in every epoch each slice of the rows
goes through its batches from the same parameters, and the slices' parameters are averaged by their rows.

Parameters (models x classes x dimensions) and their sums are the only data that pass through the driver; over
``BLOCK_BYTES`` the models are trained in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiver.functions.hashing import h
from quiver.operators.vectors import summed
from quiver.session import materialize, ship_package

BLOCK_BYTES = 64 << 20
SLICE_ROWS = 4096
HISTORY = 10
_CELLS = 2_000_000  # probabilities that a task holds at once


class Linear(NamedTuple):
    """``names[i]`` is the model of ``theta[i]``: classes x (dimensions + 1), intercept last; ``known`` marks the classes it has."""

    names: list[tuple]
    theta: np.ndarray
    known: np.ndarray

    def packed(self, spark: SparkSession, names: T.StructType) -> DataFrame:
        """(model columns, classes: array of (class_id, w, b)), the form that ``score`` reads; models x classes x dimensions values."""
        schema = T.StructType([*names.fields, T.StructField("classes", T.ArrayType(T.StructType([
            T.StructField("class_id", T.IntegerType()), T.StructField("w", T.ArrayType(T.DoubleType())), T.StructField("b", T.DoubleType())])))])
        rows = [(*n, [(c, t[c, :-1].tolist(), float(t[c, -1])) for c in range(t.shape[0]) if k[c]]) for n, t, k in zip(self.names, self.theta, self.known)]
        return spark.createDataFrame(rows, schema)


def _softmax(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probabilities, log of the normaliser) over the last axis."""
    top = z.max(axis=-1, keepdims=True)
    e = np.exp(z - top)
    total = e.sum(axis=-1, keepdims=True)
    return e / total, (np.log(total) + top)[..., 0]


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.column_stack((x, np.ones(len(x))))


def _vectors(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


# ---- the joint solver -------------------------------------------------------------------------------


def weighted_rows(train: DataFrame, samples: DataFrame, key: str, names: list[tuple], vec: str, label: str, model_cols: Sequence[str]) -> DataFrame:
    """(class_id, x, m): every drawn row once, with its multiplicity in each model of ``names``; written once."""
    mc = list(model_cols)
    drawn = samples.groupBy(key).agg(F.collect_list(F.struct(*mc, "mult")).alias("_reps"))
    rows = train.select(key, F.col(label).cast("int").alias("class_id"), F.col(vec).alias("x")).where("class_id IS NOT NULL AND x IS NOT NULL").join(drawn, key)
    place = {n: i for i, n in enumerate(names)}

    def run(batches):
        for batch in batches:
            reps = batch.column(2)
            entries, owner = reps.flatten(), np.repeat(np.arange(len(batch)), reps.value_lengths().to_numpy())
            models = np.array([place[n] for n in zip(*(entries.field(c).to_pylist() for c in mc))], np.int64)
            m = np.zeros((len(batch), len(names)), np.float32)
            np.add.at(m, (owner, models), entries.field("mult").to_numpy(zero_copy_only=False))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * len(names), pa.int32()), pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.list_(pa.float64())), flat], ["class_id", "x", "m"])

    return materialize(rows.select("class_id", "x", "_reps").mapInArrow(run, "class_id int, x array<double>, m array<float>"))


def losses(rows: DataFrame, theta: np.ndarray, known: np.ndarray, chosen: np.ndarray, residuals: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weight, loss, gradient) of models weighted by the ``chosen`` columns of ``m``, summed over the rows in one scan.

    Without ``residuals`` the last is the sum of probabilities times x, not of residuals times x."""
    models, classes, width = theta.shape
    shared = rows.sparkSession.sparkContext.broadcast((theta, known, chosen))

    def task(batches):
        theta, known, chosen = shared.value
        flat = theta.reshape(models * classes, width)
        weight, loss, gradient = np.zeros(models), np.zeros(models), np.zeros((models * classes, width))
        step = max(1, _CELLS // (models * classes))
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            label, x, m = batch.column(0).to_numpy(), _with_one(_vectors(batch.column(1), n)), _vectors(batch.column(2), n)[:, chosen]
            for a in range(0, n, step):
                part, own, w = x[a : a + step], label[a : a + step], m[a : a + step]
                z = (part @ flat.T).reshape(len(part), models, classes)
                z[:, ~known] = -np.inf
                p, norm = _softmax(z)
                real = w > 0  # a class that a model lacks has no weight in it
                at = z[np.arange(len(part))[:, None], np.arange(models)[None, :], own[:, None]]
                loss += np.where(real, w * (norm - np.where(real, at, 0.0)), 0.0).sum(axis=0)
                weight += w.sum(axis=0)
                if residuals:
                    p[np.arange(len(part)), :, own] -= 1.0
                p *= w[:, :, None]
                gradient += p.reshape(len(part), models * classes).T @ part
        return np.concatenate((weight, loss, gradient.ravel()))

    total = summed(rows, task, models * (2 + classes * width))
    shared.destroy()
    return total[:models], total[models : 2 * models], total[2 * models :].reshape(models, classes, width)


class _Descent:
    """Limited-memory BFGS of one model; the scans that evaluate it are shared."""

    def __init__(self, x: np.ndarray, f: float, g: np.ndarray, rate: float) -> None:
        self.x, self.f, self.g, self.pairs, self.done = x, f, g, [], False
        self.direction, self.step = -g, rate

    def candidate(self) -> np.ndarray:
        return self.x + self.step * self.direction

    def take(self, f: float, g: np.ndarray, tol: float) -> None:
        """Accept the candidate if it descends enough, else halve the step."""
        slope = float((self.g * self.direction).sum())
        if not f <= self.f + 1e-4 * self.step * slope + 1e-14 * abs(self.f):
            self.step /= 2
            self.done = self.step < 1e-12
            return
        s, y = self.step * self.direction, g - self.g
        if (s * y).sum() > 1e-14 * np.sqrt((s * s).sum() * (y * y).sum()):
            self.pairs = [*self.pairs[1 - HISTORY :], (s, y, 1 / (s * y).sum())]
        self.x, self.f, self.g = self.x + s, f, g
        if np.abs(g).max() <= tol:
            self.done = True
            return
        q, alphas = g.copy(), []
        for s, y, rho in reversed(self.pairs):
            alphas.append(rho * (s * q).sum())
            q -= alphas[-1] * y
        if self.pairs:
            s, y, rho = self.pairs[-1]
            q /= rho * (y * y).sum()
        for (s, y, rho), alpha in zip(self.pairs, reversed(alphas)):
            q += (alpha - rho * (y * q).sum()) * s
        self.direction, self.step = -q, 1.0


def train_logistic(train: DataFrame, samples: DataFrame, key: str, vec: str = "embedding", label: str = "label", model_cols: Sequence[str] = ("replica",),
                   reg_param: float | Mapping[tuple, float] = 0.05, max_iter: int = 200, tol: float = 1e-10, block_bytes: int = BLOCK_BYTES) -> Linear:
    """A multinomial logistic regression for each sample of ``samples``, its multiplicities as weights.

    Minimises the weighted mean log-loss plus half of ``reg_param`` (the weight decay of the hyperparameter table or
    a trial) times the squared weights; intercepts are not penalised. With several penalties, keyed by a tuple such as (model,
    task), every sample is trained with each of them, and the key stands before the sample in the model's name. Without
    a penalty separable classes have no finite optimum, so 0 is refused. A class that a sample lacks is left out of its models.
    ``max_iter`` bounds the scans, each of which serves all models.
    """
    variants = dict(reg_param) if isinstance(reg_param, Mapping) else {(): reg_param}
    if min(variants.values(), default=1.0) <= 0:
        raise ValueError("reg_param must be positive: separable classes have no finite optimum without a penalty")
    mc = list(model_cols)
    drawn = sorted(tuple(r) for r in samples.select(*mc).distinct().collect())  # one row a sample
    plan = [(v + n, k, penalty) for v, penalty in sorted(variants.items()) for k, n in enumerate(drawn)]
    names, column, penalty = [p[0] for p in plan], np.array([p[1] for p in plan], np.int64), np.array([p[2] for p in plan])
    shape = train.where(F.col(label).isNotNull() & F.col(vec).isNotNull()).agg(F.max(F.col(label).cast("int")).alias("top"), F.max(F.size(vec)).alias("dims")).first()
    if not names or shape["top"] is None:
        return Linear([], np.zeros((0, 0, 1)), np.zeros((0, 0), bool))
    classes, width = shape["top"] + 1, shape["dims"] + 1
    rows = weighted_rows(train, samples, key, drawn, vec, label, mc)
    size = max(1, block_bytes // (8 * classes * width))
    thetas, knowns = [], []
    for a in range(0, len(names), size):
        theta, known = _solve(rows, column[a : a + size], classes, width, penalty[a : a + size], max_iter, tol)
        thetas.append(theta)
        knowns.append(known)
    return Linear(names, np.concatenate(thetas), np.concatenate(knowns))


def _solve(rows: DataFrame, chosen: np.ndarray, classes: int, width: int, penalty: np.ndarray, max_iter: int, tol: float) -> tuple[np.ndarray, np.ndarray]:
    theta, every = np.zeros((len(chosen), classes, width)), np.ones((len(chosen), classes), bool)
    weight, _, gradient = losses(rows, theta, every, chosen)
    drawn = weight[:, None] / classes - gradient[:, :, -1]  # at zero the intercepts' gradient is the even share less the class's weight
    known = drawn > 0.5

    def objective(theta, loss, gradient, own):
        ridge = penalty[own][:, None, None] * np.concatenate((theta[:, :, :-1], np.zeros((len(theta), classes, 1))), axis=2)
        return loss / weight[own] + 0.5 * (ridge * theta).sum(axis=(1, 2)), gradient / weight[own][:, None, None] + ridge

    weight, loss, gradient = losses(rows, theta, known, chosen)
    f, g = objective(theta, loss, gradient, np.arange(len(chosen)))
    models = [_Descent(theta[i], f[i], g[i], 1.0) for i in range(len(chosen))]
    for _ in range(max_iter):
        own = np.array([i for i, m in enumerate(models) if not m.done], np.int64)
        if not own.size:
            break
        trial = np.stack([models[i].candidate() for i in own])
        _, loss, gradient = losses(rows, trial, known[own], chosen[own])
        f, g = objective(trial, loss, gradient, own)
        for k, i in enumerate(own):
            models[i].take(f[k], g[k], tol)
    return np.stack([m.x for m in models]), known


def fitted_moments(train: DataFrame, samples: DataFrame, key: str, models: Linear, penalties: Mapping[tuple, float], names: T.StructType, vec: str = "embedding",
                   label: str = "label", model_cols: Sequence[str] = ("replica",)) -> DataFrame:
    """(model columns, class_id, dim, fitted): sum of mult * prob * x, plus weight * penalty * coef, of each model in one scan.

    At the optimum this is the weighted rows' own sum of x a class, which checks a fit without fitting again.
    """
    mc = list(model_cols)
    drawn = sorted({n[-len(mc) :] for n in models.names})
    rows = weighted_rows(train, samples, key, drawn, vec, label, mc)
    column = np.array([drawn.index(n[-len(mc) :]) for n in models.names], np.int64)
    weight, _, moments = losses(rows, models.theta, models.known, column, residuals=False)
    ridge = models.theta * (weight * np.array([penalties[n[: -len(mc)]] for n in models.names]))[:, None, None]
    ridge[:, :, -1] = 0.0
    fitted = moments + ridge
    cells = [(*n, c, d, float(fitted[i, c, d])) for i, n in enumerate(models.names) for c in range(fitted.shape[1]) if models.known[i, c] for d in range(fitted.shape[2])]
    schema = T.StructType([*names.fields, T.StructField("class_id", T.IntegerType()), T.StructField("dim", T.IntegerType()), T.StructField("fitted", T.DoubleType())])
    return train.sparkSession.createDataFrame(cells, schema)


# ---- mini-batch gradient descent ------------------------------------------------------------------------


def slices(train: DataFrame, key: str, vec: str, labels: Sequence[str], seed: str = "sgd", rows: int = SLICE_ROWS) -> DataFrame:
    """(n, x, one array of labels each of ``labels``): slices of about ``rows`` rows, by hash, each in a seeded order; written once.

    The slices follow from the keys alone, so training does not depend on the partitioning.
    """
    usable = train.where(F.col(vec).isNotNull())
    count = max(1, math.ceil(usable.count() / rows))
    place = F.pmod(h(f"{seed}-slice", F.col(key)), F.lit(count))
    listed = usable.select(place.alias("_slice"), F.struct(h(seed, F.col(key)).alias("h"), F.col(key).alias("k"), F.col(vec).cast("array<double>").alias("x"), *[F.col(c).cast("int").alias(f"y_{c}") for c in labels]).alias("r"))
    packed = listed.groupBy("_slice").agg(F.sort_array(F.collect_list("r")).alias("r"))

    def field(name):
        return F.transform("r", lambda e: e[name])

    return materialize(packed.select(F.size("r").alias("n"), F.flatten(field("x")).alias("x"), *[field(f"y_{c}").alias(c) for c in labels]))


class Trial(NamedTuple):
    """One trial of a search: its name, the label column it learns, and how."""

    name: tuple
    label: str
    epochs: int
    batch: int
    rate: float
    weight_decay: float


def descend(x: np.ndarray, y: np.ndarray, theta: np.ndarray, batch: int, rate: np.ndarray, decay: np.ndarray) -> np.ndarray:
    """One epoch of mini-batches in row order for several models (theta: models x classes x (dimensions + 1)); rows of a null label (-1) are passed over.

    A batch's step is theta - rate * (mean gradient + decay * weights); intercepts do not decay.
    """
    models, classes, width = theta.shape
    theta, x, y = theta.copy(), x[y >= 0], y[y >= 0]
    for a in range(0, len(x), batch):
        part, own = x[a : a + batch], y[a : a + batch]
        p, _ = _softmax((part @ theta.reshape(models * classes, width).T).reshape(len(part), models, classes))
        p[np.arange(len(part)), :, own] -= 1.0
        gradient = (p.reshape(len(part), models * classes).T @ part).reshape(theta.shape) / len(part)
        gradient[:, :, :-1] += decay[:, None, None] * theta[:, :, :-1]
        theta -= rate[:, None, None] * gradient
    return theta


def train_sgd(sliced: DataFrame, trials: Sequence[Trial], classes: Mapping[str, int], dims: int, block_bytes: int = BLOCK_BYTES) -> dict[str, Linear]:
    """The models of all trials by label column; an epoch is one scan for all trials that still run."""
    ship_package(sliced.sparkSession)
    found: dict[tuple, np.ndarray] = {}
    block, size = [], 0
    for t in sorted(trials):
        block.append(t)
        size += 8 * classes[t.label] * (dims + 1)
        if size >= block_bytes:
            found.update(_epochs(sliced, block, classes, dims))
            block, size = [], 0
    if block:
        found.update(_epochs(sliced, block, classes, dims))
    out = {}
    for label in sorted({t.label for t in trials}):
        own = sorted(t for t in trials if t.label == label)
        theta = np.stack([found[label, t.name] for t in own])
        out[label] = Linear([t.name for t in own], theta, np.ones(theta.shape[:2], bool))
    return out


def _epochs(sliced: DataFrame, trials: list[Trial], classes: Mapping[str, int], dims: int) -> dict[tuple, np.ndarray]:
    theta = {(t.label, t.name): np.zeros((classes[t.label], dims + 1)) for t in trials}
    names = [c for c in sliced.columns if c not in ("n", "x")]
    for epoch in range(max(t.epochs for t in trials)):
        groups: dict[tuple, list[Trial]] = {}
        for t in trials:
            if t.epochs > epoch:
                groups.setdefault((t.label, t.batch), []).append(t)
        start = {g: np.stack([theta[t.label, t.name] for t in own]) for g, own in groups.items()}
        shared = sliced.sparkSession.sparkContext.broadcast(({g: (s, np.array([t.rate for t in groups[g]]), np.array([t.weight_decay for t in groups[g]])) for g, s in start.items()}, names))

        def task(batches, shared=shared):
            at, names = shared.value
            total, rows = {g: np.zeros_like(s[0]) for g, s in at.items()}, 0
            for batch in batches:
                for i in range(len(batch)):
                    n = batch.column(0)[i].as_py()
                    x = _with_one(batch.column(1)[i].values.to_numpy(zero_copy_only=False).reshape(n, -1))
                    rows += n
                    for (label, size), (s, rate, decay) in at.items():
                        y = batch.column(2 + names.index(label))[i].values.fill_null(-1).to_numpy(zero_copy_only=False)
                        total[label, size] += n * descend(x, y, s, size, rate, decay)
            return np.concatenate([[rows], *[t.ravel() for t in total.values()]])

        total = summed(sliced, task, 1 + sum(s.size for s in start.values()))
        shared.destroy()
        at = 1
        for g, s in start.items():
            mean = (total[at : at + s.size] / max(total[0], 1)).reshape(s.shape)
            at += s.size
            for t, own in zip(groups[g], mean):
                theta[t.label, t.name] = own
    return theta
