"""Scoring rows with many small models (T4).

Models are packed one row per model: centroids (``classes: array<struct<class_id, mu>>``) or linear classifiers
(``classes: array<struct<class_id, w, b>>``); a centroid's score is linear too, up to a part that all classes of a row
share. They are broadcast in blocks whose bytes are measured first, and every Arrow batch of rows is scored with
one matrix product per block inside its task: rows are never shuffled for scoring, and no block grows with
the number of models.
"""

from __future__ import annotations

import math
import time
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiver.operators.ensemble import TIE_DECIMALS
from quiver.session import ship_package

BLOCK_BYTES = 256 << 20  # of model values in one broadcast
LEAST_SHARE = 1e-300  # of a vote, for the logarithm


def softmax_by_segment(s: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Max-shifted softmax over consecutive columns of ``s``; a segment is one model's classes."""
    lengths = np.diff(np.append(starts, s.shape[1]))
    e = np.exp(s - np.repeat(np.maximum.reduceat(s, starts, axis=1), lengths, axis=1))
    return e / np.repeat(np.add.reduceat(e, starts, axis=1), lengths, axis=1)


class Block:
    """Some models of every task as arrays: per task the model of each column, its class, its weights and intercept."""

    def __init__(self, rows, on: int, model_cols: int) -> None:
        found: dict[tuple, tuple[list, list, list, list, list, list]] = {}
        for r in rows:
            metas, classes, weights, shifts, starts, members = found.setdefault(tuple(r[:on]), ([], [], [], [], [], []))
            starts.append(len(classes))
            own = [tuple(m) for m in r[on + model_cols + 1]] if len(r) > on + model_cols + 1 else None
            for c in r[on + model_cols]:
                metas.append(tuple(r[on : on + model_cols]))
                classes.append(c["class_id"])
                vector = np.asarray(c[1], np.float64)  # mu, or w with the intercept b after it
                weights.append(vector if len(c) > 2 else 2 * vector)
                shifts.append(c[2] if len(c) > 2 else -(vector * vector).sum())
                members.append(own)
        self.tasks = {t: (m, np.asarray(c, np.int32), np.vstack(u), np.asarray(b), np.asarray(s), o) for t, (m, c, u, b, s, o) in found.items()}


def model_blocks(models: DataFrame, on: Sequence[str], model_cols: Sequence[str], block_bytes: int = BLOCK_BYTES, members: str | None = None) -> list:
    """Broadcast blocks of the packed ``models``; their number follows the measured bytes."""
    sc = models.sparkSession.sparkContext
    vector = models.schema["classes"].dataType.elementType.names[1]
    cells = F.aggregate(F.col("classes"), F.lit(0).cast("long"), lambda acc, c: acc + F.size(c[vector]))
    size = 8 * (models.agg(F.sum(cells)).first()[0] or 0)
    n = max(1, math.ceil(size / max(1, block_bytes)))
    names = [*on, *model_cols]
    part = F.pmod(F.xxhash64(*names), F.lit(n))
    out = []
    for k in range(n):  # one block at a time on the driver
        own = models.where(part == k) if n > 1 else models
        block = Block(own.select(*names, "classes", *([members] if members else [])).orderBy(*names).toLocalIterator(), len(on), len(model_cols))
        out.append(sc.broadcast(block))
        del block
    return out


def _field(schema: T.StructType, name: str) -> T.StructField:
    return T.StructField(name, schema[name].dataType)


def score_centroids(rows: DataFrame, models: DataFrame, key: str, vec: str = "embedding", model_cols: Sequence[str] = ("replica",),
                    on: Sequence[str] = ("task",), blocks: list | None = None, block_bytes: int = BLOCK_BYTES,
                    vote_by: Sequence[str] | None = None, predict: bool = False, label: str | None = None, members: str | None = None) -> DataFrame:
    """T4: ``(on..., model..., key, class_id, prob)``; classes missing from a model get no row (prob 0).

    The probability of a class is the softmax, within its model, of minus the squared distance to its
    centroid. With ``vote_by`` (some of ``model_cols``; ``[]``: all models are one ensemble) the soft vote
    G1 is fused in: ``(on..., vote_by..., key, class_id, total)``. With ``predict`` also the arg-max G2:
    ``(on..., vote_by..., key, y_pred)``, and the rows' own ``label`` as ``y_true`` if it is named. Totals
    that agree to ``TIE_DECIMALS`` decimals tie, and the lowest class wins.

    A model that votes in several ensembles names them in the column ``members`` (an array of structs with
    the ``vote_by`` fields, which then need not be model columns) and is still scored once.

    ``blocks`` may hold the broadcast models already (:func:`model_blocks`). With several blocks every
    block is one pass over the rows and the partial totals are added up per row.
    """
    ship_package(rows.sparkSession)
    mc, on = list(model_cols), list(on)
    blocks = model_blocks(models, on, mc, block_bytes, members) if blocks is None else blocks
    if vote_by is None:
        return reduce(DataFrame.unionByName, [_pass(rows, models, b, key, vec, mc, on, None, False, None, None) for b in blocks])
    vote_by = list(vote_by)
    if len(blocks) == 1:
        return _pass(rows, models, blocks[0], key, vec, mc, on, vote_by, predict, label, members)
    parts = reduce(DataFrame.unionByName, [_pass(rows, models, b, key, vec, mc, on, vote_by, False, None, members) for b in blocks])
    totals = parts.groupBy(*on, *vote_by, key, "class_id").agg(F.sum("total").alias("total"))
    if not predict:
        return totals
    from quiver.operators.ensemble import align_truth, predict as arg_max

    found = arg_max(totals, key, [*on, *vote_by])
    return align_truth(found, rows, key, label).withColumn("y_true", F.col("y_true").cast("int")) if label else found


def confusion_counts(rows: DataFrame, models: DataFrame, key: str, label: str = "label", vec: str = "embedding", model_cols: Sequence[str] = ("replica",),
                     on: Sequence[str] = ("task",), vote_by: Sequence[str] | None = None, block_bytes: int = BLOCK_BYTES, members: str | None = None) -> DataFrame:
    """G3, the log-loss and the time of many ensembles: ``(on..., vote_by..., y_true, y_pred, n, loss, seconds)``, added up inside the scoring tasks.

    So no prediction leaves a task. ``vote_by`` (default: every model is an ensemble of its own) names the models that
    vote together, or ``members`` the ensembles of each model; ``loss`` is the sum, over the n rows, of minus the log of the
    vote's share for the true class. Rows without a label are left out. ``seconds`` is the time that tasks spent on an ensemble,
    its share of the models' scores included; its sum over an ensemble's cells is the ensemble's (0 where ensembles span blocks).
    """
    ship_package(rows.sparkSession)
    mc, on = list(model_cols), list(on)
    vote_by = mc if vote_by is None else list(vote_by)
    blocks = model_blocks(models, on, mc, block_bytes, members)
    known = rows.where(F.col(label).isNotNull())
    if len(blocks) == 1 or set(vote_by) == set(mc):  # no ensemble spans two blocks
        counted = reduce(DataFrame.unionByName, [_pass(known, models, b, key, vec, mc, on, vote_by, True, label, members, counts=True) for b in blocks])
    else:
        totals = score_centroids(known, models, key, vec, mc, on, blocks=blocks, vote_by=vote_by, members=members)
        truth = known.select(*on, key, F.col(label).cast("int").alias("y_true"))
        per = totals.join(truth, [*on, key]).groupBy(*on, *vote_by, key, "y_true").agg(
            F.max_by("class_id", F.struct(F.bround("total", TIE_DECIMALS), -F.col("class_id"))).alias("y_pred"), F.sum("total").alias("all"),
            F.sum(F.when(F.col("class_id") == F.col("y_true"), F.col("total")).otherwise(0.0)).alias("own"))
        counted = per.withColumn("n", F.lit(1).cast("long")).withColumn("loss", -F.log(F.greatest(F.col("own") / F.col("all"), F.lit(LEAST_SHARE)))).withColumn("seconds", F.lit(0.0))
    return counted.groupBy(*on, *vote_by, "y_true", "y_pred").agg(*[F.sum(c).alias(c) for c in ("n", "loss", "seconds")])


def _pass(rows: DataFrame, models: DataFrame, block, key: str, vec: str, mc: list, on: list, vote_by: list | None, predict: bool, label: str | None, members: str | None,
          counts: bool = False) -> DataFrame:
    """One pass of one block over the rows."""
    kinds = [_field(models.schema, c) for c in on] + [_field(models.schema[members].dataType.elementType if members and vote_by is not None else models.schema, c) for c in (mc if vote_by is None else vote_by)]
    if counts:
        kinds += [T.StructField("y_true", T.IntegerType()), T.StructField("y_pred", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("loss", T.DoubleType()), T.StructField("seconds", T.DoubleType())]
    else:
        kinds.append(_field(rows.schema, key))
    if counts:
        pass
    elif vote_by is None:
        kinds += [T.StructField("class_id", T.IntegerType()), T.StructField("prob", T.DoubleType())]
    elif predict:
        kinds += ([T.StructField("y_true", T.IntegerType())] if label else []) + [T.StructField("y_pred", T.IntegerType())]
    else:
        kinds += [T.StructField("class_id", T.IntegerType()), T.StructField("total", T.DoubleType())]
    schema = T.StructType(kinds)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    width = len(on)

    def emit(columns):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c.cast(f.type) for c, f in zip(columns, arrow)], arrow.names)

    def spread(values: list, n: int) -> list[np.ndarray]:
        """One column per field of the tuples, each tuple list repeated for n rows."""
        return [np.tile(np.array([v[i] for v in values]), n) for i in range(len(values[0]))] if values and values[0] else []

    def score(batch: pa.RecordBatch, task: tuple):
        metas, classes, weights, shifts, starts, owners = block.value.tasks[task]
        n = len(batch)
        began = time.perf_counter()
        x = batch.column(width + 1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
        p = softmax_by_segment(x @ weights.T + shifts, starts)  # for centroids |x|^2 is common to a row's classes
        keys = batch.column(width)
        again = lambda k: keys.take(pa.array(np.repeat(np.arange(n), k)))
        fixed = lambda k: [pa.array([t] * (n * k)) for t in task]
        if vote_by is None:
            k = len(classes)
            return emit([*fixed(k), *spread(metas, n), again(k), np.tile(classes, n), p.ravel()])
        if members is None:
            place = [mc.index(c) for c in vote_by]
            cells = [[(tuple(m[i] for i in place), int(c))] for m, c in zip(metas, classes)]
        else:
            cells = [[(g, int(c)) for g in own] for own, c in zip(owners, classes)]
        unique = sorted({u for own in cells for u in own})
        index = {u: i for i, u in enumerate(unique)}
        member = np.zeros((len(cells), len(unique)))
        for i, own in enumerate(cells):
            member[i, [index[u] for u in own]] = 1.0
        totals = p @ member
        shared = time.perf_counter() - began
        if not predict:
            return emit([*fixed(len(unique)), *spread([u[0] for u in unique], n), again(len(unique)), np.tile(np.array([u[1] for u in unique], np.int32), n), totals.ravel()])
        groups = sorted({u[0] for u in unique})
        if counts:
            truth = batch.column(width + 2).to_numpy()
            share = np.zeros((n, len(groups)))
            for i, (group, c) in enumerate(unique):
                share[:, groups.index(group)] += np.where(truth == c, totals[:, i], 0.0)
            whole = np.column_stack([totals[:, [i for i, u in enumerate(unique) if u[0] == g]].sum(axis=1) for g in groups])
            loss = -np.log(np.maximum(share / whole, LEAST_SHARE))
        totals = np.round(totals, TIE_DECIMALS)
        best = np.empty((n, len(groups)), np.int32)
        spent = np.zeros(len(groups))
        if counts:
            for own in cells:  # a model's time is its ensembles', in equal parts
                for u in own:
                    spent[groups.index(u[0])] += shared / (len(cells) * len(own))
        for g, group in enumerate(groups):
            began = time.perf_counter()
            own = [i for i, u in enumerate(unique) if u[0] == group]  # ascending classes: the first maximum is the lowest
            best[:, g] = np.array([unique[i][1] for i in own], np.int32)[np.argmax(totals[:, own], axis=1)]
            spent[g] += time.perf_counter() - began
        if counts:
            cells, place = np.unique(np.stack([np.tile(np.arange(len(groups)), n), np.repeat(truth, len(groups)), best.ravel()]), axis=1, return_inverse=True)
            place = place.ravel()
            made = [groups[g] for g in cells[0]]
            share = spent[cells[0]] / np.bincount(cells[0], minlength=len(groups))[cells[0]]
            return emit([*[pa.array([t] * len(made)) for t in task], *[[m[i] for m in made] for i in range(len(vote_by))], cells[1].astype(np.int32), cells[2].astype(np.int32),
                         np.bincount(place, minlength=len(made)), np.bincount(place, loss.ravel(), len(made)), share])
        truth = [batch.column(width + 2).take(pa.array(np.repeat(np.arange(n), len(groups))))] if label else []
        return emit([*fixed(len(groups)), *spread(groups, n), again(len(groups)), *truth, best.ravel()])

    def run(batches):
        for batch in batches:
            names = list(zip(*(batch.column(i).to_pylist() for i in range(width)))) if width else [()] * len(batch)
            for task in dict.fromkeys(names):
                if task in block.value.tasks:
                    own = batch.take(pa.array([i for i, t in enumerate(names) if t == task])) if len(set(names)) > 1 else batch
                    metas = block.value.tasks[task][0]
                    step = max(1, 4_000_000 // len(metas))
                    for a in range(0, len(own), step):
                        yield score(own.slice(a, step), task)

    extra = [F.col(label).cast("int").alias(label)] if label and predict and vote_by is not None else []
    return rows.where(F.col(vec).isNotNull()).select(*on, key, F.col(vec).alias("_vec"), *extra).mapInArrow(run, schema)


HOT_BYTES = 64 << 20  # of the most likely tokens' log-likelihoods in one broadcast
SLICE_VALUES = 1 << 18  # tokens, or values of texts' sums, that a text-scoring task works on at once
HELD_VALUES = 1 << 21  # values of partial sums that a task holds


def _tidy(run):
    """A task function that leaves no freed memory in its worker, which outlives it."""

    def task(batches):
        import ctypes

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return task


def pack_naive_bayes(loglik: DataFrame, prior: DataFrame, model_cols: Sequence[str] = ("replica",)) -> DataFrame:
    """The scoring form of a naive-Bayes ensemble: one row per token, ``cells`` = array of
    (model, class, loglik) in (model, class) order, ``top`` = the largest of them, and the
    priors under a null token. Build and write it once after training."""
    entry = F.struct(*model_cols, "class_id", "loglik")
    by_token = loglik.groupBy("token").agg(F.sort_array(F.collect_list(entry)).alias("cells"), F.max("loglik").alias("top"))
    priors = prior.withColumnRenamed("log_prior", "loglik").agg(F.sort_array(F.collect_list(entry)).alias("cells"))
    return by_token.unionByName(priors.select(F.lit(None).cast("string").alias("token"), "cells", F.lit(0.0).alias("top")))


def _dense(packed: DataFrame, cells: list[tuple], mc: list) -> DataFrame:
    """(token, top, ll): the log-likelihoods of a token under all models and classes as one array; unknown ones add 0."""
    place = {c: i for i, c in enumerate(cells)}

    def run(batches):
        step = max(1, SLICE_VALUES // len(cells))
        for batch in (whole.slice(a, step) for whole in batches for a in range(0, len(whole), step)):
            own = batch.column(1)
            entries, owner = own.flatten(), np.repeat(np.arange(len(batch)), own.value_lengths().to_numpy())
            at = np.fromiter((place[n] for n in zip(*(entries.field(c).to_pylist() for c in (*mc, "class_id")))), np.int64, len(entries))
            ll = np.zeros((len(batch), len(cells)))
            ll[owner, at] = entries.field("loglik").to_numpy(zero_copy_only=False)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * len(cells), pa.int32()), pa.array(ll.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), lists], ["token", "top", "ll"])

    return packed.where("token IS NOT NULL").select("token", "cells", "top").mapInArrow(_tidy(run), "token string, top double, ll array<double>")


def _lists(values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel()))


def score_naive_bayes(rows: DataFrame, packed: DataFrame, key: str, text: str = "text", label: str | None = None,
                      model_cols: Sequence[str] = ("replica",), predict: bool = False, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """T4 for the text path: ``(model..., key, class_id, prob)``, or with ``predict`` the fused soft vote and
    arg-max of all models, ``(key[, y_true], y_pred)``.

    score = log prior + sum over the row's tokens of the model's log-likelihood (tokens the model has not
    seen add nothing), then a softmax per (model, row). The log-likelihoods of a token are one array over all
    models and classes, and sums are vectors in Arrow tasks, so the plan is the same for any number of models. Texts are
    tokenised once. The arrays of the most likely tokens, as many as fit in ``hot_bytes``, are broadcast and added up
    where the text is; the tokens of a text that are not among them go to a join with the rest of the model (none
    of these is frequent) and come back as one partial sum a text and task. If the whole model fits there is no shuffle.
    """
    from quiver.operators.learn import tokens
    from quiver.session import materialize

    ship_package(rows.sparkSession)
    mc = list(model_cols)
    prior = packed.where("token IS NULL").select(F.explode("cells").alias("c")).select("c.*").collect()  # models x classes
    cells = sorted(tuple(r[c] for c in (*mc, "class_id")) for r in prior)
    place = {c: i for i, c in enumerate(cells)}
    start = np.zeros(len(cells))
    for r in prior:
        start[place[tuple(r[c] for c in (*mc, "class_id"))]] = r["loglik"]
    model = materialize(_dense(packed, cells, mc))
    room = hot_bytes // (8 * len(cells) + 64)
    first = model.orderBy(F.desc("top"), "token").limit(room).toArrow() if room else model.limit(0).toArrow()  # at most hot_bytes
    whole = len(first) == model.count()
    hot = rows.sparkSession.sparkContext.broadcast((first.column("token").combine_chunks(), first.column("ll").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(first), len(cells))))
    truth = F.col(label).cast("int") if label else F.lit(None).cast("int")
    said = rows.select(F.col(key), truth.alias("y_true"), F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")).alias("tokens"))

    def add_hot(batches):
        """(key, y_true, s, rest): the sum over the text's hot tokens, and its other tokens."""
        import pyarrow.compute as pc

        names, table = hot.value
        step = max(1, SLICE_VALUES // len(cells))
        for whole in batches:
            listed = whole.column(2)
            flat, ends = listed.flatten(), np.cumsum(listed.value_lengths().to_numpy(), dtype=np.int64)
            found = pc.index_in(flat, value_set=names).fill_null(-1).to_numpy() if len(names) else np.full(len(flat), -1, np.int32)
            row = 0
            while row < len(whole):  # some texts at once: as many as have few tokens and sums, or a single one
                low = int(ends[row - 1]) if row else 0
                end = min(max(int(np.searchsorted(ends, low + SLICE_VALUES, side="right")), row + 1), row + step, len(whole))
                batch, at = whole.slice(row, end - row), found[low : ends[end - 1]]
                owner = np.repeat(np.arange(end - row), np.diff(ends[row:end], prepend=low))
                known = np.flatnonzero(at >= 0)
                s = np.zeros((end - row, len(cells)))
                for a in range(0, len(known), step):
                    part = known[a : a + step]
                    edges = np.flatnonzero(np.append(True, owner[part][1:] != owner[part][:-1]))
                    s[owner[part][edges]] += np.add.reduceat(table[at[part]], edges, axis=0)
                other = np.flatnonzero(at < 0)
                bounds = np.concatenate(([0], np.cumsum(np.bincount(owner[other], minlength=end - row))))
                rest = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), flat.take(pa.array(other + low)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(s), rest], [key, "y_true", "s", "rest"])
                row = end

    id_field = _field(rows.schema, key)
    partial = T.StructType([id_field, T.StructField("y_true", T.IntegerType()), T.StructField("s", T.ArrayType(T.DoubleType()))])
    hot_sums = said.mapInArrow(_tidy(add_hot), T.StructType([*partial.fields, T.StructField("rest", T.ArrayType(T.StringType()))]))
    if whole:
        total = hot_sums.drop("rest")
    else:
        hot_sums = materialize(hot_sums)
        names = F.broadcast(rows.sparkSession.createDataFrame([(t,) for t in first.column("token").to_pylist()], "token string"))
        rare = hot_sums.select(key, F.explode("rest").alias("token")).join(model.join(names, "token", "left_anti").select("token", "ll"), "token")

        def add_up(batches):
            """Partial sums of a task: one vector a text, as long as they fit."""
            held, total = {}, np.zeros((0, len(cells)))
            for batch in batches:
                ll = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
                if len(held) + len(ll) > len(total):
                    if held:
                        yield emit(held, total)
                    held, total = {}, np.zeros((max(HELD_VALUES // len(cells), len(ll)), len(cells)))
                at = np.fromiter((held.setdefault(k, len(held)) for k in batch.column(0).to_pylist()), np.int64, len(batch))
                np.add.at(total, at, ll)
            if held:
                yield emit(held, total)

        def emit(held, total):
            kind = to_arrow_schema(partial).field(0).type
            return pa.RecordBatch.from_arrays([pa.array(list(held), kind), pa.nulls(len(held), pa.int32()), _lists(total[: len(held)])], partial.names)

        def merge(batches):
            """Texts lie together, sorted by key: their vectors are added up."""
            last, truth, total = None, None, None
            for batch in batches:
                s = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
                out = []
                for k, y, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), s):
                    if total is not None and k == last:
                        total, truth = total + v, y if truth is None else truth
                    else:
                        if total is not None:
                            out.append((last, truth, total))
                        last, truth, total = k, y, v.copy()
                if out:
                    yield finished(out)
            if total is not None:
                yield finished([(last, truth, total)])

        def finished(out):
            arrow = to_arrow_schema(partial)
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], arrow.field(0).type), pa.array([o[1] for o in out], pa.int32()), _lists(np.stack([o[2] for o in out]))], partial.names)

        from pyspark.sql.pandas.types import to_arrow_schema

        both = hot_sums.drop("rest").unionByName(rare.select(key, "ll").mapInArrow(_tidy(add_up), partial))
        total = both.repartition(key).sortWithinPartitions(key).mapInArrow(_tidy(merge), partial)

    models = [c[:-1] for c in cells]
    starts = np.array([i for i, m in enumerate(models) if not i or m != models[i - 1]])
    classes = np.array([c[-1] for c in cells], np.int32)
    unique = np.unique(classes)
    if predict:
        schema = T.StructType([id_field] + ([T.StructField("y_true", T.IntegerType())] if label else []) + [T.StructField("y_pred", T.IntegerType())])
    else:
        schema = T.StructType([_field(packed.schema["cells"].dataType.elementType, c) for c in mc] + [id_field, T.StructField("class_id", T.IntegerType()), T.StructField("prob", T.DoubleType())])

    def run(batches):
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            p = softmax_by_segment(batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) + start, starts)
            if predict:
                votes = np.round(np.column_stack([p[:, classes == c].sum(axis=1) for c in unique]), TIE_DECIMALS)
                out = [batch.column(0), *([batch.column(1)] if label else []), pa.array(unique[np.argmax(votes, axis=1)].astype(np.int32))]
            else:
                k = len(cells)
                out = [*[pa.array(np.tile(np.array([m[i] for m in models]), n), pa.int32()) for i in range(len(mc))],
                       batch.column(0).take(pa.array(np.repeat(np.arange(n), k))), pa.array(np.tile(classes, n)), pa.array(p.ravel())]
            yield pa.RecordBatch.from_arrays(out, schema.names)

    return total.mapInArrow(_tidy(run), schema)
