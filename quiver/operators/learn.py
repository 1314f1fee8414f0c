"""Distributed learners trained for many replicas at once (T1, T2; T3 is in ``linear``).

Every learner takes a multiplicity column, so a bootstrap replica is a weighting of
the rows, never a copy of them, and all replicas train in one aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def train_centroids(train: DataFrame, samples: DataFrame | None, key: str, vec: str = "embedding",
                    label: str = "label", model_cols: Sequence[str] = ("replica",), reps=None) -> DataFrame:
    """Weighted class mean per (model, class, dim) -> ``(model..., class_id, dim, value)``.

    Each row meets its packed multiplicities (one entry a model that drew it) in a 1:1 join, or gets them
    from ``reps``, a row-local ``array<struct<replica, mult>>`` column such as :func:`sampling.poisson_reps`,
    without any join. Every task multiplies its multiplicity matrix with its vectors, so the shuffle carries
    at most models x classes x dims partial sums per task and no vector is ever copied per model.
    """
    sums = centroid_sums(train, samples, key, vec, label, model_cols, reps)
    return sums.select(*model_cols, "class_id", "dim", (F.col("sx") / F.col("sw")).alias("value"))


def centroid_sums(train: DataFrame, samples: DataFrame | None, key: str, vec: str = "embedding",
                  label: str = "label", model_cols: Sequence[str] = ("replica",), reps=None) -> DataFrame:
    """The sums behind T1, ``(model..., class_id, dim, sx, sw)``: weighted sum and weight, which add up over classes that are joined."""
    from quiver.session import ship_package

    ship_package(train.sparkSession)
    mc = list(model_cols)
    base = train.select(key, F.col(label).cast("int").alias("_class"), F.col(vec).alias("_vec")).where("_class IS NOT NULL AND _vec IS NOT NULL")
    if reps is not None:
        rows = base.withColumn("_reps", reps)
    else:
        rows = base.join(_packed_mults(samples, key, mc), key)
    rows = rows.where(F.size("_reps") > 0).select("_class", "_vec", "_reps")
    element = rows.schema["_reps"].dataType.elementType
    schema = T.StructType([T.StructField(c, element[c].dataType) for c in mc] + [
        T.StructField("class_id", T.IntegerType()), T.StructField("weight", T.DoubleType()), T.StructField("sums", T.ArrayType(T.DoubleType()))])

    def partial(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
            drawn = batch.column(2)
            entries = drawn.flatten()
            owner = np.repeat(np.arange(n), drawn.value_lengths().to_numpy())
            names = list(zip(*(entries.field(c).to_pylist() for c in mc)))
            weight = entries.field("mult").to_numpy(zero_copy_only=False).astype(np.float64)
            classes = batch.column(0).to_numpy()
            groups = list(zip(names, classes[owner].tolist()))
            index = {g: i for i, g in enumerate(dict.fromkeys(groups))}
            place = np.fromiter((index[g] for g in groups), np.int64, len(groups))
            x1 = np.column_stack((np.ones(n), x))
            for a in range(0, n, 4096):  # multiplicities of some rows as a dense matrix: groups x rows
                own = (owner >= a) & (owner < a + 4096)
                m = np.zeros((len(index), min(4096, n - a)))
                np.add.at(m, (place[own], owner[own] - a), weight[own])
                part = m @ x1[a : a + 4096]
                for g, i in index.items():
                    total[g] = total[g] + part[i] if g in total else part[i].copy()
        if total:
            keys, values = list(total), list(total.values())
            arrow = to_arrow_schema(schema)
            columns = [pa.array([k[0][i] for k in keys], arrow.field(i).type) for i in range(len(mc))]
            columns += [pa.array([k[1] for k in keys], pa.int32()), pa.array([v[0] for v in values]), pa.array([v[1:] for v in values], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, arrow.names)

    cells = rows.mapInArrow(partial, schema).select(*mc, "class_id", "weight", F.posexplode("sums").alias("dim", "x"))
    return cells.groupBy(*mc, "class_id", "dim").agg(F.sum("x").alias("sx"), F.sum("weight").alias("sw"))


def pack_centroids(cent: DataFrame, model_cols: Sequence[str] = ("replica",)) -> DataFrame:
    """One row per model: ``classes`` = sorted array of (class_id, mu array ordered by dim).

    Groups are bounded by the model's own size (classes x dims), not by the data.
    """
    per_class = cent.groupBy(*model_cols, "class_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda s: s["value"]).alias("mu"))
    return per_class.groupBy(*model_cols).agg(
        F.array_sort(F.collect_list(F.struct("class_id", "mu"))).alias("classes"))


TOKEN_PATTERN = r"[\p{L}\p{N}]+"


def tokens(text):
    """Lower-cased runs of letters and digits of any script, of the whole text (JVM regex, no Python)."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), 0)


def _packed_mults(samples: DataFrame, key: str, model_cols: Sequence[str]) -> DataFrame:
    """(key, _reps): each drawn row's multiplicity per replica, at most one entry per replica."""
    return samples.groupBy(key).agg(F.collect_list(F.struct(*model_cols, "mult")).alias("_reps"))


def train_naive_bayes(train: DataFrame, samples: DataFrame | None, key: str, text: str = "text", label: str = "label",
                      alpha: float = 1.0, model_cols: Sequence[str] = ("replica",),
                      reps=None) -> tuple[DataFrame, DataFrame]:
    """Multinomial naive Bayes for every replica at once.

    Returns ``(loglik, prior)``: ``(model..., class_id, token, loglik)`` over each replica's
    vocabulary (tokens seen in that replica) with add-``alpha`` smoothing, and
    ``(model..., class_id, log_prior)`` from the weighted document counts.

    Multiplicities are packed per document (bounded by the replica count) and joined 1:1,
    so a document's text is tokenized once; token counts are combined map-side, so a very
    frequent token never reaches the shuffle as more than one row per task. ``reps`` (a
    column such as :func:`sampling.poisson_reps`) computes the packed multiplicities from the
    row itself instead of ``samples``: no join, so texts are not shuffled at all.
    """
    from quiver.session import materialize

    mc = list(model_cols)
    base = train.select(key, F.col(label).cast("int").alias("class_id"), text)
    if reps is not None:
        docs = base.withColumn("_reps", reps).filter(F.size("_reps") > 0)
    else:
        # Per-document multiplicities (at most one entry per replica), written once: read by the
        # token counts and the class counts.
        docs = base.join(materialize(_packed_mults(samples, key, mc)), key)
    reps = [F.col(f"_r.{c}").alias(c) for c in mc]
    counts = (docs.select("class_id", "_reps", F.explode(tokens(F.col(text))).alias("token"))
              .select("class_id", "token", F.explode("_reps").alias("_r"))
              .select(*reps, "class_id", "token", F.col("_r.mult").alias("mult"))
              .groupBy(*mc, "class_id", "token").agg(F.sum("mult").alias("cnt")))
    # The counts are the model's sufficient statistics (vocabulary-sized, not data-sized) and feed
    # aggregates below: write them once instead of tokenizing the training texts again.
    counts = materialize(counts)
    classes = (docs.select("class_id", F.explode("_reps").alias("_r"))
               .select(*reps, "class_id", F.col("_r.mult").alias("mult"))
               .groupBy(*mc, "class_id").agg(F.sum("mult").alias("docs")))
    # One row per (model, token) of the vocabulary with its per-class counts (at most C entries).
    by_token = counts.groupBy(*mc, "token").agg(
        F.map_from_entries(F.collect_list(F.struct("class_id", "cnt"))).alias("_cc"))
    totals = counts.groupBy(*mc, "class_id").agg(F.sum("cnt").alias("total"))
    vocab = by_token.groupBy(*mc).agg(F.count(F.lit(1)).alias("v"))
    # Per-model dimension rows (replicas x classes): small by construction, broadcast.
    dims = (classes.join(totals, mc + ["class_id"], "left").join(vocab, mc)
            .select(*mc, "class_id", F.coalesce("total", F.lit(0)).alias("total"), "v"))
    loglik = (by_token.join(F.broadcast(dims), mc)
              .select(*mc, "class_id", "token",
                      F.log((F.coalesce(F.try_element_at("_cc", F.col("class_id")), F.lit(0)) + F.lit(alpha)) /
                            (F.col("total") + F.lit(alpha) * F.col("v"))).alias("loglik")))
    # ``classes`` has replicas x classes rows, so this window is over a tiny table.
    prior = classes.select(*mc, "class_id",
                           F.log(F.col("docs") / F.sum("docs").over(Window.partitionBy(*mc))).alias("log_prior"))
    return loglik, prior
