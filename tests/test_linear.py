"""Linear learners: joint logistic regression, mini-batch descent, vector sums, counted confusions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiver.functions.hashing import h
from quiver.operators import linear as L
from quiver.operators import metrics, sampling, score, vectors
from quiver.operators.ensemble import align_truth, predict
from pyspark.sql import types as T

DIMS = 6
NAME = T.StructType([T.StructField("replica", T.IntegerType())])


@pytest.fixture(scope="module")
def emb(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((3, DIMS))
    rows = []
    for i in range(300):
        c = int(rng.integers(3))
        rows.append((i, (centres[c] + 1.2 * rng.standard_normal(DIMS)).tolist(), c, c % 2))
    rows += [(1000, None, 1, 1), (1001, [0.0] * DIMS, None, None)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, parity int").repartition(5)


def test_vector_sums_do_not_depend_on_partitions(spark, monkeypatch):
    def task(batches):
        out = np.zeros(300_000)
        for b in batches:
            out[b.column(0).to_numpy()] += 1.0
        return out

    for parts in (1, 7, 40):
        got = vectors.summed(spark.range(200_000).repartition(parts), task, 300_000)
        assert got.sum() == 200_000 and got[:200_000].min() == 1.0 and not got[200_000:].any()


def test_joint_solver_equals_mllib(spark, emb):
    """The same optimum as one MLlib fit a replica and penalty, at a hundredth of a thousandth."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    usable = emb.where("embedding IS NOT NULL AND label IS NOT NULL")
    samples = sampling.bootstrap_exact(usable, "vec_id", 2)
    found = L.train_logistic(emb, samples, "vec_id", reg_param={("a",): 0.05, ("b",): 0.3}, tol=1e-7)
    assert found.names == [(v, r) for v in "ab" for r in range(2)]
    for name, theta in zip(found.names, found.theta):
        data = usable.join(samples.where(F.col("replica") == name[1]), "vec_id").select(array_to_vector("embedding").alias("features"), F.col("label").cast("double").alias("label"), F.col("mult").cast("double").alias("w"))
        fit = LogisticRegression(family="multinomial", weightCol="w", regParam={"a": 0.05, "b": 0.3}[name[0]], standardization=False, maxIter=500, tol=1e-13).fit(data)
        assert np.abs(fit.coefficientMatrix.toArray() - theta[:, :-1]).max() < 1e-5
        centred = theta[:, -1] - theta[:, -1].mean()
        assert np.abs(fit.interceptVector.toArray() - centred).max() < 1e-5


def test_blocks_of_models_give_the_same_fit(spark, emb):
    samples = sampling.bootstrap_exact(emb.where("embedding IS NOT NULL AND label IS NOT NULL"), "vec_id", 2)
    whole = L.train_logistic(emb, samples, "vec_id", reg_param=0.5, tol=1e-8)
    split = L.train_logistic(emb, samples, "vec_id", reg_param=0.5, tol=1e-8, block_bytes=1)
    assert whole.names == split.names and np.abs(whole.theta - split.theta).max() < 1e-6


def test_a_sample_without_a_class_leaves_it_out(spark, emb):
    usable = emb.where("embedding IS NOT NULL AND label IS NOT NULL")
    samples = usable.where("label <> 2").select(F.lit(0).alias("replica"), "vec_id", F.lit(1).alias("mult")).unionByName(usable.select(F.lit(1).alias("replica"), "vec_id", F.lit(2).alias("mult")))
    found = L.train_logistic(emb, samples, "vec_id", reg_param=0.1, tol=1e-3)
    assert found.known.tolist() == [[True, True, False], [True, True, True]] and not found.theta[0, 2].any()
    packed = {r["replica"]: [c["class_id"] for c in r["classes"]] for r in found.packed(spark, NAME).collect()}
    assert packed == {0: [0, 1], 1: [0, 1, 2]}


def test_the_penalty_must_be_positive(spark):
    for bad in (0.0, {("x",): 0.1, ("y",): 0.0}):
        with pytest.raises(ValueError):
            L.train_logistic(None, None, "k", reg_param=bad)


def test_no_rows_no_models(spark, emb):
    none = L.train_logistic(emb, spark.createDataFrame([], "replica int, vec_id long, mult int"), "vec_id", reg_param=0.1)
    assert none.names == [] and none.packed(spark, NAME).count() == 0


def brute_sgd(rows, count, trials, classes):
    """Mini-batch descent with averaging, row by row: rows of (slice, order, x, labels)."""
    out = []
    for t in trials:
        w = np.zeros((classes[t.label], DIMS + 1))
        for _ in range(t.epochs):
            parts = []
            for s in range(count):
                own = sorted(r for r in rows if r[0] == s)
                if not own:
                    continue
                v = w.copy()
                known = [r for r in own if r[3][t.label] is not None]
                for a in range(0, len(known), t.batch):
                    g = np.zeros_like(v)
                    batch = known[a : a + t.batch]
                    for r in batch:
                        x = [*r[2], 1.0]
                        z = [sum(p * q for p, q in zip(x, c)) for c in v]
                        total = sum(math.exp(q) for q in z)
                        for c in range(len(v)):
                            g[c] += (math.exp(z[c]) / total - (r[3][t.label] == c)) * np.array(x) / len(batch)
                    g[:, :-1] += t.weight_decay * v[:, :-1]
                    v -= t.rate * g
                parts.append((len(own), v))
            w = sum(n * v for n, v in parts) / sum(n for n, _ in parts)
        out.append(w)
    return out


def test_descent_equals_brute_force(spark, emb):
    """Several slices, two labels, trials of other lengths, batches, rates and decays, trained together and in blocks."""
    classes = {"label": 3, "parity": 2}
    trials = [L.Trial((f"t{i}",), label, e, b, r, d) for i, (label, e, b, r, d) in enumerate([("label", 3, 16, 0.5, 0.1), ("label", 1, 32, 0.5, 0.1), ("label", 3, 16, 0.9, 0.0), ("parity", 2, 16, 0.5, 0.1)])]
    usable = emb.where("embedding IS NOT NULL")
    count = math.ceil(usable.count() / 70)
    placed = usable.select(F.pmod(h("sgd-slice", F.col("vec_id")), F.lit(count)).alias("s"), h("sgd", F.col("vec_id")).alias("h"), "vec_id", "embedding", "label", "parity").collect()
    want = brute_sgd([(r["s"], (r["h"], r["vec_id"]), r["embedding"], {"label": r["label"], "parity": r["parity"]}) for r in placed], count, trials, classes)
    for parts, block in ((1, 1 << 20), (6, 1)):
        found = L.train_sgd(L.slices(emb.repartition(parts), "vec_id", "embedding", ["label", "parity"], rows=70), trials, classes, DIMS, block_bytes=block)
        for t, w in zip(trials, want):
            own = found[t.label]
            assert np.abs(own.theta[own.names.index(t.name)] - w).max() < 1e-9


def test_counted_confusions_equal_predictions(spark, emb):
    """Fused counts and losses, in one block and in many, against probabilities row by row."""
    usable = emb.where("embedding IS NOT NULL AND label IS NOT NULL")
    samples = sampling.bootstrap_exact(usable, "vec_id", 4)
    models = L.train_logistic(emb, samples, "vec_id", reg_param=0.2, tol=1e-3).packed(spark, NAME).withColumn("task", F.lit("t")).withColumn("half", F.col("replica") % 2)
    rows = emb.withColumn("task", F.lit("t"))
    probs = score.score_centroids(rows.where("label IS NOT NULL"), models, "vec_id", model_cols=["replica", "half"]).drop("task")
    for group in (["replica", "half"], ["half"]):
        totals = probs.groupBy(*group, "vec_id", "class_id").agg(F.sum("prob").alias("total"))
        pred = align_truth(predict(totals, "vec_id", group), usable, "vec_id")
        want = {tuple(r[c] for c in [*group, "y_true", "y_pred"]): r["n"] for r in metrics.confusion(pred, group).collect()}
        share = totals.join(usable.select("vec_id", "label"), "vec_id").groupBy(*group, "vec_id").agg((F.sum(F.when(F.col("class_id") == F.col("label"), F.col("total")).otherwise(0.0)) / F.sum("total")).alias("p"))
        loss = {tuple(r[c] for c in group): r["l"] for r in share.groupBy(*group).agg(F.sum(-F.log("p")).alias("l")).collect()}
        for block in (score.BLOCK_BYTES, 200):
            got = score.confusion_counts(rows, models, "vec_id", model_cols=["replica", "half"], vote_by=group, block_bytes=block).collect()
            assert {tuple(r[c] for c in [*group, "y_true", "y_pred"]): r["n"] for r in got} == want
            sums = {}
            for r in got:
                k = tuple(r[c] for c in group)
                sums[k] = sums.get(k, 0.0) + r["loss"]
            assert sums.keys() == loss.keys() and all(abs(sums[k] - loss[k]) < 1e-8 for k in loss)
