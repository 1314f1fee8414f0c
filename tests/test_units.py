"""Failing units, their times, audited alignment, replayed runs."""

import random
import time
from collections import Counter

from pyspark.sql import functions as F

from conftest import SF001
from quiver.operators import ensemble
from quiver.plans import evaluate as EV
from quiver.sources import sinks as SK


def configs(spark, rows):
    return spark.createDataFrame(rows, "config int, task string, num_models int, pruning_factor double")


def test_one_bad_unit_leaves_the_others_alone(spark):
    emb = spark.read.parquet(f"{SF001}/embeddings.parquet")
    good = [(k, "embeddings", 3 + k, 0.1 * k) for k in range(4)]
    bad = [(7, "embeddings", 3, None), (8, None, 3, 0.1), (9, "nonsense", 3, 0.1), (10, "embeddings", 40, 0.1), (11, "embeddings", 3, -0.5)]
    whole = EV.evaluate(emb, configs(spark, good))
    mixed = EV.evaluate(emb, configs(spark, good + bad))
    key = lambda ev: sorted((r["config"], round(r["accuracy"], 9), round(r["macro_f1"], 9)) for r in ev.results.collect())
    assert key(mixed) == key(whole) and len(key(whole)) == 4
    errors = {r["config"]: r["error"] for r in mixed.all_errors.collect()}
    assert errors == {7: "pruning factor null", 8: "unknown task null", 9: "unknown task nonsense", 10: "missing 30 of 40 models", 11: "pruning factor -0.5"}


def test_models_with_bad_weights_fail_their_units_only(spark):
    emb = spark.read.parquet(f"{SF001}/embeddings.parquet")

    def broken(task, w):
        v = F.when((F.col("replica") == 2) & (F.col("dim") == 0), float("inf")).when((F.col("replica") == 5) & (F.col("dim") == 1), F.lit(None)).otherwise(F.col("value"))
        return w.withColumn("value", v).where("NOT (replica = 7 AND dim = 3)")

    rows = [(k, "embeddings", 1, 0.0) for k in range(40)] + [(40, "parity", 10, 0.2)]
    ev = EV.evaluate(emb, configs(spark, rows), weights=broken)
    picks = {r["config"]: r["model_no"] for r in ev._valid.where("task = 'embeddings'").collect()}
    want = {c: f"model {m}: weights {'missing' if m == 7 else 'not finite'}" for c, m in picks.items() if m in (2, 5, 7)}
    want[40] = "model 2: weights not finite"
    assert {r["config"]: r["error"] for r in ev.all_errors.collect()} == want and len(want) > 3
    assert {r["config"] for r in ev.results.collect()} == set(picks) - set(want)


def test_every_unit_has_its_own_time(spark):
    emb = spark.read.parquet(f"{SF001}/embeddings.parquet")
    began = time.time()
    rows = EV.evaluate(emb, configs(spark, [(0, "embeddings", 1, 0.0), (1, "embeddings", 10, 0.3), (2, "parity", 2, 0.1)])).timed.collect()
    assert len(rows) == 3 and all(0 < r["time"] < time.time() - began for r in rows) and len({r["time"] for r in rows}) == 3


def test_nothing_to_evaluate(spark):
    ev = EV.evaluate(spark.read.parquet(f"{SF001}/embeddings.parquet"), configs(spark, [(1, "nonsense", 3, 0.1)]))
    assert ev.results.collect() == [] and ev.timed.collect() == [] and ev.all_errors.count() == 1


def test_alignment_accounts_for_every_key(spark):
    rng = random.Random(1)
    pred = [(rng.choice([*range(40), None]), rng.randrange(3), "x") for _ in range(60)]
    truth = [(rng.choice([*range(40), None]), rng.randrange(3), 7) for _ in range(60)]
    pairs, audit = ensemble.audited_align(spark.createDataFrame(pred, "k int, y_pred int, p string").repartition(3), spark.createDataFrame(truth, "k int, label int, t int").repartition(4), "k")
    p, t = Counter(r[0] for r in pred), Counter(r[0] for r in truth)
    want = {}
    for k in p.keys() | t.keys():
        name = "null key" if k is None else "no truth" if not t[k] else "no prediction" if not p[k] else "duplicate both" if p[k] > 1 and t[k] > 1 else "duplicate prediction" if p[k] > 1 else "duplicate truth" if t[k] > 1 else "matched"
        n = want.get(name, (0, 0))
        want[name] = n[0] + 1, n[1] + p[k] + t[k]
    assert {r["status"]: (r["n_keys"], r["n_rows"]) for r in audit.collect()} == want
    first = lambda rows, k: next(r[1] for r in rows if r[0] == k)
    assert sorted(map(tuple, pairs.collect())) == sorted((k, first(pred, k), first(truth, k)) for k in p if k is not None and p[k] == t[k] == 1)
    empty = spark.createDataFrame([], "k int, y_pred int, p string")
    assert {r["status"] for r in ensemble.audited_align(empty, spark.createDataFrame([(1, 2)], "k int, label int"), "k")[1].collect()} == {"no prediction"}


def test_a_replayed_run_leaves_one_copy(spark, tmp_path):
    run = lambda n, extra=0: spark.createDataFrame([(k, "CB", 0.5 + extra, 0.6, 0.7) for k in range(n)], "config int, task string, time double, accuracy double, macro_f1 double")
    for fmt in ("parquet", "csv"):
        path = str(tmp_path / fmt)
        for run_id, n in ((0, 5), (1, 3), (0, 4), (1, 0)):
            SK.append_report(run(n, run_id), path, run_id, fmt)
        back = spark.read.option("header", True).option("inferSchema", True).format(fmt).load(path)
        assert Counter(r["run_id"] for r in back.collect()) == {0: 4, 1: 3}
        assert {(r["run_id"], r["time"]) for r in back.collect()} == {(0, 0.5), (1, 1.5)}
