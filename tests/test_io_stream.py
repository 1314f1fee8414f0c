import json
import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF001
from quiver.sources import readers as RD
from quiver.sources import sinks as SK


def _tmp():
    return tempfile.mkdtemp(prefix="quiver-io-")


def test_read_task_cb_and_boolq(spark):
    d = _tmp()
    with open(os.path.join(d, "cb.jsonl"), "w") as f:
        f.write(json.dumps({"premise": "p", "hypothesis": "h", "label": "neutral", "idx": 0}) + "\n")
        f.write(json.dumps({"premise": "q", "hypothesis": "i", "label": "entailment", "idx": 1}) + "\n")
    rows = RD.read_task(spark, os.path.join(d, "cb.jsonl"), "CB").collect()
    assert [r["idx"] for r in rows] == [0, 1] and rows[0]["label"] == "neutral"
    with open(os.path.join(d, "bq.jsonl"), "w") as f:
        f.write(json.dumps({"question": "q", "passage": "p", "label": True, "idx": 3}) + "\n")
    assert RD.read_task(spark, os.path.join(d, "bq.jsonl"), "BoolQ").collect()[0]["label"] is True


def test_read_hyperparams_keeps_file_order(spark):
    d = _tmp()
    rows = [{"model_name": "m", "task": "CB", "n_epochs": 5, "train_batch_size": 16, "learning_rate": 3e-5, "weight_decay": 0.1},
            {"model_name": "m", "task": "CB", "n_epochs": 3, "train_batch_size": 32, "learning_rate": 1e-5, "weight_decay": 0.2}]
    p = os.path.join(d, "hp.json")
    with open(p, "w") as f:
        json.dump(rows, f, indent=1)
    hp = RD.read_hyperparams(spark, p)
    from quiver.plans.experiment import lookup_hyperparams
    got = lookup_hyperparams(spark.createDataFrame([("m", "CB")], "model_type string, task string"), hp).collect()[0]
    assert got["n_epochs"] == 5


def test_results_csv_and_append_sinks(spark):
    d = _tmp()
    p = os.path.join(d, "results.csv")
    with open(p, "w") as f:
        f.write("config,task,time,accuracy,macro_f1\r\n16,CB,0.6,0.928571,0.915205\r\n16,BoolQ,,0.8,0.79")
    res = RD.read_results(spark, p).collect()
    assert res[1]["time"] is None and res[0]["config"] == 16
    out = os.path.join(d, "report")
    df = spark.createDataFrame([(1, "CB", 0.5, 0.6, 0.7)], "config int, task string, time double, accuracy double, macro_f1 double")
    SK.append_report(df, out, run_id=0)
    SK.append_report(df, out, run_id=1)
    back = spark.read.parquet(out)
    assert back.count() == 2 and sorted(r[0] for r in back.select("run_id").collect()) == [0, 1]


def test_results_are_written_in_parts(spark, tmp_path):
    from quiver import registry as R

    spark.read.parquet(f"{SF001}/supplier.parquet").repartition(3).write.parquet(f"{tmp_path}/supplier.parquet")
    out = R.QUERIES["read_results"](spark, str(tmp_path))
    assert len(out.inputFiles()) > 1
    assert all("\r\n" in open(f.removeprefix("file://"), newline="").read() for f in out.inputFiles())
    assert sorted(map(str, out.collect())) == sorted(map(str, R.QUERIES["read_results"](spark, SF001).collect()))


def test_streaming_scoring_matches_batch(spark):
    from quiver.plans import centroid_ensemble as CE
    from quiver.streaming import scoring as ST

    emb = spark.read.parquet(f"{SF001}/embeddings.parquet")
    run = CE.run(emb)
    train, test = CE.train_test(emb, "vec_id")
    src = os.path.join(_tmp(), "src")
    test.withColumn("task", F.lit("embeddings")).select("task", "vec_id", "embedding").write.parquet(src)
    stream = spark.readStream.schema("task string, vec_id long, embedding array<float>").parquet(src)
    out = os.path.join(_tmp(), "out")
    q = ST.score_micro_batches(stream, run.models, test, "vec_id", out, os.path.join(_tmp(), "ckpt"))
    q.awaitTermination(300)
    got = sorted((r["vec_id"], r["y_pred"]) for r in spark.read.parquet(out).collect())
    want = sorted((r["vec_id"], r["y_pred"]) for r in run.predictions.collect())
    assert got == want

    preds = spark.readStream.schema("batch_id long, vec_id long, y_pred int, y_true int").parquet(out)
    q2 = ST.running_confusion(preds, "quiver_conf", os.path.join(_tmp(), "ckpt2"))
    q2.awaitTermination(300)
    n = spark.sql("SELECT sum(n) FROM quiver_conf").collect()[0][0]
    assert n == len(want)
    assert spark.read.parquet(out).columns == ["vec_id", "y_pred", "y_true", "batch_id"]


def test_row_numbers_exact_across_partitions(spark):
    d = _tmp()
    p = os.path.join(d, "exp.csv")
    with open(p, "w") as f:
        f.write("a,b\n" + "".join(f"{i},x{i}\n" for i in range(5000)))
    df = RD.with_row_number(spark.read.option("header", True).csv(p).repartition(1).union(
        spark.read.option("header", True).csv(p)))
    rows = df.select("Row").collect()
    assert sorted(r[0] for r in rows) == list(range(10000))
    single = RD.read_experiment_table(spark, p).select("a", "Row").collect()
    assert all(int(r["a"]) == r["Row"] for r in single)


def test_explicit_assignments_and_samples(spark):
    from quiver.plans import centroid_ensemble as CE

    emb = spark.read.parquet(f"{SF001}/embeddings.parquet")
    assign = emb.select("vec_id", F.when(F.col("vec_id") % 2 == 0, "test").otherwise("val").alias("split"))
    train, test = CE.train_test(emb, "vec_id", assignments=assign)
    assert test.filter(F.col("vec_id") % 2 == 1).count() == 0 and train.count() + test.count() == emb.count()
    samples = train.select(F.lit(0).alias("replica"), "vec_id", F.lit(1).alias("mult"))
    run = CE.run(emb, assignments=assign, samples=samples)
    assert run.models.count() == 1 and run.confusion.agg(F.sum("n")).collect()[0][0] == test.count()


def test_cli_evaluate_and_variance_append(spark):
    from quiver.__main__ import main

    out = _tmp()
    for run in (0, 1):
        main(["evaluate", "--tables", SF001, "--results", f"{out}/res", "--errors", f"{out}/err", "--run-id", str(run)])
    res = spark.read.parquet(f"{out}/res")
    assert res.count() == 80 and res.filter("time IS NULL").count() == 0
    assert spark.read.parquet(f"{out}/err").count() == 20
    from quiver.plans.results import consolidate

    cons = consolidate(res.select("config", "task", "run_id", "accuracy", "macro_f1"))
    assert cons.count() == 40 and cons.filter("run_id = 1 AND n_runs = 2").count() == 40
    main(["variance", "--tables", SF001, "--out", f"{out}/var", "--run-id", "0"])
    rows = spark.read.parquet(f"{out}/var")
    assert rows.count() == 10 * rows.select("config", "model_name", "task").distinct().count() >= 80


def test_experiment_table_of_several_files_is_refused(spark):
    d = _tmp()
    for k in range(2):
        with open(os.path.join(d, f"{k}.csv"), "w") as f:
            f.write("a,b\n1,2\n")
    import pytest

    with pytest.raises(ValueError):
        RD.read_experiment_table(spark, d)


def test_no_shared_folder_is_refused_off_local():
    import pytest

    from quiver import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, name, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())


def test_two_results_of_one_run_resolve_by_value(spark):
    from quiver.plans.results import consolidate

    rows = [(1, "CB", 0, 0.25), (1, "CB", 0, 0.75)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "config int, task string, run_id int, accuracy double").repartition(2)
        assert consolidate(df).collect()[0]["accuracy"] == 0.75
