import pytest
from pyspark.sql import functions as F

from quiver.operators import ensemble as G
from quiver.operators import prune as PR
from quiver.operators import tasks as TK
from quiver.plans import experiment as X


def test_prune_fixture(spark):
    w = spark.createDataFrame([
        (0, "a.weight", 0, 3.0), (0, "a.weight", 1, -1.0), (0, "a.weight", 2, 0.5),
        (0, "b.weight", 0, -0.25), (0, "b.weight", 1, 2.0), (0, "b.weight", 2, 4.0), (0, "b.bias", 0, 0.01),
    ], "model_id int, layer string, pos int, value double")
    f = spark.createDataFrame([(0, 0.5)], "model_id int, pruning_factor double")
    out = {(r["layer"], r["pos"]): r["value"] for r in PR.prune_weights(w, f).collect()}
    assert out[("a.weight", 2)] == 0 and out[("b.weight", 0)] == 0 and out[("a.weight", 1)] == 0
    assert out[("b.bias", 0)] == 0.01 and out[("a.weight", 0)] == 3.0
    c = PR.count_weights(PR.prune_weights(w, f)).collect()[0]
    assert (c["n_params"], c["n_nonzero"]) == (7, 4)


def test_prune_half_even(spark):
    w = spark.createDataFrame([(0, "x.weight", i, float(i + 1)) for i in range(5)], "model_id int, layer string, pos int, value double")
    f = spark.createDataFrame([(0, 0.5)], "model_id int, pruning_factor double")
    zeros = PR.prune_weights(w, f).filter("value = 0").count()
    assert zeros == 2  # round-half-even(2.5)


def _ranked(rows, factor):
    """Brute force: (layer, pos) of the k smallest of one model."""
    weights = [r for r in rows if ".weight" in r[1]]
    return {(l, p) for _, l, p, _ in sorted(weights, key=lambda r: (abs(r[3]), r[1], r[2]))[: round(factor * len(weights))]}


def test_prune_equals_sorting(spark):
    from conftest import SF01
    from quiver.plans import derived as D
    w = D.weights_from_embeddings(spark.read.parquet(f"{SF01}/embeddings.parquet"))
    got = {(r["model_id"], r["layer"], r["pos"]) for r in PR.prune_weights(w, D.model_factors(w)).filter("value = 0").collect()}
    rows = [tuple(r) for r in w.select("model_id", "layer", "pos", "value").collect()]
    want = {(m, l, p) for m in range(5) for l, p in _ranked([r for r in rows if r[0] == m], (m + 1) / 10)}
    assert got == want | {(m, l, p) for m, l, p, v in rows if v == 0}


@pytest.mark.parametrize("factor", [0.0, 0.3, 0.5, 0.9, 1.0])
def test_prune_half_of_one_model_is_zero(spark, factor):
    rows = [(0, f"l{l}.weight", p, 0.0 if p % 2 else 1.0 + p) for l in range(3) for p in range(5000)] + [(1, "l.weight", 0, 2.0)]
    w = spark.createDataFrame(rows, "model_id int, layer string, pos int, value double")
    f = spark.createDataFrame([(0, factor), (1, 0.0)], "model_id int, pruning_factor double")
    got = {(r["model_id"], r["layer"], r["pos"]) for r in PR.prune_weights(w, f).filter("value = 0").collect()}
    want = {(0, l, p) for l, p in _ranked([r for r in rows if r[0] == 0], factor)}
    assert got == want | {(0, l, p) for m, l, p, v in rows if v == 0}


def test_soft_vote_tie_lowest_class(spark):
    scores = spark.createDataFrame([("m1", 1, 0, 0.5), ("m1", 1, 1, 0.5), ("m2", 1, 0, 0.3), ("m2", 1, 1, 0.3)],
                                   "model_id string, idx long, class_id int, prob double")
    pred = G.predict(G.soft_vote(scores, "idx"), "idx").collect()[0]
    assert pred["y_pred"] == 0


def test_label_encode_maps_and_strict(spark):
    cb = spark.createDataFrame([("neutral",), ("entailment",), ("contradiction",)], "label string")
    assert [r["label_id"] for r in TK.label_encode(cb, "CB").collect()] == [0, 1, 2]
    bq = spark.createDataFrame([(True,), (False,)], "label boolean")
    assert [r["label_id"] for r in TK.label_encode(bq, "BoolQ").collect()] == [1, 0]
    mr = spark.createDataFrame([("0",), ("1",)], "label string")
    assert [r["label_id"] for r in TK.label_encode(mr, "MultiRC").collect()] == [0, 1]
    bad = spark.createDataFrame([("maybe",)], "label string")
    with pytest.raises(Exception):
        TK.label_encode(bad, "CB").collect()
    q = TK.label_encode(bad, "CB", quarantine=True).collect()[0]
    assert q["label_id"] is None and "maybe" in q["label_error"]


def test_pair_text_and_path(spark):
    df = spark.createDataFrame([("p", "c1", "c2")], "premise string, choice1 string, choice2 string")
    r = TK.pair_text(df, "COPA").collect()[0]
    assert (r["seq1"], r["seq2"]) == ("p <s> c1", "p <s> c2")
    r = TK.pair_text(df, "COPA", sep=TK.SEP_DEBERTA).collect()[0]
    assert r["seq1"] == "p c1"
    paths = spark.createDataFrame([("/a/b/CB",), ("/a/b/",)], "p string")
    assert [r[0] for r in paths.select(TK.task_of_path(F.col("p"))).collect()] == ["CB", ""]


def test_flatten_nested_qa(spark):
    doc = {"text": "P", "questions": [
        {"question": "q1", "answers": [{"text": "a", "label": 1}, {"text": "b", "label": 0}, {"text": "c", "label": 1}]},
        {"question": "q2", "answers": []}]}
    from pyspark.sql import types as T

    df = spark.createDataFrame([(doc,)], T.StructType([T.StructField("passage", TK.QA_SCHEMA)]))
    rows = TK.flatten_multirc(df, sep=" ").collect()
    assert [(r["passage"], r["question_answer_concat"], r["label"]) for r in rows] == [
        ("P", "q1 a", 1), ("P", "q1 b", 0), ("P", "q1 c", 1)]


def test_model_path_examples(spark):
    t = "/m/gpt2/BoolQ/bootstrapped_*/2022_05_09-01_00_00_AM/"
    df = spark.createDataFrame([(t, 4, "gpt2", "BoolQ"), (t, 12, "gpt2", "BoolQ"), ("/m/x/", 3, "gpt2", "CB"),
                                (t, 12, "roberta", "CB")], "t string, n int, mt string, task string")
    path, err = X.model_path(F.col("t"), F.col("n"), F.col("mt"), F.col("task"))
    out = [(r[0], r[1]) for r in df.select(path, err).collect()]
    assert out[0] == ("/m/gpt2/BoolQ/bootstrapped_4/2022_05_09-01_00_00_AM/", None)
    assert out[1] == ("/m/gpt2/BoolQ/bootstrapped_12/2022_05_10-01_35_25_AM/", None)
    assert out[2][0] is None and "*" in out[2][1]
    assert out[3][1].startswith("no run-stamp suffix")


def test_variance_paths_examples(spark):
    rows = spark.createDataFrame([(1, "/s/*/m", "/d")], "row_id long, single_path string, double_path string")
    out = {(r["case"], r["i"], r["j"]): r["path"] for r in X.variance_paths(rows).collect()}
    assert out[("Single", 7, None)] == "/s/7/m/" and out[("Double", 2, 4)] == "/d/bootstrapped_2_4/"
    assert len(out) == 60


def test_experiment_clean_and_lookup(spark):
    from quiver.plans import derived as D
    raw = spark.createDataFrame([
        ("8.0", "CB", "/m/gpt2/CB/bootstrapped_*/x", "3.0", "0.1", "0", "gpt2", "n", None),
        ("9.0", "CB", None, "3.0", "0.1", "0", "gpt2", "n", "x"),
        ("10.0", "RTE", "/m/b/", "1.0", "0.0", "1", "microsoft/deberta-base", "n", None),
    ], "c1 string, c2 string, c3 string, c4 string, c5 string, c6 string, c7 string, c8 string, c9 string")
    clean = X.experiment_clean(raw, row_col=None).collect()
    assert [r["config"] for r in clean] == [8, 10] and clean[0]["num_models"] == 3
    rows = spark.createDataFrame([("microsoft/deberta-base", "RTE"), ("nobody", "CB")], "model_type string, task string")
    out = {r["model_type"]: r for r in X.lookup_hyperparams(rows, D.hyperparams(spark)).collect()}
    assert out["microsoft/deberta-base"]["learning_rate"] == 2.49e-05 and out["nobody"]["hp_status"] != "ok"


@pytest.fixture(scope="module")
def ensemble_run(spark):
    from conftest import SF01
    from quiver.plans import centroid_ensemble as CE

    emb = spark.read.parquet(f"{SF01}/embeddings.parquet")
    return CE.run(emb), CE.train_test(emb, "vec_id")[1].withColumn("task", F.lit("embeddings"))


def _brute_probs(run, rows):
    """Softmax of minus the squared distance, row by row in plain Python."""
    import math

    out = {}
    models = run.models.collect()
    for r in rows.limit(20).collect():
        for m in models:
            s = {c["class_id"]: -sum((a - b) ** 2 for a, b in zip(r["embedding"], c["mu"])) for c in m["classes"]}
            top = max(s.values())
            z = sum(math.exp(v - top) for v in s.values())
            out.update({(m["replica"], r["vec_id"], c): math.exp(v - top) / z for c, v in s.items()})
    return out


def test_scores_equal_brute_force(ensemble_run):
    run, rows = ensemble_run
    want = _brute_probs(run, rows)
    got = {(r["replica"], r["vec_id"], r["class_id"]): r["prob"] for r in run.scores.collect()}
    assert want and all(abs(got[k] - v) < 1e-9 for k, v in want.items())


@pytest.mark.parametrize("how", [{}, {"vote_by": []}, {"vote_by": [], "predict": True, "label": "label"}])
def test_many_blocks_equal_one(ensemble_run, how):
    """Over the byte budget models are scored in several broadcast blocks: same result in every mode."""
    from quiver.operators import score as SC

    run, rows = ensemble_run
    small = SC.model_blocks(run.models, ["task"], ["replica"], block_bytes=8 * 64 * 10 * 3)
    assert len(small) > 2
    names = [f.name for f in SC.score_centroids(rows, run.models, "vec_id", **how).schema]

    def table(**more):
        out = SC.score_centroids(rows, run.models, "vec_id", **how, **more).select(*names).collect()
        return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in out)

    assert table() == table(blocks=small) and len(table()) > 0


def test_fused_vote_and_prediction_equal_group_by(ensemble_run):
    run, rows = ensemble_run
    by_row = G.soft_vote(run.scores, "vec_id")
    a = {(r["vec_id"], r["class_id"]): r["total"] for r in by_row.collect()}
    b = {(r["vec_id"], r["class_id"]): r["total"] for r in run.totals.collect()}
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-9
    want = sorted((r["vec_id"], r["y_true"], r["y_pred"]) for r in G.align_truth(G.predict(by_row, "vec_id"), rows, "vec_id").collect())
    assert want == sorted((r["vec_id"], r["y_true"], r["y_pred"]) for r in run.aligned.collect())


def test_members_vote_in_several_ensembles(ensemble_run):
    from quiver.operators import score as SC

    run, rows = ensemble_run
    members = F.when(F.col("replica") < 5, F.array(F.struct(F.lit(1).alias("e")), F.struct(F.lit(2).alias("e")))).otherwise(F.array(F.struct(F.lit(2).alias("e"))))
    voted = SC.score_centroids(rows, run.models.withColumn("members", members), "vec_id", vote_by=["e"], members="members")
    got = {(r["e"], r["vec_id"], r["class_id"]): r["total"] for r in voted.collect()}
    want = {}
    for r in run.scores.collect():
        for e in ((1, 2) if r["replica"] < 5 else (2,)):
            key = (e, r["vec_id"], r["class_id"])
            want[key] = want.get(key, 0) + r["prob"]
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in got) < 1e-9


@pytest.mark.parametrize("hot", [0, 30_000, 1 << 20])
def test_many_models_have_a_small_text_plan(spark, hot):
    """60 models of 10 classes: a plan that does not grow with them, and the sums of a plain loop; a text of many rare tokens."""
    import math
    import random

    from quiver.operators import score as SC

    rng = random.Random(3)
    table = {(r, c, f"w{t}"): -rng.random() * 9 for r in range(60) for c in range(10) for t in range(12) if (r + t) % 5}
    loglik = spark.createDataFrame([(*k, v) for k, v in table.items()], "replica int, class_id int, token string, loglik double")
    prior = spark.createDataFrame([(r, c, -1.0 - c / 7) for r in range(60) for c in range(10)], "replica int, class_id int, log_prior double")
    texts = {"a": " ".join(f"w{rng.randrange(14)}" for _ in range(300)), "b": "w1", "c": "", "d": None, "e": "w3 w3 zz"}
    rows = spark.createDataFrame([(k, t, 7, 3) for k, t in texts.items()], "name string, text string, label int, s int").repartition(3)
    packed = SC.pack_naive_bayes(loglik, prior)
    got = {r["name"]: (r["y_true"], r["y_pred"]) for r in SC.score_naive_bayes(rows, packed, "name", label="label", predict=True, hot_bytes=hot).collect()}
    for k, text in texts.items():
        votes = [0.0] * 10
        for r in range(60):
            z = [-1.0 - c / 7 + sum(table.get((r, c, t), 0.0) for t in (text or "").split()) for c in range(10)]
            e = [math.exp(v - max(z)) for v in z]
            votes = [v + x / sum(e) for v, x in zip(votes, e)]
        assert got[k] == (7, max(range(10), key=lambda c: (round(votes[c], 9), -c)))
    plan = SC.score_naive_bayes(rows, packed, "name", hot_bytes=hot)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 6000 and plan.count("regexp_extract_all") <= 1


def test_tokens_keep_accented_words(spark):
    from quiver.operators.learn import tokens

    df = spark.createDataFrame([("Él corrió: ÜBER straße 42x, naïve-été",)], "t string")
    assert df.select(tokens(F.col("t"))).collect()[0][0] == ["él", "corrió", "über", "straße", "42x", "naïve", "été"]


@pytest.mark.parametrize("hot", [0, 150, 100_000])
def test_naive_bayes_scores_do_not_depend_on_the_broadcast(spark, hot):
    from quiver.operators import score as SC

    loglik = spark.createDataFrame([(r, c, t, -float(len(t)) - c * 0.5 - r * 0.1) for r in range(2) for c in range(2) for t in ("aa", "b", "cccc") if (r, t) != (1, "b")],
                                   "replica int, class_id int, token string, loglik double")
    prior = spark.createDataFrame([(r, c, -0.5 - c) for r in range(2) for c in range(2)], "replica int, class_id int, log_prior double")
    rows = spark.createDataFrame([(1, "aa b b"), (2, "unknown"), (3, ""), (4, "cccc aa zz")], "doc_id long, text string")
    got = {(r["replica"], r["doc_id"], r["class_id"]): r["prob"] for r in SC.score_naive_bayes(rows, SC.pack_naive_bayes(loglik, prior), "doc_id", hot_bytes=hot).collect()}
    import math

    table = {(r["replica"], r["class_id"], r["token"]): r["loglik"] for r in loglik.collect()}
    for r in range(2):
        for d, text in ((1, "aa b b"), (2, "unknown"), (3, ""), (4, "cccc aa zz")):
            s = [-0.5 - c + sum(table.get((r, c, t), 0.0) for t in text.split()) for c in range(2)]
            z = sum(math.exp(x) for x in s)
            assert all(abs(got[r, d, c] - math.exp(s[c]) / z) < 1e-9 for c in range(2))


def test_planning_errors_trains_nothing(spark):
    from conftest import SF001
    from quiver.plans import evaluate as EV

    ev = EV.evaluate(None, EV.configs_from_nation(spark.read.parquet(f"{SF001}/nation.parquet")))
    assert ev.errors.count() == 10  # no embeddings were needed


def test_prune_massive_tie_group(spark):
    # a third of all weights share one value and the cut falls inside that tie group, so the chosen
    # rows are decided by (layer, pos) order alone
    rows = [(0, f"l{l}.weight", p, 0.5 if p % 3 == 0 else 1.0 + ((p * 7919 + l) % 1000) / 100.0 if p % 3 == 1
             else 0.001 * (1 + (p + l) % 50))
            for l in range(3) for p in range(10000)]
    w = spark.createDataFrame(rows, "model_id int, layer string, pos int, value double")
    f = spark.createDataFrame([(0, 0.5)], "model_id int, pruning_factor double")
    got = {(r["layer"], r["pos"]) for r in PR.prune_weights(w, f).filter("value = 0").collect()}
    assert got == _ranked(rows, 0.5)


def test_centroids_rowlocal_poisson_equals_join(spark):
    from conftest import SF01
    from quiver.operators import learn as LN
    from quiver.operators import sampling as SA

    emb = spark.read.parquet(f"{SF01}/embeddings.parquet")
    a = LN.train_centroids(emb, SA.bootstrap_poisson(emb, "vec_id", 4), "vec_id")
    b = LN.train_centroids(emb, None, "vec_id", reps=SA.poisson_reps(F.col("vec_id"), 4))
    ra = {(r[0], r[1], r[2]): r[3] for r in a.collect()}
    rb = {(r[0], r[1], r[2]): r[3] for r in b.collect()}
    assert ra.keys() == rb.keys() and max(abs(ra[k] - rb[k]) for k in ra) < 1e-9


def test_scores_are_distributions(spark):
    from conftest import SF001
    from quiver.plans import centroid_ensemble as CE

    run = CE.run(spark.read.parquet(f"{SF001}/embeddings.parquet"))
    sums = run.scores.groupBy("replica", "vec_id").agg(F.sum("prob").alias("s"), F.min("prob").alias("m")).collect()
    assert sums and all(abs(r["s"] - 1.0) < 1e-9 and r["m"] >= 0 for r in sums)


def test_text_scoring_works_on_slices(spark, monkeypatch):
    """Tasks get texts in one batch, and must not hold more than a slice's vectors and a few texts' sums."""
    from quiver.operators import score as SC

    rows = spark.createDataFrame([(i, " ".join(f"t{(i * j) % 37}" for j in range(i % 50))) for i in range(400)] + [(None, "t1 t2 t99"), (3, "t5")], "doc_id long, text string")
    loglik = spark.createDataFrame([(r, c, f"t{t}", -1.0 - (t * (r + 1) + c) % 7) for r in range(3) for c in range(2) for t in range(37)], "replica int, class_id int, token string, loglik double")
    prior = spark.createDataFrame([(r, c, -0.7) for r in range(3) for c in range(2)], "replica int, class_id int, log_prior double")
    packed = SC.pack_naive_bayes(loglik, prior)

    def probs(hot):
        return sorted((str(r["doc_id"]), r["replica"], r["class_id"], round(r["prob"], 9)) for r in SC.score_naive_bayes(rows, packed, "doc_id", hot_bytes=hot).collect())

    expected = {hot: probs(hot) for hot in (1000, 1 << 20)}
    monkeypatch.setattr(SC, "SLICE_VALUES", 64)
    monkeypatch.setattr(SC, "HELD_VALUES", 60)
    assert {hot: probs(hot) for hot in expected} == expected
    assert expected[1000][0] == expected[1 << 20][0]
