from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from quiver.operators import metrics as M


def _conf(spark, yt, yp):
    df = spark.createDataFrame(list(zip(yt, yp)), "y_true int, y_pred int")
    return M.confusion(df)


def _brute(yt, yp):
    labels = sorted(set(yt) | set(yp))
    per = {}
    for c in labels:
        tp = sum(1 for a, b in zip(yt, yp) if a == b == c)
        sup = sum(1 for a in yt if a == c)
        pc = sum(1 for b in yp if b == c)
        p = tp / pc if pc else 0.0
        r = tp / sup if sup else 0.0
        f = 2 * tp / (sup + pc) if sup + pc else 0.0
        per[c] = (p, r, f, sup)
    n = len(yt)
    return {
        "accuracy": sum(1 for a, b in zip(yt, yp) if a == b) / n,
        "macro_f1": sum(v[2] for v in per.values()) / len(per),
        "weighted_f1": sum(v[2] * v[3] for v in per.values()) / n,
        "macro_precision": sum(v[0] for v in per.values()) / len(per),
    }


def test_report_golden_vectors(spark):
    rep = M.classification_report(_conf(spark, [0, 0, 1, 1, 2, 2, 2], [0, 1, 1, 1, 2, 0, 2])).collect()[0]
    assert round(rep["accuracy"], 6) == 0.714286 and round(rep["macro_f1"], 6) == 0.7
    assert round(rep["weighted_f1"], 6) == 0.714286
    per = {r["label"]: r for r in M.per_class_report(_conf(spark, [0, 0, 1], [0, 2, 1])).collect()}
    assert per[2]["precision"] == 0.0 and per[2]["support"] == 0
    rep2 = M.classification_report(_conf(spark, [0, 0, 1], [0, 2, 1])).collect()[0]
    assert round(rep2["macro_f1"], 6) == 0.555556 and round(rep2["weighted_f1"], 6) == 0.777778


def test_constant_predictor_goldens(spark):
    # CB test half: 17 contradiction (2), 8 entailment (1), 3 neutral (0); all predicted contradiction
    yt = [2] * 17 + [1] * 8 + [0] * 3
    rep = M.classification_report(_conf(spark, yt, [2] * 28)).collect()[0]
    assert (round(rep["accuracy"], 6), round(rep["macro_f1"], 6)) == (0.607143, 0.251852)
    rep = M.classification_report(_conf(spark, yt, [0] * 28)).collect()[0]
    assert (round(rep["accuracy"], 6), round(rep["macro_f1"], 6)) == (0.107143, 0.064516)
    # BoolQ: 1000 of 1635 true
    rep = M.classification_report(_conf(spark, [1] * 1000 + [0] * 635, [1] * 1635)).collect()[0]
    assert (round(rep["accuracy"], 6), round(rep["macro_f1"], 6)) == (0.611621, 0.379507)


def test_indicator_metrics_golden(spark):
    r = M.indicator_metrics(_conf(spark, [1, 0, 1, 1], [1, 1, 0, 1])).collect()[0]
    assert [round(r[c], 6) for c in ("precision", "recall", "f1")] == [0.666667] * 3
    r = M.indicator_metrics(_conf(spark, [2, 1, 0], [1, 1, 2])).collect()[0]
    assert (r["precision"], r["recall"], round(r["f1"], 6)) == (1.5, 1.0, 1.2)
    r = M.indicator_metrics(_conf(spark, [1, 0], [0, 0])).collect()[0]
    assert r["precision"] is None and r["f1"] is None


def test_eval_metrics_binary_and_macro(spark):
    r = M.eval_metrics(_conf(spark, [1, 0, 1, 1], [1, 1, 0, 1]), 2).collect()[0]
    assert round(r["precision"], 6) == 0.666667 and round(r["recall"], 6) == 0.666667
    r = M.eval_metrics(_conf(spark, [0, 0, 1, 1, 2, 2, 2], [0, 1, 1, 1, 2, 0, 2]), 3).collect()[0]
    assert round(r["f1"], 6) == 0.7


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), min_size=1, max_size=40))
def test_report_matches_brute_force(spark, pairs):
    yt, yp = [a for a, _ in pairs], [b for _, b in pairs]
    rep = M.classification_report(_conf(spark, yt, yp)).collect()[0]
    want = _brute(yt, yp)
    for k, v in want.items():
        assert abs(rep[k] - v) < 1e-9, k
    assert rep["support"] == len(yt)
    assert Counter(yt)
