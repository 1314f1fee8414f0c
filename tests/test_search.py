from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF001


def _norm(v):
    return f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def scored(spark):
    return E.queries()["trial_objectives_grids"](spark, SF001).collect()


def test_every_grid_is_scored(scored):
    cells = Counter((r["family"], r["epochs"], r["batch"]) for r in scored if r["task"] == "parity")
    assert cells == {**{("roberta", e, b): 5 for e in (3, 5) for b in (16, 32)}, **{("distilroberta", e, b): 5 for e in (9, 11) for b in (16, 32)},
                     ("gpt2", 2, 16): 3, ("gpt2", 2, 32): 3, ("deberta", 5, 16): 3}
    assert len(scored) == 2 * sum(cells.values())
    assert {r["weight_decay"] for r in scored if r["family"] == "deberta"} == {0.01}
    assert {(r["task"], r["metric"]) for r in scored if r["family"] == "deberta"} == {("embeddings", "accuracy"), ("parity", "accuracy")}


def test_rate_and_batch_matter(scored):
    """Trials that differ in the learning rate alone, or in the batch size, end at other losses."""
    own = {(r["task"], r["trial_id"]): r for r in scored if r["family"] == "deberta"}
    for task in ("embeddings", "parity"):
        assert len({own[task, f"e-5-b-16-t-{t}"]["loss"] for t in range(3)}) == 3
    assert "no_effect" not in scored[0].asDict()
    cells = {(r["batch"], r["trial_id"]): r["loss"] for r in scored if r["family"] == "gpt2" and r["task"] == "parity"}
    assert len(set(cells.values())) == 6


def test_the_roberta_grid_is_that_of_trial_objectives(spark, scored):
    alone = E.queries()["trial_objectives"](spark, SF001).collect()
    row = lambda r: tuple(_norm(r[c]) for c in alone[0].asDict())
    assert sorted(map(row, alone)) == sorted(row(r) for r in scored if r["family"] == "roberta")


@pytest.mark.parametrize("name", ["trial_objectives_grids", "best_trial_grids"])
def test_grids_equal_their_sql(spark, scored, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF001}/embeddings.parquet'")
    cur = con.execute(E.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    rows = scored if name == "trial_objectives_grids" else E.queries()[name](spark, SF001).collect()
    assert rows[0].asDict().keys() == set(cols)
    assert sorted(tuple(_norm(r[c]) for c in cols) for r in rows) == sorted(tuple(map(_norm, r)) for r in cur.fetchall())
