import math

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF001

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
FAST = ["holdout_split", "dense_position", "bootstrap_exact", "bootstrap_poisson", "double_bootstrap",
        "experiment_clean", "expand_config", "attach_factor", "lookup_hyperparams", "flatten_nested_qa",
        "pair_text", "label_encode", "task_of_path", "prune_weights", "classification_report", "eval_metrics"]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}"
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF001}/{t}.parquet'")
    return c


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and 0.0 <= rows[0]["accuracy"] <= 1.0
    assert df.columns == E.entry(spark).columns


def test_every_query_registered_with_oracle_names():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 45


@pytest.mark.parametrize("name", FAST)
def test_oracle_parity_sf0001(spark, con, name):
    sdf = E.queries()[name](spark, SF001)
    cur = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(sdf.columns) == sorted(dcols)
    srows, drows = sdf.collect(), cur.fetchall()
    cols = sorted(dcols)
    a = sorted(tuple(_norm(r[c]) for c in cols) for r in srows)
    b = sorted(tuple(_norm(r[dcols.index(c)]) for c in cols) for r in drows)
    assert a == b
