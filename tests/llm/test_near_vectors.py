"""Embedding near-duplicates against all pairs by brute force."""

import math

import numpy as np
import pytest

from quiver.llm import near_vectors as V
from quiver.llm.registry import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, node long, sig string, rep int"


def brute(rows, threshold=0.95):
    """{row number: (links, component)} and the links, of (vec_id, vector) rows."""
    usable = [i for i, (v, x) in enumerate(rows) if v is not None and x is not None and len(x) and all(e is not None and math.isfinite(e) for e in x) and any(x)]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    links = [0] * len(rows)
    unit = {i: V.unit(np.array([rows[i][1]], np.float32).astype(np.float64))[0] for i in usable}
    for p, i in enumerate(usable):
        for j in usable[p + 1 :]:
            if len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                top[find(j)] = find(i)
    low = {}
    for i in range(len(rows)):
        if rows[i][0] is not None:
            low[find(i)] = min(low.get(find(i), rows[i][0]), rows[i][0])
    return [(rows[i][0], links[i], low.get(find(i)), rows[i][0] == low.get(find(i))) for i in range(len(rows))]


def around(rng, centre, cosine, dims):
    """A vector at about this cosine to the centre."""
    noise = rng.standard_normal(dims)
    noise -= (noise @ centre) * centre
    noise /= np.linalg.norm(noise)
    return cosine * centre + math.sqrt(1 - cosine**2) * noise


def frame(spark, rows):
    return spark.createDataFrame([(i, None if x is None else [None if e is None else float(e) for e in x], 0, 7, "s", 1) for i, x in rows], SCHEMA).repartition(4)


def test_collision_is_the_measured_share():
    rng = np.random.default_rng(1)
    a = rng.standard_normal(400_000)
    shift = rng.uniform(0, V.WIDTH, a.size)
    for distance in (0.3162, 0.7, math.sqrt(2)):
        same = np.floor(shift / V.WIDTH) == np.floor((a * distance + shift) / V.WIDTH)
        assert abs(same.mean() - V.collision(distance)) < 0.004
    assert V.plan(1, 0.95) == (1, 2) and V.plan(50_000, 0.95)[0] < V.plan(10**9, 0.95)[0]
    assert V.plan(10**6, 1.0)[1] == 1


def test_recall_and_exact_links(spark):
    """1,500 strangers and groups about the threshold: no link that is none, recall at least 0.9."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(64)) for i in range(1500)]
    for g in range(60):
        centre = rng.standard_normal(64)
        centre /= np.linalg.norm(centre)
        rows += [(10_000 + 100 * g + k, around(rng, centre, rng.uniform(0.955, 0.99), 64)) for k in range(12)]
    want = {r[0]: r for r in brute(rows)}
    got = {r["vec_id"]: r for r in V.near_duplicates(frame(spark, rows)).collect()}
    assert set(got) == set(want)
    assert all(got[i]["n_links"] <= w[1] for i, w in want.items())
    total = sum(w[1] for w in want.values())
    assert total > 2000 and sum(got[i]["n_links"] for i in want) / total >= 0.9


def test_one_table_for_all_equals_brute_force(spark):
    """With all vectors in one bucket the result is exact, in whole buckets and in blocks."""
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(16)
    centre /= np.linalg.norm(centre)
    rows = [(i, around(rng, centre, rng.uniform(0.9, 0.999), 16)) for i in range(150)] + [(500 + i, rng.standard_normal(16)) for i in range(50)]
    want = sorted(brute(rows))
    for block in (2048, 16):
        got = V.near_duplicates(frame(spark, rows), mates=10**6, recall=1 - 1e-9, block=block).collect()
        assert sorted(map(tuple, got)) == want


def test_edge_cases(spark, tmp_path):
    """Nulls, zero and non-finite vectors, other lengths, scaled and equal vectors, repeated ids, huge and tiny values."""
    x = [0.5, -1.0, 2.0, 0.0]
    rows = [(5, x), (3, x), (3, x), (9, [2 * e for e in x]), (1, None), (2, []), (4, [0.0, 0.0, -0.0, 0.0]), (6, [1.0, None, 0.0, 0.0]), (7, [float("nan"), 1.0, 0.0, 0.0]),
            (8, [float("inf"), 0.0, 0.0, 0.0]), (None, x), (10, [0.5, -1.0, 2.0]), (11, [1e38, 1e38, 0.0, 1e38]), (12, [1e-38, 1e-38, 0.0, 1e-38]), (13, [0.5, -1.0, 2.0, -0.0]),
            (14, [1.0] * 5000), (15, [1.0] * 4999 + [1.5]), (16, [-e for e in x])]
    frame(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = QUERIES["op11_pstable_vectors"](spark, str(tmp_path))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    want = [(i, n, c, True if i is None else k) for i, n, c, k in brute(rows)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_a_chain_is_one_component(spark):
    steps = [math.radians(15 * k) for k in range(40)]
    rows = [(100 - k, [math.cos(s) * math.exp(0.01 * k), math.sin(s) * math.exp(0.01 * k), 0.0]) for k, s in enumerate(steps) if k < 20]
    got = V.near_duplicates(frame(spark, rows), recall=1 - 1e-9).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(None, None)]])
def test_small_tables(spark, rows):
    got = V.near_duplicates(frame(spark, rows)).collect()
    assert [tuple(r) for r in got] == [(i, 0, i, True) for i, _ in rows]
