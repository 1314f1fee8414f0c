"""Embedding near-duplicates: Euclidean p-stable hashing, then exact cosines.

A vector is brought to length 1, where a cosine of c is a distance of sqrt(2 - 2c). Every table hashes it by ``k``
projections on Gaussian directions, shifted at random and cut into steps of ``WIDTH``; vectors with the same steps
share a bucket. For a distance d the chance to share one step is known in closed form (``collision``), which gives
the number of projections (at most ``MATES`` unrelated vectors a bucket, so it grows with the logarithm of the
number of vectors) and of tables (a pair exactly at the threshold shares a bucket with probability ``RECALL``; closer pairs
more often). All pairs of a bucket are compared by their cosine in double precision.

In Spark: equal vectors are one class with a count, pre-aggregated. Bucket sizes are counted on ids alone, and
buckets of one class are dropped. Buckets of over ``BLOCK`` classes are cut into blocks, and each pair of blocks is a
group of its own, so a task holds at most two blocks; no pair leaves a task: a group gives link counts and the
star edges of its own components. A pair that meets in several tables counts in the first of them.
The rows copied for a bucket of m classes are m * m / BLOCK, the price of counting every link of a dense group.

Defined cases: null, empty and all-zero vectors and those with null or non-finite components link with nothing;
neither do vectors of different lengths. Rows with equal vectors are linked, also with the same vec_id, and each
counts as another vector. A row with a null vec_id links with nothing, has a null component and is kept. Vectors of
any length are hashed whole. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quiver.llm import textops as T
from quiver.llm.graph import components, local_components
from quiver.session import materialize, ship_package

WIDTH = 2.0
MATES = 64
RECALL = 0.96
BLOCK = 2048
LARGE = 1000  # a component of over 1 / LARGE of the vectors is joined by broadcast, not by its key
_STRIPE = 512


def collision(distance: float, width: float = WIDTH) -> float:
    """Chance that two points at this distance share a step of one projection (Datar et al., 2004)."""
    if distance <= 0:
        return 1.0
    r = width / distance
    tail = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, threshold: float, mates: int = MATES, recall: float = RECALL) -> tuple[int, int]:
    """(projections a table, tables) for n vectors; unrelated vectors are at right angles."""
    near, far = collision(math.sqrt(max(0.0, 2 - 2 * threshold))), collision(math.sqrt(2))
    k = max(1, math.ceil(math.log(max(n / mates, 1)) / -math.log(far)))
    miss = 1 - near**k
    return k, 1 if miss <= 0 else max(1, math.ceil(math.log(1 - recall) / math.log(miss)))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Tables:
    """Hashes of all tables for vectors of one length."""

    def __init__(self, dims: int, k: int, tables: int, seed: int) -> None:
        rng = np.random.default_rng([seed, dims])
        self.dims, self.k, self.tables = dims, k, tables
        self.directions = rng.standard_normal((dims, k * tables))
        self.shifts = rng.uniform(0, WIDTH, k * tables)

    def signatures(self, x: np.ndarray) -> np.ndarray:
        """(vectors x tables) 64-bit bucket names."""
        steps = np.floor((unit(x) @ self.directions + self.shifts) / WIDTH).astype(np.int64).astype(np.uint64)
        steps = steps.reshape(len(x), self.tables, self.k)
        with np.errstate(over="ignore"):
            h = T.mix64(np.arange(1, self.tables + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(self.dims))[None, :].repeat(len(x), 0)
            for j in range(self.k):
                h = T.mix64(h * np.uint64(0x9FB21C651E98DF25) + steps[:, :, j])
        return h.view(np.int64)


def classes(vectors: DataFrame, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(node, rep, copies, vec): one row for each distinct usable vector; ``rep`` is its smallest id."""
    usable = F.col(vec).isNotNull() & F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vec, lambda v: v != 0)
    rows = vectors.where(F.col(key).isNotNull() & usable).select(F.col(key).cast("long").alias("id"), F.col(vec).alias("vec"))
    distinct = rows.groupBy("vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    return materialize(distinct.select(F.monotonically_increasing_id().alias("node"), "rep", "copies", "vec"))


def signed(found: DataFrame, k: int, tables: int, seed: int) -> DataFrame:
    """``found`` with its bucket names ``sig``."""
    def run(batches):
        made: dict[int, Tables] = {}
        for batch in batches:
            vec = batch.column(2)
            sizes = vec.value_lengths().to_numpy()
            flat = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.cumsum(sizes) - sizes
            out = np.zeros((len(batch), tables), np.int64)
            for d in np.unique(sizes):
                own = np.flatnonzero(sizes == d)
                table = made.setdefault(int(d), Tables(int(d), k, tables, seed))
                for a in range(0, len(own), 2048):
                    part = own[a : a + 2048]
                    out[part] = table.signatures(flat[starts[part][:, None] + np.arange(d)])
            sig = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * tables, pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, sig], ["node", "copies", "vec", "sig"])

    return materialize(found.select("node", "copies", "vec").mapInArrow(run, f"{_ddl(found)}, sig array<long>"))


def _ddl(found: DataFrame) -> str:
    return f"node long, copies long, vec {found.schema['vec'].dataType.simpleString()}"


def linked(table: int, both: bool, first: np.ndarray, second: np.ndarray, node, copies, sig, x, threshold: float):
    """(node, root, links) of the links of one group: rows ``first`` against rows ``second`` (``both``: the same rows)."""
    u = unit(x)
    links = np.zeros(len(node), np.int64)
    stars = []
    for a in range(0, len(first), _STRIPE):
        rows = first[a : a + _STRIPE]
        near = u[rows] @ u[second].T >= threshold
        if both:
            near &= np.arange(len(second))[None, :] > (a + np.arange(len(rows)))[:, None]
        if not near.any():
            continue
        for t in range(table):  # pairs that share an earlier bucket were counted there
            near &= sig[rows, t][:, None] != sig[second, t][None, :]
        i, j = np.nonzero(near)
        if i.size:
            np.add.at(links, rows, near @ copies[second])
            np.add.at(links, second, copies[rows] @ near)
            stars.append(local_components(node[rows[i]], node[second[j]]))
    if not stars:
        return None
    nodes, low = local_components(np.concatenate([s[0] for s in stars]), np.concatenate([s[1] for s in stars]))
    order = np.argsort(node)
    place = order[np.searchsorted(node, nodes, sorter=order)]
    return nodes, low, links[place]


def _compare(threshold: float):
    def groups(batches):
        """Whole groups, across batches: (key, rows as arrays)."""
        key, held = None, []
        for batch in batches:
            if not len(batch):
                continue
            names = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
            cuts = np.concatenate(([0], np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1, [len(batch)]))
            for a, b in zip(cuts, cuts[1:]):
                own = tuple(names[a])
                if own != key and held:
                    yield key, held
                    held = []
                key = own
                held.append(batch.slice(a, b - a))
        if held:
            yield key, held

    def run(batches):
        for (dims, _, lo, hi), parts in groups(batches):
            group = pa.Table.from_batches(parts).combine_chunks()
            own, node, copies = (group.column(n).to_numpy() for n in ("own", "node", "copies"))
            flat = lambda n: group.column(n).combine_chunks().flatten().to_numpy(zero_copy_only=False)
            x = flat("vec").astype(np.float64).reshape(len(node), int(dims))
            sig = flat("sig").reshape(len(node), -1)
            first, second = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
            found = linked(int(group.column("t")[0].as_py()), lo == hi, first, second, node, copies, sig, x, threshold)
            if found is not None:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["node", "root", "links"])

    return run


def links(found: DataFrame, threshold: float = 0.95, seed: int = 11, mates: int = MATES, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(node, root, links): what every group found for its classes; ``root`` is the smallest node they reach inside it."""
    k, tables = plan(found.count(), threshold, mates, recall)
    with_names = signed(found, k, tables, seed)
    places = with_names.select("node", F.size("vec").alias("dims"), F.posexplode("sig").alias("t", "h"))
    sizes = places.groupBy("h").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / block).cast("int")
    shared = places.join(sizes, "h").select("node", "dims", "t", "h", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    placed = shared.select("node", "dims", "h", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "t", "own")
    rows = placed.join(with_names, "node").select("dims", "h", "lo", "hi", "t", "own", "copies", "node", "sig", "vec")
    dealt = rows.repartition("dims", "h", "lo", "hi").sortWithinPartitions("dims", "h", "lo", "hi")
    return materialize(dealt.mapInArrow(_compare(threshold), "node long, root long, links long"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, vec: str = "embedding", key: str = "vec_id", **how) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for every row of ``vectors``."""
    ship_package(vectors.sparkSession)
    found = classes(vectors, vec, key)
    total = found.count()
    per_group = links(found, threshold, **how)
    counts = per_group.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(per_group.where("node <> root"), "root", "node")
    named = joined.join(found.select("node", "rep"), "node")
    lowest = materialize(named.groupBy("component").agg(F.min("rep").alias("low"), F.count(F.lit(1)).alias("size")))
    large = F.broadcast(lowest.where(F.col("size") * LARGE > total).select("component", "low"))  # fewer than LARGE components
    low = named.join(large, "component").unionByName(named.join(large, "component", "left_anti").join(lowest.drop("size"), "component")).select("node", "low")
    results = found.join(counts, "node", "left").join(low, "node", "left").select(
        "vec", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("low", "rep").alias("component_id"))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vec).alias("_vec"))
    mine = (F.col("_vec") == F.col("vec")) & F.col("vec_id").isNotNull()
    out = rows.join(results, mine, "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op11_pstable_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


# All pairs by brute force; what a table misses shows as a difference.
SQL = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT e.vec_id, (SELECT count(*) FROM link l WHERE l.a = e.vec_id) AS n_links,
  coalesce((SELECT least(e.vec_id, min(r.b)) FROM reach r WHERE r.a = e.vec_id), e.vec_id) AS component_id,
  coalesce((SELECT min(r.b) FROM reach r WHERE r.a = e.vec_id), e.vec_id) >= e.vec_id AS kept FROM embeddings e"""
