"""Reproducible splits and resampling kept as multiplicities (M1-M7).

Every draw comes from the seeded hash ``h`` so results do not depend on partitioning.
Exact ranks never use a single-partition window over the data: rows are bucketed on
the top bits of their hash, a histogram of at most ``2**bits`` buckets gives each
bucket's offset (a bounded table, broadcast), and rows are ranked only inside a
bucket. Resamples are ``(replica, key, mult)`` rows; drawn rows are never duplicated.
"""

from __future__ import annotations

from decimal import Decimal, getcontext
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiver.functions.hashing import HASH_BITS, bucket, h

DEFAULT_BUCKET_BITS = 16  # 65,536 buckets: histogram <= 1 MiB, so it is always safe to broadcast


def _seeds(replicas: int | Sequence[int]) -> Column:
    if isinstance(replicas, int):
        return F.sequence(F.lit(0), F.lit(replicas - 1))
    return F.array(*[F.lit(int(s)) for s in replicas])


def _histogram(keyed: DataFrame, bits: int) -> DataFrame:
    """Per-bucket count, rows before the bucket and total rows (<= 2**bits rows)."""
    hist = keyed.groupBy("_b").agg(F.count(F.lit(1)).alias("_cnt"))
    # The histogram is bounded by 2**bits rows, so an unpartitioned window over it is cheap.
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return hist.select(
        "_b",
        "_cnt",
        F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_before"),
        F.sum("_cnt").over(Window.partitionBy()).alias("_n"),
    )


def _keyed(df: DataFrame, key: str, seed, bits: int) -> DataFrame:
    return df.withColumn("_h", h(seed, F.col(key))).withColumn("_b", bucket(F.col("_h"), bits))


def dense_position(df: DataFrame, key: str, seed="pos", bits: int = DEFAULT_BUCKET_BITS,
                   pos_col: str = "pos", n_col: str | None = None) -> DataFrame:
    """M6: exact 0..n-1 position of each row, ordered by (h(seed, key), key).

    ``key`` must be unique. Adds ``pos_col`` (and the row count as ``n_col``).
    """
    keyed = _keyed(df, key, seed, bits)
    offsets = F.broadcast(_histogram(keyed, bits).select("_b", "_before", "_n"))
    within = Window.partitionBy("_b").orderBy("_h", key)
    out = keyed.join(offsets, "_b").withColumn(
        pos_col, (F.col("_before") + F.row_number().over(within) - 1).cast("bigint"))
    out = out.drop("_h", "_b", "_before")
    return out.withColumnRenamed("_n", n_col) if n_col else out.drop("_n")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their counts (an aggregate with a map-side partial,
    so even a key holding a large share of the rows costs one row per task in the shuffle).

    Every sampler here assumes a unique key: copies of a key share one hash, so they would
    tie in every order. Check with ``duplicate_keys(df, key).isEmpty()`` before sampling a
    table that is not keyed (e.g. line items)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def _cut(df: DataFrame, key: str, frac: float, seed, bits: int) -> DataFrame:
    """One row (_ch, _ck): the (h, key) of the last 'test' row, found from a histogram of the hash
    and the one bucket that holds it. No row if the test part is empty."""
    keyed = _keyed(df.select(key), key, seed, bits)
    hist = _histogram(keyed, bits).withColumn("_k", F.ceil(F.col("_n") * F.lit(frac)).cast("bigint"))
    edge = hist.filter((F.col("_before") < F.col("_k")) & (F.col("_before") + F.col("_cnt") >= F.col("_k"))).select("_b", (F.col("_k") - F.col("_before")).alias("_left"))
    within = Window.partitionBy("_b").orderBy("_h", key)  # about n / 2**bits rows
    ranked = keyed.join(F.broadcast(edge), "_b").withColumn("_rank", F.row_number().over(within))
    return ranked.filter(F.col("_rank") == F.col("_left")).select(F.col("_h").alias("_ch"), F.col(key).alias("_ck"))


def _assign(df: DataFrame, key: str, cut: DataFrame, seed, split_col: str) -> DataFrame:
    """Tag rows by one comparison with the cut (a single broadcast row); no shuffle, one scan."""
    tagged = df.withColumn("_h", h(seed, F.col(key))).withColumn("_one", F.shiftright("_h", HASH_BITS))  # always 0: an equi-join key
    tagged = tagged.join(F.broadcast(cut.withColumn("_one", F.shiftright("_ch", HASH_BITS))), "_one", "left")
    first = (F.col("_h") < F.col("_ch")) | ((F.col("_h") == F.col("_ch")) & (F.col(key) <= F.col("_ck")))
    return tagged.withColumn(split_col, F.when(F.coalesce(first, F.lit(False)), F.lit("test")).otherwise(F.lit("val"))).drop("_h", "_ch", "_ck", "_one")


def holdout_split(df: DataFrame, key: str, frac: float = 0.5, seed=42,
                  bits: int = DEFAULT_BUCKET_BITS, split_col: str = "split") -> DataFrame:
    """M1: the ceil(frac * n) rows first in (h(seed, key), key) order are 'test', the rest 'val'.

    The cut is found on the key column alone (histogram, then the one bucket that straddles it);
    the rows are then tagged by comparing with it.
    """
    return _assign(df, key, _cut(df, key, frac, seed, bits), seed, split_col)


def fit_split(df: DataFrame, key: str, frac: float = 0.5, seed=42, bits: int = DEFAULT_BUCKET_BITS) -> DataFrame:
    """M1 fitted once: the cut, one row written to reliable storage. Applying it (:func:`apply_split`)
    is a row-local comparison, so every later reference to the train or test half only re-reads rows."""
    from quiver.session import materialize

    return materialize(_cut(df, key, frac, seed, bits))


def apply_split(df: DataFrame, key: str, cut: DataFrame, seed=42, split_col: str = "split") -> DataFrame:
    return _assign(df, key, cut, seed, split_col)


def _draws(spark, seeds: Sequence[int], n: int, name: str) -> DataFrame:
    """(name, d) for every seed and every draw index d in 0..n-1, generated in parallel by
    ``spark.range`` (no table scan, no shuffle)."""
    seed_arr = F.array(*[F.lit(int(x)) for x in seeds])
    return spark.range(len(seeds) * n).select(
        F.element_at(seed_arr, F.expr(f"cast(id div {int(n)} as int)") + 1).alias(name),
        F.pmod(F.col("id"), F.lit(n)).alias("_d"))


def _seed_list(replicas: int | Sequence[int]) -> list[int]:
    return list(range(replicas)) if isinstance(replicas, int) else [int(x) for x in replicas]


def bootstrap_exact(df: DataFrame, key: str, replicas: int | Sequence[int] = 10, seed_offset: int = 0,
                    bits: int = DEFAULT_BUCKET_BITS) -> DataFrame:
    """M2: per replica r exactly n draws with replacement; draw d picks position h(r, d) mod n.

    Returns ``(replica, key, mult)``. Draws come from a parallel range of B x n indices (one
    scalar ``count`` gives n), are pre-aggregated to ``(replica, position, mult)`` and joined
    once to the position table, which is computed once.
    """
    keys_only = df.select(key)
    n = keys_only.count()
    if n == 0:
        return df.sparkSession.createDataFrame([], f"replica int, {key} {df.schema[key].dataType.simpleString()}, mult int")
    pos = dense_position(keys_only, key, bits=bits)
    seed = F.col("replica") + F.lit(seed_offset)
    draws = (_draws(df.sparkSession, _seed_list(replicas), n, "replica")
             .select("replica", F.pmod(h(seed, F.col("_d")), F.lit(n)).alias("_target"))
             .groupBy("replica", "_target")
             .agg(F.count(F.lit(1)).cast("int").alias("mult")))
    keys = pos.select(F.col(key), F.col("pos").alias("_target"))
    return draws.join(keys, "_target").select("replica", key, "mult")


def _poisson_thresholds(k_max: int = 20) -> list[int]:
    """T_k = floor(P(Poisson(1) <= k) * 2^60); a draw is #{k : h >= T_k}."""
    getcontext().prec = 60
    e_inv = Decimal(1) / Decimal(1).exp()
    out, term, cdf = [], e_inv, Decimal(0)
    for k in range(k_max):
        cdf += term
        out.append(int(cdf * (1 << 60)))
        term = term / (k + 1)
    return [t for t in out if t < (1 << 60)]


POISSON_THRESHOLDS = _poisson_thresholds()


def poisson_mult(hash_col: Column) -> Column:
    """Inverse-CDF Poisson(1) multiplicity from a 60-bit uniform hash (integer compares only)."""
    expr = F.lit(0)
    for t in POISSON_THRESHOLDS:
        expr = expr + (hash_col >= F.lit(t)).cast("int")
    return expr


def bootstrap_poisson(df: DataFrame, key: str, replicas: int | Sequence[int] = 10,
                      seed_prefix: str = "poisson") -> DataFrame:
    """M3: independent Poisson(1) multiplicity per (row, replica); map-only, no shuffle.

    The hash is produced by a (one-element) explode so it is computed once per pair; a
    plain projection would be inlined into each of the threshold tests by the optimizer.
    """
    seed = F.concat(F.lit(seed_prefix), F.col("replica").cast("string"))
    return (
        df.select(F.col(key), F.explode(_seeds(replicas)).alias("replica"))
        .select("replica", key, F.explode(F.array(h(seed, F.col(key)))).alias("_h"))
        .select("replica", key, poisson_mult(F.col("_h")).alias("mult"))
        .filter(F.col("mult") > 0)
    )


def poisson_reps(key: Column, replicas: int, seed_prefix: str = "poisson") -> Column:
    """M3 as a row-local column: ``array<struct<replica, mult>>`` of the row's non-zero Poisson
    multiplicities (same draws as :func:`bootstrap_poisson`). Lets a learner weight rows
    without joining a sample table, so wide rows (whole texts) are never shuffled for it."""
    seeds = F.sequence(F.lit(0), F.lit(replicas - 1))
    hashes = F.transform(seeds, lambda r: h(F.concat(F.lit(seed_prefix), r.cast("string")), key))
    reps = F.transform(hashes, lambda x, i: F.struct(i.alias("replica"), poisson_mult(x).alias("mult")))
    return F.filter(reps, lambda e: e["mult"] > 0)


def double_bootstrap(df: DataFrame, key: str, outer: int = 10, inner: int = 5, inner_seed_base: int = 100,
                     bits: int = DEFAULT_BUCKET_BITS) -> DataFrame:
    """M4: resample each outer sample i (seed i) again, full size, with inner seed base+j.

    The inner draws do not depend on i (as in the reference), so they are computed
    once, pre-aggregated per (j, outer draw index), and joined to every outer sample.
    Returns ``(i, j, key, mult)``.
    """
    keys_only = df.select(key)
    n = keys_only.count()
    spark = df.sparkSession
    if n == 0:
        return spark.createDataFrame([], f"i int, j int, {key} {df.schema[key].dataType.simpleString()}, mult int")
    keys = dense_position(keys_only, key, bits=bits).select(F.col(key), F.col("pos").alias("_target"))
    outer_draws = (
        _draws(spark, list(range(outer)), n, "i")
        .select("i", "_d", F.pmod(h(F.col("i"), F.col("_d")), F.lit(n)).alias("_target"))
        .join(keys, "_target")
        .select("i", "_d", key)
    )
    inner_draws = (
        _draws(spark, list(range(inner)), n, "j")
        .select("j", F.pmod(h(F.col("j") + F.lit(inner_seed_base), F.col("_d")), F.lit(n)).alias("_d"))
        .groupBy("j", "_d")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    return (
        outer_draws.join(inner_draws, "_d")
        .groupBy("i", "j", key)
        .agg(F.sum("_c").cast("int").alias("mult"))
    )


def no_resample(df: DataFrame, key: str) -> DataFrame:
    """M7: the baseline sample, every row once."""
    return df.select(F.lit(0).alias("replica"), F.col(key), F.lit(1).alias("mult"))


def baseline_and_bootstrap(df: DataFrame, key: str, replicas: int | Sequence[int] = 10) -> DataFrame:
    """M7 with M2 under a ``model_type`` column: one training table for both kinds of model."""
    base = no_resample(df, key).withColumn("model_type", F.lit("baseline"))
    boot = bootstrap_exact(df, key, replicas).withColumn("model_type", F.lit("bootstrap"))
    return base.unionByName(boot).select("model_type", "replica", key, "mult")


def choose_models(df: DataFrame, k_col: str, row_key: Column, seed: str = "models",
                  out_col: str = "model_no") -> DataFrame:
    """M5: k distinct model numbers from 0..max(10, k)-1 per row, seeded by the row key.

    Row-local: candidates are ranked inside an array, so there is no shuffle.
    """
    k = F.col(k_col).cast("int")
    pool = F.greatest(F.lit(10), k)
    cand = F.transform(
        F.sequence(F.lit(0), pool - 1),
        lambda i: F.struct(h(F.lit(seed), F.concat(row_key.cast("string"), F.lit(":"), i.cast("string"))).alias("h"),
                           i.alias("id")),
    )
    # from 10 models on the pool is exactly the choice, and nothing needs a hash
    some = F.transform(F.slice(F.array_sort(cand), 1, k), lambda c: c["id"])
    chosen = F.when(k >= 10, F.sequence(F.lit(0), k - 1)).otherwise(some)
    return df.withColumn(out_col, F.explode(chosen))
