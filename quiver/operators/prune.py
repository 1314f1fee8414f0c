"""Global magnitude pruning (T5) and parameter counts (T6) over long weight tables.

A weight table is ``(model..., layer, pos, value)``. Per model, the k = round-half-even(
factor x number of ``.weight`` parameters) smallest |value| over all ``.weight`` layers
together become 0 (ties by layer, pos); other layers (biases) are untouched.

The boundary, the (|value|, layer, pos) of the k-th smallest weight, is one row per model. It is
found in four passes, each a map-side combined histogram of the previous pass's boundary cell: a
fine log-scale bucket of |value|, the exact (|value|, layer), a bucket of the position, the
position. The boundaries are then broadcast (a row a model) and every weight is compared with
its model's: the weight table itself is never shuffled, joined or sorted, however many of its
values tie (for example at exact zero).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOG_STEPS = 1 << 16      # log-scale buckets per octave (a histogram of <= ~2M cells per model)
ZERO_BUCKET = -(1 << 40)  # below every log bucket of a positive double


def is_weight(layer: Column) -> Column:
    return F.instr(layer, ".weight") > 0


def _b1(a: Column) -> Column:
    return F.when(a > 0, F.floor(F.log2(a) * LOG_STEPS)).otherwise(F.lit(ZERO_BUCKET)).cast("bigint")


POS_BITS = 12          # final window: at most 4,096 positions of one (value, layer) cell


def _refine(rows: DataFrame, group: list[str], cell: list[str], bounds: DataFrame) -> DataFrame:
    """``bounds`` (group..., earlier cells..., _left) with the boundary ``cell`` added and ``_left`` reduced to the
    rank within it: a histogram over the rows of the earlier cells, which a broadcast join picks out."""
    known = [c for c in bounds.columns if c != "_left"]
    hist = rows.join(F.broadcast(bounds), known).groupBy(*known, "_left", *cell).agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.partitionBy(*group).orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)
    placed = hist.withColumn("_before", F.coalesce(F.sum("_cnt").over(before), F.lit(0)))
    hit = placed.filter((F.col("_before") < F.col("_left")) & (F.col("_before") + F.col("_cnt") >= F.col("_left")))
    return hit.select(*known, *cell, (F.col("_left") - F.col("_before")).alias("_left"))


def boundaries(df: DataFrame, group: Sequence[str], factors: DataFrame, value: str) -> DataFrame:
    """(group..., _v, _layer, _pos): the k-th smallest ``value`` (>= 0) of every group, k from its factor.

    ``df`` is (group..., layer, pos, value). Groups with k = 0 have no row.
    """
    g = list(group)
    d = df.select(*g, F.col(value).alias("_v"), F.col("layer").alias("_layer"), F.col("pos").cast("bigint").alias("_pos"), _b1(F.col(value)).alias("_b1"))
    d = d.withColumn("_b4", F.shiftright("_pos", POS_BITS))
    hist = d.groupBy(*g, "_b1").agg(F.count(F.lit(1)).alias("_cnt"))
    whole = Window.partitionBy(*g)
    before = whole.orderBy("_b1").rowsBetween(Window.unboundedPreceding, -1)
    placed = hist.withColumn("_before", F.coalesce(F.sum("_cnt").over(before), F.lit(0))).withColumn("_nw", F.sum("_cnt").over(whole)).join(F.broadcast(factors), g)
    placed = placed.withColumn("_k", F.bround(F.col("pruning_factor") * F.col("_nw"), 0).cast("bigint"))
    bounds = placed.filter((F.col("_before") < F.col("_k")) & (F.col("_before") + F.col("_cnt") >= F.col("_k"))) \
        .select(*g, (F.col("_k") - F.col("_before")).alias("_left"), "_b1")
    for cell in (["_v", "_layer"], ["_b4"], ["_pos"]):
        bounds = _refine(d, g, cell, bounds)
    return bounds.select(*g, "_v", "_layer", "_pos")


def prune_weights(weights: DataFrame, factors: DataFrame, model_cols: Sequence[str] = ("model_id",)) -> DataFrame:
    """T5: ``factors`` is ``(model..., pruning_factor)``, one row a model; returns the weight table with the
    k smallest-magnitude ``.weight`` values of each model set to 0. A model without a factor is kept as it is."""
    mc = list(model_cols)
    magnitude = F.abs(F.col("value").cast("double"))
    cuts = boundaries(weights.filter(is_weight(F.col("layer"))).withColumn("_a", magnitude), mc, factors, "_a")
    rows = weights.join(F.broadcast(cuts), mc, "left")
    inside = (magnitude < F.col("_v")) | ((magnitude == F.col("_v")) & ((F.col("layer") < F.col("_layer")) | (
        (F.col("layer") == F.col("_layer")) & (F.col("pos").cast("bigint") <= F.col("_pos")))))
    cut = is_weight(F.col("layer")) & F.coalesce(inside, F.lit(False))
    return rows.select(*mc, "layer", "pos", F.when(cut, F.lit(0.0)).otherwise(F.col("value").cast("double")).alias("value"))


def count_weights(weights: DataFrame, model_cols: Sequence[str] = ("model_id",)) -> DataFrame:
    """Parameters and non-zero parameters per model, all layers."""
    return weights.groupBy(*model_cols).agg(F.count(F.lit(1)).alias("n_params"),
                                            F.count_if(F.col("value") != 0).alias("n_nonzero"))
