"""The bagged-ensemble evaluation as one Spark lineage (the flagship).

embeddings -> hold-out split -> exact bootstrap replicas of the training half ->
weighted class centroids per replica -> broadcast scoring of the test half ->
soft vote -> arg-max -> join with truth -> confusion -> classification report.

Shuffles: the split and position histograms (bounded; the split is fitted once), the draw
aggregation, the 1:1 join of multiplicities, the partial centroid sums and tiny ones after the
vote. Vote, arg-max and truth leave the scoring tasks together.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.operators import learn, metrics, sampling, score
from quiver.session import materialize


class EnsembleRun:
    """A trained ensemble; its tables are planned on first use, and its models are broadcast once."""

    def __init__(self, emb: DataFrame, train: DataFrame, test: DataFrame, samples: DataFrame, centroids: DataFrame,
                 models: DataFrame, key: str, task: str, seed) -> None:
        self.samples, self.centroids, self.models = samples, centroids, models
        self._emb, self._rows, self._key, self._seed = emb, test.withColumn("task", F.lit(task)), key, seed

    @cached_property
    def _blocks(self) -> list:
        return score.model_blocks(self.models, ["task"], ["replica"])

    def _score(self, **how) -> DataFrame:
        return score.score_centroids(self._rows, self.models, self._key, model_cols=["replica"], blocks=self._blocks, **how)

    @cached_property
    def split(self) -> DataFrame:
        return sampling.holdout_split(self._emb.select(self._key), self._key, seed=self._seed)

    @cached_property
    def scores(self) -> DataFrame:
        return self._score()

    @cached_property
    def totals(self) -> DataFrame:
        """G1 fused into scoring: probabilities are summed over the ensemble inside each task."""
        return self._score(vote_by=[]).drop("task")

    @cached_property
    def aligned(self) -> DataFrame:
        """G2 and X7 fused too: each row's arg-max and its own label leave the scoring task together."""
        return self._score(vote_by=[], predict=True, label="label").drop("task")

    @cached_property
    def predictions(self) -> DataFrame:
        return self.aligned.select(self._key, "y_pred")

    @cached_property
    def confusion(self) -> DataFrame:
        return metrics.confusion(self.aligned)


def train_test(df: DataFrame, key: str, seed=42, frac: float = 0.5,
               assignments: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Hold-out split; the 'test' part is evaluated, the other half trains.

    The split is fitted once (its cut, one row on reliable storage) and applied by a row-local
    comparison, so the many later references to either half do not recompute it. ``assignments`` = an explicit ``(key, split)`` table
    (e.g. another tool's split, to reproduce published numbers) replaces the hash split.
    """
    if assignments is not None:
        split = df.join(assignments.select(key, "split"), key)
    else:
        split = sampling.apply_split(df, key, sampling.fit_split(df, key, frac=frac, seed=seed), seed=seed)
    return split.filter(F.col("split") == "val").drop("split"), split.filter(F.col("split") == "test").drop("split")


def run(emb: DataFrame, key: str = "vec_id", replicas: int = 10, seed=42, task: str = "embeddings",
        assignments: DataFrame | None = None, samples: DataFrame | None = None) -> EnsembleRun:
    """``assignments`` (key, split) and ``samples`` (replica, key, mult) may be given explicitly."""
    train, test = train_test(emb, key, seed, assignments=assignments)
    samples = samples if samples is not None else sampling.bootstrap_exact(train, key, replicas)
    # Trained models are small and reused by every scoring pass: they are trained and written once
    # (a table in the shared checkpoint folder), like the reference saves its models.
    cent = materialize(learn.train_centroids(train, samples, key, model_cols=["replica"]))
    packed = learn.pack_centroids(cent, ["replica"]).withColumn("task", F.lit(task))
    return EnsembleRun(emb, train, test, samples, cent, packed, key, task, seed)
