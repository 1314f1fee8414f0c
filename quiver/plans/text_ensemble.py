"""Bagged naive Bayes over documents: the text counterpart of the centroid ensemble.

documents join labels -> hold-out split -> exact bootstrap replicas of the training half ->
one multinomial naive Bayes per replica (single aggregation) -> token scoring, soft vote, arg-max
and truth in one pass -> confusion.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.operators import learn, metrics, sampling, score
from quiver.plans.centroid_ensemble import train_test
from quiver.session import materialize


class TextRun:
    """A trained text ensemble; predictions are planned on first use."""

    def __init__(self, loglik: DataFrame, prior: DataFrame, packed: DataFrame, test: DataFrame) -> None:
        self.loglik, self.prior, self._packed, self._test = loglik, prior, packed, test

    @cached_property
    def scores(self) -> DataFrame:
        return score.score_naive_bayes(self._test, self._packed, "doc_id")

    @cached_property
    def aligned(self) -> DataFrame:
        return score.score_naive_bayes(self._test, self._packed, "doc_id", label="label", predict=True)

    @cached_property
    def predictions(self) -> DataFrame:
        return self.aligned.select("doc_id", "y_pred")

    @cached_property
    def confusion(self) -> DataFrame:
        return metrics.confusion(self.aligned)


def labelled_documents(documents: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    return documents.select("doc_id", "text").join(labels.select("doc_id", F.col(label).alias("label")), "doc_id")


def run(documents: DataFrame, labels: DataFrame, label: str = "quality", replicas: int = 5, seed=42,
        task: str = "quality", alpha: float = 1.0, resample: str = "exact") -> TextRun:
    """``resample='exact'`` draws n documents per replica (the reference's bootstrap);
    ``'poisson'`` is its scale form: multiplicities computed from each document's own key."""
    # the join moves whole texts, so it is done once
    docs = materialize(labelled_documents(documents, labels, label))
    train, test = train_test(docs, "doc_id", seed)
    if resample == "poisson":
        loglik, prior = learn.train_naive_bayes(train, None, "doc_id", alpha=alpha,
                                                reps=sampling.poisson_reps(F.col("doc_id"), replicas))
    else:
        samples = sampling.bootstrap_exact(train, "doc_id", replicas)
        loglik, prior = learn.train_naive_bayes(train, samples, "doc_id", alpha=alpha)
    # The trained models (every replica's log-likelihoods and priors, packed per token for
    # scoring) are written once and scored from storage, like the reference's saved models.
    return TextRun(loglik, prior, materialize(score.pack_naive_bayes(loglik, prior)), test)
