"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each document gives a vector of statistics of its whole text (``FEATURES``), computed with numpy inside
the tasks. Per class, one distributed pass adds up the sufficient statistics (count, sum, sum of outer
products) of the labelled training rows; covariances are shrunk towards the diagonal of the pooled
covariance; the score is the logistic of the difference of the two Mahalanobis log-densities plus the
log prior odds. The Cholesky factors are computed once on the driver (``len(FEATURES)`` squared
numbers a class) and reused by every task.

Defined cases: a null or empty text has the statistics of a text without words and gets a score like any
other. Labels other than 0 and 1, null labels and null ids do not train; a document with several label
rows trains once for each. With no training row in a class the score is the share of label 1 (0.5 without
any rows). Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quiver.llm import textops as T
from quiver.session import materialize, ship_package, small_batches

FEATURES = ["words", "word_length", "upper", "symbols", "stops", "digits", "distinct", "top_word", "repeats", "bigrams", "lines", "line_repeats", "non_ascii", "bars", "ends", "long_words"]
THRESHOLD = 0.3


def _class_table() -> np.ndarray:
    """Kind of every byte: 0 other, 1 white space, 2 lower, 3 upper, 4 digit, 5 sentence mark, 6 symbol, 7 non-ASCII lead, 8 continuation, 9 bar."""
    kind = np.full(256, 6, np.uint8)
    kind[:32] = 0
    kind[[9, 10, 11, 12, 13, 32]] = 1
    kind[97:123], kind[65:91], kind[48:58] = 2, 3, 4
    kind[[ord(c) for c in ".,;:?'\"-()"]] = 5
    kind[192:], kind[128:192], kind[ord("|")], kind[127] = 7, 8, 9, 0
    return kind


_KIND = _class_table()


def statistics(texts: pa.Array) -> np.ndarray:
    """(texts x features) transformed statistics of whole texts."""
    n = len(texts)
    data, offsets = T.utf8_parts(texts)
    kind = _KIND[data]
    lengths = np.diff(offsets)

    def share(mask: np.ndarray, of: np.ndarray) -> np.ndarray:
        return T.segment_sum(mask.astype(np.int64), lengths) / np.maximum(of, 1)

    letters = T.segment_sum(((kind == 2) | (kind == 3) | (kind == 7)).astype(np.int64), lengths)
    points = T.segment_sum((kind != 8).astype(np.int64), lengths)
    w = T.word_table(texts)
    words = w.per_doc.astype(float)
    some = np.maximum(words, 1)
    _, counts, distinct = T.distinct_per_doc(w.doc, w.hash, n)
    top = np.zeros(n)
    starts = np.cumsum(distinct) - distinct
    if counts.size:
        top[distinct > 0] = np.maximum.reduceat(counts, starts[distinct > 0])
    same = np.zeros(len(w.hash), np.int64)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    repeats = T.segment_sum(same, w.per_doc)
    pairs, per_pair = T.shingle_table(w, 2)
    _, _, distinct_pairs = T.distinct_per_doc(np.repeat(np.arange(n), per_pair), pairs, n)
    newline = T.segment_sum((data == 10).astype(np.int64), lengths)
    line_repeats = np.array([_line_repeats(t) if k else 0.0 for t, k in zip(texts.to_pylist(), newline)])
    non_space = np.maximum(points - share(kind == 1, np.ones(n)), 1)
    last = np.append(data[1:], 32)
    ends = T.segment_sum(((kind == 5) & ((last == 32) | (last == 10))).astype(np.int64), lengths)
    long_words = _long_words(kind, offsets, n)
    return np.column_stack([
        np.log1p(words),
        np.log(non_space / some),
        np.log(share(kind == 3, letters) + 0.01),
        np.log(share((kind == 6) | (kind == 9), non_space) + 0.003),
        np.log(share(kind == 5, some) + 0.02),
        np.log(share(kind == 4, non_space) + 0.003),
        np.log1p(distinct) / np.log1p(some),
        np.log(top / some + 0.01),
        np.log(repeats / some + 0.01),
        np.log(1 - distinct_pairs / np.maximum(per_pair, 1) + 0.02),
        np.log((newline + 1) / some),
        np.log(line_repeats + 0.05),
        np.log(share(kind == 7, non_space) + 0.01),
        np.log(share(kind == 9, some) + 0.01),
        np.log(ends / some + 0.01),
        np.log(long_words / some + 0.01),
    ])


def _line_repeats(text: str) -> float:
    lines = [x for x in text.split("\n") if x]
    return 1 - len(set(lines)) / len(lines) if lines else 0.0


def _long_words(kind: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """Words of more than 16 bytes."""
    if not kind.size:
        return np.zeros(n)
    cut = np.union1d(np.flatnonzero(kind == 1), offsets[1:-1] - 1)
    at = np.concatenate(([-1], cut, [kind.size - 1]))
    long = at[1:][np.diff(at) > 17]
    return np.bincount(np.searchsorted(offsets, long, side="right") - 1, minlength=n + 1)[:n].astype(float)


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x binary: float64 statistics) of every row of ``docs``."""
    ship_package(docs.sparkSession)
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for a, b in T.slices(batch.column(1)):
                x = statistics(batch.column(1).slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(T.lean(run), "doc_id long, x binary")


def _sums(batches):
    """Partial sufficient statistics of a task: one row a class."""
    d = len(FEATURES)
    total = {c: np.zeros(1 + d + d * d) for c in (0, 1)}
    for batch in batches:
        label = batch.column(0).to_numpy(zero_copy_only=False)
        x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float64).reshape(-1, d)
        for c in total:
            own = x[label == c]
            total[c] += np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).ravel()))
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(map(list, total.values())), pa.list_(pa.float64()))], ["label", "sums"])


class Discriminant:
    """Two Gaussian classes with shrunk covariances; ``fit`` takes the sufficient statistics of each."""

    def __init__(self, prior: float, parts: dict[int, tuple[np.ndarray, np.ndarray, float]] | None) -> None:
        self.prior, self.parts = prior, parts

    @classmethod
    def fit(cls, sums: dict[int, np.ndarray], shrinkage: float) -> "Discriminant":
        d = len(FEATURES)
        n = {c: s[0] for c, s in sums.items()}
        total = sum(n.values())
        if min(n.get(0, 0), n.get(1, 0)) < 1:
            return cls(n.get(1, 0) / total if total else 0.5, None)
        mean = {c: s[1 : 1 + d] / s[0] for c, s in sums.items()}
        scatter = {c: s[1 + d :].reshape(d, d) - s[0] * np.outer(mean[c], mean[c]) for c, s in sums.items()}
        pooled = np.diag(np.diag(scatter[0] + scatter[1]) / total + 1e-4)
        parts = {}
        for c in (0, 1):
            weight = shrinkage + (1 - shrinkage) * d / (n[c] + d)
            factor = np.linalg.cholesky((1 - weight) * scatter[c] / n[c] + weight * pooled)
            parts[c] = (mean[c], np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum())
        return cls(n[1] / total, parts)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.parts is None:
            return np.full(len(x), self.prior)
        density = {c: -0.5 * ((((x - m) @ inverse.T) ** 2).sum(axis=1) + log_det) for c, (m, inverse, log_det) in self.parts.items()}
        odds = density[1] - density[0] + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def train(vectors: DataFrame, labels: DataFrame, shrinkage: float = 0.1) -> Discriminant:
    """Fit from (doc_id, x) and (doc_id, quality), all labelled rows given."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("label IN (0, 1)")
    rows = vectors.join(known, "doc_id").select("label", "x").mapInArrow(_sums, "label int, sums array<double>")
    each = rows.select("label", F.posexplode("sums").alias("place", "value"))
    added = each.groupBy("label", "place").agg(F.sum("value").alias("value")).collect()  # two classes x the size of the statistics
    sums = {c: np.zeros(1 + len(FEATURES) + len(FEATURES) ** 2) for c in (0, 1)} if added else {}
    for r in added:
        sums[r["label"]][r["place"]] = r["value"]
    return Discriminant.fit(sums, shrinkage)


def trained_on(labels: DataFrame) -> DataFrame:
    """The label rows that may train: crc32 of doc_id as text not divisible by 5."""
    return labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)


def scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, shrinkage: float = 0.1) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    vectors = materialize(features(docs))
    model = vectors.sparkSession.sparkContext.broadcast(train(vectors, trained_on(labels), shrinkage))

    def run(batches):
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.score(x))], ["doc_id", "score"])

    scored = vectors.mapInArrow(run, "doc_id long, score double")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, shrinkage: float = 0.1, sample: int = 20_000) -> DataFrame:
    """The rows of ``docs``, all columns, that score at least ``threshold``; row by row, without a shuffle.

    The model is fitted on at most ``sample`` label rows of documents (the first ones by a hash of doc_id), so that
    their ids can be broadcast; rows that cannot train, without a quality or a document, do not count. All rows are scored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    small_batches(spark)
    known = trained_on(labels).select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(F.col("doc_id").isNotNull() & F.col("quality").cast("int").isin(0, 1))
    first = lambda rows: materialize(rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    ids, chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id")), first(known)
    own = chosen.select("doc_id").distinct()
    if ids.join(F.broadcast(own), "doc_id", "left_semi").distinct().count() < own.count():  # some have no document
        chosen = first(known.join(ids.distinct(), "doc_id", "left_semi"))
    known = chosen
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known.select(F.col("doc_id").alias("_id")).distinct()), F.col("doc_id") == F.col("_id"), "left_semi")
    # dealt anew, so that statistics and sums are two stages: in one, each task holds two Python workers, and an executor keeps them
    model = spark.sparkContext.broadcast(train(features(labelled).repartition("doc_id"), known, shrinkage))

    def run(batches):
        for batch in batches:
            keep = [model.value.score(statistics(batch.column("text").slice(a, b - a))) >= threshold for a, b in T.slices(batch.column("text"))]
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(T.lean(run), docs.schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return scores(docs, labels)
