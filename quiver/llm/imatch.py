"""Document fingerprints by I-Match: idf band, sorted distinct terms, hashes of randomised lexicon subsets.

1. One pass counts, for every word of the corpus, the documents that hold it (all documents, exact;
   each task adds up its own words first).
2. The lexicon is the band of words whose document frequency lies between two shares of the corpus. It has at most
   (mean distinct words of a document) / ``min_share`` words, whatever the number of documents, since every one of them
   is in at least ``min_share`` of them; at 8 bytes each it is broadcast (on sf0.1 at most 2,000 x 269 words, 4 MB).
3. ``RATES`` fixes lexicon subsets before any text is read: part r of a fingerprint owns the lexicon words whose
   hash for r lies in the lowest ``RATES[r]`` of all hashes. The part is the hash of the sorted distinct band words of the
   text inside its subset, all of them; part 0 takes the whole lexicon, as the plain method does, the others five subsets at
   each rate from 1/4 to 1/1024. Sparse
   subsets survive edits of long texts, dense ones tell short texts apart. A text with fewer than ``min_terms`` band words uses all
   its distinct words.
4. The likeness of two fingerprints is the share of equal parts among those that are not empty in both.

Defined cases: a null or empty text, or one of white space only, has the fingerprint ``""``; two such
texts have likeness 1, one of them and any other 0. Equal texts have equal fingerprints. Documents
follow one another by (doc_id, text), null ids first; repeated rows are documents of their own. Texts of any length count
whole. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, functions as F

from quiver.llm import textops as T
from quiver.session import ship_package

RATES = (1.0, *[2.0**-k for k in range(2, 11) for _ in range(5)])
_FLUSH = 1 << 21


def _document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial document frequencies of one task, added up while they fit in memory."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merged():
        words = np.concatenate([w for w, _ in held])
        order = np.argsort(words, kind="stable")
        words, counts = words[order], np.concatenate([c for _, c in held])[order]
        new = np.flatnonzero(np.append(True, words[1:] != words[:-1]))
        return words[new], np.add.reduceat(counts, new)

    def out(words, counts):
        for i in range(0, len(words), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(words[i : i + (1 << 17)].view(np.int64)), pa.array(counts[i : i + (1 << 17)])], ["word", "df"])

    for batch in batches:
        texts = batch.column(0)
        for a, b in T.slices(texts):
            w = T.word_table(texts.slice(a, b - a))
            values, _, _ = T.distinct_per_doc(w.doc, w.hash, b - a)
            if values.size:
                words, counts = np.unique(values, return_counts=True)
                held.append((words, counts.astype(np.int64)))
                size += words.size
        if size > _FLUSH:
            held = [merged()]
            size = held[0][0].size
            if size > _FLUSH // 2:
                yield from out(*held[0])
                held, size = [], 0
    if held:
        yield from out(*merged())


def lexicon(docs: DataFrame, min_share: float = 0.0005, max_share: float = 0.1) -> np.ndarray:
    """Sorted 64-bit hashes of the words in the idf band."""
    ship_package(docs.sparkSession)
    df = docs.select("text").mapInArrow(T.lean(_document_frequency), "word long, df long").groupBy("word").agg(F.sum("df").alias("df"))
    n = docs.count()
    low, high = max(2, int(np.ceil(n * min_share))), max(2, int(n * max_share))
    words = df.where(F.col("df").between(low, high)).select("word").toArrow().column("word").to_numpy()  # bounded by min_share, see above
    return np.sort(words.view(np.uint64))


class Fingerprinter:
    """Fingerprints of a slice of texts with a given lexicon."""

    def __init__(self, lexicon: np.ndarray, rates: tuple, min_terms: int) -> None:
        self.lexicon, self.min_terms = lexicon, min_terms
        self.limits = [(1 << 64) - 1 if r >= 1 else int(r * 2**64) for r in rates]
        self.probe = np.zeros(1 << 23, dtype=bool)
        self.probe[(lexicon & T.U64((1 << 23) - 1)).astype(np.int64)] = True

    def in_band(self, words: np.ndarray) -> np.ndarray:
        hit = self.probe[(words & T.U64((1 << 23) - 1)).astype(np.int64)]
        at = np.flatnonzero(hit)
        if at.size:
            place = np.minimum(np.searchsorted(self.lexicon, words[at]), len(self.lexicon) - 1)
            hit[at] = self.lexicon[place] == words[at]
        return hit

    def parts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(texts x subsets) uint16 parts, 0 for a subset without a word of the text, and which texts hold any word."""
        n = len(texts)
        w = T.word_table(texts)
        terms, _, per_doc = T.distinct_per_doc(w.doc, w.hash, n)  # sorted within a text
        filled = per_doc > 0
        out = np.zeros((n, len(self.limits)), dtype=np.uint16)
        if not terms.size:
            return out, filled
        band = self.in_band(terms)
        doc = np.repeat(np.arange(n), per_doc)
        few = np.bincount(doc, weights=band, minlength=n) < self.min_terms
        keep = band | few[doc]
        terms, doc = terms[keep], doc[keep]
        with np.errstate(over="ignore"):
            for r, limit in enumerate(self.limits):
                x = T.mix64(terms ^ T.U64((r + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
                inside = np.flatnonzero(x <= T.U64(limit))
                if not inside.size:
                    continue
                owner, x = doc[inside], terms[inside]
                starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                place = np.arange(owner.size) - np.repeat(starts, np.diff(np.append(starts, owner.size)))
                total = np.add.reduceat(T.mix64(x + T.mix64(place + r)), starts)  # the words in their order
                out[owner[starts], r] = (T.mix64(total) % T.U64(65535)).astype(np.uint16) + 1
        return out, filled

    def hex(self, parts: np.ndarray, filled: np.ndarray) -> list[str]:
        return [row.astype(">u2").tobytes().hex() if ok else "" for row, ok in zip(parts, filled)]


def likeness(a: np.ndarray, a_filled: np.ndarray, b: np.ndarray, b_filled: np.ndarray) -> np.ndarray:
    used = (a > 0) | (b > 0)
    same = ((a == b) & used).sum(axis=1) / np.maximum(used.sum(axis=1), 1)
    return np.where(a_filled & b_filled, same, (~a_filled & ~b_filled).astype(float))


def fingerprints(docs: DataFrame, terms: np.ndarray, rates: tuple = RATES, min_terms: int = 8) -> DataFrame:
    """``docs`` (doc_id, text) with their fingerprint: (doc_id, fingerprint)."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        f = Fingerprinter(shared.value, rates, min_terms)
        for batch in batches:
            for a, b in T.slices(batch.column(1)):
                parts, filled = f.parts(batch.column(1).slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(f.hex(parts, filled))], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def with_successor(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows (bucket, seam, doc_id, text) dealt and sorted so that every document is followed by the next one.

    Documents are dealt to ranges of doc_id (approximate quantiles, as many as there are shuffle
    partitions); the first document of each range is also sent to the range before it (seam = true),
    the very first to the last range.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = docs.select(F.col("doc_id").cast("double").alias("key"))
    cuts = sorted(set(key.approxQuantile("key", [i / n for i in range(1, n)], min(0.001, 0.1 / n)))) if n > 1 else []
    if cuts:
        rule = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="key", outputCol="range", handleInvalid="keep")
        docs = rule.transform(docs.withColumn("key", F.coalesce(F.col("doc_id").cast("double"), F.lit(float(-(2**63))))))
        docs = docs.select(F.col("range").cast("int").alias("bucket"), "doc_id", "text")
    else:
        docs = docs.select(F.lit(0).alias("bucket"), "doc_id", "text")
    first = docs.groupBy("bucket").agg(F.min("doc_id").alias("low"), F.max(F.col("doc_id").isNull()).alias("has_null")).orderBy("bucket").collect()
    seams = [(first[i - 1]["bucket"], first[i]["bucket"], None if first[i]["has_null"] else first[i]["low"]) for i in range(len(first))]
    seams = spark.createDataFrame(seams, "target int, home int, low long")  # one row a range
    docs = docs.join(F.broadcast(seams), F.col("doc_id").eqNullSafe(F.col("low")) & (F.col("bucket") == F.col("home")), "left")
    own = F.array(F.struct("bucket", F.lit(False).alias("seam")))
    both = F.array(F.struct("bucket", F.lit(False).alias("seam")), F.struct(F.col("target").alias("bucket"), F.lit(True).alias("seam")))
    rows = docs.select(F.explode(F.when(F.col("home").isNull(), own).otherwise(both)).alias("place"), "doc_id", "text")
    n = len(cuts) + 1
    rows = rows.select("place.bucket", "place.seam", "doc_id", "text").repartitionById(n, F.col("bucket"))
    return rows.sortWithinPartitions("bucket", "seam", "doc_id", "text"), n


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter (rounded down) replaced by the first as many code points of ``following``."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def robustness(docs: DataFrame, terms: np.ndarray, rates: tuple = RATES, min_terms: int = 8) -> DataFrame:
    """Fingerprint of every document and of its edited text, and the likeness to it and to the next document."""
    rows, _ = with_successor(docs)
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def report(f, ids, texts, following):
        own = pa.array(texts + following[-1:], pa.large_string())
        changed = [edited(t, u) for t, u in zip(texts, following)]
        parts, filled = f.parts(own)
        after, after_filled = f.parts(pa.array(changed, pa.large_string()))
        this, this_filled = parts[:-1], filled[:-1]
        return pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
            pa.array(f.hex(this, this_filled)),
            pa.array(f.hex(after, after_filled)),
            pa.array(likeness(this, this_filled, after, after_filled)),
            pa.array(likeness(this, this_filled, parts[1:], filled[1:])),
        ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches):
        f = Fingerprinter(shared.value, rates, min_terms)
        ids, texts, size, done = [], [], 0, False
        for batch in batches:
            if done:
                continue
            for seam, i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                ids.append(i)
                texts.append(t)
                size += len(t)
                if seam or size > T.SLICE_BYTES:
                    if len(texts) > 1:
                        yield report(f, ids[:-1], texts[:-1], texts[1:])
                    ids, texts, size = ids[-1:], texts[-1:], 0
                if seam:  # the first of the rows that open the next range ends this one
                    done = True
                    break

    return rows.select("seam", "doc_id", "text").mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op10_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return robustness(docs, lexicon(docs))
