"""Best-fit packing of documents into fixed-capacity sequences, with large items matched first.

Method. Pieces longer than a third of the capacity fit at most two to a sequence, so they are matched
greedily: the largest with the largest that still fits beside it. All smaller pieces then go, longest
first, into the tightest gap that holds them, and open a new sequence only if there is none.

Pieces of one length are interchangeable, so the plan is made on the histogram of lengths: at most
``capacity`` rows reach the driver, whatever the input, and the packing is still that of the greedy
method over all pieces at once. The plan is a list of runs: the pieces of a length with ranks from
``start`` on lie in so many sequences from ``sequence`` on, ``each`` to a sequence, from ``offset`` on.
Ranks of pieces within a length are counted in Spark, split by a salt so that a length shared by a third
of all rows is still dealt to many tasks. Each task then looks its pieces up in the runs.

Defined cases: a null or empty text is the end id alone. Rows with the same doc_id are documents of their
own. A null doc_id stays null. Equal lengths tie by (doc_id, piece, crc). Extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from quiver.llm import textops as T, tokens as K
from quiver.session import materialize, ship_package, small_batches

CAPACITY = 2048
END_ID = 0
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, start, count, each, sequence, offset): ``count`` sequences hold ``each`` pieces of the length."""
    left = {n: c for n, c in histogram.items() if c > 0}
    groups: list[tuple[int, list[tuple[int, int]]]] = []  # (sequences, [(length, pieces to a sequence)])

    large = sorted(n for n in left if 3 * n > capacity)
    for n in reversed(large):
        while left[n]:
            at = bisect_left(large, capacity - n + 1) - 1
            while at >= 0 and (large[at] > n or not left[large[at]] or (large[at] == n and left[n] < 2)):
                at -= 1
            if at < 0:
                groups.append((left[n], [(n, 1)]))
                left[n] = 0
            elif large[at] == n:
                groups.append((left[n] // 2, [(n, 2)]))
                left[n] %= 2
            else:
                partner = large[at]
                m = min(left[n], left[partner])
                groups.append((m, [(n, 1), (partner, 1)]))
                left[n] -= m
                left[partner] -= m

    by_gap: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    gaps: list[int] = []

    def put(count: int, content: list[tuple[int, int]]) -> None:
        gap = capacity - sum(n * k for n, k in content)
        if gap not in by_gap:
            by_gap[gap] = []
            insort(gaps, gap)
        by_gap[gap].append((count, content))

    for count, content in groups:
        put(count, content)
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        todo = left[n]
        while todo:
            at = bisect_left(gaps, n)
            if at == len(gaps):
                each = capacity // n
                if todo >= each:
                    put(todo // each, [(n, each)])
                if todo % each:
                    put(1, [(n, todo % each)])
                break
            gap = gaps[at]
            count, content = by_gap[gap].pop()
            if not by_gap[gap]:
                del by_gap[gap], gaps[at]
            each = gap // n
            full = min(count, todo // each)
            if full:
                put(full, content + [(n, each)])
                todo -= full * each
                count -= full
            if count and todo:  # fewer than ``each`` are left: one sequence takes them all
                put(1, content + [(n, todo)])
                todo = 0
                count -= 1
            if count:
                put(count, content)

    runs, rank, sequence = [], {}, 0
    for gap in gaps:
        for count, content in by_gap[gap]:
            offset = 0
            for n, each in content:
                start = rank.get(n, 0)
                runs.append((n, start, count, each, sequence, offset))
                rank[n] = start + count * each
                offset += n * each
            sequence += count
    return sorted(runs)


class Places:
    """Runs as arrays: sequence and offset of the piece of a length with a rank."""

    def __init__(self, runs: list[tuple[int, int, int, int, int, int]]) -> None:
        table = np.array(runs, dtype=np.int64).reshape(-1, 6)
        self.length, self.start, _, self.each, self.sequence, self.offset = table.T
        self.key = (self.length << 48) + self.start

    def look_up(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length << 48) + rank, side="right") - 1
        place = rank - self.start[at]
        return self.sequence[at] + place // self.each[at], self.offset[at] + place % self.each[at] * length


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32[, ids]) of every document, cut from its end so that only the first is shorter."""
    spark = docs.sparkSession
    ship_package(spark)
    small_batches(spark)
    name = K.ship_vocabulary(spark, vocabulary)

    def run(batches):
        encoder = K.Encoder.of(name)
        for batch in batches:
            for a, b in T.slices(batch.column(1)):
                rows = []
                for doc_id, ids in zip(batch.column(0).slice(a, b - a).to_pylist(), K.encoded(encoder, batch.column(1).slice(a, b - a), end_id)):
                    cuts = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
                    for piece, (x, y) in enumerate(zip(cuts, cuts[1:])):
                        raw = ids[x:y].astype("<u4").tobytes()
                        rows.append((doc_id, piece, x, y - x, zlib.crc32(raw), raw)[: 6 if keep_ids else 5])
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names[: len(rows[0])])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(T.lean(run, drop=False), _PIECE + (", ids binary" if keep_ids else ""))


def pack(rows: DataFrame, capacity: int = CAPACITY, rows_a_salt: int = 100_000) -> DataFrame:
    """``rows`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    rows = materialize(rows)
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    places = rows.sparkSession.sparkContext.broadcast(Places(plan(histogram, capacity)))
    salts = 1 + sum(histogram.values()) // rows_a_salt
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    own = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)  # at most ``salts`` rows a length
    base = own.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(order) - 1).join(base, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank"))

    def run(batches):
        for batch in batches:
            if len(batch):
                sequence, offset = places.value.look_up(batch.column(3).to_numpy(), batch.column(5).to_numpy())
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(run, _PIECE + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    return pack(pieces(docs, vocabulary, capacity, end_id), capacity)


def default_vocabulary() -> str:
    """Place of the installed public vocabulary (driver only; the file itself is sent to the executors)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs, default_vocabulary())
