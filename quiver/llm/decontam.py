"""Benchmark decontamination by pigeonhole edit matching.

A document holds a test item if some stretch of it is within ``errors`` = floor(rate * length) edits of the
item, both with A-Z and other letters lower-cased and white space runs as one space. Cut into errors + 1
pieces, an item that occurs with at most that many edits has at least one piece left intact, so the exact
hits of all pieces (one Aho-Corasick scan of the whole text) find every place to look at; each place,
widened by the error budget, is verified with Myers' bit-parallel distance. Nothing else is skipped, so the
result is exact.

The items are the stated query set; they are broadcast in blocks of at most ``block_chars`` characters, each
block one pass over the documents, so no block grows with the benchmark. Documents are never shuffled.

Defined cases: null or empty documents match nothing; null items, and items without any text, match
nothing. Every row of the documents and of the benchmark is taken for itself, so repeated rows give
repeated matches; null ids stay null. Of several places the one with the fewest edits is reported, the
first if they tie. Extra columns are ignored; an empty table on either side gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quiver.llm import textops as T
from quiver.session import ship_package, small_batches

RATE = 0.08
BLOCK_CHARS = 4 << 20
_MATCH = "doc_id long, item_id long, errors int, start long, end long"


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def myers(pattern: str, text: str, at_most: int) -> tuple[int, int] | None:
    """(edits, end) of the best occurrence of ``pattern`` in ``text``, the first one, if it has at most so many edits."""
    m = len(pattern)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    equal: dict[str, int] = {}
    for i, c in enumerate(pattern):
        equal[c] = equal.get(c, 0) | 1 << i
    up, down, score, best = mask, 0, m, None
    for j, c in enumerate(text):
        eq = equal.get(c, 0)
        vertical = eq | down
        horizontal = (((eq & up) + up) ^ up) | eq
        plus = down | ~(horizontal | up)
        minus = up & horizontal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = plus << 1, minus << 1
        up = (minus | ~(vertical | plus)) & mask
        down = plus & vertical & mask
        if score <= at_most and (best is None or score < best[0]):
            best = score, j + 1
    return best


class Matcher:
    """Finds a block of items in texts."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float) -> None:
        self.items = [(i, t, int(len(t) * rate)) for i, t in items if t]
        self.pieces = ahocorasick.Automaton()
        for k, (_, text, errors) in enumerate(self.items):
            cuts = [len(text) * p // (errors + 1) for p in range(errors + 2)]
            for a, b in zip(cuts, cuts[1:]):
                piece = text[a:b]
                held = self.pieces.get(piece, None)
                if held is None:
                    self.pieces.add_word(piece, (b - a, [(k, a)]))
                else:
                    held[1].append((k, a))
        if self.items:
            self.pieces.make_automaton()

    def matches(self, raw: str | None) -> Iterator[tuple[int | None, int, int, int]]:
        """(item_id, edits, start, end) of every item found; places are code points of the normalised text."""
        if not raw or not self.items:
            return
        text = normal(raw)
        places: dict[int, set[int]] = {}
        for end, (length, owners) in self.pieces.iter(text):
            for k, offset in owners:
                places.setdefault(k, set()).add(end + 1 - length - offset)
        for k in sorted(places):
            item_id, pattern, errors = self.items[k]
            found = self._best(text, pattern, errors, sorted(places[k]))
            if found:
                yield item_id, *found

    def _best(self, text: str, pattern: str, errors: int, starts: list[int]) -> tuple[int, int, int] | None:
        m = len(pattern)
        for s in starts:
            if s >= 0 and text.startswith(pattern, s):
                return 0, s, s + m
        best, at = None, 0
        while at < len(starts):  # windows that overlap are searched as one
            low, high = starts[at] - errors, starts[at] + m + errors
            at += 1
            while at < len(starts) and starts[at] - errors <= high:
                high = starts[at] + m + errors
                at += 1
            low = max(low, 0)
            hit = myers(pattern, text[low:high], errors)
            if hit and (best is None or hit[0] < best[0]):
                end = low + hit[1]
                back = myers(pattern[::-1], text[max(0, end - m - errors) : end][::-1], hit[0])
                best = hit[0], end - back[1], end
        return best


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int | None, str]]]:
    """Normalised items in blocks; a block comes to the driver, the benchmark as a whole never does."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.length("text") + 64)).first()[0] or 0
    blocks = 1 + total // block_chars
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        yield [(r["item_id"], normal(r["text"])) for r in own.collect()]


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, errors, start, end) for every document and item that it holds."""
    spark = docs.sparkSession
    ship_package(spark)
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def finder(block):
        shared = spark.sparkContext.broadcast(block)

        def run(batches):
            matcher = Matcher(shared.value, rate)
            for batch in batches:
                rows = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for m in matcher.matches(t)]
                if rows:
                    d, i, e, a, b = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(i, pa.int64()), pa.array(e, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                                                     ["doc_id", "item_id", "errors", "start", "end"])

        return docs.mapInArrow(run, _MATCH)

    found = None
    for block in item_blocks(benchmark, block_chars):
        part = finder(block)
        found = part if found is None else found.unionByName(part)
    return found


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no item. Row by row, without a shuffle."""
    spark = docs.sparkSession
    ship_package(spark)
    small_batches(spark)

    def filtered(rows, block):
        shared = spark.sparkContext.broadcast(block)

        def run(batches):
            matcher = Matcher(shared.value, rate)
            for batch in batches:
                yield batch.filter(pa.array([next(matcher.matches(t), None) is None for t in batch.column("text").to_pylist()], pa.bool_()))

        return rows.mapInArrow(T.lean(run), rows.schema)

    for block in item_blocks(benchmark, block_chars):
        docs = filtered(docs, block)
    return docs


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
