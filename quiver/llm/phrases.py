"""Phrase collocation mining by dynamic itemset counting.

Texts are cut into pieces and words; everything is counted per language. The documents lie in ``shards`` shards that are
scanned in a cycle. All words are counted from the first scan on; a longer phrase becomes active after the scan
in which the later of its two subphrases (without the last and without the first word) reached the threshold,
whatever its length, and is counted in every following scan until it has seen each shard once. Scans go on until
the last active phrase has completed its cycle. So lengths interleave, and a subphrase's count is only
waited for as long as it is below the threshold.

How a scan works in Spark. Tasks hash all words of their texts with numpy and find the active phrases with two
bitmaps: subphrases that have reached the threshold, and those that did within the last cycle. A bitmap has
no false negatives, and a phrase counted too early only brings exact counts of a shard that are not needed, so the bitmaps
limit work and never results. They have at most 2 ** ``BITS`` bits, whatever the corpus. Partial counts are sorted and
packed by hash range, shuffled, added up and written. A phrase's count is the sum over the last ``shards`` scans, each shard once;
only hashes with at least threshold / shards occurrences in some shard can reach the threshold, and only those
are looked up among the rare ones. Phrase hashes have 61 bits and a length. Texts of frequent phrases come from samples first and from a
last scan of all documents, which compares every occurrence by a second hash; if two texts share a hash the work is done again
with another seed.

Score of a frequent phrase: the least, over its cuts into two parts l and r, of floor(1000 * a * n / (l * r)) in exact decimals;
phrases that lie inside a longer one as frequent (``absorb`` percent) are dropped.

Defined cases: a null text is empty, a null language is ``und``; empty texts and languages without words give nothing. Words
and texts of any length count whole; a piece of fewer words than a phrase holds none. Repeated documents count each time.
Ties go by phrase in byte order, ties of cuts to the first. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import uuid
from functools import cache, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window as W, functions as F

from quiver.llm import textops as T
from quiver.session import materialize, ship_package, tables_dir

LONGEST = 5
THRESHOLD = 100
SHARDS = 4
BITS = 28
RANGE_BYTES = 16 << 20
_HELD = 1 << 20  # entries that a task sorts at once
_SLICE = 1 << 19  # bytes of texts that a task splits at once
_BLOCK = 1 << 16  # bytes of texts that a task hashes at once
_CHUNK = 18  # a bitmap is put together in chunks of 2 ** _CHUNK bits
_COLLECTED = 1 << 22  # names whose places (4 bytes) the driver puts together itself
_C = np.uint64(0x9FB21C651E98DF25)


class Collision(RuntimeError):
    """Two frequent phrases share a hash."""


@cache
def _byte_values(seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(value of every byte, 0 outside words; kind: 0 word, 1 blank, 2 end of a piece; powers of a place in a block; what takes a word's start back out of them)."""
    kind = np.zeros(256, np.uint8)
    kind[[9, 32]] = 1
    kind[[*b".,;:!?", *range(10, 14)]] = 2
    lower = np.arange(256, dtype=np.uint64)
    lower[65:91] += np.uint64(32)
    with np.errstate(over="ignore"):
        values = T.mix64(lower + np.uint64(1 + 1000 * seed))
        base = T.mix64(np.array([seed + 7], np.uint64))[0] | np.uint64(1)
        rising = np.cumprod(np.full(_BLOCK, base, dtype=np.uint64))
        falling = np.cumprod(np.append(np.uint64(1), np.full(_BLOCK - 1, pow(int(base), -1, 1 << 64), dtype=np.uint64)))
    values[kind > 0] = 0
    return values, kind, rising, falling


class Words(NamedTuple):
    hash: np.ndarray
    doc: np.ndarray
    together: np.ndarray  # with the next word in one piece
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of the words that lie at these places; nothing but separators lies between them."""
    values, _, rising, falling = _byte_values(seed)
    h = np.zeros(len(start), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(start):
            j = int(np.searchsorted(end, start[i] + _BLOCK, side="right"))
            if j > i:
                block = values.take(data[start[i] : end[j - 1]])
                block *= rising[: block.size]
                sums = np.cumsum(block, out=block).take(end[i:j] - start[i] - 1)  # up to the end of each word
                sums[1:] -= sums[:-1].copy()
                h[i:j] = sums * falling.take(start[i:j] - start[i])
            else:  # a word longer than a block
                j = i + 1
                power = np.uint64(1)
                for k in range(int(start[i]), int(end[i]), _BLOCK):
                    block = values.take(data[k : min(k + _BLOCK, int(end[i]))])
                    h[i] += np.sum(block * rising[: block.size], dtype=np.uint64) * power
                    power *= rising[-1]
            i = j
    return T.mix64(h)


def words_of(texts: pa.Array, seed: int) -> Words:
    data, offsets = T.utf8_parts(texts)
    kind = _byte_values(seed)[1].take(data)
    inside = kind == 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < data.size)]
    first[inner], last[inner - 1] = inside[inner], inside[inner - 1]
    at, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not at.size:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, np.zeros(0, bool), none, none, data)
    of_text = np.searchsorted(at, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(of_text))
    pieces = np.cumsum(kind == 2, dtype=np.int32).take(at)
    together = np.append(pieces[1:] == pieces[:-1], False)
    together[of_text[of_text > 0] - 1] = False
    return Words(word_hashes(data, at, end, seed), doc, together, at, end, data)


def tagged(h: np.ndarray, length: int) -> np.ndarray:
    """A phrase's name: 61 bits of its hash and its length."""
    return (h & ~np.uint64(7)) | np.uint64(length)


class Bitmap:
    """Set of names by their leading bits; never misses one."""

    def __init__(self, bits: int, data: np.ndarray) -> None:
        self.bits, self.data = bits, data

    def has(self, names: np.ndarray) -> np.ndarray:
        place = names >> np.uint64(64 - self.bits)
        return (self.data[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def phrases_in(words: Words, langs: np.ndarray, reached, longest: int, ask_last: bool = True):
    """(length, positions, names, reached here) of every phrase whose two subphrases have reached the threshold, by length.

    Without ``ask_last``, the longest ones are not looked up.
    """
    n = len(words.hash)
    raw = T.mix64(words.hash ^ langs[words.doc]) if n else words.hash
    dense = np.zeros(n, bool)
    at = np.arange(n)
    for length in range(1, longest + 1):
        if length > 1:
            both = dense[:-1] & dense[1:]
            if length == 2:
                both &= words.together[:-1]
            at = np.flatnonzero(both)
            with np.errstate(over="ignore"):
                grown = T.mix64(raw[at] * _C + words.hash[at + length - 1])
            raw = np.zeros(n, np.uint64)
            raw[at] = grown
        names = tagged(raw[at], length)
        known = reached.has(names) if reached is not None and (ask_last or length < longest) else np.zeros(len(at), bool)
        yield length, at, names, known, raw
        dense = np.zeros(n, bool)
        dense[at] = known
        if not known.any():
            return


def lang_hash(langs: list, seed: int) -> np.ndarray:
    import hashlib

    names = {v: int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8, key=str(seed).encode()).digest(), "big") for v in set(langs)}
    return np.array([names[v] for v in langs], np.uint64)


def first_of_each(names: np.ndarray) -> np.ndarray:
    """Places in sorted names at which another name begins."""
    return np.flatnonzero(np.append(True, names[1:] != names[:-1])) if names.size else np.zeros(0, np.int64)


def counted(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct names in ascending order and how often each is there."""
    names = np.sort(names)
    new = first_of_each(names)
    return names[new], np.diff(np.append(new, names.size))


def added(names: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct names in ascending order with the sums of their counts."""
    order = np.argsort(names)
    names = names[order]
    new = first_of_each(names)
    return names[new], np.add.reduceat(counts[order], new) if new.size else counts[:0]


def _batches(batches, seed: int):
    """(words, language hashes, languages) of slices of whole texts."""
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), dtype=object)
        for a, b in T.slices(batch.column(1), _SLICE):
            own = langs[a:b].tolist()
            texts = batch.column(1).slice(a, b - a)
            yield texts, words_of(texts, seed), lang_hash(own, seed), own


def _by_range(batches):
    """(range, its rows without the range) of batches whose first column is the range, sorted by it."""
    key, rows = None, []
    for batch in batches:
        for r, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if r != key and rows:
                yield key, rows
                rows = []
            key = r
            rows.append(row)
    if rows:
        yield key, rows


def _row(schema: str, *values) -> pa.RecordBatch:
    """A batch of one row of longs and binaries."""
    columns = [c.split() for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([v.tobytes() if isinstance(v, np.ndarray) else v], kinds[k]) for v, (_, k) in zip(values, columns)], [c for c, _ in columns])


_SCANNED = "range long, names binary, counts binary, many binary, times binary, n long"


def scan(docs: DataFrame, reached, young, lengths: list[int], with_words: bool, ranges: int, seed: int, light: int) -> DataFrame:
    """Counts of one shard, a row a hash range: ``n`` names with at least ``light`` occurrences (many, times) and the others (names, counts).

    ``lengths`` are those of the names in ``young``; only phrases longer by a word than one of them are counted.
    """
    width = max(1, math.ceil(math.log2(max(ranges, 2))))
    schema = "range long, names binary, counts binary"
    longest = max(lengths, default=0) + 1

    def count(batches):
        raw, size, folded = [], 0, None

        def pack(names, counts):
            counts = counts.astype(np.uint32)  # of one task
            bounds = [0, *(np.flatnonzero(np.diff(names >> np.uint64(64 - width))) + 1).tolist(), len(names)]
            parts = [(int(names[a] >> np.uint64(64 - width)), names[a:b].tobytes(), counts[a:b].tobytes()) for a, b in zip(bounds, bounds[1:])]
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in parts], k) for i, k in enumerate((pa.int64(), pa.binary(), pa.binary()))], ["range", "names", "counts"])

        def fold():
            new = counted(np.concatenate(raw)) if raw else folded
            return new if not raw or folded is None else added(*(np.concatenate(x) for x in zip(folded, new)))

        for _, words, langs, _ in _batches(batches, seed):
            recent = None
            for length, at, names, _, _ in phrases_in(words, langs, reached.value if reached else None, longest, ask_last=False):
                if length == 1:
                    chosen = names if with_words else names[:0]
                else:
                    chosen = names[recent[at] | recent[at + 1]] if recent is not None else names[:0]
                if chosen.size:
                    raw.append(chosen)
                    size += chosen.size
                recent = None
                if length in lengths:
                    recent = np.zeros(len(words.hash) + 1, bool)
                    recent[at] = young.value.has(names)
                del names
            if size > _HELD:
                folded, raw = fold(), []
                size = folded[0].size
                if size > _HELD // 2:
                    yield pack(*folded)
                    folded, size = None, 0
        if size:
            yield pack(*fold())

    def merge(batches):
        for r, rows in _by_range(batches):
            names, counts = added(np.concatenate([np.frombuffer(x, np.uint64) for x, _ in rows]), np.concatenate([np.frombuffer(x, np.uint32) for _, x in rows]).astype(np.int64))
            many = counts >= light
            small = counts[~many].astype(np.uint16 if light <= 1 << 16 else np.int64)
            yield _row(_SCANNED, r, names[~many], small, names[many], counts[many], int(many.sum()))

    partial = docs.mapInArrow(T.lean(count), schema).repartition("range").sortWithinPartitions("range")
    return materialize(partial.mapInArrow(T.lean(merge), _SCANNED))


def bitmaps_in(rows: DataFrame, pick, n: int, each: int = 16, kinds: int = 1, repeated: bool = False) -> list[Bitmap]:
    """Bitmaps of the names (uint64) in the arrays that ``pick`` takes from a batch of rows, one for each of its ``kinds`` arrays. They have
    ``each`` bits or more for each of ``n`` names, up to 2 ** ``BITS`` bits. With ``repeated`` there may be many more than ``n`` names."""
    bits = min(BITS, max(16, math.ceil(math.log2(each * max(n, 1)))))
    chunk = min(bits, _CHUNK)

    def own(batches):
        held: dict[int, list] = {}

        def out():
            for kind, arrays in held.items():
                places = np.sort(np.concatenate(arrays))
                places = places[first_of_each(places)]
                bounds = [0, *(np.flatnonzero(np.diff(places >> np.uint64(chunk))) + 1).tolist(), len(places)]
                low = (places & np.uint64((1 << chunk) - 1)).astype(np.uint32)
                parts = [(int(places[a]) >> chunk, low[a:b].tobytes()) for a, b in zip(bounds, bounds[1:]) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int64()), pa.array([kind] * len(parts), pa.int64()), pa.array([p[1] for p in parts], pa.binary())], ["chunk", "kind", "places"])

        size = 0
        for batch in batches:
            for kind, names in enumerate(pick(batch)):
                held.setdefault(kind, []).append(names >> np.uint64(64 - bits))
                size += len(names)
            if size > _HELD:
                yield from out()
                held, size = {}, 0
        yield from out()

    def joined(batches):
        key, flags = None, None
        for batch in batches:
            for c, kind, places in zip(*(x.to_pylist() for x in batch.columns)):
                if (c, kind) != key:
                    if key:
                        yield _row("chunk long, kind long, data binary", *key, np.packbits(flags, bitorder="little"))
                    key, flags = (c, kind), np.zeros(1 << chunk, bool)
                flags[np.frombuffer(places, np.uint32)] = True
        if key:
            yield _row("chunk long, kind long, data binary", *key, np.packbits(flags, bitorder="little"))

    parts = rows.mapInArrow(T.lean(own), "chunk long, kind long, places binary")
    out = [np.zeros(1 << (bits - 3), np.uint8) for _ in range(kinds)]
    if not repeated and n <= _COLLECTED:
        for c, kind, places in parts.collect():  # 4 bytes a name
            places = np.frombuffer(places, np.uint32)
            np.bitwise_or.at(out[kind], (c << (chunk - 3)) + (places >> np.uint32(3)).astype(np.int64), np.uint8(1) << (places & np.uint32(7)).astype(np.uint8))
    else:
        parts = parts.repartition("chunk").sortWithinPartitions("chunk", "kind")
        for c, kind, data in parts.mapInArrow(T.lean(joined), "chunk long, kind long, data binary").collect():  # at most 2 ** BITS bits
            out[kind][c << (chunk - 3) : (c + 1) << (chunk - 3)] = np.frombuffer(data, np.uint8)
    return [Bitmap(bits, x) for x in out]


def one_bitmap(names: DataFrame, each: int = 16, repeated: bool = False) -> Bitmap:
    """Bitmap of the only column, of longs, which may be ``repeated`` in many rows. Its size goes by an estimate of their number."""
    n = names.agg(F.approx_count_distinct(names.columns[0])).first()[0]
    small = n <= _COLLECTED
    rows = names.distinct() if repeated and small else names
    return bitmaps_in(rows, lambda batch: [batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)], n, each, repeated=not small)[0]


def bitmaps(names: DataFrame, column: str = "name", **chosen: Column) -> dict[str, Bitmap]:
    """Bitmaps of the names, one for each condition; their size follows the number of names up to 2 ** ``BITS`` bits."""
    bits = min(BITS, max(16, math.ceil(math.log2(16 * max(names.count(), 1)))))
    place = F.shiftrightunsigned(column, 64 - bits) + 1  # Spark counts positions from 1
    rows = names.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"), *[c.alias(f"is_{k}") for k, c in chosen.items()])
    found = rows.groupBy("bucket").agg(*[F.expr(f"bitmap_construct_agg(bit) FILTER (WHERE is_{k})").alias(k) for k in chosen]).collect()  # at most 2 ** BITS bits
    out = {k: np.zeros(1 << (bits - 3), np.uint8) for k in chosen}
    for r in found:
        for k, data in out.items():
            start = (r["bucket"] - 1) * 4096
            data[start : start + 4096] = np.frombuffer(r[k], np.uint8)[: max(0, data.size - start)]
    return {k: Bitmap(bits, d) for k, d in out.items()}


def _joined(column: pa.Array, kind=np.uint64) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in column.to_pylist() if x)])


def window_counts(scans: list[DataFrame], found: DataFrame | None, light: int, threshold: int, step: int, longest: int) -> DataFrame:
    """The names found so far and those with at least ``threshold`` occurrences in the scans, a row a hash range.

    A name has its largest count and its first step. ``n`` is the number of names that longer phrases can be made of, ``last1`` and so on
    the latest step of those of a length.
    """
    spark = scans[0].sparkSession
    both = reduce(DataFrame.unionByName, scans)
    viable = spark.sparkContext.broadcast(bitmaps_in(both.select("many"), lambda batch: [_joined(batch.column(0))], both.agg(F.sum("n")).first()[0] or 0)[0])
    schema = "range long, names binary, counts binary, steps binary"
    out_schema = f"{schema}, n long" + "".join(f", last{k} long" for k in range(1, longest))

    def look(batches):
        for batch in batches:
            for r, names, counts, many, times in zip(*(c.to_pylist() for c in batch.columns)):
                names, counts = np.frombuffer(names, np.uint64), np.frombuffer(counts, np.uint16 if light <= 1 << 16 else np.int64)
                own = viable.value.has(names)
                if many or own.any():
                    yield _row(schema, r, np.concatenate((np.frombuffer(many, np.uint64), names[own])), np.concatenate((np.frombuffer(times, np.int64), counts[own].astype(np.int64))), None)

    def merge(batches):
        for r, rows in _by_range(batches):
            names, f = added(*(np.concatenate([np.zeros(0, k), *(np.frombuffer(x[i], k) for x in rows if x[2] is None)]) for i, k in ((0, np.uint64), (1, np.int64))))
            names, f = names[f >= threshold], f[f >= threshold]
            steps = np.full(len(names), step, np.int32)
            for old in (x for x in rows if x[2] is not None):
                names, f, steps = (np.concatenate((x, np.frombuffer(y, x.dtype))) for x, y in zip((names, f, steps), old))
            order = np.argsort(names)
            names, f, steps = names[order], f[order], steps[order]
            new = first_of_each(names)
            if new.size:
                names, f, steps = names[new], np.maximum.reduceat(f, new), np.minimum.reduceat(steps, new)
                length = names & np.uint64(7)
                lasts = (steps[length == k] for k in range(1, longest))
                yield _row(out_schema, r, names, f, steps, int((length < longest).sum()), *(int(x.max()) if x.size else None for x in lasts))

    rows = both.select("range", "names", "counts", "many", "times").mapInArrow(T.lean(look), schema)
    if found is not None:
        rows = rows.unionByName(found.select("range", "names", "counts", "steps"))
    out = materialize(rows.repartition("range").sortWithinPartitions("range").mapInArrow(T.lean(merge), out_schema))
    viable.unpersist()
    return out


def counts_of(found: DataFrame) -> DataFrame:
    """(name, f) of the names found, a row a name."""

    def run(batches):
        for batch in batches:
            for names, f in zip(*(c.to_pylist() for c in batch.columns)):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(names, np.int64)), pa.array(np.frombuffer(f, np.int64))], ["name", "f"])

    return materialize(found.select("names", "counts").mapInArrow(T.lean(run), "name long, f long"))


def frequent(docs: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST, shards: int = SHARDS, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(name, f) of all phrases that occur at least ``threshold`` times, and the texts of ``docs`` by shard.

    ``docs`` has the columns lang and text. One row of the result is one phrase of 1 to ``longest`` words.
    """
    spark = docs.sparkSession
    ship_package(spark)
    path, seen = f"{tables_dir(spark)}/{uuid.uuid4().hex}", Observation()
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text <> ''").withColumn("shard", F.monotonically_increasing_id() % shards)
    rows.observe(seen, F.sum(F.octet_length("text")).alias("bytes")).write.partitionBy("shard").parquet(path)
    kept = spark.read.schema("lang string, text string, shard long").parquet(path)
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((seen.get.get("bytes") or 0) / RANGE_BYTES))
    light = math.ceil(threshold / shards)
    scans: list[DataFrame] = []
    found, step = None, 0
    every = recent = None
    young: list[int] = []

    def parts(since):
        """What longer phrases can be made of, and what of it was found at step ``since`` or later."""

        def pick(batch):
            names, steps = _joined(batch.column(0)), _joined(batch.column(1), np.int32)
            own = names & np.uint64(7) < np.uint64(longest)
            return names[own], names[own & (steps >= since)]

        return pick

    while True:
        own = kept.where(F.col("shard") == step % shards).select("lang", "text")
        scans.append(scan(own, every, recent, young, step < shards, ranges, seed, light))
        found = window_counts(scans[-shards:], found, light, threshold, step, longest)
        n, *lasts = found.agg(F.sum("n"), *(F.max(f"last{k}") for k in range(1, longest))).first()
        last = max((x for x in lasts if x is not None), default=-1)
        if step >= max(shards - 1, last + shards if last >= 0 else 0):
            return counts_of(found), kept
        made = bitmaps_in(found.select("names", "steps"), parts(step + 1 - shards), n or 0, kinds=2)
        for old in (every, recent):
            if old is not None:
                old.unpersist()
        young = [k for k, x in enumerate(lasts, 1) if x is not None and x >= step + 1 - shards]
        every, recent = (spark.sparkContext.broadcast(x) for x in made)
        step += 1


def phrase_texts(words: Words, at: np.ndarray, length: int) -> pa.Array:
    """The phrases at these words, lower-cased, their words joined by one space."""
    place = at[:, None] + np.arange(length)
    sizes = words.end[place] - words.start[place] + (np.arange(length) < length - 1)
    total = np.concatenate(([0], np.cumsum(sizes.sum(axis=1))))
    flat = sizes.ravel()
    inside = np.arange(int(total[-1])) - np.repeat(np.cumsum(flat) - flat, flat)
    source = np.repeat(words.start[place].ravel(), flat) + inside
    space = source == np.repeat(words.end[place].ravel(), flat)  # the place after a word stands for the space
    data = np.where(space, np.uint8(32), _LOWER[words.data[np.where(space, 0, source)]])
    return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(total.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.string())


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Met:
    """Numbers that a task has met."""

    def __init__(self) -> None:
        self.old, self.recent = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    @property
    def size(self) -> int:
        return self.old.size + self.recent.size

    def new(self, x: np.ndarray) -> np.ndarray:
        """Which of these sorted, distinct numbers come for the first time."""
        fresh = np.ones(len(x), bool)
        for known in (self.old, self.recent):
            if known.size:
                fresh &= known[np.minimum(np.searchsorted(known, x), known.size - 1)] != x
        self.recent = np.sort(np.concatenate((self.recent, x[fresh])))
        if self.recent.size > 1 << 16:  # so that the many are sorted anew for each 2 ** 16 numbers only
            self.old, self.recent = np.sort(np.concatenate((self.old, self.recent))), self.recent[:0]
        return fresh


def texts_of(found: DataFrame, docs: DataFrame, known: DataFrame | None, longest: int, seed: int, totals: bool) -> DataFrame:
    """(name, other, lang, phrase, n) of the frequent phrases in ``docs`` whose names are not among the ``known`` ones, or are
    so with another second hash ``other``. Each task names a phrase once.

    With ``totals``, rows without a name hold the number of words of a language.
    """
    context = found.sparkSession.sparkContext
    frequent_names = context.broadcast(one_bitmap(found.select("name"), 64))  # each name let in by mistake is a row with a text
    done = missing = None
    if known is not None:
        met_before = known.where("name IS NOT NULL").select("name", "both")
        done = context.broadcast(one_bitmap(met_before.select("both"), repeated=True))
        missing = context.broadcast(one_bitmap(found.join(met_before, "name", "left_anti").select("name")))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    columns = ["name", "other", "both", "lang", "phrase", "n"]

    def run(batches):
        met, total = Met(), {}
        for texts, words, langs, own in _batches(batches, seed):
            if totals:
                for lang, n in zip(own, np.bincount(words.doc, minlength=len(own)).tolist()):
                    total[lang] = total.get(lang, 0) + n
            second = word_hashes(words.data, words.start, words.end, seed + 7919)
            others = langs[words.doc]
            of_doc = np.array(own, dtype=object)
            for length, at, names, found_here, _ in phrases_in(words, langs, frequent_names.value, longest):
                at, names = at[found_here], names[found_here]
                with np.errstate(over="ignore"):
                    others[at] = other = T.mix64(others[at] * _C + second[at + length - 1])  # a longer phrase starts where a shorter one is
                    both = T.mix64(names ^ (other * np.uint64(0xD1342543DE82EF95)))
                new = np.ones(len(at), bool) if done is None else missing.value.has(names) | ~done.value.has(both)
                at, names, other, both = at[new], names[new], other[new], both[new]
                first = np.argsort(both)
                first = first[first_of_each(both[first])]
                first = first[met.new(both[first])]
                if not first.size:
                    continue
                both = both[first]
                at = at[first]
                values = [names[first].view(np.int64), other[first].view(np.int64), both.view(np.int64), of_doc[words.doc[at]].tolist(), phrase_texts(words, at, length), pa.nulls(len(at), pa.int64())]
                yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, k) for v, k in zip(values, kinds)], columns)
            if met.size > _HELD:
                met = Met()
        if total:
            empty = [pa.nulls(len(total), k) for k in kinds]
            yield pa.RecordBatch.from_arrays([*empty[:3], pa.array(list(total), pa.string()), empty[4], pa.array(list(total.values()), pa.int64())], columns)

    return materialize(docs.select("lang", "text").mapInArrow(T.lean(run), "name long, other long, both long, lang string, phrase string, n long"))


def resolved(found: DataFrame, kept: DataFrame, longest: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """((name, f, lang, phrase) of all frequent phrases, (lang, n) words of each language).

    Most texts come from two samples of the documents, so that they are not named by every task; the last scan, over all documents, names
    the rest, and every phrase that has the name of another one.
    """
    spread = F.pmod(F.xxhash64("text"), F.lit(16))
    samples = [kept.where((F.col("shard") == 0) & (spread == 0)), kept.where((F.col("shard") == 0) & (spread < 8)), kept]
    met = None
    for k, docs in enumerate(samples):
        own = texts_of(found, docs, met, longest, seed, totals=k == len(samples) - 1)
        met = own if met is None else met.unionByName(own)
    said = met.where("name IS NOT NULL").groupBy("name").agg(F.min("other").alias("other"), F.max("other").alias("other2"), F.min(F.struct("lang", "phrase")).alias("said"))
    said = materialize(said.join(found, "name").select("name", "f", "said.lang", "said.phrase", (F.col("other") != F.col("other2")).alias("shared")))
    if not said.where("shared").isEmpty():
        raise Collision(f"two frequent phrases share a hash of seed {seed}")
    return said.drop("shared"), met.where("name IS NULL").groupBy("lang").agg(F.sum("n").alias("n"))


def parts_of(said: DataFrame, longest: int, seed: int) -> DataFrame:
    """(name, lang, phrase, a, cuts, inner) of phrases of at least two words: the names of both sides of each cut, and of all shorter ones inside."""

    def run(batches):
        for batch in batches:
            words = words_of(batch.column(2), seed)
            langs = lang_hash(batch.column(1).to_pylist(), seed)
            n = np.bincount(words.doc, minlength=len(batch))
            first = np.cumsum(n) - n
            raws = [T.mix64(words.hash ^ langs[words.doc])]
            with np.errstate(over="ignore"):
                for length in range(2, longest + 1):
                    following = words.hash[np.minimum(np.arange(len(words.hash)) + length - 1, len(words.hash) - 1)]
                    raws.append(T.mix64(raws[-1] * _C + following))
            for length in range(2, longest + 1):
                rows = np.flatnonzero(n == length)
                if not rows.size:
                    continue
                name = lambda m, o: tagged(raws[m - 1][first[rows] + o], m).view(np.int64)  # noqa: B023, E731
                cuts = np.stack([x for j in range(1, length) for x in (name(j, 0), name(length - j, j))], axis=1)
                inside = [name(m, o) for m in range(2, length) for o in range(length - m + 1)]
                inner = np.stack(inside, axis=1) if inside else np.zeros((len(rows), 0), np.int64)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel())) for x in (cuts, inner)]
                own = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*own.columns, *lists], ["name", "lang", "phrase", "a", "cuts", "inner"])

    rows = said.where(F.pmod("name", F.lit(8)) > 1).select("name", "lang", "phrase", F.col("f").alias("a"))
    return materialize(rows.mapInArrow(run, "name long, lang string, phrase string, a long, cuts array<long>, inner array<long>"))


def scored(docs: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST, absorb: int = 100, shards: int = SHARDS, seed: int = 1) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of all candidates of 2 to ``longest`` words that no longer one absorbs."""
    found, kept = frequent(docs, threshold, longest, shards, seed)
    said, totals = resolved(found, kept, longest, seed)
    many = parts_of(said, longest, seed)
    longer = many.select("a", F.explode("inner").alias("name")).groupBy("name").agg(F.max("a").alias("longer"))
    rest = many.join(longer, "name", "left").where(F.coalesce(F.lit(100) * F.col("longer") < F.lit(absorb) * F.col("a"), F.lit(True)))
    each = rest.join(totals, "lang").select("name", "lang", "phrase", "a", "n", F.posexplode(F.transform(F.sequence(F.lit(0), (F.size("cuts") / 2 - 1).cast("int")), lambda k: F.struct(F.get("cuts", (2 * k).cast("int")).alias("left"), F.get("cuts", (2 * k + 1).cast("int")).alias("right")))).alias("k", "cut"))
    left, right = found.select(F.col("name").alias("left"), F.col("f").alias("l")), found.select(F.col("name").alias("right"), F.col("f").alias("r"))
    each = each.select("name", "lang", "phrase", "a", "n", "k", "cut.left", "cut.right").join(left, "left").join(right, "right")
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    each = each.withColumn("product", F.lit(1000).cast("decimal(38,0)") * wide("a") * wide("n")).withColumn("parts", wide("l") * wide("r"))
    least = each.groupBy("name").agg(F.min(F.struct(F.expr("product div parts").alias("score"), "k", "l", "r")).alias("cut"), *[F.first(c).alias(c) for c in ("lang", "phrase", "a", "n")])
    return least.select("lang", "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").alias("score"))


def top_phrases(docs: DataFrame, top: int = 2000, **how) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases by score, count and phrase."""
    for seed in range(1, 6):
        try:
            rows = scored(docs, seed=seed, **how)
            break
        except Collision:
            if seed == 5:
                raise
    # Spark keeps the first ``top`` of every task before the shuffle, so a large language is no large group
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase")))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_itemset_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_phrases(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


SQL = """WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, list_filter(string_split_regex(p, '[ \\t]+'), lambda w: w <> '') AS ws FROM (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS p FROM docs)),
total AS (SELECT lang, CAST(sum(len(ws)) AS HUGEINT) AS n FROM pieces GROUP BY lang),
grams AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM pieces, range(1, 6) t(k))),
f AS (SELECT lang, k, phrase, CAST(count(*) AS HUGEINT) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
cand AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, f AS a FROM f WHERE k > 1),
inside AS (SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, ws, a, k, m, unnest(range(1, k - m + 2)) AS i FROM cand, range(2, 5) t(m) WHERE m < k) GROUP BY ALL),
cuts AS (SELECT c.lang, c.phrase, c.a, t.n, j, l.f AS l, r.f AS r, (1000 * c.a * t.n) // (l.f * r.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM cand) c JOIN total t USING (lang)
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:j], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[j + 1:], ' ')
  LEFT JOIN inside i ON i.lang = c.lang AND i.phrase = c.phrase WHERE i.longer IS NULL OR i.longer < c.a),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS o FROM cuts) WHERE o = 1)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best) WHERE rank <= 2000"""
