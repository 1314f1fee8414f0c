"""Training-order materialisation: token sequences in keyed random order, as fixed-stride binary shards.

1. Every task encodes its documents (text, then an end id), joins them to one stream and cuts it into
   sequences of ``length`` ids; only the last of a task may be shorter. The sequences are written once,
   compressed, to the shared checkpoint folder; they number 0 .. N-1 by task and place.
2. A keyed Feistel permutation of the smallest even-bit domain that holds N, walked along its cycle until it
   falls below N, gives every sequence its slot: a bijection of 0 .. N-1 that needs no table.
3. Slots are cut into ranges of ``records`` sequences; each range is one task, which sorts its records and
   writes them as one file. Tasks send a range all its records in one compressed message.
4. A record has always the same number of bytes: slot, doc_id and place of its first id, ids used, the ids
   (unsigned 16-bit, little endian, 0 after the last), and a newline. A reader can start at any slot:
   file slot // records, byte (slot % records) * stride. Spark's text writer stores the bytes as they are.

Defined cases: a null or empty text is the end id alone. A null doc_id is stored as -1 and read as null.
Repeated rows are documents of their own. An empty table gives no files and an empty result. Extra columns
are ignored. The vocabulary must have at most 65,536 ids.
"""

from __future__ import annotations

import pickle
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from quiver.llm import textops as T, tokens as K
from quiver.session import checkpoint_dir, materialize, ship_package

LENGTH = 1024
RECORDS = 1 << 13
_DIGEST = "shard int, slot long, doc_id long, start long, length long, ids_crc32 long"
_BLOB_RECORDS = 512
_MESSAGE_RECORDS = 8192


def record_type(length: int) -> np.dtype:
    return np.dtype([("slot", "<u8"), ("doc_id", "<i8"), ("start", "<u4"), ("used", "<u2"), ("ids", "<u2", (length,)), ("end", "u1")])


def _squeeze(**arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(arrays))


def _swell(blob: bytes) -> dict[str, np.ndarray]:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def feistel(index: np.ndarray, n: int, key: int, rounds: int = 4) -> np.ndarray:
    """Keyed bijection of 0 .. n-1: a balanced Feistel network with cycle-walking."""
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    mask = T.U64((1 << half) - 1)

    def once(x):
        left, right = x >> T.U64(half), x & mask
        for r in range(rounds):
            f = T.mix64(right ^ T.mix64(np.full(1, (key + r * 0x9E3779B97F4A7C15) & (2**64 - 1), T.U64)))
            left, right = right, left ^ (f & mask)
        return (left << T.U64(half)) | right

    out = once(index.astype(T.U64))
    while True:
        outside = np.flatnonzero(out >= T.U64(n))
        if not outside.size:
            return out.astype(np.int64)
        out[outside] = once(out[outside])


def sequences(docs: DataFrame, vocabulary: str, length: int = LENGTH, end_id: int = 50256) -> DataFrame:
    """(task, first, n, blob): compressed runs of sequences of every task."""
    spark = docs.sparkSession
    ship_package(spark)
    name = K.ship_vocabulary(spark, vocabulary)

    def run(batches):
        encoder, task = K.Encoder.of(name), TaskContext.get().partitionId()
        ids, owner, start, held, written = [], [], [], 0, 0

        def cut(last: bool):
            nonlocal ids, owner, start, held, written
            flat, own, at = np.concatenate(ids), np.concatenate(owner), np.concatenate(start)
            full = len(flat) // length
            n = full + (last and len(flat) % length > 0)
            for a in range(0, n, _BLOB_RECORDS):
                b = min(n, a + _BLOB_RECORDS)
                heads = np.arange(a, b) * length
                part = np.zeros((b - a) * length, np.uint16)
                piece = flat[a * length : b * length]
                part[: len(piece)] = piece
                used = np.minimum(len(flat) - heads, length)
                blob = _squeeze(ids=part.reshape(b - a, length), doc_id=own[heads], start=at[heads], used=used.astype(np.uint16))
                yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([written + a], pa.int64()), pa.array([b - a], pa.int64()), pa.array([blob], pa.binary())], ["task", "first", "n", "blob"])
            written += n
            rest = full * length
            ids, owner, start, held = [flat[rest:]], [own[rest:]], [at[rest:]], len(flat) - rest

        for batch in batches:
            for a, b in T.slices(batch.column(1)):
                keys = batch.column(0).slice(a, b - a).fill_null(-1).to_numpy(zero_copy_only=False)
                for doc_id, own in zip(keys, K.encoded(encoder, batch.column(1).slice(a, b - a), end_id)):
                    ids.append(own.astype(np.uint16))
                    owner.append(np.full(len(own), doc_id, np.int64))
                    start.append(np.arange(len(own), dtype=np.uint32))
                    held += len(own)
                if held >= _BLOB_RECORDS * length:
                    yield from cut(False)
        if held:
            yield from cut(True)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "task int, first long, n long, blob binary")


def write_shards(docs: DataFrame, path: str, vocabulary: str, key: int = 20240501, length: int = LENGTH, records: int = RECORDS) -> int:
    """Write all sequences of ``docs`` under ``path``; returns their number."""
    spark = docs.sparkSession
    blobs = materialize(sequences(docs, vocabulary, length))
    counts = {r["task"]: r["n"] for r in blobs.groupBy("task").agg(F.sum("n").alias("n")).collect()}  # one number a task
    total, base = 0, {}
    for task in sorted(counts):
        base[task] = total
        total += counts[task]
    if not total:
        return 0
    base = spark.sparkContext.broadcast(base)
    shards = -(-total // records)
    kind = record_type(length)

    def deal(batches):
        held, size = [], 0

        def messages():
            x = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
            shard = x["slot"] // records
            order = np.argsort(shard, kind="stable")
            cuts = np.append(np.flatnonzero(np.append(True, np.diff(shard[order]) != 0)), len(order))
            for a, b in zip(cuts, cuts[1:]):
                own = order[a:b]
                yield pa.RecordBatch.from_arrays([pa.array([int(shard[own[0]])], pa.int32()), pa.array([_squeeze(**{k: v[own] for k, v in x.items()})], pa.binary())], ["shard", "blob"])

        for batch in batches:
            for task, first, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                x = _swell(blob)
                held.append({"slot": feistel(base.value[task] + first + np.arange(len(x["doc_id"])), total, key), **x})
                size += len(x["doc_id"])
                if size >= _MESSAGE_RECORDS:
                    yield from messages()
                    held, size = [], 0
        if held:
            yield from messages()

    def lay(batches):
        parts = [_swell(b) for batch in batches for b in batch.column(1).to_pylist()]
        if not parts:
            return
        x = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        order = np.argsort(x["slot"])
        for a in range(0, len(order), 1024):
            o = order[a : a + 1024]
            out = np.zeros(len(o), kind)
            for k in ("slot", "doc_id", "start", "used", "ids"):
                out[k] = x[k][o]
            out["end"] = 10
            raw = out.tobytes()
            # the writer adds the newline that ends a record
            yield pa.RecordBatch.from_arrays([pa.array([raw[i : i + kind.itemsize - 1] for i in range(0, len(raw), kind.itemsize)], pa.binary())], ["value"])

    dealt = blobs.select("task", "first", "blob").mapInArrow(deal, "shard int, blob binary").repartitionById(shards, F.col("shard"))
    dealt.mapInArrow(lay, "value binary").select(F.col("value").cast("string")).write.text(path)
    return total


def read_shards(spark: SparkSession, path: str, length: int = LENGTH, from_slot: int = 0, digest: bool = False) -> DataFrame:
    """(shard, slot, doc_id, start, length, ids) of every record from ``from_slot`` on, in slot order within a shard;
    with ``digest`` the crc32 of the ids' bytes (ids_crc32) in place of the ids."""
    kind = record_type(length)
    names = ["shard", "slot", "doc_id", "start", "length", "ids_crc32" if digest else "ids"]
    last = (lambda raws: pa.array([zlib.crc32(r) for r in raws], pa.int64())) if digest else (lambda raws: pa.array(list(raws), pa.binary()))

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                assert len(content) % kind.itemsize == 0
                shard = int(name.rsplit("/part-", 1)[1].split("-")[0])
                x = np.frombuffer(content, kind)
                x = x[x["slot"] >= from_slot]
                for a in range(0, len(x), 1024):
                    y = x[a : a + 1024]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(y), shard, np.int32)), pa.array(y["slot"].astype(np.int64)),
                        pa.array(y["doc_id"], mask=y["doc_id"] == -1), pa.array(y["start"].astype(np.int64)), pa.array(y["used"].astype(np.int64)),
                        last(i[:n].tobytes() for i, n in zip(y["ids"], y["used"]))], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(run, _DIGEST if digest else "shard int, slot long, doc_id long, start long, length long, ids binary")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of all documents, written and read back: a row a sequence with the crc32 of its 16-bit ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = f"{checkpoint_dir(spark).rstrip('/')}/token-shards/{uuid.uuid4().hex}"
    if not write_shards(docs, path, default_vocabulary()):
        return spark.createDataFrame([], _DIGEST)
    return read_shards(spark, path, digest=True)
