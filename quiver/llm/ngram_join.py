"""N-gram Jaccard join with token-combination prefixes.

Two documents link when the Jaccard similarity of their sets of ``size``-word shingles reaches
``num/den``. The join returns one row per document with the smallest doc_id reachable by links.

Method. Tokens (shingles) are ordered by document frequency, rarest first. Linked sets miss at most
e = n - ceil(t n) tokens of each other, so a prefix that cannot lose all its signatures with e misses
must share a signature. Tokens held by at most ``frequent`` documents form the rare class and are
signatures by themselves; more frequent tokens form the frequent class, whose signatures are pairs of
tokens, and the prefix is extended until (rare tokens) + max(0, frequent tokens - 1) = e + 1. Tokens
held by one document come first in the order and match nothing, so a document with e + 1 of them gives
no signature at all and is known to be alone. Pairs of long prefixes grow with the square of the
length, so sets of more than ``pair_limit`` tokens use single tokens in both classes; sets between
t * pair_limit and pair_limit give both kinds, so that every two sets within reach of each other have
one kind in common. A set of one token links only with an equal set, and equal sets are merged first.

Plan. (1) Each task cuts its documents into chunks and sends every chunk's distinct tokens, sorted and
delta-coded, to hash ranges; a range answers with the tokens that more than one document holds and
their exact frequency. No token of a hot passage is sent more than once a chunk. (2) Each chunk turns
the answers into prefixes: a small part of the documents remains. (3) Equal sets collapse to the
smallest doc_id. (4) Every signature hangs its documents on the smallest one (linear in rows, no
pairs), components of these hangings are candidate clusters. (5) Clusters are verified exactly in
blocks: a large cluster is first compared with one block of pivots, and only documents that are not
yet in its largest component meet the other blocks; a block pair is one task's matrix product over
shared tokens, and gives spanning links only. (6) Components of the links are the result.

Tokens are 64-bit hashes; shared tokens are told apart by 40 bits within a range.

Defined cases: a null or empty text, or one without words, has the empty set (n_shingles 0) and links
with nothing; one with fewer than ``size`` words has its whole word sequence as one shingle. A repeated
row gives a row of its own with the same component. A doc_id that stands for different texts stands in
the links for all of them. A row with a null doc_id has the component of its equal sets, and a null one
if no other row has its set. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from quiver.llm import textops as T
from quiver.llm.graph import components, local_components
from quiver.llm.phrases import bitmaps
from quiver.session import materialize, ship_package, small_batches

LOW_BITS = 40
LOW_MASK = T.U64((1 << LOW_BITS) - 1)
CHUNK_TOKENS = 1 << 19
SLICE_BYTES = 1 << 18  # of text cut into shingles at once
CHUNK_DOCS = 60_000
BLOCK_DOCS = 384

_MESSAGE = "range int, chunk long, kind int, payload binary"


def _pack(*arrays: np.ndarray) -> bytes:
    planes = [(a.dtype.str, a.size, a.view(np.uint8).reshape(a.size, a.itemsize).T.tobytes() if a.size else b"") for a in map(np.ascontiguousarray, arrays)]
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(planes))


def _unpack(payload: bytes) -> list[np.ndarray]:
    out = []
    for kind, size, data in pickle.loads(zstandard.ZstdDecompressor().decompress(payload)):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, size).T).view(kind).ravel() if size else np.zeros(0, kind))
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    r, c, k, p = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(c, pa.int64()), pa.array(k, pa.int32()), pa.array(p, pa.binary())], ["range", "chunk", "kind", "payload"])


def _send(ranges: int, size: int):
    """Texts to messages: kind 1 asks a range about a chunk's tokens, kind 0 is what the chunk keeps."""

    def flush(chunk: int, ids, null, tokens, sizes):
        token = np.concatenate(tokens) if tokens else np.zeros(0, T.U64)
        tokens.clear()
        n = np.concatenate(sizes)
        doc = np.repeat(np.arange(len(n), dtype=np.uint16), n)
        mixed = T.mix64(token)
        first = T.segment_sum(mixed, n)
        with np.errstate(over="ignore"):
            second = T.segment_sum(T.mix64(mixed ^ T.U64(0x5851F42D4C957F2D)), n)
        del mixed
        key = token >> T.U64(32)
        key *= T.U64(ranges)
        key >>= T.U64(32)
        key <<= T.U64(LOW_BITS)
        token &= LOW_MASK
        key |= token
        del token
        order = np.argsort(key, kind="stable")
        key, doc = key[order], doc[order]
        del order
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if key.size else np.zeros(0, np.int64)
        counts = np.diff(np.append(new, key.size)).astype(np.uint16)
        unique, single = key[new], counts == 1
        bounds = np.searchsorted(unique, np.arange(ranges + 1, dtype=T.U64) << T.U64(LOW_BITS))
        # documents of tokens that the chunk holds more than once: kept here, the range needs only their number
        several = doc[np.repeat(~single, counts)]
        ends = np.concatenate(([0], np.cumsum(np.where(single, 0, counts).astype(np.int64))))[bounds]
        kept = _pack(np.concatenate(ids), np.concatenate(null), n.astype(np.uint32), first, second, several, ends)
        yield _batch([(chunk % ranges, chunk, 0, kept)])
        holder = doc[new]
        for a in range(0, ranges, 32):
            rows = []
            for r in range(a, min(a + 32, ranges)):
                own = slice(bounds[r], bounds[r + 1])
                low = unique[own] & LOW_MASK
                if low.size:
                    rows.append((r, chunk, 1, _pack(np.diff(low, prepend=T.U64(0)), counts[own], holder[own][single[own]])))
            if rows:
                yield _batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = (TaskContext.get().partitionId() << 32) + 1
        ids, null, tokens, sizes, docs, held = [], [], [], [], 0, 0
        for batch in batches:
            for a, b in T.slices(batch.column(1), SLICE_BYTES):
                for c in range(a, b, CHUNK_DOCS):
                    part = batch.slice(c, min(b, c + CHUNK_DOCS) - c)
                    if docs and (held > CHUNK_TOKENS or docs + len(part) > CHUNK_DOCS):
                        yield from flush(chunk, ids, null, tokens, sizes)
                        T.give_back()
                        chunk, ids, null, tokens, sizes, docs, held = chunk + 1, [], [], [], [], 0, 0
                    h, per_doc = T.shingle_table(T.word_table(part.column(1)), size)
                    h, _, n = T.distinct_per_doc(np.repeat(np.arange(len(part)), per_doc), h, len(part))
                    ids.append(part.column(0).fill_null(0).to_numpy(zero_copy_only=False))
                    null.append(part.column(0).is_null().to_numpy(zero_copy_only=False))
                    tokens.append(h)
                    sizes.append(n)
                    docs += len(part)
                    held += h.size
        if docs:
            yield from flush(chunk, ids, null, tokens, sizes)

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range: which tokens of each chunk are held by more than one document, and by how many."""
    place, chunks, lows, counts, holders = None, [], [], [], []
    for batch in batches:
        for r, c, kind, payload in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if kind == 0:
                yield _batch([(r, c, 0, payload)])
                continue
            place = r
            delta, count, holder = _unpack(payload)
            chunks.append(c)
            lows.append(np.cumsum(delta, dtype=T.U64))
            counts.append(count)
            holders.append(holder)
    if not chunks:
        return
    low = np.concatenate(lows)
    order = np.argsort(low, kind="stable")
    ordered = low[order]
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    total = np.add.reduceat(np.concatenate(counts).astype(np.int64)[order], starts)
    df = np.empty(low.size, np.int64)
    df[order] = np.repeat(total, np.diff(np.append(starts, low.size)))
    at = 0
    for c, values, count, holder in zip(chunks, lows, counts, holders):
        own = df[at : at + values.size]
        at += values.size
        hits = own > 1
        if hits.any():
            yield _batch([(place, c, 1, _pack(np.diff(values[hits], prepend=T.U64(0)), own[hits].astype(np.uint64), count[hits], holder[hits[count == 1]]))])


def allowed_misses(n: int, num: int, den: int) -> int:
    """Tokens of a set of n that a linked set may miss."""
    return n - -(-num * n // den)


def signatures(n: int, tokens: np.ndarray, df: np.ndarray, num: int, den: int, frequent: int, pair_limit: int) -> np.ndarray | None:
    """Signatures of a set of ``n`` tokens of which ``tokens`` (rarest first) occur elsewhere; None: it has no link."""
    need = allowed_misses(n, num, den) + 1 - (n - len(tokens))
    if n == 0 or need <= 0:
        return None
    rare = int(np.searchsorted(df, frequent, side="right"))
    singles = T.mix64(tokens ^ T.U64(0xA0761D6478BD642F))
    out = [singles[: min(need, rare)]]
    if need > rare:
        if den * n >= num * pair_limit:
            out.append(singles[rare:need])
        if n <= pair_limit:
            top = tokens[rare : need + 1]
            i, j = np.triu_indices(len(top), 1)
            low, high = np.minimum(top[i], top[j]), np.maximum(top[i], top[j])
            with np.errstate(over="ignore"):
                out.append(T.mix64(T.mix64(low) * T.U64(0xE7037ED1A0B428DB) + high))
    return np.concatenate(out)


def _prefixes(num: int, den: int, frequent: int, pair_limit: int):
    """Messages of whole chunks to rows (doc_id, n_shingles, set1, set2, tokens, sigs)."""
    names = ["doc_id", "n_shingles", "set1", "set2", "tokens", "sigs"]

    def chunk_rows(kept, answers):
        ids, null, n, first, second, several, ends = kept
        token, owner, freq = [], [], []
        for r, delta, df, count, holder in answers:
            low = (T.U64(r) << T.U64(LOW_BITS)) | np.cumsum(delta, dtype=T.U64)
            one = count == 1
            token += [low[one], np.repeat(low[~one], count[~one])]
            freq += [df[one], np.repeat(df[~one], count[~one])]
            owner += [holder, several[ends[r] : ends[r + 1]]]
        token = np.concatenate(token) if token else np.zeros(0, T.U64)
        owner = np.concatenate(owner) if owner else np.zeros(0, np.uint16)
        freq = np.concatenate(freq).astype(np.int64) if freq else np.zeros(0, np.int64)
        order = np.lexsort((token, freq, owner))
        token, owner, freq = token[order], owner[order], freq[order]
        limits = np.searchsorted(owner, np.arange(len(n) + 1))
        rows, size = [], 0
        for i in range(len(n)):
            a, b = limits[i], limits[i + 1]
            own = token[a:b]
            sigs = signatures(int(n[i]), own, freq[a:b], num, den, frequent, pair_limit)
            who = None if null[i] else int(ids[i])
            if sigs is None:
                rows.append((who, int(n[i]), None, None, None, None))
            else:
                s1, s2 = (int(x) for x in np.array([first[i], second[i]]).view(np.int64))
                rows.append((who, int(n[i]), s1, s2, np.sort(own).tobytes(), sigs.view(np.int64)))
                size += own.size + sigs.size
            if size > 1 << 19 or len(rows) >= 8192:
                yield table(rows)
                rows, size = [], 0
        if rows:
            yield table(rows)

    def table(rows):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def run(batches):
        current, kept, answers = None, None, []
        for batch in batches:
            for r, c, kind, payload in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if kind == 0:
                    if kept is not None:
                        yield from chunk_rows(kept, answers)
                    current, kept, answers = c, _unpack(payload), []
                else:
                    assert c == current
                    answers.append((r, *_unpack(payload)))
        if kept is not None:
            yield from chunk_rows(kept, answers)

    return run


def _spanning(n: np.ndarray, tokens: list[np.ndarray], num: int, den: int, left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning links of the documents of one block pair; ``left``: only links that touch these documents."""
    m = len(n)
    flat = np.concatenate(tokens)
    owner = np.repeat(np.arange(m), [t.size for t in tokens])
    values, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    keep = count[column] > 1
    owner, column = owner[keep], np.unique(column[keep], return_inverse=True)[1] if keep.any() else np.zeros(0, np.int64)
    common = np.zeros((m, m), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = int(column[-1]) + 1 if column.size else 0
    step = 4096
    for a in range(0, width, step):
        i, j = np.searchsorted(column, [a, a + step])
        part = np.zeros((m, min(step, width - a)), np.float32)
        part[owner[i:j], column[i:j] - a] = 1
        common += part @ part.T
    sizes = n.astype(np.int64)
    inter = common.astype(np.int64)
    linked = den * inter >= num * (sizes[:, None] + sizes[None, :] - inter)
    np.fill_diagonal(linked, False)
    if left is not None:
        linked &= left[:, None] | left[None, :]
    edges, free = [], np.ones(m, bool)
    for root in range(m):
        if not free[root]:
            continue
        free[root] = False
        front = [root]
        while front:
            u = front.pop()
            reach = np.flatnonzero(linked[u] & free)
            free[reach] = False
            edges += [(u, int(v)) for v in reach]
            front += reach.tolist()
    return edges


def _group_links(group: list, num: int, den: int) -> list[tuple[int, int]]:
    """Spanning links of rows (doc_id, n, tokens, open)."""
    if len(group) < 2 or not any(opened for *_, opened in group):
        return []
    n, left = np.array([r[1] for r in group]), np.array([r[3] for r in group])
    edges = _spanning(n, [np.frombuffer(r[2], T.U64) for r in group], num, den, left)
    return [(group[a][0], group[b][0]) for a, b in edges]


def _groups(batches, width: int):
    """Runs of sorted rows with the same first ``width`` columns: the other columns of each row."""
    key, group = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:width] != key:
                if group:
                    yield group
                key, group = row[:width], []
            group.append(row[width:])
    if group:
        yield group


def _block_pairs(num: int, den: int):
    """Sorted rows (cluster, i, j, doc_id, n, tokens, open) to the spanning links of every block pair."""

    def run(batches):
        out = []
        for group in _groups(batches, 3):
            out += _group_links(group, num, den)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["a", "b"])

    return run


def _whole_clusters(num: int, den: int):
    """Sorted rows (cluster, doc_id, n, tokens, open) to (node, component) of every linked document."""

    def run(batches):
        nodes, low = [], []
        for group in _groups(batches, 1):
            links = _group_links(group, num, den)
            if links:
                found = local_components(*(np.array(x, np.int64) for x in zip(*links)))
                nodes.append(found[0])
                low.append(found[1])
            if len(nodes) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(low))], ["node", "component"])
                nodes, low = [], []
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(low))], ["node", "component"])

    return run


def _block_links(rows: DataFrame, pairs, num: int, den: int) -> DataFrame:
    """Links of the block pairs that ``pairs`` (array of struct(i, j)) sends each row to."""
    dealt = rows.select("cluster", F.explode(pairs).alias("p"), "doc_id", "n_shingles", "tokens", "open")
    dealt = dealt.select("cluster", "p.i", "p.j", "doc_id", "n_shingles", "tokens", "open")
    dealt = dealt.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    return dealt.mapInArrow(T.lean(_block_pairs(num, den)), "a long, b long")


def verified_components(sets: DataFrame, clusters: DataFrame, num: int, den: int, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(node, component) of every document that links with another.

    sets: (doc_id, n_shingles, tokens); clusters: (node, component), the candidate clusters. Clusters of one
    block are settled by one task. Larger ones first meet a block of pivots; then the documents outside the
    largest component found so far meet all blocks.
    """
    counts = clusters.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    blocks = F.ceil(F.col("members") / block_docs).cast("int")
    dealt = clusters.join(counts, "component").withColumn("blocks", blocks)
    dealt = materialize(dealt.select(F.col("component").alias("cluster"), F.col("node").alias("doc_id"), "blocks", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block")))
    small = dealt.where("blocks = 1").select("cluster", "doc_id").join(sets, "doc_id").select("cluster", "doc_id", "n_shingles", "tokens", F.lit(True).alias("open"))
    settled = small.repartition("cluster").sortWithinPartitions("cluster").mapInArrow(T.lean(_whole_clusters(num, den)), "node long, component long")
    large = dealt.where("blocks > 1")
    if large.isEmpty():
        return settled
    large = materialize(large.join(sets, "doc_id"))
    pivots = F.when(F.col("block") == 0, F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.lit(0).alias("i"), b.alias("j")))) \
        .otherwise(F.array(F.struct(F.lit(0).alias("i"), F.col("block").alias("j"))))
    first = materialize(_block_links(large.withColumn("open", F.col("block") == 0), pivots, num, den))
    named = large.select("cluster", "doc_id", "blocks", "block").join(components(first), F.col("doc_id") == F.col("node"), "left")
    named = materialize(named.select("cluster", "doc_id", "blocks", "block", F.coalesce("component", "doc_id").alias("component")))
    biggest = named.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("n")) \
        .groupBy("cluster").agg(F.max_by("component", F.struct("n", "component")).alias("biggest"), (F.sum("n") - F.max("n")).alias("opened"))
    rest = named.join(biggest, "cluster").withColumn("rows", F.ceil(F.col("opened") / block_docs).cast("int")).where("rows > 0")
    rest = rest.withColumn("open", F.col("component") != F.col("biggest")).drop("component", "biggest", "opened")
    # open documents are dealt to their own blocks (rows i) and meet every block (columns j) of the cluster
    rest = rest.withColumn("row", F.pmod(F.xxhash64("doc_id", F.lit(7)), "rows").cast("int"))
    rest = rest.join(large.select("doc_id", "n_shingles", "tokens"), "doc_id")
    down = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda r: F.struct(r.alias("i"), F.col("block").alias("j")))
    across = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.col("row").alias("i"), b.alias("j")))
    second = _block_links(rest, F.when(F.col("open"), F.array_union(across, down)).otherwise(down), num, den)
    return settled.unionByName(components(first.unionByName(second)))


def jaccard_components(docs: DataFrame, size: int = 4, num: int = 85, den: int = 100, frequent: int = 64, pair_limit: int = 400) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    ship_package(spark)
    small_batches(spark)
    ranges = max(128, int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sent = docs.mapInArrow(T.lean(_send(ranges, size)), _MESSAGE)
    answered = sent.repartitionById(ranges, F.col("range")).mapInArrow(T.lean(_answer), _MESSAGE)
    by_chunk = answered.repartition("chunk").sortWithinPartitions("chunk", "kind", "range")
    rows = by_chunk.mapInArrow(T.lean(_prefixes(num, den, frequent, pair_limit)),
                               "doc_id long, n_shingles long, set1 long, set2 long, tokens binary, sigs array<long>")
    rows = materialize(rows)
    suspects = rows.where("set1 IS NOT NULL")
    classes = materialize(suspects.groupBy("set1", "set2", "n_shingles").agg(F.min("doc_id").alias("first")))
    firsts = classes.where("first IS NOT NULL").select(F.col("first").alias("doc_id"))
    hung = materialize(suspects.select("doc_id", "sigs").join(firsts, "doc_id", "left_semi")).select(F.explode("sigs").alias("sig"), "doc_id")
    shared = hung.groupBy("sig").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    edges = hung.join(shared, "sig").where("doc_id != low").select(F.col("low").alias("a"), F.col("doc_id").alias("b"))
    found = materialize(verified_components(suspects.select("doc_id", "n_shingles", "tokens"), materialize(components(edges)), num, den))
    known = suspects.select("doc_id", "set1", "set2", "n_shingles").join(classes, ["set1", "set2", "n_shingles"])
    known = known.join(found, F.col("first") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "first").alias("component_id"))
    alone = rows.where("set1 IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return known.unionByName(alone)


def one_of_each(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs``, all columns, that have the smallest doc_id of their group of near copies.

    Of repeated rows one stays; rows with a null doc_id are kept, as nothing names them.
    """
    spark = docs.sparkSession
    found = materialize(jaccard_components(docs, size, num, den))
    stay = materialize(found.where("doc_id = component_id").groupBy(F.col("doc_id").alias("_stay")).agg(F.count(F.lit(1)).alias("_rows")))
    # texts move only for ids that go or have several rows, and the few others that share a bit with these
    doubtful = found.where("doc_id <> component_id").select("doc_id").unionByName(stay.where("_rows > 1").select(F.col("_stay").alias("doc_id")))
    shared = spark.sparkContext.broadcast(bitmaps(doubtful.select(F.xxhash64("doc_id").alias("name")).distinct(), all=F.lit(True))["all"])
    named = docs.withColumn("_hash_of_id", F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.col("doc_id").cast("long"))))

    def picked(wanted: bool) -> DataFrame:
        def run(batches):
            for batch in batches:
                names = batch.column(batch.num_columns - 1)
                hit = shared.value.has(names.fill_null(0).to_numpy().view(np.uint64)) & names.is_valid().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(batch.columns[:-1], batch.schema.names[:-1]).filter(pa.array(hit == wanted))

        return named.mapInArrow(T.lean(run), docs.schema)

    checked = picked(True).join(stay, F.col("doc_id").cast("long") == F.col("_stay"), "left_semi").dropDuplicates(["doc_id", "text"])
    return picked(False).unionByName(checked)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS shingle
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, node) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, b.y FROM reach r JOIN both_ways b ON b.x = r.node),
low AS (SELECT doc_id, min(node) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, low.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN low USING (doc_id)
"""
