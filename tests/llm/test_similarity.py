"""N-gram Jaccard join, I-Match fingerprints, connected components, text helpers."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from edge_fixtures import edge_docs, empty_docs, sentence  # noqa: F401
from quiver.llm import graph, imatch, ngram_join as N, textops as T
from quiver.llm.registry import QUERIES


def shingle_sets(docs, size):
    """Brute force: row number to set of word tuples."""
    out = []
    for _, text in docs:
        w = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
        out.append(frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    return out


def brute_components(docs, size=4, num=85, den=100):
    """(doc_id, n_shingles, component_id) per row, all pairs compared."""
    sets = shingle_sets(docs, size)
    top = list(range(len(docs)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(docs)):
        for b in range(a + 1, len(docs)):
            common = len(sets[a] & sets[b])
            if (common and den * common >= num * (len(sets[a]) + len(sets[b]) - common)) or (docs[a][0] is not None and docs[a][0] == docs[b][0] and docs[a][1] == docs[b][1]):
                top[find(b)] = find(a)
    low = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            r = find(i)
            low[r] = min(low.get(r, d), d)
    return sorted(((d, len(s), low.get(find(i))) for i, ((d, _), s) in enumerate(zip(docs, sets))), key=str)


def collected(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def test_words_follow_the_definition():
    texts = ["Ab  c\x0bd\x1ce", None, "", " x ", " y z\u0085", "É"]
    w = T.word_table(pa.array(texts))
    want = [len((t or "").encode().split()) if t else 0 for t in texts]
    assert w.per_doc.tolist() == want
    same = T.word_table(pa.array(["AB", "ab", "aB c", "ÉB", "éb"]))
    assert same.hash[0] == same.hash[1] == same.hash[2] and same.hash[-1] != same.hash[-2]
    sliced = pa.array(["q", "Ab", "r"]).slice(1, 1)
    assert T.word_table(sliced).hash[0] == same.hash[0]


def test_shingles_of_short_texts():
    h, n = T.shingle_table(T.word_table(pa.array(["a b c d e", "a b", "", "a b c d"])), 4)
    assert n.tolist() == [2, 1, 0, 1] and h[0] == h[3]


def test_local_and_spark_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(60)] + [(600, 600 + i) for i in range(50)] + [(700, 700)]
    top = {x: x for p in pairs for x in p}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    want = {x: find(x) for x in top}
    nodes, low = graph.local_components(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    assert dict(zip(nodes.tolist(), low.tolist())) == want
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(5)
    got = graph.components(edges).collect()
    assert len(got) == len(want) and {r["node"]: r["component"] for r in got} == want
    assert graph.components(edges.limit(0)).count() == 0


@pytest.mark.parametrize("num", [80, 85])
def test_prefix_signatures_lose_no_link(num):
    """Every linked pair of unequal sets shares a signature, whatever the classes and limits."""
    rng = random.Random(num)
    for _ in range(300):
        n = rng.randrange(2, 60)
        base = rng.sample(range(400), n)
        x, y = set(base), set(base)
        for _ in range(rng.randrange(0, 1 + n // 5)):
            y.discard(rng.choice(base))
            if rng.random() < 0.5:
                y.add(rng.randrange(400))
        if not y or x == y or 100 * len(x & y) < num * len(x | y):
            continue
        df = {t: rng.choice([1, 2, 5, 90, 400]) if t not in x & y else rng.choice([2, 5, 90, 400]) for t in x | y}
        for frequent, limit in ((64, 400), (0, 400), (64, 30), (0, 25)):
            def sigs(s):
                known = sorted((t for t in s if df[t] > 1), key=lambda t: (df[t], t))
                got = N.signatures(len(s), np.array(known, np.uint64), np.array([df[t] for t in known]), num, 100, frequent, limit)
                return set(() if got is None else got.tolist())

            assert sigs(x) & sigs(y)


def test_join_equals_brute_force(spark, edge_docs):
    docs = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    assert collected(N.jaccard_components(edge_docs)) == brute_components(docs)


def test_join_on_a_table_equals_brute_force(spark):
    table = spark.read.parquet(f"{SF001}/documents.parquet")
    docs = [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]
    assert collected(QUERIES["op1_ngram_join"](spark, SF001)) == brute_components(docs)


def test_large_cluster_in_blocks(spark):
    """A group larger than a block, whose members are linked only in part."""
    rng = random.Random(3)
    base = [f"t{i}" for i in range(60)]
    docs = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(60)] = f"u{i}_{rng.randrange(9)}"
        docs.append((i, " ".join(w)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    whole = brute_components(docs, 2, 80, 100)
    assert len({c for _, _, c in whole}) > 3
    verified = N.verified_components
    try:
        N.verified_components = lambda *a: verified(*a, block_docs=8)
        assert collected(N.jaccard_components(frame, 2, 80, 100, frequent=10)) == whole
    finally:
        N.verified_components = verified


def test_join_of_nothing(empty_docs):
    assert N.jaccard_components(empty_docs).collect() == []
    assert N.one_of_each(empty_docs).collect() == []


def test_one_of_each_keeps_columns_and_one_row(edge_docs):
    out = N.one_of_each(edge_docs)
    assert out.columns == edge_docs.columns
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == sorted([1, 2, 3, 4, 5, 6, 8, 10, 12, None], key=str)


def test_fingerprints_of_edge_cases(spark, edge_docs):
    docs = sorted(((r["doc_id"], r["text"] or "") for r in edge_docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    rows = imatch.robustness(edge_docs, imatch.lexicon(edge_docs)).collect()
    key = lambda i, n, s: (str(i), n, s)
    want = []
    for k, (i, t) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        cut = len(t) // 4
        want.append(key(i, len(t), hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest()))
    assert sorted(want) == sorted(key(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows)
    by = {}
    for (i, t), r in zip(docs, sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))):
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        by.setdefault(t, set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by.values())  # equal texts, equal fingerprints
    assert by[""] == {""} and len({next(iter(v)) for t, v in by.items() if t.split()}) >= 6


def auc(near, far):
    """Share of pairs in which the edited text is more alike than the next document; ties count half."""
    near, far = np.sort(near), np.sort(far)
    return float((np.searchsorted(far, near, "left") + np.searchsorted(far, near, "right")).sum() / (2 * len(near) * len(far)))


def test_fingerprints_tell_edits_from_strangers(spark):
    rows = QUERIES["op10_imatch"](spark, SF001).toPandas()
    assert len(rows) == spark.read.parquet(f"{SF001}/documents.parquet").count()
    long = rows[rows.n_chars > 300]
    assert auc(long.near_edited.to_numpy(), long.near_next.to_numpy()) > 0.95 and auc(rows.near_edited.to_numpy(), rows.near_next.to_numpy()) > 0.9
    assert long.near_next.mean() < 0.1


def test_parts_follow_the_definition(spark, edge_docs):
    """Every part by a plain loop: the lexicon words of the text inside a subset that is fixed by the words' hashes alone."""
    terms = imatch.lexicon(edge_docs, min_share=0.0, max_share=1.0)
    texts = ["alpha beta gamma", "one", None, " ", sentence(8, 60), sentence(10, 80) + " " + sentence(8, 20), "b a b a"]
    got, filled = imatch.Fingerprinter(terms, imatch.RATES, 8).parts(pa.array(texts))
    known, one = set(terms.tolist()), lambda v: int(T.mix64(np.array([v % 2**64], np.uint64))[0])
    for text, row, full in zip(texts, got, filled):
        words = sorted(set(T.word_table(pa.array([text])).hash.tolist()))
        band = [w for w in words if w in known]
        used = band if len(band) >= 8 else words
        assert full == bool(words)
        for r, rate in enumerate(imatch.RATES):
            inside = [w for w in used if rate >= 1 or one(w ^ ((r + 1) * 0x9E3779B97F4A7C15 % 2**64)) <= int(rate * 2**64)]
            want = one(sum(one(w + one(k + r)) for k, w in enumerate(inside))) % 65535 + 1 if inside else 0
            assert row[r] == want
    again = imatch.likeness(got, filled, got, filled)
    assert (again == 1).all()


def test_likeness_is_the_share_of_equal_parts():
    a, b = np.array([[1, 2, 0, 4]], np.uint16), np.array([[1, 3, 0, 0]], np.uint16)
    yes, no = np.array([True]), np.array([False])
    assert imatch.likeness(a, yes, b, yes).tolist() == [1 / 3]
    assert imatch.likeness(a, yes, b, no).tolist() == [0.0] and imatch.likeness(a, no, b, no).tolist() == [1.0]


def test_fingerprints_do_not_depend_on_partitions(spark, edge_docs):
    terms = imatch.lexicon(edge_docs)
    assert np.array_equal(terms, imatch.lexicon(edge_docs.repartition(7)))
    a = sorted(map(str, imatch.robustness(edge_docs, terms).collect()))
    assert a == sorted(map(str, imatch.robustness(edge_docs.repartition(7), terms).collect()))


def test_fingerprints_of_nothing(empty_docs):
    assert imatch.robustness(empty_docs, imatch.lexicon(empty_docs)).collect() == []


def test_lexicon_is_the_band(spark):
    docs = spark.createDataFrame([(i, f"all {'some' if i % 4 == 0 else ''} w{i} pair{i // 2}") for i in range(40)], "doc_id long, text string")
    found = imatch.lexicon(docs, min_share=0.05, max_share=0.5)
    assert np.array_equal(found, np.sort(T.word_table(pa.array(["some " + " ".join(f"pair{k}" for k in range(20))])).hash))


def test_tasks_of_the_join_hold_little_memory(monkeypatch):
    """4 MB of texts."""
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    from quiver.llm import ngram_join as J

    monkeypatch.setattr(J, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    words = np.array([f"w{i}" for i in range(5000)])
    rng = np.random.default_rng(0)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(2600)), pa.array([" ".join(words[rng.integers(0, 5000, 300)]) for _ in range(2600)])], ["doc_id", "text"])

    def peak(run):
        tracemalloc.start()
        try:
            run()
            return tracemalloc.get_traced_memory()[1] / 1e6
        finally:
            tracemalloc.stop()

    assert peak(lambda: [None for _ in J._send(128, 5)(iter([batch]))]) < 50
