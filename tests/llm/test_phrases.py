"""Phrase collocation mining against counting by definition."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from edge_fixtures import edge_docs, empty_docs  # noqa: F401
from quiver.llm import phrases as P
from quiver.llm.registry import QUERIES

LOWER = {c: c + 32 for c in range(65, 91)}


def pieces_of(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
        words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
        if words:
            yield words


def brute(docs, threshold, longest=5, top=2000):
    counts, total = {}, Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        own = counts.setdefault(lang, Counter())
        for words in pieces_of(text):
            total[lang] += len(words)
            for k in range(1, longest + 1):
                own.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: c for p, c in f.items() if len(p) > 1 and c >= threshold}
        inside = {}
        for p, c in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside.get(p[i : i + k], 0), c)
        rows = []
        for p, a in candidates.items():
            if inside.get(p, 0) < a:
                score, _, l, r = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def answered(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()))


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["Red", "fish", "the", "of", "été", "日本", "a-b", "x" * 300, *[f"w{i}" for i in range(30)]]
    fixed = ["new York city hall", "the quick brown fox jumps", "of the"]
    docs = []
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.2 else rng.choice(words[: rng.choice([6, 38])]) for _ in range(rng.randrange(0, 60))]
        docs.append((rng.choice(["en", "en", "de", None, "und"]), "".join(p + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ; "]) for p in parts)))
    return docs


def frame(spark, docs, parts=3):
    return spark.createDataFrame(docs, "lang string, text string").repartition(parts)


def test_words_and_pieces():
    texts = ["Ab  c. d\te\x0bf", None, "", " .,;", "x", "é日 É!q r"]
    words = P.words_of(pa.array(texts), 1)
    said = [words.data[a:b].tobytes().decode().translate(LOWER) for a, b in zip(words.start, words.end)]
    assert said == [w for t in texts for p in pieces_of(t) for w in p]
    assert words.together.tolist() == [k < len(p) - 1 for t in texts for p in pieces_of(t) for k in range(len(p))]
    assert words.hash[0] == P.words_of(pa.array(["aB"]), 1).hash[0] != P.words_of(pa.array(["aB"]), 2).hash[0]


@pytest.mark.parametrize("threshold, shards, top", [(8, 4, 2000), (30, 2, 7)])
def test_equals_brute_force(spark, threshold, shards, top):
    docs = corpus(threshold, 400)
    want = brute(docs, threshold, top=top)
    assert len(want) > 10 and any(len(r[2].split()) > 3 for r in brute(docs, threshold))
    assert answered(P.top_phrases(frame(spark, docs), top=top, threshold=threshold, shards=shards)) == want


def test_counts_do_not_depend_on_the_partitions(spark):
    docs = corpus(3, 200)
    assert answered(P.top_phrases(frame(spark, docs, 1), threshold=6)) == answered(P.top_phrases(frame(spark, docs, 7), threshold=6))


def test_folding_in_small_steps(spark):
    """A task that hands on its counts many times, and hashes of another seed."""
    docs = corpus(4, 150)
    found, _ = P.frequent(frame(spark, docs), threshold=6, seed=3)
    want = Counter()
    for lang, text in docs:
        for words in pieces_of(text):
            for k in range(1, 6):
                want.update((lang or "und", *words[i : i + k]) for i in range(len(words) - k + 1))
    assert sorted(r["f"] for r in found.collect()) == sorted(c for c in want.values() if c >= 6)


def test_large_products_are_exact(spark):
    """Counts whose products pass 64 bits, through the score's own expression."""
    a, n, l, r = 3_000_000_019, 9_000_000_000_037, 5_000_000_029, 6_000_000_029
    df = spark.createDataFrame([(a, n, l, r)], "a long, n long, l long, r long")
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    got = df.select((F.lit(1000).cast("decimal(38,0)") * wide("a") * wide("n")).alias("product"), (wide("l") * wide("r")).alias("parts")).selectExpr("product div parts AS s").first()["s"]
    assert got == 1000 * a * n // (l * r)


def test_query_on_the_given_tables(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("lang", "text").collect()]
    assert answered(QUERIES["op12_itemset_phrases"](spark, SF001)) == brute(docs, 100)


def test_edge_cases(spark, edge_docs, empty_docs, tmp_path):  # noqa: F811
    rows = [(r["lang"], r["text"]) for r in edge_docs.collect()]
    edge_docs.withColumn("name", F.lit(1)).withColumn("shard", F.lit("x")).write.parquet(str(tmp_path / "documents.parquet"))
    assert answered(QUERIES["op12_itemset_phrases"](spark, str(tmp_path))) == brute(rows, 100)
    want = brute(rows, 3)
    assert want and answered(P.top_phrases(edge_docs.select("lang", "text"), threshold=3)) == want
    assert answered(P.top_phrases(empty_docs.select("lang", "text"))) == []
    assert answered(P.top_phrases(frame(spark, [("en", None), (None, ""), ("de", " ., ")]))) == []


def test_bitmap_misses_no_name(spark):
    rng = np.random.default_rng(0)
    names = rng.integers(-(2**63), 2**63, 3000)
    df = spark.createDataFrame([(int(n),) for n in names], "name long")
    made = P.bitmaps(df, all=F.lit(True), some=F.col("name") > 0)
    assert made["all"].has(names.view(np.uint64)).all()
    assert made["some"].has(names[names > 0].view(np.uint64)).all()
    assert made["all"].has(rng.integers(-(2**63), 2**63, 3000).view(np.uint64)).mean() < 0.1


def test_bitmaps_of_arrays(spark, monkeypatch):
    """Put together by the driver or by tasks, in several chunks, a kind without names among them."""
    names = np.random.default_rng(1).integers(-(2**63), 2**63, 40_000)
    df = spark.createDataFrame([(names[i::7].tobytes(),) for i in range(7)], "names binary").repartition(3)
    pick = lambda b: (x := np.concatenate([np.frombuffer(v, np.uint64) for v in b.column(0).to_pylist()]), x[x < 2**62], x[:0])
    made = [P.bitmaps_in(df, pick, len(names), kinds=3)]
    made.append(P.bitmaps_in(df, pick, len(names), kinds=3, repeated=True))
    for every, low, none in made:
        assert every.bits == 20 and every.has(names.view(np.uint64)).all() and not none.data.any()
        assert low.has(names.view(np.uint64)[names.view(np.uint64) < 2**62]).all() and not low.data[low.data.size // 4 :].any()
    assert all((a.data == b.data).all() for a, b in zip(*made))
    one = P.one_bitmap(spark.createDataFrame([(int(n),) for n in names[:3000]] * 2, "name long"), 64, repeated=True)
    assert one.has(names[:3000].view(np.uint64)).all() and one.has(names[3000:].view(np.uint64)).mean() < 0.03


def test_words_longer_than_a_block():
    """A word's hash does not depend on what lies around it, whatever its length."""
    long = ["q" * n for n in (P._BLOCK - 1, P._BLOCK, P._BLOCK + 1, 3 * P._BLOCK + 5)]
    alone = [P.words_of(pa.array([w]), 1).hash[0] for w in long]
    texts = ["ab " * 30_000 + long[0], long[1].upper() + "," + long[2], " " * 9 + "c. " + long[3] + " ab"]
    words = P.words_of(pa.array(texts), 1)
    own = {int(b - a): h for a, b, h in zip(words.start, words.end, words.hash)}
    assert [own[len(w)] for w in long] == alone and len(set(alone)) == 4
    assert words.hash[0] == words.hash[-1] and words.together.tolist() == [True] * 30_000 + [False] * 4 + [True, False]


def test_late_scans_count_only_what_became_active(spark, monkeypatch):
    """Work by step: each scan walks phrases up to a word longer than what was found in the last cycle."""
    asked, scan = [], P.scan

    def noted(docs, reached, young, lengths, *rest):
        asked.append((tuple(lengths), reached is not None))
        return scan(docs, reached, young, lengths, *rest)

    monkeypatch.setattr(P, "scan", noted)
    docs = [("en", "a b c d e f. g h")] * 12
    found, _ = P.frequent(frame(spark, docs, 1), threshold=8, shards=2)
    assert sorted(r["f"] for r in found.collect()) == [12] * (8 + 6 + 4 + 3 + 2)
    assert asked[0] == ((), False) and asked[-1][0] == (4,) and all(x[0] == tuple(sorted(x[0])) for x in asked)
