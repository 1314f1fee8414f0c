"""Token ids, packing, shards, reply trees, personal data, pipeline."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF001
from edge_fixtures import edge_docs, empty_docs  # noqa: F401
from quiver.llm import ngram_join, packing as P, pii, quality, reply_trees as R, shards as S, tokens as K
from quiver.llm.registry import ORACLE, QUERIES

tokenizers = pytest.importorskip("tokenizers")
VOCABULARY = P.default_vocabulary()


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(VOCABULARY)


def plain_ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


# ---- token ids ----------------------------------------------------------------------------------------

ODD = ["", " ", "  ", "a  b", "a   b", " a", "a ", "\n", "a\n b", "a \nb", "a\n  b", "a \n \n b", "x\t y", "x \xa0y", "\xa0 x", "a\x1c b", "a <|endoftext|> b", "<|endoftext|>", "it's I'll 's",
       "a\x85 b", "12 34,5 é à", "\n \n", "a\n ", "a \n", "日本 語 \U0001f600", "\0 a\0", "a\n\nb\n\n\nc"]


@pytest.mark.parametrize("path", [VOCABULARY, S.default_vocabulary()])
def test_ids_equal_the_library(library, path):
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice(" \n\t a'sb1.,é\xa0\x1c\x85") for _ in range(rng.randrange(15))) for _ in range(1500)]
    texts = [t for t in texts if path == VOCABULARY or "<|" not in t]
    ids, sizes = K.Encoder(path).ids(texts)
    for t, part in zip(texts, np.split(ids, np.cumsum(sizes)[:-1])):
        assert part.tolist() == plain_ids(library, t)


def test_ranked_vocabulary_keeps_no_memo(library):
    encoder = K.Encoder(S.default_vocabulary())
    for texts in ([], [""], ["some words and some more", "", "words\n\n\tagain 12"] * 3):
        ids, sizes = encoder.ids(texts)
        assert len(sizes) == len(texts) and sizes.sum() == len(ids) and ids.dtype == np.uint32
        assert ids.tolist() == [i for t in texts for i in plain_ids(library, t)]
    assert not encoder.place and not encoder.used and not encoder.bytes


def test_memo_may_overflow(library, monkeypatch):
    monkeypatch.setattr(K, "MEMO_ENTRIES", 40)
    encoder = K.Encoder(VOCABULARY)
    for k in range(6):
        texts = [" ".join(f"w{k}{i}x" for i in range(n)) for n in (3, 25, 60, 0)]
        for group in (texts[:2], texts):
            ids, sizes = encoder.ids(group)
            assert [p.tolist() for p in np.split(ids, np.cumsum(sizes)[:-1])] == [plain_ids(library, t) for t in group]


# ---- packing ------------------------------------------------------------------------------------------

def check_plan(histogram, capacity):
    runs = P.plan(histogram, capacity)
    places = P.Places(runs)
    used = {}
    for n, count in histogram.items():
        if count:
            sequence, offset = places.look_up(np.full(count, n), np.arange(count))
            for s, o in zip(sequence.tolist(), offset.tolist()):
                used.setdefault(s, []).append((o, n))
    for parts in used.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
        assert sum(3 * n > capacity for _, n in parts) <= 2
    assert sorted(used) == list(range(len(used)))
    return len(used)


def best_fit(lengths, capacity):
    """Number of sequences of the same method, piece by piece."""
    large = sorted((n for n in lengths if 3 * n > capacity), reverse=True)
    gaps = []
    while large:
        n = large.pop(0)
        partner = next((m for m in large if m <= capacity - n), None)
        if partner is not None:
            large.remove(partner)
        gaps.append(capacity - n - (partner or 0))
    for n in sorted((n for n in lengths if 3 * n <= capacity), reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(12))
def test_plan_equals_best_fit_piece_by_piece(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 30, 64])
    top = rng.choice([capacity, capacity // 2, 4])
    lengths = [rng.randrange(1, top + 1) if rng.random() < 0.7 else rng.choice([capacity, 1, capacity // 2]) for _ in range(rng.randrange(0, 300))]
    histogram = {}
    for n in lengths:
        histogram[n] = histogram.get(n, 0) + 1
    assert check_plan(histogram, capacity) == best_fit(lengths, capacity)


def check_packed(rows, docs, library, capacity=2048):
    """Every document's ids once, in order, in gapless sequences."""
    by_sequence, got = {}, []
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        got.append((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for parts in by_sequence.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    want = []
    for i, t in docs:
        ids = np.array(plain_ids(library, t) + [0], "<u4")
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        want += [(str(i), k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(got) == sorted(want)
    return len(by_sequence)


def test_packing_of_edge_cases(edge_docs, library):
    docs = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    check_packed(P.pack_documents(edge_docs, VOCABULARY).collect(), docs, library)
    rows = P.pack(P.pieces(edge_docs, VOCABULARY, 16), 16, rows_a_salt=3).collect()
    check_packed(rows, docs, library, 16)


def test_packing_a_table(spark, library):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    rows = QUERIES["op5_packing"](spark, SF001).collect()
    sequences = check_packed(rows, docs, library)
    assert sequences <= 1.02 * -(-sum(r["length"] for r in rows) // 2048)


def test_packing_of_nothing(empty_docs):
    assert P.pack_documents(empty_docs, VOCABULARY).collect() == []


# ---- shards -------------------------------------------------------------------------------------------

@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_feistel_is_a_keyed_bijection(n):
    a = S.feistel(np.arange(n), n, 1)
    assert sorted(a.tolist()) == list(range(n))
    if n >= 1000:
        assert (a != S.feistel(np.arange(n), n, 2)).mean() > 0.9 and (a != np.arange(n)).mean() > 0.9


def test_shards_round_trip(spark, edge_docs, library, tmp_path):
    path, length, records = str(tmp_path / "shards"), 64, 16
    n = S.write_shards(edge_docs, path, S.default_vocabulary(), length=length, records=records)
    rows = S.read_shards(spark, path, length).collect()
    assert sorted(r["slot"] for r in rows) == list(range(n)) and all(r["shard"] == r["slot"] // records for r in rows)
    kind = S.record_type(length)
    for f in tmp_path.joinpath("shards").glob("part-*"):
        shard = np.frombuffer(f.read_bytes(), kind)  # raw reads at fixed strides
        assert (shard["end"] == 10).all() and np.array_equal(shard["slot"], shard["slot"][0] + np.arange(len(shard), dtype=np.uint64))
    # the streams of the tasks, put together again by the place of every sequence, hold every document once
    total = sum(r["length"] for r in rows)
    docs = [(r["doc_id"], plain_ids(library, r["text"]) + [50256]) for r in edge_docs.collect()]
    assert total == sum(len(ids) for _, ids in docs) and all(0 < r["length"] <= length for r in rows)
    pieces = {}
    for r in rows:
        pieces.setdefault((r["doc_id"], r["start"]), []).append(np.frombuffer(r["ids"], "<u2").tolist())
    for (doc_id, start), found in pieces.items():
        heads = [ids[start:] for i, ids in docs if i == doc_id and len(ids) > start]
        assert all(any(f[: len(h)] == h[: len(f)] for h in heads) for f in found)
    assert S.read_shards(spark, path, length, from_slot=n - 3).count() == 3


def test_shard_query_counts_every_id(spark, library):
    rows = QUERIES["op3_token_shards"](spark, SF001).collect()
    texts = [r["text"] for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    assert sum(r["length"] for r in rows) == sum(len(plain_ids(library, t)) + 1 for t in texts)


def test_shards_of_nothing(empty_docs, tmp_path):
    assert S.write_shards(empty_docs, str(tmp_path / "none"), S.default_vocabulary()) == 0


# ---- reply trees ----------------------------------------------------------------------------------------

def brute_paths(nodes):
    """node to its path from the root, for every leaf."""
    parent = {n: p for n, p in nodes}
    inner = {p for p in parent.values() if p in parent}
    out = {}
    for leaf in parent:
        if leaf not in inner:
            path, at = [], leaf
            while at in parent:
                path.append(at)
                at = parent[at]
            out[leaf] = path[::-1]
    return out


def test_paths_equal_enumeration(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for c in range(6):
        n = rng.choice([1, 2, 9, 40])
        nodes = [(i, None if i == 0 else (i - 1 if c == 0 else rng.choice([rng.randrange(i), 999, i - 1]))) for i in range(n)]
        rows += [(str(c), i, p) for i, p in nodes]
        want.update({(str(c), leaf): path for leaf, path in brute_paths(nodes).items()})
    got = {}
    for r in R.paths(spark.createDataFrame(rows, "conv_id string, node long, parent long")).collect():
        got.setdefault((r["conv_id"], r["leaf"]), []).append((-r["back"], r["node"]))
    assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == want


def test_branches_are_ranked_by_score(spark):
    rows = [("a", 1, None, "user", "q", 0.0), ("a", 2, 1, "assistant", "bad", 0.1), ("a", 3, 1, "assistant", "good", 0.9), ("a", 4, 3, "user", "more", 0.9), ("a", 5, 1, "assistant", "tie", 0.1)]
    turns = spark.createDataFrame([(None, *r[1:]) if k == 9 else r for k, r in enumerate(rows)], "conv_id string, node long, parent long, role string, text string, score double")
    turns = turns.withColumn("conv_id", F.lit(7).cast("long"))
    out = R.format_trees(turns, branches=2).orderBy("rank").select("rank", R.read_back(F.col("formatted")).alias("t")).collect()
    assert [[t["text"] for t in r["t"]] for r in out] == [["q", "good", "more"], ["q", "bad"]]
    assert R.format_trees(turns, branches=None).count() == 3


ROUND = ["", "plain", "</turn>", "<turn user>\nx</turn>\n", "\\", "\\l", "\\\\l<turn", "a\\</turn>\\", "\\### Assistant: </turn> ok", "<turnover>", "é日\U0001f600\n\n", "\\\\", "\\n\\g>", "x" * 50_000]


def test_format_round_trip(spark):
    rows = [(i, t, role, text) for i, texts in enumerate([ROUND, ROUND[::-1], ["solo"]]) for t, (role, text) in enumerate(zip(["user", "assistant", "sys>tem\n\\x", "<turn", None, ""] * 9, texts))]
    rows += [(50, 0, "user", None), (50, 0, "user", None), (50, None, "assistant", "first"), (None, 1, "assistant", "no id"), (51, 0, "assistant", None)]
    conv = spark.createDataFrame([(*r, "x", 0.5, 3) for r in rows], "conv_id long, turn long, role string, text string, formatted string, score double, node int").repartition(5)
    out = R.format_trees(R.chain(conv), branches=None).select("conv_id", R.read_back(F.col("formatted")).alias("t"), R.loss_texts(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    got = {r["conv_id"]: ([(t["role"], t["text"]) for t in r["t"]], r["loss"]) for r in out}
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert {c: t for c, (t, _) in got.items()} == want
    assert {c: loss for c, (_, loss) in got.items()} == {c: [x for role, x in turns if role == "assistant"] for c, turns in want.items()}
    assert R.format_trees(R.chain(conv.limit(0))).collect() == []


def test_conversations_equal_duckdb(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF001}/conversations.parquet'")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    want = sorted(con.execute(f"SELECT {', '.join(names)} FROM ({ORACLE['op4_reply_trees']})").fetchall())
    assert sorted(tuple(r) for r in QUERIES["op4_reply_trees"](spark, SF001).select(*names).collect()) == want


# ---- personal data ----------------------------------------------------------------------------------------

BASE = {"email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")}


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        total = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def base_row(text):
    found = sorted((m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(BASE.items()) for m in p.finditer(text or "") if passes(kind, m.group()))
    joined = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in found)
    return (*(sum(f[3] == kind for f in found) for kind in BASE), hashlib.sha256(joined.encode()).hexdigest()), {f"{kind}:{a}:{b}" for a, _, b, kind in found}


def odd_texts():
    rng = random.Random(6)
    texts = [None, "", "a@b.c_x@d.e", "a@b.c@d.e.f", "1.2.3.4.5.6.7.8", "300.1.1.1 0001.2.3.004", "4111 1111-1111 1111", "4111  1111 1111 1111", "+1 (212) 555-0100 4111111111111111", "é\U0001f600 x@y.zz 10.0.0.1", "+1", "+12", "5" * 30_000,
             "a" * 40_000 + "@x.yy", "@" * 2000, "1-" * 5000, "+" * 500 + "1 2 3 4 5 6 7 8 9", ". " * 3000 + "1.1.1.1"]
    for _ in range(400):
        texts.append("".join(rng.choice(["1", "4", "0", "255", ".", " ", "-", "+", "(", ")", "a", "@", "b.c", "_", "é", "4111111111111111"]) for _ in range(rng.randrange(1, 40))))
    return texts


def test_base_spans_equal_the_definition(spark):
    texts = odd_texts()
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, spans string, _found int").repartition(4)
    rows = {r["doc_id"]: r for r in pii.spans(docs).collect()}
    assert len(rows) == len(texts)
    for k, t in enumerate(texts):
        want, spans = base_row(t)
        r = rows[k]
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) == want, t
        assert spans <= set(r["spans"].split(",")) | {""}


def test_added_spans_are_secrets_in_context(spark):
    from conftest import SF01

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    found = 0
    for r in QUERIES["op6_pii"](spark, SF01).collect():
        added = set(filter(None, r["spans"].split(","))) - base_row(texts[r["doc_id"]])[1]
        for span in added:
            kind, a, b = span.split(":")
            assert kind != "card" or len(re.sub("[^0-9]", "", texts[r["doc_id"]][int(a) : int(b)])) > 19
            found += kind == "secret" and 'token = "' in texts[r["doc_id"]][: int(a)][-12:]
    assert found >= 10


def test_reliabilities_are_learned():
    """Votes drawn from known labelers: the estimate finds who is right."""
    rng = random.Random(2)
    counts = {}
    for _ in range(4000):
        true = rng.random() < 0.4
        right = (0.95, 0.7, 0.9, 0.6)
        votes = tuple((1 if true else -1) * (1 if rng.random() < p else -1) for p in right)
        counts[0, votes] = counts.get((0, votes), 0) + 1
    patterns = sorted(counts.items())
    belief, rate = pii.expectation_maximisation(patterns)
    agree = [rate[i][True][1] - rate[i][False][1] for i in range(4)]
    assert agree[0] > agree[1] and agree[2] > agree[3]
    top = {votes: b for ((_, votes), _), b in zip(patterns, belief)}
    assert top[1, 1, 1, 1] > 0.95 and top[-1, -1, -1, -1] < 0.05


def test_redaction(spark, edge_docs):
    text = 'mail a.b@c.de, ip 10.0.0.1 and token = "0641917ea4e9feb9cda83477b57ac2654884f485" é +1 (212) 555-0100.'
    docs = spark.createDataFrame([(1, text, len(text), 9), (2, "clean", 5, 9), (3, None, None, 9)], "doc_id long, text string, n_chars long, _found int")
    out = {r["doc_id"]: r for r in pii.redact(docs).collect()}
    assert out[1]["text"] == 'mail [EMAIL], ip [IP] and token = "[SECRET]" é [PHONE].' and out[1]["n_chars"] == len(out[1]["text"])
    assert out[2].asDict() == {"doc_id": 2, "text": "clean", "n_chars": 5, "_found": 9} and out[3]["text"] is None
    same = pii.redact(edge_docs)
    assert same.columns == edge_docs.columns and sorted(map(str, same.collect())) == sorted(map(str, edge_docs.collect()))
    assert pii.redact(edge_docs.limit(0)).collect() == [] and pii.spans(edge_docs.limit(0)).collect() == []


def test_native_operators_run_no_python(spark):
    for name in ("op4_reply_trees", "op6_pii"):
        plan = QUERIES[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


# ---- pipeline -----------------------------------------------------------------------------------------------

def test_pipeline_stage_by_stage(spark, library):
    """Every stage's decisions against the operators' own brute forces."""
    from test_similarity import brute_components

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "decontamination", "pii", "packing"]
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    good = stages["quality"](spark, docs, SF001)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF001}/labels.parquet").collect()}
    ids = {r["doc_id"] for r in good.collect()}
    assert sum((i in ids) == bool(q) for i, q in labels.items()) / len(labels) > 0.95
    first = stages["near_duplicates"](spark, good, SF001)
    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    assert {r["doc_id"] for r in first.collect()} == {d for d, _, c in brute_components(rows, 5, 80, 100) if d == c}
    clean = stages["decontamination"](spark, first, SF001)
    items = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    assert not any(i in " ".join(r["text"].lower().split()) for r in clean.collect() for i in items)
    private = stages["pii"](spark, clean, SF001)
    assert private.count() == clean.count() and not any(base_row(r["text"])[1] for r in private.collect())
    assert good.columns == first.columns == clean.columns == private.columns == docs.columns
    packed = stages["packing"](spark, private, SF001).collect()
    check_packed(packed, [(r["doc_id"], r["text"]) for r in private.collect()], library)
    assert sorted(map(str, packed)) == sorted(map(str, corpus_pipeline.run(spark, SF001).collect()))


def test_pipeline_of_edge_cases(spark, edge_docs):
    docs = edge_docs
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF001).collect() == []
        docs = stage(spark, docs, SF001)
    assert docs.count() >= 1
