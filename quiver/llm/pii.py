"""Personal data by weak supervision, with DataFrame functions only.

Base spans (e-mail, IP address, card, phone) come from fixed patterns and checks. The method adds spans:

1. Candidates are all matches of the patterns, those that fail their check included, and long strings of
   mixed letters and digits (secrets). Each has the text before and after it.
2. Labelers vote on every candidate for (1), against (-1) or not at all (0): the pattern's own check, a
   gazetteer of words before it, the characters around it, and the variety of its characters.
3. Expectation-maximisation over the counts of vote patterns estimates how reliable every labeler is and
   the probability of every pattern. The counts are one row a pattern (at most kinds x 3^4), whatever the
   corpus, and are all that reaches the driver.
4. A logistic span classifier is trained on those probabilities, with the votes, the kind and the length as
   features; it is applied to every candidate as a column expression. Candidates at or above ``threshold``
   are added; base spans always stay.

A text is scanned with patterns that run in linear time: quantifiers are possessive, and a pattern that
starts with a run of characters starts only at the beginning of a run or where the last match ended.

Defined cases: a null or empty text has no span. Spans are code points, end exclusive. Equal starts are
ordered by kind, then end. Repeated rows are documents of their own, null ids stay null, extra columns are
kept by ``redact`` and ignored by ``spans``; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quiver.session import materialize

KINDS = ["email", "ip", "card", "phone", "secret"]
BASE = KINDS[:4]
_MAIL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{_MAIL}])|\G)[{_MAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    # a run of at least 12 digits: shorter runs can't pass, and hold no longer one
    "card": r"[0-9](?:[ -]?[0-9]){11,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{16,}+",
}
LABELERS = ["check", "gazetteer", "edges", "variety"]
# P(vote | truth) before any data
PRIORS = {
    "check": {True: {1: 0.6, 0: 0.39, -1: 0.01}, False: {1: 0.05, 0: 0.3, -1: 0.65}},
    "gazetteer": {True: {1: 0.4, 0: 0.58, -1: 0.02}, False: {1: 0.03, 0: 0.67, -1: 0.3}},
    "edges": {True: {1: 0.9, 0: 0.01, -1: 0.09}, False: {1: 0.6, 0: 0.01, -1: 0.39}},
    "variety": {True: {1: 0.85, 0: 0.13, -1: 0.02}, False: {1: 0.5, 0: 0.3, -1: 0.2}},
}
# Words before a span that speak for or against personal data
FOR = "account address call card cell contact credential credit email e-mail fax host ip key login mail mobile mailto number passwd password phone pin pwd secret tel telephone token visa"
AGAINST = "article build chapter checksum commit digest edition figure hash isbn issn isrc item line md5 order page part release revision section serial sha sku step table ver version"
CONTEXT = 32


def _matches(text: Column, kind: str) -> tuple[Column, Column]:
    """Gaps between the matches of a kind, and the matches; null where there can't be any."""
    may = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind, F.rlike(text, F.lit("[0-9]")))
    pattern = F.lit(PATTERNS[kind])
    return F.when(may, F.split(text, PATTERNS[kind], -1)), F.when(may, F.regexp_extract_all(text, pattern, F.lit(0)))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _passes(match: Column, kind: str) -> Column:
    if kind == "ip":
        def small(part: Column) -> Column:
            plain = F.regexp_replace(part, "^0+", "")
            return (F.length(plain) < 3) | ((F.length(plain) == 3) & (plain <= "255"))

        return F.forall(F.split(match, r"\."), small)
    if kind == "card":
        digits = _digits(match)
        return F.when(F.length(digits) <= 19, _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _check(match: Column, kind: str, passes: Column) -> Column:
    """Vote of the pattern's own check; it does not judge what is longer than one number."""
    if kind == "secret":
        return F.lit(0)
    most = {"card": 19, "phone": 15}.get(kind)
    fails = F.lit(-1) if most is None else F.when(F.length(_digits(match)) > most, 0).otherwise(-1)
    return F.when(passes, 1).otherwise(fails)


def _votes(before: Column, match: Column, after: Column, kind: str, passes: Column) -> list[Column]:
    near = F.lower(F.right(before, F.lit(CONTEXT)))
    words = F.split(near, "[^a-z0-9-]+")
    named = lambda text: F.arrays_overlap(words, F.array(*[F.lit(w) for w in text.split()]))
    left, right = F.right(before, F.lit(1)), F.left(after, F.lit(1))
    clean = F.rlike(left, F.lit("^[\\s\"'(<:=,;]?$")) & F.rlike(right, F.lit("^[\\s\"')>,.;:!?]?$"))
    variety = F.size(F.array_distinct(F.split(match, "")))
    return [_check(match, kind, passes).cast("int"), F.when(named(AGAINST), -1).when(named(FOR), 1).otherwise(0), F.when(clean, 1).otherwise(-1),
            F.when(variety >= F.least(F.lit(8), F.length(match) / 2), 1).when(variety < 4, -1).otherwise(0)]


def candidates(text: Column) -> tuple[dict[str, Column], "callable"]:
    """Columns of gaps and matches by kind, and how to turn them into candidate arrays."""
    scans = {}
    for kind in KINDS:
        gaps, hits = _matches(text, kind)
        scans[f"_gaps_{kind}"], scans[f"_hits_{kind}"] = gaps, hits

    def spans(kind: str) -> Column:
        gaps, hits = F.col(f"_gaps_{kind}"), F.col(f"_hits_{kind}")

        def one(match: Column, i: Column) -> Column:
            start = F.aggregate(F.slice(gaps, F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, g: a + F.length(g)) \
                + F.aggregate(F.when(i > 0, F.slice(hits, F.lit(1), F.greatest(i, F.lit(1)))).otherwise(F.array().cast("array<string>")), F.lit(0).cast("long"), lambda a, m: a + F.length(m))
            passes = _passes(match, kind)
            votes = _votes(F.element_at(gaps, i + 1), match, F.element_at(gaps, i + 2), kind, passes)
            return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (start + F.length(match)).alias("end"),
                            (F.lit(kind in BASE) & passes).alias("base"), F.least(F.lit(3), F.floor(F.log2(F.length(match) / 4.0))).cast("int").alias("size"),
                            *[v.alias(n) for v, n in zip(votes, LABELERS)])

        return F.when(F.size(hits) > 0, F.transform(hits, one))

    return scans, spans


_CANDIDATE = "array<struct<start:bigint,kind:int,end:bigint,base:boolean,size:int," + ",".join(f"{n}:int" for n in LABELERS) + ">>"


def with_candidates(docs: DataFrame, keep: list[str]) -> DataFrame:
    """(row, _found): a struct of the columns ``keep``, whatever their names, and all candidates of the text."""
    scans, spans = candidates(F.coalesce(F.col("text"), F.lit("")))
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None)
    scanned = docs.select(row.alias("row"), *[c.alias(n) for n, c in scans.items()])
    none = F.array().cast(_CANDIDATE)
    found = F.sort_array(F.concat(*[F.coalesce(spans(k).cast(_CANDIDATE), none) for k in KINDS]))
    return scanned.select("row", found.alias("_found"))


def expectation_maximisation(patterns: list[tuple[tuple, int]], rounds: int = 50) -> tuple[list[float], list[dict]]:
    """Probability of every vote pattern ((kind, votes), count) to be personal data, and each labeler's reliabilities.

    Labelers are taken as independent given the truth. Priors, worth a fifth of the candidates, say what a
    labeler's vote means: a failed check speaks against a span, while clean edges and varied characters are
    common to all numbers. They also keep the share of true candidates of a kind away from 0 and 1.
    """
    kinds = sorted({k for (k, _), _ in patterns})
    share = {k: 0.5 for k in kinds}
    rate = [{truth: dict(p) for truth, p in labeler.items()} for labeler in PRIORS.values()]
    weight = max(10.0, 0.2 * sum(n for _, n in patterns))
    belief = [0.5] * len(patterns)
    for _ in range(rounds):
        for j, ((k, votes), _) in enumerate(patterns):
            yes, no = math.log(share[k]), math.log(1 - share[k])
            for labeler, v in zip(rate, votes):
                yes += math.log(labeler[True][v])
                no += math.log(labeler[False][v])
            belief[j] = 1 / (1 + math.exp(min(700, no - yes)))
        for k in kinds:
            own = [(b, n) for b, ((kk, _), n) in zip(belief, patterns) if kk == k]
            total = sum(n for _, n in own)
            share[k] = (sum(b * n for b, n in own) + 2) / (total + 4)
        for i, labeler in enumerate(rate):
            for truth, start in PRIORS[LABELERS[i]].items():
                got = {v: weight * p for v, p in start.items()}
                for b, ((_, votes), n) in zip(belief, patterns):
                    got[votes[i]] += n * (b if truth else 1 - b)
                total = sum(got.values())
                labeler[truth] = {v: c / total for v, c in got.items()}
    return belief, rate


def _span_features(kind: int, size: int, votes: tuple) -> list[int]:
    """Places of the features that are 1."""
    on = [0, 1 + kind, 1 + len(KINDS) + max(0, min(3, size))]
    base = 5 + len(KINDS)
    for i, v in enumerate(votes):
        if v:
            on.append(base + 2 * i + (v > 0))
    return on


N_FEATURES = 5 + len(KINDS) + 2 * len(LABELERS)


def train_classifier(rows: list[tuple[int, int, tuple, int, float]], steps: int = 300, rate: float = 0.5, ridge: float = 1e-3) -> list[float]:
    """Logistic weights from (kind, size, votes, count, probability)."""
    total = sum(n for *_, n, _ in rows) or 1
    data = [(_span_features(k, s, v), n / total, p) for k, s, v, n, p in rows]
    w = [0.0] * N_FEATURES
    for _ in range(steps):
        gradient = [-ridge * x for x in w]
        for on, n, p in data:
            q = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w[i] for i in on)))))
            for i in on:
                gradient[i] += n * (p - q)
        w = [x + rate * g for x, g in zip(w, gradient)]
    return w


def train(found: DataFrame) -> list[float]:
    """Weights of the span classifier from the candidates (``_found``) of all documents."""
    each = found.select(F.explode("_found").alias("c")).select("c.kind", "c.size", *[f"c.{n}" for n in LABELERS])
    counts = each.groupBy("kind", "size", *LABELERS).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 5 x 7 x 81 rows
    rows = sorted(((r["kind"], r["size"], tuple(r[n] for n in LABELERS), r["n"]) for r in counts))
    patterns: dict[tuple, int] = {}
    for k, _, votes, n in rows:
        patterns[k, votes] = patterns.get((k, votes), 0) + n
    keys = sorted(patterns)
    belief, _ = expectation_maximisation([(k, patterns[k]) for k in keys]) if keys else ([], [])
    of = dict(zip(keys, belief))
    return train_classifier([(k, s, v, n, of[k, v]) for k, s, v, n in rows])


def _score(c: Column, weights: list[float]) -> Column:
    """Log-odds of a candidate."""
    pick = lambda value, first, n: F.element_at(F.array(*[F.lit(x) for x in weights[first : first + n]]), value + 1)
    total = F.lit(weights[0]) + pick(c["kind"], 1, len(KINDS)) + pick(F.greatest(F.lit(0), c["size"]), 1 + len(KINDS), 4)
    for i, name in enumerate(LABELERS):
        at = 5 + len(KINDS) + 2 * i
        total = total + F.when(c[name] > 0, weights[at + 1]).when(c[name] < 0, weights[at]).otherwise(0.0)
    return total


def _kept(found: Column, weights: list[float], threshold: float) -> Column:
    """Base spans and the candidates that the classifier adds."""
    least = math.log(threshold / (1 - threshold))
    return F.filter(found, lambda c: c["base"] | (_score(c, weights) >= least))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda c: F.concat(F.element_at(names, c["kind"] + 1), F.lit(":"), c["start"].cast("string"), F.lit(":"), c["end"].cast("string"))), ",")


def spans(docs: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Counts, base digest and all spans of every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = materialize(with_candidates(docs, ["doc_id"]).select("row.doc_id", "_found"))  # spans only, no texts
    weights = train(found)
    base = F.filter("_found", lambda c: c["base"])
    count = lambda kind: F.size(F.filter(F.col("_base"), lambda c: c["kind"] == KINDS.index(kind))).cast("long")
    out = found.select("doc_id", base.alias("_base"), _kept(F.col("_found"), weights, threshold).alias("_all"))
    return out.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"), _joined(F.col("_all")).alias("spans"))


def redact(docs: DataFrame, threshold: float = 0.9) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; ``n_chars``, if there, follows the text."""
    weights = train(with_candidates(docs, []))
    names = docs.columns
    found = with_candidates(docs, names)
    text = F.coalesce(F.col("row")["text"], F.lit(""))
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(state: Column, c: Column) -> Column:
        fresh = c["start"] >= state["at"]
        piece = F.concat(state["out"], F.substring(text, (state["at"] + 1).cast("int"), (c["start"] - state["at"]).cast("int")), F.element_at(labels, c["kind"] + 1))
        return F.struct(F.greatest(state["at"], c["end"]).alias("at"), F.when(fresh, piece).otherwise(state["out"]).alias("out"))

    rest = lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text)))
    found = found.withColumn("_found", _kept(F.col("_found"), weights, threshold))
    found = found.withColumn("_changed", F.when(F.size("_found") > 0, F.aggregate("_found", start, step, rest)))
    new = {"text": F.coalesce(F.col("_changed"), F.col("row")["text"])}
    if "n_chars" in names:
        new["n_chars"] = F.when(F.col("_changed").isNotNull(), F.length("_changed").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row")["n_chars"])
    return found.select(*[new.get(c, F.col("row")[c]).alias(c) for c in names])


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
