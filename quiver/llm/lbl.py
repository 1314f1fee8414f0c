"""Language-model scoring: a log-bilinear neural model trained with noise-contrastive estimation.

The model predicts a token from the two before it: context vector q = r[w1] * c1 + r[w2] * c2 (element-wise
context weights), score s(w) = q . t[w] + b[w]. The softmax has levels, each normalised exactly. The head is
the ``vocab`` most frequent training tokens, and one entry for all other words; the end of a text is a token.
The other frequent words (the tail) lie in classes of about the square root of their number, ordered by
ending and frequency, so the classes grow with the counts: P(w | w1, w2) = P(other | w1, w2) *
P(class | other, w1, w2) * P(w | class, w1, w2). All further words, unseen ones included, lie in ``ENDINGS``
more classes by their last letters, which carry language and grammar; such a word gets the probability of its
class in the context times its share of the smoothed counts of the class (one unseen word a class), so the
probabilities add up to 1. In contexts, words outside the head are told apart by these endings.

1. Count: every task adds up its training tokens; counts of all words are exact and cover all documents.
   A word's ending goes with its count.
2. Frequent words (at most ``heavy`` of them, found from a histogram of counts) are broadcast with their
   counts; all others stay in a table and are joined.
3. Train: every partition runs mini-batch NCE from the same start over all its training tokens (each
   batch's distinct contexts weighted by their count, noise drawn from the unigram distribution), and the
   partitions' parameters are averaged by their tokens, element by element, in Spark (parameter mixing).
4. Score: per slice the distinct contexts are normalised with one matrix product, then looked up; rare
   words go, pre-aggregated per document, to a join with the table of counts.

Defined cases: a null or empty text is the end token alone. Rows with the same doc_id are documents of
their own; a null doc_id is held out if the crc32 of nothing were divisible, i.e. never: it trains. With
no training text all counts are 0 and every word is unseen. Extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from quiver.llm import textops as T
from quiver.session import materialize, ship_package

END = np.array([0x5EED0E9D0FE4D001], dtype=T.U64)
ENDINGS = 64
_FLUSH = 1 << 21
_FIRST_BITS = 18
PLANNED = 32  # batches of training that are laid out at once
KNOWN_PAIRS = 1 << 21  # of contexts whose normalisers a worker keeps, 8 bytes each


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of all texts, each text closed by the end token; tokens per text; which tokens are words."""
    parts = [T.word_table(texts.slice(a, b - a)) for a, b in T.slices(texts, T.PIECE_BYTES)]
    per_doc = np.concatenate([w.per_doc for w in parts] or [np.zeros(0, np.int64)]) + 1
    out = np.empty(int(per_doc.sum()), T.U64)
    ends = np.cumsum(per_doc) - 1
    is_end = np.zeros(out.size, bool)
    is_end[ends] = True
    out[is_end] = END
    out[~is_end] = np.concatenate([w.hash for w in parts] or [np.zeros(0, T.U64)])
    return out, per_doc, ~is_end


def trains(ids: pa.Array) -> np.ndarray:
    """False for held-out documents: crc32 of doc_id as text divisible by 10."""
    return np.fromiter((i is None or zlib.crc32(str(i).encode()) % 10 != 0 for i in ids.to_pylist()), bool, len(ids))


def endings(texts: pa.Array, is_word: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Class of the last letters of the tokens marked in ``which``; 0 for the end token and all others."""
    out = np.zeros(len(is_word), np.int8)
    which = which & is_word
    out[which] = T.word_ends(texts, ENDINGS, which[is_word])
    return out


def _count(batches):
    held, size = [], 0

    def merged():
        word = np.concatenate([w for w, _, _ in held])
        order = np.argsort(word, kind="stable")
        word, ending, count = word[order], np.concatenate([e for _, e, _ in held])[order], np.concatenate([c for _, _, c in held])[order]
        new = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        return word[new], ending[new], np.add.reduceat(count, new)

    def out(word, ending, count):
        for i in range(0, len(word), 1 << 17):
            k = slice(i, i + (1 << 17))
            yield pa.RecordBatch.from_arrays([pa.array(word[k].view(np.int64)), pa.array(ending[k]), pa.array(count[k])], ["word", "ending", "c"])

    for batch in batches:
        batch = batch.filter(pa.array(trains(batch.column(0))))
        for a, b in T.slices(batch.column(1)):
            texts = batch.column(1).slice(a, b - a)
            words, _, is_word = tokens(texts)
            order = np.argsort(words)
            words = words[order]
            new = np.flatnonzero(np.append(True, words[1:] != words[:-1]))
            first = order[new]  # any occurrence: the ending depends on the word alone
            which = np.zeros(len(words), bool)
            which[first] = True
            held.append((words[new], endings(texts, is_word, which)[first], np.diff(np.append(new, len(words)))))
            size += new.size
        if size > _FLUSH:
            held = [merged()]
            size = held[0][0].size
            if size > _FLUSH // 2:
                yield from out(*held[0])
                held, size = [], 0
    if held:
        yield from out(*merged())


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, ending, c): ending class and training count of every distinct token hash."""
    return docs.mapInArrow(T.lean(_count), "word long, ending byte, c long").groupBy("word").agg(F.min("ending").alias("ending"), F.sum("c").alias("c"))


class Shared:
    """What every task needs: counts of the frequent words, the head's words by id, and the classes of all others.

    ``ending`` holds the ending class of every frequent word, ``rest`` tokens and words of all that are not
    frequent, by ending class; left out, they count as class 0."""

    def __init__(self, heavy: np.ndarray, heavy_counts: np.ndarray, total: int, distinct: int, vocab: int,
                 ending: np.ndarray | None = None, rest: np.ndarray | None = None) -> None:
        order = np.argsort(heavy)
        self.heavy, self.counts = heavy[order], heavy_counts[order]
        self.endings = np.zeros(len(heavy), np.int8) if ending is None else ending[order].astype(np.int8)
        self.total, self.distinct = total, distinct
        rank = np.lexsort((self.heavy, -self.counts))[:vocab]
        self.size = len(rank) + 1  # id 0: any other word
        self.start = self.size + ENDINGS  # in contexts: before the text
        self.ids = np.zeros(len(heavy), np.int32)
        self.ids[rank] = np.arange(1, self.size)
        self.vocab_counts = np.concatenate(([max(total - int(self.counts[rank].sum()), 0) + 1], self.counts[rank])).astype(float)
        self.other_tokens = total - int(self.counts[rank].sum())
        self.other_words = distinct - len(rank)
        # the tail: frequent words outside the head, by ending and frequency
        ending = np.zeros(len(heavy), np.int64) if ending is None else ending[order].astype(np.int64)
        tail = np.flatnonzero(self.ids == 0)
        tail = tail[np.lexsort((self.heavy[tail], -self.counts[tail], ending[tail]))]
        self.n_tail = len(tail)
        self.per_class = max(1, math.isqrt(self.n_tail))
        self.tail_classes = -(-self.n_tail // self.per_class)
        self.tail_at = np.full(len(heavy), -1, np.int32)
        self.tail_at[tail] = np.arange(self.n_tail)
        self.tail_counts = self.counts[tail].astype(float)
        if rest is None:
            rest = np.zeros((2, ENDINGS), np.int64)
            rest[:, 0] = self.other_tokens - int(self.counts[tail].sum()), self.other_words - self.n_tail
        self.rest_mass = rest[0] + 0.1 * (rest[1] + 1)  # one unseen word an ending
        starts = np.arange(0, self.n_tail, self.per_class)
        self.class_counts = np.concatenate((np.add.reduceat(self.tail_counts, starts) if self.n_tail else np.zeros(0), self.rest_mass))
        self.targets = self.size + self.n_tail + ENDINGS
        # where the hashes with the same first ``_FIRST_BITS`` bits begin
        firsts = (self.heavy >> T.U64(64 - _FIRST_BITS)).astype(np.int64)
        self.begin = np.searchsorted(firsts, np.arange((1 << _FIRST_BITS) + 1)).astype(np.int32)

    def look_up(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of every word in ``heavy`` (-1: not frequent), and its vocabulary id."""
        place = np.full(len(words), -1, np.int64)
        if not len(self.heavy):
            return place, np.zeros(len(words), np.int64)
        first = (words >> T.U64(64 - _FIRST_BITS)).astype(np.int64)
        at, end = self.begin.take(first), self.begin.take(first + 1)
        rows, left = None, np.flatnonzero(at < end)
        while left.size:  # as often as the most hashes begin alike
            at, end = at[left], end[left]
            words = words[left]
            rows = left if rows is None else rows[left]
            hit = self.heavy.take(at) == words
            place[rows[hit]] = at[hit]
            at += 1
            left = np.flatnonzero(~hit & (at < end))
        return place, np.where(place >= 0, self.ids.take(place), 0)

    def endings_of(self, texts: pa.Array, is_word: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Ending class of every token: known for frequent words, read from the text for all others."""
        out = endings(texts, is_word, place < 0)
        at = np.flatnonzero(place >= 0)
        out[at] = self.endings[place[at]]
        return out

    def target(self, place: np.ndarray, ids: np.ndarray, ending: np.ndarray) -> np.ndarray:
        """What is predicted: a word of the head, a word of the tail, or the ending of any other word."""
        out = np.where(ids > 0, ids, self.size + self.n_tail + ending.astype(np.int64))
        at = np.flatnonzero((ids == 0) & (place >= 0))
        out[at] = self.size + self.tail_at[place[at]]
        return out

    def levels(self, target: np.ndarray) -> list[tuple[np.ndarray | slice, np.ndarray]]:
        """Rows and entries of each level: the head for all, classes for words outside it, words for the tail."""
        other = np.flatnonzero(target >= self.size)
        code = target[other] - self.size
        tail = code < self.n_tail
        return [(slice(None), np.where(target < self.size, target, 0)),
                (other, np.where(tail, code // self.per_class, code - self.n_tail + self.tail_classes)), (other[tail], code[tail])]


class Model:
    """Parameters: context vectors r, context weights c1 and c2, and target vectors t and biases b of the levels
    (k: classes, w: words of the tail)."""

    def __init__(self, r, t, c1, c2, b, tk, bk, tw, bw) -> None:
        self.r, self.t, self.c1, self.c2, self.b = r, t, c1, c2, b
        self.tk, self.bk, self.tw, self.bw = tk, bk, tw, bw
        self.known: dict[int, np.ndarray] = {}
        self.vectors: list[np.ndarray] = []

    @classmethod
    def start(cls, shared: Shared, dims: int, seed: int) -> "Model":
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.standard_normal(shape, np.float32) * np.float32(0.1)
        log = lambda counts: np.log(counts / max(counts.sum(), 1)).astype(np.float32)
        return cls(draw(shared.start + 1, dims), draw(shared.size, dims), np.ones(dims, np.float32) * 0.5, np.ones(dims, np.float32), log(shared.vocab_counts),
                   draw(len(shared.class_counts), dims), log(shared.class_counts), draw(shared.n_tail, dims), log(shared.tail_counts))

    def arrays(self):
        return [self.r, self.t, self.c1, self.c2, self.b, self.tk, self.bk, self.tw, self.bw]

    def pack(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays()])

    def unpack(self, flat: np.ndarray) -> "Model":
        out, at = [], 0
        for a in self.arrays():
            out.append(flat[at : at + a.size].reshape(a.shape).astype(np.float32))
            at += a.size
        return Model(*out)

    def context(self, w1: np.ndarray, w2: np.ndarray) -> np.ndarray:
        return self.r[w1] * self.c1 + self.r[w2] * self.c2

    def targets(self, shared: Shared) -> list[np.ndarray]:
        """Target vectors of the levels, each with its bias, and the longest vector and bias of every class of the tail.
        Put together once: not for a model in training."""
        if not self.vectors:
            starts = np.arange(0, shared.n_tail, shared.per_class)
            longest = [np.maximum.reduceat(x, starts) if shared.n_tail else np.zeros(0) for x in (lengths(self.tw), np.abs(self.bw))]
            self.vectors = [joined(self.t, self.b), joined(self.tk, self.bk), joined(self.tw, self.bw), *longest]
        return self.vectors

    def log_normalisers(self, w1: np.ndarray, w2: np.ndarray) -> np.ndarray:
        return log_sums(joined(self.context(w1, w2), 1), joined(self.t, self.b))

    def known_sums(self, pairs: np.ndarray, context: np.ndarray, targets: np.ndarray, level: int) -> np.ndarray:
        """``log_sums`` of distinct contexts, by ``pairs``; those met before by this worker are looked up, in a table of
        all pairs (none if there are more than ``KNOWN_PAIRS``)."""
        room = len(self.r) ** 2
        if room > KNOWN_PAIRS:
            return log_sums(context, targets)
        if level not in self.known:
            self.known[level] = np.full(room, np.nan)
        found = self.known[level][pairs]
        new = np.flatnonzero(np.isnan(found))
        if new.size:
            found[new] = self.known[level][pairs[new]] = log_sums(context[new], targets)
        return found


def joined(x: np.ndarray, last) -> np.ndarray:
    """Vectors with one more column: the biases of targets, or 1 for contexts."""
    return np.column_stack((x, np.broadcast_to(np.float32(last), len(x))))


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def longest(x: np.ndarray) -> float:
    return float(lengths(x).max()) if len(x) else 0.0


def log_sums(q: np.ndarray, t: np.ndarray, reach: float | None = None) -> np.ndarray:
    """log of the sum of exp(q . t) for every row of ``q`` over all rows of ``t``, in pieces that fit the processor's
    cache. ``reach``: what no score exceeds, in absolute value; the largest score is only looked for if that is much."""
    out = np.empty(len(q))
    reach = longest(q) * longest(t) if reach is None else reach
    step = max(16, (1 << 16) // max(len(t), 1))
    one = np.ones(len(t), np.float32)
    for a in range(0, len(q), step):
        s = q[a : a + step] @ t.T
        if reach < 80 and len(t) < 2048:  # neither exp nor its sum can leave the range of 32 bits
            np.exp(s, out=s)
            out[a : a + step] = np.log(s @ one)
            continue
        high = s.max(axis=1)
        s -= high[:, None]
        np.exp(s, out=s)
        out[a : a + step] = high + np.log(s.sum(axis=1))
    return out


def contexts(ids: np.ndarray, ending: np.ndarray, per_doc: np.ndarray, shared: "Shared") -> tuple[np.ndarray, np.ndarray]:
    """The two tokens before every token: ids of the head, classes of other words, or ``shared.start`` before the text."""
    start = shared.start
    ids = np.where(ids == 0, shared.size + ending.astype(np.int64), ids)
    first = np.zeros(len(ids), bool)
    first[np.cumsum(per_doc) - per_doc] = True
    w2 = np.append(start, ids[:-1])
    w2[first] = start
    w1 = np.append(start, w2[:-1])
    w1[first] = start
    return w1, w2


class Runs(NamedTuple):
    """Runs of equal keys in batches: where each begins, and the runs with more than one element, which need a sum:
    their places among the runs, their elements, and where each begins among these. All count within the batch."""

    first: list[np.ndarray]
    many: list[np.ndarray]
    rows: list[np.ndarray]
    begin: list[np.ndarray]
    bounds: np.ndarray  # of the batches among all runs
    new: np.ndarray  # the first elements of all runs
    run: np.ndarray  # of every element, over all batches

    @classmethod
    def of(cls, keys: np.ndarray, bounds: np.ndarray) -> "Runs":
        """``keys``: in order; no run crosses the ``bounds`` of the batches."""
        new = np.append(True, keys[1:] != keys[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(keys)))
        many = np.flatnonzero(count > 1)
        rows = np.flatnonzero(~new | np.append(~new[1:], False))
        begin = np.cumsum(count[many]) - count[many]
        runs, row = np.searchsorted(first, bounds), np.searchsorted(rows, bounds)
        some = np.searchsorted(many, runs)
        return cls(within(first, runs, bounds), within(many, some, runs), within(rows, row, bounds), within(begin, some, row), runs, first, np.cumsum(new) - 1)

    def sums(self, b: int, x: np.ndarray, order: np.ndarray | None = None) -> np.ndarray:
        """Sums of the rows of ``x`` (in the given order) over every run of a batch."""
        first, many, rows = self.first[b], self.many[b], self.rows[b]
        if order is not None:
            first, rows = order.take(first), order.take(rows)
        out = x.take(first, axis=0)
        if many.size:
            out[many] = np.add.reduceat(x.take(rows, axis=0), self.begin[b], axis=0)
        return out


def within(x: np.ndarray, cuts: np.ndarray, less: np.ndarray) -> list[np.ndarray]:
    """``x`` cut into batches, each without the start of its batch in ``less``."""
    x = x - np.repeat(less[:-1], np.diff(cuts))
    cuts = cuts.tolist()
    return [x[a:b] for a, b in zip(cuts, cuts[1:])]


def nce_epoch(model: Model, adagrad: list[np.ndarray], shared: Shared, w1, w2, w, weight, rng, noise: int, rate: float, batch: int) -> None:
    """One pass over weighted triples in random order. All targets of a batch share a level's noise words.

    The levels' targets are rows of one table, the head's entry for all other words after its words. What does not
    depend on the parameters (order, noise words, runs of equal rows) is found for ``PLANNED`` batches at once. A batch
    is sorted by target (the head, the tail, endings), so that a level's rows and a target's rows lie together; equal
    noise words are one column with their number. A bias is the last column of its vectors, which meet contexts that
    end with 1."""
    order, columns = rng.permutation(len(w)), np.stack((w1, w2, w, weight), axis=1)
    params, dims = model.arrays(), model.r.shape[1]
    wide = lambda x, last: np.column_stack((x, np.broadcast_to(np.float32(last), len(x))))
    turned = lambda parts, by: [np.roll(parts[0], by, axis=0), *parts[1:]]
    kinds = ((shared.vocab_counts, 1, 4), (shared.class_counts, 5, 6), (shared.tail_counts, 7, 8))
    starts = np.cumsum([0, *(len(counts) for counts, _, _ in kinds)])
    shares = [counts / max(counts.sum(), 1e-9) for counts, _, _ in kinds]
    cumulative = [np.cumsum(p) for p in shares]
    for c in cumulative:
        c[-1:] = 1.0
    log_noise = np.log(noise * np.concatenate(turned(shares, -1))).astype(np.float32)
    values, squares = (np.concatenate(turned([wide(x[t], x[b]) for _, t, b in kinds], -1)) for x in (params, adagrad))
    r, weights_of = wide(model.r, 1), wide(np.stack((model.c1, model.c2)), 0)
    weights_of[0, dims] = 1  # contexts end with 1 + 0
    r_squares, w_squares = wide(adagrad[0], 1), wide(np.stack((adagrad[2], adagrad[3])), 1)

    def step(values, squares, i, grad):
        own = squares.take(i, axis=0)
        own += grad * grad
        squares[i] = own
        np.sqrt(own, out=own)
        grad *= rate
        grad /= own
        grad += values.take(i, axis=0)
        values[i] = grad

    def pieces(x, cuts):
        cuts = cuts.tolist()
        return [x[a:b] for a, b in zip(cuts, cuts[1:])]

    for a in range(0, len(order), batch * PLANNED):
        triples = columns.take(order[a : a + batch * PLANNED], axis=0)
        n, table = len(triples), len(values)
        of = np.arange(n) // batch
        batches = int(of[-1]) + 1
        bounds = np.minimum(np.arange(batches + 1) * batch, n)
        bits = n.bit_length()
        key = (triples[:, 2] + of * shared.targets) << bits | np.arange(n)
        key.sort()
        c1, c2, target, weights = np.ascontiguousarray(triples.take(key & ((1 << bits) - 1), axis=0).T)
        weights = weights.astype(np.float32)
        scales = np.float32(1) / np.add.reduceat(weights, bounds[:-1])

        # targets of all levels: batch by batch, level by level
        found = shared.levels(target)
        rows = np.concatenate((np.arange(n), found[1][0], found[2][0]))
        group = of[rows] * 3 + np.repeat(np.arange(3), [len(t) for _, t in found])
        o = np.argsort(group.astype(np.uint16), kind="stable")
        rows, group = rows[o], group[o]
        entry = np.concatenate([(found[0][1] - 1) % shared.size, *(t + s for (_, t), s in zip(found[1:], starts[1:]))])[o]
        cuts = np.searchsorted(group, np.arange(3 * batches + 1))
        sizes = np.diff(cuts).reshape(batches, 3).tolist()
        key = group * table + entry
        own = Runs.of(key, cuts[::3])
        own_key, own_rows = key[own.new], entry[own.new]
        places = within(own.run, cuts[::3], own.bounds)
        own_weight, own_noise = pieces(weights[rows], cuts[::3]), pieces(log_noise[entry], cuts[::3])

        # noise words of every level that occurs in a batch
        groups = np.flatnonzero(np.diff(cuts))
        u = rng.random((len(groups), noise))
        u.sort(axis=1)
        drawn = np.empty(u.shape, np.int64)
        for level in range(3):
            some = groups % 3 == level
            drawn[some] = np.searchsorted(cumulative[level], u[some]) + starts[level]
        drawn = (groups[:, None] * table + drawn).ravel()
        new = np.flatnonzero(np.append(True, drawn[1:] != drawn[:-1]))
        times, drawn = np.diff(np.append(new, drawn.size)).astype(np.float32)[:, None], drawn[new]
        group, word = drawn // table, drawn % table
        word = np.where(word < shared.size, (word - 1) % shared.size, word)
        drawn = group * table + word
        cuts = np.searchsorted(group, np.arange(3 * batches + 1))
        widths = np.diff(cuts).reshape(batches, 3).tolist()
        cuts = cuts[::3]
        times, drawn_noise = pieces(times, cuts), pieces(log_noise[word], cuts)
        place = np.minimum(np.searchsorted(own_key, drawn), len(own_key) - 1)
        only = own_key[place] != drawn  # not targets too: these rows follow those of the targets
        extra = np.append(0, np.cumsum(only))
        place = np.where(only, extra[:-1] + np.repeat(own.bounds[1:] - extra[cuts[:-1]], np.diff(cuts)), place)
        place = within(place, cuts, own.bounds)
        touched = [np.concatenate(x) for x in zip(pieces(own_rows, own.bounds), pieces(word[only], extra[cuts]))]

        # contexts: rows of the first and second word, added up
        twice = np.concatenate((np.arange(n), np.arange(n) + np.diff(bounds)[of])) - np.tile(bounds[of], 2)
        bits = (2 * batch).bit_length()
        key = (np.tile(of, 2) * len(r) + np.concatenate((c1, c2))) << bits | twice
        key.sort()
        sorts = pieces(key & ((1 << bits) - 1), 2 * bounds)
        key >>= bits
        near = Runs.of(key, 2 * bounds)
        near_rows = within(key[near.new], near.bounds, np.arange(batches + 1) * len(r))

        for b in range(batches):
            k, scale = slice(bounds[b], bounds[b + 1]), scales[b]
            less_g = -weights[k, None]
            r1, r2 = r.take(c1[k], axis=0), r.take(c2[k], axis=0)
            q = r1 * weights_of[0]
            q += r2 * weights_of[1]
            (m0, m1, m2), (d0, d1, d2) = sizes[b], widths[b]
            mine = values.take(touched[b], axis=0)
            td, tt = mine.take(place[b], axis=0), mine.take(places[b], axis=0)
            at = m0 - m1  # where the words outside the head begin
            q_own = np.concatenate((q, q[at:], q[at : at + m2]))
            # log(k p_n) enters as the log-odds of noise; the model's own scores are taken as log-probabilities
            s = np.einsum("ij,ij->i", q_own, tt)
            s -= own_noise[b]
            less = -td
            less[:, dims] += drawn_noise[b]
            odds = np.empty(m0 * d0 + m1 * d1 + m2 * d2, np.float32)
            noisy, blocks, cell = np.empty_like(td), [], 0
            for m, some, t, d in ((m0, slice(0, m0), slice(0, m0), slice(0, d0)), (m1, slice(at, m0), slice(m0, m0 + m1), slice(d0, d0 + d1)),
                                  (m2, slice(at, at + m2), slice(m0 + m1, m0 + m1 + m2), slice(d0 + d1, d0 + d1 + d2))):
                if m:
                    gn = odds[cell : cell + m * (d.stop - d.start)].reshape(m, -1)
                    cell += gn.size
                    np.matmul(q[some], less[d].T, out=gn)
                    blocks.append((some, t, d, gn))
            with np.errstate(over="ignore"):  # the gradient is then 0
                np.exp(s, out=s)
                np.exp(odds, out=odds)
            s += 1
            gs = (own_weight[b] / s)[:, None]  # gradient of log sigmoid(s)
            odds += 1
            td *= times[b]
            tt *= gs
            for some, t, d, gn in blocks:
                np.divide(less_g[some], gn, out=gn)
                np.matmul(gn.T, q[some], out=noisy[d])
                tt[t] += gn @ td[d]
            gq = tt[:m0]
            for some, t, *_ in blocks[1:]:
                gq[some] += tt[t]
            gq[:, dims] = 0
            gq *= scale
            q_own *= gs
            grad = np.zeros_like(mine)
            sums = own.sums(b, q_own)
            grad[: len(sums)] = sums
            noisy *= times[b]
            grad[place[b]] += noisy
            grad *= scale
            own_squares = squares.take(touched[b], axis=0)
            own_squares += grad * grad
            squares[touched[b]] = own_squares
            np.sqrt(own_squares, out=own_squares)
            grad *= rate
            grad /= own_squares
            mine += grad
            values[touched[b]] = mine
            grad = np.empty((2 * m0, dims + 1), np.float32)
            np.multiply(gq, weights_of[0], out=grad[:m0])
            np.multiply(gq, weights_of[1], out=grad[m0:])
            step(r, r_squares, near_rows[b], near.sums(b, grad, sorts[b]))
            grad = np.empty_like(weights_of)
            np.einsum("ij,ij->j", r1, gq, out=grad[0])
            np.einsum("ij,ij->j", r2, gq, out=grad[1])
            w_squares += grad * grad
            grad *= rate
            grad /= np.sqrt(w_squares)
            weights_of += grad
    model.r[:], model.c1[:], model.c2[:] = r[:, :dims], weights_of[0, :dims], weights_of[1, :dims]
    adagrad[0][:], adagrad[2][:], adagrad[3][:] = r_squares[:, :dims], w_squares[0, :dims], w_squares[1, :dims]
    for to, table in ((params, values), (adagrad, squares)):
        for (_, t, b), found in zip(kinds, turned(np.split(table, starts[1:-1]), 1)):
            to[t][:], to[b][:] = found[:, :dims], found[:, dims]


def train(docs: DataFrame, shared, dims: int = 24, noise: int = 128, rate: float = 0.1, batch: int = 512, seed: int = 11) -> Model:
    """Parameters mixed over the partitions of the training documents."""

    def run(batches):
        s = shared.value
        model = Model.start(s, dims, seed)
        adagrad = [np.full(a.shape, 1e-6, np.float32) for a in model.arrays()]
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        base = s.start + 1
        seen, held, size = 0, [], 0

        def learn():
            keys = np.concatenate([k for k, _ in held])
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], np.concatenate([c for _, c in held])[order]
            new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            keys, counts = keys[new], np.add.reduceat(counts, new)
            pairs = keys // s.targets
            nce_epoch(model, adagrad, s, pairs // base, pairs % base, keys % s.targets, counts, rng, noise, rate, batch)

        for arrow in batches:
            arrow = arrow.filter(pa.array(trains(arrow.column(0))))
            for a, b in T.slices(arrow.column(1)):
                texts = arrow.column(1).slice(a, b - a)
                words, per_doc, is_word = tokens(texts)
                place, ids = s.look_up(words)
                ending = s.endings_of(texts, is_word, place)
                w1, w2 = contexts(ids, ending, per_doc, s)
                keys, counts = np.unique((w1.astype(np.int64) * base + w2) * s.targets + s.target(place, ids, ending), return_counts=True)
                held.append((keys, counts))
                size += keys.size
                seen += len(ids)
                if size > 1 << 20:
                    learn()
                    held, size = [], 0
        if held:
            learn()
        if not seen:
            return
        flat = model.pack()
        for block in range(0, len(flat), 4096):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([seen], pa.int64()),
                                              pa.array([flat[block : block + 4096].tobytes()], pa.binary())], ["block", "seen", "part"])

    def add(key, table):
        seen = table.column("seen").to_pylist()
        total = sum(np.frombuffer(x.as_py(), np.float32) * float(n) for x, n in zip(table.column("part"), seen))
        mean = (total / sum(seen)).astype(np.float32)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "part": pa.array([mean.tobytes()], pa.binary())})

    parts = docs.mapInArrow(T.lean(run), "block long, seen long, part binary")
    mixed = parts.groupBy("block").applyInArrow(add, "block long, part binary").collect()  # the model's size: some 13 MB at most
    start = Model.start(shared.value, dims, seed)
    mixed.sort(key=lambda r: r["block"])
    if not mixed:
        return start
    return start.unpack(np.concatenate([np.frombuffer(r["part"], np.float32) for r in mixed]))


def log_probabilities(s: Shared, m: Model, w1: np.ndarray, w2: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log P(target | w1, w2): of the word in the head or tail, else of the class of endings."""
    base = s.start + 1
    pairs, at = np.unique(w1 * base + w2, return_inverse=True)
    context = joined(m.context(pairs // base, pairs % base), 1)
    heads, kinds, tails, far, bias = m.targets(s)
    size = lengths(context[:, :-1])
    out = np.zeros(len(target))
    (_, head), (other, classes), (tail, words) = s.levels(target)

    def add(rows, entries, t):
        for a in range(0, len(rows), 1 << 13):
            k = rows[a : a + (1 << 13)]
            out[k] += np.einsum("ij,ij->i", context.take(at[k], axis=0), t.take(entries[a : a + (1 << 13)], axis=0))

    add(np.arange(len(target)), head, heads)
    out -= m.known_sums(pairs, context, heads, 0)[at]
    add(other, classes, kinds)
    some, place = np.unique(at[other], return_inverse=True)
    out[other] -= m.known_sums(pairs[some], context[some], kinds, 1)[place]
    add(tail, words, tails)
    own = words // s.per_class
    order = np.argsort(own.astype(np.uint16) if s.tail_classes < 1 << 16 else own, kind="stable")
    rows = tail[order]
    cuts = np.searchsorted(own[order], np.arange(s.tail_classes + 1))
    for kind in np.flatnonzero(np.diff(cuts)):
        k = rows[cuts[kind] : cuts[kind + 1]]
        own = at[k]
        out[k] -= log_sums(context.take(own, axis=0), tails[kind * s.per_class : (kind + 1) * s.per_class], size[own].max() * far[kind] + bias[kind])
    return out


def score_slice(s: Shared, m: Model, texts: pa.Array):
    """Per text: tokens, known frequent tokens, base sum and model sum without rare words, and the rare words."""
    words, per_doc, is_word = tokens(texts)
    n = len(texts)
    place, ids = s.look_up(words)
    base_log = np.log10((s.counts + 0.1) / (s.total + 0.1 * (s.distinct + 1)))
    frequent = place >= 0
    base = np.zeros(len(words))
    base[frequent] = base_log[place[frequent]]
    ending = s.endings_of(texts, is_word, place)
    w1, w2 = contexts(ids, ending, per_doc, s)
    base_id = s.start + 1
    keys, inverse = np.unique((w1.astype(np.int64) * base_id + w2) * s.targets + s.target(place, ids, ending), return_inverse=True)
    pairs = keys // s.targets
    model = (log_probabilities(s, m, pairs // base_id, pairs % base_id, keys % s.targets) / np.log(10))[inverse]
    model[~frequent] -= np.log10(s.rest_mass)[ending[~frequent]]  # the log of the count is added by the join
    doc = np.repeat(np.arange(n), per_doc)
    rare_doc, rare = doc[~frequent], words[~frequent]
    values, counts, rare_per_doc = T.distinct_per_doc(rare_doc, rare, n)
    return per_doc, T.segment_sum(frequent.astype(np.int64), per_doc), T.segment_sum(base, per_doc), T.segment_sum(model, per_doc), values, counts, rare_per_doc


def _first_pass(shared, model):
    def run(batches):
        serial = TaskContext.get().partitionId() << 36
        for batch in batches:
            for a, b in T.slices(batch.column(1)):
                n, known, base, score, values, counts, per_doc = score_slice(shared.value, model.value, batch.column(1).slice(a, b - a))
                ends = pa.array(np.concatenate(([0], np.cumsum(per_doc))).astype(np.int32))
                rows = pa.array(np.arange(serial, serial + (b - a)))
                serial += b - a
                yield pa.RecordBatch.from_arrays([
                    rows, batch.column(0).slice(a, b - a), pa.array(~trains(batch.column(0).slice(a, b - a))), pa.array(n), pa.array(known), pa.array(base), pa.array(score),
                    pa.ListArray.from_arrays(ends, pa.array(values.view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(counts.astype(np.int32))),
                ], ["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "words", "times"])

    return run


def prepare(docs: DataFrame, vocab: int, heavy: int) -> tuple[DataFrame, Shared]:
    """Counts of all training words, and the broadcast part: at most ``heavy`` most frequent words."""
    spark = docs.sparkSession
    counts = materialize(word_counts(docs))
    levels = counts.groupBy(F.floor(F.log2("c") * 16).cast("int").alias("level")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least"), F.sum("c").alias("c")).collect()
    total, distinct, taken, least = sum(r["c"] for r in levels), sum(r["n"] for r in levels), 0, None
    for r in sorted(levels, key=lambda r: -r["level"]):  # some hundred levels
        taken += r["n"]
        if taken > heavy:
            break
        least = r["least"]
    frequent = counts.where(F.col("c") >= least).toArrow() if least is not None else None
    words = frequent.column("word").to_numpy().view(T.U64) if frequent is not None else np.zeros(0, T.U64)
    c = frequent.column("c").to_numpy() if frequent is not None else np.zeros(0, np.int64)
    ending = frequent.column("ending").to_numpy() if frequent is not None else np.zeros(0, np.int8)
    rare = counts.where(F.col("c") < least) if least is not None else counts
    rest = np.zeros((2, ENDINGS), np.int64)
    for r in rare.groupBy("ending").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect():  # a row an ending
        rest[:, r["ending"]] = r["c"], r["n"]
    return rare.select("word", "c"), Shared(words, c, total, distinct, vocab, ending, rest)


def score(docs: DataFrame, vocab: int = 1023, heavy: int = 1 << 17, dims: int = 24) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``."""
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rare, found = prepare(docs, vocab, heavy)
    shared = spark.sparkContext.broadcast(found)
    model = spark.sparkContext.broadcast(train(docs, shared, dims))
    rows = materialize(docs.mapInArrow(T.lean(_first_pass(shared, model)), "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, words array<long>, times array<int>"))
    each = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("e")).select("row", F.col("e.words").alias("word"), F.col("e.times").alias("times"))
    each = each.join(rare, "word", "left").select("row", "times", F.coalesce("c", F.lit(0)).alias("c"))
    tail = each.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("tail_known"),
                                   F.sum("times").alias("tail_tokens"), F.sum(F.col("times") * F.log10(F.col("c") + 0.1)).alias("tail_log"))
    below = float(np.log10(found.total + 0.1 * (found.distinct + 1)))
    got = lambda c: F.coalesce(c, F.lit(0))
    return rows.drop("words", "times").join(tail, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + got("tail_known")).alias("n_known"), F.lit(found.total).cast("long").alias("train_tokens"),
        (F.col("base") + got("tail_log") - got("tail_tokens") * below).alias("base_score"), (F.col("score") + got("tail_log")).alias("score"))


def op8_lbl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
