"""Token ids of whole texts inside Spark tasks, with a public byte-level BPE vocabulary.

The vocabulary file is a parameter: ``*.json`` gives the ids of tokenizers, ``*.tiktoken`` those of
tiktoken, which encodes whole texts faster than chunks can be looked up. For ``*.json`` each distinct chunk of
text is encoded once per worker and a bounded memo keeps the ids. Where a json vocabulary is plain byte-level BPE with ids in merge order, tiktoken does the merges of the chunks,
as it takes a third of the time for the same ids (tested), and tokenizers only what can't be cut. Byte-level
BPE never merges across the boundary before a space or newline, so a text may be cut there and the ids
joined. Texts where that does not hold (three white-space characters in a row, two at the end, or the
string of a special token) are encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import SparkSession

from quiver.llm import textops as T

MEMO_ENTRIES = 400_000
MEMO_BYTES = 32 << 20  # of chunks and of ids
_UNSAFE = re.compile(r"\s\s(?:\s|$)|\0")


def ship_vocabulary(spark: SparkSession, path: str) -> str:
    """Send the vocabulary file to all executors; returns its name for ``SparkFiles.get``."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    spark.sparkContext.addFile(path)
    return name


PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""  # fixed: how texts are split before merges


def _flat(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes


def _merging(ranks: dict[bytes, int]):
    """Encoders of chunks and of whole texts; with ``joined`` the chunks all begin with a space or newline and end with neither, so
    that they are encoded as one text and told apart by their bytes."""
    import tiktoken

    library = tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    width = np.zeros(max(ranks.values()) + 1, np.int64)
    for word, rank in ranks.items():
        width[rank] = len(word)

    def encode(chunks: list[str], joined: bool = False) -> tuple[np.ndarray, np.ndarray]:
        if joined and len(chunks) > 1:
            ids = library.encode_to_numpy("".join(chunks), disallowed_special=())
            ends = np.cumsum([len(c.encode()) for c in chunks])
            reach = np.cumsum(width[ids])
            at = np.searchsorted(reach, ends)
            if (reach[np.minimum(at, len(reach) - 1)] == ends).all():
                return ids, np.diff(at + 1, prepend=0)
        return _flat([library.encode_ordinary(c) for c in chunks])

    def whole(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [library.encode_to_numpy(t, disallowed_special=()) for t in texts]
        return np.concatenate([np.zeros(0, np.uint32), *parts]), np.array([p.size for p in parts], np.int64)

    return encode, whole


def _rank_file(path: str) -> dict[bytes, int]:
    import base64

    with open(path, "rb") as lines:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}


def _json_ranks(path: str) -> tuple[dict[bytes, int] | None, list[str]]:
    """Ranks of a json vocabulary, or None if it isn't plain byte-level BPE with ids in merge order; its special tokens."""
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = [t["content"] for t in spec["added_tokens"]]
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and split.get("type") == "ByteLevel" and not split["add_prefix_space"] and split.get("use_regex", True) and not spec["normalizer"] \
        and not model.get("ignore_merges") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix") and not model.get("dropout")
    if not plain:
        return None, special
    # bytes are written as printable characters: themselves, or the next free code points from 256 on
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    to_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    words = {word: i for word, i in model["vocab"].items() if word not in special}
    if any(a >= b for a, b in zip(made, made[1:])) or len(made) + 256 != len(words):
        return None, special
    return {bytes(to_byte[c] for c in word): i for word, i in words.items()}, special


class Encoder:
    """``ids(texts)`` gives (ids of all texts, ids per text) as the library's own encoding would."""

    held: dict[str, "Encoder"] = {}

    def __init__(self, path: str) -> None:
        self.path, self._library = path, None
        ranks, self.special = (_rank_file(path), []) if path.endswith(".tiktoken") else _json_ranks(path)
        self._batch, self._whole = _merging(ranks) if ranks else (self._by_library, None)
        if not path.endswith(".tiktoken"):
            self._whole = None  # the library decides on special tokens and odd white space
        self.place: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(MEMO_ENTRIES + 1, np.int64)
        self.used = self.bytes = 0

    @classmethod
    def of(cls, name: str) -> "Encoder":
        """The worker's encoder for a shipped vocabulary; kept between tasks."""
        path = SparkFiles.get(name)
        if path not in cls.held:
            cls.held[path] = cls(path)
        return cls.held[path]

    def _learn(self, chunks: list[str]) -> None:
        apart = [c for c in chunks if c[:1] not in (" ", "\n") or c[-1:].isspace()]
        skip = set(apart)
        self._keep(apart, False)
        self._keep([c for c in chunks if c not in skip] if skip else chunks, True)

    def _keep(self, chunks: list[str], joined: bool) -> None:
        ids, sizes = self._batch(chunks, joined)
        if self.used + ids.size > self.flat.size:
            self.flat = np.concatenate((self.flat[: self.used], np.zeros(max(self.flat.size, 2 * ids.size), np.uint32)))
        self.flat[self.used : self.used + ids.size] = ids
        k = len(self.place)
        self.place.update(zip(chunks, range(k, k + len(chunks))))
        self.starts[k : k + len(chunks) + 1] = self.used + np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        self.used += ids.size

    def _by_library(self, texts: list[str], joined: bool = False) -> tuple[np.ndarray, np.ndarray]:
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return _flat([e.ids for e in self._library.encode_batch(texts, add_special_tokens=False)])

    def _direct(self, text: str) -> np.ndarray:
        return self._by_library([text])[0]

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self._whole:
            return self._whole(texts)
        chunks, per_text, whole = [], np.zeros(len(texts), np.int64), {}
        for i, text in enumerate(texts):
            if _UNSAFE.search(text) or any(s in text for s in self.special):
                whole[i] = self._direct(text)
                continue
            own = text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
            if not own[0]:
                own = own[1:]
            chunks += own
            per_text[i] = len(own)
        found = list(map(self.place.get, chunks))
        if None in found:
            new = list(dict.fromkeys(c for c, k in zip(chunks, found) if k is None))
            size = sum(map(len, new))
            if len(self.place) + len(new) > MEMO_ENTRIES or self.bytes + size + 4 * self.used > MEMO_BYTES:
                self.place, self.used, self.bytes = {}, 0, 0
                new = list(dict.fromkeys(chunks))
                size = sum(map(len, new))
            self.bytes += size
            if len(new) > MEMO_ENTRIES:  # one slice with that many distinct chunks: encode its texts whole
                parts = [self._direct(t) for t in texts]
                return np.concatenate(parts), np.array([p.size for p in parts])
            self._learn(new)
            found = list(map(self.place.__getitem__, chunks))
        where = np.array(found, np.int64)
        begin, size = self.starts[where], self.starts[where + 1] - self.starts[where]
        total = int(size.sum())
        shift = np.cumsum(size) - size
        ids = self.flat[np.repeat(begin - shift, size) + np.arange(total)] if total else np.zeros(0, np.uint32)
        bounds = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(per_text)))]
        if not whole:
            return ids, np.diff(bounds)
        parts = [whole.get(i, ids[bounds[i] : bounds[i + 1]]) for i in range(len(texts))]
        return np.concatenate(parts), np.array([p.size for p in parts])


def encoded(encoder: Encoder, texts, end_id: int) -> Iterator[np.ndarray]:
    """Ids of every text (null: empty) of an Arrow array, each closed by ``end_id``."""
    ids, sizes = encoder.ids([t or "" for t in texts.to_pylist()])
    ends = np.cumsum(sizes)
    for a, b in zip(ends - sizes, ends):
        yield np.append(ids[a:b], np.uint32(end_id))


T.CACHES.append(Encoder.held.clear)
