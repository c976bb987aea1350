"""Word-level memo over a public tokenizer.

The tokenizer that is used here normalises white space away, and none of its pre-token patterns reaches across it. So the ids of a text
are the ids of its white-space separated words, one after the other. Arrow splits and dictionary-encodes the words of a slice of the
texts; Python sees each distinct word of a slice once, and the library each word part that the worker hasn't met.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are split at once.
SLICE = 12 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Generations:
    """A dictionary of at most two times ``limit`` entries; those met again outlive the others."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def get(self, key):
        if (hit := self.young.get(key)) is None and (hit := self.old.get(key)) is not None:
            self.put(key, hit)
        return hit

    def put(self, key, value) -> None:
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        self.young[key] = value


class WordMemo:
    #: ASCII words without apostrophes and special tokens fall into runs of letters, single digits and runs of the rest.
    ASCII_PARTS = re.compile(rb"[a-z]+|[0-9]|[^a-z0-9]+")
    #: Marks that stay pre-tokens of their own behind a letter.
    MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, path: str, limit: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.parts = Generations(limit)
        names = self.library.get_vocab()
        self.ends = np.zeros(max(names.values(), default=0) + 1, bool)
        self.ends[[i for k, i in names.items() if k.endswith("</w>")]] = True

    def _ask(self, keys: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Ids of each key. Plain Latin words are one pre-token each, so that many share one call and the word-end marks part them."""
        plain, odd = [], []
        for k in keys:
            s = k.decode("utf-8", "replace")
            (plain if s.isalpha() and max(s) < "ɐ" else odd).append((k, s))
        for at in range(0, len(plain), 512):
            part = plain[at : at + 512]
            ids = np.array(self.library.encode(" ".join(s for _, s in part), add_special_tokens=False).ids, "<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(stops) != len(part):  # never seen; the slow way is always right
                odd += part
                continue
            packed = ids.tobytes()
            for (k, _), lo, hi in zip(part, [0, *stops[:-1]], stops):
                yield k, packed[4 * lo : 4 * hi]
        if odd:
            for (k, _), e in zip(odd, self.library.encode_batch_fast([s for _, s in odd], add_special_tokens=False)):
                yield k, np.array(e.ids, "<u4").tobytes()

    def _split(self, word: bytes) -> list[bytes]:
        if b"<|" in word or b"'" in word:  # special tokens and contractions
            return [word]
        low = word.lower()
        if low.isascii():
            return [low] if low.isalpha() else self.ASCII_PARTS.findall(low)
        stem = low.rstrip(self.MARKS)
        if stem != low and stem and (last := stem.decode("utf-8", "replace")[-1]).isalpha() and last < "ɐ":
            return [stem, low[len(stem) :]]
        return [low]

    def of(self, words: list[bytes]) -> list[bytes]:
        """The packed little-endian unsigned 32-bit ids of each word."""
        parts = [self._split(w) for w in words]
        known: dict[bytes, bytes] = {}
        new = []
        for key in set().union(*parts):
            if (hit := self.parts.get(key)) is None:
                new.append(key)
            else:
                known[key] = hit
        for key, ids in self._ask(new):
            self.parts.put(key, ids)
            known[key] = ids
        return [known[p[0]] if len(p) == 1 else b"".join([known[k] for k in p]) for p in parts]

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        ids = self.of(words.dictionary.cast(pa.binary()).to_pylist())
        offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
        values = pa.array(np.frombuffer(b"".join(ids), "<u4"))
        taken = pa.ListArray.from_arrays(pa.array(offsets), values).take(words.indices)
        ends = np.asarray(taken.offsets)[np.asarray(lists.offsets) - lists.offsets[0].as_py()]
        return np.asarray(taken.values)[ends[0] : ends[-1]].astype("<u4"), (ends - ends[0]).astype(np.int64)

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For slices of the texts, in their order: all ids, and where each text's ids begin and end. A null text counts as empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        sizes = np.cumsum(np.asarray(pc.binary_length(texts), dtype=np.int64)) if len(texts) else np.zeros(0, np.int64)
        at = 0
        while at < len(texts):
            done = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, done + SLICE, "right")))
            yield self._slice(texts.slice(at, to - at))
            at = to


_memos: dict[str, WordMemo] = {}


def memo(path: str) -> WordMemo:
    """One for each worker process and tokenizer."""
    if path not in _memos:
        _memos[path] = WordMemo(path)
    return _memos[path]


def encoded(texts: pa.Array, path: str) -> Iterator[np.ndarray]:
    """The ids of each text in turn."""
    for ids, ends in memo(path).encode(texts):
        for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist()):
            yield ids[lo:hi]
