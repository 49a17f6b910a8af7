"""Token ids of Arrow text batches with a public tokenizer file.

A tokenizer that splits at white space gives a text the ids of its words one
after another, so a worker encodes a word when it first meets it and remembers
the ids. If the tokenizer also lower-cases, words are lower-cased before they
are looked up; if it splits punctuation from letters, a word and the same word
before a comma share what is remembered. The few texts that may hold the string
of an added token, which need not stand between spaces, are encoded whole.
Texts are worked through in groups of a few megabytes."""

from __future__ import annotations

import ctypes
import os
import re
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa

from sparkvox.llm import hashing

#: Words and word stems that a worker remembers at once; then it forgets them and goes on.
CACHE_WORDS, CACHE_STEMS = 600_000, 800_000
#: Words that are encoded as one text.
JOINED = 50
#: A stem that ends in a letter or digit, and the punctuation behind it. No
#: apostrophe: tokenizers treat what follows one in ways of their own.
_TRAIL = re.compile(rb"(.*[0-9A-Za-z])([.,!?;:%&$#*|]+)")
_MARKS = frozenset(b".,!?;:%&$#*|")


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class WordEncoder:
    """Encodes UTF-8 texts word by word, with the library's ids: the string of
    a special token in a text is that token."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks fill the cores
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        # Folded as texts are before they are searched; what is found too often is only slower.
        self._added = [t.content.lower().encode() for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._lowers = self._pieces("AbZ x") == self._pieces("abz x") and self._tokenizer.normalizer is not None \
            and self._tokenizer.normalizer.normalize_str("AZ") == "az"
        self._splits = self._tokenizer.pre_tokenizer is not None and all(
            self._pieces(f"ab7{p}") == [*self._pieces("ab7"), p] for p in (".", ",", "!?", ";:", "%&$#*|"))
        self._comma = self._comma_id()
        self._number = _Numbers()
        self._stems: dict[bytes, bytes] = {}  # ids as 32-bit numbers
        self._forget()

    def _pieces(self, text: str) -> list[str]:
        t = self._tokenizer
        text = t.normalizer.normalize_str(text) if t.normalizer else text
        return [p for p, _ in t.pre_tokenizer.pre_tokenize_str(text)] if t.pre_tokenizer else [text]

    def _forget(self) -> None:
        self._number.clear()
        self._ids = np.zeros(1 << 16, np.uint32)
        self._ends = np.zeros(1 << 14, np.int64)  # of the ids of word k: _ends[k] to _ends[k + 1]

    def _learn(self, known: int) -> None:
        """Remembers the words numbered from ``known`` on: as stem and
        punctuation where the tokenizer splits there."""
        new, parts = list(islice(reversed(self._number), len(self._number) - known))[::-1], []
        for w in new:
            m = _TRAIL.fullmatch(w) if self._splits and w[-1] in _MARKS else None
            parts.append(m.groups() if m else (w,))
        if len(self._stems) > CACHE_STEMS:
            self._stems.clear()
        stems = self._stems
        unknown = list({p for ps in parts for p in ps if p not in stems})
        for s in range(0, len(unknown), 10_000):  # encodings are large objects
            stems.update(self._encoded(unknown[s:s + 10_000]))
        found = [stems[ps[0]] if len(ps) == 1 else stems[ps[0]] + stems[ps[1]] for ps in parts]
        need = known + len(new) + 1
        if need > len(self._ends):
            self._ends = np.concatenate([self._ends, np.zeros(need, np.int64)])
        ends = self._ends[known] + np.cumsum([len(x) // 4 for x in found])
        self._ends[known + 1:need] = ends
        if ends[-1] > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros(int(ends[-1]), np.uint32)])
        self._ids[self._ends[known]:ends[-1]] = np.frombuffer(b"".join(found), np.uint32)

    def _encoded(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of words that are not remembered. Where the tokenizer takes a
        comma between spaces as one token that no other word holds, many words
        are encoded as one text with commas between them."""
        out, single = {}, words
        if self._comma is not None:
            joined = [w for w in words if b"," not in w]
            single = [w for w in words if b"," in w]
            runs = [joined[k:k + JOINED] for k in range(0, len(joined), JOINED)]
            texts = [b" , ".join([*run, b""]).decode() for run in runs]
            for run, e in zip(runs, self._tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids = np.array(e.ids, np.uint32)
                ends = np.flatnonzero(ids == self._comma).tolist()
                if len(ends) != len(run):
                    single += run
                    continue
                raw, at = ids.tobytes(), 0
                for w, end in zip(run, ends, strict=True):
                    out[w], at = raw[4 * at:4 * end], end + 1
        for w, e in zip(single, self._tokenizer.encode_batch_fast([w.decode() for w in single], add_special_tokens=False), strict=True):
            out[w] = array("I", e.ids).tobytes()
        return out

    def _comma_id(self) -> int | None:
        def ids(text: str) -> list[int]:
            return self._tokenizer.encode(text, add_special_tokens=False).ids

        comma = ids("ab , cd")[len(ids("ab")):-len(ids("cd")) or None]
        alone = len(comma) == 1 and ids("ab , cd , ") == [*ids("ab"), *comma, *ids("cd"), *comma]
        return comma[0] if self._splits and alone else None

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        """The ids of each row that ``offsets`` bound, in order."""
        raw = data.data
        for i, j in hashing.row_groups(offsets, 4 << 20):
            texts = [bytes(raw[offsets[r]:offsets[r + 1]]) for r in range(i, j)]
            # ASCII letters only: what the tokenizer does to others it does later.
            folded = [t.lower() for t in texts]
            whole = {k: self._tokenizer.encode(texts[k].decode(), add_special_tokens=False).ids
                     for k, t in enumerate(folded) if any(a in t for a in self._added)}
            texts = [b"" if k in whole else f if self._lowers else t for k, (t, f) in enumerate(zip(texts, folded, strict=True))]
            texts = [t.split() for t in texts]
            del folded
            if len(self._number) > CACHE_WORDS:
                self._forget()
            known, get = len(self._number), self._number.__getitem__
            numbers = [np.fromiter(map(get, found), np.int64, len(found)) for found in texts]
            del texts
            if len(self._number) > known:
                self._learn(known)
            for k, codes in enumerate(numbers):
                if k in whole:
                    yield np.array(whole[k], np.uint32)
                    continue
                starts = self._ends[codes]
                counts = self._ends[codes + 1] - starts
                total = int(counts.sum())
                # Index of each id: its word's start plus its place in the word.
                shift = np.repeat(starts - np.cumsum(counts) + counts, counts)
                yield self._ids[shift + np.arange(total)]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for a tokenizer file; a reused worker keeps its words."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def release() -> None:
    """Forgets this worker's encoders and gives their memory back. Workers are
    reused by all steps of an application, so a task that encodes nothing would
    hold the words of the steps before it, some 200 MB per worker."""
    if _encoders:
        _encoders.clear()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim is not None:
            trim(0)


def ids_of(batch: pa.RecordBatch, column: int, path: str) -> Iterator[np.ndarray]:
    data, offsets = hashing.text_bytes(batch.column(column))
    return encoder(path).encode(data, offsets)
