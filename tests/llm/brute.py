"""Plain-Python versions of the operators' contracts, and a table of awkward rows."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls in every column, empty and blank texts, repeated rows, ties, a long text and one long word.
MESSY = [
    (1, "one two three four five six seven", "en", "a", 33),
    (2, "ONE two\tthree four five  six seven", "en", "b", 33),
    (3, None, "en", "a", 0),
    (4, "", None, None, 0),
    (5, " \n\t \n", "de", "c", None),
    (None, "one two three four five six seven", None, "a", 33),
    (6, "word", "fr", None, 4),
    (6, "word", "fr", None, 4),
    (7, "uno due\ntre quattro\nuno due\n" * 400, "it", "b", 11200),
    (8, "x" * 70000, "en", "a", 70000),
    (9, "l'été à Zürich naïve œuvre 東京 \U0001f600 end", "fr", "c", 33),
    (10, "one two three four five six seven eight", "en", "a", 39),
]

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def words(text: str | None, lower: bool = False) -> list[str]:
    return WORD.findall((text or "").translate(LOWER) if lower else text or "")


def unigram_scores(docs: list[tuple[int, str | None]], modulus: int = 7, residue: int = 2) -> dict[int, tuple]:
    """doc_id -> held_out, n_tokens, n_known, train_tokens, base_score."""
    held = {i: zlib.crc32(str(i).encode()) % modulus == residue for i, _ in docs}
    tokens = {i: [*words(t, True), None] for i, t in docs}  # None: the end
    counts = Counter(w for i in tokens if not held[i] for w in tokens[i])
    n, v = sum(counts.values()), len(counts)
    return {i: (held[i], len(ws), sum(counts[w] > 0 for w in ws), n,
                sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in tokens.items()}


def shingles(text: str | None, k: int = 5) -> frozenset:
    w = words(text, True)
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def near_components(docs: list[tuple[int, str | None]], percent: int = 75) -> dict[int, tuple[int, int]]:
    """doc_id -> set size, component; every pair that shares a shingle is compared."""
    sets = {i: shingles(t) for i, t in docs}
    same: dict[frozenset, list[int]] = defaultdict(list)
    for i, s in sets.items():
        if s:
            same[s].append(i)
    parent = {i: i for i in sets}

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(a: int, b: int) -> None:
        a, b = sorted((root(a), root(b)))
        parent[b] = a

    holders: dict[tuple, list[int]] = defaultdict(list)
    kinds = list(same)
    for ids in same.values():
        for i in ids[1:]:
            join(ids[0], i)
    for k, s in enumerate(kinds):
        common: Counter = Counter()
        for x in s:
            common.update(holders[x])
            holders[x].append(k)
        for other, n in common.items():
            if 100 * n >= percent * (len(s) + len(kinds[other]) - n):
                join(same[s][0], same[kinds[other]][0])
    return {i: (len(sets[i]), root(i)) for i in sets}


def text_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    t, w = text or "", words(text)
    where = defaultdict(list)
    for i in range(len(w) - 7):
        where[tuple(w[i:i + 8])].append(i)
    covered = {j for starts in where.values() if len(starts) > 1 for i in starts for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def token_ids(texts: list[str | None], path: str) -> list[list[int]]:
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
