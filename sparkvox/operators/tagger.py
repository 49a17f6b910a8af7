"""Part-of-speech tags by a sequence model fitted with expectation-maximisation.

A sentence is a chain of tags, each of which emits a word class: a frequent word
itself, else its language and last three letters, digits, or unknown. Words of
a lexicon have their tag fixed; suffix rules and the open tags are where the
others start from. A round computes the probability of every tag at every word
from the whole sentence and adds these up per class and per pair of tags, in the
tasks; one aggregate sums what the tasks found, and the driver holds classes x
tags numbers (``max_classes`` bounds them). Costs are whole numbers, so the best
path of a sentence is one: ties go to the tag that comes first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkvox.functions import lexicon as L
from sparkvox.operators.numbering import first_rows
from sparkvox.session import PACKED, scratch_path, ship_package

TAGS = ("ADJ", "ADP", "ADV", "AUX", "CCONJ", "DET", "NOUN", "NUM", "PART", "PRON", "PROPN", "VERB")
OPEN = ("ADJ", "ADV", "NOUN", "PROPN", "VERB")
#: Starting weights of a class: the tag of its suffix rule, open tags, and closed
#: tags, which only words with a class of their own may have, the more so the
#: larger their share of all words (function words are the frequent ones).
RULE, OTHER_OPEN, CLOSED, CLOSED_BY_SHARE = 8.0, 1.0, 0.1, 200.0
MAX_CLASSES, LEAST_COUNT, SUFFIX = 50_000, 5, 3
UNIT = 1_000_000
#: Words of the lexicon come before any others.
FIXED = 1 << 60
#: Cost of what cannot be.
NEVER = 1 << 50
#: Words that are worked on together.
CHUNK = 1 << 16
UNKNOWN, DIGITS = "unknown", "digits"


def word_class(lang: Column, lemma: Column) -> tuple[Column, Column]:
    """The class of a word of its own, and that of its language and ending."""
    lang, number = F.coalesce(lang, F.lit("")), lemma.rlike(L.DIGITS_ONLY)
    return tuple(F.when(number, F.lit(DIGITS)).otherwise(F.concat(F.lit(f"{kind}|"), lang, F.lit("|"), key))
                 for kind, key in (("w", lemma), ("s", F.right(lemma, F.lit(SUFFIX)))))


def starting_weights(name: str, share: float, lexicon: dict[str, str]) -> np.ndarray:
    """Weight of each tag for a class, before anything is learned."""
    if name == DIGITS:
        return np.array([float(t == L.NUM_POS) for t in TAGS])
    kind, _, rest = name.partition("|")
    if kind == "w" and rest in lexicon:
        return np.array([float(t == lexicon[rest]) for t in TAGS])
    ending = rest.partition("|")[2]
    rule = next((pos for suffix, pos in L.SUFFIX_RULES if ending.endswith(suffix) or (kind == "s" and suffix.endswith(ending) and ending)), None)
    closed = CLOSED + CLOSED_BY_SHARE * share if kind == "w" else 0.0
    return np.array([(RULE if t == rule else OTHER_OPEN) if t in OPEN else 0.0 if t == L.NUM_POS else closed for t in TAGS])


def _joined(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sentences one after the other, and where each starts and the last ends."""
    return np.concatenate([np.zeros(0, np.int64), *codes]), np.cumsum([0, *map(len, codes)])


def _active(flat: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Sentences in chunks, the longest first: where their words are, which of
    these places are theirs, their classes as one padded table, and how many
    are still going on at each word."""
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    order, s = order[lengths[order] > 0], 0
    while s < len(order):
        own = order[s:s + max(1, CHUNK // lengths[order[s]])]
        steps = np.arange(lengths[own[0]])
        at, inside = offsets[own][:, None] + steps, steps < lengths[own][:, None]
        table = np.where(inside, flat[np.minimum(at, len(flat) - 1)], 0)
        yield at, inside, table, np.searchsorted(-lengths[own], -steps - 1, "right")
        s += len(own)


def _list(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The values of a list column without nulls, and where each row starts and the last ends."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.flatten(), offsets - offsets[0]


@dataclass
class Tagger:
    """Classes by name, and the costs of a first tag, of a tag after a tag, and
    of a class under a tag (classes x tags)."""

    classes: dict[str, int]
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    def code(self, lang: str | None, lemma: str) -> int:
        unknown = self.classes[UNKNOWN]
        if lemma.isascii() and lemma.isdigit():
            return self.classes.get(DIGITS, unknown)
        lang = lang or ""
        return self.classes.get(f"w|{lang}|{lemma}", self.classes.get(f"s|{lang}|{lemma[-SUFFIX:]}", unknown))

    @cached_property
    def _named(self) -> tuple[pa.Array, np.ndarray]:
        return pa.array(list(self.classes), pa.string()), np.array(list(self.classes.values()), np.int64)

    def codes(self, langs: pa.Array, sentences: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``code`` of all words of some sentences, one after the other, and where each sentence starts and the last ends."""
        lemmas, offsets = _list(sentences)
        # Most words come again within a batch: each is looked up once.
        lang, lemmas = pc.fill_null(langs, "").dictionary_encode(), lemmas.dictionary_encode(null_encoding="encode")
        many = max(len(lemmas.dictionary), 1)
        words = pa.array(np.repeat(lang.indices.to_numpy().astype(np.int64), np.diff(offsets)) * many + lemmas.indices.to_numpy()).dictionary_encode()
        number, keys = words.indices.to_numpy(), words.dictionary.to_numpy()
        lang, lemmas = lang.dictionary.take(pa.array(keys // many)), lemmas.dictionary.take(pa.array(keys % many))
        (names, numbers), unknown = self._named, self.classes[UNKNOWN]

        def found(kind: str, key: pa.Array) -> np.ndarray:
            at = pc.fill_null(pc.index_in(pc.binary_join_element_wise(kind, lang, key, "|"), value_set=names), -1).to_numpy()
            return np.where(at < 0, -1, numbers[at])

        own, ending = found("w", lemmas), found("s", pc.utf8_slice_codeunits(lemmas, -SUFFIX))
        out = np.where(own >= 0, own, np.where(ending >= 0, ending, unknown))
        digits = pc.match_substring_regex(lemmas, r"\A[0-9]+\z").to_numpy(zero_copy_only=False)
        return np.where(digits, self.classes.get(DIGITS, unknown), out)[number], offsets

    def paths(self, codes: list[np.ndarray]) -> list[np.ndarray]:
        """The cheapest tags of each sentence."""
        flat, offsets = _joined(codes)
        return np.split(self.best(flat, offsets), offsets[1:-1]) if codes else []

    def best(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The same of sentences one after the other. Tags are rows of the
        arrays, so each step works on long rows; a cost carries the tag that it
        came from in its low bits, so the least has the first of equal tags."""
        out, k = np.zeros(len(flat), np.int64), len(self.start)
        bits = (k - 1).bit_length()
        emit, tags = np.ascontiguousarray(self.emit.T), np.arange(k)[:, None]
        move = (self.move << bits)[:, :, None]
        for at, inside, table, going in _active(flat, offsets):
            codes, back = np.ascontiguousarray(table.T), []
            cost = self.start[:, None] + emit.take(codes[0], axis=1)
            for t in range(1, len(codes)):
                g = going[t]
                # Of a sentence's costs only the differences count, so they stay small.
                come = ((cost[:, :g] - cost[:, :g].min(axis=0)) << bits) + tags
                least, other = come[0] + move[0], np.empty((k, g), np.int64)
                for i in range(1, k):
                    np.add(come[i], move[i], out=other)
                    np.minimum(least, other, out=least)
                back.append((least & ((1 << bits) - 1)).astype(np.int8))
                least >>= bits
                least += emit.take(codes[t, :g], axis=1)
                cost = least if g == cost.shape[1] else np.concatenate([least, cost[:, g:]], axis=1)
            tag = cost.argmin(axis=0)
            found = np.zeros(codes.shape, np.int64)
            for t in range(len(codes) - 1, -1, -1):
                g = going[t]
                found[t, :g] = tag[:g]
                if t:
                    tag[:g] = back[t - 1][tag[:g], np.arange(g)]
            out[at[inside]] = found.T[inside]
        return out

    def tags(self, lang: Column, lemmas: Column) -> Column:
        """The tags of a sentence's words, from an array of their lemmas."""
        tagger = self

        @F.arrow_udf("array<string>")
        def tagged(langs: pa.Array, sentences: pa.Array) -> pa.Array:
            flat, offsets = tagger.codes(langs, sentences)
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(TAGS).take(pa.array(tagger.best(flat, offsets))))

        return tagged(lang, F.coalesce(lemmas, F.array().cast("array<string>")))

    def save(self, spark, path: str) -> None:
        rows = [(name, [int(x) for x in self.emit[i]]) for name, i in self.classes.items()]
        rows += [("start", [int(x) for x in self.start])] + [(f"after|{t}", [int(x) for x in self.move[k]]) for k, t in enumerate(TAGS)]
        spark.createDataFrame(rows, "name string, costs array<long>").coalesce(1).write.parquet(path)

    @staticmethod
    def load(spark, path: str) -> Tagger:
        rows = {r["name"]: r["costs"] for r in spark.read.parquet(path).collect()}
        start, move = np.array(rows.pop("start")), np.array([rows.pop(f"after|{t}") for t in TAGS])
        return Tagger({name: i for i, name in enumerate(rows)}, start, move, np.array(list(rows.values())))


def expected(codes: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of first tags, pairs of tags, and (class, tag), over
    sentences; the arguments are probabilities."""
    return _expected(*_joined(codes), start, move, emit)


def _expected(flat: np.ndarray, offsets: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k = len(start)
    first, pairs, held = np.zeros_like(start), np.zeros_like(move), np.zeros((k, len(emit)))
    emit, onward = np.ascontiguousarray(emit.T), np.ascontiguousarray(move.T)  # tags are rows: each step works on long rows
    for _, _, table, going in _active(flat, offsets):
        codes, ends = np.ascontiguousarray(table.T), np.cumsum(going)
        forward, scale, given = [], [], []
        for t, g in enumerate(going):
            e = emit.take(codes[t, :g], axis=1)
            a = (onward @ forward[-1][:, :g] if t else start[:, None]) * e
            total = a.sum(axis=0)
            a /= total
            forward.append(a)
            scale.append(total)
            given.append(e)
        shares, after = np.empty((k, ends[-1])), np.ones((k, going[-1]))
        for t in range(len(codes) - 1, -1, -1):
            g = going[t]
            share = shares[:, ends[t] - g:ends[t]]
            np.multiply(forward[t], after, out=share)
            if t == 0:
                first += share.sum(axis=1)
                break
            ahead = given[t]
            ahead *= after
            ahead /= scale[t]
            pairs += forward[t - 1][:, :g] @ ahead.T * move
            after = move @ ahead
            if going[t - 1] > g:
                after = np.concatenate([after, np.ones((k, going[t - 1] - g))], axis=1)
        seen = np.concatenate([codes[t, :g] for t, g in enumerate(going)])
        for row, share in zip(held, shares, strict=True):
            row += np.bincount(seen, share, minlength=held.shape[1])
    return first, pairs, np.ascontiguousarray(held.T)


def _coded(classes: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0)
        tagger = Tagger(classes, none, none, none)
        for batch in batches:
            flat, offsets = tagger.codes(batch.column(0), batch.column(1))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))], names=["codes"])

    return run


def _counted(start: np.ndarray, move: np.ndarray, emit: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros_like(start)[None], np.zeros_like(move), np.zeros_like(emit)]
        for batch in batches:
            flat, offsets = _list(batch.column(0))
            for total, found in zip(sums, _expected(flat.to_numpy(), offsets, start, move, emit), strict=True):
                total += found
        for kind, total in enumerate(sums):
            kept = np.flatnonzero(total.any(axis=1))
            by_tag = [pa.array(x) for x in np.ascontiguousarray(total[kept].T)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kept), kind), pa.int32()), pa.array(kept, pa.int32()), *by_tag], names=["kind", "i", *TAGS])

    return run


def learn(words: DataFrame, *, lexicon: dict[str, str] | None = None, max_classes: int = MAX_CLASSES,
          least_count: int = LEAST_COUNT, rounds: int = 5) -> Tagger:
    """A tagger from a word table (``doc_id, sent_id, word_id, lemma, lang``).
    ``lexicon`` fixes the tag of ``lang|lemma`` (the built-in one unless given)."""
    spark = words.sparkSession
    ship_package(spark)
    lexicon = dict(L.lexicon_items()) if lexicon is None else lexicon
    # Words are counted by themselves first: their classes are worked out once per distinct word.
    own, ending = word_class(F.col("lang"), F.col("lemma"))
    path = scratch_path(spark, "word_classes")
    (words.groupBy("lang", "lemma").agg(F.count("*").alias("n")).select("n", F.explode(F.array(own, ending)).alias("name"))
     .groupBy("name").agg(F.sum("n").alias("n"))
     .where((F.col("n") >= least_count) | F.col("name").isin(DIGITS, *[f"w|{k}" for k in lexicon])).write.options(**PACKED).parquet(path))
    fixed = F.col("name").isin(*[f"w|{k}" for k in lexicon])
    counts = first_rows(spark.read.parquet(path), max_classes, F.col("n") + F.when(fixed, FIXED).otherwise(0), ["name"]).collect()
    n = {r["name"]: float(r["n"]) for r in counts} | {UNKNOWN: 1.0}
    names = sorted(n)
    classes = {name: i for i, name in enumerate(names)}
    total = sum(n.values()) / 2  # every word is counted by itself and by its ending
    prior = np.array([starting_weights(name, n[name] / total, lexicon) for name in names])
    prior /= prior.sum(axis=1, keepdims=True)
    path = scratch_path(spark, "sentences")
    (words.groupBy("doc_id", "sent_id", "lang").agg(F.sort_array(F.collect_list(F.struct("word_id", "lemma"))).alias("ws"))
     .select("lang", F.col("ws.lemma").alias("lemmas")).mapInArrow(_coded(classes), "codes array<int>").write.parquet(path))
    sentences = spark.read.parquet(path)
    k = len(TAGS)
    held = prior * np.array([n[name] for name in names])[:, None]
    # At first every tag is as frequent as the classes' weights say, whatever comes before it.
    first, pairs = held.sum(axis=0), np.tile(held.sum(axis=0), (k, 1))
    for turn in range(rounds + 1):
        start, move = (first + 0.1) / (first + 0.1).sum(), (pairs + 0.1) / (pairs + 0.1).sum(axis=1, keepdims=True)
        emit = held + 0.1 * prior
        emit = emit / np.maximum(emit.sum(axis=0), 1e-300)
        if turn == rounds:
            break
        first, pairs, held = np.zeros(k), np.zeros((k, k)), np.zeros_like(prior)
        # Every task has a row per class: plain sums of a column per tag add these up without an object per row.
        sums = (sentences.mapInArrow(_counted(start, move, emit), "kind int, i int, " + ", ".join(f"{t} double" for t in TAGS))
                .groupBy("kind", "i").agg(*[F.sum(t).alias(t) for t in TAGS]))
        for kind, i, *v in sums.collect():
            if kind == 0:
                first = np.array(v)
            else:
                (pairs if kind == 1 else held)[i] = v

    def costs(p: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return np.where(p > 0, np.rint(-np.log(p) * UNIT), NEVER).astype(np.int64)

    return Tagger(classes, costs(start), costs(move), costs(emit))
