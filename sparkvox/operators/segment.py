"""Words of scripts that are written without spaces.

A segmenter knows pieces (words and parts of words) and what each costs, the
negative logarithm of its probability in millionths; a run of such a script is
cut into the pieces of the least total cost. Costs are whole numbers, so equal
paths are equal everywhere: ties go to fewer words, then to the longer last
word. A character that no piece covers is a word of its own at a high cost.

Pieces come from a given vocabulary or are learned from the corpus itself: all
substrings up to a length are counted by Spark, the ``max_pieces`` of the most
text are kept (the model's size, the bound of what the driver and the tasks
hold), and rounds of expectation and maximisation follow. A round spreads each
distinct run's count over all its segmentations by their probability; tasks add
the expected counts up per piece and one aggregate sums these. Expected counts
travel as whole numbers, so the result does not depend on the partitioning.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkvox.functions import lexicon as L
from sparkvox.operators.numbering import first_rows
from sparkvox.session import PACKED, drop_folder, scratch_path, ship_package

#: Cost of a piece: so many units per natural logarithm.
UNIT = 1_000_000
MAX_PIECE_LENGTH = 8
MAX_PIECES = 200_000
#: Expected counts are summed in this fraction of one.
GRAIN = 1 << 16
#: Single characters weigh more than any text.
ALONE = 1 << 60
#: Characters whose substrings one row holds.
BLOCK = 1000
#: Runs of like length are worked on together, a character of each at a time:
#: so many characters with their padding, and the fewest runs that are worth it.
CHUNK, TOGETHER = 1 << 17, 16
#: Costs of whole runs stay below this in arrays; more than any cost; a word is counted in the low bits.
MOST_COST, NEVER, WORD_BITS = 1 << 39, 1 << 61, 20

# Marks in a word's parts: control characters, which no word contains.
_NEXT, _UNSPACED = "\x01", "\x02"


def parts(word: Column) -> Column:
    """A word cut where its script changes to or from one without spaces;
    parts of the latter kind carry a mark in front."""
    cut = F.regexp_replace(word, f"({L.UNSPACED_JAVA}+)", f"{_NEXT}{_UNSPACED}$1{_NEXT}")
    return F.array_remove(F.split(cut, _NEXT), "")


def runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(run, n)``: the distinct runs of unspaced scripts and how often each occurs."""
    found = docs.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"({L.UNSPACED_JAVA}+)"), 1)).alias("run"))
    return found.groupBy("run").agg(F.count("*").alias("n"))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Pieces:
    """Pieces as a trie in arrays, which finds those in many runs at once. A
    (state, symbol) leads to the next state by a table with open addresses."""

    def __init__(self, pieces: list[str], max_length: int):
        lengths = np.array([len(p) if len(p) <= max_length else 0 for p in pieces], np.int64)
        text = _codes("".join(p for p, n in zip(pieces, lengths, strict=True) if n))
        starts = np.cumsum(lengths) - lengths
        self.max_length, self.symbols = max_length, np.unique(text)
        symbol, self.width = np.searchsorted(self.symbols, text) + 1, len(self.symbols) + 1
        state, keys, n = np.zeros(len(pieces), np.int64), [np.zeros(0, np.int64)], 1
        for k in range(lengths.max(initial=0)):
            on = np.flatnonzero(lengths > k)
            key, inverse = np.unique(state[on] * self.width + symbol[starts[on] + k], return_inverse=True)
            state[on] = n + inverse
            keys.append(key)
            n += len(key)
        self.piece = np.full(n, -1, np.int32)
        self.piece[state[lengths > 0]] = np.flatnonzero(lengths)
        keys = np.concatenate(keys)
        bits = (2 * len(keys) + 8).bit_length()
        self.shift, self.held, self.leads = np.uint64(64 - bits), np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = left[self.held[slot[left]] < 0]
            self.held[slot[free]] = keys[free]  # of equal slots the last is held
            left = left[self.held[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & (len(self.held) - 1)
        self.leads[slot] = np.arange(1, n)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _next(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        key = state * self.width + symbol
        slot = self._slot(key)
        held = self.held[slot]
        out = np.where(held == key, self.leads[slot], -1)
        left = np.flatnonzero((held != key) & (held >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.held) - 1)
            held = self.held[slot[left]]
            hit = held == key[left]
            out[left[hit]] = self.leads[slot[left[hit]]]
            left = left[~hit & (held >= 0)]
        return out

    def found(self, runs: list[str], lengths: np.ndarray) -> np.ndarray:
        """Numbers of pieces by length - 1, place in the run, and run; -1 for
        none. ``runs``, the longest first, are of ``lengths``."""
        text, high, n = _codes("".join(runs)), lengths[0], len(runs)
        symbol = np.zeros(len(text), np.int64)
        if len(self.symbols):
            at = np.minimum(np.searchsorted(self.symbols, text), len(self.symbols) - 1)
            symbol = np.where(self.symbols[at] == text, at + 1, 0)
        table = np.zeros((high + self.max_length - 1, n), np.int64)
        table[np.arange(len(text)) - np.repeat(np.cumsum(lengths) - lengths, lengths), np.repeat(np.arange(n), lengths)] = symbol
        table = table.ravel()
        out = np.full((self.max_length, high * n), -1, np.int32)
        at = np.flatnonzero(table[:high * n])
        state = np.zeros(len(at), np.int64)
        for k in range(self.max_length):
            state = self._next(state, table[at + k * n])
            at, state = at[state >= 0], state[state >= 0]
            if not len(at):
                break
            out[k, at] = self.piece[state]
        return out.reshape(self.max_length, high, n)


def _together(runs: list[str]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Runs in chunks, the longest first: their numbers, their lengths, and how
    many have a character at each place. Empty runs are left out."""
    order, s = sorted((i for i in range(len(runs)) if runs[i]), key=lambda i: -len(runs[i])), 0
    while s < len(order):
        own = order[s:s + max(1, CHUNK // len(runs[order[s]]))]
        lengths = np.array([len(runs[i]) for i in own])
        yield own, lengths, np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), "right")
        s += len(own)


@dataclass
class Segmenter:
    """Cost of each piece, the cost of a character without a piece, and the longest piece's length."""

    costs: dict[str, int]
    unknown: int
    max_length: int

    @staticmethod
    def of(pieces: DataFrame, unknown: int) -> Segmenter:
        """From a table ``(piece, cost)``, which the caller has bounded."""
        costs = {r["piece"]: int(r["cost"]) for r in pieces.select("piece", "cost").collect()}
        return Segmenter(costs, unknown, max(map(len, costs), default=1))

    def save(self, spark, path: str) -> None:
        rows = [*self.costs.items(), (None, self.unknown)]
        spark.createDataFrame(rows, "piece string, cost long").coalesce(1).write.parquet(path)

    @staticmethod
    def load(spark, path: str) -> Segmenter:
        table = spark.read.parquet(path)
        unknown = table.where(F.col("piece").isNull()).first()["cost"]
        return Segmenter.of(table.where(F.col("piece").isNotNull()), unknown)

    def split(self, run: str) -> list[str]:
        """The cheapest words of a run."""
        n, costs, best = len(run), self.costs, [(0, 0, 0)]  # cost, words, start of the last word
        for j in range(1, n + 1):
            found = None
            for i in range(max(0, j - self.max_length), j):
                cost = costs.get(run[i:j])
                if cost is None:
                    if i < j - 1:
                        continue
                    cost = self.unknown
                at = (best[i][0] + cost, best[i][1] + 1, i)
                if found is None or at < found:
                    found = at
            best.append(found)
        words, j = [], n
        while j:
            words.append(run[best[j][2]:j])
            j = best[j][2]
        return words[::-1]

    def pieces(self) -> Pieces:
        return Pieces(list(self.costs), self.max_length)

    def split_all(self, runs: list[str], pieces: Pieces) -> list[list[str]]:
        """``split`` of each run, many runs at once."""
        out: list[list[str]] = [[] for _ in runs]
        top = max(map(abs, [self.unknown, *self.costs.values()]))
        steps = np.array([], np.int64) if top >= MOST_COST else np.array([(c << WORD_BITS) + 1 for c in self.costs.values()] + [NEVER], np.int64)
        for own, lengths, going in _together(runs):
            if len(own) < TOGETHER or top * int(lengths[0]) >= MOST_COST:
                for i in own:
                    out[i] = self.split(runs[i])
                continue
            step = steps[pieces.found([runs[i] for i in own], lengths)]
            step[0][step[0] == NEVER] = (self.unknown << WORD_BITS) + 1
            best, back = np.zeros((lengths[0] + 1, len(own)), np.int64), np.zeros((lengths[0] + 1, len(own)), np.int32)
            for j in range(1, lengths[0] + 1):
                g, k = going[j - 1], min(j, self.max_length)
                least, word = best[j - k, :g] + step[k - 1, j - k, :g], back[j, :g]
                word[:] = k
                for k in range(k - 1, 0, -1):  # the longest last word first: it stays where paths are equal
                    cost = best[j - k, :g] + step[k - 1, j - k, :g]
                    word[cost < least] = k
                    np.minimum(least, cost, out=least)
                best[j, :g] = least
            for i, n, word in zip(own, lengths.tolist(), back.T.tolist(), strict=True):
                run, found = runs[i], out[i]
                while n:
                    found.append(run[n - word[n]:n])
                    n -= word[n]
                found.reverse()
        return out

    def words(self, words: Column) -> Column:
        """An array of words with those of unspaced scripts segmented. Arrays
        without any never leave the JVM; a narrow Arrow-batched function
        segments the others, every run of a batch once."""
        segmenter, pieces = self, self.pieces()

        @F.arrow_udf("array<string>")
        def segmented(batch: pa.Array) -> pa.Array:
            given = batch.flatten().to_pylist()
            runs = list({p[1:]: None for p in given if p[0] == _UNSPACED})
            split = dict(zip(runs, segmenter.split_all(runs, pieces), strict=True))
            out, ends = [], [0]
            for p in given:
                out.extend(split[p[1:]] if p[0] == _UNSPACED else [p])
                ends.append(len(out))
            at = np.cumsum(np.append(0, pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False)))
            return pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)[at]), pa.array(out, pa.string()), mask=batch.is_null())

        some = F.exists(words, lambda w: w.rlike(L.UNSPACED_JAVA))
        return F.when(some, segmented(F.when(some, F.flatten(F.transform(words, parts))))).otherwise(words)


def expected_counts(run: str, probability: dict[str, float], max_length: int, least: float) -> dict[str, float]:
    """How often each piece stands in a run, on average over the run's
    segmentations by their probability; ``least`` is that of a character
    without a piece.

    ``ratio[j]`` is the probability of the first j characters over that of the
    first j - 1, so no length underflows. The last word before j is then (i, j)
    with probability p(i, j) over the product of the ratios i + 1 to j."""
    n, get = len(run), probability.get
    ratio = [1.0]
    for j in range(1, n + 1):
        total = get(run[j - 1:j], least)
        between = 1.0
        for i in range(j - 2, max(0, j - max_length) - 1, -1):
            between *= ratio[i + 1]
            p = get(run[i:j])
            if p:
                total += p / between
        ratio.append(total)
    out: dict[str, float] = defaultdict(float)
    reached = [0.0] * n + [1.0]  # probability that a word ends here
    for j in range(n, 0, -1):
        if not reached[j]:
            continue
        before = reached[j] / ratio[j]
        for i in range(j - 1, max(0, j - max_length) - 1, -1):
            word = run[i:j]
            p = get(word) if i < j - 1 else get(word, least)
            if p:
                out[word] += before * p
                reached[i] += before * p
            before /= ratio[i]
    return out


def _expected_together(found: np.ndarray, probability: np.ndarray, least: float, lengths: np.ndarray,
                       going: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``expected_counts`` of many runs at once, in the same order of steps:
    run, piece and expected count, a row per run and piece."""
    p = np.append(probability, 0.0)[found]
    p[0][found[0] < 0] = least
    (most, high, n), size = found.shape, len(probability)
    ratio = np.ones((high + 1, n))
    for j in range(1, high + 1):
        g = going[j - 1]
        total, between = p[0, j - 1, :g].copy(), np.ones(g)
        for k in range(2, min(j, most) + 1):
            between *= ratio[j - k + 1, :g]
            total += p[k - 1, j - k, :g] / between
        ratio[j, :g] = total
    reached = np.zeros((high + 1, n))
    reached[lengths, np.arange(n)] = 1.0
    share, piece = np.zeros((high, most, n)), np.full((high, most, n), -1, np.int32)  # by the words' ends, the last first
    for j in range(high, 0, -1):
        g = going[j - 1]
        before = reached[j, :g] / ratio[j, :g]
        for k in range(1, min(j, most) + 1):
            x = before * p[k - 1, j - k, :g]
            share[high - j, k - 1, :g], piece[high - j, k - 1, :g] = x, found[k - 1, j - k, :g]
            reached[j - k, :g] += x
            before /= ratio[j - k, :g]
    share, piece = share.ravel(), piece.ravel()
    at = np.flatnonzero((share > 0) & (piece >= 0))
    key, inverse = np.unique(at % n * size + piece[at], return_inverse=True)
    return key // size, key % size, np.bincount(inverse, share[at], len(key))


def _expected(probability: dict[str, float], max_length: int, least: float):
    names = list(probability)
    pieces, values = Pieces(names, max_length), np.array([probability[w] for w in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen, number = np.zeros(len(names), np.int64), np.zeros(len(names), bool), {w: i for i, w in enumerate(names)}
        for batch in batches:
            texts, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for own, lengths, going in _together(texts):
                if len(own) < TOGETHER:
                    for i in own:
                        for piece, x in expected_counts(texts[i], probability, max_length, least).items():
                            if piece in number:
                                total[number[piece]] += round(x * int(n[i]) * GRAIN)
                                seen[number[piece]] = True
                    continue
                found = pieces.found([texts[i] for i in own], lengths)
                of, piece, x = _expected_together(found, values, least, lengths, going)
                np.add.at(total, piece, np.rint(x * n[own][of] * GRAIN).astype(np.int64))
                seen[piece] = True
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in at], pa.string()), pa.array(total[at])], names=["piece", "n"])

    return run


def substrings(runs: DataFrame, max_length: int) -> DataFrame:
    """``(piece, n)``: all substrings up to a length. Runs are worked through in
    blocks of start positions, so no row holds the substrings of a long one."""
    starts = runs.select("n", F.explode(F.sequence(F.lit(0), F.length("run") - 1, F.lit(BLOCK))).alias("at"), "run")
    block = F.substring("run", F.col("at") + 1, F.lit(BLOCK + max_length - 1))
    inside = F.transform(
        F.sequence(F.lit(1), F.least(F.length("b"), F.lit(BLOCK))),
        lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(max_length), F.length("b") - i + 1)), lambda k: F.substring(F.col("b"), i, k)))
    return (starts.select("n", block.alias("b")).select("n", F.explode(F.flatten(inside)).alias("piece"))
            .groupBy("piece").agg(F.sum("n").alias("n")))


def learn(runs: DataFrame, *, max_length: int = MAX_PIECE_LENGTH, max_pieces: int = MAX_PIECES, min_count: int = 2,
          rounds: int = 4) -> Segmenter:
    """A segmenter from the runs (``run``, ``n``) of a corpus.

    Single characters come first among the ``max_pieces``, then the pieces by
    count times length. Pieces whose expected count falls below half of
    ``min_count`` are dropped after a round, single characters never."""
    spark = runs.sparkSession
    ship_package(spark)
    path = scratch_path(spark, "unspaced_runs")
    # Few bytes, much work: an explicit number of parts, which is not made less by size.
    runs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).write.parquet(path)
    runs = spark.read.parquet(path)
    one, path = F.length("piece") == 1, scratch_path(spark, "unspaced_pieces")
    substrings(runs, max_length).where(one | (F.col("n") >= min_count)).write.options(**PACKED).parquet(path)
    weight = F.col("n") * F.length("piece") + F.when(one, ALONE).otherwise(0)
    # The driver gets these pieces and no others.
    counts = {r["piece"]: r["n"] * GRAIN for r in first_rows(spark.read.parquet(path), max_pieces, weight, ["piece"]).collect()}
    drop_folder(spark, path)
    for _ in range(rounds if counts else 0):
        total = sum(counts.values())
        probability = {w: n / total for w, n in counts.items()}
        found = (runs.mapInArrow(_expected(probability, max_length, 1 / (total + 1)), "piece string, n long")
                 .groupBy("piece").agg(F.sum("n").alias("n")).collect())
        counts = {r["piece"]: max(r["n"], 1) for r in found if len(r["piece"]) == 1 or 2 * r["n"] >= min_count * GRAIN}
    total = max(sum(counts.values()), 1)
    costs = {w: round(UNIT * math.log(total / n)) for w, n in sorted(counts.items())}
    return Segmenter(costs, max(costs.values(), default=0) + 5 * UNIT, max(map(len, costs), default=1))
