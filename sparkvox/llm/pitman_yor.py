"""Language-model scoring with a hierarchical Pitman-Yor process.

Words are served in restaurants, one per context (the previous word); all
context restaurants share a parent, the restaurant without context, whose
parent is uniform over the vocabulary. A customer of a context restaurant sits
at a table; every table is a customer of the parent. Tables are sampled by
Gibbs: the seating of a word in a restaurant is redrawn given all else. Scores
use predictive probabilities averaged over several samples.

How it runs on Spark. Tokens are dealt out once, by a hash of the word, in
packed blocks; from then on a group of words has all its occurrences, all
contexts of them, and the documents they stand in, in one row. A sweep goes
through the groups in parallel, each given the restaurants' totals (a few
numbers per context), which are summed up again between rounds: the usual
synchronised sampler. Draws depend on the seed, the group and the round only,
so a task that is run again draws the same, and later rounds repeat earlier
draws instead of storing them. Very frequent words, found on a bounded sample
of documents that decides on nothing else, are dealt out by word and context.

Contexts are numbered by a hash of CONTEXT_BITS bits: previous words beyond
that share restaurants. This bounds what the driver holds and broadcasts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkvox.llm import hashing
from sparkvox.llm.common import filled, written
from sparkvox.session import ship_package

CONTEXT_BITS = 16
CONTEXTS = 1 << CONTEXT_BITS
#: Text bytes of a group of words, about.
GROUP_BYTES = 24 << 20
#: Documents looked at to find frequent words, and how many words at most are treated so.
SAMPLE_DOCS, MAX_FREQUENT = 2_000, 4_096
#: Sweeps before the first sample of a round, samples, and customers up to which a seating is drawn exactly.
BURN_IN, SAMPLES, EXACT_UP_TO = 2, 3, 256
#: Seatings of a larger dish of which one is chosen.
PROPOSALS = 16
CONCENTRATION = 1.0

END = np.uint64(0x5EED0E9D0F7E27A1)
START = np.uint64(0x57A97BE61217A3C5)


def contexts_of(words: np.ndarray) -> np.ndarray:
    return (hashing.mix(words ^ np.uint64(0xC0117E47)) >> np.uint64(64 - CONTEXT_BITS)).astype(np.uint16)


def group_of(words: np.ndarray, contexts: np.ndarray, frequent: np.ndarray, groups: int) -> np.ndarray:
    """Number of the group that a token belongs to."""
    key = words
    if len(frequent):
        often = np.isin(words, frequent)
        key = np.where(often, hashing.mix(words + contexts.astype(np.uint64)), words)
    return (((key >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)).astype(np.int32)


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word, context and row of every token of the rows, ends included."""
    h, row = hashing.word_hashes(data, offsets, lower=True)
    n = len(offsets) - 1
    counts = np.bincount(row, minlength=n)
    ends = np.cumsum(counts + 1) - 1
    w = np.empty(len(h) + n, np.uint64)
    w[ends] = END
    w[np.arange(len(h)) + row] = h
    before = np.empty_like(w)
    before[1:] = w[:-1]
    before[np.r_[0, ends[:-1] + 1]] = START
    return w, contexts_of(before), np.repeat(np.arange(n), counts + 1)


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], "<i8")
    return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    at, out = 8 * (1 + len(kinds)), []
    for kind, size in zip(kinds, np.frombuffer(raw, "<i8", len(kinds), 8), strict=True):
        out.append(np.frombuffer(raw, kind, int(size) // np.dtype(kind).itemsize, at))
        at += int(size)
    return out


_BLOCK = ("<u8", "<u4", "<u2", "<u4", "<i8", "<i8", "u1")


def _dealt(frequent: np.ndarray, groups: int):
    """Blocks of tokens per group: words, tokens of each, then per token context and document; rids, ids and flags of the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = batch.column(0).to_numpy()
            flags = np.array(batch.column(2), bool).astype(np.uint8) | (np.array(batch.column(1).is_null(), bool).astype(np.uint8) << 1)
            ids = batch.column(1).fill_null(0).to_numpy()
            data, offsets = hashing.text_bytes(batch.column(3))
            for i, j in hashing.row_groups(offsets):
                w, c, row = tokens_of(data, offsets[i:j + 1])
                g = group_of(w, c, frequent, groups)
                order = np.lexsort((w, g))
                w, c, row, g = w[order], c[order], row[order] + i, g[order]
                cuts = np.r_[0, np.flatnonzero(g[1:] != g[:-1]) + 1, len(g)]
                numbers, blobs = [], []
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    at = np.flatnonzero(np.r_[True, w[a + 1:b] != w[a:b - 1]])
                    docs, place = np.unique(row[a:b], return_inverse=True)
                    numbers.append(int(g[a]))
                    blobs.append(_pack(w[a:b][at], np.diff(np.r_[at, b - a]).astype("<u4"), c[a:b], place.astype("<u4"),
                                       rid[docs], ids[docs], flags[docs]))
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], names=["g", "block"])

    return run


def _grouped(table: pa.Table) -> pa.Table:
    """One row of a group: its words, dishes (word and context) with training customers, and occurrences."""
    blocks = [_unpack(b.as_py(), *_BLOCK) for b in table.column("block")]
    words = np.unique(np.concatenate([b[0] for b in blocks]))
    keys, docs, first = [], [], 0
    for w, n, c, place, rid, *_ in blocks:
        index = np.repeat(np.searchsorted(words, w), n)
        keys.append(index.astype(np.int64) << CONTEXT_BITS | c)
        docs.append(place + np.uint32(first))
        first += len(rid)
    key, doc = np.concatenate(keys), np.concatenate(docs).astype("<u4")
    rid, ids, flags = (np.concatenate([b[k] for b in blocks]) for k in (4, 5, 6))
    del blocks, keys, docs
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    learned = (flags[doc] & 1) == 0
    customers = np.add.reduceat(learned, at, dtype=np.int64)
    owner = key[at] >> CONTEXT_BITS
    dishes = _pack(words, np.bincount(owner, minlength=len(words)).astype("<u4"), (key[at] & (CONTEXTS - 1)).astype("<u2"),
                   customers.astype("<u8"))
    places = _pack(np.diff(np.r_[at, len(key)]).astype("<u8"), doc, rid, ids, flags)
    return pa.table({"g": pa.array([table.column("g")[0].as_py()], pa.int32()), "dishes": pa.array([dishes], pa.binary()),
                     "places": pa.array([places], pa.binary())})


class Dishes:
    """A group's dishes: word k has the dishes of owner k; ctx, n: context and training customers of each."""

    def __init__(self, blob: bytes, frequent: np.ndarray):
        self.words, per_word, self.ctx, n = _unpack(blob, "<u8", "<u4", "<u2", "<u8")
        self.n = n.astype(np.int64)
        self.owner = np.repeat(np.arange(len(self.words)), per_word)
        self.often = np.isin(self.words, frequent)
        # Number of each frequent word in the sorted list.
        self.place = np.searchsorted(frequent, self.words[self.often])

    def per_word(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, weights=values, minlength=len(self.words))


@dataclass
class Totals:
    """What a sweep must know of all restaurants: tables per context; customers
    and tables of the parent, in all and of each frequent word."""

    tables: np.ndarray
    parent_customers: float
    parent_tables: float
    often_customers: np.ndarray
    often_tables: np.ndarray


@dataclass
class Model:
    """Corpus counts and hyperparameters. customers: per context; often_counts: training tokens of each frequent word."""

    frequent: np.ndarray
    customers: np.ndarray
    often_counts: np.ndarray
    tokens: int
    vocabulary: int
    discount: float
    parent_discount: float
    seed: int
    totals: list[Totals] = field(default_factory=list)  # of the first round, then of each sample

    def base(self, parent_customers: np.ndarray, parent_tables: np.ndarray, t: Totals) -> np.ndarray:
        """The parent's predictive probability of words with these customers and tables."""
        rest = (CONCENTRATION + self.parent_discount * t.parent_tables) / (self.vocabulary + 1)
        return (parent_customers - self.parent_discount * parent_tables + rest) / (CONCENTRATION + t.parent_customers)


def log_stirling(n: int, discount: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S(m, t), m and t up to n: the weight of m customers at t tables."""
    out = np.full((n + 1, n + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(n + 1)
    for m in range(1, n):
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = out[m] + np.log(np.maximum(m - discount * t, 0))
        out[m + 1, 1:] = np.logaddexp(out[m, :-1], stay[1:])
    return out


def draw_tables(rng: np.random.Generator, n: np.ndarray, mass: np.ndarray, p: np.ndarray, discount: float,
                stirling: np.ndarray) -> np.ndarray:
    """Tables for ``n`` customers of one dish each. mass: concentration plus
    discount times the restaurant's other tables; p: the parent's probability.

    Up to EXACT_UP_TO customers the number is drawn from its exact conditional
    distribution given all other seatings. Beyond, PROPOSALS seatings are
    made, customer after customer, and once 64 sit, in steps of 1/64 of those
    seated, whose new tables are binomial: the work grows with the logarithm of
    n. One is chosen by weight, the product of the masses that each customer
    chose from. This is an approximation: seating in order makes more tables
    than the conditional distribution has, and the choice makes up for part of
    that (a word so frequent in its context has few tables for its customers,
    so its probability hardly depends on them)."""
    out = np.minimum(n, 1)
    small = np.flatnonzero((n > 1) & (n <= EXACT_UP_TO))
    small = small[np.argsort(n[small], kind="stable")]
    sizes, starts = np.unique(n[small], return_index=True)
    for m, a, b in zip(sizes, starts, np.append(starts, len(small))[1:], strict=True):
        step = max(1, (1 << 20) // int(m))
        for s in range(a, b, step):
            rows = small[s:min(s + step, b)]
            t = np.arange(m)
            weight = stirling[m, 1:m + 1] + np.cumsum(np.log(mass[rows, None] + discount * t), axis=1) \
                + (t + 1) * np.log(p[rows, None])
            weight = np.exp(weight - weight.max(axis=1, keepdims=True))
            total = np.cumsum(weight, axis=1)
            out[rows] = 1 + (total < rng.random(len(rows))[:, None] * total[:, -1:]).sum(axis=1)
    large = np.flatnonzero(n > EXACT_UP_TO)
    if len(large):
        rows = np.repeat(large, PROPOSALS)
        seated, t, weight = np.ones(len(rows), np.int64), np.ones(len(rows), np.int64), np.zeros(len(rows))
        while len(todo := np.flatnonzero(seated < n[rows])):
            r = rows[todo]
            step = np.minimum(np.maximum(1, seated[todo] // 64), n[r] - seated[todo])
            new = (mass[r] + discount * t[todo]) * p[r]
            total = new + seated[todo] - discount * t[todo]
            t[todo] += rng.binomial(step, new / total)
            weight[todo] += step * np.log(total)
            seated[todo] += step
        weight = weight.reshape(-1, PROPOSALS)
        weight = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
        chosen = (weight < rng.random(len(large))[:, None] * weight[:, -1:]).sum(axis=1)
        out[large] = t.reshape(-1, PROPOSALS)[np.arange(len(large)), chosen]
    return out


def chain(dishes: Dishes, model: Model, group: int, stirling: tuple[np.ndarray, np.ndarray], *, second: bool,
          samples: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Samples of a round: tables per dish, then per word the parent's
    customers and tables. Every sweep redraws each context's seating, then the
    parent's. Frequent words keep the parent seating that the totals have."""
    given = model.totals[1 if second else 0]
    rng = np.random.Generator(np.random.Philox(key=[model.seed * 2 + second, group]))
    tables = np.minimum(dishes.n, 1)
    customers = dishes.per_word(tables)
    parent = np.minimum(customers, 1)
    customers[dishes.often], parent[dishes.often] = given.often_customers[dishes.place], given.often_tables[dishes.place]
    for sweep in range(BURN_IN + samples):
        p = model.base(customers, parent, given)
        mass = CONCENTRATION + model.discount * np.maximum(given.tables[dishes.ctx] - tables, 0)
        tables = draw_tables(rng, dishes.n, mass, p[dishes.owner], model.discount, stirling[0])
        own = dishes.per_word(tables)
        customers = np.where(dishes.often, customers, own)
        mass = CONCENTRATION + model.parent_discount * np.maximum(given.parent_tables - parent, 0)
        drawn = draw_tables(rng, customers.astype(np.int64), mass, np.full(len(customers), 1 / (model.vocabulary + 1)),
                            model.parent_discount, stirling[1])
        parent = np.where(dishes.often, parent, drawn)
        if sweep >= BURN_IN:
            yield tables, np.where(dishes.often, own, customers), parent


def _stirlings(model: Model) -> tuple[np.ndarray, np.ndarray]:
    return log_stirling(EXACT_UP_TO, model.discount), log_stirling(EXACT_UP_TO, model.parent_discount)


#: Rows of statistics: what, sample, number, value and a second value.
_STATS = "kind string, s int, k int, x double, y double"


def _stats(kind: str, s: int, k: np.ndarray, x: np.ndarray, y: np.ndarray | None = None) -> pa.RecordBatch:
    n = len(k)
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * n, pa.string()), pa.array([s] * n, pa.int32()), pa.array(k, pa.int32()),
         pa.array(np.asarray(x, float), pa.float64()),
         pa.array(np.zeros(n) if y is None else np.asarray(y, float), pa.float64())], names=["kind", "s", "k", "x", "y"])


def _counted(frequent: np.ndarray):
    """Training customers and dishes per context; of frequent words; and how many words and dishes there are by size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(1).to_pylist():
                d = Dishes(blob, frequent)
                learned = np.minimum(d.n, 1)
                customers = np.bincount(d.ctx, weights=d.n, minlength=CONTEXTS)
                at = np.flatnonzero(customers)
                yield _stats("context", 0, at, customers[at], np.bincount(d.ctx, weights=learned, minlength=CONTEXTS)[at])
                counts, kinds = d.per_word(d.n), d.per_word(learned)
                yield _stats("often", 0, d.place, counts[d.often], kinds[d.often])
                rest = kinds[~d.often]
                yield _stats("sum", 0, np.arange(5), [
                    (rest > 0).sum(), (rest == 1).sum(), (rest == 2).sum(), (d.n == 1).sum(), (d.n == 2).sum()])

    return run


def _seated(model: Model, second: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stirling = _stirlings(model)
        for batch in batches:
            for g, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                d = Dishes(blob, model.frequent)
                for s, (tables, customers, parent) in enumerate(
                        chain(d, model, g, stirling, second=second, samples=SAMPLES if second else 1)):
                    sums = np.bincount(d.ctx, weights=tables, minlength=CONTEXTS)
                    at = np.flatnonzero(sums)
                    yield _stats("context", s, at, sums[at])
                    yield _stats("often", s, d.place, customers[d.often])
                    yield _stats("sum", s, np.arange(2), [customers[~d.often].sum(), parent[~d.often].sum()])

    return run


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stirling = _stirlings(model)
        for batch in batches:
            for g, blob, where in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                d = Dishes(blob, model.frequent)
                mean = np.zeros(len(d.n))
                for t, (tables, customers, parent) in zip(
                        model.totals[2:], chain(d, model, g, stirling, second=True, samples=SAMPLES), strict=True):
                    customers[d.often], parent[d.often] = t.often_customers[d.place], t.often_tables[d.place]
                    p = model.base(customers, parent, t)[d.owner]
                    mean += (d.n - model.discount * tables + (CONCENTRATION + model.discount * t.tables[d.ctx]) * p) \
                        / (CONCENTRATION + model.customers[d.ctx])
                counts = d.per_word(d.n)
                counts[d.often] = model.often_counts[d.place]
                base = np.log10((counts + 1) / (model.tokens + model.vocabulary + 1))[d.owner]
                n, doc, rid, ids, flags = _unpack(where, "<u8", "<u4", "<i8", "<i8", "u1")
                of = np.repeat(np.arange(len(n)), n.astype(np.int64))

                def summed(values: np.ndarray) -> np.ndarray:
                    return np.bincount(doc, weights=values[of], minlength=len(rid))

                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid), pa.array(ids, mask=(flags & 2) > 0), pa.array((flags & 1) > 0),
                     pa.array(np.bincount(doc, minlength=len(rid)).astype(np.int64)),
                     pa.array(summed((counts > 0)[d.owner].astype(float)).astype(np.int64)),
                     pa.array(summed(base)), pa.array(summed(np.log10(mean / SAMPLES)))],
                    names=["rid", "id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def _frequent_words(texts: DataFrame, groups: int) -> np.ndarray:
    """Hashes of words that fill a good part of a group by themselves, on a bounded sample of documents."""
    sample = texts.orderBy(F.xxhash64("rid")).limit(SAMPLE_DOCS).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = hashing.text_bytes(batch.column(0))
            for i, j in hashing.row_groups(offsets):
                w, n = np.unique(tokens_of(data, offsets[i:j + 1])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n)], names=["w", "n"])

    counts = written(sample.mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")), "lm_sample")
    least = (counts.agg(F.sum("n")).first()[0] or 0) / (8 * groups)
    top = counts.where(F.col("n") >= max(least, 1)).orderBy(F.desc("n"), "w").limit(MAX_FREQUENT).collect()
    return np.sort(np.array([r["w"] for r in top], np.int64).view(np.uint64))


def _collected(stats: DataFrame):
    """Sums over all groups: at most CONTEXTS + MAX_FREQUENT + 5 rows a sample."""
    return stats.groupBy("kind", "s", "k").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).toPandas()


def _array(found, kind: str, s: int, size: int, column: str = "x") -> np.ndarray:
    rows = found[(found["kind"] == kind) & (found["s"] == s)]
    out = np.zeros(size)
    out[rows["k"].to_numpy(np.int64)] = rows[column].to_numpy()
    return out


def _totals(model: Model, found, s: int, rng: np.random.Generator) -> Totals:
    """Sums of a sample; the parent seats the frequent words here, each with all its customers."""
    customers = _array(found, "often", s, len(model.frequent))
    before = model.totals[-1]
    mass = CONCENTRATION + model.parent_discount * np.maximum(before.parent_tables - before.often_tables, 0)
    tables = draw_tables(rng, customers.astype(np.int64), mass, np.full(len(customers), 1 / (model.vocabulary + 1)),
                         model.parent_discount, log_stirling(EXACT_UP_TO, model.parent_discount))
    sums = _array(found, "sum", s, 2)
    return Totals(_array(found, "context", s, CONTEXTS), sums[0] + customers.sum(), sums[1] + tables.sum(), customers, tables)


def _discount(ones: float, twos: float) -> float:
    """The usual estimate of a discount from how many things were seen once and twice."""
    return float(np.clip(ones / (ones + 2 * twos), 0.05, 0.95)) if ones else 0.5


def _model(found, frequent: np.ndarray, seed: int) -> Model:
    """The model before any sampling: every word has one table in each of its contexts."""
    customers, kinds = _array(found, "context", 0, CONTEXTS), _array(found, "context", 0, CONTEXTS, "y")
    often, often_kinds = _array(found, "often", 0, len(frequent)), _array(found, "often", 0, len(frequent), "y")
    words, once, twice, ones, twos = _array(found, "sum", 0, 5)
    model = Model(frequent, customers, often, int(customers.sum()), int(words + (often > 0).sum()),
                  _discount(ones, twos), _discount(once + (often_kinds == 1).sum(), twice + (often_kinds == 2).sum()), seed)
    model.totals = [Totals(kinds, kinds.sum(), model.vocabulary, often_kinds, np.minimum(often_kinds, 1))]
    return model


def score_documents(docs: DataFrame, held_out: Column, *, id_col: str = "doc_id", text_col: str = "text",
                    seed: int = 11) -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``n_tokens``, ``n_known``
    (tokens seen in training), ``train_tokens``, ``base_score`` (add-one
    unigram) and ``score`` (the model), log10 probabilities of the whole text,
    and ``perplexity`` (of the model, per token).

    Tokens: words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one end.
    Rows for which ``held_out`` is not true are learned from. A null text is
    empty: its end alone. Repeated rows are scored each; ids must be integers
    and may be null; other columns play no part; an empty table gives no rows,
    and with nothing to learn from, every word has the uniform probability."""
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("id"),
                        F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text_col).cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length(filled(F.col("text"))))).first()[0] or 0
    groups = max(16, math.ceil(size / GROUP_BYTES))
    frequent = _frequent_words(texts, groups)
    blocks = texts.mapInArrow(_dealt(frequent, groups), "g int, block binary")
    # Group g is partition g: no two groups share a task.
    held = blocks.repartitionById(groups, F.col("g")).groupBy("g").applyInArrow(
        _grouped, "g int, dishes binary, places binary")
    held = written(held, "lm_groups")
    seats = held.select("g", "dishes")

    model = _model(_collected(seats.mapInArrow(_counted(frequent), _STATS)), frequent, seed)
    rng = np.random.Generator(np.random.Philox(key=[seed, 1 << 40]))
    first = _collected(seats.mapInArrow(_seated(model, False), _STATS))
    model.totals.append(_totals(model, first, 0, rng))
    second = _collected(seats.mapInArrow(_seated(model, True), _STATS))
    model.totals += [_totals(model, second, s, rng) for s in range(SAMPLES)]

    parts = held.mapInArrow(
        _scored(model), "rid long, id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    return parts.groupBy("rid", "id", "held_out").agg(*sums).select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def held_out(id_col: str = "doc_id", modulus: int = 7, residue: int = 2) -> Column:
    """Whether the checksum of the id as text leaves the residue; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == residue, F.lit(False))
