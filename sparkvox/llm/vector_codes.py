"""Vector compression: product quantisation whose nearest entries are found in
a geometric near-neighbour access tree (GNAT) over each codebook.

A vector's components become integers and are cut into equal parts; every part
position has a codebook, and a vector's code names the nearest entry of each
part. Codebooks are refined by rounds of assigning and averaging: tasks add up
their parts per entry, one aggregate sums these, and the driver sees entries x
dimensions numbers, whatever the number of vectors.

A GNAT node holds split points and, for every pair of a split point and a
child, the range of distances from the one to the entries below the other. A
query measures its distance to the split points and drops each child whose
range cannot hold a distance as small as the best so far. It drops strictly:
bounds are rounded away from each other, so an entry as near as the best stays,
and the integers decide, ties going to the lower number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkvox.llm.common import unused, written
from sparkvox.llm.dense import floored, slices, usable
from sparkvox.session import ship_package

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Split points of a GNAT node; up to this many entries are a leaf.
DEGREE = 8
#: Queries that pass a node together.
QUERIES = 1 << 14

#: More than the rounding error of a distance or of a sum of two, relative to it.
_SLACK = 2.0**-48


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances between the rows of ``a`` and of ``b``, exact."""
    out = np.zeros((len(a), len(b)), np.int64)
    for k in range(a.shape[1]):
        gap = a[:, k, None] - b[None, :, k]
        out += gap * gap
    return out


@dataclass
class Node:
    """``numbers`` are the entries that are compared here, ascending: a leaf's
    entries or the split points. ``near[i, j]`` and ``far[i, j]`` bound the
    distances from split point i to the entries below child j."""

    numbers: np.ndarray
    children: list[Node | None] = field(default_factory=list)
    near: np.ndarray | None = None
    far: np.ndarray | None = None


class Gnat:
    """Exact nearest entry of integer points."""

    def __init__(self, entries: np.ndarray, degree: int = DEGREE):
        self.entries = np.ascontiguousarray(entries, np.int64)
        self.measured = 0  # distances measured so far
        self._root = self._built(np.arange(len(entries)), max(2, degree))

    def _built(self, numbers: np.ndarray, degree: int) -> Node:
        if len(numbers) <= degree:
            return Node(numbers)
        points = self.entries[numbers]
        # Split points far apart: each the entry farthest from those before it.
        picked = [0]
        least = _squares(points, points[:1])[:, 0]
        while len(picked) < degree:
            picked.append(int(least.argmax()))
            least = np.minimum(least, _squares(points, points[picked[-1:]])[:, 0])
        splits = np.array(sorted(set(picked)))
        if len(splits) < 2:  # all entries are equal
            return Node(numbers)
        node = Node(numbers[splits])
        rest = np.setdiff1d(np.arange(len(numbers)), splits)
        squares = _squares(points[splits], points[rest])
        child = squares.argmin(axis=0)
        root = np.sqrt(squares.astype(np.float64))
        node.near, node.far = np.zeros((len(splits), len(splits))), np.zeros((len(splits), len(splits)))
        for j in range(len(splits)):
            below = child == j
            node.children.append(self._built(numbers[rest[below]], degree) if below.any() else None)
            if below.any():
                node.near[:, j] = root[:, below].min(axis=1) * (1 - _SLACK)
                node.far[:, j] = root[:, below].max(axis=1) * (1 + _SLACK)
        return node

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest entry, the lowest of equally near ones, and
        the squared distance to it, per row."""
        at = np.zeros(len(queries), np.int64)
        best = np.full(len(queries), np.iinfo(np.int64).max)
        for s in range(0, len(queries), QUERIES):
            self._search(self._root, np.arange(s, min(s + QUERIES, len(queries))), queries, at, best)
        return at, best

    def _search(self, node: Node, rows: np.ndarray, queries: np.ndarray, at: np.ndarray, best: np.ndarray) -> None:
        squares = _squares(queries[rows], self.entries[node.numbers])
        self.measured += squares.size
        k = squares.argmin(axis=1)  # numbers ascend, so the first is the lowest
        least, number = squares[np.arange(len(rows)), k], node.numbers[k]
        better = (least < best[rows]) | ((least == best[rows]) & (number < at[rows]))
        at[rows[better]], best[rows[better]] = number[better], least[better]
        if not node.children:
            return
        root = np.sqrt(squares.astype(np.float64))
        low, high = root * (1 - _SLACK), root * (1 + _SLACK)
        order = squares.argsort(axis=1, kind="stable")
        for turn in range(len(node.numbers)):  # each query visits the child of its nearest split point first
            for j, child in enumerate(node.children):
                here = np.flatnonzero(order[:, turn] == j) if child else ()
                if not len(here):
                    continue
                reach = np.sqrt(best[rows[here]].astype(np.float64))[:, None] * (1 + _SLACK)
                out = (low[here] > (node.far[:, j] + reach) * (1 + _SLACK)).any(axis=1)
                out |= ((high[here] + reach) * (1 + _SLACK) < node.near[:, j]).any(axis=1)
                if not out.all():
                    self._search(child, rows[here[~out]], queries, at, best)


@dataclass
class Codebooks:
    """Integer entries (parts x entries x components of a part) and the factor that made the integers."""

    entries: np.ndarray
    scale: int = SCALE

    @property
    def dims(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def limit(self) -> int:
        """Greatest integer whose exact squared distances fit into 64 bits."""
        return int((2.0**62 / max(self.dims, 1))**0.5 / 2)

    def numbers(self) -> str:
        """All entries' components by part, entry and position, in decimal."""
        return ",".join(map(str, self.entries.ravel().tolist()))

    def sha256(self) -> str:
        return hashlib.sha256(self.numbers().encode()).hexdigest()

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(p, e, [int(x) for x in entry], self.scale) for p, book in enumerate(self.entries) for e, entry in enumerate(book)]
        spark.createDataFrame(rows, "part int, entry int, components array<long>, scale int").coalesce(1).write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Codebooks:
        rows = spark.read.parquet(path).orderBy("part", "entry").collect()
        if not rows:
            return Codebooks(np.zeros((1, 0, 0), np.int64))
        parts = rows[-1]["part"] + 1
        return Codebooks(np.array([r["components"] for r in rows], np.int64).reshape(parts, len(rows) // parts, -1), rows[0]["scale"])


def _assigner(books: Codebooks):
    """Code, error and the integers themselves of a batch's vectors."""
    parts, _, width = books.entries.shape
    trees = [Gnat(book) for book in books.entries]

    def run(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = floored(column, books.dims, books.scale, books.limit())
        code, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
        for p, tree in enumerate(trees):
            code[:, p], least = tree.nearest(np.ascontiguousarray(x[:, p * width:(p + 1) * width]))
            error += least
        return code, error, x

    return run


def _summed(books: Codebooks, at: int):
    parts, entries, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assign = _assigner(books)
        sums, counts = np.zeros(books.entries.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for piece in slices(batch, books.dims):
                code, _, x = assign(piece.column(at))
                for p in range(parts):
                    k = code[:, p]
                    counts[p] += np.bincount(k, minlength=entries)
                    order = k.argsort(kind="stable")
                    first = np.flatnonzero(np.diff(k[order], prepend=-1))
                    if len(first):
                        own = x[order, p * width:(p + 1) * width]
                        sums[p, k[order][first]] += np.add.reduceat(own, first, axis=0)
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(p, width), pa.int32()), pa.array(np.repeat(e, width), pa.int32()),
             pa.array(np.tile(np.arange(width), len(p)), pa.int32()), pa.array(sums[p, e].ravel()),
             pa.array(np.repeat(counts[p, e], width))], names=["part", "entry", "place", "s", "n"])

    return run


def fit(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS,
        entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks of all usable vectors (see `compress`). They start as the
    parts of the ``entries`` vectors of the smallest ids, null ids last, equal
    ids by their components. Of each round only entries x dimensions sums reach
    the driver."""
    if not 0 < entries <= 256:
        raise ValueError(f"{entries} entries: a code has one byte per part")
    spark = vectors.sparkSession
    ship_package(spark)
    kept = vectors.where(usable(F.col(vector_col))).select(F.col(id_col).alias("i"), F.col(vector_col).alias("v"))
    first = [r["v"] for r in kept.orderBy(F.col("i").asc_nulls_last(), "v").limit(entries).collect()]
    if not first:
        return Codebooks(np.zeros((parts, 0, 0), np.int64), scale)
    dims = len(first[0])
    if dims % parts:
        raise ValueError(f"{dims} components cannot be cut into {parts} equal parts")
    books = Codebooks(np.zeros((parts, len(first), dims // parts), np.int64), scale)
    start = floored(pa.array(first, pa.list_(pa.float64())), dims, scale, books.limit())
    books.entries = np.ascontiguousarray(start.reshape(len(first), parts, -1).transpose(1, 0, 2))
    for _ in range(rounds):
        found = (kept.select("v").mapInArrow(_summed(books, 0), "part int, entry int, place int, s long, n long")
                 .groupBy("part", "entry", "place").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect())
        new = books.entries.copy()
        for r in found:
            new[r["part"], r["entry"], r["place"]] = r["s"] // r["n"]
        books = Codebooks(new, scale)
    return books


def _compressed(books: Codebooks, at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assign = _assigner(books)
        for batch in batches:
            for piece in slices(batch, books.dims):
                code, error, _ = assign(piece.column(at))
                kept = [c for k, c in enumerate(piece.columns) if k != at]
                codes = pa.FixedSizeBinaryArray.from_buffers(
                    pa.binary(code.shape[1]), len(code), [None, pa.py_buffer(code.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*kept, codes, pa.array(error)], names=names)

    return run


def compress(vectors: DataFrame, books: Codebooks, *, vector_col: str = "embedding") -> DataFrame:
    """The usable rows of ``vectors`` with ``code`` (a byte per part) and
    ``error`` (squared distance of the integers from the entries) in place of
    the vector. No shuffle.

    Usable: not null, not empty, all components finite numbers; other rows go.
    Repeated rows and ids stay and get equal codes; ties between entries go to
    the lower number. Every other column passes through, nulls included; where
    one is named like an added column, the added one gets underscores. An empty
    table stays empty. Vectors of different lengths, or components too large
    for exact 64-bit distances (beyond 524,288 for 64 components at scale
    256), are errors."""
    ship_package(vectors.sparkSession)
    at = vectors.columns.index(vector_col)
    rest = [f for k, f in enumerate(vectors.schema.fields) if k != at]
    code, error = unused(vectors.drop(vector_col), "code", "error")
    schema = T.StructType([*rest, T.StructField(code, T.BinaryType()), T.StructField(error, T.LongType())])
    return vectors.where(usable(F.col(vector_col))).mapInArrow(_compressed(books, at, schema.names), schema)


def decompress(codes: DataFrame, books: Codebooks, *, code_col: str = "code") -> DataFrame:
    """``codes`` with ``approximation``: the middle of the entries' components, as
    numbers of the vectors' own size. Native; the entries go along as a literal."""
    book = F.lit([[[(int(x) + 0.5) / books.scale for x in e] for e in b] for b in books.entries])
    code = F.hex(F.col(code_col))
    number = [F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int") for p in range(len(books.entries))]
    out, = unused(codes, "approximation")
    return codes.withColumn(out, F.concat(*[F.get(F.get(book, p), k) for p, k in enumerate(number)]))


def errors_by_label(codes: DataFrame, *, label_col: str = "label", error_col: str = "error") -> DataFrame:
    """``codes`` with ``label_error``, the errors' sum over the rows of a label;
    null labels count as one. The sums are aggregated in the tasks first and
    written, so a common label meets nowhere as rows, and Spark knows their
    size: few labels are broadcast, many are joined by shuffle, where adaptive
    execution splits a common one."""
    out, key = unused(codes, "label_error", "_label")
    sums = written(codes.groupBy(F.col(label_col).alias(key)).agg(F.sum(error_col).alias(out)), "label_errors")
    return codes.join(sums, F.col(label_col).eqNullSafe(F.col(key)), "left").drop(key)


def oracle_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """DuckDB SQL of the query's rows by comparing every part with every entry."""
    steps = [f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
part AS MATERIALIZED (
  SELECT rid, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS a
  FROM kept, range({parts}) AS r(p)),
book0 AS MATERIALIZED (
  SELECT p, e, a AS b FROM part JOIN (
    SELECT rid, row_number() OVER (ORDER BY vec_id NULLS LAST, v, rid) - 1 AS e FROM kept) USING (rid) WHERE e < {entries})"""]
    for r in range(rounds + 1):
        steps.append(f"""near{r} AS MATERIALIZED (
  SELECT rid, p, min(list_sum(list_transform(list_zip(a, b), lambda z: CAST((z[1] - z[2]) * (z[1] - z[2]) AS HUGEINT))) * {entries} + e) AS m
  FROM part JOIN book{r} USING (p) GROUP BY rid, p)""")
        if r < rounds:
            steps.append(f"""mean{r} AS (
  SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY k) AS b FROM (
    SELECT p, m % {entries} AS e, k, sum(a[k]) AS s, count(*) AS n
    FROM near{r} JOIN part USING (rid, p), range(1, 1 + len(a)) AS q(k) GROUP BY ALL) GROUP BY p, e),
book{r + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(CAST(mean{r}.b AS BIGINT[]), book{r}.b) AS b FROM book{r} LEFT JOIN mean{r} USING (p, e))""")
    return f"""WITH {", ".join(steps)},
coded AS (
  SELECT rid, string_agg(lower(printf('%02x', CAST(m % {entries} AS INTEGER))), '' ORDER BY p) AS code,
    CAST(sum(m // {entries}) AS BIGINT) AS error FROM near{rounds} GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(b, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
FROM kept JOIN coded USING (rid)"""
