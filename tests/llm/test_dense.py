"""Vector codes and whitening."""

import hashlib
import math
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkvox.llm import vector_codes, whitening
from sparkvox.llm.queries import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")


def awkward() -> list[tuple]:
    """Null, empty, non-finite and repeated vectors, ties, null ids and labels."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-4, 5, 16) / 8], i % 3 if i % 5 else None) for i in range(100, 20, -1)]
    bad = [(1, None, 0), (2, [], 1), (3, [NAN] * 16, 1), (4, [0.5] * 15 + [INF], 2), (5, [None] + [0.25] * 15, None), (6, [-INF] * 16, None)]
    return rows + bad + rows[:30] + [(None, [0.125] * 16, None), (None, [-0.125] * 16, 7), (7, [0.0] * 16, None), (7, [-0.001] * 16, 1)]


def good(rows):
    return [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]


def codes(rows, parts, entries, rounds):
    """vec_id, code, error, label_error of each kept row, and the codebooks' numbers, by comparing all."""
    rows = good(rows)
    x = np.array([[math.floor(256 * float(np.float32(c))) for c in r[1]] for r in rows])
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0], rows[i][1]))
    cut = x.reshape(len(x), parts, -1)
    books = [cut[order[:entries], p].tolist() for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            own = defaultdict(list)
            for part in cut[:, p].tolist():
                own[nearest(part, book)[1]].append(part)
            books[p] = [[sum(c) // len(own[k]) for c in zip(*own[k], strict=True)] if k in own else e for k, e in enumerate(book)]
    found = [[nearest(v[p].tolist(), books[p]) for p in range(parts)] for v in cut]
    errors = [sum(d for d, _ in f) for f in found]
    labels = Counter()
    for r, e in zip(rows, errors, strict=True):
        labels[r[2]] += e
    return [(r[0], bytes(k for _, k in f), e, labels[r[2]]) for r, f, e in zip(rows, found, errors, strict=True)], \
        ",".join(str(c) for b in books for e in b for c in e)


@pytest.mark.parametrize(("n", "width", "size"), [(1, 2, 3), (8, 1, 2), (64, 4, 30), (64, 4, 2), (200, 2, 4), (256, 4, 10**8)])
def test_tree_finds_the_nearest_entry(n, width, size):
    rng = np.random.default_rng(n + size)
    entries = rng.integers(-size, size + 1, (n, width))
    queries = np.vstack([rng.integers(-2 * size, 2 * size + 1, (20_000, width)), entries])
    tree = vector_codes.Gnat(entries)
    at, least = tree.nearest(queries)
    every = ((queries[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (at == every.argmin(axis=1)).all() and (least == every.min(axis=1)).all()
    assert n <= 8 or tree.measured < 0.6 * every.size


def test_equal_entries():
    at, least = vector_codes.Gnat(np.ones((64, 4), int)).nearest(np.zeros((3, 4), int))
    assert at.tolist() == [0] * 3 and least.tolist() == [4] * 3


@pytest.mark.parametrize(("parts", "entries"), [(4, 8), (16, 64), (1, 200)])
def test_codes_equal_plain_version(spark, parts, entries):
    rows = awkward()
    want, numbers = codes(rows, parts, entries, 2)
    table = spark.createDataFrame(rows, VECTORS).repartition(5)
    books = vector_codes.fit(table, parts=parts, entries=entries)
    got = vector_codes.errors_by_label(vector_codes.compress(table, books)).select("vec_id", "code", "error", "label_error")
    assert Counter((r[0], bytes(r[1]), r[2], r[3]) for r in got.collect()) == Counter(want)
    assert books.numbers() == numbers and books.sha256() == hashlib.sha256(numbers.encode()).hexdigest()


def test_codes_query_equals_sql(spark, tmp_path):
    con = duckdb.connect()
    spark.createDataFrame(awkward(), VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    for d, files in ((SMALL, "embeddings.parquet"), (tmp_path, "embeddings.parquet/*.parquet")):
        con.execute(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{d}/{files}'")
        got = QUERIES["op12_gnat_codes"](spark, str(d))
        assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
        found = con.execute(f"SELECT {', '.join(got.columns)} FROM ({SQL['op12_gnat_codes']})").fetchall()
        assert Counter(map(tuple, got.collect())) == Counter(found) and found


def test_codebooks_are_kept_and_undone(spark, tmp_path):
    table = spark.createDataFrame(good(awkward()), VECTORS)
    books = vector_codes.fit(table, parts=16, entries=64)
    books.save(spark, f"{tmp_path}/books")
    again = vector_codes.Codebooks.load(spark, f"{tmp_path}/books")
    assert (again.entries == books.entries).all() and again.scale == books.scale
    coded = vector_codes.compress(table.withColumn("same", F.col("embedding")), again)
    for r in vector_codes.decompress(coded, again).collect():
        x = np.array([math.floor(256 * c) for c in r["same"]])
        assert ((np.array(r["approximation"]) * 256 - 0.5 - x) ** 2).sum() == r["error"]


def test_codes_of_nothing_and_clashing_columns(spark):
    none = spark.createDataFrame([], VECTORS)
    books = vector_codes.fit(none)
    assert vector_codes.errors_by_label(vector_codes.compress(none, books)).collect() == []
    bad = spark.createDataFrame([r for r in awkward() if r[0] in range(1, 7)], VECTORS)
    assert vector_codes.compress(bad, vector_codes.fit(bad)).collect() == []
    table = spark.createDataFrame(awkward(), VECTORS).select("*", F.lit("c").alias("code"), F.lit("e").alias("Error"), F.lit("l").alias("label_error"))
    got = vector_codes.compress(table, vector_codes.fit(table, entries=8))
    assert got.columns == ["vec_id", "label", "code", "Error", "label_error", "code_", "error_"]
    summed = vector_codes.errors_by_label(got, error_col="error_")
    assert summed.columns[-1] == "label_error_" and summed.count() == len(good(awkward()))


def test_vectors_of_two_lengths_are_an_error(spark):
    table = spark.createDataFrame([(1, [0.5] * 16, 1), (2, [0.5] * 32, 1)], VECTORS)
    with pytest.raises(Exception, match="16 and 32 components"):
        vector_codes.fit(table)
    with pytest.raises(Exception, match="16 and 32 components"):
        whitening.fit(table)


# --- whitening ---

def matrices():
    rng = np.random.default_rng(0)
    q, _ = np.linalg.qr(rng.normal(size=(32, 32)))
    for n in (1, 2, 3, 17, 64):
        b = rng.normal(size=(3 * n + 5, n))
        yield b.T @ b * 10.0 ** (n % 5)
    for e in (2.0 ** -np.arange(32), np.r_[np.arange(1, 6), np.zeros(27)], np.r_[np.ones(16), 2 * np.ones(16)],
              1 + 1e-9 * np.arange(32), np.r_[1e12, np.ones(31)], np.arange(32) - 16.0, np.ones(32)):
        a = (q * e) @ q.T
        yield (a + a.T) / 2
    yield from (np.diag(np.arange(9.0)), np.ones((9, 9)), np.eye(5) * 3 + np.ones((5, 5)), np.zeros((4, 4)))


@pytest.mark.parametrize("a", list(matrices()), ids=lambda a: str(len(a)))
def test_spectrum(a):
    values, vectors = whitening.spectrum(a)
    size = max(np.abs(a).max(), 1e-300) * len(a)
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() < 1e-14 * size and (np.diff(values) <= 0).all()
    assert np.abs(a @ vectors - vectors * values).max() < 1e-14 * size
    assert np.abs(vectors.T @ vectors - np.eye(len(a))).max() < 1e-11
    gap = np.abs(np.diff(values, prepend=np.inf, append=-np.inf))
    alone = np.minimum(gap[1:], gap[:-1]) > 1e-3 * size  # well apart: the eigenvector is one
    plain = np.linalg.eigh(a)[1][:, ::-1]
    assert np.abs(np.abs((vectors * plain).sum(axis=0))[alone] - 1).max(initial=0) < 1e-12


def test_polar_factor_is_the_sign():
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.normal(size=(40, 40)))
    e = np.r_[-(10.0 ** -np.arange(20)), 10.0 ** -np.arange(20) * 0.7]  # down to 1e-19 of the largest
    big = np.abs(e) > 1e-14
    u = whitening.polar_factor((q * e) @ q.T)
    assert np.abs(((q.T @ u @ q) - np.diag(np.sign(e)))[np.ix_(big, big)]).max() < 0.05
    firm = np.abs(e) > 1e-8
    assert np.abs(((q.T @ u @ q) - np.diag(np.sign(e)))[np.ix_(firm, firm)]).max() < 1e-6


def plain(vectors: list[list[float]], k: int):
    x = np.array([[math.floor(64 * c) + 1000000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(axis=0)
    centred = ((x * n - s) / n).astype(float)
    values, u = np.linalg.eigh(centred.T @ centred / n)
    values, u = values[::-1][:k], u[:, ::-1][:, :k]
    trace = (centred ** 2).sum() / n
    return ((n * x - s) ** 2).sum(axis=1), centred @ u / np.sqrt(values), values / trace


def test_whitening_query(spark):
    got = QUERIES["op13_qdwh_whitening"](spark, SMALL)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    found = got.toPandas()
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").collect()
    deviation, white, explained = plain([r["embedding"] for r in rows], 32)
    assert len(found) == 32 * len(rows) and set(found["n"]) == {len(rows)} and found["identity_error"].max() < 1e-9
    table = found.pivot(index="vec_id", columns="component", values="whitened")
    assert table.columns.tolist() == list(range(1, 33)) and table.index.tolist() == [r["vec_id"] for r in rows]
    sign = np.sign((table.to_numpy() * white).sum(axis=0))
    assert np.abs(table.to_numpy() * sign - white).max() < 1e-9
    assert (found.groupby("vec_id")["deviation"].agg(["min", "max"]).to_numpy() == deviation.astype(np.int64)[:, None]).all()
    assert np.abs(found.groupby("component")["explained"].first().to_numpy() / explained - 1).max() < 1e-12


def test_whitening_of_awkward_rows(spark):
    rows = awkward()
    want = good(rows)
    table = spark.createDataFrame(rows, VECTORS).withColumn("whitened", F.lit("own"))
    found = []
    for parts in (1, 7):
        model = whitening.fit(table.repartition(parts), components=5)
        assert model.n == len(want) and model.vectors.shape == (16, 5) and model.identity_error < 1e-10
        got = whitening.whiten(table, model)
        assert got.columns == ["vec_id", "label", "whitened", "whitened_", "deviation"]
        found.append(sorted((r["vec_id"] is None, r["vec_id"], tuple(r["whitened_"]), int(r["deviation"])) for r in got.collect()))
    assert found[0] == found[1]  # exact sums: the same to the last bit for any partitioning
    deviation, _, _ = plain([[float(np.float32(x)) for x in r[1]] for r in want], 5)
    assert sorted(d for *_, d in found[0]) == sorted(deviation)


def test_whitening_without_variance(spark):
    for vectors in ([[0.5, 1.0, -2.0]], [[0.5, 1.0, -2.0]] * 3):
        table = spark.createDataFrame([(k, v, None) for k, v in enumerate(vectors)], VECTORS)
        rows = whitening.components(whitening.whiten(table, whitening.fit(table)), whitening.fit(table)).collect()
        assert len(rows) == 3 * len(vectors) and {(r["whitened"], r["explained"], r["deviation"], r["identity_error"]) for r in rows} == {(None, 0.0, 0, 0.0)}
    # The third dimension follows from the others: two components.
    table = spark.createDataFrame([(k, [k % 5 / 2.0, k % 7 / 2.0, k % 5 / 2.0 + k % 7 / 2.0], 1) for k in range(60)], VECTORS)
    model = whitening.fit(table)
    assert model.varies.tolist() == [True, True, False] and model.identity_error < 1e-12
    none = spark.createDataFrame([], VECTORS)
    model = whitening.fit(none)
    assert whitening.components(whitening.whiten(none, model), model).collect() == []


def test_whitening_of_large_numbers(spark):
    """Beyond 53 bits the sums are still exact."""
    rng = np.random.default_rng(5)
    vectors = [[float(x) for x in rng.integers(-10**9, 10**9, 4) * 300] for _ in range(50)]
    table = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    model = whitening.fit(table)
    deviation, white, _ = plain(vectors, 4)
    got = whitening.whiten(table, model).orderBy("vec_id").collect()
    assert [int(r["deviation"]) for r in got] == deviation.tolist()
    assert np.abs(np.abs([r["whitened"] for r in got]) - np.abs(white)).max() < 1e-9
    with pytest.raises(Exception, match="exact sums need"):
        whitening.fit(spark.createDataFrame([(1, [1e300])], "vec_id long, embedding array<double>"))
