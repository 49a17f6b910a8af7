"""Words of scripts without spaces (mini_segment)."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkvox.operators import segment as SG
from sparkvox.operators.numbering import first_rows
from sparkvox.operators.tokens import tokenize_docs

DOCS = "doc_id long, text string, lang string"


def cuts(run):
    """All ways to cut a run into words."""
    if not run:
        yield []
    for k in range(1, len(run) + 1):
        for rest in cuts(run[k:]):
            yield [run[:k], *rest]


def test_split_is_the_cheapest_path():
    rng = random.Random(3)
    for trial in range(300):
        letters = "あいう"
        costs = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 4))): rng.randint(1, 6) for _ in range(rng.randint(0, 12))}
        seg = SG.Segmenter(costs, 9, max(map(len, costs), default=1))
        run = "".join(rng.choice(letters + "え") for _ in range(rng.randint(1, 9)))
        possible = [c for c in cuts(run) if all(w in costs or len(w) == 1 for w in c)]
        price = lambda c: (sum(costs.get(w, 9) for w in c), len(c))
        best = min(map(price, possible))
        # Of equal paths, the longer last word, then the longer one before it.
        want = max((c for c in possible if price(c) == best), key=lambda c: [len(w) for w in reversed(c)])
        assert seg.split(run) == want, (trial, run, costs)


def test_expected_counts_by_enumeration():
    rng = random.Random(5)
    for _ in range(100):
        letters = "かきく"
        probability = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 3))): rng.random() for _ in range(8)}
        run, least = "".join(rng.choice(letters) for _ in range(rng.randint(1, 9))), 0.01
        want, total = defaultdict(float), 0.0
        for c in cuts(run):
            if all(w in probability or len(w) == 1 for w in c):
                weight = math.prod(probability.get(w, least) for w in c)
                total += weight
                for w in c:
                    want[w] += weight
        got = SG.expected_counts(run, probability, 3, least)
        assert got.keys() == want.keys()
        assert all(math.isclose(got[w], want[w] / total, rel_tol=1e-9) for w in want)


def test_expected_counts_of_a_long_run():
    got = SG.expected_counts("ab" * 50_000, {"ab": 1e-5, "a": 1e-9, "b": 1e-9}, 4, 1e-12)
    assert math.isclose(got["ab"], 50_000, rel_tol=1e-6)


def plain_learning(runs: Counter, max_length, min_count, rounds):
    counts = Counter()
    for run, n in runs.items():
        for i in range(len(run)):
            for k in range(1, min(max_length, len(run) - i) + 1):
                counts[run[i:i + k]] += n
    counts = {w: n * SG.GRAIN for w, n in counts.items() if len(w) == 1 or n >= min_count}
    for _ in range(rounds):
        total = sum(counts.values())
        p, new = {w: n / total for w, n in counts.items()}, Counter()
        for run, n in runs.items():
            weights = [(math.prod(p[w] for w in c), c) for c in cuts(run) if all(w in p for w in c)]
            z, own = sum(w for w, _ in weights), Counter()
            for weight, c in weights:
                for w in c:
                    own[w] += weight / z
            for w, x in own.items():
                new[w] += round(x * n * SG.GRAIN)
        counts = {w: max(n, 1) for w, n in new.items() if len(w) == 1 or 2 * n >= min_count * SG.GRAIN}
    total = sum(counts.values())
    return {w: round(SG.UNIT * math.log(total / n)) for w, n in counts.items()}


def test_learning_equals_plain_version(spark, monkeypatch):
    rng = random.Random(7)
    words = ["ねこ", "いぬ", "とり", "が", "を", "みる", "たべる"]
    runs = Counter("".join(rng.choice(words) for _ in range(rng.randint(1, 4)))[:10] for _ in range(80))
    table = spark.createDataFrame(list(runs.items()), "run string, n long")
    want = plain_learning(runs, 4, 2, 3)
    monkeypatch.setattr(SG, "BLOCK", 3)  # blocks of start positions lose no substring
    for parts in (1, 5):
        seg = SG.learn(table.repartition(parts), max_length=4, rounds=3)
        assert seg.costs.keys() == want.keys() and all(abs(seg.costs[w] - want[w]) <= 2 for w in want)
    # Substrings of two words are found too, but the words are what most text is made of.
    assert [w for r in ["ねこがいぬをみる"] for w in seg.split(r)] in (["ねこ", "が", "いぬ", "を", "みる"], ["ねこが", "いぬを", "みる"])


def test_pieces_are_bounded_and_kept(spark, tmp_path):
    table = spark.createDataFrame([("あいうえお" * 4, 5), ("かきくけこ", 1)], "run string, n long")
    seg = SG.learn(table, max_pieces=12)
    assert len(seg.costs) <= 12 and set("あいうえおかきくけこ") <= set(seg.costs)
    seg.save(spark, f"{tmp_path}/pieces")
    assert SG.Segmenter.load(spark, f"{tmp_path}/pieces") == seg


@pytest.fixture(scope="module")
def segmenter():
    return SG.Segmenter({"東京": 1, "都": 2, "京都": 1, "東": 5, "に": 1, "住む": 1, "スパーク": 1}, 50, 4)


def test_spaced_and_unspaced_texts_in_one_table(spark, segmenter):
    docs = spark.createDataFrame([
        (1, "東京都に住む。Apache スパーク3系 is fast!", "ja"), (2, "The cat sat.", "en"), (3, None, "ja"), (4, "", None),
        (5, "東京都に住む", "ja"), (6, "東京都に住む", "ja"), (7, "   \n", "en"), (8, "粲" * 3 + "cat", None)], DOCS).repartition(3)
    rows = tokenize_docs(docs, segmenter=segmenter).collect()
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.sent_id, r.word_id)):
        got[r.doc_id, r.sent_id].append(r.text)
    assert got == {(1, 0): ["東京", "都", "に", "住む"], (1, 1): ["Apache", "スパーク", "3系"[0], "系", "is", "fast"], (2, 0): ["The", "cat", "sat"],
                   (5, 0): ["東京", "都", "に", "住む"], (6, 0): ["東京", "都", "に", "住む"], (8, 0): ["粲"] * 3 + ["cat"]}
    assert all([r.word_id for r in rows if (r.doc_id, r.sent_id) == k] != [] for k in got)
    spaced = docs.where("doc_id in (2, 4, 7)")
    assert sorted(map(tuple, tokenize_docs(spaced, segmenter=segmenter).collect()), key=str) == sorted(map(tuple, tokenize_docs(spaced).collect()), key=str)


def test_runs_and_nothing(spark):
    docs = spark.createDataFrame([(1, "東京 東京 cat ねこだ!ねこだ", "ja"), (2, None, "ja"), (3, "cat", "en")], DOCS)
    assert {(r.run, r.n) for r in SG.runs(docs).collect()} == {("東京", 2), ("ねこだ", 2)}
    empty = SG.learn(SG.runs(docs.where("doc_id = 3")))
    assert empty.costs == {} and empty.split("東京") == ["東", "京"]
    assert tokenize_docs(docs.limit(0), segmenter=empty).collect() == []


def test_segmenting_shuffles_nothing(spark, segmenter):
    docs = spark.createDataFrame([(k, "東京都 cat", "ja") for k in range(50)], DOCS)
    plan = tokenize_docs(docs, segmenter=segmenter)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "ArrowEvalPython" in plan


def some_runs(rng, letters, many=400):
    return ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 5, 17, 60]))) for _ in range(many)] + [letters * 3000]


def test_many_runs_split_like_single_ones():
    rng = random.Random(11)
    for trial in range(12):
        letters = "あいう\U00020000x"
        costs = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 5))): rng.randint(1, 6) for _ in range(rng.choice([0, 1, 9, 200]))}
        seg = SG.Segmenter(costs, rng.choice([2, 9, 50_000_000, 1 << 45]), max(map(len, costs), default=1))
        runs = some_runs(rng, letters + "え")
        assert seg.split_all(runs, seg.pieces()) == [seg.split(run) for run in runs], trial


def test_expected_counts_of_many_runs_are_those_of_single_ones():
    rng = random.Random(12)
    for _ in range(8):
        letters = "かきく\U00020000"
        probability = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 4))): rng.random() for _ in range(rng.choice([1, 5, 60]))}
        names, runs = list(probability), some_runs(rng, letters + "け")
        pieces, values = SG.Pieces(names, 4), np.array(list(probability.values()))
        for own, lengths, going in SG._together(runs):
            got = defaultdict(dict)
            of, piece, x = SG._expected_together(pieces.found([runs[i] for i in own], lengths), values, 0.01, lengths, going)
            for r, k, v in zip(of, piece, x, strict=True):
                got[own[r]][names[k]] = v
            for i in own:
                want = SG.expected_counts(runs[i], probability, 4, 0.01)
                assert got[i] == {w: v for w, v in want.items() if w in probability}


def test_runs_of_a_batch_take_no_step_of_python_per_character(spark, monkeypatch):
    seg = SG.Segmenter({"あい": 1, "う": 2}, 9, 2)
    monkeypatch.setattr(SG.Segmenter, "split", lambda *_: pytest.fail("one run at a time"))
    assert seg.split_all(["あいう" + "あ" * k for k in range(40)], seg.pieces())[2] == ["あい", "う", "あ", "あ"]


def test_the_driver_gets_the_kept_pieces_only(spark):
    """Pieces are chosen where they are counted: no task sends its first ``max_pieces`` to the driver."""
    rng = random.Random(13)
    rows = [("".join(rng.choice("あいうえお") for _ in range(rng.randint(1, 4))), rng.choice([1, 2, 2, 2, 3, 9, 70])) for _ in range(900)]
    rows = list(dict(rows).items())
    df = spark.createDataFrame(rows, "piece string, n long").repartition(7)
    for limit in (0, 1, 5, 40, 150, len(rows) - 1, len(rows), 10_000):
        weight = F.col("n") * F.length("piece") + F.when(F.length("piece") == 1, SG.ALONE).otherwise(0)
        got = first_rows(df, limit, weight, ["piece"])
        assert "TakeOrdered" not in got._jdf.queryExecution().executedPlan().toString()
        want = sorted(rows, key=lambda r: (len(r[0]) > 1, -r[1] * len(r[0]), r[0]))[:limit]
        assert sorted(map(tuple, got.collect())) == sorted(want), limit


def test_learning_takes_no_sorted_limit(spark, monkeypatch):
    asked = []

    def limited(df, *args):
        asked.append(df)
        return first_rows(df, *args)

    monkeypatch.setattr(SG, "first_rows", limited)
    monkeypatch.setattr(type(spark.range(0)), "limit", lambda *_: pytest.fail("a sorted limit"))
    seg = SG.learn(spark.createDataFrame([("あいうえお" * 4, 5), ("かきくけこ", 1)], "run string, n long"), max_pieces=12)
    assert asked and len(seg.costs) <= 12 and set("あいうえおかきくけこ") <= set(seg.costs)
