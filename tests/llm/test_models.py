"""Language model, language identification, near duplicates."""

import math
import random

import brute
import numpy as np
import pytest
from brute import MESSY
from pyspark.sql import functions as F

from sparkvox.llm import common, components, hashing, langid, minhash, pitman_yor


def test_words_are_hashed_alike():
    import pyarrow as pa

    rng = random.Random(1)
    texts = ["".join(rng.choice("ab C\t\n\x0b\x0c\r é東") for _ in range(rng.randrange(60))) for _ in range(300)] + [None, "", " "]
    for segment in (7, 64, 1 << 20):
        hashing.SEGMENT, old = segment, hashing.SEGMENT
        try:
            data, offsets = hashing.text_bytes(pa.array(texts)[1:])
            h, row = hashing.word_hashes(data, offsets, lower=True)
        finally:
            hashing.SEGMENT = old
        want = [(w, k) for k, t in enumerate(texts[1:]) for w in brute.words(t, True)]
        assert row.tolist() == [k for _, k in want]
        of = dict(zip((w for w, _ in want), h.tolist(), strict=True))
        assert [of[w] for w, _ in want] == h.tolist() and len(set(of.values())) == len(of)


def test_unigram_part_is_exact(spark, small, small_docs):
    want = brute.unigram_scores(small_docs)
    rows = pitman_yor.score_documents(small, pitman_yor.held_out()).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert math.isclose(r.base_score, want[r.doc_id][4], rel_tol=1e-9)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_are_the_same_again(spark, small):
    a, b = ({r.doc_id: r.score for r in pitman_yor.score_documents(small, pitman_yor.held_out()).collect()} for _ in range(2))
    assert a == b


def test_predictions_sum_to_one():
    """Sampling on one group without Spark: totals fit the seatings, so the
    probabilities of all words and the unknown one sum to one in any context."""
    import pandas as pd
    import pyarrow as pa

    py = pitman_yor
    rng = random.Random(4)
    texts = [" ".join(rng.choice("aaabbbcdefgh") for _ in range(rng.randrange(30))) for _ in range(200)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(200)), pa.array(range(200)), pa.array([i % 7 == 2 for i in range(200)]), pa.array(texts)],
        names=["rid", "id", "held", "text"])
    for frequent in (np.zeros(0, np.uint64), np.sort(np.unique(py.tokens_of(*hashing.text_bytes(pa.array(["a b"])))[0]))):
        groups = 3
        dealt = pa.Table.from_batches(py._dealt(frequent, groups)(iter([batch])))
        rows = [py._grouped(dealt.filter(pa.compute.equal(dealt["g"], g))) for g in range(groups) if g in dealt["g"].to_pylist()]
        seats = [t.select(["g", "dishes"]).combine_chunks().to_batches()[0] for t in rows]

        def summed(run, seats=seats):
            found = pd.concat([b.to_pandas() for b in run(iter(seats))])
            return found.groupby(["kind", "s", "k"], as_index=False).sum()

        model = py._model(summed(py._counted(frequent)), frequent, 5)
        held = [i % 7 == 2 for i in range(200)]
        assert model.tokens == sum(len(t.split()) + 1 for t, h in zip(texts, held, strict=True) if not h)
        assert model.vocabulary == len({w for t, h in zip(texts, held, strict=True) if not h for w in t.split()}) + 1
        draws = np.random.default_rng(1)
        model.totals.append(py._totals(model, summed(py._seated(model, False)), 0, draws))
        second = summed(py._seated(model, True))
        model.totals += [py._totals(model, second, s, draws) for s in range(py.SAMPLES)]
        for s, t in enumerate(model.totals[2:]):
            tables, words = np.zeros(py.CONTEXTS), {}
            for b in seats:
                d = py.Dishes(b["dishes"][0].as_py(), frequent)
                sample = list(py.chain(d, model, b["g"][0].as_py(), py._stirlings(model), second=True, samples=py.SAMPLES))[s]
                tables += np.bincount(d.ctx, weights=sample[0], minlength=py.CONTEXTS)
                customers, parent = sample[1].astype(float), sample[2].astype(float)
                customers[d.often], parent[d.often] = t.often_customers[d.place], t.often_tables[d.place]
                words |= dict(zip(d.words.tolist(), model.base(customers, parent, t).tolist(), strict=True))
            assert (tables == t.tables).all()
            known = {h for h in words if words[h] > float(model.base(np.zeros(1), np.zeros(1), t)[0])}
            unknown = float(model.base(np.zeros(1), np.zeros(1), t)[0])
            assert len(known) == model.vocabulary
            assert math.isclose(sum(words[h] for h in known) + unknown, 1.0, rel_tol=1e-9)


def test_tables_follow_the_exact_distribution():
    """Draws for one dish against enumeration of its seatings by their weights."""
    d, n, mass, p = 0.6, 6, 1.7, 0.3
    s = pitman_yor.log_stirling(8, d)
    # S(n, 1) = (1 - d)(2 - d)...(n - 1 - d); S(n, n) = 1
    assert math.isclose(s[4, 1], math.log((1 - d) * (2 - d) * (3 - d))) and math.isclose(s[5, 5], 0.0, abs_tol=1e-12)
    weights = [math.exp(s[n, t]) * math.prod(mass + d * i for i in range(t)) * p**t for t in range(1, n + 1)]
    want = np.array(weights) / sum(weights)
    rng, k = np.random.default_rng(5), 200_000
    got = np.bincount(pitman_yor.draw_tables(rng, np.full(k, n), np.full(k, mass), np.full(k, p), d, s), minlength=n + 1)[1:] / k
    assert np.abs(got - want).max() < 0.005


def test_large_dishes():
    """Beyond the exact draws, seating in order makes more tables, but not twice as many."""
    rng, k, d, m = np.random.default_rng(6), 1500, 0.5, pitman_yor.EXACT_UP_TO
    s = pitman_yor.log_stirling(m, d)
    for mass, p in ((50.0, 0.05), (3.0, 0.01), (2000.0, 0.02)):
        small, large = (pitman_yor.draw_tables(rng, np.full(k, n), np.full(k, mass), np.full(k, p), d, s) for n in (m, m + 1))
        assert 0.9 * small.mean() < large.mean() < 1.8 * small.mean()
    huge = pitman_yor.draw_tables(rng, np.full(3, 10**9), np.full(3, 50.0), np.full(3, 0.05), d, s)
    assert (huge >= 1).all() and (huge < 10**7).all()


def test_score_messy(spark, messy, none):
    rows = pitman_yor.score_documents(messy.withColumn("rid", F.lit("own")).withColumn("score", F.lit(1)), pitman_yor.held_out()).collect()
    assert len(rows) == len(MESSY) and all(r.score < 0 for r in rows)
    assert sorted(r.n_tokens for r in rows) == sorted(len(brute.words(t)) + 1 for _, t, *_ in MESSY)
    assert pitman_yor.score_documents(none, pitman_yor.held_out()).count() == 0
    untaught = pitman_yor.score_documents(messy, F.lit(True)).collect()
    assert {r.train_tokens for r in untaught} == {0} and all(r.n_known == 0 for r in untaught)


def test_codebook():
    assert langid.codebook(0).shape == (0, 1) and langid.codebook(1).shape == (1, 1)
    for n in (2, 4, 6, 9, 40):
        m = langid.codebook(n).astype(int)
        distance = (m.shape[1] - m @ m.T) // 2
        assert (abs(m.sum(axis=0)) < n).all() and distance[~np.eye(n, dtype=bool)].min() >= (2 ** (n - 2) if n <= 6 else 4)


def test_wrong_bits_are_corrected():
    code = langid.codebook(5)
    model = langid.Model(list("abcde"), code, np.zeros((1, code.shape[1])), np.ones(code.shape[1]))
    for k in range(5):
        for flip in ([0], [1, 5], [2, 3, 9]):
            margins = code[k].astype(float)
            margins[flip] *= -1
            best, score, unsure = model.decode(margins[None])
            assert best[0] == k and 0 < score[0] <= 1 and not unsure[0]
    assert model.decode(np.zeros((1, code.shape[1])))[2][0]  # as near to all codewords: ambiguous


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs, ~langid.held_out())
    got = langid.identify(docs, model).where(langid.held_out())
    right, n = got.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right >= 0.98 * n


def test_language_query_against_plain_version(spark):
    """The registered query, and its predictions by a plain computation on one text at a time."""
    import math
    import zlib
    from collections import Counter

    from sparkvox.llm.queries import QUERIES

    got = QUERIES["op4_output_codes"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score", "ambiguous"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    held = {d.doc_id: zlib.crc32(str(d.doc_id).encode()) % 4 == 2 for d in docs}

    def grams(text):
        letters = [chr(b) if b >= 0x80 or chr(b).isalpha() else " " for b in (text or "").lower().encode()]
        runs = " " + " ".join("".join(letters).split(" ")) + " "
        while "  " in runs:
            runs = runs.replace("  ", " ")
        data = np.frombuffer(runs.encode("latin-1"), np.uint8).astype(np.uint32)
        h = data[:-2] * np.uint32(langid._FACTORS[0]) + data[1:-1] * np.uint32(langid._FACTORS[1]) + data[2:] * np.uint32(langid._FACTORS[2])
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        return (h >> np.uint32(18)).tolist()

    counts = {}
    for d in docs:
        if not held[d.doc_id] and d.lang is not None and d.text is not None:
            counts.setdefault(d.lang, Counter()).update(grams(d.text))
    languages = sorted(counts)
    share = [[(counts[x][g] + 0.5) / (counts[x].total() + 0.5 * langid.BUCKETS) for g in range(langid.BUCKETS)] for x in languages]
    code = langid.codebook(len(languages)).tolist()
    bits = range(len(code[0]))

    def mean(g, b, side):
        own = [s[g] for s, c in zip(share, code, strict=True) if c[b] == side]
        return sum(own) / len(own)

    weight = [[float(np.float32(math.log(mean(g, b, 1)) - math.log(mean(g, b, -1)))) for b in bits] for g in range(langid.BUCKETS)]

    def margins(text):
        own = grams(text)
        return [sum(weight[g][b] for g in own) / len(own) for b in bits]

    wrong, seen = {}, Counter()
    for d in docs:
        if not held[d.doc_id] and d.lang is not None and d.text is not None:
            k = languages.index(d.lang)
            seen[k] += 1
            for b, m in zip(bits, margins(d.text) if grams(d.text) else [0.0] * len(code[0]), strict=True):
                wrong[k, b] = wrong.get((k, b), 0) + (m * code[k][b] <= 0)
    trust = []
    for b in bits:
        rate = sum((wrong[k, b] + 0.5) / (seen[k] + 1) for k in range(len(languages))) / len(languages)
        trust.append(max(0.5 * math.log((1 - rate) / rate), 0.05))
    for d, r in zip(sorted(docs, key=lambda d: d.doc_id), sorted(got.collect(), key=lambda r: r.doc_id), strict=True):
        m = margins(d.text)
        loss = [sum(math.log1p(math.exp(-m[b] * c[b] * langid.STEEPNESS)) * trust[b] for b in bits) * langid.BELIEF * len(c) / sum(trust) for c in code]
        belief = [math.exp(min(loss) - x) for x in loss]
        top = sorted((x / sum(belief) for x in belief), reverse=True)
        assert r.held_out == held[d.doc_id] and r.lang_pred == languages[loss.index(min(loss))]
        assert math.isclose(r.score, top[0], rel_tol=1e-4) and r.ambiguous == (top[0] < langid.AMBIGUOUS_BELOW * (top[0] + top[1]))


def test_every_query_keeps_its_contracts_columns(spark):
    from sparkvox.llm.queries import QUERIES

    first = {
        "op2_pitman_yor": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        "op6_one_permutation": ["doc_id", "n_shingles", "component_id", "kept"],
        "op7_decision_list": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
        "op8_token_codes": ["doc_id", "start", "n_tokens", "ids_crc32"],
        "op10_best_fit": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    }
    for name, columns in first.items():
        got = QUERIES[name](spark, "/root/testdata/sf0.001")
        assert got.columns[:len(columns)] == columns and got.count() >= 200


def test_languages_messy(spark, messy, none):
    docs = messy.withColumn("score", F.lit("own")).withColumn("LANG_PRED", F.lit("own"))
    model = langid.train(docs, F.lit(True))
    assert model.languages == ["de", "en", "fr", "it"]
    got = langid.identify(docs, model)
    assert got.columns[-3:] == ["lang_pred_", "score_", "ambiguous"]
    for r in got.collect():
        letters = any(c.isalpha() for c in r.text or "")
        assert r.score == "own" and (r.lang_pred_ in model.languages if letters else (r.lang_pred_, r.score_) == ("und", 0.0))
    empty = langid.train(none, F.lit(True))
    assert {r.lang_pred for r in langid.identify(messy, empty).collect()} == {"und"}
    assert langid.identify(none, model).count() == 0


def test_near_duplicates_equal_brute_force(spark, small, small_docs):
    want = brute.near_components(small_docs)
    rows = minhash.near_duplicates(small).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_near_duplicates_of_made_groups(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    docs = []
    passage = [word() for _ in range(120)]
    for g in range(12):
        base = passage[:60 * (g % 3)] + [word() for _ in range(rng.choice((3, 5, 6, 8, 20, 150, 400)))]
        for _ in range(rng.choice((2, 5, 40))):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 40))):
                copy[rng.randrange(len(copy))] = word()
            docs.append(" ".join(copy))
    docs += [" ".join(passage + [word() for _ in range(n)]) for n in range(0, 120, 4)]
    rng.shuffle(docs)
    docs = list(enumerate(docs))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in
           minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute.near_components(docs)


def _edited(rng, words, places):
    out = list(words)
    for p in places:
        out[p] = "".join(rng.choice("abcdefgh") for _ in range(7))
    return out


def test_edits_of_edits_in_a_large_group(spark):
    """x is near b, b near o, x not near o, and thousands of others are near o."""
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(200)]
    slots = range(8, 196, 8)  # far enough apart that each edit changes five shingles
    docs = [base] + [_edited(rng, base, rng.sample(slots, 4)) for _ in range(2000)]
    pairs = []
    for _ in range(40):
        places = rng.sample(slots, 6)
        b = _edited(rng, base, places[:1])  # J(b, o) = 0.95
        pairs.append((len(docs), len(docs) + 1))
        docs += [b, _edited(rng, b, places[1:])]  # J(x, b) = 0.77, J(x, o) = 0.73
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [p for p in pairs if got[p[0]] != 0 or got[p[1]] != 0] == []


def test_all_components_of_a_bucket_meet(spark):
    """One bucket of more members than a block, in many components: every likely pair comes out, and comes out once."""
    rng = np.random.default_rng(7)
    count, shape = 2 * minhash.MEET + 90, (2 * minhash.MEET + 90, minhash.BANDS)
    values = rng.integers(0, 80, shape)
    values[:, 3] = 5
    roots = np.where(np.arange(count) < 200, 0, np.arange(count) // 3 * 3)
    sizes = rng.choice([100, 120, 150], count)
    reps = spark.createDataFrame([(i, int(sizes[i]), values[i].tolist()) for i in range(count)],
                                 "node long, n long, bands array<long>")
    rooted = spark.createDataFrame([(i, int(r)) for i, r in enumerate(roots)], "node long, root long")
    members = minhash.shared_buckets(reps).select("key", "band", "node")
    got = [(r.a, r.b) for r in minhash.pairs_apart(members, reps, rooted, 75).collect()]
    want = {(a, b) for a in range(count) for b in range(a)
            if roots[a] != roots[b] and 4 * min(sizes[a], sizes[b]) >= 3 * max(sizes[a], sizes[b])
            and (values[a] == values[b]).sum() >= minhash.LEAST_BANDS}
    assert len(got) == len(set(got)) and set(got) == want


def test_a_large_group_without_links_gives_few_pairs(spark, monkeypatch):
    """Hundreds of texts that are alike but not similar enough, and some pairs of them that are."""
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(200)]
    slots = range(8, 196, 8)
    docs = [_edited(rng, base, rng.sample(slots, 5)) for _ in range(600)]  # J of two is 0.6 mostly
    docs += [_edited(rng, docs[k], rng.sample(slots, 1)) for k in range(20)]
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    counts, write = {}, minhash.written

    def counted(df, name):
        out = write(df, name)
        counts.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(minhash, "MEET", 64)
    monkeypatch.setattr(minhash, "written", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.near_components(rows)
    assert counts["near_apart"][0] < 20 * len(rows)


def test_pairs_are_compared_twice_only(spark, monkeypatch):
    """Once for the stars, once for what they leave apart, whether or not a further look would find links."""
    rng = random.Random(13)
    base = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(200)]
    slots = range(8, 196, 8)
    docs, doc = [], base
    for _ in range(120):  # each near the one before, few near the first
        doc = _edited(rng, doc, rng.sample(slots, 3))
        docs.append(doc)
    docs += [_edited(rng, base, rng.sample(slots, 6)) for _ in range(200)]
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    calls, compare = [], minhash.compared

    def counted(pairs, *rest):
        calls.append(pairs.count())
        return compare(pairs, *rest)

    monkeypatch.setattr(minhash, "compared", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.near_components(rows)
    assert len(calls) == 2


def test_written_leaves_no_shuffled_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before = disk.getAllFiles().size()
    out = common.written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "cleaned")
    assert disk.getAllFiles().size() <= before and out.count() == 7


def test_near_messy(spark, messy, none):
    docs = messy.withColumn("kept", F.lit("own")).withColumn("_th", F.lit("own")).withColumn("node", F.lit(1))
    rows = minhash.near_duplicates(docs).collect()
    assert len(rows) == len(MESSY)
    of = {r.doc_id: r for r in rows}
    # 1, 2 and null hold the same words, 10 one more: 3 of 4 shingles are common.
    assert {of[k].component_id for k in (1, 2, None, 10)} == {1}
    assert [of[k].component_id for k in (3, 4, 5)] == [3, 4, 5] and of[3].n_shingles == 0
    left = minhash.without_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [1, 3, 4, 5, 6, 7, 8, 9]
    assert minhash.near_duplicates(none).count() == minhash.without_near_duplicates(none).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(4)
    for size in (4, 40, 400, 4000):
        hits = []
        for _ in range(60):
            pool = np.sort(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
            a, b = pool[:size * 7 // 8], pool[size // 8:]
            a, b = np.sort(rng.permutation(pool)[:size - size // 8]), pool
            hits.append((minhash.signature(a) == minhash.signature(b)).mean())
        assert abs(np.mean(hits) - (size - size // 8) / size) < 0.04


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_components(spark, shape):
    rng = random.Random(2)
    edges = {"path": [(i, i + 1) for i in range(60)], "star": [(7, i) for i in range(60)],
             "random": [(rng.randrange(200), rng.randrange(200)) for _ in range(120)]}[shape]
    edges = [(a * 977 % 1009, b * 977 % 1009) for a, b in edges]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r.node: r.root for r in got} == {x: root(x) for x in parent} and len(got) == len(parent)
