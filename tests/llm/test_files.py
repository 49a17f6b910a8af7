"""Token files, WARC archives, packing."""

import gzip
import io
import random
from collections import defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from brute import MESSY
from pyspark.sql import functions as F

from sparkvox.llm import dac, encode, hashing, langid, minhash, packing, warc
from sparkvox.llm.encode import WordEncoder
from sparkvox.llm.queries import tokenizer_path

PATH = tokenizer_path()


def test_encoder_equals_the_library(small_docs):
    texts = [t for _, t in small_docs] + [t for _, t, *_ in MESSY] + ["ΣΑΣ é ́ x y", "it's we'LL 12,5 <b>&amp;</b>"]
    data, offsets = hashing.text_bytes(pa.array(texts))
    got = [x.tolist() for x in WordEncoder(PATH).encode(data, offsets)]
    assert got == brute.token_ids(texts, PATH)


def test_words_with_every_kind_of_character():
    """Punctuation, commas inside words, marks, odd spaces and controls, many words at a time."""
    rng = random.Random(9)
    letters = "abcxyzABC0129.,!?;:'%&$#*|<>()-_/\\\"éüñçß東京かな한글ไทยاع\u0301\u200d\xa0\u3000\x00\x01\x7f\U0001f600"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) + " " + ",".join(rng.choice(letters) for _ in range(3)) for _ in range(3000)]
    texts += [" ".join(rng.sample(texts, 30)) for _ in range(100)]
    data, offsets = hashing.text_bytes(pa.array(texts))
    assert [x.tolist() for x in WordEncoder(PATH).encode(data, offsets)] == brute.token_ids(texts, PATH)


def test_special_tokens_in_a_text():
    texts = ["end of it <|endoftext|> next", "plain", "a<|startoftext|>b,<|endoftext|>", "<|EndOfText|> <|endoftext|", "",
             "  <|endoftext|>  <|endoftext|>é\n", "<|endoftext|>"]
    data, offsets = hashing.text_bytes(pa.array(texts))
    got = [x.tolist() for x in WordEncoder(PATH).encode(data, offsets)]
    assert got == brute.token_ids(texts, PATH)
    assert got[0] == [806, 539, 585, 49407, 1131]


def test_steps_that_encode_nothing_hold_no_words():
    """A worker that has encoded runs the tasks of another step without what it remembered."""
    texts = pa.array([" ".join(f"w{k}x{i}" for i in range(500)) for k in range(20)])
    ids = pa.array(range(20), pa.int64())
    model = langid.Model([], langid.codebook(0), np.zeros((langid.BUCKETS, langid.codebook(0).shape[1]), np.float32), np.ones(1))
    tasks = [lambda: minhash._signed(iter([pa.record_batch([ids, ids, texts], ["id", "th", "text"])])),
             lambda: minhash._sets(iter([pa.record_batch([ids, texts], ["node", "text"])])),
             lambda: minhash._profiles(iter([pa.record_batch([ids, texts], ["node", "text"])])),
             lambda: langid._counts(["en"])(iter([pa.record_batch([pa.array(["en"] * 20), texts], ["lang", "text"])])),
             lambda: langid._predicted(model, 1, ["id", "text", "a", "b", "c"])(iter([pa.record_batch([ids, texts], ["id", "text"])]))]
    want = [x.tolist() for x in WordEncoder(tokenizer_path()).encode(*hashing.text_bytes(texts))]
    for task in tasks:
        batch = pa.record_batch([texts], ["text"])
        assert [x.tolist() for x in encode.ids_of(batch, 0, tokenizer_path())] == want
        assert encode._encoders
        assert sum(b.num_rows for b in task())
        assert not encode._encoders


@pytest.mark.parametrize("top", [1, 2, 255, 300, 49407, 2**20, 2**32 - 1])
def test_codes_give_any_token(top):
    rng = np.random.default_rng(top)
    docs = [np.minimum(rng.exponential(top / 8, n), top).astype(np.uint32) for n in (0, 1, 700, 513, 3000, 0)]
    shard = dac.Shard(dac.encode_shard(docs, [4, None, 6, 7, 8, 9]))
    flat = np.concatenate(docs)
    assert shard.ids == [4, None, 6, 7, 8, 9] and shard.n_tokens == len(flat)
    assert all((shard.document(k) == d).all() for k, d in enumerate(docs))
    assert all(shard[i] == flat[i] for i in rng.integers(0, len(flat), 300))


@pytest.mark.parametrize("width", range(1, 33))
def test_bits_of_any_width(width):
    rng = np.random.default_rng(width)
    for n in (0, 1, 7, 8, 9, 1000):
        values = rng.integers(0, 1 << width, n, dtype=np.uint64).astype(np.uint32)
        packed = dac._packed(values, width)
        assert len(packed) == (n * width + 7) // 8
        chunks = np.frombuffer(packed, np.uint8)
        for first, stop in ((0, n), (n // 3, n), (n // 2, n // 2), (min(n, 5), max(n - 3, min(n, 5)))):
            assert (dac._unpacked(chunks, width, first, stop - first) == values[first:stop]).all()


def test_documents_in_runs(monkeypatch):
    monkeypatch.setattr(dac, "READ_TOKENS", 100)
    rng = np.random.default_rng(3)
    docs = [rng.geometric(0.001, n).astype(np.uint32) for n in (0, 30, 0, 500, 99, 1, 1, 0, 250, 0)]
    shard = dac.Shard(dac.encode_shard(docs, list(range(10))))
    found = list(shard.documents())
    assert len(found) == 10 and all((a == b).all() and a.dtype == np.dtype("<u4") for a, b in zip(found, docs, strict=True))
    assert list(dac.Shard(dac.encode_shard([], [])).documents()) == []


def test_codes_are_small():
    ids = np.random.default_rng(1).geometric(0.01, 50_000).astype(np.uint32)
    assert len(dac.encode_shard([ids], [1])) < 50_000 * 1.5
    with pytest.raises(ValueError):
        dac.Shard(b"something else")


def test_token_files(spark, small, small_docs):
    folder, shards = dac.write_tokens(small, PATH, shard_tokens=5000)
    assert shards.count() > 5
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in dac.read_tokens(folder, shards).collect()}
    start = 0
    for (i, _), ids in sorted(zip(small_docs, brute.token_ids([t for _, t in small_docs], PATH), strict=True)):
        assert got[i] == (start, len(ids) + 1, brute.crc([*ids, 2]))
        start += len(ids) + 1


def test_token_files_messy(spark, messy, none):
    folder, shards = dac.write_tokens(messy.withColumn("id", F.lit("own")), PATH)
    rows = sorted(dac.read_tokens(folder, shards).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [1, 2, 3, 4, 5, 6, 6, 7, 8, 9, 10, None]
    assert rows[2].n_tokens == rows[3].n_tokens == rows[4].n_tokens == 1
    assert dac.read_tokens(*dac.write_tokens(none, PATH)).count() == 0


def plan_of(lengths):
    """Slots of pieces of these lengths: sequence -> (offset, length)."""
    histogram = defaultdict(int)
    for n in lengths:
        histogram[n] += 1
    used = defaultdict(list)
    for length, rank, number, sequence, offset in packing.plan_slots(dict(histogram), 100):
        for k in range(number):
            used[sequence + k].append((offset, length))
    return used


def test_plan_is_best_fit():
    rng = random.Random(8)
    for _ in range(60):
        lengths = [rng.choice((100, rng.randrange(1, 101), rng.randrange(1, 20), 33)) for _ in range(rng.randrange(1, 400))]
        used = plan_of(lengths)
        assert sorted(n for s in used.values() for _, n in s) == sorted(lengths)
        for s in used.values():
            end = 0
            for offset, n in sorted(s):
                assert offset == end
                end += n
            assert end <= 100
        # Best fit one by one, longest first, needs as many.
        room = []
        for n in sorted(lengths, reverse=True):
            fits = [r for r in room if r >= n]
            if fits:
                room.remove(min(fits))
                room.append(min(fits) - n)
            else:
                room.append(100 - n)
        assert len(used) == len(room)


def test_plan_size_depends_on_lengths_only():
    small, large = ({n: c for n in range(1, 101)} for c in (1000, 10**9))
    assert len(packing.plan_slots(large, 100)) < 2 * len(packing.plan_slots(small, 100)) + 100


def check_packing(rows, docs, capacity):
    ids = brute.token_ids([t for _, t in docs], PATH)
    want = sorted((str(i), k // capacity, k, len(part), brute.crc(part)) for (i, _), x in zip(docs, ids, strict=True)
                  for k in range(0, len(x) + 1, capacity) for part in [[*x, 1][k:k + capacity]])
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    used = defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
    for s in used.values():
        end = 0
        for offset, n in sorted(s):
            assert offset == end
            end += n
        assert end <= capacity
    return len(used), sum(len(x) + 1 for x in ids)


def test_packing(spark, small, small_docs, monkeypatch):
    monkeypatch.setattr(packing, "PER_SALT", 17)
    sequences, tokens = check_packing(packing.pack_documents(small, PATH, capacity=512).collect(), small_docs, 512)
    assert sequences <= tokens / 512 * 1.02 + 1


def test_packing_messy(spark, messy, none):
    rows = packing.pack_documents(messy.withColumn("rank", F.lit("own")).withColumn("length", F.lit("own")), PATH).collect()
    check_packing(rows, [(i, t) for i, t, *_ in MESSY], 4096)
    assert packing.pack_documents(none, PATH).count() == 0


PAGES = [(1, "http://a", "x" * 1500), (2, "http://b\r\nWARC-Type: evil", "x" * 1500), (3, None, "x" * 1500), (4, "u", "short"),
         (5, "u", "short"), (6, "u", None), (None, "u", "x" * 1500), (7, "u", "é" * 499), (8, "u", "é" * 500), (9, "u", "é" * 500),
         (9, "u", "é" * 500), (10, "u", "\r\n\r\nWARC/1.1\r\n" * 90_000)]


def test_archives(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("size", F.lit("own"))
    folder, archives = warc.write_archives(pages, archive_bytes=4000)
    rows = warc.read_archives(*warc.normalise_archives(folder, archives)).collect()
    assert len(rows) == len(PAGES)
    of = {r.page_id: r for r in rows}
    assert [(k, of[k].record_type, of[k].refers_to) for k in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, None)] == [
        (1, "revisit", 3), (2, "revisit", 3), (3, "response", None), (4, "response", None), (5, "response", None),
        (6, "response", None), (7, "response", None), (8, "revisit", 9), (9, "response", None), (10, "response", None),
        (None, "revisit", 3)]
    assert of[7].payload_bytes == 998 and of[6].payload_digest == "da39a3ee5e6b4b0d3255bfef95601890afd80709"
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    folder, archives = warc.write_archives(empty)
    assert warc.read_archives(*warc.normalise_archives(folder, archives)).count() == 0


def test_normaliser_reads_any_gzip():
    records = [warc.record(i, f"u{i}", b"p" * (i * 7000), None, False) for i in range(9)]
    whole, members = gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records))
    outs = []
    for archive in (whole, members):
        out = io.BytesIO()
        index = warc.normalise(io.BytesIO(archive).read, out.write)
        data = out.getvalue()
        assert [gzip.decompress(data[e["offset"]:e["offset"] + e["length"]]) for e in index] == records
        outs.append([e["id"] for e in index])
    assert outs[0] == outs[1] == [warc.record_name(i) for i in range(9)]
    with pytest.raises(ValueError):
        warc.normalise(io.BytesIO(gzip.compress(b"".join(records)[:-5])).read, io.BytesIO().write)
