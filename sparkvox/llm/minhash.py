"""MinHash near-deduplication by one-permutation hashing.

One pass hashes each word shingle once; the hash's top part names a bin, the
least hash of a bin is its value, and an empty bin takes the value of a bin
that its own hash sequence names (optimal densification). Four neighbouring
values make a band. Documents that share a band's value, and are close enough
in size to be similar at all, share a bucket. First each bucket links its
members to one centre only, so a bucket of m gives m - 1 candidates, and most
groups are one component after that. Then, in every bucket that still holds
several components, all pairs of members from different ones are looked at, so
that no pair is missed for the choice of centres. In large buckets only those
pairs come out of it that can be similar by the counts of their shingles per
slot, an upper bound of what they have in common. Candidates are confirmed on
full shingle sets. Equal sets are one class from the start, so copies cost
nothing.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkvox.llm import encode, hashing
from sparkvox.llm.common import filled, unused, words, written
from sparkvox.llm.components import components
from sparkvox.session import ship_package

SHINGLE = 5
#: 40 bands of 4 bins: a pair of similarity 0.75 misses all bands once in 4 million.
BANDS, ROWS = 40, 4
BINS = BANDS * ROWS
#: Sizes of two documents of similarity 0.75 differ by 4/3 at most. Size
#: classes are a little over (4/3)**2 wide and lie in two grids, half a class
#: apart, so such documents share a class in one grid at least.
CLASS_WIDTH = 1.8

_FACTORS = hashing.mix(np.arange(11, 11 + SHINGLE, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """``(row, sorted distinct shingle hashes)`` of each row in order."""
    for i, j in hashing.row_groups(offsets):
        h, rows = hashing.word_hashes(data, offsets[i:j + 1], lower=True)
        counts = np.bincount(rows, minlength=j - i)
        ends = np.cumsum(counts)
        whole = np.zeros(max(len(h) - SHINGLE + 1, 0), np.uint64)
        for k in range(SHINGLE):
            whole += h[k:len(h) - SHINGLE + 1 + k] * _FACTORS[k] if len(whole) else np.uint64(0)
        whole = hashing.mix(whole + np.uint64(SHINGLE))
        for r in range(j - i):
            n, e = int(counts[r]), int(ends[r])
            if n >= SHINGLE:
                found = np.unique(whole[e - n:e - SHINGLE + 1])
            elif n:  # fewer words: the whole sequence is one shingle
                found = hashing.mix((h[e - n:e] * _FACTORS[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
            else:
                found = np.zeros(0, np.uint64)
            yield i + r, found


def _probes(first: int, count: int) -> np.ndarray:
    """Bins that each bin tries when empty: attempts x bins."""
    tries = np.arange(first, first + count, dtype=np.uint64)[:, None] * np.uint64(0xA24BAED4963EE407)
    return (hashing.mix(tries + np.arange(1, BINS + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))
            % np.uint64(BINS)).astype(np.int64)


_EARLY, _LATE = _probes(0, 16), _probes(16, 1024)
_BAND_FACTORS = hashing.mix(np.arange(101, 101 + ROWS, dtype=np.uint64)) | np.uint64(1)
_BAND_SALT = hashing.mix(np.arange(201, 201 + BANDS, dtype=np.uint64))


def signature(found: np.ndarray) -> np.ndarray:
    """The densified bin values of a sorted set that is not empty."""
    bins = (((found >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
    out, full = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    out[bins[first]], full[bins[first]] = found[first], True
    empty, start = np.flatnonzero(~full), 0
    while len(empty):
        tries = _EARLY if not start else _LATE if start == len(_EARLY) else _probes(start, 1024)
        start += len(tries)
        hits = full[tries[:, empty]]
        done = hits.any(axis=0)
        at = hits.argmax(axis=0)[done]
        out[empty[done]] = out[tries[at, empty[done]]]
        empty = empty[~done]
    return out


def bands(values: np.ndarray) -> np.ndarray:
    """One hash per band of a signature."""
    return hashing.mix((values.reshape(BANDS, ROWS) * _BAND_FACTORS).sum(axis=1, dtype=np.uint64) + _BAND_SALT).view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encode.release()
    for batch in batches:
        data, offsets = hashing.text_bytes(batch.column(2))
        n, digests, values, ends = [], [], [], [0]
        for _, found in shingle_sets(data, offsets):
            n.append(len(found))
            digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
            if len(found):
                values.append(bands(signature(found)))
            ends.append(ends[-1] + BANDS * bool(len(found)))
        flat = np.concatenate(values) if values else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digests, pa.binary()),
             pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
            names=["id", "th", "n", "digest", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encode.release()
    for batch in batches:
        data, offsets = hashing.text_bytes(batch.column(1))
        rows, parts, ends = [], [], [0]

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts).view(np.int64)))],
                names=["node", "found"])

        for r, found in shingle_sets(data, offsets):
            rows.append(r)
            parts.append(found)
            ends.append(ends[-1] + len(found))
            if ends[-1] > 1 << 20:
                yield made()
                rows, parts, ends = [], [], [0]
        if rows:
            yield made()


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encode.release()
    for batch in batches:
        data, offsets = hashing.text_bytes(batch.column(1))
        out = []
        for _, found in shingle_sets(data, offsets):
            counts = np.bincount((found & np.uint64(PROFILE - 1)).astype(np.int64), minlength=PROFILE)
            out.append(counts.astype(np.uint8).tobytes() if counts.max() < 256 else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["node", "profile"])


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(rid, id, th, n, digest, bands)`` per row: the text's hash, the size and digest of its shingle set, the band values."""
    ship_package(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(filled(F.col(text_col)).cast("binary"))).alias("th"),
                    F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([d.schema["id"], T.StructField("th", T.BinaryType()), T.StructField("n", T.LongType()),
                           T.StructField("digest", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    return d.mapInArrow(_signed, schema).withColumn("rid", F.monotonically_increasing_id())


#: Bands that a pair must share to be worth comparing on full sets: 12.7 are expected at similarity 0.75.
LEAST_BANDS = 2
#: Values of the hash that texts are filtered by before they move.
SLOTS = 1 << 20
#: Members of a bucket in one block, and rows that a task takes at once.
MEET, PART_ROWS = 256, 20_000
#: Slots that the shingles of a text are counted by, a power of 2.
PROFILE = 256


def _cell(n: Column, grid: Column | int = 0) -> Column:
    """The size class of a document in a grid."""
    return F.floor(F.log(n.cast("double")) / math.log(CLASS_WIDTH) + grid / 2)


def bucket_members(reps: DataFrame) -> DataFrame:
    """``(key, band, node, cell)``: the buckets of each document, 2 per band; a
    key's last bit is the grid, the cell is that of the first grid. In:
    ``node, n, bands`` of one document per class."""
    keyed = reps.select("node", "n", F.posexplode("bands").alias("band", "value")).select(
        "node", "n", "band", "value", F.explode(F.array(F.lit(0), F.lit(1))).alias("grid"))
    key = F.xxhash64("band", "value", "grid", _cell(F.col("n"), F.col("grid")))
    return keyed.select(key.bitwiseAND(F.lit(-2)).bitwiseOR(F.col("grid")).alias("key"), "band", "node", _cell(F.col("n")).alias("cell"))


def shared_buckets(reps: DataFrame) -> DataFrame:
    """``(key, band, node, m)`` of the buckets with m > 1 members. Counted per task
    first and joined back, so that a hot bucket need not meet in one task. A
    bucket of the second grid whose members are all in one cell of the first is
    part of a bucket there, so it is left out."""
    members = bucket_members(reps)
    sizes = members.groupBy("key").agg(F.count("*").alias("m"), F.min("cell").alias("lo"), F.max("cell").alias("hi"))
    first = F.col("key").bitwiseAND(F.lit(1)) == 0
    sizes = written(sizes.where((F.col("m") > 1) & (first | (F.col("lo") < F.col("hi")))).select("key", "m"), "near_buckets")
    return written(members.drop("cell").join(sizes, "key"), "near_members")


def connectedness(members: DataFrame) -> DataFrame:
    """``(node, met)``: how many others a document meets in all its buckets together."""
    return written(members.groupBy("node").agg(F.sum(F.col("m") - 1).alias("met")), "near_met")


def star_pairs(members: DataFrame, met: DataFrame) -> DataFrame:
    """``(a, b)``: each member of a bucket with the bucket's centre, the member
    that meets most others. The text that a group was copied from is that, as
    its copies agree with it more than with each other; so one centre serves a
    group, few different pairs come out, and a copy of a copy finds its own
    original in the buckets that only the two have."""
    centres = (members.join(met, "node").groupBy("key")
               .agg(F.max(F.struct("met", F.xxhash64("node").alias("o"), "node")).alias("c")))
    centres = written(centres.select("key", F.col("c.node").alias("centre")), "near_centres")
    return _pairs(members.join(centres, "key").where("node <> centre"))


def _pairs(joined: DataFrame) -> DataFrame:
    return joined.select(F.greatest("node", "centre").alias("a"), F.least("node", "centre").alias("b")).distinct()


def _rooted(df: DataFrame, roots: DataFrame, c: str) -> DataFrame:
    named = roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    return df.join(named, c, "left").withColumn(f"r{c}", F.coalesce(f"r{c}", c))


def likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs close enough in size that share LEAST_BANDS bands at least."""
    left = pairs.join(reps.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bands").alias("ba")), "a")
    both = left.join(reps.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bands").alias("bb")), "b")
    near = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return both.where(near & (F.size(F.array_intersect("ba", "bb")) >= LEAST_BANDS)).select("a", "b")


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(a, b)`` of the pairs that are similar enough. Sets move once per
    pair, never all sets of a group to one place."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("found").alias("fa")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("found").alias("fb")), "b")
    counts = both.select("a", "b", F.size(F.array_intersect("fa", "fb")).alias("s"), (F.size("fa") + F.size("fb")).alias("t"))
    return counts.where(100 * F.col("s") >= percent * (F.col("t") - F.col("s"))).select("a", "b")


def _apart(percent: int):
    """``(a, b)`` from rows ``part, key, i, j, block, band, node, root, n, cell,
    bands, profile``: the pairs of block i with block j of a bucket that are in
    different components, near enough in size, share LEAST_BANDS bands at least
    and can be similar by their profiles, if both have one: the lesser counts
    of all slots add up to no less than what the two have in common. A pair
    comes out in the bucket of the first band that it shares, and in the second
    grid only if the first keeps it apart."""

    def run(table: pa.Table) -> pa.Table:
        encode.release()
        key, i, j, block, band, node, root, n, cell = (
            table.column(c).to_numpy() for c in ("key", "i", "j", "block", "band", "node", "root", "n", "cell"))
        profile = table.column("profile").combine_chunks()
        known = profile.is_valid().to_numpy(zero_copy_only=False)
        counts = np.frombuffer(b"".join(profile.drop_null().to_pylist()), np.uint8).reshape(-1, PROFILE)
        at = np.cumsum(known) - 1
        values = table.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        order = np.lexsort((node, block, j, i, key))
        k, x, y = key[order], i[order], j[order]
        cuts = np.r_[0, np.flatnonzero((k[1:] != k[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1, len(order)]
        found = [np.zeros((0, 2), np.int64)]

        def meet(left: np.ndarray, right: np.ndarray) -> None:
            for s in range(0, len(left), 64):  # 64 x MEET x BANDS comparisons at once
                some = left[s:s + 64]
                small, large = np.minimum(n[some][:, None], n[right]), np.maximum(n[some][:, None], n[right])
                a, b = np.nonzero((root[some][:, None] != root[right]) & (100 * small >= percent * large))
                for t in range(0, len(a), 1 << 15):
                    u, v = some[a[t:t + (1 << 15)]], right[b[t:t + (1 << 15)]]
                    same = values[u] == values[v]
                    good = (same.sum(axis=1) >= LEAST_BANDS) & (same.argmax(axis=1) == band[u])
                    good &= (key[u] & 1 == 0) | (cell[u] != cell[v])
                    u, v = u[good], v[good]
                    most, both = np.minimum(n[u], n[v]), known[u] & known[v]
                    most[both] = np.minimum(counts[at[u[both]]], counts[at[v[both]]]).sum(axis=1, dtype=np.int64)
                    good = (100 + percent) * most >= percent * (n[u] + n[v])
                    found.append(np.stack([np.maximum(node[u[good]], node[v[good]]), np.minimum(node[u[good]], node[v[good]])], 1))

        for c, d in zip(cuts[:-1], cuts[1:], strict=True):
            rows = order[c:d]
            roots, sizes = np.unique(root[rows], return_counts=True)
            if len(roots) == 1:
                continue
            # Members of the largest component need not meet each other.
            main = root[rows] == roots[sizes.argmax()]
            rest, main = rows[~main], rows[main]
            if i[rows[0]] == j[rows[0]]:
                meet(rest, main)
                for r in range(1, len(rest)):
                    meet(rest[r:r + 1], rest[:r])
            else:
                first = i[rows[0]]
                meet(rest[block[rest] == first], rows[block[rows] != first])
                meet(main[block[main] == first], rest[block[rest] != first])
        return pa.table({"a": np.concatenate(found)[:, 0], "b": np.concatenate(found)[:, 1]})

    return run


def pairs_apart(members: DataFrame, reps: DataFrame, roots: DataFrame, percent: int,
                profiled: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``(a, b)``: all likely pairs of a bucket's members in different
    components. In: ``key, band, node``. Buckets are cut into blocks of about
    MEET members, and each pair of blocks meets by itself, wherever it is dealt
    to: memory does not grow with a bucket, and a hot one is spread. The blocks
    of a large bucket's largest component do not meet each other. The members
    of buckets of more than one block get ``profiled(nodes)``, their profiles,
    so that a large group of texts that are alike, but not similar, does not
    give as many pairs as it has."""
    placed = written(_rooted(members, roots, "node").select("key", "band", "node", F.col("rnode").alias("root")), "near_placed")
    several = placed.groupBy("key").agg(F.count("*").alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    active = written(placed.join(written(several.select("key", "m"), "near_several"), "key"), "near_active")
    large = active.where(F.col("m") > MEET)
    main = large.groupBy("key", "root").agg(F.count("*").alias("most")).groupBy("key").agg(F.max(F.struct("most", "root")).alias("main"))
    active = active.join(written(main.select("key", "main.most", F.col("main.root").alias("main")), "near_main"), "key", "left")
    # Blocks of the others come first; those of the largest component meet these only.
    inner = F.coalesce(F.col("root") == F.col("main"), F.lit(False))
    first = F.ceil((F.col("m") - F.coalesce("most", F.lit(0))) / MEET).cast("int")
    more = F.ceil(F.coalesce("most", F.lit(0)) / MEET).cast("int")
    block = F.when(inner, first + F.pmod(F.xxhash64("node"), more)).otherwise(F.pmod(F.xxhash64("node"), first)).cast("int")
    dealt = active.select("key", "band", "node", "root", block.alias("block"),
                          F.explode(F.sequence(F.lit(0), F.when(inner, first).otherwise(first + more) - 1)).alias("other"))
    dealt = written(dealt.select("key", "band", "node", "root", "block", F.least("block", "other").alias("i"),
                                 F.greatest("block", "other").alias("j")), "near_dealt")
    parts = max(16, math.ceil(dealt.count() / PART_ROWS))
    full = dealt.join(reps.select("node", "n", _cell(F.col("n")).alias("cell"), "bands"), "node").withColumn(
        "part", F.pmod(F.xxhash64("key", "i", "j"), F.lit(parts)).cast("int"))
    hot = large.select("node").distinct()
    if profiled is None or hot.isEmpty():
        full = full.withColumn("profile", F.lit(None).cast("binary"))
    else:
        full = full.join(written(profiled(written(hot, "near_hot")), "near_profiles"), "node", "left")
    return full.groupBy("part").applyInArrow(_apart(percent), "a bigint, b bigint").distinct()


def links(docs: DataFrame, signed: DataFrame, reps: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """``(node, root)`` of the classes that links connect with others. Stars
    come first, then all pairs that are still apart: a fixed number of passes,
    however the groups are made."""
    members = shared_buckets(reps)

    def linked(pairs: DataFrame) -> DataFrame:
        nodes = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "near_nodes")
        sets = written(shingle_table(docs, signed, nodes, id_col, text_col), "near_sets")
        return written(compared(pairs, sets, percent), "near_linked")

    found = linked(written(likely(star_pairs(members, connectedness(members)), reps, percent), "near_pairs"))
    roots = written(components(found, "a", "b"), "near_roots")
    more = linked(written(pairs_apart(
        members.select("key", "band", "node"), reps, roots, percent,
        lambda hot: shingle_table(docs, signed, hot, id_col, text_col, _profiles, "node bigint, profile binary")), "near_apart"))
    if more.isEmpty():
        return roots
    # The roots so far are links as good as any: stars of what is connected.
    stars = roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    return written(components(more.unionByName(stars), "a", "b"), "near_roots")


def shingle_table(docs: DataFrame, signed: DataFrame, nodes: DataFrame, id_col: str, text_col: str,
                  made=_sets, schema: str = "node bigint, found array<bigint>") -> DataFrame:
    """``(node, found)``: the shingle sets of some nodes, from their texts; or
    what else ``made`` makes of them."""
    needed = written(signed.select(F.col("rid").alias("node"), F.col("id").alias("_id"), F.col("th").alias("_th"))
                     .join(nodes, "node"), "near_needed")

    def slot(c: str):
        return F.pmod(F.xxhash64(c), F.lit(SLOTS)).alias("_slot")

    # SLOTS rows at most, so it may be broadcast: most texts that are not needed stay where they are.
    slots = F.broadcast(needed.select(slot("_th")).distinct())
    texts = docs.select(F.col(id_col).alias("_i"), F.col(text_col).cast("string").alias("_t")).withColumn(
        "_h", F.unhex(F.md5(filled(F.col("_t")).cast("binary"))))
    texts = texts.withColumn("_slot", slot("_h")).join(slots, "_slot", "left_semi")
    texts = texts.join(needed, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_th")))
    # Repeated rows match one node together; one of them is enough.
    return texts.select("node", "_t").dropDuplicates(["node"]).mapInArrow(made, schema)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles``, ``component_id`` (the
    least id that links reach), ``kept`` (the id is that), ``stays`` (as kept,
    but true for one row only where ids repeat), ``text_md5``.

    Links join documents with 100 * common >= ``percent`` * all of their
    distinct 5-word shingles (words lower-cased in A-Z; fewer than five words
    are one shingle). Texts without words, null ones included, link with
    nothing. Null ids are the largest; other columns of ``docs`` play no part;
    an empty table gives no rows. ``percent`` must be 75 or more: size classes
    and bands are made for that."""
    signed = written(signatures(docs, id_col, text_col), "near_signed")
    classes = written(signed.where("n > 0").groupBy("digest").agg(F.min("rid").alias("node")), "near_classes")
    reps = written(signed.join(classes.select(F.col("node").alias("rid")), "rid", "left_semi")
                   .select(F.col("rid").alias("node"), "n", "bands"), "near_reps")
    roots = links(docs, signed, reps, id_col, text_col, percent)
    placed = signed.select("rid", "id", "th", "n", "digest").join(classes, "digest", "left").join(roots, "node", "left")
    placed = written(placed.select("rid", "id", "th", "n", F.coalesce("root", "node", "rid").alias("root")), "near_placed")
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "rid")
    least = placed.groupBy("root").agg(F.min(order).alias("least"))
    out = placed.join(least, "root")
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("least.id").alias("component_id"),
        F.col("id").eqNullSafe(F.col("least.id")).alias("kept"), (F.col("rid") == F.col("least.rid")).alias("stays"),
        F.lower(F.hex("th")).alias("text_md5"))


def without_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component, with all their
    columns; texts without words all stay, repeated rows of them too."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, percent=percent)
    i, th, n, copies = unused(docs, "_id", "_th", "_n", "_copies")
    found = written(found.select(F.col(id_col).alias(i), F.unhex("text_md5").alias(th), F.col("n_shingles").alias(n), "stays"),
                    "near_found")
    stay = found.where(F.col("stays") & (F.col(n) > 0)).select(i, th)
    # Rows without words are no one's duplicates: their texts' hashes are not looked up.
    own = docs.withColumn(f"{th}k", F.unhex(F.md5(filled(F.col(text_col)).cast("binary"))))
    wordless = F.size(words(F.col(text_col))) == 0
    kept = own.where(~wordless).join(stay, own[id_col].eqNullSafe(stay[i]) & (own[f"{th}k"] == stay[th]))
    twice = found.where(F.col(n) > 0).groupBy(i, th).agg(F.count("*").alias(copies)).where(F.col(copies) > 1)
    if not twice.isEmpty():  # equal rows match together; one of them stays
        kept = kept.dropDuplicates([i, th])
    return kept.select(*docs.columns).unionByName(docs.where(wordless))
