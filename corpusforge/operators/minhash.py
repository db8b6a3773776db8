"""MinHash signatures, banded LSH candidates, verified pairs, and greedy first-wins dedup."""

from __future__ import annotations

import random
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusforge.session import materialize, slices

try:
    from _md5 import md5  # the same function without OpenSSL's cost for each call
except ImportError:
    from hashlib import md5

PRIME, EMPTY = (1 << 31) - 1, 0xFFFFFFFF
NUM_PERM, BANDS, NGRAM, THRESHOLD = 128, 32, 5, 0.80
TOKEN = r"[\p{L}\p{N}_]+"
#: Hashes that go through one permutation at once: what fits a core's cache.
BLOCK = 16_384
#: Members of a bucket that meet in one group, cells that are compared at once, near pairs that one task takes, and those for each member of a bucket.
BUCKET_ROWS, CELLS, FEW_EDGES, EDGES_EACH = 4096, 1 << 20, 1_000_000, 64


def coefficients(num_perm: int = NUM_PERM, seed: int = 1) -> list[tuple[int, int]]:
    """(a, b) of each permutation h -> (a * h + b) mod 2^31 - 1; products stay below 2^62."""
    rng = random.Random(seed)
    a = [rng.randrange(1, PRIME) for _ in range(num_perm)]
    return list(zip(a, [rng.randrange(PRIME) for _ in range(num_perm)]))


def shingles(c: Column, n: int = NGRAM) -> Column:
    """Distinct word n-grams, lower-cased; one shingle of all words where there are fewer; none without words."""
    return F.element_at(F.transform(F.array(F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))), lambda w: _grams(w, n)), 1)


def _grams(w: Column, n: int) -> Column:
    of = lambda i: F.array_join(F.slice(w, i, F.lit(n)), " ")
    return (
        F.when(F.size(w) == 0, F.array().cast("array<string>"))
        .when(F.size(w) < n, F.array(F.array_join(w, " ")))
        .otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), of)))
    )


def shingle_hash(s: Column) -> Column:
    """31-bit hash of a shingle: the same number in every engine that has md5."""
    return F.conv(F.substring(F.md5(s.cast("binary")), 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(PRIME))


def joined_words(c: Column) -> Column:
    """The words of ``shingles``, lower-cased, with one space between."""
    return F.btrim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " "))


def shingle_hashes(words: bytes, n: int = NGRAM) -> np.ndarray:
    """Hashes of the distinct shingles of ``joined_words``: what ``shingle_hash`` gives for ``shingles``."""
    if not words:
        return np.zeros(0, np.uint64)
    gaps = np.flatnonzero(np.frombuffer(words, np.uint8) == 32).tolist()
    starts, ends = [0, *(k + 1 for k in gaps)], [*gaps, len(words)]
    grams = {words[x:y] for x, y in zip(starts, ends[n - 1 :])} if len(ends) >= n else {words}
    return np.frombuffer(b"".join([md5(g).digest() for g in grams]), ">u4")[::4].astype(np.uint64) & np.uint64(PRIME)


def signatures_of(hashes: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A row of minima for each array of hashes, a block of hashes at a time.

    2^31 is 1 modulo the prime, so the remainder is the sum of both halves of the
    product, less the prime if that leaves no negative number, which would wrap around.
    """
    out = np.full((len(hashes), len(a)), EMPTY, np.uint64)
    flat, row = np.concatenate(hashes), np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
    prime, half = np.uint64(PRIME), np.uint64(31)
    for k in range(0, len(flat), BLOCK):
        h, (own, first) = flat[k : k + BLOCK], np.unique(row[k : k + BLOCK], return_index=True)
        x, y, least = np.empty_like(h), np.empty_like(h), np.empty((len(a), len(own)), np.uint64)
        for j in range(len(a)):
            np.multiply(h, a[j], out=x)
            np.add(x, b[j], out=x)
            np.right_shift(x, half, out=y)
            np.bitwise_and(x, prime, out=x)
            np.add(x, y, out=x)
            np.subtract(x, prime, out=y)
            np.minimum(x, y, out=x)
            np.minimum.reduceat(x, first, out=least[j])
        out[own] = np.minimum(out[own], least.T)
    return out


def with_signatures(df: DataFrame, text: str = "text", num_perm: int = NUM_PERM, ngram: int = NGRAM, seed: int = 1, keep: Iterable[str] | None = None) -> DataFrame:
    """Adds ``signature`` (array of longs) to ``df``, or to its columns ``keep``; the others do not pass through Python.

    Words are found natively; shingles, their hashes and the minima are made in Python, some rows of a batch at a time.
    """
    a, b = (np.array(x, np.uint64) for x in zip(*coefficients(num_perm, seed)))
    own = df.columns if keep is None else list(keep)
    worded = df.select(*own, joined_words(F.coalesce(F.col(text), F.lit(""))).alias("__w"))
    at, schema = len(own), T.StructType([*df.select(*own).schema.fields, T.StructField("signature", T.ArrayType(T.LongType()))])

    def work(batches):
        for batch in slices(batches):
            words = batch.column(at).cast(pa.large_binary()).to_pylist()
            rows = signatures_of([shingle_hashes(w, ngram) for w in words], a, b) if words else np.zeros((0, len(a)))
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(a), pa.int32()), pa.array(rows.astype(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(at)], values], schema.names)

    return worded.mapInArrow(work, schema)


def similarity(x: Column, y: Column) -> Column:
    """Share of equal positions; null signatures of different lengths are an error."""
    same = F.size(F.filter(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), lambda e: e)).cast("double")
    checked = F.when(F.size(x) == F.size(y), same).otherwise(F.raise_error(F.lit("signatures of different lengths")).cast("double"))
    return F.when(F.size(x) == 0, F.lit(0.0)).otherwise(checked / F.size(x))


def lsh_rows(num_perm: int = NUM_PERM, bands: int = BANDS) -> int:
    if bands < 1 or num_perm % bands:
        raise ValueError(f"bands ({bands}) must divide num_perm ({num_perm})")
    return num_perm // bands


def approx_threshold(num_perm: int = NUM_PERM, bands: int = BANDS) -> float:
    """Similarity at which the banding's recall rises."""
    return (1 / bands) ** (1 / lsh_rows(num_perm, bands))


def band_keys(signed: DataFrame, key: str = "ord", num_perm: int = NUM_PERM, bands: int = BANDS) -> DataFrame:
    """(band, band_key, key): a row for each band of each signature."""
    r = lsh_rows(num_perm, bands)
    parts = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.slice("signature", i * r + 1, F.lit(r))))
    return signed.select(F.col(key), F.posexplode(parts).alias("band", "band_key"))


def candidates(signed: DataFrame, key: str = "ord", num_perm: int = NUM_PERM, bands: int = BANDS) -> DataFrame:
    """(src, dst): src < dst, distinct, of all that share a band."""
    k = band_keys(signed, key, num_perm, bands)
    a, b = k.withColumnRenamed(key, "src"), k.withColumnRenamed(key, "dst")
    return a.join(b, ["band", "band_key"]).filter("src < dst").select("src", "dst").distinct()


def agreement(threshold: float, num_perm: int = NUM_PERM) -> int:
    """The least number of equal positions that makes ``threshold``."""
    return next((n for n in range(num_perm + 1) if n / num_perm >= threshold), num_perm + 1)


def telling_bands(threshold: float, num_perm: int = NUM_PERM, bands: int = BANDS) -> int:
    """How many of the first bands find all that any band finds and ``threshold`` leaves.

    Positions that differ spoil a band each, so a pair at the threshold shares the
    other bands, and the first that it shares has as many behind it.
    """
    shared = bands - (num_perm - agreement(threshold, num_perm))
    return bands - max(shared, 1) + 1


def near_pairs(signed: DataFrame, threshold: float = THRESHOLD, key: str = "ord", num_perm: int = NUM_PERM, bands: int = BANDS) -> DataFrame:
    """(src, dst, sim): src < dst in input order, verified on the whole signatures.

    Equal signatures are one node, named by its first document, so a group of copies
    is not paired within itself; callers give copies their first's fate.
    """
    signed = signed.select(F.col(key).alias("ord"), "signature")
    x = _in_buckets(shared_buckets(signed, num_perm, bands, telling_bands(threshold, num_perm, bands)), signed, agreement(threshold, num_perm))
    return x.distinct().select(F.col("a").alias("src"), F.col("b").alias("dst"), (F.col("n") / num_perm).alias("sim"))


def shared_buckets(signed: DataFrame, num_perm: int = NUM_PERM, bands: int = BANDS, first: int | None = None) -> DataFrame:
    """(bucket, ord) of the buckets that hold two or more signatures, of the ``first`` bands or all."""
    keys = band_keys(signed, "ord", num_perm, bands).filter(F.col("band") < (first or bands))
    keys = materialize(keys.select(F.col("band_key").alias("bucket"), "ord"), "keys")
    many = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    return materialize(keys.join(many, "bucket", "left_semi"), "buckets")


def _groups(batches):
    """(fields of the key, columns of the rows) for each run of rows (bucket, p, q, part, ord, kept, signature) with one key."""
    held = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        own = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
        own.append(batch.column(6).flatten().to_numpy().reshape(n, -1).astype(np.uint32))
        own = own if held is None else [np.concatenate(x) for x in zip(held, own)]
        cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in own[:3]], axis=0)) + 1
        for x, y in zip([0, *cuts[:-1]], cuts):
            yield [c[x:y] for c in own]
        held = [c[cuts[-1] if len(cuts) else 0 :] for c in own]
    if held is not None:
        yield held


def _equal(x: np.ndarray, y: np.ndarray, need: int):
    """(at, n): for some rows of ``y`` after another, from row ``at``, the positions that each row of ``x`` shares with them; below ``need`` 0."""
    step = max(1, CELLS // max(1, x.size))
    low = x.astype(np.uint8)
    for at in range(0, len(y), step):
        part = y[at : at + step]
        n = (low[:, None] == part.astype(np.uint8)).sum(-1, dtype=np.uint16)
        i, j = np.nonzero(n >= need)
        exact = np.zeros_like(n)
        exact[i, j] = (x[i] == part[j]).sum(-1)
        exact[exact < need] = 0
        yield at, exact


def _edges(need: int, most: int | None):
    """The near pairs a < b of a group; a row of nulls instead of the rest if there are more than ``most`` for each member."""

    def of(ord_, sides, kept, sig):
        given = 0
        for left, right in sides:
            for at, n in _equal(sig[left], sig[right], need):
                a, b = ord_[left][:, None], ord_[right][at : at + n.shape[1]]
                i, j = np.nonzero((n > 0) & ((a < b) if left is right else (a != b)))
                given += len(i)
                if most is not None and given > most * len(ord_):
                    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64())] * 2 + [pa.array([None], pa.int32())], ["a", "b", "n"])
                    return
                x, y = a[i, 0], b[j]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(n[i, j].astype(np.int32))], ["a", "b", "n"])

    return of


def _matches(need: int):
    """For each b that goes: the kept a that are nearer than all kept ones of the group before them."""

    def of(ord_, sides, kept, sig):
        both = [(x, y) for left, right in sides for x, y in ([(left, right)] if left is right else [(left, right), (right, left)])]
        for left, right in both:
            stay, go = left[kept[left]], right[~kept[right]]
            if len(stay):
                for at, n in _equal(sig[stay], sig[go], need):
                    before = np.zeros_like(n)
                    np.maximum.accumulate(n[:-1], axis=0, out=before[1:])
                    i, j = np.nonzero(n > before)
                    yield pa.RecordBatch.from_arrays([pa.array(ord_[stay][i]), pa.array(ord_[go][at + j]), pa.array(n[i, j].astype(np.int32))], ["a", "b", "n"])

    return of


def _in_buckets(buckets: DataFrame, signed: DataFrame, need: int, most: int | None = None) -> DataFrame:
    """(a, b, n): documents of a bucket (bucket, ord) with ``need`` equal positions or more, and how many are equal.

    With a column ``kept``, only the pairs of ``_matches``. Signatures meet in numpy, a
    bucket at a time. The members of a bucket of more than ``BUCKET_ROWS`` are dealt to
    parts by hash, and every two parts are a group.
    """
    of = _matches(need) if "kept" in buckets.columns else _edges(need, most)
    flag = F.col("kept") if "kept" in buckets.columns else F.lit(True)
    large = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BUCKET_ROWS)
    x = buckets.join(large.select("bucket", F.ceil(F.col("n") / BUCKET_ROWS).cast("int").alias("k")), "bucket", "left").withColumn("k", F.coalesce("k", F.lit(1)))
    x = x.select("bucket", "ord", flag.alias("kept"), F.pmod(F.xxhash64("ord"), "k").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    x = x.select("bucket", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "ord", "kept")
    x = x.join(signed.select("ord", "signature"), "ord").select("bucket", "p", "q", "part", "ord", "kept", "signature")

    def work(batches):
        for _, p, q, part, ord_, kept, sig in _groups(batches):
            if p[0] == q[0]:
                every = np.arange(len(ord_))
                sides = [(every, every)]
            else:
                sides = [(np.flatnonzero(part == p[0]), np.flatnonzero(part == q[0]))]
            yield from of(ord_, sides, kept.astype(bool), sig)

    key = ["bucket", "p", "q"]
    return x.repartition(*key).sortWithinPartitions(*key, "ord").mapInArrow(work, "a long, b long, n int")


def _verified(pairs: DataFrame, signed: DataFrame, threshold: float) -> DataFrame:
    """``pairs`` (a, b) whose signatures agree at ``threshold``, with ``sim``."""
    s = lambda c: signed.select(F.col("ord").alias(c), F.col("signature").alias(f"s{c}"))
    x = pairs.distinct().join(s("a"), "a").join(s("b"), "b")
    return x.select("a", "b", similarity(F.col("sa"), F.col("sb")).alias("sim")).filter(F.col("sim") >= threshold)


def _settled(edges: DataFrame) -> DataFrame:
    """Who goes by ``edges`` (a, b), a < b, of which there are few: one task takes them in order."""

    def work(batches):
        gone = set()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if a not in gone:
                    gone.add(b)
        yield pa.RecordBatch.from_arrays([pa.array(sorted(gone), pa.int64())], ["ord"])

    return edges.select("a", "b").coalesce(1).sortWithinPartitions("b", "a").mapInArrow(work, "ord long")


def first_wins(signed: DataFrame, buckets: DataFrame, threshold: float = THRESHOLD, num_perm: int = NUM_PERM) -> DataFrame:
    """Ordinals that go when ``signed`` (ord, signature) is gone through in order, dropping whoever has an earlier kept neighbour.

    A round keeps each undecided document that is the first one left in all its
    buckets, and compares it with the others there. So a bucket makes a row for each
    member and kept document and never the pairs among its members, and a group of
    near copies is settled as soon as its first is. The first undecided document of
    all is kept in every round, which is written to the shared folder.

    Members of a bucket that are not near would take a round each. So once a round
    settles less than half of what was left, the near pairs of the rest are made, and
    if they are no more than ``FEW_EDGES`` they are gone through in order.
    """
    open_, gone, left, rounds, next_try = buckets, None, buckets.count(), 0, 1
    while left:
        x = open_.join(open_.groupBy("bucket").agg(F.min("ord").alias("lead")), "bucket")
        kept = materialize(x.groupBy("ord").agg(F.max(F.col("lead") < F.col("ord")).alias("blocked")).filter("NOT blocked").select("ord"), "kept")
        star = x.filter("lead < ord").join(kept.select(F.col("ord").alias("lead")), "lead", "left_semi")
        hit = _verified(star.select(F.col("lead").alias("a"), F.col("ord").alias("b")), signed, threshold)
        hit = materialize(hit.select(F.col("b").alias("ord")).distinct(), "dropped")
        gone = hit if gone is None else gone.unionByName(hit)
        open_ = materialize(open_.join(kept.unionByName(hit), "ord", "left_anti"), "undecided")
        before, left, rounds = left, open_.count(), rounds + 1
        if left and 2 * left > before and rounds >= next_try:
            edges = materialize(_in_buckets(open_, signed, agreement(threshold, num_perm), EDGES_EACH).distinct(), "edges")
            if edges.count() <= FEW_EDGES and not edges.filter("a IS NULL").limit(1).count():
                return gone.unionByName(_settled(edges))
            next_try = 2 * rounds
    return gone if gone is not None else signed.select("ord").limit(0)


def near_dedup(df: DataFrame, text: str = "text", ord_: str = "ord", threshold: float = THRESHOLD, num_perm: int = NUM_PERM, bands: int = BANDS, ngram: int = NGRAM) -> DataFrame:
    """(ord, is_duplicate, matched_ord, similarity): greedy first-wins near-dedup over all rows.

    ``matched_ord`` is the most similar earlier kept document, the first of equals.
    """
    lsh_rows(num_perm, bands)
    signed = materialize(with_signatures(df.select(F.col(ord_).alias("ord"), F.col(text).alias("text")), "text", num_perm, ngram, keep=["ord"]), "signatures")
    # Documents with one signature share the fate of the first: it is kept or, dropped, drops them too.
    firsts = materialize(signed.groupBy("signature").agg(F.min("ord").alias("ord")), "firsts")
    buckets = shared_buckets(firsts, num_perm, bands, telling_bands(threshold, num_perm, bands))
    gone = materialize(first_wins(firsts, buckets, threshold, num_perm), "gone")
    of = firsts.join(gone.withColumn("gone", F.lit(True)), "ord", "left").select("signature", F.col("ord").alias("f"), F.col("gone").isNull().alias("kept"))
    x = signed.join(of, "signature").select("ord", "f", "kept")
    # Kept documents in the buckets of dropped ones: what a dropped document can match.
    marked = buckets.join(gone.withColumn("gone", F.lit(True)), "ord", "left").select("bucket", "ord", F.col("gone").isNull().alias("kept"))
    near = _in_buckets(marked, firsts, agreement(threshold, num_perm)).select(F.col("a").alias("nb"), F.col("b").alias("f"), (F.col("n") / num_perm).alias("sim"))
    best = x.filter(~F.col("kept")).join(near, "f").filter("nb < ord").groupBy("ord").agg(F.max(F.struct("sim", (-F.col("nb")).alias("m"))).alias("best"))
    x = x.join(best, "ord", "left")
    first = F.col("ord") == F.col("f")
    matched = F.when(F.col("kept"), F.when(~first, F.col("f"))).otherwise(-F.col("best.m"))
    sim = F.when(F.col("kept"), F.when(~first, F.lit(1.0))).otherwise(F.col("best.sim"))
    return x.select("ord", (~(F.col("kept") & first)).alias("is_duplicate"), matched.alias("matched_ord"), sim.alias("similarity"))
