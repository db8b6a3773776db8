"""Exact and near dedup against sequential versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusforge.operators import exact, minhash
from corpusforge.streaming import dedup as stream

WORDS = "amber birch cedar dune ember fjord grove heath inlet jade knoll larch moor north oak pine quarry ridge slate thorn".split()


def docs(spark, texts, partitions=3):
    return spark.createDataFrame(list(enumerate(texts)), "ord long, text string").repartition(partitions)


def test_exact_levels(spark):
    texts = ["Hello, World!", "hello world", "hello   WORLD.", "page 12", "page 345", "", "?!", "STRASSE", "straße", "Hello, World!"]
    want = {"raw": [0, 1, 2, 3, 4, 5, 6, 7, 8, 0], "normalized": [0, 0, 0, 3, 4, 5, 5, 7, 7, 0], "structural": [0, 0, 0, 3, 3, 5, 5, 7, 7, 0]}
    for level, first in want.items():
        got = exact.mark_exact(docs(spark, texts), level=level).orderBy("ord").collect()
        assert [r["first_ord"] for r in got] == first
        assert [r["is_duplicate"] for r in got] == [a != b for a, b in enumerate(first)]
    with pytest.raises(ValueError, match="unknown level"):
        exact.signature(F.lit("x"), "loose")


def test_blake2b(spark):
    import hashlib

    got = spark.createDataFrame([("abc",), (None,)], "t string").select(exact.blake2b_128("t")).collect()
    assert [r[0] for r in got] == [hashlib.blake2b(b"abc", digest_size=16).hexdigest(), None]


def test_shingles(spark):
    df = docs(spark, ["a b c d", "a b", "", "a a a a a a"], 1)
    got = {r[0]: sorted(r[1]) for r in df.select("ord", minhash.shingles(F.col("text"), 2)).collect()}
    assert got == {0: ["a b", "b c", "c d"], 1: ["a b"], 2: [], 3: ["a a"]}


def test_estimate_is_near_true_jaccard(spark):
    r = random.Random(1)
    a = [f"w{r.randint(0, 999)}" for _ in range(300)]
    b = a[:140] + ["other"] + a[141:]
    c = [f"v{r.randint(0, 999)}" for _ in range(300)]
    sig = {r["ord"]: np.array(r["signature"]) for r in minhash.with_signatures(docs(spark, [" ".join(x) for x in (a, b, c)]), num_perm=256).collect()}
    sh = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a, b, c)]
    jac = lambda x, y: len(sh[x] & sh[y]) / len(sh[x] | sh[y])
    for x, y in ((0, 1), (0, 2)):
        assert abs((sig[x] == sig[y]).mean() - jac(x, y)) <= 3 / 16
    assert (sig[0] == sig[2]).mean() < 0.15


def test_bands_must_divide():
    with pytest.raises(ValueError, match="must divide"):
        minhash.lsh_rows(128, 33)
    assert minhash.approx_threshold(128, 32) == pytest.approx(0.42, abs=0.01)


def test_similarity_of_lengths(spark):
    df = spark.createDataFrame([([1, 2], [1, 3]), ([], [])], "a array<long>, b array<long>")
    assert [r[0] for r in df.select(minhash.similarity(F.col("a"), F.col("b"))).collect()] == [0.5, 0.0]


@pytest.mark.parametrize("seed", range(3))
def test_greedy_first_wins(spark, seed):
    """Against the plain loop: drop a document that has an earlier kept neighbour at the threshold."""
    r = random.Random(seed)
    texts = []
    for _ in range(12):
        w = r.choices(WORDS, k=60)
        for _ in range(6):
            texts.append(" ".join(w))
            w = list(w)
            w[r.randrange(len(w))] = f"new{r.randrange(99)}"
    texts += ["", "", texts[3]]
    r.shuffle(texts)
    df = docs(spark, texts, 1 + seed * 3)
    sig = {x["ord"]: np.array(x["signature"]) for x in minhash.with_signatures(df).collect()}
    got = {x["ord"]: x for x in minhash.near_dedup(df, threshold=0.6).collect()}
    kept = []
    for i in range(len(texts)):
        sims = [((sig[i] == sig[k]).mean(), -k) for k in kept]
        near = [s for s in sims if s[0] >= 0.6 and any((sig[i][b * 4 : b * 4 + 4] == sig[-s[1]][b * 4 : b * 4 + 4]).all() for b in range(32))]
        assert got[i]["is_duplicate"] == bool(near), i
        if near:
            assert (got[i]["similarity"], -got[i]["matched_ord"]) == max(near)
        else:
            kept.append(i)


def test_chain_keeps_both_ends(spark):
    """a ~ b ~ c without a ~ c: dropping b leaves c."""
    w = [f"t{i}" for i in range(400)]
    a, b, c = (" ".join(w[k : k + 360]) for k in (0, 20, 40))
    got = {r["ord"]: (r["is_duplicate"], r["matched_ord"]) for r in minhash.near_dedup(docs(spark, [a, b, c, "alone"]), threshold=0.86).collect()}
    sig = [np.array(r["signature"]) for r in minhash.with_signatures(docs(spark, [a, b, c])).orderBy("ord").collect()]
    assert (sig[0] == sig[1]).mean() >= 0.86 > (sig[0] == sig[2]).mean() and (sig[1] == sig[2]).mean() >= 0.86
    assert got == {0: (False, None), 1: (True, 0), 2: (False, None), 3: (False, None)}


def test_exact_and_near_streams(spark, tmp_path):
    a = " ".join(WORDS * 3)
    rows = [[(0, a), (1, "other text entirely " * 9)], [(2, a), (3, a + " end")], [(4, "third of its kind " * 9)]]
    for k, part in enumerate(rows):
        spark.createDataFrame(part, "ord long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    read = lambda: stream.read_stream(spark, f"{tmp_path}/in", "ord long, text string", files_per_trigger=1)
    q = stream.exact_stream(read()).writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT count(*) FROM firsts").first()[0] == 4
    index = stream.NearIndex(spark, f"{tmp_path}/index")
    q = stream.near_stream(read(), index, f"{tmp_path}/out", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(180)
    kept = {r["ord"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert len(kept) == 3 and len(kept & {0, 2, 3}) == 1


@pytest.mark.parametrize("rows", [minhash.BUCKET_ROWS, 5])
def test_members_that_are_not_near_take_few_rounds(spark, monkeypatch, rows):
    """Half of each text is common, so the buckets are shared and hardly anything is near: once a round for each text."""
    r = random.Random(5)
    common = [f"c{i}" for i in range(70)]
    texts = [" ".join(common + [f"w{k}_{i}" for i in range(30)]) for k in range(24)]
    texts += [t.replace(f"w{k}_29", "end") for k, t in enumerate(texts[:6])]
    r.shuffle(texts)
    names = []
    write = minhash.materialize
    monkeypatch.setattr(minhash, "materialize", lambda df, name: names.append(name) or write(df, name))
    monkeypatch.setattr(minhash, "BUCKET_ROWS", rows)
    got = {x["ord"]: x for x in minhash.near_dedup(docs(spark, texts)).collect()}
    assert names.count("kept") <= 3 and "edges" in names
    sig = {x["ord"]: np.array(x["signature"]) for x in minhash.with_signatures(docs(spark, texts)).collect()}
    kept = []
    for i in range(len(texts)):
        near = [((sig[i] == sig[k]).mean(), -k) for k in kept if (sig[i] == sig[k]).mean() >= minhash.THRESHOLD]
        assert got[i]["is_duplicate"] == bool(near), i
        if near:
            assert (got[i]["similarity"], -got[i]["matched_ord"]) == max(near)
        else:
            kept.append(i)
    assert 20 <= len(kept) < len(texts)


def test_signatures_are_the_minima_of_hashed_shingles(spark):
    texts = ["", "?", "one two", "Ärger und ÜBER_mut, 12 mal — " * 3, "a b c d e f g " * 700]
    a, b = (np.array(x, object) for x in zip(*minhash.coefficients()))
    rows = docs(spark, texts).select("ord", F.transform(minhash.shingles(F.col("text")), minhash.shingle_hash).alias("h")).collect()
    want = {r["ord"]: [min((x * p + q) % minhash.PRIME for x in r["h"]) if r["h"] else minhash.EMPTY for p, q in zip(a, b)] for r in rows}
    got = minhash.with_signatures(docs(spark, texts), keep=["ord"])
    assert got.columns == ["ord", "signature"] and {r["ord"]: r["signature"] for r in got.collect()} == want
