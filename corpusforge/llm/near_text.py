"""Near-duplicate texts: wide SimHash, segment bit counts, grid join, exact check.

The operator of ``simhash`` with the parameters that a stage on word shingles takes:
five words and a Jaccard similarity of ``SIMILARITY`` or more. At that similarity two
64-bit fingerprints differ in about ten bits and unrelated ones in 32, which is too
little room, so a fingerprint here has 128 bits, and near texts differ in ``RADIUS``
at most (98.7 % of pairs at 0.8, nearly all above).

A fingerprint is embedded as the bit counts of its 64 two-bit segments, whose Manhattan
distance never exceeds the Hamming distance. A grid fixes the counts of some segments;
points in one cell are compared by Manhattan and then by Hamming distance, and what is
left is verified on the whole shingle sets. How many segments a grid fixes follows from
the number of texts, so that a cell holds about ``CELL`` unrelated ones at most, and the
number of grids from ``RECALL``: a pair at the threshold shares a cell with that
probability, a closer one more often (0.99 at 0.85, 0.998 at 0.9).

Texts with one shingle set are one node. A cell with few close pairs gives them all; a
dense one gives each node's nearest neighbour, and then, when those are verified and
joined, the members of pairs that are still apart and whose similarity can reach the
threshold, as far as the shingles tell that no other text of a dense cell has. Those get
their sets in the cell and are verified there. So a group of near copies makes rows in
proportion to its members, and a pair is left out only if its texts are joined already or
cannot be near.

Defined results: null and empty texts are one text without words, near to each other;
a null id comes after all others, so it survives only if its group has no other; null or
repeated ids cost no row that is not a near copy; equal rows leave one; an empty table
gives an empty result; all columns are kept as they are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.graph import components
from corpusforge.llm.simhash import embed, whole_cells
from corpusforge.session import discard, materialize

SHINGLE, SIMILARITY, SEED, RADIUS = 5, 0.8, 42, 28
CELL, RECALL, LEAST_FIXED = 8192, 0.96, 8
#: Chance that a two-bit segment's count is the same: for a pair at the threshold, and for unrelated texts.
APART = math.acos(2 * SIMILARITY / (1 + SIMILARITY)) / math.pi
SAME_NEAR, SAME_FAR = (1 - APART) ** 2 + APART**2 / 2, 0.375
#: Cells up to SMALL are compared at once; above WIDE a dense cell links neighbours in sort order first.
SMALL, WIDE, FEW = 24, 32_768, 1
BLOCK = 1 << 21
#: Bits for each hash of a filter that tells which texts can be of use, and bits in all.
FILTER_BITS, MAX_FILTER_BITS = 16, 1 << 27


def mix(x: np.ndarray) -> np.ndarray:
    for shift, mul in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(mul)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Hashes of the word n-grams of ``text`` in order, A-Z lower-cased; one of all words where there are fewer."""
    words = (text or "").encode().lower().split()
    joined = b" ".join(words)
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-n] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[n - 1 :].tolist())], np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(shingle_hashes(text))


def short_set(text: str | None) -> np.ndarray:
    """The shingle set at half the size, to be sent for verification: the upper halves of the hashes. Two in a million shingles of a 10,000-word text meet by chance."""
    return np.unique((shingle_set(text) >> np.uint64(32)).astype(np.uint32))


def wide_fingerprint(own: np.ndarray) -> np.ndarray:
    """128-bit SimHash, as two words, of a shingle set; the second word's bits come from the hashes mixed again."""
    out = np.empty(2, np.uint64)
    for k in range(2):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(own), 1 << 16):
            part = own[at : at + (1 << 16)]
            part = mix(part + np.uint64(0x9E3779B97F4A7C15)) if k else part
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        out[k] = np.packbits(2 * ones > len(own), bitorder="little").view(np.uint64)[0]
    return out


def recall(fixed: int, count: int) -> float:
    """Chance that a pair at the threshold shares one of ``count`` cells of ``fixed`` segments each.

    Of the 64 segments a binomial number differs, and a grid misses all of those or not.
    """
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    found = 0.0
    for d in range(65 - fixed):
        share = math.exp(choose(64, d) + d * math.log(1 - SAME_NEAR) + (64 - d) * math.log(SAME_NEAR))
        found += share * (1 - (1 - math.exp(choose(64 - d, fixed) - choose(64, fixed))) ** count)
    return found


def grids(n: int) -> np.ndarray:
    """(grids, 2) masks over two words: the segments that each grid fixes, for ``n`` distinct texts."""
    fixed = max(LEAST_FIXED, math.ceil(math.log(max(n, 1) / CELL) / -math.log(SAME_FAR)))
    count = 8
    while recall(fixed, count) < RECALL:
        count += 1 + count // 16
    r, masks = np.random.default_rng(SEED), np.zeros((count, 2), np.uint64)
    for g in range(count):
        for s in r.choice(64, fixed, replace=False):
            masks[g, s // 32] |= np.uint64(3 << (2 * int(s % 32)))
    return masks


def cell_keys(f0: np.ndarray, f1: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """(len(f0), grids) keys of the cells that hold each point."""
    salt = (np.arange(1, len(masks) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    x = mix((embed(f0)[:, None] & masks[None, :, 0]) ^ salt)
    return mix(x + (embed(f1)[:, None] & masks[None, :, 1]))


class Points:
    """Fingerprints and their embeddings; distances between positions."""

    def __init__(self, f0: np.ndarray, f1: np.ndarray):
        self.f, self.e = (f0, f1), (embed(f0), embed(f1))

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs are within the radius: by Manhattan distance first, then by Hamming."""
        hit = np.flatnonzero(self._of(self.e, i, j) <= RADIUS)
        return hit[self._of(self.f, i[hit], j[hit]) <= RADIUS]

    def rows(self, i: np.ndarray) -> np.ndarray:
        """Hamming distances of rows ``i`` to all points."""
        return sum(np.bitwise_count(w[i][:, None] ^ w[None, :]) for w in self.f)

    @staticmethod
    def _of(words, i, j):
        return sum(np.bitwise_count(w[i] ^ w[j]) for w in words)


def _dense(p: Points, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Of a cell of ``n`` points: all pairs if they are few; else none, and for each point a near one (-1: there is none)."""
    none = np.zeros(0, np.int64)
    if n > WIDE:
        near = np.arange(n)  # itself: all members stay for the second round
        for turn in range(0, 64, 16):
            for w in p.f:
                t = np.uint64(turn)
                order = np.argsort((w << t) | (w >> np.uint64((64 - turn) % 64)) if turn else w)
                hit = p.near(order[1:], order[:-1])
                near[order[1:][hit]] = order[:-1][hit]
        return none, none, near
    a, b, near = [none], [none], np.full(n, -1)
    step = max(1, BLOCK // n)
    for k in range(0, n, step):
        own = np.arange(k, min(n, k + step))
        d = p.rows(own)
        d[np.arange(len(own)), own] = 255
        i, j = np.nonzero(d <= RADIUS)
        later = own[i] < j
        a.append(own[i[later]]), b.append(j[later])
        best = d.argmin(axis=1)
        near[own] = np.where(d[np.arange(len(own)), best] <= RADIUS, best, -1)
    a, b = np.concatenate(a), np.concatenate(b)
    return (a, b, None) if len(a) <= FEW * n else (none, none, near)


def _first_round(key, node, f0, f1):
    """Of whole cells sorted by key: candidate pairs of nodes; positions of the members of dense cells, and the nearest node of each (-1: none)."""
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(key)])))
    few = np.flatnonzero(np.repeat(sizes <= SMALL, sizes))
    k, p = key[few], Points(f0[few], f1[few])
    none = np.zeros(0, np.int64)
    a, b, dense, nearest = [none], [none], [none], [none]
    for d in range(1, min(SMALL, len(k))):
        same = np.flatnonzero(k[d:] == k[:-d])
        if not len(same):
            break
        hit = same[p.near(same, same + d)]
        a.append(node[few[hit]]), b.append(node[few[hit + d]])
    for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
        x, y, near = _dense(Points(f0[s : s + n], f1[s : s + n]), int(n))
        a.append(node[s + x]), b.append(node[s + y])
        if near is not None:
            # A member without a near one is in no pair of this cell.
            own = np.flatnonzero(near >= 0)
            dense.append(s + own), nearest.append(node[s + near[own]])
    return tuple(map(np.concatenate, (a, b, dense, nearest)))


def _second_round(key, f0, f1, root, size, shared, masks):
    """Of whole dense cells: pairs of positions within the radius that are not joined yet and can be similar.

    Two sets of ``size`` shingles have no more in common than either one has ``shared``
    with any other text. A pair comes from the first grid in which it shares a cell.
    """
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s, e in zip(starts, [*starts[1:], len(key)]):
        own, p = root[s:e], Points(f0[s:e], f1[s:e])
        roots, counts = np.unique(own, return_counts=True)
        rest = np.flatnonzero(own != roots[counts.argmax()])
        step = max(1, BLOCK // int(e - s))
        keys = cell_keys(f0[s:e], f1[s:e], masks) if len(rest) else None
        for k in range(0, len(rest), step):
            rows = rest[k : k + step]
            i, j = np.nonzero((p.rows(rows) <= RADIUS) & (own[rows][:, None] != own[None, :]))
            i = s + rows[i]
            j = s + j
            most = np.minimum(shared[i], shared[j])
            can = most >= SIMILARITY * (size[i] + size[j] - most)
            i, j = i[can], j[can]
            here = np.empty(len(i), bool)
            for x in range(0, len(i), 1 << 14):
                shared_cell = keys[i[x : x + (1 << 14)] - s] == keys[j[x : x + (1 << 14)] - s]
                first = shared_cell.argmax(axis=1)
                here[x : x + (1 << 14)] = keys[i[x : x + (1 << 14)] - s, first] == key[s].view(np.uint64)
            a.append(i[here]), b.append(j[here])
    return np.concatenate(a), np.concatenate(b)


def _ordered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distinct pairs, smaller node first."""
    return np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0)


def candidates(nodes: DataFrame, masks: np.ndarray) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of ``nodes`` (node, f0, f1): candidate pairs (a, b), the members (key, node, f0, f1) of dense cells, and the table that holds these."""

    def spread(batches):
        for batch in batches:
            node, f0, f1 = (batch.column(k).to_numpy() for k in range(3))
            step = max(1, (1 << 18) // len(masks))
            for k in range(0, len(node), step):
                keys = cell_keys(f0[k : k + step].view(np.uint64), f1[k : k + step].view(np.uint64), masks)
                cols = [np.repeat(c[k : k + step], len(masks)) for c in (node, f0, f1)]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), *map(pa.array, cols)], ["key", "node", "f0", "f1"])

    names, zero = ["a", "b", "key", "f0", "f1"], lambda n: pa.nulls(n, pa.int64())

    def join(batches):
        for key, node, f0, f1 in whole_cells(batches):
            a, b, dense, nearest = _first_round(key, node, f0.view(np.uint64), f1.view(np.uint64))
            if len(a):
                ab = _ordered(a, b)
                yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1]), *[zero(len(ab))] * 3], names)
            if len(dense):
                yield pa.RecordBatch.from_arrays([pa.array(node[dense]), pa.array(nearest), *[pa.array(c[dense]) for c in (key, f0, f1)]], names)

    cells = nodes.select("node", "f0", "f1").mapInArrow(spread, "key long, node long, f0 long, f1 long")
    found = cells.repartition("key").sortWithinPartitions("key").mapInArrow(join, "a long, b long, key long, f0 long, f1 long")
    found = materialize(found, "found")
    # A member of a dense cell is one row, with its nearest.
    pairs = materialize(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    return pairs, found.filter("key IS NOT NULL").select("key", F.col("a").alias("node"), "f0", "f1"), found


def shared_counts(dense: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, size, shared): of each text of a dense cell, its shingles, and those that another text of a dense cell has."""
    own = sets.join(dense.select("node").distinct(), "node", "left_semi")

    def spread(batches):
        for b in batches:
            for node, x in zip(b.column(0).to_numpy(), b.column(1)):
                h = np.frombuffer(x.as_py(), np.uint32).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), node))], ["h", "node"])

    alone = own.mapInArrow(spread, "h long, node long").groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node")).filter("n = 1")
    alone = alone.groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    size = (F.length("own") / 4).cast("long")
    return own.select("node", size.alias("size")).join(alone, "node", "left").select("node", "size", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("shared"))


def similar(x: np.ndarray, y: np.ndarray, similarity: float = SIMILARITY) -> bool:
    both = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
    return both >= similarity * (len(x) + len(y) - both)


def still_apart(dense: DataFrame, roots: DataFrame, sets: DataFrame, masks: np.ndarray) -> DataFrame:
    """Verified links (a, b) that join what shares a dense cell, is within the radius and not joined by ``roots`` (node, root).

    Members with such a pair go to their cell again with their sets, so what is sent grows with the members and not with their pairs.
    """
    names = ["key", "node", "f0", "f1", "root", "size", "shared"]

    def pairs(key, node, f0, f1, root, size, shared):
        return _second_round(key, f0.view(np.uint64), f1.view(np.uint64), root, size, shared, masks)

    def concerned(batches):
        for cols in whole_cells(batches):
            at = np.unique(np.concatenate(pairs(*cols)))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(c[at]) for c in cols], names)

    def verify(batches):
        for *cols, own in whole_cells(batches):
            node, root, up, links = cols[1], cols[4].tolist(), {}, []

            def top(r, up=up):
                while r in up:
                    r = up[r]
                return r

            own = [np.frombuffer(x, np.uint32) for x in own]
            for i, j in _ordered(*pairs(*cols)).tolist():
                x, y = top(root[i]), top(root[j])
                # What an earlier link has joined needs no other.
                if x != y and similar(own[i], own[j]):
                    up[max(x, y)] = min(x, y)
                    links.append((node[i], node[j]))
            if links:
                ab = _ordered(*np.array(links, np.int64).T)
                yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], ["a", "b"])

    # A text that no first pair names is near no other; it has no set and goes here.
    x = dense.join(materialize(shared_counts(dense, sets), "shared"), "node").join(roots, "node", "left")
    x = x.select("key", "node", "f0", "f1", F.coalesce("root", "node").alias("root"), "size", "shared")
    x = x.repartition("key").sortWithinPartitions("key").mapInArrow(concerned, ", ".join(f"{c} long" for c in names))
    x = materialize(x, "apart")
    cells = x.join(sets.hint("merge"), "node").select(*names, "own").repartition("key").sortWithinPartitions("key")
    links = materialize(cells.mapInArrow(verify, "a long, b long"), "links")
    discard(x)
    return links


def verified(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``pairs`` (a, b) whose shingle ``sets`` (node, own) have a Jaccard similarity of ``similarity`` at least."""

    def work(batches):
        for b in batches:
            near = []
            for x, y in zip(b.column(2), b.column(3)):
                near.append(similar(np.frombuffer(x.as_py(), np.uint32), np.frombuffer(y.as_py(), np.uint32), similarity))
            yield b.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    # Sizes alone rule out many pairs before whole sets are sent. Sets are wide rows: they are never broadcast through the driver.
    size = lambda c: sets.select(F.col("node").alias(c), F.length("own").alias(f"n_{c}"))
    can = F.least("n_a", "n_b") >= F.lit(similarity) * F.greatest("n_a", "n_b")
    pairs = pairs.join(size("a"), "a").join(size("b"), "b").filter(can).select("a", "b")
    own = lambda c: sets.select(F.col("node").alias(c), F.col("own").alias(f"own_{c}")).hint("merge")
    return pairs.join(own("b"), "b").join(own("a"), "a").select("a", "b", "own_a", "own_b").mapInArrow(work, "a long, b long")


def may_be_in(rows: DataFrame, c: str, keys: DataFrame, k: str) -> DataFrame:
    """``rows`` whose 64-bit hash ``c`` is among ``keys``' hashes ``k``, and a few others (2 in 100 at most, until ``keys`` has
    8 million), without a shuffle of ``rows``."""
    bits = min(MAX_FILTER_BITS, 1 << max(10, (FILTER_BITS * keys.count() - 1).bit_length()))
    places = lambda h: [h.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(bits - 1))]
    at = keys.select(F.explode(F.array(*places(F.col(k)))).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits")).toArrow()
    own = np.zeros(bits >> 6, np.int64)
    own[words["word"].to_numpy()] = words["bits"].to_numpy()
    one = rows.sparkSession.createDataFrame(pa.table({"__bits": pa.array([own], pa.list_(pa.int64()))}))
    hit = [F.getbit(F.get("__bits", F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1 for p in places(F.col(c))]
    return rows.join(F.broadcast(one), hit[0] & hit[1], "left_semi")


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(id, th) of the documents that have an earlier one in their group, and of those that stay but are repeated.

    A document is named by its id and the hash of its text; earlier is by id, null last, and text hash.
    """
    of = F.col(f"`{text}`")
    slim = docs.select(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(F.coalesce(of, F.lit(""))).alias("th"), of.alias("text"))
    id_type = slim.schema["id"].dataType.simpleString()

    def sign(batches):
        for b in batches:
            name, f = [], np.empty((b.num_rows, 2), np.uint64)
            for k, t in enumerate(b.column(2)):
                own = shingle_set(t.as_py())
                name.append(xxhash.xxh128_digest(own.tobytes()))
                f[k] = wide_fingerprint(own)
            f = f.view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(name, pa.binary()), *[pa.array(np.ascontiguousarray(f[:, k])) for k in range(2)]], ["id", "th", "name", "f0", "f1"])

    signed = materialize(slim.mapInArrow(sign, f"id {id_type}, th long, name binary, f0 long, f1 long"), "signed")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("first")
    nodes = signed.groupBy("name").agg(first, F.min("f0").alias("f0"), F.min("f1").alias("f1")).withColumn("node", F.monotonically_increasing_id())
    nodes = materialize(nodes, "nodes")
    masks = grids(nodes.count())
    pairs, dense, found = candidates(nodes, masks)
    repeated = materialize(signed.groupBy("id", "th").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", "th"), "repeated")
    met = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    met = materialize(nodes.join(met, "node", "left_semi").select("node", F.col("first.id").alias("m_id"), F.col("first.th").alias("m_th")), "met")

    def own_sets(batches):
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([short_set(t.as_py()).tobytes() for t in part.column(1)], pa.binary())], ["node", "own"])

    # Most texts are near no other and are not sent.
    texts = may_be_in(slim, "th", met, "m_th").join(met, (F.col("th") == F.col("m_th")) & F.col("id").eqNullSafe(F.col("m_id"))).select("node", "text")
    sets = texts.mapInArrow(own_sets, "node long, own binary")
    sets = materialize(sets if repeated.isEmpty() else sets.dropDuplicates(["node"]), "sets")
    links = materialize(verified(pairs, sets), "links")
    roots = components(links)
    more = still_apart(dense, roots, sets, masks)
    if not more.isEmpty():
        again = materialize(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more), "links")
        discard(roots)
        roots = components(again)
        discard(again)
    discard(pairs, found, met, sets, links, more)
    groups = nodes.join(roots, "node", "left").select("name", F.coalesce("root", "node").alias("root"), "first")
    stay = groups.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.id").alias("s_id"), F.col("first.th").alias("s_th"))
    stay = materialize(stay, "stay")
    is_first = (F.col("th") == F.col("s_th")) & F.col("id").eqNullSafe(F.col("s_id"))
    gone = materialize(signed.select("id", "th").join(stay, is_first, "left_anti").distinct(), "gone")
    twice = materialize(repeated.join(stay, is_first, "left_semi"), "twice")
    discard(signed, nodes, repeated, roots, stay)
    return gone, twice


def stage_near_dedup(spark, docs, sf_dir, doc_id: str = "doc_id", text: str = "text"):
    """``docs`` with one row of each group of near copies: the first by id (null last) and text hash. All columns of ``docs``."""
    gone, twice = (x.select(F.col("id").alias("__g_id"), F.col("th").alias("__g_th")) for x in near_groups(docs, doc_id, text))
    x = docs.withColumn("__th", F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    same = (F.col("__th") == F.col("__g_th")) & F.col(f"`{doc_id}`").eqNullSafe(F.col("__g_id"))
    x = x.join(gone, same, "left_anti")
    if not twice.isEmpty():
        # Only rows that are repeated are gathered, one of each before they are sent.
        one = x.join(twice, same, "left_semi").dropDuplicates([doc_id, "__th"])
        x = x.join(twice, same, "left_anti").unionByName(one)
    return x.drop("__th")
