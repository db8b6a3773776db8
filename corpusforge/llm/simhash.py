"""SimHash near-duplicates through a segment-popcount embedding and a grid range-join.

A fingerprint's 64 bits form 32 segments of two bits; the bit counts of the
segments are its embedding, a point of {0,1,2}^32. The Manhattan distance of two
points never exceeds the Hamming distance of their fingerprints. Points within
``RADIUS`` = 4 differ in at most four of seven groups of dimensions and agree on
three, so equal coordinates on some three of seven groups (35 grids) find all of
them. Inside a grid cell the full Manhattan distance comes first, then the exact
Hamming distance. Nothing is capped: the links found are all links.

Documents with one fingerprint are one node. A cell yields a spanning star for each
linked set, never its pairs, so links grow with the nodes and not with the square
of a group. Large cells join neighbours in several sort orders first, and then
compare only what is not yet in the cell's largest set with the rest, within cells of
finer grids, so that a hot cell of scattered points is not compared pair by pair.

Defined results: null and empty texts have fingerprint zero, linked like any other;
a null ``doc_id`` never names a component unless all its members are null; repeated
rows are returned as often as they come; equal fingerprints are one point,
so ties cannot arise; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.graph import components
from corpusforge.session import materialize

SHINGLE, SEED, RADIUS, GROUPS, AGREE = 4, 42, 4, 7, 3
LOW = 0x5555555555555555
#: Cells up to this size are compared pair by pair at once.
SMALL_CELL = 24
#: Rows of a block of pairwise comparisons.
BLOCK = 1 << 22
#: Comparisons that a cell makes at most before it is split.
DIRECT = 1 << 24


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of the 4-word shingles of ``text``, A-Z lower-cased."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: -SHINGLE] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist())]
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[k : k + (1 << 16)], np.uint64)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(__id, __fp): one row for each row of ``docs``."""
    slim = docs.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{text}`").alias("__text"))

    def work(batches):
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["__id", "__fp"])

    return slim.mapInArrow(work, f"__id {slim.schema['__id'].dataType.simpleString()}, __fp long")


def embed(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the two-bit segments, in unary: popcount(embed(x) ^ embed(y)) is their Manhattan distance."""
    one, low = np.uint64(1), np.uint64(LOW)
    high = (fp >> one) & low
    return ((fp & low) | high) | (((fp & low) & high) << one)


def grid_masks() -> np.ndarray:
    """Masks of the dimensions that a cell fixes: all three of seven groups of segments."""
    of = np.array_split(np.arange(32), GROUPS)
    group = [sum(3 << (2 * int(i)) for i in g) for g in of]
    return np.array([sum(group[i] for i in c) for c in combinations(range(GROUPS), AGREE)], np.uint64)


def cells(fp: np.ndarray) -> np.ndarray:
    """(len(fp), 35) keys of the cells that hold each point."""
    masks = grid_masks()
    salt = (np.arange(1, len(masks) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    x = (embed(fp)[:, None] & masks[None, :]) ^ salt
    for shift, mul in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(mul)
    return x ^ (x >> np.uint64(31))


def _settle(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the sets of nodes a[i] and b[i]; a label is the set's smallest node."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return labels
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while (labels != (up := labels[labels])).any():
            labels = up


def link_cell(fp: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Label of each point of a large cell: points in one set have one label. Exact."""
    n, r = len(fp), np.uint8(radius)
    labels, point = np.arange(n), embed(fp)
    for turn in range(0, 64, 8):
        t = np.uint64(turn)
        order = np.argsort((fp << t) | (fp >> np.uint64((64 - turn) % 64)) if turn else fp)
        near = np.bitwise_count(fp[order[1:]] ^ fp[order[:-1]]) <= r
        labels = _settle(labels, order[1:][near], order[:-1][near])
    roots, counts = np.unique(labels, return_counts=True)
    rest = labels != roots[counts.argmax()]
    for i, j in _near_pairs(fp, point, rest, radius):
        labels = _settle(labels, i, j)
    return labels


def _near_pairs(fp: np.ndarray, point: np.ndarray, rest: np.ndarray, radius: int):
    """Pairs (i, j) within ``radius`` with i in ``rest``, in blocks; of many points, within cells of a finer grid.

    Points within the radius agree on one at least of ``radius`` + 1 groups of the
    segments, so it is enough to compare those that agree on a group. Only segments
    that differ between the points are grouped, so each cell is smaller than the last.
    """
    n, own = len(fp), np.flatnonzero(rest)
    segments = [s for s in range(32) if n * len(own) > DIRECT and len(np.unique(point >> np.uint64(2 * s) & np.uint64(3))) > 1]
    if len(segments) <= radius:
        step = max(1, BLOCK // max(n, 1))
        for k in range(0, len(own), step):
            rows = own[k : k + step]
            i, j = np.nonzero(np.bitwise_count(point[rows][:, None] ^ point[None, :]) <= radius)
            near = np.bitwise_count(fp[rows[i]] ^ fp[j]) <= radius
            yield rows[i][near], j[near]
        return
    for group in np.array_split(segments, radius + 1):
        key = point & np.uint64(sum(3 << (2 * int(s)) for s in group))
        order = np.argsort(key, kind="stable")
        borders = np.flatnonzero(np.diff(key[order])) + 1
        for cell in np.split(order, borders):
            if len(cell) > 1 and rest[cell].any():
                for i, j in _near_pairs(fp[cell], point[cell], rest[cell], radius):
                    yield cell[i], cell[j]


def _links(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges between the points of whole cells, sorted by key."""
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(key)])))
    small = np.repeat(sizes <= SMALL_CELL, sizes)
    k, f = key[small], fp[small]
    a, b = [], []
    point = embed(f)
    for d in range(1, SMALL_CELL):
        same = np.flatnonzero(k[d:] == k[:-d]) if len(k) > d else np.zeros(0, np.int64)
        if not len(same):
            break
        same = same[np.bitwise_count(point[same] ^ point[same + d]) <= RADIUS]
        same = same[np.bitwise_count(f[same] ^ f[same + d]) <= RADIUS]
        a.append(f[same]), b.append(f[same + d])
    for s, n in zip(starts[sizes > SMALL_CELL], sizes[sizes > SMALL_CELL]):
        own = fp[s : s + n]
        labels = link_cell(own)
        moved = np.flatnonzero(labels != np.arange(n))
        a.append(own[moved]), b.append(own[labels[moved]])
    return (np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


def whole_cells(batches):
    """The columns, as arrays, of batches that are sorted by their first column, cut only where that changes."""
    parts: list[list[np.ndarray]] = []
    for batch in batches:
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)]
        key = cols[0]
        if not len(key):
            continue
        cut = np.searchsorted(key, key[-1]) if key[0] != key[-1] else 0
        if parts and (cut or parts[-1][0][-1] != key[0]):
            yield [np.concatenate(x) for x in zip(*parts, [c[:cut] for c in cols])]
            parts = []
        elif cut:
            yield [c[:cut] for c in cols]
        parts.append([c[cut:] for c in cols])
    if parts:
        yield [np.concatenate(x) for x in zip(*parts)]


def link_edges(distinct: DataFrame) -> DataFrame:
    """(a, b): spanning links of the distinct fingerprints in column ``fp``."""

    def spread(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for k in range(0, len(fp), 8192):
                part = fp[k : k + 8192]
                keys = cells(part)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(part, keys.shape[1]).view(np.int64))], ["key", "fp"])

    def join(batches):
        for k, f in whole_cells(batches):
            a, b = _links(k, f.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a).view(np.int64)), pa.array(np.ascontiguousarray(b).view(np.int64))], ["a", "b"])

    keyed = distinct.select("fp").mapInArrow(spread, "key long, fp long")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(join, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, __fp, __component) for each row of ``docs``; the component is named by its smallest ``doc_id``."""
    fps = materialize(fingerprints(docs, doc_id, text), "fingerprints")
    nodes = materialize(fps.groupBy(F.col("__fp").alias("fp")).agg(F.min("__id").alias("rep")), "nodes")
    roots = components(link_edges(nodes))
    linked = nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    names = linked.groupBy("root").agg(F.min("rep").alias("__component"))
    named = linked.join(names, "root").select(F.col("fp").alias("__fp"), "__component")
    return fps.join(named, "__fp").select(F.col("__id").alias(doc_id), "__fp", "__component")


def hex64(c: Column) -> Column:
    return F.lpad(F.lower(F.hex(c)), 16, "0")


def op9_simhash(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = near_duplicates(docs)
    return out.select("doc_id", hex64(F.col("__fp")).alias("fingerprint"), F.col("__component").alias("component_id"))
