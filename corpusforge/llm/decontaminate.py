"""Benchmark decontamination: BM25 over test items with block-max WAND, then overlap.

The test items form a BM25 inverted index whose scores are divided by each item's
score for itself, so one threshold serves items of any length. Every training
document is cut into passages that overlap by half and are twice as long as the
longest item; each passage is a query, and all items above the threshold are
retrieved. Upper bounds prune twice: a matrix of block maxima rules out whole
batches of passages at once, and block-max WAND walks the postings for the rest.
Both only skip what cannot reach the threshold, so retrieval is exact.

What is retrieved is verified on words: an item leaks if the passage holds at least
0.8 of its five-word shingles, and 0.8 of those of its question or of the words of
its answer, which is its last sentence. Question and answer overlap are reported.

The index goes to the executors in shards of about ``SHARD_CHARS`` characters of item
text, which bounds what is broadcast; each shard is one pass over the documents.
Document frequencies, lengths and the passages' size are those of all items, so scores
and what is found do not depend on the shards. Documents are not shuffled and read whole.

Defined results: null and empty texts never leak; items without words match nothing;
null ids pass through; repeated rows give repeated hits; repeated items are items
each; of a document's passages that hold an item with one score the one with more
overlap counts; empty tables give empty results; other columns are ignored, or kept by
``drop_leaks``.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.session import materialize, slices

SHINGLE, OVERLAP, THRESHOLD = 5, 0.8, 0.6
K1, B, BLOCK_ITEMS = 1.2, 0.75, 8
SHARD_CHARS = 2_000_000
#: Largest matrix of block maxima, in cells; a larger index is walked by WAND alone.
SCREEN_CELLS = 16_000_000
#: Tokens screened at once, and cells of block maxima gathered at once for them.
CHUNK_TOKENS, GATHER_CELLS = 200_000, 1_000_000


def words_of(text: str | None) -> list[bytes]:
    """ASCII-space separated words, A-Z lower-cased."""
    return (text or "").encode().lower().split()


def split_item(text: str) -> tuple[list[bytes], list[bytes]]:
    """Question and answer of an item: the answer is the last sentence, or the last quarter of the only one."""
    parts = [p for p in re.split(r"(?<=[.?!])\s+", text.strip()) if p]
    if len(parts) > 1:
        return words_of(" ".join(parts[:-1])), words_of(parts[-1])
    w = words_of(text)
    cut = len(w) - max(1, len(w) // 4)
    return w[:cut], w[cut:]


def shingles(words: list[bytes]) -> set[bytes]:
    if not words:
        return set()
    return {b" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}


class Collection(NamedTuple):
    """What BM25 asks of all items: how many have words, their mean and largest lengths, and the items with each word."""

    items: int
    mean: float
    longest: int
    df: dict

    @classmethod
    def of(cls, items: list[tuple]) -> Collection:
        own = [w for _, t in items if (w := words_of(t))]
        return cls(len(own), sum(map(len, own)) / max(1, len(own)), max(map(len, own), default=1), Counter(x for w in own for x in set(w)))


class ItemIndex:
    """BM25 postings of the items, normalised by self-score, with block maxima."""

    def __init__(self, items: list[tuple], threshold: float = THRESHOLD, collection: Collection | None = None):
        self.threshold = threshold
        rows = [(i, t, w) for i, t in items if (w := words_of(t))]
        total, mean, self.longest, df = collection or Collection.of(items)
        # Items that share frequent words, so mostly of one language, share blocks.
        rows.sort(key=lambda r: (sorted(((-df[x], x) for x in set(r[2])))[:3], r[1]))
        self.ids = [r[0] for r in rows]
        self.parts = [split_item(r[1]) for r in rows]
        self.shingles = [shingles(r[2]) for r in rows]
        self.vocab = {x: k for k, x in enumerate(sorted({x for r in rows for x in r[2]}))}
        idf = {x: math.log(1 + (total - df[x] + 0.5) / (df[x] + 0.5)) for x in self.vocab}
        postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for d, (_, _, w) in enumerate(rows):
            tf = Counter(w)
            score = {x: idf[x] * n * (K1 + 1) / (n + K1 * (1 - B + B * len(w) / mean)) for x, n in tf.items()}
            own = sum(score.values())
            for x, s in score.items():
                postings[self.vocab[x]].append((d, s / own))
        self.docs = [[d for d, _ in postings[t]] for t in range(len(self.vocab))]
        self.weights = [[s for _, s in postings[t]] for t in range(len(self.vocab))]
        self.most = [max(w) for w in self.weights]
        self.blocks = [{} for _ in self.docs]
        n_blocks = -(-len(rows) // BLOCK_ITEMS)
        small = len(self.vocab) * n_blocks <= SCREEN_CELLS
        self.bound = np.zeros((len(self.vocab), n_blocks), np.float32) if small else None
        for t, (ds, ws) in enumerate(zip(self.docs, self.weights)):
            for d, s in zip(ds, ws):
                b = d // BLOCK_ITEMS
                self.blocks[t][b] = max(s, self.blocks[t].get(b, 0.0))
            if small:
                self.bound[t, list(self.blocks[t])] = list(self.blocks[t].values())

    def retrieve(self, terms: list[int]) -> list[tuple[int, float]]:
        """All (item, score) with score >= threshold for a query of distinct terms: block-max WAND."""
        least = self.threshold - 1e-9
        cursor = [[self.docs[t][0], 0, t] for t in terms]
        out = []
        end = len(self.ids)

        def seek(c, d):
            ds = self.docs[c[2]]
            c[1] = bisect_left(ds, d, c[1])
            c[0] = ds[c[1]] if c[1] < len(ds) else end

        while True:
            cursor.sort()
            total, pivot = 0.0, -1
            for k, c in enumerate(cursor):
                if c[0] >= end:
                    break
                total += self.most[c[2]]
                if total >= least:
                    pivot = k
                    break
            if pivot < 0:
                return out
            d = cursor[pivot][0]
            while pivot + 1 < len(cursor) and cursor[pivot + 1][0] == d:
                pivot += 1
            block = d // BLOCK_ITEMS
            if sum(self.blocks[c[2]].get(block, 0.0) for c in cursor[: pivot + 1]) < least:
                # No item of this block before the next cursor's can reach the threshold.
                to = min((block + 1) * BLOCK_ITEMS, cursor[pivot + 1][0] if pivot + 1 < len(cursor) else end)
                for c in cursor[: pivot + 1]:
                    if c[0] < to:
                        seek(c, to)
            elif cursor[0][0] == d:
                score = sum(self.weights[c[2]][c[1]] for c in cursor[: pivot + 1])
                if score >= least:
                    out.append((d, score))
                for c in cursor[: pivot + 1]:
                    seek(c, d + 1)
            else:
                for c in cursor[:pivot]:
                    if c[0] < d:
                        seek(c, d)

    def verify(self, item: int, passage: list[bytes]) -> tuple[float, float, float]:
        """Shares of the item's and the question's shingles, and of the answer's words, in the passage."""
        have, bag = shingles(passage), Counter(passage)
        question, answer = self.parts[item]
        q = shingles(question)
        share = lambda s: len(s & have) / len(s) if s else 1.0
        found = sum(min(n, bag[x]) for x, n in Counter(answer).items())
        return share(self.shingles[item]), share(q), found / len(answer) if answer else 1.0

    def search(self, texts) -> list[dict[int, tuple[float, float, float, float]]]:
        """For each text: item -> (score, item overlap, question overlap, answer overlap) of its best leaking passage."""
        out: list[dict] = []
        part, n = [], 0
        for t in texts:
            part.append(words_of(t))
            n += len(part[-1])
            if n >= CHUNK_TOKENS:
                out += self._search(part)
                part, n = [], 0
        return out + self._search(part)

    def _best_bounds(self, term: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each query, whose terms lie from ``starts`` to ``ends``, the largest sum of block maxima; some queries at a time."""
        best = np.empty(len(starts), np.float32)
        most = max(1, GATHER_CELLS // self.bound.shape[1])
        k = 0
        while k < len(starts):
            # One query at least, however many terms it has.
            to = max(k + 1, int(np.searchsorted(ends, starts[k] + most, "right")))
            part = self.bound[term[starts[k] : ends[to - 1]]]
            best[k:to] = np.add.reduceat(part, starts[k:to] - starts[k], axis=0).max(axis=1)
            k = to
        return best

    def _search(self, docs: list[list[bytes]]) -> list[dict]:
        found: list[dict] = [{} for _ in docs]
        if not self.ids or not docs:
            return found
        step, get = self.longest, self.vocab.get
        counts = np.array([len(w) for w in docs], np.int64)
        passages = np.maximum(1, -(-counts // step) - 1)
        first = np.concatenate(([0], np.cumsum(passages)))
        ids = np.array([x for w in docs for x in map(get, w, repeat(-1))], np.int64)
        doc = np.repeat(np.arange(len(docs)), counts)
        at = np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts)
        known = ids >= 0
        ids, doc, chunk = ids[known], doc[known], at[known] // step
        # A token is in the passage that starts with its chunk and in the one before.
        here, before = chunk < passages[doc], chunk > 0
        query = np.concatenate((first[doc[here]] + chunk[here], first[doc[before]] + chunk[before] - 1))
        pairs = np.unique(query * len(self.vocab) + np.concatenate((ids[here], ids[before])))
        if not len(pairs):
            return found
        query, term = np.divmod(pairs, len(self.vocab))
        starts = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1])))
        ends = np.concatenate((starts[1:], [len(query)]))
        if self.bound is not None:
            passing = np.flatnonzero(self._best_bounds(term, starts, ends) >= self.threshold - 1e-4)
        else:
            passing = np.arange(len(starts))
        for k in passing:
            d = int(np.searchsorted(first, query[starts[k]], "right")) - 1
            p = int(query[starts[k]] - first[d])
            for item, score in self.retrieve(term[starts[k] : ends[k]].tolist()):
                whole, q, a = self.verify(item, docs[d][p * step : (p + 2) * step])
                if whole >= OVERLAP and max(q, a) >= OVERLAP:
                    found[d][item] = max(found[d].get(item, (0.0,)), (score, whole, q, a))
        return found


def shards(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", shard_chars: int | None = None):
    """The items as indexes, one for each shard; sizes are summed before anything is collected."""
    items = benchmark.select(F.col(f"`{item_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // (shard_chars or SHARD_CHARS)) or 1
    if n == 1:
        yield ItemIndex([(r[0], r[1]) for r in items.collect()])
        return
    low = F.translate(F.btrim("text", F.lit(" \t\n\x0b\x0c\r")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = items.withColumns({"shard": F.pmod(F.xxhash64("text"), F.lit(n)), "words": F.split(F.when(low != "", low), r"[\x20\x09-\x0D]+", -1)})
    words = materialize(words.filter("words IS NOT NULL"), "items")
    count, mean, longest = words.agg(F.count(F.lit(1)), F.avg(F.size("words")), F.max(F.size("words"))).first()
    each = words.select("shard", F.explode(F.array_distinct("words")).alias("w"))
    # Frequencies over all items, kept for the shards that hold the word.
    df = materialize(each.groupBy("w").agg(F.count(F.lit(1)).alias("df"), F.collect_set("shard").alias("shards")), "frequencies")
    for k in range(n):
        own = {r[0].encode(): r[1] for r in df.filter(F.array_contains("shards", F.lit(k).cast("long"))).select("w", "df").collect()}
        mine = [(r[0], r[1]) for r in words.filter(F.col("shard") == k).select("id", "text").collect()]
        if mine:
            yield ItemIndex(mine, collection=Collection(count, mean, longest, own))


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, item_overlap, question_overlap, answer_overlap): a row for each leak."""
    slim = docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`"))
    id_type, item_type = slim.schema[0].dataType, benchmark.schema[item_id].dataType
    schema = f"{doc_id} {id_type.simpleString()}, {item_id} {item_type.simpleString()}, score double, item_overlap double, question_overlap double, answer_overlap double"
    out = slim.limit(0).select(doc_id, F.lit(None).cast(item_type).alias(item_id), *[F.lit(0.0).alias(c) for c in ("score", "item_overlap", "question_overlap", "answer_overlap")])
    first = True
    for index in shards(benchmark, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def work(batches, shared=shared):
            for b in slices(batches):
                rows = [(i, k, v) for i, hits in zip(b.column(0).to_pylist(), shared.value.search(b.column(1).to_pylist())) for k, v in hits.items()]
                cols = [pa.array([r[0] for r in rows], b.schema[0].type), pa.array([shared.value.ids[r[1]] for r in rows])]
                if rows:
                    yield pa.RecordBatch.from_arrays([*cols, *[pa.array([r[2][k] for r in rows], pa.float64()) for k in range(4)]], [doc_id, item_id, "score", "item_overlap", "question_overlap", "answer_overlap"])

        hits = slim.mapInArrow(work, schema)
        out, first = hits if first else out.unionByName(hits), False
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the documents in which a benchmark item leaks."""
    at = docs.columns.index(text)
    for index in shards(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def work(batches, shared=shared):
            for b in slices(batches):
                yield b.filter(pa.array([not hits for hits in shared.value.search(b.column(at).to_pylist())], pa.bool_()))

        docs = docs.mapInArrow(work, docs.schema)
    return docs


def op4_decontaminate(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage_decontaminate(spark, docs, sf_dir):
    """Documents in which no benchmark item leaks; all columns of ``docs``."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
