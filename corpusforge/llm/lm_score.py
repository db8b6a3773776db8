"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

Counts of all words and word pairs of the training texts are quantised to levels
about sqrt(2) apart. An n-gram of level q goes into a Bloom filter q times, as
(n-gram, 1) to (n-gram, q); its count is read back by probing 1, 2, ... until a
probe fails. The model interpolates: LAMBDA times the pair's share of its history,
the rest the word's smoothed share of the corpus, both read from the filter.

The filter is made of segments by the n-gram's hash, each with a size by its own number
of entries, so the filter grows with the corpus and keeps ``BITS`` bits an entry at every
size. It is never in one place: texts are taken in chunks of ``CHUNK`` bytes, and a chunk
sends each of its distinct n-grams once, with its count in the chunk's training texts, to
the task that has the segment. That task adds up the counts, builds the segments, probes
them and sends level and exact count back to the chunk, where the texts are scored. A row
is all that a chunk and a task exchange, so the work of a task is a few array operations
however many chunks there are, and what is sent is in proportion to the texts.

A chunk is the same rows whenever it is read: it is cut from a scan of files, or from a
written copy of ``docs`` where these are anything else. Words are hashed to 64 bits throughout.

Defined results: null and empty texts hold one token, the end; a null id is never
held out and never learned from; repeated rows count and are scored as often as they come; without any
training text all counts are zero (log10 of 0.1 / 0.1 for one possible token: 0); an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusforge.session import materialize

FOLDS, HELD = 10, 0
LAMBDA, PROBES, BITS, UNIT = 0.3, 4, 10, 1024
#: Text that a task counts the n-grams of, in bytes, and segments for each such task.
TASK_BYTES, TASK_SEGMENTS, LEAST_SEGMENT_BITS = 10 << 20, 8, 12
#: Bytes of the filter that a task builds and probes at once: a segment at least.
MAX_FILTER_BYTES = 256 << 20
#: Bytes of text in a chunk; words whose hashes are remembered.
CHUNK, CACHE = 6 << 20, 400_000
#: Upper bits of a hash that are sent as counts of hashes for each value.
PREFIX = 16
_END = 0x5EED0F7E97000001
END = np.uint64(_END)
#: Least count of each level.
LEVELS = np.unique(np.floor(2.0 ** (np.arange(0, 126) / 2)).astype(np.int64))
MIDDLE = np.concatenate(([0.0], (LEVELS[:-1] + LEVELS[1:] - 1) / 2, [float(LEVELS[-1])]))


class _Hashes(dict):
    """Word -> 64-bit hash, remembering the first CACHE words."""

    def __missing__(self, w):
        h = xxhash.xxh64_intdigest(w, 7)
        if len(self) < CACHE:
            self[w] = h
        return h


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pairs(tokens: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """History (END at a text's start) and hash of each token's pair."""
    history = np.empty_like(tokens)
    history[1:] = tokens[:-1]
    history[np.cumsum(lengths) - lengths] = END
    return history, mix(history * np.uint64(0x9E3779B97F4A7C15) + tokens)


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD


def trained(doc_id) -> bool:
    return doc_id is not None and not held_out(doc_id)


def cut(batches):
    """(key, rows) of chunks in order: rows of (id, text, partition) up to CHUNK bytes of text, an empty one counted as 8."""
    n, size = 0, 0
    for b in batches:
        if b.num_rows:
            part = b.column(2)[0].as_py() << 32
        sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
        first = 0
        for k in range(b.num_rows):
            size += int(sizes[k]) + 8
            if size >= CHUNK:
                yield part | n, b.slice(first, k + 1 - first)
                n, size, first = n + 1, 0, k + 1
        if first < b.num_rows:
            yield part | n, b.slice(first)


def hashed(texts, of: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of the texts end to end, and the number of each one's tokens; each text ends in END."""
    tokens, lengths = [], []
    for t in texts:
        words = (t or "").encode().lower().split()
        tokens += map(of.__getitem__, words)
        tokens.append(_END)
        lengths.append(len(words) + 1)
    return np.array(tokens, np.uint64), np.array(lengths, np.int64)


def binaries(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Rows of bytes: the next ``counts`` items of ``data`` each."""
    ends = np.concatenate(([0], np.cumsum(counts))) * (data.nbytes // max(1, len(data)))
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def flat(column: pa.Array, kind=np.uint8) -> np.ndarray:
    """The items of all rows of bytes, end to end."""
    if not len(column):
        return np.zeros(0, kind)
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data[int(ends[0]) : int(ends[-1])], kind) if ends[-1] > ends[0] else np.zeros(0, kind)


def build_segment(h: np.ndarray, c: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Bloom filter bytes of the n-grams of one segment."""
    level = np.searchsorted(LEVELS, c, "right")
    size = UNIT * max(1, -(-int(level.sum()) * bits // UNIT))
    out = np.zeros(size, bool)
    i = 1
    while len(h):
        for at in positions(h, i, np.uint64(size)):
            out[at] = True
        i += 1
        more = level >= i
        h, level = h[more], level[more]
    return np.packbits(out, bitorder="little")


def positions(h: np.ndarray, i: int, size):
    a = mix(h + np.uint64(i * 0xD6E8FEB86659FD93 % 2**64))
    step = mix(a) | np.uint64(1)
    for _ in range(PROBES):
        yield a % size
        a = a + step


def probe(data: np.ndarray, offset: np.ndarray, size: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Levels of the n-grams ``h``: probes go on while they succeed. ``offset``, ``size``: of each one's segment."""
    level = np.zeros(len(h), np.uint8)
    alive = np.arange(len(h))
    i = 1
    while len(alive) and i < len(MIDDLE):
        own, start = size[alive], offset[alive]
        hit = np.ones(len(alive), bool)
        for at in positions(h[alive], i, own):
            hit &= (data[start + (at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
        alive = alive[hit]
        level[alive] = i
        i += 1
    return level


def filter_levels(h: np.ndarray, c: np.ndarray, segment_bits: int) -> np.ndarray:
    """Level of each distinct n-gram, read back from the filter of those with a count above zero."""
    top = np.uint64(64 - segment_bits)
    order = np.argsort(h)
    seg = (h[order] >> top).astype(np.int64)
    starts = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1]))) if len(h) else np.zeros(0, np.int64)
    level = np.zeros(len(h), np.uint8)
    parts, rows, held = [], [], 0
    for k, (x, y) in enumerate(zip(starts, [*starts[1:], len(h)])):
        own = order[x:y]
        known = own[c[own] > 0]
        parts.append(build_segment(h[known], c[known]))
        rows.append(own)
        held += len(parts[-1])
        if held >= MAX_FILTER_BYTES or k + 1 == len(starts):
            sizes, many = np.array([len(p) for p in parts]), [len(r) for r in rows]
            at = np.concatenate(rows)
            level[at] = probe(np.concatenate(parts), np.repeat(np.cumsum(sizes) - sizes, many), np.repeat((8 * sizes).astype(np.uint64), many), h[at])
            parts, rows, held = [], [], 0
    return level


def token_scores(own: np.ndarray, together: np.ndarray, lengths: np.ndarray, whole: float) -> np.ndarray:
    """Score of each text, from the filter's counts of its tokens and of their pairs. A text's last token is END."""
    starts = np.cumsum(lengths) - lengths
    before = np.empty(len(own))
    before[1:] = own[:-1]
    before[starts] = own[starts + lengths - 1]
    share = np.minimum(1.0, together / np.maximum(before, 1.0))
    single = (own + 0.1) / whole
    p = np.where(before > 0, LAMBDA * share + (1 - LAMBDA) * single, single)
    return np.add.reduceat(np.log10(np.minimum(p, 1.0)), starts)


def _asked(slim: DataFrame, group_bits: int) -> DataFrame:
    """A row for each chunk and group of hashes: of its distinct words (w) and pairs (p), how many begin with each prefix,
    their lower 48 bits in order, and their counts in the chunk's training texts."""
    groups, each = 1 << group_bits, 1 << (PREFIX - group_bits)

    def columns(h, train):
        u, inv = np.unique(h, return_inverse=True)
        prefix = np.bincount((u >> np.uint64(64 - PREFIX)).astype(np.int64), minlength=1 << PREFIX).reshape(groups, each)
        n = prefix.sum(axis=1)
        low = np.ascontiguousarray(u.view(np.uint8).reshape(-1, 8)[:, : 8 - PREFIX // 8])
        return [binaries(prefix.astype(np.uint16).ravel(), np.full(groups, each)), binaries(low, n), binaries(np.bincount(inv[train], minlength=len(u)).astype(np.uint32), n)]

    def ask(batches):
        of = _Hashes()
        for at, rows in groupby(cut(batches), lambda x: x[0]):
            rows = pa.Table.from_batches([r for _, r in rows])
            tokens, lengths = hashed(rows.column(1).to_pylist(), of)
            train = np.repeat(np.array([trained(i) for i in rows.column(0).to_pylist()]), lengths)
            key = pa.array(np.full(groups, at))
            yield pa.RecordBatch.from_arrays([key, pa.array(np.arange(groups, dtype=np.int32)), *columns(tokens, train), *columns(pairs(tokens, lengths)[1], train)], ["key", "seg", "wn", "wl", "wc", "pn", "pl", "pc"])

    return slim.mapInArrow(ask, "key long, seg int, wn binary, wl binary, wc binary, pn binary, pl binary, pc binary")


def _answered(asked: DataFrame, group_bits: int, segment_bits: int) -> DataFrame:
    """Levels of what each chunk asked for, exact counts of its words (lower 16 bits, rest); tokens and types of each task once."""
    each = 1 << (PREFIX - group_bits)

    def hashes(b, seg, k):
        counts = flat(b.column(k), np.uint16)
        prefix = np.repeat((seg[:, None] * each + np.arange(each)).ravel(), counts).astype(np.uint64)
        h = np.zeros((len(prefix), 8), np.uint8)
        h[:, : 8 - PREFIX // 8] = flat(b.column(k + 1)).reshape(-1, 8 - PREFIX // 8)
        return h.view(np.uint64).ravel() | prefix << np.uint64(64 - PREFIX), flat(b.column(k + 2), np.uint32), counts.reshape(-1, each).sum(axis=1)

    def answer(batches):
        keys, segs, held = [], [], ([], [])
        for b in batches:
            seg = b.column(1).to_numpy().astype(np.int64)
            keys.append(b.column(0).to_numpy()), segs.append(seg)
            for k in range(2):
                held[k].append(hashes(b, seg, 2 + 3 * k))
        if not keys:
            return
        (w, w_inv, wc, wn), (p, p_inv, pc_, pn) = (total(*map(np.concatenate, zip(*x))) for x in held)
        level = filter_levels(np.concatenate((w, p)), np.concatenate((wc, pc_)), segment_bits)
        key, exact = np.concatenate(keys), wc[w_inv]
        once = np.arange(len(key)) == 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(key), pa.array(np.concatenate(segs).astype(np.int32)), binaries(level[: len(w)][w_inv], wn), binaries((exact & 0xFFFF).astype(np.uint16), wn), binaries(exact >> 16, wn), binaries(level[len(w) :][p_inv], pn), pa.array(once * int(wc.sum())), pa.array(once * int((wc > 0).sum()))],
            ["key", "seg", "word", "low", "high", "pair", "tokens", "types"],
        )

    def total(h, c, n):
        u, inv = np.unique(h, return_inverse=True)
        return u, inv, np.bincount(inv, c, len(u)).astype(np.int64), n

    # A group is one partition.
    return asked.repartitionById(1 << group_bits, "seg").mapInArrow(answer, "key long, seg int, word binary, low binary, high binary, pair binary, tokens long, types long")


def _settled(slim: DataFrame, said: DataFrame, whole: float) -> DataFrame:
    """(id, n_tokens, n_known, base, score) of each text, from the answers to its chunk."""
    id_type, ids_type = slim.schema["id"].dataType.simpleString(), to_arrow_type(slim.schema["id"].dataType)

    def tag(batches):
        for at, b in cut(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, at)), b.column(0), b.column(1)], ["key", "id", "text"])

    def score(answers, rows, of):
        tokens, lengths = hashed([t for r in rows for t in r.column(7).to_pylist()], of)
        level, low, high, pair = (np.concatenate([flat(a.column(k), t) for a in answers]) for k, t in ((2, np.uint8), (3, np.uint16), (4, np.int64), (5, np.uint8)))
        u, inv = np.unique(tokens, return_inverse=True)
        up, p_inv = np.unique(pairs(tokens, lengths)[1], return_inverse=True)
        if (len(u), len(up)) != (len(level), len(pair)):
            raise RuntimeError("a chunk of documents was not the same when it was read again")
        c = high << 16 | low
        starts = np.cumsum(lengths) - lengths
        base = np.add.reduceat((np.log10(c + 0.1) - np.log10(0.1))[inv], starts) + lengths * np.log10(0.1 / whole)
        found = token_scores(MIDDLE[level][inv], MIDDLE[pair][p_inv], lengths, whole)
        known = np.add.reduceat((c > 0).astype(np.int64)[inv], starts)
        ids = pa.chunked_array([r.column(6) for r in rows], ids_type).combine_chunks()
        return pa.RecordBatch.from_arrays([ids, pa.array(lengths), pa.array(known), pa.array(base), pa.array(found)], ["id", "n_tokens", "n_known", "base", "score"])

    def settle(batches):
        of, now, held = _Hashes(), None, ([], [])
        for b in batches:
            key, kind = b.column(0).to_numpy(), pc.is_valid(b.column(1)).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (kind[1:] != kind[:-1]))))
            for x, y in zip(at, [*at[1:], len(key)]):
                if key[x] != now:
                    if held[1]:
                        yield score(*held, of)
                    now, held = key[x], ([], [])
                held[0 if kind[x] else 1].append(b.slice(x, y - x))
        if held[1]:
            yield score(*held, of)

    none = lambda c, t: F.lit(None).cast(t).alias(c)
    texts = slim.mapInArrow(tag, f"key long, id {id_type}, text string")
    texts = texts.select("key", none("seg", "int"), *[none(c, "binary") for c in ("word", "low", "high", "pair")], "id", "text")
    both = said.select("key", "seg", "word", "low", "high", "pair", none("id", id_type), none("text", "string")).unionByName(texts)
    both = both.repartition("key").sortWithinPartitions("key", F.col("seg").asc_nulls_last())
    return both.mapInArrow(settle, f"id {id_type}, n_tokens long, n_known long, base double, score double")


def score_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs``."""
    slim = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    if re.search(r"Exchange|Python|Arrow|Pandas|Scan (?!parquet)|Sample|rand\(|uuid\(", slim._jdf.queryExecution().executedPlan().toString()):
        slim = materialize(slim, "texts")
    slim = slim.withColumn("part", F.spark_partition_id())
    size = int(slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    tasks = max(int(slim.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    segment_bits = max(LEAST_SEGMENT_BITS, (TASK_SEGMENTS * tasks - 1).bit_length())
    group_bits = min(PREFIX, (tasks - 1).bit_length())
    said = materialize(_answered(_asked(slim, group_bits), group_bits, segment_bits), "answers")
    n_train, n_types = (int(x) for x in said.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first())
    out = _settled(slim, said, n_train + 0.1 * (n_types + 1))
    held = F.coalesce(F.pmod(F.crc32(F.col("id").cast("string")), F.lit(FOLDS)) == HELD, F.lit(False))
    return out.select(F.col("id").alias(doc_id), held.alias("held_out"), "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def op2_lm_score(spark, sf_dir):
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
