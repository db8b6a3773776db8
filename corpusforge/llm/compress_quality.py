"""Quality classifier by compression.

Two zstandard dictionaries are built, one from good and one from bad labelled texts.
A text's bytes are compressed with each; the difference of the two sizes over their
sum, which is all that a score depends on, is calibrated to a probability by logistic
regression on labelled texts that went into neither dictionary, so scores rise with it.

Training takes at most ``SAMPLE_DOCS`` labelled documents of each class and use
(dictionary, calibration), those with the smallest hashes of their ids, in that order
until ``SAMPLE_CHARS`` characters of each are reached; these bounds are the only ones.
Every document is scored whole. Labels, language, source and id are no inputs of a score.

Defined results: null and empty texts are scored as the empty text, whose difference
is zero; texts with one difference get one score; of labels that contradict each other
for one id the bad one counts; a null id is scored but never trained on; repeated rows get equal scores;
with no labels of a class every score is the share of good labels (0.5 without any);
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

FOLDS, HELD, CUT = 4, 2, 0.7
SAMPLE_DOCS, SAMPLE_CHARS, DICT_BYTES, LEVEL = 1500, 12_000_000, 112_640, 3


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD


class Sizes:
    """Compressed sizes of a text with the good and the bad dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        self.dicts = good, bad
        self._made = None

    def __getstate__(self):
        return {"dicts": self.dicts, "_made": None}

    def difference(self, text: str | None) -> float:
        """By how much the text compresses better with the good dictionary, between -1 and 1."""
        if self._made is None:
            self._made = [zstandard.ZstdCompressor(LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in self.dicts]
        raw = (text or "").encode()
        if not raw:
            return 0.0
        good, bad = (len(c.compress(raw)) for c in self._made)
        return (bad - good) / (bad + good)


def inputs(differences) -> np.ndarray:
    """Inputs of the calibration: a constant and the difference."""
    return np.column_stack((np.ones(len(differences)), differences))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 100) -> np.ndarray:
    """Ridge logistic regression by damped Newton steps on standardised columns; the first column is the constant."""
    mean, sd = x.mean(0), x.std(0)
    mean[0], sd[sd == 0] = 0.0, 1.0
    sd[0] = 1.0
    z = (x - mean) / sd
    penalty = np.full(z.shape[1], ridge)
    penalty[0] = 1e-6

    def loss(w):
        m = z @ w
        return (np.logaddexp(0, m) - y * m).sum() + 0.5 * (penalty * w * w).sum()

    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) + penalty * w
        move = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), g)
        t = 1.0
        while loss(w - t * move) > loss(w) and t > 1e-6:
            t /= 2
        w = w - t * move
        if np.abs(t * move).max() < 1e-8:
            break
    w = w / sd
    w[0] -= (w[1:] * mean[1:]).sum()
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[list[tuple[str, int]], float | None]:
    """(text, quality) of ``per_class`` labelled documents of each class, by the smallest hashes of their ids; the share of good labels.

    A bounded number of ids is chosen first; only their texts are then read, and
    collected if they fit ``SAMPLE_CHARS`` for each class and use.
    """
    train = labels.filter(F.col("quality").isin(0, 1) & (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) != HELD))
    train = train.select("doc_id", "quality", F.xxhash64("doc_id").alias("h"))
    counts = dict(train.groupBy("quality").count().collect())
    chosen = [(r[0], r[1], q) for q in sorted(counts) for r in train.filter(F.col("quality") == q).select("h", "doc_id").distinct().orderBy("h", "doc_id").limit(per_class).collect()]
    of: dict = {}
    for q, i in sorted((q, i) for _, i, q in chosen):
        of.setdefault(i, q)
    of = {i: of[i] for _, i, q in sorted(chosen) if of[i] == q}
    if not of:
        return [], None
    schema = T.StructType([labels.schema["doc_id"], T.StructField("pos", T.IntegerType())])
    ids = docs.sparkSession.createDataFrame([(i, k) for k, i in enumerate(of)], schema)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").withColumn("n", F.coalesce(F.length("text"), F.lit(0)))
    # One row for each chosen id, however often it is repeated.
    rows = rows.groupBy("doc_id", "pos").agg(F.min(F.struct("n", "text")).alias("t")).select("doc_id", "pos", F.col("t.text").alias("text"), F.col("t.n").alias("n"))
    # As many texts of each class go before any text, so both come from the same share of the ids.
    before = F.coalesce(F.sum("n").over(W.orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("before", before).filter(F.col("before") < 4 * SAMPLE_CHARS)
    found = {r[0]: r[1] for r in rows.select("doc_id", "text").collect()}
    return [(found[i] or "", q) for i, q in of.items() if i in found], counts.get(1, 0) / sum(counts.values())


def make_dictionary(texts: list[str]) -> bytes:
    """A zstandard dictionary trained on the texts, cut into samples of one to two kB; raw text where they are too few."""
    samples = []
    for t in texts:
        raw = t.encode()
        n = max(1, len(raw) // 1024)
        samples += [raw[len(raw) * k // n : len(raw) * (k + 1) // n] for k in range(n)]
    samples = [x for x in samples if len(x) >= 8]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return (b"\n".join(samples)[-DICT_BYTES:]).ljust(8, b" ")


class Model:
    """Dictionaries and calibration from a sample with as many texts of each class, brought back to the labels' share of good."""

    def __init__(self, sample: list[tuple[str, int]], share: float | None = None):
        self.sizes, self.weights = None, None
        self.prior = 0.5 if share is None else share
        use: dict[tuple[int, int], list[str]] = {(q, k): [] for q in (0, 1) for k in (0, 1)}
        for q in (0, 1):
            for n, t in enumerate(t for t, own in sample if own == q):
                kept = use[q, n % 2]
                if sum(map(len, kept)) < SAMPLE_CHARS:
                    kept.append(t)
        if all(use.values()):
            self.sizes = Sizes(make_dictionary(use[1, 0]), make_dictionary(use[0, 0]))
            x = inputs([self.sizes.difference(t) for q in (0, 1) for t in use[q, 1]])
            own = np.concatenate((np.zeros(len(use[0, 1])), np.ones(len(use[1, 1]))))
            self.weights = fit_logistic(x, own)
            sampled = len(use[1, 1]) / len(own)
            self.weights[0] += np.log(self.prior / (1 - self.prior)) - np.log(sampled / (1 - sampled))

    def score(self, texts) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.prior)
        if not len(texts):
            return np.zeros(0)
        x = inputs([self.sizes.difference(t) for t in texts])
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def score_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", per_class: int = 2 * SAMPLE_DOCS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``."""
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(Model(*labelled_sample(slim, labels, per_class)))

    def work(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.value.score(b.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    scored = slim.mapInArrow(work, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, score double")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == HELD, F.lit(False))
    return scored.select(F.col("doc_id").alias(doc_id), held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op8_quality_classifier(spark, sf_dir):
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
