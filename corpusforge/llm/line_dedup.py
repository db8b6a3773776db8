"""Line dedup by distinct-site spread.

A HyperLogLog sketch of the sites for each line hash, merged by aggregation, tells
on how many sites a line stands. Lines near the threshold get exact distinct counts.
Lines on ``min_sites`` sites or more are boilerplate: they stay where they come
first, in the document with the smallest id, and go everywhere else.

The lines found go to the executors if there are at most ``BROADCAST_LINES`` (16
bytes each, counted before); beyond that, documents meet their own boilerplate lines in
a join. Both ways give the same rows.

Lines are compared without ASCII space around them; blank ones are no lines and stay.

Defined results: a null text stays null and has no lines; a null source is no site;
a null id owns a line only if all its documents have null ids; repeated rows get the
same result each; an empty table gives an empty result; all other columns are kept.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusforge.session import materialize, slices

SPACE = " \t\n\x0b\x0c\r"
MIN_SITES, LG_K, NEAR, BROADCAST_LINES = 8, 12, 0.15, 500_000


def lines_of(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """(__id, __text, __site, __line): a row for each line with a word; ``__text`` is the hash of the whole text."""
    lines = F.filter(F.transform(F.split(F.col(f"`{text}`"), "\n", -1), lambda x: F.btrim(x, F.lit(SPACE))), lambda x: x != "")
    x = docs.select(F.col(f"`{doc_id}`").alias("__id"), F.xxhash64(F.col(f"`{text}`")).alias("__text"), F.col(f"`{source}`").cast("string").alias("__site"), F.explode(lines).alias("__l"))
    return x.select("__id", "__text", "__site", F.xxhash64("__l").alias("__line"))


def boilerplate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", min_sites: int = MIN_SITES) -> tuple[DataFrame, DataFrame]:
    """(__line, __owner) of the lines on ``min_sites`` distinct sites or more, and all lines."""
    lines = materialize(lines_of(docs, doc_id, text, source), "lines")
    spread = lines.groupBy("__line").agg(F.hll_sketch_agg("__site", LG_K).alias("h"), F.min("__id").alias("__owner"))
    spread = spread.select("__line", "__owner", F.hll_sketch_estimate("h").alias("sites")).filter(F.col("sites") >= min_sites * (1 - NEAR))
    spread = materialize(spread, "spread")
    sure = spread.filter(F.col("sites") > min_sites * (1 + NEAR))
    near = spread.filter(F.col("sites") <= min_sites * (1 + NEAR)).select("__line", "__owner")
    exact = lines.join(near.select("__line"), "__line", "left_semi").groupBy("__line").agg(F.count_distinct("__site").alias("n"))
    near = near.join(exact.filter(F.col("n") >= min_sites).select("__line"), "__line", "left_semi")
    return materialize(sure.select("__line", "__owner").unionByName(near), "boilerplate"), lines


def _clean(t: str | None, gone, once) -> tuple[str | None, int, int]:
    """``t`` without its lines whose hash is in ``gone``, and without all but the first of each in ``once``; its lines, and how many went."""
    if t is None:
        return None, 0, 0
    lines = t.encode().split(b"\n")
    keep, n, seen = [], 0, set()
    for line in lines:
        bare = line.strip(SPACE.encode())
        if bare:
            n += 1
            h = xxhash.xxh64_intdigest(bare, 42)
            h -= (h >> 63) << 64
            if h in seen or gone(h):
                continue
            if once(h):
                seen.add(h)
        keep.append(line)
    left = len(lines) - len(keep)
    return (b"\n".join(keep).decode() if left else t), n, left


def _with_counts(docs: DataFrame, own: list[str], text: str, clean) -> DataFrame:
    """Columns ``own`` of ``docs`` with cleaned texts and the counts; ``clean`` takes a batch and gives what ``_clean`` gives for each row."""
    counts = ["__cf_n_lines", "__cf_n_removed"]
    at = docs.columns.index(text)

    def work(batches):
        for b in slices(batches):
            new, n, gone = zip(*clean(b))
            cols = [pa.array(new, pa.string()) if k == at else b.column(k) for k in range(len(own))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(gone, pa.int64())], [*own, *counts])

    fields = [docs.schema[docs.columns.index(c)] for c in own]
    return docs.mapInArrow(work, T.StructType([*fields, *[T.StructField(c, T.LongType()) for c in counts]]))


def _by_broadcast(docs: DataFrame, found: DataFrame, doc_id: str, text: str) -> DataFrame:
    owner = docs.sparkSession.sparkContext.broadcast({r[0]: r[1] for r in found.collect()})
    n_id, n_text = docs.columns.index(doc_id), docs.columns.index(text)

    def clean(b):
        of = owner.value
        return [_clean(t.as_py(), lambda h, i=i.as_py(): h in of and of[h] != i, of.__contains__) for t, i in zip(b.column(n_text), b.column(n_id))]

    return _with_counts(docs, docs.columns, text, clean)


def _by_join(docs: DataFrame, found: DataFrame, lines: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Documents meet their own boilerplate lines, by id and text hash, so rows without an id are spread by their texts."""
    hit = lines.select("__id", "__text", "__line").distinct().join(found, "__line")
    mine = F.col("__id").eqNullSafe(F.col("__owner"))
    pick = lambda cond: F.collect_list(F.when(cond, F.col("__line")))
    of = hit.groupBy("__id", "__text").agg(pick(~mine).alias("__gone"), pick(mine).alias("__once")).withColumnsRenamed({"__id": "__of", "__text": "__of_text"})
    same = (F.xxhash64(F.col(f"`{text}`")) == F.col("__of_text")) & F.col(f"`{doc_id}`").eqNullSafe(F.col("__of"))
    x = docs.join(of, same, "left").select(*[F.col(f"`{c}`") for c in docs.columns], "__gone", "__once")
    n_text = docs.columns.index(text)

    def clean(b):
        out = []
        for t, gone, once in zip(b.column(n_text), b.column(b.num_columns - 2), b.column(b.num_columns - 1)):
            out.append(_clean(t.as_py(), set(gone.as_py() or ()).__contains__, set(once.as_py() or ()).__contains__))
        return out

    return _with_counts(x, docs.columns, text, clean)


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", min_sites: int = MIN_SITES, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """``docs`` with cleaned ``text``, ``__cf_n_lines`` and ``__cf_n_removed``."""
    found, lines = boilerplate(docs, doc_id, text, source, min_sites)
    if found.count() <= broadcast_lines:
        return _by_broadcast(docs, found, doc_id, text)
    return _by_join(docs, found, lines, doc_id, text)


def op10_line_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return dedup_lines(docs).select("doc_id", F.col("__cf_n_lines").alias("n_lines"), F.col("__cf_n_removed").alias("n_removed"), "text")


def stage_line_dedup(spark, docs, sf_dir):
    """Documents without boilerplate lines; those of which nothing is left go. All columns of ``docs``."""
    x = dedup_lines(docs)
    left = (F.col("__cf_n_removed") == 0) | (F.col("__cf_n_removed") < F.col("__cf_n_lines"))
    return x.filter(left).select(*[F.col(f"`{c}`") for c in docs.columns])


_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE = f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS parts FROM documents
), l AS (
  SELECT r, doc_id, source, raw, n, trim(raw, {_WS}) AS bare
  FROM (SELECT r, doc_id, source, unnest(parts) AS raw, generate_subscripts(parts, 1) AS n FROM d)
), b AS (
  SELECT bare, min(doc_id) AS owner FROM l WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT source) >= {MIN_SITES}
), k AS (
  SELECT l.*, b.bare IS NOT NULL AS found, b.owner, row_number() OVER (PARTITION BY l.r, l.bare ORDER BY n) AS nth FROM l LEFT JOIN b USING (bare)
), j AS (
  SELECT *, found AND (owner IS DISTINCT FROM doc_id OR nth > 1) AS gone FROM k
)
SELECT doc_id, CAST(count(*) FILTER (WHERE bare <> '') AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed,
       coalesce(string_agg(raw, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '') AS text
FROM j GROUP BY r, doc_id
UNION ALL SELECT doc_id, 0, 0, NULL FROM d WHERE text IS NULL
"""
