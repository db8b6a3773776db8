"""Crawl records: the schema, and the JSONL scan with strict accounting of bad lines."""

from __future__ import annotations

import json
import sys
import uuid
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusforge.session import shared_dir

RECORD = "url string, text string, html string, title string, language string, crawled_at string, quality string, signatures string, embedding array<double>, meta string"
_FIELDS = ("url", "text", "html", "title", "language", "crawled_at", "quality", "signatures", "embedding", "meta")
_STRINGS = ("text", "html", "title", "language", "crawled_at")


def parse_record(line: str) -> dict | None:
    """Known fields of a record, or None if the line is malformed.

    Malformed: no JSON object, no string url, or a text field that is no string.
    Nested fields are kept as JSON; unknown ones are dropped; of equal keys the last wins.
    """
    try:
        d = json.loads(line)
    except ValueError:
        return None
    if not isinstance(d, dict) or not isinstance(d.get("url"), str):
        return None
    if any(d.get(k) is not None and not isinstance(d[k], str) for k in _STRINGS):
        return None
    e = d.get("embedding")
    if e is not None and not (isinstance(e, list) and all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in e)):
        return None
    out = {k: d.get(k) for k in _FIELDS}
    out["text"] = out["text"] if out["text"] is not None else ""
    out["embedding"] = None if e is None else [float(x) for x in e]
    for k in ("quality", "signatures", "meta"):
        out[k] = json.dumps(out[k] if out[k] is not None else {}, ensure_ascii=False)
    return out


def parse_lines(lines: DataFrame) -> DataFrame:
    """(ord, value) to (ord, malformed, record fields); blank lines go, uncounted."""
    schema = f"ord long, malformed boolean, {RECORD}"

    def work(batches):
        for pdf in batches:
            rows = []
            for ord_, value in zip(pdf["ord"], pdf["value"]):
                line = (value or "").strip()
                if line:
                    rec = parse_record(line)
                    rows.append({"ord": ord_, "malformed": rec is None, **(rec or dict.fromkeys(_FIELDS))})
            if rows:
                yield pd.DataFrame(rows, columns=["ord", "malformed", *_FIELDS])

    return lines.mapInPandas(work, schema)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ord, value): lines of a text file with their 1-based number in the input.

    Files go by path, and the blocks that a file is read in by offset. A block's rows are
    read in turn, so row ids tell the place in the block; only the blocks' sizes are
    summed before the numbers are given, and no line leaves the JVM.
    """
    block = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("offset")]
    rows = spark.read.text(path).select("value", *block, F.monotonically_increasing_id().alias("row"))
    blocks = rows.groupBy("file", "offset").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    ahead = F.sum("n").over(W.orderBy("file", "offset")) - F.col("n")
    return rows.join(blocks.withColumn("ahead", ahead), ["file", "offset"]).select((F.col("ahead") + F.col("row") - F.col("first") + 1).alias("ord"), "value")


def spool(spark: SparkSession, lines) -> str:
    """Lines written to a file in the shared folder, where all executors can read them; its path."""
    path = f"{shared_dir(spark)}/corpusforge/stdin-{uuid.uuid4().hex}.jsonl"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(p)
    for part in iter(lambda: list(islice(lines, 4096)), []):
        out.write("".join(part).encode())
    out.close()
    return path


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSONL file (``-``: standard input) with ``ord`` and ``malformed``."""
    if path == "-":
        path = spool(spark, sys.stdin)
    return parse_lines(numbered_lines(spark, path))


def read_html(spark: SparkSession, path: str) -> DataFrame:
    """(path, html): whole files as UTF-8, undecodable bytes replaced."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    @F.pandas_udf("string")
    def decode(s: pd.Series) -> pd.Series:
        return s.map(lambda b: bytes(b).decode("utf-8", "replace"))

    return files.select("path", decode("content").alias("html"))
