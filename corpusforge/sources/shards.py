"""Fixed-size shards with a manifest, JSONL or Parquet, on any file system that Spark can write.

Shards are exact: shard k holds records k*size to (k+1)*size - 1 in input order. Record
numbers come from counts by range, so no task sees all rows. Spark's own writers put one
file for each shard into a staging folder, so tasks can be lost and run again; the driver
then only renames files. The manifest is written last: a folder with a manifest is complete.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusforge.session import materialize

SHARD_SIZE = 10_000
#: Files that are moved at once, and those that a task writes, about.
MOVES, TASK_FILES = 16, 64
MANIFEST = "manifest.json"


def shard_name(prefix: str, index: int, ext: str) -> str:
    return f"{prefix}-{index:05d}.{ext}"


class Folder:
    """Files of one folder, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self.path_class = self.jvm.org.apache.hadoop.fs.Path  # each name on the way to it is a call to the JVM
        self.fs = self._path("").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _path(self, name: str):
        return self.path_class(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def size(self, name: str) -> int:
        return self.fs.getFileStatus(self._path(name)).getLen()

    def names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self._path(folder))]

    def files(self, pattern: str) -> list[tuple[str, int]]:
        """(path, bytes) of what fits a glob pattern, in one call."""
        found = self.fs.globStatus(self._path(pattern)) or []
        return [("/".join(f.getPath().toString().split("/")[-pattern.count("/") - 1 :]), f.getLen()) for f in found]

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def move(self, name: str, to: str) -> None:
        if not self.fs.rename(self._path(name), self._path(to)):
            raise OSError(f"could not move {name} to {to} in {self.root}")

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        self.fs.mkdirs(self._path(""))
        stream = self.fs.create(self._path(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()


def with_positions(df: DataFrame, ord_: str = "ord", buckets: int = 256) -> DataFrame:
    """Adds ``position``, 0-based by ``ord_``, with a window for each range of it and not one for all rows."""
    x = materialize(df, "numbered")
    lo, hi = x.agg(F.min(ord_), F.max(ord_)).first()
    width = max(1, -(-((hi or 0) - (lo or 0) + 1) // buckets))
    x = x.withColumn("__b", F.floor((F.col(ord_) - F.lit(lo or 0)) / width).cast("int"))
    ahead = x.groupBy("__b").count().withColumn("__ahead", F.coalesce(F.sum("count").over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    x = x.join(ahead.select("__b", "__ahead"), "__b")
    inside = F.row_number().over(W.partitionBy("__b").orderBy(ord_)) - 1
    return x.withColumn("position", (F.col("__ahead") + inside).cast("long")).drop("__b", "__ahead")


def assign_shards(df: DataFrame, shard_size: int = SHARD_SIZE, ord_: str = "ord") -> DataFrame:
    """Adds ``position`` and ``shard``."""
    if shard_size < 1:
        raise ValueError("shard_size must be 1 or more")
    return with_positions(df, ord_).withColumn("shard", F.floor(F.col("position") / shard_size).cast("int"))


def _write(placed: DataFrame, cols: list, fmt: str, out_dir: str, prefix: str, ext: str, shard_size: int, **more) -> dict:
    """Writes ``cols`` of placed rows, a file for each shard; returns the manifest."""
    spark = placed.sparkSession
    out, stage = Folder(spark, out_dir), "_staging"
    out.delete(MANIFEST)
    # A number, as Spark else gathers small rows in one task, which writes all shards one by one.
    total = placed.count()
    files = -(-total // shard_size)
    tasks = max(1, min(files, 2 * spark.sparkContext.defaultParallelism), -(-files // TASK_FILES))
    dealt = placed.select("shard", "position", *cols).repartition(tasks, "shard").sortWithinPartitions("shard", "position").drop("position")
    writer = dealt.write.mode("overwrite").partitionBy("shard")
    for k, v in more.items():
        writer = writer.option(k, v)
    # Tasks move their own files to the staging folder; nobody reads it before all have.
    writer = writer.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    writer.format(fmt).save(f"{out.root}/{stage}")
    found = sorted((int(path.split("shard=")[-1].split("/")[0]), path, size) for path, size in out.files(f"{stage}/shard=*/part-*"))
    if len({k for k, _, _ in found}) < len(found):
        raise OSError(f"a shard has two files in {out.root}/{stage}")
    there = set(out.names(""))

    def put(item):
        k, path, size = item
        name = shard_name(prefix, k, ext)
        if name in there:
            out.delete(name)
        out.move(path, name)
        return {"path": name, "records": min(shard_size, total - k * shard_size), "bytes": size}

    # A move is a call to the file system, so many wait at once.
    with ThreadPoolExecutor(MOVES) as pool:
        shards = list(pool.map(put, found))
    out.delete(stage)
    manifest = {"format": ext, **({"compression": more["compression"]} if ext == "parquet" else {}), "total_records": total, "shard_count": len(shards), "shard_size": shard_size, "shards": shards}
    out.write(MANIFEST, json.dumps(manifest, indent=2) + "\n")
    return manifest


def write_jsonl_shards(df: DataFrame, out_dir: str, shard_size: int = SHARD_SIZE, prefix: str = "shard", compress: bool = True, ord_: str = "ord", line: str | None = None) -> dict:
    """Writes the rows of ``df`` in order of ``ord_``; returns the manifest. ``line``: a column that is JSON already."""
    placed = assign_shards(df, shard_size, ord_)
    keep = [c for c in df.columns if c != ord_]
    text = F.col(line) if line else F.to_json(F.struct(*keep), {"ignoreNullFields": "false"})
    return _write(placed, [text.alias("line")], "text", out_dir, prefix, "jsonl.gz" if compress else "jsonl", shard_size, compression="gzip" if compress else "none")


def write_parquet_shards(df: DataFrame, out_dir: str, shard_size: int = SHARD_SIZE, prefix: str = "shard", compression: str = "zstd", ord_: str = "ord") -> dict:
    """Parquet shards of one fixed schema; returns the manifest."""
    placed = assign_shards(df, shard_size, ord_)
    return _write(placed, [c for c in df.columns if c != ord_], "parquet", out_dir, prefix, "parquet", shard_size, compression=compression)


def read_manifest(spark: SparkSession, out_dir: str) -> dict:
    """The manifest; an error if there is none, or if a shard that it lists is missing."""
    folder = Folder(spark, out_dir)
    if not folder.exists(MANIFEST):
        raise FileNotFoundError(f"{out_dir} has no {MANIFEST}")
    manifest = json.loads(folder.read(MANIFEST))
    for s in manifest["shards"]:
        if not folder.exists(s["path"]):
            raise FileNotFoundError(f"{s['path']} is in the manifest but missing")
    return manifest


def read_shards(spark: SparkSession, out_dir: str) -> DataFrame:
    """(position, value): JSON lines in shard order, by the manifest and not by what files there are. Blank lines are left out."""
    shards = read_manifest(spark, out_dir)["shards"]
    if not shards:
        return spark.createDataFrame([], "position long, value string")
    starts, at = [], 0
    for s in shards:
        starts.append((s["path"], at))
        at += s["records"]
    lines = spark.read.text([f"{out_dir.rstrip('/')}/{s['path']}" for s in shards])
    lines = lines.select("value", F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    lines = lines.filter(F.length(F.btrim("value")) > 0)
    # Rows of a block keep their order within its task; the window covers one shard.
    nth = F.row_number().over(W.partitionBy("name").orderBy("block", "row")) - 1
    first = spark.createDataFrame(starts, "name string, start long")
    return lines.join(first, "name").select((F.col("start") + nth).cast("long").alias("position"), F.btrim("value").alias("value"))
