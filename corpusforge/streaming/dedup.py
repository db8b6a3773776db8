"""Dedup of a stream of records: exact as a streaming operator, near through a persisted signature table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.functions.text import normalize_native
from corpusforge.operators.exact import signature
from corpusforge.operators.minhash import BANDS, NUM_PERM, THRESHOLD, band_keys, near_dedup, similarity, with_signatures
from corpusforge.session import materialize


def read_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.format(fmt).schema(schema)
    return (r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r).load(path)


def exact_stream(stream: DataFrame, text: str = "text", level: str = "normalized", event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """First arrivals of each signature. With ``event_time``, state is bounded: copies are caught within ``delay``."""
    x = stream.withColumn("signature", signature(normalize_native(F.col(text)), level))
    if event_time is None:
        return x.dropDuplicates(["signature"])
    return x.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["signature"])


def counts_by_window(stream: DataFrame, event_time: str, width: str = "10 minutes", delay: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Arrivals in each window of event time, tumbling or sliding; late rows beyond ``delay`` are left out."""
    w = F.window(event_time, width, slide) if slide else F.window(event_time, width)
    return stream.withWatermark(event_time, delay).groupBy(w).agg(F.count(F.lit(1)).alias("n"))


class NearIndex:
    """Signatures and band keys of what was kept, as Parquet tables, so that a run can go on where the last ended.

    ``absorb`` takes one micro-batch: documents near something kept before are dropped,
    the rest is deduplicated among itself in input order, and what stays is appended.
    A batch number is a partition written by overwrite, so a replayed batch changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, threshold: float = THRESHOLD, num_perm: int = NUM_PERM, bands: int = BANDS):
        self.spark, self.path, self.threshold, self.num_perm, self.bands = spark, path.rstrip("/"), threshold, num_perm, bands

    def _table(self, name: str, batch: int) -> DataFrame | None:
        fs_path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        fs = fs_path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        return self.spark.read.parquet(f"{self.path}/{name}").filter(F.col("batch") < batch) if fs.exists(fs_path) else None

    def absorb(self, docs: DataFrame, batch: int) -> DataFrame:
        """The documents (ord, text) of this batch that stay."""
        signed = materialize(with_signatures(docs, num_perm=self.num_perm), "batch")
        keys, old = self._table("keys", batch), self._table("signatures", batch)
        fresh = signed
        if keys is not None:
            mine = band_keys(signed, num_perm=self.num_perm, bands=self.bands)
            pairs = mine.join(keys.select("band", "band_key", F.col("ord").alias("old")), ["band", "band_key"]).select("ord", "old").distinct()
            hit = pairs.join(signed.select("ord", "signature"), "ord").join(old.select(F.col("ord").alias("old"), F.col("signature").alias("of")), "old")
            fresh = signed.join(hit.filter(similarity(F.col("signature"), F.col("of")) >= self.threshold).select("ord").distinct(), "ord", "left_anti")
        stay = near_dedup(fresh, threshold=self.threshold, num_perm=self.num_perm, bands=self.bands).filter("NOT is_duplicate").select("ord")
        kept = materialize(fresh.join(stay, "ord", "left_semi"), "kept")
        band_keys(kept, num_perm=self.num_perm, bands=self.bands).write.mode("overwrite").parquet(f"{self.path}/keys/batch={batch}")
        kept.select("ord", "signature").write.mode("overwrite").parquet(f"{self.path}/signatures/batch={batch}")
        return kept.drop("signature")


def near_stream(stream: DataFrame, index: NearIndex, out: str, checkpoint: str):
    """Starts the stream (ord, text): every micro-batch goes through ``index``; what stays is written by batch."""

    def each(docs: DataFrame, batch: int) -> None:
        index.absorb(docs, batch).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
