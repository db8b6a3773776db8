"""Session helpers: tables, reliable materialisation of intermediate results, and slices of Arrow batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIRS: dict[str, str] = {}
#: Rows of a batch that a Python worker takes at once.
SLICE_ROWS = 256


def build_session(master: str = "local[*]", app: str = "corpusforge", shuffle_partitions: int = 8, **conf) -> SparkSession:
    """A session with the settings the engine is designed for (AQE on, UTC)."""
    b = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset and all
    runs in one process, as in local tests, a temporary folder takes its place.
    """
    sc = spark.sparkContext
    got = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if got:
        return got.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    key = sc.applicationId
    if key not in _OWN_DIRS:
        _OWN_DIRS[key] = tempfile.mkdtemp(prefix="corpusforge-")
        atexit.register(__import__("shutil").rmtree, _OWN_DIRS[key], True)
    return f"file://{_OWN_DIRS[key]}"


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: the result survives a lost executor, is computed once
    however often it is read, and carries real size statistics for the planner.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusforge/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``tables`` once nothing reads it again."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            if "/corpusforge/" in f:
                p = path(f)
                p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def slices(batches):
    """The rows of Arrow ``batches``, ``SLICE_ROWS`` at a time.

    A batch may be a whole partition of texts; so it is neither decoded nor returned whole.
    """
    for b in batches:
        for k in range(0, b.num_rows, SLICE_ROWS):
            yield b.slice(k, SLICE_ROWS)
