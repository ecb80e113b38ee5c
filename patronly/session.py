"""Session settings every job relies on, and the shared materialisation point."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Calendar parts and whole-day gaps are defined on UTC wall-clock time.
REQUIRED = {"spark.sql.session.timeZone": "UTC"}

# Runtime re-planning: shrink small shuffles, split skewed join partitions even
# where a later aggregate then needs one more exchange.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

# What goes to a Python worker at once: whole texts may be long, workers small.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


_SHIPPED: set[str] = set()  # applications that have the package


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings results and skew handling depend on to a given session, and let
    its Python workers import this package wherever they were started."""
    ship_package(spark)
    for key, value in {**REQUIRED, **ADAPTIVE, **BATCHES}.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send the package's source (about 0.1 MB) to the executors, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = os.path.dirname(os.path.abspath(__file__))
        folder = os.path.realpath(tempfile.mkdtemp(prefix="patronly-"))
        place = spark._jvm.org.apache.hadoop.fs.Path(f"file://{folder}")
        place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)  # served from there until then
        context.addPyFile(shutil.make_archive(os.path.join(folder, "patronly"), "zip", os.path.dirname(package), os.path.basename(package)))
        _SHIPPED.add(context.applicationId)


def local_session(cores: int | str = 8, app: str = "patronly", memory: str = "8g") -> SparkSession:
    """A session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = prepare(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A new folder for intermediate tables, in the place the cluster names in
    ``spark.checkpoint.dir``.

    Where none is set, a local session (tests, one machine) uses a scratch folder;
    a cluster is refused, since its executors would each write to a disk of their own.
    The folder goes when the application ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.gettempdir()
    path = f"{base.rstrip('/')}/run-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and go on from it.

    Used in front of iterative and many-branched work: every later pass reads only
    its columns of the table instead of recomputing joins, and a lost executor
    costs only a reread.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
