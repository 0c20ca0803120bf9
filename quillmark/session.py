"""Session settings and table access shared by the whole library."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str = "local[8]", app: str = "quillmark", **conf: str) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    b = SparkSession.builder.master(master).appName(app)
    for k, v in (DEFAULTS | {"spark.driver.memory": "12g", "spark.sql.shuffle.partitions": "8"} | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder for files that a query writes: in spark.checkpoint.dir, which all machines share, or of its own for a local session without it. It goes when the driver ends."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = f"file://{tempfile.gettempdir()}"
    path = f"{where.rstrip('/')}/quillmark-{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex}"
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(top)
    return path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path may be in any store that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, f: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """mapInArrow with batches of bounded rows and bytes."""
    return small_batches(df).mapInArrow(f, schema)


def small_batches(df: DataFrame) -> DataFrame:
    """The same rows, which go to Python in batches of bounded rows and bytes from here on in this session, as one text may be very long."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return df


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt anew over four tasks a core, by a hash. A task reads whole row groups, of which a table of well-packed texts has few; work that costs much more than reading needs all cores."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *by)
