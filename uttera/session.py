"""Session settings and the shared folder in which long lineages are cut."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and single machines; on a cluster use the one that is there."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName("uttera")
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    for k, v in (settings | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, which a count of no more than these tells; else as it is, for Spark to join by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("merge")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors share; where it is unset and the master is local (tests), a folder of this process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="uttera-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


_within: list[list[str]] = []


@contextlib.contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables staged within; for long sessions, around what is written or collected inside."""
    _within.append([])
    try:
        yield
    finally:
        for path in _within.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stage(df: DataFrame) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back.

    Cuts the lineage like ``checkpoint()`` but keeps the table columnar and
    compressed, so that later steps read only the columns they need; a lost
    executor costs nothing, for the files are in shared storage.  The table goes
    with the driver, or earlier with :func:`staging`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/uttera-{uuid.uuid4().hex}"
    if _within:
        _within[-1].append(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)  # with the driver, whose results may read it until then
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
