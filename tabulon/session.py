"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Scratch folder of local sessions; it goes when the process ends.
_FOLDER: tempfile.TemporaryDirectory | None = None


def local_session(cores: str | int = "*", name: str = "tabulon", **conf) -> SparkSession:
    """A session for tests and single-node runs; on a cluster the session comes from the submitter."""
    global _FOLDER
    if "spark.checkpoint.dir" not in conf:
        _FOLDER = _FOLDER or tempfile.TemporaryDirectory(prefix="tabulon-", ignore_cleanup_errors=True)
        conf["spark.checkpoint.dir"] = _FOLDER.name
    settings = {
        "spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.sql.dataFrameQueryContext.enabled": "false", "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.host": "127.0.0.1", "spark.driver.bindAddress": "127.0.0.1", **conf,
    }
    b = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder of `spark.checkpoint.dir`, which driver and executors share.

    Only a session that runs in this one process may do without that setting; it then gets a temporary folder, once.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tabulon-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


# Partitions of a shuffle that go to one file.
FILE_PARTS = 32


def few_parts(df: DataFrame, per_core: int) -> DataFrame:
    """A frame that comes from a shuffle, in at most `per_core` parts a core, or as many for FILE_PARTS partitions."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.coalesce(max(per_core * spark.sparkContext.defaultParallelism, -(-parts * per_core // FILE_PARTS)))


def staged(df: DataFrame, label: str = "stage", rows: int | None = None, per_core: int | None = None) -> DataFrame:
    """Write a frame to the shared scratch folder and read it back.

    Later steps then start from columnar files instead of repeating the work, with a plan that is short, a size that
    Catalyst knows, and nothing to recompute when an executor is lost. Columnar files are small for the work that their
    rows may be; with `rows`, a file holds no more of them, so that all cores get some whatever their bytes. A frame that
    comes from a shuffle may have far more partitions than its bytes are worth; with `per_core`, tasks write several of
    them to one file (`few_parts`). On a local file system each file costs processes (chmod) forked by the executor.
    """
    path = scratch(df.sparkSession, label)
    df = few_parts(df, per_core) if per_core else df
    (df.write.option("maxRecordsPerFile", rows) if rows else df.write).parquet(path)
    return df.sparkSession.read.parquet(path)
