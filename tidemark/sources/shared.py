"""What driver and executors share: this package, and tables between steps."""

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Give the executors this package: they need not see the driver's folders."""
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_package", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="tidemark"), "tidemark_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, f"tidemark/{f.relative_to(PACKAGE)}")
    sc.addPyFile(path)
    sc._tidemark_package = True


def folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where that is unset, as in tests on one machine, a temporary folder."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith(("local[", "local")) or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tidemark-shared")
        sc.setCheckpointDir(found)
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table and read again: what follows does not depend on the executors that made it."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def dealt(df: DataFrame, each: int) -> DataFrame:
    """df in parts of about `each` rows, at least one for each core: a task stays as small when the table grows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = max(cores, -(-df.count() // each))
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df


def apart(df: DataFrame) -> DataFrame:
    """df as a side of a join that is never broadcast: what Spark takes for its size comes from far smaller files."""
    return df.hint("merge")


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def dropped(*frames: DataFrame) -> None:
    """Delete stored() tables that nothing reads any more."""
    for df in frames:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            delete(df.sparkSession, path)
