"""What the operators share: sessions, work folders, byte slices of Arrow batches."""

import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parent.parent
#: What a worker remembers only for speed and can fill again.
MEMOS: list[dict] = []


def ship(spark: SparkSession) -> None:
    """Give the executors this package: they need not see the driver's folders."""
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="tidemark"), "tidemark_llm.zip")
    with zipfile.ZipFile(path, "w") as z:
        # All of it: a second archive of the package would hide what the first one lacks.
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, f"tidemark/{f.relative_to(PACKAGE)}")
    sc.addPyFile(path)
    sc._tidemark_shipped = True
    # Rows can be long texts, so that few of them make a batch.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))


def work_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one where none is set and all run on one machine, as in tests."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not folder:
        folder = tempfile.mkdtemp(prefix="tidemark-shared")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again; this cuts the lineage."""
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def settled(spark: SparkSession) -> None:
    """Shuffle files go once nothing refers to them: collect now, so that those of finished steps don't add up."""
    spark.range(1).groupBy("id").count().collect()  # Spark holds on to what it ran last
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def dropped(*tables: DataFrame) -> None:
    """Delete the files of stored() tables, or of what reads only such, that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tidy(run):
    """run over batches; then its worker gives free memory back, as it may idle beside those of later stages."""

    def tidied(batches):
        yield from run(batches)
        release()

    return tidied


def release() -> None:
    import ctypes

    import pyarrow as pa

    for memo in MEMOS:
        memo.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def slices(batch, column: str = "text", limit: int = 16 << 20):
    """Cut an Arrow batch so that the texts of a piece hold about `limit` bytes; a longer text stands alone."""
    import pyarrow.compute as pc

    n = batch.num_rows
    if n == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i in range(n):
        if i > start and held + sizes[i] > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(sizes[i])
    yield batch.slice(start)
