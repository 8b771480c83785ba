"""Live ingest: event lines to the store of events and cells, idempotent by batch, with its housekeeping between batches."""

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession

from ..operators import cells as cube
from ..operators import routes as R
from ..sources.traffic import parse_lines
from .store import Store


def ingest(spark: SparkSession, source: str, root: str, routes: R.Routes, max_files: int = 1000, compact_after: int = 50, retain_days: int | None = None, today: Callable[[], date] = date.today):
    """A streaming query over text files of events.

    A batch that runs again changes nothing.  No watermark: late events count as well, since
    cells only add up.  Between batches, folders are merged once `compact_after` count, and days
    more than `retain_days` before `today()` are left out, if any is held.
    """
    lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", max_files).text(source)

    def write(batch: DataFrame, number: int) -> None:
        store = Store(batch.sparkSession, root, routes)
        rows = parse_lines(batch)
        rows.where("rejected IS NOT NULL").select("value", "rejected").write.mode("overwrite").parquet(f"{root}/rejected/batch={number}")
        store.append(rows.where("rejected IS NULL").drop("rejected", "value"), f"batch-{number}")
        if retain_days is not None:
            store.retain(today() - timedelta(days=retain_days))
        if len(store.manifest()["cells"]) > compact_after:
            store.compact()

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint")


def live_cells(spark: SparkSession, root: str, routes: R.Routes) -> DataFrame:
    return Store(spark, root, routes).cells()


def replay(spark: SparkSession, root: str, routes: R.Routes, under: R.Routes | None = None) -> DataFrame:
    """Cells of the whole event log matched anew, with `under` as another specification has them."""
    log = Store(spark, root, routes).log().drop("op_key", "day")
    return cube.build_cells(R.resolve(log, under or routes))


