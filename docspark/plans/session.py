"""Sessions, and the package on the executors."""

from __future__ import annotations

import math
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent.parent
#: Rows of a table that one task makes into documents, at most and, where there are cores to spare, at least.
TASK_ROWS, FEW_ROWS = 5_000, 500


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each Spark context; and keep Arrow batches small."""
    # texts are long rows: batches of the default 10,000 hold tens of megabytes in the JVM and in Python at once
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3000")
    context = spark.sparkContext
    if getattr(context, "_docspark_shipped", False):
        return
    archive = Path(tempfile.mkdtemp()) / "docspark-package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(PACKAGE.rglob("*.py")):
            out.write(path, path.relative_to(PACKAGE.parent))
    context.addPyFile(str(archive))
    context._docspark_shipped = True


def spread(df: DataFrame, *keys: str, most: int = TASK_ROWS) -> DataFrame:
    """A table dealt by ``keys`` to tasks of ``most`` rows, or to all cores.

    A file of short rows is one partition however many rows it has, so one task
    would make and read all their documents.  The rows are counted from the
    files' footers, and only columns in use are shuffled.
    """
    rows = df.count()
    tasks = max(math.ceil(rows / most), min(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / FEW_ROWS)))
    return df.repartition(tasks, *keys) if tasks > 1 else df


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The same query, with the package on the executors first."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    run.__name__ = getattr(query, "__name__", "query")
    run.__doc__ = query.__doc__
    return run
