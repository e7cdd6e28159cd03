"""Gives this package to the executors, so Python workers can import it wherever they run, and bounds what they are given at a time."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    context = spark.sparkContext
    if getattr(context, "_quarry_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(here):
        folder = tempfile.mkdtemp(prefix="quarry-zip-")
        context.addPyFile(shutil.make_archive(os.path.join(folder, "quarry"), "zip", os.path.dirname(here), "quarry"))
    context._quarry_shipped = True


#: Rows that pass to a worker at a time. A row may be a long text, and its results are held beside it as Python objects.
BATCH_ROWS, BATCH_KEY, SPARKS_OWN = 512, "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def small_batches(spark: SparkSession) -> None:
    """Workers of this session get BATCH_ROWS rows at a time, unless it was given a number other than Spark's own."""
    if spark.conf.get(BATCH_KEY) == SPARKS_OWN:
        spark.conf.set(BATCH_KEY, str(BATCH_ROWS))
