import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def docs_of(spark):
    """docs_of([(doc_id, text, lang, source), ...]) with an extra column whose name clashes with inner ones."""

    def make(rows):
        full = [(i, t, la, so, len(t or ""), "x") for i, t, la, so in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, name string")

    return make
