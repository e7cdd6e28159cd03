import pyarrow as pa
from pyspark.sql import functions as F

from quarry import ship
from quarry.operators import chunking, symbols


def test_texts_pass_to_workers_in_small_batches(spark):
    def sizes(frames):
        for frame in frames:
            yield pa.RecordBatch.from_pydict({"n": pa.array([frame.num_rows], pa.int64())})

    rows = spark.range(3000).coalesce(1).select("id", F.lit("def f():\n    return 'long enough to be kept as a chunk'\n").alias("text"))
    for make in (lambda: chunking.chunk_texts(rows, F.lit("python"), F.col("text")), lambda: symbols.extracted(rows, F.col("text"), F.lit("python"))):
        spark.conf.unset(ship.BATCH_KEY)
        assert make().count() == 3000
        assert rows.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] <= ship.BATCH_ROWS


def test_a_number_that_the_session_was_given_stays(spark):
    spark.conf.set(ship.BATCH_KEY, "700")
    ship.small_batches(spark)
    assert spark.conf.get(ship.BATCH_KEY) == "700"
    spark.conf.unset(ship.BATCH_KEY)
