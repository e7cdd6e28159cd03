from pyspark.sql import functions as F

from quarry.llm import mixlm


def test_base_scores_need_no_tables(spark, monkeypatch):
    rows = spark.createDataFrame([(k, f"some words of text {k % 7} and {k}") for k in range(60)] + [(60, None), (None, "x")], "doc_id long, text string")
    whole = mixlm.score_texts(rows)
    wanted = sorted(map(str, whole.drop("score", "bits_per_byte").collect()))
    assert whole.filter(F.col("bits_per_byte") > 0).count() > 0

    def none(*_):
        raise AssertionError("tables are not needed")

    monkeypatch.setattr(mixlm, "count_ranges", none)
    monkeypatch.setattr(mixlm, "send_tables", none)
    assert sorted(map(str, mixlm.score_texts(rows, mixed=False).collect())) == wanted
