import random
import re
import unicodedata

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import lexical

ODD = ["", None, "a", "$_x __ _", "HTTPServer createPlayer snake_case_x école Ünï xé9½ aⅣb A²B", "The the THE x1y22 aBC ABc9d kİQ ΣΑΣ aΣ", "a〇一 z٠١Ab _9 A_b$Cd\nnext", "w " * 3000]


def test_counted_terms_are_the_native_tokens(spark):
    draw = random.Random(3)
    letters = "abcXYZ_$09 \n.éΣ½١"
    texts = ODD + ["".join(draw.choice(letters) for _ in range(draw.randint(0, 80))) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    native = rows.select("id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    lengths = rows.select("id", F.greatest(F.size(T.tokens(F.col("text"))), F.lit(0)).alias("length"))
    found = lexical.postings(rows).collect()
    assert sorted((r["id"], r["term"], r["tf"]) for r in found) == sorted(map(tuple, native.collect()))
    assert sorted(map(tuple, lexical.counted(rows).select("id", "length").collect())) == sorted(map(tuple, lengths.collect()))


def test_a_slice_is_cut_by_characters(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(lexical, "SLICE_CHARS", 10)
    frame = pa.RecordBatch.from_pydict({"id": pa.array(range(5), pa.int64()), "text": ["aa bb", None, "x" * 50, "cc", "dd ee"]})
    parts = list(lexical._count(pa.int64())(iter([frame])))
    assert [p.column("id").to_pylist() for p in parts] == [[0, 1], [2], [3, 4]] and parts[0].column("terms").to_pylist() == [["aa", "bb"], []]


def test_word_characters_are_letters_numbers_and_the_underscore():
    word = re.compile(r"\w")
    wrong = [c for c in map(chr, range(0x110000)) if bool(word.match(c)) != (unicodedata.category(c)[0] in "LN" or c == "_")]
    assert not wrong
