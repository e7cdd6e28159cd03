import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import paths
from quarry.functions import text as T

TOKEN = re.compile(r"[A-Za-z_][\w$]+")
SUB = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z][a-z]+|[a-z]+|[A-Z]+|\d+")


def plain_tokens(text):
    out = []
    for t in TOKEN.findall(text):
        subs = [s.lower() for s in SUB.findall(t) if len(s) > 1]
        out += [t.lower(), *(subs if len(subs) > 1 else [])]
    return out


def test_tokens_of_fixed_cases(spark):
    cases = ["HTTPServer createPlayer snake_case_x", "école _x $y a1 B2b", "", "$ _ __ x", "getHTTPResponseCode2xx", "a bc ﬁx"]
    got = spark.createDataFrame([(c,) for c in cases], "t string").select("t", T.tokens(F.col("t")).alias("k")).collect()
    assert {r.t: r.k for r in got} == {c: plain_tokens(c) for c in cases}


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet="aBcXY_$ 1é-\n", max_size=40), min_size=1, max_size=30))
def test_tokens_equal_the_plain_definition(spark, texts):
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.tokens(F.col("t")).alias("k")).collect()
    assert {r.i: r.k for r in got} == {i: plain_tokens(t) for i, t in enumerate(texts)}


def test_identifiers_lines_and_words(spark):
    row = spark.range(1).select(T.identifiers(F.lit("where is createPlayer used createPlayer abc")).alias("i"), T.lines(F.lit("a\r\nb c\n\n")).alias("l"), T.words_in(F.lit(" a b  c ")).alias("w")).first()
    assert row.i == ["createplayer"] and row.l == ["a", "b", "c", ""] and row.w == 3


def test_lengths_and_points(spark):
    row = spark.range(1).select(T.approx_tokens(F.lit("abc")).alias("a"), T.approx_tokens(F.lit("x" * 41)).alias("b"), T.points(F.lit(0.012)).alias("p"), T.points(F.lit(None).cast("double")).alias("q")).first()
    assert tuple(row) == (1, 10, "+1.2pp", "—")


def test_superseded_notes(spark):
    texts = ["valid_to: 2024", "valid_to:\nnext", "valid_to:\n", "x valid_to: y", "a\nvalid_to:  b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    loose = rows.select("i", paths.is_superseded(F.lit("memory"), F.col("t")).alias("s")).collect()
    strict = rows.select("i", paths.is_superseded(F.lit("memory"), F.col("t"), True).alias("s")).collect()
    assert [r.s for r in loose] == [True, True, False, False, True] and [r.s for r in strict] == [True, False, False, False, True]


def test_scopes_and_repos(spark):
    rows = spark.createDataFrame([(["a", "b"], ["x/lib-extra/y"]), (None, ["lib/z"]), ([], ["none"])], "scope array<string>, expect array<string>")
    got = rows.select(paths.scope_key(F.col("scope")).alias("k"), paths.inferred_repo(F.col("expect"), ["lib", "lib-extra"]).alias("r"), paths.relevant(F.col("expect"), F.array(F.lit("q/lib/z"))).alias("v")).collect()
    assert [tuple(r) for r in got] == [("a+b", "lib-extra", False), ("none", "lib", True), ("none", None, False)]
