import pytest
from pyspark.sql import functions as F

from matchloom.functions import text as T

CASES = [
    ("Microsoft SQL Server", "microsoft sql server"), ("noah's ark (jewel case)", "noah s ark jewel case"), ("foo   bar    baz", "foo bar baz"), ("  hello world  ", "hello world"),
    ("Acme Inc Software", "acme software"), ("The Best Software for the Enterprise", "best software enterprise"), ("adobe after effects", "adobe after effects"), ("INC Corp LLC", ""),
    ("v5.0", "v 5 0"), ("Pro9000", "pro 9000"), ("2007", "2007"), ("3pk", "3 pk"), (None, ""), ("", ""), ("---!!!...", ""), ("the and of for", ""), ("café résumé", "café résumé"), ("12345", "12345"),
    ("x", "x"), ("Adobe After Effects Professional 6.5", "adobe after effects professional 6 5"), ("5in", "5"), ("snake_case", "snake_case"), ("a b c", "b c"),
]


def test_normalize(spark):
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(CASES)], "i int, x string")
    got = {r.i: r.y for r in df.select("i", T.normalize(F.col("x")).alias("y")).collect()}
    assert [got[i] for i in range(len(CASES))] == [y for _, y in CASES]


@pytest.mark.parametrize(("text", "grams"), [("abc", ["abc"]), ("abcd", ["abc", "bcd"]), ("ab", ["ab"]), ("", [])])
def test_trigram_set(spark, text, grams):
    assert spark.range(1).select(T.trigram_set(F.lit(text)).alias("g")).head().g == grams


def test_tokens_and_numbers(spark):
    r = spark.range(1).select(T.numeric_tokens(F.lit("version 5 pro 2007")).alias("n"), T.numeric_tokens(F.lit("hello")).alias("e"), T.word_trigrams(F.lit("ab c")).alias("w"), T.word_trigrams(F.lit("")).alias("z")).head()
    assert (r.n, r.e, r.w, r.z) == (["5", "2007"], [], [" ab", "ab ", " c "], [])


def test_missing(spark):
    df = spark.createDataFrame([(None, None), ("nan", float("nan")), ("", 0.0), ("  NaN ", 1.0), ("adobe", 19.99)], "t string, p double")
    got = df.select(T.present_text(F.col("t")).alias("t"), T.present_number(F.col("p")).alias("p")).collect()
    assert [(r.t, r.p) for r in got] == [(False, False), (False, False), (False, True), (False, True), (True, True)]


def test_serialize_record(spark):
    df = spark.createDataFrame([("photoshop", "adobe", 599.99), ("photoshop", None, 599.99), (None, None, None), ("a", "b", 1e7), ("a", "b", 1e-4), ("a", "b", 1e-5), ("a", "b", 0.0)], "t string, m string, p double")
    got = [r.s for r in df.select(T.serialize_record(F.col("t"), F.col("m"), F.col("p")).alias("s")).collect()]
    assert got == ["photoshop | adobe | 599.99", "photoshop |  | 599.99", " |  | ", "a | b | 10000000.0", "a | b | 0.0001", "a | b | 1e-05", "a | b | 0.0"]
