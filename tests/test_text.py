"""Tokens, stripping, tolerant JSON."""

from pyspark.sql import functions as F

from folioflow.functions import text as T


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


def test_tokens_keep_numbers_whole(spark):
    cases = {"16,5%": ["16,5%"], "16,5%abc": ["16,5%abc"], "16%abc": ["16%", "abc"], "1.192": ["1.192"], "3,4.": ["3,4"], "CASA Đạt": ["casa", "đạt"]}
    for text, want in cases.items():
        assert one(spark, text, T.tokens) == want


def test_strip_is_unicode_aware(spark):
    assert one(spark, " \n x y \t\x1f", T.strip) == "x y"


def test_json_with_fences_and_prose(spark):
    parse = lambda c: T.parse_json(c, "k long")["k"]
    for text in ('```json\n{"k": 3}\n```', '```\n{"k": 3}\n```', 'so: {"k": 3} done', ' {"k": 3} '):
        assert one(spark, text, parse) == 3
    assert one(spark, "{broken", parse) is None


def test_contextual_text_takes_null_as_empty(spark):
    got = spark.createDataFrame([("a", None, "h", "x")], "a string, b string, c string, d string").select(T.contextual_text(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).first()[0]
    assert got == "Chương: a | Mục:  | Tiêu đề: h\n\nx"


def test_lower_token_characters_are_the_same():
    import re

    every = "".join(chr(c) for c in range(1, 0x2000)).lower()
    assert re.findall(T.LOWER_TOKEN, every) == re.findall(T.TOKEN, every)
