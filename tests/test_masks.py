"""Tokens are read without trying a place twice, and masked with keyword and value worked out once."""

import time

import pytest
from pyspark.sql import functions as F

from tessera import model
from tessera.functions import text


@pytest.mark.parametrize("snippet", ["a..b;1..2|4..5", 'leaf "a b" { x \'y;z\' }', '"open x..y', "..a.. b..", "it's; \"a\" 'b", "x\"y\"..z{..};", "", "\n\t{}"])
def test_tokens_are_those_of_the_plain_pattern(spark, snippet):
    plain = r"\"[^\"]*\"|'[^']*'|[^\s{};\"']+\.\.[^\s{};\"']+|[^\s{};\"']+|[{};]"
    row = spark.createDataFrame([(snippet,)], "s string").select(text.snippet_tokens(F.col("s")).alias("got"), F.regexp_extract_all("s", F.lit(plain), F.lit(0)).alias("want")).first()
    assert row.got == row.want


def test_a_long_token_is_read_once(spark):
    """Places of a token were tried again from its end for a range."""
    begin = time.time()
    tokens = spark.createDataFrame([("a" * 200_000 + ' "open ' + "b" * 200_000,)], "s string").select(text.snippet_tokens(F.col("s")).alias("t")).first().t
    assert [len(t) for t in tokens] == [200_000, 4, 200_000] and time.time() - begin < 60


def test_a_keyword_is_worked_out_once(spark):
    """Its prefix was cut anew for each class of keywords that it was looked for in."""
    df = spark.createDataFrame([(["p:range", '"1..2"', ";"],)], "t array<string>").select(text.mask_snippet(F.col("t"), model.STRUCTURAL).alias("m"))
    assert df.first().m == ["p:range", "<RANGE>", ";"]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 3
