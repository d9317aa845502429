from delvework.functions import text as T
from pyspark.sql import functions as F


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_lines(spark):
    assert one(spark, "a\r\nb\n\nc\n", T.lines) == ["a", "b", "", "c"]
    assert one(spark, "", T.lines) == []
    assert one(spark, "a\n\n", T.lines) == ["a", ""]
    assert one(spark, None, T.lines) is None


def test_bigrams(spark):
    assert one(spark, "合并模块", T.bigrams) == ["合并", "并模", "模块"]
    assert one(spark, "parse合并user 块", T.bigrams) == ["合并", "块"]
    assert one(spark, "合并模块 x 块", T.bigram_count) == 4
    assert one(spark, None, T.bigram_count) == 0


def test_split_query():
    assert T.split_query("parse合并user a.b") == (["合并"], ["parse", "user", "ab"])
    assert T.split_query("合并 模块") == (["合并", "模块"], [])
    assert T.split_query("... ") == ([], [])
    assert T.query_bigrams(["合并模块", "块"]) == ["合并", "并模", "模块", "块"]


def test_occurrences_overlap(spark):
    assert one(spark, "AAAAA", lambda c: T.occurrences(c, "aaa")) == 3
    assert one(spark, "a.b a+b", lambda c: T.occurrences(c, "a.b")) == 1
    assert one(spark, None, lambda c: T.occurrences(c, "aaa")) == 0


def test_paths(spark):
    assert one(spark, "././src\\a//b/", T.normal_path) == "src/a//b/"
    assert one(spark, "a/b.tar.GZ", T.extension) == "gz"
    assert one(spark, "a.b/c", T.extension) == "~"
    assert one(spark, "a/.env", T.extension) == "~"
