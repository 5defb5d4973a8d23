"""Compatibility forms give the terms of their plain forms unless that is turned off."""

from pyspark.sql import functions as F

from heronry.functions import text


def test_default_analyzer_normalizes(spark):
    texts = ["ＡＢＣ１２ ﬁne cafe\u0301", "ABC12 fine café", "plain", None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    a, b, *rest = [r.x for r in rows.select("i", text.StandardAnalyzer().document(F.col("t")).alias("x")).orderBy("i").collect()]
    assert a == b == ["abc12", "fine", "café"] and rest == [["plain"], [], []]
