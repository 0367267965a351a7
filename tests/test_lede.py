"""Ledes of texts that the test tables don't hold."""

from pyspark.sql import functions as F

from tests.oracle import compare
from tidemark.functions import texts
from tidemark.plans import catalogue

ODD = ["", " ", "\n\t\f\r ", None, " a  b ", "a\u00a0b c", "\u00a0", "a\u3000b\u2028c", "a\x0bb\x1cc\x1fd\x85e", "\x0b", "e\u0301 \U0001f600" * 1500, "w " * 149 + "x\u00a0y z", "a\r\n\r\nb", "\u200b", "\ufeffa b"]


def test_ledes_of_odd_texts_equal_their_sql(spark, tmp_path):
    rows = [(i, text, source) for i, (text, source) in enumerate((t, s) for t in ODD for s in ("src", None, "\u00e9" * 2047))]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/made")
    next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    assert compare(catalogue.QUERIES["lede"](spark, str(tmp_path)), catalogue.ORACLES["lede"], str(tmp_path)) == ""


def test_ledes_of_articles_keep_to_unicode_white_space(spark):
    found = spark.createDataFrame([(t,) for t in ("a\u00a0b", "\u3000", "")], "t string").select(texts.lede(F.col("t")).alias("x")).collect()
    assert [r["x"] for r in found] == ["a b", None, None]
