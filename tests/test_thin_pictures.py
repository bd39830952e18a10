"""Pictures so thin that a side vanishes when they are fitted have no price, and fail no other row."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from millrace.operators import conversation


def test_vanishing_sides(spark):
    rows = spark.createDataFrame([(0, 4096.0, 1.0, False), (1, 1.0, 2197.0, False), (2, 2048.0, 1.0, False), (3, 4096.0, 1.0, True), (4, 1024.0, 1024.0, False)], "i int, w double, h double, low boolean")
    got = {r.i: r.n for r in rows.select("i", conversation.image_tokens(F.col("w"), F.col("h"), F.col("low")).alias("n")).collect()}
    assert got == {0: None, 1: None, 2: 85 + 170 * 2 * 3072, 3: 85, 4: 765}


def test_image_tokens_of_thin_parts(spark, tmp_path):
    spark.createDataFrame([(5998, 36), (5999, 36), (29990, 36)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.p_partkey: r.tokens for r in entry.queries()["image_tokens"](spark, str(tmp_path)).collect()}
    assert got[5998] is None and got[5999] > 85 and got[29990] == 85
