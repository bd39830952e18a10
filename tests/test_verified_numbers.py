"""Numbers of any size are compared by an absolute tolerance."""

import __spark_entry__ as entry
from millrace.operators import verify


def test_large_whole_numbers_are_told_apart():
    assert not verify.close(1_000_001, 1_000_002) and not verify.close(10**30, 10**30 + 1) and not verify.close(2_000_001.0, 2_000_002)
    assert verify.close(10**400, 10**400) and verify.close(1.0, 1.0000005) and verify.close(float("nan"), float("nan")) and verify.close(float("inf"), float("inf"))


def test_verification_of_large_keys(spark, tmp_path):
    spark.range(5_999_990, 6_000_010).withColumnRenamed("id", "o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.o_orderkey: r.status for r in entry.queries()["verification"](spark, str(tmp_path)).collect()}
    assert got == {k: "failure" if k % 2 else "success" for k in range(5_999_990, 6_000_010)}
