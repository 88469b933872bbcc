"""Runs of three characters of long texts."""

import time

from pyspark.sql import functions as F

from snaptrail.operators.lookup import grams


def test_runs_of_long_texts_take_linear_time(spark):
    texts = ["", "ab", None, "abc", "añ😀bc", "x" * 9, " a\n\tb "]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select("t", grams(F.col("t")).alias("g")).collect()
    assert all(list(r["g"]) == (list(dict.fromkeys(r["t"][i : i + 3] for i in range(len(r["t"]) - 2))) if r["t"] else []) for r in out)
    took = {}
    for n in (100, 20_000):
        df = spark.range(4).select(F.repeat(F.concat(F.lit("abcd"), "id"), F.lit(n // 5)).alias("t"))
        df.select(F.sum(F.size(grams(F.col("t"))))).collect()
        began = time.time()
        assert df.select(F.sum(F.size(grams(F.col("t"))))).head()[0] == 20
        took[n] = time.time() - began
    assert took[20_000] < took[100] + 5
