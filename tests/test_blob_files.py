"""Stored parts are written by many tasks."""

import os

from snaptrail.sources import readers


def test_blobs_are_written_by_many_tasks(spark, tmp_path):
    texts = spark.range(20).selectExpr("cast(id as string) AS value").coalesce(1)
    readers.write_text_blobs(texts, str(tmp_path / "run"))
    files = [f for f in os.listdir(tmp_path / "run") if f.endswith(".txt")]
    assert len(files) == 20 and len({f.split("-")[1] for f in files}) > 1
