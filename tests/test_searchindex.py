"""The trigram index gives what a scan gives, from fewer files."""

from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kestrelog.operators import query, searchindex
from kestrelog.schema import EVENT

BASE = datetime(2026, 7, 6, 14, 0, tzinfo=UTC)


def rows(spark, messages, first=0):
    data = [(f"e{i}", BASE + timedelta(seconds=i), "a", "src", 40 if i % 2 else 20, "generic", m, "t", "f", None, None, None, None, i) for i, m in enumerate(messages, first)]
    return spark.createDataFrame(data, EVENT)


@pytest.mark.parametrize("partitioned", [False, True])
def test_search_equals_a_scan_and_opens_fewer_files(spark, tmp_path, partitioned):
    path, index = str(tmp_path / "t"), str(tmp_path / "i")

    def add(messages, first):
        out = rows(spark, messages, first).withColumn("day", F.lit(first)).coalesce(1).write.mode("append")
        (out.partitionBy("day") if partitioned else out).parquet(path)

    for i, messages in enumerate([["Connection REFUSED by db-1", "ok"], ["timeout after 30 s", "ÄRGER mit Ümlaut"], ["a", "", "refuse it"], [None, "connection reset"]]):
        add(messages, 10 * i)
    assert searchindex.update(spark, path, index) == 4 and searchindex.update(spark, path, index) == 0
    ids = lambda df: [r.event_id for r in df.collect()]
    for text, errors in (("REFUSE", False), ("connection", True), ("ärger", False), ("zz top", False), ("a", False)):
        assert sorted(ids(searchindex.search(spark, path, index, text, errors))) == sorted(ids(query.search(spark.read.parquet(path), text, errors))), text
    assert [len(searchindex.candidates(spark, path, index, t)) for t in ("refused", "refuse", "zz top", "ok")] == [1, 2, 0, 4]
    add(["refused again"], 90)  # after the index
    assert len(searchindex.candidates(spark, path, index, "refused")) == 2 and len(ids(searchindex.search(spark, path, index, "refused"))) == 2
    assert searchindex.update(spark, path, index) == 1 and len(ids(searchindex.search(spark, path, index, "refused", limit=1))) == 1
