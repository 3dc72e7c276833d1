"""Histograms by label: parts add up, batch and stream agree, quantiles stay within the error."""

import numpy as np
from pyspark.sql import functions as F

from kestrelog.streaming import metrics


def test_quantiles_of_batch_parts_and_stream(spark, tmp_path):
    r = np.random.default_rng(1)
    data = [("ab"[i % 2], float(x)) for i, x in enumerate(np.exp(r.normal(2, 2, 3000)))] + [("a", 0.0), ("a", -3.0), ("a", None), ("z", 0.0)]
    df = spark.createDataFrame(data, "label string, value double")
    whole = metrics.histogram(df, ["label"], "value")
    halves = metrics.merged([metrics.histogram(df.filter(c), ["label"], "value") for c in ("value < 7", "value >= 7")])
    source = str(tmp_path / "in")
    for i, part in enumerate(df.randomSplit([0.3, 0.7], 1)):
        part.coalesce(1).write.parquet(f"{source}/{i}")
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(source)
    for _ in range(2):  # the second run has nothing to add
        metrics.stream_histogram(stream, ["label"], "value", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    key = lambda h: sorted(tuple(x) for x in metrics.quantiles(h, ["label"], [0.0, 0.5, 0.9, 0.99, 1.0]).collect())
    assert key(whole) == key(halves) == key(metrics.read_histogram(spark, str(tmp_path / "out")))
    for label, n, share, value in key(whole):
        own = sorted(max(x, 0.0) for name, x in data if name == label and x is not None)
        exact = own[max(int(np.ceil(share * len(own))), 1) - 1]
        assert n == len(own) and abs(value - exact) <= 0.0101 * exact + 1e-12


def test_gauges_keep_the_last_number(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 3, 2.0), ("a", 3, 4.0), ("a", 9, None), ("b", 2, 7.0)], "label string, timestamp long, value double")
    assert sorted(map(tuple, metrics.gauges(df, ["label"], "value").collect())) == [("a", 4.0, 3), ("b", 7.0, 2)]
    assert metrics.gauges(df.filter(F.lit(False)), ["label"], "value").count() == 0
