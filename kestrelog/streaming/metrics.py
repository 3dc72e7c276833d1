"""Counters of what flows through a plan, observed by Spark at no extra pass; histograms with quantiles, and gauges.

A histogram is a table of counts by label and bucket of the logarithm, so parts of it (of tasks, of batches, of
streams) are merged by adding, in any order, and a quantile is off by the ratio ``error`` at most. Numbers of zero
or less share one bucket, whose value is 0; nulls are left out.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def observed(df: DataFrame, name: str, by: str | None = None, values: tuple = ()) -> DataFrame:
    """Count the rows that pass, and those with each of ``values`` in the column ``by``."""
    each = [F.count_if(F.col(by) == v).alias(str(v)) for v in values]
    return df.observe(name, F.count(F.lit(1)).alias("total"), *each)


class Metrics(StreamingQueryListener):
    """Sums of observed counters over all batches of all streams; add it with spark.streams.addListener."""

    def __init__(self):
        self.totals: Counter = Counter()

    def onQueryStarted(self, event) -> None: ...

    def onQueryIdle(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        self.totals["input_rows"] += event.progress.numInputRows
        for name, row in event.progress.observedMetrics.items():
            for label, n in row.asDict().items():
                self.totals[f"{name}.{label}"] += n

    def onQueryTerminated(self, event) -> None:
        self.totals["failed" if event.exception else "ended"] += 1


ZERO = -(1 << 31)


def histogram(rows: DataFrame, labels: list[str], value: str, error: float = 0.01) -> DataFrame:
    """(labels, bucket, n)."""
    width = math.log((1 + error) / (1 - error))
    bucket = F.when(F.col(value) > 0, F.ceil(F.log(F.col(value).cast("double")) / width)).otherwise(ZERO).cast("int")
    return rows.filter(F.col(value).isNotNull()).groupBy(*labels, bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merged(parts: list[DataFrame]) -> DataFrame:
    whole = reduce(DataFrame.unionByName, parts)
    return whole.groupBy(*[c for c in whole.columns if c != "n"]).agg(F.sum("n").alias("n"))


def quantiles(counts: DataFrame, labels: list[str], shares: list[float], error: float = 0.01) -> DataFrame:
    """(labels, n, share, value): for each share the smallest bucket that so many of a label's numbers don't pass.
    A label has as many rows as its numbers have orders of magnitude, however many they are."""
    line = Window.partitionBy(*labels).orderBy("bucket")
    up = counts.withColumn("up", F.sum("n").over(line.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(Window.partitionBy(*labels)))
    asked = up.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).filter(F.col("up") >= F.greatest(F.ceil(F.col("share") * F.col("all")), F.lit(1)))
    width = math.log((1 + error) / (1 - error))
    middle = F.when(F.col("bucket") == ZERO, 0.0).otherwise(F.exp(F.col("bucket") * width) * (1 - error))
    found = asked.groupBy(*labels, "share").agg(F.min("bucket").alias("bucket"), F.first("all").alias("n"))
    return found.select(*labels, "n", "share", middle.alias("value"))


def gauges(rows: DataFrame, labels: list[str], value: str, at: str = "timestamp") -> DataFrame:
    """(labels, value, at): each label's last number; of several at one time the largest."""
    last = F.max(F.struct(F.col(at).alias("at"), F.col(value).alias("value")))
    return rows.filter(F.col(value).isNotNull()).groupBy(*labels).agg(last.alias("last")).select(*labels, "last.value", "last.at")


def stream_histogram(rows: DataFrame, labels: list[str], value: str, path: str, checkpoint: str, error: float = 0.01, **trigger):
    """Add a stream's counts to a table, a batch a partition: one that runs again replaces its own."""

    def write(batch: DataFrame, batch_id: int) -> None:
        counts = histogram(batch, labels, value, error).withColumn("batch", F.lit(batch_id))
        counts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_histogram(spark: SparkSession, path: str) -> DataFrame:
    return merged([spark.read.parquet(path).drop("batch")])
