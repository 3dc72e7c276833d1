"""A trigram index of an event table: which files may hold a substring.

A row (gram, file) for every three characters that stand in a message of a file, sorted by gram, so that a lookup
reads few row groups. A search opens the files that hold all trigrams of its text, and those that came after the
index was last brought up to date; rows are then checked as without an index, so results never differ. Texts under
three characters have no trigram and are searched for in all files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelog.operators import query


def _files(spark: SparkSession, path: str) -> list[str]:
    return spark.read.parquet(path).inputFiles()


def _known(spark: SparkSession, index: str) -> set[str]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{index}/files")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return set()
    return {r.file for r in spark.read.parquet(f"{index}/files").collect()}  # a name a file, as Spark lists them


def update(spark: SparkSession, path: str, index: str, parts: int = 8) -> int:
    """Index the files of the table at ``path`` that the index doesn't have; how many. Files are listed as known
    last, so a run that died is done again, and a file twice in the index is no harm."""
    known = _known(spark, index)
    new = [f for f in _files(spark, path) if f not in known]
    if not new:
        return 0
    rows = spark.read.parquet(*new).select(F.input_file_name().alias("file"), F.lower("message").alias("m")).filter(F.length("m") >= 3)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("m") - 2), lambda i: F.col("m").substr(i, F.lit(3))))
    found = rows.select("file", F.explode(grams).alias("gram")).distinct()
    found.repartitionByRange(parts, "gram").sortWithinPartitions("gram").write.mode("append").parquet(f"{index}/grams")
    spark.createDataFrame([(f,) for f in new], "file string").coalesce(1).write.mode("append").parquet(f"{index}/files")
    return len(new)


def candidates(spark: SparkSession, path: str, index: str, text: str) -> list[str]:
    """The files of the table that may hold ``text``."""
    files, low = _files(spark, path), text.lower()
    grams = sorted({low[i : i + 3] for i in range(len(low) - 2)})
    known = _known(spark, index)
    if not grams or not known:
        return files
    held = spark.read.parquet(f"{index}/grams").filter(F.col("gram").isin(grams)).groupBy("file").agg(F.count_distinct("gram").alias("n"))
    may = {r.file for r in held.filter(F.col("n") == len(grams)).collect()}
    return [f for f in files if f in may or f not in known]


def search(spark: SparkSession, path: str, index: str, text: str, only_errors: bool = False, limit: int | None = None) -> DataFrame:
    """As :func:`kestrelog.operators.query.search` over the table at ``path``, from the files that may hold ``text``."""
    files = candidates(spark, path, index, text)
    whole = spark.read.parquet(path)
    if not files:
        return whole.limit(0)
    rows = spark.read.schema(whole.schema).option("basePath", path).parquet(*files)
    return query.search(rows, text, only_errors, limit)
