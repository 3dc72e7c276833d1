"""Operator 5: line dedup over overlapping three-line windows, DataFrame functions only.

A text is cut at every line feed. Each three consecutive lines are one window, known by two 64-bit
hashes. Of a window that stands more than once in the table, the occurrence with the smallest
(doc_id, hash of the text, line) stays, null ids first; every later one covers its three lines. The
covered lines of a document are merged and removed. A later occurrence that overlaps the first one
covers only the lines after it, so what stays is whole.

A document is known by its doc_id, null or not, and the 64-bit hash of its text. So two texts under one
doc_id are two documents, and rows that repeat both are one document given several times: all are
cleaned alike. Null texts stay null, with no lines. Texts of fewer than three lines have no window and
stay as they are. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def covered_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, t, removed array<int>) of documents that lose lines; t is the text's hash, lines count
    from 0."""
    lines = docs.filter("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), F.split("text", "\n", -1).alias("l"))
    hashed = lines.filter(F.size("l") >= 3).select("doc_id", "t", F.transform("l", lambda x: F.xxhash64(x)).alias("h"), F.transform("l", lambda x: F.crc32(x.cast("binary"))).alias("c"))
    keys = hashed.select(
        "doc_id",
        "t",
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), F.size("h") - 3),
                lambda i: F.struct(
                    F.xxhash64(F.get("h", i), F.get("h", i + 1), F.get("h", i + 2)).alias("k1"),
                    F.xxhash64(F.get("c", i + 2), F.get("h", i + 1), F.get("c", i), F.get("h", i), F.get("h", i + 2)).alias("k2"),
                ),
            )
        ).alias("pos", "k"),
    ).select("doc_id", "t", "pos", "k.k1", "k.k2")
    first = keys.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "t", "pos")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("t") == F.col("first.t"))
    later = keys.join(first, ["k1", "k2"]).filter(~same | (F.col("pos") != F.col("first.pos")))
    begins = F.when(same, F.greatest("pos", F.col("first.pos") + 3)).otherwise(F.col("pos"))
    spans = later.select("doc_id", "t", F.explode(F.filter(F.sequence(F.col("pos"), F.col("pos") + 2), lambda x: x >= begins)).alias("line"))
    return spans.groupBy("doc_id", "t").agg(F.array_sort(F.collect_set("line")).alias("removed"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, text (what stays, joined by line feeds)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("t"))
    covered = covered_lines(docs).select(F.col("doc_id").alias("d"), F.col("t").alias("u"), "removed")
    rows = rows.join(covered, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("u")), "left")
    lines = F.split("text", "\n", -1)
    gone = F.coalesce("removed", F.array().cast("array<int>"))
    out = rows.select("doc_id", "text", lines.alias("l"), gone.alias("gone"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("l") - 1), F.col("gone"))
    kept = F.transform(stay, lambda i: F.get("l", i))
    out = out.withColumn("n_removed", F.size("gone"))
    return out.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.size("l")).cast("long").alias("n_lines"),
        F.col("n_removed").cast("long").alias("n_removed"),
        F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
    )


SQL = r"""
WITH l AS (SELECT DISTINCT doc_id, text, coalesce(doc_id, -9223372036854775808) AS d, md5(text) AS t, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
w AS (SELECT d, t, l, unnest(range(0, len(l) - 2)) AS pos FROM l WHERE len(l) >= 3),
k AS (SELECT d, t, pos, l[pos + 1] AS a, l[pos + 2] AS b, l[pos + 3] AS c FROM w),
f AS (SELECT a, b, c, min(row(d, t, pos)) AS first, count(*) AS n FROM k GROUP BY a, b, c HAVING count(*) > 1),
later AS (SELECT k.d, k.t, k.pos, first FROM k JOIN f USING (a, b, c) WHERE row(k.d, k.t, k.pos) <> first),
s AS (SELECT d, t, first, unnest(range(pos, pos + 3)) AS line FROM later),
r AS (SELECT DISTINCT d, t, line FROM s WHERE NOT (first[1] = d AND first[2] = t AND line < first[3] + 3)),
n AS (SELECT d, t, count(*) AS n FROM r GROUP BY d, t),
e AS (SELECT d, t, l, unnest(range(0, len(l))) AS line FROM l),
j AS (SELECT e.d, e.t, string_agg(e.l[e.line + 1], chr(10) ORDER BY e.line) AS text
      FROM e LEFT JOIN r ON r.d = e.d AND r.t = e.t AND r.line = e.line WHERE r.line IS NULL GROUP BY e.d, e.t)
SELECT q.doc_id, CASE WHEN q.text IS NULL THEN 0 ELSE len(string_split(q.text, chr(10))) END AS n_lines,
       coalesce(n.n, 0) AS n_removed, CASE WHEN q.text IS NULL THEN NULL ELSE sha256(coalesce(j.text, '')) END AS text_sha256
FROM (SELECT *, coalesce(doc_id, -9223372036854775808) AS d, md5(text) AS t FROM documents) q
LEFT JOIN n ON n.d = q.d AND n.t = q.t LEFT JOIN j ON j.d = q.d AND j.t = q.t
"""
