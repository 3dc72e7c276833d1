"""Operator 9: license scans by diagonal voting, DataFrame functions only.

Texts and license phrases are word sequences. Every rolling two-word hash of every document is joined
with the positions that have it in the phrases, and the words themselves are compared; a hit votes for the
diagonal (document position minus phrase position). Diagonals of at most two words apart are merged, which
bridges words put in or left out. A merged span is verified by its longest chain of hits: document and
phrase positions rise, and from hit to hit the diagonal moves by two words at most. The chain's share of the
phrase's pairs is the span's; a phrase position counts once, however often the words stand. A base phrase
must have all of its pairs on one diagonal, so its words stand consecutively.

Null texts count as empty and have no words. Every input row gives one output row, repeated rows too: rows
are known by file and place. Very long texts are scanned whole, one row a word; ties in a chain's length
don't matter, since only the length counts. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrelog.llm.common import numbered

#: (label, phrase, base): base phrases must be found whole (fixed values), the others nearly so.
PHRASES = [
    ("cc-by", "cc by", True),
    ("gpl", "general public license", True),
    ("reserved", "all rights reserved", True),
    ("apache-2.0", "licensed under the apache license version 2 0", False),
    ("mit", "released under the mit license", False),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", False),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", False),
    ("gpl-3.0", "licensed under the gnu general public license version 3", False),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", False),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", False),
]
#: Words by which merged diagonals may lie apart, and the share of a phrase that a span must hold.
SLACK, SHARE = 2, 0.8
#: What separates words (fixed value).
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def phrase_positions(spark: SparkSession, phrases=PHRASES) -> DataFrame:
    """(h, p_a, p_b, phrase, at, total, base, label): each two-word hash of each phrase, of 64 words at most."""
    rows = []
    for i, (label, phrase, base) in enumerate(phrases):
        words = phrase.split()
        if not 2 <= len(words) <= 64:
            raise ValueError(f"a phrase has 2 to 64 words: {phrase}")
        rows += [(a, b, i, at, len(words) - 1, base, label) for at, (a, b) in enumerate(zip(words, words[1:]))]
    df = spark.createDataFrame(rows, "p_a string, p_b string, phrase int, at int, total int, base boolean, label string")
    return df.select(F.xxhash64("p_a", "p_b").alias("h"), "*")


#: The hits (pos, at) of a span from its diagonals and their bits, and the pairs of its longest chain. Only
#: hits near enough to be followed are held.
HITS = """array_sort(flatten(transform(lines, d -> transform(filter(sequence(0, total - 1), a -> getbit(d.bits, a) = 1), a -> struct(d.diagonal + a AS pos, a AS at)))))"""
CHAIN = f"""aggregate(hits, named_struct('best', 0, 'held', cast(array() AS array<struct<pos: int, at: int, n: int>>)),
    (acc, h) -> aggregate(array(1 + coalesce(array_max(transform(
            filter(acc.held, r -> r.pos < h.pos AND r.at < h.at AND abs(h.pos - h.at - r.pos + r.at) <= {SLACK}), r -> r.n)), 0)),
        acc, (acc, n) -> named_struct('best', greatest(acc.best, n),
            'held', concat(filter(acc.held, r -> r.pos >= h.pos - total - {SLACK}), array(named_struct('pos', h.pos, 'at', h.at, 'n', n))))),
    acc -> acc.best)"""


def scan(docs: DataFrame, phrases=PHRASES) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score
    (the largest share of a phrase that a verified span holds; 0 without one)."""
    low = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    words = F.filter(F.split(low, GAP, -1), lambda x: x != "")
    rows = numbered(docs).select("row", F.col("doc_id").cast("long").alias("doc_id"), words.alias("w"))
    n = F.size("w")
    pairs = F.zip_with(F.slice("w", 1, F.greatest(n - 1, F.lit(0))), F.slice("w", 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(F.xxhash64(a, b).alias("h"), a.alias("a"), b.alias("b")))
    rolling = rows.select("row", "doc_id", n.cast("long").alias("n_words"), F.posexplode_outer(pairs).alias("pos", "pair"))
    rolling = rolling.select("row", "doc_id", "n_words", "pos", "pair.h", "pair.a", "pair.b")
    # the phrases are constants of this module: a few hundred rows
    hits = rolling.join(F.broadcast(phrase_positions(docs.sparkSession, phrases)), "h", "left")
    same = (F.col("a") == F.col("p_a")) & (F.col("b") == F.col("p_b"))
    hits = hits.select("row", "doc_id", "n_words", F.when(same, F.struct("phrase", "total", "base", "label", (F.col("pos") - F.col("at")).alias("diagonal"))).alias("hit"), "at")
    votes = hits.groupBy("row", "doc_id", "n_words", "hit").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("bits"))
    votes = votes.select("row", "doc_id", "n_words", "hit.*", "bits", F.bit_count("bits").alias("votes"))
    line = Window.partitionBy("row", "phrase").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(line) > SLACK).cast("int"), F.lit(1))
    merged = votes.withColumn("new", apart).withColumn("span", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    spans = merged.groupBy("row", "doc_id", "n_words", "phrase", "total", "base", "label", "span").agg(
        F.count_if(F.col("votes") == F.col("total")).alias("whole"),
        F.min(F.when(F.col("votes") == F.col("total"), F.col("diagonal"))).alias("low"),
        F.max(F.when(F.col("votes") == F.col("total"), F.col("diagonal"))).alias("high"),
        F.bit_or("bits").alias("bits"),
        F.collect_list(F.struct("diagonal", "bits")).alias("lines"),
    )
    # a chain needs enough different positions of the phrase: only such spans are verified
    may = ~F.col("base") & (F.bit_count("bits") >= SHARE * F.col("total"))
    spans = spans.withColumn("hits", F.when(may, F.expr(HITS))).withColumn("share", F.when(may, F.expr(CHAIN)) / F.col("total"))
    whole = F.coalesce(F.col("base") & (F.col("whole") > 0), F.lit(False))
    near = F.coalesce(F.col("share") >= SHARE, F.lit(False))
    out = spans.groupBy("row", "doc_id", "n_words").agg(
        F.coalesce(F.sum(F.when(whole, F.col("whole"))), F.lit(0)).alias("n_base"),
        F.min(F.when(whole, F.col("low"))).cast("long").alias("first_word"),
        F.max(F.when(whole, F.col("high"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(whole, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(whole | near, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(whole, F.lit(1.0)).when(near, F.round("share", 6))), F.lit(0.0)).alias("score"),
    )
    return out.drop("row")
