"""Operator 11: spelling variants by a rare-first q-gram prefix filter.

Words are counted in DataFrame functions. Their bigrams are put in one global order, the rarest first
(by the number of places in all words, ties in code-point order; positions don't enter the order, since
an edit shifts them). Two words at distance one share a bigram among the three rarest of each, at places
that differ by one at most: an edit touches two bigrams at the most, so one of the three is untouched.

Only those three bigrams of a word make keys. The single edit stands either behind the shared bigram or
before it, so the other side is equal and fixes the place; of the side with the edit one half is equal as
well. So there are four keys a bigram, each of more than half of the word, and a common beginning such as
a prefix of two letters doesn't make a large bucket. Keys are 64-bit hashes; every pair that meets is
verified on the words.

Null texts have no words. A null doc_id counts as empty in the digest that picks misspelt runs. Repeated
rows count as often as they stand, very long texts are read whole, an empty table gives no rows, and
other columns are ignored. Ties for a form go to the word that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelog.llm.common import arrow_type, materialize, remove

#: Letters of a run, and its smallest length (fixed values).
RUN, SHORTEST = r"[A-Za-zÀ-ÿ]", 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One edit touches two bigrams, so one of three is left.
RAREST = 3


def words(docs: DataFrame, damage: int | None = 97, least: int = 3) -> DataFrame:
    """(word, n): distinct lower-cased runs of at least 5 code points with ``least`` occurrences.

    Where the crc32 of ``doc_id:run`` is a multiple of ``damage``, the run has lost its code point
    crc32 % length; None leaves all runs as they are.
    """
    found = F.regexp_extract_all("text", F.lit(f"{RUN}{{{SHORTEST},}}"), F.lit(0))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.explode(found).alias("run"))
    runs = runs.select("doc_id", F.translate("run", UPPER, LOWER).alias("word"))
    if damage is not None:
        runs = runs.withColumn("h", F.crc32(F.concat("doc_id", F.lit(":"), "word").cast("binary")))
        at = (F.col("h") % F.char_length("word")).cast("int")
        less = F.concat(F.col("word").substr(F.lit(1), at), F.col("word").substr(at + 2, F.char_length("word")))
        runs = runs.select(F.when(F.col("h") % damage == 0, less).otherwise(F.col("word")).alias("word"))
    counts = runs.filter(F.char_length("word") >= SHORTEST).groupBy("word").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= least)


def bigram_order(counted: DataFrame) -> dict[str, int]:
    """Bigram -> its place among all, the rarest first. At most 90 * 90 entries: runs are of 90 letters."""
    starts = F.sequence(F.lit(1), F.char_length("word") - 1)
    grams = counted.select(F.explode(F.transform(starts, lambda i: F.col("word").substr(i, F.lit(2)))).alias("gram"))
    rows = grams.groupBy("gram").agg(F.count("*").alias("n")).collect()
    return {gram: i for i, (_, gram) in enumerate(sorted((row.n, row.gram) for row in rows))}


def rarest(word: str, order: dict[str, int]) -> list[int]:
    """Places of the three bigrams of ``word`` that come first in the global order."""
    return sorted(range(len(word) - 1), key=lambda p: (order[word[p : p + 2]], p))[:RAREST]


def keys(word: str, places: list[int], shorter: int) -> set[str]:
    """Keys of ``word`` in pairs whose shorter word has ``shorter`` code points: its own length or one less."""
    out, more = set(), len(word) - shorter
    for p in places:
        rest = shorter - p - 2  # the edit stands behind the bigram: what leads up to it is equal
        if rest >= 0:
            half = (rest + 1) // 2
            out.add(f"a{p} {word[: p + 2 + half]}")
            out.add(f"b{p} {word[: p + 2]} {word[len(word) - (rest - half) :]}")
        rest = p - more  # it stands before the bigram: what follows is equal, places count in the shorter word
        if rest >= 0:
            half = (rest + 1) // 2
            out.add(f"c{rest} {word[p - (rest - half) :]}")
            out.add(f"d{rest} {word[:half]} {word[p:]}")
    return {f"{shorter} {key}" for key in out}


def near_pairs(counted: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): words at distance one, each pair once, a the shorter one or, of two equally long,
    the one that sorts first."""
    order = counted.sparkSession.sparkContext.broadcast(bigram_order(counted))  # 8,100 entries at most
    ddl = "key long, longer boolean, word string, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                places = rarest(word, order.value)
                for longer in (False, True):
                    for key in keys(word, places, len(word) - longer):
                        rows.append((xxhash.xxh64_intdigest(key) - (1 << 63), longer, word, n))
            columns = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow_type(ddl))], schema=arrow_type(ddl))

    found = counted.select("word", "n").mapInArrow(run, ddl)
    short = found.filter("not longer").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    other = found.select("key", "longer", F.col("word").alias("b"), F.col("n").alias("b_n"))
    # Spark takes the keys to be about as large as the words' compressed files and would broadcast them
    pairs = short.join(other.hint("merge"), "key").filter("longer or a < b")
    # the built-in distance gives -1 beyond its bound; equal words differ in length by none and aren't paired
    return pairs.filter(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every row of ``forms(word, form)``: the last word that its forms lead to.

    A form is twice as frequent as its word, so chains have at most 62 steps and no cycles; each round
    doubles the steps that a row has taken, and the loop ends when no row moves on. Compressed files are
    much smaller than their rows, so nothing here may be broadcast.
    """
    steps = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(7):
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if on.join(steps.hint("merge"), "root", "left_semi").isEmpty():
            break
        step = materialize(steps.join(on.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")
        remove(step.sparkSession, steps)
        steps = step
    return steps


def variants(docs: DataFrame, damage: int | None = 97, least: int = 3) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    counted = materialize(words(docs, damage, least), "spelling-words")
    pairs = near_pairs(counted)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n"))
    both = both.union(pairs.select(F.col("b"), F.col("a"), F.col("a_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    known = materialize(counted.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.n") >= 2 * F.col("n"), F.col("best")).alias("best")), "spelling-forms")
    known = known.select("word", F.col("best.near").alias("form"), "n", "n_near", (-F.col("best.n")).alias("form_n"))
    last = roots(known.filter("form is not null"))
    return known.join(last.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


SQL = r"""
WITH RECURSIVE byte_crc AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]{5,}')) AS run FROM documents),
o AS (SELECT run, hex(encode(d || ':' || run)) AS x, count(*) AS n FROM r GROUP BY ALL),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(x) // 2), lambda i: ('0x' || x[2 * i + 1 : 2 * i + 2])::BIGINT)),
        lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS h FROM o, byte_crc),
w AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
d AS MATERIALIZED (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS part FROM (SELECT *, unnest(range(0, length(word))) AS i FROM v)),
p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.i = b.i AND a.part = b.part AND a.word <> b.word AND length(a.word) = length(b.word)
      UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.part = v.word
      UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.part = v.word),
b AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM p GROUP BY word),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * v.n THEN near END AS form, CASE WHEN near_n >= 2 * v.n THEN near_n END AS form_n FROM v LEFT JOIN b USING (word)),
c AS (SELECT word, word AS root FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON c.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM f JOIN c ON c.word = f.word JOIN f g ON g.word = c.root AND g.form IS NULL
"""
