"""Operator 13: collocations from weighted n-gram counts.

Texts are cut into pieces; identical pieces of a language become one with a multiplicity, so copies are
counted by weight and not again. Distinct pieces stand in chunks of a bounded size. DuckDB counts each
chunk's weighted words and bigrams, packed by hash bucket; one task a bucket sums them in DuckDB, which
spills beyond its memory limit. The bucket answers every chunk with those of its bigrams that are frequent
in the whole table: a longer phrase is frequent only if all its bigrams are, so chunks then count three and
four words over frequent bigrams alone, and buckets sum these in the same way. All counts are exact.

Each candidate looks up the counts of its parts by requests that are shuffled to where the part's count
stands. A chunk, a bucket's table in DuckDB and a row are bounded or spill; nothing is broadcast.

Null texts have no pieces, a null lang is ``und``. Repeated rows count as often as they stand, very long
texts and pieces are read whole (a piece longer than a chunk is a chunk of its own), an empty table gives
no rows, and other columns are ignored. Ties are broken by the contract: the smaller cut, then a, then the
phrase in UTF-8 byte order.
"""

from __future__ import annotations

import contextlib
import tempfile
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrelog.llm.common import arrow_type, materialize, remove

#: What ends a piece (fixed value).
ENDS = r"[.,;:!?\x0A-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of a chunk of pieces, characters of pieces to a bucket, and the most buckets.
CHUNK, BUCKET, MOST_BUCKETS = 8_000_000, 16_000_000, 4096
#: DuckDB's memory in a task; what doesn't fit spills to the task's own folder and goes with it.
MEMORY = "256MB"
PACKED = "bucket int, chunk long, data binary"


@contextlib.contextmanager
def _database() -> Iterator[duckdb.DuckDBPyConnection]:
    with tempfile.TemporaryDirectory(prefix="kestrelog-duckdb-") as folder, duckdb.connect(":memory:") as db:
        db.execute(f"SET threads = 1; SET memory_limit = '{MEMORY}'; SET temp_directory = '{folder}'; SET preserve_insertion_order = false")
        yield db


def _pack(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _unpack(data) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(data.as_buffer())).read_all()


def _split(table: pa.Table, by: str) -> Iterator[tuple[int, pa.Table]]:
    """The rows of ``table`` for each value of its whole-number column ``by``."""
    keys = table.column(by).to_numpy()
    order = np.argsort(keys, kind="stable")
    keys, table = keys[order], table.drop_columns([by]).take(pa.array(order))
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, int)
    for a, b in zip(first, np.r_[first[1:], len(keys)]):
        yield int(keys[a]), table.slice(a, b - a).combine_chunks()


def _rows(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    schema = arrow_type(ddl)
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def pieces(docs: DataFrame) -> DataFrame:
    """(lang, piece, m): distinct pieces, their words joined by one space, and how often they stand."""
    low = F.translate("text", UPPER, LOWER)
    parts = docs.filter("text is not null").select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.explode(F.split(low, ENDS, -1)).alias("piece"))
    parts = parts.select("lang", F.trim(F.regexp_replace("piece", r"[ \t]+", " ")).alias("piece")).filter("piece <> ''")
    return parts.groupBy("lang", "piece").agg(F.count("*").alias("m"))


def _chunks(found: DataFrame, size: int) -> DataFrame:
    """(chunk, n_chars, data): pieces packed in chunks of about ``size`` characters."""
    ddl = "chunk long, n_chars long, data binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # partition and ordinal: one task's chunks are written once, with the table
        base, n, held, chars = (TaskContext.get().partitionId() << 32), 0, [], 0
        for batch in batches:
            sizes = np.cumsum(pc.utf8_length(batch.column(1)).to_numpy())
            begin = 0
            while begin < batch.num_rows:
                before = sizes[begin - 1] if begin else 0
                end = max(int(np.searchsorted(sizes, before + size - chars, "right")), begin + 1)
                end = min(end, batch.num_rows)
                held.append(batch.slice(begin, end - begin))
                chars += int(sizes[end - 1] - before)
                begin = end
                if chars >= size or begin < batch.num_rows:
                    yield _rows([(base + n, chars, _pack(pa.Table.from_batches(held)))], ddl)
                    n, held, chars = n + 1, [], 0
        if held:
            yield _rows([(base + n, chars, _pack(pa.Table.from_batches(held)))], ddl)

    return materialize(found.select("lang", "piece", "m").mapInArrow(run, ddl), "collocation-chunks")


def _short(buckets: int):
    """Weighted words and bigrams of each chunk, packed by bucket. The empty phrase counts all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                held = _unpack(data)
                with _database() as db:
                    db.register("held", held)
                    counted = db.sql(f"""
                        WITH t AS (SELECT lang, m, string_split(piece, ' ') AS w FROM held),
                        g AS (SELECT lang, m, unnest(w) AS phrase FROM t
                              UNION ALL SELECT lang, m, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM t
                              UNION ALL SELECT lang, m * len(w), '' FROM t)
                        SELECT lang, phrase, sum(m)::BIGINT AS n, (hash(lang, phrase) % {buckets})::INT AS bucket FROM g GROUP BY lang, phrase""").to_arrow_table()
                for bucket, part in _split(counted, "bucket"):
                    yield _rows([(bucket, chunk, _pack(part))], PACKED)

    return run


def _long(buckets: int):
    """Weighted phrases of three and four words over frequent bigrams, of each chunk, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data, answers in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                held, frequent = _unpack(data), pa.concat_tables([_unpack(a) for a in answers])
                with _database() as db:
                    db.register("held", held)
                    db.register("frequent", frequent)
                    db.execute("""
                        CREATE TABLE pair AS SELECT * FROM (SELECT lang, m, id * 4294967296 + i AS place, w[i] || ' ' || w[i + 1] AS phrase, w[i + 1] AS last FROM (
                            SELECT row_number() OVER () AS id, lang, m, w, unnest(range(1, len(w))) AS i FROM (SELECT lang, m, string_split(piece, ' ') AS w FROM held)))
                        SEMI JOIN frequent USING (lang, phrase)""")
                    counted = db.sql(f"""
                        WITH three AS (SELECT a.lang, a.m, a.place, a.phrase || ' ' || b.last AS phrase FROM pair a JOIN pair b ON b.place = a.place + 1),
                        g AS (SELECT lang, m, phrase FROM three UNION ALL SELECT a.lang, a.m, a.phrase || ' ' || b.last FROM three a JOIN pair b ON b.place = a.place + 2)
                        SELECT lang, phrase, sum(m)::BIGINT AS n, (hash(lang, phrase) % {buckets})::INT AS bucket FROM g GROUP BY lang, phrase""").to_arrow_table()
                for bucket, part in _split(counted, "bucket"):
                    yield _rows([(bucket, chunk, _pack(part))], PACKED)

    return run


def _summed(packed: DataFrame, buckets: int, least: int, answer: bool) -> DataFrame:
    """(lang, phrase, n) with n >= ``least``, chunk null; with ``answer`` also (chunk, data) rows, the
    frequent bigrams that each chunk has."""
    ddl = "lang string, phrase string, n long, chunk long, data binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _database() as db:
            db.execute("CREATE TABLE part (chunk BIGINT, lang VARCHAR, phrase VARCHAR, n BIGINT)")
            for batch in batches:
                for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                    held = _unpack(data)
                    db.execute(f"INSERT INTO part SELECT {chunk}, lang, phrase, n FROM held")
            db.execute(f"CREATE TABLE total AS SELECT lang, phrase, sum(n)::BIGINT AS n FROM part GROUP BY lang, phrase HAVING sum(n) >= {least}")
            for found in db.sql("SELECT lang, phrase, n, NULL::BIGINT AS chunk, NULL::BLOB AS data FROM total").to_arrow_reader(100_000):
                yield found.cast(arrow_type(ddl))
            if answer:
                for (chunk,) in db.execute("SELECT DISTINCT chunk FROM part").fetchall():
                    had = db.sql(f"SELECT lang, phrase FROM part SEMI JOIN total USING (lang, phrase) WHERE chunk = {chunk} AND contains(phrase, ' ')").to_arrow_table()
                    if had.num_rows:
                        yield _rows([(None, None, None, chunk, _pack(had))], ddl)

    return packed.repartition(buckets, "bucket").select("chunk", "data").mapInArrow(run, ddl)


def phrase_counts(docs: DataFrame, least: int = 30, chunk: int = CHUNK) -> DataFrame:
    """(lang, phrase, n): phrases of one to four words with at least ``least`` occurrences, and the empty
    phrase, which counts all words of the language."""
    chunks = _chunks(pieces(docs), chunk)
    total = chunks.agg(F.sum("n_chars")).first()[0] or 0
    buckets = int(min(max(total // BUCKET, 8), MOST_BUCKETS))
    short = materialize(_summed(chunks.select("chunk", "data").mapInArrow(_short(buckets), PACKED), buckets, least, True), "collocation-short")
    answers = short.filter("chunk is not null").groupBy("chunk").agg(F.collect_list("data").alias("answers"))
    asked = chunks.select("chunk", "data").join(answers, "chunk").select("chunk", "data", "answers")
    long = materialize(_summed(asked.mapInArrow(_long(buckets), PACKED), buckets, least, False), "collocation-long")
    remove(docs.sparkSession, chunks)
    return short.filter("chunk is null").select("lang", "phrase", "n").union(long.select("lang", "phrase", "n"))


def _between(a, b):
    """Words a to b (from 1, both included) of the column w, as a phrase."""
    return F.array_join(F.slice("w", a, b - a + 1), " ")


def collocations(docs: DataFrame, least: int = 30, inside: int = 80, first: int = 2000, chunk: int = CHUNK) -> DataFrame:
    """Each language's ``first`` collocations: lang, rank, phrase, a, l, r, n, score.

    A candidate goes where a longer one around it has at least ``inside`` hundredths of its occurrences.
    """
    counts = phrase_counts(docs, least, chunk)
    found = counts.filter("instr(phrase, ' ') > 0").select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    k, wide = F.size("w"), "decimal(38,0)"

    cuts = F.transform(F.sequence(F.lit(1), k - 1), lambda i: F.struct(i.alias("cut"), F.array(_between(F.lit(1), i), _between(i + 1, k)).alias("parts")))
    requests = found.select("lang", "phrase", "a", F.explode(cuts).alias("c")).select("lang", "phrase", "a", "c.cut", F.posexplode("c.parts").alias("side", "part"))
    parts = counts.filter("phrase <> ''").select("lang", F.col("phrase").alias("part"), F.col("n").alias("found"))
    answered = requests.join(parts, ["lang", "part"]).groupBy("lang", "phrase", "a", "cut")
    answered = answered.agg(F.max(F.when(F.col("side") == 0, F.col("found"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("found"))).alias("r"))
    score = F.expr("cast((2000000 * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as long)")
    scored = answered.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("s"))

    within = F.expr("flatten(transform(sequence(2, size(w) - 1), n -> transform(sequence(1, size(w) - n + 1), i -> array_join(slice(w, i, n), ' '))))")
    around = found.filter(k > 2).select("lang", "a", F.explode(within).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(around, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer").cast(wide) < inside * F.col("a").cast(wide)))
    kept = kept.select("lang", "phrase", "a", "s.l", "s.r", "s.score")

    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*best)  # a language may hold most rows
    kept = kept.withColumn("rank", F.row_number().over(share)).filter(F.col("rank") <= first)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).filter(F.col("rank") <= first)
    return kept.join(counts.filter("phrase = ''").select("lang", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH t AS MATERIALIZED (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i : i + k - 1])) AS p FROM t, (SELECT unnest(range(1, 5)) AS k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, p, count(*) AS a FROM g GROUP BY lang, k, p HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM t GROUP BY lang),
c AS (SELECT f.lang, f.k, f.p, f.a, j, l.a AS l, r.a AS r, ((2000000::HUGEINT * f.a) // (l.a + r.a))::BIGINT AS score
      FROM (SELECT *, unnest(range(1, k)) AS j FROM f WHERE k > 1) f
      JOIN f l ON l.lang = f.lang AND l.p = f.p[1 : f.j] JOIN f r ON r.lang = f.lang AND r.p = f.p[f.j + 1 : f.k]),
s AS (SELECT lang, k, p, a, first(row(score, l, r) ORDER BY score, j) AS s FROM c GROUP BY lang, k, p, a),
i AS (SELECT lang, p[b : e] AS p, max(a) AS longer FROM (SELECT *, unnest(range(b + 1, k + 1)) AS e FROM (SELECT *, unnest(range(1, k)) AS b FROM f WHERE k > 2)) WHERE e - b + 1 < k GROUP BY ALL),
o AS (SELECT s.lang, array_to_string(s.p, ' ') AS phrase, s.a, s.s[2] AS l, s.s[3] AS r, s.s[1] AS score FROM s LEFT JOIN i ON i.lang = s.lang AND i.p = s.p WHERE longer IS NULL OR 100 * longer < 80 * s.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) QUALIFY rank <= 2000
"""
