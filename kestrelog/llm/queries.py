"""One query per operator, over its whole tables, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelog.llm import bpe, collocations, decontaminate, html, huffman, jaccard, langid, licenses, linededup, pitmanyor, spelling, toxicity, trie
from kestrelog.llm.common import table


def remainder(modulus: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.bpe_round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents"), width=3, percent=90)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder(3) != 1)
    return toxicity.score(docs, model).select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = langid.profiles(docs, remainder(5) != 0)
    return langid.identify(docs, learned).select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.exact_groups(table(spark, sf_dir, "documents"), keep="max")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return huffman.read_ids(spark, huffman.write_ids(table(spark, sf_dir, "documents"), path, end_id=2))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pitmanyor.score(table(spark, sf_dir, "documents"), remainder(5) != 1)
    return out.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    found = [op1_bpe, op2_decontaminate, op3_jaccard, op4_toxicity, op5_line_dedup, op6_language, op7_main_text, op8_exact_dedup, op9_licenses, op10_token_ids, op11_spelling, op12_pitman_yor, op13_collocations, pipeline]
    return {f.__name__: f for f in found}


SQL = {
    "op5_line_dedup": linededup.SQL,
    "op11_spelling": spelling.SQL,
    "op13_collocations": collocations.SQL,
    "op8_exact_dedup": """
        WITH g AS (SELECT coalesce(text, '') AS t, max(doc_id) AS keep_id, count(*) AS group_size FROM documents GROUP BY 1)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(g.t) AS text_sha256
        FROM documents d JOIN g ON coalesce(d.text, '') = g.t""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
