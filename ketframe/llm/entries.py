"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ketframe.llm import chroma, decontaminate, html_text, langid, line_dedup, minhash, packing, secrets_scan, suffix_dedup, token_counts, twins
from ketframe.session import saved


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def excerpts(vectors: DataFrame) -> DataFrame:
    """Another recording of each twentieth one, so that there is something to be found: 48 of its 64 notes from the ninth on, each a little off; its id is -1 - vec_id."""
    off = lambda v, i: v + F.when(F.pmod(F.xxhash64("vec_id", i), F.lit(16)) == 0, 0.012).otherwise(0.001)
    return vectors.filter("vec_id % 20 = 0").select((-1 - F.col("vec_id")).alias("vec_id"), F.transform(F.slice("embedding", 9, 48), off).cast("array<float>").alias("embedding"))


def op1_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, column = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), {"rec_id": "vec_id", "pcm": "embedding", "decode": chroma.sound_of}
    played = saved(chroma.measured(vectors, **column), "played")
    return chroma.align(chroma.prints_of(played.union(chroma.measured(excerpts(vectors), **column)), chroma.cuts_of(played)))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    out = langid.identify(docs, langid.learn(docs))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_read(spark, sf_dir, "documents"), least_words=1)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return secrets_scan.scan(docs, secrets_scan.learn(docs), path="source")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(_read(spark, sf_dir, "pages"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_chroma, op2_language_id, op3_minhash, op4_decontamination, op5_line_dedup, op6_token_counts, op7_secret_scan, op8_packing, op9_suffix_dedup, op10_html_text)}


def oracle_sql() -> dict[str, str]:
    """The others have no twin: models, tokenisers, suffix arrays, HTML and edit distances are beyond SQL; tests hold them against brute force."""
    return {"op3_minhash": twins.OP3, "op4_decontamination": twins.OP4}
