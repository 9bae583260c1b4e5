"""The registered queries of this subpackage, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import chat_format, embedding_dedup, exact_dedup, language_id, lexical_search, minhash_dedup, packing, piece_codec, quality_rules, resampling, secret_scan, token_counts, toxicity
from gridloom.llm.queries_sql import DRAWN, EQUAL_TEXTS, QUALITY, RANKED, SECRETS, SHINGLES, VECTORS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its own name."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query(QUALITY)
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query()
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = token_counts.histogram(token_counts.lengths(table(spark, sf_dir, "documents")))
    from gridloom.llm.shared import stored

    return token_counts.suffix_sums(stored(hist, "lengths"))


@query(SECRETS)
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = secret_scan.scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(*[r.kind for r in secret_scan.RULES if r.base]))
    counts = [_count(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    return spans.select(
        F.col("row.doc_id").alias("doc_id"), *counts, F.sha2(secret_scan.listed(base), 256).alias("base_sha256"),
        secret_scan.listed(F.col("spans")).alias("spans"))


def _count(kind: str):
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


@query()
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(language_id.sample(docs))
    return language_id.identified(docs, model, keep=["doc_id"]).select(
        F.col("row.doc_id").alias("doc_id"), language_id.held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")


@query()
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = toxicity.train(toxicity.sample(docs, labels))
    return toxicity.scored(docs, model, keep=["doc_id"]).select(
        F.col("row.doc_id").alias("doc_id"), toxicity.held_out(F.col("row.doc_id")).alias("held_out"), "score", "predicted")


@query()
def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = piece_codec.coded(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return coded.select(F.col("row.doc_id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


@query(SHINGLES)
def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = minhash_dedup.Settings(words=3, percent=85)
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), settings=settings)


@query(VECTORS)
def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query()
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.repaired(table(spark, sf_dir, "conversations"))


@query(DRAWN)
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_features", "weight", "score", "rank")


@query(RANKED)
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("row.item_id").alias("item_id"), "rank", "doc_id", "score")


@query(EQUAL_TEXTS)
def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    equal = exact_dedup.equal_texts(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return equal.select(F.col("row.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")
