"""The corpus operators as registered queries: (spark, sf_dir) -> DataFrame over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.llm.bpe import decode, encode
from gridlark.llm.common import table
from gridlark.llm.html_text import extract_text
from gridlark.llm.licenses import license_scan
from gridlark.llm.media import read_media, text_to_media
from gridlark.llm.oracle import SQL
from gridlark.llm.packing import pack_documents
from gridlark.llm.quality import quality
from gridlark.llm.secret_scan import KINDS, secret_scan, spans_string
from gridlark.llm.simhash import near_duplicates
from gridlark.llm.suffixes import remove_repeats
from gridlark.llm.token_counts import token_counts


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    stored = text_to_media(docs, keep=["doc_id", "n_bytes"])
    return read_media(stored, keep=["doc_id", "n_bytes"])


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "base", "licenses")
    labels = lambda *of: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.array(*(F.transform(x, lambda d: d["label"]) for x in of))))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda d: d["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda d: d["start"])).cast("long").alias("last_word"),
        labels("base").alias("base_labels"),
        labels("base", "licenses").alias("labels"),
        (F.coalesce(F.array_max(F.transform("licenses", lambda d: d["priority"])), F.lit(0)) / 5).alias("score"),
    )


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("remaining", 256).alias("kept_sha256"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets")
    base = F.filter("secrets", lambda s: s["rank"] < len(KINDS))

    def count(rank: int) -> Column:
        return F.size(F.filter("secrets", lambda s: s["rank"] == rank)).cast("long")

    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)),
        F.sha2(spans_string(base).cast("binary"), 256).alias("base_sha256"),
        spans_string(F.col("secrets")).alias("spans"),
    )


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return decode(ids).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_media_columns": op2_media_columns,
        "op3_license_scan": op3_license_scan,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_simhash": op6_simhash,
        "op7_secret_scan": op7_secret_scan,
        "op8_html_text": op8_html_text,
        "op9_bpe": op9_bpe,
        "op10_quality_rules": op10_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    """The others hash by XXH64, encode by a tokenizer or choose freely, which SQL can't express; tests hold them against brute force."""
    return dict(SQL)
