"""One query per operator on its whole table, with SQL where SQL can express it."""

from __future__ import annotations

from fieldbook.llm import bpe, decontam, embeddings, langid, licenses, linededup, sharding, simhash, toxicity, warc

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def _table(spark, sf: str, name: str):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@_query("op1_license_scan", licenses.oracle_sql())
def op1(spark, sf):
    return licenses.license_scan(_table(spark, sf, "documents"), "doc_id", "text")


@_query("op2_simhash_near_dedup")
def op2(spark, sf):
    return simhash.near_duplicates(_table(spark, sf, "documents"), "doc_id", "text")


@_query("op3_warc_round_trip", warc.SQL)
def op3(spark, sf):
    return warc.round_trip(_table(spark, sf, "pages"), "page_id", "url", "html")


@_query("op4_line_dedup", linededup.SQL)
def op4(spark, sf):
    return linededup.line_dedup(_table(spark, sf, "documents"), "doc_id", "text")


@_query("op5_sharding")
def op5(spark, sf):
    return sharding.shard(_table(spark, sf, "documents"), "doc_id", "text", 16)


@_query("op6_embedding_near_dedup", embeddings.SQL)
def op6(spark, sf):
    return embeddings.near_duplicates(_table(spark, sf, "embeddings"), "vec_id", "embedding", "label")


@_query("op7_benchmark_decontamination", decontam.SQL)
def op7(spark, sf):
    return decontam.contamination(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"), "doc_id", "text", "item_id", "text")


@_query("op8_toxicity")
def op8(spark, sf):
    return toxicity.toxicity(_table(spark, sf, "documents"), _table(spark, sf, "labels"), "doc_id", "text", "toxic")


def public_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The text of an installed public vocabulary file, read on the driver."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


@_query("op9_bpe_encoding")
def op9(spark, sf):
    return bpe.token_digests(_table(spark, sf, "documents"), public_vocabulary(), "doc_id", "text")


@_query("op10_language_id")
def op10(spark, sf):
    return langid.language_ids(_table(spark, sf, "documents"), "doc_id", "text", "lang").drop("bits_per_byte")
