"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gridlark.llm import bpe, conversations, hamming, lines, neardup, packing, secrets, spelling, substring, suffixes, tokenbin, toxicity, urls

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Builder], Builder]:
    def add(build: Builder) -> Builder:
        QUERIES[name] = build
        if oracle:
            ORACLES[name] = oracle
        return build

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op3_best_fit_packing")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, size=4096)


@query("op5_bpe_round_trip")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op6_secret_scan", secrets.ORACLE)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.summary(secrets.find(table(spark, folder, "documents")))


@query("op8_token_files")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    manifest = tokenbin.write(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return tokenbin.read(manifest)


@query("op4_url_filter", urls.ORACLE)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(table(spark, folder, "pages"))


@query("op9_exact_top_k", hamming.ORACLE)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return hamming.search(vectors, vectors.where("vec_id % 20 = 0"), k=10)


@query("op10_line_quality", lines.ORACLE)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return lines.judge(table(spark, folder, "documents"))


@query("op2_toxicity")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return toxicity.score(documents, toxicity.fit(documents, table(spark, folder, "labels")))


@query("op7_near_duplicates", neardup.ORACLE)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"), k=4).drop("key_id")


@query("op1_substring_dedup", substring.ORACLE)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return substring.digests(table(spark, folder, "documents"))


@query("op11_conversation_repair")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.audit(conversations.damage(table(spark, folder, "conversations")))


@query("op12_spelling_variants")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))


@query("op13_suffix_dedup", suffixes.ORACLE)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.digests(table(spark, folder, "documents"))
