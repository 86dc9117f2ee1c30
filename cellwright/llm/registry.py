"""Queries of the corpus operators over whole tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, licenses, media, mixing, neardup, sharding, suffixes, toxicity, urls
from .common import load


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(load(spark, sf_dir, "documents").select("doc_id"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(load(spark, sf_dir, "documents"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(load(spark, sf_dir, "conversations"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.report(load(spark, sf_dir, "documents"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(load(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(load(spark, sf_dir, "pages"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(load(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_sharding, op2_minhash, op3_chat, op4_decontamination, op5_suffixes, op6_media, op7_toxicity, op8_urls, op9_mixing, op10_licenses)
}


def oracles() -> dict[str, str]:
    return {"op1_sharding": sharding.sql(), "op3_chat": chat.SQL, "op4_decontamination": decontam.SQL, "op8_urls": urls.sql(), "op9_mixing": mixing.SQL, "op10_licenses": licenses.SQL}
