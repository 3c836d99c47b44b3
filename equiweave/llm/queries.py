"""The registered query of each corpus operator, over its whole table and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equiweave.llm import bpe, chat, langid, linededup, minhash, mixing, quality, rules, topk, warc
from equiweave.llm.oracles import ORACLES as ORACLES
from equiweave.llm.shared import materialize, read_table, scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.word_report(read_table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(read_table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc-archives")
    warc.write(read_table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).drop("file", "offset")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read_table(spark, sf_dir, "documents"), with_ids=False)


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(read_table(spark, sf_dir, "documents"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    stored = materialize(chat.formatted(turns.unionByName(chat.demo(spark, turns))), "chat-pieces")
    return chat.read_back(stored, chat.examples(stored))


QUERIES: dict[str, Query] = {
    "op1_mixing": op1_mixing,
    "op2_line_dedup": op2_line_dedup,
    "op3_warc": op3_warc,
    "op4_language": op4_language,
    "op5_topk": op5_topk,
    "op6_quality": op6_quality,
    "op7_minhash": op7_minhash,
    "op8_bpe": op8_bpe,
    "op9_rules": op9_rules,
    "op10_chat": op10_chat,
}


