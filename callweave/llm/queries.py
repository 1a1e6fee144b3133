"""Queries over the training-data operators and, where SQL can say it, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from callweave.llm import bpe, cdc, chat, crf, embed, htmlx, mixing, rules, simhash, tokencount
from callweave.llm.common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each near-duplicate with the document of its group that stays."""
    return simhash.duplicates(table(spark, sf_dir, "documents"))


def op2_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that line labelling keeps, with their content share."""
    return crf.keep(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best branches of every conversation's reply tree, formatted."""
    return chat.conversations(chat.threads(table(spark, sf_dir, "conversations")))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page along its host's path."""
    return htmlx.extract(table(spark, sf_dir, "pages"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture, laid out in shards."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after its edits."""
    return tokencount.recount(tokencount.with_edits(table(spark, sf_dir, "documents")))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that lose a repeated passage, and what stays of them."""
    return cdc.changed(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, decoded again."""
    return bpe.encode(table(spark, sf_dir, "documents"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every vector, joined by cosines that reach the threshold, and its number of links."""
    return embed.classes(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the rule ensemble keeps, with their scores."""
    docs = table(spark, sf_dir, "documents")
    return rules.keep(docs, table(spark, sf_dir, "labels")).select("doc_id", "quality_score")


QUERIES = {f.__name__: f for f in (op1_simhash, op2_crf, op3_chat, op4_html, op5_mixing, op6_token_counts, op7_substring_dedup, op8_bpe, op9_embeddings, op10_rules)}
ORACLE_SQL: dict[str, str] = {"op3_chat": chat.SQL, "op9_embeddings": embed.SQL}
