"""The corpus pipeline: quality, near-duplicates, repeated passages, mixture, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and
read again as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from callweave.llm import bpe, cdc, mixing, rules, simhash
from callweave.llm.common import shared_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the rule ensemble rejects; it is fitted on the labelled ones of ``docs``.

    Null and blank texts are rejected; nulls elsewhere, further columns of any name (not returned),
    and texts of any length make no difference. Repeated rows are judged alike. Without labels of
    both kinds every text that isn't blank stays. An empty table gives an empty result.
    """
    return rules.keep(docs, table(spark, sf_dir, "labels")).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates, the one of least id.

    Rows with a null id or a null or empty text are in no group and stay, as do repeated rows of a
    document that stays. Texts are compared whole; ties can't arise, as rows of one id are one
    document. Further columns of any name are not returned. An empty table gives an empty result.
    """
    return simhash.dedup(docs).select(COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated passages out of all but their first document, the one of least id.

    No row is dropped: a text may end up empty, and ``n_chars`` stays that of the document as it
    came. Rows with a null id or a null or empty text stay as they are; rows equal in id and text
    lose the same. Long texts are read whole. Further columns of any name are not returned. An empty
    table gives an empty result.
    """
    return cdc.dedup(docs).select(COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw the mixture of sources; rows are laid out by shard and in its order.

    Rows with a null source form a source. Nulls elsewhere, empty and long texts are carried
    unchanged; repeated rows are rows of their own, in any order among themselves. Further columns
    of any name are not returned. An empty table gives an empty result.
    """
    return mixing.laid_out(mixing.mix(docs.select(COLUMNS))).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, one row for each.

    A null text has null ids, an empty one an empty list; texts of any length are encoded whole, and
    repeated rows give repeated results. Further columns are not read. An empty table gives an empty
    result.
    """
    return bpe.encode(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mixture", mixture), ("tokens", tokens)]
#: The fitted model and the tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; what lies between them goes to the shared folder, where the
    last stage's input has to stay until the result has been read."""
    base = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{k}")
            docs = spark.read.parquet(f"{base}/{k}")
    return docs
