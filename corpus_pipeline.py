"""A training corpus from `documents`, in five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import mixing, near_texts, packing, recompression, toxicity
from tidewell.llm.shared import spool, table

#: Share of the tokens that reach the mixing stage that it keeps.
SHARE = 0.8


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the columns stay as they are, whatever their names.

    A null or empty text scores like one without evidence. Rows that repeat a doc_id or a text are judged each; rows with a null doc_id stay. An empty table stays empty.
    """
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (0.8 or more of their five-word shingles in common) the document with the smallest id stays.

    Texts of fewer than five words are copies where all their words agree, null and empty ones of each other. Rows that repeat an id stand or fall together, ties are theirs; rows with a null id stay. An
    empty table stays empty, and columns of any names come through.
    """
    return near_texts.keep_first(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a document with a smaller id holds are cut from the texts; no document goes, one that loses all its words keeps an empty text.

    A null text stays null. Rows that repeat an id are one place in the order and cut nothing from each other. Very long texts are cut like others; an empty table stays empty; columns of any names come through.
    """
    return recompression.remove_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Domains, languages and sources are brought to their target weights: whole documents go, by a seeded order within each leaf.

    Null names count as empty ones, null texts as without tokens; rows that repeat an id stand or fall together, ties in the order going by id; rows with a null id go, having no place in it. An empty table stays
    empty, and columns of any names come through.
    """
    return mixing.keep_mixture(docs, SHARE)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences: a row a piece, with its token ids.

    A null text is empty: its document is the end id alone. Rows that repeat an id, and equal texts, are packed each, and so are rows with a null id. Very long texts are cut; an empty table gives no rows; other columns than
    doc_id and text are not looked at.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), carry=True)


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("substring_dedup", repeats), ("mixing", mix), ("packing", pack)]

#: SQL can express neither the scores nor the fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir: the rows of the last one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = spool(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
