"""A training corpus in five stages: language, quality, near copies, benchmark passages, token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, contamination, jaccard, langid, quality
from tidemark.llm.common import cut, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _whole(docs: DataFrame) -> DataFrame:
    """All columns as one struct beside the text, so that no column name can clash with a result's."""
    return docs.select(F.struct(F.lit(True).alias("given"), *(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")


def _back(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*(F.col(f"row.`{c}`") for c in docs.columns))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters, in a language that the labelled documents show.

    Null and empty texts have no letters and go. Every row is judged by itself: repeated rows and ids, null ids and further
    columns of any name stay as they are. Where no document has a language none is known and all go; an empty table
    stays empty.
    """
    model = langid.train(docs, "text", "lang")
    return _back(langid.identify(_whole(docs), model, keep=["row"]).where("not rejected"), docs)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranking puts at or above its threshold; ties with it stay.

    Null and empty texts are ranked as texts without features. Without labels of both kinds all rows rank the same.
    Repeated rows, null ids and further columns of any name stay as they are; an empty table stays empty.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return _back(quality.rate(_whole(docs), model, keep=["row"]).where("predicted = 1"), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more: the smallest doc_id.

    Ties of id go by text hash, and rows of one id and text (null counts as empty) are one. Null and empty texts are linked with nothing and
    stay; a null id is smaller than any other. Further columns of any name stay as they are; an empty table stays empty.
    """
    return jaccard.one_of_each(docs, k=5, num=80, den=100)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of a benchmark item.

    Null and empty texts have no words and stay, as do all where there are no items. Repeated rows, null ids and further
    columns of any name stay as they are; an empty table stays empty.
    """
    return contamination.clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their text as ids, n_tokens, and whether the ids decode to the text (round_trip).

    Null and empty texts have no ids. All other columns stay as they are, but for those with a result's name, which give
    way. Repeated rows stay; an empty table stays empty.
    """
    ids = bpe.encode(docs, TOKENIZER, round_trip="round_trip")
    others = [f"`{c}`" for c in docs.columns if c not in ("text", "ids", "n_tokens", "round_trip")]
    return ids.select(*others, "ids", F.size("ids").cast("long").alias("n_tokens"), "round_trip")


STAGES = [("language_id", known_language), ("quality", good_quality), ("near_copies", near_copies), ("decontamination", decontaminated), ("bpe", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learned stages have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None
