"""From raw documents to packed training sequences: five stages, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and gives a frame; all but the last give the columns of docs. Rows may have nulls in any column,
empty and very long texts, repeated rows and ids, and further columns of any name, which are carried along. An empty table stays empty
(with no trained model nothing is rejected but texts without a letter). docs must be a table or a checkpoint: stages read it more than
once and know rows by their place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from twinfold.llm import langid, mixing, neardup, packing, quality
from twinfold.llm.common import fresh, pinned, table
from twinfold.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the identifier accepts; texts without letters (null and empty ones too) and predictions below its calibrated score go."""
    names = tuple(fresh(docs.columns, "predicted", "score", "accepted"))
    return langid.predict(docs, langid.fit(docs), keep=tuple(docs.columns), names=names).filter(names[2]).select(*docs.columns)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within their language's perplexity threshold; each row is judged by itself, texts without symbols stay, and all stay without trusted text."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest id: five-word shingles, similarity of 0.8 or more. Texts without words all stay."""
    return neardup.deduplicated(docs, width=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it: not at all, or up to three times. Texts without words are never taken; a null source is one of its own."""
    return mixing.apply_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All pieces with their sequence and place; a null text is empty and has its closing id alone."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("language ID", language), ("quality classifier", quality_filter), ("MinHash near-dedup", near_dedup), ("mixing sources", mix), ("best-fit packing", pack)]

#: The stages train models and draw at random: SQL cannot express them. tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, in order; each one's rows are pinned, so no later stage computes them again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = pinned(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
