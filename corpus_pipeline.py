"""From raw documents to packed training sequences: five stages, each written as Parquet and read again.

1. ``quality``: documents that the classifier rejects go.
2. ``near_duplicates``: one document of each group of near duplicates stays, that of smallest id.
3. ``repeated_spans``: words of passages that an earlier document holds too are cut out of the text.
4. ``decontamination``: documents contaminated by the benchmark go.
5. ``packing``: what is left becomes sequences; one row for each piece.

Stages 1 to 4 return the columns of ``documents``; stage 3 also brings ``n_chars`` up to date.  Rows
whose ``doc_id`` is null pass stages 1, 2 and 4 by their text alone and are cut in stage 3 by nothing,
since no document has a smaller id.  Very long texts are read whole.  Columns may have any other names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quotelab.llm import debruijn, decontaminate, jaccard, packing, quality
from quotelab.llm.common import table, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the classifier accepts; a null or empty text is judged like any other."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates; rows without an id all stay."""
    return jaccard.one_of_each(docs)


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the words that ``substring_dedup`` removes."""
    return debruijn.without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is not contaminated; with an empty benchmark all stay."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the sequences that hold every document, empty ones too."""
    return packing.pack(docs, packing.tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("near_duplicates", near_duplicates),
    ("repeated_spans", repeated_spans),
    ("decontamination", decontamination),
    ("packing", packed),
]

#: The classifier and the tokenizer are no SQL; tests hold the stages against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of ``documents`` after all stages; an empty table gives none."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
