"""A training-data pipeline over `documents`: five stages, each of them one operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the docs of the next one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.llm import bpe, decontaminate, language, line_dedup, near_dedup
from mensura.llm.common import load, written
from mensura.llm.queries import tokenizer

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Predictions of less certainty are rejected; texts of one language are far above it, mixed ones near 0.4.
LEAST_SCORE = 0.25


def _aside(docs: DataFrame) -> DataFrame:
    """docs with all columns but doc_id and text under names that no operator's results have."""
    return docs.select(*[F.col(f"`{c}`") if c in ("doc_id", "text") else F.col(f"`{c}`").alias(f"of_document_{c}") for c in docs.columns])


def _like_documents(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs from what an operator made of _aside(docs), and n_chars as the text is now."""
    own = {c: F.col(c if c in ("doc_id", "text") else f"`of_document_{c}`") for c in docs.columns}
    if "n_chars" in own:
        own["n_chars"] = F.length("text").cast("long")
    return df.select(*[column.alias(c) for c, column in own.items()])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; null and letterless texts go."""
    model = language.train(docs.where(language.remainder("doc_id") != 2))
    judged = language.identify(_aside(docs), model)
    return _like_documents(judged.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)), docs)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of lines that occur earlier."""
    return _like_documents(line_dedup.remove_repeated(_aside(docs)), docs)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return _like_documents(near_dedup.near_duplicates(_aside(docs)).where("kept"), docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return _like_documents(decontaminate.find_contamination(_aside(docs), load(spark, sf_dir, "benchmark")).where(~F.col("contaminated")), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text, with what names a document."""
    return bpe.digests(docs, tokenizer("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("line_dedup", remove_repeated_lines),
    ("near_dedup", remove_near_duplicates),
    ("decontamination", remove_contaminated),
    ("bpe", encode),
]

#: Language models and similarity classes have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
