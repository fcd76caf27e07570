"""The corpus pipeline: documents through five of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the shared folder and reads it
back as the next stage's docs. A stage that learns does so from the documents it is given.

For every stage: null and empty texts are judged like any other text (they have no words), long texts are read whole, repeated rows
are judged alike, ties are broken as the stage's operator states, an empty table gives no rows, and columns of any other name are
carried along.
"""

from __future__ import annotations

from collections.abc import Callable

from callatlas.llm._common import durable, table
from callatlas.llm.decontamination import drop_contaminated
from callatlas.llm.mixing import mix
from callatlas.llm.quality import keep_good, train_quality
from callatlas.llm.secrets import redact_secrets, trained_on
from callatlas.llm.simhash import keep_representatives
from pyspark.sql import DataFrame, SparkSession

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Equal texts, null ones as empty, stay or go together."""
    return keep_good(docs, train_quality(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays (null last); null and empty texts are one
    group, and of rows with one doc_id and one text one stays."""
    return keep_representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go; null and empty texts hold none, equal texts go together."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced; n_chars becomes the new length. All documents stay, null and empty texts as they are."""
    return redact_secrets(docs, trained_on(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with size, target (of the source) and taken (words, repeats counted). Texts without words
    have no size and are not taken; documents of one doc_id share a threshold; columns of these names are replaced."""
    mixed = mix(docs, carry=True).where("taken > 0")
    return mixed.select(*(mixed["row"][c].alias(c) for c in docs.columns if c not in ("size", "source_size", "target", "taken")), "size", "source_size", "target", "taken")


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("mixing", mixing),
]

#: SQL can express neither the trained stages nor XXH64. The stages are held against brute-force versions one by one in tests/llm.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from the table documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs
