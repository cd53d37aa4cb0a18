"""A corpus pipeline of five stages; each reads what the one before has written.

Every stage takes ``(spark, docs, sf_dir)`` and all but the last return the columns
of ``documents``. A stage judges exactly the rows it is given.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barograph.llm import decontaminate, near_dup, packing, pii, toxicity
from barograph.llm.common import read_table, stored
from barograph.llm.spans import redacted


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels, does not reject."""
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter("not toxic").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies, short texts too, and rows without an id."""
    return near_dup.near_duplicates(docs, tail=True).filter("kept").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    found = decontaminate.contamination(docs, read_table(spark, sf_dir, "benchmark"))
    return found.filter("not contaminated").select(*docs.columns)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and disclosing terms replaced by their kind; ``n_chars`` follows the text."""
    found = pii.find_personal_data(docs)
    changed = found.withColumn("text", redacted(F.col("text"), F.col("private")))
    if "n_chars" in docs.columns:
        length = F.when(F.size("private") > 0, F.length("text")).otherwise(F.col("n_chars"))
        changed = changed.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", sanitise),
    ("packing", pack),
]

#: A trained classifier decides the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage over all documents; what each stage keeps is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
