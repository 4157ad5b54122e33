"""A training-data pipeline over ``documents``: each stage calls one operator.

Stages get (spark, docs, sf_dir), where docs is what the stage before kept, and
return a DataFrame. All but the last return the columns of ``documents``. Null
ids cannot be named by a verdict, so such rows stay (but for language ID,
which judges rows). Rows with equal ids share the verdicts of stages 3 and 4.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgrove.llm import decontaminate, langid, line_dedup, near_dedup, packing
from corpusgrove.llm.util import held_out, load, materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: below this no language is likelier than all others together
MIN_LANGUAGE_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and texts of no clear language."""
    model = langid.fit(docs.where(held_out("doc_id", 5) != 0))
    out = model.predict(docs, carry=COLUMNS)
    return out.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select("rest.*")


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of the texts; n_chars follows."""
    out = line_dedup.line_dedup(docs, carry=("lang", "source"))
    return out.select("doc_id", F.col("kept_text").alias("text"), "rest.lang", "rest.source", F.length("kept_text").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near copies."""
    gone = near_dedup.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    hits = decontaminate.find_contaminated(docs, load(spark, sf_dir, "benchmark"))
    return docs.join(materialize(hits.select("doc_id").distinct()), "doc_id", "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("line_dedup", repeated_lines), ("near_dedup", near_duplicates), ("decontamination", decontamination), ("packing", pack)]

#: models and hashing are beyond SQL; tests/llm compares every stage with a plain version, and checks columns and edge cases
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
