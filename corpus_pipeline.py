"""Cleaning of a document table in stages; each stage reads what the one before it wrote.

The ids that a stage rejects are found first and sent to the rows if they are few, so texts are not shuffled beside the search.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochwise.llm import decontaminate, jaccard, pii, sentencepiece, toxicity
from epochwise.llm.base import TEXT_ROWS, table
from epochwise.operators.ranks import small_side
from epochwise.session import ARROW_ROWS, scratch_path

#: Documents at or above this score are rejected, as op8 predicts them.
TOXIC = 0.5
#: Words of a shingle for near-duplicates in the pipeline.
SHINGLE = 5


def _small_batches(spark: SparkSession) -> None:
    """Python tasks of the session get TEXT_ROWS texts at a time, unless it sets another number itself; a stage's plan runs after it returns."""
    if spark.conf.get(ARROW_ROWS, "10000") == "10000":
        spark.conf.set(ARROW_ROWS, str(TEXT_ROWS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score is below TOXIC; the fit uses the labels table.  The score joins a row by id, the lowest of an id's rows
    would be wrong for one of them, so an id is rejected if any of its rows is.  Rows without an id stay."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    bad = small_side(toxicity.scored(docs, model).where(F.col("score") >= TOXIC).select(F.col("doc_id").alias("__id")).distinct(), TEXT_ROWS)
    return docs.join(bad, docs["doc_id"] == bad["__id"], "left_anti")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts whose shingle sets are alike: the one with the smallest id.  Candidates are texts whose
    SimHash fingerprints are linked by ball hashing, as in op1, and texts that share minimum hashes; both are verified on whole
    sets.  Rows that share an id but are not alike all stay, whatever their id."""
    return jaccard.without_copies(docs, size=SHINGLE)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no benchmark item is found; rows without an id stay."""
    _small_batches(spark)
    hits = decontaminate.matches(docs, table(spark, sf_dir, "benchmark"))
    bad = small_side(hits.select(F.col("doc_id").alias("__id")).distinct(), TEXT_ROWS)
    return docs.join(bad, docs["doc_id"] == bad["__id"], "left_anti")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data in the text replaced by its kind; n_chars counts the new text."""
    masked = pii.redact(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else masked


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids, scores, decoded): the ids of each text, the scores of its best segmentations, its text again."""
    _small_batches(spark)
    found = sentencepiece.encoded(docs, sentencepiece.default_model())
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), "ids", "scores", "decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("pieces", encode_pieces),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
