"""The corpus pipeline: five text operators in a row.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``. All stages but the last
return the columns of ``documents``; ``n_chars``, where it exists, follows a
text that a stage changes. Every stage judges its own input: all of it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from astroloom.llm import decontamination, linededup, pieces, simhash, toxicity
from astroloom.llm.common import delete, id_key, made, settle, shared_dir, sweep, table, text_key


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_column(docs, model)
    return scored.where(F.col("score") < toxicity.THRESHOLD).select("row.*")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shared lines go from all documents but their keeper."""
    found = linededup.dedup_lines(docs)
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("text"))
        elif c == "n_chars":
            columns.append(n_chars.cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(f"row.`{c}`").alias(c))
    return found.select(*columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays: the one with the smallest id, of rows
    that share that id (or have none) the one with the smallest text key. Rows
    in different components each stay, whatever their ids."""
    key = ["id", "k1", "k2"]
    k1, k2 = text_key(F.col("text"))
    own = [id_key(F.col("doc_id")).alias("id"), k1.alias("k1"), k2.alias("k2")]
    keep = settle(simhash.survivors(docs))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, *own).join(keep, key, "left_semi")
    # Rows that repeat both id and text.
    repeats = docs.select(*own).groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").join(keep, key, "left_semi")
    repeats = settle(repeats.select(*key))
    if repeats.isEmpty():
        return rows.select("row.*")
    ones = rows.join(repeats, key, "left_anti")
    order = F.struct(F.col("row.text").isNull(), F.xxhash64(F.col("row").cast("string")))
    some = rows.join(repeats, key, "left_semi").groupBy(*key).agg(F.min_by("row", order).alias("row"))
    return ones.select("row").unionByName(some.select("row")).select("row.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    found = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")).where(F.col("n_hit") == 0)
    return found.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of what is left, with the digests that prove the round trip."""
    return pieces.digests(pieces.encode_documents(docs, pieces.model_path()))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("sentencepiece_encoding", encoding_stage),
]

#: Training a classifier, SimHash components and BPE merges are not SQL; the
#: pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder. When a
    stage's output is written, its input and its checkpoints go; what stays is
    the folder of the last one, which the result reads."""
    docs = table(spark, sf_dir, "documents")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        mark = made()
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}_{name}")
        sweep(spark, mark)
        if k:
            delete(spark, f"{at}/{k - 1}_{STAGES[k - 1][0]}")
        docs = spark.read.parquet(f"{at}/{k}_{name}")
    return docs
