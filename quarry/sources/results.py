"""Sinks and reads of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators import corpus


def latest(results: DataFrame, key: str = "submission_id", when: str = "analyzed_at", tie: str | None = None) -> DataFrame:
    """The last result of each key; of equal times the one with the largest ``tie``."""
    order = [F.desc(when)] + ([F.desc(tie)] if tie else [])
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return results.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def by_id(results: DataFrame, value, key: str = "submission_id") -> DataFrame:
    return results.where(F.col(key) == value)


def listed(results: DataFrame) -> tuple[DataFrame, int]:
    """A table and its number of rows."""
    return results, results.count()


def with_results(
    submissions: DataFrame,
    results: DataFrame,
    key: str = "submission_id",
    started: DataFrame | None = None,
    failed: DataFrame | None = None,
) -> DataFrame:
    """All submissions, with their result where there is one, and their status: completed with a
    result, else failed or analyzing where their key is in those tables, else received."""
    found = submissions.join(results.withColumn("__found", F.lit("completed")), key, "left")
    status = [F.col("__found")]
    for name, rows in (("failed", failed), ("analyzing", started)):
        if rows is not None:
            found = found.join(rows.select(key).distinct().withColumn(f"__{name}", F.lit(name)), key, "left")
            status.append(F.col(f"__{name}"))
    status = F.coalesce(*status, F.lit("received"))
    return found.withColumn("status", status).drop("__found", "__failed", "__analyzing")


def write_prepared(docs: DataFrame, chunk_rows: DataFrame, path: str) -> None:
    """A prepared corpus as a folder: ``totals``, ``documents`` and ``chunks`` as JSON lines, each
    written where its rows are, so that a corpus of any size has a manifest."""
    corpus.totals(docs, chunk_rows).withColumn("generated_at", F.current_timestamp()).write.json(f"{path}/totals")
    corpus.manifest_documents(docs).write.json(f"{path}/documents")
    chunk_rows.write.json(f"{path}/chunks")


def write_manifest(spark: SparkSession, manifest: dict, path: str) -> None:
    """One JSON text at ``path``, whose folders are made."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(bytearray(corpus.manifest_json(manifest).encode()))
    finally:
        out.close()
