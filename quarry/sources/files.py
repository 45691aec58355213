"""Tables from folders: source files to review, and Markdown documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import corpus


def source_files(spark: SparkSession, path: str) -> DataFrame:
    """(submission_id, filename, language, code) of all files below a folder; the path is the id,
    the language is left to be detected, and code is null where a file is no UTF-8. What
    ``ingest.accepted_files`` does not take is in ``ingest.rejected_files``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    code = F.try_validate_utf8(F.col("content").cast("string"))
    return files.select(
        F.col("path").alias("submission_id"),
        F.substring_index("path", "/", -1).alias("filename"),
        F.lit(None).cast("string").alias("language"),
        code.alias("code"),
    )


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, value) of the ``.md`` files below a folder, but for readmes; paths are
    relative to it. A folder that isn't there raises."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True)
    full = F.expr("_metadata.file_path")
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/")
    plain = F.regexp_replace(F.url_decode(F.replace(full, F.lit("+"), F.lit("%2B"))), r"^([a-z]+):/*", "$1:/")
    start = root.split(":", 1)[0] + ":/" + root.split(":", 1)[1].lstrip("/") if ":" in root else root
    rows = files.select(F.substr(plain, F.lit(len(start) + 2)).alias("file_path"), "value")
    return rows.where(F.upper(F.substring_index("file_path", "/", -1)) != "README.MD")


class KnowledgeBaseError(Exception):
    """A knowledge base that can't be loaded."""


def _documents(spark: SparkSession, path: str) -> DataFrame:
    try:
        return corpus.documents(markdown_files(spark, path))
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            raise KnowledgeBaseError(f"knowledge base not found: {path}") from e
        raise


def knowledge_base(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """The documents below a folder. ``strict`` raises on a bad one, else it is left out;
    an id that several documents have raises either way."""
    docs = _documents(spark, path)
    if strict and (bad := docs.where("problem is not null").orderBy("file_path").first()):
        raise KnowledgeBaseError(f"{bad.file_path}: {bad.problem}")
    good = docs.where("problem is null").drop("problem")
    if twice := corpus.duplicate_ids(good).orderBy("id").first():
        raise KnowledgeBaseError(f"several documents have the id {twice.id}")
    return good


def document_by_id(spark: SparkSession, path: str, document_id: str) -> DataFrame:
    """The document of one id; raises where there is none or several have it. Reads no other one twice."""
    docs = _documents(spark, path)
    found = docs.where(F.col("problem").isNull() & (F.col("id") == document_id)).drop("problem")
    held = len(found.select("id").take(2))
    if held != 1:
        raise KnowledgeBaseError(f"{'several documents have' if held else 'no document has'} the id {document_id}")
    return found
