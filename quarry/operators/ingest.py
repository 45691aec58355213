"""Submissions: language detection, syntax checks, validation.

Text submissions that are blank, too long or of no clear language go to ``rejects``;
files are cut at the limit instead and take their language from their name.
"""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry import config, schemas
from quarry.functions import text

# What speaks for a language, and what hides brackets in Java.
PYTHON_SIGNALS = r"(?m)^\s*(def |class \w+.*:|import |from \w+ import|print\()"
JAVA_SIGNALS = r"\b(public|private|protected)\s+(class|static|void|interface)\b|System\.out\.println"
JAVA_HIDDEN = r"(?ms)//.*?$|/\*.*?\*/|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'"
CLOSES = {"{": "}", "(": ")", "[": "]"}


def detected_language(code: Column) -> Column:
    """Python, Java or null, by the signals counted in the text; a tie is Python."""
    python, java = text.count(PYTHON_SIGNALS, code), text.count(JAVA_SIGNALS, code)
    return F.when((python == 0) & (java == 0), F.lit(None).cast("string")).when(python >= java, F.lit("Python")).otherwise(F.lit("Java"))


def filename_language(filename: Column) -> Column:
    java = filename.contains(".") & (F.lower(F.substring_index(filename, ".", -1)) == "java")
    return F.when(java, F.lit("Java")).otherwise(F.lit("Python"))


def java_balance(code: Column) -> Column:
    """struct<ok, error, line>: the first bracket that closes nothing or the wrong one, or
    the innermost one left open. Strings and comments are left out beforehand, lines too."""
    tokens = F.regexp_extract_all(F.regexp_replace(code, text.pattern(JAVA_HIDDEN), ""), F.lit(r"[{}()\[\]\n]"), F.lit(0))
    start = F.struct(F.array().cast("array<struct<c:string,l:int>>").alias("stack"), F.lit(1).alias("line"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("int").alias("at"))
    closing = lambda c: F.when(c == "{", "}").when(c == "(", ")").when(c == "[", "]")

    def step(s: Column, x: Column) -> Column:
        empty = F.size(s.stack) == 0
        opens = x.isin(*CLOSES)
        wrong = x.isin(*CLOSES.values()) & F.when(empty, F.lit(True)).otherwise(closing(F.get(s.stack, F.size(s.stack) - 1).c) != x)
        expected = F.when(empty, F.lit("nothing")).otherwise(closing(F.get(s.stack, F.size(s.stack) - 1).c))
        stack = F.when(opens, F.concat(s.stack, F.array(F.struct(x.alias("c"), s.line.alias("l"))))).when(x.isin(*CLOSES.values()) & ~wrong, F.slice(s.stack, F.lit(1), F.size(s.stack) - 1)).otherwise(s.stack)
        failed = F.struct(s.stack.alias("stack"), s.line.alias("line"), F.concat(F.lit("Unexpected '"), x, F.lit("' — expected '"), expected, F.lit("' (line "), s.line.cast("string"), F.lit(")")).alias("error"), s.line.alias("at"))
        going = F.struct(stack.alias("stack"), (s.line + F.when(x == "\n", 1).otherwise(0)).alias("line"), s.error.alias("error"), s["at"].alias("at"))
        return F.when(s.error.isNotNull(), s).when(wrong, failed).otherwise(going)

    def finish(s: Column) -> Column:
        last = F.get(s.stack, F.size(s.stack) - 1)
        left = F.concat(F.lit("Unclosed '"), last.c, F.lit("' (line "), last.l.cast("string"), F.lit(")"))
        return F.struct((s.error.isNull() & (F.size(s.stack) == 0)).alias("ok"), F.coalesce(s.error, F.when(F.size(s.stack) > 0, left)).alias("error"), F.coalesce(s["at"], F.when(F.size(s.stack) > 0, last.l)).alias("line"))

    return F.aggregate(tokens, start, step, finish)


def python_syntax(submissions: DataFrame) -> DataFrame:
    """Adds ``syntax`` (struct<ok, error, line>) to Python submissions, by one Arrow pass."""

    def check(batches):
        for batch in batches:
            ok, error, line = [], [], []
            for code in batch.column("code").to_pylist():
                try:
                    ast.parse(code)
                    found = (True, None, None)
                except SyntaxError as e:
                    found = (False, f"{e.msg} (line {e.lineno})", e.lineno)
                except (ValueError, RecursionError, MemoryError) as e:
                    found = (False, str(e) or type(e).__name__, None)
                for to, x in zip((ok, error, line), found, strict=True):
                    to.append(x)
            syntax = pa.StructArray.from_arrays([pa.array(ok, pa.bool_()), pa.array(error, pa.string()), pa.array(line, pa.int32())], ["ok", "error", "line"])
            yield batch.append_column("syntax", syntax)

    return submissions.mapInArrow(check, T.StructType([*submissions.schema.fields, T.StructField("syntax", schemas.SYNTAX)]))


def checked(submissions: DataFrame) -> DataFrame:
    """Adds syntax_valid, syntax_error and syntax_error_line."""
    python = python_syntax(submissions.where(F.col("language") == "Python"))
    java = submissions.where((F.col("language") != "Python") | F.col("language").isNull()).withColumn("syntax", java_balance(F.col("code")))
    both = python.unionByName(java)
    return both.select(*submissions.columns, F.col("syntax.ok").alias("syntax_valid"), F.col("syntax.error").alias("syntax_error"), F.col("syntax.line").alias("syntax_error_line"))


def _problem(code: Column, language: Column, detected: Column) -> Column:
    return (
        F.when(code.isNull() | (code == ""), F.lit("code is empty"))
        .when(F.length(code) > config.MAX_CODE_CHARS, F.lit("code is too long"))
        .when(~text.not_blank(code), F.lit("code is blank"))
        .when(language.isNotNull() & ~language.isin(*config.LANGUAGES), F.lit("language is unknown"))
        .when(F.coalesce(language, detected).isNull(), F.lit("language is unclear"))
    )


def _judged(raw: DataFrame) -> DataFrame:
    return raw.withColumn("detected", F.when(F.col("language").isNull(), detected_language(F.col("code")))).withColumn("problem", _problem(F.col("code"), F.col("language"), F.col("detected")))


def accepted_texts(raw: DataFrame) -> DataFrame:
    """Pasted submissions that pass: language and filename filled in."""
    kept = _judged(raw).where(F.col("problem").isNull())
    return kept.select("submission_id", F.coalesce(F.nullif("filename", F.lit("")), F.lit(config.DEFAULT_FILENAME)).alias("filename"), F.coalesce("language", "detected").alias("language"), "code", F.col("language").isNull().alias("language_auto_detected"))


def rejected_texts(raw: DataFrame) -> DataFrame:
    """(submission_id, problem) of pasted submissions that don't pass."""
    return _judged(raw).where(F.col("problem").isNotNull()).select("submission_id", "problem")


def ingest_texts(raw: DataFrame) -> DataFrame:
    """Pasted submissions as SUBMISSIONS."""
    return checked(accepted_texts(raw))


def identified(raw: DataFrame, seed: int | None = None) -> DataFrame:
    """Raw submissions with a random UUID where they have no submission_id. An id is drawn from the
    plan's seed and the row's place in its partition, so that a task that runs again draws the same."""
    made = F.uuid() if seed is None else F.expr(f"uuid({seed}L)")
    return raw.withColumn("submission_id", F.coalesce("submission_id", made))


def _accepted_name(filename: Column) -> Column:
    ending = F.lower(filename)
    found = F.endswith(ending, F.lit(config.ACCEPTED_EXTENSIONS[0])) | F.endswith(ending, F.lit(config.ACCEPTED_EXTENSIONS[1]))
    return F.coalesce(found, F.lit(False))


def rejected_files(raw: DataFrame) -> DataFrame:
    """(submission_id, problem) of files that don't pass: of another ending, or whose code is null since it is no UTF-8."""
    problem = F.when(~_accepted_name(F.col("filename")), F.lit("file type is not accepted")).when(F.col("code").isNull(), F.lit("file is not UTF-8"))
    return raw.select("submission_id", problem.alias("problem")).where(F.col("problem").isNotNull())


def accepted_files(raw: DataFrame) -> DataFrame:
    """Files (submission_id, filename, language, code) with an accepted ending: code cut to the limit."""
    good = raw.where(_accepted_name(F.col("filename")) & F.col("code").isNotNull())
    return good.select("submission_id", "filename", F.coalesce("language", filename_language(F.col("filename"))).alias("language"), F.left("code", F.lit(config.MAX_CODE_CHARS)).alias("code"), F.col("language").isNull().alias("language_auto_detected"))


def ingest_files(raw: DataFrame) -> DataFrame:
    """File submissions as SUBMISSIONS."""
    return checked(accepted_files(raw))


def response(submissions: DataFrame) -> DataFrame:
    """Submissions without their code but with its length."""
    return submissions.select(*(c for c in submissions.columns if c != "code"), F.length("code").alias("code_length"))
