"""Findings from semantic reviews: JSON replies of a model, as a table.

A reply (submission_id, agent, raw) that is null, no JSON or without a list of findings
gives no rows; entries are taken one by one, each with the checks that its fields need.
JSON types stay visible through VARIANT, so that a number is told from its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import config
from quarry.functions import text
from quarry.operators import rules


def unfenced(raw: Column) -> Column:
    """The reply without a Markdown fence and its ``json`` mark."""
    clean = text.strip(raw)
    inner = F.regexp_replace(clean, r"\A`+|`+\z", "")
    inner = F.when(F.startswith(F.lower(inner), F.lit("json")), F.substr(inner, F.lit(5))).otherwise(inner)
    return text.strip(F.when(F.startswith(clean, F.lit("```")), inner).otherwise(clean))


def _entries(responses: DataFrame, agent: str) -> DataFrame:
    rows = responses.where(F.col("agent") == agent).withColumn("v", F.try_parse_json(unfenced(F.col("raw"))))
    found = F.try_variant_get("v", "$.findings", "array<variant>")
    return rows.select("submission_id", F.posexplode(found).alias("position", "f")).where(F.col("f").isNotNull())


def _type(name: str) -> Column:
    """The JSON type of a field; null where it is missing."""
    return F.regexp_extract(F.schema_of_variant(F.try_variant_get("f", f"$.{name}", "variant")), r"^[A-Z]+", 0)


def _text(name: str) -> Column:
    """A field as stripped text, the way a scalar prints; null where it is missing."""
    value = F.try_variant_get("f", f"$.{name}", "string")
    kind = _type(name)
    return text.strip(F.when(kind == "VOID", F.lit("None")).when(kind == "BOOLEAN", F.initcap(value)).otherwise(value))


def _number(name: str) -> Column:
    return F.try_variant_get("f", f"$.{name}", "double")


NUMBERS = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")


def _line() -> tuple[Column, Column]:
    """line_number as int, and whether it is usable: absent, null, whole or whole as text."""
    kind, value, as_text = _type("line_number"), _number("line_number"), F.try_variant_get("f", "$.line_number", "string")
    missing = kind.isNull() | kind.isin("VOID", "")
    whole = kind.isin(*NUMBERS) & (value == F.floor(value))
    digits = (kind == "STRING") & as_text.rlike(r"^\s*[+-]?\d+\s*$")
    line = F.when(whole, value.cast("int")).when(digits, F.trim(as_text).cast("int")).when(kind == "BOOLEAN", F.when(as_text == "true", 1).otherwise(0))
    return line, missing | whole | F.coalesce(digits, F.lit(False)) | (kind == "BOOLEAN")


def _confidence() -> Column:
    kind, value = _type("confidence"), _number("confidence")
    truth = F.when(F.try_variant_get("f", "$.confidence", "string") == "true", 1.0).otherwise(0.0)
    number = F.when(kind.isin(*NUMBERS), value).when(kind == "BOOLEAN", truth)
    return F.when(number.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), number))).otherwise(F.lit(config.DEFAULT_CONFIDENCE))


def _default(name: str, other: str) -> Column:
    """A text field: ``other`` where it is missing, null where it is no text."""
    kind = _type(name)
    return F.when(kind.isNull() | (kind == ""), F.lit(other)).when(kind == "STRING", F.try_variant_get("f", f"$.{name}", "string"))


def _read(entries: DataFrame, needed: tuple[str, ...]) -> DataFrame:
    line, usable = _line()
    out = entries.select(
        "submission_id", (F.col("position") + 1).cast("long").alias("seq"),
        F.when(_type("title") == "STRING", F.try_variant_get("f", "$.title", "string")).alias("title"),
        _text("description").alias("description"), _text("recommendation").alias("recommendation"), _text("evidence").alias("evidence"),
        _default("severity", "Medium").alias("severity"), _default("category", config.FALLBACK_CATEGORY if "evidence" in needed else "Maintainability").alias("category"),
        line.cast("int").alias("line_number"), usable.alias("usable"), _confidence().alias("confidence_score"),
    )
    keep = F.col("title").isNotNull() & F.col("usable") & F.col("severity").isin(*config.SEVERITIES)
    for c in needed:
        keep = keep & (F.length(c) > 0)
    return out.where(keep).drop("usable")


def code_findings(responses: DataFrame) -> DataFrame:
    """Design findings of the ``code`` agent."""
    rows = _read(_entries(responses, "code"), ("description", "recommendation")).where(F.col("category").isNotNull())
    return rows.select("submission_id", "seq", "title", "description", "severity", "category", "line_number", "recommendation", "confidence_score", F.lit(config.SEMANTIC).alias("source"))


def security_findings(responses: DataFrame, submissions: DataFrame | None = None) -> DataFrame:
    """Findings of the ``security`` agent, of known categories and with their risk; with
    ``submissions`` also their filename."""
    rows = _read(_entries(responses, "security"), ("description", "recommendation", "evidence"))
    rows = rows.withColumn("category", F.when(F.col("category").isin(*rules.CATEGORIES), F.col("category")).otherwise(F.lit(config.FALLBACK_CATEGORY)))
    rows = rules.classified(rows).withColumn("source", F.lit(config.SEMANTIC))
    carry = ["submission_id"]
    if submissions is not None:
        rows = rows.join(submissions.select("submission_id", "filename"), "submission_id")
        carry.append("filename")
    return rows.select(*carry, "seq", "title", "description", "severity", "category", "owasp_category", "cwe_id", "risk_score", "confidence_score", "evidence", "line_number", "recommendation", "source")
