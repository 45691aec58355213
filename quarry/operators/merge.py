"""Merging of findings that mean the same issue.

Findings of a submission and category are folded in their order: each joins the first
group whose first member is at most ``NEAR_LINES`` lines away (no line goes with no
line), or opens a group. A group of several becomes one finding. The fold is a native
``aggregate`` over the findings of one submission and category, of which there are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import config
from quarry.functions import text

FIELDS = ("seq", "title", "description", "severity", "owasp_category", "cwe_id", "risk_score", "confidence_score", "evidence", "line_number", "recommendation", "source")


def _near(a: Column, b: Column) -> Column:
    return (a.isNull() & b.isNull()) | F.coalesce(F.abs(a - b) <= config.NEAR_LINES, F.lit(False))


def merge(findings: DataFrame, by: tuple[str, ...] = ("submission_id", "filename")) -> DataFrame:
    """One row for each group, with merged_from (array of sources, empty for a finding
    by itself) and the ``seq`` of the group's first finding."""
    member = F.struct(*[F.col(c) for c in FIELDS])
    kind = findings.select(member.alias("m")).schema["m"].dataType.simpleString()
    held = findings.groupBy(*by, "category").agg(F.array_sort(F.collect_list(member)).alias("members"))

    def place(groups: Column, x: Column) -> Column:
        at = F.array_position(F.transform(groups, lambda g: _near(F.get(g, F.lit(0)).line_number, x.line_number)), F.lit(True))
        added = F.transform(groups, lambda g, i: F.when(i + 1 == at, F.concat(g, F.array(x))).otherwise(g))
        return F.when(at > 0, added).otherwise(F.concat(groups, F.array(F.array(x))))

    groups = F.aggregate("members", F.array().cast(f"array<array<{kind}>>"), place)
    rows = held.select(*by, "category", F.explode(groups).alias("group"))
    first = lambda x: F.struct(text.lookup(x.severity, config.SEVERITY_RANK, 0).alias("rank"), x.confidence_score.alias("confidence"), (-x.seq).alias("order"), x.alias("finding"))
    best = F.array_max(F.transform("group", first)).finding
    several = F.size("group") > 1
    evidence = F.array_join(F.array_distinct(F.filter(F.transform("group", lambda x: x.evidence), lambda e: e != "")), " | ")
    sources = F.array_distinct(F.transform("group", lambda x: x.source))
    rows = rows.withColumns({"best": best, "several": several, "joined": evidence, "sources": sources, "first_seq": F.get("group", F.lit(0)).seq})
    keep = lambda c: F.col(f"best.{c}").alias(c)
    return rows.select(
        *by, F.col("first_seq").alias("seq"), keep("title"), keep("description"), keep("severity"), "category", keep("owasp_category"), keep("cwe_id"), keep("risk_score"),
        F.when(F.col("several"), F.least(F.lit(1.0), F.col("best.confidence_score") + F.lit(config.AGREEMENT_BONUS))).otherwise(F.col("best.confidence_score")).alias("confidence_score"),
        F.when(F.col("several"), F.col("joined")).otherwise(F.col("best.evidence")).alias("evidence"), keep("line_number"), keep("recommendation"),
        F.when(F.col("several"), F.lit(config.MERGED)).otherwise(F.col("best.source")).alias("source"),
        F.when(F.col("several"), F.col("sources")).otherwise(F.array().cast("array<string>")).alias("merged_from"),
    )
