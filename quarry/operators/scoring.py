"""Scores of submissions from their findings and metrics."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import config
from quarry.functions import rounding, text
from quarry.operators import checks, clones, java_checks, merge, python_checks, rules, semantic
from quarry.operators.facts import with_facts


def maintainability_index(volume: Column, cyclomatic: Column, loc: Column) -> Column:
    raw = 171 - 5.2 * F.ln(F.greatest(volume, F.lit(1.0))) - 0.23 * F.greatest(cyclomatic, F.lit(1.0)) - 16.2 * F.ln(F.greatest(loc, F.lit(1)))
    return rounding.to_places(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw * 100 / 171)), 1)


def complexity_score(mean: Column) -> Column:
    score = F.least(F.lit(100.0), F.greatest(F.lit(10.0), 100 - (mean - 1) * 5))
    return F.when(mean.isNull(), F.lit(config.NO_FUNCTION_SCORE)).otherwise(rounding.to_int(score))


def maintainability_score(cost: Column) -> Column:
    return F.greatest(F.lit(0), 100 - cost).cast("int")


def quality_score(complexity: Column, maintainability: Column) -> Column:
    return rounding.to_int((complexity + maintainability) / 2)


def security_scores(submissions: DataFrame, merged: DataFrame) -> DataFrame:
    """(submission_id, security_score, highest_risk, findings) of every submission; one
    without findings has 100 and 0."""
    cost = text.lookup(F.col("severity"), config.SECURITY_PENALTY, config.OTHER_SECURITY_PENALTY)
    sums = merged.groupBy("submission_id").agg(F.sum(cost).alias("cost"), F.max("risk_score").alias("risk"), F.count("*").alias("n"))
    out = submissions.select("submission_id").join(sums, "submission_id", "left")
    return out.select("submission_id", F.greatest(F.lit(0), 100 - F.coalesce("cost", F.lit(0))).cast("int").alias("security_score"), F.coalesce("risk", F.lit(0.0)).alias("highest_risk"), F.coalesce("n", F.lit(0)).alias("findings"))


def security_findings(submissions: DataFrame, responses: DataFrame | None = None, scanners=(rules.scan,)) -> DataFrame:
    """Merged findings of all scanners, in their order, and of the semantic replies. A scanner
    takes submissions and gives rows like those of ``rules.scan``."""
    out = None
    parts = [s(submissions) for s in scanners]
    if responses is not None:
        parts.append(semantic.security_findings(responses, submissions))
    for i, rows in enumerate(parts):
        rows = rows.withColumn("seq", F.col("seq") + F.lit(i * 1_000_000))
        out = rows if out is None else out.unionByName(rows)
    return merge.merge(out)


def isolated(scanner):
    """A scanner whose failure leaves the others' findings: it is run by itself and kept by a reliable
    checkpoint (``spark.checkpoint.dir``), and gives no rows where that fails."""

    def scan(submissions: DataFrame) -> DataFrame:
        try:
            return scanner(submissions).checkpoint()
        except Exception as e:  # whatever a foreign tool raises
            warnings.warn(f"a scanner failed and is left out: {e}", RuntimeWarning, stacklevel=2)
            return no_findings(submissions)

    return scan


def no_findings(submissions: DataFrame) -> DataFrame:
    """A scanner for a tool that is not connected yet: no rows, of the right schema."""
    return rules.scan(submissions.limit(0))


def analysed(submissions: DataFrame) -> DataFrame:
    """Submissions (submission_id, filename, language, code) with all that their static analysis
    knows: python and java facts (each null for the other language), blocks (duplicate ones), loc.

    One scan and one Arrow pass, without a shuffle; what follows is read from its columns. Write
    or persist it where both findings and scores are wanted."""
    rows = with_facts(submissions.select("submission_id", "filename", "language", "code"))
    parses = F.col("facts").isNull() | F.col("facts.error").isNull()
    code = F.col("code")
    blocks = clones.blocks(code, clones.keywords_of(F.col("language")))
    return rows.select(
        "submission_id",
        "filename",
        "language",
        F.col("facts").alias("python"),
        F.when(F.col("facts").isNull(), java_checks.facts(code)).alias("java"),
        F.when(parses, blocks).otherwise(F.array().cast(clones.BLOCKS)).alias("blocks"),
        F.size(text.lines(code)).alias("loc"),
    )


def static_findings(rows: DataFrame) -> DataFrame:
    """The findings of ``analysed`` rows, ``seq`` in the order in which they are reported."""
    own = F.coalesce(python_checks.findings(F.col("python")), java_checks.findings(F.col("java")))
    found = F.concat(own, checks.found(F.col("blocks"), clones.CHECKS))
    out = rows.select("submission_id", "filename", F.posexplode(found).alias("seq", "x"))
    return out.select("submission_id", F.col("seq").cast("long").alias("seq"), "x.*", F.lit(config.STATIC_ANALYSIS).alias("source"), "filename")


def code_findings(submissions: DataFrame, responses: DataFrame | None = None) -> DataFrame:
    """Static and semantic findings with filename and source; those of replies come last."""
    out = static_findings(analysed(submissions))
    if responses is None:
        return out
    after = 1_000_000_000  # more than a submission's static findings
    replies = semantic.code_findings(responses).withColumn("seq", F.col("seq") + F.lit(after))
    return out.unionByName(replies.join(submissions.select("submission_id", "filename"), "submission_id"))


def file_metrics(rows: DataFrame, carry: tuple[str, ...] = ("submission_id",)) -> DataFrame:
    """One row for each of the ``analysed`` rows: functions, mean complexities (null without
    functions), Halstead volume and maintainability index (null where the source does not parse), lines."""
    python, java = F.col("python"), F.col("java")
    taken = lambda name: F.coalesce(
        F.transform(python["functions"], lambda f: f[name]), F.transform(java["methods"], lambda m: m[name])
    )
    rows = rows.select(
        *carry,
        "loc",
        F.coalesce(F.size(python["functions"]), F.size(java["methods"])).alias("functions"),
        taken("cyclomatic").alias("cyclomatic"),
        taken("cognitive").alias("cognitive"),
        F.when(python.isNotNull(), python_checks.volume(python)).otherwise(java["volume"]).alias("volume"),
    )
    mean = lambda c: F.when(F.size(c) > 0, F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x) / F.size(c))
    rows = rows.withColumns({"cyclomatic": mean(F.col("cyclomatic")), "cognitive": mean(F.col("cognitive"))})
    index = maintainability_index(F.col("volume"), F.coalesce("cyclomatic", F.lit(1.0)), F.col("loc"))
    return rows.select(
        *carry,
        "loc",
        "functions",
        "cyclomatic",
        "cognitive",
        rounding.to_places(F.col("volume"), 1).alias("halstead_volume"),
        F.when(F.col("volume").isNotNull(), index).alias("maintainability_index"),
    )


def quality_scores(rows: DataFrame, responses: DataFrame | None = None) -> DataFrame:
    """quality_score, maintainability_score, complexity_score and the means, for each of the
    ``analysed`` rows. Findings are counted, not made; only those of replies are joined."""
    own = F.coalesce(python_checks.cost(F.col("python")), java_checks.cost(F.col("java")))
    rows = rows.withColumn("cost", own + checks.cost(F.col("blocks"), clones.CHECKS))
    if responses is not None:
        penalty = text.lookup(F.col("severity"), config.QUALITY_PENALTY, config.OTHER_QUALITY_PENALTY)
        replies = semantic.code_findings(responses).groupBy("submission_id").agg(F.sum(penalty).alias("more"))
        rows = rows.join(replies, "submission_id", "left").withColumn("cost", F.col("cost") + F.coalesce("more", F.lit(0)))
    scored = file_metrics(rows, ("submission_id", "filename", "language", "cost")).withColumns({
        "complexity_score": complexity_score(F.col("cyclomatic")),
        "maintainability_score": maintainability_score(F.col("cost")),
    })
    return scored.select(
        "submission_id",
        "filename",
        "language",
        quality_score(F.col("complexity_score"), F.col("maintainability_score")).alias("quality_score"),
        "maintainability_score",
        "complexity_score",
        "maintainability_index",
        rounding.to_places(F.col("cyclomatic"), 1).alias("average_cyclomatic_complexity"),
        rounding.to_places(F.col("cognitive"), 1).alias("average_cognitive_complexity"),
    )


def analyze_code(submissions: DataFrame, responses: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Scores, with the time of the analysis, and findings of submissions."""
    scores = quality_scores(analysed(submissions), responses)
    return scores.withColumn("analyzed_at", F.current_timestamp()), code_findings(submissions, responses)


def scan_security(submissions: DataFrame, responses: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Scores, with the time of the analysis, and merged findings of submissions."""
    merged = security_findings(submissions, responses)
    return security_scores(submissions, merged).withColumn("analyzed_at", F.current_timestamp()), merged
