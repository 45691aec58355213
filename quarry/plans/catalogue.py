"""Every query of the library by name, with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import config
from quarry.functions import text
from quarry.operators import clones, corpus, ingest, java_checks, prompts, python_checks, rules, scoring, semantic
from quarry.plans import oracles
from quarry.plans.samples import submissions_raw
from quarry.sources import results


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.accepted_texts(submissions_raw(spark, sf_dir))


def ingest_submissions(spark, sf_dir):
    rows = ingest.accepted_texts(submissions_raw(spark, sf_dir))
    return ingest.response(rows)


def ingest_checked(spark, sf_dir):
    """Submissions with the syntax check that they pass at their creation."""
    return ingest.response(ingest.ingest_texts(submissions_raw(spark, sf_dir)))


def _files_raw(spark, sf_dir):
    """Submissions as files: some without UTF-8, some of another type."""
    raw = submissions_raw(spark, sf_dir).withColumn("filename", F.coalesce("filename", F.lit("notes.txt")))
    lost = F.col("submission_id").cast("long") % 7 == 0
    return raw.withColumns({"language": F.lit(None).cast("string"), "code": F.when(~lost, F.col("code"))})


def ingest_file_rejects(spark, sf_dir):
    return ingest.rejected_files(_files_raw(spark, sf_dir))


def ingest_rejects(spark, sf_dir):
    return ingest.rejected_texts(submissions_raw(spark, sf_dir))


def ingest_files(spark, sf_dir):
    raw = submissions_raw(spark, sf_dir).withColumn("filename", F.coalesce("filename", F.lit("notes.txt"))).withColumn("language", F.lit(None).cast("string"))
    return ingest.response(ingest.accepted_files(raw))


def language_detection(spark, sf_dir):
    raw = submissions_raw(spark, sf_dir)
    return raw.select("submission_id", ingest.detected_language(F.col("code")).alias("detected"))


def python_syntax_check(spark, sf_dir):
    rows = ingest.checked(_submissions(spark, sf_dir).where(F.col("language") == "Python"))
    return rows.where(~F.col("syntax_valid")).select("submission_id", "syntax_error", "syntax_error_line")


def java_delimiter_check(spark, sf_dir):
    rows = _submissions(spark, sf_dir).where(F.col("language") == "Java").select("submission_id", ingest.java_balance(F.col("code")).alias("s"))
    return rows.select("submission_id", F.col("s.ok").alias("ok"), F.col("s.error").alias("error"), F.col("s.line").alias("line"))


def security_rule_findings(spark, sf_dir):
    rows = rules.scan(_submissions(spark, sf_dir))
    return rows.select("submission_id", "seq", "title", "severity", "category", "owasp_category", "cwe_id", "risk_score", "confidence_score", "evidence", "line_number")


def security_rules_from_table(spark, sf_dir):
    rows = rules.scan_table(_submissions(spark, sf_dir), rules.rules_table(spark))
    return rows.select("submission_id", "seq", "category", "evidence", "line_number")


def security_rule_counts_by_category(spark, sf_dir):
    return rules.scan(_submissions(spark, sf_dir)).groupBy("category", "severity").agg(F.count("*").alias("findings"), F.count_distinct("submission_id").alias("submissions"))


def document_secrets(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("submission_id"), F.lit("document").alias("filename"), F.lit("Python").alias("language"), F.replace("text", F.lit("token ="), F.lit("access_token =")).alias("code"))
    found = rules.scan(docs, rules=tuple(r for r in rules.RULES if r.category == "Hardcoded Secrets"))
    return found.select(F.col("submission_id").cast("bigint").alias("doc_id"), "evidence", "line_number")


def risk_scores(spark, sf_dir):
    severity = F.explode(F.array(*[F.lit(s) for s in (*config.SEVERITIES, "Unknown")])).alias("severity")
    grid = rules.categories_table(spark).select("category", severity)
    return grid.select("category", "severity", rules.risk_score(F.col("category"), F.col("severity")).alias("risk_score"))


def security_merged_findings(spark, sf_dir):
    rows = scoring.security_findings(_submissions(spark, sf_dir), scanners=(rules.scan, scoring.no_findings))
    return rows.select("submission_id", "seq", "category", "severity", "line_number", "confidence_score", "evidence", "source", F.array_join("merged_from", ",").alias("merged_from"))


def security_merged_with_replies(spark, sf_dir):
    """Findings of the rules and of replies, which events make for the submissions of their id, merged."""
    rows = scoring.scan_security(_submissions(spark, sf_dir), semantic_responses(spark, sf_dir))[1]
    return rows.select("submission_id", "filename", "category", "severity", "line_number", "confidence_score", "evidence", "source", F.array_join("merged_from", ",").alias("merged_from"))


def security_scores(spark, sf_dir):
    return scoring.scan_security(_submissions(spark, sf_dir))[0].drop("analyzed_at")


def semantic_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of both agents made from events: of several shapes, good and bad."""
    e = _read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    kind = F.pmod("event_id", F.lit(8))
    entry = F.concat(F.lit('{"title":"T'), F.col("event_id"), F.lit('","description":" d '), F.col("event_type"), F.lit(' ","recommendation":"r","evidence":"e'), F.col("user_id"), F.lit('"'))
    tail = (
        F.when(kind == 0, F.lit(',"severity":"High","category":"SQL Injection","line_number":3,"confidence":0.9}'))
        .when(kind == 1, F.lit(',"severity":"Low","category":"Made Up","line_number":"4","confidence":7}'))
        .when(kind == 2, F.lit(',"category":"Performance","line_number":null,"confidence":"sure"}'))
        .when(kind == 3, F.lit(',"severity":"Severe","line_number":1}'))
        .when(kind == 4, F.lit(',"line_number":2.5}'))
        .otherwise(F.lit("}"))
    )
    body = F.concat(F.lit('{"findings":['), entry, tail, F.when(kind == 0, F.lit(',{"title":"no text"}')).otherwise(F.lit("")), F.lit("]}"))
    raw = F.when(kind == 5, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(kind == 6, F.lit("not json")).when(kind == 7, F.lit(None).cast("string")).otherwise(body)
    agent = F.when(F.pmod(F.floor(F.col("event_id") / 8), F.lit(2)) == 0, F.lit("code")).otherwise(F.lit("security"))
    return e.select(F.col("event_id").cast("string").alias("submission_id"), agent.alias("agent"), raw.alias("raw"))


def semantic_code_findings(spark, sf_dir):
    return semantic.code_findings(semantic_responses(spark, sf_dir)).select("submission_id", "title", "description", "severity", "category", "line_number", "confidence_score")


def semantic_security_findings(spark, sf_dir):
    return semantic.security_findings(semantic_responses(spark, sf_dir)).select("submission_id", "title", "description", "severity", "category", "cwe_id", "risk_score", "evidence", "line_number", "confidence_score")


def latest_result(spark, sf_dir):
    events = _read(spark, sf_dir, "events")
    rows = results.latest(events, "user_id", "ts", "event_id")
    return rows.select("user_id", "event_id", "event_type", "value")


def result_lookup(spark, sf_dir):
    """Results of one key, the last of it alone: a point lookup that the scan can prune by."""
    events = _read(spark, sf_dir, "events")
    return results.latest(results.by_id(events, 7, "user_id"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


def results_listed(spark, sf_dir):
    """All results and their number."""
    rows, total = results.listed(_read(spark, sf_dir, "events").select("event_id", "user_id", "value"))
    return rows.withColumn("total", F.lit(total).cast("long"))


def submission_status(spark, sf_dir):
    """Status of every order's submission: results, failures and started analyses by the key's remainder."""
    rows = submissions_raw(spark, sf_dir).select("submission_id")
    of = lambda k: rows.where(F.col("submission_id").cast("long") % 5 == k)
    done = of(1).withColumn("score", F.lit(1))
    return results.with_results(rows, done, started=of(2).union(of(1)), failed=of(3)).select("submission_id", "status")


def submissions_with_results(spark, sf_dir):
    scores = scoring.scan_security(_submissions(spark, sf_dir).where(F.col("language") == "Python"))[0]
    return results.with_results(submissions_raw(spark, sf_dir).select("submission_id"), scores.select("submission_id", "security_score"))


def python_function_metrics(spark, sf_dir):
    return python_checks.function_metrics(_submissions(spark, sf_dir))


def python_naming(spark, sf_dir):
    return python_checks.naming(_submissions(spark, sf_dir))


def python_unused_imports(spark, sf_dir):
    return python_checks.unused_imports(_submissions(spark, sf_dir))


def python_unused_variables(spark, sf_dir):
    return python_checks.unused_variables(_submissions(spark, sf_dir))


def python_magic_numbers(spark, sf_dir):
    return python_checks.magic_numbers(_submissions(spark, sf_dir))


def python_classes(spark, sf_dir):
    rows = python_checks.classes(_submissions(spark, sf_dir))
    return rows.withColumn("concrete", F.array_join("concrete", ", "))


def python_halstead(spark, sf_dir):
    return python_checks.halstead(_submissions(spark, sf_dir)).withColumn("volume", F.round("volume", 6))


def java_method_metrics(spark, sf_dir):
    return java_checks.methods(_submissions(spark, sf_dir))


def java_class_checks(spark, sf_dir):
    rows = java_checks.classes(_submissions(spark, sf_dir))
    return rows.withColumn("concrete", F.array_join("concrete", ","))


def java_interface_checks(spark, sf_dir):
    return java_checks.interfaces(_submissions(spark, sf_dir))


def java_unused_imports(spark, sf_dir):
    return java_checks.unused_imports(_submissions(spark, sf_dir))


def java_halstead(spark, sf_dir):
    return java_checks.halstead(_submissions(spark, sf_dir)).withColumn("volume", F.round("volume", 6))


def maintainability_index(spark, sf_dir):
    """On documents, whose token volume stands for Halstead's."""
    docs = _read(spark, sf_dir, "documents").where(F.length("text") > 0)
    tokens = F.regexp_extract_all("text", F.lit(r"[A-Za-z]+"), F.lit(0))
    rows = docs.select("doc_id", F.size(text.lines(F.col("text"))).alias("loc"), tokens.alias("t"))
    volume = F.when(F.size("t") > 0, F.size("t") * F.log2(F.size(F.array_distinct("t")).cast("double"))).otherwise(1.0)
    return rows.select("doc_id", "loc", scoring.maintainability_index(volume, F.lit(2.5), F.col("loc")).alias("maintainability_index"))


def code_findings(spark, sf_dir):
    rows = scoring.code_findings(_submissions(spark, sf_dir))
    return rows.select("submission_id", "seq", "title", "description", "severity", "category", "line_number", "recommendation", "confidence_score", "source")


def code_findings_with_replies(spark, sf_dir):
    """Static findings and those of replies, which events make for the submissions of their id."""
    rows = scoring.code_findings(_submissions(spark, sf_dir), semantic_responses(spark, sf_dir))
    return rows.select("submission_id", "filename", "title", "severity", "category", "line_number", "confidence_score", "source")


def code_file_metrics(spark, sf_dir):
    return scoring.file_metrics(scoring.analysed(_submissions(spark, sf_dir)))


def code_quality_scores(spark, sf_dir):
    return scoring.analyze_code(_submissions(spark, sf_dir))[0].drop("analyzed_at")


def code_quality_scores_with_replies(spark, sf_dir):
    rows = scoring.analyze_code(_submissions(spark, sf_dir), semantic_responses(spark, sf_dir))[0]
    return rows.select("submission_id", "quality_score", "maintainability_score", "complexity_score")


def scoring_formulas(spark, sf_dir):
    """Complexity and quality scores over grouped order lines: means, half-even rounding and limits."""
    lines = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.avg(F.col("l_quantity").cast("bigint") % 30 + 1).alias("mean"), F.sum(text.lookup(F.col("l_returnflag"), {"A": 2, "N": 5, "R": 10}, 3)).alias("cost"))
    a, b = scoring.complexity_score(F.col("mean")), scoring.maintainability_score(F.col("cost"))
    return lines.select("l_orderkey", a.alias("complexity_score"), b.alias("maintainability_score"), scoring.quality_score(a, b).alias("quality_score"))


def duplicate_blocks(spark, sf_dir):
    """Equal or alike four-line blocks within documents."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return clones.duplicate_blocks(docs, "doc_id", "text").select("doc_id", "i", "leader", "exact")


def duplicate_code_blocks(spark, sf_dir):
    return clones.clone_findings(_submissions(spark, sf_dir)).select("submission_id", "title", "severity", "line_number", "confidence_score")


def document_profile(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", text.strip(F.coalesce("text", F.lit(""))).alias("content"))
    return docs.select("doc_id", *[c.alias(n) for n, c in corpus.profile(F.col("content")).items()])


def _knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as knowledge documents: paragraphs are their lines."""
    docs = _read(spark, sf_dir, "documents")
    content = text.strip(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n\n")))
    none = F.lit(None).cast("string")
    out = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("lang").alias("category"), none.alias("owasp_category"), none.alias("cwe_id"), F.array(F.lit("python")).alias("languages"), F.array().cast("array<string>").alias("tags"), F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_path"), content.alias("content"))
    return out.withColumns(corpus.profile(F.col("content")))


def document_chunks(spark, sf_dir):
    rows = corpus.chunks(_knowledge(spark, sf_dir))
    return rows.select("chunk_id", F.col("document_id").alias("doc_id"), "chunk_index", F.length("text").alias("chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"), "category", "source_title")


def document_chunks_without_overlap(spark, sf_dir):
    rows = corpus.chunks(_knowledge(spark, sf_dir), 400, 0)
    return rows.groupBy("document_id").agg(F.count("*").alias("chunks"), F.max(F.length("text")).alias("longest"))


def corpus_manifest(spark, sf_dir):
    return corpus.by_category(_knowledge(spark, sf_dir))


def corpus_manifest_documents(spark, sf_dir):
    return corpus.manifest_documents(_knowledge(spark, sf_dir))


def corpus_manifest_totals(spark, sf_dir):
    docs = _knowledge(spark, sf_dir)
    return corpus.totals(docs, corpus.chunks(docs))


def corpus_prepared(spark, sf_dir):
    """Totals of a prepared corpus as one JSON text."""
    _, totals = corpus.prepare(_knowledge(spark, sf_dir))
    return totals.select(F.to_json(F.struct("document_count", "chunk_count")).alias("manifest"))


def duplicate_document_ids(spark, sf_dir):
    return corpus.duplicate_ids(_read(spark, sf_dir, "conversations"), "conv_id")


def front_matter_parse(spark, sf_dir):
    """Headers made from documents: good ones, and ones without an id, a header or a known category."""
    d, k = _read(spark, sf_dir, "documents"), F.pmod("doc_id", F.lit(5))
    head = F.concat(F.lit("---\nid: doc-"), F.col("doc_id"), F.lit('\ntitle: "Title '), F.col("source"), F.lit('"\ncategory: '), F.when(k == 1, F.lit("other")).otherwise(F.lit("secure_coding")), F.lit("\ncwe_id: CWE-"), F.col("doc_id"), F.lit("\nlanguages: [python, java]\nlast_updated: 2024-01-15\n---\n\n"))
    value = F.concat(F.when(k == 2, F.lit("")).when(k == 3, F.replace(head, F.lit("id: doc-"), F.lit("key: doc-"))).otherwise(head), F.coalesce("text", F.lit("")), F.lit("\n"))
    rows = corpus.documents(d.select(F.concat(F.lit("d/"), F.col("doc_id")).alias("file_path"), value.alias("value")))
    return rows.select("file_path", "problem", "id", "title", "category", "cwe_id", F.array_join("languages", ",").alias("languages"), "source", "version", F.date_format("last_updated", "yyyy-MM-dd").alias("last_updated"), F.when(F.col("problem").isNull(), F.col("content_hash")).alias("content_hash"))


def prompt_assembly(spark, sf_dir):
    rows = prompts.assembled(_read(spark, sf_dir, "conversations"), system=F.lit("Be brief."))
    return rows.select("conv_id", F.length("prompt").alias("chars"), F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"))


QUERIES = {
    f.__name__: f
    for f in (
        security_scores, security_rule_findings, security_rules_from_table, security_rule_counts_by_category, security_merged_findings, document_secrets, risk_scores,
        ingest_submissions, ingest_checked, ingest_rejects, ingest_files, ingest_file_rejects, result_lookup, results_listed, submission_status, corpus_prepared, language_detection, python_syntax_check, java_delimiter_check,
        semantic_code_findings, semantic_security_findings, latest_result, submissions_with_results,
        python_function_metrics, python_naming, python_unused_imports, python_unused_variables, python_magic_numbers, python_classes, python_halstead, security_merged_with_replies, code_findings_with_replies, code_quality_scores_with_replies,
        java_method_metrics, java_class_checks, java_interface_checks, java_unused_imports, java_halstead,
        maintainability_index, code_findings, code_file_metrics, code_quality_scores, scoring_formulas,
        duplicate_blocks, duplicate_code_blocks, document_profile, document_chunks, document_chunks_without_overlap,
        corpus_manifest, corpus_manifest_documents, corpus_manifest_totals, duplicate_document_ids, front_matter_parse, prompt_assembly,
    )
}

ORACLE_SQL = oracles.SQL
