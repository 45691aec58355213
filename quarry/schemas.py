"""Schemas of the tables that the operators take and make."""

from pyspark.sql import types as T

SUBMISSIONS_RAW = "submission_id string, filename string, language string, code string"
SUBMISSIONS = "submission_id string, filename string, language string, code string, language_auto_detected boolean, syntax_valid boolean, syntax_error string, syntax_error_line int"
SEMANTIC_RESPONSES = "submission_id string, agent string, raw string"
CODE_FINDINGS = "submission_id string, seq bigint, title string, description string, severity string, category string, line_number int, recommendation string, confidence_score double, source string"
SECURITY_FINDINGS = "submission_id string, seq bigint, title string, description string, severity string, category string, owasp_category string, cwe_id string, risk_score double, confidence_score double, evidence string, line_number int, recommendation string, source string"


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


SYNTAX = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("error", T.StringType()), T.StructField("line", T.IntegerType())])
_TEXTS = T.ArrayType(T.StringType())
_TEXT, _INT, _BOOL = T.StringType(), T.IntegerType(), T.BooleanType()
PYTHON_FACTS = _struct(
    error=_struct(message=_TEXT, line=_INT),
    functions=T.ArrayType(
        _struct(name=_TEXT, line=_INT, span=_INT, cyclomatic=_INT, cognitive=_INT, parameters=_INT, magic=_TEXTS, unused=_TEXTS)
    ),
    definitions=T.ArrayType(_struct(is_class=_BOOL, name=_TEXT, line=_INT)),
    unused_imports=T.ArrayType(_struct(name=_TEXT, line=_INT)),
    classes=T.ArrayType(
        _struct(name=_TEXT, line=_INT, span=_INT, methods=_INT, abstract_methods=_INT, abstract_base=_BOOL, concrete=_TEXTS)
    ),
    tokens=_INT,
    vocabulary=_INT,
)
KNOWLEDGE_HEADER = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("category", T.StringType()), T.StructField("owasp_category", T.StringType()),
    T.StructField("cwe_id", T.StringType()), T.StructField("languages", _TEXTS), T.StructField("tags", _TEXTS), T.StructField("source", T.StringType()),
    T.StructField("version", T.IntegerType()), T.StructField("last_updated", T.DateType()), T.StructField("problem", T.StringType()),
])
