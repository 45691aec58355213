"""Code checks of Java sources by patterns and braces, as column expressions.

Methods, classes and interfaces are arrays beside the source; their bodies run from
their brace to the one that closes it. Strings and comments count as code, and a method
that follows blank lines is reported at the first of them: its pattern begins with
white space. Nothing is joined or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import config
from quarry.functions import text
from quarry.operators import checks
from quarry.operators.checks import Check
from quarry.operators.python_checks import PASCAL, _named, concrete_values

# What counts as a method, class, interface, field, import, branch and token.
METHOD = r"(?:public|private|protected|static|\s)+[\w<>\[\],\s]+?\s+(\w+)\s*\([^)]*\)\s*(?:throws\s+[\w,\s]+)?\s*\{"
INTERFACE_METHOD = r"[\w<>\[\],\s]+\s+(\w+)\s*\([^)]*\)\s*;"
CLASS = r"\bclass\s+(\w+)"
INTERFACE = r"\binterface\s+(\w+)"
IMPORT = r"(?m)^\s*import\s+([\w.]+)\s*;"
FIELD = r"(?:private|public|protected)\s+(?:static\s+|final\s+)*[\w<>\[\],]+\s+\w+\s*(?:=[^;]+)?;"
CREATED = r"\bnew\s+(\w+)\s*\("
DECISION = r"\b(?:if|for|while|case|catch)\b|&&|\|\|"
NESTING = r"\b(?:if|for|while|catch)\b"
TOKEN = r"\+\+|--|==|!=|<=|>=|&&|\|\||[+\-*/%=<>!]|\w+"
CAMEL = r"^[a-z][a-zA-Z0-9]*$"


def java(submissions: DataFrame) -> DataFrame:
    return submissions.where(F.coalesce(F.col("language") != "Python", F.lit(True)))


def _found(p: str, code: Column) -> Column:
    """array<struct<line, name, text, end>>: the matches of a pattern with one group."""
    none = F.array().cast("array<struct<line:int,name:string,text:string,end:int>>")

    def with_name(m: Column) -> Column:
        name = F.regexp_extract(m["text"], text.pattern(p), 1)
        return F.struct(m["line"].alias("line"), name.alias("name"), m["text"].alias("text"), m["end"].alias("end"))

    some = F.transform(text.matches(p, code), with_name)
    return F.when(code.rlike(text.pattern(p)), some).otherwise(none)


def _cognitive(body: Column) -> Column:
    """One for each nesting word of a body, and one more for each brace but the first that is open there."""
    parts = F.split(body, text.pattern(NESTING), -1)
    open_braces = lambda t: F.regexp_count(t, F.lit(r"\{")) - F.regexp_count(t, F.lit(r"\}"))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("cost"))

    def step(s: Column, part: Column) -> Column:
        depth = s["depth"] + open_braces(part)
        return F.struct(depth.alias("depth"), (s["cost"] + 1 + F.greatest(depth - 1, F.lit(0))).alias("cost"))

    return F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), start, step)["cost"]


def _parameters(match: Column) -> Column:
    inside = F.regexp_extract(match, r"(?s)\A[^(]*\((.*)\)[^)]*\z", 1)
    return F.size(F.filter(F.split(inside, ",", -1), text.not_blank))


def method_array(code: Column) -> Column:
    """array<struct<line, name, span, cyclomatic, cognitive, parameters>> of a source's methods."""

    def measured(m: Column) -> Column:
        def of_body(body: Column) -> Column:
            return F.struct(
                m["line"].alias("line"),
                m["name"].alias("name"),
                (text.newlines(body) + 1).alias("span"),
                (text.count(DECISION, body) + 1).alias("cyclomatic"),
                _cognitive(body).alias("cognitive"),
                _parameters(m["text"]).alias("parameters"),
            )

        return text.let(text.brace_block(F.substr(code, m["end"])), of_body)

    named = F.filter(_found(METHOD, code), lambda m: ~m["name"].isin(*config.JAVA_CONTROL))
    return F.transform(named, measured)


def _body(code: Column, m: Column) -> Column:
    """The body that begins at the first brace after a match; null without one."""
    at = F.position(F.lit("{"), code, m["end"] + 1)
    return F.when(at > 0, text.brace_block(F.substr(code, at)))


def class_array(code: Column) -> Column:
    """array<struct<line, name, span, methods, fields, concrete>>; the last four null without a body."""
    utilities = F.array(*[F.lit(x) for x in config.JAVA_UTILITIES])

    def measured(m: Column) -> Column:
        def of_body(body: Column) -> Column:
            created = F.array_distinct(text.all_matches(CREATED, body, 1))
            return F.struct(
                m["line"].alias("line"),
                m["name"].alias("name"),
                (text.newlines(body) + 1).alias("span"),
                text.count(METHOD, body).alias("methods"),
                text.count(FIELD, body).alias("fields"),
                F.array_sort(F.array_except(created, utilities)).alias("concrete"),
            )

        return text.let(_body(code, m), of_body)

    return F.transform(_found(CLASS, code), measured)


def interface_array(code: Column) -> Column:
    """array<struct<line, name, methods>> of the interfaces with a body."""

    def measured(m: Column) -> Column:
        methods = text.count(INTERFACE_METHOD, _body(code, m))
        return F.struct(m["line"].alias("line"), m["name"].alias("name"), methods.alias("methods"))

    return F.filter(F.transform(_found(INTERFACE, code), measured), lambda x: x["methods"].isNotNull())


def unused_import_array(code: Column) -> Column:
    """array<struct<line, name>> of imports whose last part occurs once in the text."""

    def left(s: Column) -> Column:
        def unused(m: Column) -> Column:
            last = F.substring_index(m["name"], ".", -1)
            return (last != "") & (F.size(F.filter(s["words"], lambda w: w == last)) <= 1)

        return F.transform(F.filter(s["found"], unused), lambda m: F.struct(m["line"].alias("line"), m["name"].alias("name")))

    found = _found(IMPORT, code)
    words = F.when(code.rlike(text.pattern(IMPORT)), text.all_matches(r"\w+", code))
    return text.let(F.struct(found.alias("found"), words.alias("words")), left)


def volume(code: Column) -> Column:
    """Halstead's volume of a source's tokens; 1 without any."""
    operators = F.array(*[F.lit(x) for x in config.JAVA_OPERATORS])
    counted = lambda t: F.array_contains(operators, t) | t.rlike(r"(?U)^[A-Za-z_]\w*$|^\d+$")
    tokens = F.filter(text.all_matches(TOKEN, code), counted)

    def of_tokens(t: Column) -> Column:
        vocabulary = F.size(F.array_distinct(t))
        return F.when(vocabulary == 0, F.lit(1.0)).otherwise(F.size(t) * F.log2(vocabulary.cast("double")))

    return text.let(tokens, of_tokens)


def facts(code: Column) -> Column:
    """struct<classes, interfaces, methods, unused_imports, volume> of a source."""
    return F.struct(
        class_array(code).alias("classes"),
        interface_array(code).alias("interfaces"),
        method_array(code).alias("methods"),
        unused_import_array(code).alias("unused_imports"),
        volume(code).alias("volume"),
    )


CLASSES = (
    Check("java_class_name", lambda x: ~x["name"].rlike(PASCAL), _named("name")),
    Check(
        "java_god_class",
        lambda x: (x["methods"] > config.GOD_CLASS_METHODS) | (x["span"] > config.GOD_CLASS_LINES),
        _named("name", "methods", "fields", "span"),
    ),
    Check("java_concrete_classes", lambda x: F.size(x["concrete"]) > config.CONCRETE_CLASSES, concrete_values),
)
INTERFACES = (
    Check("java_fat_interface", lambda x: x["methods"] > config.FAT_INTERFACE_METHODS, _named("name", "methods")),
)
METHODS = (
    Check("java_long_method", lambda x: x["span"] > config.LONG_METHOD_LINES, _named("name", "span")),
    Check("java_cyclomatic", lambda x: x["cyclomatic"] > config.HIGH_CYCLOMATIC, _named("name", "cyclomatic")),
    Check("java_cognitive", lambda x: x["cognitive"] > config.HIGH_COGNITIVE, _named("name", "cognitive")),
    Check("java_parameters", lambda x: x["parameters"] > config.LONG_PARAMETERS, _named("name", "parameters")),
    Check("java_method_name", lambda x: ~x["name"].rlike(CAMEL), _named("name")),
)
IMPORTS = (Check("java_unused_import", lambda x: F.lit(True), _named("name")),)
_PARTS = ("classes", CLASSES), ("interfaces", INTERFACES), ("methods", METHODS), ("unused_imports", IMPORTS)


def findings(found: Column) -> Column:
    """array of all findings but for duplicate blocks, from ``facts``; null without facts."""
    return F.when(found.isNotNull(), F.concat(*[checks.found(found[name], of) for name, of in _PARTS]))


def cost(found: Column) -> Column:
    """The points that these findings cost, without their texts."""
    costs = [checks.cost(found[name], of) for name, of in _PARTS]
    return F.when(found.isNotNull(), sum(costs[1:], costs[0]))


def _elements(submissions: DataFrame, array: Column) -> DataFrame:
    return java(submissions).select("submission_id", F.explode(array).alias("x")).select("submission_id", "x.*")


def methods(submissions: DataFrame) -> DataFrame:
    """One row for each method: line, name, span, cyclomatic, cognitive, parameters."""
    return _elements(submissions, method_array(F.col("code")))


def classes(submissions: DataFrame) -> DataFrame:
    """One row for each class: line, name, span, methods, fields, concrete (sorted names)."""
    return _elements(submissions, class_array(F.col("code")))


def interfaces(submissions: DataFrame) -> DataFrame:
    """One row for each interface with a body: line, name, methods."""
    return _elements(submissions, interface_array(F.col("code")))


def unused_imports(submissions: DataFrame) -> DataFrame:
    """(submission_id, line, name) of imports whose last part occurs once in the text."""
    return _elements(submissions, unused_import_array(F.col("code")))


def halstead(submissions: DataFrame) -> DataFrame:
    """(submission_id, volume) of every Java source."""
    return java(submissions).select("submission_id", volume(F.col("code")).alias("volume"))
