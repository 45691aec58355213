"""Code checks of Python sources, as expressions over their facts.

Findings come in the order in which they are reported: functions one after another,
then names, imports and classes. The rows of the metric tables are the elements of the
facts' arrays; no check needs a join or a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import config
from quarry.operators import checks
from quarry.operators.checks import Check
from quarry.operators.facts import with_facts

SNAKE, PASCAL = r"^[a-z_][a-z0-9_]*$", r"^[A-Z][a-zA-Z0-9]*$"


def snake_case(name: Column) -> Column:
    first = F.regexp_replace(name, "(.)([A-Z][a-z]+)", "$1_$2")
    return F.lower(F.regexp_replace(first, "([a-z0-9])([A-Z])", "$1_$2"))


def _named(*names: str):
    """Values that are fields of the element itself."""
    return lambda x, y=None: {n: x[n] for n in names}


def concrete_values(x: Column) -> dict[str, Column]:
    """The classes that a class makes itself, and how many they are."""
    return {
        "name": x["name"],
        "number": F.size(x["concrete"]),
        "concrete": F.left(F.array_join(x["concrete"], ", "), F.lit(80)),
    }


def bad_function_name(x: Column) -> Column:
    return ~x["is_class"] & ~x["name"].rlike(SNAKE) & ~F.startswith(x["name"], F.lit("__"))


def bad_class_name(x: Column) -> Column:
    return x["is_class"] & ~x["name"].rlike(PASCAL)


SYNTAX = (Check("python_syntax", lambda x: x["message"].isNotNull(), lambda x: {"message": x["message"], "line": F.coalesce(x["line"].cast("string"), F.lit("None"))}),)
FUNCTIONS = (
    Check("python_long_function", lambda x: x["span"] > config.LONG_METHOD_LINES, _named("name", "span")),
    Check("python_cyclomatic", lambda x: x["cyclomatic"] > config.HIGH_CYCLOMATIC, _named("name", "cyclomatic")),
    Check("python_cognitive", lambda x: x["cognitive"] > config.HIGH_COGNITIVE, _named("name", "cognitive")),
    Check("python_parameters", lambda x: x["parameters"] > config.LONG_PARAMETERS, _named("name", "parameters")),
    Check("python_magic_number", lambda x: x["magic"], lambda x, y: {"name": x["name"], "value": y}, several=True),
    Check("python_unused_variable", lambda x: x["unused"], lambda x, y: {"name": x["name"], "variable": y}, several=True),
)
NAMES = (
    Check("python_function_name", bad_function_name, lambda x: {"name": x["name"], "suggestion": snake_case(x["name"])}),
    Check("python_class_name", bad_class_name, _named("name")),
)
IMPORTS = (Check("python_unused_import", lambda x: F.lit(True), _named("name")),)
CLASSES = (
    Check(
        "python_god_class",
        lambda x: (x["methods"] > config.GOD_CLASS_METHODS) | (x["span"] > config.GOD_CLASS_LINES),
        _named("name", "methods", "span"),
    ),
    Check(
        "python_fat_interface",
        lambda x: x["abstract_base"] & (x["abstract_methods"] > config.FAT_INTERFACE_METHODS),
        _named("name", "abstract_methods"),
    ),
    Check("python_concrete_classes", lambda x: F.size(x["concrete"]) > config.CONCRETE_CLASSES, concrete_values),
)


def _parts(facts: Column) -> list[tuple[Column, tuple[Check, ...]]]:
    """What is looked at, and the checks of it; a source that doesn't parse has its error alone."""
    error = F.when(facts["error"].isNotNull(), F.array(facts["error"])).otherwise(F.array().cast("array<struct<message:string,line:int>>"))
    places = ("functions", FUNCTIONS), ("definitions", NAMES), ("unused_imports", IMPORTS), ("classes", CLASSES)
    return [(error, SYNTAX), *((facts[name], of) for name, of in places)]


def findings(facts: Column) -> Column:
    """array of all findings but for duplicate blocks, in their order; null without facts."""
    return F.when(facts.isNotNull(), F.concat(*[checks.found(x, of) for x, of in _parts(facts)]))


def cost(facts: Column) -> Column:
    """The points that these findings cost, without their texts."""
    costs = [checks.cost(x, of) for x, of in _parts(facts)]
    return F.when(facts.isNotNull(), sum(costs[1:], costs[0]))


def volume(facts: Column) -> Column:
    """Halstead's volume: tokens times the binary log of the distinct ones, 1 without any; null for a broken source."""
    some = facts["tokens"] * F.log2(facts["vocabulary"].cast("double"))
    return F.when(facts["error"].isNull() & facts.isNotNull(), F.when(facts["vocabulary"] > 0, some).otherwise(F.lit(1.0)))


def _python(submissions: DataFrame) -> DataFrame:
    rows = submissions.where(F.col("language") == "Python").select("submission_id", "language", "code")
    return with_facts(rows).select("submission_id", "facts")


def _elements(submissions: DataFrame, array: str) -> DataFrame:
    return _python(submissions).select("submission_id", F.explode(f"facts.{array}").alias("x"))


def function_metrics(submissions: DataFrame) -> DataFrame:
    """One row for each function: name, line, span, cyclomatic, cognitive, parameters."""
    return _elements(submissions, "functions").select("submission_id", "x.*").drop("magic", "unused")


def unused_variables(submissions: DataFrame) -> DataFrame:
    """(submission_id, function, line, name): what a function assigns and never reads, the first by name."""
    rows = _elements(submissions, "functions")
    return rows.select("submission_id", F.col("x.name").alias("function"), "x.line", F.explode("x.unused").alias("name"))


def magic_numbers(submissions: DataFrame) -> DataFrame:
    """(submission_id, function, line, value): the first numbers of each function."""
    rows = _elements(submissions, "functions")
    return rows.select("submission_id", F.col("x.name").alias("function"), "x.line", F.explode("x.magic").alias("value"))


def unused_imports(submissions: DataFrame) -> DataFrame:
    """(submission_id, name, line): imports that no name, attribute, export or other word of the text names."""
    return _elements(submissions, "unused_imports").select("submission_id", "x.name", "x.line")


def naming(submissions: DataFrame) -> DataFrame:
    """(submission_id, name, line, suggestion) of badly named functions and classes."""
    x = F.col("x")
    bad = _elements(submissions, "definitions").where(bad_function_name(x) | bad_class_name(x))
    return bad.select("submission_id", "x.name", "x.line", F.when(~F.col("x.is_class"), snake_case(F.col("x.name"))).alias("suggestion"))


def classes(submissions: DataFrame) -> DataFrame:
    """One row for each class: name, line, span, methods, abstract_methods, abstract_base, concrete (sorted names)."""
    return _elements(submissions, "classes").select("submission_id", "x.*")


def halstead(submissions: DataFrame) -> DataFrame:
    """(submission_id, volume) of every Python source that parses."""
    rows = _python(submissions).select("submission_id", volume(F.col("facts")).alias("volume"))
    return rows.where(F.col("volume").isNotNull())
