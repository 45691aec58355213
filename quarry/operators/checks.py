"""Checks as data: what is looked at, when it is reported, in which words and at what cost.

A check looks at the elements of an array (functions, classes, imports ...) of one row, so
findings and costs of a submission are expressions of its row: nothing is joined or
shuffled, and costs are summed without making any text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry import config
from quarry.operators.wording import WORDING

FINDING = (
    "struct<title:string,description:string,severity:string,category:string,line_number:int,"
    "recommendation:string,confidence_score:double>"
)


@dataclass(frozen=True)
class Check:
    """``when`` of an element: a condition for one finding, or an array of what each makes
    one. ``values`` fills the places of the wording, from the element and that entry."""

    wording: str
    when: Callable[[Column], Column]
    values: Callable[..., dict[str, Column]] = field(default=lambda x: {})
    several: bool = False


def say(template: str, values: dict[str, Column]) -> Column:
    """A text with its ``{name}`` places filled by columns."""
    parts, rest = [], template
    while "{" in rest:
        head, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(head), values[name].cast("string")]
    return F.concat(*parts, F.lit(rest))


def _finding(wording: str, line: Column, values: dict[str, Column]) -> Column:
    w = WORDING[wording]
    return F.struct(
        say(w.title, values).alias("title"),
        say(w.description, values).alias("description"),
        F.lit(w.severity).alias("severity"),
        F.lit(w.category).alias("category"),
        line.cast("int").alias("line_number"),
        say(w.recommendation, values).alias("recommendation"),
        F.lit(w.confidence).alias("confidence_score"),
    )


def none_found() -> Column:
    return F.array().cast(f"array<{FINDING}>")


def _of_element(check: Check, x: Column) -> Column:
    if check.several:
        return F.transform(check.when(x), lambda y: _finding(check.wording, x["line"], check.values(x, y)))
    return F.when(check.when(x), F.array(_finding(check.wording, x["line"], check.values(x)))).otherwise(none_found())


def found(elements: Column, checks: tuple[Check, ...]) -> Column:
    """array of the findings of all elements, one element after another, checks in their order."""
    return F.flatten(F.transform(elements, lambda x: F.concat(*[_of_element(c, x) for c in checks])))


def _cost_of(check: Check, x: Column) -> Column:
    each = config.QUALITY_PENALTY.get(WORDING[check.wording].severity, config.OTHER_QUALITY_PENALTY)
    if check.several:
        return F.size(check.when(x)) * F.lit(each)
    return F.when(check.when(x), F.lit(each)).otherwise(F.lit(0))


def cost(elements: Column, checks: tuple[Check, ...]) -> Column:
    """The points that the findings of all elements take off the maintainability score."""

    def add(total: Column, x: Column) -> Column:
        for c in checks:
            total = total + _cost_of(c, x)
        return total

    return F.aggregate(elements, F.lit(0), add)
