"""Duplicate blocks: windows of four lines, equal as they are or but for names.

A window's names become numbered places in the order they appear in it and its numbers
one mark. The first window of each such form leads it; every later one is a finding,
exact where its lines equal the leader's. A document is looked at by itself, as an
expression of its row: nothing is shuffled.
"""

from __future__ import annotations

import keyword

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import config
from quarry.functions import text
from quarry.operators import checks
from quarry.operators.checks import Check

_TOKEN = r"\w+|[^\w\s]"
#: What ``blocks`` gives for a text.
BLOCKS = "array<struct<i:int,leader:int,exact:boolean,line:int>>"


def _form(block: Column, names: Column) -> Column:
    """The tokens of a window's lines with names and numbers replaced, as one text."""
    is_name = lambda t: t.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$") & ~F.array_contains(names, t)

    def replaced(s: Column) -> Column:
        one = lambda t: F.when(t.rlike(r"(?U)^\d+$"), F.lit("NUM")).when(is_name(t), F.concat(F.lit("V"), F.array_position(s.order, t).cast("string"))).otherwise(t)
        return F.array_join(F.transform(s.tokens, lambda line: F.array_join(F.transform(line, one), " ")), "\n")

    tokens = F.transform(block, lambda line: text.all_matches(_TOKEN, line))
    ordered = text.let(tokens, lambda t: F.struct(t.alias("tokens"), F.array_distinct(F.filter(F.flatten(t), is_name)).alias("order")))
    return text.let(ordered, replaced)


def _shape(line: Column) -> Column:
    """What lines of equal form have in common: their marks, with one letter for each word."""
    return F.regexp_replace(F.regexp_replace(line, text.pattern(r"\w+"), "w"), text.pattern(r"\s+"), "")


def _candidates(shapes: Column) -> Column:
    """array of the places of the windows that share their shape with another window."""

    def again(hashes: Column) -> Column:
        def twice(order: Column) -> Column:
            later = F.slice(order, F.lit(2), F.size(order))
            equal = F.zip_with(order, later, lambda a, b: F.when(a == b, a))
            return F.array_distinct(F.filter(equal, lambda h: h.isNotNull()))

        def places(of: Column) -> Column:
            marked = F.transform(hashes, lambda h, i: F.when(F.array_contains(of, h), i))
            return F.filter(marked, lambda i: i.isNotNull())

        return text.let(text.let(F.array_sort(hashes), twice), places)

    last = F.size(shapes) - config.CLONE_LINES
    window = lambda i: F.xxhash64(*[F.get(shapes, i + k) for k in range(config.CLONE_LINES)])
    return text.let(F.transform(F.sequence(F.lit(0), last), window), again)


def blocks(code: Column, names: Column) -> Column:
    """array<struct<i, leader, exact, line>> of the first duplicate blocks of a text, by their lines.

    Only windows whose shape recurs are looked at closely, by hashes of their lines and of
    their form, so that a long text holds two short texts for each of them."""
    def of_lines(lines: Column) -> Column:
        def window(i: Column) -> Column:
            def hashed(block: Column) -> Column:
                joined = F.array_join(block, "\n")
                raw, form = F.sha2(joined, 256), F.sha2(_form(block, names), 256)
                long = F.length(F.array_join(block, "")) >= config.CLONE_LEAST_CHARS
                return F.when(long, F.struct(i.alias("i"), raw.alias("raw"), form.alias("form")))

            return text.let(F.slice(lines, i + 1, F.lit(config.CLONE_LINES)), hashed)

        def against_first(windows: Column) -> Column:
            def led(forms: Column) -> Column:
                def found(w: Column) -> Column:
                    first = F.get(windows, (F.array_position(forms, w["form"]) - 1).cast("int"))
                    exact = w["raw"] == first["raw"]
                    return F.struct(w["i"].alias("i"), first["i"].alias("leader"), exact.alias("exact"), (w["i"] + 1).alias("line"))

                return F.filter(F.transform(windows, found), lambda x: x["i"] != x["leader"])

            return text.let(F.transform(windows, lambda w: w["form"]), led)

        places = text.let(F.transform(lines, _shape), _candidates)
        some = F.filter(F.transform(places, window), lambda w: w.isNotNull())
        found = F.slice(text.let(some, against_first), 1, config.CLONE_FINDINGS)
        return F.when(F.size(lines) >= config.CLONE_LINES, found.cast(BLOCKS)).otherwise(F.array().cast(BLOCKS))

    return text.let(F.slice(F.transform(text.lines(code), text.strip), 1, config.CLONE_SCANNED_LINES), of_lines)


def duplicate_blocks(documents: DataFrame, key: str = "submission_id", code: str = "code", keywords: Column | None = None) -> DataFrame:
    """(key, i, leader, exact, line_number): the first findings of each document in line order."""
    names = F.array().cast("array<string>") if keywords is None else keywords
    rows = documents.select(key, F.explode(blocks(F.col(code), names)).alias("x"))
    return rows.select(key, "x.i", "x.leader", "x.exact", F.col("x.line").alias("line_number"))


def keywords_of(language: Column) -> Column:
    """The words of a language that are no names: Python's own."""
    python = F.array(*[F.lit(k) for k in keyword.kwlist])
    return F.when(language == "Python", python).otherwise(F.array().cast("array<string>"))


def _span(i: Column) -> Column:
    return F.concat((i + 1).cast("string"), F.lit("-"), (i + config.CLONE_LINES).cast("string"))


def _spans(x: Column) -> dict[str, Column]:
    return {"here": _span(x["i"]), "there": _span(x["leader"])}


#: The findings that ``blocks`` stand for.
CHECKS = (
    Check("equal_block", lambda x: x["exact"], _spans),
    Check("alike_block", lambda x: ~x["exact"], _spans),
)


def clone_findings(submissions: DataFrame) -> DataFrame:
    """The duplicate blocks of submissions as code findings."""
    found = checks.found(blocks(F.col("code"), keywords_of(F.col("language"))), CHECKS)
    return submissions.select("submission_id", F.posexplode(found).alias("seq", "x")).select("submission_id", F.col("seq").cast("long"), "x.*")
