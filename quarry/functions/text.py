"""String functions with the semantics of Python's, as column expressions.

Patterns are Java patterns in UNIX_LINES and UNICODE_CHARACTER_CLASS mode, which is
what Python's ``re`` does with them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[\s\x1c-\x1f]"
_LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def pattern(p: str) -> str:
    """``p`` with Python's reading of dots, line ends and character classes."""
    return f"(?dU){p}"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for each row, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)\A{_SPACE}+|{_SPACE}+\z", "")


def not_blank(c: Column) -> Column:
    return c.rlike(r"(?U)[^\s\x1c-\x1f]")


def lines(c: Column) -> Column:
    """The lines of a text without their ends; a line end at the text's end adds none."""
    return let(F.split(c, _LINE_ENDS, -1), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts))


def newlines(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def words(c: Column) -> Column:
    """Number of runs without white space."""
    return F.regexp_count(c, F.lit(r"(?U)[^\s\x1c-\x1f]+"))


def count(p: str, c: Column) -> Column:
    return F.regexp_count(c, F.lit(pattern(p)))


def all_matches(p: str, c: Column, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern(p)), F.lit(group))


def matches(p: str, c: Column) -> Column:
    """array<struct<line, text, end>> of all matches of ``p``, which must not match the
    empty string: the line a match starts in, itself, and how many characters end with it."""

    def places(s: Column) -> Column:
        none = F.array().cast("array<struct<line:int,text:string,end:int>>")
        start = F.struct(none.alias("out"), F.lit(1).alias("line"), F.lit(0).alias("at"))

        def step(done: Column, pair: Column) -> Column:
            line = done["line"] + newlines(pair["part"])
            end = done["at"] + F.length(pair["part"]) + F.length(pair["match"])
            found = F.struct(line.alias("line"), pair["match"].alias("text"), end.alias("end"))
            return F.struct(
                F.concat(done["out"], F.array(found)).alias("out"),
                (line + newlines(pair["match"])).alias("line"),
                end.alias("at"),
            )

        parts = F.slice(s["parts"], F.lit(1), F.size(s["found"]))
        pairs = F.zip_with(parts, s["found"], lambda a, b: F.struct(a.alias("part"), b.alias("match")))
        return F.aggregate(pairs, start, step, lambda done: done["out"])

    return let(F.struct(all_matches(p, c).alias("found"), F.split(c, pattern(p), -1).alias("parts")), places)


def line_matches(p: str, c: Column, first: int) -> Column:
    """array<struct<line, text>> of the first matches of ``p``; counts line ends only."""

    def places(s: Column) -> Column:
        def place(x: Column, k: Column) -> Column:
            before = F.concat(F.array_join(F.slice(s.parts, F.lit(1), k + 1), ""), F.array_join(F.slice(s.found, F.lit(1), k), ""))
            return F.struct((newlines(before) + 1).cast("int").alias("line"), x.alias("text"))

        return F.transform(s.found, place)

    return let(F.struct(F.slice(all_matches(p, c), 1, first).alias("found"), F.split(c, pattern(p), first + 1).alias("parts")), places)


def lookup(c: Column, table: dict[str, float | int], other: float | int) -> Column:
    """The value of a small fixed table for each text, or ``other``."""
    out = F.lit(other)
    for key, value in reversed(table.items()):
        out = F.when(c == key, F.lit(value)).otherwise(out)
    return out


def brace_block(c: Column) -> Column:
    """From the brace that ``c`` starts with to the one that closes it, or to the end."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("size"), F.lit(False).alias("done"))

    def step(s: Column, piece: Column) -> Column:
        depth = s.depth + F.when(F.endswith(piece, F.lit("{")), 1).when(F.endswith(piece, F.lit("}")), -1).otherwise(0)
        size = F.when(s.done, s.size).otherwise(s.size + F.length(piece))
        return F.struct(F.when(s.done, s.depth).otherwise(depth).alias("depth"), size.alias("size"), (s.done | ((depth == 0) & F.endswith(piece, F.lit("}")))).alias("done"))

    return F.substring(c, F.lit(1), F.aggregate(F.split(c, r"(?<=[{}])", -1), start, step).size)
