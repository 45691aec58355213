"""Prompts from conversations, as a model's proxy sends them on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flattened(parts: Column) -> Column:
    """The text of a list of parts (type, text): its text parts, one after another."""
    return F.array_join(F.transform(F.filter(parts, lambda p: p.type == "text"), lambda p: F.coalesce(p.text, F.lit(""))), "")


def assembled(messages: DataFrame, by: str = "conv_id", order: str = "turn", system: Column | None = None) -> DataFrame:
    """(by, prompt): the system text if there is any, then each message as ``ROLE: content``
    in its order, with an empty line after each. The messages of one conversation meet in
    one row, as its prompt does."""
    line = F.concat(F.upper(F.coalesce("role", F.lit("user"))), F.lit(": "), F.coalesce("text", F.lit("")), F.lit("\n\n"))
    held = messages.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order), line.alias("line")))).alias("lines"), *([F.first(system, ignorenulls=True).alias("system")] if system is not None else []))
    body = F.array_join(F.transform("lines", lambda x: x.line), "")
    if system is not None:
        body = F.concat(F.when(F.coalesce("system", F.lit("")) != "", F.concat("system", F.lit("\n\n"))).otherwise(F.lit("")), body)
    return held.select(by, body.alias("prompt"))
