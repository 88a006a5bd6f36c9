"""Operators on message headers and section logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sticky(sections: DataFrame, message: list[str], order: str, numbers: tuple[int, ...] = (1, 2, 3, 4, 5, 6)) -> DataFrame:
    """A row for each data section (7) with the place s<n> of the last section n before it in its physical message.

    sections: message columns, an order column, number. A section holds until
    another of its number replaces it; a bitmap that says "as before" (column
    reuse) leaves the one before in force.
    """
    run = Window.partitionBy(*message).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reuse = F.col("reuse") if "reuse" in sections.columns else F.lit(False)
    held = sections
    for n in numbers:
        here = (F.col("number") == n) & (~reuse if n == 6 else F.lit(True))
        held = held.withColumn(f"s{n}", F.last(F.when(here, F.col(order)), ignorenulls=True).over(run))
    return held.where("number = 7").select(*message, F.col(order).alias("s7"), *(f"s{n}" for n in numbers))


def resolved(messages: DataFrame, parameters: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """messages with the names of their parameter key; null where it isn't known. Repeated keys of parameters count once."""
    one = parameters.dropDuplicates(keys).select(*(F.col(k).alias(f"p_{k}") for k in keys), *names)
    match = F.lit(True)
    for k in keys:
        match = match & (F.col(k) == F.col(f"p_{k}"))
    return messages.join(one, match, "left").drop(*(f"p_{k}" for k in keys))
