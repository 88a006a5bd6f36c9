"""The algebra of packed values as relations: rows of packed numbers become rows of values.

The byte kernels in sources/ do the same on whole arrays; these operators serve
packed numbers that are already columns, and fields too large for one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def scaled(x: str, reference: float, binary: int, decimal: int) -> str:
    """(reference + x * 2^binary) / 10^decimal as SQL, in the order of terms that the array kernels use."""
    unit = 10.0**-decimal
    return f"({reference * unit:.17e} + ({x}) * {2.0**binary * unit:.17e})"


def bits_at(number: str, width: int, place: int, of: int) -> str:
    """The place-th group of `width` bits of a number of `of` bits, highest first."""
    return f"(floor(({number}) / {1 << (of - width * (place + 1))}) % {1 << width})"


def expanded(bitmap: DataFrame, packed: DataFrame, keys: list[str] = ()) -> DataFrame:
    """(keys, off, value): the packed values, in order of ordinal, at the places whose bit is set; null elsewhere.

    bitmap: keys, off, bit. packed: keys, ordinal from 0, value. The ordinal of a
    place is the running count of set bits of its field.
    """
    keys = list(keys)
    run = Window.partitionBy(*keys).orderBy("off").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = bitmap.withColumn("ordinal", F.when(F.col("bit"), F.sum(F.col("bit").cast("long")).over(run) - 1))
    named = packed.select(*(F.col(k).alias(f"p_{k}") for k in keys), F.col("ordinal").alias("p_ordinal"), "value")
    match = F.col("ordinal") == F.col("p_ordinal")
    for k in keys:
        match = match & (F.col(k) == F.col(f"p_{k}"))
    return placed.join(named, match, "left").select(*keys, "off", "value")


def bitmap_bytes(validity: DataFrame, keys: list[str] = ()) -> DataFrame:
    """(keys, byte_no, byte): the bits of a field packed highest first."""
    place = F.col("off") % 8
    weight = F.element_at(F.array(*(F.lit(128 >> k) for k in range(8))), (place + 1).cast("int"))
    return validity.groupBy(*keys, F.floor(F.col("off") / 8).cast("long").alias("byte_no")).agg(F.sum(F.when(F.col("bit"), weight).otherwise(0)).cast("int").alias("byte"))


def group_values(groups: DataFrame, keys: list[str], reference: str = "ref", length: str = "len", offset: Column | None = None) -> DataFrame:
    """A row for each of a group's `length` places k with x = reference + the packed offset of that place (0 for groups of no width)."""
    rows = groups.withColumn("k", F.explode(F.expr(f"sequence(0, {length} - 1)")))
    return rows.select(*keys, "k", (F.col(reference) + (F.lit(0) if offset is None else offset)).alias("x"))


def undifferenced(rows: DataFrame, keys: list[str], order: list[str], order_of: int, x: str = "x", least: int = 0) -> DataFrame:
    """rows with `full`, the values whose first or second differences x are (plus `least`, from the order_of-th row on); missing x stay missing and are passed over.

    A first-order field is the running sum of differences; a second-order one is
    the running sum of running sums. Both are exact on whole numbers.
    """
    run = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = F.count(x).over(run)  # places count values that aren't missing
    d = rows.withColumn("_at", place)
    own = F.when(F.col("_at") > order_of, F.col(x) + least).otherwise(F.col(x))
    if order_of == 1:
        full = d.withColumn("_d", own).withColumn("full", F.when(F.col(x).isNotNull(), F.sum("_d").over(run)))
        return full.drop("_at", "_d")
    # the second row holds a value, not a difference of differences: its first difference is x2 - x1
    first = Window.partitionBy(*keys)
    head = d.withColumn("_x1", F.max(F.when(F.col("_at") == 1, F.when(F.col(x).isNotNull(), F.col(x)))).over(first))
    step = F.when(F.col("_at") == 1, 0).when(F.col("_at") == 2, F.col(x) - F.col("_x1")).otherwise(F.col(x) + least)
    steps = head.withColumn("_s", F.when(F.col(x).isNotNull(), step)).withColumn("_r", F.when(F.col(x).isNotNull(), F.sum("_s").over(run)))
    return steps.withColumn("full", F.when(F.col(x).isNotNull(), F.col("_x1") + F.sum("_r").over(run))).drop("_at", "_x1", "_s", "_r")


def packing(fields: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """(keys, reference, binary): the simple packing of each field's values into `bits` bits with decimal scale 0."""
    spread = fields.groupBy(*keys).agg(F.min("value").alias("reference"), F.max("value").alias("top"))
    span = F.col("top") - F.col("reference")
    binary = F.when(span > 0, F.ceil(F.log2(span / F.lit(float(2**bits - 1)))).cast("int")).otherwise(0)
    return spread.select(*keys, "reference", binary.alias("binary"))
