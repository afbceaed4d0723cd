"""Linear interpolation of short, bounded gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dense(df: DataFrame, axis: DataFrame, cells: DataFrame, time: str = "t") -> DataFrame:
    """One row for each time and cell: absent ones have null values. The axis is small next to the cells."""
    keys = [time, *cells.columns]
    return cells.crossJoin(axis.select(time)).join(df, keys, "left")


def fill_short_gaps(df: DataFrame, values: tuple[str, ...], max_steps: int, cell: tuple[str, ...], time: str = "t", basis: str = "index", step: float | None = None) -> DataFrame:
    """Runs of at most ``max_steps`` missing rows between two complete ones are interpolated; adds ``imputed``.

    A row is missing if any of its values is null. Rows are dense along the axis of each cell; ``basis`` index counts rows, whatever
    the times between them; basis time weighs by time and also asks that a run spans at most max_steps + 1 steps of ``step``.
    Only a window within each cell, so cells spread over all tasks; its frames are as long as a gap may be, so time is linear in the rows.
    """
    if max_steps == 0:
        return df.withColumn("imputed", F.lit(False))
    w = W.partitionBy(*cell).orderBy(time)
    before, after = w.rowsBetween(-max_steps, -1), w.rowsBetween(1, max_steps)  # a bound further off is no bound of a short gap
    whole = F.lit(True)
    for c in values:
        whole = whole & F.col(c).isNotNull()
    x = df.withColumn("__ok", whole).withColumn("__i", F.row_number().over(w))
    at = F.col("__i") if basis == "index" else F.col(time)
    packed = F.when(F.col("__ok"), F.struct(F.col("__i").alias("i"), at.alias("x"), *(F.col(c) for c in values)))
    x = x.withColumn("__a", F.last(packed, True).over(before)).withColumn("__b", F.first(packed, True).over(after))
    short = ~F.col("__ok") & F.col("__a").isNotNull() & F.col("__b").isNotNull() & (F.col("__b.i") - F.col("__a.i") - 1 <= max_steps)
    if basis == "time" and step is not None:
        short = short & (F.col("__b.x") - F.col("__a.x") <= (max_steps + 1) * step)
    part = (at - F.col("__a.x")).cast("double") / (F.col("__b.x") - F.col("__a.x")).cast("double")
    out = x.withColumn("imputed", short)
    for c in values:
        out = out.withColumn(c, F.when(F.col("imputed"), F.col(f"__a.{c}") + part * (F.col(f"__b.{c}") - F.col(f"__a.{c}"))).otherwise(F.col(c)))
    return out.drop("__ok", "__i", "__a", "__b")
