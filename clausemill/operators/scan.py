"""Running values within a document, in two levels, so that one huge document is split over tasks.

A document's rows are cut into segments by their ordinal (`segment` ordinals each; ordinals are the numbers of lines, headings or pages,
so a segment holds about that many rows).  A window runs within each segment.  Of each segment one row goes on, with what the segment adds;
a window over those carries the state from segment to segment, and it is joined back to the segments' rows.  The result is that of one window over the
document; rows are written once and shuffled once, by segment.  The first window sees `segment` rows at a time, the second a row for each segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausemill.tables import settle


def running(df: DataFrame, by: list[str], order: str, values: dict[str, tuple[str, Column]], inclusive: bool = True, segment: int | None = None) -> DataFrame:
    """df with a column for each of values: name -> (how, column).

    how: `last`, the latest value that is not null, or `sum`, of the values that are not null (0 before the first).  inclusive: the row's own value counts.
    segment: ordinals in a segment; None runs one window over the document.
    """
    end = Window.currentRow if inclusive else -1
    columns, group = df.columns, by
    if segment is not None:
        # read twice below, so written once; a struct is never null and equals one with the same nulls, so the join keeps the windows' partitions
        part = F.struct(*by, F.floor(F.col(order) / segment).cast("long").alias("__part"))
        df = settle(df, "running", even=False).withColumn("__part_of", part).withColumn("__hash", F.xxhash64("__part_of"))
        group = ["__hash", "__part_of"]
    local = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, end)
    made = {n: F.last(c, ignorenulls=True).over(local) if how == "last" else F.coalesce(F.sum(c).over(local), F.lit(0)) for n, (how, c) in values.items()}
    if segment is None:
        return df.withColumns(made)
    ends = {n: F.max_by(c, F.when(c.isNotNull(), F.col(order))) if how == "last" else F.coalesce(F.sum(c), F.lit(0)) for n, (how, c) in values.items()}
    states = df.groupBy(*group).agg(*(x.alias(n) for n, x in ends.items())).select("*", *(F.col(f"__part_of.{c}").alias(f"__of_{c}") for c in by), "__part_of.__part")
    before = Window.partitionBy(*(f"__of_{c}" for c in by)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = states.select(*group, *((F.last(n, ignorenulls=True).over(before) if how == "last" else F.sum(n).over(before)).alias(f"__c_{n}") for n, (how, _) in values.items()))
    joined = df.withColumns(made).join(carried, group, "left")
    both = [(F.coalesce(n, f"__c_{n}") if how == "last" else F.col(n) + F.coalesce(f"__c_{n}", F.lit(0))).alias(n) for n, (how, _) in values.items()]
    return joined.select(*columns, *both)


def following(df: DataFrame, order: str, value: str, segment: int = 65_536) -> DataFrame:
    """df with `next`, the value of the row with the next larger ordinal, gaps or not; null at the end.  Ordinals are whole numbers and differ.

    Within a segment by a window; the last row of one takes the first of the next segment that has rows.
    """
    df = df.withColumn("__part", F.floor(F.col(order) / segment).cast("long"))
    ahead = F.lead(value).over(Window.partitionBy("__part").orderBy(order))
    last = F.row_number().over(Window.partitionBy("__part").orderBy(F.desc(order))) == 1
    firsts = df.groupBy("__part").agg(F.min_by(value, order).alias("__first"))
    carried = firsts.select(F.col("__part").alias("__at"), F.lead("__first").over(Window.orderBy("__part")).alias("__first"))  # a row for each segment
    joined = df.withColumns({"next": ahead, "__last": last}).join(carried, F.col("__part") == F.col("__at"))
    return joined.withColumn("next", F.when(F.col("__last"), F.col("__first")).otherwise(F.col("next"))).drop("__part", "__at", "__first", "__last")
