"""Ordered operators on long groups, in two levels.

A window over a whole book would sort the largest book in one task. Here the order inside a page
is found per page, and only one narrow row per page goes into the window over the book.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of each key by ``order``; of full ties any one."""
    w = W.partitionBy(*keys).orderBy(*[c.desc_nulls_last() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def neighbours(df: DataFrame, group: str, page: str, order: list[str], value: str, before: str, after: str) -> DataFrame:
    """``value`` of the row before and after in (page, order) within the group, over page ends too."""
    own = W.partitionBy(group, page).orderBy(*order)
    inner = df.withColumns({"_p": F.lag(value).over(own), "_n": F.lead(value).over(own), "_i": F.row_number().over(own), "_k": F.count(F.lit(1)).over(W.partitionBy(group, page))})
    key = F.struct(*order)
    edges = df.groupBy(group, page).agg(F.min_by(value, key).alias("_first"), F.max_by(value, key).alias("_last"))
    book = W.partitionBy(group).orderBy(page)
    edges = edges.select(group, page, F.lag("_last").over(book).alias("_up"), F.lead("_first").over(book).alias("_down"))
    out = inner.join(edges, [group, page])
    return out.withColumns({before: F.when(F.col("_i") == 1, F.col("_up")).otherwise(F.col("_p")), after: F.when(F.col("_i") == F.col("_k"), F.col("_down")).otherwise(F.col("_n"))}).drop("_p", "_n", "_i", "_k", "_up", "_down")


def running(df: DataFrame, group: str, page: str, order: list[str], amount: Column, out: str) -> DataFrame:
    """Running sum of ``amount`` in (page, order) within the group."""
    own = W.partitionBy(group, page).orderBy(*order)
    inner = df.withColumn("_amount", amount).withColumn("_in", F.sum("_amount").over(own.rowsBetween(W.unboundedPreceding, 0)))
    book = W.partitionBy(group).orderBy(page).rowsBetween(W.unboundedPreceding, -1)
    sums = df.groupBy(group, page).agg(F.sum(amount).alias("_page")).select(group, page, F.coalesce(F.sum("_page").over(book), F.lit(0)).alias("_before"))
    return inner.join(sums, [group, page]).withColumn(out, F.col("_in") + F.col("_before")).drop("_amount", "_in", "_before")
