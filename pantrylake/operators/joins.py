"""Join and per-key patterns that Spark SQL has no single operator for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The row of each key that is greatest by the given columns (DISTINCT ON … ORDER BY … DESC).

    An aggregate rather than a window: rows are combined before the shuffle, so a hot key costs one row a task.
    """
    rest = [c for c in df.columns if c not in keys and c not in by]
    top = df.groupBy(*keys).agg(F.max(F.struct(*by, *rest)).alias("_top"))
    return top.select(*keys, *[F.col(f"_top.{c}").alias(c) for c in [*by, *rest]]).select(*df.columns)


def top_per_key(df: DataFrame, keys: list[str], by: list, n: int, name: str = "rn") -> DataFrame:
    """The first n rows of each key; Spark limits each partition before the shuffle."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*by))).filter(F.col(name) <= n)


def missing(df: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without a counterpart (NOT EXISTS)."""
    return df.join(present.select(*keys), keys, "left_anti")


def sorted_distinct_text(col: str, sep: str) -> Column:
    """Distinct values joined in order, as STRING_AGG(DISTINCT …) gives them in engines that sort."""
    return F.array_join(F.array_sort(F.collect_set(col)), sep)


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, values: list[str], slice_by: Column | None = None) -> DataFrame:
    """Each left row with the values of the last right row of its key at or before its time.

    One union and one window: both sides shuffle once by key, and nothing is paired that isn't kept.
    """
    packed = F.struct(*values)
    both = left.withColumn("_v", F.lit(None).cast(right.select(packed.alias("x")).schema["x"].dataType)).withColumn("_side", F.lit(1))
    other = right.select(F.col(key), F.col(at), packed.alias("_v"), F.lit(0).alias("_side"))
    w = W.partitionBy(key).orderBy(at, "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = both.unionByName(other, allowMissingColumns=True).withColumn("_v", F.last("_v", ignorenulls=True).over(w))
    return rows.filter("_side = 1").select(*left.columns, *[F.col(f"_v.{c}").alias(c) for c in values])


def within(left: DataFrame, right: DataFrame, a: str, b: str, reach: int) -> DataFrame:
    """Left rows with every right row whose b is within reach of a (left outer): an equal join on slices of that width.

    Each left row lies in one slice and each right row is dealt to three, so there is no nested loop over the tables, every
    pair is met once, and one outer join also keeps the left rows without any.  Column names must differ; AQE splits a busy slice.
    """
    one = left.withColumn("_slice", F.floor(F.col(a) / reach))
    three = right.withColumn("_near", F.explode(F.array(*[F.floor(F.col(b) / reach) + d for d in (-1, 0, 1)])))
    return one.join(three, (F.col("_slice") == F.col("_near")) & (F.abs(F.col(a) - F.col(b)) <= reach), "left").drop("_slice", "_near")
