"""Rates, completeness counts and coverage gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe_rate(part: Column, whole: Column) -> Column:
    """part / whole to four digits, 0 where the whole is 0 or null."""
    return F.coalesce(F.round(F.try_divide(part.cast("double"), whole.cast("double")), 4), F.lit(0.0))


def completeness(df: DataFrame, by: list[str], checks: dict[str, str]) -> DataFrame:
    """Counts of rows that meet each named condition, in one pass."""
    return df.groupBy(*by).agg(F.count("*").alias("total"), *[F.count_if(F.expr(c)).alias(name) for name, c in checks.items()])


def state_gap(places: DataFrame, have: DataFrame, target: int, n_places: int) -> DataFrame:
    """What each place lacks of its even share of a target; places without rows lack all of it."""
    share = -(-target // n_places)
    rows = places.join(have, "key", "left")
    return rows.select(*places.columns, F.coalesce("have", F.lit(0)).alias("have"), F.greatest(F.lit(share) - F.coalesce("have", F.lit(0)), F.lit(0)).alias("remaining"))


def rating_summary(reviews: DataFrame, key: str, rating: str) -> DataFrame:
    """Count, mean and a count for each of five stars."""
    return reviews.groupBy(key).agg(
        F.count("*").alias("rating_count"), F.avg(rating).cast("decimal(3,2)").alias("average_rating"), *[F.count_if(F.col(rating) == k).alias(f"stars_{k}") for k in range(1, 6)]
    )


def exposition(row: DataFrame, prefix: str = "pantrylake") -> DataFrame:
    """A one-row frame of numbers as lines of the text exposition format."""
    pairs = F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("double").alias("v")) for c in row.columns])
    line = row.select(F.explode(pairs).alias("p"))
    return line.select(F.concat(F.lit(f"# TYPE {prefix}_"), F.col("p.k"), F.lit(f" gauge\n{prefix}_"), F.col("p.k"), F.lit(" "), F.col("p.v").cast("string")).alias("line"))


def exact_percentile(df: DataFrame, key: str, value: str, p: float, name: str, slices: int = 4096) -> DataFrame:
    """key and the interpolated percentile of its values, as percentile_cont gives it.

    Values are counted in slices of each key's range; only the slices that hold the two ranks asked for are sorted, so that no
    task gets all values of a key.  Nulls are left out.
    """
    from pyspark.sql import Window as W

    rows = df.filter(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("_v"))
    ends = rows.groupBy(key).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n"))
    at = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * slices), F.lit(slices - 1))).otherwise(0)
    cut = rows.join(ends, key).withColumn("_s", at)
    before = F.sum("_c").over(W.partitionBy(key).orderBy("_s").rowsBetween(W.unboundedPreceding, -1))  # at most `slices` rows a key
    sizes = cut.groupBy(key, "_s").agg(F.count("*").alias("_c"), F.first("_n").alias("_n")).withColumn("_b", F.coalesce(before, F.lit(0)))
    rank = F.lit(p) * (F.col("_n") - 1)
    held = sizes.filter((F.col("_b") <= F.ceil(rank)) & (F.col("_b") + F.col("_c") > F.floor(rank))).select(key, "_s", "_b")
    place = F.row_number().over(W.partitionBy(key, "_s").orderBy("_v")) - 1 + F.col("_b")
    near = cut.join(held, [key, "_s"]).withColumn("_r", place).filter((F.col("_r") == F.floor(rank)) | (F.col("_r") == F.ceil(rank)))
    low, high = F.min("_v"), F.max("_v")
    return near.groupBy(key).agg((low + (high - low) * F.first(rank - F.floor(rank))).alias(name))
