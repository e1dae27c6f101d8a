"""Upserts on plain tables: joins that give the new state, since Parquet has no MERGE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def non_empty(c: Column, kind: str) -> Column:
    """Null where a new value says nothing: null, "", an empty array or map."""
    if kind == "string":
        return F.nullif(c, F.lit(""))
    if kind.startswith(("array", "map")):
        return F.when(F.size(c) > 0, c)
    return c


def merge_nonempty(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """target with source merged in: a new value replaces the old one only if it isn't empty; other rows are added.

    Adds `inserted`.  Keys must be unique in source.
    """
    kinds = dict(target.dtypes)
    t, s = target.alias("t"), source.alias("s")
    on = [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys]
    rows = t.join(s, on, "full")
    cols = [F.coalesce(f"t.{k}", f"s.{k}").alias(k) for k in keys]
    for c in target.columns:
        if c not in keys:
            cols.append((F.coalesce(non_empty(F.col(f"s.{c}"), kinds[c]), F.col(f"t.{c}")) if c in source.columns else F.col(f"t.{c}")).alias(c))
    return rows.select(*cols, F.col(f"t.{keys[0]}").isNull().alias("inserted"))


def upsert_two_keys(target: DataFrame, source: DataFrame, id_: str, one: str, two: str) -> DataFrame:
    """source with the least target id that shares either key, and whether that makes an update or an insert."""
    by_one = target.filter(F.col(one).isNotNull()).groupBy(one).agg(F.min(id_).alias("_a"))
    by_two = target.filter(F.col(two).isNotNull()).groupBy(two).agg(F.min(id_).alias("_b"))
    rows = source.join(by_one, one, "left").join(by_two, two, "left")
    found = F.least("_a", "_b")
    return rows.withColumn(id_, found).withColumn("action", F.when(found.isNull(), "insert").otherwise("update")).drop("_a", "_b")


def replace_children(children: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """children with those of every parent in new replaced."""
    return children.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_absent(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows of new whose key is neither in existing nor seen before in new."""
    return new.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def insert_absent_nocase(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """As insert_absent, regardless of case."""
    known = existing.select(F.lower(key).alias("_k")).distinct()
    return new.withColumn("_k", F.lower(key)).dropDuplicates(["_k"]).join(known, "_k", "left_anti").drop("_k")


def cascade_delete(tables: dict[str, DataFrame], ids: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table without the rows of the given ids."""
    return {name: df.join(ids.select(key), key, "left_anti") if key in df.columns else df for name, df in tables.items()}


def merge_maps(old: Column, patch: Column) -> Column:
    """old with the keys of patch replaced, as JSON || does at the top level."""
    empty = F.create_map().cast("map<string,string>")
    old, patch = F.coalesce(old, empty), F.coalesce(patch, empty)
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(patch, k)), patch)
