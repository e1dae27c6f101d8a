"""Rows brought up to date: upserts that give the whole new table, backfills, resets, seeds and syncs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pantrylake.functions import fixed
from pantrylake.functions.text import clean_text, normal_name
from pantrylake.operators.upsert import non_empty, replace_children, upsert_two_keys


def write_upsert(target: DataFrame, source: DataFrame, id_: str, one: str, two: str, keep: list[str] = ()) -> DataFrame:
    """The new target: rows that share either key updated by non-empty values (columns in `keep` stay), others added with new ids.

    Several source rows for one target row are merged, the one with the greatest keys last.
    """
    kinds, cols = dict(target.dtypes), [c for c in target.columns if c != id_]
    marked = upsert_two_keys(target, source, id_, one, two)
    found = marked.filter(F.col(id_).isNotNull())
    last = {c: F.max_by(F.col(c), F.when(non_empty(F.col(c), kinds[c]).isNotNull(), F.struct(one, two))) for c in cols if c in source.columns}
    patch = found.groupBy(id_).agg(*[v.alias(f"_{c}") for c, v in last.items()])
    updated = target.join(patch, id_, "left").select(
        id_, *[(F.coalesce(non_empty(F.col(f"_{c}"), kinds[c]), F.col(c)) if c in last and c not in keep else F.col(c)).alias(c) for c in cols]
    )
    top = target.agg(F.coalesce(F.max(id_), F.lit(0)).alias("_top"))
    new = marked.filter(F.col(id_).isNull()).dropDuplicates([one]).join(F.broadcast(top), how="cross")  # top is a single row
    return updated.unionByName(numbered_rows(new, one, id_).select(*[F.col(c) for c in target.columns if c in source.columns or c == id_]), allowMissingColumns=True)


def numbered_rows(new: DataFrame, by: str, id_: str) -> DataFrame:
    """New rows with ids above `_top`, in the order of a key: counted by ranges, then within each, never in one task."""
    spark = new.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, 8)
    ranged = new.drop(id_).repartitionByRange(parts, by).withColumn("_part", F.spark_partition_id())
    inner = ranged.withColumn("_place", F.row_number().over(W.partitionBy("_part").orderBy(by)))
    sizes = inner.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # a row a part
    return inner.join(F.broadcast(before), "_part").withColumn(id_, F.col("_top") + F.col("_before") + F.col("_place")).drop("_part", "_place", "_before", "_top")


def children_with_names(children: DataFrame, new: DataFrame, key: str, names: DataFrame) -> DataFrame:
    """As replace_children, with missing names and units filled from names(name_key, name, unit)."""
    known = names.select("name_key", F.col("name").alias("_name"), F.col("unit").alias("_unit"))
    filled = new.withColumn("name_key", normal_name(F.col("raw_text"))).join(known, "name_key", "left")
    filled = filled.withColumns({"name": F.coalesce("name", "_name", "raw_text"), "unit": F.coalesce("unit", "_unit")}).drop("_name", "_unit", "name_key")
    return replace_children(children, filled, key)


def reviews(existing: DataFrame, new: DataFrame) -> DataFrame:
    """existing with new(record, rating, comment, author, at) added, one row a hash of all but the time; the latest time wins."""
    digest = F.sha2(F.concat_ws("|", F.col("record").cast("string"), F.col("rating").cast("string"), F.trim(F.coalesce("comment", F.lit(""))), F.lower(F.trim("author"))), 256)
    both = existing.unionByName(new).withColumn("review_hash", digest)
    return both.groupBy("review_hash").agg(*[F.max_by(c, "at").alias(c) for c in existing.columns])


def cleared(df: DataFrame, cols: list[str], by: str = "state_method", methods: list[str] = ("inferred",)) -> DataFrame:
    """Columns that a method of these has filled, emptied."""
    return df.withColumns({c: F.when(F.col(by).isin(*methods), F.lit(None)).otherwise(F.col(c)) for c in cols})


def better_steps(df: DataFrame, gain: int = 80, force: bool = False) -> Column:
    """Whether new_steps should replace old ones: more steps and no fewer characters, or so many more characters."""
    chars = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda n, s: n + F.length(s))
    new, old = F.coalesce("new_steps", F.array().cast("array<string>")), F.coalesce("old_steps", F.array().cast("array<string>"))
    more = (F.size(new) > F.size(old)) & (chars(new) >= chars(old))
    return (F.size(new) > 0) & (F.lit(force) | more | (chars(new) >= chars(old) + gain))


def wants_nutrition(df: DataFrame) -> DataFrame:
    """Rows with a web address and no nutrition."""
    return df.filter(F.col("source_url").rlike("^https?://") & (F.coalesce(F.trim("nutrition_info"), F.lit("")).isin("", "{}", "null")))


def normalised_fallback(name: Column) -> Column:
    """(canonical, confidence, flags) of a name that no tier knows: itself, if it is six words at most and has no number."""
    c = F.regexp_replace(normal_name(name), r"\b(?:as needed|optional)\b", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"^\s*or\s+\d+\s+", " "), r"^\s*\d+\s+", " ")
    c = F.trim(F.regexp_replace(c, r"\s+", " "))
    words = F.split(c, " ")
    single = (F.size(words) == 1) & c.isin(sorted({u for u in fixed.LINE_UNITS if " " not in u}))
    good = (c != "") & (F.size(words) <= 6) & ~single & ~F.exists(words, lambda w: w.rlike(r"^\d+\.?\d*$"))
    flags = F.array(F.lit("normalized_fallback"), F.lit("curator_review_required"))
    return F.when(good, F.struct(F.replace(c, F.lit(" "), F.lit("_")).alias("canonical"), F.lit(0.55).alias("confidence"), flags.alias("flags")))


def corrected(items: DataFrame, corrections: DataFrame) -> DataFrame:
    """items(name, canonical) with corrections(alias, canonical) applied to unresolved names; `corrected` says where."""
    fix = corrections.select(normal_name(F.col("alias")).alias("_k"), F.col("canonical").alias("_c")).dropDuplicates(["_k"])
    out = items.withColumn("_k", normal_name(F.col("name"))).join(fix, "_k", "left")
    hit = F.col("canonical").isNull() & F.col("_c").isNotNull()
    return out.withColumn("corrected", hit).withColumn("canonical", F.coalesce("canonical", "_c")).drop("_k", "_c")


def synced(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """target as source has it: rows of source win, rows that only target has stay."""
    return target.join(source.select(key), key, "left_anti").unionByName(source, allowMissingColumns=True)


def seed_masters(categories: DataFrame, forms: list[str], crossed: str = "pulses") -> DataFrame:
    """Master rows from categories(category, name, pos): names of one category also in each form, the last listed of a name wins."""
    own = categories.select("category", F.col("name"), "pos")
    shaped = categories.filter(F.col("category") == crossed).select("category", F.explode(F.transform(F.array(*[F.lit(f) for f in forms]), lambda f: F.concat_ws(" ", "name", f))).alias("name"), F.col("pos"))
    rows = own.unionByName(shaped).withColumn("canonical", F.regexp_replace(F.lower(F.trim("name")), r"\s+", "_"))
    return rows.groupBy("canonical").agg(F.max_by("category", F.struct("pos", "category")).alias("category"), F.max_by("name", F.struct("pos", "name")).alias("name"))


def title_rows(rows: DataFrame) -> DataFrame:
    """Loose rows under one of several spellings of their columns as (title, ingredients); rows without a title go."""
    pick = lambda names: F.coalesce(*[F.nullif(clean_text(F.col(f"`{n}`")), F.lit("")) for n in names if n in rows.columns], F.lit(None).cast("string"))
    out = rows.select(pick(["title", "RecipeName", "name", "recipe_name"]).alias("title"), F.split(pick(["ingredients", "Ingredients", "TranslatedIngredients"]), r"\s*,\s*").alias("ingredients"))
    return out.filter("title IS NOT NULL")
