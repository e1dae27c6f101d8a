"""Names to canonical entities by tiers: aliases (in several spellings), canonical names, vectors, an injected model, or none.

Each distinct normalised name is resolved once and joined back, so the tiers see a table of names rather than of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pantrylake.functions import fixed
from pantrylake.functions.text import normal_name
from pantrylake.operators.vectors import nearest_above

TIERS = {"alias": 1.0, "canonical": 1.0}


def alias_table(spark: SparkSession, extra: dict[str, str] | None = None) -> DataFrame:
    """alias, canonical; the latest spelling of an alias wins."""
    return spark.createDataFrame(list((fixed.ALIASES | (extra or {})).items()), "alias string, canonical string")


def candidates(name: Column) -> Column:
    """Spellings to try, in order: the name; without counts before it; without a word in front; without "as needed"; without
    noise words; cloves, if it speaks of them; and without pounds."""
    bare = F.regexp_replace(name, r"^(?:(?:to\s+)?(?:\d+(?:\.\d+)?|\d+\s+to\s+\d+|\d+/\d+)(?:\s+(?:" + "|".join(fixed.COUNTED) + r"))?\s+)+", "")
    front = F.regexp_replace(bare, "^(?:" + "|".join(fixed.PREFIXES) + ") ", "")
    words = F.filter(F.split(bare, " "), lambda w: ~w.isin(fixed.NOISE_WORDS) & (w != ""))
    pounds = F.when((F.size(words) > 1) & F.get(words, F.lit(0)).isin("lb", "lbs"), F.array_join(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), " "))
    tried = F.array(
        name, bare, F.when(front != bare, front), F.when(bare.endswith(" as needed"), F.regexp_replace(bare, " as needed$", "")), F.array_join(words, " "),
        F.when(name.rlike(r"\bcloves?\b"), F.lit("cloves")), pounds,
    )
    return F.array_distinct(F.filter(F.transform(tried, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def _keyed(table: DataFrame, name: str) -> DataFrame:
    """One canonical for each normalised name: that of the lowest id where the table has ids, else the least."""
    rows = table.select(normal_name(F.col(name)).alias("_try"), "canonical", *(["id"] if "id" in table.columns else []))
    pick = F.min_by("canonical", F.struct("id", "canonical")) if "id" in rows.columns else F.min("canonical")
    return rows.groupBy("_try").agg(pick.alias("canonical"))


def resolve(
    names: DataFrame, aliases: DataFrame, masters: DataFrame, name: str = "name", vectors: DataFrame | None = None, master_vectors: DataFrame | None = None, threshold: float = 0.88,
    static: DataFrame | None = None,
) -> DataFrame:
    """names with canonical, tier and confidence.  aliases(alias, canonical); masters(canonical); vectors(key, embedding).

    In this order: an alias as it stands, a canonical name as it stands, an alias of `static` (or of aliases) in one of several
    spellings, a vector.  Of several rows for a name that of the lowest id counts, where the tables have ids.  Alias and
    master tables join by hash; Spark broadcasts them when their size allows it.
    """
    keyed = names.withColumn("_key", normal_name(F.col(name)))
    distinct = keyed.select("_key").filter("_key IS NOT NULL AND _key <> ''").distinct()
    tried = distinct.select("_key", F.posexplode(candidates(F.col("_key"))).alias("_pos", "_try"))
    listed = tried.join(_keyed(aliases if static is None else static, "alias"), "_try").groupBy("_key").agg(F.min_by("canonical", "_pos").alias("_l"))
    out = distinct.join(_keyed(aliases, "alias").select(F.col("_try").alias("_key"), F.col("canonical").alias("_a")), "_key", "left")
    out = out.join(_keyed(masters, "canonical").select(F.col("_try").alias("_key"), F.col("canonical").alias("_m")), "_key", "left").join(listed, "_key", "left")
    tier = F.when(F.col("_a").isNotNull(), "alias").when(F.col("_m").isNotNull(), "canonical").when(F.col("_l").isNotNull(), "alias")
    out = out.select("_key", F.coalesce("_a", "_m", "_l").alias("canonical"), tier.alias("tier"))
    out = out.withColumn("confidence", F.when(F.col("tier").isNotNull(), 1.0))
    if vectors is not None and master_vectors is not None:
        rest = out.filter("tier IS NULL").select("_key").join(vectors.withColumnRenamed("key", "_key"), "_key")
        near = nearest_above(rest, master_vectors, "_key", "canonical", threshold).select("_key", F.col("canonical").alias("_v"), "similarity")
        out = out.join(near, "_key", "left").select(
            "_key", F.coalesce("canonical", "_v").alias("canonical"), F.coalesce("tier", F.when(F.col("_v").isNotNull(), "vector")).alias("tier"), F.coalesce("confidence", F.round("similarity", 6)).alias("confidence")
        )
    joined = keyed.join(out, "_key", "left").drop("_key")
    return joined.withColumns({"tier": F.coalesce("tier", F.lit("unresolved")), "confidence": F.coalesce("confidence", F.lit(0.0))})


def with_model(resolved: DataFrame, client: Callable[[list[str]], list[tuple[str | None, float]]], name: str = "name") -> DataFrame:
    """Unresolved names through an injected client that takes a batch; its answers are clamped and marked for review."""
    rest = resolved.filter("tier = 'unresolved'").select(name).distinct()

    def ask(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            got = client(pdf[name].tolist())
            yield pd.DataFrame({name: pdf[name], "_c": [None if c is None else "_".join(c.lower().split()) for c, _ in got], "_p": [min(1.0, max(0.0, float(p))) for _, p in got]})

    answers = rest.mapInPandas(ask, f"`{name}` string, _c string, _p double")
    out = resolved.join(answers, name, "left")
    found = (F.col("tier") == "unresolved") & F.col("_c").isNotNull()
    return out.withColumns({"canonical": F.when(found, F.col("_c")).otherwise(F.col("canonical")), "confidence": F.when(found, F.col("_p")).otherwise(F.col("confidence")), "tier": F.when(found, F.lit("model")).otherwise(F.col("tier")), "needs_review": found}).drop("_c", "_p")


def learn_aliases(aliases: DataFrame, corrections: DataFrame) -> DataFrame:
    """aliases with corrections(alias, canonical, at): the latest for an alias wins, regardless of case."""
    both = aliases.select(F.lower("alias").alias("alias"), "canonical", F.lit(0).alias("_new"), F.lit(None).cast("timestamp").alias("at"))
    both = both.unionByName(corrections.select(F.lower("alias").alias("alias"), "canonical", F.lit(1).alias("_new"), F.col("at").cast("timestamp").alias("at")))
    return both.groupBy("alias").agg(F.max(F.struct("_new", "at", "canonical")).alias("x")).select("alias", "x.canonical")


def resolution_report(resolved: DataFrame, name: str = "name", top: int = 20) -> tuple[DataFrame, DataFrame]:
    """One row of counts and the rate, and the most frequent unresolved names."""
    from pantrylake.operators.metrics import safe_rate

    done = F.col("tier") != "unresolved"
    summary = resolved.agg(F.count("*").alias("total"), F.count_if(done).alias("resolved"), safe_rate(F.count_if(done), F.count("*")).alias("rate"))
    rest = resolved.filter(~done).groupBy(name).agg(F.count("*").alias("mentions")).orderBy(F.desc("mentions"), F.asc_nulls_last(name)).limit(top)
    return summary, rest
