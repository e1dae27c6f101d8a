"""Rules that classify records: places, diets, tags, difficulty, families, duplicates, quality reasons."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pantrylake.functions import fixed
from pantrylake.functions.text import collapse, has_term, tag


def region_of(state: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in fixed.REGIONS.items() for x in kv]), state)


def longest_word(text: Column, words: dict[str, list[str]]) -> Column:
    """(n, o, label, word) of the longest word in the text; the first listed among equals.

    One pattern finds, at every place where a word may begin, the longest one there; a literal map gives its label.
    """
    known: dict[str, tuple[int, str]] = {}
    for label, ws in words.items():
        for w in ws:
            known.setdefault(w, (-len(known), label))
    any_of = "|".join(re.escape(w) for w in sorted(known, key=lambda w: (-len(w), w)))
    hits = F.regexp_extract_all(text, F.lit(f"(?<![a-z0-9])(?=({any_of})(?![a-z0-9]))"), F.lit(1))
    order = F.create_map(*[F.lit(x) for w, (o, _) in known.items() for x in (w, o)])
    labels = F.create_map(*[F.lit(x) for w, (_, label) in known.items() for x in (w, label)])
    return F.array_max(F.transform(hits, lambda w: F.struct(F.length(w).alias("n"), F.try_element_at(order, w).alias("o"), F.try_element_at(labels, w).alias("label"), w.alias("word"))))


def first_word(text: Column, words: dict[str, list[str]]) -> Column:
    """(label, word) of the first listed word in the text."""
    listed = [(label, w) for label, ws in words.items() for w in ws]
    return F.coalesce(*[F.when(has_term(text, [w]), F.struct(F.lit(label).alias("label"), F.lit(w).alias("word"))) for label, w in listed])


def classify_place(df: DataFrame, text: Column, state: Column | None = None, region: Column | None = None) -> DataFrame:
    """Adds state, region, state_confidence, state_method and matched_terms.

    A given state, else the longest state word, else the first regional word, else nothing.
    """
    given = F.nullif(state, F.lit("")) if state is not None else F.lit(None).cast("string")
    low = collapse(F.lower(F.coalesce(text, F.lit(""))))
    df = df.withColumns({"_given": given, "_low": low})
    df = df.withColumns({"_s": longest_word(F.col("_low"), fixed.STATE_WORDS), "_r": first_word(F.col("_low"), fixed.REGION_WORDS)})
    g, s, r = F.col("_given"), F.col("_s"), F.col("_r")
    known = region if region is not None else F.lit(None).cast("string")
    out = {
        "state": F.coalesce(g, s["label"]),
        "region": F.when(g.isNotNull(), F.coalesce(known, region_of(g))).when(s.isNotNull(), region_of(s["label"])).otherwise(r["label"]),
        "state_confidence": F.when(g.isNotNull(), 1.0).when(s.isNotNull(), 0.95).when(r.isNotNull(), 0.45).otherwise(0.0),
        "state_method": F.when(g.isNotNull(), "provided_state").when(s.isNotNull(), "state_keyword").when(r.isNotNull(), "regional_keyword").otherwise("unclassified"),
        "matched_terms": F.array_compact(F.array(F.coalesce(g, s["word"], r["word"]))),
    }
    return df.withColumns(out).drop("_given", "_low", "_s", "_r")


def canonical_diet(c: Column) -> Column:
    n = F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    veg = n.rlike("veget[ae]rian")
    return (
        F.when(n.contains("non") & veg, "non_vegetarian").when(n.contains("egg"), "egg").when(n.contains("vegan"), "vegan").when(veg, "vegetarian")
        .when(n.contains("diabetic"), "diabetic_friendly").otherwise(F.nullif(F.replace(n, F.lit(" "), F.lit("_")), F.lit("")))
    )


def diet(existing: Column, text: Column) -> Column:
    inferred = (
        F.when(has_term(text, fixed.MEAT), "non_vegetarian").when(has_term(text, fixed.EGG), "egg")
        .when(text.contains("vegan") & ~has_term(text, [*fixed.DAIRY, *fixed.EGG, *fixed.MEAT]), "vegan").when(F.concat(text, F.lit(" ")).rlike("vegetarian|veg "), "vegetarian")
    )
    return F.when(F.nullif(existing, F.lit("")).isNotNull(), canonical_diet(existing)).otherwise(inferred)


def _with(existing: Column, *more: Column) -> Column:
    """existing tags and those of more that aren't null, each once, in order."""
    old = F.coalesce(existing, F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.concat(old, F.array_compact(F.array(*more))), lambda x: x != ""))


def diet_tags(existing: Column, diet_: Column, text: Column) -> Column:
    return _with(F.transform(existing, tag), tag(diet_), F.when(has_term(text, fixed.EGG), "EGG"), F.when(has_term(text, fixed.MEAT), "NON_VEGETARIAN"))


def allergen_tags(existing: Column, text: Column) -> Column:
    return _with(F.transform(existing, F.upper), *[F.when(has_term(text, terms), name) for name, terms in fixed.ALLERGENS.items()])


def health_tags(existing: Column, text: Column, diets: Column, allergens: Column) -> Column:
    free = ~F.array_contains(allergens, "GLUTEN") & has_term(text, fixed.GLUTEN_FREE)
    return _with(F.transform(existing, F.upper), F.when(has_term(text, fixed.PROTEIN_RICH), "HIGH_PROTEIN"), F.when(F.array_contains(diets, "VEGAN"), "VEGAN"), F.when(free, "GLUTEN_FREE"))


def difficulty(total: Column, steps: Column, ingredients: Column) -> Column:
    timed = F.when((total <= 30) & (steps <= 8), "EASY").when((total <= 90) & (ingredients <= 20), "MEDIUM").when(total <= 180, "HARD").otherwise("EXPERT")
    return F.when(total.isNotNull(), timed).when((steps <= 5) & (ingredients <= 8), "EASY").when(steps <= 12, "MEDIUM").otherwise("HARD")


def efficiency_tags(existing: Column, total: Column, steps: Column) -> Column:
    return _with(F.transform(existing, F.upper), F.when(total <= 30, "QUICK"), F.when(steps <= 6, "BEGINNER_FRIENDLY"), F.when(total >= 90, "MEAL_PREP"))


def dish_family(text: Column) -> Column:
    return F.coalesce(*[F.when(has_term(text, terms), name) for name, terms in fixed.DISH_FAMILIES.items()])


def dish_types(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(has_term(text, terms), name) for name, terms in fixed.DISH_TYPES.items()]))


def meal_role(existing: Column, text: Column, family: Column) -> Column:
    return F.coalesce(
        F.nullif(existing, F.lit("")),
        F.when(family.isin("chutney", "pickle", "raita"), "condiment").when(family.isin("sambar", "dal"), "dal_side").when(family.isin("biryani", "pulao", "khichdi", "dosa", "idli"), "complete_meal")
        .when(has_term(text, fixed.DESSERT), "dessert").when(has_term(text, fixed.SNACK), "snack_anchor").when(has_term(text, fixed.PROTEIN), "protein_side"),
    )


def cost_tier(existing: Column, text: Column) -> Column:
    return F.coalesce(F.nullif(existing, F.lit("")), F.when(has_term(text, fixed.PREMIUM), "PREMIUM").when(has_term(text, fixed.BUDGET), "BUDGET").otherwise("MID_RANGE"))


def enrich(df: DataFrame, text: Column, steps: Column, ingredients: Column, total: Column) -> DataFrame:
    """All rule columns in one projection; df may bring diet, diet_tags, allergen_tags, health_tags, efficiency_tags, meal_role and cost_tier."""
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    old = lambda c, other: F.col(c) if c in df.columns else other
    df = df.withColumn("_t", F.lower(F.coalesce(text, F.lit(""))))
    t = F.col("_t")
    df = df.withColumns({"diet": diet(old("diet", none), t), "dish_family": dish_family(t), "dish_types": dish_types(t), "allergen_tags": allergen_tags(old("allergen_tags", empty), t)})
    df = df.withColumn("diet_tags", diet_tags(old("diet_tags", empty), F.col("diet"), t))
    return df.withColumns(
        {
            "health_tags": health_tags(old("health_tags", empty), t, F.col("diet_tags"), F.col("allergen_tags")),
            "difficulty_level": difficulty(total, steps, ingredients),
            "efficiency_tags": efficiency_tags(old("efficiency_tags", empty), total, steps),
            "meal_role": meal_role(old("meal_role", none), t, F.col("dish_family")),
            "cost_tier": cost_tier(old("cost_tier", none), t),
        }
    ).drop("_t")


def title_words(c: Column) -> Column:
    """Distinct words of a title without the noise words, which go even inside others."""
    bare = F.regexp_replace(F.lower(c), "|".join(fixed.TITLE_NOISE), "")
    return F.array_distinct(F.filter(F.split(bare, r"\s+"), lambda x: x != ""))


def title_similarity(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.greatest(F.size(a), F.size(b)).cast("double")), F.lit(0.0))


def duplicate_class(similarity: Column) -> Column:
    return F.when(similarity >= 0.9, "duplicate").when(similarity >= 0.5, "variation").otherwise("new")


def similar_titles(titles: DataFrame, title: str = "title", least: float = 0.5) -> DataFrame:
    """a, b, similarity of distinct titles that share a word and reach `least`.

    Prefix filtering: a pair of that similarity shares one of the rarest words of each, so only those are joined on.
    """
    t = titles.select(F.col(title).alias("t")).filter("t IS NOT NULL").distinct().withColumn("w", title_words(F.col("t"))).filter(F.size("w") > 0)
    freq = t.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    ranked = t.select("t", F.explode("w").alias("word")).join(freq, "word").groupBy("t").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("x"))
    keep = F.size("x") - F.ceil(F.lit(least) * F.size("x")).cast("int") + 1
    keys = ranked.select("t", F.transform("x", lambda s: s["word"]).alias("w"), F.explode(F.slice("x", F.lit(1), keep)).alias("k")).select("t", "w", "k.word")
    a, b = keys.select(F.col("t").alias("a"), F.col("w").alias("wa"), "word"), keys.select(F.col("t").alias("b"), F.col("w").alias("wb"), "word")
    pairs = a.join(b, "word").filter("a < b").dropDuplicates(["a", "b"])
    return pairs.select("a", "b", title_similarity(F.col("wa"), F.col("wb")).alias("similarity")).filter(F.col("similarity") >= least)


def reasons(text: Column, title: Column, off_scope: list[str]) -> Column:
    """The first reason against a row, or null."""
    return (
        F.when(text.isNull() | (F.trim(text) == ""), "blank").when(text.rlike(r"[\x{0900}-\x{0D7F}]"), "indic_script").when(text.rlike("Ã|Â|â€"), "mojibake")
        .when(has_term(F.lower(title), off_scope), "off_scope_title").when(text.rlike(r"(?i)\b(?:reply|posted by|comments?)\b"), "comment_contamination")
    )
