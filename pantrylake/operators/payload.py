"""Records of several sources as catalogue payloads, ingredients read again, and the reviewers' form of a record."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pantrylake.functions import fixed
from pantrylake.functions import quantity as Q
from pantrylake.functions.nested import as_object, scrape_hash
from pantrylake.functions.text import clean_text, collapse, display, no_blanks, replaced
from pantrylake.operators import units as U



def no_strings() -> Column:
    return F.array().cast("array<string>")


def split_pipe(c: Column) -> Column:
    return F.coalesce(no_blanks(F.split(c, r"\|")), no_strings())


def to_int(c: Column, default: int | None = None) -> Column:
    """The whole part of a number; the default where there is none."""
    return F.coalesce(F.trim(c).try_cast("double").cast("int"), F.lit(default).cast("int"))


def language_code(c: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(low.isin("english", "en", ""), "en").otherwise(low)


def diet_tags(diet: Column) -> Column:
    """VEGETARIAN and VEGAN, by what the diet's name holds."""
    return F.array_compact(F.array(*[F.when(F.coalesce(diet.contains(w), F.lit(False)), w.upper()) for w in ("vegetarian", "vegan")]))


def meal_types(course: Column) -> Column:
    text = F.lower(F.array_join(course, " "))
    return F.array_compact(F.array(*[F.when(F.coalesce(text.contains(w), F.lit(False)), w) for w in ("breakfast", "lunch", "dinner", "snack")]))


def comma_parts(c: Column) -> Column:
    """Parts between commas joined by " | "."""
    return F.array_join(no_blanks(F.split(collapse(c), ",")), " | ")


def numbered(steps: Column) -> Column:
    return F.transform(steps, lambda s, i: F.struct((i + 1).alias("step_number"), s.alias("instruction")))


def normalise_dataset(rows: DataFrame, names: dict[str, list[str]], keep: Column | None = None) -> DataFrame:
    """A wide table of strings in the canonical columns: for each, the first of the named ones that says something.

    Ingredients are split at commas, steps into sentences; rows without title, ingredients, steps or url go, and those
    that `keep` (over the canonical columns) doesn't take.
    """

    def first(options: list[str]) -> Column:
        there = [F.nullif(collapse(F.col(f"`{n}`")), F.lit("")) for n in options if n in rows.columns]
        return F.coalesce(*there, F.lit("")) if there else F.lit("")

    out = rows.select(*[first(v).alias(k) for k, v in names.items()])
    steps = no_blanks(F.split(F.regexp_replace(F.col("instructions"), r"([.!?])\s+(?=[A-Z])", "$1\u0001"), "\u0001"))
    out = out.withColumns({"ingredients": comma_parts(F.col("ingredients")), "instructions": F.array_join(steps, " | "), "language": F.lit("english")})
    out = out.withColumn("description", F.array_join(F.filter(F.array("cuisine", "course", "diet"), lambda x: x != ""), " | "))
    out = out.filter("title <> '' AND ingredients <> '' AND instructions <> '' AND source_url <> ''")
    return out if keep is None else out.filter(keep)


def english_row(cuisine: list[str]) -> Column:
    """Texts without Indic script, damaged letters, or a mark of another language in title and url, of one of these cuisines."""
    blob = F.concat_ws(" ", "title", "ingredients", "instructions", "source_url")
    marked = F.concat_ws(" ", "title", "source_url").rlike(r"(?i)\b(?:hindi|in-hindi)\b")
    return ~marked & ~blob.rlike(r"[\x{0900}-\x{0D7F}]|à¤|à¥") & F.lower("cuisine").rlike("|".join(re.escape(c) for c in cuisine))


#: Fields of a payload that no source fills: lists, and others.
EMPTY_LISTS = ["allergen_tags", "dish_types", "texture", "health_tags", "efficiency_tags", "experience_tags", "festival_tags"]
EMPTY_TEXTS = ["difficulty_level", "youtube_url", "region", "spice_level", "complexity", "budget_band", "side_category", "meal_role", "dish_family", "cost_tier", "owner_code", "owner_name"]


def _payload(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    rest = {c: no_strings() for c in EMPTY_LISTS} | {c: F.lit(None).cast("string") for c in EMPTY_TEXTS}
    rest |= {"popularity_score": F.lit(0), "is_public": F.lit(False), "is_active": F.lit(True), "passive_time_min": F.lit(None).cast("int"), "estimated_cost_per_serving": F.lit(None).cast("double")}
    return df.select(*[v.alias(k) for k, v in (rest | cols).items()])


def dataset_payload(rows: DataFrame, path: str = "") -> DataFrame:
    """Canonical dataset rows (strings; lists between pipes) as payloads."""
    c = lambda n: collapse(F.coalesce(F.col(n), F.lit(""))) if n in rows.columns else F.lit("")
    some = lambda x: F.nullif(x, F.lit(""))
    course, steps = split_pipe(c("course")), split_pipe(c("instructions"))
    diet = some(F.lower(c("diet")))
    source = F.coalesce(some(c("dataset_source")), F.lit("normalized_dataset"))
    return _payload(rows, {
        "name": c("title"), "description": F.coalesce(some(c("description")), some(c("cuisine"))), "servings": to_int(c("servings"), 1), "image_url": some(c("image_url")),
        "course": F.transform(course, F.lower), "diet": diet, "diet_tags": diet_tags(diet), "cuisines": F.filter(F.array(c("cuisine")), lambda x: x != ""), "meal_types": meal_types(course),
        "prep_time_min": to_int(c("prep_time_min")), "cook_time_min": to_int(c("cook_time_min")), "total_time_min": to_int(c("total_time_min")),
        "ingredients_json": F.transform(split_pipe(c("ingredients")), lambda x: F.struct(x.alias("raw_text"), x.alias("name"), F.lit("dataset").alias("source"))),
        "cook_steps": numbered(steps), "quick_steps": F.slice(steps, 1, 5), "source": source, "language": language_code(c("language")), "created_by": F.lit("system_seed"),
        "metadata": F.struct(c("source_url").alias("source_url"), source.alias("dataset_source"), c("external_dataset_row").alias("external_dataset_row"), F.lit(path).alias("input_path")),
    })


def scrape_payload(rows: DataFrame, source_id: str, location: str) -> DataFrame:
    """Scraped records (title, source_url, ingredients, steps, servings, nutrition_info and others) as payloads."""
    c = lambda n, kind="string": F.col(n) if n in rows.columns else F.lit(None).cast(kind)
    some = lambda x: F.nullif(collapse(x), F.lit(""))
    lists = lambda n: F.coalesce(no_blanks(c(n, "array<string>")), no_strings())
    servings, steps = to_int(c("servings").cast("string")), lists("steps")
    title, url = F.coalesce(collapse(c("title")), F.lit("")), F.coalesce(collapse(c("source_url")), F.lit(""))
    return _payload(rows, {
        "name": title, "description": some(c("description")), "nutrition_info": as_object(c("nutrition_info").cast("string")), "tags": lists("tags"), "servings": servings, "image_url": some(c("image")),
        "course": F.transform(lists("course"), F.lower), "cuisines": lists("cuisines"), "meal_types": meal_types(lists("course")), "diet": F.lit(None).cast("string"), "diet_tags": no_strings(),
        "prep_time_min": to_int(c("prep_time_min").cast("string")), "cook_time_min": to_int(c("cook_time_min").cast("string")), "total_time_min": to_int(c("total_time_min").cast("string")),
        "ingredients_json": F.transform(lists("ingredients"), lambda x, i: F.struct(x.alias("raw_text"), (i + 1).alias("source_position"))),
        "cook_steps": numbered(steps), "quick_steps": F.slice(steps, 1, 5), "source": F.lit(source_id), "language": F.lit("en"), "created_by": F.lit("web_scraper"),
        "metadata": F.struct(
            url.alias("source_url"), scrape_hash(title, url, lists("ingredients"), steps).alias("content_hash"), F.lit(location).alias("scrape_source"), F.lit(source_id).alias("source_id"),
            F.when(servings > 0, "source_recipe_yield").alias("servings_source"),
        ),
    })


def sidecar_payload(rows: DataFrame, source_type: str, path: str = "") -> DataFrame:
    """Records read from text beside other files (title, ingredients, steps, source_url) as payloads, marked by their source's type."""
    flat = rows.withColumns({"ingredients": F.array_join("ingredients", " | "), "instructions": F.array_join("steps", " | "), "dataset_source": F.lit(source_type)})
    return dataset_payload(flat, path)


def repaired(c: Column) -> Column:
    """Known damaged spellings replaced, white space collapsed."""
    return collapse(replaced(c, fixed.DAMAGED))


# ---- ingredients read again

MEASURED = re.compile(r"\s*\d[\d./-]*\s*")
SOLID = {u for u in fixed.LINE_UNITS if " " not in u}


def begins_measured(name: str) -> bool:
    """Whether a name begins with a number that no other word is glued to."""
    m = MEASURED.match(name)
    glued = re.match(r"[A-Za-z_]+", name[m.end() :]) if m and not m[0][-1].isspace() else None
    return bool(m) and (glued is None or glued[0].lower() in SOLID)


def item_prep(text: str) -> tuple[str, str | None]:
    item, dash, prep = text.partition(" - ")
    return " ".join(item.split()), (" ".join(prep.split()) or None) if dash else None


def read_again(raw: str | None, name: str | None, quantity: str | None, unit: str | None) -> tuple:
    """(raw_text, name, prep, quantity, unit): the line parsed once more, a metric measure inside a household one preferred, and
    given values kept unless they are no proper name."""
    raw = " ".join((raw or name or "").split())
    q, u, parsed = Q.line(raw)
    if (u or "").lower() in fixed.HOUSEHOLD:
        q2, u2, inner = Q.line(parsed)
        if q2 is not None and (u2 or "").lower() in fixed.METRIC and inner and inner != parsed:
            q, u, parsed, quantity, unit = q2, u2, inner, None, u2
    for _ in range(3):
        more, _, shorter = Q.line(parsed)
        if more is None or not shorter or shorter == parsed:
            break
        parsed = shorter
    parsed, prep = item_prep(parsed)
    own = " ".join((name or parsed).split())
    low = own.lower()
    if parsed and (not own or begins_measured(own) or (u and (low == u or low.startswith(u + " ") or (own == raw and parsed != raw)))):
        own = parsed
    own, other = item_prep(own)
    given = Q.amount(quantity) if quantity is not None else None
    return raw, own, prep or other, given if given is not None else q, unit if unit is not None else u


AGAIN = T.StructType([T.StructField(n, T.DoubleType() if n == "quantity" else T.StringType()) for n in ("raw_text", "name", "prep", "quantity", "unit")])


@F.pandas_udf(AGAIN)
def _again(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for cols in batches:
        rows = list(zip(*[[None if pd.isna(x) else x for x in c] for c in cols], strict=True))
        known = {r: read_again(*r) for r in set(rows)}
        yield pd.DataFrame([known[r] for r in rows], columns=AGAIN.names)


def reread_ingredients(items: DataFrame) -> DataFrame:
    """items(raw_text, name, quantity string, unit, and others) with these read again and canonical quantities, flags and a text."""
    rest = [c for c in items.columns if c not in AGAIN.names]
    df = items.withColumn("_a", _again(repaired(F.col("raw_text")), repaired(F.col("name")), F.col("quantity").cast("string"), F.col("unit"))).select(*rest, "_a.*")
    df = U.normalise(df).withColumnsRenamed({"method": "conversion_method", "uom_confidence": "uom_confidence_score", "uom_flags": "normalization_flags"})
    text = F.when(F.col("canonical_quantity").isNotNull(), display(F.col("canonical_quantity"), F.col("canonical_unit"), F.col("name"))).otherwise(display(F.col("quantity"), F.col("unit"), F.col("name")))
    return df.withColumns({"normalized_text": text, "quantity": F.round("quantity", 2)})


def total_time(total: Column, prep: Column, cook: Column) -> Column:
    """The total given, else the sum of both parts."""
    return F.coalesce(total, prep + cook)


def rule_text(*parts: Column) -> Column:
    """What the rules look at: texts and lists, in order, in lower case."""
    return F.lower(F.concat_ws(" ", *parts))


# ---- the reviewers' form

COUNTED = r"(?i)^\s*(?:\d+(?:-\d+/\d+)?(?:\.\d+)?|\d+/\d+)\s*(?:(?:" + "|".join(sorted(SOLID, key=lambda u: (-len(u), u))) + r")\b)?\s*"


def reviewer_items(items: Column) -> Column:
    """Ingredients of a record as (item, quantity, unit, normalized_quantity, normalized_unit, normalized_text, prep), by their place.

    items: structs of raw_text, name, item, quantity, unit, canonical_quantity, canonical_unit, normalized_text, prep, source_position.
    """
    some = lambda c: F.nullif(F.trim(c), F.lit(""))

    def one(i: Column) -> Column:
        base = F.coalesce(i["name"], i["item"], i["raw_text"])
        prep = F.coalesce(some(i["prep"]), some(F.regexp_extract(base, r"\s+-\s+(.*)$", 1)))
        item = some(F.regexp_replace(F.regexp_replace(base, COUNTED, ""), r"\s+-\s+.*$", ""))
        return F.struct(
            item.alias("item"), i["quantity"].alias("quantity"), F.nullif(i["unit"], F.lit("")).alias("unit"), i["canonical_quantity"].alias("normalized_quantity"),
            F.nullif(i["canonical_unit"], F.lit("")).alias("normalized_unit"), F.nullif(i["normalized_text"], F.lit("")).alias("normalized_text"), prep.alias("prep"),
        )

    place = lambda i: F.coalesce(i["source_position"], F.lit(999999))
    ordered = F.array_sort(items, lambda x, y: F.when(place(x) < place(y), -1).when(place(x) > place(y), 1).otherwise(0))
    return F.coalesce(F.transform(ordered, one), F.array())


def all_upper(c: Column) -> Column:
    """Whether every tag that says something is in upper case; true of none."""
    return F.coalesce(F.forall(F.filter(c, lambda x: x.isNotNull() & (x != "")), lambda x: x == F.upper(x)), F.lit(True))


def cleaned_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """Texts cleaned, with `changed`: whether any of them was."""
    out = df.select("*", *[clean_text(c).alias(f"_{c}") for c in cols])
    changed = F.lit(False)
    for c in cols:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    return out.withColumn("changed", changed).withColumns({c: F.col(f"_{c}") for c in cols}).drop(*[f"_{c}" for c in cols])
