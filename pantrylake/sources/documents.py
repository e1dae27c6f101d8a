"""Records out of running text: scanned cookbooks, and descriptions of videos."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from pantrylake.functions.text import collapse, has_term, lines, sentences, upper_share

# Headings that begin and end parts of a video's description.
INGREDIENT_HEADS = ["Ingredients", "Ingredient"]
METHOD_HEADS = ["Method", "Process", "Directions", "Instructions", "Procedure", "Recipe"]
METHOD_ENDS = [r"#", "Follow ", r"Intro\s+\d", r"Outro\s+\d", "The Music I use", "Subscribe", "Download", "Website"]
# First words of lines that a scan adds.
SCAN_NOTES = ["digitized by", "google", "internet archive", "copyright"]
# Words of quantity without a digit.
QUANTITY_WORDS = ["cup", "tsp", "tbsp", "teaspoon", "tablespoon", "pinch", "gram", "grams", "kg", "ml", "litre", "to taste", "as required"]


def head(words: list[str]) -> str:
    """A pattern for lines that are one of the headings, whatever follows the word."""
    return r"(?i)^(?:" + "|".join(words) + r")(?:\b.*)?\s*:?\s*$"


def first_at(rows: Column, pattern: str) -> Column:
    """The place of the first line that matches, from 1; 0 if there is none."""
    return F.array_position(F.transform(rows, lambda x: x.rlike(pattern)), True)


def between(rows: Column, start: str, end: str | None) -> Column:
    """Lines after the first that matches start, up to the next that matches end."""
    at = first_at(rows, start)
    after = F.slice(rows, (at + 1).cast("int"), F.size(rows))
    return F.when(at > 0, before(after, end) if end else after).otherwise(F.array().cast("array<string>"))


def before(rows: Column, end: str) -> Column:
    """Lines up to the first that matches."""
    at = first_at(rows, end)
    return F.when(at > 0, F.slice(rows, F.lit(1), (at - 1).cast("int"))).otherwise(rows)


def after(rows: Column, start: str) -> Column:
    return between(rows, start, None)


def some_lines(rows: Column) -> Column:
    """Lines without marks of lists, those that say something."""
    return F.filter(F.transform(rows, lambda x: F.trim(F.regexp_replace(x, r"^[\s•*\-–]+", ""))), lambda x: x != "")


def ingredient_lines(rows: Column) -> Column:
    """Lines with a digit, a word of quantity, or a list mark at their beginning."""
    told = lambda x: x.rlike(r"\d|^\s*[•*|\-–]") | has_term(F.lower(x), QUANTITY_WORDS)
    return some_lines(F.filter(rows, told))


def video_record(description: Column, title: Column, transcript: Column) -> Column:
    """(title, ingredients, steps, transcript_used) of a description by its headings, null where either part is missing.

    Steps come from the transcript's sentences only where the description has ingredients but no method.
    """
    rows = lines(description)
    method = head(METHOD_HEADS)
    ingredients = ingredient_lines(between(rows, head(INGREDIENT_HEADS), method))
    steps = some_lines(before(after(rows, method), "(?i)^(?:" + "|".join(METHOD_ENDS) + ")"))
    said = F.coalesce(sentences(collapse(transcript)), F.array().cast("array<string>"))
    used = (F.size(ingredients) > 0) & (F.size(steps) == 0) & (F.size(said) > 0)
    steps = F.when(used, said).otherwise(steps)
    got = F.struct(collapse(title).alias("title"), ingredients.alias("ingredients"), steps.alias("steps"), used.alias("transcript_used"))
    return F.when((F.size(ingredients) > 0) & (F.size(steps) > 0), got)


def scan_lines(c: Column) -> Column:
    """Lines of scanned text: collapsed, without those that scanning added and those of a few marks."""
    kept = lambda x: (x != "") & ~F.lower(x).rlike("^(?:" + "|".join(SCAN_NOTES) + ")") & ~x.rlike(r"^[\W\d_]{1,8}$")
    return F.filter(F.transform(F.split(c, r"\r?\n"), collapse), kept)


def title_like(x: Column) -> Column:
    """Whether a line may be a heading: 4 to 70 characters, nine words at most, no digits, mostly capitals."""
    return F.length(x).between(4, 70) & (F.size(F.split(x, " ")) <= 9) & ~x.rlike(r"\d|[.!?,;]$") & (upper_share(x) > 0.45)


def blocks(rows: Column, longest: int = 90) -> Column:
    """(title, body) of each heading and the lines behind it, up to the next heading and so many lines."""
    places = F.filter(F.transform(rows, lambda x, i: F.when(title_like(x), i)), lambda i: i.isNotNull())
    ends = F.concat(F.slice(places, 2, F.greatest(F.size(places), F.lit(1))), F.array(F.size(rows)))
    cut = lambda a, b: F.slice(rows, a + 2, F.least(b - a - 1, F.lit(longest)))
    return F.zip_with(places, ends, lambda a, b: F.struct(F.get(rows, a).alias("title"), cut(a, b).alias("body")))


def block_record(title: Column, body: Column, place: Column, url: Column, source: Column, signals: list[str], verbs: list[str]) -> Column:
    """(title, source_url, ingredients, steps) of a block that is a recipe, else null: a signal, two verbs, three ingredients, two steps."""
    text = F.array_join(body, " ")
    low = F.lower(text)
    signal = F.lower(F.concat_ws(" ", title, text)).rlike("|".join(re.escape(s) for s in signals))
    heard = sum((F.when(low.contains(v), 1).otherwise(0) for v in verbs), F.lit(0))
    ingredients = F.array_distinct(ingredient_lines(F.filter(body, lambda x: F.length(x) <= 80)))
    steps = F.array_distinct(sentences(text))
    anchor = F.left(F.sha1(F.concat_ws("|", source, title, place.cast("string"))), F.lit(12))
    got = F.struct(title.alias("title"), F.concat(url, F.lit("#recipe="), anchor).alias("source_url"), F.slice(ingredients, 1, 24).alias("ingredients"), F.slice(steps, 1, 18).alias("steps"))
    return F.when(signal & (heard >= 2) & (F.size(ingredients) >= 3) & (F.size(steps) >= 2), got)
