"""String functions: built-in expressions where they can say it, Arrow-batched functions where not."""

from __future__ import annotations

import html
import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDE_SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}\x{001C}-\x{001F}]+"
MOJIBAKE = "ÃÂâ�"
_SPACES = re.compile(r"\s+")


def _oddness(s: str) -> int:
    return sum(map(s.count, MOJIBAKE))


def mended(s: str) -> str:
    """s as UTF-8 where it was read as cp1252, unless that makes it odder."""
    if _oddness(s) == 0:
        return s
    try:
        other = s.encode("cp1252").decode()
    except UnicodeError:
        return s
    return min(other, s, key=_oddness)


def cleaned(s: str | None) -> str | None:
    """Entities resolved, mojibake mended, white space collapsed."""
    if s is None:
        return None
    s = html.unescape(mended(html.unescape(html.unescape(s))))
    return _SPACES.sub(" ", s.replace(" ", " ")).strip()


@F.pandas_udf(T.StringType())
def _clean(v: pd.Series) -> pd.Series:
    return v.map(cleaned, na_action="ignore")


@F.pandas_udf(T.StringType())
def _nfkc(v: pd.Series) -> pd.Series:
    return v.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")


def clean_text(c: Column | str) -> Column:
    """As `cleaned`; texts of plain characters without entities stay with built-in functions."""
    c = F.col(c) if isinstance(c, str) else c
    plain = c.rlike(r"^[\x{0020}-\x{0025}\x{0027}-\x{007E}\t\n\r]*$")
    return F.when(plain, collapse(c)).otherwise(_clean(F.when(~plain, c)))


def collapse(c: Column) -> Column:
    """White space of all sorts to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(c, WIDE_SPACE, " "))


def hash_form(c: Column) -> Column:
    return collapse(F.lower(c))


def normal_name(c: Column) -> Column:
    """A name to look up by: compatibility forms resolved, lower case, separators as spaces."""
    ascii_ = c.rlike(r"^[\x00-\x7F]*$")
    c = F.when(ascii_, c).otherwise(_nfkc(F.when(~ascii_, c)))
    return collapse(F.regexp_replace(F.lower(c), r"[_\-/,.;:()]+", " "))


def tag(c: Column) -> Column:
    """UPPER_CASE_TAG."""
    return F.trim(F.regexp_replace(F.upper(c), "[^A-Z0-9]+", "_"), F.lit("_"))


def has_term(c: Column, terms: list[str]) -> Column:
    """Whether one of the terms stands between characters that aren't letters or digits; one pattern for all."""
    longest_first = sorted(terms, key=lambda t: (-len(t), t))
    return c.rlike("(?<![a-z0-9])(?:" + "|".join(re.escape(t) for t in longest_first) + ")(?![a-z0-9])")


def replaced(c: Column, table: dict[str, str]) -> Column:
    """Every key replaced by its value, in order."""
    return reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), table.items(), c)


def no_blanks(a: Column) -> Column:
    return F.filter(F.transform(a, lambda x: F.trim(x)), lambda x: x != "")


def as_list(c: Column) -> Column:
    """A JSON array, or parts between | or line ends, or between commas only if neither occurs."""
    parsed = F.from_json(c, "array<string>")
    split = F.when(c.rlike(r"[|\n]"), F.split(c, r"[|\n]")).otherwise(F.split(c, ","))
    return F.coalesce(no_blanks(F.when(F.ltrim(c).startswith("["), F.coalesce(parsed, split)).otherwise(split)), F.array().cast("array<string>"))


def distinct_tags(a: Column, upper: bool = True) -> Column:
    """Trimmed, cased, without blanks and repeats, in order."""
    case = F.upper if upper else F.lower
    return F.array_distinct(F.filter(F.transform(a, lambda x: case(F.trim(x))), lambda x: x != ""))


def lines(c: Column) -> Column:
    return F.transform(F.split(c, r"\r?\n"), lambda x: F.trim(x))


def first_line(c: Column) -> Column:
    """The first line that isn't blank."""
    return F.get(F.filter(lines(c), lambda x: x != ""), F.lit(0))


def section(c: Column, begins: list[str], ends: list[str]) -> Column:
    """Lines that aren't blank between the first line that is one of begins and the next that is one of ends."""
    rows = lines(c)
    low = F.transform(rows, F.lower)
    marks = F.transform(low, lambda x: x.isin(begins))
    start = F.array_position(marks, True)
    after = F.slice(rows, start + 1, F.size(rows))
    stop = F.array_position(F.transform(after, lambda x: F.lower(x).isin(ends)), True)
    inner = F.when(stop > 0, F.slice(after, F.lit(1), (stop - 1).cast("int"))).otherwise(after)
    return F.when(start > 0, F.filter(inner, lambda x: x != "")).otherwise(F.array().cast("array<string>"))


def sentences(c: Column, least: int = 12) -> Column:
    """Parts that end a sentence before a capital, of at least so many characters."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+(?=[A-Z])"), lambda x: F.trim(x)), lambda x: F.length(x) >= least)


def merged_fragments(a: Column, least: int = 8) -> Column:
    """Parts shorter than least appended to the part before."""
    return F.aggregate(
        a,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(
            (F.length(x) < least) & (F.size(acc) > 0), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), F.lit(" "), x)))
        ).otherwise(F.concat(acc, F.array(x))),
    )


def item_and_prep(c: Column) -> Column:
    """A line as (item, prep), cut at the first " - "."""
    at = F.locate(" - ", c)
    return F.struct(F.trim(F.when(at > 0, F.left(c, at - 1)).otherwise(c)).alias("item"), F.when(at > 0, F.trim(F.substr(c, at + 3))).alias("prep"))


def number_text(c: Column) -> Column:
    """A quantity without a fraction of zero: 200.0 is 200, 1.50 is 1.5."""
    return F.regexp_replace(F.regexp_replace(c.cast("decimal(18,4)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def display(quantity: Column, unit: Column, name: Column) -> Column:
    return F.concat_ws(" ", number_text(quantity), unit, name)


def minutes(c: Column) -> Column:
    """Minutes of a whole ISO 8601 duration (days don't count), else of hours and minutes in words, else of a bare number; null
    where nothing or a duration of zero is said."""
    c = F.trim(c)
    iso = r"(?i)^P(?:\d+D)?T?(?:(\d+)H)?(?:(\d+)M)?$"

    def part(pattern: str, i: int, factor: int) -> Column:
        return F.coalesce(F.regexp_extract(c, pattern, i).try_cast("int"), F.lit(0)) * factor

    words = F.nullif(part(r"(?i)(\d+)\s*(?:hours?|hrs?)\b", 1, 60) + part(r"(?i)(\d+)\s*(?:minutes?|mins?)\b", 1, 1), F.lit(0))
    return F.when(c.rlike(iso), F.nullif(part(iso, 1, 60) + part(iso, 2, 1), F.lit(0))).otherwise(F.coalesce(words, F.when(c.rlike(r"^\d+$"), c.try_cast("int"))))


def first_number(c: Column) -> Column:
    return F.regexp_extract(c, r"(\d+)", 1).try_cast("int")


def untranslated(c: Column) -> Column:
    """Whether the text holds Indic script."""
    return c.rlike(r"[\x{0900}-\x{097F}\x{0980}-\x{0D7F}]")


def upper_share(c: Column) -> Column:
    return F.coalesce(F.try_divide(F.length(F.regexp_replace(c, "[^A-Z]", "")), F.length(F.regexp_replace(c, "[^A-Za-z]", ""))), F.lit(0.0))


def like_title(c: Column, food: list[str], deny: list[str]) -> Column:
    """Whether a line may be a title: 4 to 70 characters, nine words at most, no digits, capitals, and a hint of food."""
    cased = (upper_share(c) > 0.45) | c.rlike(r"^(?:[A-Z][\w'’-]*\s*(?:(?:and|of|with|in|the|a)\s+)*)+$")
    return F.length(c).between(4, 70) & (F.size(F.split(F.trim(c), r"\s+")) <= 9) & ~c.rlike(r"\d") & cased & has_term(F.lower(c), food) & ~has_term(F.lower(c), deny)
