"""Raw records to the canonical schema by a mapping, with what can't be coerced set aside."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pantrylake.functions.text import as_list, clean_text, no_blanks

TEXTS = "title description cuisine state region language diet course source_url image_url servings prep_time cook_time total_time".split()
LISTS = "ingredients steps tags images".split()


@dataclass(frozen=True)
class Mapping:
    """Source keys to try for each canonical field, in order, and defaults."""

    source_id: str
    source_type: str = ""
    keys: dict[str, list[str]] = field(default_factory=dict)
    defaults: dict[str, str] = field(default_factory=dict)


def choose(mappings: list[Mapping], source_id: str, source_type: str) -> Mapping:
    """By id, else the first of the type, else an error."""
    for m in mappings:
        if m.source_id == source_id:
            return m
    for m in mappings:
        if m.source_type == source_type:
            return m
    raise KeyError(f"no mapping for {source_id!r} of type {source_type!r}")


def value_of(content: Column, names: list[str], default: str | None) -> Column:
    """The first key that is there and isn't ""; one that is null ends the search with null."""
    out = F.lit(default).cast("string")
    for name in reversed(names):
        v = F.variant_get(content, f"$['{name}']", "variant")
        text = F.variant_get(content, f"$['{name}']", "string")
        out = F.when(v.isNotNull() & (F.is_variant_null(v) | (text != "")), text).otherwise(out)
    return out


def coerce(raw: DataFrame, mapping: Mapping) -> DataFrame:
    """record_id, the canonical fields, unmapped (the content as it was), and error (null if accepted)."""
    content = F.col("raw_content")
    cols = {c: value_of(content, [*mapping.keys.get(c, []), c], mapping.defaults.get(c)) for c in [*TEXTS, *LISTS]}
    df = raw.select("record_id", "source_id", "source_type", *[v.alias(c) for c, v in cols.items()], content.alias("unmapped"), "metadata")
    df = df.withColumns({c: clean_text(F.col(c)) for c in TEXTS})
    df = df.withColumns({c: as_list(F.col(c)) for c in ("ingredients", "tags", "images")} | {"steps": steps_list(F.col("steps"))})
    error = F.when(F.coalesce(F.trim("title"), F.lit("")) == "", "missing_title").when(F.size("ingredients") == 0, "missing_ingredients").when(F.size("steps") == 0, "missing_steps")
    return df.withColumn("error", error)


def steps_list(c: Column) -> Column:
    """As as_list, but commas never divide steps."""
    parsed = F.from_json(c, "array<string>")
    split = F.split(c, r"[|\n]")
    return F.coalesce(no_blanks(F.when(F.ltrim(c).startswith("["), F.coalesce(parsed, split)).otherwise(split)), F.array().cast("array<string>"))


def accepted_and_dead(coerced: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted records, and dead letters with their payload and a hash that makes saving them idempotent."""
    ok = coerced.filter("error IS NULL").drop("error")
    payload = F.to_json("unmapped")
    dead = coerced.filter("error IS NOT NULL").select("record_id", "source_id", "error", payload.alias("payload"), F.sha2(F.concat_ws("\x01", "source_id", "error", payload), 256).alias("dead_letter_hash"))
    return ok, dead


def canonical_json(df: DataFrame, cols: list[str]) -> Column:
    """Compact JSON with sorted keys and nulls kept."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(cols)]), {"ignoreNullFields": "false"})


def schema_errors(df: DataFrame, required: list[str], types: dict[str, str]) -> Column:
    """What a shallow schema check finds: missing means null or "", an empty list passes; types are those of the columns."""
    kinds = dict(df.dtypes)
    bad = [F.when(F.col(c).isNull() | (F.col(c).cast("string") == "") if kinds.get(c) == "string" else F.col(c).isNull(), F.lit(f"{c}: required")) for c in required if c in kinds]
    bad += [F.lit(f"{c}: required") for c in required if c not in kinds]
    bad += [F.lit(f"{c}: expected {t}") for c, t in types.items() if c in kinds and not kinds[c].startswith(t)]
    return F.array_compact(F.array(*bad)) if bad else F.array().cast("array<string>")


def skip_reason() -> Column:
    """The first thing a scraped record lacks, or null."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    return (
        F.when(blank("name"), "missing_name").when(F.coalesce("servings", F.lit(0)) <= 0, "missing_source_servings").when(F.size("ingredients") < 1, "missing_ingredients")
        .when(F.size("steps") < 1, "missing_cook_steps").when(blank("source_url"), "missing_source_url")
    )
