"""Eleven ordered data-quality checks on a record, and the verdict that sends it on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pantrylake.functions.fixed import NUT_NAMES
from pantrylake.functions.text import hash_form, untranslated
from pantrylake.operators.units import is_liquid, name_key


@dataclass(frozen=True)
class Check:
    id: str
    name: str
    severity: str
    action: str
    passed: Column


def _none(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0))


def checks(enabled: set[str] | None = None) -> list[Check]:
    """The checks over columns title, ingredients, steps, allergen_tags, health_tags, kcal, language, images, duplicate_score,
    canonical_id and known (whether the record's hashes were seen before)."""
    items, steps = F.col("ingredients"), F.col("steps")
    quantity = lambda i: F.coalesce(i["canonical_quantity"], i["quantity"])
    scores = F.flatten(F.transform(items, lambda i: F.array_compact(F.array(i["resolution_confidence"], i["uom_confidence"]))))
    mean = F.try_divide(F.aggregate(scores, F.lit(0.0), lambda a, x: a + x), F.size(scores).cast("double"))
    seen = F.flatten(F.transform(items, lambda i: F.coalesce(i["allergen_flags"], F.array().cast("array<string>"))))
    nut_free = F.array_contains(F.transform(F.coalesce("health_tags", F.array().cast("array<string>")), lambda t: F.replace(F.lower(t), F.lit("_"), F.lit("-"))), "nut-free")
    canonical = lambda i: F.coalesce(F.nullif(i["canonical"], F.lit("")), i["name"])
    nuts = F.exists(items, lambda i: F.coalesce(F.lower(i["name"]).isin(NUT_NAMES), F.lit(False)) | F.coalesce(F.lower(i["canonical"]).isin(NUT_NAMES), F.lit(False)))
    conflict = lambda i: (
        ((i["canonical_unit"] == "ml") & ~is_liquid(name_key(canonical(i))) & ~F.coalesce(i["conversion_method"], F.lit("")).isin("density_lookup", "estimated_density_lookup")) | F.array_contains(i["flags"], "uom_conflict")
    )
    unresolved = F.exists(items, lambda i: F.coalesce(F.array_contains(i["flags"], "unresolved_ingredient"), F.lit(False)))
    english = F.lower(F.coalesce(F.nullif(F.col("language"), F.lit("")), F.lit("english"))).isin("english", "en")
    rows = [
        Check("V01", "schema_completeness", "CRITICAL", "REJECT", (F.length(F.trim("title")) > 2) & (F.size(items) >= 1) & (F.size(steps) >= 1)),
        Check("V02", "ingredient_count", "CRITICAL", "REJECT", F.size(items).between(2, 100)),
        Check("V03", "steps", "CRITICAL", "REJECT", (F.size(steps) >= 1) & F.forall(steps, lambda s: F.trim(s) != "")),
        Check("V04", "quantity_sanity", "HIGH", "REVIEW", ~F.exists(items, lambda i: F.coalesce((quantity(i) <= 0) | (quantity(i) >= 10000), F.lit(False)))),
        Check("V05", "allergen_consistency", "HIGH", "REVIEW", (F.size(F.array_except(F.coalesce("allergen_tags", F.array().cast("array<string>")), seen)) == 0) & ~(nut_free & nuts)),
        Check("V06", "uom_conflict", "HIGH", "REVIEW", ~F.exists(items, lambda i: F.coalesce(conflict(i), F.lit(False)))),
        Check("V07", "nutrition", "MEDIUM", "FLAG", F.col("kcal").between(50, 2500) | F.col("kcal").isNull()),
        Check("V08", "enrichment_score", "MEDIUM", "FLAG", (mean >= 0.7) & F.forall(scores, lambda x: x >= 0.7) & ~unresolved),
        Check("V09", "duplicate_guard", "CRITICAL", "REJECT", F.col("canonical_id").isNull() & (_none("duplicate_score") < 0.95) & ~F.coalesce("known", F.lit(False))),
        Check("V10", "language", "MEDIUM", "FLAG", english & ~untranslated(F.concat_ws(" ", "title", F.array_join("steps", " ")))),
        Check("V11", "image", "LOW", "WARN", F.size(F.coalesce("images", F.array().cast("array<string>"))) >= 1),
    ]
    return [c for c in rows if enabled is None or c.id in enabled]


def verdict(failed: Column) -> Column:
    """From severities of failed checks: any critical rejects; any high, or three medium ones, ask for review."""
    medium = F.size(F.filter(failed, lambda s: s == "MEDIUM"))
    return F.when(F.array_contains(failed, "CRITICAL"), "REJECTED").when(F.array_contains(failed, "HIGH") | (medium > 2), "REVIEW").otherwise("ACCEPTED")


def judge(df: DataFrame, rules: list[Check]) -> DataFrame:
    """df with results, failure_codes, flags and status, all checks in one projection; a check that is null has failed."""
    result = [
        F.struct(F.lit(c.id).alias("check_id"), F.lit(c.name).alias("check_name"), F.coalesce(c.passed, F.lit(False)).alias("passed"), F.lit(c.severity).alias("severity"), F.lit(c.action).alias("action"))
        for c in rules
    ]
    df = df.withColumn("results", F.array(*result))
    failed = F.filter("results", lambda r: ~r["passed"])
    return df.withColumns(
        {
            "failure_codes": F.transform(failed, lambda r: r["check_id"]),
            "flags": F.transform(F.filter(failed, lambda r: r["severity"].isin("MEDIUM", "LOW")), lambda r: r["check_name"]),
            "status": verdict(F.transform(failed, lambda r: r["severity"])),
        }
    )


def split(judged: DataFrame) -> dict[str, DataFrame]:
    """The outputs by verdict; persist the input before writing more than one."""
    return {s: judged.filter(F.col("status") == s) for s in ("ACCEPTED", "REVIEW", "REJECTED")}


def fingerprints(df: DataFrame, title: str = "title", url: str = "source_url") -> DataFrame:
    """Adds content_hash (title, url, ingredients, steps) and source_url_hash (null without a url)."""
    mark, sep = "\x01", "\x02"
    item = lambda i: F.concat_ws(sep, hash_form(i["name"]), F.coalesce(i["quantity"].cast("string"), F.lit("")), F.coalesce(hash_form(i["unit"]), F.lit("")))
    body = F.concat_ws(
        mark, F.coalesce(hash_form(F.col(title)), F.lit("")), F.coalesce(hash_form(F.col(url)), F.lit("")), F.array_join(F.transform("ingredients", item), "\x03"), F.array_join(F.transform("steps", hash_form), "\x03")
    )
    return df.withColumns({"content_hash": F.sha2(body, 256), "source_url_hash": F.when(F.trim(F.col(url)) != "", F.sha2(hash_form(F.col(url)), 256))})


def kpis(judged: DataFrame) -> DataFrame:
    """Totals, the rate accepted, and whether both goals hold: at least 85 % accepted, no accepted record with a critical failure."""
    from pantrylake.operators.metrics import safe_rate

    ok = F.col("status") == "ACCEPTED"
    critical = F.exists("results", lambda r: ~r["passed"] & (r["severity"] == "CRITICAL"))
    rows = judged.agg(
        F.count("*").alias("total"), F.count_if(ok).alias("accepted"), F.count_if(F.col("status") == "REVIEW").alias("review"), F.count_if(F.col("status") == "REJECTED").alias("rejected"),
        safe_rate(F.count_if(ok), F.count("*")).alias("acceptance_rate"), F.count_if(ok & critical).alias("accepted_critical"),
    )
    return rows.withColumn("goals_met", (F.col("acceptance_rate") >= 0.85) & (F.col("accepted_critical") == 0))


def failure_counts(judged: DataFrame) -> DataFrame:
    return judged.select(F.explode("failure_codes").alias("check_id")).groupBy("check_id").agg(F.count("*").alias("n"))
