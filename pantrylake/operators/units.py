"""Units of measure: one broadcast join with a fixed table of units, one with a fixed table of densities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pantrylake.functions import fixed
from pantrylake.functions.quantity import simple_amount


def unit_table(spark: SparkSession) -> DataFrame:
    """unit, kind, unit_out, factor, unit_confidence; its size is fixed."""
    rows = [(u, "unquantified", None, None, 0.5) for u in fixed.UNQUANTIFIED]
    rows += [(u, "weight", "g", float(f), 1.0) for u, f in fixed.GRAMS.items()]
    rows += [(u, "colloquial", "g", float(f), c) for u, (f, c) in fixed.COLLOQUIAL.items()]
    rows += [(u, "count", "count", 1.0, 1.0) for u in fixed.COUNT_UNITS]
    rows += [(u, "volume", "ml", float(f), 1.0) for u, f in fixed.MILLILITRES.items()]
    return spark.createDataFrame(rows, "unit_key string, kind string, unit_out string, factor double, unit_confidence double")


def unit_key(c: Column) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(F.replace(F.replace(F.lower(F.trim(c)), F.lit("."), F.lit("")), F.lit("-"), F.lit(" ")), r"\s+", " ")), F.lit(""))


def name_key(c: Column) -> Column:
    return F.coalesce(F.replace(F.lower(F.trim(c)), F.lit("_"), F.lit(" ")), F.lit(""))


def density(name: Column) -> Column:
    """Grams of a cup: by name, by alias, without descriptors, and by the first listed name that ends either form."""
    known = F.create_map(*[F.lit(x) for kv in fixed.DENSITY.items() for x in (kv[0], float(kv[1]))])
    alias = F.create_map(*[F.lit(x) for kv in fixed.DENSITY_ALIASES.items() for x in kv])
    keys = F.array(*[F.struct(F.lit(f" {k}").alias("k"), F.lit(float(v)).alias("v")) for k, v in fixed.DENSITY.items()])
    stripped = F.array_join(F.filter(F.split(name, r"\s+"), lambda w: ~w.isin(fixed.DENSITY_WORDS)), " ")

    def grams(b: Column) -> Column:
        ends = F.filter(keys, lambda k: F.endswith(b["n"], k["k"]) | F.endswith(b["s"], k["k"]))
        return F.coalesce(F.try_element_at(known, b["n"]), F.try_element_at(known, F.try_element_at(alias, b["n"])), F.try_element_at(known, b["s"]), F.get(ends, F.lit(0))["v"])

    # Bound once, so that the expression stays small however many densities there are.
    return F.get(F.transform(F.array(F.struct(name.alias("n"), stripped.alias("s"))), grams), F.lit(0))


def is_liquid(name: Column) -> Column:
    return name.isin(fixed.LIQUIDS) | name.rlike(fixed.LIQUID_ENDING)


def normalise(df: DataFrame, name: str = "name", quantity: str = "quantity", unit: str = "unit") -> DataFrame:
    """Adds canonical_quantity, canonical_unit, method, factor, confidence and flags.

    In this order: no quantity meant, no quantity given, no unit (a count), weight, colloquial, count, volume (millilitres
    of liquids, grams by density, grams by a general density), unknown.  Text quantities may be fractions.
    """
    q = F.col(quantity) if dict(df.dtypes)[quantity] in ("double", "float", "int", "bigint") else simple_amount(F.col(quantity))
    df = df.withColumns({"_q": q.cast("double"), "_u": unit_key(F.col(unit)), "_n": name_key(F.col(name))})
    df = df.join(F.broadcast(unit_table(df.sparkSession)), F.col("_u") == F.col("unit_key"), "left").withColumn("_d", density(F.col("_n")))
    kind, n, f = F.col("kind"), F.col("_q"), F.col("factor")
    liquid, dense = is_liquid(F.col("_n")) | F.col("_n").isin(fixed.POURED), F.col("_d").isNotNull()
    per = F.coalesce("_d", F.lit(fixed.GENERIC_DENSITY)) / fixed.CUP_ML

    def case(unq, none, blank, weight, colloquial, count, ml, grams, guess, unknown) -> Column:
        v = lambda x: x if isinstance(x, Column) else F.lit(x)
        return (
            F.when(kind == "unquantified", v(unq)).when(n.isNull(), v(none)).when(F.col("_u") == "", v(blank)).when(kind == "weight", v(weight)).when(kind == "colloquial", v(colloquial))
            .when(kind == "count", v(count)).when((kind == "volume") & liquid, v(ml)).when((kind == "volume") & dense, v(grams)).when(kind == "volume", v(guess)).otherwise(v(unknown))
        )

    metric, volume = F.round(n * f, 2), F.round(n * f * per, 2)
    one = F.lit(1.0)
    flag = case("unquantified_unit", "quantity_missing", None, None, "colloquial_unit", None, None, None, "density_estimated", "unit_unresolved")
    out = {
        "canonical_quantity": case(None, None, n, metric, metric, n, metric, volume, volume, None).cast("double"),
        "canonical_unit": case(None, None, "count", "g", "g", "count", "ml", "g", "g", None),
        "method": case("unquantified", "unknown", "count_inferred", "weight_standard", "colloquial_estimate", "count_passthrough", "volume_standard", "density_lookup", "estimated_density_lookup", "unknown"),
        "conversion_factor": case(None, None, one, f, f, one, f, F.round(f * per, 4), F.round(f * per, 4), None).cast("double"),
        "uom_confidence": case(0.5, 0.0, 0.8, 1.0, F.col("unit_confidence"), 1.0, 1.0, 0.95, 0.7, 0.0).cast("double"),
        "uom_flags": F.array_compact(F.array(flag)),
    }
    return df.withColumns(out).drop("_q", "_u", "_n", "_d", "unit_key", "kind", "unit_out", "factor", "unit_confidence")
