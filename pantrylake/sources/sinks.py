"""Exports and run records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def flat_cells(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for formats without them."""
    return df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) if t != "variant" else F.to_json(c).alias(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str, sep: str = ",", one_file: bool = False) -> None:
    """CSV with header; one file only where a reader needs that and the result is small."""
    out = flat_cells(df)
    (out.coalesce(1) if one_file else out).write.mode("overwrite").csv(path, header=True, sep=sep, escape='"')


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def counted_write(df: DataFrame, path: str, source_id: str, run_id: str) -> dict:
    """Writes Parquet and gives the run's record; counts come from the write itself, not from a second pass."""
    seen = Observation(f"run-{run_id}")
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    return {"run_id": run_id, "source_id": source_id, "status": "COMPLETED", "records": seen.get["n"]}
