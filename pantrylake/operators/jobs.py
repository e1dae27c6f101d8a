"""Jobs around queries: chunks, retries, runs that leave a record, configuration that is read again when it changes, schedules."""

from __future__ import annotations

import datetime
import hmac
import json
import os
import time
from collections.abc import Callable, Iterator
from typing import Any, TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

X = TypeVar("X")


def retried(f: Callable[[], X], tries: int = 3, first: float = 1.0, factor: float = 4.0, most: float = 16.0, sleep: Callable[[float], None] = time.sleep) -> X:
    """f's result; a failure is tried again after growing waits, the last one raised."""
    wait = first
    for left in range(tries - 1, -1, -1):
        try:
            return f()
        except Exception:
            if not left:
                raise
        sleep(min(wait, most))
        wait *= factor
    raise ValueError("tries must be positive")


def chunks(df: DataFrame, key: str, size: int = 500) -> DataFrame:
    """df with `chunk`: numbers of about `size` rows each, by a hash of the key, so that a chunk run again has the same rows."""
    n = max(1, -(-df.count() // size))
    return df.withColumn("chunk", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))


def run_in_chunks(df: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, key: str, size: int = 500) -> DataFrame:
    """work applied to the whole of df, written by chunk; chunks that are already there are not done again."""
    spark = df.sparkSession
    parted = chunks(df, key, size)
    try:
        done = spark.read.parquet(path)
    except Exception:  # noqa: BLE001 - nothing written yet
        done = None
    todo = parted if done is None else parted.join(done.select("chunk").distinct(), "chunk", "left_anti")
    work(todo).write.mode("append").partitionBy("chunk").parquet(path)
    return spark.read.parquet(path)


def run_job(spark: SparkSession, path: str, name: str, work: Callable[[], dict[str, Any]], now: Callable[[], datetime.datetime] = lambda: datetime.datetime.now(datetime.UTC)) -> dict[str, Any]:
    """work's summary, with a RUNNING record written before and a SUCCEEDED or FAILED one after; `run_states` gives the latest."""
    run_id = f"{name}-{now():%Y%m%dT%H%M%S%f}"

    def note(status: str, detail: str) -> None:
        row = [(run_id, name, status, detail, now().isoformat())]
        spark.createDataFrame(row, "run_id string, job string, status string, detail string, at string").coalesce(1).write.mode("append").json(path)

    note("RUNNING", "")
    try:
        got = work()
    except Exception as e:
        note("FAILED", f"{type(e).__name__}: {e}")
        raise
    note("SUCCEEDED", json.dumps(got, sort_keys=True, default=str))
    return got | {"run_id": run_id}


def run_states(runs: DataFrame) -> DataFrame:
    """The latest state of each run."""
    return runs.groupBy("run_id").agg(F.max(F.struct("at", "job", "status", "detail")).alias("x")).select("run_id", "x.*")


def load_until(rows: DataFrame, bad: str, limit: int | None = None, errors: int = 10) -> tuple[DataFrame, dict[str, int]]:
    """Rows without a fault in column `bad`, at most `limit` of all, and counts; too many faults fail the load."""
    part = rows if limit is None else rows.limit(limit)
    n = part.agg(F.count("*").alias("total"), F.count(bad).alias("failed")).first()
    if n["failed"] >= errors:
        raise ValueError(f"{n['failed']} of {n['total']} rows failed")
    return part.filter(F.col(bad).isNull()).drop(bad), {"inserted": n["total"] - n["failed"], "failed": n["failed"]}


def read_config(path: str) -> Any:
    """A JSON or, where the library is there, YAML file."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith((".yml", ".yaml")):
        import yaml

        return yaml.safe_load(text)
    return json.loads(text)


def sources_of(config: Any) -> dict[str, dict[str, Any]]:
    """Enabled sources by id; the last of an id wins."""
    rows = config["sources"] if isinstance(config, dict) else config
    return {str(r["source_id"]): r.get("config", {}) | r for r in rows if r.get("enabled", True)}


class Watched:
    """A configuration file, read again when its time or size has changed."""

    def __init__(self, path: str, read: Callable[[str], Any] = read_config):
        self.path, self.read, self.seen, self.value = path, read, None, None

    def get(self) -> Any:
        stat = os.stat(self.path)
        now = (stat.st_mtime_ns, stat.st_size)
        if now != self.seen:
            self.value, self.seen = self.read(self.path), now
        return self.value


def next_run(now: datetime.datetime, at: str = "03:00") -> datetime.datetime:
    """The next time of day after now."""
    hour, minute = map(int, at.split(":"))
    today = now.replace(hour=hour, minute=minute, second=0, microsecond=0)
    return today if today > now else today + datetime.timedelta(days=1)


def daily(work: Callable[[], Any], lock: str, at: str = "03:00", days: int | None = None, now: Callable[[], datetime.datetime] = datetime.datetime.now, sleep: Callable[[float], None] = time.sleep) -> Iterator[Any]:
    """work's results, once a day; a run that finds another's lock file is left out."""
    done = 0
    while days is None or done < days:
        sleep(max(0.0, (next_run(now(), at) - now()).total_seconds()))
        done += 1
        try:
            os.close(os.open(lock, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
        except FileExistsError:
            yield None
            continue
        try:
            yield work()
        finally:
            os.remove(lock)


def allowed(given: str | None, secret: str | None) -> int:
    """The HTTP status for an administrator's token: 503 where none is set, 401 for a wrong one; compared in constant time."""
    if not secret:
        return 503
    return 200 if hmac.compare_digest((given or "").encode(), secret.encode()) else 401


def add_alias(aliases: DataFrame, alias: str, canonical: str, token: str | None, secret: str | None) -> tuple[int, DataFrame]:
    """The status, and aliases with one more if the token is right and no such alias is there, regardless of case."""
    from pantrylake.operators.upsert import insert_absent_nocase

    status = allowed(token, secret)
    if status != 200:
        return status, aliases
    new = aliases.sparkSession.createDataFrame([(alias, canonical)], "alias string, canonical string")
    return status, aliases.unionByName(insert_absent_nocase(aliases, new, "alias"), allowMissingColumns=True)
