"""Data-quality queries: checks, verdicts, fingerprints and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pantrylake.functions.text import hash_form
from pantrylake.operators import validate as V
from pantrylake.operators.joins import latest
from pantrylake.operators.metrics import exposition, safe_rate
from pantrylake.plans.registry import query, table


def document_checks() -> list[V.Check]:
    """The checks that apply to a text without ingredients: same severities, same verdict."""
    return [
        V.Check("V01", "schema_completeness", "CRITICAL", "REJECT", F.col("v01")),
        V.Check("V04", "quantity_sanity", "HIGH", "REVIEW", F.col("v04")),
        V.Check("V07", "nutrition", "MEDIUM", "FLAG", F.col("v07")),
        V.Check("V08", "enrichment_score", "MEDIUM", "FLAG", F.col("v08")),
        V.Check("V09", "duplicate_guard", "CRITICAL", "REJECT", ~F.coalesce("known", F.lit(False))),
        V.Check("V10", "language", "MEDIUM", "FLAG", F.col("v10")),
        V.Check("V11", "image", "LOW", "WARN", F.col("v11")),
    ]


def judged(spark, sf) -> DataFrame:
    """Documents with the verdict; one whose normalised text has come before, by id, is known.

    Hash and checks are evaluated where the text is read, so that ids, hashes and booleans are all that is shuffled; hashes
    that one document alone has are dropped before the join, and AQE splits one that very many share.
    """
    t = F.col("text")
    tests = {
        "v01": F.length(F.trim(t)) > 2, "v04": (F.col("n_chars") > 0) & (F.col("n_chars") < 10000), "v07": ~t.contains("!!"), "v08": ~t.contains("###"), "v10": F.col("lang").isin("en", "english"), "v11": ~t.contains("|"),
    }
    docs = table(spark, sf, "documents").select("doc_id", F.sha2(hash_form(t), 256).alias("h"), *[c.alias(n) for n, c in tests.items()])
    first = docs.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("h", "first")
    docs = docs.join(first, "h", "left").withColumn("known", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    return V.judge(docs, document_checks())


CHECKED = """
WITH d AS (SELECT *, doc_id > min(doc_id) OVER (PARTITION BY trim(regexp_replace(lower(text), '[ \\t\\n\\r]+', ' ', 'g'))) AS known FROM documents),
c AS (SELECT doc_id, length(trim(text)) > 2 AS v01, n_chars > 0 AND n_chars < 10000 AS v04, text NOT LIKE '%!!%' AS v07, text NOT LIKE '%###%' AS v08, NOT known AS v09, lang IN ('en', 'english') AS v10, text NOT LIKE '%|%' AS v11 FROM d),
j AS (SELECT *, CASE WHEN NOT v01 OR NOT v09 THEN 'REJECTED' WHEN NOT v04 OR (CASE WHEN v07 THEN 0 ELSE 1 END + CASE WHEN v08 THEN 0 ELSE 1 END + CASE WHEN v10 THEN 0 ELSE 1 END) > 2 THEN 'REVIEW' ELSE 'ACCEPTED' END AS status,
  list_filter([CASE WHEN v01 THEN '' ELSE 'V01' END, CASE WHEN v04 THEN '' ELSE 'V04' END, CASE WHEN v07 THEN '' ELSE 'V07' END, CASE WHEN v08 THEN '' ELSE 'V08' END, CASE WHEN v09 THEN '' ELSE 'V09' END, CASE WHEN v10 THEN '' ELSE 'V10' END, CASE WHEN v11 THEN '' ELSE 'V11' END], lambda x: x <> '') AS codes FROM c)
"""


@query(CHECKED + "SELECT doc_id, status, array_to_string(codes, ',') AS failure_codes FROM j")
def quality_verdict(spark, sf):
    """Fingerprint, checks, verdict for every document."""
    return judged(spark, sf).select("doc_id", "status", F.array_join("failure_codes", ",").alias("failure_codes"))


@query(CHECKED + """
SELECT count(*) AS total, count(*) FILTER (status = 'ACCEPTED') AS accepted, count(*) FILTER (status = 'REVIEW') AS review, count(*) FILTER (status = 'REJECTED') AS rejected,
round(count(*) FILTER (status = 'ACCEPTED') / count(*), 4) AS acceptance_rate, count(*) FILTER (status = 'ACCEPTED' AND (NOT v01 OR NOT v09)) AS accepted_critical, round(count(*) FILTER (status = 'ACCEPTED') / count(*), 4) >= 0.85 AS goals_met FROM j
""")
def verdict_kpis(spark, sf):
    return V.kpis(judged(spark, sf))


@query(CHECKED + "SELECT code AS check_id, count(*) AS n FROM (SELECT unnest(codes) AS code FROM j) GROUP BY code")
def failure_code_counts(spark, sf):
    return V.failure_counts(judged(spark, sf))


@query("""
SELECT h AS content_hash, count(*) AS copies, min(doc_id) AS first_id FROM (SELECT doc_id, sha256(trim(regexp_replace(lower(text), '[ \\t\\n\\r]+', ' ', 'g'))) AS h FROM documents) GROUP BY h HAVING count(*) > 1
""")
def fingerprint_dupes(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.sha2(hash_form(F.col("text")), 256).alias("content_hash"))
    return rows.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).filter("copies > 1")


@query("""
SELECT coalesce(CAST(quality AS VARCHAR), 'none') AS quality, count(*) AS n, round(avg(n_chars), 4) AS mean_chars, round(count(*) FILTER (text LIKE '%!!%') / count(*), 4) AS shouting_rate FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1
""")
def label_quality_rates(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").groupBy(F.coalesce(F.col("quality").cast("string"), F.lit("none")).alias("quality"))
    return rows.agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars"), safe_rate(F.count_if(F.col("text").contains("!!")), F.count("*")).alias("shouting_rate"))


@query("""
SELECT user_id, event_type, value, NOT (event_type = 'error' AND value > 50) AS ok FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1
""")
def latest_validation(spark, sf):
    """The latest report of each record and whether it holds."""
    rows = latest(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"])
    return rows.select("user_id", "event_type", "value", (~((F.col("event_type") == "error") & (F.col("value") > 50))).alias("ok"))


@query("""
SELECT * FROM (SELECT event_id, ts, value, 'PENDING' AS status FROM events WHERE event_type = 'error' ORDER BY ts, event_id LIMIT 20) UNION ALL
SELECT * FROM (SELECT event_id, ts, value, 'DEAD' AS status FROM events WHERE event_type = 'signup' ORDER BY ts DESC, event_id DESC LIMIT 20)
""")
def queue_reads(spark, sf):
    """The oldest pending reviews and the latest dead letters."""
    e = table(spark, sf, "events")
    a = e.filter("event_type = 'error'").orderBy("ts", "event_id").limit(20).select("event_id", "ts", "value", F.lit("PENDING").alias("status"))
    b = e.filter("event_type = 'signup'").orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "ts", "value", F.lit("DEAD").alias("status"))
    return a.unionByName(b)


@query(CHECKED + """
, k AS (SELECT count(*) AS total, count(*) FILTER (status = 'ACCEPTED') AS accepted, count(*) FILTER (status = 'REVIEW') AS review, count(*) FILTER (status = 'REJECTED') AS rejected FROM j)
SELECT '# TYPE pantrylake_' || name || ' gauge' || chr(10) || 'pantrylake_' || name || ' ' || v AS line FROM (
  SELECT 'total' AS name, CAST(CAST(total AS DOUBLE) AS VARCHAR) AS v FROM k UNION ALL SELECT 'accepted', CAST(CAST(accepted AS DOUBLE) AS VARCHAR) FROM k UNION ALL SELECT 'review', CAST(CAST(review AS DOUBLE) AS VARCHAR) FROM k
  UNION ALL SELECT 'rejected', CAST(CAST(rejected AS DOUBLE) AS VARCHAR) FROM k UNION ALL SELECT 'acceptance_rate', CAST(round(accepted / total, 4) AS VARCHAR) FROM k)
""")
def metrics_exposition(spark, sf):
    """Gauges as text lines; the numbers are those of verdict_kpis."""
    return exposition(V.kpis(judged(spark, sf)).select("total", "accepted", "review", "rejected", "acceptance_rate"))
