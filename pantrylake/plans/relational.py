"""Joins, aggregations, windows, sorts, set operations and predicates over the test tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pantrylake.operators.joins import as_of, latest, missing, sorted_distinct_text, top_per_key
from pantrylake.operators.metrics import completeness, exact_percentile, safe_rate, state_gap
from pantrylake.operators.search import listing_filter, page, trending_score
from pantrylake.operators.upsert import merge_nonempty, upsert_two_keys
from pantrylake.plans.registry import query, table


@query("""
SELECT p_partkey, p_name, p_brand, p_retailprice FROM part
WHERE (p_name ILIKE '%a%' OR p_type ILIKE '%steel%' OR p_brand ILIKE '%1%') AND lower(p_brand) = lower('BRAND#2')
  AND coalesce(p_retailprice, 0) >= 920 AND p_type LIKE 'S%' AND (NULL IS NULL OR p_size = NULL)
""")
def scan_project_filter(spark, sf):
    part = table(spark, sf, "part")
    keep = listing_filter(part, text="a|steel|1", text_columns=["p_name", "p_type", "p_brand"], equal={"p_brand": "BRAND#2", "p_size": None}, at_least={"p_retailprice": 920})
    return part.filter(keep & F.col("p_type").like("S%")).select("p_partkey", "p_name", "p_brand", "p_retailprice")


@query("""
SELECT o_orderkey, o_custkey, o_orderstatus, coalesce(n_lines, 0) AS n_lines, coalesce(line_text, '') AS line_text
FROM orders LEFT JOIN (
  SELECT l_orderkey, count(*) AS n_lines,
         string_agg(l_linenumber || ':' || l_partkey || ':' || l_suppkey, '|' ORDER BY l_linenumber, l_partkey, l_suppkey) AS line_text
  FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey
""")
def entity_with_lines(spark, sf):
    """Each order with its lines as one ordered string; lines are aggregated before the join."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: F.concat_ws(":", x.l_linenumber, x.l_partkey, x.l_suppkey)), "|")
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), text.alias("line_text"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left").select(
        "o_orderkey", "o_custkey", "o_orderstatus", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("line_text", F.lit("")).alias("line_text")
    )


@query("""
SELECT o_orderkey, o_orderstatus, l_linenumber, l_partkey, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity >= 45
""")
def line_details_inner(spark, sf):
    lines = table(spark, sf, "lineitem").filter("l_quantity >= 45").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")


@query("""
SELECT c_custkey, c_name, coalesce(n_orders, 0) AS n_orders, coalesce(round(spent, 2), 0) AS spent
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, sum(o_totalprice) AS spent FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey
ORDER BY spent DESC NULLS LAST, c_custkey DESC LIMIT 20 OFFSET 20
""")
def paged_listing(spark, sf):
    totals = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("spent"))
    rows = table(spark, sf, "customer").join(totals, F.col("c_custkey") == F.col("o_custkey"), "left")
    rows = rows.select("c_custkey", "c_name", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), F.coalesce("spent", F.lit(0.0)).alias("spent"))
    return page(rows, ["spent", "c_custkey"], number=2, size=20)


@query("""
SELECT o_orderkey, count(l_orderkey) AS n_lines, coalesce(string_agg(CASE WHEN l_orderkey IS NOT NULL THEN coalesce(p_name, '?') || ' x' || CAST(l_quantity AS BIGINT) END, '; ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity), '') AS lines
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey LEFT JOIN part ON l_partkey = p_partkey GROUP BY o_orderkey
""")
def detail_nested(spark, sf):
    """A nested detail row for every order, those without lines too."""
    lines = (
        table(spark, sf, "lineitem")
        .join(table(spark, sf, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"), "left")
        .groupBy("l_orderkey")
        .agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "p_name"))).alias("x"))
    )
    text = F.array_join(F.transform("x", lambda r: F.concat(F.coalesce(r.p_name, F.lit("?")), F.lit(" x"), r.l_quantity.cast("long"))), "; ")
    rows = table(spark, sf, "orders").select("o_orderkey").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return rows.select("o_orderkey", F.coalesce(F.size("x"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(text, F.lit("")).alias("lines"))


@query("""
SELECT r_name, count(*) FILTER (c_acctbal > 0) AS n_positive, count(DISTINCT CASE WHEN c_acctbal > 5000 THEN c_mktsegment END) AS rich_segments,
       count(DISTINCT n_nationkey) AS n_nations, round(avg(coalesce(c_acctbal, 0)), 4) AS avg_balance
FROM region JOIN nation ON r_regionkey = n_regionkey LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY r_name
""")
def state_coverage(spark, sf):
    nations = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = nations.join(table(spark, sf, "customer"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return rows.groupBy("r_name").agg(
        F.count_if(F.col("c_acctbal") > 0).alias("n_positive"),
        F.countDistinct(F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment"))).alias("rich_segments"),
        F.countDistinct("n_nationkey").alias("n_nations"),
        F.round(F.avg(F.coalesce("c_acctbal", F.lit(0.0))), 4).alias("avg_balance"),
    )


@query("""
SELECT n_name AS place, coalesce(n, 0) AS have, greatest(CAST(ceil(2000 / 25.0) AS BIGINT) - coalesce(n, 0), 0) AS remaining
FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey) ON n_nationkey = c_nationkey
""")
def state_target_gap(spark, sf):
    have = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("have")).withColumnRenamed("c_nationkey", "key")
    places = table(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("place"))
    return state_gap(places, have, target=2000, n_places=25).select("place", "have", "remaining")


@query("""
SELECT l_partkey, count(*) AS n, round(avg(stars), 4) AS avg_stars, count(*) FILTER (stars = 1) AS s1, count(*) FILTER (stars = 2) AS s2,
       count(*) FILTER (stars = 3) AS s3, count(*) FILTER (stars = 4) AS s4, count(*) FILTER (stars = 5) AS s5
FROM (SELECT l_partkey, CAST(1 + floor((l_quantity - 1) / 10) AS INT) AS stars FROM lineitem) GROUP BY l_partkey
""")
def ratings_histogram(spark, sf):
    stars = table(spark, sf, "lineitem").select("l_partkey", (1 + F.floor((F.col("l_quantity") - 1) / 10)).cast("int").alias("stars"))
    return stars.groupBy("l_partkey").agg(F.count("*").alias("n"), F.round(F.avg("stars"), 4).alias("avg_stars"), *[F.count_if(F.col("stars") == k).alias(f"s{k}") for k in range(1, 6)])


@query("""
SELECT p_partkey, p_name, round(coalesce(avg_q, 0) * 10 + least(coalesce(n, 0), 50) + CASE WHEN last_ship >= TIMESTAMP '1998-06-01' - INTERVAL 30 DAY THEN 5 ELSE 0 END, 4) AS score
FROM part LEFT JOIN (SELECT l_partkey, avg(l_quantity) AS avg_q, count(*) AS n, max(l_shipdate) AS last_ship FROM lineitem GROUP BY l_partkey) ON p_partkey = l_partkey
ORDER BY score DESC, p_partkey LIMIT 25
""")
def trending_topk(spark, sf):
    use = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.avg("l_quantity").alias("avg_q"), F.count("*").alias("n"), F.max("l_shipdate").alias("seen"))
    rows = table(spark, sf, "part").join(use, F.col("p_partkey") == F.col("l_partkey"), "left")
    score = trending_score(F.lit(None), F.col("avg_q"), F.col("n"), F.col("seen"), F.expr("timestamp_ntz '1998-06-01'"))
    return rows.select("p_partkey", "p_name", F.round(score, 4).alias("score")).orderBy(F.desc("score"), "p_partkey").limit(25)


@query("""
SELECT id, string_agg(DISTINCT kind, ' | ' ORDER BY kind) AS kinds, count(*) AS n FROM (
  SELECT o_custkey AS id, o_orderpriority AS kind FROM orders UNION SELECT c_custkey, c_mktsegment FROM customer) GROUP BY id
""")
def provenance_union(spark, sf):
    tracked = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("kind"))
    own = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("kind"))
    return tracked.union(own).distinct().groupBy("id").agg(sorted_distinct_text("kind", " | ").alias("kinds"), F.count("*").alias("n"))


@query("SELECT DISTINCT ON (user_id) user_id, event_id, event_type, value FROM events ORDER BY user_id, ts DESC, event_id DESC")
def latest_per_key(spark, sf):
    return latest(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, rn FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn <= 3
""")
def first_n_per_key(spark, sf):
    return top_per_key(table(spark, sf, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], 3).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "rn")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def missing_children_anti(spark, sf):
    big = table(spark, sf, "orders").filter("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return missing(table(spark, sf, "customer"), big, ["c_custkey"]).select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def exists_semi(spark, sf):
    done = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(done, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50 AND l_discount > 0.08 AND l_tax > 0.06) AND s_nationkey IN (1, 3, 5, 7, 9)")
def not_in_list(spark, sf):
    full = table(spark, sf, "lineitem").filter("l_quantity = 50 AND l_discount > 0.08 AND l_tax > 0.06").select(F.col("l_suppkey").alias("s_suppkey"))
    return missing(table(spark, sf, "supplier").filter(F.col("s_nationkey").isin(1, 3, 5, 7, 9)), full, ["s_suppkey"]).select("s_suppkey", "s_name")


@query("""
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_value, round(percentile_cont(0.99) WITHIN GROUP (ORDER BY value), 6) AS p99,
       round(avg(epoch(ts) - epoch(TIMESTAMP '2024-01-01')), 3) AS mean_age_s, round(count(*) FILTER (value > 50) / count(*), 4) AS high_rate
FROM events GROUP BY event_type
""")
def run_metrics(spark, sf):
    """Counts, means and exact percentiles; the percentile is taken from the one slice of values that holds it."""
    events = table(spark, sf, "events")
    age = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / 1e6
    return events.join(F.broadcast(exact_percentile(events, "event_type", "value", 0.99, "p99")), "event_type").groupBy("event_type").agg(
        F.count("*").alias("n"),
        F.round(F.avg("value"), 6).alias("mean_value"),
        F.round(F.first("p99"), 6).alias("p99"),
        F.round(F.avg(age), 3).alias("mean_age_s"),
        safe_rate(F.count_if(F.col("value") > 50), F.count("*")).alias("high_rate"),
    )


@query("""
SELECT source, count(*) AS total, count(*) FILTER (trim(coalesce(text, '')) <> '') AS has_text, count(*) FILTER (lang IS NOT NULL AND lang <> '') AS has_lang,
       count(*) FILTER (n_chars > 200) AS has_long, count(*) FILTER (text LIKE '%' || chr(10) || '%') AS has_lines FROM documents GROUP BY source
""")
def completeness_report(spark, sf):
    checks = {"has_text": "trim(coalesce(text, '')) <> ''", "has_lang": "lang IS NOT NULL AND lang <> ''", "has_long": "n_chars > 200", "has_lines": "text LIKE '%\n%'"}
    return completeness(table(spark, sf, "documents"), ["source"], checks)


@query("""
SELECT (SELECT count(*) FROM customer) AS n_customers, (SELECT count(*) FROM orders) AS n_orders, (SELECT count(*) FROM lineitem WHERE l_quantity <= 0) AS bad_quantities,
       (SELECT count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)) AS orders_without_lines,
       (SELECT count(*) FROM customer) >= 100 AS ps1_volume, (SELECT count(*) FROM lineitem WHERE l_quantity <= 0) = 0 AS ps2_quantities,
       (SELECT round(count(DISTINCT o_custkey) / (SELECT count(*) FROM customer), 4) FROM orders) >= 0.5 AS ps3_coverage
""")
def acceptance_report(spark, sf):
    customers, orders, lines = (table(spark, sf, x) for x in ("customer", "orders", "lineitem"))
    a = customers.agg(F.count("*").alias("n_customers"))
    b = orders.agg(F.count("*").alias("n_orders"), F.countDistinct("o_custkey").alias("buyers"))
    c = lines.agg(F.count_if(F.col("l_quantity") <= 0).alias("bad_quantities"))
    d = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").agg(F.count("*").alias("orders_without_lines"))
    one = a.join(b, how="cross").join(c, how="cross").join(d, how="cross")  # four single rows
    return one.select(
        "n_customers", "n_orders", "bad_quantities", "orders_without_lines", (F.col("n_customers") >= 100).alias("ps1_volume"), (F.col("bad_quantities") == 0).alias("ps2_quantities"),
        (safe_rate(F.col("buyers"), F.col("n_customers")) >= 0.5).alias("ps3_coverage"),
    )


@query("SELECT p_name, p_brand, count(*) AS mentions FROM part WHERE p_size > 10 GROUP BY p_name, p_brand ORDER BY mentions DESC, p_name NULLS LAST, p_brand LIMIT 15")
def top_unresolved(spark, sf):
    return table(spark, sf, "part").filter("p_size > 10").groupBy("p_name", "p_brand").agg(F.count("*").alias("mentions")).orderBy(F.desc("mentions"), F.asc_nulls_last("p_name"), "p_brand").limit(15)


@query("""
SELECT event_type, count(*) AS total, count(*) FILTER (json_extract_string(props, '$.k') IS NOT NULL) AS with_k, round(sum(coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0)), 4) AS sum_k,
       count(*) FILTER (json_type(props, '$.k') IN ('BIGINT', 'UBIGINT', 'DOUBLE')) AS numeric_k FROM events GROUP BY event_type
""")
def json_props_quality(spark, sf):
    v = F.try_parse_json("props")
    kind = F.schema_of_variant(F.variant_get(v, "$.k", "variant"))
    return table(spark, sf, "events").groupBy("event_type").agg(
        F.count("*").alias("total"),
        F.count(F.try_variant_get(v, "$.k", "string")).alias("with_k"),
        F.round(F.sum(F.coalesce(F.try_variant_get(v, "$.k", "double"), F.lit(0.0))), 4).alias("sum_k"),
        F.count_if(kind.rlike("^(BIGINT|DOUBLE|DECIMAL)")).alias("numeric_k"),
    )


@query("""
WITH s AS (SELECT o_custkey, max(o_totalprice) AS c_acctbal, max(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority || ' ' || o_custkey END) AS c_name FROM orders GROUP BY o_custkey)
SELECT coalesce(c_custkey, o_custkey) AS c_custkey, coalesce(nullif(s.c_name, ''), t.c_name) AS c_name, coalesce(s.c_acctbal, t.c_acctbal) AS c_acctbal, c_custkey IS NULL AS inserted
FROM customer t FULL JOIN s ON c_custkey = o_custkey
""")
def cond_merge_update(spark, sf):
    """All customers, merged with what all orders say of them."""
    name = F.max(F.when(F.col("o_orderstatus") == "F", F.concat_ws(" ", "o_orderpriority", "o_custkey")))
    new = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"), name.alias("c_name"))
    return merge_nonempty(table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), new, ["c_custkey"]).select("c_custkey", "c_name", "c_acctbal", "inserted")


@query("""
WITH s AS (SELECT 'h' || max(o_orderkey) AS content_hash, 'u' || min(o_orderkey) AS url_hash, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY o_custkey),
m AS (SELECT s.content_hash, s.v, least(a.c_custkey, b.c_custkey) AS id FROM s LEFT JOIN customer a ON s.content_hash = 'h' || a.c_custkey LEFT JOIN customer b ON s.url_hash = 'u' || b.c_custkey)
SELECT id, content_hash, v, CASE WHEN id IS NULL THEN 'insert' ELSE 'update' END AS action FROM m
""")
def upsert_merge(spark, sf):
    """An aggregate of all orders into all customers, by the numbers of a customer's last or first order."""
    target = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.expr("'h' || c_custkey").alias("content_hash"), F.expr("'u' || c_custkey").alias("url_hash"))
    sums = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("last"), F.min("o_orderkey").alias("first"), F.round(F.sum("o_totalprice"), 2).alias("v"))
    source = sums.select(F.expr("'h' || last").alias("content_hash"), F.expr("'u' || first").alias("url_hash"), "v")
    return upsert_two_keys(target, source, "id", "content_hash", "url_hash").select("id", "content_hash", "v", "action")


@query("SELECT coalesce(o_orderstatus, 'ALL') AS status, coalesce(o_orderpriority, 'ALL') AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority) HAVING count(*) > 10")
def rollup_cube(spark, sf):
    rows = table(spark, sf, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).filter("n > 10")
    return rows.select(F.coalesce("o_orderstatus", F.lit("ALL")).alias("status"), F.coalesce("o_orderpriority", F.lit("ALL")).alias("priority"), "n", "total")


@query("""
SELECT 'both' AS part, k FROM (SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0)
UNION ALL SELECT 'only' AS part, k FROM (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0 EXCEPT SELECT o_custkey FROM orders)
""")
def set_ops(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    b = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return a.intersect(b).select(F.lit("both").alias("part"), "k").unionByName(b.subtract(a).select(F.lit("only").alias("part"), "k"))


@query("""
SELECT event_id, user_id, lag(event_type) OVER w AS before, lead(event_type) OVER w AS after, ntile(4) OVER w AS quarter, rank() OVER (PARTITION BY user_id ORDER BY event_type) AS type_rank,
       round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS moving
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def analytic_windows(spark, sf):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select(
        "event_id", "user_id", F.lag("event_type").over(w).alias("before"), F.lead("event_type").over(w).alias("after"), F.ntile(4).over(w).alias("quarter"),
        F.rank().over(W.partitionBy("user_id").orderBy("event_type")).alias("type_rank"), F.round(F.avg("value").over(w.rowsBetween(-2, 0)), 6).alias("moving"),
    )


@query("""
SELECT p.event_id, p.user_id, v.event_id AS view_id, v.ts AS view_ts FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY user_id, ts) v ON p.user_id = v.user_id AND p.ts >= v.ts
""")
def asof_events(spark, sf):
    """The last view at or before each purchase of a user."""
    e = table(spark, sf, "events")
    views = e.filter("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("view_id"))
    return as_of(e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), views.withColumn("view_ts", F.col("ts")), "user_id", "ts", ["view_id", "view_ts"]).drop("ts")


@query("""
SELECT a.event_id, count(b.event_id) AS near FROM (SELECT * FROM events WHERE event_type = 'error') a
LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') b ON b.ts BETWEEN a.ts - INTERVAL 10 MINUTE AND a.ts + INTERVAL 10 MINUTE GROUP BY a.event_id
""")
def range_join(spark, sf):
    """Clicks within ten minutes of an error; an equal join on time slices does the work of the range."""
    from pantrylake.operators.joins import within

    e = table(spark, sf, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")))
    a, b = e.filter("event_type = 'error'").select("event_id", "s"), e.filter("event_type = 'click'").select(F.col("event_id").alias("other"), F.col("s").alias("o"))
    return within(a, b, "s", "o", 600_000_000).groupBy("event_id").agg(F.count("other").alias("near"))


@query("SELECT o_orderkey, l_orderkey IS NOT NULL AS matched FROM orders FULL JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON o_orderkey = l_orderkey")
def full_outer(spark, sf):
    """All orders against the keys of all lines."""
    a, b = table(spark, sf, "orders").select("o_orderkey"), table(spark, sf, "lineitem").select("l_orderkey").distinct()
    return a.join(b, F.col("o_orderkey") == F.col("l_orderkey"), "full").select("o_orderkey", F.col("l_orderkey").isNotNull().alias("matched"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_counts(spark, sf):
    rows = table(spark, sf, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n", "total")


@query("""
SELECT s AS start, count(*) AS errors FROM (SELECT ts, unnest(generate_series(time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 45 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts), INTERVAL 15 MINUTE)) AS s
FROM events WHERE event_type = 'error') GROUP BY s HAVING count(*) >= 5
""")
def alert_window(spark, sf):
    from pantrylake.streaming.alerts import failure_windows

    return failure_windows(table(spark, sf, "events").filter("event_type = 'error'"), at_least=5).select("start", F.col("n").alias("errors"))


@query("""
WITH g AS (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS f FROM events),
h AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS finish, count(*) AS n FROM h GROUP BY user_id, k
""")
def session_windows(spark, sf):
    rows = table(spark, sf, "events").groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("finish"), "n")


@query("""
WITH RECURSIVE t(n, total) AS (SELECT 1, 1 UNION ALL SELECT n + 1, total + n + 1 FROM t WHERE n < 20) SELECT n, total, r_name FROM t JOIN region ON r_regionkey = n % 5
""")
def recursive_series(spark, sf):
    table(spark, sf, "region").createOrReplaceTempView("region_for_series")
    return spark.sql(
        "WITH RECURSIVE t(n, total) AS (SELECT 1, 1 UNION ALL SELECT n + 1, total + n + 1 FROM t WHERE n < 20) SELECT n, total, r_name FROM t JOIN region_for_series ON r_regionkey = n % 5"
    )
