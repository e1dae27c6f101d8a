"""Domain queries: units, names, places, rules, duplicates, and the record pipeline on fixed examples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pantrylake.functions import fixed
from pantrylake.functions.quantity import parse_line
from pantrylake.operators import classify as C
from pantrylake.operators import resolve as R
from pantrylake.operators import units as U
from pantrylake.operators import validate as V
from pantrylake.plans.registry import query, table

UNITS = ["g", "kg", "oz", "cup", "tsp", "pinch", "cloves", "ladle", "to taste", ""]
FOODS = ["rice", "milk", "paneer", "olive oil", "red onion", "unknown spice", "toor dal", "coconut milk", "whole wheat flour", "saffron"]

UOM_SQL = f"""
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS q, list_extract({UNITS}, CAST(l_partkey % 10 + 1 AS INT)) AS u, list_extract({FOODS}, CAST(l_suppkey % 10 + 1 AS INT)) AS n FROM lineitem),
w(u, k, f) AS (VALUES ('g', 'weight', 1.0::DOUBLE), ('kg', 'weight', 1000), ('oz', 'weight', 28.3495), ('cup', 'volume', 240), ('tsp', 'volume', 5), ('pinch', 'colloquial', 0.3), ('cloves', 'count', 1), ('to taste', 'unquantified', NULL)),
d(n, g) AS (VALUES ('rice', 200.0::DOUBLE), ('paneer', 150), ('red onion', 160), ('toor dal', 200), ('whole wheat flour', 120)),
m AS (SELECT l.*, k, CASE WHEN k = 'unquantified' THEN NULL WHEN l.u = '' THEN q WHEN k IN ('weight', 'colloquial') THEN q * f WHEN k = 'count' THEN q WHEN k = 'volume' AND l.n IN ('milk', 'olive oil', 'coconut milk') THEN q * f WHEN k = 'volume' THEN q * f * coalesce(g, 120) / 240 END AS v,
  CASE WHEN k = 'unquantified' THEN 'unquantified' WHEN l.u = '' THEN 'count_inferred' WHEN k = 'weight' THEN 'weight_standard' WHEN k = 'colloquial' THEN 'colloquial_estimate' WHEN k = 'count' THEN 'count_passthrough'
  WHEN k = 'volume' AND l.n IN ('milk', 'olive oil', 'coconut milk') THEN 'volume_standard' WHEN k = 'volume' AND g IS NOT NULL THEN 'density_lookup' WHEN k = 'volume' THEN 'estimated_density_lookup' ELSE 'unknown' END AS method
  FROM l LEFT JOIN w ON l.u = w.u LEFT JOIN d ON l.n = d.n)
SELECT n AS name, u AS unit, method, count(*) AS lines, round(sum(round(v, 2)), 2) AS total FROM m GROUP BY 1, 2, 3
"""


@query(UOM_SQL)
def uom_convert(spark, sf):
    """Quantities of every line in canonical units, summed by name, unit and method."""
    pick = lambda xs, c: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col(c) % 10 + 1).cast("int"))
    rows = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("quantity"), pick(UNITS, "l_partkey").alias("unit"), pick(FOODS, "l_suppkey").alias("name"))
    return U.normalise(rows).groupBy("name", "unit", "method").agg(F.count("*").alias("lines"), F.round(F.sum("canonical_quantity"), 2).alias("total"))


PART_ALIASES = {"ring": "metal_ring", "anvil": "iron_anvil", "old bolt": "antique_bolt"}
PART_MASTERS = ["gear", "plate", "small gizmo", "red_widget"]


@query("""
WITH n AS (SELECT p_partkey, p_name, lower(p_name) AS k, regexp_replace(lower(p_name), '^((large|small|hot|medium) )+', '') AS k2 FROM part),
a(alias, canonical) AS (VALUES ('ring', 'metal_ring'), ('anvil', 'iron_anvil'), ('old bolt', 'antique_bolt')), c(alias, canonical) AS (VALUES ('gear', 'gear'), ('plate', 'plate'), ('small gizmo', 'small gizmo'), ('red widget', 'red_widget')),
x AS (SELECT n.*, coalesce(a1.canonical, a2.canonical) AS ac, c1.canonical AS cc FROM n LEFT JOIN a a1 ON k = a1.alias LEFT JOIN a a2 ON regexp_replace(k, '^(large|small) ', '') = a2.alias LEFT JOIN c c1 ON k = c1.alias)
SELECT p_partkey, coalesce(ac, cc) AS canonical, CASE WHEN ac IS NOT NULL THEN 'alias' WHEN cc IS NOT NULL THEN 'canonical' ELSE 'unresolved' END AS tier, CASE WHEN coalesce(ac, cc) IS NULL THEN 0.0 ELSE 1.0 END AS confidence FROM x
""")
def alias_cascade(spark, sf):
    aliases = spark.createDataFrame(list(PART_ALIASES.items()), "alias string, canonical string")
    masters = spark.createDataFrame([(m,) for m in PART_MASTERS], "canonical string")
    names = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("name"))
    return R.resolve(names, aliases, masters).select("p_partkey", "canonical", "tier", "confidence")


WORDS = {"english": ["the", "that", "with"], "german": ["der", "nicht", "und"], "french": ["les", "dans", "pour"], "spanish": ["los", "con", "una"]}


@query("""
WITH k(label, w, o) AS (VALUES ('english', 'the', 0), ('english', 'that', 1), ('english', 'with', 2), ('german', 'der', 3), ('german', 'nicht', 4), ('german', 'und', 5), ('french', 'les', 6), ('french', 'dans', 7), ('french', 'pour', 8), ('spanish', 'los', 9), ('spanish', 'con', 10), ('spanish', 'una', 11)),
m AS (SELECT doc_id, label, w, row_number() OVER (PARTITION BY doc_id ORDER BY length(w) DESC, o) AS rn FROM documents, k WHERE regexp_matches(lower(text), '(^|[^a-z0-9])' || w || '($|[^a-z0-9])'))
SELECT doc_id, label, w AS word FROM documents LEFT JOIN (SELECT * FROM m WHERE rn = 1) USING (doc_id)
""")
def classify_longest_keyword(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", C.longest_word(F.lower("text"), WORDS).alias("x"))
    return rows.select("doc_id", "x.label", "x.word")


@query("""
SELECT o_orderkey, CASE WHEN t IS NOT NULL THEN CASE WHEN t <= 30 AND s <= 8 THEN 'EASY' WHEN t <= 90 AND i <= 20 THEN 'MEDIUM' WHEN t <= 180 THEN 'HARD' ELSE 'EXPERT' END WHEN s <= 5 AND i <= 8 THEN 'EASY' WHEN s <= 12 THEN 'MEDIUM' ELSE 'HARD' END AS difficulty,
  array_to_string(list_filter([CASE WHEN t <= 30 THEN 'QUICK' ELSE '' END, CASE WHEN s <= 6 THEN 'BEGINNER_FRIENDLY' ELSE '' END, CASE WHEN t >= 90 THEN 'MEAL_PREP' ELSE '' END], lambda x: x <> ''), ',') AS tags
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey % 240 END AS t, o_custkey % 15 AS s, o_orderkey % 25 AS i FROM orders)
""")
def difficulty_case(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey") % 240).alias("t"), (F.col("o_custkey") % 15).alias("s"), (F.col("o_orderkey") % 25).alias("i"))
    tags = C.efficiency_tags(F.array().cast("array<string>"), F.col("t"), F.col("s"))
    return rows.select("o_orderkey", C.difficulty(F.col("t"), F.col("s"), F.col("i")).alias("difficulty"), F.array_join(tags, ",").alias("tags"))


DISHES = ["egg pulao", "mutton biryani", "vegan dal", "butter chicken curry", "poha", "kheer", "soy tofu salad", "veg sandwich", "fish curry", "onion pakora", "mango pickle", "plain dosa"]


def _any(terms: list[str]) -> str:
    return f"regexp_matches(t, '(^|[^a-z0-9])({'|'.join(terms)})($|[^a-z0-9])')"


def _listed(named: dict[str, list[str]]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_any(v)} THEN '{k}' ELSE '' END" for k, v in named.items()) + "], lambda x: x <> ''), ',')"


@query(f"""
SELECT o_orderkey, CASE WHEN {_any(fixed.MEAT)} THEN 'non_vegetarian' WHEN {_any(fixed.EGG)} THEN 'egg' WHEN contains(t, 'vegan') AND NOT {_any([*fixed.DAIRY, *fixed.EGG, *fixed.MEAT])} THEN 'vegan' WHEN contains(t, 'vegetarian') OR contains(t || ' ', 'veg ') THEN 'vegetarian' END AS diet,
  {_listed(fixed.ALLERGENS)} AS allergens, {_listed(fixed.DISH_TYPES)} AS dish_types, CASE {' '.join(f"WHEN {_any(v)} THEN '{k}'" for k, v in fixed.DISH_FAMILIES.items())} END AS family,
  CASE WHEN {_any(fixed.PREMIUM)} THEN 'PREMIUM' WHEN {_any(fixed.BUDGET)} THEN 'BUDGET' ELSE 'MID_RANGE' END AS cost
FROM (SELECT o_orderkey, list_extract({DISHES}, CAST(o_orderkey % 12 + 1 AS INT)) || ' ' || lower(o_orderpriority) AS t FROM orders)
""")
def rule_tags(spark, sf):
    dish = F.element_at(F.array(*[F.lit(x) for x in DISHES]), (F.col("o_orderkey") % 12 + 1).cast("int"))
    rows = table(spark, sf, "orders").select("o_orderkey", F.concat_ws(" ", dish, F.lower("o_orderpriority")).alias("t"))
    t = F.col("t")
    rows = rows.select(
        "o_orderkey", C.diet(F.lit(None).cast("string"), t).alias("diet"), F.array_join(C.allergen_tags(F.array().cast("array<string>"), t), ",").alias("allergens"),
        F.array_join(C.dish_types(t), ",").alias("dish_types"), C.dish_family(t).alias("family"), C.cost_tier(F.lit(None).cast("string"), t).alias("cost"),
    )
    return rows


@query("""
WITH t AS (SELECT DISTINCT p_name AS n, list_distinct(string_split(p_name, ' ')) AS w FROM part), p AS (SELECT a.n AS a, b.n AS b, len(list_intersect(a.w, b.w)) / greatest(len(a.w), len(b.w)) AS similarity FROM t a JOIN t b ON a.n < b.n)
SELECT a, b, round(similarity, 6) AS similarity, CASE WHEN similarity >= 0.9 THEN 'duplicate' WHEN similarity >= 0.5 THEN 'variation' ELSE 'new' END AS class FROM p WHERE similarity >= 0.5
""")
def title_similarity_pairs(spark, sf):
    pairs = C.similar_titles(table(spark, sf, "part").select(F.col("p_name").alias("title")))
    return pairs.select("a", "b", F.round("similarity", 6).alias("similarity"), C.duplicate_class(F.col("similarity")).alias("class"))


LINES = [
    ("1½ cup rolled oats", "rolled oats"), ("2 to 3 (1 gram) bay leaves", "bay leaves"), ("300g All-purpose flour (maida)", "flour"), ("6 to 8 oz sliced white mushrooms", "mushrooms"),
    ("2-3 cloves (laung)", "cloves"), ("1 cup milk", "milk"), ("1 tsp unknown spice", "spice"), ("salt as needed", "salt"), ("3/4 cup red onion", "onion"), ("400 g chicken", "chicken"),
]


def example_records(spark) -> DataFrame:
    rows = [
        (1, "Gujarati Dhokla", "en", [LINES[0][0], LINES[5][0], LINES[6][0]], ["Mix.", "Steam."], "https://a.example.com/1"),
        (2, "Hyderabadi Bagara Rice", "en", [LINES[2][0], LINES[4][0]], ["Cook."], "https://a.example.com/2"),
        (3, "Plain Dosa", "english", [LINES[8][0]], ["Spread.", "Bake."], ""),
        (4, "Chicken Curry", None, [LINES[9][0], LINES[3][0], LINES[7][0]], [], "https://a.example.com/4"),
        (5, "रसम", "ta", [LINES[1][0], LINES[5][0]], ["Boil."], None),
    ]
    return spark.createDataFrame(rows, "id int, title string, language string, lines array<string>, steps array<string>, source_url string")


def processed(spark, records: DataFrame) -> DataFrame:
    """The record pipeline: parse, resolve, convert, classify, fingerprint, judge."""
    items = records.select("id", F.posexplode("lines").alias("pos", "line")).withColumn("p", parse_line(F.col("line"))).select("id", "pos", "line", "p.*")
    masters = spark.createDataFrame([(m,) for m in ("rolled_oats", "milk", "bay_leaves", "chicken", "red_onion", "all_purpose_flour")], "canonical string")
    known = R.resolve(items, spark.createDataFrame([], "alias string, canonical string"), masters, static=R.alias_table(spark))
    converted = U.normalise(known)
    item = F.struct(
        "pos", "name", "quantity", "unit", "canonical", "canonical_quantity", "canonical_unit", F.col("method").alias("conversion_method"), F.col("confidence").alias("resolution_confidence"), "uom_confidence",
        F.array_union("uom_flags", F.when(F.col("tier") == "unresolved", F.array(F.lit("unresolved_ingredient"))).otherwise(F.array().cast("array<string>"))).alias("flags"),
        C.allergen_tags(F.array().cast("array<string>"), F.lower("name")).alias("allergen_flags"),
    )
    grouped = converted.groupBy("id").agg(F.array_sort(F.collect_list(item)).alias("ingredients"))
    rows = records.drop("lines").join(grouped, "id", "left").withColumn("ingredients", F.coalesce("ingredients", F.expr("array()")))
    rows = C.classify_place(rows, F.concat_ws(" ", "title", "source_url"))
    rows = C.enrich(rows, F.concat_ws(" ", "title", F.array_join(F.transform("ingredients", lambda i: i["name"]), " ")), F.size("steps"), F.size("ingredients"), F.lit(None).cast("int"))
    rows = V.fingerprints(rows)
    rows = rows.withColumns({"kcal": F.lit(None).cast("double"), "images": F.array().cast("array<string>"), "duplicate_score": F.lit(None).cast("double"), "canonical_id": F.lit(None).cast("int"), "known": F.lit(False)})
    return V.judge(rows, V.checks())


@query("""
WITH e(i, state, region, family) AS (VALUES (1, 'Gujarat', 'West', NULL), (2, 'Telangana', 'South', NULL), (3, NULL, 'South', 'dosa'), (4, NULL, NULL, 'curry'), (5, NULL, NULL, NULL)),
c(i, codes, status) AS (VALUES (1, 'V08,V11', 'ACCEPTED'), (2, 'V11', 'ACCEPTED'), (3, 'V02,V11', 'REJECTED'), (4, 'V01,V03,V08,V11', 'REJECTED'), (5, 'V10,V11', 'ACCEPTED'))
SELECT o_orderkey AS id, state, region, family AS dish_family, codes AS failure_codes, status, q AS first_quantity FROM (
  SELECT o_orderkey, o_orderkey % 5 + 1 AS k, CASE o_orderkey % 5 WHEN 0 THEN 80.0 * (o_custkey % 9 + 1) WHEN 1 THEN o_custkey % 9 + 1.0 WHEN 2 THEN 160.0 * (o_custkey % 9 + 1) WHEN 3 THEN o_custkey % 9 + 1.0 ELSE 240.0 * (o_custkey % 9 + 1) END AS q FROM orders
) JOIN e ON e.i = k JOIN c ON c.i = k
""")
def record_pipeline(spark, sf):
    """Every order as a record: its lines parsed, resolved, converted, classified and judged."""
    n = (F.col("o_custkey") % 9 + 1).cast("string")
    first = [" cup rolled oats", " g all-purpose flour (maida)", " cup red onion", " g chicken", " cup milk"]
    rest = ["1 tsp unknown spice", "2-3 cloves (laung)", None, "salt as needed", "1 bay leaf"]
    titles, urls, steps = ["Gujarati Dhokla", "Hyderabadi Bagara Rice", "Plain Dosa", "Chicken Curry", "रसम"], ["u/1", "u/2", "", "u/4", None], [["Mix.", "Steam."], ["Cook."], ["Spread.", "Bake."], [], ["Boil."]]
    k = F.col("o_orderkey") % 5
    of = lambda xs: F.coalesce(*[F.when(k == i, x) for i, x in enumerate(xs) if x is not None])
    lists = [F.array(*[F.lit(x) for x in s]).cast("array<string>") for s in steps]
    records = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), of([F.lit(t) for t in titles]).alias("title"), F.lit("en").alias("language"), F.array_compact(F.array(F.concat(n, of([F.lit(x) for x in first])), of([None if x is None else F.lit(x) for x in rest]))).alias("lines"),
        of(lists).alias("steps"), F.concat(of([None if u is None else F.lit(u) for u in urls]), F.col("o_orderkey").cast("string")).alias("source_url"),
    )
    rows = processed(spark, records)
    return rows.select("id", "state", "region", "dish_family", F.array_join("failure_codes", ",").alias("failure_codes"), "status", F.col("ingredients")[0]["canonical_quantity"].alias("first_quantity"))


KNOWN_LINES = [
    # a line's frame -> quantity's factor and offset, unit and name, given by hand
    ("{n} cup rolled oats", 1.0, 0.0, "cup", "rolled oats"), ("{n} to 20 (1 gram) bay leaves", 0.5, 10.0, None, "bay leaves"), ("{n}g All-purpose flour (maida)", 1.0, 0.0, "g", "All-purpose flour"),
    ("{n}½ oz sliced white mushrooms", 1.0, 0.5, "oz", "white mushrooms"), ("{n} + 1/2 tsp fresh ginger, chopped", 1.0, 0.5, "tsp", "ginger"), ("2-{n} cloves (laung)", 0.5, 1.0, "cloves", "cloves"),
    ("salt as needed", 0.0, None, None, "salt as needed"), ("{n} 1/4 Cups milk or water", 1.0, 0.25, "cups", "milk"),
]


@query(f"""
WITH k(i, f, o, unit, name) AS (VALUES {", ".join(f"({i}, {f}, {'NULL' if o is None else o}, {'NULL' if u is None else repr(u)}, '{n}')" for i, (_, f, o, u, n) in enumerate(KNOWN_LINES))})
SELECT l_orderkey, l_linenumber, CAST(f * CAST(l_quantity AS INT) + o AS DOUBLE) AS quantity, unit, name FROM lineitem JOIN k ON i = (l_orderkey + l_linenumber) % {len(KNOWN_LINES)}
""")
def ingredient_lines(spark, sf):
    """Quantity, unit and name of a line made for every row of lineitem; each distinct line is parsed once."""
    n, at = F.col("l_quantity").cast("int").cast("string"), (F.col("l_orderkey") + F.col("l_linenumber")) % len(KNOWN_LINES)
    text = F.coalesce(*[F.when(at == i, F.replace(F.lit(x), F.lit("{n}"), n)) for i, (x, *_) in enumerate(KNOWN_LINES)])
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.alias("line"))
    parsed = rows.select("line").distinct().select("line", parse_line(F.col("line")).alias("p"))
    return rows.join(parsed, "line").select("l_orderkey", "l_linenumber", "p.quantity", "p.unit", "p.name")


@query("""
WITH k(s, r, w) AS (VALUES ('Gujarat', 'West', 'dhokla'), ('Kerala', 'South', 'appam'), ('Punjab', 'North', 'butter chicken'))
SELECT o_orderkey, s AS state, coalesce(r, CASE WHEN contains(t, 'dosa') THEN 'South' WHEN contains(t, 'poha') THEN 'West' WHEN contains(t, 'fish curry') THEN 'East' END) AS region,
  CASE WHEN s IS NOT NULL THEN 'state_keyword' WHEN contains(t, 'dosa') OR contains(t, 'poha') OR contains(t, 'fish curry') THEN 'regional_keyword' ELSE 'unclassified' END AS method
FROM (SELECT o_orderkey, list_extract(['dhokla', 'appam stew', 'butter chicken curry', 'poha', 'kheer', 'fish curry', 'plain dosa'], CAST(o_orderkey % 7 + 1 AS INT)) AS t FROM orders) LEFT JOIN k ON contains(t, w)
""")
def place_classifier(spark, sf):
    dishes = ["dhokla", "appam stew", "butter chicken curry", "poha", "kheer", "fish curry", "plain dosa"]
    rows = table(spark, sf, "orders").select("o_orderkey", F.element_at(F.array(*[F.lit(x) for x in dishes]), (F.col("o_orderkey") % 7 + 1).cast("int")).alias("t"))
    return C.classify_place(rows, F.col("t")).select("o_orderkey", "state", "region", F.col("state_method").alias("method"))
