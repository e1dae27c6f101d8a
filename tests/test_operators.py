"""Known results of the operators on small tables."""

import json

from pyspark.sql import functions as F

from pantrylake.operators import classify as C
from pantrylake.operators import resolve as R
from pantrylake.operators import units as U
from pantrylake.operators import upsert as P
from pantrylake.operators import validate as V
from pantrylake.operators import vectors as X
from pantrylake.operators.coerce import Mapping, accepted_and_dead, choose, coerce
from pantrylake.operators.metrics import safe_rate
from pantrylake.plans.domain import example_records, processed
from pantrylake.sources import readers as S
from pantrylake.streaming import alerts as A


def test_units(spark):
    rows = [
        ("flour", "1", "cup"), ("milk", "1", "cup"), ("paneer", "2", "oz"), ("spinach", "1", "handful"), ("xyz", "1", "ladle"), ("green chili", "2", None),
        ("unknown spice", "1", "tsp"), ("red onion", "3/4", "cup"), ("salt", None, "to taste"), ("rice", None, "cup"),
    ]
    got = {r["name"]: r for r in U.normalise(spark.createDataFrame(rows, "name string, quantity string, unit string")).collect()}
    want = {
        "flour": (120, "g", "density_lookup"), "milk": (240, "ml", "volume_standard"), "paneer": (56.7, "g", "weight_standard"), "spinach": (30, "g", "colloquial_estimate"),
        "xyz": (None, None, "unknown"), "green chili": (2, "count", "count_inferred"), "unknown spice": (2.5, "g", "estimated_density_lookup"), "red onion": (120, "g", "density_lookup"),
        "salt": (None, None, "unquantified"), "rice": (None, None, "unknown"),
    }
    for n, w in want.items():
        assert (got[n]["canonical_quantity"], got[n]["canonical_unit"], got[n]["method"]) == w, n
    assert got["flour"]["conversion_factor"] == 120 and got["spinach"]["uom_flags"] == ["colloquial_unit"] and got["xyz"]["uom_flags"] == ["unit_unresolved"]


def test_resolution(spark):
    names = ["atta", "kadala", "  GEHUN-KA   ATTA  ", "2 cloves ((optional))", "Salt as needed", "to 2 cups water", "medium tomatoes", "rolled oats", "not a real ingredient", None, ""]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r["name"]: (r["canonical"], r["tier"]) for r in R.resolve(df, spark.createDataFrame([], "alias string, canonical string"), spark.createDataFrame([("rolled_oats",)], "canonical string"), static=R.alias_table(spark)).collect()}
    want = ["whole_wheat_flour", "chickpea", "whole_wheat_flour", "clove", "salt", "water", "tomato", "rolled_oats", None, None, None]
    assert [got[n][0] for n in names] == want
    assert got["rolled oats"][1] == "canonical" and got["atta"][1] == "alias" and got[None][1] == "unresolved"
    asked = R.with_model(R.resolve(df, R.alias_table(spark), spark.createDataFrame([], "canonical string")), lambda xs: [("Mystery Root", 1.7) for _ in xs])
    one = asked.filter("name = 'not a real ingredient'").first()
    assert (one["canonical"], one["tier"], one["confidence"], one["needs_review"]) == ("mystery_root", "model", 1.0, True)
    learnt = R.learn_aliases(R.alias_table(spark), spark.createDataFrame([("Atta", "flour", None), ("new", "x", None)], "alias string, canonical string, at timestamp"))
    got = {r["alias"]: r["canonical"] for r in learnt.collect()}
    assert got["atta"] == "flour" and got["new"] == "x" and got["salt"] == "salt"


def test_places(spark):
    df = spark.createDataFrame([("Gujarati Dhokla", None), ("Hyderabadi Bagara Rice", None), ("x", "Kerala"), ("Plain Dosa", None), ("Soup", None)], "t string, s string")
    got = [(r["state"], r["region"], r["state_method"], r["state_confidence"]) for r in C.classify_place(df, F.col("t"), F.col("s")).collect()]
    assert got == [
        ("Gujarat", "West", "state_keyword", 0.95), ("Telangana", "South", "state_keyword", 0.95), ("Kerala", "South", "provided_state", 1.0), (None, "South", "regional_keyword", 0.45), (None, None, "unclassified", 0.0)
    ]


def test_rules(spark):
    df = spark.createDataFrame([("Egg Pulao with basmati rice", 40, 5, 9), ("Mutton Biryani", 120, 9, 15), ("plain greens", None, 3, 3)], "t string, total int, steps int, items int")
    a, b, c = C.enrich(df, F.col("t"), F.col("steps"), F.col("items"), F.col("total")).collect()
    assert a["diet"] == "egg" and "EGG" in a["allergen_tags"] and "HIGH_PROTEIN" in a["health_tags"] and a["dish_family"] == "pulao" and a["meal_role"] == "complete_meal" and a["difficulty_level"] == "MEDIUM"
    assert b["diet"] == "non_vegetarian" and b["dish_family"] == "biryani" and b["cost_tier"] == "PREMIUM" and "MEAL_PREP" in b["efficiency_tags"]
    assert c["diet"] is None and c["difficulty_level"] == "EASY" and c["cost_tier"] == "MID_RANGE"
    d = spark.range(1).select(C.canonical_diet(F.lit("Non Vegeterian")).alias("a"), C.canonical_diet(F.lit("Diabetic Friendly")).alias("b"), C.canonical_diet(F.lit("High Fibre")).alias("c")).first()
    assert tuple(d) == ("non_vegetarian", "diabetic_friendly", "high_fibre")


def test_titles(spark):
    a = C.title_words(F.lit("Paneer Butter Masala"))
    got = [
        spark.range(1).select(C.duplicate_class(C.title_similarity(a, C.title_words(F.lit(t))))).first()[0]
        for t in ("Paneer Butter Masala Recipe", "Restaurant Style Paneer Butter Masala", "Chicken Biryani", "Paneer Butter Curry", "Easy Recipe")
    ]
    assert got == ["duplicate", "duplicate", "new", "variation", "new"]


ITEM = "struct<name:string,canonical:string,quantity:double,unit:string,canonical_quantity:double,canonical_unit:string,conversion_method:string,resolution_confidence:double,uom_confidence:double,flags:array<string>,allergen_flags:array<string>>"
RECORD = f"title string, ingredients array<{ITEM}>, steps array<string>, allergen_tags array<string>, health_tags array<string>, kcal double, language string, images array<string>, duplicate_score double, canonical_id int, known boolean"


def record(**change):
    item = lambda n, **c: tuple({"name": n, "canonical": None, "quantity": 1.0, "unit": "g", "canonical_quantity": 1.0, "canonical_unit": "g", "conversion_method": "weight_standard", "resolution_confidence": 1.0, "uom_confidence": 1.0, "flags": [], "allergen_flags": ["DAIRY"]} | c for _ in [0])[0]
    base = {"title": "Dal fry", "ingredients": [item("dal"), item("ghee")], "steps": ["Boil.", "Fry."], "allergen_tags": ["DAIRY"], "health_tags": [], "kcal": 200.0, "language": "en", "images": ["a.jpg"], "duplicate_score": None, "canonical_id": None, "known": False}
    got = base | change
    if "items" in got:
        got["ingredients"] = [item(n, **c) for n, c in got.pop("items")]
    return got


def test_checks(spark):
    rows = [
        (record(), "ACCEPTED", ""), (record(steps=[]), "REJECTED", "V01,V03"), (record(items=[("dal", {})]), "REJECTED", "V02"), (record(known=True), "REJECTED", "V09"),
        (record(title="रसम कढ़ी"), "ACCEPTED", "V10"), (record(images=[]), "ACCEPTED", "V11"), (record(items=[("dal", {}), ("oil", {"flags": ["uom_conflict"]})]), "REVIEW", "V06"),
        (record(items=[("dal", {"canonical_quantity": 0.0}), ("ghee", {})]), "REVIEW", "V04"), (record(allergen_tags=["SOY"]), "REVIEW", "V05"), (record(kcal=9000.0), "ACCEPTED", "V07"),
        (record(health_tags=["NUT_FREE"], items=[("peanut", {}), ("salt", {})]), "REVIEW", "V05"), (record(health_tags=["NUT_FREE"], items=[("pistachio", {}), ("peanut oil", {})]), "ACCEPTED", ""), (record(health_tags=["nut-free"], items=[("kaju", {"canonical": "Cashews"}), ("dal", {})]), "REVIEW", "V05"),
        (record(items=[("dahi", {"canonical": "yogurt", "canonical_unit": "ml"}), ("dal", {})]), "ACCEPTED", ""), (record(items=[("milk", {"canonical": "rice", "canonical_unit": "ml"}), ("dal", {})]), "REVIEW", "V06"),
        (record(kcal=1.0, language="fr", items=[("a", {"uom_confidence": 0.1}), ("b", {})]), "REVIEW", "V07,V08,V10"),
        (record(duplicate_score=0.97), "REJECTED", "V09"), (record(title=None, steps=["a", " "]), "REJECTED", "V01,V03"),
    ]
    df = spark.createDataFrame([r for r, _, _ in rows], RECORD)
    for got, (_, status, codes) in zip(V.judge(df, V.checks()).collect(), rows, strict=True):
        assert (got["status"], ",".join(got["failure_codes"])) == (status, codes)
    judged = V.judge(df, V.checks({"V01", "V02"}))
    assert len(judged.first()["results"]) == 2
    k = V.kpis(V.judge(df, V.checks())).first()
    assert k["total"] == len(rows) and k["accepted_critical"] == 0


def test_fingerprints(spark):
    df = spark.createDataFrame([record() | {"source_url": "https://A.org "}, record(steps=["Boil.", "Bake."]) | {"source_url": "https://a.org"}, record() | {"source_url": None}], RECORD + ", source_url string")
    a, b, c = V.fingerprints(df).collect()
    assert a["content_hash"] != b["content_hash"] and a["source_url_hash"] == b["source_url_hash"] and c["source_url_hash"] is None


def test_record_pipeline(spark):
    got = {r["id"]: r for r in processed(spark, example_records(spark)).collect()}
    assert got[1]["state"] == "Gujarat" and got[2]["state"] == "Telangana" and got[3]["region"] == "South"
    assert got[4]["status"] == "REJECTED" and "V03" in got[4]["failure_codes"] and "V02" in got[3]["failure_codes"] and "V10" in got[5]["failure_codes"]
    assert got[1]["ingredients"][0]["canonical_quantity"] == 120 and got[1]["ingredients"][0]["canonical"] == "rolled_oats"


def test_upserts(spark):
    t = spark.createDataFrame([(1, "a", ["x"]), (2, "b", [])], "k int, v string, w array<string>")
    s = spark.createDataFrame([(1, "", ["y"]), (3, "c", [])], "k int, v string, w array<string>")
    got = {r["k"]: (r["v"], r["w"], r["inserted"]) for r in P.merge_nonempty(t, s, ["k"]).collect()}
    assert got == {1: ("a", ["y"], False), 2: ("b", [], False), 3: ("c", None, True)}
    assert P.replace_children(t, s.filter("k = 1"), "k").count() == 2
    assert sorted(r["k"] for r in P.insert_absent(t, s.unionByName(s), "k").collect()) == [3]
    m = spark.range(1).select(P.merge_maps(F.expr("map('a', '1', 'b', '2')"), F.expr("map('b', '3')")).alias("m")).first()["m"]
    assert m == {"a": "1", "b": "3"}
    assert P.cascade_delete({"t": t, "u": spark.range(2)}, s.select("k"), "k")["t"].count() == 1
    assert spark.range(1).select(safe_rate(F.lit(3), F.lit(4)), safe_rate(F.lit(5), F.lit(0))).first()[:] == (0.75, 0.0)


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.9, 0.1, 0.0]), (3, [0.0, 0.0, 0.0]), (4, [0.0, 1.0, 0.0])], "vec_id int, embedding array<double>")
    assert [r["vec_id"] for r in X.top_k(df, [1.0, 0.0, 0.0], 2).collect()] == [1, 2]
    near = X.knn(df.filter("vec_id = 1"), df.withColumnRenamed("vec_id", "o"), 2, "vec_id", "o").orderBy("rank").collect()
    assert [r["o"] for r in near] == [1, 2]
    assert X.knn(df.limit(0), df.withColumnRenamed("vec_id", "o"), 2, "vec_id", "o").count() == 0
    assert {(r["vec_id"], r["other"]) for r in X.lsh_neighbours(df.filter("vec_id < 3"), "vec_id", 1, planes=2, dim=3).collect()} == {(1, 2), (2, 1)}


def test_sources(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "a.csv").write_text('title,ingredients,steps\n"Dal","rice, ""dal""","Wash it, then boil.|Serve."\nRasam,,\n')
    raw = S.read_csv(spark, str(tmp_path / "csv"), "s1")
    ok, dead = accepted_and_dead(coerce(raw, choose([Mapping("s1", keys={"title": ["name", "title"]})], "s1", "csv")))
    r = ok.collect()
    assert len(r) == 1 and r[0]["steps"] == ["Wash it, then boil.", "Serve."] and r[0]["ingredients"] == ["rice", '"dal"']
    d = dead.collect()
    assert len(d) == 1 and d[0]["error"] == "missing_ingredients" and json.loads(d[0]["payload"])["title"] == "Rasam"
    assert {x["record_id"] for x in raw.collect()} == {x["record_id"] for x in S.read_csv(spark, str(tmp_path / "csv"), "s1").collect()}
    (tmp_path / "txt").mkdir()
    (tmp_path / "txt" / "r.txt").write_text("\nTomato Rasam\nIngredients:\n1 tomato\nInstructions:\nBoil.\n")
    t = S.read_text(spark, str(tmp_path / "txt"), "s2").select(F.variant_get("raw_content", "$.title", "string"), F.variant_get("raw_content", "$.steps[0]", "string")).first()
    assert tuple(t) == ("Tomato Rasam", "Boil.")
    (tmp_path / "pdf").mkdir()
    (tmp_path / "pdf" / "x.pdf").write_bytes(b"%PDF")
    (tmp_path / "pdf" / "x.txt").write_text("Coconut Rice\n")
    (tmp_path / "pdf" / "y.pdf").write_bytes(b"%PDF")
    m = {r[0]: r[1] for r in S.read_media(spark, str(tmp_path / "pdf"), "s3", "pdf").select(F.variant_get("raw_content", "$.title", "string"), F.variant_get("metadata", "$.flags[0]", "string")).collect()}
    assert m == {"Coconut Rice": None, None: "pdf_ocr_required"}
    df, runs = S.run_all(spark, [{"id": "a", "kind": "text", "path": str(tmp_path / "txt")}, {"id": "b", "kind": "csv", "path": str(tmp_path / "none")}])
    assert df.count() == 1 and [r["status"] for r in runs] == ["ok", "failed"]
    pages = spark.createDataFrame([("http://x.org", "<title>T</title><p>hi</p>")], "url string, html string")
    assert S.read_pages(pages, "w").select(F.variant_get("raw_content", "$.text", "string")).first()[0] == "hi"
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text('{"name": "A", "x": null}\nnot json\n')
    got = S.read_json(spark, str(tmp_path / "j"), "s4").select(F.variant_get("raw_content", "$.name", "string"), F.variant_get("raw_content", "$.unparsed", "string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([("A", None), (None, "not json")], key=str)


def test_streams(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i:02d}:00", "k" if i < 6 else "m") for i in range(10)] + [(0, "2024-01-01 00:00:00", "k"), (99, "2024-01-01 09:00:00", "z")]
    spark.createDataFrame(rows, "id int, t string, k string").selectExpr("id", "to_timestamp(t) AS ts", "k").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("id int, ts timestamp, k string").parquet(str(tmp_path / "in"))
    q = A.deduplicated(stream(), "id").writeStream.format("memory").queryName("d").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(120)
    assert spark.table("d").count() == 11
    q = A.running_summary(stream(), "k", "id").writeStream.outputMode("update").format("memory").queryName("s").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination(120)
    assert {r["k"]: r["n"] for r in spark.table("s").collect()} == {"k": 7, "m": 4, "z": 1}
    A.write_idempotent(stream(), str(tmp_path / "out"), str(tmp_path / "c3")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 12
    windows = A.failure_windows(spark.read.parquet(str(tmp_path / "in")))
    assert windows.agg(F.max("n")).first()[0] == 11
    said = []
    assert A.notify(windows, said.append) == windows.count() and "critical failures" in said[0]


def test_text_queries_take_every_document(spark, tmp_path):
    import html

    from pantrylake.plans.catalogue import queries

    long = "alpha beta, gamma " * 40
    texts = {1: "Tom &amp; Jerry &lt;b&gt;  &eacute;", 2: '["a, b", " c ", ""]', 3: long, 4: "[not json, x", 5: "Ein langer Satz hier. Und noch ein langer Satz.", 6: None, 7: "x | y\nz, w"}
    lang = {1: "en", 2: None, 3: "en", 4: "fr", 5: "de", 6: "de", 7: None}
    rows = [(i, t, lang[i], "s", None if t is None else len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: queries()[name](spark, str(tmp_path)).collect()

    want = {i: None if t is None else " ".join(html.unescape(t).split()) for i, t in texts.items()}
    assert {r["doc_id"]: r["flat"] for r in run("clean_text_documents")} == want

    parts = {1: [texts[1]], 2: ["a, b", "c"], 3: [x.strip() for x in long.split(",")], 4: ["[not json", "x"], 5: [texts[5]], 7: ["x", "y", "z, w"]}
    got = {}
    for r in sorted(run("listify_explode"), key=lambda r: (r["doc_id"], r["pos"])):
        got.setdefault(r["doc_id"], []).append(r["part"])
    assert got == {i: [x for x in p if x] for i, p in parts.items()}

    steps = {r["doc_id"]: r["n_sentences"] for r in run("sentence_steps")}
    assert set(steps) == set(texts) and steps[5] == 2 and steps[3] == 1


def test_relational_queries_take_whole_tables(spark, tmp_path):
    from pantrylake.plans.catalogue import queries

    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    put("customer", [(i, f"c{i}", 1.0) for i in range(1, 6)], "c_custkey bigint, c_name string, c_acctbal double")
    put("orders", [(1, 3, "F", "p", 10.0), (2, 3, "O", "p", 30.0), (5, 9, "O", "p", 7.0), (8, 9, "O", "p", 1.0), (97, 4, "O", "p", 2.0)], "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderpriority string, o_totalprice double")
    put("lineitem", [(1, 7, 1, 2, 3.0), (1, 8, 1, 1, 4.0), (11, 7, 1, 1, 5.0)], "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double")
    put("part", [(7, "bolt")], "p_partkey bigint, p_name string")
    run = lambda name: {tuple(r) for r in queries()[name](spark, str(tmp_path)).collect()}
    assert run("detail_nested") == {(1, 2, "? x4; bolt x3"), (2, 0, ""), (5, 0, ""), (8, 0, ""), (97, 0, "")}
    assert run("full_outer") == {(1, True), (2, False), (5, False), (8, False), (97, False), (None, True)}
    assert run("cond_merge_update") == {(1, "c1", 1.0, False), (2, "c2", 1.0, False), (3, "p 3", 30.0, False), (4, "c4", 2.0, False), (5, "c5", 1.0, False), (9, None, 7.0, True)}
    assert run("upsert_merge") == {(1, "h2", 40.0, "update"), (5, "h8", 8.0, "update"), (None, "h97", 2.0, "insert")}


def test_conversations_are_read_whole(spark, tmp_path):
    from pantrylake.plans.catalogue import queries

    text = " ".join(f"word{i}" for i in range(60)) + "\nassistant: not a marker"
    spark.createDataFrame([(1, 1, "user", text), (1, 2, "assistant", "yes")], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries()["conversation_context"](spark, str(tmp_path)).first()["context"] == f"[1] user: {text}\n[2] assistant: yes"
    assert tuple(queries()["section_lines"](spark, str(tmp_path)).first()) == (1, True, 1)


def test_neighbours_among_all_others(spark, tmp_path):
    from pantrylake.plans.catalogue import queries

    rows = [(0, [1.0, 0.0], 1), (51, [1.0, 0.01], 1), (2, [0.9, 0.1], 1), (50, [0.0, 1.0], 1), (3, [0.0, 1.0], 2), (100, [-1.0, -1.0], 3), (7, [1.0, 1.0], None), (150, [1.0, 1.0], None)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    best = {r["vec_id"]: r["other"] for r in queries()["knn_threshold"](spark, str(tmp_path)).collect()}
    assert best == {0: 51, 50: 3, 150: 7}  # an odd id, an id below the query's, and none for 100
    got = {(r["vec_id"], r["other"]): r["rank"] for r in queries()["label_pair_similarity"](spark, str(tmp_path)).collect()}
    assert got == {(0, 51): 1, (0, 2): 2, (0, 50): 3, (50, 2): 1, (50, 51): 2, (50, 0): 3}
