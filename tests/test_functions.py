"""Known results of the scalar functions."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pantrylake.functions import quantity as Q
from pantrylake.functions import text as T
from pantrylake.functions.html import parts
from pantrylake.sources.readers import follow

LINES = [
    ("1½ cup rolled oats", (1.5, "cup", "rolled oats")),
    ("2 to 3 (1 gram) bay leaves", (2.5, None, "bay leaves")),
    ("1 cup grated coconut (fresh or frozen)", (1, "cup", "coconut")),
    ("6 to 8 oz sliced white mushrooms", (7, "oz", "white mushrooms")),
    ("300g All-purpose flour (maida)", (300, "g", "All-purpose flour")),
    ("4piece Eggs", (4, "piece", "Eggs")),
    ('1" ginger (peeled)', (1, "inch", "ginger")),
    ("2-3 cloves (laung)", (2.5, "cloves", "cloves")),
    ("180gm maida / plain flour", (180, "gm", "maida plain flour")),
    ("3 tablespoons (warm water)", (3, "tablespoons", "warm water")),
    ("1-inch piece of cinnamon stick (dalchini)", (1, "inch", "piece of cinnamon stick")),
    ("3/4+1/4 Hung Curd (Greek Yogurt)", (1, None, "Hung Curd")),
    ("1 cup (150 grams or 2 medium-sized tomatoes (- chopped)", (1, "cup", "tomatoes")),
    (None, (None, None, None)),
    ("", (None, None, "")),
]


@pytest.mark.parametrize("line, want", LINES)
def test_line(line, want):
    assert Q.line(line) == want


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_line_never_raises(s):
    Q.line(s)


@given(st.text(max_size=80))
@settings(max_examples=200, deadline=None)
def test_clean_is_stable_on_plain_text(s):
    once = T.cleaned(s.replace("&", "").translate({ord(c): None for c in T.MOJIBAKE}))
    assert T.cleaned(once) == once


def test_clean():
    assert T.cleaned(" fry &amp; serve&nbsp; hot ") == "fry & serve hot"
    assert T.cleaned("sautÃ© onions") == "sauté onions"
    assert T.cleaned(None) is None
    assert Q.amount("1/0") is None


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first().asDict()


def test_columns(spark):
    lit = F.lit
    got = one(
        spark,
        clean=T.clean_text(lit(" fry &amp; serve&nbsp; hot ")),
        null=T.clean_text(lit(None).cast("string")),
        tag=T.tag(lit(" gluten-free! ")),
        pipes=T.as_list(lit("a, b| c|")),
        commas=T.as_list(lit("a, b")),
        array=T.as_list(lit('["x", "y, z"]')),
        section=T.section(lit("T\nIngredients:\n a \n\nb\nMethod:\nc"), ["ingredients:"], ["method:"]),
        none=T.section(lit("nothing"), ["ingredients:"], ["method:"]),
        iso=T.minutes(lit("PT1H30M")),
        zero=T.minutes(lit("PT0M")),
        words=T.minutes(lit("2 hours 5 minutes")),
        bare=T.minutes(lit("45")),
        yields=T.first_number(lit("Serves 4 to 6")),
        number=T.number_text(lit(200.0)),
        fraction=T.number_text(lit(1.5)),
        term=T.has_term(lit("a greasy egg."), ["egg", "easy"]),
        inner=T.has_term(lit("eggplant"), ["egg"]),
        prep=T.item_and_prep(lit("onion - finely chopped")),
        merged=T.merged_fragments(F.array(lit("Cook rice well."), lit("Stir."), lit("Serve it warm."))),
        tags=T.distinct_tags(F.array(lit("Egg"), lit("EGG"), lit(" "), lit("soy"))),
        mixed=Q.simple_amount(lit("1 1/2")),
        half=Q.simple_amount(lit("half")),
        title=T.first_line(lit("\n \n Dosa \nx")),
    )
    assert got["clean"] == "fry & serve hot" and got["null"] is None and got["tag"] == "GLUTEN_FREE"
    assert got["pipes"] == ["a, b", "c"] and got["commas"] == ["a", "b"] and got["array"] == ["x", "y, z"]
    assert got["section"] == ["a", "b"] and got["none"] == []
    assert (got["iso"], got["zero"], got["words"], got["bare"], got["yields"]) == (90, None, 125, 45, 4)
    assert got["number"] == "200" and got["fraction"] == "1.5" and got["term"] and not got["inner"]
    assert got["prep"]["item"] == "onion" and got["prep"]["prep"] == "finely chopped"
    assert got["merged"] == ["Cook rice well. Stir.", "Serve it warm."] and got["tags"] == ["EGG", "SOY"]
    assert got["mixed"] == 1.5 and got["half"] == 0.5 and got["title"] == "Dosa"


def test_html_parts():
    page = (
        '<html><head><title> A  b </title><script>var x="</p>";</script><script type="application/ld+json">{"@graph":[{"@type":["Recipe"],"name":"Dal","recipeIngredient":["1 cup dal"],'
        '"recipeInstructions":[{"@type":"HowToSection","itemListElement":[{"text":"Wash."},"Boil."]}],"image":{"url":"i.jpg"},"nutrition":{"@type":"N","calories":"200"}}]}</script></head>'
        '<body><p>One &amp; two</p><a href="/x">go</a><style>p{}</style></body></html>'
    )
    got = parts(page)
    assert got["title"] == "A b" and got["text"] == "One & two\ngo" and got["links"] == ["/x"]
    r = got["recipes"][0]
    assert r["name"] == "Dal" and r["steps"] == ["Wash.", "Boil."] and r["images"] == ["i.jpg"] and r["nutrition"] == {"calories": "200"}
    assert parts(None)["text"] == ""


def test_links(spark):
    rows = spark.createDataFrame([("/a",), ("#x",), ("",), ("mailto:a@b.c",), ("https://x.org/p.PDF",), ("https://x.org/p?f=a.pdf",)], "u string")
    assert [r[0] for r in rows.select(follow(F.col("u"))).collect()] == [True, False, False, False, False, True]
