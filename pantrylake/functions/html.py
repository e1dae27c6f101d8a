"""Parts of HTML pages by the standard parser, Arrow-batched."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

HIDDEN = {"script", "style", "noscript", "template", "head"}
BREAKS = {"p", "div", "br", "li", "ul", "ol", "tr", "table", "section", "article", "header", "footer", "nav", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote"}


class Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.out, self.links, self.data, self.items = "", [], [], [], []
        self.inside: list[str] = []
        self.kind = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in HIDDEN or tag == "title":
            self.inside.append(tag)
            self.kind = a.get("type") if tag == "script" else None
            if tag == "script":
                self.data.append("")
        if tag == "a" and a.get("href"):
            self.links.append(a["href"])
        if tag in BREAKS:
            self.out.append("\n")
        if tag == "li":
            self.items.append(len(self.out))

    def handle_endtag(self, tag):
        if tag in self.inside:
            while self.inside and self.inside.pop() != tag:
                pass
        if tag == "script" and self.kind != "application/ld+json" and self.data:
            self.data.pop()
        if tag in BREAKS:
            self.out.append("\n")

    def handle_data(self, text):
        if self.inside and self.inside[-1] == "title":
            self.title += text
        elif self.inside and self.inside[-1] == "script":
            self.data[-1] += text
        elif not set(self.inside) & HIDDEN:
            self.out.append(text)


def nodes(x):
    """All objects of a JSON-LD value, through lists and @graph."""
    if isinstance(x, list):
        for y in x:
            yield from nodes(y)
    elif isinstance(x, dict):
        yield x
        for k in ("@graph", "mainEntity", "itemListElement", "mainEntityOfPage"):
            if isinstance(x.get(k), (list, dict)):
                yield from nodes(x[k])


def steps_of(x) -> list[str]:
    """Instructions as flat lines: texts, steps, and sections of steps."""
    if isinstance(x, str):
        return [s.strip() for s in x.split("\n") if s.strip()]
    if isinstance(x, list):
        return [s for y in x for s in steps_of(y)]
    if isinstance(x, dict):
        return steps_of(x["itemListElement"]) if "itemListElement" in x else steps_of(x.get("text") or x.get("name") or "")
    return []


def strings(x) -> list[str]:
    if isinstance(x, str):
        return [x]
    if isinstance(x, dict):
        return strings(x.get("url") or x.get("name") or x.get("@id") or [])
    return [s for y in x or [] for s in strings(y)] if isinstance(x, (list, tuple)) else []


def recipe_of(x: dict) -> dict:
    n = x.get("nutrition") if isinstance(x.get("nutrition"), dict) else {}
    text = lambda v: strings(v)[0] if strings(v) else None
    return {
        "name": text(x.get("name")), "description": text(x.get("description")), "ingredients": strings(x.get("recipeIngredient") or x.get("ingredients")), "steps": steps_of(x.get("recipeInstructions")),
        "images": strings(x.get("image")), "prep": text(x.get("prepTime")), "cook": text(x.get("cookTime")), "total": text(x.get("totalTime")), "recipe_yield": text(x.get("recipeYield")),
        "nutrition": {k: str(v) for k, v in n.items() if not k.startswith("@")},
    }


RECIPE = T.StructType(
    [T.StructField(k, T.StringType()) for k in ("name", "description")]
    + [T.StructField(k, T.ArrayType(T.StringType())) for k in ("ingredients", "steps", "images")]
    + [T.StructField(k, T.StringType()) for k in ("prep", "cook", "total", "recipe_yield")]
    + [T.StructField("nutrition", T.MapType(T.StringType(), T.StringType()))]
)
PARTS = T.StructType(
    [T.StructField("title", T.StringType()), T.StructField("text", T.StringType()), T.StructField("links", T.ArrayType(T.StringType())), T.StructField("recipes", T.ArrayType(RECIPE))]
)


def parts(html: str | None) -> dict:
    r = Reader()
    r.feed(html or "")
    r.close()
    lines = (" ".join(s.split()) for s in "".join(r.out).split("\n"))
    found = []
    for d in r.data:
        try:
            found += [recipe_of(x) for x in nodes(json.loads(d, strict=False)) if "Recipe" in strings(x.get("@type"))]
        except (ValueError, RecursionError):
            continue
    return {"title": " ".join(r.title.split()), "text": "\n".join(s for s in lines if s), "links": r.links, "recipes": found}


@F.pandas_udf(PARTS)
def _parts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for v in batches:
        yield pd.DataFrame([parts(x) for x in v], columns=["title", "text", "links", "recipes"])


def page_parts(c: Column) -> Column:
    """title, visible text, links and JSON-LD recipes of a page."""
    return _parts(c)
