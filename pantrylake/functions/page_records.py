"""Records of pages that carry no structured data: by classes of elements, by headings, and by labels of nutrition tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pantrylake.functions.fixed import NUTRIENTS

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HEADINGS = {"h2", "h3", "h4"}
SILENT = {"script", "style", "figure", "picture", "img"}

# Where pages keep ingredients and steps: (tag, class, itemprop) of an element, and the tag of its parts.
INGREDIENT_PLACES = [("div", "wprm-recipe-ingredient-group", None, "li"), ("ul", "ingredients", None, "li"), ("li", "ingredient", None, None), (None, None, "recipeIngredient", None)]
STEP_PLACES = [
    ("div", "wprm-recipe-instruction-text", None, None), ("div", "wprm-recipe-instruction-group", None, "li"), ("div", "instructions", None, "li"), ("ol", "steps", None, "li"),
    ("ol", "recipe-instructions", None, "li"), (None, None, "recipeInstructions", "li"), (None, None, "recipeInstructions", None),
]
CARD_PLACES = [
    ("div", "wprm-recipe-instruction-text", None, None), ("li", "wprm-recipe-instruction", None, None), ("ol", "recipe-instructions", None, "li"), ("div", "instructions", None, "li"),
    (None, None, "recipeInstructions", "li"),
]
# Headings of instructions and of other parts, verbs of steps, and phrases that are none.
STEP_HEADINGS = ["how to", "instructions", "method", "directions", "step by step", "photo guide", "preparation"]
STOP_HEADINGS = ["recipe card", "variations", "related", "video", "nutrition", "notes", "comments", "about", "popular", "collections"]
STEP_VERBS = [
    "add", "bake", "blend", "boil", "chop", "cook", "drain", "fry", "grind", "heat", "knead", "mix", "pour", "remove", "rinse", "saute", "sauté", "serve", "simmer", "soak", "sprinkle", "steam",
    "stir", "temper", "turn", "wash", "whisk",
]
PREPARING = ["clean", "discard", "drain", "pat dry", "rinse", "trim", "wash"]
OPENING = ["add", "bake", "blend", "boil", "cook", "fry", "heat", "mix", "pour", "rinse", "soak", "stir"]
NOT_STEPS = [
    "add your own private notes", "here are some dishes", "jump to recipe", "mention @", "prevent sleep mode", "private notes", "related recipes", "tried this recipe", "go well with this",
]


@dataclass
class Node:
    tag: str
    attrs: dict[str, str | None] = field(default_factory=dict)
    parts: list[Node | str] = field(default_factory=list)

    def walk(self) -> Iterator[Node]:
        """This element and all within, in the page's order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [p for p in reversed(node.parts) if isinstance(p, Node)]

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x.strip())
            else:
                stack += reversed(x.parts)
        return " ".join(s for s in out if s)

    def fits(self, tag: str | None, cls: str | None, prop: str | None) -> bool:
        return (tag is None or self.tag == tag) and (cls is None or cls in (self.attrs.get("class") or "").split()) and (prop is None or self.attrs.get("itemprop") == prop)


class Tree(HTMLParser):
    """Elements of a page; an end tag closes all that is open inside its element, a stray one nothing."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag == "li" and self.open[-1].tag == "li":
            self.open.pop()
        node = Node(tag, dict(attrs))
        self.open[-1].parts.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        self.open[-1].parts.append(data)


def found(root: Node, places: list) -> list[Node]:
    """Elements at any of the places, each once, in the page's order."""
    got: dict[int, None] = {}
    order = {id(n): (i, n) for i, n in enumerate(root.walk())}
    for tag, cls, prop, part in places:
        for node in root.walk():
            if node.fits(tag, cls, prop):
                for x in node.walk() if part else [node]:
                    if not part or (x is not node and x.tag == part):
                        got[id(x)] = None
    return [order[i][1] for i in sorted(got, key=lambda i: order[i][0])]


def tidy(text: str) -> str:
    text = re.sub(r"^[•▢▣▪\-\s]+", "", " ".join(text.split()))
    return re.sub(r"(?i)^Prevent Sleep Mode\s*", "", text).strip()


def once(texts) -> list[str]:
    """Tidied texts that say something, the first of those that differ in case only."""
    kept: dict[str, str] = {}
    for t in map(tidy, texts):
        if t:
            kept.setdefault(t.casefold(), t)
    return list(kept.values())


def says(text: str, words: list[str]) -> bool:
    low = text.lower()
    return any(w in low for w in words)


def is_step(text: str) -> bool:
    return says(text, STEP_VERBS) and not says(text, NOT_STEPS)


def under_headings(root: Node) -> list[str]:
    """Steps that follow headings of instructions, before the recipe's card."""
    parent = {id(p): n for n in root.walk() for p in n.parts if isinstance(p, Node)}
    out: list[str] = []
    for heading in (n for n in root.walk() if n.tag in HEADINGS):
        name = heading.text()
        if says(name, ["recipe card"]):
            break
        if not says(name, STEP_HEADINGS):
            continue
        beside = [p for p in parent[id(heading)].parts if isinstance(p, Node)]
        steps: list[str] = []
        for node in beside[next(i for i, p in enumerate(beside) if p is heading) + 1 :]:
            text = tidy(node.text())
            if node.tag in HEADINGS:
                if steps or says(text, STOP_HEADINGS):
                    break
                continue
            if node.tag in SILENT:
                continue
            items = [t for t in once(x.text() for x in node.walk() if x.tag == "li") if is_step(t)]
            if items:
                steps += items
                continue
            if not text or says(text, NOT_STEPS):
                continue
            numbered = re.match(r"(?i)\s*(?:step\s*)?\d+[).\s:-]+(.+)$", text)
            if numbered:
                steps.append(tidy(numbered[1]))
            elif (steps and is_step(text)) or (len(text) >= 40 and says(text, PREPARING)):
                if steps and len(text) < 120 and not text.lower().startswith(tuple(OPENING)):
                    steps[-1] += " " + text
                else:
                    steps.append(text)
        out += once(steps)
    return once(out)


def worth(steps: list[str]) -> tuple[int, int]:
    return sum(map(len, steps)), len(steps)


def better(new: list[str], old: list[str], gain: int = 180) -> bool:
    """Whether a set of steps says more: more of them and no less text, or much more text."""
    (chars, n), (had, m) = worth(new), worth(old)
    return bool(new) and (not old or (n > m and chars >= had) or chars >= had + gain)


LABEL = re.compile(r"\b(" + "|".join(map(re.escape, NUTRIENTS)) + r")\s+")


def nutrition(root: Node) -> dict[str, str]:
    """Values behind the labels in the section under the first nutrition heading, else in 600 characters from "Nutrition Calories"."""
    text = ""
    parent = {id(p): n for n in root.walk() for p in n.parts if isinstance(p, Node)}
    for heading in (n for n in root.walk() if n.tag in HEADINGS and says(n.text(), ["nutrition"])):
        beside = [p for p in parent[id(heading)].parts if isinstance(p, Node)]
        for node in beside[next(i for i, p in enumerate(beside) if p is heading) + 1 :]:
            if node.tag in HEADINGS:
                break
            text = f"{text} {node.text()}".strip()
        break
    if not text:
        page = root.text()
        m = re.search(r"(?i)\bNutrition\s+Calories\b", page)
        text = page[m.start() : m.start() + 600] if m else ""
    out, labels, i = {}, list(LABEL.finditer(text)), 0
    while i < len(labels):
        # A value runs to the next label that isn't its own beginning.
        j = i + 1
        while j < len(labels) and not text[labels[i].end() : labels[j].start()].strip():
            j += 1
        value = text[labels[i].end() : labels[j].start() if j < len(labels) else len(text)].strip()
        if value:
            out[re.sub(r"[^a-z0-9]+", "_", labels[i][1].lower()).strip("_")] = value
        i = j
    return out


RECORD = T.StructType(
    [
        T.StructField("title", T.StringType()), T.StructField("description", T.StringType()), T.StructField("ingredients", T.ArrayType(T.StringType())),
        T.StructField("steps", T.ArrayType(T.StringType())), T.StructField("best_steps", T.ArrayType(T.StringType())), T.StructField("nutrition", T.MapType(T.StringType(), T.StringType())),
    ]
)


def record(html: str | None) -> dict:
    tree = Tree()
    tree.feed(html or "")
    tree.close()
    root = tree.root
    title = next((t for n in root.walk() if n.tag == "h1" for t in [" ".join(x.strip() for x in n.parts if isinstance(x, str)).strip()] if t), None)
    about = next((n.attrs.get("content") for n in root.walk() if n.tag == "meta" and n.attrs.get("name") == "description"), None)
    texts = lambda places: [t for t in (" ".join(n.text().split()) for n in found(root, places)) if t]
    card, section = once(n.text() for n in found(root, CARD_PLACES)), under_headings(root)
    best = max((s for s in (card, section) if s), key=worth, default=[])
    return {"title": title, "description": (about or "").strip(), "ingredients": texts(INGREDIENT_PLACES), "steps": texts(STEP_PLACES), "best_steps": best, "nutrition": nutrition(root)}


@F.pandas_udf(RECORD)
def _records(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for v in batches:
        yield pd.DataFrame([record(x) for x in v], columns=RECORD.names)


def page_record(c: Column) -> Column:
    """title, description, ingredients, steps, the better of two readings of the steps, and nutrition of a page."""
    return _records(c)


def title_of(c: Column) -> Column:
    """A page's name out of its title: what stands before the first bar or dash between spaces."""
    return F.trim(F.split(c, r"\s+[|–—-]\s+")[0])
