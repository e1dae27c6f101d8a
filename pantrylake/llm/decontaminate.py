"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are lower-cased, every run of characters that are neither letters nor digits becomes one space, and
both get a space at either end.  An item of m characters may occur with e = floor(rate * m) edits; it is split into
e + 1 pieces, of which at least one must occur exactly.  One Aho-Corasick automaton finds all pieces in each whole
text, and Myers' bit-parallel distance checks the windows around the hits.  The decision about a document needs
nothing but the document and the items, so documents are never shuffled.

Items come in blocks of a bounded size (`block_bytes`), one pass for each; only a block is ever broadcast, and a Python
worker builds its automaton once, not for each task.

Edge cases: null and empty texts match nothing; items without a letter or digit, or null, match nothing; equal items
are reported under each id, however many documents an item is found in; repeated documents are each reported; a very long
text is one pass of the automaton; empty tables give no rows; other columns are kept by
`drop_contaminated` and ignored by `matches`.
"""

from __future__ import annotations

from dataclasses import dataclass
from uuid import uuid4

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pantrylake.llm.common import batches, kept


@dataclass(frozen=True)
class Config:
    rate: float = 0.05
    block_bytes: int = 8 << 20


def normalised(text: pa.Array) -> pa.Array:
    low = pc.utf8_lower(pc.fill_null(text.cast(pa.large_string()), ""))
    return pc.replace_substring_regex(low, r"[^\p{L}\p{N}]+", " ")


def padded(text: str) -> str:
    return f" {text.strip()} "


class Matcher:
    """Finds approximate occurrences of a block of items."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = []
        pieces: dict[str, list[tuple[int, int]]] = {}
        self.masks: dict[int, dict[str, int]] = {}
        for (item_id, _), text in zip(items, normalised(pa.array([t for _, t in items], pa.large_string())).to_pylist(), strict=True):
            p = padded(text)
            if not p.strip():
                continue
            m, e = len(p), int(rate * len(p))
            k = len(self.items)
            self.items.append((item_id, p, e))
            cuts = [m * i // (e + 1) for i in range(e + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces.setdefault(p[a:b], []).append((k, a))
        self.auto = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.auto.add_word(piece, (len(piece), where))
        if pieces:
            self.auto.make_automaton()

    def best(self, k: int, text: str, lo: int, hi: int) -> tuple[int, int]:
        """Least edit distance of item k to a substring of text[lo:hi], and where that substring ends."""
        p = self.items[k][1]
        masks = self.masks.get(k)
        if masks is None:  # only of items that come near
            masks = self.masks[k] = {}
            for i, ch in enumerate(p):
                masks[ch] = masks.get(ch, 0) | 1 << i
        m = len(p)
        full, high = (1 << m) - 1, 1 << (m - 1)
        pv, mv, score, least, end = full, 0, m, m, lo
        for i in range(lo, hi):
            eq = masks.get(text[i], 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (~(xh | pv) & full)
            mh = pv & xh
            if ph & high:
                score += 1
            if mh & high:
                score -= 1
            ph = ph << 1 & full
            mh = mh << 1 & full
            pv = mh | (~(xv | ph) & full)
            mv = ph & xv
            if score < least:
                least, end = score, i + 1
                if least == 0:
                    break
        return least, end

    def find(self, text: str) -> dict[int, tuple[int, int, int]]:
        """Item index -> (distance, end in the normalised text, windows that match)."""
        hits: dict[int, set[int]] = {}
        if not self.items:
            return {}
        for end, (n, where) in self.auto.iter(text):
            for k, at in where:
                hits.setdefault(k, set()).add(end + 1 - n - at)
        out = {}
        for k, starts in hits.items():
            _, p, e = self.items[k]
            m, best, count, window = len(p), None, 0, None
            ordered = sorted(starts)
            for i, s in enumerate(ordered):
                if window is None:
                    window = [max(0, s - e), min(len(text), s + m + e)]
                else:
                    window[1] = min(len(text), s + m + e)
                if i + 1 < len(ordered) and ordered[i + 1] - e <= window[1]:
                    continue
                lo, hi = window
                window = None
                near = text.find(p, lo, hi)
                d, end = (0, near + m) if near >= 0 else self.best(k, text, lo, hi)
                if d <= e:
                    count += 1
                    if best is None or d < best[0]:
                        best = (d, end)
            if best is not None:
                out[k] = (*best, count)
        return out


def kept_matcher(name: str, items: list[tuple[int, str]], rate: float) -> Matcher:
    """This worker's matcher of that name; a new name drops the old one."""
    return kept(name, lambda: Matcher(items, rate))


def blocks(benchmark: DataFrame, cfg: Config):
    """The items in lists of about block_bytes at most; an item's block depends on its id."""
    rows = benchmark.filter(F.col("text").isNotNull()).select("item_id", "text")
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = -(-size // cfg.block_bytes)
    for b in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda x: (x[0] is None, x))


def matches(docs: DataFrame, benchmark: DataFrame, cfg: Config = Config()) -> DataFrame:
    """doc_id, item_id, distance, end_pos (in the normalised text) and n_windows for every occurrence pair."""
    schema = "doc_id bigint, item_id bigint, distance int, end_pos int, n_windows int"
    found = docs.sparkSession.createDataFrame([], schema)
    for items in blocks(benchmark, cfg):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(it, shared=shared, name=uuid4().hex):
            m = kept_matcher(name, shared.value, cfg.rate)
            for rb in it:
                rows = []
                for doc_id, text in zip(rb.column(0).to_pylist(), normalised(rb.column(1)).to_pylist(), strict=True):
                    rows += [(doc_id, m.items[k][0], d, end, n) for k, (d, end, n) in m.find(padded(text)).items()]
                cols = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "item_id", "distance", "end_pos", "n_windows"]
                )

        found = found.unionByName(docs.select("doc_id", "text").mapInArrow(run, schema))
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, cfg: Config = Config()) -> DataFrame:
    """docs without the documents that hold an item."""
    for items in blocks(benchmark, cfg):
        shared = docs.sparkSession.sparkContext.broadcast(items)
        at = docs.columns.index("text")

        def run(it, shared=shared, at=at, name=uuid4().hex):
            m = kept_matcher(name, shared.value, cfg.rate)
            for rb in batches(it, keeps=name):
                clean = [not m.find(padded(t)) for t in normalised(rb.column(at)).to_pylist()]
                yield rb.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
