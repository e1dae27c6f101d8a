"""Quality rules on repetition, from suffix arrays.

For each document a suffix array over its words is built by rank doubling, for many documents of a batch at once.  The
longest common prefix of neighbouring suffixes gives, for each position, the longest text there that occurs elsewhere
in the document; those of at least `min_words` are the maximal repeated substrings.  The union of their spans may cover
at most `max_fraction` of the words, and the longest may have at most `max_repeat` words.  Every word in such a span also
lies in a repeated window of three words, of which the base rule allows half, so max_fraction decides only below 0.5.
A document of fewer than `short_words` words whose repeats are one line that occurs twice is spared the fraction.

Only suffixes whose first `min_words` words occur twice can begin such a repeat, so only they are sorted; the others
count as distinct ranks, which changes no result.

Edge cases: null, empty and white-space texts have no words and fail the base rule; a document that is one word over and
over is one repeat that overlaps itself; equal rows get equal results; a missing id changes nothing; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pantrylake.llm.common import SPACE, batches, grams, run_hashes, spans, utf8

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass(frozen=True)
class Config:
    min_words: int = 10
    max_fraction: float = 0.3
    max_repeat: int = 100
    short_words: int = 100


def repeated(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key occurs again in its document, and whether it has occurred before."""
    order = np.lexsort((keys, doc))
    k, d = keys[order], doc[order]
    same = np.concatenate([[False], (k[1:] == k[:-1]) & (d[1:] == d[:-1])]) if len(k) else np.zeros(0, bool)
    again = same.copy()
    again[:-1] |= same[1:]
    out, later = np.zeros(len(k), bool), np.zeros(len(k), bool)
    out[order], later[order] = again, same
    return out, later


def windows(words: np.ndarray, woff: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, documents and first words of the windows of k words inside a document."""
    g = grams(words, k)
    doc = np.repeat(np.arange(len(woff) - 1), np.diff(woff))
    at = np.flatnonzero(doc[: len(g)] == doc[k - 1 :][: len(g)]) if len(g) else np.zeros(0, np.int64)
    return g[at], doc[at], at


def dense(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ranks of pairs (a, b), from 0."""
    order = np.lexsort((b, a))
    step = np.concatenate([[False], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])
    out = np.empty(len(a), np.int64)
    out[order] = np.cumsum(step)
    return out


def longest_repeats(words: np.ndarray, woff: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions where a repeat of at least k words begins, and the length of the longest repeat there."""
    key, doc, at = windows(words, woff, k)
    hit, _ = repeated(key, doc)
    pos, doc, key = at[hit], doc[hit], key[hit]
    if not len(pos):
        return pos, pos
    n = len(words)
    slot = np.full(n + 1, -1, np.int64)  # of each word position among the sorted suffixes
    slot[pos] = np.arange(len(pos))
    ranks, step = [dense(doc, key.astype(np.uint64))], [k]
    end = woff[1:][doc]
    while True:
        r, h = ranks[-1], step[-1]
        nxt = pos + h
        inside = nxt < end
        s = slot[np.minimum(nxt, n)]
        # Past the end, or where the next k words occur only once, the suffix differs from every other one.
        follow = np.where(inside & (s >= 0), r[s], -1 - np.arange(len(pos)))
        new = dense(r, follow)
        if new.max() + 1 == len(pos):
            ranks.append(new)
            step.append(2 * h)
            break
        ranks.append(new)
        step.append(2 * h)
    order = np.argsort(ranks[-1], kind="stable")
    a, b = order[:-1], order[1:]
    lcp = np.zeros(len(a), np.int64)
    ia, ib = a.copy(), b.copy()
    live = np.ones(len(a), bool)
    for r, h in zip(reversed(ranks[:-1]), reversed(step[:-1]), strict=True):
        same = live & (ia >= 0) & (ib >= 0)
        same[same] = r[ia[same]] == r[ib[same]]
        lcp[same] += h
        pa_, pb_ = pos[ia[same]] + h, pos[ib[same]] + h
        ia[same], ib[same] = slot[np.minimum(pa_, n)], slot[np.minimum(pb_, n)]
    # What is left after whole steps is shorter than k words: compare them one by one.
    ea, eb = end[a], end[b]
    wa, wb = pos[a] + lcp, pos[b] + lcp
    open_ = lcp > 0
    for _ in range(k):
        go = open_ & (wa < ea) & (wb < eb)
        go[go] = words[wa[go]] == words[wb[go]]
        if not go.any():
            break
        lcp[go] += 1
        wa[go] += 1
        wb[go] += 1
        open_ = go
    best = np.zeros(len(pos), np.int64)
    np.maximum.at(best, a, lcp)
    np.maximum.at(best, b, lcp)
    return pos, best


def measure(text: pa.Array, cfg: Config) -> dict[str, np.ndarray]:
    data, off = utf8(text)
    n = len(off) - 1
    solid = ~SPACE[data]
    starts, ends, woff = spans(solid, off)
    words = run_hashes(data, starts, ends)
    n_words = np.diff(woff)

    def by_doc(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[off])

    ls, le, loff = spans(data != 10, off)
    ldoc = np.repeat(np.arange(n), np.diff(loff))
    full = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
    _, later = repeated(run_hashes(data, ls, le)[full], ldoc[full])
    dup_lines = np.bincount(ldoc[full], later, n).astype(np.int64)
    line_words = (np.searchsorted(starts, le) - np.searchsorted(starts, ls))[full]
    dup_words = np.bincount(ldoc[full], later * line_words, n).astype(np.int64)

    wdoc = np.repeat(np.arange(n), n_words)

    def covered(at: np.ndarray, length: np.ndarray) -> np.ndarray:
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + length, -1)
        return np.bincount(wdoc, np.cumsum(edge)[:-1] > 0, n).astype(np.int64)

    key, doc, at = windows(words, woff, 3)
    hit, _ = repeated(key, doc)
    repeat_words = covered(at[hit], np.full(int(hit.sum()), 3))
    pos, length = longest_repeats(words, woff, cfg.min_words)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, wdoc[pos], length)
    in_repeats = covered(pos, length)
    failed = (n_words < 50) | (100 * repeat_words > 50 * n_words)
    one_line = (n_words < cfg.short_words) & (dup_lines == 1) & (dup_words >= cfg.min_words) & (in_repeats <= 2 * dup_words)
    kept = ~failed & (one_line | (in_repeats <= cfg.max_fraction * n_words)) & (longest <= cfg.max_repeat)
    return {
        "n_words": n_words, "word_chars": by_doc(solid & ((data & 0xC0) != 0x80)), "n_symbols": by_doc(SYMBOL[data]), "n_dup_lines": dup_lines,
        "n_repeat_words": repeat_words, "base_failed": failed, "kept": kept, "repeat_words": in_repeats, "longest_repeat": longest,
    }


SCHEMA = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, repeat_words bigint, longest_repeat bigint"
)


def judge(docs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """The measures of every document and whether it is kept; repeat_words counts the words inside maximal repeats."""

    def run(it):
        for rb in batches(it):
            got = measure(rb.column(1), cfg)
            yield pa.RecordBatch.from_arrays([rb.column(0), *[pa.array(v) for v in got.values()]], names=["doc_id", *got])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id bigint, {SCHEMA}")
