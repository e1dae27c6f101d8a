"""Passages that repeat across documents, by a sparse suffix array.

Of the suffixes that begin at each word, only those at minimiser positions are kept: among every 25 neighbouring heads
of 26 words the one of least hash.  Any passage of 50 words or more holds such a position, the same one in every copy,
with a head wholly inside the passage.  Heads that one document alone holds are dropped first.  Where the whole context
of a position (all its 50-word windows) is found in two documents, it is marked as it stands.  The other suffixes are
sorted behind their heads, to the right and to the left, compared with their neighbours of other documents, and the
matches are extended to both sides; where neither order shows how far (no single neighbour reaches as far to both sides
as the best ones do to one), the windows in between are compared.  A head with very many contexts is not sorted in one
task: its windows are counted by their hashes.

A word is marked if it lies in a 50-word window that occurs in two documents.  Equality is that of hashes of words
without white space, in their original case (64 bits, 32 behind an equal head).  What one document repeats within itself
is not reported (`repetition` does that).

Edge cases: null, empty and shorter texts hold no such window and give no row; copies of a text under other ids repeat
each other; rows equal in id and text are one document and each returned; two texts under one id are two documents, and
so are two texts without an id; a very long text is only more suffixes; ties between heads go to the leftmost; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pantrylake.llm.common import batches, bitmap, checkpointed, id_test, in_bitmap, mix, ragged, spread_join, utf8, words_of

PASSAGE = 50
HEAD = 26
WINDOW = PASSAGE - HEAD + 1
SIDE = PASSAGE - HEAD  #: words of context that matter on either side of a head
BITS = 27
CROWD = 1000  #: a head with more contexts, and more than a 200,000th of them all, is not sorted in one task
TOGETHER = 50_000  #: suffixes sorted at once, if heads are small
_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _A + b * _B)


def gram_tower(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every 26 and every 50 words."""
    size, level = 1, {1: words}
    while size < 32:
        x = level[size]
        level[2 * size] = joined(x[: max(0, len(x) - size)], x[size:])
        size *= 2

    def whole(parts):
        at, out, n = 0, None, len(words) - sum(parts) + 1
        for p in parts:
            x = level[p][at : at + n]
            out = x if out is None else joined(out, x)
            at += p
        return out

    if len(words) < PASSAGE:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return whole((16, 8, 2)), whole((32, 16, 2))


def anchors(words: np.ndarray, woff: np.ndarray):
    """Document, head hash, context hash, position, and first and last window start of each kept suffix."""
    head, window = gram_tower(words)
    empty = np.zeros(0, np.int64)
    n = np.diff(woff)
    many = np.maximum(n - PASSAGE + 1, 0)
    start = np.repeat(woff[:-1], many) + ragged(many)  # window starts inside documents
    if not len(start):
        return empty, head[:0], head[:0], empty, empty, empty
    best = np.arange(len(head))
    reach, span = 1, WINDOW
    while reach * 2 <= span:
        a, b = best[: len(best) - reach], best[reach:]
        best = np.where(head[a] <= head[b], a, b)
        reach *= 2
    if reach < span:
        step = span - reach
        a, b = best[: len(best) - step], best[step:]
        best = np.where(head[a] <= head[b], a, b)
    doc = np.repeat(np.arange(len(n)), many)
    p = best[start]
    new = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (doc[1:] != doc[:-1])]))
    last = np.append(new[1:], len(p)) - 1
    lo, hi = start[new], start[last]
    context = joined(window[lo], window[hi] + (hi - lo).astype(np.uint64))
    return doc[new], head[p[new]], context, p[new], lo, hi


# A place is a position with the words that its windows reach to the left of it at most and at least.
def packed(p, most, least):
    return p << 16 | most << 8 | least


def unpacked(place):
    return place >> 16, place >> 8 & 255, place & 255


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64("doc_id", "text").alias("rid"), "text")


def _suffixes(docs: DataFrame, shared=None) -> DataFrame:
    """head, context, rid and place of each kept suffix, of heads in the bitmap only if there is one."""

    def run(it):
        for rb in batches(it):
            words, woff = words_of(*utf8(rb.column(1)))
            doc, head, context, p, lo, hi = anchors(words, woff)
            place = packed(p - woff[:-1][doc], p - lo, p - hi)
            if shared is not None:
                on = in_bitmap(shared.value, head)
                doc, head, context, place = doc[on], head[on], context[on], place[on]
            cols = [pa.array(head.view(np.int64)), pa.array(context.view(np.int64)), rb.column(0).take(pa.array(doc)), pa.array(place, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["head", "context", "rid", "place"])

    return _rows(docs).mapInArrow(run, "head bigint, context bigint, rid bigint, place bigint")


WIDE = "head bigint, rid bigint, place bigint, crowd boolean, left binary, right binary"


def _wide(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(head, rid, place, crowd) with the words to the left (backwards) and to the right of the heads, as 32-bit hashes."""
    lists = asked.groupBy("rid").agg(F.collect_list(F.struct("head", "place", "crowd")).alias("asked"))
    rows = _rows(docs).filter(id_test(asked, "rid")("rid")).join(lists, "rid")

    def run(it):
        for rb in batches(it):
            words, woff = words_of(*utf8(rb.column(1)))
            lists = rb.column(2)
            inner, count = lists.flatten(), np.diff(np.asarray(lists.offsets))
            doc = np.repeat(np.arange(rb.num_rows), count)
            place = np.asarray(inner.field("place"))
            p, most, least = unpacked(place)
            at, reach = p + woff[:-1][doc], np.arange(SIDE)
            cols = [inner.field("head"), rb.column(0).take(pa.array(doc)), pa.array(place), inner.field("crowd")]
            for where, size in ((at[:, None] - 1 - reach, most), (at[:, None] + HEAD + reach, SIDE - least)):
                side = words.take(where, mode="clip").astype(np.uint32)
                side[reach >= size[:, None]] = 0
                ends = pa.array(np.arange(len(p) + 1) * (4 * SIDE), pa.int32())
                cols.append(pa.Array.from_buffers(pa.binary(), len(p), [None, ends.buffers()[1], pa.py_buffer(side.tobytes())]))
            yield pa.RecordBatch.from_arrays(cols, names=["head", "rid", "place", "crowd", "left", "right"])

    return rows.select("rid", "text", "asked").mapInArrow(run, WIDE)


def common_words(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """How many words rows of a and b begin with in common, of na and nb."""
    same = a == b
    return np.minimum(np.where(same.all(1), SIDE, same.argmin(1)), np.minimum(na, nb))


def neighbours(head, rid, one, n_one, two, n_two) -> tuple[np.ndarray, np.ndarray]:
    """Sorts suffixes behind their heads by side `one`; what each shares there with the best neighbour of another document, and
    how far the match goes on side `two`; -1 where there is none."""
    n = len(head)
    order = np.lexsort([rid, *(one[:, j] for j in reversed(range(SIDE))), head])
    h, r, at = head[order], rid[order], np.arange(n)
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])]))
    run = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
    best = np.full(n, -1)
    for other, inside in ((first[run] - 1, first[run] > 0), (np.append(first[1:], n)[run], run < len(first) - 1)):
        i = at[inside]
        i = i[h[i] == h[other[i]]]
        x, y = order[i], order[other[i]]
        best[i] = np.maximum(best[i], common_words(one[x], one[y], n_one[x], n_one[y]) * 32 + common_words(two[x], two[y], n_two[x], n_two[y]))
    out = np.empty(n, np.int64)
    out[order] = best
    return np.where(out < 0, -1, out >> 5), np.where(out < 0, -1, out & 31)


def window_keys(head, left, n_left, right, n_right):
    """Row, words to the left of the head, and hash of every window of the suffixes."""
    n = len(head)
    towers = []
    for side in (left, right):
        h = np.zeros((n, SIDE + 1), np.uint64)
        for j in range(SIDE):
            h[:, j + 1] = joined(h[:, j], side[:, j].astype(np.uint64))
        towers.append(h)
    rows, before, keys = [], [], []
    for d in range(SIDE + 1):
        row = np.flatnonzero((n_left >= d) & (n_right >= SIDE - d))
        rows.append(row)
        before.append(np.full(len(row), d))
        keys.append(joined(joined(head[row], towers[0][row, d]), towers[1][row, SIDE - d] + np.uint64(d)))
    return np.concatenate(rows), np.concatenate(before), np.concatenate(keys)


def extended(head, rid, left, n_left, right, n_right) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, and words to the left and right of its head, of matches with other documents that together cover all that they do."""
    if not len(head):
        none = np.zeros(0, np.int64)
        return none, none, none
    most_r, with_r = neighbours(head, rid, right, n_right, left, n_left)
    most_l, with_l = neighbours(head, rid, left, n_left, right, n_right)
    a = (most_r >= 0) & (most_r + with_r >= SIDE)
    b = (most_l >= 0) & (most_l + with_l >= SIDE)
    open_ = (most_r >= 0) & (most_r + most_l >= SIDE) & ~(a & b) & ~(a & (with_r == most_l)) & ~(b & (with_l == most_r))
    i, j = np.flatnonzero(a), np.flatnonzero(b)
    rows, lefts, rights = [i, j], [with_r[i], most_l[j]], [most_r[i], with_l[j]]
    if open_.any():
        part = np.flatnonzero(np.isin(head, head[open_]))
        row, before, key = window_keys(*(x[part] for x in (head, left, n_left, right, n_right)))
        row = part[row]
        order = np.lexsort((rid[row], key))
        k, r = key[order], rid[row][order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        last = np.append(first[1:], len(k)) - 1
        found = np.empty(len(k), bool)
        found[order] = np.repeat(r[first] != r[last], last - first + 1)
        found &= open_[row]
        rows.append(row[found])
        lefts.append(before[found])
        rights.append(SIDE - before[found])
    return np.concatenate(rows), np.concatenate(lefts), np.concatenate(rights)


def _arrays(rb: pa.RecordBatch):
    head, rid, place = (np.asarray(rb.column(c)) for c in ("head", "rid", "place"))
    _, most, least = unpacked(place)
    sides = [np.frombuffer(b"".join(rb.column(c).to_pylist()), np.uint32).reshape(-1, SIDE) for c in ("left", "right")]
    return place, head.view(np.uint64), rid, sides[0], most, sides[1], SIDE - least


def _sorted_matches(wide: DataFrame, n: int) -> DataFrame:
    """rid, start and end of matches, head by head."""

    def matched(batch):
        place, head, rid, left, n_left, right, n_right = _arrays(batch)
        row, l, r = extended(head, rid, left, n_left, right, n_right)
        p = place[row] >> 16
        return pa.RecordBatch.from_arrays([pa.array(rid[row]), pa.array((p - l).astype(np.int32)), pa.array((p + HEAD + r).astype(np.int32))], names=["rid", "start", "end"])

    def run(it):
        held: list[pa.RecordBatch] = []
        size, due = 0, TOGETHER
        for rb in it:
            if not rb.num_rows:
                continue
            if size >= due:
                # All heads but the last are whole.
                now = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                head = np.asarray(now.column(0))
                cut = int(np.searchsorted(head, head[-1]))
                if cut:
                    yield matched(now.slice(0, cut))
                held = [now.slice(cut)]
                size = now.num_rows - cut
                due = max(TOGETHER, 2 * size)
            held.append(rb)
            size += rb.num_rows
        if held:
            yield matched(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return wide.repartition(n, "head").sortWithinPartitions("head").mapInArrow(run, "rid bigint, start int, end int")


def _counted_matches(wide: DataFrame) -> DataFrame:
    """The same by counting windows: for heads whose suffixes are too many for one task."""

    def run(it):
        for rb in it:
            if rb.num_rows:
                place, head, rid, left, n_left, right, n_right = _arrays(rb)
                row, before, key = window_keys(head, left, n_left, right, n_right)
                cols = [pa.array(key.view(np.int64)), pa.array(rid[row]), pa.array(((place[row] >> 16) - before).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "rid", "start"])

    windows = checkpointed(wide.mapInArrow(run, "key bigint, rid bigint, start int"))
    found = windows.groupBy("key").agg(F.min("rid").alias("x"), F.max("rid").alias("y"), F.count("*").alias("n")).filter("x <> y").select("key", "n")
    return spread_join(windows, checkpointed(found), ["key"], windows.count()).select("rid", "start", (F.col("start") + PASSAGE).alias("end"))


def spans(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """rid (of id and text), start and end (words) of repeated windows and contexts; they overlap."""
    spark = docs.sparkSession
    heads = _suffixes(docs).groupBy("head").agg(F.min("rid").alias("x"), F.max("rid").alias("y")).filter("x <> y")
    kept = checkpointed(_suffixes(docs, spark.sparkContext.broadcast(bitmap(heads, "head", BITS))))
    same = kept.groupBy("head", "context").agg(F.min(F.struct("rid", "place")).alias("x"), F.max(F.struct("rid", "place")).alias("y"), F.count("*").alias("n"))
    same = checkpointed(same.select("head", "context", "x", "y", "n", (F.col("x.rid") == F.col("y.rid")).alias("lone")))
    place = F.col("place")
    start = (F.shiftright(place, 16) - F.shiftright(place, 8).bitwiseAND(255)).cast("int")
    end = (F.shiftright(place, 16) - place.bitwiseAND(255) + PASSAGE).cast("int")
    shared = same.filter("NOT lone").select("head", "context", "n")
    whole = spread_join(kept, shared, ["head", "context"], kept.count()).select("rid", start.alias("start"), end.alias("end"))
    # Heads with something left to compare; those of very many contexts are few: fewer than all contexts over the limit.
    by_head = checkpointed(same.groupBy("head").agg(F.count("*").alias("n"), F.sum(F.col("lone").cast("int")).alias("lone")).filter("n > 1 AND lone > 0"))
    limit = max(crowd, same.count() // 200_000)
    crowded = F.broadcast(by_head.filter(F.col("n") > limit).select("head", F.lit(True).alias("crowd")))
    test = id_test(by_head, "head", BITS)
    rows = same.filter(test("head")).join(crowded, "head", "left")
    rows = rows.select("head", F.coalesce("crowd", F.lit(False)).alias("crowd"), F.explode(F.when(F.col("lone"), F.array("x")).otherwise(F.array("x", "y"))).alias("one"))
    wide = checkpointed(_wide(docs, checkpointed(rows.select("head", "one.rid", "one.place", "crowd"))))
    tasks = max(spark.sparkContext.defaultParallelism, wide.count() // 200_000 + 1)
    return whole.unionByName(_sorted_matches(wide.filter("NOT crowd"), tasks)).unionByName(_counted_matches(wide.filter("crowd")))


def repeats(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, spans (maximal, in words, ends exclusive) and repeated_words of every document with a repeated passage."""
    got = spans(docs, crowd).groupBy("rid").agg(F.collect_set(F.struct("start", "end")).alias("s"))

    def run(it):
        for rb in it:
            inner, count = rb.column(1).flatten(), np.diff(np.asarray(rb.column(1).offsets))
            doc = np.repeat(np.arange(rb.num_rows), count)
            a, b = (doc << 34 | np.asarray(inner.field(x)).astype(np.int64) for x in ("start", "end"))
            order = np.argsort(a, kind="stable")
            a, b = a[order], np.maximum.accumulate(b[order])
            new = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]])) if len(a) else np.zeros(0, np.int64)
            first, last = a[new], b[np.append(new[1:], len(a)) - 1] if len(a) else b
            low = (1 << 34) - 1
            start, end = (first & low).astype(np.int32), (last & low).astype(np.int32)
            off = np.searchsorted(first >> 34, np.arange(rb.num_rows + 1))
            flat = pa.StructArray.from_arrays([pa.array(start), pa.array(end)], names=["start", "end"])
            total = np.bincount(first >> 34, end - start, rb.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.ListArray.from_arrays(pa.array(off, pa.int32()), flat), pa.array(total)], names=["rid", "spans", "repeated_words"])

    merged = checkpointed(got.mapInArrow(run, "rid bigint, spans array<struct<start:int,end:int>>, repeated_words bigint"))
    names = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("rid"))
    return names.filter(id_test(merged, "rid")("rid")).join(merged, "rid").select("doc_id", "spans", "repeated_words")
