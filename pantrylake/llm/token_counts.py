"""Exact token counts of every prefix of every text, by dynamic programming over a BPE vocabulary.

Each distinct word goes once through the programme of `pieces`, which gives the count at each of its characters; a
text's prefix counts are its words' counts on top of the sums before them.  `prefix_counts` stores them; `tokens_in`
and `cut_for` answer how many tokens a prefix has and how long a prefix fits a budget, without encoding again.

Edge cases: null and empty texts have 0 tokens and the prefix counts [0]; special strings in a text are ordinary text;
equal rows get equal counts; a repeated or missing id changes nothing; a very long text or word takes linear time; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pantrylake.llm.common import batches, ragged
from pantrylake.llm.pieces import Encoder, Pieces, kept_encoder

MODEL = "piece_bpe_32k.model"
SLICE = 4 << 20


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def prefix_table(enc: Encoder, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of all prefixes of all texts, from the empty one on, and the offset of each text's first."""
    segs, n_segs = enc.batch(texts)
    flat, at, lens = enc.tables("counts")
    n, size = len(texts), lens[segs]
    doc = np.repeat(np.arange(n), n_segs)
    tokens = flat[at[segs] + size - 1].astype(np.int64) if len(segs) else np.zeros(0, np.int64)
    before = np.cumsum(tokens) - tokens
    start = np.cumsum(n_segs) - n_segs
    some = n_segs > 0
    base = np.zeros(n, np.int64)
    base[some] = before[start[some]]
    # The text behind its leading space mark: a text of c characters has c + 1 marks and characters, and c + 1 prefixes.
    values = flat[np.repeat(at[segs], size) + ragged(size)] + np.repeat(before - base[doc], size)
    chars = np.bincount(doc, size, n).astype(np.int64)
    out_len = np.maximum(chars, 1)
    off = np.cumsum(out_len) - out_len
    out = np.zeros(int(out_len.sum()), np.int32)
    out[np.repeat(off[some], chars[some]) + ragged(chars[some])] = values
    out[off] = 0  # the empty prefix has no token, not even the mark
    return out, np.append(off, len(out))


def _run(docs: DataFrame, path: str, schema: str, make) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Pieces.load(path))
    name = uuid4().hex

    def run(it):
        enc = kept_encoder(name, shared.value)
        for rb in batches(it, SLICE, keeps=name):
            text = rb.column(1)
            counts, off = prefix_table(enc, text.to_pylist())
            yield make(rb.column(0), text, counts, off)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def prefix_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and counts: element i is the number of tokens of the first i characters."""

    def make(ids, text, counts, off):
        return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(counts, pa.int32()))], names=["doc_id", "counts"])

    return _run(docs, path or model_path(), "doc_id bigint, counts array<int>", make)


def tokens_in(counts: str, n_chars: Column) -> Column:
    """Tokens of the first n_chars characters."""
    return F.element_at(counts, F.least(n_chars, F.size(counts) - 1).cast("int") + 1)


def cut_for(counts: str, budget: int) -> Column:
    """Characters of the longest prefix with at most budget tokens."""
    fits = F.transform(counts, lambda x, i: F.when(x <= budget, i))
    return F.coalesce(F.array_max(fits), F.lit(0))


def count_tokens(docs: DataFrame, limit: int = 4096, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, and cut_chars, the longest prefix within the limit, from the prefix counts."""

    def make(ids, text, counts, off):
        total = counts[off[1:] - 1]
        inside = np.flatnonzero(counts <= limit)
        cut = inside[np.searchsorted(inside, off[1:]) - 1] - off[:-1]
        size = pc.fill_null(pc.binary_length(text.cast(pa.large_string())), 0).cast(pa.int64())
        return pa.RecordBatch.from_arrays(
            [ids, size, pa.array(total, pa.int64()), pa.array(total > limit), pa.array(cut, pa.int64())], names=["doc_id", "n_bytes", "n_tokens", "over_limit", "cut_chars"]
        )

    return _run(docs, path or model_path(), "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, cut_chars bigint", make)
