"""SentencePiece encoding and decoding with batched numpy Viterbi.

Distinct words of equal length advance together: substring hashes probe the sorted piece keys, vectorised maxima keep
the best piece ending at each position, and backpointers give the ids.  The vocabulary is a BPE one, whose library
encoding is not the segmentation of the greatest summed score; transitions are therefore restricted to neighbouring
pieces that BPE leaves apart (see `pieces`), others counting as minus infinity, so that the ids equal the library's.  Bytes of characters outside the
vocabulary become byte pieces, and decoding is exact but for the vocabulary's own space mark, which reads as a space.

Edge cases: null and empty texts have no ids and decode to the empty text; equal rows get equal ids; a repeated or
missing id changes nothing; a very long text or word takes linear time; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pantrylake.llm.common import batches, ragged
from pantrylake.llm.pieces import MARK, Encoder, Pieces, kept_encoder
from pantrylake.llm.token_counts import SLICE, model_path


def encode_batch(enc: Encoder, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of all texts and their offsets."""
    segs, n_segs = enc.batch(texts)
    flat, at, lens = enc.tables("ids")
    size = lens[segs]
    ids = flat[np.repeat(at[segs], size) + ragged(size)]
    off = np.concatenate([[0], np.cumsum(np.bincount(np.repeat(np.arange(len(texts)), n_segs), size, len(texts)).astype(np.int64))])
    return ids, off


class Decoder:
    def __init__(self, pieces: Pieces):
        size = np.array([len(x) for x in pieces.names], np.int64)
        self.size, self.at, self.flat = size, np.cumsum(size) - size, np.frombuffer(b"".join(pieces.names), np.uint8)

    def batch(self, ids: np.ndarray, off: np.ndarray) -> list[bytes]:
        """Bytes of each text, without the leading space of a text that has any."""
        size = self.size[ids]
        data = self.flat[np.repeat(self.at[ids], size) + ragged(size)].tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])[off]
        return [data[a + 1 : b] if b > a else b"" for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, n_tokens, and whether decoding them gives the text again."""
    shared = docs.sparkSession.sparkContext.broadcast(Pieces.load(path or model_path()))
    name = uuid4().hex

    def run(it):
        enc, dec = kept_encoder(name, shared.value), Decoder(shared.value)
        for rb in batches(it, SLICE, keeps=name):
            texts = rb.column(1).to_pylist()
            ids, off = encode_batch(enc, texts)
            same = [b == (t or "").replace(MARK, " ").encode() for b, t in zip(dec.batch(ids, off), texts, strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([rb.column(0), lists, pa.array(np.diff(off), pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "ids", "n_tokens", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>, n_tokens bigint, round_trip boolean")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of encoded(doc_id, ids); null ids decode to the empty text, bytes that are no UTF-8 to U+FFFD."""
    shared = encoded.sparkSession.sparkContext.broadcast(Pieces.load(path or model_path()))

    def run(it):
        dec = Decoder(shared.value)
        for rb in it:
            for i in range(0, rb.num_rows, 256):
                part = rb.slice(i, 256)
                rows = [x or [] for x in part.column(1).to_pylist()]
                off = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64)
                ids = np.fromiter((y for x in rows for y in x), np.int64, int(off[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([b.decode("utf-8", "replace") for b in dec.batch(ids, off)], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
