"""Document quality from weak labels.

Overlapping heuristic labellers look at a text's symbols, letter case, list marks, exclamation marks, repeated lines and
phrases, sentence ends and word lengths, and vote good, bad or nothing.  Expectation-maximisation over the counts of
vote patterns in all documents estimates how reliable each labeller is and the posterior of each pattern.  A linear
scorer over hashed word shapes and words is then fitted to the posteriors on a bounded sample of documents
(`sample_size` and `sample_bytes` of text, drawn by a hash of the id) and scores every whole text.  Human labels are not used.

Edge cases: a null or empty text has no features and gets the scorer's bias with every labeller silent; an empty table
gives no rows; equal rows score alike and count as often as they occur in the votes, once in the sample; a very long text
is one longer row; ties (a score of exactly the threshold) are good; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pantrylake.llm.common import SPACE, batches, chunks, run_hashes, spans, utf8
from pantrylake.llm.repetition import SYMBOL, repeated, windows

LABELLERS = ("symbols", "upper_case", "list_marks", "exclamations", "repeated_lines", "repeated_phrases", "sentence_ends", "word_lengths")
BAD, SILENT, GOOD = 0, 1, 2
HASH_BITS = 14

UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LOWER = np.zeros(256, bool)
LOWER[97:123] = True
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[97:123] = ord("a")
SHAPE[65:91] = ord("A")
SHAPE[48:58] = ord("9")
SHAPE[128:] = ord("a")
ENDS = np.zeros(256, bool)
ENDS[[ord(c) for c in ".?;:"]] = True


@dataclass(frozen=True)
class Config:
    sample_size: int = 6000  #: bound of the scorer's training sample
    sample_bytes: int = 64 << 20
    rounds: int = 60
    epochs: int = 12
    rate: float = 1.0
    ridge: float = 1e-4
    threshold: float = 0.5


def look(text: pa.Array) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Votes (documents, labellers), and the hashed features as (document, dimension, value)."""
    data, off = utf8(text)
    n = len(off) - 1
    solid = ~SPACE[data]
    starts, ends, woff = spans(solid, off)
    words = run_hashes(data, starts, ends)
    n_words = np.diff(woff)
    per_word = 1 / np.maximum(n_words, 1)

    def share(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[off]).astype(float)

    wdoc = np.repeat(np.arange(n), n_words)
    first = data[starts] if len(starts) else data
    size = ends - starts
    marks = np.bincount(wdoc, (size <= 2) & ((first == ord("|")) | (first == ord("-")) | (first == ord("*"))), n) * per_word
    upper, lower = share(UPPER[data]), share(LOWER[data])
    caps = upper / np.maximum(upper + lower, 1)
    symbols, shouts, stops = share(SYMBOL[data] & (data != ord("|"))) * per_word, share(data == ord("!")) * per_word, share(ENDS[data]) * per_word
    ls, le, loff = spans(data != 10, off)
    ldoc = np.repeat(np.arange(n), np.diff(loff))
    _, later = repeated(run_hashes(data, ls, le), ldoc)
    lines = np.bincount(ldoc, later, n) / np.maximum(np.diff(loff), 1)
    key, doc, _ = windows(words, woff, 3)
    again, _ = repeated(key, doc)
    phrases = np.bincount(doc, again, n) / np.maximum(np.bincount(doc, minlength=n), 1)
    spoken = LOWER[first] | UPPER[first] | (first >= 128)
    short = np.bincount(wdoc, spoken & (size <= 3), n) / np.maximum(np.bincount(wdoc, spoken, n), 1)

    def vote(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
        return np.where(n_words == 0, SILENT, np.where(bad, BAD, np.where(good, GOOD, SILENT)))

    votes = np.stack(
        [
            vote(symbols > 0.2, symbols < 0.02),
            vote(caps > 0.4, caps < 0.2),
            vote(marks > 0.15, marks < 0.01),
            vote(shouts > 0.2, shouts < 0.02),
            vote(lines > 0.3, lines == 0),
            vote(phrases > 0.3, phrases < 0.1),
            vote((stops < 0.02) & (n_words > 30), (stops > 0.04) & (stops < 0.5)),
            vote((short < 0.1) & (n_words > 30), (short > 0.2) & (short < 0.7)),
        ],
        axis=1,
    ).reshape(n, len(LABELLERS))
    # A word's shape: letters and digits by class, with equal neighbours dropped.
    shape = SHAPE[data]
    keep = solid.copy()
    if len(data):
        fresh = np.ones(len(data), bool)
        fresh[1:] = shape[1:] != shape[:-1]
        fresh[starts] = True
        keep &= fresh
    at = np.concatenate([[0], np.cumsum(keep)])
    shapes = run_hashes(shape[keep], at[starts], at[ends])
    dim = np.concatenate([shapes >> np.uint64(64 - HASH_BITS), (words ^ np.uint64(0x5555)) >> np.uint64(64 - HASH_BITS)]).astype(np.int64)
    dim = np.concatenate([dim[: len(shapes)], dim[len(shapes) :] + (1 << HASH_BITS)])
    cell, count = np.unique(np.concatenate([wdoc, wdoc]) << (HASH_BITS + 1) | dim, return_counts=True)
    doc = cell >> (HASH_BITS + 1)
    dim = cell & ((1 << (HASH_BITS + 1)) - 1)
    # Shapes say more than words, which are many and rare.
    value = np.sqrt(count * per_word[doc]) * np.where(dim < 1 << HASH_BITS, 1.0, 0.3)
    # Two more hashed tokens: how much is said again at once, and how much in phrases, by tenths.
    echo = np.zeros(len(words), bool)
    echo[1:] = (words[1:] == words[:-1]) & (wdoc[1:] == wdoc[:-1])
    tenth = np.stack([np.minimum(np.bincount(wdoc, echo, n) * per_word * 10, 9), np.minimum(phrases * 10, 9) + 10]).astype(np.int64)
    some = np.flatnonzero(n_words)
    extra = (2 << HASH_BITS) + tenth[:, some].reshape(-1)
    doc, dim, value = np.concatenate([doc, some, some]), np.concatenate([dim, extra]), np.concatenate([value, np.ones(len(extra))])
    order = np.argsort(doc, kind="stable")
    return votes, (doc[order], dim[order], value[order])


def reliabilities(patterns: np.ndarray, n: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """EM over labellers independent given the truth: posterior of good for each pattern, and P(vote | truth)."""
    # A start in which each bad vote counts: kinds of bad text differ, and no labeller knows more than one or two.
    post = np.array([0.97, 0.3, 0.05])[np.minimum((patterns == BAD).sum(1), 2)]
    theta = np.zeros((patterns.shape[1], 2, 3))
    for _ in range(rounds):
        prior = float((n * post).sum() + 1) / float(n.sum() + 2)
        for j in range(patterns.shape[1]):
            for y, p in ((0, 1 - post), (1, post)):
                got = np.bincount(patterns[:, j], n * p, 3) + np.array([0.2, 0.2, 0.2])
                theta[j, y] = got / got.sum()
        logp = np.log([1 - prior, prior])[None, :] + sum(np.log(theta[j][:, patterns[:, j]]).T for j in range(patterns.shape[1]))
        post = 1 / (1 + np.exp(np.clip(logp[:, 0] - logp[:, 1], -50, 50)))
    return post, theta


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    codes: np.ndarray  #: known vote patterns, sorted
    posterior: np.ndarray


def code(votes: np.ndarray) -> np.ndarray:
    return votes @ (3 ** np.arange(votes.shape[1]))


def fit(text: pa.Array, codes: np.ndarray, posterior: np.ndarray, cfg: Config) -> Model:
    """AdaGrad over shuffled minibatches of the sample."""
    w, b = np.zeros((2 << HASH_BITS) + 20), 0.0
    if not len(codes):
        return Model(w, b, codes, posterior)
    # In slices, so that the driver's working arrays stay small.
    parts = [(i, *look(text.slice(i, j - i))) for i, j in chunks(utf8(text)[1])]
    if not parts:
        return Model(w, b, codes, posterior)
    votes = np.concatenate([v for _, v, _ in parts])
    doc, dim, value = (np.concatenate([f[k] + (i if k == 0 else 0) for i, _, f in parts]) for k in range(3))
    y = posterior[np.searchsorted(codes, code(votes))]
    n = len(text)
    first = np.searchsorted(doc, np.arange(n + 1))
    g2, gb2, rng = np.full(len(w), 1e-2), 1e-2, np.random.default_rng(3)
    for _ in range(cfg.epochs):
        order = rng.permutation(n)
        for i in range(0, n, 64):
            rows = order[i : i + 64]
            size = first[rows + 1] - first[rows]
            at = np.repeat(first[rows], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            owner = np.repeat(np.arange(len(rows)), size)
            p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, w[dim[at]] * value[at], len(rows)) + b, -30, 30)))
            d = (p - y[rows]) / len(rows)
            g = np.bincount(dim[at], d[owner] * value[at], len(w)) + cfg.ridge * w
            g2 += g * g
            gb2 += d.sum() ** 2
            w -= cfg.rate * 0.2 * g / np.sqrt(g2)
            b -= cfg.rate * 0.2 * d.sum() / np.sqrt(gb2)
    return Model(w, b, codes, posterior)


def train(docs: DataFrame, cfg: Config = Config()) -> tuple[Model, np.ndarray]:
    """The model, and the labellers' estimated P(vote | truth)."""

    def run(it):
        for rb in batches(it):
            c, n = np.unique(code(look(rb.column(0))[0]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(n, pa.int64())], names=["code", "n"])

    rows = docs.select("text").mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").collect()
    codes, n = np.array([r["code"] for r in rows], np.int64), np.array([r["n"] for r in rows], float)
    if not len(codes):
        return fit(pa.array([], pa.string()), codes, n, cfg), np.zeros((0, 2, 3))
    patterns = codes[:, None] // 3 ** np.arange(len(LABELLERS))[None, :] % 3
    post, theta = reliabilities(patterns, n, cfg.rounds)
    total = int(n.sum())
    grain = 1 << 30
    part = docs.select("doc_id", "text").filter(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(31)), F.lit(grain)) < int(grain * min(1.0, cfg.sample_size / total)))
    # Hashes and sizes first, boundedly many; then the texts that fit into the budget.
    part = part.withColumn("h", F.xxhash64("doc_id", "text"))
    sized = part.groupBy("h").agg(F.first(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size")).orderBy("h").limit(2 * cfg.sample_size).collect()
    size = np.cumsum([r["size"] for r in sized])
    few = docs.sparkSession.createDataFrame([(r["h"],) for r, s in zip(sized, size, strict=True) if s <= cfg.sample_bytes], "h bigint")
    got = part.join(F.broadcast(few), "h").dropDuplicates(["h"]).collect()
    sample = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in got))
    return fit(pa.array([t for *_, t in sample], pa.large_string()), codes, post, cfg), theta


def score(docs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """doc_id, score (higher: better), predicted (1: good), and the posterior of the labellers' votes alone."""
    model, _ = train(docs, cfg)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(it):
        m = shared.value
        for rb in batches(it):
            votes, (doc, dim, value) = look(rb.column(1))
            z = np.bincount(doc, m.weights[dim] * value, rb.num_rows) + m.bias
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            weak = m.posterior[np.searchsorted(m.codes, code(votes))]
            cols = [rb.column(0), pa.array(p), pa.array((p >= cfg.threshold).astype(np.int32)), pa.array(weak)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "score", "predicted", "weak_label"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double, predicted int, weak_label double")
