"""Toxicity from the nearest labelled examples by exact TF-IDF cosine, found through a block-max inverted index.

Examples are a bounded sample of the labelled training rows, at most `per_class` of each label and `sample_bytes` of text,
drawn by a hash of the id.  Terms are lower-cased runs of letters and digits and the first five bytes of longer
ones; the vector space keeps those that at least `min_df` examples
hold and whose presence depends on the label (chi-square of at least `chi2`), so that function words and chance words do
not decide about neighbourhood; with `min_df` 1 and `chi2` 0 it keeps them all.  Cosines in that space are exact: the index stores
for each term and block of examples the greatest weight, blocks are visited by their upper bound, and the search ends
only when no remaining block can hold a better neighbour.

The neighbours' labels vote with weight 1 / (1 - cosine + eps), scaled to the classes' shares in all labelled rows; the
vote is calibrated by a logistic fit on the examples' own leave-one-out votes.  Evidence is the nearest examples' ids.

Edge cases: a null or empty text, or one without a known term, has no neighbours and gets the calibrated prior of such
texts; without labelled rows of both classes the score is the labels' mean, or 0 without any; contradicting labels of
an id count as toxic; of an id's texts one is an example; equal cosines go by id; repeated rows score alike; a very long
text is one longer query; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pantrylake.llm.common import batches, chunks, crc_mod, run_hashes, spans, utf8

WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(97, 123)]] = True
WORD[128:] = True


PREFIX = 5  #: bytes


@dataclass(frozen=True)
class Config:
    per_class: int = 3000  #: bound of the sample
    min_df: int = 3
    chi2: float = 20.0
    sample_bytes: int = 64 << 20
    block: int = 64
    k: int = 10
    eps: float = 0.05
    shrink: float = 1.0
    threshold: float = 0.3


def terms(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every term: words, and the beginnings of longer ones."""
    data, off = utf8(pc.utf8_lower(pc.fill_null(text.cast(pa.large_string()), "")))
    starts, ends, woff = spans(WORD[data], off)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(woff))
    long = np.flatnonzero(ends - starts > PREFIX)
    heads = run_hashes(data, starts[long], starts[long] + PREFIX) ^ np.uint64(0xA5A5A5A5)
    return np.concatenate([run_hashes(data, starts, ends), heads]), np.concatenate([doc, doc[long]])


def counted(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, term) pairs, by document, with counts."""
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])) if len(h) else np.zeros(0, np.int64)
    return d[first], h[first], np.diff(np.append(first, len(h)))


def term_counts(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As counted, over slices of the texts, so that the working arrays stay small however many texts there are."""
    _, off = utf8(text)
    parts = []
    for i, j in chunks(off):
        h, d = terms(text.slice(i, j - i))
        d, h, n = counted(h, d)
        parts.append((d + i, h, n))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


class Index:
    """Block-max inverted index of the examples' unit vectors."""

    def __init__(self, vocab: np.ndarray, idf: np.ndarray, ids: np.ndarray, labels: np.ndarray, doc, term, tf, cfg: Config):
        self.vocab, self.idf, self.cfg = vocab, idf, cfg
        w = (1 + np.log(tf)) * idf[term]
        norm = np.sqrt(np.bincount(doc, w * w, len(ids)))
        w = w / norm[doc]
        # Examples that share their heaviest term and label stand together, so that blocks differ and bounds are tight.
        heavy = np.full(len(ids), -1)
        order = np.argsort(w, kind="stable")
        heavy[doc[order]] = term[order]
        place = np.empty(len(ids), np.int64)
        row = np.lexsort((ids, labels, heavy))
        place[row] = np.arange(len(ids))
        self.ids, self.labels = ids[row], labels[row]
        order = np.lexsort((place[doc], term))
        self.at, self.w = place[doc][order], w[order]
        n_blocks = -(-len(ids) // cfg.block) if len(ids) else 0
        cell = term[order] * n_blocks + self.at // cfg.block
        self.first = np.searchsorted(cell, np.arange(len(vocab) * n_blocks + 1)).reshape(-1)
        self.most = np.zeros(len(vocab) * n_blocks)
        np.maximum.at(self.most, cell, self.w)
        self.most = self.most.reshape(len(vocab), n_blocks)
        self.n_blocks = n_blocks

    def nearest(self, term: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples with a positive cosine; q is a unit vector."""
        if not self.n_blocks or not len(term):
            return np.zeros(0, np.int64), np.zeros(0)
        bound = q @ self.most[term]
        order = np.argsort(-bound, kind="stable")
        got_at, got_sim, kth = [], [], 0.0
        size = self.cfg.block
        for b in order.tolist():
            if bound[b] <= 0 or bound[b] < kth - 1e-9:
                break
            acc = np.zeros(size)
            for t, x in zip(term.tolist(), q.tolist(), strict=True):
                i, j = self.first[t * self.n_blocks + b], self.first[t * self.n_blocks + b + 1]
                if i < j:
                    acc[self.at[i:j] - b * size] += x * self.w[i:j]
            on = np.flatnonzero(acc > max(0.0, kth - 1e-9))
            got_at.append(on + b * size)
            got_sim.append(acc[on])
            if sum(map(len, got_sim)) >= k:
                at, sim = np.concatenate(got_at), np.concatenate(got_sim)
                best = np.lexsort((self.ids[at], -np.round(sim, 9)))[:k]
                got_at, got_sim = [at[best]], [sim[best]]
                kth = float(sim[best].min())
        if not got_at:
            return np.zeros(0, np.int64), np.zeros(0)
        at, sim = np.concatenate(got_at), np.concatenate(got_sim)
        best = np.lexsort((self.ids[at], -np.round(sim, 9)))[:k]
        return at[best], sim[best]

    def queries(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each text the slice of its terms, the terms, and their unit weights."""
        n = len(text)
        if not len(self.vocab):
            return np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(0, np.int64), np.zeros(0)
        doc, h, tf = term_counts(text)
        at = np.searchsorted(self.vocab, h)
        at[at == len(self.vocab)] = 0
        hit = self.vocab[at] == h
        doc, term, tf = doc[hit], at[hit], tf[hit]
        w = (1 + np.log(tf)) * self.idf[term]
        w = w / np.sqrt(np.bincount(doc, w * w, n))[doc]
        return np.searchsorted(doc, np.arange(n)), np.searchsorted(doc, np.arange(1, n + 1)), term, w


@dataclass
class Model:
    index: Index
    class_weight: np.ndarray
    prior: float
    fit: np.ndarray | None  #: logistic weights of (1, vote's logit, whether there are neighbours); None: the prior is the score

    def vote(self, at: np.ndarray, sim: np.ndarray) -> float:
        cfg = self.index.cfg
        y = self.index.labels[at]
        w = self.class_weight[y] / (1 - np.minimum(sim, 1) + cfg.eps)
        return float((w @ y + cfg.shrink * self.prior) / (w.sum() + cfg.shrink))

    def features(self, votes: np.ndarray, some: np.ndarray) -> np.ndarray:
        v = np.clip(votes, 1e-4, 1 - 1e-4)
        return np.stack([np.ones(len(v)), np.log(v / (1 - v)), some], axis=1)

    def score(self, text: pa.Array, evidence: int = 3) -> tuple[np.ndarray, list[list[int]]]:
        lo, hi, term, w = self.index.queries(text)
        votes, some, why = np.full(len(lo), self.prior), np.zeros(len(lo)), []
        for i in range(len(lo)):
            at, sim = self.index.nearest(term[lo[i] : hi[i]], w[lo[i] : hi[i]], self.index.cfg.k)
            if len(at):
                votes[i], some[i] = self.vote(at, sim), 1
            why.append(self.index.ids[at[:evidence]].tolist())
        if self.fit is None:
            return votes, why
        return 1 / (1 + np.exp(-np.clip(self.features(votes, some) @ self.fit, -30, 30))), why


def examples(docs: DataFrame, labels: DataFrame, cfg: Config) -> tuple[list, dict[int, int]]:
    """(doc_id, text, label) of the sample, and how many training rows each label has."""
    known = labels.select("doc_id", "toxic").filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (crc_mod("doc_id", 4) != 2))
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("label"))
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    # Rows of an id and a size, boundedly many; then the texts that fit into the budget, half of it for each label.
    sized = docs.select("doc_id", F.xxhash64("text").alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).join(known, "doc_id")
    sized = sized.groupBy("doc_id", "label").agg(F.min(F.struct("h", "size")).alias("one"))
    chosen = []
    for label in sorted(totals):
        room = cfg.sample_bytes // 2
        for r in sized.filter(F.col("label") == label).orderBy(F.xxhash64(F.col("doc_id"), F.lit(21)), "doc_id").limit(cfg.per_class).collect():
            if r["one"]["size"] <= room:
                room -= r["one"]["size"]
                chosen.append((r["doc_id"], r["one"]["h"], label))
    few = F.broadcast(docs.sparkSession.createDataFrame(chosen, "doc_id bigint, h bigint, label int"))
    got = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).join(few, ["doc_id", "h"]).dropDuplicates(["doc_id", "h"])
    return sorted(((r["doc_id"], r["text"], r["label"]) for r in got.collect()), key=lambda r: r[0]), totals


def train(rows: list[tuple[int, str | None, int]], totals: dict[int, int], cfg: Config = Config()) -> Model:
    ids = np.array([r[0] for r in rows], np.int64)
    y = np.array([r[2] for r in rows], np.intp)
    text = pa.array([r[1] for r in rows], pa.large_string())
    n = len(rows)
    total = sum(totals.values())
    prior = totals.get(1, 0) / total if total else 0.0
    doc, term, tf = term_counts(text)
    vocab, inverse = np.unique(term, return_inverse=True)
    df = np.bincount(inverse, minlength=len(vocab)).astype(float)
    pos = np.bincount(inverse, y[doc], len(vocab)) if n else df
    n1 = float(y.sum())
    chi = np.zeros(len(vocab))
    if 0 < n1 < n:
        a, b, c, d = pos, df - pos, n1 - pos, n - n1 - (df - pos)
        chi = n * (a * d - b * c) ** 2 / np.maximum((a + b) * (c + d) * n1 * (n - n1), 1e-9)
    keep = np.flatnonzero((df >= cfg.min_df) & (chi >= cfg.chi2))
    new = np.full(len(vocab), -1)
    new[keep] = np.arange(len(keep))
    on = new[inverse] >= 0 if len(vocab) else np.zeros(0, bool)
    idf = np.log((n + 1) / (df[keep] + 1)) + 1
    index = Index(vocab[keep], idf, ids, y, doc[on], new[inverse[on]] if len(vocab) else doc[on], tf[on], cfg)
    sampled = np.bincount(y, minlength=2).astype(float)
    weight = np.array([totals.get(c, 0) / sampled[c] if sampled[c] else 0.0 for c in (0, 1)])
    weight = weight / weight.max() if weight.max() > 0 else weight + 1
    model = Model(index, weight, prior, None)
    if not 0 < n1 < n:
        return model
    lo, hi, qt, qw = index.queries(text)
    votes, some = np.full(n, prior), np.zeros(n)
    for i in range(n):
        at, sim = index.nearest(qt[lo[i] : hi[i]], qw[lo[i] : hi[i]], cfg.k + 1)
        other = index.ids[at] != ids[i]
        at, sim = at[other][: cfg.k], sim[other][: cfg.k]
        if len(at):
            votes[i], some[i] = model.vote(at, sim), 1
    x, w, share = model.features(votes, some), np.zeros(3), weight[y] / weight[y].sum()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (share * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-4 * np.eye(3), x.T @ (share * (p - y)) + 1e-4 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    model.fit = w
    return model


def score(docs: DataFrame, labels: DataFrame, cfg: Config = Config()) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence (ids of the nearest examples) for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(train(*examples(docs, labels, cfg), cfg))

    def run(it):
        for rb in batches(it):
            p, why = shared.value.score(rb.column(1))
            cols = [rb.column(0), rb.column(2), pa.array(p, pa.float64()), pa.array((p >= cfg.threshold).astype(np.int32)), pa.array(why, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "score", "predicted", "evidence"])

    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    return docs.select("doc_id", "text", held.alias("held_out")).mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int, evidence array<bigint>")
