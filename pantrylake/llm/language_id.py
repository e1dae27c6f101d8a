"""Language identification by a byte convolutional network written in numpy.

Every text is lower-cased, cut into fixed-length byte windows (the last one padded), and each window goes through
convolutions of several widths, a ReLU, max pooling over positions and a softmax; a document's distribution is the
normalised product of its windows' distributions.  The network is fitted on the driver over a bounded sample: at most
`per_lang` windows for each language, drawn by a hash of the id, from the training rows only; every language of those
rows is learnt.  A letter is a character of a Unicode category L.

Edge cases: a null or empty text, or one without a letter, is `und` with score 0; a table without usable training
rows makes every row `und`; equal probabilities go to the first language by name; repeated rows are predicted alike;
any other columns of the input are ignored; a very long text is read to its end, window by window; an empty table gives
no rows.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pantrylake.llm.common import batches, crc_mod, utf8

UNKNOWN = "und"
STEP = 16  #: windows that go through the network together; their activations stay in the cache


@dataclass(frozen=True)
class Config:
    window: int = 256
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 8
    embed: int = 8
    per_lang: int = 700  #: bound of the training sample, windows for each language
    epochs: int = 6
    batch: int = 32
    rate: float = 0.01
    seed: int = 7


@dataclass
class Model:
    langs: list[str]
    cfg: Config
    emb: np.ndarray  #: (256, embed)
    conv: np.ndarray  #: (longest width * embed, all filters); shorter widths have zeros below
    bias: np.ndarray
    out_w: np.ndarray
    out_b: np.ndarray

    def window_logits(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Logits of the windows data[starts:ends]; each is at most cfg.window bytes."""
        L, n = self.cfg.window, len(starts)
        idx = starts[:, None] + np.arange(L)[None, :]
        x = data.take(idx, mode="clip")
        x[idx >= ends[:, None]] = 0
        e = self.emb.take(x, axis=0)
        size, wide = e.strides[1], self.conv.shape[0]
        cols = np.lib.stride_tricks.as_strided(e, (n, L - max(self.cfg.widths) + 1, wide), (e.strides[0], size, e.itemsize))
        acc = np.ascontiguousarray(cols).reshape(-1, wide) @ self.conv
        pooled = np.maximum(acc.reshape(n, -1, self.conv.shape[1]).max(axis=1) + self.bias, 0)
        return pooled @ self.out_w + self.out_b

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and probability of each text."""
        n = len(texts)
        lower = pc.utf8_lower(pc.fill_null(texts, ""))
        data, off = utf8(lower)
        known = has_letter(texts)
        if not self.langs:
            return [UNKNOWN] * n, np.zeros(n)
        L = self.cfg.window
        count = -(-np.diff(off) // L)
        doc = np.repeat(np.arange(n), count)
        first = np.cumsum(count) - count
        starts = off[:-1][doc] + (np.arange(len(doc)) - first[doc]) * L
        ends = np.minimum(starts + L, off[1:][doc])
        total = np.zeros((n, len(self.langs)))
        for i in range(0, len(doc), STEP):
            logits = self.window_logits(data, starts[i : i + STEP], ends[i : i + STEP]).astype(np.float64)
            logits -= logits.max(axis=1, keepdims=True)
            logp = np.maximum(logits - np.log(np.exp(logits).sum(axis=1, keepdims=True)), -20)
            np.add.at(total, doc[i : i + STEP], logp * ((ends - starts)[i : i + STEP] / L)[:, None])
        total -= total.max(axis=1, keepdims=True)
        prob = np.exp(total)
        prob /= prob.sum(axis=1, keepdims=True)
        best = prob.argmax(axis=1)
        score = np.where(known, prob[np.arange(n), best], 0.0)
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], score


def has_letter(texts: pa.Array) -> np.ndarray:
    """Whether each text has a character of a category L; null has none."""
    found = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False).copy()
    # The pattern engine's tables may be older than Python's.
    for i in np.flatnonzero(~found):
        t = texts[int(i)].as_py()
        found[i] = bool(t) and any(unicodedata.category(c)[0] == "L" for c in set(t))
    return found


def gradients(p: dict[str, np.ndarray], bx: np.ndarray, by: np.ndarray, cfg: Config) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy of windows bx with languages by, and its gradient by each parameter (with a little decay on `ow`)."""
    F_, L, wide, n = cfg.filters, cfg.window, max(cfg.widths), len(bx)
    pooled, where = [], []
    for w in cfg.widths:
        acc = 0
        for j in range(w):
            acc = acc + (p["emb"] @ p[f"w{w}"][j])[bx[:, j : L - wide + 1 + j]]
        at = acc.argmax(axis=1)
        pooled.append(np.take_along_axis(acc, at[:, None, :], 1)[:, 0, :] + p[f"b{w}"])
        where.append(at)
    h = np.concatenate(pooled, 1)
    a = np.maximum(h, 0)
    z = a @ p["ow"] + p["ob"]
    z -= z.max(1, keepdims=True)
    q = np.exp(z)
    q /= q.sum(1, keepdims=True)
    loss = float(-np.log(np.maximum(q[np.arange(n), by], 1e-30)).mean() + 5e-5 * (p["ow"] ** 2).sum())
    q[np.arange(n), by] -= 1
    q /= n
    g = {"ow": a.T @ q + 1e-4 * p["ow"], "ob": q.sum(0), "emb": np.zeros_like(p["emb"])}
    dh = (q @ p["ow"].T) * (h > 0)
    for k, w in enumerate(cfg.widths):
        d, at = dh[:, k * F_ : (k + 1) * F_], where[k]
        g[f"b{w}"], gw = d.sum(0), np.zeros_like(p[f"w{w}"])
        for j in range(w):
            got = np.take_along_axis(bx, at + j, 1)  # the byte under each filter's best position
            gw[j] = np.einsum("nf,nfe->ef", d, p["emb"][got])
            np.add.at(g["emb"], got, d[:, :, None] * p[f"w{w}"][j].T[None])
        g[f"w{w}"] = gw
    return loss, g


def train(texts: list[str], labels: list[str], cfg: Config = Config()) -> Model:
    """Fits the network with Adam on one window of each text."""
    langs = sorted(set(labels))
    of = {x: i for i, x in enumerate(langs)}
    F_, E, L = cfg.filters, cfg.embed, cfg.window
    rng = np.random.default_rng(cfg.seed)
    y = np.array([of[x] for x in labels], dtype=np.intp)
    x = np.zeros((len(texts), L), dtype=np.intp)
    for i, t in enumerate(texts):
        raw = np.frombuffer(t.lower().encode()[:L], np.uint8)
        x[i, : len(raw)] = raw
    p = {"emb": rng.normal(0, 0.5, (256, E))}
    for w in cfg.widths:
        p[f"w{w}"] = rng.normal(0, 1 / np.sqrt(w * E), (w, E, F_))
        p[f"b{w}"] = np.zeros(F_)
    width, wide = F_ * len(cfg.widths), max(cfg.widths)
    p["ow"], p["ob"] = rng.normal(0, 1 / np.sqrt(width), (width, max(1, len(langs)))), np.zeros(max(1, len(langs)))
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    for epoch in range(cfg.epochs if len(langs) > 1 else 0):
        order = rng.permutation(len(x))
        for s in range(0, len(x), cfg.batch):
            rows = order[s : s + cfg.batch]
            _, g = gradients(p, x[rows], y[rows], cfg)
            step += 1
            rate = cfg.rate * (1 - 0.9 * epoch / cfg.epochs)
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    conv = np.zeros((wide * E, width), np.float32)
    for k, w in enumerate(cfg.widths):
        conv[: w * E, k * F_ : (k + 1) * F_] = p[f"w{w}"].reshape(w * E, F_)
    return Model(langs, cfg, p["emb"], conv, np.concatenate([p[f"b{w}"] for w in cfg.widths]), p["ow"], p["ob"])


def sample(docs: DataFrame, cfg: Config) -> tuple[list[str], list[str]]:
    """At most about per_lang windows of each language from the training rows; which ones depends on the id alone."""
    rows = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod("doc_id", 3) != 1))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], []
    grain = 1 << 30
    share = docs.sparkSession.createDataFrame([(k, int(grain * min(1.0, cfg.per_lang / n))) for k, n in counts.items()], "lang string, share bigint")
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(grain))
    start = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(12)), F.greatest(F.lit(1), F.length("text") - F.lit(cfg.window)))
    got = (
        rows.join(F.broadcast(share), "lang").filter(draw < F.col("share"))
        .select("lang", F.col("doc_id").alias("id"), F.col("text").substr((start + 1).cast("int"), F.lit(cfg.window)).alias("piece"))
        .orderBy("lang", "id", "piece")
        .limit(2 * cfg.per_lang * len(counts))
        .collect()
    )
    return [r["piece"] for r in got], [r["lang"] for r in got]


def model_of(docs: DataFrame, cfg: Config):
    """The network fitted to the sample of docs, broadcast."""
    return docs.sparkSession.sparkContext.broadcast(train(*sample(docs, cfg), cfg))


def identify(docs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs(doc_id, text, lang)."""
    shared = model_of(docs, cfg)

    def run(it):
        for rb in batches(it):
            pred, score = shared.value.predict(rb.column(1))
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(2), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    return docs.select("doc_id", "text", held.alias("held_out")).mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, cfg: Config = Config(), min_score: float = 0.3) -> DataFrame:
    """The rows of docs whose language is identified, with all their columns; a missing lang is filled in."""
    shared = model_of(docs, cfg)
    text, lang = docs.columns.index("text"), docs.columns.index("lang")

    def run(it):
        for rb in batches(it):
            pred, score = shared.value.predict(rb.column(text))
            filled = pc.coalesce(rb.column(lang), pa.array(pred, rb.column(lang).type))
            out = pa.RecordBatch.from_arrays([filled if i == lang else c for i, c in enumerate(rb.columns)], names=rb.schema.names)
            yield out.filter(pa.array([p != UNKNOWN and q >= min_score for p, q in zip(pred, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
