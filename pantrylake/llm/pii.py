"""Personal data by weak supervision: labellers vote on candidate spans, expectation-maximisation weighs the labellers,
and a span classifier fitted on the posteriors decides about every candidate that is not already certain.

Base spans (email, ip, card, phone) follow fixed patterns and checks, leftmost and non-overlapping for each kind; they
always stay.  Looser candidates of the same sorts (dotted hosts missing, bare or wrong-length numbers, spelled-out
addresses, dashed identity numbers) are added when the classifier gives them at least `accept`.

Only counts by vote and feature pattern leave the executors; their number is bounded by the labellers and features, not
by the data, so EM and the classifier's fit run on the driver over a table of fixed size.

Edge cases: null and empty texts have no spans; a table without candidates yields a classifier that adds nothing;
repeated documents are each reported; scans are linear in the text, also for very long runs of one character; other
columns are ignored by `find` and kept by `redact`.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pantrylake.llm.common import batches

BASE = ("email", "ip", "card", "phone")
LOOSE = ("email_like", "ip_like", "card_like", "phone_like", "national_id")
KINDS = (*BASE, *LOOSE)
RANK = {k: i for i, k in enumerate(KINDS)}

LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
#: A match can only begin where a run of digits begins, so the look-behind changes nothing but the running time.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
HINT = re.compile(r"[0-9@]|\bdot\b")

LOOSE_PATTERNS = (
    ("email_like", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?:@[A-Za-z0-9-]{1,63}|(?: ?\[at\] ?| \(at\) | at )[A-Za-z0-9-]{1,63}(?:(?: ?\[dot\] ?| \(dot\) | dot )[A-Za-z0-9-]{1,63}){1,4})")),
    ("ip_like", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
    ("national_id", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("phone_like", re.compile(r"(?<![0-9+])(?:\([0-9]{3}\)|[0-9]{3})[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")),
    ("card_like", re.compile(r"(?<![0-9])[0-9]{4}(?:[\x20-]?[0-9]{4}){2}[\x20-]?[0-9]{1,4}(?![0-9])")),
)
SUFFIXES = frozenset("com org net edu gov io co de fr es uk us info eu example local".split())
FOR_WORDS = re.compile(r"(?i)\b(?:e-?mail|mail|contact|write|phone|tel|telephone|mobile|cell|call|fax|card|visa|credit|payment|ip|host|address|server|ssn|social security|passport|id number)\b")
AGAINST_WORDS = re.compile(r"(?i)\b(?:version|release|isbn|issn|order|invoice|part|section|figure|page|serial|sku|ticket)\b")
CONTEXT = 40
VOTES = 3  #: against, none, for


@dataclass(frozen=True)
class Config:
    accept: float = 0.5
    rounds: int = 50


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(ch for ch in s if "0" <= ch <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the certain spans, by start and then by kind."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        if at >= done:
            s = at
            while s > done and text[s - 1] in LOCAL_CHARS:
                s -= 1
            if s < at and (m := DOMAIN.match(text, at + 1)):
                out.append((s, m.end(), "email"))
                done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        if len(m[0]) >= 12 and 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(digits_of(m[0])) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda x: (x[0], RANK[x[2]], x[1]))


def loose_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Candidates that overlap neither a base span nor an earlier candidate."""
    taken, out = sorted((s, e) for s, e, _ in base), []
    found = sorted(((m.start(), m.end(), kind) for kind, p in LOOSE_PATTERNS for m in p.finditer(text)), key=lambda x: (x[0], RANK[x[2]]))
    i = last = 0
    for s, e, kind in found:
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if s >= last and not (i < len(taken) and taken[i][0] < e):
            out.append((s, e, kind))
            last = e
    return out


def pattern(text: str, span: tuple[int, int, str]) -> tuple[int, ...]:
    """The labellers' votes (shape check, gazetteer, words around for and against, regularity), then the features."""
    s, e, kind = span
    body, around = text[s:e], text[max(0, s - CONTEXT) : s] + " " + text[e : e + CONTEXT // 2]
    d = digits_of(body)
    if kind in BASE:
        shape = 2
    elif kind == "card_like":
        shape = 0
    else:
        shape = 1 if kind == "email_like" else 2
    if kind.startswith("email"):
        tail = re.split(r"[^A-Za-z0-9]+", body.lower())
        listed = 2 if tail[-1] in SUFFIXES and len(tail) > 2 else 1 if kind == "email" else 0
    elif kind.startswith("card"):
        listed = 2 if d[:1] in ("4", "5", "6", "2") or d[:2] in ("34", "37") else 0
    elif kind == "ip":
        listed = 0 if d.startswith("0") else 1
    else:
        listed = 1
    for_, against = 2 if FOR_WORDS.search(around) else 1, 0 if AGAINST_WORDS.search(around) else 1
    regular = 0 if d and (len(set(d)) <= 2 or d in "01234567890123456789") else 1
    marks = sum(not ch.isalnum() for ch in body)
    return (shape, listed, for_, against, regular, RANK[kind], min(len(d) // 3, 6), min(marks, 5), int(for_ == 2), int(against == 0))


N_LABELLERS = 5
FEATURE_SIZES = (len(KINDS), 7, 6, 2, 2)


def one_hot(feats: np.ndarray) -> np.ndarray:
    x = np.zeros((len(feats), 1 + sum(FEATURE_SIZES)))
    x[:, 0] = 1
    at = 1
    for j, size in enumerate(FEATURE_SIZES):
        x[np.arange(len(feats)), at + feats[:, j]] = 1
        at += size
    return x


def reliabilities(votes: np.ndarray, n: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over labellers that are independent given the truth: posteriors, P(vote | truth) and the prior."""
    post = np.clip(0.5 + (votes - 1).sum(axis=1) / 4, 0.05, 0.95)
    theta, prior = np.full((votes.shape[1], 2, VOTES), 1 / VOTES), 0.5
    for _ in range(rounds):
        prior = float((n * post).sum() + 1) / float(n.sum() + 2)
        for j in range(votes.shape[1]):
            for y, p in ((0, 1 - post), (1, post)):
                got = np.bincount(votes[:, j], n * p, VOTES) + 1
                theta[j, y] = got / got.sum()
        logp = np.log([1 - prior, prior])[None, :] + sum(np.log(theta[j][:, votes[:, j]]).T for j in range(votes.shape[1]))
        post = 1 / (1 + np.exp(np.clip(logp[:, 0] - logp[:, 1], -50, 50)))
    return post, theta, prior


def fit(patterns: np.ndarray, n: np.ndarray, cfg: Config) -> np.ndarray:
    """Weights of the span classifier, a logistic regression on the posteriors of EM."""
    width = 1 + sum(FEATURE_SIZES)
    if not len(patterns):
        return np.concatenate([[-10.0], np.zeros(width - 1)])
    post, _, _ = reliabilities(patterns[:, :N_LABELLERS], n, cfg.rounds)
    x, w, share = one_hot(patterns[:, N_LABELLERS:]), np.zeros(width), n / n.sum()
    for _ in range(60):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (share * (p - post)) + 1e-3 * w
        h = (x * (share * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-3 * np.eye(width)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def probability(w: np.ndarray, patterns: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-one_hot(patterns[:, N_LABELLERS:]) @ w))


def learn(docs: DataFrame, cfg: Config = Config()) -> np.ndarray:
    """Counts every candidate of every document by pattern, then fits."""
    names = [f"p{i}" for i in range(N_LABELLERS + len(FEATURE_SIZES))]

    def run(it):
        counts: dict[tuple[int, ...], int] = {}
        for rb in it:
            for text in rb.column(0).to_pylist():
                if text and HINT.search(text):
                    base = base_spans(text)
                    for span in base + loose_spans(text, base):
                        p = pattern(text, span)
                        counts[p] = counts.get(p, 0) + 1
        if counts:
            cols = [pa.array([k[i] for k in counts], pa.int32()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(list(counts.values()), pa.int64())], names=[*names, "n"])

    rows = docs.select("text").mapInArrow(run, ", ".join(f"{x} int" for x in names) + ", n bigint").groupBy(*names).agg(F.sum("n").alias("n")).orderBy(*names).collect()
    got = np.array([list(r) for r in rows], dtype=np.int64).reshape(-1, len(names) + 1)
    return fit(got[:, :-1], got[:, -1].astype(float), cfg)


def spans_of(text: str | None, w: np.ndarray, cfg: Config) -> tuple[list, list]:
    """Base spans, and base and accepted spans together, both in order."""
    if not text or not HINT.search(text):
        return [], []
    base = base_spans(text)
    loose = loose_spans(text, base)
    if loose:
        p = probability(w, np.array([pattern(text, s) for s in loose]))
        loose = [s for s, q in zip(loose, p, strict=True) if q >= cfg.accept]
    return base, sorted(base + loose, key=lambda x: (x[0], RANK[x[2]], x[1]))


def find(docs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """doc_id, base and spans, arrays of (kind, start, end) in code points."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, cfg))
    span = "array<struct<kind:string,start:int,end:int>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(it):
        for rb in it:
            got = [spans_of(t, shared.value, cfg) for t in rb.column(1).to_pylist()]
            cols = [pa.array([[{"kind": k, "start": s, "end": e} for s, e, k in g[i]] for g in got], kind) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([rb.column(0), *cols], names=["doc_id", "base", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id bigint, base {span}, spans {span}")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base spans by kind, the hash of their listing, and the listing of all spans."""

    def listing(c: str):
        return F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def number(kind: str):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(k) for k in BASE]
    return found.select("doc_id", *counts, F.sha2(listing("base"), 256).alias("base_sha256"), listing("spans").alias("spans"))


def redact(docs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """docs with every span replaced by its kind in brackets; n_chars follows the new text."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, cfg))
    at = docs.columns.index("text")

    def cover(text: str | None) -> str | None:
        if not text:
            return text
        out, last = [], 0
        for s, e, kind in spans_of(text, shared.value, cfg)[1]:
            if e > last:
                out += [text[last : max(s, last)], f"[{kind.upper()}]"]
                last = e
        return "".join([*out, text[last:]]) if out else text

    def run(it):
        for rb in batches(it):
            text = pa.array([cover(t) for t in rb.column(at).to_pylist()], rb.column(at).type)
            yield pa.RecordBatch.from_arrays([text if i == at else c for i, c in enumerate(rb.columns)], names=rb.schema.names)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def sha(listing: str) -> str:
    return hashlib.sha256(listing.encode()).hexdigest()
