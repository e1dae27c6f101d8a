"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

Words are lower-cased runs without white space; a shingle is five words (the whole text when it has fewer).  A
shingle's weight is 1 + ln(its count in the text) times idf.  idf is 2 for shingles that few documents hold, and falls to 1
for one that all hold: 1 + ln(N / df) / ln(N / limit), where a shingle is frequent if df is over limit, a 16,384th of the
summed sizes of all documents' sets of shingles.  So at every corpus size frequent means held by the same share of documents
(about one in 65, if texts have 250 shingles), weights are the same, and fewer than 16,384 shingles are frequent.
Their df is counted exactly; which may be frequent is told by counts in 2^18 hash buckets, which bound df from above.

Each text gets `bands * rows` samples by these weights and is banded.  A pair counts as linked only if its exact weighted
Jaccard similarity, by the same weights, is at least the threshold.  At a similarity of 0.8 a pair shares a band with
probability 0.9994 at every corpus size.

Groups stay nearly linear: equal texts collapse to one node, named by its least 64-bit text hash; within a band's bucket
all members are compared with the least one.  Where a bucket is left with members of different classes, they are compared
with its centre, the member that holds the least share alone, and then those with each other whose similarity isn't ruled
out by an exact bound: one minus weighted Jaccard is a metric, so members whose similarities to a third differ by more
than 1 - threshold are too far apart; what a text alone holds (shingles that no other open text has) can't be shared with
anyone; and in each of 64 groups of shingles two texts share at most the lesser of their weights.  So every pair that
shares a bucket is compared, is in one class already, or is proven to be below the threshold.  Keys with very many rows (copies of one text, one large class) are
joined by broadcast, of which there are boundedly many (`spread_join`).

Edge cases: a null, empty or white-space text is alone in its class; equal texts share a class whatever their length;
repeated rows are each returned; one id may stand for several texts, each of which is classed by itself; a row without id
gets the least id of its class, else null; a very long text is one more node; an empty table gives no rows; other columns
are ignored by `classes` and kept by `keep_one`, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pantrylake.llm.common import batches, checkpointed, fresh, id_test, mix, release, shingles, spread_join, utf8, words_of
from pantrylake.llm.graph import components

DF_BITS = 18
FREQUENT = 1 << 14  #: fewer shingles than this are frequent
TOKEN = np.uint64((1 << 48) - 1)
GROUPS = 64  #: of shingles, by hash, in the bound on what two texts share
DRAWS = 1 << 16  #: of each variate; a shingle's three are drawn by different bits of its hash, so 2^48 triples in all
LOW = np.uint64(DRAWS - 1)


@dataclass(frozen=True)
class Config:
    k: int = 5
    bands: int = 14
    rows: int = 4
    threshold: float = 0.8


_rng = np.random.Generator(np.random.PCG64(5))
_R = _rng.gamma(2.0, 1.0, DRAWS).astype(np.float32)
_LOG_C = np.log(_rng.gamma(2.0, 1.0, DRAWS)).astype(np.float32)
_BETA = _rng.random(DRAWS).astype(np.float32)
_SALT = (_rng.integers(1, 1 << 63, 256, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def features(text: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document << 48 | 48-bit shingle), their counts, and the word hashes with their document offsets."""
    data, off = utf8(pc.utf8_lower(pc.fill_null(text.cast(pa.large_string()), "")))
    words, woff = words_of(data, off)
    g, doc = shingles(words, woff, k)
    key = np.sort((doc.astype(np.uint64) << np.uint64(48)) | (g >> np.uint64(16)))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.diff(np.append(first, len(key))), first, words, woff


def bucket(key: np.ndarray) -> np.ndarray:
    return (key & np.uint64((1 << DF_BITS) - 1)).astype(np.intp)


@dataclass(frozen=True)
class Idf:
    """Frequent shingles, sorted, and their idf; it is 2 for all others."""

    token: np.ndarray
    value: np.ndarray

    def of(self, key: np.ndarray) -> np.ndarray:
        out = np.full(len(key), 2.0)
        if len(self.token):
            token = key & TOKEN
            at = np.minimum(np.searchsorted(self.token, token), len(self.token) - 1)
            hit = self.token[at] == token
            out[hit] = self.value[at[hit]]
        return out


def weights(key: np.ndarray, tf: np.ndarray, idf: Idf) -> np.ndarray:
    return (1 + np.log(tf)) * idf.of(key)


def rarity(df: np.ndarray, total: float, limit: float) -> np.ndarray:
    """idf of shingles that df of total documents hold."""
    return np.where(df > limit, 1 + np.log(total / np.maximum(df, 1)) / np.log(max(2.0, total / limit)), 2.0)


def frequencies(docs: DataFrame, cfg: Config) -> tuple[Idf, float]:
    """idf by exact df, and the number of documents (2 at least)."""
    in_buckets, total = bucket_counts(docs, cfg)
    limit = max(1.0, in_buckets.sum() / FREQUENT)
    heavy = in_buckets > limit
    if not heavy.any():
        return Idf(np.zeros(0, np.uint64), np.zeros(0)), total
    shared = docs.sparkSession.sparkContext.broadcast(heavy)

    def run(it):
        for rb in batches(it):
            key = features(rb.column(0), cfg.k)[0]
            token, n = np.unique(key[shared.value[bucket(key)]] & TOKEN, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n, pa.int64())], names=["token", "n"])

    # Fewer than FREQUENT rows by the definition of the limit.
    rows = docs.select("text").mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") > limit).orderBy("token").toPandas()
    return Idf(rows.token.to_numpy(np.int64).view(np.uint64), rarity(rows.n.to_numpy(float), total, limit)), total


def bucket_counts(docs: DataFrame, cfg: Config) -> tuple[np.ndarray, float]:
    """df of every bucket and the number of documents, which count once for each shingle that they hold."""

    def run(it):
        got, n = np.zeros(1 << DF_BITS, np.int64), 0
        for rb in batches(it):
            key = features(rb.column(0), cfg.k)[0]
            got += np.bincount(bucket(key), minlength=1 << DF_BITS)
            n += rb.num_rows
        at = np.flatnonzero(got)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(got[at], n), pa.int64())], names=["b", "n"])

    rows = docs.select("text").mapInArrow(run, "b int, n bigint").groupBy("b").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(1 << DF_BITS)
    inside = rows[rows.b >= 0]
    df[inside.b.to_numpy()] = inside.n.to_numpy()
    return df, max(2.0, float(rows[rows.b < 0].n.sum()))


def texts_of(docs: DataFrame, names: DataFrame) -> DataFrame:
    """node and text, once each, for the text hashes in names(node)."""
    texts = docs.select(F.xxhash64("text").alias("node"), "text").filter(id_test(names, "node")("node"))
    return checkpointed(texts.join(names, "node", "left_semi").dropDuplicates(["node"]))


def samples(key: np.ndarray, tf: np.ndarray, idf: Idf, n_docs: int, cfg: Config) -> np.ndarray:
    """(bands * rows, documents) consistent weighted samples as 64-bit codes; documents without shingles have 0."""
    out = np.zeros((cfg.bands * cfg.rows, n_docs), np.uint64)
    if not len(key):
        return out
    doc = (key >> np.uint64(48)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    lens = np.diff(np.append(first, len(doc)))
    rank = np.repeat(np.arange(len(first)), lens)
    h = key & np.uint64((1 << 48) - 1)
    logw = np.log(weights(key, tf, idf)).astype(np.float32)
    for s in range(cfg.bands * cfg.rows):
        x = h * _SALT[s]
        r = _R.take((x >> np.uint64(48)).astype(np.intp))
        beta = _BETA.take((x >> np.uint64(32) & LOW).astype(np.intp))
        t = np.floor(logw / r + beta)
        a = _LOG_C.take((x >> np.uint64(16) & LOW).astype(np.intp)) - r * (t - beta + 1)
        won = np.flatnonzero(a == np.minimum.reduceat(a, first)[rank])
        code = mix(h[won] * _SALT[s] + t[won].astype(np.int64).astype(np.uint64))
        of = rank[won]
        start = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        out[s, doc[first]] = np.minimum.reduceat(code, start)
    return out


def signatures(docs: DataFrame, idf, cfg: Config) -> DataFrame:
    """doc_id, row (hash of id and text), node (hash of the text), the 128-bit hash of its words (null without any) and its band keys."""

    def run(it):
        for rb in batches(it):
            key, tf, _, words, woff = features(rb.column(3), cfg.k)
            n = rb.num_rows
            sig = samples(key, tf, idf.value, n, cfg)
            bands = np.zeros((n, cfg.bands), np.uint64)
            for b in range(cfg.bands):
                acc = np.full(n, b + 1, np.uint64)
                for r in range(cfg.rows):
                    acc = mix(acc * _SALT[100 + r] + sig[b * cfg.rows + r])
                bands[:, b] = acc
            count = np.diff(woff)
            empty = count == 0
            place = (np.arange(len(words)) - np.repeat(woff[:-1], count)).astype(np.uint64)
            ids = []
            for lane in (200, 201):
                got = np.zeros(n, np.uint64)
                if len(words):
                    got[~empty] = np.add.reduceat(mix(words * _SALT[lane] + place), woff[:-1][~empty])
                ids.append(pa.array(mix(got).view(np.int64), pa.int64(), mask=empty))
            flat = pa.array(bands.reshape(-1).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * cfg.bands, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*rb.columns[:3], *ids, lists], names=["doc_id", "row", "node", "k1", "k2", "bands"])

    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), F.xxhash64("text").alias("node"), "text")
    return rows.mapInArrow(run, "doc_id bigint, row bigint, node bigint, k1 bigint, k2 bigint, bands array<bigint>")


def similarities(pairs: DataFrame, held: DataFrame, idf, cfg: Config) -> DataFrame:
    """The weighted Jaccard similarity of each pair (a, b) of nodes, by their texts in held."""
    side = lambda x, text: held.select(F.col("node").alias(x), F.col("text").alias(text))
    both = pairs.join(side("b", "text_b"), "b").join(side("a", "text"), "a")

    def run(it):
        for rb in batches(it):
            n = rb.num_rows
            (ka, ta, *_), (kb, tb, *_) = features(rb.column(2), cfg.k), features(rb.column(3), cfg.k)
            wa, wb = weights(ka, ta, idf.value), weights(kb, tb, idf.value)
            row = lambda k: (k >> np.uint64(48)).astype(np.intp)
            _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
            least = np.bincount(row(ka[ia]), np.minimum(wa[ia], wb[ib]), n)
            union = np.bincount(row(ka), wa, n) + np.bincount(row(kb), wb, n) - least
            sim = np.where(union > 0, least / np.maximum(union, 1e-9), 0.0)
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array(sim)], names=["a", "b", "similarity"])

    return both.select("a", "b", "text", "text_b").mapInArrow(run, "a bigint, b bigint, similarity double")


def labelled(docs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """doc_id, row, k1 (null without words), class_id, and the row that stands for the class: of its least id, then of the least hash."""
    found, n_docs = frequencies(docs, cfg)
    idf, total = docs.sparkSession.sparkContext.broadcast(found), int(n_docs)
    sig = checkpointed(signatures(docs, idf, cfg))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row")).alias("least")
    equal = sig.filter("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.min("node").alias("node"), least, F.count("*").alias("n"), F.first("bands").alias("bands"))
    equal = checkpointed(equal)
    band = equal.select("node", F.posexplode("bands").alias("band", "bucket"))
    lead = band.groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("z"), F.count("*").alias("n")).filter("a < z").select("bucket", "a", "n")
    full = checkpointed(spread_join(band, checkpointed(lead), ["bucket"], total * cfg.bands).drop("n"))
    held = texts_of(docs, checkpointed(full.select("node").distinct()))
    star = checkpointed(similarities(full.filter("node <> a").select("a", F.col("node").alias("b")).distinct(), held, idf, cfg))
    release(docs.sparkSession)
    links = star.filter(F.col("similarity") >= cfg.threshold).select("a", "b")
    comp = components(links)
    near = F.coalesce("similarity", F.lit(1.0)).alias("s")
    apart = _apart(full.join(star.withColumnRenamed("b", "node"), ["a", "node"], "left").select("band", "bucket", "node", near), comp)
    if not apart.isEmpty():
        shared = checkpointed(_shared_weights(checkpointed(apart.select("node").distinct()), held, idf, cfg))
        again = checkpointed(_to_centres(apart, shared, star, held, idf, cfg, total * cfg.bands))
        star = star.unionByName(again).select("a", "b")
        links = links.unionByName(again.filter(F.col("similarity") >= cfg.threshold).select("a", "b"))
        comp = components(links)
        apart = _apart(apart.drop("comp"), comp)
        pairs = checkpointed(_open_pairs(apart, equal.select("node", "bands"), shared, cfg).join(star, ["a", "b"], "left_anti"))
        more = checkpointed(similarities(pairs, held, idf, cfg).filter(F.col("similarity") >= cfg.threshold).select("a", "b"))
        if not more.isEmpty():
            comp = components(links.unionByName(more))
    release(docs.sparkSession)
    of = checkpointed(equal.select("node", "k1", "k2", "n", "least").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    first = checkpointed(of.groupBy("comp").agg(F.min("least").alias("least"), F.count("*").alias("n")))
    named = spread_join(of.select("k1", "k2", F.col("n").alias("rows"), "comp"), first, ["comp"], total)
    named = checkpointed(named.select("k1", "k2", F.col("rows").alias("n"), F.col("least.doc_id").alias("class_id"), F.col("least.row").alias("keeps")))
    mine = spread_join(sig.filter("k1 IS NOT NULL").select("doc_id", "row", "k1", "k2"), named, ["k1", "k2"], total)
    alone = sig.filter("k1 IS NULL").select("doc_id", "row", "k1", F.col("doc_id").alias("class_id"), F.col("row").alias("keeps"))
    return mine.select("doc_id", "row", "k1", "class_id", "keeps").unionByName(alone)


def classes(docs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """doc_id and class_id, the least id of its class, for every row."""
    return labelled(docs, cfg).select("doc_id", "class_id")


def _apart(full: DataFrame, comp: DataFrame) -> DataFrame:
    """band, bucket, node, s (similarity to the bucket's least member) and comp, of buckets that hold several classes."""
    of = full.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    split = of.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y").select("bucket")
    return checkpointed(of.join(split, "bucket").distinct())


def _to_centres(apart: DataFrame, shared: DataFrame, star: DataFrame, held: DataFrame, idf, cfg: Config, total: int) -> DataFrame:
    """Similarities of the members of each bucket to its centre, the one that holds the least share alone, but for pairs in star."""
    share = apart.select("bucket", "node").join(shared.select("node", (F.col("shared") / F.col("total")).alias("share")), "node")
    centre = share.groupBy("bucket").agg(F.max(F.struct("share", "node")).alias("best"), F.count("*").alias("n"))
    centre = checkpointed(centre.select("bucket", F.col("best.node").alias("centre"), "n"))
    both = spread_join(apart.select("bucket", "node"), centre, ["bucket"], total).filter("node <> centre")
    pairs = both.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    return similarities(checkpointed(pairs.join(star, ["a", "b"], "left_anti")), held, idf, cfg)


def _shared_weights(reps: DataFrame, texts: DataFrame, idf, cfg: Config) -> DataFrame:
    """node, its total weight, and the weight of shingles that other reps hold too, in all and by GROUPS groups of shingles."""
    texts = texts.join(reps, "node", "left_semi")

    def run(it):
        for rb in batches(it):
            key, tf, *_ = features(rb.column(1), cfg.k)
            node = rb.column(0).take(pa.array((key >> np.uint64(48)).astype(np.int64)))
            token = (key & TOKEN).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(token), node, pa.array(weights(key, tf, idf.value))], names=["token", "node", "w"])

    def by_group(it):
        for rb in batches(it):
            key, tf, *_ = features(rb.column(1), cfg.k)
            n = rb.num_rows
            place = (key >> np.uint64(48)).astype(np.int64) * GROUPS + (key & np.uint64(GROUPS - 1)).astype(np.int64)
            w = np.bincount(place, weights(key, tf, idf.value), n * GROUPS)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * GROUPS, pa.int32()), pa.array(w))
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(w.reshape(n, GROUPS).sum(1)), lists], names=["node", "total", "held"])

    rows = texts.mapInArrow(run, "token bigint, node bigint, w double")
    lone = rows.groupBy("token").agg(F.count("*").alias("n"), F.min("node").alias("node"), F.min("w").alias("w")).filter("n = 1")
    lone = lone.groupBy("node", F.col("token").bitwiseAND(GROUPS - 1).alias("g")).agg(F.sum("w").alias("w"))
    lone = lone.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("g", "w"))).alias("lone"))  # GROUPS at most
    both = texts.mapInArrow(by_group, "node bigint, total double, held array<double>").join(lone, "node", "left")
    less = lambda x, g: x - F.coalesce(F.element_at("lone", g.cast("long")), F.lit(0.0))
    both = both.select("node", "total", F.transform("held", less).alias("groups"))
    return both.withColumn("shared", F.aggregate("groups", F.lit(0.0), lambda x, y: x + y))


def _open_pairs(apart: DataFrame, reps: DataFrame, shared: DataFrame, cfg: Config) -> DataFrame:
    """Pairs of a bucket in different classes that no bound rules out, each from the first bucket that it shares.

    Equal joins on the bucket and a slice of the similarity to its least member.  What two texts share is at most the sum
    over groups of shingles of the lesser weight there, without shingles that a text holds alone: members of a large
    group of near copies lack different shingles of their common text, which this bound sees.
    """
    t, gap, slack = cfg.threshold, 1 - cfg.threshold + 1e-6, 1e-6
    held = shared.filter(F.col("shared") >= t * F.col("total") - slack).join(reps, "node")
    now = checkpointed(apart.join(held, "node").withColumn("slice", F.floor(F.col("s") / gap)))
    cols = ["bucket", "slice", "band", "node", "comp", "s", "bands", "total", "shared", "groups"]
    one = now.select(*[F.col(c).alias(c if c in ("bucket", "slice") else f"{c}_a") for c in cols])
    near = F.explode(F.array(F.col("slice") - 1, F.col("slice"), F.col("slice") + 1)).alias("slice")
    two = now.select("bucket", near, *[F.col(c).alias(f"{c}_b") for c in cols[3:]])
    first = F.array_position(F.zip_with("bands_a", "bands_b", lambda x, y: x == y), True) == F.col("band_a") + 1
    need = t / (1 + t) * (F.col("total_a") + F.col("total_b")) - slack
    room = F.least("shared_a", "shared_b") >= need
    common = F.aggregate(F.zip_with("groups_a", "groups_b", lambda x, y: F.least(x, y)), F.lit(0.0), lambda x, y: x + y) >= need
    apart_ = (F.col("comp_a") != F.col("comp_b")) & (F.col("node_a") < F.col("node_b")) & (F.abs(F.col("s_a") - F.col("s_b")) <= gap)
    return one.join(two, ["bucket", "slice"]).filter(apart_ & room & common & first).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def keep_one(docs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """docs with one row of each class, that of the least id, and every row without words; other columns as they are.

    Rows are told apart by id and text.  Only rows that may have to go are shuffled.
    """
    known = checkpointed(labelled(docs, cfg).filter("k1 IS NOT NULL").select("row", "keeps"))
    gone = known.filter("row <> keeps").select("row")
    again = known.groupBy("row").agg(F.count("*").alias("n")).filter("n > 1").select("row")
    touched = checkpointed(gone.unionByName(again).distinct())
    row, maybe = fresh(docs, "row"), fresh(docs, "maybe")
    marked = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    marked = marked.withColumn(maybe, id_test(touched, "row")(row) & F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    rest = marked.filter(maybe).join(gone.select(F.col("row").alias(row)).distinct(), row, "left_anti").dropDuplicates([row])
    return marked.filter(~F.col(maybe)).unionByName(rest).select(*docs.columns)
