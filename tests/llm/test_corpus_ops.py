"""Operators that look across documents, against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pantrylake.llm import graph, near_dup, passages, quality, toxicity
from pantrylake.llm.common import id_test, spread_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n, size=4000):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def corpus(seed=3):
    """Exact copies, near copies of several degrees, a common passage, short and empty texts."""
    rng = random.Random(seed)
    rows, common = [], prose(rng, 60)
    for i in range(40):
        rows.append(prose(rng, rng.randrange(80, 200)) + (common if i % 3 == 0 else []))
    for i in range(12):
        rows.append(list(rows[i]))
    for i in range(60):
        w = list(rows[20])
        for _ in range(i % 12):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append(w)
    texts = [" ".join(w) for w in rows] + [None, "", "  ", "two words", "two  WORDS", "a", "long " * 5000]
    return list(enumerate(texts))


def weighted(texts, idf, k=5):
    out = {}
    for d, t in texts:
        key, tf, *_ = near_dup.features(pa.array([t], pa.large_string()), k)
        out[d] = dict(zip(key.tolist(), near_dup.weights(key, tf, idf).astype(float).tolist(), strict=True))
    return out


def token_list(t):
    return (near_dup.features(pa.array([t], pa.large_string()), 5)[0] & near_dup.TOKEN).tolist()


def components_of(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def brute_classes(texts, idf, threshold=0.8):
    f = weighted(texts, idf)
    edges = []
    for a in f:
        for b in f:
            if a < b and f[a] and f[b]:
                m = sum(min(w, f[b][x]) for x, w in f[a].items() if x in f[b])
                if m / (sum(f[a].values()) + sum(f[b].values()) - m) >= threshold:
                    edges.append((a, b))
    return components_of(list(f), edges)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(60)]
    got = {r["node"]: r["comp"] for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = components_of({x for e in edges for x in e}, edges)
    assert got == {n: c for n, c in want.items() if n in got} and all(n == c for n, c in want.items() if n not in got)
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_classes_equal_brute_force(spark, docs):
    texts = corpus()
    df = docs([(d, t, "en") for d, t in texts]).repartition(3)
    idf, total = near_dup.frequencies(df, near_dup.Config())
    assert total == len(texts) and 1 <= idf.value.min() and idf.value.max() <= 2
    seen = Counter(x for _, t in texts for x in set(token_list(t)))
    size = sum(seen.values())
    limit = max(1.0, size / near_dup.FREQUENT)
    frequent = {x: 1 + np.log(total / n) / np.log(max(2.0, total / limit)) for x, n in seen.items() if n > limit}
    assert dict(zip(idf.token.tolist(), idf.value.tolist(), strict=True)) == pytest.approx(frequent)
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classes(df).collect()}
    want = brute_classes(texts, idf)
    lost = [d for d in want if got[d] != want[d]]
    assert not lost
    ids = {t: d for d, t in reversed(texts)}
    assert got[ids["two words"]] == got[ids["two  WORDS"]] and all(got[d] == d for d, t in texts if not (t or "").strip())
    kept = near_dup.keep_one(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def test_weights_do_not_depend_on_colliding_buckets(docs, monkeypatch):
    """As on a corpus so large that every bucket is shared by many shingles: df, weights and classes stay the same."""
    rng = random.Random(9)
    common = prose(rng, 60)
    texts = [(i, " ".join(prose(rng, 60) + common)) for i in range(60)] + corpus()[:80]
    texts = [(i, t) for i, (_, t) in enumerate(texts)]
    df = docs([(d, t, "en") for d, t in texts]).repartition(2)
    monkeypatch.setattr(near_dup, "FREQUENT", 1024)
    true, _ = near_dup.frequencies(df, near_dup.Config())
    want = {r["doc_id"]: r["class_id"] for r in near_dup.classes(df).collect()}
    monkeypatch.setattr(near_dup, "bucket", lambda key: (key & np.uint64(15)).astype(np.intp))
    got, _ = near_dup.frequencies(df, near_dup.Config())
    assert 0 < len(true.token) < 1024 and got.token.tolist() == true.token.tolist() and np.allclose(got.value, true.value)
    assert {r["doc_id"]: r["class_id"] for r in near_dup.classes(df).collect()} == want == brute_classes(texts, true)


def test_weights_are_alike_at_every_size():
    for n in (10**4, 10**7, 10**10):
        got = near_dup.rarity(np.array([1, n / 1000, n / 10, n]), n, n * 250 / near_dup.FREQUENT)
        assert np.allclose(got, [2, 2, 1 + np.log(10) / np.log(near_dup.FREQUENT / 250), 1])


def test_classes_of_edge_tables(docs):
    assert near_dup.classes(docs([(1, "a b c", "en")]).limit(0)).count() == 0
    got = near_dup.classes(docs([(5, "same text here", "en"), (5, "same text here", "en"), (None, "same text here", "en"), (7, None, None)])).collect()
    assert sorted((r["doc_id"], r["class_id"]) for r in got if r["doc_id"] is not None) == [(5, 5), (5, 5), (7, 7)] and [r["class_id"] for r in got if r["doc_id"] is None] == [5]


def test_samples_agree_as_often_as_weighted_jaccard():
    rng = random.Random(2)
    a = prose(rng, 400)
    b = [w if rng.random() > 0.03 else "y" + w for w in a]
    cfg = near_dup.Config(bands=32, rows=8)
    idf = near_dup.Idf(np.zeros(0, np.uint64), np.zeros(0))
    key, tf, *_ = near_dup.features(pa.array([" ".join(a), " ".join(b)]), 5)
    sig = near_dup.samples(key, tf, idf, 2, near_dup.Config(bands=25, rows=4))
    f = weighted([(0, " ".join(a)), (1, " ".join(b))], idf)
    m = sum(min(w, f[1][x]) for x, w in f[0].items() if x in f[1])
    want = m / (sum(f[0].values()) + sum(f[1].values()) - m)
    assert abs((sig[:, 0] == sig[:, 1]).mean() - want) < 0.15 and cfg.bands == 32


def brute_passages(rows):
    """Marked words of each (id, text)."""
    words = {k: WORD.findall(k[1] or "") for k in rows}
    holders = {}
    for k, w in words.items():
        for i in range(len(w) - 49):
            holders.setdefault(tuple(w[i : i + 50]), set()).add(k)
    return {k: {j for i in range(len(w) - 49) if len(holders[tuple(w[i : i + 50])]) > 1 for j in range(i, i + 50)} for k, w in words.items()}


def patched(rng, n):
    """Texts pieced together from few passages, so that heads have many contexts."""
    pool = [prose(rng, rng.randrange(20, 90), 50) for _ in range(8)]
    return [(i, " ".join(w for _ in range(rng.randrange(1, 6)) for w in (rng.choice(pool)[rng.randrange(15) :] + prose(rng, rng.randrange(3), 5)))) for i in range(n)]


@pytest.mark.parametrize("crowd", [1000, 2])
def test_passages_equal_brute_force(docs, crowd):
    rng = random.Random(5)
    rows = [x for x in corpus(7) if x[1] is None or len(x[1]) < 9000] + [(900, " ".join(f"q{i % 3}" for i in range(200))), (901, " ".join(f"z{i}" for i in range(49)))]
    rows += [(1000 + i, t) for i, t in patched(rng, 80)]
    rows += [(1000, rows[-1][1]), (1001, rows[-1][1] + " end"), (None, rows[-2][1]), (None, rows[-3][1]), rows[-1], (2000, " ".join(["the"] * 300)), (2001, " ".join(["the"] * 120))]
    own = [(950, " ".join(prose(rng, 60) * 2)), (950, " ".join(prose(rng, 60)))]  # one text repeats itself; another has the same id
    rows += [*own, own[0]]
    got = {}
    for r in passages.repeats(docs([(d, t, "en") for d, t in rows]).repartition(3), crowd).collect():
        got.setdefault(r["doc_id"], []).append((tuple(tuple(s) for s in r["spans"]), r["repeated_words"]))
    want = {}
    marks = brute_passages(set(rows))
    for d, t in rows:
        if m := sorted(marks[d, t]):
            cut = [i for i in range(len(m)) if i == 0 or m[i] != m[i - 1] + 1]
            want.setdefault(d, []).append((tuple((m[a], m[b - 1] + 1) for a, b in zip(cut, [*cut[1:], len(m)], strict=True)), len(m)))
    assert {d: sorted(x) for d, x in got.items()} == {d: sorted(x) for d, x in want.items()} and 950 not in got
    assert passages.repeats(docs([(1, "a", "en")]).limit(0)).count() == 0


def test_extension_reaches_what_all_windows_reach():
    """Contexts over two words, where the best neighbours to either side often differ."""
    rng = np.random.default_rng(4)
    for _ in range(60):
        n = int(rng.integers(2, 30))
        head, rid = rng.integers(0, 2, n).astype(np.uint64), rng.integers(0, max(2, n // 2), n)
        nl, nr = rng.integers(0, 25, n), rng.integers(0, 25, n)
        base = rng.integers(1, 3, (2, passages.SIDE))
        left, right = (np.where(rng.random((n, passages.SIDE)) < 0.1, 3 - base[i], base[i]).astype(np.uint32) for i in (0, 1))
        left[np.arange(passages.SIDE) >= nl[:, None]] = 0
        right[np.arange(passages.SIDE) >= nr[:, None]] = 0
        got = [set() for _ in range(n)]
        for i, a, b in zip(*passages.extended(head, rid, left, nl, right, nr), strict=True):
            got[i] |= set(range(-a, passages.HEAD + b))
        for i in range(n):
            want = set()
            for j in range(n):
                if head[i] == head[j] and rid[i] != rid[j]:
                    for d in range(passages.SIDE + 1):
                        e = passages.SIDE - d
                        if d <= min(nl[i], nl[j]) and e <= min(nr[i], nr[j]) and (left[i, :d] == left[j, :d]).all() and (right[i, :e] == right[j, :e]).all():
                            want |= set(range(-d, passages.HEAD + e))
            assert got[i] == want


def toxic_rows(n=700, seed=1):
    rng = random.Random(seed)
    bad = ["grok", "zorp", "blarg", "snark"]
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.25)
        w = prose(rng, rng.randrange(20, 120), 500)
        for _ in range(rng.randrange(2, 6) * y):
            w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((i, " ".join(w), y))
    return rows


def test_nearest_examples_are_exact():
    rows = toxic_rows()
    m = toxicity.train(rows, Counter(y for *_, y in rows), toxicity.Config(block=16))
    x = m.index
    v = np.zeros((len(x.ids), len(x.vocab)))
    for k in range(len(x.vocab)):
        a, b = x.first[k * x.n_blocks], x.first[(k + 1) * x.n_blocks]
        v[x.at[a:b], k] = x.w[a:b]
    lo, hi, term, w = x.queries(pa.array([t for _, t, _ in toxic_rows(150, 9)]))
    for i in range(len(lo)):
        t, q = term[lo[i] : hi[i]], w[lo[i] : hi[i]]
        at, sim = x.nearest(t, q, 10)
        full = v[:, t] @ q
        best = np.lexsort((x.ids, -np.round(full, 9)))[:10]
        best = best[full[best] > 0]
        assert at.tolist() == best.tolist() and np.allclose(sim, full[best])


def test_neighbours_by_cosine_from_scratch():
    """All terms, their counts, weights and cosines by plain Python."""
    rows = [(i, t + (" naïveté Éclair" if i % 5 == 0 else ""), y) for i, t, y in toxic_rows(120)]
    m = toxicity.train(rows, Counter(y for *_, y in rows), toxicity.Config(min_df=1, chi2=0, block=8))

    def bag(t):
        words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())
        return Counter([("w", w) for w in words] + [("h", w.encode()[:5]) for w in words if len(w.encode()) > 5])

    bags = {i: bag(t) for i, t, _ in rows}
    df = Counter(x for b in bags.values() for x in b)
    n = len(rows)

    def vector(b):
        v = {x: (1 + np.log(c)) * (np.log((n + 1) / (df[x] + 1)) + 1) for x, c in b.items() if x in df}
        size = np.sqrt(sum(w * w for w in v.values()))
        return {x: w / size for x, w in v.items()}

    held = {i: vector(b) for i, b in bags.items()}
    queries = [t for _, t, _ in toxic_rows(40, 9)]
    lo, hi, term, w = m.index.queries(pa.array(queries))
    for i, t in enumerate(queries):
        q = vector(bag(t))
        sims = {d: sum(x * v.get(k, 0.0) for k, x in q.items()) for d, v in held.items()}
        want = sorted((d for d in sims if sims[d] > 0), key=lambda d: (-round(sims[d], 9), d))[:10]
        at, sim = m.index.nearest(term[lo[i] : hi[i]], w[lo[i] : hi[i]], 10)
        assert m.index.ids[at].tolist() == want and np.allclose(sim, [sims[d] for d in want])
        y = np.array([rows[d][2] for d in want])
        weight = m.class_weight[y] / (1 - np.minimum(sim, 1) + 0.05)
        assert abs(m.vote(at, sim) - ((weight * y).sum() + m.prior) / (weight.sum() + 1)) < 1e-9


def test_examples_stay_within_their_bytes(spark, docs):
    rows = toxic_rows(200)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    df = docs([(i, t, "en") for i, t, _ in rows] + [(i, t, "en") for i, t, _ in rows[:50]] + [(0, "another text", "en")])
    got, totals = toxicity.examples(df, labels, toxicity.Config(sample_bytes=20_000))
    assert sum(len(t.encode()) for _, t, _ in got) <= 20_000 and len({d for d, *_ in got}) == len(got) > 10
    known = [y for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    assert totals == Counter(known)


def test_toxicity(spark, docs):
    rows = toxic_rows()
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5000, None)], "doc_id bigint, toxic int")
    df = docs([(i, t, "en") for i, t, _ in rows] + [(900, None, "en"), (901, "", "en")])
    got = {r["doc_id"]: r for r in toxicity.score(df, labels).collect()}
    held = [(i, y) for i, _, y in rows if got[i]["held_out"]]
    assert len(held) > 100 and np.mean([got[i]["predicted"] == y for i, y in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[900]["score"] == got[901]["score"] and got[900]["predicted"] == 0
    # Labels of held-out rows change nothing.
    other = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r["doc_id"]: r["score"] for r in toxicity.score(df, other).collect()}
    assert again == {d: r["score"] for d, r in got.items()}
    assert toxicity.score(df.limit(0), labels).count() == 0 and {r["score"] for r in toxicity.score(df, labels.limit(0)).collect()} == {0.0}


def test_quality(docs):
    rng = random.Random(8)
    rows = []
    for i in range(600):
        w = [rng.choice(["the", "of", "a", "is", "and", f"word{rng.randrange(900)}", f"thing{rng.randrange(900)}"]) for _ in range(rng.randrange(40, 150))]
        text = " ".join(x + ("." if k % 12 == 11 else "") for k, x in enumerate(w))
        kind = i % 6
        if kind == 0:
            text = " ".join(x.upper() + "!!" for x in w)
        elif kind == 1:
            text = " ".join(x + rng.choice(["###", "$$$", "%%%"]) for x in w)
        rows.append((i, text, "en"))
    got = {r["doc_id"]: r for r in quality.score(docs([*rows, (1000, None, "en"), (1001, "", "en")])).collect()}
    assert np.mean([got[i]["predicted"] == (i % 6 > 1) for i in range(600)]) > 0.97
    assert got[1000]["score"] == got[1001]["score"]
    assert quality.score(docs(rows).limit(0)).count() == 0


def brute_votes(t):
    words = WORD.findall(t)
    n = len(words)
    if not n:
        return [1] * 8
    low, up = sum("a" <= c <= "z" for c in t), sum("A" <= c <= "Z" for c in t)
    lines = [x for x in t.split("\n") if x]
    later = sum(x in lines[:i] for i, x in enumerate(lines))
    grams = [tuple(words[i : i + 3]) for i in range(n - 2)]
    again = sum(c for c in Counter(grams).values() if c > 1) / max(len(grams), 1)
    spoken = [w for w in words if re.match(r"[A-Za-z\x80-\U0010ffff]", w)]
    short = sum(len(w.encode()) <= 3 for w in spoken) / max(len(spoken), 1)
    symbols, shouts, stops = (x * (1 / n) for x in (sum(c in "#*$%&<>" for c in t), t.count("!"), sum(c in ".?;:" for c in t)))
    marks = sum(len(w.encode()) <= 2 and w[0] in "|-*" for w in words) * (1 / n)
    caps, lines = up / max(up + low, 1), later / max(len(lines), 1)
    pairs = [
        (symbols > 0.2, symbols < 0.02), (caps > 0.4, caps < 0.2), (marks > 0.15, marks < 0.01), (shouts > 0.2, shouts < 0.02), (lines > 0.3, lines == 0),
        (again > 0.3, again < 0.1), (stops < 0.02 and n > 30, 0.04 < stops < 0.5), (short < 0.1 and n > 30, 0.2 < short < 0.7),
    ]
    return [0 if bad else 2 if good else 1 for bad, good in pairs]


def test_labellers_and_scores_equal_brute_force():
    rng = random.Random(3)
    word = lambda: rng.choice(["the", "a", "IT", "word", "Thing", "été", "#", "*", "|", "-", "x!", "end.", "so;", "12", "of"])
    texts = [None, "", " \n"] + ["".join(word() + rng.choice([" ", " ", " ", "\n"]) for _ in range(rng.randrange(1, 90))) * rng.choice([1, 1, 2]) for _ in range(300)]
    votes, (doc, dim, value) = quality.look(pa.array(texts, pa.large_string()))
    assert votes.tolist() == [brute_votes(t or "") for t in texts]
    # A document's features don't depend on its neighbours, and the fitted scorer is their weighted sum.
    codes = np.unique(quality.code(votes))
    m = quality.fit(pa.array(texts, pa.large_string()), codes, np.linspace(0, 1, len(codes)), quality.Config(epochs=1))
    for i in range(0, len(texts), 17):
        v, (_, d, x) = quality.look(pa.array([texts[i]], pa.large_string()))
        assert v[0].tolist() == votes[i].tolist() and sorted(zip(d, x, strict=True)) == sorted(zip(dim[doc == i], value[doc == i], strict=True))
        z = sum(m.weights[a] * b for a, b in zip(d, x, strict=True))
        assert abs(z - np.bincount(doc, m.weights[dim] * value, len(texts))[i]) < 1e-9


def test_em_equals_plain_loops():
    rng = np.random.default_rng(2)
    patterns, n = np.unique(rng.integers(0, 3, (400, 4)), axis=0, return_counts=True)
    post, theta = quality.reliabilities(patterns, n.astype(float), 7)
    p = [[0.97, 0.3, 0.05][min(sum(v == 0 for v in row), 2)] for row in patterns]
    for _ in range(7):
        prior = (sum(c * q for c, q in zip(n, p, strict=True)) + 1) / (n.sum() + 2)
        t = np.full((4, 2, 3), 0.2)
        for row, c, q in zip(patterns, n, p, strict=True):
            for j, v in enumerate(row):
                t[j, 0, v] += c * (1 - q)
                t[j, 1, v] += c * q
        t /= t.sum(2, keepdims=True)
        p = []
        for row in patterns:
            a, b = 1 - prior, prior
            for j, v in enumerate(row):
                a, b = a * t[j, 0, v], b * t[j, 1, v]
            p.append(b / (a + b))
    assert np.allclose(post, p, atol=1e-9) and np.allclose(theta, t)


def test_em_weighs_labellers():
    rng = np.random.default_rng(0)
    truth = rng.random(5000) < 0.8
    vote = lambda right: np.where(rng.random(5000) < right, truth, ~truth) * 2
    v = np.stack([vote(0.97), vote(0.9), vote(0.85), vote(0.55)], 1)
    patterns, n = np.unique(v, axis=0, return_counts=True)
    post, theta = quality.reliabilities(patterns, n.astype(float), 60)
    assert theta[0, 1, 2] > theta[2, 1, 2] > theta[3, 1, 2]
    at = [int(np.flatnonzero((patterns == row).all(1))[0]) for row in v[:300]]
    assert np.mean((post[at] > 0.5) == truth[:300]) > 0.9


def test_id_filter_loses_nothing(spark):
    df = spark.range(5000).withColumnRenamed("id", "doc_id")
    ids = df.filter("doc_id % 7 = 0")
    assert df.filter(id_test(ids, "doc_id")("doc_id")).filter("doc_id % 7 = 0").count() == ids.count()


def test_join_of_hot_keys_equals_a_plain_join(spark):
    left = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n")).filter("k % 2 = 1")
    got, want = (sorted(map(tuple, x.select("k", "id", "n").collect())) for x in (spread_join(left, right, ["k"], 6000), left.join(right, "k")))
    assert got == want


def test_one_row_of_each_class_stays(spark):
    schema = "doc_id bigint, text string, _maybe string, _gone string, row int, MAYBE_ int"
    rows = [
        (1, "a b c d e f", "x", "y", 1, 1), (2, "something else here", "x", "y", 2, 2), (2, "a b c d e f", "x", "y", 3, 3),
        (5, "p q r s t u", "x", "y", 4, 4), (5, "p q r s t u", "x", "y", 5, 5), (None, "p q r s t u", "x", "y", 6, 6), (None, "only here with no id", "x", "y", 7, 7),
        (9, None, "x", "y", 8, 8), (9, None, "x", "y", 9, 9), (9, " ", "x", "y", 10, 10), (None, "", None, None, 11, None),
    ]
    df = spark.createDataFrame(rows, schema).repartition(3)
    kept = near_dup.keep_one(df)
    assert kept.columns == df.columns
    got = kept.collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in got) == sorted(
        [(False, 1, "a b c d e f"), (False, 2, "something else here"), (False, 5, "p q r s t u"), (True, 0, "only here with no id"), (False, 9, ""), (False, 9, ""), (False, 9, " "), (True, 0, "")]
    )
    assert all(r["_maybe"] == "x" for r in got if r["doc_id"]) and near_dup.keep_one(df.limit(0)).count() == 0


def test_near_copies_are_found_beyond_the_variates(spark, docs):
    """Texts of more shingles than there are values of a variate, and recall of pairs just above the threshold."""
    rng = random.Random(11)
    long = prose(rng, 70_000, 10**6)
    rows = [(0, " ".join(long)), (1, " ".join(w if i % 90 else f"y{i}" for i, w in enumerate(long)))]
    for i in range(60):
        w = prose(rng, 120)
        rows += [(10 + 2 * i, " ".join(w)), (11 + 2 * i, " ".join(w[:40] + ["z"] + w[40:80] + ["zz"] + w[80:]))]
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classes(docs([(d, t, "en") for d, t in rows])).collect()}
    assert got[1] == 0 and np.mean([got[11 + 2 * i] == 10 + 2 * i for i in range(60)]) >= 0.9


@pytest.fixture(scope="module")
def small():
    return "/root/testdata/sf0.001"


def test_pipeline_equals_its_stages_by_hand(spark, small):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from pantrylake.llm import decontaminate, language_id, piece_codec, pii

    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet")
    known = language_id.keep_known(docs)
    one = [r["class_id"] for r in near_dup.classes(known).collect()]
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    leaks = {r["doc_id"] for r in decontaminate.matches(known, bench).collect()}
    want = set(one) - leaks
    assert set(out) == want and all(r["round_trip"] for r in out.values())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "personal_data", "token_ids"]
    text = {r["doc_id"]: r["text"] for r in piece_codec.decode(spark.createDataFrame([(d, r["ids"]) for d, r in out.items()], "doc_id bigint, ids array<int>")).collect()}
    assert not any(pii.base_spans(t) for t in text.values())
