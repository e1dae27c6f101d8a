"""Operators that decide about a document alone, against brute force."""

import random
import re
import time
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pantrylake.llm import common, decontaminate, language_id, piece_codec, pii, repetition, token_counts
from pantrylake.llm.pieces import Encoder, Pieces

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = [(1, None, "en"), (2, "", "en"), (3, " \n\t", None), (4, "a", "en"), (4, "a", "en"), (None, "b c", "fr"), (6, "word " * 3000, "en"), (7, "x" * 20000, "en")]


@pytest.fixture(scope="module")
def pieces():
    return Pieces.load(token_counts.model_path())


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=token_counts.model_path())


def noise(rng, n, letters="abcdeéñ  ▁\n\t①0.9théing!—漢字ÇÉ😀"):
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_words_and_hashes():
    texts = ["a b", "", None, "c", " a  b\x0b", "ab"]
    data, off = common.utf8(pa.array(texts))
    words, woff = common.words_of(data, off)
    assert np.diff(woff).tolist() == [2, 0, 0, 1, 2, 1]
    assert words[0] == words[3] and words[1] == words[4] and len(set(words.tolist())) == 4
    g, doc = common.shingles(words, woff, 2)
    assert doc.tolist() == [0, 3, 4, 5] and g[0] == g[2] and g[0] != g[1]


def test_prefix_counts_equal_the_library(pieces, library):
    texts = [None, "", " ", "  "] + noise(random.Random(5), 150)
    counts, off = token_counts.prefix_table(Encoder(pieces), texts)
    for i, t in enumerate(texts):
        t = t or ""
        assert [int(c) for c in counts[off[i] : off[i + 1]]] == [len(library.encode(t[:j])) for j in range(len(t) + 1)]


def test_ids_equal_the_library_and_decode(pieces, library):
    rng = random.Random(6)
    texts = noise(rng, 3000) + [" ".join(rng.choice(["the", "thering", "Ünder", "x1", "naïve"]) + rng.choice(["", ",", "s"]) for _ in range(400)), "théing" * 3000, " " * 500 + "a"]
    enc = Encoder(pieces)
    ids, off = piece_codec.encode_batch(enc, texts)
    for i, t in enumerate(texts):
        assert ids[off[i] : off[i + 1]].tolist() == library.encode(t)
    assert [b.decode() for b in piece_codec.Decoder(pieces).batch(ids, off)] == [t.replace("▁", " ") for t in texts]


def test_long_words_behind_spaces_take_linear_time(pieces, library):
    rng = random.Random(7)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzé日本語") for _ in range(20_000))
    for text in ("x  " + word, "x " + word, word):
        began = time.monotonic()
        counts, _ = token_counts.prefix_table(Encoder(pieces), [text])
        assert time.monotonic() - began < 20
        assert all(counts[k] == len(library.encode(text[:k])) for k in (0, 1, 2, 3, 4, 5, 50, 999, 7000, len(text)))
    # Many long words without spaces go together, behind one space or several.
    words = ["".join(rng.choice("abcdefg日本語") for _ in range(rng.randrange(50, 300))) for _ in range(300)]
    texts = [("  " if i % 2 else " ").join(words[i : i + 3]) for i in range(0, 300, 3)]
    enc = Encoder(pieces)
    ids, off = piece_codec.encode_batch(enc, texts)
    assert [ids[off[i] : off[i + 1]].tolist() for i in range(len(texts))] == [library.encode(t) for t in texts]
    counts, off = token_counts.prefix_table(enc, texts)
    assert all(counts[off[i] + k] == len(library.encode(texts[i][:k])) for i in range(0, 100, 9) for k in range(0, len(texts[i]) + 1, 13))


def test_words_one_by_one_and_together_agree(pieces):
    enc, rng = Encoder(pieces), random.Random(8)
    words = ["".join(rng.choice("aeinrstéß日-.") for _ in range(rng.randrange(1, 20))) for _ in range(200)]
    size = np.array([len(w) + 1 for w in words])
    chars = np.zeros((200, size.max()), np.uint32)
    for i, w in enumerate(words):
        chars[i, : size[i]] = [ord(c) for c in "▁" + w]
    back, count, lone = enc.together(chars)
    for i, w in enumerate(words):
        assert [x[i, : size[i] + 1].tolist() for x in (back, count, lone)] == [list(x) for x in enc.alone("▁" + w)]


def test_tokens_of_an_empty_table(docs):
    none = docs(EDGE).limit(0)
    assert token_counts.count_tokens(none).count() == token_counts.prefix_counts(none).count() == 0
    assert piece_codec.decode(piece_codec.encode(none)).count() == 0
    assert pii.redact(none).count() == language_id.keep_known(none).count() == repetition.judge(none).count() == 0


def test_bounded_memo_changes_nothing(pieces, library):
    enc = Encoder(pieces, bound=50)
    for part in range(5):
        texts = noise(random.Random(part), 60)
        ids, off = piece_codec.encode_batch(enc, texts)
        assert [ids[off[i] : off[i + 1]].tolist() for i in range(len(texts))] == [library.encode(t) for t in texts]


def test_token_queries(spark, docs, library):
    df = docs(EDGE)
    got = token_counts.count_tokens(df).collect()
    assert [(r["n_tokens"], r["n_bytes"]) for r in got] == [(len(library.encode(t or "")), len((t or "").encode())) for _, t, _ in EDGE]
    assert [r["over_limit"] for r in got] == [len(library.encode(t or "")) > 4096 for _, t, _ in EDGE]
    long = next(r for r in got if r["over_limit"])
    text = next(t for i, t, _ in EDGE if i == long["doc_id"])
    assert len(library.encode(text[: long["cut_chars"]])) <= 4096 < len(library.encode(text[: long["cut_chars"] + 1]))
    stored = token_counts.prefix_counts(df.filter("doc_id = 4"))
    from pyspark.sql import functions as F

    row = stored.select(token_counts.tokens_in("counts", F.lit(1)).alias("n"), token_counts.cut_for("counts", 0).alias("cut")).first()
    assert row["n"] == 1 and row["cut"] == 0
    back = piece_codec.decode(piece_codec.encode(df)).collect()
    assert [r["text"] for r in back] == [t or "" for _, t, _ in EDGE]
    assert piece_codec.encode(df.limit(0)).count() == 0


def brute_pii(t):
    out = []
    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(d) <= 19 and pii.luhn(d)):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda x: (x[0], pii.RANK[x[2]], x[1]))


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    for t in noise(rng, 8000, "0123456789" * 2 + ".@+-  ab()\n%"):
        assert pii.base_spans(t) == brute_pii(t)
    for t in ("1" * 50000, "a" * 50000 + "@", "1." * 30000, "+1 " * 30000, "a@" * 30000):  # linear, so this ends soon
        pii.base_spans(t)


def test_pii_queries(docs):
    rows = [(1, "call me at +1 (988) 555-2485 or bo@x.example.com", "en"), (2, "ssn 123-45-6789 on file", "en"), (3, "version 1.2.3.4 is out", "en"), (4, "card 4041894974608795, again 4041894974608795", "en"), (11, None, "en"), (12, "", None), (13, " ", "en")]
    found = pii.find(docs(rows))
    got = {r["doc_id"]: r for r in pii.digest(found).collect()}
    assert (got[1]["n_phone"], got[1]["n_email"], got[4]["n_card"]) == (1, 1, 2)
    base = brute_pii(rows[0][1])
    assert got[1]["base_sha256"] == pii.sha(",".join(f"{k}:{s}:{e}" for s, e, k in base))
    assert all(f"{k}:{s}:{e}" in got[1]["spans"].split(",") for s, e, k in base)
    red = {r["doc_id"]: r for r in pii.redact(docs(rows)).collect()}
    assert "555" not in red[1]["text"] and "[EMAIL]" in red[1]["text"] and red[1]["n_chars"] == len(red[1]["text"])
    assert pii.digest(pii.find(docs(rows).limit(0))).count() == 0


def test_em_finds_the_reliable_labeller():
    rng = np.random.default_rng(0)
    truth = rng.integers(0, 2, 4000)
    vote = lambda right: np.where(rng.random(4000) < right, truth * 2, 2 - truth * 2)
    v = np.stack([vote(0.95), vote(0.8), vote(0.75), vote(0.6)], 1)
    codes, n = np.unique(v, axis=0, return_counts=True)
    _, theta, _ = pii.reliabilities(codes, n.astype(float), 50)
    good = theta[:, 1, 2]
    assert good[0] > good[1] > good[3] and abs(good[0] - 0.95) < 0.05


def brute_distance(p, text):
    """Least edit distance of p to any substring of text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_edit_matching_equals_brute_force():
    rng = random.Random(9)
    items = [(i, " ".join("".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 25)))) for i in range(30)]
    m = decontaminate.Matcher(items, 0.05)
    for _ in range(120):
        t = " ".join("".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 7))) for _ in range(40))
        _, passage = rng.choice(items)
        p = list(passage)
        for _ in range(rng.randrange(5)):
            p[rng.randrange(len(p))] = rng.choice("abcdefg ")
        text = decontaminate.padded(decontaminate.normalised(pa.array([t[:60] + " " + "".join(p) + " " + t[60:]]))[0].as_py())
        want = {k: d for k, (_, q, e) in enumerate(m.items) if (d := brute_distance(q, text)) <= e}
        assert {k: v[0] for k, v in m.find(text).items()} == want


def test_decontaminate_queries(spark, docs):
    bench = spark.createDataFrame([(10, "The quick brown fox, jumps over the lazy dog again."), (11, None), (12, "..."), (13, "the quick brown fox jumps over the lazy dog again")], "item_id bigint, text string")
    rows = [(1, "So: the QUICK brown fox jumps over the lazy dog again!", "en"), (2, "nothing here", "en"), *EDGE]
    got = decontaminate.matches(docs(rows), bench).collect()
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in got} == {(1, 10, 0), (1, 13, 0)}
    blocks = decontaminate.Config(block_bytes=80)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs(rows), bench, blocks).collect()} == {(1, 10), (1, 13)}
    kept = decontaminate.drop_contaminated(docs(rows), bench)
    assert kept.columns == docs(rows).columns and Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i, *_ in rows[1:])
    assert decontaminate.matches(docs(rows), bench.limit(0)).count() == 0


def brute_repetition(t, m=10):
    t = t or ""
    w = WORD.findall(t)
    n, seen, dup = len(w), set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i : i + 3]) for i in range(n - 2))
    cov = {j for i in range(n - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    longest, inside = 0, set()
    for i in range(n):
        best = 0
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and w[i + k] == w[j + k]:
                k += 1
            best = max(best, k)
        if best >= m:
            inside |= set(range(i, i + best))
            longest = max(longest, best)
    failed = n < 50 or 100 * len(cov) > 50 * n
    cfg = repetition.Config()
    return {
        "n_words": n, "word_chars": sum(map(len, w)), "n_symbols": sum(ch in "#*$%&|<>" for ch in t), "n_dup_lines": dup, "n_repeat_words": len(cov), "base_failed": failed,
        "kept": not failed and len(inside) <= cfg.max_fraction * n and longest <= cfg.max_repeat, "repeat_words": len(inside), "longest_repeat": longest,
    }


def test_repetition_equals_brute_force(docs):
    rng = random.Random(1)

    def text():
        v = rng.choice([2, 3, 8, 40])
        w = [rng.choice(["a", "b", "é", "cc", "#", "漢"]) + str(rng.randrange(v)) for _ in range(rng.randrange(120))]
        for _ in range(rng.randrange(3)):
            if len(w) > 30:
                i = rng.randrange(len(w) - 20)
                w += w[i : i + rng.randrange(5, 40)]
        return "".join(x + (rng.choice([" ", "\n", "  ", "\t", "\n\n", "\x0b", "\xa0"]) if rng.random() < 0.3 else " ") for x in w)

    texts = [None, "", " \n", "x", "a " * 150, "a b " * 60] + [text() for _ in range(120)]
    got = repetition.measure(pa.array(texts), repetition.Config())
    for i, t in enumerate(texts):
        assert {k: v[i] for k, v in got.items()} == brute_repetition(t), t
    rows = repetition.judge(docs(EDGE)).collect()
    assert len(rows) == len(EDGE) and not any(r["kept"] for r in rows)


def test_coverage_by_long_repeats_decides_alone():
    words = (f"w{i}" for i in range(10**6))
    fresh = lambda n: " ".join(next(words) for _ in range(n))
    passage, line = fresh(90), fresh(12)
    texts = [
        "\n".join(fresh(110) + " " + passage for _ in range(5)),  # 450 of 1,000 words in repeats of 90
        "\n".join([passage, fresh(300), passage, fresh(200)]),  # 180 of 680
        "\n".join([line, fresh(40), line]),  # 24 of 64, one short line twice
        "\n".join([line, fresh(30), line, fresh(10), line]),  # the line thrice
    ]
    got = repetition.measure(pa.array(texts), repetition.Config())
    assert not got["base_failed"][:3].any() and got["repeat_words"][:3].tolist() == [450, 180, 24] and max(got["longest_repeat"]) <= 100
    assert got["kept"].tolist() == [False, True, True, False]


def test_language(docs):
    rng = random.Random(4)
    words = {"en": ["the", "thing", "with", "and"], "de": ["der", "und", "nicht", "schön"], "fr": ["les", "être", "dans", "où"]}
    rows = [(i, " ".join(rng.choice(words[x]) for _ in range(rng.randrange(8, 80))), x) for i in range(600) for x in [rng.choice(list(words))]]
    got = {r["doc_id"]: r for r in language_id.identify(docs(rows + [(1000, None, "en"), (1001, "12 34 !!", "en"), (1002, "", None)])).collect()}
    held = [(i, x) for i, _, x in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] for i, _ in held)
    assert np.mean([got[i]["lang_pred"] == x for i, x in held]) > 0.97
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1001]["score"] == 0
    kept = language_id.keep_known(docs([*rows[:50], (1000, None, "en"), (1001, "12", None)]))
    assert kept.columns == docs(rows[:1]).columns and kept.count() == 50
    assert {r["lang_pred"] for r in language_id.identify(docs([(1, "abc", None)])).collect()} == {"und"}
    assert language_id.identify(docs(rows).limit(0)).count() == 0


def test_long_text_is_read_to_its_end(docs):
    cfg = language_id.Config()
    model = language_id.train(["the thing with " * 10, "der und nicht " * 10] * 20, ["en", "de"] * 20, cfg)
    a, _ = model.predict(pa.array(["the thing with " * 3 + "der und nicht " * 400]))
    assert a == ["de"]


def test_letters_are_those_of_category_l(docs):
    import sys

    chars = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    step = [c for i, c in enumerate(chars) if i < 0x3400 or i % 97 == 0]
    assert language_id.has_letter(pa.array(step)).tolist() == [unicodedata.category(c)[0] == "L" for c in step]
    assert language_id.has_letter(pa.array([None, "", "² ½ ① Ⅷ", "12é", "ʰ", "日"])).tolist() == [False, False, False, True, True, True]
    got = language_id.identify(docs([(0, "the thing", "en"), (2, "the thing", "en"), (3, "der und", "de"), (4, "der und", "de"), (5, "² ½ ①", "en")])).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in got}[5] == "und"


def test_network_equals_plain_loops():
    cfg = language_id.Config(window=24, filters=3, embed=4, epochs=2)
    texts = ["the thing with a", "der und nicht schön", "les être dans où"] * 30
    m = language_id.train(texts, ["en", "de", "fr"] * 30, cfg)
    long = "der und nicht schön " * 3 + "the"
    raw = np.frombuffer(long.encode(), np.uint8)
    total = np.zeros(3)
    for s in range(0, len(raw), cfg.window):
        window = [*raw[s : s + cfg.window].tolist(), *[0] * (cfg.window - len(raw[s : s + cfg.window]))]
        pooled = []
        for k, w in enumerate(cfg.widths):
            for f in range(cfg.filters):
                col = k * cfg.filters + f
                best = max(sum(float(m.emb[window[i + j]] @ m.conv[j * cfg.embed : (j + 1) * cfg.embed, col]) for j in range(w)) for i in range(cfg.window - max(cfg.widths) + 1))
                pooled.append(max(best + float(m.bias[col]), 0.0))
        z = np.array(pooled) @ m.out_w + m.out_b
        total += np.maximum(z - np.log(np.exp(z).sum()), -20) * len(raw[s : s + cfg.window]) / cfg.window
    want = np.exp(total - total.max())
    pred, score = m.predict(pa.array([long]))
    assert pred == [m.langs[int(want.argmax())]] and abs(score[0] - (want / want.sum()).max()) < 1e-4


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    cfg = language_id.Config(window=12, widths=(2, 3), filters=2, embed=3)
    p = {"emb": rng.normal(0, 0.5, (256, 3)), "ow": rng.normal(0, 0.5, (4, 3)), "ob": rng.normal(0, 0.1, 3)}
    for w in cfg.widths:
        p[f"w{w}"], p[f"b{w}"] = rng.normal(0, 0.5, (w, 3, 2)), rng.normal(0, 0.5, 2)
    x, y = rng.integers(97, 105, (5, 12)), rng.integers(0, 3, 5)
    _, g = language_id.gradients(p, x, y, cfg)
    for name, a in p.items():
        for at in rng.integers(0, a.size, 12) if name != "emb" else 97 * 3 + rng.integers(0, 24, 12):
            at = np.unravel_index(int(at), a.shape)
            was, step = a[at], 1e-6
            a[at] = was + step
            up = language_id.gradients(p, x, y, cfg)[0]
            a[at] = was - step
            down = language_id.gradients(p, x, y, cfg)[0]
            a[at] = was
            assert abs((up - down) / (2 * step) - g[name][at]) < 1e-5


def test_more_than_256_languages_are_learnt(docs):
    rows = [(i, f"lang{i % 300} word", f"l{i % 300}") for i in range(6000)]
    texts, langs = language_id.sample(docs(rows), language_id.Config())
    assert len(set(langs)) == 300 == len({t.split()[0] for t in texts})


def test_an_automaton_is_built_once_a_worker():
    items = [(1, "one item text"), (2, "another item text")]
    m = decontaminate.kept_matcher("a", items, 0.05)
    assert decontaminate.kept_matcher("a", items, 0.05) is m and decontaminate.kept_matcher("b", items, 0.05) is not m


def test_workers_let_go_of_what_another_operator_kept():
    rb = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["some text"]})
    m = decontaminate.kept_matcher("a", [(1, "a benchmark item")], 0.05)
    assert len(list(common.batches([rb], keeps="a"))) == 1 and common._kept == {"a": m}
    assert len(list(common.batches([rb]))) == 1 and not common._kept


def test_stages_ask_executors_to_give_memory_back(spark):
    common.shrink_executors(spark)
