"""A SentencePiece BPE vocabulary as numpy tables, and the dynamic programme over its pieces.

A BPE encoding is the only piece sequence in which every neighbouring pair, merged on its own, comes out as that pair.
So a Viterbi pass over positions finds for every prefix of a word its exact encoding: pieces that end there are scored by
the best sum before them plus their own, transitions that don't stand count as minus infinity, and the maximum over all
pieces is kept with its backpointer (`last` holds the final piece, `count` how many there are).  As only one encoding
stands, the maximum is that one.  Words of like length advance together, padded to the longest; substrings are found by
hash among the sorted piece keys.  Where fewer than 64 words share a length class, each takes the same steps by itself.

Behind several spaces a word's own space mark joins the run before it if it would stand alone, and is a piece's
beginning otherwise: `lone` says which for every prefix, so that no prefix is encoded twice.

Text is cut before every run of spaces: no piece has a space mark after another character, so nothing merges across.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import chain

import numpy as np

from pantrylake.llm.common import kept

MARK = "▁"
SEGMENT = re.compile("[ ▁]*[^ ▁]+|[ ▁]+")
START, NONE = -1, -2
FEW = 64  #: a class of like lengths with fewer words goes one by one
CELLS = 1 << 20  #: characters that advance together
PAIR_BITS = 20  #: places for remembered pairs
_BASE = np.uint64(0x9E3779B97F4A7C15)


def merge(symbols: list[str], rank: dict[str, int], tree: dict[str, tuple[str, str]] | None = None) -> list[str]:
    """Plain BPE: the best-ranked neighbouring pair merges first, the leftmost among equals."""
    out = list(symbols)
    while len(out) > 1:
        best, at = None, 0
        for i in range(len(out) - 1):
            r = rank.get(out[i] + out[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        if tree is not None:
            tree[out[at] + out[at + 1]] = (out[at], out[at + 1])
        out[at : at + 2] = [out[at] + out[at + 1]]
    return out


@dataclass
class Pieces:
    """Tables of the vocabulary; `ids` maps dense piece numbers to the model's ids."""

    text: list[str]
    ids: np.ndarray
    score: np.ndarray
    byte_ids: np.ndarray  #: the model's id of each byte
    runs: dict[int, list[int]]  #: the model's ids of a run of n spaces, filled on demand up to its longest piece
    longest: int
    keys: np.ndarray = field(repr=False)
    key_piece: np.ndarray = field(repr=False)
    pair_keys: np.ndarray = field(repr=False)
    pair_rank: np.ndarray = field(repr=False)
    right: np.ndarray = field(repr=False)  #: (pieces, depth) right spine, -1 after its end
    right_until: np.ndarray = field(repr=False)  #: rank of the merge that takes the node
    left: np.ndarray = field(repr=False)
    left_until: np.ndarray = field(repr=False)
    names: list[bytes] = field(repr=False)  #: bytes of each model id when decoded

    def __post_init__(self) -> None:
        self.right_depth, self.left_depth = (self.right >= 0).sum(1), (self.left >= 0).sum(1)

    @property
    def unknown(self) -> int:
        return len(self.text)

    @property
    def ids_of_mark(self) -> int:
        return int(self.ids[self.text.index(MARK)])

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        names = [b""] * n
        for i in normal:
            names[i] = sp.id_to_piece(i).replace(MARK, " ").encode()
        for b in range(256):
            names[byte_ids[b]] = bytes([b])
        score = {sp.id_to_piece(i): sp.get_score(i) for i in normal}
        spaces = {p for p in score if len(p) > 1 and not p.strip(MARK)}
        if any(MARK in p.lstrip(MARK) for p in score) or any(p.startswith(MARK * 2) and p not in spaces for p in score):
            raise ValueError("pieces cross word starts; this vocabulary can't be cut at spaces")
        order = sorted((p for p in score if len(p) > 1 and p not in spaces), key=lambda p: -score[p])
        rank = {p: i for i, p in enumerate(order)}
        tree: dict[str, tuple[str, str]] = {}
        alone = [p for p in order if merge(list(p), rank, tree) == [p]]
        text = [p for p in score if len(p) == 1] + alone
        number = {p: i for i, p in enumerate(text)}
        far = len(order) + 1

        def spine(p: str, side: int) -> list[tuple[int, int]]:
            out, until = [], far
            while True:
                out.append((number[p], until))
                if len(p) == 1:
                    return out
                until, p = rank[p], tree[p][side]

        def spines(side: int) -> tuple[np.ndarray, np.ndarray]:
            all_ = [spine(p, side) for p in text]
            deep = max(map(len, all_))
            node, until = np.full((len(text), deep), -1, np.int32), np.zeros((len(text), deep), np.int32)
            for i, x in enumerate(all_):
                for j, (a, u) in enumerate(x):
                    node[i, j], until[i, j] = a, u
            return node, until

        pairs = {}
        for p in order:
            for i in range(1, len(p)):
                a, b = number.get(p[:i]), number.get(p[i:])
                if a is not None and b is not None:
                    pairs[a * (len(text) + 1) + b] = rank[p]
        pk = np.array(sorted(pairs), np.int64)
        keys = np.array([cls.key(p) for p in text], np.uint64)
        at = np.argsort(keys, kind="stable")
        r, ru = spines(1)
        le, lu = spines(0)
        tops = max((len(p) for p in spaces), default=1)
        runs = {c: sp.encode(" " * (c - 1)) if c > 1 else [sp.piece_to_id(MARK)] for c in range(1, 4 * tops + 1)}
        return cls(
            text, np.array([sp.piece_to_id(p) for p in text], np.int32), np.array([score[p] for p in text]), byte_ids, runs, max(map(len, text)),
            keys[at], at.astype(np.int32), pk, np.array([pairs[k] for k in pk], np.int32), r, ru, le, lu, names,
        )

    @staticmethod
    def key(piece: str) -> int:
        h = 0
        for ch in piece:
            h = (h * int(_BASE) + ord(ch) + 1) & ((1 << 64) - 1)
        return h

    def run(self, n: int) -> list[int]:
        """Ids of n space marks: equal scores merge from the left, so a long run repeats its longest piece."""
        if n in self.runs:
            return self.runs[n]
        top = max(self.runs) // 4
        whole = (n - 2 * top) // top
        return self.runs[top] * whole + self.runs[n - whole * top]

    def stands(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces a and b stay apart: no merge joins a right end of a with a left end of b while both exist."""
        nr, nl = self.right_depth[a], self.left_depth[b]
        n = nr * nl
        pair = np.repeat(np.arange(len(a)), n)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        i, j = k // nl[pair], k % nl[pair]
        u, v = self.right[a[pair], i], self.left[b[pair], j]
        key = u.astype(np.int64) * (len(self.text) + 1) + v
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        r = np.where(self.pair_keys[at] == key, self.pair_rank[at], 1 << 30)
        crossed = (r < self.right_until[a[pair], i]) & (r <= self.left_until[b[pair], j])
        out = np.ones(len(a), bool)
        out[pair[crossed]] = False
        return out


class Encoder:
    """Encodes words and remembers them, up to a bound; beyond it, those met once make room."""

    def __init__(self, pieces: Pieces, bound: int = 300_000):
        self.p, self.bound = pieces, bound
        self.seen_key, self.seen_ok = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)
        self.pair_memo: dict[int, bool] = {}
        self.number = None
        self.mark = pieces.ids_of_mark
        self.clear()

    def clear(self) -> None:
        self.memo: dict[str, int] = {}
        self.flat_ids: list[np.ndarray] = []
        self.flat_counts: list[np.ndarray] = []
        self.n_ids: list[np.ndarray] = []
        self.n_chars: list[np.ndarray] = []
        self.uses = np.zeros(0, np.int64)

    def prune(self) -> None:
        """Keeps what was met again, the most used half of the bound at most; a word forgotten is only encoded anew."""
        keep = np.flatnonzero(self.uses >= 2)
        if len(keep) > self.bound // 2:
            keep = np.sort(np.argpartition(-self.uses, self.bound // 2)[: self.bound // 2])
        place = np.full(len(self.memo), -1, np.int64)
        place[keep] = np.arange(len(keep))
        for what, parts, lens in (("ids", self.flat_ids, self.n_ids), ("counts", self.flat_counts, self.n_chars)):
            flat, at, n = self.tables(what)
            n = n[keep]
            parts[:] = [flat[np.repeat(at[keep] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]]
            lens[:] = [n]
        places = place.tolist()
        self.memo = {s: places[i] for s, i in self.memo.items() if places[i] >= 0}
        self.uses = self.uses[keep] // 2

    def allowed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = self.p.unknown
        free = (a < 0) | (a == n) | (b == n)
        out = free.copy()
        rows = np.flatnonzero(~free)
        if not len(rows):
            return out
        k = a[rows].astype(np.int64) * (n + 1) + b[rows]
        at = (k.view(np.uint64) * _BASE >> np.uint64(64 - PAIR_BITS)).astype(np.intp)
        miss = np.flatnonzero(self.seen_key[at] != k)
        ok = self.seen_ok[at]
        if len(miss):
            new, inverse = np.unique(k[miss], return_inverse=True)
            stands = self.p.stands(new // (n + 1), new % (n + 1))
            ok[miss] = stands[inverse]
            self.seen_key[at[miss]], self.seen_ok[at[miss]] = k[miss], ok[miss]
            # Two new pairs may share a place: what was written last has to fit together.
            self.seen_ok[at[miss]] = np.where(self.seen_key[at[miss]] == k[miss], ok[miss], self.seen_ok[at[miss]])
        out[rows] = ok
        return out

    def together(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words as rows of code points, 0 behind their ends: for each prefix the length of its last piece, the number of its
        pieces, and whether a mark alone comes first."""
        p = self.p
        n, L = chars.shape
        hits = []
        h = np.zeros((n, L), np.uint64)
        for l in range(1, min(L, p.longest) + 1):
            h = h[:, : L - l + 1] * _BASE + chars[:, l - 1 :].astype(np.uint64) + np.uint64(1)
            at = np.searchsorted(p.keys, h)
            at[at == len(p.keys)] = 0
            hits.append(np.asfortranarray(np.where(p.keys[at] == h, p.key_piece[at], p.unknown if l == 1 else NONE)))
        last, count = np.full((n, L + 1), NONE, np.int32, order="F"), np.zeros((n, L + 1), np.int32, order="F")
        best, back = np.full((n, L + 1), -np.inf, order="F"), np.zeros((n, L + 1), np.int16, order="F")
        lone = np.zeros((n, L + 1), bool, order="F")
        last[:, 0], best[:, 0] = START, 0.0
        score = np.append(p.score, 0.0)
        mark = p.text.index(MARK)
        for e in range(1, L + 1):
            rows, lens = [], []
            for l in range(min(e, p.longest), 0, -1):
                r = np.flatnonzero((hits[l - 1][:, e - l] >= 0) & (last[:, e - l] != NONE))
                rows.append(r)
                lens.append(np.full(len(r), l))
            row, l = np.concatenate(rows), np.concatenate(lens)
            b = np.concatenate([hits[x - 1][r, e - x] for r, x in zip(rows, range(min(e, p.longest), 0, -1), strict=True)])
            sums = np.where(self.allowed(last[row, e - l], b), best[row, e - l] + score[b], -np.inf)
            np.maximum.at(best[:, e], row, sums)
            won = np.flatnonzero((sums == best[row, e]) & (sums > -np.inf))
            row, l, b = row[won], l[won], b[won]
            last[row, e], back[row, e] = b, l
            one = np.ones(len(row), np.int32)
            unk = np.flatnonzero(b == p.unknown)
            if len(unk):
                c = chars[row[unk], e - 1]
                one[unk] = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
            count[row, e] = count[row, e - l] + one
            lone[row, e] = np.where(l == e, b == mark, lone[row, e - l])
        return back, count, lone

    def alone(self, word: str) -> tuple[list[int], list[int], list[bool]]:
        """The same for one word; as only one piece can end an encoding that stands, the first found is the maximum."""
        p = self.p
        if self.number is None:
            self.number = {t: i for i, t in enumerate(p.text)}
        n, number, memo = p.unknown, self.number, self.pair_memo
        last, back, count, lone = [START], [0], [0], [False]
        for e in range(1, len(word) + 1):
            found = NONE
            for l in range(min(e, p.longest), 0, -1):
                a = last[e - l]
                b = number.get(word[e - l : e], n if l == 1 else NONE)
                if b == NONE or a == NONE:
                    continue
                if a < 0 or a == n or b == n:
                    ok = True
                else:
                    k = a * (n + 1) + b
                    ok = memo.get(k)
                    if ok is None:
                        ok = memo[k] = bool(p.stands(np.array([a]), np.array([b]))[0])
                if ok:
                    found = b
                    last.append(b)
                    back.append(l)
                    count.append(count[e - l] + (len(word[e - 1].encode("utf-8", "surrogatepass")) if b == n else 1))
                    lone.append(lone[e - l] if l < e else word[:e] == MARK)
                    break
            if found == NONE:
                last.append(NONE)
                back.append(0)
                count.append(count[-1])
                lone.append(False)
        return back, count, lone

    def word_ids(self, word: str, back) -> list[int]:
        out, e = [], len(word)
        if self.number is None:
            self.number = {t: i for i, t in enumerate(self.p.text)}
        while e > 0:
            l = max(1, int(back[e]))
            b = self.number.get(word[e - l : e])
            out.append([int(self.p.ids[b])] if b is not None else [int(self.p.byte_ids[x]) for x in word[e - l : e].encode("utf-8", "surrogatepass")])
            e -= l
        return [i for part in reversed(out) for i in part]

    def learn(self, segments: list[str]) -> None:
        """Encodes segments not met before; a segment is a run of spaces and a word, or either alone."""
        classes: dict[int, list[str]] = {}
        rest = []
        for s in segments:
            if s[0] == " " and s.lstrip(" ▁"):
                # Lengths within an eighth of each other.
                n = len(s.lstrip(" ▁")) + 1
                classes.setdefault(n if n < 16 else n >> (n.bit_length() - 4) << (n.bit_length() - 4), []).append(s)
            else:
                rest.append(s)
        for words in classes.values():
            if len(words) < FEW:
                rest += words
                continue
            words.sort(key=lambda s: len(s.lstrip(" ▁")))
            step = max(1, min(16384, CELLS // (len(words[-1]) + 1)))
            for i in range(0, len(words), step):
                part = words[i : i + step]
                cores = [MARK + s.lstrip(" ▁") for s in part]
                size = np.array([len(c) for c in cores])
                L = int(size.max())
                chars = np.zeros((len(part), L), np.uint32)
                chars[np.arange(L) < size[:, None]] = np.frombuffer("".join(cores).encode("utf-32-le", "surrogatepass"), np.uint32)
                back, count, lone = self.together(chars)
                ids, n_ids = self.trace(chars, back, size)
                if all(len(s) == len(c) for s, c in zip(part, cores, strict=True)):
                    self.add(part, ids, n_ids, np.ascontiguousarray(count[:, 1:])[np.arange(L) < size[:, None]], size)
                    continue
                off = np.cumsum(n_ids) - n_ids
                for j, (s, core) in enumerate(zip(part, cores, strict=True)):
                    m = size[j]
                    self.led(s, len(s) - len(core) + 1, ids[off[j] : off[j] + n_ids[j]], count[j, : m + 1], lone[j, : m + 1])
        for s in rest:
            w = s.lstrip(" ▁")
            lead = len(s) - len(w)
            if not w:
                ids = self.p.run(lead)
                self.add([s], np.array(ids, np.int32), np.array([len(ids)]), np.array([len(self.p.run(j)) for j in range(1, lead + 1)], np.int32), np.array([lead]))
                continue
            core = (MARK if lead else "") + w
            back, counts, lone = self.alone(core)
            self.led(s, lead, np.array(self.word_ids(core, back), np.int32), np.array(counts, np.int32), np.array(lone))

    def led(self, segment: str, lead: int, ids: np.ndarray, counts: np.ndarray, lone: np.ndarray) -> None:
        """Adds a word behind `lead` spaces, given the encoding of the word behind one."""
        if lead > 1:
            run = self.p.run
            spaces = [len(run(j)) for j in range(lead + 1)]
            ids = np.concatenate([np.array(run(lead), np.int32), ids[1:]] if ids[0] == self.mark else [np.array(run(lead - 1), np.int32), ids])
            counts = np.concatenate([spaces[:-1], spaces[-1:], counts[2:] + np.where(lone[2:], spaces[lead] - 1, spaces[lead - 1])])
        self.add([segment], ids.astype(np.int32), np.array([len(ids)]), counts[1:].astype(np.int32), np.array([len(segment)]))

    def add(self, segments: list[str], ids: np.ndarray, n_ids: np.ndarray, counts: np.ndarray, n_chars: np.ndarray) -> None:
        self.memo.update(zip(segments, range(len(self.memo), len(self.memo) + len(segments)), strict=True))
        self.flat_ids.append(ids)
        self.n_ids.append(n_ids)
        self.flat_counts.append(counts)
        self.n_chars.append(n_chars)

    def trace(self, chars: np.ndarray, back: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Follows the backpointers of equal-length words together: flat ids, and how many each word has."""
        p, (n, L) = self.p, chars.shape
        owner, place, got, extra = [], [], [], []
        e = size.astype(np.int64)
        while True:
            rows = np.flatnonzero(e > 0)
            if not len(rows):
                break
            l = back[rows, e[rows]].astype(np.int64)
            s = e[rows] - l
            h = np.zeros(len(rows), np.uint64)
            for j in range(int(l.max())):
                on = np.flatnonzero(l > j)
                h[on] = h[on] * _BASE + chars[rows[on], s[on] + j].astype(np.uint64) + np.uint64(1)
            at = np.minimum(np.searchsorted(p.keys, h), len(p.keys) - 1)
            known = p.keys[at] == h
            owner.append(rows[known])
            place.append(s[known] * 4)
            got.append(p.ids[p.key_piece[at[known]]])
            for r, c in zip(rows[~known], s[~known], strict=True):
                extra += [(r, c * 4 + k, p.byte_ids[x]) for k, x in enumerate(chr(chars[r, c]).encode("utf-8", "surrogatepass"))]
            e[rows] = s
        if extra:
            x = np.array(extra)
            owner.append(x[:, 0])
            place.append(x[:, 1])
            got.append(x[:, 2])
        owner, place, got = np.concatenate(owner), np.concatenate(place), np.concatenate(got).astype(np.int32)
        order = np.argsort(owner * (4 * L + 4) + place, kind="stable")
        return got[order], np.bincount(owner, minlength=n)

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Segment numbers of all texts, and how many segments each text has."""
        if len(self.memo) > self.bound:
            self.prune()
        cut = [SEGMENT.findall(" " + t) if t else [] for t in texts]
        new = {s for c in cut for s in c}.difference(self.memo)
        if new:
            self.learn(sorted(new))
        get = self.memo.__getitem__
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        segs = np.fromiter(map(get, chain.from_iterable(cut)), np.int64, int(counts.sum()))
        uses = np.bincount(segs, minlength=len(self.memo))
        uses[: len(self.uses)] += self.uses
        self.uses = uses
        return segs, counts

    def tables(self, what: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat values, the offset of each segment, and its length: `ids`, or `counts` at each character."""
        parts, lens = (self.flat_ids, self.n_ids) if what == "ids" else (self.flat_counts, self.n_chars)
        if len(parts) > 1:
            parts[:], lens[:] = [np.concatenate(parts)], [np.concatenate(lens)]
        n = lens[0].astype(np.int64) if lens else np.zeros(0, np.int64)
        return (parts[0] if parts else np.zeros(0, np.int32)), np.cumsum(n) - n, n


def kept_encoder(name: str, pieces: Pieces) -> Encoder:
    """This process's encoder of that name, with what it has learnt in earlier tasks; a new name drops the old one."""
    return kept(name, lambda: Encoder(pieces))
