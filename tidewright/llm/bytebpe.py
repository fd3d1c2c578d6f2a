"""Byte-level BPE over whole columns (problem 7).

A column is encoded a chunk at a time with array operations:

1. Pre-tokens.  The split pattern of the tokenizer is turned into rules on
   character classes, which find all piece boundaries of a chunk at once.
2. Known pieces.  A piece is looked up by a polynomial hash of its bytes and
   compared byte by byte with the piece stored there, so a collision can't
   give wrong ids.
3. New pieces are merged with a segment tree over byte positions.  A leaf holds
   the rank of the pair that starts there, a node the leftmost minimum below
   it; a merge takes the root's pair and updates the leaves of the live
   neighbours, a logarithmic number of nodes each.  Pieces of like length run
   through their trees side by side, one array row per piece; very long pieces
   have a tree of their own.
"""

from __future__ import annotations

import base64
import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabulary lies; a parameter of every function here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Bytes of text that are worked on at once, pieces remembered, and the longest piece that shares an array with others.
CHUNK, REMEMBER, SIDE_BY_SIDE = 1 << 20, 1 << 20, 256

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
#: White space as regular expressions of the tokenizer see it. (fixed values of Unicode's White_Space)
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
INF = np.int64(1) << 60


@functools.cache
def char_classes() -> np.ndarray:
    t = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            t[c] = LETTER
        elif k == "N":
            t[c] = NUMBER
    t[WHITE] = SPACE
    return t


def piece_starts(cp: np.ndarray, row_start: np.ndarray) -> np.ndarray:
    """Flags of the characters that begin a piece; ``row_start`` flags those that begin a text."""
    n = len(cp)
    c = char_classes()[cp]
    start = row_start.copy()
    if n < 2:
        return start
    cut = row_start[1:]
    start[1:] |= c[1:] != c[:-1]
    # The last of several white spaces before other text stands alone, or joins what follows if it is a blank.
    gap = (c[:-1] == SPACE) & (c[1:] != SPACE) & ~cut
    start[:-1] |= gap
    joined = gap & (cp[:-1] == 32)
    start[1:] &= ~joined
    # Contractions, where an apostrophe is the first character of its piece.
    q = np.flatnonzero(cp == 39)
    if len(q):
        prev = np.where(q > 0, c[q - 1], SPACE)
        first = row_start[q] | (prev == LETTER) | (prev == NUMBER) | ((prev == SPACE) & (cp[q - 1] != 32))
        q = q[first]
        ends = np.append(np.flatnonzero(row_start), n)
        left = ends[np.searchsorted(ends, q, "right")] - q
        a = np.where(left > 1, cp[np.minimum(q + 1, n - 1)], 0)
        b = np.where(left > 2, cp[np.minimum(q + 2, n - 1)], 0)
        one = np.isin(a, [115, 116, 109, 100])  # s t m d
        two = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))  # re ve ll
        size = np.where(one, 2, np.where(two, 3, 0))
        q, size, left = q[size > 0], size[size > 0], left[size > 0]
        start[q + 1] = False
        after = (q + size)[left > size]
        start[after] = True
    return start


class _Pairs:
    """Rank of the pair of two tokens, for arrays of them."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, vals = [], []
        for token, r in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a << 20 | b)
                    vals.append(r)
        self.table = dict(zip(keys, vals))
        k = np.array(keys, np.int64)
        self.bits = max(4, int(np.ceil(np.log2(len(k) * 3 + 1))))
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.val = np.zeros(1 << self.bits, np.int64)
        at, todo = self._at(k), np.arange(len(k))
        v = np.array(vals, np.int64)
        while len(todo):
            free = self.key[at] == -1
            self.key[at[free]] = k[todo[free]]
            won = self.key[at] == k[todo]
            self.val[at[won]] = v[todo[won]]
            at, todo = (at[~won] + 1) & ((1 << self.bits) - 1), todo[~won]

    def _at(self, k: np.ndarray) -> np.ndarray:
        return ((k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """INF where the pair doesn't merge or a token is missing (-1)."""
        out = np.full(len(a), INF)
        todo = np.flatnonzero((a >= 0) & (b >= 0))
        k = a[todo].astype(np.int64) << 20 | b[todo]
        at = self._at(k)
        while len(todo):
            got = self.key[at]
            hit = got == k
            out[todo[hit]] = self.val[at[hit]]
            go = ~hit & (got != -1)
            at, todo, k = (at[go] + 1) & ((1 << self.bits) - 1), todo[go], k[go]
        return out


class Encoder:
    """Encodes Arrow string arrays; remembers pieces between calls."""

    def __init__(self, vocabulary: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        self.byte_id = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.pairs = _Pairs(ranks)
        rng = np.random.default_rng(7)
        self.mult = int(rng.integers(1 << 62, dtype=np.int64)) * 2 + 1
        self.inv = pow(self.mult, -1, 1 << 64)
        self.letter = rng.integers(1 << 63, size=256, dtype=np.int64).astype(np.uint64)
        self.pow = self.ipow = np.ones(1, np.uint64)
        self._forget()

    def _forget(self) -> None:
        self.bits = 16
        self.key, self.slot = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int64)
        self.n = 0
        self.h = np.zeros(1024, np.uint64)
        self.bstart, self.blen, self.istart, self.ilen = (np.zeros(1024, np.int64) for _ in range(4))
        self.bytes, self.ids = np.zeros(1 << 14, np.uint8), np.zeros(1 << 14, np.int32)
        self.nb = self.ni = 0

    def _powers(self, n: int) -> None:
        if len(self.pow) < n:
            for name, m in (("pow", self.mult), ("ipow", self.inv)):
                with np.errstate(over="ignore"):
                    factors = np.full(n, m, np.uint64)
                    factors[0] = 1
                    setattr(self, name, np.cumprod(factors, dtype=np.uint64))

    # ---- segment trees -------------------------------------------------

    def _merge_rows(self, sym: np.ndarray, size: np.ndarray) -> np.ndarray:
        """BPE of many pieces: ``sym`` (n, S) token per byte, -1 after the end; merged in place."""
        n, S = sym.shape
        nxt = np.tile(np.arange(1, S + 1, dtype=np.int32), (n, 1))
        prv = np.tile(np.arange(-1, S - 1, dtype=np.int32), (n, 1))
        tree = np.full((n, 2 * S), INF)
        if S > 1:
            r = self.pairs.rank(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(n, S - 1)
            tree[:, S : 2 * S - 1] = np.where(r < INF, r * S + np.arange(S - 1), INF)
        level = S
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        live = np.flatnonzero(tree[:, 1] < INF)
        while len(live):
            root = tree[live, 1]
            left = root % S
            right = nxt[live, left]
            far = nxt[live, right].astype(np.int64)
            near = prv[live, left].astype(np.int64)
            sym[live, left] = root // S
            sym[live, right] = -1
            nxt[live, left] = far
            ok = far < size[live]
            prv[live[ok], far[ok]] = left[ok]
            me = sym[live, left]
            a = self.pairs.rank(me, np.where(ok, sym[live, np.minimum(far, S - 1)], -1))
            b = self.pairs.rank(np.where(near >= 0, sym[live, np.maximum(near, 0)], -1), me)
            tree[live, S + right] = INF
            tree[live, S + left] = np.where(a < INF, a * S + left, INF)
            has = near >= 0
            tree[live[has], S + near[has]] = np.where(b[has] < INF, b[has] * S + near[has], INF)
            ups = [(live, S + right), (live, S + left), (live[has], S + near[has])]
            level = S
            while level > 1:
                nodes = []
                for rows, at in ups:
                    at = at >> 1
                    tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])
                    nodes.append((rows, at))
                ups, level = nodes, level // 2
            live = live[tree[live, 1] < INF]
        return sym

    def merge_one(self, piece: bytes) -> list[int]:
        """BPE of one long piece with a segment tree of its own."""
        get, n = self.pairs.table.get, len(piece)
        sym = [int(self.byte_id[x]) for x in piece]
        S = 1 << max(1, (n - 1).bit_length())
        none = (1 << 60, 0)
        tree = [none] * (2 * S)

        def pair(i, j):
            r = get(sym[i] << 20 | sym[j])
            return none if r is None else (r, i)

        for i in range(n - 1):
            tree[S + i] = pair(i, i + 1)
        for k in range(S - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i, v):
            k = S + i
            tree[k] = v
            k >>= 1
            while k:
                v = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == v:
                    break
                tree[k] = v
                k >>= 1

        while tree[1] is not none and tree[1][0] < none[0]:
            r, i = tree[1]
            j = nxt[i]
            sym[i], sym[j] = r, -1
            f = nxt[i] = nxt[j]
            put(j, none)
            if f < n:
                prv[f] = i
            put(i, pair(i, f) if f < n else none)
            if prv[i] >= 0:
                put(prv[i], pair(prv[i], i))
        return [x for x in sym if x >= 0]

    def _encode_new(self, data: np.ndarray, s: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after another, number of ids of each)."""
        parts: list = [None] * len(s)
        count = np.zeros(len(s), np.int64)
        width = 1 << np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64)
        flat, owner = [], []
        for S in np.unique(width):
            at = np.flatnonzero(width == S)
            if S > SIDE_BY_SIDE:
                for i in at:
                    ids = np.array(self.merge_one(data[s[i] : s[i] + size[i]].tobytes()), np.int32)
                    flat.append(ids)
                    owner.append(np.full(len(ids), i))
                    count[i] = len(ids)
                continue
            step = max(1, (1 << 18) // int(S))
            for k in range(0, len(at), step):
                rows = at[k : k + step]
                pos = np.arange(S)
                inside = pos < size[rows, None]
                src = np.minimum(s[rows, None] + pos, len(data) - 1)
                sym = np.where(inside, self.byte_id[data[src]], -1).astype(np.int32)
                sym = self._merge_rows(sym, size[rows])
                keep = sym >= 0
                count[rows] = keep.sum(1)
                flat.append(sym[keep])
                owner.append(np.repeat(rows, count[rows]))
        del parts
        if not flat:
            return np.zeros(0, np.int32), count
        ids, own = np.concatenate(flat), np.concatenate(owner)
        return ids[np.argsort(own, kind="stable")], count

    # ---- pieces known so far --------------------------------------------

    def _find(self, h: np.ndarray) -> np.ndarray:
        mask = (1 << self.bits) - 1
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.slot[at]
        bad = np.flatnonzero((out >= 0) & (self.key[at] != h))
        at = at[bad]
        while len(bad):
            at = (at + 1) & mask
            got = self.slot[at]
            out[bad] = got
            go = (got >= 0) & (self.key[at] != h[bad])
            bad, at = bad[go], at[go]
        return out

    def _insert(self, ids: np.ndarray) -> None:
        mask, h = (1 << self.bits) - 1, self.h[ids]
        at, todo = (h >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(len(ids))
        while len(todo):
            free = np.flatnonzero(self.slot[at] < 0)
            _, one = np.unique(at[free], return_index=True)
            free = free[one]
            self.slot[at[free]], self.key[at[free]] = ids[todo[free]], h[todo[free]]
            rest = np.ones(len(todo), bool)
            rest[free] = False
            at, todo = (at[rest] + 1) & mask, todo[rest]

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if len(a) >= n else np.concatenate([a, np.zeros(max(n - len(a), len(a)), a.dtype)])

    def _learn(self, data: np.ndarray, s: np.ndarray, size: np.ndarray, h: np.ndarray) -> None:
        ids, count = self._encode_new(data, s, size)
        m, nb, ni = len(s), int(size.sum()), len(ids)
        for name in ("h", "bstart", "blen", "istart", "ilen"):
            setattr(self, name, self._room(getattr(self, name), self.n + m))
        self.bytes, self.ids = self._room(self.bytes, self.nb + nb), self._room(self.ids, self.ni + ni)
        new = slice(self.n, self.n + m)
        self.h[new], self.blen[new], self.ilen[new] = h, size, count
        self.bstart[new] = self.nb + np.cumsum(size) - size
        self.istart[new] = self.ni + np.cumsum(count) - count
        self.bytes[self.nb : self.nb + nb] = data[_ranges(s, size)]
        self.ids[self.ni : self.ni + ni] = ids
        old, self.n, self.nb, self.ni = self.n, self.n + m, self.nb + nb, self.ni + ni
        if self.n * 3 > 1 << self.bits:
            while self.n * 3 > 1 << self.bits:
                self.bits += 1
            self.key, self.slot = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int64)
            old = 0
        self._insert(np.arange(old, self.n))

    # ---- texts ------------------------------------------------------------

    def pieces(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(byte starts of the pieces of a chunk, number of pieces per text); ``ends`` are byte ends of the texts."""
        text = data.tobytes().decode("utf-8", "surrogatepass")
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(cp) == len(data):
            byte = None
            char_end = ends
        else:
            byte = np.flatnonzero((data & 0xC0) != 0x80)
            char_end = np.searchsorted(byte, ends)
        begin = np.concatenate([[0], char_end[:-1]])
        row_start = np.zeros(len(cp) + 1, bool)
        row_start[begin] = True
        at = np.flatnonzero(piece_starts(cp, row_start[:-1]))
        per_row = np.searchsorted(at, char_end) - np.searchsorted(at, begin)
        return (at if byte is None else byte[at]), per_row

    def _chunk(self, data: np.ndarray, ends: np.ndarray, want_ids: bool) -> tuple[np.ndarray | None, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(ends), np.int64)
        s, per_row = self.pieces(data, ends)
        size = np.diff(np.append(s, len(data)))
        self._powers(len(data) + 1)
        with np.errstate(over="ignore"):
            pre = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.letter[data] * self.pow[: len(data)], dtype=np.uint64)])
            h = (pre[s + size] - pre[s]) * self.ipow[s]
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xBF58476D1CE4E5B9)
        if self.n > REMEMBER or self.nb > 64 * REMEMBER:
            self._forget()
        p = self._find(h)
        new = np.flatnonzero(p < 0)
        if len(new):
            _, first = np.unique(h[new], return_index=True)
            first = new[first]
            self._learn(data, s[first], size[first], h[first])
            p[new] = self._find(h[new])
        # Byte by byte: the piece found is the piece in the text.
        wrong = self.blen[p] != size
        if not wrong.any():
            same = data == self.bytes[_ranges(self.bstart[p], size)]
            if not same.all():
                wrong = np.minimum.reduceat(same, s) == 0
        count = self.ilen[p]
        if wrong.any():
            return self._slow(data, s, size, per_row)
        row = np.add.reduceat(np.append(count, 0), np.minimum(np.cumsum(per_row) - per_row, len(count))) * (per_row > 0)
        return (self.ids[_ranges(self.istart[p], count)] if want_ids else None), row

    def _slow(self, data, s, size, per_row):
        """Two pieces of one hash in a chunk: each piece by itself."""
        got = [self.merge_one(data[a : a + n].tobytes()) for a, n in zip(s, size)]
        count = np.array([len(x) for x in got] + [0], np.int64)
        row = np.add.reduceat(count, np.minimum(np.cumsum(per_row) - per_row, len(got))) * (per_row > 0)
        return np.array([i for x in got for i in x], np.int32), row

    def encode(self, texts: pa.Array, want_ids: bool = True) -> tuple[np.ndarray | None, np.ndarray]:
        """(ids of all texts one after another, number of ids of each text); null counts as empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        buf = texts.buffers()[2]
        data = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
        ids, counts, i = [], [], 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(off, off[i] + CHUNK, "right")) - 1)
            a, n = self._chunk(data[off[i] : off[j]], off[i + 1 : j + 1] - off[i], want_ids)
            ids.append(a)
            counts.append(n)
            i = j
        return (np.concatenate(ids) if ids else np.zeros(0, np.int32)) if want_ids else None, np.concatenate(counts) if counts else np.zeros(0, np.int64)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... size[0] of them, then those of start[1], ..."""
    end = np.cumsum(size)
    out = np.repeat(start - (end - size), size)
    out += np.arange(len(out))
    return out


_ENCODERS: dict[int, Encoder] = {}


def encoder(vocabulary: bytes) -> Encoder:
    """The encoder of this Python worker for a vocabulary."""
    k = hash(vocabulary)
    if k not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[k] = Encoder(vocabulary)
    return _ENCODERS[k]


def _shipped(df: DataFrame, vocabulary: str):
    """The vocabulary file as a broadcast: about 1 MB, whatever the corpus."""
    with open(vocabulary, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ids): token ids of every text, without special tokens; strings of special tokens are ordinary text.

    An empty and a null text have an empty list.  Every row gives a row, with
    repeated or null ids too; a text of any length is encoded whole.
    """
    rows = df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    kind = rows.schema["i"].dataType.simpleString()
    shipped = _shipped(df, vocabulary)

    def run(batches):
        enc = encoder(shipped.value)
        for b in batches:
            for k in range(0, b.num_rows, 2048):
                part = b.slice(k, 2048)
                ids, n = enc.encode(part.column(1))
                off = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(off), pa.array(ids))], names=["i", "ids"])

    return rows.mapInArrow(run, f"i {kind}, ids array<int>").withColumnRenamed("i", id_col)


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, n): number of tokens of every text."""
    rows = df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    kind = rows.schema["i"].dataType.simpleString()
    shipped = _shipped(df, vocabulary)

    def run(batches):
        enc = encoder(shipped.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(enc.encode(b.column(1), False)[1], pa.int64())], names=["i", "n"])

    return rows.mapInArrow(run, f"i {kind}, n bigint").withColumnRenamed("i", id_col)
