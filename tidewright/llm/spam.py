"""Keyword-stuffed and link-list pages (problem 9).

A page is cut into passages: sentences, and runs of lines that end without
sentence punctuation.  Every passage becomes a sequence of word classes:
function words of eight languages, content words, content words that the
passage has already had, links by the shape of their address, tags, markup,
indicators, numbers, punctuation.  A trigram model of these classes is trained
on prose, and a passage whose perplexity lies outside the range of prose, on
either side, is abnormal.  A page is found when abnormal passages are the
larger part of its text.

Prose is chosen by its form alone: a sentence with end and few repeated words.
The model decides everything else, also which shapes of addresses prose names:
those, and indicators, are read as one where they run in a list, and don't
count as text of a suspect page; an analyst's list of addresses is a list of
such.  Shapes that prose never names stay as improbable as the model has them.

Lines of logs, tables, transcripts and record dumps are neither prose nor
spam, nor has a passage of a few words a perplexity to speak of; they count in
the length of the page only.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Words without content of the eight languages of the corpus. (fixed values)
FUNCTION_WORDS = frozenset(
    """
    a an the of in on at to for from by with and or but not no is are was were be been has have had it its this that these those there here we you he she they
    our your his her their who which what when where as if than then so because until after before between about into over under only all any some each other
    le la les un une des du de d l et ou mais ne pas est sont a ont été il elle ils nous vous ce cette ces qui que dans sur pour par avec sans après son sa ses
    el los las uno una unos y o pero no es son fue ha han se su sus lo al del en con sin por para que como más entre cada
    der die das den dem des ein eine einen einem einer und oder aber nicht ist sind war wurde wurden hat haben er sie es wir ihr in im an am auf aus bei bis mit nach von vor zu zum zur um weil ob noch
    o os as um uma e ou mas não é são foi tem se seu sua no na nos nas em com sem por para que até após
    и в во на не что с со из за по к до от для он она они это как но или о об у же был была было после потом
    yang dan di ke dari untuk dengan tidak adalah ini itu pada setelah telah akan apakah oleh karena masih juga para
    的 了 在 是 和 不 与 及 或 由于 这 那 我们 他 她
    """.split()
)

#: Shapes of addresses: host without and with a number at the end of a label, each with no path, a query, a path that ends in a digit, another path.
LINKS = "abdejmop"
#: Classes of the model, one letter each: begin, end, function word, content word (small or capital, first or repeated), CJK sign (first or repeated), number, tag, other, markup, indicator.
CLASSES = "^$fcCrRzyntghi,.;:|-=" + LINKS
INDEX = {c: i for i, c in enumerate(CLASSES)}
K = len(CLASSES)
#: Classes of words, links and tags; a passage is judged from this number of them on.
JUDGED, LEAST = "fcCrRzyt" + LINKS, 6
#: Surprisal in bits up to which prose names a shape of address: once in 4096 tokens.
NAMED = 12.0
#: Part of the content words of a sentence that may be repeated for it to count as prose by form.
REPEATED = 0.15

_RECORD = re.compile(
    r"""\s*(?:[>*-]\s+)?(?:
        \d{4}-\d\d-\d\d[T ]\d\d:\d\d            # a log line
      | \[\d\d?:\d\d(?::\d\d)?\]                # a line of a transcript
      | (?:[\[{]\s*)*"(?:[^"\\\n]|\\.)*"\s*:       # a dump of records: a quoted name and a colon
      | [\[\]{}][\s\[\]{},]*$                     # or brackets alone
    )""",
    re.X,
)
_RECORD_BEGINS = frozenset('0123456789[]{}">*-')
_TABLE_END = re.compile(r"[,;|\t]\s*\d{4}-\d\d-\d\d[T ]\d\d:\d\d$")


def _is_record(line: str) -> bool:
    """A line of a log, transcript or dump, or a row of a table that ends in a time."""
    if line.lstrip()[:1] in _RECORD_BEGINS and _RECORD.match(line):
        return True
    end = line[-64:].rstrip()
    return end[-1:].isdigit() and bool(_TABLE_END.search(end)) and sum(map(line.count, ",;|\t")) >= 3


def _is_sentence(text: str) -> bool:
    return bool(_TERMINAL.search(text[-64:].rstrip()))


_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”»)]*\s+|(?<=[。！？])")
_TERMINAL = re.compile(r"[.!?。！？…][\"'”»)\]]*$")
_TOKEN = re.compile(
    r"""<[^<>\n]*>
      | (?:https?|hxxps?)://(?:[^\s<>"')\]|,;\[]|\[\.\])+
      | [\w.+-]++@[\w.\[\]-]+
      | \d{1,3}(?:\[?\.\]?\d{1,3}){3}(?![\w.])
      | (?=[\w-]++\[?\.)(?:www\.)?\w[\w-]*(?:\[?\.\]?\w[\w-]*)*\[?\.\]?[A-Za-z]{2,}(?:/[^\s<>"')\]|,;]*)?(?![\w])
      | tag:\S+ | [#＃][^\W_][\w]*
      | [぀-ヿ㐀-鿿가-힯]
      | [^\W぀-ヿ㐀-鿿가-힯]+(?:['’]\w+)*
      | [^\w\s]""",
    re.X,
)
_DOMAIN = re.compile(r"^(?:[a-z]+://)?(?:www\.)?[\w-]+(?:\[?\.\]?[\w-]+)+(?:[/:?].*)?$", re.I)
_INDICATOR = re.compile(r"^(?:[0-9a-f]{32,}|\d{1,3}(?:\.\d{1,3}){3}|.*\[\.\].*|[\w.+-]+@.+)$", re.I)
_HREF = re.compile(r"""href\s*=\s*["']?([^"'\s>]+)""", re.I)
_LEET = str.maketrans("013457", "oleast")
_CJK = re.compile(r"^[぀-ヿ㐀-鿿가-힯]$")
_WORDCHAR = re.compile(r"[^\W\d_]")
_ADDRESS = re.compile(r"^(?:[a-z]+://)?(?:www\.)?([^/?#:]*)(?::\d+)?(.*)$", re.I | re.S)


def shape(address: str) -> str:
    """Class of a link by the shape of its address."""
    host, path = _ADDRESS.match(address).groups()
    path = path.rstrip("/")
    numbered = any(x[-1:].isdigit() and not x.isdigit() for x in re.split(r"\[?\.\]?", host))
    kind = 0 if not path else 1 if "?" in path else 2 if path[-1].isdigit() else 3
    return LINKS[4 * numbered + kind]


def _learn(tok: str) -> tuple[str, str | None]:
    """(class, folded word if it is a content word) of a token."""
    if tok.isalpha() and not _CJK.match(tok):
        low = tok.lower()
        if low in FUNCTION_WORDS:
            return "f", None
        return ("C" if tok[0].isupper() and (len(tok) == 1 or not tok.isupper()) else "c"), low
    if tok[0] == "<" and len(tok) > 1:
        m = _HREF.search(tok)
        return (shape(m[1]) if m else "h"), None
    if tok[0] in "#＃" and len(tok) > 1 or tok.lower().startswith("tag:"):
        return "t", None
    if _INDICATOR.match(tok):
        return "i", None
    if ("." in tok or "/" in tok) and len(tok) > 3 and _DOMAIN.match(tok) and _WORDCHAR.search(tok):
        return shape(tok), None
    if not _WORDCHAR.search(tok):
        if tok[0].isdigit():
            return "n", None
        return (tok if tok in ",.;:|-=" else "." if tok in "!?。！？…" else "," if tok in "，、" else "|" if tok in "·★/»•*~_" else "-" if tok in "–—" else "g"), None
    low = tok.lower()
    if low in FUNCTION_WORDS:
        return "f", None
    if _CJK.match(tok):
        return "z", tok
    return ("C" if tok[0].isupper() and (len(tok) == 1 or not tok.isupper()) else "c"), low.translate(_LEET)


_KNOWN: dict[str, tuple[str, str | None]] = {}


def passages(text: str):
    """(passage, its length with white space) of what is not a record, and the length of the whole text."""
    block: list[str] = []
    for line in text.splitlines():
        if not line.strip():
            continue
        if _is_record(line):
            if block:
                yield "\n".join(block)
                block = []
            continue
        parts = [p for p in _SENTENCE.split(line) if p and p.strip()]
        for p in parts:
            if _is_sentence(p):
                if block and sum(map(len, block)) > 80:
                    yield "\n".join(block)
                    yield p
                else:
                    yield "\n".join([*block, p]) if block else p
                block = []
            else:
                block.append(p)
    if block:
        yield "\n".join(block)


_AGAIN = {"c": "r", "C": "R", "z": "y"}
_COUNTED = {c: i for i, c in enumerate("i" + LINKS)}


def describe(passage: str) -> tuple[str, list[int], int, int]:
    """Class string, characters of indicators and of each shape of link, content words, repeated ones."""
    get, out, seen, chars, words = _KNOWN.get, [], set(), [0] * len(_COUNTED), 0
    for tok in _TOKEN.findall(passage):
        k = get(tok)
        if k is None:
            if len(_KNOWN) > 200_000:
                _KNOWN.clear()
            k = _KNOWN[tok] = _learn(tok)
        c, w = k
        if w is not None:
            words += 1
            if w in seen:
                c = _AGAIN[c]
            else:
                seen.add(w)
        elif c in _COUNTED:
            chars[_COUNTED[c]] += len(tok)
        out.append(c)
    return "".join(out), chars, words, words - len(seen)


PASSAGES = "doc_id bigint, size int, total int, seq string, chars array<int>, prose boolean"


def judge(text: str) -> list[tuple[str, list[int], int, bool]]:
    """(class string, characters of indicators and links, size, prose by form) of each passage of a page."""
    out = []
    for p in passages(unicodedata.normalize("NFC", text)):
        seq, chars, words, again = describe(p)
        prose = len(seq) >= LEAST and again <= REPEATED * words and _is_sentence(p)
        out.append((seq, chars, sum(map(len, p.split())), prose))
    return out


def _cut(batches):
    for b in batches:
        cols: list[list] = [[] for _ in range(6)]
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            total = sum(map(len, text.split()))
            for seq, chars, size, prose in judge(text):
                for c, x in zip(cols, (doc, size, total, seq, chars, prose)):
                    c.append(x)
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in PASSAGES.split(", ")])


def _codes(seqs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(trigram number of every token, number of tokens of each sequence)."""
    table = np.full(256, INDEX["g"], np.int64)
    for c, i in INDEX.items():
        table[ord(c)] = i
    n = np.fromiter(map(len, seqs), np.int64, len(seqs)) + 1
    x = table[np.frombuffer("".join("^^" + s + "$" for s in seqs).encode("latin-1"), np.uint8)]
    tri = (x[:-2] * K + x[1:-1]) * K + x[2:]
    keep = np.ones(len(x), bool)
    ends = np.cumsum(n + 2)
    keep[ends - 1] = keep[ends - 2] = False
    return tri[keep[: len(tri)]], n


def _count(batches):
    total = np.zeros(K**3, np.int64)
    for b in batches:
        tri, _ = _codes(b.column(0).to_pylist())
        total += np.bincount(tri, minlength=K**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["tri", "n"])


def train(cut: DataFrame) -> Model:
    """The model of all passages that are prose by form."""
    rows = cut.where("prose").select("seq").mapInArrow(_count, "tri bigint, n bigint").groupBy("tri").agg(F.sum("n").alias("n")).collect()
    c3 = np.zeros(K**3)
    for r in rows:  # at most one row per trigram of classes
        c3[r[0]] = r[1]
    return Model(c3)


def surprisals(counts: np.ndarray) -> np.ndarray:
    """(K, K, K) bits of a class after two others; interpolated with bigrams and a uniform share."""
    c3 = counts.reshape(K, K, K)
    c2, c1 = c3.sum(0), c3.sum((0, 1))
    p1 = (c1 + 1) / (c1.sum() + K)
    p2 = (c2 + 8 * p1) / (c2.sum(-1, keepdims=True) + 8)
    return -np.log2((c3 + 8 * p2) / (c3.sum(-1, keepdims=True) + 8))


def named_by_prose(counts: np.ndarray) -> str:
    """Indicators, and the shapes of links that prose names."""
    c1 = counts.reshape(K, K, K).sum((0, 1))
    bits = -np.log2((c1 + 1) / (c1.sum() + K))
    return "i" + "".join(c for c in LINKS if bits[INDEX[c]] <= NAMED)


class Model:
    """Trigram model of prose: perplexity of passages, and how much of each speaks against its page."""

    def __init__(self, counts: np.ndarray):
        self.bits, self.named = surprisals(counts).ravel(), named_by_prose(counts)
        self.run = re.compile(f"[{self.named}](?:[^{JUDGED}{self.named}]*[{self.named}](?::n)?)+")
        self.free = np.array([c in self.named for c in _COUNTED])
        self.judged = np.array([c in JUDGED for c in CLASSES], np.int64)

    def score(self, seqs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(bits per token, whether there is enough to judge) of each class string, lists of named addresses read as one."""
        seqs = [self.run.sub("i", s) for s in seqs]
        if not seqs:
            return np.zeros(0), np.zeros(0, bool)
        tri, n = _codes(seqs)
        at = np.cumsum(n) - n
        return np.add.reduceat(self.bits[tri], at) / n, np.add.reduceat(self.judged[tri % K], at) >= LEAST


def spam_pages(df: DataFrame, low: float = 0.0001, high: float = 0.999, share: float = 0.5) -> DataFrame:
    """(doc_id) of the pages whose perplexity is abnormal for the larger part of their text.

    ``low`` and ``high`` are the quantiles of the surprisal of prose outside
    which a passage is abnormal; ``share`` is the part of the page's characters
    (without white space) that must lie in such passages, addresses that prose
    names left out.  A null, empty or blank text is no such page; equal texts
    fare alike.
    """
    rows = df.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null and trim(text) <> '' and doc_id is not null")
    cut = materialize(rows.mapInArrow(_cut, PASSAGES), "passages")
    model = cut.sparkSession.sparkContext.broadcast(train(cut))

    def score(batches):
        for b in batches:
            m = model.value
            bits, enough = m.score(b.column("seq").to_pylist())
            chars = b.column("chars").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(_COUNTED))
            mass = b.column("size").to_numpy(zero_copy_only=False) - chars[:, m.free].sum(1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("total"), b.column("prose"), pa.array(np.maximum(mass, 0), pa.int64()), pa.array(bits), pa.array(enough)], names=["doc_id", "total", "prose", "mass", "bits", "enough"])

    scored = cut.mapInArrow(score, "doc_id bigint, total int, prose boolean, mass bigint, bits double, enough boolean").where("enough")
    cuts = scored.where("prose").select(F.percentile_approx("bits", F.array(F.lit(low), F.lit(high)), 10000)).collect()[0][0] or [0.0, 0.0]
    odd = scored.where((F.col("bits") < cuts[0]) | (F.col("bits") > cuts[1]))
    return odd.groupBy("doc_id").agg(F.sum("mass").alias("s"), F.max("total").alias("t")).where(F.col("s") > share * F.col("t")).select("doc_id")
