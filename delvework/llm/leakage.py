"""Evaluation texts leaking into training text, by template canonicalisation.

Numbers, units and names of the items and of the documents become typed placeholders; windows of the resulting
templates are hash-joined, and the slots behind the placeholders are compared: windows whose slots agree speak for a
quote of an item, windows whose slots differ for a re-parameterised likeness. Pairs with enough windows side by side
are then checked word by word. What becomes a placeholder depends on the text alone, so an item is judged alike
whatever other items there are and however they reach the documents.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Template words in a window; with one word in eight altered, any 20 words keep a run of six.
GRAM = 5
#: A quote of L words with e = L // 8 altered keeps at least L - e - 4 (e + 1) windows: five or more from 20 words on.
NEED = 5
MIN_WORDS, MIN_CHARS, ONE_IN = 20, 30, 8
#: Characters of an evaluation set up to which it is sent to all executors; beyond, its windows are joined by shuffle.
SENT_CHARS = 2_000_000
#: Parts into which a window that many documents share is dealt out in that join.
SALTS = 16
#: Words by which a quote may be shifted against the item where words were added or dropped.
SHIFT = 4
#: Share of the slots inside a quote that must hold the item's values; one slot may differ where two hold them.
SLOTS_AGREE = 0.7

_NUM, _NAME, _UNIT = 11, 13, 17
#: Units of measure behind numbers (fixed values).
UNITS = set("s ms sec secs second seconds min mins minute minutes h hour hours day days week weeks month months year years mm cm m km g kg t l ml kb mb gb tb kib mib gib byte bytes px pt percent euro euros eur usd dollar dollars sekunden minuten stunden tage tagen wochen jahre secondes heures jours semaines mois ans segundos minutos horas días semanas meses años".split())
_TOKEN = re.compile(r"[぀-ヿ㐀-䶿一-鿿가-힣]|[^\W_぀-ヿ㐀-䶿一-鿿가-힣]+")
_WIDE = re.compile(r"[぀-ヿ㐀-䶿一-鿿가-힣]")
_ESC = re.compile(r"\\+u\{?([0-9a-fA-F]{4})\}?|\\+x([0-9a-fA-F]{2})|\\+([nrt])(?![a-z]{3})|\\+([\"'/*_`#\[\]()<>.!?:;,-])")
_PREFIX = re.compile(r"^[ \t]*(?:(?:>|\||//+|#+|\*|•|%|;|--)[ \t]*)+", re.M)
_BREAK = re.compile(r"</?(?:br|p|div|li|ul|ol|td|tr|th|h\d|table|blockquote)\b[^<>]{0,80}/?>", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,120}>|<!--|-->")
_LINK = re.compile(r"!?\[([^\[\]]*)\]\([^()\s]*\)")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_MARK = re.compile(r"^[ \t]*(?:[>|#*•%;]|//|--)", re.M)
_MARKS = str.maketrans("", "", "*_`~")
_EMPH = re.compile(r"[*_`~]")
_HYPHEN_AT = re.compile(r"[-‐‑][ \t]*\r?\n")
#: A line end inside a Latin word or number of a text that is Chinese or Japanese around it.
_WIDE_BREAK = re.compile(r"(?<=[\u3040-\u30ff\u4e00-\u9fff])([A-Za-z0-9]*)[ \t]*\r?\n[ \t]*([A-Za-z0-9]*)(?=[\u3040-\u30ff\u4e00-\u9fff])")
_HYPHEN = re.compile(r"(?<=[^\W\d_])[-‐‑]+[ \t]*\r?\n[ \t]*(?=[^\W\d_])")


def plain(text: str) -> str:
    """A text without escapes, markup, quoting marks and hyphenation; letter case stays."""
    if "\\" in text:
        text = _ESC.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else "\n" if m[3] else m[4], text)
    if "&" in text:
        text = html.unescape(text)
    if "%" in text and re.search(r"%[0-9A-F]{2}", text):
        text = unquote(text, errors="ignore")
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    if "<" in text:
        text = _TAG.sub("", _BREAK.sub(" ", text))
    if "](" in text:
        text = _LINK.sub(r"\1", text)
    if _MARK.search(text):
        text = _PREFIX.sub("", text)
    if "\n" in text:
        if _HYPHEN_AT.search(text):
            text = _HYPHEN.sub("", text)
        if not text.isascii():
            text = _WIDE_BREAK.sub(r"\1\2", text)
    return text.translate(_MARKS) if _EMPH.search(text) else text


def words(text: str) -> list[str]:
    """The words of a plain text, CJK characters one by one."""
    return _TOKEN.findall(plain(text))


_IS_NUM, _IS_NAME, _IS_UNIT = 1, 2, 4


class _Codes(dict):
    """Hash of each word, letter case aside, with what it can be as bits above, filled as they come."""

    def __missing__(self, tok: str) -> int:
        low = tok.casefold()
        bits = _IS_NUM if tok.isdigit() else (_IS_NAME if _name_like(tok) else 0) | (_IS_UNIT if low in UNITS else 0)
        if len(self) > 200_000:
            self.clear()
        c = self[tok] = bits << 32 | zlib.crc32(low.encode()) | 32
        return c


def _name_like(tok: str) -> bool:
    return len(tok) >= 4 and tok[0].isupper() and not tok.isupper()


_CODES = _Codes()


def codes(toks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, template with numbers and units, template with names as well) of a text, as numbers."""
    both = np.fromiter(map(_CODES.__getitem__, toks), np.uint64, len(toks))
    raw, bits = both & np.uint64(0xFFFFFFFF), both >> np.uint64(32)
    num = bits == _IS_NUM
    tpl = np.where(num, np.uint64(_NUM), raw)
    after = np.flatnonzero(num[:-1] & (bits[1:] & np.uint64(_IS_UNIT) > 0)) + 1 if len(toks) > 1 else []
    tpl[after] = _UNIT
    return raw, tpl, np.where(bits & np.uint64(_IS_NAME) > 0, np.uint64(_NAME), tpl)


_SALT = np.uint64(0x5851F42D4C957F2D)


def keys(raw: np.ndarray, tpl: np.ndarray, named: np.ndarray, likenesses: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of word windows, of template windows, of windows with names, positions of the latter).

    A window with fewer than two words beside its placeholders says nothing of its text: it is keyed by its own words.
    """
    wr = windows(raw)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if not len(wr):
        return wr, wr, *none

    def keyed(t: np.ndarray) -> np.ndarray:
        said = np.convolve(t >= 32, np.ones(GRAM, np.int64), "valid")
        return np.where(said >= 2, windows(t), wr ^ _SALT)

    if not likenesses:
        return wr, keyed(tpl), *none
    at = np.flatnonzero(np.convolve(named == _NAME, np.ones(GRAM, np.int64), "valid"))
    return wr, keyed(tpl), keyed(named)[at] + _SALT, at


class Items:
    """Items of an evaluation set with the postings of their template windows; each item stands for itself."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.rows = rows
        self.ids, self.raw, self.named, self.slots, self.weight, self.need = [], [], [], [], [], []
        postings = defaultdict(list)
        for k, (i, prompt) in enumerate(rows):
            text = plain(prompt)
            spans = list(_TOKEN.finditer(text))
            ts = [m[0] for m in spans]
            raw, tpl, named = codes(ts)
            lower = {t for t in ts if t[0].islower()}
            opens = np.array([not (x := text[: m.start()].rstrip(" \t\"'([«“„")) or x[-1] in ".!?:\n。！？" for m in spans], bool)
            # a name is written large inside of sentences and never small
            name = np.array([_name_like(t) and t.casefold() not in lower for t in ts], bool) & ~opens
            self.ids.append(i)
            self.raw.append(raw)
            self.named.append(named)
            self.slots.append((tpl == _NUM) | name)
            wide = sum(bool(_WIDE.match(t)) for t in ts) * 2 > len(ts)
            self.weight.append((np.array([len(t) for t in ts], np.int64), MIN_CHARS) if wide else (np.ones(len(ts), np.int64), MIN_WORDS))
            self.need.append(1 if wide or len(ts) < 24 else NEED)
            wr, wt, wn, at = keys(raw, tpl, named)
            for pos, h in [*enumerate(wt.tolist()), *zip(at.tolist(), wn.tolist())]:
                postings[h].append((k, pos, int(wr[pos])))
        self.keys = np.array(sorted(postings), np.uint64)
        self.postings = [postings[int(h)] for h in self.keys]
        #: the same by the words of the window, for slots that agree
        self.agreeing: list[dict[int, list[tuple[int, int]]]] = []
        for entries in self.postings:
            by: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for k, pos, w in entries:
                by[w].append((k, pos))
            self.agreeing.append(dict(by))

    def __reduce__(self):
        return Items, (self.rows,)


def windows(codes: np.ndarray) -> np.ndarray:
    """A hash for each window of ``GRAM`` words."""
    n = len(codes) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(GRAM):
            h = (h ^ codes[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
    return h


def longest(matched: np.ndarray, weight: np.ndarray, least: int) -> tuple[int, int, int]:
    """(weight, from, to) of the longest stretch of at least ``least`` in which at most one word in ``ONE_IN`` isn't matched; zeros if none.

    A stretch begins and ends with a matched word. An item that is shorter as a whole must be repeated nearly whole: at
    least nine tenths of it.
    """
    w = np.concatenate([[0], np.cumsum(weight)])
    least = min(least, -(-int(w[-1]) * 9 // 10))
    f = np.concatenate([[0], np.cumsum(np.where(matched, -1, ONE_IN - 1))])
    # from which earliest start a stretch is good enough: the prefix maxima of f at matched words, searched from the left
    begins = np.where(np.append(matched, False), f, -(1 << 40))
    start = np.minimum(np.searchsorted(np.maximum.accumulate(begins), f), np.arange(len(f)))
    size = np.where(np.insert(matched, 0, False), w - w[start], 0)
    j = int(size.argmax())
    return (int(size[j]), int(start[j]), j) if size[j] >= least and least > 0 else (0, 0, 0)


def slots_agree(right, inside):
    """Whether ``right`` of the slots ``inside`` a stretch are enough for a quote; numbers or arrays.

    A single other slot is an altered word as any other, if at least two slots hold the item's values beside it.
    """
    return (right >= SLOTS_AGREE * inside) | (inside - right <= 1) & (right >= 2)


def quoted(matched: np.ndarray, slots: np.ndarray, weight: np.ndarray, least: int) -> int:
    """Weight of the longest stretch, as :func:`longest` has them, whose slots agree too; 0 if none."""
    size, i, j = longest(matched, weight, least)
    if not size or slots_agree((matched[i:j] & slots[i:j]).sum(), slots[i:j].sum()):
        return size
    w = np.concatenate([[0], np.cumsum(weight)])
    least = min(least, -(-int(w[-1]) * 9 // 10))
    f = np.concatenate([[0], np.cumsum(np.where(matched, -1, ONE_IN - 1))])
    n = np.concatenate([[0], np.cumsum(slots)])
    ok = np.concatenate([[0], np.cumsum(matched & slots)])
    ends, best = np.flatnonzero(matched) + 1, 0
    for i in np.flatnonzero(matched):
        least = max(least, best + 1)
        j = ends[np.searchsorted(w[ends], w[i] + least) :]
        if not len(j):
            break
        j = j[(f[j] <= f[i]) & slots_agree(ok[j] - ok[i], n[j] - n[i])]
        if len(j):
            best = int(w[j[-1]] - w[i])
    return best


def check(item: np.ndarray, slots: np.ndarray, weight: np.ndarray, least: int, doc: np.ndarray, diagonal: int) -> int:
    """Weight of the longest quote of an item near a diagonal of the document; 0 if there is none long enough.

    Of the slots inside the quote, enough must hold the item's values (:func:`slots_agree`): a likeness in which just
    the names and numbers differ may have few enough altered words, yet is no quote. What stands around a quote doesn't
    count against it: every stretch that is long enough is tried.
    """
    m = len(item)
    rows = np.zeros((2 * SHIFT + 1, m), bool)
    for k, s in enumerate(range(-SHIFT, SHIFT + 1)):
        a = diagonal + s
        lo, hi = max(0, -a), min(m, len(doc) - a)
        if lo < hi:
            rows[k, lo:hi] = doc[a + lo : a + hi] == item[lo:hi]
    if not longest(rows.any(axis=0), weight, least)[0]:
        return 0
    return max(quoted(matched, slots, weight, least) for matched in (rows[SHIFT], _aligned(rows)))


def _aligned(rows: np.ndarray) -> np.ndarray:
    """Words matched on the best monotone path over the diagonals; a step to another diagonal costs as much as a miss."""
    k, m = rows.shape
    score, back = np.zeros(k), np.zeros((m, k), np.int64)
    cost = 1.0 * np.abs(np.arange(k)[:, None] - np.arange(k)[None, :])
    for i in range(m):
        via = score[None, :] - cost
        back[i] = via.argmax(axis=1)
        score = via.max(axis=1) + rows[:, i]
    at = int(score.argmax())
    out = np.zeros(m, bool)
    for i in range(m - 1, -1, -1):
        out[i] = rows[at, i] and back[i, at] == at
        at = int(back[i, at])
    return out


def compare(text: str, items: Items, likenesses: bool = True) -> list[tuple[int, str, int, int, int]]:
    """(item id, kind, words, windows with agreeing slots, windows with other slots) of the items that a text meets.

    ``kind`` is quote, or likeness where the text has the item's template with other slots; ``words`` is the length of
    the longest stretch of that kind. Without ``likenesses`` only quotes are looked for: every window with agreeing
    slots has the item's template with its names left in place, so windows with names as placeholders aren't needed.
    """
    raw, tpl, named = codes(words(text))
    wr, wt, wn, at = keys(raw, tpl, named, likenesses)
    if len(wr) == 0 or len(items.keys) == 0:
        return []
    hashes, places = np.concatenate([wt, wn]), np.concatenate([np.arange(len(wt)), at])
    index = np.searchsorted(items.keys, hashes)
    index[index == len(items.keys)] = 0
    same: dict[int, dict[int, set]] = defaultdict(lambda: defaultdict(set))
    other: dict[int, dict[int, set]] = defaultdict(lambda: defaultdict(set))
    hits = [(int(index[x]), int(places[x]), int(wr[places[x]])) for x in np.flatnonzero(items.keys[index] == hashes)]
    for i, p, r in hits:
        for k, pos in items.agreeing[i].get(r, ()):
            same[k][p - pos].add(p)
    quotes = {}
    for k, diagonals in same.items():
        weight, least = items.weight[k]
        quotes[k] = max((check(items.raw[k], items.slots[k], weight, least, raw, d) for d in _diagonals(diagonals, items.need[k])), default=0)
    if not likenesses and not any(quotes.values()):
        return []
    for i, p, r in hits:
        for k, pos, w in items.postings[i]:
            if w != r and (likenesses or quotes.get(k)):
                other[k][p - pos].add(p)
    out = []
    for k in same.keys() | other.keys():
        n_same, n_other = (sum(map(len, h[k].values())) if k in h else 0 for h in (same, other))
        if quotes.get(k):
            out.append((items.ids[k], "quote", quotes[k], n_same, n_other))
        elif n_other and likenesses:
            weight, least = items.weight[k]
            free = np.zeros(len(weight), bool)
            both = {d: same[k].get(d, set()) | other[k].get(d, set()) for d in same[k].keys() | other[k].keys()}
            like = max((check(items.named[k], free, weight, least, named, d) for d in _diagonals(both, items.need[k])), default=0)
            if like:
                out.append((items.ids[k], "likeness", like, n_same, n_other))
    return out


def _diagonals(hits: dict[int, set], need: int) -> Iterator[int]:
    """The diagonals with enough windows near them, the fullest first, without neighbours of those given already."""
    if sum(map(len, hits.values())) < need:
        return
    tried: list[int] = []
    for d, _ in sorted(hits.items(), key=lambda x: (-len(x[1]), x[0])):
        if any(abs(d - t) <= SHIFT // 2 for t in tried) or sum(len(hits.get(d + s, ())) for s in range(-SHIFT, SHIFT + 1)) < need:
            continue
        tried.append(d)
        yield d


def leaks(text: str, items: Items) -> list[tuple[int, int, int, int]]:
    """(item id, words quoted, windows with agreeing slots, windows with other slots) of the items that a text quotes."""
    return [(i, q, a, d) for i, kind, q, a, d in compare(text, items, False) if kind == "quote"]


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("kind", pa.string()), ("words", pa.int32()), ("agreeing", pa.int32()), ("differing", pa.int32())])
_DDL = "doc_id long, item_id long, kind string, words int, agreeing int, differing int"


def _compared(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(_SCHEMA.names, r)) for r in rows], schema=_SCHEMA)


def contaminated(documents: DataFrame, items: DataFrame, likenesses: bool = True, sent_chars: int = SENT_CHARS) -> DataFrame:
    """``doc_id, item_id, kind, words, agreeing, differing``: the items that each document quotes or resembles.

    A document quotes an item if it repeats at least 20 successive words of its prompt (30 characters where most of it
    is Chinese or Japanese; nine tenths of a shorter prompt) with at most one word in eight altered, whatever the case,
    punctuation, markup, hyphenation, quoting or escapes; it is a likeness if it repeats as much of the item's template
    with other numbers and names in it. ``words`` is the length of the longest such stretch, ``agreeing`` and
    ``differing`` count template windows whose slots do and don't hold the item's values. Without ``likenesses`` only the
    quotes are returned, the same ones, and ``differing`` counts other numbers and units alone. Rows with null ids or texts
    are left out; equal rows give equal results once. The items are sent to the executors if their prompts have at most
    ``sent_chars`` characters together, as counted here; else the template windows are joined by shuffle. Both ways
    judge the same pairs by the same rule, so the result is the same.
    """
    its = items.select("item_id", "prompt").where("item_id IS NOT NULL AND prompt IS NOT NULL").dropDuplicates(["item_id"])
    docs = documents.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    size = its.agg(F.sum(F.length("prompt"))).first()[0] or 0
    if size > sent_chars:
        return _joined(docs, its, likenesses)
    rows = [(r.item_id, r.prompt) for r in its.orderBy("item_id").collect()]
    ref = documents.sparkSession.sparkContext.broadcast(Items(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ref.value
        for batch in batches:
            yield _compared([(doc, *r) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in compare(text, known, likenesses)])

    return docs.mapInArrow(run, _DDL).dropDuplicates(["doc_id", "item_id"])


def _joined(docs: DataFrame, its: DataFrame, likenesses: bool) -> DataFrame:
    """The same by a shuffled join of window hashes, for sets too large to send.

    Windows that many documents have are dealt out by document. Only pairs that share as many windows as a stretch needs
    are compared, so texts move for few pairs.
    """

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                _, wt, wn, _ = keys(*codes(words(text)), likenesses)
                h, n = np.unique(np.concatenate([wt, wn]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(h), pa.int64()), pa.array(h.view(np.int64)), pa.array(n, pa.int32())], names=["key", "h", "n"])

    def needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one = Items(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())))
            yield pa.RecordBatch.from_arrays([pa.array(one.ids, pa.int64()), pa.array(one.need, pa.int32())], names=["item_id", "need"])

    left = docs.mapInArrow(grams, "key long, h long, n int").select(F.col("key").alias("doc_id"), "h", "n", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int").alias("salt"))
    right = its.mapInArrow(grams, "key long, h long, n int").select(F.col("key").alias("item_id"), "h", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    shared = left.join(right, ["h", "salt"]).groupBy("doc_id", "item_id").agg(F.sum("n").alias("n"))
    pairs = shared.join(its.mapInArrow(needs, "item_id long, need int"), "item_id").where("n >= need").select("doc_id", "item_id")
    full = pairs.join(its, "item_id").join(docs, "doc_id").select("doc_id", "item_id", "text", "prompt")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _compared([(r["doc_id"], *x) for r in batch.to_pylist() for x in compare(r["text"], Items([(r["item_id"], r["prompt"])]), likenesses)])

    return full.mapInArrow(judge, _DDL).dropDuplicates(["doc_id", "item_id"])


def found(pairs: DataFrame) -> DataFrame:
    """``doc_id, item_id`` of the quotes, distinct."""
    return pairs.where("kind = 'quote'").select("doc_id", "item_id").distinct()
