"""Reading level of documents by propagating graded examples over a document-word graph.

Paragraphs of running prose are tied to their words and to a few features of form (sentence and word length). Graded
documents are clamped; difficulty flows from paragraphs to words and back in harmonic iterations, until it moves no
more. Each word is a node of its own. Words below a share of all ties are left out, so what an iteration sends is
bounded however large the corpus is, and the graph has the same form at any size.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delvework.session import checkpointed

#: A word has at least this share of all ties between paragraphs and words, so there are at most 1/share words.
WORD_SHARE = 1e-5
#: Iterations end where no word moves by more than this on the scale of levels, or at the latest after so many.
TOLERANCE, ITERATIONS = 0.05, 12
MIN_WORDS, MIN_WIDE = 60, 120
#: Spread of levels (variance) that is supposed of a word for so many paragraphs.
PRIOR, SUPPOSED = 1.0, 2.0
#: Steps on the scale of levels in which graded paragraphs are counted to find their medians.
STEP = 0.002

_FENCE = re.compile(r"^[ \t]*(```|~~~)[^\n]*\n.*?(?:^[ \t]*\1[ \t]*$|\Z)", re.M | re.S)
_HEADING = re.compile(r"^[ \t]*(?:#{1,6}\s|={1,6}\s).*|^[^\n]*\n(?:=+|-{3,})[ \t]*$", re.M)
_CODE_LINE = re.compile(r"^[ \t]*(?:\||\$ |>>> |\+[-=+]+\+|[{}()\[\];]+\s*$|\S+\(.*\);?\s*$|[\w.]+\s*=\s*\S+\s*$|(?: {4}|\t)(?=\S*[_(){};=])|\"?[\w-]+\"?:\s*\S+,?\s*$)")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_WIDE = re.compile(r"[぀-ヿ㐀-䶿一-鿿]")
_SENTENCE = re.compile(r"[.!?。！？]+(?=\s|$|[^\s\w.])|[。！？]")
_ITEM = re.compile(r"^\s*(?:[-*•+>]|\d+[.)])\s+")
_MARKUP = re.compile(r"`[^`\n]*`|<[^<>\n]{1,80}>|https?://\S+")
_ASCII = re.compile(r"[!-~]{3,}")
_JUNK = re.compile(r"::|_|\w[./]\w|\(\)|\w=")


def paragraphs(text: str) -> list[str]:
    """The paragraphs of running prose: code, tables and headings are left out, inline code as well."""
    text = text.replace("\r\n", "\n")
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n\n", text)
    text = _HEADING.sub("\n", text)
    out = []
    for block in re.split(r"\n[ \t]*\n", text):
        lines = [x for x in block.split("\n") if x.strip() and not _CODE_LINE.match(x)]
        if not lines:
            continue
        # a short line without an end of sentence is a title
        if len(lines) == 1 and len(lines[0]) < 60 and not _SENTENCE.search(lines[0].rstrip() + " ") and not re.match(r"\s*(?:[-*•+>]|\d+[.)])\s", lines[0]):
            continue
        par = "\n".join(_ITEM.sub("", x) for x in lines)
        if "`" in par or "<" in par or "://" in par:
            par = _MARKUP.sub(" ", par)
        if _JUNK.search(par):
            par = _ASCII.sub(lambda m: " " if _JUNK.search(m[0]) else m[0], par)
        out.append(par)
    return out


class _Ids(dict):
    def __missing__(self, key: str) -> int:
        if len(self) > 200_000:
            self.clear()
        v = self[key] = int.from_bytes(hashlib.blake2b(key.encode(), digest_size=8).digest(), "big", signed=True)
        return v


_IDS = _Ids()


def unit(par: str) -> tuple[list[int], int, int]:
    """(64-bit hashes of words and features of form, words, wide characters) of a paragraph."""
    wide = _WIDE.findall(par)
    sentences = max(1, len(_SENTENCE.findall(par)))
    if len(wide) * 3 > len(par):
        runs = re.findall(r"[぀-ヿ㐀-䶿一-鿿]+", par)
        keys = {r[i : i + 2] for r in runs for i in range(max(1, len(r) - 1))}
        form = [f"\x01z{min(12, len(wide) // sentences // 6)}"] * 2
        return [_IDS[k] for k in keys] + [_IDS[k] for k in form], 0, len(wide)
    ws = _WORD.findall(par.lower())
    n = len(ws)
    if n == 0:
        return [], 0, len(wide)
    size = sum(map(len, ws)) / n
    form = [f"\x01s{min(15, n // sentences // 2)}", f"\x01w{min(20, int(size * 2))}"]
    return [_IDS[k] for k in set(ws)] + [_IDS[k] for k in form], n, len(wide)


def propagate_step(ids: np.ndarray, starts: np.ndarray, label: np.ndarray, size: np.ndarray, value: np.ndarray, weight: np.ndarray):
    """Scores of paragraphs, and per word the sums of size, of size x score, of size x score squared, and its paragraphs.

    ``ids`` holds the paragraphs' words one after another, ``starts`` where each begins; ``label`` is NaN where a
    paragraph's document isn't graded.
    """
    counts = np.diff(np.append(starts, len(ids)))
    par = np.repeat(np.arange(len(starts)), counts)
    w = weight[ids]
    top, low = np.bincount(par, w * value[ids], len(starts)), np.bincount(par, w, len(starts))
    score = np.divide(top, low, out=np.full(len(starts), np.nan), where=low > 1e-9)
    used = np.where(np.isnan(label), score, label)
    ok = ~np.isnan(used[par])
    i, s, u = ids[ok], size[par[ok]], used[par[ok]]
    return score, *(np.bincount(i, x, len(value)) for x in (s, s * u, s * u**2, np.ones(len(s))))


def cuts(bins: list[tuple[float, float, int]]) -> list[float]:
    """Three increasing cuts between the levels, half way between the medians of graded paragraphs, which bear misjudged grades.

    ``bins`` has (grade, score, paragraphs).
    """
    mid = {}
    for k in (1, 2, 3, 4):
        own = sorted((score, n) for grade, score, n in bins if grade == k)
        half, seen = sum(n for _, n in own) / 2, 0
        for score, n in own:
            seen += n
            if seen >= half:
                mid[k] = score
                break
    if not mid:
        return [1.5, 2.5, 3.5]
    # levels without grades lie between the known ones, or at their distance from the last of them
    lo, hi = min(mid), max(mid)
    full = [float(np.interp(k, sorted(mid), [mid[j] for j in sorted(mid)])) + min(0, k - lo) + max(0, k - hi) for k in (1, 2, 3, 4)]
    return np.maximum.accumulate([(a + b) / 2 for a, b in zip(full, full[1:])]).tolist()


_UNITS = "doc_id long, part int, ids array<long>, words int, wide int"
_UNIT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("ids", pa.list_(pa.int64())), ("words", pa.int32()), ("wide", pa.int32())])


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: tuple[list, ...] = ([], [], [], [], [])
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for k, par in enumerate(paragraphs(text)):
                ids, n, wide = unit(par)
                if ids:
                    for c, v in zip(cols, (doc, k, ids, n, wide)):
                        c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _UNIT_SCHEMA.types)], schema=_UNIT_SCHEMA)


def _arrays(batch: pa.RecordBatch):
    """(ids one after another, starts, sizes, grades) of a batch of paragraphs."""
    ids = batch.column("ids")
    flat = ids.flatten().to_numpy(zero_copy_only=False)
    lengths = np.diff(ids.offsets.to_numpy())
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    size = batch.column("size").to_numpy(zero_copy_only=False).astype(float)
    label = batch.column("label").to_numpy(zero_copy_only=False).astype(float)
    return flat, starts, size, label


def _vocabulary(units: DataFrame, share: float) -> np.ndarray:
    """Sorted hashes of the words with at least ``share`` of all ties: at most 1 / ``share``, counted over all paragraphs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, n = np.unique(batch.column(0).flatten().to_numpy(zero_copy_only=False), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.int64()), pa.array(n, pa.int64())], names=["w", "n"])

    counts = units.select("ids").mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
    total = F.coalesce(counts.agg(F.sum("n")).scalar(), F.lit(0))
    return np.sort(counts.where(F.col("n") >= total * share).select("w").toPandas()["w"].to_numpy(np.int64))


def _numbered(units: DataFrame, words: np.ndarray) -> DataFrame:
    """The paragraphs with places in ``words`` instead of hashes, other words left out."""
    ref = units.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = ref.value
        for batch in batches:
            ids = batch.column("ids")
            h = ids.flatten().to_numpy(zero_copy_only=False)
            at = np.searchsorted(words, h)
            known = np.append(words, 0)[at] == h if len(words) else np.zeros(len(h), bool)
            known &= at < len(words)
            ends = np.concatenate([[0], np.cumsum(known)])[ids.offsets.to_numpy() - ids.offsets[0].as_py()]
            arr = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at[known].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([arr if c == "ids" else batch.column(c) for c in batch.schema.names], names=batch.schema.names)

    return units.mapInArrow(run, "doc_id long, part int, ids array<int>, words int, wide int, size double, label double")


def _propagated(units: DataFrame, value: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One harmonic iteration: new difficulties and weights of the words, one row per word.

    Words that occur on one level only weigh more, the more so the more paragraphs show it: a word of one paragraph says
    little, so a spread of ``PRIOR`` levels is supposed for ``SUPPOSED`` paragraphs besides.
    """
    ref, size = units.sparkSession.sparkContext.broadcast((value, weight)), len(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, weight = ref.value
        sums = [np.zeros(size) for _ in range(4)]
        for batch in batches:
            if batch.num_rows:
                flat, starts, sizes, label = _arrays(batch)
                for total, x in zip(sums, propagate_step(flat, starts, label, sizes, value, weight)[1:]):
                    total += x
        at = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(s[at]) for s in sums)], names=["w", "n", "s", "q", "c"])

    rows = units.select("ids", "size", "label").mapInArrow(run, "w int, n double, s double, q double, c double")
    # rounded, so that the order in which partial sums meet doesn't show
    per = rows.groupBy("w").agg(*(F.round(F.sum(c), 6).alias(c) for c in "nsqc")).where("n > 0").withColumn("value", F.col("s") / F.col("n"))
    spread = (F.col("c") * F.greatest(F.lit(0.0), F.col("q") / F.col("n") - F.col("value") ** 2) + SUPPOSED * PRIOR) / (F.col("c") + SUPPOSED)
    got = per.select("w", "value", (1 / (0.05 + spread)).alias("weight")).toPandas()
    value, weight = np.zeros(size), np.zeros(size)
    value[got["w"]], weight[got["w"]] = got["value"], got["weight"]
    ref.unpersist()
    return value, weight


def moved(before: np.ndarray, after: np.ndarray, reached: np.ndarray, now: np.ndarray) -> float:
    """The largest move of a word, after a common shift and stretch of the scale, which the cuts between levels take up.

    Infinite while words are still being reached for the first time.
    """
    if (reached != now).any():
        return float("inf")
    if reached.sum() < 3:
        return 0.0
    x, y = before[reached], after[reached]
    rest = y - np.polyval(np.polyfit(x, y, 1), x) if x.std() > 1e-9 else y - x
    return float(np.abs(rest).max())


def reading_levels(documents: DataFrame, level_labels: DataFrame, tolerance: float = TOLERANCE, iterations: int = ITERATIONS, share: float = WORD_SHARE) -> DataFrame:
    """``doc_id, reading_level, words, wide, difficulty`` of each document with enough running prose.

    Documents with at least 60 words (Chinese and Japanese: 120 characters) of running prose get the level, 1 plain to
    4 demanding, on which most of their prose is written; ``difficulty`` is the mean before it is cut into levels.
    Grades of a document are reduced to their (lower) median, null grades are ignored, grades of unknown documents
    have no effect, and without any grades only form could tell, so all documents stay at level 2. All documents take
    part in the propagation, which ends where no word moves by more than ``tolerance``, after ``iterations`` at the
    latest; words below the ``share`` of all ties are left out. The cuts between levels are fitted on all graded
    paragraphs. Null ids or texts give no rows; equal ids count once.
    """
    docs = documents.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    grades = level_labels.where("doc_id IS NOT NULL AND rated_level BETWEEN 1 AND 4").groupBy("doc_id").agg(F.sort_array(F.collect_list("rated_level")).alias("g"))
    grades = grades.select("doc_id", F.get("g", F.floor((F.size("g") - 1) / 2).cast("int")).cast("double").alias("label"))
    parsed = docs.mapInArrow(_units, _UNITS).withColumn("size", F.greatest(F.col("words"), F.col("wide") / 2))
    parsed = parsed.join(grades, "doc_id", "left").persist()
    words = _vocabulary(parsed, share)
    units = checkpointed(_numbered(parsed.select("doc_id", "part", "ids", "words", "wide", "size", "label"), words))
    parsed.unpersist()
    value, weight = np.zeros(len(words)), np.zeros(len(words))
    for _ in range(iterations):
        before, (value, weight) = (value, weight), _propagated(units, value, weight)
        if moved(before[0], value, before[1] > 0, weight > 0) <= tolerance:
            break
    ref = documents.sparkSession.sparkContext.broadcast((value, weight))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, weight = ref.value
        for batch in batches:
            if batch.num_rows:
                flat, starts, size, label = _arrays(batch)
                s = np.round(propagate_step(flat, starts, np.full(len(starts), np.nan), size, value, weight)[0], 6)
                cols = [batch.column(c) for c in ("doc_id", "part", "words", "wide", "size", "label")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(s)], names=["doc_id", "part", "words", "wide", "size", "label", "score"])

    scored = units.mapInArrow(score, "doc_id long, part int, words int, wide int, size double, label double, score double")
    scored = scored.withColumn("score", F.when(F.isnan("score"), None).otherwise(F.col("score"))).dropDuplicates(["doc_id", "part"])
    # at most four grades times the steps of the scale, whatever the number of paragraphs
    bins = scored.where("label IS NOT NULL AND score IS NOT NULL").groupBy("label", (F.round(F.col("score") / STEP) * STEP).alias("at")).count().collect()
    c = cuts([(r.label, r["at"], r["count"]) for r in bins])
    level = F.when(F.col("score").isNull(), 2).when(F.col("score") < c[0], 1).when(F.col("score") < c[1], 2).when(F.col("score") < c[2], 3).otherwise(4)
    per = scored.withColumn("level", level).groupBy("doc_id").agg(
        *(F.sum(F.when(F.col("level") == k, F.col("size")).otherwise(0)).alias(f"l{k}") for k in (1, 2, 3, 4)),
        F.sum("words").alias("words"), F.sum("wide").alias("wide"),
        F.round(F.sum(F.col("score") * F.col("size")) / F.sum(F.when(F.col("score").isNotNull(), F.col("size"))), 4).alias("difficulty"),
    )
    top = F.array_max(F.array(*(F.struct(F.col(f"l{k}").alias("size"), F.lit(-k).alias("k")) for k in (1, 2, 3, 4))))
    enough = (F.col("words") >= MIN_WORDS) | (F.col("wide") >= MIN_WIDE)
    return per.where(enough).select("doc_id", (-top["k"]).cast("int").alias("reading_level"), "words", "wide", "difficulty")


def found(levels: DataFrame) -> DataFrame:
    """``doc_id, reading_level``."""
    return levels.select("doc_id", "reading_level")
