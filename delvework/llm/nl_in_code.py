"""Natural language inside code: which languages the comments and string literals of each file hold.

Files are cut into blocks of lines. Each block is lexed on its own for every state it could begin in, which gives a
state-transition function per block, and with it, per state, what its comments and strings hold. Both compose
associatively: blocks are folded by prefix within folds of a file and then over the folds, so a file of any size is
lexed in pieces and judged as a whole. Spans are labelled by a multinomial logistic regression over hashed n-grams whose
scores add up over fragments, so a passage over any number of blocks is judged from all of its parts.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delvework.llm import languages as L
from delvework.llm.files import line_blocks, overlay
from delvework.llm.lexer import CODE, HERE, body, family, lex, transition
from delvework.llm.passages import LINES, OPEN, Part, Run, Sum, close, combined, end_only, finished, joined, start_only

BLOCK_LINES = 256
#: Blocks of a file that are composed in one task; what is left of them is one row per fold.
FOLD = 4096
MIN_WORDS, MIN_CJK = 5, 8

_TAG = re.compile(r"^\s*(?:[@\\]\w+|:\w+(?:\s+\w+)?:)\s*(?:\w+\s*$)?")
_NOT_WORD = re.compile(r"[_(){}\[\]=<>/\\@#$|&^~]|[a-z][A-Z]|\d|\w\.\w|::|^--?\w")
_ESC = re.compile(r"\\(?:u\{([0-9a-fA-F]{1,6})\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|([nrt]))")
_TRIM = re.compile(r"^[(\[{\"'“‘«]+|[)\]}\"'”’».,;:!?…]+$")
_CODE = re.compile(r"[;{}]\s*$|\w\(\S|^[\w.$]+\s*[-+*/|]?=[^=]|^[{}]")
_WIDE = re.compile(r"[぀-ヿ㐀-䶿一-鿿]")


def _unescape(s: str) -> str:
    if "\\" not in s:
        return s
    return _ESC.sub(lambda m: (chr(int(h, 16)) if (h := m[1] or m[2] or m[3]) and int(h, 16) < 0x110000 else "\n"), s)


def prose_words(line: str) -> list[str]:
    """The words of a line that could be language; identifiers, paths, numbers and code don't count."""
    out = []
    for tok in line.split():
        t = _TRIM.sub("", tok)
        if not t:
            continue
        if _WIDE.search(t):
            out += [p for w in L.CJK_RUN.findall(t) for p in (w,)]
        elif not _NOT_WORD.search(t):
            out += L.WORD.findall(t)
    return out


def _wide(words: list[str]) -> int:
    return sum(len(w) for w in words if _WIDE.match(w))


def part_of(text: str, model: L.Model, closed: dict | None = None) -> Part:
    """The runs of lines in one language of a comment or string; ``closed`` takes those between the first and the last."""
    runs: list[Run] = []
    joins, open_, broken = True, False, False
    for line in text.split("\n"):
        line = line.strip()
        if not line:
            continue
        judged = _LINES.get(line)
        if judged is None:
            if len(_LINES) >= _LINES_KEPT:
                _LINES.clear()
            judged = _LINES[line] = _judge(line, model)
        tag, n, wide, size, score, label = judged
        if not n:
            joins, open_, broken = joins and bool(runs), False, True
            continue
        new = Run((n, wide, size, score), label)
        if tag and not runs:
            joins = False
        if not tag and open_:
            runs[-1:] = joined(runs[-1], new)
        else:
            runs.append(new)
        open_ = not tag
        if closed is not None and len(runs) > 2:
            close(closed, runs[1:-1], lambda r: verdict(*r.sums[:2], r.sums[3], model))
            runs[1:-1] = []
    return Part(joins, tuple(runs), open_, broken and not runs)


def runs_of(text: str, model: L.Model) -> list[tuple[int, int, int, np.ndarray]]:
    """Passages of a comment or string: (words, CJK characters, characters, score), one per run of lines in one language."""
    return [r.sums for r in part_of(text, model).runs]


#: Judgements of lines seen lately by this worker: licence headers and the like come again and again.
_LINES: dict[str, tuple] = {}
_LINES_KEPT = 30_000


def _judge(line: str, model: L.Model) -> tuple:
    tag = _TAG.match(line)
    words = prose_words(line[tag.end() :] if tag else line)
    if not words or len(words) < MIN_WORDS and _CODE.search(line):
        return bool(tag), 0, 0, 0, None, None
    score = model.score(words)
    n, wide, size = len(words), _wide(words), sum(map(len, words)) + (0 if _WIDE.match(words[0]) else len(words) - 1)
    return bool(tag), n, wide, size, score, model.label(score) if n >= 3 or wide >= 4 else None


def verdict(n: int, wide: int, score: np.ndarray, model: L.Model) -> str | None:
    """The language of a passage that is long enough, else None."""
    label = model.label(score)
    if label == "none":
        return None
    return label if (wide >= MIN_CJK if label in L.CJK else n >= MIN_WORDS) else None


def _units(spans: list[tuple], text: str) -> list[tuple]:
    """Comment blocks and strings of a piece: neighbouring line comments make one block."""
    out: list[list] = []
    for kind, a, b, before, still in spans:
        if kind == "l" and out and out[-1][0] == "l" and not text[out[-1][2] : a].strip() and text.count("\n", out[-1][2], a) == 1:
            out[-1][2] = b
        else:
            out.append([kind, a, b, before, still])
    return [tuple(x) for x in out]


_OPENS = re.compile(r"^(?:r#\"|\"\"\"|'''|\[\[|[\"'`])")
_CLOSES = re.compile(r"(?:\"#|\"\"\"|'''|\]\]|[\"'`])$")


def _inner(kind: str, raw: str, before: bool, still: bool, here: bool) -> str:
    """The text of a comment or string, or of a piece of one, without its marks."""
    if kind == "l":
        return "\n".join(body("l", x) for x in raw.split("\n"))
    if kind == "b":
        return body("b", raw)
    if here if before else raw.startswith("<<"):  # the first and the last line of a heredoc are marks
        raw = raw if before else raw.partition("\n")[2]
        return _unescape(raw if still else raw.rpartition("\n")[0])
    raw = raw if before else _OPENS.sub("", raw)
    return _unescape(raw if still else _CLOSES.sub("", raw))


def summed(spans: list[tuple], text: str, model: L.Model, memo: dict, here: bool = False) -> Sum:
    """What the comments and strings of a piece hold, with the parts that touch its borders left open."""
    closed: dict[str, int] = {}

    def judge(r: Run) -> str | None:
        return verdict(r.sums[0], r.sums[1], r.sums[3], model)

    head = tail = head_kind = tail_kind = None
    through = False
    units = _units(spans, text)
    for k, (kind, a, b, before, still) in enumerate(units):
        at_start = OPEN if before else LINES if kind == "l" and k == 0 and "\n" not in text[:a] and not text[:a].strip() else None
        at_end = OPEN if still else LINES if kind == "l" and k == len(units) - 1 and text.count("\n", b) <= 1 and not text[b:].strip() else None
        key = (kind, a, b, before, here and before)
        got = memo.get(key)
        if got is None:
            own: dict[str, int] = {}
            got = memo[key] = part_of(_inner(kind, text[a:b], before, still, here), model, own), own
        part = got[0]
        for lang, size in got[1].items():
            closed[lang] = closed.get(lang, 0) + size
        if at_start and at_end:
            head, head_kind, tail_kind, through = part, at_start, at_end, True
        elif at_start:
            head, head_kind = start_only(part, closed, judge), at_start
        elif at_end:
            tail, tail_kind = end_only(part, closed, judge), at_end
        else:
            close(closed, part.runs, judge)
    return Sum(closed, head, tail, head_kind, tail_kind, through)


_OUT = "file_path string, fold int, first int, last int, chars long, sums binary"
_SCHEMA = pa.schema([("file_path", pa.string()), ("fold", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("chars", pa.int64()), ("sums", pa.binary())])


def _lexed(model_ref, block_lines: int, fold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_ref.value
        _LINES.clear()
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                fam = family(r["file_path"])
                if fam is not None:
                    text = overlay(r["offs"], r["texts"])
                    chars = len(text) - text.count("\n")
                    text += "\n" * max(1, block_lines - text.count("\n"))
                    sums = pickle.dumps(by_state(text, fam, r["block"] == 0, model))
                    rows.append({"file_path": r["file_path"], "fold": r["block"] // fold, "first": r["block"], "last": r["block"], "chars": chars, "sums": sums})
            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return run


def by_state(text: str, fam: str, opens_file: bool, model: L.Model) -> dict[int, tuple[int, Sum]]:
    """(end state, what it holds) of a piece by each state in which it can begin; a file begins in code."""
    if opens_file:
        spans, end, _ = lex(text, fam)
        fn, by = {CODE: end}, {CODE: spans}
    else:
        fn, by = transition(text, fam)
    memo: dict = {}
    return {s: (fn[s], summed(spans, text, model, memo, s == HERE)) for s, spans in by.items()}


def composed(a: dict[int, tuple[int, Sum]], b: dict[int, tuple[int, Sum]], neighbours: bool, model: L.Model) -> dict[int, tuple[int, Sum]]:
    """The same of two pieces, one behind the other: the second begins in the state in which the first ends."""
    out = {}
    for s, (end, first) in a.items():
        end, second = b.get(end) or b[CODE]
        out[s] = end, combined(first, second, neighbours, lambda r: verdict(r.sums[0], r.sums[1], r.sums[3], model))
    return out


def _folded(bias: np.ndarray, last: bool):
    """Composes rows that follow each other: those of a fold, or, as the ``last`` step, those of a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = L.Model(np.zeros((0, len(bias)), np.float32), bias)
        key, at, chars, sums = None, (0, 0), 0, {}

        def done() -> list[dict]:
            if key is None:
                return []
            if not last:
                return [{"file_path": key[0], "fold": key[1], "first": at[0], "last": at[1], "chars": chars, "sums": pickle.dumps(sums)}]
            sizes = finished(sums[CODE][1], lambda r: verdict(r.sums[0], r.sums[1], r.sums[3], model))
            return [{"file_path": key[0], "lang": lang, "chars": n, "total": chars} for lang, n in sizes.items()]

        for batch in batches:
            rows = []
            for path, fold, lo, hi, n, raw in zip(*(batch.column(k).to_pylist() for k in range(6))):
                here = (path, None if last else fold)
                if here != key:
                    rows += done()
                    key, at, chars, sums = here, (lo, hi), n, pickle.loads(raw)
                else:
                    sums = composed(sums, pickle.loads(raw), lo == at[1] + 1, model)
                    at, chars = (at[0], hi), chars + n
            yield pa.RecordBatch.from_pylist(rows, schema=_TOTALS if last else _SCHEMA)
        yield pa.RecordBatch.from_pylist(done(), schema=_TOTALS if last else _SCHEMA)

    return run


_TOTALS = pa.schema([("file_path", pa.string()), ("lang", pa.string()), ("chars", pa.int64()), ("total", pa.int64())])


def training_texts(notes: DataFrame | None, limit: int = 2000) -> list[str]:
    """A bounded, repeatable sample of note bodies (the ``limit`` least by hash) from which the labeller is refitted."""
    if notes is None:
        return []
    rows = notes.select("body").where("body IS NOT NULL").distinct().orderBy(F.xxhash64("body"), "body").limit(limit).collect()
    return [r.body for r in rows]


def languages_in_code(chunks: DataFrame, notes: DataFrame | None = None, block_lines: int = BLOCK_LINES, fold: int = FOLD, sample: int = 2000) -> DataFrame:
    """``file_path, lang, chars, share``: the languages in the comments and strings of each file.

    ``chars`` counts the characters of passages of at least five words (Chinese and Japanese: eight characters) in
    ``lang``; ``share`` is their part of the file's characters, line ends aside. Blocks of ``block_lines`` lines and
    folds of ``fold`` blocks are units of work only and don't show in the result. The labeller is fitted on a built-in
    seed and on at most ``sample`` note bodies. Chunks without path or content give no rows; repeated and overlapping
    chunks count once; files of unknown kinds and files without language have no rows; other columns are ignored.
    """
    model = L.train(training_texts(notes, sample))
    ref = chunks.sparkSession.sparkContext.broadcast(model)
    blocks = line_blocks(chunks, block_lines).select("file_path", "block", "offs", "texts").mapInArrow(_lexed(ref, block_lines, fold), _OUT)
    folds = blocks.repartition("file_path", "fold").sortWithinPartitions("file_path", "fold", "first").mapInArrow(_folded(model.bias, False), _OUT)
    files = folds.repartition("file_path").sortWithinPartitions("file_path", "first").mapInArrow(_folded(model.bias, True), "file_path string, lang string, chars long, total long")
    return files.select("file_path", "lang", "chars", F.round(F.col("chars") / F.greatest(F.col("total"), F.lit(1)), 6).alias("share"))


def files_by_language(chunks: DataFrame, notes: DataFrame | None = None, **options) -> DataFrame:
    """``file_path, lang``, distinct: see :func:`languages_in_code`."""
    return languages_in_code(chunks, notes, **options).select("file_path", "lang").distinct()
