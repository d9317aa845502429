"""Splitting oversized chunks at natural boundaries by agglomerative merging."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delvework.llm.islands import Source, line_starts, masked
from delvework.llm.lexer import CODE, family, lex, states_of, transition

#: Boundary strengths: inside a line, between lines (less the deeper), at a blank line, before a declaration.
INSIDE, LINE, BLANK, DECL = 0.0, 1.0, 3.0, 10.0


_SIGNS = re.compile(r"[(){}\[\]=;]")


def start_state(text: str, fam: str, first_line: int) -> int:
    """The lexer state in which a chunk begins: code, unless it lies inside of a file and another start suits it better.

    A chunk may begin inside of a string or comment and be cut off inside of another. Of all starts, the one holds that
    leaves the most signs of code outside of strings and comments; among equals one that ends in code, and then code.
    """
    if first_line <= 1 or len(states_of(fam)) == 1:
        return CODE
    spans, end, _ = lex(text, fam)
    if end == CODE and not any(kind == "s" and "\n" in text[a:b] for kind, a, b, *_ in spans):
        return CODE
    fn, runs = transition(text, fam)
    return max(states_of(fam), key=lambda s: (len(_SIGNS.findall(masked(text, runs[s]))), fn[s] == CODE, s == CODE))


def declaration_boundaries(text: str, path: str | None, first_line: int) -> list[tuple[int, str, str]]:
    """(0-based line, kind, name) of each place, after the first line, at which a declaration with its leading lines begins."""
    fam = family(path)
    if fam is None:
        return []
    src = Source(text, fam, start_state(text, fam, first_line))
    out: dict[int, tuple[int, str, str]] = {}
    for d in src.declarations():
        if d.top > 0 and not _packed(src.lines[d.line]):
            out.setdefault(d.top, (d.top, d.kind, d.name))
    return [out[k] for k in sorted(out)]


def _packed(line: str) -> bool:
    """A line that holds several statements or a whole body: packed code, in which no declaration begins a line."""
    return len(line) > 300 or line.count("{") > 2 and line.count(";") > 2


def _segments(lines: list[str], decls: set[int], limit: int, overlap: int) -> tuple[list[tuple[int, int, int]], list[float]]:
    """Atomic segments (line, from, to) and the strength of the boundary before each.

    A segment is a line, or a part of one that is too long: as many segments as overlap, and one more, take at most
    half of ``limit``, so a piece always has room for its overlap and for text of its own.
    """
    room = max(1, limit // (2 * (overlap + 1)))
    segs, strength = [], []
    for i, line in enumerate(lines):
        blank_above = i > 0 and not lines[i - 1].strip()
        indent = len(line) - len(line.lstrip()) if line.strip() else 40
        s = DECL if i in decls else BLANK + 1 / (1 + indent) if blank_above else LINE + 1 / (1 + indent) if line.strip() else LINE / 2
        size, at = len(line) + 1, 0
        while at < size:
            to = min(size, at + room)
            if to < size:  # behind a blank, comma, semicolon or bracket where there is one
                cut = max(line.rfind(c, at + room // 2, to) for c in " ,;)}>")
                to = cut + 1 if cut >= 0 else to
            segs.append((i, at, to))
            strength.append(s if at == 0 else INSIDE)
            at = to
    return segs, strength


def agglomerate(lines: list[str], decls: set[int], limit: int, overlap: int) -> tuple[list[tuple[int, int]], list[int], list[tuple[int, int, int]], list[float]]:
    """(pieces, heads of natural units, segments, strengths) of a text by agglomerative merging.

    Segments are merged across their weakest boundary first, the smaller result first among equals, while the merged
    text and the ``overlap`` segments before it fit into ``limit`` characters. Where the merging has only declarations
    left to merge across, the text stands in its natural units: their heads are the segments that begin with a
    declaration. From there it goes on, across the declarations, up to the pieces (first segment, last segment).
    """
    segs, strength = _segments(lines, decls, limit, overlap)
    n = len(segs)
    size = [b - a for _, a, b in segs]
    before = [0]
    for x in size:
        before.append(before[-1] + x)
    extra = [before[k] - before[max(0, k - overlap)] for k in range(n)]
    tail = list(range(n))
    nxt, prv, alive, stamp = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n, [0] * n
    heap: list[tuple] = []

    def push(a: int, b: int) -> None:
        if 0 <= a and b < n:
            heapq.heappush(heap, (strength[b], size[a] + size[b], b, a, stamp[a], stamp[b]))

    for k in range(n - 1):
        push(k, k + 1)
    natural = None
    while heap:
        s, total, b, a, sa, sb = heapq.heappop(heap)
        if not (alive[a] and alive[b]) or stamp[a] != sa or stamp[b] != sb:
            continue
        if natural is None and s >= DECL:
            natural = [k for k in range(1, n) if alive[k] and strength[k] >= DECL]
        line_end = segs[tail[b]][2] > len(lines[segs[tail[b]][0]])
        if total + extra[a] - line_end > limit:  # a line end that comes last is not part of a piece
            continue
        size[a], tail[a] = total, tail[b]
        alive[b] = False
        stamp[a] += 1
        nxt[a] = nxt[b]
        if nxt[b] < n:
            prv[nxt[b]] = a
        push(prv[a], a)
        push(a, nxt[a])
    pieces, k = [], 0
    while k < n:
        pieces.append((k, (nxt[k] if nxt[k] < n else n) - 1))
        k = nxt[k]
    return pieces, natural or [], segs, strength


def _cut_at(strength: float) -> str:
    return "declaration" if strength >= DECL else "blank" if strength >= BLANK else "line" if strength > INSIDE else "inside"


def split_text(text: str, path: str | None, first_line: int, symbol: str | None, limit: int, overlap: int) -> tuple[list[dict], list[dict]]:
    """Pieces and natural units of one text: see :func:`split_oversized`."""
    text = text.replace("\r\n", "\n")
    lines = text.split("\n")
    decls = {line: (kind, name) for line, kind, name in declaration_boundaries(text, path, first_line)}
    spans, natural, segs, strength = agglomerate(lines, set(decls), limit, overlap)
    starts = line_starts(text)
    pieces = []
    for k, last in spans:
        (top, top_at, _), (i, at, _), (j, _, to) = segs[max(0, k - overlap)], segs[k], segs[last]
        begin, own, end = starts[top] + top_at, starts[i] + at, starts[j] + min(to, len(lines[j]))
        label = symbol if k == 0 else f"{symbol}(cont.+{i})" if symbol else decls.get(i, (None, None))[1]
        pieces.append(
            {"start_line": first_line + top, "own_line": first_line + i, "end_line": first_line + j, "symbol_name": label, "content": text[begin:end], "own_at": own - begin, "cut_at": _cut_at(strength[k]) if k else None}
        )
    units = [(segs[k][0], *decls[segs[k][0]]) for k in natural]
    return pieces, [{"line": first_line + line, "kind": kind, "name": name} for line, kind, name in units]


_PIECE = pa.struct([("start_line", pa.int32()), ("own_line", pa.int32()), ("end_line", pa.int32()), ("symbol_name", pa.string()), ("content", pa.string()), ("own_at", pa.int32()), ("cut_at", pa.string())])
_UNIT = pa.struct([("line", pa.int32()), ("kind", pa.string()), ("name", pa.string())])
_SCHEMA = pa.schema([("id", pa.string()), ("file_path", pa.string()), ("pieces", pa.list_(_PIECE)), ("units", pa.list_(_UNIT))])
_DDL = (
    "id string, file_path string, pieces array<struct<start_line:int,own_line:int,end_line:int,symbol_name:string,content:string,own_at:int,cut_at:string>>,"
    "units array<struct<line:int,kind:string,name:string>>"
)


def split_oversized(chunks: DataFrame, limit: int, overlap: int) -> DataFrame:
    """``id, file_path, pieces, units`` for each distinct chunk with more than ``limit`` characters of content.

    Both come from one agglomerative merging (see :func:`agglomerate`): ``units`` are the heads of the natural units
    that it stands in before it merges across declarations, as file lines; ``pieces`` are what it ends in. A piece has
    at most ``limit`` characters and begins with the last ``overlap`` segments (lines, or parts of lines too long) of
    what stands before; its own text begins at character ``own_at`` on the file's line ``own_line``, where it was cut
    at a declaration, blank line, line or inside a line (``cut_at``, null for the first). A null start line counts as
    1; a null path means no declarations, only lines and blanks; null ids or contents give no row; equal ids count
    once; ``limit`` must exceed 2 and ``overlap`` be >= 0.
    """
    if limit <= 2 or overlap < 0:
        raise ValueError("limit must exceed 2 and overlap must not be negative")
    big = chunks.select("id", "file_path", F.coalesce("start_line", F.lit(1)).alias("start_line"), "content", "symbol_name")
    big = big.where((F.length("content") > limit) & F.col("id").isNotNull()).dropDuplicates(["id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                pieces, units = split_text(r["content"], r["file_path"], r["start_line"], r["symbol_name"], limit, overlap)
                rows.append({"id": r["id"], "file_path": r["file_path"], "pieces": pieces, "units": units})
            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return big.mapInArrow(run, _DDL)


def config_of(chunk_config: DataFrame, scope: str) -> tuple[int, int]:
    """(max_chars, overlap_lines) of a scope; the table has one row per scope."""
    row = chunk_config.where(F.col("scope") == scope).select("max_chars", "overlap_lines").orderBy("max_chars").first()
    if row is None:
        raise ValueError(f"no configuration for scope {scope!r}")
    return row.max_chars, row.overlap_lines


def pieces(split: DataFrame) -> DataFrame:
    """One row per piece of :func:`split_oversized`."""
    return split.select("id", "file_path", F.posexplode("pieces").alias("piece_no", "p")).select("id", "file_path", "piece_no", "p.*")


def cut_lines(split: DataFrame) -> DataFrame:
    """``id, cut_line``: the lines at which the natural units of :func:`split_oversized` begin, behind the first."""
    return split.select("id", F.explode("units").alias("u")).select("id", F.col("u.line").alias("cut_line")).distinct()
