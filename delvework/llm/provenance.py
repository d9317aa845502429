"""Files that nobody of the project wrote by hand: generated, minified, vendored, or data saved as code.

Each file's token stream is normalized (comments dropped, numbers and strings reduced, digits cut off identifiers) and
fingerprinted by winnowing. Fingerprints that recur in vendored trees or in many unrelated modules mark copies; a
stream that mostly repeats its own fingerprints marks the output of a tool; layout marks packed files and data.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delvework.llm.files import line_blocks, overlay
from delvework.llm.lexer import body, family, lex
from delvework.session import checkpointed

BLOCK_LINES = 1024
#: Tokens in a fingerprinted window and windows of which the least hash is kept.
GRAM, WINDOW = 16, 16
#: Fewer fingerprints than this are replaced by a hash of the whole.
FEW = 8
#: Share of a file's fingerprints that must recur for it to be a copy, and unrelated modules that make them common.
COPIED, MODULES = 0.8, 4
#: A fingerprint in more than one of so many rows is joined without a shuffle: there are fewer than so many of them.
HOT = 1000

#: Lexical families of settings.
SETTINGS = {"toml", "json", "yaml", "props", "env", "ini", "xml"}
#: Directories of third-party trees and of tools' output, by convention (fixed values).
VENDOR_DIRS = {"third_party", "third-party", "thirdparty", "vendor", "vendored", "node_modules", "bower_components", "external", "extern", "deps", "_deps", "site-packages", "dist-packages", "pods", "carthage", "jspm_packages"}
BUILD_DIRS = {"gen", "generated", "autogen", "auto_generated", "generated-sources", "out", "dist", "target", "build", "bin", "obj", "__generated__"}
_GEN_NAME = re.compile(r"(?:(?:[._-](?:gen|generated|pb2|pb2_grpc|autogen)|\.(?:pb|g|designer|schema|grpc))\.[a-z]+$|^zz_generated)", re.I)
_MIN_NAME = re.compile(r"[._-](?:min|bundle|packed|prod|umd)\.(?:js|css|mjs|ts)$", re.I)

#: Openings of the banners of generators (fixed values).
_GEN_BANNER = re.compile(
    r"^\W*(?:code generated\b|(?:auto-?)?generated (?:by|from|with|file|code|using|automatically)\b|auto-?generated\b|@generated\b|<auto-?generated|this (?:file|code|class|module) (?:was|is|has been) (?:auto(?:matically)?[- ]?)?(?:generated|created|produced|written) (?:by|from|with|automatically)?|"
    r"this file (?:was|is) auto|automatically generated\b|do not (?:edit|modify|change)\b|don't edit\b|machine[- ](?:written|generated)|derived from .* (?:at build time|by)\b|produced by (?:the )?.* (?:compiler|generator)\b|compiled from\b|built (?:by|from) .* (?:do not|don't)|"
    r"automatisch (?:erzeugt|generiert|erstellt)|diese datei wurde .*(?:erzeugt|generiert|erstellt)|(?:von|durch) .* erzeugt, (?:bitte )?nicht|fichier (?:produit|généré|genere|créé) (?:par|automatiquement)|ce fichier (?:est|a été) (?:généré|produit|créé)|archivo (?:creado|generado|producido) (?:por|automáticamente)|este archivo (?:fue|es|ha sido) (?:generado|creado)|"
    r"(?:ficheiro|arquivo) (?:criado|gerado|produzido) (?:por|automaticamente)|este (?:ficheiro|arquivo) (?:foi|é) (?:gerado|criado)|файл (?:создан|сгенерирован|получен)|этот файл (?:создан|сгенерирован)|(?:本|此|该)文件由.*(?:生成|产生)|自动生成|このファイルは.*生成|自動生成)",
    re.I,
)
_TOOL_TAIL = re.compile(r"do not (?:edit|modify)|regenerate with|run \S+ again|nicht von hand|ne pas modifier|no se debe editar|não deve ser editado|не изменяйте|请勿(?:手动)?修改|編集しないで", re.I)
#: Openings of the notices of third parties; {own} notices don't count.
_THIRD = re.compile(
    r"^\W*(?:copyright (?:\(c\)|©)?\s*(?:\d{4}\W*)*(?:the )?(?P<a>[\w.-]+) (?:contributors|authors|developers|project|foundation|team)\b|(?P<b>[\w.-]+),? (?:release |v(?:ersion)? ?)?\d+(?:\.\d+)+\b.*(?:copyright|licen[cs]e|distribution|rights|\(c\)|©)|(?P<c>[\w.-]+),? release \d+(?:\.\d+)+|"
    r"this file is part of (?:the )?(?P<d>[\w.-]+) \d+(?:\.\d+)+|(?:copied|taken|imported|vendored|adapted|ported) (?:from|out of) (?P<e>[\w.-]+)(?: \d+(?:\.\d+)+| by| under| with)|!\s*(?P<f>[\w.-]+) v?\d+\.\d+)",
    re.I,
)
_TOKEN = re.compile(r"[A-Za-z_$][\w$]*|\d[\w.]*|[^\s\w]")
_DATA_LINE = re.compile(r"""^[\s\[\](){},;]*(?:(?:[-+]?(?:0x[0-9a-fA-F]+|\d[\d._]*(?:[eE][-+]?\d+)?)[fFlLuU]*|"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\#[0-9a-fA-F]{3,8}|true|false|null|None|nil)[\s\[\](){},;+.]*)+\\?$""")
_DIGITS = re.compile(r"\d+")
_DATA_START = set("0123456789-+[({\"'#,ntfN")
_SENTENCE = re.compile(r"[^\W\d_]{2,}(?:[,;:]?\s+[^\W\d_]{1,}){3,}|[぀-ヿ㐀-鿿]{6,}")


def path_kind(path: str) -> str | None:
    """What a path alone tells: 'vendored', 'generated', 'minified' or nothing."""
    *dirs, name = path.lower().split("/")
    for i, d in enumerate(dirs):
        if d in VENDOR_DIRS and i < len(dirs) - (d in ("external", "deps", "extern")) + 1:
            return "vendored"
    if _MIN_NAME.search(name):
        return "minified"
    if any(d in BUILD_DIRS for d in dirs) or _GEN_NAME.search(name):
        return "generated"
    return None


def _head(text: str, spans: list[tuple]) -> list[str]:
    """Lines of the comments before the first code of a text."""
    lines, at = [], 0
    for kind, a, b, *_ in spans:
        between = text[at:a]
        if kind == "s" or between.strip() and not re.fullmatch(r"\s*(?:<\?php|#!.*|;|package [\w.]+;?|'use strict';?)?\s*", between):
            break
        raw = text[a:b]
        if raw.startswith("/*!"):
            lines.append("! " + body("b", raw).lstrip("!* "))
        else:
            lines += body(kind, raw).split("\n")
        at = b
    return lines


def banners(lines: list[str]) -> tuple[bool, str | None]:
    """(whether the head says a tool wrote the file, name of the third party it belongs to)."""
    gen, third = False, None
    for line in lines:
        s = line.strip()
        if _GEN_BANNER.match(s) and not re.search(r"\b(?:not|never) (?:auto)?generated", s, re.I):
            gen = True
        elif _TOOL_TAIL.search(s) and re.search(r"generat|erzeugt|produ|crea|生成|создан", s, re.I) and not re.match(r"\W*(?:checks|reads|lists|strips|makes|writes|finds|that|which)\b", s, re.I):
            gen = True
        if m := _THIRD.match(s):
            third = third or next((v for v in m.groups() if v), None)
    return gen, third


def fingerprints(tokens: list[int]) -> tuple[np.ndarray, int, int]:
    """(kept fingerprints, windows, distinct windows) of a token stream by winnowing; a short stream is one window."""
    h = np.asarray(tokens, np.uint64)
    if len(h) == 0:
        return np.zeros(0, np.int64), 0, 0
    k = min(GRAM, len(h))
    g = np.zeros(len(h) - k + 1, np.uint64)
    mult = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for j in range(k):
            g = g * mult + h[j : j + len(g)]
        g ^= g >> np.uint64(29)
        g *= np.uint64(0xBF58476D1CE4E5B9)
    n, distinct = len(g), len(np.unique(g))
    w = min(WINDOW, n)
    low = g.copy()[: n - w + 1]
    for j in range(1, w):
        np.minimum(low, g[j : j + len(low)], out=low)
    return np.unique(low).view(np.int64), n, distinct


class _Hashes(dict):
    """Hashes of normalized tokens, filled as they come."""

    def __missing__(self, tok: str) -> int:
        if len(self) > 200_000:
            self.clear()
        c = tok[0]
        norm = "0" if c.isdigit() else re.sub(r"\d+", "", tok).lower() if c.isalpha() or c in "_$" else tok
        v = self[tok] = zlib.crc32(norm.encode()) + 1
        return v


_HASHED = _Hashes()


def block_features(text: str, path: str, first: bool) -> dict:
    """Sums over a block of lines from which a file is judged, with its fingerprints."""
    fam = family(path)
    spans = lex(text, fam)[0] if fam else []
    out, last = [], 0
    for kind, a, b, *_ in spans:
        out.append(text[last:a])
        out.append(_literal(text[a:b]) if kind == "s" else " ")
        nl = text.count("\n", a, b)
        if nl:
            out.append("\n" * nl)
        last = b
    out.append(text[last:])
    gen, third = banners(_head(text, spans)) if first else (False, None)
    chars = packed = data = 0
    code = []
    for line, bare in zip(text.split("\n"), "".join(out).split("\n")):
        s = line.strip()
        if not s:
            continue
        n = len(s)
        chars += n
        if n > 200:
            rest = len(bare) - 11 * bare.count(" $")  # strings and comments are no packed code
            if rest > 200 and sum(bare.count(c) for c in ";{}()=") > rest / 25:
                packed += rest
            if _dense(s):
                data += n
                continue
        if s[0] in _DATA_START and _DATA_LINE.match(s) and n > 1 and not _SENTENCE.search(s):
            data += n
            continue
        code.append(bare)
    toks = _TOKEN.findall("\n".join(code))
    fps, windows, distinct = fingerprints(list(map(_HASHED.__getitem__, toks)))
    if len(fps) < FEW and toks:  # too little to tell a copy from a likeness: only the whole counts
        fps = [int.from_bytes(hashlib.blake2b("\n".join(code).encode(), digest_size=8).digest(), "big", signed=True)]
    if fam in SETTINGS:  # settings repeat their own form by nature
        windows = distinct = 0
    return {"chars": chars, "packed": packed, "data": data, "tokens": len(toks), "windows": windows, "uniq": distinct, "gen": gen, "third": third, "fps": fps}


_LETTERS = str.maketrans("0123456789", "ghijklmnop")


def _literal(s: str) -> str:
    """One token that stands for a string: its hash, numbers aside, in letters."""
    return f" ${zlib.crc32(_DIGITS.sub('', s).encode()):08x} ".translate(_LETTERS)


def _dense(s: str) -> bool:
    """A long line that is nearly all literals: numbers, hex or base64."""
    lit = sum(len(m) for m in re.findall(r"0x[0-9a-fA-F]+|-?\d+(?:\.\d+)?|[A-Za-z0-9+/=\\]{60,}", s))
    punct = sum(s.count(c) for c in ", []{}\"'")
    return lit + punct > 0.85 * len(s)


_OUT = "file_path string, block int, module string, path_kind string, chars long, packed long, data long, tokens long, windows long, uniq long, gen boolean, third string, fps array<long>"
_SCHEMA = pa.schema(
    [("file_path", pa.string()), ("block", pa.int32()), ("module", pa.string()), ("path_kind", pa.string()), *((k, pa.int64()) for k in ("chars", "packed", "data", "tokens", "windows", "uniq")), ("gen", pa.bool_()), ("third", pa.string()), ("fps", pa.list_(pa.int64()))]
)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            path = r["file_path"]
            rows.append({"file_path": path, "block": r["block"], "module": r["module"], "path_kind": path_kind(path), **block_features(overlay(r["offs"], r["texts"]), path, r["block"] == 0)})
        yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


def judged() -> F.Column:
    """The kind of a file from its summed features, copies aside: vendored, generated, minified, data or null."""
    return (
        F.when((F.col("path_kind") == "vendored") | F.col("third").isNotNull(), "vendored")
        .when(F.col("path_kind").isNotNull(), F.col("path_kind"))
        .when(F.col("gen"), "generated")
        .when(F.col("packed") > 0.5 * F.col("chars"), "minified")
        .when((F.col("data") > 0.8 * F.col("chars")) & (F.col("data") > 400), "data")
        .when((F.col("windows") >= 24) & (F.col("uniq") < 0.5 * F.col("windows")), "generated")
    )


def not_handwritten(chunks: DataFrame, copied: float = COPIED, modules: int = MODULES, block_lines: int = BLOCK_LINES, hot: int = HOT) -> DataFrame:
    """``file_path, kind, recurring``: the files nobody wrote by hand, with what they are.

    ``kind`` is vendored, generated, minified, data or copy; ``recurring`` is the share of the file's fingerprints that
    occur in vendored files or in at least ``modules`` unrelated modules (the ``module`` of the chunks, or where that is
    null or blank the directory below the root; files outside of any count as one module): a file of which at least the
    share ``copied`` recurs is a copy. Fingerprints are reduced to distinct ones per module before a fingerprint's
    modules are counted, both map-side, so that one that a third of all files have stays small; where a file's rows meet
    the known ones, those of fingerprints that make up more than one row in ``hot`` aren't shuffled. Features are
    written once to the checkpoint folder. Rows without path or content are left out; repeated and overlapping chunks count once.
    """
    blocks = line_blocks(chunks, block_lines, ("module",)).select("file_path", "block", "module", "offs", "texts")
    # both branches read what is written here, so every file is tokenised once
    feats = checkpointed(blocks.mapInArrow(_features, _OUT))
    files = feats.groupBy("file_path").agg(
        F.first("path_kind").alias("path_kind"), *(F.sum(c).alias(c) for c in ("chars", "packed", "data", "windows", "uniq")), F.max("gen").alias("gen"), F.max("third").alias("third")
    ).select("file_path", judged().alias("kind"))
    # what makes a file vendored stands in its path or its first block; the few later blocks ask for it
    first = F.coalesce((F.col("path_kind") == "vendored") | F.col("third").isNotNull(), F.lit(False))
    vendored = files.where("kind = 'vendored'").select("file_path", F.lit(True).alias("seed"))
    later = feats.where("block > 0").join(vendored, "file_path", "left").withColumn("seed", F.coalesce("seed", F.lit(False)))
    seeded = feats.where("block = 0").withColumn("seed", first).unionByName(later)
    parts = F.split("file_path", "/")
    below = F.when(F.size(parts) > 2, F.get(parts, F.lit(1))).otherwise("")
    module = F.coalesce(F.nullif(F.trim("module"), F.lit("")), below)
    each = seeded.select("file_path", "seed", module.alias("module"), F.explode("fps").alias("fp"))
    once = each.groupBy("fp", "module").agg(F.max("seed").alias("seed"), F.count("*").alias("rows"))
    counts = once.groupBy("fp").agg((F.max("seed") | (F.count("*") >= modules)).alias("hit"), F.sum("rows").alias("rows"))
    total = feats.agg(F.sum(F.size("fps"))).first()[0] or 0
    flagged = checkpointed(counts.select("fp", "hit", (F.col("rows") * hot > total).alias("hot")).where("hit OR hot"))
    # fewer than ``hot`` fingerprints make up more than one row in ``hot`` each: those are sent, the others are joined by shuffle
    often = F.broadcast(flagged.where("hot").select("fp", F.col("hit").cast("int").alias("hit")))
    seldom = flagged.where("NOT hot").select("fp", F.lit(1).alias("hit"))
    rows = feats.select("file_path", F.explode("fps").alias("fp"))
    met = rows.join(often, "fp").unionByName(rows.join(often.select("fp"), "fp", "left_anti").join(seldom, "fp", "left"))
    share = met.groupBy("file_path").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recurring"))
    both = files.join(share, "file_path", "left")
    kind = F.when(F.col("kind").isNotNull(), F.col("kind")).when(F.col("recurring") >= copied, "copy")
    return both.select("file_path", kind.alias("kind"), F.coalesce("recurring", F.lit(0.0)).alias("recurring")).where("kind IS NOT NULL")


def found(files: DataFrame) -> DataFrame:
    """``file_path``, distinct."""
    return files.select("file_path").distinct()
