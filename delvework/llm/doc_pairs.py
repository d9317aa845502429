"""Functions paired with their documentation, by island grammars."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delvework.llm.files import line_blocks, overlay
from delvework.llm.islands import Source
from delvework.llm.lexer import CODE, body, family, lex
from delvework.llm.splitting import start_state
from delvework.session import checkpointed

#: Placeholders that stand where documentation should be (fixed values).
_PLACEHOLDER = re.compile(r"^\W*(?:(?:TODO|FIXME|XXX|TBD|HACK|WIP)\b(?:\W*(?:add|write|missing)?\W*(?:docs?|documentation|description|comment)?)?|n/?a|none|docs?|description|documentation|document me|see above|see below|lorem ipsum.*|待补充|待办|暂无|説明|未記入)?\W*$", re.I)
#: Words with which directives to tools begin (fixed values).
_DIRECTIVE = re.compile(
    r"^\W*(?:noqa|type:\s*ignore|pylint\b|pyright\b|mypy:|flake8\b|fmt:\s*o|isort:|pragma\b|nosec\b|yapf\b|ruff:|eslint\b|prettier\b|tslint:|jshint\b|jslint\b|istanbul\b|c8 ignore|@ts-|"
    r"ts-ignore|ts-expect|go:\w+|nolint\b|NOLINT|lint:|build |\+build|clang-|IWYU|NOSONAR|CHECKSTYLE|noinspection\b|SuppressWarnings|spotless|formatter:|@formatter|rustfmt\b|clippy::|SAFETY\b|phpcs\b|phpstan|psalm|"
    r"@codeCoverage|codeCoverage|rubocop\b|:nodoc:|:doc:|frozen_string_literal|typed:|coding[:=]|-\*-|shellcheck\b|luacheck\b|ktlint\b|detekt\b|vim:|vi:|ex:|region\b|endregion\b|sourceMappingURL|webpack|jsx\b|SPDX-|!/|@generated\b)",
    re.I,
)
_TAG = re.compile(r"^\s*(?:[@\\](?:param|return|returns|throws|throw|raises|raise|since|see|author|deprecated|type|arg|brief|exception|version|todo|internal|override|inheritdoc|access|api|var|template|tparam|property|private|public|static|async)\b|:\w+(?:\s+[\w.]+)*:|(?:Args|Arguments|Parameters|Returns?|Raises|Yields|Examples?|Notes?)\s*:\s*$|#\s*(?:Arguments|Returns|Errors|Panics|Safety|Examples?)\s*$|-\s*(?:parameter|returns)\b)", re.I)
_CODE = re.compile(r"[;{}]\s*$|^\s*(?:if|for|while|return|let|const|var|def|fn|func|function|import|from|class|end)\b.*[(){}=:]|^[\w.$\[\]>-]+\s*(?:[-+*/|]|<<)?=[^=]|^[\w.$:>-]+\(.*\)(?:\.\w+\(.*\))*;?\s*$|^[{}()\[\];]+$|^\$\w+\s*=")
_WORD = re.compile(r"[^\W_]+")
_CJK = re.compile(r"[぀-ヿ㐀-䶿一-鿿가-힣]")
#: Words that say nothing beside a name (fixed values).
_FILLER = {"the", "a", "an", "this", "function", "method", "func", "fn", "def", "procedure", "routine", "helper", "constructor", "of", "for", "to", "and", "is", "does", "implementation", "impl", "code", "class", "test", "wrapper"}


def name_words(name: str) -> set[str]:
    """The lower-case words of an identifier."""
    return {w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)} | {name.lower()}


def _stem(word: str) -> str:
    for end in ("ing", "es", "ed", "s"):
        if word.endswith(end) and len(word) - len(end) >= 3:
            return word[: -len(end)]
    return word


def statement(doc: str, name: str) -> str:
    """What a comment says once tags, directives, ornaments, placeholders and code are taken out; '' if nothing is left.

    A text whose words are those of the function's name, with fillers, says nothing.
    """
    kept, in_tag = [], False
    for line in doc.split("\n"):
        s = line.strip()
        if not s:
            in_tag = False
            continue
        if _TAG.match(s):
            in_tag = True
            continue
        if in_tag and len(line) - len(line.lstrip()) >= 4:  # a tag's text runs on
            continue
        in_tag = False
        if _DIRECTIVE.match(s) or _PLACEHOLDER.match(s) or _CODE.search(s):
            continue
        if not _WORD.search(s):
            continue
        kept.append(s)
    text = "\n".join(kept)
    cjk = len(_CJK.findall(text))
    if cjk >= 4:
        return text
    own = name_words(name)
    stems = {_stem(w) for w in own}
    words = [w.lower() for w in _WORD.findall(text)]
    rest = [w for w in words if not w.isdigit() and w not in _FILLER and w not in own and _stem(w) not in stems]
    return text if len(rest) >= 2 and len(words) >= 3 else ""


def clean(kind: str, raw: str) -> str:
    if kind == "l":
        return "\n".join(body("l", x).removeprefix(" ") for x in raw.split("\n"))
    return body(kind, raw).strip("\n")


def functions(text: str, path: str | None, first_line: int, whole: bool) -> list[dict]:
    """The functions of a text that has comments, with their documentation ('' where it says nothing) and code.

    ``whole``: the text begins where a declaration with its comment begins; else a line comment on the first line may
    be cut off above: such functions are ``unsure``, and ``inner`` is what is said without that comment.
    """
    fam = family(path)
    if fam is None:
        return []
    text = text.replace("\r\n", "\n")
    lexed = lex(text, fam)
    if lexed[1] != CODE or not whole:
        state = start_state(text, fam, first_line)
        lexed = lexed if state == CODE else lex(text, fam, state)
    if not any(s[0] != "s" or fam == "python" for s in lexed[0]):
        return []
    src = Source(text, fam, lexed=lexed)
    out = []
    for d in src.declarations():
        if d.kind != "function":
            continue
        spans = src.comments_above(d)
        cut = not whole and spans and src.line_of(spans[0][1]) == 0 and spans[0][0] == "l"
        parts = [clean(s[0], text[s[1] : s[2]]) for s in spans if not s[4]]
        doc = statement("\n".join(parts), d.name)
        string = src.docstring(d)
        inner = statement(_dedent(body("s", string)), d.name) if string is not None else ""
        doc = "\n".join(x for x in (doc, inner) if x)
        end, closed = src.body(d) if doc else (d.line, True)
        code = "\n".join(src.lines[d.line : end + 1]) if doc else ""
        out.append({"function_name": d.name, "line": first_line + d.line, "doc": doc, "code": code, "open": not closed, "unsure": bool(cut and doc), "inner": inner})
    return out


def _dedent(s: str) -> str:
    lines = s.split("\n")
    pads = [len(x) - len(x.lstrip()) for x in lines[1:] if x.strip()]
    k = min(pads, default=0)
    return "\n".join([lines[0], *(x[k:] for x in lines[1:])])


_SCHEMA = pa.schema(
    [("id", pa.string()), ("file_path", pa.string()), ("start_line", pa.int32()), ("function_name", pa.string()), ("line", pa.int32()), ("doc", pa.string()), ("code", pa.string()), ("open", pa.bool_()), ("unsure", pa.bool_()), ("inner", pa.string())]
)
_DDL = "id string, file_path string, start_line int, function_name string, line int, doc string, code string, open boolean, unsure boolean, inner string"
#: Lines of a file that share a join key.
_NEAR = 256


def _commented(chunks: DataFrame) -> DataFrame:
    """``file_path, near, first, flags``: per chunk and stretch of lines, which of the chunk's lines are comments only."""
    lines = F.split("content", "\n")
    c = chunks.where("NOT whole").select("file_path", F.col("start_line").alias("first"), F.transform(lines, lambda x: x.rlike(r"^\s*(?://|#(?!!)|--|/\*|\*)")).alias("flags"))
    last = F.col("first") + F.size("flags") - 1
    return c.select("file_path", F.explode(F.sequence(F.floor(F.col("first") / _NEAR), F.floor(last / _NEAR))).alias("near"), "first", "flags")


def documented_functions(chunks: DataFrame) -> DataFrame:
    """``id, file_path, function_name, line, doc, code, open``: functions whose documentation says something.

    ``doc`` is the comment directly above the declaration (attributes, decorators and annotations may stand between)
    and, in Python, the string that opens the body, without tags, directives, placeholders, ornaments and disabled
    code; ``code`` runs from the declaration's line to the end of its balanced body, or, if that is still ``open`` there,
    of the chunk (see :func:`whole_bodies`). A line comment
    with which a chunk without symbol begins is whole only if another chunk shows that no comment stands above it, or
    if no chunk has the line above and other chunks of the file have symbols. Null ids,
    paths or contents and files of unknown kinds give no rows; equal rows count once; a null start line counts as 1.
    """
    start = F.coalesce("start_line", F.lit(1))
    c = chunks.select("id", "file_path", start.alias("start_line"), "content", (F.col("symbol_name").isNotNull() | (start <= 1)).alias("whole"))
    c = c.where("id IS NOT NULL AND file_path IS NOT NULL AND content IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                for f in functions(r["content"], r["file_path"], r["start_line"], r["whole"]):
                    if f["doc"]:
                        rows.append({"id": r["id"], "file_path": r["file_path"], "start_line": r["start_line"], **f})
            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    # written once, as both kinds below read it
    found = checkpointed(c.mapInArrow(run, _DDL).dropDuplicates(["id", "function_name", "line"]))
    sure = found.where("NOT unsure").select("id", "file_path", "function_name", "line", "doc", "code", "open")
    above = F.col("start_line") - 1
    asked = found.where("unsure").withColumn("near", F.floor(above / _NEAR))
    # windows also begin at line 1, and those are whole; their lines are wanted as well
    seen = _commented(c.withColumn("whole", F.col("whole") & (F.col("start_line") > 1)))
    at = F.get("flags", above - F.col("first"))
    told = asked.join(seen, ["file_path", "near"], "left").groupBy("id", "file_path", "function_name", "line", "doc", "code", "open", "inner").agg(F.max(F.when(above >= F.col("first"), at)).alias("more"))
    # a file with named symbols was indexed symbol by symbol: what no chunk has between them is blank
    named = chunks.where("symbol_name IS NOT NULL AND file_path IS NOT NULL").select("file_path").distinct().withColumn("named", F.lit(True))
    told = told.join(named, "file_path", "left")
    doc = F.when(~F.coalesce("more", ~F.coalesce("named", F.lit(False))), F.col("doc")).otherwise(F.col("inner"))
    kept = told.select("id", "file_path", "function_name", "line", doc.alias("doc"), "code", "open").where("doc <> ''")
    return sure.unionByName(kept)


class _Body:
    """A function whose body runs on behind its chunk, with the lines gathered so far."""

    def __init__(self, row: dict):
        self.row, self.lines, self.tried = row, [], 0

    def add(self, first_line: int, lines: list[str]) -> None:
        """Lines of the file from ``first_line`` on; those that no chunk has are empty."""
        at = self.row["line"] + len(self.lines)
        self.lines += [""] * max(0, first_line - at) + lines[max(0, at - first_line) :]

    def code(self, last: bool) -> str | None:
        """The declaration up to the end of its body; None while that isn't there. Looked for where the text has doubled."""
        size = sum(map(len, self.lines)) + len(self.lines)
        if not last and size < 2 * self.tried:
            return None
        self.tried = size
        src = Source("\n".join(self.lines), family(self.row["file_path"]))
        decl = next((d for d in src.declarations() if d.line == 0), None)
        end, closed = src.body(decl) if decl else (0, True)
        return "\n".join(src.lines[: end + 1]).rstrip("\n") if closed or last else None


_BODY = pa.schema([("id", pa.string()), ("function_name", pa.string()), ("line", pa.int32()), ("whole", pa.string())])


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Goes through files in the order of their lines; only the open functions of one file are kept."""
    path, active = None, []

    def done(last: bool) -> list[dict]:
        out = []
        for b in list(active):
            code = b.code(last) if b.lines or last else None
            if code is not None:
                active.remove(b)
                out.append({"id": b.row["id"], "function_name": b.row["function_name"], "line": b.row["line"], "whole": code})
        return out

    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            if r["file_path"] != path:
                rows += done(True)
                path = r["file_path"]
            if r["id"] is not None:
                active.append(_Body(r))
            elif active:
                lines = overlay(r["offs"], r["texts"]).split("\n")
                for b in active:
                    b.add(r["first_line"], lines)
                rows += done(False)
        yield pa.RecordBatch.from_pylist(rows, schema=_BODY)
    yield pa.RecordBatch.from_pylist(done(True), schema=_BODY)


def whole_bodies(pairs: DataFrame, chunks: DataFrame, block_lines: int = 256) -> DataFrame:
    """The ``pairs`` of :func:`documented_functions` with ``code`` up to the end of each body, beyond the chunk as well.

    The files of open functions are put together again in blocks of lines and gone through in order. A body that no
    later chunk closes runs to the end of what there is of its file.
    """
    todo = pairs.where("open").select("id", "file_path", "function_name", "line")
    near = todo.groupBy("file_path").agg(F.min("line").alias("_from"))
    ends = F.coalesce("start_line", F.lit(1)) + F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit("")))
    later = chunks.select("file_path", "start_line", "content").join(near, "file_path").where(ends >= F.col("_from"))
    blocks = line_blocks(later, block_lines).select("file_path", "first_line", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("function_name"), F.lit(None).cast("int").alias("line"), "offs", "texts")
    first = (F.floor((F.col("line") - 1) / block_lines) * block_lines + 1).cast("int")
    events = todo.select("file_path", first.alias("first_line"), F.lit(0).alias("kind"), "id", "function_name", "line", F.lit(None).cast("array<int>").alias("offs"), F.lit(None).cast("array<string>").alias("texts"))
    ordered = events.unionByName(blocks).repartition("file_path").sortWithinPartitions("file_path", "first_line", "kind")
    bodies = ordered.mapInArrow(_bodies, "id string, function_name string, line int, whole string")
    return pairs.join(bodies, ["id", "function_name", "line"], "left").select("id", "file_path", "function_name", "line", "doc", F.coalesce("whole", "code").alias("code"))


def found(pairs: DataFrame) -> DataFrame:
    """``id, function_name``, distinct."""
    return pairs.select("id", "function_name").distinct()
