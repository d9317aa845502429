"""Island grammars: declarations of functions, methods, classes and impl blocks in many languages.

Only documentation, annotations, signatures and balanced bodies are parsed; everything else is water and skipped.
Comments and strings are blanked out first, so what looks like a declaration inside them is not taken for one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from delvework.llm.lexer import CODE, lex

_ID = r"[A-Za-z_$][\w$]*"
_MOD = r"(?:(?:public|private|protected|internal|static|final|abstract|override|open|sealed|async|export|default|declare|readonly|inline|suspend|extern|unsafe|const|virtual|synchronized|native|data|local|partial|pub(?:\([^)\n]*\))?)[ \t]+)*"
_NOT = r"(?!(?:if|for|while|switch|catch|return|else|do|new|throw|function|match|foreach|elif|unless|until|case|when|with|sizeof|typeof|await|yield|and|or|not|in|assert|del|raise|except|lambda|using|lock|goto)\b)"
_CLASS = r"(?:class|interface|trait|enum|struct|record|object|namespace|module|union|protocol)"

#: Per family: patterns of a declaration line; groups f (function name), c (class name) or i (impl block).
_DECL = {
    "python": [r"^[ \t]*(?:async[ \t]+)?def[ \t]+(?P<f>\w+)[ \t]*\(", r"^[ \t]*class[ \t]+(?P<c>\w+)"],
    "rust": [rf"^[ \t]*{_MOD}fn[ \t]+(?P<f>\w+)", rf"^[ \t]*{_MOD}(?:struct|enum|trait|union)[ \t]+(?P<c>\w+)[^;\n]*\{{", r"^[ \t]*(?:unsafe[ \t]+)?(?P<i>impl)\b[^;\n]*"],
    "js": [
        rf"^[ \t]*{_MOD}function[ \t]*\*?[ \t]*(?P<f>{_ID})[ \t]*[(<]",
        rf"^[ \t]*{_MOD}(?:const|let|var)[ \t]+(?P<f2>{_ID})[ \t]*(?::[^=\n]+)?=[ \t]*(?:async[ \t]*)?(?:function\b|(?:\([^()\n]*\)|{_ID})[ \t]*(?::[^=\n]+)?=>)",
        rf"^[ \t]*{_MOD}{_CLASS}[ \t]+(?P<c>{_ID})[^;\n]*\{{",
        rf"^[ \t]+{_MOD}(?:get[ \t]+|set[ \t]+|\*[ \t]*)?{_NOT}(?P<m>\#?{_ID})[ \t]*(?:<[^>\n]*>)?\((?=[^()]*\)[ \t]*(?::[ \t]*[^{{}};\n]+)?\{{)",
    ],
    "go": [rf"^func[ \t]+(?:\([^)\n]*\)[ \t]*)?(?P<f>{_ID})[ \t]*[(\[]", rf"^type[ \t]+(?P<c>{_ID})[ \t]+(?:struct|interface)\b"],
    "java": [
        rf"^[ \t]*(?:@\w+(?:\([^)\n]*\))?[ \t]+)*{_MOD}{_CLASS}[ \t]+(?P<c>{_ID})[^;\n]*\{{?",
        rf"^[ \t]*(?:@\w+(?:\([^)\n]*\))?[ \t]+)*{_MOD}(?:<[^>\n]+>[ \t]*)?{_NOT}[\w.<>\[\],? \t]*?[\w>\]][ \t]+{_NOT}(?P<f>{_ID})[ \t]*\((?=[^()]*(?:\([^()]*\)[^()]*)*\)[ \t]*(?:throws[ \t]+[\w., \t]+)?\s*\{{)",
    ],
    "kotlin": [rf"^[ \t]*{_MOD}fun[ \t]+(?:<[^>\n]+>[ \t]*)?(?:{_ID}\.)?(?P<f>{_ID})[ \t]*\(", rf"^[ \t]*{_MOD}(?:companion[ \t]+)?{_CLASS}[ \t]+(?P<c>{_ID})"],
    "c": [
        rf"^(?:template[ \t]*<[^\n]*>[ \t]*)?{_MOD}{_NOT}[A-Za-z_][\w:<>,*& \t]*?[\s*&]{_NOT}(?P<f>~?[A-Za-z_][\w:~]*)[ \t]*\((?=[^();{{}}]*(?:\([^()]*\)[^();{{}}]*)*\)[ \t]*(?:const|noexcept|override)?\s*\{{)",
        rf"^[ \t]*(?:typedef[ \t]+)?{_MOD}(?:class|struct|enum|union|namespace|interface)[ \t]+(?P<c>{_ID})[^;=()\n]*\{{",
        rf"^[ \t]+{_MOD}{_NOT}[A-Za-z_][\w:<>,*& \t]*?[\s*&]{_NOT}(?P<m>~?[A-Za-z_]\w*)[ \t]*\((?=[^();{{}}]*\)[ \t]*(?:const|noexcept|override)?\s*\{{)",
    ],
    "php": [rf"^[ \t]*{_MOD}function[ \t]+&?(?P<f>\w+)[ \t]*\(", rf"^[ \t]*{_MOD}(?:class|interface|trait|enum)[ \t]+(?P<c>\w+)"],
    "ruby": [r"^[ \t]*def[ \t]+(?:self\.)?(?P<f>\w+[?!=]?)", r"^[ \t]*(?:class|module)[ \t]+(?P<c>[A-Z][\w:]*)"],
    "shell": [r"^[ \t]*(?:function[ \t]+)?(?P<f>[\w:-]+)[ \t]*\([ \t]*\)[ \t]*\s*[{(]", r"^[ \t]*function[ \t]+(?P<f2>[\w:-]+)[ \t]*\{"],
    "lua": [rf"^[ \t]*(?:local[ \t]+)?function[ \t]+(?:[\w.]+[.:])?(?P<f>\w+)[ \t]*\(", rf"^[ \t]*(?:local[ \t]+)?(?:[\w.]+\.)?(?P<f2>\w+)[ \t]*=[ \t]*function\b"],
}

#: Lines that may stand between a comment and its declaration.
_ATTR = re.compile(r"^\s*(?:@[\w.]+(?:\s*\(.*\))?|#!?\[.*\]|\[\[?[A-Za-z_][\w:]*(?:\(.*\))?\]\]?|__attribute__\s*\(\(.*\)\)|template\s*<.*>)\s*$")


@dataclass(frozen=True)
class Decl:
    """A declaration: 0-based lines of its own line and of its first comment or attribute, kind and name."""

    line: int
    top: int
    kind: str
    name: str
    pos: int


@lru_cache(maxsize=None)
def _decl_rx(fam: str):
    return [re.compile(p, re.M) for p in _DECL.get(fam, [])]


def masked(text: str, spans: list[tuple]) -> str:
    """The text with comments blanked and the inside of strings as well; lengths and line ends stay."""
    out, last = [], 0
    for kind, a, b, *_ in spans:
        out.append(text[last:a])
        piece = text[a:b]
        if kind == "s" and "\n" not in piece and b - a >= 2:
            out.append('"' + " " * (b - a - 2) + '"')
        else:
            out.append(re.sub(r"[^\n]", " ", piece))
        last = b
    out.append(text[last:])
    return "".join(out)


def line_starts(text: str) -> list[int]:
    starts, i = [0], text.find("\n")
    while i >= 0:
        starts.append(i + 1)
        i = text.find("\n", i + 1)
    return starts


class Source:
    """A piece of source with its spans, mask and lines."""

    def __init__(self, text: str, fam: str, state: int = CODE, lexed: tuple | None = None):
        self.text, self.fam = text, fam
        self.spans, self.end, _ = lexed or lex(text, fam, state)
        self.mask = masked(text, self.spans)
        self.starts = line_starts(text)
        self.lines = text.split("\n")
        self.mlines = self.mask.split("\n")
        self.comment_at: dict[int, tuple] = {}
        self._docs()

    def line_of(self, pos: int) -> int:
        lo, hi = 0, len(self.starts)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self.starts[mid] <= pos else (lo, mid)
        return lo

    def _docs(self) -> None:
        """Lines that end a comment standing alone on its lines, with the comment's first line."""
        for k, (kind, a, b, before, _) in enumerate(self.spans):
            if kind == "s":
                continue
            first, last = self.line_of(a), self.line_of(max(a, b - 1))
            if before or self.mlines[first].strip() or self.mlines[last].strip():
                continue
            self.comment_at[last] = (first, k)

    def declarations(self) -> list[Decl]:
        found: dict[int, Decl] = {}
        for rx in _decl_rx(self.fam):
            for m in rx.finditer(self.mask):
                kind, name = next((k, v) for k, v in m.groupdict().items() if v)
                pos = m.start(kind)
                line = self.line_of(pos)
                if line in found:
                    continue
                found[line] = Decl(line, self.top(self.line_of(m.start() + len(m.group()) - len(m.group().lstrip()))), "class" if kind == "c" else "impl" if kind == "i" else "function", name, pos)
        return [found[k] for k in sorted(found)]

    def top(self, line: int) -> int:
        """The first of the comment, attribute, decorator and annotation lines directly above a line."""
        while line > 0:
            if line - 1 in self.comment_at:
                line = self.comment_at[line - 1][0]
            elif self.is_attr(line - 1):
                line -= 1
            elif (open_line := self._long_attr(line - 1)) is not None:
                line = open_line
            else:
                break
        return line

    def is_attr(self, line: int) -> bool:
        """Whether a line is an attribute, a decorator or an annotation, a comment behind it aside."""
        return bool(_ATTR.match(self.mlines[line]))

    def _long_attr(self, line: int) -> int | None:
        """The first line of an attribute over several lines that ends on this one."""
        if not re.match(r"^.*[)\]]\s*$", self.mlines[line]):
            return None
        depth = 0
        for k in range(line, max(-1, line - 30), -1):
            s = self.mlines[k]
            if not s.strip():
                return None
            depth += sum(s.count(c) for c in ")]") - sum(s.count(c) for c in "([")
            if depth <= 0:
                return k if k < line and re.match(r"^\s*(?:@[\w.]+\s*\(|#!?\[)", s) else None
        return None

    def comments_above(self, decl: Decl) -> list[str]:
        """The comments directly above a declaration, attributes skipped, first one first."""
        out, line = [], decl.line
        while line > 0:
            if line - 1 in self.comment_at:
                first, k = self.comment_at[line - 1]
                out.append(self.spans[k])
                line = first
            elif self.is_attr(line - 1):
                line -= 1
            elif (o := self._long_attr(line - 1)) is not None:
                line = o
            else:
                break
        return out[::-1]

    def body_end(self, decl: Decl) -> int:
        """The last line of a declaration's balanced body, or the text's last line where it runs on."""
        return self.body(decl)[0]

    def body(self, decl: Decl) -> tuple[int, bool]:
        """(last line, whether the body ends there) of a declaration's balanced body; else it may run on behind the text."""
        if self.fam == "python":
            close = self._close(self.mask.find("(", decl.pos)) if "(" in self.mask[decl.pos : decl.pos + 200] else decl.pos
            k = self.line_of(close if close is not None else len(self.mask) - 1)
            indent, last = len(self.mlines[decl.line]) - len(self.mlines[decl.line].lstrip()), k
            for j in range(k + 1, len(self.lines)):
                s = self.lines[j]
                if not s.strip():
                    continue
                if len(s) - len(s.lstrip()) > indent:
                    last = j
                elif self.mlines[j].strip():
                    return last, True
            return last, False
        if self.fam in ("ruby", "lua"):
            pad = self.mlines[decl.line][: len(self.mlines[decl.line]) - len(self.mlines[decl.line].lstrip())]
            for j in range(decl.line + 1, len(self.lines)):
                if re.match(rf"{pad}end\b", self.mlines[j]):
                    return j, True
            return len(self.lines) - 1, False
        start = self.mask.find("{", decl.pos)
        semi = self.mask.find(";", decl.pos)
        if start < 0 or 0 <= semi < start:
            return (self.line_of(semi) if semi >= 0 else decl.line), start >= 0 or semi >= 0
        close = self._close(start, "{", "}")
        return (self.line_of(close), True) if close is not None else (len(self.lines) - 1, False)

    def _close(self, start: int, a: str = "(", b: str = ")") -> int | None:
        depth = 0
        for m in re.compile(f"[{re.escape(a + b)}]").finditer(self.mask, max(start, 0)):
            depth += 1 if m.group() == a else -1
            if depth == 0:
                return m.start()
        return None

    def docstring(self, decl: Decl) -> str | None:
        """The string that opens a Python body."""
        if self.fam != "python":
            return None
        close = self._close(self.mask.find("(", decl.pos))
        if close is None:
            return None
        colon = self.mask.find(":", close)
        if colon < 0 or self.mask.count("\n", close, colon):
            return None
        for kind, a, b, _, still in self.spans:
            if a > colon:
                if kind == "s":
                    between = self.text[colon + 1 : a]
                    if re.fullmatch(r"\s*[rRuUbBfF]{0,2}", between):
                        return None if still else self.text[a:b]
                    return None
                if self.text[colon + 1 : a].strip() and self.mask[colon + 1 : a].strip():
                    return None
        return None
