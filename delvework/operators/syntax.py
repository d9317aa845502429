"""Symbols of source texts: functions, methods, macros and types with their lines and qualified names.

There is no parser for these languages in the environment, so a text is read as islands in water: comments and strings
are blanked out, brackets are paired, and declarations are looked for at the level of the text or of the body of the
class, module or block they stand in. What stands between them is skipped.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

Symbol = tuple[int, int, str]  # first line, last line, name

_STRING = r'"(?:[^"\\\n]|\\.)*"?'
_QUOTED = r"'(?:[^'\\\n]|\\.)*'?"
_CHAR = r"'(?:\\[^'\n]*|[^'\\\n])'"
_C_COMMENTS = r"//[^\n]*|/\*.*?(?:\*/|\Z)"


_BEGIN = r"(?:^|(?<=[{};]))[ \t]*"


def _blank(pattern: str):
    rx = re.compile(pattern, re.S | re.M)
    return lambda text: rx.sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0][:1] in "/#=" else '"' + re.sub(r"[^\n]", " ", m[0][2:]) + ('"' if len(m[0]) > 1 else ""), text)


@dataclass(frozen=True)
class Language:
    """What declares symbols: patterns at the beginning of a line whose group ``n`` is the name."""

    blank: object
    #: Symbols, which may also stand inside of containers.
    symbols: tuple[str, ...] = ()
    #: Containers, whose bodies are searched; they give their name to what is inside.
    containers: tuple[str, ...] = ()
    #: Symbols that only stand inside of containers.
    members: tuple[str, ...] = ()
    #: Symbols that only stand inside of interfaces.
    signatures: tuple[str, ...] = ()
    #: Types and values that are symbols outside of containers.
    types: tuple[str, ...] = ()
    #: Whether functions are known by ``name(...) {`` alone, at the top and in containers.
    callables: tuple[bool, bool] = (False, False)
    #: Lines before a declaration that belong to it.
    lead: str | None = None
    compiled: dict = field(default_factory=dict, compare=False)

    def rx(self, part: str) -> list[re.Pattern]:
        if part not in self.compiled:
            # a declaration begins a line, or stands behind another on its line
            self.compiled[part] = [re.compile(p.replace("^[ \\t]*", _BEGIN, 1), re.M) for p in getattr(self, part)]
        return self.compiled[part]


def _words(*words: str) -> str:
    """Any number of these words before a declaration."""
    return rf"^[ \t]*(?:(?:{'|'.join(words)})\s+)*"


_RUST = _words(r"pub(?:\([^)\n]*\))?", "default", "async", "const", "unsafe", r'extern(?:\s+"[^"\n]*")?')
_JS = _words("export", "default", "declare", "async", "abstract")
_JS_MEMBER = _words("public", "private", "protected", "static", "readonly", "async", "override", "abstract", "get", "set", "accessor")
_JAVA = _words("public", "private", "protected", "static", "final", "abstract", "sealed", "non-sealed", "strictfp", r"@\w+(?:\([^)\n]*\))?")
_CS = _words("public", "private", "protected", "internal", "static", "sealed", "abstract", "partial", "readonly", "ref", "unsafe", "new", "virtual", "override", "extern", "file", "required")
_ID = r"(?P<n>[A-Za-z_$][\w$]*)"

_js_blank = _blank(rf"{_C_COMMENTS}|{_STRING}|{_QUOTED}|`(?:[^`\\]|\\.)*`?")
_c_blank = _blank(rf"{_C_COMMENTS}|{_STRING}|{_CHAR}")
_JAVASCRIPT = dict(
    blank=_js_blank,
    symbols=(rf"{_JS}function\s*\*?\s*{_ID}",),
    members=(rf"{_JS_MEMBER}\*?\s*(?!(?:if|for|while|switch|catch|return|function|new|with|do|else|throw|typeof|await|yield)\b)(?P<n>#?[A-Za-z_$][\w$]*)\s*(?:<[^>\n]*>)?\s*\((?=[^;]*?\{{)",),
)
LANGUAGES: dict[str, Language] = {
    "rust": Language(
        _blank(rf'{_C_COMMENTS}|\br(#*)".*?(?:"\1|\Z)|{_STRING[:-2]}(?:"|\Z)|{_CHAR}'.replace(r'[^"\\\n]', r'[^"\\]')),
        symbols=(rf"{_RUST}fn\s+{_ID}", rf"^[ \t]*macro_rules!\s*{_ID}"),
        containers=(r"^[ \t]*(?:unsafe\s+)?impl\b(?P<impl>[^;{]*)(?=\{)", rf"{_RUST}(?:trait|mod)\s+{_ID}(?=[^;{{]*\{{)"),
        types=(rf"{_RUST}(?:struct|enum|type|static(?:\s+mut)?)\s+{_ID}", rf"^[ \t]*(?:pub(?:\([^)\n]*\))?\s+)?const\s+{_ID}\s*:"),
    ),
    "js": Language(**_JAVASCRIPT, containers=(rf"{_JS}class\s+{_ID}",)),
    "ts": Language(
        **{**_JAVASCRIPT, "symbols": (*_JAVASCRIPT["symbols"], rf"{_JS}type\s+{_ID}(?:<[^=\n]*>)?\s*=")},
        containers=(rf"{_JS}(?:class|interface)\s+{_ID}",),
        signatures=(r"^[ \t]*(?:readonly\s+)?(?P<n>[A-Za-z_$][\w$]*)\??\s*(?:<[^>\n]*>)?\s*(?=[:(])",),
        types=(rf"{_JS}(?:const\s+)?enum\s+{_ID}",),
    ),
    "go": Language(_blank(rf"{_C_COMMENTS}|{_STRING}|`[^`]*`?|{_CHAR}"), symbols=(rf"^func\s*(?P<recv>\([^)\n]*\))?\s*{_ID}",), types=(rf"^type\s+{_ID}",)),
    "java": Language(_blank(rf'{_C_COMMENTS}|""".*?(?:"""|\Z)|{_STRING}|{_CHAR}'), containers=(rf"{_JAVA}(?:class|interface|enum|record|@interface)\s+{_ID}",), callables=(False, True), lead=r"^\s*@\w[\w.]*(?:\(.*\))?\s*$"),
    "c": Language(_c_blank, types=(r"^typedef\b[^;{]*(?:\{|;)",), callables=(True, False)),
    "cpp": Language(
        _blank(rf'{_C_COMMENTS}|\bR"\(.*?(?:\)"|\Z)|{_STRING}|{_CHAR}'),
        containers=(r"^[ \t]*(?:inline\s+)?namespace\b[ \t]*(?P<n>[\w:]*)(?=\s*\{)", rf"^[ \t]*(?:class|struct)\s+(?:\[\[.*?\]\]\s*)?{_ID}(?=[^;(){{}}=]*\{{)"),
        types=(r"^typedef\b[^;{]*(?:\{|;)", rf"^using\s+{_ID}\s*="),
        callables=(True, True),
    ),
    "cs": Language(
        _blank(rf'{_C_COMMENTS}|@"(?:[^"]|"")*"?|{_STRING}|{_CHAR}'),
        containers=(rf"{_CS}(?:class|interface|struct|enum|record(?:\s+(?:struct|class))?)\s+{_ID}", r"^[ \t]*namespace\s+(?P<n>[\w.]+)"),
        members=(rf"{_CS}(?:event\s+)?[\w<>\[\],.?]+\s+(?P<n>[A-Z_]\w*)\s*(?=(?:\{{\s*(?:\w+\s+)?(?:get|set|init|add)\b|=>))",),
        callables=(False, True),
        lead=r"^\s*\[.*\]\s*$",
    ),
    "ruby": Language(
        _blank(rf"^=begin\b.*?(?:^=end[^\n]*|\Z)|(?:(?<=\s)|^)\#[^\n]*|{_STRING}|{_QUOTED}"),
        symbols=(r"^[ \t]*(?:(?:private|protected|public|private_class_method)\s+)?def\s+(?P<n>(?:self\.|[A-Z]\w*\.)?(?:[A-Za-z_]\w*[?!=]?|[+\-*/<=>!~\[\]%&|^]+))",),
        containers=(r"^[ \t]*(?:class|module)\s+(?P<n>[A-Z][\w:]*)", r"^[ \t]*class\s*<<\s*(?P<n>\w+)"),
    ),
}
#: The language of an extension (fixed values).
EXTENSIONS = {"rs": "rust", "js": "js", "jsx": "js", "mjs": "js", "cjs": "js", "ts": "ts", "tsx": "ts", "go": "go", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "cs": "cs", "rb": "ruby"}

#: Words that stand before brackets without declaring anything (fixed values).
_NO_NAME = set("if for while switch catch return else do new throw synchronized using lock foreach when sizeof typeof fixed checked unchecked try assert static_assert alignas decltype defined case goto delete co_await co_return co_yield yield await not and or".split())
_CALLABLE = re.compile(r"(?:^|(?<=[{};]))(?P<pre>(?:[ \t]*@\w+(?:\([^)\n]*\))?[ \t]*)*[ \t]*(?:template\s*<[^{};]*>\s*)?[^\n;{}()=#\"]*?)(?P<n>(?:[A-Za-z_]\w*(?:<[^<>\n]*>)?::)*(?:~?[A-Za-z_]\w*|operator\s*(?:\(\)|[^\s(]+)))(?:<[^<>;\n]*>)?[ \t]*(?P<open>\()", re.M)
_BODY = re.compile(r"\s*(?:(?:const|noexcept(?:\([^)]*\))?|override|final|volatile|&&?|throws\s+[\w.,\s<>]+|where\s+[\w:,.\s<>()]+|->\s*[\w:<>,\s*&]+|:\s*[^;{}]*)\s*)*\{")


def groups(m: re.Match, name: str) -> str | None:
    return m.groupdict().get(name)


class Text:
    """A source text without comments and strings, its brackets in pairs and its lines."""

    def __init__(self, text: str, lang: Language):
        self.lang, self.mask = lang, lang.blank(text)
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.lines = text.split("\n")
        self.close: dict[int, int] = {}
        stack: list[tuple[str, int]] = []
        for m in re.finditer(r"[(){}\[\]]", self.mask):
            c = m[0]
            if c in "({[":
                stack.append((c, m.start()))
            else:
                want = {")": "(", "}": "{", "]": "["}[c]
                if any(o == want for o, _ in stack[-50:]):
                    while stack:
                        o, at = stack.pop()
                        self.close[at] = m.start()
                        if o == want:
                            break
        for _, at in stack:
            self.close[at] = len(self.mask)

    def line(self, pos: int) -> int:
        return bisect_right(self.starts, min(pos, len(self.mask)))

    def end_of(self, pos: int, stop: int) -> tuple[int | None, int]:
        """(start of the body, end) of a declaration whose name ends at ``pos``: a body in braces, or all up to a semicolon."""
        while m := re.compile(r"[({\[;]").search(self.mask, pos, stop):
            if m[0] == ";":
                return None, m.start()
            if m[0] == "{":
                return m.start(), self.close[m.start()]
            pos = self.close[m.start()] + 1
        return None, stop

    def walk(self, start: int, stop: int, parent: str = "", owner: str = "", interface: bool = False) -> Iterator[Symbol]:
        lang, at = self.lang, start
        forms = [("symbol", p) for p in lang.rx("symbols")] + [("container", p) for p in lang.rx("containers")]
        forms += [("symbol", p) for p in lang.rx("members")] if parent else [("type", p) for p in lang.rx("types")]
        if interface:
            forms += [("signature", p) for p in lang.rx("signatures")]
        if lang.callables[bool(parent)]:
            forms.append(("call", _CALLABLE))
        ahead: dict[int, re.Match | None] = {}
        while at < stop:
            best: tuple[int, int, re.Match] | None = None
            for k, (_, rx) in enumerate(forms):
                if k not in ahead or ahead[k] is not None and ahead[k].start() < at:
                    ahead[k] = rx.search(self.mask, at, stop)
                if (m := ahead[k]) is not None and (best is None or (m.start(), k) < best[:2]):
                    best = m.start(), k, m
            brace = self.mask.find("{", at, stop)
            if best is None:
                return
            m, kind = best[2], forms[best[1]][0]
            if 0 <= brace < m.start():
                at = self.close[brace] + 1
                continue
            if kind == "call" and not self.callable(m, owner):
                at = m.end("n")
                continue
            name, body, end = self.declared(kind, m, stop)
            if kind == "container":
                if body is not None:
                    yield from self.walk(body + 1, end, f"{parent}::{name}" if parent else name, name, "interface" in m[0])
            elif body is not None or not re.search(r"\b(?:fn|function)\b", m[0]):  # a function without a body is but announced
                first = m.start() + len(m[0]) - len(m[0].lstrip())
                yield self.first_line(first), self.line(end), f"{parent}::{name}" if parent else name
            at = max(end, m.end()) if kind == "signature" else max(end + 1, m.end("n") if groups(m, "n") else m.end())

    def callable(self, m: re.Match, owner: str) -> bool:
        name, pre = m["n"], m["pre"].strip()
        if name in _NO_NAME or name.rpartition("::")[2] in _NO_NAME or re.split(r"\W+", pre)[-1:] in (["return"], ["new"], ["else"], ["throw"], ["case"]):
            return False
        if not re.search(r"\w", pre) and name.lstrip("~") != owner and "::" not in name and not name.startswith("operator"):
            return False
        return bool(_BODY.match(self.mask, self.close[m.start("open")] + 1))

    def declared(self, kind: str, m: re.Match, stop: int) -> tuple[str, int | None, int]:
        """(name, start of the body, end) of a declaration."""
        groups = m.groupdict()
        if kind == "call":
            body = _BODY.match(self.mask, self.close[m.start("open")] + 1).end() - 1
            return ("template<>" if "template" in m["pre"] else "") + m["n"], body, self.close[body]
        if groups.get("impl") is not None:
            head = re.sub(r"^\s*<(?:[^<>]|<[^<>]*>)*>", "", groups["impl"])
            head = " ".join(re.split(r"\bwhere\b", head)[0].split())
            of, _, what = head.partition(" for ")
            body = self.mask.index("{", m.end())
            return (f"{what}<{of}>" if what else of), body, self.close[body]
        if kind == "type" and m[0].startswith("typedef"):
            brace = self.mask.find("{", m.start(), m.end())
            end = self.mask.find(";", self.close[brace] if brace >= 0 else m.start(), stop)
            end = end if end >= 0 else stop
            names = re.findall(r"\w+", re.sub(r"\[.*?\]|\)\s*\(.*", "", self.mask[m.start() if brace < 0 else self.close[brace] : end]))
            return (names[-1] if names else "<unknown>"), None, end
        name = groups["n"] or "<anonymous namespace>"
        if groups.get("recv"):
            owner = re.findall(r"\w+", groups["recv"].partition("[")[0])
            name = f"({owner[-1]}).{name}" if owner else name
        if self.lang is LANGUAGES["ruby"]:
            return name, *self.ruby_end(m, stop)
        if kind == "signature":
            return name, None, self._statement(m.end(), stop)
        if self.lang is LANGUAGES["ts"] and re.search(r"\btype\s+" + re.escape(name), m[0]):
            return name, None, self._statement(m.end(), stop)
        return name, *self.end_of(m.end("n"), stop)

    def _statement(self, at: int, stop: int) -> int:
        """The end of a statement whose semicolon may be left out: at the first line end outside of brackets that isn't carried on."""
        while m := re.compile(r"[({\[;\n]").search(self.mask, at, stop):
            if m[0] == ";":
                return m.start()
            if m[0] == "\n":
                if not re.compile(r"\s*[|&?:=.]").match(self.mask, m.start()) and self.mask[:m.start()].rstrip()[-1:] not in "|&=?:":
                    return m.start()
                at = m.end()
            else:
                at = self.close[m.start()] + 1
        return stop

    def ruby_end(self, m: re.Match, stop: int) -> tuple[int | None, int]:
        """A Ruby body ends at the ``end`` that stands as far in as its declaration."""
        line = self.line(m.start() + len(m[0]) - len(m[0].lstrip())) - 1
        first = self.lines[line]
        if re.search(r"\bend\s*$", first) or re.match(r"\s*def\s+\S+(?:\(.*\))?\s*=\s", first):
            return None, self.starts[line] + len(first)
        pad = re.escape(first[: len(first) - len(first.lstrip())])
        e = re.compile(rf"^{pad}end\b", re.M).search(self.mask, self.starts[line] + len(first), stop)
        return self.starts[line] + len(first), e.end() if e else stop

    def first_line(self, pos: int) -> int:
        """The line of a declaration, or of the annotations above it that belong to it."""
        k = self.line(pos)
        while self.lang.lead and k > 1 and re.match(self.lang.lead, self.lines[k - 2]):
            k -= 1
        return k


def symbols(text: str, ext: str) -> list[Symbol]:
    """(first line, last line, name) of the symbols of a text, one per first line; methods as ``Class::name``.

    Lines are 1-based. Extensions of other languages give none.
    """
    if ext not in EXTENSIONS:
        return []
    source = Text(text, LANGUAGES[EXTENSIONS[ext]])
    seen: dict[int, Symbol] = {}
    for s in source.walk(0, len(source.mask)):
        if s[2] != "<unknown>":
            seen.setdefault(s[0], s)
    return [seen[k] for k in sorted(seen)]
