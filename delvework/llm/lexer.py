"""A small comment/string lexer whose behaviour over a piece of text is a state-transition function.

``lex(text, lang, state)`` returns the comment and string spans of the text and the state in which it ends.
``transition(text, lang)`` gives the end state for *every* start state, so functions of consecutive pieces
compose (associatively) and a file can be lexed in independent pieces.
"""

from __future__ import annotations

import re
from functools import lru_cache

CODE, BLOCK, TDQ, TSQ, DQ, SQ, BT, LONG, HERE, RAW = range(10)
N_STATES = 10

#: File extensions and the lexical family they belong to (fixed values).
FAMILY = {
    "py": "python", "pyi": "python", "pyx": "python",
    "rs": "rust",
    "js": "js", "jsx": "js", "mjs": "js", "cjs": "js", "ts": "js", "tsx": "js", "vue": "js", "svelte": "js",
    "go": "go",
    "java": "java", "scala": "java", "swift": "java", "groovy": "java",
    "kt": "kotlin", "kts": "kotlin",
    "c": "c", "h": "c", "cc": "c", "cpp": "c", "cxx": "c", "hpp": "c", "hh": "c", "cs": "c",
    "php": "php",
    "rb": "ruby",
    "sh": "shell", "bash": "shell", "zsh": "shell",
    "lua": "lua",
    "toml": "toml", "json": "json", "jsonc": "js",
    "yaml": "yaml", "yml": "yaml",
    "properties": "props", "env": "env", "ini": "ini", "cfg": "ini", "conf": "ini",
    "xml": "xml", "html": "xml", "svg": "xml", "md": "xml",
    "sql": "sql", "hs": "sql",
}

_DQ1 = r'"(?:[^"\\\n]|\\.)*(?:"|(?=\n)|\Z)'
_SQ1 = r"'(?:[^'\\\n]|\\.)*(?:'|(?=\n)|\Z)"
_DQM = r'"(?:[^"\\]|\\.)*(?:"|\Z)'
_SQM = r"'(?:[^'\\]|\\.)*(?:'|\Z)"
_CBLOCK = r"/\*(?:[^*]|\*(?!/))*(?:\*/|\Z)"
_CLINE = r"//[^\n]*"
_HASH = r"\#[^\n]*"
_HASHW = r"(?:(?<=\s)|(?<=;)|(?<![\s\S]))\#[^\n]*"
_TDQ = r'"""(?:[^"\\]|\\.|"(?!""))*(?:"""|\Z)'
_TSQ = r"'''(?:[^'\\]|\\.|'(?!''))*(?:'''|\Z)"
_BT = r"`(?:[^`\\]|\\.)*(?:`|\Z)"
_BTRAW = r"`[^`]*(?:`|\Z)"
_HEREDOC = r"<<[-~]?(?P<q>['\"]?)(?P<tag>[A-Z_][A-Z0-9_]*)(?P=q)[^\n]*\n(?:(?:(?![ \t]*(?P=tag)\b)[^\n]*)(?:\n|\Z))*(?:[ \t]*(?P=tag)\b|\Z)"
_PHPDOC = _HEREDOC.replace("<<[-~]?", r"<<<[ \t]*")
_RAW = r'\br#"(?:[^"]|"(?!\#))*(?:"\#|\Z)'

#: Per family: ordered (kind, state when left open, pattern). Kinds: l line comment, b block comment, s string.
_RULES = {
    "python": [("l", None, _HASH), ("s", TDQ, _TDQ), ("s", TSQ, _TSQ), ("s", None, _DQ1), ("s", None, _SQ1)],
    "rust": [("l", None, _CLINE), ("b", BLOCK, _CBLOCK), ("s", RAW, _RAW), ("s", DQ, _DQM), ("s", None, r"'(?:\\[^'\n]*|[^'\\\n])'")],
    "js": [("l", None, _CLINE), ("b", BLOCK, _CBLOCK), ("s", None, _DQ1), ("s", None, _SQ1), ("s", BT, _BT)],
    "go": [("l", None, _CLINE), ("b", BLOCK, _CBLOCK), ("s", None, _DQ1), ("s", BT, _BTRAW), ("s", None, _SQ1)],
    "java": [("l", None, _CLINE), ("b", BLOCK, _CBLOCK), ("s", TDQ, _TDQ), ("s", None, _DQ1), ("s", None, _SQ1)],
    "kotlin": [("l", None, _CLINE), ("b", BLOCK, _CBLOCK), ("s", TDQ, _TDQ), ("s", None, _DQ1), ("s", None, _SQ1)],
    "c": [("l", None, _CLINE), ("b", BLOCK, _CBLOCK), ("s", None, _DQ1), ("s", None, _SQ1)],
    "php": [("l", None, _CLINE), ("l", None, r"\#(?!\[)[^\n]*"), ("b", BLOCK, _CBLOCK), ("s", HERE, _PHPDOC), ("s", DQ, _DQM), ("s", SQ, _SQM)],
    "ruby": [("b", BLOCK, r"(?m:^)=begin\b(?:[^\n]|\n(?!=end))*(?:\n=end[^\n]*|\Z)"), ("l", None, _HASHW), ("s", HERE, _HEREDOC), ("s", DQ, _DQM), ("s", SQ, _SQM)],
    "shell": [("l", None, _HASHW), ("s", HERE, _HEREDOC), ("s", DQ, _DQM), ("s", SQ, r"'[^']*(?:'|\Z)")],
    "lua": [("b", BLOCK, r"--\[\[(?:[^\]]|\](?!\]))*(?:\]\]|\Z)"), ("l", None, r"--[^\n]*"), ("s", LONG, r"\[\[(?:[^\]]|\](?!\]))*(?:\]\]|\Z)"), ("s", None, _DQ1), ("s", None, _SQ1)],
    "toml": [("l", None, _HASHW), ("s", TDQ, _TDQ), ("s", TSQ, _TSQ), ("s", None, _DQ1), ("s", None, _SQ1)],
    "json": [("s", None, _DQ1)],
    "yaml": [("l", None, _HASHW), ("s", None, _DQ1), ("s", None, r"(?<=[\s\[,])'[^'\n]*'")],
    "props": [("l", None, r"(?m:^)[ \t]*[\#!][^\n]*")],
    "env": [("l", None, _HASHW), ("s", None, _DQ1), ("s", None, _SQ1)],
    "ini": [("l", None, r"(?m:^)[ \t]*[\#;][^\n]*"), ("s", None, _DQ1)],
    "xml": [("b", BLOCK, r"<!--(?:[^-]|-(?!->))*(?:-->|\Z)"), ("s", None, r'(?<==)"[^"<\n]*"')],
    "sql": [("l", None, r"--[^\n]*"), ("b", BLOCK, _CBLOCK), ("s", None, _SQ1), ("s", None, _DQ1)],
}

#: How a span that was left open ends, by state.
_ENDS = {
    BLOCK: {"lua": r"\]\]", "xml": r"-->", "ruby": r"(?m:^)=end[^\n]*", "": r"\*/"},
    TDQ: {"": r'(?:[^"\\]|\\.|"(?!""))*?"""'},
    TSQ: {"": r"(?:[^'\\]|\\.|'(?!''))*?'''"},
    DQ: {"": r'(?:[^"\\]|\\.)*?"'},
    SQ: {"": r"(?:[^'\\]|\\.)*?'", "shell": r"[^']*'"},
    BT: {"": r"(?:[^`\\]|\\.)*?`", "go": r"[^`]*`"},
    LONG: {"": r"\]\]"},
    HERE: {"": r"(?m:^)[ \t]*[A-Z_][A-Z0-9_]*;?[ \t]*(?m:$)"},
    RAW: {"": r'"\#'},
}
_KIND = {BLOCK: "b"}
#: Opening marks by which an unterminated last span is told from a finished one.
_CLOSE = {BLOCK: ("*/", "]]", "-->", "=end"), TDQ: ('"""',), TSQ: ("'''",), DQ: ('"',), SQ: ("'",), BT: ("`",), LONG: ("]]",), RAW: ('"#',)}


def family(path: str | None) -> str | None:
    """The lexical family of a file path, by its extension; None where it is unknown."""
    if not path:
        return None
    name = path.rsplit("/", 1)[-1]
    return FAMILY.get(name.rsplit(".", 1)[-1].lower()) if "." in name else None


@lru_cache(maxsize=None)
def _master(fam: str):
    parts, kinds, opens = [], {}, {}
    for i, (kind, state, pat) in enumerate(_RULES[fam]):
        pat = pat.replace("(?P<q>", f"(?P<q{i}>").replace("(?P=q)", f"(?P=q{i})").replace("(?P<tag>", f"(?P<tag{i}>").replace("(?P=tag)", f"(?P=tag{i})")
        parts.append(f"(?P<g{i}>{pat})")
        kinds[f"g{i}"], opens[f"g{i}"] = kind, state
    rx = re.compile("|".join(parts), re.S)
    by_index = {rx.groupindex[k]: (kinds[k], opens[k]) for k in kinds}
    return rx, by_index


@lru_cache(maxsize=None)
def _end(fam: str, state: int):
    by = _ENDS[state]
    return re.compile(by.get(fam, by[""]), re.S)


def states_of(fam: str) -> list[int]:
    """The states in which a piece of this family can end."""
    return [CODE, *dict.fromkeys(s for _, s, _ in _RULES[fam] if s is not None)]


def _open_end(m, state: int, end: int, size: int) -> bool:
    if state is None or end < size:
        return False
    s = m.group()
    if state == HERE:
        tag = next((v for k, v in m.groupdict().items() if k.startswith("tag") and v), "")
        last = s.rsplit("\n", 1)[-1].strip()
        return not ("\n" in s and last.startswith(tag))
    marks = _CLOSE[state]
    least = 5 if state in (TDQ, TSQ) else 3 if state == BLOCK else 1
    if state == BLOCK and s.startswith("=begin"):
        return "\n=end" not in s
    if len(s) <= least or not s.endswith(marks):
        return True
    if state in (DQ, SQ, BT, TDQ, TSQ):  # a closing mark behind an odd run of backslashes is part of the text
        body = s[: -len(marks[0])]
        return (len(body) - len(body.rstrip("\\"))) % 2 == 1
    return False


def lex(text: str, fam: str, state: int = CODE, known: dict | None = None):
    """Spans ``(kind, start, end, opened_before, still_open)`` of a text and its end state.

    ``known`` maps the spans (start, end) of the run from CODE to their index: lexing stops where it meets one and
    the index is returned as third item (else None), as everything after it is the same.
    """
    spans: list[tuple] = []
    pos = 0
    if state != CODE:
        m = _end(fam, state).search(text) if state in (BLOCK, LONG, HERE, RAW) else _end(fam, state).match(text)
        kind = _KIND.get(state, "s")
        if m is None:
            return [(kind, 0, len(text), True, True)], state, None
        pos = m.end()
        spans.append((kind, 0, pos, True, False))
    rx, by = _master(fam)
    end_state, size = CODE, len(text)
    for m in rx.finditer(text, pos):
        a, b = m.span()
        if known is not None and (i := known.get((a, b))) is not None:
            return spans, None, i
        # lastindex is the last group closed: for heredocs an inner one is closed first, the outer one last
        kind, opens = by[m.lastindex]
        still = _open_end(m, opens, b, size)
        spans.append((kind, a, b, False, still))
        if still:
            end_state = opens
    return spans, end_state, None


def transition(text: str, fam: str):
    """(end state by start state, {start state: spans}) of a piece; spans of states that can't occur are left out."""
    base, end, _ = lex(text, fam, CODE)
    known = {(s[1], s[2]): i for i, s in enumerate(base)}
    fn, runs = list(range(N_STATES)), {CODE: base}
    fn[CODE] = end
    for s in states_of(fam)[1:]:
        spans, e, i = lex(text, fam, s, known)
        if i is not None:
            spans, e = spans + base[i:], end
        fn[s], runs[s] = e, spans
    return fn, runs


_STRIP = {"b": re.compile(r"^[ \t]*(?:/\*+!?|\*+/|\*(?!\*)|<!--|--\[\[|=begin|=end)?[ \t]?|[ \t]*(?:\*+/|-->|\]\])[ \t]*$", re.M)}


def body(kind: str, text: str) -> str:
    """The text of a comment or string without its marks."""
    if kind == "l":
        return re.sub(r"^[ \t]*(?:/{2,}!?|#+!?|-{2,}|;+|!+)", "", text)
    if kind == "b":
        return _STRIP["b"].sub("", text)
    if text.startswith("<<"):
        return text.partition("\n")[2].rpartition("\n")[0]
    return re.sub(r'^(?:r#"|"""|\'\'\'|\[\[|["\'`])|(?:"#|"""|\'\'\'|\]\]|["\'`])$', "", text)
