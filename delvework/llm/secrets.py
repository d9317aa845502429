"""Credentials in source code and configuration: where they are, and the text with them taken out.

Literals near assignment contexts are segmented into dictionary words by Viterbi; what stays unexplained is the
residual. A long residual in a context that names a credential, or a literal of a known credential shape, is a secret;
known hash and identifier formats in other contexts aren't. The dictionary comes from the symbol names and paths of
the whole table, so words of the project are explained and random text or passwords of foreign words aren't.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delvework.llm.lexer import family

MASK = "REDACTED"
#: A word of the dictionary makes up at least this share of all words seen, so there are at most 1/share words.
WORD_SHARE = 1e-5

#: Words that names, labels and placeholders of credentials are made of (fixed values).
BASE_WORDS = (
    "about access account active admin after agent alias allow api app apply arg array async attr auth author authorization auto back base basic bearer before begin body bool buffer build byte call case cert change changeme char check class clean "
    "client close code color column comma command comment common conf config connect const content control cookie copy count create credential current custom data database date debug default delete demo description dev device digest disable doc "
    "domain double dummy edit email empty enable end endpoint entry env error event example export expr extra fake false field file filter first flag float folder form format found from func function generic get global group handler hash header "
    "hello help hidden host http https icon identifier ignore image import index info init inner input insert int internal invalid item iterator join json key keyword kind label lang last length level limit line link list live load local lock log "
    "login long lower main mail manager map mask match max menu message method min missing mock mode model module name namespace new next none normal not null number object offset old open operator option order other output owner pack page param "
    "parent parse parser part pass passphrase passwd password path pattern pick pin placeholder plain point policy pool port prefix press private process profile project prop provider public push pwd query queue quote range raw read record redacted "
    "region register relay remote remove render replace request require reset resource response result return role root route row rule run sample save scan schema scope search secret section select self semicolon send server service session set "
    "setting setup shared short show sign signing simple size sort source space split stage standard start state static status step stop storage store stream string style sub super svc switch symbol system table tag target task temp template test "
    "text theme this time timeout title todo token tool total trace tree true type union unit update upper url use user username utils valid value variable vault vector vendor version view void wait warning web webhook width window word work "
    "worker world write wrong xml yaml your zone here empty set unset unknown replaced semi colon bracket brace quota literal lexeme numeric keyword comment newline"
).split()

_SECRET_NAME = re.compile(
    r"(?:pass(?:w(?:or)?d|phrase|code)?|pwd|pw|secret|token|credentials?|api_?key|access_?key|auth_?key|signing_?key|private_?key|secret_?key|client_?key|svc_?key|service_?key|master_?key|session_?key|cipher_?key|enc(?:ryption)?_?key|hmac_?key|aes_?key|"
    r"deploy_?key|account_?key|storage_?key|shared_?key|ssh_?key|pin|pin_?code|salt(?:_?hex)?|auth|bearer|authorization|registry_?auth|jwt|login|cookie|key_?hex|key_?text|pass_?b64|_pass|_key)(?:_?(?:b64|hex|base64|raw|value|text|str|string|plain|prod|live|dev|stage|test))?$",
    re.I,
)
_NOT_SECRET_NAME = re.compile(
    r"(?:(?:^|[_.-])(?:label|field|kind|name|path|file|ttl|limit|count|size|length|min|max|days|port|host|mode|level|ratio|enabled|type|url|uri|id|ids|index|idx|pattern|regex|prompt|hint|title|text_label|column|header_name|policy|rotation|expiry|expires|timeout|verify_key|public_key|pubkey|fingerprint|checksum|digest|hash|sha\d*|etag|integrity|commit|revision|rev|uuid|icon|image)$)|(?:^|[_.-])(?:verify|public|pub|primary|foreign|sort|cache|partition|row|map|dict)[_.-]?key",
    re.I,
)
_HASH_NAME = re.compile(r"(?:check_?sum|digest|hash|sha(?:_?\d+)?|md5|etag|integrity|commit|revision|_rev$|^rev$|uuid|guid|(?:trace|request|span|build|run|job|event|fixture|object|record)_?id|icon|image|logo|font|verify_?key|public|pub_?key|fingerprint|nonce|crc|thumb|avatar|docs_?url|columns|pattern|allowed|template)", re.I)
_PLACEHOLDER = re.compile(
    r"""^(?:|[xX*.•\#_?0-]{3,}|<.*>|\[.*\]|\$\{.*\}|\$\(.*\)|\$\w+|%\w*%|%[sd]|\{\{.*\}\}|\{\w*\}|@\w+@|\#\{.*\}|env[.:\[(].*|process\.env\..*|os\.environ.*|getenv.*|ENV\[.*|System\.getenv.*|vault:.*|secret(?:s|smanager)?[:.].*|ssm:.*|kms:.*|op:/.*|arn:.*|file:.*|
    ref[:+].*|!vault.*|\w*redacted\w*|\w*change_?-?me\w*|replace[_-]?me.*|your[_-].*|.*_here|dummy.*|example.*|sample.*|fake.*|test|todo|tbd|none|null|nil|undefined|true|false|yes|no|on|off|secret|password|passwd|pwd|token|placeholder.*|insert.*|enter.*|fill.*|set[_-]?me|n/?a|default|empty|masked|hidden|removed|unset)$""",
    re.I | re.X,
)
_HEX = re.compile(r"^(?:0x)?[0-9a-fA-F]+$")
_UUID = re.compile(r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")
_HASHES = re.compile(r"^(?:(?:sha\d+|md5)[-:].*|\$2[aby]?\$.*|\$argon2.*|data:.*)$", re.I)
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_JWT = re.compile(r"(?<![\w.-])eyJ[\w-]{6,}\.[\w-]{6,}\.[\w-]{6,}")
_URL = re.compile(r"[a-zA-Z][\w+.-]*://([^\s:/@\"'<>`]+):([^\s@\"'<>`/]+)@([\w.-]+)")
_SCHEME = re.compile(r"\b(Basic|Bearer)\s+([A-Za-z0-9+/=._~:-]{8,})")
_QUOTED = re.compile(r"(?P<q>\"\"\"|'''|[\"'`])(?P<v>[^\s\"'`\\]{6,})(?P=q)")
#: The name that a literal is given to, read backwards from the literal.
_NAME_BEFORE = re.compile(r"\s*(?:\(\w+(?: wen)?|[A-Za-z]{1,2})?\s*(?P<by>=:|>=|==|=|:|,)\s*(?:[\w<>\[\]. ]+?'?&?\s*:)?\s*[\"'\])]*(?P<k>[\w$.-]*[A-Za-z_$])")
_CONT = re.compile(r"\s*(?:\+|\.\.|\.|\\|<<|&|\|\|)?[ \t]*\\?\r?\n\s*(?:\+|\.\.|\.|//|\#)?\s*([\"'`])([^\s\"'`\\]+)\1")
_CLI = re.compile(r"(?:--?(?:password|passwd|token|secret|api-?key|access-?key|key|auth|pass|pwd?|credentials?)[= ]|(?:\s-u\s+|--user[= ])[\w.-]+:)([\"']?)([^\s\"'$<{]\S{5,})\1", re.I)
#: A value to fall back on, and the name of a variable before it, read backwards.
_FALLBACK = re.compile(r"(?:,|\|\||\?\?|\?:|\bor\b)[ \t]*([\"'`])([^\"'`\s]{4,})\1")
_VARIABLE = re.compile(r"[ \t]*[\"'\])]*(\w{2,}[A-Za-z])(?=[\"'.\[( \r\n]|\Z)")
_EXPANSION = re.compile(r"\$\{(\w+):?[-=]([^}\s\"'$]{4,})\}")
#: Arguments with two strings at least, and the names of calls that take a place, a user and a password.
_ARGUMENTS = re.compile(r"\(([^()\n]*[\"'`][^()\n]*,[^()\n]*[\"'`][^()\n]*)\)")
_CALL = re.compile(r"(?:log_?[io]n|sign_?in|connect|dial|auth|open|bind|create|new|session|client|mount|attach)", re.I)
_ARGUMENT = re.compile(r"([\"'`])([^\"'`\n]*)\1")
#: A field of a query or a header inside a string.
_FIELD = re.compile(r"(?:[?&]|\b(?=X-))([A-Za-z][\w-]{2,})(?:=|:\s)([^&\s\"'`<>]{8,})")
_HOST = re.compile(r"^[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}(?::\d+)?$")
#: How people call passwords and accounts (fixed values).
_SAID = re.compile(
    r"password|passwd|passwor[dt]|kennwort|passphrase|\bpwd?\b|\bpass\b|\bmdp\b|mot de passe|contrase[nñ]a|\bclave\b|senha|palavra-passe|парол|密码|密碼|口令|パスワード|暗証|\bcreds?\b|credential|\blog ?in\b|zugang|acceso|acesso|accès|доступ|"
    r"\bsecret\b|\btoken\b|api[ _-]?key|账号|帳號|ログイン|identifiants?|anmeldung",
    re.I,
)
#: Parts of those words, one in each, by which lines without any are passed over (fixed values).
_SAID_PARTS = "pass|kennwort|pw|mdp|contrase|clave|senha|парол|密码|密碼|口令|パスワード|暗証|cred|login|log in|zugang|acc|acess|доступ|secret|token|api|账号|帳號|ログイン|identifiant|anmeldung".split("|")
_PARTS = ("private key", "eyj", "://", "basic ", "bearer ", "pass", "pwd", "pw", "secret", "token", "key", "auth", "cred", "pin", "salt", "login", "cookie", "-u ", "--user", "jwt")
_COMMENT = re.compile(r"(?:^|\s)(?://+|\#+|--|\*|;|<!--)\s?")
_STRANGE = re.compile(r"\d|[!*\#?@+%$&~^=]|[a-z][A-Z]")
_HINT = re.compile(r"pass|pwd|pw\b|secret|token|key|auth|cred|pin|salt|login|cookie|bearer|jwt|pw_|_pw", re.I)
_CONT_MARK = re.compile(r"\s*(?:\+|\.\.|\.|\\|<<|&)\s*\\?\r?\n")
_WORDS = re.compile(r"[A-Za-z]+|\d+|[^A-Za-z\d]+")

_CONFIG = {"toml", "json", "yaml", "xml", "env", "ini", "props"}
_CONFIG_LINE = {
    "xml": re.compile(r"<(?P<k>[\w.-]+)(?:\s[^<>]*)?>(?P<v>[^<>]+)</"),
    "": re.compile(r"^[ \t]*(?:[#;/]+[ \t]*)?(?:export[ \t]+|-[ \t]+)?[\"']?(?P<k>[A-Za-z_][\w.-]*)[\"']?[ \t]*[=:][ \t]*(?P<q>[\"']?)(?P<v>[^\r\n]*?)(?P=q)[ \t]*,?[ \t]*\r?$", re.M),
}
_YAML_BLOCK = re.compile(r"^(?P<pad>[ \t]*)[\"']?(?P<k>[A-Za-z_][\w.-]*)[\"']?[ \t]*:[ \t]*[|>][+-]?[ \t]*\r?\n(?P<v>[ \t]+[^\s][^\n]*)", re.M)
_COMMENT_PAIR = re.compile(r"(?:^|[\s(\"'`])(?P<k>[A-Za-z_][\w.-]*)[ \t]*(?:=|:|:=)[ \t]*(?P<v>[^\s\"'`,;()]{6,})")
#: A key and its value anywhere in a line of settings: quoted, also within a string, or bare up to the end of the pair.
_PAIR = re.compile(
    r"(?<![\w.$])(?<!\$\{)(?P<e>\\*[\"'])?(?P<k>[A-Za-z_][\w.-]*)(?(e)(?P=e))(?:[ \t]*[=:][ \t]*(?:(?P<q>\\*[\"'])(?P<v>(?:(?!(?P=q))(?:\\.|[^\\\r\n]))*)(?P=q)|(?P<b>[^\s\"'\\{}\[\],;&<>]+)(?=[ \t]*(?:[,;&}\]<\"'\\\r\n]|$)|[ \t]+[#;]))|=(?P<t>[^\s\"'\\{}\[\],;&<>]+))"
)
#: Elements that have the name in an attribute, and the value in another or as their text.
_NAMED_ELEMENT = re.compile(r"<[\w.:-]+[^<>]*?\s(?:name|key|id)\s*=\s*[\"'](?P<k>[\w.-]+)[\"'](?:[^<>]*?\svalue\s*=\s*(?P<q>[\"'])(?P<v>[^\"'<>]+)(?P=q)|[^<>]*>(?P<t>[^<>]+)</)")


class Dictionary:
    """Log-probabilities of words for the segmentation."""

    def __init__(self, counts: dict[str, int]):
        self.counts = dict(counts)
        for w in BASE_WORDS:
            self.counts[w] = max(self.counts.get(w, 0), 3)
        total = sum(self.counts.values())
        self.cost = {w: -math.log(n / total) for w, n in self.counts.items() if len(w) > 1}
        self.longest = max(map(len, self.cost), default=1)
        #: an unexplained letter costs more per character than nearly any word of three letters and more
        self.unknown = 6.0
        self.memo: dict[str, int] = {}

    def __reduce__(self):
        return Dictionary, (self.counts,)

    def residual(self, text: str) -> int:
        """Characters that no dictionary word explains on the cheapest segmentation; separators are free."""
        left = self.memo.get(text)
        if left is None:
            left = 0
            for part in _WORDS.findall(text):
                if part.isalpha():
                    left += self._letters(part.lower())
                elif part.isdigit():
                    left += len(part)
                else:
                    left += sum(c not in "._-:/ ,;|" for c in part)
            if len(self.memo) > 50_000:
                self.memo.clear()
            self.memo[text] = left
        return left

    def _letters(self, w: str) -> int:
        best, bad = [0.0], [0]
        for i in range(1, len(w) + 1):
            c, b = best[i - 1] + self.unknown, bad[i - 1] + 1
            for j in range(max(0, i - self.longest), i - 1):
                k = self.cost.get(w[j:i])
                if k is not None and best[j] + k < c:
                    c, b = best[j] + k, bad[j]
            best.append(c)
            bad.append(b)
        return bad[-1]


def _mixed(v: str) -> bool:
    return bool(re.search(r"[a-z]", v) and re.search(r"[A-Z]", v) and re.search(r"\d", v))


def _basic(v: str) -> bool:
    try:
        user, sep, pw = base64.b64decode(v + "=" * (-len(v) % 4), validate=True).decode("utf-8").partition(":")
        return bool(user and sep and pw) and not _PLACEHOLDER.match(pw)
    except (binascii.Error, ValueError):
        return False


def secret_name(name: str) -> bool:
    """Whether a name is that of a credential itself, not of something about one."""
    snake = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower().replace("-", "_").replace(".", "_")
    # a number behind a name counts things of its kind; that of an encoding belongs to it
    snake = snake if re.search(r"(?:^|_)(?:b|base)_?64$", snake) else re.sub(r"\d+$", "", snake).strip("_")
    return bool(_SECRET_NAME.search(snake)) and not _NOT_SECRET_NAME.search(snake)


def hash_name(name: str) -> bool:
    return bool(_HASH_NAME.search(re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name)))


def is_secret(name: str, v: str, words: Dictionary) -> bool:
    """Whether literal ``v``, given to ``name`` ('' if none), is a credential."""
    v = v.strip()
    if _PLACEHOLDER.match(v) or len(v) < 4 or re.fullmatch(r"(.)\1*", v):
        return False
    named = secret_name(name) if name else False
    if m := _SCHEME.search(v):
        if m[1] == "Basic":
            return _basic(m[2])
        return not _PLACEHOLDER.match(m[2]) and words.residual(m[2]) >= 8
    if _JWT.search(v):
        return True
    if m := _URL.search(v):
        return not _PLACEHOLDER.match(m[2]) and words.residual(m[2]) >= 4
    if v.startswith("-----BEGIN"):
        return False
    if re.match(r"^(?:[./~]|\w+:/)", v) and not named or " " in v:
        return False
    if named:
        if v.isdigit():
            return bool(re.search(r"pin(?:_?code)?$|passcode$", name, re.I)) and 4 <= len(v) <= 12
        if _HASHES.match(v) or _UUID.match(v) and not re.search(r"key|token|secret", name, re.I):
            return False
        if re.fullmatch(r"(?:[A-Za-z_$][\w$]*(?:\(\))?[.:]){1,}[A-Za-z_$][\w$]*(?:\(.*\)?)?", v) and words.residual(v) < 6:
            return False
        return words.residual(v) >= 4
    if name and hash_name(name) or _HASHES.match(v) or _UUID.match(v) or _HEX.match(v):
        return False
    return len(v) >= 20 and _mixed(v) and words.residual(v) >= max(16, 0.6 * len(v)) and not re.search(r"[|,;(){}<>%&]", v)


_LONG = re.compile(r"[\"'`][^\s\"'`]{20,}[\"'`]")


def find(text: str, path: str | None, words: Dictionary) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the secrets of a text, in order, without overlaps."""
    low = text.lower()
    hint, said = any(p in low for p in _PARTS), _lines_with(text, low, _SAID_PARTS)
    if not (hint or said or _LONG.search(text) or _ARGUMENTS.search(text)):
        return []
    fam, back = family(path), text[::-1]
    hits: list[tuple[int, int, str]] = []
    for m in _PEM.finditer(text) if "PRIVATE KEY" in text else ():
        e = _PEM_END.search(text, m.end())
        nxt = _PEM.search(text, m.end())
        end = e.end() if e and not (nxt and nxt.start() < e.start()) else _pem_tail(text, m.end())
        body = re.sub(r"\\[nrt]|[^A-Za-z0-9+/=]", "", text[m.end() : e.start() if e and e.end() == end else end])
        if len(body) >= 24 and not re.fullmatch(r"(?:\.|x|X|REDACTED)*", body):
            hits.append((m.start(), end, "private_key"))
    for m in _JWT.finditer(text) if "eyJ" in text else ():
        hits.append((m.start(), m.end(), "jwt"))
    for m in _URL.finditer(text) if "://" in text else ():
        if not _PLACEHOLDER.match(m[2]) and words.residual(m[2]) >= 4:
            hits.append((m.start(2), m.end(2), "url_password"))
    for m in _SCHEME.finditer(text) if "Bas" in text or "Bear" in text else ():
        if is_secret("", m[0], words):
            hits.append((m.start(2), m.end(2), m[1].lower()))
    if fam in _CONFIG:
        for m in _CONFIG_LINE.get(fam, _CONFIG_LINE[""]).finditer(text):
            if is_secret(m["k"], m["v"], words) and not _SCHEME.search(m["v"]) and not _URL.search(m["v"]):
                a = m.start("v") + len(m["v"]) - len(m["v"].lstrip())
                hits.append((a, m.end("v"), "assignment"))
        hits += _in_pairs(text, fam, words)
        if fam == "yaml":
            for m in _YAML_BLOCK.finditer(text):
                v = m["v"].strip()
                if "-----BEGIN" not in v and is_secret(m["k"], v, words):
                    a = m.start("v") + len(m["v"]) - len(m["v"].lstrip())
                    hits.append((a, a + len(v), "assignment"))
    else:
        last = -1
        for m in _QUOTED.finditer(text):
            if m.start() < last:
                continue
            v = m["v"]
            ls = text.rfind("\n", 0, m.start()) + 1
            n = _name_before(text, back, ls, m.start())
            name = n["k"][::-1].rsplit(".", 1)[-1] if n and n["by"] != "," else ""
            if not (len(v) >= 20 and _mixed(v)) and not _HINT.search(name) and not _CONT_MARK.match(text, m.end()):
                continue
            if not secret_name(name) and text[ls : m.start()].strip() == "" and text[m.end() : m.end() + 1] in (",", "\n", "\r", ""):
                continue  # a row of a table of data
            parts = [(m.start("v"), m.end("v"))]
            c = _CONT.match(text, m.end())
            while c:
                parts.append((c.start(2), c.end(2)))
                last = c.end()
                c = _CONT.match(text, c.end())
            v = "".join(text[a:b] for a, b in parts)
            if len(parts) > 1 and not name:
                continue
            if not name and (not n and not re.search(r"(?:[\w$]\s*\(|[=:,>]|return|\s)\s*[rbuf]?$", text[max(ls, m.start() - 200) : m.start()]) or _in_list(text, m.start(), m.end())):
                continue
            if is_secret(name, v, words) and not _SCHEME.search(v) and not _URL.search(v):
                hits += [(a, b, "assignment" if i == 0 else "part") for i, (a, b) in enumerate(parts)]
        for m in _COMMENT_PAIR.finditer(text) if hint else ():
            if _HINT.search(m["k"]) and secret_name(m["k"]) and not re.match(r"^[$@&*\w]*[(\[{]", m["v"]) and re.search(r"\d|[^\w.]", m["v"]) and is_secret(m["k"], m["v"], words):
                ls = text.rfind("\n", 0, m.start()) + 1
                if re.search(r"(?:^|\s)(?://|#|--|\*|;|<!--)|[\"'`]", text[ls : m.start("k")]) or fam == "shell":
                    hits.append((m.start("v"), m.end("v"), "comment"))
    for m in _CLI.finditer(text) if " -u " in text or "--" in text or " -p" in text else ():
        if not _PLACEHOLDER.match(m[2]) and words.residual(m[2].rstrip("\"'")) >= 4:
            hits.append((m.start(2), m.end(2), "argument"))
    hits += _in_calls(text, back, words)
    hits += _in_comments(text, said, words)
    hits.sort(key=lambda h: (h[0], -h[1]))
    out: list[tuple[int, int, str]] = []
    for h in hits:
        if not out or h[0] >= out[-1][1]:
            out.append(h)
    return out


def _name_before(text: str, back: str, ls: int, at: int) -> re.Match | None:
    """The name that the literal at ``at`` is given to, on its line or at the open end of the line above."""
    if m := _NAME_BEFORE.match(back, len(text) - at, len(text) - ls):
        return m
    if ls == 0 or text[ls:at].strip(" \t(&@$bruf"):
        return None
    up = text.rfind("\n", 0, ls - 1) + 1
    above = text[up : ls - 1].rstrip()
    for cut in (above, above.rstrip("( \t\\")):
        if cut and cut[-1] in "=:(":
            if m := _NAME_BEFORE.match(back, len(text) - up - len(cut), len(text) - up):
                return m
    return None


def _blank_before(text: str, at: int, blanks: str = " \t") -> int:
    """Where the blanks before a place begin."""
    while at > 0 and text[at - 1] in blanks:
        at -= 1
    return at


def _opens_pair(text: str, at: int) -> bool:
    """Whether a key at this place opens a line, a list or a map, behind a dash or ``export`` if there is one."""
    i = _blank_before(text, at)
    for word in ("-", "export"):
        if i < at and text.endswith(word, 0, i):
            i = _blank_before(text, i - len(word))
    return i == 0 or text[i - 1] in "{,[\n"


def _in_pairs(text: str, fam: str, words: Dictionary) -> list[tuple[int, int, str]]:
    """Secrets among all pairs of keys and values of settings, however many stand on a line."""
    hits, at = [], 0
    users = [m.span() for m in _URL.finditer(text)] if "://" in text else []
    while m := _PAIR.search(text, at):
        g = "v" if m["v"] is not None else "b" if m["b"] is not None else "t"
        v, at = m[g], m.start(g)  # what is no secret may hold pairs in turn
        if g != "v":
            if re.match(r"^[@&*\w]*[(\[{]|^\$[\w({]", v) or fam == "yaml" and v[0] == "*" or not secret_name(m["k"]) and "=" in v.rstrip("="):
                continue
            if not _opens_pair(text, m.start()) and not (secret_name(m["k"]) and _STRANGE.search(v)):
                continue
        if is_secret(m["k"], v, words) and not _SCHEME.search(v) and not _URL.search(v) and not any(a < m.start(g) < b for a, b in users):
            a = m.start(g) + len(v) - len(v.lstrip())
            hits.append((a, a + len(v.strip()), "assignment"))
            at = m.end()
    for m in _NAMED_ELEMENT.finditer(text) if fam == "xml" else ():
        g = "v" if m["v"] is not None else "t"
        if secret_name(m["k"]) and is_secret(m["k"], m[g], words) and not _SCHEME.search(m[g]) and not _URL.search(m[g]):
            a = m.start(g) + len(m[g]) - len(m[g].lstrip())
            hits.append((a, a + len(m[g].strip()), "assignment"))
    return hits


def _in_calls(text: str, back: str, words: Dictionary) -> list[tuple[int, int, str]]:
    """Passwords among the arguments of calls, as values to fall back on, and in fields of queries and headers."""
    hits = []
    for m in _FALLBACK.finditer(text):
        n = _VARIABLE.match(back, len(text) - m.start())
        if n and secret_name(n[1][::-1]) and is_secret(n[1][::-1], m[2], words):
            hits.append((m.start(2), m.end(2), "default"))
    for m in _EXPANSION.finditer(text) if "${" in text else ():
        if secret_name(m[1]) and is_secret(m[1], m[2], words):
            hits.append((m.start(2), m.end(2), "default"))
    for m in _FIELD.finditer(text) if "=" in text or "X-" in text else ():
        if secret_name(m[1]) and _STRANGE.search(m[2]) and is_secret(m[1], m[2], words):
            hits.append((m.start(2), m.end(2), "field"))
    for m in _ARGUMENTS.finditer(text):
        called = re.compile(r"\s*(\w+)").match(back, len(text) - m.start())
        if not called or not _CALL.match(called[1][::-1]):
            continue
        args = list(_ARGUMENT.finditer(m[1]))
        if len(args) >= 2 and (v := args[-1][2]) and _STRANGE.search(v) and not _HOST.match(v) and is_secret("password", v, words):
            at = m.start(1) + args[-1].start(2)
            hits.append((at, at + len(v), "argument"))
    return hits


def _lines_with(text: str, low: str, parts: list[str]) -> list[int]:
    """Where the lines begin that hold one of the parts in lower case."""
    found = set()
    for part in parts:
        at = low.find(part)
        while at >= 0:
            found.add(low.rfind("\n", 0, at) + 1)
            end = low.find("\n", at)
            at = low.find(part, end) if end >= 0 else -1
    if len(low) != len(text) and found:  # letters whose lower case is longer: lines are matched by their numbers
        starts = [0, *(m.end() for m in re.finditer("\n", text))]
        found = {starts[low.count("\n", 0, at)] for at in found}
    return sorted(found)


def _in_comments(text: str, lines: list[int], words: Dictionary) -> list[tuple[int, int, str]]:
    """Passwords told in comments, behind a word for them in one of many languages, on lines that may hold such a word."""
    hits = []
    for ls in lines:
        le = text.find("\n", ls)
        le = le if le >= 0 else len(text)
        if not _COMMENT.search(text, max(ls - 1, 0), le):
            continue
        m = next((m for m in _SAID.finditer(text, ls, le) if _COMMENT.search(text, max(ls - 1, 0), m.start())), None)
        if m is None:
            continue
        for t in re.finditer(r"\S+", text[m.end() : le]):
            v = t[0].strip("\"'`(),;").rstrip(".")
            v = v.rpartition(":")[2] if ":" in v and "//" not in v else v
            if len(v) >= 6 and _STRANGE.search(v) and not re.match(r"^[\d.,:/-]+$|^[<{$]", v) and not _HOST.match(v) and not re.search(r"\w\(|::|->|/\w", v) and is_secret("password", v, words):
                at = m.end() + t.start() + t[0].rfind(v)
                hits.append((at, at + len(v), "comment"))
    return hits


def _pem_tail(text: str, at: int) -> int:
    """Where the base64 lines behind an opening mark end when its closing mark is not in the text."""
    m = re.compile(r"(?:(?:\\n|[\s\"'`+.;,)(#/*-]|\\)*[A-Za-z0-9+/]{16,}={0,2})*").match(text, at)
    return m.end() if m else at


def _in_list(text: str, a: int, b: int) -> bool:
    """Whether a literal stands between others, as in a table of data."""
    i = _blank_before(text, a, " \t\r\n")
    if i == 0 or text[i - 1] not in ",[{":
        return False
    j = _blank_before(text, i - 1, " \t\r\n")
    return text[i - 1] == "," and j > 0 and text[j - 1] in "\"'`" or bool(_NEXT_LITERAL.match(text, b))


_NEXT_LITERAL = re.compile(r"\s*,\s*[\"'`]")


def redact(text: str, hits: list[tuple[int, int, str]]) -> str:
    """The text with each secret replaced; quotes, line ends and the marks of key blocks stay."""
    out, last = [], 0
    for a, b, kind in hits:
        out.append(text[last:a])
        if kind == "private_key":
            head = _PEM.match(text, a)
            tail = re.search(r"-----END [A-Z0-9 ]+-----$", text[a:b])
            inner = text[head.end() : a + tail.start() if tail else b]
            out += [head[0], re.sub(r"(\\[nrt])|[A-Za-z0-9+/]{12,}={0,2}", lambda m: m[1] or MASK, inner), tail[0] if tail else ""]
        else:
            out.append(MASK if kind != "part" else "")
        last = b
    out.append(text[last:])
    return "".join(out)


def dictionary(chunks: DataFrame, share: float = WORD_SHARE) -> Dictionary:
    """Words of symbol names and paths over the whole table, with their counts.

    Only words that make up at least ``share`` of all words are kept: at most 1 / ``share`` of them, however large
    the table is.
    """
    text = F.concat_ws(" ", F.coalesce("symbol_name", F.lit("")), F.regexp_replace(F.coalesce("file_path", F.lit("")), r"[^/]*$", ""))
    split = F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2")
    counts = chunks.select(F.explode(F.regexp_extract_all(F.lower(split), F.lit("[a-z]{3,20}"), F.lit(0))).alias("w")).groupBy("w").count()
    total = F.coalesce(counts.agg(F.sum("count")).scalar(), F.lit(0))
    kept = counts.where(F.col("count") >= F.greatest(F.lit(2), F.ceil(total * share)))
    return Dictionary({r.w: r["count"] for r in kept.collect()})


_SCHEMA = pa.schema(
    [
        ("id", pa.string()),
        ("file_path", pa.string()),
        ("places", pa.list_(pa.struct([("line_no", pa.int32()), ("kind", pa.string())]))),
        ("redacted", pa.string()),
    ]
)


def redact_secrets(chunks: DataFrame, words: Dictionary | None = None) -> DataFrame:
    """``id, file_path, places, redacted`` for each distinct chunk that holds credentials.

    ``places`` has, per secret, the file's line of its first character and the kind of finding; a secret over several
    lines counts once. ``redacted`` is the content with the secrets replaced and everything else unchanged. Null ids
    and contents give no rows, a null path is treated as code of an unknown kind, a null start line as 1.
    """
    words = words or dictionary(chunks)
    ref = chunks.sparkSession.sparkContext.broadcast(words)
    c = chunks.select("id", "file_path", F.coalesce("start_line", F.lit(1)).alias("start_line"), "content").where("id IS NOT NULL AND content IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = ref.value
        for batch in batches:
            rows = []
            for i, path, start, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
                hits = find(text, path, words)
                if hits:
                    places = [{"line_no": start + text.count("\n", 0, a), "kind": kind} for a, _, kind in hits if kind != "part"]
                    rows.append({"id": i, "file_path": path, "places": places, "redacted": redact(text, hits)})
            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    ddl = "id string, file_path string, places array<struct<line_no:int,kind:string>>, redacted string"
    return c.mapInArrow(run, ddl).dropDuplicates(["id"])


def places(redacted: DataFrame) -> DataFrame:
    """``id, line_no``, distinct."""
    return redacted.select("id", F.explode("places").alias("p")).select("id", F.col("p.line_no").alias("line_no")).distinct()
