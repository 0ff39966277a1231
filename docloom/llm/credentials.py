"""Finding and redacting literal credentials in source and configuration files.

Each detection pattern gives the trigrams that it requires; a trigram index over
the chunks of all files leaves the chunks where a pattern may match, and only
these are verified, in the batch that indexed them.  Verification looks at the form of the assignment and of the
value: stand-ins, references to variables or stores, names of fields, hashes and
numbers are not credentials.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import trigrams
from docloom.operators.physical import spread

#: Beginnings and forms of well-known token kinds.
_TOKEN_FORMS = (
    r"A[KS]IA[A-Z0-9]{16}",
    r"gh[pousr]_[A-Za-z0-9]{30,}",
    r"github_pat_[A-Za-z0-9_]{30,}",
    r"glpat-[A-Za-z0-9_-]{16,}",
    r"xox[abeoprs]-[A-Za-z0-9-]{16,}",
    r"hf_[A-Za-z0-9]{30,}",
    r"npm_[A-Za-z0-9]{30,}",
    r"pypi-[A-Za-z0-9_-]{30,}",
    r"dckr_pat_[A-Za-z0-9_-]{20,}",
    r"sk-[A-Za-z0-9_-]{20,}",
    r"[a-z]{2,6}_(?:live|test)_[A-Za-z0-9]{16,}",
    r"AIza[A-Za-z0-9_-]{35}",
    r"ya29\.[A-Za-z0-9_-]{20,}",
    r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}",
    r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
)
TOKEN = r"(?<![A-Za-z0-9_-])(?:" + "|".join(_TOKEN_FORMS) + r")(?![A-Za-z0-9])"
_BEGINNINGS = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "hf_", "npm_", "pypi-", "sk-", "_live_", "_test_", "AIza", "eyJ", "-----BEGIN")


def in_base64(text: str) -> list[str]:
    """What ``text`` surely looks like within base64, at each of the three alignments."""
    out = []
    for before in range(3):
        coded = base64.b64encode(b"\0" * before + text.encode() + b"\0" * 3).decode()
        out.append(coded[-(-8 * before // 6) : 8 * (before + len(text.encode())) // 6])
    return out


_CODED = sorted({x for b in _BEGINNINGS for x in in_base64(b) if len(x) > 2})
#: A run of base64; one that holds a beginning of a token is decoded.
BASE64_RUN = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{16,}={0,2}"
BASE64_TOKEN = "|".join(map(re.escape, _CODED))
PRIVATE_KEY = r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----"
URL_PASSWORD = r"[a-z][a-z0-9+.-]*://[^\s:/@\"'`<>]*:([^\s\"'`<>/@]+(?:/[^\s\"'`<>/@]+)*)@[\w\[]"
DSN_PASSWORD = r"(?<![\w/])[\w.-]+:([^\s\"'`@]+)@(?:tcp|unix|udp)\("

#: Words that name a secret, in several languages.
SECRET_WORD = (
    r"(?:passw(?:or[dt])?|passwd|passphrase|passcode|pwd|secret|credential|mot_?de_?passe|mdp|kennwort|contrase(?:ñ|n)a|senha|пароль|密码|パスワード"
    r"|api[_-]?key|access[_-]?key|account[_-]?key|auth[_-]?key|encryption[_-]?key|signing[_-]?key|private[_-]?key|shared[_-]?key|license[_-]?key|master[_-]?key|token|(?<![a-z])pass|bearer|authorization)"
)
_token, _base64_run, _coded = re.compile(TOKEN), re.compile(BASE64_RUN), re.compile(BASE64_TOKEN)
_KEY_END = re.compile(r"-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
_private_key, _DSN_END = re.compile(PRIVATE_KEY), re.compile(r"@(?:tcp|unix|udp)\(", re.I)
_url_password, _dsn_password = re.compile(URL_PASSWORD, re.I), re.compile(DSN_PASSWORD)

_VALUE = r"""(?P<q>["'`])(?P<v>(?:\\.|(?!(?P=q))[^\\\n])*)(?P=q)"""
#: key, sign, quoted value: assignments, entries, arguments, calls such as Set("key", "value").
_QUOTED = re.compile(rf"""(?<![\w.$-])(?P<k>[\w.$-]*{SECRET_WORD}[\w.-]*)\s*["'`]?\]?\)?\s*(?::=|\?=|=>|==?|:|,)\s*[a-zA-Z]?{_VALUE}""", re.I)
#: The same without quotation marks, for configuration, shell and build files.
_BARE = re.compile(rf"""(?:^|[\s;,"'/(?&])(?:export\s+|ENV\s+|ARG\s+|set\s+|-D|--?|-e\s+)?(?P<k>[\w.$-]*{SECRET_WORD}[\w.-]*)\s*(?::=|\?=|=|:)\s*(?P<v>[^\s"'`#][^\s"'`]*)""", re.I)
_ENV_SPACE = re.compile(rf"""^\s*(?:ENV|ARG)\s+(?P<k>\w*{SECRET_WORD}\w*)\s+(?P<v>[^\s"'`#]+)\s*$""", re.I)
_OPTION = re.compile(rf"""(?:^|\s)--?(?P<k>[\w-]*(?:{SECRET_WORD})[\w-]*)(?:\s+|=)(?:["'](?P<w>[^"'\s]+)["']|(?P<v>[^\s"'`-][^\s"'`,]*))""", re.I)
_SSHPASS = re.compile(r"""\bsshpass\s+-p\s*["']?(?P<v>[^\s"']+)""")
#: A mark, then the first thing after it in the line; in two steps, since ``mark.*?thing`` takes quadratic time on long lines.
_COMMAND, _USER = re.compile(r"\b(?:curl|wget|http)\b"), re.compile(r"""\s(?:-u|--user)[\s=]*["']?[^\s:"']+:(?P<v>[^\s"']+)""")
#: Clients that take a password as an option of one letter.
_CLIENTS = {
    re.compile(r"""\s-p(?P<q>["']?)(?P<v>[^\s"']+)(?P=q)"""): re.compile(r"\b(?:mysql|mariadb)\w*\b"),
    re.compile(r"""\s-a\s+(?P<q>["']?)(?P<v>[^\s"']+)(?P=q)"""): re.compile(r"\bredis-cli\b"),
    re.compile(r"""\s-[pP]\s+(?P<q>["']?)(?P<v>[^\s"']+)(?P=q)"""): re.compile(r"\b(?:docker login|podman login|registry login|sqlcmd|mongo(?:sh|dump|restore)?)\b"),
    re.compile(r"""\s-w\s+(?P<q>["']?)(?P<v>[^\s"']+)(?P=q)"""): re.compile(r"\bldap(?:search|modify|add|delete|whoami)\b"),
}
_BEARER = re.compile(r"""\b(?:bearer|basic|authorization["']?\s*[:,]\s*["']?token)\s+(?P<v>[A-Za-z0-9+/=_.~-]{8,})(?=["'`\s]|$)""", re.I)
_REMARK = re.compile(r"(?:^|\s)(?:[#;*]|//|--|<!--|/\*)")
_SPOKEN = re.compile(r"""\b(?P<k>login|pass\w*|pwd|pw(?=[\s:=])|token|secret|credentials?|(?:api )?key)\b(?: (?:for|of|on|to|in|at|from) [\w.-]+)*\s*(?:is\s*:?|:|=)\s*["'`]?(?P<v>[^\s"'`]+)""", re.I)
_PAIR = re.compile(r"""\b(?:auth|credentials?|login)\w*\s*=\s*\(\s*(["'])[^"']*\1\s*,\s*(?P<q>["'])(?P<v>[^"']+)(?P=q)\s*\)""", re.I)
_NAMED = re.compile(rf"""^[\s-]*name:\s*["']?(?P<k>\w*{SECRET_WORD}\w*)["']?\s*$""", re.I)
_NAMED_VALUE = re.compile(r"""^\s*value:\s*(?:(?P<q>["'])(?P<v>.*?)(?P=q)|(?P<w>[^\s"'#]+))\s*$""")
_OPEN = re.compile(r"""(?P<k>[\w.-]+)["']?\s*(?::=|=|:)\s*\(?\s*\\?\s*$""")
_PART = re.compile(r"""^\s*\(?\s*(?P<q>["'`])(?P<v>[^"'`]*)(?P=q)\s*[+.\\&)]*\s*[;,)]*\s*$""")
_PART_NEXT = re.compile(r"""[^\S\n]*["'`(]""")
_FIRST_PART = re.compile(r"""(?P<k>[\w.-]+)["']?\s*(?::=|=|:)\s*\(?\s*(?P<q>["'`])(?P<v>[^"'`]*)(?P=q)\s*[+.\\&]+\s*$""")

#: What the verifying expressions require of a text, derived from them; for an
#: expression that follows a mark or holds a word of the list, what these require.
PATTERNS = [TOKEN, BASE64_TOKEN, PRIVATE_KEY, URL_PASSWORD, DSN_PASSWORD, SECRET_WORD, _SPOKEN.pattern, _PAIR.pattern, _SSHPASS.pattern, _COMMAND.pattern, _BEARER.pattern, *(m.pattern for m in _CLIENTS.values())]
_REQUIRED = trigrams.required_bytes(PATTERNS)
_KEYED = trigrams.required_bytes([SECRET_WORD])
_GATES = {p: _KEYED for p in (_QUOTED, _OPTION, _BARE, _ENV_SPACE)} | {p: trigrams.required_bytes([p.pattern]) for p in (_SPOKEN, _PAIR, _SSHPASS, _BEARER)} | {_USER: trigrams.required_bytes([_COMMAND.pattern])} | {p: trigrams.required_bytes([m.pattern]) for p, m in _CLIENTS.items()}

_BARE_FILES = re.compile(r"(?:\.(?:ya?ml|env|ini|cfg|conf|properties|toml|sh|bash|zsh|mk|tf|tfvars|txt|npmrc|pypirc|netrc)|(?:^|/)(?:Dockerfile|Makefile|Containerfile|\.env|\.npmrc|\.pypirc)[\w.-]*)$", re.I)
_OTHER_KEY = re.compile(
    r"(?:name|names|field|ref|keyref|label|header|prefix|suffix|path|file|filename|dir|url|uri|endpoint|type|kind|count|limit|size|length|len|ttl|expiry|expires|expiration|format|regex|pattern|policy|hash|digest|"
    r"checksum|sha\d*|md5|id|ids|version|provider|manager|store|issuer|hint|help|prompt|title|description|placeholder|tokens|tokenizer|revision|commit|class|index|column|env|var|mount|volume|rotation|enabled|required)$",
    re.I,
)
_PUBLIC = re.compile(r"public|pub_?key|max_?token|num_?token|n_?token|token_?(?:count|limit|budget|len)", re.I)
_STRONG_TOKEN = re.compile(r"(?:^|[._-])(?:api|auth|access|bearer|refresh|oauth|session|bot|deploy|registry|github|gitlab|npm|slack|personal|service|admin|user|login|secret|private|client|webhook|id|x|csrf|ci|vault|bearer)?[_-]?token$|authtoken|accesstoken|apitoken|_authtoken", re.I)
_STAND_IN = re.compile(
    r"^(?:change[_-]?(?:me|it|this)\w*|replace[_-]?(?:me|this)?\w*|(?:your|my|some|insert|enter|put|use|add|set)[_ -].*|<.*>|\[.*\]|x{3,}.*|\*{3,}|\.{3,}|-+|_+|todo\w*|fixme|tbd|example.*|dummy.*|placeholder.*|sample.*|redacted|hidden|masked|"
    r"none|null|nil|true|false|undefined|empty|default|optional|required|string|str|text|value|test|foo|bar|baz|n/a|secret|private|public|basic|bearer|negotiate|required)$",
    re.I,
)
_REFERENCE = re.compile(
    r"^(?:\$[A-Za-z_]\w*|\$[({].*|%[A-Za-z_]\w*%|%\(.*|\{\{.*|\{%.*|#\{.*|\{[\w.]*\}|<%.*|@[a-z_.-]+|![a-zA-Z]+|[&*][a-z_]+|.*\$\{.*|.*\$\(.*|.*\{\{.*|(?:os|process|system|env|config|settings|secrets|vars|values|self|this|request|req|ctx|args|opts|options|params?|props|viper|cfg|data|local|var)[.\[(].*"
    r"|(?:vault|ssm|secret|secrets|sops|env|file|ref\+\w+|arn|op|keyvault|gcp|aws|awssm|consul|k8s|doppler|kms)[:/].*|(?:get|load|read|fetch)[_A-Z]\w*\(.*|/[\w.-]+(?:/[\w.-]+)*/?|\.{1,2}/.*|~/.*|[\w./-]+\.(?:pem|key|crt|cer|txt|json|ya?ml|env|p12|jks|pub|example|md)|https?://[^:@]*)$",
    re.I,
)
_HASHED = re.compile(r"^(?:sha\d+[:-]|md5:|\$2[aby]\$|\$argon2|\$[156]\$|\{ssha|\{sha|ssh-(?:rsa|ed25519|dss)|ecdsa-|pbkdf2)", re.I)
_RESOURCE = re.compile(r"^[a-z]+(?:-[a-z]+)+-(?=[a-z0-9]*\d)(?![a-z]{3,}\d{1,2}$)[a-z0-9]{4,6}$")
_NAME_OF_SECRET = re.compile(rf"^[\w.-]*(?:{SECRET_WORD}|key)s?[\w.-]*$", re.I)


#: What begins like a path but is as mixed as keys in base64 are.
_SLASHED = re.compile(r"(?=.*[a-z])(?=.*[A-Z])(?=.*\d)[A-Za-z0-9+/]{32,}={0,2}")


def _refers(value: str) -> bool:
    """Does ``value`` name a variable, a store or a file?"""
    return bool(_REFERENCE.match(value)) and not _SLASHED.fullmatch(value)


def literal(value: str, key: str = "") -> bool:
    """Is ``value`` a literal credential if a field called ``key`` holds it?"""
    value = value.strip()
    if len(value) < 4 or value.isdigit() or " " in value or "\t" in value:
        return False
    if _STAND_IN.match(value) or _refers(value) or _HASHED.match(value) or re.fullmatch(r"[\d.,:_-]+|v?\d+(?:\.\d+)+[\w.-]*", value):
        return False
    if len(set(value)) < 3 or value.endswith("(") or re.fullmatch(r"[A-Za-z_][\w.]*\(.*\)?;?", value):
        return False
    plain = re.sub(r"[_.\- ]", "", value).lower()
    if not any(c.isdigit() for c in value) and (_NAME_OF_SECRET.match(value) or plain == re.sub(r"[_.\- ]", "", key).lower()):
        return False
    if re.fullmatch(r"[A-Za-z0-9+/]{8,}={0,2}", value) and len(value) % 4 == 0:
        try:
            inner = base64.b64decode(value, validate=True).decode("ascii")
        except ValueError:
            inner = ""
        if inner.isprintable() and inner and (_STAND_IN.match(inner) or inner[0] not in "&*" and _refers(inner)):
            return False
    return True


def _holds(key: str, value: str) -> bool:
    """Does a field called ``key`` with ``value`` hold a credential?"""
    key = key.strip("\"'`$.-")
    if _OTHER_KEY.search(key) or _PUBLIC.search(key):
        return False
    if not literal(value, key):
        return False
    if re.search("token", key, re.I) and not re.search(SECRET_WORD.replace("|token", ""), key, re.I) and not _STRONG_TOKEN.search(key):
        # Many things are called tokens: then the value must look like a secret.
        return len(value) >= 20 and any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and not _RESOURCE.match(value)
    return not _RESOURCE.match(value)


def _decoded(value: str) -> str:
    try:
        whole = value.rstrip("=")
        whole = whole[: len(whole) - (len(whole) % 4 == 1)]  # one character over holds no byte
        return base64.b64decode(whole + "=" * (-len(whole) % 4)).decode("utf-8")
    except ValueError:
        return ""


def _urls(line: str) -> Iterator[re.Match]:
    """Matches of ``_url_password``, each looked for back from ``://``."""
    done, at = 0, line.find("://")
    while at >= 0:
        begin = at
        while begin > done and (line[begin - 1] in "+.-" or line[begin - 1].isascii() and line[begin - 1].isalnum()):
            begin -= 1
            if line[begin].isalpha():
                break
        m = _url_password.match(line, begin)
        if m:
            yield m
            done = m.end()
        at = line.find("://", max(done, at + 3))


def _dsns(line: str) -> Iterator[re.Match]:
    """Matches of ``_dsn_password``, each looked for in the text without blanks before its end."""
    done = 0
    for end in _DSN_END.finditer(line):
        begin = end.start()
        while begin > done and line[begin - 1] not in "\"'`@" and not line[begin - 1].isspace():
            begin -= 1
        m = _dsn_password.search(line, begin, end.end())
        if m:
            yield m
            done = m.end()


def _after(mark: re.Pattern, thing: re.Pattern, line: str) -> Iterator[re.Match]:
    """Matches of ``mark.*?thing``: of each, the match of ``thing``."""
    at = 0
    while (begin := mark.search(line, at)) and (m := thing.search(line, begin.end())):
        yield m
        at = m.end()


_MARKS = {_USER: _COMMAND, _SPOKEN: _REMARK, **_CLIENTS}


def _matches(pattern: re.Pattern, line: str) -> Iterator[re.Match]:
    mark = _MARKS.get(pattern)
    return _after(mark, pattern, line) if mark else pattern.finditer(line)


def _may(sets: list[frozenset[bytes]], low: bytes) -> bool:
    """Does the lower-cased ``low`` hold all trigrams of one of ``sets``?"""
    for s in sets:
        for gram in s:
            if gram not in low:
                break
        else:
            return True
    return False


def in_line(line: str, bare: bool) -> list[tuple[int, int]]:
    """Spans of the literal credentials that one line holds whole."""
    low = trigrams.lower_case(line).encode("utf-8", "surrogatepass")
    keyed = _may(_KEYED, low)
    out = [m.span() for m in _token.finditer(line) if not re.fullmatch(r"[\w-]*?x{6,}[\w-]*", m[0], re.I)]
    for m in _base64_run.finditer(line):
        inner = _decoded(m[0]) if _coded.search(m[0]) else ""
        if inner and (_token.search(inner) or _private_key.search(inner)):
            out.append(m.span())
    out += [m.span(1) for m in (*_urls(line), *_dsns(line)) if literal(m[1])]
    found = [_QUOTED, _OPTION, _SPOKEN, _PAIR, _SSHPASS, _USER, _BEARER, *_CLIENTS] + ([_BARE, _ENV_SPACE] if bare else [])
    for pattern in found:
        if not (keyed if _GATES[pattern] is _KEYED else _may(_GATES[pattern], low)):
            continue
        for m in _matches(pattern, line):
            groups = m.groupdict()
            which = "w" if groups.get("w") is not None else "v"
            value, key = groups[which], groups.get("k") or ""
            begin, end = m.span(which)
            if pattern in (_BARE, _SPOKEN, _OPTION):
                cut = value.rstrip(",;)]}" if pattern is not _BARE or "(" not in value else ",;")
                end -= len(value) - len(cut)
                value = cut
            if pattern in _CLIENTS:
                good = literal(value) and not value.isalpha() and not _RESOURCE.match(value)
            elif pattern is _BEARER or pattern is _SSHPASS or pattern is _USER or pattern is _PAIR:
                good = literal(value) and not (pattern is _BEARER and not any(c.isdigit() for c in value))
            elif pattern is _SPOKEN:
                good = literal(value) and not _RESOURCE.match(value) and any(c.isdigit() for c in value) and _holds("password", value)
            elif pattern is _OPTION:
                good = _holds(key, value)
            elif pattern is _QUOTED and re.search(r"(?:bearer|basic)\s", value, re.I):
                good = False  # the header form has its own pattern
            else:
                good = _holds(key, value)
            if good:
                out.append((begin, end))
    return out


def _lines(text: str, at: int) -> Iterator[tuple[int, str]]:
    """(offset, line) of the lines of ``text`` from ``at``."""
    while True:
        end = text.find("\n", at)
        yield at, text[at:] if end < 0 else text[at:end]
        if end < 0:
            return
        at = end + 1


def _parts(text: str, at: int) -> list[tuple[int, int, int]]:
    """(lines on, start, end) of the parts of a value written in several strings from the line at ``at``."""
    lines = ((offset, line[:-1] + " " if line.endswith("\r") else line) for offset, line in _lines(text, at))
    offset, line = next(lines)
    opened, first = _OPEN.search(line), _FIRST_PART.search(line)
    if not opened and not first:
        return []
    key = (opened or first)["k"]
    parts, values = [], []
    if first:
        parts, values = [(0, offset + first.start("v"), offset + first.end("v"))], [first["v"]]
    for j, (offset, line) in enumerate(lines, 1):
        more = _PART.match(line)
        if not more:
            break
        parts.append((j, offset + more.start("v"), offset + more.end("v")))
        values.append(more["v"])
        if line.rstrip()[-1:] in (";", ")"):
            break
    joined = "".join(values)
    if not joined:
        return []
    secret = _token.search(joined) or (re.search(SECRET_WORD, key, re.I) and _holds(key, joined))
    return parts if secret else []


def find(text: str, path: str | None, chunks: list[tuple[int, int, list[int]]] | None = None) -> list[tuple[int, int, int]]:
    """(line number, start, end) of each part of each credential in ``text``.

    Line numbers count from 1; further parts of a value have line number 0.  Only
    the lines of candidate ``chunks`` (first and last line, counted from 0, and the
    requirements that they meet, in order) are looked at, or all; what begins there
    is read to its end.
    """
    bare = path is None or bool(_BARE_FILES.search(path))
    out: dict[tuple[int, int], int] = {}
    lines = text.split("\n")
    offsets = list(accumulate((len(x) + 1 for x in lines), initial=0))
    done = 0  # lines that were looked at as beginnings of values in parts
    for first, last, met in chunks if chunks is not None else [(0, len(lines) - 1, range(len(_REQUIRED)))]:
        here = [_REQUIRED[n] for n in met]
        lower = trigrams.lower_case(text[offsets[first] : offsets[last + 1] - 1]).encode("utf-8", "surrogatepass")
        for i in [first + j for j, low in enumerate(lower.split(b"\n")) if _may(here, low)]:
            line = lines[i]
            key = _private_key.search(line)
            if key:
                begin = offsets[i] + key.start()
                stop = _KEY_END.search(text, begin)
                out[(begin, stop.end() if stop else offsets[i] + len(line))] = i + 1
            for a, b in in_line(line, bare):
                out.setdefault((offsets[i] + a, offsets[i] + b), i + 1)
            named = _NAMED.match(line)
            if named:
                for j in range(i + 1, min(i + 3, len(lines))):
                    value = _NAMED_VALUE.match(lines[j])
                    if value:
                        which = "w" if value["w"] is not None else "v"
                        if _holds(named["k"], value[which]):
                            out.setdefault((offsets[j] + value.start(which), offsets[j] + value.end(which)), j + 1)
                        break
        # A part may be what makes this chunk a candidate: back to where the value begins.
        begin = first
        while begin > done and (begin == first or _PART.match(lines[begin])):
            begin -= 1
        for i in range(begin, last + 1):
            line = lines[i].rstrip()
            if line and line[-1] in "(=+\\:.&" and len(line.lstrip()) > 1 and i + 1 < len(lines) and _PART_NEXT.match(lines[i + 1]):
                for n, (j, a, b) in enumerate(_parts(text, offsets[i])):
                    out.setdefault((a, b), 0 if n else i + j + 1)
        done = max(done, last + 1)
    return sorted((line, a, b) for (a, b), line in out.items())


def redact(text: str, found: list[tuple[int, int, int]], mark: str = "REDACTED") -> str:
    """``text`` with the spans found replaced, the rest character by character."""
    out, done = [], 0
    for _, a, b in sorted(found, key=lambda x: (x[1], -x[2])):
        if a >= done:
            out += [text[done:a], mark]
        done = max(done, b)
    return "".join(out) + text[done:]


def credential_lines(df: DataFrame, key: str, path: str, content: str) -> DataFrame:
    """``key, line_no``: the lines on which a literal credential begins, once each.

    Lines are cut at each newline and counted from 1.  NULL contents and keys give
    nothing; a NULL path means that unquoted values count too; a repeated key
    gives its lines once.  Only the lines found are shuffled.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = trigrams.index_of(tuple(_REQUIRED))
        for batch in it:
            paths, contents = (batch.column(i).to_pylist() for i in (1, 2))
            rows, lines = [], []
            for i, held in enumerate(index.candidate_chunks(contents)):
                found = sorted({line for line, _, _ in find(contents[i], paths[i], held) if line}) if held else []
                rows += [i] * len(found)
                lines += found
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(lines, pa.int64())], names=["key", "line_no"])

    kind = df.schema[key].dataType.simpleString()
    files = df.select(F.col(key).alias("key"), F.col(path).alias("path"), F.col(content).alias("content")).where("content is not null and key is not null")
    return spread(files).mapInArrow(batches, f"key {kind}, line_no long").distinct().withColumnRenamed("key", key)


def redacted(df: DataFrame, key: str, path: str, content: str) -> DataFrame:
    """``key`` and ``content`` of every row, credentials replaced by a mark.

    Rows without credentials, NULL and empty contents come out as they are.
    Nothing is shuffled.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = trigrams.index_of(tuple(_REQUIRED))
        for batch in it:
            paths, contents = (batch.column(i).to_pylist() for i in (1, 2))
            held = index.candidate_chunks([t or "" for t in contents])
            out = [redact(t, find(t, p, h)) if h else t for p, t, h in zip(paths, contents, held)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["key", "content"])

    kind = df.schema[key].dataType.simpleString()
    files = spread(df.select(F.col(key).alias("key"), F.col(path).alias("path"), F.col(content).alias("content")))
    return files.mapInArrow(batches, f"key {kind}, content string").select(F.col("key").alias(key), F.col("content").alias(content))
