"""P1 - credentials in source code, configuration and saved jobs.

Quoted strings and unquoted long tokens are the candidates.  Each is measured:
its alphabet, its Shannon entropy against a threshold that grows with its
length, and how often the character class changes.  A candidate is a secret
when its shape alone is that of a generated key, or when it stands where a
credential stands (a password-like name, an address, a login pair) and its
entropy reaches the lower threshold of a chosen password.  Hashes, identifiers,
labels, references and placeholders are excluded first.
:func:`branch_counts` reports how many places each rule decides.

Defined results: null or empty text has no secrets; a row delivered again under
one key gives the same places, counted once; masking keeps the length of the
text, its line breaks and everything outside the secret.
"""

from __future__ import annotations

import base64
import binascii
import json
import math
import re
from bisect import bisect_right
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sources import map_rows, spread

MIN_LENGTH = 6
#: share of the highest entropy a string of its length and alphabet can have
ENTROPY_SHARE = 0.74
#: the same for a password that was chosen, not generated, and stands under a credential's name
CHOSEN_SHARE = 0.6
#: the threshold of a chosen password does not grow beyond this length: people repeat
CHOSEN_LENGTH = 16
#: lower-case letters alone are a password from this length on
LETTERS_LENGTH = 10

# ------------------------------------------------------------------ measures
_SETS = (
    (re.compile(r"\d+"), 10),
    (re.compile(r"[0-9a-f]+|[0-9A-F]+"), 16),
    (re.compile(r"[a-z]+|[A-Z]+"), 26),
    (re.compile(r"[A-Z2-7]+"), 32),
    (re.compile(r"[a-z0-9]+|[A-Z0-9]+"), 36),
    (re.compile(r"[A-Za-z0-9]+"), 62),
    (re.compile(r"[A-Za-z0-9+/_=\-.]+"), 66),
)


def alphabet(value: str) -> int:
    for pattern, size in _SETS:
        if pattern.fullmatch(value):
            return size
    return 95


def entropy(value: str) -> float:
    """Shannon entropy in bits per character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def threshold(value: str, share: float = ENTROPY_SHARE) -> float:
    """The entropy a generated string of this length and alphabet reaches."""
    return share * min(math.log2(max(len(value), 2)), math.log2(alphabet(value)))


def changes(value: str) -> float:
    """How often lower, upper and digit follow one another, per character."""
    kinds = [0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in value]
    kinds = [k for k in kinds if k != 3]
    return sum(a != b for a, b in zip(kinds, kinds[1:])) / max(len(kinds) - 1, 1)


_HEX = re.compile(r"(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_JWT = re.compile(r"ey[A-Za-z0-9_\-]{8,}\.ey[A-Za-z0-9_\-]{6,}\.[A-Za-z0-9_\-]{10,}")
_PREFIXED = re.compile(r"[A-Za-z]{2,8}[_.\-](?:live[_\-]|test[_\-])?([A-Za-z0-9]{16,})")
_GROUPS = re.compile(r"[A-Z0-9]{4,6}(?:-[A-Z0-9]{4,6}){3,}")


def key_shaped(value: str, named: bool = False) -> bool:
    """Generated keys that are told by their shape: signed tokens, prefixed keys, key ids, grouped keys, long random letters.

    Where a name says that a key stands here, a key id may hold few digits.
    """
    n = len(value)
    if n < 16 or " " in value or _HEX.fullmatch(value) or _UUID.fullmatch(value):
        return False
    if _JWT.fullmatch(value):
        return True
    m = _PREFIXED.fullmatch(value)
    if m:
        tail = m.group(1)
        return not _HEX.fullmatch(tail) and changes(tail) >= 0.3 and entropy(tail) >= threshold(tail)
    if _GROUPS.fullmatch(value):
        flat = value.replace("-", "")
        return any(c.isdigit() for c in flat) and any(c.isalpha() for c in flat) and entropy(flat) >= threshold(flat)
    if re.fullmatch(r"[A-Z0-9]{16,40}", value):
        spread = changes(value) >= 0.2 and sum(c.isdigit() for c in value) >= 2
        odd = named and (any(c.isdigit() for c in value) or re.search(r"[B-DF-HJ-NP-TV-XZ]{3,}", value))
        return bool(spread or odd or unpronounceable(value)) and entropy(value) >= threshold(value)
    if n >= 32 and re.fullmatch(r"[a-z]+", value):
        return unpronounceable(value) and entropy(value) >= threshold(value)
    return False


def unpronounceable(value: str) -> bool:
    """Letters drawn at random: few vowels, or consonants in long runs."""
    letters = [c for c in value.lower() if c.isalpha()]
    vowels = sum(c in "aeiouy" for c in letters)
    runs = re.findall(r"[b-df-hj-np-tv-xz]{4,}", value.lower())
    return len(letters) >= 12 and (vowels < 0.27 * len(letters) and bool(runs) or len(runs) >= 2)


#: class changes per character from which a token without a name is drawn at random, not spelt
TOKEN_CHANGES = 0.4
_TOKEN_SIGNS = re.compile(r"[A-Za-z0-9+/_\-.]{16,}={0,2}")
#: how files, keys, classes and hashes start when they are written as base64
_ENCODED = re.compile(r"iVB|/9j/|R0lGOD|UEsDB|H4sI|d09G|AAEAAA|yv66v|rO0AB|JVBER|Qk0|PD94|PHN2|AAAAB3|MII[A-Za-z]|(?i:sha\d+|md5)[-_:]")


def random_token(value: str) -> bool:
    """A token that is measured only: mixed letters and digits, entropy over the threshold, and no word, path or encoded file."""
    if _TOKEN_SIGNS.fullmatch(value) is None or _HEX.fullmatch(value) or _UUID.fullmatch(value) or _ENCODED.match(value):
        return False
    core = value.rstrip("=")
    if sum(c.isdigit() for c in core) < 2 or core.islower() or core.isupper() or core.count(".") + core.count("/") + core.count("-") + core.count("_") > len(core) / 8:
        return False
    if sum(map(len, re.findall(r"[A-Z]?[a-z]{2,}", core))) >= 0.7 * len(core):  # words of an identifier
        return False
    return changes(core) >= TOKEN_CHANGES and entropy(core) >= threshold(core)


# What stands where a secret would stand without being one.
_PLACEHOLDER = re.compile(
    r"""(?ix) ^(?:
        [*x.•#?_\-\s]+ | n/?a | none | null | nil | undefined | true | false | todo | tbd | empty | default | dummy | sample | example
      | (?:your|my|the|some|enter|insert|put|add|ask|see|use|type)[\s_\-.].* | change[\s_\-]?(?:me|it|this).* | prompt(?:ed)? | redacted | masked | hidden | removed
      | <[^<>]*> | \[[^\[\]]*\] | \$\{?[^{}\s]*\}? | \$\{[^{}]*\} | \$\(.*\) | %[\w.]+% | %\{?[^{}]*+\}?\w* | @[\w.\-]+@ | \{\{.*\}\} | \#\{.*\} | __\w+__
      | enc\(.*\)? | \{(?:s?sha\d*|md5|bcrypt|crypt|pbkdf2|argon2\w*|cipher|enc|aes)\}.* | \$(?:2[abxy]|argon2\w*|1|5|6|pbkdf2\S*|apr1)\$.* | vault:.* | secretsmanager:.* | env[:.].* | arn:.* | file:.* | classpath:.*
      | ssh-(?:rsa|ed25519|dss)\s.* | -----BEGIN\ (?:RSA\ )?PUBLIC.*
      | (?:os\.|process\.)?env(?:iron)?\b.* | system\.getenv.* | getenv.*
    )$ """,
    re.S,
)
_CONSTANT = re.compile(r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+")
_DOTTED = re.compile(r"[A-Za-z_][a-z_]*(?:\.[a-z_A-Z]+)+")


def weak_secret(value: str) -> bool:
    """Passwords people choose: letters with digits, or several joined words."""
    v = value.strip()
    if len(v) < MIN_LENGTH or _PLACEHOLDER.match(v) or _CONSTANT.fullmatch(v) or _DOTTED.fullmatch(v):
        return False
    if any(c.isspace() for c in v) or "://" in v or re.fullmatch(r"[\w.+\-]+@[\w\-]+(?:\.[\w\-]+)+", v):
        return False
    if re.search(r"[(){}\[\]<>;]", v) or v.startswith(("/", "./", "../", "#")) and changes(v) < 0.3:
        return False
    letters, digits = any(c.isalpha() for c in v), any(c.isdigit() for c in v)
    if entropy(v) < min(threshold(v, CHOSEN_SHARE), CHOSEN_SHARE * math.log2(CHOSEN_LENGTH)):
        return False
    if letters and digits:
        return not re.fullmatch(r"v?\d++(?:\.\d++)+\w*|\d+(?:px|em|ms|s|kb|mb|gb|%)|[a-z]{1,3}\d{1,2}", v, re.I)
    if letters and len(re.findall(r"(?<![a-z])[a-z]{3,}[-_.](?=[a-z]{3})", v)) >= 3:
        return True
    if letters and re.search(r"[^\w.\-/:,]", v) and re.search(r"[a-z]", v) and re.search(r"[A-Z]", v) and v.isascii():
        return True
    if v.isalpha() and v.isascii() and len(v) >= 8 and not v.islower() and not v.isupper():
        if changes(v) >= 0.34 or re.search(r"[b-df-hj-np-tv-xz]{4,}", v.lower()):
            return True
    return key_shaped(v, True) or len(v) >= 20 and letters and changes(v) >= 0.3 and entropy(v) >= threshold(v)


def letters_only(value: str) -> bool:
    """A password of lower-case letters: long enough, not a few repeated, and no word for a credential."""
    return value.isascii() and value.isalpha() and value.islower() and len(value) >= LETTERS_LENGTH and entropy(value) >= threshold(value, CHOSEN_SHARE) and not any(w in value for w in _CREDENTIAL_WORDS)


# ------------------------------------------------------------------- context
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_PASSWORDS = frozenset("password passwd passwort pass pwd pw passphrase secret credential credentials pin kennwort".split())
_TOKENS = frozenset("token auth authorization apikey bearer".split())
_CREDENTIAL_WORDS = ("password", "passwort", "passphrase", "credential", "authoriz", "placeholder", "required", "kennwort", "secret", "token")
_HASHES = frozenset("digest checksum etag hash sha sha1 sha256 md5 commit uuid fingerprint crc revision sum integrity public".split())
_LABELS = frozenset("label labels title hint text placeholder caption field form length size min max dir path file name url header cookie".split())


def name_kind(name: str) -> int:
    """2 for a credential's name, 1 for the name of a key, -1 for a hash's, 0 otherwise."""
    words = [w.lower() for w in _WORDS.findall(name)]
    if not words:
        return 0
    if any(w in _HASHES for w in words):
        return -1
    last = words[-1]
    if last.isdigit() and len(words) > 1:
        last = words[-2]
    if last in _LABELS:
        return 0
    if last == "phrase" and words[-2:-1] in (["pass"], ["key"]):
        return 2
    if last in _PASSWORDS or last in _TOKENS:
        return 2
    if last == "key" and len(words) > 1:
        return 2 if words[-2] in ("api", "auth", "access", "secret", "salt", "private", "signing", "feed", "x") else 1
    if last in ("key", "license", "licence"):
        return 1
    if last in ("value", "id") and len(words) > 1 and words[-2] in _PASSWORDS:
        return 2
    return 0


def accepts(kind: int, value: str) -> bool:
    if kind < 0:
        return False
    if _PLACEHOLDER.match(value):
        return False
    if kind == 2:
        return weak_secret(value)
    if kind == 1:
        return key_shaped(value, True) or bool(_HEX.fullmatch(value)) or (
            len(value) >= 20 and " " not in value and "://" not in value and changes(value) >= 0.3 and entropy(value) >= threshold(value)
        )
    return key_shaped(value) or random_token(value)


_LITERAL = re.compile(r'"((?:[^"\\\n]|\\.)*)"|\'((?:[^\'\\\n]|\\.)*)\'')
#: what stands between two literals that the source joins
_JOIN = re.compile(r"[ \t\r\n\\]*\+[ \t\r\n\\]*")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_BODY = re.compile(r"[\s\"'+#*/;\\nr,>|-]*[A-Za-z0-9+/=]{16,}")
_URL_LOGIN = re.compile(r"://[^\s:/@\"'<>]*:")
_URL_LOGIN_END = re.compile(r"[\s@\"'<>]")
_NAMED = re.compile(r"(?<![\w.$\-])([\w.$\-]++)[\"'\]]*\s*(?:\)\s*)?(?:=>|:=|===?|!==?|[:=(,])\s*[urbfURBF]?\Z")
_ATTRIBUTE = re.compile(r"(?:name|key|id|property)\s*=\s*([\"'])([\w.\-]+)\1[^<>]*?\b(?:value|select|content|default)\s*=\s*\Z")
_TERNARY = re.compile(r"(?<![\w.$])([\w.$]++)\s*=\s*[^;={}]*\?[^;{}]*:\s*\Z")
_CONNECT = re.compile(r"\b(?:getConnection|connect|login|authenticate)\s*\(\s*[^;()]*,\s*\Z")
_PAIR = re.compile(r"[\"'][^\"'\s@]+@[^\"'\s@]+\.[^\"'\s@]+[\"']\s*,\s*\Z")
_AFTER_EQUALS = re.compile(r"\s*\.equals(?:IgnoreCase)?\s*\(\s*([\w.]+)|\s*[!=]==?\s*([\w.]+)")
_BEFORE_EQUALS = re.compile(r"(?<!\w)(\w++)\s*(?:\(\s*\))?\s*\.\s*equals(?:IgnoreCase)?\s*\(\s*\Z")
_DECODE = re.compile(r"(?:[dD]ecode(?:Base64|String|Buffer)?|atob|b64decode|from_base64)\s*\(\s*[urbf]?\Z")
_SHELL_P = re.compile(r"(?:(?:^|\s)(?:-p|--password[= ]|-u\s*[\w.\-]+:)|\b(?i:identified\s+by|password)\s+)\Z")
_SHELL = re.compile(r"(?<!\S)(?:-u[ \t]*[\w.\-]+:|--(?:[\w\-]*password|passwd|token|api-key|secret)[= ])([^\s\"'<>|;&]+)")
_SCHEME = re.compile(r"(?:Bearer|Token|Basic|ApiKey|Key|Digest)\s+(\S+)\Z", re.I)
# unquoted forms
_CONFIG = re.compile(
    r"(?m)^[ \t]*+(?:[#;!]|//|--|/\*|<!--|\*)?[ \t]*+(?:export[ \t]+|set[ \t]+|-[ \t]+)?([A-Za-z][\w.\-]*)[ \t]*[:=][ \t]*(\\\r?\n[ \t]*)?([^\s\"'<>(){},;]+)[ \t]*(?:-->|\*/)?[ \t]*\r?$"
)
_INLINE = re.compile(r"(?<![\w.\-])([A-Za-z][\w.\-]*)(=|:[ \t])([^\s\"'<>(){},;&=]+)")
_ELEMENT = re.compile(r"<([\w:.\-]+)((?:\s+[\w:.\-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*)\s*>([^<>\s]+)</\1\s*>")
_ATTR_NAME = re.compile(r"(?:name|key|id)\s*=\s*[\"']([\w.\-]+)[\"']")
_SLASH_PAIR = re.compile(r"(?<![\w./])((?:[\w.+\-]+@[\w\-]+(?:\.[\w\-]+)+)|[\w.\-]+) / (\S+?)(?=\s*(?:\*/|-->|$|[\"';]))", re.M)
_PAREN_PAIR = re.compile(r"@[\w\-]+(?:\.[\w\-]+)+ \(([^\s()]+)\)")
_PW_WORD = re.compile(r"(?i)(?<![\w.])(?:pw|pwd|passwd|password|passwort|kennwort)[ \t]+(?:([\w.+\-]+(?:@[\w.\-]+)?)[ \t]*:[ \t]*)?([^\s\"'<>,;]+)")
#: unquoted tokens; an address, a path or a reference goes on before or behind them
_LONG_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_\-.%@$#&\\])(?=[^\s=]{16})[A-Za-z0-9][A-Za-z0-9+/_\-.]{15,}+={0,2}(?![\w@(%$:\[{])")
_BLOCK = re.compile(r"(?:[ \t]*(?:#|//|\*|;)?[ \t]*[A-Za-z0-9+/]{40,}={0,2}[ \t]*\r?\n){2,}(?:[ \t]*(?:#|//|\*|;)?[ \t]*[A-Za-z0-9+/]+={0,2})?")
_HASHED = re.compile(r"(?i)(?:\b(?:sha\d*|md5|ssh-\w+)[-_: ]+|base64,\s*|\benc\()\Z")
_PEM_BLOCK = re.compile(r"-----BEGIN [A-Z0-9 ]+-----.*?(?:-----END|\Z)", re.S)
#: words of lines on which an unquoted credential can stand; some only where the characters from the one before on have a shape
_KEYWORDS = (
    *((w, None) for w in ("pass", "pwd", "secret", "token", "credential", "auth", "license", "licence", "kennwort")),
    ("pw", re.compile(r"(?:^|\W|(?<!.)(?=p))pw\b", re.S)),
    ("key", re.compile(r"[\w.\-]key[ \t]*[:=]")),
    ("pin", re.compile(r"(?:^|\W|(?<!.)(?=p))pin[ \t]*[:=]", re.S)),
)
_COMMENT_LINE = re.compile(r"^\s*(?:#|//|/\*|\*|<!--|--|;)|/\*|//\s|<!--|\s#\s")
_UNQUOTED_EXTS = frozenset("properties yml yaml sh conf cfg ini env txt sql opml xml xsl json css toml".split())


def _decoded_login(value: str) -> bool:
    """Base64 of ``user:password`` or of a usable secret."""
    if len(value) < 8 or not re.fullmatch(r"[A-Za-z0-9+/_\-]+={0,2}", value):
        return False
    try:
        raw = base64.b64decode(value.replace("-", "+").replace("_", "/") + "=" * (-len(value) % 4), validate=True)
        text = raw.decode("ascii")
    except (binascii.Error, ValueError, UnicodeDecodeError):
        return False
    if not text.isprintable():
        return False
    user, colon, word = text.partition(":")
    return weak_secret(word) if colon else weak_secret(text)


def find(text: str, ext: str = "") -> list[tuple[int, int]]:
    """Spans of the secret values in ``text``, in order and not overlapping."""
    return [(a, b) for a, b, _ in decided(text, ext)]


def _named(value: str) -> str:
    return "named, generated" if entropy(value) >= threshold(value) else "named, chosen"


def decided(text: str, ext: str = "") -> list[tuple[int, int, str]]:
    """The spans of :func:`find`, each with the rule that decides it."""
    spans: list[tuple[int, int, str]] = []
    if len(text) < MIN_LENGTH:
        return spans
    if "PRIVATE KEY" in text:
        for m in _PEM.finditer(text):
            if _PEM_BODY.match(text, m.end()):
                e = _PEM_END.search(text, m.end())
                nxt = _PEM.search(text, m.end())
                if e and (nxt is None or e.start() < nxt.start()):
                    spans.append((m.start(), e.end(), "private key"))
                else:  # cut off: to the end of its last line of key material
                    end = m.end()
                    while (b := _PEM_BODY.match(text, end)) is not None:
                        end = b.end()
                    spans.append((m.start(), end, "private key"))
    if "://" in text:
        at = 0
        while (m := _URL_LOGIN.search(text, at)) is not None and (e := _URL_LOGIN_END.search(text, m.end())) is not None:
            at, word = e.start(), text[m.end() : e.start()]
            if e.group() == "@" and len(word) >= 4 and re.match(r"[\w\[$%{]", text[e.end() : e.end() + 1]):
                if not _PLACEHOLDER.match(word) and not re.match(r"[$%{<*@]", word):
                    spans.append((m.end(), e.start(), "address"))
    # quoted literals, joined where the source joins them
    last: list[tuple[int, int]] = []
    spaced: list[tuple[int, int]] = []
    lit_end = -1
    literals: list[list[tuple[int, int]]] = []
    contexts: list[int] = []  # where the context of each literal starts: at the third literal before it
    starts = [0, 0, 0, 0]
    for m in _LITERAL.finditer(text):
        span = m.span(1) if m.group(1) is not None else m.span(2)
        if last and (j := _JOIN.match(text, lit_end)) is not None and j.end() == m.start():
            last.append(span)
        else:
            last = [span]
            literals.append(last)
            contexts.append(starts[0])
            starts = [*starts[1:], m.start()]
        lit_end = m.end()
    for pieces, context in zip(literals, contexts):
        begin, end = pieces[0][0], pieces[-1][1]
        value = text[begin:end] if len(pieces) == 1 else "".join(text[a:b] for a, b in pieces)
        if len(value) < MIN_LENGTH:
            continue
        inner = value
        if value[0] in "'\"" and value[-1] == value[0] and len(value) > 2:
            inner = value[1:-1]
            begin, end = begin + 1, end - 1
        if " " in inner:
            s = _SCHEME.match(inner)
            if s is None:
                spaced.append((begin, end))
                continue
            scheme, word = inner.split(None, 1)
            before = _statement(text, context, begin - 1)
            ok = _decoded_login(word) if scheme.lower() == "basic" else not _PLACEHOLDER.match(word) and weak_secret(word)
            if ok and len(pieces) == 1 and re.search(r"(?i)auth|token|header|key", before):
                spans.append((begin + len(inner) - len(word), end, "header"))
            continue
        if "://" in inner or inner.startswith("-----"):
            continue
        plain = False
        if not any(c.isdigit() for c in inner) and len(inner) < 24 and not re.search(r"[a-z][-_.][a-z]+[-_.][a-z]+[-_.]|[^\w.\-/: ,]|[a-z][A-Z]|[A-Z]{2}", inner):
            plain = letters_only(inner)
            if not plain:
                continue
        opening = begin - (2 if inner is not value else 1)
        before = _statement(text, context, opening)
        kind = 0
        m = _NAMED.search(before)
        if m is not None:
            kind = name_kind(m.group(1))
            if kind == 0 and (a := _ATTRIBUTE.search(before)) is not None:
                kind = name_kind(a.group(2))
        if kind == 0:
            if (t := _TERNARY.search(before)) is not None:
                kind = name_kind(t.group(1)) or (2 if re.search(r"(?i)getenv|environ|getProperty", t.group(0)) else 0)
            elif _PAIR.search(before) or _CONNECT.search(before) and before.count('"') + before.count("'") >= 2:
                kind = 2
            elif (e := _BEFORE_EQUALS.search(before)) is not None:
                kind = name_kind(e.group(1))
            elif _SHELL_P.search(before):
                kind = 2
        if kind == 0 and (e := _AFTER_EQUALS.match(text, end + 1)) is not None:
            kind = name_kind(e.group(1) or e.group(2))
        if kind == 0 and _DECODE.search(before):
            if _decoded_login(inner):
                spans.append((begin, end, "encoded"))
            continue
        if plain:
            if kind == 2 and len(pieces) == 1:
                spans.append((begin, end, "named, letters"))
            continue
        # strings joined to others are encoded data, also where a conflict marker parts them
        if accepts(kind, inner) and (kind or len(pieces) == 1 and not before.rstrip().endswith("+") or key_shaped(inner)):
            spans.append((begin, end, _named(inner) if kind else "shape" if key_shaped(inner) else "entropy"))
    # unquoted values
    if "=" in text or ":" in text or ">" in text or " / " in text or "@" in text:
        if ext not in ("java", "js", "py"):
            for m in _ELEMENT.finditer(text):
                names = [m.group(1), *_ATTR_NAME.findall(m.group(2))]
                kind = max(name_kind(n) for n in names)
                if accepts(kind, m.group(3)):
                    spans.append((*m.span(3), _named(m.group(3)) if kind else "entropy"))
        elif "</" in text:
            for m in _ELEMENT.finditer(text):
                if m.group(1) in _PASSWORDS and accepts(2, m.group(3)):
                    spans.append((*m.span(3), _named(m.group(3))))
        for start in _keyword_lines(text):
            stop = text.find("\n", start)
            stop = len(text) if stop < 0 else stop
            if text[stop - 1 : stop] == "\\" or text[stop - 2 : stop] == "\\\r":  # the value continues on the next line
                stop = text.find("\n", stop + 1)
                stop = len(text) if stop < 0 else stop
            spans += [(start + a, start + b, _named(text[start + a : start + b])) for a, b in _unquoted(text[start:stop], ext)]
        at = text.find(" / ")
        while at >= 0:
            start = text.rfind("\n", 0, at) + 1
            stop = text.find("\n", at)
            stop = len(text) if stop < 0 else stop
            for m in _SLASH_PAIR.finditer(text, start, stop):
                if weak_secret(m.group(2)):
                    user = m.group(1)
                    if "@" in user or re.search(r"(?i)\b(?:login|mailbox|account|user|pw|password|credentials?)\b[^/]*$", text[start : m.start()]):
                        spans.append((*m.span(2), "login"))
            at = text.find(" / ", stop)
        if " (" in text and "@" in text:
            spans += [(*m.span(1), "login") for m in _PAREN_PAIR.finditer(text) if weak_secret(m.group(1))]
        if " -" in text:
            spans += [(*m.span(1), "login") for m in _SHELL.finditer(text) if weak_secret(m.group(1))]
    spans += _long_tokens(text, ext, spaced)
    if not spans:
        return spans
    spans.sort(key=lambda s: (s[0], -s[1]))
    out = [spans[0]]
    for s in spans[1:]:
        if s[0] >= out[-1][1]:
            out.append(s)
    return out


def _keyword_lines(text: str) -> list[int]:
    """Where the lines on which an unquoted credential can stand begin: plain searches in the lower-case text."""
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case has another length would shift the places
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    starts = set()
    for word, shape in _KEYWORDS:
        at = low.find(word)
        while at >= 0:
            if shape is None or shape.match(low, max(at - 1, 0)) is not None:
                starts.add(low.rfind("\n", 0, at) + 1)
                at = low.find("\n", at)
                if at < 0:
                    break
            at = low.find(word, at + 1)
    return sorted(starts)


def _statement(text: str, start: int, end: int) -> str:
    """The text before ``end`` back to ``start``, or to the last sign that ends a statement or opens a block."""
    return text[max(start, *(text.rfind(c, start, end) + 1 for c in ";{}")) : end]


def _unquoted(line: str, ext: str) -> list[tuple[int, int]]:
    """Spans of unquoted values on one line (with its continuation) that names a credential."""
    out = []
    for m in _CONFIG.finditer(line):
        kind = name_kind(m.group(1))
        if (kind or m.group(2)) and not (ext == "py" and not m.group(0).lstrip().startswith("#")) and accepts(kind, m.group(3)):
            out.append(m.span(3))
    commented = _Commented(line, ext)
    for m in _PW_WORD.finditer(line):
        if weak_secret(m.group(2)) and commented(m.start()):
            out.append(m.span(2))
    for m in _INLINE.finditer(line):
        if name_kind(m.group(1)) == 2 and accepts(2, m.group(3)) and commented(m.start()):
            out.append(m.span(3))
    return out


def _line_before(text: str, at: int) -> str:
    """The last three blank-separated parts of the line before ``at``."""
    start = at
    for _ in range(3):
        start = max(text.rfind(" ", 0, start), 0)
    return text[max(start, text.rfind("\n", start, at) + 1) : at]


def _long_tokens(text: str, ext: str, spaced: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """Spans of unquoted tokens whose shape or entropy alone makes them keys; in code only in comments and in ``spaced`` literals."""
    out = []
    commented = _Commented(text, ext)
    lines_end = -1
    blocks = [m.span() for m in _PEM_BLOCK.finditer(text)] if "-----BEGIN" in text else []
    for m in _LONG_TOKEN.finditer(text):
        a, value = m.start(), m.group().rstrip(".-_/")
        if not (key_shaped(value) or random_token(value)) or _PLACEHOLDER.match(value):
            continue
        before = _line_before(text, a)
        if "://" in before.rpartition(" ")[2] or _HASHED.search(before):
            continue
        n = _NAMED.search(before.rstrip("\"'"))
        if n is not None and name_kind(n.group(1)) < 0:
            continue
        if not commented(a) and not ((k := bisect_right(spaced, (a, len(text)))) and spaced[k - 1][1] >= a + len(value)):
            continue
        # lines of nothing but base64 are a block of encoded data
        if a >= lines_end and (b := _BLOCK.match(text, text.rfind("\n", 0, a) + 1)) is not None:
            lines_end = b.end()
        if a < lines_end or any(b <= a < e for b, e in blocks):
            continue
        out.append((a, a + len(value), "shape" if key_shaped(value) else "entropy"))
    return out


class _Commented:
    """Tells whether unquoted text can hold a credential: anywhere in configuration, behind a comment sign of its line in code."""

    def __init__(self, text: str, ext: str):
        self.text, self.free = text, ext in _UNQUOTED_EXTS or not ext
        self.start, self.sign = -1, -1

    def __call__(self, at: int) -> bool:
        if self.free:
            return True
        start = self.text.rfind("\n", 0, at) + 1
        if start != self.start:  # the sign is looked for once a line
            stop = self.text.find("\n", at)
            m = _COMMENT_LINE.search(self.text[start : stop if stop >= 0 else len(self.text)])
            self.start, self.sign = start, start + m.end() if m else len(self.text) + 1
        return self.sign <= at


def password_span(value: str) -> tuple[int, int] | None:
    """The secret in a password field: the field itself, or the password of a login kept in it."""
    v = value.strip()
    if not v or _PLACEHOLDER.match(v):
        return _json_password(value)
    m = re.fullmatch(r"(?:login\s+)?\S+ / (\S+)", v)
    at = value.index(v)
    if m:
        return (at + m.start(1), at + m.end(1)) if weak_secret(m.group(1)) else None
    found = _json_password(value)
    if found:
        return found
    m = re.fullmatch(r"[A-Za-z][\w.\-]*:(\S+)", v)
    if m and weak_secret(m.group(1)):
        return at + m.start(1), at + m.end(1)
    if any(c.isspace() for c in v):
        spans = find(value)
        return spans[0] if spans else None
    return (at, at + len(v)) if weak_secret(v) or _decoded_login(v) else None


def _json_password(value: str) -> tuple[int, int] | None:
    if value.lstrip()[:1] != "{" or ":" not in value:
        return None
    try:
        fields = json.loads(value)
    except ValueError:
        return None
    if isinstance(fields, dict):
        for k, x in fields.items():
            if isinstance(x, str) and name_kind(k) == 2 and weak_secret(x):
                at = value.find(x)
                return (at, at + len(x)) if at >= 0 else (0, len(value))
    return None


_JOINT = r"[\"'][ \t\r\n\\]*(?:\+[ \t\r\n\\]*)?[\"']"


def mask(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` with every character of the spans replaced by ``x``.

    The letter keeps all formats readable (a star is an alias in YAML and a
    pattern in a shell).  A value over several lines or literals keeps its line
    breaks, the comment signs its lines start with, the joints of its literals
    and its escapes.
    """
    if not spans:
        return text
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        value = text[a:b]
        if "\n" in value or '"' in value or "'" in value or "\\" in value:
            lead = re.match(r"[ \t]*(#+|//+|\*|;|--|>)?", text[text.rfind("\n", 0, a) + 1 : a])
            sign = re.escape(lead.group(1)) if lead and lead.group(1) else ""
            keep = rf"\r?\n[ \t]*(?:{sign}[ \t]+)?|" if sign else r"\r?\n[ \t]*|"
            value = re.sub(rf"({keep}{_JOINT}|\\.|\s)|(.)", lambda m: m.group(1) or "x", value, flags=re.S)
        else:
            value = "x" * (b - a)
        out.append(value)
        at = b
    out.append(text[at:])
    return "".join(out)


# ----------------------------------------------------------------- operators
def content_secrets(files: DataFrame) -> DataFrame:
    """(row_id, line_no) of every secret in ``source_file.content``."""

    def scan(cols: dict) -> dict:
        ids, lines = [], []
        for file_id, ext, text in zip(cols["file_id"], cols["ext"], cols["content"]):
            for a, _ in find(text, ext):
                ids.append(file_id)
                lines.append(text.count("\n", 0, a) + 1)
        return {"row_id": ids, "line_no": lines}

    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9_]+)$", 1))
    src = files.where(F.length("content") >= MIN_LENGTH).select("file_id", ext.alias("ext"), "content")
    return map_rows(spread(src, "file_id"), scan, "row_id bigint, line_no bigint")


def job_secrets(jobs: DataFrame) -> DataFrame:
    """(field, row_id, line_no) of secrets in ``batch_job.email`` and ``batch_job.password``."""

    def scan(cols: dict) -> dict:
        fields, ids = [], []
        for job, email, password in zip(cols["job_id"], cols["email"], cols["password"]):
            if email and find(email):
                fields.append("email")
                ids.append(job)
            if password and password_span(password):
                fields.append("password")
                ids.append(job)
        return {"field": fields, "row_id": ids, "line_no": [1] * len(ids)}

    src = jobs.select("job_id", "email", "password")
    return map_rows(src, scan, "field string, row_id bigint, line_no bigint")


def secrets_found(files: DataFrame, jobs: DataFrame) -> DataFrame:
    """Distinct (field, row_id, line_no)."""
    code = content_secrets(files).select(F.lit("content").alias("field"), "row_id", "line_no")
    return code.unionByName(job_secrets(jobs)).distinct()


def redacted_files(files: DataFrame) -> DataFrame:
    """(file_id, n_secrets, content): files that held secrets, with the secrets masked."""

    def scan(cols: dict) -> dict:
        out: dict[str, list] = {"file_id": [], "n_secrets": [], "content": []}
        for file_id, ext, text in zip(cols["file_id"], cols["ext"], cols["content"]):
            spans = find(text, ext)
            if spans:
                out["file_id"].append(file_id)
                out["n_secrets"].append(len(spans))
                out["content"].append(mask(text, spans))
        return out

    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9_]+)$", 1))
    src = files.where(F.length("content") >= MIN_LENGTH).select("file_id", ext.alias("ext"), "content")
    return map_rows(spread(src, "file_id"), scan, "file_id bigint, n_secrets int, content string").distinct()


def redacted_jobs(jobs: DataFrame) -> DataFrame:
    """(job_id, email, password) of the jobs that held secrets, with the secrets masked."""

    def scan(cols: dict) -> dict:
        out: dict[str, list] = {"job_id": [], "email": [], "password": []}
        for job, email, password in zip(cols["job_id"], cols["email"], cols["password"]):
            spans = find(email) if email else []
            span = password_span(password) if password else None
            if spans or span:
                out["job_id"].append(job)
                out["email"].append(mask(email, spans) if spans else email)
                out["password"].append(mask(password, [span]) if span else password)
        return out

    return map_rows(jobs.select("job_id", "email", "password"), scan, "job_id bigint, email string, password string").distinct()


def branch_counts(files: DataFrame) -> DataFrame:
    """(rule, places): how many distinct places in contents each rule decides."""

    def scan(cols: dict) -> dict:
        out: dict[str, list] = {"row_id": [], "start": [], "rule": []}
        for file_id, ext, text in zip(cols["file_id"], cols["ext"], cols["content"]):
            for a, _, rule in decided(text, ext):
                out["row_id"].append(file_id)
                out["start"].append(a)
                out["rule"].append(rule)
        return out

    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9_]+)$", 1))
    src = files.where(F.length("content") >= MIN_LENGTH).select("file_id", ext.alias("ext"), "content")
    places = map_rows(spread(src, "file_id"), scan, "row_id bigint, start bigint, rule string").distinct()
    return places.groupBy("rule").agg(F.count("*").alias("places"))
