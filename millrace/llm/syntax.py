"""Syntax validation by lexing to token classes and reducing productions.

A file is lexed with one compiled pattern into a string holding one character
per token.  Two things are derived from that string:

* ``pair_codes`` - the distinct adjacent token-class pairs, which the
  DataFrame operator anti-joins against :data:`PERMISSIBLE_PAIRS`;
* ``reduces`` - bottom-up reduction of bracketed regions.  The innermost
  region is matched against the productions it could be (arguments,
  parameters, block, class body, array initialiser, ...) and replaced by one
  symbol that remembers the *set* of productions that matched, so one level of
  nesting is always a regular language and no recursion is needed.  Verdicts
  are memoised by region, bounded by :data:`MEMO_LIMIT`.

Python, JSON and XML have exact parsers in the standard library; they are used
as the production check for those languages.
"""

from __future__ import annotations

import ast
import json
import re
import tokenize
import warnings
from xml.parsers import expat

MEMO_LIMIT = 200_000
_LONG = 4_000


class _Classes(dict):
    """token text -> class characters, computed once per distinct token."""

    def __init__(self, classify):
        super().__init__()
        self._classify = classify

    def __missing__(self, token):
        if len(self) > MEMO_LIMIT:
            self.clear()
        value = self._classify(token)
        if len(token) < 80:
            self[token] = value
        return value


#: levels of nesting that are reduced in passes over the text; deeper regions are reduced as their brackets close
MAX_DEPTH = 30
_PIECE = re.compile(r"[^()\[\]{}]+|[()\[\]{}]")
_CLOSER = {"(": ")", "[": "]", "{": "}"}


def closed(s: str, region) -> str:
    """``s`` with each bracketed region replaced by ``region(bracket, content)`` when its bracket closes; ``!`` where one fails."""
    stack: list[tuple[str, list[str]]] = []
    parts: list[str] = []
    for piece in _PIECE.findall(s):
        if piece in "([{":
            stack.append((piece, parts))
            parts = []
        elif piece in ")]}":
            if not stack or _CLOSER[stack[-1][0]] != piece:
                return "!"
            inner = "".join(parts)
            bracket, parts = stack.pop()
            symbol = region(bracket, inner)
            if symbol == "!":
                return "!"
            parts.append(symbol)
        else:
            parts.append(piece)
    return "!" if stack else "".join(parts)


# --------------------------------------------------------------------- Java
JAVA_TOKEN = re.compile(
    r'//[^\r\n]*|/\*.*?(?:\*/|\Z)|"""[ \t\f]*\r?\n(?:[^\\]|\\.)*?"""|"(?:[^"\\\r\n]|\\.)*"'
    r"|'(?:[^'\\\r\n]|\\(?:u+[0-9a-fA-F]{4}|[0-7]{1,3}|.))'"
    r"|0[xX][0-9a-fA-F_.]+(?:[pP][+-]?\d+)?[lLfFdD]?|0[bB][01_]+[lL]?"
    r"|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[lLfFdD]?"
    r"|(?:[^\W\d]|\$|\\u+[0-9a-fA-F]{4})(?:[\w$]|\\u+[0-9a-fA-F]{4})*"
    r"|>>>=|>>=|<<=|->|::|\.\.\.|\+\+|--|&&|\|\||[=!<>+\-*/&|^%]=|<<|\S",
    re.S,
)
_JAVA_WORDS = {}
for _cls, _words in {
    "l": "true false null",
    "t": "this super",
    "p": "int long byte short char boolean float double",
    "v": "void",
    "c": "class interface",
    "e": "enum",
    "R": "record",
    "m": "public private protected static final abstract native transient volatile strictfp",
    "s": "synchronized",
    "D": "default",
    "q": "sealed",
    "x": "extends implements",
    "Q": "permits",
    "w": "throws",
    "T": "throw",
    "r": "return",
    "Y": "yield",
    "b": "break continue",
    "a": "assert",
    "I": "if",
    "E": "else",
    "F": "for",
    "W": "while",
    "O": "do",
    "S": "switch",
    "K": "case",
    "y": "try",
    "C": "catch",
    "f": "finally",
    "N": "new",
    "o": "instanceof",
    "M": "import package",
    "!": "goto const",
}.items():
    _JAVA_WORDS.update(dict.fromkeys(_words.split(), _cls))
_JAVA_OPS = dict(zip("()[]{};,.?:@=<>&|*", "()[]{};,.?:@=<>&|*"))
_JAVA_OPS |= {"+": "+", "-": "+", "!": "~", "~": "~", "++": "u", "--": "u", "->": "-", "::": '"', "...": "_"}
_JAVA_OPS |= dict.fromkeys("/ % ^ && || == != <= >= <<".split(), "B")
_JAVA_OPS |= dict.fromkeys("+= -= *= /= &= |= ^= %= <<= >>= >>>=".split(), "=")


def _java_class(token):
    if token in _JAVA_OPS:
        return _JAVA_OPS[token]
    if token in _JAVA_WORDS:
        return _JAVA_WORDS[token]
    head = token[0]
    if head == "/" and token[1:2] in ("/", "*"):
        return "" if token[1] == "/" or token.endswith("*/") and len(token) > 3 else "!"
    if len(token) > 1 and head in "\"'" or head.isdigit() or head == "." and token[1:2].isdigit():
        return "l"
    if head == "_" or head == "$" or head == "\\" and len(token) > 1 or head.isalpha():
        return "i"
    return "!"


_JAVA_CLASSES = _Classes(_java_class)


def java_classes(text: str) -> str:
    return "".join(map(_JAVA_CLASSES.__getitem__, JAVA_TOKEN.findall(text)))


def _mask_class(base: int, size: int, bit: int) -> str:
    return "[" + "".join(chr(base + m) for m in range(size) if m & bit) + "]"


_PAREN, _BRACE = 0xE000, 0xE100
_ARGS, _PARAMS, _FORH, _CAST, _LAMBDA, _RES = 1, 2, 4, 8, 16, 32
_BLOCK, _CLASSB, _INIT, _ENUMB, _SWITCHB = 1, 2, 4, 8, 16


def _java_grammar():
    A, P, H, T, L, Z = (_mask_class(_PAREN, 64, b) for b in (_ARGS, _PARAMS, _FORH, _CAST, _LAMBDA, _RES))
    B, C, I, N, S = (_mask_class(_BRACE, 32, b) for b in (_BLOCK, _CLASSB, _INIT, _ENUMB, _SWITCHB))
    ident = "[iRYqQ]"
    name = rf"{ident}G?(?:\.{ident}G?)*"
    typ = rf"(?:p|{name})d*"
    mod = "[msDq]"
    new = rf"NG?(?:p|{name})(?:{A}{C}?|X+d*|d+{I})"
    prefix = rf"(?:[+~u]|{T}|(?:{ident}|{L}|{P})-)*"
    primary = rf"(?:{new}|S{A}{S}|(?:p|v|{name})d*\.c|(?:p|{name})d*(?=\")|l|t|{ident}|{A}|(?<=-){B}|(?<==){I})"
    postfix = rf"(?:\.G?{ident}|\.G?t|\.{new}|{A}|X|u|\"G?(?:{ident}|N))*"
    unary = rf"{prefix}{primary}{postfix}(?:om*{typ}{ident}?)?"
    expr = rf"{unary}(?:(?:[+*&|B<=?:]|>{{1,3}}){unary})*"
    exprs = rf"(?:{expr})(?:,(?:{expr}))*"
    var = rf"{ident}d*(?:=(?:{expr}))?"
    decl = rf"{mod}*{typ}{var}(?:,{var})*"
    types = rf"{typ}(?:,{typ})*"
    param = rf"{mod}*{typ}(?:\|{typ})*_?(?:{ident}(?:\.t)?d*|t)"
    cdecl = (
        rf"{mod}*(?:c{ident}G?(?:[xQ]{types})*{C}|e{ident}(?:x{types})*{N}|R{ident}G?{P}(?:x{types})*{C})"
    )
    throws = rf"(?:w{types})?"
    lead = rf"(?:I{A}|E|F{H}|W{A}|O|s{A}|{ident}:)*"
    simple = (
        rf"(?:;|{B}|S{A}{S}|y{Z}?{B}(?:C{P}{B})*(?:f{B})?|r(?:{expr})?;|T(?:{expr});|b{ident}?;|Y(?:{expr});"
        rf"|a(?:{expr});|{cdecl}|{decl};|(?P<e>{expr});)"
    )
    rx = lambda p: re.compile(p)
    enum_const = rf"{ident}{A}?{C}?"
    member = (
        rf"(?:;|m?{B}|{cdecl}|{mod}*G?(?:v|{typ}){ident}{P}d*{throws}(?:;|{B}|D(?:{expr}|{I});)"
        rf"|{mod}*G?{ident}{P}?{throws}{B}|{decl};)"
    )
    return {
        "args": rx(rf"(?:{exprs})?"),
        "params": rx(rf"(?:{param}(?:,{param})*)?"),
        "forh": rx(rf"(?:{mod}*{typ}{ident}:(?:{expr})|(?:{decl}|{exprs})?;(?:{expr})?;(?:{exprs})?)"),
        "cast": rx(rf"{typ}(?:&{typ})*"),
        "lambda": rx(rf"(?:{ident}(?:,{ident})*)?"),
        "res": rx(rf"(?:{decl}|{name}|t\.{ident})(?:;(?:{decl}|{name}))*;?"),
        "index": rx(expr),
        "stmt": rx(lead + simple),
        "expr_stmt": rx(rf".*(?:=|u$|^u|{A}$|{C}$).*"),
        "init": rx(rf"(?:(?:{expr}|{I})(?:,(?:{expr}|{I}))*)?,?"),
        "member": rx(member),
        "enum": rx(rf"(?:{enum_const}(?:,{enum_const})*)?,?(?:;(?P<m>.*))?"),
        "label": rx(rf"(?:K(?:(?:{unary})(?:[+*&|B](?:{unary}))*)(?:,(?:(?:{unary})))*|D|K.?D)[:\-]"),
        "unit": rx(rf"(?:;|M(?:m)?{name}(?:\.\*)?;|{cdecl})*"),
        "generic": rx(
            rf"<(?:(?:\?(?:[xt]{typ})?|{typ}(?:[xt]{typ}(?:&{typ})*)?)(?:,(?:\?(?:[xt]{typ})?|{typ}(?:[xt]{typ}(?:&{typ})*)?))*)?>"
        ),
        "annotation": rx(rf"@{ident}(?:\.{ident})*[{chr(_PAREN)}-{chr(_PAREN + 63)}]?"),
    }


_J = _java_grammar()
_JMEMO: dict[tuple[str, str], int] = {}
_INNER_PAREN = re.compile(r"\(([^(){}\[\]]*)\)|\[([^(){}\[\]]*)\]|\{([^(){}\[\]]*)\}")


def _all(pattern, s: str, check=None) -> bool:
    pos, end = 0, len(s)
    while pos < end:
        m = pattern.match(s, pos)
        if m is None or m.end() == pos:
            return False
        if check is not None and not check(m):
            return False
        pos = m.end()
    return True


def _java_stmt_ok(m) -> bool:
    e = m.group("e")
    return e is None or (_J["expr_stmt"].match(e) is not None and e.count("?") == e.count(":"))


def _java_clean(s: str) -> str:
    return _J["annotation"].sub("", s.replace("@c", "c")) if "@" in s else s


def _java_paren(s: str) -> int:
    raw = s
    s = _java_clean(s)
    mask = 0
    if _J["args"].fullmatch(s) and s.count("?") == s.count(":"):
        mask |= _ARGS
    if _J["params"].fullmatch(s):
        mask |= _PARAMS
    if _J["forh"].fullmatch(s):
        mask |= _FORH
    if _J["cast"].fullmatch(s):
        mask |= _CAST
    if _J["lambda"].fullmatch(s):
        mask |= _LAMBDA
    if s and _J["res"].fullmatch(s):
        mask |= _RES
    if not mask and ("@" in raw or chr(_BRACE) <= max(s, default="") <= chr(_BRACE + 31)):
        # arguments of an annotation: values may be array initialisers or annotations
        t = "".join("l" if chr(_BRACE) <= c <= chr(_BRACE + 31) and (ord(c) - _BRACE) & _INIT else c for c in raw)
        t = _J["annotation"].sub("l", t)
        if _J["args"].fullmatch(t):
            mask |= _ARGS
    return mask


def _java_block(s: str) -> bool:
    return _all(_J["stmt"], s, _java_stmt_ok)


def _java_brace(s: str) -> int:
    raw, s = s, _java_clean(s)
    mask = 0
    if _java_block(s):
        mask |= _BLOCK
    if _all(_J["member"], s):
        mask |= _CLASSB
    if _J["init"].fullmatch(s) or "@" in raw and _J["init"].fullmatch(_J["annotation"].sub("l", raw)):
        mask |= _INIT
    m = _J["enum"].fullmatch(s)
    if m and _all(_J["member"], m.group("m") or ""):
        mask |= _ENUMB
    if not s or s[0] in "KD":
        body = _J["label"].sub(";", s)
        if _all(_J["stmt"], body):
            mask |= _SWITCHB
    return mask


def _java_region(m) -> str:
    paren, bracket, brace = m.groups()
    return _java_symbol(*(("[", bracket) if bracket is not None else ("(", paren) if paren is not None else ("{", brace)))


def _java_symbol(opener: str, inner: str) -> str:
    key = (opener, inner)
    hit = _JMEMO.get(key)
    if hit is None:
        s = key[1]
        if key[0] == "[":
            hit = 1 if _J["index"].fullmatch(s) and s.count("?") == s.count(":") else 0
        elif key[0] == "(":
            hit = _java_paren(s)
        else:
            hit = _java_brace(s)
        if len(s) < _LONG:
            if len(_JMEMO) > MEMO_LIMIT:
                _JMEMO.clear()
            _JMEMO[key] = hit
    if not hit:
        return "!"
    return "X" if key[0] == "[" else chr((_PAREN if key[0] == "(" else _BRACE) + hit)


def java_reduces(classes: str) -> bool:
    """True when the token classes reduce to a compilation unit."""
    if "!" in classes:
        return False
    s = classes.replace("[]", "d")
    if "<" in s:
        while True:
            t = _J["generic"].sub("G", s)
            if t == s:
                break
            s = t
    for _ in range(MAX_DEPTH):
        t = _INNER_PAREN.sub(_java_region, s)
        if "!" in t:
            return False
        if t == s:
            break
        s = t
    else:
        s = closed(s, _java_symbol)
        if "!" in s:
            return False
    return _J["unit"].fullmatch(_java_clean(s)) is not None


# --------------------------------------------------------------- JavaScript
JS_TOKEN = re.compile(
    r"//[^\r\n  ]*|/\*.*?(?:\*/|\Z)|\A#![^\n]*"
    r'|"(?:[^"\\\r\n]|\\.)*"|\'(?:[^\'\\\r\n]|\\.)*\'|`(?:[^`\\$]|\\.|\$(?!\{)|\$\{(?:[^{}`]|`[^`]*`|\{[^{}]*\})*\})*`'
    r"|(?:&&|\|\||\?\?|===?|!==?|=>|[=(,:;!&|?\[{}+\-*%<>~^\n]|\breturn|\btypeof)[ \t]*/(?![*/])(?:[^/\\\r\n\[]|\\.|\[(?:[^\]\\\r\n]|\\.)*\])+/\w*"
    r"|0[xX][0-9a-fA-F_]+n?|0[bB][01_]+n?|0[oO]?[0-7_]+n?(?![.\d])"
    r"|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?"
    r"|#?(?:[^\W\d]|\$|\\u[0-9a-fA-F]{4})(?:[\w$]|\\u[0-9a-fA-F]{4})*"
    r"|>>>=|\*\*=|&&=|\|\|=|\?\?=|===|!==|>>>|>>=|<<=|=>|\.\.\.|\?\.(?!\d)|\?\?|\*\*|\+\+|--|&&|\|\||[=!<>+\-*/&|^%]=|<<|>>|\n|\S",
    re.S,
)
_JS_WORDS = {}
for _cls, _words in {
    "l": "true false null",
    "c": "function",
    "C": "class",
    "x": "extends",
    "v": "var const",
    "r": "return",
    "T": "throw",
    "I": "if",
    "E": "else",
    "F": "for",
    "W": "while",
    "O": "do",
    "S": "switch",
    "K": "case",
    "D": "default",
    "b": "break continue",
    "y": "try",
    "k": "catch",
    "f": "finally",
    "N": "new",
    "~": "delete typeof void",
    "o": "in instanceof",
    "w": "with",
    "h": "debugger",
    "M": "import export enum",
    "L": "let",
    "A": "async",
    "P": "of",
    "g": "get set static",
    "Y": "yield await",
}.items():
    _JS_WORDS.update(dict.fromkeys(_words.split(), _cls))
_JS_OPS = dict(zip("()[]{};,.?:=*", "()[]{};,.?:=*"))
_JS_OPS |= {"+": "+", "-": "+", "!": "~", "~": "~", "++": "u", "--": "u", "=>": "-", "?.": "q", "...": "_", "\n": "\n"}
_JS_OPS |= dict.fromkeys("/ % ^ & | < > && || == != === !== <= >= << >> >>> ?? **".split(), "B")
_JS_OPS |= dict.fromkeys("+= -= *= /= &= |= ^= %= <<= >>= >>>= **= &&= ||= ??=".split(), "=")


def _js_class(token):
    if token in _JS_OPS:
        return _JS_OPS[token]
    if token in _JS_WORDS:
        return _JS_WORDS[token]
    head = token[0]
    if head == "/" and token[1:2] == "/" or token[:2] == "#!":
        return ""
    if token[:2] == "/*":
        if not token.endswith("*/") or len(token) < 4:
            return "!"
        return "\n" if "\n" in token else ""
    if len(token) > 1 and head in "\"'`" or head.isdigit() or head == "." and token[1:2].isdigit():
        return "l"
    if head == "_" or head == "$" or head == "\\" and len(token) > 1 or head.isalpha() or head == "#" and len(token) > 1:
        m = re.match(r"(return|typeof)[ \t]*/", token)
        return _JS_WORDS[m.group(1)] + "l" if m else "i"
    slash = token.find("/")
    if slash > 0:
        return _js_class(token[:slash].strip(" \t") or "\n") + "l"
    return "!"


_JS_CLASSES = _Classes(_js_class)
_JS_FUN, _JS_OBJ, _JS_BLK, _JS_CLS, _JS_SW = 1, 2, 4, 8, 16
_JS_ARG, _JS_PRM, _JS_FOR, _JS_EXP = 1, 2, 4, 8


def js_classes(text: str) -> str:
    s = "".join(map(_JS_CLASSES.__getitem__, JS_TOKEN.findall(text)))
    return re.sub(r"\n+", "\n", s.replace("M(", "i("))


def _js_grammar():
    A, P, H, E = (_mask_class(_PAREN, 16, b) for b in (_JS_ARG, _JS_PRM, _JS_FOR, _JS_EXP))
    O, B, C, S = (_mask_class(_BRACE, 32, b) for b in (_JS_OBJ, _JS_BLK, _JS_CLS, _JS_SW))
    ident = "[iLAPgY]"
    word = r"[iLAPgYlcCxvrTIEFWOSKDbykfN~owhM]"
    fun = rf"A?c\*?{ident}?{P}{B}"
    cls = rf"C{ident}?(?:x{ident}(?:\.{word}|{A})*)?{C}"
    prefix = rf"(?:[+~uNY]|A?(?:{ident}|{P})-)*"
    primary = rf"(?:{fun}|{cls}|l|{ident}|{E}|[dX]|{O}|(?<=-){B})"
    postfix = rf"(?:[.q]{word}|q?{A}|q?X|u|l(?!.))*"
    unary = rf"{prefix}{primary}{postfix}"
    expr = rf"{unary}(?:[+*Bo=?:]{unary})*"
    exprs = rf"_?{expr}(?:,_?{expr})*"
    target = rf"(?:{ident}|[Xd]|{O})"
    var = rf"{target}(?:=(?:{expr}))?"
    varlist = rf"[vL]{var}(?:,{var})*"
    params = rf"(?:_?{var}(?:,_?{var})*,?)?"
    lead = rf"(?:I{E}|E|FY?{H}|W{E}|O|w{E}|{ident}:)*"
    simple = (
        rf"(?:;|{B}|A?c\*?{ident}{P}{B}|C{ident}(?:x{ident}(?:\.{word}|{A})*)?{C}|S{E}{S}|y{B}(?:k{P}?{B})?(?:f{B})?"
        rf"|r(?:{exprs})?(?:;|$)|T(?:{exprs})(?:;|$)|b{ident}?(?:;|$)|h(?:;|$)|{varlist}(?:;|$)|(?P<e>{exprs})(?:;|$))"
    )
    key = rf"(?:{word}|X)"
    method = rf"(?:g|A)*\*?{key}{P}{B}"
    prop = rf"(?:{method}|{key}:(?:{expr})|{ident}(?:=(?:{expr}))?|_(?:{expr}))"
    rx = re.compile
    return {
        "args": rx(rf"(?:{exprs},?)?"),
        "exp": rx(exprs),
        "params": rx(params),
        "forh": rx(
            rf"(?:[vL]?{target}(?:\.{word}|X)*(?:=(?:{unary}))?[oP](?:{exprs})|{ident}(?:[.q]{word}|X|{A})*[oP](?:{exprs})|(?:{varlist}|{exprs})?;(?:{exprs})?;(?:{exprs})?)"
        ),
        "arr": rx(rf"(?:,*_?(?:{expr}))?(?:,+_?(?:{expr}))*,*"),
        "obj": rx(rf"(?:{prop}(?:,{prop})*)?,?"),
        "stmt": rx(lead + simple),
        "cls": rx(rf"(?:;|g*{method}|g*{key}(?:=(?:{expr}))?(?:;|$)|g{B})*"),
        "label": rx(rf"(?:K(?:{unary}(?:[+*Bo]{unary})*(?:,{unary})*)|D):"),
    }


_S = _js_grammar()
_SMEMO: dict[tuple[str, str], int] = {}
# a newline separates statements when the token before it can end one and the
# token after it cannot continue one
_ENDS = f"ilLAPgYuXdbrh{chr(_PAREN)}-{chr(_BRACE + 31)}"
_ASI = re.compile(rf"(?<=[{_ENDS}])\n(?=[ilLAPgYuNcCvrTIEFWOSbywh~])|(?<=[rb])\n")
_CLASS_ASI = re.compile(rf"(?<=[{_ENDS}])\n(?=[ilLAPgYcCvrTIEFWOSKDbykfN~owhM*X])")


def _js_balanced(e: str) -> bool:
    return e.count("?") == e.count(":")


def _js_stmts(s: str) -> bool:
    s = _ASI.sub(";", s)
    # a brace ends a function or object expression: a line break after it ends the statement
    s = re.sub(r"(?<=[-])\n(?=[ilLAPgYuNcvrTFWSbyw~])", ";", s) if "\n" in s else s
    s = s.replace("\n", "")
    pos, end = 0, len(s)
    while pos < end:
        m = _S["stmt"].match(s, pos)
        if m is None or m.end() == pos:
            return False
        e = m.group("e")
        if e and not _js_balanced(e):
            return False
        pos = m.end()
    return True


def _js_region(m) -> str:
    paren, bracket, brace = m.groups()
    return _js_symbol(*(("(", paren) if paren is not None else ("[", bracket) if bracket is not None else ("{", brace)))


def _js_symbol(opener: str, inner: str) -> str:
    key = (opener, inner)
    hit = _SMEMO.get(key)
    if hit is None:
        s = key[1]
        flat = s.replace("\n", "")
        hit = 0
        if key[0] == "(":
            ok = _js_balanced(flat)
            if ok and _S["args"].fullmatch(flat):
                hit |= _JS_ARG
            if ok and _S["exp"].fullmatch(flat):
                hit |= _JS_EXP
            if _S["params"].fullmatch(flat):
                hit |= _JS_PRM
            if _S["forh"].fullmatch(flat):
                hit |= _JS_FOR
        elif key[0] == "[":
            hit = 1 if _S["arr"].fullmatch(flat) else 0
        else:
            if _S["obj"].fullmatch(flat):
                hit |= _JS_OBJ
            if _js_stmts(s):
                hit |= _JS_BLK
            if _S["cls"].fullmatch(_CLASS_ASI.sub(";", s).replace("\n", "")):
                hit |= _JS_CLS
            t = s.lstrip("\n")
            if not t or t[0] in "KD":
                if _js_stmts(_S["label"].sub(";", t)):
                    hit |= _JS_SW
        if len(s) < _LONG:
            if len(_SMEMO) > MEMO_LIMIT:
                _SMEMO.clear()
            _SMEMO[key] = hit
    if not hit:
        return "!"
    return "X" if key[0] == "[" else chr((_PAREN if key[0] == "(" else _BRACE) + hit)


def js_reduces(classes: str) -> bool:
    """True when the token classes reduce to a script."""
    if "!" in classes:
        return False
    s = classes
    for _ in range(MAX_DEPTH):
        t = _INNER_PAREN.sub(_js_region, s)
        if "!" in t:
            return False
        if t == s:
            break
        s = t
    else:
        s = closed(s, _js_symbol)
        if "!" in s:
            return False
    if re.search(r"[(){}\[\]]", s):
        return False
    return _js_stmts(s.strip("\n"))


# --------------------------------------------------------------------- JSON
JSON_TOKEN = re.compile(
    r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|\btrue\b|\bfalse\b|\bnull\b|[^ \t\r\n]'
)


def json_classes(text: str) -> str:
    out = []
    for t in JSON_TOKEN.findall(text):
        h = t[0]
        out.append(
            h if t in "{}[]:," else "s" if h == '"' and len(t) > 1 else "l" if h in "-0123456789" or t in ("true", "false", "null") else "!"
        )
    return "".join(out)


_JSON_PAIR = re.compile(r"\{\}|\{(?:s:[slV])(?:,s:[slV])*\}|\[\]|\[[slV](?:,[slV])*\]")


def json_reduces(classes: str) -> bool:
    """Reduce ``{}`` and ``[]`` productions until one value is left."""
    s = classes
    for _ in range(MAX_DEPTH):
        t = _JSON_PAIR.sub("V", s)
        if t == s:
            break
        s = t
    else:
        s = closed(s, lambda b, x: "V" if _JSON_PAIR.fullmatch(f"{b}{x}{_CLOSER[b]}") else "!")
    return s in ("V", "s", "l")


# ------------------------------------------------------------- exact parsers
def python_parses(text: str) -> bool:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            compile(text, "<file>", "exec", ast.PyCF_ONLY_AST, dont_inherit=True)
            return True
        except (SyntaxError, ValueError):
            return False
        except (RecursionError, MemoryError):  # nesting beyond the parser's stack is not a syntax error: the rest decides
            try:
                compile(shallow(text), "<file>", "exec", ast.PyCF_ONLY_AST, dont_inherit=True)
                return True
            except (SyntaxError, ValueError):
                return False
            except (RecursionError, MemoryError):
                return True


#: characters from which a statement can be too deep for the parser
_DEEP_CHARS = 200


def shallow(text: str) -> str:
    """Python with ``pass``, or a header without parameters, for each statement that is too deep for the parser.

    Lines keep their numbers.  The statements replaced are judged by their tokens and brackets only; a text that
    can not be split into tokens raises SyntaxError.
    """
    lines = text.splitlines(keepends=True) if "\f" not in text else re.split(r"(?<=\n)", text)
    try:
        tokens = list(tokenize.generate_tokens(iter([*lines, ""]).__next__))
    except tokenize.TokenError as e:
        raise SyntaxError(str(e)) from None
    start = None
    for t in tokens:
        if start is None and t.type not in (tokenize.NL, tokenize.COMMENT, tokenize.INDENT, tokenize.DEDENT, tokenize.NEWLINE):
            start = t.start
        if t.type != tokenize.NEWLINE or start is None:
            continue
        (a, col), b = start, t.start[0]
        start = None
        statement = "".join(lines[a - 1 : b])[col:]
        if len(statement) < _DEEP_CHARS:
            continue
        head = re.match(r"(?:async\s+)?(?:def\s+\w+|class\s+\w+|if|elif|while|for|with|else|try|finally|except|match|case)\b", statement)
        block = head is not None and re.search(r":\s*(?:#[^\n]*)?\Z", statement) is not None
        alone = statement if head is None else re.sub(r"^el(?=if\b)", "", statement) + (" pass" if block else "")
        try:
            compile(alone, "<file>", "exec", ast.PyCF_ONLY_AST, dont_inherit=True)
            continue
        except (SyntaxError, ValueError):
            continue  # the whole text tells
        except (RecursionError, MemoryError):
            pass
        word = head.group() if head is not None else ""
        if re.match(r"(?:async\s+)?def\b", word):
            short = f"{word}():"
        elif word.startswith("class"):
            short = f"{word}:"
        elif word == "elif":
            short = "elif 1:"
        else:
            short = "if 1:" if word else ""
        lines[a - 1] = lines[a - 1][:col] + (short if block else f"{short} pass".lstrip()) + "\n"
        lines[a:b] = ["\n"] * (b - a)
    return "".join(lines)


def xml_parses(text: str) -> bool:
    p = expat.ParserCreate("utf-8")
    try:
        p.Parse(text.encode("utf-8", "surrogatepass"), True)
        return True
    except expat.ExpatError:
        return False


# ----------------------------------------------------------------- pairs
#: stand before the first and behind the last token, so that pairs also tell how a text may start and end
START, END = "^", "$"


def pair_codes(classes: str) -> list[int]:
    """Distinct adjacent pairs as ``left << 8 | right`` (classes are ASCII)."""
    b = START + classes.replace("\n", "") + END
    return [ord(x) << 8 | ord(y) for x, y in set(zip(b, b[1:]))]


def _pairs(alphabet: str, forbidden) -> list[int]:
    return [ord(a) << 8 | ord(b) for a in alphabet for b in alphabet if not forbidden(a, b)]


_JAVA_ALL = "".join(sorted(set("".join(_JAVA_WORDS.values()) + "".join(_JAVA_OPS.values()) + "li") - {"!"}))
_JS_ALL = "".join(sorted(set("".join(_JS_WORDS.values()) + "".join(_JS_OPS.values()) + "li") - {"!", "\n"}))


def _java_forbidden(a: str, b: str) -> bool:
    """Pairs no Java production contains (``[]`` and generics included)."""
    binary, closers = "=B*&|+?-:", ");,]}"
    if a in "=B+~-o" and b in closers or a in "=Bo" and b in "=B*|?:.o":
        return True
    if a == "l" and b in "il~pvctNIFSWrTbRYqx({[_@M":
        return True
    if a in ".\"" and b in ").,;]}={" or a == "~" and b in "=B*&|?:.,;":
        return True
    if a == "(" and b in "=B*|&,]}.?:oEKC" or a == "," and b in ")]=B*|&;,.:oE" or a == "[" and b in "=B;,).}:o":
        return True
    if a in "i" and b in "l~NKEICFWOSrTby" or a == "]" and b in "l~" or a in binary and b in "mxwEKCfWIFOrTb" and a not in "-:?":
        return True
    return a in "IFW" and b != "(" or a in "rT" and b in ")],}"


def _js_forbidden(a: str, b: str) -> bool:
    if a in "=B~" and b in ");,]}" or a in "=B" and b in "=B?:.o":
        return True
    return a == "(" and b in "=B,]}o" or a in "SW" and b not in "(:,;}=.?"


def _ends(starts: str, ends: str, empty: bool) -> list[int]:
    """Pairs of the first and of the last token with the edges of the text."""
    pairs = [(START, c) for c in starts] + [(c, END) for c in ends] + [(START, END)] * empty
    return [ord(a) << 8 | ord(b) for a, b in pairs]


def _json_allowed() -> list[int]:
    ok = ["{s", "{}", "s:", "s,", "s}", "s]", ":s", ":l", ":{", ":[", ",s", ",l", ",{", ",[", "l,", "l}", "l]", "[s", "[l", "[{", "[[", "[]", "},", "}}", "}]", "],", "]}", "]]"]
    return [ord(p[0]) << 8 | ord(p[1]) for p in ok]


def _but(alphabet: str, without: str) -> str:
    return "".join(c for c in alphabet if c not in without)


def permissible_pairs() -> list[tuple[str, int]]:
    """Every adjacent pair of token classes a language's grammar allows (a few thousand rows at most)."""
    return (
        [("java", c) for c in _pairs(_JAVA_ALL, _java_forbidden) + _ends("Mmq@ceRi;", "};", True)]
        + [("js", c) for c in _pairs(_JS_ALL, _js_forbidden) + _ends(_but(_JS_ALL, ")]},.?:=B*oEKkfx"), _but(_JS_ALL, "=B+*~([{,.?:oN_qcCvxTIFWSOwM"), True)]
        + [("json", c) for c in _json_allowed() + _ends("{[sl", "}]sl", False)]
    )


PARSED = ("java", "py", "js", "json", "xml", "xsl", "opml")


_ALLOWED: dict[str, set[int]] = {}


def permitted(ext: str, codes: list[int]) -> bool:
    """True when all adjacent pairs are in the table of the language (or it has none)."""
    if not _ALLOWED:
        for lang, code in permissible_pairs():
            _ALLOWED.setdefault(lang, set()).add(code)
    return ext not in _ALLOWED or _ALLOWED[ext].issuperset(codes)


_LEXERS = {"java": (java_classes, java_reduces), "js": (js_classes, js_reduces), "json": (json_classes, json_reduces)}


def analyse(ext: str, text: str) -> tuple[bool, list[int]]:
    """``(productions reduce, distinct adjacent pairs)`` of one file.

    A file with a pair that is not permitted is broken by that pair alone, so
    its productions are not tried and count as reduced.
    """
    if text[:1] == "\ufeff":
        text = text[1:]
    if ext in _LEXERS:
        lex, reduces = _LEXERS[ext]
        c = lex(text)
        codes = pair_codes(c)
        return not permitted(ext, codes) or reduces(c), codes
    if ext == "py":
        return python_parses(text), []
    return xml_parses(text), []


def broken(ext: str, text: str) -> bool:
    """The verdict of the parse check for one text, for operators that skip broken files as they lex."""
    ok, codes = analyse(ext, text)
    return not ok or not permitted(ext, codes)
