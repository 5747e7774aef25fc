"""Criteria as Columns: wildcards, ranges, boolean clauses, selectors and fragments.

Every builder returns a Column, so the planner sees ordinary predicates and
pushes them to the scan.  NULL follows three-valued logic unless a docstring
says otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = {
    "EQ": lambda c, v: c == v,
    "NE": lambda c, v: c != v,
    "LT": lambda c, v: c < v,
    "LE": lambda c, v: c <= v,
    "GT": lambda c, v: c > v,
    "GE": lambda c, v: c >= v,
}
SYMBOLS = {"=": "EQ", "<>": "NE", "!=": "NE", "<": "LT", "<=": "LE", ">": "GT", ">=": "GE"}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def wildcard_to_like(term: str, legacy_underscore: bool = False) -> str:
    """LIKE pattern (escape ``\\``) of a term in which ``*`` is a wildcard and ``\\*`` a star.

    ``legacy_underscore`` leaves ``_`` as LIKE's one-character wildcard.
    """
    out, i = [], 0
    while i < len(term):
        ch = term[i]
        if ch == "\\" and term[i + 1 : i + 2] == "*":
            out.append("*")
            i += 2
            continue
        if ch == "*":
            out.append("%")
        elif ch == "%" or ch == "\\" or ch == "_" and not legacy_underscore:
            out.append("\\" + ch)
        else:
            out.append(ch)
        i += 1
    return "".join(out)


def has_wildcard(term: str) -> bool:
    return re.search(r"(?<!\\)\*", term) is not None


def equals(c: Column | str, term, legacy_underscore: bool = False) -> Column:
    """Equality, or LIKE where a string holds an unescaped ``*``."""
    if isinstance(term, str):
        if has_wildcard(term):
            return _col(c).like(wildcard_to_like(term, legacy_underscore))
        return _col(c) == F.lit(term.replace("\\*", "*"))
    return _col(c) == F.lit(term)


def contains(c: Column | str, term: str) -> Column:
    return F.contains(_col(c), F.lit(term))


def not_equals(c: Column | str, term) -> Column:
    return _col(c) != F.lit(term)


def compare(c: Column | str, operator: str, value) -> Column:
    """``operator`` is a symbol (``<=``) or a name (``LE``); a value of another kind than a plain literal is refused."""
    if not isinstance(value, (int, float, str, bool)) and not hasattr(value, "isoformat"):
        raise TypeError(f"cannot compare with {type(value).__name__}")
    return OPERATORS[SYMBOLS.get(operator, operator)](_col(c), F.lit(value))


def between(c: Column | str, low, high, include_low: bool = True, include_high: bool = True) -> Column:
    c = _col(c)
    lo = (c >= F.lit(low)) if include_low else (c > F.lit(low))
    hi = (c <= F.lit(high)) if include_high else (c < F.lit(high))
    return lo & hi


def like(c: Column | str, pattern: str, escape: str | None = None) -> Column:
    """LIKE with an optional one-character escape; a longer one is refused."""
    if escape is not None and len(escape) != 1:
        raise ValueError("the escape must be one character")
    return F.like(_col(c), F.lit(pattern), F.lit(escape)) if escape else _col(c).like(pattern)


def in_set(c: Column | str, values: Iterable, negate: bool = False) -> Column:
    hit = _col(c).isin(*values)
    return ~hit if negate else hit


def is_null(c: Column | str, negate: bool = False) -> Column:
    return _col(c).isNotNull() if negate else _col(c).isNull()


def all_of(*parts: Column) -> Column:
    """Conjunction; of nothing: true."""
    return reduce(lambda a, b: a & b, parts, F.lit(True)) if parts else F.lit(True)


def any_of(*parts: Column) -> Column:
    """Disjunction; of nothing: true, as an empty junction restricts nothing."""
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(True)


def boolean_query(must: Sequence[Column] = (), must_not: Sequence[Column] = (), should: Sequence[Column] = ()) -> tuple[Column, Column]:
    """``(condition, score)`` of MUST / MUST_NOT / SHOULD clauses; the score counts the SHOULD clauses that hold.

    Without a MUST clause at least one SHOULD clause has to hold.  NULL counts as not holding.
    """
    holds = lambda p: F.coalesce(p, F.lit(False))
    cond = all_of(*[holds(p) for p in must], *[~holds(p) for p in must_not])
    if should and not must:
        cond = cond & any_of(*[holds(p) for p in should])
    score = reduce(lambda a, b: a + b, [holds(p).cast("int") for p in should], F.lit(0))
    return cond, score


def matches(c: Column | str, term: str, prefix_semantics: bool = False) -> Column:
    """In-memory style match: an empty term or value is false; ``*`` matches anything.

    Without a star the match is exact, or a prefix match on request.
    """
    c = _col(c)
    if not term:
        return F.lit(False)
    if has_wildcard(term):
        hit = c.like(wildcard_to_like(term))
    elif prefix_semantics:
        hit = F.startswith(c, F.lit(term))
    else:
        hit = c == F.lit(term)
    return F.coalesce(hit & (F.length(c) > 0), F.lit(False))


def glob_pattern(text: str) -> str:
    """A forgiving LIKE pattern: lower case, blanks and stars match anything, open at both ends."""
    body = "".join("%" if ch in " *" else "\\" + ch if ch in "%_\\" else ch for ch in text.strip().lower())
    if not body:
        raise ValueError("an empty search text")
    return re.sub("%+", "%", f"%{body}%")


def glob(c: Column | str, text: str) -> Column:
    return F.lower(_col(c)).like(glob_pattern(text))


def term_query(tokens: Column | str, value) -> Column:
    return F.array_contains(_col(tokens), str(value))


def term_range(c: Column | str, low: str | None, high: str | None, include_low: bool = True, include_high: bool = True) -> Column:
    """Range in string order; an open end is None."""
    parts = []
    if low is not None:
        parts.append((_col(c) >= low) if include_low else (_col(c) > low))
    if high is not None:
        parts.append((_col(c) <= high) if include_high else (_col(c) < high))
    return all_of(*parts)


def term_range_text(field: str, low: str, high: str, include_low: bool, include_high: bool) -> str:
    return f"{field}:{'[' if include_low else '{'}{low} TO {high}{']' if include_high else '}'}"


def between_fragment(column: str, low: str, high: str, include_low: bool = True, include_high: bool = True) -> str:
    return f"{column} {'>=' if include_low else '>'} {low} AND {column} {'<=' if include_high else '<'} {high}"


def simple_fragment(column: str, operator: str, value: str) -> str:
    """``column OP 'value'`` with quotes doubled."""
    sign = {"EQ": "=", "GE": ">=", "GT": ">", "LE": "<=", "LT": "<", "NE": "<>", "LIKE": "LIKE"}[operator]
    return f"{column} {sign} '{value.replace(chr(39), chr(39) * 2)}'"


def in_folder(path: Column | str, folder: str) -> Column:
    """Directly below a folder."""
    p, f = _col(path), folder.rstrip("/") + "/"
    return F.startswith(p, F.lit(f)) & (F.length(p) > len(f)) & ~F.contains(F.substr(p, F.lit(len(f) + 1)), F.lit("/"))


def in_tree(path: Column | str, folder: str) -> Column:
    """Anywhere below a folder."""
    f = folder.rstrip("/") + "/"
    return F.startswith(_col(path), F.lit(f)) & (F.length(_col(path)) > len(f))


def regex(c: Column | str, pattern: str, negate: bool = False) -> Column:
    hit = _col(c).rlike(pattern)
    return ~hit if negate else hit


def cookies_contain(cookies: Column | str, required: Sequence[str]) -> Column:
    """All required names occur among ``a=1; b=2``; NULL is false."""
    names = cookie_names(cookies)
    need = F.array(*[F.lit(r) for r in required])
    return F.coalesce(F.size(F.array_except(need, names)) == 0, F.lit(False))


def cookie_names(cookies: Column | str) -> Column:
    parts = F.filter(F.split(_col(cookies), "[; ]+"), lambda x: F.length(x) > 0)
    return F.transform(parts, lambda x: F.split_part(x, F.lit("="), F.lit(1)))


def three_way(a: Column | str, b: Column | str) -> Column:
    """Struct of the flags equal, greater, less and zero of a comparison."""
    a, b = _col(a), _col(b)
    return F.struct((a == b).alias("equal"), (a > b).alias("greater"), (a < b).alias("less"), (a == 0).alias("zero"))


_SELECTOR_NAME = re.compile(r"[A-Za-z_$][\w$.]*\Z")


def identifier(name: str) -> Column:
    """A selector identifier: the prefix JMS is reserved, apart from the message headers."""
    if not _SELECTOR_NAME.match(name):
        raise ValueError(f"not an identifier: {name}")
    if name.startswith("JMS") and not re.match(r"JMS(?:MessageID|DeliveryMode|Priority|Timestamp|CorrelationID|Type|X\w+)\Z", name):
        raise ValueError(f"reserved identifier: {name}")
    return F.col(name)


class Parameters:
    """Indexed bind parameters with a strict bounds check."""

    def __init__(self):
        self._terms: list = []

    def add(self, term) -> str:
        self._terms.append(term)
        return "?"

    def get(self, i: int):
        if not 0 <= i < len(self._terms):
            raise IndexError(i)
        return self._terms[i]

    def args(self) -> list:
        return list(self._terms)


def variable_filter(c: Column | str, mode: str) -> Column:
    """RAW, DERIVED or RAW_AND_DERIVED."""
    return in_set(c, {"RAW": ["raw"], "DERIVED": ["derived"], "RAW_AND_DERIVED": ["raw", "derived"]}[mode])


def clauses(store: dict[tuple[str, str], str], obj: str, clause: str) -> Column:
    """The stored SQL condition of an object; an unknown one restricts nothing."""
    text = store.get((obj, clause))
    return F.expr(text) if text else F.lit(True)
