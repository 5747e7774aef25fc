"""P4 - files nobody in the project wrote by hand.

First stage, layout: each file of code is lexed and emitted again in a
canonical layout (one statement a line, single blanks, four blanks a level).
The original is compared with it:

* ``expansion`` - canonical lines per original line of code: minified files explode;
* ``tightness`` - how many of the blanks the canonical layout sets are missing;
* ``regularity`` - original lines that start where the layout of the file says;
* ``uniformity`` - canonical lines that carry on a numbered sequence (``f0``,
  ``f1``, ... or constants that step by one): what a template emits follows
  one, and in a perfectly regular layout;
* ``literal_share`` - canonical characters that are literals and the signs
  joining them: data saved as code is little else.

Second stage, provenance: a notice of a tool in a comment or an annotation
before the first member, or a place, a banner or a package that belongs to
another project.  Generated text that looks like any other code and copies of
hand-written code can be told by nothing else.  :func:`stage_counts` reports
what each stage decides.

Defined results: null content is never a case and empty content has no
measures; a file whose repository is unknown is not judged by its package; a
file delivered again counts once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sources import map_rows, spread

#: canonical lines per original line from which a file counts as minified
MIN_EXPANSION = 2.5
#: share of missing blanks from which a file counts as minified
MIN_TIGHTNESS = 0.5
#: share of literal characters from which a file counts as data
MIN_LITERAL_SHARE = 0.8
MIN_LITERALS = 4
#: a single literal beyond this share of all literal characters is a long string, not a table
MAX_SINGLE_SHARE = 0.5
#: share of canonical lines in a numbered sequence, and of lines laid out regularly, from which a file counts as generated
MIN_UNIFORMITY = 0.7
MIN_REGULARITY = 0.9

_SLASH = frozenset("java js css c ts jsx".split())
_HASH = frozenset("py sh yml yaml properties".split())
_MARKUP = frozenset("xml xsl opml html".split())
_CODE = frozenset("java js py css".split())

_SLASH_LITERAL = re.compile(r"(?P<c>/\*.*?(?:\*/|\Z)|//[^\n]*)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`", re.S)
_PY_LITERAL = re.compile(
    r"(?P<c>#[^\n]*|(?:(?<=\n)|^)[ \t]*(?:\"\"\".*?\"\"\"|'''.*?''')[ \t]*(?=\n|$))|\"\"\".*?\"\"\"|'''.*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'",
    re.S,
)
_NUMBER = re.compile(r"(?<![\w$])[-+]?(?:0[xX][\da-fA-F]+|\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?)[lLfFdDjJ]?\b")
_FOR = re.compile(r"\bfor\s*\([^;(){}]*;[^;{}]*;")
_STATEMENT = re.compile(r"[^;{}]*[;{}]|[^;{}]+")
_RULE = re.compile(r"[^}]*\}|[^}]+")
_HEAD_LINE = re.compile(r"(?:import|package|from|use|using|include|require)\b")
_ANNOTATIONS = re.compile(r"(?:@\w[\w.]*(?:\s*\([^()]*\))?\s*)+(?!interface\b)")
_SEQUENCED = re.compile(r"(?<![A-Za-z_$])([A-Za-z_$]++)(\d++)(?![\w$])")
_DIGIT = re.compile(r"\d")
_INTEGER = re.compile(r"(?<![\w$])\d{1,9}(?![\w$])")
_SHAPED = re.compile(r"\w+")
_BLANKED = re.compile(r"[;,{](?=(\S)?)")
_JOINED = re.compile(r"(?:\"|(?<![\w.])\d[\w.]*+)\s*+[,+]")
_COMMENT = {
    "slash": re.compile(r"/\*.*?(?:\*/|\Z)|//[^\n]*", re.S),
    "hash": re.compile(r"(?m)(?:^|(?<=\s))[#!][^\n]*"),
    "markup": re.compile(r"<!--.*?(?:-->|\Z)", re.S),
    "dash": re.compile(r"--[^\n]*|/\*.*?\*/", re.S),
}

# What stands before the first declaration: comments, strings and imports are passed over, group d ends the head.
_STRING = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"
_HEAD = {
    "java": re.compile(rf"/\*.*?(?:\*/|\Z)|//[^\n]*|{_STRING}|(?P<d>\b(?:class|interface|enum|record)\s+\w)", re.S),
    "css": re.compile(rf"/\*.*?(?:\*/|\Z)|{_STRING}|(?P<d>\{{)", re.S),
    "slash": re.compile(rf"/\*.*?(?:\*/|\Z)|//[^\n]*|{_STRING}|\bimport\b[\w$\s,*{{}}]*(?:\bfrom\b)?|(?P<d>\b(?:function|class|var|let|const|export)\b|[({{\[=])", re.S),
    "py": re.compile(r"(?m)#[^\n]*|\A\s*(?:\"\"\"(?s:.*?)\"\"\"|'{3}(?s:.*?)'{3})|^(?:import|from)\b(?:[^\n(\\]|\\\n|\([^()]*\))*|(?P<d>[^\s#])"),
    "hash": re.compile(r"(?m)^[ \t]*[#!][^\n]*|(?P<d>\S)"),
    "markup": re.compile(r"<!--.*?(?:-->|\Z)|<[?!][^>]*>|(?P<d><\w)", re.S),
    "dash": re.compile(r"--[^\n]*|/\*.*?(?:\*/|\Z)|(?P<d>\S)", re.S),
}

# How tools sign what they wrote.
_TOOL = r"(?:tool|compiler|generator|maker|builder|processor|script|wizard|task|plugin|program|machine|test maker|class list|service description|schema|grammar|template)"
_NOTICE = re.compile(
    rf"""(?ix)
      \b(?:do|please\ do|must|should|may)\s+not\s+(?:be\s+)?(?:edit|change|modify|touch|alter)(?:ed)?\b
    | \b(?:don't|never)\s+(?:edit|change|modify|touch|alter)\s+(?:this|the|it)\b
    | \b(?:auto(?:matically)?|machine)[\s-]*(?:generated|created|made|written|produced|built)\b
    | \b(?:generated|created|produced|written)\s+(?:automatically|mechanically)\b
    | \bgenerated\s+(?:from|by|with|using|on|at|code|file|source)\b
    | \b(?:produced|made|built|created|emitted|written)\s+(?:by|from)\s+(?!hand\b)(?:an?\s+|the\s+)?(?:[\w.\-]+\s+){{0,4}}{_TOOL}\b
    | \boutput\s+of\s+(?:an?\s+|the\s+)?(?:[\w.\-]+\s+){{0,4}}{_TOOL}\b
    | \bmachine\s+run\b | \b(?:built|produced|made|generated)\s+from\s+[\w./\-]+\.(?:y|g4?|l|jj|proto|schema|idl|wsdl|xsd|tmpl|ftl|vm|mustache|avdl|thrift)\b
    | \b(?:all\s+|any\s+)?(?:changes|edits|modifications)\b[^.]{{0,40}}\bwill\s+be\s+(?:lost|overwritten|discarded)\b
    | \bedits\s+belong\s+in(?:to)?\b
    | (?:^|[\s*])@generated\b | <auto-?generated
    | \bautomatisch\s+(?:erzeugt|generiert|erstellt|gegenereerd|aangemaakt)\b | \bnicht\s+(?:bearbeitet|geändert|verändert)\s+werden\b
    | \b(?:généré|genere|créé)e?\s+automatiquement\b | \bgenerad[oa]\s+autom[aá]ticamente\b | \bgerad[oa]\s+automaticamente\b | \bgenerat[oa]\s+automaticamente\b
    | \bwygenerowan\w*\b[^.]{{0,30}}\bautomatycznie\b | \bautomatycznie\s+wygenerowan | автоматически\s+(?:сгенерирован|создан) | (?:сгенерирован|создан)\w*\s+автоматически
    | 自动生成 | 自動生成
    """
)
_STUB = re.compile(r"(?i)auto-?generated\s+(?:\w+\s+)?(?:stub|block|javadoc)")
_ANNOTATED = re.compile(r"(?m)^\s*@(?:javax?\.|jakarta\.)?(?:[\w.]*\.)?Generated\b")
_COPIED = re.compile(
    r"""(?ix)
      \b(?:borrowed|verbatim|unmodified|unchanged|exact|local|private|shaded|vendored|bundled)\s+(?:copy|source|version|fork)\b.{0,60}\b(?:of|from)\b
    | \b(?:taken|copied|imported|borrowed|adopted)\s+(?:over\s+)?(?:verbatim\s+|unchanged\s+)?from\s+[\w.\-]+\s+v?\d[\w.]*
    | \bwith\s+the\s+package\s+renamed\b | \bunder\s+another\s+package\b | \bships\s+with\s+[\w.\-]+\s+v?\d[\w.]*
    | \b(?:vendored|shaded|repackaged|relocated)\s+(?:copy\s+)?(?:from|of)\b
    """
)
#: the first comment of a released library: its name, a version and where it lives or how it may be used
_RELEASE = re.compile(
    r"\A﻿?\s*(?:/\*!?|//!?|#|<!--)[\s*]*(?:@(?:license|preserve)\s+)?[\w.@/\-]+(?:\s+-)?\s+v?\d+\.\d+[\w.\-]*\s*(?:[|,;(\-]|\n|\*/).*?(?:https?://|www\.|\w+\.(?:example|org|com|net|io|js|test|invalid)\b|licen[cs]e|copyright|\(c\)|home)",
    re.I | re.S,
)
_PLACES = frozenset(
    "third_party third-party thirdparty node_modules bower_components vendor vendors vendored external externals ext extern deps contrib-ext jspm_packages".split()
)
_TOOL_PLACE = re.compile(r"(?:^|/)(?:generated-sources|generated-src|generated|target/generated[\w-]*)/")
_SOURCE_ROOT = re.compile(r"^(?:(?:.*/)?(?:src/(?:main|test)/java|src/java|java/src|src)|[\w-]+-tests?)/")
_PACKAGE = re.compile(r"(?m)^[\s\ufeff]*package\s+([\w.]+)\s*;")


#: an unresolved merge: the first side is kept, the marks and the other sides say nothing about who wrote the file
_CONFLICT = re.compile(r"^<{7}.*\n((?:(?![|=>]{7}).*\n)*+)(?:\|{7}.*\n(?:(?!={7}).*\n)*+)?(?:={7}.*\n(?:(?!>{7}).*\n)*+)?(?:>{7}.*(?:\n|\Z))?", re.M)


class Layout(NamedTuple):
    """A text in canonical layout, and what the original shows against it."""

    lines: list[tuple[int, str]]  # (level, statement)
    expansion: float = 0.0
    tightness: float = 0.0
    regularity: float = 0.0
    uniformity: float = 0.0
    literal_share: float = 0.0
    literals: int = 0
    single: float = 0.0


def emitted(y: Layout) -> str:
    """The text in canonical layout."""
    return "".join(f"{'    ' * level}{statement}\n" for level, statement in y.lines)


def layout(ext: str, text: str) -> Layout:
    """``text`` emitted in canonical layout (comments dropped, each string as ``"``), with the measures of the original."""
    text = text.replace("\r\n", "\n")
    if "\n<<<<<<<" in text:
        text = _CONFLICT.sub(r"\1", text)
    literal = longest = strings = comment = comment_lines = 0

    def bare(m: re.Match) -> str:
        nonlocal literal, longest, strings, comment, comment_lines
        size = m.end() - m.start()
        if m.lastgroup == "c":
            comment += size
            breaks = text.count("\n", m.start(), m.end())
            comment_lines += breaks + 1
            return ""
        literal += size
        longest = max(longest, size)
        strings += 1
        return '"'

    code = (_PY_LITERAL if ext == "py" else _SLASH_LITERAL).sub(bare, text)
    if ext == "py":
        statements = code.split("\n")
    elif ext == "css":
        statements = _RULE.findall(code)  # a style sheet has a line for each rule, a program for each statement
    else:
        statements = _STATEMENT.findall(_FOR.sub(lambda m: m.group().replace(";", ","), code))
    lines: list[tuple[int, str]] = []
    own: list[tuple[int, str]] = []  # (level, blanks before it) of each statement that starts a line of the original
    depth = 0
    broken = 0
    for s in statements:
        t = s.strip()
        if not t:
            continue
        lead, brk, blanks = s[: s.index(t[0])].rpartition("\n")
        if ext == "py":
            blanks, brk = s[: s.index(t[0])], "\n"
            depth = len(blanks.expandtabs(4)) // 4
        elif t == "}":
            depth = max(depth - 1, 0)
        if brk or not lines:
            own.append((depth, blanks))
        if "@" in t:
            t = _ANNOTATIONS.sub("", t) or t
        if "\n" in t:
            broken += 1
            t = " ".join(t.split())
        elif "  " in t or "\t" in t:
            t = " ".join(t.split())
        lines.append((depth, t))
        if t[-1] == "{" and ext not in ("py", "css"):
            depth += 1
        elif t[-1] == "}" and t != "}" and ext != "css":
            depth = max(depth - 1, 0)
    if not lines:
        return Layout(lines)
    numbers = _NUMBER.findall(code)
    literal += sum(map(len, numbers))
    longest = max(longest, max(map(len, numbers), default=0))
    data = len(_JOINED.findall(code)) + (sum(map(code.count, "[](){}")) if ext in ("js", "py") else 0)
    white = sum(map(text.count, " \n\t\r"))
    solid = max(len(text) - white - comment, 1)
    physical = max(text.count("\n") + (not text.endswith("\n")) - comment_lines, 1)
    set_blanks = [m.group(1) for m in _BLANKED.finditer(code)]
    missing = sum(c is not None and c not in "})];," for c in set_blanks)
    return Layout(
        lines,
        sum(x[-1] in ";{}" for _, x in lines) / physical,
        missing / max(len(set_blanks), 1),
        1 - (_irregular(own) + (broken if ext != "css" else 0)) / max(len(own), 1),
        uniformity(lines),
        min((literal + data) / solid, 1.0),
        strings + len(numbers),
        longest / max(literal, 1),
    )


def _irregular(own: list[tuple[int, str]]) -> int:
    """Statements whose indentation is not the one most statements of their level have."""
    each = Counter(own)
    most: dict[int, int] = {}
    for (level, _), n in each.items():
        most[level] = max(most.get(level, 0), n)
    return len(own) - sum(most.values())


def uniformity(lines: list[tuple[int, str]]) -> float:
    """Share of canonical lines that carry on a numbered sequence.

    A name belongs to one when the numbers at its end first occur in order,
    without a gap, from 0 or 1 on.  A line also does when it differs from the
    one before only in its words and in an integer that is one higher.
    """
    body = [t for _, t in lines if t not in "{}" and not _HEAD_LINE.match(t)]
    if not body:
        return 0.0
    order: dict[str, list[int]] = {}
    names: list[tuple[int, list[str]]] = []  # (line, stems of its numbered names)
    stepping: set[int] = set()
    previous: tuple[int, str, list[str]] = (-1, "", [])
    for i, t in enumerate(body):
        if _DIGIT.search(t) is None:
            continue
        found = _SEQUENCED.findall(t)
        if found:
            names.append((i, [stem for stem, _ in found]))
        for stem, n in found:
            seen = order.setdefault(stem, [])
            if len(n) < 9 and (not seen or seen[-1] < int(n)):
                seen.append(int(n))
        numbers = _INTEGER.findall(t)
        if numbers:
            shape = _SHAPED.sub("w", t)
            if (i - 1, shape) == previous[:2] and any(int(y) == int(x) + 1 for x, y in zip(previous[2], numbers)):
                stepping |= {i - 1, i}
            previous = i, shape, numbers
    steady = {stem for stem, seen in order.items() if seen and seen[0] in (0, 1) and seen == list(range(seen[0], seen[0] + len(seen)))}
    return len(stepping | {i for i, stems in names if not steady.isdisjoint(stems)}) / len(body)


def _style(ext: str) -> str | None:
    return "slash" if ext in _SLASH else "hash" if ext in _HASH else "markup" if ext in _MARKUP else "dash" if ext == "sql" else None


def head_end(ext: str, text: str) -> int:
    """Where the first declaration starts (Java: the first type); the length of a text without one."""
    pattern = _HEAD.get(ext) or _HEAD.get(_style(ext) or "markup")
    return next((m.start() for m in pattern.finditer(text) if m.lastgroup == "d"), len(text))


#: the sign that ends the first statement or opens the first block behind a point
_FIRST_END = {
    "slash": re.compile(r"/\*.*?(?:\*/|\Z)|//[^\n]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|(?P<d>[;{}])", re.S),
    "hash": re.compile(r"[#][^\n]*|(?P<d>\n)"),
}


def member_end(ext: str, text: str, head: int) -> int:
    """Where the first member of the first declaration ends: a notice may also stand before or in that member."""
    style = _style(ext)
    if style not in _FIRST_END:
        return head
    ends = [m.end() for m, _ in zip((m for m in _FIRST_END[style].finditer(text, head) if m.lastgroup == "d"), range(2 if ext == "java" else 1))]
    return ends[-1] if ends else len(text)


def leading_comments(ext: str, text: str, end: int) -> Iterator[re.Match]:
    """The comments that start before ``end``, each to its own end."""
    style = _style(ext) or "markup"
    for m in (_SLASH_LITERAL if style == "slash" else _COMMENT[style]).finditer(text):
        if m.start() >= end:
            return
        if style != "slash" or m.lastgroup == "c":
            yield m


def notice(ext: str, path: str, text: str, head: int) -> bool:
    """True when a comment or an annotation before the end of the first member, or the place, says that a tool wrote the file."""
    if _TOOL_PLACE.search(path):
        return True
    if _style(ext) is None:
        return False
    head = member_end(ext, text, head)
    if ext == "java" and "Generated" in text:
        bare = _SLASH_LITERAL.sub(lambda m: " " * len(m.group()) if m.lastgroup == "c" else m.group(), text)
        if _ANNOTATED.search(bare, 0, head):
            return True
    for m in leading_comments(ext, text, head):
        c = re.sub(r"\s*\n\s*(?:\*|//|#)?\s*", " ", m.group())
        if _NOTICE.search(c) and not _STUB.search(c):
            return True
    return False


def copied(ext: str, path: str, text: str, head: int) -> bool:
    """True when the place, or a comment before the first declaration, tells that the file belongs to another project."""
    dirs = path.lower().split("/")[:-1]
    if ext == "java":
        m = _SOURCE_ROOT.match(path)
        if m:  # directories below the source root are packages, not places
            dirs = m.group(0).lower().strip("/").split("/")
    if any(d in _PLACES for d in dirs) or ext == "js" and "lib" in dirs:
        return True
    head = member_end(ext, text, head)
    banner = 0
    for m in leading_comments(ext, text, head):
        if _COPIED.search(re.sub(r"\s+", " ", m.group())):
            return True
        if not text[banner : m.start()].strip():
            banner = m.end()  # the comments before any code are one banner
    return ext in ("js", "css") and _RELEASE.match(text[:banner]) is not None


_BLOB = re.compile(r"[\"'`][A-Za-z0-9+/]{1000,}={0,2}[\"'`]")
_SHAPE = {
    "java": re.compile(r"\b(?:class|interface|enum|record)\s+\w+"),
    "js": re.compile(r"\b(?:var|let|const|function)\s|=>|\bmodule\b|^\s*\w[\w.]*\s*=", re.M),
    "py": re.compile(r"(?m)^\w+\s*=|^(?:def|class|import|from)\s"),
    "css": re.compile(r"\{[^{}]*:[^{}]*\}"),
}


#: the reasons of the first stage; the others are provenance
LAYOUT_REASONS = ("minified", "data", "uniform")


def judge(ext: str, path: str, text: str) -> tuple[list[str], Layout]:
    """Reasons for which the file was not written by hand, and the measures."""
    reasons = []
    text = text.removeprefix("\ufeff")
    y = Layout([])
    if ext in _CODE and text and _SHAPE[ext].search(text):
        y = layout(ext, text)
        if ext != "py" and y.expansion >= MIN_EXPANSION and y.tightness >= MIN_TIGHTNESS:
            reasons.append("minified")
        if ext != "css" and y.literal_share >= MIN_LITERAL_SHARE and (
            y.literals >= MIN_LITERALS and y.single <= MAX_SINGLE_SHARE or _BLOB.search(text) is not None
        ):
            reasons.append("data")
        if y.uniformity >= MIN_UNIFORMITY and y.regularity >= MIN_REGULARITY:
            reasons.append("uniform")
    head = head_end(ext, text)
    if notice(ext, path, text, head):
        reasons.append("notice")
    if copied(ext, path, text, head):
        reasons.append("copy")
    return reasons, y


#: projects up to which the table of root packages is sent to every task
MAX_BROADCAST_REPOS = 1_000_000


def judged_files(files: DataFrame, repos: DataFrame) -> DataFrame:
    """(file_id, reasons, and the measures) of every file with content.

    The root packages are broadcast up to MAX_BROADCAST_REPOS projects, which
    are counted first; beyond that they are joined by a shuffle of the verdicts,
    which carry no text.
    """
    measures = ("expansion", "tightness", "regularity", "uniformity", "literal_share")

    def lex(cols: dict) -> dict:
        out: dict[str, list] = {k: [] for k in ("file_id", "repo_id", "package", "reasons", *measures)}
        for file_id, repo_id, path, text in zip(cols["file_id"], cols["repo_id"], cols["path"], cols["content"]):
            path = path or ""
            name = path.rsplit("/", 1)[-1]
            ext = name.rsplit(".", 1)[-1].lower() if "." in name else ""
            reasons, y = judge(ext, path, text)
            package = None
            if ext == "java":
                m = _PACKAGE.search(text)
                root = _SOURCE_ROOT.match(path)
                if m:
                    package = m.group(1)
                elif root:  # cut off or without a declaration: the directories tell
                    package = ".".join(path[root.end() :].split("/")[:-1]) or None
            out["file_id"].append(file_id)
            out["repo_id"].append(repo_id)
            out["package"].append(package)
            out["reasons"].append(reasons)
            for k in measures:
                out[k].append(getattr(y, k))
        return out

    src = files.where(F.col("content").isNotNull()).select("file_id", "repo_id", "path", "content")
    lexed = map_rows(
        spread(src, "file_id"),
        lex,
        "file_id bigint, repo_id bigint, package string, reasons array<string>, " + ", ".join(f"{k} double" for k in measures),
    )
    roots = repos.select("repo_id", "root_package").where("root_package <> ''").dropDuplicates(["repo_id"])
    if roots.limit(MAX_BROADCAST_REPOS + 1).count() <= MAX_BROADCAST_REPOS:
        roots = F.broadcast(roots)
    foreign = (
        F.col("package").isNotNull()
        & F.col("root_package").isNotNull()
        & (F.col("package") != F.col("root_package"))
        & ~F.startswith(F.col("package"), F.concat("root_package", F.lit(".")))
    )
    return lexed.join(roots, "repo_id", "left").select(
        "file_id", F.when(foreign, F.array_append("reasons", "package")).otherwise(F.col("reasons")).alias("reasons"), *measures
    )


def files_not_by_hand(files: DataFrame, repos: DataFrame) -> DataFrame:
    """Distinct ``file_id``."""
    return judged_files(files, repos).where(F.size("reasons") > 0).select("file_id").distinct()


def file_reasons(files: DataFrame, repos: DataFrame) -> DataFrame:
    """(file_id, reason, stage): every reason for which a file was not written by hand."""
    stage = F.when(F.col("reason").isin(*LAYOUT_REASONS), "layout").otherwise("provenance")
    return judged_files(files, repos).select("file_id", F.explode("reasons").alias("reason")).withColumn("stage", stage).distinct()


def stage_counts(files: DataFrame, repos: DataFrame) -> DataFrame:
    """(reason, stage, files, alone): the files each reason holds for, and those no other stage finds."""
    own = F.array_intersect("reasons", F.array(*map(F.lit, LAYOUT_REASONS)))
    seen = judged_files(files, repos).where(F.size("reasons") > 0).select("file_id", F.array_sort("reasons").alias("reasons")).distinct()
    single = (F.size(own) == 0) | (F.size(own) == F.size("reasons"))
    stage = F.when(F.col("reason").isin(*LAYOUT_REASONS), "layout").otherwise("provenance")
    return (
        seen.select(single.alias("single"), F.explode("reasons").alias("reason"))
        .groupBy("reason")
        .agg(F.count("*").alias("files"), F.count_if("single").alias("alone"))
        .select("reason", stage.alias("stage"), "files", "alone")
    )
