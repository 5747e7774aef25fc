"""P3 - functions paired with their documentation.

Each parseable Java, Python or JavaScript file is lexed into rows: braces or
indentation levels that open and close, documentation comments, function
headers.  A cumulative sum over the rows of a file gives the nesting depth;
within one depth every opening row and its closing row form an island, so
``lead`` over (file, depth) finds where the function ends; ``lag`` over the
file attaches the comment before a header, ``lead`` the docstring behind one.
The rows carry marks, no text: the lexer, which holds the text, tells whether
a description is a real sentence, and for :func:`code_pairs` cuts the code of a
described function, with the functions inside it, as its last bracket closes.

Defined results: null content gives no rows, an empty file none; files that do
not parse are skipped; a row delivered again under one ``file_id`` gives the
same pairs, which are counted once; a null ``file_id`` is kept as null.
"""

from __future__ import annotations

import ast
import hashlib
import re
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import syntax
from .sources import with_ext, without_blocks

EXTS = ("java", "py", "js")
#: a description of up to this many words is not a sentence
MIN_WORDS = 4
#: characters of Chinese or Japanese that count as a sentence
MIN_CJK = 8

_SCAN = re.compile(
    r'/\*.*?(?:\*/|\Z)|//[^\n]*|"""[ \t\f]*\r?\n(?:[^\\]|\\.)*?"""|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`(?:[^`\\]|\\.)*`|[{};]',
    re.S,
)
_ANNOTATION_OPEN = re.compile(r"@[\w.]+\s*\([^()]*$")
_JAVA_HEAD = re.compile(
    r"(?P<type>[\w$.\]>?]+)\s+(?P<name>[\w$]+)\s*\((?P<params>(?:[^()]|\([^()]*\))*)\)\s*(?:\[\s*\]\s*)*(?:throws\s+[\w.,\s$<>@]+)?$"
)
_NOT_TYPES = frozenset(
    "new return else throw public private protected static final abstract synchronized native strictfp transient"
    " volatile default case record instanceof do try assert yield package import class interface enum".split()
)
_NOT_NAMES = frozenset("if for while switch catch synchronized try return new super this with function constructor".split())
_JS_HEAD = re.compile(
    r"(?:function\s*\*?\s*(?P<n1>[\w$]+)\s*\((?:[^()]|\([^()]*\))*\)"
    r"|(?P<n2>[\w$]+)\s*[:=]\s*(?:async\s+)?function\b\s*\*?\s*[\w$]*\s*\((?:[^()]|\([^()]*\))*\)"
    r"|(?P<n3>[\w$]+)\s*[:=]\s*(?:async\s*)?(?:\((?:[^()]|\([^()]*\))*\)|[\w$]+)\s*=>"
    r"|(?:^|[\s,*])(?P<n4>[\w$#]+)\s*\((?:[^()]|\([^()]*\))*\))\s*$"
)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")
# Sentences that describe nothing; a sentence that only starts with one of their words is prose.
_PLACEHOLDER = re.compile(
    r"(?:(?:todo|fixme|xxx|tbd)\b|hack\s*(?:[:!.(]|$)|auto-?generated\s+(?:(?:method|constructor|function)\s+)?stub\b"
    r"|\(?non-javadoc\b\)?|inherit(?:ed)?(?:\s+(?:java)?doc\w*|\s+from\s+[^\s.]+(?:\.\w+)*|\s+(?:description|javadocs?|comments?))*\s*(?:[.!]|$)"
    r"|see\s+(?:also\b|above\b|below\b|https?:|\{@|the\b|(?:super\w*|parent|base|interface|general|overridden|overriden|class|java-?docs?|docs?|documentation)\b|[\w.$]*[#(]|[\w$]+(?:\.[\w$]+)+|(?-i:\w*[a-z]\w*[A-Z]\w*)|\w+\s*(?:[.!]|$))"
    r"|(?:document|add|write)\s+(?:me|this(?:\s+(?:method|function|constructor|class))?|documentation\b[^.]*)(?:\s+(?:here|later|soon|please))?\s*(?:[.!]|$)"
    r"|description of the method\s*(?:[.:!]|$)|deprecated\s*(?:[.!]|$))(?P<rest>)",
    re.I,
)
_SENTENCE_END = re.compile(r"[.!?](?:\s+|$)")


def prose(desc: str) -> str:
    """``desc`` behind the placeholders it starts with."""
    while desc and (m := _PLACEHOLDER.match(desc)) is not None:
        end = _SENTENCE_END.search(desc, max(m.start("rest") - 1, 0))
        desc = desc[end.end() :].lstrip() if end is not None else ""
    return desc


_BLOCK_TAG = re.compile(r"(?m)^[ \t]*@[A-Za-z][\w.]*.*?(?=^[ \t]*@[A-Za-z]|\Z)", re.S)
_PY_FIELD = re.compile(r"(?m)^\s*:\w[^\n:]*:[^\n]*$|^\s*(?:Args|Arguments|Parameters|Returns|Raises|Yields)\s*:?\s*$.*\Z|^\s*>>>.*$", re.S)


def description(raw: str, python: bool = False) -> str:
    """The prose of a documentation comment: markup, code samples and tags removed, white space folded."""
    if python:
        s = re.sub(r"(?m)^[ \t]*:\w[^\n:]*:[^\n]*$|^[ \t]*>>>[^\n]*$", " ", raw)
        s = re.split(r"(?m)^[ \t]*(?:Args|Arguments|Parameters|Returns|Raises|Yields)\s*:\s*$", s)[0]
    else:
        s = re.sub(r"(?m)^[ \t]*\*+ ?", "", raw)
        s = _BLOCK_TAG.sub(" ", s)
    if "</" in s:
        s = without_blocks(s, ("pre", "code"))
    s = re.sub(r"(?s)\{@(?:inheritDoc|docRoot)\s*\}", " ", s)
    s = re.sub(r"(?s)\{@(?:code|literal|snippet)\b[^{}]*\}", " ", s)
    s = re.sub(r"(?s)\{@link(?:plain)?\s+([^{}]*)\}", r"\1", s)
    s = re.sub(r"<[^<>]*>", " ", s)
    return re.sub(r"\s+", " ", s).strip()


def name_words(name: str) -> set[str]:
    return {w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_a-zA-Z]+", name)}


# Words that only dress up the name of a function.
_DRESSING = frozenset(
    "a an the this that of for to method methode function procedure routine operation class classe object implements"
    " implementation performs perform executes execute does do calls call runs run invokes invoke handles is and it".split()
)


def is_described(desc: str, name: str) -> bool:
    """True when ``desc`` holds a real sentence that is not just ``name`` spelt out."""
    desc = prose(desc)
    if not desc:
        return False
    if len(_CJK.findall(desc)) >= MIN_CJK:
        return True
    words = _WORD.findall(desc)
    if len(words) < MIN_WORDS:
        return False
    own = name_words(name) | {name.lower()}
    rest = [w for w in (x.lower() for x in words) if w not in own and w not in _DRESSING]
    rest = [w for w in rest if w.rstrip("s") not in own and w + "s" not in own]
    return len(rest) > 0


class Row(NamedTuple):
    """One lexed row; ``pos`` is its number in the file.

    ``kind`` is D (documentation), F (a function header that opens its body),
    O / C (anything else that opens / whatever closes), X (anything that parts
    a comment from the next header).  ``real`` tells of an F that the comment
    belonging to it describes it; ``desc`` and ``code`` are its texts.
    """

    pos: int
    kind: str
    delta: int = 0
    name: str | None = None
    line_no: int | None = None
    real: bool = False
    desc: str | None = None
    code: str | None = None


def lex_functions(ext: str, text: str, with_code: bool) -> list[Row]:
    """The rows of one file in order."""
    if ext == "py":
        return _lex_python(text, with_code)
    rows: list[Row] = []
    head_re = _JAVA_HEAD if ext == "java" else _JS_HEAD
    buf: list[str] = []
    seg_start = prev = 0
    pending: tuple[str, int] | None = None  # the description that waits for its header, and where its comment ends
    opened: list[tuple[int, int]] = []  # the row that opened each level, and where the code of a described function starts
    annotation = 0

    def add(kind, delta=0, *rest):
        rows.append(Row(len(rows), kind, delta, *rest))

    for m in _SCAN.finditer(text):
        start, end = m.span()
        gap = text[prev:start]
        prev = end
        c = text[start]
        if c == "/":
            if not buf and not gap.strip():
                buf_blank = True
            else:
                buf_blank = not gap.strip() and not "".join(buf).strip()
            if buf_blank:
                if text.startswith("/**", start) and end - start > 4:
                    add("D")
                    pending = description(text[start + 3 : end - 2]), end
                elif pending:
                    add("X")
                    pending = None
                buf = []
                seg_start = end
            else:
                buf.append(gap)
                buf.append(" " * (end - start))
            continue
        if c in "\"'`":
            buf.append(gap)
            buf.append(" " * (end - start))
            continue
        buf.append(gap)
        if c == "{":
            seg = "".join(buf)
            if annotation or "@" in seg and _ANNOTATION_OPEN.search(seg):
                annotation += 1
                buf.append(" ")
                continue
            name = None
            h = head_re.search(seg.rstrip()) if ")" in seg or "=>" in seg else None
            if h is not None:
                if ext == "java":
                    if h.group("type") not in _NOT_TYPES and h.group("name") not in _NOT_NAMES:
                        name, at = h.group("name"), h.start("name")
                else:
                    g = next(k for k in ("n1", "n2", "n3", "n4") if h.group(k))
                    if h.group(g) not in _NOT_NAMES:
                        name, at = h.group(g), h.start(g)
            if name is not None:
                real = pending is not None and is_described(pending[0], name)
                opened.append((len(rows), pending[1] if real else -1))
                add("F", 1, name, text.count("\n", 0, seg_start + at) + 1, real, pending[0] if real and with_code else None)
            else:
                opened.append((len(rows), -1))
                add("O", 1)
            pending = None
        elif c == "}":
            if annotation:
                annotation -= 1
                buf.append(" ")
                continue
            row, begin = opened.pop() if opened else (-1, -1)
            if with_code and begin >= 0:
                rows[row] = rows[row]._replace(code=text[begin:end].strip())
            add("C", -1)
            pending = None
        elif pending:
            add("X")
            pending = None
        buf = []
        seg_start = end
    return rows


_PY_STRING = r"[rRbBuUfF]{0,2}(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|\"(?:[^\"\\\r\n]|\\(?:\r\n|.))*\"|'(?:[^'\\\r\n]|\\(?:\r\n|.))*')"
_PY_SCAN = re.compile(rf"(?P<s>{_PY_STRING})|#[^\r\n]*|(?P<o>[(\[{{])|(?P<x>[)\]}}])|\\\r?\n|(?P<n>\r\n|\n|\r|\Z)", re.S)
_PY_DEF = re.compile(r"(?:async\s+)?def(?:\s|\\\r?\n)+(\w+)")
_PY_BLANK = re.compile(r"[ \t\f]*(?:#[^\r\n]*)?")
_PY_DOC = re.compile(rf"(?:\(\s*)*((?:{_PY_STRING}\s*)+)[\s)]*(?=[;#]|\Z)", re.S)


def _logical_lines(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end, column, end of the header) of each logical line; a header ends behind the colon of a line with a body of its own."""
    out = []
    at, depth, colon = 0, 0, -1
    for m in _PY_SCAN.finditer(text):
        kind = m.lastgroup
        if kind == "o":
            depth += 1
        elif kind == "x":
            depth = max(depth - 1, 0)
            if depth == 0:
                colon = m.end()
        elif kind == "n" and depth == 0:
            blank = _PY_BLANK.match(text, at, m.start())
            if blank.end() < m.start():
                col = 0
                start = at
                for c in text[at : m.start()]:
                    if c == "\t":
                        col = col // 8 * 8 + 8
                    elif c == " ":
                        col += 1
                    elif c == "\f":
                        col = 0
                    else:
                        break
                    start += 1
                out.append((start, m.start(), col, colon if colon > start else start))
            at, colon = m.end(), -1
    return out


def _docstring(text: str) -> str | None:
    """The string a statement starts with, when it is nothing else."""
    m = _PY_DOC.match(text)
    if m is None:
        return None
    try:
        value = ast.literal_eval("(" + m.group(1) + ")")
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return None
    return value if isinstance(value, str) else None


def _lex_python(text: str, with_code: bool) -> list[Row]:
    """Levels are those of indentation; a docstring is the row behind its header."""
    if text[:1] == "﻿":
        text = text[1:]
    rows: list[Row] = []
    levels: list[tuple[int, int, int]] = []  # column, opening row, start of the code
    last = (0, 0, 0, 0)  # the logical line before

    def close(col: int) -> None:
        while levels and levels[-1][0] >= col:
            _, row, begin = levels.pop()
            if with_code and rows[row].real:
                rows[row] = rows[row]._replace(code=text[begin : last[1]].strip("\r\n"))
            rows.append(Row(len(rows), "C", -1))

    def document(statement: str) -> None:
        row = levels[-1][1]
        head = rows[row]
        if head.kind == "F" and (doc := _docstring(statement)) is not None:
            desc = description(doc, True)
            real = head.name != "__init__" and is_described(desc, head.name)
            rows[row] = head._replace(real=real, desc=desc if real and with_code else None)
            rows.append(Row(len(rows), "D"))

    fresh = False  # the line before is a header
    for line in _logical_lines(text):
        start, end, col, header = line
        if fresh and levels[-1][0] < col:
            document(text[start:end])
        fresh = False
        close(col)
        d = _PY_DEF.match(text, start, end)
        if d is not None:
            begin = start
            while begin and text[begin - 1] in " \t":
                begin -= 1
            levels.append((col, len(rows), begin))
            rows.append(Row(len(rows), "F", 1, d.group(1), text.count("\n", 0, d.start(1)) + 1))
            body = re.compile(r"[^:#\r\n]*:\s*(?=[^\s#])").match(text, header, end)
            if body is not None:
                document(text[body.end() : end])
            fresh = body is None
        elif text.startswith("class", start):
            levels.append((col, len(rows), start))
            rows.append(Row(len(rows), "O", 1))
        last = line
    close(-1)
    return rows


_SCHEMA = "file_id bigint, copy bigint, pos int, kind string, delta int, name string, line_no bigint, real boolean, desc string, code string"


def lexed_rows(files: DataFrame, with_code: bool = False) -> DataFrame:
    """The exploded rows; ``copy`` is a hash of the id and the text, so a task that is rerun gives the same."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    st = T._parse_datatype_string(_SCHEMA)
    arrow = to_arrow_schema(st)

    def run(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in arrow]
            names = batch.schema.names
            values = [batch.column(names.index(n)).to_pylist() for n in ("file_id", "ext", "content")]
            for file_id, ext, text in zip(*values):
                if ext != "py" and "/**" not in text:
                    continue  # nothing is documented
                rows = lex_functions(ext, text, with_code)
                if not any(r.real for r in rows) or syntax.broken(ext, text):
                    continue
                n = len(rows)
                cols[0] += [file_id] * n
                row = hashlib.blake2b(f"{file_id} {ext} ".encode() + text.encode("utf-8", "surrogatepass"), digest_size=8)
                cols[1] += [int.from_bytes(row.digest(), "big", signed=True)] * n
                for k, col in enumerate(zip(*rows), 2):
                    cols[k] += col
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return with_ext(files, EXTS).mapInArrow(run, st)


def _once(rows: DataFrame) -> DataFrame:
    """The rows of a text that was delivered again under its id only once, in the partitions of the windows that follow."""
    order = Window.partitionBy("copy").orderBy("pos")
    return rows.withColumn("last", F.lag("pos").over(order)).where(F.col("last").isNull() | (F.col("last") != F.col("pos"))).drop("last")


def functions(files: DataFrame, with_code: bool = False) -> DataFrame:
    """(file_id, copy, name, line_no, real, desc, code, start, end): functions with a body and a documentation of their own."""
    order = Window.partitionBy("copy").orderBy("pos")
    rows = (
        _once(lexed_rows(files, with_code))
        .withColumn("depth", F.sum("delta").over(order))
        .withColumn("before", F.lag("kind").over(order))
        .withColumn("behind", F.lead("kind").over(order))
        # an opening row and its closing row share the level outside the body
        .withColumn("level", F.col("depth") - F.greatest("delta", F.lit(0)))
    )
    island = Window.partitionBy("copy", "level").orderBy("pos")
    return (
        rows.where("delta <> 0")
        .withColumn("end", F.lead("pos").over(island))
        .where((F.col("kind") == "F") & ((F.col("before") == "D") | (F.col("behind") == "D")) & F.col("end").isNotNull())
        .select("file_id", "copy", "name", "line_no", "real", "desc", "code", F.col("pos").alias("start"), "end")
    )


def described_functions(files: DataFrame) -> DataFrame:
    """Distinct (file_id, method_name, line_no) of functions whose comment holds a real sentence."""
    return functions(files).where("real").select("file_id", F.col("name").alias("method_name"), "line_no").distinct()


def code_pairs(files: DataFrame) -> DataFrame:
    """(file_id, method_name, line_no, description, code): the whole text of each described function with its description."""
    return (
        functions(files, with_code=True)
        .where("real")
        .select("file_id", F.col("name").alias("method_name"), "line_no", F.col("desc").alias("description"), "code")
        .distinct()
    )
