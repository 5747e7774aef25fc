"""P8 - text cut off by field limits or mid-transfer.

For each source the number of texts of every length (in characters and in
bytes) gives a discrete hazard: of the texts that reach a length, the share
that ends there.  A window over neighbouring lengths gives the hazard to be
expected; lengths whose count is beyond it are kept under false-discovery
control and are the source's field limits.  Endings are classed from the text
itself.  Two classes come out:

* ``limit`` - the text has a significant length, most texts of that length are
  in excess of what its neighbours let expect, and its ending is not complete.
  A heading, a list entry of a few words or the like, which could be complete
  elsewhere, counts there: at a limit the length is the evidence.
* ``transfer`` - any other length.  Transfers break anywhere, so no length can
  tell them; only an ending that plainly stops inside a word, a sentence or a
  block counts.

Defined results: null and empty text is never a case; a text that reaches a
limit but ends well is none; documents repeated under new ids count each; a
null source is a source of its own.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import syntax
from .sources import map_rows, spread

#: neighbouring lengths on either side that set the expected hazard
NEIGHBOURS = 40
#: rate of false discoveries among the lengths called significant, per source
FALSE_DISCOVERY = 0.01
#: fewest texts of one length
MIN_COUNT = 3
#: share of the texts of one length that must be in excess of the expected number for the length to be a limit
MIN_EXCESS = 0.7

COMPLETE, WEAK, STRONG = 0, 1, 2

_TERMINAL = re.compile(r"(?<![.!?。！？．؟:])[.!?。！？．؟:]++[\"'»”’)\]}>`*_~」』）]*+$")
_MARK = re.compile(
    r"(?:\[\s*(?:…|\.{2,}|truncated|cut(?:\s+off)?|snip(?:ped)?|more|continued)\s*(?:…|\.{3})?\s*\]?|\((?:…|\.{3}|truncated|continued|cut\s+off)\)"
    r"|<(?:truncated|snip|cut|more)[^<>]*>|…|(?<!\.)\.{3,}|(?:\.{3}\s*)?\b(?:read|show|see)\s+more)$",
    re.I,
)
#: a remark an author may append: a mark inside a complete text
_REMARK = re.compile(r"\([^()\n]{1,60}\.{2,}\s*\)$")
_CLOSING = re.compile(
    r"(?i)^(?:(?:best|kind|warm|many)?\s*(?:regards|wishes|greetings)|cheers|thanks(?: in advance)?|thank you|sincerely|yours(?: \w+)?|viele grüße|gruß|grüße|mit freundlichen grüßen"
    r"|mfg|cordialement|bien à vous|amicalement|saludos(?: cordiales)?|un saludo|atentamente|atenciosamente|abraços|saluti|cordiali saluti|groeten|groetjes|met vriendelijke groet(?:en)?"
    r"|pozdrawiam|z poważaniem|с уважением|此致|敬具|よろしくお願いします)[,.!]?$"
)
_LIST = re.compile(r"^\s*(?:[-*+•·]|\d{1,3}[.)])\s+(.*)$")
_LINK = re.compile(r"^\W*(?:\w+:\s*)?<?(?:https?|ftp)://\S+>?\W*$|\]\([^()\s]+\)$|^\[\d+\]:?\s+\S+://\S+$")
_TAG = re.compile(r"(?:</[A-Za-z][\w:.\-]*\s*>|<(?:hr|br|p|img|li)\b[^<>]*/?>|-->|/>)$")
_STATUS = re.compile(r"^\[[^\[\]\n]{1,40}\]$|\bexit(?:ed)?\s+(?:with\s+)?(?:code|status)\s+\d+$|^[-=*_~#]{3,}$|^--\s*$", re.I)
_FIELD = re.compile(r"^[^\W\d][\w \-]{1,24}:\s+\S+(?:\s+\S+){0,3}$")
_HEADING = re.compile(r"^#{1,6}\s+\S")
_LITERALS = re.compile(r"/\*.*?(?P<c>\*/|\Z)|//[^\n]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", re.S)
_QUOTED = re.compile(r"([|>#%;])\s+(?=\S)")
_WORD = re.compile(r"[^\W\d_]+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_ENDED = re.compile(r"[.!?。！？][\"')\]»”]*(?:\s|$)|[。！？]")
_PYTHON = re.compile(r"(?m)^(?:def|class|import|from)\s+\w")


def _code_ending(text: str) -> int:
    """Ending of a text that is code: open comments, literals or braces are cuts."""
    for m in _LITERALS.finditer(text):
        if m.group().startswith("/*") and not m.group("c"):
            return STRONG
    bare = _LITERALS.sub('""', text)
    depth = bare.count("{") - bare.count("}")
    parens = bare.count("(") - bare.count(")")
    if depth > 0:
        return STRONG
    end = bare.rstrip()[-1:]
    if end in "}>" and depth <= 0 or end == ";" and parens <= 0:
        return COMPLETE
    if _PYTHON.search(text) and syntax.python_parses(text):
        last = text.rstrip().rsplit("\n", 1)[-1]
        return COMPLETE if last.startswith((" ", "\t", "def", "class", "return")) or parens == 0 else WEAK
    if text.rstrip().rsplit("\n", 1)[-1].lstrip().startswith(("//", "#", "*", "--")):
        return COMPLETE if _TERMINAL.search(text.rstrip()) else STRONG
    return STRONG


def ending(text: str, kind: str | None = None) -> int:
    """COMPLETE, WEAK (could be a cut) or STRONG (plainly a cut)."""
    t = text.rstrip()
    if not t:
        return COMPLETE
    if t.endswith("�"):
        return STRONG
    marked = False
    m = _MARK.search(t)
    if m:
        marked = True
        t = t[: m.start()].rstrip()
        if not t:
            return COMPLETE
    else:
        m = _REMARK.search(t)
        if m:
            return COMPLETE
    state = _ending(t, kind)
    return STRONG if marked and state == WEAK else state


def _ending(t: str, kind: str | None) -> int:
    if t.count("```") % 2:
        return STRONG
    if kind == "code":
        return _code_ending(t)
    lines = t.split("\n")
    last = lines[-1].strip()
    tail = [line.strip() for line in lines[-6:]]
    q = _QUOTED.match(last)
    if q and len(tail) > 1 and tail[-2].startswith(q.group(1)) and not tail[-2].endswith("|"):
        last = last[q.end() :]  # a quoted text: the sign before each line is not part of it
    if last == "```" or _STATUS.search(last) or _TAG.search(last) or _LINK.search(last):
        return COMPLETE
    if last.startswith("|"):
        return COMPLETE if last.endswith("|") and len(last) > 1 else STRONG
    for k in range(len(tail) - 1):
        if tail[k] == "--" or _CLOSING.match(tail[k]):
            return COMPLETE
    if _CLOSING.match(last) or _TERMINAL.search(last):
        return COMPLETE
    if last.endswith("}") and t.count("{") <= t.count("}"):
        return COMPLETE
    item = _LIST.match(last)
    body = item.group(1) if item else last
    words = _WORD.findall(body)
    cjk = len(_CJK.findall(body))
    if item:
        others = [x.group(1).rstrip() for x in map(_LIST.match, lines[:-1]) if x]
        if len(words) <= 3 and cjk < 6:
            return COMPLETE if 0 < len(words) < 3 else WEAK
        if len(others) >= 2 and sum(_TERMINAL.search(o) is None for o in others) * 2 > len(others):
            return WEAK
        return STRONG
    if _FIELD.match(last):
        return COMPLETE
    if _HEADING.match(last) or last.isupper() and len(words) <= 6:
        return WEAK
    if cjk >= 4:
        return STRONG
    if len(words) >= (2 if len(lines) > 1 else 6) or _ENDED.search(t[: -len(last)] if len(last) < len(t) else "") or _ENDED.search(last):
        return STRONG
    return WEAK


def length_hazards(documents: DataFrame) -> DataFrame:
    """(source, unit, length, n, at_risk, hazard, expected, p, significant) of every observed text length.

    Texts are counted per length before anything is shuffled; the windows see
    one row per distinct length, never a document.
    """
    units = F.explode(
        F.array(
            F.struct(F.lit("chars").alias("unit"), F.length("text").alias("length")),
            F.struct(F.lit("bytes").alias("unit"), F.octet_length("text").alias("length")),
        )
    )
    counts = (
        documents.where(F.length("text") > 0)
        .select("source", units.alias("u"))
        .groupBy("source", "u.unit", "u.length")
        .agg(F.count("*").alias("n"))
    )
    key = Window.partitionBy("source", "unit")
    reach = key.orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, 0)
    near = key.orderBy("length").rangeBetween(-NEIGHBOURS, NEIGHBOURS)
    # Chernoff's bound on a Poisson tail: never below the exact p-value
    gap = F.col("n") * F.log(F.col("n") / F.col("expected")) - F.col("n") + F.col("expected")
    rows = (
        counts.withColumn("at_risk", F.sum("n").over(reach))
        .withColumn("hazard", F.col("n") / F.col("at_risk"))
        # of the texts near a length, those ending elsewhere, spread evenly; one is added so that no rate is zero
        .withColumn("expected", (F.sum("n").over(near) - F.col("n") + 1) / F.lit(2.0 * NEIGHBOURS))
        .withColumn("p", F.when(F.col("n") > F.col("expected"), F.exp(-gap)).otherwise(F.lit(1.0)))
    )
    rank = key.orderBy("p", "length")
    rows = rows.withColumn("rank", F.row_number().over(rank)).withColumn("tests", F.count("*").over(key))
    passing = F.when((F.col("p") <= F.col("rank") / F.col("tests") * FALSE_DISCOVERY), F.col("rank"))
    last = F.max(passing).over(key)
    return rows.withColumn("significant", (F.col("rank") <= F.coalesce(last, F.lit(0))) & (F.col("n") >= MIN_COUNT)).drop("rank", "tests")


def endings(documents: DataFrame) -> DataFrame:
    """(doc_id, source, chars, bytes, state) of documents whose ending is not plainly complete."""

    def scan(cols: dict) -> dict:
        out: dict[str, list] = {"doc_id": [], "source": [], "chars": [], "bytes": [], "state": []}
        for doc_id, source, kind, text in zip(cols["doc_id"], cols["source"], cols["doc_kind"], cols["text"]):
            state = ending(text, kind)
            if state:
                out["doc_id"].append(doc_id)
                out["source"].append(source)
                out["chars"].append(len(text))
                out["bytes"].append(len(text.encode("utf-8", "surrogatepass")))
                out["state"].append(state)
        return out

    src = documents.where(F.length("text") > 0).select("doc_id", "source", "doc_kind", "text")
    return map_rows(spread(src, "doc_id"), scan, "doc_id bigint, source string, chars int, bytes int, state int")


def cuts(documents: DataFrame) -> DataFrame:
    """(doc_id, source, cause, unit, length, excess, state): why each cut document counts as cut.

    ``cause`` is ``limit`` with the unit and length of the limit that fits best
    and the share of its texts that are in excess, or ``transfer`` with nulls.
    """
    limits = (
        length_hazards(documents)
        .where("significant")
        .select("source", "unit", "length", (1 - F.col("expected") / F.col("n")).alias("excess"))
        .where(F.col("excess") >= MIN_EXCESS)
    )
    at = F.explode(
        F.array(
            F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")),
            F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length")),
        )
    )
    e = endings(documents).select("doc_id", "source", "state", at.alias("u")).select("doc_id", "source", "state", "u.unit", "u.length")
    j = e.join(
        limits.alias("l"),
        F.col("l.source").eqNullSafe(e["source"]) & (F.col("l.unit") == e["unit"]) & (F.col("l.length") == e["length"]),
        "left",
    ).select("doc_id", e["source"], "state", "excess", F.when(F.col("excess").isNotNull(), F.struct("excess", e["unit"], e["length"])).alias("limit"))
    return (
        j.where(F.col("limit").isNotNull() | (F.col("state") == STRONG))
        .groupBy("doc_id", "source")
        .agg(F.max("limit").alias("limit"), F.max("state").alias("state"))
        .select(
            "doc_id", "source", F.when(F.col("limit").isNotNull(), "limit").otherwise("transfer").alias("cause"),
            "limit.unit", "limit.length", F.round("limit.excess", 6).alias("excess"), "state",
        )
    )


def truncated(documents: DataFrame) -> DataFrame:
    """Distinct ``doc_id`` of documents that were cut."""
    return cuts(documents).select("doc_id").distinct()


def cause_counts(documents: DataFrame) -> DataFrame:
    """(source, cause, unit, length, documents, by_length): cuts per cause; ``by_length`` are those no ending alone shows."""
    return (
        cuts(documents)
        .groupBy("source", "cause", "unit", "length")
        .agg(F.count("*").alias("documents"), F.count_if(F.col("state") != STRONG).alias("by_length"))
    )


def truncation_rates(documents: DataFrame) -> DataFrame:
    """(source, documents, truncated, rate): how often each source cuts."""
    cut = truncated(documents).withColumn("cut", F.lit(1))
    return (
        documents.where(F.length("text") > 0)
        .select("doc_id", "source")
        .join(cut, "doc_id", "left")
        .groupBy("source")
        .agg(F.count("*").alias("documents"), F.count("cut").alias("truncated"))
        .withColumn("rate", F.round(F.col("truncated") / F.col("documents"), 6))
    )
