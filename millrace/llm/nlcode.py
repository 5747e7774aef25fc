"""P2 - natural language inside code.

Comments and string literals are masked by the automaton of :mod:`masks`,
joined where the source joins them (``"a" + "b"``, consecutive line comments),
decoded, cleaned of markup and cut into sentences.  Sentences in Cyrillic, Han
and kana are told by script, the others by the character models of
:mod:`charmodel`, trained on a bounded sample of ``documents``.

Defined results: null content gives no rows; files that do not parse are
skipped; empty files and files without a sentence give no rows; a file
delivered again counts once.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import charmodel, masks, syntax
from .sources import with_ext, without_blocks

EXTS = ("java", "py", "js")
LATIN = ("en", "de", "fr", "es", "pt", "it", "nl", "pl")
MIN_WORDS = 4
MIN_CJK = 8
#: words from which a line of consecutive line comments stands on its own
LONG_LINE = 6
#: documents per language from which the models are trained
SAMPLE_DOCUMENTS = 400
#: characters of each sampled document that are used
SAMPLE_CHARS = 20_000

# Frequent function words, by which training sentences are chosen.
FUNCTION_WORDS = {
    "en": "the of and to is in that it for be by when with not are has this from before only was which so but as if still have until",
    "de": "der die das und ist nicht ein eine wird den dem wenn von zu auf mit noch für es nach wir bevor weil wurde zuerst dass nur sind",
    "fr": "le la les des est que ne pas une un pour dans du il ce et qui sont plus avec avant nous doit parce lorsque encore ont cette",
    "es": "el la los las que no es una un por para con se en del está antes porque cuando hay ya desde también siguen más esta y pero",
    "pt": "o a os as que não é uma um por para com se em do da está antes porque quando foi já também mais ainda esta depois ou nao muito",
    "it": "il la lo gli che non è una un per con si del della di ancora prima perché quando sono stato anche più questa dopo deve se e ma",
    "nl": "de het een en is niet van dat die voor met op te zijn nog als wordt wanneer we eerst omdat deze hij moet naar bij alleen werd",
    "pl": "nie się jest w z na do że to i przed jeśli tego zostanie po gdy przez ponieważ jeszcze musi być dla także tylko jako aby już",
}
_FUNCTION = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}


def _bare(word: str) -> str:
    return unicodedata.normalize("NFKD", word.lower()).encode("ascii", "ignore").decode() if not word.isascii() else word.lower()


_WORD_LANGUAGES: dict[str, list[int]] = {}
for _i, _k in enumerate(LATIN):
    for _w in {_bare(w) for w in _FUNCTION[_k]} | _FUNCTION[_k]:
        _WORD_LANGUAGES.setdefault(_w, []).append(_i)

_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
#: a token made of letters with only sentence punctuation around it
_ORDINARY = re.compile(r"[\"'«»„“”(‘¿¡\[]*([^\W\d_]+(?:['’\-][^\W\d_]+)*)[\"'»«“”’)\].,;:!?…]*$")
_SENTENCE = re.compile(r"(?<=[.!?…])[\s\"')\]]+|[。！？；]|\n[ \t]*\n|[;:](?=\s)")
_SQL = re.compile(
    r"^\s*(?:SELECT\b.*\bFROM\b|INSERT\s+INTO\b|UPDATE\s+\S+\s+SET\b|DELETE\s+FROM\b|(?:CREATE|ALTER|DROP)\s+(?:TABLE|INDEX|VIEW|UNIQUE)\b|WITH\s+\w+\s+AS\s*\()"
    r"|^\s*(?:select\b.*\bfrom\b.*(?:\bwhere\b|=|,|\*)|insert\s+into\b.*\(|update\s+\S+\s+set\b.*=|delete\s+from\b.*=)",
    re.S,
)
_KANA = re.compile(r"[぀-ヿㇰ-ㇿｦ-ﾟ]")
_HAN = re.compile(r"[㐀-䶿一-鿿々豈-﫿]")
_CJK = re.compile(r"[぀-ヿㇰ-ㇿｦ-ﾟ㐀-䶿一-鿿々豈-﫿]")
_CYRILLIC = re.compile(r"[Ѐ-ӿ]")
_PARAGRAPH = re.compile(r"</?(?:p|br|hr|li|ul|ol|dl|dt|dd|div|table|tr|td|th|h[1-6]|blockquote)\b[^<>]*>", re.I)
_DROP = re.compile(
    r"\{@\w+[^{}]*\}|</?[A-Za-z][^<>\n]*>|\b\w+://\S+|(?<![^\s<>()\"'])[^\s@<>()\"']++@[^\s.@]+\.\S+|(?<!\S)[\w.\-]*[/\\][\w./\\\-]+",
    re.S | re.I,
)
_CODE_LINE = re.compile(r"[;{}]\s*$|^\s*[\w.$]+\s*\([^)]*\)\s*;?\s*$|^\s*(?:@\w+|:\w[^:\n]*:|>>>|\$)\s*|^\s*(?:import|package|from|return|throw)\s+[\w.]+\s*;")
_ESCAPE = re.compile(r"\\(?:u+([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|x([0-9a-fA-F]{2})|u\{([0-9a-fA-F]+)\}|([0-7]{1,3})|(\r\n|.))", re.S)
_PLAIN = {"n": " ", "t": " ", "r": " ", "f": " ", "b": "", "\n": "", "\r\n": "", "s": " ", "v": " "}


def _unescape(m) -> str:
    code = m.group(1) or m.group(2) or m.group(3) or m.group(4)
    if code:
        value = int(code, 16)
        return chr(value) if value < 0x110000 else ""
    if m.group(5):
        return chr(int(m.group(5), 8))
    return _PLAIN.get(m.group(6), m.group(6))


def decode(literal: str) -> str:
    """A literal's text with escapes replaced by what they stand for."""
    if "\\" not in literal:
        return literal
    out = _ESCAPE.sub(_unescape, literal)
    if any(0xD800 <= ord(c) <= 0xDFFF for c in out):
        out = out.encode("utf-16", "surrogatepass").decode("utf-16", "ignore")
    return out


def _comment_text(raw: str, block: bool) -> str:
    if block:
        lines = []
        for line in raw.split("\n"):
            s = line.strip().lstrip("*").strip()
            lines.append(s)
    else:
        lines = [line.strip().lstrip("/#!*").strip() for line in raw.split("\n")]
    out = []
    before = 0
    for s in lines:
        size = len(s.split())
        if s and _CODE_LINE.search(s):
            s = "\n\n"  # a tag or a line of code ends the sentence before it and is none itself
        elif not block and before >= LONG_LINE and size >= LONG_LINE:
            s = "\n\n" + s  # long line comments are sentences of their own, or pieces long enough to tell the language
        out.append(s)
        before = size
    return "\n".join(out)


def texts(language: str, contents: list[str]) -> tuple[list[int], list[str]]:
    """The natural text of each comment group and joined literal: (index of the file, text)."""
    encoded = [c.encode("utf-8", "surrogatepass") for c in contents]
    data = b"".join(encoded)
    offsets = np.zeros(len(encoded) + 1, np.int64)
    np.cumsum([len(e) for e in encoded], out=offsets[1:])
    kind = masks.kinds(language, np.frombuffer(data, np.uint8), offsets)
    owner, begin, end, what = (x.tolist() for x in masks.runs(kind, offsets))
    files: list[int] = []
    out: list[str] = []
    joined: list[str] = []
    last = (-1, 0, 0)

    def flush():
        if joined:
            files.append(last[0])
            if last[2] == masks.STRING:
                out.append(decode("".join(joined)))
            else:
                out.append(_comment_text("\n".join(joined), last[2] == masks.BLOCK_COMMENT))
            joined.clear()

    drop = b" \t\r\n\\\"'`+"
    for f, b, e, k in zip(owner, begin, end, what):
        piece = data[b:e]
        if k == masks.STRING:
            piece = piece[1:] if piece[:1] in b"\"'`" and piece else piece
        if f == last[0] and k == last[2] and k != masks.BLOCK_COMMENT:
            between = data[last[1] : b]
            if k == masks.STRING:
                same = not between.translate(None, drop)
            else:
                same = between.count(b"\n") <= 1 and between.strip() in (b"/", b"#", b"")
        else:
            same = False
        if not same:
            flush()
        if k == masks.STRING and language == "py" and piece[:2] in (b'""', b"''"):
            piece = piece[2:]
        joined.append(piece.decode("utf-8", "replace"))
        last = (f, e, k)
    flush()
    return files, out


def sentences(text: str) -> list[str]:
    """Sentences and clauses of a cleaned text that could be natural language."""
    if "<" in text or "{@" in text or "/" in text or "@" in text or "\\" in text:
        if "<" in text:
            if "</" in text:
                text = without_blocks(text, ("pre", "code", "script", "style"))
            text = _PARAGRAPH.sub("\n\n", text)
        text = _DROP.sub(" ", text)
    if len(text) < 8:
        return []
    return [s for s in _SENTENCE.split(text) if len(s) >= 8 and not _SQL.search(s)]


def ordinary_words(sentence: str) -> list[str]:
    out = []
    for token in sentence.split():
        m = _ORDINARY.match(token)
        if m:
            w = m.group(1)
            if w.islower() or w[0].isupper() and (len(w) == 1 or w[1:].islower()):
                out.append(w)
    return out


def by_script(sentence: str) -> str | None:
    """ja, zh or ru where the script tells, '' where it tells that there is no sentence, None for Latin text."""
    cjk = len(_CJK.findall(sentence))
    if cjk:
        if cjk >= MIN_CJK:
            return "ja" if _KANA.search(sentence) else "zh"
        if cjk > 2:
            return ""
    cyr = len(_CYRILLIC.findall(sentence))
    if cyr:
        words = ordinary_words(sentence)
        if sum(1 for w in words if _CYRILLIC.match(w)) >= MIN_WORDS:
            return "ru"
        if cyr > 3:
            return ""
    return None


class Models:
    """The trained tables and each language's lowest score of a natural sentence."""

    def __init__(self, lines: dict[str, list[str]]):
        self.languages = list(LATIN)
        self.tables = np.stack([charmodel.train(lines[k]) for k in self.languages], axis=1)
        self.floor = np.zeros(len(self.languages), np.float32)
        for i, k in enumerate(self.languages):
            own = charmodel.scores(self.tables, lines[k])[:, i] if lines[k] else np.zeros(1, np.float32)
            self.floor[i] = np.quantile(own, 0.01) - FLOOR_MARGIN

    def classify(self, lines: list[str]) -> list[str | None]:
        """Language of each Latin sentence (its ordinary words), None where it is not natural language.

        The mean log probability decides, raised by WORD_WEIGHT times the
        share of function words, which carries sentences whose content words
        the bounded sample never held.  The best language must reach its floor
        with the score raised by WORD_MARGIN for each of at most two function
        words; without any, as many lower-case words are asked for as a
        sentence needs words.
        """
        if not lines:
            return []
        split = [line.split() for line in lines]
        hits = np.zeros((len(lines), len(self.languages)), np.float32)
        for i, words in enumerate(split):
            for w in words:
                k = _WORD_LANGUAGES.get(w) or (_WORD_LANGUAGES.get(_bare(w)) if not w.islower() or not w.isascii() else None)
                if k:
                    hits[i, k] += 1
        s = charmodel.scores(self.tables, lines)
        share = hits / np.array([len(w) for w in split], np.float32)[:, None]
        best = (s + WORD_WEIGHT * share).argmax(axis=1)
        at = np.arange(len(lines)), best
        over, own = (s[at] - self.floor[best]).tolist(), hits[at].tolist()
        out: list[str | None] = []
        for words, b, o, h in zip(split, best.tolist(), over, own):
            if o + WORD_MARGIN * min(h, 2) >= 0 and (h or sum(w.islower() for w in words) >= MIN_WORDS):
                out.append(self.languages[b])
            else:
                out.append(None)
        return out


#: how far below the 1 % quantile of its training sentences a sentence may score
FLOOR_MARGIN = 0.45
#: what each of the first two function words of a sentence adds to its score against the floor
WORD_MARGIN = 2.0
#: weight of the share of function words against the mean log probability
WORD_WEIGHT = 2.0


def training_lines(documents: DataFrame) -> dict[str, list[str]]:
    """Sentences per Latin language from at most SAMPLE_DOCUMENTS documents labelled with it.

    The label is often wrong, so only sentences most of whose function words
    belong to the labelled language are kept; the word lists themselves are
    always part, so a language without documents still has a model.
    """
    from pyspark.sql import Window

    lang = F.lower(F.trim("lang"))
    order = Window.partitionBy("l").orderBy("h", "doc_id")
    keyed = (
        documents.where(F.col("text").isNotNull() & lang.isin(*LATIN))
        .select("doc_id", lang.alias("l"), F.xxhash64("doc_id").alias("h"), "text")
    )
    counts = {r["l"]: r["n"] for r in keyed.groupBy("l").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for k in LATIN:
        share = F.when(F.col("l") == k, F.lit(min(1.0, 4.0 * SAMPLE_DOCUMENTS / max(counts.get(k, 1), 1)))).otherwise(share)
    # cut by hash first, so that the window sorts a few times the sample and never a whole language
    near = keyed.where(F.pmod("h", F.lit(1_000_003)) < share * 1_000_003)
    picked = (
        near.withColumn("text", F.substring("text", 1, SAMPLE_CHARS))
        .withColumn("rn", F.row_number().over(order))
        .where(F.col("rn") <= SAMPLE_DOCUMENTS)
        .select("l", "text")
        .collect()
    )
    lines: dict[str, list[str]] = {k: [v] for k, v in FUNCTION_WORDS.items()}
    for label, text in picked:
        for s in sentences(text):
            words = [w.lower() for w in _WORD.findall(s)]
            hits = {k: sum(w in f for w in words) for k, f in _FUNCTION.items()}
            top = max(hits.values())
            if hits[label] >= 1 and hits[label] == top and sum(v == top for v in hits.values()) == 1 and len(words) >= 5:
                lines[label].append(s.replace("\n", " "))
    return lines


def language_rows(files: DataFrame, documents: DataFrame) -> DataFrame:
    """(file_id, nl_lang, chars, file_chars): characters of sentences per file delivery and language."""
    # fitted once; the tables have 27**4 rows and a column for each language, whatever the input
    fitted = files.sparkSession.sparkContext.broadcast(Models(training_lines(documents)))
    st = T._parse_datatype_string("file_id bigint, nl_lang string, chars bigint, file_chars bigint")
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(st)

    def run(batches):
        models = fitted.value
        for batch in batches:
            names = batch.schema.names
            ids, exts, contents = (batch.column(names.index(n)).to_pylist() for n in ("file_id", "ext", "content"))
            total: dict[tuple[int, str], int] = {}
            latin: list[tuple[int, str]] = []
            for ext in EXTS:
                rows = [i for i, e in enumerate(exts) if e == ext and not syntax.broken(ext, contents[i])]
                where, found = texts(ext, [contents[i] for i in rows])
                for w, text in zip(where, found):
                    for s in sentences(text):
                        script = by_script(s)
                        if script is None:
                            words = ordinary_words(s)
                            if len(words) >= MIN_WORDS and 2 * len(words) >= len(s.split()):
                                latin.append((rows[w], s, " ".join(words)))
                        elif script:
                            k = (rows[w], script)
                            total[k] = total.get(k, 0) + len(s.strip())
            for (i, s, _), lang in zip(latin, models.classify([x[2] for x in latin])):
                if lang is not None:
                    total[i, lang] = total.get((i, lang), 0) + len(s.strip())
            keys = list(total)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[i] for i, _ in keys], arrow[0].type),
                    pa.array([k for _, k in keys], arrow[1].type),
                    pa.array([total[k] for k in keys], arrow[2].type),
                    pa.array([len(contents[i]) for i, _ in keys], arrow[3].type),
                ],
                schema=arrow,
            )

    return with_ext(files, EXTS).mapInArrow(run, st)


def languages_in_code(files: DataFrame, documents: DataFrame) -> DataFrame:
    """Distinct (file_id, nl_lang)."""
    return language_rows(files, documents).select("file_id", "nl_lang").distinct()


def language_shares(files: DataFrame, documents: DataFrame) -> DataFrame:
    """(file_id, nl_lang, chars, share): how much of each file is in each language."""
    rows = language_rows(files, documents)
    return (
        rows.groupBy("file_id", "nl_lang")
        .agg(F.max("chars").alias("chars"), F.max("file_chars").alias("n"))
        .select("file_id", "nl_lang", "chars", F.round(F.col("chars") / F.greatest("n", F.lit(1)), 6).alias("share"))
    )
