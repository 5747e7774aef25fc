"""String functions as Columns; NULL stays NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_whitespace(c) -> Column:
    """Every run of white space becomes one blank; the ends are not trimmed."""
    return F.regexp_replace(_col(c), r"\s+", " ")


def strip_tags(c) -> Column:
    """Remove ``<...>``; a ``<`` that is never closed stays."""
    return F.regexp_replace(_col(c), "<[^>]*>", "")


def strip_symbols(c) -> Column:
    """Remove the punctuation that carries no meaning in a key."""
    return F.regexp_replace(_col(c), r"[.,:;!?\-\[\]()\s]", "")


def html_escape(c) -> Column:
    c = _col(c)
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    return c


def disable_tags(c) -> Column:
    """Escape ``<`` and ``>`` only."""
    return F.replace(F.replace(_col(c), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def html_text(c) -> Column:
    """Plain text of HTML: scripts, styles and tags dropped, blanks folded."""
    c = F.regexp_replace(_col(c), r"(?is)<(script|style)\b.*?</\1>", " ")
    c = F.regexp_replace(c, r"(?i)<(br|/p|/div|/li|/tr|/h[1-6])\b[^>]*>", " ")
    return F.trim(normalize_whitespace(strip_tags(c)))


def tokenize(c, pattern: str = r"\W+") -> Column:
    return F.filter(F.split(_col(c), pattern), lambda x: F.length(x) > 0)


def alphabetic_tokens(c) -> Column:
    return F.regexp_extract_all(_col(c), F.lit("([A-Za-z]+)"), F.lit(1))


def cjk_bigrams(c) -> Column:
    """Overlapping pairs of the characters, as analyzers index Han text."""
    c = _col(c)
    n = F.length(c)
    return F.when(n < 2, F.array(c)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substr(c, i, F.lit(2))))


def extract_ints(c) -> Column:
    return F.transform(F.regexp_extract_all(_col(c), F.lit(r"(-?\d+)"), F.lit(1)), lambda x: x.try_cast("int"))


def isbn13(c) -> Column:
    """ISBN-13 of a 10- or 13-digit ISBN; other lengths give NULL."""
    digits = F.upper(F.regexp_replace(_col(c), r"[^0-9Xx]", ""))
    core = F.concat(F.lit("978"), F.substring(digits, 1, 9))
    sum12 = F.aggregate(
        F.sequence(F.lit(1), F.lit(12)),
        F.lit(0),
        lambda acc, i: acc + F.substr(core, i, F.lit(1)).try_cast("int") * F.when(i % 2 == 1, 1).otherwise(3),
    )
    check = (F.lit(10) - sum12 % 10) % 10
    return (
        F.when(F.length(digits) == 13, digits)
        .when(F.length(digits).isin(9, 10), F.concat(core, check.cast("string")))
    )


def field_parts(c) -> Column:
    """``name|TYPE|format`` as a struct."""
    c = _col(c)
    part = lambda i: F.nullif(F.split_part(c, F.lit("|"), F.lit(i)), F.lit(""))
    return F.struct(part(1).alias("name"), part(2).alias("type"), part(3).alias("format"))


def bind(statement: str, values: list) -> str:
    """A statement for the log: each ``?`` replaced by its quoted value or null."""
    out, it = [], iter(values)
    for piece in statement.split("?")[:-1]:
        v = next(it, None)
        out += [piece, "null" if v is None else "'" + str(v).replace("'", "''") + "'"]
    return "".join([*out, statement.split("?")[-1]])


def fixed_bytes(c, length: int) -> Column:
    """Exactly ``length`` bytes of Latin text: padded with blanks or cut."""
    return F.encode(F.substring(F.rpad(_col(c), length, " "), 1, length), "ISO-8859-1")


def clean_base_name(c) -> Column:
    """File name without directories and special characters."""
    return F.regexp_replace(F.substring_index(_col(c), "/", -1), r"[^\w. ]", "")


def table_qualifier(c) -> Column:
    """``catalog.schema.table`` read from the right."""
    parts = F.split(_col(c), r"\.")
    at = lambda i: F.try_element_at(parts, F.lit(i))
    return F.struct(at(-3).alias("catalog"), at(-2).alias("schema"), at(-1).alias("table"))


def compare_sign(a, b) -> Column:
    a, b = _col(a), _col(b)
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


def digest(c, algorithm: str, form: str = "text") -> Column:
    """Lower-case hex digest (MD5, SHA-1, SHA-256, SHA-384, SHA-512) of a text, or of the bytes a hex or base64 text stands for."""
    col = _col(c)
    data = {"text": lambda: F.encode(col.cast("string"), "UTF-8"), "hex": lambda: F.unhex(col), "base64": lambda: F.unbase64(col)}[form]()
    name = algorithm.upper().replace("-", "")
    if name == "MD5":
        return F.md5(data)
    if name == "SHA1":
        return F.sha1(data)
    if name in ("SHA256", "SHA384", "SHA512"):
        return F.sha2(data, int(name[3:]))
    raise ValueError(f"unknown digest: {algorithm}")


def ascii_fold(c) -> Column:
    """Accents dropped for the Latin letters that have a plain form; anything else beyond ASCII becomes ``?``."""
    # Accented letters and their plain forms.
    accented = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿąćęłńśźżÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝĄĆĘŁŃŚŹŻ"
    plain = "aaaaaaceeeeiiiinooooouuuuyyacelnszzAAAAAACEEEEIIIINOOOOOUUUUYACELNSZZ"
    return F.regexp_replace(F.translate(_col(c), accented, plain), r"[^\x00-\x7F]", "?")


def char_bag(c) -> Column:
    """Map of each character to its number in the text."""
    chars = F.filter(F.split(_col(c), ""), lambda x: F.length(x) > 0)
    return F.map_from_entries(F.transform(F.array_distinct(chars), lambda k: F.struct(k, F.size(F.filter(chars, lambda x: x == k)))))


def s_stem(c) -> Column:
    """Plural endings removed: ``-ies`` to ``-y``, ``-es`` after a hissing sound, a single ``-s``."""
    c = F.lower(_col(c))
    return (
        F.when(c.rlike("[^ae]ies$"), F.regexp_replace(c, "ies$", "y"))
        .when(c.rlike("(s|x|z|ch|sh)es$"), F.regexp_replace(c, "es$", ""))
        .when(c.rlike("[^us]s$"), F.regexp_replace(c, "s$", ""))
        .otherwise(c)
    )
