"""P7 - evaluation texts inside training text.

Both sides are reduced to lower-case words joined by single blanks.  The items
are indexed by their character q-grams; every document is read once for each
block of items and its q-grams, sampled at a fixed stride, are looked up.  A
block holds at most ``BLOCK_CHARS`` characters of items, so an index of any
number of items fits the workers; an item table of ordinary size is one block.
  Hits are counted per document, item and overlapping diagonal band; by the
q-gram lemma a shared passage of ``length`` characters with at most ``edits``
edits keeps at least ``(length + 1 - q * (1 + edits)) / stride`` sampled hits
in one band, so bands below that are dropped.  The regions left are verified by
alignment within the band: :func:`equal_stretch` where no edits are allowed, so
that :func:`leaks_exact` asks for ``MIN_WORDS`` consecutive equal words, and
:func:`near_stretch` for :func:`leaks_near`, which allows an edit budget.

Nothing is sampled or capped among documents or items: the stride only thins
the q-grams of a document to the number the lemma still guarantees.

Defined results: null or empty text shares nothing; an item shorter than
``MIN_WORDS`` words can not leak; an empty item table gives no rows; documents
repeated under new ids are reported under each.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sources import map_rows, spread

MIN_WORDS = 20
#: characters of the items that are sent to every task at a time; more items are searched in several blocks
BLOCK_CHARS = 8_000_000
#: pairs of equal q-grams that are held at a time; documents that share more are taken in several steps
STEP_HITS = 2_000_000
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    joined = "\n".join(texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    return codes, np.concatenate([[0], np.cumsum(lengths)])


_BASE = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """Hash of the ``q`` (a power of two) characters from each position on, by doubling."""
    h = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    width, base = 1, _BASE
    with np.errstate(over="ignore"):
        while width < q:
            h = h[:-width] * base + h[width:] if len(h) > width else h[:0]
            base = base * base + np.uint64(2)
            width *= 2
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return h


class ItemIndex:
    """The q-grams of all items, sorted by hash, with a bit table in front."""

    def __init__(self, rows: list[tuple[int, str]], q: int, enough: Callable[[str], bool]):
        kept = [(i, " ".join(words(t))) for i, t in rows if t]
        kept = [(i, t) for i, t in kept if enough(t)]
        self.q = q
        self.ids = [i for i, _ in kept]
        self.texts = [t for _, t in kept]
        self.codes, self.offsets = _codes(self.texts) if kept else (np.zeros(0, np.uint32), np.zeros(1, np.int64))
        h = gram_hashes(self.codes, q)
        breaks = np.cumsum(self.codes == 10)
        inside = breaks[q - 1 :] == np.concatenate([[0], breaks[: len(h) - 1]]) if len(h) else np.zeros(0, bool)
        at = np.flatnonzero(inside)
        order = np.argsort(h[at], kind="stable")
        self.hash = h[at][order]
        self.at = at[order]
        self.item = np.searchsorted(self.offsets, self.at, side="right") - 1
        self.unique, self.first, self.count = np.unique(self.hash, return_index=True, return_counts=True)
        self.shift = np.uint64(64 - min(28, max(22, int(len(self.hash)).bit_length() + 3)))
        self.bits = np.zeros(1 << (64 - int(self.shift)), bool)
        self.bits[(self.hash >> self.shift).astype(np.int64)] = True


def shingles(w: list[str], n: int = MIN_WORDS) -> set:
    return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}


def aligned(a: str, b: str, edits: int) -> int | None:
    """Edits between two stretches on a diagonal band of half width ``edits``, None beyond the budget."""
    if edits == 0:
        return 0 if a == b else None
    if abs(len(a) - len(b)) > edits:
        return None
    far = edits + 1
    prev = {j: j for j in range(min(edits, len(b)) + 1)}
    for i, x in enumerate(a, 1):
        cur = {}
        for j in range(max(0, i - edits), min(len(b), i + edits) + 1):
            if j == 0:
                cur[j] = i
                continue
            v = prev.get(j - 1, far) + (x != b[j - 1])
            cur[j] = min(v, prev.get(j, far) + 1, cur.get(j - 1, far) + 1)
        if min(cur.values()) > edits:
            return None
        prev = cur
    d = prev.get(len(b), far)
    return d if d <= edits else None


def _reach(doc: str, item: str, at: int, i: int, edits: int, step: int) -> list[tuple[int, int]]:
    """For 0..edits edits, the most item characters that align from ``(at, i)`` on, and the document characters used.

    Each number of edits keeps the furthest point of every diagonal of the band,
    which is all an alignment of least edits needs.
    """
    n, m = (len(doc) - at, len(item) - i) if step > 0 else (at, i)

    def slide(x: int, y: int) -> tuple[int, int]:
        while x < n and y < m and (doc[at + x] == item[i + y] if step > 0 else doc[at - 1 - x] == item[i - 1 - y]):
            x += 1
            y += 1
        return x, y

    front = {0: slide(0, 0)}  # diagonal (document less item) -> furthest point
    best = [front[0]]
    out = [(best[0][1], best[0][0])]
    for _ in range(edits):
        points: dict[int, tuple[int, int]] = {}
        for d, (x, y) in front.items():
            for dx, dy in ((1, 1), (1, 0), (0, 1)):
                if x + dx <= n and y + dy <= m:
                    p = slide(x + dx, y + dy)
                    k = d + dx - dy
                    if k not in points or points[k][1] < p[1]:
                        points[k] = p
        for d, p in points.items():
            if d not in front or front[d][1] < p[1]:
                front[d] = p
        x, y = max(front.values(), key=lambda p: p[1])
        out.append((y, x))
    return out


def near_stretch(doc: str, item: str, at: int, diagonal: int, edits: int) -> tuple[int, int]:
    """(characters of the item, edits) of the longest alignment through ``at`` on a diagonal with at most ``edits`` edits."""
    i = at - diagonal
    left, right = _reach(doc, item, at, i, edits, -1), _reach(doc, item, at, i, edits, 1)
    return max(((left[k][0] + right[e][0], -(k + e)) for k in range(edits + 1) for e in range(edits + 1 - k)), default=(0, 0))


def equal_stretch(doc: str, item: str, at: int, diagonal: int) -> tuple[int, int]:
    """The longest equal stretch of ``doc`` through ``at`` on a diagonal: the alignment with no edits."""
    i = at - diagonal
    left = 0
    while at - left > 0 and i - left > 0 and doc[at - left - 1] == item[i - left - 1]:
        left += 1
    right, most = 0, min(len(doc) - at, len(item) - i)
    while right < most:
        step = min(64, most - right)
        if doc[at + right : at + right + step] == item[i + right : i + right + step]:
            right += step
            continue
        while right < most and doc[at + right] == item[i + right]:
            right += 1
        break
    return at - left, at + right


def whole_words(text: str, a: int, b: int) -> tuple[int, int]:
    """Where the words of ``text`` that lie wholly in ``[a, b)`` begin and end (``a >= b`` where there is none)."""
    if a > 0 and text[a - 1] != " ":
        cut = text.find(" ", a, b)
        a = cut + 1 if cut >= 0 else b
    if b < len(text) and text[b] != " ":
        cut = text.rfind(" ", a, b)
        b = cut if cut >= 0 else a
    return a, b


def shared_words(doc: str, item: str, at: int, diagonal: int) -> int:
    """Consecutive words that lie wholly in the equal stretch through ``at`` on both sides."""
    a, b = equal_stretch(doc, item, at, diagonal)
    c, d = whole_words(item, a - diagonal, b - diagonal)
    a, b = whole_words(doc, a, b)
    a, b = max(a, c + diagonal), min(b, d + diagonal)
    return doc.count(" ", a, b) + 1 - doc.startswith(" ", a) - (doc[b - 1] == " ") if a < b else 0


def candidate_regions(index: ItemIndex, texts: list[str], stride: int, band: int, edits: int, chars: int = 0):
    """(document, item, start, end, first hit, its diagonal) of the regions whose bands hold enough q-grams.

    ``texts`` are documents in normal form.  A region is widened by the
    characters the stride may have missed.  Without edits it is dropped unless
    it could hold ``MIN_WORDS`` words; with edits unless it holds the sampled
    q-grams that ``chars`` characters keep by the lemma, and there is a row for
    each run of hits on one of its diagonals, since any may lie on the
    alignment that counts.
    """
    q = index.q
    none = (np.zeros(0, np.int64),) * 6
    if not len(index.hash) or not texts:
        return none
    codes, offsets = _codes(texts)
    h = gram_hashes(codes, q)
    local = np.arange(len(h)) - offsets[np.searchsorted(offsets, np.arange(len(h)), side="right") - 1] if len(h) else h
    probe = np.flatnonzero((local % stride == 0) & index.bits[(h >> index.shift).astype(np.int64)]) if len(h) else np.zeros(0, np.int64)
    if not len(probe):
        return none
    k = np.searchsorted(index.unique, h[probe])
    k[k == len(index.unique)] = 0
    hit = index.unique[k] == h[probe]
    probe, k = probe[hit], k[hit]
    if not len(probe):
        return none
    n = index.count[k]
    # a q-gram many items share has a row for each of them: whole documents are taken until a step is full
    owner = np.searchsorted(offsets, probe, side="right") - 1
    total = np.cumsum(n)
    steps, begin = [], 0
    while begin < len(probe):
        end = max(int(np.searchsorted(total, (total[begin - 1] if begin else 0) + STEP_HITS)), begin + 1)
        end = int(np.searchsorted(owner, owner[end - 1], side="right"))
        steps.append(_regions(index, codes, offsets, probe[begin:end], k[begin:end], n[begin:end], q, stride, band, edits, chars))
        begin = end
    return tuple(np.concatenate(x) for x in zip(*steps))


def _regions(index, codes, offsets, probe, k, n, q, stride, band, edits, chars):
    rows = np.repeat(probe, n)
    ordinal = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
    entry = np.repeat(index.first[k], n) + ordinal
    item, place = index.item[entry], index.at[entry]
    doc = np.searchsorted(offsets, rows, side="right") - 1
    diagonal = (rows - offsets[doc]) - (place - index.offsets[item])
    # overlapping bands: each diagonal lies in two bands of width ``band``
    if band > 1:
        half = band // 2
        number = np.concatenate([diagonal // half, diagonal // half - 1])
        doc, item, rows, diagonal = np.tile(doc, 2), np.tile(item, 2), np.tile(rows, 2), np.tile(diagonal, 2)
    else:
        number = diagonal
    order = np.lexsort((rows, number, item, doc))
    doc, item, number, rows, diagonal = doc[order], item[order], number[order], rows[order], diagonal[order]
    # hits of one band that follow within reach of each other form a region; an edit spoils q - 1 + stride positions
    reach = stride if edits == 0 else stride + (q + stride) * edits
    new = np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (number[1:] != number[:-1]) | (rows[1:] - rows[:-1] > reach)]
    start = np.flatnonzero(new)
    end = np.r_[start[1:], len(rows)] - 1
    margin = stride + (q * edits)
    begin = np.maximum(rows[start] - margin, offsets[doc[start]])
    stop = np.minimum(rows[end] + q + margin, offsets[doc[start] + 1] - 1)
    if edits == 0:
        blanks = np.concatenate([[0], np.cumsum((codes == 32) | (codes == 10))])
        keep = blanks[np.minimum(stop + 1, len(codes))] - blanks[np.maximum(begin - 1, 0)] >= MIN_WORDS
        s, region = start[keep], np.flatnonzero(keep)
    else:
        # each edit spoils the sampled q-grams that overlap it
        need = max(1, (chars - edits - q + 1) // stride - edits * -(-q // stride))
        region = np.cumsum(new) - 1
        order = np.lexsort((rows, diagonal, region))
        g, d, r = region[order], diagonal[order], rows[order]
        run = np.r_[True, (g[1:] != g[:-1]) | (d[1:] != d[:-1]) | (r[1:] - r[:-1] > stride)]
        s = order[run]
        region = region[s]
        # as many different places must lie within the reach of one passage
        place = np.r_[True, (rows[1:] != rows[:-1]) | new[1:]]
        r, g = rows[place], (np.cumsum(new) - 1)[place]
        full = np.zeros(len(start), bool)
        if len(r) >= need:
            near = (g[need - 1 :] == g[: len(g) - need + 1]) & (r[need - 1 :] - r[: len(r) - need + 1] <= chars + edits - q)
            full[g[: len(near)][near]] = True
        keep = full[region]
        s, region = s[keep], region[keep]
    base = offsets[doc[s]]
    return doc[s], item[s], begin[region] - base, stop[region] - base, rows[s] - base, diagonal[s]


_INDEX: dict[tuple, ItemIndex] = {}


def _index(rows: list[tuple[int, str]], q: int, least: int, enough: Callable[[str], bool]) -> ItemIndex:
    key = (q, least, len(rows), zlib.crc32(repr(rows).encode("utf-8", "replace")))
    if key not in _INDEX:
        _INDEX.clear()
        _INDEX[key] = ItemIndex(rows, q, enough)
    return _INDEX[key]


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about BLOCK_CHARS characters, by a hash of the id; each is collected by itself."""
    chars = items.agg(F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0))).first()[0]
    n = max(1, -(-chars // BLOCK_CHARS))
    rows = items.where(F.col("text").isNotNull()).select("item_id", "text")
    for b in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) if n > 1 else rows
        yield [(r["item_id"], r["text"]) for r in part.collect()]


def _search(documents: DataFrame, items: DataFrame, q: int, least: int, verify: Callable, schema: str) -> DataFrame:
    """All documents against every block of items; ``verify(index, ids, texts)`` gives the columns of ``schema``.

    ``least`` is the number of characters a text needs to share anything; 0 asks for MIN_WORDS words.
    """

    def enough(text: str) -> bool:
        return len(text) >= least if least else text.count(" ") + 1 >= MIN_WORDS

    context = documents.sparkSession.sparkContext
    src = spread(documents.where(F.col("text").isNotNull()).select("doc_id", "text"), "doc_id")
    found = []
    for block in _blocks(items):
        rows = context.broadcast(block)

        def scan(cols: dict, rows=rows) -> dict:
            index = _index(rows.value, q, least, enough)
            ids, texts = [], []
            for doc_id, text in zip(cols["doc_id"], cols["text"]):
                normal = " ".join(words(text))
                if normal and enough(normal):
                    ids.append(doc_id)
                    texts.append(normal)
            return verify(index, ids, texts)

        found.append(map_rows(src, scan, schema))
    return reduce(DataFrame.unionByName, found)


def leaks_exact(documents: DataFrame, items: DataFrame, q: int = 32, stride: int = 8) -> DataFrame:
    """Distinct (item_id, doc_id) of documents sharing MIN_WORDS consecutive words with an item.

    MIN_WORDS one-letter words joined by blanks have ``2 * MIN_WORDS - 1``
    characters, so ``q + stride - 1`` may not exceed that for the search to be
    complete; the defaults just meet it.
    """
    if q + stride - 1 > 2 * MIN_WORDS - 1:
        raise ValueError("q and stride would let a passage through unseen")

    def verify(index: ItemIndex, ids: list, texts: list[str]) -> dict:
        out: dict[str, list] = {"item_id": [], "doc_id": []}
        found = set()
        for d, i, _, _, at, diagonal in zip(*(x.tolist() for x in candidate_regions(index, texts, stride, 1, 0))):
            if (d, i) not in found and shared_words(texts[d], index.texts[i], at, diagonal) >= MIN_WORDS:
                found.add((d, i))
                out["item_id"].append(index.ids[i])
                out["doc_id"].append(ids[d])
        return out

    return _search(documents, items, q, 0, verify, "item_id bigint, doc_id bigint").distinct()


#: characters of an item that must align, and the edits they may hold, for a passage that was reshaped
NEAR_CHARS = 120
NEAR_EDITS = 3


def leaks_near(documents: DataFrame, items: DataFrame, chars: int = NEAR_CHARS, edits: int = NEAR_EDITS, q: int = 16, stride: int = 8) -> DataFrame:
    """(item_id, doc_id, chars, edits): documents in which ``chars`` characters of an item stand with at most ``edits`` edits.

    ``edits`` edits leave a stretch of ``chars`` characters at least one equal
    piece of ``(chars - edits) // (edits + 1)`` of them, which must hold a
    sampled q-gram; otherwise the parameters are refused.  Bands are wider than
    the budget by half and overlap by half, so that an alignment lies in one.
    The longest alignment through each region's hits is given.
    """
    if (chars - edits) // (edits + 1) < q + stride - 1:
        raise ValueError("q and stride would let a passage through unseen")
    band = 2 * max(2, edits + 1)

    def verify(index: ItemIndex, ids: list, texts: list[str]) -> dict:
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for d, i, _, _, at, diagonal in zip(*(x.tolist() for x in candidate_regions(index, texts, stride, band, edits, chars))):
            if best.get((d, i), (0, 0))[0] >= len(index.texts[i]):
                continue
            size, spent = near_stretch(texts[d], index.texts[i], at, diagonal, edits)
            if size >= chars:
                best[d, i] = max(best.get((d, i), (0, -edits)), (size, spent))
        return {
            "item_id": [index.ids[i] for _, i in best],
            "doc_id": [ids[d] for d, _ in best],
            "chars": [n for n, _ in best.values()],
            "edits": [-e for _, e in best.values()],
        }

    near = _search(documents, items, q, chars - edits, verify, "item_id bigint, doc_id bigint, chars int, edits int")
    longest = F.max(F.struct("chars", (-F.col("edits")).alias("kept"))).alias("m")
    return near.groupBy("item_id", "doc_id").agg(longest).select("item_id", "doc_id", "m.chars", (-F.col("m.kept")).alias("edits"))


def leak_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, suite, documents): how many documents hold a passage of each item, leaked or not."""
    found = leaks_exact(documents, items).groupBy("item_id").agg(F.count("*").alias("n"))
    return items.select("item_id", "suite").join(found, "item_id", "left").select("item_id", "suite", F.coalesce("n", F.lit(0)).alias("documents"))
