"""Interpolated Kneser-Ney character models over a folded 27-letter alphabet."""

from __future__ import annotations

import unicodedata

import numpy as np

ORDER = 4
SYMBOLS = 27
DISCOUNT = 0.75
_FOLD = str.maketrans({"ł": "l", "Ł": "l", "ß": "s", "ø": "o", "Ø": "o", "æ": "ae", "œ": "oe", "’": "'"})
_TO_SYMBOL = np.zeros(256, np.uint8)
for _i in range(26):
    _TO_SYMBOL[97 + _i] = _TO_SYMBOL[65 + _i] = _i + 1
_BREAK = 255
_TO_SYMBOL[ord("\n")] = _BREAK


def fold(text: str) -> np.ndarray:
    """Symbols of ``text`` without case and accents; line feeds stay as breaks."""
    ascii_ = unicodedata.normalize("NFKD", text.translate(_FOLD)).encode("ascii", "ignore")
    return _TO_SYMBOL[np.frombuffer(ascii_, np.uint8)]


def _grams(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order-4 gram codes ending at each symbol and the line each belongs to; lines start after three blanks."""
    breaks = symbols == _BREAK
    line = np.cumsum(breaks) - breaks
    s = np.where(breaks, 0, symbols).astype(np.int32)
    n = len(s)
    code = s.copy()
    start = np.zeros(n, np.int64)
    idx = np.flatnonzero(breaks) + 1
    start[idx[idx < n]] = idx[idx < n]
    start = np.maximum.accumulate(start)
    pos = np.arange(n) - start
    mult = SYMBOLS
    for k in range(1, ORDER):
        prev = np.zeros(n, np.int32)
        prev[k:] = s[:-k] if k < n else 0
        prev[pos < k] = 0
        code += prev * mult
        mult *= SYMBOLS
    keep = ~breaks
    return code[keep], line[keep]


def train(lines: list[str]) -> np.ndarray:
    """Log probabilities of all 27**4 grams, interpolated down to uniform."""
    codes, _ = _grams(fold("\n".join(lines)))
    c4 = np.bincount(codes, minlength=SYMBOLS**ORDER).astype(np.float64).reshape((SYMBOLS,) * ORDER)
    p = np.full((SYMBOLS,), 1.0 / SYMBOLS)
    counts = [c4]
    for _ in range(ORDER - 1):
        counts.append((counts[-1] > 0).sum(axis=0).astype(np.float64))  # continuation counts
    for c in reversed(counts):
        total = c.sum(axis=-1, keepdims=True)
        kinds = (c > 0).sum(axis=-1, keepdims=True)
        safe = np.where(total > 0, total, 1)
        back = np.where(total > 0, DISCOUNT * kinds / safe, 1.0)
        p = np.maximum(c - DISCOUNT, 0) / safe + back * p
    return np.log(p).ravel().astype(np.float32)


def scores(tables: np.ndarray, lines: list[str]) -> np.ndarray:
    """Mean log probability per symbol of each line under each model (lines x models)."""
    codes, line = _grams(fold("\n".join(x.replace("\n", " ") for x in lines)))
    out = np.zeros((len(lines), tables.shape[1]), np.float32)
    count = np.bincount(line, minlength=len(lines))[: len(lines)]
    step = 1 << 20
    for i in range(0, len(codes), step):
        g, ln = tables[codes[i : i + step]], line[i : i + step]
        first = np.flatnonzero(np.r_[True, ln[1:] != ln[:-1]])
        out[ln[first]] += np.add.reduceat(g, first, axis=0)
    return out / np.maximum(count, 1)[:, None]
