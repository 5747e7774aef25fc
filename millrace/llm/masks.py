"""Comment and string masks by a table-driven automaton over Arrow buffers.

The UTF-8 bytes of all texts of a batch are mapped to byte classes with one
numpy lookup.  The texts are cut into blocks of :data:`BLOCK` bytes laid out
side by side, and the automaton advances all blocks by one byte per step, so a
step is one vectorised gather.  The state in which a block starts is found
first by running the blocks of long texts from every state at once and
composing the resulting maps, which keeps one very long text from running
byte by byte.
"""

from __future__ import annotations

import numpy as np

BLOCK = 2048
CODE, LINE_COMMENT, BLOCK_COMMENT, STRING = 0, 1, 2, 3

_BYTES = {ord("/"): 1, ord("*"): 2, ord('"'): 3, ord("'"): 4, ord("\\"): 5, ord("\n"): 6, ord("#"): 7, ord("`"): 8}
BYTE_CLASS = np.zeros(256, np.uint8)
for _b, _c in _BYTES.items():
    BYTE_CLASS[_b] = _c
_N_CLASSES = 9
_NAMES = (
    "code slash line block star"
    " d_open d_empty d d_esc dd dd_esc dd_1 dd_2"
    " s_open s_empty s s_esc ss ss_esc ss_1 ss_2"
    " t t_esc"
).split()
_ID = {n: i for i, n in enumerate(_NAMES)}
N_STATES = len(_NAMES)
KIND = np.zeros(N_STATES, np.uint8)
KIND[_ID["line"]] = LINE_COMMENT
KIND[[_ID["block"], _ID["star"]]] = BLOCK_COMMENT
for _n in _NAMES:
    if _n[0] in "dst" and _n not in ("slash", "star") and _n not in ("d_empty", "s_empty"):
        KIND[_ID[_n]] = STRING


def _automaton(slash: bool, hash_: bool, triple_d: bool, triple_s: bool, template: bool) -> np.ndarray:
    other, sl, st, dq, sq, bs, nl, ha, bt = range(_N_CLASSES)
    t = np.zeros((N_STATES, _N_CLASSES), np.uint8)
    s = _ID

    def row(name, default, **moves):
        t[s[name], :] = s[default]
        for key, target in moves.items():
            t[s[name], {"sl": sl, "st": st, "dq": dq, "sq": sq, "bs": bs, "nl": nl, "ha": ha, "bt": bt}[key]] = s[target]

    code = {"dq": "d_open", "sq": "s_open"}
    if slash:
        code["sl"] = "slash"
    if hash_:
        code["ha"] = "line"
    if template:
        code["bt"] = "t"
    row("code", "code", **code)
    row("slash", "code", **code, st="block")
    if slash:
        t[s["slash"], sl] = s["line"]
    row("line", "line", nl="code")
    row("block", "block", st="star")
    row("star", "block", st="star", sl="code")
    for q, key, triple in (("d", "dq", triple_d), ("s", "sq", triple_s)):
        row(f"{q}_open", q, **{key: f"{q}_empty", "bs": f"{q}_esc", "nl": "code"})
        row(f"{q}_empty", "code", **{**code, key: f"{q}{q}" if triple else f"{q}_open"})
        row(q, q, **{key: "code", "bs": f"{q}_esc", "nl": "code"})
        row(f"{q}_esc", q)
        row(q * 2, q * 2, **{key: f"{q}{q}_1", "bs": f"{q}{q}_esc"})
        row(f"{q}{q}_esc", q * 2)
        row(f"{q}{q}_1", q * 2, **{key: f"{q}{q}_2", "bs": f"{q}{q}_esc"})
        row(f"{q}{q}_2", q * 2, **{key: "code", "bs": f"{q}{q}_esc"})
    row("t", "t", bt="code", bs="t_esc")
    row("t_esc", "t")
    return t


AUTOMATA = {
    "java": _automaton(True, False, True, False, False),
    "js": _automaton(True, False, False, False, True),
    "py": _automaton(False, True, True, True, False),
}


def _advance(table: np.ndarray, classes: np.ndarray, state: np.ndarray, trace: bool):
    """Step ``classes`` (bytes x blocks) from ``state`` (.. x blocks)."""
    flat = table.ravel()
    out = np.empty(classes.shape, np.uint8) if trace else None
    state = state.astype(np.intp)
    for i in range(classes.shape[0]):
        state = flat[state * _N_CLASSES + classes[i]]
        if trace:
            out[i] = state
        state = state.astype(np.intp)
    return state, out


def kinds(language: str, buffer: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The kind of every byte of ``buffer``; text ``i`` is ``buffer[offsets[i]:offsets[i + 1]]``."""
    table = AUTOMATA[language]
    total = int(offsets[-1] - offsets[0])
    if total == 0:
        return np.zeros(0, np.uint8)
    lengths = np.diff(offsets)
    blocks = -(-lengths // BLOCK)
    owner = np.repeat(np.arange(len(lengths)), blocks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = offsets[owner] + nth * BLOCK
    size = np.minimum(BLOCK, offsets[owner + 1] - begin)
    order = np.argsort(-size, kind="stable")
    pad = np.zeros(int(begin.max()) + BLOCK + 1, np.uint8)
    cls = BYTE_CLASS[buffer]
    pad[: len(cls)] = cls
    grid = pad[begin[order][None, :] + np.arange(int(size.max()))[:, None]]
    start = np.zeros(len(owner), np.intp)
    long_ = np.flatnonzero(blocks > 1)
    if len(long_):
        place = np.empty(len(order), np.intp)
        place[order] = np.arange(len(order))
        full = np.flatnonzero((size == BLOCK) & (blocks[owner] > 1))
        cols = grid[:, place[full]]
        every = np.repeat(np.arange(N_STATES, dtype=np.intp)[:, None], len(full), axis=1)
        ends, _ = _advance(table, cols, every, False)
        at = {int(b): k for k, b in enumerate(full)}
        first = np.cumsum(blocks) - blocks
        for text in long_:
            state = 0
            for b in range(int(first[text]), int(first[text] + blocks[text])):
                start[b] = state
                if b in at:
                    state = int(ends[state, at[b]])
    out = np.zeros(len(pad), np.uint8)
    # blocks are sorted by size: step only those still running
    state = start[order]
    sizes = size[order]
    flat = table.ravel()
    running = np.searchsorted(-sizes, -np.arange(int(sizes[0])) - 1, side="right")
    base = begin[order]
    for i in range(int(sizes[0])):
        n = int(running[i])
        s = flat[state[:n] * _N_CLASSES + grid[i, :n]]
        out[base[:n] + i] = s
        state = s.astype(np.intp)
    return KIND[out[: len(buffer)]]


def runs(kind: np.ndarray, offsets: np.ndarray):
    """(text, start, end, kind) arrays of the maximal comment and string runs."""
    if not len(kind):
        z = np.zeros(0, np.int64)
        return z, z, z, z
    edge = np.flatnonzero(np.diff(kind)) + 1
    cut = np.unique(np.concatenate([edge, offsets[:-1], offsets[1:]]))
    cut = cut[cut <= len(kind)]
    begin, end = cut[:-1], cut[1:]
    keep = kind[begin] > 0
    begin, end = begin[keep], end[keep]
    text = np.searchsorted(offsets, begin, side="right") - 1
    return text, begin, end, kind[begin]
