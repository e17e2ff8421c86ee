"""Vectorised pre-tokenisation: class arrays and a transition-function scan, no regex.

The split of ``public_tokenizers.PATTERN`` is a small automaton.  Every code
point becomes one of ten symbols (its class plus what one or two code points
of look-ahead decide); a symbol is a function on the eight states below.
Functions compose associatively, so the state before each code point is a
prefix scan: the text is cut into columns of ``BLOCK`` symbols, the columns'
functions are composed side by side, the column functions are scanned by
doubling, and a second sweep reads off where a piece starts.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np

# The code points with the Unicode property White_Space.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

# Symbols.  JOIN: a blank before a non-space; LAST: another space before a non-space; CON1, CON2: an
# apostrophe before a contraction of one or two letters; RESET: between texts.
LETTER, NUMBER, OTHER, SPACE, JOIN, LAST, CON1, CON2, RESET = range(9)
# States after a code point: nothing open, in letters, in numbers, in others, in spaces, after a joining
# blank, contraction with one or two letters to come.
NONE, IN_L, IN_N, IN_O, IN_S, AFTER, ONE, TWO = range(8)
BLOCK = 128


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    step, start = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    for symbol, state in ((LETTER, IN_L), (NUMBER, IN_N), (OTHER, IN_O), (CON1, ONE), (CON2, TWO), (SPACE, IN_S), (JOIN, AFTER)):
        step[symbol] = state
    for symbol, state in ((LETTER, IN_L), (NUMBER, IN_N), (OTHER, IN_O)):
        start[symbol, [state, AFTER]] = False
    for symbol in (CON1, CON2):  # inside a run of others an apostrophe is one of them
        start[symbol, [IN_O, AFTER]] = False
        step[symbol, [IN_O, AFTER]] = IN_O
    start[SPACE, IN_S] = False
    start[LETTER, [ONE, TWO]] = False
    step[LETTER, ONE], step[LETTER, TWO] = NONE, ONE
    return step, start


STEP, START = _automaton()


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Class of every code point: letter, number, other or space."""
    first = np.array([unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)])
    out = np.full(len(first), OTHER, np.uint8)
    out[first == "L"], out[first == "N"] = LETTER, NUMBER
    out[list(WHITE_SPACE)] = SPACE
    return out


def symbols(cp: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Symbols of the code points ``cp``; at ``breaks`` stands the RESET between texts."""
    sym = class_table()[cp]
    sym[breaks] = RESET
    nxt = np.append(sym[1:], np.uint8(RESET))
    space = sym == SPACE
    before_word = space & (nxt != SPACE) & (nxt != RESET)
    sym[before_word & (cp == 0x20)] = JOIN
    sym[before_word & (cp != 0x20)] = LAST
    at = np.flatnonzero((cp == 0x27) & (sym == OTHER))
    if len(at):
        far = np.append(cp, (0, 0)).astype(np.uint32)
        far[breaks] = 0
        a, b = far[at + 1], far[at + 2]
        one = np.isin(a, np.frombuffer("stmd".encode("utf-32-le"), np.uint32))
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        sym[at[one]], sym[at[two]] = CON1, CON2
    return sym


def scan_starts(sym: np.ndarray) -> np.ndarray:
    """True where a piece starts, by a blocked scan over composed transition functions."""
    n = len(sym)
    cols = -(-n // BLOCK)
    grid = np.full(cols * BLOCK, RESET, np.uint8)
    grid[:n] = sym
    grid = np.ascontiguousarray(grid.reshape(cols, BLOCK).T)  # row j holds the j-th symbol of each column
    step = STEP.reshape(-1)
    composed = np.repeat(np.arange(8, dtype=np.uint8)[:, None], cols, axis=1)
    for row in grid:
        composed = step[(row.astype(np.intp) * 8) + composed]
    shift = 1  # prefix compositions of whole columns by doubling
    at = np.arange(cols)
    while shift < cols:
        composed[:, shift:] = composed[composed[:, :-shift], at[None, shift:]]
        shift *= 2
    state = np.zeros(cols, np.uint8)
    state[1:] = composed[NONE, :-1]
    out = np.empty((BLOCK, cols), bool)
    start = START.reshape(-1)
    for j, row in enumerate(grid):
        key = (row.astype(np.intp) * 8) + state
        out[j] = start[key]
        state = step[key]
    return np.ascontiguousarray(out.T).reshape(-1)[:n]


def pieces(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct, codes, firsts): the k-th piece of all texts is ``distinct[codes[k]]``, and text ``i`` owns
    pieces ``firsts[i]:firsts[i + 1]``."""
    import pyarrow as pa

    joined = "\n".join(texts) + "\n"
    cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    breaks = np.cumsum(lengths + 1) - 1
    starts = scan_starts(symbols(cp, breaks))
    at = np.flatnonzero(starts)  # every RESET is a start as well: it ends the piece before it
    utf8 = joined.encode("utf-8")
    if len(utf8) == len(cp):
        offset = at
    else:
        width = 1 + (cp >= 0x80).astype(np.uint8) + (cp >= 0x800) + (cp >= 0x10000)
        offset = (np.cumsum(width, dtype=np.int64) - width)[at]
    offsets = np.append(offset, len(utf8)).astype(np.int32 if len(utf8) < 1 << 31 else np.int64)
    kind = pa.binary() if offsets.dtype == np.int32 else pa.large_binary()
    slices = pa.Array.from_buffers(kind, len(at), [None, pa.py_buffer(offsets), pa.py_buffer(utf8)]).dictionary_encode()
    is_break = np.zeros(len(cp), bool)
    is_break[breaks] = True
    real = ~is_break[at]
    firsts = np.append(0, np.searchsorted(at[real], breaks))
    return slices.dictionary.to_pylist(), slices.indices.to_numpy()[real], firsts
