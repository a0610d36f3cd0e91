"""Burrows-Wheeler transforms of collections of short strings, and their merge by interleave refinement.

Symbols are bytes plus one; 0 ends each string. UTF-8 has no byte above 0xF7, so a symbol fits a byte. The end marks of a
collection are ordered by string number, those of several collections by collection.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sorted suffixes of strings laid end to end (text: symbols with a 0 behind each string), by prefix doubling.

    A suffix ends at its string's end mark; equal suffixes of different strings come in the order of the strings.
    """
    n = len(text)
    # the first eight symbols as one number, nothing behind an end mark
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    key, live = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(8):
        part = padded[k : k + n] * live
        key = key << np.uint64(8) | part
        live = part > 0
    left = np.empty(n, np.int64)  # symbols to the end of the string, its mark included
    left[:] = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(n) + 1
    done = 8
    order = np.argsort(key)
    rank = _ranks(key[order], order)
    while done < left.max(initial=0):
        follow = np.zeros(n, np.int64)
        has = np.flatnonzero(left > done)
        follow[has] = rank[has + done] + 1
        key = rank.astype(np.uint64) << np.uint64(32) | follow.astype(np.uint64)
        order = np.argsort(key)
        rank = _ranks(key[order], order)
        done *= 2
    # equal suffixes take the order of their strings; with that, all keys differ
    return np.argsort(rank.astype(np.uint64) << np.uint64(32) | np.arange(n, dtype=np.uint64))


def _ranks(sorted_keys: np.ndarray, order: np.ndarray) -> np.ndarray:
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(np.concatenate([[False], sorted_keys[1:] != sorted_keys[:-1]]))
    return rank


def transform(strings: list[bytes]) -> np.ndarray:
    """The transform of a collection: the symbol before each sorted suffix."""
    if not strings:
        return np.empty(0, np.uint8)
    joined = np.frombuffer(b"\xff".join(strings) + b"\xff", np.uint8)
    text = joined + np.uint8(1)  # 0xFF becomes the end mark 0
    ends = np.flatnonzero(text == 0)
    order = suffix_order(text, ends)
    before = np.concatenate([text[-1:], text[:-1]])
    return before[order]


def last_to_first(bwt: np.ndarray) -> np.ndarray:
    """For each row the row of the suffix one symbol longer (for an end mark: some end-mark row)."""
    order = np.argsort(bwt, kind="stable")
    out = np.empty(len(bwt), np.int64)
    out[order] = np.arange(len(bwt))
    return out


def places(bwt: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of each row, by walking all strings backwards from their end marks at once."""
    step = last_to_first(bwt)
    string = np.empty(len(bwt), np.int32)
    offset = np.empty(len(bwt), np.int32)
    rows, who = np.arange(len(lengths)), np.arange(len(lengths))
    at = lengths.astype(np.int64).copy()
    while len(rows):
        string[rows], offset[rows] = who, at[who]
        go = at[who] > 0
        rows, who = step[rows[go]], who[go]
        at[who] -= 1
    return string, offset


def merge_classes(bwts: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, class ids) of the suffixes that share their first `depth` symbols with another one.

    The transforms are merged by refining their interleave: round k orders all suffixes by their first k symbols, from the
    order by k - 1 symbols, by one stable distribution of the symbols before them; the common prefix of two neighbours is
    the round before the one that parts them. Only transforms are read, no text and no suffix is sorted again. Suffixes
    that have parted from all others, or whose strings have ended, can't share `depth` symbols any more and leave.
    Rows number the transforms laid end to end; equal class ids mean equal prefixes.
    """
    bwt = np.concatenate(bwts)
    bases = np.cumsum([0, *map(len, bwts)])
    kind = np.int32 if len(bwt) < 2**31 else np.int64
    step = np.concatenate([(last_to_first(b) + base).astype(kind) for b, base in zip(bwts, bases)])
    rows = np.arange(len(bwt), dtype=kind)
    ids = np.zeros(len(bwt), kind)
    for _ in range(depth):
        symbols = bwt[rows]
        order = np.argsort(symbols, kind="stable")
        symbols, before = symbols[order], ids[order]
        rows = step[rows[order]]
        # neighbours part where their symbols or their classes a round before differ
        parted = np.ones(len(rows) + 1, bool)
        parted[1:-1] = (symbols[1:] != symbols[:-1]) | (before[1:] != before[:-1])
        stay = ~(parted[1:] & parted[:-1]) & (symbols > 0)
        ids = np.cumsum(parted[:-1], dtype=kind)[stay]
        rows = rows[stay]
        if not len(rows):
            break
    return rows, ids
