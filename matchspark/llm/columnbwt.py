"""Column-wise construction of the suffix order and common prefixes of many aligned strings at once.

Every round inserts one symbol per string, from the last column to the first. The order of the
strings by their suffixes is the previous order, stably sorted by the new symbol - the symbols in that
order are one column of the collection's Burrows-Wheeler transform - and the common prefix of two
new neighbours is one more than the least common prefix between their old places if they got the
same symbol, else nought. Strings of different groups are never compared.
"""

from __future__ import annotations

import numpy as np

#: Symbol of a column outside of the string; equal to nothing.
NONE = 256


def repeated_windows(columns: np.ndarray, group: np.ndarray, copies: np.ndarray, window: int) -> np.ndarray:
    """(columns - window + 1, strings) of booleans: the window that starts there occurs in another string.

    ``columns``: (columns, strings) symbols; ``group`` ascends; a string with two or more copies
    repeats all its whole windows.
    """
    width, n = columns.shape
    order = np.arange(n)
    first = np.empty(n, bool)
    first[:1] = True
    first[1:] = group[1:] != group[:-1]
    common = np.zeros(n + 1, np.int32)  # common[i]: of order[i - 1] and order[i]; nought where a group starts
    base = group.astype(np.int64) * (NONE + 1)
    inside = np.zeros(n, np.int32)  # columns from here on that lie inside the string
    out = np.zeros((max(0, width - window + 1), n), bool)
    for j in range(width - 1, -1, -1):
        symbol = columns[j].astype(np.int64)
        inside = np.where(symbol == NONE, 0, inside + 1)
        key = (base + symbol)[order]
        if (key[1:] < key[:-1]).any():
            perm = np.argsort(key, kind="stable")
        else:
            perm = np.arange(n)
        sorted_key = key[perm]
        same = np.zeros(n, bool)
        same[1:] = (sorted_key[1:] == sorted_key[:-1]) & (symbol[order[perm[1:]]] != NONE)
        at = np.flatnonzero(same)
        new = np.zeros(n + 1, np.int32)
        if len(at):
            spans = np.empty(2 * len(at), np.int64)
            spans[0::2] = perm[at - 1] + 1
            spans[1::2] = perm[at] + 1
            new[at] = np.minimum.reduceat(common, spans)[::2] + 1
        order, common = order[perm], new
        if j < len(out):
            shared = np.maximum(common[:-1], common[1:]) >= window
            out[j, order] = shared
            out[j] |= (copies > 1) & (inside >= window)
    return out
