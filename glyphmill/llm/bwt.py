"""Repeated strings of one block of texts by interval expansion on its Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np

#: Symbols in the first sorting key: seven of nine bits each.
FIRST = 7


def suffix_order(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions sorted by their next `depth` symbols or more (prefix doubling), and the first sorting keys in that order."""
    n = len(symbols)
    padded = np.concatenate([symbols, np.zeros(FIRST, symbols.dtype)]).astype(np.int64)
    key = np.zeros(n, np.int64)
    for i in range(FIRST):
        key = (key << 9) | padded[i : i + n]
    order = np.argsort(key, kind="stable")
    first = key[order]
    fresh = np.append(True, first[1:] != first[:-1])
    slot = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))  # where the class of each place begins
    rank = np.empty(n, np.int64)
    rank[order] = slot
    h = FIRST
    while h < depth:
        open_ = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
        if not len(open_):
            break
        at = order[open_]
        later = np.where(at + h < n, rank[np.minimum(at + h, n - 1)] + 1, 0)
        by = np.argsort(slot[open_] * (n + 1) + later, kind="stable")
        moved, later = at[by], later[by]
        order[open_] = moved
        same = np.append(False, (later[1:] == later[:-1]) & (slot[open_][1:] == slot[open_][:-1]))
        fresh[open_] = ~same
        slot[open_] = np.maximum.accumulate(np.where(~same, open_, 0))
        rank[moved] = slot[open_]
        h *= 2
    return order, first


def long_matches(symbols: np.ndarray, least: int) -> np.ndarray:
    """Mark the positions whose next `least` symbols also begin elsewhere in the block.

    `symbols` are bytes plus one, with 0 between texts; a string over a 0 marks nothing of use,
    since callers only ask for positions whose whole string lies in a text. The common prefix
    of neighbours in suffix order is found by value: the intervals whose right border got the
    value v extend backward by a symbol each, and give v + 1 to the borders that have none yet.
    What has no value when v reaches `least` has at least `least` symbols in common.
    """
    n = len(symbols)
    out = np.zeros(n, bool)
    if n < 2:
        return out
    order, first = suffix_order(symbols, least)
    bwt = symbols[order - 1].astype(np.int64)  # position 0 is preceded by the last symbol, a 0
    lf = np.empty(n, np.int64)
    lf[np.argsort(bwt, kind="stable")] = np.arange(n)
    common = np.full(n + 1, -1, np.int64)  # common[i]: of the suffixes at i - 1 and i
    common[0] = common[n] = 0
    differ = first[1:] ^ first[:-1]
    bits = np.zeros(n - 1, np.int64)
    some = differ != 0
    bits[some] = np.floor(np.log2(differ[some].astype(np.float64))).astype(np.int64)
    # a float may round up to the next power of two
    bits[some] -= (differ[some] >> bits[some]) == 0
    common[1:n][some] = FIRST - 1 - bits[some] // 9
    # the intervals of FIRST symbols whose right border has the largest value so far
    lows = np.append(0, np.flatnonzero(some) + 1)
    highs = np.append(lows[1:], n)
    take = common[highs] == FIRST - 1
    lo, hi = lows[take], highs[take]
    value = FIRST
    while value < least and len(lo):
        size = hi - lo
        start = np.cumsum(size) - size
        at = np.arange(size.sum()) - np.repeat(start - lo, size)
        key = np.repeat(np.arange(len(lo)), size) * 512 + bwt[at]
        by = np.argsort(key, kind="stable")
        key, at = key[by], at[by]
        edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        last = np.append(edge[1:], len(key)) - 1
        new_lo, new_hi = lf[at[edge]], lf[at[last]] + 1
        open_ = common[new_hi] < 0
        lo, hi = new_lo[open_], new_hi[open_]
        common[hi] = value
        value += 1
    long = common[1:n] < 0
    out[order[1:][long]] = True
    out[order[:-1][long]] = True
    return out
