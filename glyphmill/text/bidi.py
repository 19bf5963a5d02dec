"""The bidirectional algorithm (UAX #9): embedding levels of a paragraph and the order of a line."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

from ..ucd import properties as U
from .segment import _codepoints

DEPTH = 125
BRACKETS = 63
_SHORT = {long: short for short, long in U.BC_SHORT.items()}
_REMOVED = frozenset("LRE RLE LRO RLO PDF BN".split())
_ISOLATES = frozenset(("LRI", "RLI", "FSI"))


# -- fixed values: mirrored pairs that names do not tell
MORE_PAIRS = (
    "0F3A:0F3B 0F3C:0F3D 169B:169C 2209:220C 2215:29F5 221F:2BFE 2220:29A3 2221:299B 2222:29A0 2224:2AEE 223C:223D 2243:22CD 2245:224C 2252:2253 2254:2255 "
    "2276:2277 2278:2279 2280:2281 228F:2290 2291:2292 2298:29B8 22A6:2ADE 22A8:2AE4 22A9:2AE3 22B2:22B3 22B4:22B5 22B6:22B7 22B8:27DC 22DA:22DB 22E0:22E1 "
    "22E2:22E3 22E4:22E5 22EA:22EB 22EC:22ED 22F0:22F1 22F2:22FA 22F3:22FB 22F4:22FC 22F6:22FD 22F7:22FE 27C8:27C9 27CB:27CD 2993:2994 2995:2996 29A4:29A5 "
    "29C4:29C5 29CF:29D0 29F8:29F9 2A2B:2A2C 2A3C:2A3D 2A64:2A65 2A83:2A84 2A8B:2A8C 2A8F:2A90 2A91:2A92 2A93:2A94 2AAA:2AAB 2AAC:2AAD 2AD3:2AD4 2AEC:2AED "
)


@functools.cache
def _mirrors() -> dict[int, int]:
    """Mirrored pairs: by the names that tell them apart, and those stated; used for L4 and brackets."""
    out: dict[int, int] = {}
    by_name = {}
    mirrored = U.binary("Bidi_Mirrored")
    for cp in range(U.SIZE):
        if mirrored[cp]:
            n = unicodedata.name(chr(cp), "")
            if n:
                by_name[n] = cp
    for n, cp in by_name.items():
        for a, b in (("LEFT", "RIGHT"), ("LESS-THAN", "GREATER-THAN"), ("OPENING", "CLOSING"), ("SUBSET", "SUPERSET"), ("PRECEDES", "SUCCEEDS"), ("ELEMENT OF", "CONTAINS AS MEMBER")):
            for x, y in ((a, b), (b, a)):
                if x in n:
                    other = by_name.get(n.replace(x, y))
                    if other is not None and other != cp:
                        out.setdefault(cp, other)
    for pair in MORE_PAIRS.split():
        a, b = (int(x, 16) for x in pair.split(":"))
        out[a], out[b] = b, a
    return out


def mirror(cp: int) -> int:
    return _mirrors().get(cp, cp)


@functools.lru_cache(maxsize=4096)
def paired_bracket(cp: int) -> tuple[int, bool]:
    """The other bracket and whether this one opens; (0, False) if it is none."""
    gc = U.value("General_Category", cp)
    if gc not in ("Open_Punctuation", "Close_Punctuation") or not U.value("Bidi_Mirrored", cp) or U.value("Bidi_Class", cp) != "Other_Neutral":
        return 0, False
    other = _mirrors().get(cp)
    return (other, gc == "Open_Punctuation") if other else (0, False)


def _canonical(cp: int) -> int:
    return {0x2329: 0x3008, 0x232A: 0x3009}.get(cp, cp)


def _matches(types: list[str]) -> list[int]:
    """For each isolate initiator its PDI or the length, for each matched PDI its initiator, else -1."""
    out, stack = [-1] * len(types), []
    for i, t in enumerate(types):
        if t in _ISOLATES:
            out[i] = len(types)
            stack.append(i)
        elif t == "PDI" and stack:
            j = stack.pop()
            out[j], out[i] = i, j
        elif t == "B":
            stack.clear()
    return out


def _first_strong(types: list[str], match: list[int], lo: int, hi: int) -> int | None:
    i = lo
    while i < hi:
        t = types[i]
        if t in ("L", "R", "AL"):
            return 0 if t == "L" else 1
        if t == "B":
            return None
        if t in _ISOLATES:
            i = match[i]
        i += 1
    return None


@functools.cache
def _turning() -> np.ndarray:
    """The characters that can give a level above 0 in a paragraph of level 0: right-to-left ones, Arabic numbers, explicit formatting."""
    of, names = U.codes("Bidi_Class")
    return np.isin(of, [i for i, n in enumerate(names) if _SHORT[n] in ("R", "AL", "AN", "LRE", "RLE", "LRO", "RLO", "PDF", "PDI", *_ISOLATES)])


def _flat(text: str) -> bool:
    """Whether all levels are 0 unless the direction is RTL: numbers follow L by W7, neutrals stand between L by N1."""
    return text.isascii() or not _turning()[_codepoints(text)].any()


def levels(text: str, direction: str = "AUTO") -> tuple[int, list[int]]:
    """The paragraph level, and one level a character; the text is one paragraph."""
    if direction != "RTL" and _flat(text):
        return 0, [0] * len(text)
    types = [_SHORT[U.value("Bidi_Class", ord(c))] for c in text]
    match = _matches(types)
    base = {"LTR": 0, "RTL": 1}.get(direction)
    if base is None:
        base = _first_strong(types, match, 0, len(types)) or 0
    if not text:
        return base, []
    level, now = [base] * len(types), list(types)
    _explicit(types, match, base, level, now)
    for sequence in _sequences(types, match, level):
        _resolve(text, types, match, sequence, level, now, base)
    # L1
    white = True
    for i in range(len(types) - 1, -1, -1):
        t = types[i]
        if t in ("B", "S"):
            level[i] = base
            white = True
        elif t == "WS" or t in _ISOLATES or t == "PDI":
            if white:
                level[i] = base
        elif t in _REMOVED:
            if white:
                level[i] = base
        else:
            white = False
    last = base
    for i, t in enumerate(types):
        if t in _REMOVED:
            level[i] = last
        last = level[i]
    return base, level


def _explicit(types, match, base, level, now) -> None:
    stack = [(base, "", False)]
    over_isolate = over_embed = valid = 0
    for i, t in enumerate(types):
        if t in ("RLE", "LRE", "RLO", "LRO"):
            level[i] = stack[-1][0]
            up = stack[-1][0] + (1 if t[0] == "R" and stack[-1][0] % 2 == 0 or t[0] == "L" and stack[-1][0] % 2 else 2)
            if up <= DEPTH and not over_isolate and not over_embed:
                stack.append((up, {"RLO": "R", "LRO": "L"}.get(t, ""), False))
            elif not over_isolate:
                over_embed += 1
        elif t in _ISOLATES:
            level[i] = stack[-1][0]
            now[i] = stack[-1][1] or t
            right = t == "RLI" or t == "FSI" and _first_strong(types, match, i + 1, match[i]) == 1
            up = stack[-1][0] + (1 if right == (stack[-1][0] % 2 == 0) else 2)
            if up <= DEPTH and not over_isolate and not over_embed:
                valid += 1
                stack.append((up, "", True))
            else:
                over_isolate += 1
        elif t == "PDI":
            if over_isolate:
                over_isolate -= 1
            elif valid:
                over_embed = 0
                while not stack[-1][2]:
                    stack.pop()
                stack.pop()
                valid -= 1
            level[i] = stack[-1][0]
            now[i] = stack[-1][1] or t
        elif t == "PDF":
            level[i] = stack[-1][0]
            if not over_isolate:
                if over_embed:
                    over_embed -= 1
                elif not stack[-1][2] and len(stack) > 1:
                    stack.pop()
        elif t == "B":
            level[i] = base
            stack = [(base, "", False)]
            over_isolate = over_embed = valid = 0
        else:
            level[i] = stack[-1][0]
            if t != "BN" and stack[-1][1]:
                now[i] = stack[-1][1]


def _sequences(types, match, level):
    """Isolating run sequences as lists of positions."""
    runs: list[list[int]] = []
    for i, t in enumerate(types):
        if t in _REMOVED:
            continue
        if runs and level[runs[-1][-1]] == level[i]:
            runs[-1].append(i)
        else:
            runs.append([i])
    start = {r[0]: k for k, r in enumerate(runs)}
    follows = set()
    chain: dict[int, int] = {}
    for k, r in enumerate(runs):
        end = r[-1]
        if types[end] in _ISOLATES and match[end] < len(types):
            j = start.get(match[end])
            if j is not None and level[match[end]] == level[end]:
                chain[k] = j
                follows.add(j)
    for k, r in enumerate(runs):
        if k in follows:
            continue
        out = list(r)
        while k in chain:
            k = chain[k]
            out += runs[k]
        yield out


def _resolve(text, types, match, seq, level, now, base) -> None:
    mine = level[seq[0]]
    before = seq[0] - 1
    while before >= 0 and types[before] in _REMOVED:
        before -= 1
    end = seq[-1]
    if types[end] in _ISOLATES and match[end] >= len(types):
        after_level = base
    else:
        after = end + 1
        while after < len(types) and types[after] in _REMOVED:
            after += 1
        after_level = level[after] if after < len(types) else base
    before_level = level[before] if before >= 0 else base
    sos = "R" if max(mine, before_level) % 2 else "L"
    eos = "R" if max(mine, after_level) % 2 else "L"
    t = [now[i] for i in seq]
    n = len(t)
    last = sos
    for k in range(n):  # W1
        if t[k] == "NSM":
            t[k] = "ON" if last in _ISOLATES or last == "PDI" else last
        last = t[k]
    strong = sos
    for k in range(n):  # W2, W3
        if t[k] in ("L", "R", "AL"):
            strong = t[k]
        elif t[k] == "EN" and strong == "AL":
            t[k] = "AN"
    t = ["R" if x == "AL" else x for x in t]
    for k in range(1, n - 1):  # W4
        if t[k - 1] == t[k + 1]:
            if t[k] in ("ES", "CS") and t[k - 1] == "EN" or t[k] == "CS" and t[k - 1] == "AN":
                t[k] = t[k - 1]
    k = 0
    while k < n:  # W5, W6
        if t[k] == "ET":
            j = k
            while j < n and t[j] == "ET":
                j += 1
            new = "EN" if k and t[k - 1] == "EN" or j < n and t[j] == "EN" else "ON"
            t[k:j] = [new] * (j - k)
            k = j
        else:
            k += 1
    t = ["ON" if x in ("ES", "CS") else x for x in t]
    strong = sos
    for k in range(n):  # W7
        if t[k] in ("L", "R"):
            strong = t[k]
        elif t[k] == "EN" and strong == "L":
            t[k] = "L"
    own = "R" if mine % 2 else "L"
    side = lambda x: "R" if x in ("R", "EN", "AN") else x if x == "L" else ""
    stack, pairs = [], []
    for k in range(n):  # BD16
        if t[k] != "ON":
            continue
        cp = ord(text[seq[k]])
        other, opens = paired_bracket(cp)
        if not other:
            continue
        if opens:
            if len(stack) == BRACKETS:
                pairs = []
                break
            stack.append((_canonical(other), k))
        else:
            for s in range(len(stack) - 1, -1, -1):
                if stack[s][0] == _canonical(cp):
                    pairs.append((stack[s][1], k))
                    del stack[s:]
                    break
    for a, b in sorted(pairs):  # N0
        inside = {side(t[k]) for k in range(a + 1, b)}
        if own in inside:
            new = own
        elif inside - {""}:
            prior = next((side(t[k]) for k in range(a - 1, -1, -1) if side(t[k])), sos)
            new = prior if prior != own else own
        else:
            continue
        for at in (a, b):
            t[at] = new
            k = at + 1
            while k < n and types[seq[k]] == "NSM":
                t[k] = new
                k += 1
    neutral = ("B", "S", "WS", "ON", "LRI", "RLI", "FSI", "PDI")
    k = 0
    while k < n:  # N1, N2
        if t[k] in neutral:
            j = k
            while j < n and t[j] in neutral:
                j += 1
            a = side(t[k - 1]) if k else sos
            b = side(t[j]) if j < n else eos
            t[k:j] = [a if a == b else own] * (j - k)
            k = j
        else:
            k += 1
    for k, i in enumerate(seq):  # I1, I2
        if mine % 2 == 0:
            level[i] = mine + (1 if t[k] == "R" else 2 if t[k] in ("AN", "EN") else 0)
        else:
            level[i] = mine + (1 if t[k] in ("L", "AN", "EN") else 0)


def reorder(found: list[int]) -> list[int]:
    """L2: out[visual place] = logical place."""
    out = list(range(len(found)))
    if not found:
        return out
    odd = [x for x in found if x % 2]
    for cut in range(max(found), (min(odd) if odd else max(found) + 1) - 1, -1):
        i = 0
        while i < len(out):
            if found[out[i]] >= cut:
                j = i
                while j < len(out) and found[out[j]] >= cut:
                    j += 1
                out[i:j] = out[i:j][::-1]
                i = j
            else:
                i += 1
    return out
