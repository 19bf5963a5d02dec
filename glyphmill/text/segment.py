"""Text segmentation: grapheme clusters, words and sentences (UAX #29), lines (UAX #14).

Each engine makes one pass from left to right over class numbers; what a rule needs from
further left is kept as state, so a text costs time in proportion to its length.
"""

from __future__ import annotations

import functools

import numpy as np

from ..ucd import properties as U

KINDS = ("grapheme", "word", "sentence", "line")


def _codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@functools.cache
def _names(prop: str) -> np.ndarray:
    return np.array(U.codes(prop)[1], dtype=object)


def _classes(text: str, prop: str) -> list[str]:
    return _names(prop)[U.codes(prop)[0][_codepoints(text)]].tolist()


def boundaries(text: str, kind: str, tailoring: str = "STRICT", writing: str = "NEUTRAL", provider=None) -> list[int]:
    """Codepoint indices of all boundaries, strictly increasing; none for an empty text."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    if not text:
        return []
    n = len(text)
    if kind == "grapheme":
        return [0, *_grapheme(text), n]
    if kind == "word":
        return [0, *_word(text), n]
    if kind == "sentence":
        return [0, *_sentence(text), n]
    if tailoring == "ANYWHERE":
        return [*_grapheme(text), n]
    return [*_line(text, tailoring, writing, provider), n]


def byte_offsets(text: str, found: list[int]) -> list[int]:
    if text.isascii():
        return found
    out, at, i = [], 0, 0
    for b in found:
        at += len(text[i:b].encode())
        i = b
        out.append(at)
    return out


def segments(text: str, kind: str, **options) -> list[str]:
    cut = boundaries(text, kind, **options)
    if kind == "line" and cut:
        cut = [0, *cut]
    return [text[a:b] for a, b in zip(cut, cut[1:])]


# ---- grapheme clusters -------------------------------------------------------------------


@functools.cache
def _joins() -> np.ndarray:
    """Codepoints that may belong to a cluster of several, other than a line end; whatever stands between two others is a boundary."""
    of, names = U.codes("Grapheme_Cluster_Break")
    alone = np.isin(of, [names.index(x) for x in ("Other", "Control", "LF", "CR")])
    return ~alone | U.binary("Extended_Pictographic") | (U.codes("Indic_Conjunct_Break")[0] != U.codes("Indic_Conjunct_Break")[1].index("None"))


def _inner(text: str) -> np.ndarray:
    """For each place between two characters whether it is a cluster boundary; rules are asked only around characters that may join."""
    cp = _codepoints(text)
    cut = ~((cp[:-1] == 13) & (cp[1:] == 10))
    hard = np.flatnonzero(_joins()[cp])
    _ask(text, cut, np.maximum(hard - 1, 0), np.minimum(hard + 2, len(cp)), _grapheme_rules)
    return cut


def _ask(text: str, cut: np.ndarray, first: np.ndarray, last: np.ndarray, rules) -> None:
    """Let the rules decide inside the windows first..last (in order; those that overlap are one window)."""
    if not len(first):
        return
    last = np.maximum.accumulate(last)
    new = np.flatnonzero(np.append(True, first[1:] >= last[:-1]))
    for a, b in zip(first[new].tolist(), last[np.append(new[1:] - 1, len(last) - 1)].tolist()):
        cut[a : b - 1] = False
        found = rules(text[a:b])
        if found:
            cut[np.array(found) + (a - 1)] = True


def grapheme_count(text: str) -> int:
    if text.isascii() and "\r" not in text:
        return len(text)
    return int(_inner(text).sum()) + 1 if text else 0


def _grapheme(text: str) -> list[int]:
    if text.isascii() and "\r" not in text:
        return list(range(1, len(text)))
    return (np.flatnonzero(_inner(text)) + 1).tolist()


def _grapheme_rules(text: str) -> list[int]:
    g = _classes(text, "Grapheme_Cluster_Break")
    incb = _classes(text, "Indic_Conjunct_Break")
    picto = U.binary("Extended_Pictographic")
    out = []
    flags = 0  # regional indicators in a row
    emoji = False  # a pictograph, then only Extend
    consonant = linked = False
    for i in range(len(text)):
        b = g[i]
        if i:
            a = g[i - 1]
            if a == "CR" and b == "LF":
                stay = True
            elif a in ("CR", "LF", "Control") or b in ("CR", "LF", "Control"):
                stay = False
            elif a == "L" and b in ("L", "V", "LV", "LVT") or a in ("LV", "V") and b in ("V", "T") or a in ("LVT", "T") and b == "T":
                stay = True
            elif b in ("Extend", "ZWJ", "SpacingMark") or a == "Prepend":
                stay = True
            elif incb[i] == "Consonant" and consonant and linked:
                stay = True
            elif a == "ZWJ" and emoji and picto[ord(text[i])]:
                stay = True
            else:
                stay = a == b == "Regional_Indicator" and flags % 2 == 1
            if not stay:
                out.append(i)
        flags = flags + 1 if b == "Regional_Indicator" else 0
        if picto[ord(text[i])]:
            emoji = True
        elif b not in ("Extend", "ZWJ"):
            emoji = False
        elif b == "Extend" and i and g[i - 1] == "ZWJ":
            emoji = False
        if incb[i] == "Consonant":
            consonant, linked = True, False
        elif incb[i] == "Linker":
            linked = consonant
        elif incb[i] != "Extend":
            consonant = linked = False
    return out


# ---- words -------------------------------------------------------------------------------

_NEW = ("Newline", "CR", "LF")
_SKIP = ("Extend", "Format", "ZWJ")
_AH = ("ALetter", "Hebrew_Letter")
_MID_LETTER = ("MidLetter", "MidNumLet", "Single_Quote")
_MID_NUM = ("MidNum", "MidNumLet", "Single_Quote")


def _word(text: str) -> list[int]:
    """Pairs of letters, digits, spaces and others decide by themselves, and so does a mark between two of them; the rules are asked around the rest."""
    of, names = U.codes("Word_Break")
    cp = _codepoints(text)
    w = of[cp]
    is_ = lambda *which: np.isin(w, [names.index(x) for x in which])
    letter, digit, space = is_("ALetter"), is_("Numeric"), is_("WSegSpace")
    plain = letter | digit | space | is_("Other", "CR", "LF", "Newline")
    run = letter | digit
    cut = ~(run[:-1] & run[1:] | space[:-1] & space[1:] | (cp[:-1] == 13) & (cp[1:] == 10))
    between = is_("MidLetter", "MidNumLet", "MidNum", "Single_Quote") & np.append(True, plain[:-1]) & np.append(plain[1:], True)
    at = np.flatnonzero(between[1:-1]) + 1
    held = letter[at - 1] & letter[at + 1] & ~is_("MidNum")[at] | digit[at - 1] & digit[at + 1] & ~is_("MidLetter")[at]
    cut[at[held] - 1] = cut[at[held]] = False
    hard = np.flatnonzero(~plain & ~between)
    _ask(text, cut, np.maximum(hard - 1, 0), np.minimum(hard + 2, len(cp)), _word_rules)
    return (np.flatnonzero(cut) + 1).tolist()


def _word_rules(text: str) -> list[int]:
    w = _classes(text, "Word_Break")
    picto = U.binary("Extended_Pictographic")
    n = len(w)
    after = [n] * (n + 1)  # the next class that is not skipped
    for i in range(n - 1, -1, -1):
        after[i] = i if w[i] not in _SKIP else after[i + 1]
    out = []
    one = two = ""  # the last classes that are not skipped
    flags = 0
    for i in range(n):
        b = w[i]
        if i:
            a = w[i - 1]
            if a == "CR" and b == "LF":
                stay = True
            elif a in _NEW or b in _NEW:
                stay = False
            elif a == "ZWJ" and picto[ord(text[i])] or a == b == "WSegSpace" or b in _SKIP:
                stay = True
            else:
                nxt = w[after[i + 1]] if after[i + 1] < n else ""
                stay = (
                    one in _AH and b in _AH
                    or one in _AH and b in _MID_LETTER and nxt in _AH
                    or two in _AH and one in _MID_LETTER and b in _AH
                    or one == "Hebrew_Letter" and (b == "Single_Quote" or b == "Double_Quote" and nxt == "Hebrew_Letter")
                    or two == "Hebrew_Letter" and one == "Double_Quote" and b == "Hebrew_Letter"
                    or one in ("Numeric", *_AH) and b == "Numeric" or one == "Numeric" and b in _AH
                    or two == "Numeric" and one in _MID_NUM and b == "Numeric"
                    or one == "Numeric" and b in _MID_NUM and nxt == "Numeric"
                    or one == b == "Katakana"
                    or one in (*_AH, "Numeric", "Katakana", "ExtendNumLet") and b == "ExtendNumLet"
                    or one == "ExtendNumLet" and b in (*_AH, "Numeric", "Katakana")
                    or one == b == "Regional_Indicator" and flags % 2 == 1
                )
            if not stay:
                out.append(i)
        if b not in _SKIP or not i or w[i - 1] in _NEW:
            two, one = one, b
            flags = flags + 1 if b == "Regional_Indicator" else 0
    return out


# ---- sentences ---------------------------------------------------------------------------

_SEP = ("Sep", "CR", "LF")
_STOP_LOOK = ("OLetter", "Upper", "Lower", "Sep", "CR", "LF", "STerm", "ATerm")


def _sentence(text: str) -> list[int]:
    """The rules are asked from what comes before each terminator or separator to what ends the search after it; there is no boundary elsewhere."""
    of, names = U.codes("Sentence_Break")
    s = of[_codepoints(text)]
    n = len(s)
    is_ = lambda *which: np.isin(s, [names.index(x) for x in which])
    cut = np.zeros(max(0, n - 1), bool)
    term = np.flatnonzero(is_("STerm", "ATerm", *_SEP))
    if len(term):
        solid = np.maximum.accumulate(np.where(is_("Extend", "Format"), 0, np.arange(n)))  # the last place that is not skipped
        stops = np.append(np.flatnonzero(is_(*_STOP_LOOK)), n - 1)
        _ask(text, cut, solid[np.maximum(term - 1, 0)], np.minimum(stops[np.searchsorted(stops[:-1], term + 1)] + 1, n), _sentence_rules)
    return (np.flatnonzero(cut) + 1).tolist()


def _sentence_rules(text: str) -> list[int]:
    s = _classes(text, "Sentence_Break")
    n = len(s)
    lower = [False] * (n + 1)  # a Lower comes before anything that stops the search
    for i in range(n - 1, -1, -1):
        lower[i] = s[i] == "Lower" or s[i] not in _STOP_LOOK and lower[i + 1]
    out = []
    term, stage, before_term = "", 0, ""  # 1 terminator, 2 Close, 3 Sp, 4 separator after it
    last = ""
    for i in range(n):
        b = s[i]
        if i:
            a = s[i - 1]
            if a == "CR" and b == "LF":
                stay = True
            elif a in _SEP:
                stay = False
            elif b in ("Extend", "Format"):
                stay = True
            elif not stage:
                stay = True
            elif term == "ATerm" and stage == 1 and (b == "Numeric" or before_term in ("Upper", "Lower") and b == "Upper"):
                stay = True
            elif term == "ATerm" and stage <= 3 and lower[i]:
                stay = True
            elif stage <= 3 and b in ("SContinue", "STerm", "ATerm"):
                stay = True
            elif stage <= 2 and b in ("Close", "Sp", *_SEP) or stage <= 3 and b in ("Sp", *_SEP):
                stay = True
            else:
                stay = False
            if not stay:
                out.append(i)
        if b in ("Extend", "Format") and i and s[i - 1] not in _SEP:
            continue
        if b in ("STerm", "ATerm"):
            term, stage, before_term = b, 1, last
        elif stage and stage <= 2 and b == "Close":
            stage = 2
        elif stage and stage <= 3 and b == "Sp":
            stage = 3
        elif b in _SEP and stage:
            stage = 4
        else:
            stage = 0
        last = b
    return out


# ---- lines -------------------------------------------------------------------------------

_L = {long: short for short, long in U.LB_SHORT.items()}


def resolve_line_break(lb: str, gc: str, tailoring: str = "STRICT") -> str:
    """LB1 on short class names."""
    if lb in ("AI", "SG", "XX"):
        return "AL"
    if lb == "SA":
        return "CM" if gc in ("Nonspacing_Mark", "Spacing_Mark") else "AL"
    if lb == "CJ":
        return "ID" if tailoring in ("LOOSE", "ANYWHERE") else "NS"
    return lb


# -- fixed values of the CSS Text tailorings
_ITERATION = set("々〻ゝゞヽヾ")
_CENTRED = set("・：；･‼⁇⁈⁉！？")
_WIDE = ("Wide", "Fullwidth", "Ambiguous")


def _line(text: str, tailoring: str, writing: str, provider) -> list[int]:
    raw = [_L.get(c, "XX") for c in _classes(text, "Line_Break")]
    gc = _classes(text, "General_Category")
    ea = _classes(text, "East_Asian_Width")
    picto = U.binary("Extended_Pictographic")
    n = len(text)
    lb = [resolve_line_break(c, g, tailoring) for c, g in zip(raw, gc)]
    # LB9, LB10: marks take the class of what they follow
    base = list(range(n))
    for i in range(n):
        if lb[i] in ("CM", "ZWJ"):
            if i and lb[base[i - 1]] not in ("BK", "CR", "LF", "NL", "SP", "ZW"):
                base[i] = base[i - 1]
    cl = [lb[b] if lb[b] not in ("CM", "ZWJ") else "AL" for b in base]
    east = lambda i: ea[base[i]] in ("Fullwidth", "Wide", "Halfwidth")
    nxt = [n] * (n + 1)  # start of the next unit
    for i in range(n - 1, -1, -1):
        nxt[i] = i if base[i] == i else nxt[i + 1]
    number = ["" for _ in range(n)]  # where a run NU (NU|SY|IS)* (CL|CP)? stands at this unit: n, c or nothing
    prev_unit = [-1] * n  # the unit before the unit that i belongs to
    state, last = "", -1
    flags = [0] * n
    before_space = [-1] * n  # the last unit before spaces that ends at i
    for i in range(n):
        if base[i] != i:
            number[i], prev_unit[i], flags[i], before_space[i] = number[i - 1], prev_unit[i - 1], flags[i - 1], before_space[i - 1]
            continue
        c = cl[i]
        prev_unit[i] = last
        state = "n" if c == "NU" or c in ("SY", "IS") and state == "n" else "c" if c in ("CL", "CP") and state == "n" else ""
        number[i] = state
        flags[i] = (flags[last] if last >= 0 else 0) + 1 if c == "RI" else 0
        before_space[i] = (before_space[last] if last >= 0 else -1) if c == "SP" else i
        last = i
    cjk = writing in ("CHINESE", "JAPANESE")
    out = []
    sa_run = None
    for i in range(1, n):
        if provider is not None and raw[i] == "SA" and raw[i - 1] == "SA":
            if sa_run is None or not sa_run[0] < i < sa_run[1]:
                lo, hi = i - 1, i + 1
                while lo and raw[lo - 1] == "SA":
                    lo -= 1
                while hi < n and raw[hi] == "SA":
                    hi += 1
                sa_run = (lo, hi)
            if provider([ord(c) for c in text[sa_run[0] : sa_run[1]]], 0, sa_run[1] - sa_run[0], i - sa_run[0]):
                out.append(i)
                continue
        if _breaks(i, text, lb, cl, base, prev_unit, nxt, number, flags, before_space, ea, gc, picto, east, tailoring, cjk, n):
            out.append(i)
    return out


def _breaks(i, text, lb, cl, base, prev_unit, nxt, number, flags, before_space, ea, gc, picto, east, tailoring, cjk, n) -> bool:
    a0, b0 = lb[i - 1], lb[i]
    if a0 == "BK":
        return True
    if a0 == "CR":
        return b0 != "LF"
    if a0 in ("LF", "NL"):
        return True
    if b0 in ("BK", "CR", "LF", "NL", "SP", "ZW"):
        return False
    spaced = before_space[i - 1]
    if spaced >= 0 and lb[spaced] == "ZW":
        return True
    if lb[i - 1] == "ZWJ":
        return False
    if base[i] != i:
        return False
    u = base[i - 1]
    A, B = cl[u], cl[i]
    P = prev_unit[u]
    after = nxt[i + 1]
    C = cl[after] if after < n else ""
    if A == "WJ" or B == "WJ" or A == "GL":
        return False
    if B == "GL":
        return A in ("SP", "BA", "HY", "HH")
    S = cl[spaced] if spaced >= 0 else ""
    if tailoring != "STRICT" and A not in ("BB", "OP", "QU", "SP"):
        ch = text[i]
        if tailoring in ("NORMAL", "LOOSE") and cjk and ch in "〜゠":
            return True
        if tailoring == "LOOSE":
            if ch in "‐–" and A == "ID":
                return True
            if ch in _ITERATION:
                return True
            if A == B == "IN":
                return True
            if cjk and ch in _CENTRED:
                return True
            if cjk and B == "PO" and ea[i] in _WIDE and A in ("ID", "NU"):
                return True
            if cjk and A == "PR" and ea[u] in _WIDE and B in ("ID", "NU"):
                return True
    if tailoring == "LOOSE" and cjk and A == "PR" and ea[u] in _WIDE and B == "ID":
        return True
    if B in ("CL", "CP", "EX", "SY"):
        return False
    if S == "OP":
        return False
    if S == "QU" and gc[spaced] == "Initial_Punctuation":
        q = prev_unit[spaced]
        if q < 0 or cl[q] in ("BK", "CR", "LF", "NL", "OP", "QU", "GL", "SP", "ZW"):
            return False
    if B == "QU" and gc[i] == "Final_Punctuation" and (after >= n or C in ("SP", "GL", "WJ", "CL", "QU", "CP", "EX", "IS", "SY", "BK", "CR", "LF", "NL", "ZW")):
        return False
    if B == "IS":
        return A == "SP" and C == "NU"
    if S in ("CL", "CP") and B == "NS" or S == B == "B2":
        return False
    if A == "SP":
        return True
    if B == "QU":
        if gc[i] != "Initial_Punctuation" or not east(u) or after >= n or not east(after):
            if gc[i] != "Initial_Punctuation":
                return False
            if not east(u) or after >= n or not east(after):
                return False
    if A == "QU":
        if gc[u] != "Final_Punctuation":
            return False
        if not east(i) or P < 0 or not east(P):
            return False
    if A == "CB" or B == "CB":
        return True
    if A in ("HY", "HH") and B in ("AL", "HL") and (P < 0 or cl[P] in ("BK", "CR", "LF", "NL", "SP", "ZW", "CB", "GL")):
        return False
    if P >= 0 and cl[P] == "HL" and (A == "HY" or A in ("BA", "HH") and not east(u)) and B != "HL":
        return False
    if B in ("BA", "HH", "HY", "NS") or A == "BB":
        return False
    if A == "SY" and B == "HL" or B == "IN":
        return False
    if A in ("AL", "HL") and B == "NU" or A == "NU" and B in ("AL", "HL"):
        return False
    if A == "PR" and B in ("ID", "EB", "EM") or A in ("ID", "EB", "EM") and B == "PO":
        return False
    if A in ("PR", "PO") and B in ("AL", "HL") or A in ("AL", "HL") and B in ("PR", "PO"):
        return False
    if B in ("PO", "PR") and number[u] in ("n", "c") or A in ("PO", "PR", "HY", "IS") and B == "NU" or number[u] == "n" and B == "NU":
        return False
    if A in ("PO", "PR") and B == "OP":
        if C == "NU":
            return False
        second = nxt[after + 1] if after < n else n
        if C == "IS" and second < n and cl[second] == "NU":
            return False
    if A == "JL" and B in ("JL", "JV", "H2", "H3") or A in ("JV", "H2") and B in ("JV", "JT") or A in ("JT", "H3") and B == "JT":
        return False
    korean = ("JL", "JV", "JT", "H2", "H3")
    if A in korean and B == "PO" or A == "PR" and B in korean:
        return False
    if A in ("AL", "HL") and B in ("AL", "HL"):
        return False
    aks = lambda j, c: c in ("AK", "AS") or text[j] == "◌"
    if A == "AP" and aks(i, B) or aks(u, A) and B in ("VF", "VI"):
        return False
    if A == "VI" and P >= 0 and aks(P, cl[P]) and (B == "AK" or text[i] == "◌"):
        return False
    if aks(u, A) and aks(i, B) and C == "VF":
        return False
    if A == "IS" and B in ("AL", "HL"):
        return False
    if A in ("AL", "HL", "NU") and B == "OP" and not east(i) or A == "CP" and not east(u) and B in ("AL", "HL", "NU"):
        return False
    if A == B == "RI":
        return flags[u] % 2 == 0
    if B == "EM" and (A == "EB" or picto[ord(text[u])] and gc[u] == "Unassigned"):
        return False
    return True
