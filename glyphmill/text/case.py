"""Case mapping and folding, with Final_Sigma and the Turkic and Lithuanian tailorings."""

from __future__ import annotations

import functools

from ..ucd import properties as U

# -- fixed values: case pairs (upper, lower) that versions 16.0 and 17.0 added
NEW_PAIRS = [(0x1C89, 0x1C8A), (0xA7CB, 0x264), (0xA7CC, 0xA7CD), (0xA7DA, 0xA7DB), (0xA7DC, 0x19B), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D3), (0xA7D4, 0xA7D5)]
NEW_PAIRS += [(0x10D50 + i, 0x10D70 + i) for i in range(22)] + [(0x16EA0 + i, 0x16EBB + i) for i in range(25)]
_TO_LOWER = {chr(u): chr(l) for u, l in NEW_PAIRS}
_TO_UPPER = {chr(l): chr(u) for u, l in NEW_PAIRS}
DOT, IOTA, DOTLESS, DOTTED = "̇", "i", "ı", "İ"
# -- fixed values: Lithuanian lower case of accented capitals
LITHUANIAN = {"Ì": "i̇̀", "Í": "i̇́", "Ĩ": "i̇̃"}


def upper_char(c: str) -> str:
    return _TO_UPPER.get(c) or c.upper()


def lower_char(c: str) -> str:
    return _TO_LOWER.get(c) or c.lower()


def title_char(c: str) -> str:
    return _TO_UPPER.get(c) or c.title()


def fold_char(c: str, turkic: bool = False) -> str:
    if turkic and c in ("I", DOTTED):
        return DOTLESS if c == "I" else IOTA
    return _TO_LOWER.get(c) or c.casefold()


def _simple(c: str, full: str, back) -> str:
    return full if len(full) == 1 else c


# -- fixed values: simple mappings of characters whose full mapping is longer
SIMPLE_UPPER = {0x1F80 + 16 * b + i: 0x1F88 + 16 * b + i for b in range(3) for i in range(8)} | {0x1FB3: 0x1FBC, 0x1FC3: 0x1FCC, 0x1FF3: 0x1FFC}
SIMPLE_LOWER = {v: k for k, v in SIMPLE_UPPER.items()} | {0x130: 0x69}


def to_upper_simple(cp: int) -> int:
    c = _chr(cp)
    return SIMPLE_UPPER.get(cp) or (ord(u) if c and len(u := upper_char(c)) == 1 else cp)


def to_lower_simple(cp: int) -> int:
    c = _chr(cp)
    return SIMPLE_LOWER.get(cp) or (ord(u) if c and len(u := lower_char(c)) == 1 else cp)


def to_title_simple(cp: int) -> int:
    c = _chr(cp)
    return ord(u) if c and len(u := title_char(c)) == 1 else to_upper_simple(cp)


# -- fixed values: simple folds of characters whose full fold is longer
SIMPLE_FOLD = {0x1E9E: 0xDF, 0x1FD3: 0x390, 0x1FE3: 0x3B0, 0xFB05: 0xFB06}


def case_fold_simple(cp: int, turkic: bool = False) -> int:
    c = _chr(cp)
    if cp in SIMPLE_LOWER and cp != 0x130:
        return SIMPLE_LOWER[cp]
    if cp in SIMPLE_FOLD:
        return SIMPLE_FOLD[cp]
    return ord(u) if c and len(u := fold_char(c, turkic)) == 1 else cp


def _chr(cp: int) -> str:
    return chr(cp) if 0 <= cp < U.SIZE and not 0xD800 <= cp < 0xE000 else ""


@functools.cache
def _orbits() -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for cp in range(U.SIZE):
        c = chr(cp)
        if _simple_changes(c):
            f = case_fold_simple(cp)
            out.setdefault(f, []).append(cp)
    return {f: sorted({f, *m}) for f, m in out.items()}


def _simple_changes(c: str) -> bool:
    return c in _TO_LOWER or not c.isascii() and (c.casefold() != c or c.upper() != c) or c.isalpha() and c.isascii()


def case_orbit(cp: int) -> list[int]:
    """All codepoints with the same simple fold, sorted; at least the codepoint."""
    return _orbits().get(case_fold_simple(cp), [cp])


def _soft_dotted(c: str) -> bool:
    return bool(U.binary("Soft_Dotted")[ord(c)])


def _ccc(c: str) -> int:
    return int(U.combining_classes()[ord(c)])


def _before(text: str, i: int, test) -> bool:
    """A character that passes `test` stands before i, with no class 0 or 230 between."""
    for c in reversed(text[:i]):
        if test(c):
            return True
        if _ccc(c) in (0, 230):
            return False
    return False


def _more_above(text: str, i: int) -> bool:
    for c in text[i + 1 :]:
        if _ccc(c) == 230:
            return True
        if _ccc(c) == 0:
            return False
    return False


def _before_dot(text: str, i: int) -> bool:
    for c in text[i + 1 :]:
        if c == DOT:
            return True
        if _ccc(c) in (0, 230):
            return False
    return False


def final_sigma(text: str, i: int) -> bool:
    cased, skip = U.binary("Cased"), U.binary("Case_Ignorable")
    j = i - 1
    while j >= 0 and skip[ord(text[j])]:
        j -= 1
    if j < 0 or not cased[ord(text[j])]:
        return False
    j = i + 1
    while j < len(text) and skip[ord(text[j])]:
        j += 1
    return j >= len(text) or not cased[ord(text[j])]


def lower_at(text: str, i: int, tailoring: str = "NONE") -> str:
    c = text[i]
    if tailoring == "TURKIC":
        if c == DOTTED:
            return IOTA
        if c == DOT and _before(text, i, lambda x: x == "I"):
            return ""
        if c == "I":
            return IOTA if _before_dot(text, i) else DOTLESS
    elif tailoring == "LITHUANIAN":
        if c in LITHUANIAN:
            return LITHUANIAN[c]
        if c in "IJĮ" and _more_above(text, i):
            return lower_char(c) + DOT
    if c == "Σ":
        return "ς" if final_sigma(text, i) else "σ"
    return lower_char(c)


def upper_at(text: str, i: int, tailoring: str = "NONE") -> str:
    c = text[i]
    if tailoring == "TURKIC" and c == IOTA:
        return DOTTED
    if tailoring == "LITHUANIAN" and c == DOT and _before(text, i, _soft_dotted):
        return ""
    return upper_char(c)


def title_at(text: str, i: int, tailoring: str = "NONE") -> str:
    c = text[i]
    if tailoring == "TURKIC" and c == IOTA:
        return DOTTED
    if tailoring == "LITHUANIAN" and c == DOT and _before(text, i, _soft_dotted):
        return ""
    return title_char(c)


def to_lower(text: str, tailoring: str = "NONE") -> str:
    if tailoring == "NONE" and (text.isascii() or "Σ" not in text and _TO_LOWER.keys().isdisjoint(text)):
        return text.lower()
    return "".join(lower_at(text, i, tailoring) for i in range(len(text)))


def to_upper(text: str, tailoring: str = "NONE") -> str:
    if tailoring == "NONE":
        return text.upper() if text.isascii() or _TO_UPPER.keys().isdisjoint(text) else "".join(map(upper_char, text))
    return "".join(upper_at(text, i, tailoring) for i in range(len(text)))


def to_title(text: str, tailoring: str = "NONE") -> str:
    """The first cased character of each word in title case, the rest lower."""
    from .segment import boundaries

    cased = U.binary("Cased")
    edges = boundaries(text, "word")
    out = []
    for a, b in zip(edges, edges[1:]):
        found = False
        for i in range(a, b):
            if not found and cased[ord(text[i])]:
                found = True
                out.append(title_at(text, i, tailoring))
            else:
                out.append(lower_at(text, i, tailoring))
    return "".join(out)


def case_fold(text: str, tailoring: str = "NONE") -> str:
    if tailoring != "TURKIC" and (text.isascii() or _TO_LOWER.keys().isdisjoint(text)):
        return text.casefold()
    return "".join(fold_char(c, tailoring == "TURKIC") for c in text)


def folded_equal(a: str, b: str, tailoring: str = "NONE") -> bool:
    return case_fold(a, tailoring) == case_fold(b, tailoring)
