"""Normalisation: decomposition, composition, quick checks, stream-safe text."""

from __future__ import annotations

import functools
import unicodedata

from ..ucd import properties as U

FORMS = ("NFC", "NFD", "NFKC", "NFKD")

# -- fixed values: decompositions that versions 16.0 and 17.0 added
NEW_CANONICAL = {
    0x105C9: (0x105D2, 0x307), 0x105E4: (0x105DA, 0x307), 0x11383: (0x11382, 0x113C9), 0x11385: (0x11384, 0x113BB), 0x1138E: (0x1138B, 0x113C2), 0x11391: (0x11390, 0x113C9),
    0x113C5: (0x113C2, 0x113C2), 0x113C7: (0x113C2, 0x113B8), 0x113C8: (0x113C2, 0x113C9), 0x16121: (0x1611E, 0x1611E), 0x16122: (0x1611E, 0x16129), 0x16123: (0x1611E, 0x1611F),
    0x16124: (0x16129, 0x1611F), 0x16125: (0x1611E, 0x16120), 0x16126: (0x16121, 0x1611F), 0x16127: (0x16122, 0x1611F), 0x16128: (0x16121, 0x16120),
    0x16D68: (0x16D67, 0x16D67), 0x16D69: (0x16D63, 0x16D67), 0x16D6A: (0x16D69, 0x16D67),
}
NEW_COMPAT = {0xA7F1: (0x53,)} | {0x1CCD6 + i: (0x41 + i,) for i in range(26)} | {0x1CCF0 + i: (0x30 + i,) for i in range(10)}
S_BASE, L_BASE, V_BASE, T_BASE, L_COUNT, V_COUNT, T_COUNT = 0xAC00, 0x1100, 0x1161, 0x11A7, 19, 21, 28


def _one_step(cp: int) -> tuple[tuple[int, ...], bool] | None:
    """The decomposition mapping of a codepoint and whether it is canonical."""
    if cp in NEW_CANONICAL:
        return NEW_CANONICAL[cp], True
    if cp in NEW_COMPAT:
        return NEW_COMPAT[cp], False
    text = unicodedata.decomposition(chr(cp)) if 0 <= cp < U.SIZE else ""
    if not text:
        return None
    parts = text.split()
    compat = parts[0].startswith("<")
    return tuple(int(p, 16) for p in parts[compat:]), not compat


@functools.lru_cache(maxsize=1 << 17)
def decomposition(cp: int, compat: bool) -> tuple[int, ...]:
    """The full decomposition; what has none is itself."""
    s = cp - S_BASE
    if 0 <= s < L_COUNT * V_COUNT * T_COUNT:
        lv, t = divmod(s, T_COUNT)
        l, v = divmod(lv, V_COUNT)
        return (L_BASE + l, V_BASE + v, T_BASE + t)[: 3 if t else 2]
    step = _one_step(cp)
    if step is None or not (step[1] or compat):
        return (cp,)
    return tuple(x for p in step[0] for x in decomposition(p, compat))


@functools.cache
def _pairs() -> dict[tuple[int, int], int]:
    out = {}
    for cp in range(U.SIZE):
        d = unicodedata.decomposition(chr(cp))
        if d and not d.startswith("<"):
            parts = d.split()
            if len(parts) == 2 and unicodedata.normalize("NFC", chr(cp)) == chr(cp):
                out[int(parts[0], 16), int(parts[1], 16)] = cp
    return out | {v: k for k, v in NEW_CANONICAL.items()}


def compose(a: int, b: int) -> int:
    """The primary composite of a pair, or 0."""
    if 0 <= a - L_BASE < L_COUNT and 0 <= b - V_BASE < V_COUNT:
        return S_BASE + ((a - L_BASE) * V_COUNT + b - V_BASE) * T_COUNT
    if 0 <= a - S_BASE < L_COUNT * V_COUNT * T_COUNT and (a - S_BASE) % T_COUNT == 0 and 0 < b - T_BASE < T_COUNT:
        return a + b - T_BASE
    return _pairs().get((a, b), 0)


def _ccc(cp: int) -> int:
    return int(U.combining_classes()[cp]) if 0 <= cp < U.SIZE else 0


def canonical_order(cps: list[int]) -> list[int]:
    """Each run of non-starters in order of combining class; equal classes keep their order."""
    out: list[int] = []
    held: list[int] = []
    for cp in cps:
        if _ccc(cp):
            held.append(cp)
        else:
            out += sorted(held, key=_ccc)
            out.append(cp)
            held = []
    return out + sorted(held, key=_ccc)


def normalize_cps(form: str, cps: list[int]) -> list[int]:
    if form not in FORMS:
        raise ValueError(f"form must be one of {FORMS}")
    parts = canonical_order([x for cp in cps for x in decomposition(cp, "K" in form)])
    if form.endswith("D"):
        return parts
    out: list[int] = []
    starter, last = -1, 0
    for cp in parts:
        c = _ccc(cp)
        free = starter >= 0 and (starter == len(out) - 1 or 0 < last < c)
        joined = compose(out[starter], cp) if free else 0
        if joined:
            out[starter] = joined
            continue
        if c == 0:
            starter = len(out)
        last = c
        out.append(cp)
    return out


@functools.cache
def _newer() -> frozenset[str]:
    """Characters whose normalisation CPython's older tables may get wrong."""
    return frozenset(chr(c) for c in range(U.SIZE) if U.assigned()[c] and unicodedata.category(chr(c)) == "Cn" and (c in NEW_CANONICAL or c in NEW_COMPAT or U.combining_classes()[c])) | {chr(p) for v in NEW_CANONICAL.values() for p in v if p > 0x10000}


def normalize(form: str, text: str) -> str:
    """Text in a normalisation form; the interpreter's tables serve all but characters newer than they are."""
    if text.isascii():
        return text
    if _newer().isdisjoint(text):
        return unicodedata.normalize(form, text)
    return "".join(map(chr, normalize_cps(form, [ord(c) for c in text])))


def nfd(text: str) -> str:
    return normalize("NFD", text)


def quick_check(form: str, cp: int) -> str:
    return U.value(f"{form}_Quick_Check", cp)


def quick_check_text(form: str, text: str) -> str:
    """Yes, No or Maybe."""
    if text.isascii():
        return "Yes"
    last, answer = 0, "Yes"
    for ch in text:
        cp = ord(ch)
        c = _ccc(cp)
        if c and last > c:
            return "No"
        q = quick_check(form, cp)
        if q == "No":
            return "No"
        if q == "Maybe":
            answer = "Maybe"
        last = c
    return answer


def is_normalized(form: str, text: str) -> bool:
    return normalize(form, text) == text


def is_stream_safe(text: str, most: int = 30) -> bool:
    run = 0
    for ch in text:
        run = run + 1 if _ccc(ord(ch)) else 0
        if run > most:
            return False
    return True


def stream_safe(text: str, most: int = 30) -> str:
    """U+034F put in after every `most` non-starters in a row."""
    if most <= 0:
        raise ValueError("most must be positive")
    out, run = [], 0
    for ch in text:
        if _ccc(ord(ch)):
            if run == most:
                out.append("͏")
                run = 0
            run += 1
        else:
            run = 0
        out.append(ch)
    return "".join(out)
