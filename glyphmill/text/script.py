"""Script runs (UTS #39, single script) and itemisation."""

from __future__ import annotations

import functools

from ..ucd import properties as U

#: Writing systems that go together, by script.
AUGMENTED = {"Han": ("Japanese", "Korean", "HanBopomofo"), "Hiragana": ("Japanese",), "Katakana": ("Japanese",), "Hangul": ("Korean",), "Bopomofo": ("HanBopomofo",)}


_NEUTRAL = ("Common", "Inherited")


@functools.lru_cache(maxsize=1 << 16)
def augmented(cp: int) -> frozenset[str] | None:
    """The scripts a codepoint goes with; None if it goes with any."""
    scx = U.value("Script_Extensions", cp)
    if scx in (["Common"], ["Inherited"]):
        return None
    return frozenset(scx) | {x for s in scx for x in AUGMENTED.get(s, ())}


@functools.lru_cache(maxsize=1 << 16)
def digit_block(cp: int) -> int | None:
    """The zero of the ten digits that a decimal number is one of."""
    if U.value("General_Category", cp) != "Decimal_Number":
        return None
    v = U.numeric_values().get(cp, (0, 1))[0]
    return cp - v


def is_script_run(text: str) -> bool:
    """One script for the whole text; digits from one set only. A single character always is one."""
    if len(text) < 2:
        return True
    left: frozenset[str] | None = None
    digits = None
    for c in text:
        cp = ord(c)
        if U.value("Script", cp) == "Unknown":
            return False
        d = digit_block(cp)
        if d is not None:
            if digits is not None and d != digits:
                return False
            digits = d
        s = augmented(cp)
        if s is not None:
            left = s if left is None else left & s
            if not left:
                return False
    return True


def items(text: str) -> list[tuple[int, int, str]]:
    """(start, length, script) of runs that tile the text; indices of codepoints.

    Common and Inherited characters belong to the run before them, or at the start to the one that follows; a character
    of another script stays in a run whose script is one of its extensions.
    """
    out: list[tuple[int, int, str]] = []
    start, of = 0, "Common"  # the open run
    for i, c in enumerate(text):
        script = U.value("Script", ord(c))
        if i == 0:
            of = script
        elif script in _NEUTRAL or script == of:
            continue
        elif of in _NEUTRAL:
            of = script
        elif of not in U.value("Script_Extensions", ord(c)):
            out.append((start, i - start, of))
            start, of = i, script
    if text:
        out.append((start, len(text) - start, of))
    return out
