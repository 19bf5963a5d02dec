"""Grapheme cluster and word rules as finite automata, so that a text can be cut anywhere and its pieces read apart.

A state is what the rules need of the text so far; a piece of text is then a map from states to
states, and maps compose. Many characters lead to one state whatever the state before
(`settles`), so the map of nearly every piece is constant. Where a rule looks ahead, the place in
question stays pending in the state until the character that decides comes.
"""

from __future__ import annotations

import functools

import numpy as np

from ..ucd import properties as U
from . import segment

#: What a step says: a boundary before the character; the pending place is one; it is decided; this place is pending now.
CUT, PENDING_CUT, DECIDED, PENDING = 1, 2, 4, 8
KINDS = ("grapheme", "word")
_START = "start"


def _grapheme_step(state, symbol):
    b, conjunct, picto = symbol
    flags = 0
    a, odd, emoji, consonant, linked = ("", False, False, False, False) if state == _START else state
    if state != _START:
        if a == "CR" and b == "LF":
            stay = True
        elif a in ("CR", "LF", "Control") or b in ("CR", "LF", "Control"):
            stay = False
        else:
            stay = (
                a == "L" and b in ("L", "V", "LV", "LVT")
                or a in ("LV", "V") and b in ("V", "T")
                or a in ("LVT", "T") and b == "T"
                or b in ("Extend", "ZWJ", "SpacingMark")
                or a == "Prepend"
                or conjunct == "Consonant" and consonant and linked
                or a == "ZWJ" and emoji and picto
                or a == b == "Regional_Indicator" and odd
            )
        flags = 0 if stay else CUT
    if picto:
        emoji = True
    elif b not in ("Extend", "ZWJ") or b == "Extend" and a == "ZWJ":
        emoji = False
    if conjunct == "Consonant":
        consonant, linked = True, False
    elif conjunct == "Linker":
        linked = consonant
    elif conjunct != "Extend":
        consonant = linked = False
    return (b, b == "Regional_Indicator" and not odd, emoji, consonant, linked), flags


def _word_step(state, symbol):
    b, picto = symbol
    if state == _START:
        return (b, b, "", b == "Regional_Indicator", ()), 0
    a, one, two, odd, waits = state
    new, skip, letters = segment._NEW, segment._SKIP, segment._AH
    if b in skip and a not in new:
        return (b, one, two, odd, waits), 0
    flags = 0 if not waits else DECIDED if b in waits else DECIDED | PENDING_CUT
    accepts: tuple = ()
    if a == "CR" and b == "LF":
        stay = True
    elif a in new or b in new:
        stay = False
    elif a == "ZWJ" and picto or a == b == "WSegSpace":
        stay = True
    else:
        stay = (
            one in letters and b in letters
            or two in letters and one in segment._MID_LETTER and b in letters
            or one == "Hebrew_Letter" and b == "Single_Quote"
            or two == "Hebrew_Letter" and one == "Double_Quote" and b == "Hebrew_Letter"
            or one in ("Numeric", *letters) and b == "Numeric"
            or one == "Numeric" and b in letters
            or two == "Numeric" and one in segment._MID_NUM and b == "Numeric"
            or one == b == "Katakana"
            or one in (*letters, "Numeric", "Katakana", "ExtendNumLet") and b == "ExtendNumLet"
            or one == "ExtendNumLet" and b in (*letters, "Numeric", "Katakana")
            or one == b == "Regional_Indicator" and odd
        )
        if not stay:
            if one in letters and b in segment._MID_LETTER:
                accepts = letters
            elif one == "Hebrew_Letter" and b == "Double_Quote":
                accepts = ("Hebrew_Letter",)
            elif one == "Numeric" and b in segment._MID_NUM:
                accepts = ("Numeric",)
    flags |= 0 if stay else PENDING if accepts else CUT
    middle = b in segment._MID_LETTER or b in segment._MID_NUM or b == "Double_Quote"
    two = one if middle and one in (*letters, "Numeric") else ""  # else no rule asks for it
    return (b, b, two, b == "Regional_Indicator" and not (odd and one == b), accepts), flags


class Automaton:
    """Tables of one kind of segmentation: the symbol of each codepoint, and of each state and symbol the next state and flags."""

    def __init__(self, kind: str):
        props = {"grapheme": ("Grapheme_Cluster_Break", "Indic_Conjunct_Break"), "word": ("Word_Break",)}[kind]
        step = {"grapheme": _grapheme_step, "word": _word_step}[kind]
        both = [U.codes(p)[0].astype(np.int64) for p in props] + [U.binary("Extended_Pictographic").astype(np.int64)]
        joint = both[0]
        for more in both[1:]:
            joint = joint * 256 + more
        values, self.symbol = np.unique(joint, return_inverse=True)
        names = [U.codes(p)[1] for p in props]
        symbols = []
        for v in values.tolist():
            parts = [bool(v & 255)]
            for n in reversed(names):
                v >>= 8
                parts.insert(0, n[v & 255])
            symbols.append(tuple(parts))
        states, rows = {_START: 0}, []
        for s in (todo := [_START]):
            row = []
            for c in symbols:
                after, flags = step(s, c)
                if after not in states:
                    states[after] = len(states)
                    todo.append(after)
                row.append((states[after], flags))
            rows.append(row)
        table = np.array(rows)
        self.kind, self.next, self.flags = kind, table[:, :, 0], table[:, :, 1]
        self.waiting = np.array([s != _START and kind == "word" and bool(s[4]) for s in states])
        #: symbols after which the state before no longer matters
        self.settles = (self.next == self.next[:1]).all(axis=0)
        self.n = len(states)

    def symbols(self, text: str) -> np.ndarray:
        return self.symbol[segment._codepoints(text)]

    def after(self, text: str) -> int | list[int]:
        """The state after a piece, if it is the same for every state before; else the state after each."""
        codes = self.symbols(text)
        settled = np.flatnonzero(self.settles[codes])
        if len(settled):
            state = int(self.next[0, codes[settled[-1]]])
            for c in codes[settled[-1] + 1 :].tolist():
                state = int(self.next[state, c])
            return state
        states = np.arange(self.n)
        for c in codes.tolist():
            states = self.next[states, c]
        return int(states[0]) if (states == states[0]).all() else states.tolist()

    def read(self, text: str, state: int) -> tuple[list[int], bool | None, int | None]:
        """Places in the piece that begin a segment, how a place pending before it was decided, and the place that is pending at its end.

        state: after what comes before the piece, 0 at the start of the text. Rules go character by character up to the first one
        that settles the state, and from the last one on; the one-pass engine does the rest.
        """
        codes = self.symbols(text)
        settled = np.flatnonzero(self.settles[codes])
        last = int(settled[0]) if len(settled) else len(codes) - 1
        places: list[int] = [0] if state == 0 else []
        decided, waits = None, -1 if self.waiting[state] else None

        def step(i: int, s: int) -> int:
            nonlocal decided, waits
            flags = int(self.flags[s, codes[i]])
            if flags & DECIDED:
                if waits == -1:
                    decided = bool(flags & PENDING_CUT)
                elif flags & PENDING_CUT:
                    places.append(waits)
                waits = None
            if flags & CUT:
                places.append(i)
            if flags & PENDING:
                waits = i
            return int(self.next[s, codes[i]])

        for i in range(last + 1):
            state = step(i, state)
        if len(settled):
            final = int(settled[-1])
            places += [last + p for p in segment.boundaries(text[last : final + 1], self.kind)[1:-1]]
            state, waits = int(self.next[0, codes[final]]), None
            for i in range(final + 1, len(codes)):
                state = step(i, state)
        return sorted(places), decided, waits if waits != -1 else None


@functools.cache
def automaton(kind: str) -> Automaton:
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    return Automaton(kind)
