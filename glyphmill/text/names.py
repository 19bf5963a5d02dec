"""Character names, aliases, loose lookup and named sequences."""

from __future__ import annotations

import unicodedata

from ..ucd import properties as U

# -- fixed values: names that are a prefix and the codepoint
PREFIXES = [
    (0x3400, 0x4DBF, "CJK UNIFIED IDEOGRAPH-"), (0x4E00, 0x9FFF, "CJK UNIFIED IDEOGRAPH-"), (0x20000, 0x2A6DF, "CJK UNIFIED IDEOGRAPH-"), (0x2A700, 0x2B73F, "CJK UNIFIED IDEOGRAPH-"),
    (0x2B740, 0x2B81D, "CJK UNIFIED IDEOGRAPH-"), (0x2B820, 0x2CEAD, "CJK UNIFIED IDEOGRAPH-"), (0x2CEB0, 0x2EBE0, "CJK UNIFIED IDEOGRAPH-"), (0x2EBF0, 0x2EE5D, "CJK UNIFIED IDEOGRAPH-"),
    (0x30000, 0x3134A, "CJK UNIFIED IDEOGRAPH-"), (0x31350, 0x33479, "CJK UNIFIED IDEOGRAPH-"), (0x17000, 0x187FF, "TANGUT IDEOGRAPH-"), (0x18D00, 0x18D1E, "TANGUT IDEOGRAPH-"),
    (0x18B00, 0x18CD5, "KHITAN SMALL SCRIPT CHARACTER-"), (0x1B170, 0x1B2FB, "NUSHU CHARACTER-"), (0xF900, 0xFA6D, "CJK COMPATIBILITY IDEOGRAPH-"), (0xFA70, 0xFAD9, "CJK COMPATIBILITY IDEOGRAPH-"),
    (0x2F800, 0x2FA1D, "CJK COMPATIBILITY IDEOGRAPH-"),
]


def name(cp: int) -> str | None:
    if not 0 <= cp < U.SIZE:
        return None
    for a, b, p in PREFIXES:
        if a <= cp <= b:
            return f"{p}{cp:04X}"
    return unicodedata.name(chr(cp), None)


def has_name(cp: int) -> bool:
    return name(cp) is not None


def loose_key(text: str) -> str:
    """Upper case without spaces, underscores and medial hyphens."""
    out = []
    for i, c in enumerate(text):
        if c in " _":
            continue
        if c == "-" and 0 < i < len(text) - 1 and text[i - 1] not in " _-" and text[i + 1] not in " _-":
            continue
        out.append(c.upper() if c.isascii() else c)
    return "".join(out)


_KEYS: dict[str, int] = {}


def _keys() -> dict[str, int]:
    if not _KEYS:
        for cp in range(U.SIZE):
            n = unicodedata.name(chr(cp), None)
            if n:
                _KEYS.setdefault(loose_key(n), cp)
    return _KEYS


def codepoint_by_name(text: str) -> int | None:
    """Loose lookup of names, algorithmic names and aliases."""
    key = loose_key(text)
    if key == "HANGULJUNGSEONGOE":  # the one pair that only its hyphen tells apart
        return 0x1180 if "O-E" in text.upper().replace("_", " ") else 0x116C
    for a, b, p in PREFIXES:
        start = loose_key(p + "X")[:-1]
        if key.startswith(start):
            digits = key[len(start) :]
            try:
                cp = int(digits, 16) if 4 <= len(digits) <= 6 and digits.isalnum() else -1
            except ValueError:
                cp = -1
            if a <= cp <= b:
                return cp
    found = _keys().get(key)
    if found is not None and any(a <= found <= b for a, b, _ in PREFIXES):
        return None
    if found is None:
        try:
            alias = unicodedata.lookup(text.replace("_", " ").upper())
        except KeyError:
            return None
        return ord(alias) if len(alias) == 1 else None
    return found


def named_sequence(text: str) -> list[int] | None:
    try:
        found = unicodedata.lookup(text)
    except KeyError:
        return None
    return [ord(c) for c in found] if len(found) > 1 else None
