"""UTF-8 with an explicit policy for what is not well formed: REFUSE, REPLACE or SKIP."""

from __future__ import annotations

POLICIES = ("REFUSE", "REPLACE", "SKIP")


def is_surrogate(cp: int) -> bool:
    return 0xD800 <= cp <= 0xDFFF


def is_codepoint(cp: int) -> bool:
    return 0 <= cp <= 0x10FFFF and not is_surrogate(cp)


def is_noncharacter(cp: int) -> bool:
    return 0 <= cp <= 0x10FFFF and (0xFDD0 <= cp <= 0xFDEF or cp & 0xFFFE == 0xFFFE)


def utf8_length(cp: int) -> int:
    return len(chr(cp).encode()) if is_codepoint(cp) else 0


def encode(cp: int) -> bytes | None:
    return chr(cp).encode() if is_codepoint(cp) else None


def decode(data: bytes, policy: str = "REFUSE") -> str | None:
    """Text, or None where REFUSE meets ill-formed bytes; REPLACE puts one U+FFFD for each maximal subpart."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        if policy == "REFUSE":
            return None
        if policy not in POLICIES:
            raise ValueError(f"policy must be one of {POLICIES}") from None
        return data.decode(errors="replace" if policy == "REPLACE" else "ignore")


def error_offset(data: bytes) -> int | None:
    """The first ill-formed byte, or None."""
    try:
        data.decode()
    except UnicodeDecodeError as e:
        return e.start
    return None


def count(data: bytes, policy: str = "REFUSE") -> int | None:
    text = decode(data, policy)
    return None if text is None else len(text)


def to_codepoints(data: bytes, policy: str = "REFUSE") -> list[int] | None:
    text = decode(data, policy)
    return None if text is None else [ord(c) for c in text]


def from_codepoints(cps: list[int], policy: str = "REFUSE") -> str | None:
    out = []
    for cp in cps:
        if is_codepoint(cp):
            out.append(chr(cp))
        elif policy == "REFUSE":
            return None
        elif policy == "REPLACE":
            out.append("�")
    return "".join(out)


def codepoints(data: bytes, policy: str = "REPLACE"):
    """(index, byte offset, codepoint, well formed) of each codepoint or maximal subpart."""
    at = i = 0
    while at < len(data):
        try:
            text, stop, bad = data[at:].decode(), len(data), None
        except UnicodeDecodeError as e:
            text, stop, bad = data[at : at + e.start].decode(), at + e.start, (at + e.start, at + e.end)
        for c in text:
            yield i, at, ord(c), True
            at += len(c.encode())
            i += 1
        at = stop
        if bad:
            if policy == "REFUSE":
                return
            if policy == "REPLACE":
                yield i, bad[0], 0xFFFD, False
                i += 1
            at = bad[1]


def prev(data: bytes, at: int) -> int:
    """Where the codepoint (or ill-formed byte) before `at` begins."""
    for n in range(1, min(4, at) + 1):
        if data[at - n] & 0xC0 != 0x80:
            try:
                if len(data[at - n : at].decode()) == 1:
                    return at - n
            except UnicodeDecodeError:
                pass
            break
    return max(0, at - 1)
