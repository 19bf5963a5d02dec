"""Pure cores: published vectors, invariants, differential checks against the interpreter's tables."""

import random
import unicodedata

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphmill.plans import queries, vectors
from glyphmill.text import bidi, case, norm, script, segment, utf
from glyphmill.ucd import properties as U

TEXT = st.text(alphabet=st.one_of(st.sampled_from("ab 1.,'\"\r\n-é́‍가각ᄀ👍🏻🇺🇸कष्ा:;!?()[]あア漢$%٣שבا"), st.characters(exclude_categories=["Cs", "Cn"])), max_size=25)


@pytest.mark.parametrize("kind", vectors.KINDS)
def test_vectors(kind):
    for _, op, arg, option, expected in vectors.rows(kind):
        assert vectors.answer(kind, op, arg, option) == expected, (kind, op, arg, option)


@pytest.mark.parametrize("prop", sorted(queries.FINGERPRINTS))
def test_property_fingerprints(prop):
    assert U.fingerprint(prop) == queries.FINGERPRINTS[prop]


@pytest.mark.xfail(reason="Line_Break is not exact")
def test_line_break_fingerprint():
    assert U.fingerprint("Line_Break") == queries.INEXACT["Line_Break"]


def test_greek_ranges():
    assert U.ranges("Script", "Greek") == [(int(a, 16), int(b or a, 16)) for a, _, b in (p.partition("-") for p in GREEK.split())]


# -- fixed values: the Greek script
GREEK = "0370-0373 0375-0377 037A-037D 037F 0384 0386 0388-038A 038C 038E-03A1 03A3-03E1 03F0-03FF 1D26-1D2A 1D5D-1D61 1D66-1D6A 1DBF 1F00-1F15 1F18-1F1D 1F20-1F45 1F48-1F4D 1F50-1F57 1F59 1F5B 1F5D 1F5F-1F7D 1F80-1FB4 1FB6-1FC4 1FC6-1FD3 1FD6-1FDB 1FDD-1FEF 1FF2-1FF4 1FF6-1FFE 2126 AB65 10140-1018E 101A0 1D200-1D245"


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_normal_forms(text):
    for form in norm.FORMS:
        once = norm.normalize(form, text)
        assert norm.normalize(form, once) == once and norm.is_normalized(form, once)
        own = "".join(map(chr, norm.normalize_cps(form, [ord(c) for c in text])))
        assert own == once
        if norm.quick_check_text(form, text) == "Yes":
            assert once == text
    assert norm.normalize("NFC", norm.normalize("NFD", text)) == norm.normalize("NFC", text)
    assert norm.is_stream_safe(norm.stream_safe(text, 3), 3)


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_boundaries(text):
    for kind in segment.KINDS:
        found = segment.boundaries(text, kind)
        assert found == sorted(set(found))
        assert "".join(segment.segments(text, kind)) == text
        assert not text or found[-1] == len(text)
    assert segment.boundaries(text, "line", "ANYWHERE") == segment.boundaries(text, "grapheme")[1:]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab é́‍가각ᄀ👍🏻🇺🇸कष्ा\r\n", max_size=20))
def test_graphemes_against_another_engine(text):
    assert segment.boundaries(text, "grapheme")[1:] == [m.end() for m in regex.finditer(r"\X", text)]


@settings(max_examples=150, deadline=None)
@given(TEXT, st.sampled_from(["LTR", "RTL", "AUTO"]))
def test_bidi(text, direction):
    base, found = bidi.levels(text, direction)
    assert len(found) == len(text) and all(0 <= x <= 126 for x in found) and base in (0, 1)
    assert sorted(bidi.reorder(found)) == list(range(len(text)))


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_case_and_scripts(text):
    folded = case.case_fold(text)
    assert case.case_fold(folded) == folded
    if not any(unicodedata.category(c) == "Cn" for c in text):
        assert folded == text.casefold() and case.to_upper(text) == text.upper()
    found = script.items(text)
    assert sum(n for _, n, _ in found) == len(text) and [a for a, _, _ in found] == [sum(n for _, n, _ in found[:i]) for i in range(len(found))]


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=12))
def test_utf8(data):
    for policy in ("REPLACE", "SKIP"):
        walk = [cp for _, _, cp, _ in utf.codepoints(data, policy)]
        assert walk == utf.to_codepoints(data, policy)
    assert (utf.decode(data) is None) == (utf.error_offset(data) is not None)


def test_ranges_agree_with_points():
    for prop, value in (("Script", "Greek"), ("General_Category", "Decimal_Number"), ("Script_Extensions", "Devanagari"), ("White_Space", "Yes")):
        found = U.ranges(prop, value)
        assert all(a[1] + 1 < b[0] for a, b in zip(found, found[1:]))
        for cp in (0x20, 0x30, 0x370, 0x3B1, 0x964, 0x3FFF, 0x10FFFF):
            v = U.value(prop, cp)
            inside = value in v if isinstance(v, list) else v is True if isinstance(v, bool) else v == value
            assert U.contains(found, cp) == inside


def test_break_provider():
    text = "ก" * 7
    assert segment.boundaries(text, "line", provider=lambda cps, a, b, p: p % 3 == 0) == [3, 6, 7]


def test_masks():
    assert U.gc_mask("Lu") == 1 and U.gc_mask("L") == 31
    assert U.gc_mask_ranges(U.gc_mask("Nd"))[0] == (0x30, 0x39)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab \r\n\u0301\u200d\U0001F1E6\U0001F1E7\U0001F468\U0001F3FD\u0915\u094d\u1100\u1161\u11a8\uac00\u0600é"), max_size=14))
def test_grapheme_windows(text):
    """Asking the rules only around joining characters gives what they say about the whole text."""
    assert segment._grapheme(text) == segment._grapheme_rules(text) and segment.grapheme_count(text) == (len(segment._grapheme_rules(text)) + 1 if text else 0)


_PIECES = "a B é . , ' : ! ? ) \" 1 2 _ \r \n \u2029 \u0301 \u200d \u00ad \u05d0 \u30ab \U0001F1E6 \U0001F468 \u4e00".split(" ") + [" ", "  "]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(_PIECES), max_size=14).map("".join))
def test_word_and_sentence_windows(text):
    if text:
        assert segment._word(text) == segment._word_rules(text)
        assert segment._sentence(text) == segment._sentence_rules(text)


def test_bidi_of_left_to_right_text_takes_no_passes(monkeypatch):
    """Text without right-to-left characters: the same levels as by all rules, and a long one without them."""
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab 1,.+-%$()[]«»\n\té\u0301漢\u00a0\u200b\u2028😀\u0085") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    texts += [t + x + t for t in texts[:40] for x in "א٣\u202a\u2067ع\u2069"]
    fast = [bidi.levels(t, d) for t in texts for d in ("AUTO", "LTR", "RTL")]
    flat = bidi._flat
    monkeypatch.setattr(bidi, "_flat", lambda text: False)
    assert fast == [bidi.levels(t, d) for t in texts for d in ("AUTO", "LTR", "RTL")]
    monkeypatch.setattr(bidi, "_flat", flat)
    monkeypatch.setattr(bidi, "_resolve", None)
    assert bidi.levels("été 12% (x) " * 50_000) == (0, [0] * 600_000)
