"""The character database, version 17.0, as runs and point lookups.

No data file is shipped: property values come from the installed `regex` module, whose data
are newer than 17.0; every codepoint that 17.0 had not assigned is set back to the property's
default. `regex` knows which codepoints have a value, this module knows the names.
"""

from __future__ import annotations

import bisect
import functools

import numpy as np
import regex
import unicodedata

UCD_VERSION = "17.0.0"
SIZE = 0x110000

# -- fixed values: the codepoints that version 17.0 added to what CPython's 15.1 and ICU's 16.0 know
ADDED_17 = (
    "088F 0C5C 0CDC 1ACF-1ADD 1AE0-1AEB 20C1 2B96 A7CE-A7CF A7D2 A7D4 A7F1 FBC3-FBD2 FD90-FD91 FDC8-FDCE 10940-10959 10EC5-10EC7 10ED0-10ED8 10EFA-10EFB 11B60-11B67 "
    "11DB0-11DDB 11DE0-11DE9 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18D09-18D1E 18D80-18DF2 1CCFA-1CCFC 1CEBA-1CED0 1CEE0-1CEF0 1E6C0-1E6DE 1E6E0-1E6F5 1E6FE-1E6FF 1F6D8 1F777-1F77A "
    "1F8D0-1F8D8 1FA54-1FA57 1FA8A 1FA8E 1FAC8 1FACD 1FAEA 1FAEF 1FBFA 2B73A-2B73F 2CEA2-2CEAD 323B0-33479"
)

# -- fixed values: long names of the values of each property, with the short name `regex` may want
ENUMERATED: dict[str, tuple[str, str, str]] = {
    "General_Category": ("gc", "Unassigned", "Uppercase_Letter Lowercase_Letter Titlecase_Letter Modifier_Letter Other_Letter Nonspacing_Mark Spacing_Mark Enclosing_Mark Decimal_Number Letter_Number Other_Number Connector_Punctuation Dash_Punctuation Open_Punctuation Close_Punctuation Initial_Punctuation Final_Punctuation Other_Punctuation Math_Symbol Currency_Symbol Modifier_Symbol Other_Symbol Space_Separator Line_Separator Paragraph_Separator Control Format Surrogate Private_Use Unassigned"),
    "Bidi_Class": ("bc", "Left_To_Right", "Left_To_Right Right_To_Left Arabic_Letter European_Number European_Separator European_Terminator Arabic_Number Common_Separator Nonspacing_Mark Boundary_Neutral Paragraph_Separator Segment_Separator White_Space Other_Neutral Left_To_Right_Embedding Left_To_Right_Override Right_To_Left_Embedding Right_To_Left_Override Pop_Directional_Format Left_To_Right_Isolate Right_To_Left_Isolate First_Strong_Isolate Pop_Directional_Isolate"),
    "East_Asian_Width": ("ea", "Neutral", "Ambiguous Fullwidth Halfwidth Neutral Narrow Wide"),
    "Line_Break": ("lb", "Unknown", "Ambiguous Aksara Aksara_Prebase Aksara_Start Alphabetic Break_After Break_Before Break_Both Break_Symbols Carriage_Return Close_Parenthesis Close_Punctuation Combining_Mark Complex_Context Conditional_Japanese_Starter Contingent_Break E_Base E_Modifier Exclamation Glue H2 H3 Hebrew_Letter Hyphen Ideographic Infix_Numeric Inseparable JL JT JV Line_Feed Mandatory_Break Next_Line Nonstarter Numeric Open_Punctuation Postfix_Numeric Prefix_Numeric Quotation Regional_Indicator Space Surrogate Unambiguous_Hyphen Unknown Virama Virama_Final Word_Joiner ZWJ ZWSpace"),
    "Grapheme_Cluster_Break": ("GCB", "Other", "CR LF Control Extend ZWJ Regional_Indicator Prepend SpacingMark L V T LV LVT Other"),
    "Word_Break": ("WB", "Other", "CR LF Newline Extend ZWJ Regional_Indicator Format Katakana Hebrew_Letter ALetter Single_Quote Double_Quote MidNumLet MidLetter MidNum Numeric ExtendNumLet WSegSpace Other"),
    "Sentence_Break": ("SB", "Other", "CR LF Extend Sep Format Sp Lower Upper OLetter Numeric ATerm SContinue STerm Close Other"),
    "Joining_Type": ("jt", "Non_Joining", "Dual_Joining Join_Causing Left_Joining Non_Joining Right_Joining Transparent"),
    "Joining_Group": ("jg", "No_Joining_Group", "African_Feh African_Noon African_Qaf Ain Alaph Alef Beh Beth Burushaski_Yeh_Barree Dal Dalath_Rish E Farsi_Yeh Fe Feh Final_Semkath Gaf Gamal Hah Hanifi_Rohingya_Kinna_Ya Hanifi_Rohingya_Pa He Heh Heh_Goal Heth Kaf Kaph Kashmiri_Yeh Khaph Knotted_Heh Lam Lamadh Malayalam_Bha Malayalam_Ja Malayalam_Lla Malayalam_Llla Malayalam_Nga Malayalam_Nna Malayalam_Nnna Malayalam_Nya Malayalam_Ra Malayalam_Ssa Malayalam_Tta Manichaean_Aleph Manichaean_Ayin Manichaean_Beth Manichaean_Daleth Manichaean_Dhamedh Manichaean_Five Manichaean_Gimel Manichaean_Heth Manichaean_Hundred Manichaean_Kaph Manichaean_Lamedh Manichaean_Mem Manichaean_Nun Manichaean_One Manichaean_Pe Manichaean_Qoph Manichaean_Resh Manichaean_Sadhe Manichaean_Samekh Manichaean_Taw Manichaean_Ten Manichaean_Teth Manichaean_Thamedh Manichaean_Twenty Manichaean_Waw Manichaean_Yodh Manichaean_Zayin Meem Mim No_Joining_Group Noon Nun Nya Pe Qaf Qaph Reh Reversed_Pe Rohingya_Yeh Sad Sadhe Seen Semkath Shin Straight_Waw Swash_Kaf Syriac_Waw Tah Taw Teh_Marbuta Teh_Marbuta_Goal Teth Thin_Noon Thin_Yeh Vertical_Tail Waw Yeh Yeh_Barree Yeh_With_Tail Yudh Yudh_He Zain Zhain"),
    "Hangul_Syllable_Type": ("hst", "Not_Applicable", "Leading_Jamo Vowel_Jamo Trailing_Jamo LV_Syllable LVT_Syllable Not_Applicable"),
    "Decomposition_Type": ("dt", "None", "Canonical Circle Compat Final Font Fraction Initial Isolated Medial Narrow Nobreak None Small Square Sub Super Vertical Wide"),
    "Numeric_Type": ("nt", "None", "Decimal Digit Numeric None"),
    "Indic_Conjunct_Break": ("InCB", "None", "Consonant Extend Linker None"),
    "Indic_Positional_Category": ("InPC", "Not_Applicable", "Bottom Bottom_And_Left Bottom_And_Right Left Left_And_Right Not_Applicable Overstruck Right Top Top_And_Bottom Top_And_Bottom_And_Left Top_And_Bottom_And_Right Top_And_Left Top_And_Left_And_Right Top_And_Right Visual_Order_Left"),
    "Indic_Syllabic_Category": ("InSC", "Other", "Avagraha Bindu Brahmi_Joining_Number Cantillation_Mark Consonant Consonant_Dead Consonant_Final Consonant_Head_Letter Consonant_Initial_Postfixed Consonant_Killer Consonant_Medial Consonant_Placeholder Consonant_Preceding_Repha Consonant_Prefixed Consonant_Subjoined Consonant_Succeeding_Repha Consonant_With_Stacker Gemination_Mark Invisible_Stacker Joiner Modifying_Letter Non_Joiner Nukta Number Number_Joiner Other Pure_Killer Register_Shifter Reordering_Killer Syllable_Modifier Tone_Letter Tone_Mark Virama Visarga Vowel Vowel_Dependent Vowel_Independent"),
    "NFC_Quick_Check": ("NFC_QC", "Yes", "Yes No Maybe"),
    "NFD_Quick_Check": ("NFD_QC", "Yes", "Yes No"),
    "NFKC_Quick_Check": ("NFKC_QC", "Yes", "Yes No Maybe"),
    "NFKD_Quick_Check": ("NFKD_QC", "Yes", "Yes No"),
    "Script": ("sc", "Unknown", "Adlam Ahom Anatolian_Hieroglyphs Arabic Armenian Avestan Balinese Bamum Bassa_Vah Batak Bengali Beria_Erfe Bhaiksuki Bopomofo Brahmi Braille Buginese Buhid Canadian_Aboriginal Carian Caucasian_Albanian Chakma Cham Cherokee Chorasmian Common Coptic Cuneiform Cypriot Cypro_Minoan Cyrillic Deseret Devanagari Dives_Akuru Dogra Duployan Egyptian_Hieroglyphs Elbasan Elymaic Ethiopic Garay Georgian Glagolitic Gothic Grantha Greek Gujarati Gunjala_Gondi Gurmukhi Gurung_Khema Han Hangul Hanifi_Rohingya Hanunoo Hatran Hebrew Hiragana Imperial_Aramaic Inherited Inscriptional_Pahlavi Inscriptional_Parthian Javanese Kaithi Kannada Katakana Kawi Kayah_Li Kharoshthi Khitan_Small_Script Khmer Khojki Khudawadi Kirat_Rai Lao Latin Lepcha Limbu Linear_A Linear_B Lisu Lycian Lydian Mahajani Makasar Malayalam Mandaic Manichaean Marchen Masaram_Gondi Medefaidrin Meetei_Mayek Mende_Kikakui Meroitic_Cursive Meroitic_Hieroglyphs Miao Modi Mongolian Mro Multani Myanmar Nabataean Nag_Mundari Nandinagari New_Tai_Lue Newa Nko Nushu Nyiakeng_Puachue_Hmong Ogham Ol_Chiki Ol_Onal Old_Hungarian Old_Italic Old_North_Arabian Old_Permic Old_Persian Old_Sogdian Old_South_Arabian Old_Turkic Old_Uyghur Oriya Osage Osmanya Pahawh_Hmong Palmyrene Pau_Cin_Hau Phags_Pa Phoenician Psalter_Pahlavi Rejang Runic Samaritan Saurashtra Sharada Shavian Siddham Sidetic SignWriting Sinhala Sogdian Sora_Sompeng Soyombo Sundanese Sunuwar Syloti_Nagri Syriac Tagalog Tagbanwa Tai_Le Tai_Tham Tai_Viet Tai_Yo Takri Tamil Tangsa Tangut Telugu Thaana Thai Tibetan Tifinagh Tirhuta Todhri Tolong_Siki Toto Tulu_Tigalari Ugaritic Unknown Vai Vithkuqi Wancho Warang_Citi Yezidi Yi Zanabazar_Square"),
}
BINARY = (
    "ASCII_Hex_Digit Alphabetic Any ASCII Assigned Bidi_Control Bidi_Mirrored Case_Ignorable Cased Changes_When_Casefolded Changes_When_Casemapped Changes_When_Lowercased Changes_When_Titlecased "
    "Changes_When_Uppercased Changes_When_NFKC_Casefolded Dash Default_Ignorable_Code_Point Deprecated Diacritic Emoji Emoji_Component Emoji_Modifier Emoji_Modifier_Base Emoji_Presentation "
    "Expands_On_NFC Expands_On_NFD Expands_On_NFKC Expands_On_NFKD Extended_Pictographic Extender Full_Composition_Exclusion Grapheme_Base Grapheme_Extend Grapheme_Link Hex_Digit Hyphen "
    "IDS_Binary_Operator IDS_Trinary_Operator IDS_Unary_Operator ID_Compat_Math_Continue ID_Compat_Math_Start ID_Continue ID_Start Ideographic Join_Control Logical_Order_Exception Lowercase Math "
    "Modifier_Combining_Mark Noncharacter_Code_Point Other_Alphabetic Other_Default_Ignorable_Code_Point Other_Grapheme_Extend Other_ID_Continue Other_ID_Start Other_Lowercase Other_Math "
    "Other_Uppercase Pattern_Syntax Pattern_White_Space Prepended_Concatenation_Mark Quotation_Mark Radical Regional_Indicator Sentence_Terminal Soft_Dotted Terminal_Punctuation Unified_Ideograph "
    "Uppercase Variation_Selector White_Space XID_Continue XID_Start"
).split()
#: Defined over unassigned codepoints too.
OVER_ALL = {"Any", "ASCII", "Extended_Pictographic", "Default_Ignorable_Code_Point", "Pattern_Syntax", "Noncharacter_Code_Point", "Pattern_White_Space"}
MASKS = {"L": "Lu Ll Lt Lm Lo", "LC": "Lu Ll Lt", "M": "Mn Mc Me", "N": "Nd Nl No", "P": "Pc Pd Ps Pe Pi Pf Po", "S": "Sm Sc Sk So", "Z": "Zs Zl Zp", "C": "Cc Cf Cs Co Cn"}


@functools.cache
def _all() -> str:
    return "".join(map(chr, range(SIZE)))


def _spans(pattern: str) -> list[tuple[int, int]]:
    return [m.span() for m in regex.finditer(pattern, _all())]


@functools.cache
def assigned() -> np.ndarray:
    """Assigned in 17.0: what CPython 15.1 assigns, the 16.0 additions, and those of 17.0."""
    known = np.array([unicodedata.category(chr(c)) != "Cn" for c in range(SIZE)])
    for part in ADDED_17.split():
        a, _, b = part.partition("-")
        known[int(a, 16) : int(b or a, 16) + 1] = True
    for part in ADDED_16.split():
        a, _, b = part.partition("-")
        known[int(a, 16) : int(b or a, 16) + 1] = True
    return known


# -- fixed values: the codepoints that version 16.0 added to 15.1
ADDED_16 = (
    "0897 1B4E-1B4F 1B7F 1C89-1C8A 2427-2429 31E4-31E5 A7CB-A7CD A7DA-A7DC 105C0-105F3 10D40-10D65 10D69-10D85 10D8E-10D8F 10EC2-10EC4 10EFC 11380-11389 1138B 1138E 11390-113B5 113B7-113C0 113C2 "
    "113C5 113C7-113CA 113CC-113D5 113D7-113D8 113E1-113E2 116D0-116E3 11BC0-11BE1 11BF0-11BF9 11F5A 13460-143FA 16100-16139 16D40-16D79 18CFF 1CC00-1CCF9 1CD00-1CEB3 1E5D0-1E5FA 1E5FF "
    "1F8B2-1F8BB 1F8C0-1F8C1 1FA89 1FA8F 1FABE 1FAC6 1FADC 1FADF 1FAE9 1FBCB-1FBEF"
)


@functools.cache
def too_new() -> np.ndarray:
    """What the property source assigns and 17.0 does not."""
    out = ~assigned()
    for a, b in _spans(r"\p{Cn}+"):
        out[a:b] = False
    return out


# -- fixed values: defaults of unassigned codepoints by range
BIDI_DEFAULTS = [
    ("Right_To_Left", "0590-05FF 07C0-085F FB1D-FB4F 10800-10CFF 10D40-10EBF 10F00-10F2F 10F70-10FFF 1E800-1EC6F 1ECC0-1ECFF 1ED50-1EDFF 1EF00-1EFFF"),
    ("Arabic_Letter", "0600-07BF 0860-08FF FB50-FDCF FDF0-FDFF FE70-FEFF 10D00-10D3F 10EC0-10EFF 10F30-10F6F 1EC70-1ECBF 1ED00-1ED4F 1EE00-1EEFF"),
    ("European_Terminator", "20A0-20CF"),
]
WIDE_DEFAULTS = "3400-4DBF 4E00-9FFF F900-FAFF 20000-2FFFD 30000-3FFFD"
IDEOGRAPHIC_DEFAULTS = WIDE_DEFAULTS + " 1F000-1FAFF 1FC00-1FFFD"


def _ranges_of(text: str):
    for part in text.split():
        a, _, b = part.partition("-")
        yield int(a, 16), int(b or a, 16) + 1


# -- fixed values: where 17.0 differs from the property source; found by trying older values until count and hash agreed (of Line_Break the count alone does)
OVERRIDES = {
    "Bidi_Class": [("Nonspacing_Mark", "1B3A 1B3C 1B42"), ("Left_To_Right", "D800-DFFF")],
    "East_Asian_Width": [("Neutral", "D800-DFFF")],
    "Line_Break": [("Prefix_Numeric", "20C2-20C4"), ("Break_After", "00AD"), ("Ambiguous", "00B7"), ("Alphabetic", "0387 2800"), ("Glue", "034F"), ("Ideographic", "FE51")],
    "Numeric_Type": [("None", "32403 324DF")],
    "Indic_Conjunct_Break": [("None", "1CF5-1CF6 11A3A")],
    "Indic_Syllabic_Category": [("Vowel_Independent", "16100")],
    "Changes_When_NFKC_Casefolded": [(True, "2065 FFF0-FFF8 E0000 E0002-E001F E0080-E00FF E01F0-E0FFF")],
    "Script_Extensions": [(("Tamil",), "0B83"), (("Bengali", "Devanagari"), "1CF5-1CF6")],
    "Diacritic": [(False, "0656 06E2 08D3")],
    "Extended_Pictographic": [(True, "1F1AE 1F7DA-1F7DB 1F7F1-1F7FF")],
}


@functools.cache
def codes(prop: str) -> tuple[np.ndarray, tuple[str, ...]]:
    """Per codepoint a number, and the long name of each number; for enumerated properties."""
    short, default, names = ENUMERATED[prop]
    listed = tuple(names.split())
    out = np.full(SIZE, listed.index(default), np.uint8)
    for i, name in enumerate(listed):
        if name == default:
            continue
        try:
            found = _spans(rf"\p{{{short}={name}}}+")
        except regex.error:
            continue
        for a, b in found:
            out[a:b] = i
    new = ~assigned() if prop in ("Bidi_Class", "East_Asian_Width") else too_new()
    out[new] = listed.index(default)
    by_range = BIDI_DEFAULTS if prop == "Bidi_Class" else [("Wide", WIDE_DEFAULTS)] if prop == "East_Asian_Width" else [("Ideographic", IDEOGRAPHIC_DEFAULTS)] if prop == "Line_Break" else []
    for name, text in by_range:
        for a, b in _ranges_of(text):
            out[a:b][new[a:b]] = listed.index(name)
    if prop == "Bidi_Class":
        out[new & (binary("Default_Ignorable_Code_Point") | binary("Noncharacter_Code_Point"))] = listed.index("Boundary_Neutral")
    if prop == "East_Asian_Width":
        out[0xE000:0xF900] = out[0xF0000:0xFFFFE] = out[0x100000:0x10FFFE] = listed.index("Ambiguous")
    if prop == "General_Category":
        out[0xD800:0xE000] = listed.index("Surrogate")
        out[0x0295] = listed.index("Other_Letter")
    for name, text in OVERRIDES.get(prop, ()):
        for a, b in _ranges_of(text):
            out[a:b] = listed.index(name)
    return out, listed


@functools.cache
def combining_classes() -> np.ndarray:
    out = np.zeros(SIZE, np.uint8)
    for n in range(1, 255):
        try:
            for a, b in _spans(rf"\p{{ccc={n}}}+"):
                out[a:b] = n
        except regex.error:
            continue
    out[~assigned()] = 0
    return out


@functools.cache
def binary(prop: str) -> np.ndarray:
    """Per codepoint whether a binary property holds."""
    if prop == "Assigned":
        return assigned()
    out = np.zeros(SIZE, bool)
    from ..text import case, norm

    derived = {
        "Changes_When_Uppercased": lambda c: case.to_upper(norm.nfd(c)) != norm.nfd(c), "Changes_When_Lowercased": lambda c: case.to_lower(norm.nfd(c)) != norm.nfd(c),
        "Changes_When_Titlecased": lambda c: "".join(map(case.title_char, norm.nfd(c)[:1])) + norm.nfd(c)[1:] != norm.nfd(c), "Changes_When_Casefolded": lambda c: case.case_fold(norm.nfd(c)) != norm.nfd(c),
        "Full_Composition_Exclusion": lambda c: norm.decomposition(ord(c), False) != (ord(c),) and norm.normalize("NFC", norm.normalize("NFD", c)) != c,
        **{f"Expands_On_{f}": (lambda f: lambda c: len(norm.normalize(f, c)) > 1)(f) for f in ("NFC", "NFD", "NFKC", "NFKD")},
    }
    if prop == "Changes_When_Casemapped":
        return binary("Changes_When_Uppercased") | binary("Changes_When_Lowercased") | binary("Changes_When_Titlecased")
    if prop == "Changes_When_NFKC_Casefolded":
        derived[prop] = lambda c: norm.normalize("NFKC", case.case_fold(norm.normalize("NFKC", case.case_fold(norm.nfd(c))))) != c or binary("Default_Ignorable_Code_Point")[ord(c)]
    if prop in derived:
        test = derived[prop]
        for c in np.flatnonzero(assigned()):
            if not 0xD800 <= c < 0xE000:
                out[c] = test(chr(c))
    else:
        for a, b in _spans(rf"\p{{{prop}}}+"):
            out[a:b] = True
        if prop not in OVER_ALL:
            out &= ~too_new()
    for holds, text in OVERRIDES.get(prop, ()):
        for a, b in _ranges_of(text):
            out[a:b] = holds
    return out


@functools.cache
def script_extensions() -> tuple[np.ndarray, tuple[tuple[str, ...], ...]]:
    """Per codepoint the number of its set of scripts, and the sets (sorted long names)."""
    script, names = codes("Script")
    members: dict[int, list[str]] = {}
    for name in names:
        if name in ("Common", "Inherited", "Unknown"):
            continue
        try:
            for a, b in _spans(rf"\p{{scx={name}}}+"):
                for c in range(a, b):
                    if names[script[c]] != name or c in members:
                        members.setdefault(c, []).append(name)
        except regex.error:
            continue
    sets: dict[tuple[str, ...], int] = {}
    out = np.zeros(SIZE, np.uint16)
    for i, name in enumerate(names):
        sets[(name,)] = i
    out[:] = script
    have = assigned()
    probe = {c: set(m) for c, m in members.items()}
    for c, m in probe.items():
        if not have[c]:
            continue
        own = names[script[c]]
        if own not in ("Common", "Inherited") and regex.match(rf"\p{{scx={own}}}", chr(c)):
            m.add(own)
        key = tuple(sorted(m))
        out[c] = sets.setdefault(key, len(sets))
    for scripts, text in OVERRIDES["Script_Extensions"]:
        for a, b in _ranges_of(text):
            out[a:b] = sets.setdefault(scripts, len(sets))
    return out, tuple(sets)


# -- fixed values: numbers that the interpreter's older data lack
NUMERIC_17 = [((1, 1), "12038-12039 12079 1230B 16FF4"), ((2, 1), "1222B 12399 16FF6"), ((3, 1), "1230D"), ((1, 2), "12226"), ((3, 2), "16FF5")]


@functools.cache
def numeric_values() -> dict[int, tuple[int, int]]:
    """Exact values as (numerator, denominator)."""
    from fractions import Fraction

    out = {}
    for c in np.flatnonzero(assigned()):
        v = unicodedata.numeric(chr(c), None)
        if v is not None:
            f = Fraction(v).limit_denominator(1000)
            out[int(c)] = (f.numerator, f.denominator)
    out[0x5146] = (10**12, 1)
    for value, text in NUMERIC_17:
        for a, b in _ranges_of(text):
            out.update(dict.fromkeys(range(a, b), value))
    for a, b, base in ((0x1CCF0, 0x1CCF9, 0), (0x10D40, 0x10D49, 0), (0x116D0, 0x116D9, 0), (0x116DA, 0x116E3, 0), (0x11BF0, 0x11BF9, 0), (0x16130, 0x16139, 0), (0x16D70, 0x16D79, 0), (0x1E5F1, 0x1E5FA, 0), (0x11DE0, 0x11DE9, 0)):
        for c in range(a, b + 1):
            out[c] = (c - a + base, 1)
    return out


def value(prop: str, cp: int):
    """The value of any property at any number; numbers past the last codepoint have the defaults and no binary property."""
    inside = 0 <= cp < SIZE
    if prop == "Canonical_Combining_Class":
        return int(combining_classes()[cp]) if inside else 0
    if prop == "Script_Extensions":
        of, sets = script_extensions()
        return list(sets[of[cp]]) if inside else ["Unknown"]
    if prop == "Numeric_Value":
        return numeric_values().get(cp)
    if prop in ENUMERATED:
        of, names = codes(prop)
        return names[of[cp]] if inside else ENUMERATED[prop][1]
    return bool(binary(prop)[cp]) if inside else False


def runs(prop: str) -> list[tuple[int, int, str]]:
    """Maximal ranges (first, last, long name) over all codepoints."""
    if prop == "Script_Extensions":
        of, sets = script_extensions()
        name = lambda v: ",".join(sets[v])
    elif prop == "Canonical_Combining_Class":
        of, name = combining_classes(), str
    elif prop in ENUMERATED:
        of, names = codes(prop)
        name = names.__getitem__
    else:
        of = binary(prop).astype(np.uint8)
        name = ("No", "Yes").__getitem__
    edge = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    return [(int(a), int(b) - 1, name(int(of[a]))) for a, b in zip(edge, np.append(edge[1:], SIZE))]


def mapping_runs(name: str) -> list[tuple[int, int, str]]:
    """Maximal ranges of a case mapping or of the numeric values, as text: codepoints in hex or a fraction; None where nothing changes."""
    from ..text import case

    def codepoints(found, c: int) -> str:
        found = [ord(x) for x in found] if isinstance(found, str) else [found]
        return "None" if found == [c] else " ".join(f"{x:04X}" for x in found)

    of = {
        "Simple_Uppercase_Mapping": case.to_upper_simple, "Simple_Lowercase_Mapping": case.to_lower_simple, "Simple_Titlecase_Mapping": case.to_title_simple, "Simple_Case_Folding": case.case_fold_simple,
        "Uppercase_Mapping": lambda c: case.to_upper(chr(c)), "Lowercase_Mapping": lambda c: case.to_lower(chr(c)), "Titlecase_Mapping": lambda c: case.title_char(chr(c)), "Case_Folding": lambda c: case.case_fold(chr(c)),
    }
    if name == "Numeric_Value":
        text = lambda c: "{}/{}".format(*numeric_values()[c]) if c in numeric_values() else "None"
    else:
        text = lambda c: "None" if 0xD800 <= c < 0xE000 else codepoints(of[name](c), c)
    out: list[tuple[int, int, str]] = []
    start, now = 0, text(0)
    for c in range(1, SIZE):
        if (t := text(c)) != now:
            out.append((start, c - 1, now))
            start, now = c, t
    return [*out, (start, SIZE - 1, now)]


def fingerprint(prop: str) -> tuple[int, str]:
    """How many maximal ranges the property has, and the FNV-1a hash of their text."""
    h = 0xCBF29CE484222325
    rows = mapping_runs(prop) if prop.endswith(("_Mapping", "_Folding")) or prop == "Numeric_Value" else runs(prop)
    for a, b, v in rows:
        for byte in f"{a:06X}..{b:06X} {v}\n".encode():
            h = (h ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return len(rows), f"{h:016X}"


def ranges(prop: str, wanted: str) -> list[tuple[int, int]]:
    """Maximal ranges of {property = value}; for Script_Extensions of what contains it."""
    if prop == "Script_Extensions":
        hit = [(a, b) for a, b, v in runs(prop) if wanted in v.split(",")]
    else:
        hit = [(a, b) for a, b, v in runs(prop) if v == wanted]
    out: list[tuple[int, int]] = []
    for a, b in hit:
        if out and out[-1][1] + 1 == a:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def contains(found: list[tuple[int, int]], cp: int) -> bool:
    i = bisect.bisect_right(found, (cp, SIZE)) - 1
    return i >= 0 and found[i][0] <= cp <= found[i][1]


def loose(name: str) -> str:
    """The key of a property or value name: ASCII lower case without space, tab, line ends, _ and -; 96 bytes or more match nothing."""
    key = "".join(c for c in name if c not in " \t\n\v\f\r_-")
    key = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in key)
    return key if len(key.encode()) < 96 else ""


@functools.cache
def property_names() -> dict[str, str]:
    """Loose key of every spelling to the long name."""
    out = {loose(n): n for n in (*ENUMERATED, *BINARY, "Canonical_Combining_Class", "Script_Extensions", "Numeric_Value")}
    out |= {loose(short): n for n, (short, _, _) in ENUMERATED.items()}
    out |= {
        "ccc": "Canonical_Combining_Class", "scx": "Script_Extensions", "nv": "Numeric_Value", "space": "White_Space", "wspace": "White_Space", "alpha": "Alphabetic", "lower": "Lowercase", "upper": "Uppercase",
        "ahex": "ASCII_Hex_Digit", "hex": "Hex_Digit", "dep": "Deprecated", "dia": "Diacritic", "ext": "Extender", "ideo": "Ideographic", "joinc": "Join_Control", "bidic": "Bidi_Control", "bidim": "Bidi_Mirrored",
        "ci": "Case_Ignorable", "cwcf": "Changes_When_Casefolded", "cwcm": "Changes_When_Casemapped", "cwkcf": "Changes_When_NFKC_Casefolded", "cwl": "Changes_When_Lowercased", "cwt": "Changes_When_Titlecased",
        "cwu": "Changes_When_Uppercased", "di": "Default_Ignorable_Code_Point", "extpict": "Extended_Pictographic", "epres": "Emoji_Presentation", "emod": "Emoji_Modifier", "ebase": "Emoji_Modifier_Base",
        "ecomp": "Emoji_Component", "grbase": "Grapheme_Base", "grext": "Grapheme_Extend", "ids": "ID_Start", "idc": "ID_Continue", "xids": "XID_Start", "xidc": "XID_Continue", "ri": "Regional_Indicator",
        "sterm": "Sentence_Terminal", "term": "Terminal_Punctuation", "uideo": "Unified_Ideograph", "vs": "Variation_Selector", "nchar": "Noncharacter_Code_Point", "loe": "Logical_Order_Exception",
        "patsyn": "Pattern_Syntax", "patws": "Pattern_White_Space", "pcm": "Prepended_Concatenation_Mark", "qmark": "Quotation_Mark", "sd": "Soft_Dotted", "compex": "Full_Composition_Exclusion",
    }
    return out


# -- fixed values: short names of general categories, in the order of their long names above
GC_SHORT = "Lu Ll Lt Lm Lo Mn Mc Me Nd Nl No Pc Pd Ps Pe Pi Pf Po Sm Sc Sk So Zs Zl Zp Cc Cf Cs Co Cn".split()
_CCC = {0: "Not_Reordered", 1: "Overlay", 6: "Han_Reading", 7: "Nukta", 8: "Kana_Voicing", 9: "Virama", 200: "Attached_Below_Left", 202: "Attached_Below", 214: "Attached_Above", 216: "Attached_Above_Right", 218: "Below_Left", 220: "Below", 222: "Below_Right", 224: "Left", 226: "Right", 228: "Above_Left", 230: "Above", 232: "Above_Right", 233: "Double_Below", 234: "Double_Above", 240: "Iota_Subscript"}
_CCC_SHORT = {"NR": 0, "OV": 1, "HANR": 6, "NK": 7, "KV": 8, "VR": 9, "ATBL": 200, "ATB": 202, "ATA": 214, "ATAR": 216, "BL": 218, "B": 220, "BR": 222, "L": 224, "R": 226, "AL": 228, "A": 230, "AR": 232, "DB": 233, "DA": 234, "IS": 240}
#: Short names of line break and bidi classes, which differ from the long names' capitals.
LB_SHORT = dict(zip("AI AK AP AS AL BA BB B2 SY CR CP CL CM SA CJ CB EB EM EX GL H2 H3 HL HY ID IS IN JL JT JV LF BK NL NS NU OP PO PR QU RI SP SG HH XX VI VF WJ ZWJ ZW".split(), ENUMERATED["Line_Break"][2].split()))
BC_SHORT = dict(zip("L R AL EN ES ET AN CS NSM BN B S WS ON LRE LRO RLE RLO PDF LRI RLI FSI PDI".split(), ENUMERATED["Bidi_Class"][2].split()))


def property_by_name(name: str) -> str | None:
    return property_names().get(loose(name)) if loose(name) else None


def value_by_name(prop: str, name: str) -> str | int | None:
    """The long name of a value (a number for combining classes), by any spelling."""
    key = loose(name)
    if not key:
        return None
    if prop == "Canonical_Combining_Class":
        if key.isascii() and key.isdigit() and int(key) <= 254:
            return int(key)
        return next((n for n, v in _CCC.items() if loose(v) == key), None) if key.upper() not in _CCC_SHORT else _CCC_SHORT[key.upper()]
    if prop in BINARY:
        return {"y": "Yes", "yes": "Yes", "t": "Yes", "true": "Yes", "n": "No", "no": "No", "f": "No", "false": "No"}.get(key)
    prop = "Script" if prop == "Script_Extensions" else prop
    if prop not in ENUMERATED:
        return None
    names = ENUMERATED[prop][2].split()
    known = {loose(n): n for n in names}
    if prop == "General_Category":
        known |= {loose(s): n for s, n in zip(GC_SHORT, names)} | {"cntrl": "Control", "digit": "Decimal_Number", "punct": None}
    if prop == "Line_Break":
        known |= {loose(s): n for s, n in LB_SHORT.items()}
    if prop == "Bidi_Class":
        known |= {loose(s): n for s, n in BC_SHORT.items()}
    return known.get(key)


def property_kind(prop: str) -> str:
    return "CCC" if prop == "Canonical_Combining_Class" else "SCX" if prop == "Script_Extensions" else "BLOCK" if prop == "Block" else "QC" if prop.endswith("Quick_Check") else "ENUM" if prop in ENUMERATED else "BINARY"


def value_name(prop: str, code: int) -> str:
    if prop == "Canonical_Combining_Class":
        return _CCC.get(code, "")
    return ENUMERATED[prop][2].split()[code] if prop in ENUMERATED else ("No", "Yes")[code]


def value_count(prop: str) -> int:
    return len(ENUMERATED[prop][2].split()) if prop in ENUMERATED else 255 if prop == "Canonical_Combining_Class" else 2


def gc_mask(group: str) -> int:
    """The bits 1 << category of a group such as L, LC, M, or of one category."""
    return sum(1 << GC_SHORT.index(s) for s in MASKS.get(group, group).split())


def gc_mask_ranges(mask: int) -> list[tuple[int, int]]:
    of, _ = codes("General_Category")
    hit = np.append(np.append(False, (mask >> of.astype(np.int64)) & 1 == 1), False)
    edge = np.flatnonzero(hit[1:] != hit[:-1])
    return [(int(a), int(b) - 1) for a, b in zip(edge[::2], edge[1::2])]
