"""Published test vectors of the algorithms, as rows: what is asked and what must come out."""

from __future__ import annotations

from ..text import bidi, case, names, norm, script, segment, utf
from ..ucd import properties as U


def _t(hexes: str) -> str:
    return "".join(chr(int(x, 16)) for x in hexes.split())


def _b(text: str, kind: str, *options) -> str:
    return " ".join(map(str, segment.boundaries(text, kind, *options)))


def _h(text: str) -> str:
    return " ".join(f"{ord(c):X}" for c in text)


# -- fixed values: (name, arguments, expected); arguments are hexadecimal codepoints first
BREAKS = [
    ("grapheme", "1F468 200D 1F469 200D 1F467", "", "0 5"), ("grapheme", "1F1FA 1F1F8 1F1EC 1F1E7", "", "0 2 4"), ("grapheme", "1F1FA 1F1F8 1F1EC", "", "0 2 3"), ("grapheme", "61 301 316 62", "", "0 3 4"),
    ("grapheme", "D A", "", "0 2"), ("grapheme", "A D", "", "0 1 2"), ("grapheme", "1100 1161 11A8", "", "0 3"), ("grapheme", "915 94D 937", "", "0 3"), ("grapheme", "1F44D 1F3FB", "", "0 2"),
    ("word", "6F 6E 65 20 74 77 6F", "", "0 3 4 7"), ("sentence", "4F 6E 65 2E 20 54 77 6F 2E", "", "0 5 9"), ("sentence", "41 2E 2029 42", "", "0 3 4"), ("line", "61", "", "1"), ("grapheme", "61", "", "0 1"),
    ("line", "E01 E01 E01 E01 E01 E01 E01", "", "7"), ("line", "24 28 2E 35", "", "4"), ("line", "30A2 30FC 30A2", "STRICT", "2 3"), ("line", "30A2 30FC 30A2", "NORMAL", "2 3"), ("line", "30A2 30FC 30A2", "LOOSE", "1 2 3"),
    ("line", "4E00 301C 4E00", "NORMAL JAPANESE", "1 2 3"), ("line", "4E00 301C 4E00", "STRICT JAPANESE", "2 3"), ("line", "4E00 301C 4E00", "NORMAL", "2 3"), ("line", "61 301 62", "ANYWHERE", "2 3"),
]
CASES = [
    ("upper", "DF", "NONE", "53 53"), ("title", "DF", "NONE", "53 73"), ("lower", "39F 3A3", "NONE", "3BF 3C2"), ("lower", "3A3 39F", "NONE", "3C3 3BF"), ("lower", "130", "TURKIC", "69"), ("lower", "130", "NONE", "69 307"),
    ("upper", "69", "TURKIC", "130"), ("lower", "49", "TURKIC", "131"), ("lower", "49 307", "TURKIC", "69"), ("lower", "49 300 307", "TURKIC", "131 300 307"), ("upper", "69 307", "LITHUANIAN", "49"),
    ("lower", "CC", "LITHUANIAN", "69 307 300"), ("upper", "FB03", "NONE", "46 46 49"), ("lower", "FB03", "NONE", "FB03"), ("fold", "DF", "NONE", "73 73"), ("fold", "49", "TURKIC", "131"),
    ("title", "68 65 6C 6C 6F 20 57 4F 52 4C 44 20 6F 27 6E 65 69 6C 6C", "NONE", "48 65 6C 6C 6F 20 57 6F 72 6C 64 20 4F 27 6E 65 69 6C 6C"), ("orbit", "6B", "NONE", "4B 6B 212A"), ("orbit", "31", "NONE", "31"),
    ("title_simple", "1F3", "NONE", "1F2"), ("upper_simple", "1F3", "NONE", "1F1"), ("upper_simple", "DF", "NONE", "DF"),
]
NORMS = [
    ("NFD", "1E14", "45 304 300"), ("NFKD", "FB01", "66 69"), ("NFD", "FB01", "FB01"), ("NFC", "1100 1161 11A8", "AC01"), ("NFD", "AC01", "1100 1161 11A8"), ("NFC", "41 301", "C1"), ("NFC", "41 30A", "C5"),
    ("NFD", "61 301 316", "61 316 301"), ("check NFC", "41 301", "Maybe"), ("check NFD", "C1", "No"), ("check NFD", "61 301 316", "No"), ("order", "61 301 316 300", "61 316 301 300"), ("order", "301 62 316", "301 62 316"),
    ("stream", "61 " + "301 " * 40, "61" + " 301" * 30 + " 34F" + " 301" * 10),
]
BIDI = [
    ("LTR", "61 5D0 5D1 62", "0 1 1 0", "0 2 1 3"), ("RTL", "61 5D0 5D1 62", "2 1 1 2", "3 2 1 0"), ("RTL", "5D0 31 32 5D1", "1 2 2 1", "3 1 2 0"), ("LTR", "5D0 20", "1 0", "0 1"), ("LTR", "5D0 20 5D1", "1 1 1", "2 1 0"),
    ("LTR", "61 20 28 5D0 5D1 29 20 62", "0 0 0 1 1 0 0 0", "0 1 2 4 3 5 6 7"), ("LTR", "5D0 20 28 5D0 5D1 29 20 5D1", "1 1 1 1 1 1 1 1", "7 6 5 4 3 2 1 0"), ("LTR", "5D0 28 78 29 5D1", "1 0 0 0 1", "0 1 2 3 4"),
]
SCRIPTS = [
    ("run", "70 61 79 70 61 6C", "true"), ("run", "70 430 79 70 61 6C", "false"), ("run", "2E 3B1", "true"), ("run", "2E 3B1 430", "false"), ("run", "6F22 3042", "true"), ("run", "6F22 AC00", "true"), ("run", "6F22 3105", "true"),
    ("run", "6F22 AC00 3105", "false"), ("run", "3042 AC00", "false"), ("run", "31 662", "false"), ("run", "915 966 31", "false"), ("run", "E0000", "true"), ("run", "E0000 61", "false"),
    ("items", "3B1 3B2 20 61 62 20 3B3", "0+3 Greek, 3+3 Latin, 6+1 Greek"), ("items", "22 20 5D0 5D1", "0+4 Hebrew"), ("items", "20 2E 31", "0+3 Common"), ("items", "61 964 62", "0+3 Latin"), ("items", "964 61", "0+2 Latin"), ("items", "915 964 916", "0+3 Devanagari"), ("items", "2C80 375 2C81", "0+3 Coptic"),
]
NAMES = [
    ("name", "41", "LATIN CAPITAL LETTER A"), ("name", "DF", "LATIN SMALL LETTER SHARP S"), ("name", "4E00", "CJK UNIFIED IDEOGRAPH-4E00"), ("name", "17000", "TANGUT IDEOGRAPH-17000"), ("name", "AC01", "HANGUL SYLLABLE GAG"),
    ("name", "0", ""), ("name", "378", ""), ("find", "MARCHEN LETTER -A", "11C88"), ("find", "MARCHEN LETTER A", "11C8F"), ("find", "HANGUL JUNGSEONG OE", "116C"), ("find", "HANGUL JUNGSEONG O-E", "1180"),
    ("find", "CJK UNIFIED IDEOGRAPH-4E00ZZ", ""), ("find", "CJK UNIFIED IDEOGRAPH-0041", ""), ("sequence", "LATIN SMALL LETTER A WITH MACRON AND GRAVE", "101 300"),
]
UTFS = [
    ("REPLACE", "E18041", "FFFD 41"), ("REPLACE", "F09F9841", "FFFD 41"), ("REPLACE", "C0AF", "FFFD FFFD"), ("REPLACE", "EDA080", "FFFD FFFD FFFD"), ("REPLACE", "F0808080", "FFFD FFFD FFFD FFFD"), ("REPLACE", "F4908080", "FFFD FFFD FFFD FFFD"),
    ("REPLACE", "41C2A9FF42", "41 A9 FFFD 42"), ("SKIP", "41C2A9FF42", "41 A9 42"), ("REFUSE", "41C2A9FF42", "error at 3"), ("REFUSE", "C0AF", "error at 0"), ("REFUSE", "41CEA9E697A5F09F98807A", "41 3A9 65E5 1F600 7A"),
]
CHARS = [
    ("General_Category", "41", "Uppercase_Letter"), ("Script", "41", "Latin"), ("Canonical_Combining_Class", "41", "0"), ("Bidi_Class", "41", "Left_To_Right"), ("East_Asian_Width", "41", "Narrow"), ("Line_Break", "41", "Alphabetic"),
    ("Word_Break", "41", "ALetter"), ("Grapheme_Cluster_Break", "41", "Other"), ("Joining_Type", "41", "Non_Joining"), ("General_Category", "301", "Nonspacing_Mark"), ("Canonical_Combining_Class", "301", "230"),
    ("Grapheme_Cluster_Break", "301", "Extend"), ("Script", "301", "Inherited"), ("Line_Break", "301", "Combining_Mark"), ("Script", "628", "Arabic"), ("Joining_Type", "628", "Dual_Joining"), ("Bidi_Class", "628", "Arabic_Letter"),
    ("Hangul_Syllable_Type", "AC00", "LV_Syllable"), ("Hangul_Syllable_Type", "AC01", "LVT_Syllable"), ("Line_Break", "30FC", "Conditional_Japanese_Starter"), ("Line_Break", "E01", "Complex_Context"), ("Line_Break", "BD", "Ambiguous"),
    ("Line_Break", "378", "Unknown"), ("General_Category", "1F600", "Other_Symbol"), ("East_Asian_Width", "1F600", "Wide"), ("Emoji", "1F600", "Yes"), ("Emoji_Presentation", "1F600", "Yes"), ("Extended_Pictographic", "1F600", "Yes"),
    ("Emoji_Modifier", "1F600", "No"), ("Numeric_Value", "37", "7/1"), ("Numeric_Value", "BD", "1/2"), ("Numeric_Value", "F33", "-1/2"), ("Numeric_Value", "5146", "1000000000000/1"), ("Script", "964", "Common"), ("General_Category", "110000", "Unassigned"),
    ("Any", "110000", "No"),
]
SETS = [
    ("property", "gc", "General_Category"), ("property", "generalcategory", "General_Category"), ("property", "GENERAL-CATEGORY", "General_Category"), ("property", "  general category  ", "General_Category"), ("property", "nope", ""),
    ("Canonical_Combining_Class", "AL", "228"), ("Line_Break", "AL", "Alphabetic"), ("Canonical_Combining_Class", "230", "230"), ("General_Category", "cntrl", "Control"),
]


def answer(kind: str, op: str, arg: str, option: str = "") -> str:
    """What this library says."""
    if kind == "breaks":
        return _b(_t(arg), op, *option.split())
    if kind == "cases":
        if op == "orbit":
            return " ".join(f"{c:X}" for c in case.case_orbit(int(arg, 16)))
        if op.endswith("simple"):
            return f"{(case.to_title_simple if op[0] == 't' else case.to_upper_simple)(int(arg, 16)):X}"
        return _h({"upper": case.to_upper, "lower": case.to_lower, "title": case.to_title, "fold": case.case_fold}[op](_t(arg), option))
    if kind == "norms":
        if op.startswith("check"):
            return norm.quick_check_text(op[6:], _t(arg))
        if op == "order":
            return " ".join(f"{c:X}" for c in norm.canonical_order([ord(c) for c in _t(arg)]))
        return _h(norm.stream_safe(_t(arg)) if op == "stream" else norm.normalize(op, _t(arg)))
    if kind == "bidi":
        found = bidi.levels(_t(arg), op)[1]
        return " ".join(map(str, found)) + " / " + " ".join(map(str, bidi.reorder(found)))
    if kind == "scripts":
        return str(script.is_script_run(_t(arg))).lower() if op == "run" else ", ".join(f"{a}+{n} {s}" for a, n, s in script.items(_t(arg)))
    if kind == "names":
        if op == "name":
            return names.name(int(arg, 16)) or ""
        if op == "find":
            return "" if (c := names.codepoint_by_name(arg)) is None else f"{c:X}"
        return " ".join(f"{c:X}" for c in names.named_sequence(arg) or [])
    if kind == "utfs":
        data = bytes.fromhex(arg)
        found = utf.to_codepoints(data, op)
        return f"error at {utf.error_offset(data)}" if found is None else " ".join(f"{c:X}" for c in found)
    if kind == "chars":
        v = U.value(op, int(arg, 16))
        return "Yes" if v is True else "No" if v is False else f"{v[0]}/{v[1]}" if isinstance(v, tuple) else str(v)
    if op == "property":
        return U.property_by_name(arg) or ""
    v = U.value_by_name(op, arg)
    return "" if v is None else str(v)


def rows(kind: str) -> list[tuple[int, str, str, str, str]]:
    """(id, op, arg, option, expected)."""
    table = {"breaks": BREAKS, "cases": CASES, "norms": NORMS, "bidi": BIDI, "scripts": SCRIPTS, "names": NAMES, "utfs": UTFS, "chars": CHARS, "sets": SETS}[kind]
    out = []
    for i, r in enumerate(table):
        if kind == "bidi":
            out.append((i, r[0], r[1], "", f"{r[2]} / {r[3]}"))
        elif len(r) == 4:
            out.append((i, *r))
        else:
            out.append((i, r[0], r[1], "", r[2]))
    return out


KINDS = ("breaks", "cases", "norms", "bidi", "scripts", "names", "utfs", "chars", "sets")
