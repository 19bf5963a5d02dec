"""Text functions for DataFrames and SQL.

Scalar functions are Arrow-batched; each takes a column (a name or a Column) and keyword
options, and `register` gives them SQL names. What Catalyst can express by itself is a plain
expression (`utf8_length`, `is_codepoint`, ...), so it stays inside generated code.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..shipping import ship
from ..text import bidi, case, names, norm, script, segment, utf
from ..ucd import properties as U
from . import lookup

# -- limits and results --------------------------------------------------------------------

LIMITS = {"max_text_bytes": 64 << 20, "max_bidi_depth": bidi.DEPTH, "max_nonstarters": 30}
RESULTS = {0: "ok", 1: "invalid argument", 2: "ill-formed text", 3: "limit reached", 4: "out of memory", 5: "not found", 6: "input or output failed", 7: "unknown format", 8: "corrupt data"}


def result_string(code) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in RESULTS.items() for x in kv]), _col(code))


def version() -> Column:
    return F.lit(__version__)


def version_number() -> Column:
    a, b, c = map(int, __version__.split("."))
    return F.lit(a << 16 | b << 8 | c)


def ucd_version() -> Column:
    return F.lit(U.UCD_VERSION)


def ucd_version_number() -> Column:
    return F.lit(17 << 16)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- plain expressions -----------------------------------------------------------------------


def is_surrogate(cp) -> Column:
    return _col(cp).between(0xD800, 0xDFFF)


def is_codepoint(cp) -> Column:
    return _col(cp).between(0, 0x10FFFF) & ~is_surrogate(cp)


def is_noncharacter(cp) -> Column:
    c = _col(cp).cast("long")
    return c.between(0, 0x10FFFF) & (c.between(0xFDD0, 0xFDEF) | (c.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE))


def utf8_length(cp) -> Column:
    c = _col(cp)
    return F.when(~is_codepoint(cp), 0).when(c < 0x80, 1).when(c < 0x800, 2).when(c < 0x10000, 3).otherwise(4)


def utf8_encode(cp) -> Column:
    """The character as a string; null where there is none."""
    return F.when(is_codepoint(cp), F.decode(F.unhex(F.lpad(F.hex(_col(cp).cast("long")), 8, "0")), "UTF-32"))


def utf8_validate(data) -> Column:
    return F.is_valid_utf8(_col(data).cast("string"))


def utf8_count(data, policy: str = "REFUSE") -> Column:
    text = _col(data).cast("string")
    if policy == "REPLACE":
        return F.char_length(F.make_valid_utf8(text))
    if policy == "REFUSE":
        return F.when(F.is_valid_utf8(text), F.char_length(text))
    return _call("u_count", data, policy=policy)


def codepoints(text) -> Column:
    """The codepoints of a text as an array."""
    return F.transform(F.filter(F.split(_col(text), ""), lambda c: c != ""), lambda c: F.ascii(c))


def gc_mask_contains(gc_code, mask: int) -> Column:
    return F.shiftright(F.lit(mask), 0).bitwiseAND(F.call_function("shiftleft", F.lit(1), _col(gc_code))) != 0


def hangul_compose(lead, vowel) -> Column:
    """The syllable of a leading consonant and a vowel, by arithmetic."""
    l, v = _col(lead) - norm.L_BASE, _col(vowel) - norm.V_BASE
    return F.when(l.between(0, 18) & v.between(0, 20), norm.S_BASE + (l * 21 + v) * 28)


# -- batched functions -----------------------------------------------------------------------


def _each(f: Callable, fields: tuple[str, ...] = (), /, text: bool = False, limit: int | None = None, fault: str = "null", **options) -> Callable:
    """f over a batch; nulls stay null. With fields, f gives a dict and the batch a frame. `text`: bytes that are ill-formed or a text over the limit give null, or an error."""

    def one(x):
        if isinstance(x, float) and x != x:  # a null among whole numbers
            return None
        if text and x is not None:
            x = _checked(x, limit, fault)
        return None if x is None else f(x, **options)

    def run(s: pd.Series) -> pd.Series:
        return pd.Series([one(x) for x in s], dtype=object)

    def frame(s: pd.Series) -> pd.DataFrame:
        found = [one(x) or {} for x in s]
        return pd.DataFrame({n: pd.Series([d.get(n) for d in found], dtype=object) for n in fields})

    return frame if fields else run


FAULTS = ("null", "error")


def _checked(x, limit: int | None, fault: str = "null") -> str | None:
    """A text within the limit in bytes (None: no limit), out of a string or well-formed bytes; else null, or an error that says which."""
    if isinstance(x, str):
        result = 3 if limit is not None and len(x) * 4 > limit and len(x.encode()) > limit else 0
    else:
        result = 3 if limit is not None and len(x) > limit else 0
        x = x if result else utf.decode(bytes(x), "REFUSE")
        result = 2 if x is None else result
    if result and fault == "error":
        raise ValueError(RESULTS[result])
    return None if result else x


def text_result(text, limit: int | None = -1) -> Column:
    """The result code that a function of whole texts has for a text or bytes: 0, 2 for ill-formed bytes, 3 over the limit (in bytes; None: none); null for null. A plain expression."""
    limit = LIMITS["max_text_bytes"] if limit == -1 else limit
    c = _col(text).cast("string")
    code = F.when(~F.is_valid_utf8(c), 2).otherwise(0)
    if limit is not None:
        code = F.when(F.octet_length(c) > limit, 3).otherwise(code)
    return F.when(c.isNotNull(), code)


def _udf(f: Callable, returns: str, /, text: bool = False, limit: int | None = -1, fault: str = "null", **options):
    if fault not in FAULTS:
        raise ValueError(f"fault must be one of {FAULTS}")
    limit = LIMITS["max_text_bytes"] if limit == -1 else limit
    fields = tuple(part.split(":")[0] for part in returns[7:-1].split(",")) if returns.startswith("struct<") else ()
    return F.pandas_udf(_each(f, fields, text=text, limit=limit, fault=fault, **options), returns)


def _bytes(x) -> bytes:
    return x if isinstance(x, (bytes, bytearray)) else x.encode()


def _levels(t: str, direction: str = "AUTO") -> dict:
    base, found = bidi.levels(t, direction)
    return {"paragraph_level": base, "levels": found}


def _paired(cp: int) -> dict:
    other, opens = bidi.paired_bracket(cp)
    return {"bracket": other, "opens": opens}


def utf8_prev(data, at) -> Column:
    """Where the codepoint, or the ill-formed byte, before byte `at` begins; null at the start and for nulls."""
    d, a = _col(data).cast("string").cast("binary"), _col(at).cast("int")
    before = lambda n: F.substring(d, a - n + 1, F.lit(n))  # noqa: E731  the n bytes that end there
    out = F.when(a > 0, a - 1)
    for n in (2, 3, 4):
        one = F.is_valid_utf8(before(n).cast("string")) & (F.char_length(before(n).cast("string")) == 1)
        out = F.when((a >= n) & one, a - n).otherwise(out)
    return F.when(a <= F.octet_length(d), out)


def _numeric(cp: int) -> dict | None:
    v = U.value("Numeric_Value", cp)
    return None if v is None else {"num": v[0], "den": v[1]}


#: SQL name: (function of one value, result type)
FUNCTIONS: dict[str, tuple[Callable, str]] = {
    "u_count": (lambda x, policy="REFUSE": utf.count(_bytes(x), policy), "int"),
    "u_decode": (lambda x, policy="REPLACE": utf.decode(_bytes(x), policy), "string"),
    "u_error_offset": (lambda x: utf.error_offset(_bytes(x)), "int"),
    "u_to_codepoints": (lambda x, policy="REFUSE": utf.to_codepoints(_bytes(x), policy), "array<int>"),
    "u_from_codepoints": (lambda x, policy="REFUSE": utf.from_codepoints([int(c) for c in x], policy), "string"),
    "u_upper": (case.to_upper, "string"), "u_lower": (case.to_lower, "string"), "u_title": (case.to_title, "string"), "u_case_fold": (case.case_fold, "string"),
    "u_upper_simple": (lambda c: case.to_upper_simple(int(c)), "long"), "u_lower_simple": (lambda c: case.to_lower_simple(int(c)), "long"),
    "u_title_simple": (lambda c: case.to_title_simple(int(c)), "long"), "u_fold_simple": (lambda c, turkic=False: case.case_fold_simple(int(c), turkic), "long"),
    "u_case_orbit": (lambda c: case.case_orbit(int(c)), "array<int>"),
    "u_normalize": (lambda t, form="NFC": norm.normalize(form, t), "string"), "u_is_normalized": (lambda t, form="NFC": norm.is_normalized(form, t), "boolean"),
    "u_quick_check": (lambda t, form="NFC": norm.quick_check_text(form, t), "string"), "u_stream_safe": (norm.stream_safe, "string"), "u_is_stream_safe": (norm.is_stream_safe, "boolean"),
    "u_decompose": (lambda c, compat=False: list(norm.decomposition(int(c), compat)), "array<int>"),
    "u_canonical_order": (lambda c: norm.canonical_order([int(x) for x in c]), "array<int>"),
    "u_boundaries": (lambda t, kind="grapheme", **o: segment.boundaries(t, kind, **o), "array<int>"),
    "u_byte_boundaries": (lambda t, kind="grapheme", **o: segment.byte_offsets(t, segment.boundaries(t, kind, **o)), "array<int>"),
    "u_segments": (lambda t, kind="word", **o: segment.segments(t, kind, **o), "array<string>"),
    "u_grapheme_count": (segment.grapheme_count, "int"),
    "u_is_script_run": (script.is_script_run, "boolean"),
    "u_script_items": (lambda t: [{"start": a, "length": n, "script": s} for a, n, s in script.items(t)], "array<struct<start:int,length:int,script:string>>"),
    "u_bidi_levels": (_levels, "struct<paragraph_level:int,levels:array<int>>"), "u_bidi_reorder": (lambda x: bidi.reorder([int(v) for v in x]), "array<int>"),
    "u_bidi_mirror": (lambda c: bidi.mirror(int(c)), "int"), "u_bidi_bracket": (lambda c: _paired(int(c)), "struct<bracket:int,opens:boolean>"),
    "u_name": (lambda c: names.name(int(c)), "string"), "u_has_name": (lambda c: names.has_name(int(c)), "boolean"), "u_codepoint_by_name": (names.codepoint_by_name, "int"),
    "u_named_sequence": (names.named_sequence, "array<int>"), "u_property_name": (U.property_by_name, "string"), "u_property_kind": (U.property_kind, "string"),
    "u_numeric_value": (lambda c: _numeric(int(c)), "struct<num:bigint,den:bigint>"), "u_script_extensions": (lambda c: U.value("Script_Extensions", int(c)), "array<string>"),
    "u_line_break_class": (lambda c, tailoring="STRICT": segment.resolve_line_break(segment._L.get(U.value("Line_Break", int(c)), "XX"), U.value("General_Category", int(c)), tailoring), "string"),
    "u_combining_class": (lambda c: U.value("Canonical_Combining_Class", int(c)), "int"),
}


#: Functions of whole texts: they take strings or UTF-8 bytes.
TEXTS = set(
    "u_upper u_lower u_title u_case_fold u_normalize u_is_normalized u_quick_check u_stream_safe u_is_stream_safe u_boundaries u_byte_boundaries u_segments u_grapheme_count u_is_script_run u_script_items u_bidi_levels".split()
)
#: SQL name: (function of a text and its options, result type); the options are columns too.
WITH_OPTIONS: dict[str, tuple[Callable, str]] = {
    "u_normalize_to": (lambda t, form: norm.normalize(form, t), "string"), "u_is_normalized_to": (lambda t, form: norm.is_normalized(form, t), "boolean"), "u_quick_check_of": (lambda t, form: norm.quick_check_text(form, t), "string"),
    "u_upper_in": (case.to_upper, "string"), "u_lower_in": (case.to_lower, "string"), "u_title_in": (case.to_title, "string"), "u_case_fold_in": (case.case_fold, "string"),
    "u_boundaries_of": (lambda t, kind: segment.boundaries(t, kind), "array<int>"), "u_segments_of": (lambda t, kind: segment.segments(t, kind), "array<string>"),
    "u_line_boundaries_in": (lambda t, tailoring, writing: segment.boundaries(t, "line", tailoring=tailoring, writing=writing), "array<int>"),
    "u_break_at": (lambda t, kind, at: int(at) in segment.boundaries(t, kind), "boolean"), "u_bidi_levels_in": (lambda t, direction: bidi.levels(t, direction)[1], "array<int>"),
    "u_upper_at": (lambda t, at, tailoring: case.upper_at(t, int(at), tailoring) if 0 <= at < len(t) else None, "string"),
    "u_lower_at": (lambda t, at, tailoring: case.lower_at(t, int(at), tailoring) if 0 <= at < len(t) else None, "string"),
    "u_title_at": (lambda t, at, tailoring: case.title_at(t, int(at), tailoring) if 0 <= at < len(t) else None, "string"),
}


def _with_options(name: str, limit: int | None = -1, fault: str = "null"):
    f, kind = WITH_OPTIONS[name]
    limit = LIMITS["max_text_bytes"] if limit == -1 else limit

    def run(s: pd.Series, *options: pd.Series) -> pd.Series:
        out = []
        for x, *o in zip(s, *options):
            x = None if x is None or any(v is None for v in o) else _checked(x, limit, fault)
            out.append(None if x is None else f(x, *o))
        return pd.Series(out, dtype=object)

    # the number of columns is told by the signature
    typed = {1: lambda s, a: run(s, a), 2: lambda s, a, b: run(s, a, b)}[f.__code__.co_argcount - 1]
    typed.__annotations__ = {k: pd.Series for k in typed.__code__.co_varnames[: typed.__code__.co_argcount]} | {"return": pd.Series}
    return F.pandas_udf(typed, kind)


class Segments:
    """Table function: a row (i, start, segment) for each segment of a text of any length; none for null."""

    def eval(self, text: str, kind: str):
        if text:
            cut = segment.boundaries(text, kind)
            cut = cut if cut[0] == 0 else [0, *cut]
            for i, (a, b) in enumerate(zip(cut, cut[1:])):
                yield i, a, text[a:b]


class Codepoints:
    """Table function: a row (i, byte, cp, ok) for each codepoint or ill-formed subpart of bytes under a policy; REFUSE ends at the first fault with ok false."""

    def eval(self, data: bytes, policy: str):
        if data is not None:
            data, n = bytes(data), 0
            for i, at, cp, ok in utf.codepoints(data, policy):
                yield i, at, cp, ok
                n = i + 1
            if policy == "REFUSE" and (at := utf.error_offset(data)) is not None:
                yield n, at, None, False


def _call(name: str, *columns, **options) -> Column:
    f, kind = FUNCTIONS[name]
    return _udf(f, kind, text=name in TEXTS, **options)(*[_col(c) for c in columns])


def call(name: str, column, **options) -> Column:
    """Any function of FUNCTIONS with options, as a column."""
    ship(SparkSession.getActiveSession())
    return _call(name, column, **options)


def property_value(cp, prop: str) -> Column:
    """The value of any property as text; binary ones are Yes or No. An index into constant arrays; numeric values, which have no table, ask a function."""
    if prop != "Numeric_Value":
        return lookup.property_value(_col(cp), prop)
    v = call("u_numeric_value", cp)
    return F.when(_col(cp).isNotNull(), F.coalesce(F.concat(v["num"].cast("string"), F.lit("/"), v["den"].cast("string")), F.lit("")))


def has_property(cp, prop: str) -> Column:
    return property_value(cp, prop) == "Yes"


def compose(a, b) -> Column:
    ship(SparkSession.getActiveSession())
    return F.pandas_udf(lambda x, y: pd.Series([None if pd.isna(p) or pd.isna(q) else norm.compose(int(p), int(q)) for p, q in zip(x, y)], dtype=object), "int")(_col(a), _col(b))


def folded_equal(a, b, tailoring: str = "NONE") -> Column:
    """Caseless equality; as a join key use the fold of each side."""
    return call("u_case_fold", a, tailoring=tailoring) == call("u_case_fold", b, tailoring=tailoring)


def value_by_name(name, prop: str) -> Column:
    ship(SparkSession.getActiveSession())
    return F.pandas_udf(_each(lambda n: None if (v := U.value_by_name(prop, n)) is None else str(v)), "string")(_col(name))


def break_at(text, position: int, kind: str, **options) -> Column:
    return F.array_contains(call("u_boundaries", text, kind=kind, **options), position)


def normalize(text, form: str = "NFC") -> Column:
    return call("u_normalize", text, form=form)


def register(spark: SparkSession, limit: int | None = -1, fault: str = "null") -> list[str]:
    """Give every batched function its SQL name (default options), those with options as arguments theirs, and the table functions; returns the names.

    limit: the most bytes that a function of whole texts takes, None for no limit; fault: null or error for texts over it and
    ill-formed bytes. u_result says of a text which of them it would be.
    """
    ship(spark)
    for name, (f, kind) in FUNCTIONS.items():
        spark.udf.register(name, _udf(f, kind, text=name in TEXTS, limit=limit, fault=fault))
    for name in WITH_OPTIONS:
        spark.udf.register(name, _with_options(name, limit, fault))
    spark.udf.register("u_result", _udf(lambda x: _result(x, LIMITS["max_text_bytes"] if limit == -1 else limit), "int"))
    spark.udtf.register("u_segment_rows", F.udtf(Segments, returnType="i int, start int, segment string"))
    spark.udtf.register("u_codepoint_rows", F.udtf(Codepoints, returnType="i int, byte int, cp int, ok boolean"))
    return [*FUNCTIONS, *WITH_OPTIONS, "u_result", "u_segment_rows", "u_codepoint_rows"]


def _result(x, limit: int | None) -> int:
    try:
        _checked(x, limit, "error")
    except ValueError as e:
        return next(k for k, v in RESULTS.items() if v == str(e))
    return 0
