"""Blocks, orientation, mirrors and brackets of the JVM's library against known values."""

from pyspark.sql import functions as F

from glyphmill.sources import library
from glyphmill.text import bidi
from glyphmill.ucd import properties as U


def test_blocks(spark):
    rows = sorted(tuple(r) for r in library.blocks(spark).collect())
    assert len(rows) == 397 and len({v for _, _, v in rows}) == 347  # as published, with what is in no block
    assert rows[0][0] == 0 and rows[-1][1] == U.SIZE - 1 and all(a[1] + 1 == b[0] for a, b in zip(rows, rows[1:]))
    of = lambda c: next(v for a, b, v in rows if a <= c <= b)
    assert [of(c) for c in (0x41, 0x3B1, 0x16EA0, 0x33479, 0x10FFFF, 0x1CEC0, 0x2FE0)] == ["Basic_Latin", "Greek_And_Coptic", "Beria_Erfe", "CJK_Unified_Ideographs_Extension_J", "Supplementary_Private_Use_Area_B", "Miscellaneous_Symbols_Supplement", "No_Block"]


def test_orientation(spark):
    rows = sorted(tuple(r) for r in library.vertical_orientations(spark).collect())
    assert all(a[1] + 1 == b[0] and a[2] != b[2] for a, b in zip(rows, rows[1:]))
    of = lambda c: next(v for a, b, v in rows if a <= c <= b)
    assert [of(c) for c in (0x41, 0x4E00, 0x3001, 0x2329, 0x18D80)] == ["Rotated", "Upright", "Transformed_Upright", "Transformed_Rotated", "Upright"]


def test_mirrors_and_brackets(spark):
    mirror = {r.cp: r.mirror for r in library.mirrors(spark).collect()}
    assert mirror[0x28] == 0x29 and mirror[0x2208] == 0x220B and all(mirror[b] == a for a, b in mirror.items())
    pairs = {r.cp: (r.bracket, r.opens) for r in library.brackets(spark).collect()}
    assert len(pairs) == 128 and pairs[0x28] == (0x29, True) and pairs[0x300B] == (0x300A, False) and all(pairs[b][0] == a for a, (b, _) in pairs.items())
    # the algorithm's own pairs are the same
    assert {c: bidi.mirror(c) for c in range(U.SIZE) if bidi.mirror(c) != c} == mirror
    assert {c: bidi.paired_bracket(c) for c in range(0x30000) if bidi.paired_bracket(c)[0]} == pairs
    assert library.mirrors(spark).filter(F.col("cp") < 128).count() == 8
