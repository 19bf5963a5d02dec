"""The data source on small files in the published formats, and what the loaders make of them."""

import pytest
from pyspark.sql import functions as F

from glyphmill.sources import datasource as D
from glyphmill.sources import ucd
from glyphmill.text import case, norm

CHARACTERS = """0041;LATIN CAPITAL LETTER A;Lu;0;L;;;;;N;;;;0061;
0061;LATIN SMALL LETTER A;Ll;0;L;;;;;N;;;0041;;0041
00BD;VULGAR FRACTION ONE HALF;No;0;ON;<fraction> 0031 2044 0032;;;1/2;N;FRACTION ONE HALF;;;;
01D5;LATIN CAPITAL LETTER U WITH DIAERESIS AND MACRON;Lu;0;L;00DC 0304;;;;N;;;;01D6;
00DC;LATIN CAPITAL LETTER U WITH DIAERESIS;Lu;0;L;0055 0308;;;;N;;;;00FC;
0308;COMBINING DIAERESIS;Mn;230;NSM;;;;;N;;;;;
0028;LEFT PARENTHESIS;Ps;0;ON;;;;;Y;OPENING PARENTHESIS;;;;
3400;<CJK Ideograph Extension A, First>;Lo;0;L;;;;;N;;;;;
4DBF;<CJK Ideograph Extension A, Last>;Lo;0;L;;;;;N;;;;;
FB01;LATIN SMALL LIGATURE FI;Ll;0;L;<compat> 0066 0069;;;;N;;;;;
"""


def write(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("split", [1, 17, 100, 1 << 20])
def test_rows_whatever_the_partitions(spark, tmp_path, split):
    path = write(tmp_path, "a.txt", "# a comment; with 0041\n# @missing: 0000..10FFFF; N\n\n" + CHARACTERS + "E000..F8FF ; Co # private\n   \n10FFFF;last")
    D.load(spark, path)
    df = spark.read.format("character_file").option("path", path).option("splitBytes", split).load()
    got = rows(df.select("first", "last", F.get("fields", F.lit(0)).alias("f")))
    assert got == sorted([(0x28, 0x28, "LEFT PARENTHESIS"), (0x41, 0x41, "LATIN CAPITAL LETTER A"), (0x61, 0x61, "LATIN SMALL LETTER A"), (0xBD, 0xBD, "VULGAR FRACTION ONE HALF"), (0xDC, 0xDC, "LATIN CAPITAL LETTER U WITH DIAERESIS"),
        (0x1D5, 0x1D5, "LATIN CAPITAL LETTER U WITH DIAERESIS AND MACRON"), (0x308, 0x308, "COMBINING DIAERESIS"), (0x3400, 0x4DBF, "<CJK Ideograph Extension A>"), (0xFB01, 0xFB01, "LATIN SMALL LIGATURE FI"), (0xE000, 0xF8FF, "Co"), (0x10FFFF, 0x10FFFF, "last")])
    assert df.rdd.getNumPartitions() == max(1, -(-(tmp_path / "a.txt").stat().st_size // split))


def test_conditions_reach_the_reader(spark, tmp_path):
    path = write(tmp_path, "a.txt", CHARACTERS)
    some = D.load(spark, path).filter("first > 65 AND last <= 1000 AND fields[1] = 'Lu'")
    assert [r[0] for r in rows(some.select("first"))] == [0xDC, 0x1D5]
    reader = D._Reader({"path": path})
    left = list(reader.pushFilters([D.GreaterThan(("first",), 65), D.EqualTo(("last",), 0xDC), D.EqualTo(("file",), "x")]))
    assert left == [D.EqualTo(("file",), "x")] and [r[0] for p in reader.partitions() for r in reader.read(p)] == [0xDC]
    assert D.load(spark, path).filter("first = 40").count() == 1


def test_missing_lines_and_folders(spark, tmp_path):
    write(tmp_path, "a.txt", "# @missing: 0000..10FFFF; N\n# @missing: 3400..4DBF; W\n0041..0042 ; Na # x\n3401 ; F\n")
    write(tmp_path, "b.txt", "")
    missing, lines = D.load(spark, str(tmp_path), "missing"), D.load(spark, f"{tmp_path}/*.txt")
    assert rows(missing.select("first", "last", F.get("fields", F.lit(0)))) == [(0, 0x10FFFF, "N"), (0x3400, 0x4DBF, "W")]
    found = ucd.with_defaults(lines.select("first", "last", "fields"), missing.select("first", "last", "fields"), "X")
    assert rows(found) == [(0, 0x40, "N"), (0x41, 0x42, "Na"), (0x43, 0x33FF, "N"), (0x3400, 0x3400, "W"), (0x3401, 0x3401, "F"), (0x3402, 0x4DBF, "W"), (0x4DC0, 0x10FFFF, "N")]
    with pytest.raises(Exception, match="path"):
        spark.read.format("character_file").load().collect()


def test_characters(spark, tmp_path):
    found = D.read_characters(spark, write(tmp_path, "a.txt", CHARACTERS)).cache()
    by = {r["first"]: r for r in found.collect()}
    assert (by[0x41].lower, by[0x41].upper, by[0x61].upper, by[0x61].title, by[0x28].mirrored, by[0x41].mirrored, by[0x308].combining_class) == (0x61, None, 0x41, 0x41, True, False, 230)
    assert by[0xBD].decomposition_type == "fraction" and by[0xBD].decomposition == [0x31, 0x2044, 0x32] and by[0x41].decomposition is None
    full = {r.cp: r.decomposition for r in D.decompositions(found).collect()}
    assert full == {c: list(norm.decomposition(c, False)) for c in (0xDC, 0x1D5)}
    assert {r.cp: r.decomposition for r in D.decompositions(found, True).collect()} == {c: list(norm.decomposition(c, True)) for c in (0xBD, 0xDC, 0x1D5, 0xFB01)}


def test_loaders(spark, tmp_path):
    special = D.read_special_cases(spark, write(tmp_path, "s.txt", "00DF; 00DF; 0053 0073; 0053 0053; # SHARP S\n03A3; 03C2; 03A3; 03A3; Final_Sigma; # SIGMA\n0049; 0131; 0049; 0049; tr Not_Before_Dot; # I\n"))
    got = {(r.cp, tuple(r.upper), None if r.conditions is None else tuple(r.conditions)) for r in special.collect()}
    assert got == {(0xDF, (0x53, 0x53), None), (0x3A3, (0x3A3,), ("Final_Sigma",)), (0x49, (0x49,), ("tr", "Not_Before_Dot"))}
    folds = D.read_foldings(spark, write(tmp_path, "f.txt", "0041; C; 0061; # A\n00DF; F; 0073 0073; # S\n"))
    assert rows(folds) == [(0x41, "C", [0x61]), (0xDF, "F", [0x73, 0x73])] and case.case_fold("ß") == "ss"
    assert rows(D.read_mirrors(spark, write(tmp_path, "m.txt", "0028; 0029 # LEFT PARENTHESIS\n2208; 220B # ELEMENT OF\n"))) == [(0x28, 0x29), (0x2208, 0x220B)]
    assert rows(D.read_brackets(spark, write(tmp_path, "k.txt", "0028; 0029; o # (\n0029; 0028; c # )\n0041; 0041; n\n"))) == [(0x28, 0x29, True), (0x29, 0x28, False)]
    assert rows(D.read_blocks(spark, write(tmp_path, "b.txt", "0000..007F; Basic Latin\n0080..00FF; Latin-1 Supplement\n"))) == [(0, 0x7F, "Basic_Latin"), (0x80, 0xFF, "Latin_1_Supplement")]
    assert rows(D.read_numerics(spark, write(tmp_path, "n.txt", "00BD ; 0.5 ; ; 1/2 # No\n0F33 ; -0.5 ; ; -1/2 # No\n0030 ; 0.0 ; ; 0 # Nd\n"))) == [(0x30, 0x30, 0, 1), (0xBD, 0xBD, 1, 2), (0xF33, 0xF33, -1, 2)]
    assert rows(D.read_script_extensions(spark, write(tmp_path, "x.txt", "102E0 ; Arab Copt # x\n"))) == [(0x102E0, 0x102E0, ["Arab", "Copt"])]
    aliases = D.read_name_aliases(spark, write(tmp_path, "v.txt", "0000;NULL;control\n0000;NUL;abbreviation\n01A2;LATIN CAPITAL LETTER GHA;correction\n"))
    assert rows(aliases) == [(0, 0, "NULL", "control"), (0, 1, "NUL", "abbreviation"), (0x1A2, 0, "LATIN CAPITAL LETTER GHA", "correction")]
