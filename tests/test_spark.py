"""Queries against DuckDB on the smallest tables, and the functions in SQL and streams."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from glyphmill.functions import text as T
from glyphmill.operators import corpus
from glyphmill.plans import queries as core
from glyphmill.sources import ucd
from glyphmill.streaming.text import codepoint_totals

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(map(str, df.astype(object).where(df.notnull(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert rows(core.queries()[name](spark, SF).toPandas()) == rows(con.sql(core.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql())))
def test_rows(spark, name):
    assert core.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sentences_cover_texts(spark):
    s = core.sentence_lengths(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id")
    assert s.filter(F.col("n_codepoints") != F.char_length("text")).count() == 0


def test_sql_functions(spark):
    names = T.register(spark)
    assert len(names) > 30
    got = spark.sql("SELECT u_upper('straße') AS a, u_title('hello WORLD') AS b, u_name(65L) AS c, u_bidi_levels('aב').levels AS d, u_segments('one two') AS e").first()
    assert tuple(got) == ("STRASSE", "Hello World", "LATIN CAPITAL LETTER A", [0, 1], ["one", " ", "two"])


def test_sql_functions_with_options(spark):
    T.register(spark)
    got = spark.sql("""SELECT u_normalize_to('é', 'NFD') AS a, u_upper_in('iı', 'TURKIC') AS b, u_segments_of('a b', 'word') AS c, u_break_at('ab', 'grapheme', 1) AS d, u_lower_at('ΟΣ', 1, 'NONE') AS e,
        u_upper(x'C3A9') AS f, u_upper(x'C3') AS g, u_normalize_to(NULL, 'NFC') AS h, u_upper_at('a', 5, 'NONE') AS i""").first()
    assert tuple(got) == ("e\u0301", "İI", ["a", " ", "b"], True, "ς", "É", None, None, None)
    rows_ = spark.sql("SELECT doc, s.* FROM VALUES ('x', 'One. Two'), ('y', ''), ('z', NULL) AS v(doc, t), LATERAL u_segment_rows(t, 'sentence') AS s").collect()
    assert sorted(tuple(r) for r in rows_) == [("x", 0, 0, "One. "), ("x", 1, 5, "Two")]


def test_limits(spark):
    """A fault is null, an error, or a result code; without a limit only ill-formed bytes are one."""
    some = ["abcd", "abcde", "éé", "ééa", b"ab", b"abcde", b"\xff"]
    assert [T._checked(x, 4) for x in some] == ["abcd", None, "éé", None, "ab", None, None]
    assert [T._result(x, 4) for x in some] == [0, 3, 0, 3, 0, 3, 2]
    assert [T._checked(x, None) for x in some] == ["abcd", "abcde", "éé", "ééa", "ab", "abcde", None]
    df = spark.createDataFrame([(1, b"abc"), (2, b"abcdef"), (3, b"\xff"), (4, None)], "id int, t binary")
    got = df.select("id", T.text_result("t", 4).alias("r"), T.text_result("t", None).alias("free"), T.call("u_upper", "t", limit=4).alias("up"), T.call("u_upper", "t", limit=None).alias("whole")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 0, "ABC", "ABC"), (2, 3, 0, None, "ABCDEF"), (3, 2, 2, None, None), (4, None, None, None, None)]
    for bad in (2, 3):
        with pytest.raises(Exception, match="limit reached|ill-formed"):
            df.filter(F.col("id") == bad).select(T.call("u_upper", "t", limit=4, fault="error")).collect()
    T.register(spark, limit=4)
    assert [tuple(r) for r in spark.sql("SELECT u_result('abcde'), u_upper('abcde'), u_result(x'FF'), u_upper('abcd'), u_result(NULL)").collect()] == [(3, None, 2, "ABCD", None)]
    T.register(spark)


def test_iteration_over_bytes(spark):
    T.register(spark)
    got = spark.sql("SELECT s.* FROM VALUES (x'41C3A9FF42') AS v(d), LATERAL u_codepoint_rows(d, 'REPLACE') AS s").collect()
    assert sorted(tuple(r) for r in got) == [(0, 0, 0x41, True), (1, 1, 0xE9, True), (2, 3, 0xFFFD, False), (3, 4, 0x42, True)]
    got = spark.sql("SELECT s.* FROM VALUES (x'41C3A9FF42') AS v(d), LATERAL u_codepoint_rows(d, 'REFUSE') AS s").collect()
    assert sorted(tuple(r) for r in got)[2:] == [(2, 3, None, False)]
    data = "aé日👍".encode() + b"\xff\xe6\x97" + b"\x80\x80\x80\x80\x80"
    df = spark.createDataFrame([(data, i) for i in range(len(data) + 2)], "d binary, at int")
    from glyphmill.text import utf

    assert [r.p for r in df.select(T.utf8_prev("d", "at").alias("p")).collect()] == [None, *[utf.prev(data, i) for i in range(1, len(data) + 1)], None]


def test_functions_at_positions(spark):
    df = spark.createDataFrame([("straße ΟΣ. i\u0307", i) for i in range(11)], "t string, at int")
    T.register(spark)
    from glyphmill.text import case, segment

    for f, g in (("upper", case.upper_at), ("lower", case.lower_at), ("title", case.title_at)):
        got = [r[0] for r in df.selectExpr(f"u_{f}_at(t, at, 'NONE') AS x").collect()]
        assert got == [g("straße ΟΣ. i\u0307", i, "NONE") for i in range(11)]
    for kind in segment.KINDS:
        got = [r[0] for r in df.select(F.expr(f"u_break_at(t, '{kind}', at)")).collect()]
        assert got == [i in segment.boundaries("straße ΟΣ. i\u0307", kind) for i in range(11)]


def test_versions_and_results(spark):
    got = spark.range(1).select(T.result_string(F.lit(2)).alias("a"), T.version().alias("b"), T.version_number().alias("c"), T.ucd_version().alias("d"), T.ucd_version_number().alias("e"), T.gc_mask_contains(F.lit(1), 2).alias("f"), T.gc_mask_contains(F.lit(0), 2).alias("g")).first()
    assert got.a == "ill-formed text" and got.d == "17.0.0" and got.e == 17 << 16 and (got.f, got.g) == (True, False)
    a, b, c = map(int, got.b.split("."))
    assert got.c == a << 16 | b << 8 | c


def test_expressions(spark):
    df = spark.createDataFrame([(0x41,), (0xD800,), (0xFFFE,), (0x1F600,), (0x110000,)], "cp long")
    got = df.select(T.is_codepoint("cp"), T.is_noncharacter("cp"), T.utf8_length("cp"), T.utf8_encode("cp")).collect()
    assert [tuple(r) for r in got] == [(True, False, 1, "A"), (False, False, 0, None), (True, True, 3, "￾"), (True, False, 4, "😀"), (False, False, 0, None)]


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "é")], "doc_id long, text string")
    got = {r.doc_id: r for r in df.select("doc_id", T.call("u_grapheme_count", "text").alias("n"), T.normalize("text", "NFD").alias("d")).collect()}
    assert got[1].n is None and got[2].n == 0 and got[3].d == "e\u0301"
    assert corpus.segments(df, "text", "word").count() == 1


def test_with_property_and_ranges(spark):
    cps = spark.createDataFrame([(0x3B1,), (0x41,)], "cp int")
    assert [r.cp for r in corpus.with_property(cps, "cp", "Script", "Greek").collect()] == [0x3B1]
    assert [r.cp for r in corpus.with_property(cps, "cp", "Script", "Greek", anti=True).collect()] == [0x41]
    assert ucd.ucd_values(spark).filter("property = 'Script'").count() > 170


def test_ucd_reader(spark, tmp_path):
    f = tmp_path / "x.txt"
    f.write_text("# @missing: 0000..10FFFF; No\n0041..005A ; Lu # letters\n00B5 ; Ll ; x\n\n")
    assert [tuple(r) for r in ucd.read_ucd_file(spark, str(f)).collect()] == [(0x41, 0x5A, ["Lu"]), (0xB5, 0xB5, ["Ll", "x"])]
    assert [tuple(r) for r in ucd.missing_defaults(spark, str(f)).collect()] == [(0, 0x10FFFF, ["No"])]


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")).withColumn("n", T.call("u_grapheme_count", "text"))
    q = stream.select("doc_id", "n").writeStream.format("memory").queryName("g").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("g").collect())) == sorted(map(tuple, docs.select("doc_id", T.call("u_grapheme_count", "text")).collect()))
    q = codepoint_totals(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), "text").writeStream.format("memory").queryName("t").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination(120)
    assert spark.table("t").first().n_texts == docs.count()


def test_data_files(spark, tmp_path):
    """Readers of the published formats, defaults, distinct records, the tables and the check of codes."""
    (tmp_path / "aliases").write_text("# c\ngc ; Lu ; Uppercase_Letter\nccc; 230; A ; Above\nsc ; Qaai ; Inherited ; Zinh\n")
    got = {tuple(r) for r in ucd.read_aliases(spark, str(tmp_path / "aliases")).collect()}
    assert got == {("gc", "Uppercase_Letter", "Lu"), ("gc", "Uppercase_Letter", "Uppercase_Letter"), ("ccc", "Above", "230"), ("ccc", "Above", "A"), ("ccc", "Above", "Above"), ("sc", "Inherited", "Qaai"), ("sc", "Inherited", "Inherited"), ("sc", "Inherited", "Zinh")}
    (tmp_path / "file").write_text("# @missing: 0000..10FFFF; N\n# @missing: 3400..4DBF; W\n0041..0042 ; Na # x\n3401 ; F\n")
    rows_ = ucd.with_defaults(ucd.read_ucd_file(spark, str(tmp_path / "file")), ucd.missing_defaults(spark, str(tmp_path / "file")), "X").orderBy("first").collect()
    assert [tuple(r) for r in rows_] == [(0, 0x40, "N"), (0x41, 0x42, "Na"), (0x43, 0x33FF, "N"), (0x3400, 0x3400, "W"), (0x3401, 0x3401, "F"), (0x3402, 0x4DBF, "W"), (0x4DC0, 0x10FFFF, "N")]
    ucd.write_tables(spark, str(tmp_path / "out"), ["Hangul_Syllable_Type", "East_Asian_Width"])
    records, ranges = (spark.read.parquet(str(tmp_path / "out" / n)) for n in ("records", "ranges"))
    assert records.count() == records.select("Hangul_Syllable_Type", "East_Asian_Width").distinct().count()
    assert ranges.join(records, "record_id").filter("first <= 44032 and last >= 44032").first().Hangul_Syllable_Type == "LV_Syllable"
    values = spark.read.parquet(str(tmp_path / "out" / "values"))
    assert ucd.renumbered(values, values).count() == 0 and ucd.renumbered(values, values.filter("code <> 1")).count() == 2
