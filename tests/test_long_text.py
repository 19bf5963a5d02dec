"""Pieces of long texts, streams, sets, names and lookups against what whole texts and single codepoints give."""

import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphmill.functions import lookup
from glyphmill.functions import text as T
from glyphmill.operators import corpus, long_text, names, sets
from glyphmill.streaming import text as streaming
from glyphmill.text import automaton, norm, script, segment, utf
from glyphmill.text import names as core_names
from glyphmill.ucd import properties as U

PIECES = "a B é . , ' : \" 1 2 _ ! \r \n ́ ̖ ‍ ­ א カ ؀ क ् ा ᄀ ᅡ ᆨ 가 \U0001F1E6 \U0001F1E7 \U0001F468 \U0001F3FD ཱ Å 豈".split(" ") + [" ", "  ", "́" * 9, "‍­" * 4]
TEXTS = st.lists(st.sampled_from(PIECES), max_size=24).map("".join)


def cut_anywhere(rng, text):
    out = []
    while text:
        n = rng.randint(1, 5)
        out.append(text[:n])
        text = text[n:]
    return out


@settings(max_examples=400, deadline=None)
@given(TEXTS, st.randoms(), st.sampled_from(automaton.KINDS))
def test_pieces_compose(text, rng, kind):
    """Whatever the cuts, pieces read with the state of what comes before give the boundaries of the whole text."""
    machine = automaton.automaton(kind)
    state, at, found, waits = 0, 0, [], None
    for part in cut_anywhere(rng, text):
        starts, decided, pending = machine.read(part, state)
        if decided is not None:
            if decided:
                found.append(waits)
            waits = None
        found += [at + p for p in starts]
        waits = at + pending if pending is not None else waits
        after = machine.after(part)
        state = after[state] if isinstance(after, list) else after
        at += len(part)
    if waits is not None:
        found.append(waits)
    assert sorted(found) == segment.boundaries(text, kind)[:-1]


def made(seed, n=60):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))) for _ in range(n)] + ["́" * 50, "a" + "̖́" * 30, "\U0001F1E6" * 41, "a." + "­" * 30 + "b", "a." + "­" * 30, "1,‍2.3"]


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("kind", automaton.KINDS)
@pytest.mark.parametrize("size", [1, 4])
def test_segments_of_pieces(spark, kind, size):
    texts = made(size)
    found = long_text.segment_starts(long_text.pieces(table(spark, texts), "text", size=size), kind)
    rows = found.groupBy("key").agg(F.array_sort(F.flatten(F.collect_list(F.transform("starts", lambda p: p + F.col("seq") * size)))).alias("starts")).collect()
    got = {r.key: r.starts for r in rows}
    assert got == {i: segment.boundaries(t, kind)[:-1] for i, t in enumerate(texts) if t}


@pytest.mark.parametrize("form", norm.FORMS)
def test_normal_forms_of_pieces(spark, form):
    texts = made(7)
    parts = long_text.pieces(table(spark, texts), "text", size=3)
    got = {r.key: r.text for r in long_text.joined(long_text.normalize(parts, form)).collect()}
    assert got == {i: norm.normalize(form, t) for i, t in enumerate(texts) if t}


@pytest.mark.parametrize("policy", utf.POLICIES)
def test_chunks_decode_as_whole_bytes(spark, policy):
    rng = random.Random(4)
    some = [b"", None, "aé日👍".encode() * 3, b"\xe1\x80A", b"\xc0\xaf", b"\xed\xa0\x80", b"ab\xf0\x9f\x98", *[bytes(rng.choice(b"a\xc3\xa9\xe6\x97\xa5\xf0\x9f\x98\x80\xff") for _ in range(30)) for _ in range(30)]]
    df = spark.createDataFrame(list(enumerate(some)), "doc_id long, data binary")
    rows = long_text.decode_chunks(long_text.byte_chunks(df, F.col("data"), size=2), policy).collect()
    for i, data in enumerate(some):
        own = sorted((r for r in rows if r.key == i), key=lambda r: r.seq)
        want = utf.decode(data or b"", policy)
        if want is None:
            assert not own[-1].ok and own[-1].text is None
        else:
            assert all(r.ok for r in own) and "".join(r.text for r in own) == want


def chunk_stream(spark, tmp_path, rows, files):
    """Rows (doc_id, text, at) as a stream, a file a micro-batch, in an order of its own."""
    source = tmp_path / "chunks"
    for k in range(files):
        spark.createDataFrame(rows[k::files], "doc_id long, text string, at long").coalesce(1).write.mode("append").parquet(str(source))
    schema = "doc_id long, text string, at long"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source)).withColumn("at", F.timestamp_seconds("at"))


SCRIPTS = ["paypal", "pаypal", "漢かな", "かな가", "12٣", "1٣", "٣٤", "a", "͸", "a͸", "α.1", "αа", "क०1", "", "  ", "漢ㄅ가"]


def test_script_runs_of_a_stream(spark, tmp_path):
    rows = [(i, c, 0) for i, t in enumerate(SCRIPTS) for c in t]
    random.Random(1).shuffle(rows)
    found = streaming.script_runs(chunk_stream(spark, tmp_path, rows, 3), "text")
    query = found.writeStream.format("memory").queryName("scripts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    query.awaitTermination(300)
    got = {r.doc_id: (r.is_run, r.n) for r in spark.table("scripts").collect()}
    assert got == {i: (script.is_script_run(t), len(t)) for i, t in enumerate(SCRIPTS) if t}
    batch = {r.doc_id: r.is_run for r in corpus.script_runs(table(spark, SCRIPTS), "text").collect()}
    assert batch == {k: v for k, (v, _) in got.items()}


def test_watermark_ends_texts_and_evicts_them(spark, tmp_path):
    """Texts that are over come out once; their state goes."""
    early = [(1, "ab", 100), (2, "aα", 110), (1, "c", 160)]
    late = [(3, "zz", 90_000), (3, "z", 90_001), (4, "q", 90_002)]
    source = tmp_path / "chunks"
    for rows in (early, late, [(9, "e", 200_000), (9, "f", 200_000)]):
        spark.createDataFrame(rows, "doc_id long, text string, at long").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("doc_id long, text string, at long").parquet(str(source)).withColumn("at", F.timestamp_seconds("at"))
    found = streaming.script_runs(stream, "text", event_time="at", gap="5 minutes", late="1 minute")
    query = found.writeStream.format("memory").queryName("ended").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    query.awaitTermination(300)
    assert {(r.doc_id, r.is_run, r.n) for r in spark.table("ended").collect()} == {(1, True, 3), (2, False, 2), (3, True, 3), (4, True, 1)}
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1


def brute_set(prop, value):
    return {c for a, b in U.ranges(prop, value) for c in range(a, b + 1)}


def spread(ranges):
    rows = sorted((r.first, r.last) for r in ranges.select("first", "last").collect())
    assert all(b + 1 < c for (_, b), (c, _) in zip(rows, rows[1:]))  # maximal
    return {c for a, b in rows for c in range(a, b + 1)}


def test_sets(spark):
    wanted = {"lat": ("Script", "Latin"), "upper": ("Uppercase", "Yes"), "space": ("White_Space", "Yes"), "non": ("Noncharacter_Code_Point", "Yes")}
    known = {n: brute_set(*v) for n, v in wanted.items()}
    named = sets.named_sets(spark, wanted)
    every = set(range(U.SIZE))
    assert spread(sets.union(named, ["lat", "space", "non"])) == known["lat"] | known["space"] | known["non"]
    assert spread(sets.intersection(named, ["lat", "upper"])) == known["lat"] & known["upper"]
    assert spread(sets.difference(named, "lat", ["upper", "space"])) == known["lat"] - known["upper"] - known["space"]
    assert spread(sets.complement(named, list(wanted))) == every - set().union(*known.values())
    assert spread(sets.union(named, ["nothing"])) == set()
    twice = spark.createDataFrame([("x", 5, 9), ("x", 7, 12), ("x", 13, 14), ("y", 0, 6)], "name string, first int, last int")
    assert spread(sets.union(twice, ["x"])) == set(range(5, 15)) and spread(sets.difference(twice, "x", ["y"])) == set(range(7, 15))


@pytest.mark.parametrize("prop", ["General_Category", "Script", "Bidi_Class", "White_Space", "Canonical_Combining_Class", "Script_Extensions", "Word_Break"])
def test_lookup_tables(prop):
    blocks, leaves, values = lookup.tables(prop)
    want = [v for a, b, v in U.runs(prop) for _ in range(a, b + 1)]
    assert [values[leaves[blocks[c >> lookup.BLOCK_BITS] + (c & 127)]] for c in range(U.SIZE)] == want


def test_lookup_in_generated_code(spark):
    df = spark.createDataFrame([(0x41,), (0x3B1,), (0x10FFFF,), (0x110000,), (-1,), (None,)], "cp long")
    found = df.select(T.property_value("cp", "Script").alias("s"), T.has_property("cp", "Alphabetic").alias("a"), T.property_value("cp", "Numeric_Value").alias("n"))
    assert [tuple(r)[:2] for r in found.collect()] == [("Latin", True), ("Greek", True), ("Unknown", False), (None, None), (None, None), (None, None)]
    plan = df.select(T.property_value("cp", "Script"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert [r.n for r in spark.createDataFrame([(0xBD,), (0x41,)], "cp long").select(T.property_value("cp", "Numeric_Value").alias("n")).collect()] == ["1/2", ""]


def test_cube_has_every_total(spark):
    df = spark.createDataFrame([(1, "aB1", "x"), (2, "α a", "y"), (3, "", "y"), (4, None, None)], "doc_id long, text string, lang string")
    rows = {(r.lang, r.Script, r.General_Category, r.total): r.n for r in corpus.property_cube(df, "text", ["Script", "General_Category"], "lang").collect()}
    assert rows[None, None, None, 7] == 6 and rows["x", None, None, 3] == 3 and rows[None, "Latin", None, 5] == 3 and rows["y", "Greek", "Lowercase_Letter", 0] == 1
    rolled = {(r.lang, r.Script, r.total): r.n for r in corpus.property_cube(df, "text", ["Script"], "lang", rollup=True).collect()}
    assert rolled[None, None, 3] == 6 and (None, "Latin", 2) not in rolled


def test_names_as_a_relation(spark):
    known = names.character_names(spark).cache()
    told = {r.cp: r.name for r in known.select("cp", "name").collect()}
    assert all(told.get(c) == core_names.name(c) for c in range(U.SIZE) if core_names.has_name(c))
    assert told[0x1C89] == "CYRILLIC CAPITAL LETTER TJE" and 0x378 not in told and 0xE000 not in told and 0x0A not in told
    newer = {c for part in U.ADDED_16.split() for a, _, b in [part.partition("-")] for c in range(int(a, 16), int(b or a, 16) + 1)}
    assert newer <= set(told)
    assert known.groupBy("key").count().filter("count > 1").count() == 0
    asked = ["latin small letter_a", "Hangul Jungseong O-E", "HANGUL JUNGSEONG OE", "MARCHEN LETTER -A", "marchen letter a", "CJK unified ideograph-4e00", "no such name", None, "TIBETAN MARK TSA -PHRU"]
    got = {r.name: r.found for r in names.find(spark.createDataFrame([(a,) for a in asked], "name string"), "name").collect()}
    assert got == {a: core_names.codepoint_by_name(a) if a else None for a in asked}
    assert {r.cp for r in names.words_of_names(known.filter("cp < 128")).filter("word = 'DIGIT'").collect()} == set(range(48, 58))
    assert unicodedata.name("a") == names.with_names(spark.createDataFrame([(97,)], "cp int")).first().name


def test_few_texts_of_pieces_are_moved(spark, monkeypatch):
    """Pieces in order are read as they come; only the first piece of a batch may have to wait for the state before it. In any order the counts are the same."""
    from glyphmill.operators import long_text

    texts = [(i, "e\u0301x \U0001f1e6\U0001f1e7" * (60 * i)) for i in range(1, 9)]
    parts = long_text.pieces(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), "text", size=7)
    kept, written = {}, long_text.written
    monkeypatch.setattr(long_text, "written", lambda df, name: kept.setdefault(name, written(df, name)))
    got = {r.key: r.n for r in long_text.segment_count(parts).collect()}
    n = parts.count()
    assert n > 1000 and kept["starts"].count() <= n // 500
    assert got == {i: 60 * i * 4 for i, _ in texts}
    monkeypatch.setattr(long_text, "written", written)
    assert got == {r.key: r.n for r in long_text.segment_count(parts.repartition(5, "seq")).collect()}
