"""The library's registered queries and their SQL."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus, long_text, names, sets
from ..shipping import new_path, ship
from ..sources import library, ucd
from ..streaming import text as streaming
from ..ucd import properties as U


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def script_category_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = corpus.property_profile(_table(spark, sf_dir, "documents"), "text", ["Script", "General_Category"], "lang")
    return out.select("lang", F.col("Script").alias("script"), F.col("General_Category").alias("category"), "n")


def utf8_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    return d.select("doc_id", T.utf8_count("text").cast("long").alias("n_codepoints"), F.octet_length("text").cast("long").alias("n_bytes"), T.utf8_validate("text").alias("valid"))


def non_ascii_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").filter(F.octet_length("text") != F.char_length("text"))
    return d.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(F.octet_length("text") - F.char_length("text")).alias("extra_bytes"))


def grapheme_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    return d.select("doc_id", T.call("u_grapheme_count", "text").cast("long").alias("n_graphemes"))


def normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(T.normalize("text", "NFC")).alias("nfc"), T.call("u_is_normalized", "text", form="NFC").alias("is_nfc"))


def accents_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(F.regexp_replace(T.normalize("text", "NFD"), r"\p{Mn}", "")).alias("plain"))


def case_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(T.call("u_upper", "text")).alias("upper"), F.md5(T.call("u_lower", "text")).alias("lower"), F.md5(T.call("u_case_fold", "text")).alias("folded"))


def caseless_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations")
    return c.groupBy(F.md5(T.call("u_case_fold", "text")).alias("fold")).agg(F.count("*").alias("n"), F.min("conv_id").alias("first_conv"))


def script_run_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.script_runs(_table(spark, sf_dir, "documents"), "text")


def top_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.top_characters(_table(spark, sf_dir, "documents"), "text", "lang", 10).select("lang", F.col("cp").cast("long").alias("cp"), "n", F.col("rank").cast("long").alias("rank"))


def latin_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = corpus.codepoint_counts(_table(spark, sf_dir, "pages"), "html")
    return corpus.with_property(counts, "cp", "General_Category", "Lowercase_Letter").select(F.col("cp").cast("long").alias("cp"), "n")


def benchmark_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = corpus.segments(_table(spark, sf_dir, "benchmark"), "text", "word", key="item_id")
    return w.filter(F.col("segment").rlike(r"^\p{L}")).groupBy("item_id").agg(F.count("*").alias("n_words"))


def sentence_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = corpus.segments(_table(spark, sf_dir, "documents"), "text", "sentence")
    return s.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.max(F.char_length("segment")).alias("longest"), F.sum(F.char_length("segment")).alias("n_codepoints"))


def line_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "conversations")
    return d.select("conv_id", "turn", F.size(T.call("u_boundaries", "text", kind="line")).alias("n_breaks"))


def bidi_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = corpus.paragraphs(_table(spark, sf_dir, "benchmark"), "text", "item_id")
    found = p.withColumn("b", T.call("u_bidi_levels", "paragraph"))
    return found.select("item_id", "i", F.col("b.paragraph_level").cast("long").alias("level"), F.array_max("b.levels").cast("long").alias("highest"), F.size("b.levels").cast("long").alias("n"))


def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = corpus.segments(_table(spark, sf_dir, "documents"), "text", "word")
    return w.filter(F.col("segment").rlike(r"[\p{L}\p{Nd}]")).groupBy("doc_id").agg(F.count("*").alias("n_words"))


def bidi_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = corpus.paragraphs(_table(spark, sf_dir, "documents"), "text").withColumn("b", T.call("u_bidi_levels", "paragraph"))
    return p.groupBy("doc_id").agg(F.count("*").alias("n_paragraphs"), F.max("b.paragraph_level").cast("long").alias("level"), F.max(F.array_max("b.levels")).cast("long").alias("highest"), F.sum(F.size("b.levels")).alias("n_codepoints"))


def property_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every property (enumerated, binary, combining class, script extensions) how many characters have each value."""
    counts = corpus.codepoint_counts(_table(spark, sf_dir, "documents"), "text")
    found = counts.join(ucd.by_block(ucd.all_runs(spark)), (F.shiftright("cp", 8) == F.col("block")) & F.col("cp").between(F.col("first"), F.col("last")))
    return found.groupBy("property", "value").agg(F.sum("n").alias("n"))


#: Looked up in generated code; the others have a range join.
LOOKED_UP = ("Bidi_Class", "East_Asian_Width", "Sentence_Break", "Joining_Type", "Alphabetic", "Quotation_Mark")


def property_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = corpus.codepoint_counts(_table(spark, sf_dir, "pages"), "html")
    return counts.select("n", *[T.property_value("cp", p).alias(p.lower()) for p in LOOKED_UP]).groupBy(*[p.lower() for p in LOOKED_UP]).agg(F.sum("n").alias("n"))


def block_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of documents by block and vertical orientation, by range joins."""
    counts = corpus.codepoint_counts(_table(spark, sf_dir, "documents"), "text", "lang")
    for name, ranges in (("block", library.blocks(spark)), ("orientation", library.vertical_orientations(spark))):
        by = F.broadcast(ucd.by_block(ranges).withColumnsRenamed({"first": "a", "last": "z", "block": "part", "value": name}))
        counts = counts.join(by, (F.shiftright("cp", 8) == F.col("part")) & F.col("cp").between(F.col("a"), F.col("z"))).drop("a", "z", "part")
    return counts.groupBy("lang", "block", "orientation").agg(F.sum("n").alias("n"))


#: name: (property, value) of sets that are composed
SETS = {"latin": ("Script", "Latin"), "greek": ("Script", "Greek"), "upper": ("Uppercase", "Yes"), "digit": ("General_Category", "Decimal_Number"), "dash": ("Dash", "Yes"), "hex": ("Hex_Digit", "Yes"), "quote": ("Quotation_Mark", "Yes")}


def composed_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of pages in ((latin or greek) without upper) or (digit and hex) or dash, and in none of the sets."""
    counts = corpus.codepoint_counts(_table(spark, sf_dir, "pages"), "html")
    named = sets.named_sets(spark, SETS)
    c = F.col
    chosen = sets.compose(named, (c("latin") | c("greek")) & ~c("upper") | c("digit") & c("hex") | c("dash"), list(SETS))
    none = sets.complement(named, list(SETS))
    both = [sets.members(counts, "cp", r).select(F.lit(n).alias("part"), F.col("cp").cast("long").alias("cp"), "n") for n, r in (("chosen", chosen), ("none", none))]
    return both[0].unionByName(both[1])


def script_category_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = corpus.property_cube(_table(spark, sf_dir, "documents"), "text", ["Script", "General_Category"], "lang")
    return out.select("lang", F.col("Script").alias("script"), F.col("General_Category").alias("category"), "n", "total")


def script_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = corpus.property_cube(_table(spark, sf_dir, "documents"), "text", ["Script"], "lang", "source", rollup=True)
    return out.select("lang", "source", F.col("Script").alias("script"), "n", "total")


def script_run_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive as a stream of chunks of 200 characters; the last update of each gives its verdict."""
    ship(spark)
    kind = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    arriving = spark.readStream.schema(kind).parquet(f"{sf_dir}/documents.parquet*")
    found = streaming.script_runs(long_text.pieces(arriving, "text", size=200).select(F.col("key").alias("doc_id"), "text"), "text")
    out = new_path(spark, "stream")
    updates = found.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", new_path(spark, "state"))
    updates.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")).start().awaitTermination()
    log = spark.read.schema(found.schema.add("batch", "long")).parquet(out)
    return log.groupBy("doc_id").agg(F.max_by("is_run", "batch").alias("is_run"))


def long_text_nfc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty documents make one long text, which comes in pieces of 700 characters and is normalised piece by piece."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") / 50).cast("long").alias("book"), "text")
    books = docs.groupBy("book").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", F.coalesce("text", F.lit("")).alias("text")))), lambda d: d["text"]), "").alias("text"))
    whole = long_text.joined(long_text.normalize(long_text.pieces(books, "text", "book", 700), "NFC"))
    return whole.select(F.col("key").alias("book"), F.char_length("text").cast("long").alias("n_codepoints"), F.md5("text").alias("nfc"))


def long_text_graphemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grapheme clusters of documents that come in pieces of 300 characters."""
    parts = long_text.pieces(_table(spark, sf_dir, "documents"), "text", size=300)
    return long_text.segment_count(parts, "grapheme").select(F.col("key").alias("doc_id"), F.col("n").alias("n_graphemes"))


def chunked_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of 997 bytes, which cut characters, decoded in order."""
    chunks = long_text.byte_chunks(_table(spark, sf_dir, "documents"), F.col("text").cast("binary"), size=997)
    return long_text.decode_chunks(chunks, "REFUSE").groupBy(F.col("key").alias("doc_id")).agg(F.sum(F.char_length("text")).alias("n_codepoints"), F.bool_and("ok").alias("ok"))


def character_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The characters of documents with their names, and what is found by the name written loosely."""
    named = names.with_names(corpus.codepoint_counts(_table(spark, sf_dir, "documents"), "text"))
    found = names.find(named.withColumn("loose", F.lower(F.translate("name", " ", "_"))), "loose")
    return found.select(F.col("cp").cast("long").alias("cp"), "name", "n", F.coalesce(F.col("found") == F.col("cp"), F.lit(False)).alias("found"))


_QUERIES = (
    script_category_profile, utf8_lengths, non_ascii_documents, grapheme_counts, normal_forms, accents_stripped, case_mappings, caseless_turns, script_run_documents, top_characters, latin_letters,
    benchmark_words, document_words, sentence_lengths, line_opportunities, bidi_paragraphs, bidi_documents, property_usage, property_lookup, block_profile, composed_sets, script_category_cube, script_rollup,
    script_run_stream, long_text_nfc, long_text_graphemes, chunked_decoding, character_names,
)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


# -- fixed values: range count and FNV-1a-64 of the published 17.0 properties and mappings
FINGERPRINTS = {
    "ASCII": (2, "E45913954442687D"), "ASCII_Hex_Digit": (7, "558C51664F5CA09E"), "Alphabetic": (1523, "9C0175142378E057"), "Any": (1, "8A61D5CEE523898F"),
    "Assigned": (1470, "CE7265247C6FD19C"), "Bidi_Class": (1267, "F8F21F06B38D3CD6"), "Bidi_Control": (9, "0F3716F44712E559"), "Bidi_Mirrored": (229, "E6736B6332459509"),
    "Canonical_Combining_Class": (606, "6BE787CA0CD8B82B"), "Case_Folding": (2217, "57E96988DABA1503"), "Case_Ignorable": (929, "6E70CB149875F75B"), "Cased": (317, "66506268D77C3117"),
    "Changes_When_Casefolded": (1261, "DACA61C7B8304C80"), "Changes_When_Casemapped": (263, "5270B43000E2A8DA"), "Changes_When_Lowercased": (1237, "C64CC8038ED2E818"), "Changes_When_NFKC_Casefolded": (1697, "E6E6D9346FFAB760"),
    "Changes_When_Titlecased": (1267, "4194ACA27443431A"), "Changes_When_Uppercased": (1269, "26FAE8A62C7F8282"), "Dash": (49, "1F8ADEBFD1BCAF4D"), "Decomposition_Type": (1212, "B46712277FC41F38"),
    "Default_Ignorable_Code_Point": (35, "48AF8FD5CDCB45A4"), "Deprecated": (17, "C42B72C632A4C18E"), "Diacritic": (441, "3255C7A847204759"), "East_Asian_Width": (602, "948B831D7953F082"),
    "Emoji": (303, "FAF73C1B49EA7713"), "Emoji_Component": (21, "0E4F49DE4A063C35"), "Emoji_Modifier": (3, "D1D9ECC50949B949"), "Emoji_Modifier_Base": (81, "D70521EDEE46CA92"),
    "Emoji_Presentation": (163, "6AE345AC3D7D732C"), "Expands_On_NFC": (73, "BE388B4B2D266E02"), "Expands_On_NFD": (453, "3D96A48D23C9866D"), "Expands_On_NFKC": (245, "4873C4CFB36934E6"),
    "Expands_On_NFKD": (599, "81764356ED4BF953"), "Extended_Pictographic": (313, "47C5303C12F5389A"), "Extender": (87, "44199F02D5AF81AB"), "Full_Composition_Exclusion": (147, "C6897957AEC5BE90"),
    "General_Category": (4144, "92E33DFC248931A6"), "Grapheme_Base": (1809, "66309B08B24F26F4"), "Grapheme_Cluster_Break": (1734, "5071CB1746B246C8"), "Grapheme_Extend": (767, "EC9B1E9F1589AAF7"),
    "Grapheme_Link": (117, "9544FB593D1FBB63"), "Hangul_Syllable_Type": (810, "9BBC310E8DDEA44A"), "Hex_Digit": (13, "DCED1877146AF5D1"), "Hyphen": (21, "9CA069FCE582AE92"),
    "IDS_Binary_Operator": (7, "79BD486A96165893"), "IDS_Trinary_Operator": (3, "EA3048C6DA428D43"), "IDS_Unary_Operator": (3, "8476829825EB6E9D"), "ID_Compat_Math_Continue": (37, "E0851411A50D1AAE"),
    "ID_Compat_Math_Start": (27, "AE97C3A06C843FDF"), "ID_Continue": (1599, "98F98AFBC712307D"), "ID_Start": (1369, "F67B0F67295B914C"), "Ideographic": (43, "7100FC0F92F1421B"),
    "Indic_Conjunct_Break": (906, "5C6028BAA9E7802A"), "Indic_Positional_Category": (884, "7C3668F0512C1BF1"), "Indic_Syllabic_Category": (1154, "3C06DA5EB884D3A9"), "Join_Control": (3, "916E4DD5AA31F7F5"),
    "Joining_Group": (252, "C018569BCEC8D405"), "Joining_Type": (932, "ABAABA0C44D74C23"), "Logical_Order_Exception": (15, "BAEA1A727EB11C3B"), "Lowercase": (1355, "D8E102CC2D95F74C"),
    "Lowercase_Mapping": (2103, "0EA840B498AA145F"), "Math": (283, "B370C7FBEA158198"), "Modifier_Combining_Mark": (19, "31F4246F8627A9FA"), "NFC_Quick_Check": (242, "E51F35136F4A2FC2"),
    "NFD_Quick_Check": (485, "74272739F62784E2"), "NFKC_Quick_Check": (607, "2E63480323784C4C"), "NFKD_Quick_Check": (817, "EAC957CD1BDF3A20"), "Noncharacter_Code_Point": (36, "3A887B5839A1E4EC"),
    "Numeric_Type": (498, "CD0EC1A4DE4A0278"), "Numeric_Value": (2215, "D04778AF24C46E0F"), "Other_Alphabetic": (511, "842F29C2802C2E62"), "Other_Default_Ignorable_Code_Point": (23, "45FCD86E3F02D8A8"),
    "Other_Grapheme_Extend": (99, "004EF6F5A9D29DAF"), "Other_ID_Continue": (15, "BB44A8AF74892AEA"), "Other_ID_Start": (9, "D30FCF306333DAD7"), "Other_Lowercase": (57, "A584655DC6A8922B"),
    "Other_Math": (269, "F8D6272EC0A8528F"), "Other_Uppercase": (11, "E7DDCFBC88140934"), "Pattern_Syntax": (57, "2BA1232DACD512F7"), "Pattern_White_Space": (11, "59FCA795124454CC"),
    "Prepended_Concatenation_Mark": (15, "33539457A4883B79"), "Quotation_Mark": (27, "02AF1DA78F46ADE9"), "Radical": (7, "C262A0C50F07A748"), "Regional_Indicator": (3, "5AE7DB2C9521DA61"),
    "Script": (1717, "311A02D5B8BFEB9C"), "Script_Extensions": (1882, "1EA2ED1E065BFEE1"), "Sentence_Break": (3363, "7D44F5C151169EBA"), "Sentence_Terminal": (177, "D758274C5BEB163E"),
    "Simple_Case_Folding": (2137, "712A85FE08F08189"), "Simple_Lowercase_Mapping": (2103, "19ED0EE0F0683B37"), "Simple_Titlecase_Mapping": (2092, "65C07DBE4603182B"), "Simple_Uppercase_Mapping": (2134, "7DBE8FEF1196FA35"),
    "Soft_Dotted": (69, "0E32CF44A750C539"), "Terminal_Punctuation": (233, "4E32CD6720A2C9C8"), "Titlecase_Mapping": (2138, "D9DFD710AF4CF8B5"), "Unified_Ideograph": (33, "EA4627E894351F24"),
    "Uppercase": (1321, "1BFA08E26C253A3D"), "Uppercase_Mapping": (2208, "9CC56523CB919282"), "Variation_Selector": (9, "8B13B546E53AD6C9"), "Word_Break": (1909, "A227C25318ACA32E"),
    "XID_Continue": (1613, "99E4E7D86FBE9F1A"), "XID_Start": (1383, "F2392966FCD2EB60"), "White_Space": (21, "7529672980AE7965"),
}
#: The first blocks.
BLOCKS = [(0, 0x7F, "Basic_Latin"), (0x80, 0xFF, "Latin_1_Supplement"), (0x100, 0x17F, "Latin_Extended_A"), (0x180, 0x24F, "Latin_Extended_B")]
#: The one property that is known to differ in a few ranges.
INEXACT = {"Line_Break": (3616, "40BB6EECF7886208")}

def _values(rows: list[tuple]) -> str:
    one = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + ")"


def _ranges(*props: str) -> str:
    """first, last and values of the blocks that the corpus can hold, as an inline table."""
    import bisect

    each = [U.runs(p) for p in props]
    starts = sorted({a for rows in each for a, _, _ in rows if a < 0x3000})
    rows = [(a, b - 1, *[r[bisect.bisect_right([x for x, _, _ in r], a) - 1][2] for r in each]) for a, b in zip(starts, [*starts[1:], 0x3000])]
    return _values(rows)


def oracle_sql() -> dict[str, str]:
    chars = lambda table, text, keys: f"SELECT {keys}ord(c) AS cp, count(*) AS n FROM (SELECT {keys}unnest(string_split({text}, '')) AS c FROM {table}) WHERE c <> '' GROUP BY ALL"
    dim = _ranges("Script", "General_Category")
    every = _values([(p, a, b, v) for p in ucd.PROPERTIES for a, b, v in U.runs(p) if a < 0x3000])
    called = _values([(c, unicodedata.name(chr(c))) for c in range(0x500) if unicodedata.name(chr(c), "")])
    inside = lambda *names_: "(" + " OR ".join(f"cp BETWEEN {a} AND {b}" for n in names_ for a, b in U.ranges(*SETS[n]) if a < 0x3000) + ")"
    # a mark between two letters or two digits joins them
    joined = "text"
    for marks, side in ((":.\u00b7\u2018\u2019\u2024\'\'", r"\p{L}"), (",;.\u2018\u2019\u2024\'\'", r"\p{Nd}")) * 2:
        joined = f"regexp_replace({joined}, '({side})[{marks}]({side})', '\\1x\\2', 'g')"
    paragraph = r"[^\n\r\x{1c}-\x{1e}\x{85}\x{2029}]*(?:\r\n|[\n\r\x{1c}-\x{1e}\x{85}\x{2029}])|[^\n\r\x{1c}-\x{1e}\x{85}\x{2029}]+"
    # sentences: a mark after each terminator and what belongs to it, taken out again where a rule goes on
    close, para = r"[\"''()\[\]{}\x{2018}-\x{201f}\x{ab}\x{bb}\x{2039}\x{203a}]*", r"\n\r\x{85}\x{2029}"
    marked = "text"
    for found, put in (
        (rf"(\.{close}[\x20\t\x{{a0}}]*)", r"\1\x{1}"), (rf"([!?]{close}[\x20\t\x{{a0}}]*)", r"\1\x{2}"), (r"\.\x{1}(\p{Nd})", r".\1"), (r"(\p{L})\.\x{1}(\p{Lu})", r"\1.\2"), (r"(\p{L})\.\x{1}(\p{Lu})", r"\1.\2"),
        (rf"\x{{1}}([^\p{{L}}{para}.!?\x{{1}}\x{{2}}]*\p{{Ll}})", r"\1"), (r"[\x{1}\x{2}]([-,:;\x{2013}\x{2014}.!?])", r"\1"), (rf"[\x{{1}}\x{{2}}]([{para}])", r"\1"), (rf"(\r\n|[{para}])", r"\1\x{1}"), (r"\x{2}", r"\x{1}"), (r"\x{1}$", ""),
    ):
        put = "'" + put.replace(r"\x{1}", "' || chr(1) || '").replace(r"\x{2}", "' || chr(2) || '") + "'"
        marked = f"regexp_replace({marked}, '{found}', {put}, 'g')"
    out = {
        "script_category_profile": f"SELECT lang, d.script, d.category, CAST(sum(n) AS BIGINT) AS n FROM ({chars('documents', 'text', 'lang, ')}) x LEFT JOIN {dim} AS d(first, last, script, category) ON x.cp BETWEEN d.first AND d.last GROUP BY ALL",
        "utf8_lengths": "SELECT doc_id, length(text) AS n_codepoints, strlen(text) AS n_bytes, true AS valid FROM documents",
        "non_ascii_documents": "SELECT lang, count(*) AS n_docs, CAST(sum(strlen(text) - length(text)) AS BIGINT) AS extra_bytes FROM documents WHERE strlen(text) <> length(text) GROUP BY lang",
        "grapheme_counts": "SELECT doc_id, length_grapheme(text) AS n_graphemes FROM documents",
        "normal_forms": "SELECT doc_id, md5(nfc_normalize(text)) AS nfc, nfc_normalize(text) = text AS is_nfc FROM documents",
        "accents_stripped": "SELECT doc_id, md5(strip_accents(text)) AS plain FROM documents",
        "case_mappings": "SELECT doc_id, md5(replace(upper(replace(text, 'ß', 'SS')), 'ẞ', 'SS')) AS upper, md5(lower(text)) AS lower, md5(replace(lower(text), 'ß', 'ss')) AS folded FROM documents",
        "caseless_turns": "SELECT md5(replace(lower(text), 'ß', 'ss')) AS fold, count(*) AS n, min(conv_id) AS first_conv FROM conversations GROUP BY 1",
        "script_run_documents": f"SELECT doc_id, count(DISTINCT CASE WHEN d.script NOT IN ('Common', 'Inherited') THEN d.script END) <= 1 AS is_run FROM ({chars('documents', 'text', 'doc_id, ')}) x JOIN {dim} AS d(first, last, script, category) ON x.cp BETWEEN d.first AND d.last GROUP BY doc_id",
        "top_characters": f"SELECT lang, CAST(cp AS BIGINT) AS cp, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, cp) AS rank FROM ({chars('documents', 'text', 'lang, ')})) WHERE rank <= 10",
        "latin_letters": f"SELECT CAST(cp AS BIGINT) AS cp, n FROM ({chars('pages', 'html', '')}) x JOIN {dim} AS d(first, last, script, category) ON x.cp BETWEEN d.first AND d.last WHERE d.category = 'Lowercase_Letter'",
        "document_words": rf"""SELECT doc_id, CAST(len(regexp_extract_all({joined}, '[\p{{L}}\p{{Nd}}_]*[\p{{L}}\p{{Nd}}][\p{{L}}\p{{Nd}}_]*')) AS BIGINT) AS n_words FROM documents WHERE regexp_matches(text, '[\p{{L}}\p{{Nd}}]')""",
        "sentence_lengths": f"SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, CAST(list_max(list_transform(s, lambda x: length(x))) AS INTEGER) AS longest, CAST(list_sum(list_transform(s, lambda x: length(x))) AS BIGINT) AS n_codepoints FROM (SELECT doc_id, string_split({marked}, chr(1)) AS s FROM documents WHERE text <> '')",
        "benchmark_words": rf"""SELECT item_id, n_words FROM (SELECT item_id, CAST(len(regexp_extract_all({joined}, '(?:^|[^\p{{L}}\p{{Nd}}_])\p{{L}}')) AS BIGINT) AS n_words FROM benchmark) WHERE n_words > 0""",
        "bidi_paragraphs": rf"SELECT item_id, CAST(i - 1 AS INTEGER) AS i, CAST(0 AS BIGINT) AS level, CAST(0 AS BIGINT) AS highest, CAST(length(ps[i]) AS BIGINT) AS n FROM (SELECT item_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT item_id, regexp_extract_all(text, '{paragraph}') AS ps FROM benchmark))",
        "bidi_documents": rf"SELECT doc_id, n_paragraphs, CAST(0 AS BIGINT) AS level, CAST(0 AS BIGINT) AS highest, n_codepoints FROM (SELECT doc_id, CAST(len(regexp_extract_all(text, '{paragraph}')) AS BIGINT) AS n_paragraphs, CAST(length(text) AS BIGINT) AS n_codepoints FROM documents WHERE text <> '')",
        "property_usage": f"SELECT p.property, p.value, CAST(sum(n) AS BIGINT) AS n FROM ({chars('documents', 'text', '')}) x JOIN {every} AS p(property, first, last, value) ON x.cp BETWEEN p.first AND p.last GROUP BY ALL",
        "property_lookup": f"SELECT {', '.join('d.' + p.lower() for p in LOOKED_UP)}, CAST(sum(n) AS BIGINT) AS n FROM ({chars('pages', 'html', '')}) x JOIN {_ranges(*LOOKED_UP)} AS d(first, last, {', '.join(p.lower() for p in LOOKED_UP)}) ON x.cp BETWEEN d.first AND d.last GROUP BY ALL",
        "block_profile": f"SELECT lang, block, CASE WHEN cp IN (167, 169, 174, 177, 188, 189, 190, 215, 247) THEN 'Upright' ELSE 'Rotated' END AS orientation, CAST(sum(n) AS BIGINT) AS n FROM ({chars('documents', 'text', 'lang, ')}) x JOIN {_values(BLOCKS)} AS b(first, last, block) ON x.cp BETWEEN b.first AND b.last GROUP BY ALL",
        "composed_sets": f"SELECT CASE WHEN {inside('latin', 'greek')} AND NOT {inside('upper')} OR {inside('digit')} AND {inside('hex')} OR {inside('dash')} THEN 'chosen' ELSE 'none' END AS part, CAST(cp AS BIGINT) AS cp, n FROM ({chars('pages', 'html', '')}) x WHERE {inside('latin', 'greek')} AND NOT {inside('upper')} OR {inside('digit')} AND {inside('hex')} OR {inside('dash')} OR NOT {inside(*SETS)}",
        "script_category_cube": f"SELECT lang, d.script, d.category, CAST(sum(n) AS BIGINT) AS n, CAST(grouping_id(lang, d.script, d.category) AS BIGINT) AS total FROM ({chars('documents', 'text', 'lang, ')}) x JOIN {dim} AS d(first, last, script, category) ON x.cp BETWEEN d.first AND d.last GROUP BY CUBE (lang, d.script, d.category)",
        "script_rollup": f"SELECT lang, source, d.script, CAST(sum(n) AS BIGINT) AS n, CAST(grouping_id(lang, source, d.script) AS BIGINT) AS total FROM ({chars('documents', 'text', 'lang, source, ')}) x JOIN {dim} AS d(first, last, script, category) ON x.cp BETWEEN d.first AND d.last GROUP BY ROLLUP (lang, source, d.script)",
        "long_text_nfc": "SELECT book, length(text) AS n_codepoints, md5(text) AS nfc FROM (SELECT CAST(doc_id // 50 AS BIGINT) AS book, nfc_normalize(string_agg(coalesce(text, ''), '' ORDER BY doc_id)) AS text FROM documents GROUP BY 1) WHERE text <> ''",
        "long_text_graphemes": "SELECT doc_id, length_grapheme(text) AS n_graphemes FROM documents WHERE text <> ''",
        "chunked_decoding": "SELECT doc_id, length(text) AS n_codepoints, true AS ok FROM documents WHERE text <> ''",
        "character_names": f"SELECT CAST(x.cp AS BIGINT) AS cp, v.name, n, v.cp IS NOT NULL AS found FROM ({chars('documents', 'text', '')}) x LEFT JOIN {called} AS v(cp, name) ON x.cp = v.cp",
    }
    out["script_run_stream"] = out["script_run_documents"]
    return out
