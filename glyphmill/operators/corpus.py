"""Operators over whole corpora: codepoint profiles, property filters, segments, script runs."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from ..sources.ucd import by_block, ucd_records
from ..text import script as script_core
from ..text import segment
from ..ucd import properties as U


def codepoint_counts(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """keys, cp, n: how often each codepoint occurs; counted before anything is joined."""
    chars = df.select(*keys, F.explode(F.split(F.col(text), "")).alias("c")).filter("c <> ''")
    return chars.groupBy(*keys, F.ascii("c").alias("cp")).agg(F.count("*").alias("n"))


def property_profile(df: DataFrame, text: str, props: list[str], *keys: str) -> DataFrame:
    """keys, props, n: codepoints by their properties. Joins the small counts with the broadcast ranges (about ten thousand rows, bounded by the code space)."""
    counts = codepoint_counts(df, text, *keys)
    dim = F.broadcast(by_block(ucd_records(df.sparkSession, props)))
    found = counts.join(dim, (F.shiftright("cp", 8) == F.col("block")) & F.col("cp").between(F.col("first"), F.col("last")), "left")
    return found.groupBy(*keys, *props).agg(F.sum("n").alias("n"))


def property_cube(df: DataFrame, text: str, props: list[str], *keys: str, rollup: bool = False) -> DataFrame:
    """keys, props, n and total, a bit for each column that is summed over (the first column's the highest): every subtotal of property_profile.

    Codepoints are counted and joined before the grouping sets expand them, so what is expanded are the few combinations of values.
    """
    counts = property_profile(df, text, props, *keys)
    columns = [*keys, *props]
    sets = counts.rollup(*columns) if rollup else counts.cube(*columns)
    return sets.agg(F.sum("n").alias("n"), F.grouping_id(*columns).cast("long").alias("total"))


def with_property(df: DataFrame, cp: str, prop: str, value: str, anti: bool = False) -> DataFrame:
    """Rows whose codepoint is (or is not) in {property = value}: a broadcast semi join on ranges by block."""
    rows = df.sparkSession.createDataFrame(U.ranges(prop, value) or [(1, 0)], "first int, last int").filter("first <= last")
    members = F.broadcast(by_block(rows))
    inside = (F.shiftright(F.col(cp), 8) == members["block"]) & F.col(cp).between(members["first"], members["last"])
    return df.join(members, inside, "left_anti" if anti else "left_semi")


def segments(df: DataFrame, text: str, kind: str = "word", tailoring: str = "STRICT", writing: str = "NEUTRAL", provider=None, key: str = "doc_id") -> DataFrame:
    """key, i, start, byte_start, segment: one row a segment; a table function over Arrow batches."""
    ship(df.sparkSession)
    options = {"tailoring": tailoring, "writing": writing, "provider": provider} if kind == "line" else {}

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                rows = {"k": [], "i": [], "start": [], "byte_start": [], "segment": []}
                for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if not t:
                        continue
                    cut = segment.boundaries(t, kind, **options)
                    cut = cut if cut[0] == 0 else [0, *cut]
                    at = segment.byte_offsets(t, cut)
                    n = len(cut) - 1
                    rows["k"] += [k] * n
                    rows["i"] += range(n)
                    rows["start"] += cut[:-1]
                    rows["byte_start"] += at[:-1]
                    rows["segment"] += [t[a:b] for a, b in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(rows["k"], part.column(0).type), pa.array(rows["i"], pa.int32()), pa.array(rows["start"], pa.int32()), pa.array(rows["byte_start"], pa.int32()), pa.array(rows["segment"], pa.string())], [key, "i", "start", "byte_start", "segment"])

    kind_of_key = dict(df.dtypes)[key]
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind_of_key}, i int, start int, byte_start int, segment string")


def script_masks(spark) -> DataFrame:
    """cp, m0..m3, unknown, digits: sets of scripts as bits, for `script_runs`."""
    names = sorted({s for s in U.codes("Script")[1]} | {x for v in script_core.AUGMENTED.values() for x in v})
    place = {s: i for i, s in enumerate(names)}
    of, sets = U.script_extensions()
    scripts, script_names = U.codes("Script")
    import numpy as np

    edge = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (scripts[1:] != scripts[:-1])))
    rows = []
    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), U.SIZE]):
        s = script_core.augmented(a)
        m = [-1] * 4 if s is None else [0] * 4
        for x in s or ():
            word, bit = divmod(place[x], 62)
            m[word] |= 1 << bit
        rows.append((a, b - 1, *m, script_names[scripts[a]] == "Unknown"))
    return spark.createDataFrame(rows, "first int, last int, m0 long, m1 long, m2 long, m3 long, unknown boolean")


def digit_sets(spark) -> DataFrame:
    """cp, digits: of each decimal digit the zero of its set."""
    return spark.createDataFrame([(c, script_core.digit_block(c)) for c in U.numeric_values() if script_core.digit_block(c) is not None], "cp int, digits int")


def script_runs(df: DataFrame, text: str, key: str = "doc_id") -> DataFrame:
    """key, is_run: the single-script verdict as a mergeable aggregate; the state is merged, never verdicts.

    An equi join on cp >> 7 with the range as a residual; ranges are split at those blocks.
    """
    spark = df.sparkSession
    dim = script_masks(spark).select(F.explode(F.sequence(F.shiftright("first", 7), F.shiftright("last", 7))).alias("b"), "*")
    counts = codepoint_counts(df, text, key).withColumn("b", F.shiftright("cp", 7))
    joined = counts.join(F.broadcast(dim), (counts["b"] == dim["b"]) & counts["cp"].between(dim["first"], dim["last"])).join(F.broadcast(digit_sets(spark)), "cp", "left")
    state = joined.groupBy(key).agg(
        F.sum("n").alias("n"), F.bool_or("unknown").alias("unknown"), F.countDistinct("digits").alias("digit_sets"), *[F.bit_and(f"m{i}").alias(f"m{i}") for i in range(4)]
    )
    some = F.col("m0").bitwiseOR(F.col("m1")).bitwiseOR(F.col("m2")).bitwiseOR(F.col("m3")) != 0
    return state.select(key, ((F.col("n") < 2) | (~F.col("unknown") & (F.col("digit_sets") <= 1) & some)).alias("is_run"))


def top_characters(df: DataFrame, text: str, group: str, k: int = 10) -> DataFrame:
    """group, cp, n, rank: the k most frequent codepoints of each group; ties by codepoint."""
    from pyspark.sql import Window

    counts = codepoint_counts(df, text, group)
    w = Window.partitionBy(group).orderBy(F.desc("n"), "cp")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def paragraphs(df: DataFrame, text: str, key: str = "doc_id") -> DataFrame:
    """key, i, paragraph: split after each paragraph separator, which stays at the end; for the bidi functions."""
    parts = F.split(F.col(text), "(?<=[\n\r\x1c-\x1e\x85 ])(?<!\r(?=\n))")
    return df.select(key, F.posexplode(F.filter(parts, lambda p: p != "")).alias("i", "paragraph"))
