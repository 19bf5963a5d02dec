"""The text functions in Structured Streaming: scalar ones run unchanged, and script runs merge state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.corpus import digit_sets, script_masks


def codepoint_totals(stream: DataFrame, text: str, event_time: str | None = None, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Codepoints and bytes of a stream of texts: in all, or by event-time window with a watermark."""
    counts = [F.sum(F.char_length(text)).alias("n_codepoints"), F.sum(F.octet_length(text)).alias("n_bytes"), F.count("*").alias("n_texts")]
    if event_time is None:
        return stream.groupBy().agg(*counts)
    return stream.withWatermark(event_time, late).groupBy(F.window(event_time, window)).agg(*counts)


def script_runs(chunks: DataFrame, text: str, key: str = "doc_id", event_time: str | None = None, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """key, is_run, n: the single-script verdict of texts that arrive in chunks, in any order and over any number of micro-batches.

    The state of a text is the meet of its characters' script sets (four longs), the range of its digit sets, whether an
    unassigned character was seen, and its length: it merges across chunks, tasks and micro-batches, verdicts are taken from it
    only at the end. Without event_time the state stays and each update gives the verdict so far (output mode update or
    complete). With it a text ends when no chunk of it came for `gap`: the watermark, `late` behind, then gives its verdict once
    and evicts its state (output mode append).
    """
    spark = chunks.sparkSession
    grouping = [key]
    rows = chunks
    if event_time is not None:
        rows = rows.withWatermark(event_time, late)
        grouping = [F.session_window(event_time, gap), key]
    own = [key, *([event_time] if event_time else [])]
    # a character counts once for a chunk; the first one carries the chunk's length
    chars = rows.select(*own, F.char_length(text).alias("length"), F.posexplode(F.array_distinct(F.filter(F.split(F.col(text), ""), lambda c: c != ""))).alias("i", "c"))
    chars = chars.select(*own, F.when(F.col("i") == 0, F.col("length")).otherwise(0).alias("length"), F.ascii("c").alias("cp")).withColumn("b", F.shiftright("cp", 7))
    masks = script_masks(spark).select(F.explode(F.sequence(F.shiftright("first", 7), F.shiftright("last", 7))).alias("of"), "*")
    joined = chars.join(F.broadcast(masks), (F.col("b") == F.col("of")) & F.col("cp").between(F.col("first"), F.col("last"))).join(F.broadcast(digit_sets(spark)), "cp", "left")
    state = joined.groupBy(*grouping).agg(
        F.sum("length").alias("n"), F.bool_or("unknown").alias("unknown"), F.min("digits").alias("low"), F.max("digits").alias("high"), *[F.bit_and(f"m{i}").alias(f"m{i}") for i in range(4)]
    )
    some = F.col("m0").bitwiseOR(F.col("m1")).bitwiseOR(F.col("m2")).bitwiseOR(F.col("m3")) != 0
    one_set = F.coalesce(F.col("low") == F.col("high"), F.lit(True))
    return state.select(key, ((F.col("n") < 2) | (~F.col("unknown") & one_set & some)).alias("is_run"), "n")
