"""Sets of codepoints as relations of ranges: any number of them composed in one sweep over their ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..ucd import properties as U


def named_sets(spark, wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """name, first, last of each {property = value}."""
    rows = [(n, a, b) for n, (prop, value) in wanted.items() for a, b in U.ranges(prop, value)]
    return spark.createDataFrame(rows, "name string, first int, last int")


def compose(ranges: DataFrame, rule: Column, names: list[str]) -> DataFrame:
    """first, last: the maximal ranges of the codepoints for which `rule` holds, a condition on boolean columns called like the sets.

    ranges: name, first, last; ranges of one set may touch or overlap, and a set without ranges is empty. Each range gives two
    ends; ends at one place are added up, and running sums over the places say which sets are open there. The sweep has at most
    one row for each codepoint at which anything changes, so its one window is bounded by the code space, whatever the corpus.
    """
    ends = ranges.select("name", F.explode(F.array(F.struct(F.col("first").alias("at"), F.lit(1).alias("step")), F.struct((F.col("last") + 1).alias("at"), F.lit(-1).alias("step")))).alias("e")).select("name", "e.*")
    if any(n in ("at", "first", "last") for n in names):
        raise ValueError("at, first and last cannot name sets")
    start = ends.sparkSession.range(1).select(F.lit(0).alias("at"), *[F.lit(0).cast("long").alias(n) for n in names])
    steps = ends.groupBy("at").agg(*[F.sum(F.when(F.col("name") == n, F.col("step")).otherwise(0)).alias(n) for n in names]).unionByName(start)
    places = steps.groupBy("at").agg(*[F.sum(n).alias(n) for n in names])
    by_place = Window.orderBy("at")
    open_ = places.select("at", F.lead("at", 1, U.SIZE).over(by_place).alias("next"), *[(F.sum(n).over(by_place.rowsBetween(Window.unboundedPreceding, 0)) > 0).alias(n) for n in names])
    hit = open_.filter(rule & (F.col("at") < U.SIZE)).select("at", "next")
    by_hit = Window.orderBy("at")
    island = hit.withColumn("new", F.coalesce((F.lag("next").over(by_hit) < F.col("at")).cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(by_hit))
    return island.groupBy("island").agg(F.min("at").alias("first"), (F.max("next") - 1).alias("last")).drop("island")


def union(ranges: DataFrame, names: list[str]) -> DataFrame:
    """Codepoints of any of the sets."""
    return compose(ranges, _any(names), names)


def intersection(ranges: DataFrame, names: list[str]) -> DataFrame:
    """Codepoints of all of the sets."""
    rule = F.lit(True)
    for n in names:
        rule = rule & F.col(n)
    return compose(ranges, rule, names)


def difference(ranges: DataFrame, of: str, without: list[str]) -> DataFrame:
    """Codepoints of one set and none of the others."""
    return compose(ranges, F.col(of) & ~_any(without), [of, *without])


def complement(ranges: DataFrame, names: list[str]) -> DataFrame:
    """Codepoints of none of the sets."""
    return compose(ranges, ~_any(names), names)


def _any(names: list[str]) -> Column:
    rule = F.lit(False)
    for n in names:
        rule = rule | F.col(n)
    return rule


def members(rows: DataFrame, cp: str, ranges: DataFrame, anti: bool = False) -> DataFrame:
    """Rows whose codepoint is (or is not) in the ranges: a semi join by block of 256 codepoints, broadcast since ranges are bounded by the code space."""
    blocks = F.broadcast(ranges.withColumn("block", F.explode(F.sequence(F.shiftright("first", 8), F.shiftright("last", 8)))))
    inside = (F.shiftright(F.col(cp), 8) == blocks["block"]) & F.col(cp).between(blocks["first"], blocks["last"])
    return rows.join(blocks, inside, "left_anti" if anti else "left_semi")
