"""Properties that come from the character library among Spark's own jars, as relations built inside the JVM.

That library knows version 16.0; what 17.0 adds is stated here. Blocks: the published number of ranges, hash not reproduced.
Vertical orientation: 16.0 with the one block whose default changed; 264 of the published 280 ranges, so newer signs may differ.
Mirrored pairs and brackets are those of 16.0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..ucd import properties as U

_CLASS = "com.ibm.icu.lang.UCharacter"
#: The library's numbers of the properties.
_NUMBERS = {"Block": 0x1001, "Vertical_Orientation": 0x1018, "Bidi_Paired_Bracket_Type": 0x1015}

# -- fixed values: blocks that 17.0 added
NEW_BLOCKS = [
    (0x10940, 0x1095F, "Sidetic"), (0x11B60, 0x11B7F, "Sharada_Supplement"), (0x11DB0, 0x11DEF, "Tolong_Siki"), (0x16EA0, 0x16EDF, "Beria_Erfe"),
    (0x18D80, 0x18DFF, "Tangut_Components_Supplement"), (0x1CEC0, 0x1CEFF, "Miscellaneous_Symbols_Supplement"), (0x1E6C0, 0x1E6FF, "Tai_Yo"), (0x323B0, 0x3347F, "CJK_Unified_Ideographs_Extension_J"),
]
#: Orientation of new blocks where it is not what the library gives unassigned codepoints.
NEW_UPRIGHT = [(0x18D80, 0x18DFF)]


def _value(name: str, cp: Column) -> Column:
    number = F.lit(_NUMBERS[name])
    code = F.java_method(F.lit(_CLASS), F.lit("getIntPropertyValue"), cp, number).cast("int")
    return F.java_method(F.lit(_CLASS), F.lit("getPropertyValueName"), number, code, F.lit(1))


def _with_ranges(value: Column, cp: Column, ranges: list[tuple[int, int, str]]) -> Column:
    for a, b, v in ranges:
        value = F.when(cp.between(a, b), v).otherwise(value)
    return value


def _runs(values: DataFrame) -> DataFrame:
    """first, last, value: maximal ranges of cp, value, of which there are as many as codepoints at most."""
    island = values.withColumn("island", F.col("cp") - F.row_number().over(Window.partitionBy("value").orderBy("cp")))
    return island.groupBy("value", "island").agg(F.min("cp").alias("first"), F.max("cp").alias("last")).select("first", "last", "value")


def _points(spark: SparkSession, step: int = 1) -> DataFrame:
    return spark.range(0, U.SIZE, step).select(F.col("id").cast("int").alias("cp"))


def blocks(spark: SparkSession) -> DataFrame:
    """first, last, value of every block and of what is in none; blocks begin and end at multiples of 16."""
    rows = _points(spark, 16).select("cp", _with_ranges(_value("Block", F.col("cp")), F.col("cp"), NEW_BLOCKS).alias("value"))
    every = rows.withColumn("island", F.col("cp") / 16 - F.row_number().over(Window.partitionBy("value").orderBy("cp")))
    return every.groupBy("value", "island").agg(F.min("cp").alias("first"), (F.max("cp") + 15).alias("last")).select("first", "last", "value")


def vertical_orientations(spark: SparkSession) -> DataFrame:
    """first, last, value: Rotated, Transformed_Rotated, Transformed_Upright or Upright."""
    cp = F.col("cp")
    return _runs(_points(spark).select("cp", _with_ranges(_value("Vertical_Orientation", cp), cp, [(a, b, "Upright") for a, b in NEW_UPRIGHT]).alias("value")))


def mirrors(spark: SparkSession) -> DataFrame:
    """cp, mirror of the characters that have a mirrored one."""
    rows = _points(spark).select("cp", F.java_method(F.lit(_CLASS), F.lit("getMirror"), F.col("cp")).cast("int").alias("mirror"))
    return rows.filter("cp <> mirror")


def brackets(spark: SparkSession) -> DataFrame:
    """cp, bracket, opens of the paired brackets."""
    cp = F.col("cp")
    rows = _points(spark).select("cp", F.java_method(F.lit(_CLASS), F.lit("getBidiPairedBracket"), cp).cast("int").alias("bracket"), _value("Bidi_Paired_Bracket_Type", cp).alias("kind"))
    return rows.filter("kind <> 'None'").select("cp", "bracket", (F.col("kind") == "Open").alias("opens"))
