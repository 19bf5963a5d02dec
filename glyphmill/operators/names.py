"""Character names as a relation: characters and names meet by equality joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..text import names
from ..ucd import properties as U

#: The one pair of names that only a hyphen tells apart.
_HYPHEN = ("HANGULJUNGSEONGOE", "HANGULJUNGSEONGO-E")


def loose_key(name: Column) -> Column:
    """What names that match loosely have in common: capitals without spaces, underscores and medial hyphens."""
    upper = F.translate(name, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    key = F.regexp_replace(F.regexp_replace(upper, r"(?<=[^ _-])-(?=[^ _-])", ""), "[ _]", "")
    return F.when((key == _HYPHEN[0]) & upper.contains("O-E"), _HYPHEN[1]).otherwise(key)


def character_names(spark: SparkSession) -> DataFrame:
    """cp, name, key of every codepoint that has a name, a row for each at most: names of version 16.0 from the JVM's library, and those that are a prefix and the codepoint."""
    cp = F.col("id").cast("int")
    name = F.nullif(F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("getName"), cp), F.lit("null"))
    for first, last, prefix in names.PREFIXES:
        name = F.when(cp.between(first, last), F.concat(F.lit(prefix), F.hex("id"))).otherwise(name)
    rows = spark.range(U.SIZE).select(cp.alias("cp"), name.alias("name")).filter("name IS NOT NULL AND name <> ''")
    return rows.select("cp", "name", loose_key(F.col("name")).alias("key"))


def with_names(df: DataFrame, cp: str = "cp") -> DataFrame:
    """df and a column name, null where a codepoint has none."""
    known = character_names(df.sparkSession).select(F.col("cp").alias("of"), "name")
    return df.join(known, df[cp] == known["of"], "left").drop("of")


def words_of_names(named: DataFrame) -> DataFrame:
    """word, i, cp: the words of names with their places, to search names by words."""
    return named.select("cp", F.posexplode(F.split("name", " ")).alias("i", "word")).select("word", "i", "cp")


def find(df: DataFrame, name: str) -> DataFrame:
    """df and a column found, the codepoint that the name in column `name` means by loose matching, or null."""
    known = character_names(df.sparkSession).select(F.col("cp").alias("found"), F.col("key").alias("of"))
    return df.join(known, loose_key(F.col(name)) == known["of"], "left").drop("of")
