"""The character database as DataFrames, and a reader of its published text files."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship
from ..ucd import properties as U


def ucd_runs(spark: SparkSession, prop: str) -> DataFrame:
    """first, last, value, ucd_version: maximal ranges of one property (a few thousand rows at most)."""
    return spark.createDataFrame(U.runs(prop), "first int, last int, value string").withColumn("ucd_version", F.lit(U.UCD_VERSION))


def ucd_records(spark: SparkSession, props: list[str]) -> DataFrame:
    """first, last and a column for each property, over ranges in which all of them are constant."""
    import bisect

    each = {p: U.runs(p) for p in props}
    starts = sorted({a for rows in each.values() for a, _, _ in rows})
    firsts = {p: [a for a, _, _ in rows] for p, rows in each.items()}
    rows = [(a, b - 1, *[each[p][bisect.bisect_right(firsts[p], a) - 1][2] for p in props]) for a, b in zip(starts, [*starts[1:], U.SIZE])]
    return spark.createDataFrame(rows, "first int, last int, " + ", ".join(f"`{p}` string" for p in props))


#: Every property that has runs.
PROPERTIES = [*U.ENUMERATED, *U.BINARY, "Canonical_Combining_Class", "Script_Extensions"]


def all_runs(spark: SparkSession) -> DataFrame:
    """property, first, last, value of every property, computed on the executors."""
    ship(spark)

    def runs(batches):
        for b in batches:
            for p in b.column(0).to_pylist():
                first, last, value = zip(*U.runs(p))
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(first)), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(value)], names=["property", "first", "last", "value"])

    return spark.createDataFrame([(p,) for p in PROPERTIES], "property string").repartition(8).mapInArrow(runs, "property string, first int, last int, value string")


def by_block(ranges: DataFrame) -> DataFrame:
    """ranges (first, last, ...) with a row for each block of 256 codepoints they touch, so that a lookup is an equality join on `block`."""
    return ranges.withColumn("block", F.explode(F.sequence(F.shiftright("first", 8), F.shiftright("last", 8))))


def ucd_codepoints(spark: SparkSession, props: list[str], below: int = U.SIZE) -> DataFrame:
    """cp and a column for each property; made from the ranges, never stored beside them."""
    runs = ucd_records(spark, props).filter(F.col("first") < below)
    return runs.select(F.explode(F.sequence("first", F.least("last", F.lit(below - 1)))).alias("cp"), *props)


def ucd_values(spark: SparkSession) -> DataFrame:
    """property, code, long_name, kind of every value of the enumerated properties."""
    rows = [(p, i, n, U.property_kind(p)) for p in U.ENUMERATED for i, n in enumerate(U.ENUMERATED[p][2].split())]
    return spark.createDataFrame(rows, "property string, code int, long_name string, kind string")


def set_ranges(runs: DataFrame, wanted: str) -> DataFrame:
    """Maximal ranges of {property = wanted} out of runs: gaps and islands."""
    w = Window.partitionBy("value").orderBy("first")
    hit = runs.filter(F.col("value") == wanted).withColumn("new", F.coalesce((F.col("first") > F.lag("last").over(w) + 1).cast("int"), F.lit(1)))
    island = hit.withColumn("island", F.sum("new").over(w))
    return island.groupBy("value", "island").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("island")


def read_ucd_file(spark: SparkSession, path: str) -> DataFrame:
    """first, last, fields of a semicolon-separated database file; comments and blank lines go."""
    line = F.trim(F.regexp_replace("value", "#.*$", ""))
    rows = spark.read.text(path).withColumn("line", line).filter("line <> ''").select(F.transform(F.split("line", ";"), lambda x: F.trim(x)).alias("f"))
    ends = F.split(F.get("f", F.lit(0)), r"\.\.")
    return rows.select(
        F.conv(F.get(ends, F.lit(0)), 16, 10).cast("int").alias("first"), F.conv(F.coalesce(F.get(ends, F.lit(1)), F.get(ends, F.lit(0))), 16, 10).cast("int").alias("last"),
        F.slice("f", 2, F.greatest(F.size("f") - 1, F.lit(0))).alias("fields"),
    )


def missing_defaults(spark: SparkSession, path: str) -> DataFrame:
    """first, last, fields of the @missing lines of a database file, in order of priority."""
    found = F.regexp_extract("value", r"^#\s*@missing:\s*(.*)$", 1)
    rows = spark.read.text(path).select(found.alias("line")).filter("line <> ''").select(F.transform(F.split("line", ";"), lambda x: F.trim(x)).alias("f"))
    ends = F.split(F.get("f", F.lit(0)), r"\.\.")
    return rows.select(F.conv(F.get(ends, F.lit(0)), 16, 10).cast("int").alias("first"), F.conv(F.get(ends, F.lit(1)), 16, 10).cast("int").alias("last"), F.slice("f", 2, F.greatest(F.size("f") - 1, F.lit(0))).alias("fields"))


def read_aliases(spark: SparkSession, path: str, of_values: bool = True) -> DataFrame:
    """property, long_name, spelling: one row a spelling, of a file of value aliases (property ; short ; long ; ...) or of property aliases (short ; long ; ...).

    Combining classes have their number before the names; it is a spelling too.
    """
    line = F.trim(F.regexp_replace("value", "#.*$", ""))
    f = spark.read.text(path).withColumn("line", line).filter("line <> ''").select(F.transform(F.split("line", ";"), lambda x: F.trim(x)).alias("f"))
    at = 1 if of_values else 0
    numbered = F.lit(of_values) & (F.get("f", F.lit(0)) == "ccc")
    long = F.get("f", F.when(numbered, 3).otherwise(at + 1))
    prop = F.get("f", F.lit(0)) if of_values else long
    spelled = F.slice("f", at + 1, F.greatest(F.size("f") - at, F.lit(0)))
    return f.select(prop.alias("property"), F.coalesce(long, F.get("f", F.lit(at))).alias("long_name"), F.explode(F.array_distinct(spelled)).alias("spelling"))


def with_defaults(rows: DataFrame, missing: DataFrame, default: str, column: int = 0) -> DataFrame:
    """first, last, value: maximal ranges over all codepoints of one property, out of its lines and its @missing lines (the later ones win).

    Works on single codepoints, of which there are 1,114,112.
    """
    spread = lambda df, rank: df.select(F.explode(F.sequence("first", "last")).alias("cp"), F.get("fields", F.lit(column)).alias("value"), rank.alias("rank"))
    every = rows.sparkSession.range(U.SIZE).select(F.col("id").cast("int").alias("cp"), F.lit(default).alias("value"), F.lit(-1).cast("long").alias("rank"))
    said = spread(missing, F.monotonically_increasing_id()).unionByName(spread(rows, F.lit((1 << 62)).cast("long"))).unionByName(every)
    best = said.groupBy("cp").agg(F.max_by("value", "rank").alias("value"))
    w = Window.partitionBy("value").orderBy("cp")
    return best.withColumn("island", F.col("cp") - F.row_number().over(w)).groupBy("value", "island").agg(F.min("cp").alias("first"), F.max("cp").alias("last")).select("first", "last", "value")


def dedup_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(record_id and properties of each distinct record, first, last and record_id of each range); numbered in the order of their first range."""
    props = [c for c in records.columns if c not in ("first", "last")]
    distinct = records.groupBy(*props).agg(F.min("first").alias("at"))
    distinct = distinct.withColumn("record_id", (F.row_number().over(Window.orderBy("at")) - 1).cast("int")).drop("at")
    same = [records[p].eqNullSafe(distinct[p]) for p in props]
    return distinct.select("record_id", *props), records.join(F.broadcast(distinct), same).select("first", "last", "record_id")


def write_tables(spark: SparkSession, path: str, props: list[str]) -> None:
    """The properties as Parquet tables under path: records, ranges and values."""
    records, ranges = dedup_records(ucd_records(spark, props))
    for name, df in (("records", records), ("ranges", ranges), ("values", ucd_values(spark).filter(F.col("property").isin(props)))):
        df.withColumn("ucd_version", F.lit(U.UCD_VERSION)).coalesce(1).write.mode("errorifexists").parquet(f"{path}/{name}")


def renumbered(old: DataFrame, new: DataFrame) -> DataFrame:
    """property, code, was, now: values (property, code, long_name) of `old` that `new` has under another code or lacks; empty if it only appends."""
    n = new.select("property", "code", F.col("long_name").alias("now"))
    return old.select("property", "code", F.col("long_name").alias("was")).join(n, ["property", "code"], "left").filter(~F.col("was").eqNullSafe(F.col("now")))
