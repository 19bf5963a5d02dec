"""The database's published text files as a Spark data source, and the loaders of what they hold.

    spark.dataSource.register(CharacterFiles)
    spark.read.format("character_file").option("path", "…/Scripts.txt").load()

Rows are first, last, fields, line, file; `kind` missing gives the @missing lines, which state defaults, instead.
Ranges written as a pair of First and Last lines are one row. Conditions on first and last are handed to the reader.
"""

from __future__ import annotations

import glob
import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "first int, last int, fields array<string>, line int, file string"
#: Bytes of a partition.
SPLIT = 1 << 18


class _Part(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


def _span(text: str) -> tuple[int, int]:
    a, _, b = text.partition("..")
    return int(a, 16), int(b or a, 16)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        path = options.get("path")
        if not path:
            raise ValueError("path has to name a file, a folder or a pattern")
        self.paths = sorted(p for x in glob.glob(path) or [path] for p in (glob.glob(f"{x}/*.txt") if os.path.isdir(x) else [x]))
        self.missing = options.get("kind", "rows") == "missing"
        self.split = int(options.get("splitbytes", options.get("splitBytes", SPLIT)))
        self.least, self.most = {"first": 0, "last": 0}, {"first": 0x10FFFF, "last": 0x10FFFF}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on first and last are kept to; everything else goes back to Spark."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name not in self.least or not isinstance(getattr(f, "value", None), int):
                yield f
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.least[name] = max(self.least[name], f.value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                self.most[name] = min(self.most[name], f.value - isinstance(f, LessThan))
            elif isinstance(f, EqualTo):
                self.least[name], self.most[name] = max(self.least[name], f.value), min(self.most[name], f.value)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        out = []
        for p in self.paths:
            size = os.path.getsize(p)
            out += [_Part(p, at, min(at + self.split, size)) for at in range(0, max(size, 1), self.split)]
        return out

    def _lines(self, part: _Part) -> Iterator[tuple[int, str]]:
        """Lines that begin within the part, and one more for a range that its last line opens."""
        with open(part.path, "rb") as f:
            f.seek(max(0, part.start - 1))
            if part.start:
                f.readline()  # belongs to the part before, unless it ends there
            at = f.tell()
            opens = False
            while at < part.stop or opens:
                line = f.readline()
                if not line:
                    break
                opens = at < part.stop and b", First>" in line
                yield at, line.decode("utf-8", "replace")
                at = f.tell()

    def read(self, part: _Part):
        first = None
        for at, line in self._lines(part):
            if self.missing:
                said = re.match(r"#\s*@missing:\s*(.*)", line)
                body = said[1] if said else ""
            else:
                body = line.partition("#")[0]
            fields = [x.strip() for x in body.strip().split(";")]
            if not re.fullmatch(r"[0-9A-Fa-f]{4,6}(\.\.[0-9A-Fa-f]{4,6})?", fields[0]):
                continue
            a, b = _span(fields[0])
            if len(fields) > 1 and fields[1].endswith(", First>"):
                first = a
                continue
            if len(fields) > 1 and fields[1].endswith(", Last>"):
                if first is None:
                    continue  # its first line, in the part before, gives the row
                a, first = first, None
                fields[1] = fields[1].replace(", Last>", ">")
            elif at >= part.stop:
                continue
            if self.least["first"] <= a <= self.most["first"] and self.least["last"] <= b <= self.most["last"]:
                yield a, b, fields[1:], at, os.path.basename(part.path)


class CharacterFiles(DataSource):
    """Semicolon-separated database files: a path, folder or pattern that every executor can open."""

    @classmethod
    def name(cls) -> str:
        return "character_file"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def load(spark: SparkSession, path: str, kind: str = "rows") -> DataFrame:
    """The lines of a file; kind: rows or missing."""
    from ..shipping import ship

    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CharacterFiles)
    return spark.read.format("character_file").option("path", path).option("kind", kind).load()


def _field(i: int):
    return F.nullif(F.get("fields", F.lit(i)), F.lit(""))


def _cp(column):
    return F.conv(column, 16, 10).cast("int")


def _sequence(column):
    return F.transform(F.split(column, " +"), lambda x: F.conv(x, 16, 10).cast("int"))


def read_characters(spark: SparkSession, path: str) -> DataFrame:
    """first, last, name, category, combining_class, bidi_class, decomposition_type, decomposition, mirrored, upper, lower, title of the main character file."""
    typed = F.regexp_extract(_field(4), "^<(.*)>", 1)
    mapping = F.trim(F.regexp_replace(_field(4), "^<.*>", ""))
    return load(spark, path).select(
        "first", "last", _field(0).alias("name"), _field(1).alias("category"), _field(2).cast("int").alias("combining_class"), _field(3).alias("bidi_class"),
        F.when(_field(4).isNull(), None).when(typed == "", "canonical").otherwise(typed).alias("decomposition_type"), _sequence(mapping).alias("decomposition"), (_field(8) == "Y").alias("mirrored"),
        _cp(_field(11)).alias("upper"), _cp(_field(12)).alias("lower"), F.coalesce(_cp(_field(13)), _cp(_field(11))).alias("title"),
    )


def decompositions(characters: DataFrame, compatible: bool = False) -> DataFrame:
    """cp, decomposition: full decompositions, the mappings applied until nothing changes; each round joins the mapped codepoints once more."""
    one = characters.filter("decomposition IS NOT NULL" + ("" if compatible else " AND decomposition_type = 'canonical'")).select(F.col("first").alias("cp"), "decomposition")
    step = one.select(F.col("cp").alias("of"), F.col("decomposition").alias("to"))
    now = one
    while True:
        parts = now.select("cp", F.posexplode("decomposition").alias("i", "c"))
        new = parts.join(step, parts["c"] == step["of"], "left").select("cp", "i", F.coalesce("to", F.array("c")).alias("to"), F.col("of").isNotNull().alias("mapped"))
        if new.filter("mapped").isEmpty():
            return now
        now = new.groupBy("cp").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("i", "to"))), lambda p: p["to"])).alias("decomposition"))


def read_special_cases(spark: SparkSession, path: str) -> DataFrame:
    """cp, lower, title, upper (codepoints), conditions (none: null) of the file of special cases."""
    return load(spark, path).select(F.col("first").alias("cp"), _sequence(_field(0)).alias("lower"), _sequence(_field(1)).alias("title"), _sequence(_field(2)).alias("upper"), F.split(_field(3), " +").alias("conditions"))


def read_foldings(spark: SparkSession, path: str) -> DataFrame:
    """cp, status (C, F, S, T), folding of the file of case foldings."""
    return load(spark, path).select(F.col("first").alias("cp"), _field(0).alias("status"), _sequence(_field(1)).alias("folding"))


def read_mirrors(spark: SparkSession, path: str) -> DataFrame:
    """cp, mirror of the file of mirrored pairs."""
    return load(spark, path).select(F.col("first").alias("cp"), _cp(_field(0)).alias("mirror"))


def read_brackets(spark: SparkSession, path: str) -> DataFrame:
    """cp, bracket, opens of the file of paired brackets."""
    return load(spark, path).filter(_field(1).isin("o", "c")).select(F.col("first").alias("cp"), _cp(_field(0)).alias("bracket"), (_field(1) == "o").alias("opens"))


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """first, last, value of the file of blocks, with underscores for spaces."""
    return load(spark, path).select("first", "last", F.regexp_replace(_field(0), "[ -]", "_").alias("value"))


def read_numerics(spark: SparkSession, path: str) -> DataFrame:
    """first, last, num, den of the file of derived numeric values, whose third field is a fraction."""
    parts = F.split(_field(2), "/")
    return load(spark, path).select("first", "last", F.get(parts, F.lit(0)).cast("long").alias("num"), F.coalesce(F.get(parts, F.lit(1)).cast("long"), F.lit(1).cast("long")).alias("den"))


def read_script_extensions(spark: SparkSession, path: str) -> DataFrame:
    """first, last, scripts of the file of script extensions."""
    return load(spark, path).select("first", "last", F.split(_field(0), " +").alias("scripts"))


def read_name_aliases(spark: SparkSession, path: str) -> DataFrame:
    """cp, i, alias, kind of the file of name aliases, numbered within each codepoint in the file's order."""
    from pyspark.sql import Window

    order = Window.partitionBy("first").orderBy("line")
    return load(spark, path).select(F.col("first").alias("cp"), (F.row_number().over(order) - 1).alias("i"), _field(0).alias("alias"), _field(1).alias("kind"))
