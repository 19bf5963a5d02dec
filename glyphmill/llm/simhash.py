"""SimHash near-dedup with covering tables: no pair within the radius is missed.

A text's fingerprint has a bit for each bit of the XXH64 hashes of its word shingles, repeats
included: 1 if over half of them have it. The tables are structured masks: each bit position i
gets a vector m(i) of radius + 1 bits, and table v (every such vector but zero) keeps the
positions whose m(i) has an odd product with v. Two fingerprints that differ in at most
`radius` positions set at most `radius` linear conditions on v, so some v other than zero is
left that keeps none of those positions: the pair has one key in that table.

Keys of up to FEW distinct fingerprints compare them with each other. In larger ones every
fingerprint is written at the centres around it, changed in the positions that its table leaves
out: two within the radius have a centre in common, and those at one centre are linked with the
smallest of them, so the work follows the rows and nothing is left out.

Defined results: null, empty and wordless texts have fingerprint zero, linked like any other; of
rows that repeat an id or a text each has its row; a null id counts only where a group has no
other; other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, drop, slices

RADIUS = 2
WORDS = 3
SEED = 42
#: Keys of up to so many fingerprints compare all of them.
FEW = 16
_CHUNK = 1 << 15


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """The fingerprint of one text as a signed long."""
    parts = (text or b"").lower().split()
    if not parts:
        return 0
    k = min(words, len(parts))
    shingles = zip(*[itertools.islice(parts, i, None) for i in range(k)])
    ones, hashed = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    while some := [hashed(b" ".join(s), SEED) for s in itertools.islice(shingles, _CHUNK)]:
        bits = np.unpackbits(np.array(some, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(parts) - k + 1, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp of every row."""

    def prints(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t, words) for t in b.column(1).to_pylist()], pa.int64())], names=["doc_id", "fp"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(prints, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks(radius: int = RADIUS) -> list[int]:
    """The positions that each table keeps, 2 ** (radius + 1) - 1 masks of 64 bits."""
    n = (1 << radius + 1) - 1
    return [sum(1 << i for i in range(64) if (1 + i % n & v).bit_count() % 2) for v in range(1, n + 1)]


def _changes(left_out: list[int], most: int) -> list[int]:
    """Every change of at most `most` of the positions, as the long to xor with."""
    return [_signed(sum(1 << i for i in some)) for n in range(most + 1) for some in itertools.combinations(left_out, n)]


def links(prints: DataFrame, radius: int = RADIUS, few: int = FEW) -> DataFrame:
    """Links (a, b) of distinct fingerprints (column fp) at most `radius` bits apart, enough to reach whatever such links reach."""
    if not 0 <= radius <= 4:
        raise ValueError("a radius of 0 to 4 bits is possible")
    kept = masks(radius)
    table = F.explode(F.array(*[F.struct(F.lit(v).alias("v"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for v, m in enumerate(kept)])).alias("t")
    keyed = prints.select("fp", table).select("fp", "t.v", "t.key")
    crowd = keyed.groupBy("v", "key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = cut(keyed.join(crowd, ["v", "key"]))
    x, y = (shared.filter(F.col("n") <= few).alias(n) for n in "xy")
    near = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= radius
    pairs = x.join(y, (F.col("x.v") == F.col("y.v")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & near)
    pairs = pairs.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    # a and b at most `radius` apart have a centre within radius // 2 of one and (radius + 1) // 2 of the other
    out = [[i for i in range(64) if not m >> i & 1] for m in kept]
    inner = [_changes(bits, radius // 2) for bits in out]
    outer = [[c for c in _changes(bits, (radius + 1) // 2) if c not in own] for bits, own in zip(out, map(set, inner))]
    at = lambda changes: F.get(F.array(*[F.array(*map(F.lit, c)).cast("array<long>") for c in changes]), F.col("v"))
    crowded = shared.filter(F.col("n") > few)
    spots = lambda changes, own: crowded.select("fp", F.lit(own).alias("own"), F.explode(at(changes)).alias("c")).withColumn("c", F.col("fp").bitwiseXOR(F.col("c")))
    around = spots(inner, True)
    if any(outer):
        around = around.unionByName(spots(outer, False))
    around = around.distinct()
    hub = around.groupBy("c").agg(F.min(F.when(F.col("own"), F.col("fp"))).alias("hub"), F.count("*").alias("n")).filter("n > 1 AND hub IS NOT NULL")
    met = around.join(hub, "c").filter("fp <> hub").select(F.greatest("fp", "hub").alias("a"), F.least("fp", "hub").alias("b"))
    return pairs.unionByName(met)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = WORDS, doc_id: str = "doc_id", text: str = "text", few: int = FEW) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id, the smallest id that links reach, of every row."""
    every = cut(fingerprints(docs, words, doc_id, text))
    each = cut(every.groupBy("fp").agg(F.min("doc_id").alias("least")))
    label = components(links(each.select("fp"), radius, few)).select(F.col("node").alias("fp"), "label")
    placed = cut(each.join(label, "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label")))
    drop(each)
    groups = placed.groupBy("label").agg(F.min("least").alias("component_id"))
    known = placed.join(groups, "label").select("fp", "component_id")
    return every.join(known, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
