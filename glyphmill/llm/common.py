"""Shared pieces: lineage cuts in the shared folder, connected components, byte-level shingles."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: The byte class of a word, as the contracts state it.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only a session of one machine may leave it unset and gets a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not re.fullmatch(r"local(\[[\d*, ]+\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    return (found or f"file://{tempfile.gettempdir()}/checkpoints").rstrip("/")


def cut(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends in replicated files.

    The files go when the application ends, or with `drop`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    fs, at = _file_of(spark, path)
    fs.deleteOnExit(at)
    # nothing refers to the shuffles of this write any more, once Python has let go of its handles; the driver's collector tells Spark's cleaner to delete their files now
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def _file_of(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def drop(*written: DataFrame) -> None:
    """Delete the files of tables from `cut` that nothing will read again."""
    for df in written:
        fs, at = _file_of(df.sparkSession, df.cut_path)
        fs.delete(at, True)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) for every node of edges (a, b longs): label is the smallest node it reaches.

    Alternating large and small stars; each half step is a grouped minimum, pre-aggregated
    before its shuffle and written, so that adaptive execution may split the join where a hub is hot.
    """
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for k in range(rounds):
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m")))
        large = both.join(least, F.col("a") == F.col("k")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        small = large.join(low, F.col("a") == F.col("k"))
        seen = Observation(f"components {uuid.uuid4().hex}")
        after = cut(
            small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.*")
            .filter("a <> b")
            .distinct()
            .observe(seen, F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x"))
        )
        drop(now, least)
        now, state = after, (seen.get["n"], seen.get["x"])
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    labels = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.union(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def kept_names(keep: tuple, taken: tuple) -> list[tuple[str, str]]:
    """Each column of `keep` and its name in a result with the columns `taken`: those it clashes with become keep_<name>, the id's own is left out."""
    used = {c.lower() for c in taken}
    return [(c, f"keep_{c}" if c.lower() in used else c) for c in keep if c != taken[0]]


def bind(value, f):
    """f(value) as a column expression in which `value` is evaluated once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def hit(table: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    """Which keys may be in a Bloom filter of `bits` bits."""
    p, q = _spots(keys, bits)
    return ((table[p >> 6] >> (p & 63)) & 1 == 1) & ((table[q >> 6] >> (q & 63)) & 1 == 1)


def _spots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    u = h.view(np.uint64)
    return (mix(u) % np.uint64(bits)).astype(np.int64), (mix(u ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(bits)).astype(np.int64)


def bloom(hashes: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of `bits` bits of the long column h; words of it come to the driver, never the hashes."""

    def spots(batches):
        for b in batches:
            p, q = _spots(np.asarray(b.column(0)), bits)
            w = np.unique(np.concatenate([p, q]))
            yield pa.RecordBatch.from_pydict({"w": w >> 6, "v": np.int64(1) << (w & 63)})

    rows = hashes.select("h").mapInArrow(spots, "w long, v long").groupBy("w").agg(F.bit_or("v").alias("v"))
    out = np.zeros(bits // 64, np.int64)
    for b in rows.toLocalIterator():
        out[b.w] = b.v
    return out


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, so that what a worker holds beside them stays small."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


# ---- byte-level words and shingles -------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 19)
        for key, base in (("up", _R), ("down", _R_INV)):
            table = np.empty(size, np.uint64)
            table[0] = 1
            step, factor = 1, base
            while step < size:
                m = min(step, size - step)
                table[step : step + m] = table[:m] * np.uint64(factor)
                step, factor = step * 2, factor * factor & (1 << 64) - 1
            _POWERS[key] = table
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; wraps."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_bounds(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words in `data` begin and end; texts begin at `starts`, and no word crosses one."""
    space = _SPACE[data]
    gap = np.ones(len(data) + 1, bool)  # gap[i]: a word may begin at i or end before it
    gap[1:-1] = space[:-1] | space[1:]
    gap[starts] = True
    return np.flatnonzero(gap[:-1] & ~space), np.flatnonzero(gap[1:] & ~space) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in `data` (A-Z folded) and the text each lies in; texts begin at `starts`."""
    head, tail = word_bounds(data, starts)
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_FOLD[data].astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[tail] - total[head]) * down[head] + (tail - head).astype(np.uint64)), np.searchsorted(starts, head, "right") - 1


_MULT = [np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) | 1) for k in range(8)]


def shingle_sets(texts: pa.Array, k: int = 5, chunk: int = 1 << 18):
    """Yield, for each text, the sorted distinct 64-bit hashes of its k-word shingles.

    Fewer words: the whole sequence as one shingle; null or no word: empty. Works on chunks of
    about `chunk` bytes; a longer text is a chunk of its own.
    """
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    n = len(texts)
    if not n:
        return
    _, off, raw = texts.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, texts.offset * 8)
    raw = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    valid = np.ones(n, bool) if not texts.null_count else np.asarray(texts.is_valid())
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + chunk, "right")) - 1)
        to = min(to, n)
        base = offsets[at]
        data, starts = raw[base : offsets[to]], offsets[at:to] - base
        if not len(data):
            for _ in range(at, to):
                yield np.zeros(0, np.uint64)
            at = to
            continue
        filled = np.flatnonzero(np.diff(np.append(starts, len(data))) > 0)
        hashes, inside = word_hashes(data, starts[filled])
        owner = filled[inside]
        first = np.searchsorted(owner, np.arange(to - at + 1))
        if len(hashes) >= k:
            joined = sum(hashes[i : len(hashes) - k + 1 + i] * _MULT[i] for i in range(k))
            joined = mix(joined)
        else:
            joined = np.zeros(0, np.uint64)
        for d in range(to - at):
            lo, hi = first[d], first[d + 1]
            if hi == lo or not valid[at + d]:
                yield np.zeros(0, np.uint64)
            elif hi - lo < k:
                acc = np.uint64(hi - lo)
                with np.errstate(over="ignore"):
                    for h, m in zip(hashes[lo:hi], _MULT):
                        acc = acc * np.uint64(_R) + h * m
                yield mix(np.array([acc]))
            else:
                yield np.unique(joined[lo : hi - k + 1])
        at = to
