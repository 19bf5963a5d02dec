"""Suffix-array dedup: remove every byte that a repeated 400-byte string covers, exactly.

1. Anchors. In each string of `least` bytes the leftmost smallest hash of a 64-byte gram is its
   anchor, a function of the string alone; so equal strings have equal anchors. A text falls
   into runs of strings with the same anchor; the bytes of a run are its context.
2. Anchor hashes are counted over all texts. Only contexts with a repeated anchor go on (a
   Bloom filter of fixed size lets a few others through, which does no harm).
3. Contexts are dealt out by anchor hash; so equal strings meet. Each block gets the
   Burrows-Wheeler transform of its distinct contexts, and bounded interval expansion
   (`bwt.long_matches`) marks the strings that occur twice.
4. An anchor with more than `HOT` distinct contexts would overfill a block: its contexts are counted
   with partial sums, the strings of those that do not repeat as a whole are looked for one by
   one by their own hash among all strings of the anchor, and give the same marks.
5. Marks go back to their texts as intervals; what they cover is cut out.

Defined results: null is the empty text; texts shorter than `least` bytes lose nothing; equal
texts lose everything, as each has its strings in the other; repeated ids are separate rows.

Texts are told apart by MD5; contexts by the 64-bit hash of their bytes and that of their anchor,
which both would have to agree by chance for a string to go that occurs once.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bwt import long_matches
from .common import _powers, bloom, cut, hit, mix, slices

GRAM = 64
HOT = 4096
BLOCK = 1_500_000


def _prefix(data: np.ndarray) -> np.ndarray:
    up, _ = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return total


def _rolled(total: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` bytes from each position."""
    _, down = _powers(len(total))
    n = len(total) - size
    return mix((total[size:] - total[:-size]) * down[:n])


def _leftmost_min(x: np.ndarray, w: int) -> np.ndarray:
    """For each window of w values the position of its leftmost smallest one; ties by position."""
    n = len(x)
    blocks = -(-n // w)
    full = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = x
    grid = full.reshape(blocks, w)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.arange(n - w + 1)
    low = np.minimum(right[starts], left[starts + w - 1])
    # the leftmost place of the value low at or after each start: places of each value in order
    out = np.empty(len(starts), np.int64)
    change = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
    stop = np.append(change[1:], len(starts))
    for a, b in zip(change, stop):  # a run for each anchor, about 2 / w of the positions
        here = np.flatnonzero(x[a : b - 1 + w] == low[a]) + a
        out[a:b] = here[0] if len(here) == 1 else here[np.searchsorted(here, starts[a:b])]
    return out


def runs(data: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first string, one after the last string of each run, and the prefix sums."""
    total = _prefix(data)
    grams = _rolled(total, GRAM)
    spot = _leftmost_min(grams, least - GRAM + 1)
    begin = np.flatnonzero(np.append(True, spot[1:] != spot[:-1]))
    return grams[spot[begin]].view(np.int64), begin, np.append(begin[1:], len(spot)), total


def _texts(batch: pa.RecordBatch):
    """(uid, bytes) of each distinct text of the batch and how often it is there."""
    seen: dict[int, list] = {}
    for uid, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        if uid in seen:
            seen[uid][1] += 1
        else:
            seen[uid] = [np.frombuffer(text.as_buffer(), np.uint8), 1]
    return seen


def _uid(data: str):
    return F.unhex(F.md5(data))


def repeated_spans(docs: DataFrame, least: int = 400, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """uid, spans: for each distinct text (uid: its MD5) the merged byte ranges to remove, as pairs of int32."""
    spark = docs.sparkSession
    texts = docs.select(_uid("data").alias("uid"), "data").filter(F.octet_length("data") >= least)

    def anchors(batches):
        for batch in slices(batches):
            hs, ns = [], []
            for data, times in _texts(batch).values():
                h = runs(data, least)[0]
                hs.append(h)
                ns.append(np.full(len(h), times))
            if hs:
                h, inv = np.unique(np.concatenate(hs), return_inverse=True)
                yield pa.RecordBatch.from_pydict({"h": h, "n": np.bincount(inv, np.concatenate(ns)).astype(np.int64)})

    counted = cut(texts.mapInArrow(anchors, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1"))
    n_kept, places = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = 1 << min(27, max(16, int(n_kept * 12).bit_length()))
    many = spark.sparkContext.broadcast((bloom(counted, bits), bloom(counted.filter(F.col("n") > hot), 1 << 16)))
    n_buckets = max(12, places * (least + 170) // block + 1)

    def contexts(batches):
        keep, often = many.value
        for batch in slices(batches, 2000):
            ctx: dict[tuple, list] = {}
            rows = {c: [] for c in ("bucket", "h", "c", "n", "data", "uid", "a")}

            def put(bucket, h, c, n, data, uid, a):
                for k, v in zip(rows, (bucket, h, c, n, data, uid, a)):
                    rows[k].append(v)

            for uid, (data, times) in _texts(batch).items():
                h, begin, stop, total = runs(data, least)
                inside = np.flatnonzero(hit(keep, h, bits))
                if not len(inside):
                    continue
                is_hot = hit(often, h[inside], 1 << 16)
                _, down = _powers(len(total))
                b, e = begin[inside], stop[inside] + least - 1
                whole = mix((total[e] - total[b]) * down[b] + (e - b).astype(np.uint64)).view(np.int64)
                for x, y, hh, cc, hot_one in zip(b.tolist(), e.tolist(), h[inside].tolist(), whole.tolist(), is_hot.tolist()):
                    put(-2, hh, cc, 0, None, uid, x)
                    if (hh, cc) in ctx:
                        ctx[hh, cc][1] += times
                    else:
                        ctx[hh, cc] = [data[x:y], times, hot_one]
            for (hh, cc), (data, n, hot_one) in ctx.items():
                put(-1 if hot_one else (hh >> 8) % n_buckets, hh, cc, n, data.tobytes(), None, 0)
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(rows["bucket"], pa.int64()), "h": pa.array(rows["h"], pa.int64()), "c": pa.array(rows["c"], pa.int64()), "n": pa.array(rows["n"], pa.int64()), "data": pa.array(rows["data"], pa.binary()), "uid": pa.array(rows["uid"], pa.binary()), "a": pa.array(rows["a"], pa.int64())})

    schema = "bucket long, h long, c long, n long, data binary, uid binary, a long"
    found = cut(texts.mapInArrow(contexts, schema))

    def marked(key, table):
        seen: dict[tuple, list] = {}
        for h, c, n, data in zip(*(table.column(x).to_pylist() for x in ("h", "c", "n", "data"))):
            if (h, c) in seen:
                seen[h, c][1] += n
            else:
                seen[h, c] = [data, n]
        many_of: dict[int, int] = {}
        for h, _ in seen:
            many_of[h] = many_of.get(h, 0) + 1
        out_h, out_c, spans = [], [], []
        mixed = [k for k in sorted(seen) if many_of[k[0]] > 1]
        mark = np.zeros(0, bool)
        if mixed:
            sizes = [len(seen[k][0]) for k in mixed]
            joined = np.zeros(sum(sizes) + len(sizes), np.int16)
            at = 0
            for k, size in zip(mixed, sizes):
                joined[at : at + size] = np.frombuffer(seen[k][0], np.uint8).astype(np.int16) + 1
                at += size + 1
            mark = long_matches(joined, least)
        at = 0
        for k in sorted(seen):
            data, n = seen[k]
            strings = len(data) - least + 1
            if many_of[k[0]] > 1:
                m = mark[at : at + strings] | (n > 1)
                at += len(data) + 1
            elif n > 1:
                m = np.ones(strings, bool)
            else:
                # one context may still repeat a string in itself: only where its anchor repeats, then it is two runs
                continue
            if m.any():
                out_h.append(k[0])
                out_c.append(k[1])
                spans.append(_ranges(m, least).tobytes())
        return pa.table({"h": pa.array(out_h, pa.int64()), "c": pa.array(out_c, pa.int64()), "spans": pa.array(spans, pa.binary())})

    # -- anchors in many places: their distinct contexts, of which a block holds few enough or not
    often_seen = cut(found.filter("bucket = -1").groupBy("h", "c").agg(F.sum("n").alias("n"), F.first("data").alias("data")))
    crowded = often_seen.groupBy("h").agg(F.count("*").alias("m")).filter(F.col("m") > hot).select("h")
    few = often_seen.join(crowded, "h", "left_anti").select(F.pmod(F.shiftright("h", 8), F.lit(n_buckets)).alias("bucket"), "h", "c", "n", "data")
    often_seen = often_seen.join(crowded, "h", "left_semi")
    held = found.filter("bucket >= 0").select("bucket", "h", "c", "n", "data").union(few)
    marks = held.groupBy("bucket").applyInArrow(marked, "h long, c long, spans binary")

    # -- the others string by string; a context that repeats is marked as a whole
    def strings(batches):
        for b in batches:
            for h, c, n, data in zip(*(b.column(i).to_pylist() for i in range(4))):
                s = _rolled(_prefix(np.frombuffer(data, np.uint8)), least).view(np.int64)
                yield pa.RecordBatch.from_pydict({"s": s, "h": np.full(len(s), h), "c": np.full(len(s), c), "p": np.arange(len(s)), "n": np.full(len(s), n)})

    def ranges(batches):
        for b in batches:
            spans = []
            for n, size, at in zip(*(b.column(i).to_pylist() for i in (2, 3, 4))):
                spans.append((np.array([[0, size]], np.int32) if n > 1 else _ranges_at(np.sort(np.array(at)), least)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spans, pa.binary())], ["h", "c", "spans"])

    each = "s long, h long, c long, p long, n long"
    twice = often_seen.mapInArrow(strings, each).groupBy("h", "s").agg(F.sum("n").alias("t")).filter("t > 1").select("h", "s")
    some = (
        often_seen.filter("n = 1").mapInArrow(strings, each).join(cut(twice), ["h", "s"], "left_semi")
        .groupBy("h", "c").agg(F.collect_list("p").alias("at"))  # as many as a run has strings
        .select("h", "c", F.lit(1).cast("long").alias("n"), F.lit(0).alias("size"), "at")
    )
    every_string = often_seen.filter("n > 1").select("h", "c", "n", F.octet_length("data").alias("size"), F.array().cast("array<long>").alias("at"))
    marks = marks.unionByName(some.union(every_string).mapInArrow(ranges, "h long, c long, spans binary"))
    every = found.filter("bucket = -2").select("h", "c", "uid", "a").distinct().join(cut(marks), ["h", "c"]).select("uid", "a", "spans")

    def merged(key, table):
        parts = [np.frombuffer(s, np.int32).reshape(-1, 2).astype(np.int64) + a for s, a in zip(table.column("spans").to_pylist(), table.column("a").to_pylist())]
        x = np.concatenate(parts)
        x = x[np.argsort(x[:, 0], kind="stable")]
        top = np.maximum.accumulate(x[:, 1])
        new = np.append(True, x[1:, 0] > top[:-1])
        lo = x[new, 0]
        hi = top[np.append(np.flatnonzero(new)[1:], len(x)) - 1]
        return pa.table({"uid": pa.array([key[0].as_py()], pa.binary()), "spans": pa.array([np.stack([lo, hi], 1).astype(np.int32).tobytes()], pa.binary())})

    return every.groupBy("uid").applyInArrow(merged, "uid binary, spans binary")


def _ranges(mark: np.ndarray, least: int) -> np.ndarray:
    """Byte ranges that the marked strings cover."""
    return _ranges_at(np.flatnonzero(mark), least)


def _ranges_at(at: np.ndarray, least: int) -> np.ndarray:
    """Byte ranges that the strings at these places, in order, cover."""
    new = np.append(True, at[1:] > at[:-1] + least)
    lo = at[new]
    hi = at[np.append(np.flatnonzero(new)[1:], len(at)) - 1] + least
    return np.stack([lo, hi], 1).astype(np.int32)


def dedup_substrings(docs: DataFrame, least: int = 400, doc_id: str = "doc_id", text: str = "text", hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, spans (array of start, stop), kept (the bytes left)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("data"))
    spans = repeated_spans(rows, least, hot, block)

    def cleaned(batches):
        for b in slices(batches):
            n, runs_, kept = [], [], []
            for data, s in zip(b.column(1), b.column(2).to_pylist()):
                raw = data.as_buffer()
                n.append(raw.size)
                x = np.frombuffer(s, np.int32).reshape(-1, 2) if s else np.zeros((0, 2), np.int32)
                runs_.append([{"start": int(p), "stop": int(q)} for p, q in x])
                view, at, parts = memoryview(raw), 0, []
                for p, q in x:
                    parts.append(view[at:p])
                    at = q
                kept.append(b"".join([*parts, view[at:]]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(runs_, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "spans", "kept"],
            )

    joined = rows.withColumn("uid", _uid("data")).join(spans, "uid", "left").select("doc_id", "data", "spans")
    return joined.mapInArrow(cleaned, "doc_id long, n_bytes long, spans array<struct<start:int,stop:int>>, kept binary")
