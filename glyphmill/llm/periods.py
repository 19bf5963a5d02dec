"""Runs of repeated word sequences, found by recursive frequency splitting.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), at
least `least` words and two periods long, that no neighbouring word extends. Every word of a run
occurs in it twice or more. So words that occur once within a segment (first a whole text) belong
to no run: they split it, pieces shorter than `least` go, and the rest is counted anew within each
piece until nothing splits any more. All texts of a chunk are split together.

What survives is scanned by lags. A run of period q has a stretch of at least max(least - q, q)
words that equal the word q later, and such a stretch covers one whole window of about half that
size that begins at a multiple of its size. Lags with windows of one size are compared at once, by
hashes of windows, 2 x words comparisons for each doubling of the lag; lags that have an equal
window are then compared word by word. A window inside a run whose period divides the lag shows
that run again and is passed over.

Defined results: null, empty and wordless texts have no words and no runs, and an empty collapsed
text; rows that repeat are treated alike; a text is taken whole, however long; other columns are
ignored, whatever their names, or kept on demand; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, bind, mix, slices

LEAST = 12
#: Texts are split together in chunks of about so many bytes; a longer text is a chunk of its own.
CHUNK = 1 << 20
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def surviving(words: np.ndarray, owner: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """Segments (begin, end) of `words` that words occurring once in them no longer split; none crosses a change of `owner`."""
    done: list[tuple[int, int]] = []
    place, segment = np.arange(len(words)), owner.astype(np.int64)
    size = int(words.max(initial=0)) + 1
    while len(place):
        _, where, count = np.unique(segment * size + words[place], return_inverse=True, return_counts=True)
        stays = count[where] > 1
        split = np.zeros(int(segment[-1]) + 1, bool)
        split[segment[~stays]] = True
        whole = ~split[segment]
        heads = lambda p, s: np.flatnonzero(np.append(True, (np.diff(p) > 1) | (np.diff(s) > 0))) if len(p) else np.zeros(0, np.int64)
        at = heads(place[whole], segment[whole])
        ends = np.append(at[1:], np.count_nonzero(whole))
        done += [(int(place[whole][a]), int(place[whole][b - 1]) + 1) for a, b in zip(at, ends) if b - a >= least]
        open_ = stays & ~whole
        place, segment = place[open_], segment[open_]
        at = heads(place, segment)
        length = np.diff(np.append(at, len(place)))
        segment = np.repeat(np.arange(len(at)), length)
        long_ = np.repeat(length >= least, length)
        place, segment = place[long_], segment[long_]
        _, segment = np.unique(segment, return_inverse=True) if len(segment) else (None, segment)
    return sorted(done)


def lag_scan(w: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of one segment."""
    m = len(w)
    lags = np.arange(1, m // 2 + 1)
    need = np.maximum(least - lags, lags)
    size = 1 << np.floor(np.log2((need + 1) // 2)).astype(np.int64)
    found: list[tuple[int, int, int]] = []
    hashes = {1: mix(w.astype(np.uint64) + np.uint64(1))}
    candidates = []
    for s in np.unique(size).tolist():
        half = 1
        while s not in hashes:  # from the half-sized windows
            if 2 * half not in hashes:
                h = hashes[half]
                hashes[2 * half] = mix(h[: len(h) - half] * np.uint64(0x9E3779B97F4A7C15) + h[half:])
            half *= 2
        h, qs = hashes[s], lags[size == s]
        if not len(h):
            continue
        base = np.arange(0, len(h), s)
        for part in np.array_split(qs, max(1, len(qs) * len(base) >> 22)):  # a few million comparisons at once
            later = base[:, None] + part[None, :]
            same = (later < len(h)) & (h[base][:, None] == h[np.minimum(later, len(h) - 1)])
            b, q = np.nonzero(same)
            if len(b):
                candidates.append(np.stack([part[q], base[b], np.full(len(b), s)]))
    if not candidates:
        return []
    lag, at, wide = np.concatenate(candidates, axis=1)
    order = np.argsort(lag, kind="stable")
    lag, at, wide = lag[order], at[order], wide[order]
    values, first = np.unique(lag, return_index=True)
    for q, lo, hi in zip(values.tolist(), first.tolist(), np.append(first[1:], len(lag)).tolist()):
        known = [r for r in found if q % r[2] == 0]
        b, left = at[lo:hi], np.ones(hi - lo, bool)
        for start, length, _ in known:
            left &= (b < start) | (b + q + wide[lo:hi] > start + length)
        if not left.any():
            continue
        same = np.zeros(m - q + 2, np.int8)
        same[1:-1] = w[:-q] == w[q:]
        edges = np.flatnonzero(np.diff(same))
        for start, stop in zip(edges[::2].tolist(), edges[1::2].tolist()):
            length = stop - start + q
            if length >= max(least, 2 * q) and not any(r[0] <= start and start + length <= r[0] + r[1] for r in known):
                found.append((start, length, q))
    return found


def runs_of(texts: list[bytes | None], least: int = LEAST) -> list[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """The words of each text and its runs (start, length, period), by start, then period."""
    numbers: defaultdict = defaultdict()
    numbers.default_factory = numbers.__len__
    words = [(t or b"").split() for t in texts]
    flat = np.fromiter((numbers[x] for ws in words for x in ws), np.int64)
    sizes = np.array([len(ws) for ws in words], np.int64)
    begins = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    out = [(ws, []) for ws in words]
    for a, b in surviving(flat, owner, least):
        i = int(owner[a])
        out[i][1].extend((a - int(begins[i]) + start, length, period) for start, length, period in lag_scan(flat[a:b], least))
    for _, runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that lie in no run, or only in the first period of runs."""
    gone = np.zeros(len(words), bool)
    for start, length, period in runs:
        gone[start + period : start + length] = True
    return b" ".join(w for w, g in zip(words, gone.tolist()) if not g)


def periodic_runs(docs: DataFrame, least: int = LEAST, keep: tuple = (), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period of each, by start and period), and text with each run collapsed to its first period; then `keep` as keep_<name>."""
    if least < 2:
        raise ValueError("a run has two words or more")
    named = [F.col(f"`{c}`").alias(f"keep_{c}") for c in keep]
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").cast("binary").alias("text"), *named)

    def found(batches):
        for batch in slices(batches):
            texts, done = batch.column(1).to_pylist(), []
            lo = size = 0
            for i, t in enumerate(texts):
                size += len(t or b"")
                if size >= CHUNK or i + 1 == len(texts):
                    done += [(len(ws), [dict(zip(("start", "length", "period"), r)) for r in runs], _collapsed(ws, runs) if runs else b" ".join(ws)) for ws, runs in runs_of(texts[lo : i + 1], least)]
                    lo, size = i + 1, 0
            n, runs, left = zip(*done) if done else ((), (), ())
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array(left, pa.binary()).cast(pa.string()), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "runs", "text", *batch.schema.names[2:]])

    kept = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
    return rows.mapInArrow(found, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, text string" + kept)


def planted(text: Column, doc_id: Column) -> Column:
    """The text with its words from number a on replaced by a cycle of p of them, where crc32 of the id is a multiple of ten; else as it is."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def cycle(words: Column) -> Column:
        n = F.size(words).cast("long")

        def at(a: Column) -> Column:
            p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
            return bind(p, lambda p: F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int")))), " "))

        return F.when(n > 0, bind(g % n, at)).otherwise(text)

    return F.when(h % 10 == 0, bind(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), cycle)).otherwise(text)
