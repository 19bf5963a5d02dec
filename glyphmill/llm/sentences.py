"""Substring dedup on sliding spans of sentences.

A sentence ends at a line end, and after a word that ends in . ! ? or …, with quotes or brackets
closed after it. A span is a run of consecutive sentences: it begins at each sentence and takes in
the next ones until it has `min_sentences` sentences and `min_words` words, or one sentence less
and `enough_words` words. A passage may have been put into the middle of a sentence; so spans
begin at words with a capital letter inside a sentence as well, with what is left of it as their
first sentence. All spans of all texts are hashed and met by hash; the first place of a repeated
span (smallest id, then place) stays, and what any other place of it covers is removed.

Case of A-Z and white space do not count in comparison. What stays: repeated passages without a
whole span, such as a single sentence, and a shorter tail of a passage after its last whole span.

Defined results: null and empty texts have no sentence; texts too short for a span lose
nothing; equal rows (same id and text) are treated alike, of equal texts under different ids
the smallest id keeps its own; a null id comes first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _powers, bloom, cut, hit, mix, slices, word_bounds, word_hashes

#: So many words are enough for a span of one sentence less.
ENOUGH = 50

_END = np.zeros(256, bool)
_END[list(b".!?")] = True
_CLOSE = np.zeros(256, bool)
_CLOSE[list(b"\"')]}")] = True
_BIG = np.zeros(256, bool)
_BIG[65:91] = True


def _ends(data: np.ndarray, head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Which words end a sentence by their last characters."""
    last = tail - 1
    for _ in range(3):  # closing quotes and brackets
        last = np.where(_CLOSE[data[last]] & (last > head), last - 1, last)
    # two closing quotes and the ellipsis have three bytes: E2 80 99, E2 80 9D and E2 80 A6
    three = (last - 2 >= head) & (data[np.maximum(last - 2, 0)] == 0xE2) & (data[np.maximum(last - 1, 0)] == 0x80)
    quote = three & ((data[last] == 0x99) | (data[last] == 0x9D)) & (last - 3 >= head)
    return _END[data[last]] | (three & (data[last] == 0xA6)) | (quote & _END[data[np.maximum(last - 3, 0)]])


def spans_of(data: np.ndarray, min_sentences: int, min_words: int, enough_words: int = ENOUGH):
    """Of one text: where its parts begin (bytes) and the sentence each is in; for each span its hash, first and last + 1 part.

    Parts are sentences, cut before words with a capital letter.
    """
    zero = np.zeros(1, np.int64)
    head, tail = word_bounds(data, zero)
    if not len(head):
        return (np.zeros(0, np.int64),) * 5
    lines = np.cumsum(data == 10)
    second = data[np.minimum(head + 1, len(data) - 1)]
    capital = _BIG[data[head]] | ((data[head] == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97))
    whole = np.append(True, _ends(data, head[:-1], tail[:-1]) | (lines[head[1:]] > lines[head[:-1]]))
    first = np.flatnonzero(whole | capital)  # first word of each part
    sentence = np.cumsum(whole)[first] - 1
    bound = np.append(np.flatnonzero(whole), len(head))  # first word of each sentence, and the end
    full = np.maximum(np.searchsorted(bound, first + min_words), sentence + min_sentences)
    stop = np.minimum(full, np.maximum(np.searchsorted(bound, first + enough_words), sentence + min_sentences - 1))
    start = np.flatnonzero(stop < len(bound))
    up, down = _powers(len(head) + 1)
    total = np.zeros(len(head) + 1, np.uint64)
    np.cumsum(word_hashes(data, zero)[0] * up[: len(head)], out=total[1:])
    a, b = first[start], bound[stop[start]]
    return head[first], sentence, mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64)).view(np.int64), start, np.searchsorted(first, b)


def dedup_sentences(docs: DataFrame, min_sentences: int = 3, min_words: int = 20, enough_words: int = ENOUGH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_sentences, n_removed (sentences that lose words), text (what is left)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("data"))
    rows = rows.withColumn("rid", F.xxhash64("doc_id", "data"))

    def hashes(batches):
        for batch in slices(batches):
            found = [spans_of(np.frombuffer(t.as_buffer(), np.uint8), min_sentences, min_words, enough_words)[2] for t in batch.column(0)]
            if found:
                h, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_pydict({"h": h, "n": n.astype(np.int64)})

    counted = cut(rows.select("data").mapInArrow(hashes, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h"))
    bits = 1 << min(27, max(16, (counted.count() * 12).bit_length()))
    known = docs.sparkSession.sparkContext.broadcast(bloom(counted, bits))

    def places(batches):
        keep = known.value
        for batch in batches:
            for d, rid, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                _, _, h, a, b = spans_of(np.frombuffer(t.as_buffer(), np.uint8), min_sentences, min_words, enough_words)
                at = np.flatnonzero(hit(keep, h, bits)) if len(h) else h
                if len(at):
                    yield pa.RecordBatch.from_pydict({"h": h[at], "d": pa.array([d] * len(at), pa.int64()), "rid": np.full(len(at), rid), "a": a[at].astype(np.int32), "b": b[at].astype(np.int32)})

    spots = cut(rows.select("doc_id", "rid", "data").mapInArrow(places, "h long, d long, rid long, a int, b int"))
    first = cut(spots.groupBy("h").agg(F.min(F.struct("d", "rid", "a")).alias("f"), F.max(F.struct("d", "rid", "a")).alias("l")).filter("f <> l").select("h", "f"))
    again = spots.join(first, "h").filter(~F.struct("d", "rid", "a").eqNullSafe(F.col("f"))).select("rid", "a", "b")
    cover = again.groupBy("rid").agg(F.collect_set(F.struct("a", "b")).alias("spans"))

    def cleaned(batches):
        for batch in slices(batches):
            total, gone, left = [], [], []
            for t, spans in zip(batch.column(1), batch.column(2).to_pylist()):
                raw = t.as_buffer()
                begin, sentence = spans_of(np.frombuffer(raw, np.uint8), min_sentences, min_words, enough_words)[:2]
                total.append(int(sentence[-1]) + 1 if len(begin) else 0)
                mark = np.zeros(len(begin) + 1, np.int64)
                for s in spans or ():
                    mark[s["a"]] += 1
                    mark[s["b"]] -= 1
                out = np.cumsum(mark)[:-1] > 0
                gone.append(len(np.unique(sentence[out])))
                if not out.any():
                    left.append(raw.to_pybytes())
                    continue
                edge = np.append(begin, raw.size)
                edge[0] = 0
                view = memoryview(raw)
                change = np.flatnonzero(np.append(True, out[1:] != out[:-1]))
                parts = [view[edge[i] : edge[j]] for i, j in zip(change, np.append(change[1:], len(out))) if not out[i]]
                left.append(b"".join(parts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(left, pa.binary())], ["doc_id", "n_sentences", "n_removed", "text"])

    joined = rows.join(cover, "rid", "left").select("doc_id", "data", "spans")
    return joined.mapInArrow(cleaned, "doc_id long, n_sentences long, n_removed long, text binary").withColumn("text", F.col("text").cast("string"))
