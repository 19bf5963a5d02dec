"""Alignment of two tokenizers' tokens, counted by external spills.

Each text is cut at the byte offsets where tokens of both end; the tokens that end there are linked.
How often each pair of ids is linked in the whole corpus says how good a link is:

1. Tasks encode their texts and write pair-document records as runs: split by radix (the second
   id modulo RADIX), sorted with the second tokenizer's id as the major key, compressed with zstd.
   A run has two parts, its pairs with their totals, and the documents of each pair.
2. The runs of a radix and of a span of SPAN input partitions meet in one task, where a k-way heap
   merge of their first parts counts each pair; the counts of spans are summed by Spark. A hot pair
   costs a task no more than one entry a run.
3. In the order of the second id a pass over a radix's counts gives the largest count of each id; the
   same pass looks up the pairs of every run and streams what they contribute back, a row for each
   document and radix. Spark adds these rows up.

What a task holds is bounded by SPAN input partitions and by the vocabularies, not by the corpus.

Defined results: null and empty texts, and those whose tokens do not give the bytes of a space and
the text, have no tokens: zeros and an empty digest. Rows that repeat each count; a null id is an id
like others; other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import json
import os

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices

FIRST = "/opt/tokenizers/byte_bpe_50k.json"
SECOND = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: More than any id of the first tokenizer: a pair is second id * WIDE + first id.
WIDE = 1 << 20
#: Parts that ids of the second tokenizer are dealt to.
RADIX = 16
#: Input partitions whose runs are merged together.
SPAN = 8
#: A task writes a run at the latest after so many records.
RECORDS = 1 << 20
#: Below it letters, digits and white space are what they were when the vocabulary was made.
LATIN = 0x250
# -- fixed value: how a byte-level vocabulary splits texts into words
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class First:
    """A byte-level vocabulary file.

    Where its merges come in the order of its ids, ids are ranks, and a rank encoder gives the same tokens in less than half
    the time; texts with characters from LATIN on, of which encoders may know other classes, are left to the file's own.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        # each byte has a printable character: its own, or the next of those from 256 on
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        char = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in own)}
        byte = {c: b for b, c in char.items()}
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocabulary, merges = file["model"]["vocab"], file["model"]["merges"]
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        names = {i: t for t, i in (vocabulary | special).items()}
        self.table = [t.encode() if t in special else bytes(byte[c] for c in t) for t in (names.get(i, "") for i in range(max(names) + 1))]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in merges)
        in_order = all(vocabulary["".join(m)] == 256 + i for i, m in enumerate(pairs)) and len(vocabulary) == 256 + len(merges) + sum(t in vocabulary for t in special)
        plain = file["normalizer"] is None and file["pre_tokenizer"]["type"] == "ByteLevel" and not file["pre_tokenizer"]["add_prefix_space"]
        ranks = {self.table[i]: i for t, i in vocabulary.items() if t not in special}
        self.ranked = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}) if in_order and plain else None

    def __call__(self, texts: list[str]) -> list[np.ndarray | None]:
        """The ids of a space and each text, or None where their bytes differ from it."""
        out: list[np.ndarray | None] = []
        for t in texts:
            t = f" {t}"
            if self.ranked and (t.isascii() or max(t) < chr(LATIN)):
                ids = self.ranked.encode_ordinary(t)
            else:
                ids = self.whole.encode(t, add_special_tokens=False).ids
            out.append(_ids(ids, self.table, t))
        return out


class Second:
    """A piece vocabulary file, whose encoder adds the space itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.whole = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.whole.id_to_piece(i) for i in range(self.whole.get_piece_size())]
        silent = lambda i: self.whole.is_control(i) or self.whole.is_unknown(i)
        self.table = [bytes([int(t[3:5], 16)]) if self.whole.is_byte(i) else b"" if silent(i) else t.replace(MARK, " ").encode() for i, t in enumerate(names)]

    def __call__(self, texts: list[str]) -> list[np.ndarray | None]:
        return [_ids(ids, self.table, f" {t}") for ids, t in zip(self.whole.encode(texts, num_threads=1), texts)]


def _ids(ids: list[int], table: list[bytes], text: str) -> np.ndarray | None:
    """The ids, if their bytes are the text's."""
    return np.array(ids, np.int64) if b"".join(map(table.__getitem__, ids)) == text.encode() else None


_LOADED: dict[tuple[str, str], tuple] = {}


def _loaded(first: str, second: str) -> tuple:
    """Both encoders, and the bytes of each id, once for each worker."""
    if (first, second) not in _LOADED:
        a, b = First(first), Second(second)
        _LOADED[first, second] = a, b, np.array([len(x) for x in a.table]), np.array([len(x) for x in b.table])
    return _LOADED[first, second]


_NONE = np.zeros(0, np.int64)


def encoded(texts: list[str | None], first: str = FIRST, second: str = SECOND) -> list[tuple[np.ndarray, np.ndarray]]:
    """The ids of both for each text; none where a text is null or empty, or tokens do not give its bytes."""
    a, b, *_ = _loaded(first, second)
    some = [i for i, t in enumerate(texts) if t and MARK not in t]
    out = [(_NONE, _NONE)] * len(texts)
    chosen = [texts[i] for i in some]
    for i, x, y in zip(some, a(chosen), b(chosen)):
        if x is not None and y is not None:
            out[i] = x, y
    return out


def _met(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in both of equal ends; ends rise strictly, since each token has a byte."""
    at = np.searchsorted(ends_b, ends_a)
    same = ends_b[np.minimum(at, len(ends_b) - 1)] == ends_a if len(ends_b) else np.zeros(len(ends_a), bool)
    return np.flatnonzero(same), at[same]


@functools.cache
def _written_ids(n: int) -> list[str]:
    """Each id below n before a comma, then each before a bar, then each before a semicolon."""
    return [f"{i}{mark}" for mark in ",|;" for i in range(n)]


def groups_text(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> str:
    """a1,a2|b1;a3|b2,b3: the groups between offsets where both end; i and j are the places of the tokens that end there."""
    n = 1 << max(int(x.max(initial=0)), int(y.max(initial=0))).bit_length()
    wide_x, wide_y = np.diff(i, prepend=-1), np.diff(j, prepend=-1)
    codes = np.empty(len(x) + len(y), np.int64)
    # a token comes after all of the groups before, and a second one after the first ones of its group too
    marked = x.copy()
    marked[i] += n
    codes[np.arange(len(x)) + np.repeat(j - wide_y + 1, wide_x)] = marked
    marked = y.copy()
    marked[j] += 2 * n
    codes[np.arange(len(y)) + np.repeat(i + 1, wide_y)] = marked
    return "".join(map(_written_ids(n).__getitem__, codes.tolist()))[:-1]


def token_groups(docs: DataFrame, first: str = FIRST, second: str = SECOND, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and groups, an array of (a, b), the ids of both tokenizers between two offsets where both end."""

    def made(batches):
        for batch in slices(batches, 200):
            _, _, la, lb = _loaded(first, second)
            groups = []
            for x, y in encoded(batch.column(1).to_pylist(), first, second):
                i, j = _met(np.cumsum(la[x]), np.cumsum(lb[y])) if len(x) else (_NONE, _NONE)
                groups.append([{"a": x[p:u].tolist(), "b": y[q:v].tolist()} for p, u, q, v in zip([0, *(i + 1)], i + 1, [0, *(j + 1)], j + 1)])
            ids = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(groups, pa.list_(pa.struct([("a", ids), ("b", ids)])))], names=["doc_id", "groups"])

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(made, "doc_id long, groups array<struct<a: array<int>, b: array<int>>>")


# ---- runs ----------------------------------------------------------------------------------


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of longs in one zstd frame; the first, which rises, by its steps."""
    arrays = (np.diff(arrays[0], prepend=0), *arrays[1:])
    small = [a.astype(np.min_scalar_type(int(a.max(initial=0)))) for a in arrays]
    head = np.array([len(small), *itertools.chain.from_iterable((len(a), a.itemsize) for a in small)], "<i8")
    return zstandard.ZstdCompressor(level=3).compress(b"".join([head.tobytes(), *(a.tobytes() for a in small)]))


def unpacked(run: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(run)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    at, out = 8 * (1 + 2 * n), []
    for size, wide in np.frombuffer(raw, "<i8", 2 * n, 8).reshape(-1, 2).tolist():
        out.append(np.frombuffer(raw, f"<u{wide}", size, at).astype(np.int64))
        at += size * wide
    out[0] = np.cumsum(out[0])
    return out


def _runs(pair: np.ndarray, doc: np.ndarray, radix: int):
    """(radix, pairs, documents) of records: pairs are second id * WIDE + first id; sorted, so that the second id leads."""
    docs = int(doc.max(initial=0)) + 1
    record, times = np.unique(pair * docs + doc, return_counts=True)
    pair, doc = record // docs, record % docs
    part = pair // WIDE % radix
    order = np.argsort(part, kind="stable")
    ends = np.cumsum(np.bincount(part, minlength=radix))
    for r, own in enumerate(np.split(order, ends[:-1])):
        if len(own):
            p, at = np.unique(pair[own], return_index=True)
            yield r, packed(p, np.add.reduceat(times[own], at)), packed(np.zeros(0, np.int64), np.diff(np.append(at, len(own))), doc[own], times[own])


_WRITTEN = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("radix", pa.int32()), ("span", pa.int64()), ("pairs", pa.binary()), ("posts", pa.binary())])


def _written(docs: DataFrame, first: str, second: str, radix: int, span: int) -> DataFrame:
    """A row for each document (radix null), and for each run (doc counts null; uid of its first document)."""

    def made(batches):
        _, _, la, lb = _loaded(first, second)
        part, n = TaskContext.get().partitionId(), 0
        for batch in slices(batches):
            rows, pairs, owners, begun, records = [], [], [], n, 0
            runs: list[tuple] = []

            def flush():
                if records:
                    runs.extend((part << 40 | begun, *r) for r in _runs(np.concatenate(pairs), np.concatenate(owners), radix))

            texts = batch.column(1).to_pylist()
            for d, x, y in ((d, *xy) for lo in range(0, len(texts), 200) for d, xy in enumerate(encoded(texts[lo : lo + 200], first, second), lo)):
                i, j = _met(np.cumsum(la[x]), np.cumsum(lb[y]))
                digest = hashlib.sha256(groups_text(x, y, i, j).encode()).hexdigest() if len(x) else ""
                rows.append((part << 40 | n, batch.column(0)[d].as_py(), len(x), len(y), len(i), len(i), digest))
                pairs.append(y[j] * WIDE + x[i])
                owners.append(np.full(len(i), n - begun))
                records, n = records + len(i), n + 1
                if records > RECORDS:
                    flush()
                    pairs, owners, begun, records = [], [], n, 0
            flush()
            cols = [*zip(*rows)] or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*cols, *[[None] * len(rows)] * 4], _WRITTEN)], schema=_WRITTEN)
            if runs:
                uid, r, p, posts = zip(*runs)
                empty = [None] * len(runs)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([uid, *[empty] * 6, r, [part // span] * len(runs), p, posts], _WRITTEN)], schema=_WRITTEN)

    rows = docs.select(F.col("doc_id"), F.col("text"))
    return cut(rows.mapInArrow(made, "uid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, radix int, span long, pairs binary, posts binary"))


def merged(runs: list[bytes]):
    """(pair, total) of runs by a k-way heap merge, in order."""
    heads = (zip(*(a.tolist() for a in unpacked(r))) for r in runs)
    for pair, same in itertools.groupby(heapq.merge(*heads), key=lambda x: x[0]):
        yield pair, sum(n for _, n in same)


def pair_counts(written: DataFrame) -> DataFrame:
    """radix, pair, n: how many links hold each pair."""

    def count(table: pa.Table) -> pa.Table:
        found = [*zip(*merged(table.column("pairs").to_pylist()))] or [(), ()]
        return pa.table({"radix": pa.array([table.column("radix")[0].as_py()] * len(found[0]), pa.int32()), "pair": pa.array(found[0], pa.int64()), "n": pa.array(found[1], pa.int64())})

    runs = written.filter("radix IS NOT NULL").select("radix", "span", "pairs")
    return runs.groupBy("radix", "span").applyInArrow(count, "radix int, pair long, n long").groupBy("radix", "pair").agg(F.sum("n").alias("n"))


def contributions(written: DataFrame, counts: DataFrame) -> DataFrame:
    """uid, n_best, count_sum: what the pairs of one radix add to a document."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("pair")
        one = packed(np.asarray(table.column("pair")), np.asarray(table.column("n")))
        return pa.table({"radix": table.column("radix")[:1], "counts": pa.array([one], pa.binary())})

    def streamed(runs: pa.Table, counted: pa.Table) -> pa.Table:
        pair, n = unpacked(counted.column("counts")[0].as_py())
        second = pair // WIDE
        at = np.flatnonzero(np.append(True, second[1:] != second[:-1]))
        best = n == np.repeat(np.maximum.reduceat(n, at), np.diff(np.append(at, len(n))))
        out = []
        for uid, own, posts in zip(*(runs.column(c).to_pylist() for c in ("uid", "pairs", "posts"))):
            where = np.searchsorted(pair, unpacked(own)[0])
            _, each, doc, times = unpacked(posts)
            where = np.repeat(where, each)
            many = int(doc.max()) + 1
            add = np.zeros((2, many), np.int64)
            np.add.at(add[0], doc, times * best[where])
            np.add.at(add[1], doc, times * n[where])
            there = np.unique(doc)
            out.append((uid + there, add[0][there], add[1][there]))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("uid", "n_best", "count_sum"), cols)))

    totals = counts.groupBy("radix").applyInArrow(pack, "radix int, counts binary")
    runs = written.filter("radix IS NOT NULL").select("radix", "span", "uid", "pairs", "posts")
    asked = runs.select("radix", "span").distinct().join(totals, "radix").select(F.col("radix").alias("of"), F.col("span").alias("among"), "counts")
    return runs.groupBy("radix", "span").cogroup(asked.groupBy("of", "among")).applyInArrow(streamed, "uid long, n_best long, count_sum long")


def align(docs: DataFrame, first: str = FIRST, second: str = SECOND, doc_id: str = "doc_id", text: str = "text", radix: int = RADIX, span: int = SPAN) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row; `token_groups` gives the groups themselves."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    written = _written(rows, first, second, radix, span)
    counts = cut(pair_counts(written))
    added = contributions(written, counts).groupBy("uid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    own = written.filter("radix IS NULL").select("uid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return own.join(added, "uid", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
