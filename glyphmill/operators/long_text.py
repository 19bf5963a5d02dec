"""Texts of any length as pieces: each piece is a row (key, seq, text), and many tasks work on one text.

seq counts from 0 within a key without gaps; a piece may end anywhere between two codepoints.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship, written
from ..text import automaton as A
from ..ucd import properties as U


def pieces(df: DataFrame, text: str, key: str = "doc_id", size: int = 1000) -> DataFrame:
    """key, seq, text: each text in pieces of `size` codepoints; null and empty texts have none."""
    return df.select(F.col(key).alias("key"), F.posexplode(F.regexp_extract_all(F.col(text), F.lit(f"(?s)(.{{1,{size}}})"), F.lit(1))).alias("seq", "text"))


def joined(parts: DataFrame) -> DataFrame:
    """key, text: the pieces of each key put together again; for texts that fit into a row."""
    rows = parts.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("all"))
    return rows.select("key", F.array_join(F.transform("all", lambda p: p["text"]), "").alias("text"))


# ---- normalisation -----------------------------------------------------------------------


def _class_of(hit) -> str:
    """A regular expression class of the codepoints that an array marks."""
    import numpy as np

    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b - 1:X}}}" for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())) + "]"


def joins_what_comes_before(form: str) -> str:
    """Class of the characters before which a text must not be cut: they are reordered, or may change or compose."""
    of, names = U.codes(f"{form}_Quick_Check")
    return _class_of((U.combining_classes() > 0) | (of != names.index("Yes")))


def at_boundaries(parts: DataFrame, form: str = "NFC") -> DataFrame:
    """The same texts, cut where normalisation of both sides by themselves gives the whole: what a piece begins with of the piece before goes there.

    A piece without any boundary goes to the last one that has one. Only such beginnings are moved, everything else stays
    where it is; the pieces that are left keep their seq, so seq may have gaps.
    """
    head = F.regexp_extract("text", f"(?s)^({joins_what_comes_before(form)}*)", 1)
    cut = parts.select("key", "seq", F.when(F.col("seq") == 0, "").otherwise(head).alias("head"), "text")
    cut = cut.select("key", "seq", "head", F.substring("text", F.length("head") + 1, F.length("text")).alias("body"))
    starts = (F.col("seq") == 0) | (F.col("body") != "")
    solid = cut.filter(starts).select("key", "seq", "body")
    # pieces that are head only, in rows of neighbours
    blank = cut.filter(~starts).select("key", "seq")
    island = Window.partitionBy("key").orderBy("seq")
    blank = blank.withColumn("island", F.col("seq") - F.row_number().over(island))
    blank = blank.select(F.col("key").alias("of"), F.col("seq").alias("at"), (F.min("seq").over(Window.partitionBy("key", "island")) - 1).alias("before"))
    heads = cut.filter("head <> ''").select("key", "seq", "head")
    moved = heads.join(blank, heads["key"].eqNullSafe(blank["of"]) & (heads["seq"] - 1 == blank["at"]), "left")
    moved = moved.groupBy(F.col("key").alias("of"), F.coalesce("before", F.col("seq") - 1).alias("to")).agg(F.sort_array(F.collect_list(F.struct("seq", "head"))).alias("heads"))
    both = solid.join(moved, solid["key"].eqNullSafe(moved["of"]) & (solid["seq"] == moved["to"]), "left")
    tail = F.coalesce(F.array_join(F.transform("heads", lambda h: h["head"]), ""), F.lit(""))
    return both.select("key", "seq", F.concat("body", tail).alias("text"))


def normalize(parts: DataFrame, form: str = "NFC") -> DataFrame:
    """key, seq, text: texts in pieces, normalised; the pieces of a key together are the normal form of the whole text."""
    from ..functions.text import normalize as of_one

    return at_boundaries(parts, form).select("key", "seq", of_one("text", form).alias("text"))


# ---- segmentation ------------------------------------------------------------------------


def _states(now: DataFrame) -> DataFrame:
    """key, seq, state: the automaton's state after each piece, of key, seq, state, map.

    Pieces whose state depends on what comes before hold a map of states; it is composed with that of the pieces before,
    twice as many in each round, until none is left.
    """
    now = now.select("key", "seq", "state", "map").withColumn("back", F.lit(1))
    while not (open_ := now.filter("state IS NULL")).isEmpty():
        before = now.select(F.col("key").alias("of"), F.col("seq").alias("at"), F.col("state").alias("was"), F.col("map").alias("first"), F.col("back").alias("more"))
        met = open_.join(before, open_["key"].eqNullSafe(before["of"]) & (open_["seq"] - open_["back"] == before["at"]), "left")
        at_start = F.col("at").isNull()
        state = F.when(at_start, F.get("map", F.lit(0))).otherwise(F.get("map", F.col("was")))
        both = F.when(state.isNull(), F.transform("first", lambda s: F.get(F.col("map"), s)))
        done = met.select("key", "seq", state.alias("state"), both.alias("map"), (F.col("back") + F.coalesce("more", F.lit(0))).cast("int").alias("back"))
        now = written(now.filter("state IS NOT NULL").unionByName(done), "states")
    return now.select("key", "seq", "state")


def segment_starts(parts: DataFrame, kind: str = "grapheme") -> DataFrame:
    """key, seq, starts: the places in each piece (codepoints, from 0) at which a segment of the whole text begins; kind: grapheme or word.

    A piece that comes right after the one before it is read at once. Only the others, one of a batch if texts come in
    order, wait for the state before them, and only their texts are moved.
    """
    ship(parts.sparkSession)
    types = dict(parts.dtypes)
    what = "starts array<int>, decided boolean, waits int"

    def begin(batches):
        machine, last = A.automaton(kind), None
        for b in batches:
            out = []
            for k, q, t in zip(*(b.column(i).to_pylist() for i in range(3))):
                t = t or ""
                entered = 0 if q == 0 else last[2] if last and last[:2] == (k, q - 1) else None
                x = machine.after(t)
                if isinstance(x, list) and entered is not None:
                    x = x[entered]
                state, open_ = (None, x) if isinstance(x, list) else (x, None)
                last = k, q, state
                out.append((state, open_, *((t, None, None, None) if entered is None else (None, *(machine.read(t, entered) if t else ([], None, None))))))
            columns = zip(*out) if out else [()] * 6
            kinds = (pa.int32(), pa.list_(pa.int32()), pa.string(), pa.list_(pa.int32()), pa.bool_(), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["key", "seq", "state", "map", "text", "starts", "decided", "waits"])

    begun = written(parts.select("key", "seq", "text").mapInArrow(begin, f"key {types['key']}, seq {types['seq']}, state int, map array<int>, text string, {what}"), "states")
    after = _states(begun).select(F.col("key").alias("of"), (F.col("seq") + 1).alias("at"), "state")
    late = begun.filter("text IS NOT NULL").select("key", "seq", "text")
    entered = late.join(after, late["key"].eqNullSafe(after["of"]) & (late["seq"] == after["at"]), "left").select("key", "seq", "text", F.coalesce("state", F.lit(0)).alias("state"))

    def read(batches):
        machine = A.automaton(kind)
        for b in batches:
            found = [machine.read(t, s) if t else ([], None, None) for t, s in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            starts, decided, waits = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(starts, pa.list_(pa.int32())), pa.array(decided, pa.bool_()), pa.array(waits, pa.int32())], names=["key", "seq", "starts", "decided", "waits"])

    then = written(entered.mapInArrow(read, f"key {types['key']}, seq {types['seq']}, {what}"), "starts")
    found = begun.filter("text IS NULL").select("key", "seq", "starts", "decided", "waits").unionByName(then)
    if kind == "grapheme":  # no rule looks ahead
        return found.select("key", "seq", "starts")
    # a place left pending is decided by the next piece that decides one, or by the end of the text; both are few
    said = found.filter("decided IS NOT NULL").select("key", "seq", F.lit(0).alias("turn"), "decided", F.lit(None).cast("int").alias("waits"))
    left = found.filter("waits IS NOT NULL").select("key", "seq", F.lit(1).alias("turn"), F.lit(None).cast("boolean").alias("decided"), "waits")
    order = Window.partitionBy("key").orderBy("seq", "turn")
    late = said.unionByName(left).withColumn("cut", F.coalesce(F.lead("decided").over(order), F.lit(True))).filter("turn = 1 AND cut")
    late = late.select(F.col("key").alias("of"), F.col("seq").alias("at"), F.col("waits").alias("place"))
    both = found.join(late, found["key"].eqNullSafe(late["of"]) & (found["seq"] == late["at"]), "left")
    return both.select("key", "seq", F.when(F.col("place").isNull(), F.col("starts")).otherwise(F.array_sort(F.array_append("starts", F.col("place")))).alias("starts"))


def segment_count(parts: DataFrame, kind: str = "grapheme") -> DataFrame:
    """key, n: how many segments each text has; keys whose texts are empty are left out."""
    return segment_starts(parts, kind).groupBy("key").agg(F.sum(F.size("starts")).alias("n"))


# ---- bytes -------------------------------------------------------------------------------


class DecodeChunks:
    """Table function over a table (key, seq, data) partitioned by key and ordered by seq: a row (key, seq, text, ok) for each chunk of bytes.

    A sequence that a chunk leaves unfinished is carried to the next one. REFUSE: from the first ill-formed byte on ok is
    false and text null. REPLACE and SKIP: as for whole texts. What is unfinished at the end is a row of its own.
    """

    def __init__(self):
        self.decoder = None
        self.refused = False
        self.key = self.seq = None

    def _text(self, data: bytes, final: bool = False):
        try:
            return None if self.refused else self.decoder.decode(data, final)
        except UnicodeDecodeError:
            self.refused = True
            return None

    def eval(self, row, policy: str):
        import codecs

        if self.decoder is None:
            self.decoder = codecs.getincrementaldecoder("utf-8")({"REFUSE": "strict", "REPLACE": "replace", "SKIP": "ignore"}[policy])
        self.key, self.seq = row["key"], row["seq"]
        text = self._text(bytes(row["data"] or b""))
        yield self.key, self.seq, text, not self.refused

    def terminate(self):
        if self.decoder is not None and not self.refused:
            text = self._text(b"", True)
            if text or self.refused:
                yield self.key, self.seq, text, not self.refused


def decode_chunks(chunks: DataFrame, policy: str = "REPLACE") -> DataFrame:
    """key, seq, text, ok of chunks of bytes (key long, seq long, data binary) cut anywhere; see DecodeChunks."""
    ship(chunks.sparkSession)
    table = chunks.select(F.col("key").cast("long").alias("key"), F.col("seq").cast("long").alias("seq"), F.col("data").cast("binary").alias("data"))
    return F.udtf(DecodeChunks, returnType="key long, seq long, text string, ok boolean")(table.asTable().partitionBy("key").orderBy("seq"), F.lit(policy))


def byte_chunks(df: DataFrame, data: Column, key: str = "doc_id", size: int = 1000) -> DataFrame:
    """key, seq, data: bytes in chunks of `size`, wherever that cuts."""
    n = F.ceil(F.octet_length(data) / size).cast("int")
    rows = df.select(F.col(key).alias("key"), data.alias("data"), F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))).alias("seq"))
    return rows.select("key", "seq", F.substring("data", F.col("seq") * size + 1, F.lit(size)).alias("data"))
