"""SentencePiece encoding and decoding by a shared-prefix forward pass.

Texts fall into marked words (the mark, then what is not a space). The distinct words of a
batch are sorted, which is the depth-first order of their trie; the forward state of each
prefix is kept on a stack, and a word only computes the positions past the prefix that it
shares with the word before.

With a unigram model the forward score of a prefix is the largest sum of its pieces' log
probabilities. A byte-pair model (the vocabulary here) has merge ranks for scores instead, and
a sum of them does not rank segmentations as its encoder does. There the forward scores are 0
or minus infinity: a path is allowed if the encoder would make each of its pieces, and keep
each two neighbours apart. Exactly one path of every prefix is allowed, so a state is the last
piece of that path, and the best path is the encoder's own result.

Characters outside the vocabulary become byte pieces. Runs of marks, whose merges tie, are
encoded by their length.

Defined results: null gives null ids, empty text gives none; decoding gives the text back,
except that the mark character itself comes back as a space.
"""

from __future__ import annotations

import heapq
import itertools
import re
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_names, slices

MARK = "▁"
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Words, and lengths of runs of spaces, whose ids a worker remembers between batches.
REMEMBERED = 300_000
RUNS = 2_000
#: What a character that is no piece costs beyond the worst piece, as the format has it.
UNKNOWN = 10.0


def read_vocabulary(raw: bytes) -> tuple[list[tuple[str, float, int]], bool]:
    """(piece, score, type) in order, and whether it is a unigram model, from the model file's protocol buffer."""
    import struct

    def varint(at: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            b = raw[at]
            out |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return out, at

    out, at, unigram = [], 0, True  # the default where no type is given
    while at < len(raw):
        tag, at = varint(at)
        if tag & 7 != 2:
            raise ValueError("not a model file")
        size, at = varint(at)
        end = at + size
        if tag >> 3 == 2:
            while at < end:
                field, at = varint(at)
                if field & 7 == 0:
                    value, at = varint(at)
                    unigram = value == 1 if field >> 3 == 3 else unigram
                elif field & 7 == 2:
                    value, at = varint(at)
                    at += value
                else:
                    at += 4 if field & 7 == 5 else 8
        if tag >> 3 == 1:
            piece, score, kind = "", 0.0, 1
            while at < end:
                field, at = varint(at)
                if field == 0x0A:
                    n, at = varint(at)
                    piece, at = raw[at : at + n].decode(), at + n
                elif field == 0x15:
                    score, at = struct.unpack("<f", raw[at : at + 4])[0], at + 4
                else:
                    kind, at = varint(at)
            out.append((piece, score, kind))
        at = end
    return out, unigram


class Pieces:
    """Encoder and decoder of one vocabulary."""

    _WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")

    def __init__(self, raw: bytes):
        vocabulary, self.unigram = read_vocabulary(raw)
        self.texts = [p for p, _, _ in vocabulary]
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(vocabulary) if t == 6}
        self.bytes_of = {i: b for b, i in self.byte_ids.items()}
        self.silent = {i for i, (_, _, t) in enumerate(vocabulary) if t == 3}
        # what a piece shows alone; bytes of longer characters have to be put together
        self.shown = ["" if i in self.silent else chr(self.bytes_of[i]) if self.bytes_of.get(i, 128) < 128 else p for i, p in enumerate(self.texts)]
        self.split_bytes = {i for i, b in self.bytes_of.items() if b >= 128}
        # the better a piece's place, the earlier it is merged; equal scores share a place and go from left to right
        usual = {p: (i, -s) for i, (p, s, t) in enumerate(vocabulary) if t in (1, 4)}
        self.ids = {p: i for p, (i, _) in usual.items()}
        self.place = {p: s for p, (_, s) in usual.items()}
        self.scores = {p: s for p, s, t in vocabulary if t in (1, 4)}
        self.unknown = min(self.scores.values(), default=0.0) - UNKNOWN
        self.unknown_id = next((i for i, (_, _, t) in enumerate(vocabulary) if t == 2), 0)
        self.longest = max(map(len, self.ids), default=1)
        self.ends = {p[i:] for p in self.ids for i in range(len(p))}
        #: pieces that the encoder makes of their own text
        self.good = set(self.ids) if self.unigram else {p for p in self.ids if len(p) == 1 or self.merged(p) == [p]}
        self.apart: dict[tuple[str, str], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.runs: dict[int, tuple[int, ...]] = {0: ()}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has a mark after other characters; words cannot be encoded apart")

    def merged(self, text: str) -> list[str]:
        """The encoder's merges: always the pair with the best place, of equal ones the first; a heap of pairs over a linked list."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        place, heap = self.place, []

        def offer(i: int, j: int) -> None:
            both = parts[i] + parts[j]
            if both in place:
                heapq.heappush(heap, (place[both], i, j, both))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or after[i] != j or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            after[i] = k = after[j]
            if k < len(parts):
                before[k] = i
                offer(i, k)
            if before[i] >= 0:
                offer(before[i], i)
        return [p for p in parts if p is not None]

    def _apart(self, a: str, b: str) -> bool:
        ok = self.apart.get((a, b))
        if ok is None:
            if len(self.apart) > 2_000_000:
                self.apart.clear()
            ok = self.apart[a, b] = self.merged(a + b) == [a, b]
        return ok

    def most_likely(self, words: list[str]):
        """(word, pieces) for sorted words of a unigram model: state i is the best sum over the prefix of i characters, and its last piece."""
        states: list[tuple[float, str]] = [(0.0, "")]
        before = ""
        for word in words:
            shared, n = 0, min(len(before), len(word))
            while shared < n and before[shared] == word[shared]:
                shared += 1
            del states[shared + 1 :]
            for i in range(shared + 1, len(word) + 1):
                best = (states[i - 1][0] + self.scores.get(word[i - 1], self.unknown), word[i - 1])
                for lo in range(i - 2, max(0, i - self.longest) - 1, -1):
                    piece = word[lo:i]
                    if piece not in self.ends:
                        break
                    if piece in self.scores and states[lo][0] + self.scores[piece] > best[0]:
                        best = (states[lo][0] + self.scores[piece], piece)
                states.append(best)
            before = word
            parts, i = [], len(word)
            while i:
                parts.append(states[i][1])
                i -= len(states[i][1])
            yield word, parts[::-1]

    def forward(self, words: list[str]):
        """(word, pieces) for sorted words, along their trie; `last[i]` is the last piece of the prefix of i characters."""
        last: list[str] = [""]
        before = ""
        good, longest, ends, known, apart = self.good, self.longest, self.ends, self.apart, self._apart
        for word in words:
            n = min(len(before), len(word))
            shared = 0
            while shared < n and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :]
            for i in range(shared + 1, len(word) + 1):
                found = None
                for lo in range(i - 1, max(0, i - longest) - 1, -1):
                    piece = word[lo:i]
                    if piece not in ends and lo < i - 1:
                        break  # no piece ends like this, so no longer one does
                    if piece in good or lo == i - 1:
                        if lo:
                            pair = (last[lo], piece)
                            if not (known[pair] if pair in known else apart(*pair)):
                                continue
                        found = piece
                        break
                if found is None:
                    raise AssertionError("no path")
                last.append(found)
            before = word
            parts, i = [], len(word)
            while i:
                parts.append(last[i])
                i -= len(last[i])
            yield word, parts[::-1]

    def _ids(self, parts: list[str]) -> tuple[int, ...]:
        out: list[int] = []
        for p in parts:
            if p in self.ids:
                out.append(self.ids[p])
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in p.encode()]
            elif out[-1:] != [self.unknown_id]:
                out.append(self.unknown_id)
        return tuple(out)

    def _run(self, n: int) -> tuple[int, ...]:
        found = self.runs.get(n)
        if found is None:
            found = self._ids(self.merged(MARK * n))
            if n <= RUNS:
                self.runs[n] = found
        return found

    def learn(self, words: set[str]) -> None:
        """Encode words (a mark at most at the start) that are not known yet."""
        fresh = sorted(w for w in words if w not in self.known)
        for word, parts in (self.most_likely if self.unigram else self.forward)(fresh):
            self.known[word] = self._ids(parts)

    def encode(self, texts: list[str | None]) -> list[list[int] | None]:
        """The ids of each text. Without runs of spaces a text is its words, each after one mark."""
        if len(self.known) > REMEMBERED:  # before anything of this batch is learned
            self.known.clear()
        split = [None if t is None else t.replace(MARK, " ").split(" ") if t else [] for t in texts]
        usual = [i for i, ws in enumerate(split) if ws and "" not in ws]
        self.learn({MARK + w for w in {w for i in usual for w in split[i]} if MARK + w not in self.known})
        known, out = self.known, [None] * len(texts)
        chain = itertools.chain.from_iterable
        for i in usual:
            out[i] = list(chain([known[MARK + w] for w in split[i]]))
        seldom = [i for i, ws in enumerate(split) if ws is not None and out[i] is None]
        for i, ids in zip(seldom, self._with_runs([texts[i] for i in seldom])):
            out[i] = ids
        return out

    def _with_runs(self, texts: list[str]) -> list[list[int]]:
        if self.unigram:  # a run of marks is part of the word after it
            split = [self._WORDS.findall((MARK + t).replace(" ", MARK)) if t else [] for t in texts]
            self.learn({w for ws in split for w in ws})
            return [[i for w in ws for i in self.known[w]] for ws in split]
        split = [None if t is None else self._WORDS.findall((MARK + t).replace(" ", MARK)) if t else [] for t in texts]
        distinct = {w for ws in split if ws for w in ws}
        cores = {w: w if w[:2] != MARK * 2 else MARK + w.lstrip(MARK) for w in distinct}
        self.learn({c for c in cores.values() if c != MARK})
        whole, alone = {}, self.ids.get(MARK)
        for w, core in cores.items():
            n = len(w) - len(w.lstrip(MARK))
            ids = self.known[core] if core != MARK else ()
            if core == MARK:
                whole[w] = self._run(n)
            elif n > 1 and ids[0] == alone:
                whole[w] = self._run(n) + ids[1:]
            else:
                whole[w] = self._run(n - 1) + ids if n else ids
        out: list[list[int] | None] = []
        for ws in split:
            if ws is None:
                out.append(None)
            else:
                ids = []
                for w in ws:
                    ids += whole[w]
                out.append(ids)
        return out

    def decode(self, ids: list[int] | None) -> str | None:
        if ids is None:
            return None
        if self.split_bytes.isdisjoint(ids):
            text = "".join(map(self.shown.__getitem__, ids)).replace(MARK, " ")
            return text[1:] if text[:1] == " " else text
        texts, as_bytes, silent = self.texts, self.bytes_of, self.silent
        parts: list[str] = []
        held = bytearray()
        for i in ids:
            if i in as_bytes:
                held.append(as_bytes[i])
                continue
            if held:
                parts.append(held.decode(errors="replace"))
                held = bytearray()
            if i not in silent:
                parts.append(texts[i])
        if held:
            parts.append(held.decode(errors="replace"))
        text = "".join(parts).replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


_LOADED: dict[bytes, Pieces] = {}


def _pieces(raw: bytes) -> Pieces:
    if raw not in _LOADED:
        _LOADED.clear()
        _LOADED[raw] = Pieces(raw)
    return _LOADED[raw]


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, doc_id: str = "doc_id", text: str = "text", keep: tuple = ()) -> DataFrame:
    """One row for each row of docs: doc_id, ids, n_tokens, decoded; and `keep`. The vocabulary file is read on the driver."""
    raw = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *[F.col(c).alias(f"keep_{c}") for c in keep])

    def run(batches):
        pieces = _pieces(raw.value)
        for batch in slices(batches):
            ids = pieces.encode(batch.column(1).to_pylist())
            back = [pieces.decode(x) for x in ids]
            more = batch.columns[2:]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([None if x is None else len(x) for x in ids], pa.int64()), pa.array(back, pa.string()), *more],
                ["doc_id", "ids", "n_tokens", "decoded", *batch.schema.names[2:]],
            )

    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
    out = rows.mapInArrow(run, f"doc_id long, ids array<int>, n_tokens long, decoded string{kinds}")
    return out.select("doc_id", "ids", "n_tokens", "decoded", *[F.col(f"keep_{c}").alias(name) for c, name in kept_names(keep, ("doc_id", "ids", "n_tokens", "decoded"))])
