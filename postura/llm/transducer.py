"""SentencePiece encoding and decoding as a shortest path through a weighted transducer.

The model file is compiled into three relations: the normaliser (white space to the word
mark, and a mark before the text), the pieces as a deterministic acceptor that reads one
character an arc, and byte fallback for characters without a piece. Their composition
with a text is a graph: a state is a position and the last piece, an arc reads the
characters of one piece and writes its id. Weights add up along a path, of paths to one
state the least is kept (tropical semiring), and states are relaxed from left to right.

Arc weights follow the model's kind. A unigram model's arcs weigh minus the piece's
score, and the state needs the position only. In a merge-ranked (BPE) model an arc weighs
0 if the two pieces may stand side by side, that is, if merging their joined text yields
just those two, and infinity otherwise; each prefix then has at most one last piece of
finite weight, so one state a position is enough here too, and the path is the very
segmentation that the merges give.

Pieces never cross from a text character to a following word mark, so a text falls into
segments with a best path each, and frequent segments are looked up. Texts are read whole,
in one pass without a shuffle. Defined results for odd input: null and empty texts have
no ids and decode to an empty text; repeated rows each give their row; further columns are
ignored. The word mark itself, U+2581, decodes to a space.
"""

from __future__ import annotations

import re
import struct
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only_model, tidy

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Segments remembered by a Python worker, and the longest of them in characters.
REMEMBERED, MEMO_CHARS = 200_000, 48
#: Pairs of pieces remembered by it.
MOST_PAIRS = 400_000
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2


def fields(data: bytes):
    """(number, value) of a protocol buffer message: bytes, int or float."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        elif key & 7 == 5:
            yield key >> 3, struct.unpack("<f", data[at : at + 4])[0]
            at += 4
        else:
            yield key >> 3, data[at : at + 8]
            at += 8


class Transducer:
    """A compiled model: encode() and decode() a text."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = list(fields(f.read()))
        self.pieces, self.kinds, self.scores = [], [], []
        trainer, normaliser = {}, {}
        for number, value in model:
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(piece.get(2, 0.0))
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normaliser = dict(fields(value))
        self.bpe = trainer.get(3, UNIGRAM) == BPE
        if not self.bpe and trainer.get(3, UNIGRAM) != UNIGRAM:
            raise ValueError("only unigram and merge-ranked models can be compiled")
        if normaliser.get(2):
            raise ValueError("the model rewrites characters by a compiled map; only white space rules can be compiled")
        self.dummy_prefix = bool(normaliser.get(3, 1))
        self.squeeze = bool(normaliser.get(4, 1))
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] in (NORMAL, USER)}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        self.unknown = self.kinds.index(UNKNOWN) if UNKNOWN in self.kinds else 0
        self.splits = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        inside = {c for p in self.ids if len(p) > 1 for c in p}
        alone = "".join(re.escape(c) for c in "\n\t\r" if c not in inside)
        self.segments = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|[{alone}]" if alone else ""))
        self.old: dict[str, tuple[int, ...]] = {}  # the memo before it was last full
        self.memo: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, dict[int, bool]] = {}  # whether a piece may stand before another, as far as asked
        self.known = 0
        if self.bpe:
            #: How each piece is last merged; pieces that their own text's merges don't yield never appear.
            self.halves: dict[int, tuple[int, int]] = {}
            for p, i in list(self.ids.items()):
                if len(p) > 1 and not self.split(p, i):
                    del self.ids[p]
        #: The acceptor of the pieces: a state maps a character to the next state and the piece that ends there, or -1.
        self.acceptor: dict = {}
        for p, i in self.ids.items():
            state = self.acceptor
            for c in p[:-1]:
                state = state.setdefault(c, ({}, -1))[0]
            state[p[-1]] = (state[p[-1]][0] if p[-1] in state else {}, i)
        self.worst = 10.0 - min(self.scores, default=0.0)
        self.spelled = [p.replace(MARK, " ") if k in (NORMAL, USER) else " \u2047 " if k == UNKNOWN else "" for p, k in zip(self.pieces, self.kinds)]
        self.byte_ids = frozenset(self.bytes.values())

    def merges(self, text: str) -> list[str]:
        """Pieces by repeated merging of the best-scored neighbours, leftmost first; for short texts."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                j = self.ids.get(parts[i] + parts[i + 1])
                if j is not None and (best is None or self.scores[j] > best):
                    best, at = self.scores[j], i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def split(self, p: str, i: int) -> bool:
        """Notes the last merge that makes the piece; false if merging its text ends otherwise."""
        parts = list(p)
        while len(parts) > 1:
            found = [(-self.scores[j], k) for k in range(len(parts) - 1) if (j := self.ids.get(parts[k] + parts[k + 1])) is not None]
            if not found:
                return False
            k = min(found)[1]
            if len(parts) == 2:
                self.halves[i] = (self.ids.get(parts[0], -1), self.ids.get(parts[1], -1))
                return -1 not in self.halves[i]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return True

    def beside(self, a: int, b: int) -> bool:
        """Whether piece b may follow piece a: the weight of the arc is finite.

        Undoes the two pieces' merges from the last to the first. At each point the pieces
        at the border would have merged if their joint piece ranked before the merge that
        was undone last (at equal rank the leftmost goes first).
        """
        ids, pieces, scores, halves = self.ids, self.pieces, self.scores, self.halves
        x, y, ok = a, b, True
        bound, left = float("-inf"), False  # the rank of the merge undone last, and whether it was in the left piece
        while True:
            j = ids.get(pieces[x] + pieces[y])
            if j is not None and (scores[j] > bound or scores[j] == bound and not left):
                ok = False
                break
            sx = scores[x] if x in halves else None
            sy = scores[y] if y in halves else None
            if sx is None and sy is None:
                break
            # the later of the two last merges; at equal rank the right one comes later
            if sy is None or sx is not None and sx < sy:
                bound, left = sx, True
                x = halves[x][1]
            else:
                bound, left = sy, False
                y = halves[y][0]
        return ok

    def fallback(self, c: str) -> list[int]:
        return [self.bytes[b] for b in c.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]

    def best_path(self, s: str) -> list[int]:
        """Ids on the path of least weight through the composition with s."""
        n, inf, bpe, beside, scores = len(s), float("inf"), self.bpe, self.beside, self.scores
        weight, last, start = [0.0] + [inf] * n, [-1] * (n + 1), [0] * (n + 1)
        for a in range(n):
            so_far, before = weight[a], last[a]
            if so_far == inf:
                continue
            beside_it = self.pairs.setdefault(before, {}) if bpe else None
            state, end, alone = self.acceptor, a, True
            for c in s[a:] if n < 64 else islice(s, a, None):
                arc = state.get(c)
                if arc is None:
                    break
                state, piece = arc
                end += 1
                if piece < 0:
                    continue
                alone = alone and end > a + 1
                if not bpe:
                    cost = so_far - scores[piece]
                elif weight[end] == 0.0:  # no other arc can weigh less
                    continue
                else:
                    fits = beside_it.get(piece)
                    if fits is None:
                        fits = beside_it[piece] = before < 0 or beside(before, piece)
                        self.known += 1
                    cost = so_far if fits else inf
                if cost < weight[end]:
                    weight[end], last[end], start[end] = cost, piece, a
            if alone and so_far + self.worst < weight[a + 1]:
                weight[a + 1], last[a + 1], start[a + 1] = so_far + (0.0 if bpe else self.worst), -1, a
        if self.known > MOST_PAIRS:
            self.pairs, self.known = {}, 0
        path, end = [], n
        while end:
            path.append((last[end],) if last[end] >= 0 else self.fallback(s[start[end] : end]))
            end = start[end]
        return [i for x in reversed(path) for i in x]

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        return (MARK if self.dummy_prefix and text else "") + text.replace(" ", MARK)

    def encode(self, text: str) -> list[int]:
        text = self.normalise(text)
        parts = self.segments.findall(text) if self.splits else [text]
        found = list(map(self.memo.get, parts))
        if None in found:
            found = [self.segment(s) if ids is None else ids for ids, s in zip(found, parts)]
        return list(chain.from_iterable(found))

    def segment(self, s: str) -> tuple[int, ...]:
        """The best path of a segment; short ones are remembered, and forgotten if not seen for long."""
        ids = self.memo.get(s) or self.old.get(s) or tuple(self.best_path(s))
        if len(s) <= MEMO_CHARS:
            if len(self.memo) >= REMEMBERED:
                self.old, self.memo = self.memo, {}
            self.memo[s] = ids
        return ids

    def decode(self, ids) -> str:
        if self.byte_ids.isdisjoint(ids):
            text = "".join(map(self.spelled.__getitem__, ids))
        else:
            parts: list[str] = []
            pending = bytearray()
            for i in ids:
                if i in self.byte_ids:
                    pending.append(int(self.pieces[i][3:5], 16))
                    continue
                if pending:
                    parts.append(pending.decode("utf-8", "replace"))
                    pending.clear()
                parts.append(self.spelled[i])
            parts.append(pending.decode("utf-8", "replace"))
            text = "".join(parts).replace(MARK, " ")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text

    def expected(self, text: str) -> str:
        """What decoding the encoded text has to give."""
        text = self.normalise(text).replace(MARK, " ")
        return text[1:] if self.dummy_prefix and text else text


@only_model
def compiled(path: str) -> Transducer:
    return Transducer(path)


def encode(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, ids, n_tokens and round_trip: whether the decoded ids are the normalised text again."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        model = compiled(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):  # a bounded number of id lists at a time
                part = batch.slice(k, 512)
                ids, same = [], []
                for text in part.column("text").to_pylist():
                    found = model.encode(text or "")
                    same.append(model.decode(found) == model.expected(text or ""))
                    ids.append(found)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.array(list(chain.from_iterable(ids)), np.int32))), pa.array([len(x) for x in ids], pa.int64()), pa.array(same, pa.bool_())],
                    names=["doc_id", "ids", "n_tokens", "round_trip"],
                )

    return docs.select("doc_id", "text").mapInArrow(tidy(run, model=True), f"doc_id {kind}, ids array<int>, n_tokens long, round_trip boolean")


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """The table with a text column made of its ids."""

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        model = compiled(path)
        return ids.map(lambda x: "" if x is None else model.decode(x))

    return encoded.withColumn("text", text("ids"))
