"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The model file compiles into three machines: the normaliser (space and marker rules), the pieces (a trie whose final
arcs carry the piece and its weight), and the byte fallback for characters that are no piece. Their composition with an
input is a lattice over its positions, and the encoding is its shortest path in the tropical semiring (weights add up
along a path, the least sum wins).

For a unigram model an arc weighs minus the piece's score. For a model of merges (BPE) scores are ranks of merges, whose
sums mean nothing; there the piece machine has a state per last piece, and an arc from piece u to piece v weighs 0 if
merging the characters of uv gives u, v again, and else infinity. A sequence of pieces whose neighbours all agree in
this way is what the merges make of the whole input, so the path of weight 0 is the library's encoding.

An input falls apart where no piece can reach across: before a marker that follows another character, and around
characters that are no piece. These segments repeat, and workers remember their shortest paths.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from .common import fresh, map_batches, map_streams, quoted, texts_of

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Segments of a generation, of which a worker remembers two, piece pairs that it remembers, and the longest segment
#: among them.
REMEMBERED, REMEMBERED_PAIRS, REMEMBERED_CHARS = 200_000, 300_000, 48


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind in (1, 2, 5):
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield tag >> 3, data[at : at + size]
            at += size
        else:
            raise ValueError("not a model file")


class Normaliser:
    """The transducer of the space rules: `arcs` gives for a state and an input (a space, another character or the end)
    what is put out, "" standing for the character itself, and the next state.

    `squeeze` drops spaces at both ends and all but one in between, `dummy` puts a space first unless all is empty, and
    `escape` writes spaces as markers.
    """

    BEGIN, SPACE, INSIDE = range(3)

    def __init__(self, squeeze: bool, dummy: bool, escape: bool) -> None:
        self.squeeze, self.dummy, self.mark = squeeze, dummy, MARK if escape else " "
        first, here, inside = self.mark * dummy, self.mark, self.INSIDE
        self.arcs = {(inside, "other"): ("", inside), (inside, "end"): (None, inside), (self.BEGIN, "other"): (first, inside), (self.BEGIN, "end"): (None, inside)}
        if squeeze:  # a space is put out with the character that follows
            self.arcs |= {(self.BEGIN, "space"): (None, self.BEGIN), (inside, "space"): (None, self.SPACE)}
            self.arcs |= {(self.SPACE, "space"): (None, self.SPACE), (self.SPACE, "other"): (here, inside), (self.SPACE, "end"): (None, inside)}
        else:
            self.arcs |= {(self.BEGIN, "space"): (first + here, inside), (inside, "space"): (here, inside)}

    def walk(self, text: str) -> str:
        """The machine, arc by arc."""
        state, out = self.BEGIN, []
        for char in text:
            kind = "space" if char == " " else "other"
            put, state = self.arcs[state, kind]
            out.append((put or "") + (char if kind == "other" else ""))
        return "".join(out)

    def __call__(self, text: str) -> str:
        """What `walk` gives, by whole-string operations that do the same."""
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if text and self.dummy:
            text = " " + text
        return text.replace(" ", self.mark)


class Transducer:
    """A model file compiled for encoding and decoding."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            model = list(_fields(f.read()))
        trainer = dict(_fields(next((v for n, v in model if n == 2), b"")))
        normalizer = dict(_fields(next((v for n, v in model if n == 3), b"")))
        self.bpe = trainer.get(3, UNIGRAM) == BPE
        self.dummy, squeeze, escape = (bool(normalizer.get(n, 1)) for n in (3, 4, 5))
        self.normalise = Normaliser(squeeze, self.dummy, escape)
        if trainer.get(3, UNIGRAM) not in (UNIGRAM, BPE) or normalizer.get(2) or trainer.get(24, 0):
            raise ValueError("only unigram and merge models without a character map or markers as suffixes are supported")
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        for number, value in model:
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
        if USER in self.kinds:
            raise ValueError("user-defined pieces are not supported")
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        # of a path through unknown characters the library's unigram models make least use
        self.far = 10.0 - min((self.scores[i] for i in self.ids.values()), default=0.0)
        self.trie: dict = {}
        for piece, i in self.ids.items():
            node = self.trie
            for char in piece:
                node = node.setdefault(char, {})
            node[""] = i
        chars = "".join(map(re.escape, sorted({c for p in self.ids for c in p} - {MARK})))
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces with a marker inside are not supported")
        self.segments = re.compile(f"{MARK}*[{chars}]+|{MARK}+|[^{chars}{MARK}]+")
        self.joins: dict[int, bool] = {}
        self.edges: dict[tuple[int, int], list[tuple[str, float, float]] | None] = {}
        self.seen: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _merged(self, text: str) -> tuple[list[str], list[list[str]]]:
        """The symbols that merging leaves, and what stood at the left and at the right edge meanwhile: again and again
        the neighbours whose joint piece has the highest score become one, of equal ones the first."""
        symbols = list(text)
        edges = [symbols[:1], symbols[-1:]]
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                piece = self.ids.get(symbols[i] + symbols[i + 1])
                if piece is not None and (best is None or self.scores[piece] > best):
                    best, at = self.scores[piece], i
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            for side, here in ((0, symbols[0]), (1, symbols[-1])):
                if here != edges[side][-1]:
                    edges[side].append(here)
        return symbols, edges

    def _edge(self, piece: int, side: int) -> list[tuple[str, float, float]] | None:
        """(symbol, score of the merge that makes it, score of the merge that takes it in) at one edge while the piece
        comes about; None if merging its characters makes something else."""
        if (known := self.edges.get((piece, side), 0)) == 0:
            symbols, edges = self._merged(self.pieces[piece])
            for s in (0, 1):
                made = [float("inf"), *(self.scores[self.ids[e]] for e in edges[s][1:]), -float("inf")]
                whole = len(symbols) == 1
                self.edges[piece, s] = [(e, made[i], made[i + 1]) for i, e in enumerate(edges[s])] if whole else None
            known = self.edges[piece, side]
        return known

    def _joins(self, u: int, v: int) -> bool:
        """Whether the piece machine of a merge model has an arc from u to v: while u and v come about, no symbol at
        the right edge of u may merge with one at the left edge of v that is there at the same time."""
        key = u << 32 | v
        if (known := self.joins.get(key)) is None:
            if len(self.joins) >= REMEMBERED_PAIRS:
                self.joins.clear()
            a, b = self.pieces[u], self.pieces[v]
            if a[-1] == b[0] == MARK:  # pieces of markers have equal scores, whose order the edges do not tell
                known = self._merged(a + b)[0] == [a, b]
            else:
                left, right = self._edge(u, 1), self._edge(v, 0)
                known = left is not None and right is not None
                if known:
                    for x, x_made, x_gone in left:
                        for y, y_made, y_gone in right:
                            piece = self.ids.get(x + y)
                            if piece is not None and max(x_gone, y_gone) < min(x_made, y_made) and x_gone < self.scores[piece] >= y_gone:
                                known = False
            self.joins[key] = known
        return known

    def fallback(self, part: str) -> list[int]:
        """The byte machine: the byte pieces of what is no piece, or the unknown piece if the model has none."""
        return [self.bytes[b] for b in part.encode()] if self.bytes else [self.unknown]

    def path(self, segment: str) -> list[int]:
        """The pieces of the shortest path through the composition with one segment. A segment of a merge model without
        a path of finite weight (the neighbours of its pieces would not determine the merges) is merged outright."""
        if self.bpe and (found := self._first_path(segment)):
            return found
        out = []
        for part in self._merged(segment)[0] if self.bpe else self._least_path(segment):
            piece = self.ids.get(part)
            if piece is None:
                out += self.fallback(part)
            else:
                out.append(piece)
        return out

    def _first_path(self, segment: str) -> list[int]:
        """Of a merge model, best first: all finite weights are 0, so the first path that comes to the end is a shortest
        one, and arcs that reach farthest are tried first. A position has one state at most, since what merging makes of
        the text before it is one sequence; so none is entered twice."""
        n, trie, joins = len(segment), self.trie, self.joins
        last, came, todo, start, end = {0: -1}, {}, [], 0, 0
        while end < n:
            node, reach = trie, start
            for char in segment[start:]:
                node = node.get(char)
                if node is None:
                    break
                reach += 1
                if (piece := node.get("")) is not None and reach not in last:
                    todo.append((start, reach, piece))
            if reach == start and start + 1 not in last:  # no piece has this character
                last[start + 1], came[start + 1] = -1, start
                start = end = start + 1
                continue
            while todo:
                start, end, piece = todo.pop()
                if end in last:
                    continue
                before = last[start]
                if before < 0:
                    known = self._edge(piece, 0) is not None
                elif (known := joins.get(before << 32 | piece)) is None:
                    known = self._joins(before, piece)
                if known:
                    last[end], came[end] = piece, start
                    start = end
                    break
            else:
                return []
        out = []
        while n > 0:
            if (piece := last[n]) < 0:
                out += self.fallback(segment[came[n] : n])[::-1]
            else:
                out.append(piece)
            n = came[n]
        return out[::-1]

    def _least_path(self, segment: str) -> list[str]:
        """Of a unigram model, position by position: of equal paths that which the library's search finds first."""
        n = len(segment)
        cost, back = [0.0] + [math.inf] * n, [0] * (n + 1)
        for start in range(n):
            node, end = self.trie, start
            if segment[start] not in self.ids and cost[start] + self.far < cost[start + 1]:
                cost[start + 1], back[start + 1] = cost[start] + self.far, start
            while end < n and (node := node.get(segment[end])) is not None:
                end += 1
                if "" in node and cost[start] - self.scores[node[""]] < cost[end]:
                    cost[end], back[end] = cost[start] - self.scores[node[""]], start
        out = []
        while n > 0:
            out.append(segment[back[n] : n])
            n = back[n]
        return out[::-1]

    def _remember(self, segment: str) -> bytes:
        """The path of a segment that is not among the latest; what was used since the last turn stays for the next."""
        if (ids := self.older.get(segment)) is None:
            ids = array("i", self.path(segment)).tobytes()
        if len(segment) <= REMEMBERED_CHARS:
            if len(self.seen) >= REMEMBERED:
                self.older, self.seen = self.seen, {}
            self.seen[segment] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text; a run of characters without a piece and without byte pieces is one unknown piece."""
        found = self.segments.findall(self.normalise(text))
        remember = self._remember
        ids = np.frombuffer(b"".join([self.seen.get(s) or remember(s) for s in found]), np.int32)
        if not self.bytes and len(ids):
            ids = ids[np.append(True, (ids[1:] != self.unknown) | (ids[:-1] != self.unknown))]
        return ids

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: markers become spaces, byte pieces their bytes (as UTF-8), and the space put first goes."""
        out = b"".join(map(self._bytes_of().__getitem__, ids.tolist())).decode(errors="replace")
        return out[1:] if self.dummy and out.startswith(" ") else out

    @lru_cache(maxsize=1)  # noqa: B019 - transducers live as long as their worker
    def _bytes_of(self) -> list[bytes]:
        surface = {BYTE: lambda p: bytes([int(p[1:-1], 16)]), UNKNOWN: lambda p: " ⁇ ".encode(), CONTROL: lambda p: b""}
        plain = lambda p: p.replace(MARK, " ").encode()
        return [surface.get(k, plain)(p) for p, k in zip(self.pieces, self.kinds, strict=True)]


@lru_cache(maxsize=4)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def _with(df: DataFrame, keep: tuple[str, ...], column: Column) -> tuple[DataFrame, str]:
    """The columns to keep and last another one, with a name of its own."""
    kept = df.select(*(F.col(quoted(c)) for c in keep))
    (name,) = fresh(kept, "content")
    return df.select(*(F.col(quoted(c)) for c in keep), column.alias(name)), name


def encode(docs: DataFrame, model: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns with n_pieces, ids (array<int>), ids_sha256 (of the ids as little-endian 32-bit numbers) and
    round_trip: whether decoding gives the text back. Columns to keep may have any names but these four.

    Null and empty texts have no pieces. A text with U+2581 does not round-trip, since that is the marker. Texts of any
    length are encoded whole. Rows are independent, repeated ones too; an empty table gives no rows. `model` is the path
    of the model file on the executors.
    """
    kept, body = _with(docs, keep, docs[quoted(text)])
    schema = StructType(kept.schema.fields[:-1]).add("n_pieces", "long").add("ids", ArrayType(IntegerType())).add("ids_sha256", "string").add("round_trip", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # ids take more room than their texts
                part = batch.slice(at, 512)
                ids, digests, same = [], [], []
                for t in texts_of(part, body):
                    ids.append(machine.encode(t))
                    digests.append(hashlib.sha256(ids[-1].astype("<i4", copy=False)).hexdigest())
                    same.append(machine.decode(ids[-1]) == t)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(i) for i in ids])), pa.int32()), pa.array(np.concatenate(ids)))
                columns = [*part.columns[:-1], pc.list_value_length(lists).cast(pa.int64()), lists, pa.array(digests), pa.array(same)]
                yield pa.RecordBatch.from_arrays(columns, [*keep, "n_pieces", "ids", "ids_sha256", "round_trip"])

    return map_streams(kept, run, schema)


def decode(encoded: DataFrame, model: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns and the text that their ids decode to; null and empty ids give the empty text, rows are
    independent."""
    kept, body = _with(encoded, keep, encoded[quoted(ids)].cast("array<int>"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        machine = transducer(model)
        texts = [machine.decode(np.array(i or [], np.int32)) for i in batch.column(body).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*keep, "text"])

    return map_batches(kept, run, StructType(kept.schema.fields[:-1]).add("text", "string"))
