"""Secret scans through nested encodings.

A worklist holds the layers of a text: the text itself, and what its URL escapes, Unicode escapes, base64 runs and
compressed runs unwrap to. Each layer is scanned and may unwrap to further ones, until nothing new comes; a layer that
was seen before with the same places in the original is not entered again. Every layer knows, by runs of code points, which
span of the original text each comes from.
"""

from __future__ import annotations

import base64
import binascii
import codecs
import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts_of

KINDS = ("assign", "access", "hex")
#: What a compressed run unwraps to at a time, so that no run can fill an executor's memory; pieces overlap by half.
MAX_UNPACKED = 64 << 20

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_NAMES = ("passw", "secret", "token", "apikey", "api_key")
# a maximal run that is too short holds no match of the length asked for, so the length can stand in the pattern
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")

_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_MORE = re.compile(r"\r?\n[\x20\t]*([A-Za-z0-9+/_-]+={0,2})")
_SAFE = str.maketrans("-_", "+/")


@dataclass(slots=True)
class Layer:
    """A text and where it comes from: all of it from one span of the original (whole), or by runs of code points.

    A run has the place where it begins in the layer, that in the original, how far its code points are apart there and
    how wide they are; without runs the layer is the original. A stretch of plain text is one run, however long.
    """

    text: str
    runs: np.ndarray | None = None
    whole: tuple[int, int] | None = None

    def span(self, start: int, end: int) -> tuple[int, int]:
        if self.whole:
            return self.whole
        return (start, end) if self.runs is None else (self._place(start)[0], self._place(end - 1)[1])

    def _place(self, i: int) -> tuple[int, int]:
        at, start, step, width = self.runs[np.searchsorted(self.runs[:, 0], i, side="right") - 1].tolist()
        return start + (i - at) * step, start + (i - at) * step + width

    def key(self) -> bytes:
        """Tells layers apart by their text and where it comes from."""
        seen = hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16)
        seen.update(repr(self.whole).encode() if self.whole else b"" if self.runs is None else self.runs.tobytes())
        return seen.digest()


class _Line:
    """A line of a layer being rewritten: text that stays, and text put in place of escapes."""

    def __init__(self, layer: Layer, start: int) -> None:
        self.layer, self.at, self.length = layer, start, 0
        self.pieces: list[str] = []
        self.joined: list[str] = []
        self.runs = array("i")  # four numbers a run; no text has 2**31 code points

    def _add(self, text: str) -> None:
        self.pieces.append(text)
        self.length += len(text)
        if len(self.pieces) > 1 << 14:  # many small strings take far more room than one
            self.joined.append("".join(self.pieces))
            self.pieces.clear()

    def keep(self, end: int) -> None:
        """The layer's text up to `end` stays."""
        a, layer = self.at, self.layer
        if a < end:
            if layer.whole:
                self.runs.extend((self.length, layer.whole[0], 0, layer.whole[1] - layer.whole[0]))
            elif layer.runs is None:
                self.runs.extend((self.length, a, 1, 1))
            else:
                places = layer.runs[:, 0]
                own = layer.runs[np.searchsorted(places, a, side="right") - 1 : np.searchsorted(places, end, side="left")].copy()
                over = np.maximum(a - own[:, 0], 0)
                own[:, 1] += over * own[:, 2]
                own[:, 0] += over + self.length - a
                self.runs.frombytes(own.astype(np.int32).tobytes())
            self._add(layer.text[a:end])
        self.at = end

    def put(self, a: int, b: int, new: str, per_byte: int) -> None:
        """`new` stands for a:b; per_byte: old code points for each byte of UTF-8, 0: all of new for all of a:b."""
        self.keep(a)
        if per_byte and self.layer.runs is None and not self.layer.whole and new.isascii():
            self.runs.extend((self.length, a, per_byte, per_byte))
        else:
            here = a
            for i, c in enumerate(new) if per_byte else ((0, ""),):
                after = here + per_byte * len(c.encode()) if per_byte else b
                s, e = self.layer.span(here, after)
                self.runs.extend((self.length + i, s, 0, e - s))
                here = after
        self._add(new)
        self.at = b

    def done(self, end: int) -> Layer:
        self.keep(end)
        return Layer("".join([*self.joined, *self.pieces]), np.frombuffer(self.runs, np.int32).reshape(-1, 4).astype(np.int64))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the secrets in plain sight."""
    found = []
    low = text.lower()
    if any(name in low for name in _NAMES):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return found


def _inflated(data: bytes, most: int) -> Iterator[bytes]:
    """What gzip (all members) or zlib data unwrap to, in parts; it ends where the data do, or break."""
    while data[:2] == b"\x1f\x8b" or data[:1] == b"\x78" and len(data) > 2 and (data[0] << 8 | data[1]) % 31 == 0:
        worker = zlib.decompressobj(47)
        while data and not worker.eof:
            try:
                out = worker.decompress(data, most)
            except zlib.error:
                return
            if out:
                yield out
            elif not worker.unconsumed_tail:
                break
            data = worker.unconsumed_tail
        data = worker.unused_data


def _unpacked(data: bytes) -> Iterator[str]:
    """The text of gzip or zlib data, in pieces of MAX_UNPACKED bytes that overlap by half; bytes that are not UTF-8 count
    as Latin-1."""
    half = max(1, MAX_UNPACKED // 2)
    decoder, before, held, size = codecs.getincrementaldecoder("utf-8")("heronry-latin"), "", [], 0
    for out in _inflated(data, half):
        held.append(decoder.decode(out))
        size += len(out)
        if size >= half:
            piece = "".join(held)
            yield before + piece
            before, held, size = piece, [], 0
    if any(held):
        yield before + "".join(held)


#: Bytes of ASCII text.
_ASCII = bytes([9, 10, 12, 13, *range(32, 127)])


def _latin(error: UnicodeError) -> tuple[str, int]:
    return error.object[error.start : error.end].decode("latin-1"), error.end


codecs.register_error("heronry-latin", _latin)


def _text(data: bytes) -> str | None:
    """Bytes as text: UTF-16 where every second byte is zero nearly throughout, else UTF-8; what is neither counts as
    Latin-1 if three quarters of it are ASCII text, and else as no text."""
    if b"\0" in data and len(data) % 2 == 0:
        for first, name in ((1, "utf-16-le"), (0, "utf-16-be")):
            if 20 * data[first::2].count(0) >= 9 * len(data):
                return data.decode(name, "replace")
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode(errors="heronry-latin") if 4 * len(data.translate(None, _ASCII)) <= len(data) else None


def _runs(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, digits) of base64: runs within a line, and runs joined over line breaks.

    Which lines belong together is not known: each stretch of lines of one width is tried, with and without the line
    before it, which may begin after other text, and the line after it if that is shorter; so are all lines at once.
    """
    done = -1
    for m in _BASE64.finditer(text):
        yield *m.span(), m[0].rstrip("=")
        if m.start() < done:
            continue
        lines = [m.span()]
        while not text[lines[-1][0] : lines[-1][1]].endswith("=") and (more := _MORE.match(text, lines[-1][1])):
            lines.append(more.span(1))
        done = lines[-1][1]
        if len(lines) == 1:
            continue
        parts = [text[a:b].rstrip("=") for a, b in lines]
        widths, tried = [len(p) for p in parts], {(0, len(lines))}
        first = 0
        for at in range(1, len(lines) + 1):
            if at == len(lines) or widths[at] != widths[first]:
                shorter = at < len(lines) and widths[at] < widths[first]
                tried |= {(a, b) for a in (max(0, first - 1), first) for b in (at, at + shorter) if b - a > 1}
                first = at
        for a, b in sorted(tried):
            yield lines[a][0], lines[b - 1][1], "".join(parts[a:b])


def _rewritten(layer: Layer, parts: Iterator[tuple[int, int, str, int]]) -> Iterator[Layer]:
    """The lines that hold parts (start, end, new text, per_byte as in `_Line.put`), each with its own put in."""
    line, end = None, -1
    for a, b, new, per_byte in parts:
        if a >= end:
            if line:
                yield line.done(end)
            line, end = _Line(layer, layer.text.rfind("\n", 0, a) + 1), layer.text.find("\n", b)
            end = len(layer.text) if end < 0 else end
        line.put(a, b, new, per_byte)
    if line:
        yield line.done(end)


def _url_parts(text: str) -> Iterator[tuple[int, int, str, int]]:
    for m in _URL.finditer(text):
        if (new := _text(bytes.fromhex(m[0].replace("%", "")))) is not None:
            yield *m.span(), new, 3


def _unicode_parts(text: str) -> Iterator[tuple[int, int, str, int]]:
    high = None
    for m in _UNICODE.finditer(text):
        code = int(m[m.lastindex], 10 if m.lastindex == 6 else 16)
        if high and m.lastindex == 2 and 0xDC00 <= code < 0xE000 and high.end() == m.start():
            yield high.start(), m.end(), chr(0x10000 + (int(high[2], 16) - 0xD800 << 10) + code - 0xDC00), 0
            high = None
            continue
        high = m if m.lastindex == 2 and 0xD800 <= code < 0xDC00 else None
        if code < 0x110000 and not 0xD800 <= code < 0xE000:
            yield *m.span(), chr(code), 0


def _unwrap(layer: Layer) -> Iterator[Layer]:
    text = layer.text
    if "%" in text:
        yield from _rewritten(layer, _url_parts(text))
        for m in _URL.finditer(text):
            if m[0][1:3] in ("1f", "1F", "78"):  # as compressed data begin
                for new in _unpacked(bytes.fromhex(m[0].replace("%", ""))):
                    yield Layer(new, whole=layer.span(*m.span()))
    if "\\" in text or "&#" in text:
        yield from _rewritten(layer, _unicode_parts(text))
    for start, end, run in _runs(text):
        if len(run) % 4 == 1:
            continue
        try:
            data = base64.b64decode(run.translate(_SAFE) + "=" * (-len(run) % 4))
        except binascii.Error:
            continue
        for new in _unpacked(data):
            yield Layer(new, whole=layer.span(start, end))
        if new := _text(data):
            yield Layer(new, whole=layer.span(start, end))


def spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans) of a text of any length, by start, then kind as listed, then end; an empty text has none.
    Equal secrets at different places are spans of their own."""
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    base = sorted(base_spans(text), key=order)
    found = set(base)
    seen = set()
    todo = [_unwrap(Layer(text))]
    while todo:  # the layers that lead to one at a time, so that not all pieces of a large one are held
        if (child := next(todo[-1], None)) is None:
            todo.pop()
        elif (key := child.key()) not in seen:
            seen.add(key)
            found.update((kind, *child.span(a, b)) for kind, a, b in base_spans(child.text))
            todo.append(_unwrap(child))
    return base, sorted(found, key=order)


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in found)


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row; spans in code points, end exclusive.

    The counts and the digest are those of the base spans; spans also holds what was found in unwrapped layers, as the
    span of the original that encodes it. Null and empty texts have no spans; texts of any length are scanned whole.
    Rows are independent, repeated ones too; further columns are not looked at, and an empty table gives no rows.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: list[list[int]] = [[], [], []]
        digests, texts = [], []
        for t in texts_of(batch):
            base, every = spans(t)
            kinds = [s[0] for s in base]
            for column, kind in zip(counts, KINDS, strict=True):
                column.append(kinds.count(kind))
            digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            texts.append(joined(every))
        columns = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_batches(rows, run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
