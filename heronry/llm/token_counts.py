"""Token counts of a byte-level BPE vocabulary by rank-synchronous merging of ragged arrays.

The pre-tokens of a batch that have not been seen lately lie end to end in one numpy array. In each round every
sequence finds its pair of lowest rank, and all sequences apply theirs at once; sequences without a mergeable pair
leave the array, and the symbols they have left are their token count.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts_of

#: How the vocabulary's library splits text before it merges (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LIMIT = 512
#: Pre-tokens whose counts a worker remembers; longer ones than REMEMBERED_CHARS are counted anew each time.
REMEMBERED, REMEMBERED_CHARS = 400_000, 48
_NONE = np.int64(1 << 40)


def _byte_symbols() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes: a byte stands for itself if Latin-1 prints it, others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class RankMerger:
    """The merges of a vocabulary file as sorted arrays of pair keys, ranks and results."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"]:
            raise ValueError("only byte-level BPE without a normaliser or a prefix space is supported")
        vocab = model["vocab"]
        self.size = max(vocab.values()) + 1
        self.of_byte = np.zeros(256, np.int64)
        for char, byte in _byte_symbols().items():
            self.of_byte[byte] = vocab[char]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.results = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.split = regex.compile(PATTERN)
        self.seen: dict[str, int] = {}

    def merge(self, words: list[bytes]) -> np.ndarray:
        """How many symbols each byte string has after all its merges."""
        counts = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), counts)
        while len(symbols) > 1:
            key = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            joins = (self.keys[at] == key) & (owner[:-1] == owner[1:])
            rank = np.append(np.where(joins, self.ranks[at], _NONE), _NONE)
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lengths = np.diff(np.append(starts, len(owner)))
            least = np.minimum.reduceat(rank, starts)
            chosen = (rank == np.repeat(least, lengths)) & (rank < _NONE)
            picked = np.flatnonzero(chosen)
            if not len(picked):
                break
            # of a run of overlapping pairs (aaaa) every second one merges, from the left
            new_run = np.append(True, np.diff(picked) > 1)
            run_start = np.maximum.accumulate(np.where(new_run, picked, 0))
            picked = picked[(picked - run_start) % 2 == 0]
            symbols[picked] = self.results[at[picked]]
            np.subtract.at(counts, owner[picked], 1)
            keep = np.repeat(least < _NONE, lengths)
            keep[picked + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return counts

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text; the vocabulary's special strings in it count one each."""
        split, seen = self.split.findall, self.seen
        pieces, extra = [], []
        for text in texts:
            parts = self.special.split(text) if self.special else [text]
            extra.append(len(parts) - 1)
            pieces.append(split(text) if len(parts) == 1 else [p for part in parts for p in split(part)])
        new = list(set().union(*pieces).difference(seen))
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            seen.update(zip(part, self.merge([w.encode() for w in part]).tolist(), strict=True))
        found = [sum(map(seen.__getitem__, p)) + e for p, e in zip(pieces, extra, strict=True)]
        if len(seen) > REMEMBERED:
            seen.clear()
        for word in new:
            if len(word) > REMEMBERED_CHARS:
                seen.pop(word, None)
        return found


@lru_cache(maxsize=4)
def merger(path: str) -> RankMerger:
    return RankMerger(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than `limit` tokens) of every row.

    Null and empty texts have 0 bytes and 0 tokens; texts of any length are counted whole. Rows are independent: repeated
    ones and null identifiers are returned as they are, and an empty table gives no rows. Further columns are not looked at. `vocabulary` is the path of the vocabulary file on the
    executors.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        count, found, part = merger(vocabulary).counts, [], []
        for t in texts_of(batch):
            part.append(t)
            if len(part) == 256:
                found += count(part)
                part = []
        tokens = pa.array(found + count(part), pa.int64())
        size = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), size, tokens, pc.greater(tokens, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_batches(rows, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
