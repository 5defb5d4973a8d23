"""Language-model scores by a probabilistic suffix tree over words.

The tree's root is the add-one distribution of single words. A context of d words is a candidate if it occurs MIN_COUNT
times at least, its last d - 1 words are a state and its first d - 1 words a candidate. It is a state if its next-word
distribution diverges from its suffix's: the mean log-ratio of the two, each occurrence scored by the counts without
itself, is MIN_DIVERGENCE at least. A state's
distribution is its counts smoothed by its suffix's distribution, and a word is scored by the longest suffix of what
stands before it that is a state.

No table of the tree is ever held whole. The corpus is cut into blocks of about BLOCK_TOKENS tokens, which stay where
they were written. For each depth, a block sends its distinct n-grams (as hashes, with their counts in training
rows) to buckets of the hash space, and each bucket answers every block with the corpus-wide counts of just what it
asked for. What is sent is in proportion to the corpus, every key is pre-aggregated by block, and no bucket can be made
hot by a frequent word. From KEPT_DEPTH on a block keeps its documents' sums and only those positions whose contexts may
go deeper; the depth ends at MAX_DEPTH words, the tree's order, or where no context is left.
"""

from __future__ import annotations

import itertools
import math
import pickle
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, fold, shuffles_removed, texts_of, written

HOLD_MODULUS, HELD_OUT = 7, 2
MAX_DEPTH = 6
MIN_COUNT = 8
#: Nats that a state's distribution must gain over its suffix's, per occurrence.
MIN_DIVERGENCE = 0.02
#: Pseudo-counts that the suffix's distribution has in a state's.
STRENGTH = 400.0
BLOCK_TOKENS = 1 << 20
#: Keys that a bucket is meant to get.
BUCKET_KEYS = 2 << 20

#: Bits behind the point that a log-probability keeps between depths.
LOG_BITS = 36

#: Words and n-grams are told apart by so many bits: of 10**12 of them, one in 70 000 shares its key with another.
HASH_BITS = 56
_CUT = np.uint64(64 - HASH_BITS)

_START, _END = (np.uint64(xxhash.xxh64_intdigest(b)) >> _CUT for b in (b" start", b" end"))  # no word has white space
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))  # splitmix64 (fixed values)

#: The depth from which on blocks keep their states; up to there nearly every word is active, and answers are smaller.
KEPT_DEPTH = 3

#: Where a pass's rows hold no question but the block's state.
_KEPT = -1
_BLOCK = "block long, tokens binary, vocabulary binary, lengths binary, training binary, doc_ids binary, n_tokens long, n_training long"
_ASK = "block long, bucket int, keys binary, amounts binary"
_PASS = f"{_ASK}, state binary, n_active long"
_ANSWER = "block long, step int, bucket int, totals binary, flags binary, n_distinct long"


def _hash_pair(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    x = context * _MIX[0] + word
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return (x ^ (x >> np.uint64(31))) >> _CUT


def _pack(a: np.ndarray, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(a.tobytes())


def _unpack(b: bytes, dtype: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype)


def _pack_bits(flags: np.ndarray) -> bytes:
    return _pack(np.packbits(flags))


def _unpack_bits(b: bytes, n: int) -> np.ndarray:
    return np.unpackbits(_unpack(b, np.uint8), count=n).astype(bool)


def _pack_planes(a: np.ndarray, level: int = 1) -> bytes:
    """Numbers byte by byte: all their first bytes, then all their second ones, of which many are alike."""
    return _pack(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T), level)


def _unpack_planes(b: bytes, dtype: str) -> np.ndarray:
    return np.ascontiguousarray(_unpack(b, np.uint8).reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def _pack_counts(a: np.ndarray) -> bytes:
    return _pack_planes(a.astype("<u8"))


def _unpack_counts(b: bytes) -> np.ndarray:
    return _unpack_planes(b, "<u8").astype(np.float64)


def _pack_gains(a: np.ndarray) -> bytes:
    """Half precision does: a gain is held against a threshold."""
    return _pack_planes(np.clip(a, -6e4, 6e4).astype("<f2"))


def _unpack_gains(b: bytes) -> np.ndarray:
    return _unpack_planes(b, "<f2").astype(np.float64)


def _pack_sorted(keys: np.ndarray) -> bytes:
    """Numbers as their differences (modulo 2**64), whose upper bytes are nearly all zero where they rise."""
    return _pack_planes(np.diff(keys, prepend=np.uint64(0)).astype("<u8"))


def _unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(_unpack_planes(b, "<u8"), dtype=np.uint64)


def _blocks(batches: Iterator[pa.RecordBatch], block_tokens: int) -> Iterator[pa.RecordBatch]:
    """Documents as numbers of a block's own vocabulary, in which 0 is the start and 1 the end of a text."""
    names = [f.split()[0] for f in _BLOCK.split(", ")]

    def fresh() -> tuple:
        number = defaultdict(itertools.count(2).__next__)
        return number, [], [], [], []

    number, tokens, lengths, training, ids = fresh()
    held, serial = 0, itertools.count()

    def close() -> pa.RecordBatch:
        hashes = np.array([_START, _END, *(np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number)) >> _CUT)], np.uint64)
        flat, size, trained = np.concatenate(tokens), np.array(lengths, np.int64), np.array(training, bool)
        # by how often words occur, and by hash among equals: differences of these are small
        order = np.append([0, 1], 2 + np.lexsort((hashes[2:], -np.bincount(flat, minlength=len(hashes))[2:])))
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        row = {
            "block": xxhash.xxh64_intdigest(f"{TaskContext.get().partitionId()}/{next(serial)}") >> 1, "tokens": _pack_planes(rank[flat], 9), "vocabulary": _pack_sorted(hashes[order]), "lengths": _pack(size), "training": _pack(trained),
            "doc_ids": _pack(np.array([(i or 0, i is None) for i in ids], np.int64)), "n_tokens": int(size.sum()), "n_training": int(size[trained].sum()),
        }
        return pa.RecordBatch.from_pylist([row], pa.schema([(n, pa.int64() if n in ("block", "n_tokens", "n_training") else pa.binary()) for n in names]))

    for batch in batches:
        for doc_id, trained, text in zip(batch.column("doc_id").to_pylist(), batch.column("trained").to_pylist(), texts_of(batch), strict=True):
            words = text.encode().translate(_LOWER).split()
            tokens.append(np.array([*map(number.__getitem__, words), 1], np.int32))
            lengths.append(len(words) + 1)
            training.append(trained)
            ids.append(doc_id)
            held += len(words) + 1
            if held >= block_tokens:
                yield close()
                number, tokens, lengths, training, ids = fresh()
                held = 0
    if ids:
        yield close()


def _renumbered(numbers: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(those of 0..n-1 that occur, each number's place among them)."""
    seen = np.zeros(n, bool)
    seen[numbers] = True
    return np.flatnonzero(seen), (np.cumsum(seen) - 1)[numbers].astype(np.int32)


@dataclass
class _State:
    """One block at one depth: its documents with the log-probabilities of their settled words, and the active positions:
    those whose context of this depth is a candidate."""

    # by document
    doc_ids: np.ndarray
    training: np.ndarray
    lengths: np.ndarray
    n_known: np.ndarray
    base: np.ndarray
    settled: np.ndarray
    # by active position, rising: the word (-1: not in training rows), the context, the n-gram of both (-1: unknown
    # word) and the log-probability so far
    position: np.ndarray
    word: np.ndarray
    context: np.ndarray
    gram: np.ndarray
    log: np.ndarray
    # of words and contexts in use
    vocabulary: np.ndarray
    keys: np.ndarray
    counts: np.ndarray

    @classmethod
    def root(cls, row: dict, counted: np.ndarray, numbers: dict) -> _State:
        """Depth 1: every word has its probability at the root, and the word before it as a context."""
        tokens, vocabulary = _unpack_planes(row["tokens"], "<i4"), _unpack_sorted(row["vocabulary"])
        lengths, training = _unpack(row["lengths"], np.int64), _unpack(row["training"], bool)
        first = np.cumsum(lengths) - lengths
        counts = np.empty(len(vocabulary))
        counts[np.argsort(vocabulary)] = counted
        log = np.log((counts + 1) / (numbers["tokens"] + numbers["words"] + 1))[tokens]
        known = counts[tokens] > 0
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[first] = 0
        active = np.flatnonzero(counts[before] >= numbers["min_count"])
        total = lambda x: np.add.reduceat(x, first)
        state = cls(
            _unpack(row["doc_ids"], np.int64).reshape(-1, 2), training, lengths, total(known.astype(np.int64)), total(log), np.zeros(len(lengths)),
            np.arange(len(tokens), dtype=np.uint32), np.where(known, tokens, -1), before, np.zeros(0, np.int32), log, vocabulary, vocabulary, counts,
        )
        return state._left(active, before[active])

    def documents(self) -> np.ndarray:
        """The document of each active position."""
        return np.searchsorted(np.cumsum(self.lengths), self.position, side="right")

    def _left(self, active: np.ndarray, context: np.ndarray) -> _State:
        """With these active positions and their contexts (numbers of keys); the words of others are settled."""
        done = np.ones(len(self.position), bool)
        done[active] = False
        settled = self.settled + np.bincount(self.documents()[done], self.log[done], len(self.lengths))
        used, context = _renumbered(context, len(self.keys))
        word = self.word[active]
        known = word >= 0
        words, word[known] = _renumbered(word[known], len(self.vocabulary))
        return replace(
            self, settled=settled, position=self.position[active], word=word, context=context, gram=np.zeros(0, np.int32), log=self.log[active],
            vocabulary=self.vocabulary[words], keys=self.keys[used], counts=self.counts[used],
        )

    def packed(self) -> bytes:
        """As bytes; log-probabilities to LOG_BITS bits behind the point. Keys rise; n-grams are left out, since `grams`
        numbers them alike again."""
        moved = self.__dict__ | {"position": np.diff(self.position, prepend=np.uint32(0)), "keys": np.diff(self.keys, prepend=np.uint64(0)), "gram": np.zeros(0, np.int32), "log": np.rint(self.log * -(2.0**LOG_BITS)).astype(np.int64)}
        return pickle.dumps([(name, a.dtype.str, a.shape, _pack_planes(a.ravel()) if a.size else b"") for name, a in moved.items()])

    @classmethod
    def unpacked(cls, data: bytes) -> _State:
        """A state of `packed`; the bytes come from the tasks of the pass before."""
        found = {name: (_unpack_planes(b, dtype) if b else np.zeros(0, dtype)).reshape(shape) for name, dtype, shape, b in pickle.loads(data)}  # noqa: S301
        found |= {"position": np.cumsum(found["position"], dtype=np.uint32), "keys": np.cumsum(found["keys"], dtype=np.uint64), "log": found["log"] / -(2.0**LOG_BITS)}
        return cls(**found)

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct n-grams of active positions with words that are known, and how often training rows have them."""
        asked = np.flatnonzero(self.word >= 0)
        key = _hash_pair(self.keys[self.context[asked]], self.vocabulary[self.word[asked]])
        order = np.argsort(key)
        key = key[order]
        new = np.append(True, key[1:] != key[:-1])[: len(key)]
        gram = np.empty(len(key), np.int32)
        gram[order] = np.cumsum(new) - 1
        self.gram = np.full(len(self.word), -1, np.int32)
        self.gram[asked] = gram
        trained = self.training[self.documents()[asked]]
        return key[new], np.bincount(gram, trained, int(new.sum()))

    def samples(self) -> np.ndarray:
        """An active position of each n-gram."""
        at = np.flatnonzero(self.gram >= 0)
        out = np.zeros(int(self.gram.max(initial=-1)) + 1, np.int64)
        out[self.gram[at]] = at
        return out

    def gains(self, totals: np.ndarray, owned: np.ndarray, numbers: dict) -> tuple[np.ndarray, np.ndarray]:
        """By context (in the order of the keys): what its counts tell more than its suffix, over the n-grams that this
        block owns."""
        own = np.flatnonzero(owned & (totals > 0))
        where, n, k = self.samples()[own], totals[own], numbers["strength"]
        context, log = self.context[where], self.log[where]
        gain = n * (np.log((n - 1 + k * np.exp(log)) / (self.counts[context] - 1 + k)) - log)
        order = np.argsort(self.keys)
        return self.keys[order], (np.bincount(context, gain, len(self.keys)) / self.counts)[order]

    def descend(self, totals: np.ndarray, is_state: np.ndarray, numbers: dict) -> _State:
        """Scores by the states of this depth, and the positions that go deeper: their context is a state, and with the
        word before it a frequent n-gram."""
        state = np.zeros(len(self.keys), bool)
        state[np.argsort(self.keys)] = is_state
        n, k = np.append(totals, 0.0)[self.gram], numbers["strength"]
        here = state[self.context]
        log = self.log.copy()
        log[here] = np.log((n[here] + k * np.exp(log[here])) / (self.counts[self.context[here]] + k))
        follows, document = np.zeros(len(here), bool), self.documents()
        follows[1:] = (np.diff(self.position) == 1) & (document[1:] == document[:-1]) & (n[:-1] >= numbers["min_count"])
        active = np.flatnonzero(follows & here)
        at = self.samples()
        keys = _hash_pair(self.keys[self.context[at]], self.vocabulary[self.word[at]])
        return replace(self, log=log, keys=keys, counts=totals)._left(active, self.gram[active - 1])

    def scores(self, numbers: dict) -> pa.Table:
        return pa.table(
            {
                "doc_id": pa.array(self.doc_ids[:, 0], mask=self.doc_ids[:, 1] > 0), "held_out": ~self.training, "n_tokens": self.lengths,
                "n_known": self.n_known, "train_tokens": np.full(len(self.lengths), int(numbers["tokens"])),
                "base_score": self.base / math.log(10), "score": (self.settled + np.bincount(self.documents(), self.log, len(self.lengths))) / math.log(10),
            }
        )


def _answers(table: pa.Table, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(totals, flags) of a block's questions of a step, in the order of the keys."""
    rows = sorted((r for r in table.select(["step", "bucket", "totals", "flags"]).to_pylist() if r["step"] == step), key=lambda r: r["bucket"])
    none = np.zeros(0)
    totals = [_unpack_counts(r["totals"]) for r in rows]
    flags = [_unpack_bits(r["flags"], len(t)) for r, t in zip(rows, totals, strict=True)]
    return np.concatenate([none, *totals]), np.concatenate([none.astype(bool), *flags])


def _questions(block: int, keys: np.ndarray, amounts: np.ndarray, buckets: int, pack) -> list[tuple]:
    """Rows of _ASK, by the upper bits of the rising keys, so that buckets in order are keys in order."""
    bucket = ((keys >> np.uint64(HASH_BITS - 32)) * np.uint64(buckets)) >> np.uint64(32)
    edges = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
    return [(block, b, _pack_sorted(keys[edges[b] : edges[b + 1]]), pack(amounts[edges[b] : edges[b + 1]])) for b in np.flatnonzero(np.diff(edges)).tolist()]


def _asked(rows: list[tuple], names: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in names.split(", ")]
    columns = zip(*rows, strict=True) if rows else ((),) * len(fields)
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _asks_words(buckets: int):
    """Step 0: how often each word is in training rows; the start of a text counts for its rows."""

    def run(blocks: pa.Table) -> pa.Table:
        out = []
        for row in blocks.to_pylist():
            tokens, vocabulary = _unpack_planes(row["tokens"], "<i4"), _unpack_sorted(row["vocabulary"])
            lengths, training = _unpack(row["lengths"], np.int64), _unpack(row["training"], bool)
            counts = np.bincount(tokens[np.repeat(training, lengths)], minlength=len(vocabulary))
            counts[0] = training.sum()
            order = np.argsort(vocabulary)
            out += _questions(row["block"], vocabulary[order], counts[order].astype(np.float64), buckets, _pack_counts)
        return _asked(out, _ASK)

    return run


def _opened(block: pa.Table, answers: pa.Table, depth: int, numbers: dict) -> _State:
    """A block at `depth` with its n-grams: its state, or, where none is kept, the block itself taken down from the root
    by the answers so far."""
    row = block.to_pylist()[0]
    if "state" in row:
        state = _State.unpacked(row["state"])
        state.grams()
        return state
    state = _State.root(row, _answers(answers, 0)[0], numbers)
    for d in range(1, depth):
        state.grams()
        state = state.descend(_answers(answers, 2 * d - 1)[0], _answers(answers, 2 * d)[1], numbers)
    state.grams()
    return state


def _below(block: pa.Table, answers: pa.Table, depth: int, numbers: dict) -> _State:
    """A block one depth on from `depth`, by the answers to that."""
    return _opened(block, answers, depth, numbers).descend(_answers(answers, 2 * depth - 1)[0], _answers(answers, 2 * depth)[1], numbers)


def _asks_grams(depth: int, buckets: int, numbers: dict):
    """The odd steps: the n-grams of this depth, and from KEPT_DEPTH on the block's state."""

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        if block.num_rows:
            name = block["block"][0].as_py()
            state = _opened(block, answers, 1, numbers) if depth == 1 else _below(block, answers, depth - 1, numbers)
            out = [(*q, None, 0) for q in _questions(name, *state.grams(), buckets, _pack_counts)]
            if depth >= KEPT_DEPTH:
                out.append((name, _KEPT, None, None, state.packed(), len(state.position)))
        return _asked(out, _PASS)

    return run


def _asks_gains(depth: int, buckets: int, numbers: dict):
    """The even steps: which contexts of this depth are states."""

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        if block.num_rows:
            found = _opened(block, answers, depth, numbers).gains(*_answers(answers, 2 * depth - 1), numbers)
            out = _questions(block["block"][0].as_py(), *found, buckets, _pack_gains)
        return _asked(out, _ASK)

    return run


def _asks_states(step: int) -> bool:
    """Whether blocks send what contexts gain, and ask which are states; else they send and ask for counts."""
    return step > 0 and step % 2 == 0


def _totals(step: int, min_divergence: float):
    """A bucket's answers to each block: the totals of its keys and which of them it owns (each key has one owner), or
    whether its contexts are states."""

    def run(asked: pa.Table) -> pa.Table:
        asked = asked.sort_by("block")  # sums come out alike in every run
        blocks, buckets = asked["block"].to_pylist(), asked["bucket"].to_pylist()
        parts = [_unpack_sorted(k) for k in asked["keys"].to_pylist()]
        unpack = _unpack_gains if _asks_states(step) else _unpack_counts
        keys, amounts = np.concatenate(parts), np.concatenate([unpack(a) for a in asked["amounts"].to_pylist()])
        order = np.argsort(keys, kind="stable")
        new = np.append(True, np.diff(keys[order]) != 0)
        starts = np.flatnonzero(new)
        sums = np.add.reduceat(amounts[order], starts)
        each, totals, flags = np.cumsum(new) - 1, np.zeros(len(keys)), np.zeros(len(keys), bool)
        if _asks_states(step):
            flags[order] = (sums >= min_divergence)[each]
        else:
            totals[order] = sums[each]
            flags[order[starts]] = True
        words = int(((sums > 0) & (keys[order[starts]] != _START)).sum())
        edges = np.append(0, np.cumsum([len(p) for p in parts]))
        rows = []
        for i in range(len(parts)):
            own = slice(edges[i], edges[i + 1])
            rows.append((blocks[i], step, buckets[i], _pack_counts(totals[own]), _pack_bits(flags[own]), words if i == 0 else 0))
        types = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["block", "step", "bucket", "totals", "flags", "n_distinct"])

    return run


def scores(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", depth: int = MAX_DEPTH, min_count: int = MIN_COUNT,
    min_divergence: float = MIN_DIVERGENCE, strength: float = STRENGTH, bucket_keys: int = BUCKET_KEYS, block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of `docs`.

    The tree learns from the rows whose crc32(doc_id) mod 7 is not 2, whole texts; score is its log10 probability of
    the text's words and end, base_score that of the root alone. A null or empty text is its end alone; repeated rows
    count and are scored each; a null doc_id counts as the empty text in the fold. Without training rows every word is
    unknown. An empty table gives no rows.

    Texts of any length are scored whole; further columns are not looked at. Words and n-grams are told apart by
    HASH_BITS bits. Blocks and answers lie in bucketed tables of the warehouse, so that no step shuffles what an earlier
    one has; they are dropped once used.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), (fold(doc_id, HOLD_MODULUS) != HELD_OUT).alias("trained"))
    parts = 4 * spark.sparkContext.defaultParallelism  # a block is a task's unit, a bucket a few of them
    call, tables = uuid.uuid4().hex, []

    def kept(df: DataFrame, name: str) -> DataFrame:
        """Written as a table whose rows are dealt by block, once, for all steps that follow."""
        tables.append(f"{name}_{call}")
        with shuffles_removed(spark):
            df.write.mode("append").bucketBy(parts, "block").option("compression", "none").saveAsTable(tables[-1])
        return spark.table(tables[-1])

    def dropped(*names: str) -> None:
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}_{call}")

    def answered(asked: DataFrame, step: int, depth: int) -> DataFrame:
        answers = asked.groupBy("bucket").applyInArrow(_totals(step, min_divergence), _ANSWER)
        return kept(answers.repartition(parts, "block"), f"answers{max(depth, KEPT_DEPTH - 1)}")

    try:
        left = kept(rows.mapInArrow(lambda batches: _blocks(batches, block_tokens), _BLOCK), "blocks")
        total, training = left.agg(F.sum("n_tokens"), F.sum("n_training")).first()
        buckets = max(1, math.ceil((total or 0) / bucket_keys))
        numbers = {"tokens": float(training or 0), "words": 0.0, "min_count": min_count, "min_divergence": min_divergence, "strength": strength}
        left = left.select("block", "tokens", "vocabulary", "lengths", "training", "doc_ids")
        answers = answered(left.groupBy("block").applyInArrow(_asks_words(buckets), _ASK), 0, 0)
        numbers["words"] = float(answers.agg(F.sum("n_distinct")).first()[0] or 0)
        together = lambda f, schema: left.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(f, schema)
        for d in range(1, depth + 1):
            asked = together(_asks_grams(d, buckets, dict(numbers)), _PASS)
            if d >= KEPT_DEPTH:
                passed = kept(asked, f"pass{d}")
                dropped("blocks", f"pass{d - 1}", f"answers{d - 1}")
                left, asked = passed.filter(F.col("bucket") == _KEPT).select("block", "state"), passed.filter(F.col("bucket") != _KEPT)
                if not passed.agg(F.sum("n_active")).first()[0]:
                    answers = None
                    break
            answers = answered(asked.select("block", "bucket", "keys", "amounts"), 2 * d - 1, d)
            answers = answered(together(_asks_gains(d, buckets, dict(numbers)), _ASK), 2 * d, d)

        def last(block: pa.Table, answered: pa.Table) -> pa.Table:
            if not block.num_rows:
                return empty
            return (_below(block, answered, depth, numbers) if depth else _opened(block, answered, 1, numbers)).scores(numbers)

        def settled(block: pa.Table) -> pa.Table:
            return _State.unpacked(block["state"][0].as_py()).scores(numbers)

        empty = pa.table([pa.array([], t) for t in (pa.int64(), pa.bool_(), *(pa.int64(),) * 3, pa.float64(), pa.float64())], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
        schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
        by_block = left.groupBy("block")
        found = by_block.applyInArrow(settled, schema) if answers is None else by_block.cogroup(answers.groupBy("block")).applyInArrow(last, schema)
        return written(found, "scores")
    finally:
        for name in tables:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
