"""Toxicity by gradient-boosted trees over dense features of the text, calibrated by isotonic regression.

The features are densities: of insults (a fixed list, also in disguise) and of a lexicon learned from the labels, of the
second person and its nearness to either, of capitals, punctuation, signs, repeats and obfuscated words. The lexicon
holds beginnings of words that toxic texts have more often than chance allows, weighed by their smoothed log-odds. It is
fitted crosswise: the trees see each training text by a lexicon made without it and its part of the sample, as they will
see new texts; these get the lexicon of the whole sample.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, map_batches, removed_after, texts_of, written

THRESHOLD = 0.7
#: Distinct labelled texts that a model is fitted on at most: those of the smallest hashes.
MAX_SAMPLE = 40_000
#: Lengths of the word beginnings that may enter the lexicon, parts of the sample for cross-fitting, toxic texts that a
#: beginning must stand in, and how many beginnings are weighed at most (those in most toxic texts).
STEMS, PARTS, MIN_TEXTS, MAX_STEMS = (3, 4, 5, 6, 7), 4, 5, 50_000
#: Nats by which a beginning's share of toxic texts must tell it from chance, and the weights of its entries: the least
#: one, and those that count as strong and as sure.
MIN_EVIDENCE, LEAST, STRONG, SURE = 12.0, 1.0, 3.0, 4.0

# fixed values: insults in English and in the other languages of the corpus
INSULTS = frozenset(
    """
    arsehole asshole bastard bitch bullshit clown cretin cunt dickhead dimwit disgusting douchebag dumbass dunce faggot
    fuck fucker fucking halfwit idiot idiotic idiots imbecile jackass loathsome loser losers lowlife moron moronic
    morons motherfucker nitwit pathetic prick repulsive retard retarded scum scumbag shithead shitty simpleton skank
    slut stupid subhuman swine trash trashy twat vermin wanker whore worthless
    abschaum arschloch dummkopf mistkerl schwachkopf trottel wichser
    abruti connard connasse salaud salope
    cabrón gilipollas pendejo
    """.split()
)
# fixed values: the second person
SECOND = frozenset("you your yours yourself yourselves u ur youre thou thee dich dir du euch ihr tu toi vous votre ton ti tú usted vosotros".split())
#: What stands for a letter in disguised words (fixed values).
DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i", "+": "t", "€": "e"})

_WORD = re.compile(r"[^\W\d_]+")
# a run of letters with digits or signs within, and single letters set apart
_MIXED = re.compile(r"[^\W_]*[^\W\d_][0-9@$!|+€*._\-]+[^\W_](?:[0-9@$!|+€*._\-]*[^\W_])*|[@$!|+€0-9][^\W\d_]+(?:[0-9@$!|+€]*[^\W\d_])*")
_APART = re.compile(r"(?<![^\W_])(?:[^\W\d_] ){2,}[^\W\d_](?![^\W_])")
_CAPITALS = re.compile(r"\b[A-ZÀ-Þ]{2,}\b")
_MARKS = re.compile(r"[*._\-]")
_BEFORE, _AFTER = ".,;:'\"()?-", ".,;:'\"()?-!*"
_UPPER, _LOWER, _DIGIT, _SPACE, _STOP, _MARK, _SIGN, _OTHER = range(8)

FEATURES = (
    "insults_density", "insults_log", "disguised_density", "disguised_log", "insult_share_of_kinds", "second_density", "second_near", "capitals",
    "capital_words", "digits", "stops", "exclamations", "signs", "repeats", "mixed_density", "other", "words_log", "word_length",
    "learned_density", "learned_log", "first", "second", "third", "strong_density", "strong_log", "strong_share_of_kinds", "strong_kinds_log", "sure_kinds",
)

#: Words without weight that a worker remembers for a lexicon (twice so many), and word beginnings that it counts before it hands them on.
REMEMBERED, COUNTED = 50_000, 150_000


@dataclass
class Lexicon:
    """Weights of word beginnings; a word weighs as much as its heaviest one, 0 without any."""

    stems: dict[str, float] = field(default_factory=dict)
    light: set[str] = field(default_factory=set)
    older: set[str] = field(default_factory=set)

    def weight(self, word: str) -> float:
        return max([self.stems.get(word[:n], 0.0) for n in STEMS if n <= len(word)], default=0.0)

    def weights(self, words: set[str]) -> dict[str, float]:
        """Of the words that weigh anything."""
        new = words - self.light
        found = {w: v for w in new - self.older if (v := self.weight(w))}
        if len(self.light) > REMEMBERED:
            self.light, self.older = set(), self.light
        self.light.update(new.difference(found))
        return found

    def __reduce__(self) -> tuple:
        return Lexicon, (self.stems,)


def stems(text: str) -> set[str]:
    return {w[:n] for w in set(_WORD.findall(text.lower())) for n in STEMS if n <= len(w)}


def lexicon(names: list[str], toxic: np.ndarray, clean: np.ndarray, texts: tuple[float, float]) -> Lexicon:
    """Of beginnings with the numbers of toxic and of clean texts that have them, those whose share of toxic texts is
    above the sample's (`texts`: toxic, clean) by MIN_EVIDENCE nats of log-likelihood, with their smoothed log-odds."""
    if not min(texts):
        return Lexicon()
    p0 = texts[0] / sum(texts)
    share = toxic / np.maximum(toxic + clean, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        nats = toxic * np.log(share / p0) + np.where(clean > 0, clean * np.log((1 - share) / (1 - p0)), 0.0)
    weight = np.log((toxic + 4 * p0) / (clean + 4 * (1 - p0))) - np.log(p0 / (1 - p0))
    kept = np.flatnonzero((toxic >= MIN_TEXTS) & (share > p0) & (nats >= MIN_EVIDENCE) & (weight >= LEAST))
    return Lexicon({names[i]: float(weight[i]) for i in kept})


def _classes() -> np.ndarray:
    table = np.full(0x3000, _OTHER, np.uint8)
    for code in range(len(table)):
        c = chr(code)
        if c.isupper():
            table[code] = _UPPER
        elif c.isalpha():
            table[code] = _LOWER
        elif c.isdigit():
            table[code] = _DIGIT
        elif c.isspace():
            table[code] = _SPACE
        elif c in ".,;:'\"()-":
            table[code] = _STOP
        elif c in "!?":
            table[code] = _MARK
        elif c.isascii() and c.isprintable():
            table[code] = _SIGN
    return table


_CLASS = _classes()


def features(text: str, learned: Lexicon) -> list[float]:
    """The values of FEATURES; densities are per word or per character, disguised insults count as insults too, and an
    empty text has zeros."""
    if not text:
        return [0.0] * len(FEATURES)
    low = text.lower()
    words = _WORD.findall(low)
    n, chars = max(len(words), 1), len(text)
    kinds = set(words)
    weigh, weights = learned.weight, learned.weights(kinds)
    heavy = {w for w, v in weights.items() if v >= STRONG}
    insults = kinds & INSULTS
    hits = sum(map(insults.__contains__, words)) if insults else 0
    disguised = mixed = 0
    tokens = low.split()
    odd = [t for t in tokens if not t.isalpha() and not t.rstrip(_AFTER).lstrip(_BEFORE).isalpha()]
    for m in _MIXED.finditer(" ".join(odd)):  # no match reaches over white space, and none begins or ends with these
        mixed += 1
        bare = _MARKS.sub("", m[0]).translate(DISGUISE)
        if (bare in INSULTS or weigh(bare) >= STRONG) and not _WORD.fullmatch(m[0]):
            disguised += 1
    for m in _APART.finditer(low) if any(len(t) == 1 for t in tokens) else ():
        bare = m[0].replace(" ", "")
        disguised += bare in INSULTS or weigh(bare) >= STRONG
    hits += disguised
    second, near = 0, 0.0
    if not SECOND.isdisjoint(kinds):
        where = [i for i, w in enumerate(words) if w in SECOND]
        second = len(where)
        if bad := insults | heavy:
            at = np.searchsorted(where, own := np.array([i for i, w in enumerate(words) if w in bad]))
            there = np.array([-(10**9), *where, 10**9])
            near = 1.0 / float(np.maximum(np.minimum(own - there[at], there[at + 1] - own), 1).min())
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _CLASS[np.minimum(codes, len(_CLASS) - 1)]
    count = np.bincount(kind, minlength=8) / chars
    repeats = float((codes[2:] == codes[:-2])[codes[1:-1] == codes[:-2]].sum()) if chars > 2 else 0.0
    upper = len(_CAPITALS.findall(text))
    total, strong, first = 0.0, 0, [0.0] * 3
    if weights:
        found = [weights[w] for w in words if w in weights]
        total, strong = sum(found), sum(v >= STRONG for v in found)
        first = (sorted(weights.values(), reverse=True) + first)[:3]
    return [
        hits / n, float(np.log1p(hits)), disguised / n, float(np.log1p(disguised)), len(insults) / max(len(kinds), 1), second / n, near,
        float(count[_UPPER]), upper / n, float(count[_DIGIT]), float(count[_STOP]), float(count[_MARK]), float(count[_SIGN]), repeats / chars,
        mixed / n, float(count[_OTHER]), float(np.log1p(len(words))), sum(map(len, words)) / n,
        total / n, float(np.log1p(total)), *first, strong / n, float(np.log1p(strong)), len(heavy) / max(len(kinds), 1), float(np.log1p(len(heavy))),
        float(sum(v >= SURE for v in weights.values())),
    ]


@dataclass
class Trees:
    """Boosted regression trees of one depth on the log-odds; node i has the children 2i + 1 and 2i + 2."""

    base: float
    split_on: np.ndarray  # (trees, inner nodes): feature, -1 where rows all go left
    split_at: np.ndarray  # rows go right if above
    leaves: np.ndarray  # (trees, leaves)

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        inner, rows = self.split_on.shape[1] if len(self.split_on) else 0, np.arange(len(x))
        for on, at, leaves in zip(self.split_on, self.split_at, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            while node[0] < inner if len(node) else False:
                feature = on[node]
                node = 2 * node + 1 + ((feature >= 0) & (x[rows, feature] > at[node]))
            out += leaves[node - inner]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, shrink: float = 5.0) -> Trees:
    """Newton boosting of the logistic loss; splits at quantiles of each feature."""
    base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)])
    inner = 2**depth - 1
    on, at = np.full((rounds, inner), -1), np.zeros((rounds, inner))
    leaves, margin = np.zeros((rounds, inner + 1)), np.full(len(y), base)
    for r in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            best = np.zeros(wide)
            for f, b in enumerate(binned):
                slot = (node - first) * bins + b
                gs, hs = (np.bincount(slot, w, wide * bins).reshape(wide, bins).cumsum(1) for w in (g, h))
                gain = gs**2 / (hs + shrink) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + shrink) - gs[:, -1:] ** 2 / (hs[:, -1:] + shrink)
                gain = gain[:, : len(cuts[f])]
                if not gain.shape[1]:
                    continue
                top = gain.argmax(1)
                for i in np.flatnonzero(gain[np.arange(wide), top] > best + 1e-9):
                    best[i] = gain[i, top[i]]
                    on[r, first + i], at[r, first + i] = f, cuts[f][top[i]]
            feature = on[r][node]
            node = 2 * node + 1 + ((feature >= 0) & (x[np.arange(len(y)), feature] > at[r][node]))
        slot = node - inner
        leaves[r] = rate * np.bincount(slot, g, inner + 1) / (np.bincount(slot, h, inner + 1) + shrink)
        margin += leaves[r][slot]
    return Trees(base, on, at, leaves)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (mean score, share of positives) of each block, both rising."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([s, v, 1.0])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            s2, v2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s2, blocks[-1][1] + v2, blocks[-1][2] + n2]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


@dataclass
class Model:
    trees: Trees
    at: np.ndarray
    share: np.ndarray
    learned: Lexicon = field(default_factory=Lexicon)

    def read(self, batch: pa.RecordBatch, name: str = "text") -> np.ndarray:
        """The scores of a batch of texts."""
        x = np.array([features(t, self.learned) for t in texts_of(batch, name)]).reshape(-1, len(FEATURES))
        return self.scores(x)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities; between blocks they rise with the margin, and a small part of the margin's own
        probability keeps ranks within a block."""
        margin = self.trees.margins(x)
        return 0.98 * np.interp(margin, self.at, self.share) + 0.02 / (1 + np.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray, part: np.ndarray) -> Model:
    """Trees on the rows whose part is not 0, calibration on the others; with too few of either kind, on all."""
    grow = part != 0
    if min(y[grow].sum(), (~grow & (y > 0)).sum(), (1 - y)[grow].sum(), (~grow & (y == 0)).sum()) < 5:
        grow = np.ones(len(y), bool)
        held = grow
    else:
        held = ~grow
    if not 0 < y.sum() < len(y):
        share = float(y.mean()) if len(y) else 0.0
        none = np.zeros((0, 0))
        return Model(Trees(0.0, none.astype(int), none, none), np.zeros(1), np.array([share]))
    trees = boost(x[grow], y[grow])
    return Model(trees, *isotonic(trees.margins(x[held]), y[held]))


def _sample(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, max_sample: int) -> DataFrame:
    """(digest, toxic, part, text): the distinct texts of the labelled rows whose crc32(doc_id) mod 3 is not 1; of more
    than `max_sample`, those of the smallest hashes. Toxic is what any label of the text's rows calls so."""
    ident, digest = F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("digest")
    known = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    rows = docs.select(ident, digest).filter(fold("doc_id", 3) != 1).join(known, "doc_id").groupBy("digest").agg(F.max("toxic").alias("toxic"))
    rows = written(rows, "labelled")
    rank = F.pmod(F.xxhash64("digest"), F.lit(1 << 30))
    if (n := rows.count()) > max_sample:
        # a little more than the sample by a bound on the hash, so that no partition sends the driver a sample of its own
        rows = rows.filter(rank < int((1 << 30) * min(1.0, 1.1 * max_sample / n))).orderBy(rank, "digest").limit(max_sample)
    # `max_sample` rows of a digest and a label at most are broadcast
    whole = docs.select(digest, F.coalesce(F.col(text), F.lit("")).alias("text"))
    taken = whole.join(F.broadcast(rows), "digest").groupBy("digest", "toxic").agg(F.first("text").alias("text"))
    return written(taken.select("digest", "toxic", F.pmod(F.xxhash64("digest", F.lit("part")), F.lit(PARTS)).cast("int").alias("part"), "text"), "sample")


_COUNTED = "stem string, " + ", ".join(f"n{i} long" for i in range(PARTS))


def _counted(rows: DataFrame, only: frozenset[str] | None = None) -> DataFrame:
    """By word beginning (of `only`, if given): the number of texts of each part that have it. The beginning "" counts
    the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}

        def flush() -> pa.RecordBatch:
            columns = np.array(list(counts.values()), np.int64).reshape(-1, PARTS).T
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array(np.ascontiguousarray(c)) for c in columns)], ["stem", *(f"n{i}" for i in range(PARTS))])

        for batch in batches:
            for part, text in zip(batch.column("part").to_pylist(), texts_of(batch), strict=True):
                found = stems(text)
                for stem in (found if only is None else found & only) | {""}:
                    counts.setdefault(stem, [0] * PARTS)[part] += 1
                if len(counts) > COUNTED:
                    yield flush()
                    counts = {}
        yield flush()

    summed = rows.select("part", "text").mapInArrow(run, _COUNTED).groupBy("stem")
    return summed.agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in range(PARTS)))


def _lexicons(sample: DataFrame) -> list[Lexicon]:
    """For each part of the sample the lexicon of the others, and that of all last."""
    every = sum((F.col(f"n{i}") for i in range(1, PARTS)), F.col("n0"))
    toxic = _counted(sample.filter("toxic = 1")).filter((every >= MIN_TEXTS) | (F.col("stem") == ""))
    toxic = toxic.orderBy(F.col("stem") != "", every.desc(), "stem").limit(MAX_STEMS).collect()
    names = [r[0] for r in toxic if r[0]]
    clean = {r[0]: r[1:] for r in _counted(sample.filter("toxic = 0"), frozenset(names)).collect()}
    none = (0,) * PARTS
    have = np.array([r[1:] for r in toxic if r[0]], float).reshape(-1, PARTS)
    lack = np.array([clean.get(n, none) for n in names], float).reshape(-1, PARTS)
    texts = np.array([next((r[1:] for r in toxic if not r[0]), none), clean.get("", none)], float)
    uses = [[i for i in range(PARTS) if i != part] for part in range(PARTS)] + [[*range(PARTS)]]
    return [lexicon(names, have[:, u].sum(1), lack[:, u].sum(1), tuple(texts[:, u].sum(1))) for u in uses]


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", max_sample: int = MAX_SAMPLE) -> Model:
    """A model from the labelled rows whose crc32(doc_id) mod 3 is not 1, equal texts as one; see `_sample`."""
    with removed_after(docs.sparkSession):
        return _train(_sample(docs, labels, text, doc_id, max_sample))


def _train(sample: DataFrame) -> Model:
    *others, whole = _lexicons(sample)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat = [v for part, t in zip(batch.column("part").to_pylist(), texts_of(batch), strict=True) for v in features(t, others[part])]
        x = pa.FixedSizeListArray.from_arrays(pa.array(flat, pa.float64()), len(FEATURES)).cast(pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([*batch.columns[:2], x], ["digest", "toxic", "x"])

    got = map_batches(sample.select("digest", "toxic", "part", "text"), run, "digest long, toxic int, x array<double>").toPandas().sort_values("digest")
    x = np.array(got["x"].tolist()).reshape(len(got), len(FEATURES))
    # a quarter of the texts calibrates, whatever their part
    held = got["digest"].to_numpy().view(np.uint64) >> np.uint64(7) & np.uint64(3)
    model = fit(x, got["toxic"].to_numpy().astype(float), held)
    model.learned = whole
    return model


_SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def score(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD, max_sample: int = MAX_SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of `docs`, whole texts read, however long.

    The score depends on the text alone. Null and empty texts have zeros as features and get the score of those. With
    labels of one kind only, every score is near that kind's; without any, near 0. Repeated rows get equal scores, a
    null doc_id counts as the empty text in the fold, and an empty table gives no rows. Further columns of `docs` are
    not looked at, whatever their names.
    """
    model = train(docs, labels, text, doc_id, max_sample)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = model.read(batch)
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    ident = F.col(doc_id).cast("long").alias("doc_id")
    rows = docs.select(ident, F.col(text).alias("text")).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "text")
    return map_batches(rows, run, _SCHEMA)


def clean(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD, max_sample: int = MAX_SAMPLE) -> DataFrame:
    """The rows of `docs` whose score is below `threshold`, with all their columns, of whatever names.

    Rows pass one by one as `score` has them: null and empty texts by the score of those, repeated rows alike, texts of
    any length whole. An empty table gives no rows.
    """
    model = train(docs, labels, text, doc_id, max_sample)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(model.read(batch, text) < threshold))

    return map_batches(docs, run, docs.schema)
