"""Text analysis as column expressions: normalise, segment, lower, stop, cap, position."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of more code points are dropped.
MAX_TERM = 32
# fixed values: words without retrieval value; other single characters are kept
ENGLISH = tuple(
    """
    a an and are as at be but by for from has have how i in is it its of on or that the this to was were what when where
    which who why will with you your we our can could do does did not no yes if then than so such about into over under
    again more most some any all very
    """.split()
)
CHINESE = tuple(
    """
    的 了 和 与 或 在 是 有 也 就 都 而 及 等 着 吗 呢 吧 啊 把 被 给 让 对 从 到 为 以 之 其 这 那 我 你 他 她 它 们 个 上 下 中 里 后 前 时
    一个 什么 怎么 如何 为什么 可以 因为 所以 但是 如果 通过 进行
    """.split()
)
STOP_WORDS = ENGLISH + CHINESE
# fixed values: ideographs with their extensions and compatibility forms, kana, hangul
CJK = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2EBEF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}"


class Analyzer(Protocol):
    """Turns a text column into an array of terms. `id` goes into snapshots and is compared on load.

    An analyzer that also has `body`, `split` and `keeps` (see StandardAnalyzer) is run over whole Arrow batches when an
    index is built; the terms must be those of `document`.
    """

    id: str

    def document(self, text: Column) -> Column: ...

    def query(self, text: Column) -> Column: ...


def _rewritten(column: Column, rewrite: Callable[[str], str]) -> Column:
    """Spark has no built-in for Unicode's normal forms. ASCII texts stay as they are, without Python."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(lambda t: None if t is None else rewrite(t))

    return F.coalesce(F.pandas_udf(run, "string")(F.when(column.rlike(r"[^\x00-\x7F]"), column)), column)


def nfkc(column: Column) -> Column:
    """Compatibility normalisation."""
    return _rewritten(column, lambda t: unicodedata.normalize("NFKC", t))


def unmarked(column: Column) -> Column:
    """Compatibility forms taken apart and accents and other marks dropped; what then still composes (Hangul) does."""

    def rewrite(t: str) -> str:
        return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))

    return _rewritten(column, rewrite)


def latin_terms(text: Column) -> Column:
    """Runs of letters and digits."""
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def _pairs(text: Column) -> Column:
    """All pairs of neighbouring code points, in one pass: each match looks at two and takes one."""
    return F.regexp_extract_all(text, F.lit(r"(?s)(?=(..))."), F.lit(1))


def _bigrams(run: Column) -> Column:
    return F.when(F.length(run) > 1, _pairs(run)).otherwise(F.array(run))


_IDEOGRAPHS = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08X}", CJK)
_RUNS = re.compile(f"[{_IDEOGRAPHS}]+|(?:(?![{_IDEOGRAPHS}])[^\\W_])+")


def _mixed(body: str) -> list[str]:
    """What `mixed_terms` gives for one text."""
    out = []
    for run in _RUNS.findall(body):
        out += [run[i : i + 2] for i in range(len(run) - 1)] if re.match(f"[{_IDEOGRAPHS}]{{2}}", run) else [run]
    return out


def mixed_terms(text: Column) -> Column:
    """Runs of letters and digits; ideographic runs as overlapping pairs of characters."""
    runs = F.regexp_extract_all(text, F.lit(rf"([{CJK}]+|[\p{{L}}\p{{N}}&&[^{CJK}]]+)"), F.lit(1))
    return F.flatten(F.transform(runs, lambda r: F.when(r.rlike(f"^[{CJK}]"), _bigrams(r)).otherwise(F.array(r))))


@dataclass(frozen=True)
class StandardAnalyzer:
    """Lower-case terms without stop words and over-long terms.

    Ideographic runs become character pairs, as no dictionary is at hand; the longer expression runs only for texts
    that hold such characters. NFKC comes first, which takes a Python function for texts that are not ASCII, unless
    `normalize` is false.
    """

    stop_words: tuple[str, ...] = STOP_WORDS
    max_term: int = MAX_TERM
    normalize: bool = True

    @property
    def id(self) -> str:
        return f"standard/{len(self.stop_words)}/{self.max_term}/{'nfkc' if self.normalize else 'raw'}"

    def body(self, text: Column) -> Column:
        return F.lower(F.coalesce(nfkc(text) if self.normalize else text, F.lit("")))

    def split(self, bodies: pa.Array) -> pa.Array:
        """The terms of a batch of bodies, as lists; those that `keeps` refuses, empty ones too, are still among them."""
        found = pc.split_pattern_regex(bodies, r"[^\p{L}\p{N}]+")
        mixed = pc.match_substring_regex(bodies, f"[{CJK}]")
        if not pc.any(mixed).as_py():
            return found
        lists = [_mixed(b) if m else t for b, m, t in zip(bodies.to_pylist(), mixed.to_pylist(), found.to_pylist(), strict=True)]
        return pa.array(lists, pa.list_(pa.string()))

    def keeps(self, terms: pa.Array) -> np.ndarray:
        """Which of these terms are no stop words, not empty and not too long."""
        length = pc.utf8_length(terms).to_numpy(zero_copy_only=False)
        stop = pc.is_in(terms, pa.array(self.stop_words, pa.string())).to_numpy(zero_copy_only=False)
        return (length > 0) & (length <= self.max_term) & ~stop

    def document(self, text: Column) -> Column:
        body = self.body(text)
        terms = F.when(body.rlike(f"[{CJK}]"), mixed_terms(body)).otherwise(latin_terms(body))
        if not self.stop_words:
            return F.filter(terms, lambda t: F.length(t) <= self.max_term)
        return F.filter(terms, lambda t: ~t.isin(*self.stop_words) & (F.length(t) <= self.max_term))

    query = document


@dataclass(frozen=True)
class LemmaAnalyzer:
    """A second analyzer, for comparison: normal forms without marks (é as e), lower case, no stop words, single
    ideographs dropped."""

    max_term: int = MAX_TERM
    id: str = "lemma/2"

    def document(self, text: Column) -> Column:
        terms = mixed_terms(F.lower(F.coalesce(unmarked(text), F.lit(""))))
        return F.filter(terms, lambda t: (F.length(t) <= self.max_term) & ~t.rlike(f"^[{CJK}]$"))

    query = document


def char_bigrams(text: Column) -> Column:
    """The distinct pairs of neighbouring code points, white space removed."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")
    return F.array_distinct(_pairs(bare))


def coverage(part: Column, whole: Column) -> Column:
    """The share of the distinct values of `part` that are in `whole`; 0 for none."""
    distinct = F.array_distinct(part)
    return F.when(F.size(distinct) > 0, F.size(F.array_intersect(distinct, whole)) / F.size(distinct)).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct values; 0 if either array is empty."""
    shared, every = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared / every).otherwise(F.lit(0.0))


#: Queries of at least so many characters are natural language; of at least this term overlap, exact.
NATURAL_CHARS, EXACT_OVERLAP = 16, 0.5


def query_bucket(text: Column, overlap: Column) -> Column:
    """mixed (any ASCII letter or digit), natural (long), exact (its terms are in a relevant passage) or paraphrase."""
    return (
        F.when(text.rlike("[A-Za-z0-9]"), "mixed")
        .when(F.length(text) >= NATURAL_CHARS, "natural")
        .when(overlap >= EXACT_OVERLAP, "exact")
        .otherwise("paraphrase")
    )
