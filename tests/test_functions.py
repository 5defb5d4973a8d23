from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from heronry.errors import InvalidInput
from heronry.functions import filters, text, vectors
from heronry.functions.filters import And, Eq, Or, Range
from heronry.operators import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def analyzed(spark, words, analyzer=None):
    return one(spark, (analyzer or text.StandardAnalyzer()).document(F.lit(words)))


def test_standard_analyzer(spark):
    assert analyzed(spark, "The Quick-brown fox, v2.0!") == ["quick", "brown", "fox", "v2", "0"]
    assert analyzed(spark, "x" * 32 + " " + "y" * 33) == ["x" * 32]
    assert analyzed(spark, "") == [] == analyzed(spark, "the of and")
    assert one(spark, text.StandardAnalyzer().document(F.lit(None).cast("string"))) == []


def test_ideographs_become_pairs(spark):
    assert analyzed(spark, "全文检索engine库") == ["全文", "文检", "检索", "engine", "库"]
    assert analyzed(spark, "的 云") == ["云"]


def test_compatibility_forms(spark):
    assert analyzed(spark, "ＡＢＣ ﬁne", text.StandardAnalyzer(normalize=True)) == ["abc", "fine"]


def test_second_analyzer(spark):
    assert analyzed(spark, "The Éngines pass 云 ﬁnd Cafe\u0301 한국", text.LemmaAnalyzer()) == ["the", "engines", "pass", "find", "cafe", "한국"]
    assert text.LemmaAnalyzer().id != text.StandardAnalyzer().id


def test_batches_give_the_terms_of_columns(spark):
    """What an index is built with, and what queries are analyzed with."""
    texts = ["The Engine, v2.0!", "云计算 and 数据", "日", "ｆｕｌｌ ﬁne", "", None, "a" * 40, "É l'été _x_ 1½ ²", "カタカナ한국어abc数", "\u0130stanbul ΟΔΟΣ", "x\ny\tz", "🙂 ok", "\U00020000\U00020001"]
    rows = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    for normalize in (True, False):
        a = text.StandardAnalyzer(normalize=normalize)
        expected = {r.chunk_id: sorted(Counter(r.terms).items()) for r in rows.select("chunk_id", a.document(F.col("text")).alias("terms")).collect()}
        assert {r.chunk_id: sorted((t.term, t.tf) for t in r.terms) for r in ingest.analyzed(rows, a).collect()} == expected


def test_positions_count_kept_terms(spark):
    rows = ingest.terms(spark.createDataFrame([(1, "the cat and the dog")], "chunk_id long, text string")).collect()
    assert sorted((r.position, r.term) for r in rows) == [(0, "cat"), (1, "dog")]


def test_jaccard_and_coverage(spark):
    a, b, none = (F.array(*map(F.lit, x)) for x in (["a", "b"], ["b", "c"], []))
    none = none.cast("array<string>")
    assert one(spark, text.jaccard(a, b)) == pytest.approx(1 / 3)
    assert one(spark, text.jaccard(a, none)) == 0 == one(spark, text.jaccard(none, none))
    assert one(spark, text.coverage(a, b)) == 0.5 and one(spark, text.coverage(none, b)) == 0
    assert one(spark, text.char_bigrams(F.lit("a b ab"))) == ["ab", "ba"]
    assert one(spark, text.char_bigrams(F.lit("a"))) == []


@pytest.mark.parametrize(("query", "overlap", "bucket"), [("如何 v2", 1.0, "mixed"), ("检" * 16, 1.0, "natural"), ("检索", 0.5, "exact"), ("检索", 0.4, "paraphrase")])
def test_query_buckets(spark, query, overlap, bucket):
    assert one(spark, text.query_bucket(F.lit(query), F.lit(overlap))) == bucket


def test_vectors(spark):
    v, zero = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, vectors.normalize(v)) == [0.6, 0.8]
    assert one(spark, vectors.normalize(zero)) == [0.0, 0.0]
    near = F.array(F.lit(1.0 + 5e-7), F.lit(0.0))
    assert one(spark, vectors.normalize(near)) == [1.0 + 5e-7, 0.0]
    assert one(spark, vectors.squared_distance(v, zero)) == 25
    assert one(spark, vectors.score_of_distance(F.lit(2.0))) == 0


META = [
    (0, '{"year": 2021, "lang": "en"}'), (1, '{"year": 2021.0, "lang": null}'), (2, '{"year": "2021", "tags": [1,2]}'), (3, '{"a.b": true}'), (4, "[1]"), (5, "not json"), (6, None),
    (7, '{"year": 7, "s": "7"}'),
]


@pytest.mark.parametrize(
    ("where", "expected"),
    [
        (Eq("year", "2021"), [0, 2]), (Eq("year", "2021.0"), [1]), (Eq("lang", "null"), [1]), (Eq("lang", "en"), [0]), (Eq("tags", "[1,2]"), [2]), (Eq("a.b", "true"), [3]),
        (Range("year", 7, 2021), [7]), (Range("year", gte=2021), [0, 1]), (Range("s", 0, 10), []), (Range("year", 10, 5), []), (Range("missing", 0), []),
        (And((Eq("year", "2021"), Eq("lang", "en"))), [0]), (Or((Eq("lang", "en"), Eq("a.b", "true"))), [0, 3]), (And(()), list(range(8))), (Or(()), []),
    ],
)
def test_json_filters(spark, where, expected):
    rows = spark.createDataFrame(META, "id long, metadata string")
    assert sorted(r.id for r in rows.filter(filters.predicate(where, F.col("metadata"))).collect()) == expected


def test_filter_text():
    assert filters.parse("lang=en, year>=3,year<5") == And((Eq("lang", "en"), Range("year", gte=3), Range("year", lt=5)))
    assert filters.parse(["a=b"]) == Eq("a", "b")
    for bad in ("a<=3", "a>3", "a", "", "a>=x", "=3"):
        with pytest.raises(InvalidInput):
            filters.parse(bad)


def test_typed_filters_reach_the_scan(spark, sf_dir):
    spark.catalog.clearCache()  # else the plan may read what another test has cached
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = docs.filter(filters.predicate(Range("n_chars", 10, 20), columns={"n_chars": F.col("n_chars")}))._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(n_chars,10" in plan


def brute_windows(s, size, overlap):
    """The rule, character by character."""
    def starts(p):
        k = p
        while k and s[k - 1] in "\r\n":
            k -= 1
        return p - k >= 2 and (p == len(s) or s[p] not in "\r\n")

    out, at = [], 0
    while at < len(s):
        cut = min(at + size, len(s))
        if cut < len(s):
            cut = max((p for p in range(at + 1, cut + 1) if starts(p)), default=cut)
        out.append((at, cut))
        if cut == len(s):
            break
        at = max(cut - overlap, at) if cut - overlap > at else cut
    return out


@given(st.text("ab\n\r ", max_size=80), st.integers(2, 12), st.integers(0, 11))
def test_windows(s, size, overlap):
    if overlap < size:
        assert ingest.windows(s, size, overlap) == brute_windows(s, size, overlap)


def test_windows_by_hand():
    assert ingest.windows("") == [] and ingest.windows("a" * 512) == [(0, 512)]
    assert ingest.windows("a" * 513) == [(0, 512), (448, 513)]
    assert ingest.windows("aaaa\r\nbbbbbb", 8, 2) == [(0, 6), (4, 12)]


def test_closed_form_is_the_general_rule(spark):
    docs = [(i, "ab c" * i) for i in (0, 1, 127, 128, 129, 400, 1000)] + [(5000, "a" * 300 + "\n\n" + "b" * 900), (5001, None)]
    found = ingest.chunk(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    expected = {(d, i, a, b, t[a:b]) for d, t in docs if t for i, (a, b) in enumerate(ingest.windows(t))}
    assert {tuple(r) for r in found} == expected
