"""What a hit owes to which lane, and why a query found nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import Analyzer, StandardAnalyzer


def matched_terms(query: Column, text: Column, analyzer: Analyzer | None = None) -> Column:
    """The query's terms that the text has, sorted, each once."""
    a = analyzer or StandardAnalyzer()
    return F.array_sort(F.array_intersect(a.query(query), a.document(text)))


def of_one_lane(hits: DataFrame, lexical: bool) -> DataFrame:
    """`hits` of a single lane with its score and rank as that lane's, and none of the other's."""
    own, other = ("bm25", "vector") if lexical else ("vector", "bm25")
    none = {f"{other}_score": F.lit(None).cast("double"), f"{other}_rank": F.lit(None).cast("int")}
    return hits.withColumns({f"{own}_score": F.col("score"), f"{own}_rank": F.col("rank")} | none)


def context_block(source: Column, text: Column, terms: Column) -> Column:
    """A hit as prompt text."""
    last = F.when(F.size(terms) > 0, F.concat(F.lit("\n(matched: "), F.array_join(terms, ", "), F.lit(")"))).otherwise("")
    return F.concat(F.lit("["), source, F.lit("]\n"), text, last)


def empty_reason(n_docs: Column, n_terms: Column, any_hit: Column, filtered: Column, n_allowed: Column, n_hits: Column, n_final: Column) -> Column:
    """Why a query has no final hit; null if it has, or if there were hits and k is 0.

    An empty index comes first, then the query's own part (no terms, none known), then the filter, then what
    post-processing removed.
    """
    return (
        F.when(n_final > 0, F.lit(None).cast("string"))
        .when(n_docs == 0, "NoDocuments")
        .when(n_hits > 0, "PostEmptied")
        .when((n_terms == 0) | ~any_hit, "AllTermsUnmatched")
        .when(filtered, "FilteredOut")
        .otherwise("AllTermsUnmatched")
    )
