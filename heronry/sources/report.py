"""Evaluation reports from per-query metrics: tables, sign tests computed anew, and a cell-by-cell check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.evaluate import means, sign_counts, sign_test
from . import files

Cells = dict[tuple[str, ...], float | int]


def cells(per_query: DataFrame, against: str = "hybrid") -> Cells:
    """Every number of a report, by (table, row, column), from (mode, qid, type, recall, mrr, ndcg).

    The means of each mode by bucket and over all, and for each other mode how many queries `against` does better, equal
    and worse on by NDCG, with the exact tail probability of that. All come from the per-query rows alone.
    """
    out: Cells = {}
    modes = sorted(r[0] for r in per_query.select("mode").distinct().collect())
    runs = {m: per_query.filter(F.col("mode") == m) for m in modes}
    buckets = sorted(r[0] for r in per_query.select("type").distinct().collect() if r[0] is not None)
    for mode, run in runs.items():
        for r in means(run).collect():
            for metric in ("n", "recall", "mrr", "ndcg"):
                out["means", f"{mode} {r.type or 'all'}", metric] = r[metric]
    for mode in modes if against in runs else ():
        if mode != against:
            for bucket in ("all", *buckets):
                a, b = (r if bucket == "all" else r.filter(F.col("type") == bucket) for r in (runs[against], runs[mode]))
                counts = sign_counts(a, b).first()
                found = {**counts.asDict(), "p": sign_test(counts.better, counts.worse)}
                out |= {("signs", f"{against} over {mode} {bucket}", k): v for k, v in found.items()}
    return out


def markdown(found: Cells, digits: int = 4) -> str:
    """The cells as one Markdown table for each kind, rows and columns in the order they come."""
    parts = []
    for table in dict.fromkeys(t for t, _, _ in found):
        columns = list(dict.fromkeys(c for t, _, c in found if t == table))
        rows = [[row, *(found.get((table, row, c)) for c in columns)] for row in dict.fromkeys(r for t, r, _ in found if t == table)]
        parts.append(files.markdown_rows([table, *columns], rows, digits))
    return "\n\n".join(parts)


def differences(found: Cells, written: Cells, digits: int = 4) -> list[str]:
    """What a report says otherwise than the rows it was made from: cells that differ when rounded to `digits` (small
    probabilities to as many significant ones), and cells that only one side has."""
    show = lambda v: "nothing" if v is None else f"{v:.{digits - 2}e}" if isinstance(v, float) and 0 < abs(v) < 10**-digits else f"{v:.{digits}f}"
    every = dict.fromkeys([*found, *written])
    return [f"{' / '.join(k)}: {show(written.get(k))}, but the rows give {show(found.get(k))}" for k in every if show(found.get(k)) != show(written.get(k))]
