"""The near-copy stage against a brute force of true Jaccard similarities."""

import random

import numpy as np
import pytest
from test_llm_operators import frame, rows_of

from heronry.llm import resemblance, simhash


def plain_representatives(rows):
    """The smallest id of each group, all pairs of texts compared."""
    sets = [(d, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}) for d, w in ((d, (t or "").lower().split()) for d, t in rows)]
    left, out = list(sets), set()
    while left:
        group, todo = [], [left.pop()]
        while todo:
            a = todo.pop()
            group.append(a[0])
            near = [b for b in left if len(a[1] & b[1]) / len(a[1] | b[1]) >= 0.8]
            left = [b for b in left if b not in near]
            todo += near
        out.add(min(group))
    return out


def edited(words, n, r):
    copy = list(words)
    for at in r.sample(range(len(words)), n):
        copy[at] = f"x{r.randrange(10**9)}"
    return copy


@pytest.mark.parametrize("block", [256, 7])
def test_all_pairs_and_no_others(spark, monkeypatch, block):
    monkeypatch.setattr(resemblance, "BLOCK_SETS", block)
    r = random.Random(5)
    make = lambda n: ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    texts = []
    for n in [3, 8, 40, 150, 400] * 6:  # similarities on either side of 0.8
        base = make(n)
        texts += [" ".join(base), *(" ".join(edited(base, max(1, round(n * share)), r)) for share in (0.01, 0.02, 0.023, 0.026, 0.04))]
    template = make(160)  # a crowd of one template at 0.6 or so, with near pairs inside
    for _ in range(60):
        own = template + make(45)
        texts.append(" ".join(own))
        if r.random() < 0.4:
            texts.append(" ".join(edited(own, 4, r)))
    r.shuffle(texts)
    docs = frame(spark, texts)
    found = sorted(x.doc_id for x in simhash.representatives(docs).collect())
    expected = sorted(plain_representatives(list(enumerate(texts))))
    assert found == expected and len(expected) < len(texts) - 40


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").dropDuplicates(["text"])
    rows = rows_of(docs := docs.cache())
    assert {x.doc_id for x in simhash.representatives(docs).collect()} == plain_representatives(rows)


def test_filters_keep_partners():
    n = np.arange(1, 3000)
    assert (resemblance._least(n, 0.8) == -(-4 * n // 5)).all()
    assert (n - resemblance._least(n, 0.8) + resemblance._further(n) <= n).all()
