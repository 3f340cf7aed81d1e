"""Searches for many queries, against brute force."""

import numpy as np
import pytest

from tesserine.queries import registry

from .conftest import SMALL


def nearest(spark, sf_dir, k):
    """The k nearest of every row whose id is divisible by 50, by cosine."""
    rows = sorted((r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect())
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return {int(q): ids[np.argsort(1 - x @ v, kind="stable")[:k]].tolist() for q, v in zip(ids, x, strict=True) if q % 50 == 0}


@pytest.mark.parametrize("sf_dir", [SMALL, SMALL.replace("0.001", "0.1")])
def test_inverted_lists_recall(spark, sf_dir):
    want = nearest(spark, sf_dir, 10)
    found = {(r.query_id, r.id) for r in registry.QUERIES["vec_inverted_lists"](spark, sf_dir).collect()}
    assert {q for q, _ in found} == set(want)
    recall = sum((q, i) in found for q, ids in want.items() for i in ids) / sum(map(len, want.values()))
    print(f"recall {recall:.4f} of {len(want)} queries")
    assert recall >= 0.9


def test_search_many_takes_every_50th_row(spark):
    rows = registry.QUERIES["vec_search_many_all"](spark, SMALL).collect()
    want = {(q, i, k) for q, ids in nearest(spark, SMALL, 5).items() for k, i in enumerate(ids, 1) if i != q}
    assert {(r.query_id, r.id, r.k) for r in rows} == want and len(rows) == len(want)
