import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tesserine.llm import simhash

from .fixtures import edge_docs, no_docs, prose


def slow_fingerprint(text: str) -> int:
    words = simhash.words_of(text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def slow_components(values: list[int]) -> list[int]:
    """Number of the first value that each is linked to, by all pairs."""
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(values))]


def test_fingerprints_and_components_equal_brute_force(spark):
    base = [prose(i, 40) for i in range(12)]
    texts = base + [t.replace(" ", "  ", 3).upper() for t in base[:4]] + [t + " end" for t in base] + ["", None, " \x0b ", "Ab cd", "ab CD"]
    docs = spark.createDataFrame(list(enumerate(texts, 100)), "doc_id long, text string")
    values = [slow_fingerprint(t or "") for t in texts]
    want = {i + 100: (f"{v:016x}", c + 100) for i, (v, c) in enumerate(zip(values, slow_components(values), strict=True))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()} == want


@pytest.mark.parametrize("most", [2, 64])
def test_links_connect_what_all_pairs_connect(spark, most):
    rng = random.Random(5)
    values = [rng.getrandbits(64) for _ in range(20)]
    for v in values[:5]:  # chains, and crowds around one value
        for _ in range(25):
            v ^= 1 << rng.randrange(64)
            values.append(v)
            values.append(v ^ (1 << rng.randrange(32)) ^ (1 << rng.randrange(64)))
    values = sorted(set(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), most)
    assert links.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 2).count() == 0
    found = {r.node: r.root for r in simhash.components(links).collect()}
    want = slow_components(values)
    groups = {}
    for s, c in zip(signed, want, strict=True):
        groups.setdefault(c, []).append(s)
    for members in groups.values():
        assert {found.get(m, m) for m in members} == {min(members)}


def test_edge_rows(spark):
    docs = edge_docs(spark)
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    assert {r.fingerprint for r in rows if r.doc_id in (0, 1, 2)} == {"0" * 16}
    assert {r.component_id for r in rows if r.doc_id in (0, 1, 2)} == {0}
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert kept.filter("doc_id = 8").count() == 1 and kept.filter("doc_id = 9").count() == 0
    assert kept.filter("doc_id in (0, 1, 2)").count() == 1
    assert simhash.near_duplicates(no_docs(spark)).count() == simhash.deduplicate(no_docs(spark)).count() == 0
