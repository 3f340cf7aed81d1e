import random

import numpy as np

from tesserine.llm import license_scan, queries

from ..conftest import SMALL
from .fixtures import edge_docs, no_docs, prose


def slow_common(pattern: list, words: list) -> int:
    """Longest common subsequence with any part, i.e. with the whole."""
    row = [0] * (len(words) + 1)
    for p in pattern:
        new = [0]
        for j, w in enumerate(words, 1):
            new.append(row[j - 1] + 1 if p == w else max(row[j], new[-1]))
        row = new
    return row[-1]


def test_templates_are_found_whole_and_changed():
    index = license_scan.Index.build(license_scan.TEMPLATES)
    rng = random.Random(2)
    for name, text in license_scan.TEMPLATES.items():
        words = text.split()
        for changes in (0, len(words) // 20):
            some = list(words)
            for _ in range(changes):
                at = rng.randrange(len(some))
                if rng.random() < 0.5:
                    some[at] = "zzz"
                else:
                    some.insert(at, "yyy")
            before, after = prose(1, 50).split(), prose(2, 50).split()
            found = {f[0]: f for f in index.scan(" ".join([*before, *some, *after]).encode())}
            assert name in found
            _, coverage, matched, first, last, span = found[name]
            assert matched == slow_common([w for x in words if (w := license_scan.words(x.encode()))], [license_scan.words(x.encode()) for x in some]) or changes
            assert first >= 50 and last < 50 + len(some) and span == last - first + 1 and coverage >= 0.8
    assert index.scan(prose(3, 3000).encode()) == []


def test_two_copies_are_two_regions():
    index = license_scan.Index.build(license_scan.TEMPLATES)
    line = license_scan.TEMPLATES["mit-mention"]
    found = [f for f in index.scan(f"{line}. {prose(1, 40)} {line.upper()}!".encode()) if f[0] == "mit-mention"]
    assert [(f[3], f[1]) for f in found] == [(0, 1.0), (45, 1.0)]


def test_rows(spark):
    mit = license_scan.TEMPLATES["mit"]
    docs = spark.createDataFrame([(1, f"{prose(1, 9000)}\n{mit}"), (None, mit), (1, f"{prose(1, 9000)}\n{mit}"), (2, None), (3, ""), (4, mit[: len(mit) // 3])], "doc_id long, text string")
    found = [(r.doc_id, r.first_word) for r in license_scan.scan(docs).collect() if r.license == "mit"]
    assert sorted(found, key=str) == [(1, 9000), (1, 9000), (None, 0)]
    assert license_scan.scan(edge_docs(spark)).count() == license_scan.scan(no_docs(spark)).count() == 0


def slow_align(pattern: list, words: list, lo: int, hi: int) -> int:
    """Most words of pattern in order on diagonals lo..hi, by the whole table."""
    best = {(0, j): 0 for j in range(lo, hi + 1)}
    for i, p in enumerate(pattern, 1):
        for d in range(lo, hi + 1):
            j = i + d
            cells = [best.get((i - 1, d), 0) + (1 <= j <= len(words) and words[j - 1] == p), best.get((i - 1, d + 1), 0), best.get((i, d - 1), 0)]
            best[i, d] = max(cells)
    return max(best[len(pattern), d] for d in range(lo, hi + 1))


def test_banded_alignment_equals_the_whole_table():
    rng = random.Random(6)
    for _ in range(200):
        pattern = [rng.randint(1, 4) for _ in range(rng.randint(3, 9))]
        text = [rng.randint(0, 4) for _ in range(rng.randint(1, 16))]
        lo = rng.randint(-4, 12)
        hi = lo + rng.randint(0, 6)
        found = license_scan.align(np.array(pattern), np.array(text), lo, hi)
        assert (found[0] if found else 0) == slow_align(pattern, text, lo, hi)
        if found:
            part = text[found[1] : found[2] + 1]
            assert slow_common(pattern, part) >= found[0] and text[found[1]] in pattern and text[found[2]] in pattern


def bits_common(pattern: list, words: list) -> int:
    """Longest common subsequence by bit vectors."""
    where = {p: sum(1 << i for i, q in enumerate(pattern) if q == p) for p in pattern}
    full = row = (1 << len(pattern)) - 1
    for w in words:
        m = where.get(w, 0)
        row = ((row + (row & m)) | (row & ~m)) & full
    return len(pattern) - bin(row).count("1")


def covered(text: str) -> set[str]:
    """Templates that some band of diagonals of a text covers, each diagonal tried."""
    given = [license_scan.words(w.encode()) for w in text.split()]
    out = set()
    for name, template in license_scan.TEMPLATES.items():
        pattern = [[w] for w in license_scan.words(template.encode())]
        need = license_scan.LEAST_COVERAGE * len(pattern)
        if bits_common([p[0] for p in pattern], [g[0] if g else b"" for g in given]) < need:
            continue
        band = license_scan.band_of(len(pattern))
        if any(slow_align(pattern, given, d - band, d + band) >= need for d in range(-len(pattern), len(given))):
            out.add(name)
    return out


def test_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    found = {}
    for r in queries.op3_license_scan(spark, SMALL).collect():
        found.setdefault(r.doc_id, set()).add(r.license)
    assert found and found == {d: c for d, t in docs.items() if (c := covered(t or ""))}


def test_short_templates_with_a_changed_word_are_found():
    index = license_scan.Index.build(license_scan.TEMPLATES)
    for text, name in (("Released under an MIT License", "mit-mention"), ("Licensed beneath CC BY-NC 4.0", "cc-by-nc-4.0-mention"), ("(c) 2001. ALL RIGHTS RESERVED", "all-rights-reserved")):
        assert name in {f[0] for f in index.scan(f"{prose(1, 30)} {text} {prose(2, 30)}".encode())} & covered(f"{prose(1, 30)} {text} {prose(2, 30)}")


def test_the_best_of_overlapping_regions_stays():
    index = license_scan.Index.build({"one": "a b c d e f g h i j"})
    text = "a b c d x x f g h i a b c d e f g h i j"
    assert [(f[2], f[3], f[4]) for f in index.scan(text.encode())][-1] == (10, 10, 19)
    found = index.scan(b"a b c d e f g h a b c d e f g h i j")
    assert (10, 8, 17) in [(f[2], f[3], f[4]) for f in found]
    assert all(a[4] < b[3] for a, b in zip(found, found[1:], strict=False))
