import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserine.llm import decontam

from .fixtures import edge_docs, no_docs, prose


def slow_align(pattern: str, text: str) -> int:
    """Least edits between pattern and any part of text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(rng: random.Random, text: str, n: int) -> str:
    chars = list(text)
    for _ in range(n):
        at = rng.randrange(len(chars))
        kind = rng.randrange(3)
        if kind == 0:
            chars[at] = rng.choice("xyz ")
        elif kind == 1:
            del chars[at]
        else:
            chars.insert(at, rng.choice("xyz"))
    return "".join(chars)


@settings(max_examples=150, deadline=None)
@given(st.text("ab", min_size=1, max_size=12), st.text("ab", max_size=20), st.integers(0, 4))
def test_alignment_is_the_least(pattern, text, k):
    found = decontam.align(decontam.code_points(pattern), decontam.code_points(text), k)
    best = slow_align(pattern, text)
    if best > k:
        assert found is None
    else:
        assert found[0] == best
        assert slow_align(pattern, text[found[1] : found[2]]) == best and found[2] - found[1] <= len(pattern) + k


def test_windows_within_the_budget_are_found_and_no_others():
    rng = random.Random(3)
    items = [(i, prose(100 + i, 60)) for i in range(6)]
    index = decontam.Index.build(items)
    for trial in range(60):
        w = rng.randrange(len(index.strings))
        k = int(index.edits[w])
        text = f"{prose(500 + trial, 40)} {edited(rng, index.strings[w], rng.randrange(k + 3))} {prose(900 + trial, 40)}"
        norm = decontam.normalized(text)
        want = {int(index.owner[v]) for v in range(len(index.strings)) if slow_align(index.strings[v], norm) <= int(index.edits[v])} if trial % 6 == 0 else None
        found = set(index.matches(text))
        if want is not None:
            assert found == want
        elif slow_align(index.strings[w], norm) <= k:
            assert int(index.owner[w]) in found


def test_segments_find_what_the_whole_finds(monkeypatch):
    items = [(0, "ab" * 100), (1, prose(7, 60))]
    index = decontam.Index.build(items)
    points = decontam.code_points(decontam.normalized("ab" * 3000 + " " + items[1][1] + " " + "ab" * 1500))
    whole = {(w, lo) for w, lo, _ in index.candidates(points)}
    monkeypatch.setattr(decontam, "MANY", 0)
    assert {(w, lo) for w, lo, _ in index.candidates(points)} == whole and len({index.owner[w] for w, _ in whole}) == 2


def test_verbatim_passages_are_found_wherever_they_begin():
    least = decontam.SHORT + decontam.SHORT_STEP - 1
    assert least <= 60
    item = decontam.normalized(prose(21, 60))
    index = decontam.Index.build([(1, item), (2, prose(22, 60))])
    for s in range(0, len(item) - least + 1, 3):
        assert set(index.matches(f"{prose(23, 20)} {item[s : s + least]} {prose(24, 20)}")) == {0}


def test_short_items_match_exactly():
    index = decontam.Index.build([(1, "What is 2+2?"), (2, "red  Fox"), (3, " "), (4, "red fox")])
    assert index.matches('He asked "what IS\n2+2?" twice, what is 2+2?') == {0: [1, 0, 10, 43]}
    assert set(index.matches("a (red fox).")) == {1, 2} and not index.matches("bored fox, red foxes, red foz, what is 2+3?")


def test_query_and_filter(spark):
    items = [(1, prose(11, 30)), (2, prose(12, 30)), (3, "too short"), (4, None), (None, prose(13, 30)), (1, prose(11, 30))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    passage = " ".join(items[1][1].split()[3:27])
    docs = spark.createDataFrame([(1, f"{prose(1, 50)} {items[0][1].upper()}"), (2, f"{prose(2, 9000)}\n\n{passage} {prose(3, 50)}"), (3, prose(4, 200)), (4, None), (5, ""), (None, items[4][1]), (1, f"{prose(1, 50)} {items[0][1].upper()}")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.item_id or 0) for r in decontam.matches(docs, bench).collect()) == [(0, 0), (1, 1), (1, 1), (2, 2)]
    assert sorted(r.doc_id for r in decontam.filtered(docs, bench).collect()) == [3, 4, 5]
    old = decontam.BLOCK_CHARS
    try:
        decontam.BLOCK_CHARS = 100
        assert sorted(r.doc_id for r in decontam.filtered(docs, bench).collect()) == [3, 4, 5]
    finally:
        decontam.BLOCK_CHARS = old


def test_bands_find_what_the_whole_text_gives():
    rng = random.Random(8)
    for trial in range(40):
        pattern, k = prose(trial, 12)[:60], rng.randrange(6)
        text = prose(trial + 50, 30) + edited(rng, pattern, rng.randrange(k + 1)) + prose(trial + 90, 30)
        whole = decontam.align(decontam.code_points(pattern), decontam.code_points(text), k)
        assert whole is not None and whole[0] == slow_align(pattern, text)
        d = whole[1] + rng.randrange(-k, k + 1)
        band = decontam.align(decontam.code_points(pattern), decontam.code_points(text), k, d - 2 * k, d + 2 * k)
        assert band[0] == whole[0] and band[2] == whole[2]
    far = decontam.align(decontam.code_points("abcdef"), decontam.code_points("x" * 20 + "abcdef"), 1, 0, 3)
    assert far is None and decontam.align(decontam.code_points("abcdef"), decontam.code_points("abc"), 1) is None


def test_query_equals_brute_force(spark, monkeypatch):
    rng = random.Random(12)
    items = [(i, prose(300 + i, 9 + i)) for i in range(5)] + [(9, "Who, me?")]
    docs = []
    for d in range(24):
        name, item = items[d % len(items)]
        cut = item[rng.randrange(max(1, len(item) - 70)) :][: rng.randrange(40, 90)]
        docs.append((d, f"{prose(400 + d, 6)} {edited(rng, cut, d % 7)} {prose(500 + d, 6)}" if d % 4 else prose(600 + d, 20)))
    want = set()
    index = decontam.Index.build(items)
    for d, text in docs:
        t = decontam.normalized(text)
        want |= {(d, index.items[o]) for o, w, k in zip(index.owner.tolist(), index.strings, index.edits.tolist(), strict=True) if slow_align(w, t) <= k}
        want |= {(d, 9)} if " who, me?" in t else set()
    documents = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert 5 < len(want) < 24
    for size in (decontam.BLOCK_CHARS, 100):  # in one block and in several
        monkeypatch.setattr(decontam, "BLOCK_CHARS", size)
        assert {(r.doc_id, r.item_id) for r in decontam.matches(documents, bench).collect()} == want
        assert {r.doc_id for r in decontam.filtered(documents, bench).collect()} == set(range(24)) - {d for d, _ in want}


def test_edge_rows(spark):
    docs, bench = edge_docs(spark), spark.createDataFrame([(1, prose(99, 40))], "item_id long, text string")
    none = bench.limit(0)
    assert decontam.matches(docs, bench).count() == 0 and decontam.filtered(docs, bench).count() == docs.count()
    assert decontam.matches(docs, none).count() == decontam.matches(no_docs(spark), bench).count() == 0
    assert decontam.filtered(docs, none).count() == docs.count() and decontam.filtered(docs, bench).columns == docs.columns


def test_normal_form_of_lone_surrogates():
    assert decontam.code_points("a\ud800").tolist() == [97, 0xD800]
    assert np.array_equal(decontam.qgrams(decontam.code_points("short")), np.zeros(0, np.uint64))


def test_items_at_the_limit_of_short_ones_are_found_verbatim():
    for n in range(decontam.LEAST_CHARS - 2, decontam.LEAST_CHARS + 3):
        item = prose(40 + n, 20)[:n].strip(" ,.") + "x" * 5
        item = item[:n]
        assert set(decontam.Index.build([(1, item)]).matches(f"{prose(3, 9)} {item} {prose(4, 9)}")) == {0}, n
