import random
import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tesserine.llm import packing, tokens

from .fixtures import edge_docs, no_docs


def check_windows(lengths, windows, window, least):
    seen = defaultdict(list)
    for w in windows:
        assert 0 < sum(n for _, _, n in w) <= window and all(n > 0 for _, _, n in w)
        for d, s, n in w:
            seen[d].append((s, n))
    for d, n in enumerate(lengths):
        at = 0
        for s, k in sorted(seen[d]):
            assert s == at
            at += k
        assert at == n
    for w in windows:
        used = sum(n for _, _, n in w)
        assert window - used < least or used & (used - 1) == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=60), st.sampled_from([16, 64, 100]), st.sampled_from([1, 4, 8]))
def test_windows_hold_each_id_once_with_little_padding(lengths, window, least):
    check_windows(lengths, packing.pack_lengths(lengths, window, least), window, least)


def test_tree_takes_the_tightest_window():
    rng = random.Random(1)
    tree, held = packing.CapacityTree(64), []
    for k in range(4000):
        if rng.random() < 0.5:
            c = rng.randint(1, 64)
            tree.add(c, k)
            held.append(c)
        else:
            need = rng.randint(1, 64)
            best = min((c for c in held if c >= need), default=None)
            got = tree.take(need)
            assert (got[0] if got else None) == best
            if got:
                held.remove(best)


def test_pieces_give_back_all_ids(spark):
    docs = edge_docs(spark)
    real = Tokenizer.from_file(tokens.default_path())
    want = sorted((r.doc_id is None, r.doc_id or 0, tuple(real.encode(r.text or "", add_special_tokens=False).ids) + (2,)) for r in docs.collect())
    rows = packing.pack(docs, tokens.default_path(), shard_ids=5000).collect()
    where = defaultdict(list)
    for r in rows:
        where[r.sequence_id].append(r)
    total = 0
    for pieces in where.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096
        total += at
    assert total == sum(len(x[2]) for x in want)
    for _, doc, ids in {x for x in want if want.count(x) == 1 and not x[0] and sum(y[1] == x[1] for y in want) == 1}:
        at = 0
        for p in sorted((r for r in rows if r.doc_id == doc), key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    assert packing.pack(no_docs(spark), tokens.default_path()).count() == 0
