import io
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tesserine.llm import common, token_planes, tokens

from .fixtures import edge_docs, no_docs


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_planes_go_there_and_back(kind):
    rng = np.random.default_rng(1)
    for top in (1, 2, 255, 256, 70000, 1 << 32):
        for n in (1, 7, 8, 1000):
            ids = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
            planes = token_planes.to_planes(ids, kind)
            assert np.array_equal(token_planes.from_planes(planes, n, kind), ids)
            assert len(planes) == -(-int(ids.max()).bit_length() // (8 if kind == "byte" else 1))


class Kept(io.BytesIO):
    def close(self):
        pass


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_files_give_documents_and_single_blocks(kind):
    rng = np.random.default_rng(2)
    docs = [(d, rng.integers(0, 50000, n).astype("<u4")) for d, n in ((None, 1), (3, 0), (5, 1000), (5, 17), (9, 64))]
    out = Kept()
    writer = token_planes.Writer(out, kind, block=64)
    for d, ids in docs:
        writer.add(d, ids.tobytes())
    assert writer.close()["n_ids"] == 1082
    reader = token_planes.Reader(out)
    assert [(d, b"".join(p)) for d, _, p in reader.pieces()] == [(d, ids.tobytes()) for d, ids in docs]
    flat = np.concatenate([ids for _, ids in docs])
    assert np.array_equal(reader.block(7), flat[448:512])


def test_round_trip_equals_the_tokenizer(spark):
    real = Tokenizer.from_file(tokens.default_path())
    docs = edge_docs(spark)
    want = [(r.doc_id, real.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in docs.collect()]
    manifest = token_planes.write(docs, common.scratch(spark, "test"), tokens.default_path(), block=4096)
    rows = sorted(token_planes.read(spark, manifest).collect(), key=lambda r: r.start)
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in rows) == [(r.doc_id is not None, r.doc_id or 0) for r in rows]
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    digest = lambda d, ids: (d is None, d or 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in rows) == sorted(digest(d, i) for d, i in want)
    empty = token_planes.write(no_docs(spark), common.scratch(spark, "test"), tokens.default_path())
    assert token_planes.read(spark, empty).count() == 0


def test_files_end_after_a_bounded_number_of_ids(spark):
    docs = edge_docs(spark).repartition(2)

    def written(**bounds):
        manifest = token_planes.write(docs, common.scratch(spark, "test"), tokens.default_path(), **bounds)
        return manifest.collect(), sorted(map(tuple, token_planes.read(spark, manifest).collect()), key=str)

    whole = written()[1]
    for bounds in ({"file_ids": 500}, {"file_docs": 2}):
        files, rows = written(**bounds)
        assert rows == whole and len(files) > 4
        assert all(f.n_docs <= 2 for f in files) or "file_ids" in bounds
