import __spark_entry__ as entry
import corpus_pipeline
from tesserine.llm import common

from ..conftest import SMALL
from .fixtures import edge_docs
from .test_toxicity import many


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, SMALL), "test")
        assert docs.columns == columns and 0 < docs.count() <= n, name
        n = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert sorted(r.doc_id for r in entry.queries()["pipeline"](spark, SMALL).select("doc_id").distinct().collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_stages_take_edge_rows(spark):
    docs = edge_docs(spark)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).collect()
        stage(spark, docs.limit(0), SMALL).collect()


def test_stages_on_edge_rows_give_what_they_say(spark):
    docs = common.stored(edge_docs(spark), "test")
    given = sorted(map(str, docs.collect()))
    quality, toxic, near, clean, pack = (f for _, f in corpus_pipeline.STAGES)
    kept = [str(r) for r in quality(spark, docs, SMALL).collect()]
    assert all(given.count(x) == kept.count(x) for x in set(kept)) and not any(r.text is None or len(r.text.split()) < 20 for r in quality(spark, docs, SMALL).collect())
    kept = [str(r) for r in toxic(spark, docs, SMALL).collect()]
    assert all(given.count(x) == kept.count(x) for x in set(kept)) and len({r.text in (None, "") for r in docs.collect()}) == 2
    one = near(spark, docs, SMALL).collect()
    assert [str(r) for r in one if str(r) not in given] == [] and len({str(r) for r in one}) == len(one)
    assert sum(not (r.text or "").split() for r in one) == 1 and {r.doc_id for r in one if not (r.text or "").split()} == {0}
    assert sorted(map(str, clean(spark, docs, SMALL).collect())) == given
    pieces = pack(spark, docs, SMALL).collect()
    assert sum(p.start == 0 for p in pieces) == len(given) and sum(p.doc_tokens == 1 for p in pieces) >= 4
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, SMALL)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


def test_the_toxicity_stage_learns_from_every_labelled_row_it_is_given(spark, tmp_path):
    rows, word, docs, labels = many(spark)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["toxicity"](spark, docs, str(tmp_path)).select("doc_id").collect()}
    for w in ("zorgx", "blarg"):
        assert not [i for i in kept if word.get(i) == w], w
    assert kept == {i for i, _, _ in rows if i not in word}
