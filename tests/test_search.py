"""Text search against the fixtures of the contract and brute force."""

import math
import re
from collections import Counter

import pytest

from tesserine.functions import text as tx
from tesserine.operators.fts import TextIndex
from tesserine.operators.graph import scratch
from tesserine.queries import registry

from .conftest import SMALL

TF = ["apple banana cherry", "apple apple apple banana", "apple apple cherry date"]
AND = ["apple banana", "apple cherry", "banana cherry", "apple banana cherry"]
NOT = ["database mysql optimization", "database postgres optimization", "database sqlite lightweight"]
PHRASE = ["quick brown fox", "brown quick dog", "very quick extra brown", None, "", "the", "x " * 5, "brown quick brown quick fox"]


@pytest.fixture(params=[False, True], ids=["texts", "built"])
def index(request, spark):
    def make(texts, stemmed=False):
        made = TextIndex(spark.createDataFrame(list(enumerate(texts, 1)), "id long, text string"), stemmed)
        return made.build(scratch(spark, "test")) if request.param else made

    return make


def ids(df):
    return [r.id for r in df.collect()]


def test_searches(index):
    assert ids(index(TF).search("apple", 10)) == [2, 3, 1]
    assert sorted(ids(index(AND).search("apple banana"))) == [1, 4] and sorted(ids(index(AND).search_or("apple banana"))) == [1, 2, 3, 4]
    assert sorted(ids(index(NOT).search_mode("database -mysql"))) == [2, 3] and sorted(ids(index(NOT).search_mode('"database sqlite" -mysql'))) == [3]
    i = index(PHRASE)
    assert sorted(ids(i.search_phrase("quick brown"))) == [1, 8] and sorted(ids(i.search_mode('"brown quick brown"'))) == [8] and ids(i.search_phrase("the")) == []
    assert i.stats().first().docs == 4
    assert sorted(ids(index(["hello", "hallo", "help", "zzz"]).search_fuzzy("hello"))) == [1, 2, 3]
    p = index(["prefix", "prefer", "pre", "other"])
    assert sorted(ids(p.search_prefix("pref*"))) == [1, 2] and sorted(ids(p.search_prefix("pr*", most=1))) == [3] and sorted(ids(p.search_prefix("pr*", most=None))) == [1, 2, 3]


def test_scores_are_bm25(index):
    found = {r.id: r.score for r in index(TF).search("apple").collect()}
    docs = [t.split() for t in TF]
    mean = sum(map(len, docs)) / 3
    for k, d in enumerate(docs, 1):
        tf = d.count("apple")
        assert found[k] == pytest.approx(math.log(0.5 / 3.5 + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean)))


def test_every_search_of_a_stemmed_index_uses_stems(index):
    i = index(["he was running fast", "runs faster", "walking dogs"], True)
    for search in (i.search, i.search_or, i.search_mode, i.search_fuzzy):
        assert sorted(ids(search("running"))) == [1, 2], search
    assert ids(i.search_phrase("runs fast")) == [1] and ids(i.search_mode("run -faster")) == [1]
    assert sorted(ids(i.search_prefix("run*"))) == [1, 2] and ids(i.search_prefix("walks dog*")) == [3]
    shown = {r.id: r.snippets for r in i.highlight("run").collect()}
    assert shown == {1: ["he was <em>running</em> fast"], 2: ["<em>runs</em> faster"]}


@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("ponies", "poni"), ("feed", "feed"), ("agreed", "agre"), ("hopping", "hop"), ("falling", "fall"), ("relational", "relat"), ("hopefulness", "hope"), ("electricity", "electr"), ("controlling", "control"), ("sky", "sky"), ("happy", "happi"), ("is", "is")])
def test_stems(word, stem):
    assert tx.stem(word) == stem


def test_tokens_equal_the_contract(spark):
    texts = ["The Quick-brown_fox 1x x", "é" + "a" * 64 + " " + "b" * 65 + " c" * 3, "ISn't İstanbul Kelvin abKcd", None, "", "about aboutx xabout The", "a1 22 _x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.tokens(df_col()).alias("k"))
    for t, k in df.collect():
        want = [w.lower() for w in re.findall("[A-Za-z0-9_]+", t or "") if 2 <= len(w) <= 64]
        assert k == [w for w in want if w not in tx.STOP_WORDS]


def df_col():
    from pyspark.sql import functions as F

    return F.col("t")


def test_highlights_equal_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    found = {r.doc_id: r.n for r in registry.QUERIES["fts_highlight"](spark, SMALL).collect()}
    want = {}
    for d, text in docs.items():
        at = [m.span() for m in re.finditer("[A-Za-z0-9_]+", text or "") if m[0].lower() == "ertion"]
        n, end = 0, None
        for s, e in at:
            n += end is None or max(0, s - 80) > end + 40
            end = min(len(text), e + 80)
        if at:
            want[d] = min(3, n)
    assert found == want and Counter(found.values())


def test_stemmed_query_equals_brute_force(spark):
    docs = {r.doc_id: [tx.stem(w) for w in tx.phrase_tokens(r.text or "")] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    docs = {d: k for d, k in docs.items() if k}
    mean = sum(map(len, docs.values())) / len(docs)
    want = {}
    for term in {tx.stem("ertions"), tx.stem("inlying")}:
        hit = {d: k.count(term) for d, k in docs.items() if term in k}
        for d, tf in hit.items():
            want[d] = want.get(d, 0) + math.log((len(docs) - len(hit) + 0.5) / (len(hit) + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(docs[d]) / mean))
    found = {r.doc_id: r.score for r in registry.QUERIES["fts_stemmed"](spark, SMALL).collect()}
    assert found and found == pytest.approx(want, abs=2e-6)
