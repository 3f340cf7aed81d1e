import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserine.llm import toxicity

from .fixtures import edge_docs, no_docs, prose


def corpus(n=700):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        words = prose(i % 50, 80).split()
        toxic = int(i % 3 == 0)
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), "zorgx" + "".join(rng.choice("abcdef") for _ in range(3)))
        rows.append((i, " ".join(words), rng.choice(["aa", "bb", None])))
        labels.append((i, 1, toxic))
    return rows, labels


def slow_score(model, text: str) -> float:
    """The network as written: an output for each filter and place, the maximum, and
    the logistic layer."""
    words = text.encode().lower().split()
    x = [model.table[toxicity.features([w])[0]].sum(0) for w in words]
    pooled, c = [], 0
    for k, w in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            every = [sum(x[i + j][c + j * toxicity.FILTERS + f] for j in range(w)) for i in range(len(x) - w + 1)]
            pooled.append(max([0.0, *[v + model.bias[k * toxicity.FILTERS + f] for v in every]]))
        c += w * toxicity.FILTERS
    return 1 / (1 + np.exp(-(np.dot(pooled, model.out) + model.out_bias)))


def test_scores_equal_the_network_whatever_the_chunks(monkeypatch):
    rng = np.random.default_rng(3)
    columns = sum(toxicity.WIDTHS) * toxicity.FILTERS
    pooled = len(toxicity.WIDTHS) * toxicity.FILTERS
    model = toxicity.Model(rng.normal(0, 1, (toxicity.BUCKETS, columns)).astype(np.float32), rng.normal(0, 1, pooled).astype(np.float32), rng.normal(0, 0.2, pooled).astype(np.float32), 0.1)
    texts = ["", "one", "two words", prose(4, 70), "### " + prose(5, 9)]
    for chunk in (1 << 12, 4, 1):
        monkeypatch.setattr(toxicity, "CHUNK", chunk)
        for t in texts:
            assert abs(model.score(t.encode()) - slow_score(model, t)) < 1e-4
    monkeypatch.setattr(toxicity, "CACHE_WORDS", 10)
    assert abs(model.score(texts[3].encode()) - slow_score(model, texts[3])) < 1e-4


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in toxicity.score(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(found[i].held_out == (i in set(held)) for i, _, _ in rows)
    assert np.mean([found[i].predicted == labels[i][2] for i in held]) > 0.97
    assert all(found[i].predicted == (found[i].score >= 0.5) for i, _, _ in rows)
    kept = {r.doc_id for r in toxicity.filtered(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    clean = {i for i, _, t in labels if not t}
    assert len(kept & clean) > 0.98 * len(clean) and len(kept - clean) < 0.03 * len(clean)


def test_held_out_labels_and_ids_have_no_part(spark):
    rows, labels = corpus(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    score = lambda x: {r.doc_id: r.score for r in toxicity.score(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()}
    assert score(labels) == score(turned)


def test_thresholds_allow_few_false_alarms():
    clean, toxic = np.linspace(0, 0.6, 500), np.array([0.59, 0.7, 0.9])
    cut = toxicity.calibrate(np.concatenate([clean, toxic]), np.array([0] * 500 + [1] * 3))
    assert (clean >= cut).mean() <= toxicity.FALSE_ALARMS and (toxic >= cut).sum() >= 2
    assert toxicity.calibrate(np.zeros(0), np.zeros(0)) == 0.5


def test_edge_rows(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(3, 1, 1), (4, 1, 0), (4, 0, 1), (None, 1, 1), (7, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for given in (labels, labels.limit(0)):
        rows = toxicity.score(docs, given).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id in (0, 1, 2)}) == 1
    assert toxicity.filtered(docs, labels).columns == docs.columns
    assert toxicity.score(no_docs(spark), labels).count() == toxicity.filtered(no_docs(spark), labels).count() == 0


def test_thresholds_change_smoothly_with_the_rows_of_a_language():
    rng = np.random.default_rng(5)
    scores = np.concatenate([rng.uniform(0, 0.6, 900), rng.uniform(0.5, 1, 100)])
    labels = np.array([0] * 900 + [1] * 100)
    alone = toxicity.calibrate(scores, labels)
    assert toxicity.calibrate(scores, labels, np.full(1000, 3.0)) == alone
    # a row of weight two counts like two rows
    twice = np.concatenate([np.arange(1000), np.arange(0, 1000, 7)])
    weights = np.where(np.arange(1000) % 7 == 0, 2.0, 1.0)
    assert toxicity.calibrate(scores, labels, weights) == toxicity.calibrate(scores[twice], labels[twice])
    # with 99, 100 or 101 own rows there is no jump
    cuts = []
    for own in (99, 100, 101):
        mine = np.zeros(1000)
        mine[:own] = 1
        cuts.append(toxicity.calibrate(scores, labels, mine + toxicity.PRIOR_ROWS / 1000))
    assert max(cuts) - min(cuts) < 0.02


def test_training_texts_are_bounded_in_rows_and_bytes(spark):
    rows, labels = corpus(200)
    rows.append((5000, "zorgx " * 40_000, "aa"))
    docs = spark.createDataFrame([*rows, rows[1]], "doc_id long, text string, lang string")
    known = spark.createDataFrame([*labels, (5000, 1, 1)], "doc_id long, quality int, toxic int")
    every = toxicity.sample(docs, known)
    assert len(every) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i, _, _ in rows)
    few = toxicity.sample(docs, known, rows=10, most_bytes=5000)
    size = {t: sum(len(r.text.encode()) for r in few if r.toxic == t) for t in (0, 1)}
    assert 0 < max(size.values()) <= 5000 and len(few) <= 20 and all(r.doc_id != 5000 for r in few)
    assert [r.doc_id for r in few] == [r.doc_id for r in toxicity.sample(docs.repartition(5), known, rows=10, most_bytes=5000)]


def test_training_lowers_the_loss_and_finds_the_words():
    rng = random.Random(3)
    texts, labels = [], []
    for k in range(240):
        words = prose(k % 20, 30).split()
        if k % 2:
            words.insert(rng.randrange(30), "zorg blarg")
        texts.append(" ".join(words).encode())
        labels.append(k % 2)
    y = np.array(labels, np.float32)
    model = toxicity.train(texts, y)
    p = np.clip([model.score(t) for t in texts], 1e-6, 1 - 1e-6)
    assert -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)) < 0.1 < np.log(2)
    assert [model.score(t) for t in texts[:5]] == [toxicity.train(texts, y).score(t) for t in texts[:5]]
    assert toxicity.train([], np.zeros(0, np.float32)).score(b"a b") == toxicity.train([b""], np.ones(1, np.float32)).score(b"a b")


def many(spark, n=4400):
    """Toxic and clean rows in turn, n of each. A toxic text has one of two words: the
    first among the 3,000 labelled toxic ids outside the held-out fold that have the
    least hash, the other beyond."""
    ids = spark.range(1, 2 * n, 2).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("h"), (toxicity.remainder() == 0).alias("held")).orderBy("h").collect()
    least = {r.doc_id for r in [r for r in ids if not r.held][:3000]}
    most = max(r.h for r in ids if r.doc_id in least)
    word = {r.doc_id: "zorgx" if r.h <= most else "blarg" for r in ids}
    rng = random.Random(5)
    rows = [(i, " ".join([rng.choice(["one", "two", "three", "four"]) for _ in range(6)] + [word.get(i, "five")]), "aa" if i % 4 < 2 else "bb") for i in range(2 * n)]
    return rows, word, spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(i, 1, i % 2) for i in range(2 * n)], "doc_id long, quality int, toxic int")


def test_every_labelled_row_is_learned_from(spark, monkeypatch):
    rows, word, docs, labels = many(spark)
    for size in (1 << 13, 2000):
        monkeypatch.setattr(toxicity, "SHARD_ROWS", size)
        found = {r.doc_id: r for r in toxicity.score(docs, labels).filter("held_out").collect()}
        for w in ("zorgx", "blarg"):
            own = [i for i in found if word.get(i) == w]
            assert len(own) > 50 and all(found[i].predicted == 1 and found[i].toxic for i in own), (size, w)
        assert not any(r.predicted or r.toxic for i, r in found.items() if i not in word)


def test_shards_and_calibration_take_every_row(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 100)
    rows, labels = corpus(600)
    docs = spark.createDataFrame([*rows, rows[1], rows[1]], "doc_id long, text string, lang string")
    got = toxicity.labelled(docs, spark.createDataFrame([*labels, (3, 1, 0), (None, 1, 1), (9999, 1, 1)], "doc_id long, quality int, toxic int"))
    every = {r.doc_id: r for r in got.collect()}
    assert sorted(every) == [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5] and got.count() == len(every)
    assert all((r.text, r.lang, r.toxic) == (rows[i][1], rows[i][2], labels[i][2]) for i, r in every.items())
    part = got.filter("not check")
    files, seen = toxicity.shards(part, part.count(), f"file://{tmp_path}/shards")
    assert len(files) > 2 and sum(n for _, n in files) == part.count() == sum(not r.check for r in every.values())
    slow = np.zeros(toxicity.BUCKETS, int)
    for r in part.collect():
        slow[list(set(toxicity.features(r.text.lower().encode().split()).ravel()) - {0})] += 1
    assert (seen == slow).all()
    # the thresholds are those of every row's score, in levels
    model = toxicity.trained(spark, files, seen).model()
    check = [r for r in every.values() if r.check]
    score = np.array([round(model.score(r.text.encode()) * toxicity.LEVELS) / toxicity.LEVELS for r in check])
    y = np.array([r.toxic for r in check])
    want = {lang: toxicity.calibrate(score, y, np.array([r.lang == lang for r in check]) + toxicity.PRIOR_ROWS / len(check)) for lang in ("aa", "bb")}
    assert toxicity.thresholds_of(got.filter("check"), model) == pytest.approx({None: toxicity.calibrate(score, y), **want})


def test_partitions_and_repeats_have_no_part_in_the_model(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 60)
    rows, labels = corpus(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    (a, cuts), (b, others) = toxicity.fit(docs, known), toxicity.fit(docs.union(docs.limit(40)).repartition(7), known.repartition(3))
    assert (a.table == b.table).all() and (a.out == b.out).all() and cuts == others


def test_long_texts_are_gone_over_in_pieces(monkeypatch):
    words = toxicity.Words()
    texts = [prose(1, 500), "one", "", prose(2, 3), prose(3, 90)]
    shard = toxicity.Shard.of(words, [words.ids(t.encode()).astype(np.int32) for t in texts], [0.0] * 5)
    net = toxicity.Net.new(np.full(toxicity.BUCKETS, 9))
    begins, buckets = np.cumsum(shard.sizes) - shard.sizes, shard.buckets.astype(np.int64)
    most, place = net._pool(shard, buckets, begins, shard.sizes)
    for block in (1, 3, 64):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        again, there = net._pool(shard, buckets, begins, shard.sizes)
        assert np.allclose(most, again, atol=1e-5) and (buckets[shard.ids[place]] == buckets[shard.ids[there]]).all()  # equal phrases tie
    model = net.model()
    for t, m in zip(texts, most, strict=True):
        pooled = np.maximum(np.where(np.isfinite(m), m + model.bias, 0), 0)
        assert abs(1 / (1 + np.exp(-(pooled @ model.out + model.out_bias))) - slow_score(model, t)) < 1e-4


def test_rounded_means_of_squares_dont_fall_under_zero():
    net = toxicity.Net.new(np.full(toxicity.BUCKETS, 9))
    net.t = 77.0
    same = net.with_values(net.values())
    assert same.t == 77 and (same.emb == net.emb).all() and all((same.dense[k] == v).all() for k, v in net.dense.items())
    under = net.with_values(net.values() - 1e-9)
    assert under.emb_v.min() == 0 and all(v.min() >= 0 for _, v in under.moments.values())
    words = toxicity.Words()
    shard = toxicity.Shard.of(words, [words.ids(prose(k, 20).encode()).astype(np.int32) for k in range(100)], [k % 2 for k in range(100)])
    with np.errstate(invalid="raise"):
        under.epoch(shard, np.random.default_rng(1))
    assert np.isfinite(under.values()).all()


def test_the_driver_neither_trains_nor_gets_texts(spark, monkeypatch):
    def never(*_, **__):
        raise AssertionError("in the driver")

    for name in ("train", "sample", "features"):
        monkeypatch.setattr(toxicity, name, never)
    monkeypatch.setattr(toxicity.Words, "ids", never)
    rows, labels = corpus(200)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model, thresholds = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert model.table.any() and set(thresholds) == {None, "aa", "bb"}
