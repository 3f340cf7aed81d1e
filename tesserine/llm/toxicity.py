"""Toxicity by a convolutional text classifier, trained in numpy on all labelled rows.

Words and their first bytes are hashed to rows of an embedding table; filters of
several widths slide over the whole text, each keeps its maximum, and a logistic
layer reads these. As a filter is a sum over its places, what it makes of a word is
one row of outputs by place, kept by each worker for the words it meets, so that
scoring gathers and adds. The score's only input is the text.

Training rows are dealt by a hash of their id to shards, files of word numbers that
executors write. In each epoch a task goes over each shard from the same network;
what changed is averaged by rows, in whole numbers, so that the order of sums has no
part. Scores of the rows set aside for it are counted in levels by language, and
per-language thresholds calibrated on these counts make a decision of a score.
"""

from __future__ import annotations

import copy
import io
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 16, 12, (1, 2, 3), 8
#: A word's embedding is the sum of those of the word and of its first so many
#: bytes, so that a word of a known stem is no stranger.
PREFIXES = (4, 5)
FEATURES = 1 + len(PREFIXES)
MARKS = b".,;:!?\"'()[]-*#$%&|<>_~"
#: Words whose outputs a worker keeps.
CACHE_WORDS = 100_000
#: What `sample` gives at most of each class, in rows and bytes of text. Training takes
#: every labelled row.
TRAIN_ROWS, TRAIN_BYTES = 3000, 32 << 20
#: Rows of a training shard, about; a shard ends sooner where its texts or its words
#: are many.
SHARD_ROWS, SHARD_BYTES, SHARD_WORDS = 1 << 13, 32 << 20, 1 << 19
EPOCHS, BATCH, RATE, SEED = 6, 64, 0.02, 7
#: Words of one chunk of a text, and of the texts that training goes over at once.
CHUNK, BLOCK = 1 << 12, 1 << 16
#: Parts of one in which shards' changes are summed, and levels of scores in which
#: calibration counts its rows.
UNIT, LEVELS = 1 << 30, 1 << 16
#: Training texts that a bucket must occur in; rarer ones count for nothing.
LEAST_TEXTS = 5
#: Share of false alarms among clean rows that a language's threshold allows, and the
#: weight of all languages' calibration rows together in that of one, in rows of its
#: own.
FALSE_ALARMS, PRIOR_ROWS = 0.002, 100


def features(words: Iterable[bytes]) -> np.ndarray:
    """FEATURES buckets of each word: the word without marks at its ends, and its
    first PREFIXES bytes, each hashed; 0 where there is nothing to hash."""
    bare = [w.strip(MARKS) for w in words]
    size = np.array([len(w) for w in bare], np.int64)
    out = np.zeros((len(bare), FEATURES), np.int64)
    out[:, 0] = np.where(size > 0, np.array([zlib.crc32(w) for w in bare], np.int64) % (BUCKETS - 1) + 1, 0)
    for k, p in enumerate(PREFIXES):
        out[:, k + 1] = np.where(size >= p, np.array([zlib.crc32(w[:p], p) for w in bare], np.int64) % (BUCKETS - 1) + 1, 0)
    return out


class Words(dict):
    """Numbers for words, in order of their first appearance; fresh has those that
    came since it was last emptied."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n

    def ids(self, text: bytes) -> np.ndarray:
        """Numbers of a text's words, A-Z lower-cased."""
        words = text.lower().split()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


@dataclass
class Model:
    table: np.ndarray  # bucket x columns: what each filter's place makes of a bucket
    bias: np.ndarray
    out: np.ndarray
    out_bias: float

    def __post_init__(self) -> None:
        self._reset()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._reset()

    def forget(self) -> None:
        """Empties the cache of words."""
        self._reset()

    def _reset(self) -> None:
        self._words, self._rows = Words(), np.zeros((1 << 12, self.table.shape[1]), np.float32)

    def _ids(self, text: bytes) -> np.ndarray:
        """Word numbers, with the outputs of new words put into the rows."""
        if len(self._words) > CACHE_WORDS:
            self._reset()
        ids, fresh = self._words.ids(text), self._words.fresh
        if fresh:
            if len(self._rows) < len(self._words):
                self._rows = np.concatenate([self._rows, np.zeros((len(self._words), self._rows.shape[1]), np.float32)])
            self._rows[len(self._words) - len(fresh) : len(self._words)] = self.table[features(fresh)].sum(axis=1)
            fresh.clear()
        return ids

    def score(self, text: bytes) -> float:
        """Of a whole text, in chunks that overlap by the widest filter."""
        ids = self._ids(text)
        pooled = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        for i in range(0, len(ids), CHUNK):
            part = self._rows.take(ids[i : i + CHUNK + max(WIDTHS) - 1], axis=0)
            c = 0
            for k, w in enumerate(WIDTHS):
                n = len(part) - w + 1
                if n > 0:
                    total = part[:n, c : c + FILTERS]
                    for j in range(1, w):
                        total = total + part[j : j + n, c + j * FILTERS : c + (j + 1) * FILTERS]
                    s = slice(k * FILTERS, (k + 1) * FILTERS)
                    pooled[s] = np.maximum(pooled[s], total.max(axis=0) + self.bias[s])
                c += w * FILTERS
        return float(1 / (1 + np.exp(-np.clip(pooled @ self.out + self.out_bias, -30, 30))))


@dataclass
class Shard:
    """Training rows: word numbers of all texts one after the other, and each word's
    buckets."""

    ids: np.ndarray
    sizes: np.ndarray
    labels: np.ndarray
    buckets: np.ndarray

    @staticmethod
    def of(words: Words, ids: list[np.ndarray], labels: list[float]) -> Shard:
        return Shard(np.concatenate([np.zeros(0, np.int32), *ids]), np.array([len(x) for x in ids], np.int64), np.array(labels, np.float32), features(words).astype(np.uint16))

    def seen(self) -> np.ndarray:
        """Texts that each bucket occurs in."""
        out = np.zeros(BUCKETS, np.int64)
        for t in np.split(self.ids, np.cumsum(self.sizes)[:-1]):
            out[np.unique(self.buckets[np.unique(t)])] += 1
        out[0] = 0
        return out

    def save(self, path: str) -> None:
        made = io.BytesIO()
        np.savez(made, ids=self.ids, sizes=self.sizes, labels=self.labels, buckets=self.buckets)
        with common.open_output(path) as f:
            f.write(made.getbuffer())

    @staticmethod
    def load(path: str) -> Shard:
        with common.open_input(path) as f, np.load(io.BytesIO(f.read())) as z:
            return Shard(**{k: z[k] for k in ("ids", "sizes", "labels", "buckets")})


#: First column of each width's places in what the filters make of a word.
PLACES = [FILTERS * sum(WIDTHS[:k]) for k in range(len(WIDTHS))]


@dataclass
class Net:
    """The network in training. Buckets that few texts have (rare) stay zero, and so
    do words that training never saw."""

    rare: np.ndarray
    emb: np.ndarray
    emb_v: np.ndarray
    dense: dict[str, np.ndarray]
    moments: dict[str, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    t: float = 0

    @staticmethod
    def new(seen: np.ndarray, seed: int = SEED) -> Net:
        rng = np.random.default_rng(seed)
        rare = seen < LEAST_TEXTS
        emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        emb[rare] = 0
        dense = {f"f{k}": rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for k, w in enumerate(WIDTHS)}
        dense |= {"bias": np.zeros(len(WIDTHS) * FILTERS, np.float32), "out": rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), "b": np.zeros(1, np.float32)}
        return Net(rare, emb, np.zeros(BUCKETS, np.float32), dense, {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in dense.items()})

    def model(self) -> Model:
        table = np.concatenate([self.emb @ f for k in range(len(WIDTHS)) for f in self.dense[f"f{k}"]], axis=1)
        return Model(table, self.dense["bias"], self.dense["out"], float(self.dense["b"][0]))

    def _step(self, name: str, grad: np.ndarray) -> None:
        m, v = self.moments[name]
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        self.dense[name] -= RATE * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-6)

    def _pool(self, shard: Shard, buckets: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's maximum over each text (-inf where the text is too short for
        it), and the place among the shard's ids where it begins. Texts are gone over
        in pieces that overlap by the widest filter, BLOCK words or so at once."""
        wide = max(WIDTHS) - 1
        most = np.full((len(starts), len(WIDTHS) * FILTERS), -np.inf, np.float32)
        place = np.zeros(most.shape, np.int64)
        every = np.concatenate([f for k in range(len(WIDTHS)) for f in self.dense[f"f{k}"]], axis=1)
        pieces = [(r, i, min(BLOCK, n - i), min(BLOCK + wide, n - i)) for r, n in enumerate(sizes) for i in range(0, n, BLOCK)]
        while pieces:
            some, total = [], 0
            while pieces and (not some or total + pieces[-1][3] <= BLOCK):
                some.append(pieces.pop())
                total += some[-1][3]
            unique, inverse = np.unique(np.concatenate([shard.ids[starts[r] + i : starts[r] + i + m] for r, i, _, m in some]), return_inverse=True)
            made = (self.emb[buckets[unique]].sum(axis=1) @ every).take(inverse, axis=0)
            at = 0
            for r, i, n, m in some:
                part = made[at : at + m]
                at += m
                for k, w in enumerate(WIDTHS):
                    n_w, c, s = min(n, m - w + 1), PLACES[k], slice(k * FILTERS, (k + 1) * FILTERS)
                    if n_w > 0:
                        own = part[:n_w, c : c + FILTERS]
                        for j in range(1, w):
                            own = own + part[j : j + n_w, c + j * FILTERS : c + (j + 1) * FILTERS]
                        a = own.argmax(axis=0)
                        top = own[a, np.arange(FILTERS)]
                        more = top > most[r, s]
                        place[r, s] = np.where(more, starts[r] + i + a, place[r, s])
                        most[r, s] = np.where(more, top, most[r, s])
        return most, place

    def epoch(self, shard: Shard, rng: np.random.Generator) -> None:
        """Adam over shuffled batches. A row's gradient passes through the place of
        each filter's maximum alone, so a step touches few words."""
        buckets = shard.buckets.astype(np.int64)
        buckets[self.rare[buckets]] = 0
        begins = np.cumsum(shard.sizes) - shard.sizes
        order = rng.permutation(np.flatnonzero(shard.sizes))
        for lo in range(0, len(order), BATCH):
            rows = order[lo : lo + BATCH]
            self.t += 1
            most, place = self._pool(shard, buckets, begins[rows], shard.sizes[rows])
            act = np.where(np.isfinite(most), np.maximum(most + self.dense["bias"], 0), 0)
            p = 1 / (1 + np.exp(-np.clip(act @ self.dense["out"] + self.dense["b"][0], -30, 30)))
            dz = ((p - shard.labels[rows]) / len(rows)).astype(np.float32)
            d_act = dz[:, None] * self.dense["out"][None, :] * (act > 0)
            d_out = act.T @ dz + 1e-4 * self.dense["out"]
            places = [[np.minimum(place[:, k * FILTERS : (k + 1) * FILTERS] + j, len(shard.ids) - 1) for j in range(w)] for k, w in enumerate(WIDTHS)]
            unique, inverse = np.unique(np.concatenate([shard.ids[x].ravel() for by in places for x in by]), return_inverse=True)
            e = self.emb[buckets[unique]].sum(axis=1)
            d_word = np.zeros_like(e)
            at, d_filters = 0, []
            for k, w in enumerate(WIDTHS):
                g = d_act[:, k * FILTERS : (k + 1) * FILTERS]
                filters = self.dense[f"f{k}"]
                d_filter = np.zeros_like(filters)
                for j in range(w):
                    got = inverse[at : at + g.size]
                    at += g.size
                    d_filter[j] = np.einsum("rfd,rf->df", e[got.reshape(g.shape)], g)
                    np.add.at(d_word, got, (g[:, :, None] * filters[j].T[None]).reshape(-1, DIM))
                d_filters.append(d_filter)
            for k, d_filter in enumerate(d_filters):
                self._step(f"f{k}", d_filter)
            self._step("bias", d_act.sum(axis=0))
            self._step("out", d_out)
            self._step("b", np.array([dz.sum()], np.float32))
            own, to = np.unique(buckets[unique].ravel(), return_inverse=True)
            d_emb = np.zeros((len(own), DIM), np.float32)
            np.add.at(d_emb, to.ravel(), np.repeat(d_word, FEATURES, axis=0))
            self.emb_v[own] += (d_emb * d_emb).mean(axis=1)
            self.emb[own] -= 0.05 * d_emb / (np.sqrt(self.emb_v[own])[:, None] + 1e-6)
            self.emb[0] = 0

    def values(self) -> np.ndarray:
        """All that training changes, DIM + 1 numbers a row: a row for each bucket,
        then all else. All are small, as they are summed in UNITs as 64-bit integers."""
        rest = np.concatenate([x.ravel().astype(np.float64) for k, v in self.dense.items() for x in (v, *self.moments[k])] + [np.array([self.t / 1024])])
        rest = np.concatenate([rest, np.zeros(-len(rest) % (DIM + 1))])
        return np.concatenate([np.column_stack([self.emb, self.emb_v]).astype(np.float64), rest.reshape(-1, DIM + 1)])

    def with_values(self, values: np.ndarray) -> Net:
        net, rest, at = copy.deepcopy(self), values[BUCKETS:].ravel(), 0
        net.emb, net.emb_v = values[:BUCKETS, :DIM].astype(np.float32), np.maximum(values[:BUCKETS, DIM], 0).astype(np.float32)
        for k, v in net.dense.items():
            for x in (v, *net.moments[k]):
                x[...] = rest[at : at + x.size].reshape(x.shape)
                at += x.size
            np.maximum(net.moments[k][1], 0, out=net.moments[k][1])  # a mean of squares, rounded, may be under 0
        net.t = float(rest[at] * 1024)
        return net


def train(texts: list[bytes], labels: np.ndarray, seed: int = SEED) -> Model:
    """On texts at hand, as one shard."""
    words = Words()
    shard = Shard.of(words, [words.ids(t).astype(np.int32) for t in texts], list(labels))
    net = Net.new(shard.seen(), seed)
    for k in range(EPOCHS):
        net.epoch(shard, np.random.default_rng([seed, k, 0]))
    return net.model()


def remainder() -> Column:
    """crc32(doc_id as text) mod 5; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def known_labels(labels: DataFrame) -> DataFrame:
    """doc_id and label of each labelled id outside the held-out fold; of conflicting
    labels the toxic one."""
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & (remainder() != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def texts_of(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), (F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")).alias("lang"))


def sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> list:
    """At most `rows` labelled rows of each class outside the held-out fold, with
    their whole texts, of most_bytes UTF-8 bytes together, to look at or to train on
    by `train`; `fit` has no part of it. The labels are cut down before they meet the
    texts, and the texts by their lengths before they are sent."""
    known, some = known_labels(labels), None
    for label in (0, 1):
        part = known.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        some = part if some is None else some.union(part)
    texts = texts_of(docs)
    key = ("doc_id", F.xxhash64("text").alias("h"))
    sizes = texts.join(F.broadcast(some), "doc_id").select(*key, "toxic", F.octet_length("text").alias("n")).distinct()  # 2 x rows ids at most
    left, chosen = {0: (rows, most_bytes), 1: (rows, most_bytes)}, []
    for r in sizes.orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(4 * rows).collect():
        n, room = left[r["toxic"]]
        if n and r["n"] <= room:
            left[r["toxic"]] = n - 1, room - r["n"]
            chosen.append((r["doc_id"], r["h"], r["toxic"]))
    if not chosen:
        return []
    picked = docs.sparkSession.createDataFrame(chosen, "doc_id long, h long, toxic int")
    found = texts.select(*key, "text", "lang").join(F.broadcast(picked), ["doc_id", "h"])
    return found.groupBy("doc_id", "h", "toxic").agg(F.first("text").alias("text"), F.min("lang").alias("lang")).orderBy(F.xxhash64("doc_id"), "doc_id", "h").collect()


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every labelled row outside the held-out fold with its whole text, once where it
    is repeated: doc_id, h (a hash of the text), toxic, text, lang, and check, whether
    it is set aside for calibration. A bitmap of the labelled ids passes over most
    other texts, so that few are shuffled in vain."""
    spark = docs.sparkSession
    known = common.stored(known_labels(labels), "toxicity-labels")
    bits = 64 * common.bitmap_words(known.count(), common.BITMAP_WORDS)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    mask = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id), {bits}) % 64 as int))")
    bitmap = known.select(F.shiftright(place, 6).alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("bits"))
    texts = texts_of(docs).withColumn("word", F.shiftright(place, 6)).withColumn("mask", mask)
    likely = texts.join(F.broadcast(bitmap), "word").filter(F.col("bits").bitwiseAND(F.col("mask")) != 0)
    found = likely.select("doc_id", F.xxhash64("text").alias("h"), "text", "lang").join(known.hint("shuffle_hash"), "doc_id")
    once = found.groupBy("doc_id", "h", "toxic").agg(F.first("text").alias("text"), F.min("lang").alias("lang"))
    check = F.crc32(F.concat(F.lit("calibrate"), F.col("doc_id").cast("string")).cast("binary")) % 5 == 0
    common.bounded_batches(spark)
    rows = common.stored(once.withColumn("check", check), "toxicity-rows")
    common.discard(known)
    return rows


def shards(rows: DataFrame, n: int, folder: str) -> tuple[list[tuple[str, int]], np.ndarray]:
    """Writes n training rows as shards into a folder. Their files and numbers of rows,
    in an order that partitions have no part in, and the texts that each bucket occurs
    in."""
    dealt = -(-n // SHARD_ROWS)
    rows = rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(dealt)).alias("bin"), F.xxhash64("doc_id", "h").alias("mixed"), "doc_id", "h", "toxic", "text")
    rows = rows.repartitionByRange(dealt, "bin").sortWithinPartitions("bin", "mixed", "doc_id", "h").select("bin", "toxic", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, size, words, ids, labels = -1, 0, 0, Words(), [], []

        def close() -> Iterator[pa.RecordBatch]:
            if ids:
                shard, path = Shard.of(words, ids, labels), f"{folder}/{now}-{part}.npz"
                shard.save(path)
                seen = shard.seen()
                some = np.flatnonzero(seen)
                yield pa.RecordBatch.from_arrays([pa.array([path] + [None] * len(some), pa.string()), pa.array([-1, *some], pa.int32()), pa.array([len(ids), *seen[some]], pa.int64())], ["path", "bucket", "n"])

        for batch in batches:
            for bin_, toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), common.bytes_of(batch.column(2)), strict=True):
                if bin_ != now or size + len(text) > SHARD_BYTES or len(words) > SHARD_WORDS:
                    yield from close()
                    now, part, size, words, ids, labels = bin_, part + 1 if bin_ == now else 0, 0, Words(), [], []
                ids.append(words.ids(text).astype(np.int32))
                words.fresh.clear()
                labels.append(toxic)
                size += len(text)
        yield from close()

    made = common.stored(rows.mapInArrow(common.given_back(run), "path string, bucket int, n long"), "toxicity-seen")
    files = sorted((r["path"], r["n"]) for r in made.filter(F.col("path").isNotNull()).select("path", "n").collect())
    counts = made.filter(F.col("path").isNull()).groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(BUCKETS, np.int64)
    seen[counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    common.discard(made)
    return files, seen


def trained(spark: SparkSession, files: list[tuple[str, int]], seen: np.ndarray) -> Net:
    """A network that has gone EPOCHS times over all shards. Tasks begin an epoch with
    one network and go over a shard each; the next begins with the mean, by rows, of
    what they made of it (of a bucket, of those that met it). A single shard's task
    has nothing to wait for and does all epochs."""
    net = Net.new(seen)
    if not files:
        return net
    epochs = EPOCHS if len(files) == 1 else 1
    given = spark.createDataFrame([(k, path, n) for k, (path, n) in enumerate(files)], "k long, path string, n long").repartition(len(files))
    names = [f"v{i}" for i in range(DIM + 1)]
    for first in range(0, EPOCHS, epochs):
        shared = spark.sparkContext.broadcast(net)  # its size is set by BUCKETS alone

        def run(batches: Iterable[pa.RecordBatch], shared=shared, first=first) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k, path, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    own, shard = copy.deepcopy(shared.value), Shard.load(path)
                    for e in range(first, first + epochs):
                        own.epoch(shard, np.random.default_rng([SEED, e, k]))
                    moved = np.rint((own.values() - shared.value.values()) * (n * UNIT)).astype(np.int64)
                    at = np.flatnonzero(moved.any(axis=1) | (np.arange(len(moved)) >= BUCKETS))
                    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.full(len(at), n), pa.int64()), *(pa.array(moved[at, i]) for i in range(DIM + 1))], ["at", "n", *names])

        parts = given.mapInArrow(common.given_back(run), ", ".join(["at int", "n long", *(f"{x} long" for x in names)]))
        mean = [(F.sum(x) / F.sum("n") / UNIT).alias(x) for x in names]
        got = parts.groupBy("at").agg(*mean).toArrow()
        values = net.values()
        values[got["at"].to_numpy()] += np.column_stack([got[x].to_numpy() for x in names])
        net = net.with_values(values)
        shared.destroy()
    return net


def thresholds_of(rows: DataFrame, model: Model) -> dict[str | None, float]:
    """The threshold of each language (None: of any other), by the scores of all rows,
    counted in LEVELS."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(c: dict[str, list]) -> dict[str, list]:
        return {"lang": c["lang"], "toxic": c["toxic"], "level": [round(shared.value.score(t) * LEVELS) for t in c["text"]]}

    levels = common.map_rows(rows.select("lang", "toxic", "text"), "lang string, toxic int, level int", run, binary=("text",), done=lambda: shared.value.forget())
    counts = common.stored(levels.groupBy("lang", "toxic", "level").agg(F.count("*").alias("n")), "toxicity-levels")
    every = counts.groupBy("level", "toxic").agg(F.sum("n").alias("n")).orderBy("level", "toxic").toArrow()  # 2 x LEVELS at most
    level, toxic, n = (every[x].to_numpy() for x in ("level", "toxic", "n"))
    shared.destroy()

    def own(table: pa.Table) -> pa.Table:
        mine = np.zeros(len(n))
        mine[np.searchsorted(2 * level + toxic, 2 * table["level"].to_numpy() + table["toxic"].to_numpy())] = table["n"].to_numpy()
        return pa.table({"lang": table["lang"][:1], "threshold": [calibrate(level / LEVELS, toxic, mine + n * (PRIOR_ROWS / n.sum()))]})

    found = counts.filter(F.col("lang").isNotNull()).groupBy("lang").applyInArrow(own, "lang string, threshold double").collect()
    common.discard(counts)
    return {None: calibrate(level / LEVELS, toxic, n.astype(np.float64)), **{r["lang"]: r["threshold"] for r in found}}


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Model, dict[str | None, float]]:
    """A model, and the threshold of each language (None: of any other), of all
    labelled rows outside the held-out fold: a fifth of them, by a hash of the id, is
    for the thresholds, the others for the model."""
    spark, rows = docs.sparkSession, labelled(docs, labels)
    folder = common.scratch(spark, "toxicity-shards")
    n = rows.filter(~F.col("check")).count()
    files, seen = shards(rows.filter(~F.col("check")), n, folder) if n else ([], np.zeros(BUCKETS, np.int64))
    model = trained(spark, files, seen).model()
    common.remove(spark, folder)
    thresholds = thresholds_of(rows.filter("check"), model)
    common.discard(rows)
    common.give_back()
    return model, thresholds


def calibrate(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None) -> float:
    """The threshold with most right decisions among those whose false alarms are
    few; in a gap between scores, its middle. Rows count by their weights."""
    if not len(scores) or not (labels == 1).any():
        return 0.5
    weights = np.ones(len(scores)) if weights is None else weights
    points = np.unique(np.concatenate([scores, [0.0, 1.0]]))
    cuts = (points[:-1] + points[1:]) / 2

    def over(label: int) -> np.ndarray:
        """Share, by weight, of a label's rows at or over each cut."""
        own = labels == label
        order = np.argsort(scores[own])
        total = np.concatenate([[0.0], np.cumsum(weights[own][order])])
        if total[-1] == 0:
            return np.zeros(len(cuts))
        return 1 - total[np.searchsorted(scores[own][order], cuts)] / total[-1]

    alarms = over(0)
    right = np.where(alarms <= FALSE_ALARMS + 1e-9, over(1) - alarms - 1e-3 * np.abs(cuts - 0.5), -2.0)
    return float(cuts[right.argmax()]) if right.max() > -1 else 0.5


def _scorer(spark, model: Model):
    shared = spark.sparkContext.broadcast(model)  # its size is set by BUCKETS alone

    def scores(texts: list[bytes]) -> list[float]:
        model = shared.value
        return [model.score(t) for t in texts]

    return scores, lambda: shared.value.forget()


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, threshold, toxic (score over the
    language's threshold) of every row of docs.

    Null and empty texts get the score of a text without words. A null doc_id is
    not held out, one that is no number raises. Repeated rows give repeated rows;
    other columns are ignored; an empty labels table gives an untrained model's
    scores.
    """
    model, thresholds = fit(docs, labels)
    spark = docs.sparkSession
    scores, done = _scorer(spark, model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder() == 0, F.lit(False)).alias("held_out"), (F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")).alias("lang"), F.col("text").cast("string").alias("__text"))

    def run(c: dict[str, list]) -> dict[str, list]:
        s = scores(c["__text"])
        cut = [thresholds.get(x, thresholds[None]) for x in c["lang"]]
        return {"doc_id": c["doc_id"], "held_out": c["held_out"], "score": s, "predicted": [int(x >= 0.5) for x in s], "threshold": cut, "toxic": [x >= t for x, t in zip(s, cut, strict=True)]}

    return common.map_rows(rows, "doc_id long, held_out boolean, score double, predicted int, threshold double, toxic boolean", run, binary=("__text",), done=done)


def filtered(docs: DataFrame, labels: DataFrame, training: DataFrame | None = None) -> DataFrame:
    """Rows of docs under their language's threshold, with docs' own columns. The
    model is trained on labelled rows of `training`, or of docs.

    Null and empty texts get the score of a text without words, rows of a null or
    unknown language the threshold of all; repeated rows get one decision; an empty
    table gives an empty one, and without labels an untrained model decides. A text
    id that is no number raises, as ids are cast to long."""
    model, thresholds = fit(training if training is not None else docs, labels)
    scores, done = _scorer(docs.sparkSession, model)
    text = docs.columns.index("text")
    lang = docs.columns.index("lang") if "lang" in docs.columns else None
    common.bounded_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(lang).to_pylist() if lang is not None else [None] * batch.num_rows
            keep = [s < thresholds.get(x, thresholds[None]) for s, x in zip(scores(common.bytes_of(batch.column(text))), langs, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(common.given_back(run, done), docs.schema)
