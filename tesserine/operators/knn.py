"""Nearest neighbours: exact, by inverted lists around centroids, and text embedding
by hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as V


def search(vectors: DataFrame, query: Sequence[float], k: int = 10, metric: str = "cosine", dims: int | None = None) -> DataFrame:
    """id, distance of the k nearest rows of vectors (id, embedding), ascending, ties
    by id. Rows of another size have no distance and don't count."""
    if k <= 0:
        raise ValueError("k must be positive")
    if not query or (dims is not None and len(query) != dims):
        raise ValueError("the query has the wrong number of dimensions")
    d = V.METRICS[metric](F.col("embedding"), V.constant(query))
    return vectors.select("id", d.alias("distance")).filter("distance IS NOT NULL").orderBy("distance", "id").limit(k)


def search_many(vectors: DataFrame, queries: dict[int, Sequence[float]], k: int = 10, metric: str = "cosine", probed: np.ndarray | None = None) -> DataFrame:
    """query_id, id, distance for a stated set of queries. One pass: each batch of
    vectors meets all queries in one matrix product, keeps k of its rows for each,
    and the few left are cut to k in the end. With probed (queries by lists), a
    query meets only the vectors whose column list it probes."""
    names = [q for q, v in queries.items() if v is not None and len(v)]
    if len({len(queries[q]) for q in names}) != 1:
        parts = [{q: queries[q] for q in names if len(queries[q]) == n} for n in sorted({len(queries[q]) for q in names})]
        none = vectors.sparkSession.createDataFrame([], "query_id long, id long, distance double")
        return reduce(DataFrame.unionByName, [search_many(vectors, p, k, metric) for p in parts], none)
    matrix = np.array([queries[q] for q in names], np.float64)

    def distances(x: np.ndarray, matrix: np.ndarray = matrix) -> np.ndarray:
        if metric == "cosine":
            n = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(matrix, axis=1)[None]
            with np.errstate(invalid="ignore", divide="ignore"):
                return np.where(n == 0, 0.0, np.clip(1 - x @ matrix.T / n, 0, 2))
        if metric == "inner_product":
            return -(x @ matrix.T)
        sq = np.maximum(0, (x * x).sum(1)[:, None] + (matrix * matrix).sum(1)[None] - 2 * x @ matrix.T)
        return np.sqrt(sq) if metric == "euclidean" else sq

    def run(batches):
        best: list[pd.DataFrame] = []
        for batch in batches:
            batch = batch[batch["embedding"].map(lambda v: v is not None and len(v) == matrix.shape[1])]
            if not len(batch):
                continue
            x, ids = np.stack(batch["embedding"].to_numpy()).astype(np.float64), batch["id"].to_numpy()
            if probed is None:
                d = distances(x)
            else:
                d, filed = np.full((len(x), len(names)), np.inf), batch["list"].to_numpy()
                for one in np.unique(filed):
                    rows, qs = np.flatnonzero(filed == one), np.flatnonzero(probed[:, one])
                    d[np.ix_(rows, qs)] = distances(x[rows], matrix[qs])
            for j, q in enumerate(names):
                order = np.lexsort((ids, d[:, j]))[:k]
                order = order[d[order, j] < np.inf]
                best.append(pd.DataFrame({"query_id": q, "id": ids[order], "distance": d[order, j]}))
            if len(best) > 64 * len(names):
                best = [pd.concat(best).sort_values(["distance", "id"]).groupby("query_id").head(k)]
        if best:
            yield pd.concat(best).sort_values(["distance", "id"]).groupby("query_id").head(k)

    from pyspark.sql import Window

    part = vectors.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), *(["list"] if probed is not None else [])).mapInPandas(run, "query_id long, id long, distance double")
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return part.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= k).drop("__r")


def query_blocks(queries: DataFrame, size: int = 512) -> Iterator[dict[int, Sequence[float]]]:
    """The rows of queries (id, embedding) in blocks of about size rows."""
    n = -(-queries.count() // size)
    for b in range(n):
        yield {r[0]: r[1] for r in queries.select("id", "embedding").filter(F.pmod(F.xxhash64("id"), F.lit(n)) == b).collect()}


def search_all(queries: DataFrame, search: Callable[[dict[int, Sequence[float]]], DataFrame]) -> DataFrame:
    """What search gives for all rows of queries, block by block."""
    found = [search(block) for block in query_blocks(queries) if block]
    return reduce(DataFrame.unionByName, found) if found else queries.sparkSession.createDataFrame([], "query_id long, id long, distance double")


class InvertedLists:
    """Approximate search: vectors are filed under the nearest of some centroids, and
    a query looks at the lists of the nearest few. Every vector is filed; centroids
    come from a bounded sample (sample_rows). Null and empty vectors, and those of
    another size than most, are in no list, as they have no distance; a table without
    vectors has no lists and gives no neighbours. At the default of five eighths of
    the lists, the recall of the nearest ten is measured in the tests."""

    def __init__(self, vectors: DataFrame, lists: int = 64, sample_rows: int = 20_000, rounds: int = 10, seed: int = 42):
        spark = vectors.sparkSession
        vectors = vectors.select("id", F.col("embedding").cast("array<double>").alias("embedding")).filter(F.size("embedding") > 0)
        sizes = vectors.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()  # rows of another size have no distance
        self.dims = sizes[0]["n"] if sizes else 0
        vectors = vectors.filter(F.size("embedding") == self.dims)
        part = vectors.select("embedding").orderBy(F.xxhash64("id"), "id").limit(sample_rows)
        x = np.array([r[0] for r in part.collect()], np.float64).reshape(-1, max(1, self.dims))
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
        rng = np.random.default_rng(seed)
        c = x[rng.choice(len(x), min(lists, len(x)), replace=False)] if len(x) else x
        for _ in range(rounds if len(c) else 0):
            near = (x @ c.T).argmax(1)
            for j in range(len(c)):
                own = x[near == j]
                if len(own):
                    m = own.mean(0)
                    c[j] = m / max(np.linalg.norm(m), 1e-30)
        self.centroids = c

        shared = spark.sparkContext.broadcast(c)

        @F.pandas_udf("int")
        def nearest(v: pd.Series) -> pd.Series:
            m = np.stack(v.to_numpy()).astype(np.float64)
            return pd.Series((m @ shared.value.T).argmax(1))

        self.filed = vectors.select("id", "embedding", nearest("embedding").alias("list"))

    def save(self, path: str) -> InvertedLists:
        """Writes the lists as partitions, so that a search reads only its own."""
        self.filed.repartition("list").write.partitionBy("list").parquet(path)
        self.filed = self.filed.sparkSession.read.parquet(path)
        return self

    def probes(self) -> int:
        """Five eighths of the lists, for a recall over 0.9 also where vectors hardly
        cluster."""
        return -(-5 * len(self.centroids) // 8)

    def search_many(self, queries: dict[int, Sequence[float]], k: int = 10, probes: int | None = None) -> DataFrame:
        queries = {q: v for q, v in queries.items() if v is not None and len(v) == self.dims > 0}
        if not queries:
            return self.filed.sparkSession.createDataFrame([], "query_id long, id long, distance double")
        near = np.argsort(-(np.array(list(queries.values()), np.float64) @ self.centroids.T), axis=1)[:, : probes or self.probes()]
        probed = np.zeros((len(queries), len(self.centroids)), bool)
        np.put_along_axis(probed, near, True, axis=1)
        return search_many(self.filed, queries, k, probed=probed)

    def search(self, query: Sequence[float], k: int = 10, probes: int | None = None) -> DataFrame:
        q = np.array(query, np.float64)
        if len(q) != self.dims:
            raise ValueError("the query has the wrong number of dimensions")
        near = np.argsort(-(self.centroids @ q))[: probes or self.probes()].tolist()
        return search(self.filed.filter(F.col("list").isin(near)), query, k)


def hash_embed(docs: DataFrame, dims: int = 128) -> DataFrame:
    """id, embedding of documents (id, text): signed counts of hashed tokens, of
    length one. Documents without tokens have no embedding."""
    h = F.conv(F.substring(F.md5("term"), 1, 8), 16, 10).cast("long")
    each = docs.select("id", F.explode(tx.tokens(F.col("text"))).alias("term")).select("id", h.alias("h"))
    # a document's tokens are in one partition, so sums by cell are nearly done before the shuffle
    sign = F.when(F.shiftright("h", 31) == 1, -1).otherwise(1)
    cells = each.groupBy("id", F.pmod("h", F.lit(dims)).cast("int").alias("cell")).agg(F.sum(sign).alias("v"))
    rows = cells.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("cell", "v"))).alias("m"), F.sum(F.col("v") * F.col("v")).alias("sq")).filter("sq > 0")
    return rows.select("id", F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)) / F.sqrt("sq")).alias("embedding"))
