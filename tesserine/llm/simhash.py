"""SimHash near-duplicates by deletion-variant signatures.

Two 64-bit fingerprints at distance 2 or less agree, in one of two 32-bit
segments, up to one bit. Each segment is indexed under its 32 variants with one
bit masked, so that such segments share a key; an equality join on the keys and
a check of the whole fingerprints give the links. Fingerprints are made distinct
first, so copies cost nothing. A key that many distinct fingerprints share is not
joined with itself: its fingerprints are indexed under all 2,016 variants with
two bits of the whole masked, where a key has four fingerprints at most, all of
them linked. The links of a fingerprint cost a constant, whatever the skew.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SEED = 42
SHINGLE_WORDS = 3
#: Distinct fingerprints under one key up to which they are joined pairwise:
#: about where 64 keys of that many pairs cost as much as the 2,016 variants.
JOIN_UP_TO = 64
#: Most 64-bit words of the bitmap of shared keys, which is broadcast (about 64 bytes
#: a word); beyond 4 million shared keys it fills up, and the second shuffle comes
#: to carry as much as the first.
BITMAP_WORDS = 1 << 20
MASK64 = (1 << 64) - 1


def fingerprint(text: bytes, shingle: int = SHINGLE_WORDS) -> int:
    """Unsigned SimHash of UTF-8 text; zero for a text without words."""
    words = text.lower().split()  # of bytes: A-Z alone, at \x20 and \x09-\x0D alone
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], stops[:-1] + 1])
    n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[i:j], SEED) for i, j in zip(starts[:n].tolist(), stops[shingle - 1 :].tolist(), strict=True)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 14):
        part = hashes[i : i + (1 << 14)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * counts > n).tolist())


def fingerprints(docs: DataFrame) -> DataFrame:
    """Row keys of docs with the signed fingerprint: __id, __hash, fp."""

    def run(c: dict[str, list]) -> dict[str, list]:
        return {"__id": c["__id"], "__hash": c["__hash"], "fp": np.array([fingerprint(t) for t in c["__text"]], np.uint64).view(np.int64)}

    rows = docs.select(*common.row_key("doc_id", "text"), F.col("text").cast("string").alias("__text"))
    kind = "long" if dict(rows.dtypes)["__id"] in ("bigint", "int", "smallint", "tinyint") else dict(rows.dtypes)["__id"]
    return common.map_rows(rows.withColumn("__id", F.col("__id").cast(kind)), f"__id {kind}, __hash long, fp long", run, binary=("__text",))


def _one_wildcard() -> Column:
    """The 64 keys of column fp: segment, masked bit, and the segment without it."""
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    keys = []
    for s, part in enumerate((low, high)):
        keys += [F.lit((s << 37) | (b << 32)).bitwiseOR(part.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << b)))) for b in range(32)]
    return F.array(*keys)


def _two_wildcards() -> Column:
    """The 2,016 masked values of column fp, each with the number of its mask."""
    pairs = [(1 << a) | (1 << b) for a in range(64) for b in range(a)]
    masks = [((MASK64 ^ p) ^ (1 << 63)) - (1 << 63) for p in pairs]
    return F.posexplode(F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: F.col("fp").bitwiseAND(m)))


def links(distinct: DataFrame, join_up_to: int = JOIN_UP_TO) -> DataFrame:
    """Links a > b between distinct fingerprints (column fp), enough of them to
    connect whatever is connected: all links where keys are rare, and where they
    are common a star for each two-wildcard variant."""
    spread = distinct.repartition(common.parallelism(distinct.sparkSession))
    keys = spread.select("fp", F.explode(_one_wildcard()).alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("fp").alias("b"), F.max("fp").alias("a")).filter("m > 1")
    shared = common.stored(shared, "simhash-keys")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    two = shared.filter("m = 2").select("a", "b").filter(close)
    # most keys have one fingerprint, so a bitmap of the others' hashes, whose size
    # is fixed, holds nearly all back from the second shuffle
    common_keys = shared.filter("m > 2").select("key", "m")
    bits = 64 * common.bitmap_words(common_keys.count(), BITMAP_WORDS)
    place = F.pmod(F.xxhash64("key"), F.lit(bits))
    word, mask = F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(key), {bits}) % 64 as int))").alias("mask")
    bitmap = common_keys.select(word, mask).groupBy("word").agg(F.bit_or("mask").alias("bits"))
    likely = keys.select("fp", "key", word, mask).join(F.broadcast(bitmap), "word").filter(F.col("bits").bitwiseAND(F.col("mask")) != 0).select("fp", "key")
    members = common.stored(likely.join(common_keys, "key"), "simhash-members")
    light = members.filter(F.col("m") <= join_up_to)
    few = light.select("key", F.col("fp").alias("a")).join(light.select("key", F.col("fp").alias("b")), "key").filter(F.col("a") > F.col("b")).filter(close).select("a", "b")
    heavy = members.filter(F.col("m") > join_up_to).select("fp").distinct()
    variants = heavy.select("fp", _two_wildcards().alias("mask", "value"))
    stars = variants.groupBy("mask", "value").agg(F.min("fp").alias("b"), F.collect_set("fp").alias("all")).filter(F.size("all") > 1)
    many = stars.select(F.explode("all").alias("a"), "b").filter(F.col("a") != F.col("b"))
    return two.union(few).union(many).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each node of edges (a, b): node, root.

    Alternating large and small stars; each round is a table of its own, and the
    number of rounds grows with the logarithm of a component's size.
    """
    edges = common.stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "cc-edges")
    before, n = None, edges.count()
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        new = common.stored(small, "cc-round", n)
        state = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        common.discard(edges)
        edges = new
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, n = state, state[0]
    raise RuntimeError(f"components are not stable after {rounds} rounds")


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keyed fingerprints of all rows, and root fingerprint of each linked one."""
    keyed = common.stored(fingerprints(docs), "simhash")
    distinct = common.stored(keyed.select("fp").distinct(), "simhash-distinct")
    return keyed, components(links(distinct))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, one row for each row of
    docs (doc_id, text).

    component_id is the smallest doc_id reachable over links at two or fewer
    differing bits. Null, empty and blank texts have fingerprint zero, linked
    like any other. A null doc_id is passed over as a component's name unless all
    are null. Repeated rows give repeated rows; a text of any length is fingerprinted
    whole; other columns are ignored; an empty table gives an empty result.
    """
    keyed, roots = _classes(docs)
    by_fp = keyed.groupBy("fp").agg(F.min("__id").alias("least"))
    rooted = by_fp.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    table = rooted.join(names, "root").select("fp", "component_id")
    return keyed.join(table, "fp").select(F.col("__id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """Rows of docs with one document of each component: that with the smallest
    doc_id (null last), and of rows repeating it one. All columns stay.

    Null, empty and blank texts are one component, of which one row stays. Of rows
    with the least doc_id and different texts that with the least hash stays. An
    empty table gives an empty one."""
    keyed, roots = _classes(docs)
    order = F.struct(F.col("__id").isNull().alias("n"), F.col("__id").alias("__id"), F.col("__hash").alias("__hash"))
    by_fp = keyed.groupBy("fp").agg(F.min(order).alias("least"), F.count(F.lit(1)).alias("rows"))
    rooted = by_fp.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    kept = rooted.groupBy("root").agg(F.min("least").alias("least")).select("least.__id", "least.__hash")
    copies = keyed.groupBy("__id", "__hash").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select(F.col("__id").alias("i"), F.col("__hash").alias("h"))
    kept = common.stored(kept, "simhash-kept")
    repeated = common.stored(kept.join(copies, F.col("__id").eqNullSafe(F.col("i")) & (F.col("__hash") == F.col("h")), "left_semi"), "simhash-repeated")
    mine = F.col("__id").eqNullSafe(F.col("i")) & (F.col("__hash") == F.col("h"))
    gone = keyed.select("__id", "__hash").join(kept.select(F.col("__id").alias("i"), F.col("__hash").alias("h")), mine, "left_anti").distinct()
    rows = common.drop_rows(docs, common.stored(gone, "simhash-gone"), "doc_id", "text")
    if repeated.isEmpty():
        return rows
    once = common.keep_rows(rows, repeated, "doc_id", "text").dropDuplicates(["doc_id", "text"])
    return common.keep_rows(rows, repeated, "doc_id", "text", how="left_anti").unionByName(once)


def words_of(text: str) -> list[str]:
    """The words that fingerprints are made of, for tests."""
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
