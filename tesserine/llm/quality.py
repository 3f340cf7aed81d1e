"""Quality rules and robust multivariate outliers.

Each text gives counts; base rules reject the shortest and most repetitive ones.
The counts of the others become a vector of transformed statistics, whose centre
and scatter are estimated for each language and source by the minimum covariance
determinant: from several starts (medians and quartile ranges, squashed values,
directions alone), concentration steps keep again and again the share of rows
nearest to the centre and estimate anew from these, and the start that ends in the
least determinant counts. Rows far from the centre by their Mahalanobis distance
are rejected.

A group's estimate leans on its language's, and that on the one of all rows, as
though PRIOR_ROWS rows of it were the group's own. So each group has its own
estimate, of however few rows, and no size makes a difference in kind.

Every step is one aggregation over all rows by group and bin of distance (moments
are sums of integers), so a source with a third of all rows is never gathered
anywhere, and results don't depend on how rows are dealt. Estimates reach the rows
as a broadcast table of at most BROADCAST_GROUPS groups; more are tables, joined on
the group and a salt, to the same result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 20, 30, 8
FEATURES = 5
#: A feature unit is cut into so many steps; moments are integers of these.
SCALE = 1000
#: Least standard deviation of each feature, in its own units: log words, log word
#: length, root of symbols a word, root of duplicate lines a word, root of the
#: repeated share. Many texts have none of the last three, which would leave no
#: scatter; and length alone is no sign of bad text.
FLOORS = (1.5, 0.08, 0.10, 0.06, 0.12)
#: Share of rows that a concentration step keeps, and the most steps; they end
#: when none changes an estimate.
SUBSET, STEPS = 0.75, 8
#: Rows of its language's estimate that a group's own leans on.
PRIOR_ROWS = 100
#: Squared distance beyond which a row is rejected, and that up to which rows
#: enter the last estimate: the 99.9 % and 97.5 % quantiles of chi-square with 5
#: degrees.
CUTOFF, REWEIGHT = 20.515, 12.83
CHI2_MEDIAN = 4.3515
BINS_PER_DOUBLING, LEAST_LOG = 16, -12
#: Groups whose estimates (about 300 bytes each) are broadcast, and the salts of
#: the join where there are more.
BROADCAST_GROUPS, SALTS = 50_000, 64
STARTS = 3


def text_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of UTF-8."""
    words = text.split()
    if not words:
        return 0, 0, sum(text.count(bytes([s])) for s in SYMBOLS), 0, 0
    data = b"".join(words)
    chars = len(data) - int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) == 0x80))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    dup = 0
    if b"\n" in text:
        seen: set[bytes] = set()
        for line in text.split(b"\n"):
            if line in seen:
                dup += bool(line.split())
            else:
                seen.add(line)
    return len(words), chars, symbols, dup, repeated_words(words)


def repeated_words(words: list, width: int = REPEAT_WINDOW) -> int:
    """Words that stand in a window of `width` words found twice or more. Windows
    are named exactly, by doubling: pairs of names of half the width."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    names: dict = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    at, span = np.arange(len(words)), 1
    # only places whose shorter window repeats can start a longer one that does
    while span < width:
        at = at[at + 2 * span <= len(words)]
        key = ids[at] * np.int64(len(words) + 1) + ids[at + span]
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        if span * 2 == width:
            starts = at[count[inverse] > 1]
            break
        fresh = np.full(len(words), -1, np.int64)
        fresh[at] = inverse
        ids, span = fresh, span * 2
        if (count == 1).all():
            return 0
    if not len(starts):
        return 0
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + width, -1)
    return int(np.count_nonzero(np.cumsum(cover)[:-1]))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counts(docs: DataFrame) -> DataFrame:
    """Row keys, lang, source and counts of all rows."""

    def run(c: dict[str, list]) -> dict[str, list]:
        out = list(zip(*(text_counts(t) for t in c["__text"]), strict=True)) or [[]] * 5
        return {k: c[k] for k in ("__id", "__hash", "lang", "source")} | dict(zip(COUNTS, out, strict=True))

    kind = dict(docs.dtypes)["doc_id"]
    names = docs.columns
    rows = docs.select(
        *common.row_key("doc_id", *[c for c in ("text", "lang", "source") if c in names]),
        *[F.coalesce(F.col(c).cast("string") if c in names else F.lit(None).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")],
        F.col("text").cast("string").alias("__text"),
    )
    return common.map_rows(rows, f"__id {kind}, __hash long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS), run, binary=("__text",))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _features() -> list[Column]:
    n = F.col("n_words").cast("double")
    made = (F.log(n), F.log(F.col("word_chars") / n), F.sqrt(F.col("n_symbols") / n), F.sqrt(F.col("n_dup_lines") / n), F.sqrt(F.col("n_repeat_words") / n))
    return [F.round(x * SCALE).cast("long").alias(f"x{i}") for i, x in enumerate(made)]


def squared(x: list[Column], mu: Column, inv: Column) -> Column:
    """Squared Mahalanobis distance of x by a centre and an inverse Cholesky factor
    by rows."""
    total, k = F.lit(0.0), 0
    for i in range(FEATURES):
        row = F.lit(0.0)
        for j in range(i + 1):
            row = row + inv[k] * (x[j] - mu[j])
            k += 1
        total = total + row * row
    return total


def _bin(d: Column) -> Column:
    return F.floor(F.log2(d + 2.0**LEAST_LOG) * BINS_PER_DOUBLING).cast("int")


def estimate(n: float, s: list, q: list, scale: float = 1.0) -> tuple[list[float], list[float]]:
    """Centre and inverse Cholesky factor from sums; the diagonal has the floors
    added, so the factor exists whatever the rows."""
    mu = [x / n for x in s]
    cov, k = np.zeros((FEATURES, FEATURES)), 0
    for i in range(FEATURES):
        for j in range(i + 1):
            cov[i, j] = cov[j, i] = (n * q[k] - s[i] * s[j]) / (n * n)
            k += 1
    cov = cov * scale + np.diag([(f * SCALE) ** 2 for f in FLOORS])
    inv = np.linalg.inv(np.linalg.cholesky(cov))
    return mu, [float(inv[i, j]) for i in range(FEATURES) for j in range(i + 1)]


def blended(own: list, prior: list) -> list:
    """Sums (n, s.., q..) with those of PRIOR_ROWS rows of a prior's mean added."""
    return [a + PRIOR_ROWS * b / prior[0] for a, b in zip(own, prior, strict=True)]


#: Sums of a group: rows, each feature, each product of two.
SUMS = ("n", *(f"s{i}" for i in range(FEATURES)), *(f"q{i}{j}" for i in range(FEATURES) for j in range(i + 1)))


def _sums(x: list[Column]) -> list[Column]:
    """SUMS of long columns. A bin's sums fit a long up to 2e10 rows; ANSI mode
    raises beyond that."""
    products = [x[i] * x[j] for i in range(FEATURES) for j in range(i + 1)]
    return [F.sum(c).alias(n) for n, c in zip(SUMS, [F.lit(1).cast("long"), *x, *products], strict=True)]


def _added(table: DataFrame, *keys: str) -> DataFrame:
    """SUMS of a table of sums by keys, as decimals."""
    return table.groupBy(*keys).agg(*[F.sum(F.col(c).cast("decimal(20,0)") if dict(table.dtypes)[c] == "bigint" else F.col(c)).alias(c) for c in SUMS])


def _met(rows: DataFrame, params: DataFrame, groups: int) -> DataFrame:
    """rows (grp, h: a hash) with the other columns of params (grp, ...; stored), of
    which each of so many groups has one row."""
    if groups <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(params), "grp")
    salted = params.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod("h", F.lit(SALTS)).cast("int")).join(salted, ["grp", "__salt"]).drop("__salt")


def _within(table: DataFrame, keep: Column) -> DataFrame:
    """The bins of a table (lang, grp, start, bin, sums) that keep takes, by the
    running count `before` them and the count `all` of their group and start."""
    w = Window.partitionBy("grp", "start")
    run = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    return table.withColumn("before", F.coalesce(F.sum("n").over(run), F.lit(0))).withColumn("all", F.sum("n").over(w)).filter(keep)


def _solved(sums: DataFrame, fields: str, solve) -> DataFrame:
    """grp, start and fields of solve(blended sums, row as a dict) for sums (lang,
    grp, start, SUMS and more). Sums of a language are those of its groups."""
    by_lang, by_all = _added(sums, "lang", "start"), _added(sums, "start")
    named = lambda t, p: t.select(*[F.col(c).alias(p + c) if c in SUMS else F.col(c) for c in t.columns])
    joined = sums.join(named(by_lang, "l_"), ["lang", "start"]).join(F.broadcast(named(by_all, "a_")), "start")  # STARTS rows
    strings = joined.select(*[F.col(c).cast("string").alias(c) if c.split("_")[-1] in SUMS else F.col(c) for c in joined.columns])

    def run(c: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {f.split()[0]: [] for f in ("grp", "start", *fields.split(", "))}
        for row in zip(*c.values(), strict=True):
            r = dict(zip(c, row, strict=True))
            own, lang, every = ([int(r[p + n]) for n in SUMS] for p in ("", "l_", "a_"))
            r |= {"grp": r["grp"], "start": r["start"]} | solve(blended(own, blended(lang, every)), r)
            for name, values in out.items():
                values.append(r[name])
        return out

    return common.map_rows(strings, f"grp string, start int, {fields}", run)


ESTIMATE = "mu array<double>, inv array<double>, det double"


def _estimated(sums: list, _: dict) -> dict:
    mu, inv = estimate(sums[0], sums[1 : FEATURES + 1], sums[FEATURES + 1 :])
    k = [i * (i + 3) // 2 for i in range(FEATURES)]  # the factor's diagonal
    return {"mu": mu, "inv": inv, "det": -2 * sum(float(np.log(inv[i])) for i in k)}


def _gathered(params: DataFrame, groups: int) -> DataFrame:
    """One row for each group: mu, inv and det as arrays by start."""
    wide = params.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("start", "mu", "inv", "det"))).alias("p"))  # STARTS entries
    return common.stored(wide.select("grp", F.col("p.mu").alias("mu"), F.col("p.inv").alias("inv"), F.col("p.det").alias("det")), "mcd-params", groups)


def _here(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """The same of rows (grp, start, mu, inv, det) that the driver has."""
    by: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["grp"], r["start"])):
        by.setdefault(r["grp"], []).append(r)
    doubles = pa.list_(pa.float64())
    columns = [pa.array(list(by), pa.string())]
    columns += [pa.array([[r[c] for r in of] for of in by.values()], k) for c, k in (("mu", pa.list_(doubles)), ("inv", pa.list_(doubles)), ("det", doubles))]
    return spark.createDataFrame(pa.table(columns, names=["grp", "mu", "inv", "det"]))


def _solve(sums: DataFrame, solve, groups: int) -> tuple[DataFrame, object]:
    """Estimates, gathered, from sums (lang, grp, start, SUMS and more; none of it
    shuffled but by group), and what tells whether the sums are those of the step
    before. Up to BROADCAST_GROUPS groups the driver solves them, as it sends them
    to all tasks anyway; beyond that they stay in tables."""
    if groups > BROADCAST_GROUPS:
        sums = common.stored(sums, "mcd-sums", STARTS * groups)
        state = sums.agg(F.count(F.lit(1)), F.sum(F.xxhash64("grp", "start", *SUMS).cast("decimal(38,0)"))).first()
        return _gathered(_solved(sums, ESTIMATE, solve), groups), state
    rows = [r.asDict() for r in sums.collect()]
    own = {(r["grp"], r["start"]): [int(r[n]) for n in SUMS] for r in rows}
    lang: dict = {}
    every: dict = {}
    for r in rows:
        for table, key in ((lang, (r["lang"], r["start"])), (every, r["start"])):
            table[key] = [x + y for x, y in zip(table.get(key, [0] * len(SUMS)), own[r["grp"], r["start"]], strict=True)]
    made = [{"grp": r["grp"], "start": r["start"]} | solve(blended(own[r["grp"], r["start"]], blended(lang[r["lang"], r["start"]], every[r["start"]])), r) for r in rows]
    return _here(sums.sparkSession, made), own


def _binned(rows: DataFrame, params: DataFrame, groups: int) -> DataFrame:
    """lang, grp, start, bin and SUMS of the rows in each bin of distance."""
    x = [F.col(f"x{i}") for i in range(FEATURES)]
    met = _met(rows, params.select("grp", "mu", "inv"), groups)
    each = F.transform(F.arrays_zip("mu", "inv"), lambda p: _bin(squared(x, p["mu"], p["inv"])))
    return met.select("lang", "grp", *x, F.posexplode(each).alias("start", "bin")).groupBy("lang", "grp", "start", "bin").agg(*_sums(x))


def _medians(rows: DataFrame) -> DataFrame:
    """grp with medians m and quartile ranges r (in steps of SCALE) of each feature,
    from counts of bins of 20, which tasks make before they are dealt."""
    long = rows.select("grp", F.posexplode(F.array(*[F.col(f"x{i}") for i in range(FEATURES)])).alias("j", "x"))
    found = long.groupBy("grp", "j").agg(F.percentile(F.floor(F.col("x") / 20), [0.25, 0.5, 0.75]).alias("b"))
    found = found.select("grp", "j", F.col("b")[0].alias("lo"), F.col("b")[1].alias("mid"), F.col("b")[2].alias("hi"))
    floors = F.element_at(F.array(*[F.lit((f * SCALE) ** 2) for f in FLOORS]), F.col("j") + 1)
    spread = (F.col("hi") - F.col("lo")) * 20 / 1.349
    wide = found.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("j", (F.col("mid") * 20 + 10.0).alias("m"), F.sqrt(spread * spread + floors).alias("r")))).alias("a"))  # five entries
    return common.stored(wide.select("grp", F.col("a.m").alias("m"), F.col("a.r").alias("r")), "mcd-medians")


def _starts(rows: DataFrame) -> tuple[DataFrame, int]:
    """Estimates to begin with, gathered, and the number of groups: diagonal ones; and
    those whose correlations are of squashed values, and of directions from the
    medians."""
    medians = _medians(rows)
    groups = medians.count()
    z = [(F.col(f"x{i}") - F.col("m")[i]) / F.col("r")[i] for i in range(FEATURES)]
    size = F.greatest(F.sqrt(sum((v * v for v in z), F.lit(0.0))), F.lit(1e-9))
    unit = 1 << 12  # as integers, whose sums don't depend on their order
    values = [[F.round(f(v) * unit).cast("long") for v in z] for f in (F.tanh, lambda v: v / size)]
    values.append([F.lit(0).cast("long")] * FEATURES)  # without correlations
    made = [F.struct(F.lit(k).alias("start"), *[c.alias(f"y{i}") for i, c in enumerate(v)]) for k, v in enumerate(values)]
    y = [F.col(f"y{i}") for i in range(FEATURES)]
    sums = _met(rows, medians, groups).select("lang", "grp", F.explode(F.array(*made)).alias("e")).select("lang", "grp", "e.*").groupBy("lang", "grp", "start").agg(*_sums(y))

    def solve(v: list, r: dict) -> dict:
        n, s, q = v[0], v[1 : FEATURES + 1], v[FEATURES + 1 :]
        cov, k = np.zeros((FEATURES, FEATURES)), 0
        for i in range(FEATURES):
            for j in range(i + 1):
                cov[i, j] = cov[j, i] = (q[k] / n - s[i] * s[j] / (n * n)) / unit**2
                k += 1
        root = np.sqrt(np.maximum(np.diag(cov), 1e-6))
        cor = cov / np.outer(root, root)
        np.fill_diagonal(cor, 1)
        cor = 0.95 * cor + 0.05 * np.eye(FEATURES)
        inv = np.linalg.inv(np.linalg.cholesky(cor * np.outer(r["r"], r["r"])))
        return {"mu": r["m"], "inv": [float(inv[i, j]) for i in range(FEATURES) for j in range(i + 1)], "det": 0.0}

    return _solve(sums.join(medians, "grp"), solve, groups)[0], groups


def fit(rows: DataFrame) -> tuple[DataFrame, int]:
    """Estimates of each group of rows (lang, grp, h, x0..), and their number: grp, mu,
    inv, unit, where unit is what a squared distance is divided by."""
    params, groups = _starts(rows)
    before = None
    for _ in range(STEPS):
        within = _within(_binned(rows, params, groups), F.col("before") < F.ceil(F.col("all") * SUBSET))
        params, state = _solve(_added(within, "lang", "grp", "start"), _estimated, groups)
        if state == before:
            break
        before = state
    one = F.array_min(F.transform(F.arrays_zip("det", "mu", "inv"), lambda p, i: F.struct(p["det"].alias("det"), i.alias("start"), p["mu"].alias("mu"), p["inv"].alias("inv"))))
    best = params.select("grp", one.alias("b")).select("grp", F.array("b.mu").alias("mu"), F.array("b.inv").alias("inv"))
    table = common.stored(_binned(rows, best, groups), "mcd-bins", 100 * groups)
    units = _units(table).select("grp", F.expr(f"unit * {REWEIGHT}").alias("most"))
    near = F.pow(F.lit(2.0), (F.col("bin") + 1) / float(BINS_PER_DOUBLING)) - 2.0**LEAST_LOG <= F.col("most")
    # the nearest bin stays in any case, so that there is an estimate
    inside = _within(table.join(units, "grp"), near | (F.col("before") == 0))
    params, _ = _solve(_added(inside, "lang", "grp", "start"), _estimated, groups)
    units = _units(common.stored(_binned(rows, params, groups), "mcd-bins", 100 * groups))
    return common.stored(params.join(units, "grp").select("grp", F.col("mu")[0].alias("mu"), F.col("inv")[0].alias("inv"), "unit"), "mcd", groups), groups


def _units(table: DataFrame) -> DataFrame:
    """grp, unit: the median squared distance in a group's bins over that of
    chi-square, blended with those of its language and of all rows; 1 at least."""
    counted = lambda t, *keys: t.groupBy(*keys, "bin").agg(F.sum("n").alias("n"))

    def medians(t: DataFrame, key: str, name: str) -> DataFrame:
        w = Window.partitionBy(key)
        cum = t.withColumn("c", F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(w))
        median = F.min(F.when(F.col("c") >= F.ceil(F.col("all") / 2), F.col("bin")))
        size = (F.pow(F.lit(2.0), (median + 1) / float(BINS_PER_DOUBLING)) - 2.0**LEAST_LOG) / CHI2_MEDIAN
        return cum.groupBy(key).agg(size.alias(name), F.first("all").alias(f"{name}_n"))

    own = medians(counted(table, "grp"), "grp", "own").join(table.select("grp", "lang").distinct(), "grp")
    by_lang = counted(table, "lang")
    lang = medians(by_lang, "lang", "wide")
    every = medians(counted(by_lang.withColumn("one", F.lit(1)), "one"), "one", "all").select("all")
    rest = lang.crossJoin(F.broadcast(every)).select("lang", ((F.col("wide_n") * F.col("wide") + PRIOR_ROWS * F.col("all")) / (F.col("wide_n") + PRIOR_ROWS)).alias("wide"))  # one row
    unit = (F.col("own_n") * F.col("own") + PRIOR_ROWS * F.col("wide")) / (F.col("own_n") + PRIOR_ROWS)
    return own.join(rest, "lang").select("grp", F.greatest(F.lit(1.0), unit).alias("unit"))


def _grouped(counted: DataFrame) -> DataFrame:
    """counted with base_failed, grp, h and x0.. (null where the base rules fail)."""
    rows = counted.withColumn("base_failed", base_failed()).withColumn("grp", F.to_json(F.array("lang", "source"))).withColumn("h", F.xxhash64("__id", "__hash"))
    return rows.select("*", *[F.when(~F.col("base_failed"), x).alias(f"x{i}") for i, x in enumerate(_features())])


def model(counted: DataFrame) -> tuple[DataFrame, int]:
    """The estimates and their number (see fit) of counted rows (a stored table, see counts())."""
    rows = _grouped(counted).filter(~F.col("base_failed")).select("lang", "grp", "h", *[f"x{i}" for i in range(FEATURES)])
    return fit(common.stored(rows, "mcd-vectors"))


def judge(counted: DataFrame) -> DataFrame:
    """counted (see counts(); a stored table) with base_failed, distance (null where
    the base rules fail) and kept."""
    rows, x = _grouped(counted), [F.col(f"x{i}") for i in range(FEATURES)]
    failed = rows.filter("base_failed").withColumn("distance", F.lit(None).cast("double"))
    met = _met(rows.filter(~F.col("base_failed")), *model(counted)).withColumn("distance", squared(x, F.col("mu"), F.col("inv")) / F.col("unit")).drop("mu", "inv", "unit")
    return failed.unionByName(met).withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= CUTOFF)).drop("grp", "h", *[f"x{i}" for i in range(FEATURES)])


def assess(docs: DataFrame) -> DataFrame:
    """doc_id, counts, base_failed, kept and distance of every row of docs (doc_id,
    text; lang and source if there).

    A null text has no words and fails the base rules, as do empty ones. Null
    lang or source is a group of its own name, the empty string. Repeated rows
    give repeated rows, all of which count in the estimates; a text of any length
    is one row of counts; other columns are ignored; an empty table gives an empty
    result.
    """
    judged = judge(common.stored(counts(docs), "quality"))
    return judged.select(F.col("__id").alias("doc_id"), *COUNTS, "base_failed", "kept", "distance")


def filtered(docs: DataFrame) -> DataFrame:
    """Rows of docs that are kept, with docs' own columns. Null and empty texts fail
    the base rules and go; repeated rows get one decision; an empty table gives an
    empty one."""
    bad = judge(common.stored(counts(docs), "quality")).filter(~F.col("kept")).select("__id", "__hash").distinct()
    return common.drop_rows(docs, common.stored(bad, "quality-bad"), "doc_id", *[c for c in ("text", "lang", "source") if c in docs.columns])
