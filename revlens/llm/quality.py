"""Quality rules: robust multivariate outliers by minimum covariance determinants."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, written

#: A document further from its group's centre is rejected (Mahalanobis distance, scaled so that its square has the median of chi square).
DISTANCE = 8.5
#: Share of a group that an estimate rests on; concentration steps from all starts, and from the best one.
SUPPORT, STEPS, MORE = 0.75, 3, 5
#: Documents for which a pool's estimate counts in the estimate of each group in it.
SHRINK = 30.0
#: Characters and words of the average text that each document is mixed with, so that short texts don't stand out by chance.
CHARS, WORDS = 600.0, 40.0
#: Share of the overall variance that is added to each estimate: a group of copies has no variance of its own.
RIDGE = 0.05
#: Bins of a doubling of the squared distance, in which a step's sums are taken, and in which a median is.
STEP_BINS, BINS = 32, 256
#: Groups whose estimates are broadcast; beyond that, documents and estimates are shuffled by group and one of so many salts.
BROADCAST_GROUPS, SALTS = 10_000, 64
CHI_MEDIAN = 3.3567  # of chi square with 4 degrees of freedom
WHITE = r"[ \t\n\r\f\x0B]+"
SEPARATOR = "\x1f"
X = ["x0", "x1", "x2", "x3"]
PAIRS = [(i, j) for i in range(4) for j in range(i, 4)]
STARTS = ("medians", "hyperbolic tangents", "spatial signs", "inner half", "all")
ESTIMATE = "key string, start int, n double, det double, mu array<double>, cov array<double>, inverse array<double>"
COUNTS = ["n", "w", "dw", "up", "sym"]


def counts(text: Column) -> list[Column]:
    """Characters, words, distinct words, upper-case letters and symbols of a text, as n, w, dw, up, sym; null counts 0."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, WHITE), "")
    return [F.length(text).alias("n"), F.size(words).alias("w"), F.size(F.array_distinct(words)).alias("dw"), F.regexp_count(text, F.lit(r"\p{Lu}")).alias("up"), F.regexp_count(text, F.lit(r"[^\p{L}\p{M}\p{N}\s]")).alias("sym")]


def vector(up_rate: Column, sym_rate: Column, of: str = "") -> list[Column]:
    """The transformed statistics of counts() (fields of the struct `of`, or columns): arc sines of the rates of capitals and symbols, logarithm of the word length, and of the distinct words to that of the words."""
    c = {k: F.col(of + k) for k in COUNTS}

    def rate(k: str, mean: Column) -> Column:
        return F.asin(F.sqrt((c[k] + CHARS * mean) / (c["n"] + CHARS)))

    return [rate("up", up_rate).alias("x0"), rate("sym", sym_rate).alias("x1"), F.log((c["n"] - c["w"] + 6 * WORDS) / (c["w"] + WORDS)).alias("x2"), (F.log(c["dw"] + WORDS) / F.log(c["w"] + WORDS)).alias("x3")]


def keys() -> list[Column]:
    """A document's group, its language's pool and the pool of all."""
    lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("lang", "source"))
    return [F.concat(lang, F.lit(SEPARATOR), source), F.concat(lang, F.lit(SEPARATOR + "*")), F.lit("*")]


def squared(mu: Column, inverse: Column) -> Column:
    """The squared Mahalanobis distance of x0..x3."""
    z = [F.col(x) - mu[i] for i, x in enumerate(X)]
    total = F.lit(0.0)
    for i, j in PAIRS:
        total = total + (1 if i == j else 2) * inverse[4 * i + j] * z[i] * z[j]
    return total


def statistics(docs: DataFrame, keep: list[str] | None = None) -> tuple[DataFrame, tuple[float, float]]:
    """A written table (row: struct of the columns to keep; lang, source, n, w, dw, up, sym) and the corpus's rates of capitals and symbols.

    Each text is read and counted once; where rows are to be kept whole, they are in this table, too.
    """
    row = F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("lang", "source")]) if keep is None else F.struct(*keep)
    table = written(docs.select(row.alias("row"), *[F.col(c).cast("string").alias(c) for c in ("lang", "source")], *counts(F.col("text"))), "quality")
    n, up, sym = table.agg(F.sum("n"), F.sum("up"), F.sum("sym")).first()
    return table, ((up or 0) / (n or 1), (sym or 0) / (n or 1))


def attached(rows: DataFrame, estimates: DataFrame, key: str = "key") -> DataFrame:
    """rows with the columns of the estimates (one row for each key).

    Up to BROADCAST_GROUPS estimates are broadcast. More are shuffled with the rows, by key and salt, each estimate with
    all salts, so that no key, however hot, is one task's work.
    """
    if estimates.count() <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(estimates), key)
    salted = estimates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(*X), F.lit(SALTS)).cast("int")).join(salted, [key, "salt"]).drop("salt")


def _solved(keys_: list, starts: list, n: list, mu: list[np.ndarray], cov: list[np.ndarray]) -> pa.RecordBatch:
    """Rows of ESTIMATE."""
    floats = pa.list_(pa.float64())
    inverse = [np.linalg.inv(c) for c in cov]
    return pa.RecordBatch.from_arrays([pa.array(keys_, pa.string()), pa.array(starts, pa.int32()), pa.array(n, pa.float64()), pa.array([float(np.linalg.det(c)) for c in cov], pa.float64()), pa.array([m.tolist() for m in mu], floats), *(pa.array([c.reshape(-1).tolist() for c in x], floats) for x in (cov, inverse))], names=["key", "start", "n", "det", "mu", "cov", "inverse"])


def _moments(prefix: str, z: list[Column], weight: Column | None = None) -> list[Column]:
    """Sums of a weight, of z and of its products."""
    w = F.lit(1.0) if weight is None else weight
    return [F.sum(w).alias(prefix + "w"), *[F.sum(w * z[i]).alias(f"{prefix}{i}") for i in range(4)], *[F.sum(w * z[i] * z[j]).alias(f"{prefix}{i}{j}") for i, j in PAIRS]]


def _covariance(get, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance from sums."""
    m = np.array([get(f"{i}") for i in range(4)]) / weight
    s = np.zeros((4, 4))
    for i, j in PAIRS:
        s[i, j] = s[j, i] = get(f"{i}{j}") / weight - m[i] * m[j]
    return m, s


def starts(rows: DataFrame, floor: list[float]) -> DataFrame:
    """ESTIMATE rows of deterministic starts for each key of rows (key, x0..x3): see STARTS.

    With z the vectors, standardised by medians and median deviations: their unit covariance; the covariances of tanh(z),
    of z / |z|, and of the z with |z| below the median of its expectation; that of all vectors.
    """
    middle = rows.groupBy("key").agg(*[F.percentile_approx(x, 0.5, 1000).alias("m" + x) for x in X])
    middle = written(middle.select("key", F.array(*["m" + x for x in X]).alias("mid")), "quality")
    spread = attached(rows, middle).groupBy("key").agg(F.first("mid").alias("mid"), *[F.percentile_approx(F.abs(F.col(x) - F.col("mid")[i]), 0.5, 1000).alias("d" + x) for i, x in enumerate(X)])
    spread = written(spread.select("key", "mid", F.array(*[F.sqrt((F.col("d" + x) * 1.4826) ** 2 + floor[i]) for i, x in enumerate(X)]).alias("dev")), "quality")
    z = [(F.col(x) - F.col("mid")[i]) / F.col("dev")[i] for i, x in enumerate(X)]
    size = sum((c * c for c in z[1:]), z[0] * z[0])
    sums = attached(rows, spread).groupBy("key").agg(
        F.first("mid").alias("mid"), F.first("dev").alias("dev"),
        *_moments("t", [F.tanh(c) for c in z]), *_moments("s", z, F.lit(1.0) / (size + 1e-9)), *_moments("h", z, F.when(size <= CHI_MEDIAN, 1.0).otherwise(0.0)), *_moments("a", z),
    )

    def solve(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for r in batch.to_pylist():
                mid, dev = np.array(r["mid"]), np.array(r["dev"])
                shapes = [(np.zeros(4), np.eye(4))]
                for p in "tsha":
                    m, s = _covariance(lambda k: r[p + k], max(r[p + "w"], 1e-9))  # noqa: B023
                    shapes.append((m if p in "ha" else np.zeros(4), s * (4 if p == "s" else 1)))
                for k, (m, s) in enumerate(shapes):
                    for column, value in zip(out, (r["key"], k, r["aw"], mid + m * dev, s * np.outer(dev, dev) + np.diag(floor))):
                        column.append(value)
            yield _solved(*out)

    return written(sums.mapInArrow(solve, ESTIMATE), "quality")


def concentrated(rows: DataFrame, now: DataFrame, floor: list[float], support: float) -> DataFrame:
    """One concentration step: for each estimate (key, start), mean and covariance of the share `support` of the key's rows nearest to it.

    Sums are taken in bins of the distance, and those of the nearest bins added up; the bin in which the share ends counts
    with the fraction that is missing. So a step is one aggregation, whatever the size of a group.
    """
    each = now.groupBy("key").agg(F.collect_list(F.struct("start", "mu", "inverse")).alias("e"))  # as many as there are starts
    distances = F.transform("e", lambda e: F.struct(e["start"].alias("start"), F.floor(F.log2(squared(e["mu"], e["inverse"]) + 1e-30) * STEP_BINS).cast("int").alias("bin")))
    sums = attached(rows, each).select("key", *X, F.inline(distances)).groupBy("key", "start", "bin").agg(*_moments("s", [F.col(x) for x in X]))

    def step(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("bin").to_numpy())
        n = group.column("sw").to_numpy()[order]
        most = max(support * n.sum(), min(n.sum(), 1.0))
        part = np.clip((most - (np.cumsum(n) - n)) / n, 0, 1)
        m, s = _covariance(lambda k: float((group.column("s" + k).to_numpy()[order] * part).sum()), most)
        return pa.Table.from_batches([_solved([group.column("key")[0].as_py()], [group.column("start")[0].as_py()], [n.sum()], [m], [s + np.diag(floor)])])

    return written(sums.groupBy("key", "start").applyInArrow(step, ESTIMATE), "quality")


def _scales(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """(key, scale): the median of the squared distances over that of chi square, by bins."""
    binned = attached(rows, estimates.select("key", "mu", "inverse")).select("key", F.floor(F.log2(squared(F.col("mu"), F.col("inverse")) + 1e-30) * BINS).cast("int").alias("bin"))

    def median(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("bin").to_numpy())
        n, bins = group.column("n").to_numpy()[order], group.column("bin").to_numpy()[order]
        at = int(np.searchsorted(np.cumsum(n), n.sum() / 2))
        inside = (n.sum() / 2 - (n.cumsum()[at] - n[at])) / n[at]
        return pa.table({"key": [group.column("key")[0].as_py()], "scale": [max(2.0 ** ((bins[at] + inside) / BINS), 1e-9) / CHI_MEDIAN]})

    return binned.groupBy("key", "bin").agg(F.count("*").alias("n")).groupBy("key").applyInArrow(median, "key string, scale double")


def best(rows: DataFrame, floor: list[float], support: float = SUPPORT) -> DataFrame:
    """The ESTIMATE row of each key of rows (key, x0..x3) with the least determinant, of what all starts concentrate to."""
    now = starts(rows, floor)
    for _ in range(STEPS):
        before, now = now, concentrated(rows, now, floor, support)
        discard(before)
    least = F.min_by(F.struct("start", "n", "det", "mu", "cov", "inverse"), F.struct("det", "start")).alias("e")
    now = written(now.groupBy("key").agg(least).select("key", "e.*"), "quality")
    for _ in range(MORE):
        before, now = now, concentrated(rows, now, floor, support)
        discard(before)
    return now


def fit(table: DataFrame, rates: tuple[float, float], support: float = SUPPORT) -> DataFrame:
    """(level, mu, inverse, scale) for each (lang, source) of statistics(): the minimum-covariance-determinant estimate.

    Each group, each language and all documents together have an estimate of their own; see best(). A group's is then
    mixed with its language's, which counts like SHRINK documents, and a language's likewise with that of all: a large
    group's estimate is its own, a group of few documents, which tell little, mostly its pool's, without a switch between.
    """
    names = keys()
    x = table.where("w > 0").select(*[k.alias(f"k{i}") for i, k in enumerate(names)], *vector(*map(F.lit, rates)))
    rows = written(x.select(F.explode(F.array("k0", "k1", "k2")).alias("key"), *X), "quality")
    groups = written(x.select("k0", "k1", "k2").distinct(), "quality")
    overall = rows.where("key = '*'").agg(*[F.var_pop(c) for c in X]).first()
    floor = [RIDGE * (v or 0.0) + 1e-9 for v in overall]
    found = best(rows, floor, support)

    def mixed(a: Column, b: Column, n: Column) -> Column:
        return F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p: (n * p["a"] + SHRINK * p["b"]) / (n + SHRINK))

    def shrunk(own: DataFrame, pool: DataFrame) -> DataFrame:
        """own (key, pool, n, mu, cov) mixed with the pools' (key, mu, cov)."""
        pool = pool.select(F.col("key").alias("pool"), F.col("mu").alias("pool_mu"), F.col("cov").alias("pool_cov"))
        return own.join(pool, "pool").select("key", "pool", "n", mixed(F.col("mu"), F.col("pool_mu"), F.col("n")).alias("mu"), mixed(F.col("cov"), F.col("pool_cov"), F.col("n")).alias("cov"))

    def inverted(estimates: DataFrame) -> DataFrame:
        def invert(batches):
            for batch in batches:
                inverse = [np.linalg.inv(np.array(c).reshape(4, 4)).reshape(-1).tolist() for c in batch.column("cov").to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(inverse, pa.list_(pa.float64()))], names=["key", "pool", "n", "mu", "cov", "inverse"])

        return estimates.mapInArrow(invert, "key string, pool string, n double, mu array<double>, cov array<double>, inverse array<double>")

    base = found.select("key", "n", "mu", "cov")
    whole = base.where("key = '*'").select("key", F.lit("*").alias("pool"), "n", "mu", "cov")
    langs = shrunk(base.join(groups.select(F.col("k1").alias("key"), F.col("k2").alias("pool")).distinct(), "key"), whole)
    own = shrunk(base.join(groups.select(F.col("k0").alias("key"), F.col("k1").alias("pool")), "key"), langs)
    all_ = written(inverted(whole.unionByName(langs).unionByName(own)), "quality")
    scales = _scales(rows, all_)
    scaled = all_.join(scales, "key")
    for _ in range(2):  # languages by all, then groups by languages
        pool = scaled.select(F.col("key").alias("pool"), F.col("scale").alias("pool_scale"))
        scaled = scaled.join(pool, "pool").withColumn("scale", F.when(F.col("key") == F.col("pool"), F.col("scale")).otherwise((F.col("n") * F.col("scale") + SHRINK * F.col("pool_scale")) / (F.col("n") + SHRINK))).drop("pool_scale")
    out = written(scaled.join(groups.select(F.col("k0").alias("key")), "key", "left_semi").select(F.col("key").alias("level"), "mu", "inverse", "scale"), "quality")
    discard(rows, found, all_)
    return out


def _judged(table: DataFrame, rates: tuple[float, float], distance: float, **parameters) -> DataFrame:
    """(row, distance) of the rows of statistics() that are kept."""
    placed = table.where("w > 0").select("row", keys()[0].alias("level"), *vector(*map(F.lit, rates)))
    judged = attached(placed, fit(table, rates, **parameters), "level")
    return judged.select("row", F.sqrt(squared(F.col("mu"), F.col("inverse")) / F.col("scale")).alias("distance")).where(F.col("distance") <= distance)


def within_limits(docs: DataFrame, distance: float = DISTANCE, **parameters) -> DataFrame:
    """(doc_id, lang, source, distance): the documents whose statistics are no outliers in their language and source.

    See vector() for the statistics, fit() for the estimates. Null in lang or source counts as "". Documents without a
    word (null, empty, blank) are rejected; long ones are counted whole. Each row is judged by itself, repeated rows and
    rows without doc_id too; a distance that equals the limit is kept. An empty table gives an empty result. Other columns
    are not read, whatever their names.
    """
    table, rates = statistics(docs)
    return _judged(table, rates, distance, **parameters).select("row.*", "distance")


def keep_within_limits(docs: DataFrame, distance: float = DISTANCE, **parameters) -> DataFrame:
    """The documents that within_limits() keeps, all columns kept; texts are read once and not shuffled.

    Nulls, ties, repeated rows and empty tables: as there.
    """
    table, rates = statistics(docs, docs.columns)
    return _judged(table, rates, distance, **parameters).select("row.*")
