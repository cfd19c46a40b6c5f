"""Statistics: regression, correlation, intervals, tests, clustering."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import special
from .tables import exact_quantiles, null_safe_join


def ols(df: DataFrame, y: Column, x: Column, by: Sequence[str] = ()) -> DataFrame:
    """Slope, intercept and R² of simple least squares."""
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def predict(model: DataFrame, lo: int, hi: int, transform) -> DataFrame:
    """(x, y) of a one-row model over lo..hi, with a transformed regressor."""
    spark = model.sparkSession
    xs = spark.range(lo, hi + 1).select(F.col("id").cast("double").alias("x"))
    return xs.join(F.broadcast(model)).select("x", (F.col("intercept") + F.col("slope") * transform(F.col("x"))).alias("y"))  # one row


def inverse_calibration(standards: DataFrame, samples: DataFrame, y: str, x: str, signal: str, volume: float, load: float) -> DataFrame:
    """Concentrations from a calibration line, and how to dilute all samples to the lowest one.

    sample = least concentration * (volume - load) / concentration, buffer = the rest.
    """
    m = ols(standards, F.col(y), F.col(x))
    s = samples.join(F.broadcast(m)).withColumn("concentration", (F.col(signal) - F.col("intercept")) / F.col("slope"))
    low = s.agg(F.min("concentration").alias("low"))
    s = s.join(F.broadcast(low))
    s = s.withColumn("sample_volume", F.col("low") * (volume - load) / F.col("concentration"))
    return s.withColumn("buffer_volume", F.lit(volume) - F.col("sample_volume") - load).drop("slope", "intercept", "r2", "low")


def corr_pairs(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(a, b, r) of all pairs of columns, over the rows that have both, in one aggregation."""
    pairs = list(itertools.combinations(cols, 2))
    wide = df.groupBy(*by).agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{i}`").alias("r")) for i, (a, b) in enumerate(pairs)])
    return wide.select(*by, F.inline(rows))


def high_corr(df: DataFrame, cols: Sequence[str], limit: float = 0.75) -> DataFrame:
    return corr_pairs(df, cols).filter(F.abs("r") > limit)


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """p x p matrix on the driver; the rows are aggregated where they are."""
    out = np.eye(len(cols))
    at = {c: i for i, c in enumerate(cols)}
    for r in corr_pairs(df, cols).collect():  # p(p-1)/2 rows
        out[at[r.a], at[r.b]] = out[at[r.b], at[r.a]] = r.r
    return out


def vif(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(name, vif): diagonal of the inverse of the correlation matrix."""
    inverse = np.linalg.pinv(corr_matrix(df, cols))
    return df.sparkSession.createDataFrame([(c, float(inverse[i, i])) for i, c in enumerate(cols)], "name string, vif double")


def drop_highest_vif(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """The columns without the one of highest variance inflation."""
    top = vif(df, cols).orderBy(F.desc("vif"), "name").first()
    return [c for c in cols if c != top.name]


def multiple_ols(df: DataFrame, y: str, cols: Sequence[str]) -> DataFrame:
    """(term, coefficient), with R² and adjusted R² as further terms; a pass for the means and one for the sums of
    products of the differences from them, solved on the driver. Rows with a null are left out."""
    d = df.dropna(subset=[y, *cols]).select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate([*cols, y])])
    p = len(cols)
    mean = d.agg(F.count("*").alias("n"), *[F.avg(f"v{i}").alias(f"m{i}") for i in range(p + 1)]).first()
    n = mean["n"]
    if n <= p + 1:
        raise ValueError("more rows than terms are needed")
    # products of differences from the means: products of large values would lose their digits
    c = [F.col(f"v{i}") - mean[f"m{i}"] for i in range(p + 1)]
    r = d.agg(*[F.sum(c[i] * c[j]).alias(f"s{i}_{j}") for i in range(p + 1) for j in range(i, p + 1)]).first()
    a = np.array([[r[f"s{min(i, j)}_{max(i, j)}"] for j in range(p + 1)] for i in range(p + 1)])
    scale = np.sqrt(np.maximum(np.diag(a)[:p], 1e-300))
    beta = np.linalg.lstsq(a[:p, :p] / np.outer(scale, scale), a[:p, p] / scale, rcond=None)[0] / scale
    r2 = float(beta @ a[:p, p] / a[p, p]) if a[p, p] > 0 else float("nan")
    adjusted = 1 - (1 - r2) * (n - 1) / (n - p - 1)
    first = mean[f"m{p}"] - sum(x * mean[f"m{i}"] for i, x in enumerate(beta))
    rows = [("(intercept)", float(first)), *zip(cols, map(float, beta), strict=True), ("r2", r2), ("adjusted_r2", float(adjusted))]
    return df.sparkSession.createDataFrame(rows, "term string, coefficient double")


def lasso_cv(df: DataFrame, y: str, cols: Sequence[str], key: str, lambdas: Sequence[float], folds: int = 5) -> DataFrame:
    """(lambda, mean_mse, se_mse, chosen): cross-validated lasso; the largest lambda within one standard error of the
    best is chosen. Folds go by a hash of the key, so they do not depend on the order of rows.

    Coordinate descent needs sums of products alone: one aggregation by fold, the rest is p x p on the driver.
    """
    d = df.dropna(subset=[y, *cols]).withColumn("fold", F.pmod(F.xxhash64(key), F.lit(folds)))
    # centred, since sums of products of large numbers lose digits; the intercept of a fold makes up for it
    means = d.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate([*cols, y])]).first()
    v = [F.lit(1.0), *[F.col(c).cast("double") - F.lit(means[i] or 0.0) for i, c in enumerate([*cols, y])]]
    p = len(v)
    rows = d.groupBy("fold").agg(*[F.sum(v[i] * v[j]).alias(f"s{i}_{j}") for i in range(p) for j in range(i, p)]).collect()  # a row for each fold
    gram = {r.fold: np.array([[r[f"s{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)], float) for r in rows}

    def fit(g: np.ndarray, lam: float) -> np.ndarray:
        n, mean = g[0, 0], g[0] / g[0, 0]
        cov = g / n - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(cov)[1:-1], 1e-300))
        a, c = cov[1:-1, 1:-1] / np.outer(sd, sd), cov[1:-1, -1] / sd
        b = np.zeros(len(sd))
        for _ in range(1000):
            old = b.copy()
            for j in range(len(b)):
                rho = c[j] - a[j] @ b + a[j, j] * b[j]
                b[j] = np.sign(rho) * max(abs(rho) - lam, 0) / a[j, j] if a[j, j] > 0 else 0.0
            if np.abs(b - old).max() < 1e-10:
                break
        beta = b / sd
        return np.concatenate(([mean[-1] - beta @ mean[1:-1]], beta))

    total = sum(gram.values())
    out = []
    for lam in lambdas:
        errors = []
        for g in gram.values():
            w = np.append(-fit(total - g, lam), 1.0)
            errors.append(w @ g @ w / g[0, 0])
        out.append((float(lam), float(np.mean(errors)), float(np.std(errors, ddof=1) / math.sqrt(len(errors)))))
    best = min(out, key=lambda r: r[1])
    pick = max(r[0] for r in out if r[1] <= best[1] + best[2])
    return df.sparkSession.createDataFrame([(*r, r[0] == pick) for r in out], "lambda double, mean_mse double, se_mse double, chosen boolean")


def _components(matrix: np.ndarray, names: Sequence[str], k: int) -> list[tuple]:
    """Rows of the k largest components of a correlation matrix; the largest loading of each is positive."""
    values, vectors = np.linalg.eigh(matrix)
    rows = []
    for n, i in enumerate(np.argsort(values)[::-1][:k], 1):
        v = vectors[:, i] * np.sign(vectors[np.argmax(np.abs(vectors[:, i])), i])
        rows += [(n, c, float(x), float(values[i] / values.sum())) for c, x in zip(names, v, strict=True)]
    return rows


def pca(df: DataFrame, cols: Sequence[str], k: int) -> DataFrame:
    """(component, name, loading, share) of standardised columns; the largest loading of a component is positive."""
    return df.sparkSession.createDataFrame(_components(corr_matrix(df, cols), cols, k), "component int, name string, loading double, share double")


def vector_pca(df: DataFrame, vector: str, k: int) -> DataFrame:
    """The same for the entries of an array, e0, e1, ..., of which there may be many: their correlations are one
    aggregation of rows as vectors. Null arrays and those with nulls are left out; an entry that never varies has no
    correlation with others."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Correlation

    rows = df.select(F.col(vector).cast("array<double>").alias("v")).filter("v is not null and not exists(v, x -> x is null)")
    if rows.isEmpty():
        return df.sparkSession.createDataFrame([], "component int, name string, loading double, share double")
    matrix = Correlation.corr(rows.select(array_to_vector("v").alias("v")), "v").first()[0].toArray()
    matrix = np.where(np.isnan(matrix), 0.0, matrix)
    np.fill_diagonal(matrix, 1.0)
    return df.sparkSession.createDataFrame(_components(matrix, [f"e{i}" for i in range(len(matrix))], k), "component int, name string, loading double, share double")


def welch_t(df: DataFrame, group: str, value: str, a: str, b: str, alternative: str = "less") -> DataFrame:
    """One row (t, df, p_value) comparing the means of two groups; nulls where a group has fewer than two values or
    nothing varies."""
    g = {r[0]: r for r in df.filter(F.col(group).isin(a, b)).groupBy(group).agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"), F.count(value).alias("n")).collect()}  # two rows
    x, y = g.get(a), g.get(b)
    if not x or not y or x.n < 2 or y.n < 2 or not x.v + y.v > 0:
        return df.sparkSession.createDataFrame([(None, None, None)], "t double, df double, p_value double")
    u, w = x.v / x.n, y.v / y.n
    t = (x.m - y.m) / math.sqrt(u + w)
    free = (u + w) ** 2 / (u * u / (x.n - 1) + w * w / (y.n - 1))
    low = special.t_cdf(t, free)
    p = {"less": low, "greater": 1 - low, "two-sided": 2 * min(low, 1 - low)}[alternative]
    return df.sparkSession.createDataFrame([(float(t), float(free), float(p))], "t double, df double, p_value double")


def binomial_interval(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Agresti-Coull interval, inside [0, 1]."""
    nn = n + z * z
    p = (k + z * z / 2) / nn
    half = F.sqrt(p * (1 - p) / nn) * z
    return F.greatest(F.lit(0.0), p - half), F.least(F.lit(1.0), p + half)


def bonferroni(alpha: float, n: Column) -> Column:
    return F.lit(alpha) / n


def hypergeometric(df: DataFrame, k: str, marked: str, drawn: str, total: str, two_sided: bool = False) -> DataFrame:
    """Adds tail: the smaller hypergeometric tail, doubled for two sides."""

    @F.pandas_udf("double")
    def tail(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(special.hypergeometric_tails(a, b, c, d))

    return df.withColumn("tail", F.least(F.lit(1.0), tail(k, marked, drawn, total) * (2 if two_sided else 1)))


def benjamini_hochberg(df: DataFrame, p: str, by: Sequence[str] = (), name: str = "q_value") -> DataFrame:
    """Adds the false discovery rate of each row's p-value among all rows, or among those of its group.

    Ranks come from counts: equal values are counted first, values are ranked inside narrow ranges (some 20,000 in
    all, of equal width above 1/64 and of equal ratio below), and the ranges are put together by their counts, so no
    task sees all rows of a group. Nulls have no rate and count nowhere.
    """
    by = list(by)
    v, narrow = F.col("__p"), F.lit(1 / 64)
    values = df.filter(F.col(p).isNotNull()).groupBy(*by, F.col(p).alias("__p")).agg(F.count("*").alias("__n"))
    values = values.withColumn("__bin", F.when(v >= narrow, F.floor(v * 4096)).otherwise(-F.floor(-F.log2(F.greatest(v, F.lit(1e-308))) * 16)))
    inside = Window.partitionBy(*by, "__bin")
    values = values.withColumn("__upto", F.sum("__n").over(inside.orderBy("__p")))
    # a row for each range
    bins = values.groupBy(*by, "__bin").agg(F.sum("__n").alias("__in"))
    group = Window.partitionBy(*(by or [F.lit(0)]))
    bins = bins.withColumns({"__before": F.sum("__in").over(group.orderBy("__bin")) - F.col("__in"), "__all": F.sum("__in").over(group)}).drop("__in")

    values = null_safe_join(values, bins, [*by, "__bin"])
    values = values.withColumn("__raw", F.col("__p") * F.col("__all") / (F.col("__before") + F.col("__upto")))
    values = values.withColumn("__least", F.min("__raw").over(inside.orderBy(F.desc("__p")))).drop("__before", "__all")
    later = values.groupBy(*by, "__bin").agg(F.min("__raw").alias("__own"))
    later = later.withColumn("__later", F.min("__own").over(group.orderBy(F.desc("__bin")).rowsBetween(Window.unboundedPreceding, -1))).drop("__own")
    values = null_safe_join(values, later, [*by, "__bin"])
    values = values.select(*by, "__p", F.least(F.lit(1.0), "__least", F.coalesce("__later", F.lit(1.0))).alias(name))
    return null_safe_join(df, values.withColumnRenamed("__p", p), [*by, p], "left")


def overlap_enrichment(sets: DataFrame, chosen: DataFrame, total: int | None = None, key: str = "symbol", name: str = "set_name") -> DataFrame:
    """Overlap of named sets with a chosen set: (name, set_size, overlap, tail, fdr), Benjamini-Hochberg.

    ``total`` is the size of the universe; without it, the universe is all that is in a set or chosen, counted. A
    total smaller than that is refused.
    """
    chosen = chosen.select(key).distinct()
    universe = sets.select(key).union(chosen.select(key)).filter(F.col(key).isNotNull()).agg(F.count_distinct(key)).first()[0]
    total = universe if total is None else total
    if total < universe:
        raise ValueError(f"a universe of {total} cannot hold {universe} different members")
    marked = sets.select(name, key).distinct().join(chosen.withColumn("hit", F.lit(1)), key, "left")
    g = marked.groupBy(name).agg(F.count(key).alias("set_size"), F.count("hit").alias("overlap")).withColumns({"drawn": F.lit(chosen.filter(F.col(key).isNotNull()).count()), "total": F.lit(total)})
    g = hypergeometric(g, "overlap", "set_size", "drawn", "total")
    return benjamini_hochberg(g, "tail", name="fdr").select(name, "set_size", "overlap", "tail", "fdr")


def distances(df: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """(a, b, d): Euclidean distances of groups as vectors over the keys; missing keys are 0."""
    v = df.groupBy(group, key).agg(F.sum(value).alias("v"))
    norm = v.groupBy(group).agg(F.sum(F.col("v") * F.col("v")).alias("q"))
    dots = v.select(F.col(group).alias("a"), key, F.col("v").alias("x")).join(v.select(F.col(group).alias("b"), key, F.col("v").alias("y")), key).filter("a < b").groupBy("a", "b").agg(F.sum(F.expr("x * y")).alias("dot"))
    pairs = norm.select(F.col(group).alias("a"), F.col("q").alias("qa")).join(norm.select(F.col(group).alias("b"), F.col("q").alias("qb")), F.expr("a < b"))
    return pairs.join(dots, ["a", "b"], "left").select("a", "b", F.sqrt(F.greatest(F.lit(0.0), F.expr("qa + qb - 2 * coalesce(dot, 0)"))).alias("d"))


def ward(pairs: DataFrame) -> DataFrame:
    """(step, a, b, height, size): Ward's agglomeration of the groups of distances(), a few dozens at most."""
    rows = pairs.collect()  # pairs of groups
    names = sorted({r.a for r in rows} | {r.b for r in rows})
    d = {frozenset((r.a, r.b)): float(r.d) for r in rows}
    size, out = dict.fromkeys(names, 1), []
    while len(size) > 1:
        pair = min(d, key=lambda p: (d[p], sorted(p)))
        a, b = sorted(pair)
        h, new, n = d.pop(pair), f"({a}+{b})", size[a] + size[b]
        for c in size:
            if c not in pair:
                x, y = d.pop(frozenset((a, c))), d.pop(frozenset((b, c)))
                m = size[c]
                d[frozenset((new, c))] = math.sqrt(max(0.0, ((size[a] + m) * x * x + (size[b] + m) * y * y - m * h * h) / (n + m)))
        del size[a], size[b]
        size[new] = n
        out.append((len(out) + 1, a, b, h, n))
    return pairs.sparkSession.createDataFrame(out, "step int, a string, b string, height double, size int")


def normality(df: DataFrame, value: str, points: int = 99) -> DataFrame:
    """(p, sample, normal): quantiles of a column beside those of the fitted normal distribution (a QQ plot)."""
    from statistics import NormalDist

    ps = [(i + 1) / (points + 1) for i in range(points)]
    r = df.agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s")).first()
    normal = NormalDist(r.m, r.s) if r.s else None
    quantiles = exact_quantiles(df, [], value, ps).orderBy("p").collect()  # so many points
    rows = [(q["p"], q["quantile"], normal.inv_cdf(q["p"]) if normal else None) for q in quantiles]
    return df.sparkSession.createDataFrame(rows, "p double, sample double, normal double")


#: Values that a Shapiro-Wilk test may have: its approximation is made for no more.
SHAPIRO_MOST = 5000


def shapiro_wilk(df: DataFrame, value: str) -> DataFrame:
    """One row (n, w, p_value): the Shapiro-Wilk test of a column, by Royston's approximation, for 12 to SHAPIRO_MOST values.

    Fewer values, or values that are all equal, give nulls; more are refused.
    """
    from statistics import NormalDist

    rows = df.select(F.col(value).cast("double").alias("v")).filter("v is not null").limit(SHAPIRO_MOST + 1).collect()
    if len(rows) > SHAPIRO_MOST:
        raise ValueError(f"at most {SHAPIRO_MOST} values")
    x, n, z = np.sort(np.array([r.v for r in rows])), len(rows), NormalDist()
    out = (n, None, None)
    if n >= 12 and x[0] < x[-1]:
        m = np.array([z.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
        u, norm = 1 / math.sqrt(n), math.sqrt(float(m @ m))
        # fixed values: the polynomials of the approximation
        last = m[-1] / norm + np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0], u)
        before = m[-2] / norm + np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0], u)
        phi = (m @ m - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * before**2)
        a = m / math.sqrt(phi)
        a[-1], a[-2], a[0], a[1] = last, before, -last, -before
        w = float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum())
        ln = math.log(n)
        mu = float(np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], ln))
        sigma = math.exp(float(np.polyval([0.0030302, -0.082676, -0.4803], ln)))
        out = (n, w, 1 - z.cdf((math.log(1 - w) - mu) / sigma) if w < 1 else 1.0)
    return df.sparkSession.createDataFrame([out], "n long, w double, p_value double")


def cell_tails(cells: DataFrame, alpha: float = 0.05, two_sided: bool = True) -> DataFrame:
    """Cells (col1, col2, base1, base2, observed) of contingency tables with their hypergeometric tail, the smaller of
    both sides, and whether it passes ``alpha`` spread over the 16 cells of a table."""
    per = lambda *k: F.sum("observed").over(Window.partitionBy("col1", "col2", *k))
    d = cells.withColumns({"__n1": per("base1"), "__n2": per("base2"), "__t": per()})
    d = hypergeometric(d, "observed", "__n1", "__n2", "__t", two_sided)
    return d.withColumn("significant", F.col("tail") < alpha / 16).drop("__n1", "__n2", "__t")


def spline_basis(x: Column, knots: Sequence[float]) -> list[Column]:
    """The natural cubic spline with these knots as columns: x itself, and a bend for every knot but the last two.

    Beyond the outer knots it goes on straight. Coordinates are scaled to the knots' range.
    """
    low, high = float(knots[0]), float(knots[-1])
    t = [(float(k) - low) / (high - low) for k in knots]
    z = (x - low) / (high - low)

    def bend(k: float) -> Column:
        return (F.pow(F.greatest(z - k, F.lit(0.0)), 3) - F.pow(F.greatest(z - 1.0, F.lit(0.0)), 3)) / (1.0 - k)

    return [z] + [bend(k) - bend(t[-2]) for k in t[:-2]]


def concurvity(df: DataFrame, cols: Sequence[str], knots: int = 5) -> DataFrame:
    """(term, share, worst): how much of a smooth term of each column lies in the space of the others' terms.

    A term is a natural cubic spline with knots at quantiles of its column (equal ones count once). ``share`` is the
    part of its squares that the others' terms explain, ``worst`` that of the function in its space that they explain
    best. Means and then sums of centred products are all that is taken from the data, a number for each pair of
    basis functions. Rows with a null in any column are left out; a column with fewer than two knots has no term.
    """
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    basis, terms = [], {}
    for c in cols:
        at = sorted({q["quantile"] for q in exact_quantiles(rows, [], c, [i / (knots - 1) for i in range(knots)]).collect()})
        its = [] if len(at) < 2 else spline_basis(F.col(c), at) if len(at) > 2 else [(F.col(c) - at[0]) / (at[1] - at[0])]
        terms[c] = range(len(basis), len(basis) + len(its))
        basis += its
    out = []
    if basis:
        means = rows.agg(*[F.avg(b).alias(f"m{i}") for i, b in enumerate(basis)]).first()
        pairs = list(itertools.combinations_with_replacement(range(len(basis)), 2))
        centred = rows.select(*[(b - means[i]).alias(f"b{i}") for i, b in enumerate(basis)])
        sums = centred.agg(*[F.sum(F.col(f"b{i}") * F.col(f"b{j}")).alias(f"s{i}_{j}") for i, j in pairs]).first()
        gram = np.zeros((len(basis), len(basis)))
        for (i, j), v in zip(pairs, sums, strict=True):
            gram[i, j] = gram[j, i] = v
        for c, its in terms.items():
            own, others = list(its), [i for i in range(len(basis)) if i not in its]
            if not own:
                continue
            explained = gram[np.ix_(own, others)] @ np.linalg.pinv(gram[np.ix_(others, others)], hermitian=True) @ gram[np.ix_(others, own)]
            worst = np.linalg.eigvals(np.linalg.pinv(gram[np.ix_(own, own)], hermitian=True) @ explained).real.max() if others else 0.0
            out.append((c, float(np.trace(explained) / np.trace(gram[np.ix_(own, own)])), float(min(1.0, worst))))
    return df.sparkSession.createDataFrame(out, "term string, share double, worst double")
