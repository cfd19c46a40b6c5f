"""Relational, set and aggregate operators over plain tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut

#: The 97.5 % quantile of the standard normal distribution.
Z975 = 1.959963984540054


# -- joins -----------------------------------------------------------------------------------------------------------

def natural_join(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Join on all columns that both sides have."""
    shared = [c for c in a.columns if c in b.columns]
    if not shared:
        raise ValueError("no shared columns")
    return a.join(b, shared, how)


def null_safe_join(a: DataFrame, b: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on columns in which null equals null. Of b the other columns stay, which a must not have.

    Without columns every row meets all of b, which then is a table of bounded size: one row, or a few ranks.
    """
    other = b.select(*[F.col(c).alias(f"__on{i}") for i, c in enumerate(on)], *[c for c in b.columns if c not in on])
    if not on:
        return a.join(F.broadcast(other), F.lit(True), how)
    match = F.lit(True)
    for i, c in enumerate(on):
        match = match & F.col(c).eqNullSafe(F.col(f"__on{i}"))
    return a.join(other, match, how).drop(*[f"__on{i}" for i in range(len(on))])


def keyed_lookup(x: DataFrame, y: DataFrame, on: str | list[str]) -> DataFrame:
    """Every row of y with what x has under its key."""
    return y.join(x, on, "left")


def full_join_zero(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Full outer join; numbers of a side that has no such row become 0, nulls that a side has stay."""
    left, right = a.withColumn("__a", F.lit(True)), b.withColumn("__b", F.lit(True))
    out = left.join(right, on, "full")
    numeric = {f.name for d in (a, b) for f in d.schema.fields if f.dataType.simpleString().split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")}

    def filled(c: str, mark: str) -> Column:
        return F.when(F.col(mark).isNull(), F.lit(0)).otherwise(F.col(c)).alias(c) if c in numeric else F.col(c)

    return out.select(*on, *[filled(c, "__a") for c in a.columns if c not in on], *[filled(c, "__b") for c in b.columns if c not in on])


def lookup(annotation: DataFrame, values: DataFrame, key: str, attributes: Sequence[str]) -> DataFrame:
    """Distinct attributes of the annotated keys among the values: a remote lookup as a semi join."""
    return annotation.join(values.select(key), key, "left_semi").select(*attributes).distinct()


def number_rows(df: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """Rows numbered from 0 in their order, or as they come; ties are numbered as they come.

    Rows are sorted into ranges and written once to the shared folder with their place in their range; the counts of
    the ranges then give every range its first number. No task sees all rows.
    """
    spark = df.sparkSession
    out = cut((df.orderBy(*order) if order else df).withColumn("__at", F.monotonically_increasing_id())).withColumn("__range", F.shiftright("__at", 33))
    first, starts = 0, []
    for r in out.groupBy("__range").count().orderBy("__range").collect():  # a row for each range
        starts.append((r["__range"], first))
        first += r["count"]
    out = out.join(F.broadcast(spark.createDataFrame(starts, "__range long, __first long")), "__range")
    return out.withColumn(name, F.col("__first") + F.col("__at").bitwiseAND((1 << 33) - 1)).select(*df.columns, name)


def bind_columns(a: DataFrame, b: DataFrame, order_a: str, order_b: str) -> DataFrame:
    """Rows paired by rank; the shorter side is padded with nulls."""
    return number_rows(a, "__n", order_a).join(number_rows(b, "__n", order_b), "__n", "full").drop("__n")


# -- filters and selections ------------------------------------------------------------------------------------------

def not_in(df: DataFrame, col: str, values: Sequence[str], null_as: str = "Unknown") -> DataFrame:
    """Rows whose value is none of the given; a null counts as ``null_as``, so it stays unless that is excluded."""
    return df.withColumn(col, F.coalesce(col, F.lit(null_as))).filter(~F.col(col).isin(*values))


#: Ranges that the values of a group are counted in at a time, and values that one range may have to be ranked at once.
RANGES, RANKED = 4096, 1 << 16


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """(by..., p, quantile): exact quantiles, interpolated between the two nearest ranks, of any number of values.

    The values of a group are counted in RANGES ranges between the least and the largest. A range that holds a wanted
    rank is counted anew between its own least and largest value, until both are one or RANKED values are left, which
    are ranked. Every pass is a scan with partial sums: no task holds a group's values, and a group has RANGES rows
    for each rank at most.

    Nulls and NaN are left out, groups without values have no rows, infinite values count as the largest double.
    """
    by = list(by)
    most = 1.7976931348623157e308
    rows = df.select(*by, F.col(value).cast("double").alias("__v")).filter(F.col("__v").isNotNull() & ~F.isnan("__v"))
    rows = rows.withColumn("__v", F.greatest(F.least("__v", F.lit(most)), F.lit(-most)))
    groups = cut(rows.groupBy(*by).agg(F.count("*").alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi")).filter("__n > 0"))
    at = (F.col("__n") - 1) * F.col("p")
    wanted = groups.select(*by, "__n", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p")).select(*by, "p", F.floor(at).alias("__k"), F.ceil(at).alias("__l"), (at - F.floor(at)).alias("__part"))
    ranks = wanted.select(*by, F.explode(F.array("__k", "__l")).alias("__k")).distinct()

    # __below: how many values lie below a range, which names it
    inside = null_safe_join(rows, groups.drop("__n").withColumn("__below", F.lit(0).cast("long")), by)
    found = None
    while True:
        half = F.col("__hi") * 0.5 - F.col("__lo") * 0.5
        inside = inside.withColumn("__range", F.when(half > 0, F.least(F.lit(RANGES - 1), F.floor((F.col("__v") * 0.5 - F.col("__lo") * 0.5) / half * RANGES))).otherwise(0))
        counts = inside.groupBy(*by, "__below", "__range").agg(F.count("*").alias("__c"), F.min("__v").alias("__from"), F.max("__v").alias("__to"))
        upto = F.col("__below") + F.sum("__c").over(W.partitionBy(*by, "__below").orderBy("__range"))
        counts = null_safe_join(counts.withColumn("__start", upto - F.col("__c")), ranks, by)
        chosen = cut(counts.filter("__start <= __k and __k < __start + __c"))
        known = chosen.filter("__from = __to").select(*by, "__k", F.col("__from").alias("__x"))
        found = known if found is None else found.union(known)
        left = chosen.filter("__from < __to").select(*by, "__below", "__range", "__start", "__from", "__to", "__c").distinct()
        most_left = left.agg(F.max("__c")).first()[0]
        if most_left is None:
            break
        left = left.drop("__c")
        inside = null_safe_join(inside.drop("__lo", "__hi"), left, [*by, "__below", "__range"])
        inside = inside.select(*by, "__v", F.col("__start").alias("__below"), F.col("__from").alias("__lo"), F.col("__to").alias("__hi"))
        ranks = chosen.filter("__from < __to").select(*by, "__k").distinct()
        if most_left <= RANKED:
            values = inside.groupBy(*by, "__below", "__v").agg(F.count("*").alias("__c"))
            values = values.withColumn("__start", F.col("__below") + F.sum("__c").over(W.partitionBy(*by, "__below").orderBy("__v")) - F.col("__c"))
            met = null_safe_join(values, ranks, by).filter("__start <= __k and __k < __start + __c")
            found = found.union(met.select(*by, "__k", F.col("__v").alias("__x")))
            break
    out = null_safe_join(wanted, found.withColumnRenamed("__x", "__low"), [*by, "__k"])
    out = null_safe_join(out, found.select(*by, F.col("__k").alias("__l"), F.col("__x").alias("__high")), [*by, "__l"])
    return out.select(*by, "p", (F.col("__low") * (1 - F.col("__part")) + F.col("__high") * F.col("__part")).alias("quantile"))


def above_quantile(df: DataFrame, cols: Sequence[str], p: float) -> DataFrame:
    """Rows above the p-quantile (linear interpolation) in every column. Without values nothing is above it."""
    values = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in cols])).alias("x")).select("x.*")
    limits = {r["name"]: r["quantile"] for r in exact_quantiles(values, ["name"], "value", [p]).collect()}  # a row for each column
    for c in cols:
        df = df.filter(F.col(c) > F.lit(limits.get(c)))
    return df


def min_of_group(df: DataFrame, by: list[str], value: str, tie: str) -> DataFrame:
    """The row with the smallest value of each group; the smaller tie column decides."""
    best = F.min(F.struct(value, tie, *[c for c in df.columns if c not in (*by, value, tie)])).alias("x")
    return df.groupBy(*by).agg(best).select(*by, "x.*").select(*df.columns)


def top_k(df: DataFrame, k: int, value: str, *ties: str) -> DataFrame:
    return df.orderBy(F.desc(value), *ties).limit(k)


def best_run(df: DataFrame, by: list[str], score: str, run: str) -> DataFrame:
    """The best row of each group; the largest run wins a tie."""
    rest = [c for c in df.columns if c not in (*by, score, run)]
    return df.groupBy(*by).agg(F.max(F.struct(score, run, *rest)).alias("x")).select(*by, "x.*").select(*df.columns)


def keep_best_n(df: DataFrame, by: list[str], score: str, n: int, tie: str) -> DataFrame:
    """Worst rows go until n are left in each group."""
    w = W.partitionBy(*by).orderBy(F.desc(score), tie)
    return df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")


def drop_positions(df: DataFrame, by: list[str], order: list[str], positions: Sequence[int]) -> DataFrame:
    """Rows at the given places of their group (1 is the first, -1 the last) go: outliers that were picked by hand."""
    first = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    last = F.count(F.lit(1)).over(W.partitionBy(*by))
    d = df.withColumns({"__i": first, "__n": last})
    return d.filter(~F.col("__i").isin(*positions) & ~(F.col("__i") - F.col("__n") - 1).isin(*positions)).drop("__i", "__n")


# -- sets ------------------------------------------------------------------------------------------------------------

def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def compare_sets(control: DataFrame, treated: DataFrame, key: str) -> DataFrame:
    """common, lost (control alone) or gained (treated alone) for every key, in one shuffle."""
    both = control.select(key, F.lit(1).alias("c"), F.lit(0).alias("t")).unionByName(treated.select(key, F.lit(0).alias("c"), F.lit(1).alias("t")))
    g = both.groupBy(key).agg(F.max("c").alias("c"), F.max("t").alias("t"))
    return g.select(key, F.when(F.expr("c = 1 and t = 1"), "common").when(F.expr("c = 1"), "lost").otherwise("gained").alias("status"))


def stratified_except(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys (stratum included) of a that b lacks."""
    return a.select(*keys).distinct().join(b.select(*keys), keys, "left_anti")


# -- aggregates ------------------------------------------------------------------------------------------------------

def group_counts(df: DataFrame, *by: str, name: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias(name))


def frequency(df: DataFrame, col: str, name: str = "n") -> DataFrame:
    """How often each value occurs; nulls do not count."""
    return df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias(name))


def occupied(df: DataFrame, by: list[str], start: str, stop: str, genome: int, closed: bool = False, digits: int = 2) -> DataFrame:
    """Occurrences, occupied length, mean length (half-even, whole) and percent of the genome, per group."""
    span = F.abs(F.col(stop) - F.col(start)) + (1 if closed else 0)
    g = df.groupBy(*by).agg(F.count("*").alias("occurrences"), F.sum(span).alias("total_bp"))
    return g.withColumns({"mean_length": F.bround(F.col("total_bp") / F.col("occurrences"), 0), "percent": F.bround(F.col("total_bp") * 100.0 / genome, digits)})


def mean_ci(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, standard deviation, count and half-width of the normal 95 % interval."""
    g = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))
    return g.withColumn("ci", F.lit(Z975) * F.col("sd") / F.sqrt("n"))


def pivot_counts(df: DataFrame, row: str, col: str, values: Sequence[str]) -> DataFrame:
    return df.groupBy(row).pivot(col, list(values)).count().na.fill(0)


def melt(df: DataFrame, ids: list[str], cols: list[str], name: str = "name", value: str = "value") -> DataFrame:
    """Wide to long, without nulls."""
    return df.unpivot(ids, cols, name, value).filter(F.col(value).isNotNull())


def five_numbers(df: DataFrame, by: list[str], value: str) -> DataFrame:
    names = {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0}
    q = exact_quantiles(df, by, value, list(names.values()))
    return q.groupBy(*by).agg(*[F.max(F.when(F.col("p") == p, F.col("quantile"))).alias(n) for n, p in names.items()])


def histogram(df: DataFrame, value: str, width: float, origin: float = 0.0) -> DataFrame:
    b = (F.floor((F.col(value) - origin) / width) * width + origin).alias("bin")
    return df.filter(F.col(value).isNotNull()).groupBy(b).agg(F.count("*").alias("n"))


def list_by_key(df: DataFrame, by: list[str], value: str, name: str = "values") -> DataFrame:
    """Sorted list of a column's values for each key."""
    return df.groupBy(*by).agg(F.sort_array(F.collect_list(value)).alias(name))


def lists_by_kind(df: DataFrame, by: list[str], kind: str, value: str, kinds: Sequence[str]) -> DataFrame:
    """One sorted list column for each kind, in one aggregation."""
    return df.groupBy(*by).agg(*[F.sort_array(F.collect_list(F.when(F.col(kind) == k, F.col(value)))).alias(k) for k in kinds])


def flatten_count(df: DataFrame, col: str, name: str = "n") -> DataFrame:
    """How often each element of a list column occurs."""
    return df.select(F.explode(col).alias("element")).groupBy("element").agg(F.count("*").alias(name))


def any_matches(col: str, pattern: str) -> Column:
    return F.exists(col, lambda x: x.rlike(pattern))


def on_rows(df: DataFrame, by: list[str], **aggregates: Column) -> DataFrame:
    """Group aggregates on every row."""
    w = W.partitionBy(*by)
    return df.withColumns({k: v.over(w) for k, v in aggregates.items()})


def aggregate_many(df: DataFrame, by: list[str], span: tuple[str, int], mean: str, first: tuple[str, str]) -> DataFrame:
    """max-min+width of a position, mean of a value, and the first value by an order, per group."""
    pos, width = span
    return df.groupBy(*by).agg((F.max(pos) - F.min(pos) + width).alias("length"), F.avg(mean).alias("mean"), F.min_by(*first).alias("first"))
