"""Interval operators: bins, common bins, merge, nearest features, overlaps, tiles, windows.

Intervals are rows (key..., start, stop); a key such as (chrom) is a list of columns. Coordinates are integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..session import cut
from .tables import null_safe_join


def _keys(keys: str | list[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def bin_starts(start: Column, stop: Column, width: int) -> Column:
    """Starts of the bins that [start, stop) touches; none for an empty interval. A stop on an edge opens no bin."""
    lo = (F.floor(start / width) * width).cast("long")
    hi = (F.ceil(stop / width) * width - width).cast("long")
    return F.when(stop > start, F.sequence(lo, hi, F.lit(width).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def bin_intervals(df: DataFrame, width: int = 50, start: str = "start", stop: str = "stop", name: str = "bin", explode: bool = True) -> DataFrame:
    """A row for each bin of each interval, or the bins as an array."""
    bins = bin_starts(F.col(start), F.col(stop), width)
    return df.withColumn(name, F.explode(bins) if explode else bins)


def all_bins(df: DataFrame, width: int = 50, start: str = "start", stop: str = "stop") -> DataFrame:
    """The distinct bins of all intervals, one column."""
    return bin_intervals(df, width, start, stop).select("bin").distinct()


def common_keys(df: DataFrame, keys: list[str], group: str, n_groups: int | None = None) -> DataFrame:
    """Keys that occur in every group (relational division): one shuffle on the key."""
    n = F.lit(n_groups) if n_groups else df.agg(F.count_distinct(group).alias("n")).scalar()
    return df.groupBy(*keys).agg(F.count_distinct(group).alias("__n")).filter(F.col("__n") == n).drop("__n")


def collapse(df: DataFrame, by: list[str], width: int = 50, pos: str = "bin", keep_rows: bool = False) -> DataFrame:
    """Bins back to regions: start is the smallest bin, stop the largest plus the width.

    ``pos`` may be the array of bins of ``bin_intervals(explode=False)``; an interval without bins is then left out.
    """
    if isinstance(df.schema[pos].dataType, T.ArrayType):
        d = df.filter(F.size(pos) > 0)
        lo, hi = F.min(F.array_min(pos)), F.max(F.array_max(pos))
    else:
        d, lo, hi = df, F.min(pos), F.max(pos)
    df = d
    if keep_rows:
        w = W.partitionBy(*by)
        return df.withColumns({"start": lo.over(w), "stop": hi.over(w) + width})
    hi = hi + width
    return df.groupBy(*by).agg(lo.alias("start"), hi.alias("stop"))


def collapse_islands(df: DataFrame, by: list[str], width: int = 50, pos: str = "bin", bucket: int | None = None) -> DataFrame:
    """The strict form of collapse: a region for each run of neighbouring bins.

    With ``bucket``, a multiple of the width, runs are found inside stretches of so many coordinates, and only those
    that touch the border of a stretch, two of each at most, meet by key.
    """
    if bucket and bucket % width:
        raise ValueError("a bucket is a multiple of the width")
    part = [*by, "__bucket"]
    d = df.select(*by, pos).distinct().withColumn("__bucket", F.floor(F.col(pos) / (bucket or 1)) if bucket else F.lit(0))
    d = d.withColumn("__island", F.col(pos) - width * F.row_number().over(W.partitionBy(*part).orderBy(pos)))
    d = d.groupBy(*part, "__island").agg(F.min(pos).alias("start"), (F.max(pos) + width).alias("stop")).select(*by, "start", "stop")
    return _across(d, by, bucket) if bucket else d


def _across(d: DataFrame, by: list[str], bucket: int) -> DataFrame:
    """Runs (by..., start, stop) found inside buckets, with those put together that go on over a border."""
    edge = (F.pmod("start", F.lit(bucket)) == 0) | (F.pmod("stop", F.lit(bucket)) == 0)
    w = W.partitionBy(*by).orderBy("start")
    rest = d.filter(edge).withColumn("__new", F.coalesce((F.col("start") > F.lag("stop").over(w)).cast("int"), F.lit(1)))
    rest = rest.withColumn("__island", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return d.filter(~edge).union(rest.groupBy(*by, "__island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).select(*by, "start", "stop"))


#: Bins that are the bits of one number.
BINS = 60


def mask_regions(df: DataFrame, keys: str | list[str], at: str, width: int, start: str = "start", stop: str = "stop") -> DataFrame:
    """(keys..., mask, start, stop): a region for each run of neighbouring bins that the same groups touch.

    ``at`` is the bit of a row's group, from 0 to 61. Bins are bits of numbers, one for each stretch of BINS bins and
    group, so an interval is one row for each stretch that it touches and not one for each bin. Runs begin where some
    group's bits change.
    """
    by = _keys(keys)

    def shift(way: str, x: Column, n: Column) -> Column:
        return F.call_function(f"shift{way}", x, n.cast("int"))

    d = df.filter(F.col(stop) > F.col(start)).select(*by, F.col(at).alias("__at"), F.floor(F.col(start) / width).alias("__lo"), (F.ceil(F.col(stop) / width) - 1).alias("__hi"))
    d = d.withColumn("__w", F.explode(F.sequence(F.floor(F.col("__lo") / BINS), F.floor(F.col("__hi") / BINS))))
    lo = F.greatest(F.col("__lo") - F.col("__w") * BINS, F.lit(0))
    hi = F.least(F.col("__hi") - F.col("__w") * BINS, F.lit(BINS - 1))
    one = F.lit(1).cast("long")
    d = d.groupBy(*by, "__w", "__at").agg(F.bit_or(shift("left", shift("left", one, hi - lo + 1) - 1, lo)).alias("__bits"))
    d = d.groupBy(*by, "__w").agg(F.collect_list(F.struct("__at", "__bits")).alias("__sets"))
    change = F.aggregate("__sets", one, lambda a, x: a.bitwiseOR(x["__bits"].bitwiseXOR(F.shiftleft(x["__bits"], 1))))
    d = d.withColumn("__change", change)
    begins = F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.getbit("__change", i) == 1)
    d = d.withColumn("__from", begins).select(*by, "__w", "__sets", F.explode(F.zip_with("__from", F.slice("__from", F.lit(2), F.lit(BINS)), lambda a, b: F.struct(a.alias("a"), F.coalesce(b, F.lit(BINS)).alias("b")))).alias("__run"))
    mask = F.aggregate("__sets", F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(shift("left", F.getbit(x["__bits"], F.col("__run.a")).cast("long"), x["__at"])))
    edges = [((F.col("__w") * BINS + F.col(f"__run.{e}")) * width).cast("long").alias(n) for e, n in (("a", "start"), ("b", "stop"))]
    return _across(cut(d.select(*by, mask.alias("mask"), *edges)).filter("mask != 0"), [*by, "mask"], BINS * width)


def merge_intervals(df: DataFrame, keys: str | list[str], start: str = "start", stop: str = "stop", gap: int = 1, bucket: int | None = None) -> DataFrame:
    """Overlapping and adjacent intervals become one: (keys, start, stop, n).

    Closed intervals: the next start may exceed the stop by at most ``gap``. With ``bucket``, intervals are merged
    inside coordinate buckets first. Pieces that reach into other buckets mark how far they do, and only these and the
    pieces that they reach meet by key; so a key with very many intervals is spread over tasks.
    """
    by = _keys(keys)

    def islands(d: DataFrame, part: list[str]) -> DataFrame:
        before = W.partitionBy(*part).orderBy("start", "stop").rowsBetween(W.unboundedPreceding, -1)
        upto = W.partitionBy(*part).orderBy("start", "stop").rowsBetween(W.unboundedPreceding, 0)
        d = d.withColumn("__new", (F.col("start") > F.coalesce(F.max("stop").over(before) + gap, F.col("start") - 1)).cast("int"))
        d = d.withColumn("__island", F.sum("__new").over(upto))
        return d.groupBy(*part, "__island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("n").alias("n")).drop("__island")

    d = df.select(*by, F.col(start).alias("start"), F.col(stop).alias("stop"), F.lit(1).cast("long").alias("n")).filter("start is not null and stop is not null")
    if not bucket:
        return islands(d, by)
    d = cut(islands(d.withColumn("__bucket", F.floor(F.col("start") / bucket)), [*by, "__bucket"]))
    last = F.floor((F.col("stop") + gap) / bucket)
    reach = d.filter(last > F.col("__bucket")).select(*by, F.explode(F.sequence(F.col("__bucket") + 1, last)).alias("__bucket"), (F.col("stop") + gap).alias("__reach"))
    reach = reach.groupBy(*by, "__bucket").agg(F.max("__reach").alias("__reach"))
    d = null_safe_join(d, reach, [*by, "__bucket"], "left").withColumn("__meets", (last > F.col("__bucket")) | F.coalesce(F.col("start") <= F.col("__reach"), F.lit(False)))
    whole = d.filter(~F.col("__meets")).select(*by, "start", "stop", "n")
    return whole.union(islands(d.filter("__meets").select(*by, "start", "stop", "n"), by))


def _with(bit: Column):
    return lambda x: x.bitwiseOR(bit)


#: Groups whose presence is varied in one round of sums over subsets.
BITS = 5


def subset_masks(df: DataFrame, keys: list[str], group: str, groups: list[str]) -> DataFrame:
    """One row for each mask of groups that some key has exactly: (mask, n). The last group is bit 0 upward."""
    if len(groups) > 62:
        raise ValueError("a mask has 62 bits")
    at = F.array_position(F.array(*map(F.lit, groups)), F.col(group))
    bit = F.expr("shiftleft(1L, __at - 1)")
    d = df.withColumn("__at", at.cast("int")).filter("__at > 0")
    return d.groupBy(*keys).agg(F.bit_or(bit).alias("mask")).groupBy("mask").agg(F.count("*").alias("n"))


def subset_intersections(df: DataFrame, keys: list[str], group: str, groups: list[str]) -> DataFrame:
    """For every non-empty subset of groups how many keys all of them share: (mask, groups, n).

    One pass over the data gives a histogram of exact masks; the sums over supersets run on at most 2^n rows.
    """
    sums, n = subset_masks(df, keys, group, groups), len(groups)
    spark = df.sparkSession
    subsets = spark.range(1, 1 << n).select(F.col("id").alias("mask"))
    # every mask counts for all that it holds: some bits at a time are kept or dropped, and what meets is summed, so
    # that there are n/BITS rounds over 2^n rows at most, and no pair of masks is looked at for nothing
    for low in range(0, n, BITS):
        own = F.array(F.lit(0).cast("long"))
        for i in range(low, min(n, low + BITS)):
            bit = F.lit(1 << i).cast("long")
            with_bit = F.concat(own, F.transform(own, _with(bit)))
            own = F.when(F.col("mask").bitwiseAND(bit) != 0, with_bit).otherwise(own)
        inside = F.lit(((1 << min(n, low + BITS)) - 1) ^ ((1 << low) - 1)).cast("long")
        rest = F.col("mask").bitwiseAND(F.bitwise_not(inside))
        spread = sums.select("n", rest.alias("rest"), F.explode(own).alias("part"))
        sums = spread.groupBy(F.col("rest").bitwiseOR(F.col("part")).alias("mask")).agg(F.sum("n").alias("n"))
    bits = F.split(F.reverse(F.bin("mask")), "")
    names = F.array_join(F.transform(F.array(*map(F.lit, groups)), lambda g, i: F.when(F.get(bits, i) == "1", g)), ",")
    return subsets.join(sums, "mask", "left").select("mask", names.alias("groups"), F.coalesce("n", F.lit(0)).alias("n"))


def venn_regions(df: DataFrame, keys: list[str], group: str, groups: list[str]) -> DataFrame:
    """Exact-mask counts and their share in percent: the regions of a Venn diagram."""
    return with_percent(subset_masks(df, keys, group, groups))


def with_percent(m: DataFrame) -> DataFrame:
    """Counts n of masks with their share in percent."""
    return m.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(W.partitionBy(F.lit(0))))


def overlap_join(a: DataFrame, b: DataFrame, keys: str | list[str], bucket: int, names: tuple[str, str, str, str] = ("start", "stop", "start", "stop")) -> DataFrame:
    """Pairs of half-open intervals that overlap, as an equi-join on (key, bucket).

    Each pair is emitted in the one bucket where the later start lies. Columns of both sides keep their names and
    must differ but for the keys.
    """
    by = _keys(keys)
    s1, e1, s2, e2 = names

    def spread(d: DataFrame, s: str, e: str) -> DataFrame:
        return d.filter(F.col(e) > F.col(s)).withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(s) / bucket), F.floor((F.col(e) - 1) / bucket))))

    x, y = spread(a, s1, e1), spread(b, s2, e2)
    out = x.join(y, [*by, "__bucket"]).filter((F.col(s1) < F.col(e2)) & (F.col(s2) < F.col(e1)) & (F.col("__bucket") == F.floor(F.greatest(F.col(s1), F.col(s2)) / bucket)))
    return out.drop("__bucket")


def signed_distance(a_start: Column, a_stop: Column, b_start: Column, b_stop: Column) -> Column:
    """0 on overlap of half-open intervals, else gap + 1; negative where b lies to the left."""
    return F.when((b_start < a_stop) & (a_start < b_stop), F.lit(0)).when(b_start >= a_stop, b_start - a_stop + 1).otherwise(-(a_start - b_stop + 1))


def nearest(a: DataFrame, b: DataFrame, keys: str | list[str], k: int = 1, a_id: str = "a_id", bucket: int | None = None) -> DataFrame:
    """The k nearest features of b for each interval of a, with ties: a joined to b, and ``distance``.

    a has (keys, a_id, a_start, a_stop), b has (keys, b_start, b_stop, ...). The result is what rank() <= k over the
    absolute distance gives, without comparing all of a key: the k nearest different positions on either side come
    from running windows inside buckets of positions, with the last positions of the buckets before; overlaps come
    from a bucket join, and an equi-join on the positions brings all ties. A key with very many features is spread
    over its buckets.
    """
    by, bucket = _keys(keys), bucket or 1 << 14
    place = [*by, "__p"]
    a = a.withColumns({"a_start": F.col("a_start").cast("long"), "a_stop": F.col("a_stop").cast("long")})
    b = b.withColumns({"b_start": F.col("b_start").cast("long"), "b_stop": F.col("b_stop").cast("long")})
    cell = F.floor(F.col("__p") / bucket).cast("long").alias("__b")

    def side(end: str, edge: str, sign: int) -> DataFrame:
        """(keys, a_id, __p): of each interval the k different points at or before its edge; with sign -1, after."""
        points = b.select(*by, (F.col(end) * sign).alias("__p")).distinct().select(*place, cell)
        edges = a.select(*by, F.col(a_id), (F.col(edge) * sign).alias("__p")).select(*place, cell, a_id)
        # the last k points of each bucket, then those up to the end of each bucket: k buckets with points hold them
        last = W.partitionBy(*by, "__b").orderBy(F.desc("__p"))
        tails = points.withColumn("__r", F.row_number().over(last)).filter(F.col("__r") <= k).groupBy(*by, "__b").agg(F.collect_list("__p").alias("__t"))
        upto = F.flatten(F.collect_list("__t").over(W.partitionBy(*by).orderBy("__b").rowsBetween(1 - k, 0)))
        tails = tails.select(*by, "__b", F.slice(F.sort_array(upto, False), 1, k).alias("__t"))
        # each bucket with edges takes over the points of the last bucket before it
        asked = edges.select(*by, "__b").distinct().select(*by, "__b", F.lit(None).cast("array<bigint>").alias("__t"), F.lit(0).alias("__q"))
        known = asked.unionByName(tails.withColumn("__q", F.lit(1)))
        before = F.last("__t", ignorenulls=True).over(W.partitionBy(*by).orderBy("__b", "__q").rowsBetween(W.unboundedPreceding, 0))
        carried = known.withColumn("__t", before).filter("__q = 0").select(*by, "__b", F.explode("__t").alias("__p"))
        # inside a bucket, each point with the k points that end at it, and each edge with the last such
        inside = W.partitionBy(*by, "__b")
        points = points.select(*by, "__b", "__p").unionByName(carried).withColumn("__near", F.collect_list("__p").over(inside.orderBy("__p").rowsBetween(1 - k, 0)))
        both = points.withColumns({a_id: F.lit(None).cast(dict(a.dtypes)[a_id]), "__q": F.lit(0)}).unionByName(edges.withColumns({"__near": F.lit(None).cast("array<bigint>"), "__q": F.lit(1)}))
        near = F.last("__near", ignorenulls=True).over(inside.orderBy("__p", "__q").rowsBetween(W.unboundedPreceding, 0))
        return both.withColumn("__near", near).filter("__q = 1").select(*by, a_id, F.explode("__near").alias("__p")).withColumn("__p", F.col("__p") * sign)

    lefts = side("b_stop", "a_start", 1).join(b.withColumn("__p", F.col("b_stop")), place).drop("__p")
    rights = side("b_start", "a_stop", -1).join(b.withColumn("__p", F.col("b_start")), place).drop("__p")
    sides = a.join(lefts.unionByName(rights), [*by, a_id])
    over = overlap_join(a, b, by, bucket, ("a_start", "a_stop", "b_start", "b_stop"))
    sides = sides.filter("not (b_start < a_stop and a_start < b_stop)")
    out = sides.unionByName(over.select(*sides.columns))
    out = out.withColumn("distance", signed_distance(F.col("a_start"), F.col("a_stop"), F.col("b_start"), F.col("b_stop")))
    return out.withColumn("__rank", F.rank().over(W.partitionBy(*by, a_id).orderBy(F.abs("distance")))).filter(F.col("__rank") <= k).drop("__rank")


def interval_substring(df: DataFrame, sequences: DataFrame, key: str, seq: str = "seq", start: str = "start", stop: str = "stop", chunk: int = 1 << 14) -> DataFrame:
    """The letters of [start, stop) of the named sequence, 0-based, as ``fragment``; empty for an empty interval.

    Sequences, one for each key, are cut into chunks; different intervals meet the chunks that they touch, and their
    parts are put together. So no row carries a sequence.
    """
    pattern = F.lit("(?s).{1,%d}" % chunk)
    cut = sequences.select(F.col(key).alias("__k"), F.posexplode(F.regexp_extract_all(seq, pattern, F.lit(0))).alias("__c", "__t"))
    want = df.select(F.col(key).alias("__k"), F.col(start).cast("long").alias("__s"), F.col(stop).cast("long").alias("__e")).distinct()
    first, last = F.floor(F.greatest("__s", F.lit(0)) / chunk).cast("int"), F.floor((F.col("__e") - 1) / chunk).cast("int")
    spread = want.filter("__e > __s and __e > 0").withColumn("__c", F.explode(F.sequence(first, last)))
    base = F.col("__c").cast("long") * chunk
    lo, hi = F.greatest(F.col("__s") - base, F.lit(0)), F.least(F.col("__e") - base, F.lit(chunk))
    part = F.substring("__t", lo.cast("int") + 1, (hi - lo).cast("int"))
    whole = spread.join(cut, ["__k", "__c"]).groupBy("__k", "__s", "__e").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("__c").alias("c"), part.alias("t")))), lambda x: x["t"]), "").alias("__f"))
    known = df.join(sequences.select(key).distinct(), key, "left_semi")
    out = known.join(whole, (known[key] == whole["__k"]) & (known[start].cast("long") == whole["__s"]) & (known[stop].cast("long") == whole["__e"]), "left")
    return out.select(*df.columns, F.coalesce("__f", F.lit("")).alias("fragment"))


def tile_range(df: DataFrame, pos: str, width: int) -> tuple[int, int]:
    """From the tile of the first position to behind that of the last; nothing is (0, 0)."""
    lo, hi = df.agg(F.min(pos), F.max(pos)).first()
    return (0, 0) if lo is None else (lo // width * width, (hi // width + 1) * width)


def tile_counts(df: DataFrame, pos: str, group: str, width: int, lo: int, hi: int, groups: list[str]) -> DataFrame:
    """Dense counts over half-open tiles [t, t+width) of [lo, hi) for every group: (tile, group, n)."""
    spark = df.sparkSession
    tiles = spark.range(lo, hi, width).select(F.col("id").alias("tile"))
    frame = tiles.select("tile", F.explode(F.array(*map(F.lit, groups))).alias(group))
    tile = (F.floor((F.col(pos) - lo) / width) * width + lo).alias("tile")
    counts = df.filter((F.col(pos) >= lo) & (F.col(pos) < hi)).groupBy(tile, group).agg(F.count("*").alias("n"))
    return frame.join(counts, ["tile", group], "left").select("tile", group, F.coalesce("n", F.lit(0)).alias("n"))


def tile_stats(df: DataFrame, pos: str, group: str, width: int, lo: int, hi: int, groups: list[str]) -> DataFrame:
    """Minimum, mean and maximum over groups for each tile, empty tiles included."""
    return tile_counts(df, pos, group, width, lo, hi, groups).groupBy("tile").agg(F.min("n").alias("min_n"), F.avg("n").alias("mean_n"), F.max("n").alias("max_n"))


def sliding_windows(length: Column, width: int, phase: Column | int = 0) -> Column:
    """Starts of windows of a width at steps of half the width, from a phase, inside [0, length)."""
    lo = F.lit(phase).cast("long") if isinstance(phase, int) else phase.cast("long")
    hi = (length - width).cast("long")
    return F.when(hi >= lo, F.sequence(lo, hi, F.lit(width // 2).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def windows_of(pos: Column, width: int, step: int) -> Column:
    """Starts of the sliding windows [s, s+width), s a multiple of step, that hold a position."""
    last = F.floor(pos / step) * step
    first = F.floor((pos - width) / step) * step + step
    return F.sequence(first.cast("long"), last.cast("long"), F.lit(step).cast("long"))


def multiplicity(df: DataFrame, keys: list[str], group: str) -> DataFrame:
    """How many keys occur n times in a group: (group, n, keys)."""
    return df.groupBy(*keys, group).agg(F.count("*").alias("n")).groupBy(group, "n").agg(F.count("*").alias("n_keys"))


def resize(df: DataFrame, width: int, start: str = "start", stop: str = "stop") -> DataFrame:
    """Intervals of a fixed width about their centres."""
    from ..functions.scalar import resized

    s, e = resized(F.col(start), F.col(stop), width)
    return df.withColumns({"new_start": s, "new_stop": e})


def summit_from_bin(df: DataFrame, start: str = "start", offset: str = "summit_offset", bin: str = "bin") -> DataFrame:
    """Adds ``summit`` (the start plus its offset) and ``summit_in_bin``, its place counted from a bin."""
    summit = F.col(start) + F.col(offset)
    return df.withColumns({"summit": summit, "summit_in_bin": summit - F.col(bin)})


def centred(df: DataFrame, width: int, summit: str = "summit") -> DataFrame:
    """Adds new_start and new_stop, ``width`` apart with the summit in the middle. An odd width is refused, since its
    windows would not be of that width; a null summit gives nulls."""
    if width % 2:
        raise ValueError("the width must be even")
    return df.withColumns({"new_start": F.col(summit) - width // 2, "new_stop": F.col(summit) + width // 2})


def draw_pairs(groups: DataFrame, group: str, n: int, seed: int) -> list[tuple[str, str]]:
    """n pairs of two different groups each, drawn by a hash of the seed, the number of the draw and the group.

    The names of the groups are collected: a few for each pair, since the least two hashes of a draw are its pair.
    """
    names = groups.select(F.col(group).alias("g")).filter("g is not null").distinct()
    spread = names.select("g", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    ranked = spread.withColumn("h", F.xxhash64(F.lit(seed), "i", "g"))
    two = ranked.groupBy("i").agg(F.slice(F.array_sort(F.collect_list(F.struct("h", "g"))), 1, 2).alias("x")).orderBy("i").collect()
    if any(len(r.x) < 2 for r in two):
        raise ValueError("two groups are needed")
    return [(r.x[0].g, r.x[1].g) for r in two]


def pair_background(df: DataFrame, group: str, pairs: list[tuple[str, str]], width: int = 500, bin_width: int = 50, peak: str = "peak_name", keys: tuple[str, ...] = ("chrom", "bin")) -> DataFrame:
    """For sampled pairs of groups the regions of their common bins, resized about the centre."""
    spark = df.sparkSession
    chosen = spark.createDataFrame([(i, g) for i, p in enumerate(pairs) for g in p], f"pair int, {group} string")
    d = df.join(F.broadcast(chosen), group)
    common = d.groupBy("pair", *keys).agg(F.count_distinct(group).alias("n")).filter("n = 2").drop("n")
    regions = d.join(common, ["pair", *keys], "left_semi").groupBy("pair", *keys[:-1], peak).agg(F.min(keys[-1]).alias("start"), (F.max(keys[-1]) + bin_width).alias("stop"))
    return resize(regions, width)
