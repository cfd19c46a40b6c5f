"""Atlas of regions. From the intervals of several experiments: where which of them have something, as regions.

Coordinates are cut into bins; every bin has the set of experiments (groups) with an interval there; neighbouring bins
with the same set are one region. Each region tells its groups, how many intervals support it, and the largest overlap
among them. A second table holds the bins of every set of groups and their share.

    python -m jobs.region_atlas --intervals PATH --output PATH [--config PATH]

The output holds ``regions``, partitioned by the number of groups, and ``sets``. A run replaces both; running it again
gives the same rows. Settings: columns or SQL expressions for key, group, start and stop (half open, whole numbers),
the width of a bin, and the length of the stretches that a key is cut into for the work (a multiple of the width).

Rows without key, group, start or stop, and those that do not stop behind their start, are left out and logged.
Repeated rows support a region as often as they occur. There may be 62 groups.
"""

from __future__ import annotations

import argparse
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from jobs.common import command_line, settings
from tidemark.operators import intervals as I
from tidemark.session import cut

log = logging.getLogger("tidemark.jobs.region_atlas")
SETTINGS = {"key", "group", "start", "stop", "width", "bucket"}
CONFIG = Path(__file__).with_suffix(".json")
#: Groups are bits of a long.
MOST_GROUPS = 62


def masks_of(iv: DataFrame, groups: list[str], width: int) -> DataFrame:
    """(key, mask, start, stop) of the regions of intervals (key, group, start, stop)."""
    at = F.array_position(F.array(*map(F.lit, groups)), F.col("group")).cast("int") - 1
    return I.mask_regions(iv.withColumn("at", at), "key", "at", width)


def regions_of(iv: DataFrame, masks: DataFrame, groups: list[str], width: int, bucket: int) -> DataFrame:
    """(key, start, stop, groups, bins, n_intervals, widest, n_groups) of intervals and their masks."""
    support = I.overlap_join(masks.hint("shuffle_hash"), iv.select("key", F.col("start").alias("i_start"), F.col("stop").alias("i_stop")), "key", bucket, ("start", "stop", "i_start", "i_stop"))
    overlap = F.least("stop", "i_stop") - F.greatest("start", "i_start")
    out = support.groupBy("key", "start", "stop", "mask").agg(F.count("*").alias("n_intervals"), F.max(overlap).alias("widest"))
    bits = F.split(F.reverse(F.bin("mask")), "")
    names = F.array_join(F.transform(F.array(*map(F.lit, groups)), lambda g, i: F.when(F.get(bits, i) == "1", g)), ",")
    return out.select("key", "start", "stop", names.alias("groups"), F.expr(f"cast((stop - start) div {int(width)} as bigint)").alias("bins"), "n_intervals", "widest", F.bit_count("mask").cast("int").alias("n_groups"))


def run(spark: SparkSession, intervals: str, output: str, config: str | Path = CONFIG) -> None:
    s = settings(config, SETTINGS)
    rows = spark.read.parquet(intervals).select(*[F.expr(s[c]).alias(c) for c in ("key", "group", "start", "stop")])
    iv = rows.filter("key is not null and `group` is not null and stop > start").withColumn("group", F.col("group").cast("string"))
    groups = [r["group"] for r in iv.select("group").distinct().orderBy("group").limit(MOST_GROUPS + 1).collect()]
    if len(groups) > MOST_GROUPS:
        raise ValueError(f"there are more than {MOST_GROUPS} groups")
    counted = rows.agg(F.count("*").alias("all"), F.count_if(F.expr("key is not null and `group` is not null and stop > start")).alias("used")).first()
    log.info("read %d intervals of %d groups from %s, left out %d", counted["used"], len(groups), intervals, counted["all"] - counted["used"])
    if not groups:
        groups = [""]
    masks = cut(masks_of(iv, groups, s["width"]))
    regions_of(iv, masks, groups, s["width"], s["bucket"]).write.mode("overwrite").partitionBy("n_groups").parquet(f"{output}/regions")
    sets = masks.groupBy("mask").agg(F.sum(F.expr(f"(stop - start) div {int(s['width'])}")).alias("n"))
    I.with_percent(sets).coalesce(1).write.mode("overwrite").parquet(f"{output}/sets")
    written = atlas(spark, output).groupBy("n_groups").count().orderBy("n_groups").collect()
    log.info("wrote %d regions to %s/regions: %s", sum(r["count"] for r in written), output, {r["n_groups"]: r["count"] for r in written})


def atlas(spark: SparkSession, output: str) -> DataFrame:
    """The regions of an output."""
    schema = "key long, start long, stop long, groups string, bins long, n_intervals long, widest long, n_groups int"
    return spark.read.schema(schema).parquet(f"{output}/regions")


#: The same over lineitem with the settings beside this file.
SQL = """with iv as (select cast(l_suppkey as bigint) as key, l_returnflag as grp, cast(date_diff('day', date '1970-01-01', cast(l_shipdate as date)) as bigint) as i_start,
  cast(date_diff('day', date '1970-01-01', cast(l_shipdate as date)) as bigint) + cast(l_quantity as bigint) as i_stop from lineitem),
ok as (select * from iv where key is not null and grp is not null and i_stop > i_start),
b as (select key, grp, unnest(range((i_start // 5) * 5, i_stop, 5)) as bin from ok),
m as (select key, bin, bool_or(grp = 'A') as a, bool_or(grp = 'N') as n, bool_or(grp = 'R') as r from b group by key, bin),
named as (select key, bin, concat_ws(',', case when a then 'A' end, case when n then 'N' end, case when r then 'R' end) as groups, cast(a as int) + cast(n as int) + cast(r as int) as n_groups from m),
i as (select *, bin - 5 * row_number() over (partition by key, groups order by bin) as island from named),
reg as (select key, groups, n_groups, min(bin) as start, max(bin) + 5 as stop from i group by key, groups, n_groups, island)
select reg.key, reg.start, reg.stop, groups, (reg.stop - reg.start) // 5 as bins, count(*) as n_intervals, max(least(reg.stop, i_stop) - greatest(reg.start, i_start)) as widest, n_groups
from reg join ok on ok.key = reg.key and ok.i_start < reg.stop and reg.start < ok.i_stop group by all"""


def main() -> None:
    def job(spark: SparkSession, args: argparse.Namespace) -> None:
        run(spark, args.intervals, args.output, args.config or CONFIG)

    command_line(__doc__, job, intervals="Parquet table of intervals", output="folder for the atlas", config="JSON file with settings")


if __name__ == "__main__":
    main()
