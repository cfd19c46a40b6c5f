"""Mixing sources to target weights by Pfair scheduling.

Rows of a source are cut into blocks. With weight w, the k-th block of a source is released at slot floor((k-1)/w)
and due before slot ceil(k/w). Earliest deadline first, among released blocks, places every block inside its window,
so that after any number of slots each source is less than one block away from its share.

Target weights are whole numbers a of a sum d (0.3 and 0.45 are 30 and 45), so the schedule repeats after d slots. One
cycle is laid out once, and the k-th block of a source follows by arithmetic and a lookup in that bounded table. A leg
with fewer slots than d is laid out as far as it goes, which is exact too. Only where both the sum and the leg are
longer than the table may be, weights are rounded to it (``cycle_of``). When a source has no blocks left, the next
*leg* begins, in which the other sources share the slots in proportion to their weights; so every row is placed, and
the bound holds within each leg.

The ranks of rows in a source are counted in hash buckets, with offsets summed over bucket counts: no task sees a
whole source.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .common import fresh, read

#: Slots of one cycle at most, and entries that the tables of all legs may have together.
CYCLE, ENTRIES = 1 << 16, 1 << 22
#: Rows that one bucket holds on average.
BUCKET_ROWS = 4096


def cycle_of(sources: int) -> int:
    """Slots that a cycle may have with so many sources, each of which may end a leg. There is room for all sources."""
    return max(2 * sources, min(CYCLE, ENTRIES // max(1, sources)))


def whole(weights: dict[str, float | Fraction]) -> dict[str, int]:
    """The weights as the smallest whole numbers in the same proportions; floats mean the decimals that they print."""
    exact = {s: w if isinstance(w, Fraction) else Fraction(str(w)) for s, w in weights.items()}
    scale = math.lcm(*(x.denominator for x in exact.values()))
    out = {s: int(x * scale) for s, x in exact.items()}
    common = math.gcd(*out.values())
    return {s: x // common for s, x in out.items()}


def rounded(parts: dict[str, int], cycle: int) -> dict[str, int]:
    """Whole parts that sum to the cycle: largest remainders, and one for a source whose share is below a part."""
    total = sum(parts.values())
    low = {s: 1 for s, a in parts.items() if a * cycle < total}
    rest, room = sum(a for s, a in parts.items() if s not in low), cycle - len(low)
    out = low | {s: a * room // rest for s, a in parts.items() if s not in low}
    # sources just above a part may be rounded below it when others are lifted to one
    out = {s: max(1, x) for s, x in out.items()}
    order = sorted((s for s in parts if s not in low), key=lambda s: (-(parts[s] * room % rest), s))
    left = cycle - sum(out.values())
    for s in order[:left]:
        out[s] += 1
    for s in sorted(out, key=lambda s: (-out[s], s))[: max(0, -left)]:
        out[s] -= 1
    return out


def pfair(parts: dict[str, int], slots: int) -> list[str]:
    """The source of each of the first slots: earliest deadline first among released blocks."""
    total = sum(parts.values())
    release: dict[int, list[str]] = {0: sorted(parts)}
    done = dict.fromkeys(parts, 0)
    ready: list[tuple[int, str]] = []
    out = []
    for slot in range(slots):
        for s in release.pop(slot, ()):
            heapq.heappush(ready, (-(-(done[s] + 1) * total // parts[s]), s))
        due, s = heapq.heappop(ready)
        if due <= slot:
            raise AssertionError("a block missed its deadline")
        out.append(s)
        done[s] += 1
        # the next block may be released in this very slot, and then is there for the next one
        release.setdefault(max(slot + 1, done[s] * total // parts[s]), []).append(s)
    return out


def legs_of(blocks: dict[str, int], weights: dict[str, float | Fraction], cycle: int | None = None) -> list[tuple]:
    """Rows (source, leg, first block, past block, first slot of the leg, parts, places, length): the whole plan.

    places are the slots in a cycle, of that length, of the source's parts. A leg ends when a source has no blocks
    left.
    """
    done, start, out, leg = dict.fromkeys(blocks, 0), 0, [], 0
    cycle = cycle or cycle_of(len(blocks))
    while left := {s: n - done[s] for s, n in blocks.items() if n > done[s]}:
        parts = whole({s: weights[s] for s in left})
        # the leg is over when the first source is: what it needs is within its last deadline
        longest = min(-(-n * sum(parts.values()) // parts[s]) for s, n in left.items())
        if sum(parts.values()) > cycle and longest > cycle:
            parts = rounded(parts, cycle)
            longest = min(-(-n * cycle // parts[s]) for s, n in left.items())
        length = min(sum(parts.values()), longest)
        places: dict[str, list[int]] = {s: [] for s in left}
        for slot, s in enumerate(pfair(parts, length)):
            places[s].append(slot)
        # the slot at which each source places its last block, for those that do so in this leg
        last = [(n - 1) // len(places[s]) * length + places[s][(n - 1) % len(places[s])] for s, n in left.items() if places[s] and (length == sum(parts.values()) or n <= len(places[s]))]
        end = min(last) + 1
        for s, n in left.items():
            cycles, rest = divmod(end, length)
            taken = cycles * len(places[s]) + sum(p < rest for p in places[s])
            if taken:
                out.append((s, leg, done[s], done[s] + taken, start, len(places[s]), places[s], length))
                done[s] += taken
        start, leg = start + end, leg + 1
    return out


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, block_rows: int = 16, source_col: str = "source", key_cols: tuple[str, ...] = ("doc_id",), cycle: int | None = None) -> tuple[DataFrame, list[str]]:
    """The rows of docs with leg, block, slot and position (all long), and the names of these columns.

    ``position`` orders the mix: slot, then the place in the block; positions are unique, and only a source's last
    block may be short. Rows of a source come in the order of a hash of the whole row, the key columns before it.
    ``weights`` names the target weight of each source (positive); sources without one share the mean weight. Without
    any, the target is the square root of a source's share, in parts of a cycle, which lifts small sources. A null
    source is a source of its own. Rows with equal keys are ordered by a hash of the whole row; rows equal in every
    column are interchangeable. Null keys are keys like others, and texts are only hashed, whatever their length. An
    empty table gives an empty result.

    The plan is made on the driver from one row for each source, with ENTRIES entries or two for each source and leg.
    """
    spark = docs.sparkSession
    leg, block, slot, position, h, bucket, src, key, rank, legs, s, b, offset = fresh(docs, "leg", "block", "slot", "position", "__h", "__bucket", "__src", "__key", "__rank", "__legs", "__s", "__b", "__offset")
    source: Column = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    counts = {r[0]: r[1] for r in docs.groupBy(source.alias("s")).agg(F.count("*").alias("n")).collect()}  # one row for each source
    target = {f"={s}": Fraction(str(w)) for s, w in (weights or {}).items()}
    if any(w <= 0 for w in target.values()):
        raise ValueError("weights must be positive")
    known = [target[s] for s in counts if s in target]
    mean = sum(known) / len(known) if known else Fraction(1)
    if weights:
        target = {s: target.get(s, mean) for s in counts}
    else:
        limit = cycle or cycle_of(len(counts))
        roots = {s: max(1, round(math.sqrt(n) * 1000)) for s, n in counts.items()}
        target = {s: Fraction(p) for s, p in (rounded(roots, limit) if sum(roots.values()) > limit else roots).items()}
    plan = legs_of({s: -(-n // block_rows) for s, n in counts.items()}, target, cycle)
    types = [T.StructField("s", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("leg", "first", "past", "start", "parts")), T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("length", T.LongType())]
    table = spark.createDataFrame(plan, T.StructType(types))
    table = table.groupBy(F.col("s").alias(s)).agg(F.array_sort(F.collect_list(F.struct("leg", "first", "past", "start", "parts", "places", "length"))).alias(legs))
    buckets = 1 << max(0, (sum(counts.values()) // BUCKET_ROWS).bit_length())
    plain = [F.col(c).cast("string") for c in docs.columns]
    # rows of a key that repeats are dealt apart, by the rest of the row
    base = docs.withColumns({src: source, key: F.xxhash64(*plain)}).withColumn(h, F.xxhash64(*[F.col(c) for c in key_cols], F.col(key)))
    # the bucket is the top of the hash, so that buckets are in order of the hash
    base = base.withColumn(bucket, F.shiftrightunsigned(h, 64 - buckets.bit_length() + 1).cast("long") if buckets > 1 else F.lit(0).cast("long"))
    sizes = base.groupBy(src, bucket).agg(F.count("*").alias("n"))
    before = F.expr(f"sum(n) over (partition by {src} order by {bucket}) - n")
    offsets = sizes.select(F.col(src).alias(s), F.col(bucket).alias(b), before.alias(offset))
    place = F.expr(f"row_number() over (partition by {src}, {bucket} order by {h}, {', '.join(f'`{c}`' for c in key_cols)}, {key}) - 1")
    ranked = base.withColumn(rank, place).join(offsets, (F.col(src) == F.col(s)) & (F.col(bucket) == F.col(b)))
    ranked = ranked.withColumn(rank, F.col(rank) + F.col(offset)).drop(s).withColumn(block, F.expr(f"{rank} div {block_rows}"))
    out = ranked.join(F.broadcast(table), F.col(src) == F.col(s))  # ENTRIES entries, or two for each source and leg
    now = F.element_at(F.filter(legs, lambda x: (x["first"] <= F.col(block)) & (F.col(block) < x["past"])), 1)
    out = out.withColumn(legs, now)
    x = F.col(legs)
    k = F.col(block) - x["first"]
    at = x["start"] + F.floor(k / x["parts"]) * x["length"] + F.get(x["places"], (k % x["parts"]).cast("int"))
    out = out.withColumns({leg: x["leg"], slot: at}).withColumn(position, F.col(slot) * block_rows + F.col(rank) % block_rows)
    return out.select(*docs.columns, leg, block, slot, position), [leg, block, slot, position]


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's block, slot and position in the mix."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source")
    out, (leg, block, slot, position) = mix_sources(docs)
    return out.select("doc_id", "source", F.col(leg).alias("leg"), F.col(block).alias("block"), F.col(slot).alias("slot"), F.col(position).alias("position"))
