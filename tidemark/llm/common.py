"""Helpers that the text operators share: scratch tables, hashing, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import shared_folder

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
#: Distinct words whose hashes one Python worker remembers.
_REMEMBERED = 1 << 18
#: Words of 64 bits in a filter over ids.
FILTER_WORDS = 1 << 14
#: Bytes of texts or arrays that one Arrow batch carries.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only a local session without one gets a temporary folder."""
    return shared_folder(spark)


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES, so that long texts do not add up in a Python worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def released(run):
    """A function for mapInArrow that gives memory back to the machine when a task ends.

    Workers live on between tasks, and what their allocators keep would count beside the next stage's.
    """

    def wrapped(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only where the C library can
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


class Scratch:
    """Tables in the shared folder that cut the lineage: a lost executor costs a reread, not a recomputation.

    ``drop`` removes tables that nothing reads any more. Those that a returned DataFrame still reads stay, since
    it is lazy; the shared folder is the cluster's to clear.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        bound_batches(spark)
        self.base = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{len(self.paths)}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[len(self.paths)] = (out, path)
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark._jvm
        for frame, path in self.paths.values():
            if any(frame is x for x in frames):
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)

    def sweep(self) -> None:
        """Lets Spark remove the shuffle files of plans that are done with: it does so when the driver's memory is
        swept, which may be long after the files have filled the disks."""
        gc.collect()
        self.spark._jvm.System.gc()

    def keep(self, *frames: DataFrame) -> None:
        """Drops all tables but these."""
        self.drop(*[f for f, _ in self.paths.values() if not any(f is x for x in frames)])

    def last(self, df: DataFrame) -> DataFrame:
        """Cuts a result and drops all that led to it."""
        out = self.cut(df)
        self.keep(out)
        return out


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that the frame does not have yet."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit integers (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def odd(k: int) -> np.uint64:
    """The k-th of a fixed sequence of odd multipliers."""
    z = (_GOLD * (k + 1)) & _MASK
    z = ((z ^ (z >> 30)) * int(_M1)) & _MASK
    z = ((z ^ (z >> 27)) * int(_M2)) & _MASK
    return np.uint64((z ^ (z >> 31)) | 1)


class WordHash(dict):
    """64-bit hash of a word given as bytes, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingle_set(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of n words; a shorter text is one shingle, an empty one none."""
    if not len(hashes):
        return hashes
    k = min(n, len(hashes))
    out = np.full(len(hashes) - k + 1, odd(1000 + k), np.uint64)
    for i in range(k):
        out += hashes[i : len(hashes) - k + 1 + i] * odd(i)
    return np.unique(mix(out))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def id_bits(ids: DataFrame, col: str, words: int = FILTER_WORDS) -> DataFrame:
    """One row with an array of ``words`` longs: the bits of the hashes of the ids. Its size is fixed."""
    spot = F.pmod(F.xxhash64(col), F.lit(words * 64))
    found = ids.select(spot.alias("s")).groupBy(F.expr("s div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("m"))
    every = ids.sparkSession.range(words).select(F.col("id").alias("w")).join(found, "w", "left").select("w", F.coalesce("m", F.lit(0)).cast("long").alias("m"))
    parts = every.groupBy(F.expr("w div 256").alias("p")).agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "m"))), lambda x: x["m"]).alias("m"))
    return parts.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("p", "m"))), lambda x: x["m"])).alias("all"))


def maybe_in(bits: DataFrame, col: str, words: int = FILTER_WORDS) -> Column:
    """True for every id that went into the bits, and for some others: it spares a shuffle, a join decides."""
    spot = F.pmod(F.xxhash64(col), F.lit(words * 64))
    word = F.get(bits.scalar(), (spot / 64).cast("int"))
    return F.getbit(word, (spot % 64).cast("int")) == 1


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph: (id, component), component the smallest id reachable.

    Alternates large-star and small-star steps until the edges stand still. The minima of the neighbourhoods are
    aggregated with partial sums on the map side and written before they are joined, so that a vertex with very
    many neighbours is a skewed join, which adaptive execution splits, and no task sees a whole neighbourhood.
    Isolated vertices are not in the result. Nulls and loops are ignored.
    """

    def star(both: DataFrame, keep: Column) -> DataFrame:
        low = scratch.cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        out = both.join(low, "u")
        made = out.filter(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))
        return made, low

    now = scratch.cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    state = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large, low1 = star(both, F.col("v") > F.col("u"))
        large = scratch.cut(large.distinct())
        low2 = scratch.cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low2, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.cut(small.union(low2.select("u", F.col("m").alias("v"))).distinct())
        scratch.drop(now, low1, large, low2)
        now = after
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(new) == state:
            break
        state = tuple(new)
    roots = now.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
