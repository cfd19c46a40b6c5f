"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact verification.

A document is the set of its distinct word n-grams. Two documents link when their Jaccard similarity is at least
``percent`` / 100. Every link is found, at any size:

1. *Tiles.* Sizes fall into bands whose ratio is the threshold, so linked sets lie in the same band or in
   neighbouring ones. Linked sets of a band differ in at most H elements. Elements are dealt by hash into more than
   H parts, so at least one part holds the same elements in both: (band, part, elements of the part) is a tile, and
   linked sets share one. Parts that are empty say nothing; a set with too many of them is dealt once more with
   other hashes, which keeps the guarantee.
2. *Stars.* The members of a tile are compared with its smallest member only. A group of thousands of near copies
   costs a comparison for each member, not for each pair.
   Equal sets are linked by their digests, to the smallest id of each.
3. *Open tiles.* Tiles whose members are not yet all in one component, one of those with the same members, are
   walked in blocks. The bit counts of two
   bitmaps bound the overlap from above; pairs that may still reach the threshold, and only those, are emitted.
4. *Exact check* by intersecting the sorted arrays; links then become components.

Sets are 64-bit hashes of n-grams; equal sets are recognised by two 64-bit digests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from .common import Scratch, WordHash, components, id_bits, maybe_in, mix, odd, read, released, shingle_set, signed

#: Times a set is dealt with other hashes before its empty parts become tiles too.
DEALS = 8
#: Pairs, or digests of texts, that a task remembers, not to emit them again.
REMEMBERED = 500_000
#: Rows of one block of an open tile.
BLOCK = 2048
#: Words of 64 bits in the filter over the sets of the pairs that are checked.
FILTER = 1 << 17
#: Bits of the filter that prunes the texts read again for verification. It has a fixed size, and a join decides.
PRUNE_BITS = 1 << 23

SIGNED = "doc_id long, n long, d1 long, d2 long, copy_of long, bits binary, tiles array<long>"


class Bands:
    """Bands of set sizes for a threshold in percent, and the parts of each band."""

    def __init__(self, percent: int):
        if not 0 < percent <= 100:
            raise ValueError("percent must lie in 1..100")
        self.percent, self.low = percent, [1]

    def of(self, n: int) -> int:
        while self.low[-1] <= n:
            self.low.append(max(self.low[-1] + 1, self.low[-1] * 100 // self.percent + 1))
        return int(np.searchsorted(self.low, n, side="right")) - 1

    def parts(self, band: int) -> tuple[int, int]:
        """Parts of a band, and how many of them may be empty in a set."""
        while len(self.low) < band + 2:
            self.of(self.low[-1])
        apart = (self.low[band + 1] - 1) * (100 - self.percent) // self.percent
        return apart + 1 + apart // 16, apart // 16


def tiles(values: np.ndarray, bands: Bands) -> np.ndarray:
    """Keys of all tiles of a sorted set."""
    if not len(values):
        return values
    own, out, inner = bands.of(len(values)), [], mix(values ^ odd(77))
    for band in range(max(0, own - 1), own + 1):
        n, spare = bands.parts(band)
        for deal in range(DEALS):
            part = ((values * odd(200 + deal)) >> np.uint64(33)) % np.uint64(n)
            part = part.astype(np.int64)
            total = np.zeros(n, np.uint64)
            np.add.at(total, part, inner)
            full = np.bincount(part, minlength=n) > 0
            enough = n - int(full.sum()) <= spare
            last = deal == DEALS - 1 and not enough
            j = np.arange(n, dtype=np.uint64) if last else np.flatnonzero(full).astype(np.uint64)
            tag = np.uint64((band * DEALS + deal) << 34)
            out.append(mix(total[j.astype(np.int64)] + mix(j + tag + np.uint64(1))))
            if enough:
                break
    return np.unique(np.concatenate(out))


def bitmap(values: np.ndarray) -> bytes:
    """Presence bits: a power of two of them, four to eight for each element."""
    if not len(values):
        return b""
    size = 1 << max(6, int(4 * len(values) - 1).bit_length())
    where = (values & np.uint64(size - 1)).astype(np.int64)
    flags = np.zeros(size, bool)
    flags[where] = True
    return np.packbits(flags).tobytes()


def fold(bits: np.ndarray, size: int) -> np.ndarray:
    """The bitmap at a smaller power of two."""
    while len(bits) > size:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def most_common(n1: int, bits1: bytes, n2: int, bits2: bytes) -> int:
    """An upper bound of the overlap of two sets: each bit of one that the other lacks is an element it lacks."""
    x, y = np.frombuffer(bits1, np.uint8), np.frombuffer(bits2, np.uint8)
    x, y = fold(x, len(y)), fold(y, len(x))
    return min(n1 - int(np.bitwise_count(x & ~y).sum()), n2 - int(np.bitwise_count(y & ~x).sum()))


def linked(common: int, n1: int, n2: int, percent: int) -> bool:
    return 100 * common >= percent * (n1 + n2 - common)


def _words(text: str) -> list[bytes]:
    # bytes.lower() changes A-Z alone, and bytes.split() splits at 0x20 and 0x09-0x0D
    return text.encode().lower().split()


def _sign(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bands, seen = WordHash(), Bands(percent), {}
        for batch in batches:
            rows = []
            if len(seen) > REMEMBERED:
                seen.clear()  # later copies have signatures of their own, and equal sets are linked all the same
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                split = _words(text.as_py()) if text.is_valid else []
                digest = xxhash.xxh3_128_digest(b" ".join(split)) if split else None
                values = shingle_set(words.of(split), n)
                d = signed(np.array([mix(values).sum(), mix(values ^ odd(99)).sum()], np.uint64))
                first = seen.setdefault(digest, doc) if split and doc is not None else doc
                lone = first is not None and first == doc and len(values) and seen.get((digest, 0)) is None
                if lone:
                    seen[digest, 0] = True
                rows.append((doc, len(values), int(d[0]), int(d[1]), first, bitmap(values) if lone else b"", signed(tiles(values, bands)) if lone else []))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())), strict=True)], names=["doc_id", "n", "d1", "d2", "copy_of", "bits", "tiles"])

    return run


def _bounded(percent: int):
    """Of pairs with both bitmaps, those that may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n1, n2, x, y = (batch.column(k).to_pylist() for k in ("a", "b", "n1", "n2", "x", "y"))
            keep = [i for i in range(len(a)) if linked(most_common(n1[i], x[i], n2[i], y[i]), n1[i], n2[i], percent)]
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], names=["a", "b"])

    return run


def _pairs_of_tile(ids, comp, size, bits, block, i: int, j: int, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs across components that the bit counts leave open, between the rows of blocks i and j."""
    ids, comp, size, block = (np.array(x) for x in (ids, comp, size, block))
    width = min(map(len, bits))
    rows = np.stack([fold(np.frombuffer(b, np.uint8), width) for b in bits])
    ones = np.bitwise_count(rows).sum(axis=1, dtype=np.int64)
    second = np.flatnonzero(block == j)
    for k in np.flatnonzero(block == i):
        near = second[second > k] if i == j else second
        n1, n2 = size[k], size[near]
        near = near[(comp[near] != comp[k]) & (ids[near] != ids[k]) & (100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2))]
        if not len(near):
            continue
        both = np.bitwise_count(rows[k] & rows[near]).sum(axis=1, dtype=np.int64)
        n2 = size[near]
        most = np.minimum(n1 - (ones[k] - both), n2 - (ones[near] - both))
        near = near[100 * most >= percent * (n1 + n2 - most)]
        if len(near):
            other = ids[near]
            yield np.minimum(other, ids[k]), np.maximum(other, ids[k])


def _open(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("id", "component", "n", "bits", "block")
        key, held, told = None, {k: [] for k in names}, set()

        def done():
            if held["id"]:
                for a, b in _pairs_of_tile(*held.values(), key[1], key[2], percent):
                    new = [p for p in zip(a.tolist(), b.tolist(), strict=True) if p not in told]
                    if len(told) > REMEMBERED:
                        told.clear()
                    told.update(new)
                    a, b = ([p[k] for p in new] for k in (0, 1))
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            for x in held.values():
                x.clear()

        for batch in batches:
            cols = {k: batch.column(k).to_pylist() for k in (*names, "tile", "i", "j")}
            for r in range(batch.num_rows):
                this = (cols["tile"][r], cols["i"][r], cols["j"][r])
                if this != key:
                    yield from done()
                    key = this
                for k in names:
                    held[k].append(cols[k][r])
        yield from done()

    return run


def _sets(n: int, prune: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bits = WordHash(), prune
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            spot = batch.column(2).to_numpy(zero_copy_only=False)
            keep = np.flatnonzero((bits[spot >> 3] >> (spot & 7)) & 1)
            made = [signed(shingle_set(words.of(_words(batch.column(1)[int(i)].as_py())), n)) for i in keep]
            yield pa.RecordBatch.from_arrays([pa.array(ids[keep], pa.int64()), pa.array(made, pa.list_(pa.int64()))], names=["id", "items"])

    return run


def _exact(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(k) for k in ("a", "b", "x", "y"))
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                p, q = x[i].values.to_numpy(), y[i].values.to_numpy()
                p, q = (p, q) if len(p) <= len(q) else (q, p)
                at = np.searchsorted(q.view(np.uint64), p.view(np.uint64))
                at[at == len(q)] = len(q) - 1
                keep[i] = linked(int((q[at] == p).sum()), len(p), len(q), percent)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in (a, b)], names=["a", "b"])

    return run


def _sets_of(ids: DataFrame, docs: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """(id, items) of the documents whose ids are in the one column of ids, and of some others."""
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(PRUNE_BITS))
    wanted = ids.toDF("doc_id").select(spot.alias("s"))
    rows = wanted.groupBy(F.expr("s div 32").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 32 as int))")).alias("m")).collect()  # at most PRUNE_BITS / 32
    prune = np.zeros(PRUNE_BITS // 32, np.uint32)
    for r in rows:
        prune[r.w] = r.m
    texts = docs.filter("text is not null and doc_id is not null").select("doc_id", "text", spot.alias("spot"))
    return scratch.cut(texts.mapInArrow(released(_sets(n, prune.view(np.uint8))), "id long, items array<long>"))


def _verified(pairs: DataFrame, sets: DataFrame | None, docs: DataFrame, meta: DataFrame, n: int, percent: int, scratch: Scratch) -> DataFrame:
    """Those of the pairs (a, b) that link; without sets, those needed are read from docs."""
    # bitmaps of sets that are in no pair stay out of the shuffles; the joins decide
    bits = scratch.cut(id_bits(pairs.select(F.explode(F.array("a", "b")).alias("id")), "id", FILTER))
    meta = meta.filter(maybe_in(bits, "doc_id", FILTER))
    side = lambda c, *names: meta.select(F.col("doc_id").alias(c), *(F.col(x).alias(y) for x, y in zip(("n", "d1", "d2", "bits"), names, strict=True)))
    met = pairs.join(side("b", "n2", "e1", "e2", "y"), "b").join(side("a", "n1", "d1", "d2", "x"), "a")
    same = "n1 = n2 and d1 = e1 and d2 = e2"
    met = met.filter(f"100 * least(n1, n2) >= {percent} * greatest(n1, n2)")
    equal = scratch.cut(met.filter(same).select("a", "b"))
    left = scratch.cut(met.filter(f"not ({same})").select("a", "b", "n1", "n2", "x", "y").mapInArrow(released(_bounded(percent)), "a long, b long"))
    if sets is None:
        sets = _sets_of(left.select("a").union(left.select("b")), docs, n, scratch)
    two = left.join(sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b").join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a")
    return equal.union(scratch.cut(two.mapInArrow(released(_exact(percent)), "a long, b long")))


def _still_open(members: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """Members of the tiles that hold more than one component: (tile, id, component)."""
    held = members.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    held = held.withColumns({"lo": F.expr("min(component) over (partition by tile)"), "hi": F.expr("max(component) over (partition by tile)")})
    return scratch.cut(held.filter("lo <> hi").select("tile", "id", "component"))


def ngram_jaccard_join(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of near-duplicate documents: (doc_id, n_shingles, component_id), a row for each input row.

    ``doc_id`` must be an integer. component_id is the smallest id reachable by links, the row's own included.
    Null and empty texts have no shingles and stand alone, texts of fewer than n words are one shingle. Rows that
    repeat an id are one vertex, with the links of all of them. A null id gets a null component. An empty table
    gives an empty result. Further columns are not looked at.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    meta = scratch.cut(docs.mapInArrow(released(_sign(n, percent)), SIGNED))
    lone = meta.filter("octet_length(bits) > 0")
    per = W.partitionBy("tile")
    members = lone.select(F.explode("tiles").alias("tile"), F.col("doc_id").alias("id"))
    members = members.withColumns({"leader": F.min("id").over(per), "size": F.count("*").over(per), "whole": F.bit_xor(F.xxhash64("id")).over(per)}).filter("size > 1")
    members = scratch.cut(members)
    scratch.sweep()  # the shuffle of all tiles is the largest
    stars = scratch.cut(members.filter("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct())
    copies = meta.filter("copy_of <> doc_id").select(F.col("copy_of").alias("a"), F.col("doc_id").alias("b"))
    # equal sets of several tasks, or of texts that differ: stars may miss them, if all tiles have leaders of other sets
    firsts = lone.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("a"), F.count("*").alias("rows")).filter("rows > 1").drop("rows")
    equal = lone.select("n", "d1", "d2", F.col("doc_id").alias("b")).join(firsts, ["n", "d1", "d2"]).filter("a <> b").select("a", "b")
    links = _verified(stars, None, docs, lone, n, percent, scratch).union(copies).union(equal)
    found = scratch.cut(components(links, scratch))
    # tiles of two are settled; the sets of all documents in the others are fetched once
    crowd = members.filter("size > 2")
    # of the tiles with the same members one is enough
    alike = crowd.filter("id = leader").groupBy("leader", "size", "whole").agg(F.min("tile").alias("tile")).select("tile")
    held = _still_open(crowd.select("tile", "id").join(alike, "tile"), found, scratch)
    sets = _sets_of(held.select("id"), docs, n, scratch)

    def merge(found: DataFrame, links: DataFrame) -> DataFrame:
        old = found.filter("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))
        return scratch.cut(components(old.union(links), scratch))

    # equal sets are in one component by the links above, so one of them stands for all
    held = held.join(lone.select(F.col("doc_id").alias("id"), "n", "d1", "d2"), "id")
    held = held.groupBy("tile", "n", "d1", "d2").agg(F.min("id").alias("id"), F.min("component").alias("component"))
    held = held.withColumns({"size": F.count("*").over(per), "lead": F.min("id").over(per), "block": F.expr(f"cast((row_number() over (partition by tile order by id) - 1) div {BLOCK} as int)")})
    held = held.select("tile", "lead", "id", "component", "block", F.explode(F.expr(f"sequence(0, cast((size - 1) div {BLOCK} as int))")).alias("other"))
    held = held.select("tile", "lead", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "component", "block")
    held = held.join(lone.select(F.col("doc_id").alias("id"), "n", "bits"), "id")
    # tiles with the same first member meet in a few tasks, which then emit a pair once
    held = held.repartition("lead", F.pmod("tile", F.lit(8)), "i", "j").sortWithinPartitions("tile", "i", "j", "id")
    more = scratch.cut(held.mapInArrow(released(_open(percent)), "a long, b long").distinct())
    found = merge(found, _verified(more, sets, docs, lone, n, percent, scratch))
    out = meta.select("doc_id", F.col("n").alias("n_shingles")).join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return scratch.last(out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every whole text, sets of 4-word shingles, links from 85 percent on."""
    return ngram_jaccard_join(read(spark, sf_dir, "documents"), n=4, percent=85)


def brute_force(rows: list[tuple[int, str | None]], n: int, percent: int) -> list[tuple[int, int, int]]:
    """The contract over a few rows, for tests: (doc_id, n_shingles, component_id)."""
    sets = []
    for _, text in rows:
        w = _words(text) if text is not None else []
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    up = {d: d for d, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (d, _) in enumerate(rows):
        for j in range(i):
            if sets[i] and sets[j] and linked(len(sets[i] & sets[j]), len(sets[i]), len(sets[j]), percent):
                p, q = root(d), root(rows[j][0])
                up[max(p, q)] = min(p, q)
    return [(d, len(s), root(d)) for (d, _), s in zip(rows, sets, strict=True)]
