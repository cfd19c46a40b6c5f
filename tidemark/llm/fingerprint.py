"""Document fingerprints of improbable features.

Every window of 64 bytes of a text is a candidate; so is every window of 16 bytes of a text of less than 2048 bytes,
in a digest of its own, for what short texts share is short. A window's entropy is put on a scale of 0 to 1000, and
the corpus, in which all these windows of all texts are counted, tells how common each value is. A window is a feature when
it has the rarest value, and is the first such, in at least a quarter of the runs of neighbouring windows that hold it;
so the features of a passage depend on the passage and what stands close to it. Windows of next to no entropy
(repeated bytes) are none. Features go into Bloom filters of 2048 bits, a new one after 160 features, in the order of
the text. Two fingerprints are compared by the bits that their filters share, normalised by what chance and the smaller
filter allow.

Texts are looked at in parts of a bounded number of bytes with the windows around them, which gives the same features.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import bound_batches, mix, odd, read, released

#: Bytes of a window; neighbouring windows in a run; runs in which a feature must be the rarest; texts of how many
#: bytes and more have no digest of such windows (0: all have one).
SCALES = ((64, 64, 16, 0), (16, 16, 4, 2048))
#: Values of the entropy scale, and the least that a feature has.
SCALE, LEAST = 1000, 100
FILTER_BYTES, FILTER_FEATURES, PROBES = 256, 160, 5
#: Bytes of text in one bucket of the order by id: a part of FEW of all text, but no less than the first, and no more
#: than the second, whatever there is. A bucket is read in batches.
BUCKET_BYTES, MOST_BYTES, FEW = 8 << 20, 1 << 30, 4096
#: Rows of one range in which the bounds of buckets are found.
RANGE_ROWS = 1 << 20
#: Bytes that are looked at together.
PART = 1 << 16
#: A rank behind all others, of windows that are no features.
_NEVER = SCALE + 1


def _cost(width: int) -> np.ndarray:
    """c * log2(c) in whole parts, so that sums do not depend on their order."""
    c = np.arange(width + 1)
    return np.rint(c * np.log2(np.maximum(c, 1)) * (1 << 20)).astype(np.int64)


_COSTS = {scale[0]: _cost(scale[0]) for scale in SCALES}
_ODDS = np.array([odd(20 + k) for k in range(8)], np.uint64)


def entropies(raw: np.ndarray, width: int) -> np.ndarray:
    """The entropy, on the scale, of the window that starts at each byte but the last width - 1.

    A window differs from the one before by a byte that leaves and one that comes; how often each of them occurs in
    its window follows from comparing the bytes with those at every distance below the width.
    """
    n = len(raw) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    ahead, back = np.ones(len(raw), np.uint8), np.ones(len(raw), np.uint8)
    for d in range(1, width):
        same = (raw[:-d] == raw[d:]).view(np.uint8)
        ahead[:-d] += same
        back[d:] += same
    cost = _COSTS[width]
    gone, come = ahead[: n - 1], back[width:]  # of windows 0..n-2 the first byte, of windows 1..n-1 the last
    total = np.empty(n, np.int64)
    total[0] = cost[np.bincount(raw[:width], minlength=1)].sum()
    total[1:] = cost[gone - np.uint8(1)] - cost[gone] + cost[come] - cost[come - np.uint8(1)]
    np.cumsum(total, out=total)
    most = np.log2(width)
    return np.clip(np.rint((most - total / (width << 20)) * (SCALE / most)), 0, SCALE).astype(np.int64)


def ranks_of(counts: np.ndarray) -> np.ndarray:
    """The rank of each value of the scale, the rarest first; ties in the order of the values."""
    out = np.empty(len(counts), np.int64)
    out[np.lexsort((np.arange(len(counts)), counts))] = np.arange(len(counts))
    out[:LEAST] = _NEVER
    return out


def _joined(raws: list[bytes]) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Texts in groups of about PART bytes, longer ones alone: (first, past, the bytes together, their ends)."""
    first, size = 0, 0
    for i, raw in enumerate(raws):
        if size and size + len(raw) > PART:
            yield first, i, b"".join(raws[first:i]), np.cumsum([len(x) for x in raws[first:i]])
            first, size = i, 0
        size += len(raw)
    if first < len(raws):
        yield first, len(raws), b"".join(raws[first:]), np.cumsum([len(x) for x in raws[first:]])


def _stretches(n: int, before: int, after: int) -> Iterator[tuple[int, int, int, int]]:
    """(from, past, first, last): bytes first..last are to be read for what starts at from..past."""
    for a in range(0, max(n, 1), PART):
        b = min(n, a + PART)
        yield a, b, max(0, a - before), min(n, b + after)


def _room(ends: np.ndarray) -> np.ndarray:
    """How many bytes of its text begin at each byte of texts that lie one after another."""
    return np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(ends[-1] if len(ends) else 0)


def count_values(raws: list[bytes], width: int, counts: np.ndarray) -> None:
    """Adds the windows of all texts to the counts of their values."""
    for _, _, raw, ends in _joined(raws):
        data, room = np.frombuffer(raw, np.uint8), _room(ends)
        for a, b, first, last in _stretches(len(data), 0, width - 1):
            values = entropies(data[first:last], width)[: b - a]
            counts += np.bincount(values[room[first : first + len(values)] >= width], minlength=SCALE + 1)


def _chosen(data: np.ndarray, ends: np.ndarray, ranks: np.ndarray, width: int, run: int, least: int) -> np.ndarray:
    """Positions of the features of texts that lie one after another, in order."""
    out, room = [], _room(ends)
    for a, b, first, last in _stretches(len(data), run - 1, run + width - 2):
        values = entropies(data[first:last], width)
        if not len(values):
            continue
        left = room[first : first + len(values)]
        rank = np.where(left >= width, ranks[values], _NEVER)
        key = (rank << 32) + np.arange(len(rank))
        votes = np.zeros(len(rank), np.int64)
        if len(key) >= run:
            low, n = key, 1
            while n < run:  # the least key of n neighbours, doubled until n is the run
                step = min(n, run - n)
                low = np.minimum(low[: len(low) - step], low[step:])
                n += step
            inside = left[: len(low)] >= width + run - 1
            votes = np.bincount(low[inside] & 0xFFFFFFFF, minlength=len(rank))
        picked = np.flatnonzero((votes >= least) & (rank < _NEVER)) + first
        out.append(picked[(picked >= a) & (picked < b)])
    # texts with fewer windows than a run has: the rarest is the feature
    begins = np.concatenate(([0], ends[:-1]))
    few = np.flatnonzero((ends - begins >= width) & (ends - begins < width + run - 1))
    for i in few.tolist():
        values = ranks[entropies(data[begins[i] : ends[i]], width)]
        k = int(values.argmin())
        if values[k] < _NEVER:
            out.append(np.array([begins[i] + k]))
    return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)


def _hashed(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """A hash of each window."""
    if not len(at):
        return np.zeros(0, np.uint64)
    rows = np.lib.stride_tricks.sliding_window_view(data, width)[at]
    return mix((rows.view("<u8") * _ODDS[: width // 8]).sum(axis=1) + np.uint64(width))


def _digest(hashes: np.ndarray) -> bytes:
    """Chained filters, each after a byte with its number of features."""
    _, first = np.unique(hashes, return_index=True)
    hashes, out = hashes[np.sort(first)], []
    for i in range(0, len(hashes), FILTER_FEATURES):
        part = hashes[i : i + FILTER_FEATURES]
        flags = np.zeros(8 * FILTER_BYTES, bool)
        for k in range(PROBES):
            flags[((part >> np.uint64(11 * k)) & np.uint64(8 * FILTER_BYTES - 1)).astype(np.int64)] = True
        out.append(bytes([len(part)]) + np.packbits(flags).tobytes())
    return b"".join(out)


def fingerprints(raws: list[bytes], ranks: dict[int, np.ndarray]) -> list[bytes]:
    """Of each text its digests, each after the width of its windows and its length; empty for an empty text.

    A text without features is one feature as a whole, in a digest of width 0.
    """
    out = [[] for _ in raws]
    for width, run, least, below in SCALES:
        which = [i for i, raw in enumerate(raws) if len(raw) >= width and not (below and len(raw) >= below)]
        for first, past, raw, ends in _joined([raws[i] for i in which]):
            data = np.frombuffer(raw, np.uint8)
            at = _chosen(data, ends, ranks[width], width, run, least)
            hashes = _hashed(data, at, width)
            edges = np.concatenate(([0], np.searchsorted(at, ends)))
            for k in range(past - first):
                if edges[k + 1] > edges[k]:
                    made = _digest(hashes[edges[k] : edges[k + 1]])
                    out[which[first + k]].append(struct.pack(">BI", width, len(made)) + made)
    for i, raw in enumerate(raws):
        if raw and not out[i]:
            made = _digest(np.frombuffer(hashlib.blake2b(raw, digest_size=8).digest(), np.uint64))
            out[i].append(struct.pack(">BI", 0, len(made)) + made)
    return [b"".join(x) for x in out]


def digests_of(fingerprint: bytes) -> dict[int, np.ndarray]:
    """The filters by width of window, a row for each, after its number of features."""
    out, at = {}, 0
    while at < len(fingerprint):
        width, size = struct.unpack_from(">BI", fingerprint, at)
        out[width] = np.frombuffer(fingerprint, np.uint8, size, at + 5).reshape(-1, FILTER_BYTES + 1)
        at += 5 + size
    return out


def _overlap(x: np.ndarray, y: np.ndarray) -> float:
    """The mean, over the filters of x by their features, of the best normalised overlap with a filter of y."""
    weight = x[:, 0].astype(float)
    ones = np.bitwise_count(y[:, 1:]).sum(axis=1).astype(float)
    best = np.zeros(len(x))
    for i in range(len(x)):
        own = float(np.bitwise_count(x[i, 1:]).sum())
        both = np.bitwise_count(x[i, 1:] & y[:, 1:]).sum(axis=1).astype(float)
        share = ones / (8 * FILTER_BYTES)
        # what chance gives the best of so many filters, so that a few features do not look alike
        chance = own * share + (2 + np.sqrt(2 * np.log(len(y)))) * np.sqrt(own * share * (1 - share))
        room = np.minimum(own, ones) - chance
        best[i] = np.where(room > 0, np.clip((both - chance) / np.maximum(room, 1e-9), 0, 1), 0.0).max()
    return float((best * weight).sum() / weight.sum())


def likeness(a: bytes, b: bytes) -> float:
    """0 to 1: the overlap of the shorter chain with the other, over the widths that both have, by their features."""
    if a == b:
        return 1.0
    p, q = digests_of(a), digests_of(b)
    total = weight = 0.0
    for width in p.keys() & q.keys():
        x, y = sorted((p[width], q[width]), key=lambda v: (len(v), int(v[:, 0].sum()), v.tobytes()))
        n = float(x[:, 0].sum())
        total, weight = total + n * _overlap(x, y), weight + n
    return total / weight if weight else 0.0


def corpus_ranks(docs: DataFrame, text_col: str = "text") -> dict[int, np.ndarray]:
    """For each width, the ranks of the values of the scale, from all windows of all texts."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {scale[0]: np.zeros(SCALE + 1, np.int64) for scale in SCALES}
        for batch in batches:
            raws = [t.as_py().encode() for t in batch.column(0) if t.is_valid]
            for width, _, _, below in SCALES:
                count_values([x for x in raws if not below or len(x) < below], width, counts[width])
        width = np.repeat(list(counts), SCALE + 1)
        yield pa.RecordBatch.from_arrays([pa.array(width, pa.int32()), pa.array(np.tile(np.arange(SCALE + 1), len(counts)), pa.int32()), pa.array(np.concatenate(list(counts.values())))], names=["width", "value", "n"])

    rows = docs.select(text_col).mapInArrow(released(run), "width int, value int, n long").groupBy("width", "value").agg(F.sum("n").alias("n")).collect()  # one row for each width and value
    counts = {scale[0]: np.zeros(SCALE + 1, np.int64) for scale in SCALES}
    for r in rows:
        counts[r.width][r.value] = r.n
    return {width: ranks_of(n) for width, n in counts.items()}


def edited(text: str, following: str) -> str:
    """The text with its last floor(n/2) characters replaced by the first as many of the other."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _place() -> Column:
    """The order of documents: by descending id, null ids last, equal ids by a hash of their texts."""
    return F.struct(F.col("doc_id").isNull().alias("a"), F.bitwise_not("doc_id").alias("b"), F.xxhash64("text").alias("c"))


def _bounds(docs: DataFrame) -> list[tuple]:
    """The places at which buckets begin, in order; the first bucket begins before all of them.

    The bytes of equal places are summed first, then ranges of places are walked, each in a task of its own, and cut
    into stretches; neighbouring stretches that fit into a bucket together, of whatever ranges, share it. A bucket has
    the bytes of its room at most and one document more; only rows that are equal in id and text are never parted.
    There are at most two buckets for each BUCKET_BYTES up to FEW times that, and for each MOST_BYTES beyond.
    """
    total = docs.agg(F.sum(F.octet_length("text")).alias("size"), F.count("*").alias("n")).first()
    room = min(MOST_BYTES, max(BUCKET_BYTES, (total["size"] or 0) // FEW))
    if (total["size"] or 0) <= room:
        return []

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled, place, since = 0, None, 0  # bytes up to here; where the stretch begins, and the bytes before it
        for batch in batches:
            ends = filled + np.cumsum(batch.column(3).to_numpy())
            out = []
            for k in np.flatnonzero(np.diff(ends // room, prepend=-1 if place is None else filled // room)).tolist():
                before = int(ends[k - 1]) if k else filled
                if place is not None:
                    out.append((*place, before - since))
                place, since = tuple(batch.column(c)[k].as_py() for c in range(3)), before
            filled = int(ends[-1]) if len(ends) else filled
            yield stretches(out)
        if place is not None:
            yield stretches([(*place, filled - since)])

    def stretches(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["a", "b", "c", "bytes"])

    sized = docs.groupBy(_place().alias("place")).agg(F.sum(F.octet_length("text")).cast("long").alias("bytes")).select("place.*", "bytes")
    ranged = sized.repartitionByRange(total["n"] // RANGE_ROWS + 1, "a", "b", "c").sortWithinPartitions("a", "b", "c")
    rows = ranged.mapInArrow(released(walk), "a boolean, b bigint, c bigint, bytes bigint").collect()  # one for each range and bucket
    bounds, held = [], 0
    for r in sorted(rows, key=lambda r: (r.a, r.b or 0, r.c)):
        if held and held + r.bytes > room:
            bounds.append((r.a, r.b, r.c))
            held = 0
        held += r.bytes
    return bounds


def _dealt(docs: DataFrame, bounds: list[tuple]) -> DataFrame:
    """The documents with their place and bucket: how many of the bounds are not behind the place.

    It is looked for among every step-th of the bounds first, then in one step.
    """
    docs = docs.withColumn("place", _place())
    if not bounds:
        return docs.withColumn("bucket", F.lit(0))
    step = max(1, int(len(bounds) ** 0.5))
    kind = "array<struct<a:boolean,b:bigint,c:bigint>>"
    table = docs.sparkSession.createDataFrame([(bounds[::step], bounds)], f"heads {kind}, bounds {kind}")
    upto = lambda xs: F.size(F.filter(xs, lambda x: x <= F.col("place")))
    docs = docs.withColumns({"heads": table.select("heads").scalar(), "bounds": table.select("bounds").scalar()}).withColumn("block", upto(F.col("heads")))
    inside = upto(F.slice("bounds", F.greatest(F.col("block") - 1, F.lit(0)) * step + 1, F.lit(step)))
    return docs.withColumn("bucket", F.when(F.col("block") == 0, 0).otherwise((F.col("block") - 1) * step + inside)).drop("heads", "bounds", "block")


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of all texts, of their edited forms, and their likeness to the next document.

    The next document is that of the next smaller id; after the last comes the first. Null ids come last, equal ids
    in the order of a hash of their texts; rows equal in both are next to each other. A null text counts as empty, and
    an empty text has an empty fingerprint, which is like other empty ones only. Documents are dealt into buckets of
    the order by id, of a bounded number of bytes; a copy of each bucket's first document goes to the bucket before it.
    Columns other than the two are not looked at.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ranks = corpus_ranks(docs)
    bounds = _bounds(docs)
    rows = _dealt(docs, bounds)
    firsts = sorted((r.bucket, r.first.a, r.first.b, r.first.c) for r in rows.groupBy("bucket").agg(F.min("place").alias("first")).collect())  # one for each bucket
    guests = [(*firsts[i][1:], firsts[i - 1][0]) for i in range(len(firsts))]
    guests = spark.createDataFrame(guests, "a boolean, b long, c long, other int")
    near = (F.col("place.a") == F.col("a")) & F.col("place.b").eqNullSafe(F.col("b")) & (F.col("place.c") == F.col("c"))
    rows = rows.join(F.broadcast(guests), near, "left")  # one row for each bucket
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("other").alias("bucket"), F.lit(True).alias("guest"))
    rows = rows.withColumn("to", F.explode(F.when(F.col("other").isNull(), F.array(own)).otherwise(F.array(own, guest))))
    rows = rows.select("doc_id", "text", "to.bucket", "to.guest")
    rows = rows.repartitionById(len(bounds) + 1, F.col("bucket").cast("int")).sortWithinPartitions("bucket", "guest", F.desc_nulls_last("doc_id"), F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = lambda v: base64.b64encode(v).decode()
        before = None  # the last document, with its fingerprint
        for batch in batches:
            texts = batch.column(1).to_pylist()
            made = fingerprints([t.encode() for t in texts], ranks)
            pairs = []
            for doc, text, mark, guest in zip(batch.column(0).to_pylist(), texts, made, batch.column(3).to_pylist(), strict=True):
                if guest and before is None:
                    continue  # a copy of an equal row: the first guest has been used
                if before is not None:
                    pairs.append((before, (doc, text, mark)))
                before = None if guest else (doc, text, mark)
            new = [edited(a[1], b[1]).encode() for a, b in pairs]
            marks = fingerprints(new, ranks)
            out = [(a[0], len(a[1]), hashlib.sha256(x).hexdigest(), code(a[2]), code(m), likeness(a[2], m), likeness(a[2], b[2])) for (a, b), x, m in zip(pairs, new, marks, strict=True)]
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            cols = list(zip(*out, strict=True)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[f.split()[0] for f in _OUT.split(", ")])

    return rows.mapInArrow(released(run), _OUT)


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text and its edited form, and their likeness."""
    return fingerprint_documents(read(spark, sf_dir, "documents").select("doc_id", "text"))
