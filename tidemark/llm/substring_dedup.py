"""Substring dedup by MinHash banding of paragraphs.

A paragraph is a sentence or line of at least ``min_words`` words with the short ones after it, several short ones in
a row, or a stretch of a long sentence between words that a hash picks; so a passage that sits in the middle of
another text is cut as it is elsewhere. Each is a set of word n-grams. Equal paragraphs meet by their digest. For
others, bands of MinHash values are tuned so that a pair at the threshold shares one with the wanted recall; those that
collide are compared with the smallest of their band and with the one before, the exact Jaccard similarity decides,
and links become components. Bands that then hold several components are walked in blocks, all members across
components.

Paragraphs whose component occurs in several documents form runs with their neighbours. A run goes on, word by word,
into the paragraphs beside it, as far as another run that begins (or ends) with the same component does the same.
Runs of at least ``min_run`` words count: single common sentences are no repeated passage. The first occurrence of a
component stays, the others are removed. What repeats inside a document alone is counted apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import Scratch, bound_batches, components, fresh, id_bits, maybe_in, mix, odd, read, released, signed
from .ngram_join import PRUNE_BITS, _exact

#: A sentence of more words is cut after words whose hash is a multiple of CUT.
LONG, CUT = 24, 12
_STOPS = (".", "!", "?")
#: Words of 64 bits in the filters over paragraphs.
FILTER = 1 << 17
#: Rows of one block of a band that is walked.
BLOCK = 2048
#: The chance with which a pair at the threshold must share a band, and the minima in a band.
RECALL, ROWS = 0.997, 2
#: Words beside a run into which it may go on; not less than the words that a run needs.
BESIDE = 64
#: Digests that a task remembers, not to emit the bands of a paragraph again.
REMEMBERED = 1 << 18


def tune_bands(percent: int, rows: int = ROWS, recall: float = RECALL) -> int:
    """The fewest bands of ``rows`` values for which a pair at the threshold collides with the wanted chance."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - (percent / 100) ** rows)))


class _StringHash(dict):
    """The hash of a word, its lowest bit set where the word ends a sentence; for long words, see word_hashes."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode()) & ~1 | (word[-1:] in _STOPS and word != "")
        return h


def word_hashes(data: bytes, raw: np.ndarray, first: np.ndarray, past: np.ndarray, hashes: _StringHash) -> np.ndarray:
    """The hashes of _StringHash of all words data[first:past], computed at once for words of up to 16 bytes (XXH3)."""
    size, out = past - first, np.zeros(len(first), np.uint64)
    u, m = np.uint64, np.uint64(0xFFFFFFFF)

    def number(at: np.ndarray, n: int) -> np.ndarray:
        # n bytes from each place, the first one lowest
        x = raw[at].astype(u)
        for i in range(1, n):
            x |= raw[at + i].astype(u) << u(8 * i)
        return x

    k = np.flatnonzero(size <= 3)
    a, n = first[k], size[k]
    x = raw[a].astype(u) << u(16) | raw[a + (n >> 1)].astype(u) << u(24) | raw[a + n - 1] | n.astype(u) << u(8)
    x ^= u(0x87275A9B)
    x = (x ^ x >> u(33)) * u(0xC2B2AE3D27D4EB4F)
    x = (x ^ x >> u(29)) * u(0x165667B19E3779F9)
    out[k] = x ^ x >> u(32)

    k = np.flatnonzero((size > 3) & (size <= 8))
    a, n = first[k], size[k]
    x = (number(a + n - 4, 4) + (number(a, 4) << u(32))) ^ u(0xC73AB174C5ECD5A2)
    x ^= (x << u(49) | x >> u(15)) ^ (x << u(24) | x >> u(40))
    x *= u(0x9FB21C651E98DF25)
    x ^= (x >> u(35)) + n.astype(u)
    x *= u(0x9FB21C651E98DF25)
    out[k] = x ^ x >> u(28)

    k = np.flatnonzero((size > 8) & (size <= 16))
    a, n = first[k], size[k]
    x, y = number(a, 8) ^ u(0x6782737BEA4239B9), number(a + n - 8, 8) ^ u(0xAF56BC3B0996523A)
    # both halves of the product of 128 bits
    low, mid, up = (x & m) * (y & m), (x & m) * (y >> u(32)), (x >> u(32)) * (y >> u(32))
    cross = (low >> u(32)) + (mid & m) + (x >> u(32)) * (y & m)
    fold = (cross << u(32) | low & m) ^ ((cross >> u(32)) + (mid >> u(32)) + up)
    x = n.astype(u) + x.byteswap() + y + fold
    x = (x ^ x >> u(37)) * u(0x165667919E3779F9)
    out[k] = x ^ x >> u(32)

    out = out & ~u(1) | np.isin(raw[past - 1], [ord(c) for c in _STOPS])
    for i in np.flatnonzero(size > 16).tolist():
        out[i] = hashes[data[first[i] : past[i]].decode()]
    return out


class Parsed:
    """Some texts as the words of all of them: hash, start and end in characters; and their paragraphs.

    Words stand between spaces and line ends. ``bounds`` are the places of each text's words, ``first`` and ``past``
    those of each paragraph, ``owner`` is a paragraph's text and ``number`` its place among the text's paragraphs.
    """

    def __init__(self, texts: list[str], hashes: _StringHash, min_words: int):
        coded = [t.encode() for t in texts]
        data = b"\n".join([*coded, b""])
        raw = np.frombuffer(data, np.uint8)
        opens = np.cumsum([0, *(len(x) + 1 for x in coded)])[:-1]  # the first byte of each text
        new_line = raw == 10
        apart = new_line | (raw == 32)
        edges = np.flatnonzero(np.diff(apart, prepend=True, append=True)) if len(raw) else np.zeros(0, np.int64)
        first, past = edges[::2], edges[1::2]  # the last byte stands between words, so edges come in pairs
        self.h = word_hashes(data, raw, first, past, hashes)
        self.text_of = np.searchsorted(opens, first, "right") - 1
        line = np.cumsum(new_line)[first]
        at = np.cumsum(raw & 0xC0 != 0x80)  # characters up to and with a byte
        base = at[opens[self.text_of]] if len(first) else at[:0]
        self.start, self.end = at[first] - base, at[past] - base
        self.bounds = np.searchsorted(self.text_of, np.arange(len(texts) + 1))
        last = np.concatenate((line[1:] != line[:-1], [True])) if len(line) else np.zeros(0, bool)
        ends = np.flatnonzero(last | (self.h & np.uint64(1) > 0)) + 1
        units = self._units(ends.tolist(), min_words)
        self.first = np.array([p for p, _ in units], np.int64)
        self.past = np.array([q for _, q in units], np.int64)
        self.owner = self.text_of[self.first] if len(units) else np.zeros(0, np.int64)
        opens = np.searchsorted(self.owner, np.arange(len(texts)))
        self.number = np.arange(len(units)) - opens[self.owner] if len(units) else np.zeros(0, np.int64)

    def _units(self, ends: list[int], min_words: int) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        breaks = set(self.bounds[1:].tolist())
        sentence = begin = low = 0  # the sentence, the first word in no paragraph yet, the text's first paragraph
        for end in ends:
            size = end - sentence
            if size >= min_words:
                if sentence > begin and len(out) > low:  # short ones go with the paragraph before them, if there is one
                    out[-1] = (out[-1][0], sentence)
                    begin = sentence
                if size > LONG:
                    for c in (sentence + 1 + np.flatnonzero(self.h[sentence : end - 1] % np.uint64(2 * CUT) < 2)).tolist():
                        if c - begin >= min_words and end - c >= min_words:
                            out.append((begin, c))
                            begin = c
                out.append((begin, end))
                begin = end
            elif end - begin >= min_words:  # enough short ones in a row
                out.append((begin, end))
                begin = end
            sentence = end
            if end in breaks:  # the text ends
                if begin < end and len(out) > low:
                    out[-1] = (out[-1][0], end)
                begin, low = end, len(out)
        return out

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each paragraph's words in their order."""
        if not len(self.first):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # every word belongs to one paragraph or none; edges come in pairs
        place = np.arange(len(self.h), dtype=np.uint64)
        owner = np.zeros(len(self.h), np.uint64)
        sizes = self.past - self.first
        inside = np.repeat(self.first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        owner[inside] = np.repeat(self.first, sizes).astype(np.uint64)
        value = mix(self.h + (place - owner) * odd(3))[inside]
        edges = np.cumsum(sizes) - sizes
        size = sizes.astype(np.uint64)
        one = mix(np.add.reduceat(value, edges) + size)
        two = mix(np.add.reduceat(value * odd(4) ^ (value >> np.uint64(31)), edges) + size * odd(5))
        return signed(one), signed(two)

    def shingles(self, n: int) -> np.ndarray:
        return _shingles(self.h, n)

    def band_keys(self, sh: np.ndarray, n: int, bands: int, rows: int) -> np.ndarray:
        """A row of band keys for each paragraph: hashes of ``rows`` minima over its shingles."""
        out = np.zeros((len(self.first), bands), np.uint64)
        if not len(out):
            return out
        edges = np.column_stack((self.first, self.past - n + 1)).ravel()
        # a last edge at the end of the array is left out: the last paragraph then runs to the end
        edges = edges[:-1] if edges[-1] == len(sh) else edges
        for k in range(bands):
            for r in range(rows):
                least = np.minimum.reduceat(sh * odd(500 + k * rows + r), edges)[::2]
                out[:, k] = mix(out[:, k] + least + np.uint64(k + 1))
        return out


def paragraphs(text: str, hashes: _StringHash, min_words: int) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """Word hashes of a text, and its paragraphs in order: first word, past word, start and end in characters."""
    p = Parsed([text], hashes, min_words)
    return p.h, [(a, b, int(p.start[a]), int(p.end[b - 1])) for a, b in zip(p.first.tolist(), p.past.tolist(), strict=True)]


def _shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words that start at each word but the last n-1."""
    out = np.full(max(0, len(h) - n + 1), odd(1000 + n), np.uint64)
    for i in range(n if len(out) else 0):
        out += h[i : len(h) - n + 1 + i] * odd(i)
    return mix(out)


_UNITS = "rid long, doc_id long, th long, total int, u int, n int, s int, e int, d long, d2 long, bands array<long>"


def _cut(n: int, bands: int, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = _StringHash(), set()
        for batch in batches:
            parsed = Parsed([t.as_py() if t.is_valid else "" for t in batch.column(3)], hashes, min_words)
            d, d2 = parsed.digests()
            keys = signed(parsed.band_keys(parsed.shingles(n), n, bands, ROWS))
            if len(seen) > REMEMBERED:
                seen.clear()
            new = np.zeros(len(d), bool)
            for i, x in enumerate(zip(d.tolist(), d2.tolist(), strict=True)):
                if x not in seen:
                    seen.add(x)
                    new[i] = True
            # texts without a paragraph have a row too
            bare = np.setdiff1d(np.arange(batch.num_rows), parsed.owner)
            owner = np.concatenate((parsed.owner, bare))
            total = np.bincount(parsed.owner, minlength=batch.num_rows)[owner]
            rest = np.zeros(len(bare), np.int64)
            take = pa.array(owner)
            ints = [np.concatenate((x, rest + y)).astype(np.int32) for x, y in ((parsed.number, -1), (parsed.past - parsed.first, 0), (parsed.start[parsed.first], 0), (parsed.end[parsed.past - 1], 0))]
            offsets = np.concatenate(([0], np.cumsum(np.concatenate((new, rest > 0)) * bands))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[new].ravel()), mask=pa.array(~np.concatenate((new, rest > 0))))
            cols = [*(batch.column(k).take(take) for k in range(3)), pa.array(total.astype(np.int32)), *map(pa.array, ints), pa.array(np.concatenate((d, rest))), pa.array(np.concatenate((d2, rest))), lists]
            yield pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in _UNITS.split(", ")])

    return run


def _wanted_sets(n: int, min_words: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, done, bits = _StringHash(), set(), shared.value
        for batch in batches:
            parsed = Parsed(batch.column(0).to_pylist(), hashes, min_words)
            d, d2 = parsed.digests()
            spot = d & (PRUNE_BITS - 1)
            sh, ids, sets = parsed.shingles(n), [], []
            if len(done) > REMEMBERED:
                done.clear()
            for i in np.flatnonzero((bits[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1).tolist():
                x = (int(d[i]), int(d2[i]))
                if x not in done:
                    done.add(x)
                    ids.append(x[0])
                    sets.append(signed(np.unique(sh[parsed.first[i] : parsed.past[i] - n + 1])))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["id", "items"])

    return run


def _links_of_blocks(ids, comp, items, block, i: int, j: int, percent: int) -> Iterator[tuple[int, int]]:
    """Exact links across components between the rows of blocks i and j; those that join nothing new are left out."""
    size, block, up = np.array([len(x) for x in items]), np.array(block), {}
    second = np.flatnonzero(block == j)
    flat, owner = np.concatenate([items[k] for k in second]), np.repeat(np.arange(len(second)), size[second])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]

    def root(c: int) -> int:
        while (above := up.get(c, c)) != c:
            up[c] = c = up.get(above, above)
        return c

    for k in np.flatnonzero(block == i):
        lo = np.searchsorted(flat, items[k], "left")
        n = np.searchsorted(flat, items[k], "right") - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        common = np.bincount(owner[at], minlength=len(second))
        for m in second[100 * common >= percent * (size[k] + size[second] - common)].tolist():
            x, y = root(comp[k]), root(comp[m])
            if x != y:
                up[x] = y
                yield ids[k], ids[m]


def _walk(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("d", "c", "items", "block")
        key, held = None, {x: [] for x in names}

        def done():
            if len(set(held["c"])) > 1:
                found = list(_links_of_blocks(*held.values(), key[1], key[2], percent))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
            for x in held.values():
                x.clear()

        for batch in batches:
            cols = {x: batch.column(x).to_pylist() for x in ("k", "i", "j", "d", "c", "block")}
            items = batch.column("items")
            for r in range(batch.num_rows):
                this = (cols["k"][r], cols["i"][r], cols["j"][r])
                if this != key:
                    yield from done()
                    key = this
                for x in ("d", "c", "block"):
                    held[x].append(cols[x][r])
                held["items"].append(items[r].values.to_numpy())
        yield from done()

    return run


def _crowded(keys: DataFrame, near: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) between the members of all bands that hold more than one component."""
    held = keys.select("k", "d").distinct().join(near, "d", "left").select("k", "d", F.coalesce("component", "d").alias("c"))
    per = "over (partition by k)"
    held = held.withColumns({"lo": F.expr(f"min(c) {per}"), "hi": F.expr(f"max(c) {per}"), "size": F.expr(f"count(*) {per}"), "whole": F.expr(f"bit_xor(xxhash64(d)) {per}")})
    # among three, the first and the one before are all there are
    held = scratch.cut(held.filter("size > 3 and lo <> hi").select("k", "d", "c", "lo", "size", "whole"))
    # of the bands with the same members one is enough
    alike = held.groupBy("lo", "size", "whole").agg(F.min("k").alias("k")).select("k")
    held = held.join(alike, "k").withColumn("block", F.expr(f"cast((row_number() over (partition by k order by c, d) - 1) div {BLOCK} as int)"))
    held = held.select("k", "d", "c", "block", F.explode(F.expr(f"sequence(0, cast((size - 1) div {BLOCK} as int))")).alias("other"))
    held = held.select("k", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "d", "c", "block")
    held = held.join(sets.select(F.col("id").alias("d"), "items"), "d").repartition("k", "i", "j").sortWithinPartitions("k", "i", "j")
    return scratch.cut(held.select("k", "i", "j", "d", "c", "block", "items").mapInArrow(released(_walk(percent)), "a long, b long").distinct())


_EDGES = "rid long, u int, side int, c long, beside array<int>, spots array<int>"


def _runs_of(units: list[dict]) -> list[list[dict]]:
    """Runs of neighbouring paragraphs, those across documents and those inside one apart."""
    out: list[list[dict]] = []
    for x in sorted(units, key=lambda x: x["u"]):
        if out and out[-1][-1]["u"] + 1 == x["u"] and out[-1][-1]["across"] == x["across"]:
            out[-1].append(x)
        else:
            out.append([x])
    return out


def _edges(min_words: int):
    """The words beside each run across documents, the nearest first, and where they end (side 0) or begin (side 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _StringHash()
        for batch in batches:
            parsed = Parsed(batch.column(1).to_pylist(), hashes, min_words)
            short = signed(parsed.h).view(np.int32)[1::2]  # the upper half of each hash
            opens = np.searchsorted(parsed.owner, np.arange(batch.num_rows))
            rows = []
            for i, (rid, units) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for x in _runs_of(units):
                    if x[0]["across"]:
                        first, past = parsed.first[opens[i] + x[0]["u"]], parsed.past[opens[i] + x[-1]["u"]]
                        low, high = max(parsed.bounds[i], first - BESIDE), min(parsed.bounds[i + 1], past + BESIDE)
                        if low < first:
                            rows.append((rid, x[0]["u"], 0, x[0]["c"], short[low:first][::-1], parsed.start[low:first][::-1]))
                        if past < high:
                            rows.append((rid, x[0]["u"], 1, x[-1]["c"], short[past:high], parsed.end[past:high]))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[f.split()[0] for f in _EDGES.split(", ")])

    return run


def _shared_words(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Of each edge (rid, u, side) how many words go on as beside another run, and where the last of them stands.

    Edges with the same words are one. Among the others of a component and side that begin with the same word, sorted,
    the most that one shares with any other it shares with a neighbour.
    """
    kinds = edges.groupBy("side", "c", "beside").agg(F.count("*").alias("n"))
    per = "over (partition by side, c, beside[0] order by beside)"
    kinds = kinds.withColumns({"p": F.expr(f"lag(beside) {per}"), "q": F.expr(f"lead(beside) {per}")})

    def common(other: str) -> Column:
        same = F.zip_with("beside", F.coalesce(F.col(other), F.array().cast("array<int>")), lambda x, y: F.coalesce(x == y, F.lit(False)))
        return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same).cast("long"))

    shared = F.when(F.col("n") > 1, F.size("beside").cast("long")).otherwise(F.least(F.greatest(common("p"), common("q")), F.size("beside").cast("long")))
    kinds = kinds.select("side", "c", "beside", shared.cast("int").alias("more")).filter("more > 0")
    met = edges.join(kinds, ["side", "c", "beside"])
    return scratch.cut(met.select("rid", "u", "side", "more", F.get("spots", F.col("more") - 1).alias("spot")))


_FOUND = "rid long, repeated array<int>, removed array<int>, classes array<long>, words_repeated long, words_removed long, words_inside long"


def _runs(min_run: int):
    """Of each document's repeated paragraphs (u, n, s, e, first, c, across) and edges (u, side, more, spot), the runs
    that are long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for rid, units, beside in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                more = {(x["u"], x["side"]): x for x in beside or ()}
                kept, gone, classes = [], [], set()
                words = removed = inside = 0
                for x in _runs_of(units):
                    ends = [more.get((x[0]["u"], side)) for side in (0, 1)] if x[0]["across"] else [None, None]
                    extra = [e["more"] if e else 0 for e in ends]
                    own = sum(y["n"] for y in x)
                    if own + sum(extra) < min_run:
                        continue
                    if not x[0]["across"]:
                        inside += own
                        continue
                    spans = [[y["s"], y["e"], y["n"], y["first"]] for y in x]
                    for k, e, i in ((0, ends[0], 0), (-1, ends[1], 1)):
                        if e:
                            spans[k][i] = e["spot"]
                            spans[k][2] += e["more"]
                    kept += [v for y in spans for v in y[:2]]
                    gone += [v for y in spans if not y[3] for v in y[:2]]
                    words += sum(y[2] for y in spans)
                    removed += sum(y[2] for y in spans if not y[3])
                    classes |= {y["c"] for y in x}
                rows.append((rid, kept, gone, sorted(classes), words, removed, inside))
            types = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64()]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[f.split()[0] for f in _FOUND.split(", ")])

    return run


def find_repeats(docs: DataFrame, n: int = 5, percent: int = 80, min_words: int = 8, min_run: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Repeated passages of every document: a row for each input row.

    Columns: doc_id, text_hash (xxhash64 of the text), n_paragraphs, repeated and removed (flat arrays of start, end in
    characters), classes (array of component ids), words_repeated, words_removed, and words_inside, of passages that
    repeat in this document alone. The first occurrence is that of the smallest document id, nulls last; later ones in
    the same document are removed too. Null and empty texts have no paragraphs. Rows with equal ids are separate
    documents, in the order in which they are read. ``min_words`` must not be less than n, nor min_run more than BESIDE.
    """
    if min_words < n or min_run > BESIDE:
        raise ValueError(f"min_words must be n or more, min_run {BESIDE} or less")
    spark = docs.sparkSession
    scratch, bands = Scratch(spark), tune_bands(percent)
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    units = scratch.cut(base.mapInArrow(released(_cut(n, bands, min_words)), _UNITS))
    real = units.filter("u >= 0")
    keys = real.filter("bands is not null").select(F.explode("bands").alias("k"), "d")
    keys = keys.select("k", "d", F.expr("min(d) over (partition by k)").alias("lead"), F.expr("max(d) over (partition by k)").alias("last"), F.expr("lag(d) over (partition by k order by d)").alias("prev"))
    keys = scratch.cut(keys.filter("lead <> last").drop("last"))
    scratch.sweep()  # the shuffle of all bands is the largest
    pairs = keys.filter("d <> lead").select(F.explode(F.array("lead", "prev")).alias("a"), F.col("d").alias("b")).filter("a <> b").distinct()
    pairs = scratch.cut(pairs)
    spot = F.col("d").bitwiseAND(F.lit(PRUNE_BITS - 1))
    rows = pairs.select(F.col("a").alias("d")).union(pairs.select(F.col("b").alias("d"))).select(spot.alias("s")).groupBy(F.expr("s div 32").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 32 as int))")).alias("m")).collect()  # at most PRUNE_BITS / 32
    prune = np.zeros(PRUNE_BITS // 32, np.uint32)
    for r in rows:
        prune[r.w] = r.m
    texts = docs.select(F.col(text_col).alias("text")).filter("text is not null")
    sets = scratch.cut(texts.mapInArrow(released(_wanted_sets(n, min_words, spark.sparkContext.broadcast(prune.view(np.uint8)))), "id long, items array<long>").groupBy("id").agg(F.min("items").alias("items")))
    two = pairs.join(sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b").join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a")
    links = scratch.cut(two.mapInArrow(released(_exact(percent)), "a long, b long"))
    near = scratch.cut(components(links, scratch).withColumnRenamed("id", "d"))
    more = _crowded(keys, near, sets, percent, scratch)
    scratch.drop(keys, pairs, sets, links)
    scratch.sweep()
    old = near.filter("d <> component").select(F.col("d").alias("a"), F.col("component").alias("b"))
    near = scratch.cut(components(old.union(more), scratch).withColumnRenamed("id", "d"))
    # filters of a fixed size keep paragraphs out of the shuffles that have no part in a class
    linked = maybe_in(scratch.cut(id_bits(near, "d", FILTER)), "d", FILTER)
    real = real.drop("bands")
    known = real.filter(linked).join(near, "d", "left")
    known = known.withColumns({"c": F.coalesce("component", "d"), "c2": F.when(F.col("component").isNull(), F.col("d2")).otherwise(F.lit(0))}).drop("component")
    known = known.unionByName(real.filter(~linked).withColumns({"c": F.col("d"), "c2": F.col("d2")}))
    place = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc"), "rid", "u")
    first = scratch.cut(known.groupBy("c", "c2").agg(F.min(place).alias("first"), F.count("*").alias("size"), (F.min("rid") < F.max("rid")).alias("across")).filter("size > 1"))
    bits = scratch.cut(id_bits(first.select("c").distinct(), "c", FILTER))
    again = known.filter(maybe_in(bits, "c", FILTER)).join(first.select("c", "c2", "first", "across"), ["c", "c2"])
    again = again.select("rid", "doc_id", "th", F.struct("u", "n", "s", "e", (F.col("first.rid").eqNullSafe(F.col("rid")) & (F.col("first.u") == F.col("u"))).alias("first"), "c", "across").alias("x"))
    per = scratch.cut(again.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.first("th").alias("th"), F.collect_list("x").alias("xs")))
    # texts with runs across documents, one of each, for the words beside the runs
    runs = per.filter(F.exists("xs", lambda x: x["across"])).withColumn("doc_id", F.coalesce("doc_id", F.lit((1 << 63) - 1)))
    some = scratch.cut(id_bits(runs.select("th").distinct(), "th", FILTER))
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text")).filter("text is not null")
    texts = texts.filter(maybe_in(some, "th", FILTER)).groupBy("doc_id", "th").agg(F.min("text").alias("text"))
    edges = scratch.cut(runs.join(texts, ["doc_id", "th"]).select("rid", "text", "xs").mapInArrow(released(_edges(min_words)), _EDGES))
    more = _shared_words(edges, scratch).groupBy("rid").agg(F.collect_list(F.struct("u", "side", "more", "spot")).alias("beside"))
    found = per.join(more, "rid", "left").select("rid", "xs", "beside").mapInArrow(released(_runs(min_run)), _FOUND)
    every = units.filter("u <= 0").select("rid", "doc_id", F.col("th").alias("text_hash"), F.col("total").cast("long").alias("n_paragraphs"))
    none = F.array()
    out = every.join(found, "rid", "left")
    return scratch.last(out.select("doc_id", "text_hash", "n_paragraphs", F.coalesce("repeated", none.cast("array<int>")).alias("repeated"), F.coalesce("removed", none.cast("array<int>")).alias("removed"), F.coalesce("classes", none.cast("array<long>")).alias("classes"), F.coalesce("words_repeated", F.lit(0)).cast("long").alias("words_repeated"), F.coalesce("words_removed", F.lit(0)).cast("long").alias("words_removed"), F.coalesce("words_inside", F.lit(0)).cast("long").alias("words_inside")))


def remove_repeats(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without the removed spans of find_repeats, in the same columns.

    Rows with equal id and text are one document here, which keeps what any of them keeps. A null text stays null.
    """
    bound_batches(docs.sparkSession)
    a, b, gone = fresh(docs, "__id", "__hash", "__gone")
    per = found.groupBy(F.col("doc_id").alias(a), F.col("text_hash").alias(b)).agg(F.min_by("removed", F.size("removed")).alias(gone))
    joined = docs.join(per, F.col(id_col).cast("long").eqNullSafe(F.col(a)) & (F.xxhash64(text_col) == F.col(b)), "left").select(*docs.columns, gone)
    at, width = docs.columns.index(text_col), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, cut in zip(batch.column(at).to_pylist(), batch.column(width).to_pylist(), strict=True):
                for s, e in reversed(list(zip(cut[::2], cut[1::2], strict=True)) if cut and text is not None else []):
                    text = text[:s] + text[e:]
                texts.append(text)
            cols = list(batch.columns[:width])
            cols[at] = pa.array(texts, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names[:width])

    return joined.mapInArrow(released(run), docs.schema)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its paragraphs, repeated and removed words and spans, and the classes it belongs to."""
    out = find_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return out.select("doc_id", "n_paragraphs", "words_repeated", "words_removed", "words_inside", joined("repeated").alias("repeated_spans"), joined("removed").alias("removed_spans"), joined("classes").alias("class_ids"))
