"""Controls for motifs: sequences shuffled with their letter pairs kept, and how central the sites of a motif are.

Sequences are rows (seq_id, seq) of capital letters; what is not A, C, G or T is a gap.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import special
from . import sequences as Q
from .discovery import profile_sites

# -- shuffling -------------------------------------------------------------------------------------------------------

def euler_shuffle(letters: str, rng: np.random.Generator) -> str:
    """A random text with the same pairs of neighbours, and so the same first and last letter.

    Pairs are the edges of a graph of letters, and a text is a trail over all of them. A last edge is drawn for every
    letter, until these lead from every letter to the final one; the others are put in random order before it. Then
    every trail is as likely as any other.
    """
    if len(letters) < 4:
        return letters
    after: dict[str, list[str]] = {}
    for a, b in zip(letters, letters[1:]):
        after.setdefault(a, []).append(b)
    end = letters[-1]
    while True:
        last = {a: int(rng.integers(len(its))) for a, its in after.items() if a != end}
        if all(_leads(a, end, {x: after[x][i] for x, i in last.items()}) for a in last):
            break
    for a, its in after.items():
        kept = [its.pop(last[a])] if a in last else []
        after[a] = kept + [its[i] for i in rng.permutation(len(its)).tolist()]  # taken from the end
    out = [letters[0]]
    for _ in range(len(letters) - 1):
        out.append(after[out[-1]].pop())
    return "".join(out)


def _leads(at: str, end: str, to: dict[str, str]) -> bool:
    for _ in range(len(to)):
        if at == end:
            return True
        at = to[at]
    return at == end


#: Letters that are shuffled together, and stretches that must still go on for them to go on together.
TOGETHER, SIDE_BY_SIDE = 1 << 20, 8

_CODE = np.full(256, 4, np.uint8)
_CODE[np.frombuffer(Q.BASES.encode(), np.uint8)] = range(4)
_LETTER = np.frombuffer(Q.BASES.encode(), np.uint8)

#: By final letter, the 16 ways in which the other letters lead to it; it leads to itself.
_TREES = np.array([[t for t in product(range(4), repeat=4) if t[end] == end and all(t[t[t[a]]] == end for a in range(4))] for end in range(4)])


def _mixed(x: np.ndarray) -> np.ndarray:
    """Random 64-bit numbers from counters (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shuffle_together(raw: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """``euler_shuffle`` of all stretches of some texts at once: texts one after another as bytes, where they end, and a
    random 64-bit key of each, which all its draws come from."""
    code = _CODE[raw]
    inside = code < 4
    edge = np.zeros(len(raw) + 1, bool)
    edge[0] = edge[ends] = True
    begins = np.flatnonzero(inside & (edge[:-1] | np.concatenate(([True], ~inside[:-1]))))
    stops = np.flatnonzero(inside & (edge[1:] | np.concatenate((~inside[1:], [True])))) + 1
    long = stops - begins >= 4
    begins, sizes = begins[long], (stops - begins)[long]
    order = np.argsort(-sizes, kind="stable")  # the longest first, so that those that go on are the first ones
    begins, sizes = begins[order], sizes[order]
    n = len(begins)
    if not n:
        return raw
    text = np.searchsorted(ends, begins, side="right")
    key = _mixed(keys[text] ^ _mixed((begins - np.concatenate(([0], ends))[text]).astype(np.uint64)))
    # edges by stretch and letter, in random order
    row = np.repeat(np.arange(n), sizes - 1)
    step = np.arange(len(row)) - np.repeat(np.cumsum(sizes - 1) - (sizes - 1), sizes - 1)
    at = begins[row] + step
    group = row * 4 + code[at]
    bits = np.uint64(64 - int(4 * n).bit_length())
    draw = _mixed(key[row] + step.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    by = np.argsort((group.astype(np.uint64) << bits) | (draw >> (np.uint64(64) - bits)), kind="stable")
    to = code[at[by] + 1].astype(np.int64)
    counts = np.bincount(group, minlength=4 * n)
    first = np.cumsum(counts) - counts
    # a last edge for each letter but the final one: where they lead is drawn among the trees, by how many edges each has
    final = code[begins + sizes - 1].astype(np.int64)
    all_of = np.repeat(np.arange(4 * n), counts)
    between = np.bincount(all_of * 4 + to, minlength=16 * n).reshape(n, 4, 4)
    own = counts.reshape(n, 4) > 0
    own[np.arange(n), final] = False
    lead = _TREES[final]
    ways = np.take_along_axis(between, lead.transpose(0, 2, 1), 2).astype(float)
    ways = np.where(own[:, :, None], ways, lead.transpose(0, 2, 1) == final[:, None, None]).prod(axis=1).cumsum(axis=1)
    share = (_mixed(key + np.uint64(1)) >> np.uint64(11)).astype(float) / 2.0**53
    tree = np.minimum((ways <= share[:, None] * ways[:, -1:]).sum(axis=1), lead.shape[1] - 1)
    lead = lead[np.arange(n), tree]
    among = np.flatnonzero((to == lead.reshape(-1)[all_of]) & own.reshape(-1)[all_of])
    many = np.take_along_axis(between, lead[:, :, None], 2)[:, :, 0][own]
    x = _mixed(key[:, None] ^ np.arange(2, 6, dtype=np.uint64))[own] % many.astype(np.uint64)
    i, j = among[np.cumsum(many) - many + x.astype(np.int64)], (first + counts - 1).reshape(n, 4)[own]
    to[i], to[j] = to[j], to[i]
    # the trails, a letter of each at a time
    out, here, letter, t = raw.copy(), first, code[begins].astype(np.int64), 1
    base, start = np.arange(n) * 4, first[::4].copy()
    less = -sizes
    while (on := int(np.searchsorted(less, -t, side="left"))) >= SIDE_BY_SIDE:
        g = base[:on] + letter[:on]
        letter = to[here[g]]
        here[g] += 1
        out[begins[:on] + t] = _LETTER[letter]
        t += 1
    for s in range(on):
        low = int(start[s])
        edges, its, x, made = to[low : low + int(sizes[s]) - 1].tolist(), (here[4 * s : 4 * s + 4] - low).tolist(), int(letter[s]), []
        for _ in range(int(sizes[s]) - t):
            i = its[x]
            its[x] = i + 1
            x = edges[i]
            made.append(x)
        out[begins[s] + t : begins[s] + sizes[s]] = _LETTER[made]
    return out


def pair_shuffled(df: DataFrame, seed: int, copies: int = 1, id_col: str = "seq_id", seq: str = "seq") -> DataFrame:
    """(id, copy, seq): so many shuffled copies of each sequence, with the letter pairs of every stretch kept.

    Stretches between gaps are shuffled on their own, gaps stay where they are. A copy depends on the seed, its number
    and the sequence's id and letters, not on where it is made. Null sequences stay null.
    """
    frame = df.select(id_col, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), F.col(seq).alias("seq")) if copies > 0 else df.select(id_col, F.lit(0).alias("copy"), F.col(seq).alias("seq")).limit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            there, places, letters = column.buffers()
            if letters is None or not len(column):
                yield batch
                continue
            raw = np.frombuffer(letters, np.uint8).copy()  # letters change, places do not
            places_of = np.frombuffer(places, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
            names, copies, low = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0
            while low < len(column):
                high = max(low + 1, int(np.searchsorted(places_of, places_of[low] + TOGETHER, side="right")) - 1)
                keys = [xxhash.xxh3_64_intdigest(f"{seed}\0{names[i]}\0{copies[i]}\0".encode() + raw[places_of[i] : places_of[i + 1]].tobytes()) for i in range(low, high)]
                a, b = places_of[low], places_of[high]
                raw[a:b] = shuffle_together(raw[a:b], places_of[low + 1 : high + 1] - a, np.array(keys, np.uint64))
                low = high
            made = pa.Array.from_buffers(column.type, len(column), [there, places, pa.py_buffer(raw)], offset=column.offset)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), made], names=batch.schema.names)

    return frame.mapInArrow(run, frame.schema)


# -- centre ----------------------------------------------------------------------------------------------------------


def middles(df: DataFrame, width: int, id_col: str = "seq_id", seq: str = "seq") -> DataFrame:
    """(id, seq): the middle letters of the sequences that are long enough; of an odd rest the right side has more."""
    first = F.floor((F.length(seq) - width) / 2).cast("int")
    return df.filter(F.length(seq) >= width).select(id_col, F.substring(F.col(seq), first + 1, F.lit(width)).alias("seq"))


def central_distances(df: DataFrame, profile: DataFrame, width: int, background: dict[str, float] | None = None, most_p: float = 1e-2, scale: int = 100, id_col: str = "seq_id", seq: str = "seq") -> DataFrame:
    """(distance, n): how far from the middle the best site of each sequence begins, in twice the letters.

    Sequences are cut to their middle ``width`` letters. Of equally good sites the one with the first MD5 of id, strand
    and place counts, which favours no place. Sequences without a site of p <= most_p do not count.
    """
    span = profile.select("col").distinct().count()
    sites = profile_sites(middles(df, width, id_col, seq), profile, background, most_p, scale, id_col)
    # places on the other strand count from its own first letter
    place = F.when(F.col("strand") > 0, F.col("pos")).otherwise(F.lit(width - span) - F.col("pos"))
    tie = F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.col("strand").cast("string"), place.cast("string")))
    best = sites.groupBy(id_col).agg(F.min_by(place, F.struct(F.negative("score"), tie)).alias("at"))
    return best.groupBy(F.abs(2 * F.col("at") - (width - span)).cast("int").alias("distance")).agg(F.count("*").alias("n"))


def central_enrichment(distances: DataFrame, places: int) -> DataFrame:
    """(distance, window, sites, n, p_value, corrected, best) of every central window, from (distance, n).

    ``places`` are the places where a site may begin. A window holds the places up to a distance from the middle. If
    sites fell anywhere alike, those inside a window would be binomial; p is the upper tail, and ``corrected`` that of
    the best of all windows tried, as if they were independent. Windows that hold all places are not tried.
    """
    spark = distances.sparkSession
    counts = {r["distance"]: r["n"] for r in distances.collect()}  # not more rows than places
    n, inside, rows = sum(counts.values()), 0, []
    tried = [d for d in range((places - 1) % 2, places, 2)][:-1]
    for d in tried:
        inside += counts.get(d, 0)
        window = d + 1
        p = special.binomial_tail(inside, n, window / places) if n else 1.0
        rows.append((d, window, inside, n, p, 1.0 if p >= 1 else float(-np.expm1(len(tried) * np.log1p(-p)))))
    least = min((r[4], r[0]) for r in rows) if rows and n else None
    return spark.createDataFrame([(*r, (r[4], r[0]) == least) for r in rows], "distance int, window int, sites long, n long, p_value double, corrected double, best boolean")
