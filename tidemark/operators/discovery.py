"""What is done with motifs once they are found: comparing them, finding their sites, and words that tell sets apart.

Profiles are rows (motif, col, base, freq), or wide: (motif, freqs) with the frequencies of A, C, G and T column after
column. Sequences are rows (seq_id, seq) of capital letters; what is not A, C, G or T is a gap.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import special
from ..functions.scalar import reverse_complement
from ..session import cut
from . import sequences as Q
from .stats import benjamini_hochberg

# -- motif against motif ---------------------------------------------------------------------------------------------

#: Steps that the likeness of two columns is counted in.
STEPS = 100
#: Query motifs that are compared in one pass over the targets, and columns that a motif may have.
TOGETHER, WIDEST = 32, 64


def wide_profiles(profile: DataFrame, motif: str = "motif") -> DataFrame:
    """(motif, freqs) of rows (motif, col, base, freq): four numbers for each of a motif's few columns."""
    cells = F.transform(F.array_sort(F.collect_list(F.struct("col", "base", "freq"))), lambda x: x["freq"])
    return profile.filter(F.col("base").isin(*Q.BASES)).groupBy(F.col(motif).alias("motif")).agg(cells.alias("freqs"))


def column_likeness(a: np.ndarray, b: np.ndarray, metric: str = "distance") -> np.ndarray:
    """Steps 0..STEPS of every column of a against every column of b.

    ``distance``: Euclidean, the farthest columns have 0. ``pearson``: correlation of the four frequencies; a column
    of equal frequencies has none with any, which counts as 0.
    """
    if metric == "distance":
        like = 1 - np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(2)) / math.sqrt(2)
    elif metric == "pearson":
        x, y = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
        size = np.sqrt((x**2).sum(1))[:, None] * np.sqrt((y**2).sum(1))[None, :]
        like = (1 + np.divide(x @ y.T, size, out=np.zeros_like(size), where=size > 1e-12)) / 2
    else:
        raise ValueError("metric must be distance or pearson")
    return np.floor(np.clip(like, 0, 1) * STEPS + 0.5).astype(np.int64)


class _Null:
    """The distribution of summed likeness of a run of a query's columns to columns drawn from all targets.

    Column by column the distributions are convolved; what a run's tail is asked for first costs is kept.
    """

    def __init__(self, columns: np.ndarray):
        self.columns, self.sums, self.tails = columns, {}, {}

    def _sum(self, first: int, past: int) -> np.ndarray:
        if past - first == 1:
            return self.columns[first]
        if (first, past) not in self.sums:
            self.sums[first, past] = np.convolve(self._sum(first, past - 1), self.columns[past - 1])
        return self.sums[first, past]

    def tail(self, first: int, past: int) -> np.ndarray:
        """For each sum, the probability that it is reached."""
        if (first, past) not in self.tails:
            self.tails[first, past] = np.minimum(1.0, np.cumsum(self._sum(first, past)[::-1])[::-1])
        return self.tails[first, past]


def best_alignment(query: np.ndarray, target: np.ndarray, null: _Null, least_overlap: int, both_strands: bool, metric: str) -> tuple:
    """(offset, strand, overlap, score, p of the offset, p of the best of all offsets) of a target beside a query.

    The offset is the query's column under the target's first. Of equally improbable ones the longer overlap, the
    smaller offset and the plus strand come first.
    """
    best, tried = None, 0
    least = min(least_overlap, len(query), len(target))
    for strand, columns in ((1, target), (-1, target[::-1, ::-1]))[: 1 + both_strands]:
        like = column_likeness(query, columns, metric)
        for offset in range(least - len(target), len(query) - least + 1):
            first, past = max(0, offset), min(len(query), offset + len(target))
            score = int(np.trace(like[first:past, first - offset : past - offset]))
            found = (float(null.tail(first, past)[score]), first - past, abs(offset), offset, -strand, score)
            tried += 1
            best = found if best is None else min(best, found)
    p, overlap, _, offset, strand, score = best
    return offset, -strand, -overlap, score, p, -math.expm1(tried * math.log1p(-min(p, 1 - 1e-16)))


def best_alignments(query: np.ndarray, targets: np.ndarray, null: _Null, least_overlap: int, both_strands: bool, metric: str) -> list[np.ndarray]:
    """What best_alignment gives, for targets (n, columns, 4) of one width side by side: a column for each part of it."""
    n, width, _ = targets.shape
    least = min(least_overlap, len(query), width)
    sides = {1: targets, -1: targets[:, ::-1, ::-1]} if both_strands else {1: targets}
    likes = {s: column_likeness(query, side.reshape(-1, 4), metric).reshape(len(query), n, width) for s, side in sides.items()}
    tried = [(max(0, o) - min(len(query), o + width), abs(o), o, -s) for s in sides for o in range(least - width, len(query) - least + 1)]
    p, best, score = np.full(n, np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64)
    tried.sort()  # of equally improbable ones the first stays
    for i, (_, _, offset, strand) in enumerate(tried):
        first, past = max(0, offset), min(len(query), offset + width)
        columns = np.arange(first, past)
        sums = likes[-strand][columns, :, columns - offset].sum(axis=0)
        tails = null.tail(first, past)[sums]
        better = tails < p
        p[better], best[better], score[better] = tails[better], i, sums[better]
    found = np.array(tried, np.int64)[best]
    return [found[:, 2].astype(np.int32), -found[:, 3].astype(np.int32), -found[:, 0].astype(np.int32), score, p, -np.expm1(len(tried) * np.log1p(-np.minimum(p, 1 - 1e-16)))]


def _by_width(batch: pa.RecordBatch, most: int = 1 << 12) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a batch of motifs and their matrices (n, columns, 4), those of one width together, some at once."""
    rows: dict[int, list] = {}
    for i, m in _matrices(list(range(batch.num_rows)), batch.column(1).to_pylist()):
        rows.setdefault(len(m), []).append((i, m))
    for width, its in rows.items():
        for at in range(0, len(its), max(1, most // width)):
            part = its[at : at + max(1, most // width)]
            yield np.array([i for i, _ in part]), np.stack([m for _, m in part])


def _matrices(names: list, values: list) -> Iterator[tuple[object, np.ndarray]]:
    for name, freqs in zip(names, values, strict=True):
        if freqs and None not in freqs:
            if len(freqs) % 4 or len(freqs) > 4 * WIDEST:
                raise ValueError(f"motif {name}: {len(freqs)} frequencies are not 1 to {WIDEST} columns of four")
            yield name, np.array(freqs).reshape(-1, 4)


def compare_motifs(queries: DataFrame, targets: DataFrame, least_overlap: int = 5, both_strands: bool = True, metric: str = "distance", most_p: float = 1.0) -> DataFrame:
    """Every target beside every query motif, both wide, ungapped, at the offset that chance explains least.

    (query, target, offset, strand, overlap, score, p_offset, p_value, e_value, q_value): the likeness of columns is
    counted in steps, all columns of all targets give each query column its null distribution, convolutions give that
    of every run of columns, and the best offset is corrected for the offsets tried. E counts the targets, q is
    Benjamini-Hochberg within a query over all targets, before most_p is applied.

    Queries are a stated set: they go to the targets in blocks, each with two passes over the targets, of which one
    counts likeness and one aligns. Motifs without columns or with nulls are left out; those of one name are compared
    each on its own; empty tables give no rows.
    """
    spark, out = targets.sparkSession, None
    name = targets.schema["motif"].dataType
    # made once, and dealt out by number: a small table of motifs is much work
    targets = cut(targets.select("motif", F.col("freqs").cast("array<double>").alias("freqs")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    n_targets = targets.filter("size(freqs) > 0 and not exists(freqs, x -> x is null)").count()
    found = T.StructType([
        T.StructField("query", queries.schema["motif"].dataType), T.StructField("target", name), T.StructField("offset", T.IntegerType()), T.StructField("strand", T.IntegerType()),
        T.StructField("overlap", T.IntegerType()), T.StructField("score", T.LongType()), T.StructField("p_offset", T.DoubleType()), T.StructField("p_value", T.DoubleType()),
    ])
    rows = queries.select("motif", F.col("freqs").cast("array<double>").alias("freqs")).collect()  # the stated set
    asked = list(_matrices([r["motif"] for r in rows], [r["freqs"] for r in rows]))
    for at in range(0, len(asked), TOGETHER):
        block = asked[at : at + TOGETHER]
        columns = np.concatenate([m for _, m in block])

        def count(batches: Iterator[pa.RecordBatch], columns=columns) -> Iterator[pa.RecordBatch]:
            seen = np.zeros((len(columns), STEPS + 1), np.int64)
            for batch in batches:
                for _, m in _by_width(batch):
                    for side in (m, m[:, ::-1, ::-1])[: 1 + both_strands]:
                        like = column_likeness(columns, side.reshape(-1, 4), metric)
                        for i, steps in enumerate(like):
                            seen[i] += np.bincount(steps, minlength=STEPS + 1)
            c, s = np.nonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(s), pa.array(seen[c, s])], names=["c", "s", "n"])

        counts = np.zeros((len(columns), STEPS + 1))
        for r in targets.mapInArrow(count, "c long, s long, n long").groupBy("c", "s").agg(F.sum("n").alias("n")).collect():  # STEPS rows a column
            counts[r["c"], r["s"]] = r["n"]
        shares = counts / np.maximum(counts.sum(1, keepdims=True), 1)
        edges = np.cumsum([0] + [len(m) for _, m in block])
        shared = spark.sparkContext.broadcast([(q, m, shares[edges[i] : edges[i + 1]]) for i, (q, m) in enumerate(block)])

        def align(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            nulls = [(q, m, _Null(s)) for q, m, s in shared.value]
            for batch in batches:
                for at, others in _by_width(batch):
                    targets = batch.column(0).take(pa.array(at))
                    for q, m, null in nulls:
                        values = best_alignments(m, others, null, least_overlap, both_strands, metric)
                        names = pa.array([q] * len(at), type=arrow.field(0).type)
                        yield pa.RecordBatch.from_arrays([names, targets.cast(arrow.field(1).type), *[pa.array(v, type=f.type) for v, f in zip(values, list(arrow)[2:], strict=True)]], schema=arrow)

        arrow = to_arrow_schema(found)
        part = targets.mapInArrow(align, found)
        out = part if out is None else out.union(part)
    if out is None:
        out = spark.createDataFrame([], found)
    out = cut(out)  # read twice: alignments are much work
    out = benjamini_hochberg(out.withColumn("e_value", F.col("p_value") * n_targets), "p_value", ["query"])
    return out.filter(F.col("p_value") <= most_p)


# -- sites of a profile ----------------------------------------------------------------------------------------------


def integer_scores(profile: DataFrame, background: dict[str, float], scale: int = 100) -> np.ndarray:
    """(columns, 4): log2 of frequency over background in whole steps of 1/scale, rounded half up.

    Columns that are gaps (is_gap) score 0. A frequency of 0 has no logarithm: give the profile a pseudocount.
    """
    gap = F.col("is_gap") if "is_gap" in profile.columns else F.lit(False)
    rows = profile.select("col", "base", F.when(gap, F.lit(None)).otherwise(F.col("freq")).alias("freq")).collect()  # four for each column
    out = np.zeros((1 + max((r["col"] for r in rows), default=-1), 4), np.int64)
    for r in rows:
        if r["freq"] is None:
            continue
        if not r["freq"] > 0:
            raise ValueError("all frequencies of a profile must be above 0")
        out[r["col"], Q.BASES.index(r["base"])] = math.floor(math.log2(r["freq"] / background[r["base"]]) * scale + 0.5)
    return out


def score_distribution(scores: np.ndarray, background: Sequence[float]) -> tuple[int, np.ndarray]:
    """The lowest possible sum, and the exact probabilities of it and of those above it, for letters drawn from the
    background: the distributions of the columns convolved."""
    probs = np.ones(1)
    for column in scores:
        low = column.min()
        wider = np.zeros(len(probs) + column.max() - low)
        for score, p in zip(column, background, strict=True):
            wider[score - low : score - low + len(probs)] += p * probs
        probs = wider
    return int(scores.min(1).sum()) if len(scores) else 0, probs


def _window_sums(codes: np.ndarray, first: int, past: int, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the windows without gaps from first on, before past, and their scores."""
    span = len(scores)
    at = np.arange(first, max(first, min(past, len(codes) - span + 1)))
    gaps = np.concatenate(([0], np.cumsum(codes == 4)))
    at = at[gaps[at + span] == gaps[at]]
    return at, sum((scores[m][codes[at + m]] for m in range(span)), np.zeros(len(at), np.int64))


def profile_sites(df: DataFrame, profile: DataFrame, background: dict[str, float] | None = None, most_p: float = 1e-4, scale: int = 100, id_col: str = "seq_id", seq: str = "seq") -> DataFrame:
    """Windows of both strands that a profile explains: (id, strand, pos, kmer, score, p_value, q_value), p <= most_p.

    The p-value is exact: the share of words, drawn letter by letter from the background (uniform, unless told), that
    score as high. The q-value is Benjamini-Hochberg over all windows of all sequences. It needs how many windows have
    each score, a table as long as there are scores, and so a first pass that counts them; the second pass writes only
    windows that count. Nothing is shuffled but the counts.

    Positions count from the first letter of their strand. Null and short sequences and windows with gaps have no sites.
    """
    background = background or dict.fromkeys(Q.BASES, 0.25)
    share = np.array([background[b] for b in Q.BASES]) / sum(background[b] for b in Q.BASES)
    scores = integer_scores(profile, dict(zip(Q.BASES, share.tolist(), strict=True)), scale)
    lowest, probs = score_distribution(scores, share)
    tails = np.minimum(1.0, np.cumsum(probs[::-1])[::-1])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = np.zeros(len(tails), np.int64)
        for batch in batches:
            for codes in Q._texts(batch, 0):
                for a in range(0, len(codes), Q.BLOCK):
                    _, sums = _window_sums(codes[a : a + Q.BLOCK + len(scores) - 1], 0, Q.BLOCK, scores)
                    many += np.bincount(sums - lowest, minlength=len(tails))
        there = np.flatnonzero(many)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(many[there])], names=["s", "n"])

    counts = np.zeros(len(tails))
    for r in Q._strands(df, id_col, seq).select("__s").mapInArrow(count, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).collect():  # a row for each possible score
        counts[r["s"]] = r["n"]
    rank = np.cumsum(counts[::-1])[::-1]
    raw = np.divide(tails * counts.sum(), rank, out=np.full(len(tails), np.inf), where=rank > 0)
    q = np.minimum(1.0, np.minimum.accumulate(np.where(counts > 0, raw, np.inf)))

    def score(codes: np.ndarray, first: int, n: int):
        at, sums = _window_sums(codes, first, first + n, scores)
        keep = tails[sums - lowest] <= most_p
        at, sums = at[keep], sums[keep]
        return at, [Q._words_of(codes, at, len(scores)), pa.array(sums), pa.array(tails[sums - lowest]), pa.array(q[sums - lowest])]

    added = [T.StructField("kmer", T.StringType()), T.StructField("score", T.LongType()), T.StructField("p_value", T.DoubleType()), T.StructField("q_value", T.DoubleType())]
    return Q._scored(df, id_col, seq, 0, len(scores) - 1, added, score)


# -- words that tell sets of sequences apart -------------------------------------------------------------------------

# The letters that each ambiguity code stands for.
CODES = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "M": "AC", "K": "GT", "S": "CG", "W": "AT", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
_OF_LETTERS = {frozenset(v): k for k, v in CODES.items()}
_COMPLEMENT = {k: _OF_LETTERS[frozenset(v.translate(str.maketrans("ACGT", "TGCA")))] for k, v in CODES.items()}


def reverse_pattern(pattern: str) -> str:
    """The pattern of the other strand."""
    return "".join(_COMPLEMENT[c] for c in reversed(pattern))


def wider(pattern: str) -> Iterator[str]:
    """Patterns with one code replaced by one that stands for more letters."""
    for i, c in enumerate(pattern):
        for code, letters in CODES.items():
            if set(CODES[c]) < set(letters):
                yield pattern[:i] + code + pattern[i + 1 :]


#: Letters of words that fit a number of 62 bits; sequences whose bits stand side by side in one round of a count.
LONGEST_WORD, BESIDE = 31, 1 << 13


def _numbers(codes: np.ndarray, k: int, both_strands: bool) -> np.ndarray:
    """The different words of k letters of a text as numbers to base 4, sorted; of a word and its reverse complement the
    smaller one, which is the earlier."""
    n = len(codes) - k + 1
    if n < 1:
        return np.zeros(0, np.int64)
    gaps = np.concatenate(([0], np.cumsum(codes == 4)))
    plus, minus = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(k):
        letter = codes[i : i + n].astype(np.int64) & 3
        plus = plus * 4 + letter
        minus += (3 - letter) << (2 * i)
    return np.unique((np.minimum(plus, minus) if both_strands else plus)[gaps[k:] == gaps[:n]])


def held_words(df: DataFrame, k: int, both_strands: bool = True, id_col: str = "seq_id", seq: str = "seq", positive: str = "positive") -> DataFrame:
    """(id, positive, words): the different words of k letters in each sequence, as numbers to base 4; with both strands
    a word and its reverse complement are one, the earlier. Rows of one id and flag are one sequence.

    Sequences are dealt out and sorted by id, so that rows of one sequence follow each other and only its words so far
    are kept: at most 4^k, and no more than it has letters. Texts are read in blocks. Nothing else is shuffled.
    """
    if not 1 <= k <= LONGEST_WORD:
        raise ValueError(f"a word has 1 to {LONGEST_WORD} letters")
    frame = df.filter(F.col(positive).isNotNull()).select(F.col(id_col).alias("id"), F.col(positive).alias("positive"), F.col(seq).alias("seq"))
    frame = frame.repartition("id").sortWithinPartitions("id", "positive")
    schema = T.StructType([frame.schema["id"], frame.schema["positive"], T.StructField("words", T.ArrayType(T.LongType()))])
    arrow = to_arrow_schema(schema)

    def rows(done: list[tuple]) -> pa.RecordBatch:
        ids, flags, words = zip(*done, strict=True)
        edges = np.cumsum([0, *map(len, words)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(words)))
        return pa.RecordBatch.from_arrays([pa.array(ids, arrow.field(0).type), pa.array(flags, arrow.field(1).type), lists.cast(arrow.field(2).type)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, done, size = None, [], 0
        for batch in batches:
            for name, flag, codes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), Q._texts(batch, 2)):
                if last is not None and last[:2] != (name, flag):
                    done.append(last)
                    size, last = size + len(last[2]), None
                    if size > Q.BLOCK:
                        yield rows(done)
                        done, size = [], 0
                words = [last[2]] if last else []
                words += [_numbers(codes[a : a + Q.BLOCK + k - 1], k, both_strands) for a in range(0, len(codes), Q.BLOCK)]
                last = (name, flag, np.unique(np.concatenate(words)) if len(words) > 1 else words[0] if words else np.zeros(0, np.int64))
        if last is not None:
            yield rows([*done, last])

    return frame.mapInArrow(run, schema)


def word_counts(held: DataFrame, k: int) -> DataFrame:
    """(word, pos, neg): sequences of either kind that hold a word, for every word that one of them holds."""
    counts = held.select("positive", F.explode("words").alias("w")).groupBy("w").agg(F.count_if("positive").alias("pos"), F.count_if(~F.col("positive")).alias("neg"))
    base = F.array(*map(F.lit, Q.BASES))
    letters = [F.get(base, F.shiftright("w", 2 * (k - 1 - i)).bitwiseAND(F.lit(3).cast("long")).cast("int")) for i in range(k)]
    return counts.select(F.concat(*letters).alias("word"), "pos", "neg")


def _words_for(pattern: str, both_strands: bool) -> np.ndarray:
    """The words that a pattern stands for, as numbers to base 4; with both strands the earlier of each and its reverse complement."""
    plus, minus = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for i, c in enumerate(pattern):
        letters = np.array([Q.BASES.index(x) for x in CODES[c]], np.int64)
        plus = (plus[:, None] * 4 + letters).ravel()
        minus = (minus[:, None] + ((3 - letters) << (2 * i))).ravel()
    return np.unique(np.minimum(plus, minus) if both_strands else plus)


def pattern_counts(held: DataFrame, patterns: Sequence[str], both_strands: bool = True) -> DataFrame:
    """(pattern, pos, neg): sequences of either kind that hold a word that fits, counted for all patterns at once.

    Patterns become the words that they stand for, at most 4^k each. Every such word has a bit for each of some sequences
    side by side, and a pattern's sequences are the bits of its words together. Nothing is shuffled but the counts.
    """
    spark = held.sparkSession
    meant = [_words_for(p, both_strands) for p in patterns]
    known = np.unique(np.concatenate([*meant, np.zeros(0, np.int64)]))
    shared = spark.sparkContext.broadcast((known, [np.searchsorted(known, m).astype(np.int32) for m in meant]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, meant = shared.value
        beside = max(8, min(BESIDE, (1 << 26) // max(1, len(known))))
        pos, neg = np.zeros(len(meant), np.int64), np.zeros(len(meant), np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows if len(known) else 0, beside):
                batch = whole.slice(at, beside)
                lists, flags = batch.column(1), batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
                words, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                place = np.minimum(np.searchsorted(known, words), len(known) - 1)
                there = known[place] == words
                bits = np.zeros((len(known), batch.num_rows), bool)
                bits[place[there], row[there]] = True
                bits, flags = np.packbits(bits, axis=1), np.packbits(flags)
                for i, its in enumerate(meant):
                    hit = np.bitwise_or.reduce(bits[its], axis=0)
                    of_pos = int(np.bitwise_count(hit & flags).sum())
                    pos[i] += of_pos
                    neg[i] += int(np.bitwise_count(hit).sum()) - of_pos
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(meant), dtype=np.int32)), pa.array(pos), pa.array(neg)], names=["i", "pos", "neg"])

    sums = held.select("positive", "words").mapInArrow(run, "i int, pos long, neg long").groupBy("i").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    names = spark.createDataFrame(list(enumerate(patterns)), "i int, pattern string")
    return names.join(sums, "i", "left").select("pattern", F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("neg", F.lit(0)).alias("neg"))


def _tested(counts: DataFrame, pos_all: int, neg_all: int) -> DataFrame:
    """With p_value: Fisher's exact test, one-sided, for more among the positive sequences."""

    @F.pandas_udf("double")
    def tail(pos: pd.Series, neg: pd.Series) -> pd.Series:
        n = np.full(len(pos), pos_all)
        return pd.Series(special.upper_tails(pos, n, pos + neg, n + neg_all))

    return counts.withColumn("p_value", tail("pos", "neg"))


def discriminative_words(df: DataFrame, k: int = 6, beam: int = 30, most: int = 5, most_e: float = 0.05, both_strands: bool = True, id_col: str = "seq_id", seq: str = "seq", positive: str = "positive") -> DataFrame:
    """Patterns of k letters that more of the positive sequences hold than of the others, best first.

    (rank, pattern, pos, neg, pos_all, neg_all, p_value, e_value). Sequences, not occurrences, are counted, all of
    them in every round. A search begins with the ``beam`` words of least p, replaces one letter at a time by a wider
    ambiguity code, and goes on with the best ``beam`` patterns as long as the best improves. E is p times the
    patterns tested. The best pattern's sites become gaps, and the search begins anew, until E exceeds most_e or
    ``most`` patterns are found. Ties go to the pattern first in order.

    Sequences with a null flag are left out; null and short ones count among all but hold nothing. Without positive or
    without other sequences there are no patterns.
    """
    spark = df.sparkSession
    df = df.select(F.col(id_col).alias("seq_id"), F.col(seq).alias("seq"), F.col(positive).alias("positive")).filter("positive is not null")
    pos_all, neg_all = df.agg(F.count_if("positive"), F.count_if(~F.col("positive"))).first()
    found: list[tuple] = []
    while len(found) < most and pos_all and neg_all:
        held = held_words(df, k, both_strands, "seq_id", "seq", "positive").persist()
        try:
            words = _tested(word_counts(held, k), pos_all, neg_all)
            tested = words.count()
            seeds = words.orderBy("p_value", "word").limit(beam).collect()
            known = {r["word"]: (r["p_value"], r["word"], r["pos"], r["neg"]) for r in seeds}
            now = list(known)
            while now:
                before = min(known.values())
                new = sorted({w for p in now for w in wider(p)} - known.keys())
                rows = _tested(pattern_counts(held, new, both_strands), pos_all, neg_all).collect() if new else []  # beam * k * 11 at most
                known |= {r["pattern"]: (r["p_value"], r["pattern"], r["pos"], r["neg"]) for r in rows}
                tested += len(rows)
                now = [p for _, p, *_ in sorted(known[r["pattern"]] for r in rows)[:beam]] if min(known.values()) < before else []
        finally:
            held.unpersist()
        if not known:
            break
        p, pattern, pos, neg = min(known.values())
        if p * tested > most_e:
            break
        found.append((len(found) + 1, pattern, pos, neg, pos_all, neg_all, p, min(p * tested, float(tested))))
        for one in dict.fromkeys((pattern, reverse_pattern(pattern))[: 1 + both_strands]):
            df = df.withColumn("seq", F.regexp_replace("seq", "".join(f"[{CODES[c]}]" for c in one), "N" * k))
    return spark.createDataFrame(found, "rank int, pattern string, pos long, neg long, pos_all long, neg_all long, p_value double, e_value double")


def _codes(batch: pa.RecordBatch, column: int) -> np.ndarray:
    """The texts of a batch side by side, a gap behind each."""
    return np.concatenate([x for codes in Q._texts(batch, column) for x in (codes, _GAP)])


def _centres(codes: np.ndarray, k: int, flank: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the windows without gaps, and their inner words of k letters as numbers to base 4."""
    span = k + 2 * flank
    size = max(0, len(codes) - span + 1)
    gaps = np.concatenate(([0], np.cumsum(codes == 4)))
    at = np.flatnonzero(gaps[span : span + size] == gaps[:size])
    word = np.zeros(size, np.int64)
    for j in range(k):
        word = word * 4 + codes[flank + j : flank + j + size]
    return at, word[at]


def _counted(words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The different words, in order, and how often each occurs."""
    if k > 8:
        return np.unique(words, return_counts=True)
    n = np.bincount(words)
    there = np.flatnonzero(n)
    return there, n[there]


def _columns(codes: np.ndarray, at: np.ndarray, span: int) -> np.ndarray:
    """How often each letter stands in each column of windows."""
    return np.concatenate([np.bincount(codes[at + j], minlength=4)[:4] for j in range(span)])


_GAP = np.full(1, 4, np.uint8)


def seed_profiles(df: DataFrame, group: str, k: int = 6, flank: int = 3, pseudo: float = 1.0, id_col: str = "seq_id", seq: str = "seq") -> DataFrame:
    """(motif, freqs) for each group of sequences: its commonest word of k letters, with the letters beside it, over
    all places where it stands. Ties go to the word first in order; places too near an end are left out.

    Sequences of a group meet, as letters, not as a row for each window. Groups of more than Q.BLOCK letters, which are
    few for any table, stay where they are: their words are counted in blocks, and then the letters about the commonest.
    """
    if not 1 <= k <= LONGEST_WORD:
        raise ValueError(f"a word has 1 to {LONGEST_WORD} letters")
    span, block = k + 2 * flank, Q.BLOCK
    frame = cut(df.select(F.col(group).alias("motif"), F.col(seq).alias("seq")).filter(F.col("motif").isNotNull() & (F.length("seq") >= span)))
    name = frame.schema["motif"]
    large = cut(frame.groupBy("motif").agg(F.sum(F.length("seq")).alias("n")).filter(F.col("n") > block).select("motif"))
    schema = T.StructType([name, T.StructField("freqs", T.ArrayType(T.DoubleType()))])
    arrow = to_arrow_schema(schema)

    def profile(names: list, batch: pa.RecordBatch) -> pa.RecordBatch:
        """A row of names for each run of equal names: they are one group."""
        out, found = [], []
        edges = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            codes = _codes(batch.slice(a, b - a), 1)
            at, words = _centres(codes, k, flank)
            if len(at):
                its, n = _counted(words, k)
                top = int(n.argmax())
                out.append((_columns(codes, at[words == its[top]], span) + pseudo) / (n[top] + 4 * pseudo))
                found.append(names[a])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * (4 * span)), pa.array(np.concatenate([*out, np.zeros(0)])))
        return pa.RecordBatch.from_arrays([pa.array(found, arrow.field(0).type), lists.cast(arrow.field(1).type)], schema=arrow)

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch.cast(held.schema)]).combine_chunks().to_batches()[0]
            names = batch.column(0).to_pylist()
            whole = len(names)  # the last group may go on
            while whole and names[whole - 1] == names[-1]:
                whole -= 1
            held = batch.slice(whole)
            if whole:
                yield profile(names[:whole], batch)
        if held is not None:
            yield profile(held.column(0).to_pylist(), held)

    rest = frame.join(F.broadcast(large), "motif", "left_anti")  # not more of them than letters hold blocks
    out = rest.repartition("motif").sortWithinPartitions("motif").mapInArrow(small, schema)
    if large.isEmpty():
        return out

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, np.ndarray]]:
        """Letters of a group, about as many as a block has with those of the others."""
        size, mine = 0, {}
        for batch in batches:
            for g, codes in zip(batch.column(0).to_pylist(), Q._texts(batch, 1), strict=True):
                for a in range(0, len(codes), block):
                    part = codes[a : a + block + span - 1]
                    mine.setdefault(g, []).extend([part, _GAP])
                    size += len(part)
                    if size > block:
                        yield from ((g, np.concatenate(some)) for g, some in mine.items())
                        size, mine = 0, {}
        yield from ((g, np.concatenate(some)) for g, some in mine.items())

    def summed(batches: Iterator[pa.RecordBatch], rows) -> Iterator[pa.RecordBatch]:
        """What rows(group, codes) counts, as (group, what, n): the sums of a task, as long as they are not many."""
        held: dict = {}

        def out() -> Iterator[pa.RecordBatch]:
            for g, (what, n) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(n), arrow.field(0).type), pa.array(what), pa.array(n)], schema=pa.schema([arrow.field(0), ("what", pa.int64()), ("n", pa.int64())]))

        for g, codes in blocks(batches):
            what, n = rows(g, codes)
            if g in held:
                both, at = np.unique(np.concatenate([held[g][0], what]), return_inverse=True)
                what, n = both, np.bincount(at, np.concatenate([held[g][1], n]), len(both)).astype(np.int64)
            held[g] = what, n
            if sum(len(n) for _, n in held.values()) > block:
                yield from out()
                held.clear()
        yield from out()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from summed(batches, lambda g, codes: _counted(_centres(codes, k, flank)[1], k))

    sums = T.StructType([name, T.StructField("what", T.LongType()), T.StructField("n", T.LongType())])
    many = frame.join(F.broadcast(large), "motif", "left_semi")
    counts = many.mapInArrow(count, sums).groupBy("motif", "what").agg(F.sum("n").alias("n"))
    tops = {r["motif"]: r["word"] for r in counts.groupBy("motif").agg(F.min_by("what", F.struct(F.negative("n"), "what")).alias("word")).collect()}  # a word for each of the few

    def letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(g, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at, words = _centres(codes, k, flank)
            return np.arange(4 * span), _columns(codes, at[words == tops.get(g, -1)], span)

        yield from summed(batches, rows)

    cells = many.mapInArrow(letters, sums).groupBy("motif", "what").agg(F.sum("n").alias("n"))
    cells = cells.groupBy("motif").agg(F.array_sort(F.collect_list(F.struct("what", "n"))).alias("n"))
    total = F.col("n")[0]["n"] + F.col("n")[1]["n"] + F.col("n")[2]["n"] + F.col("n")[3]["n"]
    cells = cells.filter(total > 0).select("motif", F.transform("n", lambda x: (x["n"] + pseudo) / (total + 4 * pseudo)).alias("freqs"))
    return out.union(cells)
