"""Sequence operators: k-mers, Markov models, background and motif scores, profiles, logos, column dependency.

Sequences are rows (seq_id, seq) of capital letters; what is not A, C, G or T is a gap. Positions are 0-based.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions.scalar import reverse_complement

BASES = "ACGT"


#: Letters of the stretches that a text is cut into, at least; they are cut out of stretches of as many stretches.
STRETCH = 128


def pieces(df: DataFrame, seq: str, behind: int, ahead: int, *keep: str) -> DataFrame:
    """Stretches of every text, one a row: (keep..., at, left, text, right), with so many letters before and after.

    A text is cut twice, each time in one pass, so that its length costs in proportion, and no row carries all of it.
    """
    size = max(STRETCH, behind, ahead)

    def cut(text: Column, n: int) -> Column:
        return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % n), F.lit(0))

    def beside(parts: Column, before: Column, after: Column) -> Column:
        first = F.concat(F.array(F.right(before, F.lit(behind))), F.transform(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.right(x, F.lit(behind))))
        last = F.concat(F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda x: F.left(x, F.lit(ahead))), F.array(F.left(after, F.lit(ahead))))
        return F.zip_with(F.zip_with(parts, first, lambda t, l: F.struct(t.alias("text"), l.alias("left"))), last, lambda x, r: F.struct(x["text"].alias("text"), x["left"].alias("left"), r.alias("right")))

    def rows(d: DataFrame, text: str, n: int, before: Column, after: Column) -> DataFrame:
        d = d.withColumn("__parts", cut(F.col(text), n))
        return d.select(*[c for c in d.columns if c not in (text, "__parts")], F.posexplode(beside(F.col("__parts"), before, after)).alias("__i", "__x"))

    coarse = rows(df.select(*keep, F.col(seq).alias("__seq")).filter("length(__seq) > 0"), "__seq", size * STRETCH, F.lit(""), F.lit(""))
    coarse = coarse.select(*keep, (F.col("__i") * (size * STRETCH)).alias("__at"), F.col("__x.text").alias("__t"), F.col("__x.left").alias("__l"), F.col("__x.right").alias("__r"))
    fine = rows(coarse, "__t", size, F.col("__l"), F.col("__r"))
    return fine.select(*keep, (F.col("__at") + F.col("__i") * size).alias("at"), "__x.left", "__x.text", "__x.right")


def _words(k: int) -> Column:
    """The words of k letters that begin in a stretch."""
    whole = F.concat("text", "right")
    n = F.least(F.length("text"), F.length("text") + F.length("right") - (k - 1))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(whole, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def kmers(df: DataFrame, k: int, id_col: str = "seq_id", seq: str = "seq") -> DataFrame:
    """(id, pos, kmer) of all windows of k letters."""
    cut = pieces(df, seq, 0, k - 1, id_col)
    return cut.select(id_col, "at", F.posexplode(_words(k)).alias("__p", "kmer")).select(id_col, (F.col("at") + F.col("__p")).alias("pos"), "kmer")


def words_after(df: DataFrame, before: str, k: int, id_col: str = "seq_id", seq: str = "seq") -> DataFrame:
    """(id, kmer) of the words of k bases that follow a word, wherever that stands; only these become rows."""
    words = F.regexp_extract_all(seq, F.lit(f"(?={before}([ACGT]{{{int(k)}}}))"), F.lit(1))
    return df.select(id_col, F.explode(words).alias("kmer"))


def valid_sites(df: DataFrame, span: int, both_strands: bool = True, id_col: str = "seq_id", seq: str = "seq") -> DataFrame:
    """(id, pos, kmer) of the windows without gaps, on the sequence and, further on, its reverse complement.

    Windows do not cross from one strand to the other: the strands are cut separately.
    """
    plus = df.select(id_col, F.lit(0).alias("__n"), F.col(seq).alias("__s"))
    if both_strands:
        plus = plus.unionByName(df.select(id_col, F.length(seq).alias("__n"), reverse_complement(F.col(seq)).alias("__s")))
    cut = pieces(plus, "__s", 0, span - 1, id_col, "__n")
    cut = cut.select(id_col, (F.col("at") + F.col("__n")).alias("__at"), F.posexplode(_words(span)).alias("__p", "kmer"))
    return cut.filter(F.translate("kmer", BASES, "") == "").select(id_col, (F.col("__at") + F.col("__p")).alias("pos"), "kmer")


def valid_site_counts(df: DataFrame, span: int, both_strands: bool = True, id_col: str = "seq_id", seq: str = "seq") -> DataFrame:
    """(id, n) of the valid_sites of each id that has some, counted from the stretches between gaps: no row for a window."""
    stretches = F.regexp_extract_all(seq, F.lit(f"[{BASES}]{{{int(span)},}}"), F.lit(0))
    n = F.aggregate(stretches, F.lit(0).cast("long"), lambda a, x: a + F.length(x) - (span - 1))
    return df.select(id_col, (n * (2 if both_strands else 1)).alias("n")).groupBy(id_col).agg(F.sum("n").alias("n")).filter("n > 0")


def doubled(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Each sequence with its reverse complement appended."""
    return df.withColumn(seq, F.concat(seq, reverse_complement(F.col(seq))))


def composition(df: DataFrame, seq: str = "seq") -> DataFrame:
    """(base, n) over all sequences, gaps not counted."""
    counts = [F.coalesce(F.sum(F.length(seq) - F.length(F.replace(F.col(seq), F.lit(b), F.lit("")))), F.lit(0)).alias(b) for b in BASES]
    return df.agg(*counts).unpivot([], list(BASES), "base", "n")


def all_words(spark, k: int) -> DataFrame:
    """All 4^k words of k bases: column word."""
    base = F.array(*map(F.lit, BASES))
    word = F.lit("")
    for i in range(k):
        word = F.concat(word, F.get(base, F.floor(F.col("id") / 4 ** (k - 1 - i)).cast("int") % 4))
    return spark.range(4**k).select(word.alias("word"))


#: Letters of words that a task counts in an array, at most 4^10 numbers.
TALLIED = 10


def word_counts(df: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """(word, n) of the words of k bases, 10 at most, that occur, counted in the tasks; each has a row for each word that it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(4**k, np.int64)
        for batch in batches:
            for codes in _texts(batch, 0):
                for a in range(0, len(codes), BLOCK):
                    part = codes[a : a + BLOCK + k - 1]
                    size = max(0, len(part) - k + 1)
                    word, ok = np.zeros(size, np.int64), np.ones(size, bool)
                    for i in range(k):
                        word = word * 4 + part[i : i + size] % 4
                        ok &= part[i : i + size] < 4
                    word = word[ok]
                    if len(word) < len(n) // 16:
                        np.add.at(n, word, 1)
                    else:
                        n += np.bincount(word, minlength=len(n))
        there = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(n[there])], names=["w", "n"])

    sums = df.select(F.col(seq).alias("__s")).mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
    base = F.array(*map(F.lit, BASES))
    letters = [F.get(base, F.shiftright("w", 2 * (k - 1 - i)).bitwiseAND(F.lit(3).cast("long")).cast("int")) for i in range(k)]
    return sums.select(F.concat(*letters).alias("word"), "n")


def transition_counts(df: DataFrame, order: int, pseudo: int = 1, id_col: str = "seq_id", seq: str = "seq", by: list[str] | None = None) -> DataFrame:
    """(context, base, n) of every context of ``order`` bases, with a pseudocount; dense over 4^(order+1) words.

    With ``by`` (columns of df) a model for each group.
    """
    by = by or []
    k = order + 1
    frame = all_words(df.sparkSession, k)
    if by or k > TALLIED:
        cut = pieces(df, seq, 0, order, *by).select(*by, F.explode(_words(k)).alias("word"))
        counts = cut.groupBy(*by, "word").agg(F.count("*").alias("n")).filter(F.translate("word", BASES, "") == "")
    else:
        counts = word_counts(df, k, seq)
    if by:
        frame = df.select(*by).distinct().join(F.broadcast(frame))  # 4^k words
    dense = frame.join(counts, [*by, "word"], "left")
    return dense.select(*by, F.substring("word", 1, order).alias("context"), F.substring("word", k, 1).alias("base"), (F.coalesce("n", F.lit(0)) + pseudo).alias("n"))


def transition_probabilities(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts as conditional probabilities of the base given the context."""
    w = W.partitionBy(*(by or []), "context")
    return counts.withColumn("prob", F.col("n") / F.sum("n").over(w))


def marginal(counts: DataFrame) -> DataFrame:
    """Counts of order k summed to order k-1: the oldest base of the context goes."""
    return counts.groupBy(F.expr("substring(context, 2)").alias("context"), "base").agg(F.sum("n").alias("n"))


def markov_models(df: DataFrame, order: int, pseudo: int = 1, seq: str = "seq") -> DataFrame:
    """(context, base, prob) of all orders 0..order over sequences and their reverse complements, with the
    words across the junction, as one table; the length of the context tells the order."""
    both = doubled(df, seq)
    out = None
    for k in range(order + 1):
        m = transition_probabilities(transition_counts(both, k, pseudo, seq=seq)).select("context", "base", "prob")
        out = m if out is None else out.unionByName(m)
    return out


def log_tables(models: DataFrame, order: int) -> list[np.ndarray]:
    """For k = 0..order the log-probabilities of a base after k others, in the order of the words of k + 1 letters.

    The models are collected: 4^(order+1) rows and a third more.
    """
    out = [np.full(4 ** (k + 1), np.nan) for k in range(order + 1)]
    for r in models.filter(F.length("context") <= order).collect():
        at = 0
        for c in r.context + r.base:
            at = 4 * at + BASES.index(c)
        out[len(r.context)][at] = math.log(r.prob)
    return out


_CODES = np.full(256, 4, np.uint8)
_CODES[list(b"ACGT")] = range(4)
#: Letters of a text that are scored at once.
BLOCK = 1 << 20


def _by_context(codes: np.ndarray, tables: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Log-probability of each letter given as much context as there is, and given exactly k letters; nan where there
    is a gap among them."""
    n, given = len(codes), []
    word, ok = np.zeros(n, np.int64), np.ones(n, bool)
    best = np.full(n, np.nan)
    for k, table in enumerate(tables):
        # the letter k places before becomes the first of the word
        word[k:] += codes[: n - k].astype(np.int64) % 4 * 4**k
        ok[k:] &= codes[: n - k] < 4
        ok[:k] = False
        value = np.where(ok, table[word], np.nan)
        given.append(value)
        best = np.where(ok, value, best)
    return best, given


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[np.ndarray]:
    for text in batch.column(column):
        yield _CODES[np.frombuffer(text.as_py().encode("ascii", "replace") if text.is_valid else b"", np.uint8)]  # a byte a letter


def _words_of(codes: np.ndarray, at: np.ndarray, span: int) -> pa.Array:
    """The words of ``span`` letters at some places, as strings."""
    raw = np.frombuffer(b"ACGTN", np.uint8)[codes]
    rows = np.lib.stride_tricks.sliding_window_view(raw, span)[at] if len(at) else np.zeros((0, span), np.uint8)
    return pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer((np.arange(len(at) + 1) * span).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _strands(df: DataFrame, id_col: str, seq: str) -> DataFrame:
    plus = df.select(F.lit(1).alias("strand"), F.col(seq).alias("__s"), id_col)
    return plus.unionByName(df.select(F.lit(-1).alias("strand"), reverse_complement(F.col(seq)).alias("__s"), id_col))


#: Rows that go back to Spark together, about.
ROWS = 1 << 15


def _scored(df: DataFrame, id_col: str, seq: str, behind: int, ahead: int, added: list[T.StructField], score, doubled: bool = False) -> DataFrame:
    """(id, strand, pos, added...) of both strands. Texts are scored in blocks with so many letters before and after:
    score(codes, first, n) gives, for places first..first+n, which of them count and the added columns of those.
    With ``doubled``, places of the other strand count on from the end of the text."""
    frame = _strands(df, id_col, seq)
    schema = T.StructType([frame.schema[id_col], T.StructField("strand", T.IntegerType()), T.StructField("pos", T.IntegerType()), *added])

    def together(batch: pa.RecordBatch, rows: list, places: list, columns: list) -> pa.RecordBatch:
        row = pa.array(np.concatenate(rows))
        values = [pa.concat_arrays(c) for c in zip(*columns, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(2).take(row), batch.column(0).take(row), pa.array(np.concatenate(places).astype(np.int32)), *values], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places, columns, held = [], [], [], 0
            strands = batch.column(0).to_numpy()
            for i, codes in enumerate(_texts(batch, 1)):
                for a in range(0, len(codes), BLOCK):
                    first = max(0, a - behind)
                    at, values = score(codes[first : a + BLOCK + ahead], a - first, min(BLOCK, len(codes) - a))
                    if len(at):
                        rows.append(np.full(len(at), i))
                        places.append(at + (first + len(codes) if doubled and strands[i] < 0 else first))
                        columns.append(values)
                        held += len(at)
                    if held >= ROWS:
                        yield together(batch, rows, places, columns)
                        rows, places, columns, held = [], [], [], 0
            if held:
                yield together(batch, rows, places, columns)

    return frame.select("strand", "__s", id_col).mapInArrow(run, schema)


def letter_probabilities(df: DataFrame, models: DataFrame, order: int, id_col: str = "seq_id", seq: str = "seq") -> DataFrame:
    """(id, strand, pos, base, lp): log-probability of each letter given as much context as its strand and the
    last gap allow, on both strands. Gaps have a null and the base N."""
    tables = log_tables(models, order)

    def score(codes, first, n):
        at = np.arange(first, first + n)
        best = _by_context(codes, tables)[0][at]
        return at, [_words_of(codes, at, 1), pa.array(best, mask=np.isnan(best))]

    return _scored(df, id_col, seq, order, 0, [T.StructField("base", T.StringType()), T.StructField("lp", T.DoubleType())], score)


def window_logs(codes: np.ndarray, first: int, past: int, tables: list[np.ndarray], span: int, how: str) -> tuple[np.ndarray, np.ndarray]:
    """The places from first on, before past, of the windows without gaps, and the log-probabilities of those."""
    order = len(tables) - 1
    at = np.arange(first, max(first, min(past, len(codes) - span + 1)))
    gaps = np.concatenate(([0], np.cumsum(codes == 4)))
    at = at[gaps[at + span] == gaps[at]]
    best, given = _by_context(codes, tables)
    # sums of stretches side by side; only then are the windows taken out
    low, size = first, len(codes) - span + 1
    size = max(0, min(past, size) - first)
    if how == "site":
        return at, sum((given[min(m, order)][low + m : low + m + size] for m in range(span)), np.zeros(size))[at - low]
    if how in ("gmean", "amean"):
        other = _by_context(np.where(codes < 4, 3 - codes, 4).astype(np.uint8)[::-1], tables)[0][::-1]
        best = (best + other) / 2 if how == "gmean" else np.log((np.exp(best) + np.exp(other)) / 2)
    total = sum((best[low + m : low + m + size] for m in range(span)), np.zeros(size))
    for k in range(order if how == "flank" else 0):
        a = low + span
        n = max(0, min(size, len(codes) - a - k))  # the others end before
        # up to the first gap
        total[:n] += np.where(gaps[a + k + 1 : a + k + 1 + n] > gaps[a : a + n], 0.0, best[a + k : a + k + n] - given[k][a + k : a + k + n])
    total = total[at - low]
    return at, total


#: Ways to score the background of a window.
BACKGROUNDS = ("plain", "flank", "site", "gmean", "amean")


def background_scores(df: DataFrame, models: DataFrame, order: int, span: int, id_col: str = "seq_id", seq: str = "seq", how: str = "plain") -> DataFrame:
    """(id, strand, pos, kmer, log_bg) of every valid window: the log-probability of its letters in place.

    ``plain``: each letter given what stands before it. ``flank``: also what the window tells of the ``order`` letters
    after it, their probability in place against that without it, up to a gap or the end of the strand. ``site``: the
    context of a letter begins with the window. ``gmean`` and ``amean``: the geometric and arithmetic mean of a
    letter's probabilities on both strands. There is no shuffle, and a text of any length is scored in blocks.
    """
    if how not in BACKGROUNDS:
        raise ValueError(f"how must be one of {BACKGROUNDS}")
    tables = log_tables(models, order)

    def score(codes, first, n):
        at, total = window_logs(codes, first, first + n, tables, span, how)
        return at, [_words_of(codes, at, span), pa.array(total)]

    return _scored(df, id_col, seq, order, span - 1 + order, [T.StructField("kmer", T.StringType()), T.StructField("log_bg", T.DoubleType())], score)


def background_totals(df: DataFrame, models: DataFrame, order: int, span: int, id_col: str = "seq_id", seq: str = "seq", how: str = "plain") -> DataFrame:
    """(id, strand, n, total, most) over the background_scores of each strand: their number, sum and largest. A block of
    a text gives one row."""
    if how not in BACKGROUNDS:
        raise ValueError(f"how must be one of {BACKGROUNDS}")
    tables = log_tables(models, order)

    def score(codes, first, n):
        at, logs = window_logs(codes, first, first + n, tables, span, how)
        return at[:1], [pa.array([len(at)]), pa.array([logs.sum()]), pa.array([logs.max()])] if len(at) else []

    added = [T.StructField("n", T.LongType()), T.StructField("total", T.DoubleType()), T.StructField("most", T.DoubleType())]
    parts = _scored(df, id_col, seq, order, span - 1 + order, added, score)
    return parts.groupBy(id_col, "strand").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("most").alias("most"))


def site_backgrounds(sites: DataFrame, df: DataFrame, models: DataFrame, order: int, span: int, id_col: str = "seq_id", seq: str = "seq", how: str = "plain") -> DataFrame:
    """The background_scores of sites (id, strand, pos) alone: only the letters that count for a site are scored."""
    text = F.when(F.col("strand") > 0, F.col(seq)).otherwise(reverse_complement(F.col(seq)))
    before = F.least(F.col("pos"), F.lit(order))
    part = F.substring(text, F.col("pos") - before + 1, before + span + order)
    parts = sites.select(id_col, "strand", "pos").distinct().join(df.select(id_col, seq), id_col)
    parts = parts.select(F.struct(id_col, "strand", "pos", before.alias("before")).alias("__site"), part.alias("__part"))
    scored = background_scores(parts, models, order, span, "__site", "__part", how).filter("strand = 1 and pos = __site.before")
    return scored.select(f"__site.{id_col}", "__site.strand", "__site.pos", "kmer", "log_bg")


def position_counts(sites: DataFrame, kmer: str = "kmer") -> DataFrame:
    """(col, base, n) of aligned words, dense over the bases."""
    letters = sites.select(F.posexplode(F.filter(F.split(kmer, ""), lambda c: c != "")).alias("col", "base"))
    wide = letters.groupBy("col").pivot("base", list(BASES)).count().na.fill(0)
    return wide.unpivot(["col"], list(BASES), "base", "n")


def position_profile(sites: DataFrame, pseudo: float = 0.0, kmer: str = "kmer") -> DataFrame:
    """(col, base, n, freq)."""
    counts = position_counts(sites, kmer)
    total = F.sum(F.col("n") + pseudo).over(W.partitionBy("col"))
    return counts.withColumn("freq", (F.col("n") + pseudo) / total)


def consensus(profile: DataFrame, least: float = 0.5) -> DataFrame:
    """(col, letter): the base with more than ``least`` of a column, else N."""
    g = profile.groupBy("col").agg(F.max_by("base", F.struct("freq", "base")).alias("b"), F.max("freq").alias("f"))
    return g.select("col", F.when(F.col("f") > least, F.col("b")).otherwise("N").alias("letter"))


def flank_profile(sites: DataFrame, df: DataFrame, span: int, flank: int = 5, id_col: str = "seq_id", seq: str = "seq") -> DataFrame:
    """(offset, base, n) of the letters beside sites (id, pos): -flank..-1 before, 1..flank after; X off the ends."""
    j = sites.join(df, id_col)
    off = F.explode(F.concat(F.sequence(F.lit(-flank), F.lit(-1)), F.sequence(F.lit(1), F.lit(flank))))
    j = j.select(seq, "pos", off.alias("offset"))
    at = F.when(F.col("offset") < 0, F.col("pos") + F.col("offset")).otherwise(F.col("pos") + span + F.col("offset") - 1)
    letter = F.when((at < 0) | (at >= F.length(seq)), "X").otherwise(F.substring(seq, F.greatest(at, F.lit(0)) + 1, F.lit(1)))
    return j.withColumn("base", letter).groupBy("offset", "base").agg(F.count("*").alias("n"))


def logo_heights(sites: DataFrame, kmer: str = "kmer", symbols: int = 4) -> DataFrame:
    """(col, base, n, freq, height): information of the column with the small-sample correction times the share."""
    letters = sites.select(F.posexplode(F.filter(F.split(kmer, ""), lambda c: c != "")).alias("col", "base"))
    letters = letters.filter(F.col("base").rlike("[A-Za-z]"))
    g = letters.groupBy("col", "base").agg(F.count("*").alias("n"))
    w = W.partitionBy("col")
    g = g.withColumn("total", F.sum("n").over(w)).withColumn("freq", F.col("n") / F.col("total"))
    g = g.withColumn("entropy", -F.sum(F.col("freq") * F.log2("freq")).over(w))
    error = F.lit((symbols - 1) / (2 * math.log(2))) / F.col("total")
    r = F.lit(math.log2(symbols)) - (F.col("entropy") + error)
    return g.withColumn("height", F.col("freq") * r).select("col", "base", "n", "freq", "height")


def column_information(profile: DataFrame) -> DataFrame:
    """(col, bits): 2 + sum p log2 p."""
    p = F.col("freq")
    return profile.groupBy("col").agg((2 + F.sum(F.when(p > 1e-10, p * F.log2(p)).otherwise(0.0))).alias("bits"))


def letter_rows(sites: DataFrame, id_col: str = "seq_id", kmer: str = "kmer") -> DataFrame:
    return sites.select(id_col, F.posexplode(F.filter(F.split(kmer, ""), lambda c: c != "")).alias("col", "base"))


def informative_pairs(profile: DataFrame, low: float = 0.25, high: float = 1.75) -> DataFrame:
    """(col1, col2) of the columns whose information lies in the range."""
    c = column_information(profile).filter(F.col("bits").between(low, high)).select("col")
    return c.select(F.col("col").alias("col1")).join(c.select(F.col("col").alias("col2")), F.expr("col1 < col2"))


def column_pairs(sites: DataFrame, id_col: str = "seq_id", kmer: str = "kmer") -> DataFrame:
    """(col1, col2, base1, base2, n): contingency tables of all pairs of columns."""
    chars = F.filter(F.split(kmer, ""), lambda c: c != "")
    d = sites.select(chars.alias("l"))
    d = d.select("l", F.posexplode("l").alias("col1", "base1")).select("l", "col1", "base1", F.posexplode("l").alias("col2", "base2")).filter("col1 < col2")
    return d.groupBy("col1", "col2", "base1", "base2").agg(F.count("*").alias("n"))


def mutual_information(sites: DataFrame, id_col: str = "seq_id", kmer: str = "kmer") -> DataFrame:
    """(col1, col2, bits) for all pairs of columns."""
    c = column_pairs(sites, id_col, kmer)
    w = W.partitionBy("col1", "col2")
    c = c.withColumns({"t": F.sum("n").over(w), "n1": F.sum("n").over(W.partitionBy("col1", "col2", "base1")), "n2": F.sum("n").over(W.partitionBy("col1", "col2", "base2"))})
    bit = F.col("n") / F.col("t") * F.log2(F.col("n") * F.col("t") / (F.col("n1") * F.col("n2")))
    return c.groupBy("col1", "col2").agg(F.sum(bit).alias("bits"))


def contingency(sites: DataFrame, id_col: str = "seq_id", kmer: str = "kmer") -> DataFrame:
    """Observed and expected (rounded half up) counts of all cells of all pairs of columns."""
    c = column_pairs(sites, id_col, kmer)
    m1 = c.groupBy("col1", "col2", "base1").agg(F.sum("n").alias("n1"))
    m2 = c.groupBy("col1", "col2", "base2").agg(F.sum("n").alias("n2"))
    t = c.groupBy("col1", "col2").agg(F.sum("n").alias("t"))
    cells = m1.join(m2, ["col1", "col2"]).join(t, ["col1", "col2"]).join(c, ["col1", "col2", "base1", "base2"], "left")
    return cells.select("col1", "col2", "base1", "base2", F.coalesce("n", F.lit(0)).alias("observed"), F.floor(F.col("n1") * F.col("n2") / F.col("t") + 0.5).cast("long").alias("expected"))


def _log_beta_ratio(n: int, total: int, weight: float) -> float:
    """log of the Beta prior for n of total sequences having a site, relative to a site in none."""
    p = weight * total
    return math.lgamma(n + p) + math.lgamma(total - n + p) - math.lgamma(p) - math.lgamma(total + p)


def clr_score(sites: DataFrame, background: DataFrame, n_valid: DataFrame, zoops: float | None = None, id_col: str = "seq_id") -> DataFrame:
    """One row (clr): sum over sites of log frequency minus log background, with the prior of sites.

    sites: (id, strand, pos); background: background_scores; n_valid: (id, n_valid). With ``zoops`` the Beta prior of
    that weight and the uniform choice of a site in each sequence count too.
    """
    s = sites.join(background, [id_col, "strand", "pos"]).join(n_valid, id_col)
    f = position_profile(s).filter("n > 0").agg(F.sum(F.col("n") * F.log("freq")).alias("lf"))
    b = s.agg(F.sum("log_bg").alias("lb"), F.count("*").alias("n"), F.sum(F.log("n_valid")).alias("lv"))
    out = f.join(F.broadcast(b))
    if zoops is None:
        return out.select((F.col("lf") - F.col("lb")).alias("clr"))
    total = n_valid.count()
    n = sites.count()
    return out.select((F.col("lf") - F.col("lb") - F.col("lv") + F.lit(_log_beta_ratio(n, total, zoops))).alias("clr"))


def _log_profile(profile: DataFrame) -> np.ndarray:
    """(columns, 4): logarithms of the frequencies of a profile."""
    rows = profile.select("col", "base", F.log(F.greatest("freq", F.lit(1e-300))).alias("lf")).collect()  # four for each column of the motif
    table = np.full((1 + max((r["col"] for r in rows), default=-1), 4), math.log(1e-300))
    for r in rows:
        table[r["col"], BASES.index(r.base)] = r.lf
    return table


def _profile_logs(codes: np.ndarray, at: np.ndarray, table: np.ndarray) -> np.ndarray:
    total = np.zeros(len(at))
    for c, column in enumerate(table):
        total += column[codes[at + c]]
    return total


def site_ratios(background: DataFrame, profile: DataFrame, id_col: str = "seq_id") -> DataFrame:
    """(id, strand, pos, llr): log likelihood ratio of the profile to the background, at every valid window."""
    table = _log_profile(profile)
    names = [id_col, "strand", "pos", "kmer"]
    width = len(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = _CODES[np.frombuffer("".join(batch.column(3).to_pylist()).encode(), np.uint8)].reshape(-1, width)
            total = np.zeros(len(codes))
            for c in range(width):
                total += table[c][codes[:, c]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(total - batch.column(4).to_numpy())], names=[*names, "llr"])

    frame = background.select(*names, "log_bg")
    return frame.mapInArrow(run, T.StructType([*frame.schema.fields[:4], T.StructField("llr", T.DoubleType())]))


def ilr_score(background: DataFrame, profile: DataFrame, id_col: str = "seq_id") -> DataFrame:
    """(id, ilr): log of the mean likelihood ratio over a sequence's valid windows.

    Ratios are summed where they are, a row for each run of windows of one sequence, relative to the largest of the
    run; only these rows are shuffled.
    """
    r = site_ratios(background, profile, id_col).select(id_col, "llr")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                ids, llr = batch.column(0), batch.column(1).to_numpy()
                same = pc.equal(ids.slice(1), ids.slice(0, n - 1)).fill_null(False).to_numpy(zero_copy_only=False)
                first = np.flatnonzero(np.concatenate(([True], ~same)))
                size = np.diff(np.append(first, n))
                most = np.maximum.reduceat(llr, first)
                total = np.add.reduceat(np.exp(llr - np.repeat(most, size)), first)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(first)), pa.array(most), pa.array(total), pa.array(size)], names=names)

    names = [id_col, "__m", "__s", "__n"]
    schema = T.StructType([r.schema[id_col], T.StructField("__m", T.DoubleType()), T.StructField("__s", T.DoubleType()), T.StructField("__n", T.LongType())])
    return _joined_ratios(r.mapInArrow(run, schema), id_col)


def _joined_ratios(parts: DataFrame, id_col: str) -> DataFrame:
    """(id, ilr) of (id, __m, __s, __n): the largest ratio of some windows, the sum relative to it and their number; a
    long text has several such rows."""
    top = F.max("__m").over(W.partitionBy(id_col))
    g = parts.withColumn("__top", top).groupBy(id_col).agg(F.max("__top").alias("m"), F.sum(F.col("__s") * F.exp(F.col("__m") - F.col("__top"))).alias("s"), F.sum("__n").alias("n"))
    return g.select(id_col, (F.col("m") + F.log("s") - F.log("n")).alias("ilr"))


def sequence_ratios(df: DataFrame, models: DataFrame, profile: DataFrame, order: int, id_col: str = "seq_id", seq: str = "seq", how: str = "plain") -> DataFrame:
    """What ilr_score gives of background_scores, without a row for each window: a block of a text gives one row."""
    if how not in BACKGROUNDS:
        raise ValueError(f"how must be one of {BACKGROUNDS}")
    tables, table = log_tables(models, order), _log_profile(profile)

    def score(codes, first, n):
        at, logs = window_logs(codes, first, first + n, tables, len(table), how)
        if not len(at):
            return at, []
        llr = _profile_logs(codes, at, table) - logs
        most = llr.max()
        return at[:1], [pa.array([most]), pa.array([np.exp(llr - most).sum()]), pa.array([len(at)])]

    added = [T.StructField("__m", T.DoubleType()), T.StructField("__s", T.DoubleType()), T.StructField("__n", T.LongType())]
    return _joined_ratios(_scored(df, id_col, seq, order, len(table) - 1 + order, added, score).drop("strand", "pos"), id_col)


def best_sites(background: DataFrame, profile: DataFrame, n: int, id_col: str = "seq_id") -> DataFrame:
    """The best window of each sequence, of which the n best stay: (id, strand, pos, kmer, llr)."""
    r = site_ratios(background, profile, id_col)
    best = r.groupBy(id_col).agg(F.max_by(F.struct("strand", "pos", "kmer", "llr"), F.struct("llr", "strand", F.negative("pos"))).alias("x")).select(id_col, "x.*")
    return best.orderBy(F.desc("llr"), id_col).limit(n)


def fold_prior(background: DataFrame, prior: DataFrame, n_valid: DataFrame, id_col: str = "seq_id") -> DataFrame:
    """Background divided by a position-specific prior (id, strand, pos, prior) times the number of valid windows."""
    j = background.join(prior, [id_col, "strand", "pos"]).join(n_valid, id_col)
    total = F.sum("prior").over(W.partitionBy(id_col))
    return j.withColumn("log_bg", F.col("log_bg") - F.log(F.col("prior") / total * F.col("n_valid"))).select(*background.columns)


def reverse_profile(profile: DataFrame) -> DataFrame:
    """The profile of the other strand."""
    last = F.max("col").over(W.partitionBy(F.lit(0)))
    return profile.withColumns({"col": last - F.col("col"), "base": F.translate("base", "ACGT", "TGCA")})


def shift_profile(profile: DataFrame, by: int, width: int) -> DataFrame:
    """Columns moved to the left by ``by``; those that leave go, new ones are uniform gaps (is_gap)."""
    spark = profile.sparkSession
    frame = spark.range(width).select(F.col("id").cast("int").alias("col")).select("col", F.explode(F.array(*map(F.lit, BASES))).alias("base"))
    moved = profile.select((F.col("col") - by).alias("col"), "base", "freq")
    return frame.join(moved, ["col", "base"], "left").select("col", "base", F.coalesce("freq", F.lit(0.25)).alias("freq"), F.col("freq").isNull().alias("is_gap"))


def gap_columns(profile: DataFrame, cols: list[int]) -> DataFrame:
    """(col, base, freq, is_gap): columns taken out of a profile. They stay as gaps, uniform and without weight, so
    that the others keep their places; what scores with the profile or draws it leaves them out."""
    was = F.col("is_gap") if "is_gap" in profile.columns else F.lit(False)
    gap = was | F.col("col").isin([int(c) for c in cols])
    return profile.select("col", "base", F.when(gap, F.lit(0.25)).otherwise(F.col("freq")).alias("freq"), gap.alias("is_gap"))


def fill_columns(profile: DataFrame, sites: DataFrame, cols: list[int], pseudo: float = 0.0, kmer: str = "kmer") -> DataFrame:
    """Columns put back, or added at either end: their frequencies come from the aligned words, which must be as wide.

    Columns between the old end and an added one that are not named become gaps.
    """
    wanted = [int(c) for c in cols]
    own = position_profile(sites, pseudo, kmer).filter(F.col("col").isin(wanted)).select("col", "base", F.col("freq").alias("__new"))
    old = profile if "is_gap" in profile.columns else profile.withColumn("is_gap", F.lit(False))
    last = (old.agg(F.max("col")).first()[0] or 0) if not wanted else max([old.agg(F.max("col")).first()[0] or 0, *wanted])
    frame = old.sparkSession.range(last + 1).select(F.col("id").cast("int").alias("col"), F.explode(F.array(*map(F.lit, BASES))).alias("base"))
    out = frame.join(old.select("col", "base", "freq", "is_gap"), ["col", "base"], "left").join(own, ["col", "base"], "left")
    return out.select("col", "base", F.coalesce("__new", "freq", F.lit(0.25)).alias("freq"), (F.col("__new").isNull() & F.coalesce("is_gap", F.lit(True))).alias("is_gap"))


def profile_logo(profile: DataFrame) -> DataFrame:
    """(col, base, height): information of a column times the share of a base; gaps have no height."""
    gap = F.col("is_gap") if "is_gap" in profile.columns else F.lit(False)
    bits = column_information(profile)
    return profile.join(bits, "col").select("col", "base", F.when(gap, F.lit(0.0)).otherwise(F.col("freq") * F.col("bits")).alias("height"))


def scan_profile(df: DataFrame, profile: DataFrame, base_freq: float = 0.25, id_col: str = "seq_id", seq: str = "seq", span: int = 8, above: float | None = None) -> DataFrame:
    """(id, pos, kmer, llr): log-odds of a profile at every valid window of both strands against a uniform background;
    with ``above``, of the windows with more. Places of the other strand count on from the end of the sequence."""
    table = _log_profile(profile)
    if len(table) != span:
        raise ValueError(f"the profile has {len(table)} columns, not {span}")

    def score(codes, first, n):
        at = np.arange(first, max(first, min(first + n, len(codes) - span + 1)))
        gaps = np.concatenate(([0], np.cumsum(codes == 4)))
        at = at[gaps[at + span] == gaps[at]]
        llr = _profile_logs(codes, at, table) - span * math.log(base_freq)
        if above is not None:
            at, llr = at[llr > above], llr[llr > above]
        return at, [_words_of(codes, at, span), pa.array(llr)]

    added = [T.StructField("kmer", T.StringType()), T.StructField("llr", T.DoubleType())]
    return _scored(df, id_col, seq, 0, span - 1, added, score, doubled=True).drop("strand")
