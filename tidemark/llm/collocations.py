"""Phrases whose words occur together far more often than their parts would by chance.

Phrases of 1 to ``max_words`` words are exploded into rows (lang, phrase, number), one length after another, and
hash-aggregated for each language. A phrase cannot reach the count unless its first and its last words but one do,
so a window is exploded only if both are in the table of the length before; this is exact, and tests compare it with
counting everything. Counts of the parts are joined, the score is an integer division of decimals, phrases that
one-word extensions account for are anti-joined, and the rest is ranked.

A task counts the windows of a bounded part of a language's texts in arrays and hands each phrase on once a part.
The table of the length before reaches the tasks as a Bloom filter. It is sized from the number of phrases, up to
``MOST_BITS``; what it lets through wrongly is counted and falls below the count. Beyond that size it lets more
through, which costs rows to aggregate and changes no result.

Defined results: a null text is empty; a null language is ``und``, as is the language of that name; repeated rows
count as often as they occur; ties in score go to the larger count, then to the phrase that is first in byte order;
texts of any length are read in bounded parts; an empty table gives no rows; other columns are not looked at.
Numbers are exact while 1000 * a * n and l * r stay below 10^38.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .common import Scratch, WordHash, mix, odd, read, released

#: Bytes of texts whose words are in memory at a time.
CHUNK = 2 << 20
#: Bits of a filter: so many for each phrase, and at most (32 MB).
BITS_EACH, MOST_BITS = 16, 1 << 28
#: Parts of a language that are ranked apart before the best of all parts are.
PARTS = 64

#: Marks the end of a piece; it separates pieces, so that it is never a word.
_STOP = b"."
_NORMAL = bytes(_STOP[0] if c in b".,;:!?\n\v\f\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_EDGE = re.compile(rb"[ .]")
_COUNTS = "lang string, phrase string, n long"


def _chunks(text: bytes, n: int) -> Iterator[pa.DictionaryArray]:
    """The words and stops of a text in bounded parts, each with the last n - 1 of the part before in front."""
    before, at = b"", 0
    while at < len(text):
        edge = _EDGE.search(text, at + CHUNK)
        past = edge.start() if edge else len(text)
        part = (before + text[at:past].replace(_STOP, b" . ")).strip()
        if part:
            words = pc.ascii_split_whitespace(pa.array([part], pa.string())).flatten()
            yield words.dictionary_encode()
            before = b"".join(w.as_py().encode() + b" " for w in words[max(0, len(words) - n + 1) :])
        at = past


class _Seen:
    """A Bloom filter over phrases: no phrase of the table is missed."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 64 - 1)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for spot in _spots(hashes, self.mask):
            out &= (self.bits[spot >> np.uint64(6)] >> (spot & np.uint64(63))) & np.uint64(1) == 1
        return out


def _spots(hashes: np.ndarray, mask: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    return hashes & mask, (hashes >> np.uint64(32)) & mask


def _hashes(lang: str, words: np.ndarray, n: int) -> np.ndarray:
    """Of every run of n words, given by the hashes of the words."""
    out = np.full(max(len(words) - n + 1, 0), xxhash.xxh3_64_intdigest(lang), np.uint64)
    for k in range(n):
        out += words[k : len(words) - n + 1 + k] * odd(k)
    return mix(out)


def _counted(lang: str, words: pa.DictionaryArray, n: int, seen: _Seen | None, remembered: WordHash) -> tuple[pa.Array, np.ndarray]:
    """The different phrases of n words that may reach the count, and how often they occur."""
    kinds, codes = words.dictionary, words.indices.to_numpy().astype(np.int64)
    stop = kinds.index(_STOP.decode()).as_py()
    if n == 1:
        counts = np.bincount(codes, minlength=len(kinds))
        use = np.arange(len(kinds)) != stop
        return kinds.filter(pa.array(use)), counts[use]
    stops = np.concatenate(([0], np.cumsum(codes == stop)))
    use = stops[n:] == stops[:-n] if len(codes) >= n else np.zeros(0, bool)
    if seen is not None:
        hashes = remembered.of([w.encode() for w in kinds.to_pylist()])
        parts = seen(_hashes(lang, hashes, 1))[codes] if n == 2 else seen(_hashes(lang, hashes[codes], n - 1))
        use &= parts[:-1] & parts[1:]
    starts = np.flatnonzero(use)
    if len(kinds) ** n < 1 << 62:  # the words can be told from the key again
        key = codes[starts]
        for k in range(1, n):
            key = key * len(kinds) + codes[starts + k]
        key, counts = np.unique(key, return_counts=True)
        places = [key // len(kinds) ** (n - 1 - k) % len(kinds) for k in range(n)]
    else:
        key = codes[starts]
        for k in range(1, n):  # numbered anew each time, so that the key stays exact
            key = np.unique(key, return_inverse=True)[1] * len(kinds) + codes[starts + k]
        _, first, counts = np.unique(key, return_index=True, return_counts=True)
        places = [codes[starts[first] + k] for k in range(n)]
    return pc.binary_join_element_wise(*[kinds.take(pa.array(p)) for p in places], " "), counts


def phrase_counts(docs: DataFrame, n: int, lang: str, text: str, seen=None) -> DataFrame:
    """(lang, phrase, n): occurrences of phrases of n words inside pieces; with a filter only of those that may count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered = WordHash()
        known = _Seen(seen.value) if seen is not None else None
        for batch in batches:
            texts: dict[str, list[bytes]] = {}
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                texts.setdefault(name, []).append(t.as_py().encode())
            for name, its in texts.items():
                for words in _chunks(_STOP.join(its).translate(_NORMAL), n):
                    phrases, counts = _counted(name, words, n, known, remembered)
                    if len(phrases):
                        yield pa.RecordBatch.from_arrays([pa.repeat(name, len(phrases)), phrases, pa.array(counts, pa.int64())], names=["lang", "phrase", "n"])

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text")).filter("length(text) > 0")
    return rows.mapInArrow(released(run), _COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _filter_of(frequent: DataFrame) -> np.ndarray:
    """The bits of a table's phrases, of a size from their number."""
    size = min(MOST_BITS, max(1 << 16, 1 << (BITS_EACH * frequent.count() - 1).bit_length()))
    mask = np.uint64(size - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered = WordHash()
        for batch in batches:
            made = [_hashes(name, remembered.of(words), len(words)) for name, words in zip(batch.column(0).to_pylist(), (p.as_py().encode().split(b" ") for p in batch.column(1)), strict=True)]
            spots = np.concatenate(_spots(np.concatenate([*made, np.zeros(0, np.uint64)]), mask))
            bit = np.uint64(1) << (spots & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array((spots >> np.uint64(6)).view(np.int64)), pa.array(bit.view(np.int64))], names=["word", "bit"])

    found = frequent.select("lang", "phrase").mapInArrow(run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    bits = np.zeros(size // 64, np.uint64)
    bits[found["word"].to_numpy()] = found["bit"].to_numpy().view(np.uint64)
    return bits


def frequent_phrases(docs: DataFrame, scratch: Scratch, max_words: int, min_count: int, lang: str = "lang", text: str = "text") -> tuple[list[DataFrame], DataFrame]:
    """Tables (lang, phrase, n) of the phrases of 1, 2, ... words that occur min_count times, and words by lang."""
    spark = docs.sparkSession
    words = scratch.cut(phrase_counts(docs, 1, lang, text))
    out = [scratch.cut(words.filter(F.col("n") >= min_count))]
    totals = scratch.cut(words.groupBy("lang").agg(F.sum("n").alias("n")))
    scratch.drop(words)
    for n in range(2, max_words + 1):
        seen = spark.sparkContext.broadcast(_filter_of(out[-1]))
        out.append(scratch.cut(phrase_counts(docs, n, lang, text, seen).filter(F.col("n") >= min_count)))
        seen.destroy()
    return out, totals


def _cut_scores(candidates: DataFrame, parts: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the lowest-scoring cut of every candidate."""

    def part(frame: DataFrame, name: str, count: str) -> DataFrame:
        return frame.select("lang", F.col("phrase").alias(name), F.col("n").alias(count))

    w = F.split("phrase", " ", -1)
    cuts = candidates.select("lang", "phrase", F.col("n").alias("a"), w.alias("w")).select("*", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " ").alias("rest"))
    cuts = cuts.join(part(parts, "first", "l"), ["lang", "first"]).join(part(parts, "rest", "r"), ["lang", "rest"]).join(totals, "lang")
    exact = "cast(%s as decimal(19, 0))"
    score = F.expr(f"(cast(1000 as decimal(4, 0)) * {exact % 'a'} * {exact % 'n'}) div ({exact % 'l'} * {exact % 'r'})")
    least = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c"))
    return least.select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")


def phrase_collocations(docs: DataFrame, max_words: int = 5, min_count: int = 100, inside_percent: int = 100, top: int = 2000, lang: str = "lang", text: str = "text") -> DataFrame:
    """The best ``top`` phrases of 2 to max_words words of each language: (lang, rank, phrase, a, l, r, n, score).

    A phrase goes if a longer candidate that holds it has inside_percent of its occurrences: as no phrase occurs less
    often than one around it, it is enough to look at candidates of one word more.
    """
    scratch = Scratch(docs.sparkSession)
    tables, totals = frequent_phrases(docs, scratch, max_words, min_count, lang, text)
    candidates, around = tables[1], None
    for shorter, longer in pairwise(tables[1:]):
        candidates = candidates.union(longer)
        w = F.split("phrase", " ", -1)
        inner = longer.select("lang", F.col("n").alias("more"), F.explode(F.array(F.array_join(F.slice(w, F.lit(1), F.size(w) - 1), " "), F.array_join(F.slice(w, F.lit(2), F.size(w) - 1), " "))).alias("phrase"))
        around = inner if around is None else around.union(inner)
    parts = tables[0]
    for table in tables[1:-1]:
        parts = parts.union(table)
    if around is not None:
        around = around.groupBy("lang", "phrase").agg(F.max("more").alias("more"))
        held = candidates.join(around, ["lang", "phrase"], "left").filter(F.expr(f"more is null or 100 * cast(more as decimal(19, 0)) < {int(inside_percent)} * cast(n as decimal(19, 0))"))
        candidates = held.drop("more")
    scored = _cut_scores(candidates, parts, totals)
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    in_part = F.row_number().over(W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*best))
    in_lang = F.row_number().over(W.partitionBy("lang").orderBy(*best))
    out = scored.withColumn("rank", in_part).filter(F.col("rank") <= top).withColumn("rank", in_lang).filter(F.col("rank") <= top)
    return scratch.last(out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of each language of all whole documents, by the operator's production parameters."""
    return phrase_collocations(read(spark, sf_dir, "documents"))


OP12_SQL = r"""with pieces as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
lists as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
grams as (select lang, m, array_to_string(w[i : i + m - 1], ' ') as phrase from (select lang, w, m, unnest(range(1, len(w) - m + 2)) as i from lists, (select unnest(range(1, 6)) as m))),
counts as (select lang, m, phrase, count(*) as f from grams group by all),
totals as (select lang, sum(f) as n from counts where m = 1 group by lang),
cand as (select lang, m, phrase, f as a, string_split(phrase, ' ') as w from counts where m >= 2 and f >= 100),
cuts as (select *, unnest(range(1, m)) as k from cand),
scored as (select c.lang, c.phrase, c.a, x.f as l, y.f as r, t.n, k, (1000 * c.a::hugeint * t.n::hugeint) // (x.f::hugeint * y.f::hugeint) as score
  from cuts c join counts x on x.lang = c.lang and x.phrase = array_to_string(c.w[1 : k], ' ') join counts y on y.lang = c.lang and y.phrase = array_to_string(c.w[k + 1 : c.m], ' ') join totals t on t.lang = c.lang),
least as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inner_parts as (select lang, a as more, unnest([array_to_string(w[1 : m - 1], ' '), array_to_string(w[2 : m], ' ')]) as phrase from cand where m > 2),
kept as (select * from least s where not exists (select 1 from inner_parts i where i.lang = s.lang and i.phrase = s.phrase and 100 * i.more >= 100 * s.a))
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score from kept
qualify rank <= 2000"""
