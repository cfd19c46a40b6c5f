"""Benchmark decontamination with a generalised suffix automaton of the test items.

Texts are normalised to words: A-Z in lower case, every other ASCII character than a letter or digit separates.
The automaton holds every run of words of every item. Training words are streamed through it, and at each word it
knows the length of the longest run that ends there and occurs in an item. A length of at least ``window`` marks the
last ``window`` words as hit; an item shorter than ``window`` is hit as a whole.

Items are taken in blocks of a bounded number of words, and each block has an automaton of its own; test sets of any
size work, in bounded memory. One block is streamed over the documents in one pass without a shuffle. With several,
every block emits its hits alone, by the hash of the text, and only texts that may be hit are shuffled to meet them.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import Scratch, bound_batches, fresh, id_bits, maybe_in, read, released

#: Words of test items in one automaton; a longer item is cut into pieces that overlap.
BLOCK_WORDS = 200_000

_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")


def words(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode().translate(_NORMAL).split()


class SuffixAutomaton:
    """All runs of words of all items, and the items that hold each window."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int):
        self.window, self.ids = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.holders: dict[tuple[int, ...], set[int]] = defaultdict(set)
        self.short: set[int] = set()
        for item, its in items:
            coded = [self.ids.setdefault(w, len(self.ids)) for w in its]
            last = 0
            for c in coded:
                last = self._extend(last, c)
            k = min(window, len(coded))
            if 0 < k < window:
                self.short.add(k)
            for i in range(len(coded) - k + 1 if k else 0):
                self.holders[tuple(coded[i : i + k])].add(item)
        self.least = min({window} | self.short)

    def _state(self, length: int, link: int, out: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(out)
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """The state for the run that reaches q from p, where q also holds longer runs."""
        if self.length[q] == self.length[p] + 1:
            return q
        made = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = made
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = made
            p = self.link[p]
        return made

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, self.next[last][c], c)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.next[p][c], c)
        return new

    def lengths(self, coded: list[int]) -> Iterator[int]:
        """For each word, the length of the longest run that ends there and occurs in an item."""
        nxt, link, length, state, n = self.next, self.link, self.length, 0, 0
        for c in coded:
            to = nxt[state].get(c)
            while to is None and state:
                state = link[state]
                n = length[state]
                to = nxt[state].get(c)
            if to is None:
                n = 0
            else:
                state, n = to, n + 1
            yield n

    def hits(self, its: list[bytes]) -> tuple[list[int], set[int]]:
        """Intervals of hit words, flat as first, past, first, past, ...; items whose windows occur."""
        coded = np.fromiter(map(self.ids.get, its, repeat(-1)), np.int64, len(its))
        known = np.concatenate(([0], (coded >= 0).view(np.int8), [0]))
        step = np.diff(known)
        spans, found = [], set()
        for begin, end in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True):
            if end - begin < self.least:
                continue
            run = coded[begin:end].tolist()
            for at, n in enumerate(self.lengths(run), 1):
                for k in (*(s for s in self.short if s <= n), *([self.window] if n >= self.window else [])):
                    held = self.holders.get(tuple(run[at - k : at]))
                    if held:
                        found |= held
                        spans.append((begin + at - k, begin + at))
        return merged(spans), found


def merged(spans: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for first, past in sorted(spans):
        if out and first <= out[-1]:
            out[-1] = max(out[-1], past)
        else:
            out += [first, past]
    return out


_BUILT: dict = {}


def _automaton(shared, window: int) -> SuffixAutomaton:
    """The automaton of a broadcast block, built once in each Python worker, which holds one at a time."""
    key = (shared._jbroadcast.id() if getattr(shared, "_jbroadcast", None) else id(shared.value), window)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = SuffixAutomaton([(i, t.split()) for i, t in shared.value], window)
    return _BUILT[key]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> Iterator[list[tuple]]:
    """Lists of (item, words), of at most BLOCK_WORDS + window words in all but for an item's first window.

    A longer item is cut into pieces that overlap by window - 1 words, which hold the same windows.
    """
    block, size = [], 0
    for item, text in benchmark.select(F.col(id_col), F.col(text_col)).filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).toLocalIterator():
        its = words(text)
        for at in range(0, max(1, len(its) - window + 1), BLOCK_WORDS):
            piece = its[at : at + BLOCK_WORDS + window - 1]
            if block and size + len(piece) > BLOCK_WORDS:
                yield block
                block, size = [], 0
            block.append((item, b" ".join(piece)))
            size += len(piece)
    if block:
        yield block


def _scanned(docs: DataFrame, benchmark: DataFrame, window: int, text_col: str, item_col: str, item_text_col: str, schema: T.StructType, finish) -> DataFrame:
    """docs through finish(batch, counts, hits, items), with the hit intervals and the items of every text.

    With one block of items this is one pass over docs. With more, each block is scanned for its hits alone, by the
    hash of the text; what was found is merged, and only texts that may be hit are shuffled to meet it.
    """
    spark, at, width = docs.sparkSession, docs.columns.index(text_col), len(docs.columns)
    bound_batches(spark)
    blocks = [spark.sparkContext.broadcast(b) for b in _blocks(benchmark, item_col, item_text_col, window)]
    if len(blocks) < 2:
        shared = blocks[0] if blocks else spark.sparkContext.broadcast([])

        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            auto = _automaton(shared, window)
            for batch in batches:
                split = [words(t.as_py()) for t in batch.column(at)]
                found = [auto.hits(its) for its in split]
                yield finish(batch, list(map(len, split)), [h for h, _ in found], [sorted(x) for _, x in found])

        return docs.mapInArrow(released(one), schema)

    item_type = benchmark.schema[item_col].dataType
    told = T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("hits", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(item_type))])

    def hits_of(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            auto = _automaton(shared, window)
            for batch in batches:
                found = [auto.hits(words(t.as_py())) for t in batch.column(2)]
                keep = [i for i, (h, _) in enumerate(found) if h]
                cols = [batch.column(k).take(pa.array(keep, pa.int64())) for k in (0, 1)]
                made = [pa.array([found[i][0] for i in keep], pa.list_(pa.int32())), pa.array([sorted(found[i][1]) for i in keep], pa.list_(to_arrow_type(item_type)))]
                yield pa.RecordBatch.from_arrays([*cols, *made], names=told.names)

        return released(run)

    scratch = Scratch(spark)
    h1, h2, hits, items = fresh(docs, "__h1", "__h2", "__hits", "__items")
    key = {h1: F.xxhash64(text_col), h2: F.xxhash64(F.lit(1), F.col(text_col))}
    texts = docs.filter(F.col(text_col).isNotNull()).select(key[h1].alias("h1"), key[h2].alias("h2"), F.col(text_col).alias("text"))
    # equal texts have equal hits: one row of each for a block
    every = [texts.mapInArrow(hits_of(b), told).groupBy("h1", "h2").agg(F.first("hits").alias("hits"), F.first("items").alias("items")) for b in blocks]
    found = every[0]
    for x in every[1:]:
        found = found.union(x)
    found = scratch.cut(found)
    merged_hits = found.groupBy(F.col("h1").alias(h1), F.col("h2").alias(h2)).agg(F.collect_list("hits").alias(hits), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias(items))  # an entry for each block at most
    bits = scratch.cut(id_bits(found.select("h1").distinct(), "h1"))
    may = F.coalesce(maybe_in(bits, h1), F.lit(False)) & F.col(text_col).isNotNull()
    base = docs.withColumns(key)
    names = [*docs.columns, hits, items]
    far = base.filter(~may).withColumns({hits: F.lit(None).cast("array<array<int>>"), items: F.lit(None).cast(T.ArrayType(item_type))})
    both = far.select(*names).union(base.filter(may).join(merged_hits, [h1, h2], "left").select(*names))

    def many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [merged([p for h in x or () for p in zip(h[::2], h[1::2], strict=True)]) for x in batch.column(width).to_pylist()]
            named = [x or [] for x in batch.column(width + 1).to_pylist()]
            counts = [len(words(t.as_py())) for t in batch.column(at)]
            yield finish(pa.RecordBatch.from_arrays(batch.columns[:width], names=batch.schema.names[:width]), counts, spans, named)

    return both.mapInArrow(released(many), schema)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """The rows of docs with three more columns, whose names are returned too: number of words (long), hit intervals
    (array of word positions: first, past, first, past, ...) and items found (array of item ids, ascending).

    Null and empty texts have no words and no hits. Item ids may be of any type that sorts. Items with a null id or
    null text are left out, items that repeat count under each id, an empty test set hits nothing. Documents that
    repeat get equal results. No row of docs is lost or doubled.
    """
    names = fresh(docs, "n_words", "hits", "items")
    item_type = benchmark.schema[item_col].dataType
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.LongType()), T.StructField(names[1], T.ArrayType(T.IntegerType())), T.StructField(names[2], T.ArrayType(item_type))])

    def finish(batch, counts, hits, items):
        added = [pa.array(counts, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(to_arrow_type(item_type)))]
        return pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *names])

    return _scanned(docs, benchmark, window, text_col, item_col, item_text_col, schema, finish), names


def without_spans(text: str, hits: list[int]) -> str:
    """The text without the words of the intervals, and without what separates the words of one interval."""
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw.translate(_NORMAL))]
    out, begin = [], 0
    for first, past in zip(hits[::2], hits[1::2], strict=True):
        out.append(raw[begin : at[first][0]])
        begin = at[past - 1][1]
    return b"".join([*out, raw[begin:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5, text_col: str = "text", chars_col: str | None = "n_chars", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents without the spans that occur in test items, in the same columns.

    Documents with more than ``max_coverage`` of their words in such spans are removed as a whole. Where a column
    ``chars_col`` exists, it is set anew for the texts that change. Clean, null and empty texts stay as they are.
    """
    columns, text_at = docs.columns, docs.columns.index(text_col)
    chars_at = columns.index(chars_col) if chars_col in columns else None

    def finish(batch, counts, hits, items):
        texts, keep, chars = [], [], []
        old = batch.column(chars_at).to_pylist() if chars_at is not None else None
        for i, text in enumerate(batch.column(text_at)):
            hit = hits[i]
            keep.append(sum(hit[1::2]) - sum(hit[::2]) <= max_coverage * counts[i])
            texts.append(without_spans(text.as_py(), hit) if hit else text.as_py())
            chars.append((len(texts[-1]) if hit else old[i]) if old else None)
        made = list(batch.columns)
        made[text_at] = pa.array(texts, batch.column(text_at).type)
        if chars_at is not None:
            made[chars_at] = pa.array(chars, batch.column(chars_at).type)
        return pa.RecordBatch.from_arrays(made, names=batch.schema.names).filter(pa.array(keep, pa.bool_()))

    return _scanned(docs, benchmark, window, text_col, item_col, item_text_col, docs.schema, finish)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: words, hit words, items found, their digest, and whether anything is hit."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found, (n_words, hits, items) = find_contamination(docs, read(spark, sf_dir, "benchmark"))
    n_hit = F.expr(f"aggregate({hits}, 0L, (s, x) -> x - s)")  # the alternating sum, as there is an even number
    ids = F.array_join(F.array_sort(F.transform(items, lambda x: x.cast("string"))), ",")
    return found.select("doc_id", F.col(n_words).alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.size(hits) > 0).alias("contaminated"))


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], window: int = 10) -> list[tuple]:
    """The contract over a few rows, for tests."""
    pattern, out = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), []
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    split = lambda t: pattern.findall((t or "").translate(low))
    wins = [(i, split(t)) for i, t in items]
    for doc, text in docs:
        w, hit, found = split(text), set(), set()
        for i, its in wins:
            k = min(window, len(its))
            for a in range(len(its) - k + 1 if k else 0):
                for b in range(len(w) - k + 1):
                    if w[b : b + k] == its[a : a + k]:
                        hit |= set(range(b, b + k))
                        found.add(i)
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit)))
    return out


OP10_SQL = r"""
with d as (
  select doc_id, row_number() over () as r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
b as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where item_id is not null and text is not null),
bw as (
  select distinct item_id, least(10, len(w)) as k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') as win
  from (select item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0)),
ks as (select distinct k from bw),
dw as (
  select r, k, i, array_to_string(w[i:i + k - 1], ' ') as win
  from (select r, w, k, unnest(range(1, len(w) - k + 2)) as i from d, ks where len(w) >= k)),
hit as (select dw.r, dw.k, dw.i, bw.item_id from dw join bw on dw.k = bw.k and dw.win = bw.win),
n as (select r, count(distinct x) as n_hit from (select r, unnest(range(i, i + k)) as x from hit) group by r),
its as (
  select r, count(*) as n_items, sha256(string_agg(cast(item_id as varchar), ',' order by cast(item_id as varchar))) as items_sha256
  from (select distinct r, item_id from hit) group by r)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n.n_hit, 0) as bigint) as n_hit,
       cast(coalesce(its.n_items, 0) as bigint) as n_items, coalesce(its.items_sha256, sha256('')) as items_sha256,
       coalesce(n.n_hit, 0) > 0 as contaminated
from d left join n using (r) left join its using (r)
"""
