"""Code lengths of texts by prediction by partial matching over bytes.

A trie of byte contexts holds, for every run of up to ``order`` bytes of the training texts, how often each byte (or
the end of a text) came next. A byte is looked for under the longest context that was seen. Where it is not there the
text escapes to the next shorter context, at the price of the escape, and the bytes that were possible under the
longer one are excluded under the shorter. Of a context with t occurrences of q different next bytes, those excluded
left out, a byte seen c times costs (2c - 1) / 2t and the escape q / 2t; below the empty context all bytes that are
left are alike. A text ends with a symbol of its own (the byte 255, which UTF-8 never holds; as many of them stand
before the text), so probabilities are those of whole texts.

Training counts runs of order + 1 bytes in every text, in arrays, and Spark sums them; shorter contexts are their
sums. Scoring takes the trie to the texts. It is dealt into blocks of contexts with the same last two bytes: a byte
needs one block alone, and a block has at most ``MOST_ENTRIES`` entries, or those of one pair of bytes, of which order
4 allows 2^24. Each block beyond the first is one more scan of the texts.

Beside it stands the plain model of words and ends that the scores are compared with. The most frequent words, at most
``HEAD``, go to the tasks, the others meet their counts in a join.

Defined results: a null text is empty, and an empty one has only its end; rows that repeat an id or a text are texts
of their own; nothing trained on gives all bytes the same probability; texts are read whole, in bounded parts; an empty
table gives an empty one; other columns are kept whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .common import Scratch, bound_batches, fresh, read, released

#: Bytes of context.
ORDER = 4
#: Entries (context, next byte) of one block of the trie, 16 bytes each.
MOST_ENTRIES = 4_000_000
#: Words whose counts go to the tasks.
HEAD = 1 << 17
#: Bytes of text that are looked at together.
CHUNK = 2 << 20
#: Different runs or words that a task holds before it hands them on.
HELD = 1 << 20

_EDGE = 255
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _parts(texts: Sequence[bytes], order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of order + 1 bytes that end at each byte of the texts or at an end: (runs, first run of each piece, text
    of each piece), in bounded parts. A long text is several pieces, each with the bytes before it."""
    edge = bytes([_EDGE])
    pieces: list[bytes] = []
    owners: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        whole = edge * order + text + edge
        for at in range(0, len(whole) - order, CHUNK):
            piece = whole[at : at + CHUNK + order]
            pieces.append(piece)
            owners.append(i)
            size += len(piece)
            if size >= CHUNK:
                yield _runs(pieces, owners, order)
                pieces, owners, size = [], [], 0
    if pieces:
        yield _runs(pieces, owners, order)


def _runs(pieces: list[bytes], owners: list[int], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    letters = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    runs = letters[: len(letters) - order].copy()
    for k in range(1, order + 1):
        runs <<= 8
        runs |= letters[k : len(letters) - order + k]
    inside = np.ones(len(letters), bool)  # a run does not reach into the next piece
    for k in range(1, order + 1):
        inside[np.cumsum(lengths) - k] = False
    counts = lengths - order
    return runs[inside[: len(runs)]], np.cumsum(counts) - counts, np.array(owners)


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sums of their counts."""
    if not len(keys):
        return keys, counts
    by = np.argsort(keys, kind="stable")
    keys, counts = keys[by], counts[by]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


class _Table:
    """Values by key, found for many keys at once: open addressing in arrays twice as long as there are keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(8, (2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits)
        spots, left = self._spots(keys), np.arange(len(keys))
        while len(left):
            spot = spots[left]
            free = self.keys[spot] == -1
            self.keys[spot[free]] = keys[left[free]]  # of several for one place one stays
            placed = self.keys[spot] == keys[left]
            self.values[spot[placed]] = values[left[placed]]
            left = left[~placed]
            spots[left] = (spots[left] + 1) & self.mask

    def _spots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _ODD) >> self.shift).view(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 for keys that are not there), and the places of those."""
        spots = self._spots(keys)
        held, out = self.keys[spots], self.values[spots]
        left = np.flatnonzero(held != keys)
        absent = []
        while len(left):
            empty = held[left] == -1
            absent.append(left[empty])
            left = left[~empty]
            spots[left] = (spots[left] + 1) & self.mask
            held[left], out[left] = self.keys[spots[left]], self.values[spots[left]]
            left = left[held[left] != keys[left]]
        absent = np.concatenate([*absent, np.zeros(0, np.int64)])
        out[absent] = 0.0
        return out, absent


class PpmTrie:
    """The trie as sorted arrays, an order at a time, of a block of contexts; ``pairs`` are all runs of two bytes."""

    def __init__(self, order: int, runs: np.ndarray, counts: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray):
        self.order = order
        levels = []
        for k in range(order + 1):
            own = (runs, counts) if k >= 2 else (pairs, pair_counts)
            levels.append(_sums(own[0] & ((1 << 8 * (k + 1)) - 1), own[1]))
        self.levels = []
        for k, (keys, n) in enumerate(levels):
            nodes, first = np.unique(keys >> 8, return_index=True)
            total = np.add.reduceat(n, first) if len(keys) else n
            kinds = np.diff(np.append(first, len(keys)))
            if k:  # what the symbols of a node have under its parent
                above, many = levels[k - 1]
                known = many[np.searchsorted(above, keys & ((1 << 8 * k) - 1))] if len(keys) else n
                shared = np.add.reduceat(known, first) if len(keys) else n
            else:
                shared = np.zeros_like(total)
            self.levels.append((keys, n, nodes, total, kinds, shared))
        keys, n, nodes, total, *_ = self.levels[order]
        seen = np.log10((2 * n - 1) / (2 * np.repeat(total, self.levels[order][4]))) if len(keys) else np.zeros(0)
        self.table = _Table(keys, seen)
        self.root = int(self.levels[0][4].sum())

    def logs(self, runs: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each run after those before it."""
        out, absent = self.table.get(runs)
        if len(absent):
            found, back = np.unique(runs[absent], return_inverse=True)
            out[absent] = self._escaped(found)[back]
        return out

    def _escaped(self, runs: np.ndarray) -> np.ndarray:
        out, left = np.zeros(len(runs)), np.arange(len(runs))
        less_total, less_kinds = np.zeros(len(runs), np.int64), np.zeros(len(runs), np.int64)
        for k in range(self.order, -1, -1):
            keys, n, nodes, total, kinds, shared = self.levels[k]
            if not len(keys) or not len(left):
                continue
            run = runs[left] & ((1 << 8 * (k + 1)) - 1)
            node = np.minimum(np.searchsorted(nodes, run >> 8), len(nodes) - 1)
            there = nodes[node] == run >> 8
            at = np.minimum(np.searchsorted(keys, run), len(keys) - 1)
            hit = keys[at] == run
            t, q = total[node] - less_total[left], kinds[node] - less_kinds[left]
            out[left[hit]] += np.log10((2 * n[at[hit]] - 1) / (2 * t[hit]))
            escape = there & ~hit & (q > 0)
            out[left[escape]] += np.log10(q[escape] / (2 * t[escape]))
            less_total[left[there]], less_kinds[left[there]] = shared[node[there]], kinds[node[there]]
            left = left[~hit]
        if len(left):
            out[left] -= math.log10(256 - self.root)
        return out


def adaptive_log10(text: bytes, order: int = ORDER) -> float:
    """The same code, learnt from nothing but the text itself as it goes: every byte is counted after it is coded."""
    seen: dict[bytes, dict[int, int]] = {}
    past, out = bytes([_EDGE]) * order, 0.0
    for symbol in [*text, _EDGE]:
        excluded: set[int] = set()
        for k in range(order, -1, -1):
            node = seen.get(past[order - k :])
            if not node:
                continue
            open_counts = {s: c for s, c in node.items() if s not in excluded}
            total = sum(open_counts.values())
            if symbol in open_counts:
                out += math.log10((2 * open_counts[symbol] - 1) / (2 * total))
                break
            if open_counts:
                out += math.log10(len(open_counts) / (2 * total))
            excluded |= node.keys()
        else:
            out -= math.log10(256 - len(excluded))
        for k in range(order + 1):
            node = seen.setdefault(past[order - k :], {})
            node[symbol] = node.get(symbol, 0) + 1
        past = (past + bytes([symbol]))[1:]
    return out


@dataclass
class LanguageModel:
    """What fit_language_model learnt: run counts (run, n), word counts (token, n), and their totals."""

    order: int
    lower: bool
    runs: DataFrame
    words: DataFrame
    pairs: tuple[np.ndarray, np.ndarray]
    blocks: list[tuple[int, int]]
    texts: int
    tokens: int
    kinds: int

    def word_log(self, n: Column) -> Column:
        return F.log10((n + 0.5) / self.divisor)

    @property
    def divisor(self) -> float:
        return self.tokens + 0.5 * (self.kinds + 1)


def _bytes(batch: pa.RecordBatch, column: int, lower: bool = False) -> list[bytes]:
    texts = [(t.as_py() or "").encode() for t in batch.column(column)]
    return [t.lower() for t in texts] if lower else texts  # A-Z alone, as these are bytes


def _run_counts(docs: DataFrame, order: int, lower: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return _sums(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))

        def rows(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["run", "n"])

        for batch in batches:
            for runs, _, _ in _parts(_bytes(batch, 0, lower), order):
                held.append(np.unique(runs, return_counts=True))
                if sum(len(k) for k, _ in held) > HELD:
                    held = [merged()]
                    if len(held[0][0]) > HELD // 2:
                        yield rows(*held.pop())
        if held:
            yield rows(*merged())

    return docs.mapInArrow(released(run), "run long, n long").groupBy("run").agg(F.sum("n").alias("n"))


def _word_lists(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text in lower case, in bounded lists."""
    text, at = text.lower(), 0
    while at < len(text):
        past = min(len(text), at + CHUNK)
        while past < len(text) and text[past] not in b" \t\n\v\f\r":
            past += 1
        yield text[at:past].split()
        at = past


def _word_counts(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["token", "n"])

        for batch in batches:
            for text in _bytes(batch, 0):
                for words in _word_lists(text):
                    held.update(words)
                    if len(held) > HELD // 4:
                        yield rows()
                        held.clear()
        if held:
            yield rows()

    return docs.mapInArrow(released(run), "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def fit_language_model(docs: DataFrame, scratch: Scratch, order: int = ORDER, text: str = "text", most_entries: int = MOST_ENTRIES, lower: bool = True) -> LanguageModel:
    """Learns from all texts of docs; see the module for what it holds. With ``lower`` A-Z are read in lower case."""
    if not 1 <= order <= 4:
        raise ValueError("contexts have 1 to 4 bytes, so that a block of the trie has a bound")
    docs = docs.select(F.col(text).alias("text"))
    runs, words = scratch.cut(_run_counts(docs, order, lower)), scratch.cut(_word_counts(docs))
    pairs = runs.groupBy(F.col("run").bitwiseAND(0xFFFF).alias("run")).agg(F.sum("n").alias("n")).orderBy("run").toArrow()  # 65,536 rows at most
    sizes = runs.groupBy(F.shiftright("run", 8).bitwiseAND(0xFFFF).alias("ends")).count().orderBy("ends").collect()  # likewise
    blocks, first, held = [], 0, 0
    for ends, n in sizes:
        if held and held + n > most_entries:
            blocks.append((first, ends))
            first, held = ends, 0
        held += n
    blocks.append((first, 1 << 16))
    texts = docs.count()
    kinds, tokens = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    columns = tuple(pairs[c].to_numpy() for c in ("run", "n"))
    return LanguageModel(order, lower, runs, words, columns, blocks, texts, tokens + texts, kinds + (texts > 0))


_BUILT: dict = {}


def _built(shared) -> tuple[PpmTrie, dict[bytes, float]]:
    """The trie and the words of a broadcast block, built once in each Python worker, which holds one at a time."""
    key = shared._jbroadcast.id() if getattr(shared, "_jbroadcast", None) else id(shared.value)
    if key not in _BUILT:
        _BUILT.clear()
        order, trie, words, logs = shared.value
        _BUILT[key] = PpmTrie(order, *trie), dict(zip(words, logs.tolist(), strict=True))
    return _BUILT[key]


def _text_sums(trie: PpmTrie, texts: list[bytes], block: tuple[int, int]) -> np.ndarray:
    """log10 probability of each text, as far as its contexts belong to the block."""
    out = np.zeros(len(texts))
    for runs, first, owners in _parts(texts, trie.order):
        if block == (0, 1 << 16):
            logs = trie.logs(runs)
        else:
            ends = (runs >> 8) & 0xFFFF
            mine = np.flatnonzero((ends >= block[0]) & (ends < block[1]))
            logs = np.zeros(len(runs))
            logs[mine] = trie.logs(runs[mine])
        np.add.at(out, owners, np.add.reduceat(logs, first))
    return out


def _key(text: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(text)
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


def score_texts(docs: DataFrame, model: LanguageModel, scratch: Scratch, text: str = "text", keep: Sequence[str] | None = None) -> tuple[DataFrame, tuple[str, ...]]:
    """Columns ``keep`` of docs (all, unless told) with the log10 probability of each text, and of its words.

    The names of the further columns come with it: score, bytes and ends coded, tokens, known tokens, words' score.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    keep = list(docs.columns if keep is None else keep)
    docs = docs.select(*[F.col(c) for c in keep], F.col(text).alias("__text"))
    kept = docs.select(*keep)
    score, n_bytes, n_tokens, n_known, base, row, h1, h2, rest = names = fresh(kept, "score", "n_bytes", "n_tokens", "n_known", "base_score", "__row", "__h1", "__h2", "__rest")
    pair = T.StructType([T.StructField("token", T.StringType()), T.StructField("n", T.LongType())])
    kinds = [T.DoubleType(), T.LongType(), T.LongType(), T.LongType(), T.DoubleType(), T.LongType(), T.LongType(), T.ArrayType(pair)]
    added = [T.StructField(n, t) for n, t in zip([score, n_bytes, n_tokens, n_known, base, h1, h2, rest], kinds, strict=True)]

    # so few words of the largest counts that the tasks can hold them
    hist = {b: n for b, n in model.words.groupBy(F.floor(F.log2("n")).cast("int").alias("b")).count().collect()}  # 63 rows at most
    least, many = 63, 0
    while least and many + hist.get(least - 1, 0) <= HEAD:
        least -= 1
        many += hist.get(least, 0)
    head = model.words.filter(F.col("n") >= F.lit(1 << least)).toArrow()
    head_words = [t.as_py().encode() for t in head["token"]]
    head_logs = np.log10((head["n"].to_numpy() + 0.5) / model.divisor)
    end = math.log10((model.texts + 0.5) / model.divisor)

    def shared_block(block: tuple[int, int], with_words: bool):
        ends = F.shiftright("run", 8).bitwiseAND(0xFFFF)
        part = model.runs if block == (0, 1 << 16) else model.runs.filter((ends >= block[0]) & (ends < block[1]))
        got = part.toArrow()  # MOST_ENTRIES rows, or those of one pair of bytes
        trie = (got["run"].to_numpy(), got["n"].to_numpy(), *model.pairs)
        return spark.sparkContext.broadcast((model.order, trie, head_words if with_words else [], head_logs if with_words else np.zeros(0)))

    first_block, shared, ended, lower = model.blocks[0], shared_block(model.blocks[0], True), model.texts > 0, model.lower

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, words_of_head = _built(shared)
        for batch in batches:
            texts = _bytes(batch, batch.num_columns - 1, lower)
            sums = _text_sums(trie, texts, first_block)
            cols: list[list] = [[], [], [], [], []]
            for t in texts:
                n, known, total, others = 1, int(ended), end, Counter()
                for words in _word_lists(t):
                    logs = np.fromiter(map(words_of_head.get, words, repeat(1.0)), float, len(words))
                    unknown = np.flatnonzero(logs > 0)  # no log is above 0
                    others.update([words[i] for i in unknown.tolist()])
                    n += len(words)
                    known += len(words) - len(unknown)
                    total += float(logs.sum()) - len(unknown)
                for col, value in zip(cols, (n, known, total, _key(t), [{"token": w.decode(), "n": k} for w, k in others.items()]), strict=True):
                    col.append(value)
            made = [pa.array(sums), pa.array([len(t) + 1 for t in texts], pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())]
            made += [pa.array([k[i] for k in cols[3]], pa.int64()) for i in (0, 1)] + [pa.array(cols[4], pa.list_(pa.struct([("token", pa.string()), ("n", pa.int64())])))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], *[f.name for f in added]])

    # the rows are numbered as they are written, and read again with their numbers
    out = scratch.cut(docs.mapInArrow(released(run), T.StructType([*kept.schema.fields, *added])).withColumn(row, F.monotonically_increasing_id()))
    shared.destroy()

    for block in model.blocks[1:]:
        one = shared_block(block, False)

        def more(batches: Iterator[pa.RecordBatch], one=one, block=block) -> Iterator[pa.RecordBatch]:
            trie, _ = _built(one)
            for batch in batches:
                texts = _bytes(batch, 0, lower)
                keys = [_key(t) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(_text_sums(trie, texts, block))], names=[h1, h2, "__part"])

        part = docs.select("__text").mapInArrow(released(more), T.StructType([T.StructField(h1, T.LongType()), T.StructField(h2, T.LongType()), T.StructField("__part", T.DoubleType())]))
        part = scratch.cut(part.groupBy(h1, h2).agg(F.max("__part").alias("__part")))  # copies have equal sums
        one.destroy()
        out = scratch.cut(out.join(part, [h1, h2], "left").withColumn(score, F.col(score) + F.col("__part")).select(*out.columns))

    tail = out.select(F.col(row).alias("__r"), F.explode(rest).alias("__x")).select("__r", F.col("__x.token").alias("token"), F.col("__x.n").alias("__n"))
    tail = tail.join(model.words, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    tail = tail.groupBy("__r").agg(F.sum(F.col("__n") * model.word_log(F.col("n"))).alias("__s"), F.sum(F.when(F.col("n") > 0, F.col("__n")).otherwise(0)).alias("__k"))
    out = out.join(tail, F.col(row) == F.col("__r"), "left")
    out = out.withColumns({base: F.col(base) + F.coalesce("__s", F.lit(0.0)), n_known: F.col(n_known) + F.coalesce("__k", F.lit(0))})
    return out.select(*keep, *names[:5]), tuple(names[:5])


def adaptive_scores(docs: DataFrame, order: int = ORDER, text: str = "text") -> tuple[DataFrame, str]:
    """docs with the log10 probability of each text under the model that the text itself builds up."""
    bound_batches(docs.sparkSession)
    (name,) = fresh(docs, "score")
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([adaptive_log10(t, order) for t in _bytes(batch, at)], pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(released(run), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])), name


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, A-Z in lower case, scored by a model of those whose crc32(doc_id) is not 1 modulo 5.

    A null id has no crc32 and trains.
    """
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    docs = docs.select("doc_id", held_out.alias("held_out"), "text")
    scratch = Scratch(spark)
    model = fit_language_model(docs.filter(~F.col("held_out")), scratch)
    out, (score, n_bytes, n_tokens, n_known, base) = score_texts(docs, model, scratch, keep=["doc_id", "held_out"])
    return out.select("doc_id", "held_out", F.col(n_tokens).alias("n_tokens"), F.col(n_known).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), F.col(base).alias("base_score"), F.col(score).alias("score"), F.col(n_bytes).alias("n_bytes"))
