"""Stochastic motif operators: Gibbs sampling, EM, null sets, significance, column dependency by permutation.

Restarts, null sets and column pairs are independent, so they are the rows that are spread over tasks; inside one
restart the state is sequential and stays in numpy. Every random stream is keyed by data (seed, width, dataset, run),
never by partition, so results do not depend on the layout or on retries.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import special
from ..session import cut
from .sequences import BASES, _by_context, column_pairs, transition_counts, window_logs

_CODE = np.full(256, 4, np.int8)
for _i, _c in enumerate(b"ACGT"):
    _CODE[_c] = _CODE[_c + 32] = _i
_TRANSLATE = _CODE.astype(np.uint8).tobytes()


@dataclass(frozen=True)
class MotifOptions:
    """All settings of a motif run. ``seed`` has no default: runs are reproducible or they are not runs."""

    seed: int
    width: int = 8
    runs: int = 20
    order: int = 3
    pseudo: float = 0.05
    plateau: int = 50
    max_sweeps: int = 400
    trial_sweeps: int = 5
    both_strands: bool = True
    zoops: float | None = 0.2
    shift_chance: float = 0.4
    null_sets: int = 0
    clr_sampling: bool = False
    rank: str = "ilr"
    background: str = "flank"

    def __post_init__(self):
        if self.width < 2 or self.runs < 1 or self.order < 0 or self.max_sweeps < 1:
            raise ValueError("width, runs, order and max_sweeps must be positive")
        if self.zoops is not None and not 0 < self.zoops <= 1:
            raise ValueError("zoops is a weight in (0, 1], or None for one site in each sequence")
        if self.rank not in ("ilr", "clr"):
            raise ValueError("rank must be ilr or clr")


def stream(*key: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([k & 0xFFFFFFFF for k in key])))


class Sequences:
    """Coded sequences with both strands, valid windows, and log background of every window."""

    def __init__(self, seqs: list[str], width: int, order: int, both: bool = True, background: str = "flank"):
        self.width, self.coded, self.valid, self.log_bg = width, [], [], []
        strands = [[_CODE[np.frombuffer(s.encode(), np.uint8)]] for s in seqs]
        if both:
            strands = [[s[0], np.where(s[0][::-1] < 4, 3 - s[0][::-1], 4).astype(np.int8)] for s in strands]
        models = [np.ones((4**k, 4)) for k in range(order + 1)]
        for parts in strands:
            row = np.concatenate(parts).astype(np.int64)  # words across the junction count in the model
            for k, m in enumerate(models):
                if len(row) > k:
                    context, ok = np.zeros(len(row) - k, np.int64), np.ones(len(row) - k, bool)
                    for j in range(k + 1):
                        part = row[j : len(row) - k + j]
                        ok &= part < 4
                        if j < k:
                            context = context * 4 + np.minimum(part, 3)
                    np.add.at(m, (context[ok], row[k:][ok]), 1)
        tables = [np.log(m / m.sum(axis=1, keepdims=True)).ravel() for m in models]
        self.base = np.exp(tables[0])
        for parts in strands:
            bg, ok = [], []
            for s in parts:
                # windows across the end of a strand do not exist
                at, total = window_logs(s.astype(np.uint8), 0, len(s), tables, width, background)
                full, found = np.zeros(len(s)), np.zeros(len(s), bool)
                full[at], found[at] = total, True
                bg.append(full)
                ok.append(found)
            self.coded.append(np.concatenate([*parts, np.full(width, 4, np.int8)]))
            self.valid.append(np.concatenate(ok))
            self.log_bg.append(np.concatenate(bg))
        self.n_valid = np.array([int(v.sum()) for v in self.valid])
        self.windows = [np.lib.stride_tricks.sliding_window_view(c, width)[: len(v)] for c, v in zip(self.coded, self.valid, strict=True)]

    def counts(self, sites: np.ndarray) -> np.ndarray:
        m = np.zeros((self.width, 4))
        for i in np.flatnonzero(sites >= 0):
            m[np.arange(self.width), self.windows[i][sites[i]]] += 1
        return m

    def ratios(self, i: int, log_pwm: np.ndarray) -> np.ndarray:
        """Log likelihood ratio of each window; minus infinity for invalid ones."""
        w = np.minimum(self.windows[i], 3)
        out = log_pwm[np.arange(self.width), w].sum(axis=1) - self.log_bg[i]
        return np.where(self.valid[i], out, -np.inf)


def log_pwm(counts: np.ndarray, weight: float, base: np.ndarray) -> np.ndarray:
    """Log frequencies of a profile with a pseudocount of so many sites for each site, spread like the background."""
    n = counts.sum(axis=1, keepdims=True)
    return np.log((counts + base * n * weight) / (n * (1 + weight)))


def log_profile(counts: np.ndarray) -> np.ndarray:
    """Log frequencies of a profile as it is; minus infinity for a letter that a column does not have."""
    with np.errstate(divide="ignore"):
        return np.log(counts / counts.sum(axis=1, keepdims=True))


def prior_ratio(n: int, total: int, weight: float) -> float:
    """How much more likely n+1 sites are than n, of total sequences, under the Beta prior."""
    p = weight * total
    return (n + p) / (total - n - 1 + p)


def ilr(data: Sequences, counts: np.ndarray, sites: np.ndarray | None = None) -> float:
    """Sum over sequences of the log mean likelihood ratio, for the profile of the counts, without a pseudocount.

    With ``sites`` only sequences that have one count. A sequence in which no window can come from the profile gives
    minus infinity.
    """
    pwm, total = log_profile(counts), 0.0
    for i, n in enumerate(data.n_valid):
        if n and (sites is None or sites[i] >= 0):
            r = data.ratios(i, pwm)
            top = r.max()
            if top == -np.inf:
                return -math.inf
            total += top + math.log(np.exp(r - top).sum()) - math.log(n)
    return float(total)


def run_score(data: Sequences, sites: np.ndarray, o: MotifOptions) -> float:
    """The score by which runs are ranked."""
    return clr(data, sites, o.zoops) if o.rank == "clr" else ilr(data, data.counts(sites), sites)


def clr(data: Sequences, sites: np.ndarray, zoops: float | None = None) -> float:
    """Sum over sites of log frequency minus log background, with the prior of the sites."""
    chosen = np.flatnonzero(sites >= 0)
    if not len(chosen):
        return -math.inf
    m = data.counts(sites)
    f = m / m.sum(axis=1, keepdims=True)
    out = float((m[m > 0] * np.log(f[m > 0])).sum()) - sum(data.log_bg[i][sites[i]] for i in chosen)
    if zoops is not None:
        total, n = len(sites), len(chosen)
        p = zoops * total
        out += math.lgamma(n + p) + math.lgamma(total - n + p) - math.lgamma(p) - math.lgamma(total + p) - np.log(data.n_valid[chosen]).sum()
    return out


def sample_run(data: Sequences, o: MotifOptions, rng: np.random.Generator) -> tuple[float, np.ndarray, int]:
    """One restart: random sites, sweeps until the best score stands still, phase shifts. (score, sites, sweeps)."""
    n = len(data.coded)
    able = np.flatnonzero(data.n_valid > 0)
    sites = np.full(n, -1, np.int64)
    options = [np.flatnonzero(v) for v in data.valid]
    for i in able:
        if o.zoops is None or i == able[0] or rng.random() < 0.5:
            sites[i] = rng.choice(options[i])
    counts = data.counts(sites)
    best, best_sites, since, sweep = -math.inf, sites.copy(), 0, 0
    pos = np.arange(o.width)
    while sweep < o.max_sweeps and (sweep < o.trial_sweeps or since < o.plateau):
        sweep += 1
        for i in able:
            if sites[i] >= 0:
                counts[pos, data.windows[i][sites[i]]] -= 1
                sites[i] = -1
            others = int((sites >= 0).sum())
            if others == 0:
                sites[i] = rng.choice(options[i])
            else:
                if o.clr_sampling:
                    c = counts
                    gain = (c + 1) * np.log(c + 1) - np.where(c > 0, c * np.log(np.maximum(c, 1)), 0)
                    r = np.where(data.valid[i], gain[pos, np.minimum(data.windows[i], 3)].sum(axis=1) - data.log_bg[i], -np.inf)
                    r = r - o.width * ((others + 1) * math.log(others + 1) - others * math.log(others))
                else:
                    r = data.ratios(i, log_pwm(counts, o.pseudo, data.base))
                top = max(r.max(), 0.0)
                weight = np.exp(r - top)
                cum = np.cumsum(weight)
                none = 0.0
                if o.zoops is not None and others >= 3:
                    none = data.n_valid[i] / prior_ratio(others, n, o.zoops) * math.exp(-top)
                u = rng.random() * (cum[-1] + none)
                if u < cum[-1]:
                    sites[i] = min(int(np.searchsorted(cum, u, side="right")), len(cum) - 1)
            if sites[i] >= 0:
                counts[pos, data.windows[i][sites[i]]] += 1
        if rng.random() < o.shift_chance:
            by = 1 if rng.random() < 0.5 else -1
            moved = np.where(sites >= 0, sites + by, -1)
            held = np.flatnonzero(sites >= 0)
            if len(held) and all(0 <= moved[i] < len(data.valid[i]) and data.valid[i][moved[i]] for i in held):
                gain = clr(data, moved, o.zoops) - clr(data, sites, o.zoops)
                if gain >= 0 or rng.random() < math.exp(gain):
                    sites = moved
                    counts = data.counts(sites)
        score = clr(data, sites, o.zoops)
        if score > best + 1e-9:
            best, best_sites, since = score, sites.copy(), 0
        else:
            since += 1
    return run_score(data, best_sites, o), best_sites, sweep


def em_refine(data: Sequences, counts: np.ndarray, pseudo: float = 0.05, patience: int = 3, least: float = 0.01, limit: int = 200) -> tuple[np.ndarray, float]:
    """Expectation maximisation with one site in each sequence, until it stops to improve. (counts, score)."""
    best, since = ilr(data, counts), 0
    for _ in range(limit):
        pwm, new = log_pwm(counts, pseudo, data.base), np.zeros_like(counts)
        for i, n in enumerate(data.n_valid):
            if n:
                r = data.ratios(i, pwm)
                w = np.exp(r - r.max())
                w /= w.sum()
                for c in range(data.width):
                    new[c] += np.bincount(np.minimum(data.windows[i][:, c], 3), weights=w, minlength=4)[:4]
        score = ilr(data, new)
        since = 0 if score > best + least else since + 1
        if score > best:
            best, counts = score, new
        if since >= patience:
            break
    return counts, best


def reassign(data: Sequences, counts: np.ndarray, n_sites: int, pseudo: float = 0.05) -> np.ndarray:
    """The best window of each sequence, of which the n_sites best stay."""
    pwm = log_pwm(counts, pseudo, data.base)
    found = [(float(r.max()), i, int(r.argmax())) for i, n in enumerate(data.n_valid) if n for r in [data.ratios(i, pwm)]]
    sites = np.full(len(data.coded), -1, np.int64)
    for _, i, at in sorted(found, key=lambda x: (-x[0], x[1]))[:n_sites]:
        sites[i] = at
    return sites


def public_position(at: int, length: int, width: int) -> int | None:
    """1..len on the forward strand, -1..-len on the reverse one: the place of the site's first letter as it is read."""
    return None if at < 0 else at + 1 if at < length else at - 2 * length


#: Restarts that advance side by side in one task: their scores are one matrix product.
TOGETHER = 32
#: Bytes of the letters of all windows that a task holds as numbers; beyond that they are made when they are needed.
LETTERS_BYTES = 1 << 26


def sample_together(data: Sequences, o: MotifOptions, rng: np.random.Generator, n_runs: int) -> list[tuple[float, np.ndarray, int]]:
    """sample_run for several restarts at once: (score, sites, sweeps) of each.

    The restarts share nothing but the random stream. A window is a row of 0/1 letters, so the log-likelihoods of all
    windows of a sequence under all profiles are one product; a restart that has come to rest keeps its best sites.
    """
    n, w, runs = len(data.coded), o.width, np.arange(n_runs)
    able = np.flatnonzero(data.n_valid > 0)
    options = [np.flatnonzero(v) for v in data.valid]
    eye = np.eye(5, dtype=np.float32)[:, :4]

    def spelled(i: int, at: np.ndarray | None = None) -> np.ndarray:
        x = data.windows[i][options[i] if at is None else options[i][at]]
        return eye[x].reshape(len(x), 4 * w)

    held = [spelled(i) for i in range(n)] if int(data.n_valid.sum()) * 16 * w <= LETTERS_BYTES else None
    of = (lambda i, at: held[i][at]) if held else spelled
    log_bg = [data.log_bg[i][options[i]].astype(np.float32)[:, None] for i in range(n)]
    lp = np.log(np.maximum(data.n_valid, 1))
    # sites are places in options[i]; -1 is none
    sites = np.full((n_runs, n), -1, np.int64)
    for i in able:
        drawn = rng.integers(0, len(options[i]), n_runs)
        on = np.ones(n_runs, bool) if o.zoops is None or i == able[0] else rng.random(n_runs) < 0.5
        sites[:, i] = np.where(on, drawn, -1)
    counts = np.zeros((n_runs, 4 * w), np.float64)
    for i in able:
        on = sites[:, i] >= 0
        counts[on] += of(i, sites[on, i])
    n_sites = (sites >= 0).sum(axis=1)
    bg_sum = np.zeros(n_runs)
    prior = np.zeros(n_runs)
    for i in able:
        on = sites[:, i] >= 0
        bg_sum[on] += log_bg[i][sites[on, i], 0]
        prior[on] += lp[i]
    p = (o.zoops or 0.0) * n
    lgamma = np.frompyfunc(math.lgamma, 1, 1)

    def scores() -> np.ndarray:
        c = counts
        t = np.maximum(n_sites, 1)
        out = (np.where(c > 0.5, c * np.log(np.maximum(c, 1)), 0).sum(axis=1) - w * t * np.log(t)) - bg_sum
        if o.zoops is not None:
            out = out + (lgamma(n_sites + p) + lgamma(n - n_sites + p)).astype(float) - math.lgamma(p) - math.lgamma(n + p) - prior
        return np.where(n_sites > 0, out, -np.inf)

    best, best_sites = np.full(n_runs, -np.inf), sites.copy()
    since, sweeps, live = np.zeros(n_runs, int), np.zeros(n_runs, int), np.ones(n_runs, bool)
    for sweep in range(o.max_sweeps):
        for i in able:
            on = sites[:, i] >= 0
            if on.any():
                old = sites[on, i]
                counts[on] -= of(i, old)
                bg_sum[on] -= log_bg[i][old, 0]
                prior[on] -= lp[i]
                n_sites[on] -= 1
            if o.clr_sampling:
                c = np.maximum(counts, 0)
                table = (c + 1) * np.log(c + 1) - np.where(c > 0.5, c * np.log(np.maximum(c, 1)), 0)
                t = n_sites[:, None]
                table -= (t + 1) * np.log(t + 1) - np.where(t > 0, t * np.log(np.maximum(t, 1)), 0)
            else:
                t = np.maximum(n_sites, 1)[:, None]
                table = np.log((counts + np.tile(data.base, w) * t * o.pseudo) / (t * (1 + o.pseudo)))
            r = (held[i] if held else spelled(i)) @ table.T.astype(np.float32) - log_bg[i]
            r = np.where(n_sites == 0, np.float32(0), r)  # nothing to go by: any window
            top = np.maximum(r.max(axis=0), 0)
            cum = np.cumsum(np.exp(r - top), axis=0, dtype=np.float64)
            none = np.zeros(n_runs)
            if o.zoops is not None:
                ratio = (n_sites + p) / (n - n_sites - 1 + p)
                none = np.where(n_sites >= 3, data.n_valid[i] / ratio * np.exp(-top), 0)
            u = rng.random(n_runs) * (cum[-1] + none)
            place = np.minimum((cum <= u).sum(axis=0), len(options[i]) - 1)
            sites[:, i] = np.where(u < cum[-1], place, -1)
            on = sites[:, i] >= 0
            new = sites[on, i]
            counts[on] += of(i, new)
            bg_sum[on] += log_bg[i][new, 0]
            prior[on] += lp[i]
            n_sites[on] += 1
        now = scores()
        for k in np.flatnonzero(live & (rng.random(n_runs) < o.shift_chance)):
            by = 1 if rng.random() < 0.5 else -1
            able_of = np.flatnonzero(sites[k] >= 0)
            moved = [int(options[i][sites[k, i]]) + by for i in able_of]
            if len(able_of) and all(0 <= m < len(data.valid[i]) and data.valid[i][m] for m, i in zip(moved, able_of, strict=True)):
                full = np.full(n, -1, np.int64)
                full[able_of] = moved
                gain = clr(data, full, o.zoops) - now[k]
                if gain >= 0 or rng.random() < math.exp(gain):
                    sites[k, able_of] = [int(np.searchsorted(options[i], m)) for m, i in zip(moved, able_of, strict=True)]
                    counts[k] = sum(of(i, sites[k, [i]])[0].astype(float) for i in able_of)
                    bg_sum[k] = sum(float(log_bg[i][sites[k, i], 0]) for i in able_of)
                    now[k] += gain
        better = live & (now > best + 1e-6)
        best[better], best_sites[better] = now[better], sites[better]
        since = np.where(better, 0, since + 1)
        sweeps += live
        live &= (sweep + 1 < o.trial_sweeps) | (since < o.plateau)
        if not live.any():
            break
    out = []
    for k in runs:
        full = np.array([options[i][best_sites[k, i]] if best_sites[k, i] >= 0 else -1 for i in range(n)], np.int64)
        out.append((run_score(data, full, o), full, int(sweeps[k])))
    return out


RUN_SCHEMA = "dataset int, width int, run int, score double, sweeps int, n_sites int, sites array<int>"


def as_sets(spark: SparkSession, datasets: dict[int, list[str]] | DataFrame) -> DataFrame:
    """(dataset, seq_id, seq) from a dictionary of lists, or the frame as it is."""
    if isinstance(datasets, DataFrame):
        return datasets.select(F.col("dataset").cast("int").alias("dataset"), F.col("seq_id").cast("long").alias("seq_id"), "seq")
    return spark.createDataFrame([(d, i, s) for d, seqs in datasets.items() for i, s in enumerate(seqs)], "dataset int, seq_id long, seq string")


def gibbs_runs(spark: SparkSession, datasets: dict[int, list[str]] | DataFrame, options: list[MotifOptions]) -> DataFrame:
    """All restarts of all datasets and widths: RUN_SCHEMA, a row for each restart.

    datasets has (dataset, seq_id, seq). A dataset of at most WHOLE_LETTERS is sampled one sequence after another: its
    sequences meet in a worker, and the grid of (dataset, options, block of TOGETHER restarts) is what is spread; the
    random stream belongs to the block. A larger one is dealt into parts, all of which are sampled in each sweep
    (_wide_runs). Sites are listed in the order of seq_id, -1 for none.
    """
    frame = as_sets(spark, datasets)
    if isinstance(datasets, DataFrame):
        frame = cut(frame)
        sizes = {r["dataset"]: (r["n"], r["letters"]) for r in frame.groupBy("dataset").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("letters")).collect()}
    else:
        sizes = {d: (len(seqs), sum(len(s or "") for s in seqs)) for d, seqs in datasets.items()}
    wide = {d: x for d, x in sizes.items() if x[1] > WHOLE_LETTERS}
    if not wide:
        return _whole_runs(frame, len(sizes), options)
    is_wide = F.col("dataset").isin(list(wide))
    out = _wide_runs(frame.filter(is_wide), wide, options)
    return out if len(wide) == len(sizes) else out.union(_whole_runs(frame.filter(~is_wide), len(sizes) - len(wide), options))


def _whole_runs(frame: DataFrame, n_sets: int, options: list[MotifOptions]) -> DataFrame:
    """RUN_SCHEMA of datasets that a task samples."""
    grid = [F.struct(F.lit(k).alias("k"), F.lit(b).alias("block")) for k, o in enumerate(options) for b in range(-(-o.runs // TOGETHER))]
    frame = frame.withColumn("g", F.explode(F.array(*grid))).select("dataset", "seq_id", "seq", "g.k", "g.block")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["seq_id", "seq"])
        d, k, b = (int(pdf[c].iloc[0]) for c in ("dataset", "k", "block"))
        o = options[k]
        data = Sequences([s or "" for s in pdf["seq"]], o.width, o.order, o.both_strands, o.background)
        found = sample_together(data, o, stream(o.seed, o.width, d, b), min(TOGETHER, o.runs - b * TOGETHER))
        out = [(d, o.width, b * TOGETHER + r, score, sweeps, int((sites >= 0).sum()), sites.tolist()) for r, (score, sites, sweeps) in enumerate(found)]
        return pd.DataFrame(out, columns=[c.split()[0] for c in RUN_SCHEMA.split(", ")])

    # far more partitions than groups, so that few groups share one
    parts = min(4096, 8 * len(grid) * max(1, n_sets))
    return frame.repartition(parts, "dataset", "k", "block").groupBy("dataset", "k", "block").applyInPandas(run, RUN_SCHEMA)


# -- datasets of any size --------------------------------------------------------------------------------------------

#: Letters of a dataset that one task samples, one sequence after another; and of the parts of a larger one.
WHOLE_LETTERS, PART_LETTERS = 1 << 20, 1 << 19
#: Sums go over the parts as whole numbers of this size, so that they do not depend on their order.
_UNIT = 1 << 30
_PART = "dataset int, part int, ids binary, sizes binary, codes binary"
#: Letters of the words that a task looks values up by, about: five to that power is the size of a table.
LOOKED_UP = 6


def _fives(codes: np.ndarray, k: int) -> np.ndarray:
    """The words of k letters that begin at each place, as numbers to base 5: a gap is a letter too."""
    size = max(0, len(codes) - k + 1)
    word = np.zeros(size, np.uint16 if 5**k <= 1 << 16 else np.int64)
    for j in range(k):
        word *= 5
        word += codes[j : j + size]
    return word


def _all_words(k: int) -> np.ndarray:
    """The letters of all words of k letters, in the order of their numbers to base 5."""
    return np.indices((5,) * k, np.uint8).reshape(k, -1).T


def _opposite(k: int) -> np.ndarray:
    """For each word of k letters the number of its reverse complement."""
    letters = _all_words(k)[:, ::-1]
    return np.where(letters < 4, 3 - letters, 4).astype(np.int64) @ 5 ** np.arange(k - 1, -1, -1)


class Part:
    """Sequences side by side in one array, a gap behind each: a sweep over them is a few array operations."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray):
        self.codes, self.sizes = codes, sizes
        self.first = np.cumsum(sizes + 1) - sizes - 1

    def words(self, order: int, both: bool) -> np.ndarray:
        """How often each word of order + 1 letters occurs; on both strands those across their junction included."""
        k = order + 1
        n = np.bincount(_fives(self.codes, k), minlength=5**k)
        if both:
            n = n + n[_opposite(k)]
            # the last letters of each sequence, and of its other strand the first; what stands before a short one is a gap
            ends = np.concatenate([np.full(order, 4, np.uint8), self.codes])
            last = ends[(self.first + self.sizes)[:, None] + np.arange(order)]
            row = np.concatenate([last, np.where(last < 4, 3 - last, 4)[:, ::-1], np.full((len(last), 1), 4)], axis=1)
            across = _fives(row.astype(np.uint8).ravel(), k)
            step = np.arange(len(last))[:, None] * (2 * order + 1) + np.arange(order)  # they begin before the junction
            n = n + np.bincount(across[step.ravel()], minlength=5**k)
        return n.reshape((5,) * k)[(slice(4),) * k].ravel()


class Scale:
    """What the letters around a window add to its log background, by its words of ``span`` letters.

    The first word begins ``order`` letters before the window, the next a letter later; there are ``width + order``.
    Windows of the other strand have the same words in their places: the same sums, of opposite words in reverse order.
    Backgrounds that look at letters further off, and contexts too long for a table, are not of this kind: ``own``.
    """

    def __init__(self, o: MotifOptions, tables: list[np.ndarray]):
        self.o, self.tables, order = o, tables, len(tables) - 1
        self.own = o.background not in ("plain", "flank", "site") or order > LOOKED_UP
        self.order = order = 0 if self.own else order
        span, n = order + 1, o.width + order
        self.block = max(1, LOOKED_UP - order)  # words that are looked up together
        letters = _all_words(span)
        self.last, self.opposite = letters[:, -1], _opposite(span)
        self.logs = np.zeros((n, 5**span))
        if not self.own:
            rows = np.concatenate([np.full((len(letters), 1), 4, np.uint8), letters], axis=1)
            best, given = _by_context(rows.ravel(), tables)
            best, given = best[span :: span + 1], [x[span :: span + 1] for x in given]
            for j in range(n):
                if j < o.width:
                    self.logs[j] = given[min(j, order)] if o.background == "site" else best
                elif o.background == "flank":
                    k = j - o.width
                    self.logs[j] = np.where((letters[:, order - k :] == 4).any(axis=1), 0, best - given[k])
            self.logs = np.nan_to_num(self.logs)
        self.logs[: o.width, self.last == 4] = np.inf  # no window has a gap

    def lookups(self, pwm: np.ndarray | None = None) -> list[np.ndarray]:
        """Tables by blocks of words, whose values at a window's words add up to its log ratio under a profile; with
        both strands complex, the imaginary part is the other strand's. Without a profile, minus the log background."""
        logs, w = -self.logs, self.o.width
        if pwm is not None:
            logs[:w, self.last < 4] += pwm[:, self.last[self.last < 4]]
        sides = [logs, logs[::-1, self.opposite]] if self.o.both_strands else [logs]
        span, out = self.order + 1, []
        word = np.arange(5 ** (self.order + self.block))
        subs = [word // 5 ** (self.block - 1 - i) % 5**span for i in range(self.block)]
        for s in range(0, len(logs), self.block):
            sums = [sum(side[s + i][subs[i]] for i in range(min(self.block, len(logs) - s))) for side in sides]
            out.append(sums[0] if len(sums) == 1 else np.stack(sums, axis=1))
        return out


class Profile:
    """A profile to look up: exponentials of log ratios, over ``top`` so that none exceeds 1, and the logs themselves."""

    def __init__(self, scale: Scale, pwm: np.ndarray):
        self.logs = scale.lookups(pwm)
        most = [float(t.max()) for t in self.logs]
        self.top, self.exps = sum(most), [np.exp(t - m) for t, m in zip(self.logs, most, strict=True)]


class Windows:
    """The windows of a part under the options of a run. One is named by the place of its leftmost letter, times two,
    plus one on the other strand; the windows of a sequence are in the order in which its strands are read."""

    #: A sum so much smaller than the running sum before it, or as small as that, is taken anew for its sequence.
    FINE, LEAST = 1e6, 1e-280

    def __init__(self, part: Part, scale: Scale):
        o, codes = scale.o, part.codes
        self.o, self.part, self.scale, self.sides = o, part, scale, 2 if o.both_strands else 1
        letters = scale.order + scale.block
        blocks = -(-(o.width + scale.order) // scale.block)
        ends = np.full(scale.order, 4, np.uint8), np.full(blocks * scale.block + letters, 4, np.uint8)
        words = _fives(np.concatenate([ends[0], codes, ends[1]]), letters).astype(np.intp)
        self.words = [words[i * scale.block : i * scale.block + len(codes)] for i in range(blocks)]
        if np.count_nonzero(codes == 4) == len(part.sizes):
            self.valid, n = None, np.maximum(part.sizes - o.width + 1, 0)
        else:
            gaps = np.concatenate(([0], np.cumsum(np.concatenate([codes == 4, np.ones(o.width, bool)]))))
            self.valid = gaps[o.width : o.width + len(codes)] == gaps[: len(codes)]
            n = np.add.reduceat(self.valid.astype(np.int64), part.first) if len(part.first) else np.zeros(0, np.int64)
        self.able = np.flatnonzero(n)
        self.n_valid, self.first, self.sizes = n[self.able] * self.sides, part.first[self.able], part.sizes[self.able]
        self.own = self._own() if scale.own else None
        self.plain = scale.lookups()

    def _own(self) -> np.ndarray:
        """Minus the log background of each window, for a side each."""
        codes, o = self.part.codes, self.o
        out = np.zeros((len(codes), self.sides))
        for side in range(self.sides):
            its = np.where(codes < 4, 3 - codes, 4).astype(np.uint8)[::-1] if side else codes
            at, logs = window_logs(its, 0, len(codes), self.scale.tables, o.width, o.background)
            out[len(codes) - o.width - at if side else at, side] = -logs
        return out

    def logs(self, lookups: list[np.ndarray], at: np.ndarray | slice) -> np.ndarray:
        """Sums of looked up logs at some places, a column for each side; minus infinity where there is no window."""
        out = sum(t[w[at]] for t, w in zip(lookups, self.words, strict=True)).reshape(-1, self.sides)
        return out if self.own is None else out + self.own[at]

    def of_sequence(self, i: int, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows of the i-th able sequence and what logs (a column for each side) of its places they have."""
        at = np.arange(self.first[i], self.first[i] + self.sizes[i])
        names = [at * 2, at[::-1] * 2 + 1][: self.sides]
        values = [logs[:, 0], logs[::-1, -1]][: self.sides]
        names, values = np.concatenate(names), np.concatenate(values)
        return names, values

    def weights(self, profile: Profile) -> tuple[np.ndarray, np.ndarray]:
        """Exponentials of the log ratios of all places, and their sums for each able sequence, a column for each side."""
        kind = np.complex128 if self.sides == 2 else np.float64
        e = None
        for table, words in zip(profile.exps, self.words, strict=True):
            found = table.view(kind).ravel()[words].view(np.float64)
            e = found if e is None else np.multiply(e, found, out=e)
        if self.own is not None:
            e *= np.exp(self.own).ravel()
        sums = np.add.reduceat(e.view(kind), self.first).view(np.float64).reshape(-1, self.sides)
        return e.view(kind), sums

    def draw(self, chain: Chain, profile: Profile | None, n_sites: int, sweep: int, part: int) -> np.ndarray:
        """For each able sequence a window, or -1: given the profile that the sweep before left."""
        o = self.o
        rng = stream(o.seed, o.width, chain.dataset, chain.run, sweep, part)
        u, v = rng.random(len(self.able)), rng.random(len(self.able))
        if not len(self.able):
            return np.zeros(0, np.int64)
        if not n_sites:
            site = self.numbered(np.minimum((u * self.n_valid).astype(np.int64), self.n_valid - 1))
            return site if o.zoops is None else np.where(v < 0.5, site, -1)
        e, sums = self.weights(profile)
        total, none = sums.sum(axis=1), np.zeros(len(self.able))
        if o.zoops is not None and n_sites >= 3:
            p = o.zoops * chain.n
            none = self.n_valid * max(chain.n - n_sites - 1 + p, 0.0) / (n_sites + p) * math.exp(min(-profile.top, 700))
        x = u * (total + none)
        cum = np.cumsum(e)
        before = np.where(self.first > 0, cum[self.first - 1], 0)
        minus = x >= sums[:, 0]
        place = np.searchsorted(np.ascontiguousarray(cum.real), before.real + x, side="right")
        if self.sides == 2:
            # the other strand is read backwards: the last place before which the sums do not reach what is left
            left = before.imag + sums[:, 1] - (x - sums[:, 0])
            place = np.where(minus, np.searchsorted(np.ascontiguousarray(cum.imag), left, side="left"), place)
        site = np.where(x < total, place * 2 + minus, -1)
        behind = np.abs(cum[self.first + self.sizes])
        rough = (total <= self.LEAST) | (behind > total * self.FINE) | (place < self.first) | (place >= self.first + self.sizes)
        for i in np.flatnonzero(rough & ((x < total) | (total <= self.LEAST))).tolist():
            site[i] = self.draw_one(i, profile, u[i], n_sites, chain)
        return site

    def draw_one(self, i: int, profile: Profile, u: float, n_sites: int, chain: Chain) -> int:
        """What draw gives for a sequence, from its own largest value on."""
        o = self.o
        names, r = self.of_sequence(i, self.logs(profile.logs, slice(self.first[i], self.first[i] + self.sizes[i])))
        names, r = names[np.isfinite(r)], r[np.isfinite(r)]
        if not len(r):
            return -1
        top, none = float(r.max()), 0.0
        cum = np.cumsum(np.exp(r - top))
        if o.zoops is not None and n_sites >= 3:
            p = o.zoops * chain.n
            none = self.n_valid[i] * max(chain.n - n_sites - 1 + p, 0.0) / (n_sites + p) * math.exp(min(-top, 700))
        x = u * (cum[-1] + none)
        return int(names[min(int(np.searchsorted(cum, x, side="right")), len(names) - 1)]) if x < cum[-1] else -1

    def numbered(self, rank: np.ndarray) -> np.ndarray:
        """The window of each able sequence with a number, counted from 0 in the order of its windows."""
        n = self.n_valid // self.sides
        minus = rank >= n
        rank = np.where(minus, 2 * n - 1 - rank, rank)
        if self.valid is None:
            place = self.first + rank
        else:
            place = np.flatnonzero(self.valid)[np.cumsum(n) - n + rank]
        return place * 2 + minus

    def moved(self, site: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
        """Windows one letter on, and minus the log background of each; minus infinity where there is none."""
        to = site + 2 * np.where(site % 2, -by, by)
        place = to // 2
        on = (place >= 0) & (place < len(self.part.codes))
        logs = self.logs(self.plain, np.where(on, place, 0))
        return to, np.where(on, logs[np.arange(len(to)), to % 2 if self.sides == 2 else 0], -np.inf)

    def letters(self, site: np.ndarray, m: int) -> np.ndarray:
        """The letters in a column of windows."""
        place, minus = site // 2, site % 2 == 1
        c = self.part.codes[place + np.where(minus, self.o.width - 1 - m, m)]
        return np.where(minus, 3 - c, c)

    def tell(self, site: np.ndarray) -> np.ndarray:
        """What a sweep leaves, as whole numbers: sites, background, prior, then for the sites and for these one letter
        on and back the windows that do not exist, the background and the letters."""
        on = site >= 0
        held, out = site[on], [int(on.sum()), round(float(np.log(self.n_valid[on]).sum()) * _UNIT)]
        for by in (0, 1, -1):
            to, logs = self.moved(held, by)
            bad = int(np.count_nonzero(np.isinf(logs)))
            letters = [np.bincount(self.letters(to, m), minlength=4)[:4] for m in range(self.o.width)] if not bad else np.zeros((self.o.width, 4), np.int64)
            out += [bad, round(-float(logs.sum()) * _UNIT) if not bad else 0, *np.concatenate(letters).tolist()]
        return np.array(out, np.int64)

    def chosen(self, site: np.ndarray, profile: Profile) -> tuple[float, np.ndarray]:
        """Their part of the ilr of a profile, and the sites of all sequences; -1 for none."""
        sites, total = np.full(len(self.part.sizes), -1, np.int64), 0.0
        on = np.flatnonzero(site >= 0)
        if len(on):
            at = site[on] // 2 - self.first[on]
            sites[self.able[on]] = np.where(site[on] % 2, 2 * self.sizes[on] - self.o.width - at, at)
            sums = self.weights(profile)[1].sum(axis=1)[on]
            logs = np.log(np.maximum(sums, self.LEAST)) + profile.top
            for j in np.flatnonzero(sums <= self.LEAST).tolist():
                i = int(on[j])
                r = self.logs(profile.logs, slice(self.first[i], self.first[i] + self.sizes[i]))
                logs[j] = r.max() + math.log(np.exp(r - r.max()).sum())
            total = float((logs - np.log(self.n_valid[on])).sum())
        return total, sites


def drawing_profile(o: MotifOptions, chain: Chain, counts: np.ndarray, n_sites: int) -> np.ndarray:
    """Log frequencies, or gains of the clr, that sites are drawn by."""
    if not o.clr_sampling:
        return log_pwm(counts, o.pseudo, chain.base)
    grow = lambda x: (x + 1) * np.log(x + 1) - np.where(x > 0.5, x * np.log(np.maximum(x, 1)), 0)
    return grow(counts) - grow(np.float64(n_sites))


@dataclass
class Chain:
    """A restart of a dataset: its profile, and the sweep that was best. Sites are drawn again from these."""

    dataset: int
    k: int
    run: int
    n: int
    base: np.ndarray
    counts: np.ndarray | None = None
    n_sites: int = 0
    score: float = -math.inf
    best: tuple | None = None
    since: int = 0
    sweeps: int = 0
    live: bool = True

    def take(self, o: MotifOptions, sweep: int, told: np.ndarray) -> None:
        """The sums over all parts after a sweep; sweep 0 has drawn the first sites."""
        before = (self.counts, self.n_sites)
        n_sites, prior, size = int(told[0]), told[1] / _UNIT, 2 + 4 * o.width
        bad, bg, tables = zip(*[(int(x[0]), x[1] / _UNIT, x[2:].reshape(o.width, 4)) for x in told[2:].reshape(3, size)], strict=True)

        def clr_of(j: int) -> float:
            m, t = tables[j], max(n_sites, 1)
            out = float((m * np.log(np.maximum(m, 1))).sum()) - o.width * t * math.log(t) - bg[j]
            if o.zoops is not None:
                p = o.zoops * self.n
                out += math.lgamma(n_sites + p) + math.lgamma(self.n - n_sites + p) - math.lgamma(p) - math.lgamma(self.n + p) - prior
            return out if n_sites else -math.inf

        j = 0
        self.sweeps, self.n_sites = sweep, n_sites
        if sweep:
            rng = stream(o.seed, o.width, self.dataset, self.run, sweep)
            to = 1 if rng.random() < 0.5 else 2
            if rng.random() < o.shift_chance and n_sites and not bad[to]:
                gain = clr_of(to) - clr_of(0)
                j = to if gain >= 0 or rng.random() < math.exp(gain) else 0
            now = clr_of(j)
            self.since = 0 if now > self.score + 1e-6 else self.since + 1
            if self.since == 0:
                self.score, self.best = now, (*before, sweep, (0, 1, -1)[j], tables[j], n_sites)
            self.live = sweep < o.max_sweeps and (sweep < o.trial_sweeps or self.since < o.plateau)
        self.counts = tables[j].astype(float)
        if self.best is None:
            self.best = (*before, sweep, 0, tables[j], n_sites)


#: Parts that a task packs, about.
PACKED_TOGETHER = 8


def _packed(frame: DataFrame, sizes: dict[int, tuple[int, int]]) -> DataFrame:
    """Datasets in parts of about PART_LETTERS, dealt by the hash of sequences, written for the passes to come."""
    spark = frame.sparkSession
    parts = {d: max(1, -(-letters // PART_LETTERS)) for d, (_, letters) in sizes.items()}
    many = spark.createDataFrame(list(parts.items()), "dataset int, parts long")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["seq_id", "seq"])
        coded = [(s or "").encode().translate(_TRANSLATE) for s in pdf["seq"]]
        row = (int(pdf["dataset"].iloc[0]), int(pdf["part"].iloc[0]), pdf["seq_id"].to_numpy(np.int64).tobytes(), np.array([len(c) for c in coded], np.int64).tobytes(), b"\4".join([*coded, b""]))
        return pd.DataFrame([row], columns=["dataset", "part", "ids", "sizes", "codes"])

    dealt = frame.join(F.broadcast(many), "dataset").select("dataset", F.pmod(F.xxhash64("seq_id", "seq"), "parts").cast("int").alias("part"), "seq_id", "seq")
    tasks = min(4096, max(spark.sparkContext.defaultParallelism, sum(parts.values()) // PACKED_TOGETHER))
    return cut(dealt.repartition(tasks, "dataset", "part").groupBy("dataset", "part").applyInPandas(pack, _PART))


def _over(parts: DataFrame, each, schema: str) -> DataFrame:
    """``each`` over (dataset, part, ids, Part, what a task keeps) of all rows; its rows under the schema."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict = {}
        for pdf in batches:
            for d, part, ids, sizes, codes in pdf.itertuples(index=False):
                its = Part(np.frombuffer(codes, np.uint8), np.frombuffer(sizes, np.int64))
                yield pd.DataFrame(each(int(d), int(part), ids, its, kept), columns=names)

    return parts.mapInPandas(run, schema)


def _sums(df: DataFrame, keys: list[str]) -> dict[tuple, np.ndarray]:
    """Vectors of whole numbers summed by key; the driver gets one for each key."""
    out: dict[tuple, dict[int, int]] = {}
    for r in df.select(*keys, F.posexplode("v").alias("at", "x")).groupBy(*keys, "at").agg(F.sum("x").alias("x")).collect():
        out.setdefault(tuple(r[c] for c in keys), {})[r["at"]] = r["x"]
    return {key: np.array([v[i] for i in range(len(v))], np.int64) for key, v in out.items()}


def _wide_runs(frame: DataFrame, sizes: dict[int, tuple[int, int]], options: list[MotifOptions]) -> DataFrame:
    """RUN_SCHEMA of datasets that are too large for a task: a sweep is one pass over all parts of all datasets.

    The sites of a sweep are drawn from the profile that the sweep before left, so sequences do not wait for each
    other and only counts meet; leaving out a sequence's own site, as sample_together does, makes no odds in a profile
    of thousands. Sites are not kept: those of the best sweep are drawn again from its profile and random streams,
    which belong to (seed, width, dataset, run, sweep, part).
    """
    spark, parts = frame.sparkSession, _packed(frame, sizes)
    ways = sorted({(o.both_strands, k) for o in options for k in range(o.order + 1)})
    words = _sums(_over(parts, lambda d, part, ids, its, kept: [(d, both, k, its.words(k, both).tolist()) for both, k in ways], "dataset int, both boolean, k int, v array<long>"), ["dataset", "both", "k"])
    tables = {}
    for key, n in words.items():
        m = n.reshape(-1, 4) + 1.0
        tables[key] = np.log(m / m.sum(axis=1, keepdims=True)).ravel()
    of_run = {(d, k): [tables[d, o.both_strands, j] for j in range(o.order + 1)] for d in sizes for k, o in enumerate(options)}
    chains = [Chain(d, k, r, sizes[d][0], np.exp(of_run[d, k][0])) for d in sorted(sizes) for k, o in enumerate(options) for r in range(o.runs)]

    def drawn(its: list[Chain], tell, schema: str) -> DataFrame:
        by: dict[int, dict[int, list[Chain]]] = {}
        for c in its:
            by.setdefault(c.dataset, {}).setdefault(c.k, []).append(c)

        def each(d, part, ids, its, kept):
            def once(key, make):
                if key not in kept:
                    kept[key] = make()
                return kept[key]

            out = []
            for k, some in by.get(d, {}).items():
                scale = once((d, k), lambda k=k: Scale(options[k], of_run[d, k]))
                w = Windows(its, scale)
                out += [row for c in some for row in tell(c, w, part, ids, lambda name, pwm, scale=scale: once(name, lambda: Profile(scale, pwm())))]
            return out

        return _over(parts, each, schema)

    def drew(c: Chain, w: Windows, part: int, profile, counts, n_sites: int, sweep: int) -> np.ndarray:
        by = profile(("drawn", c.dataset, c.k, c.run), lambda: drawing_profile(w.o, c, counts, n_sites)) if n_sites else None
        return w.draw(c, by, n_sites, sweep, part)

    for sweep in range(max(o.max_sweeps for o in options) + 1):
        live = [c for c in chains if c.live]
        if not live:
            break
        told = _sums(drawn(live, lambda c, w, part, ids, profile, sweep=sweep: [(c.dataset, c.k, c.run, w.tell(drew(c, w, part, profile, c.counts, c.n_sites, sweep)).tolist())], "dataset int, k int, run int, v array<long>"), ["dataset", "k", "run"])
        for c in live:
            c.take(options[c.k], sweep, told[c.dataset, c.k, c.run])

    def last(c, w, part, ids, profile):
        counts, n_sites, sweep, by, after, _ = c.best
        site = drew(c, w, part, profile, counts, n_sites, sweep)
        if by:
            site = np.where(site >= 0, w.moved(site, by)[0], -1)
        ilr_part, sites = w.chosen(site, profile(("after", c.dataset, c.k, c.run), lambda: log_profile(after)))
        return [(c.dataset, c.k, c.run, part, round(ilr_part * _UNIT), ids, sites.astype(np.int32).tobytes())]

    ends = {(c.dataset, c.k, c.run): (c.score, c.sweeps) for c in chains}

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        key = tuple(int(pdf[c].iloc[0]) for c in ("dataset", "k", "run"))
        ids = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["ids"]])
        sites = np.concatenate([np.frombuffer(x, np.int32) for x in pdf["sites"]])[np.argsort(ids, kind="stable")]
        o = options[key[1]]
        score = ends[key][0] if o.rank == "clr" else sum(pdf["v"].tolist()) / _UNIT
        return pd.DataFrame([(key[0], o.width, key[2], score, ends[key][1], int((sites >= 0).sum()), sites)], columns=[c.split()[0] for c in RUN_SCHEMA.split(", ")])

    # a number for each sequence and restart meets in a row, which is what a row of the result holds
    found = cut(drawn(chains, last, "dataset int, k int, run int, part int, v long, ids binary, sites binary"))
    return found.groupBy("dataset", "k", "run").applyInPandas(gather, RUN_SCHEMA)


def best_runs(runs: DataFrame) -> DataFrame:
    """The best restart of each dataset and width; the later run wins a tie."""
    from .tables import best_run

    return best_run(runs, ["dataset", "width"], "score", "run")


# -- null sets -------------------------------------------------------------------------------------------------------

def _gapped(letters: str, template: str) -> str:
    if len(letters) == len(template):
        return letters
    it = iter(letters)
    return "".join(next(it) if c in "ACGTacgt" else c for c in template)


def _source(spark: SparkSession, seqs: list[str] | DataFrame) -> DataFrame:
    if isinstance(seqs, DataFrame):
        return seqs.select(F.col("seq_id").cast("long").alias("seq_id"), "seq")
    return spark.createDataFrame(list(enumerate(seqs)), "seq_id long, seq string")


_NULL = "dataset int, seq_id long, seq string"


#: Chains that must still go on for them to go on together.
SIDE_BY_SIDE = 8
#: Letters of the stretches that a chain is cut into, letters that lead up to one, and rounds in which all stretches
#: that began with a wrong context are drawn again. Letters of the chains that are drawn together.
STRETCH, LEAD, ROUNDS, DRAWN_LETTERS = 500, 64, 8, 1 << 20


def _walk(table: np.ndarray, flat: np.ndarray, first: np.ndarray, sizes: np.ndarray, states: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Writes the letters of chains that begin with some states, where their draws are; the states they end with. All
    chains take their next letter together, the longest last."""
    by = np.argsort(-sizes, kind="stable")
    first, sizes, state = first[by], sizes[by], states[by]
    steps, last, on, at, less = [np.ascontiguousarray(table[:, j]) for j in range(3)], len(table) - 1, len(by), 0, -sizes
    while (on := int(np.searchsorted(less[:on], -at, side="left"))) >= SIDE_BY_SIDE:
        place, now = first[:on] + at, state[:on]
        x = flat[place]
        b = (x >= steps[0][now]).view(np.int8) + (x >= steps[1][now]).view(np.int8) + (x >= steps[2][now]).view(np.int8)
        out[place] = b
        state[:on] = (now * 4 + b) & last
        at += 1
    rows = table.tolist()
    for i in range(on):
        s, letters = int(state[i]), []
        for x in flat[first[i] + at : first[i] + sizes[i]].tolist():
            row = rows[s]
            b = 0 if x < row[0] else 1 if x < row[1] else 2 if x < row[2] else 3
            letters.append(b)
            s = (s * 4 + b) & last
        out[first[i] + at : first[i] + sizes[i]] = letters
        state[i] = s
    ends = np.empty_like(state)
    ends[by] = state
    return ends


def _chains(table: np.ndarray, states: list[int], draws: list[np.ndarray]) -> list[str]:
    """A chain for each state, as long as its draws.

    Chains are walked in stretches side by side. A stretch begins with the context to which the draws before it lead
    from any other: from the same draws, chains soon are the same. Where that is not what the stretch before ends with,
    it is drawn again from there, so that the chain is the one that a walk letter by letter gives.
    """
    sizes = np.array([len(x) for x in draws], np.int64)
    flat = np.concatenate([*draws, np.zeros(0)])
    out = np.zeros(len(flat), np.int8)
    n = -(-sizes // STRETCH)
    whose = np.repeat(np.arange(len(draws)), n)
    nth = np.arange(len(whose)) - (np.cumsum(n) - n)[whose]
    first = (np.cumsum(sizes) - sizes)[whose] + nth * STRETCH
    size = np.minimum(STRETCH, sizes[whose] - nth * STRETCH)
    begin = np.array(states, np.int64)[whose]
    later = np.flatnonzero(nth > 0)
    begin[later] = _walk(table, flat, first[later] - LEAD, np.full(len(later), LEAD), np.zeros(len(later), np.int64), out)
    end = _walk(table, flat, first, size, begin, out)
    turn = 0
    while len(wrong := later[begin[later] != end[later - 1]]):
        if turn >= ROUNDS:  # chains that do not meet: the first wrong stretch of each
            wrong = wrong[np.unique(whose[wrong], return_index=True)[1]]
        begin[wrong] = end[wrong - 1]
        end[wrong] = _walk(table, flat, first[wrong], size[wrong], begin[wrong], out)
        turn += 1
    text = out.astype(np.uint8).tobytes().translate(BASES.encode() + bytes(252)).decode()
    return [text[a - k : a] for a, k in zip(np.cumsum(sizes).tolist(), sizes.tolist(), strict=True)]


def _draws(key: tuple[int, int], names: Iterable[tuple[int, int]], sizes: list[int]) -> list[np.ndarray]:
    """So many uniform draws for each name, a pair of numbers: they are half of the counter of one generator, which is
    set anew for each, as a generator for each would take longer than its draws."""
    bits = np.random.Philox(0)
    rng, state, out = np.random.Generator(bits), bits.state, []
    state["state"]["key"] = np.array([k % (1 << 64) for k in key], np.uint64)
    for (a, b), n in zip(names, sizes, strict=True):
        state["state"]["counter"] = np.array([0, 0, a % (1 << 64), b % (1 << 64)], np.uint64)
        bits.state = state
        out.append(rng.random(n))
    return out


def markov_null_sets(spark: SparkSession, seqs: list[str] | DataFrame, n: int, seed: int, order: int = 3) -> DataFrame:
    """(dataset, seq_id, seq): n sets drawn from a Markov chain of the sequences, as long as they, with their gaps.

    The chain is that of all sequences; every sequence begins with a context as frequent as it is. A sequence's
    stream belongs to (seed, dataset, seq_id), so sequences are drawn wherever they are. Only the chain is collected:
    4^(order+1) rows.
    """
    source = _source(spark, seqs)
    m = np.ones((4**order, 4))
    for r in transition_counts(source.withColumn("seq", F.upper("seq")), order).collect():
        at = 0
        for c in r.context:
            at = at * 4 + BASES.index(c)
        m[at, BASES.index(r.base)] = r.n
    table = np.cumsum(m / m.sum(axis=1, keepdims=True), axis=1)[:, :3]
    starts = np.cumsum(m.sum(axis=1) / m.sum())

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            coded = [t.encode().translate(_TRANSLATE) for t in pdf["seq"]]
            sizes = np.array([len(c) - c.count(4) for c in coded], np.int64)
            which = np.cumsum(sizes) // DRAWN_LETTERS
            for k in np.unique(which):
                its, some = pdf[which == k], sizes[which == k].tolist()
                drawn = _draws((seed, order), zip(its["dataset"].tolist(), its["seq_id"].tolist(), strict=True), [1 + n for n in some])
                states = np.minimum(np.searchsorted(starts, [x[0] for x in drawn], side="right"), 4**order - 1).tolist()
                letters = _chains(table, states, [x[1:] for x in drawn])
                yield pd.DataFrame({"dataset": its["dataset"], "seq_id": its["seq_id"], "seq": [_gapped(x, t) for x, t in zip(letters, its["seq"], strict=True)]})

    spread = source.filter("seq is not null").select(F.explode(F.sequence(F.lit(1), F.lit(n))).alias("dataset"), "seq_id", "seq")
    return spread.mapInPandas(draw, _NULL)


#: Rows of a part in which rows are numbered, about, and the most parts.
NUMBERED, PARTS = 1 << 18, 1024


def _numbered(df: DataFrame, by: list[str], h: str, tie: str, rows: int) -> DataFrame:
    """df with ``rank``: rows of equal ``by`` numbered from 0 in random order, in parts by their hash ``h``."""
    d = df.withColumn("__part", F.pmod(F.shiftright(h, 20), F.lit(min(PARTS, rows // NUMBERED + 1))))
    first = d.groupBy(*by, "__part").count()  # at most PARTS rows for each by
    first = first.select(*by, "__part", (F.sum("count").over(W.partitionBy(*by).orderBy("__part")) - F.col("count")).alias("__first"))
    d = d.withColumn("__at", F.row_number().over(W.partitionBy(*by, "__part").orderBy(h, tie)) - 1)
    return d.join(F.broadcast(first), [*by, "__part"]).withColumn("rank", F.col("__first") + F.col("__at")).drop("__part", "__first", "__at")


def gc_shares(pieces: dict[int, int], windows: dict[int, int], least: int, rng: np.random.Generator) -> list[tuple[int, int, int, int, int]]:
    """(gc, low, high, of, first): pieces low to high of a percent take the windows of percent ``of`` from ``first`` on.

    From counts alone: a percent takes its own windows while it has ``least``; what is left takes those of the nearest
    percents too, as many of each as drawing them one by one without putting back would give.
    """
    left, used, done, out = dict(windows), dict.fromkeys(windows, 0), dict.fromkeys(pieces, 0), []

    def take(gc: int, k: int, m: int) -> None:
        if m:
            out.append((gc, done[gc], done[gc] + m, k, used[k]))
            done[gc], used[k], left[k] = done[gc] + m, used[k] + m, left[k] - m

    for gc in sorted(pieces):
        take(gc, gc, min(pieces[gc], max(0, left.get(gc, 0) - least + 1)))
    for gc in rng.permutation(sorted(pieces)).tolist():
        while done[gc] < pieces[gc]:
            near, reach = [], 0
            while sum(left[k] for k in near) < least and reach <= 100:
                near = [k for k in range(gc - reach, gc + reach + 1) if left.get(k)]
                reach += 1
            if not near:
                raise ValueError("the genome has no windows left")
            sizes = np.array([left[k] for k in near])
            m = min(pieces[gc] - done[gc], max(1, int(sizes.sum()) - least + 1))
            if sizes.sum() < 10**9:  # what numpy can draw
                drawn = rng.multivariate_hypergeometric(sizes, m, method="marginals")
            else:
                drawn = np.minimum(rng.multinomial(m, sizes / sizes.sum()), sizes)
            for k, x in zip(near, drawn.tolist(), strict=True):
                take(gc, k, x)
    return out


def gc_null_sets(spark: SparkSession, seqs: list[str] | DataFrame, genome: DataFrame, n: int, seed: int, window: int = 50, least: int = 100) -> DataFrame:
    """(dataset, seq_id, seq): each piece of ``window`` letters is replaced by an unused genome window of the same GC percent.

    genome has (contig, seq). Windows overlap by half, from a phase drawn for each contig. Percents with fewer than
    ``least`` windows left take those of the nearest percents too. Windows are not put back. Pieces and windows of a
    percent are numbered in random order, ``gc_shares`` deals numbers from the counts of percents, which alone are
    collected, and pieces meet their windows in a join. Every set has its own order of pieces and goes through the
    windows in steps and from a place of its own.
    """
    from ..functions.scalar import bases_only, gc_percent
    from .intervals import sliding_windows

    def stretches(text: str, size: int) -> Column:
        return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % size), F.lit(0))

    source = cut(_source(spark, seqs).filter("seq is not null").withColumn("row", F.monotonically_increasing_id()))
    g = genome.select("contig", bases_only(F.col("seq")).alias("seq"))
    phase = F.pmod(F.xxhash64("contig", F.lit(seed)), F.lit(window // 2))
    # long stretches first, so that no letter is walked over more than a few times
    w = g.select("contig", phase.alias("phase"), F.posexplode(stretches("seq", window * 256)).alias("i", "part"))
    w = w.select("contig", "i", "part", F.explode(sliding_windows(F.length("part"), window, F.col("phase"))).alias("at"))
    w = w.select(F.substring("part", F.col("at").cast("int") + 1, F.lit(window)).alias("w"), F.xxhash64("contig", "i", "at", F.lit(seed)).alias("h"))
    w = cut(w.withColumn("of", F.round(gc_percent(F.col("w"))).cast("int")))
    p = source.select("row", F.xxhash64("seq_id", "seq").alias("s"), F.posexplode(stretches("seq", window * 256)).alias("i", "part"))
    p = p.select("row", "s", "i", F.posexplode(stretches("part", window)).alias("j", "piece"))
    p = cut(p.select("row", "s", (F.col("i").cast("long") * 256 + F.col("j")).alias("at"), F.bround(gc_percent(F.col("piece"))).cast("int").alias("gc")))
    windows = {r["of"]: r["count"] for r in w.groupBy("of").count().collect()}  # not more than 101 rows
    pieces = {r["gc"]: r["count"] for r in p.groupBy("gc").count().collect()}
    dealt = []
    for d in range(1, n + 1):
        rng = stream(seed, window, d)
        through = {}
        for k, size in sorted(windows.items()):
            pace = int(rng.integers(size)) + 1
            while math.gcd(pace, size) > 1:
                pace = pace % size + 1
            through[k] = (size, pace, int(rng.integers(size)))
        dealt += [(d, gc, low, high, k, first, *through[k]) for gc, low, high, k, first in gc_shares(pieces, windows, least, rng)]
    shares = spark.createDataFrame(dealt, "dataset int, gc int, low long, high long, of int, first long, size long, pace long, begin long")
    p = p.withColumn("dataset", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("h", F.xxhash64("s", "at", "dataset", F.lit(seed)))
    p = _numbered(p, ["dataset", "gc"], "h", "row", n * sum(pieces.values()))
    p = p.join(F.broadcast(shares), ["dataset", "gc"]).filter("low <= rank and rank < high")  # counts of percents
    # numbers below 2^31, so that no product passes 63 bits
    p = p.select("dataset", "row", "at", "of", F.expr("((first + rank - low) * pace + begin) % size").alias("rank"))
    met = p.join(_numbered(w, ["of"], "h", "w", sum(windows.values())), ["of", "rank"])
    texts = F.transform(F.array_sort(F.collect_list(F.struct("at", "w"))), lambda x: F.rpad(x["w"], window, "A"))
    met = met.groupBy("dataset", "row").agg(F.array_join(texts, "").alias("letters")).join(source, "row").select("dataset", "seq_id", "seq", "letters")
    empty = source.filter("length(seq) = 0").select(F.explode(F.sequence(F.lit(1), F.lit(n))).alias("dataset"), "seq_id", "seq", F.lit("").alias("letters"))

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = []
            for t, x in zip(pdf["seq"], pdf["letters"], strict=True):
                out = []
                for at in range(0, len(t), window):
                    piece = t[at : at + window]
                    out.append(_gapped(x[at : at + sum(map(piece.count, "ACGTacgt"))], piece))
                made.append("".join(out))
            yield pd.DataFrame({"dataset": pdf["dataset"], "seq_id": pdf["seq_id"], "seq": made})

    return met.unionByName(empty).mapInPandas(fill, _NULL)


# -- significance ----------------------------------------------------------------------------------------------------

def _gamma_fit(x: np.ndarray, shape_range: tuple[float, float]) -> tuple[float, float, float, float]:
    """Location, shape, scale and log-likelihood of a shifted Gamma, by profile likelihood in the location."""

    def at(loc: float) -> tuple[float, float, float]:
        y = x - loc
        m, ml = y.mean(), np.log(y).mean()
        s = math.log(m) - ml
        lo, hi = shape_range
        digamma = lambda a: (math.lgamma(a * (1 + 1e-6)) - math.lgamma(a * (1 - 1e-6))) / (2e-6 * a)
        for _ in range(80):
            a = math.sqrt(lo * hi)
            lo, hi = (a, hi) if math.log(a) - digamma(a) > s else (lo, a)
        a = math.sqrt(lo * hi)
        b = m / a
        return len(x) * ((a - 1) * ml - m / b - math.lgamma(a) - a * math.log(b)), a, b

    low, spread = float(x.min()), float(x.std(ddof=1)) or 1e-6
    lo, hi = low - 50 * spread, low - 1e-6 * spread
    g = (math.sqrt(5) - 1) / 2
    p, q = hi - g * (hi - lo), lo + g * (hi - lo)
    fp, fq = at(p)[0], at(q)[0]
    for _ in range(80):
        if fp > fq:
            hi, q, fq = q, p, fp
            p = hi - g * (hi - lo)
            fp = at(p)[0]
        else:
            lo, p, fp = p, q, fq
            q = lo + g * (hi - lo)
            fq = at(q)[0]
    loc = (lo + hi) / 2
    like, a, b = at(loc)
    return loc, a, b, like


def _simplex(f, start: np.ndarray, steps: np.ndarray, limit: int = 400) -> tuple[np.ndarray, float]:
    """Nelder-Mead maximisation."""
    pts = [start, *(start + np.eye(len(start))[i] * steps[i] for i in range(len(start)))]
    val = [f(p) for p in pts]
    for _ in range(limit):
        order = np.argsort(val)[::-1]
        pts, val = [pts[i] for i in order], [val[i] for i in order]
        if math.isfinite(val[-1]) and val[0] - val[-1] < 1e-10:
            break
        mid = np.mean(pts[:-1], axis=0)
        r = mid + (mid - pts[-1])
        fr = f(r)
        if fr > val[0]:
            e = mid + 2 * (mid - pts[-1])
            fe = f(e)
            pts[-1], val[-1] = (e, fe) if fe > fr else (r, fr)
        elif fr > val[-2]:
            pts[-1], val[-1] = r, fr
        else:
            c = mid + 0.5 * (pts[-1] - mid)
            fc = f(c)
            if fc > val[-1]:
                pts[-1], val[-1] = c, fc
            else:
                pts = [pts[0]] + [pts[0] + 0.5 * (p - pts[0]) for p in pts[1:]]
                val = [val[0]] + [f(p) for p in pts[1:]]
    k = int(np.argmax(val))
    return pts[k], val[k]


def gamma_significance(observed: float, null: np.ndarray, conf: float = 0.1, shapes: tuple[float, float] = (7.0, 200.0)) -> dict[str, float]:
    """Point p-value of the observed score under a shifted Gamma of the null scores, and the largest tail within the
    likelihood-ratio region (chi-squared, 3 degrees of freedom, level 1 - conf)."""
    x = np.asarray(null, float)
    loc, shape, scale, like = _gamma_fit(x, shapes)
    tail = lambda v: special.gamma_q(v[1], (observed - v[0]) / v[2]) if observed > v[0] else 1.0
    cut = like - special.chi2_quantile(1 - conf, 3) / 2

    def inside(v: np.ndarray) -> float:
        if v[2] <= 0 or not shapes[0] <= v[1] <= shapes[1] or v[0] >= x.min():
            return -math.inf
        y = x - v[0]
        ll = ((v[1] - 1) * np.log(y) - y / v[2] - math.lgamma(v[1]) - v[1] * math.log(v[2])).sum()
        return tail(v) if ll >= cut else -1 - (cut - ll)

    spread, best = float(x.std(ddof=1)) or 1e-6, tail((loc, shape, scale))
    starts = [(loc, shape, scale)] + [(loc - i * spread, min(shapes[1], max(shapes[0], shape * j)), scale * k) for i in (0.5, 1, 2) for j in (0.8, 1.25) for k in (0.8, 1, 1.25)]
    for s in starts:
        v, value = _simplex(inside, np.array(s, float), np.array([0.3 * spread, 0.1 * s[1], 0.1 * s[2]]))
        best = max(best, value)
    return {"location": loc, "shape": shape, "scale": scale, "p_value": tail((loc, shape, scale)), "p_upper": min(1.0, best)}


def significance(best: DataFrame, conf: float = 0.1) -> DataFrame:
    """Per width: dataset 0 is observed, the others are the null. (width, observed, location, shape, scale, p_value, p_upper)."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        seen, null = pdf[pdf.dataset == 0].score, pdf[pdf.dataset > 0].score
        if not len(seen) or len(null) < 3:
            return pd.DataFrame(columns=["width", "observed", "location", "shape", "scale", "p_value", "p_upper"])
        r = gamma_significance(float(seen.iloc[0]), null.to_numpy(), conf)
        return pd.DataFrame([{"width": int(pdf.width.iloc[0]), "observed": float(seen.iloc[0]), **r}])

    return best.select("width", "dataset", "score").groupBy("width").applyInPandas(fit, "width int, observed double, location double, shape double, scale double, p_value double, p_upper double")


# -- column dependency -----------------------------------------------------------------------------------------------

def _informations(tables: np.ndarray) -> np.ndarray:
    """Mutual information, in bits, of tables of counts: the last two axes are the letters of the two columns."""
    n = tables.sum(axis=(-2, -1), keepdims=True)
    expected = tables.sum(axis=-1, keepdims=True) * tables.sum(axis=-2, keepdims=True) / n
    ratio = np.where(tables > 0, tables / np.where(expected > 0, expected, 1), 1.0)
    return (tables / n * np.log2(ratio)).sum(axis=(-2, -1))


def shuffled_tables(table: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """n tables as a permutation of one column against the other makes them: all that stays is both sums.

    Each letter of the first column takes its share of what is left of the second column's letters, one letter after
    another, which is a hypergeometric draw for all n tables at once.
    """
    out = np.zeros((n, *table.shape), np.int64)
    left = np.tile(table.sum(axis=0), (n, 1))
    for i, size in enumerate(table.sum(axis=1)[:-1].tolist()):
        want = np.full(n, size)
        for j in range(table.shape[1] - 1):
            rest = left[:, j + 1 :].sum(axis=1)
            out[:, i, j] = rng.hypergeometric(left[:, j], rest, want)
            want = want - out[:, i, j]
        out[:, i, -1] = want
        left = left - out[:, i]
    out[:, -1] = left
    return out


def column_dependency(sites: DataFrame, pairs: DataFrame, seed: int, alpha: float = 0.05, first: int = 1000, most: int = 1_000_000, n_pairs: int | None = None, stop: str = "interval") -> DataFrame:
    """Permutation test of the mutual information of column pairs, with a growing number of permutations.

    The number doubles from ``first`` to ``most`` and stops when the confidence interval of the p-value leaves the
    Bonferroni cut-off (``stop='interval'``) or when the standard error is a tenth of it (``stop='error'``).
    sites has (seq_id, kmer), an alignment of any number of rows, of which only the 16 counts of each pair (col1, col2)
    are needed: a permutation changes nothing else.
    """
    if stop not in ("interval", "error"):
        raise ValueError("stop must be interval or error")
    n = n_pairs or pairs.count()
    cut = alpha / max(1, n)
    z = 1.959963984540054
    cells = column_pairs(sites).filter(F.col("base1").rlike("^[ACGTacgt]$") & F.col("base2").rlike("^[ACGTacgt]$"))
    tables = cells.join(pairs.select("col1", "col2").distinct(), ["col1", "col2"])
    tables = tables.groupBy("col1", "col2").agg(F.collect_list(F.struct(F.upper("base1").alias("a"), F.upper("base2").alias("b"), "n")).alias("cells"))  # 16 of them, or 64 in two cases

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for c1, c2, cells in pdf[["col1", "col2", "cells"]].itertuples(index=False):
                table = np.zeros((4, 4), np.int64)
                for x in cells:
                    table[BASES.index(x["a"]), BASES.index(x["b"])] += x["n"]
                seen, rng = float(_informations(table)), stream(seed, int(c1), int(c2))
                done = hits = 0
                want = min(first, most)
                while True:
                    for size in _parts(want - done):
                        hits += int((_informations(shuffled_tables(table, size, rng)) >= seen - 1e-12).sum())
                    done = want
                    nn = done + z * z
                    p = (hits + z * z / 2) / nn
                    half = z * math.sqrt(p * (1 - p) / nn)
                    lo, hi = max(0.0, p - half), min(1.0, p + half)
                    clear = lo > cut or hi < cut if stop == "interval" else math.sqrt(max(p * (1 - p), 1e-12) / done) < p / 10
                    if clear or done >= most:
                        break
                    want = min(most, 2 * done)
                out.append((int(c1), int(c2), seen, done, hits / done, lo, hi, cut))
            yield pd.DataFrame(out, columns=["col1", "col2", "ent", "n_perms", "pval", "lo", "hi", "cutoff"])

    return tables.repartition("col1", "col2").mapInPandas(test, "col1 int, col2 int, ent double, n_perms int, pval double, lo double, hi double, cutoff double")


def _parts(n: int, size: int = 1 << 16) -> list[int]:
    return [min(size, n - i) for i in range(0, n, size)]


# -- grids and reports -----------------------------------------------------------------------------------------------

def experiment_grid(spark: SparkSession, widths: list[int], null_sets: int) -> DataFrame:
    """(width, dataset): the real set (0) and all null sets for every width."""
    ws = spark.createDataFrame([(w,) for w in widths], "width int")
    return ws.select("width", F.explode(F.sequence(F.lit(0), F.lit(null_sets))).alias("dataset"))


def monte_carlo_common(tiles: DataFrame, replicates: int, seed: int, width: int = 50) -> DataFrame:
    """(replicate, n): common bins when each group's positions are drawn uniformly within its tiles.

    tiles has (tile, tile_width, group, n). A draw is a hash of (seed, replicate, tile, group, number), so it does
    not depend on the layout.
    """
    spark = tiles.sparkSession
    groups = tiles.agg(F.count_distinct("group").alias("g"))
    d = tiles.filter("n > 0").select("tile", "tile_width", "group", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i"))
    d = d.select("*", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    u = F.pmod(F.xxhash64(F.lit(seed), "replicate", "tile", "group", "i"), F.lit(1 << 53)) / float(1 << 53)
    pos = F.bround(F.col("tile") + u * F.col("tile_width"), 0)
    d = d.select("replicate", "group", (F.floor(pos / width) * width).alias("bin"))
    k = d.groupBy("replicate", "bin").agg(F.count_distinct("group").alias("k"))
    k = k.join(F.broadcast(groups), F.col("k") == F.col("g")).groupBy("replicate").agg(F.count("*").alias("n"))  # one row
    return spark.range(1, replicates + 1).select(F.col("id").cast("int").alias("replicate")).join(k, "replicate", "left").select("replicate", F.coalesce("n", F.lit(0)).alias("n"))


def report(best: DataFrame, datasets: dict[int, list[str]] | DataFrame, o: MotifOptions) -> DataFrame:
    """(dataset, width, seq_id, position, kmer) of the sites of the best runs, in public positions."""
    from ..functions.scalar import reverse_complement

    sets = as_sets(best.sparkSession, datasets).withColumn("i", F.expr("row_number() over (partition by dataset order by seq_id, seq) - 1"))
    sites = best.select("dataset", "width", F.posexplode("sites").alias("i", "at")).filter("at >= 0")
    length = F.length("seq")
    met = sites.join(sets, ["dataset", "i"])
    both = F.concat("seq", reverse_complement(F.col("seq")))
    position = F.when(F.col("at") < length, F.col("at") + 1).otherwise(F.col("at") - 2 * length)
    return met.select("dataset", "width", "seq_id", position.alias("position"), both.substr(F.col("at") + 1, F.col("width")).alias("kmer"))
