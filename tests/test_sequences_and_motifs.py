"""Sequence scores, sampler invariants, significance, special functions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import special
from tidemark.operators import motif, sequences as Q, stats as M
from tidemark.plans import queries as plans


def planted(n=20, seed=4, motif_word="GGGACTTTCC"):
    r = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        s = "".join("ACGT"[i] for i in r.integers(4, size=80))
        at = int(r.integers(70))
        out.append(s[:at] + motif_word + s[at + len(motif_word):])
    return out


def test_sampler_finds_a_planted_motif(spark):
    seqs = planted()
    o = motif.MotifOptions(seed=1, width=10, runs=4, order=1, plateau=15, max_sweeps=60)
    best = motif.best_runs(motif.gibbs_runs(spark, {0: seqs}, [o]))
    sites = motif.report(best, {0: seqs}, o).collect()
    # a neighbouring phase or the other strand can score as well
    assert sum("GGACTTTC" in r.kmer or "GAAAGTCC" in r.kmer for r in sites) >= 14
    again = motif.best_runs(motif.gibbs_runs(spark, {0: seqs}, [o])).collect()
    assert again == best.collect()  # the same seed, the same result


def test_reported_score_is_that_of_the_sites():
    seqs = planted()
    o = motif.MotifOptions(seed=2, width=8, order=1, plateau=5, max_sweeps=15)
    data = motif.Sequences(seqs, 8, 1)
    score, sites, _ = motif.sample_run(data, o, motif.stream(2))
    assert score == pytest.approx(motif.ilr(data, data.counts(sites), sites))
    counts = data.counts(sites)
    assert (counts.sum(axis=1) == (sites >= 0).sum()).all()


def test_scores_agree_with_the_frames(spark):
    seqs = planted(6)
    data = motif.Sequences(seqs, 8, 1)
    df = spark.createDataFrame(list(enumerate(seqs)), "seq_id int, seq string")
    bg = Q.background_scores(df, Q.markov_models(df, 1), 1, 8, how="flank")
    for r in bg.filter("strand = 1 and (pos < 5 or pos > 70)").collect():
        assert r.log_bg == pytest.approx(data.log_bg[r.seq_id][r.pos])
    sites = np.array([3, 10, 0, 7, 20, 1])
    at = spark.createDataFrame([(i, 1, int(p)) for i, p in enumerate(sites)], "seq_id int, strand int, pos int")
    n_valid = bg.groupBy("seq_id").count().withColumnRenamed("count", "n_valid")
    got = Q.clr_score(at, bg, n_valid, zoops=0.2).first().clr
    assert got == pytest.approx(motif.clr(data, sites, 0.2))


def test_em_does_not_get_worse():
    data = motif.Sequences(planted(), 10, 1)
    rng = motif.stream(5)
    _, sites, _ = motif.sample_run(data, motif.MotifOptions(seed=5, width=10, order=1, plateau=2, max_sweeps=3, zoops=None), rng)
    before = motif.ilr(data, data.counts(sites))
    counts, after = motif.em_refine(data, data.counts(sites))
    assert after >= before
    assert (motif.reassign(data, counts, 5) >= 0).sum() == 5


def test_null_sets_keep_shape(spark):
    seqs = ["ACGTNACGTACG", "GGGCCC"]
    for df in (motif.markov_null_sets(spark, seqs, 3, seed=1, order=1), motif.gc_null_sets(spark, seqs, spark.createDataFrame([("c", "ACGTGC" * 300)], "contig string, seq string"), 3, seed=1, window=6)):
        rows = df.collect()
        assert len(rows) == 6
        for r in rows:
            assert len(r.seq) == len(seqs[r.seq_id]) and [i for i, c in enumerate(r.seq) if c == "N"] == [i for i, c in enumerate(seqs[r.seq_id]) if c == "N"]


def test_gamma_fit_on_simulated_scores():
    r = np.random.default_rng(1)
    null = 10 + r.gamma(20, 2, size=400)
    g = motif.gamma_significance(10 + 60.0, null)
    want = special.gamma_q(20, 30)
    assert want / 3 < g["p_value"] < want * 3 and g["p_upper"] >= g["p_value"]


def test_permutation_dependency(spark):
    r = np.random.default_rng(2)
    words = []
    for i in range(60):
        a, b = "ACGT"[r.integers(4)], "ACGT"[r.integers(4)]
        words.append((i, a + a + b))
    df = spark.createDataFrame(words, "seq_id int, kmer string")
    pairs = spark.createDataFrame([(0, 1), (0, 2)], "col1 int, col2 int")
    got = {(x.col1, x.col2): x for x in motif.column_dependency(df, pairs, seed=3, most=2000).collect()}
    assert got[0, 1].pval < 0.01 and got[0, 2].pval > 0.01


def test_special_functions():
    assert special.gamma_q(1, 2) == pytest.approx(math.exp(-2))
    assert special.gamma_p(3, 0.5) + special.gamma_q(3, 0.5) == pytest.approx(1)
    assert special.t_cdf(0, 5) == pytest.approx(0.5) and special.t_cdf(2.015, 5) == pytest.approx(0.95, abs=1e-4)
    assert special.chi2_quantile(0.95, 3) == pytest.approx(7.8147, abs=1e-3)
    assert special.hypergeometric_tail(5, 5, 5, 10) == pytest.approx(1 / 252)


def test_binomial_interval_of_a_sure_thing(spark):
    lo, hi = M.binomial_interval(F.col("k"), F.col("n"))
    r = spark.createDataFrame([(1000, 1000)], "k long, n long").select(lo.alias("lo"), hi.alias("hi")).first()
    assert r.lo == pytest.approx(0.995383, abs=1e-6) and r.hi == 1.0


def test_regressions(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(300, 3))
    y = 1 + x @ [2.0, 0.0, -1.0] + r.normal(size=300) * 0.1
    df = spark.createDataFrame([(i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))], "key long, a double, b double, c double, y double")
    fit = {t.term: t.coefficient for t in M.multiple_ols(df, "y", ["a", "b", "c"]).collect()}
    want = np.linalg.lstsq(np.c_[np.ones(300), x], y, rcond=None)[0]
    assert [fit[k] for k in ("(intercept)", "a", "b", "c")] == pytest.approx(list(want)) and fit["r2"] > 0.99
    chosen = M.lasso_cv(df, "y", ["a", "b", "c"], "key", [0.001, 0.01, 0.1, 1.0, 3.0]).filter("chosen").collect()
    assert len(chosen) == 1 and chosen[0]["lambda"] < 1


#: Twelve aligned words and the dependency of their informative columns, in bits.
WORDS = "AAAAAGAA AAAAAGAA AAGGAGAA AAAAAGAA AAAGAGAA AAGAAGAA AAAAAGAA AAAGAGAA AAGGAGAA AAGAAGAA AAGGAGAA ATGAAGAA".split()
BITS = {(2, 3): 0.089, (2, 4): 0.069, (3, 4): 0.021}


def test_known_dependency(spark):
    df = spark.createDataFrame(list(enumerate(WORDS)), "seq_id int, kmer string")
    pairs = {(r.col1 + 1, r.col2 + 1) for r in Q.informative_pairs(Q.position_profile(df)).collect()}
    got = {(r.col1 + 1, r.col2 + 1): round(r.bits, 3) for r in Q.mutual_information(df).collect()}
    assert pairs == set(BITS) and {p: got[p] for p in BITS} == BITS


def test_backgrounds_by_hand(spark):
    seqs = ["ACGTNNACGTTGCAACGT", "GGGCATTACG", "AC"]
    df = spark.createDataFrame(list(enumerate(seqs)), "seq_id int, seq string")
    models = Q.markov_models(df, 2)
    lp = {(r.context, r.base): math.log(r.prob) for r in models.collect()}
    rc = lambda s: s[::-1].translate(str.maketrans("ACGTN", "TGCAN"))
    span, order = 3, 2

    def context(s, i, begin=0):
        c = s[max(begin, i - order) : i]
        return c[c.rfind("N") + 1 :]

    def plain(s, p):
        return [lp[context(s, i), s[i]] for i in range(p, p + span)]

    def opposite(s, i):
        t = rc(s)
        j = len(s) - 1 - i
        return lp[context(t, j), t[j]]

    def want(s, p, how):
        if how == "site":
            return sum(lp[context(s, i, p), s[i]] for i in range(p, p + span))
        if how == "gmean":
            return sum((lp[context(s, i), s[i]] + opposite(s, i)) / 2 for i in range(p, p + span))
        if how == "amean":
            return sum(math.log((math.exp(lp[context(s, i), s[i]]) + math.exp(opposite(s, i))) / 2) for i in range(p, p + span))
        out = sum(plain(s, p))
        for i in range(p + span, min(len(s), p + span + order)) if how == "flank" else ():
            if s[i] == "N":
                break
            out += lp[context(s, i), s[i]] - lp[context(s, i, p + span), s[i]]
        return out

    for how in Q.BACKGROUNDS:
        got = {(r.seq_id, r.strand, r.pos): (r.kmer, r.log_bg) for r in Q.background_scores(df, models, order, span, how=how).collect()}
        rows = {(i, k, p): (s[p : p + span], want(s, p, how)) for i, t in enumerate(seqs) for k, s in ((1, t), (-1, rc(t))) for p in range(len(s) - span + 1) if "N" not in s[p : p + span]}
        assert got.keys() == rows.keys()
        for key, (word, value) in rows.items():
            assert got[key][0] == word and got[key][1] == pytest.approx(value)
    letters = {(r.seq_id, r.strand, r.pos): r.lp for r in Q.letter_probabilities(df, models, order).collect()}
    assert letters[0, 1, 4] is None and letters[0, 1, 7] == pytest.approx(lp["A", "C"])


def test_long_texts_are_cut_evenly(spark, monkeypatch):
    r = np.random.default_rng(3)
    text = "".join("ACGT"[i] for i in r.integers(4, size=70_000))
    df = spark.createDataFrame([(1, text), (2, "ACG"), (3, ""), (4, None)], "seq_id int, seq string")
    words = Q.kmers(df, 5).orderBy("seq_id", "pos").collect()
    assert [x.kmer for x in words] == [text[i : i + 5] for i in range(len(text) - 4)] and [x.pos for x in words] == list(range(len(text) - 4))


def test_profiles_and_priors(spark):
    sites = spark.createDataFrame([(0, "ACG"), (1, "ACT"), (2, "TCG")], "seq_id int, kmer string")
    profile = Q.position_profile(sites)
    back = {(r.col, r.base): r.freq for r in Q.reverse_profile(profile).collect()}
    assert back[2, "T"] == pytest.approx(2 / 3) and back[1, "G"] == 1.0
    moved = {(r.col, r.base): (r.freq, r.is_gap) for r in Q.shift_profile(profile, 1, 3).collect()}
    assert moved[0, "C"] == (1.0, False) and moved[2, "A"] == (0.25, True)
    bg = spark.createDataFrame([(0, 1, p, "ACG", -3.0 - p) for p in range(3)] + [(1, 1, 0, "TCG", -2.0)], "seq_id int, strand int, pos int, kmer string, log_bg double")
    best = Q.best_sites(bg, Q.position_profile(sites, 0.1), 1).collect()
    assert len(best) == 1 and (best[0].seq_id, best[0].pos) == (0, 2)
    prior = spark.createDataFrame([(0, 1, p, 1.0 + p) for p in range(3)] + [(1, 1, 0, 5.0)], "seq_id int, strand int, pos int, prior double")
    n_valid = bg.groupBy("seq_id").agg(F.count("*").alias("n_valid"))
    folded = {(r.seq_id, r.pos): r.log_bg for r in Q.fold_prior(bg, prior, n_valid).collect()}
    assert folded[0, 2] == pytest.approx(-5.0 - math.log(3 / 6 * 3)) and folded[1, 0] == pytest.approx(-2.0)


def test_samplers_agree():
    seqs = planted(12)
    o = motif.MotifOptions(seed=3, width=10, order=1, plateau=12, max_sweeps=60, runs=4)
    data = motif.Sequences(seqs, 10, 1)
    together = motif.sample_together(data, o, motif.stream(3), 4)
    alone = [motif.sample_run(data, o, motif.stream(3, k)) for k in range(4)]
    assert max(x[0] for x in together) == pytest.approx(max(x[0] for x in alone), rel=0.1)
    for score, sites, _ in together:
        assert score == pytest.approx(motif.run_score(data, sites, o))
    old, motif.LETTERS_BYTES = motif.LETTERS_BYTES, 0  # letters made when needed give the same
    try:
        again = motif.sample_together(data, o, motif.stream(3), 4)
    finally:
        motif.LETTERS_BYTES = old
    assert [(a[0], a[1].tolist()) for a in together] == [(b[0], b[1].tolist()) for b in again]


def test_valid_sites_are_counted_without_rows_for_them(spark, data):
    df = spark.createDataFrame([(0, "ACGTNACG"), (0, "TTTT"), (1, "ACNNACGTACnnGT"), (2, "ACG"), (3, None), (None, "ACGTA")], "seq_id long, seq string")
    for both in (True, False):
        counted = Q.valid_site_counts(df, 4, both)
        rows = Q.valid_sites(df, 4, both).groupBy("seq_id").count()
        assert sorted(counted.collect(), key=str) == sorted(rows.withColumnRenamed("count", "n").collect(), key=str)
    query = plans.QUERIES["valid_sites"](spark, data)
    assert "Generate" not in query._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("rank", "zoops"), [("ilr", 0.2), ("clr", 0.2), ("ilr", None)])
def test_large_datasets_are_sampled_in_parts(spark, monkeypatch, rank, zoops):
    seqs = planted(60)
    seqs[3] = seqs[3][:30] + "NN" + seqs[3][32:]
    seqs[5:8] = [seqs[4], "", "ACG"]
    o = motif.MotifOptions(seed=3, width=10, order=1, plateau=8, max_sweeps=25, runs=6, rank=rank, zoops=zoops)
    monkeypatch.setattr(motif, "WHOLE_LETTERS", 0)
    monkeypatch.setattr(motif, "PART_LETTERS", 1000)
    runs = motif.gibbs_runs(spark, {0: seqs, 1: seqs[:20]}, [o])
    rows = {(r.dataset, r.run): r for r in runs.collect()}
    assert len(rows) == 12 and runs.schema.simpleString() == motif.gibbs_runs(spark, {}, [o]).schema.simpleString()
    data = motif.Sequences(seqs, 10, 1)
    for r in range(6):
        sites = np.array(rows[0, r].sites)
        assert len(sites) == 60 and rows[0, r].n_sites == (sites >= 0).sum() and (sites[6], sites[7]) == (-1, -1)
        assert all(data.valid[i][p] for i, p in enumerate(sites) if p >= 0)
        assert rows[0, r].score == pytest.approx(motif.run_score(data, sites, o))
        assert zoops is not None or rows[0, r].n_sites == 58
    if zoops:
        best = max((rows[0, r] for r in range(6)), key=lambda x: x.score)
        words = ["".join("ACGTN"[c] for c in data.windows[i][p]) for i, p in enumerate(best.sites) if p >= 0]
        assert sum("GGACTTTC" in w or "GAAAGTCC" in w for w in words) >= 30
    # neither the layout nor a smaller dataset beside it counts
    frame = motif.as_sets(spark, {0: seqs}).repartition(7)
    assert {r.run: (r.score, r.sites) for r in motif.gibbs_runs(spark, frame, [o]).collect()} == {r: (rows[0, r].score, rows[0, r].sites) for r in range(6)}


@pytest.mark.parametrize("background", ["plain", "flank", "site", "gmean", "amean"])
@pytest.mark.parametrize("order", [0, 2])
def test_windows_are_looked_up_by_their_words(monkeypatch, background, order):
    r = np.random.default_rng(4)
    seqs = ["".join(r.choice(list("ACGTN"), n, p=[0.3, 0.2, 0.25, 0.23, 0.02])) for n in (0, 3, 7, 90, 6, 400, 0, 33)]
    o = motif.MotifOptions(seed=3, width=7, order=order, background=background)
    part = motif.Part(np.frombuffer(b"\4".join([s.encode().translate(motif._TRANSLATE) for s in seqs] + [b""]), np.uint8), np.array([len(s) for s in seqs]))
    data = motif.Sequences(seqs, 7, order, background=background)
    m = [part.words(k, True).reshape(-1, 4) + 1.0 for k in range(order + 1)]
    tables = [np.log(x / x.sum(axis=1, keepdims=True)).ravel() for x in m]
    assert np.exp(tables[0]) == pytest.approx(data.base)
    if background in ("plain", "flank", "site"):
        monkeypatch.setattr(motif, "window_logs", None)  # a sweep scores no letter anew
    scale = motif.Scale(o, tables)
    windows = motif.Windows(part, scale)
    pwm = np.log(r.dirichlet([1] * 4, 7))
    profile = motif.Profile(scale, pwm)
    sums = windows.weights(profile)[1].sum(axis=1)
    assert windows.able.tolist() == np.flatnonzero(data.n_valid).tolist() and windows.n_valid.tolist() == data.n_valid[windows.able].tolist()
    for j, i in enumerate(windows.able.tolist()):
        names, logs = windows.of_sequence(j, windows.logs(profile.logs, slice(part.first[i], part.first[i] + len(seqs[i]))))
        want = data.ratios(i, pwm)
        assert logs[np.isfinite(logs)] == pytest.approx(want[np.isfinite(want)])
        assert math.log(sums[j]) + profile.top == pytest.approx(math.log(np.exp(want).sum()))
        ranks = np.zeros(len(windows.able), np.int64)
        for rank, name in enumerate(names[np.isfinite(logs)].tolist()):
            ranks[j] = rank
            assert windows.numbered(ranks)[j] == name


def test_long_chains_are_walked_in_stretches(monkeypatch):
    r, longest, walk = np.random.default_rng(2), [], motif._walk
    monkeypatch.setattr(motif, "_walk", lambda *a: longest.append(int(a[3].max())) or walk(*a))
    never = np.array([[0, 1.0, 1], [0, 0, 1], [0, 0, 0], [1, 1, 1]])  # chains from different contexts never meet
    for table in (np.cumsum(r.dirichlet([1] * 4, 64), axis=1)[:, :3], never):
        draws = [r.random(n) for n in (0, 20000, 3, 700)]
        got = motif._chains(table, [0, 1, 2, 3], draws)
        for state, x, text in zip([0, 1, 2, 3], draws, got, strict=True):
            for u, letter in zip(x, text, strict=True):
                at = int((u >= table[state]).sum())
                assert letter == "ACGT"[at]
                state = (state * 4 + at) % len(table)
    assert max(longest) <= motif.STRETCH


def test_clr_sampling_finds_the_motif():
    seqs = planted(15)
    o = motif.MotifOptions(seed=5, width=10, order=1, plateau=12, max_sweeps=60, runs=4, clr_sampling=True, rank="clr")
    data = motif.Sequences(seqs, 10, 1)
    best = max(motif.sample_together(data, o, motif.stream(5), 4), key=lambda x: x[0])
    words = ["".join("ACGTN"[c] for c in data.windows[i][p]) for i, p in enumerate(best[1]) if p >= 0]
    assert sum("GGACTTTC" in w or "GAAAGTCC" in w for w in words) >= 8


def test_shuffled_tables_are_permutations():
    r = np.random.default_rng(6)
    a, b = r.integers(0, 4, 40), r.integers(0, 4, 40)
    table = np.zeros((4, 4), np.int64)
    np.add.at(table, (a, b), 1)
    drawn = motif.shuffled_tables(table, 4000, r)
    assert (drawn.sum(axis=2) == table.sum(axis=1)).all() and (drawn.sum(axis=1) == table.sum(axis=0)).all() and drawn.min() >= 0
    plain = np.zeros((4000, 4, 4), np.int64)
    for k in range(4000):
        np.add.at(plain[k], (a, r.permutation(b)), 1)
    assert np.abs(drawn.mean(axis=0) - plain.mean(axis=0)).max() < 0.15 and np.abs(drawn.std(axis=0) - plain.std(axis=0)).max() < 0.1
    assert abs(np.quantile(motif._informations(drawn), 0.9) - np.quantile(motif._informations(plain), 0.9)) < 0.02


def test_small_statistics(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 9.0)], "g string, v double")
    assert M.welch_t(df, "g", "v", "a", "b").first() == (None, None, None) and M.welch_t(df, "g", "v", "a", "z").first().t is None
    assert M.normality(df.limit(0), "v").count() == 0 and M.normality(df.filter("g = 'b'"), "v").first().normal is None
    r = np.random.default_rng(7)
    normal = spark.createDataFrame([(float(x),) for x in r.normal(size=200)], "v double")
    skew = spark.createDataFrame([(float(x),) for x in r.exponential(size=200)], "v double")
    assert M.shapiro_wilk(normal, "v").first().p_value > 0.01 and M.shapiro_wilk(skew, "v").first().p_value < 1e-6
    assert M.shapiro_wilk(df, "v").first().w is None
    # Eleven published weights, with the first doubled to make twelve, are far from normal
    w = M.shapiro_wilk(spark.createDataFrame([(float(x),) for x in (148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236, 236)], "v double"), "v").first()
    assert 0.7 < w.w < 0.85 and w.p_value < 0.02
    x = r.normal(size=(200, 2))
    big = spark.createDataFrame([(1e9 + float(a), float(b), float(a + b)) for a, b in x], "a double, b double, c double")
    fit = {t.term: t.coefficient for t in M.multiple_ols(big, "c", ["a", "b"]).collect()}
    assert fit["a"] == pytest.approx(1, abs=1e-5) and fit["r2"] == pytest.approx(1)
    near = spark.createDataFrame([(float(a), float(a + 0.01 * e), float(b)) for (a, b), e in zip(x, r.normal(size=200), strict=True)], "a double, b double, c double")
    assert M.drop_highest_vif(near, ["a", "b", "c"]) in (["a", "c"], ["b", "c"])
    corr = np.corrcoef(x.T)
    values = np.linalg.eigvalsh(corr)
    got = M.pca(spark.createDataFrame(x.tolist(), "a double, b double"), ["a", "b"], 2).select("component", "share").distinct().orderBy("component").collect()
    assert [r.share for r in got] == pytest.approx(sorted(values / values.sum(), reverse=True))


def test_ward_and_distances(spark):
    rows = [("a", 1, 1.0), ("a", 2, 1.0), ("b", 1, 1.0), ("c", 5, 4.0), ("d", 5, 4.0), ("d", 6, 1.0)]
    d = M.distances(spark.createDataFrame(rows, "g string, k int, v double"), "g", "k", "v")
    assert {(r.a, r.b): round(r.d, 6) for r in d.collect()}[("a", "c")] == round(math.sqrt(18), 6)
    steps = M.ward(d).orderBy("step").collect()
    assert {steps[0].a, steps[0].b} in ({"a", "b"}, {"c", "d"}) and steps[-1]["size"] == 4 and [s.height for s in steps] == sorted(s.height for s in steps)


def test_cell_tails_and_drawn_pairs(spark):
    from tidemark.operators import intervals as I

    df = spark.createDataFrame([(i, w) for i, w in enumerate(["AA"] * 20 + ["CC"] * 20)], "seq_id int, kmer string")
    tails = {(r.base1, r.base2): r for r in M.cell_tails(Q.contingency(df)).collect()}
    assert tails["A", "A"].significant and tails["A", "A"].tail == pytest.approx(2 * special.hypergeometric_tail(20, 20, 20, 40))
    groups = spark.createDataFrame([(g,) for g in "abcde"], "g string")
    pairs = I.draw_pairs(groups, "g", 6, 3)
    assert pairs == I.draw_pairs(groups.repartition(3), "g", 6, 3) and len(pairs) == 6 and all(a != b for a, b in pairs)
    with pytest.raises(ValueError):
        I.centred(groups.selectExpr("1 as summit"), 5)
    assert I.all_bins(spark.createDataFrame([(0, 60), (40, 50)], "start int, stop int")).count() == 2


def test_a_full_join_keeps_nulls_of_the_data(spark):
    from tidemark.operators import tables as T

    a = spark.createDataFrame([(1, None, "x"), (2, 5, "y")], "k int, n int, s string")
    b = spark.createDataFrame([(2, None), (3, 7)], "k int, m int")
    assert sorted(map(tuple, T.full_join_zero(a, b, ["k"]).collect())) == [(1, None, "x", 0), (2, 5, "y", None), (3, 0, None, 7)]


def test_letters_over_a_long_template(spark):
    """A template costs in proportion to its length: this one took minutes letter by letter."""
    from tidemark.functions.scalar import with_gaps

    letters = "ACGTTGCA" * 125_000
    rows = [(letters, "N-" + "A-" * 1_000_000 + "é"), ("GT", "aNcé-GT"), (None, "A"), (None, "--"), ("A", None), ("", "A-"), ("ACG", "")]
    df = spark.createDataFrame(rows, "sample string, template string")
    made = [r.x for r in df.select(with_gaps(df["sample"], df["template"]).alias("x")).collect()]
    assert made == ["N-" + "".join(c + "-" for c in letters) + "é", "GNTé-", None, "--", None, "-", ""]


def test_words_after_a_word_overlap(spark):
    df = spark.createDataFrame([(1, "TACTACTACGGATACNN"), (2, None), (3, "TACGG")], "seq_id long, seq string")
    assert sorted(r.kmer for r in Q.words_after(df, "TAC", 4).collect()) == ["GGAT", "TACG", "TACT"]


@pytest.mark.parametrize("how", Q.BACKGROUNDS)
def test_scores_of_windows_without_rows_for_them(spark, how):
    """Totals, sites and ratios come out as from a row for each window."""
    r = np.random.default_rng(5)
    rows = [(i, "".join(r.choice(list("ACGTN"), n, p=[0.24, 0.24, 0.24, 0.24, 0.04]))) for i, n in enumerate([0, 3, 8, 9, 40, 200])] + [(9, None)]
    df = spark.createDataFrame(rows, "seq_id long, seq string")
    models = Q.markov_models(df, 2).cache()
    bg = Q.background_scores(df, models, 2, 5, how=how).cache()
    one = lambda x: {(y[0], y[1]): tuple(y[2:]) for y in x.collect()}
    want = one(bg.groupBy("seq_id", "strand").agg(F.count("*"), F.sum("log_bg"), F.max("log_bg")))
    got = one(Q.background_totals(df, models, 2, 5, how=how))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    sites = bg.select("seq_id", "strand", "pos")
    place = lambda x: {(y.seq_id, y.strand, y.pos): (y.kmer, round(y.log_bg, 9)) for y in x.collect()}
    assert place(Q.site_backgrounds(sites, df, models, 2, 5, how=how)) == place(bg)
    profile = Q.position_profile(bg, 1.0).cache()
    want = dict(map(tuple, Q.ilr_score(bg, profile).collect()))
    got = dict(map(tuple, Q.sequence_ratios(df, models, profile, 2, how=how).collect()))
    assert got == pytest.approx(want) and want
    scan = {(x.seq_id, x.pos): x.llr for x in Q.scan_profile(df, profile, span=5).collect()}
    some = {(x.seq_id, x.pos): x.llr for x in Q.scan_profile(df, profile, span=5, above=0.0).collect()}
    assert some == {k: v for k, v in scan.items() if v > 0} and 0 < len(some) < len(scan)
    assert scan.keys() == {(x.seq_id, x.pos) for x in Q.valid_sites(df, 5).collect()}


def test_gc_null_sets_meet_their_windows_in_a_join(spark):
    r = np.random.default_rng(3)
    draw = lambda n: "".join(r.choice(list("ACGT"), n))
    seqs = [draw(25) + "nN-" + draw(40), draw(60), "", draw(60), "GC" * 15, "acg"] + [draw(60)] * 2
    source = spark.createDataFrame([*enumerate(seqs), (1, seqs[1]), (1, seqs[1]), (50, None)], "seq_id long, seq string")  # a row thrice, a null
    genome = spark.createDataFrame([("a", draw(6000)), ("b", draw(3000)), ("b", None)], "contig string, seq string")
    texts = [x.seq for x in genome.collect() if x.seq]
    made = motif.gc_null_sets(spark, source.repartition(5), genome, 2, seed=4, window=10, least=5)
    # no set in one worker
    assert "FlatMapCoGroupsInPandas" not in made._jdf.queryExecution().toString()
    rows = sorted(tuple(x) for x in made.collect())
    assert rows == sorted(tuple(x) for x in motif.gc_null_sets(spark, source.coalesce(1), genome, 2, seed=4, window=10, least=5).collect())
    assert [i for _, i, _ in rows] == sorted([*range(8), 1, 1]) * 2
    there = {t[i : i + 10] for t in texts for i in range(len(t) - 9)}
    supply = sum((len(t) // 5 for t in texts), 0)
    for d in (1, 2):
        used = []
        for _, i, s in (x for x in rows if x[0] == d):
            assert [(j, c) for j, c in enumerate(s) if c not in "ACGT"] == [(j, c) for j, c in enumerate(seqs[i]) if c not in "ACGTacgt"]
            for at in range(0, len(s), 10):
                piece = s[at : at + 10]
                if len(piece) == 10 and set(piece) <= set("ACGT"):
                    used.append(piece)
                    assert piece in there
                    old = seqs[i][at : at + 10]
                    if i != 4:  # enough windows
                        assert sum(c in "GC" for c in piece) == sum(c in "GC" for c in old)
        assert len(used) <= supply
    assert [s for d, _, s in rows if d == 1] != [s for d, _, s in rows if d == 2]


def test_gc_shares_never_take_a_window_twice():
    rng = np.random.default_rng(2)
    pieces, windows = {0: 3, 50: 40, 52: 90, 90: 7}, {48: 30, 50: 45, 52: 60, 54: 25}
    got = motif.gc_shares(pieces, windows, 10, rng)
    for gc, n in pieces.items():
        assert sorted(x for g, low, high, _, _ in got if g == gc for x in range(low, high)) == list(range(n))
    for k, n in windows.items():
        taken = [first + x for _, low, high, of, first in got if of == k for x in range(high - low)]
        assert sorted(taken) == list(range(len(taken))) and len(taken) <= n
    assert (50, 0, 36, 50, 0) in got and (52, 0, 51, 52, 0) in got  # their own, while they have 10
    with pytest.raises(ValueError):
        motif.gc_shares({50: 161}, windows, 10, rng)
