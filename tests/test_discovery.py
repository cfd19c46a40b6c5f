"""Motif comparison, site p-values, discriminative words, and what they rest on, against plain versions."""

import itertools
import math
import os
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from tidemark.functions import special
from tidemark.operators import discovery as D, sequences as Q, stats as M, tables as T
from tidemark.plans import queries as plans
from tidemark.sources import readers as R

# -- tails and rates -------------------------------------------------------------------------------------------------


def exact_tail(k, m, d, t):
    return float(sum(Fraction(math.comb(m, i) * math.comb(t - m, d - i), math.comb(t, d)) for i in range(k, min(m, d) + 1)))


def test_upper_tails_against_fractions():
    cases = [(k, m, d, t) for t in (1, 7, 12) for m in range(t + 1) for d in range(t + 1) for k in range(max(0, d + m - t), min(m, d) + 1)]
    got = special.upper_tails(*zip(*cases, strict=True))
    assert got == pytest.approx([exact_tail(*c) for c in cases], rel=1e-9, abs=1e-15)
    assert special.upper_tails([300], [1000], [1200], [5000])[0] == pytest.approx(exact_tail(300, 1000, 1200, 5000), rel=1e-9)
    far = special.upper_tails([500], [1000], [1200], [5000])[0]
    assert 0 < far == pytest.approx(exact_tail(500, 1000, 1200, 5000), rel=1e-8)
    assert special.upper_tails([1000], [1000], [1200], [5000])[0] == 0  # below what a double holds
    assert np.isnan(special.upper_tails([3, 0, 1, 1], [2, 5, 9, 1], [2, 6, 2, 9], [9, 9, 8, 8])).tolist() == [True, True, True, True]
    assert special.upper_tails([10**6], [10**8], [10**7], [10**9])[0] == pytest.approx(0.5, abs=0.001)  # memory does not follow the numbers
    assert special.hypergeometric_tails([5, 2], [5, 5], [5, 5], [10, 10]) == pytest.approx([special.hypergeometric_tail(5, 5, 5, 10), special.hypergeometric_tail(2, 5, 5, 10)])


def plain_bh(p):
    p = np.array(p)
    order = np.argsort(p, kind="stable")
    raw = p[order] * len(p) / np.searchsorted(p[order], p[order], side="right")
    q = np.empty(len(p))
    q[order] = np.minimum(1, np.minimum.accumulate(raw[::-1])[::-1])
    return q


def test_benjamini_hochberg(spark):
    r = np.random.default_rng(1)
    groups = {g: np.round(np.concatenate([r.random(80), r.random(40) ** 8, [0.0, 1.0, 1.0, 1e-300]]), d).tolist() for g, d in (("a", 12), ("b", 2), (None, 4))}
    rows = [(g, p) for g, ps in groups.items() for p in ps] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, p double")
    got = M.benjamini_hochberg(df, "p", ["g"]).collect()
    assert len(got) == len(rows) and [x.q_value for x in got if x.p is None] == [None]
    for g, ps in groups.items():
        have = sorted((x.p, x.q_value) for x in got if x.g == g and x.p is not None)
        assert np.allclose(have, sorted(zip(ps, plain_bh(ps).tolist(), strict=True)))
    alone = [x.q_value for x in M.benjamini_hochberg(df.filter("g = 'b'"), "p").orderBy("p").collect()]
    assert alone == pytest.approx(np.sort(plain_bh(groups["b"])).tolist())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_set_enrichment_of_a_universe_that_is_counted(spark, sf):
    d = f"/root/testdata/{sf}"
    if not os.path.isdir(d):
        pytest.skip("the driver's tables are not here")
    events = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_type").toPandas()
    size = events.groupby("user_id").size()
    chosen = set(size[size > 60].index)
    sets = {t: set(u) for t, u in events.groupby("event_type")["user_id"]}
    total = events["user_id"].nunique()
    tails = {}
    for t, members in sets.items():
        lo, hi = max(0, len(members) + len(chosen) - total), min(len(members), len(chosen))
        pmf = [math.comb(len(members), i) * math.comb(total - len(members), len(chosen) - i) for i in range(lo, hi + 1)]
        k, whole = len(members & chosen) - lo, math.comb(total, len(chosen))
        tails[t] = min(1.0, float(Fraction(sum(pmf[: k + 1]), whole)), float(Fraction(sum(pmf[k:]), whole)))
    q = dict(zip(tails, plain_bh(list(tails.values())), strict=True))
    got = {r.set_name: r for r in plans.QUERIES["set_enrichment"](spark, d).collect()}
    assert set(got) == set(sets)
    for t, r in got.items():
        assert (r.set_size, r.overlap) == (len(sets[t]), len(sets[t] & chosen))
        assert r.tail == pytest.approx(tails[t], rel=1e-6) and r.fdr == pytest.approx(q[t], rel=1e-6)


def test_a_universe_too_small_is_refused(spark):
    sets = spark.createDataFrame([("s", "a"), ("s", "b"), ("t", None)], "set_name string, symbol string")
    with pytest.raises(ValueError, match="universe"):
        M.overlap_enrichment(sets, sets.select("symbol"), 1)
    got = {r.set_name: r for r in M.overlap_enrichment(sets, sets.filter("symbol = 'a'").select("symbol"), 10).collect()}
    assert got["s"].tail == pytest.approx(0.2) and (got["t"].set_size, got["t"].overlap) == (0, 0)


# -- motif against motif ---------------------------------------------------------------------------------------------


def random_motifs(seed, n, widths=(2, 3)):
    r = np.random.default_rng(seed)
    return [(f"m{i}", np.round(r.dirichlet([0.4] * 4, int(r.choice(widths))), 3)) for i in range(n)]


def as_frame(spark, motifs):
    return spark.createDataFrame([(n, m.ravel().tolist() if m is not None else None) for n, m in motifs], "motif string, freqs array<double>")


def plain_comparison(query, targets, least, both, metric):
    sides = [s for _, t in targets for s in ((t, t[::-1, ::-1]) if both else (t,))]
    columns = np.concatenate(sides)
    like = D.column_likeness(query, columns, metric)
    for name, t in targets:
        options, need = [], min(least, len(query), len(t))
        for strand, side in ((1, t), (-1, t[::-1, ::-1]))[: 1 + both]:
            own = D.column_likeness(query, side, metric)
            for offset in range(-len(t), len(query) + 1):
                pairs = [(i, i - offset) for i in range(len(query)) if 0 <= i - offset < len(t)]
                if len(pairs) < need or not pairs:
                    continue
                score = sum(own[i, j] for i, j in pairs)
                reached = sum(sum(c) >= score for c in itertools.product(*[like[i].tolist() for i, _ in pairs]))
                options.append((reached / len(columns) ** len(pairs), -len(pairs), abs(offset), offset, -strand, score))
        p, overlap, _, offset, strand, score = min(options)
        yield name, (offset, -strand, -overlap, score), p, 1 - (1 - p) ** len(options)


@pytest.mark.parametrize("both", [True, False])
@pytest.mark.parametrize("metric", ["distance", "pearson"])
def test_motifs_against_all_offsets(spark, monkeypatch, both, metric):
    monkeypatch.setattr(D, "TOGETHER", 2)  # the queries go in several blocks
    targets = random_motifs(3, 6)
    queries = random_motifs(4, 3) + [("flat", np.full((2, 4), 0.25))]
    got = D.compare_motifs(as_frame(spark, queries), as_frame(spark, [*targets, ("none", None), ("empty", np.zeros((0, 4)))]), 2, both, metric).collect()
    assert len(got) == 24
    for name, q in queries:
        its = {r.target: r for r in got if r.query == name}
        for target, place, p, corrected in plain_comparison(q, targets, 2, both, metric):
            r = its[target]
            assert (r.offset, r.strand, r.overlap, r.score) == place and r.p_offset == pytest.approx(p) and r.p_value == pytest.approx(corrected)
            assert r.e_value == pytest.approx(6 * corrected)
        ps = [its[t].p_value for t in sorted(its)]
        assert [its[t].q_value for t in sorted(its)] == pytest.approx(plain_bh(ps).tolist())


def test_a_motif_is_found_again_shifted_and_on_the_other_strand(spark):
    motifs = [(f"r{i}", m) for i, (_, m) in enumerate(random_motifs(9, 60, (8, 12)))]
    query = motifs[5][1]
    shifted = np.concatenate([np.full((2, 4), 0.25), query[:-1]])
    targets = motifs[:5] + motifs[6:] + [("shifted", shifted), ("reversed", query[::-1, ::-1])]
    got = {r.target: r for r in D.compare_motifs(as_frame(spark, [("q", query)]), as_frame(spark, targets)).collect()}
    assert (got["shifted"].offset, got["shifted"].strand) == (-2, 1) and (got["reversed"].offset, got["reversed"].strand) == (0, -1)
    assert max(got["shifted"].q_value, got["reversed"].q_value) < 0.01 < min(r.q_value for t, r in got.items() if t.startswith("r") and t != "reversed")
    assert D.compare_motifs(as_frame(spark, []), as_frame(spark, targets)).count() == 0
    assert D.compare_motifs(as_frame(spark, [("q", query)]), as_frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        list(D._matrices(["x"], [[0.1] * 5]))


def test_seed_profiles(spark):
    df = spark.createDataFrame([("g", "TTACCGGTATTACCGGAC"), ("g", "ACC"), ("h", "NNNN"), ("h", None)], "g string, seq string")
    ((name, freqs),) = [(r.motif, np.array(r.freqs).reshape(-1, 4)) for r in D.seed_profiles(df, "g", 4, 1, 1.0, "g").collect()]
    assert name == "g"
    # TTAC stands at 0, too near the end, and at 9; ACCG at 2 and 11, with T and G beside it
    assert np.allclose(freqs[0], [1 / 6, 1 / 6, 1 / 6, 3 / 6]) and freqs[1].argmax() == 0 and len(freqs) == 6


def plain_seeds(rows, k, flank, pseudo):
    out = {}
    for g in {g for g, s in rows if g is not None and s}:
        spans = [s[i : i + k + 2 * flank] for n, s in rows if n == g and s for i in range(len(s) - k - 2 * flank + 1)]
        spans = [x for x in spans if not set(x) - set("ACGT")]
        n = Counter(x[flank : flank + k] for x in spans)
        if n:
            top = min(n, key=lambda w: (-n[w], w))
            spans = [x for x in spans if x[flank : flank + k] == top]
            out[g] = [(sum(x[j] == b for x in spans) + pseudo) / (len(spans) + 4 * pseudo) for j in range(k + 2 * flank) for b in "ACGT"]
    return out


@pytest.mark.parametrize("block", [1 << 20, 40])
@pytest.mark.parametrize("k", [2, 9])
def test_seed_profiles_count_letters_not_windows(spark, monkeypatch, block, k):
    monkeypatch.setattr(Q, "BLOCK", block)  # with 40, the groups of more letters are counted in blocks
    r = np.random.default_rng(8)
    text = lambda n: "".join(r.choice(list("ACGTNa"), n, p=[0.3, 0.2, 0.23, 0.23, 0.02, 0.02]))
    rows = [(g, text(n)) for g in ("one", "two", "three") for n in (0, 3, 30, 90, 41, 12)] + [(f"r{i}", text(25)) for i in range(30)]
    rows += [("one", None), (None, text(60)), ("two", rows[3][1]), ("short", "ACG"), ("gaps", "N" * 50)]
    frame = spark.createDataFrame(rows, "g string, seq string").repartition(5)
    seeds = D.seed_profiles(frame, "g", k, 2, 0.5, "g")
    got = {x.motif: x.freqs for x in seeds.collect()}
    want = plain_seeds(rows, k, 2, 0.5)
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g]) for g in want)
    assert "Generate" not in seeds._jdf.queryExecution().executedPlan().toString()  # no row for a window


# -- sites of a profile ----------------------------------------------------------------------------------------------


def test_scores_have_the_distribution_of_all_words():
    r = np.random.default_rng(2)
    scores, share = r.integers(-250, 200, (6, 4)), np.array([0.4, 0.1, 0.2, 0.3])
    lowest, probs = D.score_distribution(scores, share)
    want = np.zeros(len(probs))
    for word in itertools.product(range(4), repeat=6):
        want[sum(scores[i, c] for i, c in enumerate(word)) - lowest] += math.prod(share[c] for c in word)
    assert probs == pytest.approx(want) and probs.sum() == pytest.approx(1)


@pytest.mark.parametrize("block", [5, 1 << 20])
def test_sites_against_all_windows(spark, monkeypatch, block):
    monkeypatch.setattr(Q, "BLOCK", block)
    r = np.random.default_rng(8)
    seqs = ["".join(r.choice(list("ACGTN"), 60, p=[0.3, 0.2, 0.2, 0.28, 0.02])) for _ in range(20)] + ["ACG", "", None]
    df = spark.createDataFrame(list(enumerate(seqs)), "seq_id long, seq string")
    freqs = r.dirichlet([1] * 4, 4)
    profile = spark.createDataFrame([(i, b, float(freqs[i, j])) for i in range(4) for j, b in enumerate("ACGT")], "col int, base string, freq double")
    background = {"A": 3.0, "C": 2.0, "G": 2.0, "T": 3.0}
    share = {b: n / 10 for b, n in background.items()}
    score = lambda w: sum(math.floor(math.log2(freqs[i, "ACGT".index(c)] / share[c]) * 50 + 0.5) for i, c in enumerate(w))
    words = {"".join(w): score(w) for w in itertools.product("ACGT", repeat=4)}
    tail = {s: sum(math.prod(share[c] for c in w) for w, v in words.items() if v >= s) for s in set(words.values())}
    sites = []
    for i, s in enumerate(seqs):
        for strand, text in ((1, s or ""), (-1, (s or "")[::-1].translate(str.maketrans("ACGT", "TGCA")))):
            sites += [(i, strand, p, text[p : p + 4]) for p in range(len(text) - 3) if set(text[p : p + 4]) <= set("ACGT")]
    q = dict(zip(sites, plain_bh([round(tail[words[x[3]]], 12) for x in sites]), strict=True))
    got = D.profile_sites(df, profile, background, most_p=0.1, scale=50).collect()
    want = {x for x in sites if tail[words[x[3]]] <= 0.1}
    assert {(x.seq_id, x.strand, x.pos, x.kmer) for x in got} == want and len(got) == len(want) > 0
    for x in got:
        assert x.score == words[x.kmer] and x.p_value == pytest.approx(tail[x.score]) and x.q_value == pytest.approx(q[x.seq_id, x.strand, x.pos, x.kmer])
    with pytest.raises(ValueError):
        D.integer_scores(spark.createDataFrame([(0, "A", 0.0)], "col int, base string, freq double"), share)


# -- words that tell sets apart --------------------------------------------------------------------------------------


def fits(pattern):
    return re.compile("(?=" + "".join(f"[{D.CODES[c]}]" for c in pattern) + ")")


def holds(pattern, seq, both):
    return bool(fits(pattern).search(seq or "")) or both and bool(fits(D.reverse_pattern(pattern)).search(seq or ""))


@pytest.mark.parametrize("both", [True, False])
def test_pattern_counts(spark, both):
    r = np.random.default_rng(3)
    rows = [(i, "".join(r.choice(list("ACGTN"), 30)), bool(i % 2)) for i in range(30)] + [(98, None, True), (99, "AC", False), (97, "ACGTACGT", None)]
    df = spark.createDataFrame(rows, "seq_id long, seq string, positive boolean")
    held = D.held_words(df, 4, both)
    patterns = ["ACGT", "ANNR", "WSKM", "BDHV", "AAAA", "NNNN", "YACG"]
    got = {x.pattern: (x.pos, x.neg) for x in D.pattern_counts(held, patterns, both).collect()}
    assert got == {p: tuple(sum(holds(p, s, both) for _, s, flag in rows if flag is want) for want in (True, False)) for p in patterns}


def test_words_stay_with_their_sequence(spark):
    """Counting words moves sequences once, not a row for each word; rows of one id are one sequence."""
    rows = [(1, "ACGTAC", True), (1, "GGGGACGT", True), (2, "ACGTT", False), (2, None, False), (3, "ACGNN", True), (3, "ACGTT", None)]
    df = spark.createDataFrame(rows, "seq_id long, seq string, positive boolean").repartition(3)
    held = D.held_words(df, 4, False)
    assert {(x.id, x.positive): len(x.words) for x in held.collect()} == {(1, True): 7, (2, False): 2, (3, True): 0}
    want = {"ACGT": (1, 1), "CGTA": (1, 0), "GTAC": (1, 0), "GGGG": (1, 0), "GGGA": (1, 0), "GGAC": (1, 0), "GACG": (1, 0), "CGTT": (0, 1)}
    assert {x.word: (x.pos, x.neg) for x in D.word_counts(held, 4).collect()} == want
    counts = D.pattern_counts(held, ["ACGT", "NNNN"], False)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan  # no row for each word
    assert {x.pattern: (x.pos, x.neg) for x in counts.collect()} == {"ACGT": (1, 1), "NNNN": (1, 1)}
    with pytest.raises(ValueError):
        D.held_words(df, 32)


def plain_search(rows, k, beam, both):
    """The search itself, with every count made anew by looking through the sequences."""
    pos_all, neg_all = (sum(f is w for _, _, f in rows) for w in (True, False))

    def test(p):
        pos, neg = (sum(holds(p, s, both) for _, s, f in rows if f is w) for w in (True, False))
        return exact_tail(pos, pos_all, pos + neg, pos_all + neg_all), p, pos, neg

    words = {s[i : i + k] for _, s, _ in rows for i in range(len(s) - k + 1) if set(s[i : i + k]) <= set("ACGT")}
    words = {min(w, D.reverse_pattern(w)) if both else w for w in words}
    known = {x[1]: x for x in sorted(map(test, words))[:beam]}
    tested, now = len(words), list(known)
    while now:
        before = min(known.values())
        new = {w for p in now for w in D.wider(p)} - known.keys()
        known |= {p: test(p) for p in new}
        tested += len(new)
        now = [x[1] for x in sorted(known[p] for p in new)[:beam]] if min(known.values()) < before else []
    return *min(known.values()), tested


def test_a_planted_pattern_is_found_and_erased(spark):
    r = np.random.default_rng(11)
    draw = lambda n: "".join(r.choice(list("ACGT"), n))
    rows = []
    for i in range(80):
        s = draw(40)
        if i % 2 and i % 10 != 1:
            site = "GA" + r.choice(["C", "T"]) + "GCA"
            s = s[:10] + (site if i % 4 == 1 else D.reverse_pattern(site)) + s[16:]
        rows.append((i, s, bool(i % 2)))
    df = spark.createDataFrame(rows, "seq_id long, seq string, positive boolean")
    got = D.discriminative_words(df, k=6, beam=5, most=2, most_e=1e-3).collect()
    assert len(got) == 1 and holds(got[0].pattern, "GACGCA", True)  # erased, it is not found again
    p, pattern, pos, neg, tested = plain_search(rows, 6, 5, True)
    assert (got[0].pattern, got[0].pos, got[0].neg, got[0].pos_all, got[0].neg_all) == (pattern, pos, neg, 40, 40)
    assert got[0].p_value == pytest.approx(p) and got[0].e_value == pytest.approx(p * tested, rel=1e-6)


def test_no_patterns_without_both_kinds(spark):
    df = spark.createDataFrame([(1, "ACGTACGT", True), (2, None, True), (3, "AC", None)], "seq_id long, seq string, positive boolean")
    assert D.discriminative_words(df).count() == 0
    assert D.discriminative_words(df.filter("false")).count() == 0
    assert D.reverse_pattern("AYKBN") == "NVMRT" and sorted(D.wider("RA"))[:3] == ["DA", "NA", "RD"]


# -- rows without one task -------------------------------------------------------------------------------------------


def test_rows_are_numbered_in_order_over_many_partitions(spark):
    df = spark.range(1000).selectExpr("(id * 617) % 1000 as v", "id").repartition(7)
    got = T.number_rows(df, "at", "v").collect()
    assert sorted((r.at, r.v) for r in got) == [(i, i) for i in range(1000)]
    assert T.number_rows(df.filter("false"), "at").count() == 0
    a, b = spark.range(5).selectExpr("id as x"), spark.range(3).selectExpr("-id as y")
    assert sorted(((r.x, r.y) for r in T.bind_columns(a, b, "x", "y").collect()), key=str) == sorted([(0, -2), (1, -1), (2, 0), (3, None), (4, None)], key=str)


def test_records_begin_at_line_starts_only(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">s1 A->B map\nac\ngt\n>s2\n\n>>s3 >x\r\nN N\r\n>only a header")
    got = sorted(tuple(r) for r in R.fasta(spark, str(tmp_path / "a.fa")).collect())
    assert got == [(0, "s1 A->B map", "ACGT"), (1, "s2", ""), (2, "s3 >x", "NN"), (3, "only a header", "")]
    (tmp_path / "p.txt").write_text(">a -> b\n0.5 1e-3\n0.25\n>b\n")
    assert [(r.header, r.prior) for r in R.position_prior(spark, str(tmp_path / "p.txt")).orderBy("seq_id").collect()] == [("a -> b", [0.5, 0.001, 0.25]), ("b", [])]


def test_many_records_in_many_splits(spark, tmp_path):
    lines = "".join(f">r{i} x>y\n{'ACGT' * (i % 5)}\n" for i in range(5000))
    (tmp_path / "m.fa").write_text(lines)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = R.fasta(spark, str(tmp_path / "m.fa")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.seq_id, r.header, r.seq) for r in got) == [(i, f"r{i} x>y", "ACGT" * (i % 5)) for i in range(5000)]
    chunks = R.sequence_chunks(spark.createDataFrame([(1, "ABCDEFG"), (2, ""), (3, None)], "seq_id long, seq string"), 3)
    assert sorted(tuple(r) for r in chunks.collect()) == [(1, 0, "ABC"), (1, 3, "DEF"), (1, 6, "G")]


# -- exact quantiles -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("ranges,ranked", [(16, 3), (4096, 1 << 16)])
def test_exact_quantiles(spark, monkeypatch, ranges, ranked):
    monkeypatch.setattr(T, "RANGES", ranges)
    monkeypatch.setattr(T, "RANKED", ranked)
    r = np.random.default_rng(6)
    groups = {"a": r.lognormal(0, 6, 101).tolist(), None: [1.0] * 7 + [2.0] * 3, "b": [5.0], "c": r.integers(0, 4, 50).astype(float).tolist(), "d": [-1e308, 1e308, 0.0, 1e-320], "e": [1.0, np.nextafter(1.0, 2)]}
    rows = [(g, float(v)) for g, its in groups.items() for v in its] + [("a", None), ("z", None), ("a", math.nan)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(x.g, x.p): x.quantile for x in T.exact_quantiles(df, ["g"], "v", probs).collect()}
    assert set(got) == {(g, p) for g in groups for p in probs}
    for g, its in groups.items():
        s = sorted(its)
        for p in probs:
            at = (len(s) - 1) * p
            k, part = math.floor(at), (len(s) - 1) * p - math.floor(at)
            assert got[g, p] == pytest.approx(s[k] * (1 - part) + s[math.ceil(at)] * part)
    assert T.exact_quantiles(df.filter("v is null"), [], "v", [0.5]).count() == 0
    assert T.above_quantile(df.filter("g = 'c'"), ["v"], 0.5).count() == sum(v > np.median(groups["c"]) for v in groups["c"])
    assert T.above_quantile(df.filter("v is null"), ["v"], 0.5).count() == 0


@pytest.mark.parametrize("both", [True, False])
def test_alignments_side_by_side(both):
    """Targets of one width at once come out as one after another."""
    r = np.random.default_rng(8)
    draw = lambda n: r.dirichlet([0.3] * 4, n)
    for columns, width in ((6, 6), (4, 9), (9, 3), (1, 5)):
        query, targets = draw(columns), np.stack([draw(width) for _ in range(20)])
        null = D._Null(r.dirichlet([1.0] * (D.STEPS + 1), columns))
        got = list(zip(*D.best_alignments(query, targets, null, 4, both, "distance"), strict=True))
        for x, target in zip(got, targets, strict=True):
            want = D.best_alignment(query, target, null, 4, both, "distance")
            assert tuple(x[:4]) == want[:4] and x[4:] == pytest.approx(want[4:])
