"""Shuffled sequences, centre enrichment, profiles with gaps and concurvity against plain versions."""

import math
from collections import Counter

import numpy as np
import pytest

from tidemark.functions import special
from tidemark.operators import controls as C, discovery as D, sequences as Q, stats as M


def pairs(s):
    return Counter(a + b for a, b in zip(s, s[1:]))


def test_shuffles_keep_pairs_and_do_not_depend_on_partitions(spark):
    r = np.random.default_rng(4)
    seqs = ["".join(r.choice(list("ACGT"), n)) for n in (0, 1, 2, 3, 4, 50, 400)] + ["ACGTNNACCA--TTGACATG", "AAAA", None]
    df = spark.createDataFrame(list(enumerate(seqs)), "seq_id long, seq string")
    got = {(x.seq_id, x.copy): x.seq for x in C.pair_shuffled(df.repartition(5), 3, 2).collect()}
    again = {(x.seq_id, x.copy): x.seq for x in C.pair_shuffled(df.coalesce(1), 3, 2).collect()}
    other = {(x.seq_id, x.copy): x.seq for x in C.pair_shuffled(df, 4, 2).collect()}
    assert got == again != other and len(got) == 2 * len(seqs)
    for (i, _), s in got.items():
        assert (s is None) == (seqs[i] is None)
        if s is not None:
            assert pairs(s) == pairs(seqs[i]) and [c if c in "N-" else "x" for c in s] == [c if c in "N-" else "x" for c in seqs[i]]
    assert got[6, 0] != seqs[6] and got[6, 0] != got[6, 1]
    assert C.pair_shuffled(df, 3, 0).count() == 0


def test_every_trail_is_as_likely():
    rng = np.random.default_rng(1)
    text = "ACABACB".replace("B", "G")
    made = Counter(C.euler_shuffle(text, rng) for _ in range(6000))
    from itertools import permutations

    every = {"".join(p) for p in permutations(text) if pairs("".join(p)) == pairs(text)}
    # texts that differ in which of two equal pairs comes first are one text; all have as many such orders
    assert set(made) == every
    expected = 6000 / len(every)
    assert sum((n - expected) ** 2 / expected for n in made.values()) < 3 * len(every) + 10


def test_middles_and_distances(spark):
    freqs = np.full((3, 4), 0.01)
    for i, c in enumerate("GAT"):
        freqs[i, "ACGT".index(c)] = 0.97
    profile = spark.createDataFrame([(i, b, float(freqs[i, j])) for i in range(3) for j, b in enumerate("ACGT")], "col int, base string, freq double")
    rows = [(0, "CCCCCGATTCCC"), (1, "CATCCCCCCCG"), (2, "CCCCCCCCATCC"), (3, "GAT"), (4, None), (5, "CCCCCCCCCCC"), (6, "GGCCCCGATTCCCG")]
    df = spark.createDataFrame(rows, "seq_id long, seq string")
    mid = {x.seq_id: x.seq for x in C.middles(df, 11).collect()}
    assert mid == {0: "CCCCCGATTCC", 1: "CATCCCCCCCG", 2: "CCCCCCCCATC", 5: "CCCCCCCCCCC", 6: "GCCCCGATTCC"}
    # places 0..8, the middle at 4; ATC is GAT on the other strand
    found = {}
    for i, s in mid.items():
        rev = s[::-1].translate(str.maketrans("ACGT", "TGCA"))
        at = [p for p in range(9) if s[p : p + 3] == "GAT"] + [8 - p for p in range(9) if rev[p : p + 3] == "GAT"]
        if at:
            found[i] = abs(2 * at[0] - 8)
    got = {x.distance: x.n for x in C.central_distances(df, profile, 11, most_p=0.02).collect()}
    assert got == Counter(found.values()) == {2: 2, 6: 1, 8: 1}


def test_windows_about_the_middle(spark):
    def plain(counts, places):
        n, out = sum(counts.values()), []
        at = [d for d in range(places) if (d - places + 1) % 2 == 0][:-1]
        for d in at:
            k, w = sum(v for x, v in counts.items() if x <= d), d + 1
            p = sum(math.comb(n, i) * (w / places) ** i * (1 - w / places) ** (n - i) for i in range(k, n + 1))
            out.append((d, w, k, n, pytest.approx(min(p, 1)), pytest.approx(1 - (1 - min(p, 1)) ** len(at), abs=1e-9)))
        return out

    r = np.random.default_rng(2)
    central = Counter(abs(2 * int(x) - 20) for x in np.clip(r.normal(10, 2, 60).round(), 0, 20))
    even = Counter(abs(2 * int(x) - 20) for x in r.integers(0, 21, 60))
    for counts, places in ((central, 21), (even, 21), (Counter({1: 3, 5: 2}), 8)):
        got = C.central_enrichment(spark.createDataFrame(list(counts.items()), "distance int, n long"), places).orderBy("distance").collect()
        assert [tuple(x)[:6] for x in got] == plain(counts, places) and sum(x.best for x in got) == 1
        best = next(x for x in got if x.best)
        assert (best.corrected < 1e-6) == (counts is central)
    assert not any(x.best for x in C.central_enrichment(spark.createDataFrame([], "distance int, n long"), 9).collect())
    assert special.binomial_tail(0, 5, 0.3) == 1 and special.binomial_tail(6, 5, 0.3) == 0 and special.binomial_tail(5, 5, 0.5) == pytest.approx(1 / 32)


def test_columns_out_of_a_profile_and_back(spark):
    sites = spark.createDataFrame([("ACGT",), ("ACGA",), ("TCGA",), ("ACTA",)], "kmer string")
    whole = Q.position_profile(sites, 1.0)
    gapped = Q.gap_columns(whole, [1, 3])
    df = spark.createDataFrame([(1, "ACGTTACGATCGANACTA"), (2, "GGGTACC")], "seq_id long, seq string")
    # as if the columns were not there: the others' scores alone
    part = {(x.col, x.base): x.freq for x in whole.collect() if x.col not in (1, 3)}
    score = lambda w: sum(math.floor(math.log2(part[i, c] / 0.25) * 100 + 0.5) for i, c in enumerate(w) if i not in (1, 3))
    got = D.profile_sites(df, gapped, most_p=1.0).collect()
    assert got and all(x.score == score(x.kmer) for x in got)
    scan = Q.scan_profile(df, gapped, span=4).collect()
    assert scan and all(x.llr == pytest.approx(sum(math.log(part[i, c] / 0.25) for i, c in enumerate(x.kmer) if i not in (1, 3))) for x in scan)
    logo = Q.profile_logo(gapped).collect()
    assert {x.height == 0 for x in logo if x.col in (1, 3)} == {True} and all(x.height > 0 for x in logo if x.col == 0)
    as_map = lambda p: {(x.col, x.base): (round(x.freq, 9), x.is_gap) for x in p.collect()}
    assert as_map(Q.fill_columns(gapped, sites, [1, 3], 1.0)) == as_map(Q.gap_columns(whole, []))
    assert as_map(Q.gap_columns(gapped, [0]))[1, "C"] == (0.25, True)
    longer = as_map(Q.fill_columns(whole.filter("col < 2"), sites, [3], 1.0))
    assert longer[2, "A"] == (0.25, True) and longer[3, "A"] == (0.5, False) and longer[0, "A"][1] is False


def test_concurvity_against_numpy(spark):
    r = np.random.default_rng(7)
    a, b = r.normal(size=500), r.random(500)
    c = a**2 + 0.1 * r.normal(size=500)
    x = np.column_stack([a, b, c, np.ones(500)])
    df = spark.createDataFrame([tuple(map(float, v)) for v in x] + [(None, 1.0, 1.0, 1.0)], "a double, b double, c double, one double")

    def basis(v):
        k = np.quantile(v, [0, 0.25, 0.5, 0.75, 1])
        t, z = (k - k[0]) / (k[-1] - k[0]), (v - k[0]) / (k[-1] - k[0])
        d = lambda q: (np.maximum(z - q, 0) ** 3 - np.maximum(z - 1, 0) ** 3) / (1 - q)
        out = np.column_stack([z] + [d(q) - d(t[-2]) for q in t[:-2]])
        return out - out.mean(0)

    its = {n: basis(v) for n, v in (("a", a), ("b", b), ("c", c))}
    got = {y.term: y for y in M.concurvity(df, ["a", "b", "c", "one"]).collect()}
    assert set(got) == {"a", "b", "c"}
    for n, own in its.items():
        others = np.column_stack([v for m, v in its.items() if m != n])
        fit = others @ np.linalg.lstsq(others, own, rcond=None)[0]
        assert got[n].share == pytest.approx((fit**2).sum() / (own**2).sum(), rel=1e-6)
        qa, qb = np.linalg.qr(own)[0], np.linalg.qr(others)[0]
        assert got[n].worst == pytest.approx(np.linalg.svd(qa.T @ qb)[1].max() ** 2, rel=1e-6)
    assert got["c"].worst > 0.9 > 0.2 > got["b"].share
    assert M.concurvity(df.filter("a > 100"), ["a", "b"]).count() == 0


def test_all_entries_of_vectors(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(200, 20)) @ r.normal(size=(20, 20))
    x[:, 7] = 1.0
    df = spark.createDataFrame([(v,) for v in x.tolist()] + [(None,), ([None] * 20,)], "e array<double>")
    got = {(y.component, y.name): y for y in M.vector_pca(df, "e", 2).collect()}
    with np.errstate(invalid="ignore", divide="ignore"):
        c = np.nan_to_num(np.corrcoef(x.T))
    np.fill_diagonal(c, 1.0)
    values, vectors = np.linalg.eigh(c)
    for n in (1, 2):
        v = vectors[:, -n] * np.sign(vectors[np.abs(vectors[:, -n]).argmax(), -n])
        assert [got[n, f"e{i}"].loading for i in range(20)] == pytest.approx(v.tolist(), abs=1e-8)
        assert got[n, "e0"].share == pytest.approx(values[-n] / 20)
    assert M.vector_pca(df.filter("e is null"), "e", 2).count() == 0


def test_lasso_against_a_plain_one(spark):
    from pyspark.sql import functions as F

    r = np.random.default_rng(5)
    x = r.normal(size=(150, 3)) * [1, 50, 0.1] + [10, 1e6, 3]
    y = 3 * x[:, 0] + 0.2 * x[:, 1] + r.normal(size=150) + 1e5
    df = spark.createDataFrame([(i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))], "key long, a double, b double, c double, y double")
    fold = np.array([q.f for q in df.select("key", F.pmod(F.xxhash64("key"), F.lit(5)).alias("f")).orderBy("key").collect()])

    def fit(x, y, lam):
        z = (x - x.mean(0)) / x.std(0)
        b, t = np.zeros(3), y - y.mean()
        for _ in range(5000):
            for j in range(3):
                rho = z[:, j] @ (t - z @ b + z[:, j] * b[j]) / len(y)
                b[j] = np.sign(rho) * max(abs(rho) - lam, 0)
        return lambda w: y.mean() + (w - x.mean(0)) / x.std(0) @ b

    lambdas = [0.1, 1.0, 5.0]
    got = M.lasso_cv(df, "y", ["a", "b", "c"], "key", lambdas).orderBy("lambda").collect()
    for q, lam in zip(got, lambdas, strict=True):
        errors = [np.mean((y[fold == k] - fit(x[fold != k], y[fold != k], lam)(x[fold == k])) ** 2) for k in sorted(set(fold))]
        assert q.mean_mse == pytest.approx(np.mean(errors), rel=1e-6) and q.se_mse == pytest.approx(np.std(errors, ddof=1) / math.sqrt(5), rel=1e-6)
    assert [q.chosen for q in got].count(True) == 1


def test_chains_side_by_side_are_those_one_by_one(monkeypatch):
    from tidemark.operators import motif

    r = np.random.default_rng(9)
    table = np.cumsum(r.dirichlet([1] * 4, 16), axis=1)[:, :3]
    sizes = [0, 5, 900, 3, 3, 40, 41, 0, 7, 7, 7, 100]
    states, draws = r.integers(0, 16, len(sizes)).tolist(), [r.random(n) for n in sizes]
    together = motif._chains(table, states, draws)
    monkeypatch.setattr(motif, "SIDE_BY_SIDE", 10**9)
    assert together == motif._chains(table, states, draws) and list(map(len, together)) == sizes


def test_merging_in_buckets_of_any_size(spark):
    from tidemark.operators import intervals as I

    r = np.random.default_rng(10)
    rows = [(k, int(a), int(a + n)) for k in ("x", "y", None) for a, n in zip(r.integers(-500, 500, 80), np.where(r.random(80) < 0.05, 200, r.integers(0, 6, 80)), strict=True)]
    df = spark.createDataFrame(rows, "k string, start long, stop long")
    want = sorted(map(str, I.merge_intervals(df, "k").collect()))
    for bucket in (1, 7, 64, 5000):
        assert sorted(map(str, I.merge_intervals(df, "k", bucket=bucket).collect())) == want
    assert I.tile_range(df, "start", 50) == (min(a for _, a, _ in rows) // 50 * 50, max(a for _, a, _ in rows) // 50 * 50 + 50) and I.tile_range(df.limit(0), "start", 50) == (0, 0)


def test_gtf_attributes(spark, tmp_path):
    from tidemark.sources import readers as R

    (tmp_path / "a.gtf").write_text('#c\nchr1\tx\tgene\t5\t9\t.\t+\t.\tgene_id "G1"; gene_name "A;B"; level 2; tag "t1"; tag "t2";\nchr1\tx\texon\t5\n2\tx\texon\t7\tz\t.\t-\t0\tgene_id "G2"\n')
    got = sorted((x.seqid, x.type, x.start, x.stop, x.gene_id, x.gene_name, x.level, x.tag) for x in R.gtf(spark, str(tmp_path / "a.gtf"), ["gene_id", "gene_name", "level", "tag"]).collect())
    assert got == [("2", "exon", 7, None, "G2", None, None, None), ("chr1", "gene", 5, 9, "G1", "A;B", "2", "t1")]


def test_stretches_shuffled_together():
    r = np.random.default_rng(6)
    # every trail is as likely, as many texts of one batch show
    text = "ACAGACG"
    n = 6000
    raw = np.frombuffer(text.encode() * n, np.uint8)
    out = C.shuffle_together(raw, np.arange(1, n + 1) * len(text), r.integers(0, 2**64, n, np.uint64)).tobytes().decode()
    made = Counter(out[i : i + len(text)] for i in range(0, len(out), len(text)))
    from itertools import permutations

    every = {"".join(p) for p in permutations(text) if pairs("".join(p)) == pairs(text)}
    assert set(made) == every
    expected = n / len(every)
    assert sum((x - expected) ** 2 / expected for x in made.values()) < 3 * len(every) + 10
    # a text alone, which takes the plain way, is what it is among others
    texts = ["".join(r.choice(list("ACGT"), int(k), p=[0.6, 0.2, 0.15, 0.05])) + "N" * int(k % 2) for k in r.integers(0, 300, 60)]
    keys = r.integers(0, 2**64, len(texts), np.uint64)
    ends = np.cumsum([len(t) for t in texts])
    whole = C.shuffle_together(np.frombuffer("".join(texts).encode(), np.uint8), ends, keys).tobytes().decode()
    for i, t in enumerate(texts):
        alone = C.shuffle_together(np.frombuffer(t.encode(), np.uint8), np.array([len(t)]), keys[i : i + 1]).tobytes().decode()
        assert alone == whole[ends[i] - len(t) : ends[i]] and pairs(alone) == pairs(t)
