"""Published results: scores of motif sites, nearest features, sets of names."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import intervals as I, motif, sequences as Q, tables as T

DATA = Path(__file__).parent / "data"

# Sites (sequence, place: 1..n, or -1..-n on the other strand) by motif width, with the log scores that
# were published for them: the sum of site ratios with its prior (order 5, weight 0.2) and of mean likelihood ratios.
SITES = {
    8: ("7 169;15 18;21 21;26 31;34 220;44 -103;60 -43;63 -45;71 -159;74 128;78 -182;80 -54", 21.41, 38.84),
    14: ("1 59;3 -119;4 -138;5 105;9 106;10 170;11 137;12 -76;13 -339;18 197;19 70;21 39;23 -53;24 65;27 -113;30 -79;31 101;34 110;37 -81;39 71;40 -152;44 75;45 -126;46 103;48 -70;49 -73;50 94;51 -75;57 -128;61 52;62 -121;63 -117;70 55;72 76;74 -70;75 71;77 120;80 102;82 98", 66.62, 101.39),
    20: ("6 142;13 -94;15 27;22 81;36 -135;44 75;45 114;51 -75;71 -121;72 76;73 -90;77 120", 71.83, 89.23),
}
# The words of the sites of width 8.
WORDS = "AAAAAGAA AAAAAGAA AAGGAGAA AAAAAGAA AAAGAGAA AAGAAGAA AAAAAGAA AAAGAGAA AAGGAGAA AAGAAGAA AAGGAGAA ATGAAGAA".split()
# Scores of single sites of width 8, in the order of the sequences.
SINGLE = [3.699, 1.867, 3.949, 3.249, 3.367, 5.084, 1.929, 2.647, 3.051, 4.212, 2.748, 3.007]


def regions():
    return (DATA / "regions.txt").read_text().split()


def places(width):
    return [tuple(map(int, x.split())) for x in SITES[width][0].split(";")]


@pytest.mark.parametrize("width", SITES)
def test_scores_of_published_sites(width):
    seqs = regions()
    data = motif.Sequences(seqs, width, 5)
    sites = np.full(len(seqs), -1)
    for i, p in places(width):
        sites[i] = p - 1 if p > 0 else 2 * len(seqs[i]) + p
        assert motif.public_position(int(sites[i]), len(seqs[i]), width) == p
    _, clr, ilr = SITES[width]
    assert motif.clr(data, sites, 0.2) == pytest.approx(clr, abs=0.006)
    assert motif.ilr(data, data.counts(sites), sites) == pytest.approx(ilr, abs=0.006)
    assert motif.run_score(data, sites, motif.MotifOptions(seed=1, width=width, rank="clr")) == pytest.approx(clr, abs=0.006)


def test_scores_of_published_sites_on_frames(spark):
    seqs = regions()
    df = spark.createDataFrame(list(enumerate(seqs)), "seq_id int, seq string")
    bg = Q.background_scores(df, Q.markov_models(df, 5), 5, 8, how="flank")
    at = spark.createDataFrame([(i, 1 if p > 0 else -1, p - 1 if p > 0 else len(seqs[i]) + p) for i, p in places(8)], "seq_id int, strand int, pos int")
    n_valid = bg.groupBy("seq_id").agg(F.count("*").alias("n_valid"))
    assert Q.clr_score(at, bg, n_valid, zoops=0.2).first().clr == pytest.approx(21.41, abs=0.006)
    met = at.join(bg, ["seq_id", "strand", "pos"])
    assert [r.kmer for r in met.orderBy("seq_id").collect()] == WORDS
    profile = Q.position_profile(met)
    chosen = Q.ilr_score(bg, profile).join(at.select("seq_id"), "seq_id", "left_semi")
    assert chosen.agg(F.sum("ilr")).first()[0] == pytest.approx(38.84, abs=0.006)
    single = Q.site_ratios(met, profile).join(n_valid, "seq_id").orderBy("seq_id").select((F.col("llr") - F.log("n_valid")).alias("x"))
    assert [r.x for r in single.collect()] == pytest.approx(SINGLE, abs=0.0006)
    assert "".join(r.letter for r in Q.consensus(profile).orderBy("col").collect()) == "AANAAGAA"


def test_published_nearest_features(spark):
    rows = [line.split("\t") for line in (DATA / "nearest.tsv").read_text().splitlines()]
    a = sorted({tuple(r[:3]) for r in rows})
    b = sorted({tuple(r[3:8]) for r in rows})
    left = spark.createDataFrame([(c, f"{c}:{s}-{e}", int(s), int(e)) for c, s, e in a], "chrom string, a_id string, a_start long, a_stop long")
    right = spark.createDataFrame([(c, int(s), int(e), strand, name) for c, s, e, strand, name in b], "chrom string, b_start long, b_stop long, b_strand string, name string")
    for bucket in (None, 5000, 1 << 30):
        got = I.nearest(left, right, "chrom", 2, bucket=bucket).select("chrom", "a_start", "a_stop", "chrom", "b_start", "b_stop", "b_strand", "name", "distance").collect()
        assert sorted(tuple(map(str, r)) for r in got) == sorted(map(tuple, rows))


def test_published_sets(spark):
    a, b = (spark.createDataFrame([(x,) for x in (DATA / f).read_text().split()], "symbol string") for f in ("names_a.txt", "names_b.txt"))
    got = {r.status: r.n for r in T.compare_sets(a, b, "symbol").groupBy("status").agg(F.count("*").alias("n")).collect()}
    assert got == {"common": 37, "lost": 21, "gained": 82}
    assert a.intersect(b).count() == 37 and a.subtract(b).count() == 21 and b.subtract(a).count() == 82
