"""The jobs on copies of the given tables: growing input, repeated deliveries, reruns, odd rows."""

import logging
import os
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import common, region_atlas, word_background
from tidemark.operators import intervals as I


def lines(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture()
def parts(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").filter("doc_id < 60")
    return docs, [docs.filter(F.col("doc_id") % 3 == i) for i in range(3)]


def background(spark, tmp_path, name, source):
    word_background.run(spark, str(source), f"{tmp_path}/{name}", f"{tmp_path}/{name}-mark")
    return word_background.background(spark, f"{tmp_path}/{name}")


def test_background_of_growing_input(spark, tmp_path, parts, caplog):
    docs, (a, b, c) = parts
    folder = tmp_path / "grown"
    a.coalesce(1).write.mode("append").parquet(str(folder))
    first = lines(background(spark, tmp_path, "out", folder))
    ids = lambda: sorted(int(r["id"]) for r in spark.read.parquet(f"{tmp_path}/out/ledger").collect())
    with_letters = "length(regexp_replace(text, '[^acgt]', '')) > 0"
    assert ids() == sorted(r["doc_id"] for r in a.filter(with_letters).collect())
    b.union(c).coalesce(1).write.mode("append").parquet(str(folder))
    with caplog.at_level(logging.INFO, logger="tidemark.jobs"):
        grown = lines(background(spark, tmp_path, "out", folder))
    assert f"{b.union(c).count()} new rows in this run" in caplog.text  # the first files are not read again
    docs.coalesce(1).write.parquet(str(tmp_path / "whole"))
    whole = lines(background(spark, tmp_path, "one", tmp_path / "whole"))
    assert grown == whole != first and ids() == sorted(r["doc_id"] for r in docs.filter(with_letters).collect())
    # nothing new; then the same documents delivered again; then the mark is lost
    assert lines(background(spark, tmp_path, "out", folder)) == whole
    a.coalesce(1).write.mode("append").parquet(str(folder))
    assert lines(background(spark, tmp_path, "out", folder)) == whole
    word_background.run(spark, str(folder), f"{tmp_path}/out", f"{tmp_path}/another-mark")
    assert lines(word_background.background(spark, f"{tmp_path}/out")) == whole


def test_background_against_counting(spark, tmp_path):
    rows = [(1, "en", "acgtaac"), (1, "en", "zz tttt"), (2, None, "aXca"), (None, "en", "gggg"), (3, "en", None), (4, "en", "xyz"), (5, "en", "acg")]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").coalesce(1).write.parquet(str(tmp_path / "docs"))
    got = {(r["group"], r["word"]): r for r in background(spark, tmp_path, "out", tmp_path / "docs").collect()}
    # of the two rows with id 1 the first in order counts
    seqs = {"en": ["ACGTAAC", "ACG"], "und": ["ACA"]}
    want = Counter((g, s[i : i + n]) for g, its in seqs.items() for s in its for n in range(1, 6) for i in range(len(s) - n + 1))
    assert {k: r["n"] for k, r in got.items()} == dict(want)
    assert got["en", "AC"]["prob"] == pytest.approx(3 / 4) and got["en", "A"]["prob"] == pytest.approx(0.4)  # AC, AC, AC of AA, AC, AC, AC
    assert got["en", "ACG"]["expected"] == pytest.approx(want["en", "AC"] * want["en", "CG"] / want["en", "C"])
    assert got["en", "A"]["expected"] is None and got["en", "CG"]["expected"] == pytest.approx(3 * 2 / 10)


def test_background_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, lang string, text string").write.parquet(str(tmp_path / "docs"))
    assert background(spark, tmp_path, "out", tmp_path / "docs").count() == 0


ATLAS = [(1, "A", 0, 12), (1, "B", 10, 31), (1, "A", 47, 50), (1, "A", 50, 53), (1, "A", 50, 53), (2, "B", -7, -1), (2, "A", 5, 5), (None, "A", 1, 2), (2, None, 1, 2), (2, "A", None, 2)]


def plain_atlas(rows, width):
    ok = [r for r in rows if None not in r and r[3] > r[2]]
    bins = {}
    for k, g, s, e in ok:
        for b in range(s // width * width, e, width):
            bins.setdefault((k, b), set()).add(g)
    out = []
    for (k, b), gs in sorted(bins.items()):
        if out and out[-1][0] == k and out[-1][2] == b and out[-1][3] == gs:
            out[-1][2] = b + width
        else:
            out.append([k, b, b + width, gs])
    for k, s, e, gs in out:
        met = [min(e, j) - max(s, i) for q, _, i, j in ok if q == k and i < e and s < j]
        yield k, s, e, ",".join(sorted(gs)), (e - s) // width, len(met), max(met), len(gs)


@pytest.mark.parametrize("bucket", [5, 20, 1000])
def test_atlas(spark, tmp_path, caplog, bucket):
    spark.createDataFrame(ATLAS, "k long, g string, s long, e long").write.parquet(str(tmp_path / "iv"))
    config = tmp_path / "c.json"
    config.write_text('{"key": "k", "group": "g", "start": "s", "stop": "e", "width": 5, "bucket": %d}' % bucket)
    for _ in range(2):
        with caplog.at_level(logging.INFO, logger="tidemark.jobs"):
            region_atlas.run(spark, str(tmp_path / "iv"), str(tmp_path / "out"), str(config))
        assert sorted(tuple(r) for r in region_atlas.atlas(spark, str(tmp_path / "out")).collect()) == sorted(plain_atlas(ATLAS, 5))
    assert "read 6 intervals of 2 groups" in caplog.text and "left out 4" in caplog.text
    assert (tmp_path / "out/regions/n_groups=2").is_dir()
    sets = {r["mask"]: r["n"] for r in spark.read.parquet(str(tmp_path / "out/sets")).collect()}
    assert sets == {1: 4, 2: 6, 3: 1}


def test_atlas_of_nothing_and_wrong_settings(spark, tmp_path):
    spark.createDataFrame([], "k long, g string, s long, e long").write.parquet(str(tmp_path / "iv"))
    config = tmp_path / "c.json"
    config.write_text('{"key": "k", "group": "g", "start": "s", "stop": "e", "width": 5, "bucket": 50}')
    region_atlas.run(spark, str(tmp_path / "iv"), str(tmp_path / "out"), str(config))
    assert region_atlas.atlas(spark, str(tmp_path / "out")).count() == 0
    config.write_text('{"key": "k"}')
    with pytest.raises(ValueError, match="expected"):
        region_atlas.run(spark, str(tmp_path / "iv"), str(tmp_path / "out"), str(config))


def test_islands_in_stretches(spark):
    bins = spark.createDataFrame([(k, b * 5) for k in (1, 2) for b in range(-40, 60) if (b * 7 + k) % 11], "key long, bin long")
    assert lines(I.collapse_islands(bins, ["key"], 5, bucket=20)) == lines(I.collapse_islands(bins, ["key"], 5))
    with pytest.raises(ValueError):
        I.collapse_islands(bins, ["key"], 5, bucket=7)


@pytest.mark.parametrize("job", ["region_atlas", "word_background"])
def test_jobs_run_from_the_command_line(data, tmp_path, job):
    table = "lineitem" if job == "region_atlas" else "documents"
    paths = {"--intervals" if job == "region_atlas" else "--input": f"{data}/{table}.parquet", "--output": f"{tmp_path}/out"}
    if job == "word_background":
        paths["--checkpoint"] = f"{tmp_path}/mark"
    done = subprocess.run([sys.executable, "-m", f"jobs.{job}", *[x for p in paths.items() for x in p]], cwd=Path(__file__).parent.parent, env=os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] pyspark-shell"}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read " in done.stderr and "wrote " in done.stderr and any((tmp_path / "out").rglob("*=*/part-*.parquet"))


def test_command_line_stops_what_it_started(monkeypatch):
    class Session:
        stopped = False

        def stop(self):
            self.stopped = True

    made = Session()
    builder = type("B", (), {"appName": lambda self, n: self, "getOrCreate": lambda self: made})()
    monkeypatch.setattr(common, "SparkSession", type("S", (), {"builder": builder}))
    monkeypatch.setattr(sys, "argv", ["job", "--input", "x"])
    common.command_line("About. It", lambda s, a: (_ for _ in ()).throw(KeyError(a.input)) if s.stopped else None, input="i", config="c")
    assert made.stopped
