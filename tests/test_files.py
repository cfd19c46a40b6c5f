"""Readers and writers on small files."""

from tidemark.sources import readers as R, writers as W


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_narrowpeak(spark, tmp_path):
    p = put(tmp_path, "A549_x.narrowPeak", "chr2\t10\t20\tp1\t5\t.\t1.5\t2.5\t3.5\t4\nGL000\t1\t2\tp2\t5\t.\t1\t2\t3\t4\nchrM\t1\t2\tp3\t5\t.\t1\t2\t3\t4\n")
    rows = R.peaks_by_line(spark, p).collect()
    assert [(r.chrom, r.peak_name, r.chrom_rank, r.cell_line) for r in rows] == [("chr2", "p1", 2, "A549")]
    assert R.narrowpeak(spark, p, filtering=False).count() == 3


def test_fasta_round_trip(spark, tmp_path):
    p = put(tmp_path, "a.fa", ">one x\nACG\nTTn\n>two\n\nGG\n")
    rows = R.fasta(spark, p).orderBy("seq_id").collect()
    assert [(r.header, r.seq) for r in rows] == [("one x", "ACGTTN"), ("two", "GG")]
    assert R.is_fasta(spark, p) and R.genome(spark, p).orderBy("contig").first().seq == "ACGTT"
    W.fasta(R.fasta(spark, p), str(tmp_path / "out"))
    assert {(r.header, r.seq) for r in R.fasta(spark, str(tmp_path / "out")).collect()} == {("one x", "ACGTTN"), ("two", "GG")}


def test_tables(spark, tmp_path):
    p = put(tmp_path, "h.tsv", "name\tquantity\na\t30,88\nb\tx\n")
    assert [r.quantity for r in R.decimal_comma_table(spark, p, "name string, quantity string", ["quantity"]).collect()] == [30.88, None]
    p = put(tmp_path, "b.bed", "track x\nchr1\t5\t9 \tn1 \n\nchr1\t1\t3\tn2\n")
    df = R.bed(spark, p, "name string")
    assert sorted(map(tuple, df.collect())) == [("chr1", 1, 3, "n2"), ("chr1", 5, 9, "n1")]
    W.bed(df, str(tmp_path / "bed"), ["name"])
    assert R.bed(spark, str(tmp_path / "bed"), "name string").count() == 2


def test_repeatmasker_and_gff(spark, tmp_path):
    p = put(tmp_path, "r.out", "   SW   perc\nscore   div.\n\n  463   1.3  0.6  1.7  chr1  10001 10468 (248) +  (TAACCC)n  Simple_repeat  1 463 (0)  1 *\n  12 1 1 1 c 1 2 (3) C AluY SINE/Alu (0) 2 1 2\n")
    rows = R.repeatmasker(spark, p).orderBy("id").collect()
    assert [(r["class"], r.family, r.q_start) for r in rows] == [("Simple_repeat", None, 10001), ("SINE", "Alu", 1)]
    p = put(tmp_path, "g.gff", "##gff\nchr1\ts\tgene\t1\t9\t.\t+\t.\tID=g1;Name=x\n")
    assert [(r.start, r.id) for r in R.gff3(spark, p).collect()] == [(1, "g1")]


def test_alignments(spark, tmp_path):
    p = put(tmp_path, "c.aln", "CLUSTAL W\n\na  ACG-\nb  ACGT\n   ****\n\na  TT\nb  TA\n")
    df, kind, nucleotides = R.aligned(spark, p)
    assert (kind, nucleotides) == ("clustal", True) and {r.name: r.seq for r in df.collect()} == {"a": "ACG-TT", "b": "ACGTTA"}
    df, kind, nucleotides = R.aligned(spark, put(tmp_path, "f.txt", "MKV\nMRL\n"))
    assert (kind, nucleotides, df.count()) == ("flat", False, 2)


def test_streaming_tiles(spark, tmp_path):
    from pyspark.sql import functions as F
    from tidemark.streaming.windows import tile_stream

    src = str(tmp_path / "in")
    spark.range(100).select((F.col("id") * 60).cast("timestamp").alias("ts"), (F.col("id") % 2).alias("k")).write.parquet(src)
    s = tile_stream(spark.readStream.schema("ts timestamp, k long").parquet(src), "ts", "10 minutes", ["k"], late="0 seconds")
    q = s.writeStream.format("memory").queryName("tiles").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("tiles").agg(F.sum("n")).first()[0] == 100


def test_other_windows_on_streams(spark, tmp_path):
    from pyspark.sql import functions as F
    from tidemark.streaming.windows import session_stream, sliding_stream

    src, minute = str(tmp_path / "in"), F.col("id") * 60
    spark.range(60).filter("id % 20 < 10").select(minute.cast("timestamp").alias("ts"), F.lit(1).alias("k")).write.parquet(src)
    rows = spark.readStream.schema("ts timestamp, k int").parquet(src)
    for name, s in (("slides", sliding_stream(rows, "ts", "10 minutes", "5 minutes", ["k"], late="0 seconds")), ("sessions", session_stream(rows, "ts", "5 minutes", ["k"], late="0 seconds"))):
        q = s.writeStream.format("memory").queryName(name).outputMode("complete" if name == "slides" else "append").trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert spark.table("slides").agg(F.sum("n")).first()[0] == 60
    # the last session is still open when the rows end
    assert sorted(r.n for r in spark.table("sessions").collect()) in ([10, 10], [10, 10, 10])


def test_late_rows_are_left_out(spark, tmp_path):
    from pyspark.sql import functions as F
    from tidemark.streaming.windows import tile_stream

    src = str(tmp_path / "in")
    base = spark.range(1).select(F.lit(0).alias("i"))
    for k, second in enumerate((100_000, 200_000, 10)):  # the third comes long after its time
        base.select(F.lit(second).cast("timestamp").alias("ts"), F.lit(k).alias("k")).write.mode("append").parquet(src)
        s = tile_stream(spark.readStream.schema("ts timestamp, k int").parquet(src), "ts", "10 minutes", [], late="1 minute")
        q = s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
    starts = {r.start.timestamp() for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert 0.0 not in starts and len(starts) >= 1


def test_reports(spark, tmp_path):
    text = "Log CLR generated from sites: 21.41\nNumber of predicted sites: 12 (14.46%)\nnot a number: x\n  7   aggga    169 AAAAAGAA 176    cccca  (+) Score=   3.699  >r\n 44   cctat    103 AAGAAGAA 96     aggtg  (-) Score=   5.084  >r\n"
    p = put(tmp_path, "m.txt", text)
    assert {r.name: r.value for r in R.motif_report(spark, p).collect()} == {"Log CLR generated from sites": 21.41, "Number of predicted sites": 12.0}
    assert sorted(map(tuple, R.report_words(spark, p).collect())) == [(7, 169, "AAAAAGAA", "+", 3.699), (44, 103, "AAGAAGAA", "-", 5.084)]
    sites = put(tmp_path, "s.txt", "# x\n0 12\n3, -7\nx y\n")
    assert sorted(map(tuple, R.site_locations(spark, sites).collect())) == [(0, 12), (3, -7)]
    prior = put(tmp_path, "p.txt", ">a\n0.1 0.2\n0.3\n>b\n1\n")
    assert [(r.seq_id, r.header, r.prior) for r in R.position_prior(spark, prior).orderBy("seq_id").collect()] == [(0, "a", [0.1, 0.2, 0.3]), (1, "b", [1.0])]


def test_more_tables(spark, tmp_path):
    p = put(tmp_path, "t.csv", "a,b\n1,x\n2,y\n")
    df = R.with_header(spark, p, ",")
    assert df.dtypes == [("a", "int"), ("b", "string")] and df.count() == 2
    W.zipped_table(df, str(tmp_path / "t.zip"))
    assert sorted(map(tuple, R.zipped_table(spark, str(tmp_path / "t.zip"), "a int, b string").collect())) == [(1, "x"), (2, "y")]
    W.delimited(df, str(tmp_path / "d"))
    assert R.table(spark, str(tmp_path / "d"), "a int, b string").count() == 2
    W.name_list(df, "b", str(tmp_path / "n"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "n")).collect()) == ["x", "y"]
    W.sequences(spark.createDataFrame([("h", "ACGT")], "header string, seq string"), str(tmp_path / "q"))
    assert spark.read.text(str(tmp_path / "q")).first().value == "h\tACGT"
    p = put(tmp_path, "g.gff", "chr1\ts\tgene\t1\t9\t.\t+\t.\tID=g1\nchr1\ts\ttranscript\t1\t9\t.\t+\t.\tID=t1\n")
    assert [r.id for r in R.transcripts(R.gff3(spark, p)).collect()] == ["t1"]
    p = put(tmp_path, "p.tsv", "N\tUnused\tAccession\tName\tSpecies\n1\t2,5\tsp|P1|ONE_HUMAN\tOne\tHUMAN\n2\t1,0\tsp|P2|TWO_HUMAN\tTwo\tHUMAN\n3\t9\tsp|P3|X_MOUSE\tX\tMOUSE\n")
    rows = R.protein_summary(spark, p).collect()
    assert [(r.score, r.name) for r in rows] == [(2.5, "One")]
