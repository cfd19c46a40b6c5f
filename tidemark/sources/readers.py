"""Readers. Every schema is explicit; text that does not fit gives nulls or is left out, as stated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalar import CHROMOSOMES, accession, chromosome_rank, class_and_family, decimal_comma
from ..operators.tables import number_rows

NARROWPEAK = "chrom string, start bigint, stop bigint, peak_name string, display_int int, dot string, fold_change double, p_value double, q_value double, summit_offset int"
REPEAT_FIELDS = ("sw_score", "div", "del", "ins", "query", "q_start", "q_stop", "left", "strand", "element", "class_family", "r_start", "r_end", "r_left", "id")


def narrowpeak(spark: SparkSession, path: str | list[str], filtering: bool = True) -> DataFrame:
    """Peaks with chrom_rank and the file they come from. Filtering keeps the 24 chromosomes and eight columns."""
    df = spark.read.csv(path, sep="\t", schema=NARROWPEAK).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    if filtering:
        df = df.filter(F.col("chrom").isin(*CHROMOSOMES)).drop("display_int", "dot").withColumn("chrom_rank", chromosome_rank(F.col("chrom")))
    return df


def peaks_by_line(spark: SparkSession, paths: str | list[str], pattern: str = r"^([^_]+)_") -> DataFrame:
    """Many peak files, each row tagged with the cell line in its file's name."""
    return narrowpeak(spark, paths).withColumn("cell_line", F.regexp_extract("file", pattern, 1))


def table(spark: SparkSession, path: str, schema: str, sep: str = "\t", header: bool = True) -> DataFrame:
    return spark.read.csv(path, sep=sep, schema=schema, header=header, enforceSchema=True)


def decimal_comma_table(spark: SparkSession, path: str, schema: str, numbers: list[str], sep: str = "\t", header: bool = True) -> DataFrame:
    """A table whose numbers have decimal commas; these columns are declared as string in the schema."""
    df = table(spark, path, schema, sep, header)
    return df.withColumns({c: decimal_comma(F.col(c)) for c in numbers})


def bed(spark: SparkSession, path: str | list[str], extra: str = "") -> DataFrame:
    """chrom, start, stop and further columns as declared; blanks around fields go, comment and track lines too."""
    names = [c.split()[:2] for c in extra.split(",")] if extra else []
    lines = spark.read.text(path).filter(~F.col("value").rlike(r"^\s*(#|track|browser|$)"))
    f = F.split(F.trim("value"), r"\t")
    cols = [F.trim(F.get(f, F.lit(0))).alias("chrom"), F.trim(F.get(f, F.lit(1))).try_cast("bigint").alias("start"), F.trim(F.get(f, F.lit(2))).try_cast("bigint").alias("stop")]
    cols += [F.trim(F.get(f, F.lit(i))).try_cast(t).alias(n) for i, (n, t) in enumerate(names, 3)]
    return lines.select(*cols)


def _records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(header, body) of records that begin with > at the start of a line; > elsewhere is a letter like others.

    Signs that follow the first one in a header are left out, as is text before the first record of a file.
    """
    rec = spark.read.text(path, lineSep="\n>").withColumn("value", F.regexp_replace("value", "\r", ""))
    # the first piece of a file still has its sign; a piece without a line is a header alone
    rec = rec.filter(F.trim(F.regexp_replace("value", r"[\s>]", "")) != "").select(F.ltrim("value").alias("value"))
    return rec.select(F.trim(F.regexp_extract("value", r"^>*([^\n]*)", 1)).alias("header"), F.regexp_replace("value", r"^[^\n]*", "").alias("body"))


def fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(seq_id, header, seq): lines of a record joined, blanks removed, letters in capitals. Ids count in file order."""
    rec = _records(spark, path).select("header", F.upper(F.regexp_replace("body", r"\s", "")).alias("seq"))
    return number_rows(rec, "seq_id").select(F.col("seq_id").cast("int").alias("seq_id"), "header", "seq")


def sequence_chunks(df: DataFrame, size: int = 1 << 20, id_col: str = "seq_id", seq: str = "seq") -> DataFrame:
    """(id, start, seq): sequences cut into rows of so many letters, so that none is as long as a contig."""
    part = F.posexplode(F.regexp_extract_all(seq, F.lit("(?s).{1,%d}" % size), F.lit(0))).alias("__i", "__part")
    return df.select(id_col, seq).select(id_col, part).select(id_col, (F.col("__i").cast("long") * size).alias("start"), F.col("__part").alias("seq"))


def is_fasta(spark: SparkSession, path: str) -> bool:
    """Whether the first character that is not blank is >."""
    first = spark.read.text(path).filter(F.trim("value") != "").first()
    return bool(first) and first[0].lstrip().startswith(">")


def genome(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(contig, seq) with A, C, G, T alone."""
    return _records(spark, path).select(F.regexp_extract("header", r"^(\S*)", 1).alias("contig"), F.regexp_replace(F.upper("body"), "[^ACGT]", "").alias("seq"))


def repeatmasker(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Repeat hits; header lines are left out, class and family come from one field, a missing family is null."""
    rows = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f")).filter((F.size("f") >= 15) & F.get("f", F.lit(0)).rlike("^[0-9]+$"))
    types = {"sw_score": "int", "div": "double", "del": "double", "ins": "double", "q_start": "bigint", "q_stop": "bigint", "id": "int"}
    df = rows.select(*[F.get("f", F.lit(i)).try_cast(types.get(n, "string")).alias(n) for i, n in enumerate(REPEAT_FIELDS)])
    cls, fam = class_and_family(F.col("class_family"))
    return df.withColumns({"class": cls, "family": fam})


def site_locations(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, position): pairs of integers, positions signed by strand."""
    f = F.split(F.trim("value"), r"[\s,]+")
    return spark.read.text(path).filter(F.trim("value").rlike(r"^-?\d+[\s,]+-?\d+")).select(F.get(f, F.lit(0)).cast("int").alias("seq_id"), F.get(f, F.lit(1)).cast("int").alias("position"))


def position_prior(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, header, prior array<double>) from a FASTA-like file of numbers."""
    numbers = F.transform(F.filter(F.split("body", r"\s+"), lambda x: x != ""), lambda x: x.try_cast("double"))
    rec = number_rows(_records(spark, path).select("header", numbers.alias("prior")), "seq_id")
    return rec.select(F.col("seq_id").cast("int").alias("seq_id"), "header", "prior")


def gff3(spark: SparkSession, path: str | list[str], attribute: str = "ID") -> DataFrame:
    """Annotation rows with one attribute."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).filter(~F.startswith("value", F.lit("#")) & (F.size(f) >= 9))
    names = ("seqid", "source", "type", "start", "stop", "score", "strand", "phase", "attributes")
    df = rows.select(*[F.get(f, F.lit(i)).alias(n) for i, n in enumerate(names)])
    found = F.regexp_extract("attributes", rf"(?:^|;){attribute}=([^;]*)", 1)
    return df.withColumns({"start": F.col("start").try_cast("bigint"), "stop": F.col("stop").try_cast("bigint"), attribute.lower(): F.nullif(found, F.lit(""))})


def gtf(spark: SparkSession, path: str | list[str], attributes: list[str]) -> DataFrame:
    """Annotation rows with the named attributes (key "value"; ...) as columns; one that is absent is null.

    Of an attribute that is given several times the first value counts. Lines with fewer than nine fields are left out.
    """
    f = F.split("value", "\t")
    rows = spark.read.text(path).filter(~F.startswith("value", F.lit("#")) & (F.size(f) >= 9))
    names = ("seqid", "source", "type", "start", "stop", "score", "strand", "frame")
    df = rows.select(*[F.get(f, F.lit(i)).alias(n) for i, n in enumerate(names)], F.get(f, F.lit(8)).alias("__a"))
    found = {a: F.nullif(F.coalesce(F.nullif(F.regexp_extract("__a", rf'(?:^|;)\s*{a}\s+"([^"]*)"', 1), F.lit("")), F.regexp_extract("__a", rf'(?:^|;)\s*{a}\s+([^";\s]+)', 1)), F.lit("")) for a in attributes}
    return df.select("seqid", "source", "type", F.col("start").try_cast("bigint").alias("start"), F.col("stop").try_cast("bigint").alias("stop"), "score", "strand", "frame", *[c.alias(a) for a, c in found.items()])


def transcripts(annotation: DataFrame, kind: str = "transcript", col: str = "type") -> DataFrame:
    return annotation.filter(F.col(col) == kind)


def protein_summary(spark: SparkSession, path: str, species: str | None = "HUMAN", least: float = 1.3) -> DataFrame:
    """Protein rows with their accession, above a score and of one species; names are cleaned of blanks and signs."""
    df = spark.read.csv(path, sep="\t", header=True)
    for c in df.columns:
        df = df.withColumnRenamed(c, "".join(x if x.isalnum() else "_" for x in c).strip("_").lower())
    df = df.withColumns({"score": decimal_comma(F.col("unused")), "accession_id": accession(F.col("accession"))}).filter(F.col("score") >= least)
    return df.filter(F.col("species") == species) if species else df


def aligned(spark: SparkSession, path: str) -> tuple[DataFrame, str, bool]:
    """Aligned sequences (name, seq), their format (fasta, clustal, flat), and whether they are nucleotides (90 % rule)."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), F.col("value"))
    head = lines.filter(F.trim("value") != "").orderBy("at").first()
    first = head.value if head else ""
    if first.lstrip().startswith(">"):
        kind, df = "fasta", fasta(spark, path).select(F.col("header").alias("name"), "seq")
    elif first.startswith("CLUSTAL"):
        kind = "clustal"
        m = lines.filter(F.col("value").rlike(r"^\S+\s+[A-Za-z.-]+(\s+\d+)?\s*$") & ~F.startswith("value", F.lit("CLUSTAL")))
        m = m.select("at", F.regexp_extract("value", r"^(\S+)", 1).alias("name"), F.regexp_extract("value", r"^\S+\s+([A-Za-z.-]+)", 1).alias("part"))
        g = m.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("p"))
        df = g.select("name", F.upper(F.array_join(F.transform("p", lambda x: x["part"]), "")).alias("seq"))
    else:
        kind = "flat"
        df = lines.filter(F.trim("value") != "").select(F.col("at").cast("string").alias("name"), F.upper(F.trim("value")).alias("seq"))
    letters = F.regexp_replace("seq", "[^A-Z]", "")
    r = df.agg(F.sum(F.length(letters)).alias("n"), F.sum(F.length(F.regexp_replace("seq", "[^ACGTUN]", ""))).alias("k")).first()
    return df, kind, bool(r.n) and r.k >= 0.9 * r.n


def motif_report(spark: SparkSession, path: str) -> DataFrame:
    """(name, value) of the scores and counts that a motif finder printed as ``name: number`` or ``name = number``,
    with a share in brackets or without."""
    m = r"^\s*([A-Za-z][A-Za-z0-9() -]*?)\s*[:=]\s*(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)\s*(?:\([^)]*\))?\s*$"
    return spark.read.text(path).filter(F.col("value").rlike(m)).select(F.regexp_extract("value", m, 1).alias("name"), F.regexp_extract("value", m, 2).cast("double").alias("value"))


def report_words(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, position, kmer, strand, score) of the aligned sites in the same reports: an index, the letters before,
    first and last place around the word, the letters after, strand and score."""
    m = r"^\s*(\d+)\s+[acgtnx]*\s+(-?\d+)\s+([ACGTNX]+)\s+-?\d+\s+[acgtnx]*\s+\(([+-])\)(?:\s+Score=\s*(-?[0-9.]+))?.*$"
    part = lambda i: F.regexp_extract("value", m, i)
    rows = spark.read.text(path).filter(F.col("value").rlike(m))
    return rows.select(part(1).cast("int").alias("seq_id"), part(2).cast("int").alias("position"), part(3).alias("kmer"), part(4).alias("strand"), part(5).try_cast("double").alias("score"))


def with_header(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """A table whose columns are named by its first line; types follow from all values, which is a pass of its own."""
    return spark.read.csv(path, sep=sep, header=True, inferSchema=True)


def zipped_table(spark: SparkSession, path: str, schema: str, sep: str = "\t", header: bool = True) -> DataFrame:
    """The rows of the delimited texts inside zip archives, one archive a task, read line by line."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def lines(batches):
        import io
        import zipfile

        import pyarrow as pa

        for batch in batches:
            for content in batch.column(0):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for name in sorted(z.namelist()):
                        with io.TextIOWrapper(z.open(name), "utf-8") as text:
                            if header:
                                next(text, None)
                            part = []
                            for line in text:
                                part.append(line.rstrip("\r\n"))
                                if len(part) == 10_000:
                                    yield pa.RecordBatch.from_arrays([pa.array(part)], names=["value"])
                                    part = []
                            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string())], names=["value"])

    return files.mapInArrow(lines, "value string").select(F.from_csv("value", schema, {"sep": sep}).alias("x")).select("x.*")
