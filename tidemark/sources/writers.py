"""Writers: BED, delimited tables, FASTA, name lists, motif reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def bed(df: DataFrame, path: str, extra: list[str] | None = None, ordered: bool = True) -> None:
    """Tab, no header, in the byte order of chrom, then by start."""
    cols = ["chrom", "start", "stop", *(extra or [])]
    out = df.select(*cols)
    (out.orderBy("chrom", "start", "stop") if ordered else out).write.csv(path, sep="\t", header=False)


def delimited(df: DataFrame, path: str, sep: str = "\t") -> None:
    df.write.csv(path, sep=sep, header=True)


def name_list(df: DataFrame, col: str, path: str) -> None:
    df.select(F.col(col).cast("string")).filter(F.col(col).isNotNull()).write.text(path)


def fasta(df: DataFrame, path: str, header: str = "header", seq: str = "seq") -> None:
    df.select(F.concat(F.lit(">"), F.col(header), F.lit("\n"), F.col(seq))).write.text(path)


def sequences(df: DataFrame, path: str, name: str = "header", seq: str = "seq") -> None:
    """One sequence a line, after its name and a tab."""
    df.select(F.concat_ws("\t", F.col(name), F.col(seq))).write.text(path)


def zipped_table(df: DataFrame, path: str, member: str = "table.tsv", sep: str = "\t") -> None:
    """A delimited text with a header inside a zip archive. The archive is one file on the driver's machine, to which
    the rows come one partition after another; for large tables write Parquet."""
    import csv
    import io
    import zipfile

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z, z.open(member, "w", force_zip64=True) as raw, io.TextIOWrapper(raw, "utf-8", newline="") as text:
        out = csv.writer(text, delimiter=sep, lineterminator="\n")
        out.writerow(df.columns)
        out.writerows(df.toLocalIterator())


def motif_text(profile: DataFrame, path: str) -> None:
    """One line for each column of a profile: position and the four frequencies."""
    wide = profile.groupBy("col").pivot("base", list("ACGT")).agg(F.max("freq")).orderBy("col")
    wide.select(F.concat_ws("\t", F.col("col").cast("string"), *[F.format_number(b, 4) for b in "ACGT"])).write.text(path)
